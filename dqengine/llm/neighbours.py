"""Approximate nearest neighbours by largest inner product: NN-descent and greedy graph search.

Equal vectors are one node. Nodes get one more component so that all have one length; then the nearest by angle is the
nearest by inner product. Leaves of random projections give every node first neighbours. NN-descent then improves
them by joins: a block asks for the vectors of its nodes' neighbours in either direction; there, neighbours of one node
meet as neighbours of neighbours, and those that are nearer to each other than what they have are sent back. A query
starts from its entry nodes, expands the best nodes of its beam, and ends when there is nothing left to expand. Scores
of the result are inner products of the original vectors in double precision.

Nodes live in blocks of bounded size, in files of the shared folder that only the tasks of a block read and write. A block
task holds its nodes and those sent to it, never the whole table. All that is moved is moved in passes, each over a part
of every block or of the queries, and freed before the next: the disk holds the graph and what one pass moves.
"""

from __future__ import annotations

import io
import uuid
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from dqengine.llm.common import ship
from dqengine.session import brief_shuffles, release, scratch_path

EMPTY = -1
#: Queries whose beams are kept in one group.
QUERIES = 64
#: Blocks of a table with few nodes and of one with enough for blocks of eight times the usual size, and the most nodes of a block.
FEW, BLOCKS, LARGEST = 32, 256, 1 << 17
#: Tasks that messages are dealt to at most.
TASKS = 512
#: Nodes whose neighbours meet in one multiplication.
TOGETHER = 64
#: What one pass may move: so many times the bytes of all vectors, and on small tables so many bytes.
MOVED, SMALL = 0.75, 256 << 20
FOUND = "block int, own binary, ids binary, scores binary"


@dataclass(frozen=True)
class Settings:
    """``neighbours`` and ``reverse``: length of a node's lists. ``trees``, ``leaf``: the random projections.

    NN-descent ends after ``rounds``, or when under ``still`` of all list places changed. ``sent``: candidates that a
    node gets from one common neighbour. ``beam``: nodes a query keeps expanding; ``kept``: nodes it remembers.
    ``block``: nodes of a block, on average. A search has no most rounds. The numbers hold for one block; ``grown``
    gives those of a larger table.
    """

    neighbours: int = 40
    reverse: int = 40
    trees: int = 4
    leaf: int = 512
    rounds: int = 5
    still: float = 0.02
    sent: int = 8
    beam: int = 160
    kept: int = 256
    block: int = 2048
    seed: int = 7

    def grown(self, nodes: int) -> Settings:
        """``trees``, ``rounds``, ``sent``, ``beam`` and ``kept`` follow the logarithm of the number of nodes."""
        more = max(0, int(np.ceil(np.log2(max(1, nodes / self.block)))))
        wider = more * self.beam // 16
        return replace(
            self, trees=self.trees + more, rounds=self.rounds + more, sent=self.sent + more // 2,
            beam=self.beam + wider, kept=self.kept + wider,
        )


def block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(blocks)).astype(np.int32)


def block_size(nodes: int, block: int) -> int:
    """Nodes of a block: ``block`` on small tables, more on others, so that there are ``FEW`` and later ``BLOCKS`` of them."""
    blocks = -(-nodes // min(max(block, min(8 * block, -(-nodes // FEW)), -(-nodes // BLOCKS)), LARGEST))
    return -(-nodes // blocks)


def _mixed(keys: np.ndarray) -> np.ndarray:
    keys = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys = (keys ^ (keys >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return keys ^ (keys >> np.uint64(32))


def _vectors(column, width: int) -> np.ndarray:
    """The vectors of an Arrow column, one below the other."""
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, width) if len(column) else np.zeros((0, width))


def _numbers(batches):
    for batch in batches:
        yield from batch["block"].tolist()


def _best(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, flags: np.ndarray | None, most: int):
    """Of (owner, id, score, flag) the ``most`` best ids of each owner, best first, each id once.

    Of equal ids the first given stays. Returns the four arrays and the place inside the owner's list.
    """
    order = np.lexsort((ids, owner))
    owner, ids, scores = owner[order], ids[order], scores[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])
    order, owner, ids, scores = order[fresh], owner[fresh], ids[fresh], scores[fresh]
    by_score = np.lexsort((-scores, owner))  # of equal scores the smaller id is first
    order, owner, ids, scores = order[by_score], owner[by_score], ids[by_score], scores[by_score]
    first = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    place = np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)]))
    keep = place < most
    return owner[keep], ids[keep], scores[keep], None if flags is None else flags[order[keep]], place[keep]


def _packed(owner: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """Sorted owners, each once, and for each column of values the bytes of the owner's run."""
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    stops = np.r_[starts[1:], len(owner)]
    return owner[starts], [[v[a:b].tobytes() for a, b in zip(starts, stops)] for v in values]


def _unpacked(lists: pd.Series, kind) -> tuple[np.ndarray, np.ndarray]:
    """Values of packed lists, and the length of each list."""
    size = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(lists), kind), np.array([len(x) // size for x in lists], np.int64)


def _by_block(block: np.ndarray, *values: np.ndarray) -> list[tuple]:
    """For every block its number and the bytes of its part of each column of values."""
    small = len(block) and block.max() < 1 << 16
    order = np.argsort(block.astype(np.uint16) if small else block, kind="stable")
    key, packed = _packed(block[order], *[v[order] for v in values])
    return list(zip(key.tolist(), *packed))


def _found(owners: list, others: list, values: list, size: int, kind) -> pd.DataFrame:
    """Candidates for the lists of ``owners``, packed for their blocks."""
    if not owners:
        return pd.DataFrame([], columns=["block", "own", "ids", "scores"])
    own = np.concatenate(owners).astype(kind)
    packed = own, np.concatenate(others).astype(kind), np.concatenate(values).astype(np.float32)
    return pd.DataFrame(_by_block(own // size, *packed), columns=["block", "own", "ids", "scores"])


def _joined(lists: list[np.ndarray], back: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of each node in either direction, each once, and whether one is new in either; ``EMPTY`` at the ends."""
    (ids, _, flags), (links, fresh) = lists, back
    new = np.concatenate([flags > 0, np.unpackbits(fresh, axis=1, count=links.shape[1]) > 0], axis=1)
    key = np.concatenate([ids, links], axis=1).astype(np.int64) * 2 + ~new
    key.sort(axis=1)
    gone = key >> 1 == EMPTY
    gone[:, 1:] |= key[:, 1:] >> 1 == key[:, :-1] >> 1
    key[gone] = np.iinfo(np.int64).max
    key.sort(axis=1)
    none = key == np.iinfo(np.int64).max
    return np.where(none, EMPTY, key >> 1).astype(ids.dtype), (key & 1 == 0) & ~none


class Blocks:
    """Arrays of blocks in files of the shared folder, written and read by the tasks that hold a block.

    A file is under a draft name until it is complete, and a repeated task writes it again.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, name: str, block: int, *arrays: np.ndarray) -> None:
        files, folder = fs.FileSystem.from_uri(self.folder)
        files.create_dir(f"{folder}/{name}", recursive=True)
        path = f"{folder}/{name}/{block}"
        draft = f"{path}.{uuid.uuid4().hex}.draft"
        with files.open_output_stream(draft, compression=None) as out:
            for array in arrays:
                np.lib.format.write_array(out, np.ascontiguousarray(array), allow_pickle=False)
        files.move(draft, path)

    def read(self, name: str, block: int) -> list[np.ndarray]:
        files, folder = fs.FileSystem.from_uri(self.folder)
        with files.open_input_file(f"{folder}/{name}/{block}") as source:
            data = io.BytesIO(source.read())
        arrays = []
        while data.tell() < data.getbuffer().nbytes:
            arrays.append(np.lib.format.read_array(data, allow_pickle=False))
        return arrays


class Stored:
    """A table in the shared folder that is dropped as soon as nothing reads it any more."""

    def __init__(self, df: DataFrame, label: str):
        self.spark, self.path = df.sparkSession, scratch_path(df.sparkSession, label)
        df.write.parquet(self.path)
        self.rows = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        release(self.spark, self.path)


def _together(tables: list[Stored]) -> DataFrame:
    rows = tables[0].rows
    for more in tables[1:]:
        rows = rows.union(more.rows)
    return rows


class Graph:
    """A neighbour graph over the distinct vectors of a table, numbered from 0; ``size`` consecutive numbers are a block.

    Files of a block: ``vectors`` (as given, and the component that gives all one length), ``members`` (the ids of the
    rows of each node), and for each state of the graph ``lists`` (ids, scores, and 0 for an entry that is known, 1 for
    one that is new, 2 for one that came in this round), ``low`` (the last score of a list) and ``back`` (ids of nodes
    that have this one in their list, and whether it is new there). After the last round ``links`` has all neighbours.

    ``distinct`` has the columns number, v and ids. What a pass moves is held under ``most_bytes``.
    """

    def __init__(self, distinct: DataFrame, count: int, dimensions: int, settings: Settings):
        self.spark, self.count, self.width = distinct.sparkSession, count, dimensions + 1
        self.s = settings = settings.grown(count)
        self.size = size = block_size(count, settings.block)
        self.blocks = -(-count // size)
        self.kind = np.int32 if count < 1 << 31 else np.int64
        self.item = np.dtype(distinct.schema["v"].dataType.elementType.jsonValue())
        self.most_bytes = max(SMALL, MOVED * count * dimensions * self.item.itemsize)
        self.tasks = min(TASKS, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        self.folder = scratch_path(self.spark, "graph")
        self.files, self.state = Blocks(self.folder), 0
        self._settle(distinct)

    def build(self) -> Graph:
        settings = self.s
        self._plant()
        changed = self.count
        for _ in range(settings.rounds):
            if changed <= settings.still * self.count * settings.neighbours:
                break
            self._turn()
            changed = self._descend()
        self._turn()
        self._link()
        return self

    def _drop(self, *names: str) -> None:
        for name in names:
            release(self.spark, f"{self.folder}/{name}")

    def _each(self, key: str = "block", groups: int | None = None) -> DataFrame:
        """A row for each block."""
        groups = groups or self.blocks
        return self.spark.range(0, groups, 1, min(groups, self.tasks)).select(F.col("id").cast("int").alias(key))

    def _with_all(self, messages: DataFrame) -> DataFrame:
        """Messages to blocks, and an empty one to each, so that those take part that get none."""
        blocks = self.spark.range(0, self.blocks, 1, 1).select(F.col("id").cast("int").alias("block"))
        return messages.union(blocks.select("block", *[F.expr("X''")] * (len(messages.columns) - 1)))

    def _dealt(self, df: DataFrame, key: str = "block", groups: int | None = None) -> DataFrame:
        """Few bytes of messages can stand for much work, so the number of tasks does not follow them."""
        return df.repartition(min(groups or self.blocks, self.tasks), key)

    def _grouped(self, df: DataFrame, key: str = "block", groups: int | None = None):
        return self._dealt(df, key, groups).groupBy(key)

    def _settle(self, distinct: DataFrame) -> None:
        """Writes the vectors and members of each block."""
        width, size, files, item = self.width, self.size, self.files, self.item

        def sums(batches):
            total, longest = np.zeros(width - 1), 0.0
            for batch in batches:
                vectors = _vectors(batch.column("v"), width - 1).astype(np.float64)
                if len(vectors):
                    total += vectors.sum(axis=0)
                    longest = max(longest, float((vectors**2).sum(axis=1).max()))
            yield pa.RecordBatch.from_pydict({"total": pa.array([total.tobytes()]), "longest": pa.array([longest])})

        found = distinct.select("v").mapInArrow(sums, "total binary, longest double").collect()
        self.longest = longest = max(r.longest for r in found) or 1.0
        self.mean = np.r_[sum(np.frombuffer(r.total) for r in found) / self.count, 0.0] / np.sqrt(longest)

        def write(key, table):
            table = table.sort_by("number").combine_chunks()
            block = key[0].as_py()
            vectors = _vectors(table.column("v"), width - 1).astype(item)
            rest = np.sqrt(np.maximum(longest - (vectors.astype(np.float64) ** 2).sum(axis=1), 0.0) / longest)
            ids = table.column("ids").combine_chunks()
            lengths = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
            files.write("vectors", block, vectors, rest.astype(np.float32))
            files.write("members", block, np.r_[0, np.cumsum(lengths)], pc.list_flatten(ids).to_numpy(zero_copy_only=False))
            return pa.table({"rows": pa.array([table.num_rows], pa.int64())})

        block = F.expr(f"cast(number div {size} as int)")
        placed = self._grouped(distinct.withColumn("block", block)).applyInArrow(write, "rows long")
        assert placed.agg(F.sum("rows")).first()[0] == self.count

    def _reader(self):
        """A function that reads the vectors of a block, all of one length, in single precision."""
        files, root = self.files, np.sqrt(self.longest)

        def scaled(block: int) -> np.ndarray:
            vectors, rest = files.read("vectors", block)
            return np.column_stack([(vectors / root).astype(np.float32), rest])

        return scaled

    def _plant(self) -> None:
        """The best neighbours inside the leaves of a few random projections; large leaves are cut at random."""
        s, width, blocks, size, kind, files = self.s, self.width, self.blocks, self.size, self.kind, self.files
        scaled, mean = self._reader(), self.mean
        bits = max(0, int(np.ceil(np.log2(max(1, self.count / s.leaf)))))
        planes = np.random.default_rng(s.seed).normal(size=(s.trees, bits, width))

        def leaves(vectors: np.ndarray, tree: int) -> np.ndarray:
            side = (vectors - mean) @ planes[tree].T > 0
            return (side * (1 << np.arange(bits))).sum(axis=1) + (tree << bits)

        per_tree = self.count * (2 * width + 20 + 12 * s.neighbours)
        slices = int(-(-per_tree // self.most_bytes))
        together = max(1, int(self.most_bytes // per_tree))
        for trees in (range(t, min(t + together, s.trees)) for t in range(0, s.trees, together)):

            def tell(batches, trees=trees):
                for block in _numbers(batches):
                    vectors = scaled(block)
                    for tree in trees:
                        leaf, n = np.unique(leaves(vectors, tree), return_counts=True)
                        yield pd.DataFrame(_by_block(block_of(leaf, blocks), leaf, n), columns=["bucket", "leaf", "n"])

            def large(group: pd.DataFrame) -> pd.DataFrame:
                leaf, at = np.unique(_unpacked(group["leaf"], np.int64)[0], return_inverse=True)
                n = np.bincount(at, _unpacked(group["n"], np.int64)[0]).astype(np.int64)
                over = n > 2 * s.leaf
                return pd.DataFrame({"leaf": leaf[over], "pieces": -(-n[over] // (2 * s.leaf))})

            sizes = self._each().mapInPandas(tell, "bucket int, leaf binary, n binary")
            sizes = self._grouped(sizes, "bucket").applyInPandas(large, "leaf long, pieces long").toPandas()
            sizes = sizes.sort_values("leaf")
            cut, pieces = np.r_[sizes["leaf"].to_numpy(np.int64), 1 << 62], np.r_[sizes["pieces"].to_numpy(np.int64), 1]
            for turn in range(slices):

                def send(batches, trees=trees, cut=cut, pieces=pieces, turn=turn, state=self.state):
                    for block in _numbers(batches):
                        vectors = scaled(block)
                        half, own = vectors.astype(np.float16), block * size + np.arange(len(vectors))
                        low = files.read(f"low-{state}", block)[0] if state else np.full(len(own), -np.inf, np.float32)
                        for tree in trees:
                            leaf = leaves(vectors, tree)
                            at = np.searchsorted(cut, leaf)
                            piece = block_of(own * 64 + tree, np.where(cut[at] == leaf, pieces[at], 1))
                            cell = _mixed(leaf * (1 << 20) + piece)
                            take = np.flatnonzero((cell >> np.uint64(40)) % np.uint64(slices) == turn)
                            bucket = (cell[take] % np.uint64(blocks)).astype(np.int32)
                            yield pd.DataFrame(
                                _by_block(bucket, own[take].astype(kind), cell[take], half[take], low[take]),
                                columns=["bucket", "own", "cell", "vec", "low"],
                            )

                def nearest(group: pd.DataFrame) -> pd.DataFrame:
                    cell, _ = _unpacked(group["cell"], np.uint64)
                    order = np.argsort(cell, kind="stable")
                    ids, low = _unpacked(group["own"], kind)[0][order], _unpacked(group["low"], np.float32)[0][order]
                    half = np.frombuffer(b"".join(group["vec"]), np.float16).reshape(-1, width)
                    starts = np.flatnonzero(np.r_[True, cell[order][1:] != cell[order][:-1]])
                    owners, others, values = [], [], []
                    for a, b in zip(starts, [*starts[1:], len(ids)]):
                        most = min(s.neighbours, b - a - 1)
                        if not most:
                            continue
                        vectors = half[order[a:b]].astype(np.float32)
                        scores = vectors @ vectors.T
                        np.fill_diagonal(scores, -np.inf)
                        best = np.argpartition(scores, b - a - most, axis=1)[:, -most:]
                        value = np.take_along_axis(scores, best, axis=1)
                        better = value > low[a:b, None]
                        owners.append(np.repeat(ids[a:b], better.sum(axis=1)))
                        others.append(ids[a:b][best[better]])
                        values.append(value[better])
                    return _found(owners, others, values, size, kind)

                sent = self._each().mapInPandas(send, "bucket int, own binary, cell binary, vec binary, low binary")
                last = trees[-1] == s.trees - 1 and turn == slices - 1
                self._merge(self._grouped(sent, "bucket").applyInPandas(nearest, FOUND), last)

    def _merge(self, found: DataFrame, last: bool) -> int:
        """Better neighbours taken from ``found``. ``last`` ends the round. Returns the number of entries that are new then."""
        most, kind, files, old, state = self.s.neighbours, self.kind, self.files, self.state, self.state + 1
        size, count = self.size, self.count

        def merge(new: pd.DataFrame) -> pd.DataFrame:
            block = int(new["block"].iloc[0])
            n = min(size, count - block * size)
            if old:
                ids, scores, flags = files.read(f"lists-{old}", block)
            else:
                ids, scores, flags = np.full((n, most), EMPTY, kind), np.full((n, most), -np.inf, np.float32), np.zeros((n, most), np.uint8)
            owner = _unpacked(new["own"], kind)[0] - block * size
            if len(owner):
                touched = np.zeros(n, bool)
                touched[owner] = True
                row = np.flatnonzero(touched)
                owner = (np.cumsum(touched) - 1)[owner]
                there = ids[row] != EMPTY
                place = np.broadcast_to(np.arange(len(row))[:, None], there.shape)[there]
                found_ids, _ = _unpacked(new["ids"], kind)
                place, found_ids, value, flag, at = _best(
                    np.r_[place, owner], np.r_[ids[row][there], found_ids],
                    np.r_[scores[row][there], _unpacked(new["scores"], np.float32)[0]],
                    np.r_[flags[row][there], np.full(len(owner), 2, np.uint8)], most,
                )
                ids[row], scores[row], flags[row] = EMPTY, -np.inf, 0
                ids[row[place], at], scores[row[place], at], flags[row[place], at] = found_ids, value, flag
            if last:
                flags = (flags == 2).astype(np.uint8)
            files.write(f"lists-{state}", block, ids, scores, flags)
            files.write(f"low-{state}", block, scores[:, -1])
            return pd.DataFrame({"changed": [int((flags > 0).sum())]})

        merged = self._grouped(self._with_all(found)).applyInPandas(merge, "changed long")
        changed = merged.agg(F.sum("changed")).first()[0]
        self.state = state
        if old:
            self._drop(f"lists-{old}", f"low-{old}")
        return changed

    def _turn(self) -> None:
        """Writes the nearest nodes that have a node in their lists, and counts neighbours where something is new."""
        most, kind, files, size, state, count = self.s.reverse, self.kind, self.files, self.size, self.state, self.count

        def turned(batches):
            for block in _numbers(batches):
                ids, scores, flags = files.read(f"lists-{state}", block)
                there = ids != EMPTY
                own = np.broadcast_to(block * size + np.arange(len(ids), dtype=kind)[:, None], ids.shape)[there]
                # The nearest of one block are enough for those of all.
                to, own, score, new, _ = _best(ids[there], own.astype(kind), scores[there], flags[there], most)
                yield pd.DataFrame(_by_block(to // size, to, own, score, new), columns=["block", "own", "ids", "scores", "new"])

        def gather(edges: pd.DataFrame) -> pd.DataFrame:
            block = int(edges["block"].iloc[0])
            n = min(size, count - block * size)
            back, fresh = np.full((n, most), EMPTY, kind), np.zeros((n, most), np.uint8)
            owner, ids, _, new, at = _best(
                _unpacked(edges["own"], kind)[0] - block * size, _unpacked(edges["ids"], kind)[0],
                _unpacked(edges["scores"], np.float32)[0], _unpacked(edges["new"], np.uint8)[0], most,
            )
            back[owner, at], fresh[owner, at] = ids, new
            fresh = np.packbits(fresh, axis=1)
            files.write("back", block, back, fresh)
            near, new = _joined(files.read(f"lists-{state}", block), [back, fresh])
            return pd.DataFrame({"meeting": [int((near[new.any(axis=1)] != EMPTY).sum())]})

        edges = self._each().mapInPandas(turned, "block int, own binary, ids binary, scores binary, new binary")
        done = self._grouped(self._with_all(edges)).applyInPandas(gather, "meeting long")
        self.meeting = done.agg(F.sum("meeting")).first()[0]

    def _link(self) -> None:
        """Writes all neighbours of each node, in either direction; lists and scores are not needed any more."""
        files, state = self.files, self.state

        def write(batches):
            for block in _numbers(batches):
                ids, _ = _joined(files.read(f"lists-{state}", block), files.read("back", block))
                lengths = (ids != EMPTY).sum(axis=1)
                files.write("links", block, np.r_[0, np.cumsum(lengths)], ids[ids != EMPTY])
                yield pd.DataFrame({"edges": [int(lengths.sum())]})

        self.edges = self._each().mapInPandas(write, "edges long").agg(F.sum("edges")).first()[0]
        self._drop(f"lists-{state}", f"low-{state}", "back")

    def _turns(self) -> int:
        """Passes of a round, so that the vectors asked for in one stay under ``most_bytes``, and all found under twice that."""
        item, per_block = self.kind().itemsize, self.meeting / self.blocks
        turns = max(1, int(-(-self.meeting * self.s.sent * (2 * item + 4) // (2 * self.most_bytes))))
        while turns < self.size:
            wanted = self.count * -np.expm1(-per_block / turns / self.count)  # different nodes that a block asks for
            if self.blocks * wanted * (2 * self.width + 2 * item + 4) <= self.most_bytes:
                break
            turns += 1
        return turns

    def _descend(self) -> int:
        """One round: neighbours of neighbours meet, and what is nearer is taken over.

        Each pass takes an equal part of every block. What is found is kept until it is worth a merge.
        """
        turns, kept, kept_bytes = self._turns(), [], 0
        for turn in range(turns):
            found = self._meet(turn, turns)
            if turns > 1:
                kept.append(Stored(found, "found"))
                kept_bytes += kept[-1].rows.agg(F.sum(F.length("own") + F.length("ids") + F.length("scores"))).first()[0] or 0
                found = _together(kept)
            if turn == turns - 1 or kept_bytes > self.most_bytes // 4:
                changed = self._merge(found, turn == turns - 1)
                for table in kept:
                    table.drop()
                kept, kept_bytes = [], 0
        self._drop("back")
        return changed

    def _meet(self, turn: int, turns: int) -> DataFrame:
        """For a part of the nodes of every block: those of their neighbours that are nearer to each other than what they have."""
        s, width, size, kind, files, state = self.s, self.width, self.size, self.kind, self.files, self.state
        scaled = self._reader()

        def joining(block: int) -> tuple[np.ndarray, np.ndarray]:
            """Neighbours of the nodes where something is new, nodes with few neighbours first."""
            lists, back = files.read(f"lists-{state}", block), files.read("back", block)
            part = slice(len(lists[0]) * turn // turns, len(lists[0]) * (turn + 1) // turns)
            ids, new = _joined([x[part] for x in lists], [x[part] for x in back])
            lengths = (ids != EMPTY).sum(axis=1)
            some = np.flatnonzero(new.any(axis=1) & (lengths > 1))
            some = some[np.argsort(lengths[some], kind="stable")]
            return ids[some], new[some]

        def ask(batches):
            for block in _numbers(batches):
                ids, _ = joining(block)
                ids = np.unique(ids)
                ids = ids[ids != EMPTY]
                rows = _by_block(ids // size, ids)
                yield pd.DataFrame([(to, block, own) for to, own in rows], columns=["block", "home", "ids"])

        def answer(group: pd.DataFrame) -> pd.DataFrame:
            block = int(group["block"].iloc[0])
            vectors, (low,) = scaled(block).astype(np.float16), files.read(f"low-{state}", block)
            at = [np.frombuffer(ids, kind) - block * size for ids in group["ids"]]
            return pd.DataFrame(
                {"home": group["home"], "ids": group["ids"], "vec": [vectors[x].tobytes() for x in at], "low": [low[x].tobytes() for x in at]}
            )

        def meet(group: pd.DataFrame) -> pd.DataFrame:
            asked, _ = _unpacked(group["ids"], kind)
            order = np.argsort(asked)
            asked, low = asked[order], _unpacked(group["low"], np.float32)[0][order]
            vectors = np.frombuffer(b"".join(group["vec"]), np.float16).reshape(-1, width)[order].astype(np.float32)
            links, fresh = joining(int(group["home"].iloc[0]))
            owners, others, values = [], [], []
            for a in range(0, len(links), TOGETHER):
                ids = links[a : a + TOGETHER]
                there = ids != EMPTY
                wide = int(there.sum(axis=1).max())
                ids, there, new = ids[:, :wide], there[:, :wide], fresh[a : a + TOGETHER, :wide]
                at = np.searchsorted(asked, ids)
                at[~there] = 0
                near = vectors[at]
                near = near @ near.transpose(0, 2, 1)
                near[:, np.arange(wide), np.arange(wide)] = -np.inf
                near[~(new[:, :, None] | new[:, None, :])] = -np.inf
                near.transpose(0, 2, 1)[~there] = -np.inf
                better = near > np.where(there, low[at], np.inf)[:, :, None]
                counts = better.sum(axis=2)
                over = counts > s.sent
                if over.any():  # the best that one node gets from one common neighbour
                    many = np.where(better[over], near[over], -np.inf)
                    keep = np.argpartition(many, wide - s.sent, axis=1)[:, -s.sent :]
                    mask = np.zeros_like(many, bool)
                    np.put_along_axis(mask, keep, True, axis=1)
                    better[over] = mask
                node, one, two = np.nonzero(better)
                owners.append(at[node, one])
                others.append(at[node, two])
                values.append(near[node, one, two])
            if not owners:
                return _found([], [], [], size, kind)
            owner, other, value, _, _ = _best(
                np.concatenate(owners), np.concatenate(others), np.concatenate(values), None, s.neighbours
            )
            return _found([asked[owner]], [asked[other]], [value], size, kind)

        asked = self._each().mapInPandas(ask, "block int, home int, ids binary")
        given = self._grouped(asked).applyInPandas(answer, "home int, ids binary, vec binary, low binary")
        return self._grouped(given, "home").applyInPandas(meet, FOUND)

    def search(self, queries: DataFrame, most: int) -> DataFrame:
        """``node``, ``vec_id``, ``away``: ids and negative products of the ``most`` nearest nodes found for each query.

        ``queries`` are numbers of nodes, each once; the search enters the graph at the query's own node, which is found
        as well. Queries are taken in so many batches that what a step of one moves stays under ``most_bytes``.
        """
        total, s = queries.count(), self.s
        # All of a beam expanded at once, the query in all blocks, and two states of the beams.
        each = s.beam * -(-self.edges // self.count) * 2 * self.kind().itemsize + self.blocks * 4 * self.width
        each += 2 * max(s.kept, most) * (self.kind().itemsize + 13) + self.width * self.item.itemsize
        batches = max(1, int(-(-total * each // self.most_bytes)))
        parts = (queries.filter(F.pmod("node", F.lit(batches)) == i) for i in range(batches))
        return _together([self._batch(f"beams-{i}", part, most, -(-total // batches)) for i, part in enumerate(parts)])

    def _batch(self, name: str, queries: DataFrame, most: int, total: int) -> Stored:
        """The search of one batch, a file for each part of its queries, and in the end the products in double precision."""
        s, width, size, kind, item, files = self.s, self.width, self.size, self.kind, self.item, self.files
        kept, root, scaled = max(s.kept, most), np.sqrt(self.longest), self._reader()
        parts = max(1, -(-total // QUERIES))

        def enter(group: pd.DataFrame) -> pd.DataFrame:
            block, rows = int(group["block"].iloc[0]), []
            vectors = files.read("vectors", block)[0]
            query = group["node"].to_numpy(np.int64)
            for part, at in pd.Series(np.arange(len(query))).groupby(block_of(query, parts)):
                own = query[at.to_numpy()]
                rows.append((part, own.tobytes(), vectors[own - block * size].tobytes()))
            return pd.DataFrame(rows, columns=["part", "query", "vec"])

        def begin(group: pd.DataFrame) -> pd.DataFrame:
            part = int(group["part"].iloc[0])
            query, vectors = _unpacked(group["query"], np.int64)[0], np.frombuffer(b"".join(group["vec"]), item)
            n = len(query)
            files.write(
                f"{name}-0", part, query, vectors.reshape(n, width - 1), np.arange(n, dtype=np.int32), query.astype(kind),
                np.full(n, np.inf, np.float32), np.zeros(n, bool), np.zeros(n, np.int32),
            )
            return pd.DataFrame({"part": [part], "open": [n]})

        block = F.expr(f"cast(node div {size} as int)")
        entered = self._grouped(queries.withColumn("block", block)).applyInPandas(enter, "part int, query binary, vec binary")
        # A file has the queries, their vectors, and of all beams the query, node, score, whether expanded, and place.
        active = self._grouped(entered, "part", parts).applyInPandas(begin, "part int, open long").collect()
        active, turn = {r.part for r in active}, 0
        ended = active

        def ask(batches):
            """The best nodes of each beam that are not expanded yet, sent to their blocks."""
            for batch in batches:
                for part in active & {*batch["part"].tolist()}:
                    _, _, owner, ids, _, done, place = files.read(f"{name}-{turn}", part)
                    wanted = (place < s.beam) & ~done
                    out = _by_block(ids[wanted] // size, owner[wanted].astype(np.int32), ids[wanted])
                    yield pd.DataFrame([(b, part, w, i) for b, w, i in out], columns=["block", "part", "which", "ids"])

        def expand(group: pd.DataFrame) -> pd.DataFrame:
            """The neighbours, in either direction, of the nodes asked for."""
            block, rows = int(group["block"].iloc[0]), []
            cuts, links = files.read("links", block)
            for row in group.itertuples():
                at = np.frombuffer(row.ids, kind) - block * size
                lengths = cuts[at + 1] - cuts[at]
                owner = np.repeat(np.frombuffer(row.which, np.int32), lengths)
                near = links[np.repeat(cuts[at] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]
                rows.append((row.part, owner.tobytes(), near.tobytes()))
            return pd.DataFrame(rows, columns=["part", "which", "ids"])

        def route(near: pd.DataFrame) -> pd.DataFrame:
            """Nodes that are new to a beam, sent to their blocks with the vector of the query and what they have to reach."""
            part = int(near["part"].iloc[0])
            _, vectors, owner, ids, scores, _, place = files.read(f"{name}-{turn}", part)
            both = np.unique(_unpacked(near["which"], np.int32)[0].astype(np.int64) << 40 | _unpacked(near["ids"], kind)[0])
            known = owner.astype(np.int64) << 40 | ids
            at = np.searchsorted(both, known)
            at = at[at < len(both)][both[at[at < len(both)]] == known[at < len(both)]]
            both = np.delete(both, at)
            who, ids = both >> 40, (both & ((1 << 40) - 1)).astype(kind)
            vectors = (vectors / root).astype(np.float32)
            low = np.full(len(vectors), -np.inf, np.float32)
            low[owner[place == kept - 1]] = scores[place == kept - 1]
            rows, to = [(0, part, b"", b"", b"", b"", b"")], ids // size  # so that the part is told also if nothing is new
            for block, own, nodes in _by_block(to, who, ids):  # each block's nodes by query
                which, counts = np.unique(np.frombuffer(own, np.int64), return_counts=True)
                packed = which.astype(np.int32), vectors[which], low[which], counts
                rows.append((block, part, *[x.tobytes() for x in packed], nodes))
            return pd.DataFrame(rows, columns=["block", "part", "which", "vec", "low", "counts", "ids"])

        def score(group: pd.DataFrame) -> pd.DataFrame:
            block, rows = int(group["block"].iloc[0]), []
            stored = scaled(block)[:, :-1]
            for row in group.itertuples():
                which, counts = np.frombuffer(row.which, np.int32), np.frombuffer(row.counts, np.int64)
                vectors, ids = np.frombuffer(row.vec, np.float32).reshape(-1, width - 1), np.frombuffer(row.ids, kind)
                at = np.repeat(np.arange(len(which)), counts)
                value = np.einsum("ij,ij->i", stored[ids - block * size], vectors[at])
                better = value > np.frombuffer(row.low, np.float32)[at]
                rows.append((row.part, which[at][better].tobytes(), ids[better].tobytes(), value[better].tobytes()))
            return pd.DataFrame(rows, columns=["part", "which", "ids", "scores"])

        def take(new: pd.DataFrame) -> pd.DataFrame:
            """The beams of a part of the queries, with the nodes that were scored for them."""
            part = int(new["part"].iloc[0])
            query, vectors, owner, ids, scores, done, place = files.read(f"{name}-{turn}", part)
            done |= place < s.beam  # all of these were asked for
            more, _ = _unpacked(new["ids"], kind)
            owner, ids, scores, done, place = _best(
                np.r_[owner, _unpacked(new["which"], np.int32)[0]], np.r_[ids, more],
                np.r_[scores, _unpacked(new["scores"], np.float32)[0]], np.r_[done, np.zeros(len(more), bool)], kept,
            )
            still = int((~done & (place < s.beam)).sum())
            place = place.astype(np.int32)
            files.write(f"{name}-{turn + 1}" if still else f"{name}-ended", part, query, vectors, owner, ids, scores, done, place)
            return pd.DataFrame({"part": [part], "open": [still]})

        while active:  # every round expands nodes for good, so it ends
            asked = self._each("part", parts).mapInPandas(ask, "block int, part int, which binary, ids binary")
            near = self._grouped(asked).applyInPandas(expand, "part int, which binary, ids binary")
            routed = self._grouped(near, "part", parts).applyInPandas(
                route, "block int, part int, which binary, vec binary, low binary, counts binary, ids binary"
            )
            scored = self._grouped(routed).applyInPandas(score, "part int, which binary, ids binary, scores binary")
            told = self._grouped(scored, "part", parts).applyInPandas(take, "part int, open long").collect()
            assert {r.part for r in told} == active
            self._drop(f"{name}-{turn}")
            active, turn = {r.part for r in told if r.open}, turn + 1

        def best(batches):
            """The nearest nodes of each query, sent to their blocks with the query as it was given."""
            for batch in batches:
                for part in ended & {*batch["part"].tolist()}:
                    query, vectors, owner, ids, _, _, place = files.read(f"{name}-ended", part)
                    owner, ids = owner[place < most], ids[place < most]
                    out = _by_block(ids // size, ids, query[owner], vectors[owner])
                    yield pd.DataFrame(out, columns=["block", "ids", "query", "vec"])

        def products(group: pd.DataFrame) -> pd.DataFrame:
            block, out = int(group["block"].iloc[0]), []
            stored, (cuts, members) = files.read("vectors", block)[0], files.read("members", block)
            for row in group.itertuples():
                at, query = np.frombuffer(row.ids, kind) - block * size, np.frombuffer(row.query, np.int64)
                one, two = stored[at].astype(np.float64), np.frombuffer(row.vec, item).reshape(-1, width - 1).astype(np.float64)
                total = np.zeros(len(at))
                for i in range(width - 1):  # in the order of the components
                    total += one[:, i] * two[:, i]
                lengths = cuts[at + 1] - cuts[at]
                ids = members[np.repeat(cuts[at] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]
                out.append(pd.DataFrame({"node": np.repeat(query, lengths), "vec_id": ids, "away": np.repeat(-total, lengths)}))
            return pd.concat(out)

        found = self._grouped(self._each("part", parts).mapInPandas(best, "block int, ids binary, query binary, vec binary"))
        pairs = Stored(found.applyInPandas(products, "node long, vec_id long, away double"), "pairs")
        self._drop(f"{name}-ended")
        return pairs


def _usable(vectors: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, int]:
    """Rows with a vector of the usual length, without null or non-finite parts, and not all zero."""
    vec = F.col(f"`{vector_column}`")
    given = vectors.select(vec).schema[0].dataType
    if not isinstance(getattr(given, "elementType", None), FloatType):  # single precision stays as short as it is
        vec = vec.cast("array<double>")
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), vec.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size("v") == (sizes.n if sizes else 0)), sizes.n if sizes else 0


def nearest(
    vectors: DataFrame, queries, most: int = 20, id_column: str = "vec_id", vector_column: str = "embedding",
    settings: Settings = Settings(),
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the nearest rows found for each query row.

    ``queries`` is a condition on the id column that picks the query rows; candidates are all rows but the query's
    own id. Nearest is the largest inner product in double precision, ties go to the smaller id. Vectors that are null,
    zero, or hold null or non-finite parts take no part, nor do those of another length than most have, nor rows
    without id. Rows that repeat an id and vector count once; of one id with several vectors each asks and is found,
    and the nearest pair of vectors gives the score of two ids. An empty table gives an empty result. How many of the true nearest are found depends on the data; tests measure it.
    """
    spark = vectors.sparkSession
    ship(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    rows, dimensions = _usable(vectors, id_column, vector_column)
    if not dimensions:
        return spark.createDataFrame([], schema)
    asks = F.coalesce(queries(F.col("vec_id")), F.lit(False))
    first = Window.partitionBy("v").orderBy("vec_id")
    # Of equal vectors the smallest ids are all that any result can hold: one more than asked for, for the query itself.
    members = rows.distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= most + 1)
    distinct = members.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    with brief_shuffles(spark):
        # Nodes have numbers of their own, fixed by writing them: an id may have several vectors.
        nodes = Stored(distinct.withColumn("id", F.monotonically_increasing_id()), "nodes")
        part, within = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
        counts = nodes.rows.groupBy(part.alias("part")).count().orderBy("part").collect()
        starts = np.cumsum([0] + [r["count"] for r in counts]).tolist()
        offsets = spark.createDataFrame([(r.part, start) for r, start in zip(counts, starts)], "part long, start long")
        numbered = nodes.rows.withColumn("part", part).join(F.broadcast(offsets), "part")
        numbered = numbered.select((F.col("start") + within).alias("number"), "v", "ids")
        asking = rows.filter(asks).distinct().join(numbered, "v")
        asking = Stored(asking.select(F.col("vec_id").alias("query_id"), F.col("number").alias("node")), "queries")
        if asking.rows.isEmpty():
            return spark.createDataFrame([], schema)
        graph = Graph(numbered, starts[-1], dimensions, settings)
        nodes.drop()
        wanted = Stored(asking.rows.select("node").distinct(), "asking")
        found = graph.build().search(wanted.rows, 2 * most)
        wanted.drop()
        release(spark, graph.folder)
    pairs = (
        asking.rows.join(found, "node")
        .filter("vec_id <> query_id")
        .groupBy("query_id", "vec_id")
        .agg(F.min("away").alias("away"))
    )
    nearest_first = Window.partitionBy("query_id").orderBy("away", "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(nearest_first)).filter(F.col("rank") <= most)
    return ranked.select("query_id", "rank", "vec_id", (-F.col("away")).alias("score"))
