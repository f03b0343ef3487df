"""Plain Python versions of the operators, for comparison."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import tiktoken
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def spark_hash(parts: list[str]) -> int:
    """Spark's xxhash64 of an array of strings: each hash is the seed of the next."""
    seed = 42
    for part in parts:
        seed = xxhash.xxh64_intdigest(part.encode(), seed)
    return seed


def base(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(windows), set()
    for i, window in enumerate(windows):
        if seen[window] > 1:
            covered.update(range(i, i + 8))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def normal_lines(text: str | None) -> list[str]:
    out = re.sub("[0-9]+", "0", re.sub(r"[\x20\x09\x0B-\x0D]+", " ", text or "")).lower()
    return [line.strip(" ") for line in out.split("\n")]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def runs(words: list[str], n: int) -> set:
    padded = [""] * (n - 1) + words + [""] * (n - 1)
    return {tuple(padded[i : i + n]) for i in range(len(words) + n - 1)} if words else set()


def near(a: str, b: str) -> bool:
    """Whether two texts differ by scattered words only: two runs of 8 words or more for each five pairs of words."""
    a, b = WORD.findall(a), WORD.findall(b)
    eight, two = (runs(a, 8), runs(b, 8)), (runs(a, 2), runs(b, 2))
    return all(2 * len(eight[i] - eight[1 - i]) >= 5 * len(two[i] - two[1 - i]) for i in (0, 1))


def frequent_lines(rows, documents: int) -> dict:
    """Removable lines by host; rows are (text, host). Texts count in the order of their hashes, copies do not."""
    with_line = defaultdict(set)
    for text, host in rows:
        for line in filter(None, normal_lines(text)):
            with_line[host, line].add(text)
    out = defaultdict(set)
    for (host, line), texts in with_line.items():
        counted = []
        for text in sorted(texts, key=lambda t: signed(xxhash.xxh64_intdigest(t.encode(), 42))):
            if len(counted) <= documents and not any(near(text, c) for c in counted):
                counted.append(text)
        if len(counted) > documents:
            out[host].add(line)
    return out


def verdict(text, host, frequent, min_words=20, percent=30, keep=0.2) -> tuple[bool, bool, int]:
    """base_failed, kept, removed words."""
    n, _, _, _, repeated = base(text)
    failed = n < min_words or 100 * repeated > percent * n
    removed = sum(len(line.split(" ")) for line in normal_lines(text) if line in frequent[host])
    return failed, not failed and n - removed >= keep * n, removed


def cleaned(text, host, frequent) -> str:
    pairs = zip(text.split("\n"), normal_lines(text))
    return "\n".join(line for line, normal in pairs if normal not in frequent[host])


def fingerprint(text: str | None, n: int = 3) -> int:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lower)
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints: list[int], most_bits: int) -> list[int]:
    """For each fingerprint the first place in its component."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= most_bits:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def fill(sizes: dict, most: int = 3) -> dict:
    """Targets by pouring: share by weight, cut what is over, share that again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(sizes, 0.0), float(sum(sizes.values())), set(sizes)
    while left > 1e-9 and open_:
        whole = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / whole
        left = 0.0
        for s in [*open_]:
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.discard(s)
    return target


def random_number(doc_id, seed: int = 42) -> float:
    text = f"{seed}:{'null' if doc_id is None else doc_id}"
    return (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def mix(rows) -> list[int]:
    """Copies of each row (doc_id, text, source): down the ranking, past what does not fit."""
    size = [len(WORD.findall(text or "")) for _, text, _ in rows]
    total, number = Counter(), Counter()
    for (_, _, source), n in zip(rows, size):
        total[source] += n
        number[source] += 1
    target = fill(total)
    copies = [0] * len(rows)
    for source in total:
        ratio = target[source] / total[source] if total[source] else 0.0
        whole = round(ratio) if abs(ratio - round(ratio)) < 1e-12 else int(ratio)
        p0, mine = ratio - whole, [i for i, r in enumerate(rows) if r[2] == source]
        for i in mine:
            copies[i] = whole
        if p0 <= 1e-12:
            continue
        mean = total[source] / number[source]
        x = {i: mean / (mean + size[i]) for i in mine}
        centre = sum(size[i] * x[i] for i in mine) / total[source]
        units = defaultdict(list)
        for i in mine:
            p = p0 + min(p0, 1 - p0) * (x[i] - centre)
            assert 0 < p < 1
            u = random_number(rows[i][0])
            units[(u / (1 - u)) / (p / (1 - p))].append(i)
        left, cut, chosen = p0 * total[source], None, []
        words = {r: sum(size[i] for i in found) for r, found in units.items()}
        for r in sorted(units):
            if words[r] <= left and (cut is None or words[r]):
                chosen.append(r)
                left -= words[r]
            elif cut is None:
                cut = r
        if cut is not None:
            off, best = min((abs(words[r] - left), r) for r in units if r >= cut and r not in chosen)
            if off < left:
                chosen.append(best)
        for r in chosen:
            for i in units[r]:
                copies[i] += 1
    return copies


def byte_encoding() -> tiktoken.Encoding:
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(text: str | None) -> tuple[int, str, str]:
    ids = byte_encoding_cached().encode_ordinary(text or "")
    packed = np.array(ids, "<u4").tobytes()
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


_encoding: list[tiktoken.Encoding] = []


def byte_encoding_cached() -> tiktoken.Encoding:
    if not _encoding:
        _encoding.append(byte_encoding())
    return _encoding[0]
