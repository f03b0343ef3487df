"""URL filter: listed rules, and a logistic regression on hashed character n-grams of host and path.

The regression is trained on a small labelled table of URLs. Its weights are one array of fixed size, which goes to
all tasks with the function that applies it.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqengine.llm.common import ship

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A small labelled table: unwanted and ordinary places.
UNWANTED = """
casino-royal.example.com/bonus  win-casino.example.net/play  online-casino.example.org/slots/1
bestbets.example.com/odds  free-bet.example.net/en/1  sports-bets.example.org/live  poker-win.example.com/table/7
cheap-meds.example.com/pills  pills-online.example.net/buy  cheap-viagra.example.org/order  buy-pills.example.com/en/22
adult-cams.example.net/live  xxx-adult.example.com/video/9  adult-dating.example.org/join  sex-chat.example.com/en/5
spam-links.example.com/farm/1  linkfarm.example.net/out  seo-spam.example.org/backlinks  spamfarm.example.com/de/41
ads-server.example.com/click  adtrack.example.net/pixel  track-ads.example.org/click?id=1  ad-tracking.example.com/en/3
payday-loans.example.com/apply  fast-loan.example.net/now  free-prize.example.org/claim  win-prizes.example.com/fr/12
lottery-win.example.net/ticket  crypto-double.example.com/send  replica-watches.example.org/sale  torrent-crack.example.net/keygen
www.spam-network.example.org/en/5101  www.spam-mail.example.com/de/77  www.link-farm.example.org/es/330  spam-host.example.net/en/9
blog.casino-hall.example.net/en/4.html  m.casino-club.example.org/de/60  blog.cheap-loans.example.com/en/15  m.adult-club.example.com/es/2
casino-slots.example.com/fr/88.html  free-spins.example.net/en/904  betting-tips.example.org/de/17  cheap-drugs.example.com/es/6
"""
ORDINARY = """
www.example.com/  www.example.org/about  blog.example.net/2021/03/spring  news.example.com/world/4711.html
m.example.com/en/1234  docs.example.org/guide/install  library.example.net/catalogue/88  www.example.net/fr/991
university.example.org/research/paper.html  weather.example.com/city/berlin  museum.example.net/es/12  recipes.example.com/soup
blog.garden.example.org/en/77  www.history.example.com/de/5021.html  m.travel.example.net/fr/310  science.example.org/en/45
therapist.example.com/contact  theatre.example.net/programme  nation.example.org/en/2301  station.example.com/de/7
another.example.net/en/18  threshold.example.org/fr/62  heading.example.com/es/901  winter.example.net/en/14
www.entering.example.com/en/3042  m.otherthings.example.org/de/870.html  blog.thatone.example.net/en/2219  rents.example.com/fr/7
music.example.com/album/3  school.example.org/timetable  health.example.net/advice/sleep  bakery.example.com/en/19
www.farmers.example.org/en/14  blog.winery.example.net/en/31.html  m.trackandfield.example.com/en/5  www.adsorption.example.org/paper/3
council.example.org/minutes/2020  river.example.net/en/6021/  forum.example.com/thread/55  code.example.org/project/readme
photos.example.net/en/8  journal.example.com/es/4410  market.example.org/en/330  cinema.example.net/fr/27
www.seat.example.org/en/40  adventure.example.com/en/21  better.example.net/de/63  spatial.example.org/maps
"""


def seed_urls() -> list[tuple[str, int]]:
    """The labelled table: URL, and 1 if it is unwanted."""
    return [(f"https://{u}", label) for text, label in ((UNWANTED, 1), (ORDINARY, 0)) for u in text.split()]


@dataclass(frozen=True)
class Model:
    """Weights by hash, and the constant."""

    weights: np.ndarray
    constant: float
    shortest: int
    longest: int

    def score(self, host: str, path: str) -> float:
        """Probability that the place is unwanted."""
        found = features(host, path, len(self.weights), self.shortest, self.longest)
        value = self.constant + (float(self.weights[found].sum()) / np.sqrt(len(found)) if len(found) else 0.0)
        return float(1 / (1 + np.exp(-value)))


def features(host: str, path: str, size: int, shortest: int, longest: int) -> np.ndarray:
    """Hashes of the different character n-grams of host and path, each kind told apart by its first character."""
    found = set()
    for kind, text in (("h", f"^{host}$"), ("p", f"{path}$")) if host or path else ():
        for n in range(shortest, longest + 1):
            found.update(kind + text[i : i + n] for i in range(len(text) - n + 1))
    return np.array(sorted(zlib.crc32(g.encode("utf-8", "replace")) % size for g in found), np.int64)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path in plain Python, for training; ``host_column`` and ``path_column`` say the same for columns."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    stop = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    tail = rest[stop:]
    end = min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))
    return rest[:stop].translate(str.maketrans(UPPER, LOWER)), tail[:end]


def train(
    labelled: list[tuple[str | None, int]], size: int = 1 << 17, shortest: int = 3, longest: int = 5,
    rounds: int = 600, rate: float = 3.0, shrink: float = 2e-5,
) -> Model:
    """Logistic regression by gradient descent on the whole (small) table."""
    rows = [(features(*split_url(url), size, shortest, longest), label) for url, label in labelled]
    weights, constant = np.zeros(size), 0.0
    places = np.concatenate([f for f, _ in rows]) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    norm = np.array([1 / np.sqrt(max(1, len(f))) for f, _ in rows])
    target = np.array([float(label) for _, label in rows])
    for _ in range(rounds if rows else 0):
        value = constant + np.bincount(owner, weights[places], len(rows)) * norm
        error = 1 / (1 + np.exp(-value)) - target
        step = np.bincount(places, (error * norm)[owner], size) / len(rows)
        weights -= rate * (step + shrink * weights)
        constant -= rate * float(error.mean())
    return Model(weights, constant, shortest, longest)


def train_on(labelled: DataFrame, url_column: str, label_column: str, max_rows: int = 20_000, **how) -> Model:
    """``train`` on a labelled table. Of more than ``max_rows`` rows those with the smallest hashes are taken."""
    url, label = F.col(f"`{url_column}`"), F.col(f"`{label_column}`")
    rows = labelled.filter(url.isNotNull() & label.isNotNull()).select(url.alias("u"), label.cast("int").alias("l"))
    taken = rows.orderBy(F.xxhash64("u", "l"), "u", "l").limit(max_rows).collect()
    return train([(r.u, r.l) for r in taken], **how)


def host_column(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_column(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits: its host or a subdomain, and a path that starts like the rule's. Null if none.

    A rule is ``host/start of path``. Rules are a short list that becomes part of the query.
    """
    found = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        found = F.when(fits, F.lit(rule)) if found is None else found.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if found is None else found


def url_filter(
    pages: DataFrame, model: Model, rules: dict[str, str], id_column: str = "page_id", url_column: str = "url",
    limit: float = 0.5,
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` of every row.

    ``verdict`` is that of the longest fitting rule, else ``block`` if the model's ``score`` is ``limit`` or more. A
    null URL, or one without ``://``, has empty host and path, fits no rule, and gets the model's constant. Null ids
    and repeated rows are kept; other columns are not read.
    """
    ship(pages.sparkSession)
    url = F.col(f"`{url_column}`")
    rows = pages.select(
        F.col(f"`{id_column}`").alias("page_id"), host_column(url).alias("host"), path_column(url).alias("path")
    )
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])

    def judge(batches):
        for batch in batches:
            places = zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            yield batch.append_column("score", pa.array([model.score(h, p) for h, p in places], pa.float64()))

    scored = rows.mapInArrow(judge, schema).withColumn("rule", rule_column(F.col("host"), F.col("path"), rules))
    by_rule = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])[F.col("rule")] if rules else F.lit(None)
    by_model = F.when(F.col("score") >= limit, BLOCK).otherwise(ALLOW)
    return scored.select("page_id", "host", "path", "rule", F.coalesce(by_rule, by_model).alias("verdict"), "score")
