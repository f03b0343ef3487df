"""URL filter, HTML text, WARC archives and nearest neighbours."""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import io
import random
import re
import threading
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from dqengine.llm import html_text, neighbours, url_filter, warc
from dqengine.llm.queries import URL_RULES
from dqengine.session import scratch_path, shared_dir

PAGES = "page_id long, url string, html string"
URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.ORG/es/1?x#y", "https://example.org/en/17",
    "https://example.org/en/2", "https://notexample.org/en/1", "https://a.example.org/es/x", "http://x.com/fr/1",
    "http://x.com/de/1", "http://x.com/DE/1", "http://com/fr/", "http://x.com?fr/", "http://x.com#/fr/", "http://a.org",
    "a://b://c/d", "http://É.org/é", "http://x.net/\nline", "http://u:p@x.com:80/de/7", "http://x.org./",
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, url, f"<p>{url}") for i, url in enumerate(URLS)]
    rows += [(None, None, None), (3, "http://x.com/de/1", None), (3, "http://x.com/de/1", None), (50, "http://r/\r\nx: y", "")]
    table = spark.createDataFrame(rows, PAGES)
    for name in ("host", "path", "rule", "score", "text", "same", "revisit", "verdict"):
        table = table.withColumn(name, F.lit("clash"))
    return table


def own_rule(host: str, path: str) -> str | None:
    fits = []
    for rule in URL_RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fits.append(rule)
    return max(fits, key=len, default=None)


def test_urls_rules_and_verdicts(spark, pages):
    model = url_filter.train(url_filter.seed_urls())
    got = url_filter.url_filter(pages, model, URL_RULES).collect()
    want = []
    for r in pages.collect():
        host, path = url_filter.split_url(r.url)
        rule, score = own_rule(host, path), model.score(host, path)
        want.append((r.page_id, host, path, rule, URL_RULES[rule] if rule else "block" if score >= 0.5 else "allow"))
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == Counter(want)
    assert url_filter.url_filter(pages.limit(0), model, URL_RULES).collect() == []
    assert url_filter.url_filter(pages, model, {}).filter("rule is not null").count() == 0


def test_model_on_urls_it_has_not_seen():
    model = url_filter.train(url_filter.seed_urls())
    unwanted = [
        "http://m.casino-palace.example.com/en/4033.html", "https://free-bets-now.example.net/en/5462#top",
        "https://www.cheap-pills-store.example.org/de/6652.html", "http://spam-garden.example.com/fr/1",
        "http://adult-movies.example.com/es/17", "http://www.ads-trackers.example.net/en/9?utm_source=feed",
    ]
    ordinary = [
        "http://ththre.example.org/en/7817", "https://blog.therhe.example.net/en/8423/", "https://kitchen.example.com/bread",
        "http://www.thering.example.com/en/1837", "https://m.library.example.org/en/12?page=2&ref=x",
        "http://mountain.example.net/fr/310.html", "https://www.history.example.com/1848",
    ]
    score = lambda u: model.score(*url_filter.split_url(u))
    right = sum(score(u) >= 0.5 for u in unwanted) + sum(score(u) < 0.5 for u in ordinary)
    assert right >= len(unwanted + ordinary) - 1


def test_training_on_a_table(spark):
    table = spark.createDataFrame(url_filter.seed_urls() + [(None, 1)], "url string, bad int")
    a = url_filter.train_on(table, "url", "bad")
    assert a.score("win-casino.example.com", "/play") > 0.5 > a.score("museum.example.org", "/about")
    assert url_filter.train_on(table.limit(0), "url", "bad").score("a.b", "/") == 0.5


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("a < b & c &lt; d", "a < b & c < d"),
        ("<p>a<p>b", "a\n\nb"),
        ("<p>a <b>b</b>c\n  d</p>e<br>f", "a bc d\n\ne\nf"),
        ("<ul><li>x<li>y<ul><li>z</ul><li>w</ul>after", "- x\n- y\n  - z\n- w\n\nafter"),
        ("<ol start=9><li>a<li><p>b</ol>", "9. a\n\n10. b"),
        ("<dl><dt>T<dd>D<dt>U<dd>E</dl>", "T\n  D\nU\n  E"),
        ("<table><tr><th>Name<th>N<tr><td>Alice<td>1<tr><td>Bo<td>22</table>x", "Name   N\nAlice  1\nBo     22\n\nx"),
        ("<table><td>one<td>two</table>", "one  two"),
        ("<table><tr><td colspan=2>wide cell<tr><td>a<td>b</table>", "wide cell\na  b"),
        ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
        ("<table><tr><td>o<td><table><tr><td>i<td>j</table><tr><td>p</table>", "o  i  j\np"),
        ("<pre>a\n  <b>b</b>\tc</pre>x", "a\n  b     c\n\nx"),
        ("<head><title>t</title></head><script>var a='</p>';</script>seen<style>p{}</style>", "seen"),
        ("<style>.x, #q{display:none}</style><div class='y x'>no</div><i id=q>no</i>yes", "yes"),
        ("<p hidden>no</p><p style='display: none'>no</p><p style='visibility:hidden'>no<b style='visibility:visible'>yes</b>", "yes"),
        ("<!-- no --><noscript>no</noscript><template>no</template><textarea>yes</textarea>", "yes"),
        ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
        ("<blockquote>q<p>r</blockquote>z", "  q\n\n  r\n\nz"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("</td></tr>ok</div>", "ok"),
        ("<div>" * 20_000 + "deep" + "</div>" * 20_000, "deep"),
    ],
)
def test_layout(html, text):
    assert html_text.render(html) == text


@pytest.mark.parametrize(
    "html, text",
    [
        ("<style>@media print{.nav{display:none}}</style><p class=nav>yes", "yes"),
        ("<style>@media (max-width:9px){.a{display:none}} @media screen{.b{display:none}}</style><i class=a>yes</i><i class=b>no</i>", "yes"),
        ("<style>@import 'x'; .a{display:none}/* .c{display:none} */@media print, all{ .b {display:none} }</style><i class=a>no</i><i class=b>no</i><i class=c>yes</i>", "yes"),
        ("<style>@media screen{@supports (x:y){.a{display:none}}}.b{display:none;i{color:red}}</style><i class=a>yes</i><i class=b>no</i>", "yes"),
        ("<style media=print>.a{display:none}</style><i class=a>yes</i>", "yes"),
        ("<p>a<svg><title>no</title><desc/><path d=x /><text>one</text><text>two</text><style>.q{}</style></svg>b", "a one two b"),
        ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "x=1"),
        ("<table>stray<tr><td>cell</table>", "stray\n\ncell"),
        ("<table><tr>one<td>a</td>two<td>b</tr>three<tbody>four</table>x", "onetwothreefour\n\na  b\n\nx"),
        ("<table><b>loose<tr><td>a<tr><td>b</table>", "loose\n\na\nb"),
        ("<table><tr><td>o<table>in<tr><td>i</table></table>", "oin\n\ni"),
        ("<tr>a<td>b</td></tr><tbody>c</tbody><thead>d", "a bcd"),
    ],
)
def test_layout_keeps_what_is_shown(html, text):
    assert html_text.render(html) == text


def test_html_never_fails():
    rnd = random.Random(1)
    parts = ["<p>", "</p>", "<table>", "</table>", "<tr>", "<td>", "</td>", "<li>", "<ul>", "</ul>", "x", "&amp", "<", "<pre>",
             "</pre>", "<br>", "<!--", "-->", "<a href='", "\n", "<td colspan=9>", "<th>", "<tbody>", "<script>", "</script>"]
    for _ in range(1500):
        html_text.render("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))))


def test_html_table(spark, pages):
    got = html_text.html_text(pages).collect()
    assert Counter((r.page_id, r.text) for r in got) == Counter((r.page_id, html_text.render(r.html or "")) for r in pages.collect())
    assert html_text.html_text(pages.limit(0)).collect() == []


def test_captures(spark, pages):
    rnd = random.Random(2)
    more = [(100 + i, f"http://h/{i}", rnd.choice(["", "same", "x" * 300_000, f"<p>{i}", None])) for i in range(40)]
    table = pages.unionByName(spark.createDataFrame(more, PAGES), allowMissingColumns=True)
    rows = [(r.page_id, r.html or "") for r in table.collect()]
    first = {}
    for page, html in rows:
        if page is not None:
            first[html] = min(first.get(html, page), page)
    want = Counter()
    for page, html in rows:
        data, later = html.encode(), page != first.get(html)
        name = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want[page, len(data), name, "revisit" if later else "response", first[html] if later else None] += 1
    files = warc.write(table, scratch_path(spark, "warc"))
    for keep in (True, False):
        assert Counter(map(tuple, warc.captures(warc.read(files, keep)).collect())) == want
    nested = warc.transactions(warc.read(files)).collect()
    assert len(nested) == len(rows)
    for r in nested:
        assert len(r.requests) == len(r.metadata) == 1 and r.http_status == "HTTP/1.1 200 OK"
        assert r.type == "revisit" or hashlib.sha1(r.payload).digest() == base64.b32decode(r.payload_digest)
    few = warc.captures(warc.read(warc.write(table, scratch_path(spark, "warc"), least_bytes=5), False))
    assert few.filter("record_type = 'revisit' and payload_bytes < 5").count() == 0
    assert warc.captures(warc.read(warc.write(pages.limit(0), scratch_path(spark, "warc")))).collect() == []


def test_foreign_and_broken_records():
    assert warc.parse(b"no record", True) is None
    odd = warc.parse(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", True)
    assert odd["type"] == "warcinfo" and "payload" not in odd
    assert warc.parse(b"WARC/1.0\r\nWARC-Type: revisit\r\n\r\n", True)["payload_digest"] is None


def _foreign(kind, name, *concurrent, block=b"", length=True):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *[f"WARC-Concurrent-To: <{c}>" for c in concurrent]]
    lines += [f"Content-Length: {len(block)}"] if length else []
    return "\r\n".join(["WARC/1.0", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def test_transactions_of_other_archives(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    records = [
        _foreign("warcinfo", "info", block=b"WARC/1.0 in a block\r\n\r\nWARC/1.0"),
        _foreign("request", "q1"), _foreign("response", "r1", "q1", block=http + b"one"),  # named by the response
        _foreign("response", "r2", block=http + b"two" * 500_000), _foreign("request", "q2", "r2"),
        _foreign("metadata", "m2", "q2", block=b"page-id: 2\r\n"),  # a chain
        _foreign("response", "r3", "q3", "m3", block=http), _foreign("request", "q3"), _foreign("metadata", "m3"),
        _foreign("response", "r4", block=http), _foreign("metadata", "m9", "lost"),
    ]
    forms = {
        "members": b"".join(map(gzip.compress, records)), "one": gzip.compress(b"".join(records)),
        "plain": b"".join(records), "blocks": b"".join(gzip.compress(b"".join(records)[a : a + 999]) for a in range(0, 1_600_000, 999)),
    }
    for form, data in forms.items():
        (tmp_path / form).write_bytes(data)
        files = spark.createDataFrame([(f"file://{tmp_path}/{form}",)], "file string")
        got = {
            r.record_id: ([x.record_id for x in r.requests], [x.record_id for x in r.metadata], r.payload_bytes)
            for r in warc.transactions(warc.read(files)).collect()
        }
        assert got == {
            "<r1>": (["<q1>"], [], 3), "<r2>": (["<q2>"], ["<m2>"], 1_500_000),
            "<r3>": (["<q3>"], ["<m3>"], 0), "<r4>": ([], [], 0),
        }


def test_records_without_length_and_cut_off():
    data = b"junk\r\n" + _foreign("metadata", "a", block=b"x", length=False) + _foreign("metadata", "b", block=b"y" * 99)
    for form in (data[:-40], gzip.compress(data[:-40])):
        got = [warc.parse(r, True)["record_id"] for r in warc.split_records(io.BytesIO(form))]
        assert got == ["<a>", "<b>"]


SMALL = neighbours.Settings(neighbours=20, reverse=20, trees=2, leaf=60, block=100, beam=60, kept=80)


def brute(rows, most):
    """True nearest by query: (score, id) best first."""
    usable = {}
    for i, v in rows:
        if i is not None and v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[i] = np.array(v, float)
    out = {}
    for q in usable:
        if q % 20 == 0:
            scores = sorted((-float(usable[q] @ usable[c]), c) for c in usable if c != q)
            out[q] = scores[:most]
    return out


def test_nearest(spark):
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(6, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + rnd.normal(size=16) * (1 + i % 3)]) for i in range(900)]
    rows[7] = (7, None)
    rows[8] = (8, [0.0] * 16)
    rows[9] = (9, [float("nan")] + [1.0] * 15)
    rows[10] = (10, [None] + [1.0] * 15)
    rows[11] = (11, [1.0] * 3)
    rows[12] = (12, [float("inf")] + [1.0] * 15)
    rows += [(None, rows[20][1]), (13, rows[13][1])]
    rows += [(i, rows[40][1]) for i in range(2000, 2300)]  # one vector of many rows
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    want = brute(rows, 20)
    got = {}
    for r in neighbours.nearest(table, lambda i: i % 20 == 0, settings=SMALL).collect():
        got.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    assert set(got) == set(want)
    hits = total = 0
    for q, truth in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, len(truth) + 1))
        assert [m[1:] for m in mine] == sorted(m[1:] for m in mine)
        limit = truth[-1][0] + 1e-6
        hits += sum(m[1] <= limit for m in mine)
        total += len(truth)
    assert hits >= 0.95 * total
    equal = [m[2] for m in sorted(got[2000])]  # its own copies first, the smallest ids
    assert set(equal[:10]) <= {40, *range(2000, 2300)} or got[2000][0][1] < -float(np.dot(rows[40][1], rows[40][1]))


@pytest.mark.parametrize("n", [2_000, 12_000])
def test_recall_of_production_settings_as_the_table_grows(spark, n):
    rnd = np.random.default_rng(n)
    vectors = rnd.normal(size=(n, 32)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(table, lambda i: i % 200 == 0).groupBy("query_id").agg(F.collect_set("vec_id").alias("ids"))
    hits = 0
    for r in got.collect():
        scores = vectors @ vectors[r.query_id]
        scores[r.query_id] = -np.inf
        hits += len({*np.argsort(-scores)[:20].tolist()} & {*r.ids})
    recall = hits / (20 * (n // 200))
    print(f"recall on {n} rows: {recall:.4f}")
    assert recall >= 0.97


def _bytes_below(folders):
    return sum(p.stat().st_size for folder in folders for p in Path(folder).rglob("*") if p.is_file())


def test_disk_holds_the_graph_and_one_pass(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SMALL", 4 << 20)
    rnd = np.random.default_rng(6)
    vectors = rnd.normal(size=(6000, 32)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [*(str(f) for f in manager.localDirs()), shared_dir(spark).removeprefix("file://")]
    before, most, ended = _bytes_below(folders), 0, threading.Event()

    def watch():
        nonlocal most
        while not ended.wait(0.1):
            with contextlib.suppress(OSError):  # a file may go meanwhile
                most = max(most, _bytes_below(folders) - before)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        found = neighbours.nearest(table, lambda i: i % 20 == 0)
        left = _bytes_below(folders) - before
    finally:
        ended.set()
        watcher.join()
    print(f"at most {most} bytes, {left} left")
    assert left < 4 * vectors.nbytes and most < 30 << 20
    got = found.groupBy("query_id").agg(F.collect_set("vec_id").alias("ids")).collect()
    hits = 0
    for r in got:
        scores = vectors @ vectors[r.query_id]
        scores[r.query_id] = -np.inf
        hits += len({*np.argsort(-scores)[:20].tolist()} & {*r.ids})
    assert len(got) == 300 and hits >= 0.97 * 20 * 300


def test_blocks_are_few_and_of_one_size():
    for nodes in (1, 2048, 2049, 51_282, 256_410, 1_000_000, 15_000_000, 300_000_000):
        size = neighbours.block_size(nodes, 2048)
        blocks = -(-nodes // size)
        assert size <= neighbours.LARGEST and size * (blocks - 1) < nodes <= size * blocks
        assert blocks <= max(neighbours.BLOCKS, -(-nodes // neighbours.LARGEST))


def test_budgets_grow_with_the_table():
    one, large, huge = (neighbours.Settings().grown(n) for n in (2_000, 200_000, 200_000_000))
    assert one == neighbours.Settings()
    for name in ("trees", "rounds", "sent", "beam", "kept"):
        assert getattr(one, name) < getattr(large, name) < getattr(huge, name)


def test_nearest_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert neighbours.nearest(spark.createDataFrame([], schema), lambda i: i % 20 == 0).collect() == []
    one = spark.createDataFrame([(20, [1.0, 0.0])], schema)
    assert neighbours.nearest(one, lambda i: i % 20 == 0).collect() == []
    three = spark.createDataFrame([(20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5])], schema)
    got = neighbours.nearest(three, lambda i: i % 20 == 0).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(20, 1, 1, 1.0), (20, 2, 2, 0.5)]


BAD = ["<a ", "<!--", "<a href='", '<a b="', "</", "<p x='y\">", "<table><tr><td>x", "<b><i>", "<script>", "<td rowspan=9>", "&#", "<![CDATA["]


@pytest.mark.parametrize("piece", BAD)
def test_a_megabyte_of_bad_markup_is_read_once(piece):
    html = "start " + piece * (1_000_000 // len(piece)) + " end"
    began = time.perf_counter()
    assert html_text.render(html).startswith("start")
    assert time.perf_counter() - began < 12


def test_tables_stay_as_small_as_their_text():
    rows = "".join(f"<tr><td>a{i}<td>b{i}" for i in range(2000))
    html = f"<table><tr><td>{'long ' * 2000}<td>x{rows}</table>"
    text = html_text.render(html)
    assert len(text) < 200_000 and all(re.search(rf"^a{i} +b{i}$", text, re.M) for i in range(2000)) and "long " * 1999 in text
    wide = "".join(f"<tr><td colspan=1000>a{i}<td>b{i}" for i in range(2000))
    assert len(html_text.render(f"<table>{wide}</table>")) < 30_000
    deep = "<table><tr><td>" * 1500 + "core" + "</table>" * 1500
    assert html_text.render(deep) == "core"


def test_cells_over_several_rows_keep_the_columns():
    html = "<table><tr><td rowspan=2>A<td>b<td>c<tr><td>d<td>e<tr><td>f<td rowspan=3 colspan=2>g<tr><td>h<tr><td>i<tr><td>j<td>k<td>l</table>"
    assert html_text.render(html).split("\n") == ["A  b  c", "   d  e", "f  g", "h", "i", "j  k  l"]


def test_markup_that_is_none(spark):
    cases = {
        "a < b <c> d": "a < b d",
        "1 <2 and 3> 2": "1 <2 and 3> 2",
        "x <a href=it's>y</a> z": "x y z",
        "x <a href='open>y</a> z": "x y z",
        "x <!-- gone > y": "x",
        "x <!-- gone --> y <!> z": "x y z",
        "<title>T</title>a<textarea><b>&amp;</textarea>c": "a<b>&c",
        "a<script>if (a < b) '</p>'</script>b": "ab",
        "a</ b": "a</ b",
        "&lt;p&gt; &copy &#65;": "<p> © A",
    }
    for html, text in cases.items():
        assert html_text.render(html) == text, html


def _members(n: int) -> list[bytes]:
    return [r for i in range(n) for r in warc.capture_records(i, f"http://a/{i}", b"x" * 3000 + bytes([65 + i]), 0, None, False)]


@pytest.mark.parametrize("between", [b"", b"\0" * 2000, b"\r\n\r\n", b"\n"])
def test_bytes_between_members_are_skipped(between):
    members = _members(4)
    rows = [warc.parse(r, True) for r in warc.split_records(io.BytesIO(between.join(members) + between))]
    assert [r["type"] for r in rows] == ["response", "request", "metadata"] * 4
    assert [r["payload"] for r in rows if r["type"] == "response"] == [b"x" * 3000 + bytes([65 + i]) for i in range(4)]


@pytest.mark.parametrize("at", [2, 12, -6])
@pytest.mark.parametrize("number", [0, 3, 11])
def test_damaged_members_are_told_and_passed_over(at, number):
    members = _members(4)
    good = [warc.parse(r, True) for r in warc.split_records(io.BytesIO(b"".join(members)))]
    broken = bytearray(members[number])
    broken[at] ^= 0xFF
    members[number] = bytes(broken)
    if number == 0 and at == 2:
        members.insert(0, members[1])  # a file is known by its first member
    rows = [warc.parse(r, True) for r in warc.split_records(io.BytesIO(b"".join(members)))]
    ids = {r["record_id"] for r in rows if r["type"] != "damaged"}
    assert {r["record_id"] for i, r in enumerate(good) if i != number} <= ids
    assert sum(r["type"] == "damaged" for r in rows) == (0 if at == 2 else 1)
    assert all(r.get("payload") is None for r in rows if r["type"] == "damaged")


def test_an_id_with_several_vectors(spark):
    rnd = np.random.default_rng(5)
    vectors = rnd.normal(size=(82, 16))
    ids = [*range(80), 20, 33]  # two ids have a second vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, lambda i: i % 20 == 0, most=5).collect()
    for query in (0, 20, 40, 60):
        best = {}
        for i, v in zip(ids, vectors):
            if i == query:
                for j, w in zip(ids, vectors):
                    if j != query:
                        best[j] = max(best.get(j, -np.inf), float(sum(a * b for a, b in zip(v, w))))
        want = sorted(best, key=lambda j: (-best[j], j))[:5]
        mine = sorted((r.rank, r.vec_id) for r in got if r.query_id == query)
        assert [r for r, _ in mine] == [1, 2, 3, 4, 5] and [v for _, v in mine] == want
