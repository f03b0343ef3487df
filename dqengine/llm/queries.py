"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from dqengine.llm import (
    bpe,
    html_text,
    line_quality,
    merkle,
    mixing,
    neighbours,
    prefix_counts,
    prefix_trie,
    simhash,
    suffix_dedup,
    token_files,
    url_filter,
    warc,
)
from dqengine.llm.registry import register, table
from dqengine.session import scratch_path

BYTE_JSON = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


URL_RULES = {
    "org/": url_filter.ALLOW,
    "example.org/es/": url_filter.BLOCK,
    "example.org/en/1": url_filter.BLOCK,
    "com/fr/": url_filter.ALLOW,
    "com/de/": url_filter.BLOCK,
}


@register("op1_url_filter")
def op1(spark, sf_dir):
    model = url_filter.train(url_filter.seed_urls())
    return url_filter.url_filter(table(spark, sf_dir, "pages"), model, URL_RULES)


@register("op2_html_text")
def op2(spark, sf_dir):
    return html_text.html_text(table(spark, sf_dir, "pages"))


@register("op3_line_quality")
def op3(spark, sf_dir):
    found = line_quality.line_quality(table(spark, sf_dir, "documents"))
    return found.select(*[c for c in found.columns if c not in ("host", "removed_words")], "removed_words")


#: The mix in SQL: sizes, filled targets, probabilities, ranks, the ranking gone down, and the document that closes the gap.
MIXING_SQL = """
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
    (cast(('0x' || substr(md5('42:' || coalesce(cast(doc_id as varchar), 'null')), 1, 13)) as bigint) + 0.5e0)
      / 4503599627370496e0 as u
  from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size,
    (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight
  from d group by source),
w as (
  select *, row_number() over f as place,
    ((sum(source_size) over ()) - coalesce(sum(3 * source_size) over b, 0))
      / ((sum(weight) over ()) - coalesce(sum(weight) over b, 0)) as level
  from s
  window f as (order by 3 * source_size / weight, source nulls last),
         b as (order by 3 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
t as (
  select source, source_size, coalesce(least(3e0 * source_size, weight * (
    select arg_min(level, place) from w where level * weight < 3 * source_size)), 3e0 * source_size) as target
  from w),
r as (
  select *, case when source_size > 0 then target / source_size else 0e0 end as ratio from t),
units as (
  select source, doc_id, size, u, count(*) as times, cast(size * count(*) as bigint) as words
  from d group by source, doc_id, size, u),
means as (
  select source, sum(words) / sum(times) as mean from units group by source),
weighed as (
  select units.*, case when mean > 0 then mean / (mean + size) else 0e0 end as x
  from units join means on units.source is not distinct from means.source),
centres as (
  select source, sum(words * x) as centre from weighed group by source),
k as (
  select weighed.*, r.source_size, r.target, cast(floor(ratio) as bigint) as whole, ratio - floor(ratio) as p0,
    (ratio - floor(ratio)) * r.source_size as rest,
    ratio - floor(ratio) + least(ratio - floor(ratio), 1 - ratio + floor(ratio))
      * (x - centre / nullif(r.source_size, 0)) as p
  from weighed join r on weighed.source is not distinct from r.source
    join centres on weighed.source is not distinct from centres.source),
ranks as (
  select *, (u / (1 - u)) / nullif(p / (1 - p), 0) as odds from k),
lists as (
  select source, max(rest) as rest, list({'rank': odds, 'words': words} order by odds) as ranked
  from ranks where p0 > 0 group by source),
filled as (
  select source, list_reduce(ranked, lambda acc, unit: case
      when unit.words <= acc.missing and (acc.cut is null or unit.words > 0)
        then {'missing': acc.missing - unit.words, 'cut': acc.cut, 'taken': list_append(acc.taken, unit.rank)}
      else {'missing': acc.missing, 'cut': coalesce(acc.cut, unit.rank), 'taken': acc.taken} end,
    {'missing': rest, 'cut': cast(null as double), 'taken': cast([] as double[])}) as done
  from lists),
closing as (
  select ranks.source, min({'off': abs(words - done.missing), 'rank': odds}) as fit, max(done.missing) as missing
  from ranks join filled on ranks.source is not distinct from filled.source
  where p0 > 0 and odds >= done.cut and not list_contains(done.taken, odds) group by ranks.source),
mixed as (
  select ranks.*, case when p0 > 0 and (list_contains(done.taken, odds)
      or (fit['off'] < missing and odds = fit['rank'])) then 1 else 0 end as extra
  from ranks left join filled on ranks.source is not distinct from filled.source
    left join closing on ranks.source is not distinct from closing.source)
select doc_id, size, source_size, target, cast(size * (whole + extra) as bigint) as taken, source,
  cast(whole + extra as integer) as copies
from (select *, unnest(range(times)) as copy_of_row from mixed)
"""


@register("op4_simple8b_token_files")
def op4(spark, sf_dir):
    files = token_files.write(
        table(spark, sf_dir, "documents"), scratch_path(spark, "token-files"), public_tokenizers.path("word_bpe_49k.json")
    )
    return token_files.checksums(files)


@register("op5_prefix_token_counts")
def op5(spark, sf_dir):
    counted = prefix_counts.prefix_counts(table(spark, sf_dir, "documents"), BYTE_JSON)
    counted = counted.withColumn("n_tokens", prefix_counts.total(F.col("counts")))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@register("op6_pareto_mix", MIXING_SQL)
def op6(spark, sf_dir):
    return mixing.allocate(table(spark, sf_dir, "documents"))


@register("op7_nn_descent")
def op7(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, most=20)


@register("op8_simhash_near_duplicates")
def op8(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, most_bits=2)
    return found.select("doc_id", "fingerprint", "component_id")


@register("op9_bpe_round_trip")
def op9(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


@register("op10_warc_transactions")
def op10(spark, sf_dir):
    files = warc.write(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return warc.captures(warc.read(files, keep_payload=False))


@register("op11_prefix_trie")
def op11(spark, sf_dir):
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt_turns(table(spark, sf_dir, "conversations")))


@register("op12_merkle_manifest")
def op12(spark, sf_dir):
    return merkle.verified_documents(table(spark, sf_dir, "documents"))


@register("op13_suffix_array_dedup")
def op13(spark, sf_dir):
    return suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents"), length=50)
