"""Queries op1..op13 over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm import (jaccard, langid, lines, mixing, packing, periodic, ranking, repetition, secrets,
                           sharding, tokens, urls, vectors)
from tabwright.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# Word, line and window rules in SQL; a repeat of more than 40 words is a repeated 41-word window.
REPETITION_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), l as (
  select doc_id, count(*) - count(distinct line) as n_dup_lines
  from (select doc_id, unnest(string_split(text, chr(10))) as line from d)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id
), g as (
  select doc_id, i, w[i:i + 7] as gram from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d)
), r as (
  select doc_id, unnest(range(i, i + 8)) as p
  from (select doc_id, i, count(*) over (partition by doc_id, gram) as n from g) where n > 1
), c as (select doc_id, count(distinct p) as n_repeat_words from r group by doc_id),
long_repeat as (
  select distinct doc_id from (
    select doc_id, gram from (select doc_id, w[i:i + 40] as gram
      from (select doc_id, w, unnest(range(1, len(w) - 39)) as i from d)) group by doc_id, gram having count(*) > 1)
), b as (
  select d.doc_id, cast(len(w) as bigint) as n_words,
         cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
         cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(coalesce(l.n_dup_lines, 0) as bigint) as n_dup_lines,
         cast(coalesce(c.n_repeat_words, 0) as bigint) as n_repeat_words,
         long_repeat.doc_id is not null as too_long
  from d left join l using (doc_id) left join c using (doc_id) left join long_repeat using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and not too_long as kept
from b
"""


@query("op2_quality_rules", REPETITION_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = repetition.repetition_report(table(spark, sf_dir, "documents"), min_words=8)
    return repetition.judge(report, 20, 30, 40).drop("longest_repeat")


@query("op3_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = tokens.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = tokens.bpe_encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return tokens.bpe_decode(encoded, ranks).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                  1024, 0, with_ids=False)


# The rules of the driver's contract
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
             ("block", "com/de/")]


@query("op1_embedding_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)


@query("op4_url_filter")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query("op5_line_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"), min_words=40) \
        .select("doc_id", "lines_deleted", "words_deleted", "text")


@query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *(secrets.count_kind(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    return langid.identify(table(spark, sf_dir, "documents"), F.when(~held_out, F.col("lang")), held_out)


@query("op8_ngram_jaccard")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), 5, 80).drop("row")


@query("op9_sharding")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


RANKING_SQL = r"""
with d as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents
), q as (
  select item_id, term, count(*) as times from (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by all
), lengths as (select doc_id, count(*) as n from d group by doc_id),
whole as (select count(*) as n_docs, cast(sum(n) as bigint) as n_terms from lengths),
m as (select doc_id, 75 + (25 * n * n_docs) // n_terms as m from lengths, whole),
p as (select doc_id, term, count(*) as tf from d where term in (select term from q) group by all),
w as (select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as bigint) as w
      from (select term, count(*) as df from p group by term), whole),
s as (select item_id, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score
      from q join w using (term) join p using (term) join m using (doc_id) group by all),
r as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
      from s where score > 0)
select * from r where rank <= 20
"""


@query("op11_ranked_search", RANKING_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


# crc32 by bits over the decimal digits; equal words at a distance p in unbroken stretches are runs of period p
PERIODIC_SQL = r"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
         xor(4294967295, list_reduce(list_concat([4294967295::bigint], flatten(list_transform(
             string_split(cast(doc_id as varchar), ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda c, x: case when x >= 0 then xor(c, x) when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as h
  from documents
), e as (select doc_id, w, len(w) as n, h % 10 = 0 and len(w) > 0 as planted, (h // 10) % greatest(len(w), 1) as a,
                1 + (len(w) - (h // 10) % greatest(len(w), 1)) // (3 + (h // 10) % 8) as p from d),
x as (
  select doc_id, n, case when planted then list_transform(range(0, n), lambda i: w[1 + case when i < a then i else a + (i - a) % p end])
                         else w end as w from e
), words as (select doc_id, n, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from x),
pairs as (
  select f.doc_id, f.i, g.i - f.i as p from words f join words g using (doc_id, word) where g.i > f.i and g.i - f.i <= f.n // 4
), stretches as (
  select doc_id, p, min(i) as start, count(*) + p as length
  from (select *, i - row_number() over (partition by doc_id, p order by i) as part from pairs)
  group by doc_id, p, part having count(*) + p >= greatest(6, 4 * p)
), runs as (select doc_id, start, length, min(p) as period from stretches group by doc_id, start, length),
of_doc as (
  select doc_id, count(*) as n_runs, arg_min({'s': start, 'l': length, 'p': period}, [-length, start, period]) as best,
         string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as written
  from runs group by doc_id
), dropped as (select distinct doc_id, unnest(range(start + period, start + length)) as i from runs),
kept as (
  select doc_id, string_agg(word, ' ' order by i) as body from words anti join dropped using (doc_id, i) group by doc_id
)
select doc_id, coalesce(n_runs, 0) as n_runs, cast(best.s as bigint) as start, cast(best.l as bigint) as length,
       cast(best.p as bigint) as period, cast(1000 * best.l // best.p as bigint) as exponent_milli,
       sha256(coalesce(written, '')) as runs_sha256, sha256(coalesce(body, '')) as collapsed_sha256
from x left join of_doc using (doc_id) left join kept using (doc_id)
"""


def planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the texts, by the contract's crc32, made periodic from a word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    own = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeat(word):
        n, g = F.size(word), F.floor(h / 10)
        a = F.pmod(g, F.greatest(n, F.lit(1)))
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n > 0, F.concat_ws(" ", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(
            word, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))))).otherwise("")
    # the one-element array binds the words once
    return docs.select("doc_id", F.when(h % 10 == 0, F.transform(F.array(own), repeat)[0]).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs", PERIODIC_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(planted_periods(table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("least"), r.start.alias("start"), r.period.alias("period"))))
    line = lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), (-best["least"]).alias("length"),
        best["period"].alias("period"), F.floor(-1000 * best["least"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


# the level of the shares: with the sources by cap and weight, the first k capped, the others share by weight
MIXING_SQL = r"""
with d as (
  select doc_id, source, md5(doc_id || '|777') as key,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents
), s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
r as (select *, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight from s),
o as (
  select *, row_number() over w as k, sum(weight) over () - sum(weight) over w as weight_left,
         sum(source_size) over () - 3 * sum(source_size) over w as words_left
  from r window w as (order by source_size / weight, source nulls last rows unbounded preceding)
), levels as (
  select 0 as k, cast(sum(weight) as bigint) as weight_left, cast(sum(source_size) as bigint) as words_left from r
  union all select k, cast(weight_left as bigint), cast(words_left as bigint) from o
), level as (
  select k, weight_left, words_left from levels l
  where not exists (select 1 from o where o.k > l.k and o.weight * l.words_left / l.weight_left > 3 * o.source_size)
  order by k limit 1
), t as (
  select o.source, o.source_size,
         case when o.k <= level.k then cast(3 * o.source_size as double) else o.weight * level.words_left / level.weight_left end as target
  from o, level
), q as (
  select doc_id, size, source_size, target, cast(floor(target) as bigint) as stop,
         cast(sum(size) over (partition by d.source order by key, doc_id rows unbounded preceding) as bigint) - size as start
  from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target,
       cast(greatest(0, least(size, stop - start)) + greatest(0, least(size, stop - start - source_size))
            + greatest(0, least(size, stop - start - 2 * source_size)) as bigint) as taken
from q
"""


@query("op13_source_mix", MIXING_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"), (5, 2, 1))
