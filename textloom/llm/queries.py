"""One query per operator, over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, fingerprints, html, lm, mixing, near, quality, substring, urls


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_bytes(_read(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return got.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_words(_read(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = contamination.decontaminate(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return got.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return got.select("row.doc_id", "text_score", "meta_score", "score", "good")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(_read(spark, sf_dir, "documents")).drop("same")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_read(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    import corpus_pipeline

    return {**dict(sorted(own.items(), key=lambda x: int(x[0][2:].split("_")[0]))), "pipeline": corpus_pipeline.run}


URLS = r"""
with u as (select page_id, case when contains(url, '://') then regexp_extract(url, '(?s)^.*?://(.*)$', 1) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) as path from u),
r(verdict, rhost, rpath) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m as (select page_id, arg_max(rhost || rpath, length(rhost || rpath) * 1000 + length(rhost)) as rule, arg_max(verdict, length(rhost || rpath) * 1000 + length(rhost)) as verdict
  from h join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id)
select h.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from h left join m using (page_id)"""

BYTES = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
win as (select doc_id, i, substr(h, 2 * i + 1, 200) as s from d, unnest(range(0, greatest(n - 99, 0))) as t(i)),
late as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as r from win) where r > 1),
byte as (select doc_id, p, substr(h, 2 * p + 1, 2) as b from d, unnest(range(0, n)) as t(p)),
gone as (select byte.doc_id, p, b, coalesce(p - max(i) over (partition by byte.doc_id order by p) < 100, false) as g from byte left join late on late.doc_id = byte.doc_id and i = p),
edge as (select *, g and not coalesce(lag(g) over (partition by doc_id order by p), false) as e from gone),
kept as (select doc_id, count(*) filter (g) as n_removed, count(*) filter (e) as n_spans, string_agg(b, '' order by p) filter (not g) as k from edge group by doc_id)
select doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(k, ''))) as kept_sha256 from d left join kept using (doc_id)"""

MIX = r"""
with d as (select doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, 2.0::double * source_size as full_, [5.0, 2.0, 1.0][((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1)::int]::double as weight from s),
v as (select *, row_number() over o as rank, ((sum(source_size) over ())::double * 1.5::double - coalesce(sum(full_) over (o rows between unbounded preceding and 1 preceding), 0)) / (sum(weight) over (o rows between current row and unbounded following)) as level
  from w window o as (order by full_ / weight, encode(source) nulls last)),
f as (select arg_min(rank, rank) as first_rank, arg_min(level, rank) as first_level from v where level * weight <= full_),
t as (select source, source_size, case when first_rank is null or rank < first_rank then full_ else first_level * weight end::double as target from v, f),
x as (select doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0 end::double as rate, ('0x' || substr(md5('42:' || coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, 13))::bigint / 4503599627370496.0::double as u
  from d join t on d.source is not distinct from t.source),
c as (select *, floor(rate)::bigint + (u < rate - floor(rate))::bigint as copies from x)
select doc_id, size, source_size, target, size * copies as taken, copies from c"""

SUBSTRINGS = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as s from d, unnest(range(1, len(w) - 11)) as t(i)),
late as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) as m from win) where doc_id > m),
gone as (select distinct doc_id, i + k as p from late, range(13) as r(k)),
kept as (select d.doc_id, string_agg(d.w[p], ' ' order by p) as t, count(*) as n from d, unnest(range(1, len(w) + 1)) as x(p) where not exists (select 1 from gone g where g.doc_id = d.doc_id and g.p = x.p) group by d.doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)"""

ITEMS = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
q as (select distinct item_id, least(len(w), 10) as l, array_to_string(w[i:i + 9], ' ') as s from b, unnest(range(1, greatest(2, len(w) - 8))) as t(i) where len(w) > 0),
ls as (select distinct l from q),
win as (select doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') as s from d, ls, unnest(range(1, len(w) - l + 2)) as t(i)),
hit as (select doc_id, i, l, item_id from win join q using (l, s)),
n as (select doc_id, count(distinct i + k) as n_hit from hit, unnest(range(l)) as r(k) group by doc_id),
it as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hit group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (doc_id) left join it using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """The others can't be said in SQL, or only too slowly: tests hold them against brute force."""
    return {"op1_suffix_array_dedup": BYTES, "op2_url_filters": URLS, "op3_mixing": MIX, "op4_substring_dedup": SUBSTRINGS, "op6_decontamination": ITEMS}
