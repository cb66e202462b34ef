"""URL filters by a sort-merge range join.

A host read backwards, label by label (`com.example.`), is a canonical key: a rule's host and all its subdomains are
the keys that begin with the rule's, one interval. Urls sorted by key are swept once; a stack holds the rules whose
intervals contain the present key, each nested in the one below it. Where several of them also match the path, the
longest wins.

Rules of up to `SMALL` bytes go to the urls, which stay where they are. Any number of rules is joined with the different
(host, path) pairs: a pair stands once for each of the host's ancestors that has rules, so that key and path together
are swept, and a rule's paths are an interval there too. Ranges of that order have bounds from a sample; a rule goes to
every range that its interval meets, and a range's sweep finds the rules that began before it at its start.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import salted

RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
SMALL = 8_000_000  #: bytes of rules up to which every task gets them all
RANGE = 200_000  #: pairs in a range
AFTER = "\U0010ffff"  #: follows whatever begins like the text before it


def canonical(host: str) -> str:
    return "".join(f"{x}." for x in reversed(host.split(".")))


def prepared(rules) -> list[tuple[str, str, str, str]]:
    """((key, host, path), verdict), sorted so that a rule comes before those nested in it; of equal rules the last counts."""
    return sorted({(canonical(h), h, p): v for v, h, p in rules}.items())


def sweep(keys: list[str], rules: list) -> Iterator[tuple[int, list]]:
    """Each key's number with the rules whose interval contains it, outer ones first. Both inputs are sorted; a rule's first item is a tuple that begins with its key."""
    stack: list = []
    at = 0
    for i, key in enumerate(keys):
        while at < len(rules) and rules[at][0][0] <= key:
            while stack and not rules[at][0][0].startswith(stack[-1][0][0]):
                stack.pop()
            stack.append(rules[at])
            at += 1
        while stack and not key.startswith(stack[-1][0][0]):
            stack.pop()
        yield i, stack


def _parts(pages: DataFrame) -> DataFrame:
    rest = F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return pages.select("page_id", F.translate(host, upper, upper.lower()).alias("host"), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"))


def judge(pages: DataFrame, rules=RULES, otherwise: str = "allow", small: int = SMALL) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    Host and path are empty for a null url or one without `://`. A rule is (verdict, host, path), in a sequence (of equal
    ones the last counts) or as a DataFrame with these columns (the greatest verdict counts; a rule with a null is none).
    It fits its host and all subdomains if the path starts with its path. The longest host and path wins, of equally long
    ones that with the longer host. Without a rule: null, and the verdict `otherwise`. Equal urls fare alike; an empty
    table gives no rows."""
    source = _parts(pages)
    if isinstance(rules, DataFrame):
        rules = rules.where("verdict is not null and host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + F.octet_length("verdict") + 24)).first()[0] or 0
        if size > small:
            return _joined(source, rules, otherwise)
        rules = [(r.verdict, r.host, r.path) for r in rules.collect()]  # at most `small` bytes
    elif sum(len(x) for r in rules for x in r) > small:
        last = {(h, p): v for v, h, p in rules}
        return _joined(source, pages.sparkSession.createDataFrame([(v, h, p) for (h, p), v in last.items()], "verdict string, host string, path string"), otherwise)
    listed = prepared(rules)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            hosts, inv = np.unique(np.array(rb.column("host").to_pylist(), object), return_inverse=True)
            keys = [canonical(h) for h in hosts]
            order = sorted(range(len(keys)), key=keys.__getitem__)
            active = [[]] * len(keys)
            for i, stack in sweep([keys[j] for j in order], listed):
                if stack:
                    active[order[i]] = sorted(stack, key=lambda r: (-len(r[0][1]) - len(r[0][2]), -len(r[0][1])))
            names, verdicts = [], []
            for h, path in zip(inv.tolist(), rb.column("path").to_pylist(), strict=True):
                won = next((r for r in active[h] if path.startswith(r[0][2])), None)
                names.append(won and won[0][1] + won[0][2])
                verdicts.append(won[1] if won else otherwise)
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(names, pa.string()), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return source.mapInArrow(f, f"page_id {source.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string")


def _key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def _ancestors(host: Column) -> Column:
    """The keys of the host and of all hosts that it lies under."""
    labels = F.reverse(F.split(host, "\\."))
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit(".")))


def _joined(source: DataFrame, rules: DataFrame, otherwise: str, each: int = RANGE) -> DataFrame:
    """The range join. Key and path are one text, with a character between them that sorts before all others."""
    place = lambda key, path: F.concat(key, F.lit("\0"), path)
    rules = rules.select(place(_key(F.col("host")), F.col("path")).alias("place"), "host", "path", "verdict")
    heads = rules.select(F.substring_index("place", "\0", 1).alias("head")).distinct()
    pairs = source.select("host", "path").distinct()
    under = pairs.select("host").distinct().select("host", F.explode(_ancestors(F.col("host"))).alias("head")).join(heads, "head")
    pairs = salted(pairs, under, ["host"], F.col("path")).select("host", "path", place(F.col("head"), F.col("path")).alias("place"))
    n = pairs.count() // each + 1
    one_in = max(1, each // 40)
    some = [r.place for r in pairs.where(F.pmod(F.xxhash64(F.lit(3), "place"), F.lit(one_in)) == 0).select("place").orderBy("place").collect()]  # about 40 a range
    bounds = [some[len(some) * i // n] for i in range(1, n)] if some else []

    @F.arrow_udf("int")
    def ranged(x: pa.Array) -> pa.Array:
        return pa.array([bisect_right(bounds, t) for t in x.to_pylist()], pa.int32())

    left = pairs.withColumn("range", ranged("place"))
    right = rules.withColumn("range", F.explode(F.sequence(ranged("place"), ranged(F.concat("place", F.lit(AFTER))))))
    out = "host string, path string, rule_host string, rule_path string, verdict string"

    def swept(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in out.split(", ")]
        order = sorted(range(left.num_rows), key=(keys := left.column("place").to_pylist()).__getitem__)
        have = sorted(((p,), h, q, v) for p, h, q, v in zip(*(right.column(c).to_pylist() for c in ("place", "host", "path", "verdict")), strict=True))
        got = [(order[i], stack[-1]) for i, stack in sweep([keys[j] for j in order], have) if stack]  # the innermost has the longest path
        cols = [left.column(c).take([i for i, _ in got]) for c in ("host", "path")]
        return pa.table([c.cast(pa.string()) for c in cols] + [pa.array([r[k] for _, r in got], pa.string()) for k in (1, 2, 3)], names)

    won = left.groupBy("range").cogroup(right.groupBy("range")).applyInArrow(swept, out)
    rule = F.concat("rule_host", "rule_path")
    won = won.groupBy("host", "path").agg(F.max(F.struct(F.length(rule), F.length("rule_host"), rule.alias("rule"), "verdict")).alias("won"))
    won = won.select("host", "path", "won.rule", "won.verdict")
    return salted(source, won, ["host", "path"], F.col("page_id"), "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))
