"""python -m textloom.cli convert|check|normalization|diagnose: tokenizer definitions from the command line."""

from __future__ import annotations

import argparse
import sys
import unicodedata
from pathlib import Path

from .sources.convert import load


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.getOrCreate()


def convert(a) -> int:
    Path(a.out).write_text(load(a.definition, a.kind).to_json())
    return 0


def check(a) -> int:
    """Encodes and decodes each line; prints those that don't come back."""
    p, spark = load(a.definition, a.kind), _spark()
    from pyspark.sql import functions as F

    x = spark.read.text(a.texts).select("value", p.ids(F.col("value")).alias("ids"))
    bad = x.withColumn("back", p.decode(F.col("ids"))).where(~F.col("back").eqNullSafe(F.col("value")))
    bad.show(a.show, 100)
    return 0 if bad.isEmpty() else 1


def normalization(a) -> int:
    """Normalizes the first field of each `;`-separated line of code points, and compares with the field of the form."""
    at = {"NFC": 1, "NFD": 2, "NFKC": 3, "NFKD": 4}[a.form]
    passed = failed = 0
    for line in Path(a.texts).read_text().splitlines():
        fields = line.split("#")[0].split(";")
        if len(fields) < 5:
            continue
        text = lambda f: "".join(chr(int(c, 16)) for c in f.split())
        ok = unicodedata.normalize(a.form, text(fields[0])) == text(fields[at])
        passed, failed = passed + ok, failed + (not ok)
    print(f"{passed} passed, {failed} failed")
    return int(failed > 0)


def diagnose(a) -> int:
    """Every stage of both definitions for each text, and the first at which they differ."""
    spark = _spark()
    df = spark.createDataFrame([(t,) for t in a.text], "text string")
    one, two = (load(d, a.kind).explain_stages(df, "text").collect() for d in (a.definition, a.other))
    for x, y in zip(one, two, strict=True):
        first = next((m for m, n in zip(x.asDict().items(), y.asDict().items(), strict=False) if m[1] != n[1]), None)
        print(repr(x["text"]), "same" if first is None else f"differs at {first[0]}: {first[1]}")
    return 0


def main(argv=None) -> int:
    parser = argparse.ArgumentParser(prog="textloom", description=__doc__)
    parser.add_argument("--kind", choices=["json", "sentencepiece", "ranks", "trie", "pipeline"])
    sub = parser.add_subparsers(required=True)
    for name, f, args in (("convert", convert, ["definition", "out"]), ("check", check, ["definition", "texts"]), ("normalization", normalization, ["form", "texts"]), ("diagnose", diagnose, ["definition", "other", "text"])):
        s = sub.add_parser(name, help=f.__doc__)
        for x in args:
            s.add_argument(x, **({"nargs": "+"} if x == "text" else {}))
        s.add_argument("--show", type=int, default=20)
        s.set_defaults(run=f)
    a = parser.parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
