"""Command line: verify, clean and normalize parquet tables.

    python -m quakeframe.cli verify TABLE SCHEMA.json [--test required types]
    python -m quakeframe.cli clean TABLE SCHEMA.json OUT [--rename a:b ...] [--delete c ...] [--fix]
    python -m quakeframe.cli normalize WF SITE OUT --codes net sta [--prefix site]
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quakeframe.operators import quality
from quakeframe.operators.match import MiniseedMatcher
from quakeframe.schema import table_schema


def _schema(path: str):
    with open(path) as f:
        return table_schema("table", json.load(f))


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quakeframe")
    sub = p.add_subparsers(dest="command", required=True)
    v = sub.add_parser("verify")
    v.add_argument("table")
    v.add_argument("schema")
    v.add_argument("--test", nargs="*", default=["required", "types"], choices=["required", "types"])
    v.add_argument("--show", type=int, default=20)
    c = sub.add_parser("clean")
    c.add_argument("table")
    c.add_argument("schema")
    c.add_argument("out")
    c.add_argument("--rename", nargs="*", default=[])
    c.add_argument("--delete", nargs="*", default=[])
    c.add_argument("--fix", action="store_true")
    n = sub.add_parser("normalize")
    n.add_argument("table")
    n.add_argument("site")
    n.add_argument("out")
    n.add_argument("--codes", nargs="+", default=["net", "sta"])
    n.add_argument("--prefix", default="site")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    df = spark.read.parquet(a.table)
    if a.command == "verify":
        schema, bad = _schema(a.schema), 0
        for test in a.test:
            found = quality.check_required(df, schema) if test == "required" else quality.check_types(df, schema)
            count = found.count()
            bad += count
            print(f"{test}: {count} rows")
            if count:
                found.show(a.show, truncate=False)
        return int(bad > 0)
    if a.command == "clean":
        names = dict(x.split(":", 1) for x in a.rename)
        df, renamed = quality.rename_attributes(df, names)
        df, deleted = quality.delete_attributes(df, a.delete)
        for what, counts in (("renamed", renamed), ("deleted", deleted)):
            if counts.columns:
                print(what, counts.first().asDict())
        if a.fix:
            df, counts = quality.fix_types(df, _schema(a.schema))
            print("types", counts.first().asDict())
        df.write.parquet(a.out)
        return 0
    site = spark.read.parquet(a.site)
    own = MiniseedMatcher(site, a.prefix, a.codes, ["_id"], order=["starttime", "_id"])
    rows = df.withColumn("qf_key", F.monotonically_increasing_id())
    own.find_one(rows, ["qf_key"]).drop("qf_key", "n_matches").write.parquet(a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
