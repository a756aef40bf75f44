"""python -m sparkloom compress LOG ARCHIVE | query ARCHIVE [--severity X | --ip X] [--limit N] | datasets FOLDER"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .engine import LogEngine
from .sources import text


def main(args: list[str]) -> int:
    top = argparse.ArgumentParser(prog="sparkloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compress")
    c.add_argument("source")
    c.add_argument("archive")
    c.add_argument("--min-support", type=int, default=3)
    q = sub.add_parser("query")
    q.add_argument("archive")
    q.add_argument("-s", "--severity", action="append")
    q.add_argument("-i", "--ip")
    q.add_argument("-n", "--limit", type=int, default=10)
    d = sub.add_parser("datasets")
    d.add_argument("folder")
    given = top.parse_args(args)
    spark = SparkSession.builder.appName("sparkloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if given.command == "compress":
            LogEngine(spark, given.min_support).compress_file(given.source, given.archive).show(truncate=False)
        elif given.command == "query":
            engine = LogEngine(spark)
            found = engine.query(given.archive, severity=given.severity, ip=None if given.severity else given.ip)
            print(f"total {engine.count(given.archive)}, matched {found.count()}")
            for row in found.orderBy("log_idx").limit(given.limit).collect():
                print(row.raw)
        else:
            text.datasets(spark, given.folder).show(100, truncate=False)
    except FileNotFoundError as e:
        print(f"not found: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
