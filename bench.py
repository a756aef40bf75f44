"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "severity_per_day", "template_table", "extract_fields", "severity_filter", "ip_filter", "count_all", "time_range", "compound_filter", "keyword_filter", "top_severities", "archive_statistics", "delta_encode", "rle_runs", "gorilla_dod_bits", "type_consistency", "compat_matrix",
]
#: Queries of an archive, each against the scan of raw lines that gives the same rows: a warm-up, then the mean of three.
RUNS = 3


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from sparkloom.engine import LogEngine
    from sparkloom.plans.log_lines import log_lines
    from sparkloom.queries import QUERIES

    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    speedups: dict[str, float] = {}

    def timed(name, run) -> None:
        began = time.time()
        run()
        times[name] = round(time.time() - began, 3)

    done = lambda df: df.write.format("noop").mode("overwrite").save()
    done(QUERIES["count_all"](spark, d))  # starts the session
    for name in HEADLINE:
        timed(name, lambda: done(QUERIES[name](spark, d)))  # noqa: B023

    import tempfile

    engine, lines = LogEngine(spark), log_lines(spark, d)
    with tempfile.TemporaryDirectory() as folder:
        stats: list = []
        timed("archive_write", lambda: stats.append(engine.compress(lines, folder).first()))
        raw = spark.read.parquet(f"{folder}/logs").select("raw")
        pairs = {
            "severity": (lambda: done(engine.query(folder, severity="ERROR").select("raw")), lambda: done(raw.where(F.lower("raw").contains("error")))),
            "ip": (lambda: done(engine.query(folder, ip="10.0.0.7").select("raw")), lambda: done(raw.where(F.col("raw").contains("10.0.0.7")))),
            "compound": (lambda: done(engine.query(folder, severity="WARN", timestamp_after="2024-01-10 00:00:00").select("raw")), lambda: done(raw.where(F.lower("raw").contains("warn")))),
            "count": (lambda: engine.count(folder), lambda: raw.count()),
            "decompress": (lambda: done(engine.decompress(folder)), lambda: done(raw)),
        }

        def mean(run) -> float:
            run()  # warm-up
            began = time.time()
            for _ in range(RUNS):
                run()
            return (time.time() - began) / RUNS

        for name, (own, scan) in pairs.items():
            times[f"archive_{name}"], times[f"raw_{name}"] = round(mean(own), 3), round(mean(scan), 3)
            speedups[name] = round(times[f"raw_{name}"] / max(times[f"archive_{name}"], 1e-3), 2)
    s = stats[0]
    extra = {"lines": s.log_count, "lines_per_second_compress": round(s.log_count / times["archive_write"]), "compression_ratio": round(s.compression_ratio, 2), "speedups": speedups}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(d.rstrip("/")), **extra}))
    spark.stop()


if __name__ == "__main__":
    main()
