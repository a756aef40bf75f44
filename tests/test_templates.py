"""Templates, matching and queries on small logs."""

import pytest
from pyspark.sql import functions as F

from sparkloom.engine import LogEngine
from sparkloom.operators import matching, quality, query, templates
from sparkloom.plans.parse import parse
from sparkloom.sources import archive, text

MIX = [
    "[Thu Jun 09 06:07:04 2005] [notice] LDAP: Built with OpenLDAP", "[Thu Jun 09 06:07:05 2005] [error] Factory error creating channel", "[Thu Jun 09 06:07:19 2005] [notice] Apache/2.0.49 configured",
    "20171223-22:15:29:606|Step_LSC|30002312|onStandStepChanged 3579", "20171223-22:15:29:633|Step_StandReportReceiver|30002312|onReceive",
]


def table(parsed):
    return [(r.template_id, " ".join(r.pattern), r.match_count) for r in parsed.templates.orderBy("rank").collect()]


def test_mixed_lines(spark):
    parsed = parse(text.from_lines(spark, MIX), min_support=2)
    assert table(parsed) == [("T000", "[TIMESTAMP] [SEVERITY] [MESSAGE] [SEVERITY] [MESSAGE] [MESSAGE]", 2), ("T001", "[TIMESTAMP] [MODULE] 30002312 [MESSAGE]", 2)]
    rows = {r.log_idx: r for r in parsed.logs.collect()}
    assert [rows[i].template_id for i in range(5)] == ["T000", "T000", None, "T001", "T001"]
    assert (rows[0].severity, rows[1].severity, rows[2].message) == ("notice", "error", MIX[2])
    assert parsed.templates.select("confidence").first()[0] == pytest.approx(2 / 12)


def test_first_fit(spark):
    parsed = parse(text.from_lines(spark, MIX), min_support=2, strict=False)
    got = {r.log_idx: (r.template_id, r.extracted["TIMESTAMP"], r.extracted["SEVERITY"], r.extracted["MESSAGE"]) for r in parsed.logs.collect()}
    assert got[0] == ("T000", "Thu Jun 09 06:07:04 2005", "Built", "OpenLDAP")
    assert got[2] == ("T000", "Thu Jun 09 06:07:19 2005", "configured", "Apache/2.0.49")
    assert got[3] == ("T000", "20171223-22:15:29:606", "onStandStepChanged 3579", "30002312")


def test_low_cardinality(spark):
    lines = MIX[:3] * 100
    assert table(parse(text.from_lines(spark, lines), 2)) == [("T000", "[TIMESTAMP] [SEVERITY] [FIELD] [FIELD] [FIELD] [FIELD]", 200), ("T001", "[TIMESTAMP] [SEVERITY] Apache/2.0.49 configured", 100)]
    health = [*MIX[3:], "20171223-22:15:29:635|Step_LSC|30002312|processHandleBroadcastAction"] * 50
    assert table(parse(text.from_lines(spark, health), 2)) == [("T000", "[TIMESTAMP] [MODULE] 30002312 [FIELD]", 150)]


def test_many_values(spark):
    lines = [f"[2005-06-09 06:07:{i % 60:02d}] [info] Test message {i}" for i in range(100)]
    assert table(parse(text.from_lines(spark, lines))) == [("T000", "[TIMESTAMP] [SEVERITY] Test message [MESSAGE]", 100)]


def test_cardinality_classes(spark):
    lines = [f"{i % 2} {i % 3} {i % 4} {i % 7} x" for i in range(84)]
    tokens = templates.tokenized(text.from_lines(spark, lines))
    assert [r.cardinality for r in templates.position_cardinality(tokens).orderBy("pos").collect()] == [2, 3, 4, 4, 1]


def test_order_of_rows_does_not_matter(spark):
    lines = text.from_lines(spark, MIX * 4)
    assert table(parse(lines, 2)) == table(parse(lines.orderBy(F.desc("log_idx")).repartition(5), 2))


def test_sources_are_apart(spark):
    both = text.from_lines(spark, MIX, "a").unionAll(text.from_lines(spark, MIX[3:], "b"))
    got = {(r.source, r.template_id) for r in parse(both, 2).templates.collect()}
    assert got == {("a", "T000"), ("a", "T001"), ("b", "T000")}


def test_empty(spark):
    parsed = parse(text.from_lines(spark, []))
    assert parsed.templates.count() == parsed.logs.count() == 0


def query_log(spark):
    lines = [f"2024-12-0{i % 9 + 1} 10:00:0{i % 10} {('INFO', 'ERROR', 'WARNING')[i % 3]} job user{i} 10.0.0.{i % 4}" for i in range(60)]
    return lines, parse(text.from_lines(spark, lines))


def test_queries(spark):
    lines, parsed = query_log(spark)
    logs = parsed.logs
    assert query.by_severity(logs, "error").count() == query.by_severity(logs, ["ERROR"]).count() == 20
    assert query.by_severity(logs, ["error", "Info", "none"]).count() == 40
    assert query.by_ip(logs, "10.0.0.3").count() == 15 and query.by_ip(logs, "10.0.0").count() == 0
    assert query.compound(logs, severity="error", ip="10.0.0.1").count() == sum("ERROR" in x and x.endswith("10.0.0.1") for x in lines)
    assert [r.log_idx for r in query.compound(logs, severity="info", limit=3).collect()] == [0, 3, 6]
    assert query.keyword(logs, "USER7 ").count() == 1 and query.contains(logs, "USER7").count() == 0
    assert [tuple(r) for r in query.top_values(logs, "severity", 2).collect()] == [("INFO", 20), ("ERROR", 20)]
    assert query.parse_filter("ip=1.2.3.4") == {"ip": "1.2.3.4"}
    with pytest.raises(ValueError):
        query.parse_filter("level=x")


def test_time_range_is_closed(spark):
    lines = [f"[2024-01-01 00:00:0{i}] [info] tick {i}" for i in range(6)]
    logs = parse(text.from_lines(spark, lines)).logs
    assert query.time_range(logs, "2024-01-01 00:00:01", "2024-01-01 00:00:03").count() == 3
    assert query.time_range(logs, None, "2024-01-01 00:00:03").count() == 4 and query.time_range(logs).count() == 6


def test_archive(spark, tmp_path):
    lines = [f"[2024-01-01 00:00:{i % 60:02d}] [{'info' if i % 3 else 'error'}] took {i} ms from 10.0.0.{i % 9}" for i in range(500)]
    engine, path = LogEngine(spark), str(tmp_path / "a")
    stats = engine.compress(lines, path).first()
    assert (stats.log_count, stats.template_count, stats.original_size, stats.coverage_percentage) == (500, 1, sum(map(len, lines)), 100)
    assert engine.count(path) == 500
    assert engine.query(path, severity="error", limit=5).count() == 5
    assert engine.query(path, timestamp_after="2024-01-01 00:00:59").count() == 8
    assert engine.query(path, severity="error", message="3").count() == 1
    whole, again = parse(text.from_lines(spark, lines)).logs, archive.with_fields(*archive.read_archive(spark, path))
    columns = ["log_idx", "message", "ts_ms", "field_values", "extracted"]
    assert sorted(map(str, whole.select(columns).collect())) == sorted(map(str, again.select(columns).collect()))
    assert [r.raw for r in engine.decompress(path).orderBy("log_idx").collect()] == lines
    assert matching.positional_equality(engine.decompress(path), text.from_lines(spark, lines)).first().equal == 500
    assert engine.statistics(path)["top_severities"][0] == ("info", 333)
    plan = query.by_ip(engine.load(path), "10.0.0.1")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan
    spark.read.parquet(f"{path}/meta").withColumn("format_version", F.lit("2.0")).write.parquet(f"{path}/meta2")
    import shutil

    shutil.rmtree(f"{path}/meta")
    shutil.move(f"{path}/meta2", f"{path}/meta")
    with pytest.raises(ValueError):
        archive.read_archive(spark, path)


def test_compress_needs_a_template(spark, tmp_path):
    with pytest.raises(ValueError):
        LogEngine(spark).compress(["a", "b c"], str(tmp_path / "x"))


def test_small_templates_spare_the_lines_a_shuffle(spark, tmp_path):
    tokens = templates.tokenized(text.from_lines(spark, MIX))
    found = archive.write_templates(templates.extract_templates(tokens, 2), str(tmp_path))
    assert matching.is_small(found) and not matching.is_small(found, 1)
    plan = matching.match_strict(tokens, found, small=True)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_coverage_and_summary(spark):
    _, parsed = query_log(spark)
    summary = templates.schema_summary(parsed.templates).first()
    assert (summary.template_count, summary.total_matched, summary.coverage) == (1, 60, 1.0)
    plain = parse(text.from_lines(spark, [f"alpha beta {i}" for i in range(9)]))
    assert matching.exact_coverage(text.from_lines(spark, ["alpha beta 77", "alpha gamma 1", "x"]), plain.templates).first().matched == 1
    assert quality.covered(plain.templates, 18).first().percent == 50


def test_batch(spark, tmp_path):
    (tmp_path / "good.log").write_text("\n".join(f"[2024-01-01 00:00:00] [info] took {i} ms" for i in range(30)))
    (tmp_path / "bad.log").write_text("x\n")
    report = LogEngine(spark).compress_batch([str(tmp_path / n) for n in ("good.log", "bad.log", "none.log")], str(tmp_path / "out"))
    assert {r.name: r.ok for r in report.collect()} == {"good.log": True, "bad.log": False, "none.log": False}
    assert quality.batch_report(report).first().failed == 2
