"""Quality measures, schema versions, sources and streams."""

import json

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import matching, quality, query, versioning
from sparkloom.plans.parse import parse
from sparkloom.sources import reports, text
from sparkloom.streaming import ingest


def test_precision_recall(spark):
    a = spark.createDataFrame([(1, "X"), (1, "Y"), (2, "X")], "log_id int, type string")
    b = spark.createDataFrame([(1, "X"), (2, "Z")], "log_id int, type string")
    r = quality.precision_recall(a, b, ["log_id", "type"]).first()
    assert (r.tp, r.fp, r.fn, r.precision) == (1, 1, 2, 0.5) and r.f1 == pytest.approx(0.4)
    none = quality.precision_recall(a.limit(0), b.limit(0), ["log_id", "type"]).first()
    assert (none.tp, none.f1) == (0, 0.0)


def test_stability(spark):
    runs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "c")], "run int, pattern string")
    r = quality.template_stability(runs).first()
    assert r.avg_similarity == pytest.approx((1 + 1 / 3 + 1 / 3) / 3) and (r.num_runs, r.min_templates) == (3, 2)


def test_consistency(spark):
    lines = text.from_lines(spark, ["error at 10.0.0.1 and 10.0.0.999", "ERROR [warn]"])
    got = {r.type: (r.total, r.valid, r.examples) for r in quality.field_type_consistency(lines).collect()}
    assert got == {"SEVERITY": (3, 2, ["error", "ERROR", "[warn]"]), "IP_ADDRESS": (2, 1, ["10.0.0.1", "10.0.0.999"])}


V1 = ("Apache", "2024-01-01 00:00:00", "[TIMESTAMP] [SEVERITY] MESSAGE", ["timestamp", "severity", "message"], {"timestamp": "TIMESTAMP", "severity": "SEVERITY", "message": "MESSAGE"}, 10)
V2 = ("Apache", "2024-01-03 00:00:00", "[TIMESTAMP] [SEVERITY] [IP_ADDRESS] MESSAGE", ["timestamp", "severity", "client_ip", "message"], {**V1[4], "client_ip": "IP_ADDRESS"}, 5)


def registered(spark, rows, versions=None):
    schema = "source_name string, at string, template string, fields array<string>, field_types map<string,string>, sample_count long"
    return versioning.register(spark.createDataFrame(rows, schema).withColumn("registered_at", F.to_timestamp("at")).drop("at"), versions)


def test_versions(spark, tmp_path):
    again = (*V1[:1], "2024-01-02 00:00:00", *V1[2:])
    v = registered(spark, [V1, again, V2])
    assert [(r.version, r.template_hash, r.sample_count) for r in v.orderBy("version").collect()] == [(1, "050f0130a3cca91c", 20), (2, "192b3cf701c92ff2", 5)]
    matrix = {(r.from_version, r.to_version): r for r in versioning.compatibility_matrix(v).collect()}
    assert {k: r.level for k, r in matrix.items()} == {(1, 1): "IDENTICAL", (2, 2): "IDENTICAL", (1, 2): "BACKWARD_COMPATIBLE", (2, 1): "INCOMPATIBLE"}
    assert matrix[1, 2].added == ["client_ip"] and matrix[2, 1].removed == ["client_ip"]
    assert versioning.compare(v, "Apache", 1, 9)["compatible"] is False
    path = str(tmp_path / "v")
    assert reports.load_versions(spark, path).count() == 0
    reports.save_versions(v, path)
    back = registered(spark, [(*V1[:1], "2024-02-01 00:00:00", *V1[2:])], reports.load_versions(spark, path))
    assert [(r.version, r.sample_count) for r in versioning.history(back, "Apache").collect()] == [(1, 20), (2, 5), (3, 10)]
    assert versioning.current(back).first().version == 3


def test_changed_types(spark):
    cast = (V1[0], "2024-01-05 00:00:00", "other", V1[3], {**V1[4], "severity": "STATUS"}, 1)
    r = versioning.evolution(registered(spark, [V1, cast])).first()
    assert (r.changed_types, r.level) == (["severity"], "COMPATIBLE_WITH_CAST")


def test_text_source(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"  one \n\n\xfftwo\r\n \xc2\xa0three\n")
    rows = text.read_logs(spark, str(tmp_path / "a.log"), "a").orderBy("log_idx").collect()
    assert [r.raw for r in rows] == ["one", "two", "three"]
    assert text.read_logs(spark, str(tmp_path / "a.log"), "a", first_lines=2).count() == 1
    with pytest.raises(FileNotFoundError):
        text.read_logs(spark, str(tmp_path / "none"))


def test_datasets(spark, tmp_path):
    for name, files in {"Web": ["Web.log", "Web_full.log"], "db": ["db.log"], "no": ["x.log"]}.items():
        (tmp_path / name).mkdir()
        for f in files:
            (tmp_path / name / f).write_text("a\nb\n" if "full" in f else "a\n")
    assert [(r.name, r.lines) for r in text.datasets(spark, str(tmp_path)).collect()] == [("Web", 2), ("db", 1)]
    assert text.datasets(spark, str(tmp_path / "none")).count() == 0


def test_ground_truth(spark, tmp_path):
    sample = reports.sample_ground_truth()
    (tmp_path / "a.json").write_text(json.dumps(sample))
    (tmp_path / "b.json").write_text(json.dumps({"dataset": "b", "logs": [{"id": 7, "raw": "x 1.2.3.4", "fields": [{"type": "ip_address", "value": "1.2.3.4", "start": 2, "end": 9}]}]}))
    rows = reports.read_ground_truth(spark, str(tmp_path / "*.json")).collect()
    assert {(r.log_id, r.type, r.value) for r in rows} == {("7", "IP_ADDRESS", "1.2.3.4"), *(("sample_001", f["type"], f["value"]) for f in sample["annotations"][0]["fields"])}
    assert "| a |" in reports.markdown([{"a": 1}], "t") and "Nothing" in reports.markdown([], "t")


def test_stream_equals_batch(spark, tmp_path):
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    logs.mkdir()
    lines = [f"[2024-01-01 00:00:0{i % 10}] [info] took {i} ms" for i in range(40)]
    (logs / "a.log").write_text("\n".join(lines[:20]))
    (logs / "a.log.1").write_text("\n".join(lines[20:]))
    (logs / "a.txt").write_text("no log")
    drift = []
    first = parse(text.from_lines(spark, lines)).templates
    done = ingest.ingest(ingest.watch(spark, str(logs)), out, str(tmp_path / "c"), lambda: first, lambda t, n: drift.append(t.count()))
    done.awaitTermination()
    batch = parse(text.from_lines(spark, lines)).logs
    columns = ["raw", "template_id", "ts_ms", "severity", "message"]
    assert sorted(map(tuple, spark.read.parquet(out).select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))
    assert drift == [0]
    again = ingest.ingest(ingest.watch(spark, str(logs)), out, str(tmp_path / "c"), lambda: first)
    again.awaitTermination()
    assert spark.read.parquet(out).count() == 40


def test_stream_drift(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("\n".join(f"new shape {i}" for i in range(5)))
    first = parse(text.from_lines(spark, [f"[2024-01-01 00:00:00] [info] took {i} ms" for i in range(5)])).templates
    drift = []
    ingest.ingest(ingest.watch(spark, str(logs)), str(tmp_path / "o"), str(tmp_path / "c"), lambda: first, lambda t, n: drift.extend(" ".join(r.pattern) for r in t.collect())).awaitTermination()
    assert drift == ["new shape [MESSAGE]"]


def test_stream_with_templates_of_several_files(spark, tmp_path):
    """Templates that two files gave serve a third, and each of its lines comes once."""
    logs, out, store = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "store")
    logs.mkdir()
    line = "[2024-01-01 00:00:0{}] [info] took {} ms".format

    def run():
        lines = ingest.watch(spark, str(logs))
        ingest.ingest(lines, out, str(tmp_path / "c"), ingest.template_store(spark, store), ingest.keep_templates(store)).awaitTermination()
        return spark.read.parquet(out)

    for name in ("a.log", "b.log"):
        (logs / name).write_text("\n".join(line(i % 10, i) for i in range(20)))
    assert run().count() == 40 and spark.read.parquet(store).count() == 2
    (logs / "c.log").write_text("\n".join([*(line(i % 10, i) for i in range(20)), *(f"new shape {i}" for i in range(5))]))
    got = run()
    assert got.count() == 65 and got.where("source like '%c.log' and severity = 'info'").count() == 20
    assert spark.read.parquet(store).count() == 3  # the drift is kept
    (logs / "d.log").write_text("\n".join(f"new shape {i}" for i in range(4)))
    assert run().where("source like '%d.log' and template_id is not null").count() == 4


def test_stream_skips_what_is_there(spark, tmp_path):
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    logs.mkdir()
    (logs / "a.log").write_text("\n".join(f"took {i} ms" for i in range(20)))
    for k in range(2):  # a second stream, with a checkpoint of its own
        ingest.ingest(ingest.watch(spark, str(logs)), out, str(tmp_path / f"c{k}"), lambda: None, skip_existing=True).awaitTermination()
    assert spark.read.parquet(out).count() == 20


def test_annotations_of_files_that_share_ids(spark, tmp_path):
    for name, value in (("a", "1.1.1.1"), ("b", "2.2.2.2")):
        notes = [{"log_id": "1", "raw_text": v, "fields": [{"name": "i", "type": "ip_address", "start_pos": 0, "end_pos": 7, "value": v}]} for v in ("0.0.0.0", value)]
        (tmp_path / f"{name}.json").write_text(json.dumps({"dataset": name, "annotations": notes}))
    assert sorted(r.value for r in reports.read_ground_truth(spark, str(tmp_path / "*.json")).collect()) == ["1.1.1.1", "2.2.2.2"]


def test_lines_of_two_sources(spark):
    one, two = text.from_lines(spark, ["a", "b"], "x"), text.from_lines(spark, ["c", "d"], "y")
    both = one.unionByName(two)
    assert tuple(matching.positional_equality(both, both).first()) == (4, 4)
    assert [r.raw for r in query.rows_by_id(both, two.limit(1)).collect()] == ["c"]


def test_store_of_many_sources(spark, tmp_path):
    """A store has as many folders however many sources it has, and keeps names as they are."""
    path = str(tmp_path / "store")
    names = [None, "", "a=b/c", *map(str, range(200))]
    of = lambda sources, when, t: spark.createDataFrame([(n, when, t, ["f"], {"f": "X"}, 1) for n in sources], "source_name string, registered_at string, template string, fields array<string>, field_types map<string,string>, sample_count long").withColumn("registered_at", F.to_timestamp("registered_at"))
    reports.save_versions(versioning.register(of(names, "2024-01-01 00:00:00", "one")), path)
    assert len(list((tmp_path / "store").glob("*=*"))) <= reports.BUCKETS
    again = [None, "", "7"]
    old = reports.load_versions(spark, path).where(F.coalesce("source_name", F.lit("")).isin("", "7"))
    reports.save_versions(versioning.register(of(again, "2024-01-02 00:00:00", "two"), old), path)
    got = {(r.source_name, r.version, r.template) for r in reports.load_versions(spark, path).collect()}
    assert got == {(n, 1, "one") for n in names} | {(n, 2, "two") for n in again}
    assert reports.load_versions(spark, path).count() == len(names) + len(again)
