"""Whole imports on small files, and the invariants of validation, lookups, split, merge and jobs."""

import time
from dataclasses import replace

import pytest
from data import NETWORK, auto, gauges
from pyspark.sql import functions as F

from strata.catalog import Options
from strata.engine import Engine, Step
from strata.errors import Conflict, DuplicateKey, LookupRejected
from strata.frames import add_issue, frame
from strata.operators import jobs, split
from strata.operators.lookups import FunctionProvider, RelationProvider, looked_up, resolve_lookups
from strata.operators.merge import last_wins, merge, numbered
from strata.operators.validate import validate
from strata.plans.manifest import Entity, Field, Kind, Lookup, Manifest, Missing
from strata.store import Store


@pytest.fixture
def engine(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    engine.code_lists.put("basins", [("RHINE", "to the North Sea"), ("ODER", None)])
    return engine


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_trees_are_accepted_or_rejected_whole_and_imports_repeat(engine, tmp_path):
    engine.add_dataset(gauges())
    path = write(tmp_path, "a.xml", NETWORK)
    job = engine.import_file(path, "gauges")
    assert (job["status"], job["records_read"], job["records_rejected"], job["inserted"], job["updated"]) == ("CompletedWithRejections", 11, 6, 5, 0)
    found = engine.rejections(job["id"]).select("entity", "line", "field", "raw_value").collect()
    assert [tuple(r) for r in found] == [("Gauge", 11, "Basin", "amazon"), ("Gauge", 13, "Height", "high"), ("Reading", 15, "At", "noon")]
    assert [r.kind for r in engine.events(job["id"]).collect()] == ["started", "completed"]
    table = lambda name: engine.table("gauges", name)
    rows = table("Reading").join(table("Sensor"), "SensorKey").join(table("Gauge"), "GaugeKey").orderBy("At").collect()
    assert [(r.Code, r.BasinId, str(r.Opened), str(r.Height), r.Slot, r.Active, str(r.At), r.Level, r.Flag) for r in rows] == [
        ("RH-07", 1, "1987-11-03", "212.250", 4, False, "2026-03-01 06:00:00", 1.75, "raw"), ("RH-07", 1, "1987-11-03", "212.250", 4, False, "2026-03-01 06:15:00", 1.5, "checked"),
    ]
    assert sorted((r.Slot, r.Model, r.Active) for r in table("Sensor").collect()) == [(4, "radar", False), (5, None, True)]
    again = engine.import_file(path, "gauges")
    assert (again["inserted"], again["updated"]) == (0, 5) and [table(e).count() for e in ("Gauge", "Sensor", "Reading")] == [1, 2, 2]
    assert [j.id for j in engine.jobs(top=0).collect()] == [again["id"]] and engine.metrics().first().jobs_completed == 2


def test_json_and_codes_that_are_made(engine, tmp_path):
    engine.add_dataset(auto())
    first = '{"code": "A", "basin": "Elbe", "height": 3.50, "sensor": [{"slot": 1}, {"slot": 2, "reading": {"at": "2026-01-01T00:00:00"}}]}'
    text = f'[{first}, {{"code": "B", "BASIN": "elbe", "sensor": {{"slot": 1}}}}, {{"basin": "Po"}}]'
    job = engine.import_file(write(tmp_path, "a.json", text), "GAUGES")
    assert (job["records_read"], job["records_rejected"], job["inserted"]) == (7, 1, 6)
    # The code of a rejected record is made too; spellings that differ in case are one code.
    assert {r.code: r.id for r in engine.code_lists.contents("Basins").collect()} == {"RHINE": 1, "ODER": 2, "Elbe": 3, "Po": 4}
    assert [(r.name, r.codes) for r in engine.code_lists.summary().collect()] == [("basins", 4)] and engine.code_lists.contents("none") is None


def test_reject_file_commits_nothing_and_retries(engine, tmp_path):
    engine.add_dataset(gauges(on_missing=Missing.REJECT_FILE))
    job = engine.import_file(write(tmp_path, "a.xml", NETWORK), "gauges")
    assert job["status"] == "Failed" and "amazon" in job["error"] and job["next_attempt"] is not None
    assert engine.table("gauges", "Gauge").isEmpty() and engine.run_next("gauges") is None
    assert [r.kind for r in engine.events(job["id"]).collect()] == ["started", "failed"]
    for _ in range(2):
        engine.run(job["id"])
    assert engine.job(job["id"])["status"] == "DeadLettered"


def test_file_faults_need_not_be_retried(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "s"), Options(retry_file_faults=False)).add_dataset(gauges())
    assert engine.import_file(write(tmp_path, "a.csv", "Code\nRH-07\n"), "gauges")["status"] == "DeadLettered"


def test_duplicate_keys_fail_or_the_last_wins(spark, engine, tmp_path):
    engine.add_dataset(auto())
    # Twelve times the same gauge, each with a sensor: the last counts by number, and all sensors are its own.
    text = ", ".join(f'{{"code": "G", "height": {i}, "sensor": {{"slot": {i}}}}}' for i in range(12))
    path = write(tmp_path, "a.json", f"[{text}]")
    assert "DuplicateKey" in engine.import_file(path, "gauges")["error"]
    lenient = Engine(spark, str(tmp_path / "other"), Options(on_duplicate_key="last_wins")).add_dataset(auto())
    job = lenient.import_file(path, "gauges")
    assert job["status"] == "Succeeded" and [int(r.Height) for r in lenient.table("gauges", "Gauge").collect()] == [11]
    assert sorted(r.Slot for r in lenient.table("gauges", "Sensor").join(lenient.table("gauges", "Gauge"), "GaugeKey").collect()) == list(range(12))


def test_custom_steps_and_warnings(engine, tmp_path):
    def surveyed(context, frames):
        df = add_issue(frames["Gauge"], F.col("val.Code") == "RH-07", "Code", "not surveyed yet")
        return frames | {"Gauge": add_issue(df, F.lit(True), None, "only a warning", severity="Warning")}

    engine.add_dataset(gauges()).add_step(Step("surveyed", surveyed)).add_step(Step("never", lambda c, f: 1 / 0, applies_to=lambda m: False))
    job = engine.import_file(write(tmp_path, "a.xml", NETWORK), "gauges")
    assert job["records_rejected"] == 11 and engine.rejections(job["id"]).where("reason = 'not surveyed yet'").count() == 1


def test_queue_runs_oldest_first_and_reclaims(engine, tmp_path):
    engine.add_dataset(gauges())
    first, second = (engine.submit(write(tmp_path, f"{i}.xml", NETWORK), "gauges") for i in "ab")
    assert engine.run_next("gauges") == first and engine.run_all() == 1 and engine.job(second)["attempt"] == 1
    engine._change(lambda df: df.withColumns({"status": F.lit("Processing"), "heartbeat": F.timestamp_seconds(F.lit(0))}))
    assert engine.reclaim() == 2 and engine.jobs(status="Pending").count() == 2


def test_lookup_providers(spark):
    entity = Entity("E", "T", fields=(Field("x", lookup=Lookup("l", value_kind=Kind.STRING)),))
    df = validate({"E": frame(spark.createDataFrame([(1, "a"), (2, " A "), (3, "b"), (4, None)], "i long, x string"), entity, F.col("i"), F.col("i"))}, Manifest("m", root=entity))["E"]
    result = lambda provider, field=entity.fields[0]: [(r.val.x, len(r.issues)) for r in looked_up(df, entity, field, provider).orderBy("root_ord").collect()]
    relation = spark.createDataFrame([("l", "a", "v"), ("l", "c", "w"), ("other", "b", "x")], "list string, code string, value string")
    assert result(RelationProvider(relation)) == [("v", 0), ("v", 0), (None, 1), (None, 0)]
    assert result(FunctionProvider(lambda name, texts: {t: name + t.lower() for t in texts if t != "b"}, "string")) == [("la", 0), ("la", 0), (None, 1), (None, 0)]
    default = replace(entity.fields[0], lookup=replace(entity.fields[0].lookup, on_missing=Missing.USE_DEFAULT, default="C"))
    assert result(RelationProvider(relation), default) == [("v", 0), ("v", 0), ("w", 0), (None, 0)]
    missing = replace(default, lookup=replace(default.lookup, default="nope"))
    assert result(RelationProvider(relation), missing)[2] == (None, 1)
    with pytest.raises(LookupRejected):
        resolve_lookups({"E": df}, Manifest("m", root=entity), {})


def test_required_children_reject_their_tree(spark):
    gauge = gauges().root
    sensor = replace(gauge.children[0], required=True, children=())
    manifest = Manifest("required", root=replace(gauge, children=(sensor,)))
    above = spark.createDataFrame([(1, "with"), (2, "without")], "i long, Code string")
    below = spark.createDataFrame([(1, "1/0", "1", "7")], "i long, r string, p string, Slot string")
    frames = {"Gauge": frame(above, manifest.root, F.col("i"), F.col("i")), "Sensor": frame(below, sensor, F.col("i"), F.col("r"), F.col("p"))}
    counts = split.counts(validate(frames, manifest))
    assert (counts.records_read, counts.records_rejected, counts.errors, counts.rejected_roots) == (3, 1, 1, 1)


KEYED = Entity("K", "K", natural_key=("k",), fields=(Field("k", type=Kind.INT32), Field("v")))


def stage(spark, rows):
    return spark.createDataFrame([(i, str(i), k, v) for i, (k, v) in enumerate(rows)], "root_ord long, rec_id string, k int, v string")


def test_merge_is_idempotent_null_safe_and_never_deletes(spark):
    empty = spark.createDataFrame([], KEYED.table_schema(False))
    first = merge(stage(spark, [(1, "a"), (None, "n"), (3, "c")]), empty, KEYED, False)
    second = merge(stage(spark, [(1, None), (None, "m")]), first.table, KEYED, False)
    assert (first.inserted, first.updated, second.inserted, second.updated) == (3, 0, 0, 2)
    assert sorted((r.Id, r.k, r.v) for r in second.table.collect()) == [(1, 1, None), (2, None, "m"), (3, 3, "c")]
    assert merge(stage(spark, []), first.table, KEYED, False).table.count() == 3
    with pytest.raises(DuplicateKey):
        merge(stage(spark, [(None, "a"), (None, "b")]), empty, KEYED, False)


def test_numbers_are_dense_over_ranges(spark, monkeypatch):
    import strata.operators.merge as m

    monkeypatch.setattr(m, "RANGE_ROWS", 10)
    found = numbered(spark.range(0, 300, 3).selectExpr("id AS root_ord", "cast(id AS string) AS rec_id"), ["root_ord", "rec_id"], 7, "n").orderBy("root_ord").collect()
    assert [r.n for r in found] == list(range(8, 108))
    # One root holds most rows: its range is dealt on.
    hot = spark.range(200).selectExpr("if(id < 150, 5, id) AS root_ord", "cast(id AS string) AS rec_id")
    assert sorted(r.n for r in numbered(hot, ["root_ord", "rec_id"], 0, "n").collect()) == list(range(1, 201))
    none = spark.range(30).selectExpr("cast(null AS long) AS root_ord", "cast(id AS string) AS rec_id")
    assert sorted(r.n for r in numbered(none, ["root_ord", "rec_id"], 0, "n").collect()) == list(range(1, 31))


def test_commits_are_atomic_and_exclusive(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    base = store.head()
    folder = store.stage("t", spark.range(3))
    assert store.names() == [] and store.table("t", "id long").isEmpty()
    store.commit(base, {"t": folder}, "job")
    assert store.table("t", "id long").count() == 3 and store.head()["jobs"] == ["job"]
    with pytest.raises(Conflict):
        store.commit(base, {"t": folder})
    # A table that no one else has changed goes on top; a changed one is made anew.
    store.commit(base, {"u": store.stage("u", spark.range(2))})
    assert store.table("t", "id long").count() == 3 and store.table("u", "id long").count() == 2
    between = [spark.range(5, 6)]

    def more(df):
        if between:
            store.put("t", df.unionByName(between.pop()))
        return df.unionByName(spark.range(9, 10))

    store.change("t", "id long", more)
    assert sorted(r.id for r in store.table("t", "id long").collect()) == [0, 1, 2, 5, 9]
    # However many imports there have been, a repeated one is known.
    for i in range(3):
        store.commit(store.head(), {}, f"more-{i}")
    assert store.head()["jobs"] == ["job", "more-0", "more-1", "more-2"]


def test_records_are_ordered_by_number(spark):
    ids = [f"0/Sensor[{i}]" for i in (0, 2, 10, 9, 100)]
    df = spark.createDataFrame([(0, x, 1) for x in ids], "root_ord long, rec_id string, k int")
    assert last_wins(df, ["k"]).first()["rec_id"] == "0/Sensor[100]"
    assert [r["rec_id"] for r in numbered(df, ["root_ord", "rec_id"], 0, "n").orderBy("n").collect()] == [f"0/Sensor[{i}]" for i in (0, 2, 9, 10, 100)]
    rows = df.select(F.lit("j").alias("job_id"), "root_ord", "rec_id", F.lit("Sensor").alias("entity"), F.lit("f").alias("field"))
    assert [r["rec_id"] for r in jobs.rejected(rows, "j", 3).collect()] == ["0/Sensor[0]", "0/Sensor[2]", "0/Sensor[9]"]


def test_a_submit_during_an_import_and_a_second_claim(engine, tmp_path):
    engine.add_dataset(gauges())
    first, more = engine.submit(write(tmp_path, "a.xml", NETWORK), "gauges"), write(tmp_path, "b.xml", NETWORK)
    merge, seen = engine._import, []

    def slow(job):
        seen.append((engine.submit(more, "gauges"), engine.run(first)))
        return merge(job)

    engine._import = slow
    assert engine.run(first) is not None and seen[0][1] is None  # the second claim gets nothing
    engine._import = merge
    assert engine.job(first)["attempt"] == 1 and engine.job(seen[0][0])["status"] == "Pending" and engine.run(first) is None
    assert engine.run_all() == 1


def test_a_long_job_tells_that_it_is_alive(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "alive"), options=Options(heartbeat_seconds=0.2)).add_dataset(gauges())
    job_id, merge = engine.submit(write(tmp_path, "a.xml", NETWORK), "gauges"), engine._import

    def slow(job):
        for _ in range(100):
            if engine.job(job["id"])["heartbeat"] > job["heartbeat"]:
                return merge(job)
            time.sleep(0.1)

    engine._import = slow
    assert engine.run(job_id) is not None and engine.job(job_id)["status"] in ("Succeeded", "CompletedWithRejections")


def test_registered_queries_have_sql_with_the_same_columns(spark):
    from strata.queries import ORACLE_SQL, QUERIES

    assert set(QUERIES) - set(ORACLE_SQL) == {"metrics_summary"}
    assert QUERIES["tree_reject_counts"](spark, "/root/testdata/sf0.001").columns == ["rejections", "bad_roots", "records_read", "records_rejected"]


def test_whole_job_tables_are_completed_and_released(spark):
    import duckdb

    from strata import queries

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf}/events.parquet')")
    for name in ("jobs_status", "jobs_status_all", "jobs_release", "jobs_release_all"):
        found = sorted(tuple(r) for r in queries.QUERIES[name](spark, sf).collect())
        assert found == sorted(con.sql(queries.ORACLE_SQL[name]).fetchall()), name
        assert len(found) == con.sql("SELECT count(*) FROM events").fetchall()[0][0] or not name.endswith("_all")
