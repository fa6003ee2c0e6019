from dataclasses import replace

import pytest
from data import gauges

from strata.catalog import Catalog, Options
from strata.errors import ManifestError, UnknownDataset
from strata.functions.formats import java_pattern
from strata.plans.ddl import create_table, statements
from strata.plans.manifest import Entity, Field, Kind, Lookup, Manifest, Missing, dumps, loads


def changed(**root):
    m = gauges()
    return replace(m, root=replace(m.root, **root))


def has(manifest, text):
    return any(text in p for p in manifest.problems())


def test_a_good_manifest_has_no_problems_and_survives_a_round_trip():
    assert not gauges().problems()
    assert loads(dumps(gauges())) == gauges()


def test_comments_trailing_commas_and_any_case_are_read():
    m = loads('{ // a comment\n "NAME": "x, /* no comment */ }", /* one */ "root": {"Name": "R", "table": "T", "fields": [{"name": "a", "Type": "INT32",},],},}')
    assert m.name == "x, /* no comment */ }" and m.root.fields[0].type is Kind.INT32 and m.queue_name == m.name


@pytest.mark.parametrize(
    ("manifest", "text"),
    [
        (Manifest("x"), "root"), (replace(gauges(), name=" "), "name"), (changed(table=""), "table"), (changed(key_column=""), "keyColumn"),
        (changed(fields=()), "at least one field"), (changed(natural_key=("Nope",)), "Nope"),
        (changed(children=(Entity("gauge", "T", parent_key_column="p", fields=(Field("a"),)),)), "called gauge"),
        (changed(children=(Entity("C", "T", fields=(Field("a"),)),)), "parentKeyColumn"),
        (changed(children=(Entity("C", "T", parent_key_column="p", fields=(Field("p"),)),)), "collides with parentKeyColumn"),
        (changed(fields=(Field("Code"), Field("CODE"))), "field is called"), (changed(fields=(Field("Code"), Field("b", column="Code"))), "column is called"),
        (changed(fields=(Field("Code"), Field("GaugeKey"))), "collides with keyColumn"), (changed(fields=(Field("Code"), Field(""))), "no name"),
        (changed(fields=(Field("Code", lookup=Lookup("")),)), "needs a list"), (changed(fields=(Field("Code", lookup=Lookup("l", on_missing=Missing.USE_DEFAULT)),)), "lookup.default"),
        (changed(fields=(Field("Code"), Field("d", type=Kind.DECIMAL, precision=40))), "precision"), (changed(fields=(Field("Code"), Field("d", type=Kind.DECIMAL, precision=5, scale=10))), "scale"),
        (changed(fields=(Field("Code"), Field("s", max_length=5000))), "maxLength"), (changed(fields=(Field("Code", max_length=1000),)), "850"),
        (changed(fields=(Field("Code"), Field("d", type=Kind.DATE, format="yyyy-QQ"))), "not supported"),
    ],
)
def test_each_rule_is_reported(manifest, text):
    assert has(manifest, text), manifest.problems()


def test_all_problems_are_reported_at_once():
    with pytest.raises(ManifestError) as e:
        loads('{"name": "x", "root": {"name": "R", "table": "", "fields": []}}')
    assert len(e.value.problems) == 2


@pytest.mark.parametrize("text", ["{", "[]", '{"name": 1}', '{"root": {"fields": {}}}', '{"root": {"fields": [{"name": "a", "type": "text"}]}}'])
def test_what_is_no_manifest_is_a_manifest_error(text):
    with pytest.raises(ManifestError):
        loads(text)


def test_entities_are_listed_level_by_level():
    deep = changed(children=(Entity("A", "A", parent_key_column="p", fields=(Field("x"),), children=(Entity("C", "C", parent_key_column="p", fields=(Field("x"),)),)), Entity("B", "B", parent_key_column="p", fields=(Field("x"),))))
    assert [e.name for e, _ in deep.entities()] == ["Gauge", "A", "B", "C"]
    assert deep.entity("c").name == "C"


def test_formats_are_translated():
    assert java_pattern("yyyy-MM-dd'T'HH:mm:ss.fff") == "yyyy-MM-dd'T'HH:mm:ss.SSS"
    assert java_pattern("dd.MM.yy hh:mm tt") == "dd.MM.yy hh:mm a"
    for bad in ("d", "yyyy-QQ", "yyyy'"):
        with pytest.raises(ValueError):
            java_pattern(bad)


def test_job_scope_follows_keys_and_policies():
    assert not gauges().job_scoped()
    assert gauges(on_missing=Missing.AUTO_CREATE).job_scoped() and changed(natural_key=()).job_scoped()


def test_ddl_names_keys_and_types(spark):
    gauge, sensor, reading = statements(gauges())[1:]
    assert "`BasinId` INT" in gauge and "`Height` DECIMAL(9,3)" in gauge and "`Code` STRING NOT NULL" in gauge
    assert "'strata.foreign_key' = 'GaugeKey -> hydro.Gauges.GaugeKey'" in sensor and "'strata.unique' = 'SensorKey, At'" in reading
    assert "`Gau``ges`" in create_table(replace(gauges().root, table="Gau`ges"), None)
    for s in statements(gauges()):
        spark.sql(s)
    assert spark.table("hydro.Readings").columns == ["ReadingKey", "SensorKey", "At", "Level", "Flag"]
    spark.sql("DROP DATABASE hydro CASCADE")


def test_catalog_keeps_manifests_and_leaves_bad_ones_out(tmp_path):
    catalog = Catalog(str(tmp_path))
    catalog.put(dumps(gauges()), "GAUGES")
    (tmp_path / "bad.json").write_text("{")
    again = Catalog(str(tmp_path))
    assert [m.name for m in again.all()] == ["gauges"] and again.get("Gauges") == gauges() and again.summaries()[0]["entities"] == ["Gauge", "Sensor", "Reading"]
    with pytest.raises(ManifestError):
        again.put(gauges(), "other")
    assert again.remove("GAUGES") and not again.remove("gauges")
    with pytest.raises(UnknownDataset):
        Catalog(str(tmp_path)).get("gauges")


def test_options_are_checked():
    for bad in ({"poll_seconds": 0}, {"abandoned_after_seconds": 60}, {"on_duplicate_key": "x"}):
        with pytest.raises(ValueError):
            Options(**bad)
