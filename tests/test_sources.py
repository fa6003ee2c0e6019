"""Readers against plain models: Python's own csv module, and trees that are written out and read again."""

import csv as plain
import io
import random
import zipfile
from dataclasses import replace

import pytest
from data import NETWORK, gauges, soils
from pyspark.sql import functions as F

from strata.errors import SourceError
from strata.frames import has_errors, no_issues
from strata.plans.manifest import CsvOptions, Entity, Field, JsonOptions, Manifest, Source, SourceOptions, XmlOptions
from strata.sources import csv, json, xml
from strata.sources.files import allowed_format, infer_format
from strata.sources.reader import fast_xml, linked, read


def parsed(text, delimiter=","):
    # Every split into two pieces must give the same.
    whole = list(csv.rows([text], delimiter))
    assert all(list(csv.rows([text[:i], text[i:]], delimiter)) == whole for i in range(len(text)))
    return whole


@pytest.mark.parametrize("delimiter", [",", ";", "\t", "|"])
def test_csv_is_read_as_it_was_written(delimiter):
    draw = random.Random(delimiter)
    for _ in range(60):
        out, expected, line = io.StringIO(), [], 1
        end = draw.choice(["\n", "\r\n"])
        write = plain.writer(out, delimiter=delimiter, lineterminator=end, quoting=draw.choice([plain.QUOTE_MINIMAL, plain.QUOTE_ALL]))
        for _ in range(draw.randint(1, 6)):
            if draw.random() < 0.2:
                out.write(end)
                line += 1
            fields = ["".join(draw.choice(f'xyü "\n{delimiter}') for _ in range(draw.randint(0, 5))) for _ in range(draw.randint(1, 4))]
            write.writerow(fields)
            expected.append((line, fields))
            line += 1 + sum(f.count("\n") for f in fields)
        text = out.getvalue()
        assert parsed(text if draw.random() < 0.5 else text.removesuffix(end), delimiter) == expected, text


def test_csv_that_no_writer_makes():
    # A quote within a field is a character; what follows a closing quote is kept; an open quote runs to the end.
    assert parsed('5" pipe,6') == [(1, ['5" pipe', "6"])]
    assert parsed('"deep"er,well') == [(1, ["deeper", "well"])]
    assert parsed('dry,"wet\n\nand more') == [(1, ["dry", "wet\n\nand more"])]
    # Any line end ends a row, and is LF within a field.
    assert parsed('clay\rsand\r\n"silt\rloam"\n\r') == [(1, ["clay"]), (2, ["sand"]), (3, ["silt\nloam"])]
    assert parsed("") == [] and parsed("\n\r\n") == []


def records(module, text, manifest):
    return list(module.records(io.BytesIO(text if isinstance(text, bytes) else text.encode()), manifest))


def test_xml_records_have_lines_paths_and_children():
    found = records(xml, NETWORK, gauges())
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in found] == [
        ("Gauge", 0, "0", None, 3), ("Sensor", 0, "0/Sensor[0]", "0", 5), ("Reading", 0, "0/Sensor[0]/Reading[0]", "0/Sensor[0]", 6), ("Reading", 0, "0/Sensor[0]/Reading[1]", "0/Sensor[0]", 7),
        ("Sensor", 0, "0/Sensor[1]", "0", 9), ("Gauge", 1, "1", None, 11), ("Sensor", 1, "1/Sensor[0]", "1", 12), ("Gauge", 2, "2", None, 13), ("Gauge", 3, "3", None, 14),
        ("Sensor", 3, "3/Sensor[0]", "3", 15), ("Reading", 3, "3/Sensor[0]/Reading[0]", "3/Sensor[0]", 15),
    ]
    assert found[3][5:7] == ("Network/Gauge/Sensor/Reading", {"at": "2026-03-01 06:15", "level": "1.5", "flag": "checked"})


def test_xml_scoping_attributes_namespaces_and_skipping():
    m = soils()
    survey = replace(m, source=SourceOptions(xml=XmlOptions("Survey")))
    text = "<All><Sample><Plot>outside</Plot></Sample><Survey><sample><PLOT>p1</PLOT></sample></Survey><Trash/><Survey><Sample/></Survey></All>"
    assert [r[6] for r in records(xml, text, survey)] == [{"plot": "p1"}, {}]
    by_attribute = replace(m, root=replace(m.root, fields=(Field("Plot", source=Source.ATTRIBUTE), *m.root.fields[1:])))
    text = '<s:Sample xmlns:s="urn:soil" Plot="p2" Acid="7"><Lab><Plot>unknown here</Plot><Acid/></Lab><Depth>10</Depth><Depth>20</Depth></s:Sample>'
    assert records(xml, text, by_attribute)[0][6] == {"plot": "p2", "depth": "20"}


@pytest.mark.parametrize("text", ["<Sample><Plot>p<i>1</i></Plot></Sample>", "<Sample><Plot>", "<Sample></Plot>", " ", '<!DOCTYPE s [<!ENTITY plot "p">]><Sample/>'])
def test_xml_faults_of_the_file(text):
    with pytest.raises(SourceError):
        records(xml, text, soils())


def test_json_records():
    sensor = '{"MODEL": false, "reading": [{"level": 2e-1}, "no record", {"level": 0.10}]}'
    text = f'﻿ ["no record", {{"code": "RH-07", "height": 7.250, "basin": null, "opened": [{{"year": 1987}}], "unknown": 1, "sensor": {sensor}}}, 3, {{"Code": "first", "CODE": "last"}}]'
    found = records(json, text, gauges())
    assert [(r[0], r[1], r[2], r[5]) for r in found] == [
        ("Gauge", 1, "1", "$[1]"), ("Sensor", 1, "1/Sensor[0]", "$[1].sensor"), ("Reading", 1, "1/Sensor[0]/Reading[0]", "$[1].sensor.reading[0]"),
        ("Reading", 1, "1/Sensor[0]/Reading[1]", "$[1].sensor.reading[2]"), ("Gauge", 3, "3", "$[3]"),
    ]
    assert found[0][6] == {"code": "RH-07", "height": "7.250", "basin": None, "opened": '[{"year": 1987}]'}
    assert [r[6] for r in found[1:]] == [{"model": "false"}, {"level": "2e-1"}, {"level": "0.10"}, {"code": found[4][6]["code"]}] and found[4][6]["code"] in ("first", "last")


def test_json_is_read_in_pieces():
    big = "[" + ",\n".join('{"plot": "%s", "depth": %d}' % ("ü" * 5000, i) for i in range(60)) + "]"
    assert [r[6]["depth"] for r in records(json, big, soils())] == [str(i) for i in range(60)]
    assert records(json, "[" + "\n" * 70000 + "]", soils()) == []


def test_json_wrapped():
    named = replace(soils(), source=SourceOptions(json=JsonOptions("taken")))
    assert [r[6] for r in records(json, '{"sample": [{}], "TAKEN": [{"plot": "a"}, {"plot": "b"}]}', named)] == [{"plot": "a"}, {"plot": "b"}]
    assert [r[6] for r in records(json, '{"by": {"sample": 1}, "sample": [{"plot": "c"}]}', soils())] == [{"plot": "c"}]


@pytest.mark.parametrize("text", ["", "\n", "1.5", "true", "{}", '{"sample": 1}', "[{", '[{"plot": ]', "[[] {}]", "[{}], 1", '[{"plot": "a"},', "[nul]"])
def test_json_faults_of_the_file(text):
    with pytest.raises(SourceError):
        records(json, text, soils())


def frames(spark, path, manifest, **options):
    return {k: v.orderBy("root_ord", "rec_id").collect() for k, v in read(spark, str(path), manifest, **options).items()}


def test_flat_csv_and_ragged_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('unknown,DEPTH, plot ,acid\n?,10,p1,6.5\n\n?,"20",p2\n?,30,p3,7,8\n')
    rows = frames(spark, tmp_path / "a.csv", soils())["Sample"]
    assert [(r.raw.Plot, r.raw.Depth, r.raw.Place, r.raw.Acid, r.line, bool(r.issues)) for r in rows] == [("p1", "10", None, "6.5", 2, False), ("p2", "20", None, None, 4, True), ("p3", "30", None, "7", 5, True)]
    lenient = replace(soils(), source=SourceOptions(csv=CsvOptions(allow_ragged_rows=True)))
    assert not any(r.issues for r in frames(spark, tmp_path / "a.csv", lenient)["Sample"])


def test_csv_without_header_and_encodings(spark, tmp_path):
    of = lambda encoding: replace(soils(), source=SourceOptions(csv=CsvOptions(has_header_row=False, delimiter="|", encoding=encoding)))
    row = "p1|10|Łódź|5\n"
    # A byte order mark wins over what is configured.
    for i, (encoding, content) in enumerate([("iso-8859-2", row.encode("iso-8859-2")), ("cp1250", row.encode("cp1250")), ("iso-8859-2", row.encode("utf-8-sig")), ("utf-8", row.encode("utf-16"))]):
        (tmp_path / f"{i}.csv").write_bytes(content)
        assert frames(spark, tmp_path / f"{i}.csv", of(encoding))["Sample"][0].raw.Place == "Łódź", encoding
    with pytest.raises(Exception, match="morse"):
        frames(spark, tmp_path / "0.csv", of("morse"))


def zipped(path, **tables):
    """tables: by member, lists of rows."""
    with zipfile.ZipFile(path, "w") as z:
        for name, rows in tables.items():
            out = io.StringIO()
            plain.writer(out).writerows(rows)
            z.writestr(f"{name}.csv", out.getvalue())
    return path


def test_archives_are_linked_as_a_walk_over_their_rows_does(spark, tmp_path):
    draw = random.Random(5)
    gauge = [(f"g{draw.randrange(12)}", f"C{i}") for i in range(14)]
    sensor = [(f"s{draw.randrange(25)}", f"g{draw.randrange(16)}", str(i)) for i in range(30)]
    reading = [(f"s{draw.randrange(30)}", f"2026-01-01 00:00:{i:02}") for i in range(50)]
    path = zipped(tmp_path / "a.zip", Gauge=[("_key", "Code"), *gauge], Sensor=[("_key", "_parentKey", "Slot"), *sensor], Reading=[("_parentKey", "At"), *reading])
    # The first row of a key owns its children; an orphan is a root of its own and keeps what is below it.
    first = lambda rows: {r[0]: i for i, r in reversed(list(enumerate(rows)))}
    gauges_by, sensors_by = first(gauge), first(sensor)
    ids = [f"{gauges_by[g]}/Sensor[{i}]" if g in gauges_by else f"?/Sensor[{i}]" for i, (_, g, _) in enumerate(sensor)]
    expected = {
        "Gauge": {(c, str(i), None, gauges_by[k] != i) for i, (k, c) in enumerate(gauge)},
        "Sensor": {(slot, ids[i], str(gauges_by[g]) if g in gauges_by else None, g not in gauges_by or sensors_by[k] != i) for i, (k, g, slot) in enumerate(sensor)},
        "Reading": {(at, f"{ids[sensors_by[s]] if s in sensors_by else '?'}/Reading[{i}]", ids[sensors_by[s]] if s in sensors_by else None, s not in sensors_by) for i, (s, at) in enumerate(reading)},
    }
    found = frames(spark, path, gauges())
    for name, column in (("Gauge", "Code"), ("Sensor", "Slot"), ("Reading", "At")):
        assert {(r.raw[column], r.rec_id, r.parent_rec_id, bool(r.issues)) for r in found[name]} == expected[name], name
    roots = {r.rec_id: r.root_ord for r in found["Sensor"]}
    assert all((r.root_ord < 0) == r.rec_id.startswith("?") for name in ("Sensor", "Reading") for r in found[name])
    assert all(r.root_ord == roots[r.parent_rec_id] for r in found["Reading"] if r.parent_rec_id)
    lost = [r.root_ord for name in ("Sensor", "Reading") for r in found[name] if not r.parent_rec_id]
    assert len(lost) == len(set(lost)) > 0


def test_rows_without_keys_are_parents_of_nothing(spark):
    manifest = Manifest("two", root=Entity("A", "A", fields=(Field("x"),), children=(Entity("B", "B", parent_key_column="a", fields=(Field("x"),)),)))
    raw, none = F.create_map(F.lit("x"), F.col("id").cast("string")), no_issues()
    table = lambda n, key, parent: spark.range(n).select(F.col("id").alias("ord"), F.col("id").alias("line"), raw.alias("raw"), key.cast("string").alias("key"), parent.cast("string").alias("parent_key"), none.alias("issues"))
    found = linked({"A": table(300, F.lit(None), F.lit(None)), "B": table(3, F.lit(None), F.lit(None))}, manifest)
    assert found["A"].where(has_errors()).count() == 0 and found["A"].count() == 300 and found["B"].where(has_errors()).count() == 3


def test_archive_faults_of_the_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Code\nRH-07\n")
    with pytest.raises(SourceError):
        read(spark, str(tmp_path / "a.csv"), gauges())
    with pytest.raises(SourceError):
        read(spark, str(zipped(tmp_path / "h.zip", Gauge=[("RH-07",)])), replace(gauges(), source=SourceOptions(csv=CsvOptions(has_header_row=False))))
    with pytest.raises(Exception, match="no Gauge.csv"):
        frames(spark, zipped(tmp_path / "m.zip", Sensor=[("_key",)]), gauges())


def test_parquet_and_fast_xml(spark, tmp_path):
    spark.createDataFrame([("p1", 6.5, "more")], "PLOT string, acid double, other string").write.parquet(str(tmp_path / "p.parquet"))
    row = read(spark, str(tmp_path / "p.parquet"), soils())["Sample"].first()
    assert (row.raw.Plot, row.raw.Acid, row.raw.Depth) == ("p1", "6.5", None)
    (tmp_path / "a.xml").write_text(NETWORK)
    found = fast_xml(spark, str(tmp_path / "a.xml"), gauges())
    assert {k: v.count() for k, v in found.items()} == {"Gauge": 4, "Sensor": 4, "Reading": 3}
    assert sorted(r.raw.Code for r in found["Gauge"].collect()) == ["OD-03", "OD-04", "RH-07", "XX-01"]


def test_formats():
    assert infer_format("soil/2026.JSON") == "json" and infer_format("drop.zip") == "csv" and infer_format("no-extension", "Xml") == "xml"
    with pytest.raises(SourceError):
        infer_format("soil.docx")
    with pytest.raises(SourceError):
        allowed_format("soil.xml", replace(soils(), source=SourceOptions(formats=("csv", "json"))))
