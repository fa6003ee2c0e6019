"""A Python data source that reads files of a dataset, one partition a file, and the frames made of it.

Files are parsed as streams on the executors. Formats whose lines or raw number texts must be known (XML, JSON, CSV)
have parsers here; Parquet is read by Spark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strata.errors import SourceError
from strata.frames import Frames, frame, from_records, issue, no_issues
from strata.plans.manifest import Entity, Manifest, dumps, loads
from strata.sources import csv, json, xml
from strata.sources.files import allowed_format, open_bytes

RECORD = "entity string, root_ord long, rec_id string, parent_rec_id string, line long, path string, raw map<string,string>, fault string"
ROW = "ord long, line long, raw map<string,string>, key string, parent_key string, fault string"


class RecordSource(DataSource):
    """Options: path, kind (xml, json, csv, archive), manifest (JSON), entity (for an archive)."""

    @classmethod
    def name(cls) -> str:
        return "strata_records"

    def schema(self) -> str:
        return ROW if self.options["kind"] == "archive" else RECORD

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self):
        return [InputPartition(self.options["path"])]

    def read(self, partition: InputPartition):
        manifest, kind = loads(self.options["manifest"]), self.options["kind"]
        with open_bytes(partition.value) as stream:
            if kind == "archive":
                yield from csv.archive_rows(stream, manifest.entity(self.options["entity"]), manifest)
            else:
                yield from {"xml": xml.records, "json": json.records, "csv": csv.flat_records}[kind](stream, manifest)


def _load(spark: SparkSession, path: str, manifest: Manifest, kind: str, entity: Entity | None = None) -> DataFrame:
    spark.dataSource.register(RecordSource)
    reader = spark.read.format("strata_records").option("path", path).option("kind", kind).option("manifest", dumps(manifest))
    return (reader.option("entity", entity.name) if entity else reader).load()


def _faults(df: DataFrame) -> DataFrame:
    fault = F.when(F.col("fault").isNotNull(), F.array(issue(None, F.col("fault")))).otherwise(no_issues())
    return df.withColumn("issues", fault).drop("fault")


def linked(tables: Frames, manifest: Manifest) -> Frames:
    """Frames of an archive's tables (ord, line, raw, key, parent_key, issues).

    Children are joined to the first parent with their key; a later row with the same key is at fault, as is a row
    whose parent is not there. Such a row is a root of its own, so only its own tree is rejected.
    """
    records, parents, base = None, None, 0
    keys: dict[str, DataFrame] = {}
    for depth, (entity, parent) in enumerate(manifest.entities()):
        rows = tables[entity.name].withColumn("entity", F.lit(entity.name))
        # Rows without a key have a window each, so that a file without keys is not one window.
        window = Window.partitionBy("key", F.when(F.col("key").isNull(), F.col("ord"))).orderBy("ord")
        first = F.col("key").isNull() | (F.row_number().over(window) == 1)
        rows = rows.withColumn("__first", first if entity.children else F.lit(True))
        twice = F.when(~F.col("__first"), F.array(issue(manifest.source.csv.key_column, F.concat(F.lit("key "), F.col("key"), F.lit(" occurs twice")), F.col("key")))).otherwise(no_issues())
        rows = rows.withColumn("issues", F.concat("issues", twice))
        own = F.col("ord")
        if parent is None:
            rows = rows.withColumns({"root_ord": own.cast("long"), "rec_id": own.cast("string"), "parent_rec_id": F.lit(None).cast("string")})
        else:
            there = keys[parent.name]
            rows = rows.join(there, F.col("parent_key") == F.col("__key"), "left")
            lost = F.when(F.col("__rec").isNull(), F.array(issue(manifest.source.csv.parent_key_column, F.concat(F.lit("no "), F.lit(parent.name), F.lit(" has the key "), F.coalesce("parent_key", F.lit("(none)"))), F.col("parent_key")))).otherwise(no_issues())
            # Orphans get root numbers below zero, of their own.
            orphan = -(own.cast("long") * 1000 + depth) - 1
            rows = rows.withColumns({
                "issues": F.concat("issues", lost), "root_ord": F.coalesce("__root", orphan),
                "rec_id": F.concat(F.coalesce("__rec", F.lit("?")), F.lit(f"/{entity.name}["), own.cast("string"), F.lit("]")), "parent_rec_id": F.col("__rec"),
            }).drop("__key", "__rec", "__root")
        if entity.children:
            keys[entity.name] = rows.where(F.col("__first") & F.col("key").isNotNull()).select(F.col("key").alias("__key"), F.col("rec_id").alias("__rec"), F.col("root_ord").alias("__root"))
        rows = rows.select("entity", "root_ord", "rec_id", "parent_rec_id", "line", F.lit(None).cast("string").alias("path"), "raw", "issues")
        records = rows if records is None else records.unionByName(rows)
    return from_records(records, manifest)


def read(spark: SparkSession, path: str, manifest: Manifest, format: str | None = None, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> Frames:
    """Raw frames of a file. ``cut`` (a checkpoint) keeps the parsed rows, which several plans read."""
    kind = allowed_format(path, manifest, format)
    if kind == "parquet":
        return {manifest.root.name: parquet_frame(spark, path, manifest)}
    if kind == "csv":
        with open_bytes(path) as stream:
            archive = csv.check_shape(stream.read(4), manifest)
        if archive and manifest.root.children:
            return linked({e.name: cut(_faults(_load(spark, path, manifest, "archive", e))) for e, _ in manifest.entities()}, manifest)
        if archive:
            rows = _faults(_load(spark, path, manifest, "archive", manifest.root))
            rows = rows.select(F.lit(manifest.root.name).alias("entity"), F.col("ord").alias("root_ord"), F.col("ord").cast("string").alias("rec_id"), F.lit(None).cast("string").alias("parent_rec_id"), "line", F.lit(None).cast("string").alias("path"), "raw", "issues")
            return from_records(cut(rows), manifest)
    return from_records(cut(_faults(_load(spark, path, manifest, kind))), manifest)


def read_texts(texts: DataFrame, manifest: Manifest, kind: str) -> Frames:
    """Frames of files that are held as rows (id long, text): root_ord is id x 2^20 + the place in the text, so roots
    keep their order. A text that cannot be read fails the query, as a file would."""
    manifest_text = dumps(manifest)

    def run(batches):
        import io

        import pandas as pd

        known, parse = loads(manifest_text), {"xml": xml.records, "json": json.records, "csv": csv.flat_records}[kind]
        for batch in batches:
            rows = []
            for number, text in zip(batch["id"], batch["text"], strict=True):
                for entity, root, rec, parent, line, path, raw, fault in parse(io.BytesIO(text.encode()), known):
                    rows.append((entity, (int(number) << 20) + root, f"{number}:{rec}", parent and f"{number}:{parent}", line, path, raw, fault))
            out = pd.DataFrame(rows, columns=["entity", "root_ord", "rec_id", "parent_rec_id", "line", "path", "raw", "fault"])
            yield out.astype({"root_ord": "int64", "line": "Int64"})

    return from_records(_faults(texts.select("id", "text").mapInPandas(run, RECORD)), manifest)


def parquet_frame(spark: SparkSession, path: str, manifest: Manifest) -> DataFrame:
    """Parquet files of a dataset without children; only declared columns are read."""
    if manifest.root.children:
        raise SourceError("a Parquet file holds a dataset without child entities")
    rows = spark.read.parquet(path)
    place = F.monotonically_increasing_id()
    return frame(rows, manifest.root, place, place.cast("string"))


def fast_xml(spark: SparkSession, path: str, manifest: Manifest) -> Frames:
    """Large XML files, split by Spark's own reader: no line numbers, and row tags are case-sensitive."""
    from pyspark.sql import types as T

    def struct(entity: Entity) -> T.StructType:
        fields = [T.StructField(("_" if f.source.value == "attribute" else "") + f.name, T.StringType()) for f in entity.fields if f.source.value != "constant"]
        return T.StructType(fields + [T.StructField(c.name, T.ArrayType(struct(c))) for c in entity.children])

    rows = spark.read.format("xml").option("rowTag", manifest.root.name).option("mode", "FAILFAST").schema(struct(manifest.root)).load(path)
    rows = rows.select(F.monotonically_increasing_id().alias("root_ord"), F.struct(*rows.columns).alias("r"))
    rows = rows.withColumn("rec_id", F.col("root_ord").cast("string")).withColumn("parent_rec_id", F.lit(None).cast("string"))
    out: Frames = {}

    def walk(df: DataFrame, entity: Entity):
        raw = [F.coalesce(*[F.col(f"r.`{c}`") for c in df.schema["r"].dataType.names if c.lstrip("_").lower() == f.name.lower()] or [F.lit(None).cast("string")]).alias(f.name) for f in entity.fields]
        out[entity.name] = df.select("root_ord", "rec_id", "parent_rec_id", F.lit(None).cast("long").alias("line"), F.lit(None).cast("string").alias("path"), F.struct(*raw).alias("raw"), no_issues().alias("issues"))
        for child in entity.children:
            below = df.select("root_ord", F.col("rec_id").alias("parent_rec_id"), F.posexplode(F.col(f"r.`{child.name}`")).alias("n", "r"))
            walk(below.withColumn("rec_id", F.concat("parent_rec_id", F.lit(f"/{child.name}["), F.col("n").cast("string"), F.lit("]"))).drop("n"), child)

    walk(rows, manifest.root)
    return out
