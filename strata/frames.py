"""Frames: one flat DataFrame an entity.

Columns: root_ord (place of the root in its source), rec_id and parent_rec_id (unique in a job), line, path, raw (struct
of the fields' source strings), issues; after validation also val (struct of typed values by target column).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.plans.manifest import Entity, Manifest

ISSUES = "array<struct<severity:string,field:string,message:string,raw_value:string>>"
IDENTITY = ("root_ord", "rec_id", "parent_rec_id", "line", "path")
Frames = dict[str, DataFrame]


def no_issues() -> Column:
    return F.array().cast(ISSUES)


def issue(field: str | None, message: Column, raw: Column | None = None, severity: str = "Error") -> Column:
    return F.struct(
        F.lit(severity).alias("severity"), F.lit(field).cast("string").alias("field"), message.cast("string").alias("message"),
        (raw if raw is not None else F.lit(None)).cast("string").alias("raw_value"),
    )


def record_order(rec_id: Column) -> Column:
    """A text that sorts records of one entity by place: numbers in a rec_id are filled up to 19 digits."""
    return F.regexp_replace(F.regexp_replace(rec_id, r"(\d+)", "0" * 18 + "$1"), r"\d*(\d{19})", "$1")


def add_issue(df: DataFrame, when: Column, field: str | None, message: str, raw: Column | None = None, severity: str = "Error") -> DataFrame:
    """For custom steps. Warnings neither reject a record nor reach the rejection table."""
    added = F.array_append("issues", issue(field, F.lit(message), raw, severity))
    return df.withColumn("issues", F.when(when, added).otherwise(F.col("issues")))


def has_errors() -> Column:
    return F.exists("issues", lambda i: i["severity"] == "Error")


def frame(
    df: DataFrame, entity: Entity, root_ord: Column, rec_id: Column, parent_rec_id: Column | None = None, line: Column | None = None, path: Column | None = None, issues: Column | None = None
) -> DataFrame:
    """A raw frame of a table whose columns are named like the fields, whatever the case; other columns are left
    out, absent ones are null."""
    by_name = {c.lower(): c for c in df.columns}
    raw = [(F.col(f"`{by_name[f.name.lower()]}`") if f.name.lower() in by_name else F.lit(None)).cast("string").alias(f.name) for f in entity.fields]
    return df.select(
        root_ord.cast("long").alias("root_ord"), rec_id.cast("string").alias("rec_id"),
        (parent_rec_id if parent_rec_id is not None else F.lit(None)).cast("string").alias("parent_rec_id"),
        (line if line is not None else F.lit(None)).cast("long").alias("line"),
        (path if path is not None else F.lit(None)).cast("string").alias("path"),
        F.struct(*raw).alias("raw"), (issues if issues is not None else no_issues()).alias("issues"),
    )


def from_records(records: DataFrame, manifest: Manifest) -> Frames:
    """Frames of a reader's rows: entity, identity columns, raw as a map with lower-case keys, issues."""
    out = {}
    for entity, _ in manifest.entities():
        raw = F.struct(*[F.try_element_at("raw", F.lit(f.name.lower())).alias(f.name) for f in entity.fields])
        out[entity.name] = records.where(F.col("entity") == entity.name).select(*IDENTITY, raw.alias("raw"), "issues")
    return out


def location() -> Column:
    """Line and path as text, as far as known."""
    return F.concat_ws(" ", F.concat(F.lit("line "), F.col("line").cast("string")), F.col("path"))
