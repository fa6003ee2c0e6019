"""The accept/reject split: one error anywhere in a tree rejects the whole root tree."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.frames import Frames, has_errors, location
from strata.plans.manifest import Manifest

#: Most characters of a rejection's field, location and reason or raw value; fixed values of the table.
FIELD, PLACE, TEXT = 200, 400, 2000


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def bad_roots(frames: Frames) -> DataFrame:
    return _union([df.where(has_errors()).select("root_ord") for df in frames.values()]).distinct()


def rejections(frames: Frames, manifest: Manifest) -> DataFrame:
    """One row an error: entity, root_ord, rec_id, line, path, field, reason, raw_value. Warnings are left out."""
    parts = []
    for entity, _ in manifest.entities():
        raw = F.coalesce(F.col("i.raw_value"), F.coalesce(*[F.when(F.col("i.field") == f.name, F.col(f"raw.`{f.name}`")) for f in entity.fields]))
        errors = F.filter("issues", lambda i: i["severity"] == "Error")
        parts.append(
            frames[entity.name].where(has_errors()).withColumn("i", F.explode(errors)).select(
                F.lit(entity.name).alias("entity"), "root_ord", "rec_id", "line", "path", F.substring(location(), 1, PLACE).alias("location"),
                F.substring("i.field", 1, FIELD).alias("field"), F.substring("i.message", 1, TEXT).alias("reason"), F.substring(raw, 1, TEXT).alias("raw_value"),
            )
        )
    return _union(parts)


def accepted(frames: Frames, bad: DataFrame) -> Frames:
    return {name: df.join(bad, "root_ord", "left_anti") for name, df in frames.items()}


@dataclass(frozen=True)
class Counts:
    """records_read: all records of all trees; records_rejected: those of rejected trees; errors: their faults."""

    records_read: int
    records_rejected: int
    errors: int
    rejected_roots: int


def tree_sizes(frames: Frames) -> DataFrame:
    """root_ord, records, errors of every tree. Partial sums are made before the shuffle."""
    errors = F.size(F.filter("issues", lambda i: i["severity"] == "Error"))
    rows = _union([df.select("root_ord", errors.alias("errors")) for df in frames.values()])
    return rows.groupBy("root_ord").agg(F.count("*").alias("records"), F.sum("errors").alias("errors"))


def counts_frame(frames: Frames) -> DataFrame:
    bad = F.col("errors") > 0
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return tree_sizes(frames).agg(
        zero(F.sum("errors")).alias("rejections"), zero(F.sum(F.when(bad, 1).otherwise(0).cast("long"))).alias("bad_roots"),
        zero(F.sum("records")).alias("records_read"), zero(F.sum(F.when(bad, F.col("records")).otherwise(0))).alias("records_rejected"),
    )


def counts(frames: Frames) -> Counts:
    row = counts_frame(frames).first()
    return Counts(row["records_read"], row["records_rejected"], row["rejections"], row["bad_roots"])
