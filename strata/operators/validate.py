"""Validation: raw strings to typed values and issues, one expression chain a field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.frames import Frames, issue
from strata.functions.convert import filled, finished, parsed
from strata.plans.manifest import KEY_LENGTH, Entity, Field, Kind, Manifest, Source


def raw_of(field: Field):
    """The captured text; of a constant field, its default."""
    return F.lit(field.default).cast("string") if field.source is Source.CONSTANT else F.col(f"raw.`{field.name}`")


def validate_entity(df: DataFrame, entity: Entity) -> DataFrame:
    """Adds val: typed values, and for a lookup field the text to look up; appends at most one issue a field.

    Texts are trimmed in one projection and parsed in the next, so each is done once however often it is used.
    """
    keys = {f.name for f in entity.key_fields()}
    plain = [(i, f) for i, f in enumerate(entity.fields) if not f.lookup]
    df = df.withColumns({f"__t{i}": filled(raw_of(f), f.default) for i, f in enumerate(entity.fields)})
    made = {i: parsed(F.col(f"__t{i}"), f.type, f.format, f.precision, f.scale) for i, f in plain}
    df = df.withColumns({f"__v{i}": value for i, (value, _) in made.items()})
    # Of a decimal the form counts: a value may be null because it is too wide. Of others the value tells.
    fits = {i: made[i][1] if f.type in (Kind.DECIMAL, Kind.STRING) else F.col(f"__v{i}").isNotNull() for i, f in plain}
    values, faults = [], []
    for i, field in enumerate(entity.fields):
        raw = raw_of(field)
        if field.lookup:
            values.append(F.col(f"__t{i}").alias(field.target))
            # A lookup's own default stands in for unknown values, not for missing ones.
            fault = F.when(F.col(f"__t{i}").isNull(), F.lit("a value is required")) if field.required else None
        else:
            value, fault = finished(F.col(f"__t{i}"), F.col(f"__v{i}"), fits[i], field, field.name in keys, KEY_LENGTH)
            values.append(value.alias(field.target))
            if field.type is Kind.STRING and not field.required and not field.max_length and field.name not in keys:
                fault = None
        if fault is not None:
            faults.append(F.when(fault.isNotNull(), issue(field.name, fault, raw)))
    if faults:
        df = df.withColumn("__f", F.array(*faults))
        found = F.when(F.exists("__f", lambda i: i.isNotNull()), F.concat("issues", F.filter("__f", lambda i: i.isNotNull()))).otherwise(F.col("issues"))
        df = df.withColumn("issues", found)
    return df.withColumn("val", F.struct(*values)).drop("__f", *[f"__{k}{i}" for i in range(len(entity.fields)) for k in "tv"])


def require_children(frames: Frames, entity: Entity) -> DataFrame:
    """An issue on each parent that has no record of a required child."""
    df = frames[entity.name]
    for i, child in enumerate(c for c in entity.children if c.required):
        there = frames[child.name].where("parent_rec_id is not null").select(F.col("parent_rec_id").alias(f"__child{i}")).distinct()
        df = df.join(there, F.col("rec_id") == F.col(f"__child{i}"), "left")
        lacks = F.when(F.col(f"__child{i}").isNull(), F.array(issue(child.name, F.lit(f"at least one {child.name} is required")))).otherwise(F.array().cast(df.schema["issues"].dataType))
        df = df.withColumn("issues", F.concat("issues", lacks)).drop(f"__child{i}")
    return df


def validate(frames: Frames, manifest: Manifest) -> Frames:
    typed = {e.name: validate_entity(frames[e.name], e) for e, _ in manifest.entities()}
    return {e.name: require_children(typed, e) for e, _ in manifest.entities()}
