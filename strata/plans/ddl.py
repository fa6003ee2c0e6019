"""Tables of a dataset as Spark SQL. Parquet has no keys: primary, foreign and unique keys are table properties, and the
merge keeps them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from strata.plans.manifest import Entity, Manifest


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def create_table(entity: Entity, parent: Entity | None) -> str:
    schema = entity.table_schema(parent is not None)
    columns = ",\n  ".join(f"{quoted(f.name)} {f.dataType.simpleString().upper()}{'' if f.nullable else ' NOT NULL'}" for f in schema.fields)
    facts = {"strata.primary_key": entity.key_column}
    if parent:
        facts["strata.foreign_key"] = f"{entity.parent_key_column} -> {parent.qualified}.{parent.key_column}"
    if entity.natural_key:
        facts["strata.unique"] = ", ".join(([entity.parent_key_column] if parent else []) + list(entity.natural_key))
    text = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    properties = ", ".join(f"{text(k)} = {text(v)}" for k, v in facts.items())
    return f"CREATE TABLE IF NOT EXISTS {quoted(entity.schema)}.{quoted(entity.table)} (\n  {columns}\n) USING parquet TBLPROPERTIES ({properties})"


def statements(manifest: Manifest) -> list[str]:
    """Databases first, then tables, parents before children."""
    entities = manifest.entities()
    databases = dict.fromkeys(e.schema for e, _ in entities)
    return [f"CREATE DATABASE IF NOT EXISTS {quoted(d)}" for d in databases] + [create_table(e, p) for e, p in entities]


def apply(spark: SparkSession, manifest: Manifest) -> None:
    for statement in statements(manifest):
        spark.sql(statement)
