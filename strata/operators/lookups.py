"""Lookups: codes to values, by a left join on the distinct texts, with a policy for what is missing.

A provider turns distinct (key) rows into (key, value) rows; it never sees the data themselves. Results are joined
back to the records; they are broadcast if there are few enough of them, which is checked.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.errors import LookupRejected
from strata.frames import Frames, issue, record_order
from strata.functions.convert import shown, trimmed
from strata.lineage import checkpointed
from strata.operators.validate import raw_of
from strata.plans.manifest import Entity, Field, Manifest, Missing

#: Resolved texts up to which the result is broadcast.
BROADCAST_KEYS = 100_000


class Provider(Protocol):
    def resolve(self, list_name: str, keys: DataFrame, case_insensitive: bool) -> DataFrame:
        """(key, value) of those keys (column key: distinct trimmed texts) that are known."""

    # Providers that can also create have: create(list_name, texts) with texts (text, first) ordered by first.


class RelationProvider:
    """Looks up in a relation (list, code, value), such as a view or the result of a JDBC query."""

    def __init__(self, relation: DataFrame | Callable[[], DataFrame]):
        self.relation = relation

    def resolve(self, list_name: str, keys: DataFrame, case_insensitive: bool) -> DataFrame:
        rows = self.relation() if callable(self.relation) else self.relation
        fold = F.lower if case_insensitive else (lambda c: c)
        codes = rows.where(F.col("list") == list_name).where("value is not null").groupBy(fold(F.col("code")).alias("__code")).agg(F.min("value").alias("value"))
        return keys.join(codes, fold(F.col("key")) == F.col("__code")).select("key", "value")


class SqlProvider:
    """A query over registered views: :list is bound, and the query gives code and value."""

    def __init__(self, spark: SparkSession, query: str):
        self.spark, self.query = spark, query

    def resolve(self, list_name: str, keys: DataFrame, case_insensitive: bool) -> DataFrame:
        rows = self.spark.sql(self.query, args={"list": list_name}).select(F.lit(list_name).alias("list"), "code", "value")
        return RelationProvider(rows).resolve(list_name, keys, case_insensitive)


class FunctionProvider:
    """A Python function from (list, texts) to a dict, called on batches of distinct texts; for services."""

    def __init__(self, function: Callable[[str, list[str]], dict], value_type: str = "int"):
        self.function, self.value_type = function, value_type

    def resolve(self, list_name: str, keys: DataFrame, case_insensitive: bool) -> DataFrame:
        function, kind = self.function, f"key string, value {self.value_type}"

        def run(batches):
            import pandas as pd

            for batch in batches:
                found = function(list_name, batch["key"].tolist())
                yield pd.DataFrame([(k, v) for k, v in found.items() if v is not None], columns=["key", "value"])

        return keys.mapInPandas(run, kind)


def looked_up(df: DataFrame, entity: Entity, field: Field, provider: Provider, on_reject_file: bool = True) -> DataFrame:
    """val.<field> becomes the resolved value; unknown texts follow the field's policy."""
    policy, lookup, spark = field.lookup.on_missing, field.lookup, df.sparkSession
    key, target = F.col(f"val.`{field.target}`"), field.spark_type().simpleString()
    df = df.withColumn("__key", key)
    keys = df.where("__key is not null").groupBy(F.col("__key").alias("key")).agg(F.min(F.struct("root_ord", record_order(F.col("rec_id")).alias("rec_id"))).alias("first"))
    found = provider.resolve(lookup.list, keys.select("key"), lookup.case_insensitive)
    if policy in (Missing.REJECT_FILE, Missing.AUTO_CREATE):
        missing = keys.join(found.select("key"), "key", "left_anti")
        if policy is Missing.AUTO_CREATE and hasattr(provider, "create"):
            if not missing.isEmpty():
                provider.create(lookup.list, missing.select(F.col("key").alias("text"), "first"), lookup.case_insensitive)
                found = provider.resolve(lookup.list, keys.select("key"), lookup.case_insensitive)
        elif on_reject_file and (some := missing.orderBy("first").limit(1).collect()):
            raise LookupRejected(f"{entity.name}.{field.name}: '{some[0]['key']}' is not in {lookup.list}")
    # What was found is kept: counting it, and the join, then read few rows instead of all records again.
    found = checkpointed(found.select(F.col("key").alias("__found"), F.col("value").cast(target).alias("__value")))
    if found.count() <= BROADCAST_KEYS:
        found = F.broadcast(found)
    df = df.join(found, F.col("__key") == F.col("__found"), "left")
    value = F.col("__value")
    if policy is Missing.USE_DEFAULT:
        default = spark.createDataFrame([((lookup.default or "").strip(),)], "key string")
        rows = provider.resolve(lookup.list, default, lookup.case_insensitive).limit(1).collect()
        if rows:
            value = F.coalesce(value, F.when(F.col("__key").isNotNull(), F.lit(rows[0]["value"]).cast(target)))
    miss = F.col("__key").isNotNull() & value.isNull()
    fault = F.concat(F.lit("'"), shown(F.col("__key")), F.lit(f"' is not in {lookup.list}"))
    df = df.withColumn("issues", F.when(miss, F.array_append("issues", issue(field.name, fault, F.coalesce(trimmed(raw_of(field)), F.col("__key"))))).otherwise(F.col("issues")))
    return df.withColumn("val", F.col("val").withField(f"`{field.target}`", value)).drop("__key", "__found", "__value")


def resolve_lookups(frames: Frames, manifest: Manifest, providers: dict[str, Provider]) -> Frames:
    """All lookup fields of all entities, also of records that have other faults. Unknown providers fail the file."""
    out = dict(frames)
    for entity, _ in manifest.entities():
        for field in entity.fields:
            if field.lookup:
                provider = {k.lower(): p for k, p in providers.items()}.get(field.lookup.provider.lower())
                if provider is None:
                    raise LookupRejected(f"{entity.name}.{field.name}: no lookup provider is called {field.lookup.provider}")
                out[entity.name] = looked_up(out[entity.name], entity, field, provider)
    return out
