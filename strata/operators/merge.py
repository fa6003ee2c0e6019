"""Upserts: level by level, matched on the parent's key and the natural key, with generated surrogate keys.

Plain parquet has no row-level merge, so a merge yields the table's next version. Of the target only the columns that
identify a row are joined to the stage; the result, as large as the stage, is kept, and counts, keys and rows come from
it. The rows of the target that did not match pass through one anti join. Keys are handed out densely: offsets from
counts of ranges, then numbers within each range, so no window spans the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.errors import DuplicateKey, MissingParent
from strata.frames import Frames, record_order
from strata.lineage import checkpointed
from strata.plans.manifest import Entity, Manifest

#: Rows that one window numbers, about, and the most ranges of them; beyond that many rows ranges grow.
RANGE_ROWS, MOST_RANGES = 200_000, 1 << 16


@dataclass(frozen=True)
class Merged:
    """table: the next version; staged: rec_id, key and action of every staged row; inserted and updated."""

    table: DataFrame
    staged: DataFrame
    inserted: int
    updated: int


def numbered(df: DataFrame, order: list[str], start: int, name: str) -> DataFrame:
    """df with dense numbers above start, by the order columns: a long that spreads the rows, then record ids.

    Rows are cut into ranges of the first column. A range with more than twice its share, such as one root's many
    children, is dealt on by a hash of the order columns and numbered part by part. Counts of ranges and of parts are
    at most MOST_RANGES and twice as many rows, so they are broadcast. df is read several times: it should be kept.
    """
    ordered = [F.col(order[0]), *[record_order(F.col(c)) for c in order[1:]]]
    rows = df.agg(F.count("*").alias("n"), F.min(order[0]).alias("a"), F.max(order[0]).alias("b")).first()
    if not rows["n"]:
        return df.withColumn(name, F.lit(None).cast("long"))
    share = max(RANGE_ROWS, -(-rows["n"] // MOST_RANGES))
    ranges = -(-rows["n"] // share)
    if ranges == 1:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*ordered)).cast("long") + start)
    first, last = rows["a"] or 0, rows["b"] or 0
    width = (last - first) // ranges + 1
    ranged = df.withColumn("__range", F.expr(f"coalesce({order[0]} - {first}L, 0L) div {width}L"))
    parts = ranged.groupBy("__range").agg(F.when(F.count("*") > 2 * share, F.ceil(F.count("*") / share)).otherwise(1).alias("__parts"))
    dealt = ranged.join(F.broadcast(parts), "__range").withColumn("__part", F.when(F.col("__parts") > 1, F.pmod(F.xxhash64(*order), "__parts")).otherwise(0)).drop("__parts")
    before = Window.orderBy("__range", "__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("__range", "__part").count().select("__range", "__part", (F.coalesce(F.sum("count").over(before), F.lit(0)) + start).alias("__offset"))
    inside = F.row_number().over(Window.partitionBy("__range", "__part").orderBy(*ordered)).cast("long")
    return dealt.withColumn(name, inside).join(F.broadcast(offsets), ["__range", "__part"]).withColumn(name, F.col(name) + F.col("__offset")).drop("__range", "__part", "__offset")


def _match(entity: Entity, parent: bool) -> list[tuple[str, bool]]:
    """(column, may be null) of what identifies a row."""
    found = [(entity.parent_key_column, False)] if parent else []
    return found + [(f.target, not f.required) for f in entity.key_fields()]


def last_wins(stage: DataFrame, columns: list[str]) -> DataFrame:
    """Of the rows with one natural key the last by place in the source."""
    window = Window.partitionBy(*columns).orderBy(F.desc("root_ord"), record_order(F.col("rec_id")).desc())
    return stage.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")


def duplicate_keys(stage: DataFrame, columns: list[str]) -> DataFrame:
    return stage.groupBy(*columns).count().where("count > 1")


def merge(stage: DataFrame, target: DataFrame, entity: Entity, parent: bool, on_duplicate: str = "fail", cut=checkpointed) -> Merged:
    """stage: root_ord, rec_id and the entity's columns (the parent's key too, but no key of its own).

    Without a natural key every row is inserted. Otherwise rows of the target that match (optional key columns
    null-safely) are updated in all other columns, nulls included; no row is ever deleted. Key-only rows count as
    updated too. Duplicates in the stage raise DuplicateKey, or with ``last_wins`` the last one counts. ``cut`` keeps
    the stage with the keys that matched (a checkpoint).
    """
    key, match = entity.key_column, _match(entity, parent)
    names = [f.name for f in entity.table_schema(parent).fields]
    rest = [n for n in names if n != key]
    start = target.agg(F.coalesce(F.max(key), F.lit(0).cast("long"))).first()[0]
    if not entity.natural_key:
        new = numbered(stage, ["root_ord", "rec_id"], start, key)
        staged = new.select("rec_id", F.col(key).alias("db_key"), F.lit("INSERT").alias("action"))
        return Merged(target.unionByName(new.select(*names)), staged, stage.count(), 0)
    columns = [c for c, _ in match]
    if on_duplicate == "last_wins":
        stage = last_wins(stage, columns)
    elif twice := duplicate_keys(stage, columns).limit(1).collect():
        raise DuplicateKey(f"{entity.name}: {', '.join(f'{c} = {twice[0][c]}' for c in columns)} occurs {twice[0]['count']} times")
    same: Column = F.lit(True)
    for c, optional in match:
        a, b = F.col(f"s.`{c}`"), F.col(f"t.`{c}`")
        same = same & (a.eqNullSafe(b) if optional else a == b)
    found = stage.alias("s").join(target.select(key, *columns).alias("t"), same, "left")
    found = cut(found.select("s.root_ord", "s.rec_id", F.col(f"t.`{key}`").alias(key), *[F.col(f"s.`{c}`").alias(c) for c in rest]))
    old = found.where(F.col(f"`{key}`").isNotNull())
    new = numbered(found.where(F.col(f"`{key}`").isNull()).drop(key), ["root_ord", "rec_id"], start, key)
    kept = target.join(old.select(key), key, "left_anti")
    table = kept.select(*names).unionByName(old.select(*names)).unionByName(new.select(*names))
    staged = old.select("rec_id", F.col(key).alias("db_key"), F.lit("UPDATE").alias("action")).unionByName(new.select("rec_id", F.col(key).alias("db_key"), F.lit("INSERT").alias("action")))
    rows, updated = found.agg(F.count("*"), F.count(f"`{key}`")).first()
    return Merged(table, staged, rows - updated, updated)


def stage_rows(df: DataFrame, entity: Entity, keys: DataFrame | None, key_name: str | None = None) -> DataFrame:
    """A frame's accepted rows as the target's columns; a child gets its parent's key by parent_rec_id."""
    values = [F.col(f"val.`{f.target}`").alias(f.target) for f in entity.fields]
    if keys is None:
        return df.select("root_ord", "rec_id", *values)
    parents = keys.select(F.col("rec_id").alias("__parent"), F.col("db_key").alias(key_name))
    joined = df.join(parents, F.col("parent_rec_id") == F.col("__parent"), "left")
    return joined.select("root_ord", "rec_id", F.col(key_name), *values)


def merge_levels(frames: Frames, manifest: Manifest, read_table, write_table, on_duplicate: str = "fail", cut=checkpointed) -> tuple[int, int]:
    """Merges all levels, parents first. read_table(entity, parent) gives the target; write_table(entity, df) keeps
    its next version. ``cut`` ends a lineage (a checkpoint). Returns rows inserted and updated."""
    keys: dict[str, DataFrame] = {}
    inserted = updated = 0
    for entity, parent in manifest.entities():
        stage = cut(stage_rows(frames[entity.name], entity, keys[parent.name] if parent else None, entity.parent_key_column))
        if stage.isEmpty():
            keys[entity.name] = stage.select("rec_id", F.lit(None).cast("long").alias("db_key"))
            continue
        if parent and not stage.where(F.col(f"`{entity.parent_key_column}`").isNull()).isEmpty():
            raise MissingParent(f"{entity.name}: a record has no parent row")
        done = merge(stage, read_table(entity, parent), entity, parent is not None, on_duplicate, cut)
        write_table(entity, done.table)
        if on_duplicate == "last_wins" and entity.children and entity.natural_key:
            # Children of rows that lost belong to the row that won.
            columns = [c for c, _ in _match(entity, parent is not None)]
            by_key = stage.alias("a").join(last_wins(stage, columns).alias("b"), [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in columns])
            won = by_key.select(F.col("a.rec_id").alias("rec_id"), F.col("b.rec_id").alias("__won"))
            keys[entity.name] = cut(won.join(done.staged.withColumnRenamed("rec_id", "__won"), "__won").select("rec_id", "db_key"))
        else:
            keys[entity.name] = cut(done.staged.select("rec_id", "db_key"))
        inserted, updated = inserted + done.inserted, updated + done.updated
    return inserted, updated
