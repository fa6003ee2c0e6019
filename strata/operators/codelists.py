"""Code lists: named lists of codes with integer ids. Tables: code_lists (id, name), codes (id, code_list_id, code,
description)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LISTS = "id int, name string"
CODES = "id int, code_list_id int, code string, description string"


def summary(lists: DataFrame, codes: DataFrame) -> DataFrame:
    """name, codes of every list, also of those without a code, by name."""
    joined = lists.alias("l").join(codes.alias("c"), F.col("l.id") == F.col("c.code_list_id"), "left")
    return joined.groupBy("l.id", "l.name").agg(F.count("c.id").alias("codes")).select("name", "codes").orderBy("name")


def contents(lists: DataFrame, codes: DataFrame, name: str) -> DataFrame:
    """id, code, description of one list, by code."""
    mine = lists.where(F.lower("name") == name.lower()).select(F.col("id").alias("code_list_id"))
    return codes.join(mine, "code_list_id").select("id", "code", "description").orderBy("code")


def relation(lists: DataFrame, codes: DataFrame) -> DataFrame:
    """list, code, value: what lookups join with."""
    return codes.join(lists.select(F.col("id").alias("code_list_id"), F.col("name").alias("list")), "code_list_id").select("list", "code", F.col("id").alias("value"))


def upserted(lists: DataFrame, codes: DataFrame, name: str, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Next versions of both tables: the list is made if it is new, known codes (whatever their case) get the new
    description, others are added by their order in ``items`` (code, description, ord); none is deleted. Of equal
    codes the last counts."""
    spark = lists.sparkSession
    row = lists.where(F.lower("name") == name.lower()).select("id").first()
    if row is None:
        new_id = lists.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1
        lists = lists.unionByName(spark.createDataFrame([(new_id, name)], LISTS))
    else:
        new_id = row[0]
    last = Window.partitionBy(F.lower("code")).orderBy(F.desc("ord"))
    items = items.withColumn("n", F.row_number().over(last)).where("n = 1").select(F.lower("code").alias("k"), F.col("code").alias("new_code"), F.col("description").alias("new_description"), "ord")
    mine = F.col("code_list_id") == new_id
    joined = codes.where(mine).withColumn("k", F.lower("code")).join(items, "k", "full_outer")
    old = joined.where("id is not null").select("id", "code_list_id", "code", F.when(F.col("ord").isNotNull(), F.col("new_description")).otherwise(F.col("description")).alias("description"))
    start = codes.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    # A list's new codes come from one call; they are numbered in one window.
    number = F.row_number().over(Window.orderBy("ord", "new_code")) + start
    new = joined.where("id is null").select(number.cast("int").alias("id"), F.lit(new_id).alias("code_list_id"), F.col("new_code").alias("code"), F.col("new_description").alias("description"))
    return lists, codes.where(~mine).unionByName(old).unionByName(new)
