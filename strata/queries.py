"""Registered queries over the fixture tables, and SQL that gives the same rows.

The tables are clean, so error paths get deterministic faults, as expressions on ids that both sides spell alike.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.frames import Frames, frame, has_errors, issue, no_issues
from strata.operators import codelists, jobs, split
from strata.operators.lookups import RelationProvider, looked_up, resolve_lookups
from strata.operators.merge import duplicate_keys, last_wins, merge, merge_levels
from strata.operators.validate import validate, validate_entity
from strata.plans.manifest import Entity, Field, Kind, Lookup, Manifest, Missing, Source
from strata.sources.reader import linked, read_texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- The dirty two-level dataset: the fixtures' orders, each with its lineitem rows ----------------------------------

MANIFEST = Manifest(
    "sales",
    description="Two of the provided tables as one tree; the nation of an order is its customer's",
    root=Entity(
        "orders", "sales_orders", schema="tpch", key_column="order_id", natural_key=("o_code",),
        fields=(
            Field("o_code", required=True, max_length=15), Field("o_orderdate", type=Kind.DATE), Field("o_orderpriority", max_length=30),
            Field("nation_name", column="nation_key", lookup=Lookup("nations")), Field("o_totalprice", type=Kind.DECIMAL, precision=15, scale=2),
        ),
        children=(
            Entity(
                "lineitem", "sales_lineitem", schema="tpch", key_column="lineitem_id", parent_key_column="order_id", natural_key=("l_linenumber",),
                fields=(
                    Field("l_linenumber", type=Kind.INT32, required=True), Field("l_partkey", type=Kind.INT64),
                    Field("l_quantity", type=Kind.DECIMAL, precision=15, scale=2), Field("l_shipdate", type=Kind.DATE),
                ),
            ),
        ),
    ),
)
ORDERS, LINEITEM = MANIFEST.root, MANIFEST.root.children[0]


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("o_orderkey")
    return rows.select(
        k, F.when(k % 101 == 0, "  ").otherwise(F.concat(F.lit("O-"), k.cast("string"))).alias("o_code"),
        F.when(k % 89 == 0, "not-a-date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("o_orderdate"), "o_orderpriority",
        F.when(k % 103 == 0, "XX").when(k % 7 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("nation_name"),
        F.when(k % 97 == 0, "banana").when(k % 83 == 0, "12345678901234").otherwise(F.col("o_totalprice").cast("decimal(15,2)").cast("string")).alias("o_totalprice"),
    )


def dirty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        k, n.cast("string").alias("l_linenumber"), F.col("l_partkey").cast("string").alias("l_partkey"),
        F.when((k % 79 == 0) & (n == 1), "n/a").otherwise(F.col("l_quantity").cast("decimal(15,2)").cast("string")).alias("l_quantity"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate"),
    )


DIRTY = """
    dirty_orders AS (
        SELECT o_orderkey, CASE WHEN o_orderkey % 101 = 0 THEN '  ' ELSE 'O-' || o_orderkey END AS o_code, o_orderpriority,
            CASE WHEN o_orderkey % 89 = 0 THEN 'not-a-date' ELSE strftime(orders.o_orderdate, '%Y-%m-%d') END AS o_orderdate,
            CASE WHEN o_orderkey % 103 = 0 THEN 'XX' WHEN o_orderkey % 7 = 0 THEN lower(n_name) ELSE n_name END AS nation_name,
            CASE WHEN o_orderkey % 97 = 0 THEN 'banana' WHEN o_orderkey % 83 = 0 THEN '12345678901234' ELSE orders.o_totalprice::DECIMAL(15,2)::VARCHAR END AS o_totalprice
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    dirty_lines AS (
        SELECT l_orderkey, t.l_linenumber::VARCHAR AS l_linenumber, t.l_partkey::VARCHAR AS l_partkey, strftime(t.l_shipdate, '%Y-%m-%d') AS l_shipdate,
            CASE WHEN l_orderkey % 79 = 0 AND t.l_linenumber = 1 THEN 'n/a' ELSE t.l_quantity::DECIMAL(15,2)::VARCHAR END AS l_quantity FROM lineitem t),
    issues AS (
        SELECT 'orders' AS entity, o_orderkey AS root_ord, 'o_code' AS field, 'a value is required' AS reason, o_code AS raw_value FROM dirty_orders WHERE trim(o_code) = ''
        UNION ALL SELECT 'orders', o_orderkey, 'o_orderdate', 'cannot read ''' || o_orderdate || ''' as date', o_orderdate FROM dirty_orders WHERE try_cast(o_orderdate AS DATE) IS NULL
        UNION ALL SELECT 'orders', o_orderkey, 'nation_name', '''' || nation_name || ''' is not in nations', nation_name FROM dirty_orders WHERE lower(nation_name) NOT IN (SELECT lower(n_name) FROM nation)
        UNION ALL SELECT 'orders', o_orderkey, 'o_totalprice', 'cannot read ''' || o_totalprice || ''' as decimal', o_totalprice FROM dirty_orders WHERE try_cast(o_totalprice AS DOUBLE) IS NULL
        UNION ALL SELECT 'orders', o_orderkey, 'o_totalprice', 'does not fit decimal(15,2)', o_totalprice FROM dirty_orders WHERE try_cast(o_totalprice AS DOUBLE) >= 1e13
        UNION ALL SELECT 'lineitem', l_orderkey, 'l_quantity', 'cannot read ''' || l_quantity || ''' as decimal', l_quantity FROM dirty_lines WHERE try_cast(l_quantity AS DOUBLE) IS NULL),
    bad AS (SELECT DISTINCT root_ord FROM issues)"""


def raw_frames(spark: SparkSession, sf_dir: str) -> Frames:
    k = F.col("o_orderkey")
    line = F.col("l_orderkey").cast("string")
    # A line's id need only be unique: equal lines of an order are told apart by where they were read.
    rec = F.concat(line, F.lit("/lineitem["), F.monotonically_increasing_id().cast("string"), F.lit("]"))
    return {
        "orders": frame(dirty_orders(spark, sf_dir), ORDERS, k, k.cast("string"), line=k),
        "lineitem": frame(dirty_lines(spark, sf_dir), LINEITEM, F.col("l_orderkey"), rec, line, line=F.col("l_orderkey")),
    }


def nations(spark: SparkSession, sf_dir: str) -> RelationProvider:
    return RelationProvider(table(spark, sf_dir, "nation").select(F.lit("nations").alias("list"), F.col("n_name").alias("code"), F.col("n_nationkey").alias("value")))


def checked(spark: SparkSession, sf_dir: str) -> Frames:
    """Validated and looked up."""
    return resolve_lookups(validate(raw_frames(spark, sf_dir), MANIFEST), MANIFEST, {"codelist": nations(spark, sf_dir)})


def accepted(spark: SparkSession, sf_dir: str) -> Frames:
    frames = checked(spark, sf_dir)
    return split.accepted(frames, split.bad_roots(frames))


@query(f"""WITH {DIRTY},
    trees AS (SELECT o_orderkey, 1 + (SELECT count(*) FROM dirty_lines WHERE l_orderkey = o_orderkey) AS n FROM dirty_orders)
    SELECT (SELECT count(*) FROM issues) AS rejections, (SELECT count(*) FROM bad) AS bad_roots, sum(n)::BIGINT AS records_read,
        sum(CASE WHEN o_orderkey IN (SELECT root_ord FROM bad) THEN n ELSE 0 END)::BIGINT AS records_rejected FROM trees""")
def tree_reject_counts(spark, sf_dir):
    return split.counts_frame(checked(spark, sf_dir))


@query(f"WITH {DIRTY} SELECT entity, root_ord, field, reason, raw_value FROM issues")
def issues_exploded(spark, sf_dir):
    return split.rejections(checked(spark, sf_dir), MANIFEST).select("entity", "root_ord", "field", "reason", "raw_value")


@query(f"WITH {DIRTY} SELECT entity, field, reason, count(*) AS n, min(root_ord) AS first_root FROM (SELECT * REPLACE (regexp_replace(reason, '''.*''', '?') AS reason) FROM issues) GROUP BY ALL")
def rejection_report(spark, sf_dir):
    rows = split.rejections(checked(spark, sf_dir), MANIFEST).withColumn("reason", F.regexp_replace("reason", "'.*'", "?"))
    return rows.groupBy("entity", "field", "reason").agg(F.count("*").alias("n"), F.min("root_ord").alias("first_root"))


@query(f"WITH {DIRTY} SELECT root_ord FROM bad")
def bad_roots(spark, sf_dir):
    return split.bad_roots(checked(spark, sf_dir))


@query(f"""WITH {DIRTY} SELECT o_orderkey AS root_ord, o_code, o_orderdate::DATE::VARCHAR AS o_orderdate, o_orderpriority, n_nationkey AS nation_key, o_totalprice::DECIMAL(15,2)::DOUBLE AS o_totalprice
    FROM dirty_orders JOIN nation ON lower(n_name) = lower(nation_name) WHERE o_orderkey NOT IN (SELECT root_ord FROM bad)""")
def accepted_roots(spark, sf_dir):
    rows = accepted(spark, sf_dir)["orders"].select("root_ord", "val.*")
    return rows.select("root_ord", "o_code", F.col("o_orderdate").cast("string").alias("o_orderdate"), "o_orderpriority", "nation_key", F.col("o_totalprice").cast("double").alias("o_totalprice"))


@query(f"""WITH {DIRTY} SELECT l_orderkey AS root_ord, l_linenumber::INTEGER AS l_linenumber, l_partkey::BIGINT AS l_partkey, l_quantity::DECIMAL(15,2)::DOUBLE AS l_quantity, l_shipdate
    FROM dirty_lines WHERE l_orderkey NOT IN (SELECT root_ord FROM bad)""")
def accepted_lines(spark, sf_dir):
    rows = accepted(spark, sf_dir)["lineitem"].select("root_ord", "val.*")
    return rows.select("root_ord", "l_linenumber", "l_partkey", F.col("l_quantity").cast("double").alias("l_quantity"), F.col("l_shipdate").cast("string").alias("l_shipdate"))


@query(f"WITH {DIRTY} SELECT entity, root_ord, field, raw_value FROM issues ORDER BY root_ord, entity DESC, field LIMIT 100")
def rejections_top(spark, sf_dir):
    rows = split.rejections(checked(spark, sf_dir), MANIFEST).withColumn("job_id", F.lit("j"))
    # A line's place within its order has no fixed number here, so the order is by entity.
    return rows.orderBy("root_ord", F.desc("entity"), "field").limit(100).select("entity", "root_ord", "field", "raw_value")


# --- Conversion -----------------------------------------------------------------------------------------------------


def converted(df: DataFrame, text: Column, field: Field) -> DataFrame:
    """id, value, bad of texts, through the same steps as a frame's fields."""
    entity = one_level(field)
    rows = validate_entity(frame(df.withColumn(field.name, text), entity, F.col("id"), F.col("id")), entity)
    # Results are shown in types that every engine hands over alike.
    kind = {Kind.DECIMAL: "double", Kind.BOOLEAN: "string", Kind.DATE: "string"}.get(field.type, field.spark_type())
    return rows.select(F.col("root_ord").alias("id"), F.col(f"val.{field.target}").cast(kind).alias("value"), has_errors().alias("bad"))


def variants(spark: SparkSession, sf_dir: str, name: str, key: str, texts: list[str | Column], other: Column) -> tuple[DataFrame, Column]:
    """A table's rows with one of the texts by key modulo their number, or the other."""
    df = table(spark, sf_dir, name).withColumn("id", F.col(key).cast("long"))
    text = None
    for i, t in enumerate(texts):
        at, then = F.col("id") % (len(texts) + 1) == i, F.lit(t) if isinstance(t, str) else t
        text = F.when(at, then) if text is None else text.when(at, then)
    return df, text.otherwise(other)


def _convert_sql(name: str, key: str, texts: list[str], other: str, value: str, good: str) -> str:
    """value and good are expressions on t, the trimmed text that isn't blank."""
    cases = " ".join(f"WHEN {key} % {len(texts) + 1} = {i} THEN {t}" for i, t in enumerate(texts))
    return f"""WITH raw AS (SELECT {key}::BIGINT AS id, CASE {cases} ELSE {other} END AS text FROM {name}),
        shaped AS (SELECT id, nullif(trim(text), '') AS t FROM raw)
        SELECT id, CASE WHEN {good} THEN {value} END AS value, t IS NOT NULL AND NOT ({good}) AS bad FROM shaped"""


@query(_convert_sql("orders", "o_orderkey", ["' ' || o_custkey || ' '", "'+' || o_custkey", "o_custkey || '.5'", "''", "'99999999999'"], "o_custkey::VARCHAR", "try_cast(t AS INTEGER)", "regexp_full_match(t, '[+-]?[0-9]+') AND try_cast(t AS INTEGER) IS NOT NULL"))
def convert_int(spark, sf_dir):
    k = F.col("o_custkey").cast("string")
    df, text = variants(spark, sf_dir, "orders", "o_orderkey", [F.concat(F.lit(" "), k, F.lit(" ")), F.concat(F.lit("+"), k), F.concat(k, F.lit(".5")), "", "99999999999"], k)
    return converted(df, text, Field("f", type=Kind.INT32))


@query(_convert_sql("orders", "o_orderkey", ["'9' || lpad(o_custkey::VARCHAR, 9, '0')", "'-' || o_custkey", "'99999999999999999999'", "'1e3'"], "o_custkey::VARCHAR", "try_cast(t AS BIGINT)", "regexp_full_match(t, '[+-]?[0-9]+') AND try_cast(t AS BIGINT) IS NOT NULL"))
def convert_long(spark, sf_dir):
    k = F.col("o_custkey").cast("string")
    df, text = variants(spark, sf_dir, "orders", "o_orderkey", [F.concat(F.lit("9"), F.lpad(k, 9, "0")), F.concat(F.lit("-"), k), "99999999999999999999", "1e3"], k)
    return converted(df, text, Field("f", type=Kind.INT64))


@query(_convert_sql("orders", "o_orderkey", ["'1.5e3'", "' -' || o_custkey || '.25'", "'banana'", "'.5'", "''"], "o_totalprice::DECIMAL(18,2)::VARCHAR", "try_cast(t AS DECIMAL(18,6))::DOUBLE", "try_cast(t AS DOUBLE) IS NOT NULL"))
def convert_decimal(spark, sf_dir):
    texts = ["1.5e3", F.concat(F.lit(" -"), F.col("o_custkey").cast("string"), F.lit(".25")), "banana", ".5", ""]
    df, text = variants(spark, sf_dir, "orders", "o_orderkey", texts, F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    return converted(df, text, Field("f", type=Kind.DECIMAL))


@query(_convert_sql("orders", "o_orderkey", ["'1.5d'", "'2.5E-1'", "'-7'", "'nan'"], "o_totalprice::DECIMAL(18,2)::VARCHAR", "try_cast(t AS DOUBLE)", "regexp_full_match(t, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')"))
def convert_double(spark, sf_dir):
    df, text = variants(spark, sf_dir, "orders", "o_orderkey", ["1.5d", "2.5E-1", "-7", "nan"], F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    return converted(df, text, Field("f", type=Kind.DOUBLE))


@query(_convert_sql("orders", "o_orderkey", ["'Yes'", "' n '", "'1'", "'FALSE'", "'t'", "''"], "'on'", "(lower(t) IN ('true', '1', 'y', 'yes'))::VARCHAR", "lower(t) IN ('true', '1', 'y', 'yes', 'false', '0', 'n', 'no')"))
def convert_bool(spark, sf_dir):
    df, text = variants(spark, sf_dir, "orders", "o_orderkey", ["Yes", " n ", "1", "FALSE", "t", ""], F.lit("on"))
    return converted(df, text, Field("f", type=Kind.BOOLEAN))


@query(_convert_sql("orders", "o_orderkey", ["'2026'", "'2026-02-30'", "strftime(o_orderdate, '%m/%d/%Y')", "''"], "strftime(o_orderdate, '%Y-%m-%d')", "coalesce(try_cast(t AS DATE), try_strptime(t, '%m/%d/%Y')::DATE)::VARCHAR", "length(t) = 10 AND coalesce(try_cast(t AS DATE), try_strptime(t, '%m/%d/%Y')::DATE) IS NOT NULL"))
def convert_date(spark, sf_dir):
    df, text = variants(spark, sf_dir, "orders", "o_orderkey", ["2026", "2026-02-30", F.date_format("o_orderdate", "MM/dd/yyyy"), ""], F.date_format("o_orderdate", "yyyy-MM-dd"))
    return converted(df, text, Field("f", type=Kind.DATE))


@query(_convert_sql("orders", "o_orderkey", ["strftime(o_orderdate, '%Y-%m-%d')", "'2026011x'"], "strftime(o_orderdate, '%Y%m%d')", "try_strptime(t, '%Y%m%d')::DATE::VARCHAR", "regexp_full_match(t, '[0-9]{8}')"))
def convert_date_format(spark, sf_dir):
    df, text = variants(spark, sf_dir, "orders", "o_orderkey", [F.date_format("o_orderdate", "yyyy-MM-dd"), "2026011x"], F.date_format("o_orderdate", "yyyyMMdd"))
    return converted(df, text, Field("f", type=Kind.DATE, format="yyyyMMdd"))


@query(_convert_sql("events", "event_id", ["strftime(ts, '%Y-%m-%d %H:%M')", "'10:30'", "'soon'"], "strftime(ts, '%Y-%m-%dT%H:%M:%S')", "try_cast(t AS TIMESTAMP)", "regexp_full_match(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}[T ].*')"))
def convert_timestamp(spark, sf_dir):
    texts = [F.date_format("ts", "yyyy-MM-dd HH:mm"), "10:30", "soon"]
    df, text = variants(spark, sf_dir, "events", "event_id", texts, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return converted(df, text, Field("f", type=Kind.DATETIME))


@query(_convert_sql("events", "event_id", ["'24:00'", "strftime(ts, '%H:%M')"], "strftime(ts, '%H:%M:%S')", "CASE WHEN t <> '24:00' THEN epoch_us(try_cast('2000-01-01 ' || t AS TIMESTAMP)) - epoch_us(TIMESTAMP '2000-01-01') END", "t <> '24:00'"))
def convert_time(spark, sf_dir):
    df, text = variants(spark, sf_dir, "events", "event_id", ["24:00", F.date_format("ts", "HH:mm")], F.date_format("ts", "HH:mm:ss"))
    return converted(df, text, Field("f", type=Kind.TIME))


_HASH = "md5(event_id::VARCHAR)"
_DASHED = f"substr({_HASH}, 1, 8) || '-' || substr({_HASH}, 9, 4) || '-' || substr({_HASH}, 13, 4) || '-' || substr({_HASH}, 17, 4) || '-' || substr({_HASH}, 21)"


@query(f"""SELECT event_id AS id, CASE WHEN event_id % 4 < 3 THEN {_DASHED} END AS value, event_id % 4 = 3 AS bad FROM events""")
def convert_guid(spark, sf_dir):
    h = F.md5(F.col("event_id").cast("string").cast("binary"))
    dashed = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    df, text = variants(spark, sf_dir, "events", "event_id", [h, F.concat(F.lit("{"), F.upper(dashed), F.lit("}")), F.concat(F.lit("("), dashed, F.lit(")"))], F.substring(h, 1, 31))
    return converted(df, text, Field("f", type=Kind.GUID))


# --- Projection and validation --------------------------------------------------------------------------------------


def one_level(*fields: Field, key: tuple[str, ...] = (), **options) -> Entity:
    return Entity("Row", "Rows", fields=fields, natural_key=key, **options)


def customers(spark, sf_dir, *extra: Column) -> DataFrame:
    return table(spark, sf_dir, "customer").select("*", *extra)


def validated(df: DataFrame, entity: Entity, key: str) -> DataFrame:
    return validate_entity(frame(df, entity, F.col(key), F.col(key).cast("string")), entity)


@query("SELECT c_custkey AS root_ord, CASE WHEN c_custkey % 3 = 0 THEN 'NONE' ELSE c_mktsegment END AS segment FROM customer")
def default_fill(spark, sf_dir):
    df = customers(spark, sf_dir, F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.col("c_mktsegment")).alias("segment"))
    return validated(df, one_level(Field("segment", default="NONE")), "c_custkey").select("root_ord", "val.segment")


@query("SELECT c_custkey AS root_ord, 'import' AS origin FROM customer")
def constant_field(spark, sf_dir):
    df = customers(spark, sf_dir, F.lit("ignored").alias("origin"))
    return validated(df, one_level(Field("origin", source=Source.CONSTANT, default="import")), "c_custkey").select("root_ord", "val.origin")


@query("SELECT c_custkey AS root_ord, CASE WHEN c_custkey % 2 = 1 THEN c_name END AS name FROM customer")
def blank_to_null(spark, sf_dir):
    df = customers(spark, sf_dir, F.when(F.col("c_custkey") % 2 == 0, F.lit("  \t")).otherwise(F.col("c_name")).alias("name"))
    return validated(df, one_level(Field("name")), "c_custkey").select("root_ord", "val.name")


@query("SELECT c_custkey AS root_ord, c_name AS customer_name, c_nationkey AS nation FROM customer")
def rename_project(spark, sf_dir):
    entity = one_level(Field("C_NAME", column="customer_name"), Field("c_NationKey", column="nation", type=Kind.INT32))
    return validated(customers(spark, sf_dir), entity, "c_custkey").select("root_ord", "val.customer_name", "val.nation")


@query("SELECT o_orderkey AS root_ord, 'o_code' AS field, 'a value is required' AS message FROM orders WHERE o_orderkey % 101 = 0")
def required_missing(spark, sf_dir):
    df = validate(raw_frames(spark, sf_dir), MANIFEST)["orders"]
    return df.select("root_ord", F.explode("issues").alias("i")).where("i.field = 'o_code'").select("root_ord", "i.field", "i.message")


@query("SELECT o_orderkey AS root_ord FROM orders WHERE o_orderkey % 11 = 0")
def lookup_required_missing(spark, sf_dir):
    # The lookup's own default does not stand in for what is missing.
    field = Field("p", required=True, lookup=Lookup("l", on_missing=Missing.USE_DEFAULT, default="U"))
    df = table(spark, sf_dir, "orders").withColumn("p", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")))
    return validated(df, one_level(field), "o_orderkey").where(has_errors()).select("root_ord")


@query("SELECT o_orderkey AS root_ord, length(o_orderpriority)::VARCHAR || ' characters; at most 6 fit' AS message FROM orders WHERE length(o_orderpriority) > 6")
def max_length(spark, sf_dir):
    df = validated(table(spark, sf_dir, "orders"), one_level(Field("o_orderpriority", max_length=6)), "o_orderkey")
    return df.select("root_ord", F.explode("issues").alias("i")).select("root_ord", "i.message")


@query("SELECT doc_id AS root_ord FROM documents WHERE length(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) > 400")
def natural_key_length_400(spark, sf_dir):
    return validated(table(spark, sf_dir, "documents"), one_level(Field("text"), key=("text",)), "doc_id").where(has_errors()).select("root_ord")


@query("""WITH r AS (SELECT o_orderkey, (o_totalprice::DECIMAL(18,2) / 1000)::DECIMAL(18,3) AS t FROM orders)
    SELECT o_orderkey AS root_ord, round(t, 1) >= 100 AS too_wide, CASE WHEN round(t, 1) < 100 THEN round(t, 1)::DECIMAL(3,1)::DOUBLE END AS value FROM r""")
def decimal_overflow(spark, sf_dir):
    text = (F.col("o_totalprice").cast("decimal(18,2)") / 1000).cast("decimal(18,3)").cast("string")
    df = validated(table(spark, sf_dir, "orders").withColumn("t", text), one_level(Field("t", type=Kind.DECIMAL, precision=3, scale=1)), "o_orderkey")
    return df.select("root_ord", has_errors().alias("too_wide"), F.col("val.t").cast("double").alias("value"))


@query("SELECT o_orderkey AS root_ord, 'at least one lineitem is required' AS message FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def required_child(spark, sf_dir):
    manifest = replace(MANIFEST, root=replace(ORDERS, children=(replace(LINEITEM, required=True),)))
    df = validate(raw_frames(spark, sf_dir), manifest)["orders"]
    return df.select("root_ord", F.explode("issues").alias("i")).where("i.field = 'lineitem'").select("root_ord", "i.message")


@query("SELECT c_custkey AS root_ord, c_acctbal < 0 AS warned, false AS rejected FROM customer")
def warnings_do_not_reject(spark, sf_dir):
    df = validated(customers(spark, sf_dir), one_level(Field("c_acctbal", type=Kind.DOUBLE)), "c_custkey")
    low = F.when(F.col("val.c_acctbal") < 0, F.array(issue("c_acctbal", F.lit("below zero"), severity="Warning"))).otherwise(no_issues())
    df = df.withColumn("issues", F.concat("issues", low))
    return df.select("root_ord", (F.size("issues") > 0).alias("warned"), has_errors().alias("rejected"))


# --- Lookups and code lists -----------------------------------------------------------------------------------------


def with_country(spark, sf_dir, **lookup) -> tuple[DataFrame, Entity, Field]:
    """Customers whose country is a nation's name, in lower case for every third, unknown for every fifth."""
    k, nation = F.col("c_custkey"), table(spark, sf_dir, "nation")
    rows = customers(spark, sf_dir).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.withColumn("customer_nation", F.when(k % 5 == 0, F.concat(F.lit("new-"), (k % 4).cast("string"))).when(k % 3 == 0, F.lower("n_name")).otherwise(F.col("n_name")))
    field = Field("customer_nation", lookup=Lookup("nations", **lookup))
    entity = one_level(field)
    return validated(rows, entity, "c_custkey"), entity, field


_COUNTRY = """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'new-' || c_custkey % 4 WHEN c_custkey % 3 = 0 THEN lower(n_name) ELSE n_name END AS country
    FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _looked_up(spark, sf_dir, **lookup) -> DataFrame:
    df, entity, field = with_country(spark, sf_dir, **lookup)
    return looked_up(df, entity, field, nations(spark, sf_dir)).select("root_ord", F.col("val.customer_nation").alias("country"), has_errors().alias("bad"))


@query(f"{_COUNTRY} SELECT c_custkey AS root_ord, n_nationkey AS country, n_nationkey IS NULL AS bad FROM c LEFT JOIN nation ON lower(country) = lower(n_name)")
def lookup_reject(spark, sf_dir):
    return _looked_up(spark, sf_dir)


@query(f"{_COUNTRY} SELECT c_custkey AS root_ord, n_nationkey AS country, n_nationkey IS NULL AS bad FROM c LEFT JOIN nation ON country = n_name")
def lookup_cs(spark, sf_dir):
    return _looked_up(spark, sf_dir, case_insensitive=False)


@query(f"{_COUNTRY} SELECT count(*) AS n, count(n_nationkey) AS found FROM c LEFT JOIN nation ON lower(country) = lower(n_name)")
def lookup_ci(spark, sf_dir):
    return _looked_up(spark, sf_dir).agg(F.count("*").alias("n"), F.count("country").alias("found"))


@query(f"{_COUNTRY} SELECT c_custkey AS root_ord, coalesce(n.n_nationkey, (SELECT n_nationkey FROM nation WHERE n_name = (SELECT min(n_name) FROM nation))) AS country, false AS bad FROM c LEFT JOIN nation n ON lower(country) = lower(n_name)")
def lookup_use_default(spark, sf_dir):
    first = table(spark, sf_dir, "nation").agg(F.min("n_name")).first()[0]
    return _looked_up(spark, sf_dir, on_missing=Missing.USE_DEFAULT, default=first)


class _Growing(RelationProvider):
    """Creates codes in memory, by the order of their first use."""

    def create(self, list_name, texts, case_insensitive):
        old = self.relation
        lists = old.sparkSession.createDataFrame([(1, list_name)], codelists.LISTS)
        codes = old.select(F.col("value").cast("int").alias("id"), F.lit(1).alias("code_list_id"), "code", F.lit(None).cast("string").alias("description"))
        items = texts.select(F.col("text").alias("code"), F.lit(None).cast("string").alias("description"), F.col("first").alias("ord"))
        self.relation = codelists.relation(*codelists.upserted(lists, codes, list_name, items))


@query(f"""{_COUNTRY}, new AS (SELECT country AS code, (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY min(c_custkey)) AS id FROM c WHERE c_custkey % 5 = 0 GROUP BY country)
    SELECT c_custkey AS root_ord, coalesce(n_nationkey, id)::INTEGER AS country, false AS bad FROM c LEFT JOIN nation ON lower(country) = lower(n_name) LEFT JOIN new ON country = code""")
def lookup_auto_create(spark, sf_dir):
    df, entity, field = with_country(spark, sf_dir, on_missing=Missing.AUTO_CREATE)
    provider = _Growing(nations(spark, sf_dir).relation)
    return looked_up(df, entity, field, provider).select("root_ord", F.col("val.customer_nation").alias("country"), has_errors().alias("bad"))


@query(f"{_COUNTRY} SELECT country AS key, count(*) AS n FROM c WHERE lower(country) NOT IN (SELECT lower(n_name) FROM nation) GROUP BY country")
def lookup_misses(spark, sf_dir):
    df, entity, field = with_country(spark, sf_dir)
    rows = looked_up(df, entity, field, nations(spark, sf_dir)).where(has_errors())
    return rows.groupBy(F.col("raw.customer_nation").alias("key")).agg(F.count("*").alias("n"))


def lists_and_codes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Regions as lists, and one without a code; nations as codes."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    lists = region.select(F.col("r_regionkey").cast("int").alias("id"), F.col("r_name").alias("name")).unionByName(spark.createDataFrame([(99, "EMPTY")], codelists.LISTS))
    return lists, nation.select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_regionkey").cast("int").alias("code_list_id"), F.col("n_name").alias("code"), F.lit(None).cast("string").alias("description"))


@query("SELECT r_name AS name, count(n_nationkey) AS codes FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name UNION ALL SELECT 'EMPTY', 0")
def codelist_summary(spark, sf_dir):
    return codelists.summary(*lists_and_codes(spark, sf_dir))


@query("SELECT n_nationkey AS id, n_name AS code, NULL::VARCHAR AS description FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = (SELECT min(r_name) FROM region)")
def codelist_contents(spark, sf_dir):
    lists, codes = lists_and_codes(spark, sf_dir)
    return codelists.contents(lists, codes, lists.where("id < 99").agg(F.min("name")).first()[0].lower())


@query("""WITH l AS (SELECT r_regionkey AS id FROM region WHERE r_name = (SELECT min(r_name) FROM region))
    SELECT n_nationkey AS id, n_regionkey AS code_list_id, n_name AS code, CASE WHEN n_regionkey = (SELECT id FROM l) AND n_nationkey % 2 = 0 THEN 'seen' END AS description FROM nation
    UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + i::INTEGER, (SELECT id FROM l), 'extra' || i, 'new' FROM range(1, 3) t(i)""")
def codelist_upsert(spark, sf_dir):
    lists, codes = lists_and_codes(spark, sf_dir)
    first = lists.where("id < 99").orderBy("name").first()
    seen = codes.where((F.col("code_list_id") == first["id"]) & (F.col("id") % 2 == 0)).select(F.lower("code").alias("code"), F.lit("seen").alias("description"), F.col("id").cast("long").alias("ord"))
    new = spark.createDataFrame([("extra1", "new", 1001), ("extra2", "old", 1002), ("EXTRA2", "older", 1000), ("extra2", "new", 1003)], "code string, description string, ord long")
    return codelists.upserted(lists, codes, first["name"], seen.unionByName(new))[1]


# --- Upserts --------------------------------------------------------------------------------------------------------

CUSTOMER = Entity("Customer", "Customers", key_column="Id", natural_key=("c_custkey",), fields=(Field("c_custkey", type=Kind.INT64, required=True), Field("c_name"), Field("c_nationkey", type=Kind.INT32)))


def customer_target(spark, sf_dir) -> DataFrame:
    """Customers whose key is no multiple of 5, with keys of their own."""
    return table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select((F.col("c_custkey") + 10).alias("Id"), "c_custkey", "c_name", "c_nationkey")


def customer_stage(spark, sf_dir) -> DataFrame:
    """Customers with even keys, renamed, some without a nation."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(
        k.alias("root_ord"), k.cast("string").alias("rec_id"), k, F.concat(F.lit("new "), F.col("c_name")).alias("c_name"), F.when(k % 4 != 0, F.col("c_nationkey")).alias("c_nationkey")
    )


_UPSERTED = """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new ' || c_name ELSE c_name END AS c_name, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey END AS c_nationkey
    FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 5 <> 0"""


@query(f"""WITH new AS (SELECT c_custkey AS k, (SELECT max(c_custkey) + 10 FROM customer WHERE c_custkey % 5 <> 0) + row_number() OVER (ORDER BY c_custkey) AS id FROM customer WHERE c_custkey % 10 = 0)
    SELECT coalesce(id, c_custkey + 10) AS "Id", u.* FROM ({_UPSERTED}) u LEFT JOIN new ON k = c_custkey""")
def upsert_flat(spark, sf_dir):
    return merge(customer_stage(spark, sf_dir), customer_target(spark, sf_dir), CUSTOMER, False).table


@query(_UPSERTED)
def upsert_flat_idempotent(spark, sf_dir):
    once = merge(customer_stage(spark, sf_dir), customer_target(spark, sf_dir), CUSTOMER, False).table
    again = merge(customer_stage(spark, sf_dir), once, CUSTOMER, False)
    if again.inserted:
        raise AssertionError("a repeated merge inserts nothing")
    return again.table.drop("Id")


@query("""SELECT 'first' AS run, count(*) FILTER (c_custkey % 5 = 0) AS inserted, count(*) FILTER (c_custkey % 5 <> 0) AS updated FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT 'second', 0, count(*) FROM customer WHERE c_custkey % 2 = 0""")
def upsert_counts(spark, sf_dir):
    first = merge(customer_stage(spark, sf_dir), customer_target(spark, sf_dir), CUSTOMER, False)
    second = merge(customer_stage(spark, sf_dir), first.table, CUSTOMER, False)
    return spark.createDataFrame([("first", first.inserted, first.updated), ("second", second.inserted, second.updated)], "run string, inserted long, updated long")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, 'new ' || c_name FROM customer WHERE c_custkey % 2 = 0""")
def append_no_key(spark, sf_dir):
    return merge(customer_stage(spark, sf_dir), customer_target(spark, sf_dir), replace(CUSTOMER, natural_key=()), False).table.select("c_custkey", "c_name")


@query("SELECT s_nationkey, n FROM (SELECT CASE WHEN s_nationkey % 3 <> 0 THEN s_nationkey END AS s_nationkey, count(*)::VARCHAR AS n FROM supplier GROUP BY 1)")
def upsert_null_safe_key(spark, sf_dir):
    entity = Entity("N", "N", natural_key=("s_nationkey",), fields=(Field("s_nationkey", type=Kind.INT32), Field("n")))
    key = F.when(F.col("s_nationkey") % 3 != 0, F.col("s_nationkey")).alias("s_nationkey")
    stage = table(spark, sf_dir, "supplier").groupBy(key).agg(F.count("*").cast("string").alias("n")).withColumns({"root_ord": F.coalesce(F.col("s_nationkey"), F.lit(-1)).cast("long"), "rec_id": F.coalesce(F.col("s_nationkey").cast("string"), F.lit("-"))})
    target = spark.createDataFrame([], entity.table_schema(False))
    first = merge(stage, target, entity, False).table
    return merge(stage, first, entity, False).table.select("s_nationkey", "n")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0")
def upsert_overwrites_with_null(spark, sf_dir):
    return merge(customer_stage(spark, sf_dir), customer_target(spark, sf_dir), CUSTOMER, False).table.where("c_nationkey IS NULL").select("c_custkey")


def hierarchy(spark, sf_dir) -> dict[str, DataFrame]:
    """The accepted trees merged into empty tables; of lines with one number the last by place counts."""
    from strata.lineage import checkpointed

    frames = {k: checkpointed(v) for k, v in checked(spark, sf_dir).items()}
    frames = split.accepted(frames, checkpointed(split.bad_roots(frames)))
    tables: dict[str, DataFrame] = {}
    empty = lambda e, p: spark.createDataFrame([], e.table_schema(p is not None))
    merge_levels(frames, MANIFEST, empty, lambda e, df: tables.update({e.name: df}), "last_wins", checkpointed)
    return tables


@query(f"""WITH {DIRTY} SELECT o_code, n_nationkey AS nation_key, o_totalprice::DECIMAL(15,2)::DOUBLE AS o_totalprice
    FROM dirty_orders JOIN nation ON lower(n_name) = lower(nation_name) WHERE o_orderkey NOT IN (SELECT root_ord FROM bad)""")
def upsert_hierarchical_parent(spark, sf_dir):
    return hierarchy(spark, sf_dir)["orders"].select("o_code", "nation_key", F.col("o_totalprice").cast("double").alias("o_totalprice"))


@query(f"""WITH {DIRTY} SELECT DISTINCT 'O-' || l_orderkey AS o_code, l_linenumber::INTEGER AS l_linenumber
    FROM dirty_lines WHERE l_orderkey NOT IN (SELECT root_ord FROM bad)""")
def upsert_hierarchical_child(spark, sf_dir):
    found = hierarchy(spark, sf_dir)
    return found["lineitem"].join(found["orders"], "order_id").select("o_code", "l_linenumber")


@query(f"""WITH {DIRTY} SELECT (SELECT count(*) FROM dirty_orders WHERE o_orderkey NOT IN (SELECT root_ord FROM bad)) AS orders,
    (SELECT count(DISTINCT (l_orderkey, l_linenumber)) FROM dirty_lines WHERE l_orderkey NOT IN (SELECT root_ord FROM bad)) AS lines, 0::BIGINT AS orphans, 0::BIGINT AS repeated_keys""")
def fk_integrity(spark, sf_dir):
    found = hierarchy(spark, sf_dir)
    orders, lines = found["orders"], found["lineitem"]
    counts = [
        orders.agg(F.count("*").alias("orders")), lines.agg(F.count("*").alias("lines")), lines.join(orders, "order_id", "left_anti").agg(F.count("*").alias("orphans")),
        orders.agg((F.count("*") - F.countDistinct("order_id")).alias("repeated_keys")),
    ]
    return spark.createDataFrame([tuple(c.first()[0] for c in counts)], "orders long, lines long, orphans long, repeated_keys long")


@query("SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_natural_key(spark, sf_dir):
    return duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC) = 1""")
def last_wins_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumns({"root_ord": F.col("l_partkey"), "rec_id": F.concat(F.lit("0/lineitem["), F.col("l_suppkey").cast("string"), F.lit("]"))})
    return last_wins(rows, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey")


# --- Files ----------------------------------------------------------------------------------------------------------


def archive_tables(spark, sf_dir) -> Frames:
    """What an archive's files hold: every 50th key is written twice, and lines of every 40th order have no parent."""
    k, place = F.col("o_orderkey"), F.col("l_orderkey") * 100 + F.col("l_linenumber")
    orders = dirty_orders(spark, sf_dir).where("o_orderkey % 40 <> 0")
    raw = lambda df, names: F.create_map(*[x for n in names for x in (F.lit(n.lower()), F.col(n))])
    order = orders.select((k * 2).alias("ord"), k.alias("line"), raw(orders, ["o_code", "o_orderdate", "nation_name", "o_totalprice"]).alias("raw"), F.concat(F.lit("k"), k.cast("string")).alias("key"), F.lit(None).cast("string").alias("parent_key"), no_issues().alias("issues"))
    again = order.where("line % 50 = 0").withColumn("ord", F.col("ord") + 1)
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"))
    line = lines.select(place.alias("ord"), place.alias("line"), raw(lines.select(*[F.col(c).cast("string").alias(c) for c in lines.columns]), ["l_linenumber", "l_partkey"]).alias("raw"), F.lit(None).cast("string").alias("key"), F.concat(F.lit("k"), F.col("l_orderkey").cast("string")).alias("parent_key"), no_issues().alias("issues"))
    return {"orders": order.unionByName(again), "lineitem": line}


@query("SELECT l_orderkey * 2 AS root_ord, l_linenumber::VARCHAR AS l_linenumber, max(l_partkey)::VARCHAR AS l_partkey FROM lineitem WHERE l_orderkey % 40 <> 0 GROUP BY l_orderkey, l_linenumber")
def csv_link(spark, sf_dir):
    rows = linked(archive_tables(spark, sf_dir), MANIFEST)["lineitem"].where("parent_rec_id IS NOT NULL")
    return rows.select("root_ord", "raw.l_linenumber", "raw.l_partkey")


@query("SELECT DISTINCT l_orderkey * 100 + l_linenumber AS line, 'k' || l_orderkey AS raw_value FROM lineitem WHERE l_orderkey % 40 = 0")
def csv_orphans(spark, sf_dir):
    rows = linked(archive_tables(spark, sf_dir), MANIFEST)["lineitem"].where(has_errors())
    return rows.select("line", F.col("issues")[0]["raw_value"].alias("raw_value"))


@query("SELECT o_orderkey * 2 + 1 AS root_ord, 'key k' || o_orderkey || ' occurs twice' AS message FROM orders WHERE o_orderkey % 50 = 0 AND o_orderkey % 40 <> 0")
def csv_duplicate_key(spark, sf_dir):
    rows = linked(archive_tables(spark, sf_dir), MANIFEST)["orders"].where(has_errors())
    return rows.select("root_ord", F.col("issues")[0]["message"].alias("message"))


PAIR = Manifest("pairs", root=Entity("Pair", "Pairs", fields=(Field("a"), Field("b"))))


@query("""SELECT c_custkey * 1048576 AS root_ord, 'x, ' || chr(10) || '"' || c_name AS a, CASE WHEN c_custkey % 3 = 1 THEN NULL ELSE c_mktsegment END AS b, c_custkey % 3 > 0 AS bad FROM customer""")
def csv_ragged(spark, sf_dir):
    k = F.col("c_custkey")
    more = F.when(k % 3 == 0, F.concat(F.lit(","), F.col("c_mktsegment"))).when(k % 3 == 2, F.concat(F.lit(","), F.col("c_mktsegment"), F.lit(",more"))).otherwise("")
    text = F.concat(F.lit('A,b\r\n"x, \r\n""'), F.col("c_name"), F.lit('"'), more, F.lit("\r\n\r\n"))
    rows = read_texts(table(spark, sf_dir, "customer").select(k.alias("id"), text.alias("text")), PAIR, "csv")["Pair"]
    return rows.select("root_ord", F.col("raw.a").alias("a"), F.col("raw.b").alias("b"), has_errors().alias("bad"))


PROPS = Manifest("props", root=Entity("Prop", "Props", fields=(Field("K"), Field("price"), Field("flag"), Field("gone"), Field("more"))))


@query("""SELECT event_id * 1048576 AS root_ord, json_extract_string(props, '$.k') AS k, value::DECIMAL(18,2)::VARCHAR || '0' AS price, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS flag, NULL::VARCHAR AS gone, props AS more FROM events""")
def json_scalar_props(spark, sf_dir):
    price = F.concat(F.col("value").cast("decimal(18,2)").cast("string"), F.lit("0"))
    flag = F.when(F.col("event_id") % 2 == 0, "true").otherwise("false")
    text = F.concat(F.lit('[{"k": 0, "PRICE": '), price, F.lit(', "Flag": '), flag, F.lit(', "gone": null, "other": [], "more": '), F.col("props"), F.lit(', "k": '), F.get_json_object("props", "$.k"), F.lit("}]"))
    rows = read_texts(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), text.alias("text")), PROPS, "json")["Prop"]
    return rows.select("root_ord", F.col("raw.K").alias("k"), *[F.col(f"raw.{c}").alias(c) for c in ("price", "flag", "gone", "more")])


def order_texts(spark, sf_dir, line: Column, whole: Callable[[Column], Column]) -> DataFrame:
    """One text an order with lines; lines in the order of their source."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_quantity", line.alias("t")).alias("s"))
    rows = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]).alias("lines"))
    return rows.select("id", whole(F.col("lines")).alias("text"))


def _json_line() -> Column:
    return F.concat(F.lit('{"l_lineNumber": '), F.col("l_linenumber").cast("string"), F.lit(', "L_PARTKEY": '), F.col("l_partkey").cast("string"), F.lit("}"))


_LINES = """WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS i FROM lineitem)"""


@query(f"""{_LINES} SELECT l_orderkey * 1048576 + 1 AS root_ord, '$[1].lineItem[' || i || ']' AS path, l_linenumber::VARCHAR AS l_linenumber, l_partkey::VARCHAR AS l_partkey FROM n""")
def json_children(spark, sf_dir):
    texts = order_texts(spark, sf_dir, _json_line(), lambda x: F.concat(F.lit('[7, {"o_code": "O", "lineItem": ['), F.array_join(x, ", "), F.lit("]}]")))
    return read_texts(texts, MANIFEST, "json")["lineitem"].select("root_ord", "path", "raw.l_linenumber", "raw.l_partkey")


@query(f"""{_LINES} SELECT l_orderkey * 1048576 AS root_ord, '$.Orders[0].LINEITEM' AS path, l_partkey::VARCHAR AS l_partkey FROM n WHERE i = 0""")
def json_single_object_child(spark, sf_dir):
    texts = order_texts(spark, sf_dir, _json_line(), lambda x: F.concat(F.lit('{"Orders": [{"LINEITEM": '), x[0], F.lit("}]}")))
    return read_texts(texts, MANIFEST, "json")["lineitem"].select("root_ord", "path", "raw.l_partkey")


@query("SELECT c_custkey * 1048576 + 2 AS root_ord, '$[2]' AS path, c_name AS a FROM customer")
def json_skips_non_objects(spark, sf_dir):
    text = F.concat(F.lit('﻿ ["x", [1], {"A": "'), F.col("c_name"), F.lit('"}, null, 1.5]'))
    rows = read_texts(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.alias("text")), PAIR, "json")["Pair"]
    return rows.select("root_ord", "path", F.col("raw.a").alias("a"))


@query(f"""{_LINES} SELECT l_orderkey * 1048576 AS root_ord, (3 + i)::BIGINT AS line, 'sales/orders/lineitem' AS path, l_linenumber::VARCHAR AS l_linenumber, l_partkey::VARCHAR AS l_partkey FROM n""")
def xml_children(spark, sf_dir):
    number, part = F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")
    line = F.concat(F.lit("\n<lineitem><skip><l_partkey>no</l_partkey></skip><l_linenumber>"), number, F.lit("</l_linenumber><L_PARTKEY>"), part, F.lit("</L_PARTKEY></lineitem>"))
    texts = order_texts(spark, sf_dir, line, lambda x: F.concat(F.lit('<sales xmlns="u">\n<orders>'), F.array_join(x, ""), F.lit("</orders></sales>")))
    return read_texts(texts, MANIFEST, "xml")["lineitem"].select("root_ord", "line", "path", "raw.l_linenumber", "raw.l_partkey")


# --- Jobs -----------------------------------------------------------------------------------------------------------

_NOW = "2026-06-01 00:00:00"
_STATUS = ["Pending", "Processing", "Succeeded", "CompletedWithRejections", "Failed", "DeadLettered"]


def job_rows(spark, sf_dir) -> DataFrame:
    """A job for each event, with a state by its id."""
    k, now = F.col("event_id"), F.to_timestamp(F.lit(_NOW))
    ago = lambda n: now - jobs.seconds(n)
    return table(spark, sf_dir, "events").select(
        k.cast("string").alias("id"), F.col("event_type").alias("dataset"), F.concat(F.lit("q"), (k % 3).cast("string")).alias("queue"), F.lit("json").alias("format"),
        F.lit("f").alias("file"), F.lit(None).cast("string").alias("requested_by"), F.lit(None).cast("string").alias("correlation_id"),
        F.element_at(F.array(*[F.lit(s) for s in _STATUS]), (k % 6 + 1).cast("int")).alias("status"), (k % 4).cast("int").alias("attempt"), F.lit(3).alias("max_attempts"),
        F.lit(30).alias("retry_base_delay_seconds"), ago(k * 10).alias("created"), F.when(k % 5 == 0, ago(k % 7 * 60 - 180)).alias("next_attempt"),
        ago(k % 50 * 100).alias("started"), F.when(k % 2 == 1, ago(k % 40 * 100)).alias("heartbeat"), F.when((k % 6).isin(2, 3), ago(k % 50 * 100 - 30)).alias("completed"),
        k.alias("records_read"), (k % 11).alias("records_rejected"), (k % 13).alias("inserted"), (k % 17).alias("updated"), F.lit(None).cast("string").alias("error"),
    )


_JOBS = f"""WITH jobs AS (SELECT event_id AS k, event_id::VARCHAR AS id, event_type AS dataset, 'q' || event_id % 3 AS queue,
    {_STATUS}[(event_id % 6 + 1)::INTEGER] AS status, (event_id % 4)::INTEGER AS attempt, 3 AS max_attempts, TIMESTAMP '{_NOW}' - to_seconds(event_id * 10) AS created,
    CASE WHEN event_id % 5 = 0 THEN TIMESTAMP '{_NOW}' - to_seconds(event_id % 7 * 60 - 180) END AS next_attempt,
    TIMESTAMP '{_NOW}' - to_seconds(event_id % 50 * 100) AS started, CASE WHEN event_id % 2 = 1 THEN TIMESTAMP '{_NOW}' - to_seconds(event_id % 40 * 100) END AS heartbeat FROM events)"""


def _now() -> Column:
    return F.to_timestamp(F.lit(_NOW))


@query(f"{_JOBS} SELECT id FROM jobs WHERE queue = 'q0' AND status IN ('Pending', 'Failed') AND (next_attempt IS NULL OR next_attempt <= TIMESTAMP '{_NOW}')")
def jobs_due(spark, sf_dir):
    return jobs.due(job_rows(spark, sf_dir), "q0", _now()).select("id")


@query(f"{_JOBS} SELECT id, 'Processing' AS status, attempt + 1 AS attempt FROM jobs WHERE queue = 'q0' AND status IN ('Pending', 'Failed') AND (next_attempt IS NULL OR next_attempt <= TIMESTAMP '{_NOW}') ORDER BY created, id LIMIT 1")
def jobs_claim(spark, sf_dir):
    rows = job_rows(spark, sf_dir)
    job = jobs.next_job(rows, "q0", _now()).first()["id"]
    return jobs.claim(rows, job, _now()).where(F.col("id") == job).select("id", "status", "attempt")


@query(f"{_JOBS} SELECT id, dataset, status FROM jobs WHERE dataset = (SELECT min(dataset) FROM jobs) ORDER BY created DESC, id LIMIT 100")
def jobs_list_top(spark, sf_dir):
    rows = job_rows(spark, sf_dir)
    return jobs.listed(rows, rows.agg(F.min("dataset")).first()[0]).select("id", "dataset", "status")


@query(f"""{_JOBS} SELECT id, CASE WHEN attempt >= 3 THEN 'DeadLettered' ELSE 'Failed' END AS status,
    CASE WHEN attempt < 3 THEN (30 * pow(2, greatest(attempt - 1, 0)))::BIGINT END AS wait_seconds FROM jobs WHERE status = 'Processing'""")
def jobs_fail_transition(spark, sf_dir):
    rows = job_rows(spark, sf_dir).where("status = 'Processing'").withColumns(jobs.failed_columns(_now()))
    return rows.select("id", "status", (F.unix_timestamp("next_attempt") - F.unix_timestamp(_now())).alias("wait_seconds"))


@query(f"""{_JOBS} SELECT id, CASE WHEN status = 'Processing' AND coalesce(heartbeat, started) < TIMESTAMP '{_NOW}' - INTERVAL 1800 SECOND
    THEN CASE WHEN attempt >= 3 THEN 'DeadLettered' ELSE 'Pending' END ELSE status END AS status FROM jobs""")
def jobs_reclaim(spark, sf_dir):
    return jobs.reclaim(job_rows(spark, sf_dir), _now(), 1800).select("id", "status")


@query("SELECT event_id::VARCHAR AS id, CASE WHEN event_id % 11 > 0 THEN 'CompletedWithRejections' ELSE 'Succeeded' END AS status FROM events WHERE event_id % 6 = 1 AND event_id % 4 = 1 AND event_id <= 60")
def jobs_status(spark, sf_dir):
    # All jobs of the table are completed; the SQL asks for some.
    return jobs_status_all(spark, sf_dir).where("id % 6 = 1 AND id % 4 = 1 AND id <= 60")


@query(f"""{_JOBS} SELECT id, CASE WHEN status <> 'Processing' OR attempt <> 1 THEN status WHEN k % 11 > 0 THEN 'CompletedWithRejections' ELSE 'Succeeded' END AS status FROM jobs""")
def jobs_status_all(spark, sf_dir):
    rows = job_rows(spark, sf_dir)
    mine = rows.where("status = 'Processing' AND attempt = 1").select("id", "attempt", F.lit(1).alias("read"), F.col("records_rejected").alias("rejected"), F.lit(0).alias("inserted"), F.lit(0).alias("updated"))
    # Only the attempt that holds the job may complete it.
    late = mine.withColumns({"attempt": F.lit(2), "rejected": F.lit(1).cast("long")})
    return jobs.complete_all(rows, mine.unionByName(late), _now()).select("id", "status")


@query("SELECT event_id::VARCHAR AS id, event_id % 4 - 1 AS attempt FROM events WHERE event_id = 7")
def jobs_release(spark, sf_dir):
    return jobs_release_all(spark, sf_dir).where("id = '7' AND status = 'Pending'").select("id", "attempt")


@query(f"""{_JOBS} SELECT id, CASE WHEN k = 7 THEN 'Pending' ELSE status END AS status, (CASE WHEN k = 7 THEN attempt - 1 ELSE attempt END)::BIGINT AS attempt FROM jobs""")
def jobs_release_all(spark, sf_dir):
    return jobs.release(job_rows(spark, sf_dir), "7", 3).select("id", "status", F.col("attempt").cast("long").alias("attempt"))


@query("SELECT event_type AS kind, ts AS at, event_id AS seq FROM events WHERE user_id = (SELECT min(user_id) FROM events) ORDER BY ts, event_id")
def events_timeline(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    first = rows.agg(F.min("user_id")).first()[0]
    log = rows.select(F.col("user_id").cast("string").alias("job_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))
    return jobs.timeline(log, str(first)).select("kind", "at", "seq")


@query()
def metrics_summary(spark, sf_dir):
    return jobs.metrics(job_rows(spark, sf_dir))


def _folder(spark: SparkSession) -> str:
    """For files of one query: in the cluster's shared folder, or on this machine where Spark runs on it alone."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='strata-')}/q-{uuid.uuid4().hex}"


@query("SELECT o_orderkey::VARCHAR AS order_number, o_totalprice::DECIMAL(18,2)::DOUBLE AS total FROM orders")
def import_parquet(spark, sf_dir):
    """A whole import: read, validate, split, merge and commit, twice; the second only updates."""
    from strata.engine import Engine

    entity = Entity("O", "O", natural_key=("o_orderkey",), fields=(Field("o_orderkey", required=True), Field("o_totalprice", type=Kind.DECIMAL)))
    folder = _folder(spark)
    engine = Engine(spark, folder).add_dataset(Manifest("o", root=entity))
    table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice")).write.parquet(f"{folder}/in.parquet")
    for _ in range(2):
        job = engine.import_file(f"{folder}/in.parquet", "o")
    if job["status"] != "Succeeded" or job["inserted"] or job["updated"] != job["records_read"]:
        raise AssertionError(job)
    return engine.table("o", "O").select(F.col("o_orderkey").alias("order_number"), F.col("o_totalprice").cast("double").alias("total"))


@query("SELECT n_name AS name, n_regionkey::VARCHAR AS region FROM nation")
def stream_file_drop(spark, sf_dir):
    """Files of a folder imported by a streaming query."""
    from pathlib import Path

    from strata.engine import Engine
    from strata.streaming.drop import watch

    entity = Entity("N", "N", natural_key=("name",), fields=(Field("name", required=True), Field("region")))
    folder = _folder(spark)
    engine = Engine(spark, folder).add_dataset(Manifest("n", root=entity))
    local = folder.removeprefix("file://").removeprefix("file:")
    Path(f"{local}/in").mkdir(parents=True)
    for i, rows in enumerate([table(spark, sf_dir, "nation").where(f"n_nationkey % 2 = {i}").collect() for i in (0, 1)]):
        Path(f"{local}/in/{i}.csv").write_text("Name,Region\n" + "".join(f'"{r["n_name"]}",{r["n_regionkey"]}\n' for r in rows))
    watch(engine, f"{local}/in", "n", f"{local}/stream").awaitTermination()
    return engine.table("n", "N").select("name", "region")
