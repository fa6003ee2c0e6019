"""I-Match document fingerprints, in DataFrame operations only.

Terms are the lower-cased words. The lexicon keeps those whose document frequency lies in a band, that is, whose
inverse document frequency does. A document's distinct lexicon terms are sorted and hashed whole, and once more for
each of several random subsets of the lexicon, dense and sparse ones, so that a small change leaves some of the hashes
as they are. Document frequencies count every document.

A term in the band occurs in at least ``rare`` of all documents, so the lexicon holds at most (mean distinct terms
of a document) / rare terms, however many documents there are. It goes to the executors as one value: a hash table of
term hashes. The chance that two terms of a corpus share a 64-bit hash is negligible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import SPACE, checkpointed, documents

#: A term of the lexicon is in at least the first and at most the second share of all documents.
RARE, COMMON = 0.001, 0.1
#: (parts, subsets): each level deals the lexicon at random into parts; so many of them are subsets.
LEVELS = ((4, 1), (32, 8), (256, 16), (2048, 24))
TABLE = 1 << 15
#: Stands for the hash of a subset in which a document has no term.
NONE = "-"


def term_hashes(text: Column) -> Column:
    """Hashes of the distinct terms."""
    found = F.filter(F.split(F.lower(text), f"{SPACE}+"), lambda w: w != "")
    return F.array_distinct(F.transform(found, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, rare: float = RARE, common: float = COMMON) -> DataFrame:
    """term: hashes of the terms whose document frequency is in the band, and is two or more."""
    n = docs.count()
    terms = docs.select(F.explode(term_hashes(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return checkpointed(terms.where((F.col("df") >= max(2, rare * n)) & (F.col("df") <= max(2, common * n))).select("term"))


def _table(terms: DataFrame) -> Column:
    """The lexicon as one array of TABLE arrays: a scalar subquery."""
    slots = terms.groupBy(F.pmod("term", F.lit(TABLE)).alias("slot")).agg(F.collect_list("term").alias("terms"))
    whole = terms.sparkSession.range(TABLE).join(slots, F.col("id") == F.col("slot"), "left")
    rows = F.array_sort(F.collect_list(F.struct("id", F.coalesce("terms", F.array().cast("array<bigint>")).alias("terms"))))
    return whole.agg(F.transform(rows, lambda r: r["terms"]).alias("t")).scalar()


def _hash(terms: Column, digits: int = 8) -> Column:
    return F.when(F.size(terms) > 0, F.lower(F.right(F.lpad(F.hex(F.xxhash64(terms)), 16, "0"), F.lit(digits)))).otherwise(NONE)


def _in_subset(shift: int, parts: int, part: int):
    return lambda h: F.shiftrightunsigned(h, shift).bitwiseAND(parts - 1) == part


def _below(shift: int, parts: int, some: int):
    return lambda h: F.shiftrightunsigned(h, shift).bitwiseAND(parts - 1) < some


def with_fingerprint(df: DataFrame, text: str, terms: DataFrame, name: str) -> DataFrame:
    """df with the array of a text column's hashes: of the lexicon terms, then of those in each subset. A text
    without a lexicon term has the hash of all its terms instead, so equal texts, also empty ones, agree."""
    df = df.withColumn("__table", _table(terms)).withColumn("__all", term_hashes(F.col(text)))
    held = F.filter("__all", lambda h: F.array_contains(F.element_at("__table", (F.pmod(h, F.lit(TABLE)) + 1).cast("int")), h))
    df = df.withColumn("__band", F.array_sort(held)).drop("__table")
    whole = F.when(F.size("__band") > 0, _hash(F.col("__band"), 16)).otherwise(F.concat(F.lit("a"), F.lower(F.hex(F.xxhash64(F.array_sort("__all"))))))
    subsets, shift, made = [], 16, ["__all", "__band"]
    for parts, some in LEVELS:
        df = df.withColumn(level := f"__in{parts}", F.filter("__band", _below(shift, parts, some)))
        subsets += [_hash(F.filter(level, _in_subset(shift, parts, g))) for g in range(some)]
        made.append(level)
        shift += parts.bit_length() - 1
    return df.withColumn(name, F.array(whole, *subsets)).drop(*made)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets in which either text has a term."""
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != NONE) | (y != NONE)), lambda x: x))
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != NONE) & (x == y)), lambda x: x))
    return equal.cast("double") / either


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: float = RARE, common: float = COMMON) -> DataFrame:
    """doc_id, fingerprint (hashes joined by colons) of every row. Null texts count as empty; repeated rows have one
    row each; other columns are ignored; an empty table gives no rows."""
    rows = documents(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    found = with_fingerprint(rows, "text", lexicon(rows, rare, common), "fingerprint")
    return found.select("doc_id", F.array_join("fingerprint", ":").alias("fingerprint"))


def _ranges(rows: DataFrame, parts: int) -> DataFrame:
    """rows with part: ranges of descending doc_id. An id with very many rows has several, by the hash of the text;
    so have null ids, which come last."""
    bounds = sorted(rows.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts), reverse=True) if parts > 1 else []
    cuts = F.array(*[F.lit(int(x)) for x in bounds]).cast("array<bigint>")
    share = F.shiftrightunsigned("h", 12) / F.lit(float(1 << 52))
    same = F.size(F.filter(cuts, lambda x: x == F.col("doc_id")))
    part = F.size(F.filter(cuts, lambda x: x > F.col("doc_id"))) + F.floor(share * (same + 1))
    return rows.withColumn("part", F.when(F.col("doc_id").isNull(), len(bounds) + 1 + F.floor(share * 16)).otherwise(part).cast("int"))


def with_next(rows: DataFrame, parts: int, add=lambda df: df) -> DataFrame:
    """rows (doc_id, text) with the columns next_*: those of the next row by descending doc_id, the last row's being
    the first one's. Rows of equal id are ordered by a hash of the text.

    The order is cut into ranges. The first row of each range is sent to the range before as well, so each range
    finds its next rows by itself, and texts are shuffled once. The driver holds one id and hash for each range.
    ``add`` adds columns after the shuffle.
    """
    spark = rows.sparkSession
    keyed = _ranges(rows.withColumn("h", F.xxhash64("text")), 4 * parts)
    order = F.struct(F.col("doc_id").isNull().alias("z"), (-F.col("doc_id")).alias("i"), "h")
    firsts = sorted(keyed.groupBy("part").agg(F.min(order).alias("k")).collect(), key=lambda r: r["part"])
    if not firsts:
        firsts_df = spark.createDataFrame([], "i long, k long, ghost int")
    else:
        cells = [(r["k"]["i"], r["k"]["h"], firsts[j - 1]["part"]) for j, r in enumerate(firsts)]
        values = ", ".join(f"({'CAST(NULL AS BIGINT)' if i is None else f'{i}L'}, CAST('{h}' AS BIGINT), {g})" for i, h, g in cells)
        firsts_df = spark.sql(f"SELECT * FROM VALUES {values} AS t(i, k, ghost)")
    keyed = keyed.join(F.broadcast(firsts_df), F.expr("-doc_id <=> i AND h = k"), "left").drop("i", "k")
    own = F.struct(F.col("part"), F.lit(False).alias("ghost"))
    sent = F.when(F.col("ghost").isNotNull(), F.array(own, F.struct(F.col("ghost").alias("part"), F.lit(True).alias("ghost")))).otherwise(F.array(own))
    dealt = keyed.select(*rows.columns, "h", F.explode(sent).alias("at")).select(*rows.columns, "h", "at.part", "at.ghost")
    dealt = add(dealt.repartition(parts, "part"))
    window = Window.partitionBy("part").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "h")
    extra = [c for c in dealt.columns if c not in ("h", "part", "ghost")]
    return dealt.select("ghost", *extra, *[F.lead(c).over(window).alias(f"next_{c}") for c in extra]).where("NOT ghost").drop("ghost")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: float = RARE, common: float = COMMON) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row: the
    edited text has its last third, by code points, replaced by as much of the start of the next document, by
    descending doc_id. Null texts count as empty; null ids come last."""
    rows = documents(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    terms = lexicon(rows, rare, common)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = with_next(rows, parts, lambda df: with_fingerprint(df, "text", terms, "f"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    found = found.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)))
    found = found.select("doc_id", n.cast("long").alias("n_chars"), "edited", "f", "next_f")
    found = with_fingerprint(found, "edited", terms, "e")
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.array_join("f", ":").alias("fingerprint"),
        F.array_join("e", ":").alias("edited_fingerprint"), likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("next_f")).alias("near_next"),
    )
