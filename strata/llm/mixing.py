"""Mixing sources to target weights.

Words of a source, documents one after the other, are packed into blocks of a fixed length, shorter ones in a source
of few words, so that whole blocks come near any target. The mix is a number of
output shards; each draws how many of its slots every source fills from a multinomial over what the sources have
still to give. A source's slots are numbered through all shards; slot i is block perm(i mod n) of the source's n
blocks, where every pass over the source has a pseudorandom permutation of its own (swap-or-not, computed for one
index at a time). Slots and blocks meet in an equi-join on (source, block), so a hot source spreads over its blocks.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import SPACE, WORD, local_table

#: Rows of a source whose sizes are summed in one window, and windows whose sums are summed in the next step's; blocks
#: of a source at least; slots that are numbered at once.
CHUNK_ROWS, CHUNKS, LEAST_BLOCKS, SLOTS = 512, 4096, 64, 1 << 16
ROUNDS = 16


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> dict[str | None, Fraction]:
    """Target of each source: sources by code point, null last, have the weights in turn and share the sum of all
    sizes; none gets over ``most`` times its size, and the excess goes to the others by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    left, open_, out = Fraction(sum(sizes.values())), list(names), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] > most * sizes[s] * whole]
        if not over:
            return out | {s: left * weight[s] / whole for s in open_}
        for s in over:
            out[s] = Fraction(most * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def draw(quota: list[int], shards: int, seed: int) -> np.ndarray:
    """(shards, sources) slots. A shard's counts are multinomial over the quotas left; what a draw takes beyond a
    quota is drawn again, so that the sums are the quotas exactly."""
    rng, left = np.random.default_rng(seed), np.array(quota, np.int64)
    out = np.zeros((shards, len(quota)), np.int64)
    for g in range(shards):
        want = int(left.sum()) // (shards - g)
        while want:
            got = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[g] += got
            left -= got
            want -= int(got.sum())
    return out


def _permuted(x, n, salt):
    """Swap-or-not: in each round x changes places with its partner, or both stay, by one hash of the pair."""

    def step(at, k):
        partner = F.pmod(F.pmod(F.xxhash64(salt, k), n) + n - at, n)
        return F.when(F.pmod(F.xxhash64(salt, k, F.greatest(at, partner)), F.lit(2)) == 0, partner).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(ROUNDS).cast("long")), x, step)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    block: int = 128,
    shards: int = 64,
    most: int = 3,
    seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """(slots, pieces). slots: shard, slot, sidx, block. pieces: __row, doc_id, size, sidx, source, source_size,
    target, block, start, n: words start to start + n of a row's text lie in that block; a row without words has
    one piece with a null block. A source's blocks have ``block`` words, or a 64th of its words if that is less.

    Null texts have no words; a null source is a source of its own. The driver holds one row of sums for each source
    and shards x sources counts. Rows are placed by a hash of doc_id and size, ordered by both, so reruns agree
    however the table is split. Equal rows may change places with each other. An empty table gives empty tables.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.monotonically_increasing_id().alias("__row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    sums = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    sums.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets({r["source"]: r["size"] for r in sums}, weights, most)
    lengths = [max(1, min(block, r["size"] // LEAST_BLOCKS)) for r in sums]
    blocks = [-(-r["size"] // n) for r, n in zip(sums, lengths, strict=True)]
    quota = [round(goal[r["source"]] * n / r["size"]) if n else 0 for r, n in zip(sums, blocks, strict=True)]
    stats = local_table(
        spark,
        [(i, r["source"], r["size"], float(goal[r["source"]]), -(-r["n"] // CHUNK_ROWS), lengths[i]) for i, r in enumerate(sums)],
        "sidx int, source string, source_size long, target double, chunks long, words long",
    )
    keyed = rows.withColumnRenamed("source", "own").join(F.broadcast(stats), F.col("own").eqNullSafe(F.col("source"))).drop("own")
    keyed = keyed.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size"), F.col("chunks")))
    # Offsets of the chunks: within runs of chunks, and of the runs.
    chunk = keyed.groupBy("sidx", "chunk").agg(F.sum("size").alias("sum")).withColumn("run", F.expr(f"chunk div {CHUNKS}"))
    summed = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    run = chunk.groupBy("sidx", "run").agg(F.sum("sum").alias("sum"))
    run = run.select("sidx", "run", F.coalesce(F.sum("sum").over(summed("sidx").orderBy("run")), F.lit(0)).alias("run_offset"))
    offsets = chunk.withColumn("offset", F.coalesce(F.sum("sum").over(summed("sidx", "run").orderBy("chunk")), F.lit(0))).join(run, ["sidx", "run"])
    offsets = offsets.select("sidx", "chunk", (F.col("offset") + F.col("run_offset")).alias("offset"))
    inside = summed("sidx", "chunk").orderBy("doc_id", "size")
    placed = keyed.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["sidx", "chunk"]).withColumn("at", F.col("at") + F.col("offset"))
    spans = F.when(F.col("size") > 0, F.expr("sequence(at div words, (at + size - 1) div words)"))
    start = F.greatest(F.col("block") * F.col("words") - F.col("at"), F.lit(0).cast("long"))
    pieces = placed.withColumn("block", F.explode_outer(spans)).select(
        "__row", "doc_id", "size", "sidx", "source", "source_size", "target", "block", start.alias("start"),
        (F.least((F.col("block") + 1) * F.col("words") - F.col("at"), F.col("size")) - start).alias("n"),
    )

    counts = draw(quota, shards, seed)
    first = np.cumsum(counts, axis=0) - counts
    drawn = local_table(
        spark,
        [(g, i, int(first[g, i]), int(counts[g, i]), blocks[i]) for g in range(shards) for i in range(len(sums)) if counts[g, i]],
        "shard int, sidx int, first long, count long, blocks long",
    )
    parts = drawn.withColumn("part", F.explode(F.expr(f"sequence(0, (count - 1) div {SLOTS})")))
    parts = parts.repartition(min(4096, max(shards, int(first[-1].sum() + counts[-1].sum()) // (4 * SLOTS)) if len(sums) else 1), "shard", "sidx", "part")
    index = parts.withColumn("at", F.explode(F.expr(f"sequence(first + part * {SLOTS}, first + least(count, (part + 1) * {SLOTS}) - 1)")))
    salt = F.xxhash64(F.lit(seed), F.col("sidx"), F.expr("at div blocks"))
    slots = index.select("shard", F.col("at").alias("slot"), "sidx", _permuted(F.pmod(F.col("at"), F.col("blocks")), F.col("blocks"), salt).alias("block"))
    return slots, pieces


def _uses(slots: DataFrame) -> DataFrame:
    """How often each block is used. The planner takes what is drawn for small and would broadcast it, so the join by
    index is told to shuffle."""
    return slots.groupBy("sidx", "block").agg(F.count("*").alias("uses")).hint("merge")


def joined(slots: DataFrame, pieces: DataFrame) -> DataFrame:
    """The mix itself: for each shard and slot the pieces of the block that fills it."""
    return slots.hint("merge").join(pieces.where("block is not null"), ["sidx", "block"]).select("shard", "slot", "source", "block", "__row", "doc_id", "start", "n")


def taken(slots: DataFrame, pieces: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) of every row, from blocks joined by index."""
    return (
        pieces.join(_uses(slots), ["sidx", "block"], "left")
        .groupBy("__row", "doc_id", "size", "source_size", "target")
        .agg(F.sum(F.coalesce(F.col("n") * F.col("uses"), F.lit(0))).alias("taken"))
        .drop("__row")
    )


def mixed(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """The documents of the mix, with the columns of docs: copy c of a row holds, in order, its words in blocks that
    are used c times or more. A copy with all words keeps the text as it is; others join their words by spaces.
    Rows of which the mix takes no word go (so do texts without words)."""
    slots, pieces = mix(docs, text_col=text_col, **options)
    runs = pieces.join(_uses(slots), ["sidx", "block"]).groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("start", "n", "uses"))).alias("__runs"), F.max("uses").alias("__uses"))
    rows = docs.withColumn("__row", F.monotonically_increasing_id()).join(runs, "__row").drop("__row")
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__uses"))))
    rows = rows.withColumn("__runs", F.filter("__runs", lambda r: r["uses"] >= F.col("__copy")))
    words = F.split(F.regexp_replace(F.col(text_col), rf"^{SPACE}+|{SPACE}+$", ""), rf"{SPACE}+")
    whole = F.aggregate("__runs", F.lit(0).cast("long"), lambda s, r: s + r["n"]) == F.regexp_count(F.col(text_col), F.lit(WORD))
    part = F.array_join(F.flatten(F.transform("__runs", lambda r: F.slice(words, (r["start"] + 1).cast("int"), r["n"].cast("int")))), " ")
    rows = rows.withColumn(text_col, F.when(whole, F.col(text_col)).otherwise(part))
    if chars_col in docs.columns:
        rows = rows.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return rows.select(*docs.columns)
