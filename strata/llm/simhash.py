"""SimHash near-duplicates, with candidates pruned by the pigeonring principle.

The 64 bits of a fingerprint lie on a ring of m segments. If two fingerprints differ in at most t bits, then some
start on the ring has, for every l up to m, at most l * t / m differing bits in its first l segments. The longest
prefix whose budget is below one must be equal, so it is the key of an equi-join; each longer prefix is checked
against its budget before the whole distance is. With m = 5 and t = 2 a key has 25 or 26 bits and each
fingerprint five keys, against three keys of 21 bits by plain pigeonhole.

Equal fingerprints are merged first. A key that too many fingerprints share is refined: its free bits are cut into
t + 1 parts, one of which must be equal too. After three levels a key leaves so few free bits that its group is
bounded by itself. Within a key only a spanning forest of the links is emitted, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import checkpointed, documents, map_batches
from strata.llm.components import components

BITS = 64
#: Fingerprints that share a key, beyond which the key is refined.
CROWDED = 1024


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """A bit is set if it is set in over half of the XXH64 values of the word shingles (A-Z lower-cased)."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[: -words]))
    hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)], "<u8")
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, text_hash (of the whole text), fp (the fingerprint as a signed long) of every row."""

    def run(batch: pa.RecordBatch) -> dict:
        found = np.fromiter((fingerprint(x.as_py() or "", words) for x in batch["text"]), np.uint64, batch.num_rows)
        return {"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "fp": found.view(np.int64)}

    # Null and empty texts count as the same text.
    rows = documents(docs, id_col, text_col, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    return map_batches(rows, run, "doc_id long, text_hash long, fp long")


def ring(segments: int, most: int) -> tuple[list[int], int, list[list[tuple[int, int]]]]:
    """Masks of the join keys by start, segments in a key, and by start the (mask, budget) of each longer prefix."""
    cuts = [BITS * i // segments for i in range(segments + 1)]
    single = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(segments)]
    prefix = lambda i, n: sum(single[(i + j) % segments] for j in range(n))
    equal = max(n for n in range(segments + 1) if n * most < segments)
    if not equal:
        raise ValueError("more segments than differing bits are needed")
    return [prefix(i, equal) for i in range(segments)], equal, [[(prefix(i, n), n * most // segments) for n in range(equal + 1, segments + 1)] for i in range(segments)]


def _refined(mask: int, most: int) -> list[int]:
    """The mask with one of most + 1 parts of its free bits added."""
    free = [1 << i for i in range(BITS) if not mask >> i & 1]
    cuts = [len(free) * i // (most + 1) for i in range(most + 2)]
    return [mask | sum(free[cuts[i] : cuts[i + 1]]) for i in range(most + 1) if cuts[i + 1] > cuts[i]]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _linked(values: np.ndarray, checks: list[tuple[int, int]]) -> np.ndarray:
    """Adjacency of (..., n) values: every prefix stays in its budget, the last one being the whole ring."""
    differ = values[..., :, None] ^ values[..., None, :]
    ok = np.ones(differ.shape, bool)
    for mask, budget in checks:
        ok &= np.bitwise_count(differ & np.uint64(mask)) <= budget
    return ok


def _forest(values: np.ndarray, checks: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of k groups of n fingerprints each: (k, n) values."""
    k, n = values.shape
    label = np.broadcast_to(np.arange(n), (k, n)).copy()
    step = max(1, 2_000_000 // max(1, k * n))
    held = _linked(values, checks) if step >= n else None
    while True:
        best = label.copy()
        for i in range(0, n, step):
            if held is None:
                rows = np.ones((k, min(step, n - i), n), bool)
                differ = values[:, i : i + step, None] ^ values[:, None, :]
                for mask, budget in checks:
                    rows &= np.bitwise_count(differ & np.uint64(mask)) <= budget
            else:
                rows = held[:, i : i + step]
            best[:, i : i + step] = np.where(rows, label[:, None, :], n).min(axis=2)
        best = np.take_along_axis(best, best, axis=1)
        if (best == label).all():
            break
        label = best
    group, member = np.nonzero(label != np.arange(n))
    return values[group, member], values[group, label[group, member]]


def _links(buckets: DataFrame, checks: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """a, b: linked fingerprints, from (mask, fps) rows."""

    def run(batch: pa.RecordBatch):
        masks, lists = np.array(batch["mask"]), batch["fps"]
        offsets, flat = np.array(lists.offsets), np.array(lists.values).view(np.uint64)
        sizes = np.diff(offsets)
        for mask in np.unique(masks):
            for n in np.unique(sizes[masks == mask]):
                rows = np.flatnonzero((masks == mask) & (sizes == n))
                for i in range(0, len(rows), most := max(1, 1_000_000 // int(n * n))):
                    a, b = _forest(flat[offsets[rows[i : i + most], None] + np.arange(n)], checks[int(mask)])
                    yield {"a": a.view(np.int64), "b": b.view(np.int64)}

    return map_batches(buckets, run, "a long, b long")


def links(nodes: DataFrame, most: int = 2, segments: int = 5, crowded: int = CROWDED) -> DataFrame:
    """a, b: distinct fingerprints (column fp) that are linked by steps of at most ``most`` bits. Within each key a
    spanning forest is given, each fingerprint with the least it reaches there, so that components are whole; the two
    of a row may differ in more bits."""
    masks, _, checks = ring(segments, most)
    budgets = {_signed(m): c for m, c in zip(masks, checks, strict=True)}
    rows = nodes.select(F.explode(F.array([F.struct(F.lit(m).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"), "fp") for m in budgets])).alias("x")).select("x.*")
    found, level = [], 1
    while True:
        full = checkpointed(rows.groupBy("mask", "key").count().where(F.col("count") > crowded)) if level < 4 else None
        heavy = full is not None and not full.isEmpty()
        light = rows.join(full, ["mask", "key"], "left_anti") if heavy else rows
        buckets = light.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        found.append(_links(buckets.select("mask", "fps"), budgets))
        if not heavy:
            break
        finer = {m: [_signed(x) for x in _refined(m & (1 << 64) - 1, most)] for m in {r["mask"] for r in full.select("mask").distinct().collect()}}
        children = F.create_map(*[x for m, c in finer.items() for x in (F.lit(m), F.array([F.lit(y) for y in c]))])
        rows = (
            rows.join(full, ["mask", "key"], "left_semi")
            .select("fp", F.explode(children[F.col("mask")]).alias("mask"))
            .select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        )
        budgets = {x: [((1 << 64) - 1, most)] for c in finer.values() for x in c}
        level += 1
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 2, words: int = 3, segments: int = 5, crowded: int = CROWDED) -> DataFrame:
    """doc_id, text_hash, fp, root (the least fingerprint of its component), component_id (the least doc_id reachable
    over links, itself included) of every row.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows with equal fingerprints are one
    node, however many they are. A null doc_id never is a component's id unless the component has no other.
    Whole texts are hashed; other columns are ignored; an empty table gives no rows.
    """
    rows = checkpointed(fingerprints(docs, id_col, text_col, words))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp"), most, segments, crowded))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    rooted = checkpointed(rooted)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(ids, "root").select("fp", "root", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 2, words: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each group, as it is: that of the least doc_id, and of its texts the one of least hash.

    Texts whose fingerprints of five-word shingles are linked are candidates, each with one text of its component;
    so are texts that share a MinHash band, since a similarity of 0.8 is some ten bits of a fingerprint, for which no
    key of a ring is selective. The exact Jaccard similarity of the shingle sets decides; groups are components of
    pairs of ``least`` or more. Null and empty texts count as the same text; a group with null ids only keeps one of
    them; repeated rows are one; other columns stay, whatever their names; an empty table gives no rows.
    """
    from strata.llm import jaccard

    found = near_duplicates(docs, id_col, text_col, most, words).select("text_hash", "root").distinct()
    heads = found.groupBy("root").agg(F.min("text_hash").alias("other"))
    return jaccard.deduplicated(docs, found.join(heads, "root").where("text_hash <> other").select("text_hash", "other"), id_col, text_col, least)
