"""Toxicity: a linear classifier of character n-grams, scaled by naive Bayes log-count ratios.

Texts are lower-cased; every run of 3 to 6 characters is a feature, hashed to 2^20 slots. r = log of the share of
toxic documents that hold an n-gram over the share of clean ones, smoothed. A document's features are the r of the
n-grams that it holds; logistic regression on them gives the weights. A score looks up weight x r of each n-gram of
the whole text, so a document's length costs time but doesn't dilute what it says.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import documents, filter_batches, let_go, map_batches

SLOTS, SIZES = 1 << 20, (3, 4, 5, 6)
#: Rows of each label that the model is fitted on at most, chosen by a hash. A feature counts if the likelihood ratio of
#: its counts says more than EVIDENCE, which by chance some 60 of all slots would. Few labelled rows can't say that much:
#: the FEWEST features that say most count if they say more than HINT.
MOST_ROWS, EVIDENCE, FEWEST, HINT = {1: 8000, 0: 16000}, 8.0, 1024, 4.0
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
#: Characters that are hashed at once.
_CHUNK = 1 << 18
#: Features of rows that the fit takes at once, of which it holds some doubles each.
_AT_ONCE = 1 << 20


def slots(text: str):
    """Arrays of the slots of the text's n-grams, with repeats, some characters at a time."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    for at in range(0, max(1, len(codes) - SIZES[0] + 1), _CHUNK):
        part = codes[at : at + _CHUNK + SIZES[-1] - 1]
        with np.errstate(over="ignore"):
            rolled = np.zeros(len(part), np.uint64)
            for n in range(1, SIZES[-1] + 1):
                if len(part) < n:
                    break
                rolled = rolled[: len(part) - n + 1] * np.uint64(0x100000001B3) + (part[n - 1 :] + np.uint64(n)) * _MULTIPLY
                if n >= SIZES[0]:
                    yield ((rolled[:_CHUNK] * _MULTIPLY) >> np.uint64(44)).astype(np.int64)


def _held(text: str, table: np.ndarray) -> np.ndarray:
    """The distinct slots of a text whose entry of table isn't zero."""
    parts = [x[table[x] != 0] for x in slots(text)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def _sample(docs: DataFrame, labels: DataFrame, most: dict[int, int]) -> DataFrame:
    """toxic, text of the labelled documents to fit on; the list of their ids is bounded by the sum of most. Only ids
    that are in docs take up places, and of rows with one id the least text counts."""
    one = labels.where("doc_id is not null and toxic is not null").join(docs.select("doc_id"), "doc_id", "left_semi")
    one = one.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = None
    for label, n in most.items():
        part = one.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = part if picked is None else picked.unionByName(part)
    return docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")


def _fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, ratio: np.ndarray, strength: float = 1.0, rounds: int = 60, kept: int = 8) -> tuple[np.ndarray, float]:
    """Logistic regression on the ratios of each row's features, by limited-memory BFGS. rows: in parts, the rows'
    features one after the other, and how many each row has."""
    parts, first = [], 0
    for at, sizes in rows:
        ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], _AT_ONCE)), (0, len(sizes))))
        parts += [(first + i, first + j, at[ends[i] : ends[j]], sizes[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        first += len(sizes)

    def loss(x):
        w, total, g = x[:-1] * ratio, strength / 2 * float(x[:-1] @ x[:-1]), np.zeros(len(x))
        for i, j, some, n in parts:
            row = np.repeat(np.arange(j - i), n)
            z = np.bincount(row, w[some], j - i) + x[-1]
            e = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[i:j]
            total += float((np.logaddexp(0, z) - y[i:j] * z).sum())
            g[:-1] += np.bincount(some, e[row], len(ratio))
            g[-1] += e.sum()
        g[:-1] = g[:-1] * ratio + strength * x[:-1]
        return total, g

    x = np.append(np.zeros(len(ratio)), np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    value, g = loss(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(g).max() < 1e-6 * len(y):
            break
        d, alphas = -g, []
        for s, t in reversed(pairs):
            alphas.append(float(s @ d) / float(s @ t))
            d -= alphas[-1] * t
        d *= float(pairs[-1][0] @ pairs[-1][1]) / float(pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, float(np.abs(g).max()))
        for (s, t), alpha in zip(pairs, reversed(alphas), strict=True):
            d += (alpha - float(t @ d) / float(s @ t)) * s
        step, slope = 1.0, float(g @ d)
        while (found := loss(x + step * d))[0] > value + 1e-4 * step * slope and step > 1e-6:
            step /= 2
        if step <= 1e-6:
            break
        s, t = step * d, found[1] - g
        x, (value, g) = x + s, found
        if float(s @ t) > 1e-12:
            pairs = [*pairs, (s, t)][-kept:]
    return x[:-1], float(x[-1])


def fit(docs: DataFrame, labels: DataFrame, most: dict[int, int] | None = None) -> tuple[np.ndarray, float]:
    """(weight x ratio by slot, bias). docs: doc_id, text; labels: doc_id, toxic. Without both labels: zeros and the
    log odds that there are. The driver holds counts of SLOTS slots and, of the sampled rows, every feature that counts."""
    most = most or MOST_ROWS
    sample = _sample(docs, labels, most)

    def count(batches):
        found, rows = np.zeros((2, SLOTS), np.int32), np.zeros(2, np.int64)
        ones = np.ones(SLOTS, np.int8)
        for batch in batches:
            for label, text in zip(batch["toxic"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found[label, _held(text or "", ones)] += 1
                rows[label] += 1
        for label in (0, 1):
            at = np.flatnonzero(found[label])
            # Slot -1 counts documents.
            yield pa.RecordBatch.from_pydict({"toxic": pa.array(np.full(len(at) + 1, label, np.int32)), "slot": pa.array(np.append(at, -1).astype(np.int32)), "n": pa.array(np.append(found[label, at], rows[label]).astype(np.int64))})

    of = [F.coalesce(F.sum(F.when(F.col("toxic") == i, F.col("n"))), F.lit(0)).cast("int").alias(f"n{i}") for i in (0, 1)]
    counted = sample.mapInArrow(count, "toxic int, slot int, n long").groupBy("slot").agg(*of)
    counts, rows = np.zeros((2, SLOTS), np.float32), np.zeros(2)
    got = counted.where("n0 + n1 > 2 or slot < 0").toArrow()
    slot = got["slot"].to_numpy()
    for label in (0, 1):
        n = got[f"n{label}"].to_numpy()
        counts[label, slot[slot >= 0]] = n[slot >= 0]
        rows[label] = n[slot < 0].sum()
    bias = float(np.log((rows[1] + 0.5) / (rows[0] + 0.5)))
    if not rows.all():
        return np.zeros(SLOTS, np.float32), float(np.clip(bias, -5, 5))
    share = (counts + 0.5) / (rows[:, None] + 1)
    ratio = np.log(share[1] / share[0])
    # How much a feature tells: the likelihood ratio of its counts under two shares and under one.
    both = (counts.sum(0) + 0.5) / (rows.sum() + 1)
    tells = sum(counts[i] * np.log(share[i] / both) + (rows[i] - counts[i]) * np.log((1 - share[i] + 1e-9) / (1 - both + 1e-9)) for i in (0, 1))
    tells[counts.sum(0) < 3] = 0
    kept = np.flatnonzero(tells > max(HINT, min(EVIDENCE, np.partition(tells, -FEWEST - 1)[-FEWEST - 1])))
    # Numbers of features, as short as they can be: the list of all rows' features is what the driver holds.
    kind, signed = (np.uint16, np.int16) if len(kept) < 1 << 16 else (np.int32, np.int32)
    place, is_kept = np.zeros(SLOTS, signed), np.zeros(SLOTS, bool)
    place[kept], is_kept[kept] = np.arange(len(kept)).astype(kind).view(signed), True
    shared = docs.sparkSession.sparkContext.broadcast((place, is_kept))

    def features(batch: pa.RecordBatch) -> dict:
        numbers, some = shared.value
        return {"toxic": batch["toxic"], "held": [numbers[_held(x or "", some)] for x in batch["text"].to_pylist()]}

    got = map_batches(sample, features, f"toxic int, held array<{'int' if signed == np.int32 else 'short'}>").orderBy(F.xxhash64("held"), "toxic").toArrow()
    # Views of what came: the same bits without a sign, so nothing is copied.
    listed = [x.flatten().to_numpy().view(kind) for x in got["held"].chunks]
    rows, y = list(zip(listed, [x.value_lengths().to_numpy() for x in got["held"].chunks], strict=True)), got["toxic"].to_numpy().astype(np.float64)
    del got, listed
    w, b = _fit(rows, y, ratio[kept].astype(np.float64))
    del rows
    let_go()
    out = np.zeros(SLOTS, np.float32)
    out[kept] = w * ratio[kept]
    return out, b


def probabilities(model: tuple[np.ndarray, float], texts: pa.Array) -> np.ndarray:
    table, bias = model
    z = np.array([bias + float(table[_held(x.as_py() or "", table)].sum()) for x in texts], float)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted of every row, from its whole text. Null and empty texts have no n-grams but
    two spaces, and score what the bias says. Repeated rows are scored each; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        p = probabilities(shared.value, batch["text"])
        return {"doc_id": batch["doc_id"], "score": p, "predicted": (p >= threshold).astype(np.int32)}

    return map_batches(documents(docs, id_col, text_col), run, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    return filter_batches(docs, lambda batch: probabilities(shared.value, batch[text_col]) < threshold)
