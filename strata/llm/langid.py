"""Language identification of code-switched text by a linear-chain conditional random field over words.

A word's features are itself (if the lexicon holds it), its affixes and its character n-grams, hashed; each has a
weight for each language, and each pair of neighbouring languages has a learned transition. Forward-backward over
all words of a text gives every word's probabilities; a document's language is the one with the largest sum.

A run of over LONGEST letters (a script without spaces, junk) is a chain of pieces, each a word, so every letter
counts. Texts are one array of code points, and all features and steps are array operations. Forward-backward cuts
long texts into segments: the products of each segment's factors give what reaches its borders, then all segments of
all texts are stepped together.
"""

from __future__ import annotations

from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import documents, filter_batches, let_go, map_batches

SLOTS = 1 << 16
#: Documents of each language that the model is fitted on, about; letters of a word at most.
MOST_DOCS, LONGEST = 300, 24
#: Letters whose features are looked up at once, words in one forward-backward, least words of a segment, and steps
#: between two normalizations.
LETTERS_AT_ONCE, AT_ONCE, SEGMENT, UNSCALED = 1 << 16, 130_000, 64, 8
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Words:
    """The words of texts: letters lower-cased, one after the other; of each word its first letter, length and text."""

    def __init__(self, texts: list[str]):
        lowered = [x.lower() for x in texts]
        codes = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        mine = _is_letter()[codes]
        edges = np.flatnonzero(np.diff(mine, prepend=False, append=False))
        starts, lengths = edges[::2], edges[1::2] - edges[::2]
        ends = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1)
        text = np.searchsorted(ends, starts, "right")
        parts = -(-lengths // LONGEST)
        if len(parts) and parts.max() > 1:
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            lengths = np.minimum(np.repeat(lengths, parts) - nth * LONGEST, LONGEST)
            text = np.repeat(text, parts)
        self.codes, self.lengths = codes[mine], lengths
        self.starts = np.cumsum(lengths) - lengths
        #: Words of each text.
        self.counts = np.bincount(text, minlength=len(texts))

    def __len__(self) -> int:
        return len(self.lengths)

    def some(self, a: int, b: int) -> Words:
        """Words a to b, of one text."""
        out = object.__new__(Words)
        out.lengths = self.lengths[a:b]
        out.starts = np.cumsum(out.lengths) - out.lengths
        first = int(self.starts[a]) if b > a else 0
        out.codes, out.counts = self.codes[first : first + int(out.lengths.sum())], np.array([b - a])
        return out

    def strings(self) -> list[str]:
        whole = self.codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return [whole[a : a + n] for a, n in zip(self.starts.tolist(), self.lengths.tolist(), strict=True)]


def words(text: str) -> list[str]:
    """Runs of letters, lower-cased, of at most LONGEST letters."""
    return Words([text]).strings()


def _slot(x: np.ndarray) -> np.ndarray:
    """Slots of hashes. SLOTS itself stands for a feature that isn't there."""
    return ((x * _A) >> np.uint64(48)).view(np.int64)


def _whole(some: Words) -> np.ndarray:
    """A hash of each word."""
    if not len(some):
        return np.zeros(0, np.uint64)
    nth = (np.arange(len(some.codes)) - np.repeat(some.starts, some.lengths)).astype(np.uint64)
    c = (some.codes + np.uint64(1)) * _A
    c ^= c >> np.uint64(29)
    return np.add.reduceat(c * (_B * (np.uint64(2) * nth + np.uint64(1))), some.starts)


def features(some: Words, lexicon: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Slots of the features, SLOTS where there is none: by letter the n-grams of 2 and 3 that begin there and the
    letter, if beyond ASCII; by word the bias, the word (if in the lexicon of sorted hashes), prefixes and suffixes."""
    with np.errstate(over="ignore"):
        c, n = np.zeros(len(some.codes) + 2, np.uint64), len(some.codes)
        np.add(some.codes, np.uint64(1), out=c[:n])
        a, b, d = c * _B, c[1:] * _C, c[2:] * _D
        ab = a[:n] + b[:n]
        two, three, own = _slot(ab + np.uint64(2)), _slot(ab + d[:n] + np.uint64(3)), np.where(c[:n] > 128, _slot(a[:n] + np.uint64(1)), SLOTS)
        last = some.starts + some.lengths - 1
        two[last] = SLOTS
        three[last] = SLOTS
        three[np.maximum(last - 1, some.starts)] = SLOTS
        whole = _whole(some)
        at = np.minimum(np.searchsorted(lexicon, whole), max(0, len(lexicon) - 1))
        held = lexicon[at] == whole if len(lexicon) else np.zeros(len(some), bool)
        by_word = [np.full(len(some), int(_slot(np.uint64([7]))[0])), np.where(held, _slot(whole + np.uint64(8)), SLOTS)]
        for tag, step, origin in ((16, 1, some.starts), (32, -1, last)):
            h = np.uint64(tag)
            for k, times in enumerate((_B, _C, _D)):
                h = h + c.take(origin + step * k, mode="clip") * times + np.uint64(1)
                by_word.append(np.where(some.lengths > k, _slot(h), SLOTS))
    return [two, three, own], by_word


def _segments(lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of sequences of these lengths: of each segment its first word, its length, its sequence and its number there."""
    size = max(SEGMENT, isqrt(int(lengths.max(initial=0))))
    parts = -(-lengths // size)
    sequence = np.repeat(np.arange(len(lengths)), parts)
    nth = np.arange(len(sequence)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(np.cumsum(lengths) - lengths, parts) + nth * size
    return first, np.minimum(np.repeat(lengths, parts) - nth * size, size), sequence, nth


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities (words, languages) of the words of sequences, one after the other, of these lengths, and what the
    words after each say of it (backward, up to a factor). Emissions and transitions are factors, not logarithms."""
    k, lengths = len(transitions), np.asarray(lengths, np.int64)
    if not len(emissions):
        return np.zeros((0, k)), np.zeros((0, k))
    first, long, sequence, nth = _segments(lengths)
    # Segments by falling length, words by their place in the segment: a step takes a contiguous run.
    order = np.argsort(-long, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    active = np.searchsorted(-long[order], -np.arange(int(long.max())), "left")  # segments longer than t
    base = np.cumsum(active) - active
    step = np.arange(len(emissions)) - np.repeat(first, long)
    place = base[step] + np.repeat(rank, long)
    e = np.empty((len(emissions), k))
    e[place] = emissions
    opening = (nth == 0)[order]  # no transition leads into these
    last = np.append(nth[1:] == 0, True)

    a = np.full((len(first), k), 1.0 / k)  # what reaches each segment from before it, and below from behind it
    b = np.ones((len(first), k))
    if not last.all():
        product = np.broadcast_to(np.eye(k), (len(first), k, k)).copy()
        for t, n in enumerate(active.tolist()):
            moved = (product[:n].reshape(-1, k) @ transitions).reshape(n, k, k)
            if not t:
                moved[opening[:n]] = np.eye(k)
            np.multiply(moved, e[base[t] : base[t] + n, None, :], out=product[:n])
            if t % UNSCALED == UNSCALED - 1:
                product[:n] /= product[:n].sum(axis=(1, 2), keepdims=True)
        product = product[rank]
        product /= product.sum(axis=(1, 2), keepdims=True)
        begin = np.flatnonzero(nth == 0)
        many = np.bincount(sequence)[sequence[begin]]
        for j in range(1, int(many.max())):
            at = begin[many > j] + j
            x = np.einsum("si,sij->sj", a[at - 1], product[at - 1])
            a[at] = x / x.sum(axis=1, keepdims=True)
        for j in range(int(many.max()) - 2, -1, -1):
            at = begin[many > j + 1] + j
            x = np.einsum("sij,sj->si", product[at + 1], b[at + 1])
            b[at] = x / x.sum(axis=1, keepdims=True)
    a, b = a[order], b[order]
    forward, backward = np.empty_like(e), np.empty_like(e)
    for t, n in enumerate(active.tolist()):
        now = a[:n] @ transitions
        if not t:
            now[opening[:n]] = a[:n][opening[:n]]
        now *= e[base[t] : base[t] + n]
        if t % UNSCALED == UNSCALED - 1:
            now /= now.sum(axis=1, keepdims=True)
        forward[base[t] : base[t] + n] = now
        a = now
    back, n_after = transitions.T.copy(), 0
    held = np.empty_like(b)
    for t in range(len(active) - 1, -1, -1):
        n = int(active[t])
        held[n_after:n] = b[n_after:n]  # segments that end here
        backward[base[t] : base[t] + n] = held[:n]
        held[:n] = (held[:n] * e[base[t] : base[t] + n]) @ back
        if t % UNSCALED == UNSCALED - 1:
            held[:n] /= held[:n].sum(axis=1, keepdims=True)
        n_after = n
    both = forward * backward
    both /= both.sum(axis=1, keepdims=True)
    return both[place], backward[place]


class Crf:
    """languages, lexicon (sorted hashes of words), weights (slots and a last row of zeros, languages) and transitions
    (log factors)."""

    def __init__(self, languages: list[str], lexicon: np.ndarray, weights: np.ndarray, transitions: np.ndarray):
        self.languages, self.lexicon, self.weights, self.transitions = languages, lexicon, weights, transitions

    def emissions(self, found: Words) -> np.ndarray:
        """(words, languages) factors, the largest of a word being 1; so many letters at a time."""
        out = np.empty((len(found), len(self.languages)))
        a = 0
        while a < len(found):
            b = max(a + 1, int(np.searchsorted(found.starts, found.starts[a] + LETTERS_AT_ONCE)))
            some = found.some(a, b)
            out[a:b] = _factors(_logs(self.weights, some, *features(some, self.lexicon)))
            a = b
        return out

    def probabilities(self, found: Words) -> np.ndarray:
        """Of each word, by forward-backward over each text."""
        return forward_backward(self.emissions(found), found.counts, np.exp(self.transitions))[0]


def _logs(weights: np.ndarray, some: Words, letters: list[np.ndarray], by_word: list[np.ndarray]) -> np.ndarray:
    """Sums of the weights of each word's features."""
    each = sum(weights.take(x, axis=0) for x in letters)
    logs = np.stack([np.add.reduceat(np.ascontiguousarray(x), some.starts) for x in each.T], axis=1)
    return logs + sum(weights.take(x, axis=0) for x in by_word)


def _factors(logs: np.ndarray) -> np.ndarray:
    return np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -30))


def train(languages: list[str], sequences: list[tuple[str, list[int]]], rounds: int = 10, strength: float = 1e-4, seed: int = 3) -> Crf:
    """Maximal likelihood of sequences (text, language of each word) by Adagrad over batches."""
    rng, n = np.random.default_rng(seed), len(languages)
    found = [Words([text]) for text, _ in sequences]
    hashed, count = np.unique(np.concatenate([_whole(x) for x in found]), return_counts=True)
    lexicon = hashed[count > 1]
    weights, transitions = np.zeros((SLOTS + 1, n)), np.zeros((n, n))
    squares, moved = np.full((SLOTS, n), 1e-2), np.full((n, n), 1.0)
    for _ in range(rounds):
        order = rng.permutation(len(sequences))
        for i in range(0, len(order), 64):
            batch = [found[j] for j in order[i : i + 64]]
            some = object.__new__(Words)
            some.codes, some.lengths = np.concatenate([x.codes for x in batch]), np.concatenate([x.lengths for x in batch])
            some.starts, some.counts = np.cumsum(some.lengths) - some.lengths, np.array([len(x) for x in batch])
            letters, by_word = features(some, lexicon)
            emissions, factors = _factors(_logs(weights, some, letters, by_word)), np.exp(transitions)
            posterior, after = forward_backward(emissions, some.counts, factors)
            truth = np.concatenate([np.array(sequences[j][1], np.int64) for j in order[i : i + 64]])
            error = posterior.copy()
            error[np.arange(len(truth)), truth] -= 1
            slots, gradient = np.concatenate([*letters, *by_word]), strength * weights[:-1]
            for k in range(n):
                mine = np.ascontiguousarray(error[:, k])
                each = np.repeat(mine, some.lengths)
                gradient[:, k] += np.bincount(slots, np.concatenate([each] * len(letters) + [mine] * len(by_word)), SLOTS + 1)[:-1] / len(batch)
            squares += gradient**2
            weights[:-1] -= 0.3 * gradient / np.sqrt(squares)
            # Expected transitions under the model against those that there are: given a word's language, the next
            # one's is in proportion to transition x emission x backward.
            to = np.delete(np.arange(len(some)), np.cumsum(some.counts) - some.counts)
            pair = factors[None] * (emissions[to] * after[to])[:, None, :]
            pair *= (posterior[to - 1] / np.maximum(pair.sum(axis=2), 1e-300))[:, :, None]
            step = pair.sum(axis=0)
            np.add.at(step, (truth[to - 1], truth[to]), -1)
            step = step / len(batch) + 1e-3 * transitions
            moved += step**2
            transitions -= 0.3 * step / np.sqrt(moved)
    return Crf(languages, lexicon, weights.astype(np.float32), transitions)


def switched(texts: dict[int, list[list[str]]], seed: int = 5) -> list[tuple[str, list[int]]]:
    """Labelled sequences: each text (a list of words) by itself, and mixtures of runs of 3 to 30 words of several
    languages."""
    rng = np.random.default_rng(seed)
    out = [(" ".join(x), [k] * len(x)) for k, some in texts.items() for x in some if x]
    flat = [(k, x) for k, some in texts.items() for x in some if len(x) > 3]
    for _ in range(len(flat) // 2 if len(texts) > 1 else 0):
        text, y = [], []
        for j in rng.integers(len(flat), size=int(rng.integers(2, 5))):
            k, x = flat[j]
            n = int(rng.integers(3, 31))
            at = int(rng.integers(max(1, len(x) - n)))
            text += x[at : at + n]
            y += [k] * len(x[at : at + n])
        out.append((" ".join(text), y))
    return out


def fit(docs: DataFrame, most_docs: int = MOST_DOCS) -> Crf | None:
    """docs: doc_id, text, lang. Fitted on the whole texts of about most_docs documents of each language, chosen by a
    hash. None if no document has both a language and a letter."""
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not rows:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sorted(rows.items()) for x in (lang, min(1.0, most_docs / n))])
    picked = docs.withColumn("key", F.xxhash64("doc_id", "text")).where(F.pmod("key", F.lit(1 << 30)) / (1 << 30) < share[F.col("lang")])
    got = sorted(picked.select("key", "lang", "text").toArrow().to_pylist(), key=lambda r: (r["key"], r["lang"], r["text"]))[: 2 * most_docs * len(rows)]
    texts = {lang: [found for r in got if r["lang"] == lang and (found := words(r["text"]))] for lang in sorted(rows)}
    languages = [lang for lang, found in texts.items() if found]
    crf = train(languages, switched({k: texts[lang] for k, lang in enumerate(languages)})) if languages else None
    del got, texts
    let_go()
    return crf


def judge(crf: Crf | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; some hundred thousand words at a time."""
    lang, score = ["und"] * len(texts), np.zeros(len(texts))
    held: list[tuple[int, str]] = []
    size = 0

    def flush():
        found = Words([x for _, x in held])
        p = crf.probabilities(found)
        some = np.flatnonzero(found.counts)
        if len(some):
            ends = np.cumsum(found.counts)
            mean = np.add.reduceat(p, (ends - found.counts)[some], axis=0) / found.counts[some, None]
            best = mean.argmax(axis=1)
            for j, k, x in zip(some.tolist(), best.tolist(), mean.max(axis=1).tolist(), strict=True):
                lang[held[j][0]], score[held[j][0]] = crf.languages[k], min(1.0, x)

    for i, text in enumerate(texts if crf is not None else ()):
        held.append((i, text.as_py() or ""))
        size += len(held[-1][1])
        if size >= 6 * AT_ONCE:
            flush()
            held, size = [], 0
    if held:
        flush()
    return lang, score


def predict(docs: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (mean probability of that language over the words) of every row, from its whole
    text. ``und`` with score 0: a text that is null or has no letter, or a model that has no language. Ties go to
    the language first by code point. Repeated rows are judged each; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        lang, score = judge(shared.value, batch["text"])
        return {"doc_id": batch["doc_id"], "lang_pred": lang, "score": score}

    return map_batches(documents(docs, id_col, text_col), run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Crf | None, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is known with a score of at least ``least``, as they are. Without a model no
    language is known, so no row stays."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def stays(batch: pa.RecordBatch) -> np.ndarray:
        lang, score = judge(shared.value, batch[text_col])
        return (np.array(lang, str) != "und") & (score >= least)

    return filter_batches(docs, stays)
