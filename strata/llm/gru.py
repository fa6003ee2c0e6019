"""Language-model scores by a gated recurrent unit, beside a unigram base.

Tokens are words, A-Z lower-cased, and one end for each document. Counts, and with them the base, the classes and
what a rare word gets, cover every training document. The output is class-factored: the most frequent words are in
classes, P(word) = P(class) P(word in class), of which those of frequent words are small, as a token costs a logit for
each class and each word in its own; all others are one last class, in which a word's share is
its smoothed count. How many words are in classes grows with the corpus. The recurrent weights are fitted in numpy by
truncated backpropagation: first weights come from a small sample, then every training document is read once, whole,
in ROUNDS rounds; in a round each partition goes on from the same weights and their mean, by tokens, is what the next
begins with. In scoring the state is carried from window to window, so a score is the
log-likelihood of the whole document.

Counts of words that make up over 1 / MOST_FREQUENT of the corpus, of which there cannot be more than
MOST_FREQUENT, go to every executor; a document's other words are joined to their counts by hash.
"""

from __future__ import annotations

import copy
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import checkpointed, documents, map_batches

#: Bound of the words whose counts are broadcast, two numbers whose product is the least words in classes, width of the state.
MOST_FREQUENT, CLASSES, CLASS_SIZE, STATE = 1 << 18, 32, 32, 16
#: Documents and tokens of each that the first recurrent weights are fitted on at most; steps of backpropagation.
MOST_DOCS, MOST_TOKENS, STEPS = 3000, 200, 25
#: Rounds that share out the training documents; sequences stepped together, and their rate; tokens held at once, and
#: weights in a row of those that are averaged.
ROUNDS, LANES, RATE, AT_ONCE, PIECE = 2, 512, 0.01, 1 << 21, 8192
#: States whose class logits are held at once, few enough for a processor's cache; bytes of words hashed at once, and
#: tokens counted at once.
ROWS, BYTES, COUNTED = 2048, 1 << 18, 1 << 21
_SPACES = np.zeros(256, bool)
_SPACES[[32, *range(9, 14)]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


@lru_cache(4)
def _times(n: int) -> np.ndarray:
    """A random odd factor of each of n places in a word."""
    with np.errstate(over="ignore"):
        return _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


#: The end token's hash; that of a word is it with a chance of 2^-64.
END = int(_mixed(np.zeros(1, np.uint64) + np.uint64(5)).view(np.int64)[0])


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' 64-bit hashes, text after text, and how many each text has. A word's is the sum of its bytes, each
    times a random odd number of its place, mixed: two words agree with a chance of 2^-57 at most."""
    data = [x.encode("utf-8", "surrogatepass") for x in texts]
    whole = np.frombuffer(b"\n".join([*data, b""]).lower(), np.uint8)
    word = ~_SPACES.take(whole)
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    text = np.searchsorted(np.cumsum(np.fromiter(map(len, data), np.int64, len(data)) + 1), starts, "right")
    sums, a = np.empty(len(starts), np.uint64), 0
    times = _times(1 << int(lengths.max(initial=1)).bit_length())
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + BYTES)))
        cut = slice(int(starts[a]), int(starts[b - 1] + lengths[b - 1]))
        mine, n = whole[cut][word[cut]].astype(np.uint64), lengths[a:b]
        first = np.cumsum(n) - n
        mine += np.uint64(1)
        mine *= times.take(np.arange(len(mine)) - np.repeat(first, n))
        sums[a:b] = np.add.reduceat(mine, first)
        a = b
    out = np.full(len(starts) + len(texts), END, np.int64)
    out[np.arange(len(starts)) + text] = _mixed(sums + np.uint64(5)).view(np.int64)
    return out, np.bincount(text, minlength=len(texts)) + 1


def _parts(batch: pa.RecordBatch, most: int):
    """The batch's texts in lists of about so many characters, one text at least."""
    held, size = [], 0
    for text in batch["text"]:
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def count(docs: DataFrame) -> DataFrame:
    """h, c: how often each token is in the documents (doc_id, text), by its hash."""

    def run(batches):
        def rows():
            found, where = np.unique(np.concatenate(held), return_inverse=True)
            return found, np.bincount(where, np.concatenate(times)).astype(np.int64)

        held, times, size, most = [], [], 0, COUNTED
        for batch in batches:
            for texts in _parts(batch, 8 * BYTES):
                found, n = np.unique(hashed(texts)[0], return_counts=True)
                held.append(found)
                times.append(n)
                size += len(found)
                if size > most:
                    held, times = ([x] for x in rows())
                    size = len(held[0])
                    if 2 * size > most:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(times[0])], names=["h", "c"])
                        held, times, size = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, rows())), names=["h", "c"])

    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c > 0")


#: Logits up to here need no shift before exp in single precision.
SAFE = 60.0


def _safe(w: np.ndarray, starts) -> np.ndarray:
    """For each class of columns from starts on, whether no logit of it is over SAFE: states are within -1 and 1, so the
    weights bound the logits."""
    return np.maximum.reduceat(np.abs(w[:-1]).sum(axis=0) + w[-1], starts) <= SAFE


def _exp_logits(h: np.ndarray, w: np.ndarray, held: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp of h @ w up to a factor a row, the logits of the places held, and the sums of the rows, both up to the same
    factor. Where all logits are safe, no row needs its maximum found."""
    e = h @ w
    if not safe:
        e -= e.max(axis=1, keepdims=True)
    mine = e.ravel().take(np.arange(0, e.size, e.shape[1]) + held)
    np.exp(e, out=e)
    return e, mine, e @ np.ones(e.shape[1], e.dtype)


def class_starts(shares: np.ndarray) -> np.ndarray:
    """Where classes begin among words of these shares of all tokens, by falling share. A class costs every token a
    logit, and its own tokens one for each of its words: the least work is where both are alike."""
    starts, share = [0], 0.0
    for i, x in enumerate(shares.tolist()):
        if share * (i - starts[-1]) >= 1:
            starts.append(i)
            share = 0.0
        share += x
    return np.array(starts, np.int64)


class Gru:
    """Weights: x (words + 1, 3 state): what a word adds to the gates; u: what the state adds; c (state + 1, classes +
    1) and w (state + 1, words, class after class): logits, the last row being the bias."""

    def __init__(self, counts: np.ndarray, tail: float, size: int | None = None, state: int = STATE, seed: int = 11):
        """counts: of the words by falling frequency; tail: of all others together; size: words in each class, else as
        class_starts has them."""
        rng = np.random.default_rng(seed)
        self.state, self.n = state, len(counts)
        held = counts + 1.0
        self.starts = np.arange(0, self.n, size) if size else class_starts(held / (held.sum() + tail + 1.0))
        self.classes, self.cuts = len(self.starts), np.append(self.starts, self.n)
        self.group = np.repeat(np.arange(self.classes + 1), np.append(np.diff(self.cuts), 1))
        mass = np.append(np.add.reduceat(held, self.starts), tail + 1.0)
        self.p = {
            "x": rng.normal(0, 0.3, (self.n + 1, 3 * state)),
            "u": rng.normal(0, state**-0.5, (state, 3 * state)),
            "c": np.append(rng.normal(0, 0.1, (state, self.classes + 1)), np.log(mass / mass.sum())[None], axis=0),
            "w": np.append(rng.normal(0, 0.1, (state, self.n)), np.log(held / mass.take(self.group[:-1]))[None], axis=0),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def step(self, ids: np.ndarray, h: np.ndarray):
        """New state after reading ids, and what backpropagation needs."""
        return self._step(self.p["x"].take(ids, axis=0), h)

    def _step(self, g: np.ndarray, h: np.ndarray):
        n = self.state
        hu = h @ self.p["u"]
        zr = g[:, : 2 * n] + hu[:, : 2 * n]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        c = zr[:, n:] * hu[:, 2 * n :]
        c += g[:, 2 * n :]
        np.tanh(c, out=c)
        return h + zr[:, :n] * (c - h), (h, hu, zr, c)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def set_flat(self, weights: np.ndarray) -> None:
        """Weights in the order of flat; none at all change nothing."""
        at = 0
        for k in sorted(self.p) if len(weights) else ():
            self.p[k] = weights[at : at + self.p[k].size].reshape(self.p[k].shape).astype(np.float32)
            at += self.p[k].size

    def _by_class(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class of each id, the order by class, and where each class begins there."""
        group = self.group.take(ids)
        order = np.argsort(group.astype(np.int16 if self.classes < 1 << 15 else np.int64), kind="stable")
        return group, order, np.concatenate(([0], np.cumsum(np.bincount(group, minlength=self.classes + 1))))

    def log_probabilities(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """ln P(class) P(word in class) of each id after each state; for the tail class P(class) alone."""
        h = np.append(h, np.ones((len(h), 1), h.dtype), axis=1)
        group, order, cuts = self._by_class(ids)
        out, safe = np.empty(len(ids)), _safe(self.p["c"], [0])[0]
        for a in range(0, len(ids), ROWS):
            b = a + ROWS
            _, mine, total = _exp_logits(h[a:b], self.p["c"], group[a:b], safe)
            out[a:b] = mine - np.log(total)
        h, within = h.take(order, axis=0), (ids - self.cuts.take(group)).take(order)
        more, safe = np.zeros(len(ids)), _safe(self.p["w"], self.starts)
        for k in np.flatnonzero(np.diff(cuts)[: self.classes]):
            a, b = cuts[k], cuts[k + 1]
            _, mine, total = _exp_logits(h[a:b], self.p["w"][:, self.cuts[k] : self.cuts[k + 1]], within[a:b], safe[k])
            more[a:b] = mine - np.log(total)
        out[order] += more
        return out

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each sequence of ids, all stepped together window by window, the longest first."""
        out = np.zeros(len(texts))
        order = np.array(sorted(range(len(texts)), key=lambda i: -len(texts[i])), np.int64)
        lengths = np.array([len(texts[i]) for i in order], np.int64)
        if not len(lengths) or not lengths[0]:
            return out
        first, most = np.cumsum(lengths) - lengths, int(lengths[0])
        ids = np.concatenate([texts[i] for i in order])
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[first[lengths > 0]] = 0  # a document begins after an end
        active = np.searchsorted(-lengths, -np.arange(most), "left")
        # By step, so that each takes a contiguous run.
        base = np.concatenate(([0], np.cumsum(active)))
        nth = np.arange(len(ids)) - np.repeat(first, lengths)
        place = base[nth] + np.repeat(np.arange(len(lengths)), lengths)
        by_step, read, total = np.empty_like(ids), np.empty_like(ids), np.empty(len(ids))
        by_step[place], read[place] = ids, before
        h, t = np.zeros((active[0], self.state), np.float32), 0
        while t < most:
            until = min(most, t + max(8, min(256, 50_000 // int(active[t]))))
            a, b = base[t], base[until]
            given, states, at = self.p["x"].take(read[a:b], axis=0), np.empty((b - a, self.state), np.float32), 0
            for n in active[t:until].tolist():
                h = self._step(given[at : at + n], h[:n])[0]
                states[at : at + n] = h
                at += n
            total[a:b] = self.log_probabilities(states, by_step[a:b])
            t = until
        out[order[lengths > 0]] = np.add.reduceat(total.take(place), first[lengths > 0])
        return out / np.log(10)

    def train(self, texts: list[np.ndarray], lanes: int = 64, rounds: int = 3, rate: float = 0.02) -> None:
        """Truncated backpropagation through STEPS steps, state carried over windows, by Adam."""
        texts = [x for x in texts if len(x)]
        if not texts:
            return
        flat = np.concatenate(texts)
        fresh = np.zeros(len(flat), bool)
        fresh[np.cumsum([0, *map(len, texts[:-1])])] = True
        before = np.append(flat[:1] * 0, flat[:-1])
        before[fresh] = 0
        lanes = max(1, min(lanes, len(flat) // STEPS, max(64, len(flat) // (100 * STEPS))))
        wide = -(-len(flat) // lanes)
        # What fills up the last lanes counts nothing.
        lay = lambda x: np.append(x, np.zeros(wide * lanes - len(x), x.dtype)).reshape(lanes, wide)
        out_ids, in_ids, new, real = lay(flat), lay(before), lay(fresh), lay(np.ones(len(flat), bool))
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        t, last = 0, rounds * -(-wide // STEPS)
        for _ in range(rounds):
            h = np.zeros((lanes, self.state), np.float32)
            for at in range(0, wide, STEPS):
                cut = slice(at, min(wide, at + STEPS))
                h, grads, words = self._window(in_ids[:, cut], out_ids[:, cut], new[:, cut], h, real[:, cut])
                t += 1
                for k, g in grads.items():
                    # Of the words, only those that were read move.
                    some = (lambda x, k=k: x.take(words, axis=0) if k == "x" else x)
                    m, v = some(moment[k][0]), some(moment[k][1])
                    m *= 0.9
                    m += 0.1 * g
                    v *= 0.99
                    g *= g
                    v += 0.01 * g
                    move = np.sqrt(v)
                    move *= 1 / np.sqrt(1 - 0.99**t)
                    move += 1e-6
                    np.divide(m, move, out=move)
                    move *= rate * (1 - 0.9 * t / last) / (1 - 0.9**t)
                    if k == "x":
                        moment[k][0][words], moment[k][1][words] = m, v
                        self.p[k][words] -= move
                    else:
                        self.p[k] -= move

    def _window(self, in_ids, out_ids, new, h, real=None):
        """Last state, gradients of the mean loss of one window over the places that are real (of x: for the words
        that were read), and these words."""
        p, n = self.p, self.state
        lanes, steps = in_ids.shape
        kind = p["x"].dtype
        keep = (~new).T.astype(kind)[:, :, None]
        read, hs = in_ids.T.ravel(), np.ones((steps, lanes, n + 1), kind)
        given, kept = p["x"].take(read, axis=0).reshape(steps, lanes, 3 * n), []
        for s in range(steps):
            h, more = self._step(given[s], h * keep[s])
            kept.append(more)
            hs[s, :, :n] = h
        hs, ids = hs.reshape(-1, n + 1), out_ids.T.ravel()
        group, order, cuts = self._by_class(ids)
        counts = np.ones(len(ids), kind) if real is None else real.T.ravel().astype(kind)
        scale = counts / kind.type(max(1.0, float(counts.sum())))

        def errors(h, w, held, scale, safe):
            """Scaled softmax of h @ w less what was held."""
            e, _, total = _exp_logits(h, w, held, safe)
            e *= (scale / total)[:, None]
            e.reshape(-1)[np.arange(0, e.size, e.shape[1]) + held] -= scale
            return e

        grads = {"c": np.zeros_like(p["c"]), "w": np.zeros_like(p["w"])}
        dh, turned, safe = np.empty((len(ids), n), kind), np.ascontiguousarray(p["c"][:n].T), _safe(p["c"], [0])[0]
        for a in range(0, len(ids), ROWS):
            b = a + ROWS
            e = errors(hs[a:b], p["c"], group[a:b], scale[a:b], safe)
            grads["c"] += hs[a:b].T @ e
            dh[a:b] = e @ turned
        by_class, within, scale = hs.take(order, axis=0), (ids - self.cuts.take(group)).take(order), scale.take(order)
        more, safe = np.zeros((len(ids), n), kind), _safe(p["w"], self.starts)
        for k in np.flatnonzero(np.diff(cuts)[: self.classes]):
            a, b = cuts[k], cuts[k + 1]
            mine = slice(self.cuts[k], self.cuts[k + 1])
            e = errors(by_class[a:b], p["w"][:, mine], within[a:b], scale[a:b], safe[k])
            grads["w"][:, mine] = by_class[a:b].T @ e
            more[a:b] = e @ p["w"][:n, mine].T
        back_to = np.empty_like(order)
        back_to[order] = np.arange(len(order))
        dh += more.take(back_to, axis=0)
        dh, gates, into = dh.reshape(steps, lanes, n), np.empty((steps, lanes, 3 * n), kind), np.empty((steps, lanes, 3 * n), kind)
        back, turned = np.zeros((lanes, n), kind), np.ascontiguousarray(p["u"].T)
        for s in range(steps - 1, -1, -1):
            prev, hu, zr, c = kept[s]
            z, r, g = zr[:, :n], zr[:, n:], gates[s]
            d = dh[s] + back
            dz = d * z
            np.multiply(dz, 1 - c * c, out=g[:, 2 * n :])
            np.multiply(dz * (1 - z), c - prev, out=g[:, :n])
            np.multiply(g[:, 2 * n :] * hu[:, 2 * n :], r * (1 - r), out=g[:, n : 2 * n])
            into[s] = g
            into[s, :, 2 * n :] *= r
            back = (d - dz + into[s] @ turned) * keep[s]
        grads["u"] = np.concatenate([x[0] for x in kept]).T @ into.reshape(-1, 3 * n)
        order = np.argsort(read.astype(np.int32), kind="stable")
        read = read.take(order)
        first = np.flatnonzero(np.diff(read, prepend=-1))
        grads["x"] = np.add.reduceat(gates.reshape(-1, 3 * n).take(order, axis=0), first, axis=0)
        for g in grads.values():
            np.clip(g, -1, 1, out=g)
        return h, grads, read[first]


class Scorer:
    """The model and the frequent words' counts, with a hash table of them."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, places: np.ndarray, model: Gru):
        """frequent: hashes; counts: of each; places: each one's id in the model (model.n: tail)."""
        self.frequent, self.counts, self.places, self.model = frequent, counts, places, model
        self.table, left = np.full(4 << max(1, len(frequent)).bit_length(), -1, np.int32), np.arange(len(frequent))
        for i in range(len(self.table)):
            at = (frequent[left] + i) & (len(self.table) - 1)
            free = self.table[at] < 0
            self.table[at[free]] = left[free]  # the last one of those with one place gets it
            left = left[self.table[at] != left]
            if not len(left):
                break

    def codes(self, found: np.ndarray) -> np.ndarray:
        """For each hash its number among the frequent ones, or else -1."""
        at = found & (len(self.table) - 1)
        out = self.table.take(at)
        left = np.flatnonzero((out >= 0) & (self.frequent.take(out, mode="clip") != found))
        while len(left):
            at[left] = at[left] + 1 & (len(self.table) - 1)
            out[left] = self.table.take(at[left])
            left = left[(out[left] >= 0) & (self.frequent.take(out[left], mode="clip") != found[left])]
        return out

    def ids(self, codes: np.ndarray) -> np.ndarray:
        """Ids in the model."""
        return np.where(codes >= 0, self.places.take(codes, mode="clip"), self.model.n).astype(np.int32)

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text's tokens."""
        found, n = hashed(texts)
        return np.split(self.ids(self.codes(found)), np.cumsum(n)[:-1])


def _learned(train: DataFrame, scorer: Scorer) -> np.ndarray:
    """The weights that a pass over every token of train (doc_id, text) leads to from the scorer's: the mean over
    partitions, by tokens. A partition holds AT_ONCE tokens, a task of the mean one piece of each partition's weights."""
    shared = train.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        s = shared.value
        model, seen, held, size = copy.deepcopy(s.model), 0, [], 0
        for batch in batches:
            for texts in _parts(batch, 8 * BYTES):
                held += s.texts(texts)
                size = sum(map(len, held))
                if size >= AT_ONCE:
                    model.train(held, LANES, 1, RATE)
                    seen, held, size = seen + size, [], 0
        if held:
            model.train(held, LANES, 1, RATE)
        if seen + size:
            flat = model.flat()
            for at in range(0, len(flat), PIECE):
                yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int64()), "n": pa.array([seen + size], pa.int64()), "w": pa.array([flat[at : at + PIECE]], pa.list_(pa.float32()))})

    def mean(rows):
        w = np.stack(rows["w"].to_list()).astype(np.float64)
        return rows[["at"]].iloc[:1].assign(w=[np.average(w, axis=0, weights=rows["n"].to_numpy())])

    pieces = train.select("text").mapInArrow(run, "at long, n long, w array<float>").groupBy("at").applyInPandas(mean, "at long, w array<double>")
    got = sorted(pieces.collect(), key=lambda r: r["at"])
    shared.unpersist()
    return np.concatenate([np.array(r["w"]) for r in got]) if got else np.zeros(0)


def fit(train: DataFrame, most_frequent: int = MOST_FREQUENT, most_docs: int = MOST_DOCS) -> tuple[Scorer, DataFrame, dict]:
    """The model, the counts (h, c) of the words that are not frequent, and totals: train_tokens, types, and both of
    the tail class. train: doc_id, text."""
    counts = checkpointed(count(train))
    n, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least = n / most_frequent
    # The end is among the frequent ones in any case.
    rows = counts.where((F.col("c") > least) | (F.col("h") == END)).toArrow().sort_by([("c", "descending"), ("h", "ascending")])
    h, c = rows["h"].to_numpy(), rows["c"].to_numpy()
    frequent, c = np.append(END, h[h != END]), np.append(c[h == END].sum(), c[h != END])
    # The words in classes grow with the root of the corpus, classes and their sizes with about its fourth root.
    held = min(len(frequent), max(CLASSES * CLASS_SIZE, math.isqrt(n)))
    model = Gru(c[:held].astype(float), float(n - c[:held].sum()))
    scorer = Scorer(frequent, c.astype(np.int64), np.minimum(np.arange(len(frequent)), held), model)
    docs = int(c[0])
    if docs:
        shared = train.sparkSession.sparkContext.broadcast(scorer)

        def sampled(batch: pa.RecordBatch) -> dict:
            cut = []
            for text, key in zip(batch["text"].to_pylist(), batch["key"].to_pylist(), strict=True):
                ids = shared.value.texts([text or ""])[0]
                at = key // 7 % max(1, len(ids) - MOST_TOKENS + 1)
                cut.append(ids[at : at + MOST_TOKENS].tolist())
            return {"key": batch["key"], "ids": cut}

        picked = train.withColumn("key", F.xxhash64("doc_id", "text")).where(F.pmod("key", F.lit(1 << 30)) < int((1 << 30) * min(1.0, 2 * most_docs / docs)))
        got = map_batches(picked.select("key", "text"), sampled, "key long, ids array<long>").orderBy("key", "ids").limit(most_docs).collect()
        model.train([np.array(r["ids"], np.int64) for r in got])
        for i in range(ROUNDS):
            some = train.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == i)
            model.set_flat(_learned(some, scorer))
    tail = {"tail_tokens": int(n - c[:held].sum()), "tail_types": int(types - held) if n else 0}
    return scorer, counts.where((F.col("c") <= least) & (F.col("h") != END)), {"train_tokens": int(n), "types": int(types)} | tail


def scores(docs: DataFrame, fitted: tuple[Scorer, DataFrame, dict], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10) of every row's whole text.

    Null and empty texts are an end alone. Without training documents every token is unknown: the base is 0 and the
    model has its first weights. Repeated rows are scored each; other columns are ignored; an empty table gives no
    rows.
    """
    scorer, rare, totals = fitted
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batch: pa.RecordBatch) -> dict:
        s = shared.value
        logs, ids, out = np.log10(s.counts + 1.0), [], {k: [] for k in ("n_tokens", "n_known", "base", "tail", "n_tail", "rare")}
        for texts in _parts(batch, 8 * BYTES):
            found, n = hashed(texts)
            codes = s.codes(found)
            mine, known = s.ids(codes), codes >= 0
            ends = np.cumsum(n)
            ids += np.split(mine, ends[:-1])
            tail, each = mine == s.model.n, np.where(known, logs.take(codes, mode="clip"), 0.0)
            sums = lambda x, at=ends - n: np.add.reduceat(x, at)
            rare = np.split(found[~known], np.cumsum(sums((~known).astype(np.int64)))[:-1])
            there = known & (s.counts.take(codes, mode="clip") > 0)
            row = (n, sums(there.astype(np.int64)), sums(each), sums(each * tail), sums(tail.astype(np.int64)), rare)
            for k, v in zip(out, row, strict=True):
                out[k] += list(v)
        return {"doc_id": batch["doc_id"], "lm": s.model.score(ids)} | out

    rows = map_batches(documents(docs, id_col, text_col), run, "doc_id long, n_tokens long, n_known long, base double, tail double, n_tail long, rare array<long>, lm double")
    rows = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
    words = rows.select("row", F.explode("rare").alias("h")).join(rare, "h")
    more = words.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + F.lit(1.0))).alias("logs"))
    logs = F.coalesce("logs", F.lit(0.0))
    all_, tail = float(totals["train_tokens"] + totals["types"] + 1), float(totals["tail_tokens"] + totals["tail_types"] + 1)
    return rows.drop("rare").join(more, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(totals["train_tokens"]).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(float(np.log10(all_)))).alias("base_score"),
        (F.col("lm") + F.col("tail") + logs - F.col("n_tail") * F.lit(float(np.log10(tail)))).alias("score"),
    )
