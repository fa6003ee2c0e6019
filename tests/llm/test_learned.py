"""Toxicity, language identification and language-model scores: against plain versions and held-out rows."""

import math
import random
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strata.llm import gru, langid, queries, toxicity
from strata.llm.common import bucket

SF = "/root/testdata/sf0.01"


def test_slots_do_not_depend_on_where_a_text_is_cut(monkeypatch):
    text = "".join(random.Random(1).choice("abc dé😀") for _ in range(3000))
    whole = Counter(np.concatenate(list(toxicity.slots(text))).tolist())
    monkeypatch.setattr(toxicity, "_CHUNK", 64)
    assert Counter(np.concatenate(list(toxicity.slots(text))).tolist()) == whole
    assert sum(whole.values()) == sum(len(text) + 2 - n + 1 for n in toxicity.SIZES)


def test_toxicity_on_held_out_rows(spark):
    # A tenth of the labels is toxic; a few thousand rows are needed to meet each word often enough.
    sf = "/root/testdata/sf0.1"
    found = queries.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = [[r["predicted"] for r in found if r["toxic"] == k] for k in (1, 0)]
    assert len(toxic) > 50 and sum(toxic) > 0.9 * len(toxic) and sum(clean) < 0.02 * len(clean)


def test_toxicity_from_few_labels(spark):
    """Of eleven toxic rows nine are learned from, so few n-grams can say more than EVIDENCE."""
    sf = "/root/testdata/sf0.001"
    found = queries.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1"), "doc_id").collect()
    assert len(found) == 11 and sum(r["predicted"] for r in found) >= 9


def test_toxicity_of_awkward_rows(spark):
    rows = [(i, ("you idiot " if i % 2 else "a kind word ") + f"number {i}") for i in range(60)]
    rows += [(100, None), (101, ""), (None, "idiot"), (102, "calm " * 40_000 + "idiot "), (5, rows[5][1])]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, toxic string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (3, 1), (100, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    found = toxicity.score(docs, model).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    by_id = {r["doc_id"]: r["predicted"] for r in found}
    assert by_id[None] == by_id[102] == 1 and by_id[0] == 0 and all(by_id[i] == i % 2 for i in range(60))
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, p in by_id.items() if not p}
    assert toxicity.score(docs.where("false"), model).count() == 0
    for some in (labels.where("toxic = 0"), labels.where("false")):
        assert toxicity.score(docs, toxicity.fit(docs.select("doc_id", "text"), some)).count() == len(rows)


def test_every_telling_feature_is_kept(spark):
    rng = random.Random(8)
    bad, good = ([f"{c}{rng.randint(10**7, 10**8)}" for _ in range(150)] for c in "xy")
    docs = spark.createDataFrame([(i, " ".join(rng.sample(bad if i % 2 else good, 30))) for i in range(400)], "doc_id long, text string")
    weights, _ = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int"))
    assert np.count_nonzero(weights) > 4000


def test_ids_without_a_document_take_no_place(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), F.pmod("id", F.lit(2)).alias("toxic"))
    assert toxicity._sample(docs, labels, {1: 25, 0: 25}).count() == 50


def test_scores_against_a_plain_version(spark):
    """Every n-gram that a text holds adds its weight once."""
    rng = np.random.default_rng(3)
    weights = rng.normal(0, 0.05, toxicity.SLOTS).astype(np.float32)
    texts = ["", None, "abc", "AbC abc", "é😀 \n x" * 50, "a" * 5000]

    def slot(gram):
        rolled = 0
        for n, c in enumerate(gram, 1):
            rolled = (rolled * 0x100000001B3 + (ord(c) + n) * 0x9E3779B97F4A7C15) % 2**64
        return (rolled * 0x9E3779B97F4A7C15) % 2**64 >> 44

    want = {}
    for i, t in enumerate(texts):
        padded = f" {(t or '').lower()} "
        held = {slot(padded[a : a + n]) for n in toxicity.SIZES for a in range(len(padded) - n + 1)}
        want[i] = 1 / (1 + math.exp(-(0.3 + sum(float(weights[x]) for x in held))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = toxicity.score(docs, (weights, 0.3)).collect()
    assert all(abs(r["score"] - want[r["doc_id"]]) < 1e-4 and r["predicted"] == int(r["score"] >= 0.3) for r in found) and len(found) == len(texts)


def test_the_fit_does_not_depend_on_how_much_it_takes_at_once(monkeypatch):
    rng = np.random.default_rng(9)
    sizes = rng.integers(0, 9, 50)
    at, y, ratio = rng.integers(0, 20, sizes.sum()).astype(np.int16), (rng.random(50) < 0.5).astype(float), rng.normal(size=20)
    whole = toxicity._fit([(at, sizes)], y, ratio)
    monkeypatch.setattr(toxicity, "_AT_ONCE", 7)
    cut = int(sizes[:20].sum())
    parts = toxicity._fit([(at[:cut], sizes[:20]), (at[cut:], sizes[20:])], y, ratio)
    assert np.allclose(whole[0], parts[0]) and abs(whole[1] - parts[1]) < 1e-9
    # At the optimum the gradient is zero.
    held = np.zeros((50, 20))
    np.add.at(held, (np.repeat(np.arange(50), sizes), at), 1)
    p = 1 / (1 + np.exp(-(held @ (whole[0] * ratio) + whole[1])))
    assert np.abs(ratio * (held.T @ (p - y)) + whole[0]).max() < 1e-3 and abs((p - y).sum()) < 1e-3


def test_forward_backward_sums_over_all_paths():
    rng = np.random.default_rng(1)
    t, lengths = rng.uniform(0.1, 1, (3, 3)), [4, 1, 0, 3, 4]
    flat = rng.uniform(0.1, 1, (sum(lengths), 3))
    found, _ = langid.forward_backward(flat, lengths, t)
    for e, p in zip(np.split(flat, np.cumsum(lengths)[:-1]), np.split(found, np.cumsum(lengths)[:-1]), strict=True):
        want = np.zeros((len(e), 3))
        for path in product(range(3), repeat=len(e)):
            w = math.prod(e[i, y] for i, y in enumerate(path)) * math.prod(t[a, b] for a, b in zip(path, path[1:], strict=False))
            for i, y in enumerate(path):
                want[i, y] += w
        assert np.allclose(p, want / want.sum(axis=1, keepdims=True)) if len(e) else p.shape == (0, 3)


def plain_forward_backward(e, t):
    forward, backward = [e[0] / e[0].sum()], [np.ones(e.shape[1])]
    for x in e[1:]:
        a = (forward[-1] @ t) * x
        forward.append(a / a.sum())
    for x in e[:0:-1]:
        b = t @ (x * backward[-1])
        backward.append(b / b.sum())
    both = np.array(forward) * np.array(backward[::-1])
    return both / both.sum(axis=1, keepdims=True)


def test_segments_change_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    t, lengths = np.exp(rng.normal(0, 2, (4, 4))), [500, 1, 0, 7, 131, 8, 9, 64, 0]
    flat = np.exp(-rng.uniform(0, 30, (sum(lengths), 4)))
    for size in (1, 4, 7, 64, 1000):
        monkeypatch.setattr(langid, "SEGMENT", size)
        monkeypatch.setattr(langid, "isqrt", lambda _: 1)
        found = langid.forward_backward(flat, lengths, t)[0]
        for e, p in zip(np.split(flat, np.cumsum(lengths)[:-1]), np.split(found, np.cumsum(lengths)[:-1]), strict=True):
            assert not len(e) or np.allclose(p, plain_forward_backward(e, t), atol=1e-12)


def plain_words(text):
    out, run = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            run += c
        else:
            out += [run[i : i + langid.LONGEST] for i in range(0, len(run), langid.LONGEST)]
            run = ""
    return out


def plain_features(word, lexicon):
    """The slots of one word, letter by letter."""
    m, (a, b, c, d) = (1 << 64) - 1, map(int, (langid._A, langid._B, langid._C, langid._D))
    slot = lambda x: (x * a & m) >> 48
    x = [ord(y) + 1 for y in word]
    out = [slot(7)]
    out += [slot(u * b + v * c + 2) for u, v in zip(x, x[1:], strict=False)]
    out += [slot(u * b + v * c + w * d + 3) for u, v, w in zip(x, x[1:], x[2:], strict=False)]
    out += [slot(u * b + 1) for u in x if u > 128]
    for tag, some in ((16, x), (32, x[::-1])):
        for n in range(1, min(3, len(x)) + 1):
            out.append(slot(tag + sum(u * times + 1 for u, times in zip(some[:n], (b, c, d), strict=False))))
    whole = int(langid._whole(langid.Words([word]))[0])
    return sorted(out + ([slot(whole + 8 & m)] if whole in lexicon else []))


AWKWARD = ["", " ", "Üben x, a-b ab 'abc", "12 ²³ ,;", "数据" * 40 + " İstanbul ſtraße", "a" * 24 + "b", "a" * 24 + "c", "\ud800 x\udfff", "日本語テキスト", "é́e"]


def test_words_and_features_against_plain_versions():
    found = langid.Words(AWKWARD)
    want = [plain_words(x) for x in AWKWARD]
    assert found.strings() == [w for x in want for w in x] and found.counts.tolist() == list(map(len, want))
    lexicon = np.unique(langid._whole(langid.Words(["ab abc üben"])))
    letters, by_word = langid.features(found, lexicon)
    for i, (word, a, n) in enumerate(zip(found.strings(), found.starts, found.lengths, strict=True)):
        mine = [int(x[j]) for x in letters for j in range(a, a + n)] + [int(x[i]) for x in by_word]
        assert sorted(x for x in mine if x != langid.SLOTS) == plain_features(word, set(lexicon.tolist())), word
    assert plain_features("a" * 23 + "b", set()) != plain_features("a" * 23 + "c", set())


def test_every_letter_of_a_long_run_counts():
    one, two = (np.bincount(np.concatenate([*x, *y]), minlength=langid.SLOTS + 1)[:-1] for x, y in (langid.features(langid.Words(["x" * 100 + c + "y" * 30]), np.zeros(0, np.uint64)) for c in "ab"))
    assert (one != two).any()


def test_judged_languages_against_a_plain_version(monkeypatch):
    rng = np.random.default_rng(4)
    crf = langid.Crf(["de", "en", "fr"], np.unique(langid._whole(langid.Words(["ab abc üben"]))), np.append(rng.normal(size=(langid.SLOTS, 3)), np.zeros((1, 3)), axis=0), rng.normal(size=(3, 3)))
    texts = AWKWARD + [None, "ab abc " * 300 + "üben"]
    for at_once in (1, 50, 10**6):
        monkeypatch.setattr(langid, "AT_ONCE", at_once)
        monkeypatch.setattr(langid, "LETTERS_AT_ONCE", at_once)
        lang, score = langid.judge(crf, pa.array([x and x.encode("utf-8", "replace").decode() for x in texts]))
        for text, got, p in zip(texts, lang, score, strict=True):
            found = plain_words((text or "").encode("utf-8", "replace").decode())
            if not found:
                assert got == "und" and p == 0
                continue
            logs = np.array([crf.weights[plain_features(w, set(crf.lexicon.tolist()))].sum(axis=0) for w in found])
            mean = plain_forward_backward(np.exp(logs), np.exp(crf.transitions)).mean(axis=0)
            assert got == crf.languages[mean.argmax()] and abs(p - mean.max()) < 1e-6


def test_switched_words_are_labelled_by_their_run():
    texts = {0: [["the", "house", "with", "that"] * 8] * 20, 1: [["der", "haus", "mit", "das"] * 8] * 20}
    crf = langid.train(["en", "de"], langid.switched(texts), rounds=15)
    p = crf.probabilities(langid.Words(["the house with mit das haus haus"]))
    assert p.argmax(axis=1).tolist() == [0, 0, 0, 1, 1, 1, 1] and crf.transitions[0, 0] > crf.transitions[0, 1]


def test_languages_of_held_out_rows(spark):
    found = queries.op4_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 200 and sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.97


def test_languages_of_awkward_rows(spark):
    words = {"en": "the house with that thing over there", "de": "das haus mit dem ding ist dort drüben"}
    rows = [(i, words[k], k) for i, k in enumerate(["en", "de"] * 20)] + [(100, None, "en"), (101, "12 ²³ ,;", "en"), (102, words["de"], None), (None, words["en"], "en"), (103, words["en"] * 5000, "en")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, score string")
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    found = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found.values())
    assert found[100]["lang_pred"] == found[101]["lang_pred"] == "und" and found[102]["lang_pred"] == "de" and found[None]["lang_pred"] == found[103]["lang_pred"] == "en"
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 2
    none = langid.fit(docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    assert none is None and {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"} and langid.accepted(docs, none).count() == 0
    assert langid.predict(docs.where("false"), model).count() == 0


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    model = gru.Gru(np.arange(10, 0, -1.0), 5.0, size=4, state=3)
    model.p = {k: np.asarray(v, np.float64) for k, v in model.p.items()}
    ids, new = rng.integers(0, 11, (2, 6)), np.zeros((2, 6), bool)
    before = np.roll(ids, 1, axis=1)
    new[1, 3] = True
    h0 = rng.normal(size=(2, 3))

    def loss():
        h, total = h0, 0.0
        for s in range(6):
            h = model.step(before[:, s], h * ~new[:, s, None])[0]
            total -= model.log_probabilities(h, ids[:, s].copy()).sum()
        return total / ids.size

    _, grads, words = model._window(before, ids, new, h0)
    grads["x"], some = np.zeros_like(model.p["x"]), grads["x"]
    grads["x"][words] = some
    for k, g in grads.items():
        for at in [tuple(int(rng.integers(n)) for n in g.shape) for _ in range(12)]:
            old, model.p[k][at] = model.p[k][at], model.p[k][at] + 1e-5
            up = loss()
            model.p[k][at] = old - 1e-5
            down = loss()
            model.p[k][at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-4 + 1e-3 * abs(g[at]), (k, at)


def test_probabilities_sum_to_one_and_windows_do_not_matter():
    model = gru.Gru(np.arange(10, 0, -1.0), 5.0, size=4, state=3)
    h = np.random.default_rng(3).normal(size=(1, 3)).astype(np.float32)
    assert abs(sum(math.exp(model.log_probabilities(h, np.array([i]))[0]) for i in range(11)) - 1) < 1e-5
    texts = [np.random.default_rng(i).integers(0, 11, n) for i, n in enumerate((700, 3, 0, 1, 300, 300))]
    together, alone = model.score(texts), [model.score([t])[0] for t in texts]
    assert np.allclose(together, alone, rtol=1e-4)
    plain = 0.0
    state, last = np.zeros((1, 3), np.float32), 0
    for i in texts[4]:
        state = model.step(np.array([last]), state)[0]
        plain += model.log_probabilities(state, np.array([i]))[0] / math.log(10)
        last = i
    assert abs(plain - together[4]) < 1e-3 * abs(plain)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_language_model_base_and_counts(spark, monkeypatch):
    # So few frequent words that most counts come through the join.
    monkeypatch.setattr(gru, "MOST_FREQUENT", 64)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["The", "the", "cat", "É\u00a0x", f"w{rng.randint(0, 200)}"]) for _ in range(rng.randint(0, 40)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, " \t\x0b\n"), (None, "the cat unseen"), (3, rows[3][1]), (203, "cat " * 30_000)]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, h string, base_score string")
    train = docs.where(bucket(F.col("doc_id"), 7) != 2)
    found = gru.scores(docs, gru.fit(train.select("doc_id", "text"), most_frequent=64)).collect()
    split = lambda t: [w for w in lower(t or "").translate(str.maketrans("\t\n\x0b\x0c\r", " " * 5)).split(" ") if w] + [None]
    count = Counter(w for r in train.collect() for w in split(r["text"]))
    n, v = sum(count.values()), len(count)
    want = sorted((i if i is not None else -1, len(split(t)), sum(count[w] > 0 for w in split(t)), round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in split(t)), 5)) for i, t in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in found) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 and math.isfinite(r["score"]) for r in found)
    nothing = gru.fit(train.where("false").select("doc_id", "text"))
    assert {r["base_score"] for r in gru.scores(docs, nothing).collect()} == {0.0}
    assert gru.scores(docs.where("false"), nothing).count() == 0


def test_the_model_beats_its_base_on_held_out_rows(spark):
    row = queries.op9_gru(spark, SF).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert row["s"] > row["b"]


def test_the_model_learns_from_all_training_tokens(spark, monkeypatch):
    # No sample at all, and what can be learned comes after 400 other tokens.
    monkeypatch.setattr(gru, "CLASSES", 2)
    monkeypatch.setattr(gru, "CLASS_SIZE", 2)
    rng = random.Random(6)
    docs = [(i, " ".join([f"w{rng.randint(0, 50)}" for _ in range(400)] + ["tick tock"] * 800)) for i in range(200)]
    train = spark.createDataFrame(docs, "doc_id long, text string").repartition(3, "doc_id")
    fitted = gru.fit(train, most_docs=0)
    assert fitted[0].model.n == 54  # all words, not the four that two classes of two hold
    row = gru.scores(train, fitted).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert row["s"] > 0.8 * row["b"]


def test_every_token_of_uneven_texts_is_trained_on():
    model, seen = gru.Gru(np.arange(10, 0, -1.0), 5.0, size=4, state=3), Counter()
    window = model._window

    def counted(before, ids, new, h, real=None):
        seen.update(ids[real].tolist() if real is not None else ids.ravel().tolist())
        return window(before, ids, new, h, real)

    model._window = counted
    texts = [np.random.default_rng(i).integers(0, 11, n) for i, n in enumerate((701, 3, 1, 330))]
    model.train(texts, lanes=8, rounds=1)
    assert seen == Counter(np.concatenate(texts).tolist())


def test_frequent_words_are_in_small_classes(spark, monkeypatch):
    # Equal classes of 1,024 words take 65 logits a token, 33 for a word that is in none.
    rng = np.random.default_rng(8)
    p = 1 / np.arange(1, 3001)
    docs = [(i, " ".join(f"w{j}" for j in rng.choice(3000, 300, p=p / p.sum()))) for i in range(200)]
    scorer = gru.fit(spark.createDataFrame(docs, "doc_id long, text string"), most_docs=0)[0]
    ids, made, plain = scorer.texts([t for _, t in docs]), [], gru._exp_logits

    def counted(*args):
        made.append((found := plain(*args))[0].size)
        return found

    monkeypatch.setattr(gru, "_exp_logits", counted)
    assert scorer.model.n == 1024 and np.isfinite(scorer.model.score(ids)).all()
    assert sum(made) < 50 * sum(map(len, ids))


def test_probabilities_and_gradients_of_uneven_classes():
    rng = np.random.default_rng(9)
    model = gru.Gru(np.array([90.0, 40, 30, 20, 9, 8, 7, 6, 5, 4, 3, 2, 1, 1]), 20.0, state=3)
    assert len(set(np.diff(model.cuts).tolist())) > 1 and model.cuts[-1] == model.n == 14
    model.p = {k: np.asarray(v, np.float64) + rng.normal(0, 0.3, v.shape) for k, v in model.p.items()}
    assert abs(np.exp(model.log_probabilities(np.repeat(rng.normal(size=(1, 3)), 15, axis=0), np.arange(15))).sum() - 1) < 1e-9
    ids, h0 = rng.integers(0, 15, (2, 6)), rng.normal(size=(2, 3))
    before, new, first = np.roll(ids, 1, axis=1), np.zeros((2, 6), bool), dict(model.p)

    def loss():
        h, total = h0, 0.0
        for s in range(6):
            h = model.step(before[:, s], h)[0]
            total -= model.log_probabilities(h, ids[:, s].copy()).sum()
        return total / ids.size

    _, grads, words = model._window(before, ids, new, h0)
    grads["x"] = np.zeros_like(first["x"])
    grads["x"][words] = model._window(before, ids, new, h0)[1]["x"]
    for k, g in grads.items():
        way = rng.normal(size=g.shape)
        model.p[k] = first[k] + 1e-5 * way
        up = loss()
        model.p[k] = first[k] - 1e-5 * way
        assert abs((up - loss()) / 2e-5 - (g * way).sum()) < 1e-6, k
        model.p[k] = first[k]
