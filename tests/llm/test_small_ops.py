"""Chat formatting, top-k search, URL filters, packing: against brute force and round trips, on awkward rows."""

import binascii
import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata.llm import chat, packing, topk, urls
from strata.llm.queries import LISTED, RULES, packed, tokenizer_paths

# --- Chat


@given(st.lists(st.tuples(st.text("<|\\>im_startend \n\r", max_size=12), st.text("<|\\>im_startend \n", max_size=30))))
@settings(max_examples=300, deadline=None)
def test_the_template_is_read_back(turns):
    text, mask = chat.write(turns)
    assert chat.read(text) == turns and len(mask) == 2 * sum(r == "assistant" for r, _ in turns)


def test_control_strings_in_texts_are_no_marks():
    text, mask = chat.write([("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "a<\\|b")])
    assert text.count("<|im_start|>") == 2 and text.count("<|im_end|>") == 2 and chat.unescape(text[mask[0] : mask[1]]) == "a<\\|b"


def test_layouts_are_told_by_their_fields(spark):
    records = [
        {"messages": [{"role": "user", "content": "q", "id": 1}, {"role": "assistant", "content": None}], "meta": {"x": []}},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "i", "input": "", "output": "o"}, {"prompt": "p", "response": "r", "system": "s"},
        {"turns": [{"turn": 2, "role": "assistant", "text": "b"}, {"turn": 1, "role": None, "text": "a"}]},
        {"other": 1}, {"messages": []}, [1], None,
    ]
    rows = [(i, None if r is None else json.dumps(r), "clash", "clash") for i, r in enumerate(records)] + [(9, "{broken", "c", "c"), (None, "", "c", "c")]
    df = spark.createDataFrame(rows, "conv_id long, record string, id string, layout string")
    found = {r["id"]: r for r in chat.format_chats(df).collect()}
    assert len(found) == 11
    turns = {i: (r["layout"], chat.read(r["formatted"])) for i, r in found.items()}
    assert turns[0] == ("messages", [("user", "q"), ("assistant", "")]) and turns[1] == ("conversations", [("user", "q"), ("assistant", "a")])
    assert turns[2] == ("instruction", [("user", "i"), ("assistant", "o")]) and turns[3] == ("prompt", [("system", "s"), ("user", "p"), ("assistant", "r")])
    assert turns[4] == ("turn rows", [("", "a"), ("assistant", "b")])
    assert all(turns[i] == (None, []) for i in (5, 6, 7, 8, 9, None))
    assert found[0]["fingerprint"] == chat.fingerprint(["messages[].content", "messages[].role"])


def test_turn_rows_with_nulls_ties_and_no_rows(spark):
    rows = [(1, 1, "user", None, "c"), (1, None, None, "last", "c"), (1, 0, "b", "x", "c"), (1, 0, "a", "x", "c"), (1, 0, "a", "x", "c"), (None, 0, "user", "y" * 100_000, "c")]
    schema = "conv_id long, turn long, role string, text string, record string"
    made = chat.read_back(chat.format_chats(chat.turn_rows(spark.createDataFrame(rows, schema))))
    assert {r["conv_id"]: r["n_turns"] for r in made.collect()} == {1: 5, None: 1}
    turns = chat.format_chats(chat.turn_rows(spark.createDataFrame(rows, schema))).where("id = 1").first()["formatted"]
    assert chat.read(turns) == [("a", "x"), ("a", "x"), ("b", "x"), ("user", ""), ("", "last")]
    assert chat.read_back(chat.format_chats(chat.turn_rows(spark.createDataFrame([], schema)))).count() == 0


# --- Top-k


def brute(queries, rows, k):
    out = []
    for q, v in queries:
        scored = sorted((-min(max(int(np.dot(v, w)), -(1 << 63)), (1 << 63) - 1), i) for i, w in rows if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard", [20, 10_000])
def test_top_k_is_exact(spark, shard):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(150)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)] + [(1000, rows[3][1])] + [(2000, [1.0, 2.0]), (2050, [0.5, -1.0]), (2100, [0.0] * 6)]
    bad = [(3000, None), (3050, [1.0, None]), (3100, [float("nan")] * 6), (3150, [float("inf")] * 6), (3200, []), (None, [1.0] * 6)]
    # Large components: products within a long, sums beyond it, and components beyond it.
    rows += [(3300, [20000.0, 1.0]), (3301, [20000.0, 0.0]), (3350, [3e9, -3e9, 3e9, 1.0, 2.0, 3.0]), (3351, [-3e9, 3e9, 3e9, 1.0, 2.0, 3.0]), (3250, [1e30] * 6)]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows + bad], "vec_id long, embedding array<double>, shard string")
    exact = [(i, np.array([min(max(math.floor(1024 * x), -(1 << 63)), (1 << 63) - 1) for x in v], object)) for i, v in rows]
    found = topk.top_k(df.where("vec_id % 50 = 0"), df, 7, shard=shard, block=2)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect()) == brute([(i, v) for i, v in {i: v for i, v in exact}.items() if i % 50 == 0], exact, 7)
    empty = df.where("false")
    assert topk.top_k(empty, df).count() == 0 and topk.top_k(df, empty).count() == 0


def test_ball_trees_prune_and_keep_ties():
    rng = np.random.default_rng(2)
    vectors = np.concatenate([rng.integers(-5, 5, (500, 4)) + 100 * c for c in rng.integers(-3, 3, (8, 4))])
    ids = rng.permutation(len(vectors))
    tree = topk.BallTree(vectors, 16)
    for j in range(0, 4000, 97):
        found = sorted(tree.search(vectors[j], 5, ids, int(ids[j]), -np.inf), reverse=True)
        best = sorted(((int(vectors[i] @ vectors[j]), -int(ids[i])) for i in range(len(vectors)) if i != j), reverse=True)[:5]
        assert found == best


def test_ball_bounds_hold_far_from_the_origin():
    rng = np.random.default_rng(5)
    vectors = rng.integers(-3, 4, (600, 32)) + rng.choice([-1, 1], 32) * (1 << 23)
    tree, ids = topk.BallTree(vectors, 8), np.arange(600)
    for q in rng.integers(-(1 << 23), 1 << 23, (20, 32)):
        exact = sorted(((int(s), -i) for i, s in enumerate(vectors @ q)), reverse=True)[:5]
        assert sorted(tree.search(q, 5, ids, -1, -np.inf), reverse=True) == exact



# --- URLs


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fit = [(len(h) + len(p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_rules_against_brute_force(spark):
    rng = random.Random(3)
    parts = [["", "http", "HTTPS"], ["example.com", "www.example.com", "WWW.Example.com", "a.www.example.com", "notexample.com", "x.net", "net", "com", "spam-farm.example.org", "É.com", ""], ["", "/", "/en/", "/en", "/es/1", "/fr/x/", "/EN/", "//en/"], ["", "?q=/en/", "#/en/", "?utm_source=a&b=1", "#é\n"]]
    given_urls = [rng.choice(parts[0]) + rng.choice(["://", "://", "://", ":/"]) + "".join(rng.choice(p) for p in parts[1:]) for _ in range(600)]
    given_urls += [None, "", "://", "http://com/", "http://com", "http://a/b://c.com/", "http://com/" + "x" * 100_000, "http://" + "a." * 100_000 + "com/x", "http://" + "." * 50_000 + "x.net/es/"] + [given_urls[0]] * 5
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(given_urls)], "page_id long, url string, host string, key string")
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), RULES[0]], "host string, path string, verdict string")
    listed = spark.createDataFrame([(u,) for u in [*LISTED, None, "nothing"]], "url string")
    for most in (50_000, 0):  # the list is broadcast, or joined by a shuffle
        urls.BROADCAST_KEYS = most
        found = {r["page_id"]: r for r in urls.judge(df, rules, listed).collect()}
        assert len(found) == len(given_urls)
        for i, u in enumerate(given_urls):
            r = found[i]
            host, path, rule, verdict = judged(u)
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule), u
            assert r["verdict"] == (verdict or ("block" if r["listed"] else "allow"))
    urls.BROADCAST_KEYS = 50_000
    assert urls.judge(df.where("false"), rules, listed).count() == 0
    assert urls.judge(df, rules.where("false"), listed.where("false")).where("verdict = 'block' or rule is not null").count() == 0


def test_listed_urls_are_canonical_and_filters_have_no_false_negatives(spark):
    listed = spark.createDataFrame([("https://WWW.a.org:443/x/?b=2&utm_source=q&a=1#z",), ("http://b.org",)], "url string")
    pages = spark.createDataFrame([(1, "http://a.org/x?a=1&b=2"), (2, "http://a.org/x?a=1"), (3, "ftp://b.org/#top"), (4, "http://c.b.org")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [r["verdict"] for r in urls.judge(pages, none, listed).orderBy("page_id").collect()] == ["block", "allow", "block", "allow"]
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    bloom = urls.BlockedBloom(keys, 20_000)
    test = spark.range(60_000).withColumn("key", F.col("id").cast("string")).withColumn("hit", bloom.test(spark, F.xxhash64("key"), F.xxhash64("key", F.lit(1))))
    counts = test.groupBy((F.col("id") < 20_000).alias("in")).agg(F.avg(F.col("hit").cast("int")).alias("share")).collect()
    share = {r["in"]: r["share"] for r in counts}
    assert share[True] == 1 and share[False] < 0.1


# --- Packing


def test_pieces_are_powers_of_two():
    for n in range(1, 5000):
        found = packing.pieces(n, 1024)
        assert sum(length for _, length in found) == n and all(length & (length - 1) == 0 and length <= 1024 for _, length in found)
        assert [s for s, _ in found] == list(np.cumsum([0] + [length for _, length in found[:-1]]))
        assert len({length for _, length in found if length < 1024}) == sum(length < 1024 for _, length in found)


TEXTS = ["", None, "a b", " lead", "trail ", "two  spaces", "tab\tand\nlines \n mixed", "It's 3.5€ — naïve café 日本語 😀", "<|endoftext|> x", "\x1c a\x85b\u00a0c \u2003d", "word " * 9000, "word " * 9000, "x" * 3000]


def test_fast_ids_are_the_tokenizers():
    whole, fast = packing.ByteBpe(tokenizer_paths()["tokenizer"]), packing.ByteBpe(**tokenizer_paths())
    rng = random.Random(5)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(" \t\n'sa1é<|>.\u00a0\x1c") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    for t in texts:
        assert whole(t) == fast(t), repr(t)


def test_documents_are_packed_whole(spark):
    df = spark.createDataFrame([(None if i == 2 else i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, length string")
    rows = packing.pack(df, **tokenizer_paths()).collect()
    whole = packing.ByteBpe(tokenizer_paths()["tokenizer"])
    ids = {None if i == 2 else i: whole(t or "") + b"\0\0\0\0" for i, t in enumerate(TEXTS)}
    by_doc: dict = {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and r["bucket"] == r["length"].bit_length() - 1 and r["offset"] == 0
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert {d: b"".join(bytes(r["ids"]) for r in sorted(x, key=lambda r: r["start"])) for d, x in by_doc.items()} == ids
    assert len({r["sequence_id"] for r in rows}) == len(rows) and all(r["doc_tokens"] == len(ids[r["doc_id"]]) // 4 for r in rows)
    assert packing.pack(df.where("false"), **tokenizer_paths()).count() == 0
    crc = packing.pack(df, **tokenizer_paths()).select("ids", F.crc32("ids").alias("c")).first()
    assert binascii.crc32(bytes(crc["ids"])) == crc["c"]


def test_buckets_are_folders(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    packing.write_buckets(packing.pack(df, **tokenizer_paths()), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).groupBy("bucket").agg(F.countDistinct("length").alias("n")).where("n > 1").count() == 0


def test_a_worker_keeps_nothing_of_another_stage(spark):
    """Workers live on through the stages of the pipeline; packing's vocabulary is some 100 MB in each."""
    from strata.llm.common import map_batches

    rows = spark.range(8, numPartitions=8).selectExpr("id AS doc_id", "'some text' AS text")
    assert len(packed(rows).collect()) >= 8

    def held(batch):
        return {"doc_id": batch["doc_id"], "n": [packing._tokenizer.cache_info().currsize] * batch.num_rows}

    assert {r["n"] for r in map_batches(rows, held, "doc_id long, n long").collect()} == {0}
