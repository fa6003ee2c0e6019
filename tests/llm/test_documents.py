"""SimHash near-duplicates, I-Match fingerprints, mixing and the pipeline: against brute force, on awkward rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strata.llm import imatch, mixing, queries, simhash
from strata.llm.components import components

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def plain_fingerprint(text):
    words = [w for w in WHITE.split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles)) if shingles else 0


def plain_components(fps, most=2):
    """Of a dict of distinct fingerprints to their least id."""
    keys, root = list(fps), {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(keys, 2):
        if (a ^ b).bit_count() <= most:
            root[find(a)] = find(b)
    least: dict = {}
    for k in keys:
        least[find(k)] = min(least.get(find(k), fps[k]), fps[k])
    return {k: least[find(k)] for k in keys}


def plain_kept(rows):
    """The least id of each component of texts whose sets of five-word shingles have a Jaccard similarity of 0.8."""
    sets = []
    for _, t in rows:
        words = [w for w in WHITE.split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w]
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    least: dict = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, i), i, key=lambda x: (x is None, x))
    return sorted(least.values(), key=lambda x: (x is None, x))


def test_ring_budgets_hold_for_all_close_pairs():
    rng = random.Random(1)
    for segments, most in ((5, 2), (3, 2), (7, 3), (9, 2)):
        masks, _, checks = simhash.ring(segments, most)
        for _ in range(400):
            differ = sum(1 << b for b in rng.sample(range(64), rng.randint(0, most)))
            assert any(not differ & m and all((differ & c).bit_count() <= n for c, n in check) for m, check in zip(masks, checks, strict=True))


@pytest.mark.parametrize("crowded", [1024, 3])
def test_links_give_the_components_of_all_pairs(spark, crowded):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for c in centres for _ in range(12)} | set(centres)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    found = simhash.links(nodes, crowded=crowded).distinct().collect()
    whole = plain_components({v: v for v in values})
    assert found and all(whole[r.a & (1 << 64) - 1] == whole[r.b & (1 << 64) - 1] for r in found)
    roots = {r.node: r.root for r in components(spark.createDataFrame(found, "a long, b long")).collect()}
    groups = Counter(roots.get(signed(v), signed(v)) for v in values)
    want = Counter(whole.values())
    assert sorted(groups.values()) == sorted(want.values())


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(5, i) for i in range(200, 260)] + [(7, 7), (300, 259), (9, 8), (8, 9)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[i] for i in range(101, 141)} == {100} and {found[i] for i in [*range(200, 260), 300]} == {5} and found[9] == 8 and 7 not in found
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    base = [" ".join(word() for _ in range(300)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + 10 * i + j, t.replace(t.split(" ")[50 * j + 3], "changed", 1)) for i, t in enumerate(base[:6]) for j in range(4)]
    return rows + [(400, base[0].upper()), (401, "  " + base[0].replace(" ", "\n\t")), (402, None), (403, ""), (404, " \n"), (None, base[1]), (3, base[3]), (3, base[3]), (405, "one"), (406, "one two"), (407, "É one two three"), (408, "w " * 20_000)]


def test_near_duplicates_against_all_pairs(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, fp string, component_id int")
    fps: dict = {}
    for i, t in rows:
        f = plain_fingerprint(t)
        fps[f] = min(fps.get(f, 10**9), i if i is not None else 10**9)
    want = plain_components(fps)
    found = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in found) == Counter((i, plain_fingerprint(t), want[plain_fingerprint(t)]) for i, t in rows)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == plain_kept(rows)
    assert simhash.near_duplicates(docs.where("false")).count() == 0 and simhash.deduplicated(docs.where("false")).count() == 0
    assert simhash.deduplicated(docs.where("doc_id is null")).count() == 1


# --- I-Match


def test_edited_texts_and_fingerprints(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 120)))) for i in range(-30, 60)]
    rows += [(200, None), (201, ""), (202, "É😀" * 50), (203, "x" * 70_000), (7, rows[40][1]), (7, "other text"), (None, "no id one"), (None, "no id two"), (204, rows[3][1])]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, f string, next_text string")
    found = imatch.edited(docs).collect()
    assert len(found) == len(rows) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    # By descending id, nulls last; rows of one id in an order of their own, so every such order is tried.
    by_id: dict = {}
    for i, t in rows:
        by_id.setdefault(i, []).append(t or "")
    groups = [by_id[i] for i in sorted((i for i in by_id if i is not None), reverse=True)] + [by_id[None]]
    digests = Counter(r.edited_sha256 for r in found)

    def edits(order):
        out = []
        for i, t in enumerate(order):
            n = len(t) // 3
            out.append(hashlib.sha256((t[: len(t) - n] + order[(i + 1) % len(order)][:n]).encode()).hexdigest())
        return Counter(out)

    assert any(edits([t for g in some for t in g]) == digests for some in itertools.product(*[list(itertools.permutations(g)) for g in groups]))
    prints = {}
    for r in imatch.fingerprints(docs).collect():
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert prints[200] == prints[201] and prints[204] & prints[rows[3][0]] and sum(len(x) for x in prints.values()) > 80
    assert imatch.edited(docs.where("false")).count() == 0
    alone = imatch.edited(docs.where("doc_id = 202")).first()
    assert alone.near_next == 1.0 and alone.n_chars == 100


def test_the_lexicon_is_a_band_of_document_frequencies(spark):
    docs = spark.createDataFrame([(i, "all " + ("half " if i % 2 else "") + ("pair pair " if i < 2 else "") + f"own{i}") for i in range(20)], "doc_id long, text string")
    terms = {r.term for r in imatch.lexicon(docs, 0.1, 0.6).collect()}
    names = {w: spark.range(1).select(F.xxhash64(F.lit(w))).first()[0] for w in ("all", "half", "pair", "own3")}
    assert terms == {names["half"], names["pair"]}


# --- Mixing


def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    target, closed = {}, set()
    while True:
        free = sum(sizes.values()) - sum(3 * sizes[s] for s in closed)
        whole = sum(weights[i % 3] for i, s in enumerate(names) if s not in closed)
        target = {s: Fraction(3 * sizes[s]) if s in closed else Fraction(free * weights[i % 3], whole) for i, s in enumerate(names)}
        over = {s for s in names if s not in closed and target[s] > 3 * sizes[s]}
        if not over:
            return target
        closed |= over


def test_targets():
    for sizes in ({"a": 10, "b": 1000, "c": 50}, {"a": 1, None: 5, "Z": 100, "é": 0}, {"x": 7}, {"a": 0, "b": 0}):
        assert mixing.targets(sizes) == plain_targets(sizes) and sum(mixing.targets(sizes).values()) == sum(sizes.values())


def test_draws_fill_quotas_and_permutations_are_whole(spark):
    assert (mixing.draw([1000, 10, 0, 500], 16, 3).sum(axis=0) == [1000, 10, 0, 500]).all()
    for n in (1, 2, 7, 100):
        rows = spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("p")).collect()
        assert sorted(r.p for r in rows) == list(range(n))


def mix_rows():
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(1, 400)), f"s{i % 3}" if i % 2 else "hot") for i in range(300)]
    return rows + [(1000, None, "s1"), (1001, " \n", None), (1002, "a\x0bb  c", None), (None, "x y z", "s2"), (5, rows[5][1], rows[5][2]), (1003, "long " * 30_000, "hot"), (1004, "", "empty")]


def test_mixes_come_near_their_targets(spark):
    rows = mix_rows()
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, source string, size string, block string")
    size = lambda t: len([w for w in WHITE.split(t or "") if w])
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    goal = plain_targets(sizes)
    pieces = mixing.mix(docs)
    found = mixing.taken(*pieces).collect()
    assert Counter((r.doc_id, r.size) for r in found) == Counter((i, size(t)) for i, t, _ in rows) and all(0 <= r.taken <= 3 * r.size for r in found)
    source = {(i, size(t)): s for i, t, s in rows}
    took: dict = {}
    for r in found:
        s = source[r.doc_id, r.size]
        took[s] = took.get(s, 0) + r.taken
        assert r.source_size == sizes[s] and abs(r.target - float(goal[s])) < 1e-6
    assert all(abs(took[s] - goal[s]) <= 128 + 0.03 * goal[s] for s in sizes)
    again = mixing.taken(*mixing.mix(docs.repartition(7))).collect()
    assert Counter(tuple(r) for r in again) == Counter(tuple(r) for r in found)
    # Taken words by brute force: every slot takes every piece of its block.
    slots, parts = pieces[0].collect(), pieces[1].collect()
    uses = Counter((r.sidx, r.block) for r in slots)
    want: Counter = Counter()
    spans: dict = {}
    for r in parts:
        want[r["__row"], r.doc_id, r.size] += r.n * uses[r.sidx, r.block] if r.block is not None else 0
        spans.setdefault((r["__row"], r.size), []).append((r.start, r.n) if r.block is not None else (0, 0))
    assert Counter((i, n, x) for (_, i, n), x in want.items()) == Counter((r.doc_id, r.size, r.taken) for r in found)
    # A row's pieces are its words, in order; a block has no more than its length; each pass takes every block once.
    for (_, n), some in spans.items():
        some.sort()
        assert some[0][0] == 0 and all(a + k == b for (a, k), (b, _) in zip(some, some[1:], strict=False)) and sum(some[-1]) == n
    held = Counter()
    for r in parts:
        held[r.sidx, r.block] += r.n or 0
    blocks = Counter(s for s, b in held if b is not None)
    for s in blocks:
        words = {held[s, b] for b in range(blocks[s] - 1)}
        assert len(words) <= 1 and max(words, default=1) <= 128
        by_slot = [r.block for r in sorted((r for r in slots if r.sidx == s), key=lambda r: r.slot)]
        for i in range(0, len(by_slot), blocks[s]):
            assert len(set(by_slot[i : i + blocks[s]])) == len(by_slot[i : i + blocks[s]])
    # The joined mix has the same words as the counts, each block in a slot once.
    by_row = mixing.joined(*pieces).agg(F.sum("n")).first()[0]
    assert by_row == sum(r.taken for r in found)
    mixed = mixing.mixed(docs, chars_col=None)
    assert mixed.columns == docs.columns and sum(size(r.text) for r in mixed.collect()) == by_row
    assert mixing.taken(*mixing.mix(docs.where("false"))).count() == 0 and mixing.mixed(docs.where("false"), chars_col=None).count() == 0


def test_small_sources_come_near_their_targets(spark, monkeypatch):
    # Also with few chunks in a run, and slots numbered few at a time.
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 2)
    monkeypatch.setattr(mixing, "CHUNKS", 2)
    monkeypatch.setattr(mixing, "SLOTS", 8)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.pmod("id", F.lit(300))).alias("source"), F.repeat(F.lit("w "), 10).alias("text"), F.lit(1).alias("row"))
    slots, pieces = mixing.mix(docs)
    found = mixing.taken(slots, pieces).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert len(found) == 300 and all(abs(r.taken - r.target) <= 0.1 * r.target for r in found)
    mixed = mixing.mixed(docs, chars_col=None)
    assert mixed.columns == docs.columns and mixed.count() >= 3000 / 8


# --- The pipeline


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls, empty, long and repeated texts, and columns with the names that stages use themselves."""
    import corpus_pipeline

    words = {"en": "the house with that thing over there and more of it", "de": "das haus mit dem ding ist dort und noch mehr davon"}
    rows = [(i, f"{words[k]} {'you idiot' if i % 5 == 0 else 'kind word'} w{i} {words[k]}", k, f"s{i % 2}") for i, k in enumerate(["en", "de"] * 20)]
    rows += [(100, None, "en", None), (101, "", None, "s0"), (None, rows[1][1], None, None), (3, rows[3][1], "de", "s1"), (3, rows[3][1], "de", "s1"), (102, f"{words['en']} " * 3000, "en", "s0")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 1, "x", 2, "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row int, node string, key int, size string")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(40)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for some in (docs, docs.where("false")):
        held, columns = some, some.columns
        for name, stage in corpus_pipeline.STAGES:
            n, path = held.count(), str(tmp_path / f"{name}-{held.count()}")
            stage(spark, held, str(tmp_path)).write.parquet(path)
            held = spark.read.parquet(path)
            assert name == "packing" or held.columns == columns
            assert held.count() if n else not held.count()


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        n.append(docs.count())
        if i < 4:
            assert docs.columns == columns and docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
        if i == 2:
            # One document of each group stays, and it is the least; brute force over what came in.
            assert sorted(r.doc_id for r in docs.collect()) == plain_kept([(r.doc_id, r.text) for r in before.collect()])
    toxic = spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").select("doc_id")
    assert spark.read.parquet(str(tmp_path / "1")).join(toxic, "doc_id").count() <= 0.2 * toxic.count()
    sums = docs.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n"))
    assert sums.where("n % doc_tokens <> 0").count() == 0 and n[4] > n[3]


def test_registered_queries():
    assert [next(q for q in queries.QUERIES if q.startswith(f"op{i}_")) for i in range(1, 11)] == list(queries.QUERIES)
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_the_pipeline_returns_the_ids_of_its_sequences(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline

    texts = [None, "", "one two  three", "Grüße, 世界 " * 900]
    found = corpus_pipeline.pack(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "").orderBy("doc_id", "start").collect()
    encode = Tokenizer.from_file(queries.tokenizer_paths()["tokenizer"]).encode
    for i, text in enumerate(texts):
        mine = [r for r in found if r["doc_id"] == i]
        assert np.frombuffer(b"".join(r["ids"] for r in mine), "<u4").tolist() == [*encode(text or "", add_special_tokens=False).ids, 0]
        assert all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in mine)


@pytest.mark.parametrize("few", [1 << 19, -1])
def test_components_are_those_of_one_task(spark, monkeypatch, few):
    from strata.llm import components as module

    monkeypatch.setattr(module, "FEW", few)
    rng = random.Random(4)
    links = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(260)] + [(i + 1, i) for i in range(1000, 1100)] + [(3, 3)]
    root = {x: x for pair in links for x in pair}
    for a, b in links:
        root = {x: min(root[a], root[b]) if r in (root[a], root[b]) else r for x, r in root.items()}
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(found) == len({r.node for r in found}) and {r.node: r.root for r in found} == {x: r for x, r in root.items() if x != r}


def test_few_links_are_not_shuffled_again_and_again(spark):
    """Each shuffle leaves small files for each of its tasks, which filled the disk where tasks are many."""
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: sum(1 for x in range(tracker.getAllFiles().size()) if tracker.getAllFiles().apply(x).getName().endswith(".index"))
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    before = files()
    assert components(links).count() == 300
    assert files() - before <= 10
