"""The training-data operators against brute-force versions, on small and odd tables."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from folioflow.llm import ann, bpe, elias_fano, jaccard_join, lm_scoring, mixing, quality_mil, quality_rules, queries, sharding, substring_dedup, toxicity
from folioflow.llm.elias_fano import EliasFano
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows(n=60, seed=1):
    """Copies, near copies, shared passages, empty, null and long texts, null and repeated ids, repeated rows."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 6))) for _ in range(400)]
    passage = " ".join(rng.choices(vocab, k=50))
    rows = []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randint(0, 160))
        if i % 5 == 1:
            words[10:10] = passage.split()
        text = " ".join(words) + ("\n" + " ".join(words[:8]) if i % 4 == 0 else "")
        if i % 7 == 3 and rows:
            text = rows[rng.randrange(len(rows))][1]
        if i % 7 == 5 and rows and rows[-1][1]:
            w = rows[-1][1].split(" ")
            w[len(w) // 2] = "changed"
            text = " ".join(w)
        rows.append((i, text))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "word"), (n + 4, "one two three"), (n + 5, "One two THREE"), (n + 6, " ".join(vocab * 30)), (n + 7, "x " * 300), (None, passage), (3, rows[3][1]), (3, rows[3][1])]
    return rows


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark, rows):
    seen = sorted({i for i, _ in rows if i is not None})
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in seen] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def same(got, want):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


# 1 mixing
def test_rates_meet_targets(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    labelled = mixing.sample_labelled(docs, queries.table(spark, sf_dir, "labels"), "lang", fit_rows=4000)
    members, report = mixing.mix(docs, labelled, queries.TARGETS)
    rows = members.collect()
    total = np.zeros(len(report["domains"]))
    for r in rows:
        assert r.rate >= 0 and abs(sum(r.posterior) - 1) < 1e-9
        total += r.rate * r.n_tokens * np.array(r.posterior)
    want = np.array([queries.TARGETS[d] for d in report["domains"]]) * sum(r.n_tokens for r in rows)
    assert np.allclose(total, want, rtol=1e-4)
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert sum(lang[r.doc_id] == r.domain for r in rows if r.n_tokens > 20) > 0.95 * sum(r.n_tokens > 20 for r in rows)


def test_mixing_keeps_every_row(spark, docs, none):
    rates, _ = mixing.mix(docs, docs.select("text", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("domain")), {"a": 0.3, "b": 0.7}, total="keep", floor=1.0)
    out = mixing.realise(docs, rates)
    assert out.columns == docs.columns
    got, had = Counter(r.doc_id for r in out.collect()), Counter(r.doc_id for r in docs.collect())
    assert all(got[k] >= n for k, n in had.items())
    assert mixing.mix(none, none.select("text", F.col("lang").alias("domain")), {"a": 1.0})[0].count() == 0


# 2 quality rules
def test_base_statistics(docs, rows, labels, none):
    got = [tuple(r) for r in quality_rules.apply_rules(docs, labels)[0].select("doc_id", *quality_rules.BASE).collect()]
    same(got, [(i, *brute.base_statistics(t)) for i, t in rows])
    assert quality_rules.apply_rules(none, labels)[0].count() == 0


def test_rules_find_thresholds():
    rng = np.random.default_rng(0)
    x = rng.random((900, 3))
    bad = (x[:, 1] > 0.8) | ((x[:, 0] < 0.2) & (x[:, 2] > 0.5))
    rules = quality_rules.learn(x, bad, ("a", "b", "c"))
    hit = np.zeros(900, bool)
    for rule in rules.rules:
        hit |= np.all([x[:, "abc".index(n)] <= t if op == "<=" else x[:, "abc".index(n)] > t for n, op, t in rule], axis=0)
    assert (hit == bad).mean() > 0.97


def test_rules_on_held_out_labels(spark, sf_dir):
    out, _ = quality_rules.apply_rules(queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "labels"))
    held = out.join(queries.table(spark, sf_dir, "labels"), "doc_id").where("NOT base_failed AND crc32(cast(doc_id AS string)) % 3 = 1").collect()
    assert sum(r.kept == (r.quality == 1) for r in held) >= 0.9 * len(held)


# 3 BPE
@pytest.fixture(scope="module")
def tokenizer():
    return bpe.Tokenizer.from_file(queries.tokenizer_path())


def test_bpe_equals_the_library(spark, docs, rows, tokenizer):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.tokenizer_path())
    odd = ["<|endoftext|>a<|endoftext|>", "  \n\n x\t y  ", "don't WE'LL 12³ ①", "日本語のテキスト😀👩‍👩‍👧", "aaaaaaaaaaaaaaaa" * 20, "-" * 300, "\x1c\x1f\x85 a", "éñ�"]
    for t in [*odd, *(t or "" for _, t in rows)]:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(tokenizer.encode(t), "<u4").tolist() == ids
        assert tokenizer.decode(tokenizer.encode(t)) == lib.decode(ids, skip_special_tokens=False).encode()
    got = [tuple(r) for r in bpe.round_trip(docs, tokenizer).collect()]
    same(got, [(i, len(e := tokenizer.encode(t)) // 4, brute.sha(e), brute.sha((t or "").encode())) for i, t in rows])
    shared = bpe.share(spark, tokenizer)
    assert [r.decoded for r in bpe.decode(bpe.encode(docs, shared), shared).select("text", "decoded").where("text IS NOT NULL AND text <> decoded").collect()] == []


def test_gadgets_by_walking_states():
    rng = random.Random(2)
    ids, merges, names = {b: b - 97 for b in range(97, 100)}, [], ["a", "b", "c"]
    while len(names) < 40:
        u, v = rng.randrange(len(names)), rng.randrange(len(names))
        if names[u] + names[v] not in names:
            merges.append((u, v, len(names)))
            names.append(names[u] + names[v])
    a = bpe.TokenizationAutomaton(ids, merges, len(names))

    def merged(word):
        parts = [ids[c] for c in word]
        for u, v, t in merges:
            out = []
            for p in parts:
                if out and out[-1] == u and p == v:
                    out[-1] = t
                else:
                    out.append(p)
            parts = out
        return parts

    for _ in range(400):
        word = bytes(rng.choices(b"abc", k=rng.randint(1, 12)))
        assert a.encode_word(word) == merged(word)
    live = list(a.arcs.values())
    assert all(a.follows(x, y) == a.follows_by_states(x, y) for x in live for y in live)


# 4 sharding
def test_shards(docs, rows, none):
    got = sharding.shard(docs, 8, bins=16).collect()
    assert len(got) == len(rows)
    n = Counter(r.shard for r in got)
    assert max(n.values()) - min(n.get(s, 0) for s in range(8)) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))
    same([(r.doc_id, r.size) for r in got], [(i, len((t or "").encode()) + 1) for i, t in rows])
    assert sharding.shard(none, 8).count() == 0


def test_one_more_shard_moves_little():
    counts = {b: 10 for b in range(4096)}

    def owners(shards, slack):
        out = {}
        for b, lo, hi, s, _ in sharding.plan(counts, shards, 64, 4096, slack):
            out |= {(b, r): s for r in range(lo, hi)}
        return out

    for slack, most in ((0.0, 0.2), (0.25, 0.2)):
        a, b = owners(8, slack), owners(9, slack)
        assert len(a) == len(b) == 40960 and sum(a[k] != b[k] for k in a) < most * len(a)


# 5 nearest neighbours
def nearest(v, every=50, k=5):
    u = v / np.linalg.norm(v, axis=1)[:, None]
    for q in range(0, len(v), every):
        s = u @ u[q]
        s[q] = -9
        yield q, set(np.argsort(-s)[:k].tolist())


def clustered(n, groups, width=16, seed=7):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, width))[rng.integers(0, groups, n)] + 0.15 * rng.normal(size=(n, width))


@pytest.mark.parametrize("kind", ["table", "clustered"])
def test_recall(spark, kind):
    if kind == "table":
        rows = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
        v, df = np.array(rows.column("embedding").to_pylist(), float), spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
        assert rows.column("vec_id").to_pylist() == list(range(len(v)))
    else:
        v = clustered(6000, 300)
        df = spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = dict(nearest(v))
    assert sum(len(want[q] & got[q]) for q in want) >= 0.9 * 5 * len(want)


def test_the_walk_prunes_and_finds_all_lists_within_the_ratio():
    v = ann.unit(clustered(20_000, 1000))
    c = ann.balanced_centroids(v[:8000], 1000)
    graph, searched = ann.CentroidGraph.build(c), []
    for q in v[:200]:
        d = np.sqrt(np.maximum(0, 2 - 2 * c @ q))
        found, want = set(graph.search(q, 1.28).tolist()), set(np.flatnonzero(d <= 1.28 * d.min() + 1e-12).tolist())
        assert found <= want and len(found) >= 0.95 * len(want)
        searched.append(len(found))
    assert np.mean(searched) < 0.02 * len(c)


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    same_one = [1.0, 2.0, 3.0]
    rows = [(i, same_one) for i in range(40)] + [(i, rng.normal(size=3).tolist()) for i in range(40, 80)]
    rows += [(100, None), (150, [0.0, 0.0, 0.0]), (200, [1.0, None, 2.0]), (250, [float("nan"), 1.0, 1.0]), (300, [1.0, 2.0]), (None, same_one), (0, same_one), (50, [float("inf"), 0.0, 1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.query_id for r in got} == {0, 50, 300}  # 300 is shorter, so followed by a zero
    assert [r.score for r in got if r.query_id == 300 and r.rank == 1][0] <= 1
    first = sorted((r.rank, r.vec_id) for r in got if r.query_id == 0)
    assert first == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    assert ann.search(spark.createDataFrame([(50, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()[0].vec_id == 1


# 6 Jaccard join
def test_components(docs, rows, none):
    want = [(i, *c) for (i, _), c in zip(rows, brute.jaccard_components(rows))]
    same([(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(docs).collect()], want)
    same([(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(docs, broadcast_rows=0).collect()], want)
    assert jaccard_join.join(none).count() == 0


def test_prefixes_lose_no_link():
    rng = np.random.default_rng(4)
    none = np.empty(0, np.uint64)
    for k in range(1200):
        n = int(rng.integers(1, 600 if k % 3 == 0 else 30))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        gone, new = int(rng.integers(0, n // 5 + 1)), int(rng.integers(0, n // 4 + 1))
        b = np.unique(np.r_[a[gone:], rng.integers(0, 1 << 63, new).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if max(len(a), len(b)) > both and 100 * both >= 80 * (len(a) + len(b) - both):
            (x, need_a), (y, need_b) = jaccard_join.prefix(a, 80, 1, none), jaccard_join.prefix(b, 80, 1, none)
            assert min(need_a, need_b) >= 1 and len(np.intersect1d(x, y)) >= min(need_a, need_b)
            hot = np.sort(x[: len(x) // 2])
            assert len(np.intersect1d(jaccard_join.prefix(a, 80, 1, hot)[0], jaccard_join.prefix(b, 80, 1, hot)[0])) >= min(need_a, need_b)


def test_short_texts_with_frequent_shingles_do_not_meet(spark):
    rows = [(i, f"sign up for our newsletter w{i}") for i in range(3000)] + [(i, f"read more about this and that w{i} by us") for i in range(3000, 6000)]
    rows += [(6000, "sign up for our newsletter now and then please"), (6001, "sign up for our newsletter now and then please !")]
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.pop(6000) == got.pop(6001) == (6000, 1) and all(c == i and n == 0 for i, (c, n) in got.items())


@pytest.mark.parametrize("block", [256, 8])
def test_links_within_a_component_are_counted(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)  # components of one block and of many
    rng, texts = random.Random(5), [None, "", "one two", "One TWO"]
    for g, size in enumerate((4, 60, 12)):  # words, of which near copies change and leave out some
        base = [f"g{g}w{i}" for i in range((12, 150, 60)[g])]
        for _ in range(size):
            words = base[: rng.randrange(len(base) * 3 // 4, len(base) + 1)]
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
            texts.append(" ".join(words))
    texts += [texts[20].upper(), texts[20], texts[70] + " "]
    want = brute.jaccard_links(texts)
    assert max(n for n, _ in want) > 8 and sum(n > 2 for n, _ in want) > 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    same([(r.doc_id, r.n_links, r.n_linked) for r in jaccard_join.join(docs).collect()], [(i, *w) for i, w in enumerate(want)])
    assert jaccard_join.join(docs, links=False).columns == ["doc_id", "n_shingles", "component_id", "set_class"]


def test_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 90)).astype(np.uint64)) for _ in range(20)]
    for a, b in ((sets, sets), (sets[:7], sets[7:])):
        assert jaccard_join.overlaps(a, b, 32).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


def test_a_copy_read_first_leaves_a_class_its_keys(spark):
    texts = [" ".join(f"{x}{i}" for i in range(30)) for x in "aAbBaAz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    job = jaccard_join._Join(docs, "doc_id", "text", 80, 5, 1024, 1000, True)
    sets = job.sets().orderBy(F.desc("id")).coalesce(1)  # as where a copy's rows are read apart from the first one's
    assert all(len(r["keys"]) > 0 for r in job.classes(sets).collect())


# 7 toxicity
def test_folding_and_exceptions():
    assert toxicity.folded("Ѕtup1d ＭＯＲＯＮ!! it's 2024").split() == ["stupid", "moron", "it's", "2024"]
    lexicon = toxicity.Lexicon({" clown": 2.0, " scum ": 3.0}, exceptions=(" clown fish ",))
    a = lexicon.automaton()
    assert toxicity.hits(a, "Cl0wns!")[3] == 1 and toxicity.hits(a, "a clown fish")[3] == 0 and toxicity.hits(a, "scummy")[3] == 0
    assert toxicity.hits(a, None) == (0, 0.0, 0.0, 0, 0)


def test_toxicity_runs_on_odd_tables(docs, rows, labels, none):
    got = toxicity.classify(docs, labels).collect()
    same([(r.doc_id, r.held_out) for r in got], [(i, brute.fold(i, 3) == 1) for i, _ in rows])
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert toxicity.classify(none, labels).count() == 0


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic, flagged = sum(r.toxic for r in held), sum(r.predicted for r in held)
    caught = sum(r.predicted and r.toxic for r in held)
    assert caught >= 0.8 * toxic and caught >= 0.97 * flagged


# 8 substring dedup
@pytest.mark.parametrize("window", [35, 9, 2])
def test_repeats(docs, rows, none, window):
    want = [(i, n, gone, kept.decode()) for (i, _), (n, gone, kept) in zip(rows, brute.repeats([t for _, t in rows], window))]
    for size, hot_keys in ((1 << 26, 1024), (0, 30), (0, 1)):  # all, some and no repeated keys are sent to all executors
        out = substring_dedup.remove_repeats(docs, window=window, broadcast_bytes=size, hot_keys=hot_keys)
        assert out.columns == [*docs.columns, "repeats"]
        same([(r.doc_id, r.repeats.n, r.repeats.removed, r.repeats.kept) for r in out.collect()], want)
    assert substring_dedup.remove_repeats(none).count() == 0


# 9 LM scoring
def test_elias_fano():
    rng = np.random.default_rng(3)
    for top in (5, 1000, 1 << 40):
        v = np.sort(rng.integers(0, top, 500).astype(np.uint64))
        ef = EliasFano.build(v)
        assert (ef.get(np.arange(500)) == v).all()
        for x in np.r_[v, rng.integers(0, 2 * top, 200).astype(np.uint64)]:
            at, equal = ef.successor(np.array([x]))
            want = int(np.searchsorted(v, x))
            assert at[0] == want and equal[0] == (want < 500 and v[want] == x)
    assert EliasFano.build(np.empty(0, np.uint64)).n == 0


def test_scores(docs, rows, none):
    got = lm_scoring.score(docs, block_tokens=500).collect()
    want = [(i, *b) for (i, _), b in zip(rows, brute.unigram_scores(rows))]
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], [(*w[:5], round(w[5], 6)) for w in want])
    assert all(r.score <= 1e-9 and math.isfinite(r.score) for r in got)
    assert lm_scoring.score(none).count() == 0


def test_probabilities_add_up(spark):
    rng = random.Random(5)
    words = list("abcdefgh")
    rows = [(i, " ".join(rng.choices(words, weights=range(1, 9), k=30))) for i in range(60)]
    # the same beginning, then each possible last word, and one unseen, judged from texts of the held-out fold
    held = [i for i in range(1000, 3000) if brute.fold(i, 7) == 2][:9]
    start = "h g h"
    probes = list(zip(held, [*(f"{start} {w}" for w in words), f"{start} zz"]))
    end = next(i for i in range(3000, 4000) if brute.fold(i, 7) == 2)
    docs = spark.createDataFrame([*rows, *probes, (end, start)], "doc_id long, text string")
    first = {r.doc_id: r.score for r in lm_scoring.score(docs, order=1).collect()}
    # without context a text's probability is a product, so one more word costs that word's probability
    assert abs(sum(10 ** (first[i] - first[end]) for i, _ in probes) + _share_of_end(rows) - 1) < 1e-6
    score = {r.doc_id: r.score for r in lm_scoring.score(docs).collect()}
    assert score[end] != first[end] and all(x < 0 for x in score.values())


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_equal_brute_force(spark, order):
    rng = random.Random(order)
    rows = [(i, " ".join(rng.choices("abcdefghijkl", weights=range(1, 13), k=rng.randint(0, 25)))) for i in range(80)] + [(None, "a b zz"), (501, None)]
    # many words, so that some contexts are hot and others aren't
    rows += [(1000 + i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(60))) for i in range(40)]
    want = brute.model_scores(rows, order)
    for block_tokens in (100, 1 << 20):  # many shards, and one
        got = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), order=order, block_tokens=block_tokens).collect()
        assert len(got) == len(rows)
        for r in got:  # a hot context's weight is not rounded
            assert abs(r.score - want[r.doc_id]) < 0.001 * (order - 1) * r.n_tokens + 1e-6


def test_scores_of_odd_rows_equal_brute_force(spark, docs, rows):
    # folds go by id, so rows are numbered: ids repeat and may be null
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    want = brute.model_scores(rows, 3)
    got = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), block_tokens=500).collect()
    assert len(got) == len(rows) and all(abs(r.score - want[r.doc_id]) < 0.002 * r.n_tokens + 1e-6 for r in got)


def test_model_adds_up_to_one():
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices("abcdefgh", weights=range(1, 9), k=30))) for i in range(60)]
    p, events = brute.model_probability(rows, 3)
    for context in [(b"a", b"b"), (b"h", b"h"), (b"<s>", b"h"), (b"zz", b"a"), (b"zz", b"yy")]:
        assert abs(sum(p(context, w) for w in [*events, b"never seen"]) - 1) < 1e-9


def test_grid_and_trie_in_a_file(tmp_path):
    p = np.random.default_rng(1).random(1000)
    back = elias_fano.grid_value(elias_fano.grid_code(p))
    assert (back <= p * (1 + 1e-9)).all() and (back >= p * 0.997).all() and elias_fano.grid_value(np.zeros(1, np.uint16))[0] == 0
    parent, successor = np.array([0, 0, 2, 2, 2]), np.array([1, 7, 0, 3, 9])
    trie = elias_fano.Trie.build([{"parent": parent, "successor": successor, "alpha": np.arange(1, 6), "bow": np.array([4, 0, 6]), "parents": 3, "universe": 10}])
    (tmp_path / "trie").write_bytes(trie.tobytes())
    for t in (trie, elias_fano.Trie.map(tmp_path / "trie")):
        assert t.find(0, np.array([0, 0, 1, 2, 2, -1]), np.array([7, 2, 1, 0, 10, 1])).tolist() == [1, -1, -1, 2, -1, -1]
        assert t.first(0, np.arange(4)).tolist() == [0, 2, 2, 5] and t.alpha(0, np.array([4])).tolist() == [5] and t.bow(0, np.array([2])).tolist() == [6]


def test_rare_words_have_context(spark):
    train, probe = ([i for i in range(1000) if (brute.fold(i, 7) == 2) == held][0] for held in (False, True))
    words = [f"w{i}" for i in range(70_000)]
    rows = [(train, " ".join(words)), (probe, " ".join(words[100:200]))]
    score = {r.doc_id: r.score for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # each word is seen once, so what follows a seen pair has the probability 1 - 0.9 and more, and begin and end are backed off to
    assert score[probe] > -100 - 30 and score[probe] < -60


def _share_of_end(rows):
    counts = Counter(t for i, text in rows if brute.fold(i, 7) != 2 for t in [*text.split(), None])
    total, once, twice = sum(counts.values()), sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
    return (counts[None] - min(0.9, max(0.05, once / max(1, once + 2 * twice)))) / total


# 10 quality classifier
def test_network_gradient_learns_bags():
    rng = np.random.default_rng(0)
    bags, y = [], []
    for k in range(300):
        x = rng.normal(size=(rng.integers(1, 9), quality_mil.WIDTH))
        y.append(k % 2)
        x[rng.integers(len(x)), 0] += 0 if k % 2 else 6
        bags.append(x)
    starts = np.cumsum([0, *map(len, bags)])[:-1]
    net = quality_mil.train(np.concatenate(bags), starts, np.array(y, float))
    assert ((net.score(np.concatenate(bags), starts) >= 0.5) == np.array(y)).mean() > 0.9


def test_quality_runs_on_odd_tables(docs, rows, labels, none):
    got = quality_mil.classify(docs, labels).collect()
    same([(r.doc_id, r.held_out) for r in got], [(i, brute.fold(i, 3) == 1) for i, _ in rows])
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert quality_mil.classify(none, labels).count() == 0


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = quality_mil.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    for wanted in (0, 1):
        right, of, said = (sum(f(r) for r in held) for f in (lambda r: r.predicted == r.quality == wanted, lambda r: r.quality == wanted, lambda r: r.predicted == wanted))
        assert right >= 0.93 * of and right >= 0.93 * said


def test_network_equals_plain_loops():
    rng = np.random.default_rng(4)
    texts = [b"a Bc 12 a" * 30, b"", None, b"one two three", bytes(rng.integers(32, 126, 3000, dtype=np.uint8))]
    bags = [quality_mil.passages(t) for t in texts]
    assert [len(b) for b in bags] == [max(1, -(-len((t or b"").split()) // quality_mil.PASSAGE)) for t in texts]
    starts = np.cumsum([0, *map(len, bags)])[:-1]
    net = quality_mil.train(np.concatenate(bags), starts, np.array([1.0, 0, 0, 1, 1]), steps=5)
    got, w = net.score(np.concatenate(bags), starts), net.w
    dot = lambda a, m, j: sum(float(x) * float(m[i][j]) for i, x in enumerate(a))
    for bag, score in zip(bags, got):
        hs, es = [], []
        for row in bag:
            x = [min(6, max(-6, (float(v) - net.mean[i]) / net.scale[i])) if i < quality_mil.STATS else float(v) for i, v in enumerate(row)]
            h = [math.tanh(dot(x, w["enc"], j) + w["enc_b"][j]) for j in range(16)]
            es.append(math.exp(sum(math.tanh(dot(h, w["v"], j)) / (1 + math.exp(-dot(h, w["u"], j))) * w["a"][j] for j in range(8))))
            hs.append(h)
        z = [sum(e * h[j] for e, h in zip(es, hs)) / sum(es) for j in range(16)]
        assert abs(1 / (1 + math.exp(-sum(a * b for a, b in zip(z, w["c"])) - w["c_b"][0])) - score) < 1e-4


# pipeline
def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = queries.table(spark, sf_dir, "documents")
    before, at = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, sf_dir)
        rows = out.collect()
        at[name] = rows
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            before = spark.createDataFrame(rows, docs.schema)
    joined = brute.jaccard_components([(r.doc_id, r.text) for r in at["quality classifier"]])
    assert {r.doc_id for r in at["n-gram Jaccard join"]} == {c for n, c in joined}
    assert {r.doc_id for r in at["mixing sources to target weights"]} == {r.doc_id for r in at["n-gram Jaccard join"]}
    assert len(at["BPE encoding and decoding"]) == len(at["mixing sources to target weights"])


def test_colliding_ids_lose_no_document(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, b), (2, c), (3, a), (None, c), (None, c + " more"), (None, "alone"), (4, ""), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS).repartition(3)
    got = corpus_pipeline.ngram_jaccard_join(spark, docs, None).collect()
    same([(r.doc_id, r.text) for r in got], [(1, a), (1, b), (2, c), (None, "alone"), (4, ""), (4, "")])


@pytest.fixture(scope="module")
def clashing(docs):
    """Other columns with the names that operators use inside."""
    names = ("_key", "_kept", "_id", "_first", "_text", "_d1", "_t1", "_spans", "repeats", "_quality", "_mix_id", "_mix_rate", "_mix_copy", "_label", "_lid", "t1", "t2", "f", "n", "id", "Word", "train", "rate", "score", "s")
    return docs.select("*", *(F.concat(F.lit(n), F.col("text")).alias(n) for n in names))


def test_stages_on_odd_tables(spark, docs, rows, none, clashing, sf_dir):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0
        out, plain = stage(spark, clashing, sf_dir), stage(spark, docs, sf_dir).collect()
        if name == "BPE encoding and decoding":
            same([tuple(r) for r in out.collect()], [tuple(r) for r in plain])
            continue
        assert out.columns == clashing.columns
        got = out.collect()
        same([(r.doc_id, r.text) for r in got], [(r.doc_id, r.text) for r in plain])
        if name != "substring dedup":  # which changes texts
            assert all(r._d1 == (None if r.text is None else "_d1" + r.text) and r.repeats == (None if r.text is None else "repeats" + r.text) for r in got)
    want = brute.repeats([t for _, t in rows])
    same([(r.doc_id, r.text) for r in stages["substring dedup"](spark, docs, sf_dir).collect()], [(i, kept.decode() if gone else t) for (i, t), (n, gone, kept) in zip(rows, want)])


@pytest.mark.parametrize("name", ["bpe", "shard", "jaccard", "toxicity", "substrings", "lm", "quality", "rules", "mix"])
def test_operators_ignore_other_columns(spark, docs, clashing, labels, none, tokenizer, name):
    run = {
        "bpe": lambda d: bpe.round_trip(d, tokenizer), "shard": lambda d: sharding.shard(d, 3).select("doc_id", "size", "text_crc32"), "jaccard": lambda d: jaccard_join.join(d).select("doc_id", "n_shingles", "component_id"), "toxicity": lambda d: toxicity.classify(d, labels),
        "substrings": substring_dedup.dedup, "lm": lambda d: lm_scoring.score(d).select("doc_id", "n_tokens", F.round("score", 6)), "quality": lambda d: quality_mil.classify(d, labels), "rules": lambda d: quality_rules.apply_rules(d, labels)[0],
        "mix": lambda d: mixing.mix(d, d.select("text", F.col("lang").alias("domain")), {"en": 1.0})[0].select("doc_id", "n_tokens", "domain"),
    }[name]
    same([tuple(r) for r in run(clashing).collect()], [tuple(r) for r in run(docs).collect()])
    assert run(none).count() == 0
