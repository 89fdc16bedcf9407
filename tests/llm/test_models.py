"""Classifiers by held-out accuracy, nearest neighbours by brute force, and the pipeline by a plain version."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from maskwright.llm import bpe, mixing, neighbours, quality, toxicity
from maskwright.llm.common import held_out, training_sample
from maskwright.llm.forest import Forest
from maskwright.llm.queries import op2_neighbours, op9_toxicity, op10_quality, tokenizer

SF = "/root/testdata/sf0.01"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    ones = y.sum()
    return (rank[y == 1].sum() - ones * (ones + 1) / 2) / ones / (len(y) - ones)


def on_held_out(spark, query, label):
    rows = query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    return np.array([r.score for r in rows]), np.array([r[label] for r in rows]), np.array([r.predicted for r in rows])


def test_quality_on_held_out_rows(spark):
    score, y, predicted = on_held_out(spark, op10_quality, "quality")
    assert auc(score, y) > 0.97 and ((score >= 0.3) == (predicted == 1)).all()
    assert predicted[y == 1].mean() > 0.98


def test_toxicity_on_held_out_rows(spark):
    score, y, predicted = on_held_out(spark, op9_toxicity, "toxic")
    assert auc(score, y) > 0.85 and ((score >= 0.5) == (predicted == 1)).all()
    assert predicted[y == 0].mean() < 0.05


WORDS = "the cat sat on a mat while rain fell over old town and people walked home".split()


def labelled(spark, n=400, seed=1):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice(WORDS) for _ in range(60)]
        toxic, junk = i % 4 == 0, i % 3 == 0
        if toxic:
            words[rnd.randrange(60)] = "idiot"
            words[rnd.randrange(60)] = "scum"
        if junk:
            words = [f"{w}%%%" for w in words]
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(not junk), int(toxic)))
    docs += [(n, None, "x"), (n + 1, "", "x"), (n + 2, "word " * 200_000, "x"), (None, "no id", "x"), (0, docs[0][1], "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame([*labels, (5, 1, 0), (None, 1, 1), (n, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("model", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_and_their_edges(spark, model, label):
    docs, labels = labelled(spark)
    rows = model.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    truth = {r.doc_id: r[label] for r in labels.collect()}
    judged = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert np.mean([a == b for a, b in judged]) > 0.95
    again = {(r.doc_id, r.score) for r in model.classify(docs.repartition(3), labels).collect()}
    assert {(i, round(s, 6)) for i, s in again} == {(r.doc_id, round(r.score, 6)) for r in rows}
    assert model.classify(docs.limit(0), labels).collect() == []
    for some in (labels.limit(0), labels.filter(F.col(label) == 1)):
        assert len({r.score for r in model.classify(docs, some).collect()}) == 1


def test_labels_are_learned_from_training_rows_only(spark):
    docs, labels = labelled(spark)
    sample = training_sample(docs, labels, "quality", 50).collect()
    assert len({r.doc_id for r in sample}) == 50 and all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in sample)
    fold = docs.select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in fold)


def test_scores_are_those_of_the_softmax():
    texts = ["", "a b b c", "Was Was Was", "long " * 50_000, "x" * 500]
    rng = np.random.default_rng(1)
    difference, bias = rng.normal(size=quality.BUCKETS), 0.3
    for text, score in zip(texts, quality.Scorer(difference, bias).score(texts), strict=True):
        b, n = quality.counts(text)
        z = bias + ((difference[b] * n).sum() / n.sum() if len(b) else 0)
        assert score == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-9)


def test_features_do_not_depend_on_parts(monkeypatch):
    texts = ["Was Was it  was\twas é\u3000x", "a" * 300 + " b b b", "", "one", " x x " * 60]
    rng = np.random.default_rng(2)
    scorer = quality.Scorer(rng.normal(size=quality.BUCKETS), 0.1)
    whole, scores = [quality.counts(t) for t in texts], scorer.score(texts)
    monkeypatch.setattr(quality, "RUN", 16)
    for t, (b, n) in zip(texts, whole, strict=True):
        again = quality.counts(t)
        if len(max(t.split(), key=len, default="")) < 16:
            assert again[0].tolist() == b.tolist() and again[1].tolist() == n.tolist()
    assert np.allclose(scorer.score(texts)[[0, 2, 3, 4]], scores[[0, 2, 3, 4]])
    words = [t.split() for t in texts]
    for t, w, (b, n) in zip(texts, words, whole, strict=True):
        grams = sum(max(0, len(x) + 3 - g) for x in w for g in quality.GRAMS)
        assert n.sum() == len(w) + grams + sum(x == y for x, y in zip(w, w[1:], strict=False)), t


def test_features_survive_a_full_table():
    own = toxicity.Featuriser({})
    own.table.most = 1 << 16
    texts = [" ".join(f"w{i}x{j}" for i in range(400)) + " you idiot!!" for j in range(300)]
    first = own.many(texts[:3])
    for i in range(0, 300, 20):
        own.many(texts[i : i + 20])
    assert np.array_equal(own.many(texts[:3]), first) and own.known <= 5 << 13


def test_isotonic_curve_rises():
    rng = np.random.default_rng(0)
    x = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * x))).astype(float)
    at, share = toxicity.isotonic(x, y)
    assert (np.diff(share) >= 0).all() and (np.diff(at) >= 0).all() and 0 < share[0] < 0.2 < 0.8 < share[-1] < 1


def test_features_see_disguises_and_nearness():
    own = toxicity.Featuriser({toxicity.terms("idiot")[0]: 5.0})
    names = toxicity.FEATURES
    plain = dict(zip(names, own.one("you are an IDIOT today!"), strict=True))
    assert plain["listed"] == plain["whole"] == plain["near"] == plain["second"] == 0.2 and plain["shouted"] > 0 and plain["exclaims"] > 0
    hidden = dict(zip(names, own.one("such an 1d10t here"), strict=True))
    assert hidden["disguised"] == hidden["listed"] == 0.25 and hidden["near"] == 0
    assert own.one("").tolist() == [0.0] * len(names)


def nearest_plain(rows, queries, k):
    out = {}
    for q, v in queries:
        scored = {}
        for i, x in rows:
            if i != q:
                scored[i] = max(scored.get(i, -np.inf), float(np.dot(np.array(v, dtype=np.float64), np.array(x, dtype=np.float64))))
        out[q] = sorted(scored.items(), key=lambda s: (-s[1], s[0]))[:k]
    return out


def recall_of(found, wanted):
    hits = [len({r.vec_id for r in found if r.query_id == q} & {i for i, _ in w}) / max(1, len(w)) for q, w in wanted.items()]
    return np.mean(hits)


def test_neighbours_on_the_table(spark):
    found = op2_neighbours(spark, SF).collect()
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    wanted = nearest_plain(table, [x for x in table if x[0] % 20 == 0], 20)
    assert recall_of(found, wanted) >= 0.9 and {r.query_id for r in found} == set(wanted)
    vectors = dict(table)
    for r in found:
        assert r.score == pytest.approx(float(np.dot(np.array(vectors[r.query_id], float), np.array(vectors[r.vec_id], float))), abs=1e-12)
    for q in wanted:
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21)) and own == sorted(own, key=lambda r: (-r.score, r.vec_id))


def test_neighbours_with_ties_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROW_BLOCK", 64)
    rng = np.random.default_rng(3)
    base = rng.integers(-3, 4, (150, 6)).astype(float)
    base[base.any(axis=1) == 0] = 1
    rows = [(i, base[i % 150].tolist() if i < 300 else base[0].tolist()) for i in range(500)]
    odd = [(900, None), (901, [0.0] * 6), (902, [1.0, None, 0, 0, 0, 0]), (903, [float("nan")] * 6), (904, [float("inf")] + [0.0] * 5), (905, [1.0]), (None, base[0].tolist()), (20, rows[20][1]), (907, [])]
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1) for i, v in rows + odd], "vec_id long, embedding array<float>, score int")
    found = neighbours.nearest(df, df.filter("vec_id % 20 = 0"), k=20).collect()
    wanted = nearest_plain(rows, [x for x in rows if x[0] % 20 == 0], 20)
    assert {r.query_id for r in found} == set(wanted)
    for q, w in wanted.items():
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [(r.vec_id, r.score) for r in own] == w
    few = df.filter("vec_id < 5 or vec_id = 20")
    assert len(neighbours.nearest(few, few.filter("vec_id = 20"), k=20).collect()) == 5
    assert neighbours.nearest(df.limit(0), df.limit(0)).collect() == []


def test_very_many_ties_keep_the_smallest_ids(spark, monkeypatch):
    """One-hot vectors: nearly all products are zero."""
    monkeypatch.setattr(neighbours, "ROW_BLOCK", 100)
    rows = [(1000 - i, [1000.0 * (i % 50 == d) for d in range(50)]) for i in range(600)]
    df = spark.createDataFrame([(i, [x + 0.001 * (i % 7 == 3) * (x > 0) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    table = [(r.vec_id, r.embedding) for r in df.collect()]
    found = neighbours.nearest(df, df.filter("vec_id % 100 = 0"), k=20).collect()
    wanted = nearest_plain(table, [x for x in table if x[0] % 100 == 0], 20)
    for q, w in wanted.items():
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in own] == [i for i, _ in w]


@pytest.mark.parametrize("times", [1e9, 1e12, 1e160])
def test_one_long_row_does_not_blur_the_others(spark, monkeypatch, times):
    monkeypatch.setattr(neighbours, "ROW_BLOCK", 500)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16))
    x[1234] *= times
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = neighbours.nearest(df, df.filter("vec_id % 50 = 0"), k=20).collect()
    wanted = nearest_plain(list(enumerate(x)), [(i, x[i]) for i in range(0, 3000, 50)], 20)
    assert recall_of(found, wanted) >= 0.95
    for q, w in wanted.items():
        assert (1234 in [r.vec_id for r in found if r.query_id == q]) == (1234 in [i for i, _ in w])


def test_forest_finds_near_vectors():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16))
    forest = Forest(x[:1000], 8, 32, 1)
    leaves = forest.leaves_of(x)
    assert leaves.max() < forest.leaves and (np.bincount(leaves[:1000, 0], minlength=forest.leaves) >= 16).all()
    held = np.stack([np.bincount(leaves[:, t], minlength=forest.leaves) for t in range(8)])
    for i, found in enumerate(forest.probes(x[:20], held, 200)):
        assert (0, leaves[i, 0]) in found and sum(held[t, leaf] for t, leaf in found) >= 200
        assert len(set(found)) == len(found)


def plain_groups(texts):
    """The smallest doc_id of each group that a Jaccard of 0.8 or more over five-word shingles connects, by all pairs."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    label, own = {i: i for i in sets}, sorted(sets)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in own:
        for j in own:
            x, y = sets[i], sets[j]
            if j < i and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                label[max(root(i), root(j))] = min(root(i), root(j))
    return [i for i in own if root(i) == i]


def test_pipeline_against_plain_steps(spark):
    """Each stage keeps just what its operator decides, and all columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = f"{spark.conf.get('spark.checkpoint.dir')}/pipeline-test"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "mixing", "token_ids"]
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{path}/{i}")
        before, docs = docs, spark.read.parquet(f"{path}/{i}")
        kept.append((before, docs))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    before, after = kept[0]
    assert after.columns == before.columns
    assert ids(after) == ids(quality.classify(before, labels).filter("predicted = 1"))
    before, after = kept[1]
    assert ids(after) == ids(toxicity.classify(before, labels).filter("predicted = 0"))
    before, after = kept[2]
    assert after.columns == before.columns and ids(after) == sorted(plain_groups({r.doc_id: r.text for r in before.collect()}))
    before, after = kept[3]
    assert ids(after) == sorted(r.doc_id for r in mixing.counted(before).collect() for _ in range(r.copies))
    before, after = kept[4]
    own = bpe.codec(tokenizer("byte_bpe_50k.tiktoken"))
    text = {r.doc_id: r.text for r in before.collect()}
    rows = after.collect()
    assert len(rows) == before.count() and all(r.round_trip for r in rows)
    assert all(own.decode(r.ids).decode() == text[r.doc_id] for r in rows)


def test_stages_keep_columns_named_like_their_own(spark, tmp_path):
    path = str(tmp_path / "named")
    names = ["predicted", "quality_score", "toxic_score", "near_row", "row", "fp"]
    spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", *(f"concat('{n} ', doc_id) AS {n}" for n in names)).write.parquet(path)
    docs = spark.read.parquet(path)
    for _, stage in corpus_pipeline.STAGES[:3]:
        found = stage(spark, docs, SF)
        assert found.columns == docs.columns
        rows = found.select("doc_id", *names).collect()
        assert rows and all(r[n] == f"{n} {r.doc_id}" for r in rows for n in names)


def test_training_samples_are_bounded_by_rows_and_by_distinct_texts(spark):
    """One doc_id with very many rows, and one text in very many documents."""
    taught = [i for i in range(1, 600) if zlib.crc32(str(i).encode()) % 5]
    rows = [(taught[0], f"text {i % 90}") for i in range(400)] + [(i, "the same") for i in taught[1:200]] + [(i, f"own {i}") for i in taught[200:260]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in taught], "doc_id long, quality int")
    few = training_sample(docs, labels, "quality", 40).collect()
    assert len(few) == 40 and len({r.text for r in few}) == 40
    everything = training_sample(docs, labels, "quality", 1000).collect()
    assert sorted(r.text for r in everything) == sorted({t for _, t in rows})
    assert all(r.label == r.doc_id % 2 and (r.doc_id, r.text) in set(rows) for r in everything)


ODD_ROWS = [
    (1, None, "fr", None, 0), (2, "", "en", "a", 0), (None, "no id at all here", "en", "a", 17), (3, "x" * 300_000, "en", "b", 300_000), (4, "word " * 120_000, "en", "b", 600_000),
    (5, "one text that is there twice", "en", "a", 28), (5, "one text that is there twice", "en", "a", 28), (6, "ONE text  that is there twice", "en", "b", 29), (7, " \t\n", None, "b", 3),
]


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns, no labels, no rows."""
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    odd = spark.createDataFrame(ODD_ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    for n, some in enumerate((odd, odd.limit(0))):
        some.selectExpr("*", "'s' AS size", "1 AS copies", "'d' AS set_id", "'w' AS whole").write.parquet(f"{tmp_path}/docs-{n}")
        docs = spark.read.parquet(f"{tmp_path}/docs-{n}")
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{n}-{i}")
            before, docs = docs, spark.read.parquet(f"{tmp_path}/{n}-{i}")
            if name != "token_ids":
                assert docs.columns == before.columns
                assert all((r.size, r.copies, r.set_id, r.whole) == ("s", 1, "d", "w") for r in docs.collect())
            if name == "near_duplicates" and before.count():
                # texts without words are one group; of the three alike the smallest doc_id stays
                assert sorted(r.doc_id or 0 for r in before.collect()) == sorted(r[0] or 0 for r in ODD_ROWS)
                assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 1, 3, 4, 5]
            if name == "token_ids":
                assert all(r.round_trip for r in docs.collect())


def test_queries_of_other_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(1, 60)]
    asks = [(100 + i, rng.normal(size=6).tolist()) for i in range(9)] + [(200, [1.0, 0.0, 0.0, 0.0]), (200, [-1.0, 0.0, 0.0, 0.0]), (200, [-1.0, 0.0, 0.0, 0.0])]
    schema = "vec_id long, embedding array<double>"
    found = neighbours.nearest(spark.createDataFrame(rows, schema), spark.createDataFrame(asks, schema), k=5).collect()
    wanted = nearest_plain(rows, [(200, [-1.0, 0, 0, 0])], 5)[200]
    assert [(r.query_id, r.vec_id) for r in sorted(found, key=lambda r: r.rank)] == [(200, i) for i, _ in wanted]


def test_words_longer_than_a_run_are_read_whole(monkeypatch):
    rng = np.random.default_rng(12)
    letters = np.array(list("abcé\U0001f600"))
    long = ["".join(rng.choice(letters, n)) for n in (31, 32, 33, 34, 47, 48, 49, 65, 200, 1000)]
    texts = [*long, *(f"{w} {w}\n{w[:40]} x x" for w in long), *(f"some words  before {w}" for w in long), " ".join(long), f"ab {'x' * 100} {'x' * 100}\t"]
    scorer = quality.Scorer(rng.normal(size=quality.BUCKETS), 0.1)
    whole, scores = [quality.counts(t) for t in texts], scorer.score(texts)
    monkeypatch.setattr(quality, "RUN", 16)
    for t, (b, n) in zip(texts, whole, strict=True):
        assert "".join(quality.parts(t)) == t
        again = quality.counts(t)
        assert again[0].tolist() == b.tolist() and again[1].tolist() == n.tolist(), t
    assert np.allclose(scorer.score(texts), scores, rtol=1e-12)


def test_nearness_does_not_depend_on_runs():
    rng = np.random.default_rng(13)
    for _ in range(300):
        n = int(rng.integers(0, 80))
        hit, other = rng.random(n) < 0.3, rng.random(n) < 0.1
        plain = sum(bool(hit[i]) and bool(other[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1].any()) for i in range(n))
        cuts = np.sort(rng.integers(0, n + 1, int(rng.integers(0, 12))))
        own = toxicity.Nearness()
        for h, o in zip(np.split(hit, cuts), np.split(other, cuts), strict=True):
            own.add(np.flatnonzero(h), np.flatnonzero(o), len(h))
        assert own.total() == plain


def test_very_long_texts_have_the_features_of_their_words(monkeypatch):
    """Read run by run or at once, a text has the same features."""
    rng = random.Random(3)
    own = toxicity.Featuriser({toxicity.terms("idiot")[0]: 5.0})
    text = " ".join(rng.choice(["you", "idiot", "so", "a", "big", "WORD", "l0ser"]) for _ in range(5000))
    at_once = own.one(text)
    monkeypatch.setattr(toxicity, "word_runs", lambda t: (t.split()[i : i + 7] for i in range(0, len(t.split()), 7)))
    assert np.allclose(own.one(text), at_once, rtol=1e-6)


def trees_plain(x, y):
    """Margins on ``x`` of boosted trees that are grown by trying every feature and edge in loops."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, toxicity.BINS + 1)[1:-1])) for c in x.T]
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    total = np.full(len(y), np.log(share / (1 - share)))
    for _ in range(toxicity.TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)

        def leaves(rows, depth, g=g, h=h):
            best, found = 1e-6, None
            for f in range(x.shape[1]) if depth < toxicity.DEPTH else ():
                for e in edges[f]:
                    left, right = [i for i in rows if x[i, f] <= e], [i for i in rows if x[i, f] > e]
                    if min(len(left), len(right)) >= toxicity.LEAST_LEAF:
                        gain = sum(sum(g[i] for i in s) ** 2 / (sum(h[i] for i in s) + 1) for s in (left, right)) - sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + 1)
                        if gain > best + 1e-9:
                            best, found = gain, (left, right)
            return [rows] if found is None else [leaf for side in found for leaf in leaves(side, depth + 1)]

        for rows in leaves(list(range(len(y))), 0):
            total[rows] += -toxicity.SHRINK * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1)
    return total


def test_trees_against_plain_loops(monkeypatch):
    monkeypatch.setattr(toxicity, "TREES", 6)
    monkeypatch.setattr(toxicity, "BINS", 6)
    rng = np.random.default_rng(21)
    x = rng.normal(size=(160, 3))
    x[:, 2] = np.round(x[:, 2])
    y = (x[:, 0] + 0.5 * x[:, 1] * x[:, 2] + rng.normal(scale=0.3, size=160) > 0).astype(float)
    assert np.allclose(toxicity.Trees(x, y).margins(x), trees_plain(x, y), atol=1e-9)


def test_isotonic_against_min_max():
    """The value at a place is the largest, over blocks that begin before it, of the smallest mean that ends after it."""
    rng = np.random.default_rng(22)
    for _ in range(20):
        x, y = rng.permutation(40).astype(float), (rng.random(40) < 0.5).astype(float)
        own = y[np.argsort(x)]
        knots, share = toxicity.isotonic(x, y)
        means = [max(min(own[a : b + 1].mean() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
        sizes = [sum(abs(m - n) < 1e-12 for n in means) for m in means]
        smooth = np.maximum.accumulate([(m * n + 0.25) / (n + 0.5) for m, n in zip(means, sizes, strict=True)])
        assert np.allclose(np.interp(np.arange(40.0), knots, share), smooth)


def test_softmax_against_plain_loops(monkeypatch):
    monkeypatch.setattr(quality, "BUCKETS", 40)
    rng = np.random.default_rng(23)
    rows = [(np.sort(rng.permutation(40)[:k]), rng.integers(1, 5, k)) for k in rng.integers(1, 12, 30)] + [(np.empty(0, np.int64), np.empty(0, np.int64))]
    labels = (rng.random(len(rows)) < 0.4).astype(int)
    difference, bias = quality.train(rows, labels, epochs=3, rate=0.5, seed=5)
    draws, d, share = np.random.default_rng(5), quality.DIMENSIONS, labels.mean()
    vectors, output = (draws.uniform(-1, 1, (40, d)) / d).tolist(), (draws.normal(0, 1, (2, d)) / d).tolist()
    b, done = [np.log(1 - share), np.log(share)], 0
    for _ in range(3):
        for i in draws.permutation(len(rows)).tolist():
            buckets, counts = rows[i][0].tolist(), rows[i][1].tolist()
            weight = [c / max(1, sum(counts)) for c in counts]
            pace = 0.5 * (1 - done / (3 * len(rows)))
            done += 1
            average = [sum(w * vectors[k][j] for k, w in zip(buckets, weight, strict=True)) for j in range(d)]
            e = [np.exp(sum(output[c][j] * average[j] for j in range(d)) + b[c]) for c in (0, 1)]
            slope = [e[c] / sum(e) - (labels[i] == c) for c in (0, 1)]
            back = [slope[0] * output[0][j] + slope[1] * output[1][j] for j in range(d)]
            for c in (0, 1):
                output[c] = [output[c][j] - pace * slope[c] * average[j] for j in range(d)]
                b[c] -= 0.1 * pace * slope[c]
            for k, w in zip(buckets, weight, strict=True):
                vectors[k] = [vectors[k][j] - pace * w**0.5 * back[j] for j in range(d)]
    assert np.allclose(difference, [sum(v[j] * (output[1][j] - output[0][j]) for j in range(d)) for v in vectors], atol=1e-9)
    assert bias == pytest.approx(b[1] - b[0], abs=1e-9)
