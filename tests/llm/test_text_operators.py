"""Statistics, scores, outliers, links, repeats, against plain versions."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import boosting, components, outliers, recompression, signature_tree, statistics, words
from lodestone.llm import queries as Q

signs = st.sampled_from(["a", "b", "c", " ", "\n", "é ", "| ", "\t", "\x0b", "\r", "中", "　"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(signs, max_size=60).map("".join)), max_size=8))
def test_statistics_of_any_texts(texts):
    got = []
    for _, _, s in statistics.of_batch(pa.array(texts, pa.string())):
        got += list(zip(*(s[n].tolist() for n in outliers.BASE), strict=True))
    assert got == [brute.base_statistics(t) for t in texts]


def test_hashes_do_not_depend_on_place():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 100).astype(np.uint64)
    y = np.concatenate([rng.integers(0, 1 << 63, 37).astype(np.uint64), x])
    a, b = np.arange(0, 90), np.arange(5, 95)
    assert (words.span_hashes(x, a, b) == words.span_hashes(y, a + 37, b + 37)).all()
    assert len(set(words.span_hashes(x, a, b).tolist())) == 90


def test_outliers_on_odd_rows(odd, odd_rows, empty):
    got = outliers.judge(odd).collect()
    want = sorted(map(repr, ((r[0], *brute.base_statistics(r[1])) for r in odd_rows)))
    assert sorted(repr((r["doc_id"], *(r[n] for n in outliers.BASE))) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert outliers.judge(empty).collect() == []


def test_outliers_are_told_from_their_own_group(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        lang, size = ("aa", 4) if i % 2 else ("bb", 9)
        ws = ["".join(rng.choice("abcdef") for _ in range(max(1, int(rng.gauss(size, 1))))) for _ in range(80)]
        if i % 20 == 3:
            ws = [w + "|" for w in ws]
        rows.append((i, " ".join(ws), lang, "s"))
    kept = {r["doc_id"]: r["kept"] for r in outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [i for i, k in kept.items() if not k] == [i for i in sorted(kept) if i % 20 == 3] or {i for i, k in kept.items() if not k} == {i for i in kept if i % 20 == 3}


def test_outliers_that_are_copies_of_one_text(spark):
    rng = random.Random(6)
    rows = []
    for lang, n_junk in (("aa", 90), ("bb", 130), ("cc", 163)):  # 31, 39 and 45 per cent
        for i in range(200):
            ws = ["".join(rng.choice("abcdef") for _ in range(max(1, int(rng.gauss(5, 1))))) + ("|" if rng.random() < 0.03 else "") for _ in range(80)]
            rows.append((len(rows), " ".join(ws), lang, "s"))
        junk = " ".join("".join(rng.choice("#*$%&ab") for _ in range(5)) for _ in range(80))
        rows += [(len(rows) + i, junk, lang, "s") for i in range(n_junk)]
    junk = {r[0] for r in rows if "#" in r[1]}
    verdicts = outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert not any(r["base_failed"] for r in verdicts) and len(junk) == 383
    assert {r["doc_id"] for r in verdicts if not r["kept"]} == junk


def test_repeated_lines_alone_make_an_outlier(spark):
    rng = random.Random(8)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(max(1, int(rng.gauss(5, 1))))) for _ in range(2))
    rows = [(i, "\n".join(line() for _ in range(200)), "en", "s") for i in range(120)]
    some = [line() for _ in range(30)]
    rows.append((500, "\n".join(rng.choice(some) for _ in range(200)), "en", "s"))  # in changing order: the base rule passes it
    a_third = [line() for _ in range(134)]
    rows.append((501, "\n".join(a_third + rng.sample(a_third, 66)), "en", "s"))
    verdicts = outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert not any(r["base_failed"] for r in verdicts)
    assert [r["doc_id"] for r in verdicts if not r["kept"]] == [500]


def test_the_nearest_rows_weigh_the_share_together(spark):
    df = spark.createDataFrame([("g", 0, 0.0)] * 30 + [("g", 0, 5.0)] * 60 + [("g", 0, 90.0)] * 10 + [("h", 1, 1.0)] * 7, "grp string, start int, distance double")
    near = outliers._nearest(df).groupBy("grp", "distance").agg(F.sum("weight").alias("w")).collect()
    assert sorted((r["grp"], r["distance"], round(r["w"], 9)) for r in near) == [("g", 0.0, 30.0), ("g", 5.0, 20.0), ("h", 1.0, 3.5)]


def test_outlier_moments_are_those_of_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4)) * [1, 2, 3, 4] + [5, 0, 1, 2]
    df = spark.createDataFrame([("g", 0, *map(float, r)) for r in x], "grp string, start int, " + ", ".join(f"{p} double" for p in outliers.PARTS))
    r = outliers._moments(df).collect()[0]
    cov = np.cov(x.T, bias=True) * outliers.CONSISTENT
    cov = np.where(np.eye(4) > 0, cov, cov * 400 / (400 + outliers.FEW))
    assert np.allclose(r["mean"], x.mean(0)) and np.allclose(np.linalg.inv(cov).ravel(), r["inverse"], atol=1e-8) and np.isclose(r["logdet"], np.linalg.slogdet(cov)[1])


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_verdicts_are_those_of_plain_steps(spark, folder):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").collect()]
    want = brute.verdicts(rows, list(outliers.PARTS.values()), outliers.CUTOFF, outliers.CONSISTENT, outliers.SHRINK, outliers.FEW)
    got = {r["doc_id"]: r for r in Q.op2_quality_rules(spark, f"/root/testdata/{folder}").collect()}
    near = 0
    for k, (i, *_) in enumerate(rows):
        kept, distance = want[k]
        if distance is None or not 0.8 < distance / outliers.CUTOFF < 1.25:
            assert got[i]["kept"] == kept, (i, distance, got[i]["distance"])
        near += distance is not None and abs(got[i]["distance"] - distance) <= 0.25 * distance + 0.5
    assert near > 0.95 * sum(d is not None for _, d in want.values())


def plain_forest(x, y, trees, depth, rate, bins, least, ridge):
    """Boosted trees by trying every cut of every node; a tree is (feature, threshold, left, right) or a value."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    share = (y.sum() + 1) / (len(y) + 2)
    total, out = np.full(len(y), np.log(share / (1 - share))), []

    def grown(rows, g, h, level):
        value = -rate * g[rows].sum() / (h[rows].sum() + ridge)
        best = (1e-9, None)
        if level < depth and len(rows) >= 2 * least:
            for f in range(x.shape[1]):
                for cut in edges[f]:
                    a, b = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                    if min(len(a), len(b)) >= least:
                        gain = sum(g[s].sum() ** 2 / (h[s].sum() + ridge) for s in (a, b)) - g[rows].sum() ** 2 / (h[rows].sum() + ridge)
                        if gain > best[0] * (1 + 1e-12):
                            best = (gain, (f, cut, a, b))
        if best[1] is None:
            return value
        f, cut, a, b = best[1]
        return f, cut, grown(a, g, h, level + 1), grown(b, g, h, level + 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        out.append(grown(np.arange(len(y)), p - y, p * (1 - p), 0))
        total = total + np.array([walked(out[-1], r) for r in x])
    return 1 / (1 + np.exp(-total)), out


def walked(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def test_forest_is_that_of_plain_boosting(monkeypatch):
    monkeypatch.setattr(boosting, "TREES", 8)
    monkeypatch.setattr(boosting, "DEPTH", 3)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(260, 5))
    x[:, 2] = np.round(x[:, 2])  # ties
    y = (x[:, 0] + x[:, 2] * x[:, 3] + rng.normal(size=260) > 0).astype(float)
    want, _ = plain_forest(x, y, 8, 3, boosting.RATE, boosting.BINS, boosting.LEAST_ROWS, boosting.RIDGE)
    assert np.allclose(boosting.fit(x, y).score(x), want, atol=1e-9)


def test_scores_are_those_of_a_plain_walk_through_the_trees(spark, odd, odd_rows):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    forest = boosting.learn(docs, labels)

    def tree(t, at=0, level=0):
        if level == boosting.DEPTH or forest.left[t][at] == at:
            return forest.value[t][at]
        return int(forest.feature[t][at]), forest.threshold[t][at], tree(t, forest.left[t][at], level + 1), tree(t, forest.right[t][at], level + 1)

    trees = [tree(t) for t in range(len(forest.feature))]
    rows = [(r[0], r[1] or "") for r in odd_rows]
    made = [s for _, _, s in statistics.of_batch(pa.array([t for _, t in rows]))]
    x = np.concatenate([boosting.features(s) for s in made])
    want = sorted((repr(i), round(float(1 / (1 + np.exp(-forest.start - sum(walked(t, v) for t in trees)))), 9)) for (i, _), v in zip(rows, x, strict=True))
    assert sorted((repr(r["doc_id"]), round(r["score"], 9)) for r in boosting.score(odd, forest).collect()) == want


def test_quality_scores(spark, data):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in Q.op1_quality_classifier(spark, "/root/testdata/sf0.01").collect()]
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95


def test_quality_scores_of_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    forest = boosting.learn(odd, labels)
    got = boosting.score(odd, forest).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert boosting.score(empty, boosting.learn(empty, labels)).collect() == []
    assert 0 < boosting.learn(odd, labels.where("false")).score(np.zeros((1, 5)))[0] < 1


def test_flat_trees_split_where_they_should():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    p = boosting.fit(x[:3000], y[:3000]).score(x[3000:])
    assert ((p > 0.5) == y[3000:]).mean() > 0.97


@pytest.mark.parametrize("width", [5, 50])
def test_repeats_on_odd_rows(odd, odd_rows, empty, width):
    digest = F.sha2(F.col("kept_text").cast("binary"), 256)
    got = recompression.remove_repeats(odd, width).select("doc_id", "n_words", "n_removed", digest).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, brute.without_repeats([r[:2] for r in odd_rows], width)))
    assert recompression.remove_repeats(empty).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=12, max_size=80), st.lists(st.integers(0, 2), max_size=30), st.lists(st.integers(0, 2), max_size=30))
def test_a_window_has_one_anchor_wherever_it_stands(window, before, after):
    def anchored(values, start):
        h = words.mix(np.array(values, np.uint64) + np.uint64(9))
        name, low, high, _ = recompression.anchors(h, np.zeros(len(h), np.int64), np.array([start]), len(window))
        return name[0]

    assert anchored(window, 0) == anchored([*before, *window, *after], len(before))


def test_substring_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = Q.op6_substring_dedup(spark, data).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, brute.without_repeats([(r["doc_id"], r["text"]) for r in docs.collect()])))


@pytest.mark.parametrize("tiles", [(512, 192), (8, 4)])
def test_links_on_odd_rows(monkeypatch, spark, odd, odd_rows, empty, tiles):
    monkeypatch.setattr(signature_tree, "KEY_TILE", tiles[0])
    monkeypatch.setattr(signature_tree, "FAMILY_TILE", tiles[1])
    rng = random.Random(2)
    base = [f"v{rng.randrange(400)}" for _ in range(200)]
    near = []
    for i in range(1000, 1040):
        ws = list(base)
        for _ in range(rng.randint(0, 9)):
            ws[rng.randrange(len(ws))] = f"e{rng.randrange(10**6)}"
        near.append((i, " ".join(ws), "en", "s0"))
    rows = [r[:2] for r in odd_rows] + [r[:2] for r in near]
    docs = odd.unionByName(spark.createDataFrame([(*r, None, "x", 1, None) for r in near], odd.schema))
    got = signature_tree.link_documents(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, brute.linked(rows)))
    assert signature_tree.link_documents(empty).collect() == []


def test_jaccard_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = Q.op8_ngram_jaccard(spark, data).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, brute.linked([(r["doc_id"], r["text"]) for r in docs.collect()])))


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6))
def test_tree_traversal_finds_all_components(seed):
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    sets = [np.unique(rng.choice(pool[:40] if k % 2 else pool[20:], rng.integers(1, 40))) for k in range(rng.integers(2, 40))]
    group = np.arange(len(sets))
    for x, y in signature_tree.connect(sets, group.copy(), 60):
        group[group == group[y]] = group[x]
    want = np.arange(len(sets))
    for a in range(len(sets)):
        for b in range(a):
            if signature_tree.linked(sets[a], sets[b], 60):
                want[want == want[a]] = want[b]
    assert [list(group == group[k]) for k in range(len(sets))] == [list(want == want[k]) for k in range(len(sets))]


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(500, k) for k in range(501, 600)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {n: x for n, x in label.items() if n != x}
    assert components.components(spark.createDataFrame([], "a int, b int")).collect() == []


def test_very_long_texts_of_many_words(spark):
    """Over the slice of a megabyte, by far, and alike but for some words."""
    rng = np.random.default_rng(12)
    body = [f"w{k}" for k in rng.integers(0, 4000, 250_000)]
    other = list(body)
    for k in rng.integers(0, len(other), 60):
        other[k] = "changed"
    rows = [(1, " ".join(body)), (2, "\n".join(other)), (3, "a few words of a short text that say nothing at all"), (4, " ".join(body[100_000:100_120]))]
    df = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string").repartition(2)
    digest = F.sha2(F.col("kept_text").cast("binary"), 256)
    got = recompression.remove_repeats(df).select("doc_id", "n_words", "n_removed", digest).collect()
    assert sorted(map(tuple, got)) == sorted(brute.without_repeats(rows))
    linked = signature_tree.link_documents(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, linked)) == sorted(brute.linked(rows))
    base = {r["doc_id"]: tuple(r[n] for n in outliers.BASE) for r in outliers.judge(df).collect()}
    assert base == {i: brute.base_statistics(t) for i, t in rows}
