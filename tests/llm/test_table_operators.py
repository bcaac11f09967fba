"""Tokens, shards, packing, mixing, id files, neighbours, the pipeline."""

import glob
import os
import zlib

import brute
import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import idcodec, mixing, neighbours, packing, prefix_counts, sharding, tokens
from lodestone.llm import queries as Q

PIECES = ["a", "s", "t", "re", "'", "'s", "'ll", " ", "  ", "\n", "\t", "\r\n", "12", "é", "中", "😀", "!", " ", "　", "<|endoftext|>", "<|", "\x00", "the", "Ωing"]


@settings(max_examples=80, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(PIECES), max_size=20).map("".join), max_size=5))
def test_ids_are_those_of_the_library(tokenizer, tokenizer_path, texts):
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for made in (tokens.byte_level(tokenizer_path), prefix_counts.table(tokenizer_path).pieces):
        n, flat = made.ids(texts)
        assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])][: len(texts)] == want


def test_forgetting_changes_nothing(monkeypatch, tokenizer, tokenizer_path):
    monkeypatch.setattr(tokens, "REMEMBERED", 8)
    made = tokens.Pieces(tokens.byte_level(tokenizer_path).encode, {})
    for k in range(20):
        text = " ".join(f"word{(k * j) % 7} other{j % 3}" for j in range(5))
        assert made.ids([text])[1].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=40, deadline=None)
@given(text=st.lists(st.sampled_from(PIECES), max_size=16).map("".join), limit=st.integers(0, 12))
def test_every_prefix_has_its_exact_count(tokenizer, tokenizer_path, text, limit):
    table = prefix_counts.table(tokenizer_path)
    want = [len(e.ids) for e in tokenizer.encode_batch([text[:k] for k in range(len(text) + 1)], add_special_tokens=False)]
    assert table.prefix_counts(text).tolist() == want
    assert table.longest_within(text, limit) == max(k for k, n in enumerate(want) if n <= limit)


def kept_chars(tokenizer, text, limit):
    """Code points of the longest prefix within the limit, by encoding the prefixes around the place."""
    if len(tokenizer.encode(text, add_special_tokens=False).ids) <= limit:
        return len(text)
    ends = [e for _, e in tokenizer.encode(text, add_special_tokens=False).offsets]
    middle = ends[limit] if limit < len(ends) else len(text)
    near = range(max(0, middle - 60), min(len(text), middle + 60) + 1)
    return max((k for k in near if len(tokenizer.encode(text[:k], add_special_tokens=False).ids) <= limit), default=0)


def test_token_counts_of_odd_rows(odd, odd_rows, empty, tokenizer, tokenizer_path):
    got = prefix_counts.count_tokens(odd, tokenizer_path, 100).collect()
    n = [len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) for r in odd_rows]
    want = [(r[0], len((r[1] or "").encode()), k, k > 100, kept_chars(tokenizer, r[1] or "", 100)) for r, k in zip(odd_rows, n, strict=True)]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert prefix_counts.count_tokens(empty, tokenizer_path).collect() == []
    short = odd.where(F.length("text") < 300)
    for r in prefix_counts.store_prefix_counts(short, tokenizer_path).join(short, "doc_id").collect()[:20]:
        assert r["prefix_tokens"][-1] == len(tokenizer.encode(r["text"], add_special_tokens=False).ids) or r["doc_id"] in (20, 40, 89)


@settings(max_examples=40, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), max_size=4), limit=st.integers(0, 14))
def test_the_limit_is_found_from_counts_of_pieces(tokenizer, tokenizer_path, texts, limit):
    table = prefix_counts.table(tokenizer_path)
    n, kept = table.measured(texts, limit)
    assert n.tolist() == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert kept.tolist() == [table.longest_within(t, limit) for t in texts]


def test_many_special_strings_in_a_text(tokenizer_path):
    table = prefix_counts.table(tokenizer_path)
    assert table.prefix_counts("<|endoftext|>" * 3000)[-1] == 3000 and table.longest_within("<|endoftext|>" * 3000, 7) == 7 * 13


def test_pieces_that_clash_are_told_apart(monkeypatch, tokenizer, tokenizer_path):
    monkeypatch.setattr(tokens, "byte_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(8))
    made = tokens.Pieces(tokens.byte_level(tokenizer_path).encode, {})
    for text in ("one two three", "six\n ten  one", "", " a b c", "one two three"):
        assert made.ids([text, "the end"])[1].tolist() == [x for t in (text, "the end") for x in tokenizer.encode(t, add_special_tokens=False).ids]


def checked_shards(rows, got, shards):
    size = {}
    for r in got:
        assert r["size"] >= 1
        size.setdefault(r["shard"], []).append(r)
    for part in size.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    target, most = sum(r["size"] for r in got) / shards, max(r["size"] for r in got)
    assert all(0 <= s < shards for s in size) and all(abs(sum(r["size"] for r in size.get(s, [])) - target) <= most for s in range(shards))
    assert sorted(map(repr, ((r["doc_id"], r["size"], r["text_crc32"]) for r in got))) == sorted(map(repr, ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)))
    order = [(r["shard"], r["slot"], -1 if r["doc_id"] is None else r["doc_id"]) for r in got]
    assert [x[2] for x in sorted(order)] == sorted(x[2] for x in order)


def test_shards_of_odd_rows(odd, odd_rows, empty):
    checked_shards([r[:2] for r in odd_rows], sharding.shard_by_bytes(odd, 4).collect(), 4)
    assert sharding.shard_by_bytes(empty).collect() == []


def test_shard_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    got = Q.op4_sharding(spark, data).collect()
    checked_shards([(r["doc_id"], r["text"]) for r in docs], got, 16)
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}


def checked_packs(docs, got, capacity, end):
    """docs: (id, ids). Every id of every document in exactly one piece, sequences gapless; the share of padding."""
    sequences, pieces = {}, []
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.append((r["doc_id"], r["doc_tokens"], r["start"], r["length"], r["ids_crc32"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= capacity
    # Documents alike in id and length may be cut alike; each piece is one of some such document, and all ids are covered.
    want = {}
    for i, ids in docs:
        want.setdefault((i, len(ids) + 1), []).append([*ids, end])
    begun, ended = {}, {}
    for i, total, start, n, crc in pieces:
        assert any(brute.crc(ids[start : start + n]) == crc for ids in want[i, total])
        begun.setdefault((i, total), []).append(start)
        ended.setdefault((i, total), []).append(start + n)
    for (i, total), same in want.items():
        assert sorted(begun[i, total] + [total] * len(same)) == sorted(ended[i, total] + [0] * len(same))
    assert set(begun) == set(want)
    total = [sum(n for _, n in p) for p in sequences.values()]
    return sum(capacity - t for t in total if t & (t - 1)) / max(1, sum(total))


def test_packs_of_odd_rows(odd, odd_rows, empty, tokenizer, tokenizer_path):
    docs = [(r[0], tokenizer.encode(r[1] or "", add_special_tokens=False).ids) for r in odd_rows]
    assert checked_packs(docs, packing.pack(odd, tokenizer_path, 64, 0).collect(), 64, 0) < 0.05
    assert packing.pack(empty, tokenizer_path).collect() == []


@pytest.mark.parametrize("most", [60, 600, 3000])
def test_bins_of_any_lengths(most):
    rng = np.random.default_rng(most)
    sizes = rng.integers(1, most, 5000).tolist()
    bins = packing.Bins(1024)
    for k, n in enumerate(sizes):
        bins.add(packing.Document(k, np.arange(n, dtype="<u4").tobytes()))
    bins.end()
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    got = [dict(zip(names, x, strict=True)) for x in bins.taken()]
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for k, n in enumerate(sizes):
        ends = [0, *(a + m for a, m in sorted(by_doc[k]))]
        assert [a for a, _ in sorted(by_doc[k])] == ends[:-1] and ends[-1] == n
    room = {}
    for r in got:
        room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in room.values():
        ends = [0, *(a + m for a, m in sorted(parts))]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 1024
    assert sum(1024 - sum(n for _, n in parts) for parts in room.values()) < 0.02 * sum(sizes)


def test_short_documents_stay_whole(spark, tokenizer_path):
    got = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), tokenizer_path).groupBy("doc_id", "doc_tokens").count().collect()
    short = [r["count"] for r in got if r["doc_tokens"] <= 1024]
    assert sum(n > 1 for n in short) < 0.1 * len(short)


def test_pack_query(spark, data, tokenizer):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    ids = [(r["doc_id"], tokenizer.encode(r["text"], add_special_tokens=False).ids) for r in docs]
    assert checked_packs(ids, Q.op5_packing(spark, data).collect(), 1024, 0) < 0.02


def test_mix_query_is_its_sql(spark, data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    key = lambda t: sorted(repr(sorted(r.items())) for r in t.to_pylist())
    for name, sql in Q.oracle_sql().items():
        assert key(Q.queries()[name](spark, data).toArrow()) == key(c.sql(sql).to_arrow_table())


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def test_mix_of_odd_rows(odd, odd_rows, empty):
    got = mixing.mix_to_weights(odd).collect()
    sizes = {}
    for r in odd_rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(brute.words(r[1]))
    want = plain_targets(sizes)
    taken, largest = {}, {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0) <= (r["taken"] == 0)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    assert all(abs(taken[s] - want[s]) <= 1.5 * largest[s] for s in want)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_to_weights(odd.repartition(5)).collect()))
    assert mixing.mix_to_weights(empty).collect() == []


def test_mixed_documents_are_the_mix(odd, empty):
    plan = {}
    for r in mixing.mix_to_weights(odd).where("size > 0").collect():
        plan[r["doc_id"]] = plan.get(r["doc_id"], 0) + r["taken"]
    rows = mixing.mixed_documents(odd)
    assert rows.columns == odd.columns
    got = {}
    for r in rows.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(brute.words(r["text"]))
    assert got == {i: n for i, n in plan.items() if n}
    assert mixing.mixed_documents(empty).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=300))
def test_code_lengths(counts):
    n = idcodec.code_lengths(np.array(counts), 10)
    assert n.max() <= 10 and (len(n) == 1 or sum(2.0**-n) == 1)
    if len(counts) < 40:  # the limit does not bind
        import heapq

        heap = [(c, k) for k, c in enumerate(counts)]
        heapq.heapify(heap)
        cost, fresh = 0, len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a[0] + b[0]
            heapq.heappush(heap, (a[0] + b[0], fresh := fresh + 1))
        assert (np.array(counts) * idcodec.code_lengths(np.array(counts), 40)).sum() == (cost or counts[0])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=700))
def test_codes_round_trip(ids):
    ids = np.array(ids, np.uint32)
    symbols, counts = np.unique(ids, return_counts=True)
    book = idcodec.Book(symbols, idcodec.code_lengths(counts))
    bits, marks = book.encode(ids)
    assert (book.decode(bits, len(ids), marks) == ids).all()


def test_id_files_of_odd_rows(spark, odd, odd_rows, empty, tokenizer, tokenizer_path, monkeypatch):
    monkeypatch.setattr(idcodec, "BLOCK", 300)
    folder = idcodec.write_ids(odd, tokenizer_path)
    got = sorted(idcodec.read_ids(spark, folder).collect(), key=lambda r: r["start"])
    ids = [[*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in odd_rows]
    assert sorted(repr((r["doc_id"], r["ids"])) for r in got) == sorted(repr((r[0], i)) for r, i in zip(odd_rows, ids, strict=True))
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += len(r["ids"])
    assert [-1 if r["doc_id"] is None else r["doc_id"] for r in got] == sorted(-1 if r[0] is None else r[0] for r in odd_rows)
    assert idcodec.read_ids(spark, idcodec.write_ids(empty, tokenizer_path)).collect() == []


def test_id_file_query(spark, data, tokenizer):
    docs = sorted(spark.read.parquet(f"{data}/documents.parquet").collect(), key=lambda r: r["doc_id"])
    want, at = [], 0
    for r in docs:
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], at, len(ids), brute.crc(ids)))
        at += len(ids)
    assert sorted(tuple(r) for r in Q.op10_token_binary(spark, data).collect()) == want


def plain_neighbours(rows, k=5):
    usable = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in usable:
        if i % 50 == 0:
            near = [(-float(neighbours.cosines(np.array([v]), np.array([w]))[0]), j) for j, w in usable if j != i and len(w) == len(v)]
            out[i] = sorted(near)[:k]
    return out


@pytest.mark.parametrize("tile", [4096, 16])
def test_neighbours_of_odd_rows(spark, monkeypatch, tile):
    monkeypatch.setattr(neighbours, "TILE", tile)
    monkeypatch.setattr(neighbours, "QUERY_TILE", tile)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows[100:180] = [(i, rows[100][1]) for i in range(100, 180)]  # one very common vector
    rows += [(400, None), (401, [0.0] * 8), (402, [float("nan")] + [1.0] * 7), (450, [None] + [1.0] * 7), (None, [1.0] * 8), (403, [1.0, 2.0]), (500, [2.0, 2.0]), rows[50], (600, [2 * x for x in rows[100][1]]), (650, []), (403, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, None) for r in rows], "vec_id long, embedding array<float>, class string").repartition(3)
    got = {}
    for r in sorted(neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    want, every = plain_neighbours(rows), plain_neighbours(rows, len(rows))
    assert {i: len(n) for i, n in got.items()} == {i: len(n) for i, n in want.items() if n}
    assert all(n == sorted(n) and set(n) <= set(every[i]) for i, n in got.items())  # exact scores, in order, ties by id
    assert sum(len(set(n) & set(want[i])) for i, n in got.items()) >= 0.9 * sum(map(len, want.values()))
    assert neighbours.nearest(df.where("false"), F.col("vec_id") % 50 == 0).collect() == []


def test_neighbours_that_tie_go_by_id(spark):
    rng = np.random.default_rng(5)
    rows = [(0, [1.0] * 16)]
    for i in range(1, 2000):  # all with the same cosine to the first
        ones = rng.permutation(16)[:8]
        rows.append((i, [float(k in ones) for k in range(16)]))
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "vec_id long, embedding array<float>").repartition(3)
    got = neighbours.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4, 5] and len({r["score"] for r in got}) == 1


def recall(rows, got, k=5):
    """rows: ids and vectors. Share of the true neighbours of the queries in ``got``; each query has as many rows as it can."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        near = x @ x[q]
        near[q] = -2
        want = set(ids[np.argsort(-near)[: min(k, len(ids) - 1)]].tolist())
        assert len(got[ids[q]]) == min(k, len(ids) - 1)
        hits, total = hits + len(want & got[ids[q]]), total + len(want)
    return hits / total


def found(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    return got


def looked_at(rows, plan):
    """The share of all rows that the queries look at, from their keys."""
    ids, x = np.array([r[0] for r in rows]), neighbours._units(np.array([r[1] for r in rows], np.float64))
    tables, rotations, probes, _ = plan[x.shape[1]]
    asks, seen = np.flatnonzero(ids % 50 == 0), 0
    assert probes
    for q in asks:
        met = np.zeros(len(x), bool)
        for t in range(tables):
            met |= np.isin(neighbours.keys_of(x, t, rotations)[:, 0], neighbours.keys_of(x[[q]], t, rotations, probes)[0])
        seen += met.sum()
    return seen / len(asks) / len(x)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_neighbour_query_recall(spark, monkeypatch, sf):
    folder, plans, real = f"/root/testdata/{sf}", [], neighbours._plan
    monkeypatch.setattr(neighbours, "_plan", lambda *a: plans.append(real(*a)) or plans[-1])
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    assert recall(rows, found(Q.op7_nearest_neighbours(spark, folder))) >= 0.9
    assert looked_at(rows, plans[0]) < 0.5


def test_cosines_of_very_large_and_small_vectors(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 2e200]), (2, [1.0, 0.0]), (50, [1e-200, 1e-200]), (3, [5e-324, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], pytest.approx(r["score"], abs=1e-15)))
    half, three = 0.5**0.5, 3 / 10**0.5
    assert got == {0: [(50, 1.0), (1, three), (2, half), (3, half)], 50: [(0, 1.0), (1, three), (2, half), (3, half)]}


def test_every_dimension_has_a_plan(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=d).tolist()) for d in (3, 8, 16, 24, 32, 40, 48) for i in range(d * 1000, d * 1000 + 400)]
    classes = spark.createDataFrame([(i, i, v, i % 50 == 0) for i, v in rows], "number long, first long, vector array<double>, asks boolean")
    plan = neighbours._plan(classes, 5, neighbours.TABLES, neighbours.ROTATIONS)
    assert len(plan) == 7 and all(p[2] for p in plan.values())


@pytest.mark.parametrize(("n", "dims", "spread"), [(8, 64, 1), (8, 512, 1), (60, 512, 1), (3000, 256, 0.05), (3000, 768, 0.03), (4000, 256, 1)])
def test_recall_in_any_dimension(spark, n, dims, spread):
    rng = np.random.default_rng(n + dims)
    centres = rng.normal(size=(max(1, n // 30), dims)) / np.sqrt(dims)
    x = (centres[rng.integers(0, len(centres), n)] * (spread < 1) + spread * rng.normal(size=(n, dims))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    assert recall(rows, found(neighbours.nearest(df, F.col("vec_id") % 50 == 0))) >= 0.9


def test_structured_vectors_are_found_by_few_looks(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 64))[rng.integers(0, 200, 6000)] + 0.2 * rng.normal(size=(6000, 64))
    df = spark.createDataFrame([(i, i, v.tolist(), i % 50 == 0) for i, v in enumerate(x)], "number long, first long, vector array<double>, asks boolean")
    tables, rotations, probes, _ = neighbours._plan(df, 5, neighbours.TABLES, neighbours.ROTATIONS)[64]
    assert probes and tables * probes < 0.1 * 128**rotations


def test_rotations_keep_lengths_and_keys_are_the_nearest_axes():
    x = np.random.default_rng(2).normal(size=(50, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = neighbours.rotate(x, 9)
    assert np.allclose(np.linalg.norm(y, axis=1), 1) and np.allclose(y @ y.T, x @ x.T)
    one = neighbours.keys_of(x, 3, 1, 4)
    assert (one[:, 0] // 2 == np.abs(y).argmax(1)).all() and ((one[:, 0] % 2 == 1) == (y[np.arange(50), one[:, 0] // 2] > 0)).all()
    ends = [neighbours._both_ends(x, 9), neighbours._both_ends(x, 10)]
    for row, keys in enumerate(neighbours.keys_of(x, 3, 2, 10)):
        total = (ends[0][row][:, None] + ends[1][row][None, :]).ravel()
        assert keys.tolist() == sorted(range(len(total)), key=lambda k: (-total[k], k))[:10]


def test_pipeline_stages(spark, data, tokenizer):
    """Each stage against a plain version of its decision, on what its predecessor kept."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    first = corpus_pipeline.quality_rules(spark, docs, data)
    kept = {r["doc_id"]: r["text"] for r in first.collect()}
    assert first.columns == columns and set(kept.items()) <= set(rows.items()) and kept
    failed = {i for i, t in rows.items() if (s := brute.base_statistics(t))[0] < 10 or 100 * s[4] > 20 * s[0]}
    assert not failed & set(kept)
    second = corpus_pipeline.near_duplicates(spark, first, data)
    got = {r["doc_id"]: r["text"] for r in second.collect()}
    assert second.columns == columns and set(got) == {c for _, _, c in brute.linked(list(kept.items()), 5, 80)}
    third = corpus_pipeline.repeated_passages(spark, second, data)
    left = {r["doc_id"]: r["text"] for r in third.collect()}
    want = {i: (n, gone, digest) for i, n, gone, digest in brute.without_repeats(list(got.items()))}
    import hashlib

    assert third.columns == columns and set(left) == {i for i, (n, gone, _) in want.items() if not gone or gone < n}
    assert all(hashlib.sha256(" ".join(brute.words(t)).encode()).hexdigest() == want[i][2] for i, t in left.items())
    fourth = corpus_pipeline.source_mix(spark, third, data)
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix_to_weights(third).where("size > 0").collect()}
    count = {}
    for r in fourth.collect():
        assert r["text"] == left[r["doc_id"]]
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    assert fourth.columns == columns and count == {i: n for i, n in taken.items() if n}
    packs = corpus_pipeline.packed(spark, fourth, data).collect()
    ids = [(i, tokenizer.encode(left[i], add_special_tokens=False).ids) for i, n in count.items() for _ in range(n)]
    checked_packs(ids, packs, 1024, 0)


def test_pipeline_on_odd_rows_and_nothing(spark, odd, empty, data):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs.select([c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns]) if "text" in docs.columns else docs, data)
        assert "sequence_id" in docs.columns
        docs.collect()


def test_pipeline_runs(spark, data):
    assert corpus_pipeline.run(spark, data).count()


def test_stages_carry_columns_of_any_name(spark, odd_rows, data):
    odd_names = ["a.b", "row", "key", "x`y", "class", "body"]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), k, None, "t", 2.5, [1, 2], "") for k, r in enumerate(odd_rows)], "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, `row` string, `key` string, `x``y` double, `class` array<int>, body string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        given = {r["doc_id"]: r["a.b"] for r in docs.select("doc_id", "`a.b`").collect()}
        docs = stage(spark, docs, data)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *odd_names]
        rows = docs.collect()
        assert rows and all(r["class"] == [1, 2] and r["x`y"] == 2.5 and r["doc_id"] in given for r in rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count()
