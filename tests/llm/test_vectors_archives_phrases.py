"""Whitening, WARC archives, phrases: against plain versions, on odd rows, and on files of others."""

import gzip
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from lodestone.llm import phrases, warc, whitening
from lodestone.llm import queries as Q

# --- whitening


def plain_whitening(rows, components=4):
    """{(vec_id, place): [(component, n, deviation, whitened, explained)]} for vectors of one dimension, by a whole covariance."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v) and len(v)]
    x = {tuple(math.floor(256 * float(np.float64(c))) + 0 for c in v) for _, v in good}
    fit = np.array(sorted(x), object)
    n, s = len(fit), fit.sum(0)
    centred = fit.astype(float) - np.array([float(v) / n for v in s])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, v in good:
        w = np.array([math.floor(256 * float(c)) for c in v], object)
        deviation = sum(int(n * a - b) ** 2 for a, b in zip(w, s, strict=True))
        y = (w.astype(float) - np.array([float(b) / n for b in s])) @ vectors
        out += [(i, k + 1, n, deviation, y[k] / math.sqrt(values[k]) if values[k] > 1e-13 * values.sum() else None, values[k] / values.sum()) for k in range(min(components, len(values)))]
    return out


def same_whitening(got, want, signs=True):
    got, want = sorted(map(tuple, got), key=repr), sorted(want, key=repr)
    got = sorted(got, key=lambda r: (repr(r[0]), r[1], r[3], abs(r[4] or 0)))
    want = sorted(want, key=lambda r: (repr(r[0]), r[1], r[3], abs(r[4] or 0)))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    sign = {}
    for g, w in zip(got, want, strict=True):
        assert (g[4] is None) == (w[4] is None)
        if w[4] is not None:
            if abs(w[4]) > 1e-3:
                assert sign.setdefault(g[1], np.sign(g[4] * w[4])) == np.sign(g[4] * w[4])
            assert abs(abs(g[4]) - abs(w[4])) < 1e-7 and g[6] < 1e-9
        assert abs(g[5] - w[5]) < 1e-9


def test_whitening_query(spark, data):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    same_whitening(Q.op11_embedding_whitening(spark, data).collect(), plain_whitening(rows))


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) * (k + 1) for k in range(6)]) for i in range(40)]
    rows += [(40, None), (41, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (42, [nan] * 6), (43, [inf, *[0.0] * 5]), (None, [1e-9, -0.0, 0.0, 0.0, 0.0, -1e-9]), (7, rows[7][1]), (44, rows[7][1]), (45, [0.0] * 6)]
    short = [(i, [rng.random(), rng.random()]) for i in range(100, 120)]
    df = spark.createDataFrame([(i, v, 1, "z") for i, v in [*rows, *short, (200, [])]], "vec_id long, embedding array<double>, n int, x string").repartition(3)
    got = whitening.whiten(df).collect()
    same_whitening([r for r in got if r["vec_id"] is None or r["vec_id"] < 100], plain_whitening(rows))
    same_whitening([r for r in got if (r["vec_id"] or 0) >= 100], plain_whitening(short))
    assert whitening.whiten(df.where("vec_id IN (40, 41, 200)")).collect() == []
    assert whitening.whiten(df.limit(0)).collect() == []


def test_whitening_without_variance(spark):
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(5)], "vec_id long, embedding array<float>")
    got = whitening.whiten(flat).orderBy("vec_id", "component").collect()
    assert len(got) == 15 and all((r["whitened"] is None) == (r["component"] > 1) for r in got)
    one = whitening.whiten(flat.where("vec_id = 3")).collect()
    assert len(one) == 3 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, None, None, None)}


def test_deviations_past_64_bits_are_exact():
    x = np.array([[2**40, -5], [3, 2**50]], np.int64)
    s = [2**60, 7]
    assert whitening.deviations(x, 1000, s) == [sum((1000 * int(a) - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]


@settings(max_examples=30, deadline=None)
@given(d=st.integers(1, 60), rank=st.integers(1, 60), block=st.integers(4, 9), most=st.integers(3, 5), seed=st.integers(0, 99))
def test_lanczos_restarts_and_breaks_down(d, rank, block, most, seed):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((d, min(rank, d))) * 2.0 ** -np.arange(min(rank, d))
    a = a @ a.T
    values, vectors = whitening.block_lanczos(lambda b: a @ b, d, 4, block, most)
    want = np.linalg.eigvalsh(a)[::-1][: min(4, d)]
    assert np.allclose(values, want, atol=1e-10 * want[0])
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-10)
    assert np.abs(a @ vectors - vectors * values).max() < 1e-9 * want[0]


# --- WARC


def plain_archive(rows, least=100):
    out = []
    for page, _, html in rows:
        p = (html or "").encode()
        ids = [i for i, _, h in rows if (h or "").encode() == p and i is not None]
        again = len(p) >= least and ids and (page is None or page > min(ids))
        out.append((page, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", min(ids) if again else None))
    return sorted(out, key=repr)


ODD_PAGES = [(i, f"http://x/{i}", "<p>" + "same " * 40) for i in range(5, 30)] + [
    (None, "http://n", "<p>" + "same " * 40), (1, None, None), (2, "", ""), (3, "http://x/ä b\r\nWARC-Type: x", "short"), (4, "u", "short"), (50, "big", "é" * 700_000), (51, "words", "a b\r\n\r\nWARC/1.1\r\n" * 3000),
    (7, "again", "<p>" + "same " * 40), (5, "http://x/5", "<p>" + "same " * 40), (60, "x", "q" * 100), (61, "x", "q" * 100), (62, "x", "q" * 99), (63, "x", "q" * 99), (None, "u", "nulls " * 30), (None, "v", "nulls " * 30),
]


@pytest.mark.parametrize("level", ["0", "6"])
def test_archives_of_odd_pages(spark, level):
    pages = spark.createDataFrame([(*r, "x", 1) for r in ODD_PAGES], "page_id long, url string, html string, record_type string, payload int").repartition(4)
    folder = warc.archive_pages(pages, level=level, file_bytes="20000")
    got = warc.read_archives(spark, folder, partition_bytes="30000")
    assert sorted(map(tuple, warc.pages_of(got).collect()), key=repr) == plain_archive(ODD_PAGES)
    urls = {r["u"] for r in got.where("record_type <> 'warcinfo'").select(F.col("target_uri").alias("u")).collect()}
    assert urls == {u for _, u, _ in ODD_PAGES}
    texts = {r["p"].decode() for r in got.where("record_type = 'response'").select(F.col("payload").alias("p")).collect()}
    assert texts == {h or "" for _, _, h in ODD_PAGES}


def test_archives_of_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.pages_of(warc.read_archives(spark, warc.archive_pages(empty))).collect() == []


def test_archive_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, Q.op12_warc(spark, data).collect()), key=repr) == plain_archive(rows)


def test_predicates_are_settled_from_headers(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    folder = warc.archive_pages(pages)
    told = lambda *where: sorted(r["target_uri"] or "" for r in warc.read_archives(spark, folder, where).collect())
    uri = ("target_uri",)
    assert told(D.EqualTo(("record_type",), "response"), D.StringStartsWith(uri, "http://x/1"), D.Not(D.EqualTo(uri, "http://x/12")), D.IsNull(("refers_to",))) == sorted(f"http://x/{i}" for i in (1, *range(10, 20)) if i != 12)
    assert told(D.In(uri, ("http://x/3", "http://x/4", "none")), D.IsNotNull(("date",))) == ["http://x/3", "http://x/4"]
    assert told(D.GreaterThan(uri, "http://x/8")) == ["http://x/9"] and told(D.LessThanOrEqual(uri, "http://x/0"), D.StringContains(uri, "x")) == ["http://x/0"]
    assert told(D.EqualNullSafe(uri, None)) == [""] and told(D.Not(D.EqualTo(uri, "http://x/1"))).count("") == 0  # null is not unequal
    for bad in (D.EqualTo(("payload_length",), 1), D.EqualTo(uri, None), D.Not(D.IsNull(uri))):
        with pytest.raises(ValueError, match="not a predicate"):
            warc.read_archives(spark, folder, [bad])
    one = warc.read_archives(spark, folder, [D.EqualTo(("record_type",), "response")])
    assert (one.where("target_uri = 'http://x/7'").count(), one.count(), one.where("target_uri > 'http://x/8' OR payload_length = 1").count()) == (1, 40, 1)


def test_spark_can_push_predicates_itself(spark):
    folder = warc.archive_pages(spark.createDataFrame([(i, f"u{i}", "text") for i in range(9)], "page_id long, url string, html string"))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = warc.read_archives(spark, folder, planner_filters="true").where("record_type = 'response' AND target_uri IN ('u3', 'u5') AND payload_length = 4")
        kept = re.findall(r"Filter \((.*)\)", some._jdf.queryExecution().executedPlan().toString())
        assert some.count() == 2 and "payload_length" in kept[0] and "target_uri" not in kept[0]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def records_of(path, wanted=lambda f: True, **options):
    from pyarrow import fs

    with fs.LocalFileSystem().open_input_file(str(path)) as f:
        return list(warc.records(f, wanted, **options))


def reads(path, wanted):
    """Bytes that are inflated by a scan."""
    import zlib
    from unittest import mock

    n, real = [0], zlib.decompressobj

    class Counting:
        def __init__(self, *a):
            self.d = real(*a)

        def decompress(self, *a):
            got = self.d.decompress(*a)
            n[0] += len(got)
            return got

        def __getattr__(self, name):
            return getattr(self.d, name)

    with mock.patch.object(warc.zlib, "decompressobj", Counting):
        found = records_of(path, wanted)
    return found, n[0]


def test_unwanted_payloads_are_not_inflated(tmp_path):
    rows = [{"record_type": "response", "record_id": f"<{k}>", "date": "d", "payload": bytes(200_000)} for k in range(20)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(warc.member(warc.record(r), 6) for r in rows))
    found, n = reads(tmp_path / "a.warc.gz", lambda f: f["warc-record-id"] == "<7>")
    assert [len(f[3]) for f in found] == [200_000] and n < 200_000 + 40 * 4096


def test_files_of_other_writers(tmp_path):
    """Plain members without lengths, folded header lines, other content, line ends between records, resource records."""
    a = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: http://a\r\nX: one\r\n  two\r\nContent-Type: text/plain\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    b = b"WARC/1.0\r\nwarc-type: response\r\nContent-Type: application/http\r\nContent-Length: 28\r\n\r\nHTTP/1.1 200 OK\r\nA: b\r\n\r\nhe\n\r\n\r\n"
    (tmp_path / "m.warc.gz").write_bytes(gzip.compress(a) + gzip.compress(b))
    (tmp_path / "p.warc").write_bytes(a + b"\r\n" + b)
    for name in ("m.warc.gz", "p.warc"):
        (_, f, n, p), (_, g, m, q) = records_of(tmp_path / name)
        assert (f["warc-type"], f["x"], n, p) == ("resource", "one two", 5, b"hello") and (g["warc-type"], m, q) == ("response", 3, b"he\n")
        assert [r[2:] for r in records_of(tmp_path / name, payloads=False)] == [(5, None), (None, None)]
    (tmp_path / "cut.warc").write_bytes(a + b[:-12])
    with pytest.raises(ValueError, match="ends inside"):
        records_of(tmp_path / "cut.warc")


def test_faults_are_errors_or_rows(spark, tmp_path):
    good = warc.record({"record_type": "response", "record_id": "<1>", "date": "d", "payload": b"x"})
    (tmp_path / "a.warc").write_bytes(good + b"nothing of the kind\r\n\r\n")
    (tmp_path / "b.warc").write_bytes(good)
    (tmp_path / "notes.txt").write_bytes(b"not an archive")
    got = warc.read_archives(spark, str(tmp_path), mode="permissive").collect()
    assert sorted((r["record_type"] or "", r["error"] is None) for r in got) == [("", False), ("response", True), ("response", True)]
    with pytest.raises(Exception, match="no record begins here"):
        warc.read_archives(spark, str(tmp_path)).collect()


def test_files_of_lost_tasks_are_not_read(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    folder = warc.archive_pages(pages)
    where = folder.removeprefix("file://")
    import pathlib

    pathlib.Path(where, "lost.warc.gz").write_bytes(b"half a file of a task that was repeated")
    assert warc.pages_of(warc.read_archives(spark, folder)).count() == 1


# --- phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_phrases(rows, least, best):
    n, f = Counter(), {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for m in range(1, 6):
                for s in range(len(ws) - m + 1):
                    f.setdefault(lang, Counter())[tuple(ws[s : s + m])] += 1
    out = []
    for lang, c in f.items():
        often = {p: a for p, a in c.items() if a >= least}
        longest = {}
        for p, a in often.items():
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    if j - i < len(p):
                        longest[p[i:j]] = max(longest.get(p[i:j], 0), a)
        rows = []
        for p, a in often.items():
            if len(p) > 1 and longest.get(p, 0) < a:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:best], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def many_texts(seed, n=300, words=12):
    rng = random.Random(seed)
    voc = [f"w{k}" for k in range(words)] + ["The", "the", "é", "x|y", "中"]
    out = []
    for _ in range(n):
        body = []
        while len(body) < rng.randint(0, 60):
            body += rng.choice([["New", "york", "city"], ["a"] * rng.randint(1, 7), [rng.choice(voc)], [rng.choice(voc)], ["in", "the", "end", "of", "it", "all"]])
        out.append((rng.choice(["en", "en", "de", None]), "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ", ", ". ", "\n", "\x0b"]) for w in body)))
    return out + [("en", None), (None, None), ("fr", ""), ("fr", " .,\n"), ("und", "a a a a a a a"), ("en", "long " * 50_000), ("en", "x" * 70_000), *out[:5]]


@pytest.mark.parametrize("least,best,shard", [(3, 2000, 1 << 21), (20, 7, 700), (1000, 50, 1 << 21)])
def test_phrases_are_those_of_plain_counts(spark, monkeypatch, least, best, shard):
    monkeypatch.setattr(phrases, "SHARD_WORDS", shard)
    rows = many_texts(least)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, words string, a int").repartition(5)
    got = phrases.collocations(docs, least, best)
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string", "bigint", "bigint", "bigint", "bigint", "bigint"]
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, least, best)


def test_phrases_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).collect() == []
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, "a b c")], "lang string, text string")).collect() == []


def test_pieces_are_merged_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FAN", 4)
    rows = many_texts(5, 120)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(23)
    assert sorted(map(tuple, phrases.collocations(docs, 4, 100).collect())) == plain_phrases(rows, 4, 100)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=2, max_size=25), min_size=1, max_size=5), st.integers(1, 4))
def test_merged_tries_count_as_one_trie(parts, least):
    def trie(words):
        h = np.array(words, np.uint64)
        length = np.minimum(len(h) - np.arange(len(h)), phrases.DEPTH)
        first = np.flatnonzero(length >= 2)
        return phrases.Trie.of(first, h, length[first]).piece()

    want = Counter(tuple(p[s : s + m]) for p in parts for m in range(2, 6) for s in range(len(p) - m + 1))
    seen = {}
    for w, n, befores, longer in phrases.Trie.merged([phrases.Trie.together([trie(p)]) for p in parts]).frequent(least):
        for row, a, b, more in zip(w.tolist(), n.tolist(), befores.tolist(), longer.tolist(), strict=True):
            seen[tuple(row)] = a
            assert b == [want[tuple(row[:k])] for k in range(2, len(row))]
            assert more == (max((want[(*row, x)] for x in range(4)), default=0) if len(row) < 5 else 0)
    assert seen == {p: a for p, a in want.items() if a >= least}


def test_words_that_no_shard_has_spelt_are_looked_for(spark, monkeypatch):
    monkeypatch.setattr(phrases, "_spelling", lambda spark, words: lambda hashes, shard: np.zeros(len(hashes), bool))
    rows = many_texts(6, 60)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, phrases.collocations(docs, 4, 100).collect())) == plain_phrases(rows, 4, 100)
