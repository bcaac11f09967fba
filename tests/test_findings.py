"""What reviews of larger tables found, on small ones."""

from __future__ import annotations

import datetime
import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.functions import diagrams, names
from lodestone.functions.tokenize import words
from lodestone.operators import assemble, bm25, mine, products, record
from lodestone.plans import catalogue, large_inputs, whole_tables
from lodestone.streaming import messages


def against_sql(spark, folder, tables: dict, name: str) -> None:
    """The query over these tables gives the rows of its SQL."""
    con = duckdb.connect()
    for t, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got = catalogue.QUERIES[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalogue.SQL[name]})").fetchall()
    assert want
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_a_heading_lies_inside_one_line(spark):
    docs = spark.createDataFrame([(1, "vor\nThe\nThe a\n\n Der b\nDer")], "id int, text string")
    got = [(r["part"], r["label"], r["body"]) for r in assemble.answer_sections(docs, "text", r"^\s*(The|Der)\s", (("第", "题"),)).orderBy("part").collect()]
    assert got == [(1, "前言", "vor\nThe"), (2, "第The题", "The a"), (3, "第Der题", "Der b\nDer")]


@pytest.mark.parametrize("name", ["answer_sections", "section_titles"])
def test_sections_of_odd_texts(spark, tmp_path, name):
    texts = ["The\nvor\nThe a", "La \n\nLe b\n The\n", "10.20.30.40 Est.\n3.1 Eigener Titel", "", " \n\t", "ohne", None]
    rows = [(k, t, "en", f"src{k % 2}", 1) for k, t in enumerate(texts)]
    against_sql(spark, tmp_path, {"documents": spark.createDataFrame(rows, DOCS)}, name)


@pytest.mark.parametrize("values,dense", [(1 << 22, 0.01), (60, 2.0), (60, 0.0)])
def test_pairs_in_tiles_are_those_of_plain_sets(spark, monkeypatch, values, dense):
    for name, value in (("TILE_VALUES", values), ("DENSE_SHARE", dense), ("BLOCK_CELLS", 50)):
        monkeypatch.setattr(products, name, value)
    rng = random.Random(5)
    rows = [(k, sorted({rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 6))})) for k in range(90)]
    table = spark.createDataFrame(rows, "id long, s array<string>")
    plain = {(i, j): len({*a} & {*b}) / len({*a} | {*b}) for i, a in rows for j, b in rows if i < j and a and b and len({*a} & {*b}) / len({*a} | {*b}) >= 0.4}
    assert {(r["a"], r["b"]): r["similarity"] for r in mine.similar_pairs(table, "id", "s", 0.4).collect()} == plain


def test_only_similar_pairs_leave_a_task(spark):
    """All sets share a token, and no pair but one is similar."""
    rows = [(k, ["every", *(f"t{k}-{i}" for i in range(9))]) for k in range(300)] + [(300, ["every", *(f"t7-{i}" for i in range(8))])]
    found = products.similar(spark.createDataFrame(rows, "number long, set array<string>"), 0.5).collect()
    assert [({r["x"], r["y"]}, r["similarity"]) for r in found] == [({7, 300}, 0.9)]


@pytest.mark.parametrize("kind", ["lucene", "floored"])
def test_queries_in_tiles_find_what_blocks_find(spark, monkeypatch, kind):
    """Many copies tie, so ids decide; tiles are small, and some have nothing in them."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 8))) for _ in range(60)]
    docs = spark.createDataFrame([(k, texts[k % 60]) for k in range(240)], "id long, text string")
    asked = spark.createDataFrame([(q, texts[q]) for q in range(40)], "q long, text string")
    index = bm25.build(docs, "id", words("text"))
    search = lambda: sorted((r["q"], r["rank"], r["id"], round(r["score"], 9)) for r in bm25.search(index, asked, "q", words("text"), 5, kind).collect())
    plain = search()
    assert plain
    monkeypatch.setattr(bm25, "SENT_TERMS", 0)
    monkeypatch.setattr(bm25, "scores", None)  # no row for each query and entry
    for values, dense in ((50, 0.0), (50, 2.0), (1 << 22, 0.01)):
        monkeypatch.setattr(products, "TILE_VALUES", values)
        monkeypatch.setattr(products, "DENSE_SHARE", dense)
        assert search() == plain


def test_row_groups_of_an_index_are_small(spark, tmp_path):
    """A reader may take a row group at once, so its bytes bound the memory of a task."""
    text = F.expr("array_join(transform(sequence(1, 4000), x -> concat(id, 'x', x)), ' ')")
    bm25.build(spark.range(600).coalesce(1).select("id", text.alias("text")), "id", words("text")).write(str(tmp_path / "index"))
    for table in ("entries", "blocks"):
        found = [pq.read_metadata(f) for f in (tmp_path / "index").glob(f"*/{table}/*.parquet")]
        groups = [m.row_group(i).total_byte_size for m in found for i in range(m.num_row_groups)]
        assert sum(groups) > 20_000_000 and max(groups) < 12_000_000


def test_a_large_register_makes_no_row_for_each_place(spark):
    """Names with the same first signs, as often in the texts as signs allow; only what is a name leaves a task."""
    listed = [(k, f"name{k:05d}{'𝄞' * (k % 3)}") for k in range(3000)]
    texts = [(None, "name00001 name00007𝄞"), (2, "name" * 5000), (3, "name0000" * 500 + "name00002𝄞"), (4, "name00003" * 300), (5, ""), (6, None), (7, "na"), (7, "me00001name00001")]
    table = names.register(spark.createDataFrame(listed, "no int, name string"))
    found = names.find(spark.createDataFrame(texts, "id int, text string"), "id", "text", table, most_sent=0)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = [(i, no, n) for i, t in texts for no, n in listed if t and n in t]
    assert want and sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    marks, at_random = names._marks(table, 17), ["".join(random.Random(k).choices("name0123", k=2000)) for k in range(20)]
    assert len(names._marked(at_random, [9, 10, 11], marks, 17)[1]) < 120_000 * 0.01


def test_texts_of_diagrams_are_read_once(spark, data):
    """A filter on what was read, or a union of good and faulty rows, does not read the texts again."""
    for name, reads in (("flowcharts_of_orders", 2), ("blocks_of_orders", 1)):
        plan = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") + plan.count("EvalPython") == reads


def test_lines_that_are_remembered_stay_as_they_are(spark):
    """A node may be told of again, inside a group or out of it, without a change to other charts with the same lines."""
    lines = ["A[one] --> B", "B[two] --> A", "subgraph S", "A[one] --> B", "end", "A[three]"]
    texts = [(k, "graph TD\n" + "\n".join(lines[:k])) for k in range(len(lines) + 1)] + [(9, "graph TD\nA[one] --> B -->"), (10, "graph TD\n\nA[one] --> B -->"), (11, None)]
    rows = {r["id"]: r for r in diagrams.flowcharts(spark.createDataFrame(texts * 2, "id int, text string").coalesce(1), "id", "text").collect()}
    assert [[(n["label"], n["place"]) for n in rows[k]["nodes"]] for k in (1, 2, 5, 6)] == [[("one", 0), ("B", 1)], [("one", 0), ("two", 1)], [("one", 0), ("two", 1)], [("three", 0), ("two", 1)]]
    assert [(e["no"], e["src"]) for e in rows[6]["edges"]] == [(0, "A"), (1, "B"), (2, "A")] and rows[6]["groups"][0]["members"] == ["A", "B"]
    assert [rows[k]["error"] for k in (9, 10, 11)] == ["line 2: out of place: the end of the line", "line 3: out of place: the end of the line", "line 1: the first line is no `flowchart TD` or `flowchart LR`"]


def test_repeats_of_many_keys_share_few_states(spark, tmp_path):
    """Keys of two columns with nulls, whole numbers that no float holds, rows without a time and out of order; held against a plain walk, micro-batch by micro-batch."""
    rng, start, big = random.Random(8), datetime.datetime(2026, 5, 1), (1 << 60) + 1
    schema = "who string, no long, ts timestamp, n long, m long"
    stream = lambda: messages.repeated_within(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), ["who", "no"], seconds=3600, late="2 hours", buckets=4)
    want, last = {}, {}
    for day in range(3):
        rows = [(rng.choice([None, "", "-", "1:a", "a"]), rng.choice([None, 1, big, big + 1]), start + datetime.timedelta(days=day, seconds=rng.randint(0, 7000), microseconds=k), big + 1000 * day + k, rng.choice([None, big])) for k in range(150)]
        rows.append(("a", 1, None, big + 1000 * day + 500, None))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        q = messages.written(stream(), f"file://{tmp_path}/out", f"file://{tmp_path}/state", availableNow=True)
        q.awaitTermination()
        assert max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]) <= 4
        for who, no, ts, n, m in sorted(rows, key=lambda r: r[2] or start):
            second = ts and (ts - start) // datetime.timedelta(seconds=1)
            want[n] = (who, no, ts, m, ts is not None and (who, no) in last and 0 <= second - last[who, no] <= 3600)
            if ts is not None:
                last[who, no] = max(second, last.get((who, no), second))
    got = {r["n"]: (r["who"], r["no"], r["ts"], r["m"], r["repeated"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert {n: v for n, v in got.items() if v[2]} == {n: v for n, v in want.items() if v[2]} and any(v[4] for v in got.values())
    assert not any(v[4] for v in got.values() if v[2] is None)


def test_self_hits_in_tiles_are_those_of_blocks(spark, monkeypatch):
    """Also: tiles are not doubled where a few more do, as each is a copy of the other table."""
    n, m = products.tiles(42_000, 3.4e6, 67_000, 5.4e6, 12, lambda k: k + 1)
    assert 36 <= n * m < 45
    rng = random.Random(9)
    faq = spark.createDataFrame([(k, " ".join(rng.choice("abcdefghijklmnop") for _ in range(9)), "x") for k in range(150)], "pos long, question string, answer string")
    index = bm25.build(faq, "pos", words("question"))
    hits = lambda: sorted((r["pos"], round(r["score"], 9)) for r in record.self_hits(faq, index, F.lit("admin"), words("text"), 2.0).collect())
    plain = hits()
    monkeypatch.setattr(bm25, "SENT_TERMS", 0)
    monkeypatch.setattr(products, "LEAST_ROWS", 20)
    assert plain and hits() == plain



@pytest.mark.parametrize("rest,dense,columns,cells,marked", [(0.35, 0.01, 8192, 1 << 18, 1 << 26), (0.01, 0.0, 7, 20, 1), (1.0, 2.0, 1, 300, 200), (0.5, 0.1, 50, 1 << 18, 1 << 26)])
def test_candidates_by_rare_keys_are_all_similar_pairs(monkeypatch, rest, dense, columns, cells, marked):
    """Sets of 1 to 80 keys, a few of them in nearly all; two tiles, and one with itself, against plain sets."""
    for name, value in (("REST", rest), ("DENSE_SHARE", dense), ("NEAR_COLUMNS", columns), ("NEAR_CELLS", cells), ("MARKED", marked), ("COUNTED", 50)):
        monkeypatch.setattr(products, name, value)
    for seed, threshold in enumerate((0.05, 0.15, 0.5, 0.8, 1.0)):
        rng = random.Random(seed)
        one, two = ([{*rng.choices(range(60), [1 / (k + 1) for k in range(60)], k=rng.choice([1, 2, 9, 30, 80]))} for _ in range(n)] for n in (40, 30))
        a, b = (products.Rows(pa.chunked_array([pa.array([[*s] for s in sets], pa.list_(pa.int64()))])) for sets in (one, two))
        for left, right, rows, same in ((one, two, b, False), (one, one, a, True)):
            got = [(int(i), int(j), s) for r, c, w in products.alike(a, rows, threshold, same) for i, j, s in zip(r, c, w, strict=True)]
            want = {(i, j): len(x & y) / len(x | y) for i, x in enumerate(left) for j, y in enumerate(right) if not (same and i == j) and len(x & y) / len(x | y) >= threshold}
            if same:
                assert 2 * len(got) == len(want)
                got += [(j, i, s) for i, j, s in got]
            assert len(got) == len(want) and {(i, j): s for i, j, s in got} == want


def test_frequent_keys_make_no_work_for_pairs(spark, monkeypatch):
    """Each set has a third of a few common keys, too few to be similar: their places are not gone through pair by pair."""
    met, ranges = [], products._ranges
    monkeypatch.setattr(products, "_ranges", lambda a, b: met.append(int((b - a).sum())) or ranges(a, b))
    monkeypatch.setattr(products, "DENSE_SHARE", 2.0)
    monkeypatch.setattr(products, "met", lambda left, right, count, run, schema: (left, right, count, run))
    rng = random.Random(3)
    sets = [(k, [*map(str, rng.sample(range(12), 4)), *(f"{k}-{i}" for i in range(16))]) for k in range(1000)]
    left, right, count, run = products.similar(spark.createDataFrame(sets, "number long, set array<string>"), 0.5)
    left, right = left.toArrow(), right.toArrow()
    of = lambda t, n: t.filter(pc.equal(t.column("tile"), n))
    assert not sum(run(n, of(left, n), of(right, n)).num_rows for n in range(count * count)) and sum(met) < 1000 * 1000 / 50


def test_tiles_hold_sets_of_like_sizes(spark):
    rows = [(k, [str(i) for i in range(1 + k % 40 if k % 50 else 1500 + k)]) for k in range(2000)]
    table = spark.createDataFrame(rows, "number long, set array<string>")
    sizes = {r["s"]: r["n"] for r in table.groupBy(products._step("set").alias("s")).count().withColumnRenamed("count", "n").collect()}
    told = products.by_size(table, sizes, 8).groupBy("own").agg(F.count("*").alias("n"), F.min(F.size("set")).alias("low"), F.max(F.size("set")).alias("high")).orderBy("own").collect()
    assert sum(r["n"] for r in told) == 2000 and len(told) == 8
    assert all(a["high"] <= b["low"] * 1.02 for a, b in zip(told, told[1:], strict=False)) and max(r["n"] for r in told) < 900



def test_few_rows_leave_the_tiles_of_a_search(spark, monkeypatch):
    """Queries that ask the same are asked once, and most tiles return only what the first ones do not beat; the hits are those of blocks."""
    rng, met, out = random.Random(4), products.met, []
    monkeypatch.setattr(products, "met", lambda *a: out.append(met(*a)) or out[-1])
    docs = spark.createDataFrame([(k, " ".join(rng.choices("abcdefghijklmnop", k=8))) for k in range(600)], "id long, text string")
    asked = spark.createDataFrame([(f"{q}", " ".join("abcdefghijklmnop"[q % 30 % 11 :][:5]) + " x" * (q % 3)) for q in range(120)], "asked string, text string")
    index = bm25.build(docs, "id", words("text"))
    search = lambda: sorted((r["asked"], r["rank"], r["id"], round(r["score"], 9)) for r in bm25.search(index, asked, "asked", words("text"), 3, "lucene").collect())
    plain = search()
    monkeypatch.setattr(bm25, "SENT_TERMS", 0)
    monkeypatch.setattr(products, "TILE_VALUES", 225)
    assert plain and search() == plain
    assert 0 < sum(t.count() for t in out) < 120 * 3 * 16 / 4


def test_greatest_of_a_row_are_found_by_groups():
    rng = np.random.default_rng(3)
    for rows, columns, k in ((5, 4, 7), (3, 1000, 1), (4, 1037, 7), (2, 300, 200), (3, 7, 7)):
        worth = np.round(rng.random((rows, columns)) - 0.3, 2)
        floor = np.array([0.0, 0.69, 2.0, 0.1, 0.0][:rows])
        got = {*zip(*(x.tolist() for x in products.greatest(worth, k, floor)), strict=True)}
        for r in range(rows):
            best = sorted(((-s, c) for c, s in enumerate(worth[r].tolist()) if s > 0 and s >= floor[r]))[:k]
            assert {(r, c) for _, c in best} <= got and all(worth[r, c] > 0 and worth[r, c] >= floor[r] - 1e-7 for i, c in got if i == r)


assert large_inputs and whole_tables
