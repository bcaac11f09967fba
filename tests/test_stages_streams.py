"""Numbering, faulty rows, jobs that are stopped, diagrams, and state of streams."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.functions import diagrams
from lodestone.functions.tokenize import content, external, words
from lodestone.operators import bm25, graph, guard, route
from lodestone.plans import qa
from lodestone.runtime import numbered
from lodestone.sources import sinks
from lodestone.streaming import messages


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_dense_numbers(spark, parts):
    rng = random.Random(parts)
    rows = [(f"p{rng.randrange(40)}", k) for k in range(100)]
    df = spark.createDataFrame(rows, "path string, k int").repartition(4)
    got = numbered(df, ["path", F.desc("k")], "no", parts)
    assert [(r["path"], r["k"]) for r in got.orderBy("no").collect()] == sorted(rows, key=lambda r: (r[0], -r[1]))
    assert sorted(r["no"] for r in got.collect()) == list(range(100))
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert numbered(df.limit(0), ["path"]).collect() == []


# Faulty rows


def cutter():
    def poisoned(text):
        if "poison" in text:
            raise ValueError("this text cannot be cut")
        return text.split()

    return poisoned


@pytest.fixture()
def asked(spark, data):
    turns = spark.read.parquet(f"{data}/conversations.parquet").where("role = 'user'")
    rows = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text").limit(40)
    return rows.union(spark.createDataFrame([(-1, "what is the poison"), (-2, "where is the room")], "id long, text string")).repartition(3)


def test_one_poisoned_message_costs_itself_alone(spark, asked):
    cut = external(cutter())
    n = asked.count()
    stages = {
        "routing": lambda df: df.select("id", F.array_join(cut("text"), " ").alias("t")).select("id", route.route("t").alias("r")).select("id", "r.route"),
        "extraction": lambda df: df.select("id", F.size(content(cut("text"))).alias("n")),
    }
    entries = [(1, "where is the room", "up", ["room"]), (2, "what is due", "all", ["due"])]
    faq = spark.createDataFrame(entries, "pos long, question string, answer string, content array<string>")
    known = qa.Knowledge(faq, bm25.build(faq, "pos", words("question")), None, None)
    stages["planning"] = lambda df: qa.plan(df, known, cut("text"), content(cut("text")))
    for name, stage in stages.items():
        good, bad = guard.guarded(asked, stage, "id")
        assert good.count() == n - 1 and good.where("id = -1").isEmpty(), name
        assert [(r["id"], "cannot be cut" in r["error"]) for r in bad.collect()] == [(-1, True)], name


def test_a_stage_at_fault_is_an_error(spark):
    rows = spark.range(8).withColumn("text", F.lit("poison"))
    with pytest.raises(Exception):
        guard.guarded(rows, lambda df: df.select("id", external(cutter())("text")), "id", most_errors=3)
    good, bad = guard.guarded(rows.limit(0), lambda df: df.select("id"), "id")
    assert good.collect() == bad.collect() == []


def test_batches_with_faulty_rows(spark):
    df = spark.createDataFrame([(k, None if k == 4 else "poison" if k in (3, 17) else f"a b{k}") for k in range(30)], "id long, text string").coalesce(2)
    words_of = cutter()
    cut = lambda f: pd.DataFrame({"n": [len(words_of(t)) for t in f["text"]]})
    got = {r["id"]: (r["n"], r["error"]) for r in guard.guarded_batches(df, cut, "n int", "id").collect()}
    assert len(got) == 30 and {k for k, (_, e) in got.items() if e} == {3, 4, 17}
    assert got[3] == (None, "ValueError: this text cannot be cut") and got[5] == (2, None)


# Jobs


def test_a_stop_in_the_middle_keeps_committed_batches(spark, tmp_path):
    folder = f"file://{tmp_path}/cache"
    jobs = spark.createDataFrame([(f"k{k:03d}", k) for k in range(100)], "key string, n int").coalesce(1)
    log = tmp_path / "done"

    def dies(row):
        import os

        with open(log, "a") as f:
            f.write("x")
        if os.path.getsize(log) > 37:
            os._exit(1)
        return f"text {row['n']}"

    with pytest.raises(Exception):
        sinks.resumable(jobs, folder, dies, 10)
    assert spark.read.parquet(folder).count() == 30
    log.write_text("")

    def works(row):
        with open(log, "a") as f:
            f.write("x")
        if row["n"] == 99:
            raise RuntimeError("not today")
        return f"text {row['n']}"

    got = sinks.resumable(jobs, folder, works, 10).orderBy("key").collect()
    assert len(log.read_text()) == 70 and [r["text"] for r in got] == [f"text {k}" for k in range(99)] + [""] and got[99]["error"] == "RuntimeError: not today"
    log.write_text("")
    again = sinks.resumable(jobs, folder, lambda row: works(row | {"n": 0}), 10).orderBy("key").collect()
    assert len(log.read_text()) == 1 and again[99]["text"] == "text 0" and again[0]["text"] == "text 0" and again[1]["text"] == "text 1"


# Diagrams

DOC = """# title
```python
:::stats
```
```mermaid
%% caption: the way
graph TB
```
text
:::note two words
inside
```
:::
:::tip
:::
"""


def test_marked_blocks(spark):
    texts = [(1, DOC), (2, "a\n:::Bad\n"), (3, ":::note\n:::tip\n:::"), (4, "x\n:::note\nopen"), (5, None), (6, "```mermaid\nA-->B```\nrest")]
    got = diagrams.marked_blocks(spark.createDataFrame(texts, "id int, text string"), "id", "text").orderBy("id", "no").collect()
    assert [(r["id"], r["kind"], r["args"], r["line"], r["body"]) for r in got if r["error"] is None] == [
        (1, "mermaid", "the way", 5, "%% caption: the way\ngraph TB"), (1, "note", "two words", 10, "inside\n```"), (1, "tip", "", 14, ""), (6, "mermaid", "", 1, "A-->B"),
    ]
    assert {r["id"]: r["error"] for r in got if r["error"]} == {2: "line 2: not a mark of a block: :::Bad", 3: "line 2: a block inside a block", 4: "line 2: note has no end"}


CHART = """flowchart LR
%% a comment
A["run --dry-run <br/> <b>now</b>"] -->|"yes &amp; no"| B{ok?} -.-> C((c))
a-b---A
subgraph S1["the [group]"]
  B
  D[[sub]] <--> E(round)
end
subgraph loose words
E
end
B[changed]
"""


def test_flowcharts(spark):
    bad = {
        "": "no `flowchart", "graph RL\nA-->B": "no `flowchart", "graph TD\nA[(db)]": "no such shape", "graph TD\nA -->": "out of place", "graph TD\nend": "an end without", "graph TD\nsubgraph a\nsubgraph b": "inside a group",
        "graph TD\n$ --> B": "cannot be read", "graph TD\nA --> g\nsubgraph g [x]\nB\nend": "a link to a group", "graph TD\nA B": "out of place", "graph TD\nA([x])": "no such shape",
    }
    texts = spark.createDataFrame([(0, CHART), (1, "graph TD"), *enumerate(bad, 2)], "id int, text string")
    got = {r["id"]: r for r in diagrams.flowcharts(texts, "id", "text").collect()}
    chart = got[0]
    assert chart["direction"] == "LR" and [(n["node"], n["label"], n["shape"]) for n in chart["nodes"]] == [("A", "run --dry-run \n now", "rect"), ("B", "changed", "rect"), ("C", "c", "circle"), ("a-b", "a-b", "rect"), ("D", "sub", "subroutine"), ("E", "round", "stadium")]
    assert [(e["src"], e["dst"], e["label"], e["dashed"], e["both"]) for e in chart["edges"]] == [("A", "B", "yes & no", False, False), ("B", "C", None, True, False), ("a-b", "A", None, False, False), ("D", "E", None, False, True)]
    assert [(g["grp"], g["label"], g["members"]) for g in chart["groups"]] == [("S1", "the [group]", ["B", "D", "E"]), ("group1", "loose words", ["E"])]
    assert got[1]["nodes"] == [] and got[1]["error"] is None
    for k, what in enumerate(bad.values(), 2):
        assert what in got[k]["error"] and got[k]["nodes"] is None
    edges = diagrams.flowcharts(texts, "id", "text").select("id", F.inline("edges"))
    assert {(r["node"], r["layer"]) for r in graph.diagram_layers(edges, "id", "no").where("id = 0").collect()} == {("a-b", 0), ("A", 1), ("B", 2), ("C", 3), ("D", 0), ("E", 1)}


# Streams


def at(hour, minute=0):
    return datetime.datetime(2026, 5, 1) + datetime.timedelta(hours=hour, minutes=minute)


def test_repeats_with_state(spark, tmp_path):
    folder, sink = f"{tmp_path}/in", f"file://{tmp_path}/out"
    put = lambda rows: spark.createDataFrame(rows, "who string, ts timestamp, n int").coalesce(1).write.mode("append").parquet(f"file://{folder}")
    stream = lambda: messages.repeated_within(spark.readStream.schema("who string, ts timestamp, n int").parquet(f"file://{folder}"), ["who"], late="1 hour")
    told = lambda: {r["n"]: r["repeated"] for r in spark.read.parquet(sink).collect()}

    def go():
        q = messages.written(stream(), sink, f"file://{tmp_path}/state", availableNow=True)
        q.awaitTermination()
        return [s for p in q.recentProgress for s in p["stateOperators"]]

    put([("x", at(0), 1), ("x", at(23), 2), ("y", at(1), 3)])
    go()
    assert told() == {1: False, 2: True, 3: False}
    put([("x", at(46, 59), 4), ("y", at(26), 5), ("z", at(60), 6)])
    go()
    assert told() == {1: False, 2: True, 3: False, 4: True, 5: False, 6: False}
    put([("x", at(20), 7), ("x", at(61), 8), ("z", at(83), 9)])  # the first comes too late
    states = go()
    assert told() == {1: False, 2: True, 3: False, 4: True, 5: False, 6: False, 8: True, 9: True}
    assert sum(s["numRowsDroppedByWatermark"] for s in states) == 1
    put([("w", at(200), 10)])
    go()
    put([("w", at(201), 11)])
    assert go()[-1]["numRowsTotal"] == 1  # timers have dropped the others


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    sink = f"file://{tmp_path}/out"
    spark.createDataFrame([("a",), ("b",)], "text string").write.parquet(f"file://{tmp_path}/in")
    stream = lambda: spark.readStream.schema("text string").parquet(f"file://{tmp_path}/in")
    for state in ("state1", "state2"):  # without its checkpoint the query runs batch 0 again
        messages.answered(stream(), lambda b: b.withColumn("answer", F.upper("text")), sink, f"file://{tmp_path}/{state}", availableNow=True).awaitTermination()
        assert sorted(r["answer"] for r in spark.read.parquet(sink).collect()) == ["A", "B"]
