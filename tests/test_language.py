"""The word lattice, learned dictionaries, and registers of names."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import lattice, names
from lodestone.functions import text as T


def segmentations(text):
    if not text:
        yield []
    for k in range(1, len(text) + 1):
        for rest in segmentations(text[k:]):
            yield [text[:k], *rest]


def price(path, cost, unknown):
    return sum(cost.get(w, unknown if len(w) == 1 else math.inf) for w in path)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("甲乙丙", min_size=1, max_size=4), st.integers(0, 40), max_size=12), st.integers(10, 50), st.text("甲乙丙丁", max_size=9))
def test_the_path_is_the_best_of_all_segmentations(cost, unknown, text):
    made = lattice.Lattice(cost, unknown)
    got = made.cut(text)
    paths = [p for p in segmentations(text) if price(p, cost, unknown) < math.inf]
    least = min(price(p, cost, unknown) for p in paths)
    # of equal ones, the longest first word, then the longest second
    assert got == max((p for p in paths if price(p, cost, unknown) == least), key=lambda p: [len(w) for w in p])


def test_lattice_tokenizer(spark):
    words = spark.createDataFrame([("电路", 90), ("分析", 80), ("电路分析", 60), ("基础", 40), ("分", 5), ("", 7), (None, 3), ("空", 0)], "word string, n long")
    cut = lattice.tokenizer(words)
    rows = [("电路分析基础AC 1题",), (None,), ("",), ("路析!Ω abc",), ("々〇電路",)]
    got = [r["x"] for r in spark.createDataFrame(rows, "t string").select(cut("t").alias("x")).collect()]
    assert got == [["电路分析", "基础", "ac", "1", "题"], [], [], ["路", "析", "ω", "abc"], ["々", "〇", "電", "路"]]
    costs = {r["word"]: r["cost"] for r in lattice.costs(words).collect()}
    assert costs["电路"] == round(1e6 * math.log(275 / 90)) and set(costs) == {"电路", "分析", "电路分析", "基础", "分"}
    assert [r["x"] for r in spark.createDataFrame([("电路",)], "t string").select(lattice.tokenizer(words.limit(0))("t").alias("x")).collect()] == [["电", "路"]]


def test_large_dictionaries_are_refused(spark, monkeypatch):
    monkeypatch.setattr(lattice, "MOST_WORDS", 3)
    with pytest.raises(ValueError, match="more than 3"):
        lattice.tokenizer(spark.createDataFrame([(f"w{k}", 1) for k in range(4)], "word string, n long"))


def test_a_dictionary_is_learned_from_texts(spark):
    rng = random.Random(1)
    signs = [chr(0x4E00 + k) for k in range(400)]
    words = ["".join(rng.sample(signs, rng.choice([2, 2, 3, 4]))) for _ in range(60)]
    texts = ["".join(rng.choice(words) for _ in range(12)) + "。" + "".join(rng.choice(words) for _ in range(5)) for _ in range(300)] + [None, "", "no han"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = {r["word"]: r["n"] for r in lattice.learn(df).collect()}
    longer = {w for w in found if len(w) > 1}
    assert len(longer & set(words)) > 0.9 * len(set(words)) and len(longer - set(words)) < 0.2 * len(longer)
    assert all(found[w] == sum((t or "").count(w) for t in texts) for w in list(longer)[:10])
    cut = lattice.tokenizer(lattice.learn(df))
    truth = [rng.choice(words) for _ in range(200)]
    got = spark.createDataFrame([("".join(truth),)], "t string").select(cut("t").alias("x")).collect()[0]["x"]
    assert len(set(got) & set(truth)) > 0.85 * len(set(truth))


# Names


def held(texts, listed):
    return sorted((i, no, n) for i, t in texts for no, n in listed if t and n in t)


@pytest.mark.parametrize("most", [names.MOST_SENT, 0])
def test_names_are_found_both_ways(spark, most):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abc李四") for _ in range(n))
    listed = sorted({word(rng.randint(1, 7)) for _ in range(60)} | {"x" * 70, "x" * 64 + "y"})
    listed = list(enumerate(listed))
    texts = [(k, word(rng.randint(0, 60))) for k in range(80)] + [(100, None), (101, ""), (102, "ab" + "x" * 75), (103, "x" * 64 + "yz"), (104, "x" * 64 + "z")]
    table = names.register(spark.createDataFrame([*listed, (500, listed[0][1]), (7, ""), (8, None)], "no int, name string"))
    got = names.find(spark.createDataFrame(texts, "id int, text string"), "id", "text", table, most)
    assert sorted(tuple(r) for r in got.collect()) == held(texts, listed)
    assert names.find(spark.createDataFrame(texts, "id int, text string"), "id", "text", table.limit(0), most).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=4), max_size=6, unique=True), st.text("abc", max_size=25))
def test_masks_are_those_of_one_name_after_the_other(listed, text):
    want = text
    for n in listed:
        want = want.replace(n, "[*]")
    assert names.Automaton(list(enumerate(listed))).masked(text, "[*]") == want


def test_redaction_by_a_register(spark):
    listed = ["Anna", "Ann", "nna", "李雷"]
    table = spark.createDataFrame(list(enumerate(listed)), "no int, name string")
    df = spark.createDataFrame([("Anna, Ann and Nnna 20230001",), ("李雷李雷",), (None,), ("",)], "t string")
    got = [tuple(r) for r in df.select(names.redactor(table)("t"), T.redact("t", listed)).collect()]
    assert all(a == b for a, b in got)
    with pytest.raises(ValueError, match="mask"):
        names.redactor(spark.createDataFrame([(1, "学生甲")], "no int, name string"))
    with pytest.raises(ValueError, match="more than 2"):
        names.redactor(table, most_sent=2)


def test_no_loop_over_names(spark):
    table = names.register(spark.range(50_000).select(F.col("id").alias("no"), F.format_string("name%07d", "id").alias("name")))
    texts = spark.range(200).select("id", F.concat_ws(" ", F.lit("x"), F.format_string("name%07d", F.col("id") * 211)).alias("text"))
    found = names.find(texts, "id", "text", table)
    assert found.count() == 200 and len(found._jdf.queryExecution().optimizedPlan().toString()) < 20_000
