"""The command's one line, statistics of Markdown, and small parts."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone import runtime
from lodestone.__main__ import main
from lodestone.functions import diagrams
from lodestone.operators import evaluate, record


def test_the_command_tells_one_line(spark, tmp_path, capsys):
    folder, corpus = f"file://{tmp_path}/faq", f"file://{tmp_path}/corpus"
    record.create(spark.createDataFrame([(1, "作业什么时候交", "周五晚上")], "pos int, question string, answer string"), folder)
    spark.createDataFrame([(1, "叠加定理 是线性电路的性质", "教材")], "id long, text string, source string").write.parquet(corpus)

    def told(message, *more):
        status = main(["--message", message, *more], spark)
        lines = capsys.readouterr().out.splitlines()
        assert len(lines) == 1
        return status, json.loads(lines[0])

    assert told("闲聊") == (0, {"type": "skip"})
    assert told("【记录】问:教室在哪\n答:三楼", "--faq", folder) == (0, {"type": "record", "pos": 2})
    assert told("【记录】问:教室在哪?\n答:四楼", "--faq", folder) == (0, {"type": "refused", "reason": "duplicate"})
    assert told("【记录】没有标签", "--faq", folder)[1]["type"] == "refused"
    status, answer = told("【转发学生提问】作业什么时候交", "--faq", folder)
    assert status == 0 and answer["type"] == "answer"
    status, answer = told("【转发学生提问】什么是叠加定理", "--faq", folder, "--corpus", corpus)
    assert "叠加定理" in answer["reply"] and "教材" in answer["reply"]
    status, answer = told("【转发学生提问】在吗", "--faq", f"file://{tmp_path}/none")
    assert status == 1 and answer["type"] == "error"


def test_statistics_of_markdown(spark):
    text = "intro\n# The title \n## one\n| a | b |\n|-|-|\nsay `## two`\n```mermaid\ngraph TD\n```\n:::stats\n:::\n:::note\n:::\n## three\n# second"
    got = diagrams.markdown_statistics(spark.createDataFrame([(1, text), (2, None)], "id int, text string"), "id", "text").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "The title", 2, 2, 2, len(text)), (2, None, 0, 0, 0, 0)]


def test_cases_by_a_part_of_their_name(spark):
    cases = spark.createDataFrame([("facts a",), ("b",)], "case string")
    assert evaluate.chosen(cases, "facts").count() == 1 and evaluate.chosen(cases, "").count() == 2


def test_a_local_warehouse_is_not_shared_by_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere"

    class Session:
        sparkContext = Context()

        class conf:
            told = {"spark.sql.warehouse.dir": "file:/tmp/warehouse"}

            @classmethod
            def get(cls, key, default=None):
                return cls.told.get(key, default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session())
    Session.sparkContext.master = "local[3]"
    assert runtime.shared_dir(Session()) == "file:/tmp/warehouse/_kept"
    Session.conf.told = {"spark.checkpoint.dir": "hdfs://x/y/"}
    assert runtime.shared_dir(Session()) == "hdfs://x/y"
    assert spark.range(1).select(F.lit(1)).count() == 1
