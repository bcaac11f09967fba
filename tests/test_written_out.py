"""Rules of the course domain on rows that are written out, beside the SQL that says the same."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.functions import parsers
from lodestone.functions import text as T
from lodestone.operators import assemble, chunk, evaluate, graph, layout, route
from lodestone.plans.catalogue import rows, values

QUERIES, SQL = {}, {}


def query(sql):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


_MARKED = [(1, 0, "检索:电路 基础", "检索:电路 基础\n[教材 P10]\n第一段"), (1, 1, "检索:电路 基础", "第二段"), (1, 2, "检索:电路 基础", "尾[教材 P11]头[教材 P12]"), (1, 3, "检索:电路 基础", "第四段"), (2, 0, "", "没有标记"), (2, 1, "", "也没有"), (3, 0, "检索:x", "开头"), (3, 1, "检索:x", "检索:x 已有"), (3, 2, "检索:x", "[教材 P7"), (3, 3, "检索:x", "续")]
_FAQ_FILE = "导言\nQ: 何时交\nA: 周五\n\n补一行\n\nQ：多行\n第二行\na ： 答一\n答二\nq: 没有答案\n\nA: 迟到的答案\nQ: 末尾\nA:\n"
_FAQ_TOLD = [(1, "何时交", "周五\n\n补一行"), (2, "多行\n第二行", "答一\n答二")]
_SAID = [("我漏交了 20230001 第2次作业", "submission", "admin"), ("忘了交作业", "submission", "admin"), ("漏交了怎么办", "question", "admin"), ("什么是叠加原理", "question", "concept"), ("1.36 怎么做", "question", "problem"), ("第5题", "question", "problem"), ("考试会考叠加定理吗", "question", "admin"), ("作业里的叠加定理怎么理解", "question", "concept"), ("思维导图要画吗", "question", "admin"), ("谢谢", "question", "concept"), ("", "unknown", "concept"), ("实验报告什么时候交", "question", "admin")]
_ENTITIES = [("学号20230001张三", None, "张三", None), ("我是李四,学号 20230002,漏交第3次作业", "20230002", "李四", "第 3 次"), ("姓名：王小明 20230003 实验二", "20230003", "王小明", "第 二 次".replace("二", "2")), ("hw 12 补交 2023000", None, None, "第 12 次"), ("Chapter 7", None, None, "第 7 次"), ("第十一章", None, "第十一章", "第 十一 次"), ("作业五没交,20230004 陈大文", "20230004", "陈大文", "第 5 次")]
_DIGITS = [("第八周交", "第8周交", "", "", "MATCH"), ("提前两周", "提前1周", "2", "1", "LOST"), ("满分90", "满分90,占30%", "", "30", "EXTRA"), ("半天", "0.5", "0.5", "0,5", "LOST")]
_FACT_FILE = "# 注释\n生效:2026-9-1\n失效：2026.12.31\n事实:周五交\n来源:通知\n\n事实:没有日期\n# 中间\n来源:群\n\n生效:2026年13月1日\n事实:坏日期\n\n生效:2026-05-01\n失效:2026-04-01\n事实:倒着\n\n来源:没有事实\n\n认不出\n失效:2026/7/1日\n事实:旧\n事实:新\n"
_FACT_TOLD = [(1, "周五交", "通知", "2026-09-01", "2026-12-31"), (2, "没有日期", "群", None, None), (3, "新", "", None, "2026-07-01")]
_ANSWERS = "作业题 14.0 画出思维导图\n14.4（传递函数）清单\n14.0 题目正文在这里,很长很长\n第二行\n10.5 V\n3.92 别章的题\n14-11图示电路\n14.4 求传递函数 H(s),完整的正文\n"
_SECTIONS = [(14, 0, "14.0", "14.0 题目正文在这里,很长很长\n第二行\n10.5 V\n3.92 别章的题"), (14, 4, "14.4", "14.4 求传递函数 H(s),完整的正文"), (14, 11, "14.11", "14-11图示电路")]
_OHMS = [("10Q", "10Ω", 1), ("6Q电阻和18kQ电阻", "6Ω电阻和18kΩ电阻", 2), ("Q1 10Quotient", "Q1 10Quotient", 0), ("2Q点", "2Q点", 0), ("静态工作点Q", "静态工作点Q", 0), ("5kQ时,3 Q", "5kΩ时,3 Q", 1), ("10Ω", "10Ω", 0)]
_BOXES = [(1, 10.0, 50.0, 10.0, "b"), (1, 12.0, 5.0, 10.0, "a"), (1, 30.0, 5.0, 10.0, "c"), (1, 34.0, 90.0, 4.0, "d"), (2, 1.0, 1.0, 1.0, "x"), (2, 9.0, 0.0, 1.0, "y")]
_EDGES = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "d"), ("a", "y"), ("y", "z")]


@query(f"""
WITH parts AS ({values(_MARKED, "doc, chunk_no, anchor, text")}),
marked AS (SELECT *, NULLIF(regexp_extract(text, '\\[教材 P(\\d+)', 1), '') AS own FROM parts),
paged AS (SELECT *, LAST_VALUE(own IGNORE NULLS) OVER (PARTITION BY doc ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS page FROM marked)
SELECT CAST(doc AS INTEGER) AS doc, CAST(chunk_no AS INTEGER) AS chunk_no, page,
       CASE WHEN chunk_no > 0 AND anchor <> '' AND NOT starts_with(text, anchor) THEN anchor || E'\\n' ELSE '' END
       || CASE WHEN own IS NULL AND page IS NOT NULL THEN '[教材 P' || page || E']\\n' ELSE '' END || text AS text
FROM paged""")
def chunk_context(spark):
    return chunk.with_context(rows(spark, _MARKED, "doc int, chunk_no int, anchor string, text string"), "doc")


@query(values(_FAQ_TOLD, "pos, question, answer"))
def faq_parse(spark):
    return parsers.parse_faq(rows(spark, [(_FAQ_FILE,)], "text string"))


@query(values(_SAID, "text, class, kind"))
def message_rules(spark):
    return rows(spark, [(s[0],) for s in _SAID], "text string").select("text", route.message_class("text").alias("class"), route.question_kind("text").alias("kind"))


@query(values(_ENTITIES, "text, student_id, name, homework"))
def entity_rules(spark):
    return rows(spark, [(e[0],) for e in _ENTITIES], "text string").select("text", T.student_id("text").alias("student_id"), T.person_name("text").alias("name"), T.homework_number("text").alias("homework"))


@query(values(_DIGITS, "expected, said, lost, added, state"))
def digit_fidelity(spark):
    f = rows(spark, [d[:2] for d in _DIGITS], "expected string, said string").withColumn("f", evaluate.fidelity("expected", "said"))
    return f.select("expected", "said", F.array_join("f.lost", ",").alias("lost"), F.array_join("f.added", ",").alias("added"), "f.state")


@query(values(_FACT_TOLD, "pos, fact, source, effective_from, effective_until"))
def facts_parse(spark):
    f = parsers.parse_facts(rows(spark, [(_FACT_FILE,)], "text string"))
    return f.select("pos", "fact", "source", *(F.col(c).cast("string").alias(c) for c in ("effective_from", "effective_until")))


@query(values(_SECTIONS, "chapter, number, label, body"))
def section_longest(spark):
    docs = rows(spark, [("Z第13-14章 答案.pdf", _ANSWERS)], "name string, text string")
    return assemble.sections(docs, ["name"], "text", chapters=assemble.chapters_in_name("name")).drop("name")


@query(values(_OHMS, "raw, fixed, n"))
def ocr_symbol_fix(spark):
    fixed, n = T.repair_ohm("raw")
    return rows(spark, [(o[0],) for o in _OHMS], "raw string").select("raw", fixed.alias("fixed"), n.alias("n"))


@query(values([(1, "a b\nc d"), (2, "x\ny")], "page, text"))
def reading_order(spark):
    return layout.reading_order(rows(spark, _BOXES, "page int, y double, x double, h double, text string"), "page")


@query(f"""
WITH RECURSIVE e AS ({values(_EDGES, "src, dst")}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
walk AS (SELECT node, 0 AS layer FROM n UNION SELECT dst, layer + 1 FROM walk JOIN e ON src = node)
SELECT node, CAST(MAX(layer) AS INTEGER) AS layer FROM walk GROUP BY node""")
def dag_layers(spark):
    return graph.layers(rows(spark, _EDGES, "src string, dst string"))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_written_out_rows(spark, name):
    got, want = QUERIES[name](spark).toArrow(), duckdb.sql(SQL[name]).to_arrow_table()
    same = lambda t: sorted(repr([r[k] for k in sorted(r)]) for r in t.to_pylist())
    assert sorted(got.column_names) == sorted(want.column_names) and same(got) == same(want)


def test_the_last_mark_of_a_chunk_can_be_carried_on(spark):
    told = chunk.with_context(rows(spark, _MARKED, "doc int, chunk_no int, anchor string, text string"), "doc", carry="last")
    assert {(r["doc"], r["chunk_no"]): r["text"].split("\n")[1] for r in told.collect() if r["doc"] == 1 and r["chunk_no"] == 3} == {(1, 3): "[教材 P12]"}
