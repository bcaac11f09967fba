"""Operators on written-out cases, and against plain Python."""

import datetime
import io
import json
import random
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone import config as C
from lodestone.config import EngineConfig
from lodestone.functions import parsers
from lodestone.functions import text as T
from lodestone.functions.tokenize import cjk, content, external, words
from lodestone.operators import anchors, assemble, bm25, chunk, evaluate, graph, mine, record, registry, route, validity
from lodestone.plans import index, model, qa
from lodestone.sources import corpus, html, sinks, tables, versions
from lodestone.streaming import messages


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).collect()[0]["x"]


def plain_chunks(text, size, overlap, ends="。!?;"):
    import re

    paragraphs = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    pieces = [s for p in paragraphs for s in ([p] if len(p) <= size else re.split(f"(?<=[{ends}])", p)) if s.strip()]
    out, held = [], None
    for s in pieces:
        if held is None or len(held) + len(s) <= size:
            held = (held or "") + s
        else:
            out.append(held.strip())
            held = (held[-overlap:] if overlap else "") + s
    return [c for c in [*out, (held or "").strip()] if c]


@pytest.mark.parametrize("size,overlap", [(100, 20), (40, 0), (400, 50)])
def test_chunks_are_those_of_a_plain_fold(spark, size, overlap):
    rng = random.Random(size)
    texts = ["", "短", "第一句。" * 50, "x" * 500, None] + ["".join(rng.choice(["字", "句。", " ", "\n\n", "\n \n", "!", "long ", "？", "　"]) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunk.split_text("t", size, overlap).alias("c"))
    for r in df.collect():
        assert r["c"] == plain_chunks(r["t"] or "", size, overlap)


def test_chunk_of_long_sentences_stays_below_size_and_overlap(spark):
    got = one(spark, "t string", ("这是一句话。" * 50,), chunk.split_text("t", 100, 20))
    assert got and all(len(c) <= 120 for c in got)


@pytest.mark.parametrize("colon", ["Q:{} A:{}", "Q：{} A：{}", "Q :{} A:{}", "q:{} a：{}", " Q: {} A : {}"])
def test_faq_labels(colon):
    q, a = colon.split(" A") if " A" in colon else colon.split(" a")
    text = "\n".join(f"{q.format(n)}\n{'A' if ' A' in colon else 'a'}{a.format(n)}" for n in ("一", "二"))
    assert [x[0] for x in parsers.faq_entries(text)] == ["一", "二"]


def test_faq_drafts_parse_to_nothing(spark):
    found = spark.createDataFrame([("怎么交",), ("几点",)], "representative string")
    text = "\n".join(r["text"] for r in mine.draft(found).collect())
    assert parsers.faq_entries(text) == []


@pytest.mark.parametrize(
    "body,want",
    [("问题:甲\n标准答案:乙", ("甲", "乙", "")), ("问:甲\n\n第二行\n答：乙\n 丙 ", ("甲\n第二行", "乙\n丙", "")), ("答案:乙", ("", "", "no question")), ("问题:甲", ("", "", "no answer")), ("问题:\n答案:乙", ("", "", "empty question")), ("问题:甲\n答案:", ("", "", "empty answer")), ("Q:甲\nA:乙\nQ:丙", ("", "", "second question")), ("Q:甲\nA:乙\nA:丙", ("", "", "second answer"))],
)
def test_records(body, want):
    assert parsers.record(body) == want


def test_guarded_record_write(spark, tmp_path):
    folder = f"file://{tmp_path}/faq"
    record.create(spark.createDataFrame([(1, "几点 下课？", "五点")], "pos int, question string, answer string"), folder)
    bodies = [("Q:几点下课\nA:六点",), ("Q:学号20230001怎么办\nA:x",), ("Q:问\nA:李雷说的",), ("Q:" + "长" * 201 + "\nA:x",), ("Q:新的\nA:" + "长" * 1000,), ("没有标签",)]
    got = record.checked(spark.createDataFrame(bodies, "body string"), record.read(spark, folder), ["李雷"]).select("body", "reason", "duplicate_of").collect()
    reasons = {r["body"][:6]: (r["reason"], r["duplicate_of"]) for r in got}
    assert [reasons[b[0][:6]][0] for b in bodies] == ["duplicate", "personal data: number", "personal data: name", "too long: question", None, "no question"]
    assert reasons["Q:几点下课\nA"[:6]][1] == 1
    assert record.add_entry(spark, folder, "新的", "答") == 2
    assert [r["question"] for r in record.read(spark, folder).orderBy("pos").collect()] == ["几点 下课？", "新的"]
    with pytest.raises(Exception):
        record.add_entry(spark, f"file://{tmp_path}/none", "a", "b")


def test_idf_variants(spark):
    docs = [(i, ["all"] + (["most"] if i < 16 else []) + (["half"] if i < 12 else []) + [f"only{i}"]) for i in range(20)]
    made = bm25.build(spark.createDataFrame(docs, "id int, t array<string>"), "id", F.col("t"))
    lucene = {r["term"]: r["idf"] for r in bm25.idf_lucene(made.terms, made.corpus).collect()}
    floored = {r["term"]: r["idf"] for r in bm25.idf_floored(made.terms, made.corpus).collect()}
    assert 0 < lucene["all"] < lucene["most"] < lucene["half"] < lucene["only1"]
    assert floored["all"] == floored["most"] == floored["half"] > 0


def test_gate_filters_after_the_cut(spark):
    entries = [(1, "what is the date", ["date"]), (2, "where is the room", ["room"])] + [(k, f"filler number {k}", [f"n{k}"]) for k in range(3, 40)]
    faq = spark.createDataFrame(entries, "pos int, question string, content array<string>")
    asked = spark.createDataFrame([(1, "what is the weather", ["weather"]), (2, "the room", ["room"]), (3, "", [])], "q int, text string, content array<string>")
    found = bm25.search(bm25.build(faq, "pos", words("question")), asked, "q", words("text"), 3, "floored")
    assert found.where("q = 1").count() > 0  # the disease: a hit by function words
    assert [tuple(r) for r in bm25.gated(found, asked, "q", faq, "pos").select("q", "id").collect()] == [(2, 2)]


def test_bm25_by_hand(spark):
    import math

    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, ["c", "c"])], "id int, t array<string>")
    asked = spark.createDataFrame([(1, ["a", "a", "c"])], "q int, t array<string>")
    got = {r["id"]: r["score"] for r in bm25.search(bm25.build(docs, "id", F.col("t")), asked, "q", F.col("t"), 5).collect()}
    part = lambda df, tf, dl: math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 2))
    assert got == pytest.approx({1: 2 * part(1, 2, 3), 3: part(1, 2, 2)})


def plain_leaders(texts, threshold, stop):
    freq = Counter(texts)
    leads, out = [], {}
    sig = lambda t: frozenset(x for x in t.lower().split() if x not in stop)
    for t in sorted(freq, key=lambda t: (-freq[t], t)):
        s = sig(t)
        for lead in leads:
            o = sig(lead)
            if s and o and len(s & o) / len(s | o) >= threshold:
                out[t] = lead
                break
        else:
            leads.append(t)
            out[t] = t
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_leaders_are_those_of_the_sequential_rule(spark, threshold):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(12)] + ["the"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 6))) for _ in range(150)] + ["the"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = mine.groups(df, "id", "text", content(words("text"), ("the",)), threshold).collect()
    want = plain_leaders(texts, threshold, {"the"})
    for r in got:
        alone = all(w == "the" for w in r["text"].split())
        assert r["grp"] == (f"{r['text']}\0{r['id']}" if alone else want[r["text"]])


def test_candidates_count_occurrences(spark):
    asks = [("g", "a", "admin", False, 1.0)] * 3 + [("g", "b", "concept", False, None)] + [("h", "c", "admin", True, 2.0)]
    rows = {r["grp"]: r for r in mine.candidates(spark.createDataFrame(asks, "grp string, text string, kind string, faq_hit boolean, top_score double")).collect()}
    assert (rows["g"]["n_asks"], rows["g"]["n_variants"], rows["g"]["representative"], rows["g"]["is_gap"], rows["g"]["kinds"]) == (4, 2, "a", True, {"admin": 3, "concept": 1})
    assert not rows["h"]["is_gap"]


def test_log_lines(spark):
    lines = [json.dumps({"event": "qa_kind", "message": " 张三 20230001 问 ", "kind": "admin", "faq_hit": True, "top_score": 3.5}, ensure_ascii=False), '{"event": "qa_kind", "message": "ha', json.dumps({"event": "reply"}), json.dumps({"event": "qa_kind", "message": "  "}), ""]
    got = tables.asks(spark.createDataFrame([(x,) for x in lines], "value string"), ["张三"]).collect()
    assert [tuple(r) for r in got] == [("[学生] [学号] 问", "admin", True, 3.5)]


def test_month_files_only(spark, tmp_path):
    for name in ("2026-09.log", "llm.log"):
        (tmp_path / name).write_text(json.dumps({"event": "qa_kind", "message": name}) + "\n")
    assert [r["text"] for r in tables.read_asks(spark, f"file://{tmp_path}").collect()] == ["2026-09.log"]


@pytest.mark.parametrize("text,day", [("2026-9-1", (2026, 9, 1)), ("2026年9月1日", (2026, 9, 1)), ("2026.09.01", (2026, 9, 1)), ("2026/9/01", (2026, 9, 1)), ("2026-13-45", None), ("九月", None)])
def test_dates(spark, text, day):
    want = datetime.date(*day) if day else None
    assert one(spark, "t string", (text,), T.tolerant_date("t")) == want == parsers.fact_date(text)


def test_validity_includes_both_days(spark):
    facts = spark.createDataFrame([("f", datetime.date(2026, 1, 2), datetime.date(2026, 1, 3)), ("open", None, None)], "fact string, effective_from date, effective_until date")
    days = spark.createDataFrame([(datetime.date(2026, 1, d),) for d in range(1, 6)], "day date")
    got = sorted((r["day"].day, r["fact"]) for r in validity.facts_on(days, "day", facts).collect())
    assert got == [(1, "open"), (2, "f"), (2, "open"), (3, "f"), (3, "open"), (4, "open"), (5, "open")]


def test_status_order(spark):
    roster = spark.createDataFrame([("20230001", "王小明")], "student_id string, name string")
    sent = spark.createDataFrame([("漏交了",), ("补交 20230001 姓名:李四",), ("补交 20239999 李小四",)], "text string")
    got = {r["text"]: r["status"] for r in registry.extracted(sent, roster).collect()}
    assert list(got.values()).count("OK") == 1 and got["漏交了"] == "缺学号" and got["补交 20239999 李小四"] == "学号不在名单"
    assert {r["status"] for r in registry.extracted(sent, roster.where("false")).collect()} == {"缺学号", "名单缺失"}


def test_submission_append_needs_its_folder(spark, tmp_path):
    roster = spark.createDataFrame([("20230001", "王小明")], "student_id string, name string")
    checked = registry.extracted(spark.createDataFrame([("补交 20230001 第2次",)], "text string"), roster)
    made = registry.submission_rows(checked, F.lit("2026-01-02 03:04:05").cast("timestamp"))
    assert tuple(made.collect()[0]) == ("2026-01-02 03:04", "20230001", "王小明", "第 2 次", "补交 20230001 第2次", "OK")
    assert sinks.append_submissions(made, f"file://{tmp_path}/table").count() == 1
    assert sinks.append_submissions(made, f"file://{tmp_path}/table").count() == 2
    with pytest.raises(FileNotFoundError):
        sinks.append_submissions(made, f"file://{tmp_path}/none/table")


def workbook(rows):
    cells = "".join(f'<row r="{n}">' + "".join(f'<c r="{chr(65 + k)}{n}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + k)}{n}"><v>{v}</v></c>' for k, v in enumerate(row) if v is not None) + "</row>" for n, row in rows)
    main, link = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{link}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><dimension ref="A1:A1"/><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def test_roster_is_found_by_its_headers(spark):
    book = workbook([(1, ["名单"]), (5, ["序号", "学号", "姓名"]), (6, [1, 20230001.0, "甲"]), (7, [2, "20230002", "乙"]), (8, [3, "20230001", "丙"]), (9, [4, "12", "丁"]), (10, [5, "20230003", None]), (11, [None, None, None])])
    found = tables.roster_rows(tables.workbook_rows(spark.createDataFrame([("p", bytearray(book))], "path string, content binary")))
    assert sorted(map(tuple, found.where("problem is null").select("student_id", "name").collect())) == [("20230001", "甲"), ("20230002", "乙")]
    report = tables.roster_report(found).collect()[0]
    assert (report["count"], report["skipped_rows"], report["duplicates"], report["id_lengths"], report["usable"]) == (2, 2, 1, {8: 2}, True)


def test_corpus_scan_and_parse(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    word = io.BytesIO()
    with zipfile.ZipFile(word, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>第一段</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "sub").mkdir()
    for name, data in {"a.md": "文".encode() + b"\xff", "sub/b.DOCX": word.getvalue(), "c.xlsx": workbook([(1, ["x", None, 2])]), "bad.docx": b"no", "00_toc.md": b"x", "_meta.md": b"x", "~$a.docx": b"x", "d.pptx": b"x", "e.png": b"x", "empty.txt": b" "}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["source"]: (r["text"], r["error"]) for r in corpus.parse(corpus.scan(spark, f"file://{tmp_path}")).collect()}
    assert set(got) == {"a.md", "b.DOCX", "c.xlsx", "bad.docx", "empty.txt"}
    assert got["a.md"] == ("文", None) and got["b.DOCX"][0] == "第一段\na | b" and got["c.xlsx"][0] == "[Sheet: S]\nx | 2"
    assert got["bad.docx"][0] == "" and "BadZipFile" in got["bad.docx"][1]
    docs = corpus.documents(spark, f"file://{tmp_path}")
    assert [(r["doc_id"], r["source"]) for r in docs.orderBy("doc_id").collect()] == [(0, "a.md"), (1, "c.xlsx"), (2, "b.DOCX")]


def test_slides_go_into_groups(spark):
    p, a = "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/main"
    shape = lambda t: f"<p:sp><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/slides/slide1.xml", f'<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:cSld><p:spTree>{shape("顶")}<p:grpSp><p:grpSp>{shape("里")}</p:grpSp></p:grpSp></p:spTree></p:cSld></p:sld>')
    from lodestone.sources.office import pptx_text

    assert pptx_text(out.getvalue()) == "[第1页]\n顶\n里"


def test_event_log_and_cache(spark, tmp_path):
    events = spark.createDataFrame([(datetime.datetime(2026, 9, 1), "a"), (datetime.datetime(2026, 10, 1), "b")], "ts timestamp, event string")
    sinks.append_events(events, f"file://{tmp_path}/log")
    assert {r["month"] for r in spark.read.json(f"file://{tmp_path}/log").collect()} == {"2026-09", "2026-10"}
    jobs = spark.createDataFrame([("k1",), ("k2",)], "key string")
    calls = []

    def run(part):
        calls.append(part.count())
        return part.withColumn("text", F.when(F.col("key") == "k1", "done").otherwise(""))

    sinks.cached(jobs, f"file://{tmp_path}/cache", run, 2)
    first = sum(calls)
    sinks.cached(jobs, f"file://{tmp_path}/cache", run, 2)
    assert first == 2 and sum(calls) - first == 1  # the empty one is done again
    assert sinks.reply_line({"type": "error"})[1] == 1 and sinks.reply_line({"type": "question"})[1] == 0


def test_model_calls():
    waits, told = [], iter([(500, ""), (429, ""), (200, "ok")])
    assert model.ask(lambda *a: next(told), "s", "u", wait=waits.append) == (True, "ok") and waits == [0.5, 1.0]
    count = []
    assert model.ask(lambda *a: (count.append(1), (400, ""))[1], "s", "u", wait=waits.append) == (False, "") and len(count) == 1


def planned(spark, corpus_index=True, threshold=0.1):
    faq = spark.createDataFrame([(1, "考试 几点 开始", "九点")] + [(k, f"无关 条目{k}", "答") for k in range(2, 30)], "pos int, question string, answer string").withColumn("content", content(words("question")))
    chunks = spark.createDataFrame([(1, "叠加 定理 内容", "book.md"), (2, "考试 安排", "plan.md")], "id long, text string, source string")
    known = qa.Knowledge(faq, bm25.build(faq, "pos", words("question")), chunks, bm25.build(chunks, "id", words("text")) if corpus_index else None, "- 周五交(通知)", ("facts",))
    asked = spark.createDataFrame([(1, "考试 几点 开始"), (2, "叠加 定理"), (3, "考试 请假 安排"), (4, "1.36 叠加 几点")], "id int, text string")
    return {r["id"]: r for r in qa.plan(asked, known, words("text"), content(words("text")), config=EngineConfig(faq_hit_threshold=threshold)).collect()}


def test_planner(spark):
    r = planned(spark)
    assert (r[1]["kind"], r[1]["path"], r[1]["n_hits"], r[1]["sources"]) == ("admin", "faq", 0, ["facts", "FAQ"]) and r[1]["context"].startswith("- 周五交") and "九点" in r[1]["context"]
    assert (r[2]["kind"], r[2]["path"], r[2]["faq_hit"], r[2]["sources"]) == ("concept", "rag", False, ["book.md"])
    assert r[3]["kind"] == "admin"
    assert r[4]["kind"] == "problem" and "九点" not in r[4]["context"] and "- 周五交" not in r[4]["context"]
    r = planned(spark, corpus_index=False)
    assert r[1]["path"] == "faq" and r[2]["path"] == "no_index" and r[2]["context"] == ""


def test_answers_fall_back_to_the_context(spark):
    rows = spark.createDataFrame([(1, "rag", "c" * 600, ["a", "b"]), (2, "rag", "ctx", []), (3, "no_index", "", [])], "id int, path string, context string, sources array<string>")
    told = spark.createDataFrame([(1, ""), (2, "reply")], "key int, reply string")
    got = {r["id"]: r["answer"] for r in qa.answers(rows, told).collect()}
    assert got[1] == "c" * 500 + "\n\n来源:a, b" and got[2] == "reply" and "资料库" in got[3]


def test_index_plan(spark):
    text = "检索:电路\n[教材 P10]\n" + "\n\n".join("句子。" * 60 for _ in range(4)) + "\n\n[教材 P11]\n\n" + "\n\n".join("句子。" * 60 for _ in range(4))
    parts, made = index.build(spark.createDataFrame([(7, "b.md", text)], "doc_id int, source string, text string"), "doc_id", "source", tokenizer=cjk)
    rows = parts.orderBy("chunk_no").collect()
    assert len(rows) > 3 and all("检索:电路" in r["text"] and "[教材 P" in r["text"] for r in rows) and rows[0]["text"].count("检索:电路") == 1
    assert made.corpus.collect()[0]["n"] == len(rows)
    with pytest.raises(ValueError):
        index.build(spark.createDataFrame([], "doc_id int, source string, text string"), "doc_id", "source")


def test_index_tables_can_be_written_and_read(spark, tmp_path):
    made = bm25.build(spark.createDataFrame([(1, ["a"]), (2, ["b"])], "id int, t array<string>"), "id", F.col("t"))
    made.write(f"file://{tmp_path}/index")
    again = bm25.Index.read(spark, f"file://{tmp_path}/index")
    assert bm25.idf_lucene(again.terms, again.corpus).count() == 2
    with pytest.raises(Exception):
        bm25.Index.read(spark, f"file://{tmp_path}/none")


def test_tokenizers(spark):
    assert one(spark, "t string", ("电路分析 AC 1题",), cjk("t")) == ["电路", "路分", "分析", "ac", "1", "题"]
    assert one(spark, "t string", ("a b",), external(str.split)("t")) == ["a", "b"]
    assert one(spark, "t string", (None,), words("t")) == []


def test_text_functions(spark):
    assert one(spark, "t string", ("a  b\n\n\n\nc ",), T.clean_spaces("t")) == "a b\n\nc"
    assert one(spark, "t string", ("正文\nCopyright © 2017 McGraw",), T.strip_boilerplate("t", [], r"(?:\n|^)[ \t]*Copyright\s*©")) == "正文"
    assert one(spark, "t string", ("第1章基本概念3\n\n正文",), T.strip_running_header("t")) == "正文"
    assert one(spark, "t string", ("a中",), T.code_points("t")) == ["61", "4e2d"]
    assert one(spark, "t string", ("``` {\"type\":\"submission\"} ```",), route.model_verdict("t")) == "submission"
    assert one(spark, "t string", ('{"choices":[{"message":{"content":"","reasoning_content":"想"}}]}',), T.reply_text("t")) == "想"
    assert one(spark, "t string", ("3.0",), T.cell_text("t")) == "3"
    assert one(spark, "t string", ("x" * 60 + "\n42.5 y",), T.around("t", F.lit("42.5"), 3, 2)) == "xx 42.5 y"
    assert one(spark, "t string", ("Solution 11.2 text",), T.problem_reference("t", F.lit("Soln11012.pdf")))["problem"] == "11.2"
    assert one(spark, "t string", ("text",), T.problem_reference("t", F.lit("Soln11012.pdf")))["problem"] == "11.12"
    assert one(spark, "t string", ("x",), T.keyword_line(F.lit("a"), F.lit(""), F.lit("b"), F.lit("a"))) == "检索:a b"
    assert one(spark, "t string", ("# 标题\n\n- x\n\n第一 **段** [链](u)\n",), T.first_paragraph("t")) == "第一 段 链"
    assert one(spark, "t string", ("# 标题\n",), T.first_heading("t")) == "标题"
    assert one(spark, "t string", ("Z第1-2章 Z第9-第9章",), assemble.chapters_in_name("t")) == [1, 2, 9]
    assert one(spark, "t string", ("a<b>&",), T.html_escaped("t")) == "a&lt;b&gt;&amp;"


@pytest.mark.parametrize("message,want", [(" 【转发学生提问】问", ("forward", "问")), ("[转发学生提问] 问 ", ("forward", "问")), ("【转发学生提问】 ", ("skip", "")), ("问", ("skip", "")), ("\n【记录】Q", ("record", "Q")), (None, ("skip", ""))])
def test_routes(spark, message, want):
    got = one(spark, "t string", (message,), route.route("t"))
    assert (got["route"], got["body"]) == want


def test_contents_manifest_and_chapters(spark):
    rows = spark.createDataFrame([(1, "1.10"), (1, "1.2"), (1, "x"), (2, "2.1")], "chapter int, label string")
    assert {r["chapter"]: r["labels"] for r in assemble.contents(rows, "chapter", "label").collect()} == {1: "1.2 1.10 x", 2: "2.1"}
    pages = spark.createDataFrame([(19, "a"), (20, "b"), (30, "c")], "pdf_page int, text string")
    starts = spark.createDataFrame([(3, 1, "一"), (5, 2, "二")], "printed_start int, no int, title string")
    assert sorted((r["pdf_page"], r["printed_page"], r["no"]) for r in assemble.pages_of(pages, starts).collect()) == [(19, 3, 1), (20, 4, 1), (30, 14, 2)]
    done = spark.createDataFrame([("short",), (None,)], "reason string")
    assert {r["outcome"]: r["n"] for r in assemble.manifest(done, "reason").collect()} == {"short": 1, "written": 1}


def test_html(spark):
    pages = spark.createDataFrame([(1, '<h1 id="a">x</h1><a href="#a">1</a><a href="#b">2</a><a href="p.html#q">3</a><img src="i.svg"><b><i></b></i>')], "page_id int, html string")
    found = html.page_structure(pages)
    assert [r["value"] for r in html.broken_anchors(found).collect()] == ["b"]
    files = spark.createDataFrame([("p.html",)], "name string")
    assert [r["name"] for r in html.broken_links(found, files).collect()] == ["i.svg"]
    assert found.where("kind = 'error'").count() == 2


def test_evaluation(spark):
    now = spark.createDataFrame([("a", 1, 0, 0), ("b", None, 0, 0), ("c", 2, 0, 0), ("d", 1, 0, 0), ("n", 1, 0, 0)], "q string, first_rank int, n_foreign long, n_forbidden long")
    before = spark.createDataFrame([("a", 1, 0, 0), ("b", 3, 0, 0), ("c", 3, 0, 0), ("d", 1, 0, 0), ("m", 1, 0, 0)], "q string, first_rank int, n_foreign long, n_forbidden long")
    assert {r["q"]: r["change"] for r in evaluate.compared(now, before, "q").collect()} == {"a": "same", "b": "worse", "c": "changed", "d": "same", "m": "missing", "n": "new"}
    assert one(spark, "s string, a array<int>", ("第3章 x.md", []), evaluate.foreign_chapter("s", F.col("a"))) is True
    assert one(spark, "s string, a array<int>", ("第3章 x.md", [3]), evaluate.foreign_chapter("s", F.col("a"))) is False


def test_cycles_are_an_error(spark):
    edges = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    with pytest.raises(ValueError, match="cycle"):
        graph.layers(edges([("a", "b"), ("b", "c"), ("c", "b")]))
    told = graph.layers(edges([("a", "b"), ("b", "c"), ("a", "c"), ("x", "c"), ("a", "b"), (None, "n"), ("n", None)]))
    assert {r["node"]: r["layer"] for r in told.collect()} == {"a": 0, "b": 1, "c": 2, "x": 0}
    assert graph.layers(edges([])).collect() == []


def plain_components(edges):
    """Nodes by what they reach, each component after its least node; and the longest path between components."""
    edges = {(a, b) for a, b in edges if a is not None and b is not None}
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
        after.setdefault(b, set())

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for b in after[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        return seen

    far = {a: reach(a) for a in after}
    own = {a: min([a, *(b for b in far[a] if a in far[b])]) for a in after}
    between = {(own[a], own[b]) for a, b in edges if own[a] != own[b]}
    layer = {c: 0 for c in own.values()}
    for _ in layer:
        for a, b in between:
            layer[b] = max(layer[b], layer[a] + 1)
    return {(a, c, layer[c]) for a, c in own.items()}, {(a, b, own[a]) for a, b in edges if own[a] == own[b]}


@pytest.mark.parametrize("n,m,seed", [(1, 1, 0), (6, 9, 1), (30, 38, 2), (30, 60, 3), (0, 0, 4)])
def test_strong_components_are_those_of_a_plain_walk(spark, n, m, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + ([(None, 1), (2, None)] if n > 1 else [])
    edges = spark.createDataFrame(rows, "src long, dst long").repartition(3)
    layers, cyclic = plain_components(rows)
    got = graph.component_layers(edges)
    assert {tuple(r) for r in got.collect()} == layers and got.count() == len(layers)
    assert {tuple(r) for r in graph.cyclic_edges(edges.dropna(), got).collect()} == cyclic


def test_streams(spark, tmp_path):
    source = spark.createDataFrame([("【转发学生提问】什么是叠加原理",), ("闲聊",)], "text string")
    source.write.parquet(f"file://{tmp_path}/in")
    stream = messages.routed(spark.readStream.schema("text string").parquet(f"file://{tmp_path}/in"))
    running = messages.answered(stream, lambda b: b.where("route = 'forward'"), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    running.processAllAvailable()
    running.stop()
    assert [(r["class"], r["kind"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()] == [("question", "concept")]


def test_configuration():
    c = EngineConfig.from_env({"RAG_TOP_K": "9", "FAQ_HIT_THRESHOLD": "5", "FORWARD_PREFIX": "[a], [b]"})
    assert (c.rag_top_k, c.faq_hit_threshold, c.forward_prefixes) == (9, 5.0, ("[a]", "[b]"))
    assert EngineConfig().rag_top_k == 7 and "?" in C.QUESTION_WORDS


def test_end_tags_that_may_be_left_out(spark):
    pages = spark.createDataFrame([(1, "<ul><li>a<li>b</ul><table><tr><td>x<td>y<tr><td>z</table><p>one<p>two"), (2, "<div><span><p>x</div></p>"), (3, None)], "page_id int, html string")
    errors = {}
    for r in html.page_structure(pages).where("kind = 'error'").collect():
        errors.setdefault(r["page_id"], []).append(r["value"])
    assert errors == {2: ["</div> closes <span>", "</p> closes nothing"]}


def test_versions(spark, tmp_path):
    folder = f"file://{tmp_path}/corpus"
    with pytest.raises(FileNotFoundError):
        versions.in_force(spark, folder)
    for text in ("one", "two"):
        sinks.write_corpus(spark.createDataFrame([(text,)], "text string"), folder)
        assert [r["text"] for r in sinks.read_corpus(spark, folder).collect()] == [text]
    (tmp_path / "corpus" / "current-000000000003").write_text("")  # a writer that died
    assert [r["text"] for r in sinks.read_corpus(spark, folder).collect()] == ["two"]


def test_an_index_is_built_once_for_a_state_of_its_files(spark, tmp_path):
    path = f"file://{tmp_path}/docs"
    write = lambda rows, mode: spark.createDataFrame(rows, "id long, text string").write.mode(mode).parquet(path)
    write([(1, "a b a"), (2, None), (3, "b")], "overwrite")
    index = lambda: bm25.stored(spark.read.parquet(path), "id", words("text"), "t")
    first = index()
    assert sorted((r["term"], r["id"], r["tf"], r["dl"]) for r in first.postings.collect()) == [("a", 1, 2, 3), ("b", 1, 1, 3), ("b", 3, 1, 1)]
    assert first.corpus.collect()[0]["n"] == 3 and index().entries.inputFiles() == first.entries.inputFiles()
    write([(4, "c")], "append")
    assert index().corpus.collect()[0]["n"] == 4


def test_leaders_by_the_sequential_rule(spark):
    rng = random.Random(3)
    asks = [" ".join(rng.sample("abcdefgh", rng.randint(0, 5))) for _ in range(300)]
    times = {}
    for a in asks:
        times[a] = times.get(a, 0) + 1
    for theta in (0.3, 0.5, 0.8):
        led, want = [], {}
        for text in sorted(times, key=lambda t: (-times[t], t)):
            own = set(text.split())
            near = [x for x in led if own and set(x.split()) and len(own & set(x.split())) / len(own | set(x.split())) >= theta]
            want[text] = near[0] if near else text
            led += [] if near else [text]
        got = mine.leaders(spark.createDataFrame([(a,) for a in asks], "text string"), "text", content(words("text"), ()), theta)
        assert {r["text"]: r["leader"] for r in got.collect()} == want


def test_first_origin(spark):
    rows = spark.createDataFrame([("a", 2, 1), ("a", 1, 2), ("b", 3, 3), ("a", 1, 4)], "key string, origin int, id int")
    assert sorted(r["id"] for r in assemble.first_origin(rows, "key", "origin").collect()) == [2, 3, 4]


def test_notices_inside_notices_go_at_any_depth(spark):
    text = "MIT."
    for _ in range(12):
        text = f"M{text}IT."
    assert one(spark, "t string", (f"a {text} b",), T.strip_boilerplate("t", [r"MIT\."], "Copyright")) == "a b"
    assert one(spark, "t string", (None,), T.strip_boilerplate("t", [r"MIT\."], "Copyright")) is None


def plain_layers(edges):
    """By a walk that goes down as it is called, and edges pushed until nothing moves."""
    nodes = list(dict.fromkeys(n for e in edges for n in e))
    above, over, back = [], set(), set()

    def down(node):
        above.append(node)
        for a, b in edges:
            if a != node or a == b:
                continue
            if b in above:
                back.add((a, b))
            elif b not in over:
                down(b)
        above.pop()
        over.add(node)

    for n in nodes:
        if n not in over:
            down(n)
    layer, moved = dict.fromkeys(nodes, 0), True
    while moved:
        moved = False
        for a, b in edges:
            if a != b and (a, b) not in back and layer[b] <= layer[a]:
                layer[b], moved = layer[a] + 1, True
    return layer


def test_diagrams_with_cycles(spark):
    rng = random.Random(5)
    graphs = [[("a", "b"), ("b", "a")], [("a", "a")], [("a", "b"), ("b", "c"), ("c", "b"), ("a", "c")]] + [[(rng.choice("abcdefg"), rng.choice("abcdefg")) for _ in range(rng.randint(1, 14))] for _ in range(60)]
    rows = [(g, k, a, b) for g, edges in enumerate(graphs) for k, (a, b) in enumerate(edges)] + [(0, 9, None, "z")]
    found = graph.diagram_layers(spark.createDataFrame(rows, "g int, k int, src string, dst string"), "g", "k").collect()
    for g, edges in enumerate(graphs):
        assert {r["node"]: r["layer"] for r in found if r["g"] == g} == plain_layers(edges)
    long = [(str(k), str(k + 1)) for k in range(5000)]
    assert graph.forward_edges(long)[1] == long  # no recursion


def test_answer_sections(spark):
    docs = spark.createDataFrame([(1, "导言\n\n 2. 二\n书10.60 书题\n\n3、三"), (2, "没有标题 2. 在行里"), (3, None), (4, "1. 一\n"), (5, "")], "id int, text string")
    got = [(r["id"], r["part"], r["label"], r["body"]) for r in assemble.answer_sections(docs, "text").orderBy("id", "part").collect()]
    assert got == [(1, 1, "前言", "导言"), (1, 2, "第2题", "2. 二"), (1, 3, "书10.60", "书10.60 书题"), (1, 4, "第3题", "3、三"), (2, 1, "全文", "没有标题 2. 在行里"), (4, 1, "第1题", "1. 一"), (5, 1, "全文", "")]


def test_section_titles_by_first_appearance(spark):
    pages = spark.createDataFrame([(2, "1.2 乙 …… \n1.1 甲"), (1, "1.1 甲 ...\n1.10 3 不是\n正文")], "page int, text string").selectExpr("0 AS book", "*")
    assert [r["title"] for r in assemble.section_titles(pages, ["book"], "text", "page").orderBy("place").collect()] == ["1.1 甲", "1.2 乙"]


@pytest.mark.parametrize("body,lead,left", [("\n第一段\n续 **粗**\n\n## 节\n文", "第一段 续 粗", "\n\n## 节\n文"), ("第一段\n\n第二段", "", "第一段\n\n第二段"), ("- 列表\n\n## 节", "", "- 列表\n\n## 节"), ("**粗体** 开头\n", "粗体 开头", ""), ("", "", ""), ("\n\n", "", "\n\n"), ("段\n  \n \n# 完", "段", "  \n \n# 完")])
def test_lead_paragraphs(spark, body, lead, left):
    assert tuple(one(spark, "t string", (body,), T.lead_paragraph("t"))) == (lead, left)


def test_names_widths_and_offsets(spark):
    assert one(spark, "t string", ("/x/数字电路(一)成绩记分册_1774943315001.xlsx",), T.submission_table("t")) == "/x/数字电路(一)_补交表.xlsx"
    assert one(spark, "t string", ("名单.xlsx",), T.submission_table("t")) == "名单_补交表.xlsx"
    assert one(spark, "t string", ("分析方法R",), T.clean_title("t")) == "分析方法"
    assert one(spark, "t string", ("R",), T.clean_title("t")) == "讲义"
    assert one(spark, "t string", (None,), T.text_width("t", 10.0)) == 0.0
    assert one(spark, "t string", ("中a A.",), T.text_width("t", 10.0, True)) == pytest.approx((1 + 0.55 + 0.3 + 0.62 + 0.34) * 10 * 1.03)
    assert one(spark, "p int, t string", (19, "第1章基本概念3\n正文"), T.page_offset_fits("p", "t"))
    assert not one(spark, "p int, t string", (20, "正文\n4第一部分直流电路 3\n"), T.page_offset_fits("p", "t"))
    assert one(spark, "p int, t string", (20, "a\nb\nc\n第1章 3"), T.page_offset_fits("p", "t"))


def test_heads_of_texts(spark):
    course = anchors.Course("课", "某", "书", "书.pdf", "另")
    got = one(spark, "c int", (3,), anchors.book_chapter(course, F.col("c"), F.lit("节 点"), F.lit(1), F.lit(9), F.array(F.lit("3.1 节"), F.lit("3.2 点"))))
    assert got.splitlines()[2] == "检索:课 教材 课本 中文版 第六版 第6版 第3章 CH3 节 点 3.1 3.2 另"
    assert one(spark, "c int", (3,), anchors.translated_problem(course, F.col("c"), F.lit("3.2"), F.lit("a.pdf"))).splitlines()[2].endswith("中文版 第3章 CH3 3.2 题3.2 另")
    assert "P1-P9" in one(spark, "c int", (3,), anchors.book_appendix(course, F.lit(1), F.lit(9)))
    assert one(spark, "c int", (3,), anchors.book_preface(course)).count("\n") == 3


def test_gate_is_shut_without_a_baseline(spark):
    changes = spark.createDataFrame([(1, "same"), (2, "changed")], "q int, change string")
    assert evaluate.exit_status(None) == 1
    assert evaluate.exit_status(changes) == 0
    assert evaluate.exit_status(changes.union(spark.createDataFrame([(3, "worse")], changes.schema))) == 1


def test_record_replies(spark):
    row = ("问", "答" * 130, 2, "旧问", True, "/faq")
    got = one(spark, "q string, a string, n int, old string, no boolean, p string", row, record.reply(F.lit(8), F.col("q"), F.col("a"), F.col("n"), F.col("old"), F.col("no"), "p"))
    assert "答" * 120 + "……" in got and "(第 2 条):旧问" in got and "花名册没读到" in got
    row = ("问", "答", None, None, False, "/faq")
    got = one(spark, "q string, a string, n int, old string, no boolean, p string", row, record.reply(F.lit(8), F.col("q"), F.col("a"), F.col("n"), F.col("old"), F.col("no"), "p"))
    assert got == "✅ 已记录,FAQ 现在能被检索到 8 条。\n\n问:问\n答:答\n\n文件:/faq"


def test_facts_of_an_optional_file(spark, tmp_path):
    path = tmp_path / "facts.txt"
    assert corpus.load_facts(spark, str(path)).count() == 0
    path.write_text("事实:总是\n\n失效:2020-01-01\n事实:旧\n\n生效:2020-01-01\n事实:新\n", "utf-8")
    day = F.lit(datetime.date(2020, 1, 1))
    assert [r["fact"] for r in corpus.load_facts(spark, str(path), day).orderBy("pos").collect()] == ["总是", "旧", "新"]
    assert [r["fact"] for r in corpus.load_facts(spark, str(path)).orderBy("pos").collect()] == ["总是", "新"]


def test_settings_from_a_file_and_providers(tmp_path):
    file = tmp_path / ".env"
    file.write_text("# c\nRAG_TOP_K = 9\nexport LLM_MODEL='m'\nK1=2\n\nnonsense\n", "utf-8")
    env = C.environment(str(file), {"K1": "1.2"})
    assert (EngineConfig.from_env(env).rag_top_k, EngineConfig.from_env(env).k1, env["LLM_MODEL"]) == (9, 1.2, "m")
    assert C.environment(str(tmp_path / "none"), {}) == {}
    assert model.provider({"LLM_API_KEY": "k", "LLM_MODEL": "m", "FALLBACK_API_KEY": "o"}) == model.Provider("k", "m", "")
    old = model.provider({"LLM_MODEL": "m", "FALLBACK_MODEL": "old", "FALLBACK_GROUP_ID": "g"})
    assert (old.model, old.group, old.available()) == ("old", "g", False)


def zipped(parts):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return held.getvalue()


def test_workbooks_with_dates_and_truth_values():
    from lodestone.sources import office

    s, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sheet = f'<worksheet {s}><sheetData><row r="1"><c r="A1" t="b"><v>1</v></c><c r="B1" s="1"><v>45000.5</v></c><c r="C1" s="2"><v>45000</v></c><c r="D1"><v>45000</v></c></row><row r="3"><c r="B3"><v>7</v></c></row></sheetData></worksheet>'
    data = zipped({
        "xl/workbook.xml": f'<workbook {s} {r}><sheets><sheet name="甲" r:id="a"/><sheet name="乙" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/1.xml"/><Relationship Id="b" Target="worksheets/2.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {s}><numFmts><numFmt numFmtId="170" formatCode="yyyy&quot;年&quot;m"/><numFmt numFmtId="171" formatCode="0.0&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        "xl/worksheets/1.xml": sheet,
        "xl/worksheets/2.xml": f'<worksheet {s}><sheetData/></worksheet>',
    })
    assert office.xlsx_text(data) == "[Sheet: 甲]\nTrue | 2023-03-15 12:00:00 | 2023-03-15 00:00:00 | 45000\n7\n\n[Sheet: 乙]"


def test_slides_with_blank_rows_and_broken_notes():
    from lodestone.sources import office

    p, a = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"', 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    cell = "<a:tc><a:p><a:r><a:t>{}</a:t></a:r></a:p></a:tc>".format
    rows = f"<a:tr>{cell('错')}{cell('对')}</a:tr><a:tr>{cell(' ')}{cell('')}</a:tr>"
    data = zipped({
        "ppt/slides/slide1.xml": f"<p:sld {p} {a}><p:cSld><p:spTree><p:graphicFrame><a:tbl>{rows}</a:tbl></p:graphicFrame></p:spTree></p:cSld></p:sld>",
        "ppt/slides/_rels/slide1.xml.rels": '<Relationships><Relationship Type="x/notesSlide" Target="../notesSlides/gone.xml"/></Relationships>',
    })
    assert office.pptx_text(data) == "[第1页]\n错 | 对"


def test_audit_of_marked_texts(spark):
    rows = [("1.36", "【解】值 120 与【原】值 120 与 1.36 与 103 与 555【英】888"), ("2.1", "【解】无"), ("3.1", "【解】a【原】无数字")]
    audit = evaluate.marked_audit(spark.createDataFrame(rows, "no string, text string"), "text", "【解】", "【原】", "【英】", "no")
    assert {r["no"]: (r["missing"], r["state"]) for r in audit.collect()} == {"1.36": (["555"], "missing"), "2.1": (None, "no mark"), "3.1": ([], "kept")}


def test_files_are_read_whole(spark, tmp_path):
    for name in ("p7.txt", "a.md", "faq.txt"):
        (tmp_path / name).write_text("Q: 一\n二\nA: 三\n", "utf-8")
    assert [tuple(r) for r in corpus.page_texts(spark, str(tmp_path)).collect()] == [(7, "Q: 一\n二\nA: 三\n")]
    assert [r["text"] for r in corpus.markdown(spark, str(tmp_path)).collect()] == ["Q: 一\n二\nA: 三\n"]
    entries = parsers.parse_faq(corpus.text_or_empty(spark, str(tmp_path / "faq.txt"))).collect()
    assert [(r["pos"], r["question"], r["answer"]) for r in entries] == [(1, "一\n二", "三")]
