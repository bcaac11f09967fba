"""Registered queries over the driver's tables, each beside the SQL that says the same.

Rule tables of the course domain are Chinese, the tables are not; queries over
tables bring rules of their own, so that every branch occurs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from ..functions.tokenize import content, words
from ..operators import assemble, bm25, chunk, evaluate, mine, registry, route, validity
from ..runtime import kept
from ..sources import html
from ..streaming import messages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


#: What identifies a turn of a conversation and a chunk of a document; numbers put together could clash.
_TURN, _CHUNK = ("conv_id", "turn"), ("doc_id", "chunk_no")


def _struct(columns: tuple[str, ...]) -> str:
    """The SQL of an identifier."""
    return "struct_pack(" + ", ".join(f"{c} := {c}" for c in columns) + ")"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


def values(data: list[tuple], names: str) -> str:
    """The rows as SQL."""

    def one(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in data)}) t({names})"


# Search -------------------------------------------------------------------

_INDEX = f"""
tokens AS (SELECT doc_id AS id, {_WORDS.format("text")} AS w FROM documents),
postings AS (SELECT id, term, COUNT(*) AS tf FROM (SELECT id, UNNEST(w) AS term FROM tokens) GROUP BY id, term),
lengths AS (SELECT id, len(w) AS dl FROM tokens),
corpus AS (SELECT COUNT(*) AS n, AVG(dl) AS avgdl FROM lengths),
terms AS (SELECT term, COUNT(*) AS df FROM postings GROUP BY term)"""
_LUCENE = "idf AS (SELECT term, LN(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM terms, corpus)"
_FLOORED = "raw AS (SELECT term, LN(n - df + 0.5) - LN(df + 0.5) AS r FROM terms, corpus), idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT AVG(r) FROM raw) ELSE r END AS idf FROM raw)"


def _scored(queries: str, k: int, extra: str = "") -> str:
    """SQL for the k best of each query of ``queries`` (q, text)."""
    return f"""
asked AS (SELECT q, term, COUNT(*) AS times FROM (SELECT q, UNNEST({_WORDS.format("text")}) AS term FROM ({queries})) GROUP BY q, term),
scored AS (SELECT q, p.id, SUM(times * idf * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)))) AS score
           FROM asked JOIN idf USING (term) JOIN postings p USING (term) JOIN lengths l ON p.id = l.id, corpus GROUP BY q, p.id),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY q ORDER BY ROUND(score, 9) DESC, id) AS rank FROM scored),
best AS (SELECT * FROM ranked WHERE rank <= {k} AND score > 0){extra}"""


def document_index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    return bm25.stored(table(spark, sf_dir, "documents"), "doc_id", words("text"), "documents")


def chunk_index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    parts = chunk_documents(spark, sf_dir).withColumn("id", F.struct(*_CHUNK))
    return bm25.stored(parts, "id", words("text"), "chunks", "split_text 1")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), "text")


@query(f"WITH {_INDEX}, {_LUCENE}, {_scored('SELECT item_id AS q, text FROM benchmark', 5)} SELECT q AS item_id, id AS doc_id, CAST(rank AS INTEGER) AS rank, ROUND(score, 6) AS score FROM best")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25.search(document_index(spark, sf_dir), benchmark_queries(spark, sf_dir), "q", words("text"), 5)
    return found.select(F.col("q").alias("item_id"), F.col("id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_INDEX} SELECT id AS doc_id, term, CAST(tf AS INTEGER) AS tf FROM postings")
def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(spark, sf_dir).postings.select(F.col("id").alias("doc_id"), "term", "tf")


@query(f"""
WITH held AS (SELECT list_distinct(w) AS own, len(w) AS dl FROM (SELECT {_WORDS.format("text")} AS w FROM documents)),
terms AS (SELECT term, COUNT(*) AS df FROM (SELECT UNNEST(own) AS term FROM held) GROUP BY term)
SELECT term, df, ROUND(LN(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM terms, (SELECT COUNT(*) AS n FROM held)""")
def doc_freq_idf_lucene(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = document_index(spark, sf_dir)
    return bm25.idf_lucene(index.terms, index.corpus).withColumn("idf", F.round("idf", 6))


@query(f"WITH {_INDEX.replace('doc_id AS id', _struct(_TURN) + ' AS id').replace('FROM documents', 'FROM conversations')}, {_FLOORED} SELECT term, df, ROUND(idf, 6) AS idf FROM terms JOIN idf USING (term)")
def doc_freq_idf_floored(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("id", F.struct(*_TURN))
    index = bm25.build(turns, "id", words("text"))
    return bm25.idf_floored(index.terms, index.corpus).withColumn("idf", F.round("idf", 6))


_ENDS = ".!?;"
_CHUNKS = r"""
pieces AS (
  SELECT doc_id, list_filter(CASE WHEN length(p) <= 400 THEN [p] ELSE regexp_extract_all(p, '[^.!?;]*[.!?;]|[^.!?;]+$') END, lambda x: trim(x, E' \t\n\r') <> '') AS s
  FROM (SELECT doc_id, trim(text, E' \t\n\r') AS p FROM documents) WHERE p <> ''),
fold AS (
  SELECT doc_id, 1 AS k, s, s[1] AS buf, CAST(NULL AS VARCHAR) AS out, 0 AS c FROM pieces
  UNION ALL
  SELECT doc_id, k + 1, s,
         CASE WHEN length(buf) + length(s[k + 1]) <= 400 THEN buf || s[k + 1] ELSE right(buf, 50) || s[k + 1] END,
         CASE WHEN length(buf) + length(s[k + 1]) <= 400 THEN NULL ELSE buf END,
         c + CASE WHEN length(buf) + length(s[k + 1]) <= 400 THEN 0 ELSE 1 END
  FROM fold WHERE k < len(s)),
chunks AS (
  SELECT doc_id, c - 1 AS chunk_no, trim(out, E' \t\n\r') AS text FROM fold WHERE out IS NOT NULL
  UNION ALL
  SELECT doc_id, c, trim(buf, E' \t\n\r') FROM fold WHERE k = len(s))"""


@query(f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, text FROM chunks")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", ends=_ENDS).drop("anchor")


_CHUNK_INDEX = _INDEX.replace("doc_id AS id", _struct(_CHUNK) + " AS id").replace("FROM documents", "FROM chunks")


@query(f"WITH RECURSIVE {_CHUNKS}, {_CHUNK_INDEX}, {_LUCENE}, {_scored('SELECT item_id AS q, text FROM benchmark', 5)} SELECT q AS item_id, c.doc_id, CAST(c.chunk_no AS INTEGER) AS chunk_no, CAST(rank AS INTEGER) AS rank, ROUND(score, 6) AS score, c.text FROM best JOIN chunks c ON c.doc_id = id.doc_id AND c.chunk_no = id.chunk_no")
def bm25_topk_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kept(bm25.search(chunk_index(spark, sf_dir), benchmark_queries(spark, sf_dir), "q", words("text"), 5))
    # Only documents that hold one of the best are cut again.
    hit = found.select("id.doc_id").distinct()
    docs = table(spark, sf_dir, "documents").join(hit, "doc_id", "left_semi")
    parts = chunk.chunks(docs, "doc_id", "text", ends=_ENDS).withColumn("id", F.struct(*_CHUNK))
    found = found.join(parts.select("id", "doc_id", "chunk_no", "text"), "id")
    return found.select(F.col("q").alias("item_id"), "doc_id", "chunk_no", "rank", F.round("score", 6).alias("score"), "text")


# Questions and answers ----------------------------------------------------

_PAIRS = """
pairs AS (SELECT struct_pack(conv_id := conv_id, turn := turn) AS pos, text AS question, answer FROM (
  SELECT *, LEAD(role) OVER w AS next_role, LEAD(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant' AND text <> '' AND answer <> '')"""


@query(f"WITH {_PAIRS} SELECT pos.conv_id AS conv_id, pos.turn AS turn, question, answer FROM pairs")
def faq_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("pos.conv_id", "pos.turn", "question", "answer")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = W.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(turn), "answer": F.lead("text").over(turn)})
    t = t.where("role = 'user' AND next_role = 'assistant' AND text <> '' AND answer <> ''")
    return t.select(F.struct(*_TURN).alias("pos"), F.col("text").alias("question"), "answer")


_STOP = ("the", "of", "and", "to", "in", "a", "is", "de", "was", "that", "der", "for", "it", "on", "la")
_GATE = "list_has_any(list_filter({0}, lambda x: NOT list_contains({2}, x)), list_filter({1}, lambda x: NOT list_contains({2}, x)))"
_FAQ_INDEX = f"{_PAIRS}, {_INDEX.replace('doc_id AS id', 'pos AS id').replace('FROM documents', 'FROM pairs').replace('lower(text)', 'lower(question)')}, {_FLOORED}"
_FAQ_ASKED = f"SELECT {_struct(_TURN)} AS q, text FROM conversations WHERE role = 'user'"
_FAQ_HITS = f"""{_FAQ_INDEX}, {_scored(_FAQ_ASKED, 3)},
gated AS (SELECT b.q, b.id AS pos, b.rank, b.score FROM best b JOIN ({_FAQ_ASKED}) a ON a.q = b.q JOIN pairs p ON p.pos = b.id
  WHERE {_GATE.format(_WORDS.format("a.text"), _WORDS.format("p.question"), list(_STOP))})"""


def _faq(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, bm25.Index, DataFrame]:
    pairs = _pairs(spark, sf_dir).withColumn("content", content(words("question"), _STOP))
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.struct(*_TURN).alias("q"), "text")
    return pairs, bm25.build(pairs, "pos", words("question")), turns


@query(f"WITH {_FAQ_HITS} SELECT q.conv_id AS conv_id, q.turn AS turn, pos.conv_id AS pos_conv_id, pos.turn AS pos_turn, CAST(rank AS INTEGER) AS rank, ROUND(score, 6) AS score, score >= 4.0 AS hit FROM gated")
def faq_gated_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, index, turns = _faq(spark, sf_dir)
    found = bm25.search(index, turns, "q", words("text"), 3, "floored")
    found = bm25.gated(found, turns.select("q", content(words("text"), _STOP).alias("content")), "q", pairs, "pos")
    return found.select("q.conv_id", "q.turn", F.col("id.conv_id").alias("pos_conv_id"), F.col("id.turn").alias("pos_turn"), "rank", F.round("score", 6).alias("score"), (F.col("score") >= 4.0).alias("hit"))


# Messages -----------------------------------------------------------------

_PREFIXES = ("【转发学生提问】", "【转发同学提问】", "【转发学生消息】", "[转发学生提问]", "【记录】", "")


@query("""
WITH m AS (SELECT conv_id, turn, list_value(' 【转发学生提问】', '【转发同学提问】 ', '【转发学生消息】', '[转发学生提问]', E'\\n【记录】', '')[1 + (conv_id + turn) % 6] || CASE WHEN turn % 7 = 6 THEN '' ELSE text END AS t FROM conversations),
p AS (SELECT *, ltrim(t, E' \\t\\n\\r') AS l FROM m),
r AS (SELECT *, CASE WHEN starts_with(l, '【记录】') THEN 'record' WHEN starts_with(l, '【转发学生提问】') OR starts_with(l, '【转发同学提问】') OR starts_with(l, '【转发学生消息】') OR starts_with(l, '[转发学生提问]') THEN 'forward' ELSE 'skip' END AS way,
  trim(regexp_replace(l, '^(【记录】|【转发学生提问】|【转发同学提问】|【转发学生消息】|\\[转发学生提问\\])', ''), E' \\t\\n\\r') AS rest FROM p)
SELECT conv_id, turn, CASE WHEN way = 'forward' AND rest = '' THEN 'skip' ELSE way END AS route, CASE WHEN way = 'skip' THEN '' ELSE rest END AS body FROM r""")
def route_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.array(*map(F.lit, (" 【转发学生提问】", "【转发同学提问】 ", "【转发学生消息】", "[转发学生提问]", "\n【记录】", "")))
    t = table(spark, sf_dir, "conversations")
    text = F.concat(F.get(marks, ((F.col("conv_id") + F.col("turn")) % 6).cast("int")), F.when(F.col("turn") % 7 == 6, "").otherwise(F.col("text")))
    return t.select("conv_id", "turn", route.route(text).alias("r")).select("conv_id", "turn", "r.route", "r.body")


_LATE, _ASKS = ("tion", "schen"), ("that", "une ", "der ")


@query("""
WITH m AS (SELECT conv_id, turn, trim(text) AS t, regexp_matches(text, 'tion|schen') AS late, regexp_matches(text, 'that|une |der ') AS asks, turn % 3 = 0 AS known FROM conversations)
SELECT conv_id, turn, CASE WHEN t = '' THEN 'unknown' WHEN late AND known THEN 'submission' WHEN late AND NOT asks THEN 'submission' WHEN asks THEN 'question' ELSE 'unknown' END AS class FROM m""")
def classify_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = route.message_class("text", _LATE, _ASKS, F.col("turn") % 3 == 0, unsure="unknown")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", told.alias("class"))


_KIND = dict(problem=r"\d{1,2}\s*[.]\s*\d{1,3}|ieren", hard=("thou", "eau"), concept=("ation", "ung"), soft=("th",), soft_patterns=(r"la[^,.]{0,10}re",))


@query(r"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '\d{1,2}\s*[.]\s*\d{1,3}|ieren') THEN 'problem' WHEN regexp_matches(text, 'thou|eau') THEN 'admin' WHEN regexp_matches(text, 'ation|ung') THEN 'concept' WHEN regexp_matches(text, 'th|la[^,.]{0,10}re') THEN 'admin' ELSE 'concept' END AS kind FROM conversations""")
def question_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", route.question_kind("text", **_KIND).alias("kind"))


# Registry -----------------------------------------------------------------


@query(r"""
SELECT doc_id, NULLIF(regexp_extract(text, '(?:^|[^\p{L}\p{N}_])([0-9]{8})(?:$|[^\p{L}\p{N}_])', 1), '') AS student_id,
       NULLIF(regexp_extract(text, '(?i)hw\s*(\d+)', 1), '') AS hw, len(regexp_extract_all(text, '\d{8,}')) AS n_long
FROM documents""")
def extract_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.student_id("text").alias("student_id"), T.first_match("text", r"(?i)hw\s*(\d+)").alias("hw"), F.regexp_count("text", F.lit(C.LONG_NUMBER)).cast("long").alias("n_long"))


@query("""
WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE lpad(CAST(o_custkey AS VARCHAR), 8, '0') END AS student_id, o_orderkey % 5 + 1 AS hw FROM orders),
r AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS id, c_mktsegment AS listed FROM customer)
SELECT o_orderkey, student_id, listed AS name, '第 ' || hw || ' 次' AS homework, CASE WHEN student_id IS NULL THEN '缺学号' WHEN listed IS NULL THEN '学号不在名单' ELSE 'OK' END AS status
FROM m LEFT JOIN r ON id = student_id""")
def roster_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    number = F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.lpad(F.col("o_custkey").cast("string"), 8, "0"))
    sent = o.select("o_orderkey", F.concat(F.lit("late "), number, F.lit(" hw "), (F.col("o_orderkey") % 5 + 1).cast("string")).alias("text"))
    roster = c.select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("student_id"), F.col("c_mktsegment").alias("name"))
    return registry.extracted(sent, roster).select("o_orderkey", "student_id", "name", "homework", "status")


@query("""
WITH e AS (SELECT *, LAG(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS before FROM events)
SELECT event_id, COALESCE(CAST(epoch(date_trunc('second', ts)) AS BIGINT) - CAST(epoch(date_trunc('second', before)) AS BIGINT) <= 86400, FALSE) AS repeated FROM e""")
def submission_dup_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.repeated_within(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts").select("event_id", "repeated")


# Masks, duplicates, audits ------------------------------------------------

_NAMES = ("Then", "eaux", "")


@query(r"""
SELECT doc_id, md5(regexp_replace(replace(replace(text, 'Then', '[学生]'), 'eaux', '[学生]'), '\d{8,}', '[学号]', 'g')) AS masked,
       CASE WHEN regexp_matches(text, '\d{8,}') THEN 'number' WHEN contains(text, 'Then') OR contains(text, 'eaux') THEN 'name' END AS reason
FROM documents""")
def pii_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, _NAMES))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.redact("text", names).cast("binary")).alias("masked"), route.personal_data("text", names).alias("reason"))


_NORMAL = r"""lower(regexp_replace(text, '[\s,，。.、!！?？;；:：''"“”‘’()（）\[\]【】{}<>《》~～\-—_*#/\\|]+', '', 'g'))"""


@query(f"SELECT doc_id, MIN(doc_id) OVER (PARTITION BY {_NORMAL}) AS first_id FROM documents")
def normalize_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A hash stands for the text, so texts are not shuffled, and it is taken once; ids are combined before they are.
    docs = kept(table(spark, sf_dir, "documents").select("doc_id", F.unhex(F.sha2(T.normal_question("text").cast("binary"), 256)).alias("normal")))
    first = docs.groupBy("normal").agg(F.min("doc_id").alias("first_id"))
    return docs.join(first, "normal").select("doc_id", "first_id")


@query(r"""
WITH n AS (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(text, '\d+(?:\.\d+)?')), lambda x: (length(x) >= 3 OR contains(x, '.')) AND NOT regexp_full_match(x, '(?:19|20)\d\d') AND NOT regexp_full_match(x, '\d{1,2}\.\d{3}')) AS nums, text FROM documents),
m AS (SELECT a.doc_id, len(a.nums) AS n_numbers, len(list_filter(a.nums, lambda x: NOT contains(b.text, x) AND x <> '103')) AS n_missing, b.doc_id AS other FROM n a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, CAST(n_numbers AS INTEGER) AS n_numbers, CAST(CASE WHEN other IS NULL THEN NULL ELSE n_missing END AS INTEGER) AS n_missing, CASE WHEN other IS NULL THEN 'no mark' WHEN n_missing = 0 THEN 'kept' ELSE 'missing' END AS state FROM m""")
def number_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("target"))
    audit = evaluate.number_audit(docs.join(after, "doc_id", "left"), "text", "target")
    return audit.select("doc_id", F.size("numbers").alias("n_numbers"), F.when(F.col("target").isNotNull(), F.size("missing")).alias("n_missing"), "state")


# Validity and ranges ------------------------------------------------------

_FACTS = [("spring", "1993-02-01", "1993-02-28"), ("open start", None, "1992-03-31"), ("open end", "1998-07-01", None), ("one day", "1995-05-05", "1995-05-05"), ("all year", "1996-01-01", "1996-12-31"), ("never", "1990-01-01", "1990-02-01")]


@query(f"""
WITH f AS ({values(_FACTS, "fact, since, until")})
SELECT o_orderkey, fact FROM orders JOIN f ON CAST(o_orderdate AS DATE) >= COALESCE(CAST(since AS DATE), DATE '0001-01-01') AND CAST(o_orderdate AS DATE) <= COALESCE(CAST(until AS DATE), DATE '9999-12-31')""")
def facts_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = rows(spark, _FACTS, "fact string, a string, b string").select("fact", F.to_date("a").alias("effective_from"), F.to_date("b").alias("effective_until"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return validity.facts_on(orders, "day", facts).select("o_orderkey", "fact")


_CHAPTERS = [(1, "one", 0, 149), (2, "two", 150, 399), (3, "three", 400, 401), (4, "four", 402, 700), (5, "overlaps", 690, 100000)]


@query(f"WITH c AS ({values(_CHAPTERS, 'no, title, low, high')}) SELECT doc_id, CAST(no AS INTEGER) AS no, title FROM documents JOIN c ON doc_id BETWEEN low AND high")
def page_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = rows(spark, _CHAPTERS, "no int, title string, low long, high long")
    return validity.in_range(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", chapters, "low", "high", 1024).select("doc_id", "no", "title")


# Logs and mining ----------------------------------------------------------


@query("""
SELECT strftime(ts, '%Y-%m') AS month, event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS total, COUNT(DISTINCT CAST(json_extract_string(props, '$.k') AS INTEGER)) AS n_keys
FROM events GROUP BY ROLLUP (strftime(ts, '%Y-%m'), event_type)""")
def log_month_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM").alias("month"), "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.rollup("month", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.count_distinct("k").alias("n_keys"))


@query("""
WITH a AS (SELECT event_type || ' ' || user_id % 50 AS text, event_type AS kind, CAST(json_extract_string(props, '$.k') AS INTEGER) < 3 AS hit, value FROM events),
t AS (SELECT kind AS grp, text, COUNT(*) AS n, COUNT(*) FILTER (hit) AS hits, MIN(value) AS low, MAX(value) AS high FROM a GROUP BY kind, text)
SELECT grp, FIRST(text ORDER BY n DESC, text) AS representative, CAST(SUM(n) AS BIGINT) AS n_asks, COUNT(*) AS n_variants, CAST(SUM(hits) AS BIGINT) AS n_hit, MIN(low) AS low, MAX(high) AS high, SUM(hits) = 0 AS is_gap
FROM t GROUP BY grp HAVING SUM(n) >= 2""")
def ask_frequency_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("grp"), F.concat_ws(" ", "event_type", (F.col("user_id") % 50).cast("string")).alias("text"), F.col("event_type").alias("kind"), (F.get_json_object("props", "$.k").cast("int") < 3).alias("faq_hit"), F.col("value").alias("top_score"))
    return mine.worth_asking(mine.candidates(e), 2, gaps_only=False).drop("kinds")


_SETS = f"sets AS (SELECT {_struct(_TURN)} AS id, list_distinct(list_filter({_WORDS.format('text')}, lambda x: NOT list_contains({list(_STOP)}, x))) AS s FROM conversations)"


@query(f"""
WITH {_SETS}, p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.s, b.s)) AS i, len(a.s) AS x, len(b.s) AS y FROM sets a JOIN sets b ON a.id < b.id AND len(a.s) > 0 AND len(b.s) > 0)
SELECT a.conv_id AS a_conv_id, a.turn AS a_turn, b.conv_id AS b_conv_id, b.turn AS b_turn, ROUND(i / (x + y - i), 6) AS similarity FROM p WHERE i / (x + y - i) >= 0.15""")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select(F.struct(*_TURN).alias("id"), content(words("text"), _STOP).alias("content"))
    return mine.similar_pairs(t, "id", "content", 0.15).select(F.col("a.conv_id").alias("a_conv_id"), F.col("a.turn").alias("a_turn"), F.col("b.conv_id").alias("b_conv_id"), F.col("b.turn").alias("b_turn"), F.round("similarity", 6).alias("similarity"))


# As a recursive query over ranked texts the rule is too slow for whole tables; tests hold it against the sequential rule.
@query()
def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select(F.struct(*_TURN).alias("id"), "text")
    return mine.groups(t, "id", "text", content(words("text"), _STOP), 0.15).select("id.conv_id", "id.turn", F.md5(F.col("grp").cast("binary")).alias("grp"))


# Evaluation ---------------------------------------------------------------


def _judged(kind: str) -> str:
    return f"""WITH {_INDEX}, {_LUCENE if kind == "lucene" else _FLOORED}, {_scored("SELECT item_id AS q, text FROM benchmark", 7)},
rel AS (SELECT q, rank, contains(d.text, b.text) AS relevant, d.lang <> 'en' AS foreign_, d.source = 'src3' AS forbidden FROM best JOIN documents d ON d.doc_id = id JOIN benchmark b ON b.item_id = q),
cases AS (SELECT item_id AS q, CAST(MIN(CASE WHEN relevant THEN rank END) AS INTEGER) AS first_rank, COUNT(*) FILTER (foreign_) AS n_foreign, COUNT(*) FILTER (forbidden) AS n_forbidden FROM benchmark LEFT JOIN rel ON q = item_id GROUP BY item_id)"""


def _cases(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    items, docs = benchmark_queries(spark, sf_dir), table(spark, sf_dir, "documents")
    hits = bm25.search(document_index(spark, sf_dir), items, "q", words("text"), 7, kind)
    hits = hits.join(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("doc"), "lang", "source"), "id").join(items, "q")
    return evaluate.judged(hits, "q", F.contains("doc", "text"), F.col("lang") != "en", F.col("source") == "src3", items.select("q"))


@query(f"""{_judged("lucene")},
v AS (SELECT *, list_filter([CASE WHEN first_rank IS NULL THEN 'no hit' END, CASE WHEN n_forbidden > 0 THEN 'forbidden source' END, CASE WHEN n_foreign > 2 THEN 'too much noise' END], lambda x: x IS NOT NULL) AS problems FROM cases)
SELECT COUNT(*) AS n_cases, COUNT(first_rank) AS n_hits, ROUND(SUM(COALESCE(1 / first_rank, 0.0)) / COUNT(*), 6) AS mrr, CAST(SUM(n_foreign) AS BIGINT) AS n_foreign, COUNT(*) FILTER (len(problems) > 0) AS n_failed FROM v""")
def eval_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary(_cases(spark, sf_dir, "lucene").withColumn("problems", evaluate.verdict(F.lit(2))))


_DIFF = f"""{_judged("lucene").replace("cases AS", "lucene_cases AS")},
f_raw AS (SELECT term, LN(n - df + 0.5) - LN(df + 0.5) AS r FROM terms, corpus), f_idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT AVG(r) FROM f_raw) ELSE r END AS idf FROM f_raw),
f_scored AS (SELECT q, p.id, SUM(times * f_idf.idf * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)))) AS score FROM asked JOIN f_idf USING (term) JOIN postings p USING (term) JOIN lengths l ON p.id = l.id, corpus GROUP BY q, p.id),
f_best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY q ORDER BY ROUND(score, 9) DESC, id) AS rank FROM f_scored) WHERE rank <= 7 AND score > 0),
f_rel AS (SELECT q, rank, contains(d.text, b.text) AS relevant, d.lang <> 'en' AS foreign_, d.source = 'src3' AS forbidden FROM f_best JOIN documents d ON d.doc_id = id JOIN benchmark b ON b.item_id = q),
floored_cases AS (SELECT item_id AS q, CAST(MIN(CASE WHEN relevant THEN rank END) AS INTEGER) AS first_rank, COUNT(*) FILTER (foreign_) AS n_foreign, COUNT(*) FILTER (forbidden) AS n_forbidden FROM benchmark LEFT JOIN f_rel ON q = item_id GROUP BY item_id),
pair AS (SELECT COALESCE(n.q, o.q) AS q, n.q AS nq, o.q AS oq, o.first_rank AS old_rank, n.first_rank, COALESCE(n.first_rank, 1 << 30) AS r, COALESCE(o.first_rank, 1 << 30) AS was, n.n_foreign AS nf, o.n_foreign AS of_, n.n_forbidden AS nb, o.n_forbidden AS ob
  FROM lucene_cases n FULL JOIN floored_cases o ON n.q = o.q)
SELECT q, old_rank, first_rank, CASE WHEN oq IS NULL THEN 'new' WHEN nq IS NULL THEN 'missing' WHEN r > was OR nf > of_ OR (nb > 0 AND ob = 0) THEN 'worse' WHEN r <> was THEN 'changed' ELSE 'same' END AS change FROM pair"""


@query(_DIFF)
def eval_regression_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, before = _cases(spark, sf_dir, "lucene"), _cases(spark, sf_dir, "floored")
    return evaluate.compared(now, before, "q")


# Corpus assembly ----------------------------------------------------------


@query("""
SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'known' WHEN regexp_matches(text, 'SS\\s*号\\s*=|Gener\\s*al\\s*I\\s*nf|页数\\s*=\\s*\\d+') THEN 'scanner data' WHEN length(trim(text)) < 60 THEN 'short' END AS reason, quality
FROM documents LEFT JOIN labels USING (doc_id)""")
def corpus_scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", route.skip_reason("source", "text", known=("src1", "src2")).alias("reason"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("""
WITH r AS (SELECT md5(text) AS key, doc_id, CAST(dense_rank() OVER (ORDER BY source NULLS LAST) AS INTEGER) AS origin FROM documents)
SELECT key, MIN(doc_id) AS doc_id, origin FROM r WHERE origin = (SELECT MIN(origin) FROM r b WHERE b.key = r.key) GROUP BY key, origin""")
def source_precedence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("key"))
    names = docs.select("source").distinct().withColumn("origin", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))))  # a row for each source
    docs = docs.join(names.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    return assemble.first_origin(docs, "key", "origin").groupBy("key", "origin").agg(F.min("doc_id").alias("doc_id")).select("key", "doc_id", "origin")


@query("""
WITH o AS (SELECT doc_id, CASE WHEN quality = 1 THEN '【中文详细解析】 ' || text ELSE text END AS text FROM documents JOIN labels USING (doc_id))
SELECT n.doc_id, md5(CASE WHEN contains(o.text, '【中文详细解析】') THEN o.text ELSE n.text END) AS text, CASE WHEN contains(o.text, '【中文详细解析】') THEN 'kept' ELSE 'written' END AS outcome
FROM documents n LEFT JOIN o USING (doc_id)""")
def guarded_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The old corpus: documents with a label, those of good quality worked on already.
    new = table(spark, sf_dir, "documents").select("doc_id", "text")
    mark = "【中文详细解析】"
    done = F.when(F.col("quality") == 1, F.concat(F.lit(f"{mark} "), "text")).otherwise(F.col("text"))
    old = new.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").select("doc_id", done.alias("text"))
    return assemble.guarded(new, old, "doc_id", mark).withColumn("text", F.md5(F.col("text").cast("binary")))


@query("""
SELECT a.doc_id, b.doc_id AS appendix FROM documents a
LEFT JOIN (SELECT source, doc_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS r FROM documents WHERE lang <> 'en') WHERE r = 1) b ON a.source = b.source""")
def appendix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every document, with the longest foreign one of its source.
    docs = table(spark, sf_dir, "documents")
    other = docs.where("lang <> 'en'").groupBy("source").agg(F.max(F.struct("n_chars", "doc_id"))["doc_id"].alias("body"))
    return assemble.with_appendix(docs.select("doc_id", "source"), other, "source").select("doc_id", "appendix")


@query("""
WITH j AS (SELECT doc_id, left(sha1('v1' || chr(0) || source || chr(0) || text), 16) AS key FROM documents)
SELECT doc_id, key FROM j WHERE key NOT IN (SELECT key FROM j JOIN labels USING (doc_id) WHERE quality = 1)""")
def jobs_not_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The cache: what has a label; results of bad quality are empty.
    jobs = table(spark, sf_dir, "documents").select("doc_id", T.content_key(F.lit("v1"), "source", "text").alias("key"))
    told = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "done").otherwise("").alias("text"))
    return assemble.not_done(jobs, jobs.join(told, "doc_id").select("key", "text")).select("doc_id", "key")


_NOTICES = (r"(?s)This work is licensed.{0,60}?version \d\.", r"Released under the MIT License\.")


@query(r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(translate(t, chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g'), '^\s+|\s+$', '', 'g')) AS cleaned, t <> text AS changed
FROM (SELECT doc_id, text, regexp_replace(regexp_replace(text, '(?s)This work is licensed.{0,60}?version \d\.', '', 'g'), 'Released under the MIT License\.', '', 'g') AS t FROM documents)""")
def boilerplate_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    removed = F.regexp_replace(F.regexp_replace("text", _NOTICES[0], ""), _NOTICES[1], "")
    return docs.select("doc_id", F.md5(T.strip_boilerplate("text", _NOTICES, r"Copyright\s*©").cast("binary")).alias("cleaned"), (removed != F.col("text")).alias("changed"))


# Pages and graphs ---------------------------------------------------------


@query(r"""
SELECT page_id, length(html) AS size, len(regexp_extract_all(html, '(?i)<h[1-4][\s>]')) AS n_headings, len(regexp_extract_all(html, '(?i)<a\s[^>]*href=')) AS n_links, len(regexp_extract_all(html, '(?i)<img[\s>]')) AS n_images, len(regexp_extract_all(html, '(?i)<tr[\s>]')) AS n_rows, len(regexp_extract_all(html, '(?i)<p[\s>]')) AS n_paragraphs FROM pages""")
def html_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = html.statistics(table(spark, sf_dir, "pages"))
    return stats.select("page_id", *(F.col(c).cast("long").alias(c) for c in stats.columns[1:]))


@query()
def html_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_structure(table(spark, sf_dir, "pages"))


@query("""
WITH s AS (SELECT source, COUNT(*) AS n, CAST(SUM(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source)
SELECT source, n, chars, ROUND(chars / SUM(chars) OVER (), 6) AS share, ROUND(n / MAX(n) OVER (), 6) AS of_largest FROM s""")
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return s.withColumns({"share": F.round(evaluate.share("chars"), 6), "of_largest": F.round(evaluate.of_largest("n"), 6)})


# The planner, and streams -------------------------------------------------


@query(f"""
WITH {_FAQ_HITS},
k AS (SELECT {_struct(_TURN)} AS id, CASE WHEN regexp_matches(text, '\\d{{1,2}}\\s*[.]\\s*\\d{{1,3}}|ieren') THEN 'problem' WHEN regexp_matches(text, 'thou|eau') THEN 'admin' WHEN regexp_matches(text, 'ation|ung') THEN 'concept' WHEN regexp_matches(text, 'th|la[^,.]{{0,10}}re') THEN 'admin' ELSE 'concept' END AS kind, text FROM conversations WHERE role = 'user'),
h AS (SELECT q, MAX(score) AS faq_top FROM gated GROUP BY q),
j AS (SELECT k.*, faq_top, COALESCE(faq_top >= 4.0, FALSE) AS faq_hit FROM k LEFT JOIN h ON q = id),
d_tokens AS (SELECT doc_id AS id, {_WORDS.format("text")} AS w FROM documents),
d_postings AS (SELECT id, term, COUNT(*) AS tf FROM (SELECT id, UNNEST(w) AS term FROM d_tokens) GROUP BY id, term),
d_lengths AS (SELECT id, len(w) AS dl FROM d_tokens), d_corpus AS (SELECT COUNT(*) AS n, AVG(dl) AS avgdl FROM d_lengths),
d_idf AS (SELECT term, LN(1 + (n - COUNT(*) + 0.5) / (COUNT(*) + 0.5)) AS idf FROM d_postings, d_corpus GROUP BY term, n),
d_asked AS (SELECT q, term, COUNT(*) AS times FROM (SELECT id AS q, UNNEST({_WORDS.format("text")}) AS term FROM j WHERE NOT (faq_hit AND kind = 'admin')) GROUP BY q, term),
d_scored AS (SELECT q, p.id, SUM(times * idf * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)))) AS score FROM d_asked JOIN d_idf USING (term) JOIN d_postings p USING (term) JOIN d_lengths l ON p.id = l.id, d_corpus GROUP BY q, p.id),
d_best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY q ORDER BY ROUND(score, 9) DESC, id) AS rank FROM d_scored) WHERE rank <= 7 AND score > 0),
d_hits AS (SELECT q, COUNT(*) AS n_hits, MAX(d_best.score) AS top_score, string_agg(source, ',' ORDER BY rank) AS sources FROM d_best JOIN documents ON doc_id = d_best.id GROUP BY q)
SELECT id.conv_id AS conv_id, id.turn AS turn, kind, faq_hit, CASE WHEN faq_hit AND kind = 'admin' THEN 'faq' ELSE 'rag' END AS path, COALESCE(n_hits, 0) AS n_hits, ROUND(top_score, 6) AS top_score,
       COALESCE(list_count(list_distinct(string_split(d_hits.sources, ','))), 0) + CASE WHEN faq_hit AND kind <> 'problem' THEN 1 ELSE 0 END + CASE WHEN kind = 'admin' THEN 1 ELSE 0 END AS n_sources
FROM j LEFT JOIN d_hits ON q = id""")
def qa_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import qa

    pairs, index, turns = _faq(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    known = qa.Knowledge(pairs, index, docs, document_index(spark, sf_dir), "- fact", ("facts",))
    planned = qa.plan(turns.withColumnRenamed("q", "id"), known, words("text"), content(words("text"), _STOP), route.question_kind("text", **_KIND))
    return planned.select("id.conv_id", "id.turn", "kind", "faq_hit", "path", "n_hits", F.round("top_score", 6).alias("top_score"), F.size("sources").cast("long").alias("n_sources"))


@query("""
SELECT date_trunc('day', ts) AS day, event_type AS kind, COUNT(*) AS n FROM events WHERE NOT (CAST(json_extract_string(props, '$.k') AS INTEGER) < 50) GROUP BY ALL""")
def stream_gap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from ..runtime import shared_dir

    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    asks = stream.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), (F.get_json_object("props", "$.k").cast("int") < 50).alias("faq_hit"))
    # Counts as they change go to a table, batch by batch; the last of each day and kind holds.
    folder = f"{shared_dir(spark)}/streams/gaps-{uuid.uuid4().hex}"
    messages.written(messages.gap_counts(asks), f"{folder}/rows", f"{folder}/state", "update", availableNow=True).awaitTermination()
    return messages.latest(spark, f"{folder}/rows", ["day", "kind"]).select(F.col("day").cast("timestamp_ntz").alias("day"), "kind", "n")


@query("""
WITH e AS (SELECT *, LAG(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS before FROM events)
SELECT event_id, COALESCE(CAST(epoch(date_trunc('second', ts)) AS BIGINT) - CAST(epoch(date_trunc('second', before)) AS BIGINT) <= 3600, FALSE) AS repeated FROM e""")
def stream_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from ..runtime import shared_dir

    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = stream.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    folder = f"{shared_dir(spark)}/streams/repeats-{uuid.uuid4().hex}"
    messages.written(messages.repeated_within(rows, ["user_id", "event_type"], seconds=3600), f"{folder}/rows", f"{folder}/state", availableNow=True).awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("event_id", "repeated")
