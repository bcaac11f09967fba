"""More registered queries: dictionaries, registers of names, graphs, numbering, errors as rows, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import diagrams, lattice, names
from ..functions.tokenize import words
from ..operators import graph
from ..runtime import kept, numbered
from . import catalogue
from .catalogue import _WORDS, query, table

# Words of long words --------------------------------------------------------

#: Signs of the longest entry, and occurrences of the rarest, in the dictionary of the query.
_LONGEST, _LEAST = 6, 20


@query(f"""
WITH RECURSIVE told AS (SELECT UNNEST({_WORDS.format("text")}) AS word FROM documents),
counts AS (SELECT word, COUNT(*) AS n FROM told GROUP BY word),
dictionary AS (SELECT word, n FROM counts WHERE length(word) <= {_LONGEST} AND n >= {_LEAST}),
total AS (SELECT SUM(n) AS total FROM dictionary),
costs AS (SELECT word, CAST(ROUND(1000000 * (LN(total) - LN(n))) AS BIGINT) AS cost FROM dictionary, total),
unknown AS (SELECT CAST(ROUND(1000000 * LN(total)) AS BIGINT) AS cost FROM total),
places AS (SELECT word, length(word) AS n, k, UNNEST(range(1, length(word) - k + 2)) AS i FROM counts, range(1, {_LONGEST + 1}) s(k) WHERE k <= length(word)),
found AS (SELECT p.word, p.n - i + 1 AS rest, k, COALESCE(c.cost, u.cost) AS cost FROM places p LEFT JOIN costs c ON c.word = substr(p.word, i, k), unknown u WHERE c.cost IS NOT NULL OR k = 1),
edges AS (SELECT word, rest, list(struct_pack(cost := cost, k := k)) AS e FROM found GROUP BY word, rest),
path AS (
  SELECT word, 0 AS rest, [0::BIGINT] AS best, ['']::VARCHAR[] AS cut FROM counts
  UNION ALL
  SELECT word, rest, list_append(best, c.cost), list_append(cut, substr(word, length(word) - rest + 1, -c.k) || CASE WHEN rest + c.k > 0 THEN ' ' || cut[rest + c.k + 1] ELSE '' END)
  FROM (SELECT p.word, e.rest, best, cut, list_sort(list_transform(e.e, lambda x: struct_pack(cost := x.cost + best[e.rest - x.k + 1], k := -x.k)))[1] AS c FROM path p JOIN edges e ON e.word = p.word AND e.rest = p.rest + 1))
SELECT word, cut[rest + 1] AS pieces, best[rest + 1] AS cost FROM path WHERE rest = length(word)""")
def lattice_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Long words of these texts are put together from short ones: all words are cut by a dictionary of the short frequent ones.
    told = kept(table(spark, sf_dir, "documents").select(F.explode(words("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    dictionary = told.where((F.length("word") <= _LONGEST) & (F.col("n") >= _LEAST))
    cut = lattice.tokenizer(dictionary, every_run=True)
    costs = lattice.costs(dictionary)
    pieces = kept(told.select("word", cut("word").alias("p")))
    unknown = costs.agg(F.max("unknown").alias("u"))  # one row
    paid = pieces.select("word", F.explode("p").alias("piece")).join(costs.select(F.col("word").alias("piece"), "cost"), "piece", "left").crossJoin(F.broadcast(unknown))
    paid = paid.groupBy("word").agg(F.sum(F.coalesce("cost", "u")).alias("cost"))
    return pieces.select("word", F.array_join("p", " ").alias("pieces")).join(paid, "word")


# A register of names ----------------------------------------------------------


@query(f"""
WITH told AS (SELECT UNNEST({_WORDS.format("text")}) AS word FROM documents),
register AS (SELECT DISTINCT word AS name FROM told WHERE length(word) IN (7, 11)),
spots AS (SELECT doc_id, substr(t, i, k) AS name FROM (SELECT doc_id, lower(text) AS t, UNNEST(range(1, length(text) + 1)) AS i FROM documents), (SELECT UNNEST([7, 11]) AS k)),
held AS (SELECT DISTINCT doc_id, name FROM spots JOIN register USING (name))
SELECT doc_id, COUNT(*) AS n_names, MIN(name) AS first_name FROM held GROUP BY doc_id""")
def register_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The register: all words of seven and eleven letters, tens of thousands; they count inside longer words too.
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    listed = docs.select(F.explode(words("text")).alias("name")).where(F.length("name").isin(7, 11)).distinct()
    found = names.find(docs, "doc_id", "text", names.register(listed.withColumn("no", F.xxhash64("name"))))
    return found.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n_names"), F.min("name").alias("first_name"))


# A graph with cycles ------------------------------------------------------------

# Customers in rows of eight and groups of three rows: each leads to the next of its row, the first of a row to that of the next row,
# and some lead back, as far as their nation's number tells.
_GRAPH = """
edges AS (
  SELECT c_custkey AS src, c_custkey + 1 AS dst FROM customer WHERE c_custkey % 8 < 7
  UNION SELECT c_custkey, c_custkey + 8 FROM customer WHERE c_custkey % 8 = 0 AND c_custkey // 8 % 3 < 2
  UNION SELECT c_custkey, c_custkey - c_nationkey % 8 FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 8 >= c_nationkey % 8),
reach AS (SELECT src AS a, dst AS b FROM edges UNION SELECT a, dst FROM reach JOIN edges ON b = src),
nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
components AS (
  SELECT node, LEAST(node, COALESCE(MIN(x.b), node)) AS component
  FROM nodes LEFT JOIN (SELECT r.a, r.b FROM reach r JOIN reach s ON r.a = s.b AND r.b = s.a) x ON x.a = node GROUP BY node)"""


def _customer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), (F.col("c_nationkey") % 8).alias("back"))
    place = F.col("src") % 8
    along = c.where(place < 7).select("src", (F.col("src") + 1).alias("dst"))
    down = c.where((place == 0) & (F.expr("src div 8") % 3 < 2)).select("src", (F.col("src") + 8).alias("dst"))
    back = c.where((F.col("src") % 5 == 0) & (place >= F.col("back"))).select("src", (F.col("src") - F.col("back")).alias("dst"))
    return along.unionByName(down).unionByName(back)


@query(f"""
WITH RECURSIVE {_GRAPH},
between AS (SELECT DISTINCT a.component AS src, b.component AS dst FROM edges JOIN components a ON a.node = src JOIN components b ON b.node = dst WHERE a.component <> b.component),
walk AS (SELECT DISTINCT component, 0 AS layer FROM components UNION SELECT dst, layer + 1 FROM walk JOIN between ON src = component)
SELECT node, c.component, CAST(layer AS INTEGER) AS layer FROM components c JOIN (SELECT component, MAX(layer) AS layer FROM walk GROUP BY component) l ON l.component = c.component""")
def component_layers_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.component_layers(_customer_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {_GRAPH} SELECT DISTINCT src, dst, a.component FROM edges JOIN components a ON a.node = src JOIN components b ON b.node = dst WHERE a.component = b.component")
def cyclic_edges_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _customer_edges(spark, sf_dir)
    return graph.cyclic_edges(edges, graph.strong_components(edges))


# Numbers, and diagrams ------------------------------------------------------------


@query("SELECT doc_id, CAST(ROW_NUMBER() OVER (ORDER BY source NULLS FIRST, lang NULLS FIRST, doc_id) - 1 AS BIGINT) AS number FROM documents")
def numbered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "lang", "doc_id")
    return numbered(docs, ["source", "lang", "doc_id"]).select("doc_id", "number")


_LINES = """
lines AS (
  SELECT l_orderkey AS id, l_partkey % 7 AS p, l_suppkey % 5 AS s, CAST(l_quantity AS INTEGER) AS q, l_linenumber AS place, l_returnflag AS flag FROM lineitem),
numbered AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY id ORDER BY place, p, s, q, flag) - 1 AS INTEGER) AS no FROM lines)"""


def _order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown text for each order: its lines as links of a flowchart; those of every ninth order end in the middle of one."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", (F.col("l_partkey") % 7).alias("p"), (F.col("l_suppkey") % 5).alias("s"), F.col("l_quantity").cast("int").alias("q"), F.col("l_returnflag").alias("flag"))
    each = line.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "p", "s", "q", "flag"))).alias("l"))  # the lines of an order
    text = F.transform("l", lambda x: F.concat(F.lit("P"), x["p"].cast("string"), F.lit('["part --'), x["p"].cast("string"), F.lit('"]'), F.when(x["flag"] == "R", " -.->|").otherwise(" -->|"), x["q"].cast("string"), F.lit("| S"), x["s"].cast("string")))
    broken = F.when(F.col("id") % 9 == 0, "\nP1 -->").otherwise("")
    chart = F.concat(F.lit("# order\n```\n:::no block\n```\n:::note of the order\ninside\n:::\n```mermaid\n%% caption: order "), F.col("id").cast("string"), F.lit("\nflowchart LR\n"), F.array_join(text, "\n"), broken, F.lit("\n```\n"))
    return each.select("id", chart.alias("text"))


@query(f"""
WITH {_LINES}
SELECT id, no, 'P' || p AS src, 'S' || s AS dst, CAST(q AS VARCHAR) AS label, flag = 'R' AS dashed, NULL AS error FROM numbered WHERE id % 9 <> 0
UNION ALL SELECT DISTINCT id, NULL, NULL, NULL, NULL, NULL, 'line ' || (2 + 1 + COUNT(*) OVER (PARTITION BY id)) || ': out of place: the end of the line' FROM numbered WHERE id % 9 = 0""")
def flowcharts_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = diagrams.marked_blocks(_order_documents(spark, sf_dir), "id", "text").where("kind = 'mermaid'")
    charts = diagrams.flowcharts(blocks, "id", "body")
    links = F.transform("edges", lambda e: F.struct(e["no"].alias("no"), e["src"].alias("src"), e["dst"].alias("dst"), e["label"].alias("label"), e["dashed"].alias("dashed"), F.col("error").alias("error")))
    fault = F.expr("array(named_struct('no', int(NULL), 'src', string(NULL), 'dst', string(NULL), 'label', string(NULL), 'dashed', boolean(NULL), 'error', error))")
    return charts.select("id", F.inline(F.when(F.col("error").isNull(), links).otherwise(fault)))


@query("""
SELECT DISTINCT l_orderkey AS id, no, kind, args, line FROM lineitem,
  (SELECT * FROM (VALUES (0, 'note', 5), (1, 'mermaid', 8)) b(no, kind, line)) b, LATERAL (SELECT CASE WHEN kind = 'note' THEN 'of the order' ELSE 'order ' || l_orderkey END AS args)""")
def blocks_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagrams.marked_blocks(_order_documents(spark, sf_dir), "id", "text").select("id", "no", "kind", "args", "line")


assert catalogue.QUERIES
