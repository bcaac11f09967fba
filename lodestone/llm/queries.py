"""The queries of this subpackage and the SQL that says the same, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .boosting import learn, score

    docs = _table(spark, sf_dir, "documents")
    return score(docs, learn(docs, _table(spark, sf_dir, "labels")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .outliers import judge

    return judge(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    shards = shard_by_bytes(_table(spark, sf_dir, "documents"))
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .recompression import remove_repeats

    kept = remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .signature_tree import link_documents

    return link_documents(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_to_weights

    return mix_to_weights(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .idcodec import read_ids, write_ids

    folder = write_ids(_table(spark, sf_dir, "documents"), tokenizer_path())
    return read_ids(spark, folder, digest=True)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import PAGES, archive_pages, pages_of, read_archives

    pages = _table(spark, sf_dir, "pages")
    return pages_of(read_archives(spark, archive_pages(pages), PAGES), pages.schema["page_id"].dataType.simpleString())


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    own = (op1_quality_classifier, op2_quality_rules, op3_token_counts, op4_sharding, op5_packing, op6_substring_dedup, op7_nearest_neighbours, op8_ngram_jaccard, op9_mixing, op10_token_binary, op11_embedding_whitening, op12_warc, op13_collocations)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op6_substring_dedup": OP6, "op8_ngram_jaccard": OP8, "op9_mixing": OP9, "op12_warc": OP12, "op13_collocations": OP13}


OP6 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
places AS (SELECT doc_id, ws, UNNEST(range(1, len(ws) - 48)) AS s FROM w WHERE len(ws) >= 50),
windows AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 49], ' ')) AS h FROM places),
least AS (SELECT h, MIN(doc_id) AS first_id FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, UNNEST(range(s, s + 50)) AS k FROM windows JOIN least USING (h) WHERE doc_id > first_id),
words AS (SELECT doc_id, UNNEST(ws) AS word, UNNEST(range(1, len(ws) + 1)) AS k FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text, COUNT(*) AS n FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - COALESCE(n, 0) AS BIGINT) AS n_removed, sha256(COALESCE(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[s:s + 3], ' ') AS h FROM (SELECT doc_id, ws, UNNEST(range(1, greatest(len(ws) - 3, 1) + 1)) AS s FROM w WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, COUNT(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS i FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT d.doc_id, COALESCE(n, 0) AS n_shingles, MIN(b) AS component_id FROM documents d JOIN reach ON a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id, n
"""


OP9 = r"""
WITH sized AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS shuffled,
         CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS source_size,
         list_value(5, 2, 1)[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 3 * source_size AS cap,
         CAST(SUM(source_size) OVER () - COALESCE(SUM(3 * source_size) OVER f, 0) AS DOUBLE)
           / (SUM(weight) OVER () - COALESCE(SUM(weight) OVER f, 0)) AS level
  FROM sources
  WINDOW f AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, LEAST(CAST(cap AS DOUBLE), MAX(level) OVER () * weight) AS target FROM levels),
queues AS (
  SELECT s.doc_id, s.size, s.shuffled, t.source_size, t.target,
         SUM(s.size) OVER (PARTITION BY s.source ORDER BY s.shuffled NULLS FIRST, s.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT doc_id, size, shuffled, k, (CAST(source_size * k + upto AS DOUBLE) - size / 2.0) / target AS time
  FROM queues, (SELECT unnest([0, 1, 2]) AS k) WHERE size > 0 AND target > 0),
ranked AS (
  SELECT doc_id, size, k, time,
         SUM(size) OVER (ORDER BY time, shuffled NULLS FIRST, size, k ROWS UNBOUNDED PRECEDING) AS upto
  FROM copies WHERE time < 2),
taken AS (
  SELECT doc_id, COUNT(*) AS n FROM ranked WHERE upto - size / 2.0 <= (SELECT SUM(size) FROM sized) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * COALESCE(t.n, 0) AS BIGINT) AS taken
FROM queues q LEFT JOIN taken t USING (doc_id)
"""


OP12 = r"""
WITH p AS (SELECT page_id, CAST(strlen(COALESCE(html, '')) AS BIGINT) AS payload_bytes, sha256(COALESCE(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, MIN(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND COALESCE(page_id > first_id, first_id IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND COALESCE(page_id > first_id, first_id IS NOT NULL) THEN first_id END AS refers_to
FROM f
"""

OP13 = r"""
WITH pieces AS (
  SELECT COALESCE(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
  FROM (SELECT lang, UNNEST(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, CAST(SUM(len(ws)) AS BIGINT) AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, ws[s:s + m - 1] AS p FROM (
    SELECT lang, ws, m, UNNEST(range(1, len(ws) - m + 2)) AS s FROM pieces, (SELECT UNNEST([1, 2, 3, 4, 5]) AS m) WHERE len(ws) >= m)),
f AS (SELECT lang, p, COUNT(*) AS a FROM grams GROUP BY lang, p HAVING COUNT(*) >= 100),
cuts AS (SELECT lang, p, a, UNNEST(range(1, len(p))) AS k FROM f WHERE len(p) >= 2),
scored AS (
  SELECT c.lang, c.p, c.a, c.k, x.a AS l, y.a AS r, n, CAST(1000 AS HUGEINT) * c.a * n // (CAST(x.a AS HUGEINT) * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:len(c.p)] JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, p[i:j] AS p, MAX(a) AS longer FROM (SELECT lang, p, a, i, UNNEST(range(i, len(p) + 1)) AS j FROM (SELECT lang, p, a, UNNEST(range(1, len(p) + 1)) AS i FROM f)) WHERE j - i + 1 < len(p) GROUP BY ALL),
ranked AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, w.a, l, r, n, CAST(score AS BIGINT) AS score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, w.a DESC, array_to_string(p, ' ')) AS rank
  FROM lowest w LEFT JOIN inner_parts i USING (lang, p) WHERE i.longer IS NULL OR 100 * i.longer < 100 * w.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
