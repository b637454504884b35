"""The contract queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygrid.llm import html_extract, language, lm_score, quality
from skygrid.llm.common import held_out
from skygrid.llm.fingerprint import edited_fingerprints
from skygrid.llm.line_dedup import dedup_lines
from skygrid.llm.mixing import mix_sources
from skygrid.llm.near_dedup import near_duplicates
from skygrid.llm.packing import pack_documents
from skygrid.llm.topk import exact_top_k


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary the packing query counts with; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs, min_docs=3, min_chars=20)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT doc_id, pos, line, (top IS NOT NULL AND doc_id <> top) AS dropped FROM keyed LEFT JOIN common USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INTEGER)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~held_out()))
    out = language.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is the benchmark's texts, the background all documents."""
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


OP5_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words
), classes AS (
  SELECT min(doc_id) AS rep, list_sort(s) AS s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY 2, 3
), shingles AS (
  SELECT rep, n, unnest(s) AS x FROM classes
), links AS (
  SELECT a.rep AS a, b.rep AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.rep <> b.rep
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT rep AS a, rep AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), component AS (
  SELECT a, min(b) AS least FROM reach GROUP BY a
)
SELECT doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(least, doc_id) AS component_id, coalesce(least, doc_id) = doc_id AS kept
FROM sets s LEFT JOIN classes c ON len(s.s) > 0 AND list_sort(s.s) = c.s LEFT JOIN component ON c.rep = component.a
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    out = quality.scores(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


OP7_SQL = """
WITH part AS (
  SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), whole AS (
  SELECT vec_id, i, CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT) AS x FROM part
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source gets the same share of as many rows as there are."""
    return mix_sources(table(spark, sf_dir, "documents"), temperature=0.0, seed=17)


OP9_SQL = """
WITH RECURSIVE counts AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), rates AS (
  SELECT source, CAST((SELECT count(*) FROM documents) AS DOUBLE) * 1.0 / (SELECT CAST(count(*) AS DOUBLE) FROM counts) / n AS rate FROM counts
), parts AS (
  SELECT source, rate / greatest(ceil(rate / 16), 1) AS r, CAST(greatest(ceil(rate / 16), 1) AS BIGINT) AS parts FROM rates
), terms AS (
  SELECT source, r, parts, 0 AS k, exp(-r) AS p, exp(-r) AS c FROM parts
  UNION ALL
  SELECT source, r, parts, k + 1, p * r / (k + 1), c + p * r / (k + 1) FROM terms WHERE k < 96
), tables AS (
  SELECT source, parts, list(c ORDER BY k) AS cdf FROM terms GROUP BY source, parts
), draws AS (
  SELECT d.*, t.cdf, unnest(generate_series(1, t.parts)) AS j FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source
), counted AS (
  SELECT doc_id, text, lang, source, n_chars,
         CAST(sum(len(list_filter(cdf, lambda c: c <= CAST(CAST('0x' || md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || j)[1:13] AS BIGINT) AS DOUBLE) / 4503599627370496.0))) AS BIGINT) AS n
  FROM draws GROUP BY doc_id, text, lang, source, n_chars
)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(generate_series(1, n)) AS INTEGER) AS copy FROM counted WHERE n > 0
"""

def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_packing": op2_packing,
    "op3_language": op3_language,
    "op4_lm_score": op4_lm_score,
    "op5_near_dedup": op5_near_dedup,
    "op6_quality": op6_quality,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_fingerprint": op8_fingerprint,
    "op9_mixing": op9_mixing,
    "op10_html_extract": op10_html_extract,
}
ORACLE_SQL = {"op1_line_dedup": OP1_SQL, "op5_near_dedup": OP5_SQL, "op7_exact_top_k": OP7_SQL, "op9_mixing": OP9_SQL}
