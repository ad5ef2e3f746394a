"""The driver's tables in the shape of a document base, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_heading, is_pipe_row


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each document; its source decides on clearance and liveness, its language is the department."""
    number = F.substring("source", 4, 9).cast("int")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"), F.col("source").alias("source_file"), F.col("lang").alias("department"),
        (number % 4).alias("secret_level"), (number == 19).alias("is_deleted"), (number == 18).alias("is_deprecated"), F.lit(None).cast("string").alias("raw_table"), F.lit(False).alias("table_complex"),
    )


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that have a vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    return chunks(spark, sf_dir).join(vectors, "chunk_id")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50, as a query."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a question, with the vector of its number."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return table(spark, sf_dir, "benchmark").join(vectors, "item_id").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), "embedding")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document that isn't blank as a block; ten lines make a page."""
    rows = lines(spark, sf_dir).where(F.trim("line") != "")
    kind = F.when(is_pipe_row(F.col("line")), "table").when(is_heading(F.col("line")), "heading").otherwise("paragraph")
    return rows.select(
        F.col("doc_id").alias("document_id"), F.col("line_no").alias("pos"), kind.alias("kind"), F.col("line").alias("text"), F.floor(F.col("line_no") / 10).cast("int").alias("page"),
        F.when(kind == "table", F.col("line")).alias("raw_table"), F.lit(False).alias("table_complex"),
    )


#: Views that the oracles below share.
SQL = r"""
    chunks AS (
        SELECT doc_id AS chunk_id, text AS content, source AS source_file, lang AS department, CAST(substr(source, 4) AS INTEGER) % 4 AS secret_level,
               CAST(substr(source, 4) AS INTEGER) = 19 AS is_deleted, CAST(substr(source, 4) AS INTEGER) = 18 AS is_deprecated
        FROM documents
    ), embedded AS (SELECT c.*, e.embedding, e.label FROM chunks c JOIN embeddings e ON e.vec_id = c.chunk_id),
    lines AS (
        SELECT doc_id, CAST(unnest(range(len(parts))) AS INTEGER) AS line_no, unnest(parts) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
    ), blocks AS (
        SELECT doc_id AS document_id, line_no AS pos, CAST(line_no // 10 AS INTEGER) AS page, line AS text,
               CASE WHEN length(line) - length(replace(line, '|', '')) >= 2 THEN 'table'
                    WHEN length(trim(line)) <= 40 AND NOT contains('。！？；;.!?，,：:', right(trim(line), 1)) THEN 'heading' ELSE 'paragraph' END AS kind
        FROM lines WHERE trim(line) <> ''
    ), vhits AS (
        SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
        FROM (SELECT q.vec_id AS query_id, c.chunk_id, round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
              FROM embedded c, embeddings q WHERE q.vec_id % 50 = 0 AND NOT c.is_deleted AND NOT c.is_deprecated)
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 20
    ), words AS (
        SELECT chunk_id, token, count(*) AS tf FROM (SELECT chunk_id, unnest(string_split_regex(lower(content), '[^\p{L}\p{N}_]+')) AS token FROM chunks WHERE NOT is_deleted AND NOT is_deprecated) WHERE token <> '' GROUP BY 1, 2
    ), asked AS (
        SELECT query_id, token, count(*) OVER (PARTITION BY query_id) AS n
        FROM (SELECT DISTINCT item_id AS query_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}_]+')) AS token FROM benchmark) WHERE token <> ''
    ), lhits AS (
        SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
        FROM (SELECT query_id, chunk_id, round(sum(tf / (tf + 1)) / any_value(n), 6) AS score FROM words JOIN asked USING (token) GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 20
    ), qhits AS (
        SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
        FROM (SELECT b.item_id AS query_id, c.chunk_id, round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
              FROM embedded c, embeddings q JOIN benchmark b ON b.item_id = q.vec_id WHERE NOT c.is_deleted AND NOT c.is_deprecated)
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 20
    ), fused AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first_list, first_rank, chunk_id) AS INTEGER) AS rank
        FROM (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, CAST(min(list_no) AS INTEGER) AS first_list, arg_min(rank, list_no) AS first_rank, arg_min(score, list_no) AS score
              FROM (SELECT 0 AS list_no, * FROM lhits UNION ALL SELECT 1, * FROM qhits) GROUP BY 1, 2)
    ), filled AS (
        SELECT f.query_id, f.chunk_id, coalesce(v.score, f.score) AS score, v.score AS vector_score, CASE WHEN v.score IS NULL THEN f.score END AS lexical_score, f.rank
        FROM fused f LEFT JOIN qhits v USING (query_id, chunk_id)
    ), first_hits AS (
        SELECT h.query_id, q.label, min(CASE WHEN e.label = q.label AND h.chunk_id <> h.query_id THEN h.rank END) AS rank
        FROM vhits h JOIN embeddings e ON e.vec_id = h.chunk_id JOIN embeddings q ON q.vec_id = h.query_id GROUP BY 1, 2
    )
"""
