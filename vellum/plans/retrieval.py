"""Queries of search and of its measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, norm
from ..operators import metrics as M
from ..operators.access import Access, scope_of
from ..operators.cells import cell_topk, fit_cells, index_cells
from ..operators.search import backfill, brief, context, fuse, lexical_topk, rerank, retrieve, vector_topk
from .corpus import SQL, chunks, embedded, questions, table, vector_queries

READER = Access(("en", "fr"), 2)
SOFT = Access(("en", "fr"), 2, soft=True)
TOP = 20


def acl_hard(spark, d) -> DataFrame:
    return READER.visible(chunks(spark, d)).select("chunk_id", "department", "secret_level")


def acl_soft_weight(spark, d) -> DataFrame:
    return SOFT.visible(chunks(spark, d)).select("chunk_id", "department", "weight")


def scope_rule(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("lang").distinct().select("lang", F.array_join(scope_of(F.col("lang")), ",").alias("scope"))


def vector_hits(spark, d, access: Access = Access()) -> DataFrame:
    return vector_topk(embedded(spark, d), vector_queries(spark, d), TOP, access)


def vector_topk_soft(spark, d) -> DataFrame:
    return vector_hits(spark, d, SOFT)


def lexical_hits(spark, d) -> DataFrame:
    return lexical_topk(chunks(spark, d), questions(spark, d), TOP)


def _lists(spark, d) -> tuple[DataFrame, DataFrame]:
    vector = vector_topk(embedded(spark, d), questions(spark, d), TOP)
    return lexical_hits(spark, d).withColumn("list_no", F.lit(0)).unionByName(vector.withColumn("list_no", F.lit(1))), vector


def hybrid_rrf(spark, d) -> DataFrame:
    return fuse(_lists(spark, d)[0]).select("query_id", "chunk_id", "rrf", "rank")


def rrf_first_seen(spark, d) -> DataFrame:
    return fuse(_lists(spark, d)[0]).select("query_id", "chunk_id", "first_list", "first_rank", "score")


def rrf_score_backfill(spark, d) -> DataFrame:
    lists, vector = _lists(spark, d)
    return backfill(fuse(lists), vector).select("query_id", "chunk_id", "score", "vector_score", "lexical_score", "rank")


def reranked(spark, d) -> DataFrame:
    hits = lexical_hits(spark, d)
    texts = hits.join(questions(spark, d).select("query_id", "question"), "query_id").join(chunks(spark, d).select("chunk_id", "content"), "chunk_id")
    return rerank(texts).select("query_id", "chunk_id", "rerank_score", "candidate_rank", "rank")


def retrieval_stages(spark, d) -> DataFrame:
    """Search as a whole, candidates and final hits, for a reader."""
    base = chunks(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id", "left")
    return retrieve(base, questions(spark, d), READER)


def context_format(spark, d) -> DataFrame:
    hits = vector_hits(spark, d).where("rank <= 5").join(chunks(spark, d).select("chunk_id", "content", "source_file", "raw_table", "table_complex"), "chunk_id")
    return context(hits)


def candidate_brief(spark, d) -> DataFrame:
    return brief(vector_hits(spark, d).join(chunks(spark, d).select("chunk_id", "chunk_index", "content", "source_file"), "chunk_id"))


def _first_hits(spark, d) -> DataFrame:
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    hits = vector_hits(spark, d).join(labels.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("found")), "chunk_id")
    known = hits.join(labels.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    return M.first_hit(known, (F.col("found") == F.col("label")) & (F.col("chunk_id") != F.col("query_id")), "query_id", "label")


def recall_at_k(spark, d) -> DataFrame:
    return _first_hits(spark, d).agg(F.count(F.lit(1)).alias("n"), *M.recall_at(F.col("rank")), M.mrr(F.col("rank")))


def recall_by_label(spark, d) -> DataFrame:
    return _first_hits(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"), *M.recall_at(F.col("rank")), M.mrr(F.col("rank")))


def span_recall(spark, d) -> DataFrame:
    """How far down the lexical hits the first chunk stands that holds the whole question."""
    hits = lexical_hits(spark, d).join(questions(spark, d).select("query_id", "question"), "query_id").join(chunks(spark, d).select("chunk_id", "content"), "chunk_id")
    return M.first_hit(hits, F.contains("content", F.col("question")), "query_id").withColumn("bucket", M.rank_bucket(F.col("rank")))


def rank_buckets(spark, d) -> DataFrame:
    return _first_hits(spark, d).groupBy(M.rank_bucket(F.col("rank")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def position_class(spark, d) -> DataFrame:
    return _first_hits(spark, d).groupBy(M.position_class(F.col("rank")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def rerank_matrix(spark, d) -> DataFrame:
    """What reranking lexical hits by overlap does to first places that hold the question."""
    hits = lexical_hits(spark, d).join(questions(spark, d).select("query_id", "question"), "query_id").join(chunks(spark, d).select("chunk_id", "content"), "chunk_id")
    both = rerank(hits).groupBy("query_id").agg(*[F.bool_or(F.when(F.col(c) == 1, F.contains("content", F.col("question")))).alias(n) for c, n in (("candidate_rank", "before"), ("rank", "after"))])
    return both.groupBy(M.rerank_change(F.col("before"), F.col("after")).alias("change")).agg(F.count(F.lit(1)).alias("n"))


def consistency(spark, d) -> DataFrame:
    """Queries of one label as variants of a question."""
    first = _first_hits(spark, d)
    top = vector_hits(spark, d).where("rank = 1").join(chunks(spark, d).select("chunk_id", "source_file"), "chunk_id").select("query_id", F.col("source_file").alias("top_source"))
    return M.consistency(first.join(top, "query_id", "left").select(F.col("label").alias("question_id"), "rank", "top_source"))


def consistency_histogram(spark, d) -> DataFrame:
    return consistency(spark, d).groupBy("hits").agg(F.count(F.lit(1)).alias("n"))


def _best(spark, d) -> DataFrame:
    return vector_hits(spark, d).where("rank <= 5").join(embedded(spark, d).select("chunk_id", "embedding", "source_file", "department"), "chunk_id")


def pairwise_similarity(spark, d) -> DataFrame:
    """Mean cosine of all pairs among the best five of a query."""
    hits = _best(spark, d).select("query_id", "rank", "embedding")
    a, b = hits.select("query_id", F.col("rank").alias("ra"), F.col("embedding").alias("ea")), hits.select("query_id", F.col("rank").alias("rb"), F.col("embedding").alias("eb"))
    pairs = a.join(b, "query_id").where("ra < rb")
    return pairs.groupBy("query_id").agg(F.round(F.avg(cosine(F.col("ea"), F.col("eb"), 1e-9)), 6).alias("similarity"))


def gate_signals(spark, d) -> DataFrame:
    hits = _best(spark, d)
    return hits.groupBy("query_id").agg(
        F.count_distinct(F.nullif(F.col("source_file"), F.lit(""))).alias("sources"), F.round(F.max_by("score", -F.col("rank")) - F.max_by("score", "rank"), 6).alias("spread"), M.source_diverse("source_file", 3).alias("diverse")
    )


def scope_distribution(spark, d) -> DataFrame:
    counted = chunks(spark, d).groupBy("department").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "department"))).where("place <= 5")


def in_scope_share(spark, d) -> DataFrame:
    return chunks(spark, d).agg(M.share(F.col("department").isin("en", "fr")).alias("share"), F.count_if(F.col("department").isin("en", "fr")).alias("inside"), F.count(F.lit(1)).alias("n"))


def mode_deltas(spark, d) -> DataFrame:
    """Recall of hard and of soft scope, side by side."""
    labels = table(spark, d, "embeddings").select("vec_id", "label")

    def measured(access: Access, name: str) -> DataFrame:
        hits = vector_hits(spark, d, access).join(labels.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("found")), "chunk_id").join(labels.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
        rates = M.first_hit(hits, (F.col("found") == F.col("label")) & (F.col("chunk_id") != F.col("query_id")), "query_id").agg(*M.recall_at(F.col("rank")), M.mrr(F.col("rank")))
        return rates.unpivot([], ["recall_1", "recall_3", "recall_5", "mrr"], "metric", "value").withColumn("config", F.lit(name))

    return M.deltas(measured(READER, "hard").unionByName(measured(SOFT, "soft")), "config", "hard", "soft")


def modes_side_by_side(spark, d) -> DataFrame:
    """The first hit of each question by words and by the fused list, one column a mode."""
    lexical, (lists, _) = lexical_hits(spark, d), _lists(spark, d)
    both = lexical.select("query_id", "chunk_id", "rank", F.lit("lexical").alias("mode")).unionByName(fuse(lists).select("query_id", "chunk_id", "rank", F.lit("hybrid").alias("mode")))
    texts = both.join(questions(spark, d).select("query_id", "question"), "query_id").join(chunks(spark, d).select("chunk_id", "content"), "chunk_id")
    return texts.groupBy("query_id").pivot("mode", ["lexical", "hybrid"]).agg(F.min(F.when(F.contains("content", F.col("question")), F.col("rank"))))


def vector_shape(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.size("embedding").alias("dimension"), F.round(norm(F.col("embedding")), 4).alias("length"))


def order_changed(spark, d) -> DataFrame:
    """Whether the first five candidates and the reranked five are other lists."""
    ids = lambda rank: F.transform(F.array_sort(F.collect_list(F.when(F.col(rank) <= 5, F.struct(rank, "chunk_id")))), lambda x: x["chunk_id"])
    return reranked(spark, d).groupBy("query_id").agg((ids("candidate_rank") != ids("rank")).alias("changed"))


def ann_overlap(spark, d) -> DataFrame:
    """How much of the exact answer search by cells finds, over all vectors."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.lit(False).alias("is_deleted"), F.lit(False).alias("is_deprecated"))
    queries, centres = vector_queries(spark, d), fit_cells(vectors, 16)
    return M.overlap_recall(vector_topk(vectors, queries, 10), cell_topk(index_cells(vectors, centres), queries, centres, 10, probes=12))


QUERIES = {
    "flt_acl_hard": acl_hard, "flt_acl_soft_weight": acl_soft_weight, "flt_scope_rule": scope_rule, "srt_vector_topk": vector_hits, "srt_vector_topk_soft": vector_topk_soft, "srt_lexical_topk": lexical_hits,
    "agg_hybrid_rrf": hybrid_rrf, "win_rrf_first_seen": rrf_first_seen, "jn_rrf_score_backfill": rrf_score_backfill, "udf_rerank": reranked, "jn_retrieval_stages": retrieval_stages, "fn_context_format": context_format,
    "flt_candidate_brief": candidate_brief, "agg_recall_mrr": recall_at_k, "agg_recall_by_label": recall_by_label, "win_span_first_hit": span_recall, "agg_rank_buckets": rank_buckets, "agg_position_class": position_class,
    "agg_rerank_matrix": rerank_matrix, "agg_consistency": consistency, "agg_consistency_histogram": consistency_histogram, "jn_pairwise_similarity": pairwise_similarity, "agg_gate_signals": gate_signals,
    "agg_scope_distribution": scope_distribution, "agg_in_scope_share": in_scope_share, "agg_mode_deltas": mode_deltas, "agg_modes_side_by_side": modes_side_by_side, "fn_vector_shape": vector_shape, "agg_order_changed": order_changed,
    "agg_ann_overlap": ann_overlap,
}

_RATES = "round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 6) AS recall_3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr"
_BUCKET = "CASE WHEN rank = 1 THEN '1' WHEN rank <= 3 THEN '2-3' WHEN rank <= 5 THEN '4-5' WHEN rank <= 10 THEN '6-10' WHEN rank <= 20 THEN '11-20' ELSE 'none' END"
_RERANKED = r"""
    , asked_words AS (SELECT item_id AS query_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda t: t <> '')) AS w FROM benchmark),
    reranked AS (
        SELECT h.query_id, h.chunk_id, h.rank AS candidate_rank, contains(c.content, b.text) AS holds,
               round(len(list_intersect(a.w, list_filter(string_split_regex(lower(c.content), '[^\p{L}\p{N}_]+'), lambda t: t <> ''))) / len(a.w), 6) AS rerank_score
        FROM lhits h JOIN asked_words a USING (query_id) JOIN chunks c USING (chunk_id) JOIN benchmark b ON b.item_id = h.query_id
    ), ordered AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, candidate_rank, chunk_id) AS INTEGER) AS rank FROM reranked)
"""
_SOFT_HITS = """
    , shits AS (
        SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
        FROM (SELECT q.vec_id AS query_id, c.chunk_id, round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) * CASE WHEN c.department IN ('en', 'fr') THEN 1.0 ELSE 0.85 END, 6) AS score
              FROM embedded c, embeddings q WHERE q.vec_id % 50 = 0 AND NOT c.is_deleted AND NOT c.is_deprecated AND c.secret_level <= 2)
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 20
    )
"""
_BEST = ", best AS (SELECT h.*, e.embedding, e.source_file FROM vhits h JOIN embedded e USING (chunk_id) WHERE h.rank <= 5)"

#: The whole search of a reader: both arms under the access rule, fused, filled and reranked.
_STAGES = r"""
    , seen AS (SELECT * FROM chunks WHERE NOT is_deleted AND NOT is_deprecated AND secret_level <= 2 AND department IN ('en', 'fr')),
    larm AS (
        SELECT 0 AS list_no, query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
        FROM (SELECT query_id, chunk_id, round(sum(tf / (tf + 1)) / any_value(n), 6) AS score FROM words JOIN asked USING (token) JOIN seen USING (chunk_id) GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 20
    ), varm AS (
        SELECT 1 AS list_no, query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
        FROM (SELECT b.item_id AS query_id, c.chunk_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
              FROM seen c JOIN embeddings e ON e.vec_id = c.chunk_id, embeddings q JOIN benchmark b ON b.item_id = q.vec_id)
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 20
    ), joined AS (
        SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, min(list_no) AS first_list, arg_min(rank, list_no) AS first_rank, arg_min(score, list_no) AS score
        FROM (SELECT * FROM larm UNION ALL SELECT * FROM varm) GROUP BY 1, 2
    ), pool AS (
        SELECT * FROM (SELECT j.query_id, j.chunk_id, coalesce(v.score, j.score) AS score, CAST(row_number() OVER (PARTITION BY j.query_id ORDER BY rrf DESC, first_list, first_rank, j.chunk_id) AS INTEGER) AS rank
                       FROM joined j LEFT JOIN varm v USING (query_id, chunk_id)) WHERE rank <= 20
    ), judged AS (
        SELECT p.query_id, p.chunk_id, p.score, p.rank AS before, round(len(list_intersect(a.w, list_filter(string_split_regex(lower(c.content), '[^\p{L}\p{N}_]+'), lambda t: t <> ''))) / len(a.w), 6) AS share
        FROM pool p JOIN asked_words a USING (query_id) JOIN chunks c USING (chunk_id)
    ), final AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY share DESC, before, chunk_id) AS INTEGER) AS rank FROM judged QUALIFY rank <= 5)
"""
_DELTAS = r"""
    , scoped AS (
        SELECT 'hard' AS config, q.vec_id AS query_id, c.chunk_id, round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
        FROM embedded c, embeddings q WHERE q.vec_id % 50 = 0 AND NOT c.is_deleted AND NOT c.is_deprecated AND c.secret_level <= 2 AND c.department IN ('en', 'fr')
        UNION ALL SELECT 'soft', q.vec_id, c.chunk_id, round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) * CASE WHEN c.department IN ('en', 'fr') THEN 1.0 ELSE 0.85 END, 6)
        FROM embedded c, embeddings q WHERE q.vec_id % 50 = 0 AND NOT c.is_deleted AND NOT c.is_deprecated AND c.secret_level <= 2
    ), top AS (SELECT *, row_number() OVER (PARTITION BY config, query_id ORDER BY score DESC, chunk_id) AS rank FROM scoped QUALIFY rank <= 20),
    firsts AS (
        SELECT t.config, t.query_id, min(CASE WHEN e.label = q.label AND t.chunk_id <> t.query_id THEN t.rank END) AS rank
        FROM top t JOIN embeddings e ON e.vec_id = t.chunk_id JOIN embeddings q ON q.vec_id = t.query_id GROUP BY 1, 2
    ), rates AS (SELECT config, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 6) AS recall_3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM firsts GROUP BY 1),
    long AS (SELECT config, unnest(['recall_1', 'recall_3', 'recall_5', 'mrr']) AS metric, unnest([recall_1, recall_3, recall_5, mrr]) AS value FROM rates)
"""

ORACLE_SQL = {
    "jn_retrieval_stages": f"WITH {SQL} {_RERANKED} {_STAGES} SELECT 'candidate' AS stage, query_id, chunk_id, score, rank FROM pool UNION ALL SELECT 'final', query_id, chunk_id, score, rank FROM final",
    "agg_mode_deltas": f"WITH {SQL} {_DELTAS} SELECT h.metric, h.value AS hard, s.value AS soft, round(s.value - h.value, 6) AS delta FROM long h JOIN long s USING (metric) WHERE h.config = 'hard' AND s.config = 'soft'",
    "flt_acl_hard": f"WITH {SQL} SELECT chunk_id, department, secret_level FROM chunks WHERE NOT is_deleted AND NOT is_deprecated AND secret_level <= 2 AND department IN ('en', 'fr')",
    "flt_acl_soft_weight": f"WITH {SQL} SELECT chunk_id, department, CASE WHEN department IN ('en', 'fr') THEN 1.0 ELSE 0.85 END AS weight FROM chunks WHERE NOT is_deleted AND NOT is_deprecated AND secret_level <= 2",
    "flt_scope_rule": "SELECT DISTINCT lang, lang || ',company' AS scope FROM documents",
    "srt_vector_topk": f"WITH {SQL} SELECT query_id, chunk_id, score, rank FROM vhits",
    "srt_vector_topk_soft": f"WITH {SQL} {_SOFT_HITS} SELECT query_id, chunk_id, score, rank FROM shits",
    "srt_lexical_topk": f"WITH {SQL} SELECT query_id, chunk_id, score, rank FROM lhits",
    "agg_hybrid_rrf": f"WITH {SQL} SELECT query_id, chunk_id, rrf, rank FROM fused",
    "win_rrf_first_seen": f"WITH {SQL} SELECT query_id, chunk_id, first_list, first_rank, score FROM fused",
    "jn_rrf_score_backfill": f"WITH {SQL} SELECT query_id, chunk_id, score, vector_score, lexical_score, rank FROM filled",
    "udf_rerank": f"WITH {SQL} {_RERANKED} SELECT query_id, chunk_id, rerank_score, candidate_rank, rank FROM ordered",
    "fn_context_format": f"WITH {SQL} SELECT query_id, string_agg('[' || rank || '] ' || source_file || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context FROM vhits JOIN chunks USING (chunk_id) WHERE rank <= 5 GROUP BY 1",
    "flt_candidate_brief": f"WITH {SQL} SELECT query_id, rank, source_file, CAST(0 AS INTEGER) AS chunk_index, round_even(score, 4) AS score, left(replace(content, chr(10), ' '), 120) AS snippet FROM vhits JOIN chunks USING (chunk_id)",
    "agg_recall_mrr": f"WITH {SQL} SELECT count(*) AS n, {_RATES} FROM first_hits",
    "agg_recall_by_label": f"WITH {SQL} SELECT label, count(*) AS n, {_RATES} FROM first_hits GROUP BY label",
    "win_span_first_hit": f"WITH {SQL} SELECT query_id, rank, {_BUCKET} AS bucket FROM (SELECT h.query_id, min(CASE WHEN contains(c.content, b.text) THEN h.rank END) AS rank FROM lhits h JOIN chunks c USING (chunk_id) JOIN benchmark b ON b.item_id = h.query_id GROUP BY 1)",
    "agg_rank_buckets": f"WITH {SQL} SELECT {_BUCKET} AS bucket, count(*) AS n FROM first_hits GROUP BY 1",
    "agg_position_class": f"WITH {SQL} SELECT CASE WHEN rank <= 5 THEN 'shown' WHEN rank <= 20 THEN 'crowded' ELSE 'blind' END AS class, count(*) AS n FROM first_hits GROUP BY 1",
    "agg_rerank_matrix": f"WITH {SQL} {_RERANKED} SELECT CASE WHEN NOT b AND a THEN 'fixed' WHEN b AND NOT a THEN 'broke' WHEN b THEN 'kept_right' ELSE 'kept_wrong' END AS change, count(*) AS n FROM (SELECT query_id, bool_or(candidate_rank = 1 AND holds) AS b, bool_or(rank = 1 AND holds) AS a FROM ordered GROUP BY 1) GROUP BY 1",
    "agg_consistency": f"WITH {SQL} SELECT f.label AS question_id, count(f.rank) AS hits, count(f.rank) = count(*) AS all_hit, count(DISTINCT coalesce(c.source_file, chr(1))) = 1 AS same_top FROM first_hits f LEFT JOIN vhits h ON h.query_id = f.query_id AND h.rank = 1 LEFT JOIN chunks c USING (chunk_id) GROUP BY 1",
    "agg_consistency_histogram": f"WITH {SQL} SELECT hits, count(*) AS n FROM (SELECT label, count(rank) AS hits FROM first_hits GROUP BY 1) GROUP BY 1",
    "jn_pairwise_similarity": f"WITH {SQL} {_BEST} SELECT a.query_id, round(avg(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS similarity FROM best a JOIN best b ON a.query_id = b.query_id AND a.rank < b.rank GROUP BY 1",
    "agg_gate_signals": f"WITH {SQL} {_BEST} SELECT query_id, count(DISTINCT nullif(source_file, '')) AS sources, round(arg_min(score, rank) - arg_max(score, rank), 6) AS spread, count(DISTINCT nullif(source_file, '')) >= 3 AS diverse FROM best GROUP BY 1",
    "agg_scope_distribution": "SELECT department, n, CAST(row_number() OVER (ORDER BY n DESC, department) AS INTEGER) AS place FROM (SELECT lang AS department, count(*) AS n FROM documents GROUP BY 1) QUALIFY place <= 5",
    "agg_in_scope_share": "SELECT round(avg(CASE WHEN lang IN ('en', 'fr') THEN 1.0 ELSE 0 END), 6) AS share, count(*) FILTER (WHERE lang IN ('en', 'fr')) AS inside, count(*) AS n FROM documents",
    "agg_modes_side_by_side": f"WITH {SQL} SELECT query_id, min(CASE WHEN mode = 'l' AND contains(c.content, b.text) THEN rank END) AS lexical, min(CASE WHEN mode = 'h' AND contains(c.content, b.text) THEN rank END) AS hybrid FROM (SELECT query_id, chunk_id, rank, 'l' AS mode FROM lhits UNION ALL SELECT query_id, chunk_id, rank, 'h' FROM fused) h JOIN chunks c USING (chunk_id) JOIN benchmark b ON b.item_id = h.query_id GROUP BY 1",
    "fn_vector_shape": "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dimension, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 4) AS length FROM embeddings",
    "agg_order_changed": f"WITH {SQL} {_RERANKED} SELECT query_id, list(chunk_id ORDER BY candidate_rank) FILTER (WHERE candidate_rank <= 5) <> list(chunk_id ORDER BY rank) FILTER (WHERE rank <= 5) AS changed FROM ordered GROUP BY 1",
}
