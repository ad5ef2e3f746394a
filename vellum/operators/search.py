"""Search: exact top-k by vectors and by words for a set of queries, fusion of ranked lists, and context.

Queries are few beside chunks: they travel to the chunks in blocks, every Arrow batch
of chunks gives its own best k of each query by one matrix product, and only those
are ranked. Ranks are total: ties go by rounded score, then by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import one_line, tokens
from .access import Access

#: Queries of one scan, and queries and chunks of one product of word counts.
QUERY_BLOCK, QUERIES_AT_A_TIME, CHUNKS_AT_A_TIME = 1024, 128, 512
RRF_K = 60
#: Scores are rounded before they rank, so that sums in another order rank alike.
DIGITS = 6


def ranked(scored: DataFrame, k: int | None, by: str = "score", first: list[Column] | None = None) -> DataFrame:
    """``scored`` with rank from 1 within query_id, cut off at k."""
    order = Window.partitionBy("query_id").orderBy(*(first or [F.desc(by)]), "chunk_id")
    out = scored.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def vector_topk(chunks: DataFrame, queries: DataFrame, k: int, access: Access = Access(), block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k chunks nearest to each query by cosine times weight.

    ``chunks`` has chunk_id, embedding and what the access rule reads, ``queries`` has query_id and
    embedding. The rule applies before anything is scored. Null vectors, and vectors of
    length zero, have no score. The answer is exact.
    """
    seen = access.visible(chunks).where(F.col("embedding").isNotNull()).select(F.col("chunk_id").cast("long"), "embedding", "weight")
    rows, found = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding").toLocalIterator(), None
    while part := list(islice(rows, block)):
        ids = np.array([r["query_id"] for r in part], np.int64)
        vectors = np.array([r["embedding"] for r in part], np.float64)
        lengths = np.linalg.norm(vectors, axis=1, keepdims=True)

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, vectors: np.ndarray = vectors, lengths: np.ndarray = lengths) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                below = lengths * np.linalg.norm(x, axis=1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    score = np.round(vectors @ x.T / below * batch.column(2).to_numpy(), DIGITS)
                score[~(below > 0)] = -np.inf
                yield _best(ids, batch.column(0).to_numpy(), score, score, k)

        own = seen.mapInArrow(run, "query_id long, chunk_id long, score double")
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = chunks.sparkSession.createDataFrame([], "query_id long, chunk_id long, score double")
    return ranked(found, k)


def postings(chunks: DataFrame, extra: str | None = None) -> DataFrame:
    """(chunk_id, token, tf) of each chunk's words; ``extra`` names a column, the raw table, whose words count too."""
    text = F.col("content") if extra is None else F.concat_ws(" ", "content", extra)
    return chunks.select("chunk_id", F.explode(tokens(text)).alias("token")).groupBy("chunk_id", "token").agg(F.count(F.lit(1)).alias("tf"))


def lexical_topk(chunks: DataFrame, queries: DataFrame, k: int, access: Access = Access(), extra: str | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, chunk_id, score, rank) by words: the mean over a query's distinct words of tf / (tf + 1), times weight.

    A query without words finds nothing. Words travel as hashes of 64 bits; every batch of chunks counts those that some
    query asks for, scores all queries by one matrix product, and gives its own best k of each.
    """
    hashed = lambda text: F.transform(tokens(text), lambda t: F.xxhash64(t))
    text = F.col("content") if extra is None else F.concat_ws(" ", "content", extra)
    words = access.visible(chunks).select(F.col("chunk_id").cast("long"), F.col("weight").cast("double"), hashed(text).alias("words"))
    asked = queries.select(F.col("query_id").cast("long"), F.array_distinct(hashed(F.col("question"))).alias("words")).where(F.size("words") > 0)
    rows, found = asked.toLocalIterator(), None
    while part := list(islice(rows, block)):
        groups = []
        for lo in range(0, len(part), QUERIES_AT_A_TIME):
            group = part[lo : lo + QUERIES_AT_A_TIME]
            vocabulary = np.unique(np.concatenate([np.array(r["words"], np.int64) for r in group]))
            wanted = np.zeros((len(vocabulary), len(group)))
            for q, r in enumerate(group):
                wanted[np.searchsorted(vocabulary, np.array(r["words"], np.int64)), q] = 1.0
            groups.append((np.array([r["query_id"] for r in group], np.int64), vocabulary, wanted, wanted.sum(axis=0)))

        def run(batches: Iterator[pa.RecordBatch], groups: list = groups) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, whole.num_rows, CHUNKS_AT_A_TIME):
                    batch = whole.slice(lo, CHUNKS_AT_A_TIME)
                    lists, names, weight = batch.column(2), batch.column(0).to_numpy(), batch.column(1).to_numpy()
                    said = lists.flatten().to_numpy()
                    row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(lists).to_numpy())
                    for ids, vocabulary, wanted, size in groups:
                        at = np.minimum(np.searchsorted(vocabulary, said), len(vocabulary) - 1)
                        hit = vocabulary[at] == said
                        tf = np.bincount(row[hit] * len(vocabulary) + at[hit], minlength=batch.num_rows * len(vocabulary)).reshape(batch.num_rows, -1)
                        score = (((tf / (tf + 1.0)) @ wanted) / size * weight[:, None]).T
                        yield _best(ids, names, np.where(score > 0, score, -np.inf), np.floor(score * 10**DIGITS + 0.5), k)

        own = words.mapInArrow(run, "query_id long, chunk_id long, score double")
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = chunks.sparkSession.createDataFrame([], "query_id long, chunk_id long, score double")
    return ranked(found.withColumn("score", F.round("score", DIGITS)), k)


def _best(ids: np.ndarray, names: np.ndarray, score: np.ndarray, order: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best of each row of ``score``, by ``order`` and then by name; minus infinity is no hit."""
    order = np.where(np.isfinite(score), order, -np.inf)
    reach = min(k, order.shape[1])
    # all that reach the k-th place, ties too, and only those are sorted
    bar = -np.partition(-order, reach - 1, axis=1)[:, reach - 1]
    q, c = np.nonzero((order >= bar[:, None]) & np.isfinite(score))
    sort = np.lexsort([names[c], -order[q, c], q])
    q, c = q[sort], c[sort]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    q, c = q[place < k], c[place < k]
    return pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(names[c]), pa.array(score[q, c])], names=["query_id", "chunk_id", "score"])


def fuse(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_id, rrf, first_list, first_rank, score, rank) of ranked lists (query_id, list_no, rank, chunk_id, score).

    Reciprocal ranks are summed; ties go to the earlier list, then to the earlier place. The
    score is that of the first appearance. Entries without an id are skipped.
    """
    entry = F.struct("list_no", "rank", "score")
    summed = lists.where("chunk_id IS NOT NULL").groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf"), F.min(entry).alias("e"))
    flat = summed.select("query_id", "chunk_id", "rrf", F.col("e.list_no").alias("first_list"), F.col("e.rank").alias("first_rank"), F.col("e.score").alias("score"))
    return ranked(flat, None, first=[F.desc("rrf"), F.asc("first_list"), F.asc("first_rank")])


def backfill(fused: DataFrame, vector_hits: DataFrame) -> DataFrame:
    """Fused hits with the best vector score where there is one; the lexical score stays in a column of its own."""
    best = vector_hits.groupBy("query_id", "chunk_id").agg(F.max("score").alias("vector_score"))
    return fused.join(best, ["query_id", "chunk_id"], "left").withColumn("lexical_score", F.when(F.col("vector_score").isNull(), F.col("score"))).withColumn("score", F.coalesce("vector_score", "score"))


def overlap_score(question: Column, content: Column) -> Column:
    """A reranker's score for want of a model: the share of the question's words that the content has."""
    asked = F.array_distinct(tokens(question))
    return F.when(F.size(asked) > 0, F.round(F.size(F.array_intersect(asked, tokens(content))) / F.size(asked), DIGITS)).otherwise(0.0)


RERANKERS = {"overlap": overlap_score}


def rerank(candidates: DataFrame, backend: str = "overlap") -> DataFrame:
    """Candidates (query_id, chunk_id, rank, question, content) in the order of a reranker; equal scores keep their order."""
    if backend not in RERANKERS:
        raise ValueError(f"unknown reranker {backend!r}; known: {', '.join(sorted(RERANKERS))}")
    scored = candidates.withColumn("rerank_score", RERANKERS[backend](F.col("question"), F.col("content"))).withColumnRenamed("rank", "candidate_rank")
    return ranked(scored, None, first=[F.desc("rerank_score"), F.asc("candidate_rank")])


def retrieve(
    chunks: DataFrame, queries: DataFrame, access: Access = Access(), top_k: int = 5, candidates: int = 20, hybrid: bool = True, reranker: str | None = "overlap", variants: DataFrame | None = None
) -> DataFrame:
    """Hits of both stages, ``candidate`` and ``final``: (stage, query_id, chunk_id, score, rank).

    ``queries`` has query_id, question and embedding; ``variants`` further (query_id, variant_no,
    embedding). One list isn't fused; reranking needs more candidates than are asked for.
    """
    reach = max(top_k, candidates) if reranker else top_k
    arms = [vector_topk(chunks, queries, reach, access).withColumn("list_no", F.lit(1))]
    if variants is not None:
        # each variant with a number of its own, however many there are
        order = Window.orderBy("query_id", "variant_no")
        numbered = variants.select("query_id", "variant_no", "embedding", (F.row_number().over(order)).cast("long").alias("pair"))
        more = vector_topk(chunks, numbered.select(F.col("pair").alias("query_id"), "embedding"), reach, access).withColumnRenamed("query_id", "pair")
        arms.append(more.join(numbered.select("pair", "query_id", (F.col("variant_no") + 1).cast("int").alias("list_no")), "pair").drop("pair"))
    vector_hits = arms[0] if len(arms) == 1 else arms[0].unionByName(arms[1])
    if hybrid:
        arms.insert(0, lexical_topk(chunks, queries, reach, access).withColumn("list_no", F.lit(0)))
    if len(arms) == 1:
        pool = arms[0].select("query_id", "chunk_id", "score", "rank")
    else:
        lists = arms[0]
        for arm in arms[1:]:
            lists = lists.unionByName(arm)
        pool = backfill(fuse(lists), vector_hits).select("query_id", "chunk_id", "score", "rank").where(F.col("rank") <= reach)
    if reranker and reach > top_k:
        texts = pool.join(queries.select("query_id", "question"), "query_id").join(chunks.select("chunk_id", "content"), "chunk_id")
        final = rerank(texts, reranker).select("query_id", "chunk_id", "score", "rank").where(F.col("rank") <= top_k)
    else:
        final = pool.where(F.col("rank") <= top_k)
    return pool.select(F.lit("candidate").alias("stage"), "*").unionByName(final.select(F.lit("final").alias("stage"), "*"))


def context(hits: DataFrame) -> DataFrame:
    """(query_id, context): numbered entries of hits (rank, source_file, content, raw_table, table_complex); raw tables only where complex."""
    entry = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("source_file", F.lit("")), F.lit("\n"), "content", F.when(F.col("table_complex") & F.col("raw_table").isNotNull(), F.concat(F.lit("\n"), "raw_table")).otherwise(""))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry")))), lambda e: e["entry"]), "\n\n")
    return hits.groupBy("query_id").agg(joined.alias("context"))


def brief(hits: DataFrame, size: int = 120) -> DataFrame:
    """What a list of hits shows."""
    return hits.select("query_id", "rank", "source_file", "chunk_index", F.bround("score", 4).alias("score"), one_line(F.col("content"), size).alias("snippet"))
