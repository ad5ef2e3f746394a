"""Models as inputs: what embeds, answers and reranks is handed in, and used in bounded batches within Spark's tasks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import replies as R
from ..functions.text import one_line

#: Texts of one call of an embedder.
BATCH = 16
REPLY = "text string, finish string, error string"
#: From a prompt to a reply and the reason why it ended.
Transport = Callable[[str], tuple[str, str]]


class Embedder(Protocol):
    """What turns texts into vectors of ``dimension`` numbers; ``name`` goes into the stamps."""

    name: str
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Unit vectors of hashed words, for want of a model; a text without words is the zero vector."""

    def __init__(self, dimension: int = 64) -> None:
        self.name, self.dimension = "hash", dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", text.lower()):
                digest = hashlib.blake2b(word.encode(), digest_size=8).digest()
                row[int.from_bytes(digest[:7]) % self.dimension] += 1 if digest[7] & 1 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


def with_embeddings(rows: DataFrame, text: str, embedder: Embedder, out: str = "embedding", batch: int = BATCH) -> DataFrame:
    """``rows`` with the vector of each text, asked for in calls of at most ``batch``; vectors of another dimension are an error."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts, found = part.fillna("").tolist(), []
            for at in range(0, len(texts), batch):
                asked = texts[at : at + batch]
                vectors = embedder.embed(asked)
                if len(vectors) != len(asked) or any(len(v) != embedder.dimension for v in vectors):
                    raise ValueError(f"{embedder.name} gave vectors of another number or dimension")
                found.extend(vectors)
            yield pd.Series(found, index=part.index, dtype=object)

    return rows.withColumn(out, run(F.col(text)))


def with_replies(rows: DataFrame, prompt: Column, transport: Transport, out: str = "reply", retries: int = 0) -> DataFrame:
    """``rows`` with a model's reply (text, finish, error); after ``retries`` more tries a failure is a reply with an error."""

    @F.pandas_udf(REPLY)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(asked: str) -> tuple[str | None, str | None, str | None]:
            error = None
            for _ in range(retries + 1):
                try:
                    return (*transport(asked), None)
                except Exception as e:  # whatever a model's client raises is a reply here
                    error = f"{type(e).__name__}: {e}"
            return None, None, error

        for part in parts:
            yield pd.DataFrame([one(p) for p in part.fillna("")], columns=["text", "finish", "error"])

    return rows.withColumn(out, run(prompt))


def pair_scores(candidates: DataFrame, score: Callable[[list[tuple[str, str]]], list[float]], batch: int = 32) -> DataFrame:
    """Candidates (query_id, chunk_id, rank, question, content) in the order of a scorer of pairs, such as a cross-encoder; equal scores keep their order."""
    from .search import DIGITS, ranked

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for questions, contents in parts:
            pairs = list(zip(questions.fillna(""), contents.fillna(""), strict=True))
            yield pd.Series([s for at in range(0, len(pairs), batch) for s in score(pairs[at : at + batch])], dtype=float)

    scored = candidates.withColumn("rerank_score", F.round(run("question", "content"), DIGITS)).withColumnRenamed("rank", "candidate_rank")
    return ranked(scored, None, first=[F.desc("rerank_score"), F.asc("candidate_rank")])


def model_rerank(candidates: DataFrame, transport: Transport, snippet: int = 300) -> DataFrame:
    """(query_id, chunk_id, candidate_rank, rank): the order that a model gives to numbered snippets; a failure keeps the order as it was."""
    entry = F.struct("rank", "chunk_id", one_line(F.col("content"), snippet).alias("snippet"))
    asked = candidates.groupBy("query_id").agg(F.first("question").alias("question"), F.array_sort(F.collect_list(entry)).alias("entries"))
    listed = F.array_join(F.transform("entries", lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), e["snippet"])), "\n")
    prompt = F.concat(F.lit("Question: "), "question", F.lit("\n"), listed, F.lit("\nList the numbers from the best to the worst, as [1, 2, ...]."))
    replied = with_replies(asked, prompt, transport)
    placed = replied.select("query_id", "entries", F.posexplode(R.order(F.col("reply.text"), F.size("entries"))).alias("place", "number"))
    picked = F.element_at("entries", F.col("number"))
    return placed.select("query_id", picked["chunk_id"].alias("chunk_id"), picked["rank"].alias("candidate_rank"), (F.col("place") + 1).alias("rank"))


def expanded_queries(queries: DataFrame, transport: Transport, n: int = 2) -> DataFrame:
    """(query_id, variant_no, question): the question, number 0, and at most ``n`` further wordings; after a failure the question alone."""
    prompt = F.concat(F.lit(f"Give {n} other wordings of the question as a JSON array of strings.\n"), "question")
    every = R.expanded(F.col("question"), R.variants(F.col("reply.text"), n))
    return with_replies(queries.select("query_id", "question"), prompt, transport).select("query_id", F.posexplode(every).alias("variant_no", "question"))


def judged_questions(questions: DataFrame, transport: Transport) -> DataFrame:
    """(query_id, status, reason, options) by a judge of (query_id, question, candidates, n); fewer than two candidates aren't asked about."""
    prompt = F.concat(F.lit('Does the question have several readings? Answer {"ambiguous": ..., "reason": ..., "options": [...]}.\n'), "question", F.lit("\n"), F.coalesce("candidates", F.lit("")))
    replied = with_replies(questions, F.when(F.col("n") >= 2, prompt).otherwise(""), transport)
    return replied.select("query_id", R.judged(F.lit(True), F.col("n"), F.col("reply.text")).alias("v")).select("query_id", "v.*")


def is_ambiguous(status: Column) -> Column:
    return F.coalesce(status == "ambiguous", F.lit(False))


def is_unknown(status: Column) -> Column:
    return F.coalesce(status == "unknown", F.lit(True))


def clarification(options: Column, question: str = "Which one do you mean?") -> Column:
    """The question that goes back to the user: one numbered line for each option; null without options."""
    listed = F.transform(options, lambda o, i: F.concat((i + 1).cast("string"), F.lit(". "), o["summary"]))
    return F.when(F.size(options) > 0, F.concat(F.lit(question + "\n"), F.array_join(listed, "\n")))


def template(text: str, **values: Column) -> Column:
    """A template's text with {name} replaced by a column; names without a column stay, and a null reads as empty."""
    out = F.lit(text)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def answered(contexts: DataFrame, transport: Transport, prompt: str = "Answer from the sources and cite them as [n].\n{context}\nQuestion: {question}") -> DataFrame:
    """(query_id, answer, cited): a model's answer to (query_id, question, context, n), and the sources it cites; a failure has no answer."""
    replied = with_replies(contexts, template(prompt, context=F.col("context"), question=F.col("question")), transport)
    return replied.select("query_id", F.col("reply.text").alias("answer"), F.when(F.col("reply.text").isNotNull(), R.cited(F.col("reply.text"), F.col("n"))).alias("cited"))
