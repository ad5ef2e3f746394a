"""Connected components of a distributed edge list: contraction in every task, then rounds that join what lies in different tasks.

Every task reduces the edges that it holds to spanning stars, so that a node is a child
there at most once. A round deals the stars out by child and contracts them again,
which leaves a child with one parent; children of a node that is a child itself then go to its parent.
Once nothing changes, every child has one parent, which is a root: the smallest node of its component.

No vertex with very many neighbours meets in one task: its children are dealt out one by
one, and its own parent goes to them in runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, store

RUNS = 32
#: Edges that a task holds at a time.
EDGES_PER_TASK = 1 << 19


def smallest_by_key(rows: DataFrame, key: str, value: str, out: str, runs: int = RUNS) -> DataFrame:
    """``rows`` with the smallest ``value`` of each row's ``key``, however many rows share a key."""
    dealt = rows.withColumn("_run", F.pmod(F.xxhash64(value), F.lit(runs)).cast("int"))
    local = dealt.groupBy(key, "_run").agg(F.min(value).alias("_least"))
    total = local.groupBy(key).agg(F.min("_least").alias(out), F.collect_list("_run").alias("_runs"))
    return dealt.join(total.select(key, out, F.explode("_runs").alias("_run")), [key, "_run"]).drop("_run")


def spanning_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges but the smallest of its component, and that smallest one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent, x, y = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while len(x):
        x, y = parent[x], parent[y]
        open_ = x != y
        x, y = np.maximum(x, y)[open_], np.minimum(x, y)[open_]
        np.minimum.at(parent, x, y)
        while True:
            further = parent[parent]
            if (further == parent).all():
                break
            parent = further
    child = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[child], nodes[parent[child]]


def _contracted(edges: DataFrame, most: int) -> DataFrame:
    """(a, b) with a > b that join the same nodes within each task; stars of at most ``most`` edges and a batch are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        fresh = kept = 0

        def out() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            fresh += batch.num_rows
            if fresh > most:
                held = [spanning_stars(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                fresh, kept = 0, len(held[0][0])
                if kept > most:
                    yield out()
                    held, kept = [], 0
        if held:
            held = [spanning_stars(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            yield out()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots, which are the smallest nodes of their components.

    Edges may repeat, point either way or be loops; those with a null are none. Nodes are integers; no edges, no rows.
    Every round runs alike, however many edges are left; only the number of tasks follows theirs.
    """
    links = store(_contracted(edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")), edges_per_task))
    size, before = links.count(), None
    runs = F.array(*map(F.lit, range(RUNS)))
    while True:
        tasks = 1 + size // edges_per_task
        met = store(_contracted(links.coalesce(tasks).repartition(tasks, "a"), edges_per_task))
        discard(links)
        now = tuple(met.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return met.select(F.col("a").alias("node"), F.col("b").alias("root"))
        size, before = now[0], now
        # parents that are children; where there are none, the next round only confirms it
        inner = store(met.join(met.select(F.col("b").alias("a")).distinct(), "a", "left_semi"))
        if inner.isEmpty():
            links = met
            continue
        up = inner.select(F.col("a").alias("b"), F.col("b").alias("c"), F.explode(runs).alias("run"))
        dealt = met.withColumn("run", F.pmod(F.xxhash64("a"), F.lit(RUNS)).cast("int"))
        links = store(dealt.join(up, ["b", "run"], "left").select("a", F.coalesce("c", "b").alias("b")))
        discard(met, inner)
