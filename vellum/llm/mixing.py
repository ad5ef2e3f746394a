"""Mixing sources to target weights by soft membership, in SQL functions only.

A naive Bayes classifier over hashed words, counted from a labelled table, gives
every document a posterior over domains. Document rates then minimise the squared
difference between expected domain token totals and their targets, by projected
gradient steps from the rate 1. As a step depends on a document by its
posterior alone, documents are first summed by posterior, in steps of 1/GRAIN; the
history of residuals, a few numbers a step, then gives the rate of any document,
so no table of rates is kept or joined.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, labelled_sample, store, without

#: Labelled rows that the classifier is fitted on, at most.
TRAIN_ROWS = 4_000
BUCKETS = 4096
#: A posterior weighs as much evidence as this many words, so that it stays soft.
EVIDENCE_WORDS = 24
GRAIN = 50
#: Word weights are whole numbers: SCALE a nat, around ZERO.
SCALE, ZERO = 16, 128
TARGETS = {"en": 0.55, "fr": 0.17, "de": 0.16, "es": 0.12}


def _words(text: str) -> Column:
    """Words between ASCII white space, in lower case; none of an empty or null text."""
    body = F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return F.array_remove(F.split(body, r"[\x20\x09-\x0D]+"), "")


def _barrier() -> Column:
    """Zero, in a form that filters aren't pushed through: else a filter by what follows computes the folds below over again, many times."""
    return F.pmod(F.monotonically_increasing_id(), F.lit(1)).cast("int")


def _bucket(word: Column) -> Column:
    return (F.pmod(F.xxhash64(word), F.lit(BUCKETS)) + 1).cast("int")


@dataclass
class DomainModel:
    """Domains, their log priors, and weights by bucket: two domains to a 64-bit integer, listed with commas."""

    domains: list[str]
    priors: list[float]
    weights: list[str]

    def place(self, docs: DataFrame, text: str, n: str, p: str) -> DataFrame:
        """``docs`` with its number of words, and with the posterior in steps of 1/GRAIN, which add up to GRAIN."""
        pairs = range(len(self.weights))
        plain = without(docs.columns, n, p)
        buckets, sums = fresh([*plain, n, p], "_buckets", "_sums")
        # constants, which every task has once; a column of them would be copied row by row
        tables = [F.split(F.lit(w), ",").cast("array<bigint>") for w in self.weights]
        zero = F.struct(*[F.lit(0).cast("bigint").alias(f"s{i}") for i in pairs])

        def add(s: Column, bucket: Column) -> Column:
            return F.struct(*[(s[f"s{i}"] + F.element_at(tables[i], bucket)).alias(f"s{i}") for i in pairs])

        placed = docs.select(*plain, F.transform(_words(text), _bucket).alias(buckets))
        summed = placed.select(*plain, (F.size(buckets) + _barrier()).alias(n), F.aggregate(buckets, zero, add).alias(sums))
        return summed.select(*plain, n, self._shares(F.col(sums), F.col(n)).alias(p))

    def _shares(self, sums: Column, n: Column) -> Column:
        logs = []
        for k, prior in enumerate(self.priors):
            lane = F.shiftright(sums[f"s{k // 2}"], 31) if k % 2 else sums[f"s{k // 2}"].bitwiseAND((1 << 31) - 1)
            mean = F.when(n > 0, (lane - ZERO * n) / (SCALE * F.greatest(n, F.lit(1)))).otherwise(0.0)
            logs.append(F.lit(prior) + mean * F.least(n, F.lit(EVIDENCE_WORDS)))
        # a fold over one array, so that what it is made of is computed once
        return F.element_at(F.transform(F.array(F.array(*logs)), _rounded_softmax), 1)


def _rounded_softmax(logs: Column) -> Column:
    """Softmax in whole steps of 1/GRAIN: differences of rounded running sums, so they add up."""
    top = F.array_max(logs)
    grown = F.transform(logs, lambda x: F.exp(x - top))
    running = F.aggregate(
        grown,
        F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all")),
        lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["all"], F.array(s["sum"] + x)).alias("all")),
        lambda s: F.transform(s["all"], lambda x: F.round(GRAIN * x / s["sum"]).cast("int")),
    )
    return F.element_at(F.transform(F.array(running), lambda r: F.transform(r, lambda x, i: x - F.when(i > 0, F.get(r, i - 1)).otherwise(0))), 1)


def train_domains(labelled: DataFrame, text: str = "text", domain: str = "domain") -> DomainModel:
    """A model from (text, domain) rows, a bounded sample, with all of its domains; rows without a domain don't count.

    Without any row there is one domain, called "", that every document belongs to.
    """
    rows = labelled.where(F.col(domain).isNotNull())
    counts = {r[domain]: r["count"] for r in rows.groupBy(domain).count().collect()}
    domains = sorted(counts) or [""]
    total = sum(counts.values())
    priors = [math.log((counts.get(d, 0) + 1) / (total + len(domains))) for d in domains]
    words = rows.select(domain, F.explode(F.transform(_words(text), _bucket)).alias("bucket")).groupBy("bucket").pivot(domain, domains).count()
    every = labelled.sparkSession.range(1, BUCKETS + 1).select(F.col("id").cast("int").alias("bucket")).join(words, "bucket", "left")
    filled = every.select("bucket", *[F.coalesce(F.col(f"`{d}`"), F.lit(0)).alias(f"c{k}") for k, d in enumerate(domains)])
    sums = filled.agg(*[F.sum(f"c{k}").alias(f"t{k}") for k in range(len(domains))]).first()
    logs = [F.log((F.col(f"c{k}") + 0.5) / (sums[f"t{k}"] + 0.5 * BUCKETS)) for k in range(len(domains))]
    mean = sum(logs[1:], logs[0]) / len(domains)
    quantised = [F.least(F.greatest(F.round((x - mean) * SCALE) + ZERO, F.lit(0.0)), F.lit(2.0 * ZERO - 1)).cast("bigint") for x in logs]
    packed = [quantised[k] + (F.shiftleft(quantised[k + 1], 31) if k + 1 < len(domains) else F.lit(0).cast("bigint")) for k in range(0, len(domains), 2)]
    listed = filled.select("bucket", *[w.alias(f"w{i}") for i, w in enumerate(packed)])
    entries = lambda i: F.transform(F.array_sort(F.collect_list(F.struct("bucket", f"w{i}"))), lambda x: x[f"w{i}"].cast("string"))
    weights = listed.agg(*[F.array_join(entries(i), ",").alias(f"w{i}") for i in range(len(packed))]).first()
    return DomainModel(domains, priors, list(weights))


def _rate(p: Column, history: list[list[float]], least: float = 0.0) -> Column:
    """The rate after the steps of ``history``, the scaled residuals by domain of each; never below ``least``."""
    if not history:
        return F.lit(1.0)
    steps = F.array(*[F.array(*map(F.lit, residual)) for residual in history])

    def step(r: Column, residual: Column) -> Column:
        pull = F.aggregate(F.zip_with(p, residual, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y) / GRAIN
        return F.greatest(r - pull, F.lit(least))

    return F.aggregate(steps, F.lit(1.0), step)


@dataclass
class Mix:
    """A solved mixture; ``totals`` are the expected tokens by domain, which the targets times the budget were to be."""

    model: DomainModel
    history: list[list[float]]
    goal: list[float]
    totals: list[float]
    #: The bound of rates from below: 1 if no document is to be thinned out.
    least: float = 0.0


def solve_mix(docs: DataFrame, model: DomainModel, targets: dict[str, float], budget: float | str = "same", text: str = "text", steps: int = 60, tolerance: float = 1e-4) -> Mix:
    """Rates of least squares for ``targets``, shares by domain (others get 0; they need not add up to 1).

    ``budget`` is the number of tokens to aim at: "same" as all documents have, or
    "cover", the least with which no domain is thinned out; no document's rate is then below 1,
    whatever its posterior, so each is kept. Domains without any
    expected token are beyond reach and left out of the goal. A target above 0 of a domain
    that a fitted model doesn't have is an error.
    """
    unknown = sorted(x for x, share in targets.items() if share > 0 and x not in model.domains)
    if unknown and model.domains != [""]:
        raise ValueError(f"no labelled documents of the target domains {unknown}")
    d = range(len(model.domains))
    cells = store(model.place(docs.select(text), text, "n", "p").groupBy("p").agg(F.sum("n").cast("double").alias("n")))

    def totals(rate: Column) -> list[float]:
        row = cells.select("n", "p", rate.alias("r")).agg(*[F.sum(F.col("n") * F.col("r") * F.element_at("p", k + 1) / GRAIN) for k in d]).first()
        return [x or 0.0 for x in row]

    have = totals(F.lit(1.0))
    wanted = [targets.get(x, 0.0) * (have[k] > 0) for k, x in enumerate(model.domains)]
    share = sum(wanted) or 1.0
    wanted = [w / share for w in wanted]
    least = 1.0 if budget == "cover" else 0.0
    if budget == "same":
        budget = sum(have)
    elif budget == "cover":
        budget = max((have[k] / wanted[k] for k in d if wanted[k] > 0), default=0.0)
    goal = [w * budget for w in wanted]
    # Squares are taken relative to what a domain has, and lengths of steps relative to a document's tokens; as
    # posteriors add up to 1, the curvature is then that of a stochastic matrix, and a step of 1 always descends.
    history, reached = [], have
    for _ in range(steps):
        residual = [reached[k] - goal[k] for k in d]
        if max(map(abs, residual)) <= tolerance * max(sum(goal), 1.0):
            break
        history.append([residual[k] / max(have[k], 1.0) for k in d])
        reached = totals(_rate(F.col("p"), history, least))
    return Mix(model, history, goal, reached, least)


def apply_mix(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, posterior (array in the order of domains), rate and copies.

    copies is the rate, rounded up or down by a hash of id and text so that its expectation is the rate.
    A null or empty text has no words and the priors as its posterior; a null id is hashed like any
    other; rows that repeat are documents in their own right. An input column that is called like
    a new one is replaced; an empty table gives an empty result.
    """
    new = ["n_tokens", "posterior", "rate", "copies"]
    plain = without(docs.columns, *new)
    (p,) = fresh([*plain, *new], "_p")
    rows = mix.model.place(docs.select(plain), text, "n_tokens", p).withColumn("rate", _rate(F.col(p), mix.history, mix.least))
    chance = F.pmod(F.xxhash64(F.col(id_col), F.col(text)), F.lit(1 << 24)) / float(1 << 24)
    copies = (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int") + _barrier()).cast("int")
    return rows.select(*plain, "n_tokens", F.transform(p, lambda x: x / GRAIN).alias("posterior"), "rate", copies.alias("copies"))


def labelled_domains(docs: DataFrame, labels: DataFrame, domain: str = "lang", limit: int = TRAIN_ROWS) -> DataFrame:
    """(text, domain) of at most ``limit`` documents that the labelled table lists."""
    sample = F.broadcast(labelled_sample(labels, "quality", limit).select("doc_id"))
    return docs.join(sample, "doc_id").select("text", F.col(domain).alias("domain"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document with its posterior over languages, and the rate at which language totals match TARGETS."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    model = train_domains(labelled_domains(docs, labels))
    mix = solve_mix(docs, model, TARGETS)
    return apply_mix(docs.select("doc_id", "text"), mix).drop("text")
