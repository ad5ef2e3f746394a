import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm.mixing import GRAIN, TARGETS, apply_mix, labelled_domains, solve_mix, train_domains

from .conftest import odd_rows


@pytest.fixture(scope="module")
def model(documents, labels):
    return train_domains(labelled_domains(documents, labels))


def test_posteriors_tell_languages_and_add_up(documents, model):
    placed = model.place(documents.select("doc_id", "text", "lang"), "text", "n", "p").collect()
    right = 0
    for r in placed:
        assert sum(r["p"]) == GRAIN and min(r["p"]) >= 0 and r["n"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        right += model.domains[int(np.argmax(r["p"]))] == r["lang"]
    assert right > 0.9 * len(placed)


@pytest.mark.parametrize("budget", ["same", "cover", 5000.0])
def test_expected_totals_match_the_targets(documents, model, budget):
    mix = solve_mix(documents, model, TARGETS, budget)
    rows = apply_mix(documents, mix).collect()
    totals = np.zeros(len(model.domains))
    for r in rows:
        assert r["rate"] >= 0 and r["copies"] in (math.floor(r["rate"]), math.floor(r["rate"]) + 1)
        totals += r["n_tokens"] * r["rate"] * np.array(r["posterior"])
    share = np.array([TARGETS[x] for x in model.domains]) / sum(TARGETS.values())
    assert np.allclose(totals / totals.sum(), share, atol=2e-3)
    tokens = sum(r["n_tokens"] for r in rows)
    assert totals.sum() == pytest.approx({"same": tokens}.get(budget, budget if budget != "cover" else totals.sum()), rel=2e-3)
    if budget == "cover":
        assert min(r["rate"] for r in rows) > 0.98


def test_rates_are_the_least_squares_of_numpy(documents, model):
    """The same steps, document by document."""
    mix = solve_mix(documents, model, TARGETS)
    rows = apply_mix(documents, mix).orderBy("doc_id").collect()
    n, p = np.array([r["n_tokens"] for r in rows], float), np.array([r["posterior"] for r in rows])
    have, rate = (n[:, None] * p).sum(0), np.ones(len(rows))
    for _ in mix.history:
        reached = (n[:, None] * p * rate[:, None]).sum(0)
        rate = np.maximum(rate - p @ ((reached - np.array(mix.goal)) / have), 0)
    assert np.allclose(rate, [r["rate"] for r in rows], atol=1e-9)


def test_odd_rows(odd, none, model, spark):
    mix = solve_mix(odd, model, TARGETS)
    rows = apply_mix(odd, mix).collect()
    assert len(rows) == len(odd_rows()) and all(r["rate"] >= 0 and r["copies"] is not None for r in rows if r["text"] is not None)
    assert apply_mix(none, solve_mix(none, model, TARGETS)).count() == 0
    blank = train_domains(spark.createDataFrame([("a", None)], "text string, domain string"))
    assert blank.domains == [""]
    assert {r["rate"] for r in apply_mix(odd, solve_mix(odd, blank, {"": 1.0})).collect()} == {1.0}


def test_copies_have_their_rate_as_expectation(spark, model):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the cat "), F.col("id").cast("string")).alias("text"))
    mix = solve_mix(docs, model, TARGETS, budget=4000 * 3 * 0.3)
    got = apply_mix(docs, mix).agg(F.avg("copies"), F.avg("rate")).first()
    assert got[0] == pytest.approx(got[1], abs=0.04)


def test_cover_thins_out_no_document(spark, documents, model):
    """Short texts and texts of two languages raise the binding domain as scarce ones are repeated; none goes below 1."""
    rows = documents.select("text", "lang").orderBy("doc_id").limit(150).collect()
    by = {x: [r["text"].split(" ") for r in rows if r["lang"] == x] for x in ("en", "fr", "de", "es")}
    texts = [" ".join(w[:60]) for x in by for w in by[x]]
    texts += [" ".join(w[:k]) for k in (1, 2, 3, 5) for w in by["en"] + by["fr"]]
    texts += [" ".join(a[:n] + b[:n]) for n in (4, 12, 30) for a in by["en"][:12] for x in ("fr", "de", "es") for b in by[x][:4]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = apply_mix(docs, solve_mix(docs, model, TARGETS, "cover")).agg(F.min("rate"), F.min("copies"), F.count("*")).first()
    assert got[0] >= 1 and got[1] >= 1 and got[2] == len(texts)


def test_every_domain_is_trained(spark):
    rows = [(10 * k + i, f"word{k} term{k} thing{k} name{k}", f"d{k:02d}") for k in range(11) for i in range(10 - k // 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    many = train_domains(docs)
    assert many.domains == [f"d{k:02d}" for k in range(11)]
    placed = many.place(docs, "text", "n", "p").collect()
    assert all(many.domains[int(np.argmax(r["p"]))] == r["domain"] and sum(r["p"]) == GRAIN for r in placed)
    with pytest.raises(ValueError, match="other"):
        solve_mix(docs, many, {"d00": 0.5, "other": 0.5})
