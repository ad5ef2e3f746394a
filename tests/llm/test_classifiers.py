"""Quality and toxicity."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.llm.quality import FEATURES, features, fit_additive, score_quality, train_quality
from vellum.llm.queries import QUERIES
from vellum.llm.shared import held_out, labelled_sample
from vellum.llm.toxicity import LexiconAutomaton, edits_for, score_toxicity, train_toxicity
from vellum.llm.words import blocks

from .conftest import odd_rows


def test_held_out_is_the_crc_of_the_digits(spark):
    ids = [0, 5, 123456, -3, None]
    got = {r["i"]: r["h"] for r in spark.createDataFrame([(i,) for i in ids], "i long").select("i", held_out(F.col("i")).alias("h")).collect()}
    assert got == {i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids}


def test_labelled_sample_is_bounded_and_holds_nothing_back(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(500)] + [(None, 1), (3, None), (4, 1)], "doc_id long, quality int")
    got = labelled_sample(rows, "quality", 50).collect()
    assert len(got) == 50 == len({r["doc_id"] for r in got})
    assert not any(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in got)
    assert got == labelled_sample(rows.repartition(7), "quality", 50).collect()


def test_features_of_a_block():
    (block,) = blocks(pa.array(["AB cd cd!\nAB cd cd!", "", None, "é é é é"]))
    x = {n: features(block)[:, k] for k, n in enumerate(FEATURES)}
    assert x["log_words"].tolist() == pytest.approx([np.log1p(6), 0, 0, np.log1p(4)])
    assert x["repeat_1"].tolist() == pytest.approx([0, 0, 0, 3 / 4])
    assert x["distinct"].tolist() == pytest.approx([3 / 6, 0, 0, 1 / 4])
    assert x["repeated_lines"].tolist() == [0.5, 0, 0, 0]
    assert x["capital_words"][0] == pytest.approx(2 / 6) and x["bang"][0] == pytest.approx(2 / 6)


def test_additive_model_learns_single_features_and_a_pair():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(4000, 4))
    y = ((x[:, 0] > 0.7) | ((x[:, 1] > 0.5) & (x[:, 2] > 0.5))).astype(float)
    model = fit_additive(x[:3000], y[:3000])
    assert (1, 2) in model.pairs
    assert ((model.scores(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97
    # a score is the sum of looked-up entries
    z = model.intercept + sum(t[np.searchsorted(e, x[0, k], "right")] for k, (e, t) in enumerate(zip(model.edges, model.tables)))
    z += sum(t[np.searchsorted(model.pair_edges[a], x[0, a], "right"), np.searchsorted(model.pair_edges[b], x[0, b], "right")] for (a, b), t in zip(model.pairs, model.pair_tables))
    assert model.scores(x[:1])[0] == pytest.approx(1 / (1 + np.exp(-z)))


def test_additive_model_without_examples():
    assert fit_additive(np.zeros((0, 3)), np.zeros(0)).scores(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert fit_additive(np.zeros((3, 3)), np.ones(3)).scores(np.ones((1, 3)))[0] == pytest.approx(3.5 / 4)


@pytest.mark.parametrize("name", ["op3_quality", "op5_toxicity"])
def test_held_out_accuracy(spark, name):
    sf = "/root/testdata/sf0.01"
    label = {"op3_quality": "quality", "op5_toxicity": "toxic"}[name]
    got = QUERIES[name](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    rows = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    by = {v: [r["predicted"] for r in rows if r[label] == v] for v in (0, 1)}
    assert np.mean(by[1]) > (0.95 if label == "quality" else 0.9) and np.mean(by[0]) < (0.1 if label == "quality" else 0.02)


@pytest.mark.parametrize(("train", "score", "out"), [(train_quality, score_quality, "quality_score"), (train_toxicity, score_toxicity, "toxicity")])
def test_classifiers_on_odd_rows(odd, none, labels, train, score, out):
    for known in (labels, labels.limit(0)):
        model = train(odd, known)
        got = score(odd, model)
        assert sorted(got.columns) == sorted(odd.columns)
        rows = got.collect()
        assert len(rows) == len(odd_rows()) and all(0 <= r[out] <= 1 for r in rows)
        assert score(none, model).count() == 0
    assert train(none, labels) is not None


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def test_automaton_accepts_what_the_distance_allows():
    random.seed(2)
    lexicon, stems = ["clown", "crown", "pathetic", "disgusting", "bad", "réeux"], ["lowei", "veq"]
    a = LexiconAutomaton(lexicon, stems)
    near = set(lexicon) | set(stems)
    for w in lexicon[:4]:
        for _ in range(150):
            s = list(w)
            for _ in range(random.choice([1, 1, 2, 3])):
                k = random.randrange(len(s) + 1)
                s[k : k + random.choice([0, 1])] = random.choice(["", "x", "o", "t"])
            near.add("".join(s))
    words = sorted(w for w in near | {"loweiung", "lowe", "veqx", "ve", "x" * 40, "bod", "réeu"} if w)
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    state = a.run(data, np.concatenate([[0], ends[:-1]]), ends)
    for w, s in zip(words, state):
        best = min(((distance(w, t), i) for i, t in enumerate(lexicon) if distance(w, t) <= edits_for(t)), default=None)
        assert (a.exact[s] >= 0) == (w in lexicon), w
        assert (a.exact[s] >= 0 or a.fuzzy[s] >= 0) == (best is not None), w
        assert (a.stem[s] >= 0) == any(w.startswith(t) for t in stems), w


def test_quotation_weighs_less_than_abuse(spark):
    insult, filler = "moronic", "the quiet river runs past old stone houses and gardens"
    rows = [(i, f"{filler} you are {insult} {i}" if i % 3 == 0 else f"{filler} {i}", int(i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = train_toxicity(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert insult in model.automaton.words
    said = [(0, f"{filler} you are {insult}"), (1, f'{filler} he said the word "{insult}" was reported'), (2, f"{filler} you are mor0nic"), (3, f"{filler} you are moroni"), (4, filler)]
    got = {r["doc_id"]: r["toxicity"] for r in score_toxicity(spark.createDataFrame(said, "doc_id long, text string"), model).collect()}
    assert got[0] > 0.9 and got[0] > got[1] and got[2] > 0.9 and got[4] < 0.1
    assert list(itertools.islice(model.automaton.stems, 5)) == []
