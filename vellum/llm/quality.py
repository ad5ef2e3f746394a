"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature has a lookup table over its bins, and so has each chosen pair of
features. Shallow trees are boosted cyclically, one feature at a time with a small
step, and each tree is added into the table of its feature; pairs follow on what
single features leave over. A score is a sum of table entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out, labelled_sample, labelled_texts, without
from .words import Block, blocks, byte_table, find_words, hash_words, per_doc_sum

#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 20_000
THRESHOLD = 0.7
FEATURES = (
    "log_words", "word_bytes", "upper", "digits", "bang", "odd_symbols", "pipes", "marks", "spaces", "lines", "beyond_ascii",
    "repeat_1", "repeat_2", "distinct", "repeated_lines", "capital_words", "longest_word", "odd_endings", "short_words", "full_stops", "byte_run",
)

_UPPER, _LETTER = byte_table(bytes(range(65, 91))), byte_table(bytes([*range(65, 91), *range(97, 123)]))
_DIGIT, _BANG, _PIPE, _STOP, _LINE = (byte_table(x) for x in (b"0123456789", b"!", b"|", b".?", b"\n"))
_ODD, _MARK, _SPACE = byte_table(b"#$%&*@^~<>{}[]\\=_"), byte_table(b".,;:!?\"'()-"), byte_table(b" \t\r\n")


def features(block: Block) -> np.ndarray:
    """A row of FEATURES for each document of a block; a text without words has zeros."""
    data, offsets, words = block.data, block.offsets, find_words(block)
    n_bytes, n_words = np.maximum(np.diff(offsets), 1), np.diff(words.first)
    per_word, docs = np.maximum(n_words, 1), words.doc
    hashes, size = hash_words(data, words), words.end - words.start

    def of_bytes(table: np.ndarray) -> np.ndarray:
        return per_doc_sum(table[data], offsets)

    def of_words(flags: np.ndarray) -> np.ndarray:
        return per_doc_sum(flags, words.first) / per_word

    def repeats(values: np.ndarray, owner: np.ndarray, lag: int) -> np.ndarray:
        same = np.zeros(len(values), bool)
        same[lag:] = (values[lag:] == values[:-lag]) & (owner[lag:] == owner[:-lag])
        return same

    def distinct(values: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct values of each document, by a sort of document number and hash in one integer."""
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first)).astype(np.uint64)
        bits = np.uint64(max(1, int(len(first)).bit_length()))
        keys = np.sort((owner << (np.uint64(64) - bits)) | (values >> bits))
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        return per_doc_sum(new, first)

    lines = find_words(block, byte_table(b"\n"))
    n_lines = np.maximum(np.diff(lines.first), 1)
    first_letter = words.start
    second = np.minimum(words.start + 1, max(len(data) - 1, 0))
    capital = _UPPER[data[first_letter]] & _UPPER[data[second]] & (size > 1) if len(data) else np.zeros(0, bool)
    last = data[words.end - 1] if len(data) else data
    longest = np.zeros(len(block), np.int64)
    np.maximum.at(longest, docs, size)
    run = np.zeros(len(data), bool)
    run[3:] = (data[3:] == data[2:-1]) & (data[2:-1] == data[1:-2]) & (data[1:-2] == data[:-3]) if len(data) > 3 else False
    letters = np.maximum(of_bytes(_LETTER), 1)
    columns = [
        np.log1p(n_words), per_doc_sum(size, words.first) / per_word, of_bytes(_UPPER) / letters, of_bytes(_DIGIT) / n_bytes, of_bytes(_BANG) / per_word,
        of_bytes(_ODD) / per_word, of_bytes(_PIPE) / per_word, of_bytes(_MARK) / per_word, of_bytes(_SPACE) / n_bytes, of_bytes(_LINE) / per_word,
        per_doc_sum(data >= 128, offsets) / n_bytes, of_words(repeats(hashes, docs, 1)), of_words(repeats(hashes, docs, 2)),
        distinct(hashes, words.first) / per_word, 1 - distinct(hash_words(data, lines), lines.first) / n_lines, of_words(capital), np.log1p(longest),
        of_words(_ODD[last] | _BANG[last]), of_words(size <= 2), of_bytes(_STOP) / per_word, per_doc_sum(run, offsets) / n_bytes,
    ]
    out = np.stack(columns, axis=1).astype(np.float64) if len(block) else np.zeros((0, len(FEATURES)))
    out[n_words == 0] = 0
    return out


@dataclass
class AdditiveModel:
    """Bin edges and a table of log odds for each feature, and tables over coarser bins for pairs of features."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edges, x[:, k], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-z))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between distinct values, at quantiles; a feature of one value has none."""
    values, counts = np.unique(x, return_counts=True)
    if len(values) < 2:
        return np.zeros(0)
    middles = (values[1:] + values[:-1]) / 2
    if len(middles) < bins:
        return middles
    share = np.cumsum(counts)[:-1] / len(x)
    return np.unique(middles[np.searchsorted(share, np.arange(1, bins) / bins).clip(0, len(middles) - 1)])


def _leaves(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, depth: int = 2) -> np.ndarray:
    """Leaf values over ordered bins of the best tree of ``depth``, from sums of gradients and curvatures."""
    if depth == 0 or len(g) < 2:
        return np.full(len(g), _leaves(g.sum(), h.sum(), ridge))
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    at = int(np.argmax(gl**2 / (hl + ridge) + gr**2 / (hr + ridge))) + 1
    return np.concatenate([_tree(g[:at], h[:at], ridge, depth - 1), _tree(g[at:], h[at:], ridge, depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Leaf values over a grid of the best cut in both directions (four leaves), and its gain."""
    if min(g.shape) < 2:
        return np.zeros(g.shape), 0.0
    cg, ch = (np.cumsum(np.cumsum(x, 0), 1) for x in (g, h))
    gain, corners = 0.0, []
    for rows in (0, 1):
        for cols in (0, 1):
            g4, h4 = (_corner(c, rows, cols) for c in (cg, ch))
            corners.append(g4 / (h4 + ridge))
            gain = gain + g4**2 / (h4 + ridge)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty(g.shape)
    for (a, b), leaf in zip(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), corners, strict=True):
        out[a, b] = leaf[i, j]
    return out, float(gain[i, j])


def _corner(c: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Sums of one of the four corners, for every cut, from sums of the upper left corner."""
    upper_left, left, top, total = c[:-1, :-1], c[-1:, :-1], c[:-1, -1:], c[-1, -1]
    return [[upper_left, top - upper_left], [left - upper_left, total - left - top + upper_left]][rows][cols]


def fit_additive(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 6, rate: float = 0.1, ridge: float = 2.0, bins: int = 48, pair_bins: int = 8) -> AdditiveModel:
    """Cyclic boosting of single features, then of the pairs that explain most of what is left.

    Without rows, or with labels of one kind only, the model is the smoothed share of label 1.
    """
    prior = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(prior / (1 - prior)))
    width = x.shape[1]
    edges, coarse = [_edges(x[:, k], bins) for k in range(width)], [_edges(x[:, k], pair_bins) for k in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = AdditiveModel(start, edges, tables, [], coarse, [])
    if len(y) == 0 or y.min() == y.max():
        return model
    at = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)]
    z = np.full(len(y), start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k in range(width):
            g, h = slopes()
            n = len(tables[k])
            step = rate * _tree(np.bincount(at[k], g, n), np.bincount(at[k], h, n), ridge)
            tables[k] += step
            z += step[at[k]]
    grid = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(coarse)]

    def sums(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        cell = grid[a] * shape[1] + grid[b]
        g, h = slopes()
        return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape), cell

    gains = sorted(((-_pair_tree(*sums(a, b)[:2], ridge)[1], a, b) for a in range(width) for b in range(a + 1, width)))
    model.pairs = [(a, b) for gain, a, b in gains[:n_pairs] if gain < 0]
    model.pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for table, (a, b) in zip(model.pair_tables, model.pairs, strict=True):
            g, h, cell = sums(a, b)
            step = rate * _pair_tree(g, h, ridge)[0]
            table += step
            z += step.ravel()[cell]
    return model


def train_quality(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> AdditiveModel:
    """A model from at most ``limit`` labelled documents that are not held out (see ``labelled_sample``)."""
    rows = labelled_texts(docs, labelled_sample(labels, "quality", limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                label = batch.column(0).slice(block.lo, len(block))
                x = features(block)
                yield pa.RecordBatch.from_arrays([label, pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["label", "x"])

    found = rows.mapInArrow(run, "label int, x array<double>").toPandas()
    # rows come in any order; sums of floats shall not depend on it
    x = np.array(found["x"].tolist(), np.float64).reshape(len(found), len(FEATURES))
    y = found["label"].to_numpy(np.float64)
    order = np.lexsort([y, *x.T])
    return fit_additive(x[order], y[order])


def score_quality(docs: DataFrame, model: AdditiveModel, text_col: str = "text") -> DataFrame:
    """``docs`` with quality_score, a double from 0 to 1.

    A null text counts as empty, and empty texts have a score too. Ids play no part: rows with a
    null id and rows that repeat are scored like any other. An input column that is called
    quality_score is replaced; an empty table gives an empty result.
    """
    place = docs.columns.index(text_col)
    plain = without(docs.columns, "quality_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.scores(features(block)) for block in blocks(batch.column(place))]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in plain), pa.array(score)], names=[*plain, "quality_score"])

    schema = docs.select(plain).schema.add("quality_score", "double", False)
    return docs.mapInArrow(run, schema)


def op3_quality(spark, sf_dir: str, threshold: float = THRESHOLD) -> DataFrame:
    """Every document scored for quality: doc_id, held_out, score, predicted."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    scored = score_quality(docs.select("doc_id", "text"), train_quality(docs, labels)).withColumnRenamed("quality_score", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
