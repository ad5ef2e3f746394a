"""Toxicity: Levenshtein automata over a lexicon trie, weighed by the words around a match.

The lexicon is learnt from labelled documents: words, and stems that open many
words, which stand in toxic documents far too often for chance. A stem may well open a word of
a clean document once; what tells is that it does so again and again. The trie of the
lexicon is run against the Levenshtein automaton of every term at once: a state is a
set of trie nodes with the edits spent on each, made deterministic, so that one table
lookup a byte tells for every word which term it is, or is a misspelling of.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out, labelled_sample, labelled_texts, store, without
from .words import NOT_ALNUM, Block, blocks, find_words, lower_latin

#: Labelled rows that lexicon and weights are fitted on, at most.
TRAIN_ROWS = 8_000
#: How much likelier a term must be in toxic documents than in others.
LIKELIER = 9
THRESHOLD = 0.3
#: Words on either side of a match that its context is made of.
WINDOW = 6
#: Digits and signs that commonly stand for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
#: Words of reporting, which make a match near them likelier a quotation.
REPORTING = ("said", "says", "wrote", "writes", "called", "quote", "quoted", "quotes", "term", "word", "reported")
#: Words of address, which make a match near them likelier abuse.
ADDRESS = ("you", "your", "youre", "u", "ur")
_QUOTES = ('"', "'", "“", "”", "‘", "’", "«", "»")

_WORD = re.compile(r"(?:[^\W_]|@)+")
_FOLD = np.arange(256, dtype=np.uint8)
for _sign, _letter in LOOKALIKES.items():
    _FOLD[ord(_sign)] = ord(_letter)
_SEPARATORS = NOT_ALNUM.copy()
_SEPARATORS[ord("@")] = False


def edits_for(term: str) -> int:
    """Edits that a misspelling of ``term`` may have: 1 from five ASCII letters on, 2 from nine on, else 0."""
    return 0 if not term.isascii() or len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass
class LexiconAutomaton:
    """A deterministic automaton over bytes that accepts terms, their misspellings, and words that a stem opens.

    After a word, ``exact[state]`` and ``fuzzy[state]`` are the number of the term that
    it is or nearly is, or -1; ``stem[state]`` is the stem that opens it. State 0 is dead.
    """

    words: list[str]
    stems: list[str]
    table: np.ndarray = field(init=False)
    classes: np.ndarray = field(init=False)
    exact: np.ndarray = field(init=False)
    fuzzy: np.ndarray = field(init=False)
    stem: np.ndarray = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}  # trie node -> word
        reach: list[set[int]] = [set()]  # of each node: the edits that words below it allow

        def insert(text: bytes) -> list[int]:
            node, path = 0, [0]
            for b in text:
                if b not in children[node]:
                    children.append({})
                    reach.append(set())
                    children[node][b] = len(children) - 1
                node = children[node][b]
                path.append(node)
            return path

        for i, word in enumerate(self.words):
            path = insert(word.encode())
            ends[path[-1]] = i
            for node in path:
                reach[node].add(edits_for(word))
        most = [max(x, default=0) for x in reach]
        stem_children: list[dict[int, int]] = [{}]
        stem_ends: dict[int, int] = {}
        for i, text in enumerate(self.stems):
            node = 0
            for b in text.encode():
                if b not in stem_children[node]:
                    stem_children.append({})
                    stem_children[node][b] = len(stem_children) - 1
                node = stem_children[node][b]
            stem_ends.setdefault(node, i)

        alphabet = sorted({b for x in (children, stem_children) for node in x for b in node})
        self.classes = np.zeros(256, np.int64)  # 0: a byte that no term has
        for k, b in enumerate(alphabet, 1):
            self.classes[b] = k

        def closed(items: dict[int, int]) -> frozenset:
            """Adds what skipping letters of a term leads to; keeps the fewest edits of each node."""
            best, todo = dict(items), list(items.items())
            while todo:
                node, e = todo.pop()
                if best[node] < e:
                    continue
                for child in children[node].values():
                    if e + 1 <= most[child] and e + 1 < best.get(child, 99):
                        best[child] = e + 1
                        todo.append((child, e + 1))
            return frozenset(best.items())

        def after(state: frozenset, b: int | None) -> frozenset:
            best: dict[int, int] = {}

            def reach_node(node: int, e: int) -> None:
                if e <= most[node] and e < best.get(node, 99):
                    best[node] = e

            for node, e in state:
                for letter, child in children[node].items():
                    reach_node(child, e if letter == b else e + 1)
                reach_node(node, e + 1)
            return closed(best)

        # a state: the trie's nodes with edits, the node of the stems' trie or None, and the stem found or -1
        start = (closed({0: 0}), 0, -1)
        number, queue, rows = {start: 1}, [start], [np.zeros(len(alphabet) + 1, np.int64)]
        for state in queue:
            nodes, at, found = state
            row = np.zeros(len(alphabet) + 1, np.int64)
            for k in range(len(alphabet) + 1):
                b = alphabet[k - 1] if k else None
                child = stem_children[at].get(b) if at is not None else None
                to = (after(nodes, b), child, found if found >= 0 else stem_ends.get(child, -1))
                if not to[0] and to[1] is None and to[2] < 0:
                    continue
                if to not in number:
                    number[to] = len(number) + 1
                    queue.append(to)
                row[k] = number[to]
            rows.append(row)
        self.table = np.stack(rows)
        self.exact, self.fuzzy, self.stem = (np.full(len(rows), -1) for _ in range(3))
        for (nodes, _, found), i in number.items():
            hits = sorted((e, ends[node]) for node, e in nodes if node in ends and e <= edits_for(self.words[ends[node]]))
            if hits and hits[0][0] == 0:
                self.exact[i] = hits[0][1]
            elif hits:
                self.fuzzy[i] = hits[0][1]
            self.stem[i] = found
        self.longest = max([len(w.encode()) + edits_for(w) for w in self.words] + [len(s.encode()) for s in self.stems], default=0)

    def run(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The state after each word; 0 for words that no term is near."""
        state = np.ones(len(start), np.int64)
        size = end - start
        # a longer word can only be opened by a stem: its first bytes are enough for that, and its last state accepts no word
        live = np.arange(len(start))
        for k in range(self.longest + 1):
            live = live[size[live] > k]
            if not len(live):
                break
            state[live] = self.table[state[live], self.classes[data[start[live] + k]]]
            live = live[state[live] > 0]
        return state


@dataclass
class ToxicityModel:
    automaton: LexiconAutomaton
    word_weight: np.ndarray
    stem_weight: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(EVIDENCE) + 1))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(x @ self.weights[1:] + self.weights[0])))


#: Sums of what matches weigh: by kind; of those in quotation marks, near words of reporting, and near words of address or
#: other matches; the strongest match; and all of them for the length of the text. What each tells is fitted.
EVIDENCE = ("exact", "fuzzy", "stem", "quoted", "reported", "addressed", "strongest", "density")


def _near(flags: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[np.minimum(at + WINDOW + 1, hi)] - total[np.maximum(at - WINDOW, lo)]


def evidence(block: Block, model: ToxicityModel) -> np.ndarray:
    """A row of EVIDENCE for each document: weights of its matches by kind, and how their surroundings read."""
    data = _FOLD[lower_latin(block.data)]
    words = find_words(Block(block.lo, block.hi, lower_latin(block.data), block.offsets), _SEPARATORS)
    a = model.automaton
    state = a.run(data, words.start, words.end)
    exact, fuzzy, stem = a.exact[state], a.fuzzy[state], a.stem[state]
    at = np.flatnonzero((exact >= 0) | (fuzzy >= 0) | (stem >= 0))
    out = np.zeros((len(block), len(EVIDENCE)))
    if not len(at):
        return out
    doc = np.searchsorted(words.first, at, "right") - 1
    exact, fuzzy, stem = exact[at], fuzzy[at], stem[at]
    weight = lambda table, i: np.where(i >= 0, table[np.maximum(i, 0)] if len(table) else 0.0, 0.0)
    value = [weight(model.word_weight, exact), weight(model.word_weight, np.where(exact < 0, fuzzy, -1)), weight(model.stem_weight, np.where((exact < 0) & (fuzzy < 0), stem, -1))]
    strength = np.sum(value, axis=0)

    lo, hi = words.first[doc], words.first[doc + 1]
    text = data.tobytes()
    context = np.unique(np.concatenate([np.arange(max(l, i - WINDOW), min(h, i + WINDOW + 1)) for i, l, h in zip(at, lo, hi, strict=True)]))
    reporting, address, matched = (np.zeros(len(words.start), bool) for _ in range(3))
    matched[at] = True
    says, turns = {w.encode() for w in REPORTING}, {w.encode() for w in ADDRESS}
    for i in context.tolist():
        word = text[words.start[i] : words.end[i]]
        reporting[i], address[i] = word in says, word in turns
    original = block.data.tobytes()
    quoted = np.zeros(len(at))
    for n, i in enumerate(at.tolist()):
        first, last = max(lo[n], i - WINDOW), min(hi[n], i + WINDOW + 1) - 1
        before = original[words.start[first] : words.start[i]].decode("utf-8", "replace")
        behind = original[words.end[i] : words.end[last]].decode("utf-8", "replace")
        quoted[n] = any(q in before for q in _QUOTES) and any(q in behind for q in _QUOTES)
    told = _near(reporting, at, lo, hi) > 0
    hostile = _near(address, at, lo, hi) + _near(matched, at, lo, hi) > 1
    sums = [*value, strength * quoted, strength * told, strength * hostile]
    for k, v in enumerate(sums):
        out[:, k] = np.log1p(np.bincount(doc, v, len(block)))
    np.maximum.at(out[:, 6], doc, strength)
    out[:, 7] = np.log1p(100 * np.bincount(doc, strength, len(block)) / np.maximum(np.diff(words.first), 20))
    return out


def _surprise(toxic: int, clean: int, share: float) -> float:
    """log10 of the chance that so many of the documents that hold a term are toxic (at most; Chernoff's bound)."""
    n = toxic + clean
    p = toxic / n
    if p <= share:
        return 0.0
    divergence = p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0.0)
    return -n * divergence / math.log(10)


def _counted_words(sample: DataFrame, stems: set[str] | None) -> DataFrame:
    """(label, word, n, words) of each document of (label, text) rows: each of its words of three letters and more, or each of ``stems`` that opens some, with the
    number of places and of different words. The empty word stands for all of a document's words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, str, int, int]] = []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = Counter(_WORD.findall((text or "").lower()))
                rows.append((label, "", words.total(), len(words)))
                found: dict[str, list[int]] = {}
                for word, n in words.items():
                    for term in [word] if stems is None else [word[:k] for k in range(3, len(word)) if word[:k] in stems]:
                        if len(term) >= 3:
                            at = found.setdefault(term, [0, 0])
                            at[0] += n
                            at[1] += 1
                rows.extend((label, term, n, different) for term, (n, different) in found.items())
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["label", "word", "n", "words"])

    return sample.select("label", "text").mapInArrow(run, "label int, word string, n long, words long")


def _one_of_copies(sample: DataFrame) -> DataFrame:
    """(label, text) rows of which near copies, that have the smallest hash of their five-word shingles in common, are one.

    Else the words of a text that was copied often would tell as much as those that many texts have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = []
            for text in batch.column(1).to_pylist():
                words = _WORD.findall((text or "").lower())
                least.append(min(zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(len(words) - 4, 1))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=["label", "text", "family"])

    families = sample.select("label", "text").mapInArrow(run, "label int, text string, family long")
    return families.groupBy("label", "family").agg(F.min("text").alias("text"))


def learn_lexicon(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with their log odds, from (label, text) rows: those too toxic for chance.

    A term tells by the documents that have it, by those that have it twice and more, or, where two toxic
    ones do, by the different words that it opens in each document. Chance is
    Chernoff's bound, near copies being one document, held against the number of candidates: half a term is expected by chance.
    A stem opens at least three words of toxic documents, and stands for all that it opens.
    The sample is bounded, and so are the terms.
    """
    sample = store(_one_of_copies(sample))
    held = store(_counted_words(sample, None))
    totals = {r["label"]: (r["docs"], r["words"] or 0) for r in held.groupBy("label").agg(F.count_if(F.col("word") == "").alias("docs"), F.sum(F.when(F.col("word") == "", F.col("n"))).alias("words")).collect()}
    held = held.where("word <> ''")
    if 1 not in totals or 0 not in totals:
        return {}, {}
    (n1, words1), (n0, words0) = totals[1], totals[0]
    share = n1 / (n0 + n1)
    def tested(rows: DataFrame, key: str) -> dict[str, tuple]:
        """By term: toxic and clean documents that have it, that have it twice, the words that it opens in them, and its log odds a word."""
        of = lambda label, least: F.count_if((F.col("label") == label) & (F.col("n") >= least))
        sums = [F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0)) for label in (1, 0)]
        opened = [F.sum(F.when(F.col("label") == label, F.col("words")).otherwise(0)).alias(name) for label, name in ((1, "tw"), (0, "cw"))]
        odds = F.log((sums[0] + 0.5) / (words1 + 1)) - F.log((sums[1] + 0.5) / (words0 + 1))
        found = rows.groupBy(key).agg(of(1, 1).alias("t1"), of(0, 1).alias("c1"), of(1, 2).alias("t2"), of(0, 2).alias("c2"), *opened, odds.alias("odds"))
        return {r[0]: tuple(r)[1:] for r in found.where("t1 >= 3 AND odds > 0").collect()}

    def telling(counts: tuple, bar: float) -> bool:
        t1, c1, t2, c2, tw, cw, _ = counts
        by_documents = any(t / n1 >= LIKELIER * c / n0 and _surprise(t, c, share) < bar for t, c in ((t1, c1), (t2, c2)) if t)
        return by_documents or (t2 >= 2 and t2 / n1 >= LIKELIER * c2 / n0 and tw / words1 >= LIKELIER * cw / max(words0, 1) and _surprise(tw, cw, words1 / (words0 + words1)) < bar)

    every = held.groupBy("word").agg(F.count(F.lit(1)).alias("docs")).where("docs >= 3").count()
    bar = math.log10(0.5 / max(every, 1))
    lexicon = {w: c[-1] for w, c in tested(held, "word").items() if telling(c, bar)}
    # stems, by what the words that they open add up to; no single word may make most of it
    opens = F.transform(F.sequence(F.lit(3), F.length("word") - 1), lambda k: F.substring("word", F.lit(1), k))
    by_word = held.groupBy("word").agg(*[F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0)).alias(name) for label, name in ((1, "toxic"), (0, "clean"))])
    opened = by_word.where(F.length("word") > 3).select("toxic", "clean", F.explode(opens).alias("stem")).groupBy("stem").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.max("toxic").alias("largest"), F.count_if(F.col("toxic") > 0).alias("words")
    )
    likelier = F.col("toxic") * max(words0, 1) >= F.lit(LIKELIER) * F.col("clean") * max(words1, 1)
    promising = {r["stem"] for r in opened.where(likelier & F.expr("toxic >= 3 AND words >= 3 AND largest <= 0.8 * toxic")).select("stem").collect()}
    candidates = tested(_counted_words(sample, promising).where("word <> ''"), "word")
    bar = math.log10(0.5 / max(every, len(candidates), 1))
    good = {p: c for p, c in candidates.items() if telling(c, bar)}
    stems: dict[str, float] = {}
    for p in sorted(good, key=lambda p: (len(p), p)):
        if not p.startswith(tuple(stems)):
            # as long as it can be without losing what it stands for
            p = max((q for q in good if q.startswith(p) and good[q][0] >= 0.95 * good[p][0]), key=lambda q: (len(q), q))
            stems[p] = good[p][-1]
    lexicon = {w: v for w, v in sorted(lexicon.items()) if not w.startswith(tuple(stems))}
    return lexicon, stems


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights, the intercept first, by Newton's method."""
    z = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train_toxicity(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> ToxicityModel:
    """Lexicon and weights from at most ``limit`` labelled documents that are not held out.

    Without labels of both kinds the lexicon is empty and every score is the smoothed share of toxic rows.
    """
    sample = store(labelled_texts(docs, labelled_sample(labels, "toxic", limit)))
    lexicon, stems = learn_lexicon(sample)
    model = ToxicityModel(LexiconAutomaton(list(lexicon), list(stems)), np.array(list(lexicon.values())), np.array(list(stems.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                x = evidence(block, model)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, len(block)), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["label", "x"])

    found = sample.mapInArrow(run, "label int, x array<double>").toPandas()
    x, y = np.array(found["x"].tolist(), np.float64).reshape(len(found), len(EVIDENCE)), found["label"].to_numpy(np.float64)
    if len(y) == 0 or y.min() == y.max():
        prior = (y.sum() + 0.5) / (len(y) + 1)
        model.weights[0] = math.log(prior / (1 - prior))
        return model
    order = np.lexsort([y, *x.T])
    model.weights = _logistic(x[order], y[order])
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with toxicity, a double from 0 to 1.

    A null text counts as empty, and empty texts have a score too. Ids play no part: rows with a
    null id and rows that repeat are scored like any other. An input column that is called
    toxicity is replaced; an empty table gives an empty result.
    """
    place = docs.columns.index(text_col)
    plain = without(docs.columns, "toxicity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.scores(evidence(block, model)) for block in blocks(batch.column(place))]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in plain), pa.array(score)], names=[*plain, "toxicity"])

    return docs.mapInArrow(run, docs.select(plain).schema.add("toxicity", "double", False))


def op5_toxicity(spark, sf_dir: str, threshold: float = THRESHOLD) -> DataFrame:
    """Every document scored for toxicity: doc_id, held_out, score, predicted."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    scored = score_toxicity(docs.select("doc_id", "text"), train_toxicity(docs, labels)).withColumnRenamed("toxicity", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
