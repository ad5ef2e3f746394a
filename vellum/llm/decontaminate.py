"""Benchmark decontamination by spaced-seed hashing.

A mask is a short pattern of word positions, of which some are ignored. Every
window of words in a benchmark item and in a document is hashed under each mask
over the positions that count, so windows that differ only at ignored positions
still meet. Around each hit the document is compared with the whole item on the
same diagonal, which tolerates substituted words.

Benchmarks are small beside the documents they are searched in, so their hashes
travel to the documents, in blocks of a fixed number of items: the text of the
documents is never shuffled, and a larger benchmark takes more blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .shared import fresh

from .words import NOT_ALNUM, Block, blocks, find_words, hash_words, lower_latin, mix

#: 1 counts, 0 is ignored. Each mask counts six words; runs of ones differ, so one substitution rarely breaks all.
MASKS = ("111111", "11101011", "110110101")
#: Items of one block; its index takes about 1 kB an item.
BLOCK_ITEMS = 20_000
#: Items with fewer words are no evidence of a leak and match nothing.
MIN_ITEM_WORDS = 5
MATCHES = "start_word int, end_word int, matched_words int, item_words int, overlap double"


def _spaced(hashes: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash under ``mask`` of each window of words; shorter by the mask's span less 1."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt * 2 + 1, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out = out * np.uint64(0x9FB21C651E98DF25) + hashes[k : k + n]
    return mix(out)


@dataclass
class SeedIndex:
    """The hashes of a block of benchmark items, with the item and word position of each."""

    ids: list
    masks: list[str]
    words: np.ndarray
    first: np.ndarray
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    item: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    at: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    filter: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    @classmethod
    def build(cls, ids: list, texts: list, masks: tuple[str, ...] = MASKS) -> SeedIndex:
        """An item shorter than a mask is looked up whole instead."""
        block = next(blocks(pa.array(texts, pa.large_string()), 1 << 62), None) if texts else None
        if block is None:
            return cls(ids, [], np.zeros(0, np.uint64), np.zeros(len(ids) + 1, np.int64)).finish([], [], [])
        data = lower_latin(block.data)
        words = find_words(Block(block.lo, block.hi, data, block.offsets), NOT_ALNUM)
        hashes = hash_words(data, words)
        lengths = np.diff(words.first)
        span = max(map(len, masks))
        all_masks = [*masks, *("1" * int(n) for n in np.unique(lengths) if MIN_ITEM_WORDS <= n < span)]
        self, keys, item, at = cls(ids, all_masks, hashes, words.first), [], [], []
        for i, n in enumerate(lengths):
            if n < MIN_ITEM_WORDS:
                continue
            for m, mask in enumerate(all_masks):
                if len(mask) > n or (m >= len(masks) and len(mask) != n):
                    continue
                found = _spaced(hashes[words.first[i] : words.first[i + 1]], mask, m if m < len(masks) else 1000 + len(mask))
                keys.append(found)
                item.append(np.full(len(found), i))
                at.append(np.arange(len(found)))
        self.n_masks = len(masks)
        return self.finish(keys, item, at)

    def finish(self, keys: list, item: list, at: list) -> SeedIndex:
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        keys, item, at = join(keys, np.uint64), join(item, np.int64), join(at, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.at = keys[order], item[order], at[order]
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.keys >> np.uint64(42)).astype(np.int64)] = True
        return self

    def search(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hits of all documents of a block: document, item, and the document's word at which the item would begin."""
        docs, items, begins = [], [], []
        for m, mask in enumerate(self.masks):
            found = _spaced(hashes, mask, m if m < self.n_masks else 1000 + len(mask))
            maybe = np.flatnonzero(self.filter[(found >> np.uint64(42)).astype(np.int64)])
            lo = np.searchsorted(self.keys, found[maybe], "left")
            n = np.searchsorted(self.keys, found[maybe], "right") - lo
            maybe, lo, n = maybe[n > 0], lo[n > 0], n[n > 0]
            doc = np.searchsorted(first, maybe, "right") - 1
            inside = maybe + len(mask) <= first[doc + 1]
            maybe, lo, n, doc = maybe[inside], lo[inside], n[inside], doc[inside]
            which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            docs.append(np.repeat(doc, n))
            items.append(self.item[which])
            begins.append(np.repeat(maybe, n) - self.at[which])
        if not docs:
            return (np.zeros(0, np.int64),) * 3
        rows = np.unique(np.stack([np.concatenate(docs), np.concatenate(items), np.concatenate(begins)]), axis=1)
        return rows[0], rows[1], rows[2]

    def verify(self, hashes: np.ndarray, first: np.ndarray, doc: int, item: int, begin: int) -> tuple[int, int, int]:
        """Matched words and range of the best stretch: a match counts 1, a substituted word -2."""
        text = self.words[self.first[item] : self.first[item + 1]]
        lo, hi = max(begin, first[doc]), min(begin + len(text), first[doc + 1])
        same = hashes[lo:hi] == text[lo - begin : hi - begin]
        total = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
        gain = total - np.minimum.accumulate(total)
        end = int(np.argmax(gain))
        start = int(np.flatnonzero(total[: end + 1] == total[: end + 1].min())[-1])
        return int(same[start:end].sum()), int(lo - first[doc]) + start, int(lo - first[doc]) + end


def _matches(index: SeedIndex, column: pa.Array, min_overlap: float, min_words: int) -> Iterator[tuple]:
    """(row, item, start, end, matched, words of the item) for each contaminated row and item, the best place of each."""
    for block in blocks(column):
        data = lower_latin(block.data)
        words = find_words(Block(block.lo, block.hi, data, block.offsets), NOT_ALNUM)
        hashes = hash_words(data, words)
        best: dict[tuple[int, int], tuple] = {}
        for doc, item, begin in zip(*(x.tolist() for x in index.search(hashes, words.first)), strict=True):
            matched, start, end = index.verify(hashes, words.first, doc, item, begin)
            size = int(index.first[item + 1] - index.first[item])
            if matched >= min(min_overlap * size, min_words) and matched > best.get((doc, item), (0,))[0]:
                best[doc, item] = (matched, start, end, size)
        for (doc, item), (matched, start, end, size) in best.items():
            yield block.lo + doc, item, start, end, matched, size


def _indexes(bench: DataFrame, item_col: str, text_col: str, block_items: int, masks: tuple[str, ...]) -> Iterator[SeedIndex]:
    rows = bench.select(item_col, text_col).toLocalIterator()
    while part := list(islice(rows, block_items)):
        yield SeedIndex.build([r[0] for r in part], [r[1] for r in part], masks)


def benchmark_matches(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    min_overlap: float = 0.7, min_words: int = 13, masks: tuple[str, ...] = MASKS, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """One row for each document and benchmark item of which it holds a passage.

    Words are runs of letters and digits in lower case. A document holds an item
    if the best stretch on a diagonal matches at least ``min_overlap`` of the item's
    words, or ``min_words`` of them; each substitution costs a stretch two matches.
    The best stretch is returned (words from 0, end exclusive). Items of fewer than
    ``MIN_ITEM_WORDS`` words match nothing. Rows of
    ``docs`` that repeat each give their own rows; a null id is returned as null.
    Null and empty texts, in either table, match nothing; so do empty tables. Other
    columns are ignored.
    """
    picked = docs.select(id_col, text_col)
    (name,) = fresh([id_col], "item_id")
    kind = bench.schema[item_col].dataType
    schema = f"`{id_col}` {picked.schema[id_col].dataType.simpleString()}, `{name}` {kind.simpleString()}, {MATCHES}"
    out = None
    for index in _indexes(bench, item_col, item_text, block_items, masks):

        def run(batches: Iterator[pa.RecordBatch], index: SeedIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(_matches(index, batch.column(1), min_overlap, min_words))
                row, item, start, end, matched, size = zip(*rows, strict=True) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row, pa.int64())),
                        pa.array([index.ids[i] for i in item], to_arrow_type(kind)),
                        *(pa.array(x, pa.int32()) for x in (start, end, matched, size)),
                        pa.array([m / s for m, s in zip(matched, size, strict=True)], pa.float64()),
                    ],
                    names=[id_col, name, "start_word", "end_word", "matched_words", "item_words", "overlap"],
                )

        found = picked.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(
    docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    min_overlap: float = 0.7, min_words: int = 13, masks: tuple[str, ...] = MASKS, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item in the sense of ``benchmark_matches``.

    Null and empty texts hold none and stay; rows that repeat, and rows with a null id, are looked at apiece.
    Very long texts are searched as a whole. Empty tables: no documents give none, no items keep all.
    """
    place = docs.columns.index(text_col)
    out = docs
    for index in _indexes(bench, item_col, item_text, block_items, masks):

        def run(batches: Iterator[pa.RecordBatch], index: SeedIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, *_ in _matches(index, batch.column(place), min_overlap, min_words):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items: the documents that hold one, with the place and the overlap."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return benchmark_matches(docs, bench)
