"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is cut into segments. If two fingerprints differ in at most
four bits, some segment differs in no more bits than its radius, as the radii plus one
add up to five: so one of the two lies in the other's Hamming ball of that
segment. Every fingerprint looks its balls up in the tables of segments, and the
complete distance is verified.

Many near copies share a segment. They are first linked to a pivot of their bucket
(a star, one row each), and then only pairs of different stars are looked for. In a
crowded bucket the members of its largest star are never held against each other, and
the lookups are dealt out over several tasks; no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components, smallest_by_key
from .shared import fresh, store
from .words import Block, blocks, find_words, lower_ascii, xxh64

SEED = 42
#: Segment widths and radii for up to 2**28 distinct fingerprints, and beyond: longer keys, larger balls. Both are exact.
SEGMENTS = (((20, 1), (20, 1), (24, 0)), ((32, 2), (32, 1)))
DISTANCE = 4
#: A bucket of more fingerprints is crowded; its lookups are dealt into so many parts.
CROWDED, PARTS = 64, 16
#: Lanes of eight counters: bit k of a byte adds 1 to lane k.
_LANES = np.array([sum(((v >> k) & 1) << (8 * k) for k in range(8)) for v in range(256)], np.uint64)


def _majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each document the bits that more than half of its hashes have; without hashes zero."""
    sizes = np.diff(first)
    # pieces of at most 255 hashes, so that no lane of a byte overflows
    pieces = -(-sizes // 255)
    piece_doc = np.repeat(np.arange(len(sizes)), pieces)
    rank = np.arange(len(piece_doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = first[:-1][piece_doc] + 255 * rank
    out = np.zeros(len(sizes), np.uint64)
    if not len(starts):
        return out
    by_byte = hashes.view(np.uint8).reshape(-1, 8)
    for j in range(8):
        lanes = np.add.reduceat(_LANES[by_byte[:, j]], starts)
        counts = np.zeros((len(sizes), 8), np.int64)
        np.add.at(counts, piece_doc, lanes.view(np.uint8).reshape(-1, 8))
        for k in range(8):
            out |= (2 * counts[:, k] > sizes).astype(np.uint64) << np.uint64(8 * j + k)
    return out


def block_fingerprints(block: Block, shingle: int) -> np.ndarray:
    """Fingerprint of each document: XXH64 of all word shingles, and the majority of each bit."""
    data = lower_ascii(block.data)
    words = find_words(Block(block.lo, block.hi, data, block.offsets))
    counts = np.diff(words.first)
    # one space between words of a document, and nothing else but words
    last = np.zeros(len(words.start), bool)
    last[words.first[1:][counts > 0] - 1] = True
    keep = np.zeros(len(data) + 1, bool)
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, words.start, 1)
    np.add.at(edge, words.end, -1)
    keep[:-1] = np.cumsum(edge[:-1], dtype=np.int8) > 0
    between = words.end[~last]
    keep[between] = True
    data[between] = 0x20
    place = np.cumsum(keep) - 1
    start, end = place[words.start], place[words.end - 1] + 1
    text = data[keep[:-1]]
    shingles = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(shingles)])
    i = np.arange(first[-1]) + np.repeat(words.first[:-1] - first[:-1], shingles)
    j = i + np.repeat(np.minimum(counts, shingle), shingles) - 1
    hashes = xxh64(text, start[i], end[j], SEED)
    return _majority(hashes, first)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id_col, fp) for every row: its SimHash as a signed 64-bit integer; a null text counts as empty, which has zero."""
    picked = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [block_fingerprints(block, shingle) for block in blocks(batch.column(1))]
            found = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[id_col, "fp"])

    return picked.mapInArrow(run, picked.select(id_col).schema.add("fp", "long", False))


def _flip(number: int, part: Column) -> Callable[[Column], Column]:
    return lambda mask: F.struct(F.lit(number).alias("seg"), part.bitwiseXOR(mask).alias("key"))


def _balls(segments: tuple[tuple[int, int], ...], fp: Column, exact_only: bool) -> Column:
    """(seg, key) of each segment of ``fp``; with its whole ball unless ``exact_only``."""
    keys, shift = [], 0
    for number, (width, radius) in enumerate(segments):
        part = F.shiftrightunsigned(fp, shift).bitwiseAND((1 << width) - 1)
        flips = [0] if exact_only else [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
        masks = F.array(*[F.lit(f).cast("bigint") for f in flips])
        keys.append(F.transform(masks, _flip(number, part)))
        shift += width
    return F.concat(*keys)


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE


def link_fingerprints(distinct: DataFrame, segments: tuple[tuple[int, int], ...] | None = None, runs: int = 16) -> DataFrame:
    """(fp, root) for each of the distinct fingerprints ``fp``: root is one fingerprint of its component.

    Components are those of all links at DISTANCE or fewer differing bits.
    """
    if segments is None:
        segments = SEGMENTS[distinct.count() >= 1 << 28]
    if sum(w for w, _ in segments) != 64 or sum(r + 1 for _, r in segments) < DISTANCE + 1:
        raise ValueError("the segments don't cover 64 bits, or their radii don't cover the distance")
    # stars: each fingerprint to a pivot of its bucket and run, the pivots of runs to one of the bucket
    placed = distinct.select("fp", F.explode(_balls(segments, F.col("fp"), True)).alias("at")).select("fp", "at.*")
    placed = placed.withColumn("run", F.pmod(F.xxhash64("fp"), F.lit(runs)).cast("int")).withColumn("pivot", F.min("fp").over(Window.partitionBy("seg", "key", "run")))
    tops = placed.where("fp = pivot").withColumn("pivot", F.min("fp").over(Window.partitionBy("seg", "key")))
    links = placed.unionByName(tops).where((F.col("fp") != F.col("pivot")) & _near("fp", "pivot")).select(F.col("fp").alias("a"), F.col("pivot").alias("b"))
    stars = components(links)
    labelled = store(distinct.select("fp").join(stars.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("label")))
    # the tables and the lookups; pairs of one star are joined already
    table = labelled.select(F.col("fp").alias("b"), F.col("label").alias("lb"), F.explode(_balls(segments, F.col("fp"), True)).alias("at")).select("b", "lb", "at.*")
    lookups = labelled.select(F.col("fp").alias("a"), F.col("label").alias("la"), F.explode(_balls(segments, F.col("fp"), False)).alias("at")).select("a", "la", "at.*")
    held = table.groupBy("seg", "key", "lb").agg(F.count(F.lit(1)).alias("n"))
    largest = F.max(F.struct("n", "lb"))["lb"].alias("largest")
    crowded = store(held.groupBy("seg", "key").agg(F.sum("n").alias("n"), largest).where(F.col("n") > CROWDED).drop("n"))
    plain = lookups.join(table.join(crowded, ["seg", "key"], "left_anti"), ["seg", "key"])
    part = F.pmod(F.xxhash64("a"), F.lit(PARTS)).cast("int")
    asked = lookups.join(crowded, ["seg", "key"]).select("a", "la", "seg", "key", part.alias("part"), (F.col("la") == F.col("largest")).alias("own"))
    there = table.join(crowded, ["seg", "key"]).select("b", "lb", "seg", "key", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), (F.col("lb") == F.col("largest")).alias("member"))
    # the largest star's lookups meet the others only; all others meet everything
    asked = asked.withColumn("kind", F.explode(F.when(F.col("own"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    within = asked.join(there.withColumn("kind", F.col("member").cast("int")), ["seg", "key", "part", "kind"])
    found = plain.select("a", "la", "b", "lb").unionByName(within.select("a", "la", "b", "lb"))
    across = found.where((F.col("la") != F.col("lb")) & _near("a", "b"))
    roots = components(across.select(F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b")))
    joined = labelled.join(roots.select(F.col("node").alias("label"), "root"), "label", "left")
    return joined.select("fp", F.coalesce("root", "label").alias("root"))


def component_ids(linked: DataFrame) -> DataFrame:
    """(fp, component_id): the smallest ``least`` of each root's rows (fp, root, least); a null where all are."""
    known = smallest_by_key(linked.where("least IS NOT NULL"), "root", "least", "component_id")
    unknown = linked.where("least IS NULL")
    # fingerprints without an id are those of rows whose id is null: few, or one component's
    ids = known.groupBy("root").agg(F.min("component_id").alias("component_id"))
    return known.select("fp", "component_id").unionByName(unknown.join(ids, "root", "left").select("fp", "component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, segments: tuple[tuple[int, int], ...] | None = None) -> DataFrame:
    """One row for each row of ``docs``: id_col, fp and component_id, the smallest id that is reachable over links.

    Words are split at ASCII white space and lower-cased in A-Z; shingles of
    ``shingle`` words count as often as they occur. Fingerprints link at DISTANCE or
    fewer differing bits, that of empty texts (zero) like any other. A null id
    takes the component's smallest id, which is null only where all ids are. An
    empty table gives an empty result; other columns are ignored.
    """
    found = store(fingerprints(docs, id_col, text_col, shingle))
    distinct = store(found.groupBy("fp").agg(F.min(id_col).alias("least")))
    linked = store(link_fingerprints(distinct, segments).join(distinct, "fp"))
    # read back, so that the join below has an exchange on both sides, of which skewed parts can be split
    named = store(component_ids(linked))
    return found.join(named, "fp").select(id_col, "fp", "component_id")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """The rows of ``docs``, all columns, without those whose id isn't the smallest of their component of near-duplicates.

    Rows with a null id, which can't be told apart, all stay. Of rows that repeat the
    staying id, each stays: they are the same document.
    """
    (name,) = fresh(docs.columns, "_gone")
    gone = near_duplicates(docs, id_col, text_col, shingle).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint in hexadecimal and the smallest doc_id of its component."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
