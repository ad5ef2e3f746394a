import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from vellum.llm.components import components
from vellum.llm.queries import QUERIES
from vellum.llm.simhash import SEGMENTS, keep_one_each, link_fingerprints, near_duplicates

from .conftest import odd_rows


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows):
    fps, found = [(i, fingerprint(t)) for i, t in rows], Union()
    for a in range(len(fps)):
        for b in range(a + 1):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 4:
                found.join(a, b)
    least = {}
    for n, (i, _) in enumerate(fps):
        if i is not None:
            least[found.find(n)] = min(least.get(found.find(n), i), i)
    return sorted((str(i), f"{fp:016x}", least.get(found.find(n))) for n, (i, fp) in enumerate(fps))


def test_query_against_brute_force(spark, sf, texts):
    got = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in QUERIES["op7_simhash"](spark, sf).collect())
    assert got == expected(list(texts.items()))


def test_odd_rows(odd, none):
    got = near_duplicates(odd)
    made = got.select(F.col("doc_id").cast("string"), F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in made) == expected(odd_rows())
    assert near_duplicates(none).count() == 0 and keep_one_each(none).count() == 0
    kept = keep_one_each(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [-8, 1, 4, 5, 5, 7] and ids.count(None) == 2


@pytest.mark.parametrize("segments", [None, *SEGMENTS, ((16, 1), (16, 0), (16, 0), (16, 0)), ((13, 0), (13, 0), (13, 0), (13, 0), (12, 0))])
def test_no_link_is_lost_in_a_crowd(spark, segments):
    """Chains of near fingerprints around a few centres, so that buckets are crowded."""
    random.seed(11)
    fps = set()
    for _ in range(6):
        fp = random.getrandbits(64)
        for _ in range(40):
            fp ^= sum(1 << b for b in random.sample(range(64), random.choice([1, 3, 4, 5])))
            fps.add(fp)
    found = Union()
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 4:
                found.join(a, b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    root = {r["fp"] % (1 << 64): r["root"] for r in link_fingerprints(rows, segments).collect()}
    assert root.keys() == fps
    assert len(set(root.values())) == len({found.find(f) for f in fps})
    assert all((root[a] == root[b]) == (found.find(a) == found.find(b)) for a in fps for b in fps)


def test_segments_must_cover_the_distance(spark):
    with pytest.raises(ValueError, match="cover"):
        link_fingerprints(spark.createDataFrame([(1,)], "fp long"), ((32, 1), (32, 1)))


@pytest.mark.parametrize("per_task", [20, 200_000])
def test_components_against_union_find(spark, per_task):
    random.seed(3)
    edges = [(random.randrange(400), random.randrange(400)) for _ in range(260)] + [(900, i) for i in range(901, 990)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (7, 3), (3, 7)]
    found = Union()
    for a, b in edges:
        found.join(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), per_task).collect()}
    assert got == {x: found.find(x) for e in edges for x in e if found.find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_many_tasks(spark):
    """Edges in more tasks than one: paths, a star, and cycles, with few edges a task."""
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1400)] + [(rng.randrange(2000, 2600), rng.randrange(2000, 2600)) for _ in range(350)] + [(5, 5), (None, 7)]
    rng.shuffle(edges)
    found = Union()
    for a, b in edges:
        if a is not None:
            found.join(a, b)
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {r["node"]: r["root"] for r in components(df, edges_per_task=100).collect()}
    assert got == {x: found.find(x) for x in found.up if found.find(x) != x}


def test_a_crowded_bucket_stays_linear(spark):
    """Many fingerprints within four bits of one centre, all in one bucket, and some beyond: one star, no pairs of it."""
    rng = random.Random(5)
    near = {0}
    while len(near) < 20_000:
        near.add(sum(1 << b for b in rng.sample(range(20, 63), 4)))
    far = {(1 << 62) | (0xFFFF << 40) | i for i in range(3)}
    df = spark.createDataFrame([(x,) for x in near | far], "fp long").repartition(4)
    roots = {}
    for r in link_fingerprints(df).collect():
        roots.setdefault(r["root"], set()).add(r["fp"])
    assert sorted(map(len, roots.values()))[-1] >= len(near) and len(roots) == 2


def test_hashes_of_ranges():
    import numpy as np

    from vellum.llm.words import xxh64

    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 4800, 3000)
    end = start + rng.integers(0, 200, 3000)
    assert xxh64(data, start, end, 42).tolist() == [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(start, end)]
