"""Exact dedup, sharding and preference pairs."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vellum.llm.chat import preference_pairs
from vellum.llm.exact_dedup import exact_dedup
from vellum.llm.queries import QUERIES
from vellum.llm.sharding import assign_shards, jump_hash

from .conftest import odd_rows


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 40, 41, 1000])
def test_jump_hash_is_the_published_one(spark, n):
    keys = [0, 1, -1, 7, 2**63 - 1, -(2**63), *range(100, 160)]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", jump_hash(F.col("k"), n).alias("s")).collect()
    assert {r["k"]: r["s"] for r in got} == {k: jump(k, n) for k in keys}


def test_one_more_shard_takes_rows_only_into_itself(spark, sf):
    for r in QUERIES["op8_jump_sharding"](spark, sf).collect():
        assert r["grown_shard"] in (r["shard"], 40)


def test_shards_of_odd_rows(odd, none):
    got = assign_shards(odd, 3, rows_per_bucket=2).collect()
    assert len(got) == len(odd_rows())
    slots = defaultdict(list)
    for r in got:
        body = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(body) + 16, zlib.crc32(body), "key")
        assert r["shard"] == jump(r["doc_id"] or 0, 3)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert assign_shards(none, 3).count() == 0
    with pytest.raises(ValueError, match="positive"):
        jump_hash(F.lit(1), 0)


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup_against_brute_force(documents, texts, keep):
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[t].append(i)
    got = exact_dedup(documents, keep=keep, runs=16, fan_in=4).collect()
    assert len(got) == len(texts)
    for r in got:
        own = groups[texts[r["doc_id"]]]
        best = min(own) if keep == "min" else max(own)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (best, len(own), r["doc_id"] == best)
        assert r["text_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_exact_dedup_of_odd_rows(odd, none):
    got = exact_dedup(odd, keep="max").collect()
    assert len(got) == len(odd_rows())
    kept = defaultdict(int)
    for r in got:
        kept[r["text"] or ""] += r["kept"]
        if r["text"] == "twice the same row":
            assert (r["keep_id"], r["group_size"]) == (6, 3)
        if not r["text"]:
            assert (r["keep_id"], r["group_size"]) == (2, 3)
        if r["text"] == "a text without an id":
            assert r["keep_id"] is None
    assert set(kept.values()) == {1}
    again = exact_dedup(odd.where("doc_id = 5")).collect()
    assert sorted(r["kept"] for r in again) == [False, True], "of repeated rows one stays"
    assert exact_dedup(none).count() == 0
    with pytest.raises(ValueError, match="keep"):
        exact_dedup(odd, keep="any")


def test_a_normalisation_makes_other_groups(spark):
    rows = spark.createDataFrame([(1, "A b"), (2, "a B")], "doc_id long, text string")
    assert {r["group_size"] for r in exact_dedup(rows).collect()} == {1}
    assert {r["keep_id"] for r in exact_dedup(rows, text=F.lower("text")).collect()} == {1}


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, prompt string")


def test_preference_pairs(spark):
    made = preference_pairs(
        turns(
            spark,
            [
                (0, 0, "user", "hi"), (0, 1, "assistant", "good"), (1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (1, 2, "user", "why"), (1, 3, "assistant", "<|im_end|>"),
                (2, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, None, None), (None, 0, "user", "lost"),
            ],
        )
    )
    by = {r["pair_id"]: r for r in made.collect()}
    assert by.keys() == {0, 1, 2}
    first = by[0]
    assert first["prompt"] == "<|im_start|>user\nhi<|im_end|>\n" and first["common_turns"] == 1 and first["status"] == "pair"
    assert [first["chosen"][s["start"] : s["end"]] for s in first["chosen_mask"]] == ["good<|im_end|>\n"]
    assert [first["rejected"][s["start"] : s["end"]] for s in first["rejected_mask"]] == ["bad<|im_end|>\n", "< |im_end|><|im_end|>\n"]
    assert (by[1]["status"], by[1]["chosen"], by[1]["rejected"], by[1]["chosen_mask"]) == ("identical", "", "", [])
    assert (by[2]["status"], by[2]["rejected_id"], by[2]["prompt"], by[2]["chosen"]) == ("unpaired", None, "", "<|im_start|>\n<|im_end|>\n")
    assert preference_pairs(turns(spark, []).where("false")).count() == 0


def test_preference_pairs_can_be_given(spark):
    said = turns(spark, [(7, 0, "user", "q"), (7, 1, "assistant", "b"), (9, 0, "user", "q"), (9, 1, "assistant", "a")])
    pairs = spark.createDataFrame([("p", 9, True), ("p", 7, False)], "pair_id string, conv_id long, chosen boolean")
    (row,) = preference_pairs(said, pairs).collect()
    assert (row["pair_id"], row["chosen_id"], row["rejected_id"], row["common_turns"]) == ("p", 9, 7, 1)


def test_several_conversations_a_side(spark):
    said = turns(spark, [(7, 0, "user", "q"), (8, 0, "user", "q"), (9, 0, "user", "q")])
    pairs = spark.createDataFrame([("p", 9, True), ("p", 7, False), ("p", 8, False), ("n", 7, None)], "pair_id string, conv_id long, chosen boolean")
    got = {r["pair_id"]: r for r in preference_pairs(said, pairs.where("chosen IS NOT NULL")).collect()}
    row = got["p"]
    assert (row["status"], row["rejected_id"], row["prompt"], row["chosen"], row["common_turns"]) == ("several", 8, "", "", 0)


def test_keys_that_are_strings_and_clashing_names(spark):
    rows = spark.createDataFrame([("a", "x", 777, 1), ("b", "y", 778, 2), (None, None, 779, 3)], "doc_id string, text string, _row long, _BUCKET long")
    got = {r["doc_id"]: r for r in assign_shards(rows, 4).collect()}
    assert {r["_row"] for r in got.values()} == {777, 778, 779} and all(0 <= r["shard"] < 4 for r in got.values())
    same = spark.createDataFrame([(1, "x", "k", 9), (2, "x", "l", 8)], "doc_id long, text string, _run string, _KEEP long")
    assert {(r["doc_id"], r["keep_id"], r["_run"], r["_KEEP"]) for r in exact_dedup(same).collect()} == {(1, 1, "k", 9), (2, 1, "l", 8)}


def test_sorted_runs_are_merged(documents, capsys):
    exact_dedup(documents).explain()
    from vellum.llm.exact_dedup import _merged

    rows = documents.selectExpr("0 AS _run", "unhex(sha2(text, 256)) AS d", "doc_id")
    _merged(rows, ["_run", "d"], "min", ("doc_id", "k"), (F.lit(1), "n")).explain()
    assert "SortAggregate" in capsys.readouterr().out


def test_op8_against_brute_force(spark, sf, texts):
    """The whole query: sizes, checksums, shards and gapless slots."""
    slots = defaultdict(list)
    for r in QUERIES["op8_jump_sharding"](spark, sf).collect():
        body = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) == (len(body) + 16, zlib.crc32(body), "key", jump(r["doc_id"], 40), jump(r["doc_id"], 41))
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == len(texts)
