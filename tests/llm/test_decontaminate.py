import random

from vellum.llm.decontaminate import benchmark_matches, drop_contaminated
from vellum.llm.queries import QUERIES

from .conftest import odd_rows

random.seed(5)
WORDS = [f"w{i}" for i in range(3000)]
ITEM = random.sample(WORDS, 30)


def bench(spark, *items):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, overlap string")


def test_substitutions_are_found_and_clean_texts_left_alone(spark):
    changed = [w if i % 6 else "zzz" for i, w in enumerate(ITEM)]
    docs = spark.createDataFrame(
        [(1, " ".join(WORDS[:50] + ITEM + WORDS[:9])), (2, " ".join(["a"] * 7 + changed)), (3, " ".join(random.sample(WORDS, 400))), (4, " ".join(ITEM[:8] + WORDS[:40])), (5, " ".join(ITEM).upper() + "!")],
        "doc_id long, text string",
    )
    got = {r["doc_id"]: r for r in benchmark_matches(docs, bench(spark, " ".join(ITEM), "a b", None, "")).collect()}
    assert got.keys() == {1, 2, 5}
    assert (got[1]["start_word"], got[1]["end_word"], got[1]["overlap"]) == (50, 80, 1.0)
    assert (got[2]["start_word"], got[2]["matched_words"]) == (8, 25)
    assert {r["doc_id"] for r in drop_contaminated(docs, bench(spark, " ".join(ITEM))).collect()} == {3, 4}


def test_blocks_of_items_give_the_same(spark):
    docs = spark.createDataFrame([(1, " ".join(ITEM)), (2, " ".join(WORDS[100:140]))], "doc_id long, text string")
    items = bench(spark, " ".join(ITEM), " ".join(WORDS[100:130]), " ".join(WORDS[200:230]))
    one, many = (sorted(map(tuple, benchmark_matches(docs, items, block_items=n).collect())) for n in (100, 1))
    assert one == many and len(one) == 2
    assert drop_contaminated(docs, items, block_items=1).count() == 0


def test_a_short_item_is_looked_up_whole(spark):
    docs = spark.createDataFrame([(1, "x one two three four five y"), (2, "one two three four")], "doc_id long, text string")
    assert [r["doc_id"] for r in benchmark_matches(docs, bench(spark, "one two three four five")).collect()] == [1]


def test_odd_rows(odd, none, spark):
    got = benchmark_matches(odd, bench(spark, "a text without an id", "twice the same row ok", "twice the same row")).collect()
    assert [r["doc_id"] for r in got] == [None]
    assert drop_contaminated(odd, bench(spark, "a text without an id")).count() == len(odd_rows()) - 1
    assert benchmark_matches(none, bench(spark, "a b c d e f")).count() == 0
    assert benchmark_matches(odd, bench(spark).limit(0)).count() == 0 and drop_contaminated(odd, bench(spark).limit(0)).count() == len(odd_rows())


def test_query_finds_exactly_the_planted_passages(spark, sf, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    planted = {(d, i) for d, t in texts.items() for i, p in items.items() if p in t}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op1_decontaminate"](spark, sf).collect()}
    assert planted <= got and {d for d, _ in got} == {d for d, _ in planted}
