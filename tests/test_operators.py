import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import chunking, governance, metrics, recovery, search
from vellum.operators.access import Access, identified
from vellum.schema import checked_store

CHUNKS = "chunk_id long, content string, department string, secret_level int, is_deleted boolean, is_deprecated boolean, embedding array<float>, source_file string"


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f"alpha {'beta ' * (i % 4)}w{i}", [None, "hr", "it", "company"][i % 4], i % 3, i == 5, i == 6, rng.normal(size=8).tolist(), f"f{i % 3}") for i in range(40)]
    return spark.createDataFrame([*rows, (90, "no vector", "hr", 0, False, False, None, "f"), (91, "zero", "hr", 0, False, False, [0.0] * 8, "f")], CHUNKS).cache()


@pytest.fixture(scope="module")
def queries(spark):
    rng = np.random.default_rng(9)
    return spark.createDataFrame([(i, q, rng.normal(size=8).tolist()) for i, q in enumerate(["alpha beta", "W7 w8", "", "!!"])], "query_id long, question string, embedding array<float>").cache()


@pytest.mark.parametrize(
    ("access", "visible"),
    [
        (Access(), lambda d, s: True), (Access((), 9), lambda d, s: False), (Access(("hr",), 1), lambda d, s: d == "hr" and s <= 1), (Access(None, 0), lambda d, s: s == 0),
        (Access(("hr",), 1, soft=True), lambda d, s: s <= 1), (Access((), 1, soft=True), lambda d, s: False),
    ],
)
def test_access_fails_closed(chunks, access, visible):
    got = {r["chunk_id"]: r["weight"] for r in access.visible(chunks).collect()}
    rows = chunks.collect()
    assert got.keys() == {r["chunk_id"] for r in rows if r["chunk_id"] not in (5, 6) and visible(r["department"], r["secret_level"])}
    if access.soft:
        assert all(got[r["chunk_id"]] == (1.0 if r["department"] == "hr" else 0.85) for r in rows if r["chunk_id"] in got)


@pytest.mark.parametrize("access", [Access(), Access(("hr", "it"), 1), Access(("hr",), 2, soft=True)])
@pytest.mark.parametrize("block", [1, 100])
def test_vector_topk_against_numpy(chunks, queries, access, block):
    rows = [r for r in access.visible(chunks).collect() if r["embedding"] and any(r["embedding"])]
    got = {}
    for r in search.vector_topk(chunks.repartition(5), queries, 4, access, block).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], r["score"]))
    for q in queries.collect():
        cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
        best = sorted((-round(cos(q["embedding"], r["embedding"]) * r["weight"], 6), r["chunk_id"]) for r in rows)[:4]
        assert [(i, c) for i, (_, c) in enumerate(best, 1)] == [x[:2] for x in sorted(got[q["query_id"]])]


def test_both_arms_see_the_same_chunks(chunks, queries):
    access = Access(("hr",), 1)
    allowed = {r["chunk_id"] for r in access.visible(chunks).collect()}
    assert {r["chunk_id"] for r in search.lexical_topk(chunks, queries, 99, access).collect()} <= allowed
    assert {r["chunk_id"] for r in search.vector_topk(chunks, queries, 99, access).collect()} <= allowed


def test_filters_reach_the_scan_and_top_k_is_limited_early(spark, chunks, queries, tmp_path):
    chunks.write.parquet(str(tmp_path / "c"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = search.vector_topk(spark.read.parquet(str(tmp_path / "c")), queries, 3, Access(("hr",), 1))._jdf.queryExecution().toString()
    assert "LessThanOrEqual(secret_level,1)" in plan and "WindowGroupLimit" in plan and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_lexical_score(chunks, queries):
    got = search.lexical_topk(chunks, queries, 99).collect()
    assert {r["query_id"] for r in got} == {0, 1}, "a query without words finds nothing"
    by = {(r["query_id"], r["chunk_id"]): r["score"] for r in got}
    assert by[0, 3] == pytest.approx((1 / 2 + 3 / 4) / 2) and by[1, 7] == pytest.approx(1 / 4)


def lists(spark, *ranked):
    rows = [(0, n, r, c, 1.0 - r / 10) for n, ids in enumerate(ranked) for r, c in enumerate(ids, 1)]
    return spark.createDataFrame(rows, "query_id long, list_no int, rank int, chunk_id long, score double")


def test_fusion(spark):
    order = lambda *r: [x["chunk_id"] for x in search.fuse(lists(spark, *r)).orderBy("rank").collect()]
    assert order([1, 2, 3], [3, 9]) == [3, 1, 2, 9]
    assert order([1, 2], [8, 7]) == [1, 8, 2, 7], "ties go to the earlier list"
    assert order([1, None, 2]) == [1, 2]
    assert search.fuse(lists(spark, [1], [1])).first()["rrf"] == pytest.approx(2 / 61)
    filled = search.backfill(search.fuse(lists(spark, [1, 2], [2])), spark.createDataFrame([(0, 2, 0.5), (0, 2, 0.7)], "query_id long, chunk_id long, score double"))
    assert {r["chunk_id"]: (r["score"], r["lexical_score"]) for r in filled.collect()} == {1: (0.9, 0.9), 2: (0.7, None)}


def test_retrieve_switches(chunks, queries):
    hybrid = search.retrieve(chunks, queries, top_k=3, candidates=6)
    assert hybrid.groupBy("stage", "query_id").count().agg(F.max("count")).first()[0] == 6
    assert hybrid.where("stage = 'final'").groupBy("query_id").agg(F.max("rank"), F.count("*")).where("count(1) > 3").count() == 0
    single = search.retrieve(chunks, queries, top_k=3, hybrid=False, reranker=None)
    want = {(r["query_id"], r["rank"], r["chunk_id"]) for r in search.vector_topk(chunks, queries, 3).collect()}
    assert {(r["query_id"], r["rank"], r["chunk_id"]) for r in single.where("stage = 'final'").collect()} == want
    variants = queries.select("query_id", F.lit(1).alias("variant_no"), "embedding")
    assert search.retrieve(chunks, queries, variants=variants).where("stage = 'final'").count() > 0
    with pytest.raises(ValueError, match="unknown reranker"):
        search.retrieve(chunks, queries, reranker="magic")


def test_raw_tables_are_told_only_where_complex(spark):
    hits = spark.createDataFrame([(0, 1, "a", "x", "|r|", False), (0, 2, "b", "y", "|s|", True)], "query_id long, rank int, source_file string, content string, raw_table string, table_complex boolean")
    assert search.context(hits).first()["context"] == "[1] a\nx\n\n[2] b\ny\n|s|"


def test_tokens_name_users(spark):
    users = spark.createDataFrame([("t", "ann", "hr")], "token string, name string, department string")
    requests = spark.createDataFrame([("Bearer t",), ("t",), ("Bearer u",), (None,)], "authorization string")
    assert {r["authorization"]: r["status"] for r in identified(requests, users).collect()} == {"Bearer t": 200, "t": 401, "Bearer u": 401, None: 401}


def test_two_percentiles_that_differ(spark):
    values = spark.createDataFrame([(float(i * i), "g") for i in range(1, 11)], "v double, g string")
    assert values.agg(metrics.nearest_rank("v", 0.5)).first()[0] == 25
    assert metrics.truncated_index(values, "v", 0.5, "p", "g").first()["p"] == 36
    assert values.limit(0).agg(metrics.nearest_rank("v", 0.5)).first()[0] == 0


def test_rates_without_rows_are_zero(spark):
    empty = spark.createDataFrame([], "rank int")
    assert tuple(empty.agg(*metrics.recall_at(F.col("rank")), metrics.mrr(F.col("rank"))).first()) == (0, 0, 0, 0)
    some = spark.createDataFrame([(1,), (4,), (None,)], "rank int")
    assert tuple(some.agg(*metrics.recall_at(F.col("rank")), metrics.mrr(F.col("rank"))).first()) == (0.333333, 0.333333, 0.666667, 0.416667)


def test_overlap_recall(spark):
    rank = lambda ids: spark.createDataFrame([(0, c, r) for r, c in enumerate(ids, 1)], "query_id long, chunk_id long, rank int")
    got = {r["k"]: r["recall"] for r in metrics.overlap_recall(rank([1, 2, 3]), rank([2, 1, 9]), (1, 3)).collect()}
    assert got == {1: 0.0, 3: 0.666667}


def is_heading(line):
    line = line.strip()
    return bool(line) and len(line) <= 40 and line[-1] not in "。！？；;.!?，,：:"


def split_plainly(text, size, overlap):
    """The rules of the splitter, statement by statement."""
    out, cur, at = [], None, 0
    text = text.rstrip(" ")
    for raw in text.split("\n"):
        start, at = at, at + len(raw) + 1
        p, end = raw.strip(" "), start + len(raw)
        if not p:
            continue
        if is_heading(p):
            if cur and len(cur[0]) >= size * 0.5:
                out.append(cur)
                cur = None
            cur = [cur[0] + "\n" + p, cur[1], end, cur[3] or p] if cur else [p, start, end, p]
        elif len(p) > size:
            title = cur[3] if cur else None
            out += [cur] if cur else []
            cur, pos, piece = None, start, None
            for s in re.findall("[^。！？!?；;]*[。！？!?；;]|[^。！？!?；;]+$", p):
                if piece and len(piece[0]) + len(s) <= size:
                    piece = [piece[0] + s, piece[1], pos + len(s), title]
                else:
                    out += [piece] if piece else []
                    piece = [s, pos, pos + len(s), title]
                pos += len(s)
            out.append(piece)
        elif cur and len(cur[0]) + len(p) + 1 <= size:
            cur = [cur[0] + "\n" + p, cur[1], end, cur[3]]
        else:
            out += [cur] if cur else []
            cur = [p, start, end, None]
    out += [cur] if cur else []
    merged = []
    for c in out:
        if merged and len(c[0]) < size * 0.15 and len(merged[-1][0]) + len(c[0]) + 1 <= size:
            merged[-1] = [merged[-1][0] + "\n" + c[0], merged[-1][1], c[2], merged[-1][3]]
        else:
            merged.append(c)
    if len(merged) > 1 and len(merged[0][0]) < size * 0.15 and len(merged[0][0]) + len(merged[1][0]) + 1 <= size:
        a, b = merged[:2]
        merged[:2] = [[a[0] + "\n" + b[0], a[1], b[2], b[3] or a[3]]]
    return [([merged[i - 1][0][-n:] + "\n" + c[0], *c[1:]] if i and overlap and (n := min(overlap, int(len(merged[i - 1][0]) * 0.25))) else c) for i, c in enumerate(merged)]


def test_splitter_against_plain_rules(spark):
    rng = random.Random(8)
    bits = ["Heading", "a sentence. ", "另一句。", "long " * 9 + "end!", "x" * 70 + "。", "", "  indented.", "one; two; three."]
    texts = ["\n".join("".join(rng.choices(bits, k=rng.randrange(1, 4))) for _ in range(rng.randrange(1, 14))) for _ in range(120)] + ["", "   ", "\n\n", "only"]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(999, None)], "id int, text string").repartition(4)
    for size, overlap in ((60, 16), (120, 0), (512, 64)):
        got = {r["id"]: [list(c) for c in r["c"]] for r in rows.select("id", chunking.split_text(F.col("text"), size, overlap).alias("c")).collect()}
        assert got[999] == []
        for i, t in enumerate(texts):
            assert got[i] == split_plainly(t, size, overlap), (size, t)


BLOCKS = "document_id string, pos int, kind string, text string, page int, raw_table string, table_complex boolean"


def test_blocks_to_chunks(spark):
    rows = [
        ("d", 0, "heading", "Top", 1, None, False), ("d", 1, "table", "t=1", 1, "|t|", True), ("d", 2, "paragraph", "one.", 1, None, False), ("d", 3, "paragraph", "two.", 2, None, False), ("d", 4, "code", "x()", 2, None, False),
        ("d", 5, "heading", "Next", None, None, False), ("d", 6, "paragraph", "three.", None, None, False), ("d", 7, "table", "u=1", None, "|u|", False),
    ]
    got = [tuple(r)[1:10] for r in chunking.split_blocks(spark.createDataFrame(rows, BLOCKS)).orderBy("chunk_index").collect()]
    assert got == [
        (0, "table", "Top\nt=1", 0, 3, "Top", 1, "|t|", True), (1, "paragraph", "one.", 0, 4, "Top", 1, None, False), (2, "paragraph", "two.", 0, 4, "Top", 2, None, False), (3, "code", "x()", 0, 3, "Top", 2, None, False),
        (4, "paragraph", "Next\nthree.", 0, 11, "Next", None, None, False), (5, "table", "u=1", 0, 3, "Next", None, "|u|", False),
    ]


def lines(spark, *text):
    return spark.createDataFrame([(0, i, t) for i, t in enumerate(text)], "doc_id int, line_no int, line string")


@pytest.mark.parametrize(
    ("text", "tables"),
    [
        (["x", "| a | b |", "|---|---|", "| 1 | 2 |", "y"], [(1, 4, 2)]), (["| a | b |", "| 1 | 2 |"], []), (["| a | b |", "|---|---|"], []), (["| a | b |", "|---|---|", "| 1 |  2 | 3 |"], []),
        (["| a | b |", "|---|---|", "| 1 | 2 |", "| c | d |", "|---|---|", "| 3 | 4 |"], [(0, 3, 2), (3, 6, 2)]), (["|---|---|", "| 1 | 2 |"], []), (["| a | b |", "| c | d |", "|---|---|", "| 1 | 2 |"], [(0, 4, 3)]),
    ],
)
def test_table_recovery(spark, text, tables):
    got = recovery.recovered_tables(lines(spark, *text)).orderBy("line_start").collect()
    assert [(r["line_start"], r["line_end"], len(r["rows"])) for r in got] == tables


def test_suspects_tell_every_reason(spark):
    (row,) = recovery.suspects(lines(spark, "a | b | c | d", "a | b | c | d | e", "no")).collect()
    assert (row["line_start"], row["line_end"], row["reasons"]) == (0, 2, "no separator row; rows of unequal width")


def test_tables_over_several_paragraphs_are_rebuilt_in_place(spark):
    rows = [("d", 0, "paragraph", "before\n| a | b |\n|---|---|", 3, None, False), ("d", 1, "paragraph", "| 1 | 2 |\nafter", 4, None, False), ("d", 2, "code", "| a | b |\n|---|---|\n| 1 | 2 |", 4, None, False)]
    got = [(r["pos"], r["kind"], r["text"], r["page"], r["recovered"]) for r in recovery.recover_blocks(spark.createDataFrame(rows, BLOCKS)).orderBy("pos").collect()]
    assert got == [(0, "paragraph", "before", 3, False), (1, "table", "a=1, b=2", 3, True), (2, "paragraph", "after", 4, False), (3, "code", rows[2][3], 4, False)]


@pytest.mark.parametrize("item", ["content=x", "nope=1", "title", "=x", "is_deprecated=maybe"])
def test_corrections_are_whitelisted(item):
    with pytest.raises(ValueError):
        governance.parse_assignments([item], governance.CHUNK_FIELDS)


def test_corrections_leave_the_rest_alone(spark, chunks):
    rows = chunks.withColumn("title", F.lit(None).cast("string"))
    got = governance.corrected(rows, F.col("department") == "hr", ["secret_level=7", "title=a=b"])
    assert {(r["secret_level"], r["title"]) for r in got.where("department = 'hr'").collect()} == {(7, "a=b")}
    untouched = [c for c in rows.columns if c not in ("secret_level", "title")]
    assert sorted(map(str, got.select(untouched).collect())) == sorted(map(str, rows.select(untouched).collect()))


def test_governance(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "id string") for v in (["x", "x", "y"], ["x", "z"]))
    assert {tuple(r) for r in governance.differences(a, b, "id").collect()} == {("y", "missing"), ("z", "surplus")}
    assert {tuple(r) for r in governance.multiset_difference(a, b, "id").collect()} == {("x", 0, 1), ("y", 0, 1), ("z", 1, 0)}
    prints = [governance.fingerprint(x, ["id"], F.col("id")).first()["fingerprint"] for x in (b, b.repartition(3), a)]
    assert prints[0] == prints[1] != prints[2]
    assert governance.schema_differences(a, a.withColumn("n", F.lit(1))) == [("n", "int", "second")]
    versions = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b"), ("e", None, "c")], "id string, version int, v string")
    assert {tuple(r) for r in governance.latest(versions, "id", "version").collect()} == {("d", 2, "b"), ("e", None, "c")}
    asked = spark.createDataFrame([(1, "s", ["in", "out"])], "question_id int, source string, spans array<string>")
    held = spark.createDataFrame([("s", "within"), ("t", "out")], "source_file string, content string")
    assert [tuple(r) for r in governance.unlanded(asked, held).collect()] == [(1, "out")]
    with pytest.raises(ValueError, match="unknown store"):
        checked_store("prod")


def test_search_by_cells(spark, sf, tmp_path):
    from vellum.operators.cells import cell_topk, fit_cells, index_cells

    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding", F.lit(False).alias("is_deleted"), F.lit(False).alias("is_deprecated"))
    asked = vectors.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    centres = fit_cells(vectors, 16)
    index_cells(vectors, centres).write.partitionBy("cell").parquet(str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    assert index.count() == vectors.count(), "every row is indexed"
    exact = search.vector_topk(vectors, asked, 10)
    pairs = lambda df: {(r["query_id"], r["chunk_id"]) for r in df.collect()}
    assert pairs(cell_topk(index, asked, centres, 10, probes=16)) == pairs(exact)
    recall = {r["k"]: r["recall"] for r in metrics.overlap_recall(exact, cell_topk(index, asked, centres, 10, probes=12)).collect()}
    assert recall[1] >= 0.9 and recall[10] >= 0.9
