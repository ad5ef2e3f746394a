import pytest
from pyspark.sql import functions as F

from vellum.operators import evaluation as E


def test_questions_are_read_and_admitted(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": 1, "question": "q", "variants": [" a ", "", "b", "c"]}\n\n{"id": 2, "question": "r"}\n')
    asked = E.read_questions(spark, str(tmp_path / "q.jsonl"))
    assert asked.count() == 2
    assert [(r["id"], r["variants"]) for r in E.paraphrased(asked).collect()] == [(1, ["a", "b"])]
    (tmp_path / "bad.jsonl").write_text("{broken\n")
    with pytest.raises(Exception, match="MALFORMED"):
        E.read_questions(spark, str(tmp_path / "bad.jsonl")).collect()
    made = spark.createDataFrame([("s", "q", "span"), ("s", " ", "span"), ("s", "q", "gone"), ("s", None, "span")], "source string, question string, answer_span string")
    assert E.admitted_questions(made, spark.createDataFrame([("s", "a span.")], "source string, text string")).count() == 1


def test_variants_move_numbers_below_the_title(spark):
    texts = spark.createDataFrame([("a.md", "Rule 5\npay 10 of 99.5\nno numbers")], "file string, text string")
    units = spark.createDataFrame([("hr", 3), ("it", 40)], "department string, offset int")
    got = {r["department"]: (r["file"], r["text"]) for r in E.department_variants(texts, units).collect()}
    assert got == {"hr": ("dept_hr_a.md", "hr Rule 5\npay 13 of 102.8\nno numbers"), "it": ("dept_it_a.md", "it Rule 5\npay 50 of 139.45\nno numbers")}
    assert E.department_variants(texts, units.limit(0)).count() == 0


def test_logs_and_settings(spark, tmp_path):
    (tmp_path / "log").write_text('10:00 {"event": "ask", "ts": 1}\nnoise\n{"event": "ask"}\n{"event": "fail"}\n')
    assert {tuple(r) for r in E.audit_log(spark, str(tmp_path / "log")).collect()} == {("ask", 2), ("fail", 1)}
    pairs = lambda **v: spark.createDataFrame(list(v.items()), "name string, value string")
    assert {tuple(r) for r in E.compared_settings(pairs(a="1", b="3"), pairs(a="1", b="2", c="9")).collect()} == {("a", "same"), ("b", "different"), ("c", "missing")}


def test_heading_candidates(spark):
    rows = [("f", "Title", True, 16.0), ("f", "x" * 60, True, 10.0), ("f", "bold end.", True, 10.0), ("f", "body", False, 10.0), ("f", "big", False, 14.0), ("f", "body", False, 10.0)]
    (got,) = E.heading_candidates(spark.createDataFrame(rows, "file string, text string, bold boolean, size double")).collect()
    assert tuple(got) == ("f", 3, 2, 1, 2, 2)
    said = spark.createDataFrame([(None, True, False)], "run boolean, style boolean, document boolean")
    assert said.select(E.layered("run", "style", "document")).first()[0] is True


def test_table_lengths_and_plans(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "table", "x" * n) for n in (10, 20, 2000)] + [("b", "table", "y"), ("b", "code", "z")], "source_file string, kind string, content string")
    got = {r["source_file"]: tuple(r)[1:] for r in E.table_lengths(chunks).collect()}
    assert got == {"a": (3, 20, 2000, 2000, 1), "b": (1, 1, 1, 1, 0), "total": (4, 10, 2000, 2000, 1)}
    deep = tmp_path / ("long" * 20) / "chunks"
    chunks.write.parquet(str(deep))
    kept = spark.read.parquet(str(deep)).where(F.col("kind") == "table").select("source_file")
    (scan,) = E.scan_of(kept, "chunks")
    assert "EqualTo(kind,table)" in scan["pushed"] and "content" not in scan["columns"] and "source_file" in scan["columns"]
    assert E.scan_of(kept, "other") == []
