import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from vellum.functions import provenance, replies, tables, text, vectors


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("line", "expected"),
    [("Section 1", True), ("ends.", False), ("列表：", False), ("x" * 40, True), ("x" * 41, False), ("", False), ("   ", False), (None, False)],
)
def test_heading(spark, line, expected):
    assert value(spark, text.is_heading(F.lit(line).cast("string"))) is expected


@pytest.mark.parametrize(
    ("body", "expected"),
    [("一。二！三", ["一。", "二！", "三"]), ("a. b? c", ["a. b?", " c"]), ("", []), (None, []), ("no end", ["no end"]), ("!!", ["!", "!"])],
)
def test_sentences_keep_their_ends(spark, body, expected):
    assert value(spark, text.sentences(F.lit(body).cast("string"))) == expected


def test_numbers_and_what_is_missing(spark):
    assert value(spark, text.number_tokens(F.lit("1,234.5 and -7, 7 2024-01 7"))) == ["1234.5", "-7", "7", "2024", "-01"]
    assert value(spark, text.missing_numbers(F.lit("1 2 3"), F.lit("3 1"))) == ["2"]
    assert value(spark, text.missing_tokens(F.lit("A b c"), F.lit("B"))) == ["a", "c"]


def test_pipe_rows(spark):
    assert value(spark, text.cells(F.lit("| a | b|"))) == ["a", "b"]
    assert value(spark, text.is_separator_row(F.lit("|:--|--:|"))) is True and value(spark, text.is_separator_row(F.lit("| a |"))) is False
    assert value(spark, text.is_pipe_row(F.lit("a|b"))) is False


def test_line_and_span_predicates(spark):
    both = F.lit("x 5\nfee 7")
    assert value(spark, text.same_line(both, F.lit("7"), F.lit("fee"))) is True and value(spark, text.same_line(both, F.lit("5"), F.lit("fee"))) is False
    assert value(spark, text.contains_all(both, F.array(F.lit("x"), F.lit("7")))) is True
    assert value(spark, text.host_of(F.lit("pg://u:p@ss@host/db"))) == "host/db"


def rows(*lines):
    return F.array(*[F.array(*map(F.lit, r)) for r in lines])


def test_tables(spark):
    t = rows(["a", ""], ["1", "x|y"], ["2", "z"])
    assert value(spark, tables.to_markdown(t)) == "| a |  |\n| --- | --- |\n| 1 | x\\|y |\n| 2 | z |"
    assert value(spark, tables.to_words(t)) == "a=1, column 2=x|y；a=2, column 2=z"
    assert value(spark, tables.is_complex(t)) is True and value(spark, tables.is_complex(rows(["a"], ["1"]))) is False
    assert value(spark, tables.is_complex(rows(["a"], ["1", "2"]))) is True
    assert value(spark, tables.to_words(rows(["a", "b"]))) == "a=a, b=b"
    assert value(spark, tables.to_markdown(F.array().cast("array<array<string>>"))) == ""
    assert value(spark, tables.with_caption(F.lit("w"), F.lit("c"))) == "c\nw" and value(spark, tables.with_caption(F.lit("w"), F.lit(" "))) == "w"


@pytest.mark.parametrize(
    ("reply", "status"),
    [
        ('{"ambiguous": true}', "ambiguous"), ('{"ambiguous": false}', "clear"), ('{"ambiguous": "false"}', "ambiguous"), ('{"ambiguous": ""}', "clear"), ('{"ambiguous": 0}', "clear"), ('{"ambiguous": 2}', "ambiguous"),
        ('{"ambiguous": null}', "clear"), ('{"ambiguous": []}', "clear"), ('{"other": 1}', "unknown"), ("[1]", "unknown"), ("", "unknown"), (None, "unknown"), ("{bad", "unknown"), ('x {"ambiguous": true} y', "ambiguous"),
    ],
)
def test_verdicts_keep_three_states(spark, reply, status):
    assert value(spark, replies.verdict(F.lit(reply).cast("string")))["status"] == status


def test_a_judge_that_was_not_asked_is_clear(spark):
    for enabled, n, status in ((False, 5, "clear"), (True, 1, "clear"), (True, 2, "unknown")):
        assert value(spark, replies.judged(F.lit(enabled), F.lit(n), F.lit("nothing")))["status"] == status


@pytest.mark.parametrize(("reply", "n", "order"), [("[3, 1]", 3, [3, 1, 2]), ("so [9,2,2]", 3, [2, 1, 3]), ("none", 2, [1, 2]), (None, 0, [])])
def test_order(spark, reply, n, order):
    assert value(spark, replies.order(F.lit(reply).cast("string"), F.lit(n))) == order


@pytest.mark.parametrize(("answer", "n", "cited"), [("[2] and [source 3], source 1", 3, [1, 2, 3]), ("[7]", 2, [1, 2]), ("来源2", 2, [2]), ("nothing", 0, []), ("[99999999999]", 1, [1])])
def test_citations(spark, answer, n, cited):
    assert value(spark, replies.cited(F.lit(answer), F.lit(n))) == cited


def test_reply_states_and_variants(spark):
    assert tuple(value(spark, replies.reply_state(F.lit(" "), F.lit("Length")))) == (False, True, "truncated")
    assert tuple(value(spark, replies.reply_state(F.lit("x"), F.lit("stop")))) == (True, False, None)
    assert value(spark, replies.variants(F.lit('1. [" a ", "", "b", "c"]'), 2)) == ["a", "b"]
    assert value(spark, replies.expanded(F.lit("q"), F.array(F.lit("v"), F.lit("q")))) == ["q", "v"]
    assert value(spark, replies.thinking_mark(F.lit("x"), F.lit("hm"))) == "leaked"
    assert value(spark, replies.unverified(F.lit("a"), "careful", F.array(F.lit("s")))) == "careful\n\na\n\nSources: s"


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert value(spark, vectors.cosine(a, b)) == pytest.approx(0.96)
    assert value(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert value(spark, vectors.as_text(b)) == "[4.00000000,3.00000000]"
    with pytest.raises(Exception, match="dimension 2"):
        value(spark, vectors.of_dimension(a, 3))


def test_hashes_and_keys(spark):
    assert value(spark, provenance.content_hash(F.lit("é"))) == hashlib.sha256("é".encode()).hexdigest()
    for name in ("http://x/a", "b"):
        assert value(spark, provenance.url_id(F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    keys = {value(spark, provenance.cache_key(F.lit(kb), question=F.lit(q), department=F.lit(d).cast("string"), level=F.lit(n))) for kb in ("real", "stress") for q in "ab" for d in (None, "", "x") for n in (1, 2)}
    assert len(keys) == 24
