"""Column functions on replies of models: verdicts, orders, variants, citations, states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPTIONS = "array<struct<source:string,summary:string>>"
#: A citation: [source 3], [3] or source 3, in the two spellings of the word.
CITATION = r"\[\s*(?:[Ss]ource|来源)\s*\d+\s*\]|\[\s*\d+\s*\]|(?:[Ss]ource|来源)\s*\d+"


def verdict(reply: Column) -> Column:
    """status (clear, ambiguous, unknown), reason and options of a judge's reply.

    The outermost braces are read as JSON. Without a valid object that has the key
    ``ambiguous`` the status is unknown; a false value in the sense of scripting languages is
    clear (0, "", null, false, empty list or object), any other is ambiguous. Options need a summary.
    """
    body = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\{.*\}", 0)
    value = F.get_json_object(body, "$.ambiguous")
    known = F.array_contains(F.json_object_keys(body), "ambiguous")
    text = F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), "$.ambiguous", "variant")) == "STRING"
    falsy = value.isNull() | (value == "") | (~F.coalesce(text, F.lit(False)) & F.trim(value).isin("false", "0", "0.0", "-0", "-0.0", "[]", "{}"))
    options = F.filter(F.coalesce(F.from_json(F.get_json_object(body, "$.options"), OPTIONS), F.array().cast(OPTIONS)), lambda o: F.trim(F.coalesce(o["summary"], F.lit(""))) != "")
    status = F.when(~F.coalesce(known, F.lit(False)), "unknown").when(falsy, "clear").otherwise("ambiguous")
    return F.struct(status.alias("status"), F.coalesce(F.get_json_object(body, "$.reason"), F.lit("")).alias("reason"), F.when(status == "ambiguous", options).otherwise(F.array().cast(OPTIONS)).alias("options"))


def judged(enabled: Column, n_chunks: Column, reply: Column) -> Column:
    """A verdict that is clear where no judge was asked: switched off, or fewer than two chunks."""
    return F.when(~enabled | (n_chunks < 2), F.struct(F.lit("clear").alias("status"), F.lit("").alias("reason"), F.array().cast(OPTIONS).alias("options"))).otherwise(verdict(reply))


def order(reply: Column, n: Column) -> Column:
    """A permutation of 1..n: the reply's valid numbers, each once, then the others in their order."""
    listed = F.from_json(F.regexp_extract(F.coalesce(reply, F.lit("")), r"\[[\d\s,]*\]", 0), "array<int>")
    valid = F.array_distinct(F.filter(F.coalesce(listed, F.array().cast("array<int>")), lambda i: (i >= 1) & (i <= n)))
    every = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.concat(valid, F.array_except(every, valid))


def variants(reply: Column, n: int) -> Column:
    """The first ``n`` strings of a reply's array that aren't blank, trimmed."""
    listed = F.from_json(F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\[.*\]", 0), "array<string>")
    return F.slice(F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: F.coalesce(v != "", F.lit(False))), 1, n)


def expanded(question: Column, variants: Column) -> Column:
    """All distinct queries, the original first."""
    return F.array_distinct(F.concat(F.array(question), variants))


def reply_state(text: Column, finish: Column) -> Column:
    """answered, truncated and the reason of an empty reply."""
    answered = F.trim(F.coalesce(text, F.lit(""))) != ""
    truncated = F.lower(F.coalesce(finish, F.lit(""))) == "length"
    return F.struct(answered.alias("answered"), truncated.alias("truncated"), F.when(answered, F.lit(None).cast("string")).when(truncated, "truncated").otherwise("empty").alias("empty_reason"))


def thinking_mark(text: Column, reasoning: Column) -> Column:
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty").when(F.trim(F.coalesce(reasoning, F.lit(""))) != "", "leaked").otherwise("clean")


def cited(answer: Column, n: Column) -> Column:
    """Numbers from 1 to ``n`` that an answer cites, in ascending order; all of them if it cites none."""
    found = F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(CITATION), 0), lambda c: F.regexp_extract(c, r"\d+", 0).try_cast("int"))
    valid = F.array_sort(F.array_distinct(F.filter(found, lambda i: F.coalesce((i >= 1) & (i <= n), F.lit(False)))))
    every = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(valid) > 0, valid).otherwise(every)


def unverified(answer: Column, warning: str, sources: Column) -> Column:
    """An answer under a warning, with the sources to ask about if there are any."""
    return F.concat_ws("\n\n", F.lit(warning), answer, F.when(F.size(sources) > 0, F.concat(F.lit("Sources: "), F.array_join(sources, ", "))))
