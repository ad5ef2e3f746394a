"""Column functions on text: tokens, headings, sentences, numbers, pipe rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks after which a sentence ends; the ASCII full stop is not one of them.
SENTENCE_ENDS = "。！？!?；;"
#: Marks that a heading doesn't end with.
HEADING_STOPS = "。！？；;.!?，,：:"
HEADING_LENGTH = 40
#: A number: signed, with thousands commas and decimals.
NUMBER = r"[-+]?\d[\d,]*(?:\.\d+)?"
TOKEN_BREAK = r"[^\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Lower-cased words; none of a null or empty text. Another analyser can stand in wherever an array of tokens is asked for."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_BREAK), lambda t: t != "")


def is_heading(line: Column) -> Column:
    """Short, not blank, and without a closing mark."""
    trimmed = F.trim(line)
    return F.coalesce((trimmed != "") & (F.length(trimmed) <= HEADING_LENGTH) & ~F.right(trimmed, F.lit(1)).isin(*HEADING_STOPS), F.lit(False))


def sentences(text: Column) -> Column:
    """Sentences with their closing marks; the rest after the last mark is one, too."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^{SENTENCE_ENDS}]*[{SENTENCE_ENDS}]|[^{SENTENCE_ENDS}]+$"), 0)


def number_tokens(text: Column) -> Column:
    """Numbers without their thousands commas, each once, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), 0), lambda n: F.replace(n, F.lit(","))))


def missing_numbers(raw: Column, told: Column) -> Column:
    """Numbers of ``raw`` that ``told`` lacks."""
    return F.array_except(number_tokens(raw), number_tokens(told))


def missing_tokens(raw: Column, told: Column) -> Column:
    return F.array_except(tokens(raw), tokens(told))


def pipes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit("|")))


def is_pipe_row(line: Column) -> Column:
    return pipes(line) >= 2


def is_separator_row(line: Column) -> Column:
    """A row of a pipe table that only has pipes, colons, dashes and blanks."""
    return F.contains(line, F.lit("|")) & F.trim(line).rlike(r"^[\s|:\-]+$")


def cells(line: Column) -> Column:
    """Cells of a pipe row: one outer pipe on either side goes."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda c: F.trim(c))


def one_line(text: Column, size: int) -> Column:
    """The first ``size`` characters, with line breaks as blanks."""
    return F.left(F.translate(text, "\n", " "), F.lit(size))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def same_line(text: Column, value: Column, anchor: Column) -> Column:
    """Whether some line has both."""
    return F.exists(lines(text), lambda line: F.contains(line, value) & F.contains(line, anchor))


def contains_all(text: Column, spans: Column) -> Column:
    return F.forall(spans, lambda s: F.contains(text, s))


def host_of(connection: Column) -> Column:
    """A connection string without its credentials."""
    return F.substring_index(connection, "@", -1)
