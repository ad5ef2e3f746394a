"""Structure-aware chunking: blocks to segments by windows, text to chunks by folds, all in SQL functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.provenance import content_hash
from ..functions.tables import with_caption
from ..functions.text import is_heading, sentences
from ..schema import ATOMIC_KINDS

SIZE, OVERLAP = 512, 64
#: A heading ends a chunk that is at least so full; a chunk below the other share is tiny; overlap is capped at a share.
FULL, TINY, OVERLAP_CAP = 0.5, 0.15, 0.25
CHUNK = "struct<text:string,start:int,end:int,title:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chunk(text: Column, start: Column, end: Column, title: Column | None = None) -> Column:
    return F.struct(text.alias("text"), start.cast("int").alias("start"), end.cast("int").alias("end"), (F.lit(None) if title is None else title).cast("string").alias("title"))


def _none() -> Column:
    return F.lit(None).cast(CHUNK)


def _list(*chunks: Column) -> Column:
    return F.array(*chunks) if chunks else F.array().cast(f"array<{CHUNK}>")


def paragraphs(text: Column) -> Column:
    """Lines that aren't blank, trimmed, with the range of the line as it stands."""
    zero = F.struct(F.lit(0).alias("at"), _list().alias("out"))

    def add(s: Column, line: Column) -> Column:
        end = s["at"] + F.length(line)
        kept = F.when(F.trim(line) != "", F.concat(s["out"], F.array(_chunk(F.trim(line), s["at"], end)))).otherwise(s["out"])
        return F.struct((end + 1).alias("at"), kept.alias("out"))

    return F.aggregate(F.split(F.rtrim(F.coalesce(text, F.lit(""))), "\n"), zero, add, lambda s: s["out"])


def _pack(paragraph: Column, size: int, title: Column) -> Column:
    """A long paragraph in pieces of whole sentences; a sentence beyond the size stays whole."""
    zero = F.struct(paragraph["start"].alias("at"), _list().alias("out"))

    def add(s: Column, sentence: Column) -> Column:
        last, end = F.get(s["out"], F.size(s["out"]) - 1), s["at"] + F.length(sentence)
        fits = (F.size(s["out"]) > 0) & (F.length(last["text"]) + F.length(sentence) <= size)
        longer = F.concat(F.slice(s["out"], F.lit(1), F.greatest(F.size(s["out"]) - 1, F.lit(0))), F.array(_chunk(F.concat(last["text"], sentence), last["start"], end, title)))
        apart = F.concat(s["out"], F.array(_chunk(sentence, s["at"], end, title)))
        return F.struct(end.alias("at"), F.when(fits, longer).otherwise(apart).alias("out"))

    return F.aggregate(sentences(paragraph["text"]), zero, add, lambda s: s["out"])


def _gather(paras: Column, size: int) -> Column:
    """Paragraphs gathered up to ``size`` characters; the chunk in the making is ``cur``, null between chunks."""
    zero = F.struct(_list().alias("out"), _none().alias("cur"))
    state = lambda out, cur: F.struct(out.alias("out"), cur.alias("cur"))
    flushed = lambda s: F.when(s["cur"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["cur"])))

    def add(s: Column, p: Column) -> Column:
        cur = s["cur"]
        joined = lambda title: _chunk(F.concat(cur["text"], F.lit("\n"), p["text"]), cur["start"], p["end"], title)
        heading = is_heading(p["text"])
        own = _chunk(p["text"], p["start"], p["end"], p["text"])
        return (
            F.when(heading & (cur.isNull() | (F.length(cur["text"]) >= size * FULL)), state(flushed(s), own))
            .when(heading, state(s["out"], joined(F.coalesce(cur["title"], p["text"]))))
            .when(F.length(p["text"]) > size, state(F.concat(flushed(s), _pack(p, size, cur["title"])), _none()))
            .when(cur.isNotNull() & (F.length(cur["text"]) + F.length(p["text"]) + 1 <= size), state(s["out"], joined(cur["title"])))
            .otherwise(state(flushed(s), p))
        )

    return F.aggregate(paras, zero, add, flushed)


def merge_tiny(chunks: Column, size: int) -> Column:
    """Tiny chunks join the one before where they fit; then a tiny first chunk joins the second."""
    joined = lambda a, b, title: _chunk(F.concat(a["text"], F.lit("\n"), b["text"]), a["start"], b["end"], title)
    fits = lambda a, b: F.length(a["text"]) + F.length(b["text"]) + 1 <= size

    def add(out: Column, c: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        small = (F.size(out) > 0) & (F.length(c["text"]) < size * TINY) & fits(last, c)
        return F.when(small, F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(joined(last, c, last["title"])))).otherwise(F.concat(out, F.array(c)))

    def first(out: Column) -> Column:
        a, b = F.get(out, F.lit(0)), F.get(out, F.lit(1))
        small = (F.size(out) > 1) & (F.length(a["text"]) < size * TINY) & fits(a, b)
        return F.when(small, F.concat(F.array(joined(a, b, F.coalesce(b["title"], a["title"]))), F.slice(out, F.lit(3), F.greatest(F.size(out), F.lit(1))))).otherwise(out)

    return F.aggregate(chunks, _list(), add, first)


def with_overlap(chunks: Column, overlap: int) -> Column:
    """Each chunk after the first behind the end of the one before it, as it was without overlap."""

    def one(all_chunks: Column) -> Column:
        def add(c: Column, i: Column) -> Column:
            before = F.get(all_chunks, i - 1)["text"]
            taken = F.least(F.lit(overlap), F.floor(F.length(before) * OVERLAP_CAP).cast("int"))
            return F.when((i > 0) & (taken > 0), _chunk(F.concat(F.right(before, taken), F.lit("\n"), c["text"]), c["start"], c["end"], c["title"])).otherwise(c)

        return F.transform(all_chunks, add)

    return let(chunks, one) if overlap > 0 else chunks


def split_text(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Chunks (text, start, end, title) of a text; none of a blank or null one."""
    return with_overlap(merge_tiny(_gather(paragraphs(text), size), size), overlap)


def segments(blocks: DataFrame) -> DataFrame:
    """Blocks (document_id, pos, kind, text, page, ...) with their segment: tables and code alone, text up to the next page."""
    along = Window.partitionBy("document_id").orderBy("pos")
    atomic = F.col("kind").isin(*ATOMIC_KINDS)
    begins = F.lag("kind").over(along).isNull() | atomic | F.lag(atomic).over(along) | ~F.lag("page").over(along).eqNullSafe(F.col("page"))
    return blocks.withColumn("segment", F.sum(begins.cast("int")).over(along))


def split_blocks(blocks: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(document_id, chunk_index, kind, content, start_offset, end_offset, title, page, raw_table, table_complex, content_hash).

    A segment that is one heading, right before a table, becomes the table's caption
    and title. Other chunks carry their own title, or the last heading of the segments before.
    """
    block = F.struct("pos", "kind", "text", "page", "raw_table", "table_complex")
    grouped = segments(blocks).groupBy("document_id", "segment").agg(F.array_sort(F.collect_list(block)).alias("group"))
    first = F.get("group", F.lit(0))
    kind = F.when(first["kind"].isin(*ATOMIC_KINDS), first["kind"]).otherwise("text")
    lone = (kind == "text") & (F.size("group") == 1) & (first["kind"] == "heading")
    headings = F.filter("group", lambda b: b["kind"] == "heading")
    along = Window.partitionBy("document_id").orderBy("segment")
    placed = grouped.select(
        "document_id", "segment", "group", kind.alias("kind"), lone.alias("lone"), first.alias("first"), F.get(headings, F.size(headings) - 1)["text"].alias("heading")
    ).select(
        "*", F.last("heading", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("current"),
        (F.col("lone") & (F.lead("kind").over(along) == "table")).alias("swallowed"), F.when((F.col("kind") == "table") & F.lag("lone").over(along), F.lag("heading").over(along)).alias("caption"),
    )
    atomic = F.array(_chunk(with_caption(F.col("first.text"), F.col("caption")), F.lit(0), F.length("first.text"), F.coalesce("caption", "current")))
    told = F.transform(split_text(F.array_join(F.transform("group", lambda b: F.coalesce(b["text"], F.lit(""))), "\n"), size, overlap), lambda c: _chunk(c["text"], c["start"], c["end"], F.coalesce(c["title"], F.col("current"))))
    out = placed.where(~F.coalesce("swallowed", F.lit(False))).select(
        "document_id", "segment", F.when(F.col("kind") == "text", "paragraph").otherwise(F.col("kind")).alias("kind"), "first",
        F.posexplode(F.when(F.col("kind") == "text", told).otherwise(atomic)).alias("part", "chunk"),
    )
    numbered = out.withColumn("chunk_index", F.row_number().over(Window.partitionBy("document_id").orderBy("segment", "part")) - 1)
    return numbered.select(
        "document_id", "chunk_index", "kind", F.col("chunk.text").alias("content"), F.col("chunk.start").alias("start_offset"), F.col("chunk.end").alias("end_offset"), F.col("chunk.title").alias("title"),
        F.col("first.page").alias("page"), F.when(F.col("kind") != "paragraph", F.col("first.raw_table")).alias("raw_table"), F.coalesce(F.when(F.col("kind") != "paragraph", F.col("first.table_complex")), F.lit(False)).alias("table_complex"),
        content_hash(F.col("chunk.text")).alias("content_hash"),
    )
