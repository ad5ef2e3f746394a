"""Queries of sources, sinks, streams, models and reports, over files and rows made of the driver's tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import provenance as P
from ..functions import replies as R
from ..functions import text as TX
from ..functions.vectors import as_text, of_dimension
from ..operators import evaluation as E
from ..operators import governance as G
from ..operators import models as MD
from ..operators import reports as RP
from ..operators.access import identified
from ..sources.parsers import blocks_of, decoded, failure_counts, failure_report, parse_files, texts_of
from ..sources.routing import corpus, describe, route, scoped
from ..sources.scratch import scratch
from ..sources.store import Table, admitted, reloaded, status_of
from ..streaming.ingest import ingest
from ..streaming.jobs import checked_jobs, job_states, still_cached
from .corpus import blocks, chunks, table


def _zipped(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in files.items():
            archive.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def _named(spark, d) -> DataFrame:
    """A file for each page, in seven shapes: what its name says and what its bytes say agree, differ, or say nothing."""
    shapes = [
        ("pdf", b"%PDF-1.4 x"), ("docx", _zipped({"word/document.xml": "x"})), ("bin", _zipped({"xl/workbook.xml": "x"})), ("html", b"<html></html>"),
        ("txt", b"%PDF-1.4 x"), ("csv", b"a,b"), ("zip", _zipped({"other": "x"})),
    ]
    k = F.col("page_id") % len(shapes)
    ext, content = F.lit(None).cast("string"), F.lit(None).cast("binary")
    for i, (name, data) in enumerate(shapes):
        ext, content = F.when(k == i, F.lit(name)).otherwise(ext), F.when(k == i, F.lit(data)).otherwise(content)
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("/in/p"), F.col("page_id").cast("string"), F.lit("."), ext).alias("path"), content.alias("content"))


def route_files(spark, d) -> DataFrame:
    return route(_named(spark, d)).select("page_id", "kind", "confidence", "conflict", F.col("refused").isNotNull().alias("refused"))


def route_summary(spark, d) -> DataFrame:
    return describe(route(_named(spark, d).where("page_id % 7 IN (0, 5)")))


def corpus_listing(spark, d) -> DataFrame:
    return corpus(_named(spark, d)).select("path")


def scope_manifest(spark, d) -> DataFrame:
    """Departments that a manifest of every third file names."""
    files = _named(spark, d).select("page_id", "path")
    manifest = files.where("page_id % 3 = 0").select(F.regexp_extract("path", r"[^/]*$", 0).alias("file"), F.concat(F.lit("d"), (F.col("page_id") % 5).cast("string")).alias("department"))
    return scoped(files, manifest).select("page_id", "department")


def _csv_files(spark, d) -> DataFrame:
    rows = table(spark, d, "nation").withColumn("line", F.concat(F.col("n_nationkey").cast("string"), F.lit(","), "n_name"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("n_regionkey").agg(F.concat(F.lit("key,name\n"), listed).alias("text")).select(
        F.concat(F.lit("/in/region"), F.col("n_regionkey").cast("string"), F.lit(".csv")).alias("path"), F.encode("text", "UTF-8").alias("content")
    )


def parse_csv(spark, d) -> DataFrame:
    return blocks_of(parse_files(route(_csv_files(spark, d)))).select("document_id", "pos", "kind", "text", "raw_table", "table_complex")


def csv_groups(spark, d) -> DataFrame:
    """Tables of parts by brand, in groups of sixty rows."""
    line = F.concat(F.col("p_partkey").cast("string"), F.lit(","), F.col("p_size").cast("string"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))), lambda x: x["line"]), "\n")
    files = table(spark, d, "part").groupBy("p_brand").agg(F.concat(F.lit("key,size\n"), listed).alias("text")).select(F.concat(F.lit("/in/"), "p_brand", F.lit(".csv")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    made = blocks_of(parse_files(route(files)))
    return made.select("document_id", "pos", (F.size(F.split("raw_table", "\n")) - 2).alias("n"))


def parse_markdown(spark, d) -> DataFrame:
    text = F.concat(F.lit("# "), "s_name", F.lit("\n\nnation "), F.col("s_nationkey").cast("string"), F.lit("\n```\n# no heading\n```\n"))
    files = table(spark, d, "supplier").select(F.concat(F.lit("/in/"), F.col("s_suppkey").cast("string"), F.lit(".md")).alias("path"), F.encode(text, "UTF-8").alias("content"))
    return blocks_of(parse_files(route(files))).select("document_id", "pos", "kind", "text")


def parse_plain(spark, d) -> DataFrame:
    """Conversations as text files, a paragraph a turn."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.translate(x["text"], "\n\r", "  ")), "\n\n")
    files = table(spark, d, "conversations").groupBy("conv_id").agg(listed.alias("text")).select(F.concat(F.lit("/in/"), F.col("conv_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return texts_of(parse_files(route(files))).select("path", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_NS = {"w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "s": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "a": "http://schemas.openxmlformats.org/drawingml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def _office(kind: str, title: str, rows: list[list[str]]) -> bytes:
    """The least office file with a title and a table."""
    if kind == "docx":
        cells = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in rows)
        head = f"<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>{title}</w:t></w:r></w:p>"
        return _zipped({"word/document.xml": f'<w:document xmlns:w="{_NS["w"]}"><w:body>{head}<w:tbl>{cells}</w:tbl></w:body></w:document>'})
    if kind == "xlsx":
        cells = "".join("<row>" + "".join(f'<c r="{chr(65 + i)}{n}" t="inlineStr"><is><t>{c}</t></is></c>' for i, c in enumerate(r)) + "</row>" for n, r in enumerate(rows, 1))
        return _zipped({
            "xl/workbook.xml": f'<workbook xmlns="{_NS["s"]}" xmlns:r="{_NS["r"]}"><sheets><sheet name="{title}" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_NS["s"]}"><sheetData>{cells}</sheetData></worksheet>',
        })
    cells = "".join("<a:tr>" + "".join(f"<a:tc><a:txBody><a:p><a:r><a:t>{c}</a:t></a:r></a:p></a:txBody></a:tc>" for c in r) + "</a:tr>" for r in rows)
    return _zipped({"ppt/slides/slide1.xml": f'<p xmlns:a="{_NS["a"]}"><a:p><a:r><a:t>{title}</a:t></a:r></a:p><a:tbl>{cells}</a:tbl></p>'})


def parse_office(spark, d) -> DataFrame:
    """A region's nations as a Word document, a workbook and slides."""

    @F.pandas_udf("binary")
    def made(kind: pd.Series, title: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([_office(k, t, [["name"], *[[n] for n in ns]]) for k, t, ns in zip(kind, title, names, strict=True)], dtype=object)

    regions = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    each = regions.withColumn("kind", F.explode(F.array(*map(F.lit, ("docx", "xlsx", "pptx"))))).withColumn("title", F.concat(F.lit("region"), F.col("n_regionkey").cast("string")))
    files = each.select(F.concat(F.lit("/in/"), "title", F.lit("."), "kind").alias("path"), made("kind", "title", "names").alias("content"))
    return blocks_of(parse_files(route(files))).select("document_id", "pos", "kind", "text", "page")


def _broken(spark, d) -> DataFrame:
    path = F.concat(F.lit("/in/"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, ".docx").otherwise(".txt"))
    content = F.when(F.col("s_suppkey") % 3 == 0, F.lit(b"")).otherwise(F.encode("s_name", "UTF-8"))
    return parse_files(route(table(spark, d, "supplier").select(path.alias("path"), content.alias("content"))))


def broken_files(spark, d) -> DataFrame:
    return failure_report(_broken(spark, d)).select("path", F.element_at(F.split("report", "\n"), 2).alias("route"))


def failure_signatures(spark, d) -> DataFrame:
    return failure_counts(_broken(spark, d))


def file_failure_rates(spark, d) -> DataFrame:
    attempts = _broken(spark, d).select(F.when(F.endswith("path", F.lit(".docx")), "docx").otherwise("txt").alias("path"), F.col("parsed.ok").alias("ok"))
    return RP.failure_rates(attempts)


def encodings(spark, d) -> DataFrame:
    """Names of parts with accents, in four encodings, read back."""

    @F.pandas_udf("string")
    def read(data: pd.Series) -> pd.Series:
        return data.map(lambda x: decoded(bytes(x)))

    text = F.concat("p_name", F.lit(" déjà vu, naïve façade"))
    k = F.col("p_partkey") % 4
    content = F.when(k == 0, F.encode(text, "UTF-8")).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))).when(k == 2, F.encode(text, "UTF-16")).otherwise(F.encode(text, "ISO-8859-1"))
    return table(spark, d, "part").select("p_partkey", read(content).alias("text"))


def json_lines(spark, d) -> DataFrame:
    """Questions written as JSON lines and read again."""
    path = scratch(spark)
    table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("clear").alias("kind"), F.col("text").alias("question")).write.json(path)
    return E.read_questions(spark, path).select("id", "kind", "question")


def paraphrases(spark, d) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.array("p_name", F.lit("  "), F.concat(F.lit(" "), "p_type"), "p_brand").alias("variants"))
    return E.paraphrased(rows).select("p_partkey", F.array_join("variants", "|").alias("variants"))


def corpus_variants(spark, d) -> DataFrame:
    """Regions as texts, for three departments each."""
    texts = table(spark, d, "nation").select(F.concat("n_name", F.lit(".md")).alias("file"), F.concat("n_name", F.lit("\nkey "), F.col("n_nationkey").cast("string"), F.lit(" of 25")).alias("text"))
    units = spark.createDataFrame([("sales", 100), ("legal", 200), ("it", 300)], "department string, offset long")
    return E.department_variants(texts, units)


def audit_scan(spark, d) -> DataFrame:
    """A log of events, with other text on every line, written and counted."""
    path = scratch(spark)
    line = F.concat(F.lit("12:00 INFO "), F.to_json(F.struct(F.col("event_type").alias("event"), "user_id")), F.lit(" done"))
    table(spark, d, "events").select(line.alias("value")).write.text(path)
    return E.audit_log(spark, path)


def prompt_template(spark, d) -> DataFrame:
    made = MD.template("Sources:\n{context}\nAsk {name} about {missing}.", context=F.col("r_regionkey"), name=F.col("n_name"))
    both = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_nationkey", made.alias("prompt"))


def text_lookup(spark, d) -> DataFrame:
    """Nations' texts from two folders, of which the first has some only."""
    names = table(spark, d, "nation").select(F.col("n_name").alias("file"), "n_nationkey")
    files = names.where("n_nationkey % 2 = 0").select("file", F.lit(1).alias("priority"), F.lit("first").alias("text")).unionByName(names.where("n_nationkey % 3 = 0").select("file", F.lit(2).alias("priority"), F.lit("second").alias("text")))
    return RP.text_of(names, files)


def store_cycle(spark, d) -> DataFrame:
    """A store after chunks were put in, some replaced, some deleted, and some put in again."""
    made = Table(spark, scratch(spark), "stress", "chunks", "document_id", "document_id long, chunk_index int, content string", buckets=8)
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), F.col("lang").alias("content"))
    made.replace(rows.select("document_id"), rows)
    fresh = rows.where("document_id % 5 = 0").withColumn("content", F.lit("new"))
    made.replace(fresh.select("document_id"), fresh.unionByName(fresh.withColumn("chunk_index", F.lit(1))))
    made.delete(rows.where("document_id % 3 = 0").select("document_id"))
    made.upsert(rows.where("document_id % 9 = 0").withColumn("content", F.lit("again")))
    return made.read()


def store_emptied(spark, d) -> DataFrame:
    made = Table(spark, scratch(spark), "real", "documents", "id", "id long", buckets=4)
    made.upsert(table(spark, d, "region").select(F.col("r_regionkey").alias("id").cast("long")))
    before = made.count()
    made.truncate()
    return spark.createDataFrame([(before, made.count())], "before long, after long")


def _documents(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        k.cast("string").alias("id"), F.concat(F.lit("f"), k.cast("string"), F.lit(".md")).alias("filename"), F.when(k % 2 == 0, F.col("s_name")).alias("original_name"), F.when(k % 4 == 0, "failed").otherwise("completed").alias("status"),
        F.when(k % 4 == 0, "broken").alias("error"), F.lit(1).alias("version"), (k % 7).cast("int").alias("chunk_count"), (k % 5 == 0).alias("is_deleted"),
    )


def status_transitions(spark, d) -> DataFrame:
    """The status that each user's events lead to."""
    steps = F.create_map(*[F.lit(x) for pair in {"view": "pending", "click": "processing", "purchase": "completed", "error": "failed", "signup": "pending"}.items() for x in pair])
    rows = table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("at"), F.element_at(steps, F.col("event_type")).alias("status"), F.when(F.col("event_type") == "error", "broken").alias("error"))
    return status_of(rows)


def reloaded_documents(spark, d) -> DataFrame:
    docs = _documents(spark, d)
    return reloaded(docs, docs.where("CAST(id AS int) % 3 = 0").select("id")).select("id", "status", "error", "version")


def upload_admission(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.lit("C:\\in\\"), k.cast("string"), F.when(k % 4 == 0, ".exe").otherwise(".MD"))
    rows = table(spark, d, "part").select(k, name.alias("name"), (k * 100_000).alias("size"), (k % 5).alias("secret_level"), F.lit(3).alias("clearance"))
    return admitted(rows, ["md", "txt"]).select("p_partkey", "original_name", "rejected")


def resolved_name(spark, d) -> DataFrame:
    docs = _documents(spark, d)
    return spark.createDataFrame([(n, G.resolve(docs, n)) for n in ("f1.md", "f7.md")], "name string, id string")


def status_lookup(spark, d) -> DataFrame:
    return RP.status_in(_documents(spark, d), spark.range(0, 40).select(F.col("id").cast("string").alias("id")))


def document_snapshots(spark, d) -> DataFrame:
    docs = _documents(spark, d)
    after = G.corrected(docs.withColumn("content_status", F.lit("active")), F.col("id") == "3", ["content_status=stale"], G.DOCUMENT_FIELDS)
    found = [RP.snapshot(df, F.col("id") == "3", ["id", "status", "content_status"]) for df in (docs.withColumn("content_status", F.lit("active")), after)]
    return spark.createDataFrame([(n, s["id"], s["status"], s["content_status"]) for n, s in zip(("before", "after"), found, strict=True)], "side string, id string, status string, content_status string")


def report_artefacts(spark, d) -> DataFrame:
    path, docs = scratch(spark), _documents(spark, d)
    RP.report(docs.groupBy("status").agg(F.count(F.lit(1)).alias("n")), docs.select("id", "status"), path)
    return spark.read.schema("status string, n long").json(f"{path}/summary").join(spark.read.schema("id string, status string").json(f"{path}/details").groupBy("status").agg(F.count(F.lit(1)).alias("listed")), "status")


def schema_compare(spark, d) -> DataFrame:
    a = table(spark, d, "nation")
    return spark.createDataFrame(G.schema_differences(a, a.withColumn("n_regionkey", F.col("n_regionkey").cast("string")).drop("n_name")), "column string, type string, side string").select("column", "side")


def reproducible_build(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    runs = [G.fingerprint(df, ["doc_id"], F.col("text")) for df in (docs, docs.repartition(3), docs.where("doc_id >= 0"))]
    return G.reproducible(runs[0].unionByName(runs[1]).unionByName(runs[2]))


def settings_compare(spark, d) -> DataFrame:
    defaults = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("value"))
    example = defaults.join(table(spark, d, "nation").select(F.col("n_name").alias("name"), "n_nationkey"), "name").where("n_nationkey % 4 <> 0").select("name", F.when(F.col("n_nationkey") % 3 == 0, "x").otherwise(F.col("value")).alias("value"))
    return E.compared_settings(example, defaults)


def token_identity(spark, d) -> DataFrame:
    users = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("token"))
    requests = table(spark, d, "supplier").select("s_suppkey", F.concat(F.when(F.col("s_suppkey") % 3 == 0, "Basic ").otherwise("Bearer "), F.lit("t"), (F.col("s_suppkey") % 30).cast("string")).alias("authorization"))
    return identified(requests, users).select("s_suppkey", "name", "status")


def spans_contained(spark, d) -> DataFrame:
    """Whether pages hold all of two spans, and some line both of two words."""
    spans = F.array(F.lit("<h1>"), F.concat(F.lit("p"), F.col("page_id").cast("string")))
    return table(spark, d, "pages").select("page_id", TX.contains_all(F.col("html"), spans).alias("all_spans"), TX.same_line(F.col("html"), F.lit("<h1>"), F.lit("</body>")).alias("one_line"))


def masked_connections(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", TX.host_of(F.concat(F.lit("db://user:p@ss"), F.col("s_suppkey").cast("string"), F.lit("@host"), F.col("s_nationkey").cast("string"), F.lit("/x"))).alias("host"))


def layered_property(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(k, F.when(k % 5 == 0, "run").alias("a"), F.when(k % 3 == 0, "style").alias("b"), F.lit("document").alias("c"))
    return rows.select("s_suppkey", E.layered("a", "b", "c").alias("value"))


def unverified_answers(spark, d) -> DataFrame:
    sources = F.when(F.col("n_regionkey") > 1, F.array("n_name", F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "nation").select("n_nationkey", R.unverified(F.concat(F.lit("answer "), "n_name"), "Not verified.", sources).alias("answer"))


def vector_text(spark, d) -> DataFrame:
    checked = of_dimension(F.col("embedding"), 64)
    return table(spark, d, "embeddings").select("vec_id", as_text(F.slice(checked, 1, 2)).alias("written"))


def version_stamps(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *P.stamps(F.col("text").cast("binary"), "plain-1", "fold-2", "hash", 64))


def thinking_marks(spark, d) -> DataFrame:
    k = F.col("o_orderkey") % 3
    mark = R.thinking_mark(F.when(k == 0, " ").otherwise(F.col("o_orderstatus")), F.when(k == 1, "because").otherwise(F.lit(None).cast("string")))
    return table(spark, d, "orders").select(mark.alias("mark")).groupBy("mark").agg(F.count(F.lit(1)).alias("n"))


def warnings_once(spark, d) -> DataFrame:
    first = RP.with_warning(F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("w1"))), F.concat(F.lit("w"), F.col("n_regionkey").cast("string")))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(RP.with_warning(first, F.lit("w1")), ",").alias("warnings"))


def display_names(spark, d) -> DataFrame:
    return _documents(spark, d).select("id", RP.display_name(F.col("original_name"), F.col("filename")).alias("name"))


def event_times(spark, d) -> DataFrame:
    """Seconds of the epoch of events, and how many were there by now."""
    return table(spark, d, "events").select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("seconds"), (F.col("ts").cast("timestamp") <= F.current_timestamp()).alias("past"))


def heading_counts(spark, d) -> DataFrame:
    """Parts' names as paragraphs: bold in every third, of the size of the part."""
    rows = table(spark, d, "part").select(F.col("p_brand").alias("file"), F.col("p_name").alias("text"), (F.col("p_partkey") % 3 == 0).alias("bold"), F.col("p_size").cast("double").alias("size"))
    return E.heading_candidates(rows)


def table_length_report(spark, d) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("lang").alias("source_file"), F.when(F.col("doc_id") % 2 == 0, "table").otherwise("text").alias("kind"), F.col("text").alias("content"))
    return E.table_lengths(rows)


def _placed(spark, d) -> DataFrame:
    """Events as ranked hits of questions, the users: the latest first."""
    hits = table(spark, d, "events").select(F.col("user_id").alias("question_id"), F.col("event_type").alias("source_file"), "event_id", F.concat("event_type", F.lit(" "), F.col("event_id").cast("string"), F.lit("\nanchor "), (F.col("event_id") % 3).cast("string")).alias("content"))
    from pyspark.sql import Window

    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("event_id"))))


def rank_by_anchor(spark, d) -> DataFrame:
    hits = _placed(spark, d).withColumns({"expected": F.lit("purchase"), "anchor": F.lit("anchor 1")})
    return RP.first_by(hits, "expected").join(RP.first_by(hits, "expected", "anchor").withColumnRenamed("rank", "anchored"), "question_id")


def numeric_rates(spark, d) -> DataFrame:
    hits = _placed(spark, d).where("rank = 1").select(
        F.when(F.col("question_id") % 4 != 0, (F.col("question_id") % 6 + 1)).alias("rank"), "content", F.col("source_file").alias("value"), F.lit("anchor 1").alias("anchor"), (F.col("event_id") % 2 == 0).alias("broken")
    )
    return RP.numeric_rates(hits)


def slow_and_fast_means(spark, d) -> DataFrame:
    calls = table(spark, d, "events").select(F.when(F.col("value") > 50, "slow").otherwise("fast").alias("grp"), F.col("value").alias("ms"), F.length("props").alias("length"))
    return RP.group_means(calls, 90.0)


def verdict_scopes(spark, d) -> DataFrame:
    hits = _placed(spark, d).where("rank <= 5")
    return RP.verdicts_by_scope(hits, {"none": F.lit(False), "some": F.col("source_file").isin("click", "view"), "full": F.lit(True)})


def value_deciles(spark, d) -> DataFrame:
    return RP.deciles(table(spark, d, "events"), "value", "event_type")


def first_sources(spark, d) -> DataFrame:
    return RP.first_sources(_placed(spark, d).withColumnRenamed("question_id", "query_id"), 3).select("query_id", F.array_join("sources", ",").alias("sources"))


def most_changed_words(spark, d) -> DataFrame:
    side = lambda name: table(spark, d, name).select(F.explode(TX.tokens(F.col("text"))).alias("word"))
    return RP.most_changed(G.multiset_difference(side("benchmark"), side("conversations"), "word"))


def labelled_parts(spark, d) -> DataFrame:
    rows = table(spark, d, "labels")
    return RP.labelled_union({"good": rows.where("quality = 1").select("doc_id"), "toxic": rows.where("toxic = 1").select("doc_id")}).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def block_sequences(spark, d) -> DataFrame:
    """Blocks against the same ones, of which every third document's last is cut."""
    rows = blocks(spark, d).select("document_id", "pos", "kind", "text")
    other = rows.withColumn("text", F.when((F.col("document_id") % 3 == 0), F.left("text", F.lit(3))).otherwise(F.col("text")))
    return RP.same_blocks(rows, other)


def chunk_projection(spark, d) -> DataFrame:
    rows = chunks(spark, d).select(F.col("chunk_id").cast("string").alias("id"), "chunk_index", "department", "secret_level", "source_file", F.col("chunk_id").alias("score"))
    return RP.chunk_rows(rows).select("id", "department", "secret_level", "source_file", "score", F.col("page").isNull().alias("no_page"))


def shown_sources(spark, d) -> DataFrame:
    rows = chunks(spark, d).select(F.col("chunk_id").alias("query_id"), F.lit(1).alias("rank"), "source_file", "chunk_index", (F.col("chunk_id") / 7).alias("score"), (F.col("chunk_id") % 4).cast("int").alias("page"), "raw_table")
    return RP.sources_shown(rows).select("query_id", "rank", "source_file", "page", "raw_table", F.round("score", 3).alias("score"))


def ingested_files(spark, d) -> DataFrame:
    """Files into chunks with vectors, a store, and stamps of their content."""
    files = _csv_files(spark, d)
    made, _ = ingest(files)
    whole = MD.with_embeddings(made, "content", MD.HashEmbedder(16))
    kept = Table(spark, scratch(spark), "real", "chunks", "document_id", "document_id string, chunk_index int, content string, embedding array<float>", buckets=4)
    kept.replace(files.select(F.col("path").alias("document_id")), whole.select("document_id", "chunk_index", "content", "embedding"))
    stamps = files.select(F.col("path").alias("document_id"), *P.stamps(F.col("content"), "csv-1", "fold-2", "hash", 16))
    return kept.read().groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.min(F.size("embedding")).alias("dimension")).join(stamps.select("document_id", "source_hash", "embedding_model"), "document_id")


def embedded_texts(spark, d) -> DataFrame:
    made = MD.with_embeddings(table(spark, d, "benchmark"), "text", MD.HashEmbedder(32))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return made.select("item_id", F.size("embedding").alias("dimension"), F.round(length, 3).alias("length"))


def _longer_first(prompt: str) -> tuple[str, str]:
    """A model that orders numbered snippets backwards, and fails where the question has an odd number of words."""
    question, *lines = prompt.split("\n")
    if len(question.split(" ")) % 2:
        raise TimeoutError("no answer")
    return str([len(lines) - 1 - i for i in range(len(lines) - 1)]), "stop"


def _turns_as_candidates(spark, d) -> DataFrame:
    first = table(spark, d, "conversations").where("turn = 0").select("conv_id", F.col("text").alias("question"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text").join(first, "conv_id")
    return rows.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("chunk_id"), (F.col("turn") + 1).cast("int").alias("rank"), F.translate("question", "\n", " ").alias("question"), F.translate("text", "\n", " ").alias("content"))


def model_reranked(spark, d) -> DataFrame:
    return MD.model_rerank(_turns_as_candidates(spark, d), _longer_first)


def pair_reranked(spark, d) -> DataFrame:
    """By the length of what a candidate says, the longest first."""
    return MD.pair_scores(_turns_as_candidates(spark, d), lambda pairs: [float(len(c)) for _, c in pairs]).select("query_id", "chunk_id", "candidate_rank", "rank", "rerank_score")


def _other_wordings(prompt: str) -> tuple[str, str]:
    name = prompt.rsplit("\n", 1)[-1]
    if name.startswith("A"):
        raise ConnectionError("refused")
    return f'["{name} again", "{name}", " "]', "stop"


def expanded_questions(spark, d) -> DataFrame:
    asked = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("question"))
    return MD.expanded_queries(asked, _other_wordings)


def _judge(prompt: str) -> tuple[str, str]:
    name = prompt.split("\n")[1]
    return (f'{{"ambiguous": true, "options": [{{"source": "a", "summary": "{name} one"}}, {{"source": "b", "summary": "{name} two"}}]}}' if len(name) % 2 else '{"ambiguous": false}'), "stop"


def clarified(spark, d) -> DataFrame:
    asked = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("question"), F.lit("x").alias("candidates"), (F.col("n_nationkey") % 3).cast("int").alias("n"))
    made = MD.judged_questions(asked, _judge)
    return made.select("query_id", MD.is_ambiguous(F.col("status")).alias("ambiguous"), MD.is_unknown(F.col("status")).alias("unknown"), MD.clarification(F.col("options")).alias("question"))


def generated_answers(spark, d) -> DataFrame:
    asked = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("question"), F.lit("[1] x\n\n[2] y").alias("context"), F.lit(2).alias("n"))
    made = MD.answered(asked, lambda prompt: (f"It is {prompt.rsplit(' ', 1)[-1].lower()} [2].", "stop"))
    return made.select("query_id", "answer", F.array_join(F.transform("cited", lambda i: i.cast("string")), ",").alias("cited"))


def job_arguments(spark, d) -> DataFrame:
    k = F.col("s_suppkey") % 3
    full = F.create_map(F.lit("document_id"), F.lit("1"), F.lit("path"), F.lit("p"), F.lit("kb"), F.lit("real"))
    jobs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("job_id"), F.when(k == 0, full).when(k == 1, F.map_filter(full, lambda key, _: key != "kb")).otherwise(F.map_concat(full, F.create_map(F.lit("extra"), F.lit("1")))).alias("arguments"))
    return checked_jobs(jobs).select("job_id", "rejected")


def job_outcomes(spark, d) -> DataFrame:
    """Events as attempts of jobs, the users: purchases succeed."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    attempts = table(spark, d, "events").select(F.col("user_id").alias("job_id"), place.alias("attempt"), (F.col("event_type") == "purchase").alias("ok"), (F.col("value") * 20).alias("seconds"), F.col("event_type").alias("error"))
    return job_states(attempts)


def cache_entries(spark, d) -> DataFrame:
    """Answers stored at an order's date and asked for within minutes, by stores that change once each."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("kb"), F.col("o_orderdate").cast("timestamp").alias("stored_at"), "o_orderkey")
    entries = o.select("key", "kb", "stored_at", F.timestamp_seconds(F.unix_timestamp("stored_at") + (F.col("o_orderkey") % 90) * 60).alias("asked_at"))
    changes = o.groupBy("kb").agg(F.min("stored_at").alias("changed_at"))
    return still_cached(entries, changes).groupBy("kb").agg(F.count(F.lit(1)).alias("fresh"))


_KIND = "CASE page_id % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'xlsx' WHEN 4 THEN 'pdf' WHEN 5 THEN 'csv' END"
_EXT = "CASE page_id % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'bin' WHEN 3 THEN 'html' WHEN 4 THEN 'txt' WHEN 5 THEN 'csv' ELSE 'zip' END"
_DOCS = """docs AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_suppkey AS k, 'f' || s_suppkey || '.md' AS filename, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS original_name,
    CASE WHEN s_suppkey % 4 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN s_suppkey % 4 = 0 THEN 'broken' END AS error, CAST(s_suppkey % 7 AS INTEGER) AS chunk_count, s_suppkey % 5 = 0 AS is_deleted FROM supplier)"""
_PLACED = "placed AS (SELECT user_id AS question_id, event_type AS source_file, event_id, event_type || ' ' || event_id || chr(10) || 'anchor ' || (event_id % 3) AS content, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS INTEGER) AS rank FROM events)"
_WORDS = "string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+')"
_CANDIDATES = "cand AS (SELECT c.conv_id AS query_id, c.turn AS chunk_id, CAST(c.turn + 1 AS INTEGER) AS rank, replace(f.text, chr(10), ' ') AS question, replace(c.text, chr(10), ' ') AS content, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS p, count(*) OVER (PARTITION BY c.conv_id) AS n FROM conversations c JOIN conversations f ON f.conv_id = c.conv_id AND f.turn = 0)"

PAIRS = {
    "src_route_files": (route_files, f"SELECT page_id, {_KIND} AS kind, CASE WHEN page_id % 7 = 5 THEN 'medium' ELSE 'high' END AS confidence, CASE WHEN page_id % 7 = 4 THEN 'named text, is pdf' END AS conflict, page_id % 7 IN (3, 6) AS refused FROM pages"),
    "src_route_summary": (route_summary, "SELECT '/in/p' || page_id || CASE WHEN page_id % 7 = 0 THEN '.pdf' ELSE '.csv' END AS path, CASE WHEN page_id % 7 = 0 THEN 'pdf via pdf (high)' ELSE 'csv via csv (medium)' END AS summary FROM pages WHERE page_id % 7 IN (0, 5)"),
    "src_corpus_listing": (corpus_listing, f"SELECT '/in/p' || page_id || '.' || {_EXT} AS path FROM pages WHERE page_id % 7 NOT IN (2, 3, 6)"),
    "src_scope_manifest": (scope_manifest, "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'd' || (page_id % 5) ELSE 'company' END AS department FROM pages"),
    "src_parse_csv": (parse_csv, "SELECT '/in/region' || n_regionkey || '.csv' AS document_id, CAST(0 AS INTEGER) AS pos, 'table' AS kind, 'region' || n_regionkey || chr(10) || string_agg('key=' || n_nationkey || ', name=' || n_name, '；' ORDER BY n_nationkey) AS text, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS raw_table, false AS table_complex FROM nation GROUP BY n_regionkey"),
    "src_csv_groups": (csv_groups, "SELECT '/in/' || p_brand || '.csv' AS document_id, CAST(g AS INTEGER) AS pos, CAST(count(*) AS INTEGER) AS n FROM (SELECT p_brand, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 60 AS g FROM part) GROUP BY p_brand, g"),
    "src_parse_markdown": (parse_markdown, "SELECT '/in/' || s_suppkey || '.md' AS document_id, CAST(k AS INTEGER) AS pos, CASE k WHEN 0 THEN 'heading' WHEN 1 THEN 'paragraph' ELSE 'code' END AS kind, CASE k WHEN 0 THEN s_name WHEN 1 THEN 'nation ' || s_nationkey ELSE '```' || chr(10) || '# no heading' || chr(10) || '```' END AS text FROM supplier, range(3) r(k)"),
    "src_parse_plain": (parse_plain, "SELECT '/in/' || conv_id || '.txt' AS path, md5(string_agg(trim(translate(text, chr(10) || chr(13), '  ')), chr(10) ORDER BY turn)) AS text_md5 FROM conversations GROUP BY conv_id"),
    "src_parse_office": (parse_office, "WITH r AS (SELECT 'region' || n_regionkey AS title, string_agg('name=' || n_name, '；' ORDER BY n_name) AS told FROM nation GROUP BY 1) SELECT '/in/' || title || '.docx' AS document_id, CAST(0 AS INTEGER) AS pos, 'heading' AS kind, title AS text, CAST(NULL AS INTEGER) AS page FROM r UNION ALL SELECT '/in/' || title || '.docx', 1, 'table', told, NULL FROM r UNION ALL SELECT '/in/' || title || '.xlsx', 0, 'table', title || chr(10) || told, NULL FROM r UNION ALL SELECT '/in/' || title || '.pptx', 0, 'table', 'page 1' || chr(10) || told, 1 FROM r UNION ALL SELECT '/in/' || title || '.pptx', 1, 'paragraph', title, 1 FROM r"),
    "src_failure_report": (broken_files, "SELECT '/in/' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.docx' ELSE '.txt' END AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'route: docx' ELSE 'route: text' END AS route FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0"),
    "src_failure_signatures": (failure_signatures, "SELECT 'BadZipFile: File is not a zip file' AS signature, count(*) AS n FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'no content', count(*) FROM supplier WHERE s_suppkey % 2 = 1 AND s_suppkey % 3 = 0"),
    "agg_failure_rates": (file_failure_rates, "SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'docx' ELSE 'txt' END AS path, count(*) AS attempts, count(*) FILTER (WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0) AS failures, round(count(*) FILTER (WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0) / count(*), 6) AS rate FROM supplier GROUP BY 1"),
    "src_encodings": (encodings, "SELECT p_partkey, p_name || ' déjà vu, naïve façade' AS text FROM part"),
    "src_json_lines": (json_lines, "SELECT item_id AS id, 'clear' AS kind, text AS question FROM benchmark"),
    "src_paraphrases": (paraphrases, "SELECT p_partkey, p_name || '|' || p_type AS variants FROM part"),
    "src_corpus_variants": (corpus_variants, "SELECT 'dept_' || d || '_' || n_name || '.md' AS file, d AS department, d || ' ' || n_name || chr(10) || 'key ' || (n_nationkey + o) || ' of ' || (25 + o) AS text FROM nation, (VALUES ('sales', 100), ('legal', 200), ('it', 300)) u(d, o)"),
    "src_audit_scan": (audit_scan, "SELECT event_type AS event, count(*) AS n FROM events GROUP BY 1"),
    "src_prompt_template": (prompt_template, "SELECT n_nationkey, 'Sources:' || chr(10) || n_regionkey || chr(10) || 'Ask ' || n_name || ' about {missing}.' AS prompt FROM nation"),
    "src_text_lookup": (text_lookup, "SELECT n_name AS file, CASE WHEN n_nationkey % 2 = 0 THEN 'first' WHEN n_nationkey % 3 = 0 THEN 'second' ELSE '' END AS text FROM nation"),
    "snk_store_cycle": (store_cycle, "SELECT doc_id AS document_id, CAST(0 AS INTEGER) AS chunk_index, CASE WHEN doc_id % 9 = 0 THEN 'again' WHEN doc_id % 5 = 0 THEN 'new' ELSE lang END AS content FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 9 = 0 UNION ALL SELECT doc_id, 1, 'new' FROM documents WHERE doc_id % 5 = 0 AND doc_id % 3 <> 0"),
    "snk_store_emptied": (store_emptied, "SELECT count(*) AS before, CAST(0 AS BIGINT) AS after FROM region"),
    "snk_status_transitions": (status_transitions, "SELECT user_id AS document_id, arg_max(CASE event_type WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'pending' END, event_id) AS status, nullif(arg_max(CASE WHEN event_type = 'error' THEN 'broken' ELSE '' END, event_id), '') AS error FROM events GROUP BY 1"),
    "snk_reloaded": (reloaded_documents, f"WITH {_DOCS} SELECT id, CASE WHEN k % 3 = 0 AND NOT is_deleted THEN 'pending' ELSE status END AS status, CASE WHEN k % 3 = 0 AND NOT is_deleted THEN NULL ELSE error END AS error, CAST(CASE WHEN k % 3 = 0 AND NOT is_deleted THEN 2 ELSE 1 END AS INTEGER) AS version FROM docs"),
    "snk_upload_admission": (upload_admission, "SELECT p_partkey, p_partkey || CASE WHEN p_partkey % 4 = 0 THEN '.exe' ELSE '.MD' END AS original_name, CASE WHEN p_partkey % 4 = 0 THEN 'extension' WHEN p_partkey % 5 > 3 THEN 'clearance' WHEN p_partkey * 100000 > 52428800 THEN 'size' END AS rejected FROM part"),
    "snk_resolved_name": (resolved_name, "SELECT 'f1.md' AS name, '1' AS id UNION ALL SELECT 'f7.md', '7'"),
    "flt_status_lookup": (status_lookup, f"WITH {_DOCS} SELECT CAST(i AS VARCHAR) AS id, CAST(CASE WHEN d.id IS NULL THEN 404 ELSE 200 END AS INTEGER) AS http, status, error, chunk_count FROM range(40) r(i) LEFT JOIN docs d ON d.k = i"),
    "snk_snapshots": (document_snapshots, f"WITH {_DOCS} SELECT side, id, status, content_status FROM docs, (VALUES ('before', 'active'), ('after', 'stale')) v(side, content_status) WHERE id = '3'"),
    "snk_reports": (report_artefacts, f"WITH {_DOCS} SELECT status, count(*) AS n, count(*) AS listed FROM docs GROUP BY 1"),
    "jn_schema_compare": (schema_compare, "SELECT * FROM (VALUES ('n_name', 'first'), ('n_regionkey', 'first'), ('n_regionkey', 'second')) v(\"column\", side)"),
    "agg_reproducible": (reproducible_build, "SELECT true AS reproducible"),
    "jn_settings_compare": (settings_compare, "SELECT n_name AS name, CASE WHEN n_nationkey % 4 = 0 THEN 'missing' WHEN n_nationkey % 3 = 0 THEN 'different' ELSE 'same' END AS state FROM nation"),
    "jn_token_identity": (token_identity, "SELECT s_suppkey, n_name AS name, CAST(CASE WHEN n_name IS NULL THEN 401 ELSE 200 END AS INTEGER) AS status FROM supplier LEFT JOIN nation ON s_suppkey % 3 <> 0 AND n_nationkey = s_suppkey % 30"),
    "flt_spans_contained": (spans_contained, "SELECT page_id, contains(html, '<h1>') AND contains(html, 'p' || page_id) AS all_spans, len(list_filter(string_split(html, chr(10)), lambda x: contains(x, '<h1>') AND contains(x, '</body>'))) > 0 AS one_line FROM pages"),
    "fn_masked_connections": (masked_connections, "SELECT s_suppkey, 'host' || s_nationkey || '/x' AS host FROM supplier"),
    "fn_layered_property": (layered_property, "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'run' WHEN s_suppkey % 3 = 0 THEN 'style' ELSE 'document' END AS value FROM supplier"),
    "fn_unverified_answers": (unverified_answers, "SELECT n_nationkey, 'Not verified.' || chr(10) || chr(10) || 'answer ' || n_name || CASE WHEN n_regionkey > 1 THEN chr(10) || chr(10) || 'Sources: ' || n_name || ', b' ELSE '' END AS answer FROM nation"),
    "fn_vector_text": (vector_text, "SELECT vec_id, '[' || format('{:.8f}', CAST(embedding[1] AS DOUBLE)) || ',' || format('{:.8f}', CAST(embedding[2] AS DOUBLE)) || ']' AS written FROM embeddings"),
    "fn_version_stamps": (version_stamps, "SELECT doc_id, sha256(text) AS source_hash, 'plain-1' AS parser_version, 'none' AS clean_rules_version, 'fold-2' AS chunker_version, 'hash:64' AS embedding_model FROM documents"),
    "fn_thinking_marks": (thinking_marks, "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'empty' WHEN 1 THEN 'leaked' ELSE 'clean' END AS mark, count(*) AS n FROM orders GROUP BY 1"),
    "fn_warnings_once": (warnings_once, "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'w1' || CASE WHEN n_regionkey <> 1 THEN ',w' || n_regionkey ELSE '' END ELSE 'w' || n_regionkey || CASE WHEN n_regionkey <> 1 THEN ',w1' ELSE '' END END AS warnings FROM nation"),
    "flt_display_names": (display_names, f"WITH {_DOCS} SELECT id, coalesce(original_name, filename) AS name FROM docs"),
    "fn_event_times": (event_times, "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, ts <= now() AS past FROM events"),
    "agg_heading_candidates": (heading_counts, "WITH p AS (SELECT p_brand AS file, p_name AS text, p_partkey % 3 = 0 AS bold, CAST(p_size AS DOUBLE) AS size FROM part), m AS (SELECT file, median(size) AS middle FROM p WHERE NOT bold GROUP BY 1) SELECT file, count(*) FILTER (WHERE bold) AS bold, count(*) FILTER (WHERE bold AND length(text) <= 40) AS bold_short, count(*) FILTER (WHERE bold AND trim(text) <> '' AND length(trim(text)) <= 40 AND NOT contains('。！？；;.!?，,：:', right(trim(text), 1))) AS bold_title, count(*) FILTER (WHERE size > middle) AS larger, count(*) FILTER (WHERE size > middle AND length(text) <= 40) AS larger_short FROM p JOIN m USING (file) GROUP BY 1"),
    "agg_table_lengths": (table_length_report, "SELECT coalesce(lang, 'total') AS source_file, count(*) AS tables, CAST(quantile_disc(length(text), 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(length(text), 0.9) AS DOUBLE) AS p90, max(length(text)) AS longest, count(*) FILTER (WHERE length(text) > 1024) AS long FROM documents WHERE doc_id % 2 = 0 GROUP BY ROLLUP (lang)"),
    "win_rank_by_anchor": (rank_by_anchor, f"WITH {_PLACED} SELECT question_id, min(CASE WHEN source_file = 'purchase' THEN rank END) AS rank, min(CASE WHEN source_file = 'purchase' AND contains(content, 'anchor 1') THEN rank END) AS anchored FROM placed GROUP BY 1"),
    "agg_numeric_rates": (numeric_rates, f"WITH {_PLACED}, h AS (SELECT CASE WHEN question_id % 4 <> 0 THEN question_id % 6 + 1 END AS r, event_id FROM placed WHERE rank = 1) SELECT count(*) AS n, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0 END), 6) AS recall_3, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN event_id % 3 = 1 THEN 1.0 ELSE 0 END) FILTER (WHERE r IS NOT NULL), 6) AS same_chunk, 0.0::DOUBLE AS same_line, round(avg(CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0 END) FILTER (WHERE r IS NOT NULL), 6) AS broken FROM h"),
    "agg_group_means": (slow_and_fast_means, "SELECT CASE WHEN value > 50 THEN 'slow' ELSE 'fast' END AS grp, count(*) AS n, round(avg(value), 6) AS mean_ms, round(avg(length(props)), 6) AS mean_length, count(*) FILTER (WHERE value > 90) AS over FROM events GROUP BY 1"),
    "agg_verdict_scopes": (verdict_scopes, f"WITH {_PLACED}, h AS (SELECT * FROM placed WHERE rank <= 5) SELECT question_id, 'none' AS scope, false AS gate FROM h GROUP BY 1 UNION ALL SELECT question_id, 'some', count(DISTINCT CASE WHEN source_file IN ('click', 'view') THEN source_file END) >= 2 FROM h GROUP BY 1 UNION ALL SELECT question_id, 'full', count(DISTINCT source_file) >= 2 FROM h GROUP BY 1"),
    "agg_deciles": (value_deciles, "SELECT event_type, v[len(v) // 10 + 1] AS p10, v[len(v) // 2 + 1] AS p50, v[least(len(v) - 1, CAST(floor(len(v) * 0.9) AS BIGINT)) + 1] AS p90 FROM (SELECT event_type, list(value ORDER BY value) AS v FROM events GROUP BY 1)"),
    "srt_first_sources": (first_sources, f"WITH {_PLACED} SELECT question_id AS query_id, array_to_string(list_slice(list_sort(list(DISTINCT source_file)), 1, 3), ',') AS sources FROM placed GROUP BY 1"),
    "srt_most_changed": (most_changed_words, f"WITH w AS (SELECT word, sum(n) AS n FROM (SELECT unnest({_WORDS}) AS word, -1 AS n FROM benchmark UNION ALL SELECT unnest({_WORDS}), 1 FROM conversations) WHERE word <> '' GROUP BY 1) SELECT * FROM (SELECT word, 'added' AS side, CAST(n AS BIGINT) AS n FROM w WHERE n > 0 ORDER BY n DESC, word LIMIT 6) UNION ALL SELECT * FROM (SELECT word, 'removed' AS side, CAST(-n AS BIGINT) AS n FROM w WHERE n < 0 ORDER BY n DESC, word LIMIT 6)"),
    "set_labelled_union": (labelled_parts, "SELECT 'good' AS category, count(*) AS n FROM labels WHERE quality = 1 UNION ALL SELECT 'toxic', count(*) FROM labels WHERE toxic = 1"),
    "set_same_blocks": (block_sequences, "SELECT doc_id AS document_id, doc_id % 3 <> 0 OR max(length(line)) <= 3 AS same FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY doc_id"),
    "flt_chunk_projection": (chunk_projection, "SELECT CAST(doc_id AS VARCHAR) AS id, lang AS department, CAST(substr(source, 4) AS INTEGER) % 4 AS secret_level, source AS source_file, CAST(doc_id AS DOUBLE) AS score, true AS no_page FROM documents"),
    "flt_source_projection": (shown_sources, "SELECT doc_id AS query_id, CAST(1 AS INTEGER) AS rank, source AS source_file, CAST(doc_id % 4 AS INTEGER) AS page, CAST(NULL AS VARCHAR) AS raw_table, round(round_even(doc_id / 7, 4), 3) AS score FROM documents"),
    "str_ingest": (ingested_files, "SELECT '/in/region' || n_regionkey || '.csv' AS document_id, CAST(1 AS BIGINT) AS chunks, CAST(16 AS INTEGER) AS dimension, sha256('key,name' || chr(10) || string_agg(n_nationkey || ',' || n_name, chr(10) ORDER BY n_nationkey)) AS source_hash, 'hash:16' AS embedding_model FROM nation GROUP BY n_regionkey"),
    "udf_embed": (embedded_texts, "SELECT item_id, CAST(32 AS INTEGER) AS dimension, 1.0::DOUBLE AS length FROM benchmark"),
    "udf_model_rerank": (model_reranked, f"WITH {_CANDIDATES} SELECT query_id, chunk_id, rank AS candidate_rank, CAST(CASE WHEN len(string_split('Question: ' || question, ' ')) % 2 = 1 THEN p ELSE n + 1 - p END AS INTEGER) AS rank FROM cand"),
    "udf_pair_rerank": (pair_reranked, f"WITH {_CANDIDATES} SELECT query_id, chunk_id, rank AS candidate_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY length(content) DESC, rank) AS INTEGER) AS rank, CAST(length(content) AS DOUBLE) AS rerank_score FROM cand"),
    "udf_expanded_questions": (expanded_questions, "SELECT n_nationkey AS query_id, CAST(0 AS INTEGER) AS variant_no, n_name AS question FROM nation UNION ALL SELECT n_nationkey, 1, n_name || ' again' FROM nation WHERE NOT starts_with(n_name, 'A')"),
    "udf_clarification": (clarified, "SELECT n_nationkey AS query_id, n_nationkey % 3 >= 2 AND length(n_name) % 2 = 1 AS ambiguous, false AS unknown, CASE WHEN n_nationkey % 3 >= 2 AND length(n_name) % 2 = 1 THEN 'Which one do you mean?' || chr(10) || '1. ' || n_name || ' one' || chr(10) || '2. ' || n_name || ' two' END AS question FROM nation"),
    "udf_answers": (generated_answers, "SELECT n_nationkey AS query_id, 'It is ' || lower(list_last(string_split(n_name, ' '))) || ' [2].' AS answer, '2' AS cited FROM nation"),
    "str_job_arguments": (job_arguments, "SELECT s_suppkey AS job_id, CASE s_suppkey % 3 WHEN 1 THEN 'missing kb' WHEN 2 THEN 'unknown extra' END AS rejected FROM supplier"),
    "str_job_states": (job_outcomes, "WITH a AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_type = 'purchase' AND value * 20 <= 1800 AS ok, CASE WHEN value * 20 > 1800 THEN 'timeout' ELSE event_type END AS error FROM events), j AS (SELECT job_id, min(CASE WHEN ok THEN k END) AS done, max(k) AS last, arg_max(error, k) AS error FROM a WHERE k <= 3 GROUP BY 1) SELECT job_id, CASE WHEN done IS NOT NULL THEN 'completed' WHEN last >= 3 THEN 'failed' ELSE 'retry' END AS state, CAST(coalesce(done, last) AS INTEGER) AS attempts, CASE WHEN done IS NULL THEN error END AS error FROM j"),
    "str_cache_entries": (cache_entries, "WITH o AS (SELECT o_orderkey, o_orderstatus AS kb, o_orderdate AS stored, o_orderdate + to_minutes(CAST(o_orderkey % 90 AS INTEGER)) AS asked FROM orders), c AS (SELECT kb, min(stored) AS changed FROM o GROUP BY 1) SELECT kb, count(*) AS fresh FROM o JOIN c USING (kb) WHERE o_orderkey % 90 < 60 AND NOT (changed >= stored AND changed <= asked) GROUP BY 1"),
}

QUERIES = {name: query for name, (query, _) in PAIRS.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in PAIRS.items()}
