import io
import zipfile

import pytest
from pyspark.sql import functions as F

from vellum.sources.parsers import PARSERS, blocks_of, decoded, failure_counts, failure_report, parse_csv, parse_files, parse_pages, parse_plain, register, texts_of
from vellum.sources.routing import corpus, describe, route, scoped
from vellum.sources.store import Table, admitted, reloaded, status_of
from vellum.streaming.ingest import audit_windows, first_in_ttl, ingest, stream_files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml").replace("DOT", "."), text)
    return out.getvalue()


def p(text, style="", bold=False):
    return f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r>{"<w:rPr><w:b/></w:rPr>" if bold else ""}<w:t>{text}</w:t></w:r></w:p>'


def cell(text, more=""):
    return f"<w:tc>{more}{p(text)}</w:tc>"


DOCX = archive(
    word__styles_xml=f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>',
    word__document_xml=f'<w:document {W}><w:body>{p("Title", "H1")}{p("Bold line", bold=True)}{p("Plain.")}<w:tbl><w:tr>{cell("k")}{cell("v")}</w:tr><w:tr>{cell("1")}{cell("2", "<w:tcPr><w:vMerge/></w:tcPr>")}</w:tr></w:tbl>{p("")}{p("End.")}</w:body></w:document>',
)
ROWS = "".join(f'<row><c r="A{i}" t="s"><v>0</v></c><c r="C{i}"><v>{i}</v></c></row>' for i in range(1, 64))
XLSX = archive(
    xl__workbook_xml=f'<workbook {S} xmlns:r="{R}"><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>',
    xl___rels__workbookDOTxmlDOTrels='<Relationships><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="/xl/worksheets/b.xml"/></Relationships>',
    xl__sharedStrings_xml=f"<sst {S}><si><t>he</t><t>ad</t></si></sst>",
    xl__worksheets__a_xml=f"<worksheet {S}><sheetData>{ROWS}</sheetData></worksheet>",
    xl__worksheets__b_xml=f"<worksheet {S}><sheetData/></worksheet>",
)
PPTX = archive(
    ppt__slides__slide2_xml=f"<s {A}><a:p><a:r><a:t>second</a:t></a:r></a:p></s>",
    ppt__slides__slide1_xml=f"<s {A}><a:p><a:r><a:t>first</a:t></a:r></a:p><a:tbl><a:tr><a:tc><a:p><a:r><a:t>h</a:t></a:r></a:p></a:tc></a:tr><a:tr><a:tc><a:p><a:r><a:t>1</a:t></a:r></a:p></a:tc></a:tr></a:tbl></s>",
)
FILES = {
    "/d/a.docx": DOCX, "/d/b.xlsx": XLSX, "/d/c.pptx": PPTX, "/d/lie.txt": DOCX, "/d/e.md": b"# Head\n\npara\nmore\n\n```\ncode\n", "/d/f.csv": "﻿x, y\n,\n1,2\n".encode(), "/d/g.pdf": b"%PDF-1.4", "/d/h.html": b"<html>",
    "/d/i.py": b"x = 1\n", "/d/noext": b"words", "/d/j.zip": archive(a_xml="x"), "/d/k.txt": b"<!DOCTYPE html><p>", "/d/l.xls": b"\xd0\xcf\x11\xe0rest", "/d/m.txt": b"", "/d/dept1.md": b"v", "/d/n.txt": "汉字".encode("gb18030"),
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in FILES.items()], "path string, content binary")


@pytest.fixture(scope="module")
def parsed(files):
    return parse_files(route(files)).cache()


def test_routes(files):
    got = {r["path"][3:]: r for r in route(files).collect()}
    kinds = {k: r["kind"] for k, r in got.items()}
    assert kinds == {
        "a.docx": "docx", "b.xlsx": "xlsx", "c.pptx": "pptx", "lie.txt": "docx", "e.md": "markdown", "f.csv": "csv", "g.pdf": "pdf", "h.html": None, "i.py": "code", "noext": "text", "j.zip": None, "k.txt": None, "l.xls": None,
        "m.txt": "text", "dept1.md": "markdown", "n.txt": "text",
    }
    assert got["lie.txt"]["conflict"] == "named text, is docx" and got["noext"]["confidence"] == "low" and got["a.docx"]["confidence"] == "high"
    assert all(got[k]["refused"] for k, v in kinds.items() if v is None)
    assert describe(route(files)).where("path = '/d/h.html'").first()["summary"].startswith("refused")
    assert corpus(files, keep_variants=False).where("path LIKE '%dept%'").count() == 0


def test_parsing_loses_no_file(parsed):
    got = {r["path"][3:]: r["parsed"] for r in parsed.collect()}
    assert len(got) == len(FILES)
    assert {k for k, v in got.items() if not v["ok"]} == {"g.pdf", "h.html", "j.zip", "k.txt", "l.xls", "m.txt"}
    assert [(b["kind"], b["text"]) for b in got["a.docx"]["blocks"]] == [("heading", "Title"), ("heading", "Bold line"), ("paragraph", "Plain."), ("table", "k=1, v=2"), ("paragraph", "End.")]
    assert got["a.docx"]["blocks"][3]["table_complex"] is True and got["a.docx"]["blocks"][3]["page"] is None
    sheet = got["b.xlsx"]["blocks"]
    assert [b["text"].split("\n")[0] for b in sheet] == ["One rows 1-60", "One rows 61-62"] and sheet[0]["raw_table"].startswith("| head |  | 1 |")
    assert got["b.xlsx"]["warnings"] == ["sheet Two is empty"]
    assert [(b["kind"], b["page"]) for b in got["c.pptx"]["blocks"]] == [("table", 1), ("paragraph", 1), ("paragraph", 2)]
    assert [b["kind"] for b in got["e.md"]["blocks"]] == ["heading", "paragraph", "code"] and got["e.md"]["warnings"]
    assert got["f.csv"]["blocks"][0]["text"] == "f\nx=1, y=2"
    assert got["n.txt"]["blocks"][0]["text"] == "汉字"
    assert "no such parser" in failure_report(parsed).where("path = '/d/g.pdf'").first()["report"]
    assert failure_counts(parsed).agg(F.sum("n")).first()[0] == 6
    assert blocks_of(parsed).where("document_id = '/d/e.md'").count() == 3
    assert texts_of(parsed).where("path = '/d/e.md'").first()["text"] == "Head\npara\nmore\n```\ncode"


def test_a_registered_parser_is_used(files):
    register("pdf", lambda data, *_: parse_pages(["page one", " "]))
    try:
        row = parse_files(route(files.where("path LIKE '%.pdf'"))).first()["parsed"]
    finally:
        PARSERS.pop("pdf")
    assert row["ok"] and row["pages"] == 2 and row["warnings"] == ["page 2 has no text"]


def test_encodings_and_empty_files():
    assert decoded(b"\xff\xfea\x00") == "a"
    with pytest.raises(ValueError):
        decoded(b"\xff\xff\xff")
    assert parse_plain(b" \n").blocks == [] and parse_csv(b",\n").blocks == []


def test_store_replaces_documents_and_keeps_others(spark, tmp_path):
    schema = "document_id string, chunk_index int, content string"
    rows = lambda *r: spark.createDataFrame(r, schema)
    table = Table(spark, str(tmp_path), "real", "chunks", "document_id", schema, buckets=4)
    assert table.count() == 0
    table.upsert(rows(("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")))
    before = table.read()
    table.upsert(rows(("a", 0, "new")))
    content = lambda: sorted((r["document_id"], r["content"]) for r in table.read().collect())
    assert content() == [("a", "new"), ("b", "z")]
    assert before.count() == 3, "a reader of the earlier version isn't disturbed"
    table.replace(spark.createDataFrame([("b",)], "document_id string"), rows(("c", 0, "w")))
    assert content() == [("a", "new"), ("c", "w")]
    table.delete(spark.createDataFrame([("a",), ("nope",)], "document_id string"))
    assert content() == [("c", "w")]
    table.truncate()
    assert content() == []
    with pytest.raises(ValueError, match="unknown store"):
        Table(spark, str(tmp_path), "other", "chunks", "document_id", schema)


def test_states_of_documents(spark):
    events = spark.createDataFrame([("d", 1, "pending", None), ("d", 3, "failed", "x"), ("d", 2, "processing", None), ("e", 1, "pending", None), ("e", 1, "completed", None)], "document_id string, at int, status string, error string")
    assert {tuple(r) for r in status_of(events).collect()} == {("d", "failed", "x"), ("e", "completed", None)}
    uploads = spark.createDataFrame([("a/b.md", 5, 1, 1), ("c.exe", 5, 1, 1), ("d.md", 5, 3, 1), ("e.md", 1 << 30, 0, 1)], "name string, size long, secret_level int, clearance int")
    assert [(r["original_name"], r["rejected"]) for r in admitted(uploads, ["md"]).orderBy("name").collect()] == [("b.md", None), ("c.exe", "extension"), ("d.md", "clearance"), ("e.md", "size")]
    docs = spark.createDataFrame([("a", 1, "failed", "x", False), ("b", 4, "completed", None, True)], "id string, version int, status string, error string, is_deleted boolean")
    assert {tuple(r)[:4] for r in reloaded(docs, docs.select("id")).collect()} == {("a", 2, "pending", None), ("b", 4, "completed", None)}
    manifest = spark.createDataFrame([("a.md", "hr")], "file string, department string")
    assert {r["path"]: r["department"] for r in scoped(spark.createDataFrame([("/x/a.md",), ("/x/b.md",)], "path string"), manifest).collect()} == {"/x/a.md": "hr", "/x/b.md": "company"}


def test_stream_of_files_is_idempotent(spark, tmp_path):
    folder, schema = tmp_path / "in", "document_id string, chunk_index int, kind string, content string, start_offset int, end_offset int, title string, page int, raw_table string, table_complex boolean, content_hash string"
    folder.mkdir()
    (folder / "a.md").write_text("# T\n\nbody\n")
    (folder / "b.pdf").write_bytes(b"%PDF")
    table, failed = Table(spark, str(tmp_path / "store"), "real", "chunks", "document_id", schema, buckets=2), []
    for run in range(2):
        stream_files(spark, str(folder), table, str(tmp_path / f"ck{run}"), lambda df, _: failed.extend(r["path"] for r in df.collect())).awaitTermination()
    assert [r["content"] for r in table.read().collect()] == ["T\nbody"]
    assert len(failed) == 2 and all(p.endswith("b.pdf") for p in failed)


def test_ingest_chunks_and_reports(files):
    chunks, reports = ingest(files)
    assert {r[0] for r in chunks.select("document_id").distinct().collect()} == {f"/d/{k}" for k in ("a.docx", "b.xlsx", "c.pptx", "lie.txt", "e.md", "f.csv", "i.py", "noext", "dept1.md", "n.txt")}
    assert reports.count() == 6


def test_audit_windows_and_cache_on_a_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", F.col("event_type").alias("event"), F.col("value").alias("ms"), F.col("user_id").alias("key"))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    wanted = sorted(map(tuple, audit_windows(events, slow_ms=50.0).collect()))
    query = audit_windows(stream, slow_ms=50.0).writeStream.format("memory").queryName("w").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("w").collect())) == wanted
    query = first_in_ttl(stream, "100000 days").writeStream.format("memory").queryName("c").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("c").count() == events.select("key").distinct().count()
