"""Parsers from bytes to blocks, a registry of them, and the attempt to parse files by their chains.

Office files are read with the standard library: they are archives of XML. A PDF reader isn't
at hand here; ``register`` takes one, and without it a PDF fails, with a row that says so.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import PARSED

ROWS_PER_BLOCK = 60
FENCE = "```"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


@dataclass
class Parsed:
    blocks: list[dict] = field(default_factory=list)
    pages: int | None = None
    warnings: list[str] = field(default_factory=list)

    def add(self, kind: str, text: str, page: int | None = None, **more) -> None:
        self.blocks.append({"kind": kind, "text": text, "page": page, "raw_table": None, "table_complex": False, "meta": {}} | more)

    def add_table(self, rows: list[list[str]], caption: str | None, page: int | None = None, hint: bool = False, **meta: str) -> None:
        """A table as words and as a pipe table; ``hint`` says that its cells were merged."""
        header, width = rows[0], max(map(len, rows))
        names = [h if h.strip() else f"column {i}" for i, h in enumerate(header, 1)]
        told = "；".join(", ".join(f"{names[i] if i < len(names) else f'column {i + 1}'}={c}" for i, c in enumerate(r)) for r in (rows[1:] or rows))
        drawn = ["| " + " | ".join(c.replace("|", "\\|") for c in [*r, *[""] * (width - len(r))]) + " |" for r in rows]
        drawn.insert(1, "| " + " | ".join(["---"] * width) + " |")
        uneven = len({len(r) for r in rows}) > 1 or any(not h.strip() for h in header)
        self.add("table", f"{caption}\n{told}" if caption else told, page, raw_table="\n".join(drawn), table_complex=hint or uneven, meta=meta)


def decoded(data: bytes) -> str:
    """UTF-8, with or without a mark, or UTF-16 with one, else GB 18030 or Latin-1, whichever reads more like text; never with characters dropped.

    Bytes that are GB 18030 pair up, and stand for Chinese characters of common use almost always. Latin-1 text has single
    letters with accents between ASCII ones, which as pairs would make rare characters with ASCII letters swallowed.
    """
    for encoding in ("utf-16",) if data[:2] in (b"\xff\xfe", b"\xfe\xff") else ("utf-8-sig",):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    try:
        chinese = data.decode("gb18030")
    except UnicodeDecodeError:
        chinese = None
    high = sum(b >= 0x80 for b in data)
    # in two-byte characters of common use both bytes are high
    paired = sum(len(run) // 2 * 2 for run in re.findall(rb"[\x80-\xff]{2,}", data))
    if chinese is not None and paired >= 0.7 * high:
        return chinese
    if 2 * high < len(data) and not re.search(rb"[\x00-\x08\x0e-\x1f\x7f-\x9f]", data):
        return data.decode("latin-1")
    raise ValueError("the encoding can't be told")


def parse_plain(data: bytes, kind: str = "text") -> Parsed:
    """Paragraphs between blank lines; headings and fenced code in Markdown only; code as one block."""
    out, text = Parsed(), decoded(data)
    if kind == "code":
        if text.strip():
            out.add("code", text)
        return out
    waiting: list[str] = []
    fenced: list[str] | None = None

    def flush() -> None:
        if any(line.strip() for line in waiting):
            out.add("paragraph", "\n".join(waiting).strip())
        waiting.clear()

    for line in text.splitlines():
        mark = kind == "markdown" and line.strip().startswith(FENCE)
        if fenced is not None:
            fenced.append(line)
            if mark:
                out.add("code", "\n".join(fenced))
                fenced = None
        elif mark:
            flush()
            fenced = [line]
        elif kind == "markdown" and (found := re.match(r"#{1,6}\s+(.*\S)", line)):
            flush()
            out.add("heading", found[1])
        elif line.strip():
            waiting.append(line)
        else:
            flush()
    flush()
    if fenced is not None:
        out.add("code", "\n".join(fenced))
        out.warnings.append("a code fence isn't closed")
    return out


def _grouped(out: Parsed, rows: list[list[str]], caption: str, first: int = 1, **meta: str) -> None:
    """Tables of at most ROWS_PER_BLOCK rows, each with the header and its range in the caption."""
    header, body = rows[0], rows[1:]
    if len(body) <= ROWS_PER_BLOCK:
        out.add_table(rows, caption, **meta)
        return
    for at in range(0, len(body), ROWS_PER_BLOCK):
        part = body[at : at + ROWS_PER_BLOCK]
        out.add_table([header, *part], f"{caption} rows {at + first}-{at + first + len(part) - 1}", **meta)


def parse_csv(data: bytes, name: str = "table") -> Parsed:
    out = Parsed()
    rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(decoded(data)))]
    if rows := [r for r in rows if any(r)]:
        _grouped(out, rows, name)
    return out


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None


def _said(element: ElementTree.Element, tag: str) -> str:
    return "".join(t.text or "" for t in element.iter(tag))


def _on(element: ElementTree.Element | None) -> bool:
    return element is not None and element.get(f"{_W}val", "true") not in ("0", "false", "off")


def heading_by_style_or_bold(paragraph: ElementTree.Element, styles: dict[str, str]) -> bool:
    """A heading style, or bold in every run that has text, said in the run itself."""
    style = paragraph.find(f"{_W}pPr/{_W}pStyle")
    name = styles.get(style.get(f"{_W}val", ""), "") if style is not None else ""
    if name.lower().startswith("heading") or name.startswith("标题"):
        return True
    runs = [r for r in paragraph.iter(f"{_W}r") if _said(r, f"{_W}t").strip()]
    return bool(runs) and all(_on(r.find(f"{_W}rPr/{_W}b")) for r in runs)


def parse_docx(data: bytes, is_heading: Callable[[ElementTree.Element, dict[str, str]], bool] = heading_by_style_or_bold) -> Parsed:
    """Paragraphs, headings and tables in the order of the body; there are no pages."""
    out, archive = Parsed(), zipfile.ZipFile(io.BytesIO(data))
    sheet = _xml(archive, "word/styles.xml")
    styles = {s.get(f"{_W}styleId", ""): (n.get(f"{_W}val", "") if (n := s.find(f"{_W}name")) is not None else "") for s in (sheet.iter(f"{_W}style") if sheet is not None else ())}
    body = _xml(archive, "word/document.xml").find(f"{_W}body")
    for element in body:
        if element.tag == f"{_W}p" and (text := _said(element, f"{_W}t").strip()):
            out.add("heading" if is_heading(element, styles) else "paragraph", text)
        elif element.tag == f"{_W}tbl":
            rows = [["\n".join(_said(p, f"{_W}t") for p in cell.iter(f"{_W}p")).strip() for cell in row.findall(f"{_W}tc")] for row in element.findall(f"{_W}tr")]
            merged = any(True for _ in element.iter(f"{_W}vMerge")) or any(True for _ in element.iter(f"{_W}gridSpan"))
            if any(any(r) for r in rows):
                out.add_table(rows, None, hint=merged)
    return out


def parse_xlsx(data: bytes) -> Parsed:
    """A table for each sheet, without empty rows; an empty sheet is a warning."""
    out, archive = Parsed(), zipfile.ZipFile(io.BytesIO(data))
    shared = _xml(archive, "xl/sharedStrings.xml")
    strings = [_said(s, f"{_S}t") for s in shared.findall(f"{_S}si")] if shared is not None else []
    relations = {r.get("Id"): r.get("Target", "") for r in _xml(archive, "xl/_rels/workbook.xml.rels")}

    def value(cell: ElementTree.Element) -> str:
        if cell.get("t") == "inlineStr":
            return _said(cell, f"{_S}t")
        v = cell.find(f"{_S}v")
        raw = "" if v is None else v.text or ""
        return strings[int(raw)] if cell.get("t") == "s" and raw else raw

    for sheet in _xml(archive, "xl/workbook.xml").iter(f"{_S}sheet"):
        name, rows = sheet.get("name", ""), []
        target = relations[sheet.get(f"{_R}id")].lstrip("/")
        for row in _xml(archive, target if target.startswith("xl/") else f"xl/{target}").iter(f"{_S}row"):
            cells: list[str] = []
            for cell in row.findall(f"{_S}c"):
                letters = re.match(r"[A-Z]*", cell.get("r", ""))[0]
                place = 0
                for letter in letters:
                    place = place * 26 + ord(letter) - 64
                cells += [""] * (place - 1 - len(cells))
                cells.append(value(cell).strip())
            if any(cells):
                rows.append(cells)
        if not rows:
            out.warnings.append(f"sheet {name} is empty")
            continue
        width = max(map(len, rows))
        _grouped(out, [r + [""] * (width - len(r)) for r in rows], name, sheet=name)
    return out


def parse_pptx(data: bytes) -> Parsed:
    """For each slide its tables, then its text as one paragraph; the slide is the page."""
    out, archive = Parsed(), zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    for page, (_, name) in enumerate(slides, 1):
        tree = _xml(archive, name)
        inside = set()
        for table in tree.iter(f"{_A}tbl"):
            inside |= {id(p) for p in table.iter(f"{_A}p")}
            rows = [["\n".join(_said(p, f"{_A}t") for p in cell.iter(f"{_A}p")).strip() for cell in row.findall(f"{_A}tc")] for row in table.findall(f"{_A}tr")]
            if any(any(r) for r in rows):
                out.add_table(rows, f"page {page}", page)
        said = [t for p in tree.iter(f"{_A}p") if id(p) not in inside and (t := _said(p, f"{_A}t").strip())]
        if said:
            out.add("paragraph", "\n".join(said), page)
    out.pages = len(slides)
    return out


def parse_pages(pages: list[str | None]) -> Parsed:
    """What a PDF reader gives, a text for each page: a paragraph each, and a warning for each page without."""
    out = Parsed(pages=len(pages))
    for page, text in enumerate(pages, 1):
        if (text or "").strip():
            out.add("paragraph", text.strip(), page)
        else:
            out.warnings.append(f"page {page} has no text")
    return out


#: Parsers by name: from (bytes, kind, file stem) to Parsed.
PARSERS: dict[str, Callable[[bytes, str, str], Parsed]] = {
    "plain": lambda data, kind, _: parse_plain(data, kind),
    "csv": lambda data, _, stem: parse_csv(data, stem),
    "docx": lambda data, *_: parse_docx(data),
    "xlsx": lambda data, *_: parse_xlsx(data),
    "pptx": lambda data, *_: parse_pptx(data),
}


def register(name: str, parser: Callable[[bytes, str, str], Parsed]) -> None:
    """Adds a parser, or replaces one; what is planned from then on uses it."""
    PARSERS[name] = parser


def parse_files(routed: DataFrame) -> DataFrame:
    """Routed files with ``parsed``: blocks of the first parser that finds any, or all attempts; no file is lost."""
    parsers = dict(PARSERS)

    @F.pandas_udf(PARSED)
    def attempt(chunks: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        def one(content: bytes, kind: str | None, chain: list[str] | None, path: str, refused: str | None) -> dict:
            attempts = [] if refused is None else [{"parser": "router", "error": refused}]
            for name in chain if chain is not None and refused is None else ():
                try:
                    if name not in parsers:
                        raise LookupError("no such parser is registered")
                    found = parsers[name](bytes(content or b""), kind or "text", re.sub(r".*/|\.[^.]*$", "", path))
                    if found.blocks:
                        blocks = [{"pos": i} | b for i, b in enumerate(found.blocks)]
                        return {"ok": True, "parser": name, "pages": found.pages, "warnings": found.warnings, "attempts": attempts, "blocks": blocks}
                    attempts.append({"parser": name, "error": "; ".join(found.warnings) or "no content"})
                except Exception as error:  # a parser's failure is a result here, whatever it is
                    attempts.append({"parser": name, "error": f"{type(error).__name__}: {error}"})
            return {"ok": False, "parser": None, "pages": None, "warnings": [], "attempts": attempts, "blocks": []}

        for columns in chunks:
            yield pd.DataFrame([one(*row) for row in zip(*columns, strict=True)], columns=["ok", "parser", "pages", "warnings", "attempts", "blocks"])

    return routed.withColumn("parsed", attempt("content", "kind", "chain", "path", "refused"))


def blocks_of(parsed: DataFrame, document_id: str = "path") -> DataFrame:
    """One row for each block of the files that could be parsed."""
    return parsed.where("parsed.ok").select(F.col(document_id).alias("document_id"), F.inline("parsed.blocks"))


def texts_of(parsed: DataFrame) -> DataFrame:
    """(path, text): the blocks' texts that aren't empty, joined by lines."""
    return parsed.select("path", F.array_join(F.transform(F.filter("parsed.blocks", lambda b: F.coalesce(b["text"], F.lit("")) != ""), lambda b: b["text"]), "\n").alias("text"))


def failure_report(parsed: DataFrame) -> DataFrame:
    """(path, report) of each file that couldn't be parsed."""
    tried = F.array_join(F.transform("parsed.attempts", lambda a: F.concat(F.lit("  "), a["parser"], F.lit(": "), a["error"])), "\n")
    return parsed.where("NOT parsed.ok").select("path", F.concat_ws("\n", F.concat(F.lit("failed: "), "path"), F.concat(F.lit("route: "), F.coalesce("kind", F.lit("refused"))), tried).alias("report"))


def failure_counts(parsed: DataFrame) -> DataFrame:
    """(signature, n): how often each kind of failure occurred, numbers in messages apart, the most common first."""
    last = F.element_at("parsed.attempts", -1)["error"]
    return parsed.where("NOT parsed.ok").groupBy(F.regexp_replace(last, r"\d+", "N").alias("signature")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "signature")
