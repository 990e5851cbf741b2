"""Office files (zipped XML) as text segments, and back with rewritten text.

A part of a file is read into a small tree that knows at which bytes each run
of characters stands.  Writing replaces those bytes alone, so that whatever
else a file holds (prefixes, extensions, styles) stays as it was.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main "
_S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main "
_A = "http://schemas.openxmlformats.org/drawingml/2006/main "
_T = "urn:oasis:names:tc:opendocument:xmlns:text:1.0 "
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships "
#: Errors of files that are not what their extension says.
UNREADABLE = (zipfile.BadZipFile, expat.ExpatError, KeyError, IndexError, ValueError)


@dataclass
class Run:
    """Characters between two tags, and the bytes they take."""

    part: str
    start: int
    end: int
    text: str
    keeps_blanks: bool


@dataclass
class Element:
    tag: str
    attributes: dict[str, str]
    within: list = field(default_factory=list)

    def every(self, *tags: str) -> Iterator[Element]:
        """Elements of these tags below this one, in document order."""
        for x in self.within:
            if isinstance(x, Element):
                if x.tag in tags:
                    yield x
                yield from x.every(*tags)

    def children(self, tag: str) -> list[Element]:
        return [x for x in self.within if isinstance(x, Element) and x.tag == tag]

    def runs(self) -> list[Run]:
        return [r for x in self.within for r in ([x] if isinstance(x, Run) else x.runs())]


def parse(raw: bytes, part: str) -> Element:
    """The root of an XML part, names as ``namespace name``."""
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = False
    top = Element("", {})
    stack, text = [top], []

    def close() -> None:
        if text:
            held = "".join(t for _, t in text)
            stack[-1].within.append(Run(part, text[0][0], parser.CurrentByteIndex, held, stack[-1].attributes.get("http://www.w3.org/XML/1998/namespace space") == "preserve"))
            text.clear()

    def start(tag: str, attributes: dict[str, str]) -> None:
        close()
        element = Element(tag, attributes)
        stack[-1].within.append(element)
        stack.append(element)

    def end(_: str) -> None:
        close()
        stack.pop()

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda t: text.append((parser.CurrentByteIndex, t))
    parser.CommentHandler = parser.ProcessingInstructionHandler = lambda *_: close()
    parser.StartCdataSectionHandler = parser.EndCdataSectionHandler = close
    parser.Parse(raw, True)
    return top.within[0]


def _of(elements: Iterator[Element]) -> list[Run]:
    return [r for x in elements for r in x.runs()]


def docx(z: zipfile.ZipFile) -> Iterator[tuple[str, list[Run]]]:
    """Paragraphs of the body, of tables within tables, and of headers and footers."""
    for name in sorted(n for n in z.namelist() if n == "word/document.xml" or n.startswith(("word/header", "word/footer"))):
        root = parse(z.read(name), name)
        top = root.children(_W + "body")[0] if name == "word/document.xml" else root
        yield from _blocks(top, name[5:-4].replace("document", "body"))


def _blocks(parent: Element, path: str) -> Iterator[tuple[str, list[Run]]]:
    for p, paragraph in enumerate(parent.children(_W + "p")):
        yield f"{path}.p{p}", _of(paragraph.every(_W + "t"))
    for t, table in enumerate(parent.children(_W + "tbl")):
        for r, row in enumerate(table.children(_W + "tr")):
            for c, cell in enumerate(row.children(_W + "tc")):
                yield from _blocks(cell, f"{path}.t{t}.r{r}c{c}")


def xlsx(z: zipfile.ZipFile) -> Iterator[tuple[str, list[Run]]]:
    """String cells as ``Sheet!A1``; formulas are left out.  Cells that share a string share its runs."""
    names = set(z.namelist())
    shared = [_of(si.every(_S + "t")) for si in parse(z.read("xl/sharedStrings.xml"), "xl/sharedStrings.xml").children(_S + "si")] if "xl/sharedStrings.xml" in names else []
    links = {}
    if "xl/_rels/workbook.xml.rels" in names:
        for x in parse(z.read("xl/_rels/workbook.xml.rels"), "").within:
            if isinstance(x, Element):
                links[x.attributes["Id"]] = posixpath.normpath(posixpath.join("/xl", x.attributes["Target"]))[1:]
    for k, sheet in enumerate(parse(z.read("xl/workbook.xml"), "").every(_S + "sheet")):
        part = links.get(sheet.attributes.get(_R + "id", ""), f"xl/worksheets/sheet{k + 1}.xml")
        if part not in names:
            continue
        for c in parse(z.read(part), part).every(_S + "c"):
            if c.children(_S + "f"):
                continue
            if c.attributes.get("t") == "s":
                runs = shared[int("".join(r.text for v in c.children(_S + "v") for r in v.runs()) or 0)]
            elif c.attributes.get("t") == "inlineStr":
                runs = _of(c.every(_S + "t"))
            else:
                continue
            yield f"{sheet.attributes.get('name', '')}!{c.attributes.get('r')}", runs


def _numbered(name: str) -> tuple[str, int]:
    found = re.fullmatch(r"(.*?)(\d*)\.xml", name)
    return found[1], int(found[2] or 0)


def pptx(z: zipfile.ZipFile) -> Iterator[tuple[str, list[Run]]]:
    """Paragraphs of slides and notes by number, tables and groups included."""
    for name in sorted((n for n in z.namelist() if re.match(r"ppt/(slides/slide|notesSlides/notesSlide)\d*\.xml$", n)), key=_numbered):
        for k, p in enumerate(parse(z.read(name), name).every(_A + "p")):
            yield f"{name.rsplit('/', 1)[1][:-4]}.p{k}", _of(p.every(_A + "t"))


def odt(z: zipfile.ZipFile) -> Iterator[tuple[str, list[Run]]]:
    """Paragraphs and headings as ``body#N``."""
    for k, x in enumerate(parse(z.read("content.xml"), "content.xml").every(_T + "p", _T + "h")):
        yield f"body#{k}", x.runs()


READERS = {"docx": docx, "xlsx": xlsx, "pptx": pptx, "odt": odt}


def read(adapter: str, content: bytes) -> list[tuple[str, str]]:
    """(seg_id, text) of a file's segments that hold text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        said = [(seg_id, "".join(r.text for r in runs)) for seg_id, runs in READERS[adapter](z)]
    return [(seg_id, text) for seg_id, text in said if text]


def write(adapter: str, content: bytes, texts: dict[str, str]) -> bytes:
    """The file with these segments' texts; all other bytes of its parts stay.

    Runs of a paragraph keep their lengths, the last one takes the rest.
    """
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        edits: dict[str, dict[tuple[int, int], Run]] = {}
        for seg_id, runs in READERS[adapter](z):
            if seg_id in texts and runs and texts[seg_id] != "".join(r.text for r in runs):
                for run, text in zip(runs, spread_over_runs(texts[seg_id], [len(r.text) for r in runs]), strict=True):
                    edits.setdefault(run.part, {})[run.start, run.end] = Run(run.part, run.start, run.end, text, run.keeps_blanks or adapter not in ("docx", "xlsx"))
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as made:
            for info in z.infolist():
                raw = z.read(info)
                for (start, end), run in sorted(edits.get(info.filename, {}).items(), reverse=True):
                    head = raw[:start]
                    if not run.keeps_blanks and run.text != run.text.strip() and head.endswith(b">"):
                        head = head[:-1] + b' xml:space="preserve">'
                    raw = head + escape(run.text).encode() + raw[end:]
                made.writestr(info, raw)
    return out.getvalue()


def segments(files: DataFrame) -> DataFrame:
    """segments(file_rel, seg_ord, seg_id, text, error) of office files; what cannot be read gives a row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for rel, adapter, content in zip(*(b.column(c).to_pylist() for c in ("file_rel", "adapter", "content")), strict=True):
                try:
                    rows += [(rel, k, s, t, None) for k, (s, t) in enumerate(read(adapter, content))]
                except UNREADABLE as e:
                    rows.append((rel, 0, "", None, f"{type(e).__name__}: {e}"))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(("file_rel", "seg_ord", "seg_id", "text", "error"), cols, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)})

    return files.where(files.adapter.isin(*READERS)).select("file_rel", "adapter", "content").mapInArrow(run, "file_rel string, seg_ord int, seg_id string, text string, error string")


def rewritten(files: DataFrame, segments: DataFrame) -> DataFrame:
    """(file_rel, content, changed): files with the texts of ``segments`` (file_rel, seg_id, text) put back.

    Text files take their one segment; files without segments, and those that
    cannot be read, stay as they are.  A file's segments meet in one row, as
    its content does.
    """
    texts = segments.where("text is not null").groupBy("file_rel").agg(F.map_from_entries(F.collect_list(F.struct("seg_id", "text"))).alias("texts"))
    both = files.select("file_rel", "adapter", "content").join(texts, "file_rel", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for adapter, content, texts in zip(*(b.column(c).to_pylist() for c in ("adapter", "content", "texts")), strict=True):
                new = content
                if texts and adapter == "text":
                    new = dict(texts)["0"].encode()
                elif texts and adapter in READERS:
                    try:
                        new = write(adapter, content, dict(texts))
                    except UNREADABLE:
                        new = content
                made.append(new)
            changed = [x != y for x, y in zip(made, b.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"file_rel": b.column("file_rel"), "content": pa.array(made, pa.binary()), "changed": pa.array(changed, pa.bool_())})

    return both.mapInArrow(run, "file_rel string, content binary, changed boolean")


def spread_over_runs(text: str, lengths: list[int]) -> list[str]:
    """A rewritten paragraph laid over its old runs: each takes its old length, the last one the rest."""
    out, at = [], 0
    for n in lengths[:-1]:
        out.append(text[at : at + n])
        at += n
    return [*out, text[at:]] if lengths else []
