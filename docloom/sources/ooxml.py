"""Word and Excel files as tables, read and written with the standard library only.

``read_word`` and ``read_excel`` take a ``binaryFile`` DataFrame (path, content) and give long tables; a file that can't be
read gives one row in the error table and nothing else.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.runtime import written

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_V = "{urn:schemas-microsoft-com:vml}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_PR = "{http://schemas.openxmlformats.org/package/2006/relationships}"
# Built-in number formats that show a date or time.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_BAD_XML = re.compile("[^\t\n\r\u0020-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")

WORD = {"doc", "docx"}
EXCEL = {"xlsx"}


def extension(path) -> F.Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def can_handle(path, kinds: set[str]) -> F.Column:
    return extension(path).isin(*sorted(kinds))


def document_kind(path) -> F.Column:
    """word, excel or unsupported, by the file's extension."""
    return F.when(can_handle(path, WORD), "word").when(can_handle(path, EXCEL), "excel").otherwise("unsupported")


def doc_id(path) -> F.Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, content, doc_id) of a folder's files; a missing folder, or one without a match, gives an empty table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "path string, content binary, doc_id string")
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", "content", doc_id("path").alias("doc_id"))


# Reading


def _run_text(node: ET.Element) -> str:
    out = []
    for x in node.iter():
        if x.tag == f"{_W}t":
            out.append(x.text or "")
        elif x.tag == f"{_W}tab":
            out.append("\t")
        elif x.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out)


def _images(node: ET.Element) -> list[str]:
    """Relations of the pictures in a node, drawings and older shapes, in document order."""
    out = []
    for x in node.iter():
        rel = x.get(f"{_R}embed") if x.tag == f"{_A}blip" else x.get(f"{_R}id") if x.tag == f"{_V}imagedata" else None
        if rel:
            out.append(rel)
    return out


def parse_docx(data: bytes) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(blocks, cells, image references) of a Word file: body children in order, numbered from 0.

    blocks (block_pos, kind, text, table_no); cells (table_no, r, c, text, grid_span, v_merge), the columns a span covers as
    blank cells; images (block_pos, r, c, ord, rel_id).
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    blocks, cells, images = [], [], []
    table_no = 0
    pos = -1
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            pos += 1
            blocks.append((pos, "paragraph", _run_text(node), None))
            images += [(pos, None, None, i, rel) for i, rel in enumerate(_images(node))]
        elif node.tag == f"{_W}tbl":
            pos += 1
            table_no += 1
            blocks.append((pos, "table", None, table_no))
            for r, tr in enumerate(node.findall(f"{_W}tr")):
                c = 0
                for tc in tr.findall(f"{_W}tc"):
                    pr = tc.find(f"{_W}tcPr")
                    span = pr.find(f"{_W}gridSpan") if pr is not None else None
                    merge = pr.find(f"{_W}vMerge") if pr is not None else None
                    wide = int(span.get(f"{_W}val", "1")) if span is not None else 1
                    kind = None if merge is None else merge.get(f"{_W}val", "continue")
                    cells.append((table_no, r, c, "\n".join(_run_text(p) for p in tc.findall(f"{_W}p")), wide, kind))
                    cells += [(table_no, r, c + k, None, 1, None) for k in range(1, wide)]
                    images += [(pos, r, c, i, rel) for i, rel in enumerate(_images(tc))]
                    c += wide
    return blocks, cells, images


def _place(ref: str) -> tuple[int, int]:
    m = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref)
    col = 0
    for ch in m[1]:
        col = col * 26 + ord(ch) - 64
    return int(m[2]), col


def _number(text: str, date: bool) -> str:
    value = float(text)
    if date:
        at = datetime(1899, 12, 30) + timedelta(days=value)
        return at.strftime("%Y-%m-%d" if value == int(value) else "%Y-%m-%d %H:%M:%S")
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def parse_xlsx(data: bytes) -> tuple[list[tuple], list[tuple]]:
    """(cells, merges) of a workbook: cells (sheet, r, c, text) from 0, merges (sheet, min_row, max_row, min_col, max_col) from 1.

    Shared, inline and formula strings, booleans, whole and other numbers, and numbers under a date format are text.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
        dates = []
        if "xl/styles.xml" in names:
            styles = ET.fromstring(z.read("xl/styles.xml"))
            own = {f.get("numFmtId"): bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "").lower()))) for f in styles.iter(f"{_S}numFmt")}
            xfs = styles.find(f"{_S}cellXfs")
            dates = [own.get(x.get("numFmtId"), int(x.get("numFmtId", "0")) in _DATE_FORMATS) for x in xfs] if xfs is not None else []
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).findall(f"{_PR}Relationship")}
        cells, merges = [], []
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            name, target = sheet.get("name"), rels[sheet.get(f"{_R}id")]
            root = ET.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
            for x in root.iter(f"{_S}c"):
                row, col = _place(x.get("r"))
                kind, v = x.get("t"), x.find(f"{_S}v")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in x.iter(f"{_S}t"))
                elif v is None or v.text is None:
                    continue
                elif kind == "s":
                    text = shared[int(v.text)]
                elif kind == "b":
                    text = "True" if v.text == "1" else "False"
                elif kind in ("str", "e", "d"):
                    text = v.text
                else:
                    style = int(x.get("s", "0"))
                    text = _number(v.text, style < len(dates) and dates[style])
                cells.append((name, row - 1, col - 1, text))
            for m in root.iter(f"{_S}mergeCell"):
                a, _, b = m.get("ref").partition(":")
                (r1, c1), (r2, c2) = _place(a), _place(b or a)
                merges.append((name, r1, r2, c1, c2))
    return cells, merges


_ROW = "doc_id string, part string, n1 int, n2 int, n3 int, n4 int, n5 int, s1 string, s2 string, s3 string"


#: First bytes of the older binary Word files.
_OLE = b"\xd0\xcf\x11\xe0"


def _parse_batches(kind: str, convert: Callable[[bytes], bytes] | None = None):
    def rows(doc: str, data: bytes) -> Iterator[tuple]:
        if kind == "word":
            if convert is not None and data[:4] == _OLE:
                data = convert(data)
            blocks, cells, images = parse_docx(data)
            yield from ((doc, "block", b[0], b[3], None, None, None, b[1], b[2], None) for b in blocks)
            yield from ((doc, "cell", c[0], c[1], c[2], c[4], None, None, c[3], c[5]) for c in cells)
            yield from ((doc, "image", i[0], i[1], i[2], i[3], None, i[4], None, None) for i in images)
        else:
            cells, merges = parse_xlsx(data)
            yield from ((doc, "cell", None, c[1], c[2], 1, None, c[0], c[3], None) for c in cells)
            yield from ((doc, "merge", m[1], m[2], m[3], m[4], None, m[0], None, None) for m in merges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), *[pa.int32()] * 5, *[pa.string()] * 3]
        names = [x.split()[0] for x in _ROW.split(", ")]
        for b in batches:
            for doc, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    got = list(rows(doc, data))
                except Exception as e:  # one bad file must not end the others
                    got = [(doc, "error", None, None, None, None, None, f"{type(e).__name__}: {e}"[:500], None, None)]
                cols = list(zip(*got)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)

    return run


class Parsed:
    """The tables of parsed files. Parsing is a pass over the files for each table that is used; ``once`` writes its rows first."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def once(self) -> Parsed:
        return Parsed(written(self.rows, "parsed"))

    def _part(self, part: str, **cols: str) -> DataFrame:
        return self.rows.where(F.col("part") == part).select("doc_id", *[F.col(v).alias(k) for k, v in cols.items()])

    def blocks(self) -> DataFrame:
        return self._part("block", block_pos="n1", kind="s1", text="s2", table_no="n2")

    def cells(self) -> DataFrame:
        x = self._part("cell", sheet="s1", table_no="n1", r="n2", c="n3", text="s2", grid_span="n4", v_merge="s3")
        return x.withColumn("table_id", F.concat(F.lit("table_"), F.coalesce("table_no", F.lit(1)))).drop("table_no")

    def images(self) -> DataFrame:
        return self._part("image", block_pos="n1", r="n2", c="n3", ord="n4", rel_id="s1")

    def merges(self) -> DataFrame:
        return self._part("merge", sheet="s1", min_row="n1", max_row="n2", min_col="n3", max_col="n4")

    def errors(self) -> DataFrame:
        return self._part("error", error="s1")


def read_word(binary: DataFrame, convert: Callable[[bytes], bytes] | None = None) -> Parsed:
    """``convert`` turns an older binary Word file into the present form, such as by an office program on the executors; without
    it, or if it fails, such a file gives an error row."""
    return Parsed(binary.select("doc_id", "content").mapInArrow(_parse_batches("word", convert), _ROW))


def read_excel(binary: DataFrame) -> Parsed:
    return Parsed(binary.select("doc_id", "content").mapInArrow(_parse_batches("excel"), _ROW))


def media(binary: DataFrame) -> DataFrame:
    """(doc_id, rel_id, content) of the pictures in Word files, by relation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        rels = ET.fromstring(z.read("word/_rels/document.xml.rels")).findall(f"{_PR}Relationship")
                        out += [(doc, r.get("Id"), z.read("word/" + r.get("Target"))) for r in rels if (r.get("Target") or "").startswith("media/")]
                except (zipfile.BadZipFile, KeyError, ET.ParseError):
                    continue  # the error table names the file
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.string(), pa.string(), pa.binary()))], names=["doc_id", "rel_id", "content"])

    return binary.select("doc_id", "content").mapInArrow(run, "doc_id string, rel_id string, content binary")


def save_media(pictures: DataFrame, folder: str) -> DataFrame:
    """(doc_id, rel_id, path): each picture under a name from its content, in a folder that all executors share; written twice
    it is the same file, so a repeated task does no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pathlib import Path

        root = Path(folder.removeprefix("file://"))
        root.mkdir(parents=True, exist_ok=True)
        for b in batches:
            paths = []
            for data in b.column(2).to_pylist():
                kind = "png" if data[:4] == b"\x89PNG" else "gif" if data[:3] == b"GIF" else "jpg"
                path = root / f"{hashlib.sha256(data).hexdigest()}.{kind}"
                part = path.with_suffix(f".{uuid.uuid4().hex}")
                part.write_bytes(data)
                part.replace(path)
                paths.append(str(path))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(paths, pa.string())], names=["doc_id", "rel_id", "path"])

    return pictures.select("doc_id", "rel_id", "content").mapInArrow(run, "doc_id string, rel_id string, path string")


# Writing


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), text.encode("utf-8"))
    return out.getvalue()


def _xml(text: str) -> str:
    return escape(_BAD_XML.sub("", text), {"\r": "&#13;"})


def _paragraph(text: str, images: list[str] = ()) -> str:
    runs = []
    for i, line in enumerate(text.split("\n")):
        runs.append("<w:br/>" if i else "")
        for k, part in enumerate(line.split("\t")):
            runs.append("<w:tab/>" if k else "")
            runs.append(f'<w:t xml:space="preserve">{_xml(part)}</w:t>')
    pics = "".join(f'<w:drawing><a:blip r:embed="{rel}"/></w:drawing>' for rel in images)
    return f"<w:p><w:r>{''.join(runs)}{pics}</w:r></w:p>"


def write_docx(body: list) -> bytes:
    """A minimal Word file. Items are a paragraph's text, (text, [relations]) for one with pictures, or a table as rows of
    cells (text, grid_span, v_merge), with a list of relations behind them for a cell with pictures."""
    parts = []
    for item in body:
        if isinstance(item, str):
            parts.append(_paragraph(item))
        elif isinstance(item, tuple):
            parts.append(_paragraph(*item))
        else:
            rows = []
            for row in item:
                tcs = []
                for text, span, merge, *rels in row:
                    *lines, last = (text or "").split("\n")
                    pr = f'<w:gridSpan w:val="{span}"/>' * (span > 1) + (f'<w:vMerge w:val="{merge}"/>' if merge else "")
                    tcs.append(f"<w:tc><w:tcPr>{pr}</w:tcPr>{''.join(_paragraph(t) for t in lines)}{_paragraph(last, *rels)}</w:tc>")
                rows.append(f"<w:tr>{''.join(tcs)}</w:tr>")
            parts.append(f"<w:tbl>{''.join(rows)}</w:tbl>")
    ns = f'xmlns:w="{_W[1:-1]}" xmlns:r="{_R[1:-1]}" xmlns:a="{_A[1:-1]}"'
    return _zip({"word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:document {ns}><w:body>{"".join(parts)}</w:body></w:document>'})


def _letters(col: int) -> str:
    out = ""
    while col:
        col, rest = divmod(col - 1, 26)
        out = chr(65 + rest) + out
    return out


def write_xlsx(sheets: dict[str, tuple[list[tuple], list[tuple]]]) -> bytes:
    """A minimal workbook: sheet name to (cells (r, c, text) from 0, merges (min_row, max_row, min_col, max_col) from 1)."""
    parts, entries, rels, shared = {}, [], [], {}
    for n, (name, (cells, merges)) in enumerate(sheets.items(), 1):
        rows: dict[int, list] = {}
        for r, c, text in sorted(cells, key=lambda x: x[:2]):
            rows.setdefault(r, []).append(f'<c r="{_letters(c + 1)}{r + 1}" t="s"><v>{shared.setdefault(text, len(shared))}</v></c>')
        data = "".join(f'<row r="{r + 1}">{"".join(x)}</row>' for r, x in rows.items())
        m = "".join(f'<mergeCell ref="{_letters(c1)}{r1}:{_letters(c2)}{r2}"/>' for r1, r2, c1, c2 in merges)
        parts[f"xl/worksheets/sheet{n}.xml"] = f'<worksheet xmlns="{_S[1:-1]}"><sheetData>{data}</sheetData>' + (f"<mergeCells>{m}</mergeCells>" if m else "") + "</worksheet>"
        entries.append(f'<sheet name={quoteattr(name)} sheetId="{n}" r:id="rId{n}"/>')
        rels.append(f'<Relationship Id="rId{n}" Target="worksheets/sheet{n}.xml"/>')
    parts["xl/workbook.xml"] = f'<workbook xmlns="{_S[1:-1]}" xmlns:r="{_R[1:-1]}"><sheets>{"".join(entries)}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="{_PR[1:-1]}">{"".join(rels)}</Relationships>'
    si = "".join(f'<si><t xml:space="preserve">{_xml(t)}</t></si>' for t in shared)
    parts["xl/sharedStrings.xml"] = f'<sst xmlns="{_S[1:-1]}">{si}</sst>'
    return _zip(parts)
