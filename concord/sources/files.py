"""Files as tables: JSON batches, text and Markdown blocks, Word paragraphs, routing by name."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: fixed values: parser by extension
PARSERS = {"md": "markdown", "markdown": "markdown", "txt": "text", "docx": "docx", "pptx": "pptx", "pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "tif": "image", "tiff": "image"}


#: fixed values: parser by the beginning of a MIME type
MIME = {"application/pdf": "pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml": "docx", "application/vnd.openxmlformats-officedocument.presentationml": "pptx", "image/": "image", "text/markdown": "markdown", "text/": "text"}


def route(path: Column, mime: Column | None = None) -> Column:
    """The parser by a file name's extension, then by MIME type; anything unknown is text."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in PARSERS.items() for x in kv])
    told = F.lit(None).cast("string")
    for begin, parser in reversed(MIME.items()):
        told = F.when(mime.startswith(begin), parser).otherwise(told) if mime is not None else told
    return F.coalesce(F.try_element_at(table, ext), told, F.lit("text"))


def json_documents(spark: SparkSession, path: str, name: str = r"([^/]+?)(?:\.json)?$") -> DataFrame:
    """doc_id (from the file's path), rec_idx, record: a file is a record or an array of them; one that can't be read gives a row without a record."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), name, 1).alias("doc_id"), F.try_parse_json("value").alias("v"))
    one = files.where(F.col("v").isNull() | ~F.schema_of_variant("v").startswith("ARRAY")).selectExpr("doc_id", "0 AS rec_idx", "to_json(v) AS record")
    several = files.where(F.schema_of_variant("v").startswith("ARRAY")).lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).selectExpr("doc_id", "`pos` AS rec_idx", "to_json(value) AS record")
    return one.unionByName(several)


LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def blocks(docs: DataFrame, doc: str, text: str, markdown: Column | None = None) -> DataFrame:
    """A block for each line that isn't blank: type, heading flag and the heading above it."""
    md = markdown if markdown is not None else F.lit(True)
    lines = docs.select(doc, md.alias("_md"), F.posexplode(F.split(F.col(text), LINE_END)).alias("ord", "line")).where(~F.col("line").rlike(r"^\s*$"))
    bare = F.regexp_replace("line", r"^\s+", "")
    heading = F.col("_md") & bare.startswith("#")
    item = F.col("_md") & bare.rlike(r"^[-*] ")
    out = lines.select(doc, "ord", F.when(heading, "heading").when(item, "list_item").otherwise("paragraph").alias("type"), F.regexp_replace("line", r"^\s+|\s+$", "").alias("text"))
    title = F.when(F.col("type") == "heading", F.trim(F.regexp_replace("text", "^[# ]+", "")))
    above = F.last(title, True).over(Window.partitionBy(doc).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return out.select("*", above.alias("section"), (F.col("type") == "heading").alias("heading"))


WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def _docx(data: bytes) -> Iterator[tuple[str, str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
    for p in body.iter(f"{WORD}p") if body is not None else ():
        text = "".join(t.text or "" for t in p.iter(f"{WORD}t")).strip()
        style = p.find(f"{WORD}pPr/{WORD}pStyle")
        name = (style.get(f"{WORD}val") or "").lower() if style is not None else ""
        if text:
            yield ("heading" if name.startswith(("heading", "title")) else "list_item" if "list" in name else "caption" if "caption" in name else "paragraph"), text


def _pptx(data: bytes) -> Iterator[tuple[str, str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        for name in slides:
            for k, p in enumerate(ElementTree.fromstring(z.read(name)).iter(f"{DRAW}p")):
                text = "".join(t.text or "" for t in p.iter(f"{DRAW}t")).strip()
                if text:
                    yield ("heading" if k == 0 else "paragraph"), text


STREAM = re.compile(rb"<<((?:[^>]|>(?!>))*)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
SHOWN = re.compile(rb"\((?:[^()\\]|\\.)*+\)|<[0-9A-Fa-f\s]*>|\bT[jJ*dDm](?![A-Za-z*])|\bET\b|'|\"", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
SCANNED = 20  # characters; a PDF with fewer has to be read by OCR


def _unescaped(raw: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|.)", one, raw, flags=re.S)


def _pdf(data: bytes) -> Iterator[tuple[str, str]]:
    """Lines of the text that a PDF's content streams show, in order; simple fonts only."""
    if not data.startswith(b"%PDF"):
        raise ValueError("not a PDF")
    found: list[str] = []
    for head, body in STREAM.findall(data):
        if b"/Subtype" in head or b"/Type/XRef" in head:
            continue
        content = zlib.decompressobj().decompress(body) if b"FlateDecode" in head else body
        if b"BT" not in content:
            continue
        line = b""
        for m in SHOWN.finditer(content):
            token = m[0]
            if token[:1] == b"(":
                line += _unescaped(token[1:-1])
            elif token[:1] == b"<":
                line += bytes.fromhex(re.sub(rb"\s", b"", token[1:-1]).decode() or "")
            elif token not in (b"Tj", b"TJ"):  # the next line begins
                found.append(line.decode("cp1252", "replace").strip())
                line = b""
        found.append(line.decode("cp1252", "replace").strip())
    found = [x for x in found if x]
    if sum(map(len, found)) < SCANNED:
        yield "needs_ocr", ""
        return
    for x in found:
        yield "paragraph", x


READERS = {"pptx": _pptx, "pdf": _pdf}


def office_blocks(files: DataFrame) -> DataFrame:
    """``files(path, content)`` of Word, PowerPoint and PDF documents to (path, ord, type, text); a broken file gives one row of type failed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows = list(READERS.get(path.lower().rpartition(".")[2], _docx)(data))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, zlib.error) as e:
                    rows = [("failed", str(e))]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["path", "ord", "type", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, ord int, type string, text string")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')
