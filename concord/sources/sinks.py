"""Tables as files: JSON, Markdown, Word, PowerPoint, archives, and outputs that replace or add by document."""

from __future__ import annotations

import io
import json
import zipfile
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_report(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def markdown_report(units: DataFrame, report: str) -> DataFrame:
    """``units(report, section_ord, heading, unit_ord, key, value, status)`` to one text a report; what is open is said."""
    line = F.when(F.col("status") == "conflict", F.concat(F.lit("- "), "key", F.lit(": [conflict]"))).when(F.col("status") == "needs_review", F.concat(F.lit("- "), "key", F.lit(": [needs review]"))).otherwise(F.concat(F.lit("- "), "key", F.lit(": "), "value"))
    sections = units.groupBy(report, "section_ord", "heading").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_ord", line.alias("l")))), lambda x: x.l), "\n").alias("body"))
    whole = F.array_sort(F.collect_list(F.struct("section_ord", F.concat(F.lit("## "), "heading", F.lit("\n\n"), "body").alias("t"))))
    return sections.groupBy(report).agg(F.array_join(F.transform(whole, lambda x: x.t), "\n\n").alias("markdown"))


def write_outputs(golden: DataFrame, path: str, doc: str, replace: bool) -> None:
    """Conformed records by document: all anew, or only the documents at hand."""
    writer = golden.write.partitionBy(doc).mode("overwrite")
    (writer if replace else writer.option("partitionOverwriteMode", "dynamic")).json(path)


def download_name(stem: Column, postfix: Column, when: Column) -> Column:
    """Stem, a clean postfix and the time in UTC."""
    clean = F.regexp_replace(F.regexp_replace(postfix, "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", "")
    return F.concat(stem, F.when(clean != "", F.concat(F.lit("_"), clean)).otherwise(""), F.lit("_"), F.date_format(when, "yyyyMMdd'T'HHmmss'Z'"))


#: fixed values: names of the office formats' parts
TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
LINKS = "http://schemas.openxmlformats.org/package/2006/relationships"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SLIDE = "http://schemas.openxmlformats.org/presentationml/2006/main"
DRAW = "http://schemas.openxmlformats.org/drawingml/2006/main"
PARTS = "application/vnd.openxmlformats-officedocument"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
PLAIN = (1980, 1, 1, 0, 0, 0)  # of every entry, so that equal contents give equal files


def _zipped(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(zipfile.ZipInfo(name, PLAIN), content, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _package(main: str, kind: str, more: dict[str, str]) -> dict[str, str]:
    overrides = "".join(f'<Override PartName="/{n}" ContentType="{PARTS}.{k}+xml"/>' for n, k in {main: kind, **more}.items())
    types = f'{HEAD}<Types xmlns="{TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{overrides}</Types>'
    return {"[Content_Types].xml": types, "_rels/.rels": f'{HEAD}<Relationships xmlns="{LINKS}"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="{main}"/></Relationships>'}


#: fixed values: paragraph styles by block type
STYLES = {"heading": "Heading1", "list_item": "ListParagraph", "caption": "Caption"}


def docx(blocks: list[tuple[str, str]]) -> bytes:
    """A Word file of (type, text) blocks."""
    rows = []
    for kind, text in blocks:
        style = f'<w:pPr><w:pStyle w:val="{STYLES[kind]}"/></w:pPr>' if kind in STYLES else ""
        rows.append(f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>')
    body = f'{HEAD}<w:document xmlns:w="{WORD}"><w:body>{"".join(rows)}</w:body></w:document>'
    return _zipped({**_package("word/document.xml", "wordprocessingml.document.main", {}), "word/document.xml": body})


def pptx(blocks: list[tuple[str, str]]) -> bytes:
    """A PowerPoint file: a heading begins a slide and is its title."""
    slides: list[list[str]] = []
    for kind, text in blocks:
        if kind == "heading" or not slides:
            slides.append([])
        slides[-1].append(text)
    names = [f"ppt/slides/slide{k + 1}.xml" for k in range(len(slides))]
    parts = _package("ppt/presentation.xml", "presentationml.presentation.main", {n: "presentationml.slide" for n in names})
    ids = "".join(f'<p:sldId id="{256 + k}" r:id="rId{k + 1}"/>' for k in range(len(slides)))
    parts["ppt/presentation.xml"] = f'{HEAD}<p:presentation xmlns:p="{SLIDE}" xmlns:r="{OFFICE}"><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>'
    links = "".join(f'<Relationship Id="rId{k + 1}" Type="{OFFICE}/slide" Target="slides/slide{k + 1}.xml"/>' for k in range(len(slides)))
    parts["ppt/_rels/presentation.xml.rels"] = f'{HEAD}<Relationships xmlns="{LINKS}">{links}</Relationships>'
    for name, texts in zip(names, slides, strict=True):
        shapes = "".join(f'<p:sp><p:nvSpPr><p:cNvPr id="{k + 2}" name="t{k}"/><p:cNvSpPr/><p:nvPr/></p:nvSpPr><p:spPr/><p:txBody><a:bodyPr/><a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p></p:txBody></p:sp>' for k, t in enumerate(texts))
        parts[name] = f'{HEAD}<p:sld xmlns:p="{SLIDE}" xmlns:a="{DRAW}"><p:cSld><p:spTree><p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>{shapes}</p:spTree></p:cSld></p:sld>'
    return _zipped(parts)


LINES = 50  # of a PDF page


def pdf(blocks: list[tuple[str, str]]) -> bytes:
    """A PDF of (type, text) blocks, a line each; headings are larger.  Characters beyond Latin-1 become "?"."""
    pages = [blocks[k : k + LINES] for k in range(0, len(blocks), LINES)] or [[]]
    objects: list[bytes] = [b"<</Type/Catalog/Pages 2 0 R>>", b"", b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>"]
    kids = []
    for page in pages:
        rows = [b"BT", b"14 TL", b"72 760 Td"]
        for kind, text in page:
            raw = text.replace("\n", " ").encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
            rows.append(b"/F1 %d Tf (%s) Tj T*" % (14 if kind == "heading" else 10, raw))
        stream = zlib.compress(b"\n".join([*rows, b"ET"]), 6)
        kids.append(len(objects) + 1)
        objects.append(b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 612 792]/Resources<</Font<</F1 3 0 R>>>>/Contents %d 0 R>>" % (len(objects) + 2))
        objects.append(b"<</Length %d/Filter/FlateDecode>>stream\n%s\nendstream" % (len(stream), stream))
    objects[1] = b"<</Type/Pages/Kids[%s]/Count %d>>" % (b" ".join(b"%d 0 R" % k for k in kids), len(kids))
    out, places = b"%PDF-1.4\n", []
    for k, body in enumerate(objects):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k + 1, body)
    table = b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + table + b"trailer<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, len(out))


WRITERS = {"docx": docx, "pptx": pptx, "pdf": pdf}


def office_files(blocks: DataFrame, doc: str) -> DataFrame:
    """``blocks(doc, kind, ord, type, text)`` to (doc, kind, content): a file a document, docx, pptx or pdf."""
    grouped = blocks.groupBy(doc, "kind").agg(F.array_sort(F.collect_list(F.struct("ord", "type", "text"))).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [WRITERS[k]([(x["type"], x["text"] or "") for x in b]) for k, b in zip(batch.column("kind").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(doc), batch.column("kind"), pa.array(made, pa.binary())], [doc, "kind", "content"])

    return grouped.mapInArrow(run, f"{doc} {dict(blocks.dtypes)[doc]}, kind string, content binary")


def bundles(files: DataFrame, by: str) -> DataFrame:
    """``files(by, name, content)`` to (by, archive): the files of each bundle, and a manifest of their names and sizes."""
    grouped = files.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("name", "content"))).alias("f"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for some in batch.column("f").to_pylist():
                parts = {x["name"]: x["content"] for x in some}
                made.append(_zipped({"manifest.json": json.dumps([{"name": n, "bytes": len(c)} for n, c in parts.items()]), **parts}))
            yield pa.RecordBatch.from_arrays([batch.column(by), pa.array(made, pa.binary())], [by, "archive"])

    return grouped.mapInArrow(run, f"{by} {dict(files.dtypes)[by]}, archive binary")


def bundle_sizes(archives: DataFrame, by: str) -> DataFrame:
    """(by, n_entries, n_bytes) as the archives have them, the manifest's own bytes aside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column("archive").to_pylist():
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    listed = {x["name"]: x["bytes"] for x in json.loads(z.read("manifest.json"))}
                    assert all(len(z.read(n)) == size for n, size in listed.items())
                    rows.append((len(z.namelist()), sum(listed.values())))
            yield pa.RecordBatch.from_arrays([batch.column(by), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], [by, "n_entries", "n_bytes"])

    return archives.mapInArrow(run, f"{by} {dict(archives.dtypes)[by]}, n_entries long, n_bytes long")
