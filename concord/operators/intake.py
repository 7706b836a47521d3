"""Uploads and drafts: their role, their sections and fields, where figures go, whether a project is ready."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: extensions by preview
IMAGES = ["png", "jpg", "jpeg", "gif", "webp", "bmp"]
OFFICE = ["docx", "pptx", "doc", "ppt", "odt", "odp", "xlsx", "xls"]
TEXTS = ["txt", "md", "json", "csv", "log", "yaml", "yml", "xml", "html"]
LEAST_RATIO = 0.6


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^/.]\.([A-Za-z0-9]+)$", 1))


def preview_kind(name: Column, mime: Column) -> Column:
    """How a document is shown: by extension, else by MIME type."""
    ext, mime = extension(name), F.coalesce(mime, F.lit(""))
    return (
        F.when(ext.isin(IMAGES) | mime.startswith("image/"), "image").when((ext == "pdf") | (mime == "application/pdf"), "pdf")
        .when(ext.isin(OFFICE), "office-pdf").when(ext.isin(TEXTS) | mime.startswith("text/"), "text").otherwise("unsupported")
    )


def upload_role(name: Column, area: Column) -> Column:
    """Where an upload belongs: a file with a fixed name before all, else by the area it was put in; null has no role."""
    base, ext = F.lower(F.element_at(F.split(name, "/"), -1)), extension(name)
    plain = F.element_at(F.split(name, "/"), -1)
    return (
        F.when(base == "project.json", "project.json").when(base == "graphics.json", "corpus/graphics.json")
        .when((area == "template") & (ext == "json"), "template/incident_report_template.json")
        .when((area == "first_draft") & (ext == "json"), "first_attempt/incident_report_draft.json")
        .when((area == "corrections") & base.startswith("email_") & (ext == "txt"), F.concat(F.lit("corrections/emails/"), plain))
        .when((area == "corrections") & (ext == "json"), "corrections/comments.json")
        .when((area == "corpus") & ext.isin("txt", "md"), F.concat(F.lit("corpus/"), plain))
    )


def readiness(files: DataFrame, project: str, role: str) -> DataFrame:
    """Of each project what it has, what is missing, and whether it can run."""
    r = F.col(role)
    has = {
        "manifest": r == "project.json",
        "corpus": r.rlike(r"^corpus/.*\.(txt|md)$"),
        "start": r.startswith("template/") | r.startswith("first_attempt/"),
        "corrections": r == "corrections/comments.json",
    }
    counts = files.groupBy(project).agg(*[F.coalesce(F.bool_or(test), F.lit(False)).alias(f"has_{k}") for k, test in has.items()])
    missing = {
        "has_manifest": "Upload the project manifest (project.json).",
        "has_corpus": "Upload the original corpus (at least one .txt/.md).",
        "has_start": "Upload a template or a first draft (at least one).",
        "has_corrections": "Upload corrections (comments.json).",
    }
    problems = F.array_compact(F.array(*[F.when(~F.col(c), F.lit(said)) for c, said in missing.items()]))
    return counts.withColumn("problems", problems).withColumn("ready", F.size("problems") == 0)


def counts_by_kind(records: DataFrame, project: str, kind: str, kinds: list[str]) -> DataFrame:
    """A column a kind."""
    return records.groupBy(project).pivot(kind, kinds).agg(F.count(F.lit(1))).na.fill(0)


def bare_heading(text: Column) -> Column:
    """A heading in lower case without its number."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s*\d+[.)]\s*", "")))


def match_sections(headings: DataFrame, heading: str, sections: list[tuple[str, str]]) -> DataFrame:
    """``headings`` with the template section (key, heading) that each is most like, if it is like one at all; distinct headings are compared once."""
    known = [(key, key.replace("_", " "), title) for key, title in sections]
    bare = headings.select(bare_heading(F.col(heading)).alias("_h")).distinct()
    template = headings.sparkSession.createDataFrame([(t,) for _, _, t in known], "t string").select(bare_heading(F.col("t")).alias("t"))
    titles = [r[0] for r in template.collect()]  # a row a section of the template

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for h in batch["_h"]:
                best, most = None, 0.0
                for (key, words, _), title in zip(known, titles, strict=True):
                    ratio = max(difflib.SequenceMatcher(None, h, c).ratio() for c in (title, words)) if h else 0.0
                    if ratio > most:
                        best, most = key, ratio
                found.append(best if most >= LEAST_RATIO else None)
            yield pd.DataFrame({"_h": batch["_h"], "section": found})

    matched = bare.mapInPandas(run, "_h string, section string")
    return headings.withColumn("_h", bare_heading(F.col(heading))).join(matched, "_h", "left").drop("_h")


def absorbed(lines: DataFrame, text: str, fields: DataFrame) -> DataFrame:
    """``lines(section, text)`` with the field (key) whose label they begin with, and its value; ``fields(section, key, label)``."""
    pattern = r"^\s*([A-Za-z][\w /-]{1,40}?)\s*:\s*(.*?)\s*$"
    squeeze = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit(""))
    told = lines.withColumn("_l", squeeze(F.regexp_extract(text, pattern, 1))).withColumn("value", F.regexp_extract(text, pattern, 2))
    names = F.array_distinct(F.array(squeeze(F.coalesce("label", "key")), squeeze(F.replace("key", F.lit("_"), F.lit(" ")))))
    known = fields.select("section", "key", "ord", F.explode(names).alias("_l")).groupBy("section", "_l").agg(F.min_by("key", "ord").alias("key"))
    return told.join(known, ["section", "_l"], "left").withColumn("value", F.when(F.col("key").isNotNull() & (F.col("value") != ""), F.col("value"))).drop("_l")


def cross_references(bodies: DataFrame, keys: list[str], text: str) -> DataFrame:
    """A row for each "Figure N" of a body, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\b(?:figure|fig\.?)\s*(\d+)\b"), F.lit(1))
    return bodies.select(*keys, F.posexplode(found).alias("ord", "n")).select(*keys, "ord", F.concat(F.lit("Figure "), "n").alias("text"))


def place_figures(figures: DataFrame, sections: DataFrame, by: str) -> DataFrame:
    """``figures(by, figure, name, caption)`` into ``sections(by, section, ord, heading, body)``: where the body names the file, else where it shares most words (two at least), else by the heading's words, else the first."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) > 2))
    stem = F.lower(F.regexp_replace("name", r"\.[^.]*$", ""))
    f = figures.withColumn("_stem", stem).withColumn("_words", F.array_union(words(F.col("caption")), words(stem))).withColumn("_cap", words(F.when(F.col("caption") != "", F.col("caption")).otherwise(stem)))
    both = f.join(sections, by)  # figures x sections of one document
    body = F.lower("body")
    named = F.contains(body, F.lower("name")) | ((F.col("_stem") != "") & F.contains(body, F.col("_stem")))
    shared = F.size(F.array_intersect("_words", F.split(body, "[^a-z0-9]+")))
    rank = F.when(named, F.struct(F.lit(3).alias("tier"), F.lit(0).alias("n"))).when(shared >= 2, F.struct(F.lit(2).alias("tier"), shared.alias("n"))).otherwise(F.struct(F.lit(1).alias("tier"), F.size(F.array_intersect("_cap", words(F.col("heading")))).alias("n")))
    best = F.row_number().over(Window.partitionBy(by, "figure").orderBy(F.desc("_rank"), "ord"))
    return both.withColumn("_rank", rank).select(by, "figure", "section", F.col("_rank.tier").alias("tier"), best.alias("_b")).where("_b = 1").drop("_b")


def outcome_status(pathway: Column, quarantined: Column, provisional: Column) -> Column:
    """A cluster's outcome as a unit's status."""
    return F.when(quarantined | (pathway == "declined"), "conflict").when((pathway == "review") | provisional.isNotNull(), "needs_review").otherwise("corrected")


def as_markdown(blocks: DataFrame, doc: str) -> DataFrame:
    """``blocks(doc, ord, type, text)`` as one Markdown text a document."""
    said = F.trim("text")
    line = F.when(F.col("type").isin("heading", "slide_title"), F.concat(F.lit("# "), said)).when(F.col("type") == "list_item", F.concat(F.lit("- "), said)).otherwise(said)
    lines = blocks.where(F.length(said) > 0).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))).alias("b"))
    return lines.select(doc, F.array_join(F.transform("b", lambda x: x.l), "\n").alias("markdown"))


def page_defects(pages: DataFrame, page: str, defects: list[str], seed: int, least: int = 1, most: int = 3) -> DataFrame:
    """One to three of the defects for each page, drawn by a hash of page, defect and seed: the same seed gives the same."""
    rows = pages.select(page, F.explode(F.array(*map(F.lit, defects))).alias("defect"))
    order = F.row_number().over(Window.partitionBy(page).orderBy(F.xxhash64(page, "defect", F.lit(seed)), "defect"))
    want = F.pmod(F.xxhash64(F.col(page), F.lit(seed)), F.lit(most - least + 1)) + least
    return rows.withColumn("_r", order).where(F.col("_r") <= want).drop("_r")


def first_attempt(blocks: DataFrame, doc: str, sections: list[tuple[str, str]], fields: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``blocks(doc, ord, kind, text)`` folded onto a template: field values (of several the last), figure references and bodies by section.

    A heading that is like a section's begins it; one that is like none is passed over, and what
    stands before the first is left out.
    """
    heads = match_sections(blocks.where("kind = 'heading'").select(doc, "ord", "text"), "text", sections).select(doc, "ord", F.col("section").alias("_s"))
    now = F.last("_s", ignorenulls=True).over(Window.partitionBy(doc).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    placed = blocks.join(heads, [doc, "ord"], "left").withColumn("section", now).where("section IS NOT NULL AND kind = 'paragraph'").drop("_s")
    marker = r"(?i)^\s*\[FIGURE:\s*(.+?)\]\s*$"
    figures = placed.where(F.col("text").rlike(marker)).select(doc, "section", "ord", F.trim(F.regexp_extract("text", marker, 1)).alias("ref_name"))
    told = absorbed(placed.where(~F.col("text").rlike(marker)), "text", fields)
    values = told.where("value IS NOT NULL").groupBy(doc, "section", "key").agg(F.max_by("value", "ord").alias("value"))
    lines = F.array_sort(F.collect_list(F.struct("ord", "text")))
    bodies = told.where("key IS NULL").groupBy(doc, "section").agg(F.trim(F.array_join(F.transform(lines, lambda x: x.text), " ")).alias("body"))
    return values, figures, bodies


def header_block(blocks: DataFrame, doc: str) -> DataFrame:
    """The blocks before a document's second heading."""
    seen = F.count_if(F.col("kind") == "heading").over(Window.partitionBy(doc).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("_n", seen).where("_n < 2").drop("_n")
