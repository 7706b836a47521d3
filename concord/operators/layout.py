"""Boxes on pages, and formatting rules against what is observed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(boxes: DataFrame, captions: DataFrame, page: str = "page") -> DataFrame:
    """Each box's caption on its page: the least distance of tops, then the smaller id."""
    joined = boxes.join(captions, page)
    return joined.groupBy(page, "box_id").agg(F.min(F.struct(F.abs(F.col("caption_top") - F.col("top")).alias("d"), F.col("caption_id"))).alias("m")).select(page, "box_id", F.col("m.caption_id").alias("caption_id"), F.round("m.d", 6).alias("distance"))


def not_overlapping(boxes: DataFrame, others: DataFrame, page: str = "page") -> DataFrame:
    """Boxes that overlap none of the others on their page."""
    o = others.select(F.col(page).alias("_p"), F.col("x0").alias("ox0"), F.col("x1").alias("ox1"), F.col("top").alias("otop"), F.col("bottom").alias("obottom"))
    hit = (F.col(page) == F.col("_p")) & (F.col("x0") < F.col("ox1")) & (F.col("ox0") < F.col("x1")) & (F.col("top") < F.col("obottom")) & (F.col("otop") < F.col("bottom"))
    return boxes.join(o, hit, "left_anti")


def lines(words: DataFrame, page: str = "page", pitch: float = 3.0) -> DataFrame:
    """Words of one bucket of tops make a line."""
    bucket = F.bround(F.col("top") / pitch).cast("long").alias("line")
    return words.groupBy(page, bucket).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word"))), lambda x: x.word), " ").alias("text"))


def dominant(observed: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of equals the one seen first."""
    counts = observed.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "_first")
    return counts.select("*", F.row_number().over(w).alias("_r")).where("_r = 1").drop("_r", "_first")


def violations(rules: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence that differs from a declared rule; without a rule nothing is wrong."""
    r = F.broadcast(rules.select("area", "attr", F.col("value").alias("expected")))  # rules are declared by hand
    return evidence.join(r, ["area", "attr"]).where(~F.col("value").eqNullSafe(F.col("expected"))).select("area", "attr", "idx", F.col("value").alias("found"), "expected")


def caption_adjacency(blocks: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """``blocks(doc, image, caption)`` in order: of each image whether its caption is the block behind it, or the one before."""
    w = Window.partitionBy(doc).orderBy(*order)
    seen = blocks.select("*", F.lag("caption").over(w).alias("_b"), F.lead("caption").over(w).alias("_a"))
    return seen.where("image").withColumn("caption_position", F.when(F.col("_a"), "below").when(F.col("_b"), "above").otherwise("none")).drop("_a", "_b")


def role(text: Column) -> Column:
    """What a line on a page is by its text: caption, table title, page number, or text."""
    return (
        F.when(text.rlike(r"(?i)^\s*(?:figure|fig\.?)\s*\d+"), "caption").when(text.rlike(r"(?i)^\s*table\s*\d+"), "table_title")
        .when(text.rlike(r"(?i)^\s*(?:page\s*)?\d{1,3}\s*$"), "page_number").otherwise("text")
    )
