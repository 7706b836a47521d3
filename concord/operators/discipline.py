"""Formatting rules: learned from a template's evidence, declared ones first, and what breaks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: fonts with the same measures
FONTS = {
    "arial": "Liberation Sans",
    "helvetica": "Liberation Sans",
    "arial narrow": "Liberation Sans Narrow",
    "times new roman": "Liberation Serif",
    "times": "Liberation Serif",
    "courier new": "Liberation Mono",
    "courier": "Liberation Mono",
    "calibri": "Carlito",
    "cambria": "Caladea",
}


def font_family(name: Column) -> Column:
    """The family a font is judged by; an unknown one stands for itself."""
    key = F.lower(F.trim(name))
    table = F.create_map(*[F.lit(x) for kv in {**FONTS, **{v.lower(): v for v in FONTS.values()}}.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), name)


def learned_placement(images: DataFrame, by: list[str]) -> DataFrame:
    """``images(by, ord, has_title, title_align, align, width)``: a title is required if every figure has one, not if none has, else undefined; of the rest the commonest value, of equals the first seen."""
    def most(column: str) -> DataFrame:
        counts = images.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"), F.min("ord").alias("f"))
        best = counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), "f", column)).alias("b"))
        return best.select(*by, F.col(f"b.{column}").alias(column))

    titled = images.groupBy(*by).agg(F.when(F.bool_and("has_title"), True).when(~F.bool_or("has_title"), False).alias("title_required"))
    for c in ("title_align", "align", "width"):
        titled = titled.join(most(c), by, "left")
    return titled


def precedence(declared: DataFrame, learned: DataFrame, keys: list[str]) -> DataFrame:
    """Declared values before learned ones."""
    return declared.withColumnRenamed("value", "_d").join(learned.withColumnRenamed("value", "_l"), keys, "full").select(*keys, F.coalesce("_d", "_l").alias("value"), F.when(F.col("_d").isNotNull(), "declared").otherwise("learned").alias("source"))


def inspect_images(images: DataFrame, rules: DataFrame, by: list[str]) -> DataFrame:
    """Findings on ``images(by, idx, has_caption, caption_position, has_title, title_align, width, align)`` by ``rules(by, caption_required, caption_position, title_required, title_align, width_px, want_align)``.

    A missing policy needs review; where a rule is undefined nothing else is wrong.
    """
    r = rules.select(*by, "caption_required", F.col("caption_position").alias("want_position"), "title_required", F.col("title_align").alias("want_title_align"), "width_px", "want_align")
    d = images.join(r, by)
    wide = F.greatest(F.lit(24), F.floor(F.col("width_px") * 0.15).cast("int"))

    def finding(test: Column, key: str, status: str, observed: Column | str, required: Column | str) -> Column:
        text = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("string")
        return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(key).alias("rule"), F.lit(status).alias("status"), text(observed).alias("observed"), text(required).alias("required")))

    found = [
        finding(F.col("caption_required").isNull(), "caption", "needs_review", "present", "undefined"),
        finding(F.col("caption_required") & ~F.col("has_caption"), "caption", "corrected", "missing", "required"),
        finding(F.col("caption_required").isNotNull() & ~(F.col("caption_required") & ~F.col("has_caption")) & (F.col("caption_position") != F.col("want_position")), "caption_position", "corrected", F.col("caption_position"), F.col("want_position")),
        finding(F.col("title_required") & ~F.col("has_title"), "title", "corrected", "missing", "centered title"),
        finding(F.col("title_required") & F.col("has_title") & (F.col("title_align") != F.col("want_title_align")), "title_align", "corrected", F.col("title_align"), F.col("want_title_align")),
        finding(F.abs(F.col("width") - F.col("width_px")) > wide, "width", "corrected", F.col("width"), F.col("width_px")),
        finding(F.col("align") != F.col("want_align"), "align", "corrected", F.col("align"), F.col("want_align")),
    ]
    return d.select(*by, "idx", F.explode(F.array_compact(F.array(*found))).alias("f")).select(*by, "idx", "f.*")


def inspect_tables(tables: DataFrame, title_required: bool | None, title_position: str | None, header_style: str | None) -> DataFrame:
    """Findings on ``tables(doc, idx, has_title, title_position, header_style)``."""
    if title_required is None:
        first = F.struct(F.lit("title").alias("rule"), F.lit("needs_review").alias("status"))
    else:
        missing = F.lit(title_required) & ~F.col("has_title")
        first = F.when(missing, F.struct(F.lit("title").alias("rule"), F.lit("corrected").alias("status")))
        if title_position:
            first = first.when(F.col("title_position") != title_position, F.struct(F.lit("title_position").alias("rule"), F.lit("corrected").alias("status")))
    second = F.when(F.col("header_style") != header_style, F.struct(F.lit("header_style").alias("rule"), F.lit("corrected").alias("status"))) if header_style else F.lit(None).cast("struct<rule:string,status:string>")
    return tables.select("doc", "idx", F.explode(F.array_compact(F.array(first, second))).alias("f")).select("doc", "idx", "f.*")


def inspect_text(samples: DataFrame, rules: DataFrame, by: list[str]) -> DataFrame:
    """``samples(by, element, idx, attr, value)`` by ``rules(by, element, attr, value)``: deviations, fonts by family; an element without any rule needs review once."""
    known = rules.select(*by, "element").distinct().withColumn("known", F.lit(True))
    r = rules.select(*by, "element", "attr", F.col("value").alias("required"))
    family = lambda c: F.when(F.col("attr") == "font", font_family(F.col(c))).otherwise(F.col(c))
    off = samples.where("value IS NOT NULL AND value <> ''").join(r, [*by, "element", "attr"]).where(family("value") != family("required"))
    off = off.select(*by, "element", "idx", "attr", F.lit("corrected").alias("status"), F.col("value").alias("observed"), "required")
    unknown = samples.select(*by, "element").distinct().join(known, [*by, "element"], "left_anti")
    unknown = unknown.select(*by, "element", F.lit(None).cast("int").alias("idx"), F.lit(None).cast("string").alias("attr"), F.lit("needs_review").alias("status"), F.lit("present").alias("observed"), F.lit("undefined").alias("required"))
    return off.unionByName(unknown)


def caption_geometry(boxes: DataFrame, wanted: str, tolerance: float, width: float) -> DataFrame:
    """``boxes`` with caption_top, caption_bottom, caption_cx (null without a caption): where the caption lies, whether it is centred, and the status."""
    below, above = F.col("caption_top") >= F.col("bottom") - 1, F.col("caption_bottom") <= F.col("top") + 1
    position = F.when(F.col("caption_top").isNull(), "none").when(below, "below").when(above, "above").otherwise("beside")
    placed = below if wanted == "below" else above
    centred = F.abs(F.col("caption_cx") - (F.col("x0") + F.col("x1")) / 2) <= tolerance * width
    return boxes.withColumn("position", position).withColumn("aligned", F.coalesce(centred, F.lit(False))).withColumn("status", F.when(F.coalesce(placed & centred, F.lit(False)), "unchanged").otherwise("corrected"))


def page_number_geometry(boxes: DataFrame, page: str, height: float, width: float, band: float, centre: bool) -> DataFrame:
    """The first page-number box of a page lies in the footer band, and in its middle where the rule asks for that."""
    w = Window.partitionBy(page).orderBy("top", "box_id")
    first = boxes.select("*", F.row_number().over(w).alias("_r")).where("_r = 1").drop("_r")
    low = F.col("top") >= height * (1 - band)
    middle = F.abs((F.col("x0") + F.col("x1")) / 2 - width / 2) <= 0.2 * width
    return first.select(page, "box_id", low.alias("in_footer"), middle.alias("centred"), F.when(low & (middle if centre else F.lit(True)), "unchanged").otherwise("corrected").alias("status"))
