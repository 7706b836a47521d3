"""Facts from a corpus: sentences, the best of them for a query, and the value in one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: headings that are cut off a body
LABELS = ["Summary", "Observations", "Findings", "Preliminary Assessment", "Assessment"]
TERMS = "[a-z0-9]+"


def sentences(text: Column) -> Column:
    """Split behind terminators, at bullets and before an inline "Label:"."""
    parts = F.split(text, r"(?<=[.!?])\s+|\s*[-•]\s+|\s+(?=[A-Z][a-z]+:\s)")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    """Blocks between empty lines, blanks run together."""
    return F.filter(F.transform(F.split(text, "\n\n"), lambda b: F.trim(F.regexp_replace(b, r"\s+", " "))), lambda b: b != "")


def chunks(docs: DataFrame, doc: str, text: str, fine: bool = False) -> DataFrame:
    """(doc, chunk_id, text): paragraphs, or their sentences."""
    blocks = docs.select(doc, F.posexplode(paragraphs(F.col(text))).alias("i", "block"))
    if not fine:
        return blocks.select(doc, F.concat(F.col(doc).cast("string"), F.lit("#c"), "i").alias("chunk_id"), F.col("block").alias("text"))
    parts = blocks.select(doc, "i", F.posexplode(sentences(F.col("block"))).alias("j", "text"))
    return parts.select(doc, F.concat(F.col(doc).cast("string"), F.lit("#c"), "i", F.lit("s"), "j").alias("chunk_id"), "text")


def _quoted(hint: Column) -> Column:
    return F.concat(F.lit(r"\Q"), hint, F.lit(r"\E"))


def _first(text: Column, pattern: Column) -> Column:
    """The first group of the first match of a pattern that is built by row."""
    return F.call_function("regexp_extract", text, pattern, F.lit(1))


def value_in(text: Column, extract: Column, query: Column, hint: Column) -> Column:
    """The value that a sentence gives: the token behind a hint, the text behind a label, a version, a date, a duration, or the line that shares most with the query."""
    some = lambda c: F.when(c != "", c)
    token = some(F.regexp_replace(_first(text, F.concat(F.lit("(?i)"), _quoted(hint), F.lit(r"\s+([A-Za-z0-9][\w.\-]*)"))), r"[.,;:]+$", ""))
    label = F.regexp_replace(hint, ":+$", "")
    labelled = some(F.trim(_first(text, F.concat(_quoted(label), F.lit(r"\s*:\s*(.+?)(?:\s{2,}|\s+[A-Z][a-z]+:|$)")))))
    version = some(F.regexp_extract(text, r"\b(\d+\.\d+(?:\.\d+)?)\b", 1))
    date = some(F.regexp_extract(text, r"\b(\d{4}-\d{2}-\d{2})\b", 1))
    span = r"(?i)\b(\w+)\s+(hours?|minutes?|days?|weeks?)\b"
    duration = F.when(F.regexp_like(text, F.lit(span)), F.lower(F.concat(F.regexp_extract(text, span, 1), F.lit(" "), F.regexp_extract(text, span, 2))))
    terms = F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit(TERMS), F.lit(0)))
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct((-F.size(F.array_intersect(F.regexp_extract_all(F.lower(x), F.lit(TERMS), F.lit(0)), terms))).alias("n"), i.alias("i"), F.trim(x).alias("t")))
    best = F.array_min(F.filter(lines, lambda x: x.n < 0))["t"]
    line = some(F.when(best.contains(":"), F.trim(F.regexp_replace(best, r"^[^:]*:", ""))).otherwise(best))
    by_label = (extract == "line") & hint.isNotNull() & hint.endswith(":")
    return (
        F.when((extract == "token") & hint.isNotNull(), token)
        .when(by_label & labelled.isNotNull(), labelled)
        .when(extract == "version", version)
        .when(extract == "date", date)
        .when(extract == "duration", duration)
        .when(extract == "line", line)
    )


def strip_label(text: Column, anchor: Column | None = None) -> Column:
    """Without a heading word in front; the first that fits is cut."""
    out = F.trim(text)
    for label in reversed(LABELS):
        out = F.when(F.regexp_like(text, F.lit(rf"(?i)^\s*{label}\s+")), F.trim(F.regexp_replace(text, rf"(?i)^\s*{label}\s+", ""))).otherwise(out)
    if anchor is None:
        return out
    pattern = F.concat(F.lit(r"(?i)^\s*"), _quoted(anchor), F.lit(r"\s+"))
    return F.when(anchor.isNotNull() & F.coalesce(F.regexp_like(text, pattern), F.lit(False)), F.trim(F.regexp_replace(text, pattern, F.lit("")))).otherwise(out)


def field_query(query: Column, label: Column, key: Column, section: Column) -> Column:
    """The declared query, or the label and section in words."""
    words = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("_"), F.lit(" "))
    derived = F.trim(F.concat(words(F.coalesce(label, key)), F.lit(" "), words(section)))
    return F.when(F.coalesce(query, F.lit("")) != "", query).otherwise(derived)


def facts(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Of ``hits(keys, chunk_id, source_doc, text, score, extract, query, hint, wanted_doc)``, each query's best 8: the value of the first that has one, those with the hint before all others, those of another document left out."""
    near = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "chunk_id"))
    top = hits.select("*", near.alias("_r")).where("_r <= 8").where("wanted_doc IS NULL OR wanted_doc = source_doc")
    hinted = F.contains(F.lower("text"), F.lower("hint"))
    top = top.withColumn("_h", F.coalesce(hinted, F.lit(False))).withColumn("_any", F.max("_h").over(Window.partitionBy(*keys))).where("_h OR NOT _any")
    valued = top.withColumn("value", value_in(F.col("text"), F.col("extract"), F.col("query"), F.col("hint"))).where("value IS NOT NULL")
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("_r"))
    method = F.concat(F.lit("retrieval+"), "extract", F.when(F.col("hint").isNotNull(), "+hint").otherwise(""))
    return valued.select("*", first.alias("_f")).where("_f = 1").select(*keys, "value", "source_doc", "chunk_id", F.round("score", 3).alias("score"), method.alias("method"))
