"""The library of learned profiles and the vocabulary, as tables that are rewritten whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: what each action makes of an entry
STATES = {"register": "provisional", "approve": "approved", "retire": "retired", "reject": "rejected", "restore": "provisional"}


def current(actions: DataFrame, entry: str, order: list[str], action: str) -> DataFrame:
    """Each entry's state after its last action, and its version: how often it was registered."""
    last = F.max_by(action, F.struct(*order))
    to_state = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    return actions.groupBy(entry).agg(last.alias("_a"), F.count_if(F.col(action) == "register").alias("version")).select(entry, F.try_element_at(to_state, F.col("_a")).alias("state"), "version")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows in place of those with their keys."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def best_match(shapes: DataFrame, library: DataFrame) -> DataFrame:
    """Of each shape the library entry with the largest path Jaccard (of equals the largest id): joined on paths, not crossed."""
    s = shapes.select("shape", F.size("paths").alias("n"), F.explode("paths").alias("p"))
    l = library.select("profile_id", F.size("paths").alias("m"), F.explode("paths").alias("p"))  # noqa: E741
    shared = s.join(l, "p").groupBy("shape", "profile_id").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("m").alias("m"))
    score = shared.select("shape", "profile_id", F.round(F.col("k") / (F.col("n") + F.col("m") - F.col("k")), 6).alias("jaccard"))
    return score.groupBy("shape").agg(F.max(F.struct("jaccard", "profile_id")).alias("b")).select("shape", F.col("b.profile_id").alias("profile_id"), F.col("b.jaccard").alias("jaccard"))


def merged_values(schema: Column, learned: Column, free_form: Column) -> Column:
    """The schema's values first, then learned ones; a free-form field has no list."""
    return F.when(free_form, F.array().cast("array<string>")).otherwise(F.array_union(schema, learned))


def capped(rows: DataFrame, by: list[str], order: list[str], cap: int = 200) -> DataFrame:
    """The first rows of each group, with the group's true count."""
    w = Window.partitionBy(*by)
    return rows.select("*", F.row_number().over(w.orderBy(*order)).alias("_r"), F.count("*").over(w).alias("total")).where(F.col("_r") <= cap).drop("_r")


def distinct_stems(files: DataFrame, stem: str, order: list[str]) -> DataFrame:
    """Equal stems get _2, _3 and so on."""
    r = F.row_number().over(Window.partitionBy(stem).orderBy(*order))
    return files.withColumn("stored", F.when(r == 1, F.col(stem)).otherwise(F.concat(stem, F.lit("_"), r.cast("string"))))


def combined(store: DataFrame, bundled: DataFrame, key: str) -> DataFrame:
    """Both, but of an id that both have the store's."""
    return store.unionByName(bundled.join(store.select(key), key, "left_anti"))


def gathered(uploads: DataFrame, project: str, name: str, order: str) -> DataFrame:
    """Text notes of each project, or its Word, PowerPoint and PDF files where it has no notes; of one name the first."""
    note = F.lower(name).rlike(r"[.](txt|md)$")
    seen = uploads.withColumn("_n", note).withColumn("_has", F.bool_or("_n").over(Window.partitionBy(project)))
    kept = seen.where(F.col("_n") | (~F.col("_has") & F.lower(name).rlike(r"[.](docx|pptx|pdf)$")))
    return kept.groupBy(project, name).agg(F.min(order).alias(order))
