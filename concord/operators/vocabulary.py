"""Values and aliases that people taught, as tables: (target, value, ...), (target, alias, value, ...), (target)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.operators.library import upsert

#: fixed values: reasons for which a shape may be rejected
REASONS = ["not_our_data", "wrong_mapping", "duplicate_shape", "bad_source_data", "other"]
NOTE = 10  # characters, blanks aside, that the reason "other" needs


def add_aliases(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """Aliases with new ones; a spelling that is known gets the new value."""
    return upsert(aliases, new, ["target", "alias"])


def remove_values(values: DataFrame, aliases: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the values (target, value); aliases of a removed value go with it."""
    keys = gone.select("target", "value").distinct()
    known = keys.join(values.select("target", "value").distinct(), ["target", "value"], "left_semi")
    return values.join(keys, ["target", "value"], "left_anti"), aliases.join(known, ["target", "value"], "left_anti")


def promoted(values: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases with those that values carry themselves (the older form); a spelling that is known stays, of several the first counts."""
    old = values.where("alias IS NOT NULL AND trim(alias) <> ''").select("target", F.trim("alias").alias("alias"), "value", "ord")
    first = old.groupBy("target", "alias").agg(F.min_by("value", "ord").alias("value"))
    return aliases.select("target", "alias", "value").unionByName(first.join(aliases.select("target", "alias"), ["target", "alias"], "left_anti"))


def merged(schema: DataFrame, values: DataFrame, free_form: DataFrame) -> DataFrame:
    """(target, ord, value): a schema's values in order, then taught ones in order, each once; a free-form target has none, and targets without a list stay so."""
    listed = schema.select("target", F.lit(0).alias("part"), "ord", "value").unionByName(values.join(schema.select("target").distinct(), "target", "left_semi").select("target", F.lit(1).alias("part"), "ord", "value"))
    first = listed.groupBy("target", "value").agg(F.min(F.struct("part", "ord")).alias("at"))
    kept = first.join(free_form.select("target"), "target", "left_anti")
    return kept.select("target", (F.row_number().over(Window.partitionBy("target").orderBy("at", "value")) - 1).alias("ord"), "value")


def rejection_error(category: Column, fields: Column, note: Column, known: list[str]) -> Column:
    """Why a rejection's reason is not enough, or null."""
    foreign = F.try_element_at(F.filter(fields, lambda f: ~f.isin(known)), F.lit(1))
    return (
        F.when(~category.isin(REASONS), F.concat(F.lit("unknown reject category: "), category))
        .when((category == "wrong_mapping") & (F.size(F.coalesce(fields, F.array().cast("array<string>"))) == 0), "wrong_mapping requires at least one golden field")
        .when((category == "wrong_mapping") & foreign.isNotNull(), F.concat(F.lit("not a golden field: "), foreign))
        .when((category == "other") & (F.length(F.regexp_replace(F.coalesce(note, F.lit("")), r"\s", "")) < NOTE), "category 'other' requires an informative note (>= 10 non-whitespace characters)")
    )


def rejection_text(category: Column, fields: Column, note: Column) -> Column:
    """The reason as it is kept."""
    said = F.trim(F.coalesce(note, F.lit("")))
    text = (
        F.when(category == "not_our_data", "Rejected — not our data.")
        .when(category == "wrong_mapping", F.concat(F.lit("Rejected — wrong field mapping ("), F.array_join(fields, ", "), F.lit(").")))
        .when(category == "duplicate_shape", "Rejected — duplicate of an existing shape.")
        .when(category == "bad_source_data", "Rejected — bad source data.")
        .when(category == "other", F.concat(F.lit("Rejected — "), said, F.lit(".")))
        .otherwise("Rejected.")
    )
    return F.when((category != "other") & (said != ""), F.concat(text, F.lit(" Note: "), said)).otherwise(text)
