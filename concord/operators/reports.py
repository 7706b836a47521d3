"""Document records: duplicates, statuses, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicates(docs: DataFrame, key: str, content: str) -> DataFrame:
    """The content hash of each document and the first document that has it, if another."""
    h = F.sha2(F.col(content), 256)
    first = F.min(key).over(Window.partitionBy("sha256"))
    return docs.select(key, h.alias("sha256")).select(key, "sha256", F.when(first != F.col(key), first).alias("duplicate_of"))


def overall_status(stages: Column, error: Column | None = None) -> Column:
    """failed before completed (there are stages, all completed or skipped) before processing before pending."""
    failed = F.exists(stages, lambda s: s == "failed")
    return (
        F.when(failed if error is None else failed | (F.coalesce(error, F.lit("")) != ""), "failed")
        .when((F.size(stages) > 0) & F.forall(stages, lambda s: s.isin("completed", "skipped")), "completed")
        .when(F.exists(stages, lambda s: s == "processing"), "processing")
        .otherwise("pending")
    )


def effective_time(created: Column, modified: Column, file_time: Column, ingested: Column) -> tuple[Column, Column]:
    """The first of the times a document has, and which it is."""
    when = F.coalesce(created, modified, file_time, ingested)
    return when, F.when(created.isNotNull(), "created").when(modified.isNotNull(), "modified").when(file_time.isNotNull(), "file_mtime").otherwise("ingested")


def report(docs: DataFrame, supplementals: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Documents in time order with the number of supplementals that target each; those without target belong to the project."""
    counts = supplementals.where(F.col("target").isNotNull()).groupBy(F.col("target").alias(key)).agg(F.count("*").alias("n_supplementals"))
    return docs.join(counts, key, "left").withColumn("n_supplementals", F.coalesce("n_supplementals", F.lit(0).cast("long"))).orderBy(*order)


def job_counts(jobs: DataFrame, payload: str, state: str, path: str = "$.project_id") -> DataFrame:
    """Jobs by project (a value of their payload; jobs without one are left out) and state."""
    named = jobs.select(F.get_json_object(payload, path).alias("project"), state).where("project IS NOT NULL")
    return named.groupBy("project", state).agg(F.count("*").alias("n"))


def retried(jobs: DataFrame, attempts: str, failed: str, most: int = 3) -> DataFrame:
    """State after an attempt: done, queued again, or failed after the last."""
    return jobs.withColumn("state", F.when(~F.col(failed), "done").when(F.col(attempts) < most, "queued").otherwise("failed"))


def worst_state(parts: DataFrame, by: list[str], state: str, order: list[str]) -> DataFrame:
    """The worst state of each group; ``order`` from best to worst, an unknown state being the worst."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, s in enumerate(order) for x in (s, k)]), F.col(state)), F.lit(len(order)))
    return parts.groupBy(*by).agg(F.max_by(state, rank).alias("state"), F.count("*").alias("n"))


def running_total(rows: DataFrame, by: list[str], order: list[str], amount: str) -> DataFrame:
    """How many were done up to and with each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("done", F.sum(amount).over(w))


def pruned(index: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """The index without entries of documents that are gone."""
    return index.join(documents.select(key), key, "left_semi")


def claim(jobs: DataFrame, state: str, waiting: list[str], order: list[str]) -> DataFrame:
    """The next job: the first of those waiting."""
    return jobs.where(F.col(state).isin(waiting)).orderBy(*order).limit(1)
