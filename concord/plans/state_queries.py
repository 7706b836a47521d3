"""Queries of reports, jobs and what a project keeps between runs, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import convert, text
from concord.operators import alignment, layout, reconcile, reports, scoring
from concord.plans.alignment_queries import GAME, match_shapes
from concord.plans.library_queries import scratch
from concord.plans.registry import query, table


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 6 WHEN 0 THEN 'caption' WHEN 1 THEN 'table_title' WHEN 2 THEN 'page_number' WHEN 3 THEN 'page_number' ELSE 'text' END AS role FROM lineitem""")
def layout_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber") % 6
    said = F.when(k == 0, F.concat(F.lit(" Fig. "), "l_partkey", F.lit(": x"))).when(k == 1, F.concat(F.lit("TABLE"), "l_partkey")).when(k == 2, F.concat(F.lit("Page "), F.col("l_partkey") % 1000)).when(k == 3, "7").when(k == 4, "12345").otherwise("see figure 3")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", layout.role(said).alias("role"))


@query("""
WITH d AS (SELECT doc_id, source, doc_id % 3 > 0 AS completed, doc_id % 5 > 0 AS canonical FROM documents), s AS (SELECT conv_id AS target, text FROM conversations)
SELECT source, count(*) FILTER (completed AND canonical) AS source_documents, count(*) FILTER (completed AND canonical AND doc_id IN (SELECT target FROM s)) AS with_supplementals FROM d GROUP BY 1 HAVING count(*) FILTER (completed AND canonical) > 0""")
def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only completed documents that were parsed come into a report, with their supplementals."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    done = d.where("doc_id % 3 > 0").join(d.where("doc_id % 5 > 0").select("doc_id"), "doc_id", "left_semi")
    s = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("target"))
    counted = reports.report(done, s, "doc_id", ["source", "doc_id"])
    return counted.groupBy("source").agg(F.count("*").alias("source_documents"), F.count_if(F.col("n_supplementals") > 0).alias("with_supplementals"))


@query("""
SELECT p_partkey, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')), lambda w: NOT list_contains(regexp_extract_all(lower(p_type), '[a-z0-9]+'), w) AND w <> 'bracket')), ' ') AS foreign_ FROM part""")
def foreign_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a name that neither a target's name nor its description explains."""
    name, known = text.name_tokens(F.col("p_name")), F.array_union(text.name_tokens(F.col("p_type")), F.array(F.lit("bracket")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(F.array_except(name, known)), " ").alias("foreign_"))


@query("""
SELECT event_id, CASE event_type WHEN 'view' THEN 'relabel_graphic' WHEN 'click' THEN 'relabel_graphic' WHEN 'error' THEN 'flag' ELSE 'replace' END AS operation FROM events""")
def engine_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema's operations in the engine's words."""
    e = F.col("event_type")
    op = F.when(e == "view", "relabel_graphic").when(e == "click", "relocate_graphic").when(e == "error", "flag_needs_review").otherwise("replace_field")
    return table(spark, sf_dir, "events").select("event_id", reconcile.engine_operation(op).alias("operation"))


@query("""
SELECT conv_id, string_agg(role, '>' ORDER BY turn % 3, turn) AS assembled FROM conversations GROUP BY 1""")
def ordered_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results put together by order, then task, however they finished."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") % 3).alias("ord"), F.col("turn").alias("task"), "role")
    listed = F.array_sort(F.collect_list(F.struct("ord", "task", "role")))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(listed, lambda x: x.role), ">").alias("assembled"))


@query("""
SELECT * FROM (VALUES ('golden', 8, 0, 0), ('renamed', 7, 1, 0), ('nested', 8, 0, 0), ('synonyms', 8, 0, 0), ('arity', 7, 1, 0), ('conflict', 7, 0, 1), ('misspelt', 7, 1, 0), ('opaque', 0, 8, 0), ('decoys', 2, 6, 0), ('weather', 0, 8, 0)) AS s(kind, mapped, needs_review, conflicts)""")
def alignment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of each shape by status."""
    m = match_shapes(spark).groupBy("kind").agg(*[F.count_if(F.col("status") == s).cast("int").alias(n) for s, n in (("mapped", "mapped"), ("needs_review", "needs_review"), ("conflict", "conflicts"))])
    return m


_CASES = [
    ("releaseYear", "2001", "string", "2001", "date"), ("releaseYear", "10/09/2007", "string", "2007", "date"), ("releaseYear", "October 27, 2017", "string", "2017", "date"), ("criticScore", "97", "string", "97", "number"), ("criticScore", "90.0", "string", "90", "number"), ("criticScore", "9/10", "string", "9", "number"),
    ("genres", "Shooter;Action", "string", "Shooter|Action", "list"), ("genres", "Platformer", "string", "Platformer", "list"), ("platform", "PC", "string", "Windows PC", "alias"), ("platform", "Xbox", "string", "Xbox", "alias"), ("ESRB", "K-A", "string", "E", "alias"), ("ESRB", "Mature", "string", "M", "alias"), ("ESRB", "RP", "string", "E", "alias"),
]


@query("SELECT * FROM (VALUES ('date', 3, 1.0), ('number', 3, 0.666667), ('list', 2, 1.0), ('alias', 5, 0.8), (NULL, 13, 0.846154)) AS a(category, n, accuracy)")
def normalization_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw values converted by their targets and compared with what is expected."""
    rows = spark.createDataFrame(_CASES, "target string, value string, jtype string, expected string, category string")
    made = F.lit(None).cast("string")
    for t in GAME:
        got = convert.convert(t, F.col("value"), F.col("jtype"))
        made = F.when(F.col("target") == t.name, F.array_join(got, "|") if t.type == "array" else got.cast("string")).otherwise(made)
    return scoring.accuracy(rows.withColumn("correct", F.coalesce(made == F.col("expected"), F.lit(False))), "category", "correct").select("category", F.col("n").cast("int").alias("n"), "accuracy")


@query("""
WITH p AS (SELECT user_id AS target, max_by(CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'zz' END, event_id) AS path FROM events WHERE user_id % 7 > 0 GROUP BY 1)
SELECT target, path FROM p WHERE path = 'b' OR path = 'a' AND target % 2 = 0""")
def verified_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals for open targets hold only if the shape has the path and its type fits."""
    e = table(spark, sf_dir, "events")
    k, u = F.col("event_id") % 3, F.col("user_id")
    proposals = e.select("event_id", u.alias("target"), F.when(k == 0, "a").when(k == 1, "b").otherwise("zz").alias("path"))
    seen = F.array(F.struct(F.lit("a").alias("path"), F.lit("integer").alias("primary")), F.struct(F.lit("b").alias("path"), F.lit("string").alias("primary")))
    open_ = e.where("user_id % 7 > 0").select(u.alias("target"), F.when(u % 2 == 0, F.array(F.lit("number"))).otherwise(F.array(F.lit("boolean"))).alias("want"), seen.alias("candidates")).distinct()
    return alignment.verified_proposals(open_, proposals, "event_id").select("target", "path")


@query("""SELECT p_partkey AS id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+'))), ',') AS paths, p_size AS version FROM part""")
def library_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library written as JSON and loaded again: lists, maps and versions come back."""
    path = scratch(spark, "library")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_sort(F.array_distinct(text.name_tokens(F.col("p_name")))).alias("paths"), F.col("p_size").alias("version"))
    p.withColumn("types", F.map_from_arrays("paths", F.transform("paths", lambda x: F.lit("string")))).write.json(path)
    back = spark.read.schema("id long, paths array<string>, version int, types map<string,string>").json(path)
    return back.select("id", F.array_join(F.array_sort(F.map_keys("types")), ",").alias("paths"), "version")


@query("""SELECT event_id, greatest(0.0, least(1.0, (value - 50) / 100.0)) AS dial FROM events""")
def dials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("value") - 50) / 100.0)).alias("dial"))
