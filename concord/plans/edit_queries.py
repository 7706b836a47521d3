"""Queries of edits and of people's decisions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions.convert import Target
from concord.operators import alignment, edits, library, profile
from concord.plans.registry import query, table
from concord.plans.storage import cut

_REFUSED = "CASE o_orderkey % 5 WHEN 0 THEN 'conflict-preserved' WHEN 1 THEN 'no-value' WHEN 2 THEN 'ungrounded' END"


def _units(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    said = F.concat(F.lit("The order was placed early. Its price is "), F.col("o_custkey"), F.lit(" units in all. Nothing else is known!"))
    value = F.when(k % 5 == 1, "").when(k % 5 == 2, "Its price is not told anywhere.").otherwise(F.concat(F.lit("Its price is "), k, F.lit(" units in all.")))
    units = o.select("o_orderkey", said.alias("text"))
    intents = o.select("o_orderkey", value.alias("new_value"), (k % 5 == 0).alias("conflict"))
    grounding = F.concat(F.lit("we know: ITS  price is "), F.col("o_orderkey"), F.lit(" units in all."))
    return units, edits.guarded(intents, grounding)


@query(f"SELECT o_orderkey, {_REFUSED} AS refused FROM orders")
def edit_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts stay, empty and ungrounded values are never written."""
    return _units(spark, sf_dir)[1].select("o_orderkey", "refused")


@query(f"""
SELECT o_orderkey, CASE WHEN {_REFUSED} IS NULL THEN 'Its price is ' || o_orderkey || ' units in all.' ELSE 'The order was placed early. Its price is ' || o_custkey || ' units in all. Nothing else is known!' END AS text FROM orders""")
def edit_whole_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.replaced(*_units(spark, sf_dir), "o_orderkey").select("o_orderkey", "text")


_SPLICED = f"SELECT o_orderkey, 'The order was placed early. Its price is ' || CASE WHEN {_REFUSED} IS NULL THEN o_orderkey ELSE o_custkey END || ' units in all. Nothing else is known!' AS text FROM orders"


@query(_SPLICED)
def edit_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence that is meant is replaced; those around it stay."""
    return edits.spliced(*_units(spark, sf_dir), "o_orderkey").select("o_orderkey", "text")


@query(_SPLICED)
def edit_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by keeping, replacing and adding words."""
    return edits.tagged(*_units(spark, sf_dir), "o_orderkey").select("o_orderkey", "text")


@query("""
WITH c AS (SELECT conv_id AS target, role AS new_value, turn AS round FROM conversations), d AS (SELECT conv_id AS target, max_by('v' || turn, turn) AS new_value FROM conversations WHERE conv_id % 3 = 0 GROUP BY 1)
SELECT target, new_value, round FROM c UNION ALL SELECT target, new_value, (SELECT max(round) + 1 FROM c) FROM d""")
def resolve_units_by_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions make a new round; the last decision for a target counts."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("target"), F.col("role").alias("new_value"), F.col("turn").alias("round"))
    d = table(spark, sf_dir, "conversations").where("conv_id % 3 = 0").select(F.col("conv_id").alias("target"), F.concat(F.lit("v"), "turn").alias("new_value"), F.col("turn").alias("ord"))
    return edits.resolved(c, d, "target")


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND event_id % 40 = 0)")
def unresolve_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return edits.without(e.drop("event_type"), e.where("event_type = 'error' AND event_id % 40 = 0").select("user_id").distinct(), "user_id")


@query("""
SELECT 'before' AS run, count(*) AS filled, count(*) AS records FROM orders UNION ALL SELECT 'after', count(*) FILTER (o_orderpriority <> '' AND o_orderkey % 4 <> 0), count(*) FROM orders""")
def override_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records fill a target before and after a person points it at another path."""
    record = F.to_json(F.struct(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("priority")))
    docs = table(spark, sf_dir, "orders").select("o_orderkey", record.alias("record"))
    fields = [Target("orderId", ["integer"], True), Target("status")]
    long = cut(profile.cells(docs, ["o_orderkey"], "record"), "cells")
    found = cut(alignment.infer_mapping(profile.profile(long, ["o_orderkey"], None, profile.totals(docs, "record")), alignment.target_table(spark, fields)), "mapping")
    out = None
    for run, mapping in (("before", found), ("after", alignment.override(found, "status", "priority"))):
        part = alignment.execute(docs, long, ["o_orderkey"], mapping, fields).agg(F.lit(run).alias("run"), F.count("status").alias("filled"), F.count("*").alias("records"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'store' ELSE 'bundled' END AS origin FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def combined_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects of the writable store and the bundled ones; the store wins where both have an id."""
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return library.combined(ids.where("id % 3 = 0").withColumn("origin", F.lit("store")), ids.where("id % 2 = 0").withColumn("origin", F.lit("bundled")), "id")


@query("""
WITH u AS (SELECT user_id, event_id, CASE event_id % 4 WHEN 0 THEN 'note' || (event_id % 12) || '.md' WHEN 1 THEN 'report.docx' WHEN 2 THEN 'scan.png' ELSE 'slides.pptx' END AS name, event_id % 4 = 0 AND user_id % 2 = 0 AS note FROM events WHERE event_id % 4 > 0 OR user_id % 2 = 0),
n AS (SELECT *, bool_or(note) OVER (PARTITION BY user_id) AS has FROM u), k AS (SELECT * FROM n WHERE CASE WHEN has THEN note ELSE name IN ('report.docx', 'slides.pptx') END)
SELECT user_id, name, min(event_id) AS event_id FROM k GROUP BY ALL""")
def gather_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project's text notes; only where it has none, its deliverables; each name once."""
    k = F.col("event_id") % 4
    name = F.when(k == 0, F.concat(F.lit("note"), F.col("event_id") % 12, F.lit(".md"))).when(k == 1, "report.docx").when(k == 2, "scan.png").otherwise("slides.pptx")
    uploads = table(spark, sf_dir, "events").where("event_id % 4 > 0 OR user_id % 2 = 0").select("user_id", "event_id", name.alias("name"))
    return library.gathered(uploads, "user_id", "name", "event_id")
