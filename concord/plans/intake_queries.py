"""Queries of uploads, drafts and project state over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.operators import intake
from concord.plans.registry import query, table

_NAMES = "CASE page_id % 8 WHEN 0 THEN 'a/Project.JSON' WHEN 1 THEN 'graphics.json' WHEN 2 THEN 'x.json' WHEN 3 THEN 'Email_1.txt' WHEN 4 THEN 'notes.md' WHEN 5 THEN 'fig.png' WHEN 6 THEN 'doc.pdf' ELSE 'noext' END"


def _name(key: str) -> F.Column:
    k = F.col(key) % 8
    out = F
    for n, v in enumerate(["a/Project.JSON", "graphics.json", "x.json", "Email_1.txt", "notes.md", "fig.png", "doc.pdf"]):
        out = out.when(k == n, v)
    return out.otherwise("noext")


@query(f"""
SELECT page_id, CASE page_id % 8 WHEN 5 THEN 'image' WHEN 6 THEN 'pdf' WHEN 7 THEN CASE page_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'text' ELSE 'unsupported' END ELSE CASE WHEN page_id % 3 = 0 THEN 'image' ELSE 'text' END END AS kind FROM (SELECT page_id, {_NAMES} AS name FROM pages)""")
def preview_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    mime = F.when((k % 3 == 0) & (k % 8 != 6), "image/png").when(k % 3 == 1, "text/plain")
    return table(spark, sf_dir, "pages").select("page_id", F.when((k % 8 == 6), intake.preview_kind(_name("page_id"), F.lit(None).cast("string"))).otherwise(intake.preview_kind(_name("page_id"), mime)).alias("kind"))


_AREA = "CASE event_type WHEN 'view' THEN 'template' WHEN 'click' THEN 'corrections' WHEN 'error' THEN 'corpus' ELSE 'first_draft' END"
_ROLE = f"""r AS (SELECT event_id, user_id, CASE event_id % 8 WHEN 0 THEN 'project.json' WHEN 1 THEN 'corpus/graphics.json' WHEN 2 THEN CASE {_AREA} WHEN 'template' THEN 'template/incident_report_template.json' WHEN 'first_draft' THEN 'first_attempt/incident_report_draft.json' WHEN 'corrections' THEN 'corrections/comments.json' END
 WHEN 3 THEN CASE {_AREA} WHEN 'corrections' THEN 'corrections/emails/Email_1.txt' WHEN 'corpus' THEN 'corpus/Email_1.txt' END WHEN 4 THEN CASE {_AREA} WHEN 'corpus' THEN 'corpus/notes.md' END END AS role FROM events)"""


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    area = F.when(e == "view", "template").when(e == "click", "corrections").when(e == "error", "corpus").otherwise("first_draft")
    return table(spark, sf_dir, "events").select("event_id", "user_id", intake.upload_role(_name("event_id"), area).alias("role"))


@query(f"WITH {_ROLE} SELECT event_id, role FROM r")
def upload_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's fixed name before the area it was put in."""
    return _roles(spark, sf_dir).select("event_id", "role")


@query(f"""
WITH {_ROLE}, h AS (SELECT user_id, bool_or(coalesce(role = 'project.json', false)) AS m, bool_or(coalesce(role IN ('corpus/Email_1.txt', 'corpus/notes.md'), false)) AS c, bool_or(coalesce(role LIKE 'template/%' OR role LIKE 'first_attempt/%', false)) AS s, bool_or(coalesce(role = 'corrections/comments.json', false)) AS k FROM r GROUP BY 1)
SELECT user_id, m AND c AND s AND k AS ready, (4 - m::INT - c::INT - s::INT - k::INT)::INT AS n_problems FROM h""")
def project_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.readiness(_roles(spark, sf_dir), "user_id", "role").select("user_id", "ready", F.size("problems").alias("n_problems"))


@query("""
SELECT user_id, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click FROM events GROUP BY 1""")
def readiness_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.counts_by_kind(table(spark, sf_dir, "events"), "user_id", "event_type", ["view", "click"])


SECTIONS = [("description", "1. Description of Event"), ("timeline", "2. Timeline"), ("root_cause", "3. Root Cause"), ("actions", "4) Corrective Actions")]


@query("""
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'description' WHEN 1 THEN 'timeline' WHEN 2 THEN 'root_cause' WHEN 3 THEN 'actions' WHEN 4 THEN 'root_cause' ELSE NULL END AS section FROM documents""")
def match_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings to a template's sections: numbers and case aside, the likest of those that are like enough."""
    k = F.col("doc_id") % 7
    heading = F.when(k == 0, "12. description of events").when(k == 1, "TIMELINE:").when(k == 2, "Root Causes").when(k == 3, "Corrective action").when(k == 4, "3) root cause").when(k == 5, "Weather").otherwise("")
    return intake.match_sections(table(spark, sf_dir, "documents").select("doc_id", heading.alias("heading")), "heading", SECTIONS).select("doc_id", "section")


@query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'lead_author' WHEN 1 THEN 'lead_author' WHEN 2 THEN 'site' END AS key, CASE o_orderkey % 5 WHEN 0 THEN 'A. Person ' || o_custkey WHEN 2 THEN 'Ward: ' || o_custkey END AS value FROM orders""")
def absorb_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """"Label: value" lines to declared fields; an empty value is consumed and stays empty, other lines are prose."""
    k = F.col("o_orderkey") % 5
    line = F.when(k == 0, F.concat(F.lit("  Lead Author : A. Person "), "o_custkey")).when(k == 1, "LEADAUTHOR:").when(k == 2, F.concat(F.lit("Location: Ward: "), "o_custkey")).when(k == 3, "Unknown label: x").otherwise("no label at all")
    fields = spark.sql("SELECT * FROM VALUES ('s', 'lead_author', CAST(NULL AS STRING), 0), ('s', 'site', 'Location', 1) AS f(section, key, label, ord)")
    lines = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("s").alias("section"), line.alias("text"))
    return intake.absorbed(lines, "text", fields).select("o_orderkey", "key", "value")


@query("""
SELECT c_custkey, ord, 'Figure ' || n AS text FROM (SELECT c_custkey, unnest([0, 1, 2]) AS ord, unnest([c_custkey, c_nationkey, 7]) AS n FROM customer)""")
def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("See figure "), "c_custkey", F.lit(" and FIG. "), "c_nationkey", F.lit("; Fig7 too, but no configure 9 or figures 3."))
    return intake.cross_references(table(spark, sf_dir, "customer").select("c_custkey", body.alias("body")), ["c_custkey"], "body")


@query("""
SELECT p_partkey AS figure, CASE p_partkey % 4 WHEN 0 THEN 'b' WHEN 1 THEN 'c' WHEN 2 THEN 'd' ELSE 'a' END AS section, CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS tier FROM part""")
def place_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A figure goes where the text names it, else where most words are shared, else by heading, else first."""
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, "packet_loss.png").otherwise(F.concat(F.lit("z"), "p_partkey", F.lit(".png")))
    caption = F.when(k == 1, "Cabinet wiring overview").when(k == 2, "Timeline chart").otherwise("")
    figures = table(spark, sf_dir, "part").select(F.lit(1).alias("doc"), F.col("p_partkey").alias("figure"), name.alias("name"), caption.alias("caption"))
    sections = spark.sql("SELECT * FROM VALUES (1, 'a', 0, 'Start', 'nothing here'), (1, 'b', 1, 'Loss', 'as packet_loss.png shows'), (1, 'c', 2, 'Wires', 'the cabinet and its wiring'), (1, 'd', 3, 'Timeline', 'then this') AS s(doc, section, ord, heading, body)")
    return intake.place_figures(figures, sections, "doc").select("figure", "section", "tier")


@query("""
SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_type = 'error' THEN 'conflict' WHEN event_type = 'view' OR event_id % 3 = 0 THEN 'needs_review' ELSE 'corrected' END AS status FROM events""")
def outcome_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, e = F.col("event_id"), F.col("event_type")
    way = F.when(e == "error", "declined").when(e == "view", "review").otherwise("replay_clean")
    return table(spark, sf_dir, "events").select("event_id", intake.outcome_status(way, k % 5 == 0, F.when(k % 3 == 0, "p")).alias("status"))


@query("""
SELECT conv_id, string_agg(CASE WHEN turn = 0 THEN '# ' || trim(text) WHEN turn % 2 = 1 THEN '- ' || trim(text) ELSE trim(text) END, chr(10) ORDER BY turn) AS markdown FROM conversations WHERE trim(text) <> '' GROUP BY 1""")
def blocks_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    blocks = table(spark, sf_dir, "conversations").select("conv_id", t.alias("ord"), F.when(t == 0, "heading").when(t % 2 == 1, "list_item").otherwise("paragraph").alias("type"), "text")
    return intake.as_markdown(blocks, "conv_id")


@query("SELECT page_id, true AS bounded, true AS distinct_ FROM pages")
def page_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three distinct defects a page, the same for the same seed."""
    defects = [f"d{k}" for k in range(13)]
    one, two = (intake.page_defects(table(spark, sf_dir, "pages"), "page_id", defects, 7) for _ in range(2))
    both = one.join(two, ["page_id", "defect"])
    return both.groupBy("page_id").agg(F.count("*").between(1, 3).alias("bounded"), (F.count_distinct("defect") == F.count("*")).alias("distinct_"))


_DRAFT = "b AS (SELECT conv_id, turn, role, turn % 4 AS k, ['description', 'timeline', 'root_cause', 'actions'][(turn // 4) % 4 + 1] AS section FROM conversations)"


def _draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    k, which = t % 4, F.floor(t / 4) % 4
    title = F.when(which == 0, "1. Description of Event").when(which == 1, "2. TIMELINE").when(which == 2, "Root causes").otherwise("4) Corrective Actions")
    said = F.when(k == 0, title).when(k == 1, F.concat(F.lit("Lead Author: A"), t)).when(k == 2, F.concat(F.lit(" [Figure:  f"), t, F.lit(".png ]"))).otherwise(F.col("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", t.alias("ord"), F.when(k == 0, "heading").otherwise("paragraph").alias("kind"), said.alias("text"))


@query(f"""
WITH {_DRAFT} SELECT conv_id, section, max_by('A' || turn, turn) FILTER (k = 1) AS author, count(*) FILTER (k = 2) AS n_figures, max_by('f' || turn || '.png', turn) FILTER (k = 2) AS last_figure, string_agg(role, ' ' ORDER BY turn) FILTER (k = 3) AS body FROM b GROUP BY 1, 2 HAVING count(*) FILTER (k > 0) > 0""")
def first_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A converted draft folded onto the template's sections."""
    fields = spark.sql("SELECT s AS section, 'lead_author' AS key, CAST(NULL AS STRING) AS label, 0 AS ord FROM VALUES ('description'), ('timeline'), ('root_cause'), ('actions') AS v(s)")
    values, figures, bodies = intake.first_attempt(_draft(spark, sf_dir), "conv_id", SECTIONS, fields)
    by = ["conv_id", "section"]
    counted = figures.groupBy(*by).agg(F.count("*").alias("n_figures"), F.max_by("ref_name", "ord").alias("last_figure"))
    whole = values.select(*by, F.col("value").alias("author")).join(counted, by, "full").join(bodies, by, "full")
    return whole.select(*by, "author", F.coalesce("n_figures", F.lit(0).cast("long")).alias("n_figures"), "last_figure", "body")


@query("SELECT conv_id, turn FROM conversations WHERE turn < 4")
def header_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands before the second heading."""
    return intake.header_block(_draft(spark, sf_dir), "conv_id").select("conv_id", F.col("ord").alias("turn"))
