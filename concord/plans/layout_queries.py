"""Queries of formatting, page geometry, scoring and generated variations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import text
from concord.operators import discipline, generate, layout, scoring
from concord.plans.registry import query, table


@query("""
WITH f AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN ' Arial' WHEN 1 THEN 'Times New Roman' WHEN 2 THEN 'CALIBRI' WHEN 3 THEN 'liberation mono' WHEN 4 THEN p_brand ELSE 'courier' END AS font FROM part)
SELECT p_partkey, CASE (SELECT p_size % 6 FROM part p WHERE p.p_partkey = f.p_partkey) WHEN 0 THEN 'Liberation Sans' WHEN 1 THEN 'Liberation Serif' WHEN 2 THEN 'Carlito' WHEN 3 THEN 'Liberation Mono' WHEN 4 THEN font ELSE 'Liberation Mono' END AS family FROM f""")
def font_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 6
    font = F.when(k == 0, " Arial").when(k == 1, "Times New Roman").when(k == 2, "CALIBRI").when(k == 3, "liberation mono").when(k == 4, F.col("p_brand")).otherwise("courier")
    return table(spark, sf_dir, "part").select("p_partkey", discipline.font_family(font).alias("family"))


_IMAGES = "i AS (SELECT p_brand AS brand, p_partkey AS ord, CASE WHEN p_brand < 'Brand#3' THEN true WHEN p_brand < 'Brand#5' THEN false ELSE p_size % 2 = 0 END AS has_title, CASE WHEN p_size % 3 > 0 THEN CASE p_size % 2 WHEN 0 THEN 'center' ELSE 'left' END END AS align, p_size % 4 * 100 + 100 AS width FROM part)"


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    titled = F.when(F.col("p_brand") < "Brand#3", True).when(F.col("p_brand") < "Brand#5", False).otherwise(F.col("p_size") % 2 == 0)
    align = F.when(F.col("p_size") % 3 > 0, F.when(F.col("p_size") % 2 == 0, "center").otherwise("left"))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("ord"), titled.alias("has_title"), align.alias("align"), align.alias("title_align"), (F.col("p_size") % 4 * 100 + 100).alias("width"))


@query(f"""
WITH {_IMAGES}, t AS (SELECT brand, CASE WHEN bool_and(has_title) THEN true WHEN NOT bool_or(has_title) THEN false END AS title_required FROM i GROUP BY 1),
ac AS (SELECT brand, align, count(*) AS n, min(ord) AS f FROM i WHERE align IS NOT NULL GROUP BY brand, align), a AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY n DESC, f) AS r FROM ac),
wc AS (SELECT brand, width, count(*) AS n, min(ord) AS f FROM i GROUP BY brand, width), w AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY n DESC, f) AS r FROM wc)
SELECT brand, title_required, align, width FROM t LEFT JOIN a USING (brand) JOIN w USING (brand) WHERE coalesce(a.r, 1) = 1 AND w.r = 1""")
def learned_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a template's figures establish: titles where all have one, commonest alignment and width."""
    return discipline.learned_placement(_images(spark, sf_dir), ["brand"]).select("brand", "title_required", "align", "width")


_PLACED = """x AS (SELECT p_brand AS brand, p_partkey AS idx, p_size % 2 = 0 AS has_caption, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 3 = 0 THEN 'above' ELSE 'below' END AS caption_position, p_size % 4 < 3 AS has_title, CASE WHEN p_size % 7 = 0 THEN 'left' ELSE 'center' END AS title_align, p_size * 10 AS width, CASE WHEN p_size % 11 = 0 THEN 'right' ELSE 'center' END AS align FROM part),
r AS (SELECT DISTINCT p_brand AS brand, CASE right(p_brand, 1)::INT % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS required FROM part)"""


@query(f"""
WITH {_PLACED}, j AS (SELECT * FROM x JOIN r USING (brand))
SELECT brand, idx, 'caption' AS rule, 'needs_review' AS status, 'present' AS observed, 'undefined' AS required FROM j WHERE required IS NULL
UNION ALL SELECT brand, idx, 'caption', 'corrected', 'missing', 'required' FROM j WHERE required AND NOT has_caption
UNION ALL SELECT brand, idx, 'caption_position', 'corrected', caption_position, 'below' FROM j WHERE required IS NOT NULL AND NOT (required AND NOT has_caption) AND caption_position <> 'below'
UNION ALL SELECT brand, idx, 'title', 'corrected', 'missing', 'centered title' FROM j WHERE NOT has_title
UNION ALL SELECT brand, idx, 'title_align', 'corrected', title_align, 'center' FROM j WHERE has_title AND title_align <> 'center'
UNION ALL SELECT brand, idx, 'width', 'corrected', width::VARCHAR, '250' FROM j WHERE abs(width - 250) > greatest(24, floor(250 * 0.15))
UNION ALL SELECT brand, idx, 'align', 'corrected', align, 'center' FROM j WHERE align <> 'center'""")
def inspect_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven kinds of findings on figures."""
    s = F.col("p_size")
    images = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("idx"), (s % 2 == 0).alias("has_caption"), F.when(s % 5 == 0, None).when(s % 3 == 0, "above").otherwise("below").alias("caption_position"), (s % 4 < 3).alias("has_title"), F.when(s % 7 == 0, "left").otherwise("center").alias("title_align"), (s * 10).alias("width"), F.when(s % 11 == 0, "right").otherwise("center").alias("align"))
    k = F.right("brand", F.lit(1)).cast("int") % 3
    rules = images.select("brand").distinct().select("brand", F.when(k == 1, True).when(k == 2, False).alias("caption_required"), F.lit("below").alias("caption_position"), F.lit(True).alias("title_required"), F.lit("center").alias("title_align"), F.lit(250).alias("width_px"), F.lit("center").alias("want_align"))
    return discipline.inspect_images(images, rules, ["brand"])


@query("""
SELECT l_orderkey AS doc, l_linenumber AS idx, CASE WHEN l_quantity < 10 THEN 'title' ELSE 'title_position' END AS rule, 'corrected' AS status FROM lineitem WHERE l_quantity < 10 OR l_returnflag = 'A'
UNION ALL SELECT l_orderkey, l_linenumber, 'header_style', 'corrected' FROM lineitem WHERE l_linestatus = 'F'""")
def inspect_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("idx"), (F.col("l_quantity") >= 10).alias("has_title"), F.when(F.col("l_returnflag") == "A", "below").otherwise("above").alias("title_position"), F.when(F.col("l_linestatus") == "F", "plain").otherwise("bold").alias("header_style"))
    return discipline.inspect_tables(t, True, "above", "bold")


@query("""
WITH s AS (SELECT source, lang AS element, doc_id AS idx, CASE doc_id % 3 WHEN 0 THEN 'Arial' WHEN 1 THEN 'helvetica' ELSE 'Courier' END AS font, CASE WHEN doc_id % 4 = 0 THEN 'bold' END AS weight FROM documents)
SELECT source, element, idx, 'font' AS attr, 'corrected' AS status, font AS observed, 'Liberation Sans' AS required FROM s WHERE element IN ('en', 'fr') AND font = 'Courier'
UNION ALL SELECT source, element, idx, 'weight', 'corrected', weight, 'normal' FROM s WHERE element IN ('en', 'fr') AND weight IS NOT NULL
UNION ALL SELECT DISTINCT source, element, NULL::BIGINT, NULL, 'needs_review', 'present', 'undefined' FROM s WHERE element NOT IN ('en', 'fr')""")
def inspect_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that deviates from its element's style, fonts judged by family; elements without a rule."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    s = d.select("source", F.col("lang").alias("element"), k.alias("idx"), F.explode(F.create_map(F.lit("font"), F.when(k % 3 == 0, "Arial").when(k % 3 == 1, "helvetica").otherwise("Courier"), F.lit("weight"), F.when(k % 4 == 0, "bold"))).alias("attr", "value"))
    rules = d.select("source").distinct().select("source", F.explode(F.array(F.lit("en"), F.lit("fr"))).alias("element")).select("source", "element", F.explode(F.create_map(F.lit("font"), F.lit("Liberation Sans"), F.lit("weight"), F.lit("normal"))).alias("attr", "value"))
    return discipline.inspect_text(s, rules, ["source"])


@query("""
WITH d AS (SELECT doc_id % 3 AS k, lang, doc_id, source FROM documents), a AS (SELECT source AS area, lang AS attr, min(doc_id)::VARCHAR AS v FROM d WHERE k = 0 GROUP BY ALL), b AS (SELECT source AS area, lang AS attr, max(doc_id)::VARCHAR AS v FROM d WHERE k <> 0 GROUP BY ALL)
SELECT area, attr, coalesce(a.v, b.v) AS value, CASE WHEN a.v IS NULL THEN 'learned' ELSE 'declared' END AS source FROM a FULL JOIN b USING (area, attr)""")
def rule_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("area"), F.col("lang").alias("attr"), "doc_id")
    declared = d.where("doc_id % 3 = 0").groupBy("area", "attr").agg(F.min("doc_id").cast("string").alias("value"))
    learned = d.where("doc_id % 3 <> 0").groupBy("area", "attr").agg(F.max("doc_id").cast("string").alias("value"))
    return discipline.precedence(declared, learned, ["area", "attr"])


_GEOMETRY = "b AS (SELECT l_orderkey AS page, l_partkey * 10 + l_linenumber AS box_id, l_quantity AS x0, l_quantity + 40 AS x1, 100.0 AS top, 200.0 AS bottom, CASE l_linenumber % 4 WHEN 0 THEN 199.5 WHEN 1 THEN 60.0 WHEN 2 THEN 150.0 END AS caption_top, CASE l_linenumber % 4 WHEN 0 THEN 220.0 WHEN 1 THEN 100.9 WHEN 2 THEN 170.0 END AS caption_bottom, CASE WHEN l_linenumber % 4 < 3 THEN l_quantity + 20 + l_tax * 400 END AS caption_cx FROM lineitem)"


@query(f"""
WITH {_GEOMETRY} SELECT page, box_id, CASE WHEN caption_top IS NULL THEN 'none' WHEN caption_top >= bottom - 1 THEN 'below' WHEN caption_bottom <= top + 1 THEN 'above' ELSE 'beside' END AS position, coalesce(abs(caption_cx - (x0 + x1) / 2) <= 0.02 * 600, false) AS aligned,
 CASE WHEN caption_top >= bottom - 1 AND abs(caption_cx - (x0 + x1) / 2) <= 0.02 * 600 THEN 'unchanged' ELSE 'corrected' END AS status FROM b""")
def caption_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where captions lie, within a point, and whether they are centred, within a share of the page."""
    k, li = F.col("l_linenumber") % 4, table(spark, sf_dir, "lineitem")
    boxes = li.select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("box_id"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 40).alias("x1"), F.lit(100.0).alias("top"), F.lit(200.0).alias("bottom"), F.when(k == 0, 199.5).when(k == 1, 60.0).when(k == 2, 150.0).alias("caption_top"), F.when(k == 0, 220.0).when(k == 1, 100.9).when(k == 2, 170.0).alias("caption_bottom"), F.when(k < 3, F.col("l_quantity") + 20 + F.col("l_tax") * 400).alias("caption_cx"))
    return discipline.caption_geometry(boxes, "below", 0.02, 600.0).select("page", "box_id", "position", "aligned", "status")


@query("""
WITH b AS (SELECT l_orderkey AS page, l_partkey * 10 + l_linenumber AS box_id, l_quantity * 10 AS x0, l_quantity * 10 + 20 AS x1, l_extendedprice / 100 AS top FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY top, box_id) AS r FROM b), g AS (SELECT page, box_id, top >= 800 * (1 - 0.9) AS in_footer, abs((x0 + x1) / 2 - 300) <= 0.2 * 600 AS centred FROM f WHERE r = 1)
SELECT *, CASE WHEN in_footer AND centred THEN 'unchanged' ELSE 'corrected' END AS status FROM g""")
def page_number_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    boxes = li.select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("box_id"), (F.col("l_quantity") * 10).alias("x0"), (F.col("l_quantity") * 10 + 20).alias("x1"), (F.col("l_extendedprice") / 100).alias("top"))
    return discipline.page_number_geometry(boxes, "page", 800.0, 600.0, 0.9, True)


@query("""
WITH t AS (SELECT doc_id, text, regexp_replace(text, '[^A-Za-z]', '', 'g') AS l FROM documents)
SELECT doc_id, CASE WHEN l = '' THEN 'none' WHEN l = upper(l) THEN 'upper' WHEN len(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda w: left(w, 1) <> upper(left(w, 1)))) = 0 THEN 'title' ELSE 'sentence' END AS casing FROM t""")
def casing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.casing(F.col("text")).alias("casing"))


@query("SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_name || ' / ' || p_type), '[a-z0-9]+'), '_') AS slug FROM part")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"))


@query("""
WITH n AS (SELECT p_partkey, p_name AS a FROM part), b AS (SELECT p_partkey, a, len(list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, i, 2)))) AS n FROM n) SELECT p_partkey, n::INT AS n FROM b""")
def bigram_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.size(text.bigrams(F.col("p_name"))).alias("n"))


@query("""
WITH e AS (SELECT user_id, event_id, value, event_id % 3 = 0 AS targeted, event_id % 5 = 0 AS changed, event_id % 7 = 0 AS right_, event_id % 11 = 0 AS conflict FROM events)
SELECT user_id, count(*) FILTER (targeted) AS targeted, count(*) FILTER (targeted AND changed AND right_) AS correct, count(*) FILTER (NOT targeted AND changed) AS unintended, count(*) FILTER (targeted AND conflict) AS conflicts,
 round(CASE WHEN count(*) FILTER (targeted AND NOT conflict) = 0 THEN 1.0 ELSE count(*) FILTER (targeted AND changed AND right_ AND NOT conflict) * 1.0 / count(*) FILTER (targeted AND NOT conflict) END, 6) AS recall,
 round(CASE WHEN count(*) FILTER (changed) = 0 THEN 1.0 ELSE count(*) FILTER (targeted AND changed AND right_) * 1.0 / count(*) FILTER (changed) END, 6) AS "precision" FROM e GROUP BY 1""")
def edit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that were meant, made and right, against those that were not meant."""
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select("user_id", (k % 3 == 0).alias("targeted"), (k % 5 == 0).alias("changed"), (k % 7 == 0).alias("right"), (k % 11 == 0).alias("conflict"))
    return scoring.edits(e, ["user_id"])


@query("""
SELECT event_type, round(min(value), 6) AS least, round(median(value), 6) AS median, round(quantile_disc(value, 0.9), 6) AS p90, round(max(value), 6) AS most FROM events GROUP BY 1""")
def latency_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.latencies(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("""
WITH g AS (SELECT o_orderkey % 10 AS axis, o_orderkey, o_orderkey % 4 <> 0 AS is_field, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'wrong' ELSE 'right' END AS got FROM orders)
SELECT axis, count(*) FILTER (is_field AND got = 'right') AS recovered, count(*) FILTER (is_field AND got IS NULL) AS missed, count(*) FILTER (got = 'wrong' OR NOT is_field AND got IS NOT NULL) AS false_match FROM g GROUP BY 1""")
def frontier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields recovered and missed, and matches that are false: to another target, or of a decoy."""
    k = F.col("o_orderkey")
    truth = F.when(k % 4 != 0, "right")
    got = F.when(k % 3 == 0, None).when(k % 7 == 0, "wrong").otherwise("right")
    return scoring.frontier(table(spark, sf_dir, "orders").select((k % 10).alias("axis"), truth.alias("golden"), got.alias("matched")), ["axis"])


@query("""
WITH m AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'lab-large-2' WHEN 'click' THEN 'lab-small' ELSE 'other' END AS model, event_id % 1000 AS tin, event_id % 300 AS tout, value FROM events), p AS (SELECT *, CASE WHEN contains(model, 'large') THEN 3.0 WHEN contains(model, 'small') THEN 0.5 END AS price_in, CASE WHEN contains(model, 'large') THEN 9.0 WHEN contains(model, 'small') THEN 1.5 END AS price_out FROM m)
SELECT model, count(*) AS calls, sum(tin)::BIGINT AS tokens_in, sum(tout)::BIGINT AS tokens_out, round(avg(value), 6) AS latency, round(sum(tin * price_in + tout * price_out) / 1e6, 9) AS dollars FROM p GROUP BY 1""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, tokens, latency and price by model; the price of the first name that a model's name holds, else none."""
    e = table(spark, sf_dir, "events")
    model = F.when(F.col("event_type") == "view", "lab-large-2").when(F.col("event_type") == "click", "lab-small").otherwise("other")
    calls = e.select(model.alias("model"), (F.col("event_id") % 1000).alias("tokens_in"), (F.col("event_id") % 300).alias("tokens_out"), F.col("value").alias("latency"))
    return scoring.run_metrics(calls, {"large": (3.0, 9.0), "small": (0.5, 1.5)})


@query("""
WITH r AS (SELECT o_orderkey, o_orderkey % 8 AS level, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice FROM orders)
SELECT o_orderkey, CASE level WHEN 0 THEN 'src_order_date_v2' WHEN 1 THEN 'orderDate' WHEN 2 THEN 'order-date' ELSE 'order_date' END AS key, CASE level % 4 WHEN 0 THEN strftime(day::DATE, '%d/%m/%Y') WHEN 1 THEN strftime(day::DATE, '%m/%d/%Y') WHEN 2 THEN strftime(day::DATE, '%B %d, %Y') ELSE strftime(day::DATE, '%d-%m-%Y') END AS value FROM r""")
def variation_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys restyled and dates in other notations, by knobs."""
    k = F.col("o_orderkey") % 8
    key = F.when(k == 0, generate.restyled(F.lit("order_date"), "affix")).when(k == 1, generate.restyled(F.lit("order_date"), "case")).when(k == 2, generate.restyled(F.lit("order_date"), "delimiter")).otherwise("order_date")
    return table(spark, sf_dir, "orders").select("o_orderkey", key.alias("key"), generate.redated(F.date_format("o_orderdate", "yyyy-MM-dd"), k % 4).alias("value"))


@query("""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN '1' ELSE '0' END ELSE CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END END AS value FROM events""")
def boolean_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", generate.boolean_variant(k % 2 == 0, k % 3).alias("value"))


@query("""
SELECT i AS ord, 'field_' || i AS name, i < 2 AS required FROM range(400) t(i)""")
def wide_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema of so many text fields, the first two required."""
    rows = [(k, t.name, t.required) for k, t in enumerate(generate.wide_schema(400))]
    return spark.createDataFrame(rows, "ord long, name string, required boolean")


@query("""
SELECT o_orderkey % 50 AS report, o_orderkey AS unit, CASE WHEN o_orderkey % 3 = 0 THEN 'High' ELSE o_orderpriority END = o_orderpriority AS value_ok, CASE WHEN o_orderkey % 4 = 0 THEN 'filled' ELSE 'corrected' END = 'corrected' AS status_ok FROM orders""")
def gold_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    gold = o.select((k % 50).alias("report"), k.alias("unit"), F.col("o_orderpriority").alias("value"), F.lit("corrected").alias("status"))
    made = o.select((k % 50).alias("report"), k.alias("unit"), F.when(k % 3 == 0, "High").otherwise(F.col("o_orderpriority")).alias("value"), F.when(k % 4 == 0, "filled").otherwise("corrected").alias("status"))
    return scoring.unit_matches(made, gold, ["report", "unit"])


@query("""
WITH u AS (SELECT o_orderkey % 50 AS report, o_orderkey % 3 <> 0 AS v, o_orderkey % 4 <> 0 AS s FROM orders)
SELECT report, count(*) AS units, round(100.0 * avg(v::INT), 6) AS value_pct, round(100.0 * avg(s::INT), 6) AS status_pct FROM u GROUP BY 1""")
def gold_report_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a report's units with the right value and the right status."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    gold = o.select((k % 50).alias("report"), k.alias("unit"), F.col("o_orderpriority").alias("value"), F.lit("corrected").alias("status"))
    made = o.select((k % 50).alias("report"), k.alias("unit"), F.when(k % 3 == 0, "other").otherwise(F.col("o_orderpriority")).alias("value"), F.when(k % 4 == 0, "filled").otherwise("corrected").alias("status"))
    return scoring.report_scores(scoring.unit_matches(made, gold, ["report", "unit"]), ["report"])


@query("""
WITH w AS (SELECT l_orderkey AS doc, l_linenumber AS ord, l_returnflag = 'A' AS image, l_returnflag = 'N' AS caption FROM lineitem),
n AS (SELECT *, lag(caption) OVER (PARTITION BY doc ORDER BY ord, image, caption) AS before, lead(caption) OVER (PARTITION BY doc ORDER BY ord, image, caption) AS after FROM w)
SELECT doc, ord, CASE WHEN after THEN 'below' WHEN before THEN 'above' ELSE 'none' END AS caption_position, count(*) AS n FROM n WHERE image GROUP BY ALL""")
def caption_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A figure's caption is the block next to it: the one behind before the one in front."""
    blocks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("ord"), (F.col("l_returnflag") == "A").alias("image"), (F.col("l_returnflag") == "N").alias("caption"))
    return layout.caption_adjacency(blocks, "doc", ["ord", "image", "caption"]).groupBy("doc", "ord", "caption_position").agg(F.count("*").alias("n"))
