"""The engine's operators over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.functions import convert, text
from concord.functions.convert import Target
from concord.operators import alignment, batch, layout, library, profile, reconcile, reports, retrieval, scoring
from concord.plans.orders import ORDER_FIELDS, order_records
from concord.plans.registry import ORACLE, QUERIES, query, table
from concord.plans.storage import cut
from concord.sources import files

__all__ = ["ORACLE", "QUERIES"]


def _r(x: F.Column | str, n: int = 6) -> F.Column:
    return F.round(x, n)


@query("""
SELECT o_orderkey, o_orderkey AS "orderId", c_name AS "customerName", round(o_totalprice, 6) AS "totalPrice", o_orderstatus AS "orderStatus",
  strftime(o_orderdate, '%Y-%m-%d') AS "orderDate", replace(o_orderpriority, '-', ';') AS "tags"
FROM orders JOIN customer ON o_custkey = c_custkey""")
def align_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three shapes of one table, each cluster profiled, mapped, converted and validated in one plan: the columns come back."""
    out = batch.align_shapes(order_records(spark, sf_dir).select("o_orderkey", "record"), "o_orderkey", "record", ORDER_FIELDS).where("conformant")
    return out.select("o_orderkey", "orderId", "customerName", _r("totalPrice").alias("totalPrice"), "orderStatus", "orderDate", F.array_join("tags", ";").alias("tags"))


@query("""
WITH m(style, target, path, method) AS (VALUES
 (0, 'orderId', 'orderId', 'exact'), (0, 'customerName', 'customerName', 'exact'), (0, 'totalPrice', 'totalPrice', 'exact'), (0, 'orderStatus', 'orderStatus', 'exact'), (0, 'orderDate', 'orderDate', 'exact'), (0, 'tags', 'tags[]', 'exact'),
 (1, 'orderId', 'order_id', 'exact'), (1, 'customerName', 'customer_name', 'exact'), (1, 'totalPrice', 'total_price', 'exact'), (1, 'orderStatus', 'order_status', 'exact'), (1, 'orderDate', 'order_date', 'exact'), (1, 'tags', 'tags', 'exact'),
 (2, 'orderId', 'header.orderId', 'exact'), (2, 'customerName', 'party.customerName', 'exact'), (2, 'totalPrice', 'sums.totalPrice', 'exact'), (2, 'orderStatus', 'header.orderStatus', 'exact'), (2, 'orderDate', 'header.orderDate', 'exact'), (2, 'tags', 'tags[]', 'exact'))
SELECT CAST(style AS BIGINT) AS style, target, path, method, CAST(1.0 AS DOUBLE) AS confidence, 'mapped' AS status FROM m WHERE style IN (SELECT DISTINCT o_orderkey % 3 FROM orders)""")
def infer_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = order_records(spark, sf_dir).select("o_orderkey", "style", "record")
    long = cut(profile.cells(docs, ["style", "o_orderkey"], "record"), "cells")
    found = profile.profile(long, ["o_orderkey"], ["style"], profile.totals(docs, "record", ["style"]))
    return alignment.infer_mapping(found, alignment.target_table(spark, ORDER_FIELDS), ["style"]).select("style", "target", "path", "method", "confidence", "status")


@query("""
SELECT event_type, 'k' AS path, 'integer' AS types, count(*) AS present, count(*) AS total FROM events GROUP BY event_type""")
def json_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = profile.cells(table(spark, sf_dir, "events"), ["event_type", "event_id"], "props")
    total = profile.totals(table(spark, sf_dir, "events"), "props", ["event_type"])
    return profile.profile(long, ["event_id"], ["event_type"], total).select("event_type", "path", F.array_join("types", ",").alias("types"), "present", "total")


@query("""
WITH c AS (SELECT event_type, props->>'$.k' AS v, min(event_id) AS f FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY f) AS r FROM c)
SELECT event_type, string_agg(v, ',' ORDER BY r) AS examples FROM r WHERE r <= 5 GROUP BY event_type""")
def json_examples_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = profile.cells(table(spark, sf_dir, "events"), ["event_type", "event_id"], "props")
    return profile.examples(long, ["event_id"], ["event_type"]).select("event_type", F.array_join("examples", ",").alias("examples"))


@query("""
SELECT p_partkey, array_to_string(regexp_extract_all(lower(regexp_replace(p_name || 'Type' || p_type, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+'), ' ') AS tokens FROM part""")
def name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.name_tokens(F.concat("p_name", F.lit("Type"), "p_type")), " ").alias("tokens"))


@query("""
SELECT CAST(o_orderkey % 3 AS BIGINT) AS style, count(*) AS n_docs, min(o_orderkey) AS first_doc, CAST(6 AS BIGINT) AS n_paths
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def shape_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = profile.signatures(profile.cells(order_records(spark, sf_dir), ["o_orderkey"], "record"), "o_orderkey")
    return profile.clusters(signed, "o_orderkey").select((F.col("first_doc") % 3).alias("style"), "n_docs", "first_doc", F.size("paths").cast("long").alias("n_paths"))


@query("""
WITH w(w) AS (VALUES ('blot'), ('widgit'), ('bracket'), ('gears'), ('screw'), ('gate')),
n AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS name FROM part),
d AS (SELECT name, w, levenshtein(name, w) AS d, greatest(1, length(w) // 4) AS b FROM n, w WHERE abs(length(name) - length(w)) <= 2 AND length(w) >= 3)
SELECT name, w AS word, round(0.80 + (1 - (d - 1) * 1.0 / b) * 0.06, 6) AS score FROM d WHERE d > 0 AND d <= b""")
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.sql("SELECT * FROM VALUES ('blot'), ('widgit'), ('bracket'), ('gears'), ('screw'), ('gate') AS t(word)")
    names = table(spark, sf_dir, "part").select(F.split("p_name", " ")[1].alias("name")).distinct()
    near = names.select("name", F.explode(F.sequence(F.length("name") - 2, F.length("name") + 2)).alias("n")).join(F.broadcast(words.withColumn("n", F.length("word"))), "n")
    return near.select("name", "word", _r(alignment.fuzzy_score(F.array("name"), F.array("word"))).alias("score")).where("score IS NOT NULL")


MESSY = "CASE CAST(l_linenumber % 4 AS INT) WHEN 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) WHEN 1 THEN ' 1,' || CAST(l_orderkey + 100 AS VARCHAR) WHEN 2 THEN CAST(l_orderkey AS VARCHAR) || CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN '.5' WHEN 1 THEN '.0' ELSE 'e2' END ELSE 'n/a' END"


@query(f"""
WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, {MESSY} AS raw FROM lineitem), c AS (SELECT *, replace(trim(raw), ',', '') AS p FROM m)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN TRY_CAST(p AS DOUBLE) = floor(TRY_CAST(p AS DOUBLE)) THEN CAST(TRY_CAST(p AS DOUBLE) AS BIGINT) END AS as_integer, round(TRY_CAST(p AS DOUBLE), 6) AS as_number FROM c""")
def cast_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.expr(MESSY.replace("VARCHAR", "STRING")).alias("raw"))
    return raw.select("l_orderkey", "l_linenumber", "l_partkey", convert.cast_number(F.col("raw"), True).alias("as_integer"), _r(convert.cast_number(F.col("raw"), False)).alias("as_number"))


@query("""
SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 5 = 3 AND day(o_orderdate) <= 12 THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) ELSE o_orderdate::DATE END, '%Y-%m-%d') AS iso,
 strftime(o_orderdate, '%Y') AS year FROM orders""")
def parse_date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five notations; month first is taken for day first where it can be."""
    o, d = table(spark, sf_dir, "orders"), F.col("o_orderdate")
    forms = ["yyyy-MM-dd", "yyyy/MM/dd", "d/M/yyyy", "M/d/yyyy", "MMMM d, yyyy"]
    raw = F.coalesce(*[F.when(F.col("o_orderkey") % 5 == k, F.date_format(d, f)) for k, f in enumerate(forms)])
    return o.select("o_orderkey", convert.parse_date(raw).alias("iso"), convert.parse_date(raw, True).alias("year"))


@query("""
SELECT c_custkey, CASE c_mktsegment WHEN 'FURNITURE' THEN 'Home' WHEN 'HOUSEHOLD' THEN 'Home' WHEN 'MACHINERY' THEN 'MACHINERY' WHEN 'BUILDING' THEN 'BUILDING' END AS segment FROM customer""")
def enum_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", convert.coerce_enum(F.col("c_mktsegment"), ["Home", "MACHINERY", "BUILDING"], {"FURNITURE": "Home", "HOUSEHOLD": "Home"}).alias("segment"))


@query("""
SELECT p_partkey, array_to_string([x for x in list_transform(regexp_split_to_array(replace(p_name, ' ', ' ; ') || ',/' || p_brand, '[;,/|]'), lambda x: trim(x)) if x <> ''], '|') AS parts FROM part""")
def split_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.replace("p_name", F.lit(" "), F.lit(" ; ")), F.lit(",/"), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(convert.split_list(raw), "|").alias("parts"))


LINE_FIELDS = [Target("l_quantity", ["number"], True, minimum=1, maximum=40), Target("l_returnflag", ["string"], True, enum=["A", "N"]), Target("l_shipdate_text", ["string"], pattern=r"^\d{4}-0")]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate_text"))
    return li.withColumn("issues", alignment.issues(LINE_FIELDS, [f.name for f in LINE_FIELDS]))


@query("""
WITH i AS (SELECT 'range:l_quantity' AS issue FROM lineitem WHERE l_quantity < 1 OR l_quantity > 40 UNION ALL
 SELECT 'enum:l_returnflag' FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') UNION ALL
 SELECT 'pattern:l_shipdate_text' FROM lineitem WHERE month(l_shipdate) >= 10)
SELECT issue, count(*) AS n FROM i GROUP BY issue""")
def validate_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(F.explode("issues").alias("i")).groupBy(F.concat("i.kind", F.lit(":"), "i.target").alias("issue")).agg(F.count("*").alias("n"))


@query("""
SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS l_quantity FROM lineitem
WHERE l_quantity BETWEEN 1 AND 40 AND l_returnflag IN ('A', 'N') AND month(l_shipdate) < 10""")
def conformance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where(F.size("issues") == 0).select("l_orderkey", "l_linenumber", _r("l_quantity").alias("l_quantity"))


@query("""
WITH m AS (SELECT c_nationkey, c_mktsegment AS target, c_mktsegment IN ('FURNITURE', 'MACHINERY') AS required, bool_or(c_acctbal > 9000) AS mapped FROM customer GROUP BY ALL),
c AS (SELECT c_nationkey, round(avg(mapped::INT), 6) AS coverage, round(avg(CASE WHEN required THEN mapped::INT END), 6) AS required_coverage, count(*) FILTER (required AND mapped) AS required_mapped FROM m GROUP BY 1)
SELECT *, CASE WHEN required_coverage IS NOT NULL AND required_mapped = 0 THEN 'reject' WHEN coalesce(required_coverage, coverage) < 0.5 THEN 'reject' WHEN coalesce(required_coverage, coverage) < 0.7 THEN 'review' ELSE 'convertible' END AS verdict FROM c""")
def relevance_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "customer").groupBy("c_nationkey", F.col("c_mktsegment").alias("target")).agg(F.when(F.max(F.col("c_acctbal") > 9000), "mapped").otherwise("needs_review").alias("status"))
    c = alignment.coverage(m.withColumn("required", F.col("target").isin("FURNITURE", "MACHINERY")), ["c_nationkey"])
    return c.withColumn("verdict", alignment.relevance(F.col("required_coverage"), F.col("coverage"), F.col("required_mapped")))


@query("""
WITH f AS (SELECT floor((day(ts) - 1) / 7)::INT AS week, avg((value > 300 AND week = 0 OR value > 20)::INT) AS high, avg((event_type <> 'error' AND (week < 2 OR event_id % 2 = 0))::INT) AS kind FROM events GROUP BY 1),
l AS (SELECT week, 'high' AS target, high AS rate FROM f UNION ALL SELECT week, 'kind', kind FROM f)
SELECT n.week AS week, b.target, round(b.rate, 6) AS was, round(n.rate, 6) AS now FROM l b JOIN l n ON b.target = n.target AND b.week = 0 AND n.week > 0 WHERE b.rate - n.rate > 0.25""")
def fill_rate_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("week", F.floor((F.dayofmonth("ts") - 1) / 7).cast("int"))
    golden = e.select("week", F.when((F.col("value") > 300) & (F.col("week") == 0) | (F.col("value") > 20), 1).alias("high"), F.when((F.col("event_type") != "error") & ((F.col("week") < 2) | (F.col("event_id") % 2 == 0)), 1).alias("kind"))
    rates = alignment.fill_rates(golden, ["high", "kind"], ["week"])
    was = rates.where("week = 0").select("target", F.col("rate").alias("was"))
    return rates.where("week > 0").join(F.broadcast(was), "target").where("was - rate > 0.25").select("week", "target", _r("was").alias("was"), _r("rate").alias("now"))


SHAPES = "SELECT c_nationkey AS shape, list_sort(list(DISTINCT c_mktsegment || (c_custkey % 4)::VARCHAR)) AS paths FROM customer GROUP BY 1"


def _shapes(spark: SparkSession, sf_dir: str, parity: int) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("shape")).agg(F.array_sort(F.collect_set(F.concat("c_mktsegment", (F.col("c_custkey") % 4).cast("string")))).alias("paths"))
    return c.where(F.col("shape") % 2 == parity)


@query(f"""
WITH s AS ({SHAPES}), j AS (SELECT a.shape, b.shape AS profile_id, round(len(list_intersect(a.paths, b.paths)) * 1.0 / len(list_distinct(a.paths || b.paths)), 6) AS jaccard
FROM s a JOIN s b ON a.shape % 2 = 0 AND b.shape % 2 = 1)
SELECT shape, max(profile_id) AS profile_id, jaccard FROM j WHERE jaccard = (SELECT max(jaccard) FROM j k WHERE k.shape = j.shape) AND jaccard > 0 GROUP BY shape, jaccard""")
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.best_match(_shapes(spark, sf_dir, 0), _shapes(spark, sf_dir, 1).withColumnRenamed("shape", "profile_id"))


@query(f"""
WITH s AS ({SHAPES}), j AS (SELECT a.shape AS a, b.shape AS b, len(list_intersect(a.paths, b.paths)) * 1.0 / len(list_distinct(a.paths || b.paths)) AS j FROM s a JOIN s b ON b.shape = a.shape + 1)
SELECT a, b, round(j, 6) AS jaccard, CASE WHEN j >= 0.95 THEN 'high' WHEN j >= 0.6 THEN 'moderate' WHEN j > 0 THEN 'low' ELSE 'none' END AS band FROM j""")
def signature_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _shapes(spark, sf_dir, 0).unionByName(_shapes(spark, sf_dir, 1))
    pairs = s.select(F.col("shape").alias("a"), F.col("paths").alias("pa"), (F.col("shape") + 1).alias("b")).join(s.select(F.col("shape").alias("b"), F.col("paths").alias("pb")), "b")
    j, band = profile.compare(F.col("pa"), F.col("pb"))
    return pairs.select("a", "b", _r(j).alias("jaccard"), band.alias("band"))


@query("""
WITH c AS (SELECT c_custkey, CASE c_custkey % 17 WHEN 0 THEN 'high' WHEN 1 THEN 'moderate' WHEN 2 THEN 'low' END AS rejected, CASE c_custkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'moderate' WHEN 2 THEN 'low' END AS approved,
 c_acctbal < 0 AS drifted, CASE WHEN c_acctbal > 6000 THEN 'convertible' WHEN c_acctbal > 3000 THEN 'review' ELSE 'reject' END AS verdict, c_nationkey % 2 AS required, c_nationkey % 3 = 0 AS research FROM customer)
SELECT research, CASE WHEN rejected IN ('high', 'moderate') THEN 'declined' WHEN approved = 'high' AND NOT drifted THEN 'replay_clean' WHEN approved IN ('high', 'moderate') THEN 'drift_repair'
 WHEN verdict = 'review' THEN 'review' WHEN verdict = 'convertible' THEN CASE WHEN research THEN 'novel_research' ELSE 'review' END WHEN research AND required > 0 THEN 'novel_research' ELSE 'reject_irrelevant' END AS pathway, count(*) AS n_docs FROM c GROUP BY ALL""")
def pathway_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    band = lambda k: F.when(k == 0, "high").when(k == 1, "moderate").when(k == 2, "low")
    verdict = F.when(F.col("c_acctbal") > 6000, "convertible").when(F.col("c_acctbal") > 3000, "review").otherwise("reject")
    ways = [alignment.pathway(band(F.col("c_custkey") % 17), band(F.col("c_custkey") % 4), F.col("c_acctbal") < 0, verdict, F.col("c_nationkey") % 2, on) for on in (True, False)]
    research = F.col("c_nationkey") % 3 == 0
    return c.groupBy(research.alias("research"), F.when(research, ways[0]).otherwise(ways[1]).alias("pathway")).agg(F.count("*").alias("n_docs"))


@query("""
WITH l AS (SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment)) AS v FROM customer GROUP BY 1)
SELECT c_nationkey, CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE array_to_string(['MACHINERY', 'Other'] || [x for x in v if x <> 'MACHINERY'], ',') END AS vocabulary FROM l""")
def vocab_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("v"))
    merged = library.merged_values(F.array(F.lit("MACHINERY"), F.lit("Other")), F.col("v"), F.col("c_nationkey") % 5 == 0)
    return learned.select("c_nationkey", F.array_join(merged, ",").alias("vocabulary"))


ACTIONS = {"signup": "register", "view": "approve", "click": "restore", "purchase": "retire", "error": "reject"}


@query("""
SELECT user_id, CASE max_by(event_type, (ts, event_id)) WHEN 'view' THEN 'approved' WHEN 'purchase' THEN 'retired' WHEN 'error' THEN 'rejected' ELSE 'provisional' END AS state, count(*) FILTER (event_type = 'signup') AS version FROM events GROUP BY user_id""")
def library_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    act = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.try_element_at(act, F.col("event_type")).alias("action"))
    return library.current(e, "user_id", ["ts", "event_id"], "action")


@query("""
SELECT event_type, event_id, total FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r, count(*) OVER (PARTITION BY event_type) AS total FROM events) WHERE r <= 200""")
def shape_sample_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.capped(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], ["event_id"])


@query("""
SELECT c_custkey, CASE WHEN r = 1 THEN s ELSE s || '_' || r END AS stored FROM (SELECT c_custkey, lower(c_mktsegment) AS s, row_number() OVER (PARTITION BY lower(c_mktsegment) ORDER BY c_custkey) AS r FROM customer)""")
def output_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_mktsegment").alias("stem"))
    return library.distinct_stems(c, "stem", ["c_custkey"]).select("c_custkey", "stored")


HASHED = """
{0}w AS (SELECT {1}, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM {2}),
{0}s AS (SELECT {1}, ('0x' || substr(md5(t), 31, 2))::INT AS slot, sum(CASE WHEN ('0x' || substr(md5(t), 30, 1))::INT % 2 = 1 THEN 1 ELSE -1 END) AS v FROM {0}w GROUP BY ALL),
{0}n AS (SELECT {1}, sqrt(sum(v * v)) AS n FROM {0}s GROUP BY 1),
{0}v AS (SELECT {0}s.{1}, slot, v / n AS value FROM {0}s JOIN {0}n USING ({1}) WHERE n > 0 AND v <> 0)"""
COSINE = f"WITH {HASHED.format('d', 'doc_id', 'documents')}, {HASHED.format('q', 'item_id', '(SELECT * FROM benchmark WHERE item_id % 50 = 0)')}, c AS (SELECT item_id, doc_id, round(sum(dv.value * qv.value), 9) AS cosine FROM dv JOIN qv USING (slot) GROUP BY ALL)"


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").where("item_id % 50 = 0")


def _cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.cosine(retrieval.hashed(table(spark, sf_dir, "documents"), "doc_id", "text"), retrieval.hashed(_queries(spark, sf_dir), "item_id", "text"), "doc_id", "item_id")


@query(COSINE + " SELECT item_id, doc_id, round(cosine, 6) AS cosine FROM c")
def hash_embed_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cosine(spark, sf_dir).select("item_id", "doc_id", _r("cosine").alias("cosine"))


LEXICAL = """qt AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM benchmark WHERE item_id % 50 = 0),
dt AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM documents),
lx AS (SELECT item_id, doc_id, round(count(*) * 1.0 / max(n), 6) AS overlap FROM qt JOIN dt USING (t) JOIN (SELECT item_id, count(*) AS n FROM qt GROUP BY 1) USING (item_id) GROUP BY ALL)"""


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _queries(spark, sf_dir).select("item_id", F.array_distinct(text.tokens(F.col("text"))).alias("q")).select("item_id", F.size("q").alias("n"), F.explode("q").alias("t"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("t"))
    return d.join(q, "t").groupBy("item_id", "doc_id").agg(_r(F.count("*") / F.first("n")).alias("overlap"))


@query(f"WITH {LEXICAL} SELECT * FROM lx")
def lexical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir)


@query(COSINE + f""", {LEXICAL}, rl AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS rl FROM lx WHERE overlap > 0),
rv AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, doc_id) AS rv FROM c),
f AS (SELECT item_id, doc_id, round(coalesce(1.0 / (60 + rl), 0) + coalesce(1.0 / (60 + rv), 0), 9) AS score FROM rl FULL JOIN rv USING (item_id, doc_id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM f) WHERE rank <= 10""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fuse(_lexical(spark, sf_dir), _cosine(spark, sf_dir), ["item_id"], "doc_id", "overlap", "cosine")


TOPK = """p AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score, a.label AS la, b.label AS lb FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)"""


@query(f"WITH {TOPK} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM k WHERE rank <= 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.vector_topk(table(spark, sf_dir, "embeddings"), 50).withColumn("score", _r("score"))


@query(f"""WITH {TOPK}, g AS (SELECT query_id, rank, (la = lb)::INT AS rel, sum((la = lb)::INT) OVER (PARTITION BY query_id) AS total FROM k),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS ideal FROM g WHERE rank <= 10 AND total > 0),
q AS (SELECT query_id, sum(rel) * 1.0 / least(max(total), 10) AS recall, coalesce(max(CASE WHEN rel > 0 THEN 1.0 / rank END), 0) AS rr, CASE WHEN sum(rel / log2(ideal + 1)) > 0 THEN sum(rel / log2(rank + 1)) / sum(rel / log2(ideal + 1)) ELSE 0 END AS ndcg FROM t GROUP BY 1)
SELECT count(*) AS n_queries, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM q""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    top = retrieval.vector_topk(e, 50)
    a, b = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("la")), e.select("vec_id", F.col("label").alias("lb"))
    totals = e.groupBy(F.col("label").alias("la")).agg(F.count("*").alias("same"))
    ranked = top.join(a, "query_id").join(b, "vec_id").join(totals, "la").select("query_id", "rank", (F.col("la") == F.col("lb")).cast("int").alias("relevant"), (F.col("same") - 1).alias("total"))
    return retrieval.ranking_metrics(ranked, "query_id", 10)


@query("""
WITH h AS (SELECT doc_id, sha256(text) AS sha256 FROM documents) SELECT doc_id, sha256, nullif(min(doc_id) OVER (PARTITION BY sha256), doc_id) AS duplicate_of FROM h""")
def dedupe_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""
SELECT d.doc_id, d.lang, d.source, count(l.doc_id) AS n_supplementals FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND (l.toxic = 1 OR l.quality = 0) GROUP BY ALL""")
def doc_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = table(spark, sf_dir, "labels").select(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), F.col("doc_id")).alias("target"))
    return reports.report(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), more, "doc_id", ["source", "doc_id"])


def _found(words: list[str]) -> str:
    return " + ".join(f"contains(lower(text), '{w}')::INT" for w in words)


@query(f"""
WITH b AS (SELECT ({_found(text.NEGATIVE)}) - ({_found(text.POSITIVE)}) AS b FROM conversations)
SELECT CASE WHEN b > 0 THEN 'negative' WHEN b < 0 THEN 'positive' ELSE 'neutral' END AS sentiment, count(*) AS n FROM b GROUP BY 1""")
def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy(text.sentiment(F.col("text")).alias("sentiment")).agg(F.count("*").alias("n"))


@query()
def chunk_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.chunks(files.blocks(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


@query("""
WITH l AS (SELECT conv_id, turn, text, CASE WHEN length(text) < 200 THEN text END AS head FROM conversations)
SELECT conv_id, turn, last_value(head IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM l""")
def section_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(F.when(F.length("text") < 200, F.col("text")), True).over(w).alias("section"))


@query("""
SELECT doc_id, count(*) AS n_blocks FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY 1""")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.blocks(table(spark, sf_dir, "documents"), "doc_id", "text", F.lit(False)).groupBy("doc_id").agg(F.count("*").alias("n_blocks"))


@query("SELECT conv_id, turn, role FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id, role) AS m FROM conversations) WHERE turn = m")
def latest_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "role").alias("t"), "conv_id", "turn", "role")
    return reconcile.latest_round(c, "t", "turn").select("conv_id", "turn", "role")


@query("""
WITH r AS (SELECT unnest(generate_series(0, (SELECT max(turn) FROM conversations))) AS r), s AS (SELECT r, conv_id, turn, max(turn) OVER (PARTITION BY r, conv_id) AS m FROM conversations JOIN r ON turn <= r)
SELECT r, count(*) AS n_in_force, sum(turn)::BIGINT AS turns FROM s WHERE turn = m GROUP BY r""")
def converge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.rounds(table(spark, sf_dir, "conversations"), "conv_id", "turn").groupBy("r").agg(F.count("*").alias("n_in_force"), F.sum("turn").alias("turns"))


PROPOSED = "(SELECT conv_id AS unit, list(DISTINCT role) AS candidates, first(role ORDER BY turn::VARCHAR) AS one FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations) WHERE turn >= m - unit_rounds GROUP BY 1)".replace("unit_rounds", "conv_id % 2")
RESOLVED = f"""
WITH u AS (SELECT doc_id AS unit, CASE WHEN doc_id % 4 <> 1 THEN CASE doc_id % 3 WHEN 0 THEN ' User ' ELSE lang END END AS draft, CASE doc_id % 7 WHEN 0 THEN lang WHEN 3 THEN 'user' END AS fact FROM documents),
j AS (SELECT unit, coalesce(draft, '') AS draft, fact, coalesce(len(candidates), 0) AS n_candidates, one FROM u LEFT JOIN {PROPOSED} USING (unit)),
s AS (SELECT unit, n_candidates, CASE WHEN n_candidates > 1 THEN NULL ELSE coalesce(fact, one, nullif(draft, '')) END AS value,
 CASE WHEN n_candidates > 1 THEN 'conflict' WHEN fact IS NOT NULL THEN CASE WHEN draft = '' THEN 'filled' WHEN lower(trim(draft)) <> lower(trim(fact)) THEN 'corrected' ELSE 'unchanged' END
 WHEN n_candidates = 1 THEN CASE WHEN draft = '' THEN 'filled' ELSE 'corrected' END ELSE 'needs_review' END AS status FROM j)"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    units = table(spark, sf_dir, "documents").select(d.alias("unit"), F.when(d % 4 != 1, F.when(d % 3 == 0, " User ").otherwise(F.col("lang"))).alias("draft"), F.when(d % 7 == 0, F.col("lang")).when(d % 7 == 3, "user").alias("fact"))
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("unit"), "turn", "role", F.max("turn").over(Window.partitionBy("conv_id")).alias("m")).where("turn >= m - unit % 2")
    return reconcile.resolve_units(units, c, "unit", "draft", "fact", "role", "turn").select("unit", "n_candidates", "value", "status")


@query(RESOLVED + " SELECT * FROM s")
def resolve_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)


@query(RESOLVED + " SELECT status, count(*) AS n FROM s GROUP BY status")
def status_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.tally(_resolved(spark, sf_dir))


@query(RESOLVED + " SELECT unit, n_candidates FROM s WHERE status = 'conflict'")
def conflict_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).where("status = 'conflict'").select("unit", "n_candidates")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn)::INT AS number FROM conversations")
def number_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.number(table(spark, sf_dir, "conversations"), ["conv_id", "role"], ["turn"]).select("conv_id", "turn", "number")


@query("""
WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS number FROM conversations WHERE role = 'user')
SELECT c.conv_id, c.turn, number, CASE WHEN number IS NULL THEN 'needs_review' ELSE 'resolved' END AS status FROM conversations c LEFT JOIN n USING (conv_id, turn)""")
def xref_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    numbered = reconcile.number(c.where("role = 'user'"), ["conv_id"], ["turn"]).select("conv_id", "turn", "number")
    return reconcile.resolve_references(c.select("conv_id", "turn"), numbered, ["conv_id", "turn"])


@query("""
WITH c AS (SELECT source, lang AS value, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY ALL)
SELECT source, value, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, f) AS r FROM c) WHERE r = 1""")
def dominant_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.dominant(table(spark, sf_dir, "documents").select("source", F.col("lang").alias("value"), "doc_id"), ["source"], "value", "doc_id")


@query("""
SELECT source AS area, doc_id AS idx, lang AS found, CASE source WHEN 'src0' THEN 'en' WHEN 'src1' THEN 'fr' ELSE 'de' END AS expected FROM documents WHERE source IN ('src0', 'src1', 'src2') AND lang <> CASE source WHEN 'src0' THEN 'en' WHEN 'src1' THEN 'fr' ELSE 'de' END""")
def inspect_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES ('src0', 'lang', 'en'), ('src1', 'lang', 'fr'), ('src2', 'lang', 'de') AS r(area, attr, value)")
    seen = table(spark, sf_dir, "documents").select(F.col("source").alias("area"), F.lit("lang").alias("attr"), F.col("doc_id").alias("idx"), F.col("lang").alias("value"))
    return layout.violations(rules, seen).select("area", "idx", "found", "expected")


BOXES = "SELECT l_orderkey AS page, l_partkey * 10 + l_linenumber AS box_id, l_quantity * 10 AS x0, l_quantity * 10 + 60 AS x1, l_extendedprice / 200 AS top, l_extendedprice / 200 + 80 AS bottom, l_linenumber FROM lineitem"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("box_id"), (F.col("l_quantity") * 10).alias("x0"), (F.col("l_quantity") * 10 + 60).alias("x1"), (F.col("l_extendedprice") / 200).alias("top"), (F.col("l_extendedprice") / 200 + 80).alias("bottom"), "l_linenumber")


@query(f"""
WITH b AS ({BOXES}), j AS (SELECT a.page, a.box_id, c.box_id AS caption_id, abs(c.top - a.top) AS d FROM b a JOIN b c ON a.page = c.page AND a.l_linenumber % 2 = 1 AND c.l_linenumber % 2 = 0)
SELECT page, box_id, caption_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY page, box_id ORDER BY d, caption_id) AS r FROM j) WHERE r = 1""")
def nearest_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    captions = b.where("l_linenumber % 2 = 0").select("page", F.col("box_id").alias("caption_id"), F.col("top").alias("caption_top"))
    return layout.nearest(b.where("l_linenumber % 2 = 1"), captions)


@query(f"""
WITH b AS ({BOXES}) SELECT page, box_id FROM b a WHERE l_linenumber % 2 = 1 AND NOT EXISTS (SELECT 1 FROM b c WHERE c.page = a.page AND c.l_linenumber % 2 = 0 AND a.x0 < c.x1 AND c.x0 < a.x1 AND a.top < c.bottom AND c.top < a.bottom)""")
def anti_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    return layout.not_overlapping(b.where("l_linenumber % 2 = 1"), b.where("l_linenumber % 2 = 0")).select("page", "box_id")


@query("""
SELECT l_orderkey % 100 AS page, round_even(l_quantity / 3.0, 0)::BIGINT AS line, count(*) AS n_words, min(l_linenumber) AS x0 FROM lineitem GROUP BY ALL""")
def line_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("page"), F.col("l_linenumber").alias("x0"), F.col("l_linenumber").alias("x1"), F.col("l_quantity").alias("top"), F.col("l_quantity").alias("bottom"), F.lit("w").alias("word"))
    return layout.lines(words).select("page", "line", F.size(F.split("text", " ")).cast("long").alias("n_words"), "x0")


@query("SELECT props->>'$.k' AS project, event_type, count(*) AS n FROM events WHERE props->>'$.k' IS NOT NULL GROUP BY ALL")
def job_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.job_counts(table(spark, sf_dir, "events"), "props", "event_type", "$.k")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('signup', 'view') ORDER BY value DESC, ts, event_id LIMIT 1")
def job_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.claim(table(spark, sf_dir, "events"), "event_type", ["signup", "view"], [F.desc("value"), "ts", "event_id"]).select("event_id", "event_type")


@query("""
WITH b AS (SELECT quality, count(*) FILTER (doc_id % 5 = 0 AND toxic = 1) AS tp, count(*) FILTER (doc_id % 5 = 0 AND toxic = 0) AS fp, count(*) FILTER (doc_id % 5 <> 0 AND toxic = 1) AS fn FROM labels GROUP BY 1),
p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp * 1.0 / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fn) END AS r FROM b)
SELECT quality, tp, fp, fn, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM p""")
def schema_match_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return scoring.precision_recall(labels.where("doc_id % 5 = 0"), labels.where("toxic = 1"), ["doc_id"], ["quality"])


@query("SELECT o_orderpriority AS category, count(*) AS n, round(avg((o_orderstatus = 'F')::INT), 6) AS accuracy FROM orders GROUP BY ROLLUP (o_orderpriority)")
def normalization_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category"), (F.col("o_orderstatus") == "F").alias("correct"))
    return scoring.accuracy(cases, "category", "correct")


@query("""
SELECT o_custkey % 2 = 0 AS resolvable, count(*) AS n FROM (SELECT o_custkey FROM orders SEMI JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON o_custkey = c_custkey UNION ALL SELECT o_custkey FROM orders ANTI JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON o_custkey = c_custkey) GROUP BY 1""")
def target_resolvable(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_custkey % 2 = 0")
    on = F.col("o_custkey") == F.col("c_custkey")
    both = o.join(c, on, "left_semi").withColumn("resolvable", F.lit(True)).unionByName(o.join(c, on, "left_anti").withColumn("resolvable", F.lit(False)))
    return both.groupBy("resolvable").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, max_by(l_returnflag, (l_linenumber, l_partkey, l_suppkey)) AS section FROM lineitem GROUP BY 1")
def graphics_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.last_placement(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "l_returnflag").withColumnRenamed("l_returnflag", "section")


@query("""
SELECT page_id, CASE WHEN regexp_matches(lower(regexp_extract(regexp_replace(url, '[?#].*', ''), '\\.([A-Za-z0-9]+)$', 1)), '^(md|markdown)$') THEN 'markdown' ELSE 'text' END AS parser FROM pages""")
def route_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", files.route(F.regexp_replace("url", "[?#].*", "")).alias("parser"))


@query("""
WITH v AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN '' WHEN 1 THEN replace(right(text, 20), ' ', '  ') ELSE role || '  ' || turn END AS value FROM conversations),
n AS (SELECT c.conv_id, c.turn, trim(regexp_replace(lower(v.value), '\\s+', ' ', 'g')) AS v, trim(regexp_replace(lower(p.text), '\\s+', ' ', 'g')) AS t FROM conversations c JOIN v USING (conv_id, turn) LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = 0)
SELECT conv_id, turn, v = '' OR coalesce(contains(t, v), false) AS grounded FROM n""")
def grounded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each turn in the first turn's text: an empty one, its own end with wider blanks, and one that is made up."""
    c = table(spark, sf_dir, "conversations")
    value = F.when(F.col("conv_id") % 3 == 0, "").when(F.col("conv_id") % 3 == 1, F.replace(F.right("text", F.lit(20)), F.lit(" "), F.lit("  "))).otherwise(F.concat("role", F.lit("  "), F.col("turn").cast("string")))
    first = c.where("turn = 0").select("conv_id", F.col("text").alias("corpus"))
    return c.select("conv_id", "turn", value.alias("value")).join(first, "conv_id", "left").select("conv_id", "turn", F.coalesce(reconcile.grounded(F.col("value"), F.col("corpus")), F.lit(False)).alias("grounded"))


@query("""
WITH c AS (SELECT turn, count(*) FILTER (role = 'user') AS open FROM conversations GROUP BY 1)
SELECT turn, open, coalesce(open < lag(open) OVER (ORDER BY turn), true) AS progressed FROM c""")
def round_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "conversations").groupBy("turn").agg(F.count_if(F.col("role") == "user").alias("open"))
    return reconcile.progress(counts, "turn", "open")


@query("""
SELECT event_id, CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'unknown_operation' WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'empty_value' END AS reason FROM events""")
def correction_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_id") % 2 == 1, F.lit("x")).alias("new_value"))
    return reconcile.valid_operations(ops, "event_type", "new_value", ["view", "click", "purchase"], ["purchase"]).select("event_id", "reason")


@query("""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'failed' WHEN doc_id % 3 = 0 THEN 'completed' WHEN doc_id % 2 = 0 THEN 'processing' ELSE 'pending' END AS status FROM documents""")
def overall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    second = F.when(d % 3 == 0, "skipped").when(d % 2 == 0, "processing").otherwise("pending")
    stages = F.when(d % 7 == 1, F.filter(F.array(F.when(d % 5 == 0, "failed").when(d % 3 == 0, "completed").when(d % 2 == 0, "processing")), lambda x: x.isNotNull()))
    stages = stages.otherwise(F.array(F.when(d % 5 == 0, "failed").otherwise("completed"), second))
    return table(spark, sf_dir, "documents").select("doc_id", reports.overall_status(stages).alias("status"))


from concord.plans import alignment_queries, edit_queries, intake_queries, layout_queries, library_queries, reconcile_queries, state_queries  # noqa: E402, F401  they list more queries

_PARTS = ["resolve_units", "reconcile_tables", "reconcile_graphics", "page_furniture"]


@query("WITH u AS (" + " UNION ALL ".join(f"SELECT status FROM ({ORACLE[p]})" for p in _PARTS) + ") SELECT status, count(*) AS n FROM u GROUP BY 1 UNION ALL SELECT 'total_units', count(*) FROM u")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole report: fields, tables, figures and page elements as units, tallied."""
    return reconcile.summary(reconcile.report({p: QUERIES[p](spark, sf_dir) for p in _PARTS}))
