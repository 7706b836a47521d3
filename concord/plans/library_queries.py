"""Queries of sources, sinks, library actions and streaming over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions.convert import Target
from concord.operators import library
from concord.plans.registry import query, table
from concord.plans.storage import cut, shared_dir
from concord.sources import files, sinks
from concord.streaming import align as streaming


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""
WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders) SELECT o_orderkey::VARCHAR AS doc_id, o_orderstatus AS status, round(o_totalprice, 2) AS price FROM o""")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as JSON lines and read again by the JSON source."""
    path = scratch(spark, "report")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.round("o_totalprice", 2).alias("price"))
    sinks.json_report(o).write.text(path)
    back = spark.read.text(path).select(F.from_json("value", "o_orderkey long, status string, price double").alias("r"))
    return back.select(F.col("r.o_orderkey").cast("string").alias("doc_id"), "r.status", "r.price")


@query("""
WITH u AS (SELECT c_nationkey, c_mktsegment AS heading, c_custkey, CASE c_custkey % 3 WHEN 0 THEN '- c' || c_custkey || ': [conflict]' WHEN 1 THEN '- c' || c_custkey || ': [needs review]' ELSE '- c' || c_custkey || ': ' || c_name END AS line FROM customer),
g AS (SELECT c_nationkey, heading, string_agg(line, chr(10) ORDER BY c_custkey) AS body FROM u GROUP BY c_nationkey, heading), s AS (SELECT c_nationkey, heading, '## ' || heading || chr(10) || chr(10) || body AS t FROM g)
SELECT c_nationkey AS report, string_agg(t, chr(10) || chr(10) ORDER BY heading) AS markdown FROM s GROUP BY 1""")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    units = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("report"), F.ascii("c_mktsegment").alias("section_ord"), F.col("c_mktsegment").alias("heading"), F.col("c_custkey").alias("unit_ord"), F.concat(F.lit("c"), "c_custkey").alias("key"), F.col("c_name").alias("value"), F.when(k == 0, "conflict").when(k == 1, "needs_review").otherwise("filled").alias("status"))
    return sinks.markdown_report(units, "report")


@query("""
SELECT o_orderpriority AS doc, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'second' ELSE 'first' END AS run, count(*) AS n FROM orders GROUP BY ALL""")
def outputs_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs by document: a second run replaces only the documents it has."""
    path, o = scratch(spark, "outputs"), table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("doc"), "o_orderkey")
    sinks.write_outputs(o.withColumn("run", F.lit("first")), path, "doc", replace=True)
    sinks.write_outputs(o.where("doc IN ('1-URGENT', '2-HIGH')").withColumn("run", F.lit("second")), path, "doc", replace=False)
    return spark.read.schema("o_orderkey long, run string, doc string").json(path).groupBy("doc", "run").agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT conv_id, turn, role FROM conversations) SELECT conv_id::VARCHAR AS doc_id, turn::INT AS rec_idx, role FROM r""")
def json_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON array a file, a file a document: each record with its place."""
    path = scratch(spark, "json")
    c = table(spark, sf_dir, "conversations")
    arrays = c.groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.struct(x.role.alias("role")))).alias("value"))
    arrays.select("value", F.concat(F.lit("doc"), "conv_id").alias("name")).repartition("name").write.partitionBy("name").text(path)
    found = files.json_documents(spark, f"{path}/*/*.txt", r"name=doc([^/]+)/")
    return found.select("doc_id", "rec_idx", F.get_json_object("record", "$.role").alias("role"))


@query("""SELECT c_custkey::VARCHAR AS id, 'a "quoted", name' || chr(10) || c_name AS name FROM customer""")
def csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV with quotes, commas and line ends inside values."""
    path = scratch(spark, "csv")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit('a "quoted", name\n'), "c_name").alias("name"))
    c.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return files.csv_records(spark, path)


@query("""
SELECT d.doc_id, d.doc_id * 10 + s AS ord, CASE WHEN s = 0 THEN 'heading' ELSE 'paragraph' END AS type, CASE WHEN s = 0 THEN d.source ELSE d.lang || ' & <' || s || '>' END AS text FROM documents d, (VALUES (0), (1), (2)) t(s)""")
def office_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and PowerPoint files made by the sinks and read by the parsers."""
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", F.posexplode(F.array("source", F.concat("lang", F.lit(" & <1>")), F.concat("lang", F.lit(" & <2>")))).alias("s", "text"))
    blocks = lines.select("doc_id", F.col("s").alias("ord"), F.when(F.col("s") == 0, "heading").otherwise("paragraph").alias("type"), "text")
    made = sinks.office_files(blocks.withColumn("kind", F.when(F.col("doc_id") % 2 == 0, "docx").otherwise("pptx")), "doc_id")
    back = files.office_blocks(made.select(F.concat(F.col("doc_id").cast("string"), F.lit("."), "kind").alias("path"), "content"))
    doc = F.split("path", "[.]")[0].cast("long")
    return back.select(doc.alias("doc_id"), (doc * 10 + F.col("ord")).alias("ord"), "type", "text")


@query("""
WITH d AS (SELECT doc_id, doc_id % 5 AS bundle, text FROM documents) SELECT bundle, count(*) + 1 AS n_entries, sum(strlen(text))::BIGINT AS n_bytes FROM d GROUP BY 1""")
def zip_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a bundle in one archive with a manifest; sizes read back from the archives."""
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 5).alias("bundle"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    return sinks.bundle_sizes(sinks.bundles(d, "bundle"), "bundle")


@query("""
SELECT c_custkey, lower(c_mktsegment) || '_' || regexp_replace(c_name, '[^A-Za-z0-9_-]+', '_', 'g') || '_20240102T030405Z' AS name FROM customer""")
def download_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = F.to_timestamp(F.lit("2024-01-02 03:04:05"))
    return table(spark, sf_dir, "customer").select("c_custkey", sinks.download_name(F.lower("c_mktsegment"), F.concat(F.lit("_"), "c_name", F.lit("_")), when).alias("name"))


@query("""
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'image' WHEN page_id % 5 = 1 THEN 'pdf' WHEN page_id % 5 = 2 THEN 'markdown' WHEN page_id % 5 = 3 THEN 'text' ELSE 'docx' END AS parser FROM pages""")
def route_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parser by extension, then by MIME type, else text."""
    k = F.col("page_id") % 5
    name = F.when(k == 0, "a.PNG").when(k == 1, "upload").when(k == 2, "b.md").when(k == 3, "noname").otherwise("c.docx")
    mime = F.when(k == 1, "application/pdf").when(k == 2, "image/png").when(k == 3, "application/unknown")
    return table(spark, sf_dir, "pages").select("page_id", files.route(name, mime).alias("parser"))


@query("""
SELECT user_id AS entry, max_by(value, event_id) AS value FROM events GROUP BY 1""")
def upsert_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resolution in place of the one before, by target."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("entry"), "event_id", "value")
    half = e.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY event_id)")).first()[0]
    last = lambda x: x.groupBy("entry").agg(F.max_by("value", "event_id").alias("value"))
    return library.upsert(last(e.where(F.col("event_id") <= half)), last(e.where(F.col("event_id") > half)), ["entry"])


@query("""
SELECT o_orderkey AS rec_id, o_orderkey AS "orderId", o_orderstatus AS "orderStatus", round(o_totalprice, 2) AS "totalPrice" FROM orders""")
def align_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of records as they arrive, aligned batch by batch by one mapping, each batch written once."""
    source, out = scratch(spark, "arriving"), scratch(spark, "aligned")
    record = F.to_json(F.struct(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("order_status"), F.round("o_totalprice", 2).alias("total_price")))
    table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rec_id"), record.alias("record")).repartition(3, "rec_id").write.json(source)
    fields = [Target("orderId", ["integer"], True), Target("orderStatus", enum=["F", "O", "P"]), Target("totalPrice", ["number"])]
    streaming.align_stream(spark, source, out, f"{out}-state", fields, per_batch=1).awaitTermination()
    return cut(spark.read.parquet(f"{out}/*").select("rec_id", "orderId", "orderStatus", "totalPrice"), "streamed")


@query("""
SELECT d.doc_id, d.doc_id * 100 + s AS ord, CASE WHEN d.doc_id % 10 = 0 THEN 'needs_ocr' ELSE 'paragraph' END AS type, CASE WHEN d.doc_id % 10 = 0 THEN '' WHEN s = 0 THEN 'Source (' || d.source || ') \\ of it' ELSE d.lang || ' & line ' || s END AS text
FROM documents d, (SELECT unnest(range(60)) AS s) t WHERE d.doc_id % 10 > 0 OR s = 0""")
def pdf_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF files of two pages made by the sink and read by the parser; one with hardly any text has to be read by OCR."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    rows = d.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("ord"), "source", "lang").where("doc_id % 10 > 0 OR ord = 0")
    said = F.when(F.col("doc_id") % 10 == 0, "x").when(F.col("ord") == 0, F.concat(F.lit("Source ("), "source", F.lit(") \\ of it"))).otherwise(F.concat("lang", F.lit(" & line "), "ord"))
    made = sinks.office_files(rows.select("doc_id", "ord", F.when(F.col("ord") == 0, "heading").otherwise("paragraph").alias("type"), said.alias("text"), F.lit("pdf").alias("kind")), "doc_id")
    back = files.office_blocks(made.select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), "content"))
    doc = F.split("path", "[.]")[0].cast("long")
    return back.select(doc.alias("doc_id"), (doc * 100 + F.col("ord")).alias("ord"), "type", "text")
