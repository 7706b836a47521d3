"""Queries of extraction, reconciliation, corrections and jobs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import text
from concord.operators import extract, reconcile, reports
from concord.plans.registry import query, table


@query("""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS p FROM documents), b AS (SELECT doc_id, trim(regexp_replace(p, '\\s+', ' ', 'g')) AS b FROM p),
m AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(b, '([.!?])\\s+', '\\1\x01', 'g'), '\\s*[-•]\\s+', '\x01', 'g'), '\\s+([A-Z][a-z]+:\\s)', '\x01\\1', 'g') AS b FROM b WHERE b <> ''),
s AS (SELECT doc_id, trim(unnest(string_split(b, '\x01'))) AS s FROM m)
SELECT doc_id, count(*) AS n_sentences, max(length(s)) AS longest FROM s WHERE s <> '' GROUP BY 1""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of paragraphs: split behind terminators, at bullets, before labels."""
    chunks = extract.chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", fine=True)
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.length("text")).cast("long").alias("longest"))


_FACTS = """CASE o_orderkey % 6 WHEN 0 THEN 'The unit was running B' || o_custkey || '.3, then stopped.' WHEN 1 THEN 'Site: Ward ' || o_custkey || ' Author: J. Okafor' WHEN 2 THEN 'Updated to version 4.2.' || (o_orderkey % 9) || ' last night.'
 WHEN 3 THEN 'It began on ' || strftime(o_orderdate, '%Y-%m-%d') || ' at noon.' WHEN 4 THEN 'It lasted Four hours in all.' ELSE 'No value here' || chr(10) || 'Root cause: loose cable ' || o_orderkey || chr(10) || 'cause unknown' END"""


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, o = F.col("o_orderkey") % 6, table(spark, sf_dir, "orders")
    said = F.when(k == 0, F.concat(F.lit("The unit was running B"), "o_custkey", F.lit(".3, then stopped."))).when(k == 1, F.concat(F.lit("Site: Ward "), "o_custkey", F.lit(" Author: J. Okafor")))
    said = said.when(k == 2, F.concat(F.lit("Updated to version 4.2."), F.col("o_orderkey") % 9, F.lit(" last night."))).when(k == 3, F.concat(F.lit("It began on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" at noon.")))
    said = said.when(k == 4, "It lasted Four hours in all.").otherwise(F.concat(F.lit("No value here\nRoot cause: loose cable "), "o_orderkey", F.lit("\ncause unknown")))
    kind = F.when(k == 0, "token").when(k == 2, "version").when(k == 3, "date").when(k == 4, "duration").otherwise("line")
    hint = F.when(k == 0, "was running").when(k == 1, "Site:")
    return o.select("o_orderkey", said.alias("text"), kind.alias("extract"), F.lit("root cause").alias("query"), hint.alias("hint"))


@query(f"""
WITH t AS (SELECT o_orderkey, o_custkey, o_orderdate, {_FACTS} AS t FROM orders)
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'B' || o_custkey || '.3' WHEN 1 THEN 'Ward ' || o_custkey WHEN 2 THEN regexp_extract(t, '([0-9]+[.][0-9]+[.][0-9]+)', 1) WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 4 THEN 'four hours' ELSE 'loose cable ' || o_orderkey END AS value FROM t""")
def value_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value in a sentence by kind: token behind a hint, label, version, date, duration, best line."""
    s = _sentences(spark, sf_dir)
    return s.select("o_orderkey", extract.value_in(F.col("text"), F.col("extract"), F.col("query"), F.col("hint")).alias("value"))


@query("""
WITH h AS (SELECT conv_id, turn, role, CASE turn % 3 WHEN 0 THEN 'The fix is 1.2.' || turn WHEN 1 THEN 'only version 3.4' ELSE 'nothing of the kind' END AS text, (turn * 7 + conv_id) % 11 / 10.0 AS score FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, 't' || turn) AS r FROM h),
t AS (SELECT *, contains(lower(text), 'the') AS h FROM r WHERE r <= 8 AND (conv_id % 5 <> 0 OR role = 'user')),
k AS (SELECT *, max(h::INT) OVER (PARTITION BY conv_id) AS a FROM t), u AS (SELECT * FROM k WHERE h OR a = 0)
SELECT conv_id, 't' || min_by(turn, r) AS chunk_id, round(min_by(score, r), 3)::DOUBLE AS score, 'retrieval+version+hint' AS method FROM u WHERE regexp_matches(text, '\\b[0-9]+[.][0-9]+([.][0-9]+)?\\b') GROUP BY conv_id""")
def fact_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each query's eight best hits the first with a value: those with the hint first, those of another document never."""
    hits = table(spark, sf_dir, "conversations").select("conv_id", F.concat(F.lit("t"), "turn").alias("chunk_id"), F.col("role").alias("source_doc"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("The fix is 1.2."), "turn")).when(F.col("turn") % 3 == 1, "only version 3.4").otherwise("nothing of the kind").alias("text"), ((F.col("turn") * 7 + F.col("conv_id")) % 11 / 10).alias("score"), F.lit("version").alias("extract"), F.lit("").alias("query"), F.lit("The").alias("hint"), F.when(F.col("conv_id") % 5 == 0, "user").alias("wanted_doc"))
    return extract.facts(hits, ["conv_id"]).select("conv_id", "chunk_id", "score", "method")


@query("""
SELECT conv_id, turn, trim(text) AS body FROM conversations""")
def label_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies without the heading word or anchor in front."""
    k = F.col("turn") % 3
    said = F.when(k == 0, F.concat(F.lit(" summary  "), "text")).when(k == 1, F.concat(F.lit("Preliminary Assessment "), "text")).otherwise(F.concat("role", F.lit(" "), "text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", extract.strip_label(said, F.when(k == 2, F.upper("role"))).alias("body"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type ELSE trim(replace(CASE WHEN p_size % 3 = 1 THEN p_brand ELSE replace(p_name, ' ', '_') END, '_', ' ') || ' ' || replace(lower(p_type), '_', ' ')) END AS query FROM part""")
def field_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_size") % 3
    return p.select("p_partkey", extract.field_query(F.when(k == 0, F.col("p_type")).when(k == 1, ""), F.when(k == 1, F.col("p_brand")), F.replace("p_name", F.lit(" "), F.lit("_")), F.lower("p_type")).alias("query"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, p_name, floor(l_quantity)::INT AS q, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, floor(l_quantity)::INT::VARCHAR)::INT AS row_ord FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, row_ord, 'Item' AS label, p_name AS cell FROM l UNION ALL SELECT l_orderkey, row_ord, 'Size', q::VARCHAR FROM l UNION ALL SELECT l_orderkey, row_ord, 'Owner', 'O ' || l_suppkey FROM l WHERE l_linenumber % 2 = 1""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a block split at their marker, cells by label; a cell that isn't there is left out."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    owner = F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(F.concat(F.lit(". Owner: O "), "l_suppkey"))
    item = F.concat(F.lit("Item: "), "p_name", F.lit(". Size: "), F.floor("l_quantity").cast("string"), owner, F.lit("."))
    blocks = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", item.alias("t")))), lambda x: x.t), " ").alias("block"))
    return reconcile.table_cells(blocks, "l_orderkey", "block", "Item:", ["Item", "Size", "Owner"])


@query("""
SELECT o_orderkey AS table_id, array_to_string([x FOR x IN [CASE WHEN o_orderkey % 3 = 0 THEN 'columns' END, CASE WHEN o_orderkey % 5 = 0 THEN 'font' END, CASE WHEN o_orderkey % 7 = 0 THEN 'header_style' END] IF x IS NOT NULL], ',') AS formatting,
 CASE WHEN o_orderkey % 11 = 0 THEN 'filled' WHEN o_orderkey % 2 = 0 THEN 'corrected' ELSE 'filled' END AS status FROM orders""")
def reconcile_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatting that changes, and whether a table was filled or corrected; a missing draft is filled."""
    k, o = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    specs = o.select(k.alias("table_id"), F.array(F.lit("a"), F.lit("b")).alias("columns"), F.lit("Serif").alias("font"), F.lit("bold").alias("header_style"))
    drafts = o.select(k.alias("table_id"), F.when(k % 3 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("columns"), F.when(k % 5 == 0, "Sans").otherwise(F.when(k % 2 == 0, "").otherwise("Serif")).alias("font"), F.when(k % 7 == 0, "plain").otherwise("bold").alias("header_style"), F.when(k % 11 == 0, None).otherwise((k + 1) % 2).cast("int").alias("n_rows"))
    return reconcile.reconcile_tables(drafts, specs).select("table_id", F.array_join("formatting", ",").alias("formatting"), "status")


@query("""
WITH r AS (SELECT p_partkey AS graphic_id, p_brand AS section, p_name AS name FROM part),
m AS (SELECT graphic_id, CASE WHEN graphic_id % 4 = 3 THEN 'corrected' WHEN graphic_id % 4 = 0 THEN 'filled' WHEN graphic_id % 4 = 1 THEN 'corrected' ELSE 'unchanged' END AS status FROM r)
SELECT * FROM m""")
def reconcile_graphics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relabel before insertion before move; the last placement counts."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("graphic_id"), F.col("p_brand").alias("section"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"))
    k = F.col("graphic_id") % 4
    last = p.where(k.isin(1, 2)).select("name", F.when(k == 1, "elsewhere").otherwise(F.col("section")).alias("section"), F.lit(1).alias("ord"))
    before = p.where(k.isin(1, 2)).select("name", F.lit("draft").alias("section"), F.lit(0).alias("ord"))
    relabels = p.where(k == 3).select("section", F.col("name").alias("new_value"), F.lit("old.png").alias("old_value"))
    return reconcile.reconcile_graphics(p, last.unionByName(before), relabels).select("graphic_id", "status")


@query("""
WITH d AS (SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS header, doc_id % 3 = 0 AS numbered, CASE WHEN doc_id % 5 = 0 THEN 'SECRET' END AS mark FROM documents),
c AS (SELECT conv_id AS doc_id, count(DISTINCT role) AS n, min(role) AS one FROM conversations WHERE turn < 1 + conv_id % 2 GROUP BY 1)
SELECT doc_id, 'header' AS element, CASE WHEN header <> '' THEN 'unchanged' ELSE 'filled' END AS status, CASE WHEN header <> '' THEN header ELSE lang END AS value FROM d
UNION ALL SELECT doc_id, 'footer', 'corrected', 'Page number (added) + classification marking (still needed)' FROM d
UNION ALL SELECT doc_id, 'page_numbers', CASE WHEN numbered THEN 'unchanged' ELSE 'corrected' END, 'true' FROM d
UNION ALL SELECT doc_id, 'classification', CASE WHEN n > 1 THEN 'conflict' WHEN n = 1 THEN CASE WHEN mark IS NULL THEN 'filled' ELSE 'corrected' END ELSE 'needs_review' END, CASE WHEN n > 1 THEN NULL WHEN n = 1 THEN one ELSE mark END FROM d LEFT JOIN c USING (doc_id)""")
def page_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    drafts = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("title"), F.when(d % 2 == 0, F.col("source")).otherwise("").alias("header"), F.lit("").alias("footer"), (d % 3 == 0).alias("page_numbers"), F.when(d % 5 == 0, "SECRET").alias("classification"))
    c = table(spark, sf_dir, "conversations").where("turn < 1 + conv_id % 2").select(F.col("conv_id").alias("doc_id"), F.lit("classification").alias("element"), F.col("turn").alias("id"), F.col("role").alias("new_value"))
    return reconcile.furniture(drafts, c, "doc_id")


_FIGURES = "f AS (SELECT p_partkey AS fig, lower(p_name) AS caption FROM part), t AS (SELECT l_orderkey AS fb, 'The FIGURE is wrong: please use ' || string_agg(lower(p_name), ' and the ' ORDER BY l_linenumber, p_partkey) AS body FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <= 2 GROUP BY 1)"


@query(f"""
WITH {_FIGURES}, fw AS (SELECT DISTINCT fig, unnest(string_split_regex(caption, '[^a-z0-9]+')) AS w FROM f), tw AS (SELECT DISTINCT fb, unnest(string_split_regex(lower(body), '[^a-z0-9]+')) AS w FROM t),
s AS (SELECT fb, fig, count(*) AS shared FROM tw JOIN fw USING (w) WHERE length(w) > 1 AND w NOT IN ('the', 'and', 'is', 'wrong', 'please', 'figure') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY fb ORDER BY shared DESC, fig) AS r, lead(shared) OVER (PARTITION BY fb ORDER BY shared DESC, fig) AS next FROM s)
SELECT fb, fig, shared FROM r WHERE r = 1 AND shared >= 2 AND shared > coalesce(next, 0)""")
def ground_relabels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figure that feedback means: two content words in common at least, and more than any other."""
    p = table(spark, sf_dir, "part")
    figures = p.select(F.col("p_partkey").alias("fig"), reconcile.content_words(F.lower("p_name")).alias("w"))
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").join(p.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    said = li.groupBy(F.col("l_orderkey").alias("fb")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_partkey", F.lower("p_name").alias("n")))), lambda x: x.n), " and the ").alias("b"))
    said = said.select("fb", reconcile.content_words(F.concat(F.lit("Subject: nothing of this\nThe FIGURE is wrong: please use "), "b")).alias("w"))
    return reconcile.dominant_by_words(said, figures, "fb", "fig", "w")


@query("""
WITH f AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'The firmware version should be 4.2.' || event_id || ', not 3' WHEN 'click' THEN 'Severity should be High' WHEN 'error' THEN 'Something should be done' ELSE 'the severity is wrong' END AS t, event_type FROM events)
SELECT event_id, CASE event_type WHEN 'view' THEN 'factors.firmware_version' ELSE 'ids.severity' END AS target, CASE event_type WHEN 'view' THEN '4' ELSE 'high' END AS new_value FROM f WHERE event_type IN ('view', 'click')""")
def interpret_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offline rule: "should be X" on a target that is named; all else is left alone."""
    e = F.col("event_type")
    t = F.when(e == "view", F.concat(F.lit("The firmware version should be 4.2."), "event_id", F.lit(", not 3"))).when(e == "click", "Severity should be High").when(e == "error", "Something should be done").otherwise("the severity is wrong")
    return reconcile.interpreted(table(spark, sf_dir, "events").withColumn("t", t), ["factors.firmware_version", "ids.severity"], "t").select("event_id", "target", "new_value")


@query("""
WITH u AS (SELECT turn, CASE conv_id % 4 WHEN 0 THEN 'conflict' WHEN 1 THEN 'needs_review' ELSE 'filled' END AS status, CASE WHEN conv_id % 8 = 1 OR turn > 2 THEN 'discipline' ELSE 'value' END AS class FROM conversations)
SELECT turn, count(*) AS total_units, count(*) FILTER (status IN ('conflict', 'needs_review') AND class <> 'discipline') AS unresolved, count(*) FILTER (status IN ('conflict', 'needs_review') AND class <> 'discipline') = 0 AS converged FROM u GROUP BY turn""")
def convergence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("conv_id")
    u = table(spark, sf_dir, "conversations").select("turn", F.when(k % 4 == 0, "conflict").when(k % 4 == 1, "needs_review").otherwise("filled").alias("status"), F.when((k % 8 == 1) | (F.col("turn") > 2), "discipline").alias("defect_class"))
    return reconcile.convergence(u, ["turn"])


@query("""
WITH c AS (SELECT event_id, user_id AS target FROM events WHERE event_type = 'view'), m AS (SELECT event_id, user_id AS target FROM events WHERE event_type = 'click')
SELECT * FROM c UNION ALL SELECT * FROM m WHERE target NOT IN (SELECT target FROM c)""")
def append_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed operations are added only for targets that have none."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("target"), "event_type")
    return reconcile.append_operations(e.where("event_type = 'view'").drop("event_type"), e.where("event_type = 'click'").drop("event_type"), "target")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag || '.table' ELSE l_returnflag || '.field' END AS key, CASE WHEN l_returnflag IN ('A', 'R') THEN true ELSE false END AS known FROM lineitem""")
def target_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's cell is known by its table, every other target by itself."""
    target = F.when(F.col("l_linenumber") % 3 == 0, F.concat("l_returnflag", F.lit(".table[2].x"))).otherwise(F.concat("l_returnflag", F.lit(".field")))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", reconcile.resolvable_key(target).alias("key"))
    valid = spark.sql("SELECT * FROM VALUES ('A.table'), ('A.field'), ('R.table'), ('R.field') AS v(key)").withColumn("known", F.lit(True))
    return li.join(valid, "key", "left").select("l_orderkey", "l_linenumber", "key", F.coalesce("known", F.lit(False)).alias("known"))


@query("""
SELECT o_orderkey, CASE WHEN regexp_matches(o_orderpriority, '[0-9]') THEN regexp_replace(o_orderpriority, '^(.*)([0-9])([^0-9]*)$', '\\1') || ((regexp_extract(o_orderpriority, '^(.*)([0-9])([^0-9]*)$', 2)::INT + 1) % 10) || regexp_extract(o_orderpriority, '^(.*)([0-9])([^0-9]*)$', 3) ELSE o_orderpriority || ' (DRAFT - unverified)' END AS wrong FROM orders""")
def wrong_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.wrong_value(F.concat(F.lit(" "), "o_orderpriority")).alias("wrong"))


@query("""
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS tool FROM events""")
def tool_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), "event_type", F.lit("<|channel|>commentary")))
    return table(spark, sf_dir, "events").select("event_id", text.tool_name(raw).alias("tool"))


@query("""
SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN ts END, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 DAY END, CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 2 DAY END, ts + INTERVAL 3 DAY) AS effective,
 CASE WHEN event_id % 2 = 0 THEN 'created' WHEN event_id % 3 = 0 THEN 'modified' WHEN event_id % 5 = 0 THEN 'file_mtime' ELSE 'ingested' END AS source FROM events""")
def effective_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, ts = F.col("event_id"), F.col("ts")
    day = lambda n: ts + F.expr(f"INTERVAL {n} DAY")
    when, source = reports.effective_time(F.when(k % 2 == 0, ts), F.when(k % 3 == 0, day(1)), F.when(k % 5 == 0, day(2)), day(3))
    return table(spark, sf_dir, "events").select("event_id", when.alias("effective"), source.alias("source"))


@query("""
SELECT event_id, CASE WHEN event_type <> 'error' THEN 'done' WHEN event_id % 4 < 3 THEN 'queued' ELSE 'failed' END AS state FROM events""")
def job_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 4).alias("attempts"), (F.col("event_type") == "error").alias("bad"))
    return reports.retried(e, "attempts", "bad").select("event_id", "state")


@query("""
SELECT user_id, arg_max(event_type, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END) FILTER (event_type IN ('view', 'click', 'purchase', 'error')) AS state, count(*) AS n FROM events WHERE event_type <> 'signup' GROUP BY 1""")
def diagnostics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst state of each part; one that isn't listed is worse than all."""
    return reports.worst_state(table(spark, sf_dir, "events").where("event_type <> 'signup'"), ["user_id"], "event_type", ["view", "click", "purchase"])


@query("SELECT event_id, sum(event_id % 3) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS done FROM events")
def progress_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("files", F.col("event_id") % 3)
    return reports.running_total(e, ["event_type"], ["ts", "event_id"], "files").select("event_id", "done")


@query("SELECT vec_id FROM embeddings WHERE label IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def index_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of documents that are gone leave the index."""
    index = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("doc_id"))
    return reports.pruned(index, table(spark, sf_dir, "documents").where("doc_id % 2 = 0"), "doc_id").select("vec_id")
