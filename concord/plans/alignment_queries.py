"""Queries of matching, routing and vocabulary: over the driver's tables, and over records written here."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import text
from concord.functions.convert import Target
from concord.operators import alignment, batch, generate, profile, scoring, vocabulary
from concord.plans.orders import ORDER_FIELDS, order_records
from concord.plans.registry import query, table
from concord.plans.storage import cut

#: the golden schema of a game, after which the shapes below are written
GAME = [
    Target("name", description="The title of the game", required=True),
    Target("releaseYear", pattern=r"^\d{4}$", description="the year the game was published", required=True),
    Target("developer", description="the studio that developed or made the game"),
    Target("publisher", description="the company that published or distributed the game"),
    Target("platform", enum=["Windows PC", "Xbox", "PlayStation", "Nintendo Switch"], aliases={"PC": "Windows PC", "XBOX": "Xbox", "PS": "PlayStation"}, description="the console or hardware system"),
    Target("genres", ["array"], description="list of genres"),
    Target("criticScore", ["integer"], minimum=0, maximum=100, description="critic press rating out of 100"),
    Target("ESRB", enum=["E", "E10+", "T", "M", "AO"], aliases={"K-A": "E", "Kids to Adults": "E", "Mature": "M", "Teen": "T"}, description="ESRB age rating"),
]
_A = {"name": "Lantern Road", "releaseYear": "2014", "developer": "Two Owls", "publisher": "Harbour", "platform": "Xbox", "genres": ["Puzzle"], "criticScore": 81, "ESRB": "T"}
_B = {"name": "Quiet Engine", "releaseYear": "2019", "developer": "Plain Works", "publisher": "Harbour", "platform": "Windows PC", "genres": ["Racing", "Arcade"], "criticScore": 74, "ESRB": "E"}


def _renamed(r: dict, names: dict[str, str]) -> dict:
    return {names[k]: v for k, v in r.items() if k in names}


SHAPES: dict[str, list[dict]] = {
    "golden": [_A, _B],
    "renamed": [{**_renamed(r, {"name": "game_name", "releaseYear": "release_year", "developer": "developer_studio", "publisher": "publisher_name", "platform": "platform_system", "criticScore": "critic_score_value", "ESRB": "esrb_rating"}), "genre_list": r["genres"]} for r in (_A, _B)],
    "nested": [{"gameData": {"name": r["name"], "releaseInfo": {"year": r["releaseYear"]}, "studio": {"developer": r["developer"], "publisher": r["publisher"]}}, "classification": {"platform": r["platform"], "ESRB": r["ESRB"]}, "ratings": {"critic": r["criticScore"]}, "genres": r["genres"]} for r in (_A, _B)],
    "synonyms": [_renamed(r, {"name": "title", "releaseYear": "launched", "developer": "studio", "publisher": "distributor", "platform": "console", "genres": "categories", "criticScore": "metascore", "ESRB": "maturity"}) for r in (_A, _B)],
    "arity": [{**r, "platform": [r["platform"]]} for r in (_A, _B)],
    "conflict": [{**{k: v for k, v in r.items() if k != "publisher"}, "publisher_a": r["publisher"], "publisher_b": r["publisher"]} for r in (_A, _B)],
    "misspelt": [_renamed(r, {"name": "nmae", "releaseYear": "releaseYaer", "developer": "develper", "publisher": "publsher", "platform": "platfrm", "genres": "genrs", "criticScore": "criticScor", "ESRB": "ESRBB"}) for r in (_A, _B)],
    "opaque": [_renamed(r, {"name": "f1", "releaseYear": "f2", "developer": "f3", "publisher": "f4", "platform": "f5", "genres": "f6", "criticScore": "f7", "ESRB": "f8"}) for r in (_A, _B)],
    "decoys": [{"name": r["name"], "release_year": r["releaseYear"], "developer_contact": "a@b.example", "publisher_region": "EMEA", "platform_vendor": "Someone Inc", "year_installed": "2001-02-03T10:00:00Z", "station_name": "North", "rating": "4 stars", "label": "x", "game": "y"} for r in (_A, _B)],
    "weather": [{"station_id": "s1", "temperature_c": 3.5, "humidity": 80, "wind_kph": 12}, {"station_id": "s2", "temperature_c": 4.5, "humidity": 70, "wind_kph": 8}],
}
#: what each shape's targets are read from, by the rules of the matcher, worked out by hand; a target that isn't listed is left open
EXPECTED = {
    "golden": {**{t.name: (t.name, "exact") for t in GAME}, "genres": ("genres[]", "exact")},
    "renamed": {"name": ("game_name", "description"), "releaseYear": ("release_year", "exact"), "developer": ("developer_studio", "description"), "publisher": ("publisher_name", "description"), "platform": ("platform_system", "description"), "criticScore": ("critic_score_value", "description"), "ESRB": ("esrb_rating", "description")},
    "nested": {"name": ("gameData.name", "exact"), "releaseYear": ("gameData.releaseInfo.year", "description"), "developer": ("gameData.studio.developer", "exact"), "publisher": ("gameData.studio.publisher", "exact"), "platform": ("classification.platform", "exact"), "genres": ("genres[]", "exact"), "criticScore": ("ratings.critic", "description"), "ESRB": ("classification.ESRB", "exact")},
    "synonyms": {"name": ("title", "synonym"), "releaseYear": ("launched", "synonym"), "developer": ("studio", "synonym"), "publisher": ("distributor", "synonym"), "platform": ("console", "synonym"), "genres": ("categories[]", "synonym"), "criticScore": ("metascore", "synonym"), "ESRB": ("maturity", "synonym")},
    "arity": {**{t.name: (t.name, "exact") for t in GAME if t.name != "platform"}, "genres": ("genres[]", "exact")},
    "conflict": {**{t.name: (t.name, "exact") for t in GAME if t.name != "publisher"}, "genres": ("genres[]", "exact")},
    "misspelt": {"releaseYear": ("releaseYaer", "fuzzy"), "developer": ("develper", "fuzzy"), "publisher": ("publsher", "fuzzy"), "platform": ("platfrm", "fuzzy"), "criticScore": ("criticScor", "fuzzy"), "ESRB": ("ESRBB", "fuzzy"), "genres": ("genrs[]", "fuzzy")},
    "opaque": {},
    "decoys": {"name": ("name", "exact"), "releaseYear": ("release_year", "exact")},
    "weather": {},
}


def shape_records(spark: SparkSession) -> DataFrame:
    rows = [(shape, k, json.dumps(r)) for shape, records in SHAPES.items() for k, r in enumerate(records)]
    return spark.createDataFrame(rows, "kind string, rec int, record string")


def _expected_rows() -> str:
    out = []
    for kind, found in EXPECTED.items():
        for t in GAME:
            path, method = found.get(t.name, (None, None))
            status = "mapped" if path else "conflict" if (kind, t.name) == ("conflict", "publisher") else "needs_review"
            method = method or ("fuzzy" if status == "conflict" else "abstain")
            out.append(f"('{kind}', '{t.name}', {f"'{path}'" if path else 'NULL'}, '{method}', '{status}')")
    return ", ".join(out)


def match_shapes(spark: SparkSession) -> DataFrame:
    docs = shape_records(spark)
    long = cut(profile.cells(docs, ["kind", "rec"], "record"), "cells")
    return alignment.infer_mapping(profile.profile(long, ["rec"], ["kind"], profile.totals(docs, "record", ["kind"])), alignment.target_table(spark, GAME), ["kind"])


@query(f"SELECT * FROM (VALUES {_expected_rows()}) AS m(kind, target, path, method, status)")
def match_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten shapes of one schema: what is mapped, by which tier, and what is left open."""
    return match_shapes(spark).select("kind", "target", "path", "method", "status")


@query("""
SELECT * FROM (VALUES ('renamed', 'genres', 'genre_list[]', 'human', 'mapped', 1.0), ('opaque', 'genres', 'genre_list[]', 'human', 'mapped', 1.0)) AS m(kind, target, path, method, status, confidence)""")
def mapping_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person maps one target of two shapes by hand; the others are as they were."""
    done = alignment.override(match_shapes(spark), "genres", "genre_list[]").where("kind IN ('renamed', 'opaque')")
    return done.where("method = 'human'").select("kind", "target", "path", "method", "status", F.col("confidence").cast("decimal(2,1)").alias("confidence"))


@query("SELECT * FROM (VALUES ('conflict', 'publisher', 0::BIGINT, 'publisher_a', 0.86), ('conflict', 'publisher', 1::BIGINT, 'publisher_b', 0.86)) AS m(kind, target, rank, path, score)")
def open_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a person may choose from where two paths tie."""
    found = alignment.open_candidates(match_shapes(spark), ["kind"]).where("kind = 'conflict' AND path IS NOT NULL")
    return found.select("kind", "target", F.col("rank").cast("long").alias("rank"), "path", F.round("score", 2).cast("decimal(3,2)").alias("score"))


def routed_records(spark: SparkSession, sf_dir: str, second: bool) -> DataFrame:
    """Orders as documents in five shapes; in a second batch those of the first shape have lost the price and those of another a field."""
    o = order_records(spark, sf_dir).where("style = 0").select("o_orderkey", F.from_json("record", "orderId long, customerName string, totalPrice double, orderStatus string, orderDate string, tags array<string>").alias("r"))
    o = o.withColumn("style", F.floor(F.col("o_orderkey") / 3) % 5)
    price = F.when(F.lit(second), F.lit("unknown")).otherwise(F.col("r.totalPrice").cast("string"))
    kept = [F.col("r.orderId").alias("orderId"), F.col("r.customerName").alias("customerName"), price.alias("totalPrice"), F.col("r.orderStatus").alias("orderStatus"), F.col("r.orderDate").alias("orderDate"), "r.tags"]
    plain = F.to_json(F.struct(*kept))
    renamed = F.to_json(F.struct(F.col("r.orderId").alias("order_id"), F.col("r.customerName").alias("customer_name"), F.col("r.totalPrice").alias("total_price"), F.col("r.orderStatus").alias("order_status"), F.col("r.orderDate").alias("order_date"), F.array_join("r.tags", ";").alias("tags")))
    nested = F.to_json(F.struct(F.struct(F.col("r.orderId").alias("orderId"), F.col("r.orderDate").alias("orderDate"), F.col("r.orderStatus").alias("orderStatus")).alias("header"), F.struct(F.col("r.customerName").alias("customerName"), *([] if second else [F.lit("x").alias("memo")])).alias("party"), F.struct(F.col("r.totalPrice").alias("totalPrice")).alias("sums"), "r.tags"))
    opaque = F.to_json(F.struct(F.col("r.orderId").cast("string").alias("f1"), F.col("r.customerName").alias("f2"), F.col("r.totalPrice").alias("f3")))
    weather = F.to_json(F.struct(F.lit("s").alias("station"), F.col("r.totalPrice").alias("humidity")))
    return o.select("o_orderkey", "style", F.lit(0).alias("rec"), F.when(F.col("style") == 0, plain).when(F.col("style") == 1, renamed).when(F.col("style") == 2, nested).when(F.col("style") == 3, opaque).otherwise(weather).alias("record"))


def batches(spark: SparkSession, sf_dir: str) -> tuple[batch.Batch, batch.Batch]:
    """A cold batch, a person's approval of all it learned, and a second batch in which two shapes drifted."""
    library = batch.empty_library(spark)
    docs = routed_records(spark, sf_dir, False)
    cold = batch.run_batch(batch.plan_batch(docs, "o_orderkey", "rec", "record", ORDER_FIELDS, library), "o_orderkey", "rec", ORDER_FIELDS, library, "order")
    library = cut(batch.decide(batch.register(library, cold.learned), "approved"), "library")
    docs = routed_records(spark, sf_dir, True)
    warm = batch.run_batch(batch.plan_batch(docs, "o_orderkey", "rec", "record", ORDER_FIELDS, library), "o_orderkey", "rec", ORDER_FIELDS, library, "order")
    return cold, warm


ROUTED = "WITH d AS (SELECT o_orderkey, (o_orderkey // 3) % 5 AS style FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 = 0)"


@query(ROUTED + """
SELECT 'cold' AS run, CASE WHEN style < 3 THEN 'novel_research' ELSE 'review' END AS pathway, count(*) AS n_docs, count(*) FILTER (style < 3) AS conformed, CAST(0 AS BIGINT) AS needs_review FROM d GROUP BY 2
UNION ALL SELECT 'warm', CASE style WHEN 1 THEN 'replay_clean' WHEN 0 THEN 'drift_repair' WHEN 2 THEN 'drift_repair' ELSE 'review' END, count(*), count(*) FILTER (style < 3), 0 FROM d GROUP BY 2""")
def batch_pathways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and records by pathway: shapes learned cold, replayed warm, repaired where they drifted, never forced."""
    cold, warm = batches(spark, sf_dir)
    both = cold.outcomes.withColumn("run", F.lit("cold")).unionByName(warm.outcomes.withColumn("run", F.lit("warm")))
    return both.groupBy("run", "pathway").agg(F.sum("n_docs").alias("n_docs"), F.sum("conformed").alias("conformed"), F.sum("needs_review").alias("needs_review"))


@query("""
SELECT * FROM (VALUES (0, 'behavioral', 'totalPrice', 'fill 100%->0%'), (2, 'structural', 'party memo', 'missing field party memo')) AS d(style, kind, field, detail)""")
def batch_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed in the shapes of the second batch against the approved ones."""
    _, warm = batches(spark, sf_dir)
    first = warm.plan.decisions.select("shape", (F.floor(F.col("first_doc") / 3) % 5).cast("int").alias("style"))
    return warm.plan.drifted.join(first, "shape").select("style", "kind", F.replace("field", F.lit("."), F.lit(" ")).alias("field"), F.replace("detail", F.lit("."), F.lit(" ")).alias("detail"))


@query(ROUTED + """
SELECT o_orderkey, o_orderkey AS "orderId", c_name AS "customerName", round(o_totalprice, 6) AS "totalPrice", o_orderstatus AS "orderStatus", strftime(o_orderdate, '%Y-%m-%d') AS "orderDate", replace(o_orderpriority, '-', ';') AS tags
FROM d JOIN orders USING (o_orderkey) JOIN customer ON o_custkey = c_custkey WHERE style < 3""")
def align_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conformant records of a cold batch by document, whatever their shape."""
    library, docs = batch.empty_library(spark), routed_records(spark, sf_dir, False)
    done = batch.run_batch(batch.plan_batch(docs, "o_orderkey", "rec", "record", ORDER_FIELDS, library), "o_orderkey", "rec", ORDER_FIELDS, library, "order")
    return done.records.select("o_orderkey", "orderId", "customerName", F.round("totalPrice", 6).alias("totalPrice"), "orderStatus", "orderDate", F.array_join("tags", ";").alias("tags"))


@query(ROUTED + """
SELECT 5::BIGINT AS clusters, count(*) FILTER (style < 3) AS conformed_records, 0::BIGINT AS needs_review_records, 0::BIGINT AS quarantined_docs, 3::BIGINT AS n_provisional FROM d""")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    library, docs = batch.empty_library(spark), routed_records(spark, sf_dir, False)
    done = batch.run_batch(batch.plan_batch(docs, "o_orderkey", "rec", "record", ORDER_FIELDS, library), "o_orderkey", "rec", ORDER_FIELDS, library, "order")
    return batch.summary(done.outcomes).select("clusters", "conformed_records", "needs_review_records", "quarantined_docs", F.size("provisional").cast("long").alias("n_provisional"))


@query("""
WITH s AS (SELECT o_orderkey, o_orderkey % 3 AS style FROM orders JOIN customer ON o_custkey = c_custkey), t(target) AS (VALUES ('orderId'), ('customerName'), ('totalPrice'), ('orderStatus'), ('orderDate'), ('tags'))
SELECT target, 'filled' AS status, count(*) AS n FROM s, t GROUP BY target""")
def provenance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each target of each record came about."""
    done = batch.align_shapes(order_records(spark, sf_dir).select("o_orderkey", "record"), "o_orderkey", "record", ORDER_FIELDS)
    return done.select(F.explode("provenance").alias("p")).groupBy("p.target", "p.status").agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{}' WHEN 1 THEN '{"a": 1, "a": 2}' WHEN 2 THEN '{"a": ' WHEN 3 THEN '[1, 2]' WHEN 4 THEN NULL ELSE props END AS record FROM events)
SELECT event_id, CASE event_id % 6 WHEN 2 THEN 'unparsable' WHEN 3 THEN 'not_an_object' WHEN 4 THEN 'missing' END AS reason FROM r WHERE event_id % 6 IN (2, 3, 4)""")
def quarantine_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that can't be profiled, with the reason; {} and repeated keys can."""
    return profile.quarantine(_odd_records(spark, sf_dir), "record").select("event_id", "reason")


def _odd_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 6
    return table(spark, sf_dir, "events").select("event_id", F.when(k == 0, "{}").when(k == 1, '{"a": 1, "a": 2}').when(k == 2, '{"a": ').when(k == 3, "[1, 2]").when(k == 5, F.col("props")).alias("record"))


@query("""
WITH c AS (SELECT event_id % 6 AS k, count(*) AS n FROM events GROUP BY 1)
SELECT path, 'integer' AS types, (SELECT sum(n) FROM c WHERE c.k = p.k)::BIGINT AS present, (SELECT sum(n) FROM c WHERE c.k IN (0, 1, 5))::BIGINT AS total, ex FROM (VALUES ('a', 1, '2'), ('k', 5, NULL)) AS p(path, k, ex)""")
def odd_record_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile that counts empty records and takes the last of repeated keys."""
    docs = _odd_records(spark, sf_dir)
    p = profile.profile(profile.cells(docs, ["event_id"], "record"), ["event_id"], None, profile.totals(docs, "record"))
    return p.select("path", F.array_join("types", ",").alias("types"), "present", "total", F.when(F.col("path") == "a", F.array_join("examples", ",")).alias("ex"))


@query("""
WITH d AS (SELECT o_orderkey, (o_orderkey % 12 + 1)::INT AS depth FROM orders)
SELECT o_orderkey, array_to_string(list_transform(range(1, depth + 1), lambda i: 'k' || i), '.') || '[]' AS path, o_orderkey::VARCHAR AS value FROM d""")
def deep_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves under 2 to 13 containers: no depth is too much."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 12 + 1).cast("int").alias("depth"))
    opening = F.array_join(F.transform(F.sequence(F.lit(1), "depth"), lambda i: F.concat(F.lit('{"k'), i.cast("string"), F.lit('": '))), "")
    record = F.concat(opening, F.lit("["), F.col("o_orderkey").cast("string"), F.lit("]"), F.repeat(F.lit("}"), F.col("depth")))
    return profile.cells(o.select("o_orderkey", record.alias("record")), ["o_orderkey"], "record").select("o_orderkey", "path", "value")


_SHAPE_SETS = "SELECT c_nationkey AS shape, list_sort(list(DISTINCT c_mktsegment || (c_custkey % 4)::VARCHAR)) AS paths FROM customer GROUP BY 1"


@query(f"""
WITH s AS ({_SHAPE_SETS}), p AS (SELECT a.shape, a.paths AS a, b.paths AS b FROM s a JOIN s b ON b.shape = a.shape + 1)
SELECT shape, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS added, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS removed, len(list_intersect(a, b))::BIGINT AS shared,
 CASE WHEN shape % 2 = 1 THEN array_to_string(list_sort(list_filter(list_intersect(a, b), lambda x: right(x, 1) = '3')), ',') ELSE '' END AS mismatched FROM p""")
def signature_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths added, removed and shared between neighbouring shapes, and shared ones whose type changed."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("shape"), F.concat("c_mktsegment", (F.col("c_custkey") % 4).cast("string")).alias("p")).distinct()
    c = c.groupBy("shape").agg(F.array_sort(F.collect_set("p")).alias("paths"))
    typed = c.withColumn("types", F.map_from_arrays("paths", F.transform("paths", lambda p: F.when(p.endswith("3") & (F.col("shape") % 4 < 2), "integer").otherwise("string"))))
    other = typed.select((F.col("shape") - 1).alias("shape"), F.col("paths").alias("b"), F.col("types").alias("tb"))
    d = typed.join(other, "shape").withColumn("d", profile.difference(F.col("paths"), F.col("b"), F.col("types"), F.col("tb")))
    return d.select("shape", F.array_join("d.added", ",").alias("added"), F.array_join("d.removed", ",").alias("removed"), F.size("d.shared").cast("long").alias("shared"), F.array_join("d.mismatched", ",").alias("mismatched"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN round(l_discount * 100)::INT || '%' WHEN 1 THEN ' ' || l_partkey || '/' || (l_linenumber - 1) WHEN 2 THEN l_partkey || ' stars' WHEN 3 THEN '-1.5e2' ELSE l_orderkey::VARCHAR END AS raw FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE l_linenumber % 5 WHEN 0 THEN TRY_CAST(replace(raw, '%', '') AS DOUBLE) WHEN 1 THEN CASE WHEN l_linenumber > 1 THEN TRY_CAST(split_part(trim(raw), '/', 1) AS DOUBLE) / (l_linenumber - 1) END WHEN 2 THEN NULL ELSE TRY_CAST(raw AS DOUBLE) END, 6) AS number FROM r""")
def numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts that are numbers: plain, in percent, ratios (not of nothing); numbers inside prose are none."""
    k = F.col("l_linenumber") % 5
    raw = F.when(k == 0, F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%"))).when(k == 1, F.concat(F.lit(" "), "l_partkey", F.lit("/"), F.col("l_linenumber") - 1)).when(k == 2, F.concat("l_partkey", F.lit(" stars"))).when(k == 3, "-1.5e2").otherwise(F.col("l_orderkey").cast("string"))
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(alignment.number_of(raw, F.lit("string")), 6).alias("number"))


@query("""
SELECT n_nationkey, lower(n_name) IN ('united states', 'usa', 'canada', 'australia', 'japan', 'china', 'germany', 'france', 'united kingdom', 'sweden', 'finland', 'poland', 'south korea', 'new zealand', 'brazil', 'mexico', 'spain', 'italy', 'netherlands')
 OR lower(r_name) IN ('europe', 'africa', 'asia', 'middle east') AND n_nationkey % 2 = 0 AS region FROM nation JOIN region ON n_regionkey = r_regionkey""")
def region_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are a region's, not a company's."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", (alignment.region(F.concat(F.lit(" "), "n_name")) | (alignment.region(F.col("r_name")) & (F.col("n_nationkey") % 2 == 0))).alias("region"))


@query("""
WITH v AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%B %d, %Y') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') WHEN 3 THEN 'copyright ' || year(o_orderdate) || ' acme' WHEN 4 THEN year(o_orderdate)::VARCHAR ELSE 'the 1st of May ' || year(o_orderdate) END AS v FROM orders)
SELECT o_orderkey, o_orderkey % 6 IN (0, 1, 4, 5) AS fits FROM v""")
def pattern_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year's pattern fits a year and a plain date, no time of day and no prose."""
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    v = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "MMMM dd, yyyy")).when(k == 2, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 3, F.concat(F.lit("copyright "), F.year(d), F.lit(" acme"))).when(k == 4, F.year(d).cast("string")).otherwise(F.concat(F.lit("the 1st of May "), F.year(d)))
    return table(spark, sf_dir, "orders").select("o_orderkey", alignment.fits_pattern(v, F.lit(r"^\d{4}$")).alias("fits"))


@query("""
SELECT event_id, event_type, CASE event_type WHEN 'view' THEN event_id % 2 = 0 WHEN 'click' THEN true WHEN 'error' THEN event_id % 2 = 1 ELSE false END AS ok FROM events""")
def type_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON types against schema types: integers are numbers, arrays want arrays."""
    even = F.col("event_id") % 2 == 0
    seen = F.when(F.col("event_type") == "view", F.when(even, "array").otherwise("string")).when(F.col("event_type") == "click", F.when(even, "integer").otherwise("number")).when(F.col("event_type") == "error", F.when(even, "number").otherwise("integer")).otherwise("null")
    ok = F.when(F.col("event_type") == "view", alignment.type_ok(seen, ["array"])).when(F.col("event_type") == "click", alignment.type_ok(seen, ["number"])).when(F.col("event_type") == "error", alignment.type_ok(seen, ["integer"])).otherwise(alignment.type_ok(seen, ["string"]))
    return table(spark, sf_dir, "events").select("event_id", "event_type", ok.alias("ok"))


@query("""
SELECT p_partkey, lower(regexp_replace(p_name, '[_-]+', ' ', 'g')) || '. ' || trim(p_type) || CASE WHEN p_size % 3 = 0 THEN '' ELSE '. examples: ' || left(trim(p_brand), 80) || '; ' || p_size END AS evidence FROM part""")
def evidence_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    shown = F.when(F.col("p_size") % 3 == 0, F.array(F.lit(None).cast("string"), F.lit(" "))).otherwise(F.array(F.lit(None).cast("string"), F.col("p_brand"), F.lit(""), F.col("p_size").cast("string")))
    return p.select("p_partkey", text.evidence(F.replace("p_name", F.lit(" "), F.lit("_")), F.concat(F.lit(" "), "p_type"), shown).alias("evidence"))


@query("""
WITH v AS (SELECT c_nationkey AS target, c_mktsegment AS value, min(c_custkey) AS ord FROM customer WHERE c_custkey % 2 = 0 GROUP BY ALL),
s AS (SELECT n_nationkey AS target, unnest(['MACHINERY', 'Other']) AS value, unnest([0, 1]) AS ord FROM nation WHERE n_nationkey % 4 <> 3),
b AS (SELECT target, value, 0 AS part, ord FROM s UNION ALL SELECT target, value, 1, ord FROM v WHERE target % 4 <> 3),
f AS (SELECT target, value, min((part, ord)) AS place FROM b WHERE target % 5 <> 0 GROUP BY ALL)
SELECT target, (row_number() OVER (PARTITION BY target ORDER BY place, value) - 1)::BIGINT AS ord, value FROM f""")
def vocabulary_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema's values first, then taught ones; none for free-form targets, none where the schema lists none."""
    v = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").groupBy(F.col("c_nationkey").alias("target"), F.col("c_mktsegment").alias("value")).agg(F.min("c_custkey").alias("ord"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("target"))
    s = n.where("target % 4 <> 3").select("target", F.posexplode(F.array(F.lit("MACHINERY"), F.lit("Other"))).alias("ord", "value"))
    return vocabulary.merged(s, v, n.where("target % 5 = 0")).withColumn("ord", F.col("ord").cast("long"))


_TAUGHT = "v AS (SELECT DISTINCT c_nationkey AS target, c_mktsegment AS value FROM customer), a AS (SELECT c_nationkey AS target, 'a' || c_custkey AS alias, c_mktsegment AS value FROM customer WHERE c_custkey % 3 = 0), g AS (SELECT n_nationkey AS target, CASE WHEN n_nationkey % 2 = 0 THEN 'BUILDING' ELSE 'NOTHING' END AS value FROM nation)"


@query(f"""WITH {_TAUGHT}
SELECT 'value' AS kind, target, NULL AS alias, value FROM v ANTI JOIN g USING (target, value) UNION ALL SELECT 'alias', target, alias, value FROM a ANTI JOIN g USING (target, value)""")
def vocabulary_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that are removed take their aliases along."""
    c = table(spark, sf_dir, "customer")
    v = c.select(F.col("c_nationkey").alias("target"), F.col("c_mktsegment").alias("value")).distinct()
    a = c.where("c_custkey % 3 = 0").select(F.col("c_nationkey").alias("target"), F.concat(F.lit("a"), "c_custkey").alias("alias"), F.col("c_mktsegment").alias("value"))
    gone = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("target"), F.when(F.col("n_nationkey") % 2 == 0, "BUILDING").otherwise("NOTHING").alias("value"))
    values, aliases = vocabulary.remove_values(v, a, gone)
    return values.select(F.lit("value").alias("kind"), "target", F.lit(None).cast("string").alias("alias"), "value").unionByName(aliases.select(F.lit("alias").alias("kind"), "target", "alias", "value"))


@query("""
WITH o AS (SELECT c_nationkey AS target, lower(c_mktsegment) AS alias, c_mktsegment || (c_custkey % 3) AS value, c_custkey AS ord FROM customer WHERE c_custkey % 2 = 1),
n AS (SELECT n_nationkey AS target, 'building' AS alias, 'Building' AS value FROM nation), f AS (SELECT target, alias, min_by(value, ord) AS value FROM o GROUP BY ALL)
SELECT * FROM n UNION ALL SELECT * FROM f ANTI JOIN n USING (target, alias)""")
def alias_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases that values carry become aliases of their own; those that exist stay."""
    c = table(spark, sf_dir, "customer")
    old = c.select(F.col("c_nationkey").alias("target"), F.when(F.col("c_custkey") % 2 == 1, F.concat(F.lower("c_mktsegment"), F.lit(" "))).alias("alias"), F.concat("c_mktsegment", F.col("c_custkey") % 3).alias("value"), F.col("c_custkey").alias("ord"))
    new = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("target"), F.lit("building").alias("alias"), F.lit("Building").alias("value"))
    return vocabulary.promoted(old, new)


@query("""
WITH c AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'not_our_data' WHEN 1 THEN 'wrong_mapping' WHEN 2 THEN 'wrong_mapping' WHEN 3 THEN 'other' WHEN 4 THEN 'other' ELSE 'because' END AS category, event_type FROM events)
SELECT event_id, CASE event_id % 6 WHEN 1 THEN CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE 'not a golden field: ' || event_type END WHEN 2 THEN 'wrong_mapping requires at least one golden field' WHEN 3 THEN 'category ''other'' requires an informative note (>= 10 non-whitespace characters)' WHEN 5 THEN 'unknown reject category: because' END AS error,
 CASE event_id % 6 WHEN 0 THEN 'Rejected — not our data. Note: ' || event_type WHEN 1 THEN 'Rejected — wrong field mapping (' || event_type || ').' WHEN 2 THEN 'Rejected — wrong field mapping ().' WHEN 3 THEN 'Rejected — a b c d.' WHEN 4 THEN 'Rejected — seen before: ' || event_type || '.' ELSE 'Rejected.' END AS text FROM c""")
def rejection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, e = F.col("event_id") % 6, F.col("event_type")
    category = F.when(k == 0, "not_our_data").when(k.isin(1, 2), "wrong_mapping").when(k.isin(3, 4), "other").otherwise("because")
    fields = F.when(k == 1, F.array(e)).otherwise(F.array().cast("array<string>"))
    note = F.when(k == 0, F.concat(F.lit(" "), e)).when(k == 3, "a b c d").when(k == 4, F.concat(F.lit("seen before: "), e))
    return table(spark, sf_dir, "events").select("event_id", vocabulary.rejection_error(category, fields, note, ["view", "click"]).alias("error"), vocabulary.rejection_text(category, fields, note).alias("text"))


@query("SELECT 'field_' || i AS target, 'FIELD-' || i AS path, 'exact' AS method, 'mapped' AS status FROM range(400) t(i)")
def wide_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema of 400 fields against records of 400 keys that all share a word."""
    docs = spark.createDataFrame([(k, json.dumps({f"FIELD-{i}": f"v{k}" for i in range(400)})) for k in range(3)], "rec int, record string")
    long = cut(profile.cells(docs, ["rec"], "record"), "cells")
    found = profile.profile(long, ["rec"], None, profile.totals(docs, "record"))
    return alignment.infer_mapping(found, alignment.target_table(spark, generate.wide_schema(400))).select("target", "path", "method", "status")


@query("SELECT * FROM (VALUES ('case', 8, 0, 0), ('affix', 2, 0, 6), ('nest', 8, 0, 0), ('array_wrap', 1, 0, 7), ('opaque', 0, 0, 8), ('described', 8, 0, 0)) AS v(level, tp, fp, fn)")
def variation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated variations of golden records, matched and scored: what is lost is left open, nothing is matched falsely."""
    out = None
    for level in generate.LEVELS:
        records, paths = generate.variation(SHAPES["golden"], level)
        docs = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)], "rec int, record string")
        told = {p: next(t.description for t in GAME if t.name == n) for n, p in paths.items()} if level == "described" else None
        long = cut(profile.cells(docs, ["rec"], "record"), "cells")
        part = profile.profile(long, ["rec"], None, profile.totals(docs, "record"), told).withColumn("level", F.lit(level))
        gold = spark.createDataFrame([(level, p, n) for n, p in paths.items()], "level string, path string, target string")
        out = (part, gold) if out is None else (out[0].unionByName(part), out[1].unionByName(gold))
    found = alignment.infer_mapping(out[0], alignment.target_table(spark, GAME), ["level"]).where("status = 'mapped'").select("level", "path", "target")
    return scoring.precision_recall(found, out[1], ["path", "target"], ["level"]).select("level", F.col("tp").cast("int").alias("tp"), F.col("fp").cast("int").alias("fp"), F.col("fn").cast("int").alias("fn"))
