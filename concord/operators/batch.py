"""Batches of documents in many shapes: clustered, routed by what the library knows, aligned in one plan.

A library is a table of learned shapes (``LIBRARY``).  Nothing here loops over clusters: shapes,
matches, drift, relevance and pathways are tables with a row for each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.functions.convert import Target
from concord.operators import alignment, profile
from concord.plans.storage import cut

LIBRARY = "profile_id string, state string, version int, paths array<string>, types map<string,string>, mapping map<string,string>, baseline map<string,double>, source_docs array<string>, source_doc_count long"
PRODUCING = ["replay_clean", "drift_repair", "novel_research"]
SOURCES_KEPT = 20


def empty_library(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LIBRARY)


def shapes(docs: DataFrame, long: DataFrame, doc: str) -> DataFrame:
    """Each document's shape; one without fields has the empty shape."""
    signed = profile.signatures(long, doc)
    none = F.array().cast("array<string>")
    return docs.select(doc).distinct().join(signed, doc, "left").select(
        doc, F.coalesce("paths", none).alias("paths"), F.coalesce("types", F.create_map().cast("map<string,string>")).alias("types"),
        F.coalesce("shape", F.substring(F.sha2(F.lit("[]"), 256), 1, 16)).alias("shape"),
    )


def matches(clusters: DataFrame, library: DataFrame) -> DataFrame:
    """Of each shape the library entry nearest by paths (of equals the largest id), with its band and what differs."""
    own = clusters.select("shape", F.size("paths").alias("n"), F.explode("paths").alias("p"))
    known = library.select("profile_id", F.size("paths").alias("m"), F.explode("paths").alias("p"))
    shared = own.join(known, "p").groupBy("shape", "profile_id").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("m").alias("m"))
    best = shared.groupBy("shape").agg(F.max(F.struct((F.col("k") / (F.col("n") + F.col("m") - F.col("k"))).alias("score"), "profile_id")).alias("b")).select("shape", "b.*")
    entries = library.select("profile_id", F.col("paths").alias("known"), F.col("types").alias("known_types"))
    both = best.join(clusters.select("shape", "paths", "types"), "shape").join(entries, "profile_id")
    diff = both.withColumn("diff", profile.difference(F.col("paths"), F.col("known"), F.col("types"), F.col("known_types")))
    _, band = profile.compare(F.col("paths"), F.col("known"), F.size("diff.mismatched") > 0)
    return diff.select("shape", "profile_id", "score", band.alias("band"), "diff.added", "diff.removed", "diff.mismatched")


def frozen(matched: DataFrame, library: DataFrame, fields: DataFrame) -> DataFrame:
    """The library's mapping of each matched shape, a row a target, as ``infer_mapping`` gives it."""
    known = matched.select("shape", "profile_id").join(library.select("profile_id", "mapping"), "profile_id")
    path = F.try_element_at("mapping", F.col("target"))
    return known.crossJoin(fields.select("ord", "target", "required")).select(  # the result's own rows: shapes x columns of the schema
        "shape", "ord", "target", "required", path.alias("path"), F.when(path.isNotNull(), "profile").otherwise("abstain").alias("method"),
        F.when(path.isNotNull(), 1.0).otherwise(0.0).alias("confidence"), F.when(path.isNotNull(), "mapped").otherwise("needs_review").alias("status"),
        F.array().cast("array<struct<path:string,score:double>>").alias("candidates"), F.lit("").alias("note"),
    )


def drift(matched: DataFrame, library: DataFrame, rates: DataFrame) -> DataFrame:
    """A row for each matched shape and thing that changed: kind (structural, type, behavioral), field, detail.

    A path that a mapping reads is told by its target.
    """
    known = matched.join(library.select("profile_id", "mapping", "baseline"), "profile_id")
    targets = F.map_from_entries(F.transform(F.map_entries("mapping"), lambda e: F.struct(e["value"].alias("k"), e["key"].alias("v"))))
    known = known.withColumn("targets", F.when(F.size(F.array_distinct(F.map_values("mapping"))) == F.size("mapping"), targets).otherwise(F.create_map().cast("map<string,string>")))

    def changed(column: str, kind: str, detail: str) -> DataFrame:
        return known.select("shape", "profile_id", "targets", F.explode(column).alias("p")).select("shape", "profile_id", F.lit(kind).alias("kind"), F.coalesce(F.try_element_at("targets", F.col("p")), "p").alias("field"), F.concat(F.lit(detail), "p").alias("detail"))

    fell = known.select("shape", "profile_id", F.explode("baseline").alias("target", "was")).join(rates, ["shape", "target"], "left")
    now = F.coalesce("rate", F.lit(0.0))
    fell = fell.where(F.col("was") - now > 0.25).select("shape", "profile_id", F.lit("behavioral").alias("kind"), F.col("target").alias("field"), F.format_string("fill %.0f%%->%.0f%%", 100 * F.col("was"), 100 * now).alias("detail"))
    shape = known.where("band <> 'high' AND size(added) = 0 AND size(removed) = 0").select("shape", "profile_id", F.lit("structural").alias("kind"), F.lit(None).cast("string").alias("field"), F.concat(F.lit("shape similarity dropped to "), "band").alias("detail"))
    return changed("added", "structural", "new field ").unionByName(changed("removed", "structural", "missing field ")).unionByName(changed("mismatched", "type", "type change at ")).unionByName(fell).unionByName(shape)


def align_shapes(docs: DataFrame, doc: str, column: str, fields: list[Target]) -> DataFrame:
    """``docs(doc, column)``, a record a document, clustered by shape and each shape aligned by its own mapping; nothing is learned."""
    long = cut(profile.cells(docs, [doc], column), "cells")
    signed = cut(shapes(docs, long, doc).select(doc, "shape"), "shapes")
    placed = docs.join(signed, doc)
    long = cut(long.join(signed, doc), "placed")
    found = profile.profile(long, [doc], ["shape"], signed.groupBy("shape").agg(F.count("*").alias("total")))
    mapping = cut(alignment.infer_mapping(found, alignment.target_table(docs.sparkSession, fields), ["shape"]), "mapping")
    golden = cut(alignment.execute(placed, long, [doc], mapping, fields, ["shape"]), "golden")
    # written, so that a filter on what conforms looks at columns and is not pushed into every conversion
    golden = golden.withColumn("issues", alignment.issues(fields, [f.name for f in fields], "provenance"))
    return golden.withColumn("conformant", alignment.conformant(fields))


@dataclass
class Plan:
    """A batch's tables: documents with shapes, cells, shapes, decisions, drift, and both mappings."""

    docs: DataFrame
    long: DataFrame
    decisions: DataFrame  # shape, first_doc, n_docs, profile_id, band, verdict, required_*, pathway
    drifted: DataFrame
    known: DataFrame  # mapping of matched shapes
    inferred: DataFrame  # mapping of all others, and of those to repair
    golden: DataFrame | None  # records of matched shapes


def plan_batch(docs: DataFrame, doc: str, rec: str, column: str, fields: list[Target], library: DataFrame, dial: float = 0.5, research: bool = True) -> Plan:
    """``docs(doc, rec, column)`` routed: a pathway for each shape, nothing converted but by approved mappings."""
    spark = docs.sparkSession
    long = cut(profile.cells(docs, [doc, rec], column), "cells")
    signed = cut(shapes(docs, long, doc), "shapes")
    clusters = cut(profile.clusters(signed, doc), "clusters")
    placed = cut(docs.join(signed.select(doc, "shape"), doc), "placed")
    long = cut(long.join(signed.select(doc, "shape"), doc), "placed")
    target = target_rows = cut(alignment.target_table(spark, fields), "target")
    names = [f.name for f in fields]

    rejected = matches(clusters, library.where("state = 'rejected'")).select("shape", F.col("band").alias("rejected_band"), F.col("profile_id").alias("rejected_id"))
    approved = cut(matches(clusters, library.where("state = 'approved'")).where("band IN ('high', 'moderate')"), "approved")
    known = cut(frozen(approved, library, target_rows), "known")
    golden = cut(alignment.execute(placed.join(approved.select("shape"), "shape", "left_semi"), long, [doc, rec], known, fields, ["shape"]), "golden")
    rates = alignment.fill_rates(golden, names, ["shape"])
    drifted = cut(drift(approved, library, rates), "drift")

    total = profile.totals(placed, column, ["shape"])
    inferred = cut(alignment.infer_mapping(profile.profile(long, [doc, rec], ["shape"], total), target, ["shape"]), "inferred")
    share = alignment.coverage(inferred, ["shape"])
    required = sum(f.required for f in fields)
    joined = clusters.select("shape", "first_doc", "n_docs").join(rejected, "shape", "left").join(approved.select("shape", "profile_id", "band", "score"), "shape", "left")
    joined = joined.join(drifted.select("shape").distinct().withColumn("drifted", F.lit(True)), "shape", "left").join(share, "shape", "left")
    verdict = alignment.relevance(F.col("required_coverage"), F.coalesce("coverage", F.lit(0.0)), F.coalesce("required_mapped", F.lit(0)), dial)
    way = alignment.pathway(F.col("rejected_band"), F.col("band"), F.col("drifted"), verdict, F.lit(required), research)
    decisions = joined.select("shape", "first_doc", "n_docs", "profile_id", "rejected_id", "band", "score", verdict.alias("verdict"), "coverage", "required_coverage", F.lit(required).alias("required_total"), "required_mapped", way.alias("pathway"))
    return Plan(placed, long, cut(decisions, "decisions"), drifted, known, inferred, golden)


def doc_counts(decisions: DataFrame) -> DataFrame:
    """Documents by pathway."""
    return decisions.groupBy("pathway").agg(F.sum("n_docs").alias("n_docs"))


def profile_id(title: str, shape: Column) -> Column:
    return F.concat(F.lit(f"{title}__shape_"), F.substring(shape, 1, 10))


@dataclass
class Batch:
    plan: Plan
    outcomes: DataFrame  # shape, pathway, n_docs, conformed, needs_review, quarantined, provisional
    records: DataFrame  # conformant golden records with their document
    learned: DataFrame  # library rows to be approved


def run_batch(plan: Plan, doc: str, rec: str, fields: list[Target], library: DataFrame, title: str = "target") -> Batch:
    """Carry out the pathways: replay by the library's mapping, research by the inferred one; a shape that maps nothing goes to review.

    Only conformant records come out.  What research learned is provisional: a new entry, or the
    next version of the one that drifted.
    """
    names = [f.name for f in fields]
    grounded = plan.inferred.where("status = 'mapped'").groupBy("shape").agg(F.map_from_entries(F.collect_list(F.struct("target", "path"))).alias("mapping"))
    decided = plan.decisions.join(grounded, "shape", "left")
    blank = F.col("pathway").isin("novel_research", "drift_repair") & F.col("mapping").isNull()
    decided = cut(decided.withColumn("pathway", F.when(blank, "review").otherwise(F.col("pathway"))), "decided")
    research = decided.where(F.col("pathway").isin("novel_research", "drift_repair")).select("shape")
    mine = plan.docs.join(research, "shape", "left_semi")
    fresh = alignment.execute(mine, plan.long, [doc, rec], plan.inferred.join(research, "shape", "left_semi"), fields, ["shape"])
    replay = plan.golden.join(decided.where("pathway = 'replay_clean'").select("shape"), "shape", "left_semi")
    golden = cut(replay.unionByName(fresh), "records").withColumn("issues", alignment.issues(fields, names, "provenance"))
    golden = cut(golden.withColumn("conformant", alignment.conformant(fields)), "golden")

    counts = golden.groupBy("shape").agg(F.count_if("conformant").alias("conformed"), F.count_if(~F.col("conformant")).alias("needs_review"))
    learning = F.col("pathway").isin("novel_research", "drift_repair")
    pid = F.when(F.col("pathway") == "drift_repair", F.col("profile_id")).when(F.col("pathway") == "novel_research", profile_id(title, F.col("shape")))
    zero = F.lit(0).cast("long")
    outcomes = decided.join(counts, "shape", "left").select("shape", "first_doc", "pathway", "n_docs", F.coalesce("conformed", zero).alias("conformed"), F.coalesce("needs_review", zero).alias("needs_review"), (F.col("pathway") == "reject_irrelevant").alias("quarantined"), pid.alias("provisional"))

    rates = alignment.fill_rates(golden.join(research, "shape", "left_semi"), names, ["shape"])
    baseline = rates.groupBy("shape").agg(F.map_from_entries(F.collect_list(F.struct("target", F.round("rate", 4).alias("rate")))).alias("baseline"))
    order = Window.partitionBy("shape").orderBy(doc)
    sources = plan.docs.join(research, "shape", "left_semi").select("shape", doc).distinct().select("shape", doc, F.row_number().over(order).alias("r"))
    sources = sources.groupBy("shape").agg(F.array_sort(F.collect_list(F.when(F.col("r") <= SOURCES_KEPT, F.struct("r", F.col(doc).cast("string").alias("d"))))).alias("s"), F.count("*").alias("source_doc_count"))
    signs = signs_of(plan)
    versions = library.groupBy("profile_id").agg(F.max("version").alias("was"))
    learned = decided.where(learning).select("shape", pid.alias("profile_id"), "mapping").join(signs, "shape").join(baseline, "shape").join(sources, "shape").join(versions, "profile_id", "left")
    learned = learned.select("profile_id", F.lit("provisional").alias("state"), (F.coalesce("was", F.lit(0)) + 1).alias("version"), "paths", "types", "mapping", "baseline", F.transform("s", lambda x: x.d).alias("source_docs"), "source_doc_count")
    return Batch(plan, outcomes, golden.where("conformant").drop("issues", "conformant"), learned)


def signs_of(plan: Plan) -> DataFrame:
    """Paths and types of each shape, as its first document has them."""
    first = plan.decisions.select("shape", "first_doc")
    doc = [c for c in plan.docs.columns if c not in ("shape",)][0]
    return profile.signatures(plan.long.join(first, (plan.long["shape"] == first["shape"]) & (F.col(doc) == F.col("first_doc")), "left_semi"), doc).select("shape", "paths", "types")


def register(library: DataFrame, learned: DataFrame) -> DataFrame:
    """The library with the learned entries in place of those with their ids; what a person rejected stays."""
    kept = learned.join(library.where("state = 'rejected'").select("profile_id"), "profile_id", "left_anti")
    return library.join(kept.select("profile_id"), "profile_id", "left_anti").unionByName(kept)


def decide(library: DataFrame, state: str, ids: list[str] | None = None) -> DataFrame:
    """A person's decision about entries (all, or those named): approved, retired, rejected, provisional."""
    mine = F.lit(True) if ids is None else F.col("profile_id").isin(ids)
    return library.withColumn("state", F.when(mine, F.lit(state)).otherwise(F.col("state")))


def summary(outcomes: DataFrame) -> DataFrame:
    """One row: clusters, records by fate, quarantined documents, provisional profiles."""
    return outcomes.agg(
        F.count("*").alias("clusters"), F.coalesce(F.sum("conformed"), F.lit(0)).alias("conformed_records"), F.coalesce(F.sum("needs_review"), F.lit(0)).alias("needs_review_records"),
        F.coalesce(F.sum(F.when(F.col("quarantined"), F.col("n_docs"))), F.lit(0)).alias("quarantined_docs"), F.array_sort(F.collect_set("provisional")).alias("provisional"),
    )
