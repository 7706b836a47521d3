"""JSON records as long tables of cells, and their profiles and shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions import text
from concord.plans.storage import cut

STEP = 6  # levels that one plan opens
#: fixed values: bookkeeping fields
BOOKKEEPING = ["internal_id", "_scraped_at"]


def json_type(v: Column, t: Column | None = None) -> Column:
    """null, boolean, integer, number, string, array or object; ``t``: the value's schema, where a column has it."""
    t = F.schema_of_variant(v) if t is None else t
    return (
        F.when(t == "VOID", "null").when(t == "BOOLEAN", "boolean").when(t == "BIGINT", "integer")
        .when(t.rlike(r"^DECIMAL\([0-9]+,0\)$") & ~F.to_json(v).contains("."), "integer").when(t.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(t == "STRING", "string").when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object")
    )


def depth(record: Column) -> Column:
    """How deep a JSON text's brackets stand in one another, strings aside."""
    brackets = F.regexp_replace(F.regexp_replace(record, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', ""), r"[^\[\]{}]", "")
    step = lambda a, x: F.when(x.isin("{", "["), F.struct((a.d + 1).alias("d"), F.greatest(a.m, a.d + 1).alias("m"))).otherwise(F.struct((a.d - 1).alias("d"), a.m.alias("m")))
    return F.aggregate(F.split(brackets, ""), F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), step, lambda a: a.m)


def quarantine(records: DataFrame, column: str) -> DataFrame:
    """The records that are no JSON object, with the reason; all others take part in profiles."""
    _allow_repeated_keys(records)
    v = F.try_parse_json(F.col(column))
    reason = F.when(F.col(column).isNull(), "missing").when(v.isNull(), "unparsable").when(~F.schema_of_variant(v).startswith("OBJECT"), "not_an_object")
    return records.withColumn("reason", reason).where("reason IS NOT NULL")


def _allow_repeated_keys(records: DataFrame) -> None:
    """Of a key that a record repeats the last value counts."""
    records.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def cells(records: DataFrame, ids: list[str], column: str) -> DataFrame:
    """A row for each leaf: ids, path, jtype, value (text), pos (of the arrays around it).

    An empty array is a row of its element path with type array; an empty object has none.
    Containers are opened level by level, ``STEP`` levels in one plan; what is deeper is written
    and opened on, so no depth is too much and shallow records cost one plan.
    """
    _allow_repeated_keys(records)
    spark = records.sparkSession
    deepest = records.agg(F.max(depth(F.col(column)))).first()[0] or 0
    now = records.select(*ids, F.try_parse_json(F.col(column)).alias("v"), F.lit("").alias("path"), F.array().cast("array<int>").alias("pos")).where("v IS NOT NULL AND schema_of_variant(v) LIKE 'OBJECT%'")
    out = None
    while deepest > 0:
        for _ in range(min(deepest, STEP)):
            opened = spark.tvf.variant_explode_outer(F.col("v").outer())
            step = "CASE WHEN value IS NULL THEN path WHEN key IS NULL THEN path || '[]' WHEN path = '' THEN key ELSE path || '.' || key END"
            now = now.withColumnRenamed("pos", "was").lateralJoin(opened).selectExpr(*ids, "CASE WHEN value IS NULL THEN v ELSE value END AS v", f"{step} AS path", "CASE WHEN value IS NULL OR key IS NOT NULL THEN was ELSE array_append(was, `pos`) END AS pos")
        deepest -= STEP
        if deepest > 0:
            now = cut(now.withColumn("t", F.schema_of_variant("v")), "levels")
            closed = F.col("t").rlike("^(?:OBJECT|ARRAY)<.+>$") & (F.col("t") != "ARRAY<VOID>")
            leaves, now = now.where(~closed).drop("t"), now.where(closed).drop("t")
            out = leaves if out is None else out.unionByName(leaves)
    out = now if out is None else out.unionByName(now)
    out = out.where("path <> ''").withColumn("_t", F.schema_of_variant("v"))
    kind = json_type(F.col("v"), F.col("_t"))
    path = F.when(F.col("jtype") == "array", F.concat("path", F.lit("[]"))).otherwise(F.col("path")).alias("path")
    value = F.when(~F.col("jtype").isin("array", "null"), F.coalesce(F.expr("try_variant_get(v, '$', 'string')"), F.to_json("v"))).alias("value")
    return out.withColumn("jtype", kind).where("jtype <> 'object'").select(*ids, path, "pos", "jtype", value)


def totals(records: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Records that are objects, {} among them."""
    _allow_repeated_keys(records)
    v = F.try_parse_json(F.col(column))
    return records.where(v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT")).groupBy(*(by or [])).agg(F.count("*").alias("total"))


def profile(long: DataFrame, record: list[str], by: list[str] | None = None, total: DataFrame | None = None, descriptions: dict[str, str] | None = None) -> DataFrame:
    """Per path: types by frequency, first five distinct examples (with their types), presence, total, tokens of the leaf's name and description.

    ``total``: the numbers of records, as ``totals`` gives them; without it, of those with a cell.
    """
    by = by or []
    if total is None:
        total = long.select(*by, *record).distinct().groupBy(*by).agg(F.count("*").alias("total"))
    kinds = long.groupBy(*by, "path", "jtype").agg(F.count("*").alias("n")).groupBy(*by, "path").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "jtype"))).alias("kinds"))
    present = long.groupBy(*by, "path").agg(F.countDistinct(*record).alias("present"))
    joined = kinds.join(present, [*by, "path"])
    joined = joined.join(total, by) if by else joined.crossJoin(F.broadcast(total))  # one row
    joined = joined.join(examples(long, record, by), [*by, "path"], "left")
    leaf = F.regexp_replace(F.element_at(F.split("path", "[.]"), -1), r"\[\]", "")
    told = {k: v for k, v in (descriptions or {}).items() if v}
    desc = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in told.items() for x in kv]), F.col("path")), F.lit("")) if told else F.lit("")
    return joined.select(*by, "path", F.transform("kinds", lambda k: k.jtype).alias("types"), "examples", "example_types", "present", "total", text.name_tokens(leaf).alias("tokens"), text.description_tokens(desc).alias("desc_tokens"))


def examples(long: DataFrame, record: list[str], by: list[str] | None = None, keep: int = 5) -> DataFrame:
    """The first distinct values of each path."""
    from pyspark.sql import Window

    by = by or []
    first = long.where("jtype NOT IN ('null', 'array')").groupBy(*by, "path", "value").agg(F.min(F.struct(*record, "pos", "jtype")).alias("first"))
    order = Window.partitionBy(*by, "path").orderBy("first", "value")
    top = first.select("*", F.row_number().over(order).alias("r")).where(F.col("r") <= keep)
    listed = F.array_sort(F.collect_list(F.struct("r", "value", "first.jtype")))
    return top.groupBy(*by, "path").agg(listed.alias("l")).select(*by, "path", F.transform("l", lambda x: x.value).alias("examples"), F.transform("l", lambda x: x.jtype).alias("example_types"))


def signatures(long: DataFrame, doc: str) -> DataFrame:
    """Each document's shape: normalised paths without bookkeeping fields, their hash, and each path's primary type."""
    kinds = long.repartition(doc).groupBy(doc, "path", "jtype").agg(F.count("*").alias("n"))  # one exchange for all three steps
    primary = kinds.groupBy(doc, "path").agg(F.min(F.struct((-F.col("n")).alias("n"), "jtype")).alias("k"))
    raw = primary.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("path", "k.jtype"))).alias("raw")).withColumn("raw_id", F.sha2(F.to_json("raw"), 256))
    # names are normalised once for each set of raw paths, not for each document
    ignored = [text.normalise_path(F.lit(p)) for p in BOOKKEEPING]
    each = raw.groupBy("raw_id").agg(F.first("raw").alias("raw")).select("raw_id", F.explode("raw").alias("x"))
    named = each.select("raw_id", F.col("x.path").alias("path"), text.normalise_path(F.col("x.path")).alias("norm"), F.col("x.jtype").alias("jtype")).where(~F.col("norm").isin(*ignored))
    first = named.groupBy("raw_id", "norm").agg(F.min_by("jtype", "path").alias("jtype"))
    shapes = first.groupBy("raw_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("norm", "jtype")))).alias("types")).select("raw_id", F.map_keys("types").alias("paths"), "types")
    listed = F.concat(F.lit('["'), F.array_join("paths", '", "'), F.lit('"]'))
    shapes = shapes.withColumn("shape", F.substring(F.sha2(listed, 256), 1, 16))
    return raw.select(doc, "raw_id").join(shapes, "raw_id").select(doc, "paths", "types", "shape")


def clusters(signed: DataFrame, doc: str) -> DataFrame:
    """Documents of one shape, by the first of them, whose types stand for the shape's."""
    return signed.groupBy("shape").agg(F.min(doc).alias("first_doc"), F.count("*").alias("n_docs"), F.min_by("paths", doc).alias("paths"), F.min_by("types", doc).alias("types"))


def compare(a: Column, b: Column, mismatched: Column | None = None) -> tuple[Column, Column]:
    """Jaccard of two path sets (1 if both are empty) and its band."""
    j = text.jaccard(a, b, 1.0)
    band = F.when(j >= 0.95, F.when(mismatched if mismatched is not None else F.lit(False), "moderate").otherwise("high")).when(j >= 0.6, "moderate").when(j > 0, "low").otherwise("none")
    return j, band


def difference(now: Column, known: Column, now_types: Column, known_types: Column) -> Column:
    """Of two signatures: paths added and removed, and shared ones whose primary type differs."""
    shared = F.array_intersect(now, known)
    changed = F.filter(shared, lambda p: F.try_element_at(now_types, p) != F.try_element_at(known_types, p))
    return F.struct(F.array_sort(F.array_except(now, known)).alias("added"), F.array_sort(F.array_except(known, now)).alias("removed"), F.array_sort(shared).alias("shared"), F.array_sort(changed).alias("mismatched"))
