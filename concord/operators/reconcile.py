"""Draft units against corpus facts and reviewer corrections, by rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_round(corrections: DataFrame, target: str, round_: str, up_to: int | None = None) -> DataFrame:
    """All corrections of each target's last round, or of its last round so far."""
    seen = corrections if up_to is None else corrections.where(F.col(round_) <= up_to)
    return seen.select("*", F.max(round_).over(Window.partitionBy(target)).alias("_last")).where(F.col(round_) == F.col("_last")).drop("_last")


def rounds(corrections: DataFrame, target: str, round_: str) -> DataFrame:
    """Every round r with the corrections in force at it, in one plan."""
    last = corrections.agg(F.max(round_).alias("last"))
    at = last.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))).alias("r"))
    seen = corrections.join(F.broadcast(at), F.col(round_) <= F.col("r"))  # as many rows as rounds, broadcast
    return seen.select("*", F.max(round_).over(Window.partitionBy("r", target)).alias("_last")).where(F.col(round_) == F.col("_last")).drop("_last")


def resolve(draft: Column, fact: Column, proposals: Column) -> tuple[Column, Column, Column]:
    """Status, value and note of a unit; ``proposals``: array of structs (id, new_value), in order.

    Corrections that differ are a conflict without a value.  A fact of the corpus beats a
    correction and is compared with the draft without case and outer blanks; a correction alone
    gives its value; with neither the unit needs review and keeps its draft.
    """
    draft = F.coalesce(draft, F.lit(""))
    given = F.coalesce(proposals, F.array().cast("array<struct<id:string,new_value:string>>"))
    differ = F.size(F.array_distinct(F.transform(given, lambda c: F.struct(c.new_value)))) > 1
    one = F.try_element_at(given, F.lit(1))["new_value"]
    supplied = F.coalesce(one, F.lit("")) != ""
    plain = lambda c: F.lower(F.trim(c))
    status = (
        F.when(differ, "conflict")
        .when(fact.isNotNull(), F.when(draft == "", "filled").when(plain(draft) != plain(fact), "corrected").otherwise("unchanged"))
        .when(supplied, F.when(draft == "", "filled").otherwise("corrected"))
        .otherwise("needs_review")
    )
    value = F.when(differ, None).when(fact.isNotNull(), fact).when(supplied, one).when(draft != "", draft)
    note = (
        F.when(differ, "Corrections disagree; resolution deferred to a human.")
        .when(fact.isNotNull(), "")
        .when(supplied, F.concat(F.lit("Value supplied by correction "), F.try_element_at(given, F.lit(1))["id"], F.lit(" (no corpus fact).")))
        .otherwise("Flagged or required, but no corpus value or corrected value available.")
    )
    return status, value, note


def resolve_units(units: DataFrame, corrections: DataFrame, target: str, draft: str, fact: str, new_value: str, id_: str) -> DataFrame:
    """Each unit with status, value, note, the draft's value, the correction ids and the number of distinct candidates."""
    proposed = corrections.groupBy(target).agg(F.array_sort(F.collect_list(F.struct(F.col(id_).cast("string").alias("id"), F.col(new_value).cast("string").alias("new_value")))).alias("_c"))
    joined = units.join(proposed, target, "left")
    status, value, note = resolve(F.col(draft), F.col(fact), F.col("_c"))
    distinct = F.size(F.array_distinct(F.transform("_c", lambda c: F.struct(c.new_value))))
    return joined.select(target, status.alias("status"), value.alias("value"), note.alias("note"), F.col(draft).alias("original"), F.coalesce(distinct, F.lit(0)).cast("long").alias("n_candidates"), F.coalesce(F.transform("_c", lambda c: c.id), F.array().cast("array<string>")).alias("corrections"))


def tally(units: DataFrame, by: list[str] | None = None) -> DataFrame:
    return units.groupBy(*(by or []), "status").agg(F.count("*").alias("n"))


def progress(counts: DataFrame, round_: str, open_: str) -> DataFrame:
    """Whether the open units fell against the round before."""
    before = F.lag(open_).over(Window.orderBy(round_))  # a row a round
    return counts.withColumn("progressed", F.coalesce(F.col(open_) < before, F.lit(True)))


def number(units: DataFrame, by: list[str], order: list[str], name: str = "number") -> DataFrame:
    return units.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def resolve_references(references: DataFrame, numbered: DataFrame, keys: list[str]) -> DataFrame:
    """Cross references to numbered units; one that points nowhere needs review."""
    found = references.join(numbered, keys, "left")
    return found.withColumn("status", F.when(F.col("number").isNull(), "needs_review").otherwise("resolved"))


def last_placement(placements: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Of several placements the last counts."""
    return placements.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def valid_operations(ops: DataFrame, operation: str, value: str, known: list[str], setting: list[str]) -> DataFrame:
    """Why an operation can't be applied, or null."""
    reason = F.when(~F.col(operation).isin(known), "unknown_operation").when(F.col(operation).isin(setting) & (F.coalesce(F.col(value), F.lit("")) == ""), "empty_value")
    return ops.withColumn("reason", reason)


def squeezed(c: Column) -> Column:
    """Lower case, blanks run together."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def grounded(value: Column, corpus: Column) -> Column:
    """The value stands in the corpus, both squeezed; an empty value invents nothing."""
    v = squeezed(F.coalesce(value, F.lit("")))
    return (v == "") | F.contains(squeezed(corpus), v)


def resolvable_key(target: Column) -> Column:
    """What a target is looked up by: a cell ``section.table[...]`` by its table, all others by themselves."""
    return F.when(target.contains("["), F.substring_index(target, "[", 1)).otherwise(target)


def dominant_match(pairs: DataFrame, left: str, right: str, shared: str, least: int = 2) -> DataFrame:
    """The right side with most shared tokens, if it has enough and more than the runner-up."""
    w = Window.partitionBy(left).orderBy(F.desc(shared), right)
    ranked = pairs.select("*", F.row_number().over(w).alias("_r"), F.lead(shared).over(w).alias("_next"))
    return ranked.where((F.col("_r") == 1) & (F.col(shared) >= least) & (F.col(shared) > F.coalesce("_next", F.lit(0)))).drop("_r", "_next")


#: fixed values: words that say nothing about which figure is meant
FILLER = [
    "the", "a", "an", "of", "and", "to", "in", "for", "is", "it", "that", "this", "with", "by", "on", "at", "as", "or", "be", "its", "into", "from",
    "subject", "reviewer", "please", "should", "swap", "not", "now", "there", "what", "one", "correct", "right", "wrong", "reference", "referenced", "section",
    "figure", "chart", "image", "graphic", "diagram", "plot", "png",
]


def content_words(text: Column) -> Column:
    """Words of feedback without its mail head and without words that say nothing."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?im)^(?:from|subject|to|cc|date):.*$", "")
    return F.array_distinct(F.filter(F.split(F.lower(body), "[^a-z0-9]+"), lambda w: (F.length(w) > 1) & ~w.isin(FILLER)))


def shared_words(left: DataFrame, right: DataFrame, a: str, b: str, words: str) -> DataFrame:
    """Pairs with the number of words they share, joined on words."""
    l = left.select(a, F.explode(words).alias("_w"))  # noqa: E741
    r = right.select(b, F.explode(words).alias("_w"))
    return l.join(r, "_w").groupBy(a, b).agg(F.count("*").alias("shared"))


def word_sets(rows: DataFrame, key: str, words: str) -> DataFrame:
    """Each key with its distinct words, sorted, as ``_set``; a key of several rows has the words of all."""
    return rows.select(key, F.explode(words).alias("_w")).groupBy(key).agg(F.array_sort(F.collect_set("_w")).alias("_set"))


def dominant_by_words(left: DataFrame, right: DataFrame, a: str, b: str, words: str, least: int = 2) -> DataFrame:
    """``a, b, shared``: each left side's dominant match by shared words.

    Sets of words are matched, not rows: what several left sides say is looked up once, and right sides
    of one set are one candidate, which ties with itself and so is nobody's match.  The work grows with
    pairs of distinct sets that share a word, however many rows have them.
    """
    l, r = word_sets(left, a, words), word_sets(right, b, words)  # noqa: E741
    said = l.select("_set", F.col("_set").alias(words)).distinct()
    kinds = r.groupBy("_set").agg(F.count("*").alias("_n"), F.min(b).alias("_b")).select(F.struct("_b", "_n").alias("_kind"), F.col("_set").alias(words))
    best = dominant_match(shared_words(said, kinds, "_set", "_kind", words), "_set", "_kind", "shared", least).where("_kind._n = 1")
    return l.join(best, "_set").select(a, F.col("_kind._b").alias(b), "shared")


def reconcile_graphics(required: DataFrame, placed: DataFrame, relabels: DataFrame) -> DataFrame:
    """``required(graphic_id, section, name)``, ``placed(name, section, ord)``, ``relabels(section, new_value, old_value)``: a relabel to the right name beats insertion, insertion beats a move."""
    last = placed.groupBy("name").agg(F.max_by("section", "ord").alias("placed_section"))
    named = relabels.groupBy("section", F.col("new_value").alias("name")).agg(F.max("old_value").alias("old_value"), F.lit(True).alias("relabelled"))
    both = required.join(last, "name", "left").join(named, ["section", "name"], "left")
    at = F.col("placed_section")
    status = F.when(F.col("relabelled"), "corrected").when(at.isNull(), "filled").when(at != F.col("section"), "corrected").otherwise("unchanged")
    note = (
        F.when(F.col("relabelled"), F.concat(F.lit("Relabeled from '"), F.coalesce("old_value", F.lit("")), F.lit("' to '"), "name", F.lit("'.")))
        .when(at.isNull(), "Graphic was missing; inserted into its required section.")
        .when(at != F.col("section"), F.concat(F.lit("Moved from '"), at, F.lit("' to '"), "section", F.lit("'.")))
        .otherwise("")
    )
    return both.select("graphic_id", "section", "name", status.alias("status"), note.alias("note"))


def reconcile_tables(drafts: DataFrame, specs: DataFrame) -> DataFrame:
    """``drafts(table_id, columns, font, header_style, n_rows)`` against ``specs`` with the same columns: what formatting changes, and the status."""
    s = specs.select("table_id", *[F.col(c).alias(f"want_{c}") for c in ("columns", "font", "header_style")])
    both = s.join(drafts, "table_id", "left")
    changed = lambda c, some: F.when(some & (F.col(c) != F.col(f"want_{c}")), F.lit(c))
    formatting = F.array_compact(F.array(changed("columns", F.size("columns") > 0), changed("font", F.col("font") != ""), changed("header_style", F.col("header_style") != "")))
    return both.select("table_id", formatting.alias("formatting"), F.when(F.coalesce("n_rows", F.lit(0)) > 0, "corrected").otherwise("filled").alias("status"))


def table_cells(blocks: DataFrame, key: str, text: str, marker: str, labels: list[str]) -> DataFrame:
    """Rows of a text block, split before each marker, and each label's value in them: a row for each found cell (``row_ord``, ``label``, ``cell``)."""
    quoted = [F.lit(x) for x in labels]
    segments = blocks.select(key, F.posexplode(F.split(text, f"(?=\\Q{marker}\\E)")).alias("seg", "segment")).where(F.contains(F.lower("segment"), F.lit(marker.lower())))
    ends = "|".join(f"\\Q{x}\\E" for x in labels)
    found = [F.regexp_extract("segment", rf"(?i)\Q{x}\E\s*:\s*(.+?)\s*(?:\.\s|\.$|(?:{ends})\s*:|$)", 1) for x in labels]
    numbered = segments.select(key, "segment", F.row_number().over(Window.partitionBy(key).orderBy("seg")).alias("row_ord"))
    cells = numbered.select(key, "row_ord", F.explode(F.arrays_zip(F.array(*quoted).alias("label"), F.array(*found).alias("cell"))).alias("x"))
    value = F.trim(F.regexp_replace("x.cell", r"\s+", " "))
    return cells.select(key, "row_ord", F.col("x.label").alias("label"), value.alias("cell")).where("cell <> ''")


def furniture(drafts: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """``drafts(key, title, header, footer, page_numbers, classification)`` and ``corrections(key, element, id, new_value)``: a row for each page element with status and value."""
    marks = corrections.where("element = 'classification'").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("id").cast("string").alias("id"), "new_value"))).alias("_c"))
    d = drafts.join(marks, key, "left")
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    status, value, _ = resolve(F.col("classification"), F.lit(None).cast("string"), F.col("_c"))
    elements = [
        ("header", F.when(some("header"), "unchanged").otherwise("filled"), F.when(some("header"), F.col("header")).otherwise(F.col("title"))),
        ("footer", F.when(some("footer"), "unchanged").otherwise("corrected"), F.lit("Page number (added) + classification marking (still needed)")),
        ("page_numbers", F.when(F.coalesce("page_numbers", F.lit(False)), "unchanged").otherwise("corrected"), F.lit("true")),
        ("classification", status, value),
    ]
    rows = F.array(*[F.struct(F.lit(k).alias("element"), st.alias("status"), v.alias("value")) for k, st, v in elements])
    return d.select(key, F.explode(rows).alias("x")).select(key, "x.*")


def convergence(units: DataFrame, by: list[str]) -> DataFrame:
    """Open units of each round, and whether all are settled; findings of discipline don't count."""
    open_ = F.col("status").isin("needs_review", "conflict") & (F.coalesce("defect_class", F.lit("")) != "discipline")
    return units.groupBy(*by).agg(F.count("*").alias("total_units"), F.count_if(open_).alias("unresolved")).withColumn("converged", F.col("unresolved") == 0)


def append_operations(corrections: DataFrame, more: DataFrame, target: str) -> DataFrame:
    """The corrections, and of the proposed ones those whose target none has yet."""
    return corrections.unionByName(more.join(corrections.select(target).distinct(), target, "left_anti").select(corrections.columns))


def interpreted(feedback: DataFrame, targets: list[str], text: str) -> DataFrame:
    """A rule's reading of feedback: "should be X" sets X on the first target that is named; nothing else is proposed."""
    low = F.lower(text)
    value = F.trim(F.regexp_extract(low, r"should be\s+(.+?)(?:,| not | instead|\.|$)", 1))
    named = F.lit(None).cast("string")
    for t in reversed(targets):
        leaf = t.split(".")[-1]
        named = F.when(F.contains(low, F.lit(leaf.replace("_", " "))) | F.contains(low, F.lit(leaf)), t).otherwise(named)
    return feedback.withColumn("new_value", value).withColumn("target", named).withColumn("operation", F.lit("replace_field")).where("new_value <> '' AND target IS NOT NULL")


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """(kind, status): the units of all parts of a report."""
    out = None
    for kind, units in parts.items():
        part = units.select(F.lit(kind).alias("kind"), "status")
        out = part if out is None else out.unionByName(part)
    return out


def summary(units: DataFrame) -> DataFrame:
    """Units by status, and all of them; every status counts once more in the total by grouping sets."""
    counts = units.rollup("status").agg(F.count("*").alias("n"), F.grouping("status").alias("g"))
    return counts.select(F.when(F.col("g") == 1, "total_units").otherwise(F.col("status")).alias("status"), "n")


def engine_operation(operation: Column) -> Column:
    """A proposed operation in the engine's words."""
    return F.when(operation.isin("relabel_graphic", "relocate_graphic"), "relabel_graphic").when(operation == "flag_needs_review", "flag").otherwise("replace")
