"""Source paths to target columns: candidates, scores, mapping, execution, validation, routing.

Everything is keyed by cluster (``by``): the mappings of all shapes are inferred in one plan and
executed in one plan, so the number of shapes adds rows, not jobs.  Without ``by`` there is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.functions import text
from concord.functions.convert import Target, convert

#: fixed values: other names of a target, each a whole name; none that could mean two targets
SYNONYMS = {
    "name": ["title"],
    "releaseYear": ["launched", "launch", "debut"],
    "developer": ["studio", "creator", "maker"],
    "publisher": ["distributor"],
    "platform": ["console", "system", "hardware"],
    "genres": ["categories", "category", "genre", "tags"],
    "criticScore": ["metacritic", "metascore"],
    "ESRB": ["maturity"],
}
#: fixed values: common words that are no misspelling of a short name
NO_TYPO = [
    "game", "fame", "tame", "same", "lame", "dame", "came", "mane", "nave",
    "date", "rate", "late", "gate", "mate", "fate", "hate", "time", "type",
    "note", "code", "node", "mode", "role", "line", "list", "size", "year",
]
#: fixed values: names of regions and countries, no company's or person's
REGIONS = [
    "emea", "apac", "amer", "latam", "anz", "mena", "na", "eu", "us", "uk",
    "north america", "south america", "latin america", "central america",
    "asia pacific", "asia-pacific", "europe", "middle east", "oceania",
    "africa", "asia", "worldwide", "global", "international", "domestic",
    "north", "south", "east", "west", "northwest", "northeast", "southwest",
    "southeast", "pacific northwest", "midwest",
    "united states", "usa", "canada", "australia", "japan", "china", "germany",
    "france", "united kingdom", "sweden", "finland", "poland", "south korea",
    "new zealand", "brazil", "mexico", "spain", "italy", "netherlands",
]
#: fixed values: words of a date
DATE_WORDS = [
    "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december",
    "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct",
    "nov", "dec",
    "st", "nd", "rd", "th",
    "of", "the",
]
#: fixed values: names that say little
GENERIC = ["name", "id", "code", "type", "value", "key", "label"]
#: fixed values: targets that hold names of people, things or companies
NAME_LIKE = ["name", "developer", "publisher"]
#: fixed values: scores of the tiers, and the boost for values that fit
EXACT, NORMALISED, ALIAS, SYNONYM, FUZZY, FUZZY_BEST, DESCRIPTION = 1.0, 0.95, 0.9, 0.88, 0.80, 0.86, 0.85
BOOST = 0.04
RETAINED = 0.34


def target_table(spark: SparkSession, fields: list[Target]) -> DataFrame:
    """A row a target: what matching needs of it."""
    key = lambda name: " ".join(sorted(set(text.words_of(name))))
    rows = []
    for k, f in enumerate(fields):
        words = text.words_of(f.name)
        desc = [w for w in text.words_of(f.description) if w not in text.STOP and len(w) > 1]
        vocabulary = sorted({str(x).strip().lower() for x in [*f.enum, *f.aliases, *f.aliases.values()]})
        aliases = sorted({key(a) for a in f.aliases} - {""})
        rows.append((k, f.name, f.types, f.required, vocabulary, aliases, SYNONYMS.get(f.name, []), None if f.minimum is None else float(f.minimum), None if f.maximum is None else float(f.maximum), f.pattern or None, words, desc, bool(f.enum)))
    return spark.createDataFrame(rows, "ord int, target string, want array<string>, required boolean, vocabulary array<string>, aliases array<string>, synonyms array<string>, minimum double, maximum double, pattern string, t_tokens array<string>, t_desc array<string>, listed boolean")


def compatible(primary: Column, want: Column) -> Column:
    """Soft: a text may become anything, integers and numbers one another; else the type must be the target's."""
    numeric = F.arrays_overlap(want, F.array(F.lit("integer"), F.lit("number")))
    return F.array_contains(want, primary) | (primary == "string") | (primary.isin("integer", "number") & numeric)


def type_ok(jtype: Column, types: list[str]) -> Column:
    """Whether a JSON value of this type is one of the schema's; an array target takes arrays only."""
    if "array" in types:
        return jtype == "array"
    return jtype.isin(types) | ((jtype == "integer") & F.lit("number" in types))


def number_of(value: Column, jtype: Column) -> Column:
    """A value that is a number as a whole: plain, in percent, or a ratio."""
    t = F.trim(value)
    plain = F.trim(F.regexp_replace(t, "%$", ""))
    one = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
    top, bottom = (F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)\s*/\s*([0-9]+(?:\.[0-9]+)?)$", k).try_cast("double") for k in (1, 2))
    return F.when(jtype == "boolean", None).when(t.contains("/"), F.when(bottom != 0, top / bottom)).when(plain.rlike(f"^{one}$"), plain.try_cast("double"))


def fits_pattern(value: Column, pattern: Column) -> Column:
    """The value matches, or is a plausible date (no clock, no words but a date's) of which a part matches."""
    v = F.trim(value)
    parts = F.regexp_extract_all(v, F.lit(r"[^\s,/\-:]+"), F.lit(0))
    date = v.rlike("[0-9]") & F.forall(F.regexp_extract_all(F.lower(v), F.lit("[a-z]+"), F.lit(0)), lambda w: w.isin(DATE_WORDS))
    return F.regexp_like(v, pattern) | (~v.rlike("[0-9]{1,2}:[0-9]{2}") & date & F.exists(parts, lambda p: F.regexp_like(p, pattern)))


def region(value: Column) -> Column:
    return F.lower(F.trim(value)).isin(REGIONS)


def _fits() -> tuple[Column, Column, Column]:
    """Whether any example fits the target's pattern, range and vocabulary; null where the target has none."""
    seen = F.arrays_zip("examples", "example_types")
    pattern = F.when(F.col("pattern").isNotNull(), F.exists("examples", lambda x: fits_pattern(x, F.coalesce("pattern", F.lit("")))))
    limited = (F.col("minimum").isNotNull() | F.col("maximum").isNotNull()) & F.arrays_overlap("want", F.array(F.lit("integer"), F.lit("number")))
    inside = lambda n: n.isNotNull() & (n >= F.coalesce("minimum", F.lit(float("-inf")))) & (n <= F.coalesce("maximum", F.lit(float("inf"))))
    range_ = F.when(limited, F.exists(seen, lambda x: inside(number_of(x["examples"], x["example_types"]))))
    vocabulary = F.when(F.size("vocabulary") > 0, F.exists(seen, lambda x: (x["example_types"] == "string") & F.array_contains("vocabulary", F.lower(F.trim(x["examples"])))))
    return pattern, range_, vocabulary


def contradicted(fits: list[str]) -> Column:
    """By the columns of ``_fits`` no example fits the pattern, the range or the vocabulary; or a name's examples are all addresses, times or regions."""
    strings = F.transform(F.filter(F.arrays_zip("examples", "example_types"), lambda x: x["example_types"] == "string"), lambda x: F.trim(x["examples"]))
    odd = lambda v: v.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$") | v.rlike(r"^(?i:https?://|www\.)") | v.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")
    name = F.col("target").isin(NAME_LIKE) & ~F.col("listed") & F.col("pattern").isNull() & (F.size(strings) > 0)
    misfit = [~F.coalesce(x, F.lit(True)) for x in fits]
    return (F.size("examples") > 0) & (misfit[0] | misfit[1] | misfit[2] | (name & (F.forall(strings, odd) | F.forall(strings, region))))


def corroborated(fits: list[str]) -> Column:
    """Some example fits what the target declares, or both are lists."""
    pattern, range_, vocabulary = (F.coalesce(x, F.lit(False)) for x in fits)
    return (F.size("examples") > 0) & (pattern | range_ | vocabulary | (F.array_contains("want", F.lit("array")) & F.array_contains("types", F.lit("array"))))


def _together(tokens: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(tokens)), "")


def fuzzy_score(source: Column, target: Column) -> Column:
    """Of two token sets, each written together in order: edits within max(1, length / 4), lengths within 2; null beyond, and for common words."""
    a, b = _together(source), _together(target)
    budget = F.greatest(F.lit(1), F.floor(F.length(b) / 4).cast("int"))
    d = F.levenshtein(a, b)
    near = (F.abs(F.length(a) - F.length(b)) <= 2) & (F.length(b) >= 3) & (F.length(a) > 0)
    common = (F.size(F.array_distinct(source)) == 1) & F.array_join(source, "").isin(NO_TYPO) & ~F.arrays_overlap(source, target)
    return F.when(near & ~common & (d > 0) & (d <= budget), FUZZY + (1 - (d - 1) / budget) * (FUZZY_BEST - FUZZY))


def weak_overlap() -> Column:
    """A free text target shares only words that say little, and the source has a word of its own that the target doesn't know."""
    free = ~F.col("listed") & F.col("pattern").isNull() & F.col("minimum").isNull() & F.col("maximum").isNull()
    shared, extra = F.array_intersect("tokens", "t_tokens"), F.array_except("tokens", "t_tokens")
    foreign = F.array_except(extra, F.col("t_desc"))
    return free & (F.size(shared) > 0) & F.forall(shared, lambda w: w.isin(GENERIC)) & (F.size(foreign) > 0)


def candidates(profile: DataFrame, target: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pairs that can score at all: an equal name, alias or synonym, a word in common, or a length for a near spelling."""
    by = by or []
    tag = lambda kind, words: F.transform(words, lambda w: F.concat(F.lit(kind), w))
    length = F.length(_together(F.col("tokens")))
    own = F.concat(tag("set ", F.array(text.token_key(F.col("tokens")))), tag("word ", F.array_union("tokens", "desc_tokens")), tag("length ", F.array((length).cast("string"))))
    names = F.array_distinct(F.concat(F.array(text.token_key(F.col("t_tokens"))), F.col("aliases"), F.col("synonyms")))
    near = F.sequence(F.length(_together(F.col("t_tokens"))) - 2, F.length(_together(F.col("t_tokens"))) + 2)
    theirs = F.concat(tag("set ", names), tag("word ", F.array_union("t_tokens", "t_desc")), tag("length ", near.cast("array<string>")))
    keys = target.select("target", F.explode(theirs).alias("key"))
    met = profile.select(*by, "path", F.explode(F.array_distinct(own)).alias("key")).join(keys, "key")
    kind = F.col("key")
    pairs = met.groupBy(*by, "path", "target").agg(F.max(kind.startswith("set ")).alias("_set"), F.count_if(kind.startswith("word ")).alias("_n"), F.max(kind.startswith("length ")).alias("_near"))
    size = lambda c: F.size(F.array_distinct(c)).alias
    bag, want_bag = F.array_union("tokens", "desc_tokens"), F.array_union("t_tokens", "t_desc")
    left = profile.select("*", _together(F.col("tokens")).alias("_a"), size("tokens")("_own"), size(bag)("_bag"))
    right = target.select("*", _together(F.col("t_tokens")).alias("_b"), size("t_tokens")("_want"), size(want_bag)("_wbag"))
    both = pairs.join(left, [*by, "path"]).join(right, "target")
    # the words in common bound every overlap, the spelling every near miss: what is below either can't score
    bound = F.greatest(*[F.col("_n") / F.greatest(F.col(a) + F.col(b) - F.col("_n"), F.lit(1)) for a, b in (("_bag", "_wbag"), ("_own", "_wbag"), ("_bag", "_want"))])
    budget = F.greatest(F.lit(1), F.floor(F.length("_b") / 4).cast("int"))
    spelt = F.col("_near") & (F.levenshtein("_a", "_b") <= budget)
    return both.where(F.col("_set") | (bound >= RETAINED) | spelt).drop("_set", "_n", "_near", "_a", "_b", "_own", "_bag", "_want", "_wbag")


def scored(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The first tier that fits gives the score.  A list for a scalar is never taken; below the alias tier values have a veto."""
    tokens, want, bag, want_bag = F.col("tokens"), F.col("t_tokens"), F.array_union("tokens", "desc_tokens"), F.array_union("t_tokens", "t_desc")
    both = lambda a, b: F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(text.jaccard(a, b))
    fits = {f"_fits{k}": x for k, x in enumerate(_fits())}
    seen = pairs.withColumns({"_name": text.token_key(tokens), "_want": text.token_key(want), "_fuzzy": fuzzy_score(tokens, want), "_ok": compatible(F.coalesce(F.try_element_at("types", F.lit(1)), F.lit("null")), F.col("want")), **fits})
    seen = seen.withColumns({"_veto": contradicted(list(fits)), "_boost": F.when(corroborated(list(fits)), F.lit(BOOST)).otherwise(F.lit(0.0)), "_overlap": F.greatest(both(bag, want_bag), both(tokens, want_bag), both(bag, want)), "_weak": weak_overlap()})
    name, boost, ok, overlap, fuzzy = (F.col(c) for c in ("_name", "_boost", "_ok", "_overlap", "_fuzzy"))
    rules = [
        (F.col("path").endswith("[]") & ~F.array_contains("want", F.lit("array")), None, "arity"),
        ((F.size(tokens) > 0) & (tokens == want), F.lit(EXACT), "exact"),
        ((F.size(tokens) > 0) & (name == F.col("_want")), F.lit(NORMALISED), "normalized"),
        (F.array_contains("aliases", name), F.lit(ALIAS), "alias"),
        (F.col("_veto"), None, "contradicted"),
        (F.array_contains("synonyms", name) & ok, F.least(SYNONYM + boost, F.lit(ALIAS - 0.01)), "synonym"),
        (fuzzy.isNotNull() & ok, F.least(fuzzy + boost, F.lit(SYNONYM - 0.01)), "fuzzy"),
        ((overlap >= RETAINED) & ok & F.col("_weak"), None, "weak"),
        ((overlap >= RETAINED) & ok, F.least(DESCRIPTION + boost, F.lit(ALIAS - 0.01), 0.5 + overlap / 2 + boost), "description"),
    ]
    found = F
    for test, value, label in rules:
        score = F.lit(None).cast("double") if value is None else F.round(value, 12)
        found = found.when(test, F.struct(score.alias("score"), F.lit(label).alias("method")))
    return seen.select(*(by or []), "target", "path", found.alias("f")).where("f.score IS NOT NULL").select(*(by or []), "target", "path", "f.*")


def infer_mapping(profile: DataFrame, target: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A row a cluster and target: path, method, confidence, status, ranked candidates, note.  A tie at the top is a conflict unless names are equal; nothing needs review."""
    by = by or []
    found = scored(candidates(profile, target, by), by)
    ranked = found.groupBy(*by, "target").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "path", "method"))).alias("c"))
    every = profile.select(*by).distinct().crossJoin(target.select("ord", "target", "required")) if by else target.select("ord", "target", "required")  # clusters x columns of the schema: the result's own rows
    best, second = F.try_element_at("c", F.lit(1)), F.try_element_at("c", F.lit(2))
    tied = F.size(F.filter("c", lambda x: x.s == F.element_at("c", 1).s))
    tie = second.isNotNull() & (second["s"] == best["s"]) & ~best["method"].isin("exact", "normalized")
    score = -best["s"]
    return every.join(ranked, [*by, "target"], "left").select(
        *by, "ord", "target", "required",
        F.when(~F.coalesce(tie, F.lit(False)), best["path"]).alias("path"),
        F.coalesce(best["method"], F.lit("abstain")).alias("method"),
        F.coalesce(score, F.lit(0.0)).alias("confidence"),
        F.when(best.isNull(), "needs_review").when(F.coalesce(tie, F.lit(False)), "conflict").otherwise("mapped").alias("status"),
        F.coalesce(F.transform("c", lambda x: F.struct(x.path.alias("path"), (-x.s).alias("score"))), F.array().cast("array<struct<path:string,score:double>>")).alias("candidates"),
        F.when(best.isNull(), "no source field cleared the match floor").when(F.coalesce(tie, F.lit(False)), F.format_string("ambiguous: %d source fields tie at %.2f", tied, score)).otherwise("").alias("note"),
    )


def override(mapping: DataFrame, target: str, path: str | None) -> DataFrame:
    """A person's decision for one target: this path, or none; the candidates stay."""
    mine = F.col("target") == target
    new = {"path": F.lit(path).cast("string"), "method": F.lit("human"), "confidence": F.lit(1.0 if path else 0.0), "status": F.lit("mapped" if path else "needs_review"), "note": F.lit("human-mapped (field-by-field override)" if path else "human left unmapped (no viable source)")}
    return mapping.select(*[F.when(mine, new[c]).otherwise(F.col(c)).alias(c) if c in new else c for c in mapping.columns])


def open_candidates(mapping: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What a person may choose from, for each target that isn't mapped."""
    return mapping.where("status <> 'mapped'").select(*(by or []), "target", F.posexplode_outer("candidates").alias("rank", "c")).select(*(by or []), "target", "rank", "c.*")


PROVENANCE = "struct<target:string,status:string,path:string,method:string,confidence:double,raw:string,note:string>"


def execute(records: DataFrame, long: DataFrame, ids: list[str], mapping: DataFrame, fields: list[Target], by: list[str] | None = None) -> DataFrame:
    """Golden records: of every record of ``records(by, ids)`` each mapped path's value, converted, and where it came from.

    A value that is absent or can't be converted is null and needs review.  ``mapping`` joins as
    rows, and Spark broadcasts it if it is small.
    """
    by = by or []
    paths = mapping.where("status = 'mapped' AND path IS NOT NULL").select(*by, "path", "target")
    picked = long.join(paths, [*by, "path"])
    columns = []
    for f in fields:
        mine = F.col("target") == f.name
        columns.append(F.max(F.when(mine & ~F.col("path").endswith("[]"), F.struct("value", "jtype"))).alias(f"one_{f.name}"))
        if f.type == "array":
            columns.append(F.array_sort(F.collect_list(F.when(mine & F.col("path").endswith("[]") & (F.col("jtype") != "array"), F.struct("pos", "value")))).alias(f"all_{f.name}"))
    values = picked.groupBy(*by, *ids).agg(*columns)
    told = mapping.select(*by, F.struct("target", F.struct("path", "method", "confidence", "status", "note").alias("m")).alias("m"))
    told = told.groupBy(*by).agg(F.map_from_entries(F.collect_list("m")).alias("_m"))
    wide = records.select(*by, *ids).join(values, [*by, *ids], "left")
    wide = wide.join(told, by) if by else wide.crossJoin(F.broadcast(told))  # one row
    values, raws = [], []
    for k, f in enumerate(fields):
        one = F.col(f"one_{f.name}")
        value, raw = convert(f, one["value"], one["jtype"]), F.when(one["jtype"] != "null", one["value"])
        if f.type == "array":
            items = F.transform(f"all_{f.name}", lambda x: x.value)
            some = F.size(F.coalesce(items, F.array().cast("array<string>"))) > 0
            value, raw = F.when(some, items).otherwise(value), F.when(some, F.to_json(items)).otherwise(raw)
        values.append(value.alias(f.name))
        raws.append(raw.alias(f"_raw{k}"))
    wide = wide.select(*by, *ids, "_m", *values, *raws)  # converted once; what follows only looks at the columns
    provenance = []
    for k, f in enumerate(fields):
        value, raw, m = F.col(f"`{f.name}`"), F.col(f"_raw{k}"), F.try_element_at("_m", F.lit(f.name))
        note = F.when(m["status"] != "mapped", F.when(m["note"] == "", "unmapped").otherwise(m["note"])).when(raw.isNull(), "source value absent in this record").when(value.isNull(), f"could not produce a {f.type}").otherwise("")
        status = F.when(m["status"] == "conflict", "conflict").when((m["status"] != "mapped") | value.isNull(), "needs_review").otherwise("filled")
        provenance.append(F.struct(F.lit(f.name).alias("target"), F.coalesce(status, F.lit("needs_review")).alias("status"), m["path"].alias("path"), m["method"].alias("method"), m["confidence"].alias("confidence"), raw.alias("raw"), F.coalesce(note, F.lit("unmapped")).alias("note")))
    return wide.select(*by, *ids, *[f"`{f.name}`" for f in fields], F.array(*provenance).cast(f"array<{PROVENANCE}>").alias("provenance"))


def issues(fields: list[Target], produced: list[str], provenance: str | None = None) -> Column:
    """What is wrong with a golden record, as an array of structs (target, kind).

    With its provenance, a required target that was deferred is no error (nor is the record
    conformant), and a value whose source isn't told is ungrounded.
    """
    out = []
    for k, f in enumerate(fields):
        v = F.col(f"`{f.name}`")
        own = F.col(provenance)[k] if provenance else None  # it stands in the order of the fields

        def issue(test: Column, kind: str, name: str = f.name) -> Column:
            return F.when(test, F.struct(F.lit(name).alias("target"), F.lit(kind).alias("kind")))

        if f.required:
            deferred = F.coalesce(own["status"].isin("needs_review", "conflict"), F.lit(False)) if own is not None else F.lit(False)
            out.append(issue(v.isNull() & ~deferred, "missing_required"))
        if f.name not in produced:
            continue
        if f.enum and f.type != "array":
            out.append(issue(v.isNotNull() & ~v.isin(f.enum), "enum"))
        if f.enum and f.type == "array":
            out.append(issue(F.size(F.array_except(v, F.array(*map(F.lit, f.enum)))) > 0, "enum"))
        if f.pattern and f.type == "string":
            out.append(issue(v.isNotNull() & ~v.rlike(f"^(?:{f.pattern})"), "pattern"))
        if f.minimum is not None and f.type in ("integer", "number"):
            out.append(issue(v < f.minimum, "range"))
        if f.maximum is not None and f.type in ("integer", "number"):
            out.append(issue(v > f.maximum, "range"))
        if own is not None:
            out.append(issue(v.isNotNull() & ~F.coalesce((own["status"] == "filled") & (own["path"] != ""), F.lit(False)), "ungrounded"))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<struct<target:string,kind:string>>")


def conformant(fields: list[Target], found: str = "issues") -> Column:
    """No issue, and every required target present."""
    present = F.lit(True)
    for f in fields:
        if f.required:
            present = present & F.col(f"`{f.name}`").isNotNull()
    return (F.size(found) == 0) & present


def coverage(mapping: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mapped shares of all and of required targets."""
    hit = F.col("status") == "mapped"
    return mapping.groupBy(*(by or [])).agg(
        F.round(F.avg(hit.cast("int")), 6).alias("coverage"),
        F.round(F.avg(F.when(F.col("required"), hit.cast("int"))), 6).alias("required_coverage"),
        F.count_if(F.col("required") & hit).alias("required_mapped"),
    )


def relevance(required_coverage: Column, coverage_: Column, required_mapped: Column, dial: float = 0.5) -> Column:
    """convertible, review or reject; without required targets the whole coverage decides, and none at all is always a reject."""
    dial = min(1.0, max(0.0, dial))
    share = F.coalesce(required_coverage, coverage_)
    floor = F.when(required_coverage.isNotNull(), required_mapped == 0).otherwise(coverage_ == 0)
    return F.when(floor | (share < dial), "reject").when(share < dial + 0.2, "review").otherwise("convertible")


def pathway(rejected_band: Column, approved_band: Column, drifted: Column, verdict: Column, required_total: Column, research: bool = True) -> Column:
    """Where a cluster goes: declined, replay_clean, drift_repair, novel_research, review or reject_irrelevant.

    A shape near one that a person rejected is declined; one near an approved shape is replayed
    if nothing drifted; of the others relevance decides, and research may try what has required targets.
    """
    near = ["high", "moderate"]
    known = F.coalesce(approved_band, F.lit("none")).isin(near)
    return (
        F.when(F.coalesce(rejected_band, F.lit("none")).isin(near), "declined")
        .when(known & (approved_band == "high") & ~F.coalesce(drifted, F.lit(False)), "replay_clean")
        .when(known, "drift_repair")
        .when(verdict == "convertible", "novel_research" if research else "review")
        .when(verdict == "review", "review")
        .when(F.lit(research) & (required_total > 0), "novel_research")
        .otherwise("reject_irrelevant")
    )


def fill_rates(golden: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Share of records that fill each target, long."""
    wide = golden.groupBy(*by).agg(*[F.avg(F.col(f"`{c}`").isNotNull().cast("int")).alias(c) for c in columns])
    return wide.unpivot(by or None, columns, "target", "rate") if by else wide.unpivot([], columns, "target", "rate")


def behavioural_drift(baseline: DataFrame, now: DataFrame, by: list[str] | None = None, tolerance: float = 0.25) -> DataFrame:
    """Targets whose fill rate fell by more than the tolerance; a rate that is gone counts as 0."""
    drop = F.col("was") - F.coalesce("rate", F.lit(0.0))
    return baseline.withColumnRenamed("rate", "was").join(now, [*(by or []), "target"], "left").where(drop > tolerance).select(*(by or []), "target", F.round("was", 6).alias("was"), F.round(F.coalesce("rate", F.lit(0.0)), 6).alias("now"))


def align(docs: DataFrame, ids: list[str], column: str, fields: list[Target], by: list[str] | None = None, mapping: DataFrame | None = None) -> DataFrame:
    """Profile, map, execute, validate the records of every cluster at once: golden columns, provenance, issues, conformant."""
    from concord.operators import profile as p
    from concord.plans.storage import cut

    by = by or []
    long = cut(p.cells(docs, [*by, *ids], column), "cells")
    if mapping is None:
        total = p.totals(docs, column, by)
        mapping = cut(infer_mapping(p.profile(long, ids, by, total), target_table(docs.sparkSession, fields), by), "mapping")
    golden = execute(docs, long, ids, mapping, fields, by)
    found = issues(fields, [f.name for f in fields], "provenance")
    # written, so that a filter on what conforms looks at a column and is not pushed into every conversion
    return cut(golden, "golden").withColumn("issues", found).withColumn("conformant", conformant(fields))


def verified_proposals(open_: DataFrame, proposals: DataFrame, order: str) -> DataFrame:
    """Each open target's last proposal, if it holds: ``open_(target, want, candidates)``, where candidates are structs (path, primary); the path must be one of them, of a type that the target takes."""
    last = proposals.groupBy("target").agg(F.max_by("path", order).alias("path"))
    both = last.join(open_, "target").withColumn("c", F.try_element_at(F.filter("candidates", lambda c: c.path == F.col("path")), F.lit(1)))
    return both.where(F.col("c").isNotNull() & compatible(F.col("c.primary"), F.col("want"))).select("target", "path", F.lit("semantic").alias("method"))
