"""Personal data by candidate gradient boosting, in DataFrame operations only.

Base spans follow four fixed patterns with their checks and are always kept.  Beyond them,
high-recall generators propose spans that may overlap (long mixed tokens, labelled secrets,
social security numbers, account numbers, numbers grouped like phone numbers); boosted trees
judge each by its format and the words before it; spans over the calibrated threshold are kept,
likeliest first, that overlap neither a base span nor one kept before.  The trees are fitted on
the driver from labelled examples written by a seeded generator and applied as an SQL expression.

Patterns are written so that they are scanned in linear time and without recursion: possessive
repeats, and starts only where a run of the pattern's first characters begins or the last match
ended; what they match is the contract's leftmost non-overlapping matches.

Places are code points, ends exclusive.  Edge cases: a null or empty text has no spans;
repeated rows get equal results; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .boosting import BoostedTrees

LOCAL = "[A-Za-z0-9._%+-]"
#: kind -> pattern; fixed values up to possessive repeats and run starts
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
VALID = {
    "email": "true",
    "ip": "NOT exists(split(x.m, '[.]'), p -> NOT p RLIKE '^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$')",
    "card": "length(regexp_replace(x.m, '[^0-9]', '')) BETWEEN 14 AND 19 AND luhn_check(regexp_replace(x.m, '[^0-9]', ''))",
    "phone": "length(regexp_replace(x.m, '[^0-9]', '')) BETWEEN 10 AND 15",
}
GENERATORS = {
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{16,}+",
    "labelled": r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|token|secret|api[_-]?key)[\x20]{0,2}[:=][\x20]{0,2}[\"']?[^\s\"',;]{6,}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3}+)?(?![A-Za-z0-9])",
    "number": r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
}
KINDS = [*BASE, *GENERATORS]
SPAN = "struct<s:bigint,e:bigint,m:string,b:string>"
CONTEXT = 24  # characters before a candidate
LABELS = r"(?i)(?:pass|pwd|token|secret|key|auth|ssn|social|iban|account|phone|tel|call|mobile|fax)"
PREFIXES = r"^(?:AKIA|ASIA|gh[pousr]_|sk-|sk_|xox[abp]-|AIza)"
VOID = r"^(?:000|666|9[0-9][0-9])-[0-9][0-9]-"  # numbers never issued
FEATURES = {
    "size": "cast(length(x.m) as double)",
    "digits": "cast(length(regexp_replace(x.m, '[^0-9]', '')) as double) / length(x.m)",
    "upper": "cast(length(regexp_replace(x.m, '[^A-Z]', '')) as double) / length(x.m)",
    "lower": "cast(length(regexp_replace(x.m, '[^a-z]', '')) as double) / length(x.m)",
    "marks": "cast(length(regexp_replace(x.m, '[A-Za-z0-9]', '')) as double)",
    "label": f"CASE WHEN x.b RLIKE '{LABELS}' OR x.m RLIKE '^{LABELS}' THEN 1D ELSE 0D END",
    "prefix": f"CASE WHEN x.m RLIKE '{PREFIXES}' THEN 1D ELSE 0D END",
    "void": f"CASE WHEN x.m RLIKE '{VOID}' THEN 1D ELSE 0D END",
    "turns": "cast(size(split(x.m, '(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])', -1)) as double) / length(x.m)",
}


def _features(kind: int, text: str, before: str) -> list[float]:
    """The same features in Python, for fitting."""
    import re

    n = len(text)
    share = [sum(map(f, text)) / n for f in (lambda c: c in "0123456789", lambda c: "A" <= c <= "Z", lambda c: "a" <= c <= "z")]
    labelled = bool(re.search(LABELS, before) or re.match(LABELS, text))
    turns = len(re.split(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", text)) / n
    return [float(n), *share, float(sum(not (c.isascii() and c.isalnum()) for c in text)), float(labelled), float(bool(re.search(PREFIXES, text))), float(bool(re.search(VOID, text))), turns, float(kind)]


def examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Labelled candidates of every generator: secrets and numbers of people, and things that look like them."""
    rng = np.random.default_rng(seed)
    pick = lambda letters, k: "".join(rng.choice(list(letters), k))
    upper, hexes, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdef", "0123456789"
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"
    words = ["the", "report", "version", "table", "chapter", "build", "order", "section", "page", "see", "from", "item"]
    hints = {"secret": ["key: ", "token = ", "secret=", "auth "], "labelled": [""], "ssn": ["ssn ", "social security "], "iban": ["iban ", "account "], "number": ["call ", "phone ", "tel. ", "fax "]}
    good = {
        "secret": [lambda: "AKIA" + pick(upper, 16), lambda: "ghp_" + pick(base64, 36), lambda: pick(hexes, 40), lambda: pick(base64, 32), lambda: pick(hexes, 18)],
        "labelled": [lambda: "password=" + pick(hexes, 18), lambda: 'token = "' + pick(hexes, 40), lambda: "api_key: " + pick(base64, 24), lambda: "pwd=" + pick(base64, 9), lambda: "token: " + ".".join(pick(base64, int(k)) for k in rng.integers(30, 300, 3)), lambda: "secret=" + pick(base64 + "+/.:!$=", int(rng.integers(65, 500)))],
        "ssn": [lambda: f"{pick(digits, 3)}-{pick(digits, 2)}-{pick(digits, 4)}"],
        "iban": [lambda: "DE" + pick(digits, 20), lambda: f"GB{pick(digits, 2)} WEST {pick(digits, 4)} {pick(digits, 4)} {pick(digits, 4)}"],
        "number": [lambda: f"({pick(digits, 3)}) {pick(digits, 3)}-{pick(digits, 4)}", lambda: f"{pick(digits, 3)}-{pick(digits, 3)}-{pick(digits, 4)}"],
    }
    bad = {
        "secret": [lambda: "_".join(rng.choice(words, 3)) + "_2", lambda: pick(digits, 17), lambda: f"20{pick(digits, 2)}-{'-'.join(rng.choice(words, 3))}", lambda: "/".join(rng.choice(words, 4)) + "/1"],
        "labelled": [lambda: "token: " + str(rng.choice(words)) + "based", lambda: "secret = " + str(rng.choice(words)) + "ing", lambda: "token: " + "-".join(rng.choice(words, rng.integers(12, 60)))],
        "ssn": [lambda: f"{pick('0', 3)}-{pick(digits, 2)}-{pick(digits, 4)}"],
        "iban": [lambda: "AB12 " + " ".join(["WORD", "THAT", "GOES"])],
        "number": [lambda: f"{pick(digits, 2)} {pick(digits, 3)} {pick(digits, 3)}", lambda: f"20{pick(digits, 2)}.{pick(digits, 3)}.{pick(digits, 3)}"],
    }
    x, y = [], []
    for _ in range(n):
        kind = str(rng.choice(list(GENERATORS)))
        real = bool(rng.random() < 0.5)
        make = (good if real else bad)[kind]
        text = make[rng.integers(len(make))]()
        before = str(rng.choice(hints[kind] if rng.random() < (0.6 if real else 0.1) else words)) + " "
        x.append(_features(KINDS.index(kind), text, before[-CONTEXT:]))
        y.append(float(real))
    return np.array(x), np.array(y)


@lru_cache
def model(examples_n: int = 4000, precision: float = 0.99) -> tuple[BoostedTrees, float]:
    """The trees and their threshold, from ``examples_n`` written examples: a bound that no input moves."""
    x, y = examples(examples_n, 7)
    trees = BoostedTrees().fit(x, y)
    return trees, math.floor(max(0.5, trees.threshold(x, y, precision)) * 1e6) / 1e6  # not rounded up: many examples stand at the threshold


def _spans(df: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """All matches with places: ends are sums of what stands between matches, summed by chunks of 256."""
    quoted = F.lit(pattern)
    some = F.col(text).rlike(pattern)
    m, p, z, c = (f"{name}_{x}" for x in "mpzc")
    df = df.withColumn(m, F.when(some, F.regexp_extract_all(text, quoted, F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(p, F.when(F.size(m) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(z, F.expr(f"transform(`{m}`, (x, i) -> cast(length(`{p}`[i]) + length(x) as bigint))"))
    df = df.withColumn(c, F.expr(f"transform(sequence(0, (size(`{z}`) - 1) div 256), k -> aggregate(slice(`{z}`, cast(k * 256 + 1 as int), 256), 0L, (a, x) -> a + x))"))
    df = df.withColumn(c, F.expr(f"transform(`{c}`, (x, k) -> aggregate(slice(`{c}`, 1, k), 0L, (a, x) -> a + x))"))
    end = f"(`{c}`[i div 256] + aggregate(slice(`{z}`, cast((i div 256) * 256 + 1 as int), cast(i % 256 + 1 as int)), 0L, (a, x) -> a + x))"
    placed = f"transform(transform(`{m}`, (x, i) -> struct(x as m, {end} as e, right(`{p}`[i], {CONTEXT}) as b)), x -> named_struct('s', x.e - length(x.m), 'e', x.e, 'm', x.m, 'b', x.b))"
    return df.withColumn(name, F.when(F.size(m) > 0, F.expr(placed)).otherwise(F.array().cast(f"array<{SPAN}>"))).drop(m, p, z, c)


def _chained(spans: str, item: str) -> str:
    """Spans in order of place, as an array of chains: each begins where all before it have ended.  One step a span."""
    start = f"named_struct('done', cast(array() as array<array<{item}>>), 'now', cast(array() as array<{item}>), 'end', -1L)"
    new = f"named_struct('done', CASE WHEN size(a.now) = 0 THEN a.done ELSE array_append(a.done, a.now) END, 'now', array_append(cast(array() as array<{item}>), x), 'end', x.e)"
    more = "named_struct('done', a.done, 'now', array_append(a.now, x), 'end', greatest(a.end, x.e))"
    return f"aggregate({spans}, {start}, (a, x) -> CASE WHEN x.s < a.end THEN {more} ELSE {new} END, a -> CASE WHEN size(a.now) = 0 THEN a.done ELSE array_append(a.done, a.now) END)"


def scan(docs: DataFrame, name: str = "pii") -> DataFrame:
    """``docs`` with a struct column: base and spans, arrays of (s, k, e, kind) in order of place and kind."""
    trees, limit = model()
    given = docs.columns
    text = common.free_name(docs, "_text")
    df = docs.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit("")))
    labels = {k: common.free_name(docs, f"_{k}") for k in KINDS}
    for kind in KINDS:
        df = _spans(df, text, BASE.get(kind) or GENERATORS[kind], labels[kind])
    base = [F.expr(f"transform(filter(`{labels[kind]}`, x -> {VALID[kind]}), x -> named_struct('s', x.s, 'k', {k}, 'e', x.e, 'kind', '{kind}'))") for k, kind in enumerate(BASE)]
    first = common.free_name(df, "_base")
    df = df.withColumn(first, F.array_sort(F.concat(*base)))
    proposed = []
    for kind in GENERATORS:
        k = KINDS.index(kind)
        score = trees.sql([*[f"({e})" for e in FEATURES.values()], f"{k}D"])
        proposed.append(F.expr(f"filter(transform(`{labels[kind]}`, x -> named_struct('s', x.s, 'k', {k}, 'e', x.e, 'kind', '{kind}', 'p', {score})), x -> x.p >= {limit!r}D)"))
    more = common.free_name(df, "_more")
    df = df.withColumn(more, F.concat(*proposed))
    # Spans that overlap in a chain are settled among themselves: base spans come first; then the
    # likeliest proposal (then the longest, then the earlier kind) that overlaps none kept before.
    item = "struct<s:bigint,k:int,e:bigint,kind:string,p:double>"
    based = f"transform(`{first}`, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e, 'kind', x.kind, 'p', 2D))"
    free = "filter(c, x -> x.p < 2D AND NOT exists(c, y -> y.p = 2D AND y.s < x.e AND x.s < y.e))"
    ranked = f"array_sort(transform({free}, x -> named_struct('p', -x.p, 'size', x.s - x.e, 'k', x.k, 's', x.s, 'e', x.e, 'kind', x.kind)))"
    span = "struct<s:bigint,k:int,e:bigint,kind:string>"
    kept = f"aggregate({ranked}, cast(array() as array<{span}>), (a, x) -> CASE WHEN exists(a, y -> y.s < x.e AND x.s < y.e) THEN a ELSE array_append(a, named_struct('s', x.s, 'k', x.k, 'e', x.e, 'kind', x.kind)) END)"
    chains = _chained(f"array_sort(concat({based}, cast(`{more}` as array<{item}>)))", item)
    df = df.withColumn(more, F.when(F.size(more) > 0, F.expr(f"flatten(transform({chains}, c -> {kept}))")).otherwise(F.array().cast(f"array<{span}>")))
    result = F.struct(F.col(first).alias("base"), F.array_sort(F.concat(F.col(first), F.col(more))).alias("spans"))
    return df.select(*[F.col(f"`{c}`") for c in given], result.alias(name))


def joined(spans: str) -> Column:
    return F.array_join(F.expr(f"transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e))"), ",")


def digest(scanned: DataFrame, name: str = "pii") -> DataFrame:
    """The columns of the contract, and the number of all spans."""
    counts = [F.expr(f"cast(size(filter({name}.base, x -> x.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind in BASE]
    return scanned.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(joined(f"{name}.base"), 256).alias("base_sha256"), joined(f"{name}.spans").alias("spans"), F.size(f"{name}.spans").cast("long").alias("n_spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each run of spans replaced by its kind in brackets; overlapping spans become one."""
    name = common.free_name(docs, "pii")
    df = scan(docs, name)
    # a run of overlapping spans has the kind of its first: of those that begin there the longest, then the earlier kind
    item = "struct<s:bigint,k:int,e:bigint,kind:string>"
    cuts = common.free_name(df, "_cuts")
    chains = _chained(f"array_sort({name}.spans)", item)
    led = "array_min(transform(filter(c, x -> x.s = c[0].s), x -> named_struct('e', -x.e, 'k', x.k, 'kind', x.kind))).kind"
    df = df.withColumn(cuts, F.expr(f"transform({chains}, c -> named_struct('s', c[0].s, 'kind', {led}, 'e', array_max(transform(c, x -> x.e))))"))
    pieces = F.expr(
        f"concat(array_join(transform(`{cuts}`, (x, i) -> concat(substring(text, cast(CASE WHEN i = 0 THEN 0 ELSE `{cuts}`[i - 1].e END + 1 as int), cast(x.s - CASE WHEN i = 0 THEN 0 ELSE `{cuts}`[i - 1].e END as int)), '[', upper(x.kind), ']')), ''), substring(text, cast(element_at(`{cuts}`, -1).e + 1 as int)))"
    )
    clean = F.when(F.size(cuts) > 0, pieces).otherwise(F.col("text"))
    return df.select(*[clean.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
