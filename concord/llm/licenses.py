"""Licence scan by a positional rare-token index, in DataFrame operations only.

The index holds the words of the licence templates by position, and each word's inverse document
frequency over all documents.  A start (word position less template position) counts if the
template's mandatory key phrase stands at its place there.  At each such start the words that
agree with the template's are met, and of these the ones with the highest IDF are looked up; so
no notice takes from another, whatever else the file holds, and a whole notice scores 1.  The
score is the IDF mass met of the template's rare words.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z in lower case.  The base labels are
plain phrase places and always kept.

Edge cases: a null or empty text has no words, empty labels and score 0; repeated rows get
equal results; rows are told apart by a number given as they are written; an empty table gives an
empty result; other columns are kept.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: fixed values: the contract's phrases and labels
BASE = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
#: fixed values: notices of known licences, with label and mandatory key phrase
TEMPLATES = [
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    ("gpl", "general public license", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "general public license", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "lesser general public license", "under the terms of the gnu lesser general public license"),
    ("agpl", "affero general public license", "under the terms of the gnu affero general public license"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "into the public domain", "free and unencumbered software released into the public domain"),
    ("isc", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose"),
]
RARE_WORDS = 8  # of a start, looked up in the index
ACCEPT = 0.5  # share of the template's rare mass


def _vocabulary() -> list[str]:
    return sorted({w for _, _, text in TEMPLATES for w in text.split()} | {w for p in BASE for w in p})


def _lower(text: Column) -> Column:
    """Lower case; of other letters only the Kelvin sign would become ASCII, so it is put out of the way."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00c5")))


def _maybe(low: str) -> Column:
    """What every text with a base or key phrase fulfils: it holds the phrase's longest word, or the whole phrase where that word is short."""
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    tests = {}
    for phrase in sorted({tuple(k.split()) for _, k, _ in TEMPLATES} | set(BASE)):
        word = max(phrase, key=len)
        tests[word if len(word) > 5 else phrase] = F.contains(low, F.lit(word)) if len(word) > 5 else F.rlike(low, F.lit(gap.join(phrase)))
    return reduce(Column.__or__, tests.values())


def _places(hits: str, phrase: tuple[str, ...]) -> Column:
    """Positions where the phrase's words stand consecutively; hits: all vocabulary words in order."""
    follow = " and ".join(f"get({hits}, j + {k}).w = '{w}' and get({hits}, j + {k}).i = x.i + {k}" for k, w in enumerate(phrase) if k)
    test = f"x.w = '{phrase[0]}'" + (f" and coalesce({follow}, false)" if follow else "")
    return F.expr(f"transform(filter({hits}, (x, j) -> {test}), x -> x.i)")


def _windows(hits: str, key: str) -> Column:
    """The key phrase's places with the hits around: all that a template with this key may meet there."""
    phrase = key.split()
    sides = [(at, len(text.split()) - at) for _, k, text in TEMPLATES if k == key for at in [_key_at(k, text)]]
    before, after = (max(x) for x in zip(*sides, strict=True))
    follow = " and ".join(f"get({hits}, j + {k}).w = '{w}' and get({hits}, j + {k}).i = x.i + {k}" for k, w in enumerate(phrase) if k)
    near = f"slice({hits}, greatest(j - {before}, 0) + 1, {before + after})"
    return F.expr(f"filter(transform({hits}, (x, j) -> CASE WHEN x.w = '{phrase[0]}' AND {follow} THEN named_struct('key', '{key}', 'i', x.i, 'near', {near}) END), x -> x IS NOT NULL)")


def _key_at(key: str, text: str) -> int:
    own, phrase = text.split(), key.split()
    return next(i for i in range(len(own)) if own[i : i + len(phrase)] == phrase)


def _tagged(places: Column, field: str, value: str) -> Column:
    return F.transform(places, lambda i: F.struct(F.lit(value).alias(field), i.alias("i")))


def facts(docs: DataFrame, keep: list[str], names: dict[str, str]) -> DataFrame:
    """One reading of the texts, written once: the kept columns, a row number, the number of words,
    the vocabulary words seen, and, of texts that may hold a phrase, the places of vocabulary words."""
    low, words, maybe = (common.free_name(docs, f"_{x}") for x in ("low", "words", "maybe"))
    listed = F.array(*map(F.lit, _vocabulary()))
    quoted = ", ".join(f"'{w}'" for w in _vocabulary())
    kept = [F.col(f"`{c}`") for c in keep]
    hits = names["hits"]
    none = F.array().cast("array<struct<i:bigint,w:string>>")
    out = docs.select(*kept, _lower(F.col("text").cast("string")).alias(low))
    out = out.select(*kept, F.regexp_extract_all(low, F.lit(WORD), F.lit(0)).alias(words), _maybe(low).alias(maybe))
    out = out.select(
        *kept,
        F.monotonically_increasing_id().alias(names["row"]),
        F.size(words).cast("long").alias(names["n_words"]),
        F.array_intersect(listed, words).alias(names["seen"]),
        F.when(F.col(maybe), F.expr(f"filter(transform(`{words}`, (w, i) -> struct(cast(i as bigint) as i, w as w)), x -> x.w in ({quoted}))")).otherwise(none).alias(hits),
    )
    return common.cut(out, "license")


def inverse_frequencies(seen: DataFrame, column: str) -> dict[str, float]:
    """IDF of the vocabulary over all documents: as many rows as the vocabulary has words, and one more."""
    words = F.explode(F.array_append(column, F.lit(""))).alias("w")
    counts = {r["w"]: r["n"] for r in seen.select(words).groupBy("w").agg(F.count("*").alias("n")).collect()}
    return {w: math.log((1 + counts.get("", 0)) / (1 + counts.get(w, 0))) + 1 for w in _vocabulary()}


def scan(docs: DataFrame, name: str = "license", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or only its columns ``keep``) with a struct column: n_words, places (of base phrases), base_labels, labels, score."""
    spark = docs.sparkSession
    given = docs.columns if keep is None else keep
    names = {x: common.free_name(docs, f"_{x}") for x in ("row", "n_words", "seen", "hits", "base", "keys")}
    table = facts(docs, given, names)
    idf = inverse_frequencies(table, names["seen"])
    base = [_tagged(_places(names["hits"], p), "label", label) for p, label in BASE.items()]
    keys = [_windows(names["hits"], k) for k in sorted({k for _, k, _ in TEMPLATES})]
    hit = table.where(F.size(names["hits"]) > 0).select("*", F.concat(*base).alias(names["base"]), F.concat(*keys).alias(names["keys"]))

    # the index: a row a template, with its words by position
    rows = []
    for label, key, text in TEMPLATES:
        own = text.split()
        mass = sum(sorted((idf[w] for w in own), reverse=True)[:RARE_WORDS])
        listed, weights = ", ".join(f"'{w}'" for w in own), ", ".join(f"{idf[w]!r}D" for w in own)
        rows.append(f"('{label}', '{key}', {_key_at(key, text)}L, array({listed}), array({weights}), {mass!r}D)")
    index = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS i(label, key, key_at, words, idf, mass)")

    places = hit.where(F.size(names["keys"]) > 0).select(F.col(names["row"]).alias("d"), F.explode(names["keys"]).alias("x"))
    starts = places.join(F.broadcast(index), F.col("x.key") == index["key"]).select("d", "label", "words", "idf", "mass", "x.near", (F.col("x.i") - F.col("key_at")).alias("start"))
    place = "cast(y.i - start as int)"
    met = starts.select("d", "label", "mass", F.expr(f"transform(filter(near, y -> get(words, {place}) = y.w), y -> struct(-get(idf, {place}) as r, y.w as w))").alias("met"))
    rare = met.select("d", "label", "mass", "met", F.slice(F.array_sort(F.array_distinct("met")), 1, RARE_WORDS).alias("rare"))
    summed = "aggregate(filter(met, y -> array_contains(rare, y)), 0D, (a, y) -> a - y.r)"
    whole = rare.select("d", "label", F.least(F.lit(1.0), F.round(F.expr(summed) / F.col("mass"), 9)).alias("score"))
    found = whole.groupBy("d").agg(F.max("score").alias("score"), F.collect_set(F.when(F.col("score") >= ACCEPT, F.col("label"))).alias("more"))
    plain = F.array_distinct(F.transform(names["base"], lambda x: x.label))
    result = F.struct(
        F.col(names["n_words"]).alias("n_words"),
        F.col(names["base"]).alias("places"),
        F.array_join(F.array_sort(plain), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(plain, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
    joined = hit.join(found, hit[names["row"]] == found["d"], "left").select(*[hit[c] for c in given], result.alias(name))
    # texts that hold no phrase need no join
    bare = F.struct(
        F.col(names["n_words"]).alias("n_words"),
        F.array().cast("array<struct<label:string,i:bigint>>").alias("places"),
        F.lit("").alias("base_labels"),
        F.lit("").alias("labels"),
        F.lit(0.0).alias("score"),
    )
    return joined.unionByName(table.where(F.size(names["hits"]) == 0).select(*[F.col(f"`{c}`") for c in given], bare.alias(name)))


def digest(scanned: DataFrame, name: str = "license") -> DataFrame:
    """The columns of the contract."""
    starts = F.transform(f"{name}.places", lambda x: x.i)
    return scanned.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        f"{name}.n_words",
        F.size(f"{name}.places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        f"{name}.base_labels",
        f"{name}.labels",
        f"{name}.score",
    )
