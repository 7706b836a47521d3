"""Names, tokens and hashed vectors as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: words that say nothing in a target's description
STOP = ["the", "a", "an", "of", "for", "to", "by", "in", "on", "and", "or", "this", "that", "value", "field", "given"]
#: fixed values: and in a source's
SOURCE_STOP = [*STOP, "with"]
#: fixed values: sentiment words
NEGATIVE = ["angry", "unacceptable", "wrong", "broken", "failed", "terrible", "furious", "disappointed", "escalate", "unhappy", "mistake", "error"]
POSITIVE = ["great", "thanks", "excellent", "good", "approved", "correct", "perfect"]
DIM = 256


def split_camel(name: Column) -> Column:
    return F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")


def name_tokens(name: Column) -> Column:
    """camelCase split, lower case, ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(split_camel(name)), F.lit("[a-z0-9]+"), F.lit(0))


def description_tokens(text: Column, stop: list[str] = SOURCE_STOP) -> Column:
    """Name tokens without stop words and single letters."""
    return F.filter(name_tokens(text), lambda w: (F.length(w) > 1) & ~w.isin(stop))


def words_of(name: str) -> list[str]:
    """Name tokens of a plain string, for the few names of a schema."""
    return re.findall("[a-z0-9]+", re.sub("(?<=[a-z0-9])(?=[A-Z])", " ", name).lower())


def token_key(tokens: Column) -> Column:
    """One string for a set of tokens."""
    return F.array_join(F.array_sort(F.array_distinct(tokens)), " ")


def normalise_path(path: Column) -> Column:
    """Each segment by its name tokens, and whether it is an array."""
    segment = lambda s: F.concat(F.array_join(name_tokens(F.regexp_replace(s, r"\[\]", "")), " "), F.when(s.endswith("[]"), "[]").otherwise(""))
    return F.array_join(F.transform(F.split(path, "[.]"), segment), ".")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def bigrams(s: Column) -> Column:
    return F.when(F.length(s) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text has."""
    q = F.array_distinct(query)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, text)) / F.size(q))


def hash_slot(token: Column) -> Column:
    """Dimension of a token: the last byte of its md5."""
    return F.conv(F.substring(F.md5(token), 31, 2), 16, 10).cast("int")


def hash_sign(token: Column) -> Column:
    """Sign of a token: the low bit of the byte before."""
    return F.when(F.conv(F.substring(F.md5(token), 30, 1), 16, 10).cast("int") % 2 == 1, F.lit(1)).otherwise(F.lit(-1))


def words_found(text: Column, words: list[str]) -> Column:
    """How many of the words the text holds, as substrings."""
    return sum((F.contains(F.lower(text), F.lit(w)).cast("int") for w in words), F.lit(0))


def sentiment(text: Column) -> Column:
    balance = words_found(text, NEGATIVE) - words_found(text, POSITIVE)
    return F.when(balance > 0, "negative").when(balance < 0, "positive").otherwise("neutral")


def casing(text: Column) -> Column:
    letters = F.regexp_replace(text, "[^A-Za-z]", "")
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))
    return (
        F.when(F.length(letters) == 0, "none")
        .when(letters == F.upper(letters), "upper")
        .when(F.forall(words, lambda w: F.substring(w, 1, 1) == F.upper(F.substring(w, 1, 1))), "title")
        .otherwise("sentence")
    )


def slug(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), "_")


def clean_name(name: Column) -> Column:
    """A field's name in words."""
    return F.lower(F.trim(F.regexp_replace(split_camel(name), r"[_\-]+", " ")))


def evidence(name: Column, description: Column, examples: Column) -> Column:
    """What a field is, in one line: its name, description and up to three examples of at most 80 characters."""
    shown = F.slice(F.filter(F.transform(F.coalesce(examples, F.array().cast("array<string>")), lambda e: F.substring(F.trim(e), 1, 80)), lambda e: F.coalesce(e, F.lit("")) != ""), 1, 3)
    told = F.when(F.size(shown) > 0, F.concat(F.lit("examples: "), F.array_join(shown, "; ")))
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.array_join(F.array_compact(F.array(some(clean_name(name)), some(description), told)), ". ")


def wrong_value(value: Column) -> Column:
    """A value that is certainly wrong: the last digit one up, or a mark behind it."""
    v = F.trim(value)
    head, digit, rest = (F.regexp_extract(v, r"(?s)^(.*)([0-9])([^0-9]*)$", k) for k in (1, 2, 3))
    return F.when(v.rlike("[0-9]"), F.concat(head, ((digit.cast("int") + 1) % 10).cast("string"), rest)).otherwise(F.concat(v, F.lit(" (DRAFT - unverified)")))


def tool_name(name: Column) -> Column:
    """A tool's name without a channel mark."""
    return F.trim(F.substring_index(F.coalesce(name, F.lit("")), "<|", 1))
