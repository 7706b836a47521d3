"""Variations of clean records: restyled and opaque keys, nesting, other notations, wide schemas."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.functions.convert import Target

#: fixed values: notations that an ISO date is written anew in
NOTATIONS = ["dd/MM/yyyy", "MM/dd/yyyy", "MMMM dd, yyyy", "dd-MM-yyyy"]
#: fixed values: neighbours on a keyboard
ROWS = ["qwertyuiop", "asdfghjkl", "zxcvbnm"]


def restyled(key: Column, knob: str) -> Column:
    """A key in camel case, with hyphens, or between affixes."""
    if knob == "case":
        words = F.split(F.replace(key, F.lit("-"), F.lit("_")), "_")
        return F.concat(F.element_at(words, 1), F.array_join(F.transform(F.slice(words, 2, F.size(words)), lambda w: F.initcap(w)), ""))
    if knob == "delimiter":
        return F.replace(key, F.lit("_"), F.lit("-"))
    return F.concat(F.lit("src_"), key, F.lit("_v2"))


def redated(iso: Column, which: Column) -> Column:
    """An ISO date, or the first day of a year, in another notation; anything else as it is."""
    day = F.coalesce(F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(iso, "yyyy-MM-dd")), F.when(iso.rlike(r"^\d{4}$"), F.try_to_date(iso, "yyyy")))
    told = F.coalesce(*[F.when(which == k, F.date_format(day, f)) for k, f in enumerate(NOTATIONS)])
    return F.coalesce(told, iso)


def boolean_variant(value: Column, which: Column) -> Column:
    """yes/no, 1/0 or true/false."""
    return F.when(which == 0, F.when(value, "yes").otherwise("no")).when(which == 1, F.when(value, "1").otherwise("0")).otherwise(F.when(value, "true").otherwise("false"))


def misspelt(word: Column, seed: Column) -> Column:
    """A word with one letter replaced by its neighbour on the keyboard; the same seed gives the same slip."""
    at = F.pmod(F.xxhash64(word, seed), F.greatest(F.length(word), F.lit(1))).cast("int") + 1
    letter = F.lower(F.substring(word, at, F.lit(1)))
    near = F.create_map(*[F.lit(x) for row in ROWS for k, c in enumerate(row) for x in (c, row[k + 1] if k + 1 < len(row) else row[k - 1])])
    other = F.coalesce(F.try_element_at(near, letter), letter)
    return F.concat(F.substring(word, F.lit(1), at - 1), other, F.substring(word, at + 1, F.length(word)))


def wide_schema(width: int) -> list[Target]:
    """So many text fields, the first two required."""
    return [Target(f"field_{k}", required=k < 2, description=f"value number {k}") for k in range(width)]


LEVELS = ["case", "affix", "nest", "array_wrap", "opaque", "described"]


def variation(records: list[dict], level: str) -> tuple[list[dict], dict[str, str]]:
    """Golden records as a team with its own habits would write them, and the path of each target."""
    names = list(dict.fromkeys(k for r in records for k in r))

    def key(name: str, k: int) -> str:
        if level == "case":
            return re.sub("(?<=[a-z0-9])(?=[A-Z])", "_", name).upper()
        if level == "affix":
            return f"src_{name}_v2"
        return f"f{k + 1:02}" if level in ("opaque", "described") else name

    keys = {n: key(n, k) for k, n in enumerate(names)}
    made, paths = [], {}
    for r in records:
        row = {keys[n]: [v] if level == "array_wrap" and not isinstance(v, list) else v for n, v in r.items()}
        made.append({"payload": row} if level == "nest" else row)
        for n, v in r.items():
            paths[n] = ("payload." if level == "nest" else "") + keys[n] + ("[]" if isinstance(v, list) or level == "array_wrap" else "")
    return made, paths
