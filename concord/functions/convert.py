"""Typed conversions that give null instead of a guess."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.functions.text import words_of

#: fixed values: date formats, in the order they are tried (day first before month first), each with the form of its texts
DATE_FORMATS = [
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("d.M.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
    ("MMMM d, yyyy", r"^[A-Z][a-z]+ \d{1,2}, \d{4}$"),
    ("MMM d, yyyy", r"^[A-Z][a-z]+ \d{1,2}, \d{4}$"),
    ("yyyy", r"^\d{4}$"),
]


@dataclass
class Target:
    """A column of the golden schema."""

    name: str
    types: list[str] = field(default_factory=lambda: ["string"])
    required: bool = False
    enum: list[str] = field(default_factory=list)
    aliases: dict[str, str] = field(default_factory=dict)
    format: str | None = None
    pattern: str | None = None
    minimum: float | None = None
    maximum: float | None = None
    description: str = ""

    @property
    def type(self) -> str:
        return self.types[0]


def targets(schema: dict) -> list[Target]:
    """The top-level properties of a JSON Schema, in order."""
    required = set(schema.get("required", []))
    out = []
    for name, p in schema.get("properties", {}).items():
        kind = p.get("type", "string")
        items = p.get("items") if isinstance(p.get("items"), dict) else {}
        out.append(Target(name, kind if isinstance(kind, list) else [kind], name in required, list(p.get("enum") or items.get("enum") or p.get("x-pydi-taxonomy") or []), dict(p.get("x-pydi-taxonomy-aliases") or {}), p.get("format"), p.get("pattern"), p.get("minimum"), p.get("maximum"), p.get("description", "")))
    return out


def cast_number(text: Column, integer: bool, jtype: Column | None = None) -> Column:
    """A plain number (commas dropped).  An integer target cuts a JSON number, but refuses a text with a fraction."""
    plain = F.regexp_replace(F.trim(text), ",", "")
    number = F.when(plain.rlike(r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), plain.try_cast("double"))
    if not integer:
        return number
    digits = plain.rlike("^[+-]?[0-9]{1,18}$")  # as they stand: a double would round them
    whole = F.when(digits, plain.try_cast("long")).when(number == F.floor(number), number.try_cast("long"))
    return whole if jtype is None else F.when(jtype == "number", number.try_cast("long")).otherwise(whole)


def parse_date(text: Column, year_only: bool = False) -> Column:
    """An ISO date, or the year, by the first format that fits; ISO dates are taken as they stand."""
    t = F.trim(text)
    named = F.when(t.rlike("^[A-Za-z]"), F.initcap(F.lower(t))).otherwise(t)
    found = F.coalesce(*[F.when(named.rlike(form), F.try_to_date(named, f)) for f, form in DATE_FORMATS])
    iso = t.rlike(r"^\d{4}-\d{2}-\d{2}$")
    if year_only:
        return F.when(t.rlike("^[0-9]{4}$"), t).when(iso, F.substring(t, 1, 4)).otherwise(F.date_format(found, "yyyy"))
    return F.when(iso, t).otherwise(F.date_format(found, "yyyy-MM-dd"))


def apply_alias(value: Column, aliases: dict[str, str]) -> Column:
    if not aliases:
        return value
    pairs = F.create_map(*[F.lit(x) for kv in sorted(aliases.items()) for x in kv])
    return F.coalesce(F.try_element_at(pairs, value), value)


def coerce_enum(value: Column, enum: list[str], aliases: dict[str, str]) -> Column:
    v = apply_alias(value, aliases)
    return F.when(v.isin(enum), v)


def split_list(text: Column, aliases: dict[str, str] | None = None) -> Column:
    parts = F.filter(F.transform(F.split(text, "[;,/|]"), lambda s: F.trim(s)), lambda s: s != "")
    return F.transform(parts, lambda s: apply_alias(s, aliases or {})) if aliases else parts


def wants_year(t: Target) -> bool:
    pattern = t.pattern or ""
    return (r"\d{4}" in pattern and r"\d{2}" not in pattern) or "year" in words_of(t.name)


def wants_date(t: Target) -> bool:
    return t.format == "date" or wants_year(t) or r"\d{4}-\d{2}-\d{2}" in (t.pattern or "") or "date" in words_of(t.name)


def convert(t: Target, value: Column, jtype: Column) -> Column:
    """One expression for a target column; null where the value can't be converted."""
    if t.type == "array":
        parts = split_list(value, t.aliases)
        return F.when((jtype == "string") & (F.size(parts) > 0), parts)
    plain = ~jtype.isin("array", "object", "null")
    if t.enum:
        return F.when(plain, coerce_enum(value, t.enum, t.aliases))
    if t.type in ("integer", "number"):
        return F.when(jtype.isin("integer", "number", "string"), cast_number(value, t.type == "integer", jtype))
    if t.type != "string":
        return F.lit(None).cast("string")
    if wants_date(t):
        year = wants_year(t)
        date = F.when(jtype == "string", parse_date(value, year_only=year))
        return date.when((jtype == "integer") & value.rlike("^[1-9][0-9]{3}$"), value) if year else date
    return F.when(plain, apply_alias(value, t.aliases))
