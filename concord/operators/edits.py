"""Edits that change what was meant and nothing else: whole units, sentences, token by token."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.operators.reconcile import squeezed


def guarded(intents: DataFrame, grounding: Column) -> DataFrame:
    """``intents(new_value, conflict)`` with the reason why one is not carried out: a conflict stays, an empty or ungrounded value is never written."""
    value = F.coalesce("new_value", F.lit(""))
    return intents.withColumn("refused", F.when(F.coalesce("conflict", F.lit(False)), "conflict-preserved").when(value == "", "no-value").when(~F.contains(squeezed(grounding), squeezed(value)), "ungrounded"))


def replaced(units: DataFrame, intents: DataFrame, key: str) -> DataFrame:
    """The corrected value in place of the whole unit."""
    mine = intents.where("refused IS NULL").select(key, "new_value")
    return units.join(mine, key, "left").withColumn("text", F.coalesce("new_value", "text")).drop("new_value")


def _sentences(text: str) -> list[str]:
    found = [p.strip() for p in re.findall(r"[^.!?]*[.!?]", text)]
    return [p for p in found if p] or ([text] if text.strip() else [])


def _plain(text: str) -> str:
    return re.sub(r"\s+", " ", text.strip().lower())


def spliced_text(paragraph: str, sentence: str) -> str:
    """A paragraph with the sentence that is most like the new one replaced by it."""
    own = _sentences(paragraph)
    if len(own) < 2:
        return sentence
    likeness = [difflib.SequenceMatcher(a=_plain(s), b=_plain(sentence)).ratio() for s in own]
    own[likeness.index(max(likeness))] = sentence.strip()
    return " ".join(own)


def tagged_text(before: str, after: str) -> str:
    """The words of ``before`` kept, deleted, replaced or added to until they are those of ``after``."""
    a, b, out = before.split(), after.split(), []
    for tag, i, j, k, m in difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes():
        out += a[i:j] if tag == "equal" else b[k:m]
    return " ".join(out)


def _rewritten(units: DataFrame, intents: DataFrame, key: str, rule) -> DataFrame:
    mine = intents.where("refused IS NULL").select(key, "new_value")
    hit = units.join(mine, key)  # only what is edited meets Python

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "text": [rule(t or "", v) for t, v in zip(batch["text"], batch["new_value"], strict=True)]})

    done = hit.select(key, "text", "new_value").mapInPandas(run, f"{key} {dict(units.dtypes)[key]}, text string").withColumnRenamed("text", "_new")
    return units.join(done, key, "left").withColumn("text", F.coalesce("_new", "text")).drop("_new")


def spliced(units: DataFrame, intents: DataFrame, key: str) -> DataFrame:
    """The likest sentence of a unit replaced; its other sentences stay word for word."""
    return _rewritten(units, intents, key, spliced_text)


def tagged(units: DataFrame, intents: DataFrame, key: str) -> DataFrame:
    """The likest sentence of a unit edited word by word."""

    def rule(paragraph: str, sentence: str) -> str:
        own = _sentences(paragraph)
        if len(own) < 2:
            return tagged_text(paragraph, sentence)
        likeness = [difflib.SequenceMatcher(a=_plain(s), b=_plain(sentence)).ratio() for s in own]
        at = likeness.index(max(likeness))
        own[at] = tagged_text(own[at], sentence)
        return " ".join(own)

    return _rewritten(units, intents, key, rule)


def resolved(corrections: DataFrame, decisions: DataFrame, target: str) -> DataFrame:
    """Corrections with a person's decisions as a round of their own, after all before; of several for a target the last counts."""
    last = corrections.agg((F.coalesce(F.max("round"), F.lit(-1)) + 1).alias("round"))
    chosen = decisions.groupBy(target).agg(F.max_by("new_value", "ord").alias("new_value"))
    return corrections.select(target, "new_value", "round").unionByName(chosen.crossJoin(F.broadcast(last)).select(target, "new_value", "round"))  # one row


def without(resolutions: DataFrame, targets: DataFrame, target: str) -> DataFrame:
    """Resolutions that were not taken back."""
    return resolutions.join(targets.select(target), target, "left_anti")
