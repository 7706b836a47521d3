"""Predicted against true pairs, and values against expected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def precision_recall(predicted: DataFrame, gold: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision (1 without predictions), recall, f1."""
    by = by or []
    p = predicted.select(*by, *keys).distinct().withColumn("_p", F.lit(1))
    g = gold.select(*by, *keys).distinct().withColumn("_g", F.lit(1))
    both = p.join(g, [*by, *keys], "full")
    counts = both.groupBy(*by).agg(F.count_if(F.col("_p").isNotNull() & F.col("_g").isNotNull()).alias("tp"), F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))
    precision = F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    recall = F.when(F.col("tp") + F.col("fn") == 0, 0.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fn")))
    f1 = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return counts.select(*by, "tp", "fp", "fn", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def accuracy(cases: DataFrame, category: str, correct: str) -> DataFrame:
    """Share correct by category, and over all (category null)."""
    return cases.rollup(category).agg(F.count("*").alias("n"), F.round(F.avg(F.col(correct).cast("int")), 6).alias("accuracy"))


def edits(units: DataFrame, by: list[str]) -> DataFrame:
    """``units(targeted, changed, right, conflict)``: what was meant and done right, over what could be done and over what was done."""
    hit = F.col("targeted") & F.col("changed") & F.col("right")
    open_ = F.col("targeted") & ~F.col("conflict")
    counts = units.groupBy(*by).agg(
        F.count_if("targeted").alias("targeted"), F.count_if(hit).alias("correct"), F.count_if(~F.col("targeted") & F.col("changed")).alias("unintended"), F.count_if(F.col("targeted") & F.col("conflict")).alias("conflicts"),
        F.count_if(hit & open_).alias("_h"), F.count_if(open_).alias("_o"), F.count_if("changed").alias("_c"),
    )
    share = lambda a, b: F.round(F.when(F.col(b) == 0, 1.0).otherwise(F.col(a) / F.col(b)), 6)
    return counts.select(*by, "targeted", "correct", "unintended", "conflicts", share("_h", "_o").alias("recall"), share("correct", "_c").alias("precision"))


def frontier(cases: DataFrame, by: list[str]) -> DataFrame:
    """``cases(golden, matched)``: golden null is a decoy.  Recovered, missed, and false matches."""
    g, m = F.col("golden"), F.col("matched")
    return cases.groupBy(*by).agg(F.count_if(g.isNotNull() & (m == g)).alias("recovered"), F.count_if(g.isNotNull() & m.isNull()).alias("missed"), F.count_if(m.isNotNull() & (g.isNull() | (m != g))).alias("false_match"))


def latencies(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Least, median, the value that 90 % don't exceed, most."""
    return rows.groupBy(*by).agg(F.round(F.min(value), 6).alias("least"), F.round(F.median(value), 6).alias("median"), F.round(F.expr(f"percentile_disc(0.9) WITHIN GROUP (ORDER BY `{value}`)"), 6).alias("p90"), F.round(F.max(value), 6).alias("most"))


def run_metrics(calls: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """``calls(model, tokens_in, tokens_out, latency)`` by model; ``prices``: dollars for a million tokens in and out, by a part of the model's name."""
    paid_in = paid_out = F.lit(None).cast("double")
    for part, (a, b) in reversed(prices.items()):
        mine = F.contains("model", F.lit(part))
        paid_in, paid_out = F.when(mine, a).otherwise(paid_in), F.when(mine, b).otherwise(paid_out)
    cost = F.col("tokens_in") * paid_in + F.col("tokens_out") * paid_out
    return calls.groupBy("model").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.avg("latency"), 6).alias("latency"), F.round(F.sum(cost) / 1e6, 9).alias("dollars"))


def unit_matches(made: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Of each gold unit whether its value and its status came out; one that is missing has neither."""
    g = gold.select(*keys, F.col("value").alias("_v"), F.col("status").alias("_s"))
    both = g.join(made, keys, "left")
    return both.select(*keys, F.coalesce(F.col("value") == F.col("_v"), F.lit(False)).alias("value_ok"), F.coalesce(F.col("status") == F.col("_s"), F.lit(False)).alias("status_ok"))


def report_scores(matches: DataFrame, by: list[str]) -> DataFrame:
    return matches.groupBy(*by).agg(F.count("*").alias("units"), F.round(100 * F.avg(F.col("value_ok").cast("int")), 6).alias("value_pct"), F.round(100 * F.avg(F.col("status_ok").cast("int")), 6).alias("status_pct"))
