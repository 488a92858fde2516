"""Budgeted story plans: classes by rule, time estimates, top shares, and a hard limit by prefix sums."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.text import two_decimals
from tideline.operators import scan

BRIDGES = ("CAUSE", "SETUP", "PAYOFF", "CONSEQUENCE")
#: Importance from which an event must, or should, be told; fixed parts of an event's time (fixed values).
MUST, SHOULD = 0.7, 0.4
LEAST_MS, TRANSITION_MS = 1200, 250
HOLD_MS = {"NARRATION_ONLY": 0, "KEY_DIALOGUE": 600, "DIALOGUE_HEAVY": 1200}


@dataclass(frozen=True)
class Profile:
    style: str = "FULL_PLOT"
    compression: float = 0.2
    limit_ms: int | None = 120_000
    policy: str = "KEY_DIALOGUE"
    words_per_second: float = 2.5


def bridge_events(edges: DataFrame) -> DataFrame:
    """Distinct endpoints of bridge edges."""
    bridge = edges.where(F.col("relation").isin(*BRIDGES))
    return bridge.select(F.col("from_event_id").alias("event_id")).union(bridge.select("to_event_id")).distinct()


def reveal_targets(edges: DataFrame) -> DataFrame:
    return edges.where("relation = 'REVEAL' and from_event_id % 5 = 0").select(F.col("to_event_id").alias("event_id")).distinct()


def estimate_ms(words: Column, profile: Profile) -> Column:
    spoken = F.ceil(words / F.lit(profile.words_per_second) * 1000.0).cast("long")
    return F.greatest(F.lit(LEAST_MS).cast("long"), spoken) + HOLD_MS[profile.policy] + TRANSITION_MS


def classify(events: DataFrame, edges: DataFrame, profile: Profile, focused: Column | None = None) -> DataFrame:
    """events with budget_class, reason and estimated_ms."""
    flags = events.join(bridge_events(edges).withColumn("_b", F.lit(True)), "event_id", "left").join(reveal_targets(edges).withColumn("_r", F.lit(True)), "event_id", "left")
    shown = two_decimals("importance")
    focus = F.lit(False) if focused is None else focused
    chain = [
        (F.col("_b"), "MUST_HAVE", F.lit("causal bridge endpoint (cause/setup/payoff/consequence)")),
        (F.col("_r"), "MUST_HAVE", F.lit("major reveal target")),
        (F.col("importance") >= MUST, "MUST_HAVE", F.concat(F.lit("narrative importance "), shown)),
    ]
    if profile.style == "CHARACTER":
        chain += [(focus, "SHOULD_HAVE", F.lit("direct participation of focus character")), (F.lit(True), "OPTIONAL", F.lit("focus character does not participate"))]
    chain += [(F.col("importance") >= SHOULD, "SHOULD_HAVE", F.concat(F.lit("supporting context "), shown)), (F.lit(True), "OPTIONAL", F.concat(F.lit("low narrative importance "), shown))]
    kind = reason = None
    for test, name, why in chain:
        kind = F.when(test, name) if kind is None else kind.when(test, name)
        reason = F.when(test, why) if reason is None else reason.when(test, why)
    words = F.lit(1) + F.col("event_id") % 12
    return flags.select(*events.columns, kind.alias("budget_class"), reason.alias("reason"), estimate_ms(words, profile).alias("estimated_ms"))


def top_share(classed: DataFrame, profile: Profile) -> DataFrame:
    """Events that the style keeps: the most important share of one class, all or none of the others."""
    group = W.partitionBy("user_id", "budget_class")
    ranked = classed.withColumn("_k", F.row_number().over(group.orderBy(F.desc("importance"), "start_ms", "ordinal"))).withColumn("_n", F.count(F.lit(1)).over(group))
    share = F.col("_n") * F.lit(float(profile.compression))
    if profile.style in ("FULL_PLOT", "CHARACTER"):
        keep = F.col("budget_class").isin("MUST_HAVE", "SHOULD_HAVE") | (F.col("_k") <= F.floor(share))
    else:
        keep = (F.col("budget_class") == "MUST_HAVE") | ((F.col("budget_class") == "SHOULD_HAVE") & (F.col("_k") <= F.ceil(share)))
    return ranked.where(keep).drop("_k", "_n")


def fit_limit(kept: DataFrame, limit_ms: int, hot: DataFrame | bool | None = True) -> DataFrame:
    """Drops optional, then should-have events, least important first, while the total is
    over the limit; the greedy loop as a prefix sum. feasible: must-have events alone fit."""
    ranked = kept.withColumn("_c", F.expr("case budget_class when 'OPTIONAL' then 0 when 'SHOULD_HAVE' then 1 else 2 end"))
    must = F.when(F.col("budget_class") == "MUST_HAVE", F.col("estimated_ms")).otherwise(0)
    totals = {"_all": F.col("estimated_ms"), "_must": must}
    sized = scan.running(ranked, "user_id", ["_c", "importance", "start_ms", "ordinal"], {"_before": F.col("estimated_ms")}, totals, hot=hot)
    sized = sized.withColumn("feasible", F.col("_must") <= limit_ms)
    return sized.where((F.col("budget_class") == "MUST_HAVE") | (F.col("_all") - F.col("_before") <= limit_ms)).drop("_c", "_before", "_all", "_must")


def plan(events: DataFrame, edges: DataFrame, profile: Profile) -> DataFrame:
    hot = scan.hot_keys(events, "user_id", scan.MOST)
    kept = top_share(classify(events, edges, profile), profile)
    kept = fit_limit(kept, profile.limit_ms, hot) if profile.limit_ms is not None else kept.withColumn("feasible", F.lit(True))
    placed = scan.running(kept, "user_id", ["start_ms", "ordinal"], number="plan_ordinal", hot=hot)
    return placed.select("user_id", "plan_ordinal", "event_id", "budget_class", "reason", "estimated_ms", "feasible")


def selected_plots(events: DataFrame, planned: DataFrame) -> DataFrame:
    """Plots (a user's events of one type) with a planned member."""
    plots = events.select("user_id", "event_type", "event_id")
    return plots.join(planned.select("event_id"), "event_id", "left_semi").select("user_id", "event_type").distinct()
