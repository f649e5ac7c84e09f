"""Mixing sources to target weights by iterative proportional fitting (operator 4)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlattice.llm.common import SEPARATOR_RUN, Work, documents, salted_join

#: Marginals: a target is in proportion to its tokens to this power (1 keeps the shares, 0 makes them equal).
TEMPERATURE = {"source": 0.5, "lang": 0.7, "topic": 0.8}
MISSING = "(none)"
#: Cells that are raked in the driver at most (about 100 bytes each); more are raked as a table, to the same probabilities.
CELLS = 1 << 17
#: Share of the tokens to draw.
FRACTION = 0.7
#: Raking ends when no marginal is off by more than this share of the tokens to draw, or after so many rounds.
CLOSE, ROUNDS = 1e-9, 500


def form_topic(text: Column) -> Column:
    """A topic by the form of the text: table, list, markup, short, long or prose; null for a null text.

    A stand-in for the labels of a topic model: `mix` takes any column.
    """
    words = F.size(F.split(text, SEPARATOR_RUN))
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(text.rlike(r"(?s)\|[^|\n]*\|[^|\n]*\|"), "table")
        .when(text.rlike(r"(?m)^\s*(?:[-*+]|\d+[.)])\s"), "list")
        .when(text.rlike(r"(?s)<[A-Za-z/][^>]*>|\*\*|(?m)^#+\s"), "markup")
        .when(words < 64, "short")
        .when(words > 1024, "long")
        .otherwise("prose")
    )


def attainable(goal: np.ndarray, capacity: np.ndarray, total: float) -> np.ndarray:
    """What values can have of `total` tokens: in proportion to their goals, and no more than they hold.

    What a value cannot give falls to the others in proportion to their goals. If the values with a goal hold less
    than `total`, all give what they hold.
    """
    out, open_ = np.zeros(len(goal)), goal > 0
    while open_.any():
        left = total - out.sum()
        want = np.where(open_, goal * (left / goal[open_].sum()), 0.0)
        full = open_ & (want >= capacity)
        if not full.any():
            return out + want
        out[full] = capacity[full]
        open_ &= ~full
    return out


def rake(cells: np.ndarray, tokens: np.ndarray, targets: list[np.ndarray], budget: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Probabilities of cells (a row of codes each, one per marginal), and the tokens each value of a marginal shall have.

    Each round scales every marginal's values to what is attainable of their targets with `budget` tokens, and cuts
    at 1 what that raises above; cells that are cut let the others of their value rise in the next round. Where the
    cells let no probabilities meet all marginals, those of the last round are given.
    """
    capacity = [np.bincount(cells[:, axis], tokens, len(target)) for axis, target in enumerate(targets)]
    goals = [attainable(np.where(have > 0, target, 0.0), have, budget) for have, target in zip(capacity, targets)]
    chance = np.full(len(tokens), min(1.0, budget / max(tokens.sum(), 1e-300)))
    for _ in range(ROUNDS):
        off = 0.0
        for axis, goal in enumerate(goals):
            now = np.bincount(cells[:, axis], chance * tokens, len(goal))
            off = max(off, np.abs(now - goal).max(initial=0))
            ratio = np.where(now > 0, goal / np.where(now > 0, now, 1), 0.0)
            chance = np.minimum(1.0, chance * ratio[cells[:, axis]])
        if off < CLOSE * max(budget, 1e-300):
            break
    return chance, goals


def _held_chances(cells: DataFrame, axes: list[str], powers: dict[str, float], targets: dict[str, dict[str, float]], fraction: float) -> DataFrame:
    """Cells with their probability and their values' targets, raked in the driver."""
    table = cells.orderBy(*axes).toArrow()
    tokens = table["n"].to_numpy().astype(np.float64)
    codes, shares = [], []
    for axis in axes:
        coded = table[axis].combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        if axis in targets:
            given = targets[axis]
            shares.append(np.array([float(given.get(v, 0.0)) for v in coded.dictionary.to_pylist()]))
        else:
            shares.append(np.bincount(code, tokens) ** powers[axis])
        codes.append(code)
    chance, goals = rake(np.stack(codes, axis=1), tokens, shares, fraction * tokens.sum())
    found = table.select(axes).append_column("probability", pa.array(chance))
    for axis, code, goal in zip(axes, codes, goals):
        found = found.append_column(f"{axis}_target", pa.array((goal / max(goal.sum(), 1e-300))[code]))
    return F.broadcast(cells.sparkSession.createDataFrame(found))


def _table_chances(work: Work, cells: DataFrame, axes: list[str], powers: dict[str, float], targets: dict[str, dict[str, float]], fraction: float) -> DataFrame:
    """Cells with their probability and their values' targets, raked as a table; as `rake`, without a bound on cells or values."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("n")).first()[0])
    budget = fraction * total
    goals, number = {}, {}
    for axis in axes:
        have = cells.groupBy(axis).agg(F.sum("n").cast("double").alias("capacity"))
        if axis in targets:
            given = spark.createDataFrame([(v, float(g)) for v, g in targets[axis].items()], f"{axis} string, goal double")
            have = have.join(F.broadcast(given), axis, "left").withColumn("goal", F.coalesce("goal", F.lit(0.0)))
        else:
            have = have.withColumn("goal", F.col("capacity") ** powers[axis])
        have = work.table(have, f"values-{axis}")
        # the level at which min(capacity, level * goal) sums to the budget lies between two neighbours among capacity / goal;
        # each round gives the full values up and deals what they leave to the others
        level = 0.0
        while True:
            full = (F.col("goal") > 0) & (F.col("goal") * level >= F.col("capacity"))
            given, open_ = have.agg(F.coalesce(F.sum(F.when(full, F.col("capacity"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("goal"))), F.lit(0.0))).first()
            after = (budget - given) / open_ if open_ > 0 else level
            if after <= level:
                break
            level = after
        goal = F.when(F.col("goal") > 0, F.least(F.col("capacity"), F.col("goal") * float(level))).otherwise(0.0)
        goals[axis] = work.table(have.select(axis, goal.alias("goal")), f"goals-{axis}")
        number[axis] = goals[axis].count()

    def look_up(left, right, on, n):
        # values may be many, and one of them may hold most cells
        return left.join(F.broadcast(right), on) if n <= CELLS else salted_join(left, right, [on], "inner", F.struct(*axes))

    last, step = "chances", 0
    current = work.table(cells.withColumn("probability", F.lit(min(1.0, fraction))), last)
    for _ in range(ROUNDS):
        off = 0.0
        for axis in axes:
            step += 1
            now = current.groupBy(axis).agg(F.sum(F.col("probability") * F.col("n")).alias("now"))
            ratio = F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(0.0)
            ratios = work.table(now.join(goals[axis], axis).select(axis, ratio.alias("ratio"), F.abs(F.col("now") - F.col("goal")).alias("off")), f"ratios-{step}")
            off = max(off, ratios.agg(F.max("off")).first()[0])
            raised = look_up(current, ratios.drop("off"), axis, number[axis]).withColumn("probability", F.least(F.lit(1.0), F.col("probability") * F.col("ratio")))
            current = work.table(raised.drop("ratio"), f"chances-{step}")
            work.drop(last)
            work.drop(f"ratios-{step}")
            last = f"chances-{step}"
        if off < CLOSE * budget:
            break
    for axis in axes:
        whole = goals[axis].agg(F.sum("goal")).first()[0] or 1.0
        current = look_up(current, goals[axis].select(axis, (F.col("goal") / float(whole)).alias(f"{axis}_target")), axis, number[axis])
    return current.drop("n")


AXES = ["source", "lang", "topic"]


def mix(docs: DataFrame, topic: Column, fraction: float = FRACTION, temperature: dict[str, float] | None = None, targets: dict[str, dict[str, float]] | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, source, lang, topic, tokens, probability, drawn, and source_target, lang_target, topic_target.

    Tokens are words between white space; a document without any counts as one token. `targets` gives shares for
    the values of a marginal (others get none); without it a share follows the tokens by `temperature`. What a value
    cannot give, because all its tokens are less than its share of the tokens to draw, falls to the others of its
    marginal; the shares that are left are the targets of the result. Cells of source, lang and topic are raked to
    all three, each value to its own share, under the bound that no probability exceeds 1. A document is drawn if a
    hash of its id and seed, as a number from 0 to 1, is below its cell's probability: the choice depends on nothing
    else. A null source, lang or topic is a value of its own, `(none)`; rows that repeat an id and cell are drawn
    together; null ids are one id. No rows give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    work = Work(spark, "mixing")
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.size(F.filter(F.split(text, SEPARATOR_RUN), lambda w: w != ""))
    rows = docs.select(F.col(id_col).alias("doc_id"), *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in ("source", "lang")], F.coalesce(topic, F.lit(MISSING)).alias("topic"), F.greatest(F.lit(1), words).cast("long").alias("tokens"))
    rows = work.table(rows, "rows")
    axes = AXES
    powers = TEMPERATURE | (temperature or {})
    cells = work.table(rows.groupBy(*axes).agg(F.sum("tokens").alias("n")), "cells")
    n = cells.count()
    if not n:
        return rows.select("*", F.lit(0.0).alias("probability"), F.lit(False).alias("drawn"), *[F.lit(0.0).alias(f"{a}_target") for a in axes])
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    if n <= CELLS:
        out = rows.join(_held_chances(cells, axes, powers, targets or {}, fraction), axes)
    else:
        out = salted_join(rows, _table_chances(work, cells, axes, powers, targets or {}, fraction), axes, "inner", F.struct("doc_id", "tokens"))
    return out.select("doc_id", *axes, "tokens", "probability", (u < F.col("probability")).alias("drawn"), *[f"{a}_target" for a in axes])


def shares(mixed: DataFrame) -> DataFrame:
    """axis, value, tokens, target, expected, drawn: how near the drawn tokens come to each marginal's targets.

    expected is the share of the tokens that are drawn on average, drawn that of the tokens that were.
    """
    drawn = F.when(F.col("drawn"), F.col("tokens")).otherwise(0)
    cells = mixed.groupBy(*AXES, *[f"{a}_target" for a in AXES]).agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("probability")).alias("expected"), F.sum(drawn).alias("drawn"))
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value"), F.col(f"{a}_target").alias("target")) for a in AXES]))
    values = cells.select(each.alias("v"), "tokens", "expected", "drawn").groupBy("v.axis", "v.value", "v.target").agg(*[F.sum(c).alias(c) for c in ("tokens", "expected", "drawn")])
    whole = values.groupBy("axis").agg(F.sum("expected").alias("all_expected"), F.sum("drawn").alias("all_drawn"))
    share = lambda c: F.when(F.col(f"all_{c}") > 0, F.col(c) / F.col(f"all_{c}")).otherwise(0.0).alias(c)
    return values.join(F.broadcast(whole), "axis").select("axis", "value", "tokens", "target", share("expected"), share("drawn"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), form_topic(F.col("text")))
