"""Greedy choices in order, without one sequential group: what a range of rows does to the state before it is a small function.

Rows are numbered and cut into ranges of ``RANGE``. For batches, a range is a step function from the bytes used before it to the
batches it opens and the bytes used behind it. Step functions compose, so they are combined over ``FAN`` ranges at a time in a tree; its
root is asked with nothing used, and the states go down again to every range, whose rows then find their batch at once. Two entries
that come to the same cut are one step, so a function has no more steps than a batch has rows.

For budgets, a range takes all its rows while the running sum of the candidates that still fit at all stays within what is
left: one step, and sums compose. The first range beyond is opened row by row; behind it less is left, candidates above
that can never be taken, and the same is asked of the others. All groups take a step at once.

Costs and sizes are whole numbers, so sums are exact in any order.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.work import written
from .ranks import dense_position

#: Rows of a range, and ranges that a node of the tree combines.
RANGE, FAN = 65_536, 64
#: Groups whose states are broadcast at most (about 100 bytes each); beyond, they are joined by shuffle, where adaptive execution splits a hot group.
BROADCAST_GROUPS = 100_000


def _whole_number(df: DataFrame, amount: str) -> None:
    if df.schema[amount].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{amount} must be a whole number")


def _placed(df: DataFrame, by: list[str], order: list[str], amount: str) -> DataFrame:
    """``df`` as struct ``row`` with group, range, place and a whole ``amount``; written, as ranges must not be drawn twice."""
    group = F.to_json(F.struct(*[F.col(c) for c in by]), {"ignoreNullFields": "false"}) if by else F.lit("")
    keyed = df.select(F.struct("*").alias("row"), group.alias("group"), F.col(amount).cast("long").alias("amount"), *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)])
    out = dense_position(keyed, "group", *[f"o{k}" for k in range(len(order))])
    return written(out.select("row", "group", "amount", F.col("position").alias("place"), F.floor(F.col("position") / RANGE).alias("range")), "budget-placed")


def _few(df: DataFrame, by: list[str], run, kind: str) -> DataFrame | None:
    """A table of one range at most, each group by itself, as it is; ``run`` takes a group's frame in order."""
    if df.limit(RANGE + 1).count() > RANGE:
        return None
    group = F.to_json(F.struct(*[F.col(c) for c in by]), {"ignoreNullFields": "false"}) if by else F.lit("")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {kind}"
    return df.groupBy(group.alias("__group")).applyInPandas(run, schema)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else df


# --- Batches --------------------------------------------------------------------------------------


class Steps:
    """What a range does to the bytes used before it.

    Entered with 0: ``zero`` (batches opened, bytes used behind). Else the first bound that the entry lies above gives its
    ``opened`` and ``used``; at or under all bounds nothing is opened and ``total`` is added.
    """

    def __init__(self, zero: tuple[int, int], bounds: np.ndarray, opened: np.ndarray, used: np.ndarray, total: int) -> None:
        self.zero, self.total = zero, total
        # Neighbours with one outcome are one step; bounds fall.
        last = np.append((opened[1:] != opened[:-1]) | (used[1:] != used[:-1]), True)[: len(bounds)]
        self.bounds, self.opened, self.used = bounds[last], opened[last], used[last]

    @classmethod
    def of(cls, sizes: np.ndarray, most: int) -> Steps:
        m = len(sizes)
        sums = np.concatenate([[0], np.cumsum(sizes)])
        cut = first_cuts(sums, most)
        opened, used = np.zeros(m, np.int64), sums[m] - sums[:m]
        for k in range(m - 1, -1, -1):
            if cut[k] < m:
                opened[k], used[k] = opened[cut[k]] + 1, used[cut[k]]
        bounds = most - sums[1:]
        n = int(np.searchsorted(-bounds, 0, "left")) + 1  # an entry above 0 reaches no row behind the first bound at or under 0
        n = min(n, m)
        return cls((int(opened[0]), int(used[0])), bounds[:n], opened[:n] + 1, used[:n], int(sums[m]))

    def __call__(self, entry: int) -> tuple[int, int]:
        if entry == 0:
            return self.zero
        k = int(np.searchsorted(-self.bounds, -entry, "right"))  # the first bound under the entry
        if k == len(self.bounds):
            return 0, entry + self.total
        return int(self.opened[k]), int(self.used[k])

    def then(self, other: Steps) -> Steps:
        """This range, then another."""

        def after(opened: int, used: int) -> tuple[int, int]:
            more, used = other(used)
            return opened + more, used

        own = [after(int(o), int(u)) for o, u in zip(self.opened, self.used, strict=True)]
        # Where nothing is opened here, the other's bounds lie lower by what was added.
        low = other.bounds - self.total
        floor = self.bounds[-1] if len(self.bounds) else np.iinfo(np.int64).max
        inside = low < floor
        # An entry just above the floor was cut here; one at it meets the first of the other's bounds that is lower.
        opened = np.array([o for o, _ in own] + other.opened[inside].tolist(), np.int64)
        used = np.array([u for _, u in own] + other.used[inside].tolist(), np.int64)
        return Steps(after(*self.zero), np.concatenate([self.bounds, low[inside]]).astype(np.int64), opened, used, self.total + other.total)


def first_cuts(sums: np.ndarray, most: int) -> np.ndarray:
    """For a batch that starts at each row, the row that starts the next one (the number of rows: none)."""
    m = len(sums) - 1
    cut = np.searchsorted(sums, sums[:m] + most, "right") - 1
    alone = (cut < m) & (sums[np.minimum(cut, m)] == sums[:m])  # too large for any batch, and nothing before it
    cut = cut + alone
    return np.maximum(cut, np.arange(m) + 1)


STEPS = "group string, node long, zero_opened long, zero_used long, bounds array<long>, opened array<long>, used array<long>, total long"


def _row(group: str, node: int, s: Steps) -> pd.DataFrame:
    return pd.DataFrame([(group, node, *s.zero, s.bounds, s.opened, s.used, s.total)], columns=[c.split()[0] for c in STEPS.split(", ")])


def _steps(r) -> Steps:
    lists = [np.asarray(v, np.int64) for v in (r.bounds, r.opened, r.used)]
    return Steps((int(r.zero_opened), int(r.zero_used)), *lists, int(r.total))


def batches(df: DataFrame, by: list[str], order: list[str], size: str, most: int) -> DataFrame:
    """``df`` with ``batch`` from 0: rows of a group in a total order, a batch ending where the next row would take it over ``most``.

    A row larger than that is a batch of its own. Sizes are whole numbers, 0 or more.
    """

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        cut, out, start = first_cuts(np.concatenate([[0], np.cumsum(pdf[size].to_numpy(np.int64))]), most), np.zeros(len(pdf), np.int64), 0
        while (start := int(cut[start])) < len(pdf):
            out[start:] += 1
        return pdf.assign(batch=out)

    _whole_number(df, size)
    if (few := _few(df, by, whole, "batch long")) is not None:
        return few
    items = _placed(df, by, order, size)

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        return _row(pdf["group"].iloc[0], int(pdf["range"].iloc[0]), Steps.of(pdf["amount"].to_numpy(np.int64), most))

    def combined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        return _row(pdf["group"].iloc[0], int(pdf["node"].iloc[0]) // FAN, reduce(Steps.then, map(_steps, pdf.itertuples())))

    def entered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        batch, used, out = int(pdf["batch"].iloc[0]), int(pdf["entry"].iloc[0]), []
        for r in pdf.itertuples():
            out.append((r.group, r.node, batch, used))
            more, used = _steps(r)(used)
            batch += more
        return pd.DataFrame(out, columns=["group", "node", "batch", "entry"])

    def assigned(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        sums = np.concatenate([[0], np.cumsum(pdf["amount"].to_numpy(np.int64))])
        cut, used = first_cuts(sums, most), int(pdf["entry"].iloc[0])
        start = 0 if used == 0 else int(np.searchsorted(sums[1:], most - used, "right"))
        out = np.full(len(pdf), int(pdf["batch"].iloc[0]), np.int64)
        if used == 0 and len(pdf):
            start = int(cut[0])
        while start < len(pdf):
            out[start:] += 1
            start = int(cut[start])
        return pd.DataFrame({"place": pdf["place"].to_numpy(), "batch": out})

    sized = items.select("group", "range", "place", "amount")
    level = written(sized.groupBy("group", "range").applyInPandas(told, STEPS), "budget-steps")
    up = [level]
    while up[-1].groupBy("group").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        up.append(written(up[-1].groupBy("group", F.floor(F.col("node") / FAN).alias("above")).applyInPandas(combined, STEPS), "budget-steps"))
    state = up[-1].select("group", "node", F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("entry"))
    for level in reversed(up[:-1]):
        above = state.withColumnRenamed("node", "above")
        children = level.withColumn("above", F.floor(F.col("node") / FAN)).join(above, ["group", "above"])
        state = written(children.groupBy("group", "above").applyInPandas(entered, "group string, node long, batch long, entry long"), "budget-states")
    placed = sized.join(state.withColumnRenamed("node", "range"), ["group", "range"]).groupBy("group", "range").applyInPandas(assigned, "place long, batch long")
    return items.select("row", "place").join(placed, "place").select("row.*", "batch")


# --- Budgets --------------------------------------------------------------------------------------


def spend(df: DataFrame, by: list[str], order: list[str], cost: str, budget: int | Column) -> DataFrame:
    """``df`` with ``taken``: rows of a group in a total order, each taken if its cost is within what the budget has left.

    Costs are whole numbers, 0 or more; a null cost is not taken. ``budget`` may be a column that is constant in a group.
    """

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        left, taken = int(pdf["__budget"].iloc[0]), []
        for c in pdf[cost].tolist():
            taken.append(c is not None and c == c and c <= left)
            left -= int(c) if taken[-1] else 0
        return pdf.assign(taken=taken)

    limit = budget if isinstance(budget, Column) else F.lit(budget)
    _whole_number(df, cost)
    if (few := _few(df.withColumn("__budget", limit.cast("long")), by, whole, "taken boolean")) is not None:
        return few.drop("__budget")
    items = _placed(df.withColumn("__budget", limit.cast("long")), by, order, cost)
    state = written(items.groupBy("group").agg(F.max("row.__budget").alias("left")), "budget-left")
    remaining, decided = items.select("group", "range", "place", "amount"), []

    def opened(pdf: pd.DataFrame) -> pd.DataFrame:
        # All groups of a range at once: a small group is not worth a frame of its own.
        pdf, taken, lefts, last, left = pdf.sort_values("place"), [], [], None, 0
        for group, entry, amount in zip(pdf["group"].tolist(), pdf["entry"].tolist(), pdf["amount"].tolist(), strict=True):
            if group != last:
                last, left = group, entry
            taken.append(amount <= left)
            left -= amount if taken[-1] else 0
            lefts.append(left)
        return pd.DataFrame({"place": pdf["place"].to_numpy(), "taken": taken, "group": pdf["group"].to_numpy(), "left": lefts})

    while True:
        fitting = written(remaining.join(_small(state), "group").filter(F.col("amount") <= F.col("left")), "budget-fitting")
        sums = fitting.groupBy("group", "range").agg(F.sum("amount").alias("sum"), F.max("left").alias("left"))
        upto = F.sum("sum").over(W.partitionBy("group").orderBy("range").rowsBetween(W.unboundedPreceding, 0))  # over ranges, not rows
        beyond = sums.withColumn("upto", upto).filter(F.col("upto") > F.col("left"))
        beyond = beyond.groupBy("group").agg(F.min(F.struct("range", (F.col("left") - F.col("upto") + F.col("sum")).alias("entry"))).alias("first"))
        beyond = written(beyond.select("group", F.col("first.range").alias("bound"), F.col("first.entry").alias("entry")), "budget-beyond")
        judged = fitting.drop("left").join(_small(beyond), "group", "left")
        decided.append(judged.filter("bound IS NULL OR range < bound").select("place", F.lit(True).alias("taken")))
        if beyond.isEmpty():
            break
        inside = written(judged.filter("range = bound").groupBy("range").applyInPandas(opened, "place long, taken boolean, group string, left long"), "budget-opened")
        decided.append(inside.select("place", "taken"))
        state = written(inside.groupBy("group").agg(F.min("left").alias("left")), "budget-left")
        remaining = written(judged.filter("range > bound").select("group", "range", "place", "amount"), "budget-remaining")
    taken = reduce(DataFrame.unionAll, decided)
    out = items.select("row", "place").join(taken, "place", "left")
    return out.select(*[F.col("row")[c].alias(c) for c in df.columns], F.coalesce("taken", F.lit(False)).alias("taken"))
