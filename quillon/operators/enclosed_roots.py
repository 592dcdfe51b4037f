"""Every root of stored secular functions, enclosed, and windows proved empty.

A secular function of a family is the sum of weight / (x - pole) over a stored table. With positive weights it falls from plus to minus infinity
between neighbouring poles, so every gap holds one root and there is none beyond the outer poles. The frontier is a table of boxes, one a gap: each round asks the
function at ``POINTS`` inner points of every box, as one join with the poles and one aggregation, and keeps the part where the sign turns. Families of up to
``SHORT`` poles travel as lists instead and go through all rounds in their row. A sign counts only
if the sum lies further from 0 than its rounding errors can reach, which a second sum bounds; a box whose points are all unsure is as small as doubles tell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.work import written

POINTS = 7
#: Half a unit in the last place of 1.
UNIT = 2.0**-53
ROUNDS = 40
#: Poles of a family that are one list, and families of a task.
SHORT, FAMILIES = 512, 256


def _checked(poles: DataFrame) -> DataFrame:
    bad = ~(F.col("weight") > 0) | F.isnan("pole") | (F.abs("pole") == float("inf")) | F.col("pole").isNull() | F.col("weight").isNull()
    if not poles.filter(bad).isEmpty():
        raise ValueError("poles must be finite and weights positive")
    return poles


def gaps(poles: DataFrame) -> DataFrame:
    """(family, gap from 1, lo, hi, status) between neighbouring poles of a table (family, pole, weight). Weights must be positive and poles finite."""
    order = W.partitionBy("family").orderBy("pole")
    ends = _checked(poles).groupBy("family", "pole").agg(F.sum("weight").alias("weight")).select(
        "family", F.row_number().over(order).alias("gap"), F.col("pole").cast("double").alias("lo"), F.lead("pole").over(order).cast("double").alias("hi")
    )
    return ends.filter("hi IS NOT NULL").withColumn("status", F.lit("open"))


def values(points: DataFrame, poles: DataFrame) -> DataFrame:
    """``points`` (family, x and others) with the function's value there and how far off it may be."""
    named = points.withColumn("__at", F.struct(*points.columns)).hint("merge")
    term = F.col("weight") / (F.col("x") - F.col("pole"))
    sums = named.select("__at", "family", "x").join(poles.select("family", "pole", "weight"), "family").groupBy("__at").agg(
        F.sum(term).alias("value"), (F.sum(F.abs(term)) * (F.count("*") + 4) * UNIT * 1.01).alias("error")
    )
    return sums.select("__at.*", "value", "error")


def _rounds(p: np.ndarray, w: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, status) of the roots between ascending poles: the rounds of ``roots`` for one family."""
    lo, hi = p[:-1].copy(), p[1:].copy()
    status, open_ = np.full(len(lo), "unsure", object), np.arange(len(lo))
    share = np.arange(1, POINTS + 1) / (POINTS + 1)
    for _ in range(ROUNDS):
        a, b = lo[open_, None], hi[open_, None]
        x = a + (b - a) * share
        inside = (x > a) & (x < b)
        term = w / (np.where(inside, x, np.nan)[:, :, None] - p)
        value, error = term.sum(2), np.abs(term).sum(2) * (len(p) + 4) * UNIT * 1.01
        up = np.where((value > error), x, -np.inf).max(1)
        down = np.where((-value > error), x, np.inf).min(1)
        stuck = np.isinf(up) & np.isinf(down)
        lo[open_], hi[open_] = np.maximum(lo[open_], up), np.minimum(hi[open_], down)
        small = hi[open_] - lo[open_] <= width * np.maximum(1.0, np.maximum(np.abs(lo[open_]), np.abs(hi[open_])))
        status[open_[small]] = "enclosed"
        open_ = open_[~small & ~stuck]
        if not len(open_):
            break
    return lo, hi, status


def _short_roots(poles: DataFrame, width: float) -> DataFrame:
    """``roots`` of the families of a table (family, pole, weight) that are short enough for a list each."""
    lists = poles.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("pole", "weight"))).alias("l")).select("family", F.col("l.pole").alias("p"), F.col("l.weight").alias("w"))
    lists = written(lists, "pole-lists")
    lists = lists.repartition(max(1, lists.count() // FAMILIES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                p, w = (np.asarray(b.column(k)[at].values) for k in (1, 2))
                with np.errstate(all="ignore"):
                    lo, hi, status = _rounds(p, w, width)
                n = len(lo)
                family = b.column(0).take(pa.array(np.full(n, at)))
                yield pa.RecordBatch.from_arrays([family, pa.array(np.arange(1, n + 1), pa.int32()), pa.array(lo), pa.array(hi), pa.array(status.tolist(), pa.string())], names=["family", "gap", "lo", "hi", "status"])

    kind = lists.schema["family"].dataType.simpleString()
    return written(lists.mapInArrow(run, f"family {kind}, gap int, lo double, hi double, status string"), "short-roots")


def roots(poles: DataFrame, width: float = 1e-12) -> DataFrame:
    """(family, gap, lo, hi, status) of all roots: enclosed to a relative width, or unsure where rounding hides the sign in all that is left."""
    poles = poles.select("family", F.col("pole").cast("double").alias("pole"), F.col("weight").cast("double").alias("weight"))
    # Written tables are small by their files and not in memory: no join here is left to the size of files.
    poles = written(_checked(poles).groupBy("family", "pole").agg(F.sum("weight").alias("weight")).withColumn("n", F.count("*").over(W.partitionBy("family"))), "poles")
    done = _short_roots(poles.filter((F.col("n") > 1) & (F.col("n") <= SHORT)), width)
    poles = poles.filter(F.col("n") > SHORT).drop("n")
    boxes = written(gaps(poles), "boxes")
    if boxes.isEmpty():
        return done
    for _ in range(ROUNDS):
        share = F.sequence(F.lit(1), F.lit(POINTS))
        inner = boxes.select("family", "gap", "lo", "hi", F.explode(share).alias("k"))
        inner = inner.withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("k") / (POINTS + 1))).filter((F.col("x") > F.col("lo")) & (F.col("x") < F.col("hi")))
        told = values(inner, poles)
        # The function falls: the root lies above every point of a sure plus and below every one of a sure minus.
        sure = F.abs("value") > F.col("error")
        cut = told.groupBy("family", "gap").agg(F.max(F.when(sure & (F.col("value") > 0), F.col("x"))).alias("up"), F.min(F.when(sure & (F.col("value") < 0), F.col("x"))).alias("down"))
        small = F.col("hi") - F.col("lo") <= width * F.greatest(F.lit(1.0), F.abs("lo"), F.abs("hi"))
        stuck = F.col("up").isNull() & F.col("down").isNull()
        boxes = boxes.join(cut.hint("merge"), ["family", "gap"], "left").withColumns({"lo": F.coalesce("up", "lo"), "hi": F.coalesce("down", "hi")})
        boxes = written(boxes.withColumn("status", F.when(small, "enclosed").when(stuck, "unsure").otherwise("open")).drop("up", "down"), "boxes")
        ended = boxes.filter("status <> 'open'")
        done = done.unionByName(ended)
        boxes = boxes.filter("status = 'open'")
        if boxes.isEmpty():
            break
    return done.unionByName(boxes.withColumn("status", F.lit("unsure")))


def windows(enclosures: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (family, low, high) with the roots surely inside, those that a bound cuts, and whether it is proved empty, holds, or is undecided."""
    e = enclosures.select("family", "lo", "hi").hint("merge")
    met = wanted.join(e, "family", "left").withColumns({
        "__in": (F.col("lo") >= F.col("low")) & (F.col("hi") <= F.col("high")), "__meets": (F.col("hi") >= F.col("low")) & (F.col("lo") <= F.col("high")),
    })
    out = met.groupBy("family", "low", "high").agg(F.count_if("__in").alias("inside"), F.count_if(F.col("__meets") & ~F.col("__in")).alias("cut"))
    return out.withColumn("proof", F.when(F.col("inside") > 0, "holds").when(F.col("cut") > 0, "undecided").otherwise("empty"))
