"""Directed acyclic graphs of artifacts: closure, levels, chains, plans. Depth grows the rounds, not the tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import written
from .budget import spend


def closure(edges: DataFrame, roots: DataFrame, most_depth: int = 64, cut: bool = False) -> DataFrame:
    """(root, node, depth: least) of all that roots (column root) depend on, themselves included at depth 0.

    Edges are (node, dep). Frontiers are joined round by round; what is known is not visited again, so
    cycles end. Deeper graphs than ``most_depth`` are refused, or with ``cut`` given as far as that.
    """
    edges = edges.select("node", "dep").distinct()
    known = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct()
    front = known
    for depth in range(1, most_depth + 1):
        step = front.select("root", "node").join(edges, "node").select("root", F.col("dep").alias("node")).distinct()
        front = step.join(known.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth))
        front = _kept(front)
        if front.isEmpty():
            return known
        known = known.unionByName(front)
    if cut:
        return known
    raise ValueError(f"deeper than {most_depth}")


def chain(spark, view_sql: str, start_sql: str, most: int = 64) -> DataFrame:
    """(start, node, step, problem) along single successors, a join a step, as recursive queries stop at a million rows.

    A node that the chain has met already ends it with a row whose problem is ``cycle``, a step beyond ``most`` (under 100) with
    one whose problem is ``too deep``; all other rows have none. ``view_sql`` selects (node, next), ``start_sql`` selects (start).
    """
    # Written columns of numbers are far smaller than in memory, so none of them is broadcast by its size.
    edges = _kept(spark.sql(view_sql).select("node", "next")).hint("merge")
    front = _kept(spark.sql(start_sql).select("start", F.col("start").alias("node"), F.lit(0).alias("step"), F.array("start").alias("seen"), F.lit(None).cast("string").alias("problem")))
    done = front.drop("seen")
    while True:
        step = front.filter("problem IS NULL").join(edges, "node")
        problem = F.when(F.array_contains("seen", F.col("next")), "cycle").when(F.col("step") >= most, "too deep")
        front = _kept(step.select("start", F.col("next").cast(front.schema["node"].dataType).alias("node"), (F.col("step") + 1).alias("step"), F.array_append("seen", F.col("next")).alias("seen"), problem.alias("problem")))
        if front.isEmpty():
            return done
        done = done.unionByName(front.drop("seen"))


def levels(edges: DataFrame, nodes: DataFrame, most_depth: int = 64) -> DataFrame:
    """(node, level): 0 without dependencies, else one more than the highest of them. A cycle is an error."""
    done = None
    rest, left = nodes.select("node").distinct(), edges.select("node", "dep").distinct()
    for level in range(most_depth + 1):
        ready = _kept(rest.join(left.select("node").distinct(), "node", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            if rest.isEmpty():
                return done if done is not None else ready
            raise ValueError("the graph has a cycle")
        rest = _kept(rest.join(ready, "node", "left_anti"))
        left = _kept(left.join(ready.select(F.col("node").alias("dep")), "dep", "left_anti"))
        done = ready if done is None else done.unionByName(ready)
    raise ValueError(f"deeper than {most_depth}")


def _kept(df: DataFrame) -> DataFrame:
    """Computed now, once: later rounds must not repeat earlier ones."""
    return written(df, "dag")


def divergence(comparisons: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, origin) of mismatches: inherited if a dependency mismatches, undetermined if one was not compared, else first."""
    deps = edges.join(comparisons.select(F.col("node").alias("dep"), F.col("status").alias("dep_status")), "dep", "left")
    by = deps.groupBy("node").agg(F.bool_or(F.coalesce(F.col("dep_status") == "mismatch", F.lit(False))).alias("bad"), F.bool_or(F.col("dep_status").isNull()).alias("unknown"))
    origin = F.when(F.col("bad"), "inherited").when(F.col("unknown"), "undetermined").otherwise("first")
    return comparisons.filter("status = 'mismatch'").join(by, "node", "left").select("node", origin.alias("origin"))


def plan(candidates: DataFrame, by: str, order: str, cost: str, budget: int) -> DataFrame:
    """Candidates in order with whether the budget of their group still pays for them; refused ones cost nothing. Costs are whole numbers."""
    return spend(candidates, [by], [order], cost, budget)


def planned(nodes: DataFrame, edges: DataFrame, candidates: DataFrame, order: list, budget: int) -> DataFrame:
    """(node, level, candidate, cost, status) of a derivation plan: nodes in dependency order, each with its best candidate.

    ``candidates`` are (node, candidate, cost, ...). Within a level nodes go by name; one whose cost the rest of the budget does not cover is
    refused and costs nothing, one that needs a refused or unplannable node is blocked. Costs are whole numbers; the nodes of a level
    are spent for in order of their names, range by range.
    """
    from .selection import best

    placed = _kept(levels(edges, nodes))
    chosen = best(candidates, ["node"], order).select("node", "candidate", "cost")
    placed = _kept(placed.join(chosen, "node", "left"))
    done, left = None, budget
    for level in range((placed.agg(F.max("level")).first()[0] or 0) + 1):
        own = placed.filter(F.col("level") == level)
        if done is not None:
            bad = edges.join(done.filter("status <> 'planned'").select(F.col("node").alias("dep")), "dep").select("node").distinct().withColumn("__blocked", F.lit(True))
            own = own.join(bad, "node", "left")
        else:
            own = own.withColumn("__blocked", F.lit(None).cast("boolean"))

        free = own.filter("__blocked IS NULL AND cost IS NOT NULL")
        taken = spend(free.select("node", "cost"), [], ["node"], "cost", left).filter("taken").select("node", "taken")
        status = F.when(F.col("__blocked"), "blocked").when(F.col("cost").isNull(), "no_candidate").when(F.col("taken"), "planned").otherwise("over_budget")
        own = _kept(own.join(taken, "node", "left").withColumn("status", status).drop("__blocked", "taken"))
        left -= own.filter("status = 'planned'").agg(F.sum("cost")).first()[0] or 0
        done = own if done is None else done.unionByName(own)
    return done.select("node", "level", "candidate", "cost", "status")


def resolved(roots: DataFrame, edges: DataFrame, known: DataFrame, most_depth: int, most_nodes: int) -> DataFrame:
    """(root, nodes, depth, outcome) of identities resolved with all they depend on: resolved, or missing, too_deep or too_many.

    What lies more than one step beyond ``most_depth`` is not visited: there, nodes and depth are those of what was.
    """
    tree = closure(edges, roots, most_depth + 1, cut=True)
    lost = tree.join(known.select("node"), "node", "left_anti").groupBy("root").agg(F.count("*").alias("missing"))
    per = tree.groupBy("root").agg(F.count("*").alias("nodes"), F.max("depth").alias("depth")).join(lost, "root", "left")
    outcome = F.when(F.col("depth") > most_depth, "too_deep").when(F.col("nodes") > most_nodes, "too_many").when(F.col("missing") > 0, "missing").otherwise("resolved")
    return per.select("root", "nodes", "depth", outcome.alias("outcome"))


def protected(candidates: DataFrame, edges: DataFrame, live: DataFrame) -> DataFrame:
    """``candidates`` (node) with whether anything live (column root) reaches them."""
    reached = closure(edges, live).select("node").distinct().withColumn("protected", F.lit(True))
    return candidates.join(reached, "node", "left").withColumn("protected", F.coalesce("protected", F.lit(False)))


def invalidated(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(node, depth) of all that must be done again after a change of nodes (column node): what depends on them, however far."""
    back = edges.select(F.col("dep").alias("node"), F.col("node").alias("dep"))
    return closure(back, changed.select(F.col("node").alias("root"))).groupBy("node").agg(F.min("depth").alias("depth"))


def ancestry(roots: DataFrame, edges: DataFrame, recorded: DataFrame, observed: DataFrame) -> DataFrame:
    """(root, ancestors, wrong): how many ancestors a manifest has, and how many are not what was recorded (node, digest)."""
    tree = closure(edges, roots).filter("depth > 0")
    both = recorded.select("node", F.col("digest").alias("w")).join(observed.select("node", F.col("digest").alias("g")), "node", "left")
    judged = tree.join(both, "node", "left")
    per = judged.groupBy("root").agg(F.count("*").alias("ancestors"), F.count_if(F.coalesce(F.col("w") != F.col("g"), F.lit(True))).alias("wrong"))
    return roots.select("root").distinct().join(per, "root", "left").fillna({"ancestors": 0, "wrong": 0})
