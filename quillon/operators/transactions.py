"""Publication transactions as tables: phases that only go forward, leases with fencing, rollover; each step is a new table, nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phases of a transaction, in order, and the two that end it.
PHASES = ["planned", "staged", "uploaded", "indexed", "complete"]
TERMINAL = ("complete", "abandoned")


def current(journal: DataFrame) -> DataFrame:
    """(tx, phase, seq) of the last checkpoint of each transaction in an append-only journal (tx, seq, phase)."""
    return journal.groupBy("tx").agg(F.max_by("phase", "seq").alias("phase"), F.max("seq").alias("seq"))


def next_phase(phase: Column) -> Column:
    """The phase after this one; null for terminal and unknown ones."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in zip(PHASES, PHASES[1:], strict=False) for x in pair]), phase)


def inspected(journal: DataFrame) -> DataFrame:
    """(tx, phase, next, resumable): where each transaction stands and how it goes on."""
    return current(journal).select("tx", "phase", next_phase(F.col("phase")).alias("next"), (~F.col("phase").isin(*TERMINAL)).alias("resumable"))


def advance(journal: DataFrame, requests: DataFrame) -> DataFrame:
    """Checkpoints (tx, seq, phase) to append for requests (tx, seen): one step, only where the journal still stands at what was seen."""
    now = current(journal).join(requests.groupBy("tx").agg(F.max("seen").alias("seen")), "tx")
    step = next_phase(F.col("phase"))
    return now.filter((F.col("seq") == F.col("seen")) & step.isNotNull()).select("tx", (F.col("seq") + 1).alias("seq"), step.alias("phase"))


def completed(journal: DataFrame) -> DataFrame:
    """All checkpoints that take every open transaction to its end, one phase a row."""
    now = current(journal).filter(~F.col("phase").isin(*TERMINAL))
    at = F.array_position(F.array(*map(F.lit, PHASES)), F.col("phase")).cast("int")
    rest = F.slice(F.array(*map(F.lit, PHASES)), at + 1, F.lit(len(PHASES)) - at)
    return now.filter(at > 0).select("tx", "seq", F.posexplode(rest).alias("k", "phase")).select("tx", (F.col("seq") + F.col("k") + 1).alias("seq"), "phase")


def abandoned(journal: DataFrame, requests: DataFrame, receipts: DataFrame) -> DataFrame:
    """(tx, seq, phase, refused) of requests to give transactions up: refused where a receipt proves that the target is published, or where it has ended."""
    now = current(journal).join(requests.select("tx").distinct(), "tx").join(receipts.select("tx", F.lit(True).alias("__r")).distinct(), "tx", "left")
    refused = F.when(F.col("__r").isNotNull(), "published").when(F.col("phase").isin(*TERMINAL), "ended")
    return now.select("tx", F.when(refused.isNull(), F.col("seq") + 1).alias("seq"), F.when(refused.isNull(), "abandoned").alias("phase"), refused.alias("refused"))


def leased(leases: DataFrame, requests: DataFrame, at: int, seconds: int) -> DataFrame:
    """(resource, owner, token, until, granted) after requests (resource, owner, asked) at a time, the earliest first.

    A free or expired lease goes to the first who asks, with a token one higher; its owner renews it with the same token.
    """
    first = requests.groupBy("resource").agg(F.min_by("owner", F.struct("asked", "owner")).alias("wants"), F.max_by(F.col("owner"), F.struct("asked", "owner")).alias("__last"), F.collect_set("owner").alias("all"))
    both = leases.join(first, "resource", "full_outer")
    live = F.coalesce(F.col("until") > at, F.lit(False))
    renews = live & F.array_contains("all", F.col("owner"))
    takes = ~live & F.col("wants").isNotNull()
    return both.select(
        "resource", F.when(takes, F.col("wants")).otherwise(F.col("owner")).alias("owner"), (F.coalesce("token", F.lit(0)) + takes.cast("int")).alias("token"),
        F.when(F.coalesce(renews, F.lit(False)) | takes, F.lit(at + seconds)).otherwise(F.col("until")).alias("until"), (F.coalesce(renews, F.lit(False)) | takes).alias("granted"),
    )


def released(leases: DataFrame, requests: DataFrame, at: int) -> DataFrame:
    """Leases after releases (resource, owner, token); a stale token or another owner changes nothing."""
    own = requests.select("resource", "owner", "token").distinct().withColumn("__r", F.lit(True))
    both = leases.join(own, ["resource", "owner", "token"], "left")
    return both.select("resource", "owner", "token", F.when(F.col("__r"), F.least(F.col("until"), F.lit(at))).otherwise(F.col("until")).alias("until"))


def rolled_over(topology: DataFrame, limit: int) -> DataFrame:
    """Shards (family, shard, status, generation, bytes) after rollover: a writable shard beyond its limit closes, and its family gets one of the next generation.

    The new shard's name binds it to the one before.
    """
    full = (F.col("status") == "writable") & (F.col("bytes") > limit)
    old = topology.withColumn("status", F.when(full, "closed").otherwise(F.col("status")))
    name = F.concat(F.lit("g"), (F.col("generation") + 1).cast("string"), F.lit("-"), F.substring(F.sha2(F.concat_ws("/", "family", F.col("shard").cast("string"), F.col("generation").cast("string")), 256), 1, 8))
    last = topology.filter(full).groupBy("family").agg(F.max_by(F.struct("shard", "generation"), F.struct("generation", "shard")).alias("x")).select("family", "x.shard", "x.generation")
    new = last.select("family", name.alias("shard"), F.lit("writable").alias("status"), (F.col("generation") + 1).alias("generation"), F.lit(0).cast("long").alias("bytes"))
    return old.withColumn("shard", F.col("shard").cast("string")).unionByName(new.select(*topology.columns))


def updated(partition: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(partition after, conflicts) of inserting records (key, value): equal ones change nothing, other values for a known key are conflicts and stay out."""
    both = partition.select("key", F.col("value").alias("old")).join(records.select("key", F.col("value").alias("new")).distinct(), "key", "full_outer")
    several = both.groupBy("key").agg(F.first("old").alias("old"), F.count_distinct("new").alias("n"), F.min("new").alias("new"))
    clash = (F.col("n") > 1) | (F.col("old").isNotNull() & F.col("new").isNotNull() & (F.col("old") != F.col("new")))
    after = several.filter(F.col("old").isNotNull() | ~clash).select("key", F.coalesce("old", "new").alias("value"))
    return after, several.filter(clash).select("key")
