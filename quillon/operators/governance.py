"""Decisions over catalogs: requests against policies, admissions, routes, resolution with rejections, frozen hypotheses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shown import canonical_digest
from . import dag, lookup
from .gates import RANKS, quality_satisfies, reasons

#: Stages that a candidate passes, in order.
STAGES = ["topology", "route", "index", "policy", "disposition", "assurance", "compatibility", "revocation", "manifest", "receipt", "encoding", "dependency"]


def promotion(requests: DataFrame, grade: str, target: str, reviews: str, least_reviews: int, certificate: str) -> DataFrame:
    """Requests with every reason against promotion: unknown or lower target, too few reviews, no certificate for the certified grade."""
    rank = lambda c: F.try_element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), F.col(c))
    out = requests.withColumn("reasons", reasons(
        ("unknown_grade", rank(grade).isNull() | rank(target).isNull()), ("not_higher", F.coalesce(rank(target) <= rank(grade), F.lit(False))),
        ("reviews", F.col(reviews) < least_reviews), ("certificate", (F.col(target) == "certified") & F.col(certificate).isNull()),
    ))
    return out.withColumn("accepted", F.size("reasons") == 0)


def capability_failures(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """(request, kind, name, code) of needs (request, kind, name, least) that a catalog (kind, name, most) can't meet."""
    both = requests.join(catalog, ["kind", "name"], "left")
    code = F.when(F.col("most").isNull(), "unsupported").when(F.col("most") < F.col("least"), "insufficient")
    return both.withColumn("code", code).filter("code IS NOT NULL").select("request", "kind", "name", "code")


def observation_problems(lambda_squared: Column, modes: Column, bits: Column, first: Column, last: Column) -> Column:
    """Why an observation request is not valid."""
    finite = ~F.isnan(lambda_squared) & (F.abs(lambda_squared) < float("inf"))
    return reasons(("cutoff", ~(finite & (lambda_squared > 1))), ("modes", modes <= 0), ("precision", bits < 53), ("target", (first < 1) | (last < first)))


def observation_plan(df: DataFrame, lambda_squared: str, last: str, digits: str, guard: str) -> DataFrame:
    """Height that the last wanted zero needs, least modes that reach it and bits for the digits, at least 64."""
    from ..functions.numbers import zero_height

    height = zero_height(F.col(last))
    modes = F.ceil(F.round(height * F.log(lambda_squared) / (2 * F.pi()), 9)).cast("long")
    bits = F.greatest(F.lit(64), F.ceil((F.col(digits) + F.col(guard)) * F.log2(F.lit(10.0)))).cast("long")
    return df.withColumns({"height": height, "least_modes": modes, "bits": bits})


def family_of(df: DataFrame, catalog: DataFrame, kind: str = "kind") -> DataFrame:
    """``df`` with the family of its kind; unknown kinds have none. The catalog is one row a kind."""
    return df.join(catalog.select(F.col("kind").alias(kind), "family").dropDuplicates([kind]), kind, "left")


def kinds_of(catalog: DataFrame, family: str) -> DataFrame:
    return catalog.filter(F.col("family") == family).select("kind").distinct()


def contract(df: DataFrame, contracts: DataFrame, kind: str = "kind") -> DataFrame:
    """``df`` with its kind's codec and producer, and a status: known, reserved or unknown."""
    own = contracts.select(F.col("kind").alias(kind), "codec", "producer", "reserved", F.lit(True).alias("__known"))
    status = F.when(F.col("__known").isNull(), "unknown").when(F.col("reserved"), "reserved").otherwise("known")
    return df.join(own, kind, "left").withColumn("status", status).drop("__known", "reserved")


def registration_problems(declared: DataFrame, registered: DataFrame, key: str) -> DataFrame:
    """(key, problem) of names on one side only, or registered more than once."""
    a, b = declared.select(key).distinct().withColumn("__a", F.lit(True)), registered.groupBy(key).agg(F.count("*").alias("__n"))
    problem = F.when(F.col("__n").isNull(), "missing").when(F.col("__a").isNull(), "unexpected").when(F.col("__n") > 1, "duplicate")
    return a.join(b, key, "full_outer").select(key, problem.alias("problem")).filter("problem IS NOT NULL")


def admitted(manifests: DataFrame, catalog: DataFrame, destination: str) -> DataFrame:
    """Manifests (kind, semantics, ...) that may go to a destination: a known kind at its current semantics, public kinds alone to a public one."""
    known = catalog.select("kind", F.col("semantics").alias("__semantics"), F.col("public").alias("__public"))
    both = manifests.join(known, "kind").filter("semantics = __semantics")
    return (both.filter("__public") if destination == "public" else both).drop("__semantics", "__public")


def route(requests: DataFrame, topology: DataFrame) -> DataFrame:
    """Requests (family, visibility, ...) with the repository of the only route for both; none or several leave it null with a problem."""
    routes = topology.groupBy("family", "visibility").agg(F.min("repository").alias("repository"), F.count("*").alias("__n"))
    both = requests.join(routes, ["family", "visibility"], "left")
    problem = F.when(F.col("__n").isNull(), "no_route").when(F.col("__n") > 1, "ambiguous_route")
    return both.withColumn("problem", problem).withColumn("repository", F.when(F.col("problem").isNull(), F.col("repository"))).drop("__n")


def secret_names(names: Column, values: Column) -> Column:
    """Whether any name or value of two arrays looks like a credential: by the name's words, or by a value's form."""
    word = r"(?i)(^|[^a-z])(pass(word|wd)?|secret|token|api[_-]?key|credential|private[_-]?key)([^a-z]|$)"
    form = r"(?i)(-----BEGIN [A-Z ]*PRIVATE KEY-----|(password|secret|api_key|token)\s*[=:]\s*\S)"
    return F.exists(names, lambda n: n.rlike(word)) | F.exists(values, lambda v: F.coalesce(v.rlike(form), F.lit(False)))


# --- Resolution


def find(queries: DataFrame, entries: DataFrame, checks: dict[str, Column], order: list[Column], edges: DataFrame, sound: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(selected, rejections, tree) of queries (query, semantic) against candidates (semantic, artifact, ...).

    A candidate is rejected at the first stage whose check is not true; a stage without a check passes. The first candidate in the order that
    passes them all, and whose whole dependency closure is sound, is selected; one that fails by a dependency is rejected
    at that stage. The tree has every (query, node, depth) of the selected artifacts' closures.
    """
    unknown = set(checks) - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages {sorted(unknown)}")
    both = queries.join(entries, "semantic", "left")
    judged = lookup.staged(both, *[(s, checks[s]) for s in STAGES if s in checks])
    passed = judged.filter("failed_stage IS NULL")
    closure = dag.closure(edges, passed.select(F.col("artifact").alias("root")).distinct())
    unsound = closure.join(sound.select(F.col("artifact").alias("node")), "node", "left_anti").select(F.col("root").alias("artifact")).distinct().withColumn("__unsound", F.lit(True))
    passed = passed.join(unsound, "artifact", "left")
    chosen, refused = lookup.overlay(passed, ["query"], order, F.col("__unsound").isNull())
    rejections = judged.filter("failed_stage IS NOT NULL").select("query", "artifact", F.col("failed_stage").alias("stage"))
    rejections = rejections.unionByName(refused.select("query", "artifact", F.lit("dependency").alias("stage")))
    tree = chosen.select("query", F.col("artifact").alias("root")).join(closure, "root").select("query", "node", "depth")
    return chosen.select("query", "semantic", "artifact"), rejections, tree


#: Where an artifact may lie, the nearest first.
SOURCES = ["bundle", "workspace", "local", "remote"]


def resolve(queries: DataFrame, copies: DataFrame, accepted: Column) -> DataFrame:
    """Queries (query, semantic) with the nearest acceptable copy (semantic, source, artifact, ...), or with a problem and how many were refused.

    Of copies of one artifact in one source the acceptable ones come first.
    """
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    both = queries.join(copies, "semantic")
    chosen, refused = lookup.overlay(both, ["query"], [rank, F.col("artifact"), ~accepted], accepted & (rank > 0))
    n = refused.groupBy("query").agg(F.count("*").alias("refused"))
    out = queries.join(chosen.select("query", "source", "artifact"), "query", "left").join(n, "query", "left")
    return out.select("query", "source", "artifact", F.coalesce("refused", F.lit(0)).alias("refused"), F.when(F.col("artifact").isNull(), "not_found").alias("problem"))


def certified_against(df: DataFrame, references: DataFrame, on: str, value: str, lo: str, hi: str, reference: str) -> DataFrame:
    """Digits that agree with a reference, only for rows whose certificate holds: an ordered enclosure with the value inside."""
    holds = F.coalesce((F.col(lo) <= F.col(value)) & (F.col(value) <= F.col(hi)), F.lit(False))
    out = lookup.against_reference(df.withColumn("certified", holds), references, on, value, reference)
    inside = F.col(reference).between(F.col(lo), F.col(hi))
    return out.withColumns({"digits": F.when(F.col("certified"), F.col("digits")), "reference_inside": F.when(F.col("certified"), inside)})


def frozen_members(manifests: DataFrame, member: str, role: str, identity: str) -> DataFrame:
    """(member, problems) of cohorts' members: one state, at most one table of roots, and no identity twice."""
    per = manifests.groupBy(member).agg(
        F.count_if(F.col(role) == "state").alias("states"), F.count_if(F.col(role) == "roots").alias("roots"), F.count("*").alias("n"), F.count_distinct(identity).alias("ids")
    )
    return per.select(member, reasons(("state", F.col("states") != 1), ("roots", F.col("roots") > 1), ("identity", F.col("n") != F.col("ids"))).alias("problems"))


# --- Hypotheses


def freeze(cases: DataFrame, partitions: list[str]) -> DataFrame:
    """Cases (case_id, partition, prediction, tolerance) with the digest that later evaluations must name; invalid tables are errors when read.

    Refused: a case twice, an unknown partition, a prediction or tolerance that is missing, a tolerance below zero.
    """
    bad = ~F.col("partition").isin(*partitions) | F.col("prediction").isNull() | F.coalesce(F.col("tolerance") < 0, F.lit(True)) | F.col("case_id").isNull()
    once = cases.groupBy("case_id").agg(F.first("partition").alias("partition"), F.first("prediction").alias("prediction"), F.first("tolerance").alias("tolerance"), F.count("*").alias("__n"), F.bool_or(F.coalesce(bad, F.lit(True))).alias("__bad"))
    valid = F.when((F.col("__n") > 1) | F.col("__bad"), F.raise_error(F.concat(F.lit("not a valid case: "), F.coalesce(F.col("case_id").cast("string"), F.lit("null"))))).otherwise(F.col("prediction"))
    out = once.select("case_id", "partition", valid.alias("prediction"), "tolerance")
    return out.withColumn("digest", canonical_digest({c: F.col(c) for c in ("case_id", "partition", "prediction", "tolerance")}))


def evaluate(frozen: DataFrame, observed: DataFrame, protected: bool = False) -> DataFrame:
    """(case_id, partition, digest, observed, status) of frozen cases against observations (case_id, value, eligible).

    The protected partition is left alone unless asked for. A case without an observation is missing, an ineligible one says so.
    """
    cases = frozen if protected else frozen.filter("partition <> 'protected'")
    both = cases.join(observed.select("case_id", F.col("value").alias("observed"), "eligible"), "case_id", "left")
    status = (
        F.when(F.col("observed").isNull(), "missing").when(~F.coalesce("eligible", F.lit(False)), "ineligible")
        .when(F.abs(F.col("observed") - F.col("prediction")) <= F.col("tolerance"), "pass").otherwise("fail")
    )
    return both.select("case_id", "partition", "digest", "observed", status.alias("status"))


def merged_config(layers: DataFrame, ranks: list[str], allowed_env: list[str]) -> DataFrame:
    """(path, value, source, shadowed, problem) of configuration layers (path, value, source): the strongest source wins.

    ``ranks`` names the sources, the weakest first. The environment may only set allowed paths; a path twice in one source is refused.
    """
    rank = F.array_position(F.array(*map(F.lit, ranks)), F.col("source"))
    known = layers.filter((rank > 0) & ((F.col("source") != "environment") | F.col("path").isin(*allowed_env)))
    per = known.groupBy("path", "source").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    out = per.withColumn("rank", rank).groupBy("path").agg(F.max_by(F.struct("value", "source"), "rank").alias("x"), (F.count("*") - 1).alias("shadowed"), F.max("n").alias("n"))
    twice = F.col("n") > 1
    return out.select("path", F.when(~twice, F.col("x.value")).alias("value"), F.when(~twice, F.col("x.source")).alias("source"), "shadowed", F.when(twice, "duplicate_source").alias("problem"))


def audit_shards(registered: DataFrame, indexed: DataFrame, stored: DataFrame) -> DataFrame:
    """(shard, objects, bytes, unindexed, dangling) of shards: objects that no index names, and index entries without an object."""
    both = stored.select("shard", "object", "bytes").join(indexed.select("shard", "object", F.lit(True).alias("__i")), ["shard", "object"], "full_outer")
    per = both.groupBy("shard").agg(
        F.count("bytes").alias("objects"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"),
        F.count_if(F.col("__i").isNull()).alias("unindexed"), F.count_if(F.col("bytes").isNull()).alias("dangling"),
    )
    zero = {c: 0 for c in ("objects", "bytes", "unindexed", "dangling")}
    return registered.select("shard").join(per, "shard", "left").fillna(zero)


def repairs(computed: DataFrame, stored: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, action) for index partitions that drifted: write, replace or remove; sound ones give no row."""
    a, b = computed.select(key, F.col(digest).alias("w")), stored.select(key, F.col(digest).alias("g"))
    action = F.when(F.col("g").isNull(), "write").when(F.col("w").isNull(), "remove").when(F.col("w") != F.col("g"), "replace")
    return a.join(b, key, "full_outer").select(key, action.alias("action")).filter("action IS NOT NULL")


def duplicates(artifacts: DataFrame, semantic: str, digest: str) -> DataFrame:
    """(semantic, artifacts, digests) of identities that were computed more than once, and with how many contents."""
    return artifacts.groupBy(semantic).agg(F.count("*").alias("artifacts"), F.count_distinct(digest).alias("digests")).filter("artifacts > 1")
