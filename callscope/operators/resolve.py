"""Call resolution: which definition, if any, a called name means.

A name is looked up in the caller's lexical scopes, innermost first, then in its file,
then in its repository.  The first tier with any match decides: one match is a link, more
are ambiguous and no lower tier is asked.  Without a match the callee is external.

The outcome depends on caller and name only, so sites are summed up to these first.  Two
indexes hold one row per key, so each join keeps its left side's size, and a popular name
makes a hot key only on the side that Spark can split.  The first is keyed by file and
name and lists the qualified names that end so: as every scope's candidate ends with the
name, the scopes are tried inside the row, without a join each.

Rows are dealt out by the key of the coming join before they are summed up, so sums and
join share one exchange, and sorts run in all tasks instead of in those that read a small
file.  The indexes are the hashed sides of their joins: they have a row per key, and the
calls need no sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.schema import EXTERNAL, FUNCTION

TIERS = ("lexical_scope", "same_file", "repository_unique")


def index(definitions: DataFrame, *keys: str) -> DataFrame:
    """Matches and one id per key."""
    return definitions.groupBy("repo_name", *keys).agg(F.count(F.lit(1)).alias("matches"), F.min("entity_id").alias("target_id"))


def candidates(qualified_name, name):
    """Qualified names that ``name`` may mean inside a definition, innermost scope first."""
    scope = F.split(qualified_name, r"\.")
    return F.transform(F.sequence(F.size(scope), F.lit(0), F.lit(-1)), lambda d: F.concat_ws(".", F.slice(scope, F.lit(1), d), F.array(name)))


def file_index(definitions: DataFrame) -> DataFrame:
    """Per file and name: ``scoped``, what stands before it in the qualified names that end with it (innermost last by length), and ``m1``, the definitions of the name (null if none)."""
    parts = F.split("qualified_name", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat_ws(".", F.slice(parts, k, F.size(parts))))
    each = definitions.select("repo_name", "file_path", "qualified_name", "entity_id", F.col("name").alias("own"), F.explode(F.array_union(tails, F.array("name"))).alias("name"))
    each = each.repartition("repo_name", "file_path", "name")
    named = F.when(F.col("own") == F.col("name"), F.col("entity_id"))
    per = each.groupBy("repo_name", "file_path", "name", "qualified_name").agg(F.count(F.lit(1)).alias("matches"), F.min("entity_id").alias("target_id"), F.count(named).alias("n1"), F.min(named).alias("id1"))
    scope = F.expr("left(qualified_name, length(qualified_name) - length(name))")
    whole_part = F.endswith(F.col("qualified_name"), F.col("name")) & ((F.length(scope) == 0) | F.endswith(scope, F.lit(".")))
    entry = F.when(whole_part, F.struct(F.length(scope).alias("depth"), scope.alias("scope"), "matches", "target_id"))
    whole = per.groupBy("repo_name", "file_path", "name").agg(F.collect_list(entry).alias("scoped"), F.sum("n1").alias("n1"), F.min("id1").alias("id1"))
    return whole.select("repo_name", "file_path", "name", "scoped", F.when(F.col("n1") > 0, F.struct(F.col("n1").alias("matches"), F.col("id1").alias("target_id"))).alias("m1"))


def sites_of(functions: DataFrame) -> DataFrame:
    """Call sites of parsed functions (repo_name, entity_id, file_path, qualified_name, calls): a row each, in source order."""
    each = functions.select("repo_name", F.col("entity_id").alias("caller_id"), "file_path", "qualified_name", F.posexplode(F.transform("calls", lambda c: c["name"])).alias("ordinal", "name"))
    return each.where(F.length("name") > 0)


def resolve(sites: DataFrame, definitions: DataFrame) -> DataFrame:
    """Outcome of each (caller, name).

    sites: repo_name, caller_id, file_path, qualified_name, name, ordinal.
    definitions: repo_name, entity_id, file_path, qualified_name, name.
    Returns repo_name, caller_id, file_path, name, n_sites, first_ordinal, matches (0 if
    external), resolution, target_id (null unless there is one match).
    """
    keys = ["repo_name", "caller_id", "file_path", "qualified_name", "name"]
    calls = sites.select(*keys, "ordinal").repartition("repo_name", "file_path", "name").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sites"), F.min("ordinal").alias("first_ordinal"))
    return outcomes(calls, definitions)


def outcomes(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """:func:`resolve` of sites that are summed up already: a row per (caller, name), with n_sites and first_ordinal."""
    found = calls.join(file_index(definitions).hint("shuffle_hash"), ["repo_name", "file_path", "name"], "left")
    found = found.join(index(definitions, "name").select("repo_name", "name", F.struct("matches", "target_id").alias("m2")), ["repo_name", "name"], "left")
    # A scope of the caller is a start of its qualified name; those lie inside each other, so the innermost is the longest.
    inside = F.concat("qualified_name", F.lit("."))
    found = found.withColumn("m0", F.array_max(F.filter("scoped", lambda x: F.startswith(inside, x["scope"]))))
    tier = F.coalesce(*(F.when(F.col(f"m{k}").isNotNull(), F.struct(F.lit(t).alias("resolution"), F.col(f"m{k}.matches").alias("matches"), F.col(f"m{k}.target_id").alias("target_id"))) for k, t in enumerate(TIERS)))
    found = found.withColumn("t", tier)
    return found.select(
        "repo_name", "caller_id", "file_path", "name", "n_sites", "first_ordinal",
        F.coalesce("t.matches", F.lit(0)).alias("matches"),
        F.coalesce("t.resolution", F.lit("external")).alias("resolution"),
        F.when(F.col("t.matches") == 1, F.col("t.target_id")).alias("target_id"),
    )


def internal_edges(resolved: DataFrame) -> DataFrame:
    """One edge per (caller, target): its sites, and the resolution of the first of them."""
    one = resolved.where(F.col("matches") == 1).select("repo_name", "caller_id", "target_id", "resolution", "first_ordinal", "name", "n_sites", "file_path").repartition("repo_name", "caller_id")
    return one.groupBy("repo_name", "caller_id", "target_id").agg(
        F.min_by("resolution", F.struct("first_ordinal", "name")).alias("resolution"), F.sum("n_sites").alias("call_count"), F.min("file_path").alias("source_file")
    )


def external_edges(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("matches") == 0).select("repo_name", "caller_id", F.col("name").alias("target_name"), F.col("n_sites").alias("call_count"), F.col("file_path").alias("source_file"))


def ambiguous_names(resolved: DataFrame) -> DataFrame:
    """Names of each caller that several definitions share, in order of first occurrence."""
    many = resolved.where(F.col("matches") > 1).select("repo_name", "caller_id", "first_ordinal", "name").repartition("repo_name", "caller_id")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("first_ordinal", "name"))), lambda x: x["name"])
    return many.groupBy("repo_name", "caller_id").agg(ordered.alias("ambiguous_calls"))


def call_table(resolved: DataFrame) -> DataFrame:
    """Both kinds of edges in the columns of ``calls``, in one pass."""
    one = F.col("matches") == 1
    rows = resolved.where(F.col("matches") <= 1).select(
        "repo_name", "caller_id", F.when(one, FUNCTION).otherwise(EXTERNAL).alias("target_kind"), F.when(one, F.col("target_id")).otherwise(F.col("name")).alias("target_key"),
        "resolution", "n_sites", "first_ordinal", "name", "file_path",
    )
    return rows.repartition("repo_name", "caller_id").groupBy("repo_name", "caller_id", "target_kind", "target_key").agg(
        F.min_by("resolution", F.struct("first_ordinal", "name")).alias("resolution"), F.sum("n_sites").alias("call_count"), F.min("file_path").alias("source_file")
    )


def resolve_flat(sites: DataFrame, definitions: DataFrame) -> DataFrame:
    """The earlier resolver: a target by its exact qualified name (the last definition wins), else by a unique simple name, else ``external::<target>``.

    sites: repo_name, caller_id, target, line.  Returns caller_id, target_id, count, locations (sorted lines).
    """
    exact = definitions.groupBy("repo_name", F.col("qualified_name").alias("target")).agg(F.max("entity_id").alias("exact_id"))
    simple = index(definitions, "name").where(F.col("matches") == 1).select("repo_name", F.col("name").alias("simple"), F.col("target_id").alias("simple_id"))
    grouped = sites.groupBy("repo_name", "caller_id", "target").agg(F.count(F.lit(1)).alias("n"), F.collect_list("line").alias("lines"))
    rows = grouped.withColumn("simple", F.element_at(F.split("target", r"\."), -1))
    rows = rows.join(exact, ["repo_name", "target"], "left").join(simple, ["repo_name", "simple"], "left")
    rows = rows.withColumn("target_id", F.coalesce("exact_id", "simple_id", F.concat(F.lit("external::"), "target")))
    merged = rows.groupBy("repo_name", "caller_id", "target_id").agg(F.sum("n").alias("count"), F.sort_array(F.flatten(F.collect_list("lines"))).alias("locations"))
    return merged
