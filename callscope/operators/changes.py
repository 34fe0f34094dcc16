"""Push events: which files a push changed, and what that does to a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.identity import is_repository_path, normalize_path
from callscope.functions.text import is_supported
from callscope.operators.checkpoints import cut
from callscope.operators.graph import Graph
from callscope.operators.resolve import ambiguous_names, call_table, resolve
from callscope.schema import EXTERNAL, FUNCTION

MOST_COMMITS = 20


def _real(sha: Column) -> Column:
    return F.coalesce((F.length(sha) > 0) & ~F.rlike(sha, F.lit("^0+$")), F.lit(False))


def admissible() -> Column:
    """Whether a push event (columns of PUSH_EVENT) holds a complete change set: all its commits, few enough, no forced or created or deleted branch."""
    n = F.size("commits")
    whole = F.forall("commits", lambda c: c.isNotNull() & c["added"].isNotNull() & c["modified"].isNotNull() & c["removed"].isNotNull())
    plain = ~(F.coalesce("forced", F.lit(False)) | F.coalesce("created", F.lit(False)) | F.coalesce("deleted", F.lit(False)))
    return F.coalesce((n > 0) & (n < MOST_COMMITS) & (F.col("size") == n) & plain & _real(F.col("before")) & _real(F.col("after")) & whole, F.lit(False))


def repository(event: str = "repository") -> Column:
    """``owner/repository`` of a push event; null if it can't be told."""
    given = lambda c: F.nullif(c, F.lit(""))
    full = F.when(F.contains(F.col(f"{event}.full_name"), F.lit("/")), F.col(f"{event}.full_name"))
    owner = F.coalesce(given(F.col(f"{event}.owner.login")), given(F.col(f"{event}.owner.name")), given(F.substring_index(full, "/", 1)))
    name = F.coalesce(given(F.col(f"{event}.name")), given(F.expr(f"substring({event}.full_name, instr({event}.full_name, '/') + 1)")))
    return F.concat(owner, F.lit("/"), name)


def path_states(changes: DataFrame, *keys: str) -> DataFrame:
    """Last state of each path: changes has the keys, path, seq (any order) and op (``updated`` or ``removed``); the greatest (seq, op) wins."""
    return changes.groupBy(*keys, "path").agg(F.max_by("op", F.struct("seq", "op")).alias("state"))


def change_set(events: DataFrame, *keys: str) -> DataFrame:
    """keys, updated, deleted: sorted paths of each admissible event, by commits in order, in a commit additions and modifications before removals.

    Paths are normalised; only supported languages count.
    """
    rows = events.where(admissible()).select(*keys, F.posexplode("commits").alias("commit", "c"))
    ops = F.array(*(F.struct(F.lit(k).alias("rank"), F.lit(op).alias("op"), F.col(f"c.{field}").alias("paths")) for k, (field, op) in enumerate((("added", "updated"), ("modified", "updated"), ("removed", "removed")))))
    rows = rows.select(*keys, "commit", F.inline(ops)).select(*keys, F.struct("commit", "rank").alias("seq"), "op", F.explode("paths").alias("raw"))
    rows = rows.select(*keys, normalize_path(F.col("raw")).alias("path"), "seq", "op").where(is_supported(F.col("path")))
    last = path_states(rows, *keys)
    of = lambda s: F.sort_array(F.collect_list(F.when(F.col("state") == s, F.col("path"))))
    return last.groupBy(*keys).agg(of("updated").alias("updated"), of("removed").alias("deleted"))


def valid_paths(events: DataFrame) -> Column:
    """Whether all paths of an event stay inside the repository."""
    paths = F.flatten(F.transform("commits", lambda c: F.concat(c["added"], c["modified"], c["removed"])))
    return F.forall(paths, is_repository_path)


def stale_functions(functions: DataFrame, affected: DataFrame, surviving: DataFrame) -> DataFrame:
    """Functions in affected files (repo_name, path) whose id is null or not surviving (repo_name, entity_id)."""
    at = functions.join(affected.select("repo_name", F.col("path").alias("file_path")), ["repo_name", "file_path"], "left_semi")
    return at.join(surviving.select("repo_name", "entity_id"), ["repo_name", "entity_id"], "left_anti")


def apply_change_set(g: Graph, files: DataFrame, functions: DataFrame, sites: DataFrame, deleted: DataFrame) -> Graph:
    """The graph after files changed and went.

    files: (repo_name, path, updated_at) of changed files; functions: their definitions in
    the columns of ``functions`` but for ambiguous_calls; sites as in ``resolve``; deleted:
    (repo_name, path).  A path that is both changed and deleted is changed.  Calls into
    surviving definitions stay, and unchanged files are not resolved anew.
    """
    changed = files.select("repo_name", "path").distinct()
    gone = deleted.select("repo_name", "path").distinct().join(changed, ["repo_name", "path"], "left_anti")
    affected = cut(changed.unionByName(gone))
    at = affected.withColumnRenamed("path", "file_path")
    others = g.functions.join(at, ["repo_name", "file_path"], "left_anti")
    ids_left = cut(others.select("repo_name", "entity_id"))  # narrow: code and vectors are read once, by whoever reads the result
    definitions = others.select("repo_name", "entity_id", "file_path", "qualified_name", "name").where(F.col("entity_id").isNotNull() & F.col("name").isNotNull() & F.col("qualified_name").isNotNull() & F.col("file_path").isNotNull())
    new = functions.dropDuplicates(["repo_name", "entity_id"]).join(changed.withColumnRenamed("path", "file_path"), ["repo_name", "file_path"], "left_semi")
    resolved = cut(resolve(sites, definitions.unionByName(new.select(*definitions.columns))))  # read three times
    new = new.drop("ambiguous_calls").join(ambiguous_names(resolved).withColumnRenamed("caller_id", "entity_id"), ["repo_name", "entity_id"], "left")
    new = new.withColumn("ambiguous_calls", F.coalesce("ambiguous_calls", F.array().cast("array<string>")))
    old = g.functions.join(at, ["repo_name", "file_path"], "left_semi").select("repo_name", "entity_id", F.col("leiden_community").alias("_was"))
    new = new.drop("leiden_community").join(old, ["repo_name", "entity_id"], "left").withColumnRenamed("_was", "leiden_community")  # until clusters are found anew
    all_functions = others.unionByName(new.select(*others.columns))
    kept = g.calls.join(ids_left.select("repo_name", F.col("entity_id").alias("caller_id")), ["repo_name", "caller_id"], "left_semi")
    ids = ids_left.unionByName(new.select("repo_name", "entity_id")).select("repo_name", F.col("entity_id").alias("target_key"))
    inside = kept.where(F.col("target_kind") == FUNCTION).join(ids, ["repo_name", "target_key"], "left_semi")
    calls = inside.unionByName(kept.where(F.col("target_kind") == EXTERNAL)).unionByName(call_table(resolved))
    called = calls.where(F.col("target_kind") == EXTERNAL).select("repo_name", F.col("target_key").alias("name")).distinct()
    old_files = g.files.join(affected, ["repo_name", "path"], "left_anti")
    return Graph(files=old_files.unionByName(files.select(*old_files.columns)), functions=all_functions, external_functions=called, calls=calls, communities=g.communities, repositories=g.repositories)
