"""Communities: projection of a source graph, Leiden, modularity, labels.

One Leiden for all sizes, in whole numbers and rounds of simultaneous steps, so it does not
matter where it runs: a repository whose graph has at most ``KERNEL_EDGES`` edges is
clustered by one task, all such repositories in parallel; a larger one by joins, level by
level until its graph has shrunk to that.  The result is the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions.view import fallback_name
from callscope.operators.checkpoints import cut, kept
from callscope.operators.graph import Graph, community_samples, defines, pooled, running_number
from callscope.schema import EXTERNAL, FUNCTION, MIN_LABELED_COMMUNITY, UNGROUPED_DESCRIPTION, UNGROUPED_ID, UNGROUPED_NAME

#: Edges up to which one task clusters a repository: some 150 bytes each in a worker.  Where it runs changes no result.
KERNEL_EDGES = 4_000_000
#: Nodes move in turns of this many classes, drawn anew for each turn of all.
CLASSES = 4
#: Turns of all in a row without a new least number of moves that end a level: what then moves on swaps without an end.
PATIENCE = 3
#: Rounds in a row in which no part grows that end a refinement.
STILL = 2
SINGLETON_WARNING = 0.25


def projection(g: Graph) -> DataFrame:
    """Undirected graph as distinct (repo_name, s, t, type); s and t carry their kind.  Functions without edges have null t."""
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c))
    called = g.calls.select("repo_name", F.col("caller_id").alias("entity_id"), F.concat("target_kind", F.lit(":"), "target_key").alias("t"))
    calls = g.functions.select("repo_name", "entity_id").join(called, ["repo_name", "entity_id"], "left")
    calls = calls.select("repo_name", node(FUNCTION, "entity_id").alias("s"), "t", F.when(F.col("t").isNotNull(), F.lit("CALLS")).alias("type"))
    files = defines(g).select("repo_name", node("File", "file_path").alias("s"), node(FUNCTION, "entity_id").alias("t"), F.lit("DEFINES").alias("type"))
    return calls.unionByName(files).distinct()


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """repo_name, communities, modularity of weighted undirected edges (repo_name, s, t, weight) and members (repo_name, node, community).

    A loop counts twice in its node's degree.
    """
    m = lambda c: members.select("repo_name", F.col("node").alias(c), F.col("community").alias(f"{c}c"))
    both = edges.join(m("s"), ["repo_name", "s"]).join(m("t"), ["repo_name", "t"])
    ends = both.select("repo_name", "weight", F.inline(F.array(F.struct(F.col("sc").alias("community"), (F.col("sc") == F.col("tc")).cast("double").alias("inner")), F.struct(F.col("tc").alias("community"), F.lit(0.0).alias("inner")))))
    per = ends.groupBy("repo_name", "community").agg(F.sum("weight").alias("d"), F.sum(F.col("weight") * F.col("inner")).alias("l"))
    total = per.groupBy("repo_name").agg((F.sum("d") / 2).alias("m"))
    rows = per.join(total, "repo_name").where(F.col("m") > 0)
    return rows.groupBy("repo_name").agg(F.count(F.lit(1)).alias("communities"), F.sum(F.col("l") / F.col("m") - (F.col("d") / (2 * F.col("m"))) * (F.col("d") / (2 * F.col("m")))).alias("modularity"))


def _mixed(ids, r: int):
    """A number of 16 bits from node and round, alike for arrays and columns; ids below 2^31."""
    x = (ids * 2654435761 + (r + 1) * 805459861) % (1 << 32)
    high = x >> 15 if isinstance(x, np.ndarray) else F.shiftright(x, 15)
    x = (x ^ high if isinstance(x, np.ndarray) else x.bitwiseXOR(high)) * 1597334677 % (1 << 32)
    return x >> 16 if isinstance(x, np.ndarray) else F.shiftright(x, 16)


def _turn(ids, r: int):
    """Whether a node may move in round ``r``: once in each turn of ``CLASSES`` rounds."""
    return _mixed(ids, r // CLASSES) % CLASSES == r % CLASSES


def _awake(ids, r: int):
    return _mixed(ids, r) % 2 == 0


def _sums(s: np.ndarray, c: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (s, c), c below ``n``, and the sum of w of each."""
    key = s * n + c
    order = np.argsort(key, kind="stable")
    key, w = key[order], w[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first] // n, key[first] % n, np.add.reduceat(w, first) if len(first) else w


def _best(v: np.ndarray, c: np.ndarray, gain: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each v the c of the largest gain, of equal ones its own, else the lowest."""
    order = np.lexsort((c, ~own, -gain, v))
    first = order[np.flatnonzero(np.diff(v[order], prepend=-1))]
    return v[first], c[first], gain[first]


def _total(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, at, values)
    return out


class _Moves:
    """When a level's moving ends: after a turn without moves, or ``PATIENCE`` turns without a new least number."""

    def __init__(self):
        self.round, self.moves, self.least, self.since = 0, 0, None, 0

    def end(self, moved: int) -> bool:
        self.round, self.moves = self.round + 1, self.moves + moved
        if self.round % CLASSES:
            return False
        moves, self.moves = self.moves, 0
        self.since = 0 if self.least is None or moves < self.least else self.since + 1
        self.least = moves if self.least is None else min(self.least, moves)
        return not moves or self.since >= PATIENCE


def _move(ids, s, t, w, k, label) -> np.ndarray:
    """Nodes whose turn it is move to the neighbouring community of the largest gain."""
    m2 = int(k.sum())
    names, label = np.unique(label, return_inverse=True)
    n = len(names)
    turns, over = _Moves(), False
    while not over:
        up = _turn(ids, turns.round)
        total = _total(label, k, n)
        e = up[s]
        v, c, into = _sums(s[e], label[t[e]], w[e], n)
        own = label[v] == c
        gain = m2 * into - k[v] * (total[c] - np.where(own, k[v], 0))
        stay = -k * (total[label] - k)
        stay[v[own]] = gain[own]
        v, c, gain = _best(v, c, gain, own)
        go = gain > stay[v]
        label[v[go]] = c[go]
        over = turns.end(int(go.sum()))
    return names[label]


def _refine(ids, s, t, w, k, label) -> np.ndarray:
    """Parts of communities, each named by the node that began it: nodes still alone and awake join a part that is not, while that gains."""
    n, m2 = len(ids), int(k.sum())
    inner = label[s] == label[t]
    s, t, w = s[inner], t[inner], w[inner]
    part, r, still = np.arange(n), 0, 0
    while still < STILL:
        total, size = _total(part, k, n), np.bincount(part, minlength=n)
        up = _awake(ids, r) & (size[part] == 1)
        e = up[s] & ~up[t]
        v, c, into = _sums(s[e], part[t[e]], w[e], n)
        gain = m2 * into - k[v] * total[c]
        good = gain > 0
        v, c, _ = _best(v[good], c[good], gain[good], np.zeros(int(good.sum()), bool))
        part[v] = c
        still, r = 0 if len(v) else still + 1, r + 1
    return part


def _connected(label, s, t) -> np.ndarray:
    """The least node of each node's connected part of its community: minima travel along the edges, with jumps."""
    inner = label[s] == label[t]
    s, t = s[inner], t[inner]
    low, was = np.arange(len(label)), None
    while was is None or (low != was).any():
        was, low = low, low.copy()
        np.minimum.at(low, s, was[t])
        low = np.minimum(low, low[low])
    return low


def _levels(ids: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Community of each node, as the least node of a level's graph in it.

    ids: sorted names of nodes; a, b, w: distinct edges by place, of loops the weight once;
    label: the community in which each node starts.
    """
    owner = np.arange(len(ids))  # node of the present level that holds each input node
    while True:
        loop = a == b
        s, t, x = np.concatenate([a[~loop], b[~loop]]), np.concatenate([b[~loop], a[~loop]]), np.concatenate([w[~loop]] * 2)
        k = _total(a, w, len(ids)) + _total(b, w, len(ids))
        label = _move(ids, s, t, x, k, label)
        part = _refine(ids, s, t, x, k, label)
        kept, place = np.unique(part, return_inverse=True)
        if len(kept) == len(ids):
            return ids[_connected(label, s, t)][owner]
        owner = place[owner]
        a, b, w = _sums(np.minimum(place[a], place[b]), np.maximum(place[a], place[b]), w, len(kept))
        ids, label = ids[kept], label[kept]  # parts lie inside communities


def leiden(n: int, s: np.ndarray, t: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Community of each of ``n`` nodes (Traag, Waltman, van Eck 2019), resolution 1; weights are whole numbers.

    Local moving, refinement inside each community, aggregation of the refined parts, again
    until nothing merges; then communities in their connected parts.  Steps are taken at
    once by a class of nodes that a hash draws, ties go to the lowest community, so the
    result is fixed.
    """
    a, b, x = _sums(np.minimum(s, t), np.maximum(s, t), np.asarray(w).astype(np.int64), n)
    return _levels(np.arange(n), a, b, x, np.arange(n))


_FOUND = "repo_name string, id bigint, community bigint"


def _cluster(pdf: pd.DataFrame) -> pd.DataFrame:
    """All levels of one repository from edges (a, b, w) and the communities of their ends (la, lb)."""
    ends, starts = pdf[["a", "b"]].to_numpy(np.int64).ravel(), pdf[["la", "lb"]].to_numpy(np.int64).ravel()
    ids, first, place = np.unique(ends, return_index=True, return_inverse=True)
    found = _levels(ids, place[0::2], place[1::2], pdf["w"].to_numpy(np.int64), starts[first])
    return pd.DataFrame({"repo_name": pdf["repo_name"].iloc[0], "id": ids, "community": found})


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.hint("shuffle_hash")


def _renamed(rows: DataFrame, **columns: str) -> DataFrame:
    return rows.select(*(F.col(c).alias(new) for new, c in columns.items()))


def _moved(both: DataFrame, nodes: DataFrame, m2: int) -> DataFrame:
    """:func:`_move` by joins: (id, k, label) of nodes after moving; both: s, t, w in each direction."""
    state, turns, over = nodes, _Moves(), False
    while not over:
        r = turns.round
        totals = state.groupBy("label").agg(F.sum("k").alias("total"))
        st = state.select("id", "k", "label").join(_hashed(totals), "label")
        near = both.where(_turn(F.col("s"), r)).join(_hashed(_renamed(st, t="id", c="label", total="total")), "t").groupBy("s", "c", "total").agg(F.sum("w").alias("into"))
        mine = _renamed(st.where(_turn(F.col("id"), r)), s="id", k="k", own="label", own_total="total")
        own = F.col("c") == F.col("own")
        choice = near.join(_hashed(mine), "s").withColumn("gain", m2 * F.col("into") - F.col("k") * (F.col("total") - F.when(own, F.col("k")).otherwise(0)))
        best = choice.groupBy("s", "k", "own", "own_total").agg(F.max(F.struct("gain", own.alias("own"), (-F.col("c")).alias("c"))).alias("best"), F.max(F.when(own, F.col("gain"))).alias("stay"))
        go = best.where(F.col("best.gain") > F.coalesce("stay", -F.col("k") * (F.col("own_total") - F.col("k"))))
        state = kept(state.select("id", "k", "label").join(_hashed(go.select(F.col("s").alias("id"), (-F.col("best.c")).alias("to"))), "id", "left").select("id", "k", F.coalesce("to", "label").alias("label"), F.col("to").isNotNull().alias("moved")))
        over = turns.end(state.where("moved").count())
    return state.select("id", "k", "label")


def _refined(both: DataFrame, state: DataFrame, m2: int) -> DataFrame:
    """:func:`_refine` by joins: (id, k, label, part)."""
    inner = both.join(_hashed(_renamed(state, s="id", ls="label")), "s").join(_hashed(_renamed(state, t="id", lt="label")), "t").where(F.col("ls") == F.col("lt"))
    inner = kept(inner.select("s", "t", "w"))
    found, r, still = state.withColumn("part", F.col("id")), 0, 0
    while still < STILL:
        sizes = found.groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.sum("k").alias("total"))
        rows = found.select("id", "k", "part").join(_hashed(sizes), "part").withColumn("up", _awake(F.col("id"), r) & (F.col("size") == 1))
        near = inner.where(_awake(F.col("s"), r)).join(_hashed(_renamed(rows.where(~F.col("up")), t="id", c="part", total="total")), "t")
        near = near.groupBy("s", "c", "total").agg(F.sum("w").alias("into")).join(_hashed(_renamed(rows.where("up"), s="id", k="k")), "s")
        near = near.withColumn("gain", m2 * F.col("into") - F.col("k") * F.col("total")).where(F.col("gain") > 0)
        best = near.groupBy("s").agg(F.max(F.struct("gain", (-F.col("c")).alias("c"))).alias("best")).select(F.col("s").alias("id"), (-F.col("best.c")).alias("to"))
        found = kept(found.select("id", "k", "label", "part").join(_hashed(best), "id", "left").select("id", "k", "label", F.coalesce("to", "part").alias("part"), F.col("to").isNotNull().alias("joined")))
        still, r = 0 if found.where("joined").limit(1).count() else still + 1, r + 1
    return found.select("id", "k", "label", "part")


def _parts(both: DataFrame, state: DataFrame) -> DataFrame:
    """:func:`_connected` by joins: (id, community)."""
    inner = both.join(_renamed(state, s="id", ls="label"), "s").join(_renamed(state, t="id", lt="label"), "t").where(F.col("ls") == F.col("lt"))
    inner = kept(inner.select("s", "t"))
    low = kept(state.select("id", F.col("id").alias("part")))
    while True:
        near = inner.join(_renamed(low, t="id", part="part"), "t").groupBy(F.col("s").alias("id")).agg(F.min("part").alias("near"))
        step = kept(low.join(near, "id", "left").select("id", F.col("part").alias("was"), F.least("part", "near").alias("part")))
        low = kept(step.join(_renamed(step, part="id", up="part"), "part", "left").select("id", "was", F.least("part", "up").alias("part")))
        if not low.where(F.col("was") != F.col("part")).limit(1).count():
            return _renamed(low, id="id", community="part")
        low = low.drop("was")


def _by_joins(links: DataFrame, kernel_edges: int) -> DataFrame:
    """:func:`_cluster` of one repository's edges by joins, up to the level that one task can take over: (id, community)."""
    owner = None
    while True:
        if owner is not None and links.count() <= kernel_edges:
            found = links.withColumn("repo_name", F.lit("")).groupBy("repo_name").applyInPandas(_cluster, _FOUND).select("id", "community")
            break
        ends = F.array(F.struct(F.col("a").alias("id"), F.col("la").alias("label"), "w"), F.struct(F.col("b").alias("id"), F.col("lb").alias("label"), "w"))
        nodes = kept(links.select(F.inline(ends)).groupBy("id", "label").agg(F.sum("w").alias("k")).select("id", "k", "label"))
        m2 = nodes.agg(F.sum("k")).first()[0]
        ways = F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("t"), "w"), F.struct(F.col("b").alias("s"), F.col("a").alias("t"), "w"))
        both = kept(links.where(F.col("a") != F.col("b")).select(F.inline(ways)))
        state = _moved(both, nodes, m2)
        parts = _refined(both, state, m2)
        if not parts.where(F.col("part") != F.col("id")).limit(1).count():
            found = _parts(both, state)
            break
        place = parts.select("id", "part")
        owner = kept(place if owner is None else _renamed(owner, node="id", id="part").join(place, "id").select(F.col("node").alias("id"), "part"))
        of = lambda c: _hashed(_renamed(parts, **{c: "id", f"p{c}": "part", f"c{c}": "label"}))
        met = links.select("a", "b", "w").join(of("a"), "a").join(of("b"), "b")
        one, two = F.struct(F.col("pa").alias("p"), F.col("ca").alias("c")), F.struct(F.col("pb").alias("p"), F.col("cb").alias("c"))
        met = met.select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y"), "w").select(F.col("x.p").alias("a"), F.col("y.p").alias("b"), F.col("x.c").alias("la"), F.col("y.c").alias("lb"), "w")
        links = kept(met.groupBy("a", "b", "la", "lb").agg(F.sum("w").alias("w")))
    return found if owner is None else _renamed(owner, node="id", id="part").join(found, "id").select(F.col("node").alias("id"), "community")


def detect(g: Graph, kernel_edges: int = KERNEL_EDGES, edges: DataFrame | None = None) -> DataFrame:
    """repo_name, entity_id, leiden_community of each function; a repository's communities are numbered by their least member.

    ``edges``: the projection, if it is at hand.  ``kernel_edges`` says where the work is
    done and changes nothing of the result.
    """
    edges = cut(projection(g)) if edges is None else edges
    names = edges.select("repo_name", F.explode(F.array("s", "t")).alias("node")).where(F.col("node").isNotNull()).distinct()
    nodes = kept(running_number(names, "repo_name", "node").select("repo_name", "node", F.col("ordinal").alias("id")))
    of = lambda c, new: _hashed(_renamed(nodes, repo_name="repo_name", **{c: "node", new: "id"}))
    met = edges.where(F.col("t").isNotNull()).select("repo_name", "s", "t").join(of("s", "x"), ["repo_name", "s"]).join(of("t", "y"), ["repo_name", "t"])
    links = kept(met.groupBy("repo_name", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("w"))).withColumns({"la": F.col("a"), "lb": F.col("b")})
    big = [r["repo_name"] for r in links.groupBy("repo_name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > kernel_edges).select("repo_name").toLocalIterator()]
    found = links.where(~F.col("repo_name").isin(*big)).groupBy("repo_name").applyInPandas(_cluster, _FOUND)
    for repo in big:
        large = _by_joins(links.where(F.col("repo_name") == repo).drop("repo_name"), kernel_edges)
        found = found.unionByName(large.withColumn("repo_name", F.lit(repo)))
    # Nodes without edges are alone.
    found = kept(nodes.join(found, ["repo_name", "id"], "left").withColumn("community", F.coalesce("community", "id")))
    least = found.groupBy("repo_name", "community").agg(F.min("id").alias("least"))
    numbers = running_number(least, "repo_name", "least").select("repo_name", "community", F.col("ordinal").alias("leiden_community"))
    prefix = f"{FUNCTION}:"
    mine = found.where(F.startswith("node", F.lit(prefix))).join(numbers, ["repo_name", "community"])
    return mine.select("repo_name", F.substring("node", len(prefix) + 1, 1 << 30).alias("entity_id"), "leiden_community")


def write_back(functions: DataFrame, found: DataFrame) -> DataFrame:
    return functions.drop("leiden_community").join(found, ["repo_name", "entity_id"], "left")


def report(functions: DataFrame, edges: DataFrame, repositories: DataFrame | None = None) -> DataFrame:
    """Per repository: communities, functions, singletons and their share (0 without functions), projected nodes and edges, whether to warn.

    Of ``repositories`` (repo_name), those without functions or edges have zeros.
    """
    sizes = functions.where(F.col("leiden_community").isNotNull()).groupBy("repo_name", "leiden_community").agg(F.count(F.lit(1)).alias("n"))
    rows = sizes.groupBy("repo_name").agg(F.count(F.lit(1)).alias("community_count"), F.sum("n").alias("function_count"), F.count_if(F.col("n") == 1).alias("singleton_count"))
    nodes = edges.select("repo_name", F.explode(F.array("s", "t")).alias("node")).where(F.col("node").isNotNull()).groupBy("repo_name").agg(F.count_distinct("node").alias("projected_nodes"))
    links = edges.groupBy("repo_name").agg((2 * F.count("t")).alias("projected_relationships"))
    share = F.when(F.col("community_count") > 0, F.col("singleton_count") / F.col("community_count")).otherwise(0.0)
    if repositories is not None:
        rows = repositories.select("repo_name").distinct().join(rows, "repo_name", "left")
    rows = rows.join(nodes, "repo_name", "left").join(links, "repo_name", "left")
    rows = rows.select("repo_name", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in rows.columns if c != "repo_name")).withColumn("singleton_ratio", share)
    return rows.withColumn("warning", F.col("singleton_ratio") > SINGLETON_WARNING)


def sample_labeler(batch: list[dict]) -> list[dict]:
    """Labels communities without a model: by the folder most of their files share and their first names."""
    out = []
    for row in batch:
        folders = [p.rsplit("/", 1)[0] if "/" in p else p for p in row["file_paths"]]
        top = max(sorted(set(folders)), key=folders.count) if folders else "code"
        out.append({"id": row["comm_id"], "name": top, "description": f"{row['function_count']} functions such as {', '.join(row['func_names'][:3])}."})
    return out


def label(functions: DataFrame, labeler=sample_labeler, smallest: int = MIN_LABELED_COMMUNITY, batch: int = 8) -> tuple[DataFrame, DataFrame]:
    """Functions with small communities pooled, and the rows of ``communities``.

    ``labeler`` maps up to ``batch`` communities to labels with their id; one that leaves
    any out, or names another, fails the whole.
    """
    large = community_samples(functions).where(F.col("function_count") >= smallest)

    def run(pdfs):
        for pdf in pdfs:
            for at in range(0, len(pdf), batch):
                rows = pdf.iloc[at : at + batch].to_dict("records")
                got = labeler([{**r, "func_names": list(r["func_names"]), "file_paths": list(r["file_paths"])} for r in rows])
                by_id = {int(x["id"]): x for x in got}
                if len(got) != len(rows) or set(by_id) != {int(r["comm_id"]) for r in rows}:
                    raise ValueError("the labels do not match the communities asked for")
                named = [by_id[int(r["comm_id"])] for r in rows]
                yield pd.DataFrame({"repo_name": [r["repo_name"] for r in rows], "community_id": [r["comm_id"] for r in rows], "name": [x["name"].strip() for x in named], "description": [x["description"].strip() for x in named]})

    # Ids are unique in a repository only: a request holds one repository's.
    labelled = large.repartition("repo_name").sortWithinPartitions("repo_name", "comm_id").groupBy("repo_name").applyInPandas(lambda pdf: pd.concat([*run([pdf])]), "repo_name string, community_id bigint, name string, description string")
    moved = pooled(functions, smallest)
    rest = moved.where(F.col("leiden_community") == UNGROUPED_ID).select("repo_name").distinct()
    pool = rest.select("repo_name", F.lit(UNGROUPED_ID).cast("bigint").alias("community_id"), F.lit(UNGROUPED_NAME).alias("name"), F.lit(UNGROUPED_DESCRIPTION).alias("description"))
    return moved, labelled.unionByName(pool)


def fallback_labels(functions: DataFrame) -> DataFrame:
    """A community row per community, named by its number."""
    rows = functions.where(F.col("leiden_community").isNotNull()).select("repo_name", F.col("leiden_community").alias("community_id")).distinct()
    return rows.withColumn("name", fallback_name(F.col("community_id"))).withColumn("description", F.lit(""))


__all__ = ["EXTERNAL", "detect", "fallback_labels", "label", "leiden", "modularity", "projection", "report", "sample_labeler", "write_back"]
