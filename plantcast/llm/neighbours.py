"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

The graph starts from the best neighbours inside small leaves of random hyperplane splits. Each round then joins every node
with its neighbours and with the nodes it is a neighbour of: the members of such a list are compared with each other, since a
neighbour of a neighbour is likely to be a neighbour, and only pairs better than a member's worst neighbour leave the task.
A search keeps the best nodes found per query, and in each round joins those not yet expanded with the graph.

A list carries its members' vectors in eight bits per number, so what a round moves grows with the number of edges; the
search scores in 32 bits and the result in double precision. Lists are dealt to groups of a bounded number of centres. Lists of
nodes that very many others point to are cut into parts, which loses no pair with the node's own neighbours.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantcast.llm.lattice import unit_rows, usable
from plantcast.llm.shared import group_count, salted_lookup, stored

NEIGHBOURS = 30
LEAF = 256
SPLITS = 4
ROUNDS = 6
# A round that changes a smaller share of the graph is the last.
SETTLED = 0.01
POINTED_AT = 48
CENTRES_BY_DIM = 1 << 16
BEAM = 96
ENTRIES = 8
MAX_HOPS = 40
PAIRS_PER_GROUP = 1 << 18
SEED = 5
# Groups that the rows of one vector are dealt to, step by step, when the smallest keys are sought.
FIRST_SALTS = (64, 8, 1)
_EDGE = "u long, v long, s float, fresh boolean"


def best(pdf: pd.DataFrame, owner: str, other: str, keep: int) -> pd.DataFrame:
    """The ``keep`` best rows by ``s`` of each owner, one per pair (the first given), ties to the smaller other."""
    pdf = pdf.drop_duplicates([owner, other])
    pdf = pdf.iloc[np.lexsort((pdf[other].to_numpy(), -pdf["s"].to_numpy(), pdf[owner].to_numpy()))]
    start = np.flatnonzero(np.r_[True, pdf[owner].to_numpy()[1:] != pdf[owner].to_numpy()[:-1]]) if len(pdf) else np.array([], int)
    place = np.arange(len(pdf)) - np.repeat(start, np.diff(np.r_[start, len(pdf)]))
    return pdf[place < keep]


def _vectors(blobs, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float32).reshape(-1, dim)


def shortened(unit: np.ndarray) -> list[bytes]:
    """Each row as its largest number (32-bit) and its numbers in 8 bits relative to it."""
    top = np.abs(unit).max(axis=1, initial=0).astype(np.float32)
    whole = np.rint(unit / top[:, None] * 127).astype(np.int8)
    return [t.tobytes() + r.tobytes() for t, r in zip(top, whole)]


def lengthened(blobs, dim: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, dim + 4)
    top = raw[:, :4].copy().view(np.float32)
    return raw[:, 4:].view(np.int8).astype(np.float32) * (top / 127)


def distinct_vectors(rows: DataFrame, asked: Column, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Written tables of the usable rows (``row``, ``key``, ``asked``, ``vector``, ``mark``) and of their distinct vectors
    (``node``, ``mark``, ``dim``, ``vector``)."""
    vec = F.col(vector)
    mark = F.struct(F.xxhash64(vec).alias("a"), F.xxhash64(vec, F.lit(1)).alias("b")).alias("mark")
    row = F.monotonically_increasing_id().alias("row")
    members = stored(rows.where(usable(vec)).select(row, F.col(key).alias("key"), asked.alias("asked"), vec.alias("vector"), mark), "vectors")
    distinct = members.groupBy("mark", "vector").agg(F.count(F.lit(1)).alias("n"))
    return members, stored(distinct.select(F.monotonically_increasing_id().alias("node"), "mark", F.size("vector").alias("dim"), "vector"), "distinct")


def first_rows(members: DataFrame, keep: int) -> DataFrame:
    """``mark``, ``first``: the ``keep`` rows of smallest key of each vector (``key``, ``row``), cut in steps so that no task
    meets all rows of a vector."""
    slim = members.select("mark", "key", "row")
    for salts in FIRST_SALTS:
        order = Window.partitionBy("mark", F.pmod(F.xxhash64("row"), F.lit(salts))).orderBy(F.col("key").asc_nulls_last(), "row")
        slim = slim.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= keep).drop("_place")
    return slim.groupBy("mark").agg(F.collect_list(F.struct("key", "row")).alias("first"))


def index_nodes(distinct: DataFrame, dim: int) -> DataFrame:
    """Written table ``node``, ``mark``, ``unit`` (32-bit), ``small`` (8-bit) of the distinct vectors of length ``dim``."""

    @F.pandas_udf("unit binary, small binary")
    def forms(vectors: pd.Series) -> pd.DataFrame:
        x = unit_rows(vectors).astype(np.float32) if len(vectors) else np.zeros((0, dim), np.float32)
        return pd.DataFrame({"unit": [r.tobytes() for r in x], "small": shortened(x)}, dtype=object)

    return stored(distinct.where(F.col("dim") == dim).withColumn("_f", forms("vector")).select("node", "mark", "_f.unit", "_f.small"), "nodes")


def _leaf_graph(nodes: DataFrame, dim: int, count: int, keep: int) -> DataFrame:
    """Best neighbours inside leaves of ``SPLITS`` random splits."""
    bits = max(0, (count // LEAF).bit_length() - 1)
    planes = np.random.default_rng([SEED, dim]).normal(size=(SPLITS, dim, bits)).astype(np.float32)

    @F.pandas_udf("array<long>")
    def leaves(units: pd.Series) -> pd.Series:
        x = _vectors(units, dim)
        codes = [((x @ planes[t] > 0) @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int64) for t in range(SPLITS)]
        return pd.Series(list(np.column_stack(codes)), dtype=object) if len(x) else pd.Series([], dtype=object)

    coded = nodes.select("node", F.posexplode(leaves("unit")).alias("split", "leaf"))
    coded = stored(coded, "leaves")
    sizes = coded.groupBy("split", "leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * LEAF)
    large = stored(sizes.select("split", "leaf", F.ceil(F.col("n") / F.lit(LEAF)).cast("int").alias("parts")), "large-leaves")
    part = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int")
    placed = coded.join(large, ["split", "leaf"], "left").select("node", "split", "leaf", part.alias("part"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for at in pdf.groupby(["split", "leaf", "part"], sort=False).indices.values():
            ids, x = pdf["node"].to_numpy()[at], _vectors(pdf["unit"].iloc[at], dim)
            s = x @ x.T
            np.fill_diagonal(s, -np.inf)
            k = min(keep, len(at) - 1)
            if k > 0:
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                out.append(pd.DataFrame({"u": np.repeat(ids, k), "v": ids[top].ravel(), "s": np.take_along_axis(s, top, 1).ravel()}))
        found = pd.concat(out) if out else pd.DataFrame({"u": [], "v": [], "s": []})
        return best(found, "u", "v", keep).assign(fresh=True)

    group = F.pmod(F.xxhash64("split", "leaf", "part"), F.lit(group_count(count * SPLITS, 8192))).alias("g")
    return placed.join(nodes.select("node", "unit"), "node").groupBy(group).applyInPandas(compare, _EDGE)


def _merge(edges: DataFrame, groups: int, keep: int) -> DataFrame:
    """The best ``keep`` edges of each node; an edge that was there already stays as it was."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return best(pdf.sort_values("fresh", kind="stable"), "u", "v", keep)

    return edges.groupBy(F.pmod(F.xxhash64("u"), F.lit(groups)).alias("g")).applyInPandas(merge, _EDGE)


def _local_join(dim: int, keep: int):
    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["c", "part", "m", "fresh"], kind="stable").drop_duplicates(["c", "part", "m"], keep="last")
        x, ids, bound, fresh = lengthened(rows["small"], dim), rows["m"].to_numpy(), rows["bound"].to_numpy(), rows["fresh"].to_numpy()
        c, part = rows["c"].to_numpy(), rows["part"].to_numpy()
        start = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (part[1:] != part[:-1])])
        size = np.diff(np.r_[start, len(rows)])
        by_size = np.argsort(size, kind="stable")
        out = []
        for at in range(0, len(start), 256):
            some = by_size[at : at + 256]
            width = size[some].max()
            slots = np.minimum(np.arange(width)[None, :], size[some][:, None] - 1) + start[some][:, None]
            used = np.arange(width)[None, :] < size[some][:, None]
            f, v = fresh[slots] & used, x[slots]
            s = v @ v.transpose(0, 2, 1)
            good = (s > bound[slots][:, :, None]) & (f[:, :, None] | f[:, None, :]) & used[:, :, None] & used[:, None, :]
            good &= ~np.eye(width, dtype=bool)
            i, j, k = np.nonzero(good)
            out.append((ids[slots[i, j]], ids[slots[i, k]], s[i, j, k]))
        u, v, s = (np.concatenate(part) for part in zip(*out))
        return best(pd.DataFrame({"u": u, "v": v, "s": s}), "u", "v", keep).assign(fresh=True)

    return pairs


def _proposals(graph: DataFrame, nodes: DataFrame, dim: int, count: int, keep: int) -> DataFrame:
    """Pairs of members of the same list that are better than the worst neighbour of one of them."""
    pointed = graph.groupBy(F.col("v").alias("c")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > POINTED_AT)
    hubs = stored(pointed.select("c", F.ceil(F.col("n") / F.lit(POINTED_AT)).cast("int").alias("parts")), "hubs")
    parts = F.coalesce("parts", F.lit(1))
    ahead = graph.select(F.col("u").alias("c"), F.col("v").alias("m"), "fresh").join(hubs, "c", "left")
    ahead = ahead.select("c", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "m", "fresh")
    back = graph.select(F.col("v").alias("c"), F.col("u").alias("m"), "fresh").join(hubs, "c", "left")
    back = back.select("c", F.pmod(F.xxhash64("m"), parts).cast("int").alias("part"), "m", "fresh")
    full = graph.groupBy(F.col("u").alias("node")).agg(F.min("s").alias("low"), F.count(F.lit(1)).alias("n"))
    bounds = full.select(F.col("node").alias("_n"), F.when(F.col("n") >= keep, F.col("low")).otherwise(F.lit(-2.0)).cast("float").alias("bound"))
    members = nodes.select("node", "small").join(bounds, F.col("node") == F.col("_n"), "left")
    members = stored(members.select("node", "small", F.coalesce("bound", F.lit(-2.0).cast("float")).alias("bound")), "members")
    lists = ahead.union(back).join(members, F.col("m") == F.col("node")).drop("node")
    group = F.pmod(F.xxhash64("c", "part"), F.lit(group_count(count, max(64, CENTRES_BY_DIM // dim)))).alias("g")
    return lists.groupBy(group).applyInPandas(_local_join(dim, keep), _EDGE)


def build_graph(nodes: DataFrame, dim: int, keep: int = NEIGHBOURS, rounds: int = ROUNDS) -> DataFrame:
    """Written graph ``u``, ``v``, ``s`` (cosine), ``fresh``: up to ``keep`` near neighbours of each node."""
    count = nodes.count()
    groups = group_count(count, 8192)
    graph = stored(_merge(_leaf_graph(nodes, dim, count, keep), groups, keep), "graph")
    for _ in range(rounds if count > LEAF else 0):
        known = graph.withColumn("fresh", F.lit(False))
        graph = stored(_merge(known.union(_proposals(graph, nodes, dim, count, keep)), groups, keep), "graph")
        if graph.where("fresh").count() <= SETTLED * keep * count:
            break
    return graph


def _score(dim: int, keep: int):
    def score(pairs: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        x = _vectors(vectors["unit"], dim)
        query = vectors["query"].to_numpy()
        places = []
        for column, chosen in (("q", query), ("v", ~query)):
            at = np.flatnonzero(chosen)
            ids = vectors["node"].to_numpy()[at]
            order = np.argsort(ids)
            places.append(at[order[np.searchsorted(ids[order], pairs[column].to_numpy())]])
        s = np.empty(len(pairs), np.float32)
        for at in range(0, len(s), 1 << 15):
            i, j = places[0][at : at + (1 << 15)], places[1][at : at + (1 << 15)]
            s[at : at + (1 << 15)] = np.einsum("ij,ij->i", x[i], x[j])
        better = s > vectors["bound"].to_numpy()[places[0]]
        found = pd.DataFrame({"q": pairs["q"].to_numpy()[better], "v": pairs["v"].to_numpy()[better], "s": s[better]})
        return best(found, "q", "v", keep).assign(done=False)

    return score


def search_graph(nodes: DataFrame, dim: int, graph: DataFrame, queries: DataFrame, beam: int = BEAM) -> DataFrame:
    """``q``, ``v``, ``s``: the best nodes found for each query, at most ``beam``, never the query's own node.

    ``queries`` is a written table ``q`` (the query's node if it is in the index, else any other number), ``unit``. Searches
    start at the neighbours of the query's own node and at ``ENTRIES`` fixed nodes.
    """
    state_schema = "q long, v long, s float, done boolean"
    count, asked = nodes.count(), queries.count()
    entries = [r["node"] for r in nodes.orderBy(F.xxhash64("node"), "node").select("node").limit(ENTRIES).collect()]
    ways = graph.select("u", "v").union(graph.select("v", "u")).distinct()
    ways = stored(ways.select(F.col("u").alias("at"), F.col("v").alias("to")), "ways")
    start = queries.select("q", F.explode(F.lit(entries)).alias("v")) if entries else queries.select("q", F.lit(None).cast("long").alias("v"))
    pairs = start.union(queries.join(ways, F.col("q") == F.col("at")).select("q", F.col("to").alias("v")))
    state = None
    for _ in range(MAX_HOPS):
        pairs = pairs.where((F.col("q") != F.col("v")) & F.col("v").isNotNull()).distinct()
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            break
        groups = group_count(max(pairs.count(), asked), PAIRS_PER_GROUP)
        dealt = pairs.withColumn("g", F.pmod(F.xxhash64("v"), F.lit(groups)))
        bounds = queries.select("q", "unit").withColumn("bound", F.lit(-2.0).cast("float"))
        if state is not None:
            worst = state.groupBy(F.col("q").alias("_q")).agg(F.min("s").alias("low"), F.count(F.lit(1)).alias("n"))
            limit = F.when(F.col("n") >= beam, F.col("low")).otherwise(F.lit(-2.0)).cast("float")
            bounds = queries.join(worst, F.col("q") == F.col("_q"), "left").select("q", "unit", F.coalesce(limit, F.lit(-2.0).cast("float")).alias("bound"))
        asking = dealt.select(F.col("g").alias("h"), "q").distinct().join(bounds, "q").select("h", F.col("q").alias("node"), "unit", "bound", F.lit(True).alias("query"))
        met = dealt.select(F.col("g").alias("h"), F.col("v").alias("node")).distinct().join(nodes.select("node", "unit"), "node")
        met = met.select("h", "node", "unit", F.lit(0.0).cast("float").alias("bound"), F.lit(False).alias("query"))
        found = dealt.groupBy("g").cogroup(asking.union(met).groupBy("h")).applyInPandas(_score(dim, beam), state_schema)
        known = found if state is None else state.withColumn("done", F.lit(True)).union(found)

        def keep_best(pdf: pd.DataFrame) -> pd.DataFrame:
            return best(pdf.sort_values("done", ascending=False, kind="stable"), "q", "v", beam)

        by_query = F.pmod(F.xxhash64("q"), F.lit(group_count(asked, 1024))).alias("g")
        state = stored(known.groupBy(by_query).applyInPandas(keep_best, state_schema), "beam")
        pairs = state.where(~F.col("done")).join(ways, F.col("v") == F.col("at")).select("q", F.col("to").alias("v"))
    return state.select("q", "v", "s") if state is not None else queries.sparkSession.createDataFrame([], "q long, v long, s float")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(rows: DataFrame, asked: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` nearest rows found for each row for which ``asked`` (an expression
    over ``key``) holds.

    Rows with equal keys or vectors are separate candidates; only the query's own row is none. Vectors that are null, zero
    or hold null or non-finite numbers take no part; candidates are the vectors of the query's own length. Equal scores
    rank by key. An empty table gives no rows.

    Equal vectors are one node of the graph. Its ``k + 1`` rows of smallest key stand for it, since a query may be one of them.
    """
    members, distinct = distinct_vectors(rows, asked, key, vector)
    asking = members.where("asked").select("row", "key", "mark")
    wanted = asking.select("mark").distinct()
    # Vectors of different lengths have no cosine, so each length that is asked for has a graph of its own.
    lengths = [r["dim"] for r in distinct.join(wanted, "mark").select("dim").distinct().orderBy("dim").collect()]
    empty = rows.sparkSession.createDataFrame([], "q long, v long, s float"), rows.sparkSession.createDataFrame([], "q long")
    found, queries = empty
    for dim in lengths:
        nodes = index_nodes(distinct, dim)
        of_length = stored(nodes.join(wanted, "mark").select(F.col("node").alias("q"), "unit"), "queries")
        found = found.union(search_graph(nodes, dim, build_graph(nodes, dim), of_length))
        queries = queries.union(of_length.select("q"))
    # Scores of the search are in single precision, so more are measured again than are returned.
    near = Window.partitionBy("q").orderBy(F.desc("s"), "v")
    short = found.withColumn("_place", F.row_number().over(near)).where(F.col("_place") <= 4 * k).select("q", "v")
    short = short.union(queries.select("q", F.col("q").alias("v")))
    firsts = distinct.join(first_rows(members, k + 1), "mark")
    left = distinct.select(F.col("node").alias("q"), "mark", F.col("vector").alias("_a"))
    right = firsts.select(F.col("node").alias("v"), F.col("vector").alias("_b"), "first")
    scored = short.join(left, "q").join(right, "v").select("q", "mark", cosine(F.col("_a"), F.col("_b")).alias("score"), F.explode("first").alias("_r"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("_r.key").asc_nulls_last(), "_r.row")
    ranked = scored.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k + 1)
    lists = ranked.groupBy("mark").agg(F.sort_array(F.collect_list(F.struct("_place", "_r", "score"))).alias("_list"))
    answered = salted_lookup(asking, lists, "mark", F.col("row"))
    others = F.slice(F.filter("_list", lambda x: x["_r"]["row"] != F.col("row")), 1, k)
    answers = answered.select(F.col("key").alias("query_id"), F.posexplode(others).alias("_at", "_x"))
    return answers.select("query_id", (F.col("_at") + 1).alias("rank"), F.col("_x._r.key").alias("vec_id"), F.col("_x.score").alias("score"))
