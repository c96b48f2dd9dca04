"""Embedding near-dedup by NN-descent.

1. Equal vectors are one node.  Random-hyperplane trees deal the nodes into small
   blocks; the best neighbours within blocks start the graph.
2. NN-descent: every node introduces its neighbours, and those it is a neighbour
   of, to each other; each keeps its best `k`.  Rounds go on until few lists
   change.
3. Edges over the threshold are kept and give components.  Lists that are full of
   such edges are saturated: they are enlarged to the whole component, whose
   members are compared block by block, so that links are counted, not listed.
   Their nodes first search again outside their component, until no list is
   full of links, so that no component ends where the lists did.
4. Recall is audited on a bounded sample against all vectors; when it is too low
   the graph is grown from new trees and refined again, and after three attempts
   every pair is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare
from .components import connected_components

EDGE = "u long, x long, s float"


def _matrix(col, dtype) -> np.ndarray:
    """Rows of packed vectors of one length."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.stack([np.frombuffer(v.as_buffer(), dtype) for v in col]) if len(col) else np.zeros((0, 0), dtype)


def _classes(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows: vec_id, rep) and (nodes: rep, many, dim, unit vector as bytes)."""
    wide = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    # A null or non-finite component makes the sum null, NaN or infinite.
    fine = F.col("v").isNotNull() & F.col("vec_id").isNotNull() & (norm2 > 0) & ~F.isnan(norm2) & (norm2 < float("inf"))
    # Huge or tiny components would overflow the sum: scale by the largest first.
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    wide = wide.withColumn("top", F.when(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)), top))
    wide = wide.withColumn("v", F.when((F.col("top") > 0) & (F.col("top") < float("inf")), F.transform("v", lambda x: x / F.col("top"))))
    wide = wide.select("vec_id", F.when(fine, F.col("v")).alias("v"))
    rows = cut(wide.withColumn("key", F.when(F.col("v").isNotNull(), F.md5(F.to_json("v")))))
    named = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many"), F.first("v").alias("v"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs = [np.array(v, dtype=np.float64) for v in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([len(v) for v in vs], pa.int32()), pa.array([(v / np.linalg.norm(v)).tobytes() for v in vs], pa.binary())], ["key", "rep", "many", "dim", "v"])

    nodes = cut(named.select("key", "rep", "many", "v").mapInArrow(unit, "key string, rep long, many long, dim int, v binary"))
    return rows.select("vec_id", "key").join(nodes.select("key", "rep"), "key", "left").select("vec_id", "rep"), nodes.drop("key")


def _trees(nodes: DataFrame, k: int, trees: int, leaf: int, seed: int) -> DataFrame:
    """Start edges: each node's best k in its block of every tree."""
    n = nodes.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim in set(b.column(1).to_pylist()):
                at = np.flatnonzero(b.column(1).to_numpy(zero_copy_only=False) == dim)
                v = b.column(2).take(pa.array(at))
                x = _matrix(v, np.float64)
                planes = np.random.Generator(np.random.PCG64([seed, dim])).standard_normal((trees * depth, dim))
                side = (x @ planes.T > 0).reshape(len(x), trees, depth)
                code = side @ (1 << np.arange(depth, dtype=np.int64)) if depth else np.zeros((len(x), trees), np.int64)
                small = pa.array([r.astype(np.float32).tobytes() for r in x], pa.binary())
                for t in range(trees):
                    yield pa.RecordBatch.from_arrays([pa.array([f"{dim}:{t}"] * len(x)), pa.array(code[:, t], pa.int64()), b.column(0).take(pa.array(at)), b.column(3).take(pa.array(at)), small], ["tree", "code", "u", "own", "v"])

    coded = nodes.select("rep", "dim", "v", "own").mapInArrow(codes, "tree string, code long, u long, own long, v binary")
    many = coded.groupBy("tree", "code").agg(F.count("*").alias("many"))
    # A crowded block is dealt out at random: its parts meet in other trees and in the descent.
    dealt = coded.join(many, ["tree", "code"]).withColumn("salt", F.pmod(F.xxhash64("u", "tree"), F.ceil(F.col("many") / (2 * leaf))))

    def best(t: pa.Table) -> pa.Table:
        x, ids = _matrix(t["v"], np.float32), t["u"].to_numpy()
        return _top(ids, t["own"].to_numpy(), x, k, np.full(len(ids), -2, np.float32))

    return dealt.groupBy("tree", "code", "salt").applyInArrow(best, EDGE)


def _top(ids: np.ndarray, own: np.ndarray, x: np.ndarray, k: int, least: np.ndarray) -> pa.Table:
    """Each row's best k of other owners that exceed its present k-th."""
    out_u, out_x, out_s = [], [], []
    for a in range(0, len(ids), 512):
        s = x[a : a + 512] @ x.T
        s[own[a : a + 512, None] == own[None, :]] = -3
        m = min(k, s.shape[1] - 1)
        if m < 1:
            break
        top = np.argpartition(-s, m - 1, axis=1)[:, :m]
        best = np.take_along_axis(s, top, axis=1)
        r, c = np.nonzero(best > least[a : a + 512, None])
        out_u.append(ids[a + r])
        out_x.append(ids[top[r, c]])
        out_s.append(best[r, c])
    if not out_u:
        out_u, out_x, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
    return pa.table({"u": np.concatenate(out_u), "x": np.concatenate(out_x), "s": np.concatenate(out_s).astype(np.float32)})


def _keep(edges: DataFrame, k: int) -> DataFrame:
    one = edges.where("u <> x").groupBy("u", "x").agg(F.max("s").alias("s"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "x"))
    return one.withColumn("r", rank).where(F.col("r") <= k)


def _descend(graph: DataFrame, nodes: DataFrame, k: int, part: int, known: DataFrame | None = None) -> DataFrame:
    """Edges found by introducing the neighbours of each node, and those by `known` edges, to each other."""
    worst = graph.groupBy("u").agg(F.when(F.count("*") >= k, F.min("s")).otherwise(F.lit(-2.0)).cast("float").alias("least"))
    ways = graph.select("u", "x") if known is None else graph.select("u", "x").unionByName(known.select("u", "x"))
    meets = ways.select(F.col("u").alias("w"), F.col("x").alias("m")).unionByName(ways.select(F.col("x").alias("w"), F.col("u").alias("m"))).distinct()
    hosts = nodes.select(F.col("rep").alias("w"), F.col("rep").alias("m"))
    meets = meets.unionByName(hosts)
    # A node that very many point to hosts several meetings.
    salted = meets.join(meets.groupBy("w").agg(F.count("*").alias("many")), "w")
    salted = salted.select("w", F.pmod(F.xxhash64("m", "w"), F.ceil(F.col("many") / part)).alias("salt"), "m")
    guests = nodes.select(F.col("rep").alias("m"), "own", "v").join(worst.withColumnRenamed("u", "m"), "m", "left").fillna({"least": -2.0})
    full = salted.join(guests, "m").select("w", "salt", "m", "own", "least", "v")

    def introduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if not len(t):
                return
            w, salt, m, own, least = (t[c].to_numpy() for c in ("w", "salt", "m", "own", "least"))
            x = _matrix(t["v"], np.float64).astype(np.float32)
            cuts = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (salt[1:] != salt[:-1])]))
            found = [_top(m[a:z], own[a:z], x[a:z], k, least[a:z].astype(np.float32)) for a, z in zip(cuts, np.append(cuts[1:], len(w)))]
            yield from pa.concat_tables(found).combine_chunks().to_batches()

        for b in batches:
            held.append(b)
            t = pa.Table.from_batches(held)
            w, salt = t["w"].to_numpy(), t["salt"].to_numpy()
            start = np.flatnonzero((w != w[-1]) | (salt != salt[-1]))
            upto = int(start[-1]) + 1 if len(start) else 0
            yield from solve(t.slice(0, upto))
            held = t.slice(upto).combine_chunks().to_batches()
        if held:
            yield from solve(pa.Table.from_batches(held))

    return full.repartition("w", "salt").sortWithinPartitions("w", "salt").mapInArrow(introduce, EDGE)


def _refine(start: DataFrame, nodes: DataFrame, k: int, rounds: int, settle: float, known: DataFrame | None = None) -> DataFrame:
    """The graph after descents from the start edges, until few lists change."""
    graph = cut(_keep(start, k))
    size = graph.count()
    for _ in range(rounds):
        grown = _descend(graph, nodes, k, 8 * k, known)
        before = graph.select("u", "x").withColumn("old", F.lit(1))
        graph = cut(_keep(graph.select("u", "x", "s").unionByName(grown), k).join(before, ["u", "x"], "left"))
        new = graph.where("old is null").count()
        graph = graph.drop("old")
        if new <= settle * size:
            break
    return graph


def _bridge(graph: DataFrame, nodes: DataFrame, threshold: float, k: int, trees: int, leaf: int, rounds: int, settle: float, seed: int) -> DataFrame:
    """(node, component) by the graph's links and those that full lists leave out.

    A list full of links may hide others, so its node searches again for the
    nearest nodes outside its component.  A link is hidden only where both its
    ends have full lists; components that were found linked are one in the
    next search, which goes on with the lists that are full of links again.
    """
    edges, last, near = cut(_sure(graph, nodes, threshold)), graph, graph.select("u", "x")
    while True:
        found = cut(connected_components(edges))
        full = last.where(F.col("s") >= threshold - 1e-4).groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("u").alias("rep"))
        mine = nodes.drop("own").join(full, "rep", "left_semi").join(found.select(F.col("node").alias("rep"), F.col("component").alias("own")), "rep", "left")
        nodes_left = cut(mine.withColumn("own", F.coalesce("own", "rep")))
        if nodes_left.select("own").distinct().limit(2).count() < 2:
            return found
        seed += 1000
        last = _refine(_trees(nodes_left, k, trees, leaf, seed), nodes_left, k, rounds, settle, near)
        new = cut(_sure(last, nodes, threshold))
        if new.isEmpty():
            return found
        edges, near = edges.unionByName(new), near.unionByName(last.select("u", "x"))


def _sure(edges: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(u, v) of the edges that reach the threshold in double precision."""
    near = edges.where(F.col("s") >= threshold - 1e-4).select("u", F.col("x").alias("v"), "s")
    # Single precision is off by far less than 1e-4: only edges that close are computed again.
    open_edges = near.where(F.col("s") < threshold + 1e-4).select("u", "v")
    ends = open_edges.join(nodes.select(F.col("rep").alias("u"), F.col("v").alias("a")), "u").join(nodes.select(F.col("rep").alias("v"), F.col("v").alias("b")), "v").select("u", "v", "a", "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [float(np.frombuffer(x.as_buffer(), np.float64) @ np.frombuffer(y.as_buffer(), np.float64)) >= threshold for x, y in zip(b.column(2), b.column(3))]
            yield b.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return near.where(F.col("s") >= threshold + 1e-4).select("u", "v").unionByName(ends.mapInArrow(verify, "u long, v long"))


def _block_pairs(members: DataFrame, block: int) -> DataFrame:
    """The members of each component, dealt into blocks, by pair of blocks (i, j)."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = members.join(sizes, "component").withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # Block b takes part in the pairs (b, other) and (other, b).
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return pairs.select("component", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), "b", "rep", "many", "v")


def _pair_forest(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """(u, v): edges that connect what is linked within each pair of blocks, one a node at most."""

    def forest(t: pa.Table) -> pa.Table:
        x, ids = _matrix(t["v"], np.float64), t["rep"].to_numpy()
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        left, out = near.any(axis=1), []
        while left.any():
            root = int(np.argmax(left))
            edge, reached = np.array([root]), np.zeros(len(x), bool)
            while len(edge):
                reached[edge] = True
                edge = np.flatnonzero(near[edge].any(axis=0) & ~reached)
            out += [(int(ids[root]), int(ids[m])) for m in np.flatnonzero(reached) if m != root]
            left &= ~reached
        return pa.table({"u": pa.array([a for a, _ in out], pa.int64()), "v": pa.array([b for _, b in out], pa.int64())})

    return _block_pairs(members, block).groupBy("component", "i", "j").applyInArrow(forest, "u long, v long")


def _count_links(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """(rep, links): linked copies within each component; members: component, rep, many, v.

    A component is dealt into blocks, and every pair of blocks is one task:
    only the counts leave it.
    """
    pairs = _block_pairs(members, block)

    def count(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        x, b, many = _matrix(t["v"], np.float64), t["b"].to_numpy(), t["many"].to_numpy().astype(np.float64)
        n = np.zeros(len(x))
        one, two = np.flatnonzero(b == i), np.flatnonzero(b == j)
        for a in range(0, len(one), 256):
            rows = one[a : a + 256]
            near = x[rows] @ x[two].T >= threshold
            if i == j:
                near[rows[:, None] == two[None, :]] = False
                n[rows] += near @ many[two]
            else:
                n[rows] += near @ many[two]
                n[two] += many[rows] @ near
        return pa.table({"rep": t["rep"], "n": pa.array(n.astype(np.int64))})

    return pairs.groupBy("component", "i", "j").applyInArrow(count, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("links"))


def _audit(nodes: DataFrame, links: DataFrame, threshold: float, sample: int) -> float:
    """Share of the sample's links (against all nodes) that were counted: of all, or in the mean over the nodes, whichever is less."""
    probes = nodes.orderBy(F.xxhash64("rep", F.lit(11))).limit(sample).join(links, "rep", "left").select("rep", "dim", "v", F.coalesce("links", F.lit(0)).alias("links")).collect()
    if not probes:
        return 1.0
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {p.dim for p in probes}:
        own = [p for p in probes if p.dim == dim]
        by_dim[dim] = np.array([p.rep for p in own]), np.stack([np.frombuffer(p.v, np.float64) for p in own])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for b in batches:
            dims, reps, many = (b.column(c).to_numpy(zero_copy_only=False) for c in (1, 0, 3))
            for dim, (ids, y) in by_dim.items():
                at = np.flatnonzero(dims == dim)
                if len(at):
                    near = _matrix(b.column(2).take(pa.array(at)), np.float64) @ y.T >= threshold
                    n = ((near & (reps[at][:, None] != ids[None, :])) * many[at][:, None]).sum(axis=0)
                    for i, m in zip(ids.tolist(), n.tolist()):
                        total[i] = total.get(i, 0) + int(m)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["rep", "n"])

    truth = {r.rep: r.n for r in nodes.select("rep", "dim", "v", "many").mapInArrow(exact, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n")).collect()}  # the sample
    shares = [p.links / truth[p.rep] for p in probes if truth.get(p.rep)]
    return min(sum(p.links for p in probes) / sum(truth.values()), sum(shares) / len(shares)) if shares else 1.0


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, k: int = 8, trees: int = 3, leaf: int = 256, rounds: int = 6, settle: float = 0.02, block: int = 512, audit_rows: int = 256, recall: float = 0.99) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Links are cosine >= threshold in double precision.  Defined cases: vectors
    that are null, zero, empty or hold null or non-finite components, and rows
    with a null id, link with nothing; vectors of different lengths do not
    link; rows with equal vectors link with each other; an empty table gives no
    row; other columns are not read.
    """
    prepare(vectors.sparkSession)
    rows, nodes = _classes(vectors, id_col, vector_col)
    nodes = nodes.withColumn("own", F.col("rep"))
    graph, links, found = None, None, None
    for attempt in range(3):
        start = _trees(nodes, k, trees, leaf, seed=attempt)
        graph = _refine(start if graph is None else start.unionByName(graph.select("u", "x", "s")), nodes, k, rounds, settle)
        found = _bridge(graph, nodes, threshold, k, trees, leaf, rounds, settle, attempt)
        members = found.withColumnRenamed("node", "rep").join(nodes, "rep")
        links = cut(_count_links(members, threshold, block))
        if _audit(nodes, links, threshold, audit_rows) >= recall:
            break
    else:
        # Still below the bound: every pair of one length is compared.
        everyone = nodes.select(F.col("dim").cast("long").alias("component"), "rep", "many", "v")
        found = cut(connected_components(_pair_forest(everyone, threshold, block)))
        links = cut(_count_links(everyone, threshold, block)).where("links > 0")
    per_node = nodes.select("rep", "many").join(links, "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    per_node = per_node.select("rep", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(per_node, "rep", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
