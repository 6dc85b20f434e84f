"""Graph operators on keyed edge tables: components and shortest paths."""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.operators.storage import bucketed, stored, with_mesh

#: Vertices in a block of the shortest-path search at most; a task holds one block.
BLOCK = 500_000
#: Rounds whose improvements are kept apart.
COMPACT = 8
#: Blocks to be settled in a round that are named to the reader, so that it leaves out files of others.
NAMED = 1000
#: Edges that a task of the components holds at once, ids in a span of the first pass, and by how much spans widen.
CHUNK, SPAN, WIDER = 1_000_000, 1 << 17, 64


def _least_in_chunk(mesh: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mesh, node, root) of the nodes of some edges: the least node that each reaches by these; each is its place in order until edges agree."""
    meshes, nodes = np.concatenate([mesh, mesh]), np.concatenate([u, v])
    order = np.lexsort((nodes, meshes))
    meshes, nodes = meshes[order], nodes[order]
    new = np.concatenate([[True], (nodes[1:] != nodes[:-1]) | (meshes[1:] != meshes[:-1])])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    meshes, nodes = meshes[new], nodes[new]
    a, b, root = place[: len(u)], place[len(u) :], np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return meshes, nodes, nodes[root]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while ((up := root[root]) != root).any():
            root = up


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_least_in_chunk`` of each ``CHUNK`` of a task's edges (mesh_id, u, v)."""

    def roots(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        names = rows["mesh_id"].combine_chunks().dictionary_encode()
        mesh, node, root = _least_in_chunk(*(x.to_numpy(zero_copy_only=False) for x in (names.indices, rows["u"], rows["v"])))
        yield from pa.table({"mesh_id": names.dictionary.take(pa.array(mesh)), "node": node, "root": root}).to_batches(max_chunksize=100_000)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            yield from roots(held)
            held = []
    if any(b.num_rows for b in held):
        yield from roots(held)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(mesh_id, a, b) -> (mesh_id, node, component): the least node that each node with an edge reaches.

    Edges are dealt by spans of their lesser node, and each task gives the nodes of its edges the least one that they reach by these. Nodes that got several
    in several tasks link these: that graph, of mere least nodes, is solved in the same way with wider spans, and by ``_by_stars`` if it is not a half of the one before.
    """
    rows = edges.select("mesh_id", F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter("u > v")
    return _components(rows, SPAN, None)


def _components(rows: DataFrame, span: int, n: int | None) -> DataFrame:
    keys, dealt = ["mesh_id", "node"], F.expr(f"v div {span}")
    if n is None:
        rows = rows.repartition("mesh_id", dealt)
    else:
        rows = rows.coalesce(1) if n <= CHUNK else rows.repartition(-(-n // CHUNK), "mesh_id", dealt)
    found = stored(rows.mapInArrow(_contracted, "mesh_id string, node long, root long"))
    least = stored(found.groupBy(*keys).agg(F.min("root").alias("m"), F.max("root").alias("x")))
    # merged, so that no table passes the driver
    links = found.join(least.filter("x > m").hint("merge"), keys).filter("root > m").select("mesh_id", F.col("root").alias("u"), F.col("m").alias("v"))
    links = stored(links.distinct())
    left = links.count()
    if left == 0:
        return least.select("mesh_id", "node", F.col("m").alias("component"))
    rest = _by_stars(links) if n is not None and left > n / 2 else _components(links, span * WIDER, left)
    rest = rest.select("mesh_id", F.col("node").alias("m"), "component")
    return least.join(rest, ["mesh_id", "m"], "left").select("mesh_id", "node", F.coalesce("component", "m").alias("component"))


def _by_stars(rows: DataFrame) -> DataFrame:
    """Components of distinct edges (mesh_id, u > v) by large-star and small-star rounds; each is joins and aggregations on (mesh_id, node) and its table is stored."""
    last = None
    while True:
        state = rows.agg(F.count("*"), F.sum(F.xxhash64("mesh_id", "u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return rows.select("mesh_id", F.col("u").alias("node"), F.col("v").alias("component")).union(rows.select("mesh_id", "v", "v")).distinct()
        last = state
        both = rows.union(rows.select("mesh_id", "v", "u"))
        least = both.groupBy("mesh_id", "u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.join(least.hint("merge"), ["mesh_id", "u"]).filter("v > u").select("mesh_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large)
        least = large.groupBy("mesh_id", "u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), ["mesh_id", "u"]).select("mesh_id", F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        rows = stored(small.filter("u <> v").distinct())


def _settle(key, links: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """The vertices of a block whose distance is less than known, by a heap search from the candidates that are less."""
    mesh, block = key
    new = rows["new"].to_numpy(bool)
    vid, dist = rows["vid"].to_numpy(), rows["dist"].to_numpy()
    ids = np.unique(np.concatenate([vid, links["src"].to_numpy(), links["dst"].to_numpy()]))
    order = np.argsort(links["src"].to_numpy(), kind="stable")
    begins = np.searchsorted(links["src"].to_numpy()[order], ids, "left").tolist() + [len(order)]
    to = array("q", np.searchsorted(ids, links["dst"].to_numpy()[order]).astype(np.int64).tobytes())
    length = array("d", links["w"].to_numpy()[order].astype(float).tobytes())
    best = np.full(len(ids), np.inf)
    best[np.searchsorted(ids, vid[~new])] = dist[~new]
    known, heap = best.copy(), []
    best = array("d", best.tobytes())
    for v, d in zip(np.searchsorted(ids, vid[new]).tolist(), dist[new].tolist(), strict=True):
        if d < best[v]:
            best[v] = d
            heap.append((d, v))
    heapq.heapify(heap)
    while heap:
        d, v = heapq.heappop(heap)
        if d > best[v]:
            continue
        for k in range(begins[v], begins[v + 1]):
            t, far = to[k], d + length[k]
            if far < best[t]:
                best[t] = far
                heapq.heappush(heap, (far, t))
    best = np.array(best)
    less = best < known
    return pd.DataFrame({"mesh_id": pd.Series([mesh] * int(less.sum()), dtype=object), "vid": ids[less].astype("int64"), "dist": best[less], "block": np.full(int(less.sum()), block, "int64")})


def shortest_paths(edges: DataFrame, sources: DataFrame, block: int = BLOCK, predecessors: bool = True) -> DataFrame:
    """(mesh_id, src, dst, w), (mesh_id, vid) -> (mesh_id, vid, dist, pred): exact distances from the nearest source.

    Vertices fall into blocks of ``block`` consecutive ids. A round takes the blocks that candidates have reached, settles each
    by its own heap search, and keeps the vertices whose distance became less; only these go on along edges between blocks. The search ends
    when no distance became less: rounds are as many as a shortest path changes blocks. Unreachable vertices have no row. Weights
    are not negative. ``pred`` is the least id among equal predecessors, null at a source.
    """
    schema, keys = "mesh_id string, vid long, dist double, block long", ("mesh_id", "block")
    at = lambda c: F.expr(f"{c} div {block}")
    inner = bucketed(edges.filter(at("src") == at("dst")).select("mesh_id", at("src").alias("block"), "src", "dst", "w"), *keys)
    between = stored(edges.filter(at("src") != at("dst")).select("mesh_id", "src", "dst", "w"))
    found: list[DataFrame] = []
    fresh = stored(sources.select("mesh_id", "vid", F.lit(0.0).alias("dist"), at("vid").alias("block")).distinct())
    while True:
        active = stored(fresh.select(*keys).distinct())
        named = [x["block"] for x in active.select("block").distinct().limit(NAMED + 1).collect()]
        lie = F.col("block").isin(named) if len(named) <= NAMED else F.lit(True)
        rows = fresh.withColumn("new", F.lit(True))
        if found:
            known = with_mesh(_least(found), active, "left_semi", keys)
            rows = rows.unionByName(known.withColumn("new", F.lit(False)))
        links = with_mesh(inner.filter(lie), active, "left_semi", keys)
        less = stored(links.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(_settle, schema))
        if less.limit(1).count() == 0:
            break
        found.append(less)
        if len(found) > COMPACT:
            found = [stored(_least(found))]
        crossed = between.join(less.withColumnRenamed("vid", "src"), ["mesh_id", "src"]).groupBy("mesh_id", F.col("dst").alias("vid")).agg(F.min(F.col("dist") + F.col("w")).alias("dist"))
        fresh = stored(crossed.select("mesh_id", "vid", "dist", at("vid").alias("block")))
    dist = stored(_least(found).drop("block")) if found else fresh.drop("block")
    return dist.join(nearest_before(edges, dist), ["mesh_id", "vid"], "left") if predecessors else dist


def _least(found: list[DataFrame]) -> DataFrame:
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    return rows.groupBy("mesh_id", "vid", "block").agg(F.min("dist").alias("dist"))


def nearest_before(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """(mesh_id, vid, pred): the least id from which an edge of positive length leads to each vertex at its distance."""
    reach = edges.join(dist.select("mesh_id", F.col("vid").alias("src"), F.col("dist").alias("d")), ["mesh_id", "src"])
    into = reach.join(dist.withColumnRenamed("vid", "dst"), ["mesh_id", "dst"]).filter("d + w = dist AND w > 0")
    return into.groupBy("mesh_id", F.col("dst").alias("vid")).agg(F.min("src").alias("pred"))
