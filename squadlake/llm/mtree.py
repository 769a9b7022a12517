"""Exact top-k search by inner product with M-trees.

Within one tree all vectors get a coordinate that gives them the same norm M, and
queries get 0 there; then |q - v|^2 = |q|^2 + M^2 - 2 q.v, so the best inner
products are the nearest neighbours, and the distance obeys the triangle inequality.

Distinct vectors are dealt out to trees of bounded size.  A tree is a table of
pages: inner nodes over leaves over vectors, each page with its pivot, its
covering radius and its entries' distances from the pivot.  A search takes pages
best first by their lower bound.  An entry whose stored distance from its parent
already rules it out by the triangle inequality costs no distance computation.
Scores are exact integer inner products.

Queries meet trees in blocks: a task holds one tree and one block.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from squadlake.llm.shared import Scratch
from squadlake.llm.textblocks import column_of

TREE_VECTORS = 16_384
LEAF_ENTRIES = 64
NODE_LEAVES = 32
BLOCK_QUERIES = 512
PAGES = "tree int, node int, leaf int, pivot binary, radius double, distance double, vectors binary, distances binary, ids binary, counts binary"


def quantised(embeddings: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(vec_id, vector): floor(scale * x) of each component as little-endian int64.
    Rows without an id, null vectors and those with null or non-finite components are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for name, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name is None or not vector.is_valid or vector.values.null_count:
                    continue
                x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    ids.append(name)
                    rows.append(np.floor(scale * x).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], names=["vec_id", "vector"])

    return embeddings.select(F.col(id_column).cast("long"), vector_column).mapInArrow(run, "vec_id long, vector binary").distinct()


def _distances(points: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - pivot) ** 2).sum(axis=1))


def _grouped(points: np.ndarray, members: np.ndarray, size: int) -> list[np.ndarray]:
    """Split ``members`` into groups of at most ``size``: by the nearer of two far
    pivots, or by the distance from one of them where that would split few off."""
    done, todo = [], [members]
    while todo:
        group = todo.pop()
        if len(group) <= size:
            done.append(group)
            continue
        first = group[int(_distances(points[group], points[group[0]]).argmax())]
        d = _distances(points[group], points[first])
        nearer = d <= _distances(points[group], points[group[int(d.argmax())]])
        if not len(group) / 10 <= nearer.sum() <= len(group) * 0.9:
            nearer = np.zeros(len(group), dtype=bool)
            nearer[np.argsort(d, kind="stable")[:len(group) // 2]] = True
        todo += [group[nearer], group[~nearer]]
    return done


def _raised(vectors: np.ndarray, norm: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(norm ** 2 - (vectors ** 2).sum(axis=1), 0))
    return np.column_stack([vectors, rest])


def build_tree(tree: int, vectors: np.ndarray, ids: list[np.ndarray]) -> Iterator[dict]:
    """The pages of one tree: its leaves, each below an inner node (leaf -1)."""
    points = _raised(vectors.astype(np.float64), math.sqrt(float((vectors.astype(np.float64) ** 2).sum(axis=1).max())))
    groups = _grouped(points, np.arange(len(points)), LEAF_ENTRIES)
    pivots = np.array([points[g].mean(axis=0) for g in groups])
    for node, leaves in enumerate(_grouped(pivots, np.arange(len(groups)), NODE_LEAVES)):
        centre = pivots[leaves].mean(axis=0)
        radius = 0.0
        for leaf in leaves.tolist():
            g = groups[leaf]
            d = _distances(points[g], pivots[leaf])
            radius = max(radius, float(_distances(points[g], centre).max()))
            yield {"tree": tree, "node": node, "leaf": leaf, "pivot": pivots[leaf].tobytes(), "radius": float(d.max()),
                   "distance": float(_distances(pivots[leaf][None], centre)[0]), "vectors": vectors[g].astype("<i8").tobytes(), "distances": d.tobytes(),
                   "ids": np.concatenate([ids[i] for i in g]).astype("<i8").tobytes(), "counts": np.array([len(ids[i]) for i in g], "<i8").tobytes()}
        yield {"tree": tree, "node": node, "leaf": -1, "pivot": centre.tobytes(), "radius": radius, "distance": 0.0,
               "vectors": b"", "distances": b"", "ids": b"", "counts": b""}


class Tree:
    """A tree read from its pages, and the search in it."""

    def __init__(self, pages: list[dict]):
        inner = sorted((p for p in pages if p["leaf"] < 0), key=lambda p: p["node"])
        self.pivots = np.array([np.frombuffer(p["pivot"]) for p in inner])
        self.radii = np.array([p["radius"] for p in inner])
        self.dim = self.pivots.shape[1] - 1
        self.leaves = []
        for node in range(len(inner)):
            own = [p for p in pages if p["leaf"] >= 0 and p["node"] == node]
            self.leaves.append((np.array([np.frombuffer(p["pivot"]) for p in own]), np.array([p["radius"] for p in own]), np.array([p["distance"] for p in own]),
                                [(np.frombuffer(p["vectors"], "<i8").reshape(-1, self.dim), np.frombuffer(p["distances"]),
                                  np.frombuffer(p["ids"], "<i8"), np.concatenate([[0], np.cumsum(np.frombuffer(p["counts"], "<i8"))])) for p in own]))
        self.norm2 = max(float((e[0].astype(np.float64) ** 2).sum(axis=1).max()) for n in self.leaves for e in n[3])
        largest = max(int(np.abs(e[0]).max(initial=0)) for n in self.leaves for e in n[3])
        self.largest = largest
        self.computed = self.avoided = 0

    def search(self, query: np.ndarray, k: int, without: int | None = None) -> list[tuple[int, int]]:
        """The k rows (score, vec_id) with the highest scores, ties to smaller ids; rows
        of the id ``own`` take no part."""
        wide = self.dim * max(self.largest, 1) * max(int(np.abs(query).max(initial=0)), 1) >= 1 << 62
        exact = query.astype(object) if wide else query
        point = np.append(query.astype(np.float64), 0.0)
        size2 = float(point @ point)
        slack = 1e-9 * (size2 + self.norm2) + 1e-6
        best: list[tuple[int, int]] = []  # (score, -vec_id), the worst first

        def reach() -> float:
            """The distance beyond which nothing can enter the result."""
            if len(best) < k:
                return math.inf
            return math.sqrt(max(size2 + self.norm2 - 2 * float(best[0][0]), 0) + slack)

        d_inner = _distances(self.pivots, point)
        queue = [(max(d - r, 0.0), 0, i, -1, d) for i, (d, r) in enumerate(zip(d_inner.tolist(), self.radii.tolist()))]
        heapq.heapify(queue)
        while queue:
            bound, _, node, leaf, d = heapq.heappop(queue)
            limit = reach()
            if bound > limit:
                break
            pivots, radii, parents, entries = self.leaves[node]
            if leaf < 0:
                near = np.flatnonzero(np.abs(d - parents) - radii <= limit)
                self.avoided += len(parents) - len(near)
                self.computed += len(near)
                own = _distances(pivots[near], point)
                for i, x in zip(near.tolist(), own.tolist()):
                    low = max(x - float(radii[i]), 0.0)
                    if low <= limit:
                        heapq.heappush(queue, (low, 1, node, i, x))
                continue
            vectors, distances, ids, bounds = entries[leaf]
            fits = np.abs(d - distances) <= limit
            if without is not None:
                fits &= np.logical_or.reduceat(ids != without, bounds[:-1])
            near = np.flatnonzero(fits)
            self.avoided += len(distances) - len(near)
            self.computed += len(near)
            scores = vectors[near].astype(object) @ exact if wide else vectors[near] @ exact
            chosen = np.arange(len(near))
            if len(best) == k:
                chosen = np.flatnonzero(scores >= best[0][0])
            if len(chosen) > k:
                chosen = chosen[scores[chosen] >= np.sort(scores[chosen])[-k]]
            for i in chosen.tolist():
                score = int(scores[i])
                for vec_id in ids[bounds[near[i]]:bounds[near[i] + 1]].tolist():
                    if vec_id == without:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (score, -vec_id))
                    elif (score, -vec_id) > best[0]:
                        heapq.heapreplace(best, (score, -vec_id))
        return [(s, -i) for s, i in best]


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


_PAGE_SCHEMA = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("leaf", pa.int32()), ("pivot", pa.binary()), ("radius", pa.float64()), ("distance", pa.float64()),
                          ("vectors", pa.binary()), ("distances", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary()), ("dim", pa.int32())])


def build_trees(rows: DataFrame, k: int, scratch: Scratch, tree_vectors: int = TREE_VECTORS) -> tuple[DataFrame, int]:
    """The pages of all trees over ``rows`` (vec_id, vector), and the number of trees.

    Equal vectors are one entry with its k + 1 smallest ids: a result holds no
    more of them.  Vectors of another dimension form trees of their own.
    """
    first = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= k + 1)
    distinct = scratch.keep(few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "distinct")
    trees = max(1, math.ceil(distinct.count() / tree_vectors))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        tree, dim = key[0].as_py(), key[1].as_py()
        vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), "<i8").reshape(-1, dim)
        ids = [np.array(x, dtype=np.int64) for x in table.column("ids").to_pylist()]
        return _table([{**page, "dim": dim} for page in build_tree(tree, vectors, ids)], _PAGE_SCHEMA)

    dealt = distinct.where(F.octet_length("vector") > 0).select(
        "vector", "ids", F.pmod(F.xxhash64("vector"), F.lit(trees)).cast("int").alias("tree"), (F.octet_length("vector") / 8).cast("int").alias("dim"))
    return scratch.keep(dealt.groupBy("tree", "dim").applyInArrow(build, PAGES + ", dim int"), "pages"), trees


def search_trees(pages: DataFrame, trees: int, queries: DataFrame, n_queries: int, k: int, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(vector, own, vec_id, score): for each distinct query (vector, own) the k best
    rows of each tree, but those of the id ``own`` where it is not null."""
    blocks = max(1, math.ceil(n_queries / block_queries))

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[dict] = []
        if left.num_rows and right.num_rows:
            tree = Tree(left.to_pylist())
            for raw, own in zip(right.column("vector").to_pylist(), right.column("own").to_pylist()):
                found += [{"vector": raw, "own": own, "vec_id": i, "score": s} for s, i in tree.search(np.frombuffer(raw, "<i8"), k, own)]
        return _table(found, pa.schema([("vector", pa.binary()), ("own", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))

    every_block = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    every_tree = queries.select("vector", "own", (F.octet_length("vector") / 8).cast("int").alias("dim"), F.pmod(F.xxhash64("vector", "own"), F.lit(blocks)).cast("int").alias("block"),
                                F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    keys = ["tree", "dim", "block"]
    return every_block.groupBy(*keys).cogroup(every_tree.groupBy(*keys)).applyInArrow(search, "vector binary, own long, vec_id long, score long")


def top_k(rows: DataFrame, queries: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``rows`` with the highest inner
    product with each row of ``queries`` (both vec_id, vector), but its own id; ties
    go to the smaller id.  Fewer rows give fewer results, none gives none.  Rows
    equal in id and vector count once; an id of several vectors is one query, with the
    best rows for any of them.  Only equal dimensions are compared.
    """
    pages, trees = build_trees(rows, k, scratch)
    # Of an id with one vector at most one of k + 1 rows is its own, so queries of a vector
    # share their search.  Where an id has several vectors, its own rows are left out in it.
    asked = rows.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").groupBy("vec_id").agg(
        (F.min("vector") != F.max("vector")).alias("_several"))
    named = scratch.keep(queries.distinct().join(asked, "vec_id", "left").select(
        F.col("vec_id").alias("query_id"), "vector", F.when(F.col("_several"), F.col("vec_id")).alias("own")), "queries")
    distinct = scratch.keep(named.select("vector", "own").distinct(), "distinct")
    found = scratch.keep(search_trees(pages, trees, distinct, distinct.count(), k + 1), "found")
    found = found.withColumnsRenamed({"vector": "_vector", "own": "_own"})
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    met = named.join(found, (F.col("vector") == F.col("_vector")) & F.col("own").eqNullSafe(F.col("_own"))).where("query_id <> vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
