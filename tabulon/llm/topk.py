"""Exact top-k by inner product: M-tree, best-first search.

Integer vectors are searched by inner product. With R^2 at least every squared norm, a vector x gets one more
coordinate sqrt(R^2 - |x|^2) and a query gets 0; then the squared distance is |q|^2 + R^2 - 2 q.x, so the nearest
are those of the highest inner product, and distance is a metric, which an M-tree needs.

Rows are dealt to the nearest of some pivots, and what one pivot gets by a hash into parts of bounded size. A task
builds an M-tree of its part: leaf pages of up to `page` vectors around a pivot, under inner pages of up to `page`
entries, up to one root. An entry holds its covering radius and its distance to the parent's pivot. The pages are the
rows of the index. A search opens a part's pages and takes a block of queries; each query keeps a heap of pages by the
least distance that any vector below them can have, and goes on until that is beyond its k-th best. An entry's distance
to the query is computed only if the stored distance to the parent leaves a chance:
|d(q, parent) - d(parent, x)| - r <= bound.
The roots of all parts are the top of the tree. A query first goes to the parts whose roots may hold the highest
scores; its k-th best there is a bound, and in a second round it goes, with the bound, only to those parts whose roots
reach it. Parts, blocks of queries and lost tasks are independent of each other.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, tidy_batches, written

#: Vectors in a part, entries in a page, queries in a block; pivots at most; parts that a query visits in the first round.
PART, PAGE, BLOCK, PIVOTS, FIRST = 16_384, 128, 4_096, 4_096, 2
#: Distances are computed in floating point; a bound must be beyond the k-th best by more than this share of the largest norm.
SLACK = 1e-9
PAGES = "dim int, part long, node int, level int, parent int, radius double, to_parent double, pivot binary, entries binary, ids binary, entry_to_pivot binary, norm2 double"


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """id, v: each component x as floor(scale * x). Rows with a null or empty vector or with null or non-finite components are left out."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return df.where(v.isNotNull() & (F.size(v) > 0)).where(~bad).select(F.col(id_col).cast("long").alias("id"), whole.alias("v")).where("id is not null")


def _clusters(points: np.ndarray, page: int) -> list[np.ndarray]:
    """Split points into groups of at most `page`, near points together: by the nearer of two far pivots, in halves."""
    found, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= page:
            found.append(rows)
            continue
        mine = points[rows]
        a = mine[np.argmax(((mine - mine[0]) ** 2).sum(1))]
        b = mine[np.argmax(((mine - a) ** 2).sum(1))]
        # the order by nearness to a against b, cut in the middle: exact copies split too, so no page overflows
        order = np.argsort(mine @ (b - a), kind="stable")
        half = max(page, (len(rows) // 2 + page - 1) // page * page)
        todo += [rows[order[:half]], rows[order[half:]]]
    return found


def build_pages(ids: np.ndarray, vectors: np.ndarray, norm2: float, page: int) -> list[dict]:
    """The pages of an M-tree of integer vectors, root first. norm2: R^2."""
    extra = np.sqrt(np.maximum(0.0, norm2 - (vectors.astype(np.float64) ** 2).sum(1)))
    points = np.column_stack([vectors.astype(np.float64), extra])
    nodes: list[dict] = []
    level, below = 0, None  # below: (pivots, radii, node numbers) of the level under this one
    while True:
        objects = points if below is None else below[0]
        pivots, radii, numbers = [], [], []
        for rows in _clusters(objects, page):
            mine = objects[rows]
            centre = mine.mean(0)
            pivot = mine[np.argmin(((mine - centre) ** 2).sum(1))]
            away = np.sqrt(((mine - pivot) ** 2).sum(1))
            radius = float((away if below is None else away + below[1][rows]).max())
            number = len(nodes)
            entry = {"node": number, "level": level, "parent": -1, "radius": radius, "to_parent": 0.0, "pivot": pivot}
            if below is None:
                entry |= {"entries": vectors[rows], "ids": ids[rows]}
            else:
                entry |= {"entries": mine, "ids": below[2][rows]}
                for child, d in zip(below[2][rows].tolist(), away.tolist(), strict=True):
                    nodes[child] |= {"parent": number, "to_parent": d}
            entry["entry_to_pivot"] = away
            nodes.append(entry)
            pivots.append(pivot)
            radii.append(radius)
            numbers.append(number)
        if len(numbers) == 1:
            return nodes
        level, below = level + 1, (np.array(pivots), np.array(radii), np.array(numbers, dtype=np.int64))


def search_pages(nodes: dict[int, dict], root: int, norm2: float, query_id: int, q: np.ndarray, k: int, least_score: float = -np.inf) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, id) of one query, best first, ties to the smaller id; and how many distances were computed. The query's own id takes no part.
    least_score: lower scores aren't wanted."""
    qf = np.append(q.astype(np.float64), 0.0)
    q2 = float((qf**2).sum())
    eps = SLACK * (np.sqrt(q2) + np.sqrt(norm2) + 1)
    best: list[tuple[int, int]] = []  # heap of (score, -id): the worst first
    computed = 1

    def reach() -> float:
        """Nothing farther than this can be among the k best."""
        known = max(least_score, best[0][0]) if len(best) >= k else least_score
        return np.sqrt(max(0.0, q2 + norm2 - 2.0 * known)) + eps

    far = float(np.sqrt(((qf - nodes[root]["pivot"]) ** 2).sum()))
    heap = [(max(0.0, far - nodes[root]["radius"]), root, far)]
    while heap:
        least, number, away = heapq.heappop(heap)
        bound = reach()
        if least > bound:
            break
        node = nodes[number]
        if node["level"] == 0:
            near = np.flatnonzero(np.abs(away - node["entry_to_pivot"]) <= bound)
            computed += len(near)
            scores = node["entries"][near] @ q
            if len(best) >= k:
                keep = scores >= best[0][0]
                near, scores = near[keep], scores[keep]
            for score, i in zip(scores.tolist(), node["ids"][near].tolist(), strict=True):
                if i == query_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (score, -i))
                elif (score, -i) > best[0]:
                    heapq.heapreplace(best, (score, -i))
        else:
            radii = node["radii"]
            near = np.flatnonzero(np.abs(away - node["entry_to_pivot"]) - radii <= bound)
            computed += len(near)
            d = np.sqrt(((node["entries"][near] - qf) ** 2).sum(1))
            least = np.maximum(0.0, d - radii[near])
            for m, i, x in zip(least.tolist(), node["ids"][near].tolist(), d.tolist(), strict=True):
                if m <= bound:
                    heapq.heappush(heap, (m, i, x))
    return [(s, -i) for s, i in sorted(best, reverse=True)], computed


def _dealt(vectors: DataFrame, n_rows: int, part: int) -> DataFrame:
    """dim, part, id, v: each vector in a part of its nearest pivot. Pivots are vectors, by a hash; a part has about `part` vectors."""
    spark = vectors.sparkSession
    n = min(PIVOTS, max(1, -(-n_rows // part)))
    some = vectors.select("v").distinct().orderBy(F.xxhash64("v")).limit(n).collect() if n > 1 else []
    pivots: dict[int, tuple[list[int], np.ndarray]] = {}
    for dim in {len(r.v) for r in some}:
        at = [i for i, r in enumerate(some) if len(r.v) == dim]
        pivots[dim] = (at, np.array([some[i].v for i in at], dtype=np.float64))
    known = spark.sparkContext.broadcast(pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.full(batch.num_rows, -1)
            v = batch.column(1).to_pylist()
            dims = np.array([len(x) for x in v])
            for dim, (at, points) in known.value.items():
                rows = np.flatnonzero(dims == dim)
                for lo in range(0, len(rows), 256):
                    mine = rows[lo : lo + 256]
                    x = np.array([v[i] for i in mine.tolist()], dtype=np.float64)
                    cells[mine] = np.array(at)[((points**2).sum(1) - 2.0 * x @ points.T).argmin(axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), *batch.columns], names=["cell", "id", "v"])

    if n == 1:
        return vectors.select(F.size("v").alias("dim"), F.lit(0).cast("long").alias("part"), "id", "v")
    dealt = written(vectors.mapInArrow(tidy_batches(nearest), "cell long, id long, v array<bigint>").withColumn("dim", F.size("v")), "dealt")
    # a row for each pivot and length at most; a pivot with many vectors, or copies, has several parts
    sizes = dealt.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / part).alias("parts"))
    parts = F.pmod(F.xxhash64("id", "v"), F.col("parts"))
    numbered = dealt.join(F.broadcast(written(sizes, "cells")) if sizes.count() <= 4 * PIVOTS else sizes, ["dim", "cell"])
    return numbered.select("dim", (F.shiftleft(F.col("cell") + 1, 32) + parts).alias("part"), "id", "v")


def build_index(vectors: DataFrame, n_rows: int, part: int = PART, page: int = PAGE) -> DataFrame:
    """The pages of the M-trees of `vectors` (id, v), a row each. Vectors of another length are in trees of their own.

    An id that comes more than once counts once for each row; in a pivot's parts rows go by a hash of the id and the
    vector, so that repeated ids and copies of a vector spread too.
    """

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.array(pdf["v"].tolist(), dtype=np.int64)
        ids = pdf["id"].to_numpy(np.int64)
        order = np.lexsort((*v.T[::-1], ids))  # any order of arrival gives the same pages
        v, ids = v[order], ids[order]
        norm2 = float((v.astype(np.float64) ** 2).sum(1).max())
        rows = build_pages(ids, v, norm2, page)
        return pd.DataFrame([x | {"dim": key[0], "part": key[1], "norm2": norm2} | {c: np.ascontiguousarray(x[c]).tobytes() for c in ("pivot", "entries", "ids", "entry_to_pivot")} for x in rows])[[c.split()[0] for c in PAGES.split(", ")]]

    return _dealt(vectors, n_rows, part).groupBy("dim", "part").applyInPandas(build, PAGES)


def open_pages(pdf: pd.DataFrame) -> tuple[dict[int, dict], int, float]:
    nodes: dict[int, dict] = {}
    for r in pdf.to_dict("records"):
        leaf = r["level"] == 0
        n = {"level": r["level"], "radius": r["radius"], "pivot": np.frombuffer(r["pivot"], np.float64), "ids": np.frombuffer(r["ids"], np.int64), "entry_to_pivot": np.frombuffer(r["entry_to_pivot"], np.float64)}
        n["entries"] = np.frombuffer(r["entries"], np.int64 if leaf else np.float64).reshape(len(n["ids"]), -1)
        nodes[r["node"]] = n
    # inner products of integers are exact in floating point up to 2**53, and faster; else they stay integers
    if all(np.abs(n["entries"]).max(initial=0) < 1 << 20 for n in nodes.values() if n["level"] == 0):
        for n in nodes.values():
            n["entries"] = n["entries"].astype(np.float64)
    for n in nodes.values():
        if n["level"]:
            n["radii"] = np.array([nodes[i]["radius"] for i in n["ids"].tolist()])
    root = int(pdf.loc[pdf["parent"] == -1, "node"].iloc[0])
    return nodes, root, float(pdf["norm2"].iloc[0])


def _routed(index: DataFrame, queries: DataFrame, bounds: DataFrame | None, first: int) -> DataFrame:
    """dim, part, id, v, least: the parts that a query (id, v) visits. Without `bounds` the `first` ones by their bound; with
    them (id, least) the others whose bound reaches the query's."""
    roots: dict[int, tuple] = {}
    # a row for each part, of some PART vectors
    for r in index.where("parent = -1").select("dim", "part", "radius", "norm2", "pivot").orderBy("dim", "part").collect():
        roots.setdefault(r.dim, []).append((r.part, r.radius, r.norm2, np.frombuffer(r.pivot, np.float64)))
    roots = {dim: tuple(map(np.array, zip(*of, strict=True))) for dim, of in roots.items()}
    known, again = index.sparkSession.sparkContext.broadcast(roots), bounds is not None

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, v, least in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (of := known.value.get(len(v))) is None:
                    continue
                parts, radius, norm2, pivot = of
                q = np.append(np.array(v, dtype=np.float64), 0.0)
                q2 = (q**2).sum()
                away = np.sqrt(((pivot - q) ** 2).sum(axis=1))
                slack = SLACK * (q2 + norm2 + 1)
                # |q - x|^2 = |q|^2 + R^2 - 2 q.x, and no x is nearer than this
                best = (q2 + norm2 - np.maximum(0.0, away - radius) ** 2) / 2 + slack
                order = np.lexsort((parts, -best))
                begun, rest = order[:first], order[first:]
                go = rest[best[rest] >= least] if again else begun
                rows += [(len(v), int(parts[p]), i, v, least) for p in go.tolist()]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64()]
            for lo in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[lo : lo + 10_000], strict=True), kinds, strict=True)], names=["dim", "part", "id", "v", "least"])

    never = F.lit(float("-inf"))
    asked = queries.select("id", "v", never.alias("least")) if bounds is None else queries.join(bounds, "id", "left").select("id", "v", F.coalesce("least", never).alias("least"))
    return asked.mapInArrow(tidy_batches(route), "dim int, part long, id long, v array<bigint>, least double")


def _visited(index: DataFrame, routed: DataFrame, blocks: int, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best in each part that a query visits."""
    asked = routed.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    pages = index.withColumn("block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))

    def search(pdf: pd.DataFrame, asked_: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(pdf) and len(asked_):
            nodes, root, norm2 = open_pages(pdf)
            for query_id, v, least in zip(asked_["id"].tolist(), asked_["v"].tolist(), asked_["least"].tolist(), strict=True):
                q = np.asarray(v, dtype=np.int64)
                q = q.astype(np.float64) if np.abs(q).max(initial=0) < 1 << 20 else q
                out += [(query_id, i, int(s)) for s, i in search_pages(nodes, root, norm2, query_id, q, k, least)[0]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    keys = ["dim", "part", "block"]
    return pages.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")


def search_index(index: DataFrame, queries: DataFrame, n_queries: int, k: int, block: int = BLOCK, first: int = FIRST) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each of `queries` (id, v) over all pages of `index`; ties to the smaller id."""
    blocks = max(1, -(-n_queries // block))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    begun = written(_visited(index, _routed(index, queries, None, first), blocks, k).withColumn("rank", place).where(F.col("rank") <= k), "begun")
    if index.where("parent = -1").groupBy("dim").count().agg(F.max("count")).first()[0] in (None, *range(first + 1)):
        return begun.select("query_id", "rank", "vec_id", "score")
    bounds = begun.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("least"))
    rest = _visited(index, _routed(index, queries, bounds, first), blocks, k)
    return begun.drop("rank").unionByName(rest).withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def topk(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """For each row of `queries`, the k rows of `df` of another id with the highest inner product of floor(scale * x); fewer, if there are fewer.

    Columns: query_id, rank (from 1), vec_id, score. Ties go to the smaller vec_id. Vectors that are null or empty
    or hold null or non-finite components take no part on either side, nor do null ids; a vector meets those of its
    own length only. Scores must fit 64 bits. Query ids are taken to be distinct. An empty table gives no rows;
    other columns are not looked at.
    """
    vectors = integer_vectors(df, id_col, vector_col, scale)
    asked = integer_vectors(queries, id_col, vector_col, scale)
    index = written(build_index(vectors, df.count()), "mtree")
    return search_index(index, asked, queries.count(), k)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk(vectors, vectors.where("vec_id % 20 = 0"))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
