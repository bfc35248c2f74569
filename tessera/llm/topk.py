"""Exact top-k inner products by multi-resolution segment statistics.

For two vectors cut into segments of length m, with segment means u, v and
deviations s, t, Cauchy-Schwarz bounds the inner product by the sum of
m * (u*v + s*t); equivalently the squared distance is at least the sum of
m * ((u-v)**2 + (s-t)**2). The bound is taken with few long segments first, then
with more and shorter ones, and only pairs that could still enter a query's k
best are computed exactly. So the answer is exact: bounds only skip work.

1. Pilot. Every query is scored against a bounded sample of the candidates
   (``pilot`` rows, chosen by a hash of the id). Its k-th best score there is a
   floor that its k best surely reach.
2. Cells. Blocks of queries, with their floors, meet blocks of candidates
   (``block`` rows of each at most); floors rise further within a cell. A cell
   yields at most k rows a query and says how many pairs it computed.
3. The cells' rows are merged by a ranked window, which Spark limits to k on the
   map side too.

Short segments bound best: on vectors without any structure only the finest level
(two components a segment) skips pairs, and it costs as much as the product itself.

Defined results: vectors that are null, empty or hold null or non-finite parts
take no part; only vectors of equal length are compared; a query never meets
rows of its own id, so repeated rows of one id never find each other; each
distinct vector of a query id is asked once and has ranks of its own; repeated
candidate rows count each; ties go to the smaller id. Parts whose products don't
fit a double exactly are computed with whole numbers of any size; a score beyond
64 bits is an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Components a segment, coarse to fine.
LENGTHS = (16, 4, 2)
#: Candidates compared at once within a cell.
STEP = 1024
#: A level is computed for pairs one by one below this share of pairs, else as a matrix.
SPARSE = 0.2
#: Candidates of the pilot, about.
PILOT = 4096


def quantised(column: str) -> Column:
    return F.transform(column, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))


def _statistics(x: np.ndarray, length: int) -> np.ndarray:
    """Scaled segment means and deviations, so that their inner product is the bound."""
    at = np.arange(0, x.shape[1], length)
    size = np.diff(np.append(at, x.shape[1]))
    mean = np.add.reduceat(x, at, axis=1) / size
    dev = np.sqrt(np.maximum(np.add.reduceat((x - np.repeat(mean, size, axis=1)) ** 2, at, axis=1) / size, 0.0))
    return np.concatenate([mean * np.sqrt(size), dev * np.sqrt(size)], axis=1)


def search_cell(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query row, candidate id, score) of each query's k best in this cell that reach its floor, and the pairs computed."""
    biggest = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    exact = np.float64 if biggest < 2**52 else object
    qx, cx = q.astype(exact), c.astype(exact)
    ql = [_statistics(q.astype(np.float64), m) for m in LENGTHS]
    cl = [_statistics(c.astype(np.float64), m) for m in LENGTHS]
    slack = 1e-9 * max(1.0, biggest)
    n = len(q)
    floor = np.full(n, -np.inf) if floor is None else floor.copy()
    best: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(0, dtype=int), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=exact))
    computed = 0
    for at in range(0, len(c), STEP):
        here = slice(at, at + STEP)
        width = len(c_ids[here])
        able = np.ones((n, width), dtype=bool)
        rows = cols = None
        if np.isfinite(floor).any():
            for a, b in zip(ql, cl, strict=True):
                if rows is None and able.mean() > SPARSE:
                    able &= a @ b[here].T + slack >= floor[:, None]
                    continue
                if rows is None:
                    rows, cols = np.nonzero(able)
                may = np.concatenate([np.einsum("ij,ij->i", a[rows[i : i + 65536]], b[here][cols[i : i + 65536]]) + slack >= floor[rows[i : i + 65536]] for i in range(0, len(rows), 65536)] or [np.zeros(0, dtype=bool)])
                rows, cols = rows[may], cols[may]
            if rows is None and able.mean() <= SPARSE:
                rows, cols = np.nonzero(able)
        if rows is None:
            score = (qx @ cx[here].T).ravel()
            rows, cols = (x.ravel() for x in np.indices((n, width)))
        elif len(rows):
            score = np.concatenate([(qx[rows[i : i + 65536]] * cx[here][cols[i : i + 65536]]).sum(axis=1) for i in range(0, len(rows), 65536)])
        else:
            continue
        computed += len(rows)
        keep = (q_ids[rows] != c_ids[here][cols]) & (score.astype(np.float64) >= floor[rows])
        r = np.concatenate([best[0], rows[keep]])
        i = np.concatenate([best[1], c_ids[here][cols[keep]]])
        s = np.concatenate([best[2], score[keep]])
        order = np.lexsort((i, -s.astype(np.float64), r)) if exact is np.float64 else np.array(sorted(range(len(r)), key=lambda x: (r[x], -s[x], i[x])), dtype=int)
        r, i, s = r[order], i[order], s[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        top = place < k
        best = (r[top], i[top], s[top])
        last = place == k - 1
        floor[r[last]] = np.maximum(floor[r[last]], s[last].astype(np.float64))
    return (*best, computed)


def _digest(v: np.ndarray) -> np.ndarray:
    return common.mix(np.bitwise_xor.reduce(common.mix(v.astype(np.uint64) + np.arange(v.shape[1], dtype=np.uint64) * common.MIX_A), axis=1)).view(np.int64)


def search(vectors: DataFrame, queries: Column, k: int = 5, *, block: int = 16384, least_block: int = 2048, pilot: int = PILOT) -> DataFrame:
    """``query_id, form, vec_id, score`` of each query's best rows by cell; rows with a null ``vec_id`` tell the pairs of a cell (``form``) and those computed (``score``)."""
    spark = vectors.sparkSession
    good = (
        common.columns_of(vectors, "vec_id", "embedding")
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
        .where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))))
        .select(F.col("vec_id").cast("long"), quantised("embedding").alias("v"), F.size("embedding").alias("dim"))
    )
    counts = good.agg(F.count(F.lit(1)), F.count(F.when(queries, 1))).first()
    n, nq = int(counts[0]), int(counts[1])
    wide = max(spark.sparkContext.defaultParallelism * 3, 1)
    cells = max(1, math.ceil(n / block), min(wide, n // least_block))
    q_blocks = max(1, math.ceil(nq / block))
    spread = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(cells)).cast("int")
    asked = good.where(queries).distinct().withColumn("qb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(q_blocks)).cast("int"))
    share = min(1 << 30, int((1 << 30) * pilot / max(1, n)))
    sample = good.where(F.pmod(F.xxhash64(F.lit(5), "vec_id", "v"), F.lit(1 << 30)) < share)
    each = F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb")

    def parts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = np.asarray(pa.compute.list_flatten(table.column("v")), dtype=np.int64).reshape(-1, table.column("dim")[0].as_py())
        return v, np.asarray(table.column("vec_id"), dtype=np.int64), np.asarray(table.column("q"))

    def floors(table: pa.Table) -> pa.Table:
        v, ids, is_q = parts(table)
        got = np.full(int(is_q.sum()), -np.inf)
        if is_q.any() and not is_q.all():
            r, _, s, _ = search_cell(v[is_q], ids[is_q], v[~is_q], ids[~is_q], k)
            last = np.flatnonzero(np.arange(len(r)) - np.searchsorted(r, r) == k - 1)
            got[r[last]] = np.nextafter(s[last].astype(np.float64), -np.inf) if s.dtype == object else s[last]
        return pa.table({"vec_id": pa.array(ids[is_q]), "v": table.column("v").filter(pa.array(is_q)), "dim": table.column("dim").filter(pa.array(is_q)), "qb": table.column("qb").filter(pa.array(is_q)), "floor": pa.array(got)})

    first = asked.select("vec_id", "v", "dim", "qb", F.lit(True).alias("q")).unionByName(sample.select("vec_id", "v", "dim", each, F.lit(False).alias("q")))
    # One group a block of queries and length: at most `block` queries and about `pilot` candidates.
    asked = first.groupBy("qb", "dim").applyInArrow(floors, "vec_id long, v array<long>, dim int, qb int, floor double")
    asked = asked.select("vec_id", "v", "dim", "qb", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cb"), F.lit(True).alias("q"), "floor")
    offered = good.withColumn("cb", spread).select("vec_id", "v", "dim", each, "cb", F.lit(False).alias("q"), F.lit(None).cast("double").alias("floor"))

    def cell(table: pa.Table) -> pa.Table:
        v, ids, is_q = parts(table)
        rows = np.flatnonzero(is_q)
        some = len(rows) and not is_q.all()
        r, i, s, computed = search_cell(v[is_q], ids[is_q], v[~is_q], ids[~is_q], k, np.asarray(table.column("floor").filter(pa.array(is_q)), dtype=np.float64)) if some else ([], [], [], 0)
        at = rows[np.asarray(r, dtype=int)]
        pairs = len(rows) * (len(ids) - len(rows))
        return pa.table({
            "query_id": pa.array([*ids[at].tolist(), None], pa.int64()), "form": pa.array([*_digest(v)[at].tolist(), pairs], pa.int64()),
            "vec_id": pa.array([*np.asarray(i, dtype=np.int64).tolist(), None], pa.int64()), "score": pa.array([*[int(x) for x in s], computed], pa.int64()),
        })

    return asked.unionByName(offered).groupBy("qb", "cb", "dim").applyInArrow(cell, "query_id long, form long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: Column, k: int = 5, **how) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k best among ``vectors(vec_id, embedding)``.

    ``queries``: a condition on ``vec_id`` that names the query set.
    """
    best = search(vectors, queries, k, **how).where("vec_id is not null")
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "form").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def skipped(vectors: DataFrame, queries: Column, k: int = 5, **how) -> DataFrame:
    """``pairs, computed`` of the search's cells: what the bounds left to compute."""
    return search(vectors, queries, k, **how).where("vec_id is null").agg(F.sum("form").alias("pairs"), F.sum("score").alias("computed"))


def brute_force(rows: list[tuple[int, list[float] | None]], is_query, k: int = 5) -> list[tuple[int, int, int, int]]:
    """The same by plain loops, for tests."""
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in good:
        if is_query(i):
            got = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in good if j != i and len(w) == len(v))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(got)]
    return out


