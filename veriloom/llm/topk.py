"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Queries and candidates are cut into blocks by a hash of the id; every (query block, candidate block) pair is one task's work, so neither
side is ever held whole.  In a task every dimension has its list of candidates sorted by value.  For each query by itself sorted access goes
down the lists of its components, from the top where the component is positive and from the bottom where it is negative, to
doubling depths; every candidate met gets its full score by random access; the query stops when its k-th score is
above the threshold, the sum of its components times the values at the current depth, which bounds all candidates not met.  A
threshold equal to the k-th score doesn't stop it, since a tie with a smaller id may follow.  Scores are computed in the narrowest of float32,
float64, int64 and Python's integers in which all of a block's are exact.  Each pair of blocks gives at most k rows
a query; a window over these gives the result.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; so do rows with a null id; a row is no
candidate of a query with the same id; repeated rows count as rows of their own; ties go to the smaller id; fewer candidates than k
give fewer rows; an empty table gives none.  Vectors are expected to have one width; those of another width than the widest
are filled up with zeros, which leaves inner products as they are.  Components and scores beyond a long are set to the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.llm import shared

K = 20
SCALE = 64
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 8192
#: The first depth to which lists are read; it doubles.
STEPS = 8


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array<int>): floor(scale * x) of the vectors that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.coalesce(bad, F.lit(True)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    out = np.zeros((len(column), width), dtype=np.int64)
    lengths = np.diff(np.concatenate([[0], ends]))
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(ends - lengths, lengths)] = flat
    return out


def _kind(queries: np.ndarray, candidates: np.ndarray) -> type:
    """The fastest number type in which every score and bound of these integers is exact."""
    most = lambda x: max((abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))), default=0)
    peak = max(1, most(queries)) * max(1, most(candidates)) * max(1, candidates.shape[1])
    return np.float32 if peak < 2**24 else np.float64 if peak < 2**53 else np.int64 if peak < 2**63 else object


def _best(scores: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """Which k come first by falling score, then by rising place."""
    if len(scores) > k:
        some = np.sort(scores)[-k] if scores.dtype == object else np.partition(scores, len(scores) - k)[len(scores) - k]
        may = np.flatnonzero(scores >= some)
    else:
        may = np.arange(len(scores))
    if scores.dtype == object:
        return np.array(sorted(may.tolist(), key=lambda i: (-scores[i], places[i]))[:k], dtype=np.int64)
    return may[np.lexsort((places[may], -scores[may]))[:k]]


def threshold_top_k(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, candidates: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[int], int]]:
    """For each query: its id repeated, ids and scores of the best k candidates of this block (its own id left out), and how many candidates it met."""
    order = np.argsort(ids, kind="stable")
    ids, candidates = ids[order], candidates[order]
    m, width = candidates.shape
    kind = _kind(queries, candidates)
    table, queries = candidates.astype(kind), queries.astype(kind)
    # each dimension's list, largest values first; for a negative component it is read from its end
    lists = np.ascontiguousarray(np.argsort(candidates, axis=0, kind="stable")[::-1].T)
    values = np.take_along_axis(np.ascontiguousarray(table.T), lists, axis=1)
    for own, q in zip(query_ids.tolist(), queries, strict=True):
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen, depth, reach, met = np.zeros(m, dtype=bool), 0, min(m, STEPS), 0
        scores, places = np.zeros(0, kind), np.zeros(0, np.int64)
        while True:
            now = np.zeros(m, dtype=bool)
            now[lists[up, depth:reach]] = True
            now[lists[down, m - reach : m - depth]] = True
            if reach == m:  # lists of components that are 0 were not read
                now[:] = True
            new = np.flatnonzero(now & ~seen)
            seen |= now
            met += len(new)
            new = new[ids[new] != own]
            # picking most rows out of the table costs more than multiplying it whole
            met_scores = table[new] @ q if len(new) * 8 < m else (table @ q)[new]
            scores, places = np.concatenate([scores, met_scores]), np.concatenate([places, new])
            first = _best(scores, places, k)
            scores, places = scores[first], places[first]
            if reach == m:
                break
            bound = q[up] @ values[up, reach - 1] + q[down] @ values[down, m - reach]
            if len(scores) == k and scores[-1] > bound:
                break
            depth, reach = reach, min(m, reach * 2)
        yield np.full(len(places), own, dtype=np.int64), ids[places], [int(x) for x in scores], met


def _task(k: int):
    names, kinds = ["query_id", "vec_id", "score"], [pa.int64()] * 3

    def run(key: tuple, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names=names)
        qv, cv = queries["v"].combine_chunks(), candidates["v"].combine_chunks()
        width = max(int(x.value_lengths().to_numpy(zero_copy_only=False).max()) for x in (qv, cv))
        found = list(threshold_top_k(queries["vec_id"].to_numpy(), _matrix(qv, width), candidates["vec_id"].to_numpy(), _matrix(cv, width), k))
        scores = [max(-(1 << 63), min(x, (1 << 63) - 1)) for f in found for x in f[2]]
        return pa.Table.from_arrays([*[pa.array(np.concatenate([f[i] for f in found])) for i in range(2)], pa.array(scores, pa.int64())], names=names)

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for tables of (vec_id, v)."""
    queries, candidates = shared.cut(queries), shared.cut(candidates)
    blocks = lambda df, size: max(1, -(-df.count() // size))
    nq, nc = blocks(queries, QUERY_BLOCK), blocks(candidates, CANDIDATE_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id", F.monotonically_increasing_id()), F.lit(n)).cast("int")
    left = queries.withColumn("qb", part(nq, 1)).withColumn("cb", every(nc))
    right = candidates.withColumn("cb", part(nc, 2)).withColumn("qb", every(nq))
    best = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(_task(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
