"""Exact top-k search by inner product, after the three-phase uniform threshold algorithm."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumark.llm.shared import cut

#: Distinct query vectors of one round, at most about: what is broadcast at once is bounded by this.
ROUND = 16_384
LISTS = 2
_QUERIES, _ROWS = 1024, 4096


def quantise(vectors: DataFrame, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """(id, v): floor(scale * component) as double arrays, one row per id; vectors with a null or non-finite component are left out."""
    finite = F.forall(embedding, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    whole = F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    rows = vectors.filter(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & finite).select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("e"))
    return rows.groupBy("id").agg(F.min("e").alias(embedding)).select("id", whole.alias("v"))


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as a matrix, short ones filled with zeros; components beyond `width` are left out."""
    lengths = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    most = int(lengths.max()) if len(lengths) else 0
    if len(lengths) and (lengths == most).all():
        out = flat.reshape(len(lengths), most)
    else:
        out = np.zeros((len(lengths), most))
        out[np.arange(most) < lengths[:, None]] = flat
    if width is not None and width != most:
        out = out[:, :width] if width < most else np.hstack((out, np.zeros((len(out), width - most))))
    return np.ascontiguousarray(out)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exactly: in doubles where no sum can leave 2**53, in Python's integers otherwise (then bounded to a long)."""
    if not a.size or not b.size or a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) < 2.0**53:
        return a @ b.T
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a).dot(whole(b).T), -(2**63), 2**63 - 1)


def _best(query: np.ndarray, key: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest keys of each query, ties to smaller ids."""
    order = np.lexsort((ids, -key if key.dtype != object else np.argsort(np.argsort(-key)), query))
    q = query[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return order[rank < k]


def axes(queries: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the components, in falling order of how much of the queries lies along it."""
    _, basis = np.linalg.eigh(queries.T @ queries) if queries.size else (None, np.zeros((queries.shape[1],) * 2))
    return np.ascontiguousarray(basis[:, ::-1])


def _pairs(q: np.ndarray, rows: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The exact inner products of the pairs (q[x], rows[y])."""
    if not len(x) or not q.size or not rows.size:
        return np.zeros(len(x))
    if q.shape[1] * float(np.abs(q).max()) * float(np.abs(rows).max()) >= 2.0**53:
        return np.asarray([max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(q[i], rows[j], strict=True)))) for i, j in zip(x, y, strict=True)], dtype=object)
    return np.concatenate([np.einsum("ij,ij->i", q[x[i : i + 65_536]], rows[y[i : i + 65_536]]) for i in range(0, len(x), 65_536)])


def sufficient(q: np.ndarray, rows: np.ndarray, low: np.ndarray, basis: np.ndarray, edges: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of all pairs whose score is at least the query's cutoff, by lists along the basis.

    A list is scored for all rows, and a pair goes on only while its score so far and the lengths of what is left of
    both vectors (no product can be larger) may reach the cutoff; bounds are widened by more than they can be off. The
    scores of the pairs that are left are resolved exactly, pair by pair or, where these are many, all at once.
    """
    turned, other = q @ basis, rows @ basis
    off = 1e-9 * np.sqrt((turned**2).sum(1))[:, None] * np.sqrt((other**2).sum(1))[None, :]
    going, score = np.ones((len(q), len(rows)), bool), -low[:, None].astype(np.float64)
    for a, b in zip(edges[:-1], edges[1:-1], strict=False):  # the last list is left to the resolution
        score = score + turned[:, a:b] @ other[:, a:b].T
        left = np.sqrt((turned[:, b:] ** 2).sum(1))[:, None] * np.sqrt((other[:, b:] ** 2).sum(1))[None, :]
        going &= score + left + off + 1e-12 * np.abs(low[:, None]) >= 0
        if going.mean() <= 0.05:
            break
    if going.mean() > 0.25:
        whole = _product(q, rows)
        x, y = np.nonzero(whole >= low[:, None])
        return x, y, whole[x, y]
    x, y = np.nonzero(going)
    whole = _pairs(q, rows, x, y)
    reached = (whole >= low[x]).astype(bool)
    return x[reached], y[reached], whole[reached]


def _scan(rows: DataFrame, shared, k: int, cutoffs, lists: int) -> DataFrame:
    """One pass over the vectors for one round of queries; each task gives at most k entries for each query (and list).

    Without cutoffs it gives the local score lists: the k highest partial scores of each query in each list, with the
    whole score of these entries and of no others. With cutoffs it gives the entries that reach the query's cutoff,
    of which the k best of the task are enough; see sufficient().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, basis = shared.value
        width = queries.shape[1]
        edges = [width * i // lists for i in range(lists + 1)]
        low = cutoffs.value if cutoffs is not None else None
        held: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                ids, matrix = part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1), width)
                for first in range(0, len(queries), _QUERIES):
                    q = queries[first : first + _QUERIES]
                    found = []
                    if low is None:
                        turned, other = q @ basis, matrix @ basis
                        for a, b in zip(edges, edges[1:], strict=False):
                            s = turned[:, a:b] @ other[:, a:b].T
                            edge = np.partition(s, -k, axis=1)[:, -k, None] if s.shape[1] > k else np.full((len(s), 1), -np.inf)
                            x, y = np.nonzero(s >= edge)
                            found.append((x, ids[y], s[x, y], _pairs(q, matrix, x, y)))
                    else:
                        x, y, score = sufficient(q, matrix, low[first : first + _QUERIES], basis, edges)
                        found.append((x, ids[y], score, score))
                    for i, entries in enumerate(found):
                        if (first, i) in held:
                            entries = tuple(map(np.concatenate, zip(held[first, i], entries, strict=True)))
                        keep = _best(entries[0], entries[2], entries[1], k)
                        held[first, i] = tuple(e[keep] for e in entries)
        for (first, i), (x, ids, _, score) in held.items():
            for at in range(0, len(x), 65_536):
                rows = slice(at, at + 65_536)
                whole = np.clip(score[rows], -(2**63), 2**63 - 1) if score.dtype == object else score[rows]
                yield pa.RecordBatch.from_arrays([pa.array(x[rows].astype(np.int64) + first), pa.array(np.full(len(x[rows]), i, np.int64)), pa.array(ids[rows], pa.int64()), pa.array(whole.astype(np.int64), pa.int64())], names=["q", "list", "vec_id", "score"])

    return rows.mapInArrow(run, "q long, list long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, lists: int = LISTS, vec_id: str = "vec_id", embedding: str = "embedding", round_size: int = ROUND) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with all rows but its own.

    Components become floor(scale * x); ties go to the smaller vec_id. Vectors are turned to the axes along which most of
    the round's queries lies, and these are dealt to `lists` lists, a partial score in each. Phase 1 gathers, over all tasks, the k + 1 highest entries of every list for each query;
    the (k + 1)-th best whole score among them is a lower bound of the true one, for partial scores of any sign.
    Phase 2 broadcasts it: a row whose first lists and the lengths of what is left stay below it cannot reach it. Phase 3
    resolves the scores of the rest exactly on the integers, and the best are final. k + 1, as a query's own row is left
    out at the end.

    Equal vectors are one class: only its k + 1 smallest ids can ever be in a result, and queries with equal vectors
    are searched once. Queries go in rounds of about `round_size` distinct vectors, so broadcasts are bounded, and no
    row leaves its task unless it is among the best of that task.

    Null ids, null vectors and those with null or non-finite components take no part. Rows of one id count once, with
    the smallest vector. Vectors of other lengths are filled with zeros. A query with fewer than k others returns all;
    empty tables give no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = quantise(vectors, scale, vec_id, embedding)
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("_n") <= k + 1)
    rows = cut(ranked.select("id", "v"))
    asked = quantise(queries, scale, vec_id, embedding)
    asked = cut(asked.select("id", "v", F.xxhash64("v").alias("h")))
    rounds = max(1, -(-asked.agg(F.approx_count_distinct("h")).first()[0] // round_size))
    best = []
    for r in range(rounds):
        mine = asked.filter(F.pmod("h", F.lit(rounds)) == r)
        distinct = mine.groupBy("v").agg(F.min("id").alias("lead")).toArrow()
        if not distinct.num_rows:
            continue
        matrix = _matrix(distinct.column("v").combine_chunks())
        shared = spark.sparkContext.broadcast((matrix, axes(matrix)))
        lead = distinct.column("lead").to_numpy()
        listed = _scan(rows, shared, k + 1, None, lists)
        listed = listed.withColumn("_n", F.row_number().over(Window.partitionBy("q", "list").orderBy(F.desc("score"), "vec_id"))).filter(F.col("_n") <= k + 1)
        whole = listed.select("q", "vec_id", "score").distinct()
        bound = whole.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("_n") == k + 1).select("q", "score").toArrow()
        low = np.full(len(lead), -(2.0**63))
        low[bound.column("q").to_numpy()] = bound.column("score").to_numpy()
        low = np.where(np.abs(low) < 2.0**53, low, np.nextafter(low, -np.inf))  # never above a long that has no double
        final = _scan(rows, shared, k + 1, spark.sparkContext.broadcast(low), lists)
        final = final.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("_n") <= k + 1)
        names = spark.createDataFrame(pa.table({"q": np.arange(len(lead)), "lead": lead}))
        same = mine.join(mine.groupBy("v").agg(F.min("id").alias("lead")), "v").select("id", "lead")
        best.append(final.join(names, "q").join(same, "lead").select(F.col("id").alias("query_id"), "vec_id", "score"))
    if not best:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = functools.reduce(DataFrame.union, best).filter("query_id != vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
