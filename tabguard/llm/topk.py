"""Exact top-k by inner product with pivot-table elimination.

Vectors are made whole numbers first: floor(scale * x) of each component. Every
vector stores its distances to a set of pivots, computed once. The distances bound
|q - x| from below, and
    q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2
from above. The bound is the largest that the table allows: not only the largest
difference of the distances to one pivot, but that of all pivots together. They
place q and x in the space that the pivots span, up to their distances from it, so
    |q - x|^2 >= |q' - x'|^2 + (|q - q'|^2 ^ 1/2 - |x - x'|^2 ^ 1/2)^2
for their projections q' and x'. Candidates are evaluated in the order of the bound,
and a query stops when the bound of the next one is below its k-th best score: the
result is exact. A query starts from the k-th best score among a bounded sample of
rows, which no candidate below it can beat.

Queries and candidates meet block by block: a block of candidates is a bounded
group of rows, and so is a block of queries; each pair of blocks is one group,
which yields at most k rows a query. A query's best rows are then chosen by a
window over those. Rows are dealt to the blocks by identifier and place, so that
a repeated identifier fills no block.

Pivots and the sample are bounded: the first rows by their hash.

Defined cases: vectors that are null, or hold a null or non-finite component, take
no part; vectors of unequal length count as padded with zeros; an empty vector has
score 0 with all; equal scores go to the smaller identifier; rows with a null
identifier take no part; repeated identifiers are candidates each, but never of a
query with the same identifier; of repeated queries the one with the least vector
asks; a query with fewer than k candidates gets all; an empty table gives an empty
result. Scores beyond 64 bits raise OverflowError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabguard.llm.common import cut, map_arrow, quoted

SCALE = 1024
K = 10
PIVOTS = 48
SAMPLE_ROWS = 2048
#: Bytes that the sample may take; of wider vectors it holds fewer.
SAMPLE_BYTES = 8 << 20
#: Rows of a block of candidates and of one of queries: at 64 components 4 and 2 MB of each.
CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 4096
#: Candidates that a query evaluates at a time, in the order of their bounds.
STEP = 64
#: Queries whose bounds are computed at a time.
AT_ONCE = 64
FOUND = "query_id long, vec_id long, score long, evaluated long"


def _usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def _whole(vectors: list, scale: int, width: int) -> np.ndarray:
    """The vectors as whole numbers (in doubles, which hold them exactly), padded."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(float(scale) * out)


class Table:
    """The pivots, and what distances to them say."""

    def __init__(self, pivots: np.ndarray):
        self.pivots, self.norms = pivots, (pivots * pivots).sum(1)
        values, vectors = np.linalg.eigh(pivots @ pivots.T) if len(pivots) else (np.zeros(0), np.zeros((0, 0)))
        # directions that the pivots hardly span are left out: the bound is weaker, and still true
        good = values > 1e-6 * max(values.max(initial=0), 1e-300)
        self.turn = vectors[:, good] / np.sqrt(values[good])
        self.least = np.sqrt(values[good].min(initial=np.inf))

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ self.pivots.T + self.norms[None], 0))

    def places(self, distances: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Projections onto the space of the pivots, and the distances from it."""
        inside = ((norms[:, None] + self.norms[None] - distances * distances) / 2) @ self.turn
        return inside, np.sqrt(np.maximum(norms - (inside * inside).sum(1), 0))

    def slack(self, norms: np.ndarray) -> np.ndarray:
        """What rounding can add to or take from a projection and the distance to it, at most."""
        size = np.sqrt(norms)
        error = 4e-15 * (len(self.pivots) + 1) * (norms + self.norms.max(initial=0)) / self.least + 1e-15 * size
        return error + np.sqrt(2 * size * error + error * error)


def _bounds(table: Table, q_far: np.ndarray, q_norm: np.ndarray, x_far: np.ndarray, x_norm: np.ndarray):
    """A function from a slice of queries to upper bounds of their products with all x.

    (|q|^2 + |x|^2 - the least possible |q - x|^2) / 2 is the product of the projections and that of the rests.
    """
    q_in, q_out = table.places(q_far, q_norm)
    x_in, x_out = table.places(x_far, x_norm)
    q_size, x_size, q_slack, x_slack = np.sqrt(q_norm), np.sqrt(x_norm), table.slack(q_norm), table.slack(x_norm)

    def bounds(some: slice) -> np.ndarray:
        out = q_in[some] @ x_in.T + q_out[some][:, None] * x_out[None]
        out += q_slack[some][:, None] * (x_size + x_slack)[None] + q_size[some][:, None] * (x_slack + 1e-12 * x_size)[None] + 1
        return out

    return bounds


def _multiply(x: np.ndarray, q: np.ndarray):
    """Inner products as whole numbers: in 64 bits where no sum can exceed them, else in Python's."""
    most = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * x.shape[1]
    if most < 2.0**52:
        return lambda rows, i: (x[rows] @ q[i]).astype(np.int64)
    if most < 2.0**62:
        a, b = x.astype(np.int64), q.astype(np.int64)
        return lambda rows, i: a[rows] @ b[i]

    def slow(rows, i):
        b = [int(v) for v in q[i]]
        return np.array([sum(int(v) * w for v, w in zip(x[r], b)) for r in rows], np.int64)

    return slow


def _thresholds(q: np.ndarray, ids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, k: int) -> np.ndarray:
    """For each query a score that k rows of the sample, other than the query's own, reach; else the least."""
    out = np.full(len(q), np.iinfo(np.int64).min)
    product = _multiply(sample, q)
    every = np.arange(len(sample))
    for i, me in enumerate(ids):
        scores = product(every[sample_ids != me], i)
        if len(scores) >= k:
            out[i] = np.partition(scores, len(scores) - k)[-k]
    return out


def _search(queries: pa.Table, rows: pa.Table, table: Table, k: int) -> pa.Table:
    """The k best rows of a block for each query of a block, as far as they can be among its k best of all."""
    width = table.pivots.shape[1]
    matrix = lambda c, n: np.frombuffer(b"".join(c.to_pylist()), np.float64).reshape(len(c), n)
    order = np.argsort(rows["row"].to_numpy(), kind="stable")
    ids, x, x_far = rows["row"].to_numpy()[order], matrix(rows["v"], width)[order], matrix(rows["far"], len(table.pivots))[order]
    query_ids, q, q_far = queries["id"].to_numpy(), matrix(queries["v"], width), matrix(queries["far"], len(table.pivots))
    least = queries["least"].to_numpy()
    exact = _multiply(x, q)
    bounds = _bounds(table, q_far, (q * q).sum(1), x_far, (x * x).sum(1))
    out = []
    for start in range(0, len(q), AT_ONCE):
        for i, bound in enumerate(bounds(slice(start, start + AT_ONCE)), start):
            near = np.flatnonzero(~(bound < least[i]) & (ids != query_ids[i]))
            near = near[np.argsort(-bound[near], kind="stable")]
            best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
            step, at = STEP, 0
            while at < len(near):
                if len(best) == k and bound[near[at]] < best[-1]:
                    break
                take = near[at : at + step]
                best = np.concatenate([best, exact(take, i)])
                best_ids = np.concatenate([best_ids, ids[take]])
                top = np.lexsort((best_ids, -best))[:k]
                best, best_ids = best[top], best_ids[top]
                at, step = at + len(take), step * 2
            # what was evaluated stands beside the first row; a query that found none has one without vec_id
            n = max(1, len(best))
            done = np.zeros(n, np.int64)
            done[0] = at
            ids_out = pa.array(best_ids, pa.int64()) if len(best) else pa.nulls(1, pa.int64())
            scores = pa.array(best, pa.int64()) if len(best) else pa.nulls(1, pa.int64())
            out.append(pa.table([pa.array(np.full(n, query_ids[i]), pa.int64()), ids_out, scores, pa.array(done)], names=["query_id", "vec_id", "score", "evaluated"]))
    return pa.concat_tables(out)


def matches(
    vectors: DataFrame,
    is_query: Column,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = K,
    scale: int = SCALE,
    pivots: int = PIVOTS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """query_id, vec_id, score of each query's best rows of each block, and how many were evaluated for them."""
    asks = F.coalesce(is_query, F.lit(False))
    given = vectors.filter(quoted(id_column).isNotNull() & _usable(quoted(vector_column))).select(
        quoted(id_column).cast("long").alias("id"), quoted(vector_column).cast("array<double>").alias("x"), asks.alias("asks")
    )
    sizes = given.agg(F.count("*").alias("n"), F.count_if("asks").alias("asks"), F.max(F.size("x")).alias("width")).first()
    width = max(1, sizes["width"] or 0)
    blocks, query_blocks = max(1, -(-sizes["n"] // CANDIDATE_BLOCK)), max(1, -(-sizes["asks"] // QUERY_BLOCK))
    sample_rows = min(sample_rows, max(k + 1, SAMPLE_BYTES // (8 * width)))
    wanted = max(pivots, sample_rows)
    draw = F.pmod(F.xxhash64("id", "x"), F.lit(1 << 40))
    # twice as many as are wanted pass a filter, so that a task sends few; the rows collected are bounded
    few = given.filter(draw < int(min(1.0, (2 * wanted + 100) / max(1, sizes["n"])) * (1 << 40)))
    first = few.select("id", "x", draw.alias("d")).distinct().orderBy("d", "id", "x").limit(wanted).collect()
    sample, sample_ids = _whole([r["x"] for r in first], scale, width), np.array([r["id"] for r in first], np.int64)
    table = Table(np.unique(sample[:pivots], axis=0) if len(sample) else sample)
    sample, sample_ids = sample[:sample_rows], sample_ids[:sample_rows]

    def prepare(batches):
        n = 0
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                x = _whole(part.column(1).to_pylist(), scale, width)
                ids, asking = part.column(0).to_numpy(), np.array(part.column(2).to_pylist(), bool)
                least = np.full(len(x), np.iinfo(np.int64).min)
                if asking.any():
                    least[asking] = _thresholds(x[asking], ids[asking], sample, sample_ids, k)
                packed = lambda m: pa.array([row.tobytes() for row in m], pa.binary())
                place = np.arange(n, n + len(x)) % blocks
                n += len(x)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), packed(x), packed(table.distances(x)), pa.array(least), pa.array(place, pa.int64())],
                    names=["id", "x", "asks", "v", "far", "least", "place"],
                )

    prepared = map_arrow(given, prepare, "id long, x array<double>, asks boolean, v binary, far binary, least long, place long")
    rows = cut(prepared.withColumn("x", F.when(F.col("asks"), F.col("x"))))
    deal = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select(deal(blocks, F.col("id"), F.col("place")).alias("b"), every(query_blocks).alias("a"), F.col("id").alias("row"), "v", "far")
    asking = rows.filter("asks").groupBy("id").agg(F.min(F.struct("x", "v", "far", "least")).alias("q")).select("id", "q.v", "q.far", "q.least")
    queries = asking.select(deal(query_blocks, F.col("id")).alias("a"), every(blocks).alias("b"), "id", "v", "far", "least")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score", "evaluated")})
        return _search(left, right, table, k)

    return queries.groupBy("a", "b").cogroup(candidates.groupBy("a", "b")).applyInArrow(run, FOUND)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = K,
    scale: int = SCALE,
    pivots: int = PIVOTS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of each query, which is a row itself."""
    found = matches(vectors, is_query, id_column, vector_column, k, scale, pivots, sample_rows).filter("vec_id IS NOT NULL")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def share_evaluated(vectors: DataFrame, is_query: Column, **options) -> float:
    """The share of all pairs of a query and a candidate whose score was computed."""
    s = matches(vectors, is_query, **options).agg(F.sum("evaluated").alias("done"), F.count_distinct("query_id").alias("queries")).first()
    n = vectors.count()
    return (s["done"] or 0) / max(1, s["queries"] * (n - 1))
