"""Approximate nearest neighbours by cross-polytope hashing, with exact reranking.

Unit vectors are turned by fast pseudo-rotations (three rounds of random signs and a Hadamard
transform); the nearest signed axis is the hash. Each table has its own rotation. A vector is
indexed under its nearest axis and a query looks under the nearest few. Equal vectors are
indexed once with their smallest ids, and a bucket larger than a block is dealt over several
tasks, with the queries that ask it in each. Cosines are taken from the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traitloom.llm.common import cut

TABLES = 12
PROBES = 10
BLOCK = 8192
SEED = 11


def rotations(dim: int, tables: int, hashes: int, seed: int = SEED) -> np.ndarray:
    """Random signs: tables x hashes x 3 rounds x (dim rounded up to a power of two)."""
    width = 1 << max(0, int(dim - 1).bit_length())
    return np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, hashes, 3, width))


def turned(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of signs and Hadamard transform, over the rows of ``x`` padded with zeros."""
    width = signs.shape[-1]
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    for k in range(3):
        y *= signs[k]
        step = 1
        while step < width:
            z = y.reshape(len(y), -1, 2, step)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(len(y), width)
            step *= 2
        y /= np.sqrt(width)
    return y


def axes(x: np.ndarray, signs: np.ndarray, probes: int) -> np.ndarray:
    """Buckets of each row in one table, the nearest first: rows x probes.

    With several hashes in a table the buckets are combinations, ranked by what they lose
    against the nearest axes; ties go to the smaller number.
    """
    codes = loss = None
    for one in signs:
        y = turned(x, one)
        both = np.concatenate([y, -y], axis=1)
        order = np.argsort(-both, axis=1, kind="stable")[:, :probes]
        lost = both.max(axis=1, keepdims=True) - np.take_along_axis(both, order, axis=1)
        if codes is None:
            codes, loss = order.astype(np.int64), lost
            continue
        codes = (codes[:, :, None] * both.shape[1] + order[:, None, :]).reshape(len(x), -1)
        loss = (loss[:, :, None] + lost[:, None, :]).reshape(len(x), -1)
        best = np.lexsort((codes, loss), axis=1)[:, :probes]
        codes, loss = np.take_along_axis(codes, best, axis=1), np.take_along_axis(loss, best, axis=1)
    return codes


def cosines(query: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Cosine of one vector with the rows of ``others``, each by the same sum in double precision."""
    q, o = query.astype(np.float64), others.astype(np.float64)
    dot = (o * q[None, :]).sum(axis=1)
    return dot / (np.sqrt((q * q).sum()) * np.sqrt((o * o).sum(axis=1)))


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows with an id whose vector is not null, empty or zero and is finite throughout."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int = TABLES,
    probes: int = PROBES,
    hashes: int = 1,
    block: int = BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query row, its own id left out.

    Largest cosine first, ties to the smaller id; fewer rows only if there are fewer candidates:
    a query whose buckets held less than ``k`` is compared with all. Ids that repeat with different vectors count as one candidate with its best score.
    Vectors of another length than the query's are no candidates. With no usable rows
    the result is empty. ``hashes`` per table can grow with the table to keep buckets small.
    """
    base = usable(vectors, id_col, vector_col)
    # k + 1 ids of each vector are enough for every query, its own among them. The limit is
    # applied before the shuffle too, so a vector that fills a third of the rows moves little.
    rank = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    few = base.withColumn("n", rank).where(F.col("n") <= k + 1)
    distinct = few.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("d", F.size("v"))
    distinct = cut(distinct)
    asked = usable(queries, id_col, vector_col).dropDuplicates(["id", "v"]).withColumn("d", F.size("v"))

    def index(batches: Iterator[pa.RecordBatch], wide: int):
        for batch in batches:
            size = batch.column(batch.schema.get_field_index("d")).to_numpy()
            for d in np.unique(size):
                part = batch.take(pa.array(np.flatnonzero(size == d)))
                v = part.column(part.schema.get_field_index("v"))
                x = _rows(v).astype(np.float64)
                scale = np.abs(x).max(axis=1, keepdims=True)
                x = x / scale
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                for t, signs in enumerate(rotations(int(d), tables, hashes)):
                    code = axes(x, signs, wide)
                    for p in range(code.shape[1]):
                        yield part, np.full(len(part), t, np.int32), code[:, p]

    def place(batches):
        for part, t, code in index(batches, 1):
            names = ["t", "code", "d", "ids", "v"]
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(code), *(part.column(part.schema.get_field_index(n)) for n in names[2:])], names)

    def ask(batches):
        for part, t, code in index(batches, probes):
            names = ["t", "code", "d", "id", "v"]
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(code), *(part.column(part.schema.get_field_index(n)) for n in names[2:])], names)

    kind = dict(vectors.dtypes)[vector_col]
    placed = distinct.mapInArrow(place, f"t int, code long, d int, ids array<long>, v {kind}")
    asks = asked.select("id", "v", "d").mapInArrow(ask, f"t int, code long, d int, id long, v {kind}")
    # Rows per bucket decide over how many blocks it is dealt: buckets are at most
    # tables * (2 * width) ** hashes per length, far fewer than vectors.
    sizes = cut(placed.groupBy("t", "code", "d").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")))
    bucket = ["t", "code", "d"]
    left = placed.join(sizes, bucket).withColumn("b", F.pmod(F.xxhash64(F.get("ids", F.lit(0)), "t"), F.col("blocks")).cast("int")).drop("blocks")
    right = asks.join(sizes, bucket).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def best(query_table: pa.Table, index_table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if query_table.num_rows and index_table.num_rows:
            x = _rows(index_table["v"].combine_chunks())
            ids = index_table["ids"].to_pylist()
            unit = x.astype(np.float64)
            norm = np.sqrt((unit * unit).sum(axis=1))
            q = _rows(query_table["v"].combine_chunks()).astype(np.float64)
            for a in range(0, len(q), 256):
                near = (q[a : a + 256] @ unit.T) / norm[None, :]
                for i, row in enumerate(near):
                    own, wide = query_table["id"][a + i].as_py(), k + 1
                    while True:
                        # All that may tie with the last one are looked at again exactly; rows of ids that are there
                        # already, or the query's own, make room for more.
                        at = max(0, len(row) - wide)
                        last = np.partition(row, at)[at]
                        some = np.flatnonzero(row >= last - 1e-9 * max(1.0, abs(last)))
                        others = {j for n in some.tolist() for j in ids[n]} - {own}
                        if len(others) >= k or len(some) == len(row):
                            break
                        wide = 2 * max(wide, len(some))
                    score, held = cosines(q[a + i], unit[some]), {}
                    for s, n in zip(score.tolist(), some.tolist()):
                        for j in ids[n]:
                            if j != own:
                                held[j] = max(s, held.get(j, s))
                    out += [(own, j, s) for j, s in sorted(held.items(), key=lambda x: (-x[1], x[0]))[:k]]
        cols = list(zip(*out)) if out else ((), (), ())
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    place_of, result = [*bucket, "b"], "query_id long, vec_id long, score double"
    found = cut(right.groupBy(*place_of).cogroup(left.groupBy(*place_of)).applyInArrow(best, result))
    # Queries that met fewer than k candidates are compared with all vectors, in blocks.
    full = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") >= k)
    short = cut(asked.join(full, asked["id"] == full["query_id"], "left_anti"))
    if not short.isEmpty():
        parts = max(1, -(-distinct.count() // block))
        spread = distinct.withColumn("b", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(parts)).cast("int"))
        everywhere = short.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        rest = everywhere.groupBy("d", "b").cogroup(spread.groupBy("d", "b")).applyInArrow(best, result)
        found = found.unionByName(rest)
    pairs = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
