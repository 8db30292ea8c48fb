"""Approximate nearest neighbours by cross-polytope hashing.

A table of the index turns each unit vector with three rounds of random signs and a
fast Hadamard transform, and files it under the signed axis that it is nearest to.
A query looks into the `probes` axes nearest to it in each table, and the vectors
found there in any table are compared exactly.

Axes are found once per row and travel beside the vector, 4 bytes a table.  Vectors
are dealt into blocks of bounded size by a hash, whatever axes they are filed under,
so an axis with a third of all vectors is spread like any other.  Queries are dealt
into blocks as well, and each task matches one block of queries with one of vectors:
a vector is shuffled once per query block, a query once per vector block, neither
once per table or probe.  In a task the queries of a batch look into the tables of
its block, one matrix product covers the vectors that any of them found, and only the
best few per query become rows.  No vector is dropped and no pair of vectors becomes
a row.  The result does not depend on the blocks.

A query that found fewer than k others, which needs very few vectors in all its
buckets, is compared with all rows, in the same blocks.

Scores are the cosine in double precision on the original vectors; a first matrix
product selects with a margin, and products summed in a fixed order decide, so that
equal vectors score equally and ties go to the smaller id.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part, as query or as candidate; neither do rows without id;
vectors are padded with zeros to one length; rows with one id and vector are one
row; rows with one id and different vectors are queries of their own, with a list
each under that id, and candidates for each other; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fallow.session import settle, ship_package

TABLES, PROBES = 12, 10
BLOCK = 65536  # rows of a block at most
BATCH = 128  # queries looked up together


def rotation_signs(dim: int, tables: int, seed: int) -> np.ndarray:
    """Random signs, by table and round, for vectors padded to a power of two."""
    return np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, 1 << max(0, dim - 1).bit_length()))


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n = rows.shape[1]
    half = 1
    while half < n:
        pairs = rows.reshape(len(rows), n // (2 * half), 2, half)
        rows = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(len(rows), n)
        half *= 2
    return rows / np.sqrt(n)


def rotate(rows: np.ndarray, signs: np.ndarray) -> np.ndarray:
    for s in signs:
        rows = hadamard(rows * s)
    return rows


def axes(rows: np.ndarray, signs: np.ndarray, probes: int) -> np.ndarray:
    """Per row the `probes` nearest signed axes, nearest first; axis a is 2a, its negative 2a + 1."""
    turned = rotate(rows, signs)
    both = np.stack([turned, -turned], axis=2).reshape(len(rows), -1)
    return np.argsort(-both, axis=1, kind="stable")[:, : min(probes, both.shape[1])]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    lists = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == dim).all():
        return lists.reshape(-1, dim)
    at = 0
    for i, n in enumerate(sizes):
        out[i, :n] = lists[at : at + n]
        at += n
    return out


def _even(rows: np.ndarray) -> np.ndarray:
    """Rows scaled by a power of two each, which changes no cosine and keeps squares in range."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])


def _with_axes(dim: int, tables: int, probes: int, seed: int):
    """Rows with the `probes` axes nearest to them in each table, as 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = rotation_signs(dim, tables, seed)
        for batch in batches:
            keys = np.stack([batch["id"].to_numpy(), batch["digest"].to_numpy()])
            batch = batch.take(pa.array(np.unique(keys, axis=1, return_index=True)[1]))  # a row repeated millions of times is not shuffled as often
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                rows = _even(_matrix(part["vector"], dim))
                unit = np.zeros((len(rows), signs.shape[2]))
                unit[:, :dim] = rows / np.sqrt((rows * rows).sum(axis=1))[:, None]
                near = np.stack([axes(unit, s, probes) for s in signs], axis=1).astype("<i4")
                yield pa.record_batch([*part.columns, pa.array([r.tobytes() for r in near], pa.binary())], names=[*part.schema.names, "axes"])

    return run


class _Side:
    """One side of a pair of blocks: ids, digests, scaled vectors, norms and axes (row, table, probe) of its distinct rows."""

    def __init__(self, rows: pa.Table, dim: int, tables: int):
        keys = np.stack([rows["id"].to_numpy(), rows["digest"].to_numpy()])
        (self.ids, self.digests), one = np.unique(keys, axis=1, return_index=True)
        self.vectors = _even(_matrix(rows["vector"].combine_chunks(), dim))[one]
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.axes = np.frombuffer(b"".join(rows["axes"].to_pylist()), "<i4").reshape(rows.num_rows, tables, -1)[one]


FOUND = pa.schema([("query_id", pa.int64()), ("query_digest", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _best(k: int, dim: int, tables: int, everything: bool):
    """Per pair of blocks: the k best vectors that each query finds in its buckets, or of all of them."""
    n_axes = 2 << max(0, dim - 1).bit_length()

    def found_by(q: _Side, part: slice, v: _Side) -> np.ndarray:
        other = (q.ids[part, None] != v.ids) | (q.digests[part, None] != v.digests)
        if everything:
            return other
        seen = np.zeros(other.shape, bool)
        for t in range(tables):
            looked_into = np.zeros((len(seen), n_axes), bool)
            np.put_along_axis(looked_into, q.axes[part, t], True, axis=1)
            seen |= np.take(looked_into, v.axes[:, t, 0], axis=1)
        return seen & other

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return FOUND.empty_table()
        q, v = _Side(queries, dim, tables), _Side(vectors, dim, tables)
        found = [[], [], [], []]
        for at in range(0, len(q.ids), BATCH):
            seen = found_by(q, slice(at, at + BATCH), v)
            among = np.flatnonzero(seen.any(axis=0))
            if not len(among):
                continue
            near, norms, ids = v.vectors[among], v.norms[among], v.ids[among]
            rough = (q.vectors[at : at + BATCH] @ near.T) / (q.norms[at : at + BATCH, None] * norms)
            rough[~seen[:, among]] = -np.inf
            take = min(k, len(among))
            bound = -np.partition(-rough, take - 1, axis=1)[:, take - 1] - 1e-9
            for i in range(len(rough)):
                mine = np.flatnonzero((rough[i] >= bound[i]) & (rough[i] > -np.inf))
                exact = (near[mine] * q.vectors[at + i]).sum(axis=1) / (q.norms[at + i] * norms[mine])
                mine, exact = mine[(o := np.lexsort((ids[mine], -exact))[:k])], exact[o]
                for out, values in zip(found, (np.full(len(mine), q.ids[at + i]), np.full(len(mine), q.digests[at + i]), ids[mine], exact), strict=True):
                    out.append(values)
        if not found[0]:
            return FOUND.empty_table()
        return pa.table([pa.array(np.concatenate(x)) for x in found], schema=FOUND)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", tables: int = TABLES, probes: int = PROBES, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows of `vectors` found for each row of `queries`, itself left out."""
    spark = vectors.sparkSession
    ship_package(spark)

    def usable(df: DataFrame) -> DataFrame:
        own = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
        finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
        own = own.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
        return own.select("id", F.xxhash64("vector").alias("digest"), "vector")  # a row is its id and vector

    everything, asked = usable(vectors), usable(queries)
    rows, dim = everything.agg(F.count("*"), F.max(F.size("vector"))).first()
    n_asked, dim_asked = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    width = max(dim or 1, dim_asked or 1)
    schema = "id long, digest long, vector array<double>, axes binary"
    filed = everything.mapInArrow(_with_axes(width, tables, 1, seed), schema)
    sought = asked.mapInArrow(_with_axes(width, tables, probes, seed), schema)
    # blocks of vectors: of bounded size, and on a small table enough of them for all cores
    v_blocks = max(1, -(-rows // block), min(spark.sparkContext.defaultParallelism, rows // 1024))

    def compare(q: DataFrame, n: int, all_rows: bool) -> DataFrame:
        q_blocks = max(1, -(-n // block))
        dealt = lambda blocks: F.pmod(F.xxhash64(F.lit(seed), "id", "digest"), F.lit(blocks))
        every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
        q = q.withColumn("q_block", dealt(q_blocks)).withColumn("v_block", every(v_blocks))
        v = filed.withColumn("v_block", dealt(v_blocks)).withColumn("q_block", every(q_blocks))
        pair = ["q_block", "v_block"]
        result = "query_id long, query_digest long, vec_id long, score double"
        near = q.groupBy(*pair).cogroup(v.groupBy(*pair)).applyInArrow(_best(k, width, tables, all_rows), result)
        order = Window.partitionBy("query_id", "query_digest").orderBy(F.desc("score"), "vec_id")
        return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    result = ["query_id", "rank", "vec_id", "score"]
    found = settle(compare(sought, n_asked, False))
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("query_digest").alias("digest"))
    short = settle(sought.join(full, ["id", "digest"], "left_anti"))
    n_short = short.count()
    if not n_short:
        return found.select(result)
    own = full.select(F.col("id").alias("query_id"), F.col("digest").alias("query_digest"))
    return found.join(own, ["query_id", "query_digest"], "left_semi").select(result).unionByName(compare(short, n_short, True).select(result))
