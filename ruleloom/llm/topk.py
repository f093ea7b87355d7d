"""Exact top-k inner product by columnar branch-and-bound over blocks of vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, fields

DIMS = 16
#: Cells of queries and candidates that are tasks of their own; with more cells, a task has several.
MAX_TASKS = 20_000


def search_block(queries: np.ndarray, ids: np.ndarray, columns: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray, dims: int = DIMS) -> list[np.ndarray]:
    """For each query the positions of its k best of a block, by (score down, id up); those below its floor may be left out.

    columns holds the block dimension by dimension. Scores accumulate a block of dimensions at a time; after each, a
    candidate whose partial score plus the product of the remaining norms (the most that remaining mass can add) is
    below the k-th best lower bound (partial less that product), or below the floor that earlier blocks have set, is
    dropped, and the surviving columns are compacted.
    """
    n_dim, n = columns.shape
    if n == 0:
        return [np.empty(0, np.int64) for _ in queries]
    starts = list(range(0, n_dim, dims))
    mass = lambda m, axis: np.sqrt(np.cumsum((np.asarray(m, np.float64) ** 2)[::-1] if axis == 0 else (np.asarray(m, np.float64) ** 2)[:, ::-1], axis))
    rest_x, rest_q = mass(columns, 0)[::-1], mass(queries, 1)[:, ::-1]
    # The first block of dimensions is common to all queries of the block: one product.
    first = queries[:, : dims] @ columns[: dims]
    found = []
    for i, q in enumerate(queries):
        alive, part = None, first[i].astype(np.float64)
        if own[i] >= 0:
            part[own[i]] = -np.inf
        for at in starts[1:] + [n_dim]:
            if at < n_dim:
                left = rest_q[i, at] * (rest_x[at] if alive is None else rest_x[at, alive]) * (1 + 1e-9) + 1e-6
            else:
                left = 0.0
            if len(part) > k or floor[i] > -np.inf:
                low = part - left
                bound = max(floor[i], np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf)
                keep = np.flatnonzero(part + left >= bound)
                if len(keep) < 0.7 * len(part) or at == n_dim:
                    part, alive = part[keep], keep if alive is None else alive[keep]
            if at < n_dim:
                cols = columns[at : at + dims] if alive is None else columns[at : at + dims, alive]
                part = part + q[at : at + dims] @ cols
        alive = np.arange(n) if alive is None else alive
        ok = np.isfinite(part)
        alive, part = alive[ok], part[ok]
        found.append(alive[np.lexsort((ids[alive], -part))[:k]])
    return found


def scaled(embedding: Column) -> Column:
    """floor(64 x) of each component as long; null where a component (or the vector) is null or not finite."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(fit & (F.size(x) > 0), F.transform(x, lambda v: F.floor(v * 64).cast("long")))


def _packed(rows: DataFrame, name: Column) -> DataFrame:
    """dim, b, ids, prints, values (dimension by dimension), wide: the rows (vec_id, v, dim, print) of each block."""

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["vec_id", "print"], kind="stable")
        values = np.stack(part["v"].to_numpy()).astype(np.int64)
        small = bool(np.abs(values).max(initial=0) < 2**15)
        return pd.DataFrame(
            {"dim": [int(key[0])], "b": [int(key[1])], "ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "prints": [part["print"].to_numpy(np.int64).tobytes()],
             "values": [values.T.astype(np.int16 if small else np.int64).tobytes()], "wide": [not small]}
        )

    return rows.select("vec_id", "v", "dim", "print", name.alias("b")).groupBy("dim", "b").applyInPandas(pack, "dim int, b long, ids binary, prints binary, values binary, wide boolean")


def top_k(vectors: DataFrame, queries: Column, k: int = 20, block: int = 8192, query_block: int = 8192, group: int = 16) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products with other rows.

    vectors: (vec_id long, v array<long>). queries: which rows are queries; all rows with an id are candidates but those
    of the query's id. Rows are packed into blocks of equal dimension. Blocks of queries and groups of candidate blocks
    meet in a grid: each cell is a task that takes its candidate blocks one after the other, keeps the k best of each
    query as the floor for the next, and gives out at most k rows for each query; these partial tops are cut again
    before and after they meet. A cell holds one block of queries and one group of candidates, whatever the table's size.

    Rows without vector or id take no part, vectors of other lengths are not compared, ties go to the smaller id. Rows
    that repeat an id are candidates each. Query rows equal in id and vector are one query; those of one id with
    different vectors are queries each, ranked apart. No queries or an empty table give no rows.
    """
    rows = fields(vectors, vec_id=vectors["vec_id"].cast("long"), v=vectors["v"], dim=F.size(vectors["v"])).withColumn("is_query", F.coalesce(queries, F.lit(False)))
    rows = rows.filter("vec_id is not null and v is not null").withColumn("print", F.xxhash64("v"))
    counts = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / (block * group)).alias("groups"), F.ceil(F.count_if("is_query") / query_block).alias("query_blocks"))
    cells = counts.agg(F.sum(F.col("groups") * F.col("query_blocks"))).first()[0] or 1
    counts = counts.withColumnRenamed("dim", "d")

    def blocks(part: DataFrame, count: str, per: int, *salt: Column) -> DataFrame:
        dealt = part.join(counts, part.dim == counts.d)
        return _packed(dealt, F.pmod(F.xxhash64("vec_id", "print", *salt), F.col(count) * per))

    def spread(packed: DataFrame, count: str, column: str) -> DataFrame:
        """Each block once for every block or group that it meets."""
        both = packed.join(counts, packed.dim == counts.d)
        return both.filter(f"{count} > 0").withColumn(column, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)))

    cand = spread(blocks(rows, "groups", group), "query_blocks", "qb").withColumn("g", F.floor(F.col("b") / group))
    asks = blocks(rows.filter("is_query").dropDuplicates(["vec_id", "print"]), "query_blocks", 1, F.lit(1))
    asks = spread(asks, "groups", "g").withColumnRenamed("b", "qb")
    grid, n = ["dim", "qb", "g"], min(cells, MAX_TASKS)
    cand, asks = (x.select(*grid, "ids", "prints", "values", "wide").repartition(n, *grid) for x in (cand, asks))
    schema = pa.schema([("query_id", pa.int64()), ("print", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def read(r: dict) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(r["ids"], np.int64), np.frombuffer(r["values"], np.int64 if r["wide"] else np.int16).reshape(r["dim"], -1)

    def search(key, blocks_: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(asked) or not len(blocks_):
            return schema.empty_table()
        ask = asked.to_pylist()[0]
        qids, qs = read(ask)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(qids)
        floor = np.full(len(qids), -np.inf)
        for r in sorted(blocks_.to_pylist(), key=lambda r: r["ids"]):
            for i, (ids, score) in enumerate(_search_one(qids, qs, *read(r), k, floor)):
                ids, score = np.concatenate([best[i][0], ids]), np.concatenate([best[i][1], score])
                top = np.lexsort((ids, -score))[:k]
                best[i] = ids[top], score[top]
                if len(top) == k:
                    floor[i] = score[top[-1]]
        size = [len(ids) for ids, _ in best]
        prints = np.frombuffer(ask["prints"], np.int64)
        return pa.Table.from_batches([batch(schema, np.repeat(qids, size), np.repeat(prints, size), np.concatenate([x for x, _ in best]), np.concatenate([x for _, x in best]))])

    best = cand.groupBy(*grid).cogroup(asks.groupBy(*grid)).applyInArrow(search, "query_id long, print long, vec_id long, score long")
    w = Window.partitionBy("query_id", "print").orderBy(F.col("score").desc(), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search_one(qids: np.ndarray, qs: np.ndarray, ids: np.ndarray, columns: np.ndarray, k: int, floor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """ids and scores of each query's k best of one block."""
    dim = len(columns)
    peak = float(np.abs(columns.astype(np.float64)).max(initial=0)) * float(np.abs(qs.astype(np.float64)).max(initial=0)) * dim
    if peak >= 2**52 or (len(ids) > 1 and (np.diff(ids) == 0).any()):
        # Whole integer products where doubles could round, or where ids repeat.
        out, whole = [], columns.astype(np.int64)
        for q, v in zip(qids, qs.T.astype(np.int64)):
            s = v @ whole
            s, i = s[ids != q], ids[ids != q]
            top = np.lexsort((i, -s))[:k]
            out.append((i[top], s[top]))
        return out
    where = np.searchsorted(ids, qids)
    where[where == len(ids)] = 0
    kind = np.float32 if peak < 2**23 else np.float64
    cols, asks = columns.astype(kind), qs.T.astype(kind)
    found = search_block(asks, ids, cols, np.where(ids[where] == qids, where, -1), k, floor)
    flat, reps = np.concatenate(found), np.repeat(np.arange(len(qids)), [len(x) for x in found])
    score = np.einsum("ij,ij->j", cols[:, flat].astype(np.float64), asks[reps].T.astype(np.float64)).astype(np.int64)
    ends = np.cumsum([len(x) for x in found])[:-1]
    return list(zip(np.split(ids[flat], ends), np.split(score, ends)))
