"""Exact top-k by inner product with MaxScore pruning.

Vectors become integers, floor(scale * x) by component. Every dimension is a query term whose posting list
in a shard holds each row's contribution above the shard's least one, so contributions are never negative and
the term's score bound is the largest. Queries go in batches with one order of terms, by their summed bounds. For each
query the longest run of small bounds that cannot lift a row to its current k-th score is non-essential; a batch
traverses the terms that are essential for any of its queries, as one product of matrices over a block of rows. The
other terms are probed in falling order of bound, only for pairs of query and row whose sum plus the
remaining bounds can still compete. Block by block the k-th scores rise. Shards are merged by a window
over at most k rows per query and shard.

The query set and the rows are dealt into blocks and shards of bounded size and meet cell by cell; neither
side is broadcast or collected.

Defined results: vectors that are null, hold a null or non-finite component, or have no id take no part;
shorter vectors are padded with zeros; rows equal in id and vector count once; ties go to the smaller id;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.session import stage_table

SHARD_ROWS = 4096
QUERY_ROWS = 2048
#: Rows scored before the threshold is raised.
BLOCK = 1024
#: Queries that share their essential terms.
BATCH = 256
PROBES = 8
#: Pairs are probed one by one when they are fewer than one in this many.
DENSE = 64


def codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """Distinct (vec_id, codes) of the usable vectors."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    t = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(~bad)
    as_int = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return t.select(F.col(id_col).cast("long").alias("vec_id"), as_int.alias("codes")).distinct()


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _best(ids: np.ndarray, at: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    first = np.lexsort((ids[at], -score))[:k]
    return at[first], score[first]


def search(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int):
    """MaxScore over one shard: per query, positions of the k best rows other than its own, and their scores."""
    limit = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, rows.shape[1])
    # sums below 2**53 are exact in double precision
    kind = np.float64 if limit < 2.0**52 else np.int64
    postings = np.ascontiguousarray(rows.T, dtype=kind)
    top, bottom = postings.max(axis=1), postings.min(axis=1)
    for start in range(0, len(queries), BATCH):
        q = queries[start : start + BATCH].astype(kind)
        yield from _search_batch(postings, top, bottom, ids, q, own[start : start + BATCH], k)


def _search_batch(postings, top, bottom, ids, queries, own, k: int):
    floor = np.minimum(queries * top, queries * bottom)
    bound = np.maximum(queries * top, queries * bottom) - floor
    order = np.argsort(bound.sum(axis=0), kind="stable")
    q, n = np.ascontiguousarray(queries[:, order]), len(queries)
    zero = np.zeros((n, 1), q.dtype)
    # rest[:, i]: what the i first terms can add at most; lifted[:, i]: that with all other terms at their least
    rest = np.concatenate([zero, np.cumsum((floor + bound)[:, order], axis=1)], axis=1)
    lifted = rest + floor.sum(axis=1, keepdims=True) - np.concatenate([zero, np.cumsum(floor[:, order], axis=1)], axis=1)
    best = [(np.zeros(0, np.int64), np.zeros(0, q.dtype))] * n
    least = -np.inf if q.dtype == np.float64 else np.iinfo(np.int64).min
    need = np.full(n, least, dtype=q.dtype)
    for a in range(0, postings.shape[1], BLOCK):
        block = postings[order, a : a + BLOCK]
        ready = bool((need > least).all())
        # the first terms that cannot lift a row to the k-th score are non-essential, here for all queries of the batch
        split = int((lifted < need[:, None]).sum(axis=1).min()) - 1 if ready else 0
        split = min(max(split, 0), len(order) - 1)
        score = q[:, split:] @ block[split:]
        compete = score >= (need - rest[:, split])[:, None] if ready else np.ones(score.shape, dtype=bool)
        who, at = np.nonzero(compete)
        score = score[who, at]
        by_row = np.ascontiguousarray(block[:split].T)
        while split and len(at):
            # a few pairs are probed some terms at a time; where many compete, all of them at once
            step = slice(max(0, split - PROBES) if DENSE * len(at) < compete.size else 0, split)
            split = step.start
            if split or DENSE * len(at) < compete.size:
                score = score + np.einsum("ij,ij->i", q[:, step][who], by_row[:, step][at])
            else:
                score = score + (q[:, step] @ block[step])[who, at]
            keep = score >= (need - rest[:, split])[who]
            who, at, score = who[keep], at[keep], score[keep]
        other = ids[a + at] != own[who]
        who, at, score = who[other], a + at[other], score[other]
        cuts = np.searchsorted(who, np.arange(n + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[i], cuts[i + 1])
            more, s = at[part], score[part]
            if len(s) > 4 * k:  # only what reaches the k-th score is sorted, ties included
                reach = s >= np.partition(s, len(s) - k)[len(s) - k]
                more, s = more[reach], s[reach]
            best[i] = _best(ids, np.concatenate([best[i][0], more]), np.concatenate([best[i][1], s]), k)
            if len(best[i][1]) == k:
                need[i] = best[i][1][-1]
    for at, score in best:
        yield at, score.astype(np.int64)


def _cell(k: int):
    def run(table: pa.Table) -> pa.Table:
        width = max((len(x) for x in table["codes"]), default=0)
        m = _matrix(table["codes"], width)
        asks, ids = table["asks"].to_numpy(), table["vec_id"].to_numpy()
        rows, queries = np.flatnonzero(~asks), np.flatnonzero(asks)
        out: list[tuple] = []
        if width and len(rows):
            for i, (at, score) in zip(queries, search(m[rows], ids[rows], m[queries], ids[queries], k)):
                out.append((np.full(len(at), i), rows[at], score))
        elif len(rows):  # vectors without components
            for i in queries:
                at = rows[ids[rows] != ids[i]]
                at = at[np.argsort(ids[at], kind="stable")][:k]
                out.append((np.full(len(at), i), at, np.zeros(len(at), np.int64)))
        asker, at, score = (np.concatenate(x).astype(np.int64) if out else np.zeros(0, np.int64) for x in (list(zip(*out)) or [(), (), ()]))
        key = table["key"].to_numpy()
        return pa.table({"query_id": ids[asker], "key": key[asker], "vec_id": ids[at], "score": score})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k rows of highest inner product for every query among `codes` rows: query_id, rank, vec_id, score."""
    t = stage_table(vectors.withColumn("key", F.xxhash64("vec_id", "codes")).withColumn("asks", is_query), "codes")
    n = t.agg(F.count(F.lit(1)).alias("rows"), F.count_if("asks").alias("queries")).first()
    shards, blocks = max(1, -(-n["rows"] // shard_rows)), max(1, -(-n["queries"] // query_rows))
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    deal = lambda size: F.pmod("key", F.lit(size)).cast("int")
    rows = t.withColumn("shard", deal(shards)).withColumn("block", every(blocks)).withColumn("asks", F.lit(False))
    asks = t.filter("asks").withColumn("block", deal(blocks)).withColumn("shard", every(shards))
    cells = rows.unionByName(asks).groupBy("shard", "block")
    found = cells.applyInArrow(_cell(k), "query_id long, key long, vec_id long, score long")
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def search_table(vectors: DataFrame) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 20; every other row is a candidate."""
    return top_k(codes(vectors), F.col("vec_id") % 20 == 0)
