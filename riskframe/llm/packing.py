"""Conflict-constrained best-fit packing of documents into sequences of fixed length.

Documents are cut into pieces of at most `capacity` words; full pieces are bins of their own. The others
are dealt by hash to groups of bounded size, and each group packs its pieces, longest first. Open bins are
ordered by residual: one bitmap of bins per residual. Every source and every duplicate cluster has a bitmap
of the bins that hold it. For a piece, the search starts at the residual equal to its length and goes
from successor to successor until a residual has a bin that is in neither bitmap, the tightest compatible
one. Copies of one cluster never share a bin. A source repeats in a bin only when no open bin without it has
room. Without a compatible bin a new one is opened.

A cluster is a text up to case and blanks, so the copies that a mix repeats are kept apart as well.

Defined results: documents without words take no room and get no bin; null sources are a source of their own;
repeated rows are packed one by one; ties are broken by id, text and copy, so reruns agree; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from riskframe.llm.common import words
from riskframe.session import stage_table

CAPACITY = 2048
GROUP_PIECES = 4096
NULL_ID = -(2**63)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, in the order given; lengths are between 1 and `capacity`."""
    at_residual = [0] * (capacity + 1)  # bitmap of bins
    occupied = 0  # bitmap of residuals that have bins
    of_source: dict = {}
    of_cluster: dict = {}
    residual: list[int] = []
    bins, offsets = [], []
    for need, source, cluster in zip(lengths, sources, clusters):
        hard = of_cluster.get(cluster, 0)
        soft = hard | of_source.get(source, 0)
        chosen = -1
        for against in (soft, hard):
            left = occupied >> need
            level = need
            while left:
                skip = (left & -left).bit_length() - 1
                level += skip
                free = at_residual[level] & ~against
                if free:
                    chosen = (free & -free).bit_length() - 1
                    break
                left >>= skip + 1
                level += 1
            if chosen >= 0 or against == hard == soft:
                break
        if chosen < 0:
            chosen = len(residual)
            residual.append(capacity)
        else:
            level = residual[chosen]
            at_residual[level] ^= 1 << chosen
            if not at_residual[level]:
                occupied ^= 1 << level
        bit = 1 << chosen
        bins.append(chosen)
        offsets.append(capacity - residual[chosen])
        residual[chosen] -= need
        if residual[chosen]:
            at_residual[residual[chosen]] |= bit
            occupied |= 1 << residual[chosen]
        of_source[source] = of_source.get(source, 0) | bit
        of_cluster[cluster] = hard | bit
    return bins, offsets


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, own, copy, n_words, piece, start, length, source, cluster."""
    text = F.translate("text", UPPER, LOWER)
    t = docs.select("doc_id", "source", F.xxhash64("text").alias("own"), words(text).alias("w"))
    t = t.select("doc_id", "source", "own", F.size("w").cast("long").alias("n_words"), F.xxhash64("w").alias("cluster"))
    t = t.groupBy("doc_id", "source", "own", "n_words", "cluster").agg(F.count(F.lit(1)).alias("copies"))
    zero = F.lit(0).cast("long")
    t = t.withColumn("copy", F.explode(F.sequence(zero, F.col("copies") - 1))).drop("copies")
    t = t.withColumn("piece", F.explode(F.sequence(zero, F.greatest(zero, F.floor((F.col("n_words") - 1) / capacity)))))
    start = F.col("piece") * capacity
    return t.withColumn("start", start).withColumn("length", F.least(F.lit(capacity), F.col("n_words") - start))


def pack(docs: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: doc_id, copy, n_words, piece, start, length, source, cluster, bin, offset."""
    t = stage_table(pieces(docs, capacity), "pieces")
    n = t.count()
    key = F.xxhash64("doc_id", "own", "copy", "piece")
    # ids travel without nulls, which pandas would turn into floats
    t = t.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    t = t.withColumn("grp", F.pmod(key, F.lit(max(1, -(-n // group_pieces)))))
    columns = ["doc_id", "copy", "n_words", "piece", "start", "length", "source", "cluster"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "own", "copy", "piece"], ascending=[False, True, True, True, True], kind="stable")
        bins, offsets = best_fit(pdf["length"].tolist(), pdf["source"].tolist(), pdf["cluster"].tolist(), capacity)
        return pdf[columns].assign(bin=(int(pdf["grp"].iloc[0]) << 32) + np.array(bins, dtype="i8"), offset=np.array(offsets, dtype="i8"))

    types = "doc_id long, copy long, n_words long, piece long, start long, length long, source string, cluster long"
    packed = t.filter("length > 0").groupBy("grp").applyInPandas(run, f"{types}, bin long, offset long")
    empty = t.filter("length <= 0").select(*columns, F.lit(None).cast("long").alias("bin"), F.lit(None).cast("long").alias("offset"))
    return packed.unionByName(empty).withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
