"""Oversampling of the smaller classes between nearest neighbours, and class counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from riskframe import functions as fx
from riskframe.operators.neighbors import nearest_lists
from riskframe.operators.ranking import dist_rank
from riskframe.session import stage_table


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label)


def smote(
    df: DataFrame,
    label: str,
    id_col: str,
    vec: str,
    k: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Grow every class to the size of the largest.

    Returns (id, copy, label, vec): the given rows with copy 0 and synthetic rows with copy >= 1,
    each x + u * (neighbour - x) for one of the k nearest rows of its class. The deficit is spread
    evenly: every row gets deficit div n copies and the rows first in hash order one more, so no
    row is picked by a random index and nothing has to be ranked. u and the choice of neighbour are
    drawn from the (seed, id, copy) hash. All classes are searched together, and neighbours bring their
    vectors along, so no row is looked up again.
    """
    array = T.ArrayType(T.DoubleType())
    rows = stage_table(df.select(id_col, label, F.col(vec).cast(array).alias(vec)), "smote")
    sizes = rows.groupBy(F.col(label).alias("_class")).agg(F.count(F.lit(1)).alias("_n"))
    biggest = sizes.agg(F.max("_n")).first()[0] or 0
    small = sizes.filter(F.col("_n") < biggest)
    short = small.filter(F.col("_n") <= k).first()
    if short:
        raise ValueError(f"class {short['_class']!r} has {short['_n']} rows, needs more than k={k}")
    small = stage_table(small.withColumn("_deficit", biggest - F.col("_n")), "small-classes")
    members = rows.join(small, F.col(label).eqNullSafe(F.col("_class")))
    key = fx.hash_key(seed, id_col)
    # rows of a class in hash order; the first get one copy more
    ranked = dist_rank(members.withColumn("_key", key), "_key", "_rank", by=["_class"])
    extra = F.when(F.col("_rank") <= F.col("_deficit") % F.col("_n"), 1).otherwise(0)
    ranked = ranked.withColumn("_copies", F.floor(F.col("_deficit") / F.col("_n")) + extra)
    ranked = stage_table(ranked.select(id_col, label, vec, "_copies"), "smote-members")
    lists = nearest_lists(
        ranked, ranked, k, query_id=id_col, base_id=id_col, query_vec=vec, base_vec=vec,
        exclude_self=True, by=label, payload=vec,
    )
    planned = (
        ranked.filter("_copies > 0")
        .join(lists, id_col)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    )
    pick = F.pmod(fx.hash_int(fx.hash_key(f"{seed}:pick", id_col, "copy")), F.lit(k)) + 1
    to = F.element_at("neighbors", pick.cast("int"))["payload"]
    u = fx.hash_uniform(f"{seed}:u", id_col, "copy")
    grown = planned.select(id_col, label, "copy", F.col(vec).alias("_from"), to.alias("_to"), u.alias("_u"))
    moved = F.zip_with("_from", "_to", lambda x, y: x + F.col("_u") * (y - x))
    grown = grown.select(id_col, "copy", label, moved.alias(vec))
    return rows.select(id_col, F.lit(0).alias("copy"), label, vec).unionByName(grown)
