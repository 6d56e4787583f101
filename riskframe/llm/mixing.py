"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over block quotas.

Every document is cut into blocks of `block_words` words (or is one block). The blocks of a source stand
in a permuted order, by md5 of (seed, row, epoch, block), first pass before second pass; the source's quota
is the prefix of this order whose words reach its target. A tree then splits the vector of block quotas
among output shards: a node over shards [lo, hi) hands its left half a multivariate hypergeometric
draw, source after source, of exactly that half's capacity. A leaf owns, for each source, a contiguous and
disjoint range of the permuted blocks, which are shuffled inside the shard by another md5 order.

All of it is DataFrame work. Running sums of a source are cut into buckets of the uniform key, so a source
that holds a third of all rows is spread over a third of the buckets. The driver sees single rows of sums.

Defined results: a null or wordless text has size 0 and is never drawn; a null source is a source of its
own, last in order; rows equal in doc_id, source and text are copies of one row and are drawn together;
an empty table gives an empty mix; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.llm.common import let, n_words, numbered, same
from riskframe.session import stage_table

BLOCK_WORDS = 256
SHARD_BLOCKS = 1024
BUCKET_BLOCKS = 2048
SEED = "mix"
#: Shards below the nodes of one task of the tree, and most tasks of a level.
TASK_SHARDS = 16
MAX_TASKS = 512
#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
TOTAL = 1.5
REPEATS = 2


def sized(docs: DataFrame) -> DataFrame:
    """One row per distinct (doc_id, source, text): its digest, size in words and number of copies."""
    t = docs.select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), n_words(F.col("text")).alias("size"))
    return t.groupBy("doc_id", "source", "digest", "size").agg(F.count(F.lit(1)).alias("copies"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, repeats: int = REPEATS) -> DataFrame:
    """Per source: index, source_size, weight and target.

    The targets share `total` times all sizes by weight; a target stops at `repeats` times its source's
    size, and the excess is reshared among the others until none is above. Each round is one aggregate.
    """
    s = sizes.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("rows")
    )
    s = numbered(s, [F.col("source").asc_nulls_last()], "ix")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("ix") % len(weights) + 1).cast("int"))
    s = stage_table(s.withColumn("weight", w), "sources")
    cap = F.col("source_size") * repeats
    first = s.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("w")).first()
    wanted = total * (first["all"] or 0)
    level, capped = (wanted / first["w"], -1) if first["w"] else (0.0, 0)
    while True:
        above = F.col("weight") * F.lit(level) >= cap
        row = s.agg(
            F.sum(F.when(above, cap)).alias("cap"), F.sum(F.when(~above, F.col("weight"))).alias("w"), F.count_if(above).alias("n")
        ).first()
        if row["n"] == capped or not row["w"]:
            break
        level, capped = (wanted - (row["cap"] or 0)) / row["w"], row["n"]
    share = F.col("weight") * F.lit(float(level))
    return s.withColumn("target", F.when(share >= cap, cap.cast("double")).otherwise(share))


def _log_factorial(n: Column) -> Column:
    """ln(n!) by a table up to 15 and Stirling's series above."""
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    x = n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, 5))
    return F.when(n < 16, F.element_at(small, (n + 1).cast("int"))).otherwise(series)


def hypergeometric(whole: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """The draw at quantile `u` of the marked items among `drawn` of `whole`.

    Probabilities are summed outward from the mode, up and down in turn, until they reach `u`.
    """

    def walk(s):
        up = lambda k, p: p * (s.marked - k) * (s.drawn - k) / ((k + 1) * (s.whole - s.marked - s.drawn + k + 1))
        down = lambda k, p: p * k * (s.whole - s.marked - s.drawn + k) / ((s.marked - k + 1) * (s.drawn - k + 1))

        def step(a, j):
            pu = F.when(s.m + j > s.hi, 0.0).otherwise(F.when(j == 0, a.pu).otherwise(up(s.m + j - 1, a.pu)))
            pd = F.when(s.m - j < s.lo, 0.0).otherwise(F.when(j == 0, a.pd).otherwise(down(s.m - j + 1, a.pd)))

            def add(v):
                one = a.sum + v.pu
                both = F.when(j == 0, one).otherwise(one + v.pd)
                k = F.when(a.k.isNotNull(), a.k).when(one >= s.u, s.m + j).when(both >= s.u, s.m - j)
                return F.struct(v.pu.alias("pu"), v.pd.alias("pd"), both.alias("sum"), k.cast("long").alias("k"))

            return let(F.struct(pu.alias("pu"), pd.alias("pd")), add)

        p = F.exp(
            _log_factorial(s.marked) - _log_factorial(s.m) - _log_factorial(s.marked - s.m) + _log_factorial(s.whole - s.marked)
            - _log_factorial(s.drawn - s.m) - _log_factorial(s.whole - s.marked - s.drawn + s.m)
            - _log_factorial(s.whole) + _log_factorial(s.drawn) + _log_factorial(s.whole - s.drawn)
        )
        start = let(p, lambda q: F.struct(q.alias("pu"), q.alias("pd"), F.lit(0.0).alias("sum"), F.lit(None).cast("long").alias("k")))
        frac = s.marked / F.greatest(s.whole, F.lit(1))
        sd = F.sqrt(s.drawn * frac * (1 - frac) * (s.whole - s.drawn) / F.greatest(s.whole - 1, F.lit(1)))
        reach = F.least(F.greatest(s.m - s.lo, s.hi - s.m), F.ceil(12 * sd) + 12)
        return F.aggregate(F.sequence(F.lit(0).cast("long"), reach), start, step, lambda a: F.coalesce(a.k, s.m))

    whole, marked, drawn = (c.cast("long") for c in (whole, marked, drawn))
    lo, hi = F.greatest(F.lit(0).cast("long"), drawn + marked - whole), F.least(drawn, marked)
    mode = F.least(hi, F.greatest(lo, F.floor((drawn + 1) * (marked + 1).cast("double") / (whole + 2)))).cast("long")
    names = zip("whole marked drawn u lo hi m".split(), (whole, marked, drawn, u, lo, hi, mode))
    return let(F.struct(*[c.alias(name) for name, c in names]), walk)


def shard_ranges(quotas: DataFrame, n_shards: int, seed: str = SEED) -> DataFrame:
    """The leaves of the splitting tree: shard, ix, start and n, the source's permuted blocks it owns.

    `quotas` has ix 0, 1, ... and q. A node carries the counts of all sources and where they start.
    """
    nodes = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct("ix", "q"))).alias("s"))  # a row per source
    zero = F.lit(0).cast("long")
    nodes = nodes.select(
        zero.alias("lo"), F.lit(n_shards).cast("long").alias("hi"), F.col("s.q").alias("counts"),
        F.transform("s.q", lambda _: zero).alias("starts"),
    )
    uniform = lambda lo, hi, i: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), lo, hi, i)), 1, 13), 16, 10).cast("double") / 16.0**13
    for level in range(max(0, math.ceil(math.log2(max(1, n_shards))))):
        if level and level % 6 == 0:
            # a node's subtree is work of its own; the number keeps adaptive execution from merging them into one task
            parts = max(1, min(2**level, n_shards // TASK_SHARDS, MAX_TASKS))
            nodes = stage_table(nodes.repartition(parts, "lo"), "tree")
        total = F.aggregate("counts", zero, lambda a, x: a + x)
        mid = F.floor((F.col("lo") + F.col("hi")) / 2)
        n_left = F.floor(total * (mid - F.col("lo")) / (F.col("hi") - F.col("lo")))
        split = nodes.withColumn("mid", mid).withColumn("total", total).withColumn("n_left", n_left)

        def draw(a, x):
            k = hypergeometric(a.rest, x.k, a.n, uniform(F.col("lo"), F.col("hi"), x.i))
            return let(k, lambda got: F.struct((a.rest - x.k).alias("rest"), (a.n - got).alias("n"), F.concat(a.out, F.array(got)).alias("out")))

        begin = F.struct(F.col("total").alias("rest"), F.col("n_left").alias("n"), F.array().cast("array<long>").alias("out"))
        indexed = F.transform("counts", lambda k, i: F.struct(k.alias("k"), i.alias("i")))
        split = split.withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, F.aggregate(indexed, begin, draw, lambda a: a.out)))
        minus = F.zip_with("counts", "left", lambda a, b: a - b)
        plus = F.zip_with("starts", "left", lambda a, b: a + b)
        row = lambda lo, hi, c, s: F.struct(lo.alias("lo"), hi.alias("hi"), c.alias("counts"), s.alias("starts"))
        lo, hi, mid, left = (F.col(c) for c in ("lo", "hi", "mid", "left"))
        halves = F.array(row(lo, mid, left, F.col("starts")), row(mid, hi, minus, plus))
        whole = F.array(row(lo, hi, F.col("counts"), F.col("starts")))
        nodes = split.select(F.explode(F.when(left.isNotNull(), halves).otherwise(whole)).alias("e")).select("e.*")
    cells = F.arrays_zip(F.col("counts").alias("n"), F.col("starts").alias("start"))
    leaves = nodes.select(F.col("lo").alias("shard"), F.posexplode(cells).alias("ix", "c"))
    return leaves.select("shard", F.col("ix").cast("long").alias("ix"), "c.start", "c.n").filter("n > 0")


def mix(
    sizes: DataFrame,
    targets: DataFrame,
    block_words: int | None = BLOCK_WORDS,
    shard_blocks: int = SHARD_BLOCKS,
    repeats: int = REPEATS,
    seed: str = SEED,
) -> DataFrame:
    """The mix as placed blocks: doc_id, source, digest, copies, epoch, block, words, shard, position.

    `block_words=None` draws whole documents. A block takes part when more than half of it lies before the
    target, so a source's words miss the target by at most half a block.
    """
    # at most one row per source: Spark broadcasts it by its written size
    t = stage_table(targets.withColumn("parts", F.ceil(F.col("source_size") / (BUCKET_BLOCKS * (block_words or 64)) + 1)), "targets")
    with_target = sizes.filter("size > 0").join(t.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    per_block = F.col("size") if block_words is None else F.lit(block_words)
    epochs = F.sequence(F.lit(0), F.least(F.lit(repeats), F.greatest(F.lit(1), F.ceil(F.col("target") / F.col("source_size")))).cast("int") - 1)
    b = with_target.withColumn("epoch", F.explode(epochs))
    b = b.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / per_block))))
    b = b.withColumn("words", F.least(per_block, F.col("size") - F.col("block") * per_block).cast("long"))
    key = F.md5(F.concat_ws(":", F.lit(seed), "doc_id", "digest", "epoch", "block"))
    b = b.withColumn("key", key).withColumn("load", F.col("words") * F.col("copies"))
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 16.0**8 * F.col("parts")).cast("long")
    b = b.withColumn("part", part).select(
        "doc_id", "source", "digest", "copies", "ix", "target", "epoch", "block", "words", "load", "key", "part"
    )
    b = stage_table(b, "blocks")
    sums = b.groupBy("ix", "epoch", "part").agg(F.sum("load").alias("w"), F.count(F.lit(1)).alias("c"))
    earlier = Window.partitionBy("ix").orderBy("epoch", "part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    sums = sums.select(
        "ix", "epoch", "part", F.coalesce(F.sum("w").over(earlier), zero).alias("w_before"), F.coalesce(F.sum("c").over(earlier), zero).alias("c_before")
    )
    inside = Window.partitionBy("ix", "epoch", "part").orderBy("key")
    run = inside.rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("w_in", F.coalesce(F.sum("load").over(run), zero)).withColumn("c_in", F.row_number().over(inside) - 1)
    b = b.join(stage_table(sums, "sums"), ["ix", "epoch", "part"])
    b = b.filter(F.col("w_before") + F.col("w_in") + F.col("load") / 2 < F.col("target"))
    taken = stage_table(b.withColumn("rank", F.col("c_before") + F.col("c_in")).drop("w_before", "w_in", "c_before", "c_in", "part", "load"), "taken")
    quotas = t.select("ix").join(taken.groupBy("ix").agg(F.count(F.lit(1)).alias("q")), "ix", "left").select("ix", F.coalesce("q", zero).alias("q"))
    quotas = stage_table(quotas, "quotas")
    n_shards = max(1, math.ceil((quotas.agg(F.sum("q")).first()[0] or 0) / shard_blocks))
    cell = F.greatest(F.lit(1), F.floor(F.col("q") / n_shards)).alias("cell_size")
    cells = quotas.select("ix", cell)
    ranges = shard_ranges(quotas, n_shards, seed).join(cells, "ix")
    ends = F.sequence(F.floor(F.col("start") / F.col("cell_size")), F.floor((F.col("start") + F.col("n") - 1) / F.col("cell_size")))
    ranges = stage_table(ranges.withColumn("cell", F.explode(ends)).drop("cell_size"), "ranges")
    placed = taken.join(cells, "ix").withColumn("cell", F.floor(F.col("rank") / F.col("cell_size")))
    placed = placed.join(ranges, ["ix", "cell"]).filter("rank >= start and rank < start + n")
    local = Window.partitionBy("shard").orderBy(F.md5(F.concat_ws(":", F.lit("local"), "key")), "key")
    return placed.select(
        "doc_id", "source", "digest", "copies", "epoch", "block", "words", "shard", F.row_number().over(local).cast("long").alias("position")
    )


def mixed_documents(docs: DataFrame, targets_of=source_targets) -> DataFrame:
    """`docs` with every document as often as the mix takes it whole; the columns stay."""
    sizes = stage_table(sized(docs), "sizes")
    placed = mix(sizes, targets_of(sizes), block_words=None)
    times = placed.groupBy("doc_id", "source", "digest").agg(F.count(F.lit(1)).alias("times"))
    times = times.select(*[F.col(c).alias(f"_{c}") for c in times.columns])
    d = docs.select(F.struct(*docs.columns).alias("row"), F.md5(F.coalesce("text", F.lit(""))).alias("_text"))
    on = F.col("row.doc_id").eqNullSafe(F.col("_doc_id")) & F.col("row.source").eqNullSafe(F.col("_source")) & (F.col("_text") == F.col("_digest"))
    copies = d.join(times, on).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    return copies.select("row.*")


def mix_table(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: what the mix takes of it, its source's size and target, and where it went.

    `blocks`, `shards` and `positions` run alike: block, shard and place in the shard of everything taken, first pass first. Copies
    of a row are placed together, one after the other.
    """
    sizes = stage_table(sized(docs), "sizes")
    targets = stage_table(source_targets(sizes), "targets")
    placed = mix(sizes, targets)
    at = F.sort_array(F.collect_list(F.struct("epoch", "block", "shard", "position"))).alias("at")  # a text's own blocks, REPEATS times at most
    per = placed.groupBy("doc_id", "source", "digest").agg(F.sum("words").alias("taken"), F.count(F.lit(1)).alias("n_blocks"), at)
    keys = ["doc_id", "source", "digest"]
    joined = sizes.join(per, same(sizes, per, keys), "left").drop(*[per[k] for k in keys])
    t = targets.select(F.col("source").alias("of"), "source_size", "target")
    joined = joined.join(t, F.col("source").eqNullSafe(F.col("of")))
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    place = lambda c: F.coalesce(F.col(f"at.{c}").cast("array<long>"), F.array().cast("array<long>")).alias(f"{c}s")
    return joined.select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"), place("block"), place("shard"), place("position"),
    )
