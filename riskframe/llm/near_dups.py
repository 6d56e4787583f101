"""Near-duplicate documents by SetSketch registers, verified on full shingle sets.

A document's set is its distinct word shingles (lower-cased A-Z); with fewer words than a shingle takes, its
whole word sequence is the only one. Every element gives `REGISTERS` exponential values in ascending order at
pseudo-random registers; a register keeps the smallest, stored truncated on an exponential scale (floor of
minus log to base `BASE`). Registers of a union are the element-wise maxima, and two sets agree in a
register with a probability close to their Jaccard similarity.

1. One pass over the texts gives each row its set's digest, size and registers. Equal sets become one class, led
   by the smallest doc_id; the copies never meet again.
2. Bands of `ROWS` registers are bucket keys. The first `FIRST` bands alone bring most groups together: in a bucket
   every class is paired with the bucket's leader only, and keeps the leader it shares most bands with. The pair's
   similarity is estimated jointly from both register vectors by maximum likelihood, given the exact set sizes;
   pairs estimated more than four standard errors below the threshold are dropped, the others verified on the
   full sets, computed from the whole texts. That gives components, and exact distances to leaders.
3. All bands follow; a pair of similarity 0.8 misses them all with probability below 2e-9. Only buckets that hold
   several components are opened: a bucket of one component, however large, has nothing to add. First the classes
   outside a bucket's largest component meet one class of it, then components are recomputed.
4. The exact rest: in a bucket that still holds several components, every class outside the bucket's largest
   component meets every class of another component, in blocks of bounded size. Pairs whose distances to a
   common leader differ by more than the threshold allows cannot be similar (Jaccard distance is a metric);
   a pair is judged in the first band it shares; survivors of the estimate are verified, cell by cell: a text goes
   to a cell once and its set is made once there. Between cells pass a class's text and its partners' places, a row per
   class, never a row per pair; links inside what is connected by then are not looked for.
   So a group of many copies costs a row per member and cell, and no component changes.

Components come from alternating star contractions on DataFrames, written out round by round.

Defined results: texts without words are linked with nothing; rows without an id are linked with nothing and
kept, with a null component; rows that repeat an id are linked by their texts; extra columns are ignored.
Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from riskframe.llm.common import numbered, stage_text
from riskframe.session import stage_table

REGISTERS = 256
ROWS = 5
BANDS = REGISTERS // ROWS
BASE = 1.001
OFFSET = 8192
#: Bands of the first round.
FIRST = 6
#: More than four standard errors of the estimate at similarity 0.8.
MARGIN = 0.11
#: Up to this many classes are looked up in the texts by a table that travels with the tasks.
NEEDED_ROWS = 500_000
#: Classes that meet in one cell, per side.
BLOCK = 512
#: Bytes of text handled at a time inside a task.
CHUNK = 1_000_000

_rng = np.random.default_rng(20240229)
_WEIGHTS = _rng.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_WEIGHTS = _rng.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Multiples of the golden ratio, one per round.
_ROUND = np.arange(1, REGISTERS + 2, dtype=np.uint64) * _GOLDEN
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words begin (one more at the end)."""
    raw = [t.encode().lower() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    blank = _BREAK[data]
    start = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    stop = np.flatnonzero(blank & np.r_[False, ~blank[:-1]])
    ends = np.cumsum([len(r) + 1 for r in raw])
    first = np.searchsorted(start, np.r_[0, ends])
    if not len(start):
        return np.zeros(0, np.uint64), first
    return span_hashes(data, start, stop - start), first


def span_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans of `data`; none may be empty."""
    begin = np.cumsum(length) - length
    offset = np.arange(int(length.sum())) - np.repeat(begin, length)
    # weights repeat after 4096 bytes; a second round number keeps the rounds apart
    weight = _WEIGHTS[offset & 4095]
    if len(offset) and offset.max() > 4095:
        weight = weight + (offset >> 12).astype(np.uint64) * _GOLDEN
    weight *= data[offset + np.repeat(start, length)].astype(np.uint64) + np.uint64(1)
    return mixed(np.add.reduceat(weight, begin) + length.astype(np.uint64) * _GOLDEN)


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, first = word_hashes(texts)
    n = max(0, len(h) - size + 1)
    grams = np.zeros(n, np.uint64)
    for i in range(size):
        grams = mixed(grams * np.uint64(3) + h[i : i + n] + _ROUND[i])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            x = _ROUND[b - a - 1 : b - a]
            for i in range(a, b):
                x = mixed(x * np.uint64(5) + h[i : i + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers, a row per set (zeros for an empty set)."""
    m = REGISTERS
    sizes = np.array([len(s) for s in sets])
    low = np.full((len(sets), m), np.inf)
    low[sizes == 0] = 1.0
    doc = np.repeat(np.arange(len(sets)), sizes)
    h = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    place = mixed(h ^ _GOLDEN)
    step = ((place >> np.uint64(32)) | np.uint64(1)).astype(np.int64) & (m - 1)
    place = place.astype(np.int64) & (m - 1)
    x = np.zeros(len(h))
    flat = low.reshape(-1)
    for j in range(m):
        u = (mixed(h + _ROUND[j]) >> np.uint64(11)) * 2.0**-53
        x = x - np.log1p(-u) / (m - j)
        # an element whose next value exceeds all of its set's registers is done
        bound = low.max(axis=1)
        go = x < bound[doc]
        if not go.all():
            doc, h, place, step, x = doc[go], h[go], place[go], step[go], x[go]
        if not len(doc):
            break
        np.minimum.at(flat, doc * m + place, x)
        place = (place + step) & (m - 1)
    k = np.clip(np.floor(1 - np.log(np.maximum(low, 1e-300)) / np.log(BASE)) + OFFSET, 1, 65535).astype(np.uint16)
    k[sizes == 0] = 0
    return k


def band_keys(k: np.ndarray) -> np.ndarray:
    """Rows of registers to rows of BANDS bucket keys."""
    parts = k[:, : BANDS * ROWS].reshape(len(k), BANDS, ROWS).astype(np.uint64)
    key = (parts * _BAND_WEIGHTS).sum(axis=2, dtype=np.uint64)
    return mixed(key + _ROUND[:BANDS]).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum likelihood similarity of register rows `a` and `b`, given the set sizes."""
    above = (a > b).sum(axis=1)[:, None]
    below = (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - above - below
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)
    more, less = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
    value = above * np.log(more) + below * np.log(less) + same * np.log(np.maximum(1 - more - less, 1e-12))
    return j[np.arange(len(j)), value.argmax(axis=1)]


def _chunks(values: pa.Array) -> Iterator[tuple[int, list[str]]]:
    first, held, size = 0, [], 0
    for i, v in enumerate(values):
        held.append(v.as_py() or "")
        size += len(held[-1])
        if size >= CHUNK:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _chunks(batch.column(2)):
                sets = shingle_sets(texts, size)
                digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8") for s in sets])
                rows = registers(sets)
                n = pa.array([len(s) for s in sets], pa.int64())
                keys = batch.slice(first, len(texts))
                columns = [keys.column(0), keys.column(1), n, pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([r.tobytes() for r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "own", "n", "high", "low", "regs"])

    return run


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """Per row: doc_id, own (text hash), n (set size), high and low (set digest), regs."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("own"), "text")
    return t.mapInArrow(_sketch(size), "doc_id long, own long, n long, high long, low long, regs binary")


def _bands(first: int, last: int):
    """(doc, high, lab, regs) to one row per band: key, doc, high, lab."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint16).reshape(batch.num_rows, REGISTERS)
            keys = band_keys(k)[:, first:last].reshape(-1)
            columns = [np.repeat(batch.column(i).to_numpy(zero_copy_only=False), last - first) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, columns)], names=["key", "doc", "high", "lab"])

    return run


NODE = "struct<doc:long,high:long>"


def _similar(threshold: float):
    """Rows with regs_a, regs_b, n_a, n_b: those whose estimate may reach the threshold, with the estimate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                a, b = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint16).reshape(part.num_rows, REGISTERS) for i in (2, 3))
                n_a, n_b = (part.column(i).to_numpy(zero_copy_only=False).astype("f8") for i in (4, 5))
                near = estimate(a, b, n_a, n_b)
                out = pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(near)], names=["a", "b", "near"])
                yield out.filter(pa.array(near >= threshold - MARGIN))

    return run


def _verified(size: int, percent: int):
    """Pairs with both texts: whether their full sets are similar enough, and their exact distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.add(pc.coalesce(pc.binary_length(batch.column(2)), 0), pc.coalesce(pc.binary_length(batch.column(3)), 0)).to_numpy(zero_copy_only=False)
            # about CHUNK bytes of text at a time
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows]):
                part = batch.slice(int(a), int(b - a))
                left = shingle_sets([t or "" for t in part.column(2).to_pylist()], size)
                right = shingle_sets([t or "" for t in part.column(3).to_pylist()], size)
                both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)]
                union = [len(x) + len(y) - n for x, y, n in zip(left, right, both)]
                keep = pa.array([100 * n >= percent * u for n, u in zip(both, union)], pa.bool_())
                apart = pa.array([1 - n / u for n, u in zip(both, union)], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns[:2], keep, apart], names=["a", "b", "similar", "apart"])

    return run


def connected(edges: DataFrame) -> DataFrame:
    """Components of the edges (a, b) of ordered nodes: node and its component's smallest node, `label`.

    Alternating large-star and small-star contractions; every round is written out, until each component is a
    star around its smallest node.
    """
    e = stage_table(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    while True:
        # stars, when no class hangs on two others and none that hangs on another is a centre itself
        rows = e.select(F.col("v").alias("node"), F.lit(1).alias("hangs")).unionByName(e.select(F.col("u").alias("node"), F.lit(0).alias("hangs")).distinct())
        odd = rows.groupBy("node").agg(F.sum("hangs").alias("n"), F.min("hangs").alias("least")).filter("n > 1 or n = 1 and least = 0")
        if odd.isEmpty():
            return e.select(F.col("v").alias("node"), F.col("u").alias("label"))
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m"))
        large = both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        large = stage_table(large.filter("u <> v"), "large_star")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        hung = large.join(least, "v")
        small = hung.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u")))
        e = stage_table(small.filter("u <> v").distinct(), "small_star")


ASKED = f"cell long, at int, node {NODE}, lab long, others binary"


def _cells(threshold: float):
    """One cell of a bucket, its block of classes against its block of the rest: a row per class with an undecided pair.

    `at` is the class's place in the cell, `others` the places (int32) it is to be compared with.
    """

    def run(table: pa.Table) -> pa.Table:
        rest, key, out = table["rest"].to_numpy(), table["key"][0].as_py(), table["out"].to_numpy()
        k = np.frombuffer(b"".join(table["regs"].to_pylist()), np.uint16).reshape(len(table), REGISTERS)
        label, n = table["lab"].to_numpy(), table["n"].to_numpy().astype("f8")
        leader, apart = table["leader"].to_numpy(), table["apart"].to_numpy()
        nodes = table["node"].combine_chunks()
        ids = np.stack([nodes.field(c).to_numpy() for c in ("doc", "high")], axis=1)
        # a class of both blocks has one place; places ascend with the nodes
        _, head, place = np.unique(ids, axis=0, return_index=True, return_inverse=True)
        place = place.ravel()
        bands = k[:, : BANDS * ROWS].reshape(len(k), BANDS, ROWS)
        mine = int(np.flatnonzero(band_keys(k[:1])[0] == key)[0])
        at = np.arange(len(table))
        theirs = at[~rest]
        others: dict[int, bytes] = {}
        met = np.zeros(len(head), dtype=bool)
        for i in at[rest].tolist():
            # distances to a common leader bound the distance between the two
            far = (leader[theirs] == leader[i]) & (np.abs(apart[theirs] - apart[i]) > 1 - threshold + 1e-9)
            # two classes of the rest meet in both orders, and are judged in one
            other = theirs[(label[theirs] != label[i]) & ~far & (~out[theirs] | (place[theirs] > place[i]))]
            # a pair that shares an earlier band is judged there
            other = other[~(bands[other, :mine] == bands[i, :mine]).all(axis=2).any(axis=1)]
            if len(other):
                near = estimate(k[other], np.broadcast_to(k[i], (len(other), REGISTERS)), n[other], np.full(len(other), n[i]))
                other = place[other[near >= threshold - MARGIN]]
            if len(other):
                others[place[i]] = other.astype(np.int32).tobytes()
                met[other] = met[place[i]] = True
        cell = xxhash.xxh3_64_intdigest(repr((key, table["i"][0].as_py(), table["j"][0].as_py()))) - (1 << 63)
        used = np.flatnonzero(met)
        columns = {
            "cell": pa.array(np.full(len(used), cell, dtype=np.int64)),
            "at": pa.array(used, pa.int32()),
            "node": nodes.take(pa.array(head[used])),
            "lab": pa.array(label[head[used]]),
            "others": pa.array([others.get(u, b"") for u in used.tolist()], pa.binary()),
        }
        return pa.table(columns)

    return run


def _root(parent: dict[int, int], x: int) -> int:
    while parent.setdefault(x, x) != x:
        x = parent[x]
    return x


def _cell_linked(size: int, percent: int):
    """One cell's classes with their texts: links between full sets that are similar enough.

    Links that join what is already connected, by its label or by links of this cell, are neither looked for nor returned.
    """

    def run(table: pa.Table) -> pa.Table:
        sets = []
        for _, part in _chunks(table["text"]):
            sets += shingle_sets(part, size)
        many = np.array([len(s) for s in sets])
        row = {p: i for i, p in enumerate(table["at"].to_pylist())}
        label = table["lab"].to_pylist()
        parent: dict[int, int] = {}
        left, right = [], []
        for i, others in enumerate(table["others"].to_pylist()):
            mine = _root(parent, label[i])
            rows = [row[p] for p in np.frombuffer(others, np.int32).tolist()]
            rows = np.array([j for j in rows if _root(parent, label[j]) != mine], dtype=np.int64)
            # about CHUNK shingles at a time
            cuts = np.flatnonzero(np.diff(np.cumsum(many[rows]) // CHUNK)) + 1
            for part in np.split(rows, cuts):
                if not len(part):
                    continue
                x = np.concatenate([sets[j] for j in part.tolist()])
                found = sets[i][np.minimum(np.searchsorted(sets[i], x), many[i] - 1)] == x
                both = np.add.reduceat(found, np.cumsum(many[part]) - many[part], dtype=np.int64)
                for j in part[100 * both >= percent * (many[i] + many[part] - both)].tolist():
                    one, two = _root(parent, label[i]), _root(parent, label[j])
                    if one != two:
                        parent[max(one, two)] = min(one, two)
                        left.append(i)
                        right.append(j)
        nodes = table["node"].combine_chunks()
        return pa.table({"a": nodes.take(pa.array(left, pa.int64())), "b": nodes.take(pa.array(right, pa.int64()))})

    return run


def _cell_verified(size: int, percent: int):
    """One cell's texts and its pairs: the pairs whose full sets are similar enough. A text's set is made once."""

    def run(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        at = {(n["doc"], n["high"]): i for i, n in enumerate(texts["node"].to_pylist())}
        sets = []
        for _, part in _chunks(texts["text"]):
            sets += shingle_sets(part, size)
        similar = []
        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()):
            x, y = (sets[at[n["doc"], n["high"]]] for n in (a, b))
            both = len(np.intersect1d(x, y, assume_unique=True))
            similar.append(100 * both >= percent * (len(x) + len(y) - both))
        return pairs.select(["a", "b"]).filter(pa.array(similar, pa.bool_()))

    return run


class _Links:
    """The verified links between classes, found step by step."""

    def __init__(self, docs: DataFrame, classes: DataFrame, size: int, percent: int):
        self.docs, self.classes, self.size, self.percent = docs, classes, size, percent
        self.threshold = percent / 100

    def likely(self, pairs: DataFrame) -> DataFrame:
        """(a, b, near) of the pairs whose estimate may reach the threshold."""
        c = self.classes.select("node", "n", "regs")
        p = pairs.join(c.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("regs").alias("regs_a")), "a")
        p = p.join(c.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("regs").alias("regs_b")), "b")
        p = p.select("a", "b", "regs_a", "regs_b", "n_a", "n_b").mapInArrow(_similar(self.threshold), f"a {NODE}, b {NODE}, near double")
        return stage_table(p, "likely")

    def texts(self, need: DataFrame) -> DataFrame:
        """The texts of the classes in `need`, written once: node, text."""
        need = stage_table(need.join(self.classes.select("node", "own"), "node"), "needed")
        if need.count() <= NEEDED_ROWS:
            need = F.broadcast(need)
        d = self.docs.select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_own"), "text")
        found = d.join(need, (F.col("_doc") == F.col("node.doc")) & (F.col("_own") == F.col("own")))
        return stage_table(found.select("node", "text"), "texts")

    def judged(self, pairs: DataFrame) -> DataFrame:
        """(a, b, similar, apart) of every pair, from the full sets."""
        texts = self.texts(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        p = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        p = p.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        run = _verified(self.size, self.percent)
        types = f"a {NODE}, b {NODE}, similar boolean, apart double"
        return stage_text(p.select("a", "b", "text_a", "text_b").mapInArrow(run, types), "judged")

    def similar_in_cells(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of the similar pairs of (a, b, cell): a text goes to its cells once, however many pairs it has there."""
        need = pairs.select(F.explode(F.array("a", "b")).alias("node"), F.col("cell").alias("place")).distinct()
        texts = need.join(self.texts(need.select("node").distinct()), "node").select("place", "node", "text")
        found = texts.groupBy("place").cogroup(pairs.groupBy("cell")).applyInArrow(_cell_verified(self.size, self.percent), f"a {NODE}, b {NODE}")
        return stage_text(found, "similar")

    def linked_in_cells(self, asked: DataFrame) -> DataFrame:
        """Links (a, b) among the undecided pairs of cells (ASKED): a text goes to its cells once, however many pairs it has there."""
        rows = asked.join(self.texts(asked.select("node").distinct()), "node").select("cell", "at", "node", "lab", "others", "text")
        return stage_text(rows.groupBy("cell").applyInArrow(_cell_linked(self.size, self.percent), f"a {NODE}, b {NODE}"), "linked")

    def judged_best(self, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Each class's leader with the most shared bands, the smallest on a tie: these pairs, and their judgement."""
        best = F.min(F.struct((-F.col("shared")).alias("fewest"), F.col("a")))
        best = stage_table(pairs.groupBy("b").agg(best.alias("best")).select(F.col("best.a").alias("a"), "b"), "best")
        return best, self.judged(self.likely(best))


def _labelled(rows: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    t = labels.select(F.col("node").alias(node), F.col("label").alias(label))
    return rows.join(t, node, "left").withColumn(label, F.coalesce(label, node))


def _open_members(entries: DataFrame) -> DataFrame:
    """The rows (key, node, lab) of buckets that hold several labels."""
    spread = entries.groupBy("key").agg(F.min("lab").alias("low"), F.max("lab").alias("high_"))
    return entries.join(spread.filter("low <> high_").select("key"), "key")


def class_links(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Verified links (a, b) that connect the classes of similar sets."""
    find = _Links(docs, classes, size, percent)
    rows = classes.select("node", "node.doc", "node.high", "regs")
    types = "key long, doc long, high long, lab long"

    # the first bands
    few = rows.select("doc", "high", F.lit(0).cast("long").alias("lab"), "regs").mapInArrow(_bands(0, FIRST), types)
    few = few.select("key", F.struct("doc", "high").alias("node"), "lab")
    lead = few.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    pairs = few.join(lead, "key").filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    tried, first = find.judged_best(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")))
    links = first.filter("similar").select("a", "b")
    # all bands, where buckets hold several components
    lab = F.xxhash64("label.doc", "label.high").alias("lab")
    named = _labelled(rows, connected(links), "node", "label").select("doc", "high", lab, "regs")
    entries = named.mapInArrow(_bands(0, BANDS), types).select("key", F.struct("doc", "high").alias("node"), "lab")
    members = stage_table(_open_members(entries), "members")
    # classes outside a bucket's largest component meet the smallest class of that component
    groups = members.groupBy("key", "lab").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader"))
    main = groups.groupBy("key").agg(F.max(F.struct("n", "lab", "leader")).alias("m"), (F.sum("n") == 2).alias("two"))
    pairs = members.join(main, "key").filter("lab <> m.lab")
    pairs = pairs.select(F.least("m.leader", "node").alias("a"), F.greatest("m.leader", "node").alias("b"), "two", F.lit(1).alias("new"))
    pairs = pairs.unionByName(tried.select("a", "b", F.lit(False).alias("two"), F.lit(0).alias("new")))
    pairs = pairs.groupBy("a", "b").agg(F.sum("new").alias("shared"), F.max("two").alias("two"), F.min("new").alias("untried"))
    pairs = stage_table(pairs.filter("untried = 1").drop("untried"), "pairs")
    best, second = find.judged_best(pairs)
    tried = tried.unionByName(best)
    links = links.unionByName(second.filter("similar").select("a", "b"))
    labels = connected(links)
    # the rest: buckets that still hold several components
    inside = _labelled(members.select("key", "node"), labels, "node", "label").select("key", "node", lab)
    inside = stage_table(_open_members(inside), "rest")
    spread = inside.groupBy("key", "lab").agg(F.count(F.lit(1)).alias("n"))
    spread = spread.groupBy("key").agg(F.max_by("lab", F.struct("n", "lab")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    # the only pair of a bucket of two is among `pairs`; larger buckets are gone through cell by cell
    open_keys = stage_table(spread.filter("all > 2"), "open")
    leaders = first.unionByName(second).groupBy(F.col("b").alias("node")).agg(F.min(F.struct("apart", "a")).alias("l"))
    leaders = leaders.select("node", F.xxhash64("l.a.doc", "l.a.high").alias("leader"), F.col("l.apart").alias("apart"))
    known = inside.select("node").distinct().join(classes.select("node", "n", "regs"), "node").join(leaders, "node", "left")
    own = F.xxhash64("node.doc", "node.high")
    known = known.select("node", "n", "regs", F.coalesce("leader", own).alias("leader"), F.coalesce("apart", F.lit(0.0)).alias("apart"))
    m = inside.join(open_keys, "key").join(stage_table(known, "known"), "node")
    blocks, rest_blocks = F.ceil(F.col("all") / BLOCK), F.ceil((F.col("all") - F.col("most")) / BLOCK)
    zero = F.lit(0).cast("long")
    m = m.withColumn("out", F.col("lab") != F.col("main"))
    as_member = m.withColumn("i", F.pmod(own, blocks)).withColumn("j", F.explode(F.sequence(zero, rest_blocks - 1))).withColumn("rest", F.lit(False))
    as_rest = m.filter("out").withColumn("j", F.pmod(own, rest_blocks)).withColumn("i", F.explode(F.sequence(zero, blocks - 1))).withColumn("rest", F.lit(True))
    cells = as_member.unionByName(as_rest).select("key", "i", "j", "node", "lab", "n", "regs", "leader", "apart", "rest", "out")
    asked = stage_table(cells.groupBy("key", "i", "j").applyInArrow(_cells(percent / 100), ASKED), "asked")
    links = links.unionByName(find.linked_in_cells(asked))
    apart = pairs.filter("two").select("a", "b").join(best, ["a", "b"], "left_anti")
    apart = _labelled(_labelled(apart, labels, "a", "la"), labels, "b", "lb").filter("la <> lb").select("a", "b")
    # a class has at most a pair per band here
    apart = find.likely(apart).select("a", "b", F.xxhash64("a.doc", "a.high").alias("cell"))
    return links.unionByName(find.similar_in_cells(apart))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, own (text hash), n_shingles, component_id, kept."""
    t = stage_text(sketches(docs, size), "sketches")
    classes = t.filter("doc_id is not null and n > 0").groupBy("high", "low").agg(F.min(F.struct("doc_id", "own", "n", "regs")).alias("c"))
    node = F.struct(F.col("c.doc_id").alias("doc"), F.col("high"))
    classes = stage_table(classes.select(node.alias("node"), "high", "low", "c.own", "c.n", "c.regs"), "classes")
    labels = connected(class_links(docs, classes, size, percent))
    named = classes.select("high", "low", "node").join(labels, "node", "left")
    named = named.select("high", "low", F.coalesce("label.doc", "node.doc").alias("component"))
    rows = t.select("doc_id", "own", "n", "high", "low").join(named, ["high", "low"], "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component"))
    return rows.select("doc_id", "own", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def kept_documents(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each group; the columns stay.

    Here a document is an id, null included, with a text: documents are numbered by both, null ids last, and
    linked by number. The smallest of a group stays, once however often its row is repeated.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("own"))
    named = rows.groupBy(F.col("id").alias("of"), F.col("own").alias("hash")).agg(F.count(F.lit(1)).alias("copies"))
    named = stage_table(numbered(named, [F.col("of").asc_nulls_last(), F.col("hash")], "nr"), "named")
    on = F.col("id").eqNullSafe(F.col("of")) & (F.col("own") == F.col("hash"))
    texts = stage_table(rows.join(named, on).select(F.col("nr").cast("long").alias("doc_id"), F.col("row.text").alias("text")), "texts")
    kept = near_duplicates(texts, size, percent).filter("kept").select(F.col("doc_id").alias("nr")).distinct()
    found = rows.join(stage_table(named.join(kept, "nr"), "kept"), on)
    several = found.filter("copies > 1").groupBy("id", "own").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return found.filter("copies = 1").select("row.*").unionByName(several.select("row.*"))
