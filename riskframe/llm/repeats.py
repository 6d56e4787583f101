"""Exact removal of long repeated byte strings by a hash-compared suffix sort.

Every byte covered by a `WIDTH`-byte string that also starts anywhere else is found, in the same document or
another. A window of that width is named by its anchor, the leftmost of its k-grams with the smallest hash:
equal windows have equal anchors at equal offsets. So windows only ever meet under their anchor's hash.

1. One pass cuts each document into segments, runs of windows with the same anchor, and emits the anchor's
   hash and a digest of the segment, not its text. Equal segments form a class; a class with two members or
   more is removed whole, and however many copies there are, one member stands for it from here on.
2. Under an anchor hash with several classes, the members' texts are suffix-sorted: the text right of the
   anchor, and the text left of it backwards. Prefix polynomial hashes make any two prefixes comparable in one
   step, a binary search over the length finds the common extension of two suffixes, and a bottom-up mergesort
   orders them with a logarithmic number of comparisons. Common extensions of sorted neighbours are checked
   on the bytes; if a hash collided, the sort is repeated with another base. A window that reaches L bytes
   left of its anchor is repeated if another member agrees with it on L bytes left and WIDTH - L right, which is
   read from the two sorted orders.
3. Hashes with more than `GROUP` classes (the rims of a passage that very many documents share) do not fit in one
   sort. They are cut into pieces of `PIECE` windows; a piece whose common core occurs once is dropped, and the
   windows of the others are counted by digest. That is exact as well, and every count is combined before
   its shuffle, so no key gathers in one task.

Defined results: null and empty texts and texts shorter than WIDTH bytes are kept; rows that repeat an id and a
text are copies of each other; null ids are handled as an id of their own; an empty table gives no rows;
extra columns are ignored. Digests of segments and windows are 128 bits, taken under their anchor's 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from riskframe.llm.common import stage_text
from riskframe.session import stage_table

WIDTH = 400
GRAM = 32
GROUP = 2048
PIECE = 32
NULL_ID = -(2**63)
#: Bytes handled at a time; positions below it fit in the low bits of a hash.
CHUNK = 1 << 20
#: Members sorted together, unless one hash has more.
BATCH = 2048
_SPREAD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position, by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    for i, c in enumerate(_SPREAD):
        step = 1 << i
        h = h[:-step] * c + h[step:]
        h ^= h >> np.uint64(29)
        h *= _SPREAD[i - 1]
        h ^= h >> np.uint64(32)
    return h


def segments(data: np.ndarray, ends: np.ndarray, width: int):
    """Runs of windows with the same anchor: anchor position, its hash, first and last window start.

    `data` holds texts that end at `ends`; windows do not cross texts.
    """
    none = (np.zeros(0, np.int64),) * 4
    if len(data) < width:
        return none
    h = gram_hashes(data)
    span = width - GRAM + 1
    low = np.uint64(CHUNK * 2 - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    size = -(-len(key) // span) * span
    padded = np.full(size, np.uint64(2**64 - 1))
    padded[: len(key)] = key
    grid = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(data) - width + 1
    anchor = (np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & low).astype(np.int64)
    starts = np.arange(n)
    begin = np.r_[0, ends[:-1]]
    stop_of = np.repeat(ends, ends - begin)[:n]
    starts = starts[starts + width <= stop_of]
    if not len(starts):
        return none
    anchor = anchor[starts]
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    first, last = np.r_[0, cut], np.r_[cut, len(starts)] - 1
    return anchor[first], h[anchor[first]].view(np.int64), starts[first], starts[last]


def _chunks(raws: list[bytes], width: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts of about CHUNK bytes: row numbers, offsets inside the row's text, bytes. Longer texts are cut with overlap."""
    rows, offsets, held, size = [], [], [], 0
    for i, raw in enumerate(raws):
        if len(raw) < width:
            continue
        for at in range(0, len(raw) - width + 1, CHUNK - width):
            part = raw[at : at + CHUNK - 1] if len(raw) >= CHUNK else raw
            if size + len(part) >= CHUNK:
                yield rows, offsets, held
                rows, offsets, held, size = [], [], [], 0
            rows.append(i)
            offsets.append(at)
            held.append(part)
            size += len(part)
            if len(raw) < CHUNK:
                break
    if held:
        yield rows, offsets, held


def _digest(part: bytes, lead: int) -> bytes:
    return xxhash.xxh3_128_digest(part, seed=lead)


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [(t or "").encode() for t in batch.column(2).to_pylist()]
            doc, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for rows, offsets, held in _chunks(raws, width):
                data = b"".join(held)
                ends = np.cumsum([len(x) for x in held])
                a, h, s0, s1 = segments(np.frombuffer(data, np.uint8), ends, width)
                if not len(a):
                    continue
                which = np.searchsorted(ends, s0, side="right")
                shift = np.array(offsets)[which] - np.r_[0, ends[:-1]][which]
                row = np.array(rows)[which]
                digests = b"".join([_digest(data[x : y + width], z - x) for x, y, z in zip(s0.tolist(), s1.tolist(), a.tolist())])
                w = np.frombuffer(digests, "<i8").reshape(-1, 2)
                columns = [h, w[:, 0].copy(), w[:, 1].copy(), doc[row], own[row], *((x + shift).astype("i4") for x in (a, s0, s1))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["hash", "w1", "w2", "doc", "own", "a", "s0", "s1"])

    return run


KEYS = ["hash", "w1", "w2"]


def prefix_hashes(m: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes, modulo 2**64, of all prefixes of the rows."""
    powers = np.cumprod(np.r_[np.uint64(1), np.full(m.shape[1] - 1, np.uint64(base))])
    out = np.zeros((len(m), m.shape[1] + 1), np.uint64)
    np.cumsum((m.astype(np.uint64) + np.uint64(1)) * powers, axis=1, out=out[:, 1:])
    return out


def common(prefix: np.ndarray, length: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Length of the common extension of rows p and q, by binary search over prefix hashes."""
    lo, hi = np.zeros(len(p), np.int64), np.minimum(length[p], length[q])
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi + 1) // 2
        same = prefix[p, mid] == prefix[q, mid]
        lo, hi = np.where(open_ & same, mid, lo), np.where(open_ & ~same, mid - 1, hi)


def suffix_order(m: np.ndarray, length: np.ndarray, begin: np.ndarray, size: np.ndarray, base: int):
    """Mergesort of the rows inside their groups: the order, and each row's extension with the one before it.

    Groups are runs of `size` rows from `begin`; every level merges sorted runs pairwise, all groups at once, by
    finding each row's place in the other run.
    """
    prefix = prefix_hashes(m, base)
    n = len(m)
    order = np.arange(n)
    group = np.repeat(np.arange(len(begin)), size)
    at, first, total = np.arange(n) - begin[group], begin[group], size[group]

    def less(p, q):
        k = common(prefix, length, p, q)
        end_p, end_q = k >= length[p], k >= length[q]
        left = m[p, np.minimum(k, m.shape[1] - 1)]
        right = m[q, np.minimum(k, m.shape[1] - 1)]
        # a suffix that ends is smaller; equal ones are neither
        return np.where(end_q, False, np.where(end_p, True, left < right))

    run = 1
    while run < size.max(initial=0):
        mine = at // run
        other = mine ^ 1
        lo = np.minimum(other * run, total)
        hi = np.minimum(lo + run, total)
        start = lo.copy()
        even = mine % 2 == 0
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            x, y = order[open_], order[first[open_] + mid]
            # rows of the left run go before equal rows of the right run
            before = np.where(even[open_], less(y, x), ~less(x, y))
            lo[open_] = np.where(before, mid + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], mid)
        place = first + np.minimum(mine, other) * run + (at - mine * run) + (lo - start)
        order[place] = order.copy()
        run *= 2
    shared = np.zeros(n, np.int64)
    inner = np.flatnonzero(at > 0)
    shared[inner] = common(prefix, length, order[inner - 1], order[inner])
    # collision verification: the bytes agree up to the extension, and differ or end there
    p, q = order[inner - 1], order[inner]
    cols = np.arange(m.shape[1])
    ok = ((m[p] == m[q]) | (cols >= shared[inner][:, None])).all(axis=1)
    k = np.minimum(shared[inner], m.shape[1] - 1)
    ends = (shared[inner] >= length[p]) | (shared[inner] >= length[q])
    ok &= ends | (m[p, k] < m[q, k])
    return order, shared, bool(ok.all())


def _padded(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(x) for x in parts])
    size = max(1, int(length.max()))
    return np.frombuffer(b"".join(x.ljust(size, b"\0") for x in parts), np.uint8).reshape(len(parts), size), length


def repeated_offsets(parts: list[bytes], lead: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int):
    """For members grouped by anchor hash: member, and first and last offset L of each run of repeated windows.

    A member is a segment; its anchor lies `lead` bytes after its start. The window at offset L starts L bytes
    before the anchor.
    """
    n = len(parts)
    right, right_len = _padded([x[a:] for x, a in zip(parts, lead.tolist())])
    left, left_len = _padded([x[:a][::-1] for x, a in zip(parts, lead.tolist())])
    sorted_ = []
    for m, length in ((right, right_len), (left, left_len)):
        base = 0x5851F42D4C957F2D
        while True:
            order, shared, sound = suffix_order(m, length, begin, size, base)
            if sound:
                break
            base = base * 3 + 2  # odd again
        sorted_.append((order, shared))
    (by_right, ext_right), (by_left, ext_left) = sorted_
    new = np.zeros(n, dtype=bool)
    new[begin] = True
    most = lead  # the segment's first window
    least = lead - (np.array([len(x) for x in parts]) - width)
    members, offsets = [], []
    rid, lid = np.empty(n, np.int64), np.empty(n, np.int64)
    for offset in range(int(least.min()), int(most.max()) + 1):
        here = np.flatnonzero((least <= offset) & (offset <= most))
        if len(here) < 2:
            continue
        rid[by_right] = np.cumsum(new | (ext_right < width - offset))
        lid[by_left] = np.cumsum(new | (ext_left < offset))
        key = rid[here] * (n + 1) + lid[here]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        again = here[by[np.r_[False, same] | np.r_[same, False]]]
        members.append(again)
        offsets.append(np.full(len(again), offset))
    if not sum(map(len, members)):
        return (np.zeros(0, np.int64),) * 3
    member, offset = np.concatenate(members), np.concatenate(offsets)
    by = np.lexsort((offset, member))
    member, offset = member[by], offset[by]
    cut = np.flatnonzero((member[1:] != member[:-1]) | (offset[1:] != offset[:-1] + 1)) + 1
    first, last = np.r_[0, cut], np.r_[cut, len(member)] - 1
    return member[first], offset[first], offset[last]


def _sorted_groups(width: int):
    """Members sorted by anchor hash to the repeated offset runs of each class."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        h, w1, w2 = (t[c].to_numpy() for c in KEYS)
        # a repeated row brings its members twice
        again = (h[1:] == h[:-1]) & (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])
        if again.any():
            t = t.filter(pa.array(np.r_[True, ~again]))
            h = t["hash"].to_numpy()
        begin = np.r_[0, np.flatnonzero(h[1:] != h[:-1]) + 1]
        size = np.diff(np.r_[begin, len(h)])
        member, first, last = repeated_offsets(t["part"].to_pylist(), t["lead"].to_numpy().astype("i8"), begin, size, width)
        keys = [t[c].to_numpy()[member] for c in KEYS]
        return pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array(first.astype("i4")), pa.array(last.astype("i4"))], names=[*KEYS, "l0", "l1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
            while sum(len(x) for x in held) >= BATCH:
                t = pa.concat_tables(held)
                h = t["hash"].to_numpy()
                cuts = np.flatnonzero(h[1:] != h[:-1]) + 1
                if not len(cuts):
                    break
                # whole groups only: the last one may go on
                at = int(cuts[min(len(cuts) - 1, np.searchsorted(cuts, BATCH))])
                yield solve(t.slice(0, at))
                held = [t.slice(at)]
        if held:
            t = pa.concat_tables(held)
            if len(t):
                yield solve(t)

    return run


def _members(width: int):
    """(text, spots) to one row per segment: the class key, its bytes and the anchor's place in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, spots in zip(batch.column(0), batch.column(1)):
                raw, rows = text.as_py().encode(), spots.as_py()
                for i in range(0, len(rows), 2000):
                    part = rows[i : i + 2000]
                    columns = [pa.array([r[c] for r in part], pa.int64()) for c in KEYS]
                    cut = pa.array([raw[r["s0"] : r["s1"] + width] for r in part], pa.binary())
                    lead = pa.array([r["a"] - r["s0"] for r in part], pa.int32())
                    yield pa.RecordBatch.from_arrays([*columns, cut, lead], names=[*KEYS, "part", "lead"])

    return run


def _pieces(width: int):
    """Segments to pieces: the windows with offsets in [PIECE * i, PIECE * (i + 1)), and the core all of them share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, w1, w2, part, lead in zip(*(c.to_pylist() for c in batch.columns)):
                for i in range((lead - len(part) + width) // PIECE, lead // PIECE + 1):
                    l0, l1 = max(PIECE * i, lead - len(part) + width), min(PIECE * (i + 1) - 1, lead)
                    # what all windows of the piece share lies in every segment that has one of them
                    core = part[lead - PIECE * i : lead - (PIECE * (i + 1) - 1) + width]
                    out.append((h, w1, w2, i, _digest(core, 0), part[lead - l1 : lead - l0 + width], l0, l1))
            if out:
                arrays = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 3 + [pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32()])]
                yield pa.RecordBatch.from_arrays(arrays, names=[*KEYS, "piece", "core", "part", "l0", "l1"])

    return run


def _windows(width: int):
    """Pieces to one digest per window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, w1, w2, part, l0, l1 in zip(*(c.to_pylist() for c in batch.columns)):
                for offset in range(l0, l1 + 1):
                    out.append((h, w1, w2, offset, _digest(part[l1 - offset : l1 - offset + width], offset)))
                if len(out) >= 50_000:
                    yield _window_rows(out)
                    out = []
            if out:
                yield _window_rows(out)

    return run


def _window_rows(out: list[tuple]) -> pa.RecordBatch:
    arrays = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 3 + [pa.int32(), pa.binary()])]
    return pa.RecordBatch.from_arrays(arrays, names=[*KEYS, "l0", "window"])


def spans(docs: DataFrame, width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """Runs of repeated windows: doc, own (text hash), and the byte range [start, stop) they cover."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc")
    d = docs.select(doc, F.xxhash64("text").alias("own"), "text")
    t = d.mapInArrow(_cut(width), "hash long, w1 long, w2 long, doc long, own long, a int, s0 int, s1 int")
    t = stage_text(t, "segments")
    place = F.struct("doc", "own", "a", "s0", "s1")
    classes = t.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("at"))
    parts = classes.groupBy("hash").agg(F.count(F.lit(1)).alias("classes"), F.sum("copies").alias("rows")).filter("rows > 1")
    classes = stage_table(classes.join(parts, "hash").drop("rows"), "classes")
    whole = t.join(classes.filter("copies > 1").select(*KEYS), KEYS, "left_semi")
    found = whole.select("doc", "own", F.col("s0").alias("start"), (F.col("s1") + width).alias("stop"))
    # members of hashes with several classes, with their bytes
    many = classes.filter("classes > 1")
    spots = many.select(F.col("at.doc").alias("doc"), F.col("at.own").alias("own"), F.struct(*KEYS, "at.a", "at.s0", "at.s1").alias("s"))
    spots = spots.groupBy("doc", "own").agg(F.collect_list("s").alias("spots"))
    texts = d.join(spots, ["doc", "own"])
    members = texts.select("text", "spots").mapInArrow(_members(width), "hash long, w1 long, w2 long, part binary, lead int")
    members = stage_text(members, "members", rows=100)
    large = stage_table(many.filter(F.col("classes") > group).select("hash").distinct(), "large")
    usual = members.join(large, "hash", "left_anti").select(*KEYS, "part", "lead")
    usual = usual.repartition("hash").sortWithinPartitions(*KEYS).mapInArrow(_sorted_groups(width), "hash long, w1 long, w2 long, l0 int, l1 int")
    hot = members.join(large, "hash", "left_semi").select(*KEYS, "part", "lead").dropDuplicates(KEYS)
    pieces = hot.mapInArrow(_pieces(width), "hash long, w1 long, w2 long, piece int, core binary, part binary, l0 int, l1 int")
    pieces = stage_table(pieces, "pieces")
    again = pieces.groupBy("hash", "piece", "core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    pieces = pieces.join(again, ["hash", "piece", "core"], "left_semi").select(*KEYS, "part", "l0", "l1")
    windows = stage_table(pieces.mapInArrow(_windows(width), "hash long, w1 long, w2 long, l0 int, window binary"), "windows")
    again = windows.groupBy("hash", "l0", "window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    single = windows.join(again, ["hash", "l0", "window"], "left_semi").select(*KEYS, "l0", F.col("l0").alias("l1"))
    runs = stage_table(usual.unionByName(single), "offsets")
    # one join on the large side, which Spark can split where a class is large
    runs = runs.join(classes.filter("classes > 1 and copies = 1").select(*KEYS), KEYS, "left_semi")
    some = t.join(stage_table(runs, "single"), KEYS)
    some = some.select("doc", "own", (F.col("a") - F.col("l1")).alias("start"), (F.col("a") - F.col("l0") + width).alias("stop"))
    return found.unionByName(some)


APPLIED = T.StructType().add("kept", "binary").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")


@F.pandas_udf(APPLIED)
def _apply(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
    rows = []
    for text, ranges in zip(texts, found):
        raw = (text or "").encode()
        parts, at, removed, n = [], 0, 0, 0
        end = -1
        for r in sorted((x["start"], x["stop"]) for x in ranges) if ranges is not None else ():
            if r[0] > end:
                parts.append(raw[max(at, 0) : r[0]])
                n += 1
                removed += r[1] - r[0]
                end = r[1]
            elif r[1] > end:
                removed += r[1] - end
                end = r[1]
            at = end
        parts.append(raw[at:])
        rows.append((b"".join(parts), len(raw), removed, n))
    return pd.DataFrame(rows, columns=["kept", "n_bytes", "n_removed", "n_spans"])


def remove_repeats(docs: DataFrame, width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """Per row: doc_id, kept (the remaining bytes), n_bytes, n_removed, n_spans."""
    per = spans(docs, width, group).groupBy("doc", "own").agg(F.collect_set(F.struct("start", "stop")).alias("found"))
    per = stage_table(per, "spans")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc")
    d = docs.select("doc_id", doc, F.xxhash64("text").alias("own"), "text")
    d = d.join(per, ["doc", "own"], "left").select("doc_id", _apply("text", "found").alias("r"))
    return d.select("doc_id", "r.*")



def repeat_table(docs: DataFrame) -> DataFrame:
    d = remove_repeats(docs.select("doc_id", "text"))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
