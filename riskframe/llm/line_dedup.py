"""Line dedup: range-partitioned line hashes, secondary sort, keep bitmaps per document.

A line's key is the line stripped of ASCII blanks at both ends with A-Z lower-cased. A key of at least
`min_chars` code points that is found in at least `min_docs` documents keeps its lines only in the
largest doc_id that holds it. Keys travel as 128-bit hashes, never as text.

The (hash, document, position) entries are range-partitioned by hash and document and sorted by hash,
document (largest first) and position; each partition streams over its runs. The partition ranges cut
inside a hot line's run, so a line found in a third of all documents is spread like any other. Only the
first and the last run of a partition can be cut; their figures are merged across partitions (two rows a
partition) and joined back. What leaves the streams is the dropped positions, folded into one compressed
bitmap per document; the text is touched again only where the bitmaps are applied.

Defined results: null or empty text is one empty line and is kept; null ids sort below all others and are
one document; rows that repeat an id are one document for counting and keep their own lines; extra
columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from riskframe.llm.common import stage_text
from riskframe.session import stage_table

MIN_CHARS = 40
MIN_DOCS = 5
BLANKS = b" \t\n\v\f\r"
ROWS = 50_000
NULL_ID = -(2**63)
APPLIED = T.StructType().add("kept", "string").add("n_lines", "long").add("n_dropped", "long")


def _digest(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text)


def _entries(min_chars: int):
    """Batches of (doc_id, own, text) to (high, low, doc, own, pos) for every line whose key is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = (text.as_py() or "").encode()
                for pos, line in enumerate(raw.split(b"\n")):
                    if len(line) < min_chars:
                        continue
                    key = line.strip(BLANKS).lower()
                    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
                        continue
                    out.append((_digest(key), NULL_ID if doc is None else doc, own, pos))
                if len(out) >= ROWS:
                    yield _pack(out)
                    out = []
            if out:
                yield _pack(out)

    return run


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    keys, docs, own, pos = zip(*rows)
    high_low = np.frombuffer(b"".join(keys), dtype=">i8").astype("i8").reshape(-1, 2)
    arrays = [high_low[:, 0].copy(), high_low[:, 1].copy(), *(np.array(x, dtype="i8") for x in (docs, own)), np.array(pos, dtype="i4")]
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["high", "low", "doc", "own", "pos"])


def _runs(min_docs: int):
    """Sorted entries of one partition to rows of two kinds.

    Kind 0: an entry to drop. Kind 1: an entry of a run that the partition's bounds may have cut, left open.
    Kind 2: the figures of such a run: documents (in `own`), the smallest in `pos`'s place as `last`.
    The entries of a run are held until it ends; no run is larger than its partition.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None  # high, low, docs, largest, last doc, entries held, open at the start
        for batch in parts:
            n = batch.num_rows
            if not n:
                continue
            high, low, doc, own, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            cut = np.flatnonzero((high[1:] != high[:-1]) | (low[1:] != low[:-1])) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, n]
            out: list[tuple] = []
            # a run inside the batch with fewer entries than documents needed drops nothing
            seen = ends - starts >= min_docs
            seen[[0, -1]] = True
            for a, b in zip(starts[seen].tolist(), ends[seen].tolist()):
                key = (high[a], low[a])
                if state is None or state["key"] != key:
                    if state is not None:
                        out.extend(_close(state, min_docs))
                    state = {"key": key, "docs": 0, "largest": doc[a], "last": None, "held": [], "open": state is None}
                d = doc[a:b]
                new = 1 + int((d[1:] != d[:-1]).sum()) - int(state["last"] == d[0])
                state["docs"] += new
                state["last"] = d[-1]
                if state["open"]:
                    out.append(_open_rows(key, d, own[a:b], pos[a:b]))
                else:
                    # copies: a view would keep the whole batch alive
                    state["held"].append((d.copy(), own[a:b].copy(), pos[a:b].copy()))
            if out:
                yield _table(out)
        if state is not None:
            # the last run may go on in the next partition
            out = []
            if not state["open"]:
                out = [_open_rows(state["key"], *h) for h in state["held"]]
            out.append(_summary(state))
            yield _table(out)

    return run


COLUMNS = ["kind", "high", "low", "doc", "own", "pos", "docs"]


def _open_rows(key, doc, own, pos) -> tuple:
    n = len(doc)
    return (np.full(n, 1, "i4"), np.full(n, key[0]), np.full(n, key[1]), doc, own, pos, np.zeros(n, "i8"))


def _summary(state) -> tuple:
    one = lambda x, kind="i8": np.array([x], dtype=kind)
    # largest: entries come largest document first
    return (one(2, "i4"), one(state["key"][0]), one(state["key"][1]), one(state["largest"]), one(state["last"]), one(0, "i4"), one(state["docs"]))


def _drops(state) -> list[tuple]:
    out = []
    for doc, own, pos in state["held"]:
        gone = doc != state["largest"]
        n = int(gone.sum())
        if n:
            out.append((np.zeros(n, "i4"), np.full(n, state["key"][0]), np.full(n, state["key"][1]), doc[gone], own[gone], pos[gone], np.zeros(n, "i8")))
    state["held"] = []
    return out


def _close(state, min_docs: int) -> list[tuple]:
    if state["open"]:
        return [_summary(state)]
    return _drops(state) if state["docs"] >= min_docs else []


def _table(parts: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=COLUMNS)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per line to drop: doc, own (hash of the document's text) and pos (0-based)."""
    entry = "high long, low long, doc long, own long, pos int"
    t = stage_text(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("own"), "text").mapInArrow(_entries(min_chars), entry), "lines")
    order = [F.col("high"), F.col("low"), F.col("doc").desc(), F.col("own"), F.col("pos")]
    t = t.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = "kind int, high long, low long, doc long, own long, pos int, docs long"
    t = stage_table(t.mapInArrow(_runs(min_docs), rows), "runs")
    # a document whose entries span two partitions is counted by both: take the shared end off
    s = t.filter("kind = 2").select("high", "low", F.col("doc").alias("top"), F.col("own").alias("bottom"), "docs")
    pieces = s.groupBy("high", "low").agg(
        F.max("top").alias("largest"), F.sum("docs").alias("docs"),
        F.sort_array(F.collect_list(F.struct("top", "bottom")), asc=False).alias("p"),  # a row per partition it spans
    )
    shared = F.aggregate(
        F.sequence(F.lit(0), F.size("p") - 1), F.lit(0),
        lambda a, i: a + F.when((i > 0) & (F.get(F.col("p"), i - 1)["bottom"] == F.get(F.col("p"), i)["top"]), 1).otherwise(0),
    )
    pieces = stage_table(pieces.select("high", "low", "largest").where((F.col("docs") - shared) >= min_docs), "cut_runs")
    late = t.filter("kind = 1").join(pieces, ["high", "low"]).filter("doc <> largest").select("doc", "own", "pos")
    return t.filter("kind = 0").select("doc", "own", "pos").unionByName(late)


@F.pandas_udf(T.BinaryType())
def _bitmap(positions: pd.Series) -> pd.Series:
    """Sorted distinct positions to a compressed bitmap; bit i is set when line i is dropped."""

    def pack(p):
        bits = np.zeros(int(p[-1]) + 1, dtype=bool)
        bits[p] = True
        return zlib.compress(np.packbits(bits).tobytes(), 1)

    return positions.map(lambda p: pack(np.sort(np.asarray(p))))


def _apply(texts: pa.Array, bitmaps: pa.Array) -> pa.Array:
    """Texts without the lines set in their bitmaps; a null bitmap gives null."""
    kept, lines, dropped = [], [], []
    for text, bits in zip(texts, bitmaps):
        bits = bits.as_py()
        if bits is None:
            kept.append(None), lines.append(None), dropped.append(None)
            continue
        mask = np.unpackbits(np.frombuffer(zlib.decompress(bits), dtype="u1"))
        parts = (text.as_py() or "").split("\n")
        stays = [x for i, x in enumerate(parts) if i >= len(mask) or not mask[i]]
        kept.append("\n".join(stays))
        lines.append(len(parts))
        dropped.append(len(parts) - len(stays))
    columns = [pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
    return pa.StructArray.from_arrays(columns, ["kept", "n_lines", "n_dropped"])


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per document with dropped lines: doc, own and the compressed bitmap of its dropped lines."""
    gone = dropped_lines(docs, min_chars, min_docs)
    return gone.groupBy("doc", "own").agg(F.collect_set("pos").alias("pos")).select("doc", "own", _bitmap("pos").alias("bits"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per row: `row` (all columns of `docs`), `kept` (its remaining text), `n_lines` and `n_dropped`."""
    bits = stage_table(keep_bitmaps(docs, min_chars, min_docs), "bitmaps")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    d = docs.select(F.struct(*docs.columns).alias("row"), doc.alias("doc"), F.xxhash64("text").alias("own"))
    # only documents that lose lines go through Python, and once: a filter must not repeat the call
    apply = F.arrow_udf(_apply, APPLIED).asNondeterministic()
    d = d.join(bits, ["doc", "own"], "left")
    d = d.select("row", "bits", apply(F.when(F.col("bits").isNotNull(), F.col("row.text")), F.col("bits")).alias("r"))
    whole = F.coalesce("row.text", F.lit(""))
    cut = F.col("bits").isNotNull()
    return d.select(
        "row",
        F.when(cut, F.col("r.kept")).otherwise(whole).alias("kept"),
        F.when(cut, F.col("r.n_lines")).otherwise(F.size(F.split(whole, "\n"))).cast("long").alias("n_lines"),
        F.when(cut, F.col("r.n_dropped")).otherwise(F.lit(0)).cast("long").alias("n_dropped"),
    )


def line_table(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept_sha256."""
    d = dedup_lines(docs.select("doc_id", "text"))
    return d.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
