"""Token-id files with a minimal perfect hash index for keyed access.

Texts are range-partitioned and sorted by doc_id and encoded; each partition is cut into shards of about
`SHARD_IDS` ids. A shard is one row of a Parquet dataset (so any store Spark writes to will do, and Spark's
commit protocol covers lost executors): the raw little-endian ids (two bytes each while the vocabulary has
at most 65,536 entries, else four), the document keys in order, and the index. The index is a minimal perfect
hash over the shard's keys: levels of bit arrays, each key set at the first level where it collides with no
other; the rank of its bit is its slot. A slot holds the key's fingerprint, offset and length, so a lookup
takes constant time and a key that is not in the shard is recognised by its fingerprint.

Encoding goes through the tokenizers library. Texts of ASCII and Latin letters are cut where the byte-level
pre-tokenizer cuts, and every distinct piece is encoded by the library once per worker and remembered by its
64-bit hash in a table of bounded size. All other texts, and those that hold the text of a special token, are
encoded whole.

Defined results: a null text is empty and has only the end id; null ids come first; rows that repeat an id are
further occurrences of its key, ordered by text hash; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from riskframe.llm.near_dups import mixed, span_hashes
from riskframe.session import scratch_path, stage_table

SHARD_IDS = 1 << 21
END = 0
#: Pieces remembered per worker.
PIECES = 2_000_000
NEAR_BITS = 20
GAMMA = 2.0
MAX_LEVELS = 48
NULL_ID = -(2**63)
CHUNK = 1_000_000
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
# texts of these characters take the fast path, unless they hold contractions or long runs of blanks
_USUAL = re.compile(rf"[\x20-\x7e\n{_LETTERS}]*")
# classes of bytes: 0 between texts, 1 letters (all bytes of longer characters here), 2 digits, 3 blank, 4 others
_CLASS = np.full(256, 4, dtype=np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_CLASS[32] = 3
_CLASS[0] = 0


def _byte_characters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256, 257, ... in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTES = _byte_characters()


class Encoder:
    """Texts to bytes of ids, every distinct piece encoded once.

    The byte-level pre-tokenizer cuts where the class of characters changes, a blank going with what follows it;
    the pieces are encoded independently, by the model alone. Known pieces are kept as arrays: hash, place in the pool, length.
    """

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self):
        # pieces in the order they were met: hash, place in the pool, length
        self.hash = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int32)
        # their numbers by leading bits of the hash, the first that came, and all of them sorted by hash
        self.near = np.zeros(1 << NEAR_BITS, np.int32)
        self.order = np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 16, self.kind)
        self.used = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        usual = [i for i, t in enumerate(texts) if t and _USUAL.fullmatch(t) and "'" not in t and not any(s in t for s in self.special)]
        raws = [texts[i].encode() for i in usual]
        data = np.frombuffer(b"\0".join(raws) + b"\0\0\0", np.uint8)
        # three blanks in a row, or two at the end of a text, are not cut one by one
        blank = (data == 32) | (data == 10)
        runs = np.flatnonzero(blank[:-2] & blank[1:-1] & (blank[2:] | (data[2:] == 0)))
        if len(runs):
            odd = set(np.searchsorted(np.cumsum([len(r) + 1 for r in raws]), runs, side="right").tolist())
            usual = [i for k, i in enumerate(usual) if k not in odd]
            raws = [r for k, r in enumerate(raws) if k not in odd]
            data = np.frombuffer(b"\0".join(raws) + b"\0\0\0", np.uint8)
        out: list = [None] * len(texts)
        if usual:
            for i, ids in zip(usual, self._pieces(raws, data[:-2])):
                out[i] = ids.tobytes()
        whole = lambda t: np.array(self.tok.encode(t, add_special_tokens=False).ids, self.kind).tobytes()
        return [whole(t) if ids is None else ids for t, ids in zip(texts, out)]

    def _pieces(self, raws: list[bytes], data: np.ndarray) -> list[np.ndarray]:
        """Ids of each text; `data` holds the texts, a zero byte after each."""
        cls = _CLASS[data]
        before = np.r_[np.uint8(0), cls[:-1]]
        # a newline stands alone; what follows a blank goes with it
        begin = ((cls != before) & (before != 3)) | (cls == 3) | (data == 10) | (np.r_[np.uint8(0), data[:-1]] == 10) | (cls == 0)
        start = np.flatnonzero(begin)
        length = np.diff(np.r_[start, len(data)])
        kept = cls[start] != 0
        ends = np.cumsum([len(r) + 1 for r in raws])
        start, length = start[kept], length[kept]
        h = span_hashes(data, start, length)
        if len(self.hash) + len(h) > PIECES and len(self.hash) + len(np.unique(h)) > PIECES:
            self._forget()
        piece = self.near[h >> np.uint64(64 - NEAR_BITS)]
        far = np.flatnonzero(self.hash[piece] != h) if len(self.hash) else np.arange(len(h))
        if len(far):
            found, first, inverse = np.unique(h[far], return_index=True, return_inverse=True)
            where = np.searchsorted(self.hash[self.order], found)
            at = np.append(self.order, 0)[where] if len(self.hash) else np.zeros(len(found), np.int64)
            new = np.flatnonzero(self.hash[at] != found) if len(self.hash) else np.arange(len(found))
            new = np.union1d(new, np.flatnonzero(where == len(self.hash)))
            if len(new):
                whole = data.tobytes()
                at[new] = len(self.hash) + np.arange(len(new))
                spans = zip(start[far[first[new]]].tolist(), length[far[first[new]]].tolist())
                self._learn(found[new], where[new], [whole[a : a + n] for a, n in spans])
            piece[far] = at[inverse]
        size = self.length[piece]
        upto = np.cumsum(size)
        place = np.repeat(self.at[piece] - (upto - size), size) + np.arange(int(upto[-1]))
        ids = self.pool[place]
        cuts = np.r_[0, upto][np.searchsorted(start, ends)]
        return np.split(ids, cuts[:-1])

    def _learn(self, hashes: np.ndarray, where: np.ndarray, pieces: list[bytes]) -> None:
        """Ids of new pieces, by the tokenizer's own model on the byte-level characters."""
        model = self.tok.model
        found = [[t.id for t in model.tokenize(p.decode("latin-1").translate(_BYTES))] for p in pieces]
        size = np.array([len(f) for f in found])
        ids = np.array([i for f in found for i in f], self.kind)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        numbers = len(self.hash) + np.arange(len(hashes))
        slots = (hashes >> np.uint64(64 - NEAR_BITS)).astype(np.int64)
        taken = (self.hash[self.near[slots]] >> np.uint64(64 - NEAR_BITS)) == slots.astype(np.uint64) if len(self.hash) else np.zeros(len(slots), bool)
        self.near[slots[~taken]] = numbers[~taken]
        self.order = np.insert(self.order, where, numbers)
        self.hash = np.concatenate([self.hash, hashes])
        self.at = np.concatenate([self.at, self.used + np.cumsum(size) - size])
        self.length = np.concatenate([self.length, size.astype(np.int32)])
        self.used += len(ids)


#: One encoder per worker process and vocabulary, so its pieces outlive a task.
_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def hashed(keys: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """64-bit hash of (key, occurrence)."""
    return mixed(mixed(keys.astype(np.int64).view(np.uint64)) + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _level(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(h ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) % np.uint64(size)).astype(np.int64)


def build_index(h: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
    """Minimal perfect hash of distinct hashes: level sizes in bits, all levels' bits, and each key's slot."""
    sizes, bits, slot = [], [], np.full(len(h), -1)
    rest, used = np.arange(len(h)), 0
    while len(rest):
        if len(sizes) == MAX_LEVELS:
            raise ValueError("keys of a shard share a hash")
        size = max(64, int(GAMMA * len(rest)) // 64 * 64 + 64)
        at = _level(h[rest], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        here = alone[at]
        slot[rest[here]] = used + (np.cumsum(alone) - 1)[at[here]]
        used += int(here.sum())
        sizes.append(size)
        bits.append(np.packbits(alone))
        rest = rest[~here]
    return sizes, (np.concatenate(bits).tobytes() if bits else b""), slot


class Shard:
    """Keyed access to one shard row."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["payload"], dtype=f"<u{row['id_bytes']}")
        self.sizes = list(row["levels"])
        bits = np.frombuffer(row["bits"], dtype=np.uint8)
        ends = np.cumsum([s // 8 for s in self.sizes])
        self.bits = [np.unpackbits(b) for b in np.split(bits, ends[:-1])] if self.sizes else []
        self.rank = [np.cumsum(b) - 1 for b in self.bits]
        self.begin = np.r_[0, np.cumsum([int(b.sum()) for b in self.bits])]
        self.slots = np.frombuffer(row["slots"], dtype=SLOT)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset and length for every hash; -1 where the shard has no such key."""
        slot = np.full(len(h), -1)
        rest = np.arange(len(h))
        for i, (size, bits, rank) in enumerate(zip(self.sizes, self.bits, self.rank)):
            at = _level(h[rest], i, size)
            hit = bits[at] == 1
            slot[rest[hit]] = self.begin[i] + rank[at[hit]]
            rest = rest[~hit]
        ok = slot >= 0
        ok[ok] = self.slots["mark"][slot[ok]] == (h[ok] >> np.uint64(32)).astype(np.uint32)
        offset, length = np.full(len(h), -1), np.full(len(h), -1)
        offset[ok], length[ok] = self.slots["offset"][slot[ok]], self.slots["length"][slot[ok]]
        return offset, length

    def get(self, doc_id: int | None, nth: int = 0) -> np.ndarray | None:
        """The ids of one document, or None."""
        key = np.array([NULL_ID if doc_id is None else doc_id])
        offset, length = self.find(hashed(key, np.array([nth])))
        return None if offset[0] < 0 else self.ids[offset[0] : offset[0] + length[0]]


SLOT = np.dtype([("mark", "<u4"), ("offset", "<u8"), ("length", "<u8")])
SCHEMA = (
    "part int, seq int, n_docs long, n_ids long, id_bytes int, first_key long, last_key long,"
    " payload binary, keys binary, nth binary, levels array<long>, bits binary, slots binary"
)


def _shard(part: int, seq: int, kind: np.dtype, keys: list[int], nth: list[int], runs: list[bytes]) -> pa.RecordBatch:
    k, m = np.array(keys, dtype="<i8"), np.array(nth, dtype="<u4")
    length = np.array([len(r) // kind.itemsize for r in runs], dtype=np.int64)
    h = hashed(k, m)
    sizes, bits, slot = build_index(h)
    slots = np.zeros(len(k), dtype=SLOT)
    slots["mark"][slot] = (h >> np.uint64(32)).astype(np.uint32)
    slots["offset"][slot], slots["length"][slot] = np.cumsum(length) - length, length
    row = {
        "part": part, "seq": seq, "n_docs": len(k), "n_ids": int(length.sum()), "id_bytes": kind.itemsize,
        "first_key": keys[0], "last_key": keys[-1], "payload": b"".join(runs), "keys": k.tobytes(), "nth": m.tobytes(),
        "levels": sizes, "bits": bits, "slots": slots.tobytes(),
    }
    types = {"part": pa.int32(), "seq": pa.int32(), "id_bytes": pa.int32(), "levels": pa.list_(pa.int64())}
    arrays = [pa.array([v], types.get(c)) for c, v in row.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(row))


def _write(path: str, end: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = encoder_of(path), TaskContext.get().partitionId(), 0
        stop = np.array([end], encoder.kind).tobytes()
        keys: list[int] = []
        nth: list[int] = []
        runs: list[bytes] = []
        size, last = 0, (None, -1)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(texts):
                upto, held, part_texts = at, 0, []
                while upto < len(texts) and held < CHUNK:
                    part_texts.append(texts[upto].as_py() or "")
                    held += len(part_texts[-1])
                    upto += 1
                for doc, run in zip(ids[at:upto], encoder.encode(part_texts)):
                    doc = NULL_ID if doc is None else doc
                    last = (doc, last[1] + 1 if last[0] == doc else 0)
                    keys.append(doc)
                    nth.append(last[1])
                    runs.append(run + stop)
                    size += len(runs[-1]) // encoder.kind.itemsize
                    if size >= shard_ids:
                        yield _shard(part, seq, encoder.kind, keys, nth, runs)
                        keys, nth, runs, size, seq = [], [], [], 0, seq + 1
                at = upto
        if keys:
            yield _shard(part, seq, encoder.kind, keys, nth, runs)

    return run


def write_tokens(docs: DataFrame, vocabulary: str, path: str, end: int = END, shard_ids: int = SHARD_IDS) -> None:
    """Write the shards of `docs` (doc_id, text) in ascending doc_id order to the folder `path`."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    t = t.repartitionByRange(*order).sortWithinPartitions(*order)
    t.mapInArrow(_write(vocabulary, end, shard_ids), SCHEMA).write.option("compression", "zstd").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row)
            keys, nth = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["nth"], "<u4")
            offset, length = shard.find(hashed(keys, nth))
            crc = [zlib.crc32(shard.ids[a : a + n].astype("<u4").tobytes()) for a, n in zip(offset.tolist(), length.tolist())]
            doc = pa.array(keys, mask=keys == NULL_ID)
            where = [pa.array(np.full(len(keys), row[c], "i4")) for c in ("part", "seq")]
            columns = [*where, doc, pa.array(offset), pa.array(length), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "seq", "doc_id", "offset", "n_tokens", "ids_crc32"])


def read_tokens(spark, path: str) -> DataFrame:
    """Per document, looked up by key in its shard: doc_id, start, n_tokens, ids_crc32."""
    shards = spark.read.schema(SCHEMA).parquet(path)
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    heads = shards.select("part", "seq", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))
    heads = stage_table(heads, "shard_starts")
    found = shards.mapInArrow(_read, "part int, seq int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return found.join(heads, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, vocabulary: str) -> DataFrame:
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, vocabulary, path)
    return read_tokens(docs.sparkSession, path)
