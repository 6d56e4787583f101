"""Periodic runs of words: block convolution at dyadic scales, then extension of the distances found.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of at least
max(6, 4 * q) words, that no neighbouring word extends. Documents are taken together, one word that never recurs
between two of them, so no run crosses documents.

For a period q let L be the power of two with L <= q < 2L. A run with that period holds a whole aligned block of L
words among its first 2q, and the block occurs again q words on. So, at each scale L, every aligned block is matched
against the words that follow it: the sums of squared differences between the block's word numbers and all windows
L to 2L - 1 words on come from a number-theoretic transform, exactly. They are zero modulo primes whose product exceeds the
largest possible sum, so a zero is an occurrence. The distances of the occurrences are candidate periods, and
each is extended word by word to its maximal stretch; stretches that are long enough are runs, the smallest period
first, and a stretch found again with a multiple of its period is the same run.

Two exact tests spare transforms: a block inside a run has words that all recur less than 2L words later, and
what a block matches inside a known run of a shorter period is that run. Both only skip blocks that can seed
no new run.

Work is a map over the documents: memory is bounded by `WORDS` words or one document, nothing is shuffled.

Defined results: a null or empty text has no words, no runs and the digests of empty strings; a null doc_id
is never altered; rows that repeat an id are results of their own; extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskframe.llm.common import stage_text

WORDS = 200_000  # words taken together, if documents are shorter
CELLS = 1 << 18  # numbers of a transform held at once
# fixed values: primes c * 2^k + 1 with their primitive roots, for transforms of up to 2^21 words
PRIMES = ((998244353, 3), (1004535809, 3), (469762049, 3))
MIN_LENGTH, MIN_EXPONENT = 6, 4


@cache
def _twiddles(prime: int, root: int, half: int, back: bool) -> np.ndarray:
    """Powers 0 to half - 1 of a primitive root of unity of order 2 * half, or of its inverse."""
    w = pow(root, (prime - 1) // (2 * half), prime)
    w = pow(w, -1, prime) if back else w
    out = np.ones(half, dtype=np.uint64)
    filled = 1
    while filled < half:
        out[filled : 2 * filled] = out[:filled] * np.uint64(pow(w, filled, prime)) % np.uint64(prime)
        filled *= 2
    return out


def _forward(a: np.ndarray, prime: int, root: int) -> np.ndarray:
    """Transform of every row, in bit-reversed order."""
    m, n = a.shape
    p, half = np.uint64(prime), n // 2
    while half:
        a = a.reshape(m, -1, 2, half)
        u, v = a[:, :, 0], a[:, :, 1]
        a = np.stack([(u + v) % p, (u + p - v) * _twiddles(prime, root, half, False) % p], axis=2)
        half //= 2
    return a.reshape(m, n)


def _inverse(a: np.ndarray, prime: int, root: int) -> np.ndarray:
    """Rows in natural order from transforms in bit-reversed order."""
    m, n = a.shape
    p, half = np.uint64(prime), 1
    while half < n:
        a = a.reshape(m, -1, 2, half)
        u, v = a[:, :, 0], a[:, :, 1] * _twiddles(prime, root, half, True) % p
        a = np.stack([(u + v) % p, (u + p - v) % p], axis=2)
        half *= 2
    return a.reshape(m, n) * np.uint64(pow(n, -1, prime)) % p


def zero_mismatch(ids: np.ndarray, blocks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) of every occurrence of a block `size` to 2 * size - 1 words after itself.

    `ids` are non-negative numbers, followed by at least 2 * size numbers that match nothing before them.
    """
    largest = int(ids.max(initial=0)) ** 2 * size
    primes, bound = [], 1
    for p in PRIMES:
        if bound <= largest:
            primes.append(p)
            bound *= p[0]
    n, starts, distances = 2 * size, [], []
    for at in range(0, len(blocks), max(1, CELLS // n)):
        b = blocks[at : at + max(1, CELLS // n)]
        x = ids[b[:, None] + np.arange(size)].astype(np.uint64)
        y = ids[b[:, None] + np.arange(size, n + size)].astype(np.uint64)
        y[:, -1] = 0  # the last word that a window can take is 3 * size - 2 words on
        flipped = np.zeros_like(y)  # the block read backwards turns the product into a correlation
        flipped[:, -np.arange(size)] = x
        zero = np.ones((len(b), size), dtype=bool)
        for prime, root in primes:
            p = np.uint64(prime)
            cross = _inverse(_forward(flipped % p, prime, root) * _forward(y % p, prime, root) % p, prime, root)[:, :size]
            total = np.concatenate([np.zeros((len(b), 1), np.uint64), np.cumsum((y % p) ** 2 % p, axis=1)], axis=1)
            squares = (total[:, size : 2 * size] - total[:, :size]) % p + ((x % p) ** 2 % p).sum(axis=1)[:, None] % p
            zero &= (squares + 2 * (p - cross)) % p == 0
        rows, offset = np.nonzero(zero)
        starts.append(b[rows])
        distances.append(offset + size)
    return np.concatenate(starts), np.concatenate(distances)


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix of two equally long sequences."""
    at, step = 0, 64
    while at < len(a):
        other = np.flatnonzero(a[at : at + step] != b[at : at + step])
        if len(other):
            return at + int(other[0])
        at, step = at + step, 2 * step
    return len(a)


def _extend(ids: np.ndarray, n: int, start: int, distance: int) -> tuple[int, int]:
    """The maximal stretch with the given period around an occurrence: first word and end."""
    right = start + _agreeing(ids[start : n - distance], ids[start + distance : n])
    left = start - _agreeing(ids[:start][::-1], ids[distance : start + distance][::-1])
    return left, right + distance


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """Every run of a sequence of non-negative numbers as (start, length, period), by start, then period."""
    n = len(ids)
    if n < MIN_LENGTH:
        return []
    # distance to the next equal word
    order = np.argsort(ids, kind="stable")
    recurs = np.full(n, n, dtype=np.int64)
    again = ids[order][1:] == ids[order][:-1]
    recurs[order[:-1][again]] = np.diff(order)[again]
    found: dict[tuple[int, int], int] = {}
    size, worst = 1, recurs
    while MIN_EXPONENT * size <= n:
        blocks = np.flatnonzero(worst < 2 * size) * size
        if found and len(blocks):
            known = np.array(sorted(found), dtype=np.int64)
            reach = np.r_[0, np.maximum.accumulate(known[:, 1])]
            blocks = blocks[reach[np.searchsorted(known[:, 0], blocks, "right")] < blocks + 3 * size - 1]
        if len(blocks):
            padded = np.r_[ids, np.full(3 * size, ids.max() + 1)]
            starts, distances = zero_mismatch(padded, blocks, size)
            order = np.lexsort((starts, distances))
            starts, distances = starts[order], distances[order]
            cuts = np.flatnonzero(np.diff(distances)) + 1
            for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(starts)].tolist()):
                while a < b:  # occurrences within a stretch just extended belong to it
                    q = int(distances[a])
                    start, end = _extend(ids, n, int(starts[a]), q)
                    if end - start >= max(MIN_LENGTH, MIN_EXPONENT * q):
                        found.setdefault((start, end), q)
                    a += int(np.searchsorted(starts[a:b], end - q - size, "right"))
        size *= 2
        half = len(worst) // 2
        worst = np.maximum(worst[: 2 * half : 2], worst[1 : 2 * half : 2])
    return sorted((s, e - s, q) for (s, e), q in found.items())


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with every tenth document's tail made periodic, by the checksum of its id."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _summary(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, q in runs:
        drop[start + q] += 1
        drop[start + length] -= 1
    kept = (w for w, d in zip(words, np.cumsum(drop)) if not d) if runs else words
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    digests = hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()
    return (len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, *digests)


OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
TYPES = [pa.int64()] * 6 + [pa.string()] * 2


def _together(docs: list[tuple]) -> list[tuple]:
    """Results of some documents, given as (doc_id, words)."""
    number: dict[bytes, int] = {}
    ids, begins = [], []
    for _, words in docs:
        begins.append(len(ids))
        ids.extend([number.setdefault(w, len(number)) for w in words])
        ids.append(-1)
    flat = np.array(ids, dtype=np.int64)
    ends = np.flatnonzero(flat < 0)
    flat[ends] = len(number) + np.arange(len(ends))  # words that never recur
    runs: list[list] = [[] for _ in docs]
    for s, n, q in find_runs(flat):
        at = int(np.searchsorted(begins, s, "right")) - 1
        runs[at].append((s - begins[at], n, q))
    return [(doc_id, *_summary(words, r)) for (doc_id, words), r in zip(docs, runs)]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in OUT.split(", ")]
    for batch in batches:
        rows, held, n = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = planted((text.as_py() or "").encode().split(), doc_id)
            held.append((doc_id, words))
            n += len(words)
            if n >= WORDS:
                rows += _together(held)
                held, n = [], 0
        rows += _together(held) if held else []
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, TYPES)], names=names)


def run_table(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the number of runs, the longest one, and digests of all runs and of the collapsed text."""
    return stage_text(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_runs, OUT), "periodic")
