r"""Secret scan: candidate values judged by how many owners and repositories of the corpus hold them.

Three patterns give the base spans, leftmost and non-overlapping per kind, which always stay:
`assign` (a name such as password or api_key, `:` or `=`, and a value of 6 characters or more), `access` (AKIA and 16 or
more of A-Z0-9) and `hex` (24 or more of 0-9a-f). A fourth kind, `owned`, is a maximal run of 20 or more of
[A-Za-z0-9_-] with a digit, an upper-case and a lower-case letter and 10 different characters that overlaps no base span. Such a
run by itself may be anything, so the corpus decides: values travel as 128-bit hashes, which are counted over distinct
repositories and owners. A value that several owners hold is a copied example, fixture or identifier and gives no
span; one that a single owner holds is taken for a live credential and its spans are added.

The counts are aggregated in steps (value, owner, repository), (value, owner), (value), each combined before
its shuffle, so a value found in a third of all documents costs a row per task and step. Only values with several owners
are looked up: as a broadcast after a check of rows and bytes, beyond it by a shuffled join, whose hot keys
adaptive execution splits.

Owner and repository are columns of the input; in the query the source owns its documents, and every document is a
repository of its own.

Defined results: a null or empty text has no spans; null owners are one owner, null repositories one repository of their owner;
rows that repeat a text and id are scanned each and count once; an empty table gives an empty one; the input's
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.llm.common import stage_text
from riskframe.session import local_if_small

KINDS = ["assign", "access", "hex", "owned"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# a run is matched whole or not at all, so the least length can stand in these patterns
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
OWNED = re.compile(r"[A-Za-z0-9_-]{20,}")
ASSIGN_CHARS = 6
DISTINCT = 10  # different characters of a value that looks live
WIDELY = 3  # owners of a value that counts as widely copied

DIGIT, LOWER, UPPER = re.compile("[0-9]"), re.compile("[a-z]"), re.compile("[A-Z]")


def looks_live(value: str) -> bool:
    """Whether a value has a digit, a letter and many different characters, unlike a placeholder."""
    return len(set(value)) >= DISTINCT and bool(DIGIT.search(value)) and bool(LOWER.search(value) or UPPER.search(value))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the base kinds, in order."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def weak_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Runs that only the corpus can judge: mixed, varied, and clear of the base spans."""
    starts, reach = [s[0] for s in base], [0, *accumulate((s[2] for s in base), max)]
    out = []
    for m in OWNED.finditer(text):
        if looks_live(m[0]) and LOWER.search(m[0]) and UPPER.search(m[0]):
            if reach[bisect_left(starts, m.end())] <= m.start():
                out.append((m.start(), 3, m.end(), m[0]))
    return out


def listed(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, *_ in spans)


FIELDS = ["start", "kind", "end", "value", "live"]
SPAN = pa.struct(list(zip(FIELDS, [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.bool_()])))
SCANNED = (
    "n_assign long, n_access long, n_hex long, base_sha256 string, "
    "found array<struct<start: long, kind: int, end: long, value: binary, live: boolean>>"
)


def _scan(texts: pa.Array) -> pa.Array:
    """Texts to their base counts, the digest of their base spans, and all candidates with hashed values."""
    counts: list[list[int]] = [[], [], []]
    digests, found = [], []
    for text in texts:
        text = text.as_py() or ""
        base = base_spans(text)
        for k in range(3):
            counts[k].append(sum(s[1] == k for s in base))
        digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
        spans = base + weak_spans(text, base)
        found.append([dict(zip(FIELDS, (*s[:3], xxhash.xxh3_128_digest(s[3].encode()), looks_live(s[3])))) for s in spans])
    columns = [*(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(found, pa.list_(SPAN))]
    return pa.StructArray.from_arrays(columns, ["n_assign", "n_access", "n_hex", "base_sha256", "found"])


def ownership(found: DataFrame) -> DataFrame:
    """Per value: distinct owners, and distinct repositories of all owners. Every step combines before it shuffles."""
    each = found.groupBy("value", "owner", "repository").agg(F.lit(1).alias("one"))
    held = each.groupBy("value", "owner").agg(F.count("one").alias("n"))
    return held.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Per row: doc_id, base counts and digest, `spans` (all kinds), `n_owned` added spans, `n_live` spans with one owner whose
    value looks live, `n_copied` spans with a value of `WIDELY` owners or more."""
    own = {"owner": owner, "repository": repository}
    t = docs.select("doc_id", *[F.col(c).alias(k) for k, c in own.items()], "text").withColumn("row", F.monotonically_increasing_id())
    scan = F.arrow_udf(_scan, SCANNED).asNondeterministic()
    s = stage_text(t.select("row", "doc_id", "owner", "repository", scan("text").alias("r")), "secrets")
    found = s.select("row", "owner", "repository", F.inline("r.found"))
    many = ownership(found).filter("owners > 1").select("value", "owners")
    judged = found.join(local_if_small(many), "value", "left").fillna({"owners": 1})
    judged = judged.withColumn("mine", F.col("live") & (F.col("owners") == 1))
    span = F.struct("start", "kind", "end")
    per_row = judged.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when((F.col("kind") < 3) | F.col("mine"), span))).alias("spans"),
        F.count_if((F.col("kind") == 3) & F.col("mine")).alias("n_owned"),
        F.count_if("mine").alias("n_live"),
        F.count_if(F.col("owners") >= WIDELY).alias("n_copied"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return s.join(per_row, "row", "left").select(
        "doc_id", "r.n_assign", "r.n_access", "r.n_hex", "r.base_sha256",
        F.coalesce(_joined(F.col("spans")), F.lit("")).alias("spans"), zero("n_owned"), zero("n_live"), zero("n_copied"),
    )
