"""Language ID by multilingual mixture inference.

The model holds, for each language, the log probabilities of the byte trigrams inside lower-cased words
(blank at both ends), add-half smoothed. A document is a mixture: its words are drawn from languages with
unknown proportions. Expectation-maximisation estimates the proportions from the words' likelihoods; a set
of languages is kept by penalised likelihood (half the log of the number of words for each further
language), starting from the best single language. The prediction is the kept language with the largest
proportion, which is the score.

Learning: counts come from labelled documents. At most about `per_language` documents of a language are
used, a hash sample by id; texts of others are not read for learning. Scoring reads every text, whole.
The model has languages x 65,536 numbers; more than `MAX_LANGUAGES` learned values are refused.

`accepted` rejects what is `und` for its text, and texts that fit no learned language. A text's fit is the mean log
probability of its trigrams, each word in the language that suits it best. A language with `LEAST_LABELLED` labelled
documents or more has a bound: as far below the fit that one in a thousand of them misses as that is below their
median. A text predicted as the language is rejected below it; languages with fewer labels reject no text.

Defined results: a null text, or one without a letter, is `und` with score 0; without any learned language
every document is `und`, and `accepted` rejects only the texts without a letter; ties go to the smaller language name; null ids are scored but never learned from;
repeated rows get equal predictions; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.llm.common import stage_text
from riskframe.session import collect_bounded

PER_LANGUAGE = 10_000
MAX_LANGUAGES = 512
BUCKETS = 1 << 16
LEAST_LABELLED = 1_000
STEPS = 30
TOLERANCE = 1e-4
#: Bytes of text handled at a time inside a task.
CHUNK = 500_000
UND = "und"
LETTER = regex.compile(r"\p{L}")
# letters are a-z and all bytes of longer characters; everything else is a break
_CLASS = np.zeros(256, dtype=np.uint32)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, 155)


def _trigrams(texts: list[str]):
    """Bucket of each letter's trigram with its predecessors, the word starts and each text's first word."""
    data = np.frombuffer((" ".join(texts) + " ").lower().encode(), dtype=np.uint8)
    c = _CLASS[data]
    before = np.r_[np.uint32(0), c[:-1]]
    two = np.r_[np.uint32(0), before[:-1]] * (before > 0)
    key = ((two * 155 + before) * 155 + c) * np.uint32(2654435761) >> np.uint32(16)
    # a word ends with the break after it, so its last letters are seen with the end
    inside = (c > 0) | (before > 0)
    key = key[inside]
    starts = np.flatnonzero(((c > 0) & (before == 0))[inside])
    sizes = np.array([len(t.lower().encode()) + 1 for t in texts])
    letters_before = np.r_[0, np.cumsum(inside)][np.r_[0, np.cumsum(sizes)]]
    return key, starts, np.searchsorted(starts, letters_before)


def _chunks(values: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about CHUNK characters: first index and texts; nulls are empty."""
    first, held, size = 0, [], 0
    for i, v in enumerate(values):
        held.append(v.as_py() or "")
        size += len(held[-1])
        if size >= CHUNK:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang in pc.unique(batch.column(0)).to_pylist():
            for _, part in _chunks(batch.column(1).filter(pc.equal(batch.column(0), lang))):
                counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))[:] += np.bincount(_trigrams(part)[0], minlength=BUCKETS)
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        names = pa.array([lang] * len(at), pa.string())
        yield pa.RecordBatch.from_arrays([names, pa.array(at), pa.array(c[at])], names=["lang", "bucket", "n"])


def learn(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Language names in order and their log probabilities, one row per language."""
    labelled = labelled.filter("lang is not null and doc_id is not null")
    sizes = collect_bounded(labelled.groupBy("lang").count(), MAX_LANGUAGES)
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col("lang") == r["lang"], min(1.0, per_language / r["count"])).otherwise(share)
    draw = F.abs(F.xxhash64(F.lit("language"), "doc_id") % 1_000_000) / 1_000_000
    sample = labelled.filter(draw < share).select("lang", "text")
    counts = sample.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counts.groupBy("lang").agg(F.collect_list("bucket").alias("at"), F.collect_list("n").alias("n")).toArrow()
    names = sorted(r["lang"] for r in sizes)
    table = np.full((len(names), BUCKETS), 0.5)
    for lang, at, n in zip(rows["lang"].to_pylist(), rows["at"], rows["n"]):
        table[names.index(lang), at.values.to_numpy()] += n.values.to_numpy()
    return names, np.log(table / table.sum(axis=1, keepdims=True)).astype("f4")


def proportions(likelihood: np.ndarray, start: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """EM for mixture proportions: words x languages log likelihoods to proportions and log likelihood."""
    top = likelihood.max(axis=1, keepdims=True)
    p, pi = np.exp(likelihood - top), start
    for _ in range(steps):
        joint = p * pi
        total = joint.sum(axis=1, keepdims=True)
        new = (joint / np.maximum(total, 1e-300)).mean(axis=0)
        done = np.abs(new - pi).max() < TOLERANCE
        pi = new
        if done:
            break
    return pi, float(np.log(np.maximum((p * pi).sum(axis=1), 1e-300)).sum() + top.sum())


def infer(likelihood: np.ndarray) -> tuple[int, float]:
    """Index and proportion of the main language of one document's words."""
    n, k = likelihood.shape
    single = likelihood.sum(axis=0)
    best = int(single.argmax())
    if k == 1:
        return 0, 1.0
    penalty = 0.5 * np.log(n + 1)
    pi, every = proportions(likelihood, np.full(k, 1 / k))
    # no set can gain more than the full set does
    if every - single[best] <= penalty:
        return best, 1.0
    order = np.argsort(-pi, kind="stable")
    kept, value, share = np.array([best]), float(single[best]), np.ones(1)
    for size in range(2, k + 1):
        if every - penalty * (size - 1) <= value:
            break
        some = np.sort(order[:size])
        got, ll = proportions(likelihood[:, some], np.full(size, 1 / size))
        if ll - penalty * (size - 1) > value:
            kept, value, share = some, ll - penalty * (size - 1), got
    at = int(share.argmax())
    return int(kept[at]), float(min(1.0, share[at]))


def _predict(texts: pa.Array, names: list[str], table: np.ndarray) -> tuple[list[str], list[float], list[float | None]]:
    langs, scores, fits = [], [], []
    for _, part in _chunks(texts):
        key, starts, first = _trigrams(part)
        words = np.stack([np.add.reduceat(row[key], starts) for row in table], axis=1).astype("f8") if len(starts) and names else None
        for i, text in enumerate(part):
            a, b = int(first[i]), int(first[i + 1])
            if words is None or not LETTER.search(text):
                langs.append(UND)
                scores.append(0.0)
                fits.append(None)
                continue
            # letters outside the model's classes give no word: nothing speaks for any language
            at, score = infer(words[a:b]) if b > a else (0, 1 / len(names))
            langs.append(names[at])
            scores.append(score)
            end = starts[b] if b < len(starts) else len(key)
            fits.append(float(words[a:b].max(axis=1).sum() / (end - starts[a])) if b > a else None)
    return langs, scores, fits


def identify(docs: DataFrame, names: list[str], table: np.ndarray, keep: list[str]) -> DataFrame:
    """`keep` columns of `docs` with lang_pred, score and fit."""
    model = docs.sparkSession.sparkContext.broadcast((names, table))  # at most MAX_LANGUAGES x BUCKETS floats

    @F.arrow_udf("lang_pred string, score double, fit double")
    def predict(texts: pa.Array) -> pa.Array:
        langs, scores, fits = _predict(texts, *model.value)
        arrays = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.float64())]
        return pa.StructArray.from_arrays(arrays, ["lang_pred", "score", "fit"])

    d = docs.select(*keep, predict("text").alias("_p"))
    return d.select(*keep, F.col("_p.lang_pred").alias("lang_pred"), F.col("_p.score").alias("score"), F.col("_p.fit").alias("fit"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def language_table(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    names, table = learn(docs.filter(~held_out()))
    return identify(docs, names, table, ["doc_id", "text"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame) -> DataFrame:
    """`docs` without the texts that have no letter or fit no learned language; the columns stay.

    Only the documents' keys and fits are written; the rows themselves do not pass through Python.
    """
    names, table = learn(docs.filter(~held_out()))
    docs = docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    if not names:
        return docs
    own = F.xxhash64("text")
    label = F.when(~held_out() & F.col("doc_id").isNotNull(), F.col("lang"))
    keyed = docs.select(F.col("doc_id").alias("id"), own.alias("own"), label.alias("label"), "text")
    told = stage_text(identify(keyed, names, table, ["id", "own", "label"]).drop("score"), "told")
    low, middle = (F.percentile_approx("fit", q, 100_000) for q in (0.001, 0.5))
    bounds = told.filter("label is not null and fit is not null").groupBy("label")
    bounds = bounds.agg((2 * low - middle).alias("bound"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_LABELLED)
    bounds = F.broadcast(bounds.select(F.col("label").alias("lang_pred"), "bound"))  # MAX_LANGUAGES rows at most
    gone = told.join(bounds, "lang_pred").filter("fit < bound").select("id", "own").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("of"), own.alias("hash"))
    return rows.join(gone, F.col("of").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("own")), "left_anti").select("row.*")
