"""The document operators against brute force, on odd rows and on the smallest table."""

import hashlib
import re
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from riskframe.llm import language, language_model, line_dedup, mixing, near_dups, packing, quality, repeats
from riskframe.llm.common import read_documents
from tests.conftest import DATA
from tests.llm.conftest import make_docs

BREAK = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in BREAK.split(text or "") if w]


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def counted(rows):
    return Counter(map(repr, rows))


@pytest.fixture(scope="module")
def given(spark):
    return [(r["doc_id"], r["text"]) for r in read_documents(spark, DATA).collect()]


# --- line dedup -------------------------------------------------------------------------------------


def lines_brute(rows, min_docs=5, min_chars=40):
    key = lambda line: low(line.strip(" \t\n\v\f\r"))
    docs = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                docs[key(line)].add(-(2**63) if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        me = -(2**63) if doc is None else doc
        kept = [x for x in lines if len(docs.get(key(x), ())) < min_docs or max(docs[key(x)]) == me]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_line_dedup_on_odd_rows(spark, odd_rows):
    got = rows_of(line_dedup.line_table(make_docs(spark, odd_rows)))
    want = lines_brute([r[:2] for r in odd_rows])
    assert sum(r[2] for r in want) > 0
    assert counted(got) == counted(want)


def test_line_dedup_runs_cut_by_partitions(spark):
    """One line in most documents, over many more partitions than lines."""
    rows = [(i // 2, f"The very same long line stands in all of the documents.\nown {i}") for i in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows_of(line_dedup.line_table(make_docs(spark, rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert counted(got) == counted(lines_brute(rows))


def test_line_bitmaps_round_trip(spark, odd_rows):
    import zlib

    df = make_docs(spark, [r for r in odd_rows if r[0] is not None])
    want = {(r["doc"], r["own"], r["pos"]) for r in line_dedup.dropped_lines(df).collect()}
    got = set()
    for r in line_dedup.keep_bitmaps(df).collect():
        bits = np.unpackbits(np.frombuffer(zlib.decompress(r["bits"]), "u1"))
        got |= {(r["doc"], r["own"], int(i)) for i in np.flatnonzero(bits)}
    assert got == want and got


# --- near duplicates --------------------------------------------------------------------------------


def near_brute(rows, size, percent):
    sets = []
    for doc, text in rows:
        w = words(low(text))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (a, x) in enumerate(zip(rows, sets)):
        for j in range(i):
            y = sets[j]
            if x and y and a[0] is not None and rows[j][0] is not None and 100 * len(x & y) >= percent * len(x | y):
                up[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    out = []
    for i, (r, s) in enumerate(zip(rows, sets)):
        c = min((x for x in least[find(i)] if x is not None), default=None) if s and r[0] is not None else r[0]
        out.append((r[0], len(s), c, r[0] == c))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_on_odd_rows(spark, odd_rows, size):
    got = rows_of(near_dups.near_duplicates(make_docs(spark, odd_rows), size).drop("own"))
    want = near_brute([r[:2] for r in odd_rows], size, 80)
    assert counted(got) == counted(want)
    assert len({r[2] for r in want if r[0] is not None and 40 <= r[0] < 46}) == 1, "the chain is one component"


def test_near_duplicates_find_links_beside_the_leader(spark):
    """Two tight groups whose texts are all close to each other, so buckets hold several components."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for g in range(4):
        own = list(base)
        for i in rng.choice(80, 9, replace=False):
            own[i] = f"g{g}x{i}"
        for v in range(25):
            w = list(own)
            w[int(rng.integers(80))] = f"v{g}-{v}"
            rows.append((len(rows), " ".join(w)))
    got = rows_of(near_dups.near_duplicates(make_docs(spark, rows), 2).drop("own"))
    assert counted(got) == counted(near_brute(rows, 2, 80))


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(1, 2**63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:1800]), np.unique(pool[200:2000])
    k = near_dups.registers([a, b, np.unique(np.r_[a, b])])
    assert (np.maximum(k[0], k[1]) == k[2]).all()
    got = near_dups.estimate(k[:1], k[1:2], np.array([1800.0]), np.array([1800.0]))[0]
    assert abs(got - 1600 / 2000) < 0.1


# --- repeated strings -------------------------------------------------------------------------------


def repeats_brute(rows, width):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for (doc, _), r in zip(rows, raws):
        gone = np.zeros(len(r), dtype=bool)
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(np.frombuffer(r, "u1")[~gone]) if r else b""
        out.append((doc, len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def repeats_got(df, **how):
    return [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in repeats.remove_repeats(df, **how).collect()]


@pytest.mark.parametrize("group", [repeats.GROUP, 2])
def test_repeats_on_odd_rows(spark, odd_rows, group):
    rows = [r for r in odd_rows if r[0] != 11]
    passage = " ".join(f"p{i}" for i in range(160))
    rows += [(100 + i, "x" * (7 * i) + passage[: 700 - 23 * i] + f"end {i}" * 9) for i in range(9)] + [(120, "ab" * 500), (121, "z" * 399), (122, "z" * 400)]
    got = repeats_got(make_docs(spark, rows), group=group)
    assert counted(got) == counted(repeats_brute([r[:2] for r in rows], 400))


def test_repeats_in_a_text_longer_than_a_chunk(spark):
    rng = np.random.default_rng(2)
    letters = "".join(map(chr, rng.integers(97, 123, 1_300_000)))
    text = letters + letters[600_000:601_000] + letters[1_048_100:1_049_100]
    got = repeats_got(make_docs(spark, [(1, text), (2, "y" + letters[5:700])]))
    ranges = [(5, 700), (600_000, 601_000), (1_048_100, 1_049_100), (1_300_000, 1_302_000)]
    assert {(r[0], r[2], r[3]) for r in got} == {(1, sum(b - a for a, b in ranges), 4), (2, 695, 1)}


def test_suffix_order_is_lexicographic_and_verified():
    rng = np.random.default_rng(4)
    parts = [bytes(rng.integers(97, 99, int(rng.integers(1, 40))).astype("u1")) for _ in range(200)]
    parts.sort(key=lambda x: x[0])  # two groups by first letter
    size = np.array([sum(p[0] == 97 for p in parts), sum(p[0] == 98 for p in parts)])
    m, length = repeats._padded(parts)
    order, shared, sound = repeats.suffix_order(m, length, np.r_[0, size[0]], size, 0x5851F42D4C957F2D)
    got = [parts[i] for i in order]
    assert sound and got == sorted(parts)
    for i in range(1, len(got)):
        if i != size[0]:
            k = int(shared[i])
            assert got[i][:k] == got[i - 1][:k] and got[i][k : k + 1] != got[i - 1][k : k + 1] or got[i] == got[i - 1]
    # base 0 makes all bytes after the first invisible to the hash: the check on the bytes sees it
    assert not repeats.suffix_order(m, length, np.r_[0, size[0]], size, 0)[2]


# --- quality ----------------------------------------------------------------------------------------


def base_brute(text):
    text = text or ""
    w = words(text)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {i + k for p in at.values() if len(p) > 1 for i in p for k in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_on_odd_rows(spark, odd_rows):
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (8, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(make_docs(spark, odd_rows), labels)
    got = got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = []
    for r in odd_rows:
        b = base_brute(r[1])
        failed = b[0] < 20 or 100 * b[4] > 30 * b[0]
        want.append((r[0], *b, failed, not failed))  # too few labels to certify a cutoff
    assert counted(rows_of(got)) == counted(want)


def test_quality_cutoffs_hold_their_risk(spark):
    """Good documents have few symbols; the certified cutoff rejects the bad ones and almost no good one."""
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(4000):
        good = i % 8 != 0
        n = int(rng.integers(0, 3)) if good else int(rng.integers(20, 40))
        text = " ".join(f"t{i}u{k}" + ("#" if k < n else "") for k in range(40))
        rows.append((i, text, "en" if i % 2 else None))
        labels.append((i, int(good), 0))
    lab = spark.createDataFrame([x for x in labels if x[0] < 3200], "doc_id long, quality int, toxic int")
    judged = quality.judge(make_docs(spark, rows), lab).collect()
    truth = {i: q for i, q, _ in labels}
    assert all(r["kept"] == bool(truth[r["doc_id"]]) for r in judged)


def test_quality_levels_against_brute_force(spark):
    """Paths of joint cutoffs, certified levels and rejections, recomputed with plain loops."""
    from math import comb

    rng = np.random.default_rng(12)
    rows, labels = [], []
    for i in range(3000):
        lang = ["en", "de", None, "rare"][i % 4 if i % 50 else 3] if i % 4 != 3 or i % 60 == 3 else "en"
        good = rng.random() < 0.8
        marks, caps = int(rng.poisson(1 if good else 4)), int(rng.poisson(2 if good else 7))
        text = " ".join(("T" if k < caps else "t") + f"{i}u{k}" + ("#" if k < marks else "") + ("!" if k % 7 == 0 and not good else "") for k in range(30))
        rows.append((i, text, lang))
        labels += [(i, int(good), 0)] * int(rng.integers(0, 3))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    stats = quality.stage_table(quality.statistics(make_docs(spark, rows)), "s")
    got = {r["stratum"]: (list(r["cuts"]), r["n_good"], r["good_rejected"], r["bad_rejected"]) for r in quality.cutoffs(stats, lab).collect()}
    bins = {r["doc_id"]: (r["stratum"], r["b"]) for r in stats.filter("not base_failed").selectExpr("*").withColumn("b", quality.F.array(*quality.bins())).collect()}
    truth = {d: q for d, q, _ in labels}
    strata = {s for s, _ in bins.values()}
    n_good = {s: sum(truth.get(d) == 1 for d, (t, _) in bins.items() if t == s) for s in strata}
    able = sorted((s for s in strata if 0.95 ** n_good[s] <= 0.05), key=lambda s: -n_good[s])
    able = [s for i, s in enumerate(able, 1) if 0.95 ** n_good[s] <= 0.05 / i]
    want = {}
    for s in able:
        docs = [(d, b) for d, (t, b) in bins.items() if t == s]
        best = None
        for share in quality.SHARES:
            cuts = []
            for r in range(6):
                values = sorted({b[r] for _, b in docs})
                cuts.append(next(v for v in values if sum(b[r] > v for _, b in docs) <= len(docs) * share))
            out = [d for d, b in docs if any(x > c for x, c in zip(b, cuts))]
            good, bad = (sum(truth.get(d) == q for d in out) for q in (1, 0))
            n = n_good[s]
            if sum(comb(n, j) * 0.05**j * 0.95 ** (n - j) for j in range(good + 1)) > 0.05 / len(able):
                break
            if bad > good and (best is None or bad - good > best[3] - best[2]):
                best = (cuts, n, good, bad)
        if best:
            want[s] = best
    assert got == want and len(want) >= 2 and "rare" not in want


def test_binomial_bound_is_exact(spark):
    from math import comb

    from pyspark.sql import functions as F

    for n, p, level in [(10, 0.3, 0.05), (300, 0.05, 0.01), (2000, 0.01, 0.001), (50, 0.01, 0.05)]:
        cdf, k = 0.0, -1
        for j in range(n + 1):
            cdf += comb(n, j) * p**j * (1 - p) ** (n - j)
            if cdf > level:
                break
            k = j
        got = spark.range(1).select(quality.most_rejected(F.lit(n).cast("long"), p, F.lit(level)).alias("k")).first()["k"]
        assert got == k


# --- language ---------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    got = language.language_table(read_documents(spark, DATA)).collect()
    truth = {r["doc_id"]: r["lang"] for r in read_documents(spark, DATA).collect()}
    held = [r for r in got if r["held_out"]]
    assert len(held) > 20 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_on_odd_rows(spark, odd_rows):
    df = make_docs(spark, odd_rows)
    got = {(r["doc_id"], r["lang_pred"]) for r in language.language_table(df).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (6, "und"), (7, "en"), (13, "en")} <= got
    assert sorted(language.accepted(df).columns) == sorted(df.columns)
    assert {r["doc_id"] for r in df.collect()} - {r["doc_id"] for r in language.accepted(df).collect()} == {1, 2, 3, 6}
    nothing = make_docs(spark, [(1, "some text", None)])
    assert [r["lang_pred"] for r in language.language_table(nothing).collect()] == ["und"]


def test_accepted_without_labels_and_with_texts_of_no_language(spark):
    rnd = random.Random(3)
    vocab = ["river", "stone", "winter", "garden", "market", "letter", "silver", "window", "morning", "shadow"]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    odd = [(9001, "qxzjv kqwxz vvjqk " * 9), (9002, "12 ..."), (9003, None)]
    ids = lambda rows: {r["doc_id"] for r in language.accepted(make_docs(spark, rows)).collect()}
    rows = [(i, prose(20)) for i in range(1600)]
    assert ids([(*r, "en") for r in rows] + [(*r, None) for r in odd]) == set(range(1600))
    assert ids([(*r, None) for r in rows[:9] + odd]) == {*range(9), 9001}


def test_mixture_finds_both_languages():
    rng = np.random.default_rng(8)
    words_ = np.full((300, 3), -9.0)
    words_[:180, 0] = -3 + rng.normal(0, 0.5, 180)
    words_[180:, 2] = -3 + rng.normal(0, 0.5, 120)
    pi, _ = language.proportions(words_, np.full(3, 1 / 3))
    assert np.allclose(pi, [0.6, 0, 0.4], atol=0.02)
    at, share = language.infer(words_)
    assert at == 0 and abs(share - 0.6) < 0.02


# --- language model ---------------------------------------------------------------------------------


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(9)
    net = language_model.initial(rng.integers(1, 50, 100).astype(float))
    net.data = net.data.astype(np.float64)
    net = language_model.Network(net.classes, net.data)
    net.data += rng.normal(0, 0.1, len(net.data)) * (net.data > -50)
    inputs = rng.integers(0, 100, (5, 4))
    target = rng.integers(0, 100, (5, 4))
    target[3:, 2] = -1
    h0 = rng.normal(0, 0.3, (4, language_model.HIDDEN))
    g = language_model.gradient(net, h0, inputs, target)[0].data
    for i in [*rng.choice(len(net.data), 40), *np.argsort(-np.abs(g))[:40]]:
        if net.data[i] < -50:
            continue
        old, eps = net.data[i], 1e-5
        net.data[i] = old + eps
        up = language_model.gradient(net, h0, inputs, target)[2]
        net.data[i] = old - eps
        down = language_model.gradient(net, h0, inputs, target)[2]
        net.data[i] = old
        assert abs((up - down) / (2 * eps) - g[i]) < 2e-3 * (1 + abs(g[i]))


def test_lanes_carry_the_state_through_whole_documents():
    rng = np.random.default_rng(10)
    net = language_model.initial(rng.integers(1, 50, 200).astype(float))
    net.data += rng.normal(0, 0.3, len(net.data)).astype("f4") * (net.data > -50)
    docs = [np.r_[rng.integers(1, 200, n), language_model.END].astype(np.int32) for n in (0, 1, 3, 500, 70, 64, 63, *rng.integers(1, 90, 400))]
    got = language_model.score_documents(net, docs)
    for d, value in list(zip(docs, got))[:12]:
        h, x, total = np.zeros((1, language_model.HIDDEN), np.float32), np.array([language_model.END]), 0.0
        for t in d:
            h = language_model._step(net, x, h)[0]
            total += float(language_model.output_logp(net, h, np.array([t]))[0])
            x = np.array([t])
        assert abs(total - value) < 1e-3 * max(1, abs(total))


def test_language_model_counts_and_held_out_gain(spark, odd_rows):
    import math
    import zlib

    rows = [(r["doc_id"], r["text"]) for r in read_documents(spark, DATA).collect()] + [(None if r[0] is None else r[0] + 10**6, r[1]) for r in odd_rows]
    got = language_model.score_table(make_docs(spark, rows))
    learn = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 != 0
    c = Counter()
    for d, t in rows:
        if learn(d):
            c.update([*words(low(t)), None])
    n, v = sum(c.values()), len(c)
    want = defaultdict(list)
    for d, t in rows:
        tokens = [*words(low(t)), None]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        want[d].append((d is not None and not learn(d), len(tokens), sum(w in c for w in tokens), n, round(base, 5)))
    have = defaultdict(list)
    for r in got.collect():
        have[r["doc_id"]].append((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)))
    assert {k: sorted(x) for k, x in have.items()} == {k: sorted(x) for k, x in want.items()}
    held = [r for r in got.collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def _alone(net, docs):
    """The network after one pass over `docs`, window by window, a step on all weights each; and the windows."""
    lm = language_model
    target, _, lengths = lm._streams(docs, lm.LANES)
    inputs = np.vstack([np.full((1, target.shape[1]), lm.END), np.maximum(target[:-1], lm.END)])
    w, seen, h, windows = net.data.copy(), np.full_like(net.data, 1e-2), np.zeros((target.shape[1], lm.HIDDEN), np.float32), 0
    for t in range(0, len(target), lm.WINDOW):
        goal = target[t : t + lm.WINDOW]
        g, h, _ = lm.gradient(lm.Network(net.classes, w, net.width), h, inputs[t : t + lm.WINDOW], goal)
        step = np.clip(g.data / np.sqrt(max(1, (goal >= 0).sum())), -1, 1)
        seen += step * step
        w -= lm.RATE * step / np.sqrt(seen)
        windows += 1
    return w, windows


def _shards(rng, sizes, words=200):
    return [[np.r_[rng.integers(1, words, n), language_model.END].astype(np.int32) for n in rng.integers(0, 90, size)] for size in sizes]


def test_networks_side_by_side_are_trained_as_if_alone(monkeypatch):
    rng = np.random.default_rng(12)
    start = language_model.initial(rng.integers(1, 50, 200).astype(float))
    docs = _shards(rng, (300, 3, 90))
    docs[2].append(np.r_[rng.integers(1, 200, 300), language_model.END].astype(np.int32))
    nets = [language_model.Network(start.classes, start.data.copy(), start.width) for _ in docs]
    seen = [language_model.Network(start.classes, np.full_like(start.data, 1e-2), start.width) for _ in docs]
    steps, gradient = [], language_model.stacked_gradient
    alone = [_alone(start, d) for d in docs]
    monkeypatch.setattr(language_model, "stacked_gradient", lambda *a: steps.append(len(a[1])) or gradient(*a))
    language_model.train(nets, seen, docs)
    for net, (want, _) in zip(nets, alone):
        assert np.abs(want - start.data).max() > 0.1 and np.abs(net.data - want).max() < 1e-4
    # a window is one step of all networks that still have documents
    windows = [n for _, n in alone]
    assert len(steps) == max(windows) < sum(windows) == sum(steps)


@pytest.mark.parametrize("chunk", [10**6, 400])
def test_a_task_trains_every_shard_on_all_its_documents(monkeypatch, chunk):
    from types import SimpleNamespace

    import pyarrow as pa

    rng = np.random.default_rng(13)
    start = language_model.initial(rng.integers(1, 50, 200).astype(float))
    docs = _shards(rng, (40, 1, 7, 25, 60, 12, 90))
    rows = [(s * 3, d.tobytes()) for s, shard in enumerate(docs) for d in shard]
    batches = [
        pa.RecordBatch.from_arrays([pa.array([s for s, _ in part], pa.int64()), pa.array([d for _, d in part], pa.binary())], names=["shard", "tokens"])
        for part in (rows[i : i + 11] for i in range(0, len(rows), 11))
    ]
    monkeypatch.setattr(language_model, "CHUNK_TOKENS", chunk)

    def trained(together):
        monkeypatch.setattr(language_model, "TOGETHER", together)
        out = pa.Table.from_batches(language_model._trainer(SimpleNamespace(value=start.data), start.classes, start.width)(iter(batches)))
        return out["shard"].to_pylist(), out["n"].to_pylist(), [np.frombuffer(w, np.float32) for w in out["weights"].to_pylist()]

    shards, n, alone = trained(1)
    assert shards == [0, 3, 6, 9, 12, 15, 18] and n == [sum(map(len, d)) for d in docs]
    again = trained(3)
    assert again[:2] == (shards, n) and max(np.abs(a - b).max() for a, b in zip(alone, again[2])) < 1e-4
    if chunk > 400:
        assert max(np.abs(a - _alone(start, d)[0]).max() for a, d in zip(alone, docs)) < 1e-4


def test_large_and_small_sums_of_the_softmax():
    x = np.array([[0, 200, -300], [-90, -95, -92], [1, 2, 3]], np.float32)
    goal = np.array([0, 1, 2])
    want = np.log(np.exp(x.astype(float) - x.max(axis=1, keepdims=True)).sum(axis=1)) - (x[np.arange(3), goal] - x.max(axis=1))
    assert np.allclose(language_model._exponentials(x.copy(), goal)[0], want, rtol=1e-5)


def test_language_model_learns_from_every_training_document(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{j}" for j in rng.integers(0, 50, 4))) for i in range(2600)]
    fitted = []
    fit = language_model.fit
    monkeypatch.setattr(language_model, "SHARD_DOCUMENTS", 200)
    monkeypatch.setattr(language_model, "fit", lambda *a: fitted.append(fit(*a)) or fitted[-1])
    got = language_model.score_table(make_docs(spark, rows, clashes=False)).first()
    assert fitted[0][1] == got["train_tokens"] > 11_000
    assert language_model.vocabulary_size(10**8, 10**6) == 10_000
    assert language_model.vocabulary_size(10**6, 10**6) == language_model.VOCABULARY - 2


# --- mixing and packing -----------------------------------------------------------------------------


def test_mix_on_odd_rows(spark, odd_rows):
    rows = [(*r[:2], "en", None if i % 7 == 0 else f"s{i % 4}") for i, r in enumerate(odd_rows)]
    got = mixing.mix_table(make_docs(spark, rows)).collect()
    assert counted((r["doc_id"], r["size"]) for r in got) == counted((r[0], len(words(r[1]))) for r in rows)
    source = {}
    for r in rows:
        source.setdefault(r[3], 0)
        source[r[3]] += len(words(r[1]))
    order = sorted(source, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(source.values()), {}
    while True:
        level = (total - sum(capped.values())) / sum(w for s, w in weight.items() if s not in capped)
        over = {s: 2 * source[s] for s in order if s not in capped and weight[s] * level > 2 * source[s]}
        if not over:
            break
        capped |= over
    target = {s: capped.get(s, weight[s] * level) for s in order}
    taken = defaultdict(int)
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
    for s in order:
        # repeated rows are drawn together, so a draw weighs up to two blocks here
        assert abs(taken[source[s], round(target[s], 6)] - target[s]) <= 256, s


def test_mix_shards_partition_the_draw(spark):
    rows = [(i, " ".join(["w"] * (50 + i % 700)), "en", "hot" if i % 3 else f"s{i % 5}") for i in range(1, 400)]
    sizes = mixing.stage_table(mixing.sized(make_docs(spark, rows)), "t")
    targets = mixing.source_targets(sizes)
    placed = mixing.mix(sizes, targets, block_words=40, shard_blocks=64).collect()
    again = mixing.mix(sizes, targets, block_words=40, shard_blocks=64).collect()
    assert counted(placed) == counted(again), "reruns agree"
    assert len({(r["doc_id"], r["epoch"], r["block"]) for r in placed}) == len(placed), "blocks are disjoint"
    per = Counter(r["shard"] for r in placed)
    assert max(per.values()) - min(per.values()) <= 2 + len(per).bit_length(), "shards are filled evenly"
    for s, n in per.items():
        assert sorted(r["position"] for r in placed if r["shard"] == s) == list(range(1, n + 1))


def test_mix_returns_its_placement(spark, monkeypatch):
    """Every document's blocks are in its row, each place of a shard is taken once, and the leaves equal a plain replay of the tree."""
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 4)
    rows = [(i, " ".join(["w"] * (200 + 37 * i % 1500)), "en", "hot" if i % 3 else f"s{i % 5}") for i in range(1, 300)]
    docs = make_docs(spark, rows)
    sizes = mixing.stage_table(mixing.sized(docs), "t")
    placed = mixing.mix(sizes, mixing.source_targets(sizes), shard_blocks=4).collect()
    where = {(r["doc_id"], r["epoch"], r["block"]): (r["shard"], r["position"]) for r in placed}
    assert len(set(where.values())) == len(placed)
    n_shards = len({r["shard"] for r in placed})
    assert n_shards > 2**6, "the tree was written between levels"
    assert n_shards == -(-len(placed) // 4)
    got = mixing.mix_table(docs)
    shards = mixing.mix(sizes, mixing.source_targets(sizes)).collect()
    want = Counter((r["doc_id"], r["block"], r["shard"], r["position"]) for r in shards)
    out = got.collect()
    assert Counter((r["doc_id"], *x) for r in out for x in zip(r["blocks"], r["shards"], r["positions"])) == want
    assert all(len(r["blocks"]) == len(r["shards"]) == len(r["positions"]) == r["n_blocks"] for r in out)
    again = mixing.mix_table(docs).collect()
    assert counted(out) == counted(again)


def test_tree_of_very_many_sources(spark):
    """Quotas of 3,000 sources are split over 100 shards: each source whole, each shard filled evenly."""
    q = [(i, i % 7) for i in range(3000)]
    leaves = mixing.shard_ranges(spark.createDataFrame(q, "ix long, q long"), 100).collect()
    per, shard = Counter(), Counter()
    spans = defaultdict(list)
    for r in leaves:
        per[r["ix"]] += r["n"]
        shard[r["shard"]] += r["n"]
        spans[r["ix"]].append((r["start"], r["n"]))
    assert all(per[i] == n for i, n in q)
    for s in spans.values():
        at = 0
        for start, n in sorted(s):
            assert start == at
            at += n
    assert len(shard) == 100 and max(shard.values()) - min(shard.values()) <= 8


def test_hypergeometric_draws(spark):
    from math import comb

    from pyspark.sql import functions as F

    whole, marked, drawn = 40, 13, 17
    u = (F.col("id") + 0.5) / 20000
    draw = mixing.hypergeometric(F.lit(whole), F.lit(marked), F.lit(drawn), u)
    got = Counter(r[0] for r in spark.range(20000).select(draw).collect())
    for k in range(14):
        p = comb(marked, k) * comb(whole - marked, drawn - k) / comb(whole, drawn)
        assert abs(got[k] / 20000 - p) < 2e-3


def test_mixed_documents_keep_columns(spark, odd_rows):
    df = make_docs(spark, odd_rows)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    assert max(Counter((r["doc_id"], r["text"]) for r in out.filter("doc_id <> 9").collect()).values()) <= 2


def naive_best_fit(lengths, sources, clusters, capacity):
    free, src, clu, out = [], [], [], []
    for n, s, c in zip(lengths, sources, clusters):
        fits = [b for b in range(len(free)) if free[b] >= n and c not in clu[b]]
        fits = [b for b in fits if s not in src[b]] or fits
        if fits:
            b = min(fits, key=lambda b: (free[b], b))
        else:
            b = len(free)
            free.append(capacity), src.append(set()), clu.append(set())
        out.append((b, capacity - free[b]))
        free[b] -= n
        src[b].add(s), clu[b].add(c)
    return out


def test_best_fit_equals_naive_search():
    rng = np.random.default_rng(11)
    for capacity in (16, 100):
        n = 400
        lengths = sorted(rng.integers(1, capacity + 1, n).tolist(), reverse=True)
        sources, clusters = rng.integers(0, 5, n).tolist(), rng.integers(0, 150, n).tolist()
        assert list(zip(*packing.best_fit(lengths, sources, clusters, capacity))) == naive_best_fit(lengths, sources, clusters, capacity)


def test_packing_on_odd_rows(spark, odd_rows):
    got = packing.pack(make_docs(spark, odd_rows), capacity=128).collect()
    want = Counter()
    for r in odd_rows:
        n = len(words(r[1]))
        for p in range(max(1, -(-n // 128))):
            want[r[0], n, p, min(128, n - 128 * p)] += 1
    assert Counter((r["doc_id"], r["n_words"], r["piece"], r["length"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        assert (r["bin"] is None) == (r["n_words"] == 0)
        if r["bin"] is not None:
            bins[r["bin"]].append(r)
    for held in bins.values():
        held.sort(key=lambda r: r["offset"])
        assert all(a["offset"] + a["length"] <= b["offset"] for a, b in zip(held, held[1:]))
        assert held[-1]["offset"] + held[-1]["length"] <= 128
        assert len({r["cluster"] for r in held}) == len(held), "copies never share a bin"


# --- all --------------------------------------------------------------------------------------------


def test_kept_documents_leave_one_row_of_each_group(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(1, a), (1, a), (1, a + " end"), (2, a), (None, a), (None, b), (None, b), (3, c), (3, b + " end")]
    got = sorted((r["doc_id"], r["text"][0]) for r in near_dups.kept_documents(make_docs(spark, rows)).collect())
    assert got == [(1, "a"), (3, "b"), (3, "c")]


@pytest.mark.parametrize(
    "run",
    [
        line_dedup.line_table, near_dups.near_duplicates, near_dups.kept_documents, repeats.remove_repeats, language.language_table,
        language.accepted, language_model.score_table, mixing.mix_table, mixing.mixed_documents, packing.pack,
    ],
    ids=lambda f: f.__name__,
)
def test_empty_tables(spark, run):
    assert run(make_docs(spark, [])).collect() == []


def test_quality_of_an_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(make_docs(spark, []), labels).collect() == []


def test_pairs_of_a_cell_are_judged_from_one_copy_of_each_text(spark, monkeypatch):
    """Many undecided pairs of a group: a text goes to a cell once, not once a pair."""
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(30):
        w = list(base)
        for j in rng.choice(60, int(rng.integers(1, 6)), replace=False):
            w[j] = f"own{i}-{j}"
        rows.append((i, " ".join(w)))
    docs = make_docs(spark, rows, clashes=False)
    t = near_dups.sketches(docs, 2).selectExpr("struct(doc_id as doc, high) as node", "own", "n", "regs").localCheckpoint()
    pairs = t.selectExpr("node as a").crossJoin(t.selectExpr("node as b")).filter("a.doc < b.doc").selectExpr("a", "b", "a.doc % 2 as cell")
    seen, stage = [], near_dups.stage_text

    def keep(df, name, **options):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stage(df, name, **options)

    monkeypatch.setattr(near_dups, "stage_text", keep)
    got = {(r["a"]["doc"], r["b"]["doc"]) for r in near_dups._Links(docs, t, 2, 80).similar_in_cells(pairs.localCheckpoint()).collect()}
    sets = [set(zip(t.split(), t.split()[1:])) for _, t in rows]
    want = {(i, j) for i in range(30) for j in range(i + 1, 30) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert got == want and 0 < len(want) < 435
    assert "CoGroup" in seen[-1] and "text_a" not in seen[-1]


def test_undecided_pairs_of_a_large_group_pass_no_row_a_pair(spark, monkeypatch):
    """Classes just below the threshold of each other: at most a row per class and bucket is written, not one per pair."""
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(240):
        w = list(base)
        for j in rng.choice(100, 5 if i % 40 else 1, replace=False):
            w[j] = f"own{i}-{j}"
        rows.append((i, " ".join(w)))
    counts, stages = {}, {name: getattr(near_dups, name) for name in ("stage_table", "stage_text")}

    def counting(stage):
        def run(df, name="stage", **options):
            out = stage(df, name, **options)
            counts[name] = max(counts.get(name, 0), out.count())
            return out

        return run

    for name, stage in stages.items():
        monkeypatch.setattr(near_dups, name, counting(stage))
    got = rows_of(near_dups.near_duplicates(make_docs(spark, rows), 2).drop("own"))
    assert counted(got) == counted(near_brute(rows, 2, 80))
    assert 10 < len({r[2] for r in got}) < 240
    assert max(counts.values()) <= counts["members"], counts
