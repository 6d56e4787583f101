"""Secret scan, conversation repair and periodic runs against brute force, on odd rows and on the smallest table."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from riskframe.llm import conversations, periodic, secret_scan
from riskframe.llm.common import read_documents
from tests.conftest import DATA
from tests.llm.conftest import make_docs
from tests.llm.test_documents import counted, rows_of, words


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- secrets ----------------------------------------------------------------------------------------

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def secrets_brute(rows):
    """(doc_id, text, owner) rows to results, by all matches and sets of owners."""
    found, owners = [], defaultdict(set)
    for doc, text, owner in rows:
        text = text or ""
        spans = [(m.start(), "assign", m.end(), m[2]) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m[2]) >= 6]
        spans += [(m.start(), "access", m.end(), m[0]) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), "hex", m.end(), m[0]) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        more = []
        for m in re.finditer(r"[A-Za-z0-9_-]+", text):
            mixed = re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0])
            clear = all(m.end() <= s or e <= m.start() for s, _, e, _ in spans)
            if len(m[0]) >= 20 and mixed and clear and len(set(m[0])) >= 10:
                more.append((m.start(), "owned", m.end(), m[0]))
        found.append((doc, spans, more))
        for *_, value in spans + more:
            owners[value].add(owner)
    kinds = ["assign", "access", "hex", "owned"]
    join = lambda spans: ",".join(f"{k}:{s}:{e}" for s, k, e, _ in sorted(spans, key=lambda x: (x[0], kinds.index(x[1]))))
    out = []
    for doc, spans, more in found:
        n = [sum(k == kind for _, k, _, _ in spans) for kind in kinds[:3]]
        alive = lambda v: len(owners[v]) == 1 and len(set(v)) >= 10 and bool(re.search("[0-9]", v)) and bool(re.search("[A-Za-z]", v))
        mine = [s for s in more if alive(s[3])]
        live = sum(alive(s[3]) for s in spans + more)
        wide = sum(len(owners[s[3]]) >= 3 for s in spans + more)
        out.append((doc, *n, sha(join(spans)), join(spans + mine), len(mine), live, wide))
    return out


def test_secrets_on_planted_rows(spark, odd_rows):
    rnd = random.Random(3)
    key = lambda n=32: "".join(rnd.choice("abcdefghijkmnopqrstuvwxyzABCDEFGH0123456789_-") for _ in range(n))
    copied, mine, example = key(), key(), "AKIA" + "EXAMPLE0" * 3
    rows = [(r[0], r[1], r[3] if len(r) > 3 else "s0") for r in odd_rows]
    for i in range(6):
        rows.append((100 + i, f"é call({copied}) then {example} {mine if i == 2 else key(19)}", f"owner{i}"))
    rows += [
        (200, f"{mine} again {mine}", "owner2"), (201, None, None), (202, f"api_key = '{key()}'\nAPIKEY:{key(5)}x", None),
        (203, "token: token:abcdefg password=\"Zażółć\" PASSWD:'x1y2z3' ſecret=abcdef1 secret =   abcdef2", "owner9"),
        (204, "0123456789abcdef01234567" * 3 + " " + "f" * 24 + " AKIAKIA" + "Q" * 17, "owner9"), (205, key(25), None), (206, "a" * 200_000 + "1B", "o"),
        (207, " ".join(key() for _ in range(3000)), "owner7"),
    ]
    docs = make_docs(spark, [(d, t, "en", s) for d, t, s in rows])
    got = secret_scan.scan_secrets(docs)
    want = secrets_brute(rows)
    assert counted(rows_of(got)) == counted(want)
    spans = {r["doc_id"]: r for r in got.collect()}
    assert spans[102]["n_owned"] == 1 and spans[200]["n_owned"] == 2 and spans[207]["n_owned"] > 2900
    assert all(spans[100 + i]["n_copied"] == 2 for i in range(6))


def test_secrets_with_joins_by_shuffle(spark, monkeypatch):
    rnd = random.Random(4)
    values = ["".join(rnd.choice("abcdefgABCDEFG0123456789") for _ in range(24)) for _ in range(40)]
    rows = [(i, " ".join(rnd.choice(values[: 1 + i % 40]) for _ in range(4)), f"s{i % 7}") for i in range(300)]
    monkeypatch.setattr(secret_scan, "local_if_small", lambda df: df)
    docs = make_docs(spark, [(d, t, "en", s) for d, t, s in rows])
    assert counted(rows_of(secret_scan.scan_secrets(docs))) == counted(secrets_brute(rows))
    assert secret_scan.scan_secrets(docs.limit(0)).collect() == []


# --- conversations ----------------------------------------------------------------------------------


def damage_brute(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        act = zlib.crc32(key.encode()) % 20
        out[conv]
        if act == 0:
            continue
        text = "" if act == 1 else re.sub("[.!?]", "", text) if act == 2 else text
        out[conv] += [(turn, "user" if act == 4 else role, text)] * (2 if act == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, *x[1:])) for c, r in out.items()}


def repair_brute(rows):
    out = []
    for conv, said in damage_brute(rows).items():
        seen, faults = set(), []
        for _, role, text in said:
            inner = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not inner else "duplicate" if (role, text) in seen else "" if inner[-1] in ".!?" else "truncated")
            seen.add((role, text))
        # best (cost, audit, lines) from each state to the end, from the last row to the first
        step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
        add = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}

        def inserted(best):
            for _ in range(4):
                for s, (name, to) in add.items():
                    if best.get(to):
                        c, a, lines = best[to]
                        best[s] = min(best.get(s) or (10**9,), (c + 5, "I" + a, (f"{name}:", *lines)))
            return best

        best = inserted({0: (0, "", ()), 3: (0, "", ())})
        for (_, role, text), fault in zip(reversed(said), reversed(faults)):
            now = {}
            for s in range(4):
                options = [(best[s][0] + 2, "D" + best[s][1], best[s][2])]
                if fault in ("", "truncated"):
                    more = 5 * (fault == "truncated")
                    if (s, role[:1]) in step:
                        c, a, lines = best[step[s, role[:1]]]
                        options.append((c + more, "K" + a, (f"{role}:{text}", *lines)))
                    name, to = add[s]
                    c, a, lines = best[to]
                    options.append((c + 1 + more, "R" + a, (f"{name}:{text}", *lines)))
                now[s] = min(options)
            best = inserted(now)
        turns = {t for t, _, _ in said if t is not None}
        initials = [r[:1] for _, r, _ in said]
        cost, audit, lines = best[0]
        out.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, sha("\n".join(lines)),
        ))
    return out


def talk(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in "conv at block key kind copy dropped fault first edits act".split():
        df = df.selectExpr("*", f"'x' as `{c}`")
    return df


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_conversations_on_odd_rows(spark, block):
    rnd = random.Random(block)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "u2", "Assistant"]
    texts = ["Yes.", "No!", "cut", "", " \t", None, "é?", "Why?\n", "same.", "\xa0", "x" * 5000 + "."]
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rnd.randrange(1, 30)):
            rows.append((conv, rnd.choice([turn, turn, turn, turn + 3, None]), rnd.choice(roles[: rnd.choice([2, 5, 10])]), rnd.choice(texts)))
    rows += rows[:40]  # repeated rows
    rows += [(900, t, "user" if t % 2 else "assistant", f"line {t}.") for t in range(400)]  # goes on over many blocks
    rows += [(901, 0, "user", "only.")] * 3 + [(902, None, None, None)]
    rows += [(1000 + i, 0, "user", "x.") for i in range(60)]  # some lose their only row
    rnd.shuffle(rows)
    got = rows_of(conversations.repair(talk(spark, rows), block))
    assert counted(got) == counted(repair_brute(rows))
    assert conversations.repair(talk(spark, []), block).collect() == []


def test_conversations_of_the_smallest_table(spark):
    rows = spark.read.parquet(f"{DATA}/conversations.parquet")
    assert counted(rows_of(conversations.repair(rows, 50))) == counted(repair_brute(rows_of(rows.select("conv_id", "turn", "role", "text"))))


def test_least_audit_wins_ties():
    """Costs tie between deleting either of two rows; the audit that is less in ASCII order is taken."""
    kinds = np.array([3, 3, 6])  # user, user, assistant, all without a fault
    edits = conversations.least_paths(kinds, np.array([0]), np.array([3]), conversations.FINAL[None], np.array([True]), 1)
    assert "".join(edits[0]) == "DKK"


# --- periodic runs ----------------------------------------------------------------------------------


def runs_brute(x):
    out = {}
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + (j == i)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def test_runs_of_small_alphabets():
    rnd = random.Random(1)
    for _ in range(400):
        x, letters = [], rnd.choice([1, 2, 3, 5, 30])
        while len(x) < rnd.randrange(120):
            piece = [rnd.randrange(letters) for _ in range(rnd.randrange(1, 9))]
            x += piece if rnd.random() < 0.5 else (piece * rnd.randrange(2, 7))[: rnd.randrange(4, 40)]
        assert periodic.find_runs(np.array(x, dtype=np.int64)) == runs_brute(x)


def test_transform_finds_every_occurrence():
    rnd = np.random.default_rng(2)
    for size in (1, 2, 8, 64):
        ids = np.r_[rnd.integers(0, 2, 40 * size), np.full(3 * size, 5)]
        ids[::7] *= 1_000_003  # large numbers take more than one prime
        blocks = np.arange(40) * size
        got = set(zip(*(a.tolist() for a in periodic.zero_mismatch(ids, blocks, size))))
        want = {(int(b), d) for b in blocks for d in range(size, 2 * size) if (ids[b : b + size] == ids[b + d : b + d + size]).all()}
        assert got == want


def table_brute(rows):
    out = []
    for doc, text in rows:
        w = words(text)
        n, h = len(w), 1 if doc is None else zlib.crc32(str(doc).encode())
        if h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = runs_brute(w) if len(set(w)) < n else []
        drop = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        milli = 1000 * best[1] // best[2] if runs else None
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        out.append((doc, len(runs), *best, milli, sha(listed), sha(" ".join(x for i, x in enumerate(w) if i not in drop))))
    return out


def test_runs_on_odd_rows(spark, odd_rows):
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(40)]
    rows = [(r[0], r[1]) for r in odd_rows if len(r[1] or "") < 100_000]
    for i in range(60):
        piece = [rnd.choice(vocab) for _ in range(rnd.randrange(1, 120))]
        rows.append((500 + i, " ".join([rnd.choice(vocab) for _ in range(i)] + piece * rnd.randrange(3, 7) + piece[: len(piece) // 2])))
    assert counted(rows_of(periodic.run_table(make_docs(spark, rows)))) == counted(table_brute(rows))
    assert periodic.run_table(make_docs(spark, rows).limit(0)).collect() == []


def test_a_very_long_text(spark):
    """300,000 words with one run of a long period, taken in one piece."""
    rnd = random.Random(9)
    piece = [f"w{rnd.randrange(10**6)}" for _ in range(50_000)]
    rows = [(7, " ".join(["x"] * 9 + [f"y{i}" for i in range(20_000)] + piece * 5))]
    got = rows_of(periodic.run_table(make_docs(spark, rows)))[0]
    assert got[1:6] == (2, 20_009, 250_000, 50_000, 5000)


def test_smallest_table(spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in read_documents(spark, DATA).collect()]
    assert counted(rows_of(periodic.run_table(read_documents(spark, DATA)))) == counted(table_brute([r[:2] for r in rows]))
    assert counted(rows_of(secret_scan.scan_secrets(read_documents(spark, DATA)))) == counted(secrets_brute(rows))
