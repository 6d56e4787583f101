import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names the operators use inside, as extra columns of the input
CLASHES = "row r kept size copies digest hash own bits words n key shard component label lang_pred score doc".split()


def make_docs(spark, rows, clashes=True):
    """(doc_id, text[, lang[, source]]) rows as documents, with extra columns of clashing names."""
    full = [(r[0], r[1], *(list(r[2:]) + ["en", "s0"][len(r) - 2 :]), None) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    if clashes:
        for c in CLASHES:
            df = df.selectExpr("*", f"'x' as `{c}`")
    return df


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, wordless, tied, repeated and long texts, null ids, languages and sources."""
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    line = "This line is shared by a good many documents of the table."
    shared = prose(120)
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "Word"), (6, "12 34 ..."),
        (7, shared), (8, shared.upper()), (9, shared), (9, shared), (10, shared + " tail"), (None, shared), (None, prose(30)),
        (11, prose(40000)), (12, "a " * 900), (13, "É" * 450), (14, "É" * 450),
        (15, prose(60), None, None), (16, prose(60), None, "s1"), (17, "x\x1cy\xa0z " * 30), (17, prose(25)),
    ]
    rows += [(20 + i, f"{prose(30)}\n  {line.upper() if i % 2 else line}\t\n{prose(5)}\n{line}") for i in range(7)]
    # a chain: neighbours are similar, the ends are not
    base = prose(100).split()
    for i in range(6):
        rows.append((40 + i, " ".join(base[: 100 - 6 * i] + [f"new{j}" for j in range(6 * i)])))
    return rows
