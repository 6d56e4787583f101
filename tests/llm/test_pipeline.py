"""The pipeline's stages, and what each does to planted rows."""

import random

import corpus_pipeline
from riskframe.session import stage_table
from tests.conftest import DATA
from tests.llm.conftest import make_docs


def test_stages_act_on_planted_rows(spark):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(4000)]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    line = "Subscribe to our newsletter for more of the same stories."
    rows = [(i, prose(60) + ("\n" + line if i < 8 else ""), "en", f"s{i % 3}") for i in range(60)]
    near = rows[30][1].split()
    near[10] = "changed"
    rows += [(100, rows[20][1], "en", "s0"), (101, " ".join(near), "en", "s1"), (102, None, "en", "s0"), (103, "123 456", "en", "s1"), (104, line, "en", "s2")]
    docs = make_docs(spark, rows)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage_table(stage(spark, docs, DATA), name)
        seen[name] = docs.collect()
        if name != "pack":
            assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {k: {r["doc_id"] for r in v} for k, v in seen.items()}
    clean = set(range(60))
    assert ids["language"] == clean | {100, 101, 104}
    assert ids["lines"] == clean | {100, 101, 104}
    assert [r["doc_id"] for r in seen["lines"] if line in r["text"]] == [104]
    assert all(r["n_chars"] == len(r["text"]) for r in seen["lines"])
    assert ids["near_dups"] == clean | {104}
    assert ids["mix"] <= ids["near_dups"]
    assert {r["doc_id"] for r in seen["pack"]} == ids["mix"]
    total = sum(len(r["text"].split()) for r in seen["near_dups"])
    assert abs(sum(len(r["text"].split()) for r in seen["mix"]) - 1.5 * total) < 0.1 * total


def test_run_on_the_smallest_tables(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert "doc_id" in out.columns and out.count() > 100


def test_empty_table(spark):
    docs = make_docs(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = stage_table(stage(spark, docs, DATA), name)
    assert docs.count() == 0
