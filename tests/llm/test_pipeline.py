"""The pipeline against brute force on a small fixture."""

import random

import pytest

import corpus_pipeline
from loomsearch.llm import mixing

from .test_operators import brute_near


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rng = random.Random(12)
    english = "the of and to in that was his with they which from have this".split()
    german = "der die und das nicht ist mit ein sich auch werden über für".split()
    rows = []
    for k in range(60):
        base = rng.choices(english if k % 3 else german, k=rng.randint(40, 120))
        lang = "en" if k % 3 else "de"
        for copy in range(rng.choice((1, 1, 2, 3))):
            words = list(base)
            if copy == 2:
                words[rng.randrange(len(words))] = "changed"
            rows.append([len(rows), " ".join(words), lang, f"s{k % 4}", 0])
    rows += [[len(rows) + i, t, None, "s9", 0] for i, t in enumerate((None, "", "12 !!"))]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{path}/documents.parquet")
    out, docs = [spark.read.parquet(f"{path}/documents.parquet").collect()], spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        docs.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        out.append(docs.collect())
    return out


def test_language_and_exact(stages):
    start, known, exact, *_ = stages
    assert {r.doc_id for r in known} == {r.doc_id for r in start if r.text and any(c.isalpha() for c in r.text)}
    best = {}
    for r in known:
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(best.values()) and set(exact) <= set(known)


def test_near(stages):
    exact, near = stages[2], stages[3]
    ordered = sorted(exact, key=lambda r: r.doc_id)
    groups = brute_near([r.text for r in ordered], 80)  # no contract sets the stage another threshold
    assert sorted(r.doc_id for r in near) == sorted(r.doc_id for k, r in enumerate(ordered) if groups[k][1] == k) and set(near) <= set(exact)
    assert len(near) < len(exact)


def test_mix_and_tokens(stages):
    near, mixed, tokens = stages[3:]
    assert set(mixed) <= set(near)
    size = lambda rows: {s: sum(len(r.text.split()) for r in rows if r.source == s) for s in {r.source for r in near}}
    have, got = size(near), size(mixed)
    longest = max(len(r.text.split()) for r in near)
    total, names = sum(have.values()), sorted(have)
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        left = total - sum(3 * have[s] for s in capped)
        target = {s: 3 * have[s] if s in capped else weight[s] * left / sum(weight[x] for x in names if x not in capped) for s in names}
        over = {s for s in names if target[s] > 3 * have[s]}
        if not over:
            break
        capped |= over
    assert all(abs(got[s] - target[s]) <= longest / 2 + 1 for s in names)
    assert len(tokens) == len(mixed) and all(r.round_trip for r in tokens)
    assert sorted(r.doc_id for r in tokens) == sorted(r.doc_id for r in mixed)


def test_entry_lists_the_pipeline():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert names["pipeline"] is corpus_pipeline.run and {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in names if k.startswith("op")}
