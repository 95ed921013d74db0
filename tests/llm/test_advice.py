"""What the review of round 1 found missing."""

import random
import re

import numpy as np

import corpus_pipeline
from loomsearch.llm import minhash, secrets, vector_dedup

from .test_operators import by_id, docs


# 1

def guessed(text):
    return [text[s:e] for k, s, e in secrets.scan(text)[1] if k == "guess"]


def test_secret_needs_no_digit():
    """The guess cost decides: values without a digit, or with signs of templates inside, count; prose and whole templates don't."""
    for text, value in (("password: hG$kd9Lq2x", "hG$kd9Lq2x"), ("pwd=Kf7%Zq2mLp9w", "Kf7%Zq2mLp9w"), ("passphrase: kXqZvBnMwPlRtY", "kXqZvBnMwPlRtY")):
        assert guessed(text) == [value]
    for value in ("authentication", "necessarily", "uncharacteristically", "documentation.", "configuration", "${DB_PASSWORD_XQZ7}", "{{vault_zx7Kq2mLp9}}", "%APP_XQZ7KP2M%", "****************", "your_password_here"):
        assert guessed(f"the password is {value}") == [], value


def test_secret_contexts():
    """Names that end in a credential's name, and Authorization headers; a name within a word introduces nothing."""
    for text in ("DB_PWD=x7Kp2mQ9vL", "DB_PASSWORD=x7Kp2mQ9vL", "my-pwd: x7Kp2mQ9vL", "a_token => x7Kp2mQ9vL", '"Authorization": "Basic x7Kp2mQ9vL"', "curl -H 'authorization: bearer  x7Kp2mQ9vL'", "my pwd is x7Kp2mQ9vL"):
        assert guessed(text) == ["x7Kp2mQ9vL"], text
    assert guessed("Authorization: Bearer x7Kp2mQ9vLtR4wZs") == ["x7Kp2mQ9vLtR4wZs"]
    for text in ("spin: x7Kp2mQ9vL", "x9pwd=x7Kp2mQ9vL", "basic understanding", "the bearer necessarily"):
        assert guessed(text) == [], text


# 5

def test_vectors_dense_family(spark):
    """A label with a shared mean direction and a dense family: single vectors that link with one member each all join."""
    rng = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    family = unit(unit(rng.standard_normal(64)) + unit(rng.standard_normal((1200, 64))) * 0.2)
    away = rng.standard_normal((60, 64))
    away = unit(away - (away * family[:60]).sum(axis=1, keepdims=True) * family[:60])
    x = np.concatenate([family, 0.932 * family[:60] + np.sqrt(1 - 0.932**2) * away, unit(rng.standard_normal((800, 64)))]).astype(np.float32)
    df = spark.createDataFrame([(k, v, 0) for k, v in enumerate(x.tolist())], "vec_id bigint, embedding array<float>, label int")
    got = by_id(vector_dedup.assign(df), "vec_id")
    y = unit(x.astype(float))
    want = (y @ y.T >= 0.93).sum(axis=1) - 1
    assert {got[k].component_id for k in range(1260)} == {0}
    assert [got[k].n_links for k in range(len(x))] == want.tolist()


# 10

def brute_near_at(texts, percent):
    """The least document of each one's component, as by_id would have it."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))})
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in range(len(sets))}


def test_near_at_80(spark):
    """The stage links from 0.80 on, op10 from 0.85 on, and nothing is missed at either."""
    rng = random.Random(21)
    texts = []
    for k in range(40):
        base = [f"w{rng.randrange(500)}" for _ in range(54)]
        for copy in range(4):  # one word of 54: 45 of 55 shingles stay, 0.82
            words = list(base)
            if copy:
                words[rng.randrange(5, 49)] = f"e{k}x{copy}"
            texts.append(" ".join(words))
        texts.append(" ".join(base[:-6] + [f"n{k}x{i}" for i in range(6)]))
    rng.shuffle(texts)
    rows = docs(spark, texts)
    loose, strict = brute_near_at(texts, 80), brute_near_at(texts, 85)
    assert len(set(loose.values())) < len(set(strict.values()))
    assert {k: r.component_id for k, r in by_id(minhash.assign(rows, percent=80)).items()} == loose
    assert {k: r.component_id for k, r in by_id(minhash.assign(rows)).items()} == strict
    assert {r.doc_id for r in corpus_pipeline.near(spark, rows, "").collect()} == set(loose.values())


def test_near_scheme():
    """Bands and signature test lose next to nothing at the threshold."""
    rng = random.Random(5)
    for percent in (80, 85):
        rows, need = minhash.scheme(percent)
        p = percent / 100
        assert (1 - p**rows) ** (minhash.MINIMA // rows) < 1e-6
        lost = sum(sum(rng.random() < p for _ in range(minhash.MINIMA)) < need for _ in range(5000))
        assert lost <= 1
    assert minhash.scheme(85) == (5, 84)
