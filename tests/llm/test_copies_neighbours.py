"""Near copies and nearest vectors against brute force."""

import random
import re

import numpy as np
import pytest

from quire.llm import near_copies, neighbours
from quire.llm.near_copies import classes_and_links, record_pairs
from quire.llm.neighbours import similar_vectors

PAPERS = "work string, title string, abstract string, key string, cls string"


def texts(seed=1, n=120):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(n):
        words = [rng.choice(common) if rng.random() < 0.7 else f"r{rng.randint(0, 900)}" for _ in range(rng.randint(15, 70))]
        rows.append((f"W{i:03}", f"Title {i % 7}", " ".join(words)))
    for i in range(60):
        _, t, a = rows[rng.randrange(n)]
        words = a.split()
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 99)}"
        rows.append((f"X{i:03}", t if i % 2 else None, "  ".join(words[: len(words) - i % 5]).upper()))
    rows += [("N1", None, None), ("N2", "only title " * 20, ""), (None, "x", "y " * 40), ("L1", "long", "w1 w2 w3 " * 9000), ("L2", "long", "w1 w2 w3 " * 9000), ("S1", "t", "a " * 25), ("S2", "t", "a " * 30)]
    return rows + rows[:9]


def brute(rows, t=0.5):
    sets = {}
    for w, title, a in rows:
        if w and a and len(re.findall(r"[^\W_]+", a.lower())) >= 20:
            x = re.findall(r"[^\W_]+", f"{title or ''} {a}".lower())
            sets.setdefault(w, set()).add(frozenset(zip(x, x[1:], x[2:])))
    ks = sorted(sets)
    return {(a, b) for i, a in enumerate(ks) for b in ks[i + 1 :] if any(len(x & y) >= t * len(x | y) for x in sets[a] for y in sets[b])}


@pytest.mark.parametrize("t", [0.5, 0.8])
def test_pairs_are_exact(spark, t):
    rows = texts()
    df = spark.createDataFrame([(*r, "q", "q") for r in rows], PAPERS)
    got = {(r.key_a, r.key_b) for r in record_pairs(*classes_and_links(df, "work", "title", "abstract", similarity=t)).collect()}
    assert got == brute(rows, t) and ("L1", "L2") in got


def test_frequent_ngrams_are_met_in_parts(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "HOT", 3)
    monkeypatch.setattr(near_copies, "PER_SHARD", 5)
    rows = texts(seed=3) + [(f"T{i:02}", "template", " ".join(f"t{k}" for k in range(40)) + f" x{i} y{i} z{i}") for i in range(25)]
    df = spark.createDataFrame([(*r, "q", "q") for r in rows], PAPERS)
    got = {(r.key_a, r.key_b) for r in record_pairs(*classes_and_links(df, "work", "title", "abstract")).collect()}
    assert got == brute(rows) and ("T00", "T24") in got


def test_large_classes_are_stars(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "EXPANDED", 3)
    rows = [(f"W{i}", "t", "some words " * 15 + "end") for i in range(6)]
    df = spark.createDataFrame([(*r, "q", "q") for r in rows], PAPERS)
    got = {(r.key_a, r.key_b) for r in record_pairs(*classes_and_links(df, "work", "title", "abstract")).collect()}
    assert got == {("W0", f"W{i}") for i in range(1, 6)}


def test_no_texts(spark):
    members, links = classes_and_links(spark.createDataFrame([], PAPERS), "work", "title", "abstract")
    assert members.collect() == [] and links.collect() == []


def vectors(seed=2, n=400, dims=32):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    for i in range(0, n, 4):
        x[i + 1 : i + 4] = x[i] + 0.2 * rng.normal(size=(3, dims))
    return x.astype(np.float32)


VECTORS = "node string, vector array<float>, v string, shard string"


@pytest.mark.parametrize("members", [20_000, 60])
def test_recall_against_brute_force(spark, monkeypatch, members):
    monkeypatch.setattr(neighbours, "MOST_MEMBERS", members)  # at 60 shards are split
    monkeypatch.setattr(neighbours, "PER_CENTRE", 50)
    x = vectors()
    rows = [(f"n{i:04}", [float(v) for v in r], "q", "q") for i, r in enumerate(x)]
    nan = float("nan")
    rows += rows[:5] + [("bad1", None, "q", "q"), ("bad2", [], "q", "q"), ("bad3", [0.0] * 32, "q", "q"), ("bad4", [nan] * 32, "q", "q"), ("bad5", [1.0] * 31, "q", "q"), (None, [1.0] * 32, "q", "q"), ("big", [1e30] * 32, "q", "q")]
    got = {(r.key_a, r.key_b): r.similarity for r in similar_vectors(spark.createDataFrame(rows, VECTORS), "node", "vector", k=3, dims=32, least=0.8).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    truth = {(f"n{i:04}", f"n{j:04}") for i in range(len(x)) for j in np.argsort(-s[i])[:3] if s[i, j] >= 0.8}
    assert len(truth & set(got)) / len(truth) >= 0.9 and not any(k.startswith("bad") for p in got for k in p)
    assert all(abs(v - s[int(a[1:]), int(b[1:])]) < 1e-5 for (a, b), v in got.items())


def test_few_or_no_vectors(spark):
    one = spark.createDataFrame([("a", [1.0, 2.0], "q", "q")], VECTORS)
    assert similar_vectors(one, "node", "vector", dims=2).collect() == []
    assert similar_vectors(one.limit(0), "node", "vector", dims=2).collect() == []
    two = spark.createDataFrame([("a", [1.0, 2.0], "q", "q"), ("b", [1.0, 2.0], "q", "q")], VECTORS)
    assert {(r.key_a, r.key_b, r.place) for r in similar_vectors(two, "node", "vector", dims=2).collect()} == {("a", "b", 1), ("b", "a", 1)}


def test_similar_vectors_meet_among_many_centres(spark, monkeypatch):
    from quire.llm import neighbours as N

    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 64)) + 0.5 * rng.normal(size=(4, 64))[np.arange(1200) % 4]
    y = x + 0.62 * rng.normal(size=x.shape)
    v = np.concatenate([x, y]).astype(np.float32)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, i + 1200) for i in range(1200) if unit[i] @ unit[i + 1200] >= 0.8}
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id int, v array<float>").repartition(4).cache()
    monkeypatch.setattr(N, "PER_CENTRE", 4)
    found = {(r.key_a, r.key_b) for r in N.similar_vectors(df, "id", "v", k=5, dims=64, least=0.8).collect()}
    lost = len(want - found) / len(want)
    assert len(want) > 800 and lost < 0.045, lost  # three shards for all lose 0.073
