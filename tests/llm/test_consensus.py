"""Consensus: known reliabilities, reversed and idle annotators, and odd inputs."""

import random

import pytest

from quire.llm.consensus import consensus, latest_answers, reliabilities

ANSWERS = "task string, item long, annotator string, value double, others string, sd string"


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(5)
    truth, rows = {}, []
    for i in range(600):
        truth[i] = rng.randint(1, 5)
        says = {f"good{k}": truth[i] if rng.random() < 0.8 else rng.randint(1, 5) for k in range(4)}
        says |= {"reverse": 6 - truth[i], "random": rng.randint(1, 5), "same": 4}
        rows += [("t", i, a, float(v), "q", "q") for a, v in says.items() if rng.random() < 0.7]
    rows += [("t", None, "good0", 1.0, "q", "q"), ("t", 1, None, 1.0, "q", "q"), ("t", 1, "good0", None, "q", "q"), ("t", 9999, "alone", 5.0, "q", "q")]
    answers = spark.createDataFrame(rows, ANSWERS)
    judges = reliabilities(answers)
    return truth, answers, judges


def test_reliabilities(judged):
    r = {x.annotator: x.reliability for x in judged[2].collect()}
    assert all(r[f"good{k}"] > 0.7 for k in range(4)) and r["reverse"] < -0.8
    assert abs(r["random"]) < 0.2 and r["same"] == 0 and r["alone"] == 0


def test_consensus_finds_the_truth(judged):
    truth, answers, judges = judged
    rows = {x.item: x for x in consensus(answers, judges).collect()}
    known = [i for i in truth if i in rows and rows[i].consensus is not None]
    assert sum((rows[i].consensus >= 2.5) == (truth[i] >= 3) for i in known) / len(known) > 0.95
    assert rows[9999].consensus is None and rows[9999].agreement is None


def test_latest_answer_counts(spark):
    rows = [(1, "a", 1, 2, 3), (1, "a", 2, 4, 5), (1, "a", 2, 4, 4), (2, "a", 1, 1, 1)]
    df = spark.createDataFrame(rows, "c long, j string, at int, u int, v int")
    got = {(r.task, r.item): r.value for r in latest_answers(df, "c", "j", "at", {"u": "u", "v": "v"}).collect()}
    assert got == {("u", 1): 4.0, ("v", 1): 5.0, ("u", 2): 1.0, ("v", 2): 1.0}


def test_no_answers(spark):
    empty = spark.createDataFrame([], ANSWERS)
    judges = reliabilities(empty)
    assert judges.collect() == [] and consensus(empty, judges).collect() == []


def test_reliabilities_fit_each_pairs_own_overlap(judged):
    import numpy as np

    from quire.llm.consensus import SHRINK

    _, answers, judges = judged
    rows = [r for r in answers.collect() if None not in (r.item, r.annotator, r.value)]
    found = {r.annotator: r for r in judges.collect() if r.sd > 1e-9 and r.overlap > 0}
    names = sorted(found)
    z = {(r.item, r.annotator): (r.value - found[r.annotator]["mean"]) / found[r.annotator].sd for r in rows if r.annotator in found}
    items = sorted({i for i, _ in z})
    m = np.array([[z.get((i, a), np.nan) for a in names] for i in items])
    there = ~np.isnan(m)
    m = np.nan_to_num(m)
    s, n = m.T @ m, (there.T.astype(float) @ there)
    np.fill_diagonal(s, 0)
    np.fill_diagonal(n, 0)
    r = np.array([found[a].reliability for a in names])
    fit = (s @ r) / (n @ (r * r) + SHRINK)
    assert np.abs(r - np.clip(fit, -0.99, 0.99)).max() < 0.01


def test_unsettled_reliabilities_raise(judged):
    with pytest.raises(RuntimeError):
        reliabilities(judged[1], most_steps=1, tolerance=1e-12).collect()
