"""Items that appear together, and mixtures of sources, against brute force."""

import itertools
import random
from collections import Counter

import pytest

from quire.llm.mixing import mixture, shares
from quire.llm.pairs import pairs_with_lift

RECORDS = "kind string, record string, items array<string>, n long, basket string"


def brute(rows, least, lift):
    per = {}
    for kind, rec, items, *_ in rows:
        if rec is not None:
            got = {i for i in items or [] if i is not None}
            if got:
                per.setdefault(kind, {}).setdefault(rec, set()).update(got)
    out = {}
    for kind, recs in per.items():
        n, c, p = len(recs), Counter(), Counter()
        for s in recs.values():
            c.update(s)
            p.update(itertools.combinations(sorted(s), 2))
        for (a, b), k in p.items():
            if k >= least and k * n >= lift * c[a] * c[b]:
                out[kind, a, b] = (k, c[a], c[b], n)
    return out


def test_pairs_match_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for r in range(300):
        base = ["a1", "a2", "a3"] if r % 20 == 0 else []
        rows.append(("x", f"r{r}", base + ["hot"] + [f"i{rng.randint(0, 40)}" for _ in range(rng.randint(0, 4))] + [None], 1, "z"))
    rows += rows[:30] + [("x", None, ["a1", "a2"], 1, "z"), ("x", "e1", None, 1, "z"), ("x", "e2", [], 1, "z"), ("y", "r1", ["a1", "a2"], 1, "z")]
    got = {(r.kind, r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in pairs_with_lift(spark.createDataFrame(rows, RECORDS), 4, 6.0).collect()}
    assert got == brute(rows, 4, 6.0) and ("x", "a1", "a2") in got


def test_no_records_give_no_pairs(spark):
    assert pairs_with_lift(spark.createDataFrame([], RECORDS)).collect() == []


DOCS, TARGETS = "doc_id long, source string, n_tokens long, h string", "source string, target_share double, max_repeats int, copies int"


def sizes(out):
    c = Counter()
    for r in out:
        c[r.source] += r.n_tokens * r.copies
    return c


@pytest.mark.parametrize("total", [None, 5000])
def test_mixture_keeps_shares_and_caps(spark, total):
    rng = random.Random(1)
    docs = [(i, "big", rng.randint(1, 20), "q") for i in range(3000)] + [(10_000 + i, "small", rng.randint(1, 20), "q") for i in range(40)]
    docs += [(20_000, None, 50, "q"), (20_001, "stray", 50, "q"), (20_002, "big", 0, "q")]
    targets = [("big", 0.8, 1, 0), ("small", 0.2, 3, 0), ("absent", 0.1, 2, 0), (None, 0.5, 2, 0)]
    d, t = spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS)
    out = mixture(d, t, total).collect()
    got, there = sizes(out), Counter()
    for _, s, n, _h in docs:
        there[s] += n
    assert set(got) <= {"big", "small"} and max(r.copies for r in out if r.source == "small") <= 3
    assert max((r.copies for r in out if r.source == "big"), default=0) == 1
    most = max(n for _, _, n, _ in docs)
    whole = total or there["small"] * 3 * 1.0 / 0.2
    assert abs(got["big"] - min(0.8 * whole, there["big"])) <= most
    assert abs(got["small"] - min(0.2 * whole, 3 * there["small"])) <= most or total
    rows = {r.source: r for r in shares(d, t, mixture(d, t, total)).collect()}
    assert rows["absent"].tokens_drawn == 0 and rows["stray"].tokens_drawn == 0 and None in rows
    assert abs(sum(r.actual_share for r in rows.values()) - 1) < 1e-9


def test_smaller_totals_are_nested(spark):
    rng = random.Random(2)
    d = spark.createDataFrame([(i, "s", rng.randint(1, 9), "q") for i in range(500)], DOCS)
    t = spark.createDataFrame([("s", 1.0, 1, 0)], TARGETS)
    few, many = ({r.doc_id for r in mixture(d, t, x).collect()} for x in (300, 900))
    assert few and few < many


def test_mixture_of_nothing(spark):
    d, t = spark.createDataFrame([], DOCS), spark.createDataFrame([("s", 1.0, 1, 0)], TARGETS)
    assert mixture(d, t).collect() == [] and mixture(d, spark.createDataFrame([], TARGETS)).collect() == []
    assert [r.tokens_drawn for r in shares(d, t, mixture(d, t)).collect()] == [0]
