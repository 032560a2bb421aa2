"""Encoding against the public library, and the line model."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.bpe import ByteBpe, merged
from quire.llm.stuffing import line_shares, stuffed_pages
from quire.llm.tokens import TOKENIZERS, VOCABULARY, token_counts, token_ids


@pytest.fixture(scope="module")
def pair():
    tokenizers = pytest.importorskip("tokenizers")
    ours = ByteBpe(open(os.path.join(TOKENIZERS, VOCABULARY), "rb").read())
    theirs = tokenizers.Tokenizer.from_file(os.path.join(TOKENIZERS, "byte_bpe_50k.json"))
    theirs.encode_special_tokens = True
    return ours, theirs


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=300))
def test_ids_equal_the_library(pair, text):
    assert pair[0].encode(text) == pair[1].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 5000, " " * 3000 + "x", "\n\r\t \n", "<|endoftext|>", "naïve ﬁne 中文 😀", "=" * 777])
def test_long_runs(pair, text):
    assert pair[0].encode(text) == pair[1].encode(text, add_special_tokens=False).ids


def test_every_token_is_its_own_encoding(pair):
    assert all(merged(t, pair[0].ranks) == [i] for t, i in list(pair[0].ranks.items())[::97])


def test_ids_of_a_table(spark, pair):
    rows = [(1, "one two", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, "one two", "x"), (4, " ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id or 0, list(r.ids)) for r in token_ids(df, "doc_id", "text").collect())
    assert got == sorted((k or 0, pair[0].encode(t)) for k, t, _ in rows) and (2, []) in got
    counts = token_counts(df, ["doc_id"], "text").collect()
    assert sorted(r.n_tokens for r in counts) == sorted(len(pair[0].encode(t)) for _, t, _ in rows)
    assert token_ids(df.limit(0), "doc_id", "text").collect() == []


PROSE = "The group met in the hall and spoke of what it had seen on the way. It was late when we left for the town by the river. "
PAGES = [
    (1, PROSE * 4), (2, " | ".join(["cheap glass", "best glass", "glass deal"] * 20)), (3, " ".join(f"https://shop.example/p?id={i}" for i in range(40))),
    (4, "\n".join(["Sale", "Best Offer", "Glass Kiln"] * 20)), (5, "#glass #kiln #sale " * 20), (6, PROSE + "Buy glass kiln here. Cheap glass kiln and glass kiln deals. " * 15),
    (7, PROSE * 3 + "\nKeywords: glass; kiln; sale; fibre"), (8, None), (9, ""), (10, "  \n "), (11, "glass " * 30_000),
]


def test_stuffed_pages_are_told_from_prose(spark):
    df = spark.createDataFrame([(*p, "z", "z") for p in PAGES * 2], "doc_id long, text string, h string, prose string")
    assert {r.doc_id for r in stuffed_pages(df, "doc_id", "text").collect()} == {2, 3, 4, 5, 6, 11}
    rows = line_shares(df, "doc_id", "text").collect()
    assert len(rows) == 2 * len(PAGES) and {r.doc_id for r in rows if r.n_lines == 0} == {8, 9, 10}
    assert all(r.prose is None for r in rows if r.n_lines == 0)
    assert line_shares(df.limit(0), "doc_id", "text").collect() == []


def test_arrays_of_pages_give_what_single_pages_give():
    import numpy as np

    from quire.llm.stuffing import SYMBOLS, decode, expected, prior

    rng = np.random.default_rng(5)
    pages = [rng.integers(0, len(SYMBOLS), n).astype(np.int8) for n in (0, 1, 2, 7, 7, 30, 3, 0, 200)]
    begin, move, emit = prior()
    together = expected(pages, prior())
    alone = [expected([p], prior()) for p in pages]
    assert all(np.allclose(x, sum(a[k] for a in alone)) for k, x in enumerate(together))
    assert abs(together[2].sum() - sum(map(len, pages))) < 1e-6 and abs(together[1].sum() - sum(max(0, len(p) - 1) for p in pages)) < 1e-6
    for p, states in zip(pages, decode(pages, prior())):
        if len(p) == 3:  # all 64 paths
            score = lambda s: np.log(begin[s[0]] * emit[s[0], p[0]]) + sum(np.log(move[a, b] * emit[b, x]) for a, b, x in zip(s, s[1:], p[1:]))
            best = max(((i, j, k) for i in range(4) for j in range(4) for k in range(4)), key=score)
            assert tuple(states) == best
        assert len(states) == len(p)


def test_no_task_reads_more_for_more_partitions(spark):
    df = spark.createDataFrame([(i, PROSE) for i in range(40)] + [(99, "#glass #kiln #sale " * 20)], "doc_id long, text string")
    few, many = ({(r.doc_id, round(r.prose, 9)) for r in line_shares(df.repartition(n), "doc_id", "text").collect()} for n in (1, 200))
    assert few == many and len(few) == 41
