"""Entities of two sources, and labels mapped to a list."""

import random
import time

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.canonical import NameIndex, apart, distance, map_to_list, words_of
from quire.llm.entity_match import FLOOR, family_name, fit, match, plain, records, scored_pairs, with_terms

ROWS = "id string, title string, names array<string>, year int, doi string, at int, score string, doc string"


def table(spark, rows):
    df = spark.createDataFrame([(*r, 1, "q", "q") for r in rows], ROWS)
    return records(df, "id", F.col("title"), F.col("names"), F.col("year"), F.col("doi"), "at")


def people(rng):
    return [f"{rng.choice('ABC')}. Name{rng.randint(0, 400)}" for _ in range(3)]


def test_records_of_the_same_work_are_found(spark):
    rng = random.Random(4)
    docs = [(f"W{i}", " ".join(f"word{rng.randint(0, 300)}" for _ in range(8)), people(rng), 1990 + i % 30, f"10.1/{i}" if i % 3 else None) for i in range(300)]
    docs += [("G1", "Editorial", ["A. Name1"], 2000, None), ("G2", "Editorial", ["B. Name2"], 2000, None), ("E", None, None, None, None), (None, "x", None, None, None)]
    queries = []
    for i in range(0, 300, 2):
        _, t, n, y, d = docs[i]
        words = t.split()
        if i % 4 == 0:
            words = words[:6]
        queries.append((str(i), " ".join(words).upper(), [x.split(". ")[1] + ", " + x[0] for x in n][:2] if i % 5 else None, y + i % 2, d if i % 3 == 1 else None))
    queries += [("900", "nothing like it at all", ["Z. Stranger"], 1900, None), ("901", None, None, None, None), ("902", "Editorial", None, 2000, None)] + queries[:4]
    got = {r.query: r.doc for r in match(table(spark, docs), table(spark, queries)).where("confidence >= 0.5").collect()}
    right = sum(got.get(str(i)) == f"W{i}" for i in range(0, 300, 2))
    assert right >= 145 and "900" not in got and "901" not in got and "902" not in got


def test_nothing_to_match(spark):
    some = table(spark, [("W1", "one two three", ["A. B"], 2000, None)])
    assert match(some, some.limit(0)).collect() == [] and match(some.limit(0), some).collect() == []


def test_search_finds_all_above_the_floor(spark, monkeypatch):
    from quire.llm import entity_match as E

    rng = random.Random(7)
    docs = [rng.sample(range(200), 12) for _ in range(300)]
    queries = [sorted(set(rng.sample(docs[i], 9)) | set(rng.sample(range(210), 2))) for i in range(0, 300, 10)]
    count = np.zeros(210)
    for d in docs:
        count[d] += 1
    weights = np.where(count > 0, np.log1p((len(docs) - count + 0.5) / (count + 0.5)), 0.0)
    name = lambda s: [f"N{'abcdefghij'[x // 100]}{'abcdefghij'[x // 10 % 10]}{'abcdefghij'[x % 10]}" for x in s]
    side = lambda sets, k: with_terms(table(spark, [(f"{k}{i}", None, name(s), None, None) for i, s in enumerate(sets)]))
    w = lambda s: sum(weights[x] for x in s)
    want = {(f"q{i}", f"d{j}"): w(set(a) & set(b)) / w(a) for i, a in enumerate(queries) for j, b in enumerate(docs) if w(set(a) & set(b)) >= FLOOR * w(a)}
    d, q = side(docs, "d").cache(), side(queries, "q").cache()
    for split, shard, step in ((200_000, 2_000_000, 1 << 18), (5, 50, 40)):  # frequent terms split, many shards, small steps
        monkeypatch.setattr(E, "TERM_POSTINGS", split)
        monkeypatch.setattr(E, "SHARD_POSTINGS", shard)
        monkeypatch.setattr(E, "STEP", step)
        keys = lambda x, n: x.select(F.col("id").alias(n), F.col("key").alias(f"{n}_key"))
        got = scored_pairs(d, q).join(keys(q, "query"), "query").join(keys(d, "doc"), "doc").collect()
        assert {(r.query_key, r.doc_key) for r in got} == set(want) and len(got) == len(want) >= 30
        assert all(abs(r.coverage - want[r.query_key, r.doc_key]) < 1e-9 for r in got)


def test_pairs_are_scored_in_blocks_and_shuffle_files_go_at_once(spark, monkeypatch):
    from quire.llm import entity_match as E
    from quire.session import cut_lean, drop

    files = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split() if "/shuffle_" in f}

    def gone(before):  # files are removed in the background
        for _ in range(100):
            if not files() - before:
                return True
            time.sleep(0.1)

    before, parts = files(), []
    for k in (0, 1):
        parts.append(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("x")).count().withColumn("part", F.lit(k)))
    kept = cut_lean(parts)
    assert gone(before) and {tuple(r) for r in kept.collect()} == {(x, 143 if x < 6 else 142, k) for x in range(7) for k in (0, 1)}
    drop(kept)
    sizes = []
    monkeypatch.setattr(E, "cut_lean", lambda x: sizes.append(1 if isinstance(x, DataFrame) else len(x := list(x))) or cut_lean(x))
    docs = with_terms(table(spark, [(f"W{i}", f"alpha beta word{i % 9} rare{i % 40}", [f"A. Name{i % 5}"], 2000, None) for i in range(120)])).cache()
    asked = with_terms(table(spark, [(str(i), f"alpha beta word{i % 9} rare{i % 40}", None, 2000, None) for i in range(50)])).cache()
    found = {}
    for block in (6, 0.02):
        monkeypatch.setattr(E, "BLOCK", block)
        rows = [tuple(r) for r in scored_pairs(docs, asked).collect()]
        found[block] = set(rows)
        assert len(rows) == len(found[block]) >= 50
    assert found[6] == found[0.02] and sizes[-1] > 5 and sizes.count(1) == len(sizes) - 1


def test_names_and_text():
    assert [family_name(x) for x in ("Karvar, J.", "J. Karvar", "Jol Karvar", "Karvar J", "et al.", "", None)] == ["karvar"] * 4 + [None] * 3
    assert plain("Töwards <i>A &amp; B</i>").split() == ["towards", "a", "and", "b"]


def test_logistic_fit_separates():
    x = np.array([[0.0], [0.1], [0.9], [1.0]] * 20)
    w = fit(x, (x[:, 0] > 0.5).astype(float), ridge=0.01)
    assert w[0] > 0 and (x[:, 0] * w[0] + w[1] > 0).tolist() == (x[:, 0] > 0.5).tolist()


NAMES = [("F1", "cherry"), ("F2", "cherry root"), ("F3", "turnip seed"), ("F4", "spinach"), ("F5", "falsoranate"), ("F3", "glanoquin")]


def test_labels_meaning_a_food():
    index = NameIndex(NAMES)
    hits = {"2 lb CHERRIES (see note 4)": None, "root of chérry": "F2", "cherryroot": "F2", "0f the same": None, "tumip s3ed": None, "tvrnip seeds, washed": "F3", "spina.": "F4", "some spinach *": "F4",
            "cherry peel": None, "Falsoranate": "F5", "well pounded glanoqvin": "F3", "wooden spoon": None, "cherries": None, "chery": "F1", "turnip": None}
    got = {k: (index.best(k) or (0, 0, None))[2] for k in hits}
    for k in ("root of chérry", "cherryroot", "tvrnip seeds, washed", "spina.", "some spinach *", "Falsoranate", "well pounded glanoqvin", "chery"):
        assert got[k] == hits[k], k
    for k in ("0f the same", "cherry peel", "wooden spoon", "turnip"):
        assert got[k] is None, k
    assert distance("abcd", "abdc", 2) == 1 and distance("abc", "xyz", 1) == 2 and words_of("(see note)") == []
    assert apart(["root", "cherry"], ["cherry", "root"]) == 0


def test_prefix_filter_misses_nothing():
    rng = random.Random(1)
    names = [(f"F{i}", "".join(rng.choice("abcdef") for _ in range(7))) for i in range(150)]
    index = NameIndex(names)
    for _ in range(60):
        s = {f"^{''.join(rng.choice('abcdef') for _ in range(7))}$"[k : k + 2] for k in range(8)}
        want = {k for k, (_, _, t) in enumerate(index.names) if len(s & t) / len(s | t) >= index.least - 1e-9}
        assert {k for _, k in index.similar(s)} == want


def test_labels_of_a_table(spark, monkeypatch):
    from quire.llm import canonical

    rows = [("n1", "cherry root"), ("n1", "cherry root"), ("n2", None), ("n3", " \t"), (None, "cherry"), ("n4", "kettle"), ("n5", "x" * 50_000)]
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], "node_id string, label string, entry string, edits int")
    names = spark.createDataFrame([*NAMES, (None, "x"), ("F9", None)], "foodon_id string, name string")
    want = {("n1", "F2"), ("n4", "none"), ("n5", "none")}
    for block in (50_000, 2):
        monkeypatch.setattr(canonical, "BLOCK", block)
        assert {(r.node_id, r.foodon_id) for r in map_to_list(df, "node_id", "label", names, "foodon_id", "name").collect()} == want
    assert {r.foodon_id for r in map_to_list(df, "node_id", "label", names.limit(0), "foodon_id", "name").collect()} == {"none"}
    assert map_to_list(df.limit(0), "node_id", "label", names, "foodon_id", "name").collect() == []


def test_long_names_are_paired_whole():
    import itertools

    name = "sweet white wine vinegar sauce"
    index = NameIndex([("F1", name), ("F2", "wine"), ("F3", "white vinegar")])
    assert index.best(name)[2] == "F1" and index.best("sause of wihte wine sweet vinegar")[2] == "F1"
    assert index.best("sweet white wine vinegar kettle") is None
    rng = random.Random(3)
    foods = ["wine", "vine", "vinegar", "sauce", "sweet", "swede", "white", "whites", "salt"]
    from quire.llm.canonical import written

    for _ in range(150):
        a, b = ([rng.choice(foods) for _ in range(n)] for n in [rng.randint(2, 6)] * 2)
        sums = [sum(d) for p in itertools.permutations(b) if min(d := [written(x, y) for x, y in zip(a, p)]) >= 0]
        assert apart(a, b) == min(sums, default=-1)


def test_hits_leave_in_steps(monkeypatch):
    from quire.llm import entity_match as E

    monkeypatch.setattr(E, "STEP", 100)
    n = 1000
    postings = np.zeros(n, dtype=E.POSTING)
    postings["term"], postings["sig"], postings["id"] = np.arange(n) // 10, 1, np.arange(n)
    lookups = np.zeros(n // 10, dtype=E.LOOKUP)
    lookups["term"] = np.arange(n // 10)
    bound = np.zeros((1, 64), dtype=np.float32)
    bound[0, 0] = E.UNIT
    steps = list(E.hits(postings, lookups, np.array([5]), bound))
    assert max(len(q) for q, _ in steps) <= 100 and np.concatenate([d for _, d in steps]).tolist() == list(range(n))
    assert list(E.hits(postings[:0], lookups, np.array([5]), bound)) == []


def test_more_frequent_terms_than_can_be_split_lose_nothing(spark, monkeypatch):
    from quire.llm import entity_match as E

    rows = [(f"d{i}", None, ["A. Common", f"B. Half{'ab'[i % 2]}", f"C. Own{chr(97 + i)}"], 2000, None) for i in range(20)]
    docs, queries = with_terms(table(spark, rows)).cache(), with_terms(table(spark, rows)).cache()
    monkeypatch.setattr(E, "TERM_POSTINGS", 2)
    found = {}
    for most in (100, 1):
        monkeypatch.setattr(E, "MOST_SPLIT", most)
        found[most] = {(r.query, r.doc) for r in scored_pairs(docs, queries).collect()}
    assert found[1] == found[100] and len(found[1]) >= 20
