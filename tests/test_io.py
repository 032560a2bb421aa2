"""Sources, sinks and streams on small files."""

import json

from pyspark.sql import functions as F

from quire.sources import readers as R
from quire.sources import writers as W
from quire.streaming import flows as S


def test_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text('doi,cluster\n10.1/a,3\n10.1/b,x\n10.1/c,\n')
    assert [(r.doi, r.cluster) for r in R.read_csv(spark, str(tmp_path / "t.csv"), "doi string, cluster int", ["cluster"]).collect()] == [("10.1/a", 3)]
    (tmp_path / "m.csv").write_text("cluster,C0,C1\nC0,1.0,0.2\nC1,0.2,1.0\n")
    assert [(r.a, r.b, r.value) for r in R.read_matrix(spark, str(tmp_path / "m.csv"), ["C0", "C1"]).collect()] == [("C0", "C1", 0.2)]
    (tmp_path / "r.json").write_text(json.dumps([{"t": "a", "i": [{"name": "x"}]}, {"t": None}]))
    assert R.read_any(spark, str(tmp_path / "r.json"), "t string, i array<struct<name:string>>").count() == 1
    (tmp_path / "l.jsonl").write_text('{"index":1,"v":"a"}\nnot json\n{"index":2,"v":"b"}\n{"index":1,"v":"c"}\n')
    assert {(r["index"], r.v) for r in R.read_log(spark, str(tmp_path / "l.jsonl"), "index int, v string", "index").collect()} == {(1, "c"), (2, "b")}
    for k in ("one", "two"):
        (tmp_path / "f" / k).mkdir(parents=True)
        (tmp_path / "f" / k / "x.csv").write_text(f"doi\n{k}\n")
    assert {(r.doi, r.cluster) for r in R.read_by_folder(spark, str(tmp_path / "f/*/*.csv"), "doi string").collect()} == {("one", "one"), ("two", "two")}


def test_lists_and_fallbacks(spark):
    rows = [("['a', 'b']",), ("a\n b ",), ("a|b",), ("a",), (None,), ("",)]
    got = [r.x for r in spark.createDataFrame(rows, "c string").select(R.coerced_list("c").alias("x")).collect()]
    assert got == [["a", "b"], ["a", "b"], ["a", "b"], ["a"], [], []]
    t = lambda rows: spark.createDataFrame(rows, "k string, v string")
    base = t([("1", None), ("2", None), ("3", None)])
    out = {r.k: (r.v, r.origin) for r in R.coalesced(base, "k", [("pdf", t([("1", "p")])), ("abstract", t([("1", "a"), ("2", "a")]))], "v").collect()}
    assert out == {"1": ("p", "pdf"), "2": ("a", "abstract"), "3": (None, None)}
    assert {r.k for r in R.filled_up(t([("1", "a"), ("2", "a"), ("3", "a")]), t([("2", "b"), ("4", "b"), ("5", "b"), ("6", "b")]), "k", 5).collect()} == {"1", "2", "4", "5", "6"}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), ["a", None], {"k": 1})], "id int, x double, l array<string>, m map<string,int>")
    assert W.plain_properties(df).first().asDict() == {"id": 1, "x": None, "l": ["a"]}
    assert json.loads(W.summary_json(df).first().json) == {"id": 1, "x": None, "l": ["a"]}
    W.append_log(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "log"))
    W.append_log(spark.createDataFrame([(2, "x")], "a int, b string"), str(tmp_path / "log"))
    assert R.read_log(spark, str(tmp_path / "log"), "a int, b string", "a").count() == 2
    W.write_parts(df.select("id", F.lit("n").alias("label")), str(tmp_path / "parts"), "label")
    assert spark.read.parquet(str(tmp_path / "parts/label=n")).count() == 1
    assert W.newick(([("a b", 1.0), ([("c", 0.5), ("d", 0.25)], 2.0)], 0.0)) == "(a_b:1,(c:0.5,d:0.25):2);"
    w = spark.createDataFrame([("W1", "=x", None, 2000, 3, None, ["A"], ["C"], [], "article", "en", True)], "work string, title string, abstract string, year int, citations int, doi string, authors array<string>, concepts array<string>, refs array<string>, type string, language string, is_oa boolean")
    row = W.index_rows(w).first()
    assert list(row.asDict()) == W.INDEX_COLUMNS and row.Title == "'=x" and row.Abstract == ""


def test_streams(spark, tmp_path):
    rows = [(1, "2021-01-01 00:00:00", "a"), (1, "2021-01-01 00:10:00", "b"), (2, "2021-01-01 05:00:00", "c"), (3, "2021-01-09 00:00:00", "d")]
    df = spark.createDataFrame(rows, "id int, ts string, v string").withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(2):
        df.where(F.col("v").isin(*("ab" if k == 0 else "cd"))).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: S.arriving(spark, str(tmp_path / "in"), df.schema)
    S.drain(S.once(stream(), "id", "ts"), str(tmp_path / "c1"), "once_")
    assert spark.table("once_").count() == 3
    S.drain(S.windowed_counts(stream(), "ts", "id"), str(tmp_path / "c2"), "counts_", "complete")
    assert {(r.id, r.n) for r in spark.table("counts_").collect()} == {(1, 2), (2, 1), (3, 1)}
    S.drain(S.sessions(stream(), "ts", "id"), str(tmp_path / "c3"), "sessions_", "complete")
    assert spark.table("sessions_").count() == 3
    sink = S.keep_latest("id", ["ts"], str(tmp_path / "kept"))
    for number, part in enumerate(("a", "bcd")):
        sink(df.where(F.col("v").isin(*part)), number)
    assert {(r.id, r.v) for r in spark.read.parquet(str(tmp_path / "kept/v1")).collect()} == {(1, "b"), (2, "c"), (3, "d")}
