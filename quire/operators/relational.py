"""Relational operators: filters, joins, aggregates, ranks and removal of duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, place: str = "place") -> DataFrame:
    """The first ``n`` rows of each group in an order that must be total; Spark limits each group
    before the shuffle, so a hot group sends few rows."""
    ranked = df.withColumn(place, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(place) <= n)
    return ranked.withColumn(place, F.col(place).cast("bigint"))


def share_of_group(df: DataFrame, value: str, group: list[str], name: str = "share") -> DataFrame:
    """Each row's value over its group's sum; null where that is 0."""
    return df.withColumn(name, F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*group))))


def concentration(df: DataFrame, area: str, item: str, n: str) -> DataFrame:
    """Share of an item in its area over its share in all: above 1 where it is over-represented."""
    in_area = F.col(n) / F.sum(n).over(Window.partitionBy(area))
    by_item = df.groupBy(item).agg(F.sum(n).alias("_i")).withColumn("_all", F.col("_i") / F.sum("_i").over(Window.partitionBy()))
    return df.withColumn("share", in_area).join(by_item.select(item, "_all"), item).withColumn("index", F.col("share") / F.col("_all")).drop("_all")


def two_phase_join(left: DataFrame, right: DataFrame, exact: str, loose: Column, keep: list[str]) -> DataFrame:
    """Rows of ``left`` joined on ``exact``; those without a partner then on ``loose`` of the same
    column. ``keep`` are right columns; how the row matched is in ``phase``."""
    r = right.select(F.col(exact).alias("_k"), *keep)
    one = left.join(r, F.col(exact) == F.col("_k")).drop("_k").withColumn("phase", F.lit("exact"))
    rest = left.join(r, F.col(exact) == F.col("_k"), "left_anti").withColumn("_l", loose)
    loose_right = right.select(loose.alias("_k"), *keep).where("_k is not null")
    two = rest.join(loose_right, F.col("_l") == F.col("_k")).drop("_k", "_l").withColumn("phase", F.lit("loose"))
    return one.unionByName(two)


def dedupe_by_keys(df: DataFrame, first: Column, second: list[Column], order: list[str]) -> DataFrame:
    """One row per ``first`` key; rows without it one per ``second`` keys; null in either second key
    counts as a value. Of equal keys the row lowest by ``order``, combined before the shuffle."""
    fields = [c for c in df.columns if c not in order]
    pick = F.min(F.struct(*order, *fields)).alias("_r")
    keyed = df.withColumn("_k", first).withColumns({f"_s{i}": c for i, c in enumerate(second)})
    a = keyed.where("_k is not null").groupBy("_k").agg(pick)
    b = keyed.where("_k is null").groupBy(*(f"_s{i}" for i in range(len(second)))).agg(pick)
    return a.select("_r.*").unionByName(b.select("_r.*")).select(df.columns)


def latest(df: DataFrame, key: str, at: list[str]) -> DataFrame:
    """The row with the greatest ``at`` of each key: the last one written wins."""
    rest = [c for c in df.columns if c != key and c not in at]
    return df.groupBy(key).agg(F.max(F.struct(*at, *rest)).alias("_r")).select(key, "_r.*").select(df.columns)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key, and added."""
    return latest(
        old.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1))), key, ["_p"]
    ).drop("_p")


def any_term(text: list[str], terms: list[str], every: bool = False) -> Column:
    """Whether a term, or every one, is in any of the text columns, whatever the case."""
    hit = [reduce(lambda a, b: a | b, (F.coalesce(F.lower(c).contains(t.lower()), F.lit(False)) for c in text)) for t in terms]
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), hit)


def intersections(df: DataFrame, text: str, terms: dict[str, str]) -> DataFrame:
    """Number of rows for each term and for each combination of two or three, in one pass."""
    flags = {n: F.coalesce(F.lower(F.col(text)).contains(t), F.lit(False)).cast("int") for n, t in terms.items()}
    names = sorted(flags)
    combos = [(a,) for a in names] + [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    combos += [(a, b, c) for i, a in enumerate(names) for j, b in enumerate(names[i + 1 :], i + 1) for c in names[j + 1 :]]
    sums = df.select(*(flags[n].alias(n) for n in names)).agg(
        *(F.sum(reduce(lambda x, y: x * y, (F.col(n) for n in c))).alias("+".join(c)) for c in combos)
    )
    pairs = F.array(*(F.struct(F.lit("+".join(c)).alias("terms"), F.coalesce(F.col(f"`{'+'.join(c)}`"), F.lit(0)).alias("n")) for c in combos))
    return sums.select(F.explode(pairs).alias("x")).select("x.*")


def average_ranks(df: DataFrame, value: str, group: list[str] | None = None, name: str = "rank", descending: bool = False) -> DataFrame:
    """Rank of ``value`` within its group, ties sharing the mean of their places. Computed from the
    distinct values and their counts, so that only those are sorted."""
    group = group or []
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy(*group).orderBy(F.desc(value) if descending else F.asc(value)).rowsBetween(Window.unboundedPreceding, 0)
    ranks = counts.withColumn(name, F.sum("_n").over(over) - (F.col("_n") - 1) / 2.0).drop("_n")
    return df.join(ranks, [*group, value])


def mode_first(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, the smallest of tied ones; nulls don't count."""
    n = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*group).agg(F.min(F.struct(-F.col("n"), F.col(value)))[value].alias("mode"), F.max("n").alias("n"))


def observed_windows(df: DataFrame, year: str, width: int) -> DataFrame:
    """(start, end, year): every run of ``width`` successive observed years, gaps ignored."""
    years = df.where(F.col(year).isNotNull()).select(F.col(year).alias("year")).distinct()
    w = Window.orderBy("year")  # one row per distinct year
    runs = years.select(F.col("year").alias("start"), F.lead("year", width - 1).over(w).alias("end")).where("end is not null")
    return runs.join(years, F.col("year").between(F.col("start"), F.col("end")))


def diverse_examples(df: DataFrame, group: str, source: str, order: list[str], n: int) -> DataFrame:
    """``n`` rows per group: first at most max(2, n over the sources) of each source, then the rest in
    order."""
    many = df.groupBy(group).agg(F.greatest(F.lit(2), F.floor(F.lit(n) / F.countDistinct(source))).alias("_most"))
    ranked = df.join(many, group).withColumn("_p", F.row_number().over(Window.partitionBy(group, source).orderBy(*order)))
    late = (F.col("_p") > F.col("_most")).cast("int").alias("_late")
    return top_per_group(ranked.withColumn("_late", late), [group], [F.col("_late"), *(F.col(c) for c in order)], n).drop("_most", "_p", "_late")


def decide(decisions: DataFrame, item: str, priority: dict[str, int], source: str = "source") -> DataFrame:
    """One decision per item: that of the source of highest priority, the last in ``order`` of equal ones."""
    rank = F.coalesce(*(F.when(F.col(source) == s, p) for s, p in priority.items()), F.lit(-1))
    return latest(decisions.withColumn("_p", rank), item, ["_p", "order"]).drop("_p")


def bins_by_quantile(df: DataFrame, value: str, bins: int) -> DataFrame:
    """``bin`` of each row: right-closed ranges between equal quantiles, repeated edges dropped."""
    edges = df.agg(F.percentile(value, F.array(*(F.lit(i / bins) for i in range(bins + 1)))).alias("e")).select(F.array_distinct("e").alias("_e"))
    return (
        df.crossJoin(F.broadcast(edges))  # one row of at most bins + 1 edges
        .withColumn("bin", F.greatest(F.lit(1), F.size(F.filter("_e", lambda e: e < F.col(value)))))
        .drop("_e")
    )
