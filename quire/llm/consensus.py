"""Consensus of several annotators by spectral reliability.

Answers are centred and scaled per task and annotator, which takes out what two annotators would
agree on by chance given how they answer at large. The leading eigenvector of their agreement matrix
without its diagonal, each entry divided by the root of both annotators' overlap, says who agrees with
the rest. The vector is then corrected for how often each two annotators overlap: reliabilities r are
moved until they fit every two annotators' mean product as r_i * r_j, each pair weighted by its own
number of common items. The matrix is never formed: a step joins the answers with the current vector,
sums by item, joins back and sums by annotator, so no pair of answers is ever emitted, however many
answers an item has; an item's sums less an answer's own are what its pairs add up to.

A reliability is an annotator's correlation with the hidden truth. It is negative for one who answers
the reverse, near zero for one who guesses or always says the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut, drop

#: Correlations are kept within this bound, so that no single annotator has infinite weight.
MOST = 0.99
#: Added to the matrix' diagonal, so that a vector can't flip from step to step.
SHIFT = 0.25
#: So many common answers without any agreement are added to each annotator's own, so that few don't count as proof.
SHRINK = 1.0


def latest_answers(rows: DataFrame, item: str, annotator: str, at: str, values: dict[str, str]) -> DataFrame:
    """(task, item, annotator, value): of each item and annotator the answer with the latest ``at``.

    ``values`` maps tasks to columns; ties go to the greatest values; rows must be readable ones.
    """
    one = rows.groupBy(F.col(item).alias("item"), F.col(annotator).alias("annotator")).agg(
        F.max(F.struct(at, *values.values())).alias("x")
    )
    tasks = F.array(*(F.struct(F.lit(t).alias("task"), F.col(f"x.{c}").cast("double").alias("value")) for t, c in values.items()))
    return one.select("item", "annotator", F.explode(tasks).alias("t")).select("t.task", "item", "annotator", "t.value")


def reliabilities(answers: DataFrame, most_steps: int = 100, tolerance: float = 1e-3) -> DataFrame:
    """One row per task and annotator: n_answers, mean, sd, overlap (answers that others gave to the
    same items) and reliability, the estimated correlation with the truth, from -1 to 1.

    ``answers`` has task, item, annotator, value, one row per answer. An annotator without overlap
    or with answers all alike has reliability 0. The sign is set so that the annotators, weighted
    by overlap, agree with the truth on the whole. No answers give no rows. Raises if the values still
    move by ``tolerance`` after ``most_steps``.
    """
    who = ["task", "annotator"]
    x = answers.select("task", "item", "annotator", "value").where(F.col("item").isNotNull() & F.col("annotator").isNotNull() & F.col("value").isNotNull())
    sizes = x.groupBy("task", "item").agg((F.count(F.lit(1)) - 1).alias("others"))
    stats = cut(
        x.join(sizes, ["task", "item"])
        .groupBy(who)
        .agg(
            F.count(F.lit(1)).alias("n_answers"),
            F.avg("value").alias("mean"),
            F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("sd"),
            F.sum("others").alias("overlap"),
        )
    )
    live = stats.where("sd > 1e-9 and overlap > 0").select(*who, "mean", "sd", F.sqrt("overlap").alias("root"))
    z = cut(x.join(live, who).select(*who, "item", ((F.col("value") - F.col("mean")) / F.col("sd")).alias("z"), "root"))

    def sums(vector: DataFrame) -> DataFrame:
        """Per annotator: v before, and over all others' answers to the same items the sums of z * z' * v' and of v' * v'."""
        part = z.join(vector.select(*who, "v"), who).withColumn("p", F.col("z") * F.col("v") / F.col("by"))
        whole = part.groupBy("task", "item").agg(F.sum("p").alias("s"), F.sum(F.col("v") * F.col("v")).alias("t"))
        return part.join(whole, ["task", "item"]).groupBy(*who, "root", F.col("v").alias("old")).agg(
            F.sum(F.col("z") * (F.col("s") - F.col("p"))).alias("top"), F.sum(F.col("t") - F.col("v") * F.col("v")).alias("bottom")
        )

    def settled(vector: DataFrame, step) -> DataFrame:
        """(task, annotator, root, old, v) once a step moves no value by ``tolerance``."""
        for _ in range(most_steps):
            fresh = cut(step(vector))
            drop(vector)
            vector = fresh
            moved = vector.agg(F.max(F.abs(F.col("v") - F.col("old")))).first()[0]
            if moved is None or moved < tolerance:
                return vector
        raise RuntimeError(f"reliabilities still move after {most_steps} steps")

    def scaled(v: DataFrame) -> DataFrame:
        """Of unit length per task, on the whole positive; one row per task goes to all tasks of the join."""
        norm = v.groupBy("task").agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("norm"), F.sum(F.col("v") * F.col("root")).alias("side"))
        sign = F.when(F.col("side") < 0, -1.0).otherwise(1.0)
        return v.join(F.broadcast(norm), "task").select(*who, "root", "old", (sign * F.try_divide(F.col("v"), F.col("norm"))).alias("v"))

    def power(vector: DataFrame) -> DataFrame:
        return scaled(sums(vector).select(*who, "root", "old", (F.col("top") / F.col("root") + SHIFT * F.col("old")).alias("v")))

    def fitted(vector: DataFrame) -> DataFrame:
        fit = F.col("top") / (F.col("bottom") + SHRINK)
        return sums(vector).select(*who, "root", "old", F.greatest(F.lit(-MOST), F.least(F.lit(MOST), (F.col("old") + fit) / 2)).alias("v"))

    z = z.withColumn("by", F.col("root"))
    vector = settled(cut(scaled(live.select(*who, "root", F.lit(0.0).alias("old"), F.col("root").alias("v")))), power)
    z = z.withColumn("by", F.lit(1.0))
    # to the scale of correlations: the greatest is taken for MOST, and the fit finds the rest
    most = vector.groupBy("task").agg(F.max(F.abs(F.col("v") / F.col("root"))).alias("most"))
    begun = vector.join(F.broadcast(most), "task").select(*who, "root", "old", (MOST * F.try_divide(F.col("v") / F.col("root"), F.col("most"))).alias("v"))
    lam = settled(cut(begun), fitted).select(*who, F.col("v").alias("reliability"))
    return stats.join(lam, who, "left").withColumn("reliability", F.coalesce("reliability", F.lit(0.0)))


def consensus(answers: DataFrame, judges: DataFrame, least_information: float = 0.5) -> DataFrame:
    """One row per task and item: consensus, information, n_answers and agreement.

    An answer votes with r / (1 - r^2) for its annotator's reliability r, reversed where r is
    negative. ``consensus`` is the weighted mean on the scale of the reliable annotators, null if the
    votes' information (the sum of r^2 / (1 - r^2)) is below ``least_information``, less than one
    annotator of reliability 0.58. ``agreement`` is one less the answers' variance about the
    consensus over the variance expected by chance, from the unweighted answers; null for a single one.
    """
    r = F.col("reliability")
    weight = (r / (1 - r * r)).alias("w")
    # one row per task: bounded by the number of tasks
    scale = judges.groupBy("task").agg(
        F.try_divide(F.sum(F.when(r > 0, r * F.col("overlap") * F.col("mean"))), F.sum(F.when(r > 0, r * F.col("overlap")))).alias("mu"),
        F.try_divide(F.sum(F.when(r > 0, r * r * F.col("overlap") * F.col("sd"))), F.sum(F.when(r > 0, r * F.col("overlap")))).alias("tau"),
        F.try_divide(F.sum(F.col("n_answers") * F.col("sd") ** 2), F.sum("n_answers")).alias("spread"),
    )
    z = F.when(F.col("sd") > 1e-9, (F.col("value") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    return (
        answers.select("task", "item", "annotator", "value").where(F.col("item").isNotNull() & F.col("value").isNotNull())
        .join(judges.select("task", "annotator", "mean", "sd", "reliability"), ["task", "annotator"])
        .select("task", "item", "value", weight, r.alias("r"), z.alias("z"))
        .groupBy("task", "item")
        .agg(
            F.sum(F.expr("w * z")).alias("top"),
            F.sum(F.expr("w * r")).alias("information"),
            F.count(F.lit(1)).alias("n_answers"),
            F.var_samp("value").alias("variance"),
        )
        .join(F.broadcast(scale), "task")
        .select(
            "task",
            "item",
            F.when(F.col("information") >= least_information, F.expr("mu + tau * top / information")).alias("consensus"),
            "information",
            "n_answers",
            F.when(F.col("n_answers") > 1, 1 - F.try_divide(F.col("variance"), F.col("spread"))).alias("agreement"),
        )
    )
