"""Evaluation: hits within a few lines, precision and recall, and the gate against a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def eval_hits(findings: DataFrame, expected: DataFrame, slack: int = 3) -> tuple[DataFrame, DataFrame]:
    """(expected with found, findings with relevant): same case and file, lines at most slack apart.

    findings(name, fid, file, line), expected(name, eid, file, line). Each side's distinct places meet by case, file and
    bucket of 2 * slack + 1 lines, which holds at most so many places of either, so the cost grows with the rows and not
    with their pairs. A row without a case, file or line hits nothing.
    """
    width = 2 * slack + 1
    bucket = lambda line: F.floor(F.col(line) / width)
    f = findings.select("name", "file", F.col("line").alias("_f")).dropna().distinct().withColumn("_b", bucket("_f"))
    e = expected.select("name", "file", F.col("line").alias("_e")).dropna().distinct()
    around = F.sequence(F.floor((F.col("_e") - slack) / width), F.floor((F.col("_e") + slack) / width))
    near = f.join(e.withColumn("_b", F.explode(around)), ["name", "file", "_b"]).filter(F.abs(F.col("_f") - F.col("_e")) <= slack)

    def flag(df: DataFrame, line: str, name: str) -> DataFrame:
        hit = near.select(F.col("name").alias("_name"), F.col("file").alias("_file"), F.col(line).alias("_line")).distinct().withColumn("_hit", F.lit(True))
        at = (F.col("name") == F.col("_name")) & (F.col("file") == F.col("_file")) & (F.col("line") == F.col("_line"))
        return df.join(hit, at, "left").withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_name", "_file", "_line", "_hit")

    return flag(expected, "_e", "found"), flag(findings, "_f", "relevant")


def eval_case_metrics(cases: DataFrame, expected: DataFrame, findings: DataFrame, slack: int = 3) -> DataFrame:
    """cases(name, rejected, verdict, tokens, error) with expected, found, findings and falsePositives."""
    wanted, got = eval_hits(findings, expected, slack)
    e = wanted.groupBy("name").agg(F.count("*").alias("expected"), F.count_if("found").alias("found"))
    f = got.groupBy("name").agg(F.count("*").alias("findings"), F.count_if(~F.col("relevant")).alias("falsePositives"))
    return cases.join(e, "name", "left").join(f, "name", "left").fillna(0, ["expected", "found", "findings", "falsePositives"])


def eval_summary(metrics: DataFrame) -> DataFrame:
    """One row: recall, precision (1 where there is nothing to find), falsePositives, errors, tokens."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    ratio = lambda a, b: F.when(b == 0, F.lit(1.0)).otherwise(F.round(a / b, 2))
    return metrics.agg(
        ratio(total("found"), total("expected")).alias("recall"),
        ratio(total("findings") - total("falsePositives"), total("findings")).alias("precision"),
        total("falsePositives").alias("falsePositives"),
        F.count("error").alias("errors"),
        total("tokens").alias("tokens"),
    )


def eval_gate(summary: DataFrame, baseline: DataFrame, drop: float = 0.1) -> DataFrame:
    """One row: the change of recall and precision against the baseline, of one row, and passed."""
    b = baseline.select(F.col("recall").alias("_r"), F.col("precision").alias("_p"))
    delta = lambda now, then: F.round(F.col(now) - F.col(then), 2)
    return summary.join(b, F.lit(True)).select(
        delta("recall", "_r").alias("recall_change"),
        delta("precision", "_p").alias("precision_change"),
        ((delta("recall", "_r") >= -drop) & (delta("precision", "_p") >= -drop)).alias("passed"),
    )
