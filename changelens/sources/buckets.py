"""Stored tables dealt to buckets by key: a change reads and rewrites the buckets that it touches, and no others."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Buckets:
    """A Parquet table below path, with a folder for each of n buckets of its keys' hashes.

    rewrite() replaces whole buckets by Spark's dynamic overwrite of partitions, so a bucket has the files of its last
    rewriting only and needs no compaction. A bucket that was written holds one marking row beside its own, so that it is
    replaced even if nothing of it is left. A rewriting that runs again gives the same; readers meanwhile can see some
    buckets before and some after it.
    """

    path: str
    schema: str
    keys: list[str]
    n: int = 256

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n)).cast("int")

    def read(self, spark: SparkSession, of: list[int] | None = None) -> DataFrame:
        """The table's rows, or those of some buckets; the folders of others are not opened."""
        try:
            rows = spark.read.schema(f"{self.schema}, `_row` boolean, `_bucket` int").parquet(self.path)
        except AnalysisException as error:  # never written
            if error.getCondition() == "PATH_NOT_FOUND":
                return spark.createDataFrame([], self.schema)
            raise
        if of is not None:
            rows = rows.filter(F.col("_bucket").isin(of))
        return rows.filter("_row").drop("_row", "_bucket")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of rows(keys): n numbers at most."""
        return sorted(r["b"] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def rewrite(self, rows: DataFrame, touched: list[int]) -> None:
        """Puts rows in the place of all that the touched buckets hold. A large bucket is written by several tasks."""
        spark = rows.sparkSession
        own = spark.createDataFrame([], self.schema)
        dealt = rows.select(*own.columns).withColumns({"_row": F.lit(True), "_bucket": self.bucket()})
        marks = spark.createDataFrame([(b,) for b in touched], "`_bucket` int").select(
            *(F.lit(None).cast(f.dataType).alias(f.name) for f in own.schema), F.lit(False).alias("_row"), "_bucket"
        )
        both = dealt.hint("rebalance", "_bucket").unionByName(marks)
        both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)


@dataclass
class Latest:
    """How rows of one key become one, whatever order they come in and however often.

    order names the columns that date a row. `last` columns are the latest row's, null or not; `known` ones the latest
    that wasn't null; `first` ones the earliest that wasn't. A state keeps the date of each, so an event that comes late,
    or once more, changes only what it would have changed in time.
    """

    keys: list[str]
    order: list[str]
    last: list[str] = field(default_factory=list)
    known: list[str] = field(default_factory=list)
    first: list[str] = field(default_factory=list)

    def lifted(self, changes: DataFrame) -> DataFrame:
        """changes(keys, order, last, known, first) as states."""
        at = F.struct(*self.order)
        dates = [F.when(F.col(c).isNotNull(), at).alias(f"{c}_at") for c in (*self.known, *self.first)]
        return changes.select(*self.keys, at.alias("as_of"), *self.last, *self.known, *self.first, *dates)

    def folded(self, states: DataFrame) -> DataFrame:
        """One state a key. Folding states of states is the same as folding all of their rows at once."""
        kept = [F.max("as_of").alias("as_of"), *(F.max_by(c, "as_of").alias(c) for c in self.last)]
        for names, take, date in ((self.known, F.max_by, F.max), (self.first, F.min_by, F.min)):
            kept += [take(c, f"{c}_at").alias(c) for c in names] + [date(f"{c}_at").alias(f"{c}_at") for c in names]
        return states.groupBy(*self.keys).agg(*kept)

    def schema(self, changes: DataFrame) -> str:
        """The schema of a table of states of such changes."""
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.lifted(changes).schema)


def merge(table: Buckets, rule: Latest, changes: DataFrame) -> None:
    """Folds changes into the stored states. Costs what their buckets hold; without changes nothing is written."""
    states = rule.folded(rule.lifted(changes))
    touched = table.touched(states)
    if touched:
        stored = table.read(changes.sparkSession, touched)
        table.rewrite(rule.folded(stored.unionByName(states)), touched)
