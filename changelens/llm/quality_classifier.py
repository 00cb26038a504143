"""Quality classifier: document evidence with host and path posteriors, by hierarchical empirical Bayes."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelens.llm.scratch import named, ship, written

WORD = re.compile(r"\w+")
#: Prefixes of words, so that a word's stem speaks for forms that the sample lacks.
STEMS = (4, 5)
#: The weight of the level above where sites don't differ.
NO_DIFFERENCE = 1e9
#: Site tables of up to so many bytes are broadcast; larger ones are joined by shuffling.
BROADCAST_BYTES = 16 << 20


def features(text: str) -> set[str]:
    """What a text shows: its lower-case words, their stems, and coarse steps of its form, each once."""
    words = WORD.findall(text.lower())
    out = set(words)
    out.update([f"{w[:k]}~" for k in STEMS for w in out if len(w) > k])
    n = len(words)
    if n >= 20:
        lines = [line for line in text.split("\n") if line.strip()]
        shape = {
            "distinct": len(set(words)) / n,
            "symbols": sum(map(text.count, "#*$%&|<>")) / n,
            "marks": sum(map(text.count, "!?")) / n,
            "capitals": sum(map(str.isupper, text)) / len(text),
            "length": sum(map(len, words)) / n / 10,
            "lines": len(set(lines)) / max(1, len(lines)),
        }
        out.update(f"={name}{min(20, int(20 * value))}" for name, value in shape.items())
    return out


def feature_counts(docs: DataFrame) -> DataFrame:
    """(feature, bad, good): how many documents of docs(text, bad) show each feature."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for text, bad in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts[bad].update(features(text.as_py() or ""))
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_pydict({
                "feature": pa.array(names, pa.string()),
                "bad": pa.array([counts[1][x] for x in names], pa.int64()),
                "good": pa.array([counts[0][x] for x in names], pa.int64()),
            })

    return (
        docs.select("text", "bad")
        .mapInArrow(count, "feature string, bad long, good long")
        .groupBy("feature")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    )


def telling_features(counts: DataFrame, n_bad: int, n_good: int, most: int, *, ratio: float = 2.0, test: float = 12.0) -> dict[str, float]:
    """The log likelihood ratios of features that speak for bad documents: of at least ratio, and beyond chance by a
    likelihood-ratio test (G squared) of at least test."""
    llr = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (n_good + 1))
    share = n_bad / (n_bad + n_good)
    n = F.col("bad") + F.col("good")
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    rows = (
        counts.withColumn("llr", llr)
        .withColumn("g", 2 * (part(F.col("bad"), n * share) + part(F.col("good"), n * (1 - share))))
        .filter((F.col("llr") >= ratio) & (F.col("g") >= test))
        .orderBy(F.desc("g"), "feature")
        .limit(most)
    )
    return {r["feature"]: r["llr"] for r in rows.collect()}


def scored(docs: DataFrame, llr: dict[str, float], *, strongest: int = 3) -> DataFrame:
    """docs(doc_id, text, ...) with, for text, step: the sum of its strongest log ratios, in whole steps."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(llr)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        names = known.keys()
        for batch in batches:
            steps = []
            for text in batch.column(1):
                top = sorted((known[x] for x in features(text.as_py() or "") & names), reverse=True)[:strongest]
                steps.append(math.floor(sum(top)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(steps, pa.int32())], [*names_out, "step"])

    names_out = [c for c in docs.columns if c != "text"]
    out = T.StructType([*(docs.schema[c] for c in names_out), T.StructField("step", T.IntegerType())])
    return docs.select("doc_id", "text", *names_out[1:]).mapInArrow(score, out)


def chance_at(rate: Column | float, evidence: Column) -> Column:
    """The chance of being bad at a site of that rate: its odds times e to the evidence, which is infinite for a label."""
    return 1 / (1 + (1 - rate) / rate * F.exp(-evidence))


def held_in(rate: Column) -> Column:
    return F.greatest(F.least(rate, F.lit(1 - 1e-9)), F.lit(1e-9))


def site_cells(rows: DataFrame, *site: str) -> DataFrame:
    """(site, cells, size): each site's documents as an array of (evidence, n), sorted; as long as there are score steps."""
    pooled = rows.groupBy(*site, "evidence").agg(F.sum("n").alias("n"))
    cells = F.sort_array(F.collect_list(F.struct("evidence", "n"))).alias("cells")
    return pooled.groupBy(*site).agg(cells, F.sum("n").alias("size"))


def over_cells(value) -> Column:
    """The sum of n * value(evidence) over a site's cells."""
    return F.aggregate("cells", F.lit(0.0), lambda total, c: total + c["n"] * value(c["evidence"]))


def prior_weight(sites: DataFrame, above: str) -> float:
    """How many documents the rate of the level above counts for, from how far sites(cells, size, above) differ.

    At the rate r of the level above, a document's score is s = (c - r) / (r (1 - r)), c being its chance there. Without
    site differences a site's sum of scores U has the variance I, the sum of s squared; differences of variance t in the
    rates add I * I * t. So t is the sum of U * U - I over all sites, by that of I * I, and the weight of a beta prior
    follows as r (1 - r) / t - 1. Evidence that tells little has a small I, so chances that vary less than labels do
    don't hide a difference. It is rounded, so that the order of a sum doesn't show.
    """
    r = F.col(above)
    score = lambda e: (chance_at(r, e) - r) / (r * (1 - r))
    at = sites.select(over_cells(score).alias("u"), over_cells(lambda e: score(e) * score(e)).alias("i"), (F.col("size") * r * (1 - r)).alias("spread"), "size")
    row = at.agg(F.sum(F.col("u") * F.col("u") - F.col("i")).alias("t"), F.sum(F.col("i") * F.col("i")).alias("ii"), F.sum("spread").alias("spread"), F.sum("size").alias("n")).first()
    if not row["n"] or not row["ii"] or row["t"] <= 0:
        return NO_DIFFERENCE
    return float(f"{min(NO_DIFFERENCE, max(1.0, row['spread'] / row['n'] * row['ii'] / row['t'] - 1)):.6g}")


def site_rate(above: Column, weight: float, rounds: int = 30) -> Column:
    """A site's bad rate by expectation and maximisation: its documents' chances at the rate, with weight documents of the rate above."""
    step = lambda r, _: held_in((over_cells(lambda e: chance_at(r, e)) + weight * above) / (F.col("size") + weight))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), held_in(above), step)


def overall_rate(cells: list[tuple[float, int]], start: float) -> float:
    """The bad rate of all documents, from (evidence, n)."""
    if not cells:
        return start
    evidence, n = np.array([c[0] for c in cells]), np.array([c[1] for c in cells], dtype=float)
    rate = start
    for _ in range(200):
        rate = float(np.clip((n / (1 + (1 - rate) / rate * np.exp(-evidence))).sum() / n.sum(), 1e-6, 1 - 1e-6))
    return float(f"{rate:.9g}")


def classify(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    sample: int = 40_000,
    most_features: int = 50_000,
    reject_above: float = 0.5,
    whole: bool = False,
) -> DataFrame:
    """One row a document: its evidence, its host's and path's bad rates, the posterior of being bad, and kept.

    labels(doc_id, quality, toxic): quality 0 or toxic 1 means bad; of repeated labels the worst counts, null ones
    count as clean. Up to `sample` labelled documents, those with the smallest hashes of doc_id, train the features;
    all other labelled ones calibrate: the ratio of a score step's shares among bad and good documents, smoothed and
    non-decreasing in the step, is the evidence.

    A site's documents are then counts by evidence, a labelled document being certain. From them follow the overall bad
    rate, each host's, shrunk towards it, and each path's in a host, shrunk towards the host's, as far as
    prior_weight() says; sparse sites stay close to the level above. The posterior is the path's odds times the
    document's own evidence; its own label, if it has one, counts at its site only.

    The table has no URLs: by default the source stands for the host and the language for the path.

    The driver holds most_features ratios and some tens of steps. A null text has no feature; a null host or path is
    a site of its own, apart from an empty one; documents without labels are judged like all others; without any label
    the evidence is even and everything is kept. Repeated rows are judged alike. An empty table gives an empty result.
    whole adds each document's row as the struct document.
    """
    ship(docs.sparkSession)
    site = lambda c: F.col(c).cast("string")
    own = [F.struct(*(F.col(named(c)) for c in docs.columns)).alias("document")] if whole else []
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), site(host_col).alias("host"), site(path_col).alias("path"), *own)
    marked = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad")
    )
    order = F.xxhash64("doc_id", F.lit(3))
    part = sample / max(1, marked.count())
    edge = -(1 << 63) + int(min(0.7, part) * (1 << 64))  # so that some are left to calibrate
    marked = marked.withColumn("training", order < F.lit(min(edge, (1 << 63) - 1)))
    chosen = marked.filter("training")
    if chosen.count() <= 2 * sample:  # by the bound; only a table of repeated hashes could hold more
        chosen = F.broadcast(chosen)
    training = docs.select("doc_id", "text").join(chosen, "doc_id")
    sizes = training.groupBy("bad").count()
    sizes = {r["bad"]: r["count"] for r in sizes.collect()}
    n_bad, n_good = sizes.get(True, 0), sizes.get(False, 0)
    llr = telling_features(feature_counts(training), n_bad, n_good, most_features) if n_bad and n_good else {}

    rows = written(scored(docs.select("doc_id", "text", "host", "path"), llr), "scored")
    seen = written(
        rows.select("doc_id", "host", "path", "step").join(marked, "doc_id", "left").groupBy("host", "path", "step", "bad", "training").agg(F.count("*").alias("n")),
        "site-counts",
    )
    held = seen.filter(~F.col("training")).groupBy("step").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("good"))
    evidence, rate = calibrated([(r["step"], r["bad"], r["good"]) for r in held.collect()])
    steps = F.broadcast(docs.sparkSession.createDataFrame(sorted(evidence.items()), "known int, evidence double"))
    at_step = F.least(F.greatest("step", F.lit(0)), F.lit(max(evidence))) == F.col("known")
    paths = path_rates(seen.join(steps, at_step), rate)
    joined = F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path"))
    size = paths.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("host"), F.lit(0)) + F.coalesce(F.octet_length("path"), F.lit(0))).alias("bytes")).first()
    few = (size["bytes"] or 0) + 40 * size["n"] <= BROADCAST_BYTES
    paths = paths.withColumnsRenamed({"host": "_host", "path": "_path"})
    if whole:  # scored again beside their rows: a table of them would hold the corpus once more
        rows = scored(docs, llr)
    return (
        rows.join(steps, at_step)
        .join(F.broadcast(paths) if few else paths, joined)
        .withColumn("posterior", chance_at(F.col("path_rate"), F.col("evidence")))
        .select("doc_id", "host", "path", "evidence", "host_rate", "path_rate", "posterior", (F.col("posterior") <= reject_above).alias("kept"), *(["document"] if whole else []))
    )


def path_rates(seen: DataFrame, start: float) -> DataFrame:
    """(host, path, host_rate, path_rate) of counts seen(host, path, evidence, bad, n); where bad is known, it is certain."""
    certain = F.when(F.col("bad"), float("inf")).otherwise(float("-inf"))
    counts = written(
        seen.withColumn("evidence", F.when(F.col("bad").isNull(), F.col("evidence")).otherwise(certain)).groupBy("host", "path", "evidence").agg(F.sum("n").alias("n")),
        "site-cells",
    )
    overall = overall_rate([(r["evidence"], r["n"]) for r in counts.groupBy("evidence").agg(F.sum("n").alias("n")).orderBy("evidence").collect()], start)
    hosts = written(site_cells(counts, "host").withColumn("overall", F.lit(overall)), "host-cells")
    rates = hosts.select(F.col("host").alias("_host"), site_rate(F.col("overall"), prior_weight(hosts, "overall")).alias("host_rate"))
    paths = written(site_cells(counts, "host", "path").join(rates, F.col("host").eqNullSafe(F.col("_host"))).drop("_host"), "path-cells")
    weight = prior_weight(paths, "host_rate")
    return written(paths.select("host", "path", "host_rate", site_rate(F.col("host_rate"), weight).alias("path_rate")), "path-rates")


def calibrated(counts: list[tuple[int, int, int]]) -> tuple[dict[int, float], float]:
    """(log ratio of each score step from 0 to the greatest, bad rate) from (step, bad, good) counts.

    Neighbouring steps whose ratios fall are pooled, so more score never means less evidence.
    """
    bad, good = sum(c[1] for c in counts), sum(c[2] for c in counts)
    top = max([c[0] for c in counts], default=0)
    found = {step: (b, g) for step, b, g in counts}
    pools: list[list[float]] = []  # bad, good, steps
    ratio = lambda p: math.log((p[0] + 0.5) / (bad + 1)) - math.log((p[1] + 0.5) / (good + 1))
    for step in range(top + 1):
        pools.append([*found.get(step, (0, 0)), 1])
        while len(pools) > 1 and (ratio(pools[-1]) < ratio(pools[-2]) or not pools[-1][0] + pools[-1][1]):
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    values = np.repeat([ratio(p) if bad and good else 0.0 for p in pools], [int(p[2]) for p in pools])
    rate = (bad + 0.5) / (bad + good + 1) if bad and good else 0.01
    return dict(enumerate(values.tolist())), rate
