"""Quality rules: cutoffs whose false rejections are bounded, stratum by stratum, on labelled documents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.llm.scratch import named, written

BLANKS = r"[\x20\x09-\x0D]+"
#: Each rule's value, large where a text looks bad, and what is usual for prose: limits of published web-text filters for
#: symbols, repeated lines, repeated windows and word length, and our own for capitals and marks. Their ratio alone counts.
RULES = {
    "symbols": ("n_symbols / nullif(n_words, 0)", 0.1),
    "dup_lines": ("n_dup_lines / nullif(n_lines, 0)", 0.3),
    "repeats": ("n_repeat_words / nullif(n_words, 0)", 0.18),
    "capitals": ("n_capitals / nullif(word_chars, 0)", 0.3),
    "word_length": ("word_chars / nullif(n_words, 0)", 10.0),
    "marks": ("n_marks / nullif(n_words, 0)", 0.1),
}
#: A level is a value in hundredths of its limit, held to TOP.
STEPS, TOP = 100, 20_000
#: Tables of up to so many labelled ids are broadcast to the documents.
BROADCAST_LABELS = 1_000_000
#: Cutoff tables of up to so many strata are broadcast.
BROADCAST_STRATA = 10_000


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, whatever body does with it in lambdas."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more among the words, the first finding included.

    Windows are hashed to 64 bits and sorted with their starts, so equal ones become neighbours.
    """
    window = lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i"))
    )
    same = lambda s, e, k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == e["h"])) | (
        (k + 1 < F.size(s)) & (s[F.least(k + 1, F.size(s) - 1)]["h"] == e["h"])
    )
    starts = lambda s: F.sort_array(F.transform(F.filter(s, lambda e, k: same(s, e, k)), lambda e: e["i"]))
    covered = F.aggregate(
        let(F.sort_array(let(words, window)), starts),
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return F.when(F.size(words) >= 3, covered).otherwise(0)


def text_statistics(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", whole: bool = False
) -> DataFrame:
    """Counts over each whole text, one row a document. A null text counts as empty, a null stratum as ''.

    whole: with the document's row itself, as the struct document.
    """
    own = [F.struct(*(F.col(named(c)) for c in docs.columns)).alias("document")] if whole else []
    kept = ["document"] if whole else []
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    long = lambda c: c.cast("long")
    return (
        docs.select(
            F.col(id_col).alias("doc_id"), text.alias("text"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), *own
        )
        .withColumn("words", F.array_remove(F.split("text", BLANKS), ""))
        .select(
            *kept,
            "doc_id",
            "stratum",
            long(F.size("words")).alias("n_words"),
            long(F.length(F.array_join("words", ""))).alias("word_chars"),
            long(F.regexp_count("text", F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
            let(lines, lambda x: F.struct(long(F.size(x)).alias("n"), long(F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
            long(repeated_words(F.col("words"))).alias("n_repeat_words"),
            long(F.regexp_count("text", F.lit(r"\p{Lu}"))).alias("n_capitals"),
            long(F.regexp_count("text", F.lit(r"[!?]"))).alias("n_marks"),
        )
        .select("*", F.col("lines.n").alias("n_lines"), F.col("lines.dup").alias("n_dup_lines"))
        .drop("lines")
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )


def level(rule: str) -> Column:
    """The rule's value in hundredths of its limit. 0 where a text has no words."""
    value, limit = RULES[rule]
    return F.coalesce(F.least(F.lit(TOP), F.floor(F.expr(value) / limit * STEPS)), F.lit(0)).cast("int")


def allowed_rejections(n: Column, most: float, risk: float) -> Column:
    """The largest k whose exact binomial tail P(X <= k | n, most) is at most risk; -1 if there is none.

    With k or fewer rejections among n good documents, the exact upper bound of the rate, at confidence 1 - risk, is
    at most `most`.
    """
    odds = math.log(most / (1 - most))
    step = lambda a, i: F.struct(
        (a["term"] + F.log((n - i) / (i + 1)) + odds).alias("term"),
        (a["tail"] + F.exp(a["term"])).alias("tail"),
        F.when(a["tail"] + F.exp(a["term"]) <= risk, i).otherwise(a["k"]).alias("k"),
    )
    start = F.struct((n * math.log1p(-most)).alias("term"), F.lit(0.0).alias("tail"), F.lit(-1).cast("long").alias("k"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.floor(n * most).cast("long")), start, step, lambda a: a["k"])


def certified_cutoffs(
    holdout: DataFrame, *, false_rejection: float = 0.02, risk: float = 0.05, price: float = 20.0
) -> DataFrame:
    """(stratum, cutoff): a text is rejected where its score, the highest of its rules' levels, lies above the cutoff.

    holdout(stratum, good, score). All rules of a stratum share one cutoff, in hundredths of their limits, so what is
    tested is the rejection by any of them, and false_rejection bounds the share of good texts that a stratum loses in all.

    A stratum with enough labelled good texts is tested by itself, the others together as the rest, whose bound then holds for
    them as a whole. Who is tested alone follows from the numbers of good texts only: of the m largest strata, the m-th
    is, if m + 1 shares of the risk still let it certify a cutoff that rejects none. Cutoffs are tested from the
    mildest on, one after the other, each against "it rejects more than false_rejection of good texts", by the exact
    binomial tail. Testing in a fixed order and stopping at the first failure needs no correction among cutoffs; the
    risk is divided among the tested strata (Bonferroni). So with probability 1 - risk, no stratum tested alone, nor the rest,
    breaks its bound. Of the cutoffs that pass, the one with the most rejected bad texts less price times the rejected
    good ones is taken, the mildest on ties; a stratum without such gain has no cutoff, and a rest of too few labelled
    good texts has none either.

    The table of strata, one row each, is ordered in one task.
    """
    good, bad = F.count_if("good"), F.count_if(~F.col("good"))
    largest = F.row_number().over(Window.orderBy(F.desc("n"), "stratum"))
    alone = F.col("n") * math.log1p(-false_rejection) <= F.log(F.lit(risk) / (F.col("m") + 1))
    strata = holdout.groupBy("stratum").agg(good.alias("n")).withColumn("m", largest)
    strata = written(strata.select("stratum", "n", F.when(alone, F.col("stratum")).alias("unit")), "quality-strata")  # a null unit is the rest
    shares = strata.agg(F.count("unit")).first()[0] + 1
    units = strata.groupBy("unit").agg(allowed_rejections(F.sum("n"), false_rejection, risk / shares).alias("allowed"))
    few = F.broadcast if strata.count() <= BROADCAST_STRATA else lambda df: df
    counts = (
        holdout.groupBy("stratum", "score")
        .agg(good.alias("good"), bad.alias("bad"))
        .join(few(strata.select("stratum", "unit")), "stratum")
        .groupBy("unit", "score")
        .agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    )
    above = Window.partitionBy("unit").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    tested = (
        counts.select("unit", (F.col("score") - 1).alias("cutoff"), F.sum("good").over(above).alias("good"), F.sum("bad").over(above).alias("bad"))
        .join(few(units.withColumnRenamed("unit", "of")), F.col("unit").eqNullSafe(F.col("of")))
        .filter(F.col("good") <= F.col("allowed"))
        .withColumn("gain", F.col("bad") - price * F.col("good"))
        .filter("gain > 0")
    )
    cutoffs = tested.groupBy("unit").agg(F.max_by("cutoff", F.struct("gain", "cutoff")).alias("cutoff"))
    return strata.select("stratum", F.col("unit").alias("of")).join(cutoffs, F.col("unit").eqNullSafe(F.col("of"))).select("stratum", "cutoff")


def apply_quality_rules(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", whole: bool = False, **options
) -> DataFrame:
    """One row a document: its counts, base_failed, and kept.

    labels (doc_id, quality): a document with quality 1 is good; of repeated labels the smallest counts, null ones
    are left out. The holdout is every labelled document that the base rules pass; certified_cutoffs says which cutoffs
    follow. Null text counts as empty and so fails the base rules; a stratum without any labelled document, an empty
    label table or an empty input rejects nothing more.
    Repeated rows are judged alike. Only the named columns are read, unless
    whole asks for each document's row, as the struct document. Then the statistics are written only of documents
    whose ids are labelled, as a table of all rows would hold the corpus once more.
    """
    columns = {"id_col": id_col, "text_col": text_col, "stratum_col": stratum_col}
    marked = labels.filter("quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    levels = lambda df: df.select("*", *(level(r).alias(r) for r in RULES)).withColumn("score", F.greatest(*RULES))
    if whole and marked.count() <= BROADCAST_LABELS:
        # Only the named columns, under names of our own, so that none of the documents' can clash.
        flat = docs.select(F.col(named(id_col)).alias("doc_id"), F.col(named(text_col)).alias("text"), F.col(named(stratum_col)).alias("lang"))
        holdout = levels(written(text_statistics(flat.join(F.broadcast(marked.select("doc_id")), "doc_id", "left_semi")), "labelled-rows"))
        judged = levels(text_statistics(docs, **columns, whole=True))
    else:
        holdout = judged = levels(written(text_statistics(docs, **columns, whole=whole), "quality-rows"))
    holdout = holdout.filter(~F.col("base_failed")).join(marked, "doc_id").select("stratum", "good", "score")
    cutoffs = written(certified_cutoffs(holdout, **options), "quality-cutoffs")
    few = cutoffs.count() <= BROADCAST_STRATA
    above = lambda c: F.coalesce(F.col(c) > F.col("cutoff"), F.lit(False))
    return judged.join(F.broadcast(cutoffs) if few else cutoffs, "stratum", "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        # One expression over both sides of the join: a part over the texts alone would be computed below the join once more.
        (~F.greatest("base_failed", above("score"))).alias("kept"),
        "stratum",
        *(above(r).alias(f"{r}_failed") for r in RULES),
        *(["document"] if whole else []),
    )
