"""The dealt methods against brute force: plain forms of each over small tables."""

import math
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelens.llm import mixing, near_dedup, packing, quality_classifier, quality_rules, sharding, token_shards, url_filters
from changelens.llm.tokens import word_tokenizer


def plain_rates(cells, above, weight, rounds=30):
    """A site's rate by EM over (evidence, n), in NumPy."""
    e, n = np.array([c[0] for c in cells]), np.array([c[1] for c in cells], dtype=float)
    rate = above
    for _ in range(rounds):
        chance = 1 / (1 + (1 - rate) / rate * np.exp(-e))
        rate = min(max(((n * chance).sum() + weight * above) / (n.sum() + weight), 1e-9), 1 - 1e-9)
    return rate


def plain_weight(sites):
    """sites: (cells, rate above). The weight of the level above, in NumPy."""
    t = ii = spread = total = 0.0
    for cells, r in sites:
        e, n = np.array([c[0] for c in cells]), np.array([c[1] for c in cells], dtype=float)
        score = (1 / (1 + (1 - r) / r * np.exp(-e)) - r) / (r * (1 - r))
        u, i = (n * score).sum(), (n * score**2).sum()
        t, ii, spread, total = t + u * u - i, ii + i * i, spread + n.sum() * r * (1 - r), total + n.sum()
    return 1e9 if t <= 0 else min(1e9, max(1.0, spread / total * ii / t - 1))


def test_site_rates_equal_plain_empirical_bayes(spark):
    rng = np.random.default_rng(4)
    seen = []
    for h in [None, "", "a", "b", "bad"]:
        for p in ["x", "y", None]:
            share = 0.9 if h == "bad" else 0.6 if (h, p) == ("a", "y") else 0.1
            for evidence in (-2.0, 0.5, 3.0):
                n = int(rng.integers(1, 60) * (1 + 3 * share * (evidence > 0)))
                seen.append((h, p, evidence, None, n))
            seen.append((h, p, 0.0, True, int(20 * share)))
            seen.append((h, p, 0.0, False, int(20 * (1 - share))))
    seen = [row for row in seen if row[4]]
    got = {(r["host"], r["path"]): r for r in quality_classifier.path_rates(spark.createDataFrame(seen, "host string, path string, evidence double, bad boolean, n long"), 0.2).collect()}
    by_path, by_host, every = defaultdict(Counter), defaultdict(Counter), Counter()
    for h, p, e, bad, n in seen:
        e = e if bad is None else math.inf if bad else -math.inf
        by_path[h, p][e] += n
        by_host[h][e] += n
        every[e] += n
    cells = lambda c: sorted(c.items())
    overall = plain_rates(cells(every), 0.2, 0.0, 200)
    w = plain_weight([(cells(c), overall) for c in by_host.values()])
    host = {h: plain_rates(cells(c), overall, w) for h, c in by_host.items()}
    wp = plain_weight([(cells(c), host[h]) for (h, _), c in by_path.items()])
    assert w < 50 and wp < 200
    for (h, p), c in by_path.items():
        assert got[h, p]["host_rate"] == pytest.approx(host[h], rel=1e-4)
        assert got[h, p]["path_rate"] == pytest.approx(plain_rates(cells(c), host[h], wp), rel=1e-4)
    assert got["bad", "x"]["path_rate"] > got["b", "x"]["path_rate"]
    assert got[None, "x"]["path_rate"] != got["", "x"]["path_rate"]


def test_equal_texts_are_judged_by_their_site(spark):
    rng = np.random.default_rng(8)
    words = lambda: " ".join(f"w{x}" for x in rng.integers(0, 50, 40))
    docs = [(i, words(), "bad" if i % 4 == 0 else f"h{i % 4}", "x") for i in range(2000)]
    docs += [(3000, "the same text", "bad", "x"), (3001, "the same text", "h1", "x"), (3002, "the same text", "new", "x"), (3003, None, None, None)]
    labels = [(i, 1, int(d[2] == "bad" and i % 5 > 0)) for i, d in enumerate(docs[:1000])]
    out = quality_classifier.classify(
        spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    )
    by = {r["doc_id"]: r for r in out.filter("doc_id >= 3000").collect()}
    assert by[3000]["evidence"] == by[3001]["evidence"]
    assert by[3000]["posterior"] > 0.5 > by[3002]["posterior"] > by[3001]["posterior"]
    assert not by[3000]["kept"] and by[3001]["kept"]
    sparse = by[3002]
    assert abs(sparse["path_rate"] - by[3003]["path_rate"]) < 0.1  # sites of one document stay near the overall rate


def test_shards_equal_plain_longest_processing_time(spark):
    rng = np.random.default_rng(6)
    texts = ["x" * int(n) for n in rng.integers(1, 4000, 150)]
    texts += texts[:20] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = sharding.lpt_shards(docs, 7, grain=10**6).collect()  # every group is above the limit
    loads = Counter()
    for r in out:
        loads[r["shard"]] += r["size"]
    group = Counter()
    for t in texts:
        group[t] += len(t) + 16
    plain = [0] * 7
    for size in sorted(group.values(), reverse=True):
        plain[plain.index(min(plain))] += size
    assert sorted(loads.values()) == sorted(plain)
    bundled = Counter()
    for r in sharding.lpt_shards(docs, 7, grain=8).collect():
        bundled[r["shard"]] += r["size"]
    assert max(bundled.values()) - min(bundled.values()) <= max(group.values()) + sum(group.values()) / (7 * 8) * 3


def test_splitting_tree_keeps_its_margins_and_law():
    quotas = [1000, 3, 0, 57, 40]
    for n in (1, 2, 7, 64):
        dealt = mixing.split_quotas(quotas, n, 1)
        assert dealt.sum(0).tolist() == quotas and max(dealt.sum(1)) - min(dealt.sum(1)) <= 1 and (dealt >= 0).all()
    draws = np.array([mixing.split_quotas([30, 10, 60], 4, seed)[0] for seed in range(3000)])
    assert np.allclose(draws.mean(0), [7.5, 2.5, 15], atol=0.2)
    variance = 25 * np.array([0.3 * 0.7, 0.1 * 0.9, 0.6 * 0.4]) * 75 / 99
    assert np.allclose(draws.var(0), variance, rtol=0.12)


def test_wide_draws_follow_the_exact_law():
    good, bad, n = 12, 20, 9
    rng = np.random.default_rng(0)
    seen = Counter(mixing.by_weights(rng, good, bad, n) for _ in range(20_000))
    for k in range(10):
        p = math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n)
        assert abs(seen[k] / 20_000 - p) < 0.015
    assert 0 <= mixing.by_weights(rng, 10**10, 10**10, 5) <= 5
    assert abs(mixing.hypergeometric(rng, 10**10, 3 * 10**10, 10**10) / 10**10 - 0.25) < 1e-4


def mix_docs(spark):
    rng = np.random.default_rng(9)
    size = lambda i: 0 if i % 50 == 0 else int(rng.integers(1, 90))
    docs = [(i, " ".join(f"d{i}w{j}" for j in range(size(i))), f"s{i % 7}" if i % 3 else "hot", 1, 2) for i in range(600)]
    docs += [(700, None, None, 1, 2), (701, "a b c", None, 1, 2), (702, "", "", 1, 2), *docs[5:8]]
    return docs, spark.createDataFrame(docs, "doc_id long, text string, source string, Number int, row_number int")


def test_blocks_are_disjoint_and_follow_the_tree(spark):
    docs, df = mix_docs(spark)
    found = {}
    for n in (3, 16):
        rows, blocks = (x.collect() for x in mixing.mix_blocks(df, n_shards=n, block_words=20))
        keys = [(b["row_id"], b["copy"], b["block"]) for b in blocks]
        assert len(keys) == len(set(keys))
        size = {r["row_id"]: r["size"] for r in rows}
        assert all(b["start"] == 20 * b["block"] and 0 < b["words"] <= min(20, size[b["row_id"]] - b["start"]) for b in blocks)
        quota = Counter((b["source"], b["copy"]) for b in blocks)
        names = sorted(quota, key=lambda x: (x[0] is None, x[0] or "", x[1]))
        dealt = mixing.split_quotas([quota[x] for x in names], n, 17)
        by_shard = Counter((b["source"], b["copy"], b["shard"]) for b in blocks)
        assert all(by_shard[*name, shard] == dealt[shard, i] for i, name in enumerate(names) for shard in range(n))
        taken, target = Counter(), {}
        for r in rows:
            target[r["source"]] = r["target"]
        for b in blocks:
            taken[b["source"]] += b["words"]
        assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
        found[n] = {k: w for k, w in Counter({r["row_id"]: 0 for r in rows}).items()} | dict(Counter(b["row_id"] for b in blocks))
    assert found[3] == found[16]


def test_mixed_documents_are_the_drawn_blocks(spark):
    docs, df = mix_docs(spark)
    taken = Counter()
    for r in mixing.mixture(df, n_shards=4, block_words=20).collect():
        taken[r["doc_id"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"] and (r["shard"] is None) == (r["taken"] == 0)
    out = mixing.mixed_documents(df, n_shards=4, block_words=20)
    assert out.columns == df.columns
    text, words = {d[0]: d[1] for d in docs}, Counter()
    parts = out.withColumn("part", F.spark_partition_id()).collect()
    for r in parts:
        own = (text[r["doc_id"]] or "").split()
        drawn = r["text"].split()
        assert drawn and [w for w in own if w in set(drawn)] == drawn
        words[r["doc_id"]] += len(drawn)
    assert words == +taken and len({r["part"] for r in parts}) == 4
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_large_shards_lie_in_several_partitions(spark):
    ends = (-(2**63), -(2**62), -1, 0, 5, 2**62, 2**63 - 1)
    rows = spark.createDataFrame([(s, k) for k in ends for s in (1, 0, 2)], "shard int, shuffle_key long")
    out = mixing.laid_out(rows, 3, F.col("shard"), F.col("shuffle_key"), 4).withColumn("p", F.spark_partition_id()).collect()
    assert [(r["shard"], r["shuffle_key"]) for r in sorted(out, key=lambda r: r["p"])] == [(s, k) for s in range(3) for k in ends]
    assert {r["p"] for r in out} == set(range(12))

    _, df = mix_docs(spark)
    whole = mixing.mixed_documents(df, n_shards=4, block_words=20)
    in_parts = mixing.mixed_documents(df, n_shards=4, block_words=20, part_words=60)
    assert in_parts.rdd.getNumPartitions() > whole.rdd.getNumPartitions() == 4
    text = lambda d: [tuple(r) for r in d.collect()]
    assert text(in_parts) == text(whole)


def test_cut_documents_keep_their_line_ends(spark):
    ends = (" ", "\n", "  ", "\t\n")
    text = {i: " " + "".join(f"w{i}x{j}" + ends[(i + j) % 4] for j in range(90)) for i in range(12)}
    df = spark.createDataFrame([(i, t, "abc"[i % 3]) for i, t in text.items()], "doc_id long, text string, source string")
    out = mixing.mixed_documents(df, n_shards=4, block_words=20).collect()
    cut = [r for r in out if r["text"] != text[r["doc_id"]]]
    assert cut and all(w in text[r["doc_id"]] for r in cut for w in re.findall(r"\S+\s*", r["text"]))


def test_slots_are_the_permutation_of_the_sequences(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i * 7 % 90))) for i in range(40)] + [(40, None)], "doc_id long, text string")
    rows = token_shards.sequences(docs, id_col="doc_id", text_col="text", length=16, end_id=0, vocabulary=None)
    placed, n = token_shards.slotted(rows, key=5, shard_rows=8)
    placed = placed.collect()
    order = rows.orderBy("split", "place").collect()
    slots = token_shards.feistel(np.arange(n), n, 5)
    assert n == len(order) and {(r["doc_id"], r["piece"]): r["slot"] for r in placed} == {(r["doc_id"], r["piece"]): s for r, s in zip(order, slots.tolist(), strict=True)}
    assert all(r["shard"] == r["slot"] // 8 for r in placed)
    tokens = defaultdict(list)
    for r in sorted(order, key=lambda r: r["piece"]):
        tokens[r["doc_id"]] += np.frombuffer(r["ids"], dtype="<u2")[: r["n_tokens"]].tolist()
    for d in docs.collect():
        assert tokens[d["doc_id"]] == word_tokenizer().library.encode(d["text"] or "", add_special_tokens=False).ids + [0]


def test_ids_beyond_16_bits_are_an_error(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    stored = docs.select(F.lit(1))
    assert token_shards.with_scheme("s3://x/y", stored) == "s3://x/y"
    assert token_shards.with_scheme("/x", stored) == "/x"


def test_each_bin_is_the_fullest_that_holds_the_largest_left():
    rng = np.random.default_rng(7)
    for _ in range(60):
        lengths = rng.integers(1, 40, rng.integers(1, 12))
        bins = packing.minimum_bin_slack(lengths, 40)
        left = list(range(len(lengths)))
        for b in range(bins.max() + 1):
            chosen = [i for i in left if bins[i] == b]
            largest = max(lengths[left])
            best = max(
                sum(lengths[list(c)]) for k in range(1, len(left) + 1) for c in combinations(left, k) if sum(lengths[list(c)]) <= 40 and max(lengths[list(c)]) == largest
            )
            assert sum(lengths[chosen]) == best and max(lengths[chosen]) == largest
            left = [i for i in left if i not in chosen]
        assert not left


def test_equal_pieces_are_dealt_to_all_groups(spark):
    out = packing.pack_documents(spark.createDataFrame([(1, "some words here")] * 3000, "doc_id long, text string"), group_rows=500).collect()
    groups = Counter(r["sequence_id"] >> 32 for r in out)
    assert len(out) == 3000 and len(groups) == 6 and max(groups.values()) < 700
    kinds = dict(packing.pack_documents(spark.createDataFrame([(1, "x")], "doc_id long, text string")).dtypes)
    assert kinds == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}


def plain_cutoffs(rows, most, risk, price):
    """rows: (stratum, good, score). The certified cutoffs."""
    tail = lambda k, n: sum(math.comb(n, i) * most**i * (1 - most) ** (n - i) for i in range(k + 1))
    n = Counter(s for s, good, _ in rows if good)
    order = sorted({r[0] for r in rows}, key=lambda s: (-n[s], s))
    alone = {s for m, s in enumerate(order, start=1) if tail(0, n[s]) <= risk / (m + 1)}
    out = {}
    for unit in [*({s} for s in alone), set(order) - alone]:
        mine = [r for r in rows if r[0] in unit]
        total = sum(r[1] for r in mine)
        best = (0, None)
        for cutoff in range(2001):
            good, bad = sum(r[1] and r[2] > cutoff for r in mine), sum(not r[1] and r[2] > cutoff for r in mine)
            if tail(good, total) <= risk / (len(alone) + 1):
                best = max(best, (bad - price * good, cutoff), key=lambda x: (x[0], -1 if x[1] is None else x[1]))
        if best[0] > 0:
            out |= {s: best[1] for s in unit}
    return out


def test_cutoffs_equal_plain_tests_and_pool_small_strata(spark):
    rng = np.random.default_rng(3)
    rows = []
    for stratum, n in (("en", 700), ("de", 230), ("fr", 220), ("xx", 2)):
        for _ in range(n):
            good = rng.random() < 0.85
            rows.append((stratum, bool(good), int(rng.integers(0, 40)) if good or rng.random() < 0.1 else int(rng.integers(20, 200))))
    holdout = spark.createDataFrame(rows, "stratum string, good boolean, score int")
    got = {r["stratum"]: r["cutoff"] for r in quality_rules.certified_cutoffs(holdout).collect()}
    want = plain_cutoffs(rows, 0.02, 0.05, 20.0)
    assert got == want and set(got) == {"en", "de", "fr", "xx"} and got["de"] == got["fr"] == got["xx"] != None  # noqa: E711


def test_all_rules_together_stay_within_the_bound(spark):
    # Every rule alone rejects some good texts; what is certified is the loss by any of them.
    good = [" ".join(f"w{i}x{j}" for j in range(50)) for i in range(1200)]
    good = [t + (" ###" * 9 if i % 90 == 0 else " !!!" * 9 if i % 90 == 30 else " ABCDEFGHIJ" * 9 if i % 90 == 60 else "") for i, t in enumerate(good)]
    bad = [" ".join(f"w{i}y{j}" for j in range(50)) + " ###" * 9 + " !!!" * 9 for i in range(300)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + bad)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 1200)) for i in range(1500)], "doc_id long, quality int")
    lost = quality_rules.apply_quality_rules(docs, labels, price=1.0).filter("doc_id < 1200 and not kept").count()
    k = max(k for k in range(40) if sum(math.comb(1200, i) * 0.02**i * 0.98 ** (1200 - i) for i in range(k + 1)) <= 0.05 / 2)
    assert lost <= k


CLASHING = [
    "_labelled", "good", "cutoff", "score", "stratum", "number", "document", "host", "path", "step", "evidence", "bad", "training", "known", "_host", "component", "node", "row_id", "shard",
    "shuffle_key", "copy", "parts", "words", "size", "target", "s", "a`b", "n_words", "kept", "base_failed", "doc.id", "group", "signature", "mixed_text", "place", "bucket",
]


def test_stages_carry_columns_of_any_name(spark):
    import corpus_pipeline

    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", len(t), *[f"v{i}"] * len(CLASHING)) for i, t in enumerate(texts)]
    names = ", ".join("`" + c.replace("`", "``") + "` string" for c in CLASHING)
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {names}")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    plain, corpus_pipeline.labels = corpus_pipeline.labels, lambda *_: labels
    try:
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHING], name
            out = docs.collect()
            assert len(out) >= 40 and all(r[5:] == (f"v{r['doc_id']}",) * len(CLASHING) for r in out)
    finally:
        corpus_pipeline.labels = plain


def test_banded_pairs_are_confirmed_whatever_their_signatures_say():
    from changelens.llm.signatures import shingle_set

    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words), " ".join(words[:90] + ["x"] * 3)]
    assert near_dedup.linked(shingle_set(texts[0]), shingle_set(texts[1]), 75)
    signatures = np.arange(256, dtype=np.uint8).reshape(2, 128)  # nothing alike ...
    assert near_dedup.link_forest(np.array([3, 7]), signatures, texts, 75) == []
    signatures[1, 8:12] = signatures[0, 8:12]  # ... but one band
    assert near_dedup.link_forest(np.array([3, 7]), signatures, texts, 75) == [(7, 3)]


def test_what_the_mix_takes_does_not_hang_on_the_number_of_shards(spark):
    docs = spark.createDataFrame([(i, "w " * (20 + i % 50), f"s{i % 4}") for i in range(200)], "doc_id long, text string, source string")
    taken = lambda n: sorted((r["doc_id"], r["taken"]) for r in mixing.mixture(docs, n_shards=n, block_words=16).collect())
    assert taken(4) == taken(13)


def test_captures_are_rows(spark):
    import datetime as dt

    at = dt.datetime(2024, 1, 5)
    captures = spark.createDataFrame(
        [(1, "http://a.com/x", at), (1, "http://a.com/x", at), (None, "http://a.com/x", at), (1, "http://b.com/", at)], "capture_id long, url string, fetched_at timestamp"
    )
    entries = spark.createDataFrame([("domain", "a.com", True, "block", at)], "kind string, pattern string, listed boolean, verdict string, at timestamp")
    for options in ({}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "part_rows": 2}):
        out = url_filters.judge_captures(captures, entries, **options).collect()
        assert sorted((str(r["capture_id"]), r["url"], r["n_active"], r["kept"]) for r in out) == [
            ("1", "http://a.com/x", 1, False), ("1", "http://a.com/x", 1, False), ("1", "http://b.com/", 0, True), ("None", "http://a.com/x", 1, False)
        ]


def test_large_families_meet_in_blocks(spark):
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join(base[: 100 + i % 20]) for i in range(60)] + [" ".join(base[:100] + [f"e{i}"]) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for options in ({}, {"block_rows": 16, "spread": 5}, {"block_rows": 10, "spread": 50}):
        out = near_dedup.near_duplicates(docs, **options).collect()
        assert len(out) == 180 and {r["component_id"] for r in out} == {0}


def test_probes_are_the_fewest_that_find_enough():
    from changelens.llm import neighbours

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16)) * 4
    for vectors, most in ((rng.normal(size=(1500, 16)), 0.95), (centres[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 16)) * 0.3, 0.3)):
        hashes = neighbours.StableHashes(16, float(np.sqrt(vectors.var(0).sum())) * 2.0, 1, 6, 5)
        changes = neighbours.perturbations(6, 400)
        probes, recall, share = neighbours.chosen_probes(vectors, hashes, 10, changes, 0.9, asking=50)
        assert recall >= 0.9 and share < most
        fewer = neighbours.chosen_probes(vectors, hashes, 10, changes[: probes - 1], 0.9, asking=50)
        assert fewer[1] < 0.9 or probes == 1
    assert neighbours.chosen_probes(np.ones((3, 4)), neighbours.StableHashes(4, 1.0, 1, 2, 5), 10, neighbours.perturbations(2, 4), 0.9)[:2] == (1, 1.0)


def test_recall_by_the_chosen_probes(spark):
    from changelens.llm import neighbours

    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(3000, 24))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]) for r in neighbours.neighbours(table, every=60).collect()}
    hits = 0
    for q in range(0, 3000, 60):
        d = ((vectors - vectors[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += sum((q, int(i)) in got for i in np.argsort(d)[:10])
    assert len(got) == 500 and hits / 500 >= 0.9
