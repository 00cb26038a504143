"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from changelens.llm import (
    license_scan,
    mixing,
    near_dedup,
    neighbours,
    packing,
    quality_classifier,
    quality_rules,
    sharding,
    token_shards,
    url_filters,
)
from changelens.llm.components import components
from changelens.llm.signatures import shingle_set
from changelens.llm.tokens import word_tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, row_id int, shard double, node string, words int"
LONG = " ".join(f"word{i % 977} and{i}" for i in range(30_000))
TEXTS = [
    None, "", "   \n\t", "one two", "one two three four five six", "ONE two Three four five six", "one two three four five six", LONG, LONG,
    "all rights reserved", "Ünï cödé ﬀ 中文 don't", "a\x00b \x85 x", "license " * 300,
]


def rows(texts=TEXTS):
    return [(i if i != 3 else None, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", 0, "x", 1, 0.5, "n", 2) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows() + rows()[-1:], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, None, 1), (4, 0, 0), (4, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")


def test_sharding(docs, none):
    out = sharding.lpt_shards(docs, 3).collect()
    assert len(out) == len(TEXTS) + 1
    slots, shards = defaultdict(list), defaultdict(set)
    by_crc = {r["text_crc32"]: r for r in out}
    for r in out:
        slots[r["shard"]].append(r["slot"])
        shards[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for key, x in shards.items() if key[0])
    assert by_crc[zlib.crc32(LONG.encode())]["size"] == len(LONG) + 16 and by_crc[None]["size"] == 16
    assert sharding.lpt_shards(none, 3).count() == 0


def test_license(docs, none):
    out = {r["doc_id"]: r for r in license_scan.license_labels(docs).collect()}
    assert out[9]["base_labels"] == "reserved" and (out[9]["first_word"], out[9]["last_word"], out[9]["score"]) == (0, 0, 1.0)
    assert out[0]["n_words"] == 0 and out[0]["labels"] == "" and out[0]["first_word"] is None
    assert license_scan.license_labels(docs).count() == len(TEXTS) + 1
    assert license_scan.license_labels(none).count() == 0


def test_license_wrapped_notice(spark):
    text = "x " * 500 + "Redistribution and use in source and\nbinary forms, with or without\nmodification, are permitted " + "y " * 900
    out = license_scan.license_labels(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert out["labels"] == "bsd" and out["score"] == 1.0 and out["n_base"] == 0


def test_quality_rules(docs, none, labels):
    out = quality_rules.apply_quality_rules(docs, labels).collect()
    assert len(out) == len(TEXTS) + 1
    by = {r["doc_id"]: r for r in out}
    assert by[0]["n_words"] == 0 and by[0]["base_failed"] and not by[0]["kept"]
    assert by[12]["n_repeat_words"] == 300 and by[12]["base_failed"]
    assert by[7]["n_words"] == 60_000 and by[7]["kept"]
    assert quality_rules.apply_quality_rules(none, labels).count() == 0
    assert quality_rules.apply_quality_rules(docs, labels.limit(0)).count() == len(TEXTS) + 1


def test_allowed_rejections_is_exact(spark):
    from math import comb

    from pyspark.sql import functions as F

    got = {r["n"]: r["k"] for r in spark.createDataFrame([(n,) for n in (0, 10, 300, 1000, 2000)], "n long").select("n", quality_rules.allowed_rejections(F.col("n"), 0.02, 0.01).alias("k")).collect()}
    for n, k in got.items():
        tail = lambda k: sum(comb(n, i) * 0.02**i * 0.98 ** (n - i) for i in range(k + 1))  # noqa: B023, E731
        assert (k == -1 or tail(k) <= 0.01) and tail(k + 1) > 0.01


def test_cutoffs_reject_bad_texts_and_keep_good_ones(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en") for i in range(3000)]
    bad = [(9000 + i, " ".join(f"w{i}y{j}###" for j in range(60)), "en") for i in range(200)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d[0], int(d[0] < 9000)) for d in good + bad], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality_rules.apply_quality_rules(docs, labels).filter("kept").collect()}
    assert kept == {d[0] for d in good}


def test_classifier(docs, none, labels):
    out = quality_classifier.classify(docs, labels).collect()
    assert len(out) == len(TEXTS) + 1 and all(0 <= r["posterior"] <= 1 for r in out)
    assert quality_classifier.classify(none, labels).count() == 0
    assert all(r["kept"] for r in quality_classifier.classify(docs, labels.limit(0)).collect())


def test_classifier_on_held_out_documents(spark):
    rng = np.random.default_rng(3)
    words = lambda: [f"w{x}" for x in rng.integers(0, 3000, 80)]
    docs = [(i, " ".join(words() + (["scum"] if i % 5 == 0 else [])), f"s{i % 7}", "en") for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(d[0], 1, int(d[0] % 5 == 0)) for d in docs[:1000]], "doc_id long, quality int, toxic int")
    out = quality_classifier.classify(df, labels).filter("doc_id >= 1000").collect()
    wrong = [r["doc_id"] for r in out if r["kept"] == (r["doc_id"] % 5 == 0)]
    assert len(wrong) <= 5


def brute_components(texts):
    words = [(t or "").encode("utf-8").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()) for w in words]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = list(TEXTS)
    for _ in range(12):
        base = [f"t{x}" for x in rng.integers(0, 400, rng.integers(20, 150))]
        for _ in range(rng.integers(1, 25)):
            copy = list(base)
            for at in rng.integers(0, len(copy), rng.integers(0, 5)):
                copy[at] = f"e{rng.integers(0, 999)}"
            base = copy if rng.random() < 0.4 else base
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes, roots = brute_components(texts)
    for options in ({}, {"block_bytes": 4000}, {"family_bytes": 2000, "block_bytes": 1000}):
        out = {r["doc_id"]: r for r in near_dedup.near_duplicates(df, **options).collect()}
        assert [out[i]["n_shingles"] for i in range(len(texts))] == sizes
        assert [out[i]["component_id"] for i in range(len(texts))] == roots
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out.values())


def test_near_duplicates_edges(docs, none):
    out = near_dedup.near_duplicates(docs).collect()
    assert len(out) == len(TEXTS) + 1
    by = {r["doc_id"]: r["component_id"] for r in out}
    assert by[5] == by[6] == 4 and by[8] == 7 and by[0] == 0 and by[1] == 1
    assert near_dedup.near_duplicates(none).count() == 0
    kept = [r["doc_id"] for r in near_dedup.without_near_duplicates(docs).collect()]
    assert sorted(k for k in kept if k is not None) == [0, 1, 2, 4, 7, 9, 10, 11, 12]


def test_pairs_of_low_estimate_are_confirmed():
    words = [f"w{i}" for i in range(104)]
    texts = [" ".join(words), " ".join(words[:-10] + [f"x{i}" for i in range(10)])]
    signatures = np.zeros((2, 128), dtype=np.uint8)
    signatures[1, 72:] = 1
    assert near_dedup.link_forest(np.array([5, 9]), signatures, texts, 75) in ([(9, 5)], [(5, 9)])


def test_without_near_duplicates_takes_rows_not_ids(spark):
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(40))
    rows = [
        (1, text(0)), (1, text(0)), (1, text(1)), (1, ""), (1, ""), (2, text(2)), (3, text(2) + " tail"), (3, text(3)),
        (None, text(4)), (None, text(5)), (None, text(2) + " more"), (None, text(6)), (None, text(6) + " tail"), (None, ""), (None, None),
    ]
    out = near_dedup.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = Counter((r["doc_id"], r["text"]) for r in out)
    last = [key for key in left if key[1] in (text(6), text(6) + " tail")]
    assert len(last) == 1 and left.pop(last[0]) == 1
    assert left == Counter([(1, text(0)), (1, text(1)), (1, ""), (1, ""), (2, text(2)), (3, text(3)), (None, text(4)), (None, text(5)), (None, ""), (None, None)])


def test_components_of_paths_and_cycles(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


def test_mixture(docs, none):
    out = mixing.mixture(docs).collect()
    assert len(out) == len(TEXTS) + 1
    taken, target, size = Counter(), {}, Counter()
    for r in out:
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"] and r["source_size"] is not None
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    assert all(t <= 2 * size[s] + 1e-9 for s, t in target.items())
    again = sorted((str(r["doc_id"]), r["taken"]) for r in mixing.mixture(docs).collect())
    assert again == sorted((str(r["doc_id"]), r["taken"]) for r in out)
    assert mixing.mixture(none).count() == 0
    words = sum(len(r["text"].split()) for r in mixing.mixed_documents(docs).collect())
    assert abs(words - sum(taken.values())) <= 300  # other blanks than ASCII ones split a few words more


def test_targets_and_quotas():
    target = mixing.source_targets([("b", 10), ("a", 1000), (None, 100)])
    assert sum(target.values()) == pytest.approx(1.5 * 1110) and target["b"] == 20 and target[None] == 200
    quotas = mixing.split_quotas([1000, 3, 0, 57], 7, 1)
    assert quotas.sum(0).tolist() == [1000, 3, 0, 57] and max(quotas.sum(1)) - min(quotas.sum(1)) <= 1


def test_packing(docs, none):
    out = packing.pack_documents(docs).collect()
    tokenizer = word_tokenizer()
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    by = defaultdict(dict)
    for r in out:
        by[r["doc_id"]][r["piece"]] = r
    for i, text in enumerate(TEXTS):
        if i == 3:
            continue
        ids = tokenizer.library.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, r in by[i].items():
            part = np.array(ids[piece * 2048 : (piece + 1) * 2048], dtype="<u4")
            assert (r["start"], r["length"], r["ids_crc32"]) == (piece * 2048, len(part), zlib.crc32(part.tobytes()))
        assert len(by[i]) == -(-len(ids) // 2048)
    assert packing.pack_documents(none).count() == 0


def test_bin_slack_beats_or_meets_first_fit_and_is_feasible():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = rng.integers(1, 101, 200)
        bins = packing.minimum_bin_slack(lengths, 100)
        loads = np.bincount(bins, weights=lengths)
        assert loads.max() <= 100
        fit = []
        for x in sorted(lengths.tolist(), reverse=True):
            for i, load in enumerate(fit):
                if load + x <= 100:
                    fit[i] += x
                    break
            else:
                fit.append(x)
        assert len(loads) <= len(fit)


def test_word_tokenizer_equals_its_library():
    tokenizer = word_tokenizer()
    for text in [*TEXTS, "I'm they'LL İx ΣΑΣ", "<|endoftext|> ok", "naïve ½ ² ª", "tab\tnew\nline nbsp", "snake_case 123abc"]:
        ids = np.frombuffer(tokenizer.encode(text or ""), dtype="<u4").tolist()
        assert ids == tokenizer.library.encode(text or "", add_special_tokens=False).ids


def test_feistel_is_a_bijection():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        for key in (0, 7):
            assert sorted(token_shards.feistel(np.arange(n), n, key).tolist()) == list(range(n))
    assert token_shards.feistel(np.arange(100), 100, 1).tolist() != token_shards.feistel(np.arange(100), 100, 2).tolist()


def test_token_shards_round_trip(docs, none, tmp_path):
    index, manifest, path = token_shards.materialise(docs, f"file://{tmp_path}/shards", length=64, shard_rows=50)
    index = index.collect()
    assert sorted(r["slot"] for r in index) == list(range(len(index)))
    files = sorted(f for f in os.listdir(f"{tmp_path}/shards") if not f.startswith("."))
    assert files == [f"shard-{i:05d}.bin" for i in range(-(-len(index) // 50))]
    assert sum(r["n_rows"] for r in manifest.collect()) == len(index)
    data = b"".join(open(f"{tmp_path}/shards/{f}", "rb").read() for f in files)
    assert len(data) == len(index) * 128
    tokenizer, seen = word_tokenizer(), defaultdict(list)
    for r in index:
        ids = np.frombuffer(data[r["slot"] * 128 : (r["slot"] + 1) * 128], dtype="<u2")
        assert not ids[r["n_tokens"] :].any()
        seen[r["doc_id"]].append((r["piece"], ids[: r["n_tokens"]].tolist()))
    for i in (0, 4, 7, 10):
        ids = [x for _, part in sorted(seen[i]) for x in part]
        assert ids == tokenizer.library.encode(TEXTS[i] or "", add_special_tokens=False).ids + [0]
    assert token_shards.training_order(none).count() == 0


def test_url_filter(spark):
    import datetime as dt

    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    captures = spark.createDataFrame(
        [
            (1, "http://a.b.example.com/x/y", day(5)), (2, "http://a.b.example.com/x/y", day(15)), (3, "http://a.b.example.com/x/y", day(400)),
            (4, None, day(1)), (5, "no url", day(1)), (6, "http://example.com", None), (7, "HTTP://u@A.b.example.com:80/q/z?x#y", day(15)), (8, "http://a.b.example.com/x/y", day(10)),
        ],
        "capture_id long, url string, fetched_at timestamp",
    )
    entries = spark.createDataFrame(
        [
            ("domain", "example.com", True, "block", day(3)), ("domain", "example.com", False, "block", day(10)), ("path", "a.b.example.com/x/", True, "allow", day(300)),
            ("host", "a.b.example.com", True, "block", day(12)), ("host", None, True, "block", day(1)), ("host", "a.b.example.com", True, "block", None),
        ],
        "kind string, pattern string, listed boolean, verdict string, at timestamp",
    )
    out = {r["capture_id"]: (r["n_active"], r["kept"]) for r in url_filters.judge_captures(captures, entries).collect()}
    assert out == {1: (1, False), 2: (1, False), 3: (2, True), 4: (0, True), 5: (0, True), 6: (0, True), 7: (1, False), 8: (0, True)}
    assert url_filters.judge_captures(captures.limit(0), entries).count() == 0
    assert url_filters.judge_captures(captures, entries.limit(0)).filter("kept").count() == 8


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(400, 8))
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(vectors)]
    rows += [(500, None, "x", 1), (600, [0.0] * 8, "x", 1), (700, [float("nan")] + [1.0] * 7, "x", 1), (800, [1.0, None] * 4, "x", 1), (900, [1.0], "x", 1), (7, vectors[7].tolist(), "x", 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row string, id int")
    out = neighbours.neighbours(table).collect()
    assert {r["query_id"] for r in out} == {0, 100, 200, 300} and len(out) == 40
    hits = 0
    for q in (0, 100, 200, 300):
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
        d[q] = np.inf
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [g[0] for g in got] == list(range(1, 11)) and all(abs(d[g[1]] - g[2]) < 1e-12 for g in got)
        hits += len({g[1] for g in got} & set(np.argsort(d)[:10].tolist()))
    assert hits >= 36
    few = neighbours.neighbours(table.filter("vec_id in (100, 3, 7)")).collect()
    assert sorted(r["vec_id"] for r in few) == [3, 7, 7]
    assert neighbours.neighbours(table.limit(0)).count() == 0 and neighbours.neighbours(table.filter("vec_id = 100")).count() == 0


def test_shingles():
    assert len(shingle_set(None)) == 0 and len(shingle_set("a b")) == 1 and len(shingle_set("a b c d e f")) == 2
    assert shingle_set("A b\nc  d e").tolist() == shingle_set("a b c d E").tolist() != shingle_set("É b c d e").tolist()


def test_pipeline_keeps_its_rules(spark, tmp_path):
    good = [(i, " ".join(f"g{i}w{j}" for j in range(80)), "en", f"s{i % 3}", 0) for i in range(60)]
    copies = [(100 + i, good[i][1] + " tail", "en", "s1", 0) for i in range(10)]
    short = [(200 + i, "too short", "en", "s2", 0) for i in range(5)]
    spark.createDataFrame(good + copies + short, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in out}
    assert ids <= {d[0] for d in good} and len(ids) >= 30
    sizes = defaultdict(int)
    for r in out:
        sizes[r["sequence_id"]] += r["length"]
    assert max(sizes.values()) <= 2048
    names = [name for name, _ in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert names == ["rules", "classifier", "dedup", "mix", "pack"]


def test_pipeline_on_nulls_repeats_clashing_columns_and_no_rows(spark, tmp_path):
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(70))
    rows = [(i, text(i), "en", f"s{i % 2}", 0, 1, 2, "d") for i in range(12)]
    rows += [(None, text(50), None, None, 0, 1, 2, "d"), (None, text(51), "", "", None, 1, 2, "d"), (3, text(52), "en", "s1", 0, 1, 2, "d"), rows[4], rows[4]]
    rows += [(60, None, "en", "s1", 0, 1, 2, "d"), (61, "", "en", "s1", 0, 1, 2, "d"), (62, " ".join(f"L{j}" for j in range(30_000)), "en", "s1", 0, 1, 2, "d")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, Number int, kept int, document string"
    labels = spark.createDataFrame([(0, 1, 0), (None, 0, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    for name, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tmp_path}/some")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "Number", "kept", "document"]
        seen.append(Counter((r["doc_id"], r["text"]) for r in docs.collect()))
    good = Counter((r[0], r[1]) for r in rows if r[1])
    assert seen[0] == seen[1] == good
    assert seen[2] == Counter(good.keys())
    assert {key[0] for key in seen[3]} <= {key[0] for key in good}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
