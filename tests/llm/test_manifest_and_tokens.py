"""Manifest, alignment and byte-level encoding against plain forms, on nulls, long texts, ties, repeats and empty tables."""

import base64
import hashlib
import random
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from changelens.llm import alignment, byte_bpe, license_scan, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, digest string, rank int, ids string, pairs string, `n``a` int, row int"
LONG = " ".join(f"word{i % 977} and{i}" for i in range(30_000))
TEXTS = [
    None, "", "   \n\t", "One two", "one two", "It's 12345 o'clock\r\n\r\n  now", LONG, "Ünï cödé ﬀ 中文 don't K", "a\x00b \x85 x", "▁a b▁", "<s> </s> <|endoftext|> <unk>",
    "a" * 5000, " " * 3000 + "x", "é" * 3000, "<0x41>", "🙂🙂 x", "K", "tail ",
]


def rows(n=len(TEXTS)):
    lang = lambda i: [None, "", "de", "en", "en", "en", "fr"][i % 7]
    return [(i if i != 3 else None, TEXTS[i % len(TEXTS)], lang(i), None if i % 5 == 0 else f"s{i % 3}", i if i % 4 else None, "g", "d", 1, "i", "p", 1, 2) for i in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows() + rows()[5:8], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def plain_manifest(data):
    """{(doc_id, leaf): [(subroot, root, proof, folded root), ...]} by whole lists."""
    sealed = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, text, lang, source, n, *_: sha("".join(map(sealed, (i, source, lang, n, text))))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def climb(level):
        """(root, the siblings of each place, level by level, with the place inside the run)."""
        ways, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for way, i in zip(ways, at, strict=True):
                run = level[i // 8 * 8 : i // 8 * 8 + 8]
                way.append((i % 8, run[: i % 8] + run[i % 8 + 1 :]))
            at = [i // 8 for i in at]
            level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        return level[0], ways

    langs = defaultdict(list)
    for row in data:
        langs[row[2]].append((row[0] is not None, row[0] or 0, leaf(*row), row))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: climb([x[2] for x in sorted(langs[k], key=lambda x: x[:3])]) for k in order}
    root, tops = climb([trees[k][0] for k in order])
    out = defaultdict(list)
    for k, top in zip(order, tops, strict=True):
        for (_, _, own, row), way in zip(sorted(langs[k], key=lambda x: x[:3]), trees[k][1], strict=True):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            fold = leaf(row[0], row[1] and row[1].translate(low), *row[2:]) if hit else own
            for digit, others in way + top:
                fold = sha("".join(others[:digit]) + fold + "".join(others[digit:]))
            out[row[0], own].append((trees[k][0], root, sha("".join("".join(o) for _, o in way + top)), fold))
    return out


def test_manifest_equals_plain_trees(spark):
    data = rows(700) + rows(40)[5:12] + [(7, "x", "lone", None, 1, "g", "d", 1, "i", "p", 1, 2)]
    got = defaultdict(list)
    for r in merkle.manifest_digests(spark.createDataFrame(data, SCHEMA).repartition(5)).collect():
        assert r["verified"] == (r["folded_root"] == r["root"])
        got[r["doc_id"], r["leaf"]].append((r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]))
    want = plain_manifest(data)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_manifest_of_one_row_many_groups_and_none(spark, none):
    assert merkle.manifest_digests(none).count() == 0
    one = [(4, "Text", "en", None, 1, "g", "d", 1, "i", "p", 1, 2)]
    r = merkle.manifest_digests(spark.createDataFrame(one, SCHEMA)).first()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == sha("")
    many = [(i, "t", f"l{i:03}", None, 1, "g", "d", 1, "i", "p", 1, 2) for i in range(70)]
    got = {(r["doc_id"], r["leaf"]): [(r["subroot"], r["root"], r["proof_sha256"], r["folded_root"])] for r in merkle.manifest_digests(spark.createDataFrame(many, SCHEMA)).collect()}
    assert got == dict(plain_manifest(many))


def test_proofs_of_the_leaves_asked_for(spark):
    docs = spark.createDataFrame(rows(300), SCHEMA)
    every = {(r["grp"], r["doc_id"]): r["proof"] for r in merkle.inclusion_proofs(docs).collect()}
    wanted = spark.createDataFrame([("=en", 0), ("=en", 77), ("", 3)], "grp string, rank long")
    some = {(r["grp"], r["doc_id"]): r["proof"] for r in merkle.inclusion_proofs(docs, wanted=wanted).collect()}
    assert len(some) == 3 and all(every[k] == v for k, v in some.items())


def plain_links(text, a, b, bytes_a, bytes_b):
    """(a ids, b ids, links, groups) by comparing all starts and ends; None without tokens."""
    if not text:
        return None
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    p, q = [bytes_a[i] for i in x], [bytes_b[i] for i in y]
    if not b"".join(p) == (" " + text).encode() == b"".join(q):
        return None
    end_a, end_b = np.cumsum([len(t) for t in p]).tolist(), np.cumsum([len(t) for t in q]).tolist()
    links = []
    for i, stop in enumerate(end_a):
        j = bisect_right(end_b, stop - len(p[i]))
        while j < len(q) and end_b[j] - len(q[j]) < stop:
            links.append((x[i], y[j]))
            j += 1
    groups, i, j = [], 0, 0
    for cut in sorted(set(end_a) & set(end_b)):
        k, m = bisect_right(end_a, cut), bisect_right(end_b, cut)
        groups.append((x[i:k], y[j:m]))
        i, j = k, m
    return x, y, links, groups


@pytest.mark.parametrize("frequent", [1 << 18, 40])
def test_alignment_equals_plain_links(spark, docs, frequent):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    bytes_a = alignment.ByteLevel(public_tokenizers.path("byte_bpe_50k.json")).entries
    bytes_b = {i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())}
    data = rows() + rows()[5:8]
    plain = {t: plain_links(t, a, b, bytes_a, bytes_b) for t in TEXTS}
    assert plain["▁a b▁"] is None and plain["<s> </s> <|endoftext|> <unk>"]
    holds = Counter(pair for row in data if plain[row[1]] for pair in set(plain[row[1]][2]))
    best = Counter()
    for (x, _), n in holds.items():
        best[x] = max(best[x], n)
    want = []
    for row in data:
        if not plain[row[1]]:
            want.append((row[0], 0, 0, 0, 0, 0, 0, ""))
            continue
        x, y, links, groups = plain[row[1]]
        text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        want.append((row[0], len(x), len(y), len(groups), len(links), sum(holds[k] == best[k[0]] for k in links), sum(holds[k] for k in links), sha(text)))
    got = alignment.alignment_digests(docs, frequent=frequent).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(want)
    lists = {r["doc_id"]: r["groups"] for r in alignment.align(docs).select("doc_id", "groups").collect()}
    for row in rows():
        if plain[row[1]] and row[0] is not None:
            assert [(g["a"], g["b"]) for g in lists[row[0]]] == plain[row[1]][3]


def test_alignment_of_nothing(none):
    assert alignment.alignment_digests(none).count() == 0


def test_lanes_leave_no_link_out():
    rng = np.random.default_rng(3)
    for lane in (1, 3, 7, 100, 10_000):
        sizes = rng.integers(1, 400, size=9)
        ends = [np.unique(np.concatenate([np.cumsum(sizes), rng.choice(np.arange(1, sizes.sum()), size=300)])) for _ in range(2)]
        met = alignment.lockstep(*ends, *alignment.lanes(sizes, lane))
        starts = [np.append(0, e[:-1]) for e in ends]
        want = {(i, j) for i in range(len(ends[0])) for j in range(len(ends[1])) if max(starts[0][i], starts[1][j]) < min(ends[0][i], ends[1][j])}
        assert Counter(zip(met.a.tolist(), met.b.tolist(), strict=True)) == Counter(want)
        assert sorted(ends[0][met.cut_a].tolist()) == sorted(set(ends[0].tolist()) & set(ends[1].tolist()))


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_encoding_equals_its_library(spark, docs, none, library):
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.round_trip_digests(docs).collect()]
    want = []
    for row in rows() + rows()[5:8]:
        ids = library.encode_ordinary(row[1] or "")
        want.append((row[0], len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(row[1] or "")))
    assert Counter(got) == Counter(want)
    assert byte_bpe.round_trip_digests(none).count() == 0
    assert dict(byte_bpe.round_trip_digests(docs).dtypes)["n_tokens"] == "bigint"


def test_random_texts_are_encoded_as_the_library_does(library):
    import regex

    rng = random.Random(5)
    vocabulary = byte_bpe.ByteVocabulary.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    pattern, letters = regex.compile(public_tokenizers.PATTERN), "abehlnorst ABE'st019 .,!\n\t\x1c\x85  äßéλж中文한ﬀ²½Ⅷ٣🙂́‍"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(2000)] + ["ab" * 20_000, "x" * 70_001, " " * 50_000 + "x"]
    for text, ids in zip(texts, byte_bpe.encode_batch(texts, vocabulary, pattern, {}), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode_ordinary(text)


def test_texts_beyond_a_chunk_and_a_full_memory(library, monkeypatch):
    import regex

    monkeypatch.setattr(byte_bpe, "CHUNK", 64)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 10)
    vocabulary = byte_bpe.ByteVocabulary.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = ["", LONG[:3000], "short", LONG[-500:], ""]
    for text, ids in zip(texts, byte_bpe.encode_batch(texts, vocabulary, regex.compile(public_tokenizers.PATTERN), {}), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode_ordinary(text)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 3000])
def test_perfect_hash_is_minimal(n):
    keys = [f"key{i}".encode() for i in range(n)]
    assert sorted(byte_bpe.PerfectHash(keys).slots(keys).tolist()) == list(range(n))


def test_rank_based_ids_equal_the_byte_level_library():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    own, rng = alignment.ByteLevel(public_tokenizers.path("byte_bpe_50k.json")), random.Random(6)
    letters = "abehlnorst ABE'st019 .,!\n\t\x1c\x85  äßéλж中文한ﬀ²½Ⅷ٣🙂́‍"
    texts = [t for t in TEXTS if t] + ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(1000)]
    for text in texts:
        assert own.encode(text).tolist() == library.encode(" " + text, add_special_tokens=False).ids


def test_licenses_of_capital_letters(spark):
    texts = ["THIS WORK IS LICENSED UNDER THE GNU LESSER PUBLIC LICENSE, VERSION 3", "KNOWN KEY KIT", "Known Key Kit", "known key kit", "LİCENSE KELVIN"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = lambda **o: [r["labels"] for r in license_scan.license_labels(docs, **o).orderBy("doc_id").collect()]
    assert labels()[0] == "gpl-3.0"
    assert labels(templates={"kit": "known key kit"}) == ["", "kit", "", "kit", ""]
    assert labels(templates={}) == [""] * 5
    words = F.array_remove(F.split(license_scan.lowered(F.col("text")), license_scan.SEPARATORS), "")
    assert docs.filter("doc_id = 4").select(words).first()[0][1] == "kelvin"
