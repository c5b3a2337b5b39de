"""Centroid clustering, SentencePiece coding and periodic runs against brute force and the library."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from fleetfold.llm import centroids, periodic, pieces, queries

sentencepiece = pytest.importorskip("sentencepiece")

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, words string, runs string, ids string, collapsed string"


def rows_of(texts):
    return [(i, t, None, None if k % 2 else "s", None, "clash", "clash", "clash", None) for k, (i, t) in enumerate(texts)]


# --- centroids ----------------------------------------------------------------------------------


def brute_clusters(rows, rounds=3, k=16):
    """The contract of op11, with Python integers."""
    kept = [(key, [math.floor(64 * float(x)) for x in v]) for key, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda key: "g" if key is None else hashlib.sha256(f"1:{key}".encode()).hexdigest()
    means = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def choose(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), i) for i, m in enumerate(means))

    for _ in range(rounds):
        chosen = [choose(v)[1] for _, v in kept]
        for i in range(len(means)):
            mine = [v for (_, v), c in zip(kept, chosen) if c == i]
            if mine:
                means[i] = [sum(x) // len(mine) for x in zip(*mine)]
    result = [(key, *choose(v)) for key, v in kept]
    inertia = {i: sum(d for _, d, c in result if c == i) for i in range(len(means))}
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return [(key, c, d, inertia[c], sum(inertia.values()), sha[c]) for key, d, c in result]


def test_transform_keeps_distances_and_orders_by_sign_changes():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-1000, 1000, (2, 50, 64))
    moved = centroids.transform(a) - centroids.transform(b)
    assert (np.square(moved).sum(axis=1) == 64 * np.square(a - b).sum(axis=1)).all()
    basis = centroids.transform(np.eye(64, dtype=np.int64))
    changes = (np.diff(np.sign(basis), axis=0) != 0).sum(axis=0)
    assert changes.tolist() == list(range(64))


def test_nearest_takes_the_smaller_number_of_equal_distances():
    rng = np.random.default_rng(2)
    for spread in (1, 3, 1 << 23):
        vectors, aims = rng.integers(-spread, spread + 1, (300, 64)), rng.integers(-spread, spread + 1, (16, 64))
        aims[7] = aims[3]
        distance = np.square(vectors[:, None] - aims[None]).sum(axis=2)
        number, least = centroids.nearest(vectors, aims)
        assert (number == distance.argmin(axis=1)).all() and (least == distance.min(axis=1)).all()


@pytest.mark.parametrize("n", [0, 1, 9, 400])
def test_clusters_match_brute_force(spark, n, tmp_path):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 64).round(1)]) for i in range(n)]
    if n > 1:
        bad = [None, [], [0.1] * 63, [0.1] * 65, [None] + [0.1] * 63, [float("nan")] * 64, [float("inf")] + [0.0] * 63]
        rows += [(1000 + i, v) for i, v in enumerate(bad)] + [rows[0], (rows[0][0], rows[1][1]), (None, rows[2][1]), (None, None)]
    schema = "vec_id bigint, embedding array<float>, label int, cluster int, components string"
    rows = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, v in rows]
    spark.createDataFrame([(k, v, None, 5, "clash") for k, v in rows], schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_centroid_clustering(spark, str(tmp_path))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    key = lambda r: (r[0] is None, *(str(x) for x in r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_clusters(rows), key=key)


def test_components_beyond_exact_sums_are_refused(spark):
    df = spark.createDataFrame([(1, [1e30] * 64)], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="range of exact sums"):
        centroids.walsh_clusters(df)


# --- pieces -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(queries.piece_model())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())


def test_pieces_equal_the_library(model, library):
    coder, rng = pieces.PieceCoder(model), random.Random(5)
    alphabet = "abcdefgh   \n\t▁éß日本語中 the ing ion  　\x00<>🙂0xA:)(=-_*#"
    for _ in range(4000):
        n = rng.randrange(50)
        text = "".join(rng.choices(alphabet, k=n)) if rng.random() < 0.5 else "".join(rng.choices(model.pieces[259:], k=n // 5))
        ids = library.encode(text)
        assert coder.encode(text) == ids, text
        assert coder.decode(ids) == library.decode(ids), text
    for unit in (" ", "a", "=", "\n", "aa ", "  a", "日", "▁"):
        for n in (1, 2, 3, 17, 100, 5000):
            assert coder.encode(unit * n) == library.encode(unit * n)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(259), 28705, 259]) for _ in range(rng.randrange(8))]
        assert coder.decode(ids) == library.decode(ids), ids


def test_pair_test_equals_merging(model):
    coder, rng = pieces.PieceCoder(model), random.Random(6)
    for _ in range(6000):
        left, right = rng.randrange(259, 32000), rng.randrange(259, 32000)
        a, b = model.pieces[left], model.pieces[right]
        assert coder.may_follow(left, right) == (pieces.merged(list(a + b), model.score)[0] == [a, b])


def test_tables_of_a_task_may_be_emptied(model, library, monkeypatch):
    monkeypatch.setattr(pieces, "PARTS_KEPT", 2)
    monkeypatch.setattr(pieces, "PAIRS_KEPT", 3)
    text = "The quick brown fox jumps over the lazy dog. " * 3
    assert pieces.PieceCoder(model).encode(text) == library.encode(text)


def test_piece_query(spark, library, tmp_path):
    texts = [(1, "Hello world\n"), (1, "Hello world\n"), (None, "  two  blanks "), (3, None), (4, ""), (5, "x" * 70_000 + " y" * 70_000), (6, "naïve 日本 🙂 ▁")]
    for name, some in (("full", texts), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(rows_of(some), DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
        got = queries.op12_sentencepiece(spark, str(folder)).collect()
        want = []
        for key, text in some:
            ids = library.encode(text or "")
            sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
            want.append((key, len(ids), *sha))
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_codes_keep_other_columns(spark, model):
    docs = spark.createDataFrame(rows_of([(1, "a b"), (2, None)]), DOCUMENTS)
    coded = pieces.encode_texts(docs, model)
    assert coded.columns == ["doc_id", "text", "lang", "source", "n_chars", "words", "runs", "collapsed", "ids"]
    decoded = pieces.decode_ids(coded, model).orderBy("doc_id").collect()
    assert [r.decoded for r in decoded] == ["a b", ""] and decoded[1].ids == []
    assert pieces.decode_ids(coded.withColumn("ids", pieces.F.lit(None)), model).first().decoded == ""


# --- runs ---------------------------------------------------------------------------------------


def brute_runs(words):
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            size = i + q - start
            shorter = any(all(words[j] == words[j + p] for j in range(start, start + size - p)) for p in range(1, q))
            if size >= max(24, 3 * q) and not shorter:
                found.append((start, size, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(rng):
    words = []
    for _ in range(rng.randrange(4)):
        kinds, size = rng.choice([1, 2, 2, 3, 50]), rng.randrange(1, 30)
        block = [str(rng.randrange(kinds)) for _ in range(size)]
        if rng.random() < 0.3:
            block = block * 3 + [str(rng.randrange(kinds)) for _ in range(size)]
        words += block * rng.randrange(1, 7)
        words = words[: max(0, len(words) - rng.randrange(5))]
    return words


def test_runs_match_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        docs = [random_words(rng) for _ in range(rng.randrange(1, 5))]
        ends = np.r_[0, np.cumsum([len(d) for d in docs])].astype(np.int64)
        words = np.array([int(w) for d in docs for w in d], dtype=np.int64)
        assert periodic.runs_of(words, ends) == [(i, *r) for i, d in enumerate(docs) for r in brute_runs(d)]


def test_long_repetitions_take_one_extension_each(monkeypatch):
    asked = []
    stop = periodic._stop
    monkeypatch.setattr(periodic, "_stop", lambda *a: asked.append(1) or stop(*a))
    words = np.tile(np.arange(1000), 200)
    assert periodic.runs_of(words, np.array([0, len(words)])) == [(0, 0, len(words), 1000)]
    assert len(asked) == 2
    assert periodic.runs_of(np.zeros(300_000, dtype=np.int64), np.array([0, 300_000])) == [(0, 0, 300_000, 1)]


def expected_runs(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if key is not None and n:
        h = zlib.crc32(str(key).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + size for s, size, q in runs)]
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a},{b},{c}\n" for a, b, c in runs), " ".join(kept))]
    return (key, len(runs), *shown, *sha)


def test_run_query(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    texts = [(None if i == 5 else i // 2, " ".join(random_words(rng)) + rng.choice(["", "\n", " \t "])) for i in range(240)]
    texts += [(900, None), (901, ""), (902, "\n"), (903, "a " * 500), (903, "a " * 500), (904, "one")]
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in texts) > 10
    for name, some in (("full", texts), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(rows_of(some), DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
        got = queries.op13_periodic_runs(spark, str(folder)).collect()
        assert sorted(map(tuple, got), key=str) == sorted((expected_runs(*t) for t in some), key=str)


def test_runs_keep_other_columns(spark):
    docs = spark.createDataFrame([(1, [["b"], ["c"]], "x", ["w"] * 30), (2, None, "y", None), (3, None, None, ["a", None])], "k bigint, m array<array<string>>, runs string, body array<string>")
    found = periodic.periodic_runs(docs, "body").orderBy("k")
    assert found.columns == ["k", "m", "runs", "collapsed"]
    assert [(len(r.runs), r.collapsed) for r in found.collect()] == [(1, "w"), (0, ""), (0, "a ")]
