"""Text operators against brute force, on small tables with nulls, ties, copies and long texts."""

import hashlib
import math
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from fleetfold.llm import components, decontamination, language, licenses, mixing, quality_model, quality_rules, sharding, simhash, substrings, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, host string, words string"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(20_000))
PASSAGE = "the quick brown fox jumps over the lazy dog while nine grey herons watch from the far bank of the river"
TEXTS = [
    (1, PASSAGE + " Licensed under CC BY-NC 4.0."),
    (2, PASSAGE + " Licensed under CC BY-NC 4.0."),
    (3, "before " + PASSAGE.upper() + " after it all rights reserved"),
    (4, None),
    (5, ""),
    (6, LONG),
    (7, "GNU General Public License, version 3. ALL RIGHTS RESERVED"),
    (None, PASSAGE),
    (7, "same key, another text é ß İ K"),
    (8, "a a a a a a a a\nb\nb\n###"),
    (8, "a a a a a a a a\nb\nb\n###"),
    (9, "tail " + LONG[:3000]),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 3 else "en", None if i == 6 else "s", 0, "clash", "clash") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_rules(docs, nothing):
    rows = quality_rules.quality_by_host(docs).collect()
    assert len(rows) == len(TEXTS)
    for text in {t for _, t in TEXTS}:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        twice = {w for w in windows if windows.count(w) > 1} if len(words) < 100 else None
        if twice is not None:
            covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
            assert (len(words), len(covered)) in {(r.n_words, r.n_repeat_words) for r in rows}
    assert not any(r.kept for r in rows if r.base_failed)
    assert quality_rules.quality_by_host(nothing).count() == 0
    assert quality_rules.passing(docs).columns == docs.columns


def test_quality_rules_hold_whatever_rows_are_added(spark):
    def clean(i):
        return " ".join(f"plain{(i * 60 + k) % 9973}" for k in range(60))

    junk = [(i, clean(i) + " # # # # # # # # #", "a") for i in range(3)] + [(i, (clean(i) + "\n") + "same line\n" * 9, "b") for i in range(3, 6)]
    fine = [(100 + i, clean(i), f"{'abcdefgh'[i % 8]}") for i in range(240)]
    for rows in (junk, junk + fine, junk + fine + fine, junk + [(i, t, "a") for i, t, _ in fine]):
        found = quality_rules.quality_by_host(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
        assert not any(r.kept for r in found if r.doc_id < 100) and not any(r.base_failed for r in found)
        assert all(r.kept for r in found if r.doc_id >= 100)
    barred = [(i, clean(i) + " #" * 9, "bad") for i in range(8)] + [(50, clean(50), "bad")]
    found = spark.createDataFrame(barred + fine, "doc_id bigint, text string, source string")
    assert {r.doc_id for r in quality_rules.passing(found).collect()} == {i for i, _, _ in fine}


def test_licenses(docs, nothing):
    rows = {(r.doc_id, r.n_words): r for r in licenses.license_report(docs).collect()}
    first = next(r for r in rows.values() if r.doc_id == 1)
    assert (first.base_labels, first.labels, first.n_base) == ("cc-by", "cc-by,cc-by-nc", 1)
    both = next(r for r in rows.values() if r.doc_id == 7 and r.n_base)
    assert (both.base_labels, both.first_word, both.last_word) == ("gpl,reserved", 1, 6)
    assert next(r for r in rows.values() if r.doc_id == 4).n_words == 0
    assert licenses.license_report(nothing).count() == 0


def test_sharding(docs, nothing, spark):
    rows = sharding.shard_by_bytes(docs, shards=4, fences=3).collect()
    assert len(rows) == len(TEXTS)
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert len({r.shard for r in rows if r.doc_id in (1, 2)}) == 1
    assert sharding.shard_by_bytes(nothing).count() == 0
    sizes = [int(x) for x in np.random.default_rng(1).integers(1, 100, 300)]
    ends = np.cumsum(sizes)
    groups = spark.createDataFrame([(int(e), s) for e, s in zip(ends, sizes)], "upto bigint, bytes bigint")
    found, cuts = sharding.minimax_capacity(groups, int(ends[-1]), max(sizes), 7, fences=20)

    def fits(capacity):
        shards, held = 1, 0
        for size in sizes:
            shards, held = (shards, held + size) if held + size <= capacity else (shards + 1, size)
        return shards <= 7

    assert found == next(c for c in range(max(sizes), int(ends[-1])) if fits(c))
    assert max(np.diff([0, *cuts])) <= found


def test_mixing(docs, nothing):
    rows = mixing.mix_words(docs).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert abs(sum({r.source_size: r.target for r in rows}.values()) - 1.5 * sum(r.size for r in rows)) < 1e-6
    for size in {r.source_size for r in rows}:
        assert 0 <= next(r.target for r in rows if r.source_size == size) - sum(r.taken for r in rows if r.source_size == size) < 1
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_words(docs).collect()))
    assert mixing.mix_words(nothing).count() == 0
    assert mixing.mixed(docs).columns == docs.columns


def test_decontamination(docs, nothing, spark):
    words = PASSAGE.split()
    words[7] = "sleepy"
    bench = spark.createDataFrame([(11, " ".join(words)), (12, "too short"), (13, None), (14, "none of these words is anywhere in the other table at all")], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    assert found == {(1, 11), (2, 11), (3, 11), (None, 11)}
    left = decontamination.without_benchmark(docs, bench)
    assert left.columns == docs.columns and left.count() == len(TEXTS) - 4
    assert decontamination.contaminated(nothing, bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_seeds_survive_every_tolerated_substitution():
    for n in range(8, 14):
        for gone in combinations(range(n), n - math.ceil(0.8 * n - 1e-9)):
            free = [(s, at) for s in decontamination.SEEDS for at in range(n - max(s)) if not {at + k for k in s} & set(gone)]
            assert free, (n, gone)


def test_short_items_and_substitutions_in_items_below_thirteen_words(docs, spark):
    words = PASSAGE.split()
    rows = [(1, words[2:3]), (2, words[3:10]), (3, words[3:6] + words[7:10]), (4, ["zzz"]), (5, ["北京欢迎你"])]
    rows += [(10 + k, [f"other{i}" if i in gone else w for i, w in enumerate(words[:n])]) for k, (n, gone) in enumerate([(10, (2, 3)), (10, (3, 6)), (11, (4, 5)), (12, (4, 5))])]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "item_id bigint, text string")
    texts = spark.createDataFrame([(1, PASSAGE), (2, "x " + " ".join(words[3:10]) + " y"), (3, "a 北京欢迎你 b"), (4, "nothing here")], "doc_id bigint, text string")
    found = decontamination.contaminated(texts, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (1, 2), (2, 2), (3, 5), (1, 10), (1, 11), (1, 12), (1, 13)}
    assert {(r.first_word, r.words, r.agreeing) for r in found if r.item_id == 2} == {(3, 7, 7), (1, 7, 7)}
    assert {r.doc_id for r in decontamination.without_benchmark(texts, bench).collect()} == {4}


def test_simhash_groups(docs, nothing, spark):
    rows = simhash.simhash_components(docs).collect()
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert {r.fingerprint for r in rows if r.doc_id == 4} == {"0" * 16}
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns and kept.count() == len({(r.fingerprint) for r in rows}) and kept.where("doc_id = 2").count() == 0
    assert simhash.simhash_components(nothing).count() == 0


def test_fingerprint_links_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centers = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for c in centers]))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    labels = np.arange(len(prints))
    for _ in range(30):
        labels = np.array([labels[row].min() for row in near])
    groups = {}
    for p, label in zip(prints.view(np.int64), labels):
        groups.setdefault(label, set()).add(int(p))
    want = {frozenset(g) for g in groups.values() if len(g) > 1}
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp bigint")
    for limit, run in ((2048, 1024), (16, 8)):
        monkeypatch.setattr(simhash, "NODE_LIMIT", limit)
        monkeypatch.setattr(simhash, "RUN", run)
        found = {}
        for r in components.components(simhash.linked_fingerprints(df)).collect():
            found.setdefault(r.root, set()).add(r.node)
        assert {frozenset(g) for g in found.values()} == want


def test_fingerprint_definition():
    text = b"One two THREE four five"
    digests = [xxhash.xxh64_intdigest(s, 42) for s in (b"one two three four", b"two three four five")]
    assert simhash.fingerprint(text) == digests[0] & digests[1]


def brute_cut(rows):
    out = {}
    for n, (key, text) in enumerate(rows):
        body = (text or "").encode()
        rank = key if key is not None else 1 << 62
        earlier = [(t or "").encode() for k, t in rows if k is not None and k < rank]
        gone = bytearray(len(body))
        for i in range(len(body) - 49):
            if any(body[i : i + 50] in e for e in earlier):
                gone[i : i + 50] = b"\1" * 50
        left = bytes(b for b, g in zip(body, gone) if not g)
        out[n] = (key, len(body), sum(gone), hashlib.sha256(left).hexdigest())
    return sorted(map(str, out.values()))


@pytest.mark.parametrize("limit", [1 << 16, 1])
def test_substrings(docs, nothing, monkeypatch, limit):
    monkeypatch.setattr(substrings, "GROUP_LIMIT", limit)
    rows = substrings.remove_repeats(docs).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256)) for r in rows) == brute_cut(TEXTS)
    assert substrings.remove_repeats(nothing).count() == 0


def test_anchors_of_many_places_are_wide(spark):
    texts = [(1, "first " + "-" * 40_000), (2, "second " + "-" * 40_000)]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([t.encode() for _, t in texts])], ["text_id", "text"])
    emitted = pa.Table.from_batches(substrings._emit_anchors([batch])).sort_by("anchor")
    for size in (1, 1000):
        rows = pa.Table.from_batches(substrings._repeated(emitted.to_batches(max_chunksize=size))).to_pylist()
        dashes = int(substrings.anchor_digests(b"-" * 20).view(np.int64)[0])
        assert [(r["text_id"], r["wide"]) for r in rows if r["anchor"] == dashes] == [(1, True), (2, True)]
        assert not any(r["wide"] for r in rows if r["anchor"] != dashes)
    found = substrings.remove_repeats(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256)) for r in found) == brute_cut(texts)


def test_strings_of_wide_groups_are_given_once():
    text = b"x" + b"-" * 300 + bytes(range(97, 123)) * 2 + b"-" * 200
    at, digest = substrings.anchors(text)
    known = [{"anchor": int(d), "wide": True} for d in np.unique(digest.view(np.int64))]
    kind = pa.list_(pa.struct([("anchor", pa.int64()), ("wide", pa.bool_())]))
    columns = [pa.array([5, 6]), pa.array([1, 2]), pa.array([text, text]), pa.array([known, known], kind)]
    contexts = list(substrings._contexts([pa.RecordBatch.from_arrays(columns, ["text_id", "rank", "text", "places"])]))
    found = [(r["text_id"], r["start"], r["digest"]) for b in substrings._digests(contexts) for r in b.to_pylist()]
    starts = {a - 30 + k for a in at.tolist() for k in range(31) if 0 <= a - 30 + k <= len(text) - 50}
    assert sorted(found) == sorted((i, s, hashlib.md5(text[s : s + 50]).digest()) for i in (5, 6) for s in starts)


def test_column_wise_order():
    rng = np.random.default_rng(3)
    strings = rng.integers(97, 99, (200, 12)).astype(np.uint8)
    ranks = rng.integers(0, 50, 200)
    valid = rng.random((200, 5)) < 0.8
    found = substrings.column_wise(strings, ranks, valid, length=8)
    for i in range(200):
        for a in range(5):
            same = [ranks[j] for j in range(200) if valid[j, a] and (strings[j, a : a + 8] == strings[i, a : a + 8]).all()]
            elsewhere = [ranks[j] for j in range(200) if valid[j, a] and (strings[j, a : a + 8] == strings[i, a : a + 8]).all()]
            assert found[i, a] == (bool(valid[i, a]) and min(same + elsewhere) < ranks[i])


def test_passes_match_enumeration():
    emissions, moves = np.array([0.5, -1.0, 2.0, 0.1]), np.array([[0.3, -0.2], [0.4, 0.7]])
    weights = {}
    for path in np.ndindex(*(2,) * 4):
        score = sum(e for e, y in zip(emissions, path) if y) + sum(moves[a, b] for a, b in zip(path, path[1:]))
        weights[path] = np.exp(score)
    want = [sum(w for p, w in weights.items() if p[t]) / sum(weights.values()) for t in range(4)]
    assert np.allclose(toxicity.passes([emissions, emissions[:1]], moves)[0], want)


def test_texts_without_listed_words_are_scored_as_in_the_fit():
    field = toxicity.Field({"bad": 3.0}, np.array([-3.0, 1.0, 0.0, 0.0]), np.array([[0.1, -0.2], [0.0, 0.5]]), np.array([-4.0, 1.5, 0.5]))
    texts = ["fine " * 400, "", "good " * 400, "fine " * 30, "so bad it is"]
    score, spans = toxicity.score_texts(texts, field)
    for text, found in zip(texts, score):
        evidence = np.array([3.0 if w == "bad" else 0.0 for w in text.split()])
        marginal = toxicity.passes([toxicity._features(evidence) @ field.weights], field.moves)[0]
        assert np.isclose(found, 1 / (1 + np.exp(-np.dot(toxicity._summary(evidence, marginal), field.curve))))
    assert score[0] == score[2] > score[3] > score[1] and [len(s) for s in spans[:4]] == [0, 0, 0, 0]


@pytest.fixture(scope="module")
def labelled(spark):
    folder = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_models_on_held_out_rows(labelled):
    docs, labels = labelled
    toxic = toxicity.toxic_documents(docs, toxicity.fit_field(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert (toxic.predicted == toxic.toxic).mean() > 0.94 and (toxic.predicted[toxic.toxic == 1]).mean() > 0.7
    good = quality_model.quality_scores(docs, quality_model.fit_quality(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert (good.predicted == good.quality).mean() > 0.97
    known = language.predict_languages(docs, language.fit_filters(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (known.lang_pred == known.lang).mean() > 0.99


def test_models_without_rows(docs, nothing, spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in toxicity.toxic_documents(docs, toxicity.fit_field(docs, labels)).collect()} == {0.0}
    assert {r.score for r in quality_model.quality_scores(docs, quality_model.fit_quality(docs, labels)).collect()} == {0.5}
    found = language.predict_languages(docs, language.fit_filters(docs)).collect()
    assert len(found) == len(TEXTS) and {r.lang_pred for r in found if r.doc_id in (4, 5)} == {"und"}
    assert {r.lang_pred for r in language.predict_languages(docs, language.fit_filters(nothing)).collect()} == {"und"}


def test_grams_count_once_per_text():
    texts = ["banana banana", "", "b a n", "12 34", "banana"]
    digests, owners = language.grams(texts)
    once, owner = language._once_per_text(digests, owners)
    assert sorted(zip(owner.tolist(), once.tolist())) == sorted(set(zip(owners.tolist(), digests.tolist())))
    assert len(language._once_per_text(*language.grams(["12"]))[0]) == 0
