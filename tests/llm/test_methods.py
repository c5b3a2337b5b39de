"""The methods themselves: the field's gradient, host limits, spaced seeds against brute force."""

import math
import random
import re
from itertools import product

import numpy as np
import pytest

from fleetfold.llm import decontamination, mixing, quality_model, quality_rules, simhash, toxicity


# --- toxicity field -----------------------------------------------------------------------------


def log_likelihood(features, labels, weights, moves):
    """By listing every labelling of every text."""
    total = 0.0
    for x, y in zip(features, labels):
        scores = x @ weights
        rate = lambda s: sum(scores[t] * s[t] for t in range(len(s))) + sum(moves[a, b] for a, b in zip(s, s[1:]))  # noqa: B023, E731
        every = [rate(s) for s in product((0, 1), repeat=len(y))]
        total += rate([int(v) for v in y]) - math.log(sum(map(math.exp, every)))
    return total


@pytest.mark.parametrize("seed", range(4))
def test_gradient_equals_finite_differences(seed):
    rng = np.random.default_rng(seed)
    lengths = [1, 5, 7, 2, 7]
    features = [rng.normal(size=(n, 4)) for n in lengths]
    labels = [rng.integers(0, 2, n).astype(float) for n in lengths]
    weights, moves = rng.normal(size=4), rng.normal(size=(2, 2))
    up, up_moves = toxicity.likelihood_gradient(features, labels, weights, moves)
    step = 1e-6
    for i in range(4):
        off = np.eye(4)[i] * step
        slope = (log_likelihood(features, labels, weights + off, moves) - log_likelihood(features, labels, weights - off, moves)) / (2 * step)
        assert math.isclose(up[i], slope, rel_tol=1e-5, abs_tol=1e-5)
    for i, j in product((0, 1), repeat=2):
        off = np.zeros((2, 2))
        off[i, j] = step
        slope = (log_likelihood(features, labels, weights, moves + off) - log_likelihood(features, labels, weights, moves - off)) / (2 * step)
        assert math.isclose(up_moves[i, j], slope, rel_tol=1e-5, abs_tol=1e-5)


# --- quality rules ------------------------------------------------------------------------------

WORDS = "doc_id bigint, text string, source string"


def symbol_text(i, symbols, words=100):
    body = " ".join(f"plain{(i * words + k) % 9973}" for k in range(words - 1))
    return f"{body} x{'#' * symbols}"


def test_hosts_that_differ_by_a_few_percent_decide(spark):
    rng, rows, key = random.Random(1), [], 0
    for host, share in (("a", 0.02), ("b", 0.02), ("c", 0.02), ("d", 0.06)):
        for _ in range(800):
            key += 1
            rows.append((key, symbol_text(key, 11 + rng.randrange(9) if rng.random() < share else rng.randrange(4)), host))
    near = [(10_000 + i, symbol_text(50_000 + i, 10), host) for i, host in enumerate("abcd")]
    df = spark.createDataFrame(rows + near, WORDS)
    found = {r.doc_id: r for r in quality_rules.quality_by_host(df).collect()}
    # ten symbols in a hundred words are just within the rule, but not at the host with more failures
    assert [found[10_000 + i].kept for i in range(4)] == [True, True, True, False]
    assert all(found[k].kept == (t.count("#") <= 10) for k, t, _ in rows)


def test_host_verdicts_only_take_away(spark):
    rows = [(i, symbol_text(i, (i * 7) % 16), "abcde"[i % 5] if i % 3 else "a") for i in range(600)] + [(601, None, None), (602, "", "a")]
    for extra in ([], [(1000 + i, symbol_text(1000 + i, 0), "a") for i in range(400)]):
        df = spark.createDataFrame(rows + extra, WORDS)
        for r in quality_rules.judged(quality_rules.measured(df), quality_rules.host_verdicts(quality_rules.measured(df))).collect():
            assert not (r.kept and (r.base_failed or r.fails_symbols or r.fails_lines or r.fails_length))
            assert 0.5 <= r.limit_symbols <= 1


def test_shrinkage_equals_the_definition(spark):
    rng = random.Random(3)
    counts = {h: (rng.randrange(50, 400), rng.random() * 0.3) for h in "abcdefgh"}
    rows, key = [], 0
    for h, (n, share) in counts.items():
        for _ in range(n):
            key += 1
            rows.append((key, symbol_text(key, 20 if rng.random() < share else 0), h))
    measured = quality_rules.measured(spark.createDataFrame(rows, WORDS))
    got = {r.verdict_host: r.rate_symbols for r in quality_rules.host_verdicts(measured).collect()}
    fails = {h: sum("#" in t for _, t, host in rows if host == h) for h in counts}
    total = len(rows)
    mean = sum(fails.values()) / total
    spread = sum(fails[h] ** 2 / counts[h][0] for h in counts) / total - mean**2
    between = spread - mean * (1 - mean) * len(counts) / total
    strength = (mean * (1 - mean) - between) / between
    for h, (n, _) in counts.items():
        assert math.isclose(got[h], (fails[h] + mean * strength) / (n + strength), rel_tol=1e-9)


def test_counts_match_brute_force(spark):
    rng = random.Random(4)
    texts = ["", None, " ", "\n\n", "a b c a b c", "é# é# é# é#\n\x0b\n"]
    for _ in range(150):
        lines = [" ".join(rng.choices(["a", "bb", "#c", "d$%", "é", ""], k=rng.randrange(8))) for _ in range(rng.randrange(1, 9))]
        texts.append("\n".join(rng.choices(lines, k=len(lines) + 2)))
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], WORDS)
    for r in quality_rules.quality_by_host(df).collect():
        text = texts[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))


# --- benchmark overlaps -------------------------------------------------------------------------


def brute_overlaps(text, items):
    """Items of which a window of up to 13 words agrees in 4 of 5 words somewhere, short ones in all."""
    words, found = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()) if w], set()
    for key, item in items.items():
        goal = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", item.lower()) if w]
        n = min(len(goal), 13)
        least = len(goal) if len(goal) < 8 else math.ceil(0.8 * n - 1e-9)
        for shift in range(-len(goal), len(words) + 1):
            agree = [0 <= shift + i < len(words) and words[shift + i] == w for i, w in enumerate(goal)]
            if n and max(sum(agree[s : s + n]) for s in range(len(goal) - n + 1)) >= least:
                found.add(key)
                break
    return found


def test_overlaps_match_brute_force_under_random_substitutions(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    items = {i: " ".join(rng.choices(vocabulary, k=rng.randrange(3, 40))) for i in range(25)}
    texts = {}
    for i in range(120):
        words = rng.choices(vocabulary, k=rng.randrange(60))
        goal = items[rng.randrange(25)].split()
        first = rng.randrange(max(1, len(goal) - 12))
        part = [w if rng.random() < 0.85 else rng.choice(vocabulary) for w in goal[first : first + rng.randrange(8, 20)]]
        at = rng.randrange(len(words) + 1)
        texts[i] = " ".join(words[:at] + part + words[at:])
    docs = spark.createDataFrame([(i, t, "clash", {"a": 1}) for i, t in texts.items()], "doc_id bigint, text string, text_k1 string, k1 map<string,int>")
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    want = {(i, key) for i, t in texts.items() for key in brute_overlaps(t, items)}
    assert got == want
    left = decontamination.without_benchmark(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(texts) - {i for i, _ in want}
    few = decontamination.without_benchmark(docs, bench, least_item_words=41)
    assert few.count() == len(texts)


# --- quality classifier -------------------------------------------------------------------------


def test_prior_and_risk_need_no_negatives():
    rng = np.random.default_rng(8)
    good, bad = rng.normal(1.5, 1, (4000, 3)), rng.normal(-1.5, 1, (1000, 3))
    trusted, web = rng.normal(1.5, 1, (1500, 3)), np.r_[good, bad]

    def sums_at(weights):
        return quality_model.risk_sums(trusted, weights), quality_model.risk_sums(web, weights)

    apart = quality_model.descend(sums_at, None, 4)
    counts = [np.bincount((quality_model._sigmoid(x @ apart[:-1] + apart[-1]) * 999).astype(int), minlength=1000).astype(float) for x in (trusted, web)]
    prior = quality_model.least_bound(*counts)
    assert abs(prior - 0.8) < 0.05
    weights = quality_model.descend(sums_at, prior, 4)
    scores = quality_model._sigmoid(web @ weights[:-1] + weights[-1])
    assert ((scores >= 0.5) == (np.arange(5000) < 4000)).mean() > 0.98
    # a prior that is too high: the estimated loss of the negatives stays at zero or more
    bold = quality_model.descend(sums_at, 0.95, 4)
    (loss_p, *_), (loss_u, *_) = map(quality_model._parts, sums_at(bold))
    assert loss_u - 0.95 * loss_p > -1e-3


def test_risk_gradient_equals_finite_differences():
    rng = np.random.default_rng(9)
    trusted, web, prior, weights = rng.normal(size=(50, 2)), rng.normal(size=(80, 2)), 0.6, rng.normal(size=3)

    def risk(w):
        p, u = (np.c_[x, np.ones(len(x))] @ w for x in (trusted, web))
        return prior * np.logaddexp(0, -p).mean() + np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()

    (_, _, row, _), (_, gradient, _, curve) = (quality_model._parts(quality_model.risk_sums(x, weights)) for x in (trusted, web))
    for i in range(3):
        off = np.eye(3)[i] * 1e-5
        assert math.isclose((gradient - prior * row)[i], (risk(weights + off) - risk(weights - off)) / 2e-5, rel_tol=1e-5, abs_tol=1e-7)
    again = quality_model._parts(quality_model.risk_sums(web, weights + np.array([1e-5, 0, 0])))[1]
    assert np.allclose((again - gradient) / 1e-5, curve[0], atol=1e-3)


# --- columns of any name ------------------------------------------------------------------------


def test_stages_keep_columns_of_any_name_and_type(spark):
    schema = """doc_id bigint, text string, lang string, source string, n_chars bigint, row_x1 string, copies int, k1 string,
        flagged_k1 string, whole_row string, fp string, m map<string, int>, deep array<map<string, int>>"""
    rows = [(i, f"text number {i} of some words " * 3, "en", "s", 1, "c", 7, "k", "f", "w", "p", {"b": 2, "a": i}, [{"x": 1}]) for i in range(4)]
    rows += [rows[0], (9, None, None, None, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    bench = spark.createDataFrame([(1, "text number 2 of some words text number 2 of some words")], "item_id bigint, text string")
    for stage, keys in (
        (simhash.one_per_group(docs), None),
        (mixing.mixed(docs), None),
        (decontamination.without_benchmark(docs, bench), [9]),
        (quality_rules.passing(docs), []),
    ):
        assert stage.columns == docs.columns and stage.schema == docs.schema
        found = stage.collect()
        assert all(r.m is None or r.m["b"] == 2 for r in found)
        if keys is not None:
            assert sorted(r.doc_id for r in found) == keys
