"""Toxic spans from a linear-chain conditional random field over words.

Labels exist per document only, so words are labelled first: a word of a toxic training document counts
as toxic if it is far more frequent in toxic than in clean training documents. The field has two states;
a word's features are its own evidence and that of its neighbours. Forward and backward passes give the
probability of each word to be toxic; their sum, turned into a probability by a fitted curve, scores
the document, and the runs of words above one half are its offending spans.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfold.llm.common import held_out, stored, text_keys, training_labels, whole_text

WORD = re.compile(r"[^\W_]+")
# documented bounds of the fit: labelled documents for the word list, and for the weights
SAMPLE, FIT_SAMPLE = 12_000, 3_000
LEAST_DOCUMENTS, LEAST_EVIDENCE = 5, 2.0
CONFIDENCE = 2.0
FIT_ROUNDS, SETTLED, PENALTY = 60, 1e-2, 1e-2
# beginnings of words count as evidence too, so that inflected forms are known
PREFIXES = (4, 5, 6, 7)
# documents whose words are stepped through together
LANES = 256


class Field(NamedTuple):
    """evidence per listed word or beginning; weights of (bias, own, before, after) for the toxic state;
    moves[i][j] from state i to j; the curve: a constant, a weight for the expected number of toxic words
    and one for the strongest of them."""

    evidence: dict[str, float]
    weights: np.ndarray
    moves: np.ndarray
    curve: np.ndarray


def units(word: str) -> list[str]:
    """The word and its beginnings, marked as such."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, label in zip(batch.column(0), batch.column(1)):
            counts[label.as_py()].update({u for w in set(WORD.findall(text.as_py().lower())) for u in units(w)})
        words = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), *(pa.array([counts[k][w] for w in words], pa.int64()) for k in (1, 0))], ["word", "toxic", "clean"]
        )


def word_evidence(sample: DataFrame) -> dict[str, float]:
    """Lower bound of the log odds of the words that mark toxic documents; ``sample`` has text and label."""
    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0) + 1.0, sizes.get(0, 0) + 1.0
    counts = sample.select("text", "label").mapInArrow(_word_counts, "word string, toxic bigint, clean bigint")
    summed = counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    odds = F.log((F.col("toxic") + 0.5) / toxic) - F.log((F.col("clean") + 0.5) / clean) - CONFIDENCE * error
    least = min(LEAST_DOCUMENTS, max(1, int(toxic) - 1))
    rows = summed.where(F.col("toxic") >= least).select("word", odds.alias("odds")).where(F.col("odds") >= LEAST_EVIDENCE)
    return {r.word: r.odds for r in rows.collect()}


def passes(emissions: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """Probability of the toxic state for every word of every text, by forward and backward passes."""
    return marginals_and_moves(emissions, moves)[0]


def marginals_and_moves(emissions: list[np.ndarray], moves: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(marginals per text, expected number of moves between the states over all texts).

    ``emissions``: score of the toxic state over the clean one, per word. Texts of like length step together.
    The probability of a move is the forward message before it, the move itself, the emission behind it
    and the backward message behind it.
    """
    result: list[np.ndarray] = [np.zeros(0)] * len(emissions)
    by_length = sorted((i for i in range(len(emissions)) if len(emissions[i])), key=lambda i: -len(emissions[i]))
    ratio, expected = np.exp(moves), np.zeros((2, 2))
    for at in range(0, len(by_length), LANES):
        lanes = by_length[at : at + LANES]
        lengths = np.array([len(emissions[i]) for i in lanes])
        longest = int(lengths[0])
        odds = np.ones((longest, len(lanes)))
        for lane, i in enumerate(lanes):
            odds[: lengths[lane], lane] = np.exp(np.clip(emissions[i], -50, 50))
        active = [int((lengths > t).sum()) for t in range(longest)]
        # forward and backward messages as the toxic share of their sum
        ahead = np.zeros((longest, len(lanes)))
        p = odds[0] / (1 + odds[0])
        ahead[0] = p
        for t in range(1, longest):
            n = active[t]
            q = p[:n]
            clean = (1 - q) * ratio[0, 0] + q * ratio[1, 0]
            toxic = ((1 - q) * ratio[0, 1] + q * ratio[1, 1]) * odds[t, :n]
            p = toxic / (clean + toxic)
            ahead[t, :n] = p
        back = np.full(len(lanes), 0.5)
        for t in range(longest - 1, -1, -1):
            n = active[t]
            f, b = ahead[t, :n], back[:n]
            both = f * b
            marginal = both / (both + (1 - f) * (1 - b))
            ahead[t, :n] = marginal
            w = b * odds[t, :n]
            if t:
                q = ahead[t - 1, :n]
                joint = np.stack([(1 - q) * ratio[0, 0] * (1 - b), (1 - q) * ratio[0, 1] * w, q * ratio[1, 0] * (1 - b), q * ratio[1, 1] * w])
                expected += (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
            clean = ratio[0, 0] * (1 - b) + ratio[0, 1] * w
            toxic = ratio[1, 0] * (1 - b) + ratio[1, 1] * w
            back[:n] = toxic / (clean + toxic)
        for lane, i in enumerate(lanes):
            result[i] = ahead[: lengths[lane], lane].copy()
    return result, expected


def _features(evidence: np.ndarray) -> np.ndarray:
    """(words, 4): bias, own evidence, evidence before and after."""
    padded = np.r_[0.0, evidence, 0.0]
    return np.stack([np.ones(len(evidence)), evidence, padded[:-2], padded[2:]], axis=1)


def _pairs(labels: np.ndarray) -> np.ndarray:
    return np.array([[np.sum((labels[:-1] == i) & (labels[1:] == j)) for j in (0, 1)] for i in (0, 1)], dtype=float)


def likelihood_gradient(features: list[np.ndarray], labels: list[np.ndarray], weights: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood of the word labels: what is seen less what the field expects."""
    marginals, expected = marginals_and_moves([f @ weights for f in features], moves)
    seen = sum((_pairs(y) for y in labels), np.zeros((2, 2)))
    return sum((f.T @ (y - m) for f, y, m in zip(features, labels, marginals)), np.zeros(len(weights))), seen - expected


def fit_weights(sequences: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, moves and curve by gradient ascent on the penalised likelihood of the word labels.

    Ends when a round changes no parameter by more than ``SETTLED``, or after ``FIT_ROUNDS``.
    """
    labels = [((s >= LEAST_EVIDENCE) & bool(t)).astype(float) for s, t in zip(sequences, toxic)]
    features = [_features(s) for s in sequences]
    words = max(1, sum(map(len, sequences)))
    weights, moves = np.array([-3.0, 1.0, 0.0, 0.0]), np.zeros((2, 2))
    squares_w, squares_m = np.full(4, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(FIT_ROUNDS):
        up_w, up_m = likelihood_gradient(features, labels, weights, moves)
        gradient, gradient_m = (up_w - PENALTY * weights) / words, (up_m - PENALTY * moves) / words
        squares_w += gradient**2
        squares_m += gradient_m**2
        step, step_m = 0.5 * gradient / np.sqrt(squares_w), 0.2 * gradient_m / np.sqrt(squares_m)
        weights, moves = weights + step, np.clip(moves + step_m, -4, 4)
        if max(np.abs(step).max(), np.abs(step_m).max()) < SETTLED:
            break
    x = np.array([_summary(s, m) for s, m in zip(sequences, passes([f @ weights for f in features], moves))])
    curve = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -40, 40)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.1 * np.eye(3), x.T @ (toxic - p) - 0.1 * curve)
        curve = curve + step
        if np.abs(step).sum() < 1e-6:
            break
    return weights, moves, curve


def _summary(evidence: np.ndarray, marginal: np.ndarray) -> tuple[float, float, float]:
    """1, log of the expected number of toxic words, evidence of the strongest."""
    return 1.0, math.log1p(marginal.sum()), float((marginal * evidence).max(initial=0.0))


def _evidence(words: list[str], listed: dict[str, float], starts: set[str]) -> np.ndarray:
    found = [max(listed.get(u, 0.0) for u in units(w)) if w[:3] in starts else 0.0 for w in words]
    return np.array(found, dtype=float)


def first_letters(listed: dict[str, float]) -> set[str]:
    return {u.rstrip("*")[:3] for u in listed}


def fit_field(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fit_sample: int = FIT_SAMPLE) -> Field | None:
    """A field from about ``sample`` labelled training documents (equal texts once); None without toxic ones."""
    chosen = training_labels(labels, "toxic", sample)
    text = docs.select(F.col("doc_id"), whole_text().alias("text"))
    # the label sample is bounded by its parameter
    labelled = text.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_doc")).select("text", F.col("label").cast("int").alias("label"), *text_keys(F.col("text")))
    # of equal texts with different labels the toxic one counts
    rows = stored(labelled.groupBy("k1", "k2").agg(F.max("label").alias("label"), F.first("text").alias("text")))
    listed = word_evidence(rows)
    if not listed:
        return None
    share = min(1.0, fit_sample / max(1, rows.count()))
    few = rows.where(F.pmod("k2", F.lit(1 << 20)) < int(share * (1 << 20))).select("text", "label")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        starts = first_letters(listed)
        sequences = [_evidence(WORD.findall(t.lower()), listed, starts) for t in frame.text]
        weights, moves, curve = fit_weights(sequences, frame.label.to_numpy())
        return pd.DataFrame({"value": np.r_[weights, moves.ravel(), curve]}).reset_index(names="at")

    # one task for a sample of documented size
    fitted = few.groupBy().applyInPandas(fit, "at bigint, value double").collect()
    values = np.array([r.value for r in sorted(fitted, key=lambda r: r.at)])
    return Field(listed, values[:4], values[4:8].reshape(2, 2), values[8:])


def score_texts(texts: list[str], field: Field) -> tuple[np.ndarray, list[list[dict]]]:
    """Score and offending spans (offsets of characters) of each text; texts of one length without a listed word share one pass."""
    starts, spans = first_letters(field.evidence), [[] for _ in texts]
    summary = np.tile([1.0, 0.0, 0.0], (len(texts), 1))
    owners, emissions, found, plain = [], [], [], {}
    for i, text in enumerate(texts):
        evidence = _evidence(WORD.findall(text.lower()), field.evidence, starts)
        if not evidence.any():
            # the same score at every word, so the length decides
            first = len(evidence) not in plain
            plain.setdefault(len(evidence), []).append(i)
            if not first:
                continue
        owners.append([i] if evidence.any() else plain[len(evidence)])
        emissions.append(_features(evidence) @ field.weights)
        found.append(evidence)
    marginals = passes(emissions, field.moves)
    for alike, evidence, marginal in zip(owners, found, marginals):
        summary[alike] = _summary(evidence, marginal)
    for i, marginal in ((i, m) for alike, m in zip(owners, marginals) if (m >= 0.5).any() for i in alike):
        at = 0
        for k, m in enumerate(WORD.finditer(texts[i].lower())):
            if marginal[k] >= 0.5:
                if spans[i] and at == k:
                    spans[i][-1]["end"] = m.end()
                else:
                    spans[i].append({"start": m.start(), "end": m.end()})
                at = k + 1
    return 1 / (1 + np.exp(-np.clip(summary @ field.curve, -40, 40))), spans


def toxic_documents(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, held_out, score, predicted, spans for every document.

    Null and empty texts score like clean ones; without a fitted field every score is 0. Offsets refer to
    the lower-cased text. Repeated rows and null keys are rows like others.
    """
    rows = docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), whole_text().alias("text"))
    span = "array<struct<start:int,end:int>>"
    if field is None:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.array().cast(span).alias("spans"))
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, spans = score_texts(batch.column(2).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, kind)],
                ["doc_id", "held_out", "score", "predicted", "spans"],
            )

    key = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(task, f"doc_id {key}, held_out boolean, score double, predicted int, spans {span}")
