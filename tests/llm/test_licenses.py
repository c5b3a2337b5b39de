"""The licence scan against laying every template over every place of every text."""

import random
import re

import pytest

from fleetfold.llm import licenses

INDEX = licenses.index_templates()


def by_hand(text):
    words = [w.lower() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    base, labels, score = [], set(), 0.0
    for e in INDEX:
        for start in range(-len(e.words) + 1, len(words)):
            here = [0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(e.words)]
            share = sum(here) / len(e.words)
            phrase = all(here[e.phrase_at : e.phrase_at + e.phrase_words])
            if sum(here[i] for _, i in e.rare) >= licenses.AGREEING:
                score = max(score, share)
            if e.base and phrase:
                base.append((start + e.phrase_at, e.label))
            if phrase and (e.base or share >= licenses.COVERAGE):
                labels.add(e.label)
    return (
        len(words), len(base), min((s for s, _ in base), default=None), max((s for s, _ in base), default=None),
        ",".join(sorted({b for _, b in base})), ",".join(sorted(labels)), round(score, 12),
    )


def report(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {
        r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 12))
        for r in licenses.license_report(rows).collect()
    }


def random_text(rng):
    pieces = []
    for _ in range(rng.randint(0, 4)):
        words = re.split(" ", rng.choice(licenses.TEMPLATES).text)
        cut = rng.choice((0, 0, rng.randint(0, len(words))))
        words = words[cut:] if rng.random() < 0.5 else words[: len(words) - cut]
        rate = rng.choice((0, 0, 0.1, 0.3))
        pieces += [rng.choice(("other", "É", "public license", "* by", "#")) if rng.random() < rate else w for w in words]
        pieces += [rng.choice(("plain", "cc", "License", "\n", "all", "rights", "reserved", "7"))] * rng.randint(0, 3)
    return rng.choice((" ", "\n// ")).join(pieces)


def test_random_texts_against_every_place(spark):
    rng = random.Random(5)
    texts = [random_text(rng) for _ in range(400)] + [None, "", "cc by cc by cc", "CC-BY" * 40, "all rights reserved " * 300]
    found = report(spark, texts)
    wrong = [(t, found[i], by_hand(t)) for i, t in enumerate(texts) if found[i] != by_hand(t)]
    assert not wrong, wrong[:2]
    assert sum(bool(f[5]) for f in found.values()) > 100 and any(0 < f[6] < 1 and not f[5] for f in found.values())


@pytest.mark.parametrize("template", licenses.TEMPLATES)
def test_each_template_earns_its_label_and_needs_its_phrase(spark, template):
    commented = "\n".join(f" * {line}" for line in template.text.split(". "))
    broken = template.text.lower()
    first = re.split(" ", template.phrase)[0]
    broken = re.sub(rf"\b{first}\b", "another", broken)
    found = report(spark, [commented, broken])
    assert template.label in found[0][5].split(",") and found[0][6] == 1.0
    assert found[1] == by_hand(broken) and found[1][5] != found[0][5]


def test_the_words_around_a_phrase_decide(spark):
    found = report(spark, [
        "a talk on the permission is hereby granted free of charge clause",
        "Released under the MIT License.",
        "the gnu affero general public license is long",
    ])
    assert found[0][5] == "" and 0 < found[0][6] < licenses.COVERAGE
    assert found[1][5] == "mit"
    assert found[2][4:6] == ("gpl", "gpl")


def test_phrases_must_stand_in_their_templates():
    for phrase in ("absent words", "license"):
        with pytest.raises(ValueError):
            licenses.index_templates((licenses.Template("x", phrase, "some license text"),))
