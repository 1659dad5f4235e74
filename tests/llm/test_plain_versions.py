"""License scans, secret scans and the quality classifier against plain versions of their methods."""

import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import cataloom.llm.licenses as L
import cataloom.llm.quality as Q
import cataloom.llm.secrets as S

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, key int, notice int, label string, words int, t string, base int"


def table(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, 2, "l", 3, "t", 4) for r in rows], DOCS)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- licenses


def plain_words(text):
    return re.findall(L.WORD, lowered(text))


def plain_notices(text, templates, min_share=0.75, drift=2):
    words, out = plain_words(text), set()
    for label, template in templates:
        notice = plain_words(template)
        votes = {}
        for q in range(len(notice) - 2):
            for p in range(len(words) - 2):
                if words[p : p + 3] == notice[q : q + 3]:
                    votes.setdefault(p - q, []).append((q, p))
        band, bands = None, []
        for diagonal in sorted(votes):
            if band is None or diagonal - band > drift:
                bands.append([])
            bands[-1] += votes[diagonal]
            band = diagonal
        for hits in bands:
            share = len({q for q, _ in hits}) / (len(notice) - 2)
            first, last = min(p for _, p in hits), max(p for _, p in hits) + 3
            if share >= min_share and last - first <= 1.5 * len(notice):
                out.add((label, first, last, round(share, 9)))
    return sorted(out)


def plain_base(text):
    words = plain_words(text)
    return sorted((i, label) for phrase, label in L.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())


def altered(text, draw):
    words = text.split()
    for _ in range(draw.randint(0, 3)):
        at = draw.randrange(len(words))
        words[at : at + draw.randint(0, 1)] = draw.choices(["so", "the", words[at]], k=draw.randint(0, 1))
    return " ".join(words)


def test_licenses_equal_plain_diagonals(spark):
    draw = random.Random(12)
    texts = [" ".join(draw.choice([altered(t, draw), "some other words here", "all rights reserved"]) for _, t in draw.choices(L.NOTICES, k=draw.randint(1, 4))) for _ in range(80)]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(7, "nothing"), (7, texts[3]), (None, None), (5, ""), (5, "")]
    for templates in (None, [("one", L.NOTICES[3][1]), ("two", L.NOTICES[0][1] + " " + L.NOTICES[2][1]), ("short", "a b"), ("short", None), (None, "a b c d"), ("one", L.NOTICES[3][1])]):
        given = None if templates is None else spark.createDataFrame(templates, "label string, text string")
        known = L.NOTICES if templates is None else [t for t in templates[:2]]
        got = sorted(((r.doc_id, [(b.start, b.label) for b in sorted(r.base)], sorted((n.label, n.first, n.last, round(n.share, 9)) for n in r.notices or []), r.n_words, round(r.score, 9)) for r in L.licenses(table(spark, rows), given).collect()), key=str)
        want = []
        for i, t in rows:
            base, notices = plain_base(t), plain_notices(t, known)
            want.append((i, base, notices, len(plain_words(t)), 1.0 if base else min(1.0, max((n[3] for n in notices), default=0.0))))
        assert got == sorted(want, key=str)
    assert sum(bool(w[2]) for w in want) > 0


def test_many_templates_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_GRAMS", 5)
    rows = table(spark, [(1, L.NOTICES[3][1]), (2, "x")])
    got = {r.doc_id: r.notices for r in L.licenses(rows, L.default_templates(spark)).collect()}
    assert [n.label for n in got[1]] == ["bsd"] and got[2] is None


def test_rows_keep_their_own_labels(spark):
    rows = [(1, "nothing to see here at all"), (1, dict(L.NOTICES)["mit"]), (None, dict(L.NOTICES)["mit"]), (None, "x")]
    got = sorted((r.doc_id or 0, r.n_words, [n.label for n in r.notices or []]) for r in L.licenses(table(spark, rows)).collect())
    assert [labels for _, n, labels in got if n in (1, 6)] == [[], []] and all(labels == ["mit"] for _, n, labels in got if n not in (1, 6))


# --- secrets


def plain_base_secrets(text):
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(S.ASSIGN.replace("(?i:(password", "((?i:password").replace("api_?key))", "api_?key))"), text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(S.ACCESS, text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end(), "hex") for m in re.finditer(S.HEX, text) if len(m[0]) >= 24])


def plain_ratios(samples):
    counts = {}
    for token, random_ in samples:
        chars = [c for c in token or "" if c in S.ALPHABET]
        for a, b in zip(chars, chars[1:]):
            counts[random_, a, b] = counts.get((random_, a, b), 0) + 1
    total = {}
    for (side, a, _), n in counts.items():
        total[side, a] = total.get((side, a), 0) + n
    chance = lambda side, a, b: (counts.get((side, a, b), 0) + 0.5) / (total.get((side, a), 0) + 0.5 * len(S.ALPHABET))
    return {(a, b): math.log(chance(True, a, b) / chance(False, a, b)) for a in S.ALPHABET for b in S.ALPHABET}


def test_secrets_equal_plain_patterns_and_ratios(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    samples = S.labelled_samples(spark, docs, max_docs=40, random_strings=100)
    models = S.train(samples)
    ratios = plain_ratios([tuple(r) for r in samples.collect()])
    assert np.allclose(models.ratios, [ratios[a, b] for a in S.ALPHABET for b in S.ALPHABET])
    draw = random.Random(4)
    extra = ["".join(draw.choices(["token", "=", ": ", "'", "Zq9", "AKIA", "0a1b", "é", "x" * 9, " ", "B7kPq2Lm9Xz4Tt0Rv8Wn"], k=30)) for _ in range(60)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + i, t) for i, t in enumerate(extra)] + [(None, None), (20_000, ""), (20_001, " token=abcdefgh  " + "0a" * 20)]
    got = {(r.doc_id): ([tuple(b)[:4] for b in r.base], [(b.start, b.end) for b in r.added]) for r in S.secrets(table(spark, rows), models).collect()}
    some = 0
    for i, text in rows:
        text = text or ""
        base = plain_base_secrets(text)
        tokens = [(m.start(), m.end(), sum(ratios[a, b] for a, b in zip(m[0], m[0][1:])) / (len(m[0]) - 1)) for m in re.finditer(S.CANDIDATE, text)]
        assert all(abs(mean - 0.75) > 1e-9 for *_, mean in tokens)
        free = [(a, b) for a, b, mean in tokens if mean >= 0.75 and not any(x < b and a < y for x, _, y, _ in base)]
        assert got[i] == (base, free)
        some += len(free)
    assert some > 5


# --- quality


def test_margins_equal_all_pairs():
    draw = np.random.default_rng(2)
    size = (1 << Q.BITS) + Q.STATISTICS
    model = Q.FactorisationMachine(0.3, draw.normal(size=size), draw.normal(size=(size, Q.RANK)))
    parts = [(draw.choice(size, n, replace=False), draw.normal(size=n)) for n in (1, 2, 30)]
    begins = np.concatenate(([0], np.cumsum([len(n) for n, _ in parts])))
    got, _ = model.margins(np.concatenate([n for n, _ in parts]), np.concatenate([v for _, v in parts]), begins)
    for (number, value), margin in zip(parts, got, strict=True):
        want = 0.3 + sum(model.linear[i] * x for i, x in zip(number, value))
        for a in range(len(number)):
            for b in range(a):
                want += model.factors[number[a]] @ model.factors[number[b]] * value[a] * value[b]
        assert margin == pytest.approx(want)


def test_scores_are_the_margins_of_whole_texts(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.fit(docs, labels, max_rows=100, epochs=2)
    got = {r.doc_id: r for r in Q.scored(docs, model).collect()}
    for r in docs.collect():
        number, value, begins = next(Q.features(__import__("pyarrow").array([r.text])))
        w = model.linear[number] @ value
        factors = model.factors[number] * value[:, None]
        pairs = sum(float(factors[a] @ factors[:a].sum(0)) for a in range(1, len(factors)))
        score = 1 / (1 + math.exp(-(model.bias + w + pairs)))
        assert got[r.doc_id].score == pytest.approx(score, abs=1e-4) and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.5)
    assert json.dumps(sorted(got)) == json.dumps(sorted(r.doc_id for r in docs.collect()))


def test_equal_rows_have_equal_scores_and_empty_tables_none(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.fit(docs, labels, max_rows=50, epochs=1)
    rows = table(spark, [(1, "same words"), (1, "same words"), (None, "same words"), (2, None), (3, "")])
    got = sorted((r.score for r in Q.scored(rows, model).collect()))
    assert len(got) == 5 and len({round(x, 9) for x in got}) == 2
    assert Q.scored(rows.where(F.lit(False)), model).count() == 0
