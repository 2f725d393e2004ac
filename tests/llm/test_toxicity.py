"""Toxicity: parts against plain versions, the label model on made votes, held-out labels."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from trialbraid.llm import toxicity as tox
from trialbraid.llm.arrowtext import term_runs, text_bytes
from trialbraid.llm.catalog import LLM_QUERIES


def votes(texts, lexicon=None):
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    out = tox.votes_of(data, offsets, term_runs(data, offsets), lexicon or tox.Lexicon.of([]))
    return [{name for j, name in enumerate(tox.VOTERS) if v >> j & 1} for v in out.tolist()]


def test_every_kind_of_voter():
    texts = [
        "You are an IDIOT", "an idiot is what they said about you", "THIS IS ALL SHOUTED AT THE ROOM",
        "stop!! now", "end!", "!start", "what a sh*t day", "noooo", "no oo", "a & b % c $ d # e | f",
        "12 34 56 78 90 12 34", "thanks, you loser", None, "", "Imbécile",
    ]
    assert votes(texts) == [
        {"insult_en", "insult_de", "insult_fr", "addressed"}, {"insult_en", "insult_de", "insult_fr"},
        {"shouting"}, {"exclaiming"}, set(), set(), {"masked"}, {"drawn_out"}, set(), {"symbols"},
        {"digits"}, {"polite", "contempt_en", "addressed"}, set(), set(), {"insult_fr"},
    ]
    # Alone or among others, a text has the same votes.
    assert [votes([t])[0] for t in texts] == votes(texts)


def test_learned_words_equal_plain_counts(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(40)]
    bad, data = {"w3", "w17"}, []
    for _ in range(400):
        text = " ".join(rng.choice(words, 6, replace=False))
        data.append((text, int(bool(bad & set(text.split())))))
    data += [("copy " * 3 + "of one toxic page", 1)] * 300
    lexicon = tox.learn_lexicon(spark.createDataFrame(data, "text string, toxic int"))
    seen = {tuple(sorted(set(re.findall(r"\w+", t)))): y for t, y in data}
    bounds = {}
    for w in {x for key in seen for x in key}:
        n = sum(w in key for key in seen)
        k = sum(y for key, y in seen.items() if w in key)
        z = tox.Z
        low = (k + z * z / 2 - z * np.sqrt(k * (n - k) / n + z * z / 4)) / (n + z * z)
        if k >= tox.MIN_DOCUMENTS and low >= tox.BANDS[0]:
            bounds[w] = low
    learned = {h for h, b in zip(lexicon.words.tolist(), lexicon.bits.tolist()) if b >> len(tox.LISTS)}
    plain = {int(term_runs(*text_bytes(pa.array([w]))).hash[0]) for w in bounds}
    assert learned == plain and bad <= set(bounds) and "copy" not in bounds


def test_label_model_finds_accuracies_and_the_correlated_pair(spark):
    rng = np.random.default_rng(5)
    n = 40_000
    y = rng.random(n) < 0.15
    fired = np.zeros((n, len(tox.VOTERS)), bool)
    accurate = {0: (0.8, 0.01), 1: (0.5, 0.02), 2: (0.6, 0.05), 9: (0.3, 0.1)}
    for j, (one, zero) in accurate.items():
        fired[:, j] = rng.random(n) < np.where(y, one, zero)
    # Voter 10 mostly repeats voter 9 and knows nothing itself.
    fired[:, 10] = np.where(rng.random(n) < 0.9, fired[:, 9], rng.random(n) < 0.1)
    bits = (fired * (1 << np.arange(len(tox.VOTERS)))).sum(1)
    gold = np.where(rng.random(n) < 0.2, y, -1).astype(int)
    rows = spark.createDataFrame(
        [(int(b), int(g)) for b, g in zip(bits, gold)], "votes bigint, gold int"
    )
    model = tox.fit_label_model(rows.groupBy("votes", "gold").count().withColumnRenamed("count", "n"))
    assert abs(model.prior - 0.15) < 0.02
    assert model.parents[10] == 9 or model.parents[9] == 10
    for j in (0, 1, 2):
        assert model.parents[j] is None
        assert model.rates[1, 0, j] == pytest.approx(accurate[j][0], abs=0.04)
        assert model.rates[0, 0, j] == pytest.approx(accurate[j][1], abs=0.02)
    # The copy adds next to nothing to the voter it copies.
    both, one = np.zeros((2, len(tox.VOTERS)))
    both[[9, 10]], one[9] = 1, 1
    odds = model.log_odds(np.array([both, one]))
    assert abs(odds[0] - odds[1]) < 0.5


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    out = LLM_QUERIES["op12_toxicity"](spark, sf)
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in got)
    assert hit / sum(r.toxic for r in got) > 0.75
    assert hit / sum(r.predicted for r in got) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    good = [r.score for r in got if not r.toxic]
    bad = [r.score for r in got if r.toxic]
    assert np.mean([[b > g for g in good] for b in bad]) > 0.95


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (2, None), (None, 1), (7, 0), (99, 1)], "doc_id bigint, toxic int"
    )
    for docs, known in ((odd, labels), (odd, labels.limit(0)), (nothing, labels), (nothing, labels.limit(0))):
        classifier = tox.train(docs, known)
        out = tox.score_documents(odd, classifier).collect()
        assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
        by_text = {}
        for row, text in zip(out, [r.text for r in odd.collect()]):
            assert by_text.setdefault(text or "", row.score) == row.score
        assert tox.score_documents(nothing, classifier).count() == 0
    named = odd.selectExpr("'k' || doc_id AS doc_id", "text")
    own = labels.selectExpr("'k' || doc_id AS doc_id", "toxic")
    assert tox.score_documents(named, tox.train(named, own)).schema["doc_id"].dataType.simpleString() == "string"
