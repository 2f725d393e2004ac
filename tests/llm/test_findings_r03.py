"""Cases of the third round's findings: each failed before its change."""

from __future__ import annotations

import math
import os
import pickle
import random
import re
import tracemalloc
from collections import Counter
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trialbraid.llm import arrowtext, line_dedup, ngram_join, quality_lm

ORDER = "the old grey fox runs over a wide green hill while many small birds sing loud songs near deep still water".split()
UNSPACED = "[\u0e00-\u0fff\u1000-\u10bf\u1780-\u17ff\u2e80-\u2fff\u3000-\u9fff\uf900-\ufaff\U00010000-\U0010ffff]"
TOKEN = re.compile(f"{UNSPACED}|(?:(?!{UNSPACED})[0-9A-Za-z\u0080-\uffff])+|[^\\x20\\x09-\\x0D0-9A-Za-z\u0080-\U0010ffff]+")


def sentences(rng, n):
    """Stretches of one order of words, from anywhere."""
    return [" ".join(ORDER[(s + i) % len(ORDER)] for i in range(40)) for s in (rng.randrange(100) for _ in range(n))]


def shuffled(rng, text):
    words = text.split()
    rng.shuffle(words)
    return " ".join(words)


@pytest.fixture(scope="module")
def order_of_words(spark, tmp_path_factory):
    """Trusted texts 0 to 119, unlabelled good ones to 129, shuffled ones to 139."""
    rng = random.Random(5)
    good = sentences(rng, 130)
    texts = [*good, *(shuffled(rng, t) for t in good[120:])]
    docs = spark.createDataFrame(
        [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    labels = spark.createDataFrame([(i, 1) for i in range(120)], "doc_id bigint, quality int")
    path = str(tmp_path_factory.mktemp("order"))
    labels.write.parquet(f"{path}/labels.parquet")
    return docs, labels, path


def test_words_in_a_wrong_order_are_rejected(order_of_words):
    docs, labels, _ = order_of_words
    kept = {r.doc_id: r.kept for r in quality_lm.classify_documents(docs, labels).collect()}
    assert all(kept[i] for i in range(120, 130))
    assert not any(kept[i] for i in range(130, 140))


def test_the_pipeline_rejects_words_in_a_wrong_order(spark, order_of_words):
    docs, _, path = order_of_words
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, path).collect()}
    assert kept & set(range(120, 140)) == set(range(120, 130))


def test_characters_of_one_class_are_told_apart(spark):
    symbol = quality_lm._alphabet()
    one, other = next(
        (a, b) for a in range(0x430, 0x450) for b in range(a + 1, 0x460) if symbol[a] == symbol[b]
    ) if len(set(symbol[0x430:0x460])) < 0x30 else (0x430, next(c for c in range(0x460, 0x500) if symbol[c] == symbol[0x430]))
    good = [f"{chr(one) * 3} {chr(one)} {chr(one) * 2}"] * 40
    docs = spark.createDataFrame(
        [*((i, t, "ru") for i, t in enumerate(good)), (90, chr(one) * 5, "ru"), (91, chr(other) * 5, "ru")],
        "doc_id bigint, text string, lang string",
    )
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id bigint, quality int")
    found = {r.doc_id: r.perplexity for r in quality_lm.classify_documents(docs, labels).collect()}
    assert found[91] > 2 * found[90]


def test_tokens_equal_a_plain_pattern():
    texts = ["a,b  c!!\n", "", "漢字 and かな", "ไทย กข", "é世界 \U0001f600x ß", "\x00a\x01", " ", "x", "--", "한국어 말", "က ខ ༀ \uff01"]
    data, offsets = arrowtext.text_bytes(pa.array(texts))
    runs = arrowtext.tokens(data, offsets)
    raw = data.tobytes()
    found = [[raw[i:j].decode() for i, j in zip(runs.start[a:b], runs.end[a:b])] for a, b in zip(runs.first, runs.first[1:])]
    assert found == [TOKEN.findall(t) for t in texts]


def plain_logs(spelled, folds, texts):
    """Plain interpolated Kneser-Ney over pairs of words: nll of (part, text)."""
    frame = lambda t: ["", *TOKEN.findall(t), ""]

    def discounts(counts):
        n = [max(sum(v == k for v in counts.values()), 1) for k in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        raw = [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
        return [min(max(d, 0.05), k + 1 - 0.05) for k, d in enumerate(raw)]

    def model(trusted):
        two = Counter(g for t in trusted for g in zip(frame(t), frame(t)[1:]))
        one = Counter(b for _, b in two)
        d2, d1 = discounts(two), discounts(one)
        off = lambda v, d: d[min(v, 3) - 1] if v else 0

        def alone(w):
            all_ = sum(one.values())
            if not all_:
                return spelled(w)
            back = sum(off(v, d1) for v in one.values()) / all_
            return (one[w] - off(one[w], d1)) / all_ + back * spelled(w)

        def p(a, b):
            same = {g: v for g, v in two.items() if g[0] == a}
            total = sum(same.values())
            if not total:
                return alone(b)
            seen = two[(a, b)]
            return (seen - off(seen, d2)) / total + sum(off(v, d2) for v in same.values()) / total * alone(b)

        return p

    models = [model([t for f, t in folds if f != part]) for part in range(3)]
    return [-sum(math.log(models[part](a, b)) for a, b in zip(frame(t), frame(t)[1:])) for part, t in texts]


@pytest.mark.parametrize("hot", [0, 3, 300_000])
def test_scores_equal_plain_smoothing(spark, monkeypatch, hot):
    """However many gains are broadcast, and with repeated texts."""
    monkeypatch.setattr(quality_lm, "HOT", hot)
    rng = random.Random(3)
    folds = [(i % 2, " ".join(rng.choice(["ab", "abc", "ba,", "c!", "世界", "d"]) for _ in range(rng.randrange(9)))) for i in range(24)]
    folds = [*dict.fromkeys(folds)]
    folds += [folds[0], folds[0]]
    trusted = spark.createDataFrame([(t, f) for f, t in folds], "text string, part int")
    model = quality_lm.WordModel(trusted)
    texts = [*folds, (2, "ab abc zz"), (2, "zz zz\n\nab"), (2, ""), (2, "ab abc zz"), (2, "世 界界")]
    docs = spark.createDataFrame([(i, t, None, p) for i, (p, t) in enumerate(texts)], "doc_id bigint, text string, lang string, part int")
    found = {r.doc_id: r.nll for r in quality_lm.score_documents(docs, model).collect()}
    assert len(found) == len(texts)
    spelled = lambda w: float(np.exp(model.spelling.value.logs([w])[0]))
    expected = plain_logs(spelled, folds, texts)
    assert [found[i] for i in range(len(texts))] == pytest.approx(expected, abs=1e-3)


def test_spelling_tells_labelled_junk_at_the_default_quantile(spark):
    """Other documents than the labelled ones that the model knows."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality_lm.classify_documents(docs, labels.where("doc_id % 2 = 1"))
    rates = judged.join(labels.where("doc_id % 2 = 0"), "doc_id").groupBy("quality")
    kept = {r.quality: r.share for r in rates.agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert kept[1] > 0.95 and kept[0] < 0.2


def test_counts_and_their_shuffle_files_go_when_they_are_read(spark, order_of_words, monkeypatch):
    """What is stored of pairs is gone with the scores, and so are shuffle files with each write."""
    docs, labels, _ = order_of_words
    setting, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    before = spark.conf.get(setting, None)

    def noted(df, *path, stored=quality_lm.stored):
        out = stored(df, *path)
        if {"a", "v0", "w"} & set(out.columns):
            seen.append((spark.conf.get(setting, None), out.inputFiles()))
        return out

    monkeypatch.setattr(quality_lm, "stored", noted)
    judged = quality_lm.classify_documents(docs, labels)
    assert len(seen) > 4 and all(tidy == "true" for tidy, _ in seen)
    assert not any(os.path.exists(urlparse(f).path) for _, files in seen for f in files)
    assert spark.conf.get(setting, None) == before
    assert judged.where("doc_id >= 130 AND kept").count() == 0


def test_packed_columns_are_read_back():
    rng = np.random.default_rng(1)
    ends = np.array([np.iinfo(np.int64).min, np.iinfo(np.int64).max, -1, 0])
    tables = [[rng.integers(-(2**63), 2**63 - 1, 9), rng.integers(0, 5, 9)], [ends, ends[::-1]], [ends[:0], ends[:0]], [ends[:1], ends[:1]]]
    blobs = pa.chunked_array([[quality_lm._packed(*t) for t in tables]], pa.binary())
    found = quality_lm._unpacked(blobs, 2)
    assert found.tolist() == np.concatenate([np.stack(t) for t in tables], axis=1).tolist()


@pytest.mark.parametrize("hot", [30, 300_000])
def test_pairs_take_few_bytes_and_sums_few_rows(spark, monkeypatch, hot):
    """All that is stored of pairs, and a row for each text (not for each text and shard), with rare and frequent words."""
    monkeypatch.setattr(quality_lm, "HOT", hot)
    rng = random.Random(7)
    texts = [" ".join(f"w{int(400 * rng.random() ** 2)}" for _ in range(60)) for _ in range(1000)]
    pairs = {p for t in texts for p in zip(t.split(), t.split()[1:])}
    docs = spark.createDataFrame([(i, t, None, i % 2) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, part int")
    rows = []

    def noted(df, *path, stored=quality_lm.stored):
        out = stored(df, *path)
        if "nll" in out.columns:
            rows.append(out.count())
        return out

    monkeypatch.setattr(quality_lm, "stored", noted)
    model = quality_lm.WordModel(docs)
    held = sum(os.path.getsize(urlparse(f).path) for f in model.rare.inputFiles())
    assert held < (8 if hot > 400 else 24) * len(pairs)
    found = quality_lm.score_documents(docs, model).collect()
    assert len(found) == len(texts) == sum(rows)


def test_hashing_takes_a_part_of_a_slice_at_once():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(ORDER) for _ in range(400_000)), "x" * (arrowtext.HASH_BYTES + 9) + " fox fox"]
    data, offsets = arrowtext.text_bytes(pa.array(texts))
    tracemalloc.start()
    runs = arrowtext.words(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(runs.hash) + 8 * len(data) + 16 * arrowtext.SLICE_BYTES
    first = {}
    for h, i, j in zip(runs.hash.tolist(), runs.start.tolist(), runs.end.tolist()):
        assert first.setdefault(bytes(data[i:j]), h) == h
    assert len(set(first.values())) == len(first) == len(set(ORDER)) + 1


def test_workers_hold_the_rows_of_the_spelling_alone(spark):
    words = spark.createDataFrame([(w,) for w in ORDER], "word string")
    spelling = pickle.loads(pickle.dumps(quality_lm.Spelling(words)))
    assert not hasattr(spelling, "model")
    assert spelling.logs(["fox", "xof"])[0] > spelling.logs(["fox", "xof"])[1]


def test_rows_go_to_python_in_small_batches(spark, order_of_words, monkeypatch):
    docs, labels, _ = order_of_words
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(key), []

    def noted(module):
        plain = module.stored

        def stored(df, *path):
            if any(n in df._jdf.queryExecution().toString() for n in ("MapInArrow", "InArrow")):
                seen.append((module.__name__, int(spark.conf.get(key))))
            return plain(df, *path)

        monkeypatch.setattr(module, "stored", stored)

    for module in (quality_lm, line_dedup, ngram_join):
        noted(module)
    quality_lm.classify_documents(docs, labels)
    line_dedup.dedup_lines(docs)
    ngram_join.join_documents(docs)
    assert {m for m, _ in seen} == {m.__name__ for m in (quality_lm, line_dedup, ngram_join)}
    assert all(size == 8 << 20 for _, size in seen)
    assert spark.conf.get(key) == before
