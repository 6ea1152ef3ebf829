"""Learned operators: exact parts against brute force, held-out accuracy, odd rows."""

import itertools
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_contracts import SCHEMA, odd_texts

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(odd_texts())] + [(7, "repeated row", "en", "s", 3)] * 2 + [(None, "no id", "en", "s", 1)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).withColumn("spans", F.lit(1)).repartition(3)


def test_marginals_are_exact():
    from loomlint.llm.toxicity import Field

    rng = np.random.default_rng(0)
    for sizes in ([1], [3, 1, 4], [2, 5, 1, 1]):
        n = sum(sizes)
        f = Field(np.zeros(1), 0.0, rng.normal(size=(2, 2)), rng.normal(), np.zeros(3))
        s, first = rng.normal(size=n) * 2, np.zeros(n, bool)
        first[np.cumsum(sizes) - np.array(sizes)] = True
        got, at = f.marginals(s, first), 0
        for size in sizes:
            mass, total = np.zeros(size), 0.0
            for y in itertools.product((0, 1), repeat=size):
                w = np.exp(sum(s[at + i] * y[i] for i in range(size)) + y[0] * f.start + sum(f.trans[a, b] for a, b in zip(y, y[1:])))
                total += w
                mass += w * np.array(y)
            assert np.allclose(got[at : at + size], mass / total)
            at += size


def test_long_chains_cross_blocks():
    from loomlint.llm.toxicity import BLOCK, Field

    rng = np.random.default_rng(1)
    n = 3 * BLOCK + 17
    f = Field(np.zeros(1), 0.0, np.array([[0.5, -0.5], [-0.2, 0.9]]), 0.3, np.zeros(3))
    s, first = rng.normal(size=n), np.zeros(n, bool)
    first[[0, 5, BLOCK, 2 * BLOCK + 3]] = True
    whole, cut = f.marginals(s, first), [0, 5, BLOCK, 2 * BLOCK + 3, n]
    parts = [f.marginals(s[a:b], first[a:b]) for a, b in zip(cut, cut[1:])]
    assert np.allclose(whole, np.concatenate(parts))


def test_toxicity(spark, odd):
    from loomlint.llm import toxicity

    x = toxicity.op1_toxicity(spark, SF)
    assert x.count() == 1000 and x.where("score between 0 and 1 and predicted = cast(score >= 0.5 as int)").count() == 1000
    joined = x.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("held_out and lang = 'en'")
    got = {(r["toxic"], r["predicted"]): r["count"] for r in joined.groupBy("toxic", "predicted").count().collect()}
    assert got[0, 0] >= 0.97 * (got[0, 0] + got.get((0, 1), 0)) and got[1, 1] >= 0.75 * (got[1, 1] + got.get((1, 0), 0))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spans = x.join(docs, "doc_id").where("size(spans) > 0").select(F.explode("spans").alias("s"), "text").select(F.expr("lower(substring(text, cast(s.start + 1 as int), cast(s.end - s.start as int)))").alias("w"))
    # a plain field, word by word, gives the same scores
    field = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in x.collect()}
    A = np.exp(field.trans)
    for r in docs.where("doc_id < 40").collect():
        e = [np.exp(np.clip(field.word_score(w), -30, 30)) for w in toxicity.words_of((r["text"] or "").encode())]
        ahead, back = [], [np.ones(2)]
        for i, v in enumerate(e):
            a = np.array([1.0, np.exp(field.start)]) if not i else ahead[-1] @ A
            a = a * [1.0, v]
            ahead.append(a / a.sum())
        for v in e[:0:-1]:
            b = A @ (back[0] * [1.0, v])
            back.insert(0, b / b.sum())
        p = np.array([(a * b / (a * b).sum())[1] for a, b in zip(ahead, back)])
        top, mass = min(1 - 1e-4, max([1e-4, *p])), p.sum() if len(p) else 0.0
        z = field.head @ [1.0, np.log(top / (1 - top)), np.log1p(mass)]
        assert abs(scores[r["doc_id"]] - 1 / (1 + np.exp(-z))) < 1e-4
    words = {r["w"]: r["count"] for r in spans.groupBy("w").count().collect()}
    assert max(words, key=words.get).isalpha() and len(words) < 60
    field = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    y = toxicity.score(odd, field)
    assert y.count() == odd.count() and y.where("score is null or score >= 0.5 or size(spans) > 0").count() == 0
    none = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0"))
    assert none is None and toxicity.score(odd, none).agg(F.max("score")).first()[0] == 0
    assert toxicity.score(odd.limit(0), field).count() == 0


def test_toxicity_in_all_languages(spark):
    from loomlint.llm import toxicity

    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    x = toxicity.op1_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    got = {(r["lang"], r["toxic"]): (r["n"], r["hit"]) for r in x.groupBy("lang", "toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("hit")).collect()}
    assert all(got[lang, 0][1] <= 0.03 * got[lang, 0][0] for lang in ("en", "de", "fr", "es"))
    for lang, least in (("en", 0.85), ("de", 0.75), ("fr", 0.8), ("es", 0.5)):
        assert got[lang, 1][1] >= least * got[lang, 1][0], (lang, got)


def test_backpropagation_matches_differences():
    from loomlint.llm import langid

    rng = np.random.default_rng(3)
    k, c, n, span = 3, 2, 4, 6
    unit = lambda: langid.Unit(rng.normal(0, 0.5, (256, 3 * k)), rng.normal(0, 0.5, (k, 3 * k)))
    model = langid.Model(["a", "b"], unit(), unit(), rng.normal(size=(2 * k, c)), np.zeros(c))
    x = rng.integers(0, 5, (span, n)).astype(np.uint8)
    mask = (np.arange(span)[:, None] < np.array([6, 4, 2, 6])[None, :]).astype(np.float32)
    want = rng.normal(size=(span, n, k))

    def value():
        return float((model.ahead.states(x, mask) * want).sum())

    keep = []
    model.ahead.states(x, mask, keep)
    d_table, d_recur = model.ahead.gradients(x, mask, keep, want)
    for p, g in ((model.ahead.recur, d_recur), (model.ahead.table, d_table)):
        for at in [(0, 0), (1, 4), (2, 8), (2, 1)]:
            old = p[at]
            p[at] = old + 1e-3
            up = value()
            p[at] = old - 1e-3
            down = value()
            p[at] = old
            assert abs((up - down) / 2e-3 - g[at]) < 1e-2 * max(1, abs(g[at]))


def test_langid(spark, odd):
    from loomlint.llm import langid

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    x = langid.op4_langid(spark, SF)
    assert x.count() == 1000 and x.where("score between 0 and 1").count() == 1000
    held = x.join(docs, "doc_id").where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()
    model = langid.train(langid.sample(docs))
    y = langid.predict(odd, model)
    rows = [(r["text"], r["lang_pred"], r["score"]) for r in y.collect()]
    assert len(rows) == odd.count()
    for text, lang, score in rows:
        und = not any(c.isalpha() for c in text or "")
        assert (lang == "und") == und and (score == 0) == und
    assert langid.sample(docs.limit(0)) == [] and langid.train([]) is None
    assert langid.predict(odd, None).where("lang_pred <> 'und'").count() == 0


def test_langid_against_a_plain_network(spark):
    """Predictions equal those of a network read byte by byte; every language is learned, from long documents too."""
    from loomlint.llm import langid

    rows = [(i, f"{'abc xyz' if i % 2 else 'kqj vww'} " * (1 if i < 40 else 50_000), f"l{i % 2}" if i < 40 else "long") for i in range(44)] + [(100 + i, f"w{i} " * 20, f"rare{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    sample = langid.sample(docs)
    assert {y for _, y in sample} == {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 5} and all(len(w) <= langid.TRAIN_SPAN for ws, _ in sample for w in ws)
    model = langid.train(langid.sample(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 200")))
    texts = ["Ein kurzer Satz.", "é", "the " * 100, "x" * 129, "mañana 12"]
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()

    def states(unit, bs):
        k, h, out = unit.recur.shape[0], np.zeros(unit.recur.shape[0]), []
        for b in bs:
            u, v = unit.table[b], h @ unit.recur
            r, z = (np.clip(0.2 * (u[i * k : (i + 1) * k] + v[i * k : (i + 1) * k]) + 0.5, 0, 1) for i in (0, 1))
            n = np.tanh(u[2 * k :] + r * v[2 * k :])
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    for r in got:
        raw, total = texts[r["doc_id"]].encode(), 0
        for i in range(0, len(raw), langid.SPAN):
            w = raw[i : i + langid.SPAN]
            for a, b in zip(states(model.ahead, w), states(model.back, w[::-1])[::-1]):
                y = np.exp(np.concatenate([a, b]) @ model.out + model.bias)
                total = total + y / y.sum()
        p = total / len(raw)
        assert model.langs[int(p.argmax())] == r["lang_pred"] and abs(p.max() - r["score"]) < 1e-3


def test_quality_against_plain_counts(spark, monkeypatch):
    """Weights, scores and verdicts from plain counts; broadcast or shuffled, trusted ids count alike."""
    from loomlint.llm import quality

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(None, "no id " * 30), (1, None)], "doc_id bigint, text string"))
    model = quality.fit(docs, labels)
    monkeypatch.setattr(quality, "BROADCAST_IDS", 0)
    assert np.array_equal(quality.fit(docs, labels).weight, model.weight)
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    raw, trusted = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    rows = docs.collect()

    def buckets(text):
        h = [zlib.crc32(w) for w in (text or "").encode().split()]
        return [x % quality.BUCKETS for x in h] + [((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) % 2**64 >> 32) % quality.BUCKETS for a, b in zip(h, h[1:])]

    for r in rows:
        for b in buckets(r["text"]):
            raw[b] += 1
            trusted[b] += r["doc_id"] in good
    weight = np.log((trusted + 1) / (trusted.sum() + quality.BUCKETS)) - np.log((raw + 1) / (raw.sum() + quality.BUCKETS))
    assert np.allclose(weight, model.weight)
    for r in quality.score(docs, model).collect():
        b = buckets(r["text"])
        want = weight[b].mean() if b else 0.0
        assert abs(want - r["score"]) < 1e-9 and r["kept"] == (not r["base_failed"] and r["score"] >= model.threshold)


def test_windows_cover_whole_texts():
    from loomlint.llm import langid

    texts = [b"abc", b"x" * 300, b"y" * 128]
    x, mask, of = langid.windows(texts, 128)
    for i, t in enumerate(texts):
        assert b"".join(x[:, j][mask[:, j] > 0].tobytes() for j in np.nonzero(of == i)[0]) == t


def test_quality_counts_every_trusted_document(spark):
    from loomlint.llm import quality

    docs = spark.range(20_500).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("same"), F.concat(F.lit("w"), F.col("id"))).alias("text"))
    model = quality.fit(docs, docs.select("doc_id", F.lit(1).alias("quality")))
    assert not model.weight.any()  # all text is trusted: both multinomials are one


def word_buckets(text):
    h = [zlib.crc32(w) for w in (text or "").encode().split()]
    return [x % 10_000 for x in h] + [((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) % 2**64 >> 32) % 10_000 for a, b in zip(h, h[1:])]


def test_quality_threshold_comes_from_every_labelled_document(spark, monkeypatch):
    """More labels than a sample of some thousands, long texts, equal texts, ids that repeat or are labelled both ways; broadcast or shuffled."""
    from loomlint.llm import quality

    rng = np.random.default_rng(3)

    def text(n, share):
        return " ".join(f"{'good' if own else 'bad'}{w}" for own, w in zip(rng.random(n) < share, rng.integers(0, 400, n)))

    docs = [(i, text(60, 0.9 - 0.4 * (i % 2) * rng.random())) for i in range(6000)]
    docs += [(7000 + i, text(40_000, 0.3 + 0.1 * i)) for i in range(6)] + [(8000 + i, docs[0][1]) for i in range(50)] + [(3, docs[9][1]), (9000, "too short"), (9001, None), (None, docs[5][1])]
    assert max(len(t or "") for _, t in docs) > 200_000
    labels = [(d, 1 - d % 2) for d, _ in docs if d is not None and d < 5500 or d is not None and d >= 7000] + [(11, 1), (None, 1), (None, 0), (5600, None), (10**6, 1)]
    x, y = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), spark.createDataFrame(labels, "doc_id bigint, quality int")
    want = brute.quality_threshold(docs, labels, word_buckets)
    model = quality.fit(x, y)
    assert abs(model.threshold - want) < 1e-9
    monkeypatch.setattr(quality, "BROADCAST_IDS", 0)
    assert quality.fit(x, y).threshold == model.threshold
    good = [(d, q) for d, q in labels if q == 1]
    assert abs(quality.fit(x, y.where("quality = 1")).threshold - brute.quality_threshold(docs, good, word_buckets)) < 1e-9
