"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent units of ``HIDDEN`` cells read the UTF-8 bytes of a window
forwards and backwards; a softmax over both states labels every position, and a
document's probabilities are the mean over all its positions. Whole texts are
read, in windows of ``SPAN`` bytes that start from a zero state. Gates are
piecewise linear, which costs a fraction of an exponential.

The network is trained in numpy by backpropagation through time on windows of a
bounded sample: the first ``PER_LANGUAGE`` documents of each language by a hash
of the id (fewer, but one at least, where all languages have more than
``DOCUMENTS``), ``WINDOWS`` windows of ``TRAIN_SPAN`` bytes of each, cut from
texts of any length before they leave the executors, by Adam in a fixed order of
windows. Every value of lang is learned; positions are labelled in fewer lanes
as there are more languages.

Learned only from text and lang of rows whose crc32 of the id leaves a
remainder but 0 modulo 5; nothing but text is read for a prediction.

Defined results: null texts and texts without a letter are ``und`` with score
0; so is every text if nothing could be learned; ties go to the language first
by code point; repeated rows get equal predictions; rows with a null lang or id
aren't learned from; an empty table gives an empty result; texts of any length are read whole; an id that
repeats within a language is in the sample once; columns named like an output
column are replaced, others stay, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

HIDDEN = 12
SPAN = 128
#: Windows that are read at a time by a model of few languages, and the labels that all lanes and languages may have.
LANES = 2048
LABELS = LANES * 16
PER_LANGUAGE = 300
WINDOWS = 8
TRAIN_SPAN = 64
BATCH = 256
EPOCHS = 6
RATE = 0.02
#: Documents of the sample, if there aren't more languages.
DOCUMENTS = 60_000
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Unit:
    """One direction: input table (256, 3 HIDDEN), recurrent matrix (HIDDEN, 3 HIDDEN); gates r, z, candidate."""

    table: np.ndarray
    recur: np.ndarray

    def states(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(time, windows, HIDDEN) for bytes (time, windows); a masked place resets the state."""
        k = self.recur.shape[0]
        h, out = np.zeros((x.shape[1], k), np.float32), np.empty((*x.shape, k), np.float32)
        for t in range(len(x)):
            u, v = self.table[x[t]], h @ self.recur
            g = u[:, : 2 * k] + v[:, : 2 * k]
            gate = np.clip(0.2 * g + 0.5, 0, 1)
            r, z, un = gate[:, :k], gate[:, k:], v[:, 2 * k :]
            n = np.tanh(u[:, 2 * k :] + r * un)
            if keep is not None:
                keep.append((h, r, z, un, n, (gate > 0) & (gate < 1)))
            h = (n + z * (h - n)) * mask[t][:, None]
            out[t] = h
        return out

    def gradients(self, x: np.ndarray, mask: np.ndarray, keep: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self.recur.shape[0]
        d_recur, d_in = np.zeros_like(self.recur), np.empty((*x.shape, 3 * k), np.float32)
        dh = np.zeros((x.shape[1], k), np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, r, z, un, n, inside = keep[t]
            dh = (dh + d_out[t]) * mask[t][:, None]
            dn = dh * (1 - z) * (1 - n * n)
            dv = np.concatenate([dn * un, dh * (h - n), dn * r], 1)
            dv[:, : 2 * k] *= 0.2 * inside
            d_in[t] = dv
            d_in[t][:, 2 * k :] = dn
            d_recur += h.T @ dv
            dh = dh * z + dv @ self.recur.T
        d_table = np.zeros_like(self.table)
        np.add.at(d_table, x.reshape(-1), d_in.reshape(-1, 3 * k))
        return d_table, d_recur


@dataclass
class Model:
    langs: list[str]
    ahead: Unit
    back: Unit
    out: np.ndarray
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.ahead.table, self.ahead.recur, self.back.table, self.back.recur, self.out, self.bias]

    def labels(self, x: np.ndarray, mask: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities (time, windows, languages) of every position, and the states."""
        a = self.ahead.states(x, mask, keep and keep[0])
        b = self.back.states(x[::-1], mask[::-1], keep and keep[1])[::-1]
        both = np.concatenate([a, b], 2)
        y = both @ self.out + self.bias
        y = np.exp(y - y.max(2, keepdims=True))
        return y / y.sum(2, keepdims=True), both


def windows(texts: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (time, windows) of whole texts, mask, and the text of each window."""
    many = [-(-len(t) // span) for t in texts]
    flat = b"".join(t + bytes(n * span - len(t)) for t, n in zip(texts, many, strict=True))
    x = np.frombuffer(flat, np.uint8).reshape(-1, span)
    of = np.repeat(np.arange(len(texts)), many)
    left = np.array([len(t) for t in texts])[of] - (np.arange(len(of)) - (np.cumsum(many) - many)[of]) * span
    mask = np.arange(span)[None, :] < left[:, None]
    return x.T, mask.T.astype(np.float32), of


def train(sample: list[tuple[list[bytes], str]]) -> Model | None:
    """Learn from (windows of a text, its language)."""
    sample = [(cuts, y) for cuts, y in sample if any(cuts)]
    langs = sorted({y for _, y in sample})
    if not langs:
        return None
    rng = np.random.default_rng(20240501)
    k, c = HIDDEN, len(langs)
    unit = lambda: Unit(rng.normal(0, 0.3, (256, 3 * k)).astype(np.float32), rng.normal(0, 0.3, (k, 3 * k)).astype(np.float32))
    model = Model(langs, unit(), unit(), rng.normal(0, 0.1, (2 * k, c)).astype(np.float32), np.zeros(c, np.float32))
    number = {lang: i for i, lang in enumerate(langs)}
    cuts, ys = [w for ws, _ in sample for w in ws], [number[lang] for ws, lang in sample for _ in ws]
    x = np.frombuffer(b"".join(w.ljust(TRAIN_SPAN, b"\0") for w in cuts), np.uint8).reshape(-1, TRAIN_SPAN)
    size, y = np.array([len(w) for w in cuts]), np.array(ys)
    even = len(y) / (c * np.bincount(y, minlength=c))
    m, v, step = [np.zeros_like(p) for p in model.parts()], [np.zeros_like(p) for p in model.parts()], 0
    steps = EPOCHS * max(1, len(y) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(order) - min(BATCH, len(order)) + 1, BATCH):
            pick = order[i : i + BATCH]
            xs, mask = x[pick].T, (np.arange(TRAIN_SPAN)[:, None] < size[pick][None, :]).astype(np.float32)
            keep: tuple[list, list] = ([], [])
            p, both = model.labels(xs, mask, keep)
            d = p.copy()
            d[:, np.arange(len(pick)), y[pick]] -= 1
            d *= (mask * even[y[pick]][None, :])[:, :, None] / mask.sum()
            d = d.astype(np.float32)
            d_both = d @ model.out.T
            flat = both.reshape(-1, 2 * k)
            g = [*model.ahead.gradients(xs, mask, keep[0], d_both[:, :, :k]), *model.back.gradients(xs[::-1], mask[::-1], keep[1], d_both[::-1, :, k:]), flat.T @ d.reshape(-1, c), d.sum((0, 1))]
            step += 1
            norm = np.sqrt(sum(float((z * z).sum()) for z in g))
            rate = RATE * (1 - 0.9 * step / max(steps, step))
            for j, p_ in enumerate(model.parts()):
                gj = g[j] * min(1.0, 1.0 / (norm + 1e-9))
                m[j] = 0.9 * m[j] + 0.1 * gj
                v[j] = 0.999 * v[j] + 0.001 * gj * gj
                p_ -= (rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def pooled(model: Model, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities over all positions of each text; texts must not be empty."""
    total = np.zeros((len(texts), len(model.langs)))
    x, mask, of = windows(texts, SPAN)
    lanes = max(1, min(LANES, LABELS // len(model.langs)))
    for i in range(0, x.shape[1], lanes):
        p, _ = model.labels(x[:, i : i + lanes], mask[:, i : i + lanes])
        np.add.at(total, of[i : i + lanes], np.einsum("twc,tw->wc", p, mask[:, i : i + lanes]))
    return total / np.array([max(1, len(t)) for t in texts])[:, None]


def sample(docs: DataFrame) -> list[tuple[list[bytes], str]]:
    """Windows and languages of at most PER_LANGUAGE documents of each language."""
    raw = common.utf8("text")
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~common.held_out(F.col("doc_id")) & (F.octet_length("text") > 0))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    counts = common.save(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    each = max(1, min(PER_LANGUAGE, DOCUMENTS // max(1, counts.count())))
    # twice the share wanted by hash, of which the first are taken: few rows are shuffled, and fewer reach the driver
    share = counts.select("lang", F.least(F.lit(1 << 30), F.floor(F.lit((2 * each + 50) * (1 << 30)) / F.col("n")) + 1).alias("_below"))
    at = lambda k: F.pmod(F.xxhash64(F.col("doc_id"), F.lit(k)), F.greatest(F.lit(1), F.octet_length("text") - TRAIN_SPAN // 2)).cast("int")
    cuts = F.array(*[F.substring(raw, at(k) + 1, F.lit(TRAIN_SPAN)) for k in range(WINDOWS)])
    near = known.select("lang", "doc_id", place.alias("_place"), cuts.alias("_cuts")).join(share, "lang").where("_place < _below")
    near = near.groupBy("lang", "_place", "doc_id").agg(F.min("_cuts").alias("_cuts"))
    first = near.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_place", "doc_id"))).where(F.col("_n") <= each)
    rows = sorted(first.select("lang", "_n", "_cuts").collect(), key=lambda r: (r["lang"], r["_n"]))
    return [([bytes(w) for w in r["_cuts"]], r["lang"]) for r in rows]


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds lang_pred and score to ``docs``."""
    docs = docs.drop("lang_pred", "score")
    names, own = docs.columns, common.spare(docs, "_text")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            texts = [x or "" for x in b.column(own).to_pylist()]
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            ask = [i for i, t in enumerate(texts) if model is not None and _LETTER.search(t)]
            if ask:
                p = pooled(model, [texts[i].encode("utf-8", "replace") for i in ask])
                for i, row in zip(ask, p, strict=True):
                    lang[i], score[i] = model.langs[int(row.argmax())], min(1.0, float(row.max()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.withColumn(own, F.col("text")).mapInArrow(run, schema)


def op4_langid(spark, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(sample(docs))
    x = predict(docs.select("doc_id", "text"), model)
    return x.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
