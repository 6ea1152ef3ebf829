"""Toxicity: a linear-chain conditional random field tags toxic words.

Labels are of documents, so token labels come first: over a bounded sample of
labelled documents, forms (a word, its beginnings, its ends) whose document
frequency is far higher in toxic documents, by log-likelihood ratio, are seeds;
words of toxic documents that have a seed form are labelled toxic, all others
clean (toxic documents that no seed explains are looked at again by
themselves). On these labelled sequences the field learns weights of hashed forms
and of transitions by gradient ascent on the conditional likelihood.

For every document, forward-backward marginals of the two tags give a score: a
logistic function of the largest marginal and of the expected number of toxic
words. Words whose marginal exceeds one half are the offending spans.

Forward and backward passes of a binary chain are compositions of Moebius maps
of the odds. All words of a batch lie in one chain that restarts at each
document; maps are composed within blocks, blocks are chained, and the odds run
through all blocks at once, so one text of a million words costs what a
thousand texts of a thousand words cost.

Learned only from rows whose crc32 of the id leaves a remainder but 0 modulo 5;
lang, source and ids are never features. Sample bounds: ``TOXIC`` and ``CLEAN``
documents of at most ``SAMPLE_BYTES`` each, 60 MB in all; an id that repeats in the
documents is in the sample once.

Defined results: null and empty texts and texts without letters have a score
from the bias alone and no spans; without any toxic or any clean label all
scores are 0; labels that are null are ignored, and a document labelled both
ways is in the sample once, as toxic; repeated rows get equal scores; an empty
table gives an empty result; texts of any length are scored whole; columns named
like an output column are replaced, others stay, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

TOXIC = 1000
CLEAN = 2000
SAMPLE_BYTES = 20_000
FORMS = 1 << 18
BLOCK = 512
#: A seed form's log-likelihood ratio against chance, and its share of toxic documents.
SEED_LLR = 12.0
#: The same for documents that earlier seeds don't explain; they are few and of fewer languages.
LATER_LLR = 12.0
SEED_SHARE = 0.9
STEPS = 40
CACHE = 500_000
_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
_TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def forms(word: bytes) -> list[bytes]:
    n = len(word)
    return [b"=" + word, *[b"^" + word[:k] for k in (3, 4, 5, 6, 8) if n > k], *[b"$" + word[-k:] for k in (3, 4) if n > k]]


def _slots(word: bytes) -> list[int]:
    return [crc32(f) % FORMS for f in forms(word)]


def _run(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, x: float) -> np.ndarray:
    """x_t = (a_t x_(t-1) + b_t) / (c_t x_(t-1) + d_t) for all t."""
    n = len(a)
    lanes = -(-n // BLOCK) if n else 0
    if not lanes:
        return np.zeros(0)
    pad = lanes * BLOCK - n
    shape = lambda v, fill: np.concatenate([v, np.full(pad, fill)]).reshape(lanes, BLOCK).T.copy()
    a, b, c, d = shape(a, 1.0), shape(b, 0.0), shape(c, 0.0), shape(d, 1.0)
    p, q, r, s = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)
    for t in range(BLOCK):
        p, q, r, s = a[t] * p + b[t] * r, a[t] * q + b[t] * s, c[t] * p + d[t] * r, c[t] * q + d[t] * s
        top = np.maximum(np.maximum(p, q), np.maximum(r, s))
        p, q, r, s = p / top, q / top, r / top, s / top
    into = np.empty(lanes)
    for i in range(lanes):
        into[i] = x
        x = (p[i] * x + q[i]) / (r[i] * x + s[i])
    out = np.empty((BLOCK, lanes))
    for t in range(BLOCK):
        into = (a[t] * into + b[t]) / (c[t] * into + d[t])
        out[t] = into
    return out.T.reshape(-1)[:n]


@dataclass
class Field:
    """Weights of forms, transitions (log, from-to) and start odds (log)."""

    weight: np.ndarray
    bias: float
    trans: np.ndarray
    start: float
    head: np.ndarray

    def chains(self, s: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward odds and backward odds of the toxic tag; ``first``: the word starts a text."""
        e, A, n = np.exp(np.clip(s, -30, 30)), np.exp(self.trans), len(s)
        ahead = _run(np.where(first, 0, e * A[1, 1]), e * np.where(first, np.exp(self.start), A[0, 1]), np.where(first, 0, A[1, 0]), np.where(first, 1, A[0, 0]), 1.0)
        # what stands after word t-1 as a function of what stands after word t
        e, f = e[::-1], first[::-1]
        back = _run(np.where(f, 0, A[1, 1] * e), np.where(f, 1, A[1, 0]), np.where(f, 0, A[0, 1] * e), np.where(f, 1, A[0, 0]), 1.0)
        after = np.ones(n)
        after[:-1] = back[: n - 1][::-1]
        return ahead, after

    def marginals(self, s: np.ndarray, first: np.ndarray) -> np.ndarray:
        ahead, after = self.chains(s, first)
        odds = ahead * after
        return odds / (1 + odds)

    def word_score(self, word: bytes) -> float:
        return float(self.weight[_slots(word)].sum()) + self.bias


def document_features(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """(1, logit of the largest marginal, log of 1 + expected toxic words) of n documents."""
    top, mass = np.full(n, 1e-4), np.zeros(n)
    np.maximum.at(top, doc, np.clip(p, 1e-4, 1 - 1e-4))
    np.add.at(mass, doc, p)
    return np.stack([np.ones(n), np.log(top / (1 - top)), np.log1p(mass)], 1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 0.5)
    ridge[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def _distinct(docs: list[tuple[list[bytes], int]]) -> list[tuple[list[bytes], int]]:
    """Without near copies of documents before: they would make chance words look like seeds."""
    seen: set[int] = set()
    out = []
    for words, y in docs:
        sketch = sorted({crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))})[:8]
        if sum(x in seen for x in sketch) * 2 <= len(sketch):
            out.append((words, y))
            seen.update(sketch)
    return out


class Lexicon:
    """Numbers of the distinct words of some documents, and of their forms."""

    def __init__(self, docs: list[list[bytes]]):
        self.words: dict[bytes, int] = {}
        self.docs = [np.fromiter((self.words.setdefault(w, len(self.words)) for w in words), np.int32, len(words)) for words in docs]
        names: dict[bytes, int] = {}
        of = [[names.setdefault(f, len(names)) for f in forms(w)] for w in self.words]
        self.names = list(names)
        self.size = np.array([len(x) for x in of], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.form = np.fromiter((f for x in of for f in x), np.int32, int(self.size.sum()))

    def forms_of(self, words: np.ndarray) -> np.ndarray:
        """Distinct forms of words by number."""
        n = self.size[words]
        return np.unique(self.form[np.repeat(self.start[words] - np.cumsum(n) + n, n) + np.arange(n.sum())])


def seeds(lexicon: Lexicon, labels: list[int]) -> np.ndarray:
    """Whether each form is a seed; toxic documents without any are looked at again by themselves, until they give no more."""
    sets = [lexicon.forms_of(np.unique(d)) for d in lexicon.docs]
    n_forms = len(lexicon.names)
    count = lambda some: np.bincount(np.concatenate(some), minlength=n_forms) if some else np.zeros(n_forms, np.int64)
    clean = count([x for x, y in zip(sets, labels, strict=True) if not y])
    left, quiet = [x for x, y in zip(sets, labels, strict=True) if y], labels.count(0)
    found, least = np.zeros(n_forms, bool), SEED_LLR
    while left:
        share, k = len(left) / (len(left) + quiet), count(left)
        r = k / np.maximum(1, k + clean)
        llr = k * np.log(np.maximum(r, 1e-9) / share) + clean * np.log(np.maximum(1 - r, 1e-9) / (1 - share))
        new = (k > 0) & (r >= SEED_SHARE) & (llr >= least)
        if not new.any():
            break
        found |= new
        left, least = [x for x in left if not new[x].any()], LATER_LLR
    return found


def _parts(sizes: np.ndarray, most: int = 200_000) -> list[slice]:
    """Stretches of whole documents of about ``most`` words."""
    ends = np.cumsum(sizes)
    cut = [0, *[int(ends[i]) for i in range(len(ends)) if i + 1 == len(ends) or ends[i] // most != ends[i + 1] // most]]
    return [slice(a, b) for a, b in zip(cut, cut[1:], strict=False)]


def _gradient(field: Field, s: np.ndarray, y: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradients of the log-likelihood: by word, by transition, of the start."""
    ahead, after = field.chains(s, first)
    p = ahead * after
    p /= 1 + p
    before = np.nonzero(~first[1:])[0]
    A = np.exp(field.trans)
    r, b, e = ahead[before], after[before + 1], np.exp(np.clip(s[before + 1], -30, 30))
    xi = np.stack([np.full(len(r), A[0, 0]), A[0, 1] * e * b, A[1, 0] * r, A[1, 1] * r * e * b])
    seen = np.bincount((2 * y[before] + y[before + 1]).astype(int), minlength=4)
    return y - p, seen - (xi / xi.sum(0)).sum(1), float((y - p)[first].sum())


def train(sample: list[tuple[bytes, int]]) -> Field | None:
    docs = [(words_of(t), y) for t, y in sample]
    docs = [(w, y) for w, y in docs if w]
    unlike = _distinct(docs)
    if len({y for _, y in unlike}) < 2:
        return None
    lexicon = Lexicon([w for w, _ in unlike])
    found = seeds(lexicon, [y for _, y in unlike])
    ids, flat = lexicon.words, np.concatenate(lexicon.docs)
    sizes, labels = np.array([len(w) for w, _ in unlike]), np.array([y for _, y in unlike])
    del docs, unlike
    first = np.zeros(len(flat), bool)
    first[np.cumsum(sizes) - sizes] = True
    of_toxic = np.repeat(labels, sizes)
    seeded = np.add.reduceat(found[lexicon.form], lexicon.start) > 0
    y = (seeded[flat] & (of_toxic == 1)).astype(float)
    word_at = np.repeat(np.arange(len(ids), dtype=np.int32), lexicon.size)
    slots = np.fromiter((crc32(f) % FORMS for f in lexicon.names), np.int32, len(lexicon.names))
    used, slot_at = np.unique(slots[lexicon.form], return_inverse=True)
    params = np.zeros(len(used) + 6)  # weights, bias, transitions, start
    m, v = np.zeros_like(params), np.zeros_like(params)
    params[len(used)] = -3.0
    field = Field(np.zeros(FORMS, np.float32), 0.0, np.zeros((2, 2)), 0.0, np.zeros(3))
    parts = _parts(sizes)
    for step in range(1, STEPS + 1):
        w, bias = params[: len(used)], params[len(used)]
        field.trans, field.start = params[len(used) + 1 : -1].reshape(2, 2), params[-1]
        score = np.bincount(word_at, w[slot_at], len(ids)) + bias
        g, pairs, at_start = np.zeros(len(ids)), np.zeros(4), 0.0
        for part in parts:
            more = _gradient(field, score[flat[part]], y[part], first[part])
            g += np.bincount(flat[part], more[0], len(ids))
            pairs, at_start = pairs + more[1], at_start + more[2]
        grad = np.concatenate([np.bincount(slot_at, g[word_at], len(used)) - 0.1 * w, [g.sum()], pairs - field.trans.ravel(), [at_start - field.start]])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        params = params + 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    field.weight[used] = params[: len(used)]
    field.bias, field.trans, field.start = float(params[len(used)]), params[len(used) + 1 : -1].reshape(2, 2).copy(), float(params[-1])
    score = np.array([field.word_score(w) for w in ids])
    p = np.concatenate([field.marginals(score[flat[part]], first[part]) for part in parts])
    x = document_features(p, np.repeat(np.arange(len(sizes)), sizes), len(sizes))
    field.head = _logistic(x, labels.astype(float))
    return field


def sample(docs: DataFrame, labels: DataFrame) -> list[tuple[bytes, int]]:
    """Texts and labels of at most TOXIC + CLEAN labelled documents, first by a hash of the id."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~common.held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("_y"))
    pick = lambda y, n: known.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = pick(1, TOXIC).unionByName(pick(0, CLEAN))
    texts = docs.where(F.octet_length("text") <= SAMPLE_BYTES).select("doc_id", common.utf8("text").alias("_bytes"))
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "_y").agg(F.min("_bytes").alias("_bytes")).collect()  # ids: at most TOXIC + CLEAN rows
    return [(bytes(r["_bytes"]), int(r["_y"])) for r in sorted(rows, key=lambda r: r["doc_id"])]


def fit(docs: DataFrame, labels: DataFrame) -> Field | None:
    return train(sample(docs, labels))


def _spans(text: bytes, toxic: np.ndarray) -> list[tuple[int, int]]:
    """Code point ranges of the words at the given places."""
    out, want, last, chars = [], set(toxic.tolist()), 0, 0
    for i, m in enumerate(_TOKEN.finditer(text)):
        if i in want:
            chars += len(text[last : m.start()].decode("utf-8", "replace"))
            size = len(m[0].decode("utf-8", "replace"))
            out.append((chars, chars + size))
            chars, last = chars + size, m.end()
    return out


def score(docs: DataFrame, field: Field | None) -> DataFrame:
    """Adds score and spans (code point ranges of toxic words) to ``docs``."""
    docs = docs.drop("score", "spans")
    names, own = docs.columns, common.spare(docs, "_bytes")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}
        for b in common.slices(batches):
            texts = [x or b"" for x in b.column(own).to_pylist()]
            n = len(texts)
            scores, spans = np.zeros(n), [[] for _ in range(n)]
            if field is not None and n:
                if len(known) > CACHE:
                    known.clear()
                s: list[float] = []
                sizes = np.zeros(n, np.int64)
                for i, t in enumerate(texts):
                    words = words_of(t)
                    sizes[i] = len(words)
                    for w in set(words):
                        if w not in known:
                            known[w] = field.word_score(w)
                    s += map(known.__getitem__, words)
                first = np.zeros(len(s), bool)
                at = np.cumsum(sizes) - sizes
                first[at[sizes > 0]] = True
                p = field.marginals(np.array(s), first)
                doc = np.repeat(np.arange(n), sizes)
                z = document_features(p, doc, n) @ field.head
                scores = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                toxic = np.nonzero(p > 0.5)[0]
                for d in np.unique(doc[toxic]):
                    spans[d] = [{"start": x, "end": y} for x, y in _spans(texts[d], toxic[doc[toxic] == d] - at[d])]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(scores), pa.array(spans, span_type)], names=[*names, "score", "spans"])

    return docs.withColumn(own, common.utf8("text")).mapInArrow(run, schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    x = score(docs, fit(docs, common.read_table(spark, sf_dir, "labels")))
    return x.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
