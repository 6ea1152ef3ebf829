"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio of trusted to raw text.

Words and word pairs are hashed into ``BUCKETS``. The raw multinomial counts
every document; the trusted one counts every document labelled of good
quality. A document's score is the mean over its n-grams of
log(p_trusted / p_raw), so length doesn't matter.

The threshold is fixed once from every labelled document that passes the base rules, whole, each scored with its
own counts taken out: it is the score that best separates good from bad (midway between its neighbours), but never
more than the ``SPARE`` quantile of the good ones, so that good documents stay. Then every document is decided by the
same comparison. Without labels of bad documents the quantile alone decides;
without trusted documents the method keeps everything. A document labelled both ways is trusted and counts as good and as bad.

Both counts are taken in one pass and cross the network as at most ``BUCKETS`` rows a task. The ids labelled good
are broadcast while there are ``BROADCAST_IDS`` at most (some 17 MB); more of them meet the texts in a shuffle by id, with
the same counts. Labelled documents are scored for the threshold where they lie: their ids are broadcast within the same
bound; beyond it every document with an id is scored, and only ids and scores are shuffled to meet the labels. Scores are
ranked by range partitions plus offsets, so the driver gets a few rows however many labels there are. Verdicts are map only.

Defined results: null and empty texts have no words, fail the base rules and
aren't kept; repeated rows and ties get equal verdicts; ids that are null are
never trusted; an empty table gives an empty result; texts of any length are
read whole; columns named like an output column are replaced, others stay,
whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import windows
from . import common

#: As many hash buckets as the published importance-resampling recipe uses.
BUCKETS = 10_000
#: Ids that may be broadcast.
BROADCAST_IDS = 250_000
SPARE = 0.01
SMOOTH = 1.0
MIN_WORDS = 50
MAX_REPEATED = 0.5
_SYMBOLS = b"#*$%&|<>"
#: White space and UTF-8 continuation bytes: what is left are code points of words.
_NOT_WORD = bytes([9, 10, 11, 12, 13, 32, *range(0x80, 0xC0)])


def base_counts(text: bytes) -> tuple[int, int, int, int, int, list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the words of a UTF-8 text."""
    words = text.split()
    n = len(words)
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    repeat = 0
    if n > 2:
        grams = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(grams)) < len(grams):
            many = Counter(grams)
            upto = 0
            for i, g in enumerate(grams):
                if many[g] > 1:
                    repeat += i + 3 - max(i, upto)
                    upto = i + 3
    return n, len(text.translate(None, _NOT_WORD)), len(text) - len(text.translate(None, _SYMBOLS)), dup, repeat, words


def grams(words: list[bytes]) -> np.ndarray:
    """Buckets of the words and of the pairs of neighbours."""
    h = np.fromiter(map(crc32, words), np.uint64, len(words))
    pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)
    return (np.concatenate([h, pair]) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Model:
    weight: np.ndarray
    threshold: float

    def score(self, buckets: np.ndarray) -> float:
        return float(self.weight[buckets].mean()) if len(buckets) else 0.0


def _weights(trusted: np.ndarray, raw: np.ndarray) -> np.ndarray:
    p = (trusted + SMOOTH) / (trusted.sum() + SMOOTH * BUCKETS)
    q = (raw + SMOOTH) / (raw.sum() + SMOOTH * BUCKETS)
    return np.log(p / q)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, BUCKETS), np.int64)
    for b in common.slices(batches):
        for text, good in zip(b.column("_bytes").to_pylist(), b.column("_good").to_pylist(), strict=True):
            n = np.bincount(grams((text or b"").split()), minlength=BUCKETS)
            total[0] += n
            if good:
                total[1] += n
    at = np.nonzero(total[0])[0]
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], names=["bucket", "raw", "trusted"])


def _counted(texts: DataFrame, good: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket occurs in all ``texts``, and in those of the distinct ids ``good``."""
    ids = good.withColumn("_good", F.lit(True))
    if ids.count() <= BROADCAST_IDS:
        marked = texts.join(F.broadcast(ids), "doc_id", "left")
    else:  # rows without an id are good for nothing, and stay out of the shuffle
        marked = texts.where("doc_id is not null").join(ids.hint("shuffle_hash"), "doc_id", "left")
        marked = marked.unionByName(texts.where("doc_id is null").withColumn("_good", F.lit(None).cast("boolean")))
    rows = marked.select("_bytes", "_good").mapInArrow(_count, "bucket bigint, raw bigint, trusted bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).collect()
    out = np.zeros((2, BUCKETS))
    for r in rows:
        out[:, r["bucket"]] = r["raw"], r["trusted"]
    return out[0], out[1]


def _apart(texts: DataFrame, raw: np.ndarray, trusted: np.ndarray) -> DataFrame:
    """(doc_id, if_trusted, if_not) of the documents that pass the base rules: scores with own counts taken out, of ``trusted`` too or not."""
    all_t, all_r = trusted.sum() + SMOOTH * BUCKETS, raw.sum() + SMOOTH * BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            at, scores = [], []
            for i, text in enumerate(b.column("_bytes").to_pylist()):
                n, _, _, _, repeat, words = base_counts(text)
                if n < MIN_WORDS or repeat > MAX_REPEATED * n:
                    continue
                own = np.bincount(grams(words), minlength=BUCKETS)
                k = np.nonzero(own)[0]
                c, size = own[k], own.sum()
                q = (raw[k] - c + SMOOTH) / (all_r - size)
                # of documents that aren't trusted the first score means nothing, and nobody asks for it
                t = (np.maximum(trusted[k] - c, 0) + SMOOTH) / max(all_t - size, 1), (trusted[k] + SMOOTH) / all_t
                at.append(i)
                scores.append([float((c * np.log(x / q)).sum() / size) for x in t])
            cols = zip(*scores, strict=True) if scores else ([], [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), *[pa.array(c, pa.float64()) for c in cols]], names=["doc_id", "if_trusted", "if_not"])

    zero = F.lit(None).cast("double")
    return texts.select("doc_id", "_bytes").mapInArrow(run, texts.limit(0).select("doc_id", zero.alias("if_trusted"), zero.alias("if_not")).schema)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Count all documents, then set the threshold on all labelled ones."""
    with common.scope() as made:
        model = _fit(docs, labels)
    common.discard(*made)
    return model


def _fit(docs: DataFrame, labels: DataFrame) -> Model:
    texts = docs.select("doc_id", common.utf8("text").alias("_bytes"))
    given = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    given = common.save(given.groupBy("doc_id").agg(F.max("quality").alias("_good"), (1 - F.min("quality")).alias("_bad")), "labelled-ids")
    raw, trusted = _counted(texts, given.where("_good = 1").select("doc_id"))
    if not trusted.sum():
        return Model(np.zeros(BUCKETS), -np.inf)
    if given.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(given.select("doc_id")), "doc_id", "left_semi")
    own = _apart(texts.where("doc_id is not null"), raw, trusted).join(given, "doc_id")
    return Model(_weights(trusted, raw), _threshold(own.select(F.when(F.col("_good") == 1, F.col("if_trusted")).otherwise(F.col("if_not")).alias("score"), "_good", "_bad")))


def _threshold(scores: DataFrame) -> float:
    """The threshold of rows (score, _good, _bad), the last two 1 or 0."""
    # equal scores are one row, whose before_ sums are the rows of a smaller score
    each = scores.groupBy("score").agg(F.sum("_good").alias("good"), F.sum("_bad").alias("bad"))
    x = common.save(windows.numbered(each, [F.col("score")], ("good", "bad")), "thresholds")
    good, bad = x.agg(F.sum("good"), F.sum("bad")).first()
    if not good:
        return -np.inf
    rank = (good - 1) * SPARE
    near = [x.where((F.col("before_good") <= i) & (F.col("before_good") + F.col("good") > i)).first()["score"] for i in (int(rank), min(int(rank) + 1, good - 1))]
    spare = float(np.quantile(near, rank - int(rank)))
    if not bad:
        return spare
    best = x.orderBy((F.col("before_bad") / bad - F.col("before_good") / good).desc(), "score").first()
    under = x.where(F.col("place") == max(best["place"] - 1, 0)).first()
    return min(spare, (under["score"] + best["score"]) / 2)


_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds the base counts, base_failed, score and kept to ``docs``."""
    added = [*_COLUMNS, "base_failed", "score", "kept"]
    docs = docs.drop(*added)
    names, own = docs.columns, common.spare(docs, "_bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            rows = []
            for text in b.column(own).to_pylist():
                *counts, words = base_counts(text or b"")
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > 100 * MAX_REPEATED * counts[0]
                s = model.score(grams(words))
                rows.append((*counts, failed, s, not failed and s >= model.threshold))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in added]
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names + added)

    extra = ", ".join(f"{c} bigint" for c in _COLUMNS) + ", base_failed boolean, score double, kept boolean"
    schema = docs.limit(0).select("*", *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in extra.split(", ")]).schema
    return docs.withColumn(own, common.utf8("text")).mapInArrow(run, schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, common.read_table(spark, sf_dir, "labels"))
    x = score(docs, model)
    return x.select("doc_id", *_COLUMNS, "base_failed", "kept", "score")
