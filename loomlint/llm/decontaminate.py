"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are windows of 13 consecutive words of the benchmark items (an
item of fewer words is one window). Letters of the alphabet are words: every
word of a pattern has a small integer, every other word is 0. Patterns of one
length form one search with

- a shift table over hashed blocks of two words: how far a search position
  may move on when the block that ends there is seen,
- buckets of patterns by the hash of their last block, looked into only where
  the shift is 0, with the first block's hash as a second filter,
- a direct word-by-word comparison with every pattern left.

Many places of a batch move at once: the words of a batch lie in one array,
and each stretch of ``LANE`` words is searched from its own first place.

Benchmark text is compiled in blocks of ``BLOCK_BYTES`` (and one item at
most over it): one array of word numbers, the places where windows start, and
whose they are. A compiled block is broadcast; its size is bounded by the
block's, about 40 bytes a word and 150 a distinct word. A benchmark of one
block, the usual case, takes one pass over the documents and no shuffle. A
larger one takes a pass a block, one after the other, over documents written
with a row number; a pass writes only the rows that are hit, and its broadcast
is destroyed before the next block is compiled. So no worker ever holds more
than one block, however large the benchmark is.

Defined results: null or empty texts have no words and are never
contaminated; items without words have no window; items with a null id mark
words but aren't counted or listed; items repeated under one id count once;
overlapping and repeated occurrences mark a word once; an empty table, of
documents or of benchmark items, gives no hits; columns of ``docs`` named like
an output column are replaced, others stay, whatever their names; documents of
any length are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import windows
from . import common

WINDOW = 13
LANE = 256
#: Slots of a shift table, one byte each.
TABLE = 1 << 20
#: Benchmark text that is compiled and broadcast at a time.
BLOCK_BYTES = 8 << 20
#: Words as SQL functions count them.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Lower-cases A-Z and turns every byte that isn't part of a word into a space.
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(44)).astype(np.int64)


class Searcher:
    """Wu-Manber tables for windows of ``m`` words that start at ``starts`` of ``flat``."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, m: int):
        self.flat, self.starts, self.m = flat, starts, m
        self.span = min(2, m)
        self.shift = np.full(TABLE, m - self.span + 1, np.int8)
        for end in range(self.span - 1, m):
            np.minimum.at(self.shift, self.block(end), np.int8(m - 1 - end))
        key = self.key(self.block(m - 1), self.block(self.span - 1))
        self.order = np.argsort(key, kind="stable").astype(np.int32)
        self.keys = key[self.order]

    def block(self, end: int) -> np.ndarray:
        return _block(self.flat[self.starts + end - self.span + 1], self.flat[self.starts + end])

    @staticmethod
    def key(suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        return suffix * TABLE + prefix

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last places and numbers of the windows that occur in ``text``; -1 in it matches nothing."""
        ends, found = [], []
        at = np.arange(self.m - 1, len(text), LANE, dtype=np.int64)
        stop = np.minimum(at + LANE, len(text))
        while len(at):
            step = self.shift[_block(text[at - self.span + 1], text[at])]
            hit = at[step == 0]
            if len(hit):
                first = hit - self.m + 1
                key = self.key(_block(text[hit - self.span + 1], text[hit]), _block(text[first], text[first + self.span - 1]))
                lo, hi = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
                many = hi - lo
                e, c = np.repeat(hit, many), self.order[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())]
                same = np.ones(len(e), bool)
                for i in range(self.m):
                    same[same] = text[e[same] - self.m + 1 + i] == self.flat[self.starts[c[same]] + i]
                ends.append(e[same])
                found.append(c[same])
            at = at + np.maximum(step, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return (np.concatenate(ends), np.concatenate(found)) if ends else (np.zeros(0, np.int64), np.zeros(0, np.int32))


@dataclass
class Owners:
    """Item numbers of window ``c``: items[first[c] : first[c + 1]]."""

    first: np.ndarray
    items: np.ndarray


@dataclass
class Tables:
    """A compiled block of the benchmark."""

    vocab: dict[bytes, int]
    names: list[str]
    searchers: list[tuple[Searcher, Owners]]


def _windows(flat: np.ndarray, starts: np.ndarray, item: np.ndarray, m: int) -> tuple[np.ndarray, Owners]:
    """The distinct windows and their items."""
    h = np.zeros(len(starts), np.uint64)
    for i in range(m):
        h = h * np.uint64(0x9E3779B97F4A7C15) + flat[starts + i].astype(np.uint64)
    order = np.lexsort((item, h))
    starts, item, h = starts[order], item[order], h[order]
    # neighbours of equal hash are compared word by word
    new = np.ones(len(starts), bool)
    new[1:] = h[1:] != h[:-1]
    for i in range(m):
        new[1:] |= flat[starts[1:] + i] != flat[starts[:-1] + i]
    first = np.append(np.nonzero(new)[0], len(starts)).astype(np.int32)
    return starts[new], Owners(first, item)


def compile_items(items: list[tuple[str | None, bytes]]) -> Tables:
    """The tables of (id, text) items."""
    vocab: dict[bytes, int] = {}
    numbers: dict[str, int] = {}
    parts, sizes, who = [], [], []
    for item, text in items:
        words = words_of(text)
        parts.append(np.fromiter((vocab.setdefault(w, len(vocab) + 1) for w in words), np.int32, len(words)))
        sizes.append(len(words))
        who.append(-1 if item is None else numbers.setdefault(item, len(numbers)))
    flat = np.concatenate([np.zeros(0, np.int32), *parts])
    size, number = np.array(sizes, np.int64), np.array(who, np.int32)
    begin, m = np.cumsum(size) - size, np.minimum(size, WINDOW)
    searchers = []
    for length in sorted({*m.tolist()} - {0}):
        of = m == length
        many = size[of] - length + 1
        starts = np.repeat(begin[of] - np.cumsum(many) + many, many) + np.arange(many.sum())
        starts, owners = _windows(flat, starts.astype(np.int32), np.repeat(number[of], many), length)
        searchers.append((Searcher(flat, starts, length), owners))
    return Tables(vocab, list(numbers), searchers)


def search_batch(texts: list[bytes], tables: Tables) -> Iterator[tuple[int, list[tuple[int, int]], set[str], int]]:
    """(number of words, merged word ranges that are hit, ids of items, words of the longest window found) of each text."""
    ids, sizes, get = [-1], [], tables.vocab.get
    for t in texts:
        words = words_of(t)
        sizes.append(len(words))
        ids += [get(w, 0) for w in words]
        ids.append(-1)
    flat = np.array(ids, np.int64)
    start = np.cumsum([1] + [n + 1 for n in sizes[:-1]]) if sizes else np.zeros(0, np.int64)
    ranges: dict[int, list] = {}
    items: dict[int, set] = {}
    longest: dict[int, int] = {}
    for s, owners in tables.searchers:
        if len(flat) < s.m:
            continue
        ends, found = s.search(flat)
        doc = np.searchsorted(start, ends, "right") - 1
        for d, e, c in zip(doc.tolist(), (ends - start[doc]).tolist(), found.tolist(), strict=True):
            ranges.setdefault(d, []).append((e - s.m + 1, e + 1))
            items.setdefault(d, set()).update(tables.names[i] for i in owners.items[owners.first[c] : owners.first[c + 1]].tolist() if i >= 0)
            longest[d] = max(s.m, longest.get(d, 0))
    for d, n in enumerate(sizes):
        yield n, _merge(ranges.get(d, [])), items.get(d, set()), longest.get(d, 0)


_RANGES = pa.list_(pa.list_(pa.int64()))


def _merge(ranges: list) -> list[list[int]]:
    out: list[list[int]] = []
    for x, y in sorted(map(tuple, ranges)):
        if out and x <= out[-1][1]:
            out[-1][1] = max(y, out[-1][1])
        else:
            out.append([x, y])
    return out


def _pass(df: DataFrame, tables, text: str, hits_only: bool = False) -> DataFrame:
    """Search ``df`` for a broadcast block: its other columns, n_words, hit_ranges, items and longest."""
    names = [c for c in df.columns if c != text]
    added = [("n_words", pa.int64()), ("hit_ranges", _RANGES), ("items", pa.list_(pa.string())), ("longest", pa.int64())]
    extra = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_ranges", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            rows = [(n, r, sorted(i), m) for n, r, i, m in search_batch([x or b"" for x in b.column(text).to_pylist()], tables.value)]
            cols = list(zip(*rows, strict=True)) or [[]] * len(added)
            out = pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *[pa.array(c, k) for c, (_, k) in zip(cols, added, strict=True)]], names=[*names, *[n for n, _ in added]])
            yield out.filter(pc.greater(out.column("longest"), 0)) if hits_only else out

    return df.mapInArrow(run, T.StructType([*[df.schema[c] for c in names], *extra.fields]))


def _items(bench: DataFrame) -> list[tuple[str | None, bytes]]:
    return [(r["_id"], bytes(r["_text"])) for r in bench.select("_id", "_text").distinct().collect()]


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.set_column(b.schema.get_field_index("hit_ranges"), "hit_ranges", pa.array([_merge(r) for r in b.column("hit_ranges").to_pylist()], _RANGES))


def _in_blocks(docs: DataFrame, bench: DataFrame, text: str) -> DataFrame:
    """A pass for each block of ``bench`` in turn, over numbered rows."""
    spark = docs.sparkSession
    row = common.spare(docs, "_row")
    rows = common.save(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate-rows")
    placed = windows.numbered(bench.distinct().withColumn("_n", F.octet_length("_text").cast("long")), [F.xxhash64("_id", "_text"), F.col("_id"), F.col("_text")], ("_n",))
    blocks = common.save(placed.select("_id", "_text", F.floor(F.col("before__n") / BLOCK_BYTES).cast("long").alias("_block")), "benchmark-blocks")
    found = []
    for block in range(blocks.agg(F.max("_block")).first()[0] + 1):
        tables = spark.sparkContext.broadcast(compile_items(_items(blocks.where(F.col("_block") == block))))
        found.append(common.save(_pass(rows.select(F.col(row).alias("_row"), common.utf8(text).alias("_bytes")), tables, "_bytes", True).drop("n_words"), "decontaminate-hits"))
        tables.destroy()
    # a row has at most one list a block
    hits = reduce(DataFrame.unionByName, found).groupBy("_row").agg(
        F.flatten(F.collect_list("hit_ranges")).alias("hit_ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest")
    )
    hits = hits.mapInArrow(_union, hits.schema).withColumnRenamed("_row", "_hit_row")
    x = rows.select(F.struct(*rows.columns).alias("d")).join(hits, F.col(f"d.`{row}`") == F.col("_hit_row"), "left")
    return x.select(
        *[F.col(f"d.`{c}`").alias(c) for c in docs.columns], F.regexp_count(F.coalesce(F.col(f"d.`{text}`"), F.lit("")), F.lit(WORD)).cast("long").alias("n_words"),
        F.coalesce("hit_ranges", F.array().cast("array<array<bigint>>")).alias("hit_ranges"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("longest", F.lit(0)).cast("long").alias("longest"),
    )


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, n_hit, hit_ranges (word places, end exclusive), items, longest (words of the longest window found) and contaminated to ``docs``."""
    docs = docs.drop("n_words", "n_hit", "hit_ranges", "items", "longest", "contaminated")
    bench = benchmark.select(F.col("item_id").cast("string").alias("_id"), common.utf8("text").alias("_text"))
    if (bench.agg(F.sum(F.octet_length("_text"))).first()[0] or 0) <= BLOCK_BYTES:
        raw = common.spare(docs, "_bytes")
        x = _pass(docs.withColumn(raw, common.utf8(text)), docs.sparkSession.sparkContext.broadcast(compile_items(_items(bench))), raw)
    else:
        x = _in_blocks(docs, bench, text)
    x = x.withColumn("n_hit", F.aggregate("hit_ranges", F.lit(0).cast("long"), lambda s, r: s + r[1] - r[0]))
    return x.select(*docs.columns, "n_words", "n_hit", "hit_ranges", "items", "longest", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    x = find(docs, common.read_table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256)
    return x.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")
