"""SimHash near-duplicate classes: BK-trees over fingerprints, linked within a radius.

1. A document's fingerprint is the strict bit majority of the XXH64 values
   (seed 42) of its 3-word shingles.
2. Equal fingerprints are one node. Of k bit blocks, two fingerprints within
   ``RADIUS`` bits agree on k - ``RADIUS`` at least, so nodes are dealt to shards
   by every choice of so many blocks and their values, and only meet inside
   shards. Nodes are dealt by the blocks of ``BLOCKS[0]`` first; those of shards of
   more than ``SHARD`` nodes are dealt anew by the next, finer blocks (a pair that
   met in such a shard meets again, since both nodes are dealt anew), so a
   shard's size doesn't grow with the corpus unless its fingerprints are alike.
3. In a shard nodes go into a BK-tree: children are keyed by their integer
   Hamming distance to the parent, and a look-up follows only edges within
   the radius of its own distance. A subtree whose nodes are already linked
   to the node looked up needs no look-up, so dense groups cost about what
   they have nodes. A shard gives a forest of links, not all pairs.
4. A shard that is still larger after the finest blocks is several trees of
   about ``SHARD`` nodes; its nodes look into their own tree and the later ones. Trees are
   shipped to the tasks by shuffle: their number grows with the corpus, so
   they can't be broadcast within a bound.
5. Links become components by alternating large-star and small-star steps,
   each written to the shared folder. Joins spread hot fingerprints and hot
   nodes over salted keys.

Defined results: null and empty texts, and texts without a word, have
fingerprint 0, which links like any other; texts of one or two words are one
shingle; equal texts share a fingerprint; null ids are never the smallest id
of a component that has another, and a component of null ids only has a null
component_id; repeated rows stay; an empty table gives an empty result; texts of
any length are read whole; ``dedup`` reads doc_id and text only, and
``near_duplicates`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from . import common

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Nodes of a tree.
SHARD = 20_000
#: Keys (an id and a hash, some 60 MB in all) that may be broadcast.
BROADCAST_KEYS = 500_000
#: Numbers of bit blocks, coarse to fine: shards of 16, then of about 32 bits.
BLOCKS = (4, 6)
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(text: bytes) -> int:
    """Unsigned fingerprint of a UTF-8 text."""
    w = text.translate(_LOWER).split()
    if not w:
        return 0
    if len(w) < SHINGLE:
        return xxh64_intdigest(b" ".join(w), SEED)
    h = np.array([xxh64_intdigest(b" ".join(s), SEED) for s in zip(w, w[1:], w[2:], strict=False)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and fp, the fingerprint as a signed integer."""
    texts = docs.select(*keep, common.utf8("text").alias("_bytes"))
    names = texts.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            fp = np.array([fingerprint(x or b"") for x in b.column("_bytes").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(fp)], names=[*names, "fp"])

    return texts.mapInArrow(run, texts.select(*names, F.lit(0).cast("long").alias("fp")).schema)


class Tree:
    """A BK-tree that links each node it gets to what is within the radius."""

    def __init__(self) -> None:
        self.value: list[int] = []
        self.children: list[dict[int, int]] = []
        #: A node of the one component that the subtree is in, or -1.
        self.one: list[int] = []
        self.up: list[int] = []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def near(self, x: int, mine: int = -1, linked: set[int] | None = None) -> list[int]:
        """Nodes within the radius of x, one at least of each component that has any."""
        if not self.value:
            return []
        out, linked, todo = [], set() if linked is None else linked, [0]
        value, children, one, root = self.value, self.children, self.one, self.root
        while todo:
            i = todo.pop()
            if linked and one[i] >= 0 and root(one[i]) in linked:
                continue
            d = (value[i] ^ x).bit_count()
            if d <= RADIUS and (r := root(i)) not in linked:
                out.append(i)
                linked.add(r)
            for k, c in children[i].items():
                if d - RADIUS <= k <= d + RADIUS:
                    todo.append(c)
        return out

    def add(self, x: int) -> list[int]:
        """Insert x; the values it links to."""
        found, new = self.near(x), len(self.value)
        self.up.append(new)
        for i in found:
            self.up[self.root(i)] = new
        if self.value:
            i = 0
            while True:
                if self.one[i] >= 0 and self.root(self.one[i]) != self.root(new):
                    self.one[i] = -1
                d = (self.value[i] ^ x).bit_count()
                if d not in self.children[i]:
                    self.children[i][d] = new
                    break
                i = self.children[i][d]
        self.value.append(x)
        self.children.append({})
        self.one.append(new)
        return [self.value[i] for i in found]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, query, fp), sorted: the forest of links of each shard's tree."""
    mask = (1 << 64) - 1

    def rows():
        for b in batches:
            yield from zip(b.column("shard").to_pylist(), b.column("query").to_pylist(), b.column("fp").to_pylist(), strict=True)

    a: list[int] = []
    c: list[int] = []
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for _, group in groupby(rows(), key=lambda r: r[0]):
        tree = Tree()
        for _, query, fp in group:
            x = fp & mask
            for y in [tree.value[i] for i in tree.near(x)] if query else tree.add(x):
                a.append(signed(x))
                c.append(signed(y))
        if len(a) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], schema=schema)
            a, c = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], schema=schema)


def _parts(k: int) -> Column:
    """The choices of k - RADIUS of k bit blocks: hashes of their places and values."""
    edge = [64 * i // k for i in range(k + 1)]
    block = [F.shiftrightunsigned("fp", edge[i]).bitwiseAND(F.lit((1 << (edge[i + 1] - edge[i])) - 1)) for i in range(k)]
    return F.array(*[F.xxhash64(F.lit(n), *[block[i] for i in chosen]) for n, chosen in enumerate(combinations(range(k), k - RADIUS))])


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between distinct values ``fp`` that join whatever the radius joins."""
    shards, left = [], nodes.select("fp")
    for level, k in enumerate(BLOCKS):
        dealt = left.select("fp", F.explode(_parts(k)).alias("part"))
        sizes = common.save(dealt.groupBy("part").count().where("count > 1"), "shards")
        last = level == len(BLOCKS) - 1
        fine = sizes if last else sizes.where(F.col("count") <= SHARD)
        x = dealt.join(fine.select("part", F.ceil(F.col("count") / SHARD).cast("int").alias("trees")), "part")
        shards.append(x.select("fp", F.concat(F.lit(f"{k}:"), "part").alias("part"), "trees"))
        large = sizes.where(F.col("count") > SHARD)
        if last or large.isEmpty():
            break
        left = common.save(common.salted_join(dealt, large.select("part"), "part", F.col("fp"), "left_semi").select("fp").distinct(), "large-shards")
    x = reduce(DataFrame.unionByName, shards)
    own = F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")
    x = x.select("fp", "part", own.alias("own"), F.explode(F.sequence(own, F.col("trees") - 1)).alias("tree"))
    x = x.select(F.concat_ws(":", "part", "tree").alias("shard"), (F.col("own") != F.col("tree")).alias("query"), "fp")
    return x.repartition("shard").sortWithinPartitions("shard", "query", "fp").mapInArrow(_links, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of the component."""
    e = common.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    def to_least(x: DataFrame, size: int) -> DataFrame:
        """Rows (a, b, m): m is the least neighbour of a, or a itself."""
        least = common.save(x.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "least")
        made.append(least)
        return common.hot_join(x, least, "a", "n", size)

    was = state(e)
    while was[0]:
        made: list[DataFrame] = [e]
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = to_least(both, 2 * was[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = common.save(large.where("a <> b"), "large-star")
        made.append(large)
        small = to_least(large, was[0]).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = common.save(small.where("a <> b").distinct(), "small-star")
        now = state(new)
        common.discard(*made)
        e = new
        if now == was:
            break
        was = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def hexed(fp) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _classes(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """Columns ``keep`` of ``docs``, fp, component_id and root, the fingerprint that stands for the class."""
    marked = common.save(fingerprints(docs, keep), "fingerprints")
    nodes = common.save(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    found = components(links(nodes.select("fp")))
    roots = common.save(found, "roots")
    common.discard(found)
    rooted = common.save(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    ids = common.save(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("_fps"), F.sum("n").alias("_rows")), "ids")
    sums = ids.agg(F.sum("_fps"), F.sum("_rows")).first()
    named = common.hot_join(rooted, ids.drop("_rows"), "root", "_fps", sums[0] or 0)
    named = common.save(named.select("fp", "root", "component_id", "n"), "components")
    common.discard(nodes, roots, rooted, ids)
    return common.hot_join(marked, named, "fp", "n", sums[1] or 0)


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id, class): class is the same for all rows of a component."""
    return _classes(docs, [F.col("doc_id")]).select("doc_id", hexed("fp").alias("fingerprint"), "component_id", hexed("root").alias("class"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each class of ``docs``: of the rows of the smallest id, null ids last, the first by a hash of the whole row.

    Rows are told apart by id and a hash of all columns, never by id alone, so
    an id that two classes share loses neither. Only ids and hashes are
    shuffled to choose. The chosen keys are broadcast while there are
    ``BROADCAST_KEYS`` at most; more of them meet the whole rows in a shuffle.
    """
    whole = [F.col(f"`{c}`") for c in docs.columns]
    row = F.xxhash64(*[F.to_json(c) if isinstance(docs.schema[n].dataType, (T.MapType, T.VariantType)) else c for n, c in zip(docs.columns, whole, strict=True)])
    marked = _classes(docs, [F.col("doc_id"), row.alias("_hash")])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_hash")).alias("f")
    chosen = common.save(marked.groupBy("root").agg(first).select(F.col("f.doc_id").alias("_id"), F.col("f._hash").alias("_few")), "chosen")
    repeated = not marked.groupBy("doc_id", "_hash").count().where("count > 1").isEmpty()
    key = common.spare(docs, "_hash")
    few = chosen if chosen.count() > BROADCAST_KEYS else F.broadcast(chosen)
    kept = docs.withColumn(key, row).join(few, (F.col(key) == F.col("_few")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    # rows that are equal in all columns have one key; most tables have none
    return (kept.dropDuplicates(["doc_id", key]) if repeated else kept).drop(key)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    return dedup(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"))
