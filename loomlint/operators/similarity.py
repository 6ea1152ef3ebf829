"""TF-IDF and vectors, sparse and relational."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from ..functions import columns as C


def term_counts(docs: DataFrame, key: str, text: str = "text", vocab: DataFrame | None = None) -> DataFrame:
    """(key, token, n, size, first_pos): counted within a task's rows first.

    Of tokens beyond ``vocab``, a table of few rows, none is shuffled.
    """
    x = docs.select(key, C.tokens(F.col(text)).alias("_t"))
    x = x.select(key, F.size("_t").alias("size"), F.posexplode("_t").alias("pos", "token"))
    if vocab is not None:
        x = x.join(F.broadcast(vocab.select("token")), "token", "left_semi")
    return x.groupBy(key, "token").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.min("pos").alias("first_pos"))


def idf(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(token, df, idf): ln((N + 1) / (df + 1)) + 1 over distinct tokens of texts."""
    distinct = docs.select(key, F.explode(F.array_distinct(C.tokens(F.col(text)))).alias("token"))
    n = docs.agg(F.count("*").alias("_docs"))
    x = distinct.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))  # one row
    return x.select("token", "df", (F.log((F.col("_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def vocabulary(docs: DataFrame, key: str, size: int = 512, text: str = "text") -> DataFrame:
    """The ``size`` tokens of highest idf; ties by where they are first seen (key, then place)."""
    # places in the array of distinct tokens keep the order in which tokens are first seen
    seen = docs.select(key, F.posexplode(F.array_distinct(C.tokens(F.col(text)))).alias("pos", "token"))
    first = seen.groupBy("token").agg(F.min(F.struct(key, "pos")).alias("first"), F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("_docs"))
    x = first.crossJoin(F.broadcast(n)).withColumn("idf", F.log((F.col("_docs") + 1) / (F.col("df") + 1)) + 1)  # one row
    return x.orderBy(F.col("df"), "first").limit(size).select("token", "df", "idf")


def vectors(counts: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(key, token, w): term frequency times idf over vocabulary tokens, scaled to length 1."""
    x = counts.join(vocab.select("token", "idf"), "token").withColumn("w", F.col("n") / F.col("size") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return x.withColumn("w", F.col("w") / norm).select(key, "token", "w")


def sparse_cosine(a: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """(a_key, b_key, similarity) of vectors (key, token, w) with a token in common."""
    x = a.join(b.withColumnRenamed("w", "_w"), "token")
    return x.groupBy(a_key, b_key).agg(F.sum(F.col("w") * F.col("_w")).alias("similarity"))


#: Rows of a table that is broadcast at most, and cells of a matrix of patterns (80 MB); beyond, tables are joined.
BROADCAST_ROWS, DENSE_CELLS = 500_000, 10_000_000


def _multiplied(theirs: DataFrame, lengths: DataFrame, mine: DataFrame, key: str, item: str, threshold: float) -> DataFrame:
    """``recalled`` where the patterns fit one matrix: each text's weights times the rows of its tokens."""
    import numpy as np

    spark, rows = theirs.sparkSession, mine.collect()  # DENSE_CELLS at most
    names, words = sorted({r[0] for r in rows}), {w: i for i, w in enumerate(sorted({r[1] for r in rows}))}
    place, matrix = {x: i for i, x in enumerate(names)}, np.zeros((len(words), len(names)))
    for r in rows:
        matrix[words[r[1]], place[r[0]]] = r[2]
    shared = spark.sparkContext.broadcast((np.array(names, dtype="int64"), matrix))
    numbers = spark.createDataFrame(list(words.items()), "token string, _at int")
    x = theirs.join(F.broadcast(numbers), "token").groupBy(key).agg(F.collect_list("_at").alias("_at"), F.collect_list("w").alias("_w"))
    x = x.join(lengths, key).select(F.col(key).cast("long"), "_at", "_w", "norm")

    def multiply(batches):
        import pyarrow as pa

        names, matrix = shared.value
        for b in batches:
            ids, norms = b.column(0).to_pylist(), b.column(3).to_pylist()
            at, w = (b.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2))
            ends = np.concatenate([[0], np.cumsum(b.column(1).value_lengths().to_numpy())])
            found = []
            for i, (one, norm) in enumerate(zip(ids, norms, strict=True)):
                s = w[ends[i] : ends[i + 1]] @ matrix[at[ends[i] : ends[i + 1]]] / norm
                found += [(one, int(names[j]), float(s[j])) for j in np.nonzero(s >= threshold)[0]]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=[key, item, "similarity"])

    return x.mapInArrow(multiply, f"{key} long, {item} long, similarity double")


def recalled(docs: DataFrame, patterns: DataFrame, key: str, item: str, threshold: float, text: str = "text") -> DataFrame:
    """(key, item, similarity) of TF-IDF vectors over both tables' texts, at a similarity of at least ``threshold``.

    Texts are dealt by key once, so what follows is summed up within a task.
    Of a pattern, its lightest tokens that can't reach the threshold together
    make no pair; only pairs that share another one are multiplied out.
    """
    few = lambda d: F.broadcast(d) if d.count() <= BROADCAST_ROWS else d
    corpus = docs.select(F.lit(False).alias("_p"), F.col(key).alias("_id"), text).unionByName(patterns.select(F.lit(True).alias("_p"), F.col(item).alias("_id"), text))
    x = corpus.repartition("_p", "_id").select("_p", "_id", C.tokens(F.col(text)).alias("_t")).select("_p", "_id", F.size("_t").alias("size"), F.explode("_t").alias("token"))
    counts = storage.save(x.groupBy("_p", "_id", "token").agg(F.count("*").alias("n"), F.first("size").alias("size")), "counts")
    n = corpus.count()
    df = storage.save(counts.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")  # what is missing occurs once
    x = counts.join(few(df), "token", "left")
    x = x.withColumn("w", F.col("n") / F.col("size") * (F.log(F.lit(n + 1) / (F.coalesce("df", F.lit(1)) + 1)) + 1)).select("_p", "_id", "token", "w")
    norms = storage.save(x.groupBy("_p", "_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), "norms")

    mine = x.where("_p").join(norms.where("_p").select("_id", "norm"), "_id").select(F.col("_id").alias(item), "token", (F.col("w") / F.col("norm")).alias("_w"))
    light = F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(item).orderBy("_w", "token"))
    mine = storage.save(mine.withColumn("_heavy", light >= (threshold - 1e-9) ** 2), "patterns")
    theirs = x.where("not _p").select(F.col("_id").alias(key), "token", "w")
    lengths = norms.where("not _p").select(F.col("_id").alias(key), "norm")
    items, words = mine.agg(F.count_distinct(item), F.count_distinct("token")).first()
    if items * words <= DENSE_CELLS:
        return _multiplied(theirs, lengths, mine.select(item, "token", "_w"), key, item, threshold)
    pairs = storage.save(theirs.join(few(mine.where("_heavy").select(item, "token")), "token").select(key, item).distinct(), "pairs")
    shared = theirs.join(pairs, key).join(few(mine.select(item, "token", "_w")), [item, "token"])
    dots = shared.groupBy(key, item).agg(F.sum(F.col("w") * F.col("_w")).alias("_dot"))
    scaled = dots.join(lengths, key)
    return scaled.select(key, item, (F.col("_dot") / F.col("norm")).alias("similarity")).where(F.col("similarity") >= threshold)


#: Vectors in a block: 2 MB at 64 numbers each, and a product of two blocks is 32 MB at most.
BLOCK_QUERIES, BLOCK_ROWS = 1024, 4096


def vector_blocks(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(n, dim, ids, vectors): rows packed by ``size`` at most of one dimension, scaled to length 1, as bytes; null vectors are left out."""
    x = rows.select(F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v")).where("_id is not null and _v is not null")

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        held: dict[int, list] = {}  # dimension: parts (ids, matrix) of a block not full yet

        def block(dim):
            parts = held.pop(dim)
            ids, m = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            for i in range(0, len(ids), size):
                n = len(ids[i : i + size])
                yield pa.RecordBatch.from_pylist([{"n": n, "dim": dim, "ids": ids[i : i + n].tobytes(), "vectors": m[i : i + n].tobytes()}], schema=schema)

        schema = pa.schema([("n", pa.int64()), ("dim", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary())])
        for b in batches:
            ids, v = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            ends = v.offsets.to_numpy()
            lengths, flat = np.diff(ends), v.values.to_numpy(zero_copy_only=False)  # null numbers become nan
            for dim in np.unique(lengths).tolist():
                at = np.nonzero(lengths == dim)[0]
                m = flat[ends[at][:, None] + np.arange(dim)] if dim else np.empty((len(at), 0))
                norm = np.zeros(len(at))
                for c in range(dim):
                    norm += m[:, c] * m[:, c]
                norm = np.sqrt(norm)
                held.setdefault(dim, []).append((ids[at], m / np.where(norm == 0, 1.0, norm)[:, None]))  # a zero vector stays as it is
                if sum(len(p[0]) for p in held[dim]) >= size:
                    yield from block(dim)
        for dim in list(held):
            yield from block(dim)

    return x.mapInArrow(pack, "n long, dim long, ids binary, vectors binary")


def cosine_top(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, threshold: float, broadcast: bool = False) -> DataFrame:
    """The k nearest rows of each query at a similarity of at least ``threshold``.

    Queries are a stated set. Every query meets every row, so the work is the
    product of both; blocks of either meet as whole matrices, and each pair of
    blocks hands on k rows a query. Matrix products only choose: what may be
    among the k is summed up anew in one order, so that equal vectors tie.
    """
    n = rows.sparkSession.sparkContext.defaultParallelism
    q = vector_blocks(queries, key, vector, BLOCK_QUERIES).select("dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    r = vector_blocks(rows.repartition(n), key, vector, BLOCK_ROWS).select(F.col("dim").alias("r_dim"), F.col("ids").alias("r_ids"), F.col("vectors").alias("r_vectors"))
    pairs = r.crossJoin(F.broadcast(q) if broadcast else q).where("dim = r_dim").select("dim", "q_ids", "q_vectors", "r_ids", "r_vectors")
    slack = 1e-9  # far beyond what the order of a sum changes

    def meet(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for x in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                qi, ri = np.frombuffer(x["q_ids"], "int64"), np.frombuffer(x["r_ids"], "int64")
                qv, rv = np.frombuffer(x["q_vectors"]).reshape(len(qi), x["dim"]), np.frombuffer(x["r_vectors"]).reshape(len(ri), x["dim"])
                near = qv @ rv.T
                low = np.full(len(qi), threshold - slack)
                if len(ri) > k + 1:  # one more than k, since a query may be among the rows itself
                    low = np.maximum(low, np.partition(np.nan_to_num(near, nan=2.0), len(ri) - k - 1, axis=1)[:, len(ri) - k - 1] - slack)
                i, j = np.nonzero(~(near < low[:, None]) & (qi[:, None] != ri[None, :]))
                s = np.zeros(len(i))
                for c in range(x["dim"]):
                    s += qv[i, c] * rv[j, c]
                keep = ~(s < threshold)
                i, j, s = i[keep], j[keep], s[keep]
                order = np.lexsort((ri[j], -s, i))
                i, j, s = i[order], j[order], s[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                yield pa.RecordBatch.from_arrays([pa.array(qi[i[keep]]), pa.array(ri[j[keep]]), pa.array(s[keep])], names=["query", "match", "similarity"])

    x = pairs.mapInArrow(meet, "query long, match long, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "match")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_matches(similar: DataFrame, unit: str, order: str, n: int = 3, threshold: float = 0.7) -> DataFrame:
    """The first n patterns of each unit in catalog order, not by similarity."""
    x = similar.where(F.col("similarity") >= threshold)
    return x.withColumn("rank", F.row_number().over(Window.partitionBy(unit).orderBy(order))).where(F.col("rank") <= n)


def naming_style(names: Column) -> tuple[Column, Column]:
    """How many names are snake_case and camelCase."""
    return F.size(F.filter(names, lambda n: n.rlike("_[a-z]"))), F.size(F.filter(names, lambda n: ~n.rlike("_[a-z]") & n.rlike("[a-z][A-Z]")))
