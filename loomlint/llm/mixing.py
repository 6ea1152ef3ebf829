"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame operations only).

1. Sources get weights by rank, and targets by water-filling: a target stops
   at ``cap`` times its source's size and the excess is shared anew by weight
   until none is above. A round is one aggregate over the sources.
2. Every source's documents are put in a shuffled but repeatable order (MD5 of
   the document id) and laid end to end; the stream is cut into blocks of equal
   words. A block has the words of 1 / ``SLOTS`` of the mix, or of
   1 / ``LEAST_SLOTS`` of the source's target where that is less.
3. The schedule is a fixed sequence of as many slots as the targets have blocks.
   Slot k belongs to the source in whose share of the cumulative weights the
   golden-ratio point ``k * GOLDEN mod 2**32`` falls: the points decide how
   many slots a source gets and when. Points of low discrepancy hit a share of
   n slots n times, give or take a few.
4. The r-th slot of a source reads its block r modulo its number of blocks, and
   ``cap`` passes at most. So many whole passes and so many blocks of one more
   pass say how often each word of the stream is read, and with its place in the
   stream what the mix takes of a document. Documents join the schedule by the
   block they begin in, which gives the slot that reads them first.

All arithmetic of the schedule is in whole numbers, so reruns agree.

A source's taken words differ from its target by the points' discrepancy, a few
blocks (of at most 1 / ``LEAST_SLOTS`` of the target where a block holds more
than one word), and by its last, shorter block.

Ranks and running sums over sources, and over documents of a source, are taken
within partitions or cells of ``CELL`` documents, never in one task. Texts are
read for their size and, if a column of the result, moved once.

Defined results: null text and text of white space only have size 0 and take 0
words; a null source is a source of its own and sorts last; rows with a null id
are ordered by their text; repeated rows each own an interval (equal rows are
told apart only by position, their multiset of results is repeatable); an empty
table gives an empty result; a column named like an output column of the
operator is replaced by it, others stay, whatever their names; texts of any
length are counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import windows
from . import common

#: 2**32 divided by the golden ratio, to the nearest odd number.
GOLDEN = 2654435769
#: Slots of the schedule, besides those that small sources add.
SLOTS = 65536
#: Slots that a source's target has at least, if it has as many words.
LEAST_SLOTS = 1024
#: Weights by the rank of the source, repeating.
WEIGHTS = (3, 1, 2)
#: Documents of a cell, on average.
CELL = 1000
#: Slots of a schedule that is broadcast: 32 MB at most.
BROADCAST_SLOTS = 1 << 20


def order_key(id_col: Column) -> Column:
    return F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """(source, source_size) of each source -> also place (by source, null last), weight and target; saved."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    x = common.save(windows.numbered(sizes, [F.col("source").asc_nulls_last()]).withColumn("weight", w), "mix-sources")
    full, level = cap * F.col("source_size"), 0.0
    wanted = (x.agg(F.sum("source_size")).first()[0] or 0) * share
    while True:
        above = full < level * F.col("weight")
        spent, open_weight = x.agg(F.sum(F.when(above, full).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        new = (wanted - spent) / open_weight if open_weight else float("inf")
        if new <= level or not open_weight:
            break
        level = new
    target = F.least(full, F.lit(level) * F.col("weight")) if level < float("inf") else full
    return common.save(x.withColumn("target", target.cast("double")), "mix-targets")


def shares(targets: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Adds block (words), n_blocks, n_slots (wanted) and the whole numbers lo and hi between which the source's points fall; saved."""
    total = targets.agg(F.sum("target")).first()[0] or 0.0
    common_block = F.lit(max(1, -int(-total // slots)))
    block = F.greatest(F.lit(1), F.least(common_block, F.floor(F.col("target") / LEAST_SLOTS).cast("long"))).cast("long")
    x = targets.withColumn("block", block).withColumns({
        "n_blocks": F.ceil(F.col("source_size") / F.col("block")).cast("long"),
        "n_slots": F.round(F.col("target") / F.col("block")).cast("long"),
    })
    x = common.save(windows.numbered(x.drop("place"), [F.col("source").asc_nulls_last()], ("n_slots",)), "mix-shares")
    n = x.agg(F.sum("n_slots")).first()[0] or 0
    x = x.withColumns({"lo": F.expr(f"shiftleft(before_n_slots, 32) div {max(n, 1)}"), "hi": F.expr(f"shiftleft(before_n_slots + n_slots, 32) div {max(n, 1)}")})
    return x.drop("before_n_slots")


def schedule(parts: DataFrame, slots: int, golden: int = GOLDEN) -> DataFrame:
    """(place, rank, slot): the rank-th slot of the source at ``place``, of the slots 1 to ``slots``."""
    spark = parts.sparkSession
    bits = max(1, slots.bit_length())
    shift = 32 - min(31, bits)
    # a share covers whole cells of a grid as fine as the slots, and parts of two more: few shares lie in one cell
    held = parts.where("hi > lo").select("place", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift))).alias("cell"))
    points = spark.range(1, slots + 1).select(F.col("id").alias("slot"), (F.col("id") * golden % (1 << 32)).alias("point"))
    hits = points.withColumn("cell", F.shiftright("point", shift)).join(held, "cell").where("point >= lo and point < hi")
    return hits.select("place", (F.row_number().over(Window.partitionBy("place").orderBy("slot")) - 1).cast("long").alias("rank"), "slot")


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS, slots: int = SLOTS, golden: int = GOLDEN) -> DataFrame:
    """Adds size, source_size, target, taken (words the mix takes, repeats counted) and first_slot (that reads of the document first, null if none does) to ``docs``."""
    docs = docs.drop("size", "source_size", "target", "taken", "first_slot")
    # columns go by numbers, so that none clashes and those that the caller doesn't want are never moved
    numbered = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    given = {c.lower(): F.col(n) for c, n in numbered.items()}
    text = F.coalesce(given["text"], F.lit(""))
    name = F.when(given["source"].isNull(), "").otherwise(F.concat(F.lit("="), given["source"]))
    key = F.when(given["doc_id"].isNotNull(), order_key(given["doc_id"])).otherwise(F.md5(text.cast("binary")))
    size = F.regexp_count(text, F.lit(common.WORD)).cast("long")
    keyed = docs.toDF(*numbered.values()).select("*", size.alias("size"), name.alias("name"), key.alias("key"))
    # (name, key, size) of each document: counts and sums are taken of these, the texts aren't read again for them
    narrow = common.save(keyed.select(given["source"].alias("source"), "size", "name", F.substring("key", 1, 8).alias("key")), "mix-sizes")
    sources = narrow.groupBy("source", "name").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(common.save(sources, "mix-source-sizes"), share, cap, weights)
    parts = shares(targets, slots)
    most, total = parts.agg(F.max("n"), F.sum("n_slots")).first()
    # hexadecimal digits of the key that deal a source into cells
    digits = next(d for d in range(2, 9) if (most or 0) <= CELL * 16**d or d == 8)
    hits = common.save(schedule(parts, total or 0, golden), "mix-schedule")
    won = parts.join(hits.groupBy("place").agg(F.count("*").alias("hits")), "place", "left")
    reads = F.least(F.coalesce("hits", F.lit(0)), F.floor(F.lit(cap) * F.col("n_blocks")).cast("long"))
    won = won.withColumn("reads", reads).select(
        "name", "place", "source_size", "target", "block", "reads", "n_blocks",
        F.floor(F.col("reads") / F.greatest("n_blocks", F.lit(1))).cast("long").alias("passes"), F.least(F.col("reads") % F.greatest("n_blocks", F.lit(1)) * F.col("block"), "source_size").alias("more"),
    )

    # cells of all sources, with the words before them and their source's part in the schedule
    deal = F.substring("key", 1, digits).alias("deal")
    cells = narrow.groupBy("name", deal).agg(F.sum("size").alias("cell_size"))
    ahead = Window.partitionBy("name").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    cells = common.save(cells.withColumn("offset", F.coalesce(F.sum("cell_size").over(ahead), F.lit(0))).drop("cell_size").join(won, "name"), "mix-cells")
    within = Window.partitionBy("name", "deal").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    # the window and the join share one partitioning by cell, so whole rows move once
    placed = keyed.withColumn("deal", deal).withColumn("end", F.sum("size").over(within)).join(cells, ["name", "deal"])
    placed = placed.withColumn("end", F.col("end") + F.col("offset")).withColumn("start", F.col("end") - F.col("size"))
    upto = lambda c: F.col("passes") * F.col(c) + F.least(F.col(c), F.col("more"))
    placed = placed.withColumn("taken", (upto("end") - upto("start")).cast("long")).withColumn("rank", F.floor(F.col("start") / F.col("block")).cast("long"))
    first = hits.withColumnRenamed("slot", "first_slot")
    placed = placed.join(F.broadcast(first) if (total or 0) <= BROADCAST_SLOTS else first, ["place", "rank"], "left")
    return placed.select(*[F.col(n).alias(c) for c, n in numbered.items()], "size", "source_size", "target", "taken", F.when(F.col("taken") > 0, F.col("first_slot")).alias("first_slot"))


def op3_mix(spark, sf_dir: str) -> DataFrame:
    x = mix(common.read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return x.select("doc_id", "size", "source_size", "target", "taken", "source", "first_slot")
