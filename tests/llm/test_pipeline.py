"""Stages of the pipeline, each against plain Python on what its predecessor kept."""

import brute
import numpy as np
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    import corpus_pipeline as c
    from loomlint.llm import common, quality

    real = common.read_table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, "word " * 8 + " ".join(f"w{i}" for i in range(80)), "en", "s", 1), (None, "word " * 8 + " ".join(f"w{i}" for i in range(80)), "en", "s", 1), (10**9, None, None, None, None), (10**9 + 1, "", "en", "s", 0)], real.schema)
    docs = real.unionByName(odd).unionByName(real.where("doc_id < 3"))
    columns = docs.columns
    stages = dict(c.STAGES)
    assert [n for n, _ in c.STAGES] == ["quality rules", "simhash near-dedup", "benchmark decontamination", "pii", "source mix"]

    kept = common.save(stages["quality rules"](spark, docs, SF), "t")
    base = {(d, t) for (d, t), r in zip(rows(docs), brute.quality(rows(docs))) if not r[-1]}
    assert kept.columns == columns and set(rows(kept)) <= base
    model = quality.fit(docs, common.read_table(spark, SF, "labels"))
    assert sorted(map(str, rows(kept))) == sorted(map(str, rows(quality.score(docs, model).where("kept"))))

    single = common.save(stages["simhash near-dedup"](spark, kept, SF), "t")
    before, after = brute.simhash(rows(kept)), rows(single)
    ids = {c for _, _, c in before if c is not None}
    assert single.columns == columns and sorted(d for d, _ in after if d is not None) == sorted(ids)
    nameless = {f for d, f, c in before if c is None}
    assert len([1 for d, _ in after if d is None]) <= len(nameless) and (not nameless or any(d is None for d, _ in after))

    # a long document with a short passage, and a fixed one with all but one word of a window
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    passage = brute.FOLDED.findall(bench[0][1].translate(brute.LOWER))[:14]
    filler = [f"zz{i}" for i in range(3000)]
    more = [(10**9 + 5, " ".join(filler[:1500] + passage + filler[1500:]), "en", "s", 1), (10**9 + 6, " ".join(filler[:30] + passage[:12] + filler[30:]), "en", "s", 1)]
    single = single.unionByName(spark.createDataFrame(more, single.schema))
    clean = common.save(stages["benchmark decontamination"](spark, single, SF), "t")
    want = [d for d, _, hit, *_ in brute.decontaminate(rows(single), bench) if not hit]  # every item has a window of 13 words
    assert clean.columns == columns and sorted(map(str, want)) == sorted(str(d) for d, _ in rows(clean))
    assert 10**9 + 6 in want and 10**9 + 5 not in want

    safe = common.save(stages["pii"](spark, clean, SF), "t")
    assert safe.columns == columns and safe.count() == clean.count()
    assert all(r[1:5] == (0, 0, 0, 0) for r in brute.pii(rows(safe)))
    had = {d for d, *n, _ in brute.pii(rows(clean)) if sum(n)}
    changed = {d for (d, t) in set(rows(clean)) - set(rows(safe))}
    assert had <= changed and len(changed) <= len(had) + 2

    mixed = stages["source mix"](spark, safe, SF)
    r = mixed.agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).first()
    assert mixed.count() == safe.count() and abs(r["taken"] - 1.5 * r["size"]) <= 40


def test_odd_tables(spark, tmp_path):
    """Empty tables, clashing columns and unlike texts of one id go through every stage."""
    import corpus_pipeline as c
    from loomlint.llm import common

    real = common.read_table(spark, SF, "documents")
    for t in ("labels", "benchmark"):
        common.read_table(spark, SF, t).write.parquet(f"{tmp_path}/{t}.parquet")
    clash = {n: F.lit(i) for i, n in enumerate(["email", "context", "fp", "_hash", "_bytes", "_row", "kept", "score", "n_words", "items", "longest", "size", "taken", "class", "name", "key", "deal", "d"])}
    for docs in (real.limit(0), real.where("doc_id < 40").withColumns(clash), real.limit(0).withColumns(clash)):
        n, columns = docs.count(), docs.columns
        for name, stage in c.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.count() <= n
            if name != "source mix":
                assert out.columns == [x for x in columns if name != "quality rules" or x in columns]
                own = out.select(*[x for x in clash if x in out.columns]).distinct().collect()
                assert len(own) <= 1
        assert c.run is not None


def test_short_items_condemn_nothing(spark, tmp_path):
    import corpus_pipeline as c

    spark.createDataFrame([(1, "the"), (2, "of the"), (3, "a whole item of eight words in all")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "the the of the end"), (2, "long " * 500 + "a whole item of eight words in all"), (3, "nothing here"), (4, None)], "doc_id bigint, text string")
    got = c.benchmark_decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 3, 4]


def test_quality_stage_learns_from_every_labelled_document(spark, tmp_path):
    """Good documents are all long, so a threshold that leaves long ones out would keep the bad ones."""
    import random

    import corpus_pipeline as c
    from test_models import word_buckets

    rng = random.Random(5)
    text = lambda n, kind: " ".join(f"{kind}{rng.randrange(500)}" for _ in range(n))
    docs = [(i, text(35_000, "good"), "en", "s", 0) for i in range(4)] + [(10 + i, text(80, "bad"), "en", "s", 0) for i in range(20)] + [(50, text(90, "good"), "en", "s", 0), (51, text(90, "bad"), "en", "s", 0)]
    assert all(len(t) > 200_000 for _, t, *_ in docs[:4])
    labels = [(d, int(d < 10), 0) for d, *_ in docs if d < 50]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    threshold = brute.quality_threshold([r[:2] for r in docs], [r[:2] for r in labels], word_buckets)
    x = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = sorted(r["doc_id"] for r in c.quality_rules(spark, x, str(tmp_path)).collect())
    counts = {d: np.bincount(word_buckets(t), minlength=10_000) for d, t, *_ in docs}
    raw, trusted = sum(counts.values()), sum(counts[d] for d in range(4))
    weight = np.log((trusted + 1) / (trusted.sum() + 10_000)) - np.log((raw + 1) / (raw.sum() + 10_000))
    assert kept == sorted(d for d, n in counts.items() if (weight * n).sum() / n.sum() >= threshold) == [0, 1, 2, 3, 50]
