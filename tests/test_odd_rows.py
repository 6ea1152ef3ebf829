"""Queries against their SQL on odd rows that the driver's tables lack, and operators against plain Python."""

import random

import duckdb

from loomlint import catalog


def same_as_sql(spark, folder, name, **tables):
    """Run the query and its SQL over authored tables: table=(rows, schema)."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        path = f"{folder}/{table}.parquet"
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)
        con.execute(f"create view {table} as select * from '{path}/*.parquet'")
    df = catalog.queries()[name](spark, str(folder))
    cols = sorted(df.columns)
    cell = lambda v: round(v, 6) if isinstance(v, float) else v
    plain = lambda rows: sorted((tuple(cell(v) for v in r) for r in rows), key=str)
    got, want = plain(df.select(cols).collect()), plain(con.execute(f"select {', '.join(cols)} from ({catalog.oracle_sql()[name]})").fetchall())
    assert got == want
    return got


def test_code_points_of_odd_texts(spark, tmp_path):
    texts = ["", None, "abc", "ABC 12", "z~", "été", "a​b­", "ok \U0001f600", "\U000e0041ᅟ", "line\nZ", "\x7f", "x﻿ﾠ"]
    rows = [*enumerate(texts), (3, "ü​"), (3, "twice"), (0, "once more"), (1, None), (None, "no id")]
    assert same_as_sql(spark, tmp_path, "q_codepoints", documents=(rows, "doc_id long, text string"))


def test_vector_search_meets_in_blocks(spark, tmp_path, monkeypatch):
    from loomlint.operators import similarity

    monkeypatch.setattr(similarity, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 40)
    rng = random.Random(5)
    some = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(60)]
    rows = [(i, some[i * i % 60]) for i in range(900)]  # copies everywhere: ties go by match
    assert len(same_as_sql(spark, tmp_path, "q_cosine_topk", embeddings=(rows, "vec_id long, embedding array<float>"))) == 45
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert similarity.vector_blocks(e.coalesce(1), "vec_id", "embedding", 40).count() == 23  # rows of a join, not 900
    odd = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, []), (6, [1.0, 0.1])], "id long, v array<double>")
    got = similarity.cosine_top(odd.where("id in (0, 2, 5)"), odd, "id", "v", 5, 0.2).collect()
    assert sorted((r["query"], r["match"], r["rank"]) for r in got) == [(0, 1, 1), (0, 6, 2)]


def test_band_merge_of_one_large_group_is_linear(spark):
    import time

    from loomlint.operators import matching

    schema = "file string, category string, ord long, line long, severity string, confidence double"
    n = 60_000  # all in one group, and every found row far from the first static ones
    static = spark.range(n).selectExpr("'f' as file", "'c' as category", "id as ord", "id * 10 as line", "'low' as severity", "0.5D as confidence")
    found = spark.range(n).selectExpr("'f' as file", "'c' as category", "id as ord", f"({n} - 1 - id) * 10 + 3 as line", "'high' as severity", "0.9D as confidence")
    began = time.monotonic()
    got = matching.merge_bands(static, found).groupBy("source", "severity").count().collect()
    assert [tuple(r) for r in got] == [("both", "high", n)]
    assert time.monotonic() - began < 60  # 1.8 billion comparisons if each row looks through its group
    odd = [("f", None, 1, None, "low", None), ("f", None, 2, 7, "low", 0.0), (None, "c", 3, 7, "low", 0.2)]
    got = matching.merge_bands(spark.createDataFrame(odd, schema), spark.createDataFrame(odd, schema)).collect()
    plain = sorted(((r["ord"], r["line"], r["source"], None if r["confidence"] is None else round(r["confidence"], 6)) for r in got), key=str)
    assert plain == [(1, None, "ai", 0.56), (1, None, "static", None), (2, 7, "both", 0.945)]


def test_near_equal_texts_are_all_found(spark, tmp_path):
    rng = random.Random(11)
    texts = []
    for n in [1, 2, 3, 4, 5, 6, 9, 10, 11, 16, 17, 20, 25, 26, 40, 77]:
        base = [rng.choice(["", "same", f"line {i}"]) for i in range(n)]
        for _ in range(9):
            v = [x if rng.random() > 0.1 else f"other {rng.random()}" for x in base]
            cut = rng.choice([0, 0, 1, n // 5])
            texts.append("\n".join(v[: n - cut] if rng.random() < 0.5 else v + ["more"] * cut))
    rows = [(i % 400, t, s) for i, t in enumerate(texts + texts[:90]) for s in [rng.choice(["s", "t", None])]]
    assert len(same_as_sql(spark, tmp_path, "q_body_similarity", documents=(rows, "doc_id long, text string, source string"))) > 100


def test_recall_by_matrix_and_by_joins(spark, tmp_path, monkeypatch):
    from loomlint.operators import similarity

    rng = random.Random(2)
    words = [f"w{i}ord" for i in range(60)]
    text = lambda: " ".join(rng.choice(words[: rng.choice([5, 60])]) for _ in range(12))
    docs = [*((i % 70, text()) for i in range(80)), (90, ""), (91, None), (92, "! ?")]
    tables = {"documents": (docs, "doc_id long, text string"), "benchmark": ([*((i, text()) for i in range(9)), (20, "")], "item_id long, text string")}
    assert same_as_sql(spark, tmp_path, "q_embedding_recall", **tables)
    monkeypatch.setattr(similarity, "DENSE_CELLS", 0)
    assert same_as_sql(spark, tmp_path, "q_embedding_recall", **tables)
