import random

import duckdb
from test_contracts import SCHEMA, odd_texts


def same_as_sql(spark, df, tmp_path):
    from loomlint.llm import license

    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted(con.execute(f"select doc_id, n_licenses, licenses, containment from ({license.oracle()})").fetchall(), key=key)
    got = sorted(map(tuple, license.op8_license(spark, str(tmp_path)).collect()), key=key)
    assert got == want
    return got


def test_planted_and_odd_texts(spark, tmp_path):
    from loomlint.llm import license

    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choice("lorem ipsum the of license permission to any é 7".split()) for _ in range(n))
    texts = odd_texts()
    for name, t in license.TEMPLATES.items():
        for pad in (0, 3, 57, 400):
            texts.append(f"{filler(pad)} {t.upper() if pad == 3 else t} {filler(pad // 2)}")
        w = t.split()
        texts.append(" ".join(w[: len(w) * 9 // 10]))  # nearly all of it
        texts.append(" ".join(w[: len(w) // 2]))  # not enough
    texts.append(filler(30_000) + " " + license.TEMPLATES["MIT"])
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)] + [(1, texts[-2], None, None, 1)] * 2 + [(None, "Released under the MIT License.", None, None, 1)], SCHEMA)
    got = same_as_sql(spark, df, tmp_path)
    assert sum(r[1] for r in got) >= 4 * len(license.TEMPLATES)


def test_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    assert same_as_sql(spark, df, tmp_path) == []


def test_hash_is_sparks(spark):
    from pyspark.sql import functions as F

    from loomlint.llm import license

    h = spark.range(1).select(F.xxhash64(*[F.xxhash64(F.lit(w)) for w in "a bc def g h".split()])).first()[0]
    assert license._hash("a bc def g h") == h


def test_short_templates(spark):
    import pytest

    from loomlint.llm import license

    texts = ["© 2020 Foo. All rights reserved.", "all RIGHTS, reserved", "small rights reserved", "all rights were reserved", "Released under the MIT License. All rights reserved.", "", None, "word " * 500 + "All rights reserved"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    templates = {"Zero": "All rights reserved.", "MIT": license.TEMPLATES["MIT"]}
    got = {r["doc_id"]: [tuple(x) for x in r["licenses"]] for r in license.scan(df, templates).collect()}
    all_ = ("Zero", 1.0)
    assert got == {0: [all_], 1: [all_], 2: [], 3: [], 4: [("MIT", 1.0), all_], 5: [], 6: [], 7: [all_]}
    only = {r["doc_id"] for r in license.scan(df, {"Zero": "All rights reserved"}).collect() if r["licenses"]}
    assert only == {0, 1, 4, 7}
    with pytest.raises(ValueError):
        license.scan(df, {"none": "©"})
