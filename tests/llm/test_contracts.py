"""Operators with a fixed contract against brute force, on driver data and on odd rows."""

import random

import brute
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def odd_texts():
    rng = random.Random(7)
    bits = ["a@b.c", "a@b.c%d@e.f", "x..y@z-.q.", "@", "a@b", "1.2.3.4.5.6.7.8", "300.1.1.1", "001.002.3.4", "1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "+1 (415) 555-2671", "+1415555267112345678", "+12", "++49 30 1234567", "12 13  14", "é", "ß@x.de", " ", "\x0b", "[x]", "A B C", "same line\nsame line\n", "\n\n", "the the the the", "~", "0", "x+1 (743) 555-3824", "9" * 40, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5"]
    texts = [None, "", " ", "\t\n", "one", "one two", "Ünïcode ÀB", "a " * 3000, "@" * 300, "9" * 5000, "1.2.3.4 " * 700, "+1 (415) 555-2671 " * 300, "x" * 20000]
    for _ in range(150):
        texts.append(rng.choice(["", " ", "\n"]).join(rng.choice(bits) + rng.choice(["", " ", ",", "\n"]) for _ in range(rng.randint(1, 14))))
    return texts


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(i, t, None, None if i % 5 == 0 else f"s{i % 7}", None) for i, t in enumerate(odd_texts())]
    rows += [(7, "repeated row", "en", "s1", 3), (7, "repeated row", "en", "s1", 3), (None, "no id here at all", "en", "s2", 1)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit(1)).withColumn("score", F.lit("x")).repartition(3)


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    """Driver data; odd rows; no rows."""
    real = spark.read.parquet(f"{SF}/documents.parquet")
    empty = tmp_path_factory.mktemp("empty")
    real.limit(0).write.parquet(f"{empty}/documents.parquet")
    return [real, docs, spark.read.parquet(f"{empty}/documents.parquet")]


def key(row):
    return tuple((x is not None, x) for x in row)


def same(df, expected):
    assert sorted(map(tuple, df.collect()), key=key) == sorted(expected, key=key)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_decontaminate(spark, tables):
    from loomlint.llm import decontaminate

    real = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    odd = spark.createDataFrame([(1, "the"), (2, "one two"), (3, None), (4, ""), (None, "repeated row"), (5, "a " * 40), (5, "no id here"), (6, "the the THE")], "item_id bigint, text string")
    for df in tables:
        for bench in (real, odd):
            x = decontaminate.find(df, bench)
            got = x.select("doc_id", "n_words", "n_hit", F.size("items").cast("long"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256), "contaminated")
            same(got, brute.decontaminate(pairs(df), [tuple(r) for r in bench.collect()]))


def test_decontaminate_in_blocks(spark, tables, monkeypatch):
    from loomlint.llm import decontaminate

    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    whole = sorted(map(str, decontaminate.find(tables[0], bench).select("doc_id", "n_hit", "items", "hit_ranges").collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 4000)
    assert sorted(map(str, decontaminate.find(tables[0], bench).select("doc_id", "n_hit", "items", "hit_ranges").collect())) == whole


def test_simhash(tables):
    from loomlint.llm import simhash

    for df in tables:
        same(simhash.dedup(df).select("doc_id", "fingerprint", "component_id"), brute.simhash(pairs(df)))


def test_simhash_dense_group_over_many_trees(spark, monkeypatch):
    from loomlint.llm import simhash

    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(400)} | {rng.getrandbits(64) for _ in range(200)}
    monkeypatch.setattr(simhash, "SHARD", 37)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.links(spark.createDataFrame(signed, "fp bigint"))
    got = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                up[root(a)] = root(b)
    groups = {}
    for f in fps:
        groups.setdefault(root(f), set()).add(f - (1 << 64) if f >> 63 else f)
    for g in groups.values():
        assert {got.get(f, f) for f in g} == {min(g)}


def test_simhash_deals_large_shards_anew(spark, monkeypatch):
    from loomlint.llm import simhash

    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps):  # neighbours within the radius and just beyond
        for k in (1, 2, 3, 4):
            g = f
            for bit in rng.sample(range(64), k):
                g ^= 1 << bit
            fps.add(g)
    monkeypatch.setattr(simhash, "SHARD", 2)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(spark.createDataFrame(signed, "fp bigint"))).collect()}
    groups = {}
    for f in fps:
        s = f - (1 << 64) if f >> 63 else f
        groups.setdefault(got.get(s, s), set()).add(f)
    of = {f: r for r, g in groups.items() for f in g}
    assert all((of[a] == of[b]) or (a ^ b).bit_count() > 3 for a in fps for b in fps)
    for g in groups.values():  # and each group is linked
        todo, seen = [min(g)], {min(g)}
        while todo:
            a = todo.pop()
            new = {b for b in g - seen if (a ^ b).bit_count() <= 3}
            seen |= new
            todo += new
        assert seen == g


@pytest.mark.parametrize("keys", [500_000, 0])
def test_near_duplicates_keep_one_row_a_class(spark, monkeypatch, keys):
    from loomlint.llm import simhash

    monkeypatch.setattr(simhash, "BROADCAST_KEYS", keys)

    rng = random.Random(3)
    texts = {k: " ".join(f"{k}{rng.randrange(10**6)}" for _ in range(60)) for k in "abc"}
    near = texts["b"] + " end"
    rows = [(1, texts["a"], 5, "x"), (1, texts["b"], 5, "x"), (2, texts["b"], 5, "y"), (3, texts["a"], 5, "z"), (4, near, 5, "w"), (None, texts["c"], 1, "v"), (None, texts["c"], 1, "v"), (5, "", 0, "e"), (6, None, 0, "n"), (5, "", 0, "e")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp int, _hash string")
    got = simhash.near_duplicates(df).collect()
    assert got[0].__fields__ == ["doc_id", "text", "fp", "_hash"]
    kept = sorted(((r["doc_id"] or 0, r["text"]) for r in got), key=str)
    assert kept == sorted([(1, texts["a"]), (1, texts["b"]), (0, texts["c"]), (5, "")], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_quality_base(spark, tables):
    from loomlint.llm import quality

    labels = spark.createDataFrame([(1, 1), (2, 0), (1, 1), (None, 1)], "doc_id bigint, quality int")
    for df in tables:
        model = quality.fit(df, labels)
        got = quality.score(df, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        same(got, brute.quality(pairs(df)))
    assert quality.score(df, quality.fit(df, labels.limit(0))).count() == 0


def test_quality_rejects_bad_labels_and_keeps_the_rest(spark):
    from loomlint.llm import quality

    x = quality.op6_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed")
    got = {(r["quality"], r["kept"]): r["count"] for r in x.groupBy("quality", "kept").count().collect()}
    assert got.get((1, False), 0) <= 0.02 * got[1, True]
    assert got.get((0, True), 0) <= 0.1 * got[0, False]


def test_pii_base(tables):
    from loomlint.llm import pii

    for df in tables:
        got = pii.digest(pii.detect(df, ["doc_id"]))
        same(got.drop("spans"), brute.pii(pairs(df)))


def test_pii_contexts_discover_unseen_identifiers(spark):
    from loomlint.llm import pii

    rows = [(i, f"Please reach member card: 4111111111111111 now or user{i}@mail.com today") for i in range(3)]
    rows += [(10 + i, f"blah your member card: {n} now thanks {i}") for i, n in enumerate(["4000000000000002", "4242424242424242", "5555555555554444", "378282246310005", "6011111111111117", "4012888888881881", "5105105105105100", "3530111333300000", "30569309025904", "4222222222222"] * 12)]
    rows += [(900, "here your member card: 99887766554433 now"), (901, "chapter 12345678 of the book"), (902, None)]
    out = {r["doc_id"]: r["spans"] for r in pii.digest(pii.detect(spark.createDataFrame(rows, "doc_id bigint, text string"), ["doc_id"])).collect()}
    assert out[900] == "context:23:37"
    assert out[901] == "" and out[902] == ""


def test_pii_redacts(spark):
    from loomlint.llm import pii

    rows = [(1, "é mail a@b.co, ip 10.0.0.1! +1 (415) 555-2671 x", 5), (2, "clean", 5), (3, None, None), (4, "1.2.3.4@host.com", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars int")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redact(df).collect()}
    assert got[1] == ("é mail [EMAIL], ip [IP]! [PHONE] x", 34)
    assert got[2] == ("clean", 5) and got[3] == (None, None)
    assert got[4][0] == "[EMAIL]"


def test_mix(spark, tables):
    from loomlint.llm import mixing

    for df in tables:
        got = mixing.mix(df).select("doc_id", "text", "source", "size", "source_size", "target", "taken").collect()
        assert len(got) == df.count()
        sizes, taken, targets = {}, {}, {}
        for r in got:
            assert r["size"] == len(brute.WORD.findall(r["text"] or ""))
            assert 0 <= r["taken"] <= 2 * r["size"]
            sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
            taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
            targets[r["source"]] = (r["source_size"], r["target"])
        assert abs(sum(t for _, t in targets.values()) - 1.5 * sum(sizes.values())) < 1e-3 * max(1, sum(sizes.values()))
        for s, (size, target) in targets.items():
            assert size == sizes[s] and target <= 2 * size + 1e-6 and abs(taken[s] - target) <= max(6, 0.01 * target)
        again = mixing.mix(df.repartition(5)).select("doc_id", "size", "taken").collect()
        assert sorted(map(tuple, again), key=key) == sorted(((r["doc_id"], r["size"], r["taken"]) for r in got), key=key)


def test_mix_follows_the_sequence(spark):
    """Other points give another mix; every source's slots run close to its share at every length of the schedule."""
    from loomlint.llm import mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, other = ({r["doc_id"]: (r["taken"], r["first_slot"]) for r in mixing.mix(docs, golden=g).collect()} for g in (mixing.GOLDEN, 1779033703))
    assert sum(one[i][0] != other[i][0] for i in one) > 5 and sum(one[i][1] != other[i][1] for i in one) > len(one) // 2
    sizes = docs.groupBy("source").agg(F.sum("n_chars").alias("source_size"))
    parts = mixing.shares(mixing.source_targets(sizes)).collect()
    slots = sum(p["n_slots"] for p in parts)
    got = mixing.schedule(spark.createDataFrame(parts), slots).collect()
    assert sorted(r["slot"] for r in got) == list(range(1, slots + 1))
    for p in parts:
        mine = sorted(r["slot"] for r in got if r["place"] == p["place"])
        assert [r["rank"] for r in sorted(got, key=lambda r: r["slot"]) if r["place"] == p["place"]] == list(range(len(mine)))
        assert all(abs(i + 1 - s * p["n_slots"] / slots) < 8 for i, s in enumerate(mine))


def discovered(spark, texts):
    from loomlint.llm import pii

    found = pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), ["doc_id"])
    return {c["value"] for r in found.collect() for c in r["context"]}


def test_pii_seeds_of_all_kinds(spark):
    names = ["ann.lee", "bo", "cy.day", "di", "ed.fox", "flo"]
    mails = [f"account of member ({n}@example.com) since spring" for n in names * 10]
    cards = [f"paid with card {c} yesterday" for c in ("4111 1111 1111 1111", "4242 4242 4242 4242", "5555 5555 5555 4444", "4012 8888 8888 1881", "5105 1051 0510 5100") * 12]
    texts = [*mails, "account of member AB12 since spring", *cards, "paid with card 998877 yesterday", "room AB13 of 998878"]
    assert discovered(spark, texts) == {"AB12", "998877"}


def test_pii_bootstraps_until_nothing_is_new(spark):
    values, texts = ["4111111111111111", "4242424242424242", "5555555555554444", "4012888888881881", "5105105105105100"], []
    every = set()
    for level in ("a", "b", "c", "d", "e"):
        new = [f"{level}{i}" for i in range(5)]
        texts += [f"x{level} y{level} {v} z{level}" for v in values * 12 + new]
        every |= set(new)
        values = new
    assert discovered(spark, texts) == every
