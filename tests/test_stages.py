"""Service levels, providers, and reports of scans."""

import math
import re
import sys

import pytest
from pyspark import cloudpickle

from loomlint.plans import corpus, reports, scan, stages
from loomlint.sources import code

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module
FILES = "file string, language string, content string"


class Says:
    def __init__(self, reply):
        self.reply = reply

    def available(self):
        return self.reply != "gone"

    def complete(self, prompt):
        if "boom" in prompt:
            raise ValueError("boom")
        return self.reply, 5


class Letters:
    """Counts of letters as vectors."""

    def embed(self, texts):
        return [[float(t.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]


REPLY = '```json\n{"issues": [{"line": 2, "severity": "error", "message": "odd", "category": "implementation"}]}\n```'
ROWS = [
    ("secret", "implementation", "error", "", "password token secret"),
    ("random", "implementation", "warning", "python", "random token"),
]


@pytest.fixture(scope="module")
def units(spark):
    files = [("a.py", "python", "def password_token():\n    secret()\n"), ("b.ts", "typescript", "export function other() { return 'boom random token'; }\n"), ("c.py", "python", "def quiet():\n    pass\n")]
    return code.extract_units(spark.createDataFrame(files, FILES)).where("error is null").cache()


def tokens(text):
    return [w.lower() for w in re.split(r"[^a-zA-Z0-9]+", re.sub("([a-z])([A-Z])", r"\1 \2", text).replace("_", " ")) if len(w) > 1]


def plain_recall(units, rows, threshold):
    """The recall by a plain program."""
    texts = [r[4] for r in rows] + [u["text"] for u in units]
    toks = [tokens(t) for t in texts]
    df = {}
    for t in toks:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log((len(texts) + 1) / (n + 1)) + 1 for w, n in df.items()}
    assert len(idf) <= stages.VOCABULARY

    def vector(t):
        v = {w: t.count(w) / len(t) * idf[w] for w in set(t)}
        n = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / n for w, x in v.items()}

    vs = [vector(t) for t in toks]
    out = set()
    for u, v in zip(units, vs[len(rows) :], strict=True):
        hits = []
        for r, p in zip(rows, vs, strict=False):
            s = sum(v.get(w, 0) * x for w, x in p.items())
            if s >= threshold and (not r[3] or u["language"] in r[3].split()):
                hits.append((u["file"], u["start_line"] + 1, r[0], round(s, 6)))
        out |= set(hits[: stages.FIRST])
    return out


def test_recall(spark, units):
    got = stages.recall(units, 0.05, ROWS)
    want = plain_recall(stages.unit_texts(units).collect(), ROWS, 0.05)
    assert {(r["file"], r["line"], r["rule_id"], round(r["confidence"], 6)) for r in got.collect()} == want and want
    assert {f for f, *_ in want} >= {"a.py", "b.ts"} and "c.py" not in {f for f, *_ in want}
    assert not [r for r in want if r[0] == "b.ts" and r[2] == "random"]


def test_recall_of_nothing(spark, units):
    assert stages.recall(units.where("false"), 0.1, ROWS).count() == 0


def test_embedder(units):
    got = stages.recall(units, 0.0, ROWS, Letters()).collect()
    assert {(r["file"], r["rule_id"]) for r in got} == {("a.py", "secret"), ("a.py", "random"), ("b.ts", "secret"), ("c.py", "secret"), ("c.py", "random")}
    assert all(0 <= r["confidence"] <= 1 + 1e-9 for r in got)


def test_levels(spark, units):
    structural = scan.issues(units.where("file = 'c.py'")).limit(0)
    one = lambda level, **kw: stages.run(units, structural, level, rows=ROWS, threshold=0.05, **kw)
    totals = lambda r: {x["stage"]: (x["issues"], x["tokens"]) for x in r["totals"].collect()}
    assert totals(one("L1")) == {"structural": (0, 0)}
    two = totals(one("L2"))
    assert set(two) == {"structural", "embedding"} and two["embedding"][0] > 0
    three = one("L3", providers=[Says("gone"), Says(REPLY)])
    found = totals(three)
    asked = stages.suspicious(units, three["issues"].where("stage = 'embedding'")).collect()
    bad = [u for u in asked if "boom" in u["source"]]
    assert 0 < len(bad) < len(asked)
    assert three["failures"].count() == len(bad) and three["failures"].first()["error"] == "ValueError: boom"
    assert found["model"] == (len(asked) - len(bad), 5 * (len(asked) - len(bad)))
    none = totals(one("L3", providers=[Says("gone")]))
    assert none == {**two, "model": (0, 0)}
    with pytest.raises(ValueError):
        one("L4")


def test_scan_by_level(spark):
    files = spark.createDataFrame(corpus.FILES, FILES)
    low, high = scan.scan(files), scan.scan(files, level="L2", threshold=0.05)
    n = {r["stage"]: r["issues"] for r in high["stages"].collect()}
    assert n["structural"] == low["issues"].count() and n["embedding"] > 0
    assert high["issues"].count() == n["structural"] + n["embedding"]
    assert {r["language"] for r in stages.patterns(spark).selectExpr("explode(split(languages, ' ')) language").distinct().collect()} == {"", "typescript", "javascript", "python", "java", "kotlin"}


def test_reports(spark):
    r = scan.scan(spark.createDataFrame(corpus.FILES, FILES))
    n = r["issues"].count()
    text, comment = reports.terminal(r["issues"], r["score"], n=2), reports.change_comment(r["issues"], r["score"], n=3)
    assert text.startswith("Score ") and "src/app.ts (" in text and "more" in text
    assert comment.startswith("<!-- loomlint -->\n") and f"and {n - 3} more" in comment and comment.count("**error**") == 3
    empty = reports.heal_summary(spark.createDataFrame([], "patched boolean, changes int, original_score double, fixed_score double")).first()
    assert tuple(empty) == (0, 0, 0, 0.0)


def test_catalog_of_apis(spark, tmp_path):
    from loomlint.operators import v3
    from loomlint.sources import files as sources

    (tmp_path / "apis.json").write_text('[{"api": "old()", "pattern": "\\\\bold\\\\(", "severity": "high", "replacement": "fresh()", "deprecated_since": "2.0", "x": 1}, {"api": "none"}]')
    catalog = sources.api_catalog(spark, str(tmp_path / "apis.json"))
    files = spark.createDataFrame([("a.ts", "typescript", "// old()\nx = old(1) + old(2)\nfold(1)")], FILES)
    rows = [tuple(r) for r in v3.stale_apis(files, catalog).select("line", "column", "severity", "message").collect()]
    assert rows == [(2, 5, "high", "old() (since 2.0) -> fresh()")]
    assert v3.stale_apis(files, catalog.where("false")).count() == 0
    nothing = spark.createDataFrame([], "language string, package string")
    ghost = spark.createDataFrame([("a.ts", "typescript", "import a from 'ghost';\nimport b from 'famous';")], FILES)
    known = spark.createDataFrame([("famous",)], "package string")
    assert [r["message"] for r in v3.phantom_packages(ghost, nothing, nothing, well_known=known).collect()] == ["ghost"]


def test_security_names_weaknesses(spark):
    from loomlint.operators import v3

    text = "const password = 'abcdefgh1';\neval(x);\napp.use(helmet({ hsts: false }));\nconst t = { rejectUnauthorized: false };\nconst k = 'ghp_" + "a" * 36 + "';\nconst h = hsts(true);"
    rows = spark.createDataFrame([("a.ts", "typescript", text), ("tests/a.ts", "typescript", text)], FILES)
    got = {(r["file"], r["line"], r["type"], r["cwe"]) for r in v3.security(rows).collect()}
    want = {(1, "hardcoded-secret", "CWE-798"), (2, "unsafe-eval", "CWE-95"), (3, "insecure-config", "CWE-693"), (4, "insecure-config", "CWE-295"), (5, "hardcoded-secret", "CWE-798")}
    assert got == {("a.ts", *w) for w in want}
