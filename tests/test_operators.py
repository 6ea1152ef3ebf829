"""Operators against plain Python and authored cases."""

import json
import random

import pytest
from pyspark.sql import functions as F


def test_file_selection(spark, tmp_path):
    from loomlint.sources import files

    for p, t in {"a/x.ts": "let a", "node_modules/y.ts": "b", "z.py": "c", "q.bin": "d"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    got = {(r["file"], r["language"], r["content"]) for r in files.read_tree(spark, str(tmp_path)).collect()}
    assert got == {("a/x.ts", "typescript", "let a"), ("z.py", "python", "c")}
    df = spark.createDataFrame([("a/x.test.ts",), ("a/x.ts",), ("b.md",)], "file string")
    names = lambda d: {r["file"] for r in d.collect()}
    assert names(files.include_exclude(df, ["**/*.ts"], ["**/*.test.*"])) == {"a/x.test.ts", "a/x.ts"}
    assert names(files.include_exclude(df, ["**/*.ts"], ["**/*.test.*"], strict=True)) == {"a/x.ts"}


def test_manifest_and_cache(spark):
    from loomlint.sources import files

    m = spark.createDataFrame([("p", '{"dependencies": {"a": "1"}, "devDependencies": {"b": "2", "a": "1"}}'), ("q", "no json")], "file string, content string")
    assert {(r["file"], r["package"]) for r in files.manifest_dependencies(m).collect()} == {("p", "a"), ("p", "b")}
    cache = spark.createDataFrame([("k", 100, 50), ("old", 10, 50)], "key string, ts long, ttl long")
    look = spark.createDataFrame([("k",), ("k",), ("old",), ("none",)], "key string")
    r = files.cache_stats(look, cache, 120).first()
    assert (r["lookups"], r["hits"], r["misses"], r["hit_rate"]) == (4, 2, 2, 0.5)


def greedy(static, found):
    rank = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
    out, used = [dict(s, source="static") for s in static], set()
    for a in found:
        at = next((i for i, x in enumerate(out) if i not in used and x["file"] == a["file"] and x["category"] == a["category"] and abs(x["line"] - a["line"]) <= 3), None)
        if at is None:
            out.append(dict(a, source="ai", confidence=a["confidence"] * 0.8))
        else:
            used.add(at)
            keep = a if rank[a["severity"]] > rank[out[at]["severity"]] else out[at]
            out[at] = dict(keep, source="both", confidence=min(1.0, out[at]["confidence"] * 1.05))
    return sorted((x["file"], x["category"], x["ord"], x["line"], x["severity"], round(x["confidence"], 9), x["source"]) for x in out if x["confidence"] >= 0.3)


def test_band_merge_is_greedy_in_order(spark):
    from loomlint.operators import matching

    rng = random.Random(3)
    row = lambda i: {"file": rng.choice("ab"), "category": rng.choice("xy"), "ord": i, "line": rng.randint(1, 25), "severity": rng.choice(["critical", "low", "info"]), "confidence": rng.choice([0.3, 0.5, 0.9])}
    s, a = [row(i) for i in range(30)], [row(i) for i in range(40)]
    schema = "file string, category string, ord long, line long, severity string, confidence double"
    got = matching.merge_bands(spark.createDataFrame(s, schema), spark.createDataFrame(a, schema)).collect()
    assert sorted((r["file"], r["category"], r["ord"], r["line"], r["severity"], round(r["confidence"], 9), r["source"]) for r in got) == greedy(s, a)


def test_chain_depths(spark):
    from loomlint.operators import matching

    edges = [(f"{c}{i}", f"{c}{i - 1}" if i else None) for c, n in (("a", 40), ("b", 1), ("c", 7)) for i in range(n)]
    got = {r["node"]: r["depth"] for r in matching.chain_depths(spark.createDataFrame(edges, "node string, parent string"), "node", "parent").collect()}
    assert got == {f"{c}{i}": i for c, n in (("a", 40), ("b", 1), ("c", 7)) for i in range(n)}


def test_scores_saturate_and_empty_is_perfect(spark):
    from loomlint.operators import scoring

    schema = "file string, category string, severity string"
    r = scoring.aggregate(spark.createDataFrame([], schema)).first()
    assert (r["overall_score"], r["grade"], r["total_files"], r["passed"]) == (100, "A+", 0, True)
    r = scoring.total(spark.createDataFrame([("f", "hallucination", "critical")] * 9, schema), []).first()
    assert (r["aiFaithfulness"], r["total_score"], r["grade"]) == (0.0, 65, "D")


@pytest.mark.parametrize("reply, want", [
    ('```json\n{"issues": [{"line": 3, "message": "m", "severity": "critical", "category": "stale api"}]}\n```', [(3, "error", "code-freshness", "m")]),
    ('[{"line": -2, "message": "m"}, {"message": "no line"}]', [(1, "info", "implementation", "m")]),
    ("sorry", []), ("", []),
])
def test_replies(spark, reply, want):
    from loomlint.plans import model_stage

    got = model_stage.parse_replies(spark.createDataFrame([("f", reply)], "file string, reply string")).collect()
    assert [(r["line"], r["severity"], r["category"], r["message"]) for r in got] == want


SRC = """import a from 'x';
import b from 'x';
const q = require('y');
// TODO: later
const api_key = "abcdefgh12345";
function f() {
  return 1;
  dead();
}
try { g(); } catch (e) {}
let v: any = h() as any;
console.log(v);
"""


def test_file_detectors_and_reports(spark):
    from loomlint.operators import v3
    from loomlint.plans import reports

    files = spark.createDataFrame([("s.ts", "typescript", SRC), ("e.ts", "typescript", "")], "file string, language string, content string")
    kinds = lambda d: {(r["type"], r["line"]) for r in d.collect()}
    assert kinds(v3.security(files)) == {("hardcoded-secret", 5)}
    assert {("incomplete-implementation", 4), ("unreachable-code", 8), ("empty-catch", 10)} <= kinds(v3.logic_gaps(files))
    assert kinds(v3.duplication(files)) == {("duplicate-import", 2)}
    assert ("module-system", 3) in kinds(v3.context_breaks(files))
    assert kinds(v3.type_safety(files)) == {("any-usage", 11)}
    assert {("unresolved-marker", 4), ("empty-catch", 10), ("console-left", 12), ("unreachable-after-return", 8), ("mixed-modules", 1)} <= kinds(v3.bot(files))
    known = spark.createDataFrame([("typescript", "x")], "language string, package string")
    assert kinds(v3.phantom_packages(files, known, spark.createDataFrame([], "package string"))) == {("phantom-package", 3)}
    issues = v3.bot(files).withColumnRenamed("detector", "detector_id").withColumn("end_line", F.lit(None).cast("int"))
    doc = json.loads(reports.sarif(issues).first()["json"])
    assert doc["version"] == "2.1.0" and len(doc["runs"][0]["results"]) == issues.count()
    assert reports.code_quality(issues).where("length(fingerprint) > 40").count() == 0


def test_streamed_files(spark, tmp_path):
    from loomlint.operators.rules import Rule
    from loomlint.streaming import incremental

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.py").write_text("x = 1\neval(x)\n")
    found = incremental.stream_rules(incremental.file_stream(spark, str(tmp_path / "in")), [Rule("eval", r"\beval\(")])
    incremental.start(found, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["line_no"], r["rule_id"]) for r in got] == [(2, "eval")]
