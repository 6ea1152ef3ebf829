"""A small corpus of source files with one defect each, for the code-scan query and tests."""

FILES = [
    ("src/app.ts", "typescript", """import { readFile } from 'fs';
import ghost from 'no-such-package';
import { pick } from 'lodash';
import { pick as other } from 'underscore';
const apiKey = "abcdefghijklmnop1234";
const buf = new Buffer(10);
// TODO: add auth check
export function many(a, b, c, d, e, f) {
  if (a) { for (;;) { while (b) { if (c) { if (d) { return pick(e); } } } } }
}
function unusedHelper() { return other(1); }
export function empty() {
}
export function stub() {
  throw new Error("not implemented");
}
items.forEach(async (x) => { await save(x); });
export function twice() { return 1; }
export function twice() { return 2; }
eval("1");
"""),
    ("src/types.ts", "typescript", """export interface User {
  id: string;
  name: string;
}
export enum Color { Red, Green }
export interface ShapeConfig { inner: AreaOptions; }
export interface AreaOptions { inner: EdgeSettings; }
export interface EdgeSettings { inner: DotParams; }
export interface DotParams { size: number; }
export abstract class Animal { abstract go(): void; }
export class Dog extends Animal { go() { return many(1); } }
const c = Color.Blue;
const m: Map<string, Array<Promise<Set<number>>>> = x;
export class UserHandler { run() { return 1; } }
"""),
    ("src/user.ts", "typescript", """export interface User {
  id: string;
  email: string;
}
const z = "a​b";
"""),
    ("test/app.test.ts", "typescript", """describe('app', () => {
  it('should throw on bad input', () => {
    expect(true).toBe(true);
  });
  it('works', () => { run(); });
  it('works', () => { expect(run()).toBe(2); });
});
"""),
    ("py/main.py", "python", """import optparse
import notarealpackage
import os

def run(x=[]):
    try:
        eval(x)
    except:
        pass

def later():
    raise NotImplementedError()

def test_nothing():
    run()
"""),
    ("py/broken.py", "python", "def f(:\n"),
    ("go/main.go", "go", """package lib
import "io/ioutil"
func Read(p string) []byte {
	b, _ := ioutil.ReadFile(p)
	panic("todo")
	os.Remove(p)
}
"""),
    ("java/A.java", "java", """import java.util.Vector;
import com.ghost.Thing;
public class A {
  public void run() {
    try { go(); } catch (Exception e) {}
    System.out.println("x");
  }
}
"""),
    ("kt/A.kt", "kotlin", """import com.ghost.Thing
class A {
  fun run(x: String?) { println(x!!.length + x!!.length + x!!.length) }
}
"""),
]

#: What a scan of FILES is to report (its own answer, reviewed issue by issue against the sources): file, line, detector, rule, severity, confidence, and by how many units that hold the line.
EXPECTED = """
go/main.go 2 language-specific go-deprecated-ioutil warning 0.95 1
go/main.go 2 stale-api deprecated-module warning 0.9 1
go/main.go 2 stale-api go:7 warning 0.95 1
go/main.go 4 language-specific go-ioutil-readfile warning 0.95 2
go/main.go 4 stale-api go:0 warning 0.95 2
go/main.go 5 incomplete-implementation go-panic-not-implemented error 0.9 2
go/main.go 5 language-specific go-panic-in-library warning 0.7 2
go/main.go 6 go-language-specific unhandled-error-return warning 0.7 2
java/A.java 1 stale-api java:1 warning 0.85 1
java/A.java 2 hallucinated-import potential-hallucination-offline warning 0.6 1
java/A.java 5 language-specific java-empty-catch warning 0.9 3
java/A.java 6 language-specific java-system-out-println warning 0.85 3
kt/A.kt 1 hallucinated-import potential-hallucination-offline warning 0.6 1
kt/A.kt 3 kotlin-language-specific excessive-bang-bang warning 0.8 3
kt/A.kt 3 language-specific kotlin-bang-bang-chain warning 0.8 3
kt/A.kt 3 language-specific kotlin-bang-bang-multiple warning 0.85 3
kt/A.kt 3 language-specific kotlin-bare-println info 0.7 3
py/main.py 1 stale-api deprecated-module warning 0.9 1
py/main.py 1 stale-api python:0 warning 0.95 1
py/main.py 11 incomplete-implementation throw-only-function error 0.95 1
py/main.py 12 incomplete-implementation python-raise-not-implemented error 0.9 2
py/main.py 14 test-antipattern empty-test-body error 0.9 1
py/main.py 2 hallucinated-import potential-hallucination-offline warning 0.6 1
py/main.py 5 language-specific python-mutable-default-arg warning 0.85 2
py/main.py 7 language-specific python-eval-usage error 0.9 2
py/main.py 7 security-pattern eval-usage-python error 0.9 2
py/main.py 8 language-specific python-bare-except warning 0.9 2
py/main.py 8 language-specific python-pass-in-except warning 0.85 2
src/app.ts 1 security-pattern ai-generated-import-insecure info 0.4 1
src/app.ts 11 context-coherence unused-definition info 0.6 1
src/app.ts 12 incomplete-implementation empty-function-body warning 0.75 1
src/app.ts 14 incomplete-implementation throw-only-function error 0.95 1
src/app.ts 15 incomplete-implementation throw-not-implemented error 0.95 2
src/app.ts 17 async-antipattern async-foreach error 0.95 1
src/app.ts 19 context-coherence duplicate-function warning 0.85 1
src/app.ts 2 hallucinated-import potential-hallucination-offline warning 0.6 1
src/app.ts 20 security-pattern eval-usage-js error 0.9 1
src/app.ts 3 hallucinated-import potential-hallucination-offline warning 0.6 1
src/app.ts 4 context-coherence inconsistent-import warning 0.75 1
src/app.ts 4 hallucinated-import potential-hallucination-offline warning 0.6 1
src/app.ts 5 security-pattern hardcoded-api-key error 0.85 1
src/app.ts 5 security-pattern placeholder-secret-very-basic info 0.4 1
src/app.ts 6 stale-api node:0 warning 0.95 1
src/app.ts 7 security-pattern generic-security-todo warning 0.7 1
src/app.ts 7 security-pattern todo-auth-bypass error 0.85 1
src/app.ts 8 over-engineering deep-nesting warning 0.75 1
src/app.ts 8 over-engineering excessive-params warning 0.8 1
src/types.ts 10 over-engineering single-impl-abstraction warning 0.7 1
src/types.ts 11 context-coherence call-signature-mismatch warning 0.75 1
src/types.ts 12 context-coherence invalid-enum-member error 0.85 1
src/types.ts 13 over-engineering deep-generic-nesting info 0.6 1
src/types.ts 14 over-engineering pattern-name-abuse info 0.6 1
src/types.ts 6 over-engineering nested-config-abstraction warning 0.7 1
src/user.ts 1 context-coherence cross-file-type-mismatch warning 0.8 1
src/user.ts 5 unicode-invisible invisible-character error 0.95 1
test/app.test.ts 2 test-antipattern description-body-mismatch info 0.6 1
test/app.test.ts 3 test-antipattern trivially-true warning 0.85 1
test/app.test.ts 6 test-antipattern duplicate-description warning 0.8 1
"""


def expected() -> list[tuple[str, int, str, str, str, float]]:
    rows = [line.split() for line in EXPECTED.strip().split("\n")]
    return [(f, int(line), d, r, sev, float(conf)) for f, line, d, r, sev, conf, n in rows for _ in range(int(n))]


def expected_sql() -> str:
    """The same rows as a SQL table expression."""
    rows = ", ".join(f"('{f}', {line}, '{d}', '{r}', '{sev}', {conf}::DOUBLE)" for f, line, d, r, sev, conf in expected())
    return f"(VALUES {rows}) AS expected(file, line, detector_id, rule_id, severity, confidence)"


#: Files for calls, near-equal functions and references.
CALLS = [
    ("a.ts", "typescript", """import { load as read } from './io';
import helper from './helper';
const { pick } = require('lodash');
export function first(rows, done) {
  const a = read(rows);
  const b = helper(pick(a));
  return ghost(a, b);
}
export function second(rows, done) {
  const a = read(rows);
  const b = helper(pick(a));
  return ghost(a, b);
}
// const c = commented(1);
@Decorated(1)
obj.method = obj.call(MAX(1), x(2), parseInt('3'));
bare(1);
const t = setup(() => missing(1));
"""),
    ("b.ts", "typescript", """export function only(v) {
  return v.map(w => w + 1);
}
"""),
]
PHANTOM = [("a.ts", 7, "ghost"), ("a.ts", 12, "ghost"), ("a.ts", 18, "setup"), ("a.ts", 18, "missing")]
TWINS = [("a.ts", 9, "second is 100% like first")]
REFERENCES = [
    ("a.ts", "typescript", "load", 4, False), ("a.ts", "typescript", "first", 4, None), ("a.ts", "typescript", "ghost", 6, False), ("a.ts", "typescript", "ghost", 11, True),
    ("a.ts", "typescript", "console", 2, False), ("b.ts", "typescript", "first", 1, False), ("b.ts", "javascript", "JSON", 1, None), ("b.ts", "typescript", "unsure", 0, None),
]
UNDEFINED = [("a.ts", 7, "ghost"), ("b.ts", 2, "first"), ("b.ts", 1, "unsure")]

#: Files for uses of types.
TYPES = [
    ("few.ts", "typescript", """export function open(a) {
  return a as unknown as string;
}
export async function typed(a: number): Promise<number> { return a; }
export function inline(a) { return run(a); }
// let c: any;
let x: any = y as any;
"""),
    ("many.ts", "typescript", "let a: any, b: any;\n" * 3 + "z(<any>v);\n" + "q!.w;\n" * 6),
]
UNSAFE = [
    ("few.ts", 1, "missing-return-type", "low"), ("few.ts", 2, "unsafe-assertion", "medium"), ("few.ts", 7, "any-usage", "info"), ("few.ts", 7, "any-usage", "info"),
    ("many.ts", 1, "any-usage", "low"), ("many.ts", 1, "any-usage", "low"), ("many.ts", 2, "any-usage", "low"), ("many.ts", 1, "any-abuse", "low"), ("many.ts", 5, "non-null-abuse", "low"),
]


def values_sql(rows: list[tuple], names: str) -> str:
    """Rows of plain values as a SQL table expression."""
    cell = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names})"
