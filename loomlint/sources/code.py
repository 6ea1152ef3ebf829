"""Code units of source files: functions, classes, methods, with imports, calls and complexity.

Python is read with ``ast``; brace languages with a conservative lexer that
blanks strings and comments and matches braces. A file that can't be read
gives a row of scan errors instead of failing the job.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = (
    "file string, language string, ord int, kind string, name string, parent string, start_line int, end_line int, source string, exported boolean, "
    "cyclomatic int, cognitive int, max_nesting int, loc int, param_count int, "
    "imports array<struct<module:string,symbols:array<string>,line:int,is_relative:boolean>>, "
    "calls array<struct<callee:string,method:string,line:int,arg_count:int>>, error string"
)
FIELDS = [x.split()[0] for x in re.split(r", (?=\w+ (?:string|int|boolean|array))", UNIT)]
_KEYWORDS = set("if for while switch catch return function new typeof else do try when in is as await yield throw sizeof defer go func fun def class super this print assert select case and or not lambda async import constructor".split())
_BRANCH = {
    "typescript": r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?(?![.?:])", "java": r"\b(?:if|for|while|catch|switch)\b|&&|\|\||\?(?!>)",
    "go": r"\b(?:if|for|switch|case|select)\b|&&|\|\|", "kotlin": r"\b(?:if|for|while|when|catch)\b|->|\?:|&&|\|\|",
}
_CONTROL = re.compile(r"\b(?:if|for|while|switch|catch|try|else|when|select|do)\b[^{};]*$")
_DECL = {
    "typescript": [("class", r"(?P<exp>export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface|enum)\s+(?P<name>\w+)"), ("function", r"(?P<exp>export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>\w+)\s*(?:<[^>{}]*>)?\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)"), ("function", r"(?P<exp>export\s+)?(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=;{}]+)?=\s*(?:async\s*)?(?:\((?P<params>[^()]*)\)|\w+)\s*(?::[^=;{}]+)?=>")],
    "java": [("class", r"(?P<exp>public\s+)?(?:(?:abstract|final|static|private|protected)\s+)*(?:class|interface|enum|record)\s+(?P<name>\w+)")],
    "go": [("function", r"\bfunc\s+(?P<recv>\([^)]*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)"), ("class", r"\btype\s+(?P<name>\w+)\s+(?:struct|interface)\b")],
    "kotlin": [("class", r"(?P<hid>(?:private|protected|internal)\s+)?(?:(?:data|sealed|abstract|open|enum|inner)\s+)*(?:class|interface|object)\s+(?P<name>\w+)"), ("function", r"(?P<hid>(?:private|protected|internal)\s+)?(?:(?:suspend|override|inline|open)\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(?P<name>\w+)\s*\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)")],
}
_METHOD = {
    "typescript": r"(?:^|[;{}\n])\s*(?P<mod>(?:(?:public|private|protected|static|async|override|get|set|readonly)\s+)*)(?P<name>[A-Za-z_$#]\w*)\s*(?:<[^>{}]*>)?\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?::[^{};=]+)?(?=\{)",
    "java": r"(?:^|[;{}\n])\s*(?:@\w+(?:\([^)]*\))?\s*)*(?P<mod>(?:(?:public|private|protected|static|final|abstract|synchronized|default)\s+)*)(?:<[^>]*>\s*)?(?:[\w.<>\[\],? ]+\s+)?(?P<name>\w+)\s*\((?P<params>[^()]*)\)\s*(?:throws\s+[\w., ]+)?(?=\{)",
    "kotlin": _DECL["kotlin"][1][1],
}


def masked(text: str, language: str) -> str:
    """Text with strings and comments as spaces; line ends stay."""
    marks = r"//[^\n]*|/\*.*?(?:\*/|$)|\"\"\".*?(?:\"\"\"|$)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?" + (r"|`(?:\\.|[^`\\])*`?" if language in ("typescript", "go") else "")
    return re.sub(marks, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def body_end(text: str, at: int) -> int:
    """Place after the brace that closes the first one from ``at``; -1 without any."""
    start = text.find("{", at)
    if start < 0:
        return -1
    depth = 0
    for m in re.finditer(r"[{}]", text[start:]):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return start + m.end()
    return len(text)


def loc(source: str) -> int:
    return sum(1 for x in map(str.strip, source.split("\n")) if x and not x.startswith(("//", "/*", "*", "#")))


def complexity(text: str, language: str) -> tuple[int, int, int]:
    """Cyclomatic, cognitive and nesting of masked text."""
    cyclomatic = 1 + len(re.findall(_BRANCH[language], text))
    stack: list[bool] = []
    cognitive = deepest = last = 0
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            control = bool(_CONTROL.search(re.sub(r"\([^()]*\)", "()", text[last : m.start()])))
            depth = sum(stack)
            cognitive += (1 + depth) if control else 0
            stack.append(control)
            deepest = max(deepest, sum(stack))
        elif stack:
            stack.pop()
        last = m.end()
    return cyclomatic, cognitive, deepest


def _params(text: str | None) -> int:
    if not text or not text.strip():
        return 0
    depth, n = 0, 1
    for c in text:
        depth += c in "([{<"
        depth -= c in ")]}>"
        n += c == "," and not depth
    return n - text.rstrip().endswith(",")


def calls(text: str, base: int) -> list[tuple]:
    out = []
    for m in re.finditer(r"(?<![\w.])([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\(", text):
        callee = m[1]
        method = callee.split(".")[-1]
        if method in _KEYWORDS or re.search(r"\b(?:function|func|fun|def|class|new)\s+$", text[max(0, m.start() - 12) : m.start()]):
            continue
        depth, end = 1, m.end()
        while end < len(text) and depth:
            depth += text[end] in "([{"
            depth -= text[end] in ")]}"
            end += 1
        if "." not in callee and re.match(r"\s*(?:(?::|throws\b)[^{};=]*|\w+\s*)?\{", text[end:]):
            continue  # a declaration
        out.append((callee, method, base + text.count("\n", 0, m.start()), _params(text[m.end() : end - 1].replace("<", " ").replace(">", " "))))
    return out


def imports(text: str, language: str) -> list[tuple]:
    out = []
    for line, s in enumerate(text.split("\n")):
        if language == "typescript":
            for m in re.finditer(r"(?:\bimport\s+(?P<what>[^'\"]*?)\s*(?:\bfrom\s*)?|\brequire\s*\(\s*|\bexport\s+[^'\"]*?\bfrom\s*)['\"](?P<mod>[^'\"]+)['\"]", s):
                what = re.sub(r"^type\s+", "", m["what"] or "")
                names = [x.strip().split(" as ")[0].strip() for x in re.sub(r"[{}]", ",", what).split(",") if x.strip()]
                out.append((m["mod"], names, line, m["mod"][0] in "./"))
        elif language in ("java", "kotlin"):
            if m := re.match(r"\s*import\s+(?:static\s+)?([\w.]+)(\.\*)?", s):
                whole, star = m[1], bool(m[2])
                out.append((whole if star else whole.rpartition(".")[0], ["*"] if star else [whole.rpartition(".")[2]], line, False))
    if language == "go":
        for m in re.finditer(r"import\s+(?:\((?P<many>[^)]*)\)|(?P<one>(?:[\w.]+\s+)?\"[^\"]+\"))", text):
            for x in re.finditer(r"(?P<alias>[\w.]+\s+)?\"(?P<mod>[^\"]+)\"", m["many"] or m["one"]):
                out.append((x["mod"], [x["alias"].strip()] if x["alias"] else [], text.count("\n", 0, m.start(0) + (m[0].find(x[0]))), x["mod"].startswith(".")))
    return out


def brace_units(file: str, text: str, language: str) -> list[dict]:
    bare = masked(text, language)
    whole = complexity(bare, language)
    line = lambda at: text.count("\n", 0, at)
    out = [dict(kind="file", name=file, parent=None, a=0, b=len(text), exported=False, params=0, c=whole)]
    depth, opens = [0] * (len(bare) + 1), 0
    for i, ch in enumerate(bare):
        opens -= ch == "}"
        depth[i] = opens
        opens += ch == "{"
    for kind, rule in _DECL[language]:
        for m in re.finditer(rule, bare):
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            if depth[start] != 0:
                continue
            g, end = m.groupdict(), body_end(bare, m.end())
            stop = bare.find(";", m.end())
            if end < 0 or (0 <= stop < bare.find("{", m.end())):
                end = stop + 1 if stop >= 0 else len(text)
            name = g["name"]
            exported = bool(g.get("exp")) if language in ("typescript", "java") else name[:1].isupper() if language == "go" else not g.get("hid")
            unit = "method" if g.get("recv") else kind
            out.append(dict(kind=unit, name=name, parent=file, a=start, b=end, exported=exported, params=_params(g.get("params")), c=complexity(bare[start:end], language)))
            if kind == "class" and language in _METHOD:
                inner = bare.find("{", m.end())
                for x in re.finditer(_METHOD[language], bare[inner + 1 : end - 1]) if 0 <= inner < end else ():
                    at = inner + 1 + x.start("name")
                    if depth[at] != 1 or x["name"] in _KEYWORDS:
                        continue
                    stop = body_end(bare, inner + 1 + x.end())
                    first = inner + 1 + x.start() + len(x[0]) - len(x[0].lstrip(" \n\t;{}"))
                    private = re.search(r"private|protected|internal", x.groupdict().get("mod") or x.groupdict().get("hid") or "")
                    out.append(dict(kind="method", name=x["name"], parent=name, a=first, b=stop if stop > 0 else end, exported=not private, params=_params(x["params"]), c=complexity(bare[first:stop], language)))
    for u in out:
        u |= {"start": line(u["a"]), "end": line(max(u["a"], u["b"] - 1)), "source": text[u["a"] : u["b"]], "calls": calls(bare[u["a"] : u["b"]], line(u["a"])), "imports": imports(text, language) if u["kind"] == "file" else []}
    return out


class _Python(ast.NodeVisitor):
    def __init__(self) -> None:
        self.cyclomatic, self.cognitive, self.depth, self.deepest = 1, 0, 0, 0

    def generic_visit(self, node: ast.AST) -> None:
        if isinstance(node, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.IfExp)):
            self.cyclomatic += 1
            self.cognitive += 1 + self.depth
            self.depth += 1
            self.deepest = max(self.deepest, self.depth)
            super().generic_visit(node)
            self.depth -= 1
            return
        if isinstance(node, ast.BoolOp):
            self.cyclomatic += len(node.values) - 1
            self.cognitive += 1
        super().generic_visit(node)


def python_units(file: str, text: str) -> list[dict]:
    tree, lines = ast.parse(text), text.split("\n")

    def unit(node: ast.AST, kind: str, name: str, parent: str | None) -> dict:
        first = min([getattr(node, "lineno", 1), *[d.lineno for d in getattr(node, "decorator_list", [])]]) - 1
        last = getattr(node, "end_lineno", len(lines)) - 1
        v = _Python()
        for child in ast.iter_child_nodes(node):
            v.visit(child)
        params = 0
        if hasattr(node, "args") and isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            a = node.args
            params = len([x for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg] if x and x.arg not in ("self", "cls")])
        found, imported = [], []
        for x in ast.walk(node):
            if isinstance(x, ast.Call):
                callee = ast.unparse(x.func)
                if re.fullmatch(r"[\w.]+", callee):
                    found.append((callee, callee.split(".")[-1], x.lineno - 1, len(x.args) + len(x.keywords)))
            elif kind == "file" and isinstance(x, ast.Import):
                imported += [(n.name, [], x.lineno - 1, False) for n in x.names]
            elif kind == "file" and isinstance(x, ast.ImportFrom):
                imported.append(("." * x.level + (x.module or ""), [n.name for n in x.names], x.lineno - 1, x.level > 0))
        return dict(kind=kind, name=name, parent=parent, start=first, end=last, source="\n".join(lines[first : last + 1]), exported=not name.startswith("_") or name == "__init__", params=params, c=(v.cyclomatic, v.cognitive, v.deepest), calls=found, imports=imported)

    out = [unit(tree, "file", file, None)]
    out[0]["exported"] = False
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(unit(node, "function", node.name, file))
        elif isinstance(node, ast.ClassDef):
            out.append(unit(node, "class", node.name, file))
            out += [unit(x, "method", x.name, node.name) for x in node.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
    return out


def units_of(file: str, language: str, text: str) -> list[tuple]:
    """Rows of UNIT of one file."""
    try:
        found = python_units(file, text) if language == "python" else brace_units(file, text, language)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [(file, language, -1, "error", file, None, 0, 0, "", False, 0, 0, 0, 0, 0, [], [], str(e)[:200])]
    return [
        (file, language, i, u["kind"], u["name"], u["parent"], u["start"], u["end"], u["source"], u["exported"], *u["c"], loc(u["source"]), u["params"], u["imports"], u["calls"], None)
        for i, u in enumerate(found)
    ]


def extract_units(files: DataFrame) -> DataFrame:
    """Units of ``files`` (file, language, content); languages that can't be read give none."""

    def run(batches) -> Iterator:
        import pandas as pd

        for b in batches:
            rows = [r for f, lang, text in zip(b["file"], b["language"], b["content"], strict=True) if text is not None for r in units_of(f, lang, text)]
            yield pd.DataFrame(rows, columns=FIELDS)

    known = F.col("language").isin("python", "typescript", "java", "go", "kotlin")
    return files.where(known).select("file", "language", "content").mapInPandas(run, UNIT)
