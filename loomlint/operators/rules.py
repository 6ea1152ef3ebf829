"""Rules over lines: literal patterns, compiled once a task, one pass over a text, no join."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


@dataclass(frozen=True)
class Rule:
    """A line rule. ``pattern`` and the excludes are Java regular expressions."""

    id: str
    pattern: str
    severity: str = "warning"
    confidence: float = 0.8
    languages: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    #: Lines after the current one that the pattern may reach over.
    window: int = 0
    #: Excludes look at this many lines before and after.
    around: tuple[int, int] = (0, 0)
    #: all: every line; code: lines that aren't comments.
    where: str = "all"
    category: str = "implementation"
    message: str = ""
    fields: dict = field(default_factory=dict, compare=False)


def _joined(lines: Column, i: Column, before: int, after: int) -> Column:
    start = F.greatest(i - before, F.lit(0))
    return F.array_join(F.slice(lines, start + 1, i - start + 1 + after), "\n")


def may_match(text: Column, rule: Rule) -> Column:
    """Whether a rule can match any line of a text; true where that can't be told from the whole.

    A line that matches makes the whole text match, with anchors at line ends,
    unless the pattern looks around: what it sees past the line differs.
    """
    if any(x in rule.pattern for x in ("(?=", "(?!", "(?<")):
        return F.lit(True)
    return text.rlike("(?m)" + rule.pattern.replace(r"\A", "^"))


def hits(lines: Column, rules: list[Rule], language: Column | None = None, possible: list[Column] | None = None) -> Column:
    """[(line, rule)] of a text's lines (0-based) by rules in order; ``possible``: of each rule, whether it can match, its languages included."""

    def at(line: Column, i: Column) -> Column:
        comment = C.is_comment(line)
        found = []
        for n, r in enumerate(rules):
            text = _joined(lines, i, 0, r.window) if r.window else line
            ok = text.rlike(r.pattern)
            if r.languages and language is not None and possible is None:
                ok = language.isin(*r.languages) & ok
            if possible is not None:
                ok = possible[n] & ok
            if r.where == "code":
                ok = ~comment & ok
            scope = _joined(lines, i, *r.around) if any(r.around) else line
            for x in r.excludes:
                ok = ok & ~scope.rlike(x)
            found.append(F.when(ok, F.struct(i.alias("line"), F.lit(r.id).alias("rule"))))
        return F.filter(F.array(*found), lambda h: h.isNotNull())

    return F.flatten(F.transform(lines, at))


def scan(docs: DataFrame, rules: list[Rule], key: list[str], text: str = "text", language: str | None = None) -> DataFrame:
    """One row per (text, line, rule) that matches: key, line_no (1-based), rule_id, severity, category, confidence, line_text."""
    # rules are tried on whole texts first; only texts and rules that match are looked at by line
    lang = F.col(language) if language else None
    spoken = {ls: lang.isin(*ls) for ls in {r.languages for r in rules if r.languages}} if language else {}
    of = lambda r: spoken[r.languages] & may_match(F.col(text), r) if r.languages in spoken else may_match(F.col(text), r)
    x = docs.select(*key, F.col(text).alias("_text"), *([language] if language and language not in key else []), F.array(*[of(r) for r in rules]).alias("_m"))
    x = x.where(F.array_contains("_m", True)).withColumn("_lines", C.lines(F.col("_text")))
    groups = [(i, rules[i : i + 20]) for i in range(0, len(rules), 20)]
    found = F.concat(*[hits(F.col("_lines"), g, lang, [F.get("_m", F.lit(i + n)) for n in range(len(g))]) for i, g in groups])
    x = x.select(*key, "_lines", F.explode(found).alias("_h"))
    by = {r.id: r for r in rules}
    look = lambda attr, default: C.literal_map({k: getattr(r, attr) for k, r in by.items()}, F.col("_h.rule"), default)
    return x.select(
        *key, (F.col("_h.line") + 1).alias("line_no"), F.col("_h.rule").alias("rule_id"), look("severity", "info").alias("severity"),
        look("category", "implementation").alias("category"), look("confidence", 0.0).alias("confidence"), F.get("_lines", F.col("_h.line")).alias("line_text"),
    )


def previous_line(docs: DataFrame, key: list[str], pattern: str, directive: str, text: str = "text") -> DataFrame:
    """Lines that match, and whether the line before holds a directive to suppress."""
    ls = C.lines(F.col(text))
    found = F.filter(F.transform(ls, lambda line, i: F.struct(i.alias("i"), line.alias("line"))), lambda s: s["line"].rlike(pattern))
    x = docs.select(*key, ls.alias("_lines"), F.explode(found).alias("h"))
    before = F.coalesce(F.get("_lines", F.col("h.i") - 1), F.lit(""))
    return x.select(*key, (F.col("h.i") + 1).alias("line_no"), before.rlike(directive).alias("suppressed"))
