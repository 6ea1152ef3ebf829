"""Column expressions, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import tables


def literal_map(values: dict, key: Column, default) -> Column:
    """Look a key up in a small fixed table."""
    out = F.lit(default)
    for k, v in reversed(list(values.items())):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def half_up(x: Column, digits: int = 0) -> Column:
    """Round halves up on binary doubles, as floor(x * 10^d + 0.5) / 10^d."""
    m = 10**digits
    return F.floor(x * m + 0.5) / m


def grade(score: Column, plus: bool = True) -> Column:
    out = F.lit("F")
    for at, g in reversed(tables.GRADES):
        if plus or g != "A+":
            out = F.when(score >= at, g).otherwise(out)
    return out


def lines(text: Column) -> Column:
    """Lines of a text; a trailing line end leaves an empty last line."""
    return F.split(text, "\n", -1)


def line_of(text: Column, offset: Column) -> Column:
    """0-based line that holds a 0-based offset."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n", -1)) - 1


def is_comment(line: Column) -> Column:
    return F.ltrim(line).rlike(r"^(//|#|\*|/\*)")


def tokens(text: Column) -> Column:
    """Lower-case tokens of over one character; camelCase and snake_case are split."""
    split = F.translate(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(split, F.lit("[a-z0-9]{2,}"), F.lit(0))


def squeezed(line: Column) -> Column:
    """A line trimmed, runs of white space as one space."""
    return F.regexp_replace(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\s+", " ")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for unequal lengths, empty and zero vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)


def normalised(v: Column) -> Column:
    """A vector of length 1; a zero vector as it is."""
    n = F.sqrt(dot(v, v))
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def package_name(language: Column, module: Column) -> Column:
    """Package of an imported module by language."""
    scoped = F.concat_ws("/", F.slice(F.split(module, "/"), 1, 2))
    npm = F.when(module.startswith("@"), scoped).otherwise(F.element_at(F.split(module, "/"), 1))
    go = F.when(F.element_at(F.split(module, "/"), 1).contains("."), F.concat_ws("/", F.slice(F.split(module, "/"), 1, 3))).otherwise(module)
    return F.when(language.isin("typescript", "javascript"), npm).when(language == "python", F.element_at(F.split(module, r"\."), 1)).when(language == "go", go).otherwise(module)


#: Ranges of invisible code points (ends included).
INVISIBLE = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180E), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xE000, 0xF8FF), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0),
    (0xFFF0, 0xFFFB), (0xE0000, 0xE007F), (0xE0100, 0xE01EF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD),
]


def invisible(code: Column) -> Column:
    """The code point is invisible or a non-character."""
    out = (code.bitwiseAND(0xFFFE) == 0xFFFE) | code.between(0xFDD0, 0xFDEF)
    for a, b in INVISIBLE:
        out = out | code.between(a, b)
    return out


def code_label(code: Column) -> Column:
    h = F.hex(code)
    return F.concat(F.lit("U+"), F.when(F.length(h) < 4, F.lpad(h, 4, "0")).otherwise(h))


def fingerprint(file: Column, line: Column, message: Column, size: int = 40) -> Column:
    return F.substring(F.base64(F.concat_ws(":", file, line, message).cast("binary")), 1, size)


def html_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def severity_of(word: Column) -> Column:
    """Severity that a model's reply names."""
    s = F.lower(F.coalesce(word, F.lit("info")))
    return F.when(s.isin("error", "critical"), "error").when(s.isin("warning", "warn"), "warning").otherwise("info")


def category_of(word: Column) -> Column:
    c = F.lower(word)
    has = lambda *ws: F.greatest(*[c.contains(w) for w in ws]) if len(ws) > 1 else c.contains(ws[0])
    return F.when(has("faithful", "hallucin"), "ai-faithfulness").when(has("fresh", "stale", "deprecat"), "code-freshness").when(has("coher", "context"), "context-coherence").otherwise("implementation")


def sla_target_ms(files: Column, level: str) -> Column:
    return F.greatest(F.lit(1000), F.ceil(files / 100 * (tables.SLA_SECONDS[level] * 1000))).cast("long")


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return literal_map(tables.LANGUAGE_BY_EXTENSION, ext, None)


def excluded(path: Column, names=tuple(tables.EXCLUDED_DIRS)) -> Column:
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin(*names))
