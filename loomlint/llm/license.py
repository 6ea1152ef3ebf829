"""License scans: MinHash bands retrieve templates, exact shingle containment verifies (DataFrame operations only).

A text's words (runs of a-z and 0-9 after lower-casing A-Z) make 5-word
shingles, hashed once. Templates are of size classes of 1, 2, 4, ... shingles.
For each class the text is cut into overlapping windows: with a stride of half
the class, a window is so wide that any run of as many shingles as the class
has lies in one whole. A window's MinHash sketch has ``BANDS`` bands of ``ROWS`` rows; it
retrieves the templates of its class that have the same values in all rows of
some band.

Collision probability: a template of n shingles (over half its class c), of
which 0.8 n stand in a window of 1.5 c, has a Jaccard similarity s of 0.4 / 1.6 =
0.25 to the window at least; 1 - (1 - s ** ROWS) ** BANDS is then 0.998. Where n
is 1 or 2 the window is as wide as the template and s is 1. A whole template
has s of 0.5 / 1.5 at least, and a probability over 0.99998.

Two filters ahead of the sketches lose none of these: a text that has no shingle
of any template is not cut into windows, and a window is sketched if it holds
0.8 times as many shingles of templates of its class as the least of them has.

Retrieved templates are verified on the whole text: the share of the
template's distinct shingles that occur must be ``CONTAINED`` or more. All of
it happens within a row: nothing is shuffled. Templates are a dictionary or a
table (license, text) of at most ``TEMPLATE_BYTES``, else an error.

A template of fewer than five words has no shingle: it is looked for as one
sequence of whole words, in every text. A template without a word is an error.

Defined results: null and empty texts have no license, texts of fewer than five
words only one of a template as short; a template that occurs many times counts
once; a template whose shingles are strewn over a text, farther apart than a
window, may not be retrieved; repeated rows get equal results; an empty table
gives an empty result; texts of any length are scanned whole; a column named
licenses is replaced, others stay, whatever their names.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common
from .license_texts import TEMPLATES

SHINGLE = 5
BANDS, ROWS = 96, 2
CONTAINED = 0.8
TEMPLATE_BYTES = 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))


def template_shingles(text: str) -> list[str]:
    """Distinct shingles of a template, in order."""
    w = template_words(text)
    return list(dict.fromkeys(" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)))


def _chain(*values: int) -> int:
    """What F.xxhash64 makes of 64-bit values, signed."""
    h = 42
    for v in values:
        h = xxh64_intdigest((v % (1 << 64)).to_bytes(8, "little"), h)
    return _signed64(h)


def _signed64(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _hash(shingle: str) -> int:
    """What F.xxhash64 makes of the hashes of a shingle's words."""
    return _chain(*[xxh64_intdigest(w.encode(), 42) for w in shingle.split(" ")])


def size_class(n: int) -> int:
    return 1 << (n - 1).bit_length()


def bands(hashes: list[int]) -> list[int]:
    """Band values of the sketch of a template."""
    c = size_class(len(hashes))
    least = [min(_chain(h, i) for h in hashes) for i in range(BANDS * ROWS)]
    return [_chain(c, j, *least[j * ROWS : (j + 1) * ROWS]) for j in range(BANDS)]


def _let(value: Column, then) -> Column:
    return F.element_at(F.transform(F.array(value), then), 1)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("[a-z0-9]+"), F.lit(0))


def _shingles(items: Column, join) -> Column:
    """One value for each run of SHINGLE items."""
    runs = F.sequence(F.lit(0), F.size(items) - SHINGLE)
    return F.when(F.size(items) < SHINGLE, F.array()).otherwise(F.transform(runs, lambda i: join(*[F.get(items, i + k) for k in range(SHINGLE)])))


def retrieved(hashes: Column, templates: dict[str, list[int]], keys: list[int]) -> Column:
    """Band values of a text's windows that are among ``keys``, those of the templates, given by their shingles' hashes."""
    none = F.array().cast("array<bigint>")
    long_ = lambda v: F.lit(v).cast("long")

    def sketched(window: Column, c: int) -> Column:
        least = lambda i: F.array_min(F.transform(window, lambda h: F.xxhash64(h, i)))
        return F.transform(F.sequence(long_(0), long_(BANDS - 1)), lambda j: F.xxhash64(long_(c), j, *[least(j * ROWS + r) for r in range(ROWS)]))

    def of_class(c: int) -> Column:
        known = sorted({h for t in templates.values() if size_class(len(t)) == c for h in t})
        fewest = math.ceil(CONTAINED * min(len(t) for t in templates.values() if size_class(len(t)) == c) - 1e-9)
        stride = max(1, c // 2)
        width = c + stride - 1
        # places of the class's shingles tell which windows are worth a look
        at = F.filter(F.transform(hashes, lambda h, i: F.when(h.isin(known), i)), lambda i: i.isNotNull())
        starts = F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(F.greatest(F.lit(0), F.floor((i - width + stride) / stride).cast("int")), F.floor(i / stride).cast("int")))))
        worth = lambda w: F.size(F.filter(w, lambda h: h.isin(known))) >= fewest
        look = lambda w: F.when(worth(w), F.filter(sketched(w, c), lambda k: k.isin(keys))).otherwise(none)
        return F.flatten(F.transform(starts, lambda s: _let(F.slice(hashes, s * stride + 1, F.lit(width)), look)))

    every = sorted({h for t in templates.values() for h in t})
    classes = sorted({size_class(len(t)) for t in templates.values()})
    return F.when(F.exists(hashes, lambda h: h.isin(every)), F.array_distinct(F.concat(*[of_class(c) for c in classes]))).otherwise(none)


def _templates(templates: dict[str, str] | DataFrame | None) -> dict[str, str]:
    if templates is None:
        return TEMPLATES
    if isinstance(templates, DataFrame):
        size = templates.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        if size > TEMPLATE_BYTES:
            raise ValueError(f"templates of {size} bytes; {TEMPLATE_BYTES} at most")
        return {r["license"]: r["text"] or "" for r in templates.select("license", "text").collect()}
    return templates


def scan(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, text: str = "text") -> DataFrame:
    """Adds licenses: [(license, containment)] by license to ``docs``."""
    templates = _templates(templates)
    docs = docs.drop("licenses")
    parts = {k: template_shingles(v) for k, v in sorted(templates.items())}
    short = {k: " ".join(template_words(templates[k])) for k, v in parts.items() if not v}
    if empty := [k for k, v in short.items() if not v]:
        raise ValueError(f"templates without a word: {', '.join(empty)}")
    hashed = {k: [_hash(s) for s in v] for k, v in parts.items() if v}
    banded = {k: bands(v) for k, v in hashed.items()}
    keys = sorted({b for v in banded.values() for b in v})
    none = F.array().cast("array<struct<license:string,containment:double>>")
    own = common.spare(docs, "_found")
    # a text that lacks the longest word of every short template is not put together for them
    telling = sorted({_signed64(xxh64_intdigest(max(v.split(" "), key=len).encode(), 42)) for v in short.values()})
    ws = lambda: words(F.coalesce(F.col(text), F.lit("")))
    bands_in = lambda h: _let(_shingles(h, F.xxhash64).cast("array<bigint>"), lambda x: retrieved(x, hashed, keys)) if hashed else F.array().cast("array<bigint>")
    seen = lambda h: F.struct(bands_in(h).alias("bands"), F.exists(h, lambda v: v.isin(telling)).alias("short"))
    x = docs.withColumn(own, _let(F.transform(ws(), lambda w: F.xxhash64(w)), seen))

    def met(found: Column, values: list[int]) -> Column:
        return F.exists(found, lambda f: f.isin(values))

    def verified(found: Column, shingles: Column) -> Column:
        rows = []
        for k in hashed:
            share = F.size(F.array_intersect(shingles, F.array(*map(F.lit, parts[k])))) / F.lit(float(len(parts[k])))
            rows.append(F.struct(F.lit(k).alias("license"), F.when(met(found, banded[k]), share).otherwise(F.lit(0.0)).alias("containment")))
        return F.filter(F.array(*rows), lambda r: r["containment"] >= CONTAINED)

    strings = _let(ws(), lambda w: _shingles(w, lambda *c: F.concat_ws(" ", *c)).cast("array<string>"))
    matched = _let(F.struct(F.col(own)["bands"].alias("f"), strings.alias("s")), lambda z: verified(z["f"], z["s"])) if hashed else none
    licenses = F.when(F.size(F.col(own)["bands"]) > 0, matched).otherwise(none)
    if short:
        whole = F.concat(F.lit(" "), F.array_join(ws(), " "), F.lit(" "))
        rows = lambda t: F.array(*[F.struct(F.lit(k).alias("license"), t.contains(f" {v} ").cast("double").alias("containment")) for k, v in short.items()])
        licenses = F.array_sort(F.concat(licenses, F.when(F.col(own)["short"], _let(whole, lambda t: F.filter(rows(t), lambda r: r["containment"] == 1))).otherwise(none)))
    return x.withColumn("licenses", licenses).drop(own)


def op8_license(spark, sf_dir: str) -> DataFrame:
    x = scan(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return x.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(F.transform("licenses", lambda r: r["license"]), ",").alias("licenses"),
        F.round(F.array_max(F.transform("licenses", lambda r: r["containment"])), 6).alias("containment"),
    )


def oracle() -> str:
    """DuckDB SQL of op8_license: every template against every text, without retrieval."""
    rows = ", ".join(f"('{k}', '{s}')" for k, v in sorted(TEMPLATES.items()) for s in template_shingles(v))
    short = ", ".join(f"('{k}', '{' '.join(template_words(v))}')" for k, v in sorted(TEMPLATES.items()) if not template_shingles(v))
    return f"""
WITH t(license, shingle) AS (VALUES {rows}),
u(license, phrase) AS (VALUES {short}),
n AS (SELECT license, count(*) AS n FROM t GROUP BY license),
w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z0-9]+') AS w FROM documents),
g AS (SELECT r, w, unnest(range(1, len(w) - {SHINGLE} + 2)) AS i FROM w),
s AS (SELECT DISTINCT r, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS shingle FROM g),
c AS (SELECT r, license, count(*) AS k FROM s JOIN t USING (shingle) GROUP BY r, license),
m AS (SELECT r, license, k / n.n AS containment FROM c JOIN n USING (license) WHERE k / n.n >= {CONTAINED}
      UNION ALL SELECT r, license, 1.0 FROM w JOIN u ON contains(' ' || array_to_string(w, ' ') || ' ', ' ' || phrase || ' '))
SELECT w.doc_id, count(m.license)::BIGINT AS n_licenses, coalesce(string_agg(m.license, ',' ORDER BY m.license), '') AS licenses,
       round(max(m.containment), 6)::DOUBLE AS containment
FROM w LEFT JOIN m USING (r) GROUP BY w.r, w.doc_id
"""
