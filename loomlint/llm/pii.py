"""Personal data by bootstrapped contextual extraction (DataFrame operations only).

Seeds are e-mail addresses, IP addresses, payment cards and phone numbers that
fixed rules find. The contexts of seed entities induce lexical patterns: the
two words before, the word before and the word after, the word before, and the
word before with the shape of the value (its runs of digits, capitals and small
letters); words of a context are without the punctuation around them. A
context ends at a token with a digit or an @. Every seed is an instance of the
patterns it stands in, and so is every other token with a digit that isn't part
of a seed, which makes a bipartite graph of patterns and instances with counts.
In rounds, a pattern's confidence is the share of its instances that are known
entities; patterns with enough distinct known instances and enough confidence
are promoted; unknown instances that promoted patterns vouch for (noisy or)
become known, and the next round scores the graph anew, until a round finds
nothing new. Occurrences of discovered instances in promoted contexts are spans
of kind ``context``. Words without a digit are seeds only, never discovered.

Offsets come from splitting a text by a rule: the lengths of gaps and matches
add up. Sums go over chunks of ``CHUNK`` matches, so a text of very many
matches isn't quadratic. The rules use possessive repeats and look-behind so
that no text makes them backtrack; they match what the plain rules match.

One pass reads the texts and writes spans and instances (not the texts, unless
asked for) to the shared folder; the graph is built from there.

Joins spread a hot pattern or value over salted keys.

Defined results: null and empty texts have no spans; overlapping spans of
different kinds are all reported, and ``redact`` writes them as one, named by
the longest of those that start first; columns named like the result's are
replaced by ``detect`` and kept by ``redact``; repeated rows get equal spans; ids may be
null or repeated, as rows are told apart by a number of their own; an empty
table gives an empty result; texts of any length are searched whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# The rules' patterns. They match exactly what the plain forms
#   [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   [0-9]([\x20-]?[0-9])+          of 13 digits or more
#   \+[0-9][\x20().0-9-]+[0-9]     of 9 digits or more
# match, leftmost and without overlap, but never backtrack into a run.
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9]){8,}+",
}
KINDS = ("email", "ip", "card", "phone")
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
#: What a pattern can vouch for: a phone-like run, or a word with a digit in it.
INSTANCE = r"\+[0-9](?:[\x20().-]*+[0-9]){8,}+\S*+|(?<!\S)[^\s0-9]*+[0-9]\S*+"
#: Characters of text that a context may reach over.
REACH = 64
CHUNK = 256
#: A promoted pattern has so many distinct known instances and so much confidence.
SUPPORT = 5
CONFIDENCE = 0.9
#: An instance is discovered at this noisy-or score.
ACCEPT = 0.99


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _running(steps: Column) -> Column:
    """Running sums of an array of lengths, by chunks."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int")), lambda i: F.slice(steps, i * CHUNK + 1, F.lit(CHUNK)))
    within = lambda c: F.transform(c, lambda _, i: total(F.slice(c, F.lit(1), i + 1)))
    ahead = lambda sums: F.transform(sums, lambda _, i: total(F.slice(sums, F.lit(1), i)))
    whole = _let(chunks, lambda cs: F.zip_with(cs, _let(F.transform(cs, total), ahead), lambda c, o: F.transform(within(c), lambda x: x + o)))
    return F.when(F.size(steps) == 0, F.array().cast("array<int>")).otherwise(F.flatten(whole))


def _matches(text: Column, rule: str) -> Column:
    """[(start, end, value, gap before, gap after)] of the rule's matches in code points."""
    found = F.struct(F.regexp_extract_all(text, F.lit(rule), F.lit(0)).alias("m"), F.split(text, rule, -1).alias("g"))
    tail, head = lambda g: F.substring(g, -REACH, REACH), lambda g: F.substring(g, 1, REACH)

    def placed(f: Column) -> Column:
        steps = F.zip_with(f["m"], F.slice(f["g"], F.lit(1), F.size(f["m"])), lambda m, g: F.length(m) + F.length(g))
        gaps = F.transform(f["m"], lambda _, i: F.struct(tail(F.get(f["g"], i)).alias("before"), head(F.get(f["g"], i + 1)).alias("after")))
        return F.zip_with(F.arrays_zip(f["m"].alias("m"), gaps.alias("c")), _let(steps, _running), lambda x, e: F.struct((e - F.length(x["m"])).alias("start"), e.alias("end"), x["m"].alias("value"), x["c"]["before"].alias("before"), x["c"]["after"].alias("after")))

    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    return _let(found, lambda f: F.when(F.size(f["m"]) == 0, none).otherwise(placed(f)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(IP_PARTS)
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _valid(kind: str) -> Callable[[Column], Column]:
    return lambda x: (x != "") & _holds(kind, x)


def seeds(text: Column, kind: str) -> Column:
    """[(start, end, value, gap before, gap after)] of what one rule finds."""
    maybe = text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9]")
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    return F.when(maybe, F.filter(_matches(text, RULES[kind]), lambda s: _holds(kind, s["value"]))).otherwise(none)


def _bare(spans: Column) -> Column:
    """The spans without their gaps."""
    return F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["value"]))


def _word(gap: Column, last: bool, n: int = 1) -> Column:
    words = F.filter(F.split(F.lower(gap), r"\s+"), lambda w: w != "")
    bare = lambda w: F.coalesce(F.nullif(F.regexp_replace(w, r"^[^\p{L}]++|(?<!\P{L})\P{L}++$", ""), F.lit("")), w)
    return F.coalesce(_let(F.get(words, F.size(words) - n if last else F.lit(n - 1)), bare), F.lit("#"))


def _shape(value: Column) -> Column:
    """Runs of digits by length, runs of capitals and small letters as one each."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), r"\p{Lu}+", "A"), r"\p{Ll}+", "a")


def _instance(s: Column, known: bool) -> Column:
    # what is glued to the value is no context, nor is what lies beyond other instances
    before, after = F.regexp_replace(s["before"], r"(?s)^.*[0-9@]\S*|\S+$", ""), F.regexp_replace(s["after"], r"(?s)^\S+|\S*[0-9@].*$", "")
    l1, l2, r1 = _word(before, True), _word(before, True, 2), _word(after, False)
    patterns = F.array(F.concat(F.lit("2 "), l2, F.lit(" "), l1, F.lit(" _")), F.concat(F.lit("1 "), l1, F.lit(" _ "), r1), F.concat(F.lit("1 "), l1, F.lit(" _")), F.concat(F.lit("s "), l1, F.lit(" "), _shape(s["value"])))
    return F.struct(s["start"], s["end"], s["value"], F.lit(known).alias("known"), patterns.alias("patterns"))


def instances(text: Column, found: dict[str, Column]) -> Column:
    """[(start, end, value, known, patterns)] of the seeds and of the tokens that patterns can vouch for."""

    def seed(v: Column) -> Column:
        known = v.rlike(RULES["email"])
        for kind in ("ip", "card", "phone"):
            known = known | _let(F.regexp_extract(v, RULES[kind], 0), _valid(kind))
        return known

    # a seed of one token is seen in the token; one of many tokens is told by its place
    many = F.filter(F.concat(found["card"], found["phone"]), lambda s: s["value"].contains(" "))
    free = lambda wide: F.filter(_matches(text, INSTANCE), lambda s: ~seed(s["value"]) & ~F.exists(wide, lambda w: (w["start"] < s["end"]) & (s["start"] < w["end"])))
    none = F.array().cast("array<struct<start:int,end:int,value:string,known:boolean,patterns:array<string>>>")
    others = F.when(text.rlike("[0-9]"), _let(many, lambda wide: F.transform(free(wide), lambda s: _instance(s, False)))).otherwise(none)
    return F.concat(*[F.transform(found[k], lambda s: _instance(s, True)) for k in KINDS], others)


def learn(graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(promoted patterns, discovered values) of a graph (pattern, value, n, known)."""
    known = common.save(graph.where("known").select("value").distinct(), "known")
    first = known
    while True:
        marked = common.salted_join(graph, known.withColumn("_known", F.lit(True)), "value", F.col("pattern"), "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
        marked = common.save(marked.select("pattern", "value", "n", F.col("_known").alias("is_known")), "marked")
        scored = marked.groupBy("pattern").agg(
            F.sum(F.when(F.col("is_known"), F.col("n")).otherwise(0)).alias("hits"), F.sum("n").alias("n"), F.sum(F.col("is_known").cast("int")).alias("support")
        )
        scored = scored.withColumn("confidence", F.col("hits") / (F.col("n") + 1)).where((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE))
        promoted = common.save(scored.select("pattern", "confidence"), "promoted")
        vouched = common.salted_join(marked.where(~F.col("is_known")), promoted, "pattern", F.col("value")).groupBy("value").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        new = common.save(vouched.where(F.col("score") >= ACCEPT).select("value"), "discovered")
        common.discard(marked)
        if new.isEmpty():
            break
        common.discard(promoted)
        known = common.save(known.unionByName(new), "known")
    return promoted, known.join(first, "value", "left_anti")


def _detect(docs: DataFrame, keep: list[str]) -> DataFrame:
    """kept (a struct of the columns ``keep``), email, ip, card, phone and context."""
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")
    found = docs.select(kept, F.monotonically_increasing_id().alias("_row"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    found = found.select("kept", "_row", "_text", *[seeds(F.col("_text"), k).alias(k) for k in KINDS])
    own = {k: F.col(k) for k in KINDS}
    found = found.select("kept", "_row", *[_bare(c).alias(k) for k, c in own.items()], instances(F.col("_text"), own).alias("_instances"))
    found = common.save(found, "pii-found")
    each = found.where(F.size("_instances") > 0).select("_row", F.explode("_instances").alias("i"))
    edges = each.select(F.explode("i.patterns").alias("pattern"), F.col("i.value").alias("value"), F.col("i.known").alias("known"))
    graph = common.save(edges.groupBy("pattern", "value").agg(F.count("*").alias("n"), F.max("known").alias("known")), "pii-graph")
    promoted, discovered = learn(graph)
    more = each.select("_row", "i.start", "i.end", "i.value", "i.patterns")
    more = common.salted_join(more, discovered, "value", F.col("_row")).select("_row", "start", "end", "value", F.explode("patterns").alias("pattern"))
    more = common.salted_join(more, promoted.select("pattern"), "pattern", F.col("_row"), "left_semi")
    more = common.save(more.groupBy("_row").agg(F.collect_set(F.struct("start", "end", "value")).alias("context")), "pii-context")
    common.discard(graph)
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    base = F.concat(*[F.col(k) for k in KINDS])
    clear = F.filter("context", lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    if more.isEmpty():
        return found.select("kept", *KINDS, none.alias("context"))
    out = found.where(F.size("_instances") > 0).join(more, "_row", "left").withColumn("context", F.coalesce(F.array_sort(clear), none))
    return out.select("kept", *KINDS, "context").unionByName(found.where(F.size("_instances") == 0).select("kept", *KINDS, none.alias("context")))


def detect(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs``, email, ip, card, phone and context: arrays of (start, end, value)."""
    keep = [c for c in keep if c.lower() not in (*KINDS, "context")]
    return _detect(docs, keep).select("kept.*", *KINDS, "context")


def _marked(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(kind.upper()).alias("kind"))


def _named(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; n_chars of a changed text follows it."""
    names = docs.columns
    # spans that overlap become one, of the kind of the first, of the longest if several start there
    spans = F.array_sort(F.concat(*[F.transform(k, _marked(k)) for k in (*KINDS, "context")]))
    spans = F.transform(spans, lambda s: F.struct(s["start"], (-s["back"]).alias("end"), s["kind"]))
    start = F.struct(F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("done"), F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit("").alias("kind")).alias("open"))

    def step(s: Column, x: Column) -> Column:
        joined = F.struct(s["open"]["start"].alias("start"), F.greatest(s["open"]["end"], x["end"]).alias("end"), s["open"]["kind"].alias("kind"))
        done = F.when(s["open"]["start"] < 0, s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
        return F.when(x["start"] < s["open"]["end"], F.struct(s["done"].alias("done"), joined.alias("open"))).otherwise(F.struct(done.alias("done"), x.alias("open")))

    merged = F.aggregate(F.col("_spans"), start, step, lambda s: F.when(s["open"]["start"] < 0, s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
    end = lambda m, i: F.coalesce(F.get(m, i - 1)["end"], F.lit(0))
    pieces = lambda t, m: F.transform(m, lambda s, i: F.concat(F.substring(t, end(m, i) + 1, s["start"] - end(m, i)), F.lit("["), s["kind"], F.lit("]")))
    text = F.col("kept.`text`")
    whole = lambda m: F.concat(F.array_join(pieces(text, m), ""), F.substring(text, F.element_at(m, -1)["end"] + 1, F.length(text)))
    x = _detect(docs, names).select("kept", spans.alias("_spans"))
    clean = F.size("_spans") == 0
    x = x.select("kept", F.when(clean, text).otherwise(_let(merged, whole)).alias("_new"))
    n_chars = [c for c in names if c.lower() == "n_chars"]
    same = F.col("_new").eqNullSafe(text)
    new = {"text": F.col("_new")} | {c: F.when(same, F.col(f"kept.`{c}`")).otherwise(F.length("_new").cast(docs.schema[c].dataType)) for c in n_chars}
    return x.select(*[new.get(c.lower() if c.lower() == "text" else c, F.col(f"kept.`{c}`")).alias(c) for c in names])


def digest(spans: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of what ``detect`` returns."""
    named = lambda kinds: F.concat(*[F.transform(k, _named(k)) for k in kinds])
    return spans.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(named(KINDS), ",").cast("binary"), 256).alias("base_sha256"), F.array_join(named((*KINDS, "context")), ",").alias("spans"),
    )


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return digest(detect(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]))
