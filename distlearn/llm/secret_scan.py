"""Scanning texts for secrets with a trigram inverted index, by DataFrame functions alone.

Every rule is a regular expression. From its parsed form follows which trigrams (of the lower-cased
text) a match must hold: a conjunction of alternatives, each a set of trigrams. One posting
(trigram, document) is written per trigram that some rule asks for and that a document holds; the
postings of a document are intersected to a bit mask, and rules whose query the mask fulfils are
verified by the expression itself. A rule without mandatory trigrams is run on every text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product
from operator import and_, or_
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

MOST_STRINGS = 64  # alternatives of one stretch of an expression that are spelled out
MOST_LETTERS = 4  # letters of a class that are spelled out
STEP = 256  # lengths summed at a time
SPANS = "array<struct<start:bigint,at:int,end:bigint,kind:string>>"

Clause = frozenset  # of trigrams that must all occur
Query = list[set[Clause]]  # every member: at least one of its clauses holds


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``pattern`` finds it, ``group`` must have ``least`` characters at least."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def either_case(words: str) -> str:
    """The expression with each ASCII letter in either case, without a flag."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else c for c in words)


BASE = (
    Rule(
        "assign",
        "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}"),  # a run of 24 or more is a whole run of [0-9a-f]+
)
FURTHER = (
    Rule("private_key", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)


def trigram_query(pattern: str) -> Query:
    """What trigrams any match holds; an empty query says nothing is mandatory."""
    return _sequence(list(parser.parse(pattern)))[1]


def _trigrams(text: str) -> Clause:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _any_of(strings: set[str]) -> Query:
    """At least one of the strings occurs."""
    clauses = {_trigrams(s) for s in strings}
    if frozenset() in clauses:
        return []
    return [{c for c in clauses if not any(d < c for d in clauses)}]  # a clause within another says it all


def _sequence(nodes: list) -> tuple[set[str] | None, Query]:
    """(all strings it can match, if few; its query)."""
    run, query, whole = {""}, [], True
    for op, arg in nodes:
        strings, inner = _node(str(op), arg)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a, b in product(run, strings)}
            continue
        query += _any_of(run) + inner
        run, whole = strings or {""}, False
    return (run, _any_of(run)) if whole else (None, query + _any_of(run))


def _node(op: str, arg) -> tuple[set[str] | None, Query]:
    if op == "LITERAL":
        return {chr(arg).lower()}, []
    if op == "IN":
        letters: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                letters.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < 64:
                letters |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, []
        return (letters, []) if len(letters) <= MOST_LETTERS else (None, [])
    if op == "SUBPATTERN":
        return _sequence(list(arg[-1]))
    if op == "BRANCH":
        found = [_sequence(list(x)) for x in arg[1]]
        if all(s is not None for s, _ in found) and sum(len(s) for s, _ in found) <= MOST_STRINGS:
            return set().union(*(s for s, _ in found)), []
        if all(q for _, q in found):  # one clause of each part that must hold is enough
            return None, [set().union(*(min(q, key=len) for _, q in found))]
        return None, []
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, inside = arg
        strings, query = _sequence(list(inside))
        if strings is not None and (least, most) == (0, 1):
            return strings | {""}, []
        if least == 0:
            return None, []
        return None, query if strings is None else _any_of(strings)
    return None, []


def _masks(trigrams: list[str]) -> list[dict[str, int]]:
    """Bits of the trigrams in as many 63-bit masks as they need."""
    return [{t: 1 << i for i, t in enumerate(trigrams[at : at + 63])} for at in range(0, len(trigrams), 63)]


def postings(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """(doc_id, trigram): the inverted index, for the given lower-case trigrams."""
    low = F.lower(whole_text())
    held = F.posexplode(F.array(*[F.contains(low, F.lit(t)) for t in trigrams])).alias("at", "holds")
    name = F.element_at(F.array(*map(F.lit, trigrams)), F.col("at") + 1)
    return docs.select("doc_id", held).where("holds").select("doc_id", name.alias("trigram"))


def candidates(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(doc_id, kinds): the rules with mandatory trigrams whose query the document's postings fulfil.

    Postings are combined before the shuffle, one row per document and task.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in queries.values() for alternatives in q for clause in alternatives for t in clause})
    masks = _masks(trigrams)
    index = postings(docs, trigrams)
    bits = [F.coalesce(F.create_map(*[F.lit(x) for t, b in m.items() for x in (t, b)])[F.col("trigram")], F.lit(0)) for m in masks]
    met = index.groupBy("doc_id").agg(*[F.bit_or(b.cast("long")).alias(f"m{i}") for i, b in enumerate(bits)])

    def holds(clause: Clause) -> Column:
        need = [sum(b for t, b in m.items() if t in clause) for m in masks]
        return reduce(and_, [F.col(f"m{i}").bitwiseAND(F.lit(n)) == n for i, n in enumerate(need) if n])

    kinds = [
        F.when(reduce(and_, [reduce(or_, [holds(c) for c in sorted(alternatives, key=sorted)]) for alternatives in q]), F.lit(k))
        for k, q in queries.items()
    ]
    return met.select("doc_id", F.array_compact(F.array(*kinds)).alias("kinds")).where(F.size("kinds") > 0)


def running_sums(lengths: Column) -> Column:
    """Sums up to each element; in two levels, so that long arrays don't cost their square."""
    def sums(values: Column) -> Column:
        last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long"))
        return F.aggregate(values, F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(last(a) + x)))

    parts = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / STEP).cast("int")), lambda i: sums(F.slice(lengths, i * STEP + 1, STEP))
    )
    totals = sums(F.transform(parts, lambda p: F.element_at(p, -1)))
    starts = F.concat(F.array(F.lit(0).cast("bigint")), totals)
    return F.flatten(F.zip_with(parts, F.slice(starts, 1, F.size(parts)), lambda p, s: F.transform(p, lambda x: x + s)))


def _scanned(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(row, text, found): each row of ``docs`` as a struct, so that no column name can clash."""
    indexed = {r.kind for r in rules if trigram_query(r.pattern)}
    asked = candidates(docs, [r for r in rules if r.kind in indexed]).withColumnRenamed("doc_id", "held")
    rows = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text, empty = F.col("text"), F.array().cast("array<string>")
    met = rows.join(asked, rows["doc_id"].eqNullSafe(asked["held"]), "left").select(
        "row", F.coalesce("kinds", empty).alias("kinds"), F.coalesce(F.col("row.text"), F.lit("")).alias("text")
    )
    none = F.array().cast(SPANS)
    for at, r in enumerate(rules):
        pattern = F.lit(r.pattern)
        chosen = F.array_contains("kinds", r.kind) if r.kind in indexed else F.lit(True)
        ask = chosen & F.rlike(text, pattern)
        lengths = lambda group, p=pattern: F.transform(F.regexp_extract_all(text, p, F.lit(group)), lambda m: F.char_length(m).cast("bigint"))
        met = met.withColumn(f"m{at}", F.when(ask, lengths(0))).withColumn(
            f"g{at}", F.when(ask, lengths(r.group)) if r.group else F.col(f"m{at}")
        ).withColumn(
            f"p{at}", F.when(ask, F.transform(F.split(text, r.pattern, -1), lambda s: F.char_length(s).cast("bigint")))
        )
    for at, r in enumerate(rules):
        matches, groups, pieces = F.col(f"m{at}"), F.col(f"g{at}"), F.col(f"p{at}")
        ends = running_sums(F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda a, b: a + b))
        spans = F.zip_with(
            F.zip_with(ends, matches, lambda e, m: F.struct((e - m).alias("start"), F.lit(at).alias("at"), e.alias("end"), F.lit(r.kind).alias("kind"))),
            groups,
            lambda s, g: F.when(g >= r.least, s),
        )
        met = met.withColumn(f"s{at}", F.when(F.size(matches) > 0, F.array_compact(spans)).otherwise(none).cast(SPANS))
    return met.select("row", "text", F.array_sort(F.concat(*[F.col(f"s{at}") for at in range(len(rules))])).alias("found"))


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = BASE + FURTHER) -> DataFrame:
    """All columns of ``docs`` and ``found``: array of (start, at, end, kind), sorted by start, then rule.

    Offsets count code points of the whole text, end exclusive; ``at`` is the rule's place in the
    list. Matches of a rule are leftmost and don't overlap each other; those whose group is too short
    are dropped after matching. A null text is empty and has no spans; each row gives one row, equal
    ids and nulls included; an empty table gives an empty result. A column called ``found`` is replaced.
    """
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c != "found"]
    return _scanned(docs, rules).select(*kept, "found")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, base: Sequence[Rule] = BASE) -> DataFrame:
    """doc_id, n_<kind> of the base rules, base_sha256 of their spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    kept = F.filter("found", lambda s: s["at"] < len(base))
    return found.select(
        "doc_id", *[count(r.kind) for r in base], F.sha2(listed(kept).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans")
    )


def redact(docs: DataFrame, rules: Sequence[Rule] = BASE + FURTHER, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans become one mark.

    A null text stays null; texts without a span are unchanged.
    """
    text, size = F.col("text"), F.char_length("text").cast("bigint")
    kind = "array<struct<start:bigint,end:bigint>>"
    newest = lambda a: F.try_element_at(a, F.lit(-1))
    span = lambda start, end: F.array(F.struct(start.alias("start"), end.alias("end"))).cast(kind)
    merged = F.aggregate(
        "found",
        F.array().cast(kind),
        lambda a, s: F.when(
            (F.size(a) > 0) & (newest(a)["end"] > s["start"]),
            F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), span(newest(a)["start"], F.greatest(newest(a)["end"], s["end"]))),
        ).otherwise(F.concat(a, span(s["start"], s["end"]))),
    )
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("spans", lambda s: s["end"]))
    ends = F.concat(F.transform("spans", lambda s: s["start"]), F.array(size))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substr(text, (a + 1).cast("int"), (b - a).cast("int")))
    clean = F.when(F.size("found") == 0, F.col("row.text")).otherwise(F.array_join(pieces, mark))
    marked = _scanned(docs, rules).withColumn("spans", merged)
    return marked.select(*[clean.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
