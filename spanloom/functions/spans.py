"""Spans inside one row, as Column expressions: array<struct<s int, e int, type string>>, half-open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokenize

SPANS = "array<struct<s:int,e:int,type:string>>"


def span(s: Column, e: Column, kind: Column) -> Column:
    return F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"), kind.alias("type"))


def overlap(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def _ranked(spans: Column, *keys: Callable[[Column], Column]) -> Column:
    """Sorted ascending by the keys, then by the span itself."""
    keyed = F.transform(spans, lambda x: F.struct(*[k(x).alias(f"k{i}") for i, k in enumerate(keys)], x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda y: y["x"])


def greedy(ranked: Column, most: int | None = None, kind: str = SPANS) -> Column:
    """Take spans in the given order unless they overlap one taken before; at most ``most``."""

    def step(taken: Column, x: Column) -> Column:
        skip = F.exists(taken, lambda y: overlap(x, y))
        if most is not None:
            skip = skip | (F.size(taken) >= most)
        return F.when(skip, taken).otherwise(F.concat(taken, F.array(x)))

    return F.aggregate(ranked, F.array().cast(kind), step)


def non_overlapping(spans: Column) -> Column:
    """Longest first, then leftmost, then by type; the result by start."""
    return F.array_sort(greedy(_ranked(F.array_distinct(spans), lambda x: x["s"] - x["e"], lambda x: x["s"], lambda x: x["type"])))


def merge_layers(first: Column, second: Column) -> Column:
    """Spans of the first layer, and those of the second that touch none of them nor each other."""
    return F.array_sort(greedy(F.concat(_ranked(first, lambda x: x["s"]), _ranked(F.array_distinct(second), lambda x: x["s"] - x["e"], lambda x: x["s"]))))


def spans_to_bio(spans: Column, n: Column) -> Column:
    """Labels of n tokens; of overlapping spans the first in order stays.

    Spans that stay lie apart and in order, so each gives the outside labels before it and its own; spans that are apart already
    need no choice.
    """

    def apart(x: Column) -> Column:
        return F.forall(F.sequence(F.lit(1), F.size(x)), lambda i: (x[i - 1]["s"] < x[i - 1]["e"]) & ((i == 1) | (F.try_element_at(x, F.greatest(i - 1, F.lit(1)))["e"] <= x[i - 1]["s"])))

    def inside(x: Column) -> Column:
        """Spans cut to the n tokens, with whether their first token is among them."""
        cut = F.transform(x, lambda y: F.struct(F.greatest(y["s"], F.lit(0)).alias("s"), F.least(y["e"], n).alias("e"), y["type"].alias("type"), (y["s"] >= 0).alias("whole")))
        return F.filter(cut, lambda y: y["s"] < y["e"])

    def labels(x: Column) -> Column:
        def of(y: Column, i: Column) -> Column:
            before = F.when(i > 0, F.try_element_at(x, F.greatest(i, F.lit(1)))["e"]).otherwise(0)
            first = F.when(y["whole"], F.concat(F.lit("B-"), y["type"])).otherwise(F.concat(F.lit("I-"), y["type"]))
            return F.concat(F.array_repeat(F.lit("O"), y["s"] - before), F.array(first), F.array_repeat(F.concat(F.lit("I-"), y["type"]), y["e"] - y["s"] - 1))

        end = F.coalesce(F.try_element_at(x, F.lit(-1))["e"], F.lit(0))
        return F.concat(F.flatten(F.transform(x, of)), F.array_repeat(F.lit("O"), n - end))

    made = let(F.array_sort(spans), lambda x: let(F.when((F.size(x) == 0) | apart(x), x).otherwise(greedy(x)), lambda y: let(inside(y), labels)))
    return F.when(n > 0, made).otherwise(F.array().cast("array<string>"))


def bio_to_spans(labels: Column) -> Column:
    """struct(spans, repaired) of B-, I- and O labels; an I- that continues no span of its type opens one (a repair).

    One fold over the row's labels; :func:`spanloom.operators.spans.bio_spans` is the same over rows of tokens.
    """
    start = F.struct(F.array().cast(SPANS).alias("spans"), F.lit(0).alias("i"), F.lit(0).alias("repaired"))

    def step(a: Column, label: Column) -> Column:
        kind, prefix = F.substring(label, 3, 1 << 30), F.substring(label, 1, 2)
        last = F.try_element_at(a["spans"], F.lit(-1))
        goes_on = F.coalesce((prefix == "I-") & (last["e"] == a["i"]) & (last["type"] == kind), F.lit(False))
        opens = prefix.isin("B-", "I-") & ~goes_on
        grown = F.concat(F.slice(a["spans"], 1, F.greatest(F.size(a["spans"]) - 1, F.lit(0))), F.array(span(last["s"], a["i"] + 1, last["type"])))
        spans = F.when(goes_on, grown).when(opens, F.concat(a["spans"], F.array(span(a["i"], a["i"] + 1, kind)))).otherwise(a["spans"])
        return F.struct(spans.alias("spans"), (a["i"] + 1).alias("i"), (a["repaired"] + (opens & (prefix == "I-")).cast("int")).alias("repaired"))

    return F.aggregate(labels, start, step, lambda a: F.struct(a["spans"], a["repaired"]))


def occurrences(tokens: Column, part: Column) -> Column:
    """Start indices at which ``part`` lies in ``tokens``."""
    n, k = F.size(tokens), F.size(part)
    starts = F.when((k > 0) & (k <= n), F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: F.slice(tokens, i + 1, k) == part)


def _at(starts: Column, size: Column, kind: Column) -> Column:
    return F.when(F.size(starts) > 0, F.transform(starts, lambda i: span(i, i + size, kind)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: an expression that lambdas mention is otherwise computed anew for every element."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def align(tokens: Column, text: Column, kind: Column) -> Column:
    """All places of a predicted string: by white space, then without case, then by the tokenizer, then without case."""

    def places(x: Column) -> Column:
        found = []
        for part in ("by_space", "by_token"):
            for hay, needle in (("tokens", part), ("lowered", f"{part}_lowered")):
                found.append(_at(occurrences(x[hay], x[needle]), F.size(x[needle]), kind))
        return F.coalesce(*found, F.array().cast(SPANS))

    by_space = F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")
    by_token = tokenize(F.trim(text))
    sides = {"tokens": tokens, "lowered": F.transform(tokens, F.lower)}
    for name, part in (("by_space", by_space), ("by_token", by_token)):
        sides |= {name: part, f"{name}_lowered": F.transform(part, F.lower)}
    return let(F.struct(*[v.alias(k) for k, v in sides.items()]), places)


def lenient_matches(gold: Column, pred: Column) -> Column:
    """How many predictions meet a gold span of their type that none before has taken, both in order."""
    start = F.struct(F.array_sort(gold).alias("left"), F.lit(0).alias("n"))

    def step(a: Column, p: Column) -> Column:
        hits = F.transform(a["left"], lambda g: overlap(g, p) & (g["type"] == p["type"]))
        at = F.coalesce(F.array_position(hits, F.lit(True)), F.lit(0)).cast("int")
        rest = F.concat(F.slice(a["left"], 1, F.greatest(at - 1, F.lit(0))), F.slice(a["left"], at + 1, F.size(a["left"])))
        return F.when(at > 0, F.struct(rest.alias("left"), (a["n"] + 1).alias("n"))).otherwise(a)

    return F.aggregate(F.array_sort(pred), start, step, lambda a: a["n"])


def entity_of(tokens: Column, x: Column, entities: Column) -> Column:
    """The first entity (text, type, ...) of the span's type whose tokens equal the span's without case."""
    own = F.transform(F.slice(tokens, x["s"] + 1, x["e"] - x["s"]), F.lower)

    def equal(e: Column) -> Column:
        text = F.lower(F.trim(e["text"]))
        return (e["type"] == x["type"]) & ((F.filter(F.split(text, r"\s+"), lambda w: w != "") == own) | (tokenize(text) == own))

    return F.try_element_at(F.filter(entities, equal), F.lit(1))


def source_of(text: Column, kind: Column, entities: Column) -> Column:
    """The first entity that an unaligned prediction came from: equal text without outer blanks, and equal type."""
    return F.try_element_at(F.filter(entities, lambda e: (F.trim(e["text"]) == F.trim(text)) & e["type"].eqNullSafe(kind)), F.lit(1))


def chars_to_tokens(tokens: Column, start: Column, end: Column) -> Column:
    """The half-open token span that a half-open character span of the joined text touches, or null."""
    offsets = F.aggregate(
        tokens,
        F.array().cast("array<struct<a:int,b:int>>"),
        lambda acc, t: F.concat(acc, F.array(F.struct(F.coalesce(F.try_element_at(acc, F.lit(-1))["b"] + 1, F.lit(0)).alias("a"), (F.coalesce(F.try_element_at(acc, F.lit(-1))["b"] + 1, F.lit(0)) + F.length(t)).alias("b")))),
    )
    hits = F.filter(F.transform(offsets, lambda o, i: F.when((o["a"] < end) & (start < o["b"]), i)), lambda i: i.isNotNull())
    return F.when(F.size(hits) > 0, F.struct(F.array_min(hits).alias("s"), (F.array_max(hits) + 1).alias("e")))
