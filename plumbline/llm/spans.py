"""Places of regex matches inside texts, with built-in functions only.

Spark returns the matched strings, not where they stand. The text is also split at
the same matches, so the lengths of the pieces and of the matches add up to the
places. Sums run in chunks, so that a text with very many matches stays linear.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start: int, end: int, hit: string, before: string>>"
CHUNK = 256
BEFORE = 48


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def none() -> Column:
    return F.expr(f"cast(array() as {SPAN})")


def found(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: start, end (code points, exclusive), hit, and what stands before."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(hits, lambda h: F.when(F.size(h) == 0, none()).otherwise(_places(text, pattern, h)))


def _places(text: Column, pattern: str, hits: Column) -> Column:
    rows = F.zip_with(
        F.slice(F.split(text, pattern, -1), 1, F.size(hits)),
        hits,
        lambda piece, hit: F.struct(
            F.length(piece).alias("gap"),
            F.length(hit).alias("size"),
            hit.alias("hit"),
            F.right(piece, F.lit(BEFORE)).alias("before"),
        ),
    )
    return let(rows, lambda r: let(_chunks(r), lambda c: F.flatten(F.zip_with(c, _bases(c), _within))))


def _chunks(rows: Column) -> Column:
    starts = F.sequence(F.lit(0), F.size(rows) - 1, F.lit(CHUNK))
    return F.transform(starts, lambda at: F.slice(rows, at + 1, F.lit(CHUNK)))


def _bases(chunks: Column) -> Column:
    """Where each chunk begins."""
    totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, r: n + r["gap"] + r["size"]))
    begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    return F.aggregate(
        totals,
        begin,
        lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
        lambda a: a["out"],
    )


def _within(chunk: Column, base: Column) -> Column:
    def step(a: Column, r: Column) -> Column:
        start = a["at"] + r["gap"]
        end = start + r["size"]
        span = F.struct(start.alias("start"), end.alias("end"), r["hit"].alias("hit"), r["before"].alias("before"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

    return F.aggregate(chunk, F.struct(base.alias("at"), none().alias("out")), step, lambda a: a["out"])


def in_context(spans: Column) -> Column:
    """Spans of `found` whose `before` is the text before them, earlier matches included.

    It is cut to the last `BEFORE` characters; as no match is empty, so many earlier matches are enough.
    """

    def whole(all_spans: Column, s: Column, i: Column) -> Column:
        earlier = F.slice(all_spans, F.greatest(i - BEFORE + 1, F.lit(1)), F.least(i, F.lit(BEFORE)))
        parts = F.transform(earlier, lambda e: F.concat(e["before"], F.right(e["hit"], F.lit(BEFORE))))
        joined = F.right(F.concat(F.array_join(parts, ""), s["before"]), F.lit(BEFORE))
        return F.when((i == 0) | (F.length(s["before"]) >= BEFORE), s["before"]).otherwise(joined)

    return let(spans, lambda a: F.transform(a, lambda s, i: s.withField("before", whole(a, s, i))))


def tagged(spans: Column, kind: str, order: int) -> Column:
    """Spans with their kind, in a form that sorts by start and then by the order of kinds."""
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")
        ),
    )


def listed(spans: Column) -> Column:
    """kind:start:end of tagged spans, joined by commas in order."""
    one = F.transform(
        F.array_sort(spans),
        lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(one, ",")


def masked(text: Column, spans: Column, mark: str) -> Column:
    """The text with every span (overlapping ones together) replaced by `mark`.

    Spans go in chunks, each with its own stretch of the text, so that a place is sought in a
    stretch and not from the start of the text.
    """
    furthest = lambda rows: F.array_max(F.transform(rows, lambda s: s["end"]))

    def reached(chunks: Column) -> Column:
        """How far the spans before each chunk go, and those of all chunks at the end."""
        return F.aggregate(
            F.transform(chunks, furthest),
            F.array(F.lit(0)),
            lambda out, end: F.concat(out, F.array(F.greatest(F.element_at(out, -1), end))),
        )

    def cut(chunk: Column, base: Column) -> Column:
        stretch = F.substring(text, base + 1, F.greatest(furthest(chunk) - base, F.lit(0)))
        return let(stretch, lambda part: _cut(part, chunk, base, mark))

    def whole(chunks: Column, ends: Column) -> Column:
        bases = F.slice(ends, F.lit(1), F.size(chunks))
        rest = F.substring(text, F.element_at(ends, -1) + 1, F.length(text))
        return F.concat(F.array_join(F.zip_with(chunks, bases, cut), ""), rest)

    chunked = let(F.array_sort(spans), _chunks)
    done = let(chunked, lambda c: let(reached(c), lambda ends: whole(c, ends)))
    return F.when(F.size(spans) == 0, text).otherwise(done)


def _cut(part: Column, chunk: Column, base: Column, mark: str) -> Column:
    """A stretch of text that begins at `base`, with the spans of the chunk replaced."""
    begin = F.struct(base.alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(part, a["at"] - base + 1, s["start"] - a["at"])
        apart = F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(gap, F.lit(mark))).alias("out"))
        joined = F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))
        return F.when(s["start"] >= a["at"], apart).otherwise(joined)

    return F.aggregate(chunk, begin, step, lambda a: F.array_join(a["out"], ""))
