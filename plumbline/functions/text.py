"""Text columns: cleaning, cutting, tokens. Built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text_config import TITLE_STOPWORDS


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, also inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean(text: Column) -> Column:
    """Whitespace collapsed and trimmed, empty becomes NULL."""
    return F.nullif(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def search_text(text: Column) -> Column:
    return F.coalesce(clean(F.lower(text)), F.lit(""))


def last_index(text: Column, char: str) -> Column:
    """0-based position of the last `char`, -1 when absent."""
    back = F.instr(F.reverse(text), char)
    return F.when(back > 0, F.length(text) - back).otherwise(F.lit(-1))


def head(text: Column, n: Column) -> Column:
    return F.substring(text, F.lit(1), n.cast("int"))


def truncate(text: Column, limit: Column) -> Column:
    """Cut to `limit`, back to the last space when it is in the last fifth."""

    def shortened(cut: Column) -> Column:
        late = lambda space: F.when(space >= F.floor(limit * 0.8), head(cut, space)).otherwise(cut)
        return F.concat(F.rtrim(bound(last_index(cut, " "), late)), F.lit(" ..."))

    def cut(cleaned: Column) -> Column:
        return F.when(F.length(cleaned) <= limit, cleaned).otherwise(bound(head(cleaned, limit), shortened))

    return bound(clean(text), cut)


def boundary_cut(text: Column, limit: Column) -> Column:
    """Back to a late period, else to a late space."""

    def cut(body: Column) -> Column:
        def at(ends: Column) -> Column:
            return (
                F.when(ends["period"] >= F.floor(limit * 0.75), head(body, ends["period"] + 1))
                .when(ends["space"] >= F.floor(limit * 0.85), head(body, ends["space"]))
                .otherwise(body)
            )

        return bound(F.struct(last_index(body, ".").alias("period"), last_index(body, " ").alias("space")), at)

    return bound(text, cut)


def raw_excerpt(text: Column, limit: int = 4000) -> Column:
    def cut(cleaned: Column) -> Column:
        short = boundary_cut(head(cleaned, F.lit(limit)), F.lit(limit))
        return F.when(F.length(cleaned) <= limit, cleaned).otherwise(F.concat(F.rtrim(short), F.lit(" ...")))

    return bound(clean(text), cut)


def title_tokens(title: Column) -> Column:
    """Distinct lower-case words of two or more characters, no stop words."""
    words = F.regexp_extract_all(search_text(title), F.lit("[a-z0-9]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in TITLE_STOPWORDS])
    return F.array_except(F.filter(words, lambda w: F.length(w) >= 2), stop)


def jaccard(left: Column, right: Column) -> Column:
    common = F.size(F.array_intersect(left, right))
    return F.coalesce(F.try_divide(common, F.size(left) + F.size(right) - common), F.lit(0.0))


def mentions(ticker: Column, text: Column) -> Column:
    """Ticker or cashtag as a whole token, any case."""
    pattern = F.concat(
        F.lit(r"(?i)(?:^|[^A-Za-z0-9])\$?\Q"), ticker, F.lit(r"\E(?:$|[^A-Za-z0-9])")
    )
    return F.coalesce(F.regexp(text, pattern), F.lit(False))


def term_hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms occur in normalised text."""
    hits = F.lit(0)
    for term in terms:
        hits = hits + F.contains(text, F.lit(term)).cast("int")
    return hits
