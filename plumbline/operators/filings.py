"""Filing evidence: form limits and excerpts around section headings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.functions.text_config import (
    AFTER_HEADING,
    BEFORE_HEADING,
    EXCERPT_SIZE,
    HEADINGS,
    MERGE_GAP,
    RESEARCH_FORM_LIMITS,
    SECTION_SIZE,
    SEPARATOR,
)
from plumbline.sources.landed import literal_map, within_form_limits


def per_form(values: Mapping[str, int]) -> Column:
    return F.try_element_at(literal_map(values), F.col("filing_type"))


def newest_per_form(filings: DataFrame, limits: Mapping[str, int] = RESEARCH_FORM_LIMITS) -> DataFrame:
    order = [F.desc_nulls_last("filing_date"), F.desc("filing_id")]
    return within_form_limits(filings, order, limits)


def keyword_windows(body: Column) -> Column:
    """[start, end) spans around the first two hits of each heading."""
    headings = F.try_element_at(
        F.create_map(
            *[x for form, words in HEADINGS.items() for x in (F.lit(form), F.array(*[F.lit(w) for w in words]))]
        ),
        F.col("filing_type"),
    )

    def locate(word: Column, lower: Column, after: Column) -> Column:
        """0-based hit at or after a position, NULL when there is none."""
        return F.nullif(F.call_function("locate", word, lower, after + 1), F.lit(0)) - 1

    def spans(hits: Column, before: Column, behind: Column, size: Column) -> Column:
        return F.transform(
            F.filter(hits, lambda f: f["at"].isNotNull()),
            lambda f: F.struct(
                F.greatest(f["at"] - before, F.lit(0)).alias("start"),
                F.least(f["at"] + F.length(f["w"]) + behind, size).alias("end"),
            ),
        )

    def search(t: Column) -> Column:
        firsts = F.transform(headings, lambda w: F.struct(w.alias("w"), locate(w, t["lower"], F.lit(0)).alias("at")))
        both = F.flatten(
            F.transform(
                F.filter(firsts, lambda f: f["at"].isNotNull()),
                lambda f: F.array(
                    f, F.struct(f["w"].alias("w"), locate(f["w"], t["lower"], f["at"] + F.length(f["w"])).alias("at"))
                ),
            )
        )
        return F.array_sort(spans(both, t["before"], t["behind"], t["size"]))

    # one-element arrays bind the lower-cased text once for all headings
    bound = F.struct(
        F.lower(body).alias("lower"),
        per_form(BEFORE_HEADING).alias("before"),
        per_form(AFTER_HEADING).alias("behind"),
        F.length(body).alias("size"),
    )
    return F.coalesce(
        F.try_element_at(F.transform(F.array(bound), search), F.lit(1)),
        F.array().cast("array<struct<start:int,end:int>>"),
    )


def merged_windows(windows: Column, gap: int = MERGE_GAP) -> Column:
    """Sorted spans with those at most `gap` apart joined."""
    empty = F.filter(windows, lambda w: F.lit(False))

    def step(acc: Column, w: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], w["end"]).alias("end"))),
        )
        near = (F.size(acc) > 0) & (w["start"] <= last["end"] + gap)
        return F.when(near, joined).otherwise(F.concat(acc, F.array(w)))

    return F.aggregate(windows, empty, step)


def cut_windows(body: Column, windows: Column, section_size: Column) -> Column:
    """Section texts, trimmed to word or sentence edges and to a size."""

    def cut(w: Column) -> Column:
        def opened(section: Column) -> Column:
            space = F.instr(section, " ") - 1
            inside = (w["start"] > 0) & (space >= 0) & (space <= 80)
            return F.when(inside, F.substring(section, space + 2, F.length(section))).otherwise(section)

        def closed(part: Column) -> Column:
            return F.when(w["end"] < F.length(body), text.boundary_cut(part, F.length(part))).otherwise(part)

        # each stage of the text is computed once and handed on
        section = F.trim(F.substring(body, w["start"] + 1, w["end"] - w["start"]))
        return text.truncate(text.bound(text.bound(section, opened), closed), section_size)

    return F.filter(F.transform(windows, cut), lambda s: s.isNotNull() & (s != ""))


def with_excerpt(filings: DataFrame, limit: int | None = None) -> DataFrame:
    """Adds relevant_excerpt: sections around headings, else the start."""
    size = F.lit(limit) if limit is not None else per_form(EXCERPT_SIZE)
    rows = filings.withColumn("_body", text.clean(F.col("raw_text")))
    rows = rows.withColumn("_windows", merged_windows(keyword_windows(F.col("_body"))))
    count = F.size("_windows")
    budget = F.greatest(
        F.floor(F.greatest(size - len(SEPARATOR) * (count - 1), F.lit(1)) / F.greatest(count, F.lit(1))), F.lit(1)
    )
    section = F.when(count > 0, F.least(per_form(SECTION_SIZE), budget)).otherwise(per_form(SECTION_SIZE))
    rows = rows.withColumn("_section", section.cast("int"))
    rows = rows.withColumn("_parts", cut_windows(F.col("_body"), F.col("_windows"), F.col("_section")))
    stitched = F.when(F.size("_parts") > 0, F.array_join("_parts", SEPARATOR)).otherwise(F.col("_body"))
    return rows.withColumn("relevant_excerpt", text.truncate(stitched, size)).drop(
        "_body", "_windows", "_section", "_parts"
    )
