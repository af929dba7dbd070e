"""News evidence: relevance, ranking, duplicate removal, selection."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.functions.scalars import date_array
from plumbline.functions.text_config import (
    LOW_RELEVANCE_TERMS,
    MATERIAL_TERMS,
    MIN_RELEVANCE,
    TITLE_SIMILARITY,
)
from plumbline.sources.stored import settle

GROUP = ["as_of_date", "ticker"]


def in_view(articles: DataFrame, dates: Sequence[date], days_back: int = 90) -> DataFrame:
    """Articles published in the `days_back` days up to each research date."""
    seen = F.filter(
        date_array(dates),
        lambda d: (F.col("published_on") <= d) & (F.col("published_on") >= F.date_sub(d, days_back)),
    )
    return articles.withColumn("as_of_date", F.explode(seen))


def relevance(articles: DataFrame) -> DataFrame:
    """Adds relevance_score; needs as_of_date, company_name, title, summary."""
    title_raw, summary_raw = text.clean(F.col("title")), text.clean(F.col("summary"))
    base = articles.withColumns(
        {
            "_title": F.coalesce(title_raw, F.lit("")),
            "_summary": F.coalesce(summary_raw, F.lit("")),
            "_name": text.search_text(F.col("company_name")),
        }
    ).withColumns({"_t": text.search_text(F.col("_title")), "_s": text.search_text(F.col("_summary"))})
    low = F.lit(0)
    for term in LOW_RELEVANCE_TERMS:
        low = low + (F.contains("_t", F.lit(term)) | F.contains("_s", F.lit(term))).cast("int")
    base = base.withColumns(
        {
            "_in_title": text.mentions(F.col("ticker"), F.col("_title")),
            "_in_summary": text.mentions(F.col("ticker"), F.col("_summary")),
            "_mt": text.term_hits(F.col("_t"), MATERIAL_TERMS),
            "_ms": text.term_hits(F.col("_s"), MATERIAL_TERMS),
            "_low": low,
            "_nt": (F.col("_name") != "") & F.contains("_t", F.col("_name")),
            "_ns": (F.col("_name") != "") & F.contains("_s", F.col("_name")),
            "_short": F.regexp_extract("_name", "[a-z0-9]+", 0),
        }
    )
    word = F.concat(F.lit(r"\b"), F.col("_short"), F.lit(r"\b"))
    named = F.length("_short") >= 4
    age = F.datediff("as_of_date", "published_on")

    def points(condition: Column, value: float) -> Column:
        return F.when(condition, value).otherwise(0.0)

    direct = F.col("_in_title") | F.col("_in_summary") | F.col("_nt") | F.col("_ns")
    score = (
        points(F.col("_in_title"), 5.0)
        + points(F.col("_in_summary"), 2.5)
        + points(F.col("_nt"), 5.0)
        + points(F.col("_ns"), 2.5)
        + points(named & F.regexp("_t", word), 2.0)
        + points(named & F.regexp("_s", word), 1.0)
        + F.least(F.col("_mt") * 1.25, F.lit(4.0))
        + F.least(F.col("_ms") * 0.5, F.lit(3.0))
        - F.least(F.col("_low") * 1.75, F.lit(5.0))
        - points(~direct & (F.col("_mt") == 0) & (F.col("_ms") == 0), 3.0)
        - points(F.col("_summary") == "", 0.75)
        - points(F.col("_title") == "", 2.0)
        + F.when(age <= 7, 1.25).when(age <= 30, 0.75).when(age <= 90, 0.25).otherwise(0.0)
    )
    score = F.when(F.col("published_on") > F.col("as_of_date"), -1.0).otherwise(F.round(score, 6))
    return base.select(*articles.columns, score.alias("relevance_score"))


def rank_order() -> Column:
    """Sort key of an article: best first when ascending, unique by id."""
    return F.struct(
        (-F.col("relevance_score")).alias("a"),
        (-F.unix_date("published_on")).alias("b"),
        F.col("news_article_id").alias("c"),
    )


def same_event(url: Column, tokens: Column, other_url: Column, other_tokens: Column, threshold: float) -> Column:
    same_url = F.coalesce(text.clean(url) == text.clean(other_url), F.lit(False))
    return same_url | (text.jaccard(tokens, other_tokens) >= threshold)


def _similar_titles(titles: DataFrame, threshold: float) -> DataFrame:
    """(group, title, other): all pairs of different token sets that are similar, both ways.

    Similar sets share a token among the first n - ceil(threshold * n) + 1 of any common
    order. Tokens are ordered by how many titles of the group hold them, rarest first, so a
    word that all titles share brings none together.
    """
    tokens = titles.select(*GROUP, "title", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    shared = tokens.groupBy(*GROUP, "token").agg(F.count("*").alias("titles"))
    rare_first = (
        tokens.join(shared, [*GROUP, "token"])
        .groupBy(*GROUP, "title", "n")
        .agg(F.array_sort(F.collect_list(F.struct("titles", "token"))).alias("ordered"))
    )
    length = (F.col("n") - F.ceil(F.col("n") * F.lit(threshold)) + 1).cast("int")
    prefix = rare_first.select(*GROUP, "title", "n", F.explode(F.slice("ordered", 1, length)).alias("p")).select(
        *GROUP, "title", "n", F.col("p.token").alias("token")
    )
    other = prefix.select(*GROUP, "token", F.col("title").alias("other"), F.col("n").alias("m"))
    near = (F.col("n") >= F.col("m") * threshold) & (F.col("m") >= F.col("n") * threshold)
    candidates = (
        prefix.join(other, [*GROUP, "token"]).filter((F.col("title") < F.col("other")) & near)
        .select(*GROUP, "title", "other").distinct()
    )
    named = titles.select(*GROUP, F.col("title").alias("other"), F.col("tokens").alias("other_tokens"))
    pairs = (
        candidates.join(titles, [*GROUP, "title"]).join(named, [*GROUP, "other"])
        .filter(text.jaccard(F.col("tokens"), F.col("other_tokens")) >= threshold)
        .select(*GROUP, "title", "other")
    )
    return pairs.union(pairs.select(*GROUP, "other", "title"))


def _greedy(rows: DataFrame, threshold: float) -> DataFrame:
    """(group, news_article_id) of the articles that no earlier kept one resembles, for groups of any size.

    Articles that share a url or a title's tokens need no pairs: the first open article of
    a url, of a title and of all similar titles has no open rival and is kept; what shares
    its url, title or a similar title drops out. Rounds follow the depth of chains of
    duplicates. Each is written, so plans stay short and a lost executor costs one round.
    """
    rows = settle(rows, "news_rows")
    titles = rows.filter("title IS NOT NULL").groupBy(*GROUP, "title").agg(F.first("_tokens").alias("tokens"))
    similar = settle(_similar_titles(titles, threshold), "news_pairs")
    left, kept = rows.drop("_tokens"), []
    while not left.isEmpty():
        by_url = left.groupBy(*GROUP, "url").agg(F.min("_order").alias("first_url"))
        by_title = left.groupBy(*GROUP, "title").agg(F.min("_order").alias("first_title"))
        around = (
            similar.join(by_title.withColumnRenamed("title", "other"), [*GROUP, "other"])
            .groupBy(*GROUP, "title").agg(F.min("first_title").alias("first_around"))
        )
        placed = left.join(by_url, [*GROUP, "url"], "left").join(by_title, [*GROUP, "title"], "left").join(
            around, [*GROUP, "title"], "left"
        )
        first = F.lit(True)
        for rival in ("first_url", "first_title", "first_around"):
            first = first & F.coalesce(F.col("_order") <= F.col(rival), F.lit(True))
        leaders = settle(placed.filter(first).select(*left.columns), "news_kept")
        kept.append(leaders)
        urls = leaders.filter("url IS NOT NULL").select(*GROUP, "url").distinct()
        gone = leaders.select(*GROUP, "title").union(
            similar.join(leaders, [*GROUP, "title"], "left_semi").select(*GROUP, "other")
        )
        left = settle(
            left.join(leaders, [*GROUP, "news_article_id"], "left_anti")
            .join(urls, [*GROUP, "url"], "left_anti")
            .join(gone.distinct(), [*GROUP, "title"], "left_anti"),
            "news_round",
        )
    out = rows.select(*GROUP, "news_article_id").limit(0)
    for part in kept:
        out = out.unionByName(part.select(*GROUP, "news_article_id"))
    return out


def deduplicated(scored: DataFrame, threshold: float = TITLE_SIMILARITY) -> DataFrame:
    """Articles kept when each is compared, best first, with those kept before."""
    tokens = text.title_tokens(F.col("title"))
    rows = scored.select(
        *GROUP, "news_article_id", text.clean(F.col("url")).alias("url"), rank_order().alias("_order"), tokens.alias("_tokens")
    ).withColumn("title", F.nullif(F.array_join(F.array_sort("_tokens"), " "), F.lit("")))
    return scored.join(_greedy(rows, threshold), [*GROUP, "news_article_id"], "left_semi")


def selected(unique: DataFrame, limit: int = 12, minimum: float = MIN_RELEVANCE) -> DataFrame:
    """First `limit` articles: qualifying ones, then the best of the rest.

    Deduplicated articles are ordered by score, so qualifying ones come first.
    """
    order = Window.partitionBy(*GROUP).orderBy(
        F.desc(F.col("relevance_score") >= minimum), F.desc("relevance_score"), F.desc("published_on"), "news_article_id"
    )
    return (
        unique.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= limit)
        .withColumn("position", F.col("position").cast("long"))
        .withColumn("qualifies", F.col("relevance_score") >= minimum)
    )


def evidence(chosen: DataFrame, excerpt_size: int = 4000) -> DataFrame:
    """Compact article records with an excerpt of the full text."""
    return chosen.filter(text.clean(F.col("title")).isNotNull()).select(
        *GROUP,
        "position",
        "news_article_id",
        F.array("ticker").alias("related_tickers"),
        text.clean(F.col("title")).alias("title"),
        "source",
        "published_on",
        "url",
        text.clean(F.col("summary")).alias("summary"),
        text.raw_excerpt(F.col("raw_text"), excerpt_size).alias("raw_text_excerpt"),
        "relevance_score",
    )
