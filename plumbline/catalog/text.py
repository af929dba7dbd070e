"""News and filing evidence."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.catalog.twin import cte, r, register
from plumbline.functions import text
from plumbline.functions.scalars import rnd
from plumbline.functions.text_config import LOW_RELEVANCE_TERMS, MATERIAL_TERMS, RESEARCH_FORM_LIMITS, TITLE_STOPWORDS
from plumbline.operators import filings as filing_ops
from plumbline.operators import lookups
from plumbline.operators import news as news_ops
from plumbline.sources import testbed

DATES = [date(2000, 6, 30), date(2000, 10, 31)]
FILED_BY = date(2000, 6, 30)
KEY = ["as_of_date", "ticker", "news_article_id"]

CLEAN = "NULLIF(TRIM(REGEXP_REPLACE({0}, '\\s+', ' ', 'g')), '')"


def clean_sql(column):
    return CLEAN.format(column)


cte("news_dates", " UNION ALL ".join(f"SELECT DATE '{d}' AS as_of_date" for d in DATES))
cte("viewed", f"""SELECT d.as_of_date, n.*, CASE WHEN CAST(SUBSTR(n.ticker, 7) AS INT) % 2 = 0 THEN 'Brand Company' END AS company_name,
 COALESCE({clean_sql('title')}, '') AS title_c, COALESCE({clean_sql('summary')}, '') AS summary_c,
 COALESCE({clean_sql('LOWER(title)')}, '') AS t, COALESCE({clean_sql('LOWER(summary)')}, '') AS s
FROM news n JOIN news_dates d ON published_on <= d.as_of_date AND published_on >= d.as_of_date - 90""", "news", "news_dates")


def terms_sql(terms):
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]"


MENTION = "REGEXP_MATCHES({0}, CONCAT('(^|[^A-Za-z0-9])\\$?', ticker, '($|[^A-Za-z0-9])'), 'i')"
cte("featured", f"""SELECT *, {MENTION.format('title_c')} AS in_title, {MENTION.format('summary_c')} AS in_summary,
 LEN(LIST_FILTER({terms_sql(MATERIAL_TERMS)}, lambda x: CONTAINS(t, x))) AS mt, LEN(LIST_FILTER({terms_sql(MATERIAL_TERMS)}, lambda x: CONTAINS(s, x))) AS ms,
 LEN(LIST_FILTER({terms_sql(LOW_RELEVANCE_TERMS)}, lambda x: CONTAINS(t, x) OR CONTAINS(s, x))) AS low,
 COALESCE(CONTAINS(t, LOWER(company_name)), FALSE) AS nt, COALESCE(CONTAINS(s, LOWER(company_name)), FALSE) AS ns,
 company_name IS NOT NULL AND REGEXP_MATCHES(t, '\\bbrand\\b') AS short_t, company_name IS NOT NULL AND REGEXP_MATCHES(s, '\\bbrand\\b') AS short_s
FROM viewed""", "viewed")
cte("relevant", """SELECT *, CAST(ROUND(CAST(CASE WHEN in_title THEN 5 ELSE 0 END + CASE WHEN in_summary THEN 2.5 ELSE 0 END + CASE WHEN nt THEN 5 ELSE 0 END
 + CASE WHEN ns THEN 2.5 ELSE 0 END + CASE WHEN short_t THEN 2 ELSE 0 END + CASE WHEN short_s THEN 1 ELSE 0 END + LEAST(mt * 1.25, 4) + LEAST(ms * 0.5, 3)
 - LEAST(low * 1.75, 5) - CASE WHEN NOT (in_title OR in_summary OR nt OR ns) AND mt = 0 AND ms = 0 THEN 3 ELSE 0 END
 - CASE WHEN summary_c = '' THEN 0.75 ELSE 0 END - CASE WHEN title_c = '' THEN 2 ELSE 0 END
 + CASE WHEN as_of_date - published_on <= 7 THEN 1.25 WHEN as_of_date - published_on <= 30 THEN 0.75 WHEN as_of_date - published_on <= 90 THEN 0.25 ELSE 0 END AS DOUBLE), 6) AS DOUBLE) AS relevance_score
FROM featured""", "featured")
TOKENS = f"LIST_SORT(LIST_DISTINCT(LIST_FILTER(REGEXP_EXTRACT_ALL({{0}}, '[a-z0-9]+'), lambda w: LENGTH(w) >= 2 AND NOT LIST_CONTAINS({terms_sql(TITLE_STOPWORDS)}, w))))"
cte("ordered_news", f"""SELECT as_of_date, ticker, news_article_id, url, {TOKENS.format('t')} AS tokens, relevance_score, published_on,
 ROW_NUMBER() OVER (PARTITION BY as_of_date, ticker ORDER BY relevance_score DESC, published_on DESC, news_article_id) AS rn FROM relevant""", "relevant")
SIM = "LEN(LIST_INTERSECT(k.tokens, o.tokens)) * 1.0 / NULLIF(LEN(k.tokens) + LEN(o.tokens) - LEN(LIST_INTERSECT(k.tokens, o.tokens)), 0)"
DUP = f"LEN(LIST_FILTER(w.kept, lambda k: k.url = o.url OR COALESCE({SIM}, 0) >= 0.68)) > 0"
cte("walk", f"""SELECT DISTINCT as_of_date, ticker, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS news_article_id, FALSE AS keep, CAST([] AS STRUCT(url VARCHAR, tokens VARCHAR[])[]) AS kept FROM ordered_news
UNION ALL SELECT w.as_of_date, w.ticker, o.rn, o.news_article_id, NOT ({DUP}), CASE WHEN {DUP} THEN w.kept ELSE LIST_APPEND(w.kept, {{'url': o.url, 'tokens': o.tokens}}) END
FROM walk w JOIN ordered_news o ON o.as_of_date = w.as_of_date AND o.ticker = w.ticker AND o.rn = w.rn + 1""", "ordered_news")
cte("unique_news", "SELECT o.* FROM ordered_news o JOIN walk w ON w.as_of_date = o.as_of_date AND w.ticker = o.ticker AND w.rn = o.rn AND w.keep", "walk", "ordered_news")
cte("chosen_news", """SELECT *, ROW_NUMBER() OVER (PARTITION BY as_of_date, ticker ORDER BY relevance_score >= 2 DESC, relevance_score DESC, published_on DESC, news_article_id) AS position, relevance_score >= 2 AS qualifies
FROM unique_news QUALIFY position <= 6""", "unique_news")


def viewed(s, d):
    rows = news_ops.in_view(testbed.news(s, d), DATES)
    even = F.substring("ticker", 7, 4).cast("int") % 2 == 0
    return rows.withColumn("company_name", F.when(even, "Brand Company"))


def scored(s, d):
    return news_ops.relevance(viewed(s, d))


def unique(s, d):
    return news_ops.deduplicated(scored(s, d))


def chosen(s, d):
    return news_ops.selected(unique(s, d), 6)


register("x_clean_text", lambda s, d: testbed.filings(s, d).select("filing_id", text.clean(F.col("raw_text")).alias("body")),
         f"SELECT filing_id, {clean_sql('raw_text')} AS body FROM filings", "filings")
register("x_clean_filing", lambda s, d: testbed.filings(s, d).select("ticker", "filing_type", "filing_date", text.clean(F.col("accession_number")).alias("accession_number"), F.length(text.clean(F.col("raw_text"))).cast("long").alias("body_length")),
         f"SELECT ticker, filing_type, filing_date, accession_number, LENGTH({clean_sql('raw_text')}) AS body_length FROM filings", "filings")
register("x_clean_news", lambda s, d: testbed.news(s, d).select("ticker", text.clean(F.col("title")).alias("title"), text.clean(F.col("summary")).alias("summary"), "source", "url"),
         f"SELECT ticker, {clean_sql('title')} AS title, {clean_sql('summary')} AS summary, source, url FROM news", "news")
CUT = 600


def _last(expr, char):
    return f"CASE WHEN INSTR(REVERSE({expr}), '{char}') > 0 THEN LENGTH({expr}) - INSTR(REVERSE({expr}), '{char}') ELSE -1 END"


register("x_truncate", lambda s, d: testbed.filings(s, d).select("filing_id", text.truncate(F.col("raw_text"), F.lit(CUT)).alias("cut")),
         f"""SELECT filing_id, CASE WHEN LENGTH(body) <= {CUT} THEN body ELSE CONCAT(RTRIM(CASE WHEN sp >= {int(CUT * 0.8)} THEN SUBSTR(head, 1, sp) ELSE head END), ' ...') END AS cut
FROM (SELECT *, {_last('head', ' ')} AS sp FROM (SELECT filing_id, {clean_sql('raw_text')} AS body, SUBSTR({clean_sql('raw_text')}, 1, {CUT}) AS head FROM filings) a) b""", "filings")
register("x_raw_excerpt", lambda s, d: testbed.news(s, d).select("news_article_id", text.raw_excerpt(F.col("raw_text"), CUT).alias("excerpt")),
         f"""SELECT news_article_id, CASE WHEN LENGTH(body) <= {CUT} THEN body ELSE CONCAT(RTRIM(CASE WHEN dot >= {int(CUT * 0.75)} THEN SUBSTR(head, 1, dot + 1) WHEN sp >= {int(CUT * 0.85)} THEN SUBSTR(head, 1, sp) ELSE head END), ' ...') END AS excerpt
FROM (SELECT *, {_last('head', ' ')} AS sp, {_last('head', '.')} AS dot FROM (SELECT news_article_id, {clean_sql('raw_text')} AS body, SUBSTR({clean_sql('raw_text')}, 1, {CUT}) AS head FROM news) a) b""", "news")
register("x_ticker_in_text", lambda s, d: testbed.news(s, d).select("news_article_id", text.mentions(F.col("ticker"), F.col("title")).alias("in_title"), text.mentions(F.col("ticker"), F.col("summary")).alias("in_summary")),
         f"SELECT news_article_id, {MENTION.format('title')} AS in_title, {MENTION.format('summary')} AS in_summary FROM news", "news")
register("x_contains", lambda s, d: testbed.news(s, d).select("news_article_id", text.term_hits(text.search_text(F.col("summary")), MATERIAL_TERMS).cast("long").alias("material_hits")),
         f"SELECT news_article_id, LEN(LIST_FILTER({terms_sql(MATERIAL_TERMS)}, lambda x: CONTAINS(LOWER(summary), x))) AS material_hits FROM news", "news")
register("x_relevance", lambda s, d: scored(s, d).select(*KEY, "relevance_score"), f"SELECT {', '.join(KEY)}, relevance_score FROM relevant", "relevant")


def _ranked_news(s, d):
    """Position of an article: grouped counts of scores, then days, then ids."""
    from plumbline.operators.ranking import ranked

    order = F.col("relevance_score") * 100000 + F.datediff("published_on", F.lit(date(1970, 1, 1)))
    rows = scored(s, d).withColumn("_order", order).withColumn("_id", F.col("news_article_id").cast("string"))
    return ranked(rows, ["as_of_date", "ticker"], "_order", "_id", "position")


register("x_rank_news", lambda s, d: _ranked_news(s, d).select(*KEY, "position"),
         """SELECT as_of_date, ticker, news_article_id, ROW_NUMBER() OVER (PARTITION BY as_of_date, ticker
ORDER BY relevance_score DESC, published_on DESC, MD5(CAST(news_article_id AS VARCHAR)), CAST(news_article_id AS VARCHAR)) AS position FROM relevant""", "relevant")
register("x_title_tokens", lambda s, d: testbed.news(s, d).select("news_article_id", F.array_join(F.array_sort(text.title_tokens(F.col("title"))), " ").alias("tokens")),
         f"SELECT news_article_id, ARRAY_TO_STRING({TOKENS.format('LOWER(title)')}, ' ') AS tokens FROM news", "news")


def _neighbours(s, d):
    """Similarity of each article with the next one under the same url."""
    rows = testbed.news(s, d).select("url", "news_article_id", text.title_tokens(F.col("title")).alias("tokens"))
    w = Window.partitionBy("url").orderBy("news_article_id")
    return rows.select("news_article_id", rnd(text.jaccard(F.col("tokens"), F.lead("tokens").over(w)), 6).alias("similarity"))


register("x_jaccard", _neighbours,
         f"""SELECT news_article_id, {r('COALESCE(LEN(LIST_INTERSECT(a, b)) * 1.0 / NULLIF(LEN(a) + LEN(b) - LEN(LIST_INTERSECT(a, b)), 0), 0)', 6, 'similarity')} FROM (
SELECT news_article_id, tokens AS a, LEAD(tokens) OVER (PARTITION BY url ORDER BY news_article_id) AS b FROM (SELECT *, {TOKENS.format('LOWER(title)')} AS tokens FROM news) n) m""", "news")
register("x_dedup_greedy", lambda s, d: unique(s, d).select(*KEY, "relevance_score"), f"SELECT {', '.join(KEY)}, relevance_score FROM unique_news", "unique_news")
register("x_select_news", lambda s, d: chosen(s, d).select(*KEY, "position", "qualifies"), f"SELECT {', '.join(KEY)}, position, qualifies FROM chosen_news", "chosen_news")
register("t_news_fill", lambda s, d: chosen(s, d).groupBy("as_of_date", "ticker").agg(F.count("*").alias("articles"), F.sum(F.col("qualifies").cast("long")).alias("qualifying")),
         "SELECT as_of_date, ticker, COUNT(*) AS articles, CAST(SUM(CASE WHEN qualifies THEN 1 ELSE 0 END) AS BIGINT) AS qualifying FROM chosen_news GROUP BY 1, 2", "chosen_news")
register("x_news_evidence", lambda s, d: news_ops.evidence(chosen(s, d), 400).select(*KEY, "position", "title", "url", "summary", "relevance_score"),
         f"SELECT c.as_of_date, c.ticker, c.news_article_id, c.position, v.title_c AS title, c.url, NULLIF(v.summary_c, '') AS summary, c.relevance_score FROM chosen_news c JOIN viewed v USING (as_of_date, ticker, news_article_id) WHERE v.title_c <> ''", "chosen_news", "viewed")


def limited(s, d):
    return filing_ops.newest_per_form(lookups.known_by(testbed.filings(s, d), "filing_date", FILED_BY))


LIM = "CASE filing_type WHEN '8-K' THEN 5 WHEN '10-Q' THEN 2 WHEN '10-K' THEN 1 END"
cte("limited", f"""SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker, filing_type ORDER BY filing_date DESC, filing_id DESC) AS form_position FROM (SELECT * FROM filings WHERE filing_date <= DATE '{FILED_BY}') f
QUALIFY form_position <= {LIM}""", "filings")
assert RESEARCH_FORM_LIMITS == {"8-K": 5, "10-Q": 2, "10-K": 1}
register("t_form_limits", lambda s, d: limited(s, d).select("filing_id", "ticker", "filing_type", "form_position"), "SELECT filing_id, ticker, filing_type, form_position FROM limited", "limited")
register("t_head_cap", lambda s, d: lookups.newest(limited(s, d), ["ticker"], [F.desc("filing_date"), F.desc("filing_id")], 4).select("filing_id", "ticker", "position"),
         "SELECT filing_id, ticker, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY filing_date DESC, filing_id DESC) AS position FROM limited QUALIFY position <= 4", "limited")


def body(s, d):
    return testbed.filings(s, d).withColumn("body", text.clean(F.col("raw_text")))


def spans(s, d):
    return body(s, d).withColumn("windows", filing_ops.keyword_windows(F.col("body")))


register("x_keyword_windows", lambda s, d: spans(s, d).select("filing_id", "filing_type", F.posexplode("windows").alias("n", "w")).select("filing_id", "filing_type", "n", "w.start", "w.end"))
register("x_merge_windows", lambda s, d: spans(s, d).select("filing_id", F.posexplode(filing_ops.merged_windows(F.col("windows"))).alias("n", "w")).select("filing_id", "n", "w.start", "w.end"))
register("w_islands", lambda s, d: spans(s, d).select("filing_id", F.size("windows").alias("hits"), F.size(filing_ops.merged_windows(F.col("windows"))).alias("islands")))
register("x_cut_windows", lambda s, d: spans(s, d).select("filing_id", F.posexplode(filing_ops.cut_windows(F.col("body"), filing_ops.merged_windows(F.col("windows")), F.lit(2500))).alias("n", "section")))
register("x_filing_excerpt", lambda s, d: filing_ops.with_excerpt(testbed.filings(s, d)).select("filing_id", "filing_type", "relevant_excerpt"))
register("x_filing_evidence", lambda s, d: filing_ops.with_excerpt(limited(s, d)).select("filing_id", "ticker", "filing_type", "filing_date", "accession_number", "relevant_excerpt"))


def _many(s, d):
    """Evidence of all tickers at both news dates in one plan; tickers without any are named, not dropped."""
    dates = F.explode(F.array(*[F.lit(day) for day in DATES])).alias("as_of_date")
    news_side = chosen(s, d).groupBy("as_of_date", "ticker").agg(F.count("*").alias("articles"))
    filing_side = limited(s, d).groupBy("ticker").agg(F.count("*").alias("filings"))
    everyone = testbed.filings(s, d).select("ticker").distinct().select(dates, "ticker")
    rows = everyone.join(news_side, ["as_of_date", "ticker"], "left").join(filing_side, "ticker", "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("articles", "filings")}
    status = F.when(counts["articles"] + counts["filings"] == 0, "no evidence").otherwise("ok")
    return rows.select("as_of_date", "ticker", *[c.alias(n) for n, c in counts.items()], status.alias("status"))


register("x_evidence_many", _many,
         f"""SELECT *, CASE WHEN articles + filings = 0 THEN 'no evidence' ELSE 'ok' END AS status FROM (
SELECT v.as_of_date, t.ticker, COALESCE(n.c, 0) AS articles, COALESCE(f.c, 0) AS filings FROM (SELECT DISTINCT ticker FROM filings) t
CROSS JOIN (SELECT UNNEST([{', '.join(f"DATE '{day}'" for day in DATES)}]) AS as_of_date) v
LEFT JOIN (SELECT as_of_date, ticker, COUNT(*) AS c FROM chosen_news GROUP BY ALL) n ON n.ticker = t.ticker AND n.as_of_date = v.as_of_date
LEFT JOIN (SELECT ticker, COUNT(*) AS c FROM limited GROUP BY 1) f ON f.ticker = t.ticker) x""", "filings", "chosen_news", "limited")
