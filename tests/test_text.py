"""Excerpts and duplicate removal against plain Python on the whole texts."""

import re
from datetime import date

from pyspark.sql import functions as F

from plumbline.functions.text_config import (
    AFTER_HEADING, BEFORE_HEADING, EXCERPT_SIZE, HEADINGS, SECTION_SIZE, SEPARATOR,
)
from plumbline.operators import filings, news
from plumbline.sources import testbed

SF = "/root/testdata/sf0.001"


def clean(t):
    return re.sub(r"\s+", " ", t).strip() or None


def cut(t, n):
    t = clean(t)
    if t is None or len(t) <= n:
        return t
    h = t[:n]
    s = h.rfind(" ")
    return (h[:s] if s >= int(n * 0.8) else h).rstrip() + " ..."


def brute_excerpt(form, raw):
    body = clean(raw)
    low, found = body.lower(), []
    for word in HEADINGS[form]:
        at = -1
        for _ in range(2):
            at = low.find(word, 0 if at < 0 else at + len(word))
            if at < 0:
                break
            found.append((max(at - BEFORE_HEADING[form], 0), min(at + len(word) + AFTER_HEADING[form], len(body))))
    merged = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1] + 350:
            merged[-1] = (merged[-1][0], max(merged[-1][1], b))
        else:
            merged.append((a, b))
    size = SECTION_SIZE[form]
    if merged:
        free = max(EXCERPT_SIZE[form] - len(SEPARATOR) * (len(merged) - 1), 1)
        size = min(size, max(free // len(merged), 1))
    parts = []
    for a, b in merged:
        s = body[a:b].strip()
        if a > 0 and 0 <= s.find(" ") <= 80:
            s = s[s.find(" ") + 1:]
        if b < len(body):
            if s.rfind(".") >= int(len(s) * 0.75):
                s = s[: s.rfind(".") + 1]
            elif s.rfind(" ") >= int(len(s) * 0.85):
                s = s[: s.rfind(" ")]
        s = cut(s, size) if clean(s) else None
        if s:
            parts.append(s)
    return cut(SEPARATOR.join(parts) if parts else body, EXCERPT_SIZE[form])


def test_filing_excerpts_match_brute_force(spark):
    rows = filings.with_excerpt(testbed.filings(spark, SF)).select("filing_type", "raw_text", "relevant_excerpt").collect()
    assert len(rows) >= 200
    for r in rows:
        assert r.relevant_excerpt == brute_excerpt(r.filing_type, r.raw_text)


def brute_dedup(items, threshold=0.68):
    kept = []
    for _, i, url, tokens in sorted(items):
        tokens = set(tokens)
        def close(k):
            union = tokens | k[1]
            return url == k[0] or (tokens and k[1] and len(tokens & k[1]) / len(union) >= threshold)
        if not any(close(k) for k in kept):
            kept.append((url, tokens, i))
    return {k[2] for k in kept}


def test_dedup_equals_brute_force(spark):
    """A hot group: a third of the rows are copies of one title."""
    rows = []
    for i in range(90):
        title = "alpha beta gamma delta" if i % 3 == 0 else f"alpha beta word{i % 7} item{i % 11} extra{i % 2}"
        rows.append((date(2000, 1, 5), "T", i, title, f"http://x/{i // 2}", float(i % 5), date(2000, 1, 1 + i % 4)))
    frame = spark.createDataFrame(
        rows, "as_of_date date, ticker string, news_article_id long, title string, url string, relevance_score double, published_on date"
    )
    items = [((-r[5], -(r[6].toordinal()), r[2]), r[2], r[4], set(re.findall("[a-z0-9]+", r[3]))) for r in rows]
    wanted = brute_dedup([(o, i, u, t) for o, i, u, t in items])
    got = {r.news_article_id for r in news.deduplicated(frame).collect()}
    assert got == wanted
    assert len(wanted) > 5


def test_dedup_of_many_titles_with_one_common_word(spark):
    """No pair is similar: one round, whatever the group's size; empty urls are no url."""
    rows = [
        (date(2000, 1, 5), "T", i, f"extraordinary item{i} part{i * 7} kind{i * 13}", "" if i % 2 else f" http://x/{i} ", float(i % 5), date(2000, 1, 1))
        for i in range(2000)
    ]
    rows += [(date(2000, 1, 5), "T", 5000 + i, f"another title number{i}", f"http://x/{i}", -1.0, date(2000, 1, 1)) for i in (0, 2)]
    frame = spark.createDataFrame(
        rows, "as_of_date date, ticker string, news_article_id long, title string, url string, relevance_score double, published_on date"
    )
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    got = {r.news_article_id for r in news.deduplicated(frame).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before
    assert got == set(range(2000)) and jobs < 60


def test_title_tokens_and_mentions(spark):
    from plumbline.functions import text

    row = spark.createDataFrame([("Why the $ABC stock, ABC2 and abcd?", "ABC")], "t string, k string").select(
        text.title_tokens(F.col("t")).alias("tokens"), text.mentions(F.col("k"), F.col("t")).alias("hit"),
        text.mentions(F.lit("BCD"), F.col("t")).alias("miss"),
    ).first()
    assert set(row.tokens) == {"abc", "abc2", "abcd"} and row.hit and not row.miss
