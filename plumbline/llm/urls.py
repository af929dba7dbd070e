"""URL filters: fixed host and path rules, then rules mined by FP-growth.

A url is cut into host and path. The longest fixed rule that fits decides. For the
other urls, Spark's FP-growth mines token combinations from labelled urls (a label
of 0 means block); rules `tokens -> block` are kept above a support and a confidence.
The kept rules are matched by an inverted index: each rule is posted once, under its
rarest token, and a url meets only the rules posted under a token of its own.

Null urls, and urls without `://`, have an empty host and path, no tokens, and the
default verdict. Repeated rows, null ids and ties: one output row per input row.
Without usable labels no rule is mined and the default holds. Empty tables give no
rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_SUPPORT = 0.002
# the lower end of the 95 % interval (Wilson) of a rule's confidence must reach this
MIN_CONFIDENCE = 0.5
Z = 1.96
BLOCK, ALLOW = "block", "allow"


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("net", "/", BLOCK),
    UrlRule("example.net", "/en/", ALLOW),
    UrlRule("example.com", "/de/", BLOCK),
    UrlRule("org", "/fr/", ALLOW),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fixed(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule = F.when(fits, F.lit(r.text)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, labels of the host, words of the path, its ending, names in the query."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(
        F.filter(F.split(F.lower(path), "/"), lambda x: (x != "") & ~x.rlike("[0-9]")),
        lambda x: F.concat(F.lit("p:"), x),
    )
    ending = F.transform(F.regexp_extract_all(path, F.lit(r"\.([A-Za-z]+)$"), F.lit(1)), lambda x: F.concat(F.lit("e:"), x))
    names = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([A-Za-z_]+)="), F.lit(1)), lambda x: F.concat(F.lit("q:"), x))
    scheme = F.array(F.concat(F.lit("s:"), F.lower(F.regexp_extract(url, "^[A-Za-z]+", 0))))
    every = F.array_sort(F.array_distinct(F.concat(labels, words, ending, names, scheme)))
    return F.when(host != "", every).otherwise(F.expr("cast(array() as array<string>)"))


def mined(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """(antecedent, confidence, support) of the rules `tokens -> block`; labelled has tokens and blocked."""
    mark = F.when(F.col("blocked"), F.lit("=block")).otherwise(F.lit("=allow"))
    baskets = labelled.where(F.size("tokens") > 0).select(F.array_append("tokens", mark).alias("items"))
    rules = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    blocking = rules.associationRules.where(F.array_contains("consequent", "=block"))
    p, n = F.col("confidence"), F.col("support") / F.col("confidence") * baskets.count()
    middle = p + Z**2 / (2 * n)
    spread = Z * F.sqrt(p * (1 - p) / n + Z**2 / (4 * n**2))
    sure = (middle - spread) / (1 + Z**2 / n)
    return blocking.where((sure >= min_confidence) & (F.col("lift") > 1)).select("antecedent", "confidence", "support")


def indexed(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Postings (token, antecedent, confidence): every rule under its rarest token."""
    frequency = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    posted = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(frequency, "token")
    return posted.groupBy("antecedent", "confidence").agg(F.min_by("token", F.struct("n", "token")).alias("token"))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, confidence): the strongest mined rule that a url fulfils."""
    postings = indexed(rules, urls)
    return (
        urls.select("key", "tokens", F.explode("tokens").alias("token"))
        .join(postings, "token")
        .where(F.size(F.array_except("antecedent", "tokens")) == 0)
        .groupBy("key")
        .agg(F.max("confidence").alias("confidence"))
    )


def judge(
    pages: DataFrame,
    labels: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: tuple[UrlRule, ...] = RULES,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """id, host, path, rule, verdict and the confidence of the mined rule; labels has id and blocked."""
    url = F.col(f"`{url_col}`").cast("string")
    host, path = host_and_path(url)
    cut = pages.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"), url.alias("url"), host.alias("host"), path.alias("path")
    )
    rule, verdict = fixed(F.col("host"), F.col("path"), rules)
    urls = cut.select(
        F.xxhash64("id", "url").alias("key"),
        "id",
        "host",
        "path",
        rule.alias("rule"),
        verdict.alias("fixed"),
        tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens"),
    )
    known = labels.groupBy("id").agg(F.max("blocked").alias("blocked"))
    found = mined(urls.join(known, "id").select("tokens", "blocked"), min_support, min_confidence)
    strongest = matched(urls.where("rule IS NULL").select("key", "tokens").distinct(), found)
    judged = urls.join(strongest, "key", "left")
    return judged.select(
        "id",
        "host",
        "path",
        "rule",
        F.coalesce("fixed", F.when(F.col("confidence").isNotNull(), F.lit(BLOCK)), F.lit(ALLOW)).alias("verdict"),
        "confidence",
    )


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """Labels of pages: the quality of the document with the page's number."""
    labels = (
        spark.read.parquet(f"{sf_dir}/labels.parquet")
        .where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .select(F.col("doc_id").cast("bigint").alias("id"), (F.col("quality") == 0).alias("blocked"))
    )
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, labels).withColumnRenamed("id", "page_id")
