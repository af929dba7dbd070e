"""Personal data: seed regexes, and contexts bootstrapped from what they find.

Emails, addresses, cards and phone numbers are seeds. The one or two words before a
seed make a lexical pattern; they are sought in the 48 characters of text before it,
whatever matches stand there. Patterns and instances (the identifiers they stand
before) form a bipartite graph that is scored in turns: a pattern scores the sum of
its instances' scores over their number plus one, an unseen instance the best score
of its patterns, seeds stay at 1. Patterns that end at `CONFIDENT` or more and have
`SUPPORT` different supporters find identifiers (digit-bearing tokens) that no seed regex
matches. Supporters are seeds and, from turn to turn, identifiers which such a pattern
has found, so what is found opens patterns that no seed stands behind. Scores are whole numbers of millionths, so order of summing changes nothing.

Possessive forms of the seed regexes match the same spans as the plain ones, but need
no stack and no rescanning on very long runs. Null and empty texts have no spans;
repeated rows, null ids and ties: one output row per input row. Identical edges count
once. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.spans import found, in_context, listed, none, tagged
from plumbline.sources.stored import settle

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"
# a token with at least three digits
TOKEN = r"(?<![A-Za-z0-9@._+/-])(?=[A-Za-z@._+/-]*+[0-9])[A-Za-z0-9@._+/-]++"
LEAST_DIGITS = 3
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
ONE = 1_000_000
CONFIDENT = ONE // 2
SUPPORT = 3
TURNS = 3


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Check of the doubled-every-second-digit sum, for strings of a few digits."""
    backwards = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(backwards, i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def seeds(text: Column) -> dict[str, Column]:
    """Checked spans per kind."""

    def kept(kind: str, span: Column) -> Column:
        hit = span["hit"]
        n = F.length(digits_of(hit))
        if kind == "ip":
            return hit.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
        if kind == "card":
            return F.when(n.between(12, 19), passes_luhn(digits_of(hit))).otherwise(False)
        return n.between(9, 15) if kind == "phone" else F.lit(True)

    spans = {
        "email": F.when(F.contains(text, F.lit("@")), in_context(found(text, EMAIL))).otherwise(none()),
        "ip": in_context(found(text, IP)),
        "card": in_context(found(text, CARD)),
        "phone": F.when(F.contains(text, F.lit("+")), in_context(found(text, PHONE))).otherwise(none()),
    }
    return {k: F.filter(v, partial(kept, k)) for k, v in spans.items()}


def pattern_of(before: Column) -> Column:
    """The last two words before a span, in lower case, digits masked; empty if there is none."""
    tail = F.regexp_extract(before, r"(\S*\s+)?\S+\s*$|\S*\s*$", 0)
    plain = F.regexp_replace(F.lower(F.trim(tail)), "[0-9]", "0")
    return F.regexp_replace(plain, r"\s+", " ")


def instances(marked: DataFrame) -> DataFrame:
    """(key, pattern, value, start, end, seed): every seed and every other token, with its pattern."""
    both = F.concat(
        *[F.transform(F.col(k), lambda s: F.struct(s.alias("span"), F.lit(True).alias("seed"))) for k in KINDS],
        F.transform(F.col("tokens"), lambda s: F.struct(s.alias("span"), F.lit(False).alias("seed"))),
    )
    return (
        marked.select("key", F.explode(both).alias("x"))
        .select(
            "key",
            pattern_of(F.col("x.span.before")).alias("pattern"),
            F.xxhash64("x.span.hit").alias("value"),
            F.col("x.span.start").alias("start"),
            F.col("x.span.end").alias("end"),
            F.col("x.seed").alias("seed"),
        )
        .where("pattern <> ''")
    )


def confident_patterns(found_instances: DataFrame, turns: int = TURNS) -> DataFrame:
    """(pattern, score) of the patterns that may discover."""
    edges = found_instances.groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    # an instance that is a seed somewhere is a seed everywhere
    values = edges.groupBy("value").agg(F.max("seed").alias("seed"))
    edges = settle(edges.select("pattern", "value").join(values, "value"), "edges")
    width = edges.groupBy("pattern").agg(
        F.count("*").alias("n"), F.sum(F.col("seed").cast("bigint")).alias("seeds")
    )
    sure = F.expr(f"score >= {CONFIDENT} AND support >= {SUPPORT}")
    sums = width.select("pattern", (F.col("seeds") * ONE).alias("total"), F.col("seeds").alias("support"))
    for turn in range(turns):
        patterns = width.join(sums, "pattern").selectExpr("pattern", "support", "total div (n + 1) AS score")
        if turn < turns - 1:
            best = (
                edges.where("NOT seed")
                .join(patterns.where("score > 0"), "pattern")
                .groupBy("value")
                .agg(F.max("score").alias("best"), F.max(sure).alias("reached"))
            )
            sums = (
                edges.join(best, "value", "left")
                .groupBy("pattern")
                .agg(
                    F.sum(F.expr(f"CASE WHEN seed THEN {ONE} ELSE coalesce(best, 0) END")).alias("total"),
                    F.sum(F.expr("CAST(seed OR coalesce(reached, false) AS bigint)")).alias("support"),
                )
            )
    return patterns.where(sure).select("pattern", "score")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, one array of spans per kind, and `context`, the spans that patterns discovered."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    chosen = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    kinds = seeds(F.col("text"))
    marked = chosen.select(
        "id",
        F.xxhash64(F.col("id").cast("string"), "text").alias("key"),
        *[v.alias(k) for k, v in kinds.items()],
        F.filter(in_context(found(F.col("text"), TOKEN)), lambda s: F.length(digits_of(s["hit"])) >= LEAST_DIGITS).alias("raw"),
    )
    taken = F.concat(*[F.col(k) for k in KINDS])
    clear = F.filter(
        "raw",
        lambda t: ~F.exists("taken", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])),
    )
    marked = settle(
        marked.withColumn("taken", taken).withColumn("tokens", clear).drop("raw", "taken"), "spans"
    )
    seen = instances(marked)
    discovered = (
        seen.where("NOT seed")
        .join(confident_patterns(seen), "pattern")
        .dropDuplicates(["key", "start", "end"])
        .groupBy("key")
        .agg(F.collect_list(F.struct("start", "end")).alias(CONTEXT))
    )
    empty = F.expr("cast(array() as array<struct<start: int, end: int>>)")
    return marked.join(discovered, "key", "left").select(
        "id", *KINDS, F.coalesce(F.col(CONTEXT), empty).alias(CONTEXT)
    )


def op9_personal_data(spark, sf_dir: str) -> DataFrame:
    spans = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.concat(*[tagged(F.col(k), k, i) for i, k in enumerate(KINDS)])
    more = tagged(F.col(CONTEXT), CONTEXT, len(KINDS))
    return spans.select(
        F.col("id").cast("bigint").alias("doc_id"),
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.concat(base, more)).alias("spans"),
    )
