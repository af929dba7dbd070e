"""Secret scans over a trigram inverted index.

From each rule's regex a Boolean query over trigrams is derived: every clause lists
alternatives, each a set of trigrams that a match must hold. The index has a posting
(trigram, row key) for every trigram that some query names; postings are intersected
per key, the queries are evaluated on what a key holds, and only then is the regex
run on the text, as the exact check. Rules without a mandatory trigram (long hex
runs) are scanned over all texts. Keys are 64-bit hashes of id and text: a collision
could only add a candidate, never lose one.

Null and empty texts have no spans. Very long texts are scanned whole, in time linear
in their length. Repeated rows, null ids and ties: every input row gives one output
row, whatever its id. Empty tables give no rows. Other columns pass through in `row`.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.spans import found, listed, masked, none, tagged

try:  # the parser of the standard library, under its name since 3.11
    from re import _constants as ops
    from re import _parser as parser
except ImportError:  # pragma: no cover
    import sre_constants as ops
    import sre_parse as parser

MARK = "[SECRET]"
MAX_EXACT = 16


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    # a match counts if this group of it is at least so long
    group: int = 0
    least: int = 0


BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "(?<![0-9a-f])[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", "gh[opusr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", "sk_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
)
RULES = BASE + MORE


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def boolean_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses that must all hold; a clause holds if all trigrams of one alternative occur.

    Letters are taken in lower case, so the query is for texts in lower case.
    """
    exact, clauses = _walk(list(parser.parse(pattern)), {""}, [])
    return _flushed(exact, clauses)


def _flushed(exact: set[str], clauses: list) -> list:
    if exact and all(len(s) >= 3 for s in exact):
        return [*clauses, sorted({trigrams(s) for s in exact}, key=sorted)]
    return clauses


def _walk(nodes: list, exact: set[str], clauses: list) -> tuple[set[str], list]:
    """exact: all strings that the part just before this point can be; clauses: what is known already."""
    for op, value in nodes:
        words = _exact_of(op, value)
        if words is not None and len(exact) * len(words) <= MAX_EXACT:
            exact = {a + b for a, b in itertools.product(exact, words)}
            continue
        clauses = _flushed(exact, clauses)
        exact = {""}
        if words is not None:
            exact = words
        elif op is ops.SUBPATTERN:
            exact, clauses = _walk(list(value[3]), exact, clauses)
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT) and value[0] >= 1:
            inner, clauses = _walk(list(value[2]), {""}, clauses)
            clauses = _flushed(inner, clauses)
        elif op is ops.BRANCH:
            options = [boolean_of(list(branch)) for branch in value[1]]
            if all(options):
                clauses = [*clauses, [frozenset().union(*alts) for o in options for alts in itertools.product(*o)]]
        # all else (classes, optional parts, assertions) says nothing about trigrams
    return exact, clauses


def boolean_of(nodes: list) -> list:
    exact, clauses = _walk(nodes, {""}, [])
    return _flushed(exact, clauses)


def _exact_of(op, value) -> set[str] | None:
    """All strings that a node can be, if they are few."""
    if op is ops.LITERAL:
        return {chr(value).lower()}
    if op is ops.IN and all(kind is ops.LITERAL for kind, _ in value) and len(value) <= 4:
        return {chr(c).lower() for _, c in value}
    if op is ops.SUBPATTERN:
        return _exact_all(list(value[3]))
    if op is ops.BRANCH:
        parts = [_exact_all(list(branch)) for branch in value[1]]
        return set().union(*parts) if all(p is not None for p in parts) else None
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and (value[0], value[1]) in ((0, 1), (1, 1)):
        inner = _exact_all(list(value[2]))
        return None if inner is None else inner | ({""} if value[0] == 0 else set())
    return None


def _exact_all(nodes: list) -> set[str] | None:
    out = {""}
    for op, value in nodes:
        words = _exact_of(op, value)
        if words is None or len(out) * len(words) > MAX_EXACT:
            return None
        out = {a + b for a, b in itertools.product(out, words)}
    return out


def postings(keyed: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index: (gram, key) for each of the trigrams that a text holds."""
    lowered = keyed.select("key", F.lower("text").alias("lowered"))
    held = F.array_compact(F.array(*[F.when(F.contains("lowered", F.lit(g)), F.lit(g)) for g in grams]))
    return lowered.select("key", F.explode(held).alias("gram"))


def candidates(index: DataFrame, queries: dict[str, list]) -> DataFrame:
    """(key, rules): the rules whose Boolean query the postings of a key fulfil."""

    def holds(clauses: list) -> Column:
        met = F.lit(True)
        for clause in clauses:
            either = F.lit(False)
            for grams in clause:
                wanted = F.array(*[F.lit(g) for g in sorted(grams)])
                either = either | (F.size(F.array_except(wanted, F.col("grams"))) == 0)
            met = met & either
        return met

    per_key = index.groupBy("key").agg(F.collect_set("gram").alias("grams"))
    rules = F.array_compact(F.array(*[F.when(holds(q), F.lit(k)) for k, q in queries.items()]))
    return per_key.select("key", rules.alias("rules")).where(F.size("rules") > 0)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Columns row (all columns of the document), text and one array of spans per kind."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.xxhash64(F.col(f"`{id_col}`").cast("string"), text).alias("key"),
        text.alias("text"),
    )
    queries = {r.kind: q for r in rules if (q := boolean_query(r.pattern))}
    grams = sorted({g for q in queries.values() for clause in q for alt in clause for g in alt})
    if grams:
        listed_rules = candidates(postings(keyed.select("key", "text"), grams), queries)
        keyed = keyed.join(listed_rules, "key", "left")
    else:
        keyed = keyed.withColumn("rules", F.lit(None).cast("array<string>"))

    def verified(rule: Rule) -> Column:
        spans = found(F.col("text"), rule.pattern)
        if rule.least:
            whole = f"^{rule.pattern}$"
            spans = F.filter(spans, lambda s: F.length(F.regexp_extract(s["hit"], whole, rule.group)) >= rule.least)
        if rule.kind not in queries:
            return spans
        return F.when(F.array_contains("rules", rule.kind), spans).otherwise(none())

    return keyed.select("row", "text", *[verified(r).alias(r.kind) for r in rules])


def _joined(rules: tuple[Rule, ...]) -> Column:
    return F.concat(*[tagged(F.col(r.kind), r.kind, i) for i, r in enumerate(rules)])


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = find_secrets(docs)
    return spans.select(
        F.col("row.doc_id").cast("bigint").alias("doc_id"),
        *[F.size(r.kind).cast("bigint").alias(f"n_{r.kind}") for r in BASE],
        F.sha2(listed(_joined(BASE)), 256).alias("base_sha256"),
        listed(_joined(RULES)).alias("spans"),
    )


def redacted(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents with every secret replaced by a mark; columns as they were, null texts stay null."""
    spans = find_secrets(docs, id_col, text_col)
    clean = spans.select("row", "text", _joined(RULES).alias("all"))
    return clean.select(
        *[
            F.when(F.col("row")[c].isNotNull(), masked(F.col("text"), F.col("all"), MARK)).alias(c)
            if c == text_col
            else F.col("row")[c].alias(c)
            for c in docs.columns
        ]
    )


def compiled(rule: Rule) -> re.Pattern:
    return re.compile(rule.pattern)
