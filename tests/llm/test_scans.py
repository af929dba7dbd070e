"""Secrets and personal data against plain Python; derived trigram queries; masks."""

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from plumbline.llm import pii, secrets, spans

DOCS = "doc_id bigint, text string, lang string, rules string, key string, gram int"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "r", "k", 1) for i, t in enumerate(texts)], DOCS)


def noise(rng, parts, n):
    return "".join(rng.choice(parts) for _ in range(n))


SECRET_PARTS = ["password", "PASSWD", "secret", "Token", "api_key", "apikey", "=", ": ", " ", '"', "abcdef", "ab", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "😀", "\n", "x", "=="]
PII_PARTS = ["a.b", "@", "c-d", ".com", "1", "23", "255", "256", ".", " ", "-", "+", "(4)", "4111 1111 1111 1111", "4539578763621486", "_", "é", "😀", "\n", "0001", "+1 (988) 555-2485", "10.0.0.1"]


def base_secrets(x):
    rule = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(rule, x) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
    return out + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_pii(x):
    only = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 12 <= len(only(m)) <= 19 and luhn(only(m))]
    return out + [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(only(m)) <= 15]


def text_of(found):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def write(spark, tmp_path, texts):
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def check(rows, texts, base, names):
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(text_of(want).encode()).hexdigest(), (texts[r["doc_id"]], r["spans"])
        assert [r[f"n_{k}"] for k in names] == [sum(w[3] == k for w in want) for k in names]


def test_base_secrets_equal_plain_regexes(spark, tmp_path):
    rng = random.Random(7)
    texts = [None, "", "token=ab token: token: abcdef"] + [noise(rng, SECRET_PARTS, rng.randrange(1, 60)) for _ in range(300)]
    texts.append("password=abcdefgh " * 5000)
    check(secrets.op4_secrets(spark, write(spark, tmp_path, texts)).collect(), texts, base_secrets, ("assign", "access", "hex"))


def test_base_personal_data_equals_plain_regexes(spark, tmp_path):
    rng = random.Random(8)
    texts = [None, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "9" * 50_000, "a." * 50_000 + "@b" + ".c" * 20_000, "1 " * 20_000]
    texts += [noise(rng, PII_PARTS, rng.randrange(1, 50)) for _ in range(300)]
    check(pii.op9_personal_data(spark, write(spark, tmp_path, texts)).collect(), texts, base_pii, pii.KINDS)


def test_patterns_discover_unseen_identifiers(spark):
    seeds = [f"please call me at +1 (555) 010-{1000 + i} now {i}" for i in range(6)]
    texts = [*seeds, "please call me at 555-0199-77 today", "a number like 555-0199-88 elsewhere", None]
    rows = {r["id"]: r for r in pii.find_personal_data(table(spark, texts)).collect()}
    assert [texts[6][s["start"] : s["end"]] for s in rows[6]["context"]] == ["555-0199-77"]
    assert rows[7]["context"] == [] and rows[8]["context"] == []
    assert all(len(rows[i]["phone"]) == 1 for i in range(6))


def test_contexts_reach_over_earlier_matches(spark):
    """The words before a seed and before a token are the same, whatever digits stand in them."""
    texts = [f"room 7741 contact a{i}@ex.com" for i in range(5)] + ["room 7741 contact AB778899"]
    rows = {r["id"]: r for r in pii.find_personal_data(table(spark, texts)).collect()}
    assert [texts[5][s["start"] : s["end"]] for s in rows[5]["context"]] == ["AB778899"]


def test_contexts_equal_the_text_before(spark):
    rng = random.Random(11)
    texts = [noise(rng, ["12", "7", " ", "ab", ", ", "é😀", "x" * 50], rng.randrange(1, 400)) for _ in range(60)]
    rows = table(spark, texts).select("doc_id", spans.in_context(spans.found(F.col("text"), "[0-9]+")).alias("s")).collect()
    assert sum(len(r["s"]) for r in rows) > 1000
    for r in rows:
        text = texts[r["doc_id"]]
        assert [s["before"] for s in r["s"]] == [text[max(s["start"] - spans.BEFORE, 0) : s["start"]] for s in r["s"]]


def test_discovered_identifiers_open_patterns(spark):
    """Tokens behind a pattern of seeds carry a second pattern, which has no seed and finds a third token."""
    texts = [f"please call +1 (555) 010-{1000 + i}" for i in range(20)]
    texts += [f"please call QX{i}55019" for i in range(4)] + [f"badge of QX{i}55019" for i in range(4)]
    texts += ["badge of ZZ777888", "number of ZZ777999", None, ""]
    docs = table(spark, texts).withColumn("doc_id", F.expr("nullif(doc_id, 31)"))
    docs = docs.unionAll(docs.where("doc_id = 28"))
    rows = [(r["id"], [texts[r["id"]][s["start"] : s["end"]] for s in r["context"]]) for r in pii.find_personal_data(docs).where("id IS NOT NULL").collect()]
    assert [found for i, found in rows if i == 28] == [["ZZ777888"]] * 2
    assert [found for i, found in rows if i == 29] == [[]]
    assert all(found == [f"QX{(i - 20) % 4}55019"] for i, found in rows if 20 <= i < 28)
    assert pii.find_personal_data(docs.limit(0)).collect() == []


def test_pattern_scores_are_deterministic_fractions(spark):
    rows = [("p", v, v < 3) for v in range(4)] + [("q", 9, False)]
    edges = spark.createDataFrame([(k, p, v, 0, 1, s) for k, (p, v, s) in enumerate(rows)], "key bigint, pattern string, value bigint, start int, end int, seed boolean")
    assert [tuple(r) for r in pii.confident_patterns(edges, turns=1).collect()] == [("p", 600_000)]


def test_trigram_queries():
    query = secrets.boolean_query("(?i:password|tok_?en)=")
    assert len(query) == 1 and len(query[0]) == 3
    assert secrets.boolean_query("[0-9a-f]{24,}") == []
    assert secrets.boolean_query("AKIA[A-Z]+(xyz)?") == [[frozenset({"aki", "kia"})]]
    assert secrets.boolean_query("(?:abc|[xyz]+)def") == [[frozenset({"def"})]]
    for rule in secrets.RULES:
        for clause in secrets.boolean_query(rule.pattern):
            assert clause and all(alt for alt in clause)


def test_queries_lose_no_match(spark):
    """A text that matches a rule is a candidate of it: the spans equal those of a full scan."""
    rng = random.Random(9)
    parts = [*SECRET_PARTS, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1B2" * 9, "xoxb-1234567890ab", "sk_live_" + "9" * 20, "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9, "AIza" + "Q" * 35]
    texts = [noise(rng, parts, rng.randrange(1, 30)) for _ in range(150)]
    for r in secrets.find_secrets(table(spark, texts)).collect():
        text = texts[r["row"]["doc_id"]]
        for rule in secrets.MORE:
            assert [s["hit"] for s in r[rule.kind]] == [m[0] for m in re.finditer(rule.pattern, text)], rule


def test_masking_keeps_other_columns_and_nulls(spark):
    docs = table(spark, ["a password=abcdefgh b", None, "é😀 token: 0123456789abcdef0123456789abcdef!", "clean"])
    out = secrets.redacted(docs)
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts == {0: "a [SECRET] b", 1: None, 2: "é😀 [SECRET]!", 3: "clean"}
    assert secrets.redacted(docs.limit(0)).collect() == []


def masked_plainly(text, marks):
    out, at = "", 0
    for start, end in sorted(marks):
        if start >= at:
            out += text[at:start] + "#"
        at = max(at, end)
    return out + text[at:]


def test_masks_equal_plain_python(spark):
    rng = random.Random(12)
    rows = []
    for k in range(60):
        text = noise(rng, ["a", "é", "😀", "bc"], rng.randrange(0, 900))
        starts = [rng.randrange(len(text)) for _ in range(rng.choice([0, 3, 255, 256, 257, 800]))] if text else []
        rows.append((k, text, [(s, min(s + rng.choice([1, 2, 9, 200]), len(text))) for s in starts]))
    frame = spark.createDataFrame(rows, "k int, t string, s array<struct<start: int, end: int>>")
    for r in frame.select("*", spans.masked(F.col("t"), F.col("s"), "#").alias("m")).collect():
        assert r["m"] == masked_plainly(r["t"], [tuple(s) for s in r["s"]])


def test_very_many_secrets_are_masked_in_good_time(spark):
    n = 40_000
    frame = spark.createDataFrame([("é password=abcdefgh" * n,)], "t string").select(
        "t", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * 19 + 2).alias("start"), (i * 19 + 19).alias("end"))).alias("s")
    )
    began = time.monotonic()
    assert frame.select(spans.masked(F.col("t"), F.col("s"), "#").alias("m")).first()["m"] == "é #" * n
    assert time.monotonic() - began < 60


def test_many_matches_keep_their_places(spark):
    text = "é1 22  " * 1500
    row = spark.createDataFrame([(text,)], "t string").select(spans.found(F.col("t"), "[0-9]+").alias("s")).first()
    assert [(s["start"], s["end"], s["hit"]) for s in row["s"]] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", text)]


def test_scans_run_without_python(spark, tmp_path):
    path = write(spark, tmp_path, ["x"])
    for query in (secrets.op4_secrets, pii.op9_personal_data):
        plan = query(spark, path)._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas", plan)
