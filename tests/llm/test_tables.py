"""Top-k search, revisits, url filters, registration and the pipeline."""

import math
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import batches, topk, urls, warc

SF = "/root/testdata/sf0.001"


def brute_top(rows, k, every=20):
    cells = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(64 * x) for x in v]
            cells[i] = min(cells.get(i, (list(v), w)), (list(v), w))
    out = []
    for q in cells:
        if q % every == 0:
            score = lambda i: sum(a * b for a, b in zip(cells[q][1], cells[i][1]))
            best = sorted((-score(i), i) for i in cells if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 8192])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "VECTOR_BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    monkeypatch.setattr(topk, "TILE", 4)
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 0.5, -0.25, 1.5, rng.uniform(-2, 2)]) for _ in range(16)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(300, None), (301, [None] * 16), (302, [float("nan")] * 16), (303, [float("inf")] * 16), (None, [1.0] * 16), (20, [9.0] * 16), (304, [1.0]), (305, [])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, label int, score string")
    out = topk.search(frame, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=6)
    assert sorted(tuple(r) for r in out.collect()) == brute_top([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 6)
    assert topk.search(frame.limit(0), "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect() == []


def test_segment_bounds_hold():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(50, 30)), rng.normal(size=(60, 30))
    exact = a @ b.T
    last = None
    for level in (2, 4, 10, 30):
        bound = topk.segment_statistics(a, level) @ topk.segment_statistics(b, level).T
        assert (bound >= exact - 1e-9).all()
        last = bound
    np.testing.assert_allclose(last, exact)


def test_scores_beyond_doubles_are_exact():
    big = np.array([[2**30 + 1, 3]]), np.array([[2**31 - 1, 5]])
    assert topk.exact_scores(*big)[0, 0] == (2**30 + 1) * (2**31 - 1) + 15
    with pytest.raises(OverflowError):
        topk.exact_scores(np.array([[2**40]]), np.array([[2**40]]))


def brute_revisits(rows):
    out = {}
    for rid, uri, t, kind, _, headers in rows:
        if kind != "revisit":
            continue
        h = {k.lower(): v for k, v in (headers or {}).items()}
        old = [r for r in rows if r[3] == "response" and r[4] == 200 and r[1] == uri and uri and t is not None and r[2] is not None and r[2] < t]
        if not old:
            out[rid] = ("unmatched", None, None)
            continue
        best = max(old, key=lambda r: (r[2], r[0]))
        g = {k.lower(): v for k, v in (best[5] or {}).items()}
        bare = lambda x: re.sub("^W/", "", x or "")
        if "etag" in h:
            good = "etag" in g and (bare(h["etag"]) == bare(g["etag"]) if h["etag"].startswith("W/") else h["etag"] == g["etag"])
        elif "last-modified" in h:
            good = h["last-modified"] == g.get("last-modified")
        else:
            good = "etag" not in g and "last-modified" not in g
        new = g | {k: v for k, v in h.items() if k not in warc.KEPT_FIELDS}
        out[rid] = ("resolved", best[0], new) if good else ("mismatch", None, None)
    return out


def test_revisits_equal_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        headers = {}
        if rng.random() < 0.6:
            headers[rng.choice(["ETag", "etag"])] = rng.choice(['"a"', 'W/"a"', '"b"'])
        if rng.random() < 0.5:
            headers["Last-Modified"] = rng.choice(["x", "y"])
        headers |= {"Content-Type": f"t{i}", "X-Id": str(i)} if rng.random() < 0.7 else {}
        kind = rng.choice(["response", "revisit"])
        uri = rng.choice(["h.org/a", "h.org/a", "h.org/a", "h.org/b", None])
        rows.append((i, uri, rng.choice([None, *range(0, 40_000, 700)]), kind, rng.choice([200, 200, 404]), headers if rng.random() < 0.9 else None))
    frame = spark.createDataFrame([(*r, "x") for r in rows], "record_id bigint, uri string, time bigint, kind string, status int, headers map<string,string>, url string")
    got = {r["record_id"]: (r["outcome"], r["response_id"], r["headers"]) for r in warc.resolve_revisits(frame).collect()}
    assert got == brute_revisits(rows)
    assert warc.resolve_revisits(frame.limit(0)).collect() == []


def test_canonical_urls(spark):
    cases = {
        "HTTP://WWW.Ex.com:80/a/?utm_source=f&b=1#top": "ex.com/a?b=1",
        "https://ex.com/a?b=1": "ex.com/a?b=1",
        "ex.com/": "ex.com",
        "https://www2.ex.com?utm_x=1": "ex.com",
    }
    frame = spark.createDataFrame([(k,) for k in cases], "u string").select("u", warc.canonical(F.col("u")).alias("c"))
    assert {r["u"]: r["c"] for r in frame.collect()} == cases


def test_fixed_url_rules(spark):
    pages = [
        (1, "http://a.net/x"), (2, "https://EXAMPLE.net/en/1?q"), (3, "https://b.example.com/de/"), (4, "http://x.org/fr/1#t"),
        (5, "http://x.net"), (6, None), (7, "no scheme"), (8, "http://planet/"), (9, "http://x.org/de"), (10, ""), (11, "http://net/é?x"),
    ]
    frame = spark.createDataFrame([(i, u, "h") for i, u in pages], "page_id bigint, url string, host string")
    none = spark.createDataFrame([], "id bigint, blocked boolean")
    rows = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(frame, none).collect()}
    assert rows == {
        1: ("a.net", "/x", "net/", "block"), 2: ("example.net", "/en/1", "example.net/en/", "allow"),
        3: ("b.example.com", "/de/", "example.com/de/", "block"), 4: ("x.org", "/fr/1", "org/fr/", "allow"),
        5: ("x.net", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("planet", "/", None, "allow"),
        9: ("x.org", "/de", None, "allow"), 10: ("", "", None, "allow"), 11: ("net", "/é", "net/", "block"),
    }
    assert urls.judge(frame.limit(0), none).collect() == []


def test_mined_rules_block_token_combinations(spark):
    rows = [(i, f"http://{'spam' if i % 3 == 0 else 'good'}.example.org/{'win' if i % 2 else 'doc'}/{i}?ref=1") for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(i, i % 3 == 0 and i % 2 == 1) for i in range(0, 600)], "id bigint, blocked boolean")
    out = {r["id"]: r["verdict"] for r in urls.judge(pages, labels, min_support=0.05).collect()}
    assert out == {i: "block" if i % 3 == 0 and i % 2 == 1 else "allow" for i in range(600)}


def test_url_filter_and_revisits_run_without_python(spark):
    for query in (urls.op6_url_filter, warc.op2_revisits):
        assert not re.search("Python|Arrow|Pandas", query(spark, SF)._jdf.queryExecution().toString())


def test_queries_and_twins_are_registered():
    import __spark_entry__ as entry

    from plumbline import llm

    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in names and set(llm.load()[1]) <= set(names)


def test_nothing_outside_imports_the_subpackage():
    root = Path(__file__).resolve().parents[2]
    for path in (root / "plumbline").rglob("*.py"):
        if "llm" not in path.parts:
            assert "plumbline.llm" not in path.read_text() and "import llm" not in path.read_text(), path


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        after = docs.count()
        assert 0.5 * before <= after <= before, name
        before = after
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.select("doc_id").distinct().count() == before


def test_pipeline_equals_plain_python(spark):
    """Every stage against a brute-force version; the classifier's own scores decide the first."""
    import corpus_pipeline
    from test_scans import base_secrets
    from test_similar import expected

    from plumbline.llm import decontam, quality, secrets, stages

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    score = {r["doc_id"]: r["predicted"] for r in quality.op5_quality(spark, SF).collect()}
    docs = {i: t for i, t in docs.items() if score[i] == 1}
    docs = {i: docs[i] for i, (_, c) in expected(list(docs.items()), stages.SIMILAR_PERCENT, stages.SHINGLE_WORDS).items() if c == i}
    items = [decontam.words_of(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9))}
    kept = {}
    for i, text in docs.items():
        words = decontam.words_of(text)
        hit = {p + k for p in range(len(words)) for k in range(10) if tuple(words[p : p + 10]) in windows}
        if len(hit) <= 0.5 * len(words):
            spans = decontam.merged([(p, p) for p in hit])
            kept[i] = decontam.without_spans(text, spans) if spans else text
    for i, text in kept.items():
        found = base_secrets(text) + [(m.start(), 9, m.end(), r.kind) for r in secrets.MORE for m in re.finditer(r.pattern, text)]
        for a, b in reversed(decontam.merged([(s[0], s[2] - 1) for s in found])):
            text = text[:a] + secrets.MARK + text[b + 1 :]
        kept[i] = text
    from test_text_models import reference_ids

    want = {i: len(reference_ids(t)) for i, t in kept.items()}
    got = {r["doc_id"]: r["doc_tokens"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_compact_cells_come_back():
    for value in (0, 127, -128, 128, -(2**15), 2**15, 2**31, -(2**40), 2**61):
        cells = np.array([[value, 0], [1, -1], [5, 7]], float)
        assert batches.cells_of(batches.compact(cells), 3, 2).tolist() == cells.astype(np.int64).tolist()
    assert len(batches.compact(np.ones((3, 2)))) == 6
    assert batches.cells_of(batches.compact(np.zeros((3, 0))), 3, 0).shape == (3, 0)


def test_search_never_broadcasts_queries(spark):
    """Queries are repeated for every vector block, which their table's size does not show."""
    frame = spark.range(60).select(F.col("id").alias("vec_id"), F.array(F.lit(0.5), F.col("id").cast("double")).alias("embedding"))
    found = topk.search(frame, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=3)
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 9
