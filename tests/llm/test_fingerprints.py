"""Prefix hashes and document fingerprints against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import fingerprints as fp

SCHEMA = "doc_id bigint, text string, n_chars int, fingerprint string, bucket int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)


def spans(text):
    n = min(fp.SPAN, len(text))
    return {text[i : i + n] for i in range(len(text) - n + 1)} if n else set()


def jaccard(a, b):
    a, b = spans(a), spans(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def brute(rows):
    """Ids are distinct; null last."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for (one, text), (_, following) in zip(order, order[1:] + order[:1]):
        a, b = text or "", following or ""
        cut = len(a) // 3
        changed = a[: len(a) - cut] + b[:cut]
        out[one] = (len(a), hashlib.sha256(changed.encode()).hexdigest(), a, changed, b)
    return out


def check(frame, want):
    rows = frame.collect()
    assert len(rows) == len(want)
    prints = {}
    for r in rows:
        n, sha, text, changed, following = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert (r["prefix_edited"], r["prefix_next"]) == (common(text, changed), common(text, following))
        for mine, other, near in ((text, changed, r["near_edited"]), (text, following, r["near_next"])):
            exact = jaccard(mine, other)
            assert 0 <= near <= 1 and abs(near - exact) < (0.45 if len(spans(mine) | spans(other)) > fp.SKETCH else 1e-9)
        for t, p in ((text, r["fingerprint"]), (changed, r["edited_fingerprint"])):
            assert prints.setdefault(p, t) == t
    assert len(prints) == len(set(prints.values()))


@pytest.mark.parametrize("seed", [1, 2])
def test_query_figures_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    alphabet = "ab é\U0001f600\x00"
    texts = ["", None, "a", "ab", "x" * 19, "y" * 20, "z" * 21, "long " * 3000]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(60)]
    texts += [texts[20]] * 9 + [texts[30][:-3] + "?!"] * 2
    rng.shuffle(texts)
    rows = list(zip(rng.sample(range(-500, 5000), len(texts) - 1), texts)) + [(None, texts[-1])]
    check(fp.edited(table(spark, rows).repartition(5)), brute(rows))


def test_few_rows_and_repeats(spark):
    assert fp.edited(table(spark, [])).collect() == []
    for rows in ([(5, "only text of one document")], [(None, "nothing")], [(1, "a" * 30), (2, None)]):
        check(fp.edited(table(spark, rows)), brute(rows))
    same = fp.edited(table(spark, [(7, "the same text twice over")] * 3 + [(None, "x"), (None, "x")])).collect()
    assert sorted(str(r["doc_id"]) for r in same) == ["7", "7", "7", "None", "None"]
    assert len({r["fingerprint"] for r in same if r["doc_id"] == 7}) == 1
    assert sum(r["near_next"] == 1.0 for r in same) == 3


def test_likeness_of_edited_documents(spark):
    rows = fp.op12_fingerprints(spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    check(fp.op12_fingerprints(spark, "/root/testdata/sf0.001"), brute(list(docs.items())))
    assert np.mean([r["near_edited"] for r in rows]) > 0.4 and np.mean([r["near_next"] for r in rows]) < 0.2


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=40), st.text("ab", max_size=40), st.data())
def test_spans_and_extensions(a, b, data):
    one, two = fp.PrefixHashes.of(a), fp.PrefixHashes.of(b)
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    n = data.draw(st.integers(0, min(len(a) - i, len(b) - j)))
    assert (one.span(i, n) == two.span(j, n)) == (a[i : i + n] == b[j : j + n])
    assert one.common_extension(i, two, j) == common(a[i:], b[j:])
    joined = one.joined(i, two, j)
    assert joined.span(0, i + j) == fp.PrefixHashes.of(a[:i] + b[:j]).span(0, i + j)


@settings(max_examples=40, deadline=None)
@given(st.text("abc", max_size=120), st.text("abc", max_size=120), st.data())
def test_edited_prints_equal_those_of_the_text(a, b, data):
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    assert fp.Prints.of(a).edited(i, fp.Prints.of(b), j).fingerprint() == fp.Prints.of(a[:i] + b[:j]).fingerprint()
