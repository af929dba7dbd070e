"""N-gram Jaccard join and components against brute force."""

import random
import re

import numpy as np
import pytest

from plumbline.llm import components, jaccard

SCHEMA = "doc_id bigint, text string, lang string, `class` string, id int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 7) for i, t in rows], SCHEMA)


def shingle_set(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if len(words) >= width:
        return set(zip(*[words[k:] for k in range(width)]))
    return {tuple(words)} if words else set()


def expected(rows, percent=85, width=4):
    sets = {i: shingle_set(t, width) for i, t in rows}
    top = {i: i for i in sets}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def got(frame):
    return {r["id"]: (r["n_shingles"], r["component_id"]) for r in frame.collect()}


def corpus(seed, copies):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([3, 4, 9, 30, 90, 250]))]
        for _ in range(copies):
            changed = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                changed[rng.randrange(len(changed))] = rng.choice(words)
            cut = rng.choice([0, 0, 1, 5])
            rows.append((len(rows), " ".join(changed[: len(changed) - cut] or changed)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, seed):
    rows = corpus(seed, 12)
    assert got(jaccard.similar_groups(table(spark, rows))) == expected(rows)


def test_other_share_and_width(spark):
    rows = corpus(6, 12)
    assert got(jaccard.similar_groups(table(spark, rows), percent=80, width=5)) == expected(rows, 80, 5)


def test_small_chunks_give_the_same_groups(spark, monkeypatch):
    rows = corpus(3, 10)
    monkeypatch.setattr(jaccard, "CHUNK_WEIGHT", 200)
    monkeypatch.setattr(jaccard, "HUB_WEIGHT", 100)
    assert got(jaccard.similar_groups(table(spark, rows))) == expected(rows)


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "É b c d"), (7, "é b c d"), (8, long), (9, long + " end"), (None, "one two")]
    out = jaccard.similar_groups(table(spark, rows)).collect()
    by = {r["id"]: (r["n_shingles"], r["component_id"]) for r in out if r["id"] is not None}
    assert by == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 7), 8: (29_997, 8), 9: (29_998, 8)}
    assert [r["component_id"] for r in out if r["id"] is None] == [4]


def test_empty_table_and_repeated_rows(spark):
    assert jaccard.similar_groups(table(spark, [])).collect() == []
    rows = [(1, "a b c d e")] * 3 + [(2, "a b c d e")]
    assert sorted(tuple(r)[:3] for r in jaccard.similar_groups(table(spark, rows)).collect()) == [(1, 2, 1)] * 3 + [(2, 2, 1)]


@pytest.mark.parametrize("percent", [80, 85])
def test_every_linked_pair_shares_a_signature(percent):
    rng = np.random.default_rng(5)
    for n in list(range(1, 60)) + [100, 333, 1000]:
        for _ in range(8):
            left = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            most = jaccard.differing(2 * n, percent)
            gone = rng.integers(0, most + 1)
            right = np.unique(np.concatenate((left[gone:], rng.integers(0, 2**64, rng.integers(0, most + 1), dtype=np.uint64))))
            shared = len(np.intersect1d(left, right))
            union = len(left) + len(right) - shared
            if 100 * shared >= percent * union and shared < union:
                assert set(jaccard.signatures(left, percent)) & set(jaccard.signatures(right, percent))


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_pairs_share_as_many_signatures_as_said(percent):
    rng = np.random.default_rng(7)
    seen = 0
    for n in list(range(1, 60)) + [100, 333, 1000, 4000]:
        for _ in range(8):
            left = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            gone = rng.integers(0, jaccard.differing(2 * n, percent) + 1)
            more = jaccard.differing(2 * n, percent) - gone if rng.integers(2) else 0
            right = np.unique(np.concatenate((left[gone:], rng.integers(0, 2**64, more, dtype=np.uint64))))
            shared = len(np.intersect1d(left, right))
            union = len(left) + len(right) - shared
            if 100 * shared >= percent * union and shared < union:
                common = len(np.intersect1d(jaccard.signatures(left, percent), jaccard.signatures(right, percent)))
                assert common >= max(jaccard.least_common(left, percent), jaccard.least_common(right, percent)) >= 1
                seen += 1
    assert seen > 100


def test_small_chunks_at_the_share_of_the_pipeline(spark, monkeypatch):
    """Common passages keep signatures of unlike texts open."""
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"{t} {passage}" if rng.random() < 0.6 else t) for i, t in corpus(9, 12)]
    monkeypatch.setattr(jaccard, "CHUNK_WEIGHT", 200)
    monkeypatch.setattr(jaccard, "HUB_WEIGHT", 100)
    assert got(jaccard.similar_groups(table(spark, rows), percent=80, width=5)) == expected(rows, 80, 5)


def test_pipeline_links_at_four_fifths(spark):
    from plumbline.llm import stages

    words = [f"w{i}" for i in range(100)]
    # of 96 shingles 86 stay and 10 are new: 86 of 106 in common (0.811); with 15 changed, 81 of 111 (0.73)
    near = words[:30] + ["x"] + words[31:60] + ["y"] + words[61:]
    far = words[:20] + ["x"] + words[21:50] + ["y"] + words[51:80] + ["z"] + words[81:]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far[::-1])), (4, " ".join(words[::-1]))]
    kept = {r["doc_id"] for r in stages.one_of_each_group(spark, table(spark, rows), "").collect()}
    assert kept == {1, 3, 4}


def test_prefix_tree_finds_all_links():
    rng = random.Random(4)
    for _ in range(60):
        sets = [np.array(sorted(rng.sample(range(1, 40), rng.randrange(1, 25))), np.uint64) for _ in range(30)]
        tree = jaccard.PrefixTree(sets)
        for probe in sets:
            want = {i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, probe)) >= 85 * len(np.union1d(s, probe))}
            assert set(tree.linked(probe, 85, lambda i: False)) == want


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (20, 21), (21, 22), (22, 20), (8, 8)] + [(i, i + 1) for i in range(100, 140)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {5: 3, 4: 3, 3: 3, 9: 3, 20: 20, 21: 20, 22: 20} | {i: 100 for i in range(100, 141)}
    assert found == want


def test_prefixes_of_linked_sets_meet():
    rng = random.Random(9)
    for percent in (80, 85):
        for _ in range(400):
            a = rng.sample(range(200), rng.randrange(1, 60))
            b = [x for x in a if rng.random() > 0.12] + rng.sample(range(200, 260), rng.randrange(4))
            both, all_of = len(set(a) & set(b)), len(set(a) | set(b))
            if not b or 100 * both < percent * all_of:
                continue
            order = {x: rng.random() for x in range(260)}
            heads = [set(sorted(s, key=order.get)[: jaccard.prefix_length(len(s), percent)]) for s in (a, b)]
            assert heads[0] & heads[1]


def test_common_passage_keeps_unlike_texts_apart_and_links_stay(spark):
    """Texts that share half of their words are no candidates; near copies of them are found."""
    rng = random.Random(10)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(40):
        own = [f"q{i}x{k}" for k in range(60)]
        rows.append((len(rows), passage + " " + " ".join(own)))
        if i % 4 == 0:
            own[rng.randrange(60)] = "other"
            rows.append((len(rows), " ".join(own) + " " + passage))
    groups = jaccard.similar_groups(table(spark, rows).repartition(4), percent=80, width=5)
    assert got(groups) == expected(rows, 80, 5)
