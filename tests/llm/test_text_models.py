"""Decontamination, packing, token counts and the classifier against plain versions."""

import random
import zlib

import numpy as np
import pytest

from plumbline.llm import counts, decontam, packing, quality

DOCS = "doc_id bigint, text string, lang string, row string, n_words int, part int"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "r", 1, 2) for i, t in enumerate(texts)], DOCS)


def brute_overlap(doc, items, window):
    hit, names = set(), set()
    for name, words in items:
        span = min(window, len(words))
        for s in range(len(words) - span + 1):
            for p in range(len(doc) - span + 1):
                if span and doc[p : p + span] == words[s : s + span]:
                    hit |= set(range(p, p + span))
                    names.add(name)
    return hit, names


@pytest.mark.parametrize("seed", range(5))
def test_automaton_finds_all_windows(seed):
    rng = random.Random(seed)
    for _ in range(300):
        kinds, window = rng.choice([2, 3, 6]), rng.choice([1, 2, 3, 4])
        make = lambda n, k: [b"%d" % rng.randrange(k) for _ in range(n)]
        items = [(str(rng.randrange(4)), make(rng.randrange(1, 9), kinds)) for _ in range(rng.randrange(1, 5))]
        doc = make(rng.randrange(30), kinds + 1)
        spans, found = decontam.Automaton(items, window).scan(doc)
        hit, names = brute_overlap(doc, items, window)
        assert {i for a, b in spans for i in range(a, b + 1)} == hit and found == names


@pytest.mark.parametrize("shard", [5, 10**6])
def test_overlap_of_tables(spark, shard):
    rng = random.Random(3)
    words = [f"W{i}" for i in range(30)] + ["É", "ß2"]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([3, 12, 25, 40, 1])] + [(9, None), (None, "a b"), (10, " .,")]
    texts = [None, "", "..."]
    for _ in range(40):
        text = [rng.choice(words) for _ in range(60)]
        item = rng.choice(items[:5])[1].lower().split()
        at = rng.randrange(50)
        texts.append(", ".join(text[:at] + item[rng.randrange(2) :] + text[at:]))
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, spans string")
    coded = [(str(i), decontam.words_of(t)) for i, t in items if i is not None and t]
    out = decontam.find_overlap(table(spark, texts), bench, shard_words=shard).collect()
    assert len(out) == len(texts)
    for r in out:
        doc = decontam.words_of(texts[r["row"]["doc_id"]])
        hit, names = brute_overlap(doc, coded, 10)
        assert r["n_words"] == len(doc)
        assert {i for s in r["spans"] for i in range(s["first"], s["last"] + 1)} == hit
        assert r["items"] == sorted(names)


def test_spans_are_removed(spark):
    item = " ".join(f"q{i}" for i in range(20))
    own = " ".join(f"own{i}" for i in range(40))
    docs = table(spark, [own, f"{own}. {item.upper()}! {own}", f"x {item}", None, "Ünï"])
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    out = decontam.cleaned(docs, bench)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {0: own, 1: f"{own}. ! {own}", 3: None, 4: "Ünï"}
    assert decontam.cleaned(docs, bench.limit(0)).count() == 5
    assert decontam.cleaned(docs.limit(0), bench).collect() == []


def test_short_items_stay_in_clean_documents(spark):
    item = " ".join(f"q{i}" for i in range(12))
    texts = ["one of the many words here of the kind", f"of the {item} and more words to the end of the long text about other things", "of the"]
    bench = spark.createDataFrame([(1, "of the"), (2, item)], "item_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in decontam.cleaned(table(spark, texts), bench, max_coverage=0.9).collect()}
    # the short item touches the long one, so they are one span; on its own it stays unless it is most of the text
    assert got == {0: texts[0], 1: texts[1].replace(f"of the {item}", "")}
    short = {r["doc_id"]: r["text"] for r in decontam.cleaned(table(spark, texts), bench, min_span=2, max_coverage=0.9).collect()}
    assert short[0] == "one  many words here  kind"


def test_shards_leave_one_automaton_at_a_time(spark, monkeypatch):
    """Every shard but the last is settled and its broadcast dropped; results are those of one automaton."""
    settled = []
    monkeypatch.setattr(decontam, "settle", lambda f, n, real=decontam.settle: settled.append(n) or real(f, n))
    items = [(i, " ".join(f"w{i}x{j}" for j in range(12))) for i in range(4)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = table(spark, [items[2][1], f"{items[0][1]} {items[3][1]}", None, "clean"])
    one = decontam.find_overlap(docs, bench).collect()
    assert settled == []
    many = decontam.find_overlap(docs, bench, shard_words=12)
    assert len(settled) == 3
    key = lambda r: r["row"]["doc_id"]
    assert sorted(many.collect(), key=key) == sorted(one, key=key)


TEXTS = ["Hello world, it's 12 o'clock!", None, "", "é漢字 😀\n\n  x", "<|endoftext|> a", "word " * 3000, "Zz", "Zz"]


def reference_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*model.encode(text or "", add_special_tokens=False).ids, 1]


def test_packing_is_a_round_trip(spark):
    docs = table(spark, TEXTS * 5)
    pieces = packing.pack(docs, window=64).collect()
    whole = {}
    for p in sorted(pieces, key=lambda p: (p["id"], p["start"])):
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] and p["start"] == len(whole.get(p["id"], []))
        whole.setdefault(p["id"], []).extend(ids)
    assert whole == {i: reference_ids(t) for i, t in enumerate(TEXTS * 5)}
    assert all(p["doc_tokens"] == len(whole[p["id"]]) for p in pieces)
    filled = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == filled.get(p["sequence_id"], 0)
        filled[p["sequence_id"]] = p["offset"] + p["length"]
    last = max(filled)
    assert sorted(filled) == list(range(last + 1))
    assert all(n == 64 for s, n in filled.items() if s != last) and filled[last] <= 64


def test_packing_digest_and_empty_table(spark):
    text = "abc<|endoftext|>d <|endoftext|> <|endoftex|>"
    row = packing.digest(packing.pack(table(spark, [text]))).first()
    ids = reference_ids(text)
    assert ids.count(50256) == 2
    assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()) and row["length"] == len(ids)
    assert packing.pack(table(spark, [])).collect() == []


def reference_count(vocabulary, text):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    model = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], unk_id=0))
    model.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(r"[\x20\x09-\x0d]+"), "removed"), pre_tokenizers.Metaspace(prepend_scheme="always", split=False)]
    )
    return len(model.encode(text, add_special_tokens=False).ids)


def test_counts_equal_a_unigram_tokenizer():
    rng = random.Random(2)
    for _ in range(40):
        letters = "abc"
        pieces = {counts.MARK: -4.0} | {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 4))): -float(rng.randrange(1, 6)) for _ in range(8)}
        pieces |= {counts.MARK + rng.choice(letters): -float(rng.randrange(1, 6))}
        counter = counts.Counter(list(pieces.items()))
        for _ in range(40):
            text = "".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 25)))
            assert counter.count(text)[0] == reference_count(list(pieces.items()), text), (pieces, text)


def test_texts_of_single_characters_take_the_short_way():
    """Texts without a gap are counted as the general way counts them; others are left to it."""
    rng = random.Random(5)
    vocabulary = [(c, -rng.randrange(1, 5) * 1.0) for c in "▁abcd"]
    vocabulary += [("".join(rng.choice("▁abcd") for _ in range(rng.randrange(2, 5))), -rng.randrange(1, 9) * 1.0) for _ in range(40)]
    one = counts.Counter(vocabulary)
    for _ in range(500):
        text = "▁" + "".join(rng.choice("abcd") for _ in range(rng.randrange(12)))
        assert one._covered(text) == one._with_gaps(text)
        assert one._covered(text + "z") is None and one._covered("z" + text) is None
        assert one._covered(text + "z" + text) is None


def test_counts_with_the_public_vocabulary(spark):
    vocabulary = counts.pieces_of(counts.default_vocabulary())
    out = {r["id"]: r["n_tokens"] for r in counts.count_pieces(table(spark, TEXTS)).collect()}
    assert out == {i: reference_count(vocabulary, t or "") for i, t in enumerate(TEXTS)}
    assert counts.count_pieces(table(spark, [])).collect() == []


def test_trees_learn_and_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    forest = quality.grow(x[:2000], y[:2000])
    scores = forest.scores(x[2000:])
    assert ((scores > 0.5) == y[2000:]).mean() > 0.95

    def walk(row):
        total = forest.base
        for s, t, v in zip(forest.statistic, forest.threshold, forest.value):
            node = 0
            while node < len(s):
                node = 2 * node + 1 + bool(row[s[node]] > t[node])
            total += v[node - len(s)]
        return 1 / (1 + np.exp(-total))

    np.testing.assert_allclose(scores[:50], [walk(r) for r in x[2000:2050]])


def test_held_out_quality(spark):
    rows = quality.op5_quality(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = rows.merge(labels, on="doc_id")
    fold = both[both.held_out]
    assert (both.held_out == both.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.3) == (rows.predicted == 1)).all()
    assert (fold.predicted == fold.quality).mean() > 0.9


def test_quality_of_odd_rows(spark):
    docs = table(spark, [None, "", "a" * 100_000, "x y z"])
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (99, 1)], "doc_id bigint, quality int")
    forest = quality.train(docs, labels)
    out = quality.scored(docs, forest).collect()
    assert len(out) == 4 and all(0 <= r["score"] <= 1 for r in out)
    assert quality.scored(docs.limit(0), forest).collect() == []
