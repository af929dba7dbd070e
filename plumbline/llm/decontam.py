"""Benchmark decontamination with a generalised suffix automaton of the items' words.

The automaton of all items is built once over word numbers. Each document's
words are streamed through it and the length of the longest match that ends at
every word is tracked. Where that length reaches the window (10 words), the whole
match is hit; an item shorter than a window is hit where all of it occurs.

Only stretches in which every pair of neighbouring words also stands in some item
can hold a match of two words or more, so the automaton runs on those stretches
and starts afresh at each; the filter is one array lookup per word.

Items are read in shards of at most `SHARD_WORDS` words (or one item), one automaton
each, and documents pass all of them in turn. Between two shards the documents are
written with what was found so far, so the driver holds two shards and a task one
automaton at a time: a larger benchmark takes more passes, not more memory.

Null and empty texts have no words; items without words, or without an id, take no
part. Repeated items count once per item id. Repeated documents are judged row by
row. Empty tables give no rows, or no hits. Other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.batches import keep_modest
from plumbline.sources.stored import release, settle

WINDOW = 10
SHARD_WORDS = 200_000
# spans longer than this, or covering more of a document than this, are removed
MIN_SPAN_WORDS = 10
MAX_COVERAGE = 0.5
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
# A-Z to lower case, every byte that is no part of a word to a space
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
SLOTS = 1 << 22
STATE = "row struct<{row}>, n_words bigint, spans array<struct<first: bigint, last: bigint>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(FOLD).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences; states are list positions, 0 is the root."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        # state -> items one of whose windows of `length` words ends there
        self.ends: dict[int, dict[int, set[str]]] = {}
        coded = []
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            coded.append((name, ids))
            last = 0
            for word in ids:
                last = self._extend(last, word)
        for name, ids in coded:
            span = min(window, len(ids))
            state = matched = 0
            for word in ids:
                state, matched = self.step(state, matched, word)
                state, matched = self.shorten(state, min(matched, span))
                if matched == span:
                    self.ends.setdefault(state, {}).setdefault(span, set()).add(name)
        # longest window end among a state and its suffixes, so that most states need no walk
        self.reach = [0] * len(self.length)
        for state in sorted(range(len(self.length)), key=self.length.__getitem__):
            above = self.reach[self.link[state]] if state else 0
            self.reach[state] = 1 if above or state in self.ends else 0
        self.shortest = min((s for e in self.ends.values() for s in e), default=window)
        self.pairs = np.zeros(SLOTS, dtype=bool)
        for _, ids in coded:
            codes = np.array(ids, dtype=np.int64)
            self.pairs[_pair(codes[:-1], codes[1:])] = True

    def _extend(self, last: int, word: int) -> int:
        """Append a word to the sequence that ends in `last`."""
        if word in self.next[last]:
            known = self.next[last][word]
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, word, known)
        fresh = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = fresh
            at = self.link[at]
        if at >= 0:
            known = self.next[at][word]
            self.link[fresh] = known if self.length[known] == self.length[at] + 1 else self._split(at, word, known)
        return fresh

    def _split(self, at: int, word: int, known: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.next[known]), self.link[known])
        self.link[known] = copy
        while at >= 0 and self.next[at].get(word) == known:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def step(self, state: int, matched: int, word: int) -> tuple[int, int]:
        """The longest suffix of (what was matched + word) that some item holds."""
        while word not in self.next[state]:
            state = self.link[state]
            if state < 0:
                return 0, 0
            matched = self.length[state]
        return self.next[state][word], matched + 1

    def shorten(self, state: int, matched: int) -> tuple[int, int]:
        """The state of the last `matched` words."""
        while state and self.length[self.link[state]] >= matched:
            state = self.link[state]
        return state, matched

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans as (first, last) word numbers, merged and in order, and the items found."""
        get = self.vocabulary.get
        ids = np.fromiter([get(w, 0) for w in words], dtype=np.int64, count=len(words))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for begin, end in self._stretches(ids):
            state = matched = 0
            for at, word in enumerate(ids[begin:end].tolist(), begin):
                state, matched = self.step(state, matched, word)
                # a longer match than a window is a window too: look it up by its own state
                if matched >= self.shortest and self.reach[state]:
                    longest = self._ending(state, matched, found)
                    if longest:
                        first = at - longest + 1
                        while spans and spans[-1][1] >= first - 1:
                            first = min(first, spans.pop()[0])
                        spans.append((first, at))
        return spans, found

    def _ending(self, state: int, matched: int, found: set[str]) -> int:
        """Longest window that ends here; its items and those of shorter windows are added."""
        longest = 0
        while state > 0:
            for span, names in self.ends.get(state, {}).items():
                if span <= matched:
                    longest = max(longest, span)
                    found |= names
            state = self.link[state]
            matched = self.length[state] if state >= 0 else 0
        return longest

    def _stretches(self, ids: np.ndarray):
        """Runs of known words, for windows of two words and more of known neighbours."""
        if self.shortest < 2:
            good = ids > 0
            edges = np.flatnonzero(np.diff(np.concatenate(([False], good, [False])).astype(np.int8)))
            return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]
        good = (ids[:-1] > 0) & (ids[1:] > 0)
        good[good] = self.pairs[_pair(ids[:-1][good], ids[1:][good])]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], good, [False])).astype(np.int8)))
        return [(int(a), int(b) + 1) for a, b in zip(edges[::2], edges[1::2]) if b + 1 - a >= self.shortest]


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ((left * 0x9E3779B1 + right * 0x85EBCA6B) >> 7) & (SLOTS - 1)


def shards(items: DataFrame, id_col: str, text_col: str, limit: int):
    """The items in lists of at most `limit` words (or one item), read partition by partition."""
    held, size = [], 0
    chosen = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    for row in chosen.where("id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        words = words_of(row["text"])
        if not words:
            continue
        if held and size + len(words) > limit:
            yield held
            held, size = [], 0
        held.append((row["id"], words))
        size += len(words)
    if held:
        yield held


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def find_overlap(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """Columns row (all columns of the document), n_words, spans and items.

    With several shards this runs one job a shard but for the last.
    """
    frame = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.expr("cast(array() as array<struct<first: bigint, last: bigint>>)").alias("spans"),
        F.expr("cast(array() as array<string>)").alias("items"),
    )
    schema = frame.schema
    at = docs.columns.index(text_col)
    context = docs.sparkSession.sparkContext
    keep_modest(docs.sparkSession)
    passes = shards(items, item_id, item_text, shard_words)
    following, stored = next(passes, []), None
    while following is not None:
        shard, following = following, next(passes, None)
        shared = context.broadcast(Automaton(shard, window))

        def stream(batches, shared=shared):
            automaton = shared.value
            for batch in batches:
                counts, spans, names = [], [], []
                texts = batch.column(0).field(at).cast(pa.string())
                earlier = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
                for text, (old, known) in zip(texts, earlier):
                    words = words_of(text.as_py())
                    new, found = automaton.scan(words)
                    pairs = [(x["first"], x["last"]) for x in old] + new if old else new
                    counts.append(len(words))
                    spans.append([{"first": a, "last": b} for a, b in merged(pairs)])
                    names.append(sorted(found.union(known)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(counts, pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                        pa.array(names, pa.list_(pa.string())),
                    ],
                    names=["row", "n_words", "spans", "items"],
                )

        frame = frame.mapInArrow(stream, schema)
        if following is not None:
            earlier, stored = stored, settle(frame, "overlap")
            frame = stored
            shared.destroy()
            if earlier is not None:
                release(earlier)
    return frame


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_overlap(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.last - s.first + 1)")
    return found.select(
        F.col("row.doc_id").cast("bigint").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode("utf-8", "replace")
    places = [m.span() for m in WORD.finditer(raw.translate(FOLD))]
    out, at = [], 0
    for first, last in spans:
        out.append(raw[at : places[first][0]])
        at = places[last][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")


def cleaned(docs: DataFrame, items: DataFrame, text_col: str = "text", min_span: int = MIN_SPAN_WORDS, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """Documents without benchmark spans of `min_span` words and more.

    Shorter spans (of items with fewer words) stay in the text, but count as hit: a document of
    which more than `max_coverage` is hit goes. The columns stay as they were.
    """
    found = find_overlap(docs, items, text_col)
    at = docs.columns.index(text_col)
    schema = docs.schema
    names = docs.columns

    def cut(batches):
        for batch in batches:
            rows = batch.column(0)
            columns = [rows.field(i) for i in range(len(names))]
            spans = batch.column(2).to_pylist()
            texts = columns[at].to_pylist() if any(spans) else None
            keep = []
            for i, (n, held) in enumerate(zip(batch.column(1).to_pylist(), spans)):
                hit = sum(s["last"] - s["first"] + 1 for s in held)
                keep.append(not held or hit <= max_coverage * n)
                long = [(s["first"], s["last"]) for s in held if s["last"] - s["first"] + 1 >= min_span]
                if long:
                    texts[i] = without_spans(texts[i], long)
            if texts is not None:
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return found.select("row", "n_words", "spans").mapInArrow(cut, schema)


def items_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
