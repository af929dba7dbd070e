"""N-gram Jaccard join: sets of word shingles in a prefix tree, exact at a given share.

A document is the set of its distinct `width`-word shingles (4), as 64-bit hashes, whose
order is the global one. Two documents link when 100 * intersection >= `percent` (85) * union.

1. Equal sets are one class, named by a hash of the set.
2. Candidates. If two sets link, at most a share H of their summed sizes differ (3/37 at 85 %). Hashes
   are cut into more ranges than elements can differ, so in at least one range the two sets agree wholly.
   A signature is the hash of what a set has in one range; classes of neighbouring size
   share their own ranges. Only classes that share a signature can link. Some ranges of a
   set may be empty: a few spare ranges stand for them, and a set with more empty ranges
   than spare ones signs those as well.
3. Every class is compared with one hub, the class it shares most signatures with among
   the smallest classes of its signatures. That is linear in the number of classes and
   settles most groups of near copies.
4. Signatures whose classes are still in different components are resolved in full. As a
   range is spoilt only by an element that differs, a set knows how many signatures it
   shares at least with any set it links with. A class with fewer unresolved signatures
   than that has no open link; of the others, all but the most frequent signatures that
   a link can do without are kept, so two that link still share one. Of classes still open, the
   shingles are put in one order, rarest first by counters of fixed size; of a set of n, the first
   n - ceil(share * n) + 1 elements hold one that any linked set has among its own. A common
   passage comes last in that order and brings nothing together. The classes that share such
   elements, joined to blocks by connected components, are cut into chunks by size and weight,
   and a class goes to the pairs of chunks in which an element of it meets a class of another
   component and fitting size.
5. Joining (3 and 4): the sets of a block are stored in a path-compressed prefix tree.
   A probe walks down the tree, so sets with a common beginning share the overlap
   counted there; a subtree is left when the sizes in it, or the overlap so far plus
   what can still come on both sides, cannot reach the threshold, or when probe and
   leaf are in one component already or share too few signatures for a link.

Lower case concerns A-Z only; words end at [\\x20\\x09-\\x0D]. Documents without words,
null texts: empty set, own component. Repeated rows and equal texts: one class. Rows with
the same id but different texts are one document for the ids, each with its own set size.
Null ids never name a component unless a group has no other. Empty tables give no rows.
Other columns are not read. 64-bit hashes stand for the shingles and sets themselves.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.batches import keep_modest
from plumbline.llm.components import components
from plumbline.sources.stored import release, settle

NGRAM = 4
PERCENT = 85
# shingles per chunk of a block, and per part of a hub's members (the hub goes to each)
CHUNK_WEIGHT, HUB_WEIGHT = 400_000, 50_000
GROWTH = 1.5
SEEN = 50_000
# counters of shingles, and the parts in which tasks hand them on
COUNTER_BITS, COUNTER_PARTS = 20, 16
U = np.uint64
MULTIPLIER = U(0x9E3779B97F4A7C15)
TURN = [U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)]


def mix(x: np.ndarray) -> np.ndarray:
    """A mixing of 64 bits that can be undone (finaliser of a counter-based generator)."""
    x = (x ^ (x >> U(30))) * TURN[0]
    x = (x ^ (x >> U(27))) * TURN[1]
    return x ^ (x >> U(31))


_POWERS = np.ones(1, U)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate(([U(1)], np.full(2 * n, MULTIPLIER))), dtype=U)
    return _POWERS[:n]


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash per word of lower-cased UTF-8 bytes."""
    data = np.frombuffer(raw, np.uint8)
    inside = (data != 32) & ((data < 9) | (data > 13))
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, U)
    sizes = ends - starts
    powers = _powers(int(sizes.max()))
    letters = data[inside].astype(U) + U(1)
    firsts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    places = np.arange(len(letters)) - np.repeat(firsts, sizes)
    return mix(np.add.reduceat(letters * powers[places], firsts) + sizes.astype(U))


def shingles(text: str | None, width: int = NGRAM) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of fewer words, of the whole sequence."""
    words = word_hashes((text or "").encode("utf-8", "replace").lower())
    n = len(words)
    if n == 0:
        return words
    span = min(n, width)
    total = np.full(n - span + 1, U(span))
    for i in range(span):
        total = total * MULTIPLIER + words[i : n - span + 1 + i]
    return np.unique(mix(total))


def set_hash(values: np.ndarray) -> int:
    whole = mix(values + TURN[2]).sum(dtype=U, keepdims=True) * MULTIPLIER + U(len(values))
    return int(mix(whole).view(np.int64)[0])


def differing(total: int, percent: int = PERCENT) -> int:
    """Most elements in which two linked sets of `total` summed size can differ."""
    return (100 - percent) * total // (100 + percent)


def _bounds(limit: int) -> list[int]:
    out = [1]
    while out[-1] <= limit:
        out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
    return out


BOUNDS = _bounds(1 << 34)


def classes(n: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(class number, most differing elements) of each size class in which a set of n takes part."""
    at = bisect_right(BOUNDS, n) - 1
    out = [(2 * at, differing(2 * (BOUNDS[at + 1] - 1), percent))]
    for edge in (at, at + 1):  # pairs across a bound: the smaller below it, the larger at or above
        bound = BOUNDS[edge]
        top = 100 * (bound - 1) // percent
        if percent * bound <= 100 * n and n <= top:
            out.append((2 * edge + 1, differing(bound - 1 + top, percent)))
    return [(c, h) for c, h in out if h > 0]


def signatures(values: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """One hash per range and size class; 48 bits, as equal ones are checked anyway."""
    if not len(values):
        return np.zeros(0, np.int64)
    mixed = mix(values + TURN[3])
    high = values >> U(32)
    out = []
    for number, most in classes(len(values), percent):
        spare = 2 + most // 32
        ranges = most + 1 + spare
        place = ((high * U(ranges)) >> U(32)).astype(np.int64)
        firsts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        sums = np.add.reduceat(mixed, firsts)
        names = place[firsts]
        if ranges - len(firsts) > spare:
            empty = np.setdiff1d(np.arange(ranges), names)
            names, sums = np.concatenate((names, empty)), np.concatenate((sums, np.zeros(len(empty), U)))
        out.append(mix(sums * MULTIPLIER + names.astype(U) + U(number << 40)) >> U(16))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def least_common(values: np.ndarray, percent: int = PERCENT) -> int:
    """Signatures the set shares at least with any unequal set it links with.

    Of all ranges, as many are spoilt as elements differ; ranges empty in both sets may be unsigned.
    """
    n, high, out = len(values), values >> U(32), []
    for number, most in classes(n, percent):
        spare = 2 + most // 32
        ranges = most + 1 + spare
        place = (high * U(ranges)) >> U(32)
        filled = 1 + int((place[1:] != place[:-1]).sum())
        spoilt = min(most, differing(n + 100 * n // percent, percent))
        out.append(ranges - spoilt - min(spare, ranges - filled))
    return min(out, default=1)


class PrefixTree:
    """Sorted sets by common beginnings; every node holds a run of elements."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = [len(s) for s in sets]
        self.runs: list[np.ndarray] = []
        self.below: list[list[int]] = []
        self.here: list[list[int]] = []
        self.depth: list[int] = []
        self.least: list[int] = []
        self.most: list[int] = []
        self.roots: list[int] = []
        order = sorted((i for i in range(len(sets)) if len(sets[i])), key=lambda i: sets[i].astype(">u8").tobytes())
        pending = [(None, part, 0) for part in self._parts(sets, order, 0)]
        while pending:
            parent, part, depth = pending.pop()
            first, last = sets[part[0]], sets[part[-1]]
            size = min(len(first), len(last))
            unequal = np.flatnonzero(first[depth:size] != last[depth:size])
            end = depth + int(unequal[0]) if len(unequal) else size
            node = len(self.runs)
            ending = [i for i in part if self.sizes[i] == end]
            self.runs.append(first[depth:end])
            self.below.append([])
            self.here.append(ending)
            self.depth.append(end)
            lengths = [self.sizes[i] for i in part]
            self.least.append(min(lengths))
            self.most.append(max(lengths))
            (self.roots if parent is None else self.below[parent]).append(node)
            rest = part[len(ending) :]
            pending.extend((node, p, end) for p in self._parts(sets, rest, end))

    @staticmethod
    def _parts(sets, order, depth):
        out, last = [], None
        for i in order:
            head = sets[i][depth]
            if head != last:
                out.append([])
                last = head
            out[-1].append(i)
        return out

    def linked(self, probe: np.ndarray, percent: int, skip) -> list[int]:
        """Numbers of the stored sets that link with the probe; `skip(i)` tells which need no look."""
        n = len(probe)
        found: list[int] = []
        low, high = -(-percent * n // 100), 100 * n // percent
        pending = [(node, 0) for node in self.roots]
        while pending:
            node, shared = pending.pop()
            if self.most[node] < low or self.least[node] > high:
                continue
            below, here = self.below[node], self.here[node]
            if not below and all(skip(i) for i in here):
                continue
            run = self.runs[node]
            at = probe.searchsorted(run)
            shared += int((probe[np.minimum(at, n - 1)] == run).sum())
            end = self.depth[node]
            # elements of the probe after this run, elements of the longest set after it
            left = n - int(at[-1])
            possible = shared + min(left, self.most[node] - end)
            if (100 + percent) * possible < percent * (n + max(self.least[node], low)):
                continue
            for i in here:
                if (100 + percent) * shared >= percent * (n + self.sizes[i]) and not skip(i):
                    found.append(i)
            pending.extend((child, shared) for child in below)
        return found


def shingle_table(
    docs: DataFrame, id_col: str, text_col: str, width: int = NGRAM, percent: int = PERCENT
) -> DataFrame:
    """(id, n, class, print, need): set size, set hash (null for an empty set), hash of the text, `least_common`."""

    def measure(batches):
        for batch in batches:
            sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64()),
                    batch.column(2),
                    pa.array([least_common(s, percent) if len(s) else 1 for s in sets], pa.int64()),
                ],
                names=["id", "n", "class", "print", "need"],
            )

    return _chosen(docs, id_col, text_col).mapInArrow(
        measure, "id bigint, n bigint, class bigint, print bigint, need bigint"
    )


def _chosen(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"), text.alias("text"), F.xxhash64(text).alias("print")
    )


def signature_table(docs: DataFrame, id_col: str, text_col: str, percent: int, width: int) -> DataFrame:
    """(signature, class) rows; copies within a task sign once, as far as a bounded memo goes."""

    def sign(batches):
        seen: set[int] = set()
        for batch in batches:
            names, sizes, parts = [], [], []
            for text in batch.column(0).to_pylist():
                values = shingles(text, width)
                if not len(values):
                    continue
                name = set_hash(values)
                if name in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(name)
                signed = signatures(values, percent)
                names.append(name)
                sizes.append(len(signed))
                parts.append(signed)
            if names:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(parts), pa.int64()),
                        pa.array(np.repeat(np.array(names, np.int64), sizes), pa.int64()),
                    ],
                    names=["signature", "class"],
                )

    return _chosen(docs, id_col, text_col).select("text").mapInArrow(sign, "signature bigint, class bigint")


def joined(rows: DataFrame, percent: int, width: int) -> DataFrame:
    """Links (a, b) found in blocks.

    rows: block (any columns of `keys`), role (0 probe, 1 stored, 2 both), class, component, text;
    clustered by block. Within a block, classes of one component are not compared again.
    """

    def join(batches):
        key, held = None, []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            links = []
            for block, chunk, role, name, component, text in zip(*cols):
                if (block, chunk) != key:
                    links += _block_links(held, percent)
                    key, held = (block, chunk), []
                held.append((role, name, component, shingles(text, width)))
            yield _edges(links)
        yield _edges(_block_links(held, percent))

    return rows.select("block", "chunk", "role", "class", "component", "text").mapInArrow(join, "a bigint, b bigint")


def _edges(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"]
    )


def _block_links(rows: list, percent: int) -> list[tuple[int, int]]:
    stored = [r for r in rows if r[0] > 0]
    probes = [r for r in rows if r[0] != 1]
    if not stored or not probes:
        return []
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    tree = PrefixTree([r[3] for r in stored])
    holders: dict[int, list[int]] = {}
    if len(probes) > 1:
        for i, row in enumerate(stored):
            for signature in signatures(row[3], percent).tolist():
                holders.setdefault(signature, []).append(i)
    links = []
    for _, name, component, values in probes:
        if not len(values):
            continue
        if len(probes) > 1:
            common = Counter(i for s in signatures(values, percent).tolist() for i in holders.get(s, ()))
            least = least_common(values, percent)
            near = {i for i, n in common.items() if n >= least}
        else:
            near = range(len(stored))
        if not near:
            continue
        skip = lambda i, near=near: i not in near or top(stored[i][2]) == top(component)
        for i in tree.linked(values, percent, skip):
            a, b = top(component), top(stored[i][2])
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((name, stored[i][1]))
    return links


def links_of(docs: DataFrame, table: DataFrame, id_col: str, text_col: str, percent: int, width: int) -> DataFrame:
    """Edges (a, b) between classes that connect all that is linked."""
    signed = signature_table(docs, id_col, text_col, percent, width)
    of_signature = Window.partitionBy("signature")
    shared = settle(
        signed.withColumn("hub", F.min("class").over(of_signature))
        .withColumn("last", F.max("class").over(of_signature))
        .where("hub <> last")
        .select("signature", "class", "hub")
        .distinct(),
        "signatures",
    )
    texts = settle(_texts(docs, table, shared.select("class").distinct(), id_col, text_col), "texts")
    near = settle(_hub_links(shared, texts, percent, width), "links")
    placed = components(near)
    named = shared.join(placed.withColumnRenamed("node", "class"), "class", "left").select(
        "signature", "class", F.coalesce("component", "class").alias("component")
    )
    rest = settle(_unresolved(named), "unresolved")
    release(shared)
    if rest.isEmpty():
        release(texts, rest)
        return near
    sizes = texts.select("class", "n", "need")
    # classes that have too few open signatures for any link go first, as this also lowers frequencies
    enough = rest.groupBy("class").agg(F.count("*").alias("open")).join(sizes, "class").where("open >= need")
    fewer = settle(_unresolved(rest.join(enough.select("class", "n", "need"), "class")), "unresolved")
    release(rest)
    still = settle(_unresolved(_rarest(fewer)).select("class", "component").distinct(), "open")
    release(fewer)
    elements = settle(_unresolved(prefix_table(texts.join(still, "class"), shared_counts(texts, width), percent, width)), "prefixes")
    release(still)
    if elements.isEmpty():
        release(texts, elements)
        return near
    blocks = components(elements.select(F.col("class").alias("a"), F.col("first").alias("b")))
    placed = elements.join(blocks.select(F.col("node").alias("class"), F.col("component").alias("block")), "class")
    more = settle(_block_rest(placed, texts, percent, width), "links")
    release(texts, elements)
    return near.union(more)


def _slots(values: np.ndarray) -> np.ndarray:
    return (values >> U(64 - COUNTER_BITS)).astype(np.int64)


def shared_counts(texts: DataFrame, width: int) -> np.ndarray:
    """Counters of the classes' shingles by the first COUNTER_BITS of their hash: fixed in size, added up over tasks."""

    def count(batches):
        total, pending, held = np.zeros(1 << COUNTER_BITS, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                pending.append(_slots(shingles(text, width)))
                held += len(pending[-1])
                if held >= len(total):
                    total += np.bincount(np.concatenate(pending), minlength=len(total))
                    pending, held = [], 0
        if pending:
            total += np.bincount(np.concatenate(pending), minlength=len(total))
        parts = np.split(total, COUNTER_PARTS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(COUNTER_PARTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
            names=["part", "counts"],
        )

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_buffer(), np.int64) for c in table["counts"])
        return pa.table({"part": table["part"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, counts binary"
    rows = texts.select("text").mapInArrow(count, schema).groupBy("part").applyInArrow(add, schema).collect()
    return np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(rows, key=lambda r: r["part"])])


def prefix_length(n: int, percent: int) -> int:
    """So many elements of a set, first in any one order of all elements, hold one of every set it links with."""
    return n + (-percent * n) // 100 + 1


def prefix_table(rows: DataFrame, counts: np.ndarray, percent: int, width: int) -> DataFrame:
    """(signature, class, component, n): the first shingles of each set, those of the least counters first."""

    def cut(batches):
        for batch in batches:
            names, parts, sizes = [], [], []
            for text in batch.column(3).to_pylist():
                values = shingles(text, width)
                order = np.lexsort((values, counts[_slots(values)]))[: prefix_length(len(values), percent)]
                parts.append(values[order].view(np.int64))
                sizes.append(len(order))
            if sizes:
                repeated = [pa.array(np.repeat(batch.column(i).to_numpy(), sizes), pa.int64()) for i in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(parts), pa.int64()), *repeated], names=["signature", "class", "component", "n"]
                )

    return rows.select("class", "component", "n", "text").mapInArrow(
        cut, "signature bigint, class bigint, component bigint, n bigint"
    )


def _unresolved(named: DataFrame) -> DataFrame:
    """Rows of signatures found in more than one component, with the signature's first class and frequency."""
    over = named.groupBy("signature").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.min("class").alias("first"), F.count("*").alias("held")
    )
    return named.drop("first", "held").join(over.where("x <> y").select("signature", "first", "held"), "signature")


def _rarest(rest: DataFrame) -> DataFrame:
    """Without the `need` - 1 most frequent signatures of each class, in one order for all classes.

    Two classes that link share `need` signatures or more, so the rarest of them stays on both sides.
    """
    order = Window.partitionBy("class").orderBy(F.desc("held"), F.desc("signature"))
    return rest.withColumn("position", F.row_number().over(order)).where("position >= need").drop("position")


def _texts(docs: DataFrame, table: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(class, n, need, text): one text for each wanted class."""
    one = (
        table.join(wanted, "class", "left_semi")
        .groupBy("class")
        .agg(F.min(F.struct("id", "print", "n", "need")).alias("x"))
        .select("class", "x.*")
    )
    texts = _chosen(docs, id_col, text_col)
    same = texts["id"].eqNullSafe(one["id"]) & (texts["print"] == one["print"])
    return texts.join(one, same).select("class", "n", "need", "text")


def _hub_links(shared: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    common = shared.where("class <> hub").groupBy("class", "hub").agg(F.count("*").alias("common"))
    best = common.groupBy("class").agg(F.max(F.struct("common", "hub")).alias("best"))
    pairs = settle(best.select("class", F.col("best.hub").alias("hub")), "pairs")
    weights = (
        pairs.join(texts.select("class", "n"), "class")
        .groupBy("hub")
        .agg(F.ceil(F.sum("n") / HUB_WEIGHT).cast("bigint").alias("chunks"))
    )
    members = pairs.join(weights, "hub").select(
        F.col("hub").alias("block"),
        F.pmod(F.xxhash64("class"), F.col("chunks")).alias("chunk"),
        F.lit(1).alias("role"),
        "class",
    )
    hubs = weights.select(
        F.col("hub").alias("block"),
        F.explode(F.expr("sequence(0L, chunks - 1)")).alias("chunk"),
        F.lit(0).alias("role"),
        F.col("hub").alias("class"),
    )
    # members and hubs meet their texts in one join, so texts are shuffled once
    placed = members.unionByName(hubs).join(texts.select("class", "text"), "class")
    rows = placed.withColumn("component", F.col("class")).repartition("block", "chunk").sortWithinPartitions("block", "chunk")
    return joined(rows, percent, width)


def _block_rest(placed: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Links between the classes of a block; placed: (signature, class, component, n, block)."""
    # sizes of linked sets lie in the same or in neighbouring steps
    step = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent)))
    placed = placed.withColumn("step", step)
    members = placed.select("block", "step", "class", "component", "n").distinct()
    chunks = members.groupBy("block", "step").agg(F.ceil(F.sum("n") / CHUNK_WEIGHT).cast("bigint").alias("chunks"))
    number = (F.col("step") * F.lit(1 << 32) + F.pmod(F.xxhash64("class"), F.col("chunks"))).alias("own")
    held = settle(
        members.join(chunks, ["block", "step"])
        .select("class", number)
        .join(placed.select("signature", "class", "component", "n", "block"), "class"),
        "held",
    )
    targets = held.groupBy("signature", F.col("own").alias("other")).agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("component").alias("x"), F.max("component").alias("y")
    )
    fits = (F.col("n") * percent <= F.col("most") * 100) & (F.col("least") * percent <= F.col("n") * 100)
    differ = (F.col("x") != F.col("component")) | (F.col("y") != F.col("component"))
    met = held.join(targets, "signature").where(fits & differ).select("block", "own", "other", "class", "component").distinct()
    rows = met.join(texts.select("class", "text"), "class").select(
        "block",
        F.struct(F.least("own", "other"), F.greatest("own", "other")).cast("string").alias("chunk"),
        F.expr("CASE WHEN own = other THEN 2 WHEN own < other THEN 0 ELSE 1 END").alias("role"),
        "class",
        "component",
        "text",
    )
    return joined(rows.repartition("block", "chunk").sortWithinPartitions("block", "chunk"), percent, width)


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = NGRAM
) -> DataFrame:
    """id, n_shingles, component_id and print (hash of the text), one row per document."""
    keep_modest(docs.sparkSession)
    table = settle(shingle_table(docs, id_col, text_col, width, percent), "shingles")
    links = links_of(docs, table, id_col, text_col, percent, width)
    names = table.where("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("least"))
    # documents that share an id are one node as well
    placed = names.join(components(links).withColumnRenamed("node", "class"), "class", "left").select(
        "class", F.coalesce("component", "class").alias("component"), "least"
    )
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(smallest, "component").select("class", "component_id")
    return table.join(named, "class", "left").select(
        "id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        "print",
    )


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    groups = similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
