"""Document fingerprints from prefix polynomial hashes.

For a text with code points c the prefix array P[i] holds the sum of c_j B^j, j < i, modulo a prime.
Any span [i, i + n) then has the hash (P[i + n] - P[i]) B^-i, wherever it stands, so two spans
are compared in constant time, and the longest common extension of two places is found by binary
search over its length. Two primes below 2^31 make 62 bits; equal hashes stand for equal spans.

A fingerprint is: number of code points, hash of the whole text (62 bits), and the SKETCH
smallest mixed hashes of its distinct spans of SPAN code points (a shorter text is one
span). The likeness of two fingerprints is the share of spans in common, estimated from the
smallest SKETCH hashes of both together (exact where both texts have fewer spans). Equal texts
have equal fingerprints and likeness 1; two empty texts are alike, an empty and another are not.

`edited` pairs each document with the next one by descending id, after the last the first. Ids that
start a range (quantiles of the ids, few numbers) split the documents; compressed texts are
shuffled once by range, the document that starts a range also goes to the range before it,
and each range is read in order with one document in hand. Prefix and span hashes of an
edited text are put together from those of its two parts; only spans across the seam are new.

Null, empty texts: no code points. A lone document is its own next. Long texts: about 100 bytes a
code point while the text is in hand. Null ids come last. Rows that repeat an id
are ordered by a hash of their text and stay in one range, which is streamed, never held. Empty
table: no rows. Other columns are not read. Unpaired surrogates count as U+FFFD.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.batches import keep_modest

SPAN, SKETCH = 20, 32
PRIMES = (2**31 - 1, 2**31 - 19)
BASES = (1_000_003, 998_244_353)
RANGES_PER_PARTITION = 4
SLICE = 256
PACKED = "bucket int, extra int, doc_id bigint, tie bigint, size bigint, packed binary"


class Powers:
    """Powers of a base and of its inverse modulo a prime, as far as asked for."""

    def __init__(self, prime: int, base: int):
        self.prime, self.base, self.inverse = prime, base, pow(base, -1, prime)
        self.up = self.down = np.ones(1, np.int64)

    def reach(self, n: int) -> None:
        while len(self.up) < n:
            have = len(self.up)
            self.up = np.concatenate((self.up, self.up * pow(self.base, have, self.prime) % self.prime))
            self.down = np.concatenate((self.down, self.down * pow(self.inverse, have, self.prime) % self.prime))


_POWERS = [Powers(p, b) for p, b in zip(PRIMES, BASES)]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)


class PrefixHashes:
    """Prefix arrays of one text, one per prime."""

    def __init__(self, sums: list[np.ndarray]):
        self.sums = sums

    @classmethod
    def of(cls, text: str) -> "PrefixHashes":
        # code point 0 counts too
        letters = code_points(text) + 1
        sums = []
        for powers in _POWERS:
            powers.reach(len(letters) + 1)
            # below 2^31 each: sums of fewer than 2^32 terms fit 63 bits
            terms = letters * powers.up[: len(letters)] % powers.prime
            sums.append(np.concatenate(([0], np.cumsum(terms) % powers.prime)))
        return cls(sums)

    def __len__(self) -> int:
        return len(self.sums[0]) - 1

    def joined(self, keep: int, other: "PrefixHashes", take: int) -> "PrefixHashes":
        """Prefix arrays of the first `keep` code points followed by the other's first `take`."""
        out = []
        for powers, mine, theirs in zip(_POWERS, self.sums, other.sums):
            powers.reach(keep + 1)
            moved = theirs[1 : take + 1] * powers.up[keep] % powers.prime
            out.append(np.concatenate((mine[: keep + 1], (mine[keep] + moved) % powers.prime)))
        return PrefixHashes(out)

    def span(self, start: int, length: int) -> int:
        """Hash of a span, the same wherever it stands."""
        out = 0
        for powers, sums in zip(_POWERS, self.sums):
            powers.reach(start + 1)
            own = int(sums[start + length] - sums[start]) * int(powers.down[start]) % powers.prime
            out = out << 31 | own
        return out

    def common_extension(self, start: int, other: "PrefixHashes", there: int) -> int:
        """Longest n with equal spans of n code points at `start` here and `there` in the other."""
        low, high = 0, min(len(self) - start, len(other) - there)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(start, middle) == other.span(there, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def spans(self, length: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Hashes of all spans of `length` that begin in [first, last); by the first prime, mixed to 32 bits."""
        powers, sums = _POWERS[0], self.sums[0]
        last = len(self) - length + 1 if last is None else last
        powers.reach(max(last, 1))
        own = (sums[first + length : last + length] - sums[first:last]) % powers.prime
        return mixed(own * powers.down[first:last] % powers.prime)


def mixed(x: np.ndarray) -> np.ndarray:
    """32 well-mixed bits (a common finaliser of 64-bit hashes)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (x >> np.uint64(32)).astype(np.uint32)


def smallest(values: np.ndarray, k: int = SKETCH) -> np.ndarray:
    """The k smallest distinct values, ascending."""
    for some in (4 * k, len(values)):
        part = np.partition(values, some)[:some] if some < len(values) else values
        own = np.unique(part)
        if len(own) >= k or some >= len(values):
            break
    return own[:k]


class Prints:
    """A text's prefix arrays, span hashes and fingerprint."""

    def __init__(self, hashes: PrefixHashes, spans: np.ndarray | None = None):
        self.hashes = hashes
        n = len(hashes)
        width = min(SPAN, n)
        self.spans = spans if spans is not None else hashes.spans(width) if n else np.zeros(0, np.uint32)
        self.sketch = smallest(self.spans)

    @classmethod
    def of(cls, text: str) -> "Prints":
        return cls(PrefixHashes.of(text))

    def edited(self, keep: int, other: "Prints", take: int) -> "Prints":
        """Of the first `keep` code points followed by the other's first `take`."""
        hashes = self.hashes.joined(keep, other.hashes, take)
        if keep < SPAN or take < SPAN:
            return Prints(hashes)
        seam = hashes.spans(SPAN, keep - SPAN + 1, keep)
        return Prints(hashes, np.concatenate((self.spans[: keep - SPAN + 1], seam, other.spans[: take - SPAN + 1])))

    def fingerprint(self) -> str:
        whole = self.hashes.span(0, len(self.hashes))
        return f"{len(self.hashes):x}-{whole:016x}-{self.sketch.astype('>u4').tobytes().hex()}"


def likeness(one: np.ndarray, two: np.ndarray, k: int = SKETCH) -> float:
    """Share of common spans, from two sketches."""
    if not len(one) and not len(two):
        return 1.0
    union = np.union1d(one, two)[:k]
    both = np.intersect1d(one, two, assume_unique=True)
    return float(np.isin(both, union, assume_unique=True).sum() / len(union))


def compared(mine: str, own: Prints, theirs: str, other: Prints) -> tuple:
    """Figures of a text, its edited form and the next text."""
    n = len(mine)
    keep, take = n - n // 3, min(n // 3, len(theirs))
    changed = own.edited(keep, other, take)
    text = mine[:keep] + theirs[:take]
    return (
        n,
        hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(),
        own.fingerprint(),
        changed.fingerprint(),
        likeness(own.sketch, changed.sketch),
        likeness(own.sketch, other.sketch),
        own.hashes.common_extension(0, changed.hashes, 0),
        own.hashes.common_extension(0, other.hashes, 0),
    )


RESULT = {
    "doc_id": "bigint",
    "n_chars": "bigint",
    "edited_sha256": "string",
    "fingerprint": "string",
    "edited_fingerprint": "string",
    "near_edited": "double",
    "near_next": "double",
    "prefix_edited": "bigint",
    "prefix_next": "bigint",
}
ARROW = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32(), "binary": pa.binary()}


def range_starts(ids: DataFrame, ranges: int) -> list[int]:
    """Ids, descending, that start a range; the largest id is the first. `ranges` numbers at most."""
    shares = [i / ranges for i in range(1, ranges)]
    row = ids.agg(F.max("id").alias("top"), F.percentile_approx("id", shares or [0.5], F.lit(100 * ranges)).alias("cuts")).first()
    if row["top"] is None:
        return []
    return sorted({row["top"], *(row["cuts"] if shares else [])}, reverse=True)


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of figures (see RESULT) per document."""
    spark = docs.sparkSession
    keep_modest(spark)
    ids = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    starts = range_starts(ids, RANGES_PER_PARTITION * partitions)
    # ascending, for the search
    climbing = np.array(starts[::-1], np.int64)

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                out = [[] for _ in range(6)]
                for one, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    raw = (text or "").encode("utf-8", "replace")
                    # the range whose start is the smallest id not below this one; null ids come last
                    bucket = max(0, len(starts) - 1)
                    if one is not None:
                        bucket = len(starts) - 1 - int(np.searchsorted(climbing, one))
                    places = [(bucket, 0)]
                    if one is None and not starts or starts and one == starts[bucket]:
                        places.append(((bucket or max(1, len(starts))) - 1, 1))
                    tie = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)
                    packed = pa.compress(raw, codec="zstd", asbytes=True)
                    for where, extra in places:
                        for column, value in zip(out, (where, extra, one, tie, len(raw), packed)):
                            column.append(value)
                yield table_of(out, PACKED)

    def walk(batches):
        out: list[list] = [[] for _ in RESULT]
        held = None  # bucket, doc_id, text, prints
        closed = None
        for batch in batches:
            for bucket, extra, one, size, packed in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if bucket == closed:
                    continue  # of rows that share the id of a start, only the first is next
                text = pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True).decode() if size else ""
                now = (bucket, one, text, Prints.of(text))
                if held is not None:
                    for column, value in zip(out, (held[1], *compared(held[2], held[3], text, now[3]))):
                        column.append(value)
                    if len(out[0]) == SLICE:
                        yield table_of(out, RESULT)
                        out = [[] for _ in RESULT]
                held, closed = (None, bucket) if extra else (now, closed)
        yield table_of(out, RESULT)

    chosen = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ordered = (
        chosen.mapInArrow(pack, PACKED)
        .repartition("bucket")
        .sortWithinPartitions("bucket", "extra", F.col("doc_id").desc_nulls_last(), "tie")
    )
    schema = ", ".join(f"{k} {v}" for k, v in RESULT.items())
    return ordered.select("bucket", "extra", "doc_id", "size", "packed").mapInArrow(walk, schema)


def table_of(columns: list[list], schema: str | dict) -> pa.RecordBatch:
    fields = schema if isinstance(schema, dict) else dict(f.split() for f in schema.split(", "))
    arrays = [pa.array(c, ARROW[kind]) for c, kind in zip(columns, fields.values())]
    return pa.RecordBatch.from_arrays(arrays, names=list(fields))


def op12_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
