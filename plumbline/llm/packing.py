"""Packing: concatenate all documents and cut the stream into fixed windows.

Two passes of prefix sums give every token its global place. Pass one tokenizes
each text once and writes, per row, its ids and its offset within the task that
made it, so the written table fixes the order of the stream. Pass two sums the
tokens per task, turns those few totals into offsets by a running sum, and cuts
documents where a window of `window` ids ends. A document that crosses a window
leaves one boundary record (piece) per window it touches.

Every window is full but the last, so padding is below one window in all.

Null, empty texts: only the closing id. Long texts: cut as often as needed.
Ties and repeated rows: each row is its own document, also when ids repeat; null
ids stay null. Empty tables: no pieces. Other columns are not read.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.batches import keep_modest
from plumbline.sources.stored import settle

WINDOW = 2048
END_ID = 1
# rows per Arrow batch sent back to Spark
SLICE = 256
TOKEN_TABLE = "id bigint, part int, local bigint, n bigint, ids binary"


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from text to ids: ranks of a byte-level vocabulary, marks of added tokens as one id each.

    `path` is the vocabulary's JSON file; its rank file, beside it, gives the same ids about four times as fast.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        added = {t["content"]: int(t["id"]) for t in json.load(file)["added_tokens"]}
    with open(re.sub(r"[.]json$", ".tiktoken", path), "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    made = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: made.encode(text, allowed_special="all")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenized(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """One row per document: ids as little-endian unsigned 32-bit, and its place within its task."""

    def encode(batches):
        encode_one = encoder(vocabulary)
        part, local = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                counts, places, blobs = [], [], []
                for text in piece.column(1).to_pylist():
                    ids = np.array([*encode_one(text or ""), end_id], dtype="<u4")
                    counts.append(len(ids))
                    places.append(local)
                    blobs.append(ids.tobytes())
                    local += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        pa.array([part] * len(counts), pa.int32()),
                        pa.array(places, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(blobs, pa.binary()),
                    ],
                    names=["id", "part", "local", "n", "ids"],
                )

    keep_modest(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(encode, TOKEN_TABLE)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces: id, start, length, ids (binary), doc_tokens, sequence_id, offset."""
    stream = settle(tokenized(docs, id_col, text_col, vocabulary or default_vocabulary(), end_id), "tokens")
    # one row per task of the first pass: the running sum runs over a few numbers
    totals = stream.groupBy("part").agg(F.max(F.col("local") + F.col("n")).alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    placed = stream.join(F.broadcast(bases), "part").withColumn("place", F.col("base") + F.col("local"))
    cut = placed.withColumn(
        "sequence_id",
        F.explode(F.expr(f"sequence(place div {window}, (place + n - 1) div {window})")),
    )
    first = F.expr(f"greatest(sequence_id * {window} - place, 0)")
    last = F.expr(f"least((sequence_id + 1) * {window} - place, n)")
    return (
        cut.withColumn("start", first)
        .withColumn("length", last - F.col("start"))
        .select(
            "id",
            "start",
            "length",
            F.expr("substring(ids, int(4 * start + 1), int(4 * length))").alias("ids"),
            F.col("n").alias("doc_tokens"),
            "sequence_id",
            F.expr(f"place + start - sequence_id * {window}").alias("offset"),
        )
    )


def op10_pack(spark, sf_dir: str) -> DataFrame:
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        F.col("id").alias("doc_id"),
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
