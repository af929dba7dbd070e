"""Conversation structure repair by Hirschberg's divide and conquer.

The roles of a repaired conversation read (s?(ua)+)? by their initials. An automaton with four states (start,
after s, after u, after a) follows them. Rows are kept (0), given the role of user or
assistant (3), deleted (4; blank rows and duplicates must be), or an empty row is inserted before
one or at the end (3); an undeleted truncated row adds 3. Wanted: the cheapest edits, and of those
the audit (initials of the edits in order) that comes first.

To rebuild it in linear space, a forward vector of the four states' least costs runs to the middle row
and a backward vector from the end; a state where their sum is least is an optimal crossing. Of several, the
audit-least is taken: the forward vector also ranks the states by their least audits
up to there. Audits that end with the edit of the same row are never beginnings of each other, so the
ranks decide. Both halves are solved likewise, down to single rows.

The conversation is cut the same way for Spark. All rows are sorted by range, numbered, and
cut into segments of SEGMENT rows at most, so a huge conversation is spread over many tasks. Conversations
with several segments get a table per segment (least cost and rank from each state to each), whose
forward and backward vectors choose the crossings between segments; then every segment is
repaired on its own. What is joined per conversation in the end are numbers, the audit (part
of the result) and a running hash of the text, read in order and never held.

Nulls in role and text stand for one space, null turns come first, null conversation ids are a
conversation of their own. Rows of one turn come in the order of role and text; rows that are
equal in all are counted, not held. Empty texts are blank. Very long texts are only hashed. Empty
table: no rows. Other columns are not read. All rows dropped: zeros, empty audit, hash of the empty string.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm.batches import keep_modest
from plumbline.sources.stored import settle

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
# a power of two: segments never span two partitions of the sorted rows
SEGMENT = 1024
START, SYSTEM, USER, ASSISTANT = range(4)
# state after one more row of user or assistant
TURN_TO = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 60
# cost and audit of the inserts that end the conversation well
CLOSING = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
# what a row is: no fault, truncated, to be deleted
CLEAN, CUT, GONE = range(3)
MARKS = r"[.!?]"
LETTER = r"[^\x20\x09-\x0D]"


@lru_cache(maxsize=4096)
def moves(initial: str, kind: int) -> tuple:
    """Per state before a row: (state after it, cost, edits), cheapest, then first; inserts come before the row."""
    out = []
    for state in range(4):
        best: dict[int, tuple[int, str]] = {}

        def offer(after, cost, edits):
            best[after] = min(best.get(after, (FAR, "")), (cost, edits))

        at, cost, edits = state, 0, ""
        for _ in range(3):
            offer(at, cost + DELETE, edits + "D")
            if kind != GONE:
                more = TRUNCATED if kind == CUT else 0
                offer(TURN_TO[at], cost + REROLE + more, edits + "R")
                if initial == "s" and at == START:
                    offer(SYSTEM, cost + KEEP + more, edits + "K")
                if initial and initial == "  ua"[TURN_TO[at]]:
                    offer(TURN_TO[at], cost + KEEP + more, edits + "K")
            at, cost, edits = TURN_TO[at], cost + INSERT, edits + "I"
        out.append(tuple((after, *best[after]) for after in sorted(best)))
    return tuple(out)


# rows of a segment are (initial, kind, copies); copies after the first are deleted
def forward(rows, costs: list[int], ranks: list[int]) -> tuple[list[int], list[int]]:
    """Least cost to each state after the rows, and the states' ranks by their least audits."""
    for initial, kind, copies in rows:
        best: list = [None] * 4
        for state, step in enumerate(moves(initial, kind)):
            if costs[state] < FAR:
                for after, cost, edits in step:
                    key = (costs[state] + cost, ranks[state], edits)
                    if best[after] is None or key < best[after]:
                        best[after] = key
        order = sorted((b[1:], s) for s, b in enumerate(best) if b)
        ranks = [4] * 4
        for rank, (_, state) in enumerate(order):
            ranks[state] = rank
        costs = [b[0] + DELETE * (copies - 1) if b else FAR for b in best]
    return costs, ranks


def backward(rows, costs: list[int]) -> list[int]:
    """Least cost from each state before the rows to their end, given that from there on."""
    for initial, kind, copies in reversed(rows):
        more = DELETE * (copies - 1)
        costs = [min(c + costs[after] for after, c, _ in step) + more for step in moves(initial, kind)]
        costs = [min(c, FAR) for c in costs]
    return costs


def only(state: int) -> list[int]:
    return [0 if s == state else FAR for s in range(4)]


def crossing(fore: tuple[list[int], list[int]], back: list[int]) -> int:
    """The optimal state with the least audit up to it."""
    costs, ranks = fore
    return min(range(4), key=lambda s: (costs[s] + back[s], ranks[s]))


def edits_of(rows: list, start: int, end: list[int], closing=None) -> list[str]:
    """Edits of each row from state `start`; `end` has the cost from each state on, `closing` its edits."""
    if not rows:
        return []
    if len(rows) == 1:
        initial, kind, copies = rows[0]
        tail = "D" * (copies - 1)
        best = None
        for after, cost, edits in moves(initial, kind)[start]:
            key = (cost + end[after], edits + tail + (closing[after] if closing else ""), edits + tail)
            if best is None or key < best:
                best = key
        return [best[2]]
    middle = len(rows) // 2
    fore = forward(rows[:middle], only(start), [0] * 4)
    at = crossing(fore, backward(rows[middle:], end))
    return edits_of(rows[:middle], start, only(at)) + edits_of(rows[middle:], at, end, closing)


def repaired(rows: list, start: int, stop: int | None) -> tuple[str, int, int, list]:
    """Audit, cost, last state and repaired (place or None, role) of a segment; stop: state to reach, None at the end."""
    costs, closing = zip(*CLOSING)
    steps = edits_of(rows, start, only(stop) if stop is not None else list(costs), None if stop is not None else closing)
    at, cost, out = start, 0, []

    def insert():
        nonlocal at, cost
        at, cost = TURN_TO[at], cost + INSERT
        out.append((None, ROLE[at]))

    for place, ((initial, kind, _), steps_of_row) in enumerate(zip(rows, steps)):
        for edit in steps_of_row:
            if edit == "I":
                insert()
            elif edit == "D":
                cost += DELETE
            else:
                cost += TRUNCATED * (kind == CUT) + (REROLE if edit == "R" else KEEP)
                at = SYSTEM if edit == "K" and initial == "s" else TURN_TO[at]
                out.append((place, ROLE[at] if edit == "R" else None))
    audit = "".join(steps)
    if stop is None:
        audit += closing[at]
        for _ in closing[at]:
            insert()
    return audit, cost, at, out


def damaged(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, text, copies: rows after damage; dropped rows keep their conversation with 0 copies."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col(f"`{conv}`").cast("string"), space), F.coalesce(F.col(f"`{turn}`").cast("string"), space))
    rows = turns.select(
        F.col(f"`{conv}`").alias("conv"),
        F.col(f"`{turn}`").cast("bigint").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), space).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), space).alias("text"),
        (F.crc32(key) % 20).alias("lot"),
    )
    gone = F.col("lot") == 0
    return rows.select(
        "conv",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(gone | (F.col("lot") == 1), "")
        .when(F.col("lot") == 2, F.regexp_replace("text", MARKS, ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.when(gone, 0).when(F.col("lot") == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def marked(rows: DataFrame) -> DataFrame:
    """Equal rows counted, with what each row is; duplicates are known by the first turn of role and text."""
    live = F.col("copies") > 0
    counted = rows.groupBy("conv", "turn", "role", "text", live.alias("live")).agg(F.sum("copies").alias("copies"))
    # role and text by hash, so that neither is moved a second time
    size = F.length("role").cast("string")
    counted = counted.withColumn("print", F.sha2(F.concat_ws(":", size, "role", "text"), 256))
    order = F.struct(F.col("turn").isNotNull().alias("some"), F.coalesce("turn", F.lit(0)).alias("turn"))
    firsts = counted.where("live").groupBy(F.col("conv").alias("c"), F.col("print").alias("p")).agg(F.min(order).alias("first"))
    both = counted.join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("print") == F.col("p")), "left")
    blank = ~F.col("text").rlike(LETTER)
    again = order > F.col("first")
    cut = ~F.col("text").rlike(MARKS + r"[\x20\x09-\x0D]*\z")
    return both.select(
        "conv",
        "turn",
        "role",
        "text",
        "copies",
        F.substring("role", 1, 1).alias("initial"),
        blank.alias("blank"),
        again.alias("again"),
        F.when(blank | again, GONE).when(cut, CUT).otherwise(CLEAN).alias("kind"),
    )


def segments(rows: DataFrame) -> DataFrame:
    """Rows sorted by conversation and turn over all tasks, with `place` and `segment`, written once."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a beginning of the text orders as the text does; whole texts are not sampled
    ranged = rows.withColumn("opening", F.substring("text", 1, 16)).repartitionByRange(
        partitions, "conv", "turn", "role", "opening"
    )
    placed = ranged.sortWithinPartitions("conv", "turn", "role", "text").withColumn("place", F.monotonically_increasing_id())
    return settle(placed.drop("opening").withColumn("segment", F.expr(f"place div {SEGMENT}")), "turns")


def runs(batches, keys: int):
    """Rows of Arrow batches, gathered while their first `keys` columns stay as they are."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if row[:keys] != key and held:
                yield key, held
                held = []
            key = row[:keys]
            held.append(row[keys:])
    if held:
        yield key, held


def crossings(rows: DataFrame) -> DataFrame:
    """conv, segment, start, stop of every segment of conversations that have several; stop is null at the end."""
    several = rows.groupBy("conv").agg(F.min("segment").alias("a"), F.max("segment").alias("b")).where("a < b")
    several = several.select(F.col("conv").alias("c"))
    narrow = rows.select("conv", "segment", "place", "initial", "kind", "copies")
    chosen = narrow.join(several, F.col("conv").eqNullSafe(F.col("c")), "left_semi")
    kind = rows.schema["conv"].dataType.simpleString()

    def tables(batches):
        for (conv, segment), held in runs(batches, 2):
            live = [row[1:] for row in held if row[3]]
            costs, ranks = [], []
            for state in range(4):
                one = forward(live, only(state), [0] * 4) if live else (only(state), [0] * 4)
                costs += one[0]
                ranks += one[1]
            yield batch_of([[conv], [segment], [costs], [ranks]], ["conv", "segment", "costs", "ranks"], conv_type)

    def choose(table: pa.Table) -> pa.Table:
        table = table.sort_by("segment")
        made = list(zip(table["costs"].to_pylist(), table["ranks"].to_pylist()))
        back = [[c for c, _ in CLOSING]]
        for costs, _ in reversed(made):
            back.append([min(costs[4 * p + q] + back[-1][q] for q in range(4)) for p in range(4)])
        back.reverse()
        states = [START]
        for (costs, ranks), rest in zip(made, back[1:]):
            p = states[-1]
            states.append(crossing((costs[4 * p : 4 * p + 4], ranks[4 * p : 4 * p + 4]), rest))
        n = len(made)
        columns = [table["conv"].to_pylist(), table["segment"].to_pylist(), states[:-1], states[1:n] + [None]]
        return pa.Table.from_batches([batch_of(columns, ["conv", "segment", "start", "stop"], conv_type)])

    conv_type = to_arrow_type(rows.schema["conv"].dataType)
    ordered = chosen.repartition("conv", "segment").sortWithinPartitions("conv", "segment", "place")
    summed = ordered.mapInArrow(tables, f"conv {kind}, segment bigint, costs array<bigint>, ranks array<bigint>")
    return summed.groupBy("conv").applyInArrow(choose, f"conv {kind}, segment bigint, start bigint, stop bigint")


def batch_of(columns: list[list], names: list[str], conv_type) -> pa.RecordBatch:
    kinds = {"conv": conv_type, "audit": pa.string(), "head": pa.string(), "tail": pa.string(), "sha": pa.string()}
    kinds |= {"costs": pa.list_(pa.int64()), "ranks": pa.list_(pa.int64()), "texts": pa.list_(pa.string())}
    arrays = [pa.array(c, kinds.get(n, pa.int64())) for c, n in zip(columns, names)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


LEGAL = ("su", "ua", "au")
PART = ("conv", "segment", "audit", "cost", "illegal", "head", "tail", "sha", "texts")


def repair(turns: DataFrame, conv="conv_id", turn="turn", role="role", text="text", damage: bool = True) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; damage: see `damaged`."""
    keep_modest(turns.sparkSession)
    if damage:
        rows = damaged(turns, conv, turn, role, text)
    else:
        space = F.lit(" ")
        rows = turns.select(
            F.col(f"`{conv}`").alias("conv"),
            F.col(f"`{turn}`").cast("bigint").alias("turn"),
            F.coalesce(F.col(f"`{role}`").cast("string"), space).alias("role"),
            F.coalesce(F.col(f"`{text}`").cast("string"), space).alias("text"),
            F.lit(1).cast("bigint").alias("copies"),
        )
    placed = segments(marked(rows))
    kind = placed.schema["conv"].dataType.simpleString()
    conv_type = to_arrow_type(placed.schema["conv"].dataType)
    cuts = settle(crossings(placed), "crossings").select(
        F.col("conv").alias("c"), F.col("segment").alias("s"), "start", "stop"
    )
    joined = placed.join(cuts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s")), "left")
    ordered = (
        joined.select("conv", "segment", "start", "stop", "place", "initial", "kind", "copies", "role", "text")
        .repartition("conv", "segment")
        .sortWithinPartitions("conv", "segment", "place")
    )

    def mend(batches):
        out: list[list] = [[] for _ in PART]
        for (conv_id, segment, start, stop), held in runs(batches, 4):
            live = [row for row in held if row[3]]
            rows = [row[1:4] for row in live]
            audit, cost, _, mended = repaired(rows, START if start is None else start, stop)
            texts = []
            for place, new_role in mended:
                own = live[place] if place is not None else None
                texts.append(f"{new_role or own[4]}:{own[5] if own else ''}")
            sequence = [initial for initial, _, copies in rows]
            illegal = sum(a + b not in LEGAL for a, b in zip(sequence, sequence[1:])) + sum(n - 1 for _, _, n in rows)
            whole = start is None
            sha = hashlib.sha256("\n".join(texts).encode("utf-8", "replace")).hexdigest() if whole else None
            values = (conv_id, segment, audit, cost, illegal, *((sequence[0], sequence[-1]) if sequence else (None, None)), sha, None if whole else texts)
            for column, value in zip(out, values):
                column.append(value)
            if len(out[0]) == 256 or not whole:
                yield batch_of(out, PART, conv_type)
                out = [[] for _ in PART]
        yield batch_of(out, PART, conv_type)

    def splice(batches):
        """Segments of one conversation after another, in order."""
        key, audit, cost, illegal, tail, digest, begun = None, [], 0, 0, None, None, False

        def row():
            return batch_of([[key[0]], ["".join(audit)], [cost], [illegal], [digest.hexdigest()]], ["conv", "audit", "cost", "illegal", "sha"], conv_type)

        for batch in batches:
            for one in zip(*(batch.column(i).to_pylist() for i in range(len(PART)))):
                if key != one[:1]:
                    if key is not None:
                        yield row()
                    key, audit, cost, illegal, tail, digest, begun = one[:1], [], 0, 0, None, hashlib.sha256(), False
                audit.append(one[2])
                cost += one[3]
                illegal += one[4] + (tail is not None and one[5] is not None and tail + one[5] not in LEGAL)
                tail = one[6] if one[6] is not None else tail
                for text in one[8]:
                    digest.update(("\n" if begun else "").encode() + text.encode("utf-8", "replace"))
                    begun = True
        if key is not None:
            yield row()

    parts = settle(
        ordered.mapInArrow(
            mend,
            f"conv {kind}, segment bigint, audit string, cost bigint, illegal bigint, head string, tail string, sha string, texts array<string>",
        ),
        "repairs",
    )
    result = f"conv {kind}, audit string, cost bigint, illegal bigint, sha string"
    long = parts.where("sha is null").repartition("conv").sortWithinPartitions("conv", "segment")
    done = parts.where("sha is not null").select("conv", "audit", "cost", "illegal", "sha").union(long.mapInArrow(splice, result))
    gone = F.col("copies")
    repeats = F.when(F.col("again"), gone).otherwise(gone - 1)
    counts = placed.groupBy("conv", "turn").agg(
        F.sum(F.when(F.col("blank"), gone).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank") & (gone > 0), repeats).otherwise(0)).alias("duplicate"),
        F.sum(F.when((F.col("kind") == CUT) & (gone > 0), 1).otherwise(0)).alias("truncated"),
    )
    # one row per turn by now, so distinct turns are counted as rows
    per_conv = counts.groupBy(F.col("conv").alias("c")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps"),
        *[F.sum(n).cast("bigint").alias(n) for n in ("blank", "duplicate", "truncated")],
    )
    return done.join(per_conv, F.col("conv").eqNullSafe(F.col("c"))).select(
        F.col("conv").alias("conv_id"),
        "gaps",
        "blank",
        "duplicate",
        "truncated",
        "illegal",
        "cost",
        "audit",
        F.col("sha").alias("repaired_sha256"),
    )


def op11_repair(spark, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
