"""Chat formatting: the cheapest repair of a conversation's roles, then its rendering.

A legal conversation is an optional system turn, then user and assistant turns in alternation,
beginning with a user turn and ending with an assistant turn. A dynamic program over that automaton
chooses, turn by turn, to keep a turn, to merge it into the turn before it (which then has its text
too), or to relabel it, and where to insert an empty turn; costs add up and the least total wins.

A step of the program is a small matrix over (min, +), which is associative. Conversations of at most
``segment`` turns are repaired in one go. Longer ones are put in order by a range shuffle; what a task
gets of a conversation, in pieces of at most ``segment`` turns, gives the matrix of its cheapest ways
between states; combined from the end they say what each state costs after each piece. A piece then
traces its way from every state, which gives the state it leads to, and along these the way of the whole
conversation. So no task holds more than a piece, however long a conversation is and however its turns
are numbered, and the result, ties included, does not depend on how it was cut.

The order of turns is that of the turn number, null last, then of the role, null first, then of the
text: null first, its first ``PREFIX`` characters, then a hash of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import bounded, rows_of
from halyard.session import cut

SEGMENT = 1024
PREFIX = 64
MERGE, RELABEL, INSERT = 2, 3, 4
#: States: nothing yet, after system, after user, after assistant.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ROLE_OF = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
STATE_OF = {v: k for k, v in ROLE_OF.items()}
LEGAL = ((EMPTY, SYSTEM), (EMPTY, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))
FAR = 1 << 50


def moves(state: int, role: str | None) -> list[tuple[int, int, tuple[int, ...], bool, bool]]:
    """Ways to take a turn: (cost, next state, inserted states, merged, relabelled), cheapest kinds first."""
    own = STATE_OF.get((role or "").strip().lower())
    out = []
    for target in (SYSTEM, USER, ASSISTANT):
        relabel = 0 if target == own else RELABEL
        if target == state:
            out.append((relabel + MERGE, target, (), True, relabel > 0))
        if (state, target) in LEGAL:
            out.append((relabel, target, (), False, relabel > 0))
        for between in (SYSTEM, USER, ASSISTANT):
            if (state, between) in LEGAL and (between, target) in LEGAL:
                out.append((relabel + INSERT, target, (between,), False, relabel > 0))
    return sorted(out)


MOVES = {(s, r): moves(s, r) for s in range(4) for r in (None, "system", "user", "assistant")}


def kind(role: str | None) -> str | None:
    role = (role or "").strip().lower()
    return role if role in STATE_OF else None


def ending(state: int) -> tuple[int, tuple[int, ...]]:
    """The cost of ending in a state, and the turns to insert."""
    return {EMPTY: (2 * INSERT, (USER, ASSISTANT)), SYSTEM: (2 * INSERT, (USER, ASSISTANT)), USER: (INSERT, (ASSISTANT,)), ASSISTANT: (0, ())}[state]


def transfer(roles: list[str | None]) -> np.ndarray:
    """Least costs between states over these turns."""
    best = np.full((4, 4), FAR, dtype=np.int64)
    np.fill_diagonal(best, 0)
    steps = {}
    for role in roles:
        step = steps.get(role)
        if step is None:
            step = np.full((4, 4), FAR, dtype=np.int64)
            for s in range(4):
                for cost, t, *_ in MOVES[s, role]:
                    step[s, t] = min(step[s, t], cost)
            steps[role] = step
        best = np.minimum(FAR, (best[:, :, None] + step[None]).min(axis=1))
    return best


def trace(roles: list[str | None], start: int, end: int) -> list[tuple]:
    """The moves of a cheapest way from start to end; ties go to the move that sorts first, early turns first."""
    return trace_to(roles, start, [0 if s == end else FAR for s in range(4)])


def trace_to(roles: list[str | None], start: int, rest: list[int]) -> list[tuple]:
    """As :func:`trace`, to any state, where ``rest`` is what each state costs from there on."""
    after = [[FAR] * 4 for _ in roles] + [list(rest)]
    for i in range(len(roles) - 1, -1, -1):
        for s in range(4):
            after[i][s] = min([FAR, *(c + after[i + 1][t] for c, t, *_ in MOVES[s, roles[i]])])
    out, state = [], start
    for i, role in enumerate(roles):
        move = next(m for m in MOVES[state, role] if m[0] + after[i + 1][m[1]] == after[i][state])
        out.append(move)
        state = move[1]
    return out


ENDING = [ending(s)[0] for s in range(4)]


def rendered(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}\n" for role, text in turns)


def ordered_columns(conversations: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        text.alias("text"),
        F.substring(text, 1, PREFIX).alias("head"),
        F.xxhash64(text).alias("hash"),
    )


def turn_order() -> list[Column]:
    return [F.asc_nulls_first("conv_id"), F.asc_nulls_last("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("head"), F.asc("hash")]


TURN = "conv_id long, position long, turn long, action string, role string, cost long, n_inserted long, rendered string"
REST = "conv_id long, piece long, before long, rest array<long>, last boolean"


def repair(conv_id, turns: list[tuple], before: int, start: int, rest: list[int], last: bool) -> Iterator[tuple]:
    """A row of :data:`TURN` for each turn (turn, role, text) of a piece."""
    steps = trace_to([kind(r) for _, r, _ in turns], start, rest)
    for i, ((turn, _, text), (cost, target, between, joins, renamed)) in enumerate(zip(turns, steps, strict=True)):
        out = [rendered([(ROLE_OF[b], "") for b in between]), f"{text or ''}\n" if joins else rendered([(ROLE_OF[target], text or "")])]
        inserted = len(between)
        if last and i == len(turns) - 1:
            more, left = ending(target)
            cost += more
            inserted += len(left)
            out.append(rendered([(ROLE_OF[s], "") for s in left]))
        action = ("merge and relabel" if renamed else "merge") if joins else "relabel" if renamed else "keep"
        yield conv_id, before + i, turn, action, ROLE_OF[target], cost, inserted, "".join(out)


TURN_SCHEMA = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("turn", pa.int64()), ("action", pa.string()), ("role", pa.string()), ("cost", pa.int64()), ("n_inserted", pa.int64()), ("rendered", pa.string())])


def turns(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``conv_id, position, turn, action, role, cost, n_inserted, rendered``: a row for each turn.

    ``position`` counts a conversation's turns in order, from 0. ``action`` is what the cheapest repair
    does with the turn (keep, merge, relabel, merge and relabel), ``role`` the role its text then has,
    ``rendered`` its text as rendered, with the empty turns inserted before it and, for the last turn,
    after it. All of a conversation in order of position is its rendering. Ties of cost go to the move
    that sorts first. A null or unknown role is relabelled, a null text is empty, rows with a null
    conv_id make one conversation, repeated rows are repeated turns. Other columns are not read; an empty
    table gives no rows. ``segment`` bounds what a task holds, and changes no row.
    """
    rows = ordered_columns(conversations)
    long = cut(rows.groupBy("conv_id").count().where(F.col("count") > segment).select(F.col("conv_id").alias("c")))
    of_long = F.col("conv_id").eqNullSafe(F.col("c"))
    short = rows.join(long, of_long, "left_anti").repartition("conv_id").sortWithinPartitions(*turn_order())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for conv_id, own in groupby(rows_of(batches, "conv_id", "turn", "role", "text"), key=itemgetter(0)):
                held = [r[1:] for r in own]
                yield from repair(conv_id, held, 0, EMPTY, ENDING, True)

        yield from bounded(each(), TURN_SCHEMA, 2000, lambda r: len(r[7]))

    done = short.mapInArrow(whole, TURN)
    return done if long.isEmpty() else done.unionByName(long_turns(rows.join(long, of_long, "left_semi"), segment))


def long_turns(rows: DataFrame, segment: int) -> DataFrame:
    """As :func:`turns`, for conversations of any length: range-partitioned, cut into pieces, traced piece by piece."""
    # the row number parts equal turns, so that they may lie in several partitions
    placed = rows.withColumn("row", F.monotonically_increasing_id())
    order = [*turn_order(), F.asc("row")]
    kept = "conv_id long, piece long, turn long, role string, text string"
    fields = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32

        def each() -> Iterator[tuple]:
            piece, held = first, 0
            last: object = each  # equal to no id
            for conv_id, turn, role, text in rows_of(batches, "conv_id", "turn", "role", "text"):
                if conv_id != last or held == segment:
                    piece, held, last = piece + 1, 0, conv_id
                held += 1
                yield conv_id, piece, turn, role, text

        yield from bounded(each(), fields, 2000, lambda r: len(r[4] or ""))

    pieces = cut(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, kept))
    costs = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("n", pa.int64()), ("costs", pa.list_(pa.int64()))])
    rest = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("before", pa.int64()), ("rest", pa.list_(pa.int64())), ("last", pa.bool_())])
    led = pa.schema([*rest, ("leads", pa.list_(pa.int64()))])
    way = pa.schema([*rest, ("start", pa.int64())])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for key, own in groupby(rows_of(batches, "conv_id", "piece", "role"), key=itemgetter(0, 1)):
                roles = [kind(r) for _, _, r in own]
                yield *key, len(roles), transfer(roles).ravel().tolist()

        yield from bounded(each(), costs)

    def rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each state costs after each piece. A conversation takes 300 bytes here for each ``segment`` turns."""

        def each() -> Iterator[tuple]:
            for conv_id, own in groupby(rows_of(batches, *costs.names), key=itemgetter(0)):
                own = list(own)
                after = [np.array(ENDING)]
                for *_, c in own[:0:-1]:
                    after.append(np.minimum(FAR, (np.array(c).reshape(4, 4) + after[-1][None]).min(axis=1)))
                before = 0
                for i, ((_, piece, n, _), own_rest) in enumerate(zip(own, after[::-1], strict=True)):
                    yield conv_id, piece, before, own_rest.tolist(), i == len(own) - 1
                    before += n

        yield from bounded(each(), rest)

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state in which the way through a piece ends, for each in which it may begin."""

        def each() -> Iterator[tuple]:
            for _, own in groupby(rows_of(batches, *rest.names, "role"), key=itemgetter(0, 1)):
                own = list(own)
                roles = [kind(r[5]) for r in own]
                yield *own[0][:5], [trace_to(roles, s, own[0][3])[-1][1] for s in range(4)]

        yield from bounded(each(), led)

    def begins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for _, own in groupby(rows_of(batches, *led.names), key=itemgetter(0)):
                state = EMPTY
                for *row, ends in own:
                    yield *row, state
                    state = ends[state]

        yield from bounded(each(), way)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for (conv_id, _), own in groupby(rows_of(batches, "conv_id", "piece", "turn", "role", "text", "before", "start", "rest", "last"), key=itemgetter(0, 1)):
                held = list(own)
                yield from repair(conv_id, [r[2:5] for r in held], *held[0][5:])

        yield from bounded(each(), TURN_SCHEMA, 2000, lambda r: len(r[7]))

    def by_conversation(frame: DataFrame) -> DataFrame:
        return frame.repartition("conv_id").sortWithinPartitions("conv_id", "piece")

    def with_turns(ways: DataFrame, *columns: str) -> DataFrame:
        own = ways.withColumnsRenamed({"conv_id": "c", "piece": "p"})
        joined = numbered.select("conv_id", "piece", "row", *columns).join(own, F.col("piece") == F.col("p"))
        return joined.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "row")

    # pieces lie whole and in order in their partitions, as a checkpoint keeps partitions
    numbered = pieces.withColumn("row", F.monotonically_increasing_id())
    found = pieces.select("conv_id", "piece", "role").mapInArrow(matrices, "conv_id long, piece long, n long, costs array<long>")
    known = cut(by_conversation(found).mapInArrow(rests, REST))
    traced = with_turns(known, "role").select(*rest.names, "role").mapInArrow(leads, REST + ", leads array<long>")
    ways = cut(by_conversation(traced).mapInArrow(begins, REST + ", start long"))
    return with_turns(ways, "turn", "role", "text").select("conv_id", "piece", "turn", "role", "text", "before", "start", "rest", "last").mapInArrow(write, TURN)


def repaired(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``conv_id, segment, n_in, n_out, n_merged, n_relabelled, n_inserted, cost, rendered, sha256``.

    :func:`turns`, with so many turns to a row: segment 0 has the first ``segment`` turns of a
    conversation, and ``rendered`` of all segments in order is the conversation. A conversation of no
    more turns is one row. A segment's first turn may be merged into the last turn of the segment before;
    it then renders as text without a role line.
    """
    placed = turns(conversations).withColumn("segment", F.floor(F.col("position") / segment).cast("long"))
    merged = F.col("action").startswith("merge")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("position", "rendered"))), lambda x: x["rendered"])
    counted = placed.groupBy("conv_id", "segment").agg(
        F.count(F.lit(1)).alias("n_in"),
        (F.count_if(~merged) + F.sum("n_inserted")).alias("n_out"),
        F.count_if(merged).alias("n_merged"),
        F.count_if(F.col("action").endswith("relabel")).alias("n_relabelled"),
        F.sum("n_inserted").alias("n_inserted"),
        F.sum("cost").alias("cost"),
        F.array_join(parts, "").alias("rendered"),
    )
    return counted.withColumn("sha256", F.sha2("rendered", 256))
