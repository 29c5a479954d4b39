"""Repair of conversation structure: the cheapest edits that make turns alternate, by sorted streams of rows."""

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechlake.functions.text import BLANK

#: The states of `(s?(ua)+)?`: nothing yet, after s, after u, after a. The role that may come next where it is not s.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWING = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Edits in the order of their initials, and what they cost; an undeleted truncated row costs TRUNCATED more.
DELETE, INSERT, KEEP, REROLE = range(4)
LETTERS = b"DIKR"
COSTS = (4, 3, 0, 3)
TRUNCATED = 3
#: What is left to pay behind the last row: u needs an assistant, s both.
END = (0, 6, 3, 0)
SOUND, DOOMED, CUT = range(3)
FAULTS = ("", "blank", "duplicate", "truncated")


@cache
def step(after: tuple[int, ...], initial: int, fault: int) -> tuple[tuple[int, ...], int]:
    """Go back over one row: the costs from each state, less the least of them, and the first edits, two bits a state.

    after: the costs behind the row. initial: the state that keeping the row leads to, or START where the
    grammar has no such role. Of equally cheap edits the one with the least initial is taken, which gives the
    least audit, as a state and an edit leave no choice of where they lead.
    """
    extra = TRUNCATED if fault == CUT else 0
    own = []
    for state in range(4):
        options = [(COSTS[DELETE] + after[state], DELETE)]
        if fault != DOOMED:
            if initial == FOLLOWING[state] or initial == SYSTEM and state == START:
                options.append((extra + after[initial], KEEP))
            options.append((COSTS[REROLE] + extra + after[FOLLOWING[state]], REROLE))
        own.append(min(options))
    for _ in range(2):  # two inserts at most pay between two rows
        own = [min(own[s], (COSTS[INSERT] + own[FOLLOWING[s]][0], INSERT)) for s in range(4)]
    least = min(c for c, _ in own)
    return tuple(c - least for c, _ in own), sum(e << 2 * s for s, (_, e) in enumerate(own))


def _pointers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add `edits`, the backpointers of each row; rows come by conversation, each from its end."""
    conversation, costs = object(), END
    for batch in batches:
        found = bytearray()
        for conv, initial, fault in zip(batch.column("conv_id").to_pylist(), batch.column("initial").to_pylist(), batch.column("fault").to_pylist(), strict=True):
            if conv != conversation:
                conversation, costs = conv, END
            edits = 0
            if initial is not None:  # not the mark of a conversation without rows
                costs, edits = step(costs, initial if initial < 4 else START, (SOUND, DOOMED, DOOMED, CUT)[fault])
            found.append(edits)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.uint8()).cast(pa.int16())], [*batch.schema.names, "edits"])


def _edited(state: int, initial: int | None, edits: int) -> Iterator[tuple[int, int]]:
    """(edit, state after it) up to and with the one that uses the row."""
    while True:
        edit = edits >> 2 * state & 3
        if edit in (INSERT, REROLE):
            state = FOLLOWING[state]
        elif edit == KEEP:
            state = initial
        yield edit, state
        if edit != INSERT:
            return


def _closing(state: int) -> Iterator[tuple[int, int]]:
    while END[state]:
        state = FOLLOWING[state]
        yield INSERT, state


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each conversation in order; rows come by conversation and turn, with their backpointers."""
    conversation, state, place = object(), START, 0
    names = ["conv_id", "position", "edit", "fault", "turn", "role", "text"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def made(events: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*events, strict=True), types, strict=True)], names)

    def closed(events: list[tuple]) -> None:
        for place_, (edit, then) in enumerate(_closing(state), place):
            events.append((conversation, place_, chr(LETTERS[edit]), "", None, ROLES[then], ""))

    for batch in batches:
        events: list[tuple] = []
        for r in batch.to_pylist():
            if r["conv_id"] != conversation:
                closed(events)
                conversation, state, place = r["conv_id"], START, 0
            if r["initial"] is None:
                continue
            for edit, state in _edited(state, r["initial"], r["edits"]):
                row = (None, ROLES.get(state), "") if edit == INSERT else (r["turn"], ROLES[state] if edit == REROLE else r["role"], r["text"])
                events.append((conversation, place, chr(LETTERS[edit]), "" if edit == INSERT else FAULTS[r["fault"]], *row))
                place += 1
        if events:
            yield made(events)
    events = []
    closed(events)
    if events:
        yield made(events)


class _Report:
    """What is carried from row to row of a conversation."""

    def __init__(self, conversation):
        self.conversation, self.state, self.cost = conversation, START, 0
        self.first, self.last, self.turns, self.illegal, self.initial = None, None, 0, 0, None
        self.faults, self.audit, self.digest, self.lines = [0] * 4, bytearray(), hashlib.sha256(), 0

    def _write(self, edit: int, line: str | None) -> None:
        self.audit.append(LETTERS[edit])
        self.cost += COSTS[edit]
        if line is not None:
            self.digest.update((("\n" if self.lines else "") + line).encode("utf-8", "surrogatepass"))
            self.lines += 1

    def add(self, turn: int | None, role: str, text: str, initial: int, fault: int, edits: int) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        self.faults[fault] += 1
        # as states: su, ua and au follow each other, su also from START
        self.illegal += self.initial is not None and (self.initial == 4 or FOLLOWING[self.initial] != initial)
        self.initial = initial
        for edit, self.state in _edited(self.state, initial, edits):
            if edit == INSERT:
                self._write(edit, ROLES[self.state] + ":")
            elif edit == DELETE:
                self._write(edit, None)
            else:
                self._write(edit, f"{ROLES[self.state] if edit == REROLE else role}:{text}")
                self.cost += TRUNCATED if fault == 3 else 0

    def result(self) -> tuple:
        for edit, then in _closing(self.state):
            self._write(edit, ROLES[then] + ":")
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.conversation, gaps, *self.faults[1:], self.illegal, self.cost, self.audit.decode(), self.digest.hexdigest())


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation; rows come by conversation and turn, with their backpointers."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    types = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
    one, done = None, []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "initial", "fault", "edits")]
        for conv, turn, role, text, initial, fault, edits in zip(*columns, strict=True):
            if one is None or conv != one.conversation:
                if one is not None:
                    done.append(one.result())
                one = _Report(conv)
            if initial is not None:
                one.add(turn, role, text, initial, fault, edits)
        if done:
            yield made()
            done = []
    if one is not None:
        done.append(one.result())
        yield made()


def _with_edits(messages: DataFrame, there: str | None) -> DataFrame:
    """The rows of each conversation together and by turn, with faults and backpointers.

    The rows are shuffled once, by conversation. In the partitions Spark sorts them thrice, spilling as it
    must: to find texts seen before, from the end for the backpointers, and by turn for the edits.
    """
    present = F.coalesce(F.col(there), F.lit(False)) if there else F.lit(True)
    own = lambda c: F.when(present, F.coalesce(F.col(c), F.lit(" ")))
    rows = messages.select(F.col("conv_id").cast("string").alias("conv_id"), F.when(present, F.col("turn").cast("long")).alias("turn"), own("role").alias("role"), own("text").alias("text"))
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).when(F.col("role").isNotNull(), 4)
    body = F.rtrim(F.col("text"), F.lit(BLANK))
    rows = rows.withColumns({"initial": initial, "_h": F.md5("text"), "_end": F.right(body, F.lit(1))}).repartition("conv_id")
    seen = F.row_number().over(W.partitionBy("conv_id", "role", "_h").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(F.col("_end") == "", 1).when(F.col("_seen") > 1, 2).when(~F.col("_end").isin(*".!?"), 3).otherwise(0)
    rows = rows.withColumn("_seen", seen).withColumn("fault", F.coalesce(fault, F.lit(0))).drop("_end", "_h")
    order = ["conv_id", "turn", "role", "text", "_seen"]
    schema = "conv_id string, turn bigint, role string, text string, initial int, _seen int, fault int, edits short"
    back = rows.sortWithinPartitions(*[F.col(c).desc_nulls_last() for c in order]).mapInArrow(_pointers, schema)
    return back.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])


def repair_conversations(messages: DataFrame, there: str | None = None) -> DataFrame:
    """The cheapest edits that give each conversation role initials `(s?(ua)+)?`, a row an edit.

    messages: conv_id, turn, role, text. Returns conv_id (as text), position (from 0), edit (D delete, I insert,
    K keep, R rerole), fault of the row (blank, duplicate, truncated or ""), turn, role and text after the edit.
    The repaired conversation is the rows that are not deleted. Rows stand by turn, nulls first, then by role and
    text, so that equal rows are neighbours. A row's first fault counts: blank, duplicate (role and text seen
    earlier), truncated (the last character that is not white space is none of .!?). To keep costs 0, to rerole to
    user or assistant 3, to delete 4, which blank and duplicate rows must be, to insert a user or an assistant
    without text 3; a truncated row that stays costs 3 more. Of the cheapest edits the ASCII-least initials count.

    Costs of four states are carried from row to row against the order of turns, and each row is given a byte of
    backpointers; a second stream follows them by turn. So memory does not grow with a conversation: what is kept
    between the streams lies in Spark's sorts, which spill. All rows of one conversation pass one task, as their
    edits depend on each other. Null roles and texts count as one space; a null conv_id is a conversation; roles
    of other initials can only be reroled or deleted; an empty table gives an empty one; other columns are left
    behind. Rows where the boolean column `there` is not true count for nothing.
    """
    return _with_edits(messages, there).mapInArrow(_rows, "conv_id string, position bigint, edit string, fault string, turn bigint, role string, text string")


def conversation_reports(messages: DataFrame, there: str | None = None) -> DataFrame:
    """One row per conversation on its repair (see repair_conversations).

    conv_id (as text), gaps (last turn - first + 1 - distinct turns, nulls aside; 0 without turns), the numbers of blank, duplicate and
    truncated rows, illegal (neighbours whose initials are none of su, ua, au), cost, audit (the edits' initials)
    and repaired_sha256 (of the repaired `role:text`, joined by newlines). A conversation of which no row is
    there has zeros, an empty audit and the hash of the empty string.
    """
    schema = "conv_id string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    return _with_edits(messages, there).mapInArrow(_reports, schema)
