"""Repair of conversation structure by the cheapest edits, found with iterative-deepening A*.

A repaired conversation is empty, or at most one system message and then one or more pairs of user and assistant. Each row
is kept, given another role or deleted, and empty messages may be inserted. A search goes through a stretch of rows depth
first, edits in ASCII order, under a bound on the cost. Every state is a row and the role before it. What a state is known
to cost at least stands in a table: first an estimate from the faults ahead, and each time the state fails under a
bound, the least that its edits would have needed. The bound then rises to the least cost of the first state, so the first
path that is accepted is the cheapest, and the ASCII-least of these.

Rows are sorted over the whole table by ranges, so a conversation with a third of all rows lies in many tasks. It is cut
into stretches of ``STRETCH`` rows, which are searched one by one, from every role that may stand before them to every role
they may end with. A stretch ends with an edit of its last row, so of two different scripts for it neither begins the
other, and the scripts of a conversation are chosen one after the other once the costs behind them are known. That takes
two passes over a few numbers a stretch, which flow through a task in order and are not held.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.support import BLANKS, arrow_batch, arrow_rows, save
from callweave.session import ship_package

STRETCH = 64  # rows searched together; bounds a search, never the result
BATCH_ROWS = 4096  # rows handed on at a time

KEEP, REROLE, DELETE, INSERT, MEND = 0, 3, 4, 3, 3  # costs; MEND is added for a truncated row that stays
NOTHING, SYSTEM, USER, ASSISTANT = range(4)  # what stands before a row
FOLLOWING = (USER, USER, ASSISTANT, USER)
ROLES = ("", "", "user", "assistant")
LEGAL = frozenset(("su", "ua", "au"))
END_COSTS = (0.0, 2.0 * INSERT, float(INSERT), 0.0)  # of ending a conversation after nothing, system, user, assistant
BLANK, DUPLICATE, TRUNCATED, SOUND = "bdt."
FAULTS = {BLANK: "blank", DUPLICATE: "duplicate", TRUNCATED: "truncated", SOUND: None}

Lower = list[list[float]]

_STRETCHES = "conv_id bigint, part bigint, rows array<bigint>, initials string, faults string"
_EDITS = "conv_id bigint, part bigint, edit_no bigint, edit string, cost bigint, fault string, row_no bigint, new_role string"
_PATHS = "conv_id bigint, part bigint, rows array<bigint>, initials string, faults string, costs array<double>, scripts array<string>"
_DIGESTS = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, repaired_sha256 string"
)


# --- the search --------------------------------------------------------------------------------------------


def estimate(initials: str, faults: str, goal: int | None) -> Lower:
    """What each state costs at least, by row and role before it, to end after the last row in ``goal``, or, without a goal, to
    end the conversation. Every row pays for its own fault, whatever the others do."""
    if goal is None:
        last = list(END_COSTS)
    else:
        last = [0.0 if q == goal else math.inf for q in range(4)]
    table, ahead = [last], 0.0
    for initial, fault in zip(reversed(initials), reversed(faults)):
        if fault in (BLANK, DUPLICATE):
            ahead += DELETE
        else:
            ahead += min(DELETE, (MEND if fault == TRUNCATED else 0) + (KEEP if initial in "sua" else REROLE))
        # nothing and a system message stand before a row only if no other message does
        table.append([ahead if goal is None or q == goal or goal >= USER or q == NOTHING and goal == SYSTEM else math.inf for q in range(4)])
    return table[::-1]


def edits_at(initials: str, faults: str, row: int, before: int, goal: int | None) -> list[tuple[str, int, int, int]]:
    """Edits in ASCII order, each with its cost and the state it leads to."""
    follows = FOLLOWING[before]
    if row == len(faults):
        return [("I", INSERT, row, follows)] if goal is None else []
    found = [("D", DELETE, row + 1, before), ("I", INSERT, row, follows)]
    if faults[row] not in (BLANK, DUPLICATE):
        mend = MEND if faults[row] == TRUNCATED else 0
        if initials[row] == ROLES[follows][0]:
            found.append(("K", KEEP + mend, row + 1, follows))
        elif initials[row] == "s" and before == NOTHING:
            found.append(("K", KEEP + mend, row + 1, SYSTEM))
        found.append(("R", REROLE + mend, row + 1, follows))
    return found


def cheapest(initials: str, faults: str, before: int = NOTHING, goal: int | None = None, lower: Lower | None = None) -> tuple[float, str]:
    """Cost and edits of the cheapest script, ASCII-least of these; infinite and empty if none leads to ``goal``.

    ``lower`` is changed. What it has learned holds for other roles before the rows too, with the same goal.
    """
    lower = estimate(initials, faults, goal) if lower is None else lower
    while (bound := lower[0][before]) < math.inf:
        script = _under(bound, initials, faults, before, goal, lower)
        if script is not None:
            return bound, script
    return math.inf, ""


def _under(bound: float, initials: str, faults: str, before: int, goal: int | None, lower: Lower) -> str | None:
    """The first accepted script that costs no more than ``bound``, or None, and then the first state's table entry is above it."""
    n = len(faults)

    def is_accepted(row: int, role: int) -> bool:
        return row == n and (role in (NOTHING, ASSISTANT) if goal is None else role == goal)

    if is_accepted(0, before):
        return ""
    # a frame: row, role before it, what is left of the bound, edits not tried yet, the least that failed ones needed, its own cost
    frames = [[0, before, bound, iter(edits_at(initials, faults, 0, before, goal)), math.inf, 0]]
    script: list[str] = []
    while frames:
        frame = frames[-1]
        left = frame[2]
        for edit, cost, row, role in frame[3]:
            needed = cost + lower[row][role]
            if needed > left:
                frame[4] = min(frame[4], needed)
                continue
            script.append(edit)
            if is_accepted(row, role):
                return "".join(script)
            frames.append([row, role, left - cost, iter(edits_at(initials, faults, row, role, goal)), math.inf, cost])
            break
        else:
            frames.pop()
            lower[frame[0]][frame[1]] = max(lower[frame[0]][frame[1]], frame[4])
            if frames:
                script.pop()
                frames[-1][4] = min(frames[-1][4], frame[5] + lower[frame[0]][frame[1]])
    return None


# --- conversations -----------------------------------------------------------------------------------------


def repair_conversations(rows: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``conv_id, part, edit_no, edit, cost, fault, turn, old_role, role, text``: the edits of every conversation, in order by
    ``part`` and ``edit_no``.

    Reads ``conv_id, turn, role, text`` of ``rows``; other columns are left out, whatever their names. Rows of a conversation are
    taken by turn, nulls first, then by role and a hash of the text. A null role or text is empty; all rows with a null ``conv_id``
    are one conversation. ``fault`` is the row's first: ``blank`` (no character but the six ASCII blanks), ``duplicate`` (role and text
    came before), ``truncated`` (the last such character is none of ``.!?``), else null. ``edit`` is D, I, K or R; an inserted message has
    null ``turn, old_role, fault`` and an empty text, a deleted row null ``role`` and ``text``. Each row given is in exactly one edit. An
    empty table gives no rows.

    Texts are moved once, by row number; sorting and searching see marks of them. ``stretch`` is the number of rows searched
    together and changes no result.
    """
    ship_package(rows.sparkSession)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    given = rows.select("conv_id", "turn", role.alias("old_role"), text.alias("old_text"))
    given = save(given.withColumn("row_no", F.monotonically_increasing_id()), "rows")
    solved = _solved(_stretches(given, stretch))
    # inserted messages have no row: numbers of their own keep them from meeting in one task
    number = F.coalesce("row_no", -1 - F.shiftrightunsigned(F.xxhash64("conv_id", "part", "edit_no"), 1))
    edits = solved.withColumn("row_no", number).join(given.drop("conv_id").hint("merge"), "row_no", "left")
    stays = F.col("edit") != "D"
    return edits.select(
        "conv_id",
        "part",
        "edit_no",
        "edit",
        "cost",
        "fault",
        "turn",
        "old_role",
        F.when(stays, F.coalesce("new_role", "old_role")).alias("role"),
        F.when(stays, F.coalesce("old_text", F.lit(""))).alias("text"),
    )


def _stretches(given: DataFrame, stretch: int) -> DataFrame:
    """``_STRETCHES``: rows of one conversation in order, their role initials and first faults."""
    last = F.substring(F.rtrim(F.col("old_text"), F.lit(BLANKS)), -1, 1)
    own = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    initial = F.substring("old_role", 1, 1)
    rows = given.select(
        "conv_id",
        "turn",
        "old_role",
        F.md5("old_text").alias("mark"),
        "row_no",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("?").alias("initial"),
        own.alias("fault"),
    )
    rows = save(rows, "marks")
    # where role and text come at several rows, the turn of the first; a row of a later turn is a duplicate
    key = ("conv_id", "old_role", "mark")
    turn = F.struct(F.col("turn").isNotNull().alias("is_set"), "turn")
    repeated = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(turn).alias("first")).where("n > 1").drop("n")
    renamed = repeated.select(*[F.col(k).alias(f"r_{k}") for k in key], "first")
    same = F.col("conv_id").eqNullSafe(F.col("r_conv_id")) & (F.col("old_role") == F.col("r_old_role")) & (F.col("mark") == F.col("r_mark"))
    marked = rows.join(renamed.hint("merge"), same, "left").withColumn("later", F.coalesce(turn > F.col("first"), F.lit(False)))
    order = ("conv_id", "turn", "old_role", "mark", "row_no")
    dealt = marked.select(*order, "initial", "fault", "later").repartitionByRange(*order[:4]).sortWithinPartitions(*order)
    return save(dealt.mapInArrow(partial(_cut, stretch), _STRETCHES), "stretches")


def _cut(stretch: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of the rows of a partition. Rows that agree in turn, role and text stand side by side: all but the first are duplicates."""
    task = TaskContext.get()
    part = (task.partitionId() if task else 0) << 33
    seen, numbers, initials, faults, out = None, [], [], [], []
    for conv_id, turn, role, mark, row_no, initial, fault, later in arrow_rows(batches):
        if numbers and (conv_id != seen[0] or len(numbers) == stretch):
            out.append((seen[0], part, numbers, "".join(initials), "".join(faults)))
            numbers, initials, faults = [], [], []
            part += 1
        own = (conv_id, turn, role, mark)
        numbers.append(row_no)
        initials.append(initial)
        faults.append(DUPLICATE if fault != BLANK and (later or own == seen) else fault)
        seen = own
        if len(out) >= BATCH_ROWS // STRETCH:
            yield arrow_batch(out, _STRETCHES)
            out = []
    if numbers:
        out.append((seen[0], part, numbers, "".join(initials), "".join(faults)))
    if out:
        yield arrow_batch(out, _STRETCHES)


def _solved(stretches: DataFrame) -> DataFrame:
    """``_EDITS`` of all conversations."""
    several = stretches.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chained = several.select(F.col("conv_id").alias("c_conv_id"), F.lit(True).alias("is_chained"))
    split = stretches.join(chained.hint("merge"), F.col("conv_id").eqNullSafe(F.col("c_conv_id")), "left").drop("c_conv_id")
    split = save(split, "dealt")
    whole = split.where("is_chained is null").drop("is_chained").mapInArrow(_search, _EDITS)
    paths = split.where("is_chained").drop("is_chained").repartition("conv_id", "part").mapInArrow(_search_all, _PATHS)
    backward = paths.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"))
    behind = save(backward.mapInArrow(_costs_behind, f"{_PATHS}, behind array<double>"), "behind")
    forward = behind.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return whole.unionByName(forward.mapInArrow(_choose, _EDITS))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _edit_batches((*key, NOTHING, cheapest(key[3], key[4])[1]) for key in arrow_rows(batches))


def _search_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs and scripts of each stretch from every role before it to every role it may end with."""
    out = []
    for key in arrow_rows(batches):
        found = {}
        for goal in range(4):
            lower = estimate(key[3], key[4], goal)
            for before in range(4):
                found[before, goal] = cheapest(key[3], key[4], before, goal, lower)
        pairs = [found[before, goal] for before in range(4) for goal in range(4)]
        out.append((*key, [cost for cost, _ in pairs], [script for _, script in pairs]))
        if len(out) >= BATCH_ROWS // STRETCH:
            yield arrow_batch(out, _PATHS)
            out = []
    if out:
        yield arrow_batch(out, _PATHS)


def _costs_behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds what ends the conversation at least after each stretch, by the role it ends with. Stretches come last first."""
    schema, out, seen, ahead = f"{_PATHS}, behind array<double>", [], object(), END_COSTS
    for row in arrow_rows(batches):
        if row[0] != seen:
            seen, ahead = row[0], END_COSTS
        out.append((*row, list(ahead)))
        ahead = [min(row[5][4 * before + goal] + ahead[goal] for goal in range(4)) for before in range(4)]
        if len(out) >= BATCH_ROWS // STRETCH:
            yield arrow_batch(out, schema)
            out = []
    if out:
        yield arrow_batch(out, schema)


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of each stretch: of those that lead to the least cost in all, the ASCII-least. Stretches come in order."""

    def chosen() -> Iterator[tuple]:
        seen, role, held = object(), NOTHING, None
        for conv_id, part, numbers, initials, faults, costs, scripts, behind in arrow_rows(batches):
            if held is not None:
                yield held if held[0] == conv_id else (*held[:6], held[6] + _ending(role))
            before = role if conv_id == seen else NOTHING
            total = [costs[4 * before + goal] + behind[goal] for goal in range(4)]
            least = min(total)
            script, role = min((scripts[4 * before + goal], goal) for goal in range(4) if total[goal] == least)
            seen, held = conv_id, (conv_id, part, numbers, initials, faults, before, script)
        if held is not None:
            yield (*held[:6], held[6] + _ending(role))

    yield from _edit_batches(chosen())


def _ending(role: int) -> str:
    return "I" * int(END_COSTS[role] // INSERT)


def _edit_batches(scripts: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    out = []
    for conv_id, part, numbers, initials, faults, before, script in scripts:
        row = 0
        for edit_no, edit in enumerate(script):
            if edit == "I":
                before = FOLLOWING[before]
                out.append((conv_id, part, edit_no, edit, INSERT, None, None, ROLES[before]))
                continue
            cost, new_role = DELETE, None
            if edit != "D":
                is_system = edit == "K" and initials[row] == "s"
                before = SYSTEM if is_system else FOLLOWING[before]
                cost = (KEEP if edit == "K" else REROLE) + (MEND if faults[row] == TRUNCATED else 0)
                new_role = ROLES[before] if edit == "R" else None
            out.append((conv_id, part, edit_no, edit, cost, FAULTS[faults[row]], numbers[row], new_role))
            row += 1
        if len(out) >= BATCH_ROWS:
            yield arrow_batch(out, _EDITS)
            out = []
    if out:
        yield arrow_batch(out, _EDITS)


# --- digests -----------------------------------------------------------------------------------------------


class _Digest:
    """What is told of one conversation, taken while its edits go by."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.counts, self.illegal, self.cost = conv_id, {"blank": 0, "duplicate": 0, "truncated": 0}, 0, 0
        self.turns: tuple[int, int, int] | None = None  # least, greatest, how many
        self.initial: str | None = None
        self.audit: list[str] = []
        self.repaired, self.is_open = hashlib.sha256(), False

    def add(self, edit: str, cost: int, fault: str | None, turn: int | None, old_role: str | None, role: str | None, text: str | None) -> None:
        self.audit.append(edit)
        self.cost += cost
        if edit != "I":
            if fault:
                self.counts[fault] += 1
            initial = old_role[:1]
            if self.initial is not None and self.initial + initial not in LEGAL:
                self.illegal += 1
            self.initial = initial
            if turn is not None and self.turns is None:
                self.turns = (turn, turn, 1)
            elif turn is not None and turn != self.turns[1]:
                self.turns = (self.turns[0], turn, self.turns[2] + 1)
        if role is not None:
            self.repaired.update(("\n" if self.is_open else "").encode() + f"{role}:{text}".encode())
            self.is_open = True

    def row(self) -> tuple:
        least, greatest, n = self.turns or (0, 0, 1)
        counts = (self.counts["blank"], self.counts["duplicate"], self.counts["truncated"])
        return (self.conv_id, greatest - least + 1 - n, *counts, self.illegal, self.cost, "".join(self.audit), self.repaired.hexdigest())


def repair_digests(edits: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of what ``repair_conversations`` returned.

    ``gaps`` is the number of turns missing between the first and the last, ``illegal`` that of neighbours whose role initials are not
    su, ua or au, ``audit`` the edits, the hash is that of the repaired ``role:text``, joined by line breaks. A hash is taken in
    order, so the rows of a conversation flow through one task, which holds one of them at a time.
    """
    columns = ("conv_id", "edit", "cost", "fault", "turn", "old_role", "role", "text")
    dealt = edits.repartition("conv_id").sortWithinPartitions("conv_id", "part", "edit_no")
    return dealt.select(*columns).mapInArrow(_digest, _DIGESTS)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, out = None, []
    for conv_id, *edit in arrow_rows(batches):
        if held is None or held.conv_id != conv_id:
            if held is not None:
                out.append(held.row())
            held = _Digest(conv_id)
            if len(out) >= BATCH_ROWS:
                yield arrow_batch(out, _DIGESTS)
                out = []
        held.add(*edit)
    if held is not None:
        out.append(held.row())
    if out:
        yield arrow_batch(out, _DIGESTS)
