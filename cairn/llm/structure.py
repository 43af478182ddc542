"""Repair of conversation structure: cheapest edits by a Viterbi search that emits what all survivors share."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import pick

#: What has been read of `(s?(ua)+)?`: nothing, the system row, a user row, an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Where a kept row of an initial leads, and where the only row that a rerole or an insertion can make leads.
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
MADE = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: Whatever can follow NOTHING can follow ASSISTANT for at most so much more: a kept system row becomes a deleted one.
DETOUR = DELETE
SPACE = " \t\n\v\f\r"
#: Edits that wait before shared ones are looked for; doubled while few are found, so that looking stays cheap.
PATIENCE = 32
#: Rows of an output batch, and characters after which it ends early.
BATCH_ROWS, BATCH_CHARS = 4096, 4_000_000

_SOURCE = ["conv_id", "turn", "role", "text"]
_EDITS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("place", pa.int64()),
        ("edit", pa.string()),
        ("role", pa.string()),
        ("text", pa.string()),
        ("turn", pa.int64()),
        ("fault", pa.string()),
        ("illegal", pa.bool_()),
    ]
)
EDITS = "conv_id long, place long, edit string, role string, text string, turn long, fault string, illegal boolean"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
REPORT = "conv_id long, " + "".join(f"{c} long, " for c in COUNTS) + "audit string, repaired_sha256 string"


class Edit:
    """A node of the backpointer tree; `holders` counts the later edits and the survivors that refer to it."""

    __slots__ = ("before", "holders", "kind")

    def __init__(self, before: Edit | None, kind: str):
        self.before, self.kind, self.holders = before, kind, 0
        if before is not None:
            before.holders += 1


def _let_go(edit: Edit | None) -> None:
    """One holder less; an edit that nobody holds leaves the tree."""
    while edit is not None:
        edit.holders -= 1
        if edit.holders:
            return
        edit = edit.before


#: (cost, state before the row, letter, insertions after it)
Way = tuple[int, int, str, int]


class Survivors:
    """The cheapest way to each state for the rows read so far, ties to the ASCII-least string of edits.

    Two ways of equal cost to one state differ in a letter before either ends (if one were the start of
    the other, the rest would be insertions, which cost).  Their order is that of the whole strings
    that led there, which `rank` holds, so complete unresolved strings are compared in one step.
    """

    def __init__(self) -> None:
        self.root = Edit(None, "")
        self.cost: list[int | None] = [None] * 4
        self.last: list[Edit | None] = [None] * 4
        self.rank = [0] * 4
        self.waiting, self.patience = 0, PATIENCE
        self.last[NOTHING] = self.root
        self.root.holders = 1
        self._move([(0, NOTHING, "", 0), None, None, None])

    def _starts(self, a: int, b: int) -> bool:
        """Whether the string that led to state a is the start of that of b: only insertions lie between."""
        edit, target = self.last[b], self.last[a]
        while edit is not target:
            if edit.kind != "I":
                return False
            edit = edit.before
        return True

    def _first(self, a: Way, b: Way) -> bool:
        """Whether the string of way a, up to its row, comes before that of way b."""
        if a[1] == b[1]:
            return a[2] < b[2]
        if self._starts(a[1], b[1]):
            return a[2] < "I"
        if self._starts(b[1], a[1]):
            return b[2] > "I"
        return self.rank[a[1]] < self.rank[b[1]]

    def read(self, initial: str, unwanted: bool, cut_off: bool) -> None:
        """One row: kept, reroled or deleted from every state, with insertions after it."""
        found: list[Way | None] = [None] * 4
        for state, cost in enumerate(self.cost):
            if cost is None:
                continue
            ways = [(state, (cost + DELETE, state, "D", 0))]
            if not unwanted:
                kept = KEPT[state].get(initial)
                if kept is not None:
                    ways.append((kept, (cost + cut_off, state, "K", 0)))
                ways.append((MADE[state], (cost + REROLE + cut_off, state, "R", 0)))
            for to, way in ways:
                best = found[to]
                if best is None or way[0] < best[0] or (way[0] == best[0] and self._first(way, best)):
                    found[to] = way
        self._move(found)

    def _move(self, found: list[Way | None]) -> None:
        """Adds insertions to the ways found, drops hopeless states, and puts the new survivors in place of the old."""
        for a, b in ((NOTHING, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)):
            if found[a] is not None:
                total, source, kind, inserted = found[a]
                best = found[b]
                if best is None or total + INSERT < best[0] or (total + INSERT == best[0] and self._first(found[a], best)):
                    found[b] = (total + INSERT, source, kind, inserted + 1)
        after, system, nothing = found[ASSISTANT], found[SYSTEM], found[NOTHING]
        if system is not None and (after[0] < system[0] or (after[0] == system[0] and self._first(after, system))):
            found[SYSTEM] = None
        if nothing is not None and after[0] + DETOUR < nothing[0]:
            found[NOTHING] = None

        nodes: dict[tuple[int, str, int], Edit] = {}
        live = [(to, way) for to, way in enumerate(found) if way is not None]
        last: list[Edit | None] = [None] * 4
        for to, (_, source, kind, inserted) in live:
            node = self.last[source]
            for k in range(0 if kind else 1, inserted + 1):
                made = nodes.get((source, kind, k))
                if made is None:
                    made = nodes[source, kind, k] = Edit(node, "I" if k else kind)
                node = made
            node.holders += 1
            last[to] = node
        rank = [0] * 4
        for at, (a, x) in enumerate(live):
            for b, y in live[:at]:
                same = x[1:3] == y[1:3]
                if (x[3] < y[3]) if same else self._first(x, y):
                    rank[b] += 1
                else:
                    rank[a] += 1
        for edit in self.last:
            if edit is not None:
                _let_go(edit)
        self.cost, self.last, self.rank = [way and way[0] for way in found], last, rank
        self.waiting += 1

    def shared(self) -> str:
        """Edits that all survivors share and that were not given before; looked for when enough rows wait."""
        if self.waiting < self.patience:
            return ""
        path, edit = [], next(x for x in self.last if x is not None)
        while edit is not self.root:
            path.append(edit)
            edit = edit.before
        out = []
        while path and self.root.holders == 1:
            self.root = path.pop()
            self.root.before = None
            out.append(self.root.kind)
        self.waiting = len(path)
        self.patience = max(PATIENCE, 2 * len(path))
        return "".join(out)

    def rest(self) -> str:
        """The edits not given yet of the cheapest way that ends with nothing or with an assistant row."""
        ends = [(self.cost[s], self.rank[s], s) for s in (NOTHING, ASSISTANT) if self.cost[s] is not None]
        out, edit = [], self.last[min(ends)[2]]
        while edit is not self.root:
            out.append(edit.kind)
            edit = edit.before
        return "".join(reversed(out))


class _Conversation:
    """Rows of one conversation in order: those without a decision wait, the others leave as edits."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.place, self.state, self.before = conv_id, 0, NOTHING, None
        self.survivors, self.rows = Survivors(), deque()

    def read(self, turn: int | None, role: str, text: str, repeated: bool) -> list[tuple]:
        end = text.rstrip(SPACE)[-1:]
        fault = "blank" if not end else "duplicate" if repeated else "truncated" if end not in ".!?" else None
        illegal = self.before is not None and self.before + role[:1] not in LEGAL
        self.before = role[:1]
        self.rows.append((turn, role, text, fault, illegal))
        self.survivors.read(role[:1], fault in ("blank", "duplicate"), fault == "truncated")
        return self._decided(self.survivors.shared())

    def finish(self) -> list[tuple]:
        return self._decided(self.survivors.rest())

    def _decided(self, edits: str) -> list[tuple]:
        out = []
        for kind in edits:
            turn, role, text, fault, illegal = (None, None, "", None, False) if kind == "I" else self.rows.popleft()
            if kind == "D":
                text = None
            elif kind == "K":
                self.state = KEPT[self.state][role[:1]]
            else:
                self.state = MADE[self.state]
                role = ROLES[self.state]
            out.append((self.conv_id, self.place, kind, role, text, turn, fault, illegal))
            self.place += 1
        return out


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of conversations whose rows follow each other in order."""
    here: _Conversation | None = None
    out: list[tuple] = []
    chars = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _EDITS, strict=True)], schema=_EDITS
        )

    for part in batches:
        for conv_id, turn, role, text, repeated in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if here is None or here.conv_id != conv_id:
                out += here.finish() if here is not None else []
                here = _Conversation(conv_id)
            done = here.read(turn, role, text, repeated)
            out += done
            chars += sum(len(x[4] or "") for x in done)
            if len(out) >= BATCH_ROWS or chars >= BATCH_CHARS:
                yield batch()
                out, chars = [], 0
    out += here.finish() if here is not None else []
    if out:
        yield batch()


def repair(conversations: DataFrame) -> DataFrame:
    """The cheapest edits that give each conversation (conv_id, turn, role, text) the roles `(s?(ua)+)?` by initial.

    One row per edit, numbered by `place` within conv_id: K(ept), R(eroled), D(eleted, text null) with
    the row's turn, its fault and whether its initial may not follow that of the row before, or
    I(nserted: a user or assistant row with an empty text, no turn).  Faults: blank (nothing but white
    space), duplicate (role and text seen earlier in the conversation), else truncated (no [.!?] at
    the end).  Costs: R 2, I 2, D 3, truncated rows kept or reroled 1 more; blank and duplicate rows have
    to go.  Of equal costs the ASCII-least string of letters wins.

    Rows stand by turn, those without one first, equal turns by role and text.  Null roles and texts
    are one space; rows without conv_id are one conversation; repeated rows are duplicates; an empty
    table gives no rows.  Any other column stays behind.

    A conversation is read in order by one task, as its edits depend on each other; the task holds the
    survivors' backpointers and the rows that await a decision, not the conversation.
    """
    rows = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    # Windows by (conv_id, role, text) find their rows already together by conv_id: one shuffle.
    earlier = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn"))
    return (
        rows.repartition("conv_id")
        .select(*_SOURCE, (earlier > 1).alias("repeated"))
        .sortWithinPartitions("conv_id", "turn", "role", "text", "repeated")
        .mapInArrow(_repaired, EDITS)
    )


class _Report:
    """Counts and digests of one conversation, from its edits in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.audit, self.sha, self.joined = conv_id, [], hashlib.sha256(), False
        self.n = dict.fromkeys(COUNTS, 0)
        self.first = self.turn = None
        self.turns = 0

    def read(self, edit: str, role: str, text: str | None, turn: int | None, fault: str | None, illegal: bool) -> None:
        n = self.n
        self.audit.append(edit)
        n["illegal"] += illegal
        if fault:
            n[fault] += 1
        n["cost"] += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
        n["cost"] += CUT_OFF * (fault == "truncated" and edit != "D")
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn = turn
            self.turns += 1
        if edit != "D":
            self.sha.update(("\n" * self.joined + f"{role}:{text}").encode())
            self.joined = True

    def row(self) -> tuple:
        self.n["gaps"] = self.turn - self.first + 1 - self.turns if self.turns else 0
        return (self.conv_id, *self.n.values(), "".join(self.audit), self.sha.hexdigest())


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    here: _Report | None = None
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        kinds = [pa.int64()] * (1 + len(COUNTS)) + [pa.string()] * 2
        names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names
        )

    for part in batches:
        for conv_id, *facts in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if here is None or here.conv_id != conv_id:
                out += [here.row()] if here is not None else []
                here = _Report(conv_id)
            here.read(*facts)
        if len(out) >= BATCH_ROWS:
            yield batch()
            out = []
    out += [here.row()] if here is not None else []
    if out:
        yield batch()


def report(edits: DataFrame) -> DataFrame:
    """Per conversation of repair()'s result: gaps in turns, faults, cost, the letters of its edits, a digest of what stays.

    Reads the edits as repair() leaves them, conversation by conversation and in order; for edits
    from elsewhere (a written table) use `edits.repartition("conv_id").sortWithinPartitions("conv_id", "place")`.
    """
    return edits.select("conv_id", "edit", "role", "text", "turn", "fault", "illegal").mapInArrow(_reported, REPORT)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows spoilt by crc32(`conv_id:turn`) % 20: 0 goes, 1 loses its text, 2 its [.!?], 3 comes twice, 4 becomes a user's.

    Nulls in the key, in role and in text read as one space.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    drawn = conversations.select(
        F.col("conv_id").alias("conv_id"),
        F.col("turn").alias("turn"),
        part("role").alias("role"),
        part("text").alias("text"),
        (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20).alias("draw"),
    )
    draw = F.col("draw")
    copies = F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1)
    return drawn.select(
        "conv_id",
        "turn",
        F.when(draw == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"),
    ).drop("copy")


def repaired_damage(conversations: DataFrame) -> DataFrame:
    """report() of the damaged conversations, with a row for each original conv_id, also where no row is left."""
    found = report(repair(damage(conversations)))
    asked = conversations.select(F.col("conv_id").cast("long").alias("asked")).distinct()
    nothing = {c: F.lit(0).cast("long") for c in COUNTS}
    nothing |= {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return asked.join(found, F.col("asked").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("asked").alias("conv_id"), *[F.coalesce(F.col(c), v).alias(c) for c, v in nothing.items()]
    )
