"""Conversation structure: faults found, and the cheapest edits that give every conversation a legal shape."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = " \t\n\x0b\x0c\r"
#: Shapes are (s?(ua)+)? over the initials of roles: state and initial to the next state.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
STATES, ENDS = 4, (0, 3)
#: The one role that may come next where a turn is made up or gets a new role.
NEXT = {0: "user", 1: "user", 2: "assistant", 3: "user"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LEGAL = ("su", "ua", "au")
#: A row that must go, in a conversation written as one letter a row; capitals are truncated rows.
GONE = "-"


def _row_edits(mark: str) -> list[tuple[str, int, dict[int, int]]]:
    """Edits of one row: (letter, cost, state before to state after)."""
    delete = ("D", DELETE, {q: q for q in range(STATES)})
    if mark == GONE:
        return [delete]
    worse = TRUNCATED if mark.isupper() else 0
    keep = {q: STEP[q, mark.lower()] for q in range(STATES) if (q, mark.lower()) in STEP}
    return [delete, ("K", KEEP + worse, keep), ("R", REROLE + worse, {q: STEP[q, NEXT[q][0]] for q in range(STATES)})]


EDITS = {mark: _row_edits(mark) for mark in "suaxSUAX" + GONE}
MADE = {q: STEP[q, NEXT[q][0]] for q in range(STATES)}


def _after(marks: str, node: int) -> Iterator[tuple[str, int, int]]:
    """Edges out of a lattice node, row * STATES + state: (letter, cost, node), letters in ASCII order."""
    i, q = divmod(node, STATES)
    edits = EDITS[marks[i]] if i < len(marks) else []
    for k, (letter, cost, to) in enumerate(edits):
        if q in to:
            yield letter, cost, (i + 1) * STATES + to[q]
        if k == 0:
            yield "I", INSERT, i * STATES + MADE[q]
    if not edits:
        yield "I", INSERT, i * STATES + MADE[q]


def _before(marks: str, node: int) -> Iterator[tuple[int, int]]:
    """Edges into a lattice node: (cost, node)."""
    i, q = divmod(node, STATES)
    for p, to in MADE.items():
        if to == q:
            yield INSERT, i * STATES + p
    for _, cost, to in EDITS[marks[i - 1]] if i else ():
        for p, r in to.items():
            if r == q:
                yield cost, (i - 1) * STATES + p


@lru_cache(maxsize=1 << 16)
def cheapest_edits(marks: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of a conversation, the ASCII-least audit among them.

    Dijkstra's search runs from the start and from the legal ends at once, the side with the nearer front first. It goes
    on until the fronts together exceed the best meeting, so every cheapest path has an edge or node at which settled
    halves cross. Nodes of the forward half from which no crossing is reached are left out; the least letter at each
    node of what remains gives the least audit, as no audit is the start of an equally cheap one (that would cost
    inserts for nothing) and a letter names one edge. Linear in memory, and in time but for the heaps.
    """
    n = len(marks)
    near = {0: 0}, {n * STATES + q: 0 for q in ENDS}
    done: tuple[dict[int, int], dict[int, int]] = ({}, {})
    # a free edge leads a row on, so at one distance forward rows go up, backward ones down
    heaps = [(0, 0, 0)], [(0, -n, n * STATES + q) for q in ENDS]
    best = min((d + near[1][v] for v, d in near[0].items() if v in near[1]), default=1 << 62)
    while True:
        for heap, seen in zip(heaps, done, strict=True):
            while heap and heap[0][2] in seen:
                heapq.heappop(heap)
        if not heaps[0] or not heaps[1] or heaps[0][0][0] + heaps[1][0][0] > best:
            break
        side = int(heaps[1][0][0] < heaps[0][0][0])
        d, _, v = heapq.heappop(heaps[side])
        done[side][v] = d
        for cost, w in ((c, w) for _, c, w in _after(marks, v)) if side == 0 else _before(marks, v):
            if d + cost < near[side].get(w, 1 << 62):
                near[side][w] = d + cost
                row = w // STATES
                heapq.heappush(heaps[side], (d + cost, -row if side else row, w))
                if w in near[1 - side]:
                    best = min(best, d + cost + near[1 - side][w])
    # a distance that was met but not settled is of a real path, so where it makes up the best cost it is final
    ahead, back = done[0], near[1]
    leads: set[int] = set()

    def goes_on(g: int, w: int) -> bool:
        return (w in leads and ahead[w] == g) or (w in back and g + back[w] == best)

    for v in reversed(ahead):
        if goes_on(ahead[v], v) or any(goes_on(ahead[v] + cost, w) for _, cost, w in _after(marks, v)):
            leads.add(v)
    audit, g, v = [], 0, 0
    while g < best or v // STATES < n:
        letter, cost, w = next(e for e in _after(marks, v) if goes_on(g + e[1], e[2]))
        audit.append(letter)
        g, v = g + cost, w
    return best, "".join(audit)


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) as they come out of the damage by CRC-32 of ``conv_id:turn``, a twentieth each.

    Null role or text, and null conv_id or turn in the key, is one space. 0 drops the row (``alive`` is false, so that
    the conversation is still known), 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it (``copy`` 1), 4 makes
    it the user's.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(shown[0], F.lit(":"), shown[1])) % 20
    role = F.when(kind == 4, F.lit("user")).otherwise(shown[2])
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(shown[3], ".!?", "")).otherwise(shown[3])
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind != 0).alias("alive"), copies.alias("copy"))


class Conversation:
    """One conversation as its rows stream by: first all rows without texts, then the texts.

    Holds a letter and a digest a row, no texts.
    """

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.marks: list[str] = []
        self.seen: set[bytes] = set()
        self.turns: set[int] = set()
        self.initial = ""
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.cost, self.audit, self.at, self.state = 0, "", 0, 0
        self.digest, self.lines = hashlib.sha256(), 0

    def look(self, turn: int | None, initial: str, said: bytes, blank: bool, truncated: bool) -> None:
        if turn is not None:
            self.turns.add(turn)
        if self.marks and self.initial + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.initial = initial
        fault = "blank" if blank else "duplicate" if said in self.seen else "truncated" if truncated else None
        self.seen.add(said)
        if fault:
            self.counts[fault] += 1
        mark = initial if initial and initial in "sua" else "x"
        self.marks.append(GONE if fault in ("blank", "duplicate") else mark.upper() if fault else mark)

    def judge(self) -> None:
        self.cost, self.audit = cheapest_edits("".join(self.marks))

    def _line(self, edit: str, role: str, text: str) -> tuple[int, str, str, str]:
        self.state = STEP[self.state, role[0]]
        self.digest.update((b"\n" if self.lines else b"") + f"{role}:{text}".encode("utf-8", "replace"))
        self.lines += 1
        return self.lines - 1, edit, role, text

    def inserted(self) -> Iterator[tuple[int, str, str, str]]:
        """The turns made up at this place."""
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._line("I", NEXT[self.state], "")

    def repaired(self, role: str, text: str) -> Iterator[tuple[int, str, str, str]]:
        """What becomes of the next row: (position, edit, role, text)."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._line(edit, role if edit == "K" else NEXT[self.state], text)

    def summary(self) -> dict:
        turns = self.turns
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        return {"conv_id": self.conv_id, "gaps": gaps, **self.counts, "cost": self.cost, "audit": self.audit, "repaired_sha256": self.digest.hexdigest()}


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURN = "position long, edit string, role string, text string"


def _repair(rows: DataFrame, turns: bool) -> DataFrame:
    """Summaries of conversations, or their repaired turns, from rows like those of ``damaged``."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    last = F.substring(trimmed, -1, 1)
    said = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32))
    marked = rows.select("*", said.alias("said"), (trimmed == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))
    # each row twice: without its text, then, behind all these of its conversation, with it
    phase = F.explode(F.when(F.col("alive"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    both = marked.select("*", phase.alias("phase")).withColumn("text", F.when(F.col("phase") == 1, F.col("text")))
    order = ["conv_id", "phase", "turn", "role", "said", "copy"]
    key = rows.schema["conv_id"].dataType.simpleString()
    schema = T.StructType.fromDDL(f"conv_id {key}, {TURN if turns else SUMMARY}")
    columns = ("conv_id", "phase", "alive", "turn", "role", "said", "blank", "truncated", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        now: Conversation | None = None
        judged = False

        def ended() -> list[dict]:
            if now is None:
                return []
            if not judged:
                now.judge()
            made = [(now.conv_id, *line) for line in now.inserted()]
            return [dict(zip(arrow.names, line, strict=True)) for line in made] if turns else [now.summary()]

        for batch in batches:
            out = []
            for conv_id, phase, alive, turn, role, said, blank, truncated, text in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if now is None or conv_id != now.conv_id:
                    out += ended()
                    now, judged = Conversation(conv_id), False
                if phase == 0:
                    if alive:
                        now.look(turn, role[:1], said, blank, truncated)
                    continue
                if not judged:
                    now.judge()
                    judged = True
                for line in now.repaired(role, text):
                    if turns:
                        out.append(dict(zip(arrow.names, (conv_id, *line), strict=True)))
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        yield pa.RecordBatch.from_pylist(ended(), schema=arrow)

    dealt = both.select(*columns, "copy").repartition("conv_id").sortWithinPartitions(*order)
    return dealt.select(*columns).mapInArrow(run, schema)


def as_given(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) for repair without damage; null role or text is one space."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return rows.select("conv_id", "turn", *shown, F.lit(True).alias("alive"), F.lit(0).alias("copy"))


def repairs(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (as from ``damaged`` or ``as_given``): its faults, the edits, and a digest of the result.

    Rows go by turn (null first), those of one turn by role, then by a digest of role and text; equal rows are
    duplicates from the second on. The first fault of a row counts: blank, duplicate, truncated. ``illegal`` counts
    neighbours whose role initials may not follow each other, ``gaps`` the turns missing between least and largest.
    Blank and duplicate rows are deleted; the rest is kept, gets another role or is deleted, and empty turns are put in,
    at least cost, so that the initials read ``(s?(ua)+)?``. ``audit`` has the initials of the edits in order,
    ASCII-least of the cheapest; ``repaired_sha256`` is of the repaired ``role:text`` joined by newlines. An empty role
    has no initial and fits nowhere. Null conv_id is a conversation. One without rows left has zeros, an empty
    audit and the digest of nothing. No rows give no rows; other columns are not read.

    One shuffle by conversation. A SHA-256 is one chain, so a conversation is one task's; its texts pass one at a
    time, and a letter and a digest a row are held.
    """
    return _repair(rows, turns=False)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position, edit (K, R or I), role, text. Order and rules as in ``repairs``."""
    return _repair(rows, turns=True)


def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
