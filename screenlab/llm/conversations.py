"""Conversation structure repair by a lazily determinised weighted automaton.

Role sequences must follow ``(s?(ua)+)?``: an optional system row, then users and assistants in turn. Each
row may be kept, given another role or deleted, and empty rows may be put in, all at a cost. The costs of
ending well from each grammar state, less the smallest of them, are one state of the determinised automaton;
states and their transitions are made when first met and kept in a table. They differ by less than the price
of a few edits, so there are few. One scan of the table from a conversation's last row to its first gives its
cost, and a walk back along tight arcs gives the edits.

Rows of a conversation reach a task as one sorted stream, what faults need before what the texts need, so
a task holds one byte for each row of a conversation and its edits (which the result holds too), never its texts.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space, costs of the edits, and roles that rows may be given.
SPACE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: Grammar states: start, after the system row, after a user, after an assistant; it may end in the first and the last.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ENDS = (0, 3)
_LEGAL = {"su", "ua", "au"}
_FAR = 1 << 20


class Automaton:
    """Costs to the end as states of an automaton that reads rows from the last to the first.

    A symbol is 0 for a row that must go, else 1 + 2 * (place of its initial in "sua", or 3) + whether it is truncated.
    """

    def __init__(self):
        self.ids: dict[tuple[int, ...], int] = {}
        self.vectors: list[tuple[int, ...]] = []
        self.next: list[list[tuple[int, int] | None]] = []
        self.paths: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.last = self._state(self._closed([0 if q in ENDS else _FAR for q in range(4)]))[0]

    @staticmethod
    def symbol(initial: str, truncated: bool) -> int:
        place = "sua".find(initial) if initial else -1
        return 1 + 2 * (place if place >= 0 else 3) + truncated

    @staticmethod
    def _closed(costs: list[int]) -> list[int]:
        """Costs once rows may be put in before what is left."""
        for _ in range(3):
            for (q, role), to in STEP.items():
                if role in ROLES:
                    costs[q] = min(costs[q], INSERT + costs[to])
        return costs

    def _state(self, costs: list[int]) -> tuple[int, int]:
        """The state of a cost vector less its smallest cost, and that cost."""
        least = min(costs)
        key = tuple(c - least for c in costs)
        if key not in self.ids:
            self.ids[key] = len(self.vectors)
            self.vectors.append(key)
            self.next.append([None] * 9)
        return self.ids[key], least

    @staticmethod
    def _edits(symbol: int, q: int) -> Iterator[tuple[str, int, int]]:
        """Letter, cost and next grammar state of each edit of a row, ASCII-least first."""
        yield "D", DELETE, q
        if symbol:
            initial, extra = "sua?"[(symbol - 1) // 2], TRUNCATED * ((symbol - 1) % 2)
            if (q, initial) in STEP:
                yield "K", extra, STEP[q, initial]
            for role in ROLES:
                if (q, role) in STEP:
                    yield "R", REROLE + extra, STEP[q, role]

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """The state before one more row, and what is added to all costs; worked out when first asked for."""
        after = self.vectors[state]
        found = self._state(self._closed([min(c + after[to] for _, c, to in self._edits(symbol, q)) for q in range(4)]))
        self.next[state][symbol] = found
        return found

    def path(self, state: int, symbol: int, q: int) -> tuple[str, int]:
        """Edits from grammar state ``q`` up to and with those of one row (none at the end, symbol -1), and the grammar state then."""
        key = (state, symbol, q)
        if key not in self.paths:
            after = self.vectors[state]
            (before, added), letters = (self.next[state][symbol], "") if symbol >= 0 else ((state, 0), "")
            now = self.vectors[before]
            while True:
                if symbol >= 0:
                    tight = [(edit, to) for edit, c, to in self._edits(symbol, q) if now[q] + added == c + after[to]]
                elif q in ENDS:
                    break
                else:
                    tight = []
                put = next((to for role in ROLES if (to := STEP.get((q, role))) is not None and now[q] == INSERT + now[to]), None)
                if tight and (tight[0][0] == "D" or put is None):
                    letters, q = letters + tight[0][0], tight[0][1]
                    break
                letters, q = letters + "I", put
            self.paths[key] = (letters, q)
        return self.paths[key]

    def repair(self, symbols: bytes | bytearray) -> tuple[int, str]:
        """The least cost and the ASCII-least edits of that cost."""
        state, cost, states = self.last, 0, array("l", [self.last])
        table = self.next
        for symbol in reversed(symbols):
            state, added = table[state][symbol] or self.step(state, symbol)
            cost += added
            states.append(state)
        cost += self.vectors[state][0]
        q, out = 0, []
        for k, symbol in enumerate(symbols):
            letters, q = self.path(states[len(symbols) - 1 - k], symbol, q)
            out.append(letters)
        return cost, "".join(out) + self.path(self.last, -1, q)[0]


def filled(column: str) -> Column:
    """Text of a column, one space where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role and text, damaged by the CRC-32 of ``conv_id:turn`` divided by 20 (nulls are one space there).

    0 drops the row, 1 empties its text, 2 takes away ``.``, ``!`` and ``?``, 3 repeats it, 4 makes it a user's.
    """
    code = F.crc32(F.encode(F.concat(filled(conv_id), F.lit(":"), filled(turn)), "utf-8")) % 20
    rows = rows.select(rows[conv_id].alias("conv_id"), rows[turn].cast("long").alias("turn"), filled(role).alias("role"), filled(text).alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1)))
    return rows.filter("code <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def _stream(rows: DataFrame, every: DataFrame | None) -> DataFrame:
    """Rows of a conversation in one task and in order: its id, first places of role and text, faults, then texts.

    First places are found by partial aggregates, so that no role and text, however common, is one group of rows.
    """
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"))
    rows = rows.withColumn("digest", F.md5(F.encode("text", "utf-8")))
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("named"), "turn")).alias("f"))
    end = F.rtrim("text", F.lit(SPACE))
    part = lambda section, kind, blank, cut, text: F.struct(F.lit(section).alias("section"), F.lit(kind).alias("kind"), blank.alias("blank"), cut.alias("cut"), text.alias("text"))
    false, none = F.lit(False), F.lit(None).cast("string")
    both = F.explode(F.array(part(1, 1, F.length(end) == 0, ~F.right(end, F.lit(1)).isin(".", "!", "?"), none), part(2, 0, false, false, F.col("text"))))
    blank = lambda section, kind: part(section, kind, false, false, none).alias("p")
    sections = rows.select("conv_id", "turn", "role", "digest", both.alias("p"))
    sections = sections.unionByName(first.select("conv_id", F.col("f.turn").alias("turn"), "role", "digest", blank(1, 0)))
    ids = (rows if every is None else every).select("conv_id").distinct()
    sections = sections.unionByName(ids.select("conv_id", F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("digest"), blank(0, 0)))
    order = ["conv_id", "section", F.asc_nulls_first("turn"), "role", "digest", "kind"]
    return sections.select("conv_id", "turn", "role", "digest", "p.*").repartition("conv_id").sortWithinPartitions(*order)


class _Conversation:
    """Faults, edits and repaired rows of one conversation, as its stream goes by."""

    def __init__(self, conv_id, automaton: Automaton):
        self.conv_id, self.automaton, self.symbols = conv_id, automaton, bytearray()
        self.first = self.initial = self.cost = None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None
        self.audit, self.at, self.role = "", 0, "a"

    def row(self, turn, role: str, digest: str, blank: bool, cut: bool) -> None:
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        again, self.first = (turn, role, digest) != self.first, None
        if self.initial is not None and self.initial + role[:1] not in _LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += cut and not blank and not again
        self.symbols.append(0 if blank or again else Automaton.symbol(role[:1], cut))

    def judge(self) -> None:
        if self.cost is None:
            self.cost, self.audit = self.automaton.repair(self.symbols)

    def _new(self, initial: str | None) -> str:
        """The role of the next row that stays: its own, or the one whose turn it is."""
        self.role = initial if initial == "s" else "a" if self.role == "u" else "u"
        return ROLES.get(self.role, "")

    def text(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """Edit, role and text of what is put in before the row, and of the row if it stays."""
        self.judge()
        yield from self.rest()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            new = self._new(role[:1] if edit == "K" else None)
            yield edit, role if edit == "K" else new, text

    def rest(self) -> Iterator[tuple[str, str, str]]:
        """What is put in here."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield "I", self._new(None), ""

    def report(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit


def _walk(batches, automaton: Automaton) -> Iterator[tuple[_Conversation, tuple[str, str, str] | None]]:
    """Each conversation with each of its repaired rows, then with None."""
    one = None
    for batch in batches:
        for conv_id, turn, role, digest, section, kind, blank, cut, text in zip(*(c.to_pylist() for c in batch.columns)):
            if section == 0:
                if one is not None:
                    one.judge()
                    yield from ((one, x) for x in one.rest())
                    yield one, None
                one = _Conversation(conv_id, automaton)
            elif section == 2:
                yield from ((one, x) for x in one.text(role, text))
            elif kind == 0:
                one.first = (turn, role, digest)
            else:
                one.row(turn, role, digest, blank, cut)
    if one is not None:
        one.judge()
        yield from ((one, x) for x in one.rest())
        yield one, None


def _gathered(found: Iterator[tuple], schema: pa.Schema, rows: int = 4096, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Tuples in batches of at most ``rows`` or about ``size`` characters of their last value."""
    held, characters = [], 0
    for row in found:
        held.append(row)
        characters += len(row[-1] or "")
        if len(held) >= rows or characters >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, characters = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _mapped(rows: DataFrame, every: DataFrame | None, columns: list[tuple[str, T.DataType]], made) -> DataFrame:
    stream = _stream(rows, every)
    schema = T.StructType([T.StructField("conv_id", stream.schema["conv_id"].dataType), *(T.StructField(n, t) for n, t in columns)])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from _gathered(made(_walk(batches, Automaton())), to_arrow_schema(schema))

    return stream.mapInArrow(run, schema)


def repaired_rows(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """conv_id, place (from 1), edit (K kept, R given another role, I put in), role and text of each repaired row.

    Rows go by turn (nulls first), rows of one turn by role and by digest of the text. Null roles and texts are one space,
    rows without a conv_id are one conversation, of repeated rows the first stays, an empty table gives an empty one and
    further columns are left out. Texts may have any length: they go by one at a time.
    """

    def made(found):
        place = 0
        for one, row in found:
            place = place + 1 if row else 0
            if row:
                yield one.conv_id, place, *row

    return _mapped(rows, every, [("place", T.LongType()), ("edit", T.StringType()), ("role", T.StringType()), ("text", T.StringType())], made)


def repair_report(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """A row for each conversation: gaps in turns, faults (blank, duplicate, truncated: each row's first), illegal neighbours,
    cost, audit (the edits' initials) and the SHA-256 of the repaired rows as ``role:text`` lines.

    Conversations are those of ``every`` where it is given: one without rows has zeros, no edits and the digest of nothing.
    Order, nulls and repeats as in ``repaired_rows``.
    """
    counts = [(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]

    def made(found):
        digest, began = hashlib.sha256(), False
        for one, row in found:
            if row:
                digest.update(("\n" * began + row[1] + ":" + row[2]).encode("utf-8", "surrogatepass"))
                began = True
            else:
                *numbers, audit = one.report()
                yield one.conv_id, *numbers, digest.hexdigest(), audit
                digest, began = hashlib.sha256(), False

    found = _mapped(rows, every, [*counts, ("repaired_sha256", T.StringType()), ("audit", T.StringType())], made)
    return found.select("conv_id", *[n for n, _ in counts], "audit", "repaired_sha256")
