"""Conversation structure repair by weighted CYK parsing of intervals.

A repaired conversation reads (s?(ua)+)? in initials of its roles. With the
places of that expression as 0 (start), 1 (after s), 2 (after u), 3 (after a),
a nonterminal (p, q) derives what leads from place p to q, in Chomsky normal
form: (p, q) -> (p, r) (r, q), or one row kept, rerolled or deleted. Insertions
need no row, so each cell is closed under them on both sides. A cell holds for
each nonterminal the cheapest (cost, audit); spans are combined bottom-up by
length, each from two halves: all binary cuts of a span give the same cell, as
the nonterminals join by their places. Costs add up over letters of the audit,
so of two audits of one cost none begins the other, and the least of joined
audits is the joint of the least.

Rows of a conversation pass in order, in blocks of ``SPAN``; what is carried on
is the best (cost, audit) for each place and the running hash of its text, so a
conversation needs no more memory than its audit and one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow

#: Rows parsed as one interval; costs.
SPAN, REROLE, DELETE, INSERT, TRUNCATED = 64, 3, 4, 3, 3
DROP, EMPTY, STRIP, REPEAT, USER = range(5)
#: The place that each role initial leads to, and the roles that may be given.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLES = {"u": "user", "a": "assistant"}
ENDS = (0, 3)
BLANKS = " \t\n\x0b\f\r"

Cell = dict[tuple[int, int], tuple[int, str]]


def _insertions() -> Cell:
    """Places that inserted rows alone connect."""
    out: Cell = {(p, p): (0, "") for p in range(4)}
    for _ in range(2):
        out |= {(p, NEXT[q, x]): (c + INSERT, a + "I") for (p, q), (c, a) in out.items() for x in ROLES if (q, x) in NEXT and (p, NEXT[q, x]) not in out}
    return out


INSERTED = _insertions()


def join(left: Cell, right: Cell) -> Cell:
    """The cell of a span from those of its two parts."""
    out: Cell = {}
    for (p, r), (c, a) in left.items():
        for q in range(4):
            b = right.get((r, q))
            if b is not None:
                new = (c + b[0], a + b[1])
                if (p, q) not in out or new < out[p, q]:
                    out[p, q] = new
    return out


_LEAVES: dict[tuple[str, str], Cell] = {}


def leaf(initial: str, fault: str) -> Cell:
    """The cell of one row, by its role's initial and fault ("", "blank", "duplicate" or "truncated")."""
    if initial not in "sua" or not initial:
        initial = "-"
    if (initial, fault) not in _LEAVES:
        own: Cell = {(p, p): (DELETE, "D") for p in range(4)}
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED if fault == "truncated" else 0
            for (p, x), q in NEXT.items():
                if x == initial:
                    own[p, q] = (more, "K")
                elif x in ROLES:
                    own[p, q] = (more + REROLE, "R")
        _LEAVES[initial, fault] = join(join(INSERTED, own), INSERTED)
    return _LEAVES[initial, fault]


def parse(leaves: list[Cell]) -> Cell:
    """Combine spans bottom-up by their length."""
    while len(leaves) > 1:
        leaves = [join(leaves[i], leaves[i + 1]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def repaired(place: int, audit: str, rows: list[tuple[str, str]]) -> list[str]:
    """The lines that an audit makes of rows (role, text) from a place on."""
    out, at = [], iter(rows)
    for edit in audit:
        if edit == "D":
            next(at)
            continue
        role, text = ("", "") if edit == "I" else next(at)
        if edit != "K":
            role = ROLES["a" if place == 2 else "u"]
        out.append(f"{role}:{text}")
        place = NEXT[place, role[0]]
    return out


class Conversation:
    """What has been seen of one conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.rows, self.leaves = conv_id, [], []
        # for each place the best cost, its audit, the hash of the repaired lines, and whether there are any
        self.best = {0: (0, "", hashlib.sha256(), False)}
        self.low = self.high = self.initial = None
        self.turns = self.illegal = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if fault:
            self.faults[fault] += 1
        self.rows.append((role, text))
        self.leaves.append(leaf(initial, fault))
        if len(self.rows) == SPAN:
            self.flush()

    def flush(self) -> None:
        """Parse the rows at hand and join the cell to the best ways to where they begin."""
        if not self.rows:
            return
        cell, new = parse(self.leaves), {}
        for q in range(4):
            ways = [(was[0] + cell[p, q][0], was[1] + cell[p, q][1], p) for p, was in self.best.items() if (p, q) in cell]
            if ways:
                cost, audit, p = min(ways)
                digest, begun = self.best[p][2].copy(), self.best[p][3]
                lines = repaired(p, cell[p, q][1], self.rows)
                if lines:
                    digest.update(("\n" * begun + "\n".join(lines)).encode())
                new[q] = (cost, audit, digest, begun or bool(lines))
        self.best, self.rows, self.leaves = new, [], []

    def result(self) -> tuple:
        self.flush()
        cost, audit, digest = min(self.best[q][:2] + (self.best[q][2].hexdigest(),) for q in ENDS if q in self.best)
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, *self.faults.values(), self.illegal, cost, audit, digest


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of conversations (conv_id, turn, role, text) after the damage that a CRC of conversation and turn decides: conv_id, turn, role, text, there (false for a row that is dropped). Null role or text is one space."""
    k = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    text = F.coalesce("text", F.lit(" "))
    return conversations.select(
        F.col("conv_id").cast("bigint"),
        F.col("turn").cast("bigint"),
        F.when(k == USER, ROLES["u"]).otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(k == EMPTY, "").when(k == STRIP, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (k != DROP).alias("there"),
        F.explode(F.array_repeat(F.lit(0), F.when(k == REPEAT, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, there) with ``fault``: "blank", "duplicate" (role and text seen earlier), "truncated" or "". Rows of a conversation come into one task, where all later steps find them."""
    bare = F.translate("text", BLANKS, "")
    seen = F.row_number().over(Window.partitionBy("conv_id", "there", "role", "text").orderBy("turn")) > 1
    fault = F.when(bare == "", "blank").when(seen, "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    return rows.repartition("conv_id").withColumn("fault", fault)


ORDER = ("conv_id", "turn", "role", "text")
RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def structure(rows: DataFrame) -> DataFrame:
    """The faults of each conversation and its cheapest repair.

    ``rows``: conv_id, turn, role, text, there. Returns a row for each conv_id,
    also where no row is there (zeros, empty audit): gaps, blank, duplicate,
    truncated, illegal, cost, audit (an initial for each edit: Keep, Rerole,
    Delete, Insert; ties to the least), repaired_sha256 (of the repaired lines
    role:text). Rows go by turn (nulls first), then role and text, which settles
    ties; rows of null conv_id are one conversation; a role of no known initial
    can't be kept. Texts of any length pass whole, an empty table gives no
    rows, other columns are not read. A hash of a conversation's text has to
    pass its rows in order, so one conversation is one task's stream.
    """
    kinds = [("conv_id", pa.int64()), *((x, pa.int64()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        for batch in batches:
            done = []
            for conv_id, turn, role, text, there, fault in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.result())
                    now = Conversation(conv_id)
                if there:
                    now.add(turn, role, text, fault)
            yield _batch(done, kinds)
        if now is not None:
            yield _batch([now.result()], kinds)

    return map_arrow(faults(rows).select(*ORDER, "there", "fault").sortWithinPartitions(*ORDER), run, RESULT)


def _batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def repair(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text, edit (K, R or I), turn (null for inserted rows).

    ``rows`` as for ``structure``, ``found`` its result, whose audits head
    their conversations' rows. Nulls, ties, empty tables as there.
    """
    kinds = [("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string()), ("turn", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, place, conv_id = "", 0, 0, 0, None
        for batch in batches:
            out: list[tuple] = []

            def put(edit: str, role: str, text: str, turn: int | None) -> None:
                nonlocal state, place
                role = role if edit == "K" else ROLES["a" if state == 2 else "u"]
                out.append((conv_id, place, role, text, edit, turn))
                state, place = NEXT[state, role[0]], place + 1

            def insert() -> None:
                nonlocal at
                while audit[at : at + 1] == "I":
                    put("I", "", "", None)
                    at += 1

            for conv_id, head, turn, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):  # noqa: B020
                if head is not None:
                    audit, at, state, place = head, 0, 0, 0
                else:
                    if audit[at] != "D":
                        put(audit[at], role, text, turn)
                    at += 1
                insert()
            yield _batch(out, kinds)

    none = F.lit(None)
    heads = found.select("conv_id", F.col("audit").alias("head"), none.cast("bigint").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"))
    own = rows.where("there").select("conv_id", none.cast("string").alias("head"), "turn", "role", "text")
    both = heads.unionByName(own).repartition("conv_id").sortWithinPartitions("conv_id", F.col("head").isNull(), "turn", "role", "text")
    return map_arrow(both.select("conv_id", "head", "turn", "role", "text"), run, "conv_id bigint, place bigint, role string, text string, edit string, turn bigint")
