"""Operator 11: repair of conversation structure by an integer-minimum DP.

A conversation's rows, in order, are edited until its role initials read
``(s?(ua)+)?``. Keep costs 0, Rerole (to user or assistant) 1, Delete 2, Insert
(an empty user or assistant turn, anywhere) 5; blank and repeated rows must
go, and a truncated row that stays costs 5 more.

The cheapest edits, and among them those whose initials are least in ASCII,
come from one scalar: a big integer whose high digits are the cost and whose
low digits, fixed in number, spell the edits' initials from the left (D, I, K,
R are 1 to 4; 0 is the padding behind the end, so a shorter string comes
first). An edit in front of a suffix adds its cost, moves the suffix's digits
one place to the right and puts its own digit before them. So an ordinary
minimum of integers over a DAG of (row, state of the grammar), from the last
row to the first, decides everything, and the digits of the least integer are
the edits.

Spark prepares and orders the rows. Each row goes to its conversation's task
twice: first as a few flags and a digest of role and text, all that the DP
needs, then with its text, which is hashed as it streams by. A task so holds
some bytes for each row of one conversation at a time, never its texts. The
DP's integers grow with the conversation, so its time is quadratic in the rows
of one conversation, with a very small factor (8,000 rows take about a second).

Null roles, texts, turns and ids read as one space in what is hashed or
compared; in order, null turns come first, and rows of one turn are ordered by
role, then by a digest of role and text. Rows with a null id are one conversation. Rows that repeat
are repeated rows. Very long texts stream. Other columns are not looked at.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_batches, mapped, read

#: White space, and what ends a whole sentence.
SPACE, STOPS = " \t\n\x0b\x0c\r", "[.!?]"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
LETTERS = " DIKR"
#: Faults of a row; the first that fits counts.
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
#: States of the grammar: nothing yet, after s, after u, after a; and where an inserted or reroled turn leads.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
#: Where keeping a row of this initial leads from each state, if it may be kept.
KEPT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
_NEVER = (None,) * 4


def cheapest(initials: str, faults: list[int]) -> tuple[int, str]:
    """The cost of the cheapest edits and their initials."""
    n = len(initials)
    width = 3 * (n + 2 * n // 5 + 4)  # bits of the low digits: no more inserts than deleting everything costs
    low, top = (1 << width) - 1, width - 3

    def put(letter: int, cost: int, rest: int) -> int:
        return ((rest >> width) + cost) << width | letter << top | (rest & low) >> 3

    def inserted(best: list[int]) -> list[int]:
        for _ in range(2):  # a third insert in one place would come back to a state that it had
            best = [min(best[s], put(INSERT, 5, best[NEXT[s]])) for s in range(4)]
        return best

    never = (2 * n + 20) << width
    best = inserted([0, never, never, 0])
    for i in range(n - 1, -1, -1):
        fault, here = faults[i], []
        kept = KEPT.get(initials[i], _NEVER)
        extra = 5 if fault == TRUNCATED else 0
        for s in range(4):
            least = put(DELETE, 2, best[s])
            if fault <= TRUNCATED:
                if kept[s] is not None:
                    least = min(least, put(KEEP, extra, best[kept[s]]))
                least = min(least, put(REROLE, 1 + extra, best[NEXT[s]]))
            here.append(least)
        best = inserted(here)
    least, out = best[START], []
    digits = least & low
    for at in range(top, -1, -3):
        if not (d := digits >> at & 7):
            break
        out.append(LETTERS[d])
    return least >> width, "".join(out)


REPAIRED = "conv_id long, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TYPES = [pa.int64()] * 8 + [pa.string()] * 2


class _Conversation:
    """One conversation as it streams by: flags first, then texts."""

    def __init__(self, conv):
        self.conv, self.initials, self.faults, self.seen = conv, [], [], set()
        self.turns, self.first, self.last, self.illegal = 0, None, None, 0
        self.sha, self.edits, self.state, self.some = hashlib.sha256(), None, START, False

    def flag(self, turn, initial: str, last: str, digest: bytes) -> None:
        fault = BLANK if not last else DUPLICATE if digest in self.seen else FINE if last in ".!?" else TRUNCATED
        self.seen.add(digest)
        if self.initials and self.initials[-1] + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initials.append(initial)
        self.faults.append(fault)
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn

    def decide(self) -> None:
        self.cost, self.audit = cheapest([x if x in KEPT else "?" for x in self.initials], self.faults)
        self.seen, self.edits = None, iter(self.audit)

    def put(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.some else "") + f"{role}:{text}").encode())
        self.some = True

    def made(self) -> str:
        """The role that the grammar asks for next."""
        self.state = NEXT[self.state]
        return "user" if self.state == USER else "assistant"

    def inserts(self) -> str | None:
        """Put what is inserted here; the next edit of another kind, if there is one."""
        for edit in self.edits:
            if edit != "I":
                return edit
            self.put(self.made(), "")
        return None

    def row(self, role: str, text: str) -> None:
        if self.edits is None:
            self.decide()
        edit = self.inserts()
        if edit == "K":
            self.state = KEPT[role[:1]][self.state]
            self.put(role, text)
        elif edit == "R":
            self.put(self.made(), text)

    def result(self) -> tuple:
        if self.edits is None:
            self.decide()
        self.inserts()
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.conv, len(self.faults), gaps, *(self.faults.count(x) for x in (BLANK, DUPLICATE, TRUNCATED)), self.illegal, self.cost, self.audit, self.sha.hexdigest())


def repair(rows: DataFrame) -> DataFrame:
    """``REPAIRED`` for each conversation of ``rows`` (conv_id, turn, role, text).

    A row whose turn was lost altogether may stand there with ``gone`` true (a
    further, optional column): it only names its conversation.
    """
    bounded_batches(rows)
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), gone.alias("gone"))
    own = own.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))
    last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    first = own.select("conv_id", F.lit(0).alias("phase"), "turn", "role", "digest", F.when(~F.col("gone"), last).alias("x"))
    then = own.where(~F.col("gone")).select("conv_id", F.lit(1).alias("phase"), "turn", "role", "digest", F.col("text").alias("x"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = first.unionByName(then).repartition(parts, "conv_id").sortWithinPartitions("conv_id", "phase", "turn", "role", "digest")

    def run(batches):
        none = object()
        last, own = none, None

        def send(results):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*results), _TYPES)], [x.split()[0] for x in REPAIRED.split(", ")])

        for b in batches:
            results = []
            for conv, phase, turn, role, digest, x in zip(*(b.column(i).to_pylist() for i in range(6))):
                if last is none or conv != last:
                    if own is not None:
                        results.append(own.result())
                    last, own = conv, _Conversation(conv)
                if phase:
                    own.row(role, x)
                elif x is not None:
                    own.flag(turn, role[:1], x, digest)
            if results:
                yield send(results)
        if own is not None:
            yield send([own.result()])

    return mapped(dealt, run, REPAIRED)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` as a faulty front end would have kept them, by a checksum of conversation and turn; lost rows have ``gone``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    own = own.withColumn("fate", F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20)
    fate = F.col("fate")
    changed = F.when(fate == 1, "").when(fate == 2, F.regexp_replace("text", STOPS, "")).otherwise(F.col("text"))
    own = own.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), (fate == 0).alias("gone"), F.array_repeat(F.lit(0), F.when(fate == 3, 2).otherwise(1)).alias("copies"))
    return own.withColumn("copy", F.explode("copies")).drop("copy", "copies")


def op11_repair(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(read(spark, sf_dir, "conversations"))).drop("n_rows")
