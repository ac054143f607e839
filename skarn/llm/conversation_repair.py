"""Conversation structure repair: the cheapest edits that give role initials (s?(ua)+)?.

Four grammar states: nothing yet, after the system's message, after a user's, after an assistant's; the first and the last
may end. A forward Viterbi pass over a conversation's messages carries for each state the least (cost, audit),
where the audit is a letter for each edit: Keep 0, Rerole 1, Delete 2, Insert 5; a cut message that stays adds 5. Each layer is
closed with at most two inserts, more never pay. A state and a letter determine the new role, so an audit determines the repair.

The least audit of a layer begins the least audit of the whole: of two audits of one state, layer and cost none begins the
other, as letters and messages fix the cost and more inserts cost more. So (min, concatenation) is a semiring, and the pass
over a stretch of messages is a 4 x 4 matrix over it that does not depend on what is around it.

Rows are collapsed to distinct messages of a turn, dealt by ranges of (conversation, turn, digest) and sorted, so a
conversation of any length lies in neighbouring partitions. A task repairs the conversations that lie within its partition. Those at
its ends, and those beyond BLOCK messages, give a matrix for the partition and their messages in blocks; the
matrices of a conversation are multiplied, and its blocks are read in order along the audit. Only the hash needs them all in one
task, as SHA-256 has no other way; it holds one batch at a time.

Defined results: null roles and texts are one space; messages of one turn go by the SHA-256 of length of role, role and
text; null turns come first; a null id is a conversation; an empty role has no initial and cannot be kept; numbers
beyond 64 bits are shown as the largest long; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import deque
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.llm.common import Scratch, small_batches

BLOCK, BLOCK_BYTES = 1024, 4 << 20
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: Where an initial leads from each state; the role that a rerole or an insert gives there.
NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
GIVEN = ["user", "user", "assistant", "user"]
LEADS = [2, 2, 3, 2]
ENDS = (0, 3)
LEGAL = {"su", "ua", "au"}
WHITE = " \t\n\x0b\f\r"
_MOST = (1 << 63) - 1
Vector = list  # of (cost, audit) or None by state

_COUNTS = ["present", "first_turn", "last_turn", "turns", "first_role", "last_role", "blank", "duplicate", "truncated", "illegal"]
_STATS = T.StructType([T.StructField(c, T.StringType() if c.endswith("role") else T.LongType()) for c in _COUNTS])
_MATRIX = T.ArrayType(T.StructType([T.StructField(c, T.StringType() if c == "audit" else T.LongType()) for c in ("start", "end", "cost", "audit")]))
_LINES = T.ArrayType(T.StructType([T.StructField(c, T.StringType() if c in ("role", "text") else T.LongType()) for c in ("role", "text", "fault", "n")]))
_RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


# --- the pass over messages ---------------------------------------------------------------------


def closed(v: Vector) -> Vector:
    """With up to two inserts behind each state."""
    out, last = list(v), v
    for _ in range(2):
        now: Vector = [None] * 4
        for s, x in enumerate(last):
            if x is not None:
                y, t = (x[0] + INSERT, x[1] + "I"), LEADS[s]
                now[t] = y if now[t] is None else min(now[t], y)
        out = [b if a is None else a if b is None else min(a, b) for a, b in zip(out, now)]
        last = now
    return out


def step(v: Vector, initial: str, fault: int, n: int) -> Vector:
    """The next layer: n messages alike, of which all but the first are duplicates."""
    v = closed(v)
    if fault in (BLANK, DUPLICATE):
        return [x and (x[0] + DELETE * n, x[1] + "D" * n) for x in v]
    out: Vector = [x and (x[0] + DELETE, x[1] + "D") for x in v]
    extra = CUT if fault == TRUNCATED else 0
    for s, x in enumerate(v):
        if x is None:
            continue
        moves = [(LEADS[s], REROLE, "R")]
        if initial in NEXT[s]:
            moves.append((NEXT[s][initial], KEEP, "K"))
        for t, cost, letter in moves:
            y = (x[0] + cost + extra, x[1] + letter)
            out[t] = y if out[t] is None else min(out[t], y)
    return [x and (x[0] + DELETE * (n - 1), x[1] + "D" * (n - 1)) for x in out] if n > 1 else out


def matrix(lines: list[tuple]) -> list[Vector]:
    """From each state, over the messages (role, text, fault, n)."""
    out = []
    for s in range(4):
        v: Vector = [None] * 4
        v[s] = (0, "")
        for role, _, fault, n in lines:
            v = step(v, role[:1], fault, n)
        out.append(v)
    return out


def product(a: list[Vector], b: list[Vector]) -> list[Vector]:
    out = []
    for row in a:
        v: Vector = [None] * 4
        for x, onward in zip(row, b):
            for t, y in enumerate(onward):
                if x is not None and y is not None and (v[t] is None or x[0] + y[0] <= v[t][0]):
                    z = (x[0] + y[0], x[1] + y[1])
                    v[t] = z if v[t] is None else min(v[t], z)
        out.append(v)
    return out


def total(parts: list[list[Vector]]) -> list[Vector]:
    """The product of all, neighbours first, so that no audit is copied more often than the logarithm of their number."""
    while len(parts) > 1:
        parts = [product(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def best(v: Vector) -> tuple[int, str]:
    v = closed(v)
    return min(v[s] for s in ENDS if v[s] is not None)


class Walk:
    """Follows an audit through the messages and gives the repaired ones."""

    def __init__(self):
        self.state, self.edits = 0, deque()

    def inserts(self):
        while self.edits and self.edits[0] == "I":
            self.edits.popleft()
            role, self.state = GIVEN[self.state], LEADS[self.state]
            yield role, ""

    def over(self, lines: list[tuple]):
        for role, text, _, n in lines:
            for _ in range(n):
                yield from self.inserts()
                edit = self.edits.popleft()
                if edit == "D":
                    continue
                if edit == "R":
                    role, self.state = GIVEN[self.state], LEADS[self.state]
                else:
                    self.state = NEXT[self.state][role[:1]]
                yield role, text


class Fixed:
    """The hash of repaired messages as they come."""

    def __init__(self):
        self.hash, self.any = hashlib.sha256(), False

    def add(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) * self.any}{role}:{text}".encode())
        self.any = True


class Stats:
    """Counts over messages in order; those of neighbouring stretches can be joined."""

    def __init__(self, values: dict | None = None):
        self.__dict__.update(values or dict.fromkeys(_COUNTS, 0) | dict.fromkeys(["first_turn", "last_turn", "first_role", "last_role"]))

    def add(self, turn: int | None, role: str, fault: int, n: int) -> None:
        if self.present:
            self.illegal += self.last_role + role not in LEGAL
        else:
            self.first_role = role
        self.last_role, self.present = role, self.present + n
        self.illegal += n - 1
        if turn is not None:
            self.turns += self.last_turn != turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if fault == BLANK:
            self.blank += n
        elif fault == DUPLICATE:
            self.duplicate += n
        else:
            self.duplicate += n - 1
            self.truncated += fault == TRUNCATED

    def join(self, o: Stats) -> None:
        """o comes behind."""
        if self.present and o.present:
            self.illegal += self.last_role + o.first_role not in LEGAL
        self.turns += o.turns - (o.turns > 0 and self.last_turn == o.first_turn)
        self.first_role = self.first_role if self.present else o.first_role
        self.last_role = o.last_role if o.present else self.last_role
        self.first_turn = o.first_turn if self.first_turn is None else self.first_turn
        self.last_turn = self.last_turn if o.last_turn is None else o.last_turn
        for c in ("present", "blank", "duplicate", "truncated", "illegal"):
            setattr(self, c, getattr(self, c) + getattr(o, c))

    def result(self) -> dict:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return {"gaps": min(gaps, _MOST)} | {c: getattr(self, c) for c in ("blank", "duplicate", "truncated", "illegal")}


# --- partitions ---------------------------------------------------------------------------------


class _Run:
    """What a partition holds of one conversation."""

    def __init__(self, conv_id, first: bool):
        self.conv_id, self.first = conv_id, first
        self.lines, self.size, self.count, self.blocks, self.matrices, self.stats = [], 0, 0, 0, [], Stats()

    def cut(self) -> list[tuple]:
        lines, self.lines, self.size, self.count = self.lines, [], 0, 0
        self.matrices.append(matrix(lines))
        self.blocks += 1
        return lines


def _blocks(batches, schema: pa.Schema, texts: bool):
    """Sorted rows of a partition to rows of kind done, part (a matrix) and text (a block of messages)."""
    out: list[dict] = []
    run = None

    def block(r: _Run) -> None:
        no = r.blocks
        lines = r.cut()
        if lines:
            out.append({"kind": "text", "conv_id": r.conv_id, "part": part, "no": no, "lines": [dict(zip(("role", "text", "fault", "n"), x)) for x in lines]})

    def close(r: _Run, last: bool) -> None:
        if r.first or last or r.blocks:
            block(r)
            entries = [{"start": s, "end": t, "cost": x[0], "audit": x[1]} for s, v in enumerate(total(r.matrices)) for t, x in enumerate(v) if x]
            out.append({"kind": "part", "conv_id": r.conv_id, "part": part, "no": -1, "stats": {c: getattr(r.stats, c) for c in _COUNTS}, "matrix": entries})
            return
        v: Vector = [(0, ""), None, None, None]
        for role, _, fault, n in r.lines:
            v = step(v, role[:1], fault, n)
        cost, audit = best(v)
        walk, fixed = Walk(), Fixed()
        walk.edits.extend(audit)
        repaired = [*walk.over(r.lines), *walk.inserts()]
        for x in repaired:
            fixed.add(*x)
        row = {"kind": "done", "conv_id": r.conv_id, "part": part, "no": 0, **r.stats.result(), "cost": cost, "audit": audit, "repaired_sha256": fixed.hash.hexdigest()}
        out.append(row | {"lines": [{"role": role, "text": text} for role, text in repaired]} if texts else row)

    part = 0
    for b in batches:
        part = b.column("part")[0].as_py() if b.num_rows else part
        for conv_id, turn, role, text, gone, fault, n in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "fault", "n"))):
            if run is None or run.conv_id != conv_id:
                if run is not None:
                    close(run, False)
                run = _Run(conv_id, run is None)
            if gone:
                continue
            run.stats.add(turn, role[:1], fault, n)
            while n:  # a block holds so many copies at most
                some = min(n, BLOCK - run.count)
                run.lines.append((role, text, fault, some))
                run.size, run.count, n = run.size + len(text), run.count + some, n - some
                fault = DUPLICATE if fault != BLANK else BLANK
                if run.count >= BLOCK or run.size > BLOCK_BYTES:
                    block(run)
        yield pa.RecordBatch.from_pylist(out, schema)
        out.clear()
    if run is not None:
        close(run, True)
        yield pa.RecordBatch.from_pylist(out, schema)


def _multiplied(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """All partitions of one conversation to its result, and to each partition's piece of the audit."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    stats, parts = Stats(), []
    for r in rows:
        stats.join(Stats(r["stats"]))
        m: list[Vector] = [[None] * 4 for _ in range(4)]
        for x in r["matrix"]:
            m[x["start"]][x["end"]] = (x["cost"], x["audit"])
        parts.append(m)
    cost, audit = best(total(parts)[0])
    out, at = [], 0
    for k, r in enumerate(rows):
        end, left = at, r["stats"]["present"]
        while left:
            left -= audit[end] != "I"
            end += 1
        end = len(audit) if k + 1 == len(rows) else end
        out.append({"conv_id": r["conv_id"], "part": r["part"], "no": -1, "piece": audit[at:end]})
        at = end
    out[0] |= {**stats.result(), "cost": cost, "audit": audit}
    return pa.Table.from_pylist(out, schema)


def _walked(batches, schema: pa.Schema, texts: bool):
    """Pieces of audits and blocks of messages, in order, to results (or to repaired messages)."""
    row = walk = fixed = None
    part = 0

    def ended():
        repaired = list(walk.inserts())
        for x in repaired:
            fixed.add(*x)
        out = row | {"repaired_sha256": fixed.hash.hexdigest(), "part": part, "no": _MOST}
        return out | {"lines": [dict(zip(("role", "text"), x)) for x in repaired]} if texts else out

    for b in batches:
        out = []
        for r in b.to_pylist():
            if r["audit"] is not None:
                if row is not None:
                    out.append(ended())
                row, walk, fixed = r, Walk(), Fixed()
            part = r["part"]
            if r["no"] < 0:
                walk.edits.extend(r["piece"])
                continue
            repaired = []
            for x in walk.over([(x["role"], x["text"], x["fault"], x["n"]) for x in r["lines"]]):
                fixed.add(*x)
                if texts:
                    repaired.append(dict(zip(("role", "text"), x)))
            if texts:
                out.append({"conv_id": r["conv_id"], "part": r["part"], "no": r["no"], "lines": repaired})
        yield pa.RecordBatch.from_pylist(out, schema)
    if row is not None:
        yield pa.RecordBatch.from_pylist([ended()], schema)


# --- the operator -------------------------------------------------------------------------------


def _arrow(kind: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)


def spaced(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """A drill: by crc32 of `conv_id:turn` modulo 20 a row is lost, emptied, stripped of its stops, repeated, or made the user's.

    conv_id, turn, role, text, n (how often), gone (lost, so that its conversation is still known).
    """
    code = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    role = F.when(code == 0, "").when(code == 4, "user").otherwise(spaced("role"))
    text = F.when(code <= 1, "").when(code == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    n = F.when(code == 3, 2).otherwise(1).cast("long")
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), n.alias("n"), (code == 0).alias("gone"))


def whole(conversations: DataFrame) -> DataFrame:
    """The rows as they are, for repair."""
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("gone"))


def _sorted(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct messages of each turn with their fault, dealt by ranges of their place."""
    alike = rows.groupBy("conv_id", "turn", "gone", "role", "text").agg(F.sum("n").alias("n"))
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    alike = scratch.write(alike.withColumn("digest", digest), "messages")
    # Only messages of several turns matter here, so the other side of the join is small as a rule.
    again = alike.where("not gone").groupBy("conv_id", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("c")).where("c > 1")
    again = again.select(F.col("conv_id").alias("other"), F.col("digest").alias("same"), "first")
    bare = F.rtrim("text", F.lit(WHITE))
    fault = F.when(bare == "", BLANK).when(F.struct("turn") > F.col("first"), DUPLICATE).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    marked = alike.join(again, F.col("conv_id").eqNullSafe(F.col("other")) & (F.col("digest") == F.col("same")), "left").withColumn("fault", fault)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "digest")]
    dealt = marked.drop("other", "same", "first").repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.withColumn("part", F.spark_partition_id())


def repair(rows: DataFrame, texts: bool = False) -> DataFrame:
    """rows as of whole() or damaged(). Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    With texts, the repaired messages instead, in blocks: conv_id, part, no (both in order), lines (an array of role, text).
    """
    small_batches(rows.sparkSession)
    scratch = Scratch(rows.sparkSession, "repair")
    conv = T.StructField("conv_id", rows.schema["conv_id"].dataType)
    place = [conv, T.StructField("part", T.IntegerType()), T.StructField("no", T.LongType())]
    result = [T.StructField(c, T.StringType() if c in ("audit", "repaired_sha256") else T.LongType()) for c in _RESULT]
    lines = T.StructField("lines", _LINES)
    kinds = T.StructType([T.StructField("kind", T.StringType()), *place, *result, lines, T.StructField("stats", _STATS), T.StructField("matrix", _MATRIX)])
    made = scratch.write(_sorted(rows, scratch).mapInArrow(partial(_blocks, schema=_arrow(kinds), texts=texts), kinds), "blocks")
    scratch.drop("messages")
    pieces = T.StructType([*place, *result[:-1], T.StructField("piece", T.StringType())])
    shown = _arrow(pieces)
    cut = made.where("kind = 'part'").select("conv_id", "part", "stats", "matrix").groupBy("conv_id").applyInArrow(lambda t: _multiplied(t, shown), pieces)
    both = cut.unionByName(made.where("kind = 'text'").select("conv_id", "part", "no", "lines"), allowMissingColumns=True)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "part", "no")]
    kinds = T.StructType([*place, *result, lines])
    walked = both.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(partial(_walked, schema=_arrow(kinds), texts=texts), kinds)
    every = made.where("kind = 'done'").select(kinds.names).union(walked)
    if texts:
        return every.select("conv_id", "part", "no", F.transform("lines", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("lines"))
    return every.where("audit is not null").select("conv_id", *_RESULT)
