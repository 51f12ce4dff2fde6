"""Structure repair of conversations by a scan of min-plus matrices.

Allowed are conversations whose roles begin ``s?`` (system) and go on ``(ua)+`` (user,
assistant), and empty ones. Four states tell what may come next: nothing yet, after the system
turn, after a user, after an assistant. A turn becomes a 4x4 matrix: from each state to each,
the cheapest way to take the turn, with turns inserted before it. Its elements are pairs of a
cost and an audit, the letters of the edits; sums are least by cost and then by the letters,
products add costs and join letters. Both laws of a semiring hold for what occurs here: two
audits of the same turns between the same states and of the same cost are never such that one
begins the other, as the letters alone tell the state they lead to and a loop of insertions
costs something. So matrices may be multiplied in any grouping.

Spark cuts the turns, in order, into ranges that ignore where conversations end. A task
multiplies the matrices of its turns as a balanced tree and finishes the conversations that
lie within its range; the first and the last one may go on in other tasks, and their products
are multiplied in rounds of ``FAN`` neighbours. Only numbers, initials and digests of turns go
this way. The texts are dealt once, by conversation, and meet the audit in a sorted stream.

Turns seen before are told without a join: the least place of each distinct role and text is
found by a grouped minimum and sorted in front of the turns that have it.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagekit.llm.common import small_batches, stored

#: Ranges whose products of one conversation are multiplied in one task and round.
FAN = 64
#: Turns whose product a worker remembers, and how many such products.
SHORT, MEMO = 8, 1 << 16

# Edits by their letters and costs, and the roles by their initials.
KEEP, REROLE, DELETE, INSERT = ("K", 0), ("R", 2), ("D", 3), ("I", 2)
TRUNCATED = 1
USER, ASSISTANT = "user", "assistant"
ENDS, WHITE = ".!?", " \t\n\x0b\x0c\r"

#: Moves between the states: nothing yet, after system, after user, after assistant.
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

Element = tuple[int, str]
Matrix = tuple[Element | None, ...]


def times(left: Matrix, right: Matrix) -> Matrix:
    out: list[Element | None] = [None] * 16
    for i in range(4):
        for k in range(4):
            a = left[4 * i + k]
            if a is None:
                continue
            for j in range(4):
                b = right[4 * k + j]
                if b is not None:
                    cost, at = a[0] + b[0], 4 * i + j
                    if out[at] is None or cost < out[at][0] or cost == out[at][0] and a[1] + b[1] < out[at][1]:
                        out[at] = (cost, a[1] + b[1])
    return tuple(out)


def _matrix(moves: dict[tuple[int, int], Element]) -> Matrix:
    return tuple(moves.get((i, j)) for i in range(4) for j in range(4))


ONE = _matrix({(i, i): (0, "") for i in range(4)})


def _closure() -> Matrix:
    """Any number of insertions; more than one a role only costs more."""
    one = _matrix({(i, j): (INSERT[1], INSERT[0]) for role in "ua" for i, j in NEXT[role].items()})
    either = tuple(min(filter(None, pair), default=None) for pair in zip(ONE, one, strict=True))
    return times(either, times(either, either))


CLOSURE = _closure()


@lru_cache(maxsize=None)
def turn(code: str) -> Matrix:
    """A turn's matrix. ``x``: it must go; else its initial, ``o`` for other ones, in upper
    case if the turn is truncated."""
    moves = {(i, i): (DELETE[1], DELETE[0]) for i in range(4)}
    if code != "x":
        more = TRUNCATED if code.isupper() else 0
        for role in "ua":
            moves |= {(i, j): (REROLE[1] + more, REROLE[0]) for i, j in NEXT[role].items()}
        moves |= {(i, j): (KEEP[1] + more, KEEP[0]) for i, j in NEXT.get(code.lower(), {}).items()}
    return times(CLOSURE, _matrix(moves))


def product(codes: str) -> Matrix:
    """The product of the turns' matrices, as a balanced tree."""
    return _short(codes) if len(codes) <= SHORT else times(product(codes[: len(codes) // 2]), product(codes[len(codes) // 2 :]))


@lru_cache(maxsize=MEMO)
def _short(codes: str) -> Matrix:
    if len(codes) < 2:
        return turn(codes) if codes else ONE
    return times(_short(codes[: len(codes) // 2]), _short(codes[len(codes) // 2 :]))


def cheapest(m: Matrix) -> Element:
    """The cheapest edits from nothing to nothing or to an assistant's turn."""
    whole = times(m, CLOSURE)
    return min(e for e in (whole[0], whole[3]) if e)


class Stretch:
    """Turns of one conversation that follow each other: what can be joined to the next ones."""

    __slots__ = ("rows", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "first", "last", "codes", "matrix")

    def __init__(self):
        self.rows = self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.first = self.last = None
        self.codes, self.matrix = [], ONE

    def add(self, turn_no: int | None, initial: str, kind: str, n: int, new: bool) -> None:
        """``n`` equal turns; ``kind`` B blank, T truncated, F fine; ``new``: the first of them
        has not been seen before."""
        if turn_no is not None and turn_no != self.high:
            self.low, self.high = turn_no if self.low is None else self.low, turn_no
            self.turns += 1
        self.illegal += (n - 1) + (self.last is not None and self.last + initial not in ("su", "ua", "au"))
        self.first, self.last = initial if self.first is None else self.first, initial
        self.rows += n
        if kind == "B":
            self.blank += n
        else:
            self.duplicate += n - new
            self.truncated += new and kind == "T"
        if new:
            code = initial if initial in ("s", "u", "a") else "o"
            self.codes.append((code.upper() if kind == "T" else code) + "x" * (n - 1))
        else:
            self.codes.append("x" * n)

    def close(self) -> Stretch:
        self.matrix = times(self.matrix, product("".join(self.codes)))
        self.codes = []
        return self

    def join(self, other: Stretch) -> None:
        """Goes on with a closed stretch."""
        if not other.rows:
            return
        self.turns += other.turns - (self.high is not None and self.high == other.low)
        self.low = other.low if self.low is None else self.low
        self.high = self.high if other.high is None else other.high
        for count in ("rows", "blank", "duplicate", "truncated", "illegal"):
            setattr(self, count, getattr(self, count) + getattr(other, count))
        self.illegal += self.last is not None and self.last + other.first not in ("su", "ua", "au")
        self.first, self.last = other.first if self.first is None else self.first, other.last
        self.matrix = times(self.matrix, other.matrix)

    @staticmethod
    def of(row: dict) -> Stretch:
        out = Stretch()
        for c in ("rows", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "first", "last"):
            setattr(out, c, row[c])
        out.matrix = tuple(None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"], strict=True))
        return out

    def row(self, conv, part: int, whole: bool) -> dict:
        cost, audit = cheapest(self.matrix) if whole else (None, None)
        counts = {c: getattr(self, c) for c in ("rows", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "first", "last")}
        costs, audits = ([], []) if whole else ([e and e[0] for e in self.matrix], [e and e[1] for e in self.matrix])
        return {"conv_id": conv, "part": part, "whole": whole, **counts, "cost": cost, "audit": audit, "costs": costs, "audits": audits}


_STRETCH = (
    "part int, whole boolean, rows bigint, low bigint, high bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, "
    "illegal bigint, first string, last string, cost bigint, audit string, costs array<bigint>, audits array<string>"
)


def _schema(conv_type: pa.DataType) -> pa.Schema:
    n, s = pa.int64(), pa.string()
    kinds = [conv_type, pa.int32(), pa.bool_(), n, n, n, n, n, n, n, n, s, s, n, s, pa.list_(n), pa.list_(s)]
    names = ["conv_id", *(c.split()[0] for c in _STRETCH.split(", "))]
    return pa.schema(list(zip(names, kinds, strict=True)))


def damage(rows: DataFrame, conv: str = "conv_id", turn_col: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turn, role, text, gone)``: the table as a careless export leaves it.

    The crc32 of ``conv:turn`` by 20 decides: 0 drops the row (it stays as ``gone``, so that no
    conversation is forgotten), 1 empties the text, 2 removes its ``.!?``, 3 repeats it, 4
    makes it the user's. A null is a blank in that key, as a role and as a text.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), space))
    fate, said = F.crc32(key) % 20, F.coalesce(text, space)
    changed = F.when(fate == 1, F.lit("")).when(fate == 2, F.translate(said, ENDS, "")).otherwise(said)
    return rows.select(
        F.col(conv).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.when(fate == 4, F.lit(USER)).otherwise(F.coalesce(role, space)).alias("role"),
        changed.alias("text"), (fate == 0).alias("gone"), F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _digest():
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))


def _places(rows: DataFrame) -> DataFrame:
    """Turns in order with what matters of them, in ranges; equal ones as one row."""
    spoken = F.rtrim("text", F.lit(WHITE))
    kind = F.when(F.col("gone"), "G").when(spoken == "", "B").when(F.instr(F.lit(ENDS), F.right(spoken, F.lit(1))) > 0, "F").otherwise("T")
    gone = F.col("gone")
    narrow = rows.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(~gone, _digest()).alias("digest"), kind.alias("kind"), F.when(~gone, F.left("role", F.lit(1))).alias("initial")
    )
    turns = narrow.groupBy("conv_id", "turn", "digest").agg(F.first("kind").alias("kind"), F.first("initial").alias("initial"), F.count("*").alias("n"))
    least = F.when(~F.bool_or(F.col("turn").isNull()), F.min("turn"))
    first = turns.where("kind IN ('T', 'F')").groupBy("conv_id", "digest").agg(least.alias("turn"))
    both = turns.unionByName(first.select("conv_id", "turn", "digest", F.lit("N").alias("kind"), F.lit("").alias("initial"), F.lit(0).cast("bigint").alias("n")))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc_nulls_first("digest")]
    return both.repartitionByRange(*order).sortWithinPartitions(*order, "n").select("conv_id", F.spark_partition_id().alias("part"), "turn", "digest", "kind", "initial", "n")


def _stretches(batches):
    """From a range of turns in order to a row per conversation: finished, or its product."""
    held, conv, at, is_first, new, schema, out = None, None, None, True, None, None, []
    for batch in batches:
        schema = schema or _schema(batch.schema.field("conv_id").type)
        for c, part, no, digest, kind, initial, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if held is None or c != conv:
                if held is not None:
                    out.append(held.close().row(conv, at, not is_first))
                    is_first = False
                held, conv, at, new = Stretch(), c, part, None
            if kind == "N":
                new = (no, digest)
            elif kind != "G":
                held.add(no, initial, kind, n, kind != "B" and new == (no, digest))
            if len(held.codes) >= 1 << 16:
                held.close()
        if len(out) >= 1024:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if held is not None:
        out.append(held.close().row(conv, at, False))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _joined(whole: bool):
    """Joins the stretches of a conversation (``whole``) or of one part of it that come one
    after the other."""

    def run(batches):
        held, key, schema, out = None, None, None, []
        for batch in batches:
            schema = schema or _schema(batch.schema.field("conv_id").type)
            for row in batch.select(schema.names).to_pylist():
                now = (row["conv_id"], None if whole else row["part"])
                if held is None or now != key:
                    if held is not None:
                        out.append(held.row(key[0], key[1], whole))
                    held, key = Stretch(), now
                held.join(Stretch.of(row))
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if held is not None:
            out.append(held.row(key[0], key[1], whole))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def edits(rows: DataFrame, fan: int = FAN) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` per conversation.

    ``rows`` as `damage` returns them. A turn's first fault counts: blank, duplicate (role and
    text seen earlier in the conversation), truncated (its last character that is no white
    space is none of ``.!?``). Turns follow each other by number, nulls first; those of one
    number by the MD5 of role and text, equal ones side by side. ``gaps``: numbers between the
    least and the greatest that no turn has. ``illegal``: neighbours whose initials are none of
    su, ua, au. Conversations without a row have zeros and an empty audit; a null is a
    conversation of its own; an empty table gives no row.
    """
    small_batches(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {_STRETCH}"
    stretches = stored(_places(rows).mapInArrow(_stretches, schema))
    open_, done = stretches.where("NOT whole"), stretches.where("whole")
    top = open_.agg(F.max("part").alias("top")).first()["top"] or 0
    while top >= fan:
        open_ = open_.withColumn("bucket", F.floor(F.col("part") / fan).cast("int")).repartition("conv_id", "bucket").sortWithinPartitions("conv_id", "bucket", "part")
        open_ = open_.withColumn("part", F.col("bucket")).drop("bucket").mapInArrow(_joined(False), schema)
        top //= fan
    last = open_.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_joined(True), schema)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    return done.unionByName(last).select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit")


FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _met(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's edits and then its turns in order, in one partition."""
    turns = rows.where(~F.col("gone")).select("conv_id", F.lit(1).alias("kind"), "turn", _digest().alias("digest"), "role", "text")
    both = found.withColumn("kind", F.lit(0)).unionByName(turns, allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "digest")
    return dealt.select("conv_id", "kind", "role", "text", *FACTS)


def _walk(batches):
    """Tells, in order, each conversation's facts and then its repaired turns ``(position,
    edit, role, text)``. Holds an audit and a batch."""
    audit, at, position, odd = "", 0, 0, 0

    def insertions():
        nonlocal at, position
        while at < len(audit) and audit[at] == INSERT[0]:
            yield None, (position, INSERT[0], ASSISTANT if (position - odd) % 2 else USER, "")
            at, position = at + 1, position + 1

    for batch in batches:
        conv, kind, role, text = (batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text"))
        for i in range(batch.num_rows):
            if kind[i] == 0:
                facts = [batch.column(c)[i].as_py() for c in FACTS]
                audit, at, position = facts[-1], 0, 0
                odd = (len(audit) - audit.count(DELETE[0])) % 2
                yield (conv[i], facts), None
                yield from insertions()
            else:
                edit = audit[at]
                at += 1
                if edit != DELETE[0]:
                    new = ASSISTANT if (position - odd) % 2 else USER
                    yield None, (position, edit, role[i] if edit == KEEP[0] else new, text[i])
                    position += 1
                yield from insertions()


def repair(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``(conv_id, position, edit, role, text)``: the repaired turns; ``found`` as `edits`
    gives them. Inserted turns have an empty text; nothing of a conversation that lost all."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        conv, out, schema = None, [], None

        def taken():
            nonlocal schema
            for batch in batches:
                schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
                yield batch

        held = 0
        for facts, one in _walk(taken()):
            if facts:
                conv = facts[0]
                continue
            out.append((conv, *one))
            held += len(one[3])
            if len(out) >= 1024 or held >= 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    small_batches(rows.sparkSession)
    return _met(rows, found).mapInArrow(run, f"conv_id {kind}, position bigint, edit string, role string, text string")


def digests(rows: DataFrame, fan: int = FAN) -> DataFrame:
    """What `edits` finds, with the SHA-256 of the repaired turns as lines ``role:text``.

    Digests are carried along the stream of repaired turns, so a conversation of any length is
    one task's but never in memory.
    """
    found = edits(rows, fan)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        schema, now, sha, empty, out = None, None, None, True, []

        def taken():
            nonlocal schema
            for batch in batches:
                schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), *((c, pa.int64()) for c in FACTS[:-1]), ("audit", pa.string()), ("repaired_sha256", pa.string())])
                yield batch

        def done():
            out.append((now[0], *now[1], sha.hexdigest()))

        for facts, one in _walk(taken()):
            if facts:
                if now:
                    done()
                now, sha, empty = facts, hashlib.sha256(), True
                if len(out) >= 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                    out = []
            else:
                sha.update(("" if empty else "\n").encode() + f"{one[2]}:{one[3]}".encode("utf-8", "replace"))
                empty = False
        if now:
            done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    small_batches(rows.sparkSession)
    counts = ", ".join(f"{c} bigint" for c in FACTS[:-1])
    return _met(rows, found).mapInArrow(run, f"conv_id {kind}, {counts}, audit string, repaired_sha256 string")
