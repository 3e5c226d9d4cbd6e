"""Repair of conversations: the cheapest edits that leave turns in order, and an audit string of them.

Rows are dealt out by range of (conversation, turn) and cut into slices. A slice is solved from every state it can be
entered in; its audits are nodes that share their beginnings. The slices of a conversation are then chained in order,
and texts are hashed as soon as the edits before them are settled, so no conversation is held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from netlens.llm.common import discard, stash

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: Where a repaired conversation stands: nothing yet, after the system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = {"su", "ua", "au"}
_BLANKS = " \t\n\x0b\x0c\r"


def damage(turns: DataFrame) -> DataFrame:
    """``conversations`` with faults by crc32(conv_id:turn) % 20; nulls are read as one space, but for conv_id and turn themselves."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    rows = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


# --- edits as linked nodes ----------------------------------------------------------

_BASE, _PRIME = 1_000_003, (1 << 61) - 1


class Edits:
    """Strings of edit letters as a tree: a node is its parent's string and a letter.

    ``up[v][k]`` is the ancestor 2^k letters shorter, ``code[v]`` a rolling hash of the whole string.
    """

    def __init__(self, base: int = _BASE, prime: int = _PRIME):
        self.base, self.prime = base, prime
        self.up: list[list[int]] = [[]]
        self.letter, self.size, self.code = [""], [0], [0]

    def add(self, node: int, letter: str) -> int:
        new = len(self.up)
        jumps, k = [node], 0
        while k < len(self.up[jumps[k]]):
            jumps.append(self.up[jumps[k]][k])
            k += 1
        self.up.append(jumps)
        self.letter.append(letter)
        self.size.append(self.size[node] + 1)
        self.code.append((self.code[node] * self.base + ord(letter)) % self.prime)
        return new

    def cut(self, node: int, size: int) -> int:
        """The first ``size`` letters of a node."""
        while (more := self.size[node] - size) > 0:
            node = self.up[node][more.bit_length() - 1]
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def same(self, a: int, b: int) -> bool:
        """Whether two nodes of one length are equal letter by letter, as far as they do not share nodes."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Order of the strings: the letters after their longest common prefix, found by halving jumps over equal hashes."""
        if a == b:
            return False
        size = min(self.size[a], self.size[b])
        x, y = self.cut(a, size), self.cut(b, size)
        if self.code[x] == self.code[y]:
            if self.same(x, y):
                return self.size[a] < self.size[b]
            return self.text(a) < self.text(b)  # equal hashes of different strings
        p, q = x, y
        for k in reversed(range(len(self.up[x]))):
            if k < len(self.up[p]) and self.code[self.up[p][k]] != self.code[self.up[q][k]]:
                p, q = self.up[p][k], self.up[q][k]
        if not self.same(self.up[p][0], self.up[q][0]):
            return self.text(a) < self.text(b)
        return self.letter[p] < self.letter[q]


def _best(edits: Edits, chosen: dict[int, tuple[int, int]], to: int, cost: int, node: int, letter: str) -> None:
    """Keep the cheaper, of equal ones the lesser, way to a state."""
    old = chosen.get(to)
    if old is None or cost < old[0]:
        chosen[to] = (cost, edits.add(node, letter))
    elif cost == old[0]:
        new = edits.add(node, letter)
        if edits.less(new, old[1]):
            chosen[to] = (cost, new)


def _insert(edits: Edits, at: dict[int, tuple[int, int]]) -> None:
    """Turns put in before the next row, as long as that is better."""
    for state in (START, SYSTEM, ASSISTANT, USER, ASSISTANT):
        if state in at:
            _best(edits, at, _NEXT[state], at[state][0] + INSERT, at[state][1], "I")


def solve(initials: list[str], faults: list[str], enter: int, edits: Edits | None = None) -> dict[int, tuple[int, str]]:
    """state after the rows -> (cost, audit) of the cheapest, then least, edits of rows entered in a state."""
    edits = edits or Edits()
    at = {enter: (0, 0)}
    for initial, fault in zip(initials, faults):
        _insert(edits, at)
        after: dict[int, tuple[int, int]] = {}
        for state, (cost, node) in at.items():
            _best(edits, after, state, cost + DELETE, node, "D")
            if fault in ("blank", "duplicate"):
                continue
            more = cost + (CUT if fault == "truncated" else 0)
            to = _NEXT[state]
            if initial == "ua"[to == ASSISTANT]:
                _best(edits, after, to, more + KEEP, node, "K")
            elif initial == "s" and state == START:
                _best(edits, after, SYSTEM, more + KEEP, node, "K")
            _best(edits, after, to, more + REROLE, node, "R")
        at = after
    _insert(edits, at)
    return {s: (c, edits.text(v)) for s, (c, v) in at.items()}


def apply_edits(audit: str, state: int, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each turn that the edits leave."""
    row = 0
    for letter in audit:
        if letter != "D":
            system = letter == "K" and roles[row][:1] == "s"
            to = SYSTEM if system else _NEXT[state]
            yield letter, roles[row] if letter == "K" else _ROLE[to], "" if letter == "I" else texts[row]
            state = to
        row += letter != "I"


# --- slices -------------------------------------------------------------------------

_SLICE = "none boolean, conv long, part int, no int, roles array<string>, texts array<string>, ways array<struct<enter: int, leave: int, cost: long, audit: string>>"
_WAYS = pa.list_(pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_SLICE_TYPE = pa.schema([("none", pa.bool_()), ("conv", pa.int64()), ("part", pa.int32()), ("no", pa.int32()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("ways", _WAYS)])


def _slices(batches: Iterator[pa.RecordBatch], most: int, chars: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (none, conv, role, text, fault) as slices of one conversation with their ways from state to state."""
    part, no, key, size, begins = TaskContext.get().partitionId(), 0, None, 0, False
    rows: list[tuple[str, str, str]] = []
    out: list[tuple] = []

    def close() -> None:
        nonlocal no, size
        roles, texts, faults = map(list, zip(*rows))
        initials = [r[:1] for r in roles]
        ways = []
        # only the first conversation of a range can have begun in the one before it
        for enter in [START] if begins else [START, SYSTEM, USER, ASSISTANT]:
            ways += [{"enter": enter, "leave": s, "cost": c, "audit": a} for s, (c, a) in solve(initials, faults, enter).items()]
        out.append((*key, part, no, roles, texts, ways))
        no, size = no + 1, 0
        rows.clear()

    def results() -> pa.RecordBatch:
        cols = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SLICE_TYPE)], schema=_SLICE_TYPE)

    for batch in batches:
        for none, conv, role, text, fault in zip(*[c.to_pylist() for c in batch.columns]):
            if rows and ((none, conv) != key or len(rows) >= most or size + len(text) > chars):
                same = (none, conv) == key
                close()
                begins = not same
            elif not rows:
                begins = False
            key = (none, conv)
            rows.append((role, text, fault))
            size += len(text)
        if len(out) > 2_000:
            yield results()
    if rows:
        close()
    if out:
        yield results()


_AUDIT = "none boolean, conv long, illegal long, cost long, audit string, repaired_sha256 string"
_AUDIT_TYPE = pa.schema([("none", pa.bool_()), ("conv", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_TURNS = "none boolean, conv long, place long, edit string, role string, text string"
_TURNS_TYPE = pa.schema([("none", pa.bool_()), ("conv", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


class _Chain:
    """One conversation, slice by slice; rows are let go once all ways still open agree on the edits before."""

    def __init__(self, key: tuple):
        self.key, self.illegal, self.last = key, 0, None
        # state -> (cost, audit of the open slices, ((enter, audit), ...) of the open slices)
        self.open: dict[int, tuple[int, str, tuple]] = {START: (0, "", ())}
        self.held: list[tuple[list, list]] = []
        self.cost, self.audit, self.hash, self.place = 0, [], hashlib.sha256(), 0

    def take(self, roles: list[str], texts: list[str], ways: list[dict]) -> Iterator[tuple]:
        for role in roles:
            if self.last is not None:
                self.illegal += self.last + role[:1] not in _LEGAL
            self.last = role[:1]
        self.held.append((roles, texts))
        new: dict[int, tuple] = {}
        for w in ways:
            if w["enter"] in self.open:
                cost, audit, path = self.open[w["enter"]]
                way = (cost + w["cost"], audit + w["audit"], path + ((w["enter"], w["audit"]),))
                if w["leave"] not in new or way[:2] < new[w["leave"]][:2]:
                    new[w["leave"]] = way
        # after an assistant's turn all can follow that follows a system turn; a start only spares one deletion
        sure = new[ASSISTANT][0] if ASSISTANT in new else None
        if sure is not None:
            new = {s: w for s, w in new.items() if not (s == SYSTEM and w[0] > sure or s == START and w[0] > sure + DELETE)}
        self.open = new
        paths = [w[2] for w in new.values()]
        agreed = 0
        while agreed < len(self.held) and len({p[agreed] for p in paths}) == 1:
            agreed += 1
        yield from self.settle(agreed)

    def settle(self, slices: int) -> Iterator[tuple]:
        path = next(iter(self.open.values()))[2][:slices]
        for (enter, audit), (roles, texts) in zip(path, self.held):
            self.audit.append(audit)
            for edit, role, text in apply_edits(audit, enter, roles, texts):
                self.hash.update(f"{chr(10) * (self.place > 0)}{role}:{text}".encode())
                yield (*self.key, self.place, edit, role, text)
                self.place += 1
        del self.held[:slices]
        gone = sum(len(a) for _, a in path)
        self.open = {s: (c, a[gone:], p[slices:]) for s, (c, a, p) in self.open.items()}

    def end(self) -> Iterator[tuple]:
        state = min((s for s in self.open if s in (START, ASSISTANT)), key=lambda s: self.open[s][:2])
        self.open = {state: self.open[state]}
        self.cost = self.open[state][0]
        yield from self.settle(len(self.held))

    def result(self) -> tuple:
        return (*self.key, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def _chained(batches: Iterator[pa.RecordBatch], turns: bool) -> Iterator[pa.RecordBatch]:
    """The audits of sorted slices, or the repaired turns."""
    schema = _TURNS_TYPE if turns else _AUDIT_TYPE
    chain: _Chain | None = None
    out: list[tuple] = []

    def results() -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * len(schema)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    def collect(rows: Iterator[tuple]) -> None:
        for row in rows:
            if turns:
                out.append(row)

    def finish() -> None:
        collect(chain.end())
        if not turns:
            out.append(chain.result())

    for batch in batches:
        for at in range(batch.num_rows):  # a slice at a time: its texts are bounded
            none, conv, _, _, roles, texts, ways = (c[0].as_py() for c in batch.slice(at, 1).columns)
            if chain is None or chain.key != (none, conv):
                if chain is not None:
                    finish()
                chain = _Chain((none, conv))
            collect(chain.take(roles, texts, ways))
            if len(out) > 2_000:
                yield results()
    if chain is not None:
        finish()
    yield results()


# --- operators ----------------------------------------------------------------------

def faults(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(none, conv, turn, role, text, uid, same, fault): each row's first fault of blank, duplicate and truncated, else ''.

    Write nothing twice: the result is a table. ``none`` tells the rows without a conversation, which are one conversation.
    """
    plain = F.rtrim("text", F.lit(_BLANKS))
    rows = turns.select(
        F.col(conv_id).isNull().alias("none"), F.coalesce(F.col(conv_id).cast("long"), F.lit(0).cast("long")).alias("conv"), F.col(turn).cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(a) for c, a in ((role, "role"), (text, "text"))], F.monotonically_increasing_id().alias("uid"),
    )
    rows = rows.withColumn("same", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)))
    rows = stash(rows.withColumn("_end", F.right(plain, F.lit(1))))
    place, key = F.struct("turn", "uid"), ["none", "conv", "same"]
    first = rows.groupBy(*key).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    known = rows.join(first, key, "left")
    fault = F.when(F.col("_end") == "", "blank").when(place > F.col("_first"), "duplicate").when(F.col("_end").isin(".", "!", "?"), "").otherwise("truncated")
    out = stash(known.select(*rows.drop("_end").columns, fault.alias("fault")))
    discard(turns.sparkSession, rows)
    return out


def _sliced(rows: DataFrame, most: int, chars: int, per_task: int) -> DataFrame:
    # of equal turns the role comes first, then the beginning of the text, then its digest
    order = ["none", "conv", "turn", "role", F.substring("text", 1, 16), "same", "uid"]
    parts = max(-(-rows.count() // per_task), 1)
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("none", "conv", "role", "text", "fault")
    return dealt.mapInArrow(lambda it: _slices(it, most, chars), _SLICE)


def _ordered(slices: DataFrame) -> DataFrame:
    return slices.repartition("none", "conv").sortWithinPartitions("none", "conv", "part", "no")


def repair(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int = 256, chars: int = 4_000_000, per_task: int = 50_000,
) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    Turns come by number, nulls first; of equal numbers by role, then by the first 16 characters of the text, then by a digest.
    Edits are Keep, Rerole (3), Delete (4, required for blank and duplicate rows) and Insert (3) of a turn without text; a truncated
    row that stays costs 3 more. The role initials must come out as ``(s?(ua)+)?``. The audit has the cheapest edits' initials in
    order, of equal ones the least. ``repaired_sha256`` is that of the ``role:text`` lines left.

    Null roles and texts are one space; rows without a conversation are one conversation; repeated rows are duplicates of the
    first; an empty table gives an empty result; a text may be of any length; other columns are not read. A conversation's edits
    are solved slice by slice in many tasks; only the chaining and the hash, which is sequential, go through its rows in order.
    """
    rows = faults(turns, conv_id, turn, role, text)
    counts = rows.groupBy("none", "conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")],
    )
    audits = _ordered(_sliced(rows, most, chars, per_task)).mapInArrow(lambda it: _chained(it, False), _AUDIT)
    out = counts.join(audits, ["none", "conv"])
    out = stash(out.select(F.when(~F.col("none"), F.col("conv")).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
    discard(turns.sparkSession, rows)
    return out


def repaired_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int = 256, chars: int = 4_000_000, per_task: int = 50_000) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns that :func:`repair` leaves, numbered from 0, with the edit that each had."""
    rows = faults(turns, conv_id, turn, role, text)
    out = _ordered(_sliced(rows, most, chars, per_task)).mapInArrow(lambda it: _chained(it, True), _TURNS)
    return out.select(F.when(~F.col("none"), F.col("conv")).alias("conv_id"), "place", "edit", "role", "text")


def repaired_after_damage(conversations: DataFrame) -> DataFrame:
    """:func:`repair` of the damaged conversations, with every original conv_id."""
    done = repair(damage(conversations))
    ids = conversations.select("conv_id").distinct()
    joined = ids.join(done.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    zero, none = F.lit(0).cast("long"), hashlib.sha256().hexdigest()
    figures = [F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *figures, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
