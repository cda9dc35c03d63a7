"""Conversation structure repair: the cheapest edits that make roles alternate, by an auction for shortest paths.

The rows of a conversation, in order, span a lattice: a node for each place between rows and each state of the role
grammar `(s?(ua)+)?` (nothing yet, after a system turn, after a user turn, after an assistant turn), an arc for each
edit with its integer cost. The auction algorithm holds a path and a price for each node. The path's last node either
raises its price to the least that going on costs, and the path contracts, or the price already is that, and the path
extends along that arc. When the path reaches the end, prices are a dual optimum: arcs whose cost equals the fall of
the price are tight, the cheapest repairs are the paths of tight arcs, and the least of them in ASCII order is traced.

A lattice has at most `BLOCK_ROWS` rows. Longer conversations are cut into blocks, dealt over tasks by ranges of
(conversation, turn). Auctions give the costs between the states at both ends of a block, a pass from the last block to
the first turns them into prices at the ends, and with those each block is auctioned and traced by itself, for each
state that it may be entered in. Only the digest of a conversation, which is sequential by definition, is made by one
task in a stream of its blocks; it holds one block at a time.

Order: by turn (nulls first), then role, then text (bytes). Null ids are a conversation of their own; a null role or
text is one space. A role is known by its first character (s, u, a; any other, or an empty role, fits nowhere).
Repeated rows are duplicates of the first. Long texts close their block early. Empty tables give no rows. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import Scratch, query, rows_of, table

BLOCK_ROWS = 32
BLOCK_BYTES = 1 << 20
#: Costs of the edits, and of leaving a truncated row in.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NEVER = 1 << 40

# states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant
STATES = range(4)
_SYSTEM, _USER, _ASSISTANT = 1, 2, 3
#: The state after a role's turn, where the grammar allows it.
_AFTER = {0: (_SYSTEM, _USER), _SYSTEM: (_USER,), _USER: (_ASSISTANT,), _ASSISTANT: (_USER,)}
_NAMES = {_USER: "user", _ASSISTANT: "assistant"}
#: Cost from each state once all rows are read.
_DONE = (0, NEVER, NEVER, 0)
_OK, _BLANK, _DUPLICATE, _TRUNCATED = range(4)


def row_arcs(initial: int, fault: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of a row in ASCII order of the edits."""
    arcs = [("D", DELETE, state)]
    if fault in (_OK, _TRUNCATED):
        more = TRUNCATED if fault == _TRUNCATED else 0
        if initial in _AFTER[state]:
            arcs.append(("K", more, initial))
        arcs += [("R", REROLE + more, s) for s in _AFTER[state] if s in _NAMES]
    return arcs


_ROW_ARCS = [[row_arcs(kind & 3, kind >> 2, q) for q in STATES] for kind in range(16)]
_INSERTS = [[("I", INSERT, s) for s in _AFTER[q] if s in _NAMES] for q in STATES]


def lattice(kinds: Sequence[int], exits: Sequence[int], last: bool) -> list[list[tuple[str, int, int]]]:
    """Arcs (edit, cost, node) of each node 4 * place + state, and of the end, the node after them. What is inserted
    between two blocks belongs to the latter."""
    arcs = []
    for at, kind in enumerate(kinds):
        for q in STATES:
            inserts = [(e, c, 4 * at + s) for e, c, s in _INSERTS[q]]
            rows = [(e, c, 4 * at + 4 + s) for e, c, s in _ROW_ARCS[kind][q]]
            arcs.append(rows[:1] + inserts + rows[1:])
    end = 4 * len(kinds) + 4
    for q in STATES:
        out = [("", exits[q], end)] if exits[q] < NEVER else []
        arcs.append(out + ([(e, c, end - 4 + s) for e, c, s in _INSERTS[q]] if last else []))
    return [*arcs, []]


def auction(origin: int, arcs: Sequence[Sequence[tuple[str, int, int]]], price: list[int], most: int) -> int:
    """The least cost from a node to the end, NEVER if it is above `most`. `price` holds a price for each node with
    none above cost plus price over any arc; it comes back so, and tight along a cheapest path."""
    end, path = len(arcs) - 1, [origin]
    while path[-1] != end:
        node = path[-1]
        least, to = min(((c + price[j], j) for _, c, j in arcs[node]), default=(NEVER, end))
        if least > most:
            least = NEVER
        if price[node] < least:  # contract
            price[node] = least
            if len(path) > 1:
                path.pop()
            elif least == NEVER:
                return NEVER
        elif price[node] == NEVER:
            return NEVER
        else:
            path.append(to)
    return price[origin]


def first_prices(arcs: Sequence[Sequence[tuple[str, int, int]]]) -> list[int]:
    """0 where a path leads to the end, NEVER elsewhere: no bids are made for nodes that lead nowhere."""
    before: list[list[int]] = [[] for _ in arcs]
    for node, out in enumerate(arcs):
        for _, _, to in out:
            before[to].append(node)
    price, left = [NEVER] * len(arcs), [len(arcs) - 1]
    price[-1] = 0
    while left:
        for node in before[left.pop()]:
            if price[node]:
                price[node] = 0
                left.append(node)
    return price


def most_cost(n: int) -> int:
    """More than any repair costs that can be made: a row is rerolled or deleted, and a turn inserted before it."""
    return (DELETE + REROLE + INSERT + TRUNCATED) * (n + 2) + 16


def between(kinds: Sequence[int], last: bool) -> list[int]:
    """Costs from each state before a block to each state after it, row by row."""
    out = [NEVER] * 16
    for to in STATES:
        arcs = lattice(kinds, [0 if q == to else NEVER for q in STATES], last)
        price = first_prices(arcs)
        for q in STATES:
            out[4 * q + to] = auction(q, arcs, price, most_cost(len(kinds)))
    return out


def traces(kinds: Sequence[int], exits: Sequence[int], last: bool, entries: Sequence[int]) -> list[tuple[str, int] | None]:
    """For each state a block may be entered in: (edits, state after them), the ASCII-least of the cheapest."""
    lowest = min(exits)
    arcs = lattice(kinds, [x if x >= NEVER else x - lowest for x in exits], last)
    price, end, out = first_prices(arcs), len(arcs) - 1, []
    leads: dict[int, bool] = {end: True}

    def tight(node: int) -> Iterator[tuple[str, int]]:
        return ((edit, to) for edit, cost, to in arcs[node] if price[node] == cost + price[to] < NEVER)

    def leads_on(node: int) -> bool:
        if node not in leads:
            leads[node] = any(leads_on(to) for _, to in tight(node))
        return leads[node]

    costs = [auction(q, arcs, price, most_cost(len(kinds))) for q in entries]
    for q, cost in zip(entries, costs, strict=True):
        if cost == NEVER:
            out.append(None)
            continue
        node, edits = q, []
        while True:
            edit, to = next((e, j) for e, j in tight(node) if leads_on(j))
            if to == end:
                break
            edits.append(edit)
            node = to
        out.append(("".join(edits), node % 4))
    return out


def applied(edits: str, state: int, roles: Sequence[str], texts: Sequence[str]) -> Iterator[tuple[str, str | None, str | None]]:
    """(edit, role, text) of each edit; deletions have neither role nor text."""
    at = 0
    for edit in edits:
        if edit == "D":
            yield edit, None, None
        elif edit == "K":
            state = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}[roles[at][0]]
            yield edit, roles[at], texts[at]
        else:
            state = next(s for s in _AFTER[state] if s in _NAMES)
            yield edit, _NAMES[state], texts[at] if edit == "R" else ""
        at += edit != "I"


# -- damage and faults: expressions


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text, dropped), damaged by a checksum of `id:turn`: a twentieth each is dropped, emptied,
    freed of full stops, repeated, and given to the user. Dropped rows stay, marked, to tell of their conversation."""
    conv, turn = turns[f"`{conv_col}`"], turns[f"`{turn_col}`"]
    said = [F.coalesce(c.cast("string"), F.lit(" ")) for c in (conv, turn)]
    kind = F.crc32(F.concat(said[0], F.lit(":"), said[1])) % 20
    role, text = (F.coalesce(turns[f"`{c}`"].cast("string"), F.lit(" ")) for c in (role_col, text_col))
    df = turns.select(conv.alias("conv"), turn.alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")
    return df.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), times).drop("copy")


def _first_fault(text: Column, again: Column) -> Column:
    blank = ~text.rlike(r"[^ \t-\r]")
    whole = text.rlike(r"[.!?][ \t-\r]*\z")
    return F.when(blank, _BLANK).when(again, _DUPLICATE).when(whole, _OK).otherwise(_TRUNCATED).cast("int")


def _faulty(rows: DataFrame) -> DataFrame:
    """Rows with `fault`. Of equal rows at different turns, all but those of the first turn are duplicates; equal rows of
    one turn are told apart where they stand side by side."""
    place = F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn"))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    same = rows.where("not dropped").groupBy("conv", "role", "digest").agg(F.min(place).alias("first"), F.max(place).alias("final")).where("first <> final")
    met = rows.alias("r").join(
        same.alias("s"), F.col("r.conv").eqNullSafe(F.col("s.conv")) & (F.col("r.role") == F.col("s.role")) & (F.col("r.digest") == F.col("s.digest")), "left"
    )
    again = F.col("s.first").isNotNull() & ~F.col("r.turn").eqNullSafe(F.col("s.first.turn"))
    return met.select("r.conv", "r.turn", "r.role", "r.text", "r.dropped", _first_fault(F.col("r.text"), again).alias("fault"))


_COUNTS = "n long, blank long, duplicate long, truncated long, illegal long, turns long, head string, tail string"
_BLOCK = f"part int, block int, kinds binary, roles array<string>, texts array<string>, {_COUNTS}"


def _fields(ddl: str) -> list[tuple[str, pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [(f.name, to_arrow_type(f.dataType)) for f in T.StructType.fromDDL(ddl)]


def _made(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _illegal(before: str | None, after: str) -> bool:
    return before is not None and before + after not in ("su", "ua", "au")


class _Block:
    """Rows of a conversation that stand together, and what can be counted of them."""

    def __init__(self):
        self.kinds, self.roles, self.texts, self.size = bytearray(), [], [], 0
        self.counts, self.illegal, self.turns = [0, 0, 0, 0], 0, 0
        self.head = self.tail = self.low = self.high = None

    def add(self, turn, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        self.kinds.append({"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}.get(initial, 0) | fault << 2)
        self.illegal += _illegal(self.tail, initial)
        self.head = initial if self.head is None else self.head
        self.tail = initial
        gone = fault in (_BLANK, _DUPLICATE)
        self.roles.append("" if gone else role)
        self.texts.append("" if gone else text)
        self.size += 0 if gone else len(text)
        self.counts[fault] += 1
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def row(self, conv, part: int, block: int) -> tuple:
        n = len(self.kinds)
        return conv, part, block, bytes(self.kinds), self.roles, self.texts, n, *self.counts[1:], self.illegal, self.turns, self.head, self.tail, self.low, self.high


def _blocks(ids: pa.DataType, turns: pa.DataType):
    """Blocks of rows (conv, turn, role, text, dropped, fault) that come in order."""
    schema = pa.schema([("conv", ids), *_fields(_BLOCK), ("low", turns), ("high", turns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, conv, block, before = TaskContext.get().partitionId(), 0, None, None, None
        for batch in rows_of(batches):
            out, size = [], 0
            for c, turn, role, text, dropped, fault in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if block is not None and (c != conv or len(block.kinds) >= BLOCK_ROWS or block.size > BLOCK_BYTES):
                    out.append(block.row(conv, part, at))
                    size += block.size
                    block, at = None, at + 1
                    if size > BLOCK_BYTES:
                        yield _made(out, schema)
                        out, size = [], 0
                before = None if c != conv else before
                conv, block = c, block or _Block()
                if dropped:
                    continue
                if before == (turn, role, text) and fault != _BLANK:
                    fault = _DUPLICATE
                before = (turn, role, text)
                block.add(turn, role, text, fault)
            if out:
                yield _made(out, schema)
        if block is not None:
            yield _made([block.row(conv, part, at)], schema)

    return run


def _matrices(ids: pa.DataType):
    schema = pa.schema([("conv", ids), ("part", pa.int32()), ("block", pa.int32()), ("costs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, part, block, kinds, last = (batch.column(k).to_pylist() for k in range(5))
            costs = [between(k, final) for k, final in zip(kinds, last, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((conv, part, block, costs), schema, strict=True)], schema=schema)

    return run


def _sweep(ids: pa.DataType):
    """The prices at the ends of blocks, which come from the last of a conversation to its first."""
    schema = pa.schema([("conv", ids), ("part", pa.int32()), ("block", pa.int32()), ("exits", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, exits = object(), None
        for batch in batches:
            rows = []
            for conv, part, block, costs in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if conv != at:
                    at, exits = conv, list(_DONE)
                rows.append((conv, part, block, exits))
                exits = [min(min(costs[4 * q + r] + exits[r] for r in STATES), NEVER) for q in STATES]
            if rows:
                yield _made(rows, schema)

    return run


def _traced():
    """Adds to blocks the edits and the state after them, for each state before."""
    made = [("edits", pa.list_(pa.string())), ("after", pa.list_(pa.int32()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            kinds, exits, last = (batch.column(names.index(n)).to_pylist() for n in ("kinds", "exits", "last"))
            edits, after = [], []
            for k, x, final in zip(kinds, exits, last, strict=True):
                found = traces(k, x or _DONE, x is None or final, STATES if x else STATES[:1])
                edits.append([None if f is None else f[0] for f in found])
                after.append([None if f is None else f[1] for f in found])
            keep = [batch.column(k) for k, n in enumerate(names) if n not in ("exits", "last")]
            kept = [n for n in names if n not in ("exits", "last")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(edits, made[0][1]), pa.array(after, made[1][1])], names=[*kept, "edits", "after"])

    return run


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def traced_blocks(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Blocks of the rows (conv, turn, role, text, dropped) with their traces, sorted by conversation within tasks."""
    rows = scratch.write(_faulty(rows), "rows")  # which is read to find the ranges and to deal by them
    ids, turns = rows.schema["conv"].dataType, rows.schema["turn"].dataType
    many = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number given is not coalesced
    dealt = rows.repartitionByRange(many, "conv", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv", "turn", "role", "text")
    ddl = f"conv {ids.simpleString()}, {_BLOCK}, low {turns.simpleString()}, high {turns.simpleString()}"
    blocks = scratch.write(dealt.select("conv", "turn", "role", "text", "dropped", "fault").mapInArrow(_blocks(_arrow(ids), _arrow(turns)), ddl), "blocks")
    scratch.drop(rows)

    own = blocks.groupBy("conv").agg(F.count("*").alias("blocks"), F.max(F.struct("part", "block")).alias("final")).where("blocks > 1")
    long = blocks.alias("b").join(own.alias("o"), F.col("b.conv").eqNullSafe(F.col("o.conv")))
    long = long.select("b.conv", "b.part", "b.block", "b.kinds", (F.struct("b.part", "b.block") == F.col("o.final")).alias("last"))
    place = f"conv {ids.simpleString()}, part int, block int"
    long = long.repartition(many, "part", "block")  # few small rows with much to do
    costs = scratch.write(long.mapInArrow(_matrices(_arrow(ids)), f"{place}, costs array<bigint>"), "costs")
    swept = costs.repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("block"))
    exits = scratch.write(swept.mapInArrow(_sweep(_arrow(ids)), f"{place}, exits array<bigint>"), "exits")
    # a long conversation's last block is the one whose exits are free
    priced = blocks.join(exits.select("part", "block", "exits"), ["part", "block"], "left")
    free = F.col("exits") == F.array(*[F.lit(x).cast("long") for x in _DONE])
    priced = priced.select(*blocks.columns, "exits", F.coalesce(free, F.lit(True)).alias("last"))
    out = scratch.write(priced.mapInArrow(_traced(), f"{ddl}, edits array<string>, after array<int>"), "traced")
    scratch.drop(blocks, costs, exits)
    return out


def _in_order(traced: DataFrame) -> DataFrame:
    return traced.repartition("conv").sortWithinPartitions("conv", "part", "block")


class _Walk:
    """The blocks of a conversation in order, edits chosen by the state that those before have led to."""

    def __init__(self, conv):
        self.conv, self.state, self.n, self.lines, self.sha = conv, 0, 0, 0, hashlib.sha256()
        self.counts, self.cost, self.audit, self.turns = [0, 0, 0, 0], 0, [], 0
        self.tail = self.low = self.high = None

    def take(self, row: dict) -> list[tuple[str, str | None, str | None]]:
        edits, state = row["edits"][self.state], self.state
        done = list(applied(edits, state, row["roles"], row["texts"]))
        self.state = row["after"][state]
        at = 0
        for edit in edits:
            cut = edit != "I" and row["kinds"][at] >> 2 == _TRUNCATED and edit != "D"
            self.cost += {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}[edit] + (TRUNCATED if cut else 0)
            at += edit != "I"
        self.audit.append(edits)
        if row["n"]:
            seam = _illegal(self.tail, row["head"])
            new = [row["blank"], row["duplicate"], row["truncated"], row["illegal"] + seam]
            self.counts = [a + b for a, b in zip(self.counts, new, strict=True)]
            self.tail = row["tail"]
            if row["turns"]:
                self.turns += row["turns"] - (self.high is not None and self.high == row["low"])
                self.low = row["low"] if self.low is None else self.low
                self.high = row["high"]
        return done

    def digest(self, done: list[tuple[str, str | None, str | None]]) -> None:
        for edit, role, text in done:
            if edit != "D":
                self.sha.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
                self.lines += 1

    def summary(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, *self.counts, self.cost, "".join(self.audit), self.sha.hexdigest()


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Walk, dict | None]]:
    """(conversation, its next block), then (conversation, None) at its end."""
    walk = None
    for batch in rows_of(batches):
        for row in batch.to_pylist():
            if walk is None or walk.conv != row["conv"]:
                if walk is not None:
                    yield walk, None
                walk = _Walk(row["conv"])
            yield walk, row
    if walk is not None:
        yield walk, None


def repaired_turns(traced: DataFrame) -> DataFrame:
    """The conversations after their repair: conv, place (from 0), edit (D, I, K or R), role and text (null if deleted)."""
    ids = traced.schema["conv"].dataType
    schema = pa.schema([("conv", _arrow(ids)), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for walk, row in _walks(batches):
            if row is None:
                continue
            done = walk.take(row)
            rows = [(walk.conv, walk.n + k, *d) for k, d in enumerate(done)]
            walk.n += len(done)
            if rows:
                yield _made(rows, schema)

    return _in_order(traced).mapInArrow(run, f"conv {ids.simpleString()}, place long, edit string, role string, text string")


def repair_report(traced: DataFrame) -> DataFrame:
    """A row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    ids = traced.schema["conv"].dataType
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = pa.schema([("conv", _arrow(ids)), *[(n, pa.int64()) for n in names], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for walk, row in _walks(batches):
            if row is None:
                rows.append(walk.summary())
            else:
                walk.digest(walk.take(row))
            if len(rows) >= 4096:
                yield _made(rows, schema)
                rows = []
        if rows:
            yield _made(rows, schema)

    return _in_order(traced).mapInArrow(run, f"conv {ids.simpleString()}, {', '.join(n + ' long' for n in names)}, audit string, repaired_sha256 string")


@query("op13_structure_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "structure")
    return repair_report(traced_blocks(damaged(table(spark, sf_dir, "conversations")), scratch)).withColumnRenamed("conv", "conv_id")
