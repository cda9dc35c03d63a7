"""Best-fit packing by a grouping genetic algorithm on islands.

A document becomes its token ids and an end id. One longer than a sequence is cut into whole sequences, the first
piece taking what is over. Whole sequences need no packing. The other pieces are dealt to shards of bounded size by a
hash of their number, so a shard holds a fair mixture; each shard is evolved on several islands at once, in tasks of
their own. An individual is a grouping of pieces into bins. Crossover injects whole well-filled bins of one parent
into the other, removes the bins that would hold a piece twice, and puts the displaced pieces back by best fit, longest
first. Between rounds each island sends its elite to the next one, through a join. The best island of a shard wins.

A shard leaves few bins unfilled, and shards grow in number, not in size. Null and empty texts are one end id. Repeated
rows are packed each by itself. A text is encoded whole, and its task holds a few copies of it; its pieces are rows of
their own. Empty tables give empty results. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, packed, query, rows_of, table, thrifty, unpacked
from millrace.llm.tokens import default_tokenizer, encoder

PIECES = "id long, piece int, start long, length long, ids_crc32 long, ids binary"


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, and first what is over."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _to_pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 1 << 14, 16 << 20):  # the more texts at once, the fewer words are asked for
            ids, ends = encoder(path).encode_column(batch.column(1))
            ids = memoryview(np.insert(ids, ends, end_id).view(np.uint8))
            rows, at = [], 0
            for i, end in zip(batch.column(0).to_pylist(), (ends + np.arange(1, len(ends) + 1)).tolist(), strict=True):
                for k, (s, n) in enumerate(cuts(end - at, capacity)):
                    data = ids[4 * (at + s) : 4 * (at + s + n)]
                    rows.append((i, k, s, n, zlib.crc32(data), bytes(data) if with_ids else None))
                at = end
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


class Bins:
    """Open bins by free room, for best fit: the fullest bin that still takes a piece."""

    def __init__(self, capacity: int, room: np.ndarray):
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask, self.capacity, self.n = 0, capacity, len(room)
        for k, r in enumerate(room.tolist()):
            if r:
                self.by_room[r].append(k)
                self.mask |= 1 << r

    def put(self, length: int) -> int:
        fits = self.mask >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            k = self.by_room[room].pop()
            if not self.by_room[room]:
                self.mask ^= 1 << room
        else:
            room, k = self.capacity, self.n
            self.n += 1
        if room > length:
            self.by_room[room - length].append(k)
            self.mask |= 1 << (room - length)
        return k


def best_fit(lengths: np.ndarray, capacity: int, bins: np.ndarray, todo: np.ndarray) -> np.ndarray:
    """`bins` by piece with the pieces `todo` (bin -1) put in, in their order; others stay."""
    n = int(bins.max(initial=-1)) + 1
    placed = bins >= 0
    room = capacity - np.bincount(bins[placed], lengths[placed], n).astype(np.int64)
    open_bins, bins = Bins(capacity, room), bins.copy()
    bins[todo] = [open_bins.put(x) for x in lengths[todo].tolist()]
    return bins


def renumbered(bins: np.ndarray) -> np.ndarray:
    """The same grouping without empty bins."""
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def fitness(lengths: np.ndarray, capacity: int, bins: np.ndarray) -> tuple[int, float]:
    """To be made small: the number of bins, then one less how unevenly they are filled."""
    fill = np.bincount(bins, lengths) / capacity
    return len(fill), 1 - float((fill**2).mean())


def crossover(lengths: np.ndarray, capacity: int, into: np.ndarray, of: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Well-filled bins of one parent go into the other whole; what they displace is best-fitted again."""
    fill = np.bincount(of, lengths, of.max() + 1)
    well = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(well, max(1, len(well) // 4), replace=False)] = True
    injected = chosen[of]
    hit = np.zeros(into.max() + 1, bool)
    hit[into[injected]] = True  # bins that hold an injected piece
    # the least filled of the other bins are opened too, so that their pieces can close gaps
    rest = np.bincount(into, lengths, len(hit))
    opened = np.flatnonzero(~hit & (rest < np.quantile(rest, 0.05)))
    hit[opened] = True
    child = np.where(hit[into], -1, into)
    child[injected] = len(hit) + of[injected]
    displaced = np.flatnonzero(child < 0)
    kept = child >= 0
    child[kept] = renumbered(child[kept])
    displaced = displaced[np.argsort(-lengths[displaced], kind="stable")]
    return renumbered(best_fit(lengths, capacity, child, displaced))


def first_population(lengths: np.ndarray, capacity: int, size: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Best fit, longest first; and best fit with the order somewhat stirred."""
    none = np.full(len(lengths), -1, np.int64)
    orders = [np.argsort(-lengths, kind="stable")]
    orders += [np.argsort(-lengths * rng.uniform(0.9, 1.1, len(lengths)), kind="stable") for _ in range(size - 1)]
    return [renumbered(best_fit(lengths, capacity, none, order)) for order in orders]


def evolve(lengths: np.ndarray, capacity: int, population: list[np.ndarray], generations: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Each generation replaces the worst half by children of two of the better half."""
    size = len(population)
    least = -(-int(lengths.sum()) // capacity)
    for _ in range(generations):
        population = sorted(population, key=lambda x: fitness(lengths, capacity, x))
        if fitness(lengths, capacity, population[0])[0] == least:
            break  # no grouping has fewer bins
        better = population[: max(2, size // 2)]
        children = []
        while len(better) + len(children) < size:
            a, b = rng.choice(len(better), 2, replace=False)
            children.append(crossover(lengths, capacity, better[a], better[b], rng))
        population = better + children
    return sorted(population, key=lambda x: fitness(lengths, capacity, x))


STATE = "shard long, island int, bins int, waste double, elite binary, population array<binary>"
_STATE = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("bins", pa.int32()), ("waste", pa.float64()), ("elite", pa.binary()), ("population", pa.list_(pa.binary()))])


def _evolve(capacity: int, size: int, generations: int, turn: int, seed: int):
    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rng = np.random.default_rng([seed, turn, row["shard"], row["island"]])  # the same if a task runs again
                lengths = unpacked(row["lengths"], np.int32).astype(np.int64)
                if row["population"]:
                    population = [unpacked(x, np.int32) for x in row["population"]]
                    if row["migrant"] is not None:
                        population[-1] = unpacked(row["migrant"], np.int32)
                else:
                    population = first_population(lengths, capacity, size, rng)
                population = evolve(lengths, capacity, population, generations, rng)
                n, waste = fitness(lengths, capacity, population[0])
                out = [packed(x) for x in population]
                columns = [row["shard"], row["island"], n, waste, out[0], out]
                yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(columns, _STATE, strict=True)], schema=_STATE)

    return run


@thrifty
def _to_shard(group: pa.Table) -> pa.Table:
    """One row for a shard's pieces, in the order of their numbers."""
    group = group.sort_by("uid")
    lengths = packed(group["length"].to_numpy().astype(np.int32))
    uids = packed(group["uid"].to_numpy().astype(np.int64))
    return pa.table({"shard": group["shard"].slice(0, 1), "lengths": pa.array([lengths], pa.binary()), "uids": pa.array([uids], pa.binary())})


@thrifty
def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            lengths, uids, bins = unpacked(row["lengths"], np.int32).astype(np.int64), unpacked(row["uids"], np.int64), unpacked(row["elite"], np.int32)
            order = np.argsort(bins, kind="stable")
            before = np.cumsum(lengths[order]) - lengths[order]
            new = np.flatnonzero(np.r_[True, bins[order][1:] != bins[order][:-1]])
            offset = before - np.repeat(before[new], np.diff(np.r_[new, len(bins)]))
            columns = [uids[order], row["shard"] * (1 << 32) + bins[order].astype(np.int64), offset]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["uid", "sequence_id", "offset"])


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None,
    shard_pieces: int = 8192, islands: int = 3, population: int = 4, generations: int = 4, rounds: int = 2, with_ids: bool = False, seed: int = 5,
) -> DataFrame:
    """One row per piece: its id, piece, start, length, ids_crc32, sequence_id and offset, and its ids (little-endian
    unsigned 32-bit) if asked for."""
    scratch = Scratch(docs.sparkSession, "packing")
    path = tokenizer or default_tokenizer()
    narrow = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].cast("string").alias("text"))
    pieces = narrow.mapInArrow(_to_pieces(path, capacity, end_id, with_ids), PIECES).withColumn("uid", F.monotonically_increasing_id())
    pieces = scratch.write(pieces, "pieces")  # which fixes the uid
    loose = pieces.filter(F.col("length") < capacity).select("uid", "length")
    shards = max(1, -(-loose.count() // shard_pieces))
    dealt = loose.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)))
    items = scratch.write(dealt.groupBy("shard").applyInArrow(_to_shard, "shard long, lengths binary, uids binary"), "items")
    everywhere = items.select("shard", "lengths", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    state = None
    for turn in range(rounds):
        if state is None:
            task = everywhere.withColumns({"population": F.lit(None).cast("array<binary>"), "migrant": F.lit(None).cast("binary")})
        else:
            moved = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elite").alias("migrant"))
            task = everywhere.join(state.select("shard", "island", "population"), ["shard", "island"]).join(moved, ["shard", "island"], "left")
        task = task.select("shard", "island", "lengths", "population", "migrant").repartition(shards, "shard", "island")  # small rows with much to do: a number that is given is not coalesced
        after = scratch.write(task.mapInArrow(_evolve(capacity, population, generations, turn, seed), STATE), f"round{turn}")
        if state is not None:
            scratch.drop(state)
        state = after
    best = state.groupBy("shard").agg(F.min(F.struct("bins", "waste", "island"))["island"].alias("island"))
    elite = state.join(best, ["shard", "island"]).select("shard", "elite")
    places = items.join(elite, "shard").select("shard", "lengths", "uids", "elite").mapInArrow(_places, "uid long, sequence_id long, offset long")
    places = scratch.write(places, "places")
    scratch.drop(state, items)
    whole = F.col("length") == capacity
    out = pieces.join(places, "uid", "left").select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        F.when(whole, -1 - F.col("uid")).otherwise(F.col("sequence_id")).alias("sequence_id"),
        F.when(whole, F.lit(0).cast("long")).otherwise(F.col("offset")).alias("offset"), "ids",
    )
    return out if with_ids else out.drop("ids")


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
