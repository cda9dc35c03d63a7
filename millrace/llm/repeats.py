"""Removal of repeated passages by a suffix order over a prefix-free parse.

A rolling hash over k bytes sets triggers: a position whose hash is the least of some stretch of `length - k + 1`
positions. Triggers depend on content only, every string of `length` bytes holds at least one, and equal strings hold
the same ones at the same places. They cut texts into phrases. A string of `length` bytes is then a tail of one phrase
(up to its first trigger) followed by the parse from that trigger on. So two sorted lists decide on equality: the
phrase tails, sorted from the trigger backwards (the dictionary's order), and the parse from each trigger on (the
parse's order). With the longest common prefixes of neighbours in both lists, strings of `length` bytes are equal
if both their ranks, cut to the lengths in question, are. No position of the corpus is sorted that is not next to a
trigger found in more than one document, and equal contexts of a block are sorted once.

Three passes over blocks of whole documents, tied together by shuffles of compressed arrays:

1. each block sends its distinct trigger hashes; buckets answer with one bit each: seen in another document or not;
2. each block sends the distinct contexts of its shared triggers; buckets sort them and answer for each context
   with the smallest document that holds each string around the trigger;
3. each block marks the bytes of strings that a smaller document holds.

A passage in a third of all documents is sent once per block, not once per document. Null texts count as empty.
Documents of equal id don't take from each other; a null id is larger than every other. Matches never cross documents.
A text larger than a block is a block of its own. Empty tables give empty results. Other columns pass through, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, packed, query, rows_of, table, thrifty, unpacked

LAST = np.iinfo(np.int64).max
K = 16
_BYTE_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = np.random.default_rng(977).integers(1, 1 << 63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hashed(x: np.ndarray) -> np.ndarray:
    """Mixed hashes from codes whose last axis holds the bytes of each string, or of all strings in turn."""
    step = 1
    for mul in _STEPS:
        x = x[..., :-step] * mul + x[..., step:]
        step *= 2
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def hashes_at(data: np.ndarray, places: np.ndarray, piece: int = 1 << 16) -> np.ndarray:
    if not len(places):
        return np.empty(0, np.uint64)
    strings = np.lib.stride_tricks.sliding_window_view(data, K)
    h = np.concatenate([_hashed(_BYTE_CODES[strings[places[i : i + piece]]])[:, 0] for i in range(0, len(places), piece)])
    # triggers are least hashes: their high bits, which name the bucket, are made even again
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each stretch of `width` values, by doubling."""
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def triggers(data: np.ndarray, ends: np.ndarray, length: int, piece: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: trigger places, and the first and last start of the strings assigned to each.

    A string of `length` bytes belongs to its least hash, of equal ones to the leftmost. The low bits of a hash give
    way to its place, so that a minimum names its place too."""
    n = len(data) - length + 1
    place_bits = np.uint64((1 << 20) - 1)
    valid = np.ones(max(n, 0), bool)
    for k in range(1, length):  # starts whose string would reach into the next text
        at = ends - k
        valid[at[(at >= 0) & (at < n)]] = False
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, n, piece):
        h = _hashed(_BYTE_CODES[data[at : at + piece + length - 1]])
        h &= ~place_bits
        h |= np.arange(len(h), dtype=np.uint64)
        place = (_least(h, length - K + 1) & place_bits).astype(np.int64) + at
        start = np.flatnonzero(valid[at : at + piece]) + at
        if len(start):
            place = place[start - at]
            new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            out.append((place[new], start[new], start[np.r_[new[1:] - 1, len(start) - 1]]))
    if not out:
        return (np.empty(0, np.int64),) * 3
    place, first, last = (np.concatenate(x) for x in zip(*out, strict=True))
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])  # one trigger's strings may start in two pieces
    return place[new], first[new], last[np.r_[new[1:] - 1, len(place) - 1]]


class Block:
    """Whole texts laid end to end, with their triggers."""

    FIELDS = "block long, n_triggers long, ids binary, nulls binary, uids binary, ends binary, data binary, places binary, near binary, far binary"

    def __init__(self, row: dict):
        self.number = row["block"]
        self.ids, self.uids = unpacked(row["ids"], np.int64), unpacked(row["uids"], np.int64)
        self.nulls, self.ends = unpacked(row["nulls"], np.uint8).astype(bool), unpacked(row["ends"], np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"]), np.uint8)
        self.places = np.cumsum(unpacked(row["places"], np.uint32), dtype=np.int64)
        self.near, self.far = unpacked(row["near"], np.uint8), unpacked(row["far"], np.uint8)  # start is place less this

    def hashed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct trigger hashes, whether more than one document of the block has each, and by trigger the number
        of its hash and its document's id."""
        h = hashes_at(self.data, self.places)
        ids = self.ids[np.searchsorted(self.ends, self.places, "right")]
        order = np.argsort(h, kind="stable")
        new = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]]) if len(h) else np.empty(0, np.int64)
        distinct, by = h[order][new], ids[order]
        many = np.minimum.reduceat(by, new) < np.maximum.reduceat(by, new) if len(h) else np.empty(0, bool)
        number = np.empty(len(h), np.int64)
        number[order] = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(h)]))
        return distinct, many, number, ids

    def contexts(self, length: int, bits: int, answers: list[dict]) -> Contexts:
        distinct, many, number, ids = self.hashed()
        shared = many.copy()
        for bucket, part in _by_bucket(distinct, bits):
            for x in answers:
                if x["bucket"] == bucket:
                    shared[part] |= np.unpackbits(np.frombuffer(x["found"], np.uint8), count=part.stop - part.start).astype(bool)
        return Contexts(self, np.flatnonzero(shared[number]), distinct[number], ids, length, bits)


class Contexts:
    """Distinct contexts of a block's shared triggers, in order of their bucket.

    A context is the bytes from the first to the end of the last string assigned to the trigger, others blanked."""

    def __init__(self, block: Block, chosen: np.ndarray, hashes: np.ndarray, ids: np.ndarray, length: int, bits: int):
        reach = length - K
        self.places, self.near, self.far, self.ids = block.places[chosen], block.near[chosen], block.far[chosen], ids[chosen]
        padded = np.concatenate((np.zeros(reach, np.uint8), block.data, np.zeros(length, np.uint8)))
        rows = np.empty((len(chosen), 10 + reach + length), np.uint8)
        # big-endian hash first, so that the order of rows is the order of buckets
        rows[:, :8] = hashes[chosen].astype(">u8").view(np.uint8).reshape(-1, 8)
        rows[:, 8], rows[:, 9] = self.near, self.far
        rows[:, 10:] = np.lib.stride_tricks.sliding_window_view(padded, reach + length)[self.places] if len(chosen) else 0
        column = np.arange(reach + length)
        rows[:, 10:][(column < reach - self.far[:, None].astype(np.int64)) | (column >= reach + length - self.near[:, None].astype(np.int64))] = 0
        order = np.argsort(rows.view(f"V{rows.shape[1]}").ravel(), kind="stable") if len(rows) else np.empty(0, np.int64)
        rows = rows[order]
        new = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(1)]) if len(rows) else order
        self.number = np.empty(len(rows), np.int64)
        self.number[order] = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(rows)]))
        self.rows = rows[new]
        self.least = np.minimum.reduceat(self.ids[order], new) if len(rows) else np.empty(0, np.int64)
        self.parts = list(_by_bucket(np.ascontiguousarray(self.rows[:, :8]).view(">u8").ravel().astype(np.uint64), bits))


def _by_bucket(ordered: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Parts of ordered hashes by their highest bits."""
    if len(ordered):
        bucket = (ordered >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(ordered), np.int64)
        new = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        for at, end in zip(new, np.r_[new[1:], len(ordered)], strict=True):
            yield int(bucket[at]), slice(int(at), int(end))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("n_triggers", pa.int64())] + [(n, pa.binary()) for n in ("ids", "nulls", "uids", "ends", "data", "places", "near", "far")])


def _to_blocks(length: int, block_bytes: int):
    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        uids: list[int] = []
        texts: list[bytes] = []
        size = 0

        def block() -> pa.RecordBatch:
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
            data = np.frombuffer(b"".join(texts), np.uint8)
            place, first, last = triggers(data, ends, length)
            nulls = np.array([x is None for x in ids], np.uint8)
            number = int(np.random.default_rng().integers(1, LAST))  # written at once, so never drawn again
            row = (
                number, len(place), packed(np.array([LAST if x is None else x for x in ids], np.int64)), packed(nulls),
                packed(np.array(uids, np.int64)), packed(ends), zstandard.ZstdCompressor(level=3).compress(data.tobytes()),
                packed(np.diff(place, prepend=0).astype(np.uint32)), packed((place - last).astype(np.uint8)), packed((place - first).astype(np.uint8)),
            )
            ids.clear(), uids.clear(), texts.clear()
            return _batch([row], BLOCK_SCHEMA)

        for batch in rows_of(batches):
            for i, u, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(i), uids.append(u), texts.append(t or b"")
                size += len(t or b"")
                if size >= block_bytes:
                    yield block()
                    size = 0
        if ids:
            yield block()

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {f.name: batch.column(k)[i].as_py() for k, f in enumerate(batch.schema)}


ASK = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("asked", pa.binary())])
FOUND = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("found", pa.binary())])
ASK_MORE = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("asked", pa.binary()), ("least", pa.binary())])


def _ask(bits: int):
    @thrifty
    def run(batches):
        for row in _blocks(batches):
            block = Block(row)
            distinct = block.hashed()[0]
            yield _batch([(b, block.number, packed(distinct[part])) for b, part in _by_bucket(distinct, bits)], ASK)

    return run


@thrifty
def _answer(group: pa.Table) -> pa.Table:
    """One bucket: which hashes more than one block has."""
    asked = [unpacked(x, np.uint64) for x in group["asked"].to_pylist()]
    sizes = [len(x) for x in asked]
    h = np.concatenate(asked)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    found = np.empty(len(h), bool)
    found[order] = np.r_[False, same] | np.r_[same, False]
    cuts = np.split(found, np.cumsum(sizes)[:-1])
    return pa.table([group["block"], group["bucket"], pa.array([np.packbits(x).tobytes() for x in cuts], pa.binary())], schema=FOUND)


def _ask_more(length: int, bits: int):
    @thrifty
    def run(batches):
        for row in _blocks(batches):
            block = Block(row)
            c = block.contexts(length, bits, row["answers"] or [])
            pack = zstandard.ZstdCompressor(level=3).compress
            yield _batch([(b, block.number, pack(c.rows[part].tobytes()), packed(c.least[part])) for b, part in c.parts], ASK_MORE)

    return run


def _ranked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and the length each shares with the one before."""
    rows = np.ascontiguousarray(rows)
    order = np.argsort(rows.view(f"V{rows.shape[1]}").ravel(), kind="stable")
    differ = rows[order][1:] != rows[order][:-1]
    shared = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return order, np.r_[0, shared]


def smaller_documents(contexts: np.ndarray, near: np.ndarray, far: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """By context: bit j is set if the string that starts j bytes before the trigger is also in a smaller document.

    Two strings are equal if their tails before the trigger have one rank, cut to j bytes, and the parse from the
    trigger on has one rank, cut to the rest."""
    reach, out = length - K, np.zeros(len(contexts), np.uint64)
    tails, shared_tail = _ranked(contexts[:, :reach][:, ::-1])
    parse, shared_parse = _ranked(contexts[:, reach:])
    rank_tail, rank_parse = np.empty(len(contexts), np.int64), np.empty(len(contexts), np.int64)
    for j in range(reach + 1):
        at = np.flatnonzero((near <= j) & (j <= far))
        if not len(at):
            continue
        rank_tail[tails] = np.cumsum(shared_tail < j) if j else 0
        rank_parse[parse] = np.cumsum(shared_parse < length - j)
        key = rank_parse[at] * (len(contexts) + 1) + rank_tail[at]
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        smallest = np.repeat(np.minimum.reduceat(least[at][order], new), np.diff(np.r_[new, len(at)]))
        hit = at[order][smallest < least[at][order]]
        out[hit] |= np.uint64(1 << j)
    return out


def _answer_more(length: int):
    @thrifty
    def run(group: pa.Table) -> pa.Table:
        """One bucket: the contexts of all blocks, sorted once."""
        width = 10 + 2 * length - K
        unpack = zstandard.ZstdDecompressor().decompress
        asked = [np.frombuffer(unpack(x), np.uint8).reshape(-1, width) for x in group["asked"].to_pylist()]
        sizes, rows = [len(x) for x in asked], np.concatenate(asked)
        least = np.concatenate([unpacked(x, np.int64) for x in group["least"].to_pylist()])
        order = np.argsort(rows.view(f"V{width}").ravel(), kind="stable")
        new = np.flatnonzero(np.r_[True, (rows[order][1:] != rows[order][:-1]).any(1)])
        smallest = np.minimum.reduceat(least[order], new)
        distinct = rows[order][new]
        found = smaller_documents(distinct[:, 10:], distinct[:, 8], distinct[:, 9], smallest, length)
        counts, own = np.diff(np.r_[new, len(rows)]), np.uint64((1 << (length - K + 1)) - 1)
        bits = np.empty(len(rows), np.uint64)
        bits[order] = np.repeat(found, counts)
        bits[order] |= np.where(np.repeat(smallest, counts) < least[order], own, np.uint64(0))
        cuts = np.split(bits, np.cumsum(sizes)[:-1])
        return pa.table([group["block"], group["bucket"], pa.array([packed(x) for x in cuts], pa.binary())], schema=FOUND)

    return run


RESULT = "id long, uid long, n_bytes long, starts array<long>, lengths array<long>, kept binary"


def _mark(length: int, bits: int):
    schema = pa.schema([("id", pa.int64()), ("uid", pa.int64()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("kept", pa.binary())])

    @thrifty
    def run(batches):
        for row in _blocks(batches):
            block = Block(row)
            c = block.contexts(length, bits, row["answers"] or [])
            found = np.zeros(len(c.rows), np.uint64)
            more = {x["bucket"]: x["found"] for x in row["more"] or []}
            for bucket, part in c.parts:
                found[part] = unpacked(more[bucket], np.uint64)
            bit = found[c.number] if len(c.rows) else found
            own = c.ids > c.least[c.number] if len(c.rows) else np.empty(0, bool)  # a smaller document of this block
            starts = np.zeros(len(block.data) + 1, np.int32)
            for j in range(length - K + 1):
                hit = (((bit >> np.uint64(j)) & np.uint64(1)).astype(bool) | own) & (c.near <= j) & (j <= c.far)
                starts[c.places[hit] - j] = 1
            total = np.cumsum(starts[:-1])
            covered = total > np.r_[np.zeros(min(length, len(total)), total.dtype), total[:-length]][: len(total)]
            del total, starts
            # texts are cut at their ends, where runs of neighbours may touch
            edge = np.zeros(len(covered) + 1, bool)
            edge[block.ends] = True
            begin = np.flatnonzero(covered & np.r_[True, ~covered[:-1] | edge[1:-1]][: len(covered)])
            end = np.flatnonzero(covered & np.r_[~covered[1:] | edge[1:-1], True][: len(covered)]) + 1
            first = np.r_[0, block.ends[:-1]]
            lo, hi = np.searchsorted(begin, first), np.searchsorted(begin, block.ends)
            out = []
            for k, (s, e) in enumerate(zip(first.tolist(), block.ends.tolist(), strict=True)):
                kept = block.data[s:e] if lo[k] == hi[k] else block.data[s:e][~covered[s:e]]
                spans = begin[lo[k] : hi[k]]
                out.append((None if block.nulls[k] else int(block.ids[k]), int(block.uids[k]), e - s, (spans - s).tolist(), (end[lo[k] : hi[k]] - spans).tolist(), kept.tobytes()))
            yield _batch(out, schema)

    return run


def repeats(docs: DataFrame, scratch: Scratch, length: int = 50, block_bytes: int = 4 << 20, bucket_triggers: int = 1 << 18) -> DataFrame:
    """(id, uid, n_bytes, starts, lengths, kept) for rows (id, uid, text): the removed runs and what remains."""
    if not K < length <= K + 63:
        raise ValueError(f"strings have {K + 1} to {K + 63} bytes")
    rows = docs.select(F.col("id").cast("long"), F.col("uid").cast("long"), F.col("text").cast("string"))
    blocks = scratch.write(rows.mapInArrow(_to_blocks(length, block_bytes), Block.FIELDS), "blocks")
    count = blocks.agg(F.sum("n_triggers")).first()[0] or 0
    bits = max(0, int(count // bucket_triggers).bit_length())
    asked = blocks.mapInArrow(_ask(bits), "bucket long, block long, asked binary")
    found = asked.groupBy("bucket").applyInArrow(_answer, "block long, bucket long, found binary")
    answers = scratch.write(found.groupBy("block").agg(F.collect_list(F.struct("bucket", "found")).alias("answers")), "answers")
    with_answers = blocks.join(answers, "block", "left")
    asked = with_answers.mapInArrow(_ask_more(length, bits), "bucket long, block long, asked binary, least binary")
    found = asked.groupBy("bucket").applyInArrow(_answer_more(length), "block long, bucket long, found binary")
    more = scratch.write(found.groupBy("block").agg(F.collect_list(F.struct("bucket", "found")).alias("more")), "more")
    return with_answers.join(more, "block", "left").mapInArrow(_mark(length, bits), RESULT)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """Per row: its id, bytes, removed spans (start, length in bytes) and the remaining bytes."""
    scratch = Scratch(docs.sparkSession, "repeats")
    out = repeats(docs.select(docs[f"`{id_col}`"].alias("id"), F.lit(0).alias("uid"), docs[f"`{text_col}`"].alias("text")), scratch, length)
    spans = F.arrays_zip(F.col("starts").alias("start"), F.col("lengths").alias("length"))
    return out.select(F.col("id").alias(id_col), "n_bytes", spans.alias("spans"), "kept")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """The rows with repeated passages cut out of their text; null texts stay null. Characters of which a cut left
    only some bytes are dropped, so that the text is valid."""
    scratch = Scratch(docs.sparkSession, "repeats")
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("uid"))
    whole = scratch.write(whole, "rows")  # which fixes the uid
    blocks = Scratch(docs.sparkSession, "repeats-blocks")
    out = repeats(whole.select(F.col("row")[id_col].alias("id"), "uid", F.col("row")[text_col].alias("text")), blocks, length)
    cut = out.filter(F.size("starts") > 0).select("uid", "kept").mapInArrow(_as_text, "uid long, kept string")
    cut = scratch.write(cut, "cut")
    blocks.clear()  # before the rows are shuffled
    text = F.when(F.col("kept").isNull(), F.col("row")[text_col]).otherwise(F.col("kept"))
    return whole.join(cut, "uid", "left").select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


@thrifty
def _as_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(batches):
        text = [x.decode("utf-8", "ignore") for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["uid", "kept"])


@query("op3_suffix_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_spans(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
