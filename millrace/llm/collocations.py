"""Phrase collocation mining by direct-address tiles, level by level.

Words that occur often enough are numbered by falling frequency in their language. A pair of neighbouring numbers is a
cell of a square; squares are cut into tiles of `SIDE` by `SIDE` cells. Frequent words have small numbers, so the first
tiles hold most pairs: a block of text counts those as dense arrays (`numpy.bincount`), all other tiles as sorted
coordinate lists. Tiles are summed over blocks, in two steps so that the first tile has no single owner at once; an
owner holds one tile, which turns dense when its list grows. Pairs that are frequent are numbered by falling frequency
again, and neighbouring pairs that overlap are the pairs of the next level, as a frequent phrase has frequent parts: so
phrases of 3, 4 and 5 words are counted by the same tiles.

Text is read once: a block (of about `BLOCK_WORDS` words, by language) becomes a list of its distinct words and the
words' places in that list. Lists, never words by occurrence, meet the numbers: words bucket by bucket of their checksum,
pairs tile by tile; the bucket's or tile's numbers come first in the stream, the blocks' words or cells after them. A
whole text lies in one block.
Numbers have 31 bits: more frequent phrases of one length in a language raise an error.

Null texts are empty, a null language is `und`. Repeated rows count as often as they occur. Ties of rank are ordered by
phrase. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, at_blanks, packed, query, rows_of, table, unpacked
from millrace.llm.tokens import Numbers
from millrace.operators.ordering import numbered, top_per_group

BLOCK_WORDS = 1 << 21
#: A tile's side is 2 to this power.
BITS = 11
SIDE = 1 << BITS
#: A tile is dense where a block has that many of its pairs, and where its list has that many cells.
DENSE_PAIRS, DENSE_CELLS = SIDE * SIDE // 32, SIDE * SIDE // 4
#: First tiles of either side that are looked at for dense ones.
HEAD = 8
#: Owners of a tile in the first step of its sum.
OWNERS = 16
#: Words with numbers that a bucket holds, about; their lists are the memory of a task.
BUCKET_WORDS = 1 << 16

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(_BREAKS + b"\t", b"." * len(_BREAKS) + b" ")


def split_words(text: bytes) -> list[bytes]:
    """Words in lower case, and a full stop between pieces."""
    return text.lower().translate(_PLAIN).replace(b".", b" . ").split()  # bytes.lower knows A to Z only


def _row(values: tuple, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) if not isinstance(v, np.ndarray) else pa.ListArray.from_arrays([0, len(v)], pa.array(v, f.type.value_type)) for v, f in zip(values, schema, strict=True)], schema=schema)


_WORDS = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("keys", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("codes", pa.binary())])
#: A block's places in its list of pairs (`tx` -1), and the cells of that list by tile, which are numbered from `first`.
_PAIRS = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("tx", pa.int32()), ("ty", pa.int32()), ("first", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary()), ("codes", pa.binary())])
_PAIRS_DDL = "block long, lang string, tx int, ty int, first int, cells binary, counts binary, codes binary"


def _encoded(block_words: int):
    """Blocks of (lang, text): distinct words, how often each occurs, and places in that list from 1, 0 between pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        numbers: dict[str, Numbers] = {}
        codes: dict[str, list[np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for lang, known in numbers.items():
                flat = np.concatenate([*codes[lang], np.zeros(0, np.int32)])
                words = b"\n".join(known).decode().split("\n")[1:]  # no word holds a line feed
                counts = np.bincount(flat, minlength=len(known))[1:]
                yield _row((part << 32 | made, lang, np.array(words, object), counts, packed(flat)), _WORDS)
                made += 1
            numbers.clear()
            codes.clear()

        total = 0
        for batch in rows_of(batches, 4096):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                if lang not in numbers:
                    numbers[lang], codes[lang] = Numbers({b".": 0}), []
                for some in at_blanks(b".".join([*texts, b""])):
                    words = split_words(some)
                    codes[lang].append(np.fromiter(map(numbers[lang].__getitem__, words), np.int32, len(words)))
                    total += len(words)
            if total >= block_words:
                yield from flush()
                total = 0
        yield from flush()

    return run


def tiled(x: np.ndarray, y: np.ndarray, least: int = DENSE_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, the cells of a tile side by side and sorted, as `tx << 42 | ty << 22 | cell`; how often each occurs;
    and each pair's place in that list from 1."""
    code = np.zeros(len(x), np.int32)
    keys, counts, n = [], [], 0
    tx, ty = x >> BITS, y >> BITS
    cell = (x & (SIDE - 1)) << BITS | (y & (SIDE - 1))
    head = (tx < HEAD) & (ty < HEAD)
    tile = np.where(head, tx * HEAD + ty, -1)
    for t in np.flatnonzero(np.bincount(tile[head], minlength=1) >= least):
        here = np.flatnonzero(tile == t)
        count = np.bincount(cell[here], minlength=SIDE * SIDE)
        found = np.flatnonzero(count)
        place = np.zeros(SIDE * SIDE, np.int32)
        place[found] = np.arange(n + 1, n + 1 + len(found))
        code[here] = place[cell[here]]
        keys.append((t // HEAD) << 42 | (t % HEAD) << 22 | found)
        counts.append(count[found])
        n += len(found)
    rest = np.flatnonzero(code == 0)
    found, place, count = np.unique(tx[rest] << 42 | ty[rest] << 22 | cell[rest], return_inverse=True, return_counts=True)
    code[rest] = place + n + 1
    return np.concatenate([*keys, found]).astype(np.int64), np.concatenate([*counts, count]).astype(np.int64), code


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _next(block: int, lang: str, flat: np.ndarray, at: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The pairs of a block whose places `at` of its list have numbers: the tiles' cells, and the places in their list."""
    number = np.full(int(flat.max(initial=0)) + 1, -1, np.int64)
    number[at] = ids
    found = number[flat]
    both = np.flatnonzero((found[:-1] >= 0) & (found[1:] >= 0))
    if not len(both):
        return
    keys, counts, code = tiled(found[both], found[both + 1])
    starts = np.flatnonzero(np.r_[True, keys[1:] >> 22 != keys[:-1] >> 22])
    rows = []
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
        t = int(keys[s]) >> 22
        rows.append((block, lang, t >> 20, t & 0xFFFFF, s + 1, packed((keys[s:e] & 0x3FFFFF).astype(np.uint32)), packed(counts[s:e]), None))
        if len(rows) == 1024:
            yield _rows(rows, _PAIRS)
            rows = []
    if rows:
        yield _rows(rows, _PAIRS)
    out = np.zeros(len(flat) - 1, np.int32)
    out[both] = code
    yield _rows([(block, lang, -1, -1, 0, None, None, packed(out))], _PAIRS)


def _pairs_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks (block, lang, codes, at, ids) of which rows with numbers come before the row with places."""
    seen, at, ids = None, [], []
    for batch in rows_of(batches):
        for block, lang, codes, a, i in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if block != seen:
                seen, at, ids = block, [], []
            if codes is None:
                at.append(unpacked(a, np.int32))
                ids.append(unpacked(i, np.int32))
            elif at:
                yield from _next(block, lang, unpacked(codes, np.int32), np.concatenate(at), np.concatenate(ids))
                seen, at, ids = None, [], []


_TILE = "lang string, tx int, ty int, owner int, cells binary, counts binary"
_TILES = pa.schema([("lang", pa.string()), ("tx", pa.int32()), ("ty", pa.int32()), ("owner", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])


class Tile:
    """Counts of a tile's cells: a list of coordinates, and a dense array once that is smaller."""

    def __init__(self):
        self.cells, self.counts, self.size, self.dense = [], [], 0, None

    def add(self, cells: np.ndarray, counts: np.ndarray) -> None:
        """Counts of cells that are all different."""
        if self.dense is not None:
            self.dense[cells] += counts
            return
        self.cells.append(cells)
        self.counts.append(counts)
        self.size += len(cells)
        if self.size > DENSE_CELLS:
            cells, counts = self.sums()
            self.cells, self.counts, self.size = [cells], [counts], len(cells)
            if self.size > DENSE_CELLS // 2:
                self.dense = np.zeros(SIDE * SIDE, np.int64)
                self.dense[cells] = counts

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        if self.dense is not None:
            cells = np.flatnonzero(self.dense)
            return cells.astype(np.uint32), self.dense[cells]
        cells, counts = np.concatenate(self.cells), np.concatenate(self.counts)
        order = np.argsort(cells, kind="stable")
        cells = cells[order]
        starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        return cells[starts], np.add.reduceat(counts[order], starts)


_FOUND = pa.schema([("lang", pa.string()), ("x", pa.int64()), ("y", pa.int64()), ("f", pa.int64())])


def _summed(least: int | None):
    """Sums of tiles that come sorted: tiles again, or the pairs of at least so many occurrences."""

    def done(key: tuple, tile: Tile) -> pa.RecordBatch:
        cells, counts = tile.sums()
        lang, tx, ty = key[:3]
        if least is None:
            return _rows([(lang, tx, ty, 0, packed(cells), packed(counts))], _TILES)
        keep = counts >= least
        cells, counts = cells[keep].astype(np.int64), counts[keep]
        columns = [pa.array([lang] * len(cells), pa.string()), pa.array((cells >> BITS) + tx * SIDE), pa.array((cells & (SIDE - 1)) + ty * SIDE), pa.array(counts)]
        return pa.RecordBatch.from_arrays(columns, schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tile = None, Tile()
        for batch in rows_of(batches):
            for *key, cells, counts in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if at is not None and key != at:
                    yield done(at, tile)
                    tile = Tile()
                at = key
                tile.add(unpacked(cells, np.uint32), unpacked(counts, np.int64))
        if at is not None:
            yield done(at, tile)

    return run


def frequent_pairs(pairs: DataFrame, least: int) -> DataFrame:
    """(lang, x, y, f) of the pairs of numbers with at least so many occurrences in all blocks."""
    key = ["lang", "tx", "ty", "owner"]
    tiles = pairs.where("tx >= 0").select(*key[:3], F.pmod("block", F.lit(OWNERS)).cast("int").alias("owner"), "cells", "counts")
    first = tiles.repartition(*key).sortWithinPartitions(*key).mapInArrow(_summed(None), _TILE)
    return first.repartition(*key[:3]).sortWithinPartitions(*key).mapInArrow(_summed(least), "lang string, x long, y long, f long")


_NUMBERS = pa.schema([("lang", pa.string()), ("tx", pa.int32()), ("ty", pa.int32()), ("cells", pa.binary()), ("ids", pa.binary())])


def _number_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, tx, ty, cell, id) in that order as a row a tile."""
    at, cells, ids = None, [], []

    def done() -> pa.RecordBatch:
        return _rows([(*at, packed(np.concatenate(cells)), packed(np.concatenate(ids)))], _NUMBERS)

    for batch in batches:
        if not batch.num_rows:
            continue
        lang, tx, ty = (batch.column(k).to_pylist() for k in range(3))
        cell, number = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
        keys = list(zip(lang, tx, ty, strict=True))
        starts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1])]
        for s, e in zip(starts, [*starts[1:], len(keys)], strict=True):
            if at is not None and keys[s] != at:
                yield done()
                cells, ids = [], []
            at = keys[s]
            cells.append(cell[s:e].astype(np.uint32))
            ids.append(number[s:e].astype(np.int32))
    if at is not None:
        yield done()


_MET = pa.schema([("block", pa.int64()), ("at", pa.binary()), ("ids", pa.binary())])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles (lang, tx, ty, owner, block, first, cells, ids) in order; the row with numbers, of block -1, comes first. The
    places in its block's list of each cell that has a number, and the numbers."""
    at, own, numbers = None, None, None
    for batch in rows_of(batches):
        rows = []
        for *key, block, first, cells, ids in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
            if key != at:
                at, own = key, None
            cells = unpacked(cells, np.uint32)
            if block < 0:
                own, numbers = cells, unpacked(ids, np.int32)
            elif own is not None:
                place = np.minimum(np.searchsorted(own, cells), len(own) - 1)
                found = np.flatnonzero(own[place] == cells)
                if len(found):
                    rows.append((block, packed((found + first).astype(np.int32)), packed(numbers[place[found]])))
        if rows:
            yield _rows(rows, _MET)


def _of_numbers(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """The pairs of the next length: of blocks' cells that have numbers, `items` (lang, key, id)."""
    x, y = F.shiftright("key", 32), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))
    cell = F.shiftleft(x.bitwiseAND(F.lit(SIDE - 1)), BITS).bitwiseOR(y.bitwiseAND(F.lit(SIDE - 1)))
    tile = ["lang", "tx", "ty"]
    numbers = items.select("lang", F.shiftright(x, BITS).cast("int").alias("tx"), F.shiftright(y, BITS).cast("int").alias("ty"), cell.alias("cell"), "id")
    numbers = numbers.repartition(*tile).sortWithinPartitions(*tile, "cell").mapInArrow(_number_tiles, "lang string, tx int, ty int, cells binary, ids binary")
    owners = F.explode(F.sequence(F.lit(0), F.lit(OWNERS - 1))).alias("owner")  # each has the tile's numbers
    first = numbers.select(*tile, owners, F.lit(-1).cast("long").alias("block"), F.lit(0).alias("first"), "cells", "ids")
    owner = F.pmod("block", F.lit(OWNERS)).cast("int").alias("owner")
    cells = pairs.where("tx >= 0").select(*tile, owner, "block", "first", "cells", F.lit(None).cast("binary").alias("ids"))
    key = [*tile, "owner"]
    met = first.unionByName(cells).repartition(*key).sortWithinPartitions(*key, "block").mapInArrow(_meet, "block long, at binary, ids binary")
    return _with_codes(met, pairs.where("tx < 0"))


def _numbered(found: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Adds `id`, from 0 by falling frequency in a language."""
    ranked = numbered(found, ["lang"], [F.desc("f"), F.col("phrase")], "id", scratch.path(f"{name}-ranked"))
    few = F.assert_true(F.col("id") < (1 << 31), F.lit("more frequent phrases of one length than numbers"))
    return scratch.write(ranked.withColumn("id", F.coalesce(few.cast("long"), F.col("id") - 1)), name)


_LISTED = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("block", pa.int64()), ("words", pa.list_(pa.binary())), ("at", pa.binary())])


def _by_bucket(buckets: int):
    """The words of blocks (block, lang, keys) by bucket, with their places in the block's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lang, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = np.array(keys.values.cast(pa.binary()).to_pylist(), object)
                bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
                order = np.argsort(bucket, kind="stable").astype(np.int32)
                starts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0]).tolist()
                rows = [(lang, int(bucket[order[s]]), block, words[order[s:e]], packed(order[s:e] + 1)) for s, e in zip(starts, [*starts[1:], len(order)], strict=True)]
                for k in range(0, len(rows), 1024):
                    yield _rows(rows[k : k + 1024], _LISTED)

    return run


def _meet_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets (lang, bucket, block, words, at, id) in order; rows of a word and its number, of block -1, come first."""
    at, numbers = None, {}
    for batch in rows_of(batches, 4096):
        lang, bucket, block, places, ids = (batch.column(k).to_pylist() for k in (0, 1, 2, 4, 5))
        rows = []
        for k, key in enumerate(zip(lang, bucket, strict=True)):
            if key != at:
                at, numbers = key, {}
            words = batch.column(3)[k].values.to_pylist()
            if block[k] < 0:
                numbers[words[0]] = ids[k]
            elif numbers:
                number = np.fromiter((numbers.get(w, -1) for w in words), np.int64, len(words))
                found = np.flatnonzero(number >= 0)
                if len(found):
                    rows.append((block[k], packed(unpacked(places[k], np.int32)[found]), packed(number[found].astype(np.int32))))
        if rows:
            yield _rows(rows, _MET)


def _of_words(blocks: DataFrame, items: DataFrame) -> DataFrame:
    """The pairs of blocks of words, where both are frequent."""
    buckets = max(64, -(-items.count() // BUCKET_WORDS))
    none, word = F.lit(None), F.col("key").cast("binary")
    numbers = items.select(
        "lang", F.pmod(F.crc32(word), F.lit(buckets)).cast("int").alias("bucket"), F.lit(-1).cast("long").alias("block"),
        F.array(word).alias("words"), none.cast("binary").alias("at"), F.col("id").cast("long").alias("id"),
    )
    listed = blocks.select("block", "lang", "keys").mapInArrow(_by_bucket(buckets), "lang string, bucket int, block long, words array<binary>, at binary")
    both = numbers.unionByName(listed.withColumn("id", none.cast("long")))
    key = ["lang", "bucket"]
    met = both.repartition(*key).sortWithinPartitions(*key, "block").select(*key, "block", "words", "at", "id").mapInArrow(_meet_words, "block long, at binary, ids binary")
    return _with_codes(met, blocks)


def _with_codes(met: DataFrame, codes: DataFrame) -> DataFrame:
    """The pairs of blocks, from what their lists have met (block, at, ids) and their places (block, lang, codes)."""
    none = F.lit(None)
    met = met.select("block", none.cast("string").alias("lang"), none.cast("binary").alias("codes"), "at", "ids")
    codes = codes.select("block", "lang", "codes", none.cast("binary").alias("at"), none.cast("binary").alias("ids"))
    both = met.unionByName(codes).repartition("block").sortWithinPartitions("block", F.col("codes").isNotNull())
    return both.mapInArrow(_pairs_of_blocks, _PAIRS_DDL)


def _cut(least_first: int, words: int) -> Column:
    """The cut of the lowest score, the first of equals: (score, k, l, r)."""
    big = lambda c: c.cast("decimal(38,0)")
    cuts = []
    for k in range(least_first, words):
        left, right = F.get("pf", F.lit(k - 1)), F.get("sf", F.lit(words - k - 1))
        over = (big(F.lit(1000)) * big(F.col("f"))).cast("decimal(38,0)") * big(F.col("n"))
        under = big(left) * big(right)
        # exact: integral division of decimals, which have 38 digits
        score = F.call_function("div", over.cast("decimal(38,0)"), under.cast("decimal(38,0)"))
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts)) if len(cuts) > 1 else cuts[0]


def phrases(docs: DataFrame, scratch: Scratch, longest: int = 5, least: int = 100, text_col: str = "text", lang_col: str = "lang", block_words: int = BLOCK_WORDS) -> DataFrame:
    """All phrases of 2 to `longest` words with at least `least` occurrences that no longer one stands for: lang, phrase,
    words, a, l, r, n, score."""
    text, lang = docs[f"`{text_col}`"].cast("string"), docs[f"`{lang_col}`"].cast("string")
    docs = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    ddl = "block long, lang string, keys array<string>, counts array<bigint>, codes binary"
    blocks = scratch.write(docs.mapInArrow(_encoded(block_words), ddl), "words")
    listed = blocks.select("lang", F.explode(F.arrays_zip("keys", "counts")).alias("w"))
    counted = scratch.write(listed.groupBy("lang", F.col("w.keys").alias("key")).agg(F.sum("w.counts").alias("f")), "counted")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    word = counted.where(F.col("f") >= least).select("lang", "key", F.col("key").alias("phrase"), F.col("key").alias("tail"), "f", F.array("f").alias("pf"), F.array("f").alias("sf"))
    items, out = _numbered(word, scratch, "items-1"), []
    for words in range(2, longest + 1):
        made = _of_words(blocks, items) if words == 2 else _of_numbers(blocks, items)
        pairs = scratch.write(made, f"pairs-{words}")
        scratch.drop(blocks)
        blocks = pairs
        found = scratch.write(frequent_pairs(blocks, least), f"found-{words}")
        a, b = items.alias("a"), items.alias("b")
        met = found.alias("p").join(a, (F.col("p.lang") == F.col("a.lang")) & (F.col("p.x") == F.col("a.id"))).join(b, (F.col("p.lang") == F.col("b.lang")) & (F.col("p.y") == F.col("b.id")))
        longer = met.select(
            "p.lang", F.shiftleft("p.x", 32).bitwiseOR(F.col("p.y")).alias("key"), F.concat("a.phrase", F.lit(" "), "b.tail").alias("phrase"), F.col("b.tail").alias("tail"), "p.f",
            F.concat("a.pf", F.array("p.f")).alias("pf"), F.concat("b.sf", F.array("p.f")).alias("sf"),
        )
        if words > 2:
            # a longer phrase that occurs as often stands for its parts; one word more is enough, as those between occur as often
            parts = met.select("p.lang", F.explode(F.array(F.struct(F.col("a.id"), F.col("a.f")), F.struct(F.col("b.id"), F.col("b.f")))).alias("part"), "p.f").where("f >= part.f")
            out.append(items.join(parts.select("lang", F.col("part.id").alias("id")).distinct(), ["lang", "id"], "left_anti").withColumn("words", F.lit(words - 1)))
        items = _numbered(longer, scratch, f"items-{words}")
    out.append(items.withColumn("words", F.lit(longest)))
    scored = []
    for df, words in zip(out, range(2, longest + 1), strict=True):
        cut = df.join(totals, "lang").withColumn("cut", _cut(1, words))
        scored.append(cut.select("lang", "phrase", "words", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score"))
    whole = scored[0]
    for df in scored[1:]:
        whole = whole.unionByName(df)
    return whole


def best_phrases(docs: DataFrame, scratch: Scratch, most: int = 2000, **options) -> DataFrame:
    """Each language's first `most` phrases by score, occurrences and phrase, with their rank."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    return top_per_group(phrases(docs, scratch, **options), ["lang"], order, most)


_SQL = """
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS ws FROM d
), t AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase, list_slice(ws, i, i + k - 1) AS ws
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k))
), f AS (SELECT lang, k, phrase, any_value(ws) AS ws, count(*)::HUGEINT AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
longer AS (
  SELECT DISTINCT p.lang, p.phrase FROM f q, (SELECT 0 AS s UNION ALL SELECT 1) x, f p
  WHERE p.lang = q.lang AND p.k = q.k - 1 AND p.a = q.a AND p.phrase = array_to_string(list_slice(q.ws, 1 + s, q.k - 1 + s), ' ')
), cuts AS (
  SELECT f.lang, f.phrase, f.a, f.k, f.ws, c FROM f, (SELECT unnest(range(1, 5)) AS c) WHERE f.k > 1 AND c < f.k
), s AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, l.a AS l, r.a AS r, t.n, (1000 * cuts.a * t.n) // (l.a * r.a) AS score, c
  FROM cuts JOIN t USING (lang)
  JOIN f l ON l.lang = cuts.lang AND l.phrase = array_to_string(list_slice(cuts.ws, 1, c), ' ')
  JOIN f r ON r.lang = cuts.lang AND r.phrase = array_to_string(list_slice(cuts.ws, c + 1, cuts.k), ' ')
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
o AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM b ANTI JOIN longer USING (lang, phrase)
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM o WHERE rank <= 2000
"""


@query("op12_collocations", _SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = best_phrases(table(spark, sf_dir, "documents"), Scratch(spark, "collocations"))
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
