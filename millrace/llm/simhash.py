"""Near-duplicates by SimHash with deletion-variant signatures.

Two fingerprints of 64 bits that differ in at most k bits, cut into k // 2 + 1 segments, differ in at most one bit of
some segment. So every segment is indexed once for each of its bits with that bit wiped out; two segments that differ
in one bit are equal in the variant without it. Rows with equal variants meet through an equality shuffle, and the
whole fingerprints are compared there. A group does not emit its pairs but a spanning forest of its links, which
keeps the components and grows with the group, not with its square.

Null and empty texts, and texts of blanks, have fingerprint zero and are linked like any other. Repeated rows share a
fingerprint. A null id is never a component's smallest while the component has another. Texts are hashed whole, in blocks
of shingles. Empty tables give empty results. Other columns are not read, or pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import Scratch, components, query, rows_of, table, thrifty

SEED = 42


def shingle_hashes(data: bytes | None, shingle: int = 3, block: int = 1 << 15) -> Iterator[np.ndarray]:
    """Hashes of a UTF-8 text's shingles, repeats included, in blocks: ASCII letters in lower case, words at ASCII
    blanks; fewer words than a shingle has are one."""
    words = (data or b"").lower().split()
    if not words:
        return
    joined, n = b" ".join(words), max(len(words) - shingle + 1, 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends, digest = ends[-n:].tolist(), xxhash.xxh64_intdigest
    for at in range(0, n, block):
        yield np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + block], ends[at : at + block], strict=True)], np.uint64)


def fingerprint_of(blocks: list[np.ndarray]) -> int:
    """A bit is set if over half the hashes set it."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in blocks:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.uint32)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprint(data: bytes | None, shingle: int = 3) -> int:
    return fingerprint_of(list(shingle_hashes(data, shingle)))


def commonness(docs: DataFrame, text_col: str, shingle: int, sample_rows: int = 10_000, most: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of the commonest shingles of a sample. They only order shingles: any numbers would give
    the same links, these keep stock phrases out of the keys."""
    texts = docs.select(docs[f"`{text_col}`"].cast("string").alias("text"))
    share = min(1.0, sample_rows / max(texts.count(), 1))
    texts = texts.filter(F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(1 << 20)) < int(share * (1 << 20)))

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            sets = [np.unique(b) for x in batch.column(0).cast(pa.binary()).to_pylist() for b in shingle_hashes(x, shingle)]
            hashes, counts = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts.astype(np.int64))], names=["hash", "n"])

    counted = texts.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where("n > 2")
    found = counted.orderBy(F.desc("n"), "hash").limit(most).collect()
    hashes, counts = (np.array([r[k] for r in found], np.int64) for k in ("hash", "n"))
    order = np.argsort(hashes.view(np.uint64))
    return hashes.view(np.uint64)[order], counts[order]


def prefix_keys(hashes: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The rarest shingles of a set, as many as a similar set must hold one of among its own: with all shingles in one
    order, two sets of that similarity share one of their first n - ceil(similarity * n) + 1."""
    listed, counts = common
    weight = np.zeros(len(hashes), np.int64)
    if len(listed):
        at = np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)
        weight = np.where(listed[at] == hashes, counts[at], 0)
    n = len(hashes)
    return hashes[np.lexsort((hashes, weight))[: n - int(np.ceil(similarity * n - 1e-9)) + 1]].view(np.int64)


#: Bytes of the least parities that pairs of a key are looked through with, before whole ones are compared.
SHORT = 64


def short_bytes(n: int) -> int:
    """As many buckets as shingles, so that dissimilar sets of any size are told apart."""
    return max(SHORT, 1 << max((int(n) - 1).bit_length() - 3, 0))


def parities(hashes: np.ndarray) -> bytes:
    """Whether buckets hold an odd number of a set's shingles, two buckets or more to a shingle. Two sets differ in as
    many shingles as buckets at least; the halves of a longer one, added, are the shorter one."""
    width = max(8 * SHORT, 1 << (2 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def folded(data: bytes, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(np.frombuffer(data, np.uint64).reshape(-1, size // 8), axis=0)


def most_apart(n, m, similarity: float):
    """Shingles that are in one of two sets of n and m only, at most, if they are that similar."""
    return (n + m) * (1 - similarity) / (1 + similarity) + 1e-6


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = 3, similarity: float | None = None) -> DataFrame:
    """(row, fp): the whole row as a struct and its fingerprint as a signed long. With a similarity also n, the number
    of its distinct shingles, their prefix keys and their parities."""
    df = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[f"`{text_col}`"].cast("string").alias("text"))
    common = None if similarity is None else commonness(docs, text_col, shingle)
    fields = [df.schema["row"], T.StructField("fp", T.LongType())]
    if similarity is not None:
        fields += [T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("odd", T.BinaryType())]

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            blocks = [list(shingle_hashes(x, shingle)) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            columns = [batch.column(0), pa.array(np.array([fingerprint_of(b) for b in blocks], np.uint64).view(np.int64))]
            if similarity is not None:
                sets = [np.unique(np.concatenate(b)) if b else None for b in blocks]
                columns.append(pa.array([0 if x is None else len(x) for x in sets], pa.int64()))
                columns.append(pa.array([None if x is None else prefix_keys(x, similarity, common) for x in sets], pa.list_(pa.int64())))
                columns.append(pa.array([None if x is None else parities(x) for x in sets], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return df.mapInArrow(run, T.StructType(fields))


def variants(fp: Column, k: int, bits: int = 64) -> Column:
    """Keys of the fingerprint: for each segment and each of its bits, the segment without that bit."""
    n = k // 2 + 1
    cuts = [bits * i // n for i in range(n + 1)]
    keys = []
    for low, high in zip(cuts, cuts[1:], strict=False):
        width = high - low
        if width > 56:
            raise ValueError("a key needs segments of at most 56 bits: k is 2 or more")
        segment = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            wiped = segment.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit)))
            keys.append(wiped.bitwiseOR(F.lit((low + bit) << width)) if width <= 32 else F.xxhash64(F.lit(low + bit), wiped))
    return F.array(*keys)


def spanning(prints: np.ndarray, k: int) -> Iterator[tuple[np.uint64, np.ndarray]]:
    """Of distinct fingerprints: a searched one and those first reached from it over a link of at most k bits.

    Each search step compares one fingerprint with all that aren't reached yet, so dense groups shrink fast."""
    left = prints
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(left ^ at) <= k
            if near.any():
                reached = left[near]
                yield at, reached
                frontier.extend(reached)
                left = left[~near]


def _links(k: int):
    """Spanning forests of the links of fingerprints with one key."""

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_key, kept_fp = np.empty(0, np.int64), np.empty(0, np.uint64)

        def linked(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
            sizes = np.diff(np.r_[starts, len(keys)])
            two = starts[sizes == 2]
            a, b = prints[two], prints[two + 1] if len(two) else prints[two]
            near = np.bitwise_count(a ^ b) <= k
            left, right = [a[near]], [b[near]]
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
                own = np.unique(prints[s : s + n])
                for at, reached in spanning(own, k):
                    left.append(np.full(len(reached), at, np.uint64))
                    right.append(reached)
            out = [pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)]
            return pa.RecordBatch.from_arrays(out, names=["a", "b"])

        for batch in batches:
            keys = np.concatenate((kept_key, batch.column(0).to_numpy(zero_copy_only=False)))
            prints = np.concatenate((kept_fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            if not len(keys):
                continue
            whole = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            yield linked(keys[:whole], prints[:whole])
            kept_key, kept_fp = keys[whole:], prints[whole:]
        yield linked(kept_key, kept_fp)

    return run


class _Shorts:
    """Parities of rows, by their width."""

    def __init__(self, rows: np.ndarray):
        self.width = np.fromiter(map(len, rows), np.int64, len(rows))
        self.place, self.of = np.zeros(len(rows), np.int64), {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.place[at] = np.arange(len(at))
            self.of[w] = np.frombuffer(b"".join(rows[at]), np.uint64).reshape(-1, w // 8)

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Buckets in which rows x and y differ; a longer parity is folded to the other's width."""
        out = np.empty(len(x), np.int64)
        both = self.width[x] << 32 | self.width[y]
        for key in np.unique(both).tolist():
            at = np.flatnonzero(both == key)
            for some in np.array_split(at, len(at) // (1 << 14) + 1):
                a, b = self.of[key >> 32][self.place[x[some]]], self.of[key & 0xFFFFFFFF][self.place[y[some]]]
                w = min(a.shape[1], b.shape[1])
                a, b = (np.bitwise_xor.reduce(c.reshape(len(c), -1, w), axis=1) for c in (a, b))
                out[some] = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
        return out


def _windows(low: int, high: int, similarity: float):
    """Pairs of rows (key, fp, n, root, short) of one key that stand `low` places or more and fewer than `high` apart in
    their order by n, have different roots, and by their sizes and parities may be that similar: (null, a, b). Before
    them, if there are keys with more rows than that, these rows: (key, fp, n)."""

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def out(key: np.ndarray | None, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            key = pa.nulls(len(a), pa.int64()) if key is None else pa.array(key)
            return pa.RecordBatch.from_arrays([key, pa.array(a), pa.array(b)], names=["key", "a", "b"])

        def paired(key, fp, n, root=None, short=None) -> Iterator[pa.RecordBatch]:
            at, shorts = np.arange(len(key)), None if short is None else _Shorts(short)
            if low == 1 and len(key):
                new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                sizes = np.diff(np.r_[new, len(key)])
                more = np.repeat(sizes > high, sizes)
                yield out(key[more], fp[more], n[more])
            if low > 1:
                at = at[at + low - 1 < len(key)]
                at = at[key[at] == key[at + low - 1]]
            for d in range(low, high):
                at = at[at + d < len(key)]
                at = at[key[at] == key[at + d]]
                at = at[n[at] >= similarity * n[at + d] - 1e-6]  # rows further on are larger still
                if not len(at):
                    break
                for some in np.array_split(at, len(at) // (1 << 18) + 1):
                    x, y = some, some + d
                    if root is not None:
                        ok = root[x] != root[y]
                        x, y = x[ok], y[ok]
                        ok = shorts.apart(x, y) <= most_apart(n[x], n[y], similarity)
                        x, y = x[ok], y[ok]
                    if len(x):
                        yield out(None, np.minimum(fp[x], fp[y]), np.maximum(fp[x], fp[y]))

        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(min(batch.num_columns, 4))]
            if batch.num_columns > 4:
                now.append(np.array([*batch.column(4).to_pylist(), None], object)[:-1])
            now = [np.concatenate(x) for x in zip(kept, now, strict=True)] if kept else now
            if not len(now[0]):
                continue
            whole = int(np.searchsorted(now[0], now[0][-1]))  # the last key may go on in the next batch
            yield from paired(*[x[:whole] for x in now])
            kept = [x[whole:] for x in now]
        if kept:
            yield from paired(*kept)

    return run


def _verified(pairs: DataFrame, rows: DataFrame, firsts: DataFrame, sets: DataFrame, scratch: Scratch, similarity: float, shingle: int) -> DataFrame:
    """The pairs (a, b) of fingerprints whose shingle sets are that similar: those that parities don't rule out are
    compared themselves."""

    @thrifty
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 4096):
            _, _, n, m, odd, other = (batch.column(k).to_pylist() for k in range(6))
            sizes = [min(len(x), len(y)) for x, y in zip(odd, other, strict=True)]
            apart = [int(np.bitwise_count(folded(x, s) ^ folded(y, s)).sum(dtype=np.int64)) for x, y, s in zip(odd, other, sizes, strict=True)]
            keep = [k <= most_apart(p, q, similarity) for k, p, q in zip(apart, n, m, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    @thrifty
    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            keep = []
            for x, y in zip(*(batch.column(k).cast(pa.binary()).to_pylist() for k in (2, 3)), strict=True):
                p, q = (np.unique(np.concatenate([*shingle_hashes(t, shingle), np.empty(0, np.uint64)])) for t in (x, y))
                shared = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(shared >= similarity * (len(p) + len(q) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("odd").alias("oa")), "a")
    both = both.join(sets.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("ob")), "b")
    pairs = scratch.write(both.select("a", "b", "na", "nb", "oa", "ob").mapInArrow(near, "a long, b long"), "pairs")
    paired = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(firsts, "fp").select("fp", F.col("first").alias("uid"))
    paired = scratch.write(paired, "paired")
    text = scratch.write(rows.select("uid", "text").join(paired, "uid").select("fp", "text"), "texts")
    both = pairs.join(text.select(F.col("fp").alias("a"), F.col("text").alias("ta")), "a").join(text.select(F.col("fp").alias("b"), F.col("text").alias("tb")), "b")
    links = scratch.write(both.select("a", "b", "ta", "tb").mapInArrow(alike, "a long, b long"), "links")
    scratch.drop(pairs, paired, text)
    return links


def similar_links(rows: DataFrame, scratch: Scratch, similarity: float, shingle: int, window: int = 4) -> DataFrame:
    """(a, b) of fingerprints whose shingle sets are that similar, for rows (uid, fp, text, n, keys, odd): enough of them
    to connect all that are.

    At a similarity of 0.8 fingerprints differ in about ten bits, of which no segment tells. So sets are joined by their
    prefix keys instead, of which similar sets share one. Rows of a key are paired with the next few in its order by
    size, the pairs are verified on the sets and what is linked is contracted; keys that still have rows of several
    components go on with those further apart, until each pair of a key is in one component, verified or ruled out by
    sizes or parities, which rule out no similar pair. One text stands for all of a fingerprint, which link anyway."""
    narrow = rows.select("uid", "fp")
    firsts = scratch.write(narrow.groupBy("fp").agg(F.min("uid").alias("first")), "firsts")
    # fewer rows are left out than stay, so the wide side may be spared a shuffle
    copies = scratch.write(narrow.join(firsts, "fp").where("uid <> first").select("uid"), "copies")
    sole = rows.select("uid", "fp", "n", "keys", "odd").join(copies, "uid", "left_anti")
    sets = scratch.write(sole.where("n > 0").select("fp", "n", "odd"), "sets")
    keyed = sole.select(F.explode("keys").alias("key"), "fp", "n").repartition("key").sortWithinPartitions("key", "n", "fp")
    found = scratch.write(keyed.mapInArrow(_windows(1, window, similarity), "key long, a long, b long"), "found")
    # of larger keys: their rows, whose n is beside them in `sets`
    left = found.where("key is not null").select("key", F.col("a").alias("fp"), F.col("b").alias("n"))
    pairs = tried = scratch.write(found.where("key is null").select("a", "b").distinct(), "tried")
    links = _verified(pairs, rows, firsts, sets, scratch, similarity, shingle)
    while not left.isEmpty():
        roots = components(links, scratch)
        rooted = scratch.write(left.join(roots, left["fp"] == roots["node"], "left").select("key", "fp", "n", F.coalesce("root", "fp").alias("root")), "rooted")
        several = rooted.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("least"), F.max("root").alias("last")).where(f"size > {window} and least < last")
        left = scratch.write(rooted.join(several.select("key"), "key", "left_semi"), "left")
        scratch.drop(rooted)
        short = sets.join(left.select("fp").distinct(), "fp", "left_semi").select("fp", "n", "odd").mapInArrow(_shortened, "fp long, short binary")
        keyed = left.join(short, "fp").select("key", "fp", "n", "root", "short").repartition("key").sortWithinPartitions("key", "n", "fp")
        pairs = keyed.mapInArrow(_windows(window, 16 * window, similarity), "key long, a long, b long").select("a", "b").distinct()
        pairs = scratch.write(pairs.join(tried, ["a", "b"], "left_anti"), "tried")
        links = links.unionByName(_verified(pairs, rows, firsts, sets, scratch, similarity, shingle))
        tried, left, window = tried.unionByName(pairs), left.drop("root"), 16 * window
    return links


@thrifty
def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(batches, 4096):
        short = [folded(x, short_bytes(n)).tobytes() for n, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, pa.binary())], names=["fp", "short"])


def classes(prints: DataFrame, scratch: Scratch, k: int = 3, more: DataFrame | None = None) -> DataFrame:
    """(fp, root, component) for rows (id, fp): the least fingerprint and the smallest id that links can reach: those
    of at most k bits, and `more` links (a, b)."""
    distinct = scratch.write(prints.groupBy("fp").agg(F.min("id").alias("id")), "distinct")
    keyed = distinct.select(F.explode(variants(F.col("fp"), k)).alias("key"), "fp")
    links = keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links(k), "a long, b long")
    roots = components(links if more is None else links.unionByName(more), scratch)
    of_root = scratch.write(
        distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "id", F.coalesce("root", "fp").alias("root")), "roots"
    )
    least = of_root.groupBy("root").agg(F.min("id").alias("component"))
    return scratch.write(of_root.join(least, "root").select("fp", "root", "component"), "classes")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, shingle: int = 3) -> DataFrame:
    """One row per row: id, fingerprint (hex) and component_id."""
    scratch = Scratch(docs.sparkSession, "simhash")
    narrow = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))
    rows = scratch.write(with_fingerprint(narrow, "text", shingle).select("row.id", "fp"), "prints")
    found = classes(rows, scratch, k)
    return rows.join(found, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, shingle: int = 3, similarity: float | None = None) -> DataFrame:
    """The rows with one of each component left: the one of the smallest id, and of repeated ids any one. With a
    `similarity`, texts whose shingle sets are that similar are linked as well."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = with_fingerprint(docs, text_col, shingle, similarity).withColumn("uid", F.monotonically_increasing_id())
    rows = scratch.write(rows, "rows")  # which fixes the uid
    narrow = rows.select(F.col("row")[id_col].alias("id"), "fp", "uid")
    more = None
    if similarity is not None:
        linking = Scratch(docs.sparkSession, "simhash-links")
        more = scratch.write(similar_links(rows.select("uid", "fp", F.col("row")[text_col].alias("text"), "n", "keys", "odd"), linking, similarity, shingle), "more")
        linking.clear()
    found = classes(narrow, scratch, k, more)
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("uid"))
    named = scratch.write(narrow.join(found, "fp").select("uid", "id", "root"), "named")
    kept = named.groupBy("root").agg(F.min(order)["uid"].alias("uid"))
    dropped = scratch.write(named.join(kept, "uid", "left_anti").select("uid"), "dropped")
    out = Scratch(docs.sparkSession, "simhash-kept").write(rows.join(dropped, "uid", "left_anti").select("row.*"), "out")
    scratch.clear()
    return out


@query("op4_simhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
