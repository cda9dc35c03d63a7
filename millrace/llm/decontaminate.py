"""Benchmark decontamination by latent semantic retrieval.

Benchmark items and overlapping windows of the documents are passages, weighted by TF-IDF over the items' words; the
document frequencies come from all rows of the corpus. A randomised SVD of the passages gives a latent basis:
one pass over the corpus adds up the products of terms (A'A), which are written; tasks multiply them by a random matrix,
the results meet in one small QR step, and a second product refines it. Every passage is then projected, and the items whose latent cosine with it is high enough
become candidates. Each candidate is verified on the words themselves: the longest common subsequence of item and
document around the passage must hold most of the item, and so must that of the item's answer, its last words.

Items are handled in blocks of at most `block_items`, each with its own words and basis, so what a task holds does not
grow with the benchmark. The basis is fitted on every passage of the table and on the items, whose own directions all
stay in it; frequencies, search and verification cover every passage as well.

A text is searched whole, in windows. Null and empty texts match nothing; items without a word are never found; repeated items and rows each count. Empty
tables give empty results. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, packed, query, rows_of, table, thrifty, unpacked

WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for x in b:
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


class Items:
    """A block of benchmark items: ids, words, and the vocabulary that all vectors are over."""

    def __init__(self, rows: list[tuple], size: int, step: int):
        self.ids = [i for i, _ in rows]
        words = [words_of(t) for _, t in rows]
        self.terms = {w: k for k, w in enumerate(sorted({w for ws in words for w in ws}))}
        self.rows = [np.array([self.terms[w] for w in ws], np.int64) for ws in words]
        self.passage, self.term, self.owner, _ = passages(self.rows, size, step, max(len(self.terms), 1))


def windows_of(lengths: np.ndarray, size: int, step: int) -> np.ndarray:
    """Number of windows that cover texts of so many words: each but the first adds `step` words."""
    return np.maximum((lengths - size + 2 * step - 1) // step, 1)


def passages(rows: list[np.ndarray], size: int, step: int, n_terms: int, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of term numbers (negative: a word of no item): passage and term of all distinct pairs, in order, and
    the text and first word of all passages. `use` tells the terms that count."""
    lengths = np.array([len(x) for x in rows], np.int64)
    counts = windows_of(lengths, size, step)
    base = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(lengths)), counts)
    start = (np.arange(len(text)) - base[text]) * step if len(text) else text
    flat = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)
    hit = flat >= 0 if use is None else (flat >= 0) & use[flat]
    hit = np.flatnonzero(hit)
    where = np.searchsorted(np.cumsum(lengths), hit, "right")
    local = hit - (np.cumsum(lengths) - lengths)[where]
    pairs = [np.empty(0, np.int64)]
    for back in range(size // step):
        number = local // step - back
        ok = (number >= 0) & (number < counts[where])
        pairs.append((base[where[ok]] + number[ok]) * n_terms + flat[hit[ok]])
    pair = np.unique(np.concatenate(pairs))
    return pair // n_terms, pair % n_terms, text, start


def project(passage: np.ndarray, term: np.ndarray, idf: np.ndarray, scaled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passages with a term, their unit TF-IDF vectors times a basis); `scaled` is the basis times IDF."""
    if not len(passage):
        return passage, np.empty((0, scaled.shape[1]), np.float32)
    new = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
    norm = np.sqrt(np.add.reduceat(idf[term] ** 2, new))
    counts = np.diff(np.r_[new, len(passage)])
    out = np.empty((len(new), scaled.shape[1]), np.float32)
    for n in np.unique(counts).tolist():  # passages of n terms are one array
        at = np.flatnonzero(counts == n)
        out[at] = scaled[term[new[at, None] + np.arange(n)]].sum(1)
    return passage[new], out / norm[:, None]


def _pieces(passage: np.ndarray, most: int = 1 << 13):
    """Slices of pairs that hold whole passages."""
    at = 0
    while at < len(passage):
        end = min(at + most, len(passage))
        if end < len(passage):
            last = int(np.searchsorted(passage, passage[end - 1]))
            end = last if last > at else int(np.searchsorted(passage, passage[at], "right"))
        yield slice(at, end)
        at = end


def _gram(passage: np.ndarray, term: np.ndarray, idf: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """(A'A) omega for the unit TF-IDF rows A."""
    out, scaled = np.zeros_like(omega), idf[:, None] * omega
    for part in _pieces(passage):
        p, t = passage[part], term[part]
        _, rows = project(p, t, idf, scaled)
        new = np.r_[True, p[1:] != p[:-1]]
        number = np.cumsum(new) - 1
        norm = np.sqrt(np.add.reduceat(idf[t] ** 2, np.flatnonzero(new)))
        order = np.argsort(t, kind="stable")
        first = np.flatnonzero(np.r_[True, t[order][1:] != t[order][:-1]])
        share = rows[number[order]] * (idf[t[order]] / norm[number[order]])[:, None]
        out[t[order][first]] += np.add.reduceat(share, first, axis=0)
    return out


TERMS = pa.schema([("uid", pa.int64()), ("terms", pa.binary())])


def _to_terms(terms: dict[str, int]):
    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = terms.get
        for batch in rows_of(batches, 4096):
            rows = [packed(np.array([get(w, -1) for w in words_of(t)], np.int32)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], schema=TERMS)

    return run


def _term_batches(batches: Iterator[pa.RecordBatch], at: int = 1, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in rows_of(batches, 512):
        yield batch, [unpacked(x, np.int32) for x in batch.column(at).to_pylist()]


FREQUENCIES = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("total", pa.binary())])


def _frequencies(n_terms: int, cut: int = 4096):
    """Each task's texts and document frequencies, in rows of `cut` terms that add up elsewhere."""

    @thrifty
    def run(batches):
        total, n = np.zeros(n_terms, np.int64), 0
        for _, rows in _term_batches(batches):
            text = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
            flat = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)
            total += np.bincount(np.unique(text[flat >= 0] * n_terms + flat[flat >= 0]) % n_terms, minlength=n_terms)
            n += len(rows)
        parts = range(0, max(n_terms, 1), cut)
        columns = [[k // cut for k in parts], [n] * len(parts), [packed(total[k : k + cut]) for k in parts]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FREQUENCIES, strict=True)], schema=FREQUENCIES)

    return run


@thrifty
def _counted(group: pa.Table) -> pa.Table:
    """The sum of all tasks' rows of a part."""
    n = sum(group["n"].to_pylist())
    total = np.add.reduce([unpacked(x, np.int64) for x in group["total"].to_pylist()])
    return pa.table([pa.array(c, f.type) for c, f in zip(([group["part"][0].as_py()], [n], [packed(total)]), FREQUENCIES, strict=True)], schema=FREQUENCIES)


PAIRS = pa.schema([("part", pa.int64()), ("code", pa.binary()), ("value", pa.binary())])
#: Terms of which a row holds the products with all others.
PART = 128


def _products(passage: np.ndarray, term: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of the weights of any two terms of a passage, under first term * terms + second, the first no larger; a
    term's own product by half, as it counts from both sides."""
    new = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
    counts = np.diff(np.r_[new, len(passage)])
    weight = idf[term] / np.repeat(np.sqrt(np.add.reduceat(idf[term] ** 2, new)), counts)
    codes, values = [], []
    for n in np.unique(counts).tolist():  # passages of n terms are one array; their terms ascend
        at = new[counts == n, None] + np.arange(n)
        i, j = np.triu_indices(n)
        t, w = term[at], weight[at]
        codes.append((t[:, i] * len(idf) + t[:, j]).ravel())
        values.append((w[:, i] * w[:, j] * np.where(i == j, 0.5, 1.0)).ravel())
    return np.concatenate(codes), np.concatenate(values)


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each code once, in order, with the sum of its values."""
    codes, values = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[first], np.add.reduceat(values[order], first)


def _pairs(idf: np.ndarray, use: np.ndarray, size: int, step: int, most: int = 1 << 20):
    """Each task's share of A'A for the unit TF-IDF rows A, in rows of `PART` terms that add up elsewhere; what grows too
    large to hold is told in between."""
    n_terms = len(idf)

    def told(held) -> pa.RecordBatch:
        codes, values = _summed(held)
        edges = np.arange(-(-n_terms // PART) + 1) * (PART * n_terms)
        at = np.searchsorted(codes, edges)
        parts = [k for k in range(len(edges) - 1) if at[k] < at[k + 1]]
        columns = (
            parts,
            [packed((codes[at[k] : at[k + 1]] - edges[k]).astype(np.int64)) for k in parts],
            [packed(values[at[k] : at[k + 1]].astype(np.float64)) for k in parts],
        )
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PAIRS, strict=True)], schema=PAIRS)

    @thrifty
    def run(batches):
        held, n = [], 0
        for _, rows in _term_batches(batches):
            passage, term, _, _ = passages(rows, size, step, n_terms, use)
            for part in _pieces(passage):
                held.append(_products(passage[part], term[part], idf))
                n += len(held[-1][0])
                if n > most:
                    held = [_summed(held)]
                    n = len(held[0][0])
                    if n > most // 2:
                        yield told(held)
                        held, n = [], 0
        if held:
            yield told(held)

    return run


@thrifty
def _pairs_added(group: pa.Table) -> pa.Table:
    """The sum of all tasks' rows of a part."""
    rows = zip(group["code"].to_pylist(), group["value"].to_pylist(), strict=True)
    codes, values = _summed([(unpacked(c, np.int64), unpacked(v, np.float64)) for c, v in rows])
    return pa.table([pa.array(c, f.type) for c, f in zip(([group["part"][0].as_py()], [packed(codes)], [packed(values)]), PAIRS, strict=True)], schema=PAIRS)


def _grams(omega: np.ndarray, cut: int = 512):
    """The share of (A'A) omega of some parts of A'A, in rows of `cut` terms that add up elsewhere."""

    @thrifty
    def run(batches):
        out, n_terms = np.zeros_like(omega), len(omega)
        for batch in rows_of(batches, 1):
            for part, codes, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low, high = part * PART, min((part + 1) * PART, n_terms)
                block = np.zeros((high - low) * n_terms, np.float32)
                block[unpacked(codes, np.int64)] = unpacked(values, np.float64)
                block = block.reshape(-1, n_terms)
                out[low:high] += block @ omega
                out += block.T @ omega[low:high]
        parts = range(0, len(out), cut)
        yield pa.RecordBatch.from_arrays([pa.array([k // cut for k in parts], pa.int64()), pa.array([out[k : k + cut].tobytes() for k in parts], pa.binary())], names=["part", "sums"])

    return run


@thrifty
def _added(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in group["sums"].to_pylist())
    return pa.table({"part": group["part"].slice(0, 1), "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def latent_basis(texts: DataFrame, scratch: Scratch, items: Items, idf: np.ndarray, use: np.ndarray, rank: int, size: int, step: int, item_weight: float, seed: int) -> np.ndarray:
    """Terms by directions: the leading right singular directions of all texts' passages and the weighted items, and
    those that the items' passages have besides, so that the basis holds the items whole: no latent cosine with an item
    is below the plain one."""
    n_terms = len(idf)
    used = use[items.term]
    told = "part long, code binary, value binary"
    pairs = scratch.write(texts.select("uid", "terms").mapInArrow(_pairs(idf, use, size, step), told).groupBy("part").applyInArrow(_pairs_added, told), "pairs")

    def gram(omega: np.ndarray) -> np.ndarray:
        parts = pairs.mapInArrow(_grams(omega), "part long, sums binary")
        rows = parts.groupBy("part").applyInArrow(_added, "part long, sums binary").collect()  # n_terms x rank numbers
        out = np.zeros_like(omega)
        for row in rows:
            x = np.frombuffer(row["sums"], np.float32).reshape(-1, omega.shape[1])
            out[row["part"] * 512 : row["part"] * 512 + len(x)] = x
        return out + item_weight * _gram(items.passage[used], items.term[used], idf, omega)

    width = min(rank + 16, n_terms)
    omega = np.random.default_rng(seed).standard_normal((n_terms, width)).astype(np.float32)
    q = np.linalg.qr(gram(omega))[0].astype(np.float32)
    small = q.T @ gram(q)
    scratch.drop(pairs)
    _, turn = np.linalg.eigh((small + small.T) / 2)
    passage, term = items.passage[used], items.term[used]
    number = np.unique(passage, return_inverse=True)[1]
    own = np.zeros((n_terms, int(number.max(initial=-1)) + 1), np.float32)
    own[term, number] = idf[term]
    own /= np.linalg.norm(own, axis=0)
    return np.linalg.qr(np.hstack((q @ turn[:, ::-1][:, :rank], own)))[0].astype(np.float32)


class Index:
    """What a search task holds: IDF, the basis, the items in it, and what verification needs."""

    def __init__(self, items: Items, idf: np.ndarray, use: np.ndarray, basis: np.ndarray):
        self.items, self.idf, self.use, self.scaled = items, idf, use, idf[:, None] * basis
        used = use[items.term]
        passage, vectors = project(items.passage[used], items.term[used], idf, self.scaled)
        self.owner = items.owner[passage]
        self.vectors = unit(vectors)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def verified(item: np.ndarray, region: np.ndarray, min_share: float, answer_share: float) -> int:
    """Length of the longest common subsequence if it and that of the answer, the item's last quarter but at least
    three words, are long enough; else 0."""
    known = set(item.tolist())
    near = [t for t in region.tolist() if t in known]
    if len(near) < min_share * len(item):
        return 0
    words = item.tolist()
    found = common_subsequence(words, near)
    answer = words[-max(3, len(words) // 4) :]
    return found if found >= min_share * len(words) and common_subsequence(answer, near) >= answer_share * len(answer) else 0


def _search(index: Index, size: int, step: int, min_cosine: float, min_share: float, answer_share: float):
    @thrifty
    def run(batches):
        items = index.items
        for batch, rows in _term_batches(batches):
            passage, term, text, start = passages(rows, size, step, len(index.idf), index.use)
            best: dict[tuple[int, int], tuple[int, float]] = {}
            for part in _pieces(passage):
                number, vectors = project(passage[part], term[part], index.idf, index.scaled)
                cosine = unit(vectors) @ index.vectors.T
                for p, k in zip(*np.nonzero(cosine >= min_cosine), strict=True):
                    t, item, at = int(text[number[p]]), int(index.owner[k]), int(start[number[p]])
                    words = items.rows[item]
                    region = rows[t][max(0, at - len(words)) : at + size + len(words)]
                    n = verified(words, region, min_share, answer_share)
                    if n > best.get((t, item), (0, 0.0))[0]:
                        best[t, item] = (n, float(cosine[p, k]))
            uids = batch.column(0)
            found = [(uids[t].as_py(), items.ids[i], n, len(items.rows[i]), c) for (t, i), (n, c) in best.items()]
            columns = list(zip(*found, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["uid", "item_id", "common", "n_words", "cosine"])

    return run


FOUND = "uid long, item_id long, common long, n_words long, cosine double"


def _item_blocks(benchmark: DataFrame, most_items: int, most_chars: int, step: int, most_windows: int = 512) -> Iterator[list[tuple]]:
    """Items with a word, in blocks of bounded size, one block at a time on the driver."""
    block: list[tuple] = []
    size = windows = 0
    for row in benchmark.toLocalIterator():
        if WORD.search(row["text"] or ""):
            more = len(words_of(row["text"])) // step + 1  # its passages at most, each a direction of the basis
            if block and (len(block) == most_items or size + len(row["text"]) > most_chars or windows + more > most_windows):
                yield block
                block, size, windows = [], 0, 0
            block.append((row["item_id"], row["text"]))
            size += len(row["text"])
            windows += more
    if block:
        yield block


def leaks(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", uid_col: str = "uid", size: int = 64, step: int = 32, rank: int = 256,
    min_cosine: float = 0.3, min_share: float = 0.6, answer_share: float = 0.5, common_term: float = 0.05, block_items: int = 256, block_chars: int = 1 << 20, seed: int = 11,
) -> DataFrame:
    """(uid, item_id, common, n_words, cosine) for each row and item that it leaks: `common` words of the item's
    `n_words` follow in the row's text. Terms in more than `common_term` of all rows don't enter vectors, but for items
    that have fewer than four others; verification reads all words."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    out = spark.createDataFrame([], FOUND)
    for block in _item_blocks(benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")), block_items, block_chars, step):
        items = Items(block, size, step)
        n_terms = len(items.terms)
        texts = docs.select(docs[f"`{uid_col}`"].cast("long").alias("uid"), docs[f"`{text_col}`"].cast("string").alias("text"))
        terms = scratch.write(texts.mapInArrow(_to_terms(items.terms), "uid long, terms binary"), "terms")
        told = "part long, n long, total binary"
        counted = terms.mapInArrow(_frequencies(n_terms), told).groupBy("part").applyInArrow(_counted, told).orderBy("part").collect()  # a number a term
        n = counted[0]["n"] if counted else 0
        df = np.concatenate([unpacked(r["total"], np.int64) for r in counted]) if counted else np.zeros(n_terms, np.int64)
        idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.1)
        use = df <= max(common_term * n, 20)
        for row in items.rows:
            if len(np.unique(row[use[row]])) < 4:
                use[row] = True
        basis = latent_basis(terms, scratch, items, idf, use, rank, size, step, 4.0, seed)
        index = Index(items, idf, use, basis)
        found = terms.mapInArrow(_search(index, size, step, min_cosine, min_share, answer_share), FOUND)
        out = out.unionByName(scratch.write(found, "found"))
        scratch.drop(terms)
    return out


def with_uid(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, uid), written, so that the numbers hold."""
    return scratch.write(docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("uid")), "rows")


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row for each document and item it leaks: id, item_id, common, n_words, cosine."""
    narrow = docs.select(docs[f"`{id_col}`"].alias("uid"), docs[f"`{text_col}`"].alias("text"))
    return leaks(narrow, benchmark, **settings).withColumnRenamed("uid", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """The rows that leak no item, with their own columns."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    rows = with_uid(docs, scratch)
    found = leaks(rows.select("uid", F.col("row")[text_col].alias("text")), benchmark, **settings).select("uid").distinct()
    return rows.join(found, "uid", "left_anti").select("row.*")


@query("op8_benchmark_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "common", "n_words")
