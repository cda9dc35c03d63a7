import re
from pathlib import Path
from urllib.parse import unquote

import xxhash
from pyspark.sql import functions as F

from millrace.llm.simhash import _windows, fingerprint, folded, parities, short_bytes, simhash_dedup, simhash_groups, spanning


def plain(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(rows):
    prints = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return sorted(((i, f"{prints[a]:016x}", least.get(find(a))) for a, (i, _) in enumerate(rows)), key=str)


def test_groups_equal_brute_force(spark):
    base = " ".join(f"Wörd{i} the{i % 7}" for i in range(150))
    rows = [(i, base.replace(f"the{i % 7}", "THE", i % 5)) for i in range(80)]
    rows += [(100 + i, base.replace(f"Wörd{i} ", f"x{i} ")) for i in range(60)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "one"), (304, "one two"), (305, "ONE two"), (303, "one"), (None, base), (None, "alone here now"), (None, None)]
    rows += [(400 + i, f"a b c{i} d{i} e") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((tuple(r) for r in simhash_groups(df).collect()), key=str) == brute(rows)


def test_spanning_reaches_every_linked_print():
    import numpy as np

    rng = np.random.default_rng(3)
    prints = np.unique(rng.integers(0, 1 << 12, 600).astype(np.uint64))
    reached = sum(len(x) for _, x in spanning(prints, 3))
    assert reached == len(prints) - 1  # one component


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(7, text, "a"), (3, text, "b"), (3, text, "c"), (None, text, "d"), (9, "some other words of a text here", "e"), (None, "null id alone with its own words", "f"), (9, "same id yet another text entirely different", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("row", F.lit(1))
    out = simhash_dedup(df)
    assert out.columns == df.columns
    kept = sorted(r.fp for r in out.collect())
    assert kept[1:] == ["e", "f", "g"] and kept[0] in "bc"


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_groups(df).count() == 0 and simhash_dedup(df).count() == 0


def test_similar_sets_are_linked_and_others_are_not(spark):
    import random

    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghiklmnorstu", k=rng.randint(3, 8)))
    shared = [word() for _ in range(40)]
    texts = []
    for _ in range(60):
        base = [word() for _ in range(rng.choice([30, 80, 200, 600, 1500]))] + shared
        texts.append(base)
        for edits in (1, len(base) // 70, len(base) // 8):
            near = base[:]
            for at in rng.sample(range(len(near)), edits):
                near[at] = word()
            texts.append(near)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "two words")]
    sets = [{tuple((t or "").split()[k : k + 5]) for k in range(max(len((t or "").split()) - 4, 1))} for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    prints = [fingerprint((t or "").encode(), 5) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    want = sorted(rows[i][0] for i in range(len(rows)) if find(i) == i)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in simhash_dedup(df, shingle=5, similarity=0.8).collect()) == want
    assert len(want) < len(simhash_dedup(df, shingle=5).collect())


def test_pairs_of_a_key_grow_with_similar_sets_only():
    """Sets of any size that share a third of their shingles make no pair, however many stand in one key; those that are
    similar make theirs."""
    import numpy as np
    import pyarrow as pa

    rng, sets = np.random.default_rng(4), []
    for n in (20, 120, 600, 3000):
        stock = rng.integers(0, 1 << 63, n // 3, dtype=np.uint64)
        own = [np.unique(np.concatenate((stock, rng.integers(0, 1 << 63, n - n // 3 + k % 5, dtype=np.uint64)))) for k in range(200)]
        sets += own + [np.unique(np.concatenate((x[: len(x) - len(x) // 20], rng.integers(0, 1 << 63, len(x) // 20, dtype=np.uint64)))) for x in own[:10]]
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    sizes = np.array([len(sets[k]) for k in order])
    short = [folded(parities(sets[k]), short_bytes(len(sets[k]))).tobytes() for k in order]
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(order), np.int64)), pa.array(np.array(order)), pa.array(sizes), pa.array(np.array(order)), pa.array(short, pa.binary())], names=["key", "fp", "n", "root", "short"])
    pairs = {(a, b) for out in _windows(1, len(order), 0.8)(iter([batch])) for a, b in zip(out.column(1).to_pylist(), out.column(2).to_pylist(), strict=True) if not out.column(0).null_count == 0}
    alike = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 0.8 <= len(sets[a]) / len(sets[b]) <= 1.25 and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))}
    assert len(alike) >= 30 and alike <= pairs and len(pairs) <= len(alike) + 0.01 * 210 * 210


def words(rng, n):
    return ["".join(rng.choices("abcdefghiklmnorstu", k=8)) for _ in range(n)]


def test_similar_pair_in_a_group_of_a_thousand_is_linked(spark):
    """All hold one stock text; only the last two are similar to another (0.83, the others 0.67 and less)."""
    import random

    rng, rows = random.Random(5), []
    for _ in range(3):
        stock = words(rng, 114)
        rows += [(len(rows) + k, " ".join(stock + words(rng, own))) for k, own in enumerate([44] * 1000 + [11] * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in simhash_dedup(df, shingle=5, similarity=0.8).collect()}
    assert kept.isdisjoint({1001, 2003, 3005})
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    prints = {i: fingerprint(t.encode(), 5) for i, t in rows}
    for i in {r[0] for r in rows} - kept:  # nothing else goes but by its fingerprint
        assert i in (1001, 2003, 3005) or any((prints[i] ^ prints[j]).bit_count() <= 3 for j in sets if j != i)


def test_copies_with_a_repeated_phrase_are_linked(spark):
    """Repeats turn the fingerprint and leave the set."""
    import random

    rng, rows = random.Random(6), []
    for k in range(20):
        text, phrase = words(rng, 300), words(rng, 10)
        rows += [(2 * k, " ".join(text + phrase)), (2 * k + 1, " ".join(text + phrase * 12))]
    prints = [fingerprint(t.encode(), 5) for _, t in rows]
    assert sum((a ^ b).bit_count() > 20 for a, b in zip(prints[::2], prints[1::2], strict=True)) >= 5
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash_dedup(df, shingle=5, similarity=0.8).collect()) == list(range(0, 40, 2))


def test_only_the_result_stays_in_the_shared_folder(spark, tmp_path, monkeypatch):
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[k : k + 60])) for k in range(0, 300, 3)] + [(1000 + k, " ".join(words[:60])) for k in range(6)]
    monkeypatch.setattr("millrace.session.shared_dir", lambda spark: str(tmp_path))
    out = simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, similarity=0.8)
    assert 0 < out.count() < len(rows)
    written = {x.parent for x in tmp_path.rglob("*.parquet")}
    assert written and written == {Path(x.removeprefix("file:")).parent for x in map(unquote, out.inputFiles())}
