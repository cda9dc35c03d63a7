import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as cp
from test_quality import plain as quality
from test_repeats import brute as repeats

from millrace.llm.simhash import fingerprint


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.randint(20, 40))) for i in range(8)]
    passage, long_text = prose(60), prose(200)
    rows = [(i, prose(rng.randint(5, 150))) for i in range(60)]
    rows += [(60, long_text), (61, long_text), (62, long_text.replace(" ", "  ", 1)), (63, long_text + " end")]
    rows += [(70 + k, prose(40) + " " + passage + " " + prose(40)) for k in range(3)]
    rows += [(80 + k, prose(50) + " " + items[k][1] + " " + prose(50)) for k in range(4)]
    rows += [(90, None), (91, ""), (92, "x " * 100)]
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, folder


def test_stages_equal_brute_force(spark, corpus):
    rows, folder = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(cp.STAGES)
    read = lambda df: sorted((r.doc_id, r.text) for r in df.collect())

    kept = stage["quality rules"](spark, docs, folder)
    want = sorted((i, t) for i, t in rows if quality(t)[-1])
    assert read(kept) == want and kept.schema == docs.schema

    prints = {i: fingerprint(t.encode(), cp.SHINGLE_WORDS) for i, t in want}
    root = {i: min([j for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3]) for i in prints}
    assert all(root[root[i]] == root[i] for i in root)  # the fixture's groups are stars
    single = stage["SimHash near-dedup"](spark, kept, folder)
    want = [(i, t) for i, t in want if root[i] == i]
    assert read(single) == want and not {61, 62, 63} & {i for i, _ in want}

    cut = stage["suffix-array dedup"](spark, single, folder)
    told = {i: gone for i, _, gone, _, _ in repeats(want, 50)}
    got = read(cut)
    assert {i: len(t.encode()) - len(dict(got)[i].encode()) for i, t in want} == told and told[71] > 300 and told[72] > 300
    assert all(r.n_chars == len(r.text) for r in cut.collect()) and cut.schema == docs.schema

    clean = stage["benchmark decontamination"](spark, cut, folder)
    assert read(clean) == [(i, t) for i, t in got if not 80 <= i < 84]

    packed = stage["best-fit packing"](spark, clean, folder)
    assert {r.doc_id for r in packed.collect()} == {i for i, _ in read(clean)}


def test_run(spark, corpus):
    rows, folder = corpus
    out = cp.run(spark, folder).collect()
    ids = {r.doc_id for r in out}
    assert {60, 70, 71, 72} <= ids and not ids & {61, 62, 63, 80, 81, 82, 83, 90, 91, 92}
    fill = {}
    for r in out:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 1024


def test_empty_documents(spark, corpus, tmp_path):
    _, folder = corpus
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
