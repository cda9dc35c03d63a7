"""The registered queries of the subpackage: beside their SQL where they have one, else their shape."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import compare
from millrace.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    frame = QUERIES[name](spark, SF_DIR)
    names = sorted(frame.columns)
    got = [tuple(r) for r in frame.select(*names).collect()]
    answer = con.execute(f"SELECT * FROM ({ORACLE[name]}) q")
    columns = [d[0] for d in answer.description]
    assert sorted(columns) == names
    want = [tuple(r[columns.index(n)] for n in names) for r in answer.fetchall()]
    assert compare(names, got, want) == ""


def test_all_and_the_pipeline_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("op2_best_fit_packing", "doc_id piece start length ids_crc32 sequence_id offset"),
        ("op3_suffix_dedup", "doc_id n_bytes n_removed n_spans kept_sha256"),
        ("op4_simhash_near_dedup", "doc_id fingerprint component_id"),
        ("op5_toxicity", "doc_id held_out score predicted"),
        ("op8_benchmark_decontamination", "doc_id item_id common n_words"),
        ("op9_token_id_files", "doc_id start n_tokens ids_crc32"),
        ("op10_html_extraction", "page_id url text n_chars"),
        ("op11_license_scan", "doc_id n_words n_base first_word last_word base_labels labels score"),
        ("op12_collocations", "lang rank phrase a l r n score"),
        ("op13_structure_repair", "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256"),
    ],
)
def test_columns_and_rows(spark, name, columns):
    out = QUERIES[name](spark, SF_DIR)
    assert out.columns == columns.split()
    rows = out.count()
    table = "pages" if name.startswith("op10") else "conversations" if name.startswith("op13") else "documents"
    n = spark.read.parquet(f"{SF_DIR}/{table}.parquet").select("conv_id" if table == "conversations" else "*").distinct().count()
    assert rows >= n if name.startswith("op2") else rows >= 0 if name.startswith(("op8", "op12")) else rows == n
