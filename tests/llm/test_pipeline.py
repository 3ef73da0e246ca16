"""The pipeline's stages against brute force, each on its own input."""

import hashlib
import random
import re

import public_tokenizers
import pytest
from test_lines import brute
from test_near_copies import fingerprint, low, roots
from tokenizers import Tokenizer

import corpus_pipeline
from tidegrid.llm.queries import ORACLE, QUERIES
from tidegrid.session import scratch_path


@pytest.fixture(scope="module")
def sf(spark, odd, tmp_path_factory):
    """Odd documents and a small benchmark as a folder of tables."""
    path = str(tmp_path_factory.mktemp("tables"))
    odd.write.parquet(f"{path}/documents.parquet")
    text = odd.where("doc_id = 18").first().text
    items = [(1, text), (2, None), (None, "words that no document of these tables has in any place at all")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, sf, by_id):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "encode":
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(path := scratch_path(spark, "t"))
        kept[name], docs = (docs.collect(), spark.read.parquet(path).collect()), spark.read.parquet(path)
    pairs = {n: ([(r.doc_id, r.text) for r in a], [(r.doc_id, getattr(r, "text", None)) for r in b]) for n, (a, b) in kept.items()}

    before, after = pairs["language"]
    assert by_id(after) == by_id((i, t) for i, t in before if re.search(r"[^\W\d_]", t or ""))
    before, after = pairs["lines"]
    assert by_id(after) == by_id(r[:2] for r in brute(before))
    assert all(r.n_chars == len(r.text) for r in kept["lines"][1])
    before, after = pairs["near_duplicates"]
    rows = [(low(i), fingerprint(t)) for i, t in before]
    root = roots(rows, lambda a, b: bin(a[1] ^ b[1]).count("1") <= 2)
    assert sorted(low(i) for i, _ in after) == sorted(min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in set(root))
    assert set(after) <= set(before)
    before, after = pairs["decontaminate"]
    assert by_id(after) == by_id(x for x in before if x[0] != 18) and len(after) == len(before) - 1
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    last = [(r.doc_id, r.n_tokens, r.decoded_sha256) for r in kept["encode"][1]]
    want = [(i, len(library.encode(t, add_special_tokens=False).ids), hashlib.sha256(t.encode()).hexdigest()) for i, t in after]
    assert by_id(last) == by_id(want)


def test_rows_without_an_id_are_documents_of_their_own(spark, sf):
    rng = random.Random(8)
    a, b, c, d = (" ".join(f"{x}{rng.randint(0, 10**6)}" for _ in range(40)) for x in "abcd")
    rows = [(None, a), (None, b), (5, a), (9, b), (11, c), (11, d), (None, c), (None, d), (None, d)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, sf).collect()
    assert sorted((r.text, r.doc_id) for r in kept) == sorted((t, None) for t in (a, b, c, d))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("item_id = 1").first().text
    docs = docs.union(spark.createDataFrame([(None, item, "en", "s", 1), (11, item, None, None, 1)], docs.schema))
    kept = corpus_pipeline.decontaminate(spark, docs, sf).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept))) == sorted(map(repr, rows))


def test_run_is_its_stages(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and rows.count() > 20


def test_empty_tables(spark, sf, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", ["op3_line_dedup", "op5_url_rules", "op7_substring_dedup", "op8_chat", "op11_collocations", "op12_suffix_dedup"])
def test_queries_equal_their_sql(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = QUERIES[name](spark, folder).toArrow(), con.execute(ORACLE[name]).to_arrow_table()
    columns = sorted(want.column_names)
    assert sorted(got.column_names) == columns
    lines = lambda t: sorted(map(repr, zip(*[t.column(c).to_pylist() for c in columns])))
    assert lines(got) == lines(want)
