"""BPE and token files against the library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidegrid.llm import bpe, token_files
from tidegrid.session import scratch_path

BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
ALPHABET = " .,AB;'\n\t  \x1c\x85abcdEFé漢字'sll12٣!?.,<|endoftext|>👍🏽́Σİ\""


def texts() -> list[str]:
    rng = random.Random(5)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(1500)]
    return [*made, *("<|endoftext|>" + t for t in made[:50]), *(t.replace(" ", "") * 40 for t in made[:20]), "a" * 3000]


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}


def test_encoder_equals_library(library):
    encoder = bpe.Encoder(bpe.Vocabulary(BYTES))
    for text in texts():
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library[BYTES].encode(text, add_special_tokens=False).ids, text


def test_array_equals_heap():
    vocab = bpe.Vocabulary(BYTES)
    for text in texts():
        parts = [vocab.first[b] for b in text.replace(" ", "").encode()]
        assert vocab._merge_array(list(parts)) == vocab._merge_heap(list(parts))


def test_word_ids_equal_library(library):
    words = token_files.WordIds(WORDS)
    for text in texts():
        assert np.frombuffer(words.encode(text), "<u4").tolist() == library[WORDS].encode(text, add_special_tokens=False).ids, text


def test_every_letter_as_the_library_has_it():
    """Some letters are taken apart before the tokenizer's pattern sees them."""
    words = token_files.WordIds(WORDS)
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha() and (c < 0x3400 or c % 7 == 0 or 0xF900 <= c < 0xFFFF)]
    assert "\u0958" in letters and "\ufb1d" in letters
    for c in letters:
        for text in (c, f"a{c}b."):
            assert words.encode(text) == words._part(text), repr(text)


def test_caches_are_bounded_and_harmless():
    recent = bpe.Recent(str.upper, 3, longest=5)
    assert [recent[k] for k in "abcdabcdefg"] == list("ABCDABCDEFG") and len(recent) <= 3 and len(recent.older) <= 3
    assert recent["longer than five"] == "LONGER THAN FIVE" and "longer than five" not in recent


def test_round_trip_of_rows(odd, odd_pairs, library, by_id):
    rows = bpe.decode(bpe.encode(odd, BYTES), BYTES).select("doc_id", "decoded", bpe.token_count(), bpe.ids_array().alias("a")).collect()
    want = [(i, t or "", *(lambda ids: (len(ids), ids))(library[BYTES].encode(t or "", add_special_tokens=False).ids)) for i, t in odd_pairs]
    assert by_id(rows) == by_id(want)


def test_both_in_one_step(spark, odd, none):
    columns = ["doc_id", "ids", "decoded"]
    two = bpe.decode(bpe.encode(odd, BYTES), BYTES).select(*columns)
    one = bpe.encode_and_decode(odd, BYTES)
    assert one.columns == columns and one.exceptAll(two).count() == two.exceptAll(one).count() == 0
    assert bpe.encode_and_decode(none, BYTES).count() == 0


def test_decode_of_broken_bytes(spark, library):
    ids = [[0x1FFFF], [], [220, 128, 129], list(range(100, 256))]
    rows = spark.createDataFrame([(k, bytearray(np.array(x, "<u4").tobytes())) for k, x in enumerate(ids)], "doc_id long, ids binary")
    got = {r.doc_id: r.decoded for r in bpe.decode(rows, BYTES).collect()}
    assert got == {k: library[BYTES].decode([i for i in x if i < 50257], skip_special_tokens=False) for k, x in enumerate(ids)}


def test_empty_tables(none, spark):
    assert bpe.decode(bpe.encode(none, BYTES), BYTES).count() == 0
    path = scratch_path(spark, "t")
    token_files.write_tokens(none, path, WORDS)
    assert token_files.read_tokens(spark, path).count() == 0


def test_token_files(spark, odd, odd_pairs, library):
    path = scratch_path(spark, "t")
    token_files.write_tokens(odd, path, WORDS, partitions=4, row_group_bytes=1 << 16, page_rows=5)
    rows = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert [i is None for i in ids[:2]] == [True, True] and ids[2:] == sorted(ids[2:])
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 1
        at += r.n_tokens
    want = sorted((repr(i), zlib.crc32(np.array(library[WORDS].encode(t or "", add_special_tokens=False).ids + [1], "<u4"))) for i, t in odd_pairs)
    assert want == sorted((repr(r.doc_id), zlib.crc32(np.array(r.ids, "<u4"))) for r in rows)


def test_files_are_laid_out_for_selective_reads(spark, odd):
    import glob

    import pyarrow.parquet as pq

    path = scratch_path(spark, "t")
    token_files.write_tokens(odd, path, WORDS, partitions=3)
    for file in glob.glob(f"{path.removeprefix('file://')}/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        columns = {meta.row_group(0).column(k).path_in_schema: meta.row_group(0).column(k) for k in range(meta.num_columns)}
        assert all(c.has_column_index and c.has_offset_index for c in columns.values())
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
        assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
    one = token_files.read_tokens(spark, path).where("doc_id = 12")
    assert one.count() == 1 and "doc_id" in one._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    counts = token_files.read_tokens(spark, path, ids=False)
    assert "ids" not in counts.columns and "ids:" not in counts._jdf.queryExecution().executedPlan().toString()


def test_marks_and_cases_are_parted_before_words_are_remembered(library):
    words = token_files.WordIds(WORDS)
    for text in (
        "Word word. WORD, word... (word) word). word.) wort'. it's. IT'S! ÉLAN; élan?! ß- Straße-Weg. a²! ²! 3a. x|",
        "<|endoftext|> A. <|ENDOFTEXT|> b. c<|endoftext|>.", "“Word.” Σας. WORD.\xa0word,\x85word;\x1cWord.", "ÀÖØÞ. àöøþÿ× ÷. µ. ª.",
    ):
        assert np.frombuffer(words.encode(text), "<u4").tolist() == library[WORDS].encode(text, add_special_tokens=False).ids, text
    words = token_files.WordIds(WORDS)
    words.encode("word Word WORD word. Word, WORD; word?")
    assert set(words.words) == {"word", ".", ",", ";", "?"}
