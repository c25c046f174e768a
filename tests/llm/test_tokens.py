import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tokenizers
from cases import EDGE, LONG, frame

from vectrove.llm.bpe import PIECE_CHARS, bpe_decode, bpe_encode, encode_text, load_encoding, safe_pieces
from vectrove.llm.token_counts import SAME_SPLIT_BELOW, PreTokenizer, token_counts


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_counts_equal_the_library(spark, library):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts(frame(spark, EDGE)).collect())
    want = sorted((i is None, i or 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in EDGE)
    assert got == want


def test_counts_of_no_rows_and_of_hot_words(spark, library):
    assert token_counts(frame(spark, [])).count() == 0
    text = "the " * 70_000 + "<|endoftext|><|endoftext|>end"
    assert token_counts(frame(spark, [(1, text)]), n_buckets=2).first().n_tokens == len(library.encode(text, add_special_tokens=False).ids)


def test_fast_split_equals_the_library_for_every_code_point_it_serves():
    pre = PreTokenizer(None)
    for c in range(SAME_SPLIT_BELOW):
        text = f"a{chr(c)}b 1{chr(c)} {chr(c)}x"
        assert pre._ordinary(text) == [text[a:b] for _, (a, b) in pre.tokenizer.pre_tokenizer.pre_tokenize_str(text)], hex(c)


def test_encoding_equals_the_library(spark):
    enc = load_encoding()
    rows = bpe_encode(frame(spark, EDGE), digests=True).collect()
    want = []
    for i, t in EDGE:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        want.append((i is None, i or 0, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(want)


def test_round_trip_and_empty_table(spark):
    encoded = bpe_encode(frame(spark, EDGE), keep=("doc_id", "text"))
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in bpe_decode(encoded, keep=("doc_id", "text")).collect())
    assert bpe_encode(frame(spark, [])).count() == 0


def test_pieces_are_cut_at_boundaries_of_the_pattern():
    enc = load_encoding()
    for text in (LONG, "x" * 5000, "a b\n\n  c " * 900, "é " * 4000, " \n" * 3000, "日本 " * 2000 + "end of it", "これは、文です。次の文！" * 900, "привет, мир 12 " * 900, "it's 'tis we'll 'S\u00a0x\u2003y\u200b z" * 400, "中文。’s “q” ，a" * 700):
        pieces = safe_pieces(text, 100)
        assert "".join(pieces) == text
        assert [i for p in pieces for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_long_texts_of_all_scripts_are_cut_in_linear_time():
    import time

    made = {"cyrillic": "Съешь ещё этих мягких французских булок, да выпей чаю. ", "japanese": "吾輩は猫である。名前はまだ無い、どこで生れたか。", "no newline": "plain words only "}
    for name, unit in made.items():
        took = []
        for size in (1_250_000, 5_000_000):
            text = unit * (size // len(unit))
            began = time.perf_counter()
            pieces = safe_pieces(text)
            took.append(time.perf_counter() - began)
            assert "".join(pieces) == text and max(map(len, pieces)) < PIECE_CHARS + 100, name
        assert took[1] < 16 * max(took[0], 1e-3), name
    assert safe_pieces("x" * 5_000_000) == ["x" * 5_000_000]
    enc = load_encoding()
    text = made["japanese"] * 8000
    assert encode_text(enc, text).tolist() == enc.encode_ordinary(text)
    assert encode_text(enc, "x" * 300_000).tolist() == enc.encode_ordinary("x" * 300_000)
