import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skein.llm import tokens
from skein.llm.common import table
from tests.llm.helpers import docs, rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(pairs):
    t, start, out = Tokenizer.from_file(PATH), 0, {}
    for doc, text in sorted(pairs):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out[doc] = {"doc_id": doc, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.asarray(ids, "<u4").tobytes())}
        start += len(ids)
    return out


@pytest.mark.parametrize("bits", [1, 3, 8, 12, 16, 17, 20, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(1).integers(0, 2**bits, 1001).astype(np.uint32)
    packed = tokens.pack(ids, bits)
    assert len(packed) == (1001 * bits + 7) // 8
    assert (tokens.unpack(packed, bits, 1001) == ids).all() and (tokens.unpack(packed, bits, 40, 333) == ids[333:373]).all()


def test_crc_join():
    a, b = b"spark" * 99, bytes(range(256)) * 77
    assert tokens.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b) and tokens.crc_join(zlib.crc32(a), 0, 0) == zlib.crc32(a)


def test_width():
    assert [tokens.width(n) for n in (1, 2, 3, 256, 257, 50257)] == [1, 1, 2, 8, 9, 16]


def test_small_texts_and_long_ones(spark, monkeypatch):
    texts = [None, "", " ", "a", "  two  spaces \n\n end ", "it's we'll <|endoftext|> x", "é😀ñ ​　x", "word " * 70_000, "x" * 9000, "12 345½ ²", "tail"]
    assert rows(tokens.report(docs(spark, texts), PATH)) == expected(list(enumerate(texts)))


def test_table(spark, sf):
    d = table(spark, sf, "documents")
    assert rows(tokens.report(d, PATH)) == expected([(r.doc_id, r.text) for r in d.collect()])


def test_empty_table(spark):
    assert tokens.report(docs(spark, []), PATH).count() == 0


def test_pieces_equal_the_library():
    e, t = tokens.encoder(PATH), Tokenizer.from_file(PATH)
    texts = ["½ of x² and Ⅷ ٣٤ १२", "a_b __c _", "\x1c\x1d x\x85y", " 　é\r\n\t z", "don't 'LL 'd''s", "..!?\n\n\n  a", "é é ñ́", "😀👍🏽", "<|endoftext|>", "x<|endoftext|> y", "", "   ", "ſt ʼs", "a\n\nb\n\n\nc", "a\n", "\na", " a", "a ", "a\n \nb", "a\x00b \x00", "\x00", "\u2003x y", "x\u2003 y", "tab\tin", "a\xa0 b", "\n", "\n\n", " "]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
