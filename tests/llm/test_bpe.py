import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.bpe import Vocabulary, encode_decode

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(open(PATH, encoding="utf-8").read())


def expected(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return b"".join(i.to_bytes(4, "little") for i in ids), library.decode(ids, skip_special_tokens=False).encode()


SAMPLES = ["", " ", "Hello  World's 123 it's!!", "a\x1cb\u0085c d", "ΑΣ ΟΔΟΣ Σ", "İstanbul ǅ ß ﬁ", "étude", "x<|endoftext|>y <|startoftext|>",
           "<|endoftext|><|endoftext|>", "日本語 テスト", "🙂🙂 👩‍👩‍👧", "aaaa" * 50, "​﻿", "'S 'll'VE", "१२३ ½ ²", "a_b-c--__..", "\n\n\t", "<|", "e ́x"]


def test_samples(library, vocabulary):
    ids, text = vocabulary.encode_texts(SAMPLES)
    for s, i, d in zip(SAMPLES, ids, text):
        assert (i, d) == expected(library, s), s


def test_random_words(library, vocabulary):
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz" * 3 + "éèßñüœ'-.,0123456789 \n" + "ABCÉ"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(200))) for _ in range(1500)]
    texts += ["".join(chr(r.choice([r.randrange(32, 0x250), r.randrange(0x370, 0x3000)])) for _ in range(60)) for _ in range(500)]
    ids, text = vocabulary.encode_texts(texts)
    bad = [(s, i, d) for s, i, d in zip(texts, ids, text) if (i, d) != expected(library, s)]
    assert not bad, bad[:2]


def test_rows_and_nulls(spark, library):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "y"), (None, "abc", "z"), (2, None, "w"), (3, "", "v"), (4, "ab " * 700_000, "u")]
    got = encode_decode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH).collect()
    assert len(got) == len(rows)
    assert [r.n_tokens for r in got if r.doc_id in (2, 3)] == [0, 0]
    for r in got:
        if r.doc_id == 1:
            assert (bytes(r.ids), r.decoded.encode()) == expected(library, "Hello world")
        if r.doc_id == 4:
            assert r.n_tokens == 700_000 and r.decoded == " ".join(["ab</w>"] * 700_000)
    assert encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
