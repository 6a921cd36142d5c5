import random

import pytest
from tokenizers import Tokenizer

from engram.llm import bpe, queries
from tests.llm.brute import sha

RNG = random.Random(1)
PIECES = ["a", "b", " ", "  ", "\n", "1", "é", "😀", "'s", "'", "<|endoftext|>", "中", "_", "　", "\x00", "\x1c", "the", " token", "\U00010940", "՘"]


@pytest.fixture(scope="module")
def public():
    path = bpe.public_vocabulary()
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return path, library


def texts():
    fixed = [None, "", " ", "<|endoftext|>", "a <|endoftext|>  b <|endoftext|><|endoftext|>", "a" * 3000, "ab" * 500 + " " + "é" * 400, "😀" * 300, "日本語" * 200, "x " * 50_000]
    return fixed + ["".join(RNG.choice(PIECES) for _ in range(RNG.randint(0, 60))) for _ in range(1500)]


def test_ids_and_text_as_the_library(public):
    path, library = public
    own = bpe.load(path)
    for t in texts():
        want = library.encode(t or "", add_special_tokens=False).ids
        ids = own.encode(t or "").tolist()
        assert ids == want
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False) == (t or "")


def test_decoding_any_ids(public):
    path, library = public
    own = bpe.load(path)
    for _ in range(300):
        ids = [RNG.randrange(50_257) for _ in range(RNG.randint(0, 20))]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_long_words_merge_as_short_ones(public, monkeypatch):
    own = bpe.ByteBpe(public[0])
    words = [bytes(RNG.choice(b"abcdth e") for _ in range(RNG.randint(1, 190))) for _ in range(200)]
    short = [own.merge(w) for w in words]
    monkeypatch.setattr(bpe, "LONG_WORD", 1)
    assert [own.merge(w) for w in words] == short


def test_operator(spark, public, tiny):
    path, library = public
    rows = [(i, t, "x") for i, t in enumerate(texts()[:40])] + [(7, "twice", "x"), (7, "twice", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    made = bpe.round_trip(docs, path).collect()
    assert len(made) == len(rows)
    assert all(r.decoded == (r.text or "") and r.token_ids == library.encode(r.text or "", add_special_tokens=False).ids for r in made)
    assert bpe.round_trip(docs.limit(0), path).count() == 0
    table = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    for r in queries.op2_bpe(spark, tiny).collect():
        ids = library.encode(table[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(table[r.doc_id]))
