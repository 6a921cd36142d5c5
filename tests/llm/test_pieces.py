import random

import pytest
import sentencepiece

from engram.llm import pieces, queries
from tests.llm.brute import sha

RNG = random.Random(3)
PARTS = ["a", "b", " ", "  ", "\n", "1", "é", "😀", "'s", "<s>", "</s>", "<unk>", "<0x41>", "中", "▁", "　", "\x00", "the", " token", "     ", "\t", "\r\n", "ing", ".com", "),", "́", "ﬁ"]


@pytest.fixture(scope="module")
def public():
    path = pieces.public_model()
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


def texts():
    fixed = [None, "", " ", "  ", "▁", "a" * 3000, "ab" * 500 + " " + "é" * 400, " " * 5000, " " * 300 + "the", "日本語" * 200, "😀" * 300, "x " * 50_000]
    return fixed + ["".join(RNG.choice(PARTS) for _ in range(RNG.randint(0, 60))) for _ in range(1500)]


def test_ids_and_text_as_the_library(public):
    path, library = public
    own, all_texts = pieces.load(path), [t or "" for t in texts()]
    for t, ids in zip(all_texts, own.encode_all(all_texts)):
        want = library.encode(t, add_eos=True)
        assert ids.tolist() == want
        assert own.decode(ids) == library.decode(want)


def test_decoding_any_ids(public):
    path, library = public
    own = pieces.load(path)
    for _ in range(2000):
        ids = [RNG.choice([RNG.randrange(32_000), RNG.randrange(300), 28_705, 259]) for _ in range(RNG.randint(0, 12))]
        assert own.decode(ids) == library.decode(ids)


def test_long_words_merge_as_short_ones(public, monkeypatch):
    own = pieces.load(public[0])
    words = ["".join(RNG.choice("abcdth eñ中") for _ in range(RNG.randint(1, 190))) for _ in range(200)] + [" " * n for n in range(1, 120)]
    rounds = own.merge_all(words)
    monkeypatch.setattr(pieces, "LONG_WORD", 0)
    assert own.merge_all(words) == rounds


def test_operator(spark, public, tiny):
    path, library = public
    rows = [(i, t, "x") for i, t in enumerate(texts()[:60])] + [(1007, "twice", "x"), (1007, "twice", "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    made = pieces.round_trip(docs, path).collect()
    assert len(made) == len(rows)
    by_id = {r.doc_id: r for r in made}
    for i, t, _ in rows:
        want = library.encode(t or "", add_eos=True)
        assert by_id[i].token_ids == want and by_id[i].decoded == library.decode(want)
    assert pieces.encode(docs.limit(0), path).count() == 0
    table = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    for r in queries.op12_sentencepiece(spark, tiny).collect():
        ids = library.encode(table[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
