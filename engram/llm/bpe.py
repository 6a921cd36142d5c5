"""Byte-level BPE encoding and decoding with a vocabulary file of a public tokenizer.

The file is the JSON of a byte-level BPE model (vocabulary, ranked merges, added tokens).
A word's symbols lie in one contiguous list of parts with the ranks of adjacent pairs in a
second: the smallest rank is found by scanning, the boundary inside that pair is deleted,
and the ranks of the two neighbouring pairs are refreshed, until no pair has a rank. Words
longer than ``LONG_WORD`` symbols, where repeated scans would be quadratic, use a linked
list with a heap and give the same ids.

Texts are independent: the operator is one map over the table without a shuffle. Each
Python worker keeps the vocabulary and a bounded table of words it has met.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from engram.llm.memory import tidied

LONG_WORD = 200
#: Distinct words a worker remembers before it starts afresh; longer words are not kept.
WORDS_KEPT = 250_000
LONGEST_KEPT = 64
NO_RANK = 1 << 60

#: The public byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and digits that the installed regular expressions know and the
#: public tokenizers library, on an older Unicode, takes for neither.
NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 "
    "16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 "
    "1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED "
    "1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F "
)
_NEWER_SET = "".join("-".join(f"\\U{int(end, 16):08X}" for end in span.split("-")) for span in NEWER.split())
_NEWER = regex.compile(f"[{_NEWER_SET}]")
_FIRST_NEWER = "\u0558"
#: The pattern for texts that hold such a character.
CAREFUL = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{_NEWER_SET}]]").replace(r" ?\p{L}+", rf" ?[\p{{L}}--[{_NEWER_SET}]]+").replace(r" ?\p{N}+", rf" ?[\p{{N}}--[{_NEWER_SET}]]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class ByteBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        byte_of = {ord(s): b for b, s in enumerate(symbols)}
        self.byte_ids = [vocab[s] for s in symbols]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.rank.setdefault((vocab[left], vocab[right]), rank)
            self.made.append(vocab[left + right])
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added = added
        self.added_split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        every = {**vocab, **added}
        self.bytes_of = [b""] * (max(every.values()) + 1)
        for token, i in every.items():
            codes = [byte_of.get(ord(c)) for c in token]
            self.bytes_of[i] = token.encode() if None in codes else bytes(codes)
        self.pattern = regex.compile(PATTERN)
        self.careful = regex.compile(CAREFUL, regex.V1)
        self.words = _Words(self)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        parts = [self.byte_ids[b] for b in word]
        if len(parts) > LONG_WORD:
            return self._merge_long(parts)
        rank, made = self.rank, self.made
        ranks = [rank.get(pair, NO_RANK) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            parts[i] = made[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get((parts[i], parts[i + 1]), NO_RANK)
            if i:
                ranks[i - 1] = rank.get((parts[i - 1], parts[i]), NO_RANK)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        live = [True] * n
        rank, made = self.rank, self.made
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)

        def push(i: int) -> None:
            j = after[i]
            if j < n and (r := rank.get((parts[i], parts[j]))) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], live[j] = made[r], False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [p for p, alive in zip(parts, live) if alive]

    def pre_tokens(self, text: str) -> list[str]:
        """The words that are merged one by one."""
        if not text.isascii() and max(text) >= _FIRST_NEWER and _NEWER.search(text):
            return self.careful.findall(text)
        return self.pattern.findall(text)

    def _packed(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if self.added_split is None or not any(t in text for t in self.added):
            return b"".join(map(self.words.__getitem__, self.pre_tokens(text)))
        out = []
        for piece in self.added_split.split(text):
            if piece in self.added:
                out.append(self.added[piece].to_bytes(4, "little"))
            elif piece:
                out += map(self.words.__getitem__, self.pre_tokens(piece))
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; strings of added tokens become those tokens."""
        self.words.trim()
        return np.frombuffer(self._packed(text), dtype="<i4")

    def decode(self, ids) -> str:
        """Text of a list of ids, added tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.asarray(ids).tolist())).decode("utf-8", "replace")


class _Words(dict):
    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        packed = np.array(self.bpe.merge(word.encode("utf-8")), dtype="<i4").tobytes()
        if len(word) <= LONGEST_KEPT:
            self[word] = packed
        return packed

    def trim(self) -> None:
        if len(self) > WORDS_KEPT:
            self.clear()


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of an installed public tokenizer's file; a parameter of the operators, not kept here."""
    import public_tokenizers

    return public_tokenizers.path(name)


_LOADED: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """The vocabulary at ``path``, read once a process."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def _output(documents: DataFrame, names: dict[str, T.DataType]) -> tuple[T.StructType, list[str]]:
    kept = [f for f in documents.schema.fields if f.name not in names]
    return T.StructType([*kept, *[T.StructField(n, t) for n, t in names.items()]]), [f.name for f in kept]


def round_trip(documents: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Adds ``token_ids`` (array of int) and ``decoded`` (the text decoded from those ids).

    Null texts count as empty and have no ids. Every row comes back once; columns of these
    two names are replaced, all others pass through. Whole texts are encoded.
    """
    schema, kept = _output(documents, {"token_ids": T.ArrayType(T.IntegerType(), False), "decoded": T.StringType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [bpe.encode(t or "") for t in part.column(text).to_pylist()]
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32, copy=False)))
                decoded = pa.array([bpe.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], lists, decoded], names=[*kept, "token_ids", "decoded"])

    return documents.mapInArrow(tidied(run), schema)


def encode(documents: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``round_trip`` without the decoded text."""
    return round_trip(documents, vocabulary, text).drop("decoded")
