"""SentencePiece encoding and decoding with a BPE model file of a public tokenizer.

A text gets a leading space mark and every space becomes that mark; symbols are code points.
Two neighbouring symbols merge where their joined string is a piece of the model, the pair of
best score first and of equal scores the leftmost. What is left over becomes the ids of its
UTF-8 bytes.

A word is a stretch that no piece can cross at its ends. All new words of a batch are merged
together: their symbols lie in one flat array, each round takes the least pair rank of every
word by a segmented minimum, merges the leftmost such pair of all words at once, compacts the
arrays and drops the words that have no pair left. Words of more than ``LONG_WORD`` symbols,
for which rounds would be quadratic, use a linked list with a heap and give the same ids.

Texts are independent: the operator is one map over the table without a shuffle. Each Python
worker keeps the model and a bounded table of words it has met.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from engram.llm.bpe import _output, public_vocabulary
from engram.llm.memory import tidied

SPACE = "▁"
LONG_WORD = 256
#: Distinct words a worker remembers before it starts afresh; longer words are not kept.
WORDS_KEPT = 600_000
LONGEST_KEPT = 64
NO_RANK = np.iinfo(np.int64).max
#: A code point that is no piece of its own is the symbol ``UNKNOWN`` + code point; a pair is ``left << SHIFT | right``.
UNKNOWN = 1 << 22
SHIFT = 24
#: Kinds of pieces in a model file, and what an unknown piece decodes to.
NORMAL, UNK, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNK_SURFACE = " ⁇ "


class PieceBpe:
    """Encoder and decoder of one model file.

    Models with a normaliser, user-defined or unused pieces, or without pieces for bytes are refused.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rule = model.normalizer_spec
        kinds = [p.type for p in model.pieces]
        if model.trainer_spec.model_type != 2 or rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.escape_whitespaces:
            raise ValueError("only BPE models whose texts are taken as they are")
        if USER_DEFINED in kinds or UNUSED in kinds or kinds.count(BYTE) != 256 or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with pieces for bytes and without user-defined or unused pieces")
        self.dummy = rule.add_dummy_prefix
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = kinds
        self.end = model.trainer_spec.eos_id
        self.first_byte = [0] * 256
        for i, (p, kind) in enumerate(zip(self.pieces, kinds)):
            if kind == BYTE:
                self.first_byte[int(p[3:5], 16)] = i
        self.normal = {p: i for i, (p, kind) in enumerate(zip(self.pieces, kinds)) if kind == NORMAL}
        scores = {i: model.pieces[i].score for i in self.normal.values()}
        ranks = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs: dict[int, tuple[int, int]] = {}
        for piece, i in self.normal.items():
            for cut in range(1, len(piece)):
                left, right = self.symbol(piece[:cut]), self.symbol(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << SHIFT | right] = (ranks[scores[i]], i)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()] + [NO_RANK], dtype=np.int64)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()] + [-1], dtype=np.int64)
        self.bytes_of = [self._bytes(p, kind) for p, kind in zip(self.pieces, kinds)]
        self.pattern = self._words_pattern()
        self.words = _Words()

    def symbol(self, text: str) -> int | None:
        """The symbol of a piece or of a single code point."""
        found = self.normal.get(text)
        return UNKNOWN + ord(text) if found is None and len(text) == 1 else found

    def _bytes(self, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return UNK_SURFACE.encode() if kind == UNK else piece.replace(SPACE, " ").encode()

    def _words_pattern(self) -> re.Pattern:
        """Stretches of a text that no piece reaches across.

        Code points that stand in no longer piece come alone. Breaks are ASCII signs that no
        piece has after a letter, and letters here all that is not ASCII too: a word ends before
        a sign of that kind.
        """
        longer = [p.replace(SPACE, " ") for p in self.normal if len(p) > 1]
        if any(re.search("[^ ] ", p) for p in longer):
            raise ValueError("a piece has a space after another character")
        inside, follows = set("".join(longer)), {p[i : i + 2] for p in longer for i in range(len(p) - 1)}
        ascii_signs = [chr(c) for c in range(128) if not chr(c).isalpha() and chr(c) != " "]
        alone = [c for c in ascii_signs if c not in inside]
        signs = [c for c in ascii_signs if c in inside]
        joined = [c for c in signs if any(two[1] == c and (two[0].isalpha() or two[0] > "\x7f") for two in follows)]
        a, n, j = (re.escape("".join(x)) for x in (alone, signs, joined))
        letters = f"[^ {a}{n}]"
        word = f" *(?:[{n}]+{letters}*|{letters}+)" if n else f" *{letters}+"
        word += f"(?:(?=[{j}])[{n}]+{letters}*)*" if j else ""
        return re.compile("|".join([f"[{a}]"] * bool(a) + [word, " +"]))

    def merge_all(self, words: list[str]) -> list[list[int]]:
        """Final symbols of each word by rounds over all words at once."""
        out: list[list[int]] = [[] for _ in words]
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        for i in (i for i, w in enumerate(words) if len(w) > LONG_WORD):
            out[i] = self._merge_long([self.symbol(c) for c in words[i].replace(" ", SPACE)])
        points = np.frombuffer("".join(words[i] for i in short).replace(" ", SPACE).encode("utf-32-le"), dtype="<u4")
        seen, where = np.unique(points, return_inverse=True)
        symbols = np.array([self.symbol(chr(c)) for c in seen.tolist()], dtype=np.int64)[where] if len(seen) else np.zeros(0, dtype=np.int64)
        owner = np.repeat(np.array(short, dtype=np.int64), [len(words[i]) for i in short])
        pair = self._pair_at(symbols, owner, np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            rank = self.ranks[pair]
            sizes = np.diff(np.r_[starts, len(symbols)])
            least = np.minimum.reduceat(rank, starts)
            done = least == NO_RANK
            if done.any():
                for s, n in zip(starts[done].tolist(), sizes[done].tolist()):
                    out[owner[s]] = symbols[s : s + n].tolist()
                live = ~np.repeat(done, sizes)
                symbols, owner, pair = symbols[live], owner[live], pair[live]
                rank, least, sizes = rank[live], least[~done], sizes[~done]
                if not len(symbols):
                    break
            hits = np.flatnonzero(rank == np.repeat(least, sizes))
            at = hits[np.r_[True, owner[hits[1:]] != owner[hits[:-1]]]]
            symbols[at] = self.made[pair[at]]
            kept = np.ones(len(symbols), dtype=bool)
            kept[at + 1] = False
            symbols, owner, pair = symbols[kept], owner[kept], pair[kept]
            at = at - np.arange(len(at))
            near = np.concatenate((at, at[at > 0] - 1))
            pair[near] = self._pair_at(symbols, owner, near)
        return out

    def _pair_at(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places in the table of pairs of the symbols at ``at`` and after; -1 for none."""
        found = np.full(len(at), -1, dtype=np.int64)
        inner = np.flatnonzero(at + 1 < len(symbols))
        inner = inner[owner[at[inner]] == owner[at[inner] + 1]]
        key = symbols[at[inner]] << SHIFT | symbols[at[inner] + 1]
        place = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        if len(self.keys):
            found[inner] = np.where(self.keys[place] == key, place, -1)
        return found

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, pairs = len(parts), self.pairs
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(p[0], i, parts[i], parts[i + 1]) for i in range(n - 1) if (p := pairs.get(parts[i] << SHIFT | parts[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], live[j], after[i] = pairs[a << SHIFT | b][1], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (i, before[i]):
                right = after[left] if left >= 0 else n
                if right < n and (p := pairs.get(parts[left] << SHIFT | parts[right])):
                    heapq.heappush(heap, (p[0], left, parts[left], parts[right]))
        return [p for p, alive in zip(parts, live) if alive]

    def _packed(self, symbols: list[int]) -> bytes:
        """Ids of final symbols as little-endian 32-bit integers; a symbol that is no piece as its bytes."""
        if max(symbols) >= UNKNOWN:
            symbols = [i for s in symbols for i in ([s] if s < UNKNOWN else [self.first_byte[b] for b in chr(s - UNKNOWN).encode()])]
        return struct.pack(f"<{len(symbols)}i", *symbols)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, each with the end id and without a start id."""
        self.words.trim()
        split = [self.pattern.findall((" " if self.dummy else "") + t.replace(SPACE, " ")) if t else [] for t in texts]
        new = list(set().union(*split).difference(self.words))
        self.words.update(zip(new, map(self._packed, self.merge_all(new))))
        end = np.array([self.end], dtype="<i4").tobytes()
        out = [np.frombuffer(b"".join([*map(self.words.__getitem__, ws), end]), dtype="<i4") for ws in split]
        for w in new:
            if len(w) > LONGEST_KEPT:
                del self.words[w]
        return out

    def decode(self, ids) -> str:
        """Text of a list of ids: the first space mark goes, control pieces are silent, bytes that are no UTF-8 become U+FFFD each."""
        ids = np.asarray(ids).tolist()
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        marked = self.dummy and first is not None and self.kinds[first] == NORMAL and self.pieces[first].startswith(SPACE)
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            text = _each_byte(raw)
        return text[1:] if marked else text


def _each_byte(raw: bytes) -> str:
    """UTF-8 with one U+FFFD for every single byte that belongs to no whole character."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode("utf-8"))
            break
        except UnicodeDecodeError as bad:
            out += [raw[at : at + bad.start].decode("utf-8"), "�"]
            at += bad.start + 1
    return "".join(out)


class _Words(dict):
    def trim(self) -> None:
        if len(self) > WORDS_KEPT:
            self.clear()


def public_model(name: str = "piece_bpe_32k.model") -> str:
    """Place of an installed public model; a parameter of the operators, not kept here."""
    return public_vocabulary(name)


_LOADED: dict[str, PieceBpe] = {}


def load(path: str) -> PieceBpe:
    """The model at ``path``, read once a process."""
    if path not in _LOADED:
        _LOADED[path] = PieceBpe(path)
    return _LOADED[path]


def round_trip(documents: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Adds ``token_ids`` (array of int, the end id last) and ``decoded`` (the text decoded from those ids).

    Null texts count as empty and have the end id alone. Every row comes back once, repeated
    rows too; columns of these two names are replaced, all others pass through. Whole texts of
    any length are encoded; an empty table stays empty. A space mark in a text decodes as a space.
    """
    schema, kept = _output(documents, {"token_ids": T.ArrayType(T.IntegerType(), False), "decoded": T.StringType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = pieces.encode_all([t or "" for t in part.column(text).to_pylist()])
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32, copy=False)))
                decoded = pa.array([pieces.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], lists, decoded], names=[*kept, "token_ids", "decoded"])

    return documents.mapInArrow(tidied(run), schema)


def encode(documents: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``round_trip`` without the decoded text."""
    return round_trip(documents, model, text).drop("decoded")
