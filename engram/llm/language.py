"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in both directions, labels every position with
language probabilities, and the document's probabilities are their mean over the positions
of letters. Texts are cut into segments of ``SEGMENT`` bytes that are read side by side,
each from a zero state, so that all bytes of all texts are read in ``SEGMENT`` steps a
batch. Training is backpropagation through time in numpy (Adam).

An input byte is one-hot, so its product with the input weights is one row of a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.sampling import by_class, held_out, texts_of

#: Most labelled documents to fit on, for each language.
MOST_PER_LANGUAGE = 250
HIDDEN = 8
SEGMENT = 64
#: Segments of each fitted document that one pass trains on, drawn anew each pass.
DRAWN = 6
EPOCHS = 5
BATCH = 128
RATE = 0.02
#: Segments that are read side by side when scoring.
SIDE_BY_SIDE = 4096
UNKNOWN = "und"

#: A letter as Unicode has it; numbers that look like one (Ⅳ, ½, ①) are none.
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_LETTER = np.zeros(256, dtype=bool)
_IS_LETTER[97:123] = True
_IS_LETTER[128:] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Network:
    """Weights of both directions and of the output layer."""

    def __init__(self, languages: list[str], rng: np.random.Generator):
        h = HIDDEN
        self.languages = languages
        self.table = (rng.standard_normal((2, 256, 3 * h)) * 0.3).astype(np.float32)
        self.recur = (rng.standard_normal((2, h, 3 * h)) / np.sqrt(h)).astype(np.float32)
        self.out = (rng.standard_normal((2 * h, len(languages))) * 0.3).astype(np.float32)
        self.bias = np.zeros(len(languages), dtype=np.float32)

    def read(self, segments: np.ndarray, side: int, keep: bool = False):
        """States of one direction, ``SEGMENT`` by segments by ``HIDDEN``; with what training needs if ``keep``."""
        h = HIDDEN
        steps = range(segments.shape[1]) if side == 0 else range(segments.shape[1] - 1, -1, -1)
        table, recur = self.table[side], self.recur[side]
        states = np.empty((segments.shape[1], len(segments), h), dtype=table.dtype)
        state = np.zeros((len(segments), h), dtype=table.dtype)
        kept = {}
        for t in steps:
            into = table[segments[:, t]]
            own = state @ recur
            gates = _sigmoid(into[:, : 2 * h] + own[:, : 2 * h])
            fresh = np.tanh(into[:, 2 * h :] + gates[:, h:] * own[:, 2 * h :])
            if keep:
                kept[t] = (state, gates, fresh, own[:, 2 * h :])
            state = fresh + gates[:, :h] * (state - fresh)
            states[t] = state
        return (states, kept) if keep else states

    def probabilities(self, segments: np.ndarray) -> np.ndarray:
        """Language probabilities of every position, ``SEGMENT`` by segments by languages."""
        logits = self.read(segments, 0) @ self.out[:HIDDEN]
        logits += self.read(segments, 1) @ self.out[HIDDEN:]
        logits += self.bias
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits


def cut(text: str) -> np.ndarray:
    """A text's bytes in lower case, in rows of ``SEGMENT``; the last row is filled up with zeros."""
    raw = _FOLD[np.frombuffer(text.encode("utf-8"), dtype=np.uint8)]
    rows = -(-len(raw) // SEGMENT)
    out = np.zeros(rows * SEGMENT, dtype=np.uint8)
    out[: len(raw)] = raw
    return out.reshape(rows, SEGMENT)


def gradients(net: Network, seg: np.ndarray, label: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Gradients of the mean log loss over all letters' positions by backpropagation through time, and the loss."""
    h = HIDDEN
    runs = [net.read(seg, side, keep=True) for side in (0, 1)]
    both = np.concatenate((runs[0][0], runs[1][0]), axis=2)
    logits = both @ net.out + net.bias
    p = np.exp(logits - logits.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    on = _IS_LETTER[seg].T.astype(both.dtype)
    sure = p[:, np.arange(len(seg)), label].copy()
    p[:, np.arange(len(seg)), label] -= 1
    d_logits = p * (on / max(1.0, on.sum()))[:, :, None]
    grads = [np.zeros_like(x) for x in (net.table, net.recur, net.out, net.bias)]
    grads[2] += np.einsum("tbh,tbc->hc", both, d_logits, optimize=True)
    grads[3] += d_logits.sum(axis=(0, 1))
    d_both = d_logits @ net.out.T
    for side in (0, 1):
        kept = runs[side][1]
        order = range(seg.shape[1] - 1, -1, -1) if side == 0 else range(seg.shape[1])
        back = np.zeros((len(seg), h), dtype=both.dtype)
        for t in order:
            state, gates, fresh, own = kept[t]
            z, r = gates[:, :h], gates[:, h:]
            g = back + d_both[t, :, side * h : side * h + h]
            d_fresh = g * (1 - z) * (1 - fresh * fresh)
            d_z = g * (state - fresh) * z * (1 - z)
            d_r = d_fresh * own * r * (1 - r)
            d_in = np.concatenate((d_z, d_r, d_fresh), axis=1)
            d_own = np.concatenate((d_z, d_r, d_fresh * r), axis=1)
            np.add.at(grads[0][side], seg[:, t], d_in)
            grads[1][side] += state.T @ d_own
            back = g * z + d_own @ net.recur[side].T
    return grads, float(-(np.log(sure) * on).sum() / max(1.0, on.sum()))


def train(texts: list[str], target: list[int], languages: list[str], seed: int = 3) -> Network:
    """Fit by backpropagation through time; every letter's position is a training case."""
    rng = np.random.default_rng(seed)
    net = Network(languages, rng)
    pieces = [cut(t) for t in texts]
    params = [net.table, net.recur, net.out, net.bias]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    y = np.array(target)
    step = 0
    for _ in range(EPOCHS):
        drawn = [(i, r) for i, p in enumerate(pieces) if len(p) for r in rng.integers(0, len(p), DRAWN)]
        rng.shuffle(drawn)
        for lo in range(0, len(drawn), BATCH):
            part = drawn[lo : lo + BATCH]
            seg = np.stack([pieces[i][r] for i, r in part])
            label = y[[i for i, _ in part]]
            grads, _ = gradients(net, seg, label)
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            shrink = min(1.0, 1.0 / (norm + 1e-9))
            scale = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for i, g in enumerate(grads):
                g *= shrink
                m1[i] += 0.1 * (g - m1[i])
                m2[i] += 0.001 * (g * g - m2[i])
                params[i] -= scale * m1[i] / (np.sqrt(m2[i]) + 1e-8)
    return net


def fit(rows: list[tuple[str | None, str]]) -> Network | None:
    """Fit on ``(text, lang)`` rows; None where there is nothing to learn from."""
    rows = [(t, x) for t, x in rows if t and _LETTER.search(t)]
    languages = sorted({x for _, x in rows})
    if not languages:
        return None
    return train([t for t, _ in rows], [languages.index(x) for _, x in rows], languages)


def fit_from_table(documents: DataFrame, most: int = MOST_PER_LANGUAGE) -> Network | None:
    """Fit on about ``most`` documents of each language outside the held-out fold."""
    ids = by_class(documents, "lang", most).withColumnRenamed("lang", "target")
    found = texts_of(documents.where("lang is not null"), ids, "text", "lang").where("lang = target").orderBy("doc_id")
    return fit([(r.text, r.lang) for r in found.collect()])


def predict(texts: list[str | None], net: Network | None) -> tuple[list[str], np.ndarray]:
    """Language and its pooled probability for each text."""
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    at = [i for i, t in enumerate(texts) if net is not None and t and _LETTER.search(t)]
    if not at:
        return langs, scores
    pieces = [cut(texts[i]) for i in at]
    segments = np.concatenate(pieces)
    owner = np.repeat(np.arange(len(at)), [len(p) for p in pieces])
    total = np.zeros((len(at), len(net.languages)))
    for lo in range(0, len(segments), SIDE_BY_SIDE):
        part = segments[lo : lo + SIDE_BY_SIDE]
        p = net.probabilities(part)
        p *= _IS_LETTER[part].T[:, :, None]
        np.add.at(total, owner[lo : lo + SIDE_BY_SIDE], p.sum(axis=0))
    total /= total.sum(axis=1, keepdims=True)
    best = total.argmax(axis=1)
    for k, i in enumerate(at):
        langs[i] = net.languages[best[k]]
        scores[i] = total[k, best[k]]
    return langs, scores.clip(0, 1)


def identify(documents: DataFrame, net: Network | None, text: str = "text", name: str = "language") -> DataFrame:
    """Adds a struct ``language(lang, score)`` to every row.

    Whole texts of any length are read, in segments of ``SEGMENT`` bytes that know nothing of
    one another; the probabilities of all letters are pooled. A text shorter than a segment
    is one short read. ``lang`` is ``und`` with score 0 for a null text, one without a
    letter, and everywhere if there was nothing to learn from; of equal probabilities the
    first language by name counts. Repeated rows come back as often as they came, an empty
    table stays empty. Other columns pass through; one of that name is replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(net)

    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in series:
            lang, score = [], []
            part: list = []
            size = 0
            for i, t in enumerate(s):
                part.append(t)
                size += len(t or "")
                if size > SEGMENT * SIDE_BY_SIDE or i == len(s) - 1:
                    found, p = predict(part, shared.value)
                    lang += found
                    score.append(p)
                    part, size = [], 0
            yield pd.DataFrame({"lang": lang, "score": np.concatenate(score) if score else np.zeros(0)})

    return documents.withColumn(name, F.pandas_udf(run, "lang string, score double")(F.col(text)))


def language_digest(documents: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, held_out, lang_pred, score."""
    told = identify(documents.select("doc_id", "text"), fit_from_table(documents))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
