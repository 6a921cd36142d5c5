"""Toxicity by a convolutional text classifier trained in numpy.

A word is the mean of hashed embeddings: of the word and of its first four to seven
letters, so that words of one stem share a part. Filters of ``WIDTHS`` words slide over the
text, each keeps its maximum, and a logistic unit reads the maxima. Training is plain
backpropagation (Adam); through the maximum only the winning windows get a gradient.

A filter is linear before its maximum, so for scoring each distinct word's answers to all
filter positions are computed once and a text is scored by gathering and adding them.

Thresholds are calibrated by language on labelled texts kept out of the training: the raw
score at which a language's F1 is best is mapped to ``THRESHOLD``. The language is guessed
from the text alone, by frequent words learned from the fitting sample.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.sampling import by_class, held_out, texts_of

#: Most labelled rows to fit on, for each of the two labels.
MOST_PER_LABEL = 2000
THRESHOLD = 0.3
BUCKETS = 1 << 15
SIZE = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Blank words after each text: as many as the widest filter has words.
BLANKS = max(WIDTHS)
PREFIXES = (4, 5, 6, 7)
EPOCHS = 7
BATCH = 32
RATE = 0.01
#: Share of each step by which touched embeddings shrink, so that words without a say stay near zero.
DECAY = 0.02
#: Buckets met in fewer fitted texts stay at zero: they could only be learnt by heart.
LEAST_TEXTS = 3
#: Distinct words a worker remembers before it starts afresh.
WORDS_KEPT = 100_000

_OTHER = re.compile(r"[\W\d_]+")
_OFFSETS = [(k, j) for k in WIDTHS for j in range(k)]


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def buckets(word: str) -> list[int]:
    """Hash buckets of a word: itself and its prefixes; marks and digits do not count."""
    plain = _OTHER.sub("", word)
    parts = [plain, *(f"<{plain[:n]}" for n in PREFIXES)]
    return [zlib.crc32(p.encode("utf-8")) % (BUCKETS - 1) + 1 for p in parts] if plain else [0] * (1 + len(PREFIXES))


class Model:
    """Parameters and the scoring of word lists."""

    def __init__(self, rng: np.random.Generator):
        self.embed = (rng.standard_normal((BUCKETS, SIZE)) * 0.02).astype(np.float32)
        self.embed[0] = 0
        self.conv = (rng.standard_normal((len(_OFFSETS), SIZE, FILTERS)) * 0.3).astype(np.float32)
        self.bias = np.zeros((len(WIDTHS), FILTERS), dtype=np.float32)
        self.out = (rng.standard_normal(len(WIDTHS) * FILTERS) * 0.3).astype(np.float32)
        self.out_bias = np.zeros(1, dtype=np.float32)
        self.votes: dict[str, int] = {}
        self.thresholds: np.ndarray = np.array([0.5])
        self.prior: float | None = None

    def answers(self, rows: np.ndarray) -> np.ndarray:
        """Answers of words (rows of bucket numbers) to every filter position."""
        e = self.embed[rows].mean(axis=1)
        return np.einsum("we,oef->wof", e, self.conv, optimize=True).reshape(len(rows), -1)

    def pool(self, answers: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Maxima over texts laid end to end, each followed by ``BLANKS`` blank words.

        A window begins at a word or at the first blank, so none reaches into the next text.
        """
        n, out = len(answers), []
        beyond = np.append(begins[1:], n)[:, None] - np.arange(1, BLANKS)
        for w, k in enumerate(WIDTHS):
            first = sum(WIDTHS[:w])
            total = answers[:, first * FILTERS : (first + 1) * FILTERS].copy()
            for j in range(1, k):
                total[: n - j] += answers[j:, (first + j) * FILTERS : (first + j + 1) * FILTERS]
            total[beyond] = -np.inf
            out.append(np.maximum.reduceat(total, begins, axis=0) + self.bias[w])
        return np.maximum(np.concatenate(out, axis=1), 0)

    def raw(self, pooled: np.ndarray) -> np.ndarray:
        # Row by row, so that equal texts score alike wherever they stand in a batch.
        return 1 / (1 + np.exp(-((pooled * self.out).sum(axis=1) + self.out_bias[0])))


def _flat(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end with ``BLANKS`` blanks (word 0) after each, and where each begins."""
    blank = np.zeros(BLANKS, dtype=np.int64)
    flat = np.concatenate([x for t in texts for x in (t, blank)])
    lengths = np.array([len(t) + BLANKS for t in texts])
    return flat, np.cumsum(lengths) - lengths


def gradients(model: Model, texts: list[np.ndarray], rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], float]:
    """Gradients of the weighted log loss by backpropagation, and the loss.

    ``texts`` are word numbers, ``rows`` the buckets of each word. Returns the buckets
    touched with their gradient, the gradients of filters, biases and output, and the loss.
    """
    flat, begins = _flat(texts)
    used, where = np.unique(flat, return_inverse=True)
    e = model.embed[rows[used]].mean(axis=1)
    table = np.einsum("we,oef->wof", e, model.conv, optimize=True)
    ends = np.append(begins[1:], len(flat))
    pooled = np.zeros((len(texts), len(WIDTHS), FILTERS), dtype=e.dtype)
    best = np.zeros(pooled.shape, dtype=np.int64)
    for w, k in enumerate(WIDTHS):
        first = sum(WIDTHS[:w])
        total = table[where, first].copy()
        for j in range(1, k):
            total[: len(flat) - j] += table[where[j:], first + j]
        for d in range(len(texts)):
            part = total[begins[d] : ends[d] - BLANKS + 1]
            best[d, w] = begins[d] + part.argmax(axis=0)
            pooled[d, w] = part.max(axis=0)
    pooled += model.bias
    on = pooled > 0
    active = np.where(on, pooled, 0).reshape(len(texts), -1)
    p = model.raw(active)
    g = ((p - y) * weight).astype(e.dtype)
    grads = [np.zeros_like(x) for x in (model.conv, model.bias, model.out, model.out_bias)]
    back = (g[:, None] * model.out).reshape(pooled.shape) * on
    d_e = np.zeros_like(e)
    for w, k in enumerate(WIDTHS):
        for j in range(k):
            o = sum(WIDTHS[:w]) + j
            at = where[np.minimum(best[:, w] + j, len(flat) - 1)]
            for f in range(FILTERS):
                grads[0][o, :, f] += e[at[:, f]].T @ back[:, w, f]
                np.add.at(d_e, at[:, f], back[:, w, f, None] * model.conv[o, :, f])
    grads[1] += back.sum(axis=0)
    grads[2] += active.T @ g
    grads[3] += g.sum()
    touched = rows[used].reshape(-1)
    d_rows = np.repeat(d_e / rows.shape[1], rows.shape[1], axis=0)
    unique, inverse = np.unique(touched, return_inverse=True)
    d_embed = np.zeros((len(unique), SIZE), dtype=e.dtype)
    np.add.at(d_embed, inverse, d_rows)
    sure = np.where(y > 0, p, 1 - p).clip(1e-12, 1)
    return unique, d_embed, grads, float(-(weight * np.log(sure)).sum())


def train(texts: list[list[str]], toxic: list[int], seed: int = 7) -> Model:
    """Fit the network on word lists and labels."""
    rng = np.random.default_rng(seed)
    model = Model(rng)
    vocabulary: dict[str, int] = {"": 0}
    coded = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in t], dtype=np.int64) for t in texts]
    rows = np.array([buckets(w) for w in vocabulary])
    met = np.zeros(BUCKETS, dtype=np.int64)
    for t in coded:
        met[np.unique(rows[np.unique(t)])] += 1
    rows = np.where(met[rows] >= LEAST_TEXTS, rows, 0)
    model.embed[met < LEAST_TEXTS] = 0
    y = np.array(toxic, dtype=np.float32)
    weight = np.where(y > 0, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean())).clip(0, 10)
    params = [model.embed, model.conv, model.bias, model.out, model.out_bias]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(coded))
        for lo in range(0, len(order), BATCH):
            batch = order[lo : lo + BATCH]
            unique, d_embed, grads, _ = gradients(model, [coded[i] for i in batch], rows, y[batch], weight[batch] / len(batch))
            step += 1
            scale = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for i, (x, gx) in enumerate(zip(params[1:], grads), start=1):
                m1[i] += 0.1 * (gx - m1[i])
                m2[i] += 0.001 * (gx * gx - m2[i])
                x -= scale * m1[i] / (np.sqrt(m2[i]) + 1e-8)
            m1[0][unique] += 0.1 * (d_embed - m1[0][unique])
            m2[0][unique] += 0.001 * (d_embed * d_embed - m2[0][unique])
            model.embed[unique] *= 1 - DECAY
            model.embed[unique] -= scale * m1[0][unique] / (np.sqrt(m2[0][unique]) + 1e-8)
            model.embed[0] = 0
    return model


class Scorer:
    """Scores texts with a model; remembers each distinct word's answers up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[str, int] = {"": 0}
        width = len(_OFFSETS) * FILTERS
        self.table = np.zeros((WORDS_KEPT // 8, width), dtype=np.float32)
        self.vote = np.zeros(len(self.table), dtype=np.int64)

    def _code(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.ids) > WORDS_KEPT:
            self._reset()
        before = len(self.ids)
        ids = self.ids
        coded = [np.fromiter((ids.setdefault(w, len(ids)) for w in t), dtype=np.int64, count=len(t)) for t in texts]
        if len(ids) > before:
            fresh = [w for w, _ in zip(reversed(ids), range(len(ids) - before))][::-1]
            if len(ids) > len(self.table):
                grown = max(2 * len(self.table), len(ids))
                self.table = np.concatenate((self.table, np.zeros((grown - len(self.table), self.table.shape[1]), dtype=np.float32)))
                self.vote = np.concatenate((self.vote, np.zeros(grown - len(self.vote), dtype=np.int64)))
            for lo in range(0, len(fresh), 20_000):
                part = fresh[lo : lo + 20_000]
                self.table[before + lo : before + lo + len(part)] = self.model.answers(np.array([buckets(w) for w in part]))
                self.vote[before + lo : before + lo + len(part)] = [self.model.votes.get(w, 0) for w in part]
        return coded

    def features(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Pooled maxima and guessed language (0: none) of each text."""
        pooled, langs = [], []
        n_langs = len(self.model.thresholds)
        part: list[np.ndarray] = []
        size = 0
        for i, t in enumerate(coded := self._code(texts)):
            part.append(t)
            size += len(t)
            if size > 60_000 or i == len(coded) - 1:
                flat, begins = _flat(part)
                pooled.append(self.model.pool(self.table[flat], begins))
                votes = np.stack([np.add.reduceat((self.vote[flat] == k).astype(np.int64), begins) for k in range(1, n_langs)], axis=1) if n_langs > 1 else np.zeros((len(part), 1))
                langs.append(np.where(votes.max(axis=1) > 0, votes.argmax(axis=1) + 1, 0))
                part, size = [], 0
        return np.concatenate(pooled), np.concatenate(langs)

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        if self.model.prior is not None:
            return np.full(len(texts), self.model.prior)
        pooled, langs = self.features(texts)
        raw = self.model.raw(pooled)
        cut = self.model.thresholds[langs]
        return np.where(raw < cut, THRESHOLD * raw / cut, THRESHOLD + (1 - THRESHOLD) * (raw - cut) / (1 - cut)).clip(0, 1)


def _language_words(texts: list[list[str]], langs: list[str | None], most: int = 60) -> tuple[dict[str, int], list[str]]:
    """Words that are frequent in one language of the sample and rarer in each other."""
    names = sorted({x for x in langs if x is not None})
    shares = []
    for name in names:
        counts = Counter(w for t, x in zip(texts, langs) if x == name for w in t)
        total = sum(counts.values()) or 1
        shares.append({w: c / total for w, c in counts.most_common(400)})
    votes = {}
    for i, own in enumerate(shares):
        typical = [w for w, s in own.items() if all(s > 3 * other.get(w, 0) for j, other in enumerate(shares) if j != i)]
        votes.update({w: i + 1 for w in typical[:most]})
    return votes, names


def _best_cut(raw: np.ndarray, y: np.ndarray, clean_weight: float) -> float:
    """The cut with the best F1, in the middle of its gap; 0.5 where there is only one label.

    Each clean text stands for ``clean_weight`` of them, as the sample holds fewer than the table.
    """
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-raw, kind="stable")
    r, t = raw[order], np.cumsum(y[order])
    f1 = 2 * t / (t + clean_weight * (np.arange(1, len(t) + 1) - t) + y.sum())
    last = np.append(r[1:] < r[:-1], True)
    i = int(np.argmax(np.where(last, f1, -1)))
    below = r[i + 1] if i + 1 < len(r) else 0.0
    return float(np.clip((r[i] + below) / 2, 0.02, 0.98))


def fit(rows: list[tuple[int, str | None, str | None, int]], clean_weight: float = 1.0) -> Model:
    """Fit on ``(doc_id, text, lang, toxic)`` rows: three quarters train, one quarter calibrates."""
    texts = [words_of(t) for _, t, _, _ in rows]
    y = [int(bool(x)) for *_, x in rows]
    if len(set(y)) < 2:
        model = Model(np.random.default_rng(0))
        model.prior = 0.0 if not y or not y[0] else 1.0
        return model
    tune = [zlib.crc32(f"tune{i}".encode()) % 4 == 0 for i, *_ in rows]
    use = [i for i, t in enumerate(tune) if not t]
    if len({y[i] for i in use}) < 2 or len({y[i] for i, t in enumerate(tune) if t}) < 2:
        use, tune = list(range(len(rows))), [True] * len(rows)
    model = train([texts[i] for i in use], [y[i] for i in use])
    model.votes, names = _language_words(texts, [lang for _, _, lang, _ in rows])
    model.thresholds = np.full(len(names) + 1, 0.5)
    at = [i for i, t in enumerate(tune) if t]
    pooled, langs = Scorer(model).features([texts[i] for i in at])
    raw, label = model.raw(pooled), np.array([y[i] for i in at])
    whole = _best_cut(raw, label, clean_weight)
    for k in range(len(names) + 1):
        mine = langs == k
        # A language with few positive texts to calibrate on shares the common threshold.
        model.thresholds[k] = _best_cut(raw[mine], label[mine], clean_weight) if label[mine].sum() >= 15 else whole
    return model


def fit_from_tables(documents: DataFrame, labels: DataFrame, most: int = MOST_PER_LABEL) -> Model:
    """Fit on about ``most`` labelled rows of each label outside the held-out fold."""
    found = texts_of(documents, by_class(labels, "toxic", most), "text", "lang").orderBy("doc_id")
    learnt = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    n_toxic, n_clean = learnt.agg(F.count_if(F.col("toxic") != 0), F.count_if(F.col("toxic") == 0)).first()
    thinned = lambda n: max(1.0, n / most)
    return fit([(r.doc_id, r.text, r.lang, r.toxic) for r in found.collect()], thinned(n_clean) / thinned(n_toxic))


def score_documents(documents: DataFrame, model: Model, text: str = "text", score: str = "toxicity") -> DataFrame:
    """Adds ``toxicity`` (0 to 1; ``THRESHOLD`` is the calibrated cut) to every row.

    Whole texts of any length are scored; null counts as empty. Equal texts score alike,
    repeated rows come back as often as they came, an empty table stays empty. Other columns
    pass through, whatever their names; one of that name is replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for s in series:
            made = [scorer.scores([words_of(t) for t in s.iloc[lo : lo + 256]]) for lo in range(0, len(s), 256)]
            yield pd.Series(np.concatenate(made) if made else np.zeros(0), dtype=np.float64)

    return documents.withColumn(score, F.pandas_udf(run, "double")(F.col(text)))


def toxicity_digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, held_out, score, predicted."""
    scored = score_documents(documents.select("doc_id", "text"), fit_from_tables(documents, labels))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"),
    )
