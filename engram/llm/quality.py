"""Quality by co-training: a text view and a metadata view teach each other.

The text view sees the words, as log odds of hashed tokens between good and bad texts, and
measures of the text (shares of capitals, marks, digits, repeated words and lines, lengths);
the metadata view sees source, language and length. Both are logistic models over one-hot
quantile bins and hashed names. A fitted text's tokens are weighed by the labels of the other
half of the texts, so that no text vouches for itself. In each round a view labels the pool of
unlabelled documents and hands its most confident labels to the other view. A view hands
over a label only above the confidence at which, on labelled rows kept aside, it was right
in ``SURE`` of the cases, so a view that knows nothing teaches nothing. At the end each view
is calibrated on the rows kept aside, and a logistic unit over the two calibrated log odds
scores every document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.sampling import by_class, held_out, texts_of
from engram.llm.substring_dedup import _WordHashes

#: Most labelled rows to fit on, for each label, and most unlabelled rows in the pool.
MOST_PER_LABEL = 2500
MOST_UNLABELLED = 2500
ROUNDS = 4
HANDED = 200
SURE = 0.97
#: A rejected good document is worse than a kept bad one, so the cut lies below one half.
KEEP = 0.3
BINS = 12
NAMES = 64
TOKENS = 1 << 14

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = b"0123456789"
_MARKS = b"#$%&*@^~<>{}[]\\/=+_"
_ENDS = b".,;:!?"


def text_measures(text: str | None) -> list[float]:
    """Measures of a whole text; zeros for an empty one."""
    raw = (text or "").encode("utf-8")
    n = len(raw)
    if not n:
        return [0.0] * 14

    def share(chars: bytes) -> float:
        return (n - len(raw.translate(None, chars))) / n

    words = raw.split()
    k = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper, lower = share(_UPPER), share(_LOWER)
    return [
        upper / max(1e-9, upper + lower),
        share(b"!"),
        share(_MARKS),
        share(b"|"),
        share(_DIGITS),
        np.log2(k),
        n / k,
        len(counts) / k,
        counts.most_common(1)[0][1] / k if counts else 0.0,
        sum(a == b for a, b in zip(words, words[1:])) / k,
        1 - len(set(lines)) / max(1, len(lines)),
        raw.count(b"\n") / n,
        share(_ENDS) * n / k,
        len(max(words, key=len)) if words else 0.0,
    ]


def token_buckets(text: str | None, table: _WordHashes) -> np.ndarray:
    """Hash buckets of the distinct lower-case words of a whole text."""
    words = (text or "").lower().encode("utf-8").split()
    return np.unique(np.fromiter(map(table.__getitem__, words), dtype=np.uint64, count=len(words)) & np.uint64(TOKENS - 1)).astype(np.int64)


def token_odds(tokens: list[np.ndarray], labels: dict[int, float], half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(odds of each text, odds of each bucket)``: log odds of the texts' tokens by the labelled texts.

    A labelled text is weighed by the labels of the other half, any other by both.
    """
    weights = []
    for k in (0, 1):
        counts = []
        for label in (1.0, 0.0):
            mine = [tokens[i] for i, y in labels.items() if y == label and half[i] == k]
            met = np.bincount(np.concatenate(mine), minlength=TOKENS) if mine else np.zeros(TOKENS)
            counts.append(np.log((met + 1) / (len(mine) + 2)))
        weights.append(counts[0] - counts[1])
    whole = (weights[0] + weights[1]) / 2
    return np.array([(weights[1 - half[i]] if i in labels else whole)[t].mean() if len(t) else 0.0 for i, t in enumerate(tokens)]), whole


def meta_measures(source: str | None, lang: str | None, n_chars: int | None) -> tuple[list[str], float]:
    """Names and the length of a document's metadata; a null is a name of its own."""
    return [f"source={source}", f"lang={lang}"], float(np.log2(1 + max(0, n_chars or 0)))


class View:
    """A logistic model over quantile bins of numbers and hash buckets of names."""

    def __init__(self, numbers: np.ndarray):
        self.edges = [np.unique(np.quantile(numbers[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(numbers.shape[1])] if len(numbers) else [np.zeros(0)] * numbers.shape[1]
        self.scale, self.shift = 1.0, 0.0

    def code(self, numbers: np.ndarray, names: list[list[str]]) -> np.ndarray:
        """Indices of the active features, one column a measure or name."""
        columns, base = [], 0
        for j, edges in enumerate(self.edges):
            columns.append(base + np.searchsorted(edges, numbers[:, j], "right"))
            base += len(edges) + 1
        for j in range(len(names[0]) if names else 0):
            columns.append(base + np.array([zlib.crc32(x[j].encode("utf-8")) % NAMES for x in names]))
            base += NAMES
        self.width = base
        return np.stack(columns, axis=1)

    def fit(self, codes: np.ndarray, y: np.ndarray, steps: int = 300, decay: float = 1e-3) -> None:
        self.weight, self.bias = np.zeros(self.width), 0.0
        m1, m2 = np.zeros(self.width + 1), np.zeros(self.width + 1)
        for s in range(1, steps + 1):
            g = (1 / (1 + np.exp(-self.logit(codes))) - y) / len(y)
            grad = np.bincount(codes.reshape(-1), np.repeat(g, codes.shape[1]), self.width) + decay * self.weight
            whole = np.append(grad, g.sum())
            m1 += 0.1 * (whole - m1)
            m2 += 0.01 * (whole * whole - m2)
            move = 0.1 * m1 / (1 - 0.9**s) / (np.sqrt(m2 / (1 - 0.99**s)) + 1e-8)
            self.weight -= move[:-1]
            self.bias -= move[-1]

    def logit(self, codes: np.ndarray) -> np.ndarray:
        return self.weight[codes].sum(axis=1) + self.bias

    def calibrated(self, codes: np.ndarray) -> np.ndarray:
        return self.scale * self.logit(codes) + self.shift


def _unit(x: np.ndarray, y: np.ndarray, decay: float = 1e-2) -> tuple[np.ndarray, float]:
    """Logistic weights (not negative) and bias over the columns of ``x``, by Newton steps."""
    w, b = np.full(x.shape[1], 1.0 / x.shape[1]), 0.0
    full = np.hstack((x, np.ones((len(x), 1))))
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ w + b).clip(-30, 30)))
        g = full.T @ (p - y) / len(y) + decay * np.append(w, 0)
        h = (full * (p * (1 - p))[:, None]).T @ full / len(y) + (decay + 1e-6) * np.eye(full.shape[1])
        move = np.linalg.solve(h, g).clip(-2, 2)
        w, b = np.maximum(w - move[:-1], 0), b - move[-1]
    return w, float(b)


class Model:
    """Two views, and how their log odds are joined."""

    def __init__(self, rows: list[tuple], pool: list[tuple], good_per_bad: float = 1.0, rounds: int = ROUNDS):
        """``rows``: (doc_id, text, source, lang, n_chars, quality); ``pool``: the same without a label.

        ``good_per_bad`` is how much more the sample thins out good rows than bad ones.
        """
        self.prior: float | None = None
        y = np.array([float(bool(r[5])) for r in rows])
        aside = np.array([zlib.crc32(f"aside{r[0]}".encode()) % 4 == 0 for r in rows], dtype=bool)
        if len(rows) < 8 or len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
            self.prior = float(y.mean()) if len(y) else 1.0
            return
        both = [*rows, *pool]
        measures = np.array([text_measures(r[1]) for r in both])
        table = _WordHashes()
        tokens = [token_buckets(r[1], table) for r in both]
        half = np.array([zlib.crc32(f"half{r[0]}".encode()) % 2 for r in both])
        meta = [meta_measures(r[2], r[3], r[4]) for r in both]
        length, names = np.array([[m[1]] for m in meta]), [m[0] for m in meta]
        n = len(rows)
        self.views = [None, View(length[:n])]
        codes = [None, self.views[1].code(length, names)]
        known = [dict(zip(np.flatnonzero(~aside), y[~aside])) for _ in self.views]
        free = [set(range(n, len(both))) for _ in self.views]
        for turn in range(rounds + 1):
            odds, self.tokens = token_odds(tokens, known[0], half)
            text = np.column_stack((measures, odds))
            self.views[0] = View(text[:n])
            codes[0] = self.views[0].code(text, [])
            for v, view in enumerate(self.views):
                at = np.fromiter(known[v], dtype=np.int64)
                view.fit(codes[v][at], np.array([known[v][i] for i in at]))
            if turn == rounds:
                break
            gained = 0
            for v, view in enumerate(self.views):
                other = 1 - v
                held = view.logit(codes[v][:n][aside])
                open_ = np.array(sorted(free[other]), dtype=np.int64)
                if not len(open_):
                    continue
                guess = view.logit(codes[v][open_])
                for label, sign in ((1.0, 1), (0.0, -1)):
                    cut = self._sure(sign * held, (y[aside] == label))
                    if cut is None:
                        continue
                    sure = np.flatnonzero(sign * guess >= cut)
                    for i in sure[np.argsort(-sign * guess[sure], kind="stable")][:HANDED]:
                        known[other][int(open_[i])] = label
                        free[other].discard(int(open_[i]))
                        gained += 1
            if not gained:
                break
        joined = []
        for v, view in enumerate(self.views):
            w, b = _unit(view.logit(codes[v][:n][aside])[:, None], y[aside])
            view.scale, view.shift = float(w[0]), b
            joined.append(view.calibrated(codes[v][:n][aside]))
        self.join, self.offset = _unit(np.stack(joined, axis=1), y[aside])
        self.offset += float(np.log(good_per_bad))

    @staticmethod
    def _sure(odds: np.ndarray, right: np.ndarray) -> float | None:
        """The least log odds from which on the labels were right in ``SURE`` of at least ten cases."""
        order = np.argsort(-odds, kind="stable")
        hits = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        ok = np.flatnonzero((hits >= SURE) & (np.arange(len(order)) >= 9))
        return float(odds[order[ok[-1]]]) if len(ok) else None

    def scores(self, rows: list[tuple], table: _WordHashes | None = None) -> np.ndarray:
        """Joined, text and metadata probabilities of (text, source, lang, n_chars) rows."""
        if self.prior is not None or not rows:
            return np.full((len(rows), 3), self.prior if self.prior is not None else 1.0)
        table = _WordHashes() if table is None else table
        odds = [self.tokens[t].mean() if len(t) else 0.0 for t in (token_buckets(r[0], table) for r in rows)]
        text = np.column_stack((np.array([text_measures(r[0]) for r in rows]), odds))
        meta = [meta_measures(r[1], r[2], r[3]) for r in rows]
        a = self.views[0].calibrated(self.views[0].code(text, []))
        b = self.views[1].calibrated(self.views[1].code(np.array([[m[1]] for m in meta]), [m[0] for m in meta]))
        joined = np.stack((a, b), axis=1) @ self.join + self.offset
        return 1 / (1 + np.exp(-np.stack((joined, a, b), axis=1).clip(-30, 30)))


def fit_from_tables(documents: DataFrame, labels: DataFrame, most: int = MOST_PER_LABEL, unlabelled: int = MOST_UNLABELLED) -> Model:
    """Fit on about ``most`` labelled rows a label and ``unlabelled`` others, held-out fold left out."""
    columns = ["doc_id", "text", "source", "lang", "n_chars"]
    rows = texts_of(documents, by_class(labels, "quality", most), *columns[1:]).orderBy("doc_id").collect()
    others = documents.select(F.col("doc_id").cast("bigint").alias("doc_id")).join(labels.select(F.col("doc_id").cast("bigint").alias("doc_id")), "doc_id", "left_anti")
    pool_ids = by_class(others.withColumn("pool", F.lit(1)), "pool", unlabelled)
    pool = texts_of(documents, pool_ids.select("doc_id"), *columns[1:]).orderBy("doc_id").collect()
    n_good, n_bad = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).agg(F.count_if(F.col("quality") != 0), F.count_if(F.col("quality") == 0)).first()
    thinned = lambda n: max(1.0, n / most)
    return Model([(*[r[c] for c in columns], r.quality) for r in rows], [tuple(r[c] for c in columns) for r in pool], thinned(n_good) / thinned(n_bad))


def score_documents(documents: DataFrame, model: Model, name: str = "quality_views") -> DataFrame:
    """Adds a struct ``quality_views(score, text_score, metadata_score)`` to every row.

    Whole texts of any length are measured; null text, source, lang or n_chars are values of
    their own. Equal rows score alike and come back as often as they came, an empty table
    stays empty. Other columns pass through; one of that name is replaced. Where labels teach nothing every score is the share of
    good labels (1 without any).
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        table = _WordHashes()
        for text, source, lang, n_chars in batches:
            rows = list(zip(text, source, lang, [None if pd.isna(x) else int(x) for x in n_chars]))
            yield pd.DataFrame(shared.value.scores(rows, table), columns=["score", "text_score", "metadata_score"])

    made = F.pandas_udf(run, "score double, text_score double, metadata_score double")
    return documents.withColumn(name, made(F.col("text"), F.col("source"), F.col("lang"), F.col("n_chars").cast("bigint")))


def quality_digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, text_score, metadata_score and whether the document is kept."""
    docs = documents.select("doc_id", "text", "source", "lang", "n_chars")
    told = score_documents(docs, fit_from_tables(documents, labels))
    return told.select("doc_id", "quality_views.*", (F.col("quality_views.score") >= KEEP).alias("keep"))


def good_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score reaches ``KEEP``; columns unchanged."""
    rows = documents.select("text", "source", "lang", "n_chars", F.struct(*documents.columns).alias("row"))
    told = score_documents(rows, fit_from_tables(documents, labels))
    return told.where(F.col("quality_views.score") >= KEEP).select("row.*")
