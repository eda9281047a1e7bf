"""Quality rules: base counts, and a hashed n-gram logistic regression.

Base counts are exact and take whole texts. The model adds three means: of the
weights of a text's words, of its words' character 3- to 5-grams, and of its word
pairs, all hashed into one table. It is fitted on a bounded sample of labelled
rows by gradient steps, calibrated by a logistic curve on labelled rows that the
fit did not see, and scored in Arrow batches against a fixed probability.

Defined cases: a null or empty text has no words and fails the base rules; a
label other than 0 or 1 and a label without a text take no part; with labels of
one kind only the model keeps whatever passes the base rules; a very long text
is scored whole, and only those of at most ``TRAINING_TEXT_BYTES`` bytes take
part in the fit; a null id is kept as null and has no label; a probability that
equals the threshold is kept; repeated rows are separate documents; other
columns, whatever their names, are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .words import WordIds, hash_sample, id_and_text, keep_rows, raw_texts, slices, sole

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50

#: Labelled rows the model is fitted and calibrated on (about so many, at most twice as many).
TRAINING_ROWS = 3_000
#: Longer texts are scored like all others but do not take part in the fit.
TRAINING_TEXT_BYTES = 65_536
#: One in so many of them, by hash of the text, is kept for calibration.
CALIBRATION_SHARE = 4
#: Documents whose calibrated probability of good quality is lower are not kept.
KEEP_PROBABILITY = 0.5

TABLE_BITS, STEPS, RATE, DECAY = 18, 80, 0.3, 1e-5
GRAMS = (3, 4, 5)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


def _bucket(h: np.ndarray, group: int) -> np.ndarray:
    """Table entries of 64-bit values, salted by feature group."""
    h = (h + np.uint64(group + 1)) * _MIX
    return ((h ^ (h >> np.uint64(29))) * _MIX >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _char_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every character n-gram of every word with a space at both ends."""
    text = b"".join(b" " + w + b" " for w in words).decode()
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter((len(w.decode()) + 2 for w in words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    room = ends[owner] - np.arange(len(points))  # characters left in the word
    owners, buckets = [], []
    h = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = h[: len(points) - n + 1] * _STEP + points[n - 1 :] if n > 1 else points.copy()
        if n in GRAMS:
            at = np.flatnonzero(room[: len(h)] >= n)
            owners.append(owner[at])
            buckets.append(_bucket(h[at], n))
    return np.concatenate(owners), np.concatenate(buckets)


def _pair_buckets(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _bucket(first * _STEP ^ (second + _MIX), 2)


@dataclass
class _Block:
    """Features of a run of texts, one after the other: eight bytes each."""

    rows: slice
    sizes: np.ndarray
    column: np.ndarray
    value: np.ndarray

    def sums(self, w: np.ndarray) -> np.ndarray:
        """Sum of weight times value for each text."""
        out, there = np.zeros(len(self.sizes)), np.flatnonzero(self.sizes)
        if len(there):
            starts = (np.cumsum(self.sizes) - self.sizes)[there]
            out[there] = np.add.reduceat(w.take(self.column) * self.value, starts)
        return out

    def back(self, error: np.ndarray, size: int) -> np.ndarray:
        """Sum of error times value for each table entry."""
        return np.bincount(self.column, weights=self.value * np.repeat(error, self.sizes), minlength=size)


def _feature_blocks(texts: list[bytes], texts_each: int = 64) -> Iterator[_Block]:
    """Table entries and values of each text: the mean of each kind of feature."""
    for first in range(0, len(texts), texts_each):
        some, sizes, columns, values = texts[first : first + texts_each], [], [], []
        for text in some:
            words, before = text.split(), sum(map(len, columns))
            if words:
                kinds = WordIds()
                own = np.fromiter(map(kinds.__getitem__, words), dtype=np.int64, count=len(words))
                hashes, times = _word_hashes(list(kinds)), np.bincount(own)
                owner, grams = _char_buckets(list(kinds))
                for bucket, weight in ((_bucket(hashes, 0), times), (grams, times[owner]), (_pair_buckets(hashes[own[:-1]], hashes[own[1:]]), np.ones(len(own) - 1))):
                    if len(bucket):
                        kind, at = np.unique(bucket, return_inverse=True)
                        columns.append(kind.astype(np.int32))
                        values.append((np.bincount(at, weights=weight) / weight.sum()).astype(np.float32))
            sizes.append(sum(map(len, columns)) - before)
        none = [np.zeros(0, dtype=np.int32)]
        yield _Block(slice(first, first + len(some)), np.array(sizes), np.concatenate(columns or none), np.concatenate(values or none))


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * logits + self.offset, -50, 50)))

    @classmethod
    def fit(cls, texts: list[bytes], labels: list[int]) -> QualityModel:
        """Full-batch Adam on the rows not kept for calibration, then a logistic curve on the rest."""
        from xxhash import xxh64_intdigest

        y = np.array(labels, dtype=float)
        aside = np.array([xxh64_intdigest(t, seed=7) % CALIBRATION_SHARE == 0 for t in texts], dtype=bool)
        if len({*y[~aside]}) < 2 or len({*y[aside]}) < 2:
            return cls(np.zeros(1 << TABLE_BITS, dtype=np.float32), 0.0, 0.0, 50.0)
        blocks = list(_feature_blocks(texts))
        size = 1 << TABLE_BITS
        fit = ~aside
        share = y[fit].mean()
        importance = np.where(fit, np.where(y == 1, 0.5 / share, 0.5 / (1 - share)), 0.0) / fit.sum()  # both kinds weigh alike
        w, m, v, bias, mb, vb = np.zeros(size), np.zeros(size), np.zeros(size), 0.0, 0.0, 0.0
        logits = np.zeros(len(y))
        for step in range(1, STEPS + 1):
            g, error = DECAY * w / len(y), np.zeros(len(y))
            for block in blocks:
                own = block.rows
                logits[own] = block.sums(w) + bias
                error[own] = (1.0 / (1.0 + np.exp(-np.clip(logits[own], -50, 50))) - y[own]) * importance[own]
                g += block.back(error[own], size)
            gb = error.sum()
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            a, b = 1 - 0.9**step, 1 - 0.999**step
            w -= RATE * (m / a) / (np.sqrt(v / b) + 1e-9)
            bias -= RATE * (mb / a) / (np.sqrt(vb / b) + 1e-9)
        for block in blocks:
            logits[block.rows] = block.sums(w) + bias
        slope, offset = _logistic_curve(logits[aside], y[aside])
        return cls(w.astype(np.float32), float(bias), slope, offset)


def _logistic_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y) = 1 / (1 + exp(-(slope * x + offset))), by damped Newton steps.

    Targets are drawn in a little, as if each kind had been seen once more, so
    that separable rows have a finite curve.
    """
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = x.std() or 1.0
    z = (x - x.mean()) / scale
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        d, h = p - target, p * (1 - p) + 1e-9
        g = np.array([(d * z).sum(), d.sum()])
        hessian = np.array([[(h * z * z).sum() + 1e-6, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        da, db = np.linalg.solve(hessian, g)
        most = max(1.0, abs(da), abs(db))
        a, b = a - da / most, b - db / most
        if max(abs(da), abs(db)) < 1e-9:
            break
    a = max(a, 0.0)
    return float(a / scale), float(b - a * x.mean() / scale)


class _Scorer:
    """Base counts and logits of batches; words' weights are kept for the next ones."""

    def __init__(self, model: QualityModel, limit: int = 600_000):
        self.model, self.limit = model, limit
        self._clear()

    def _clear(self) -> None:
        self.ids, self.filled = WordIds(), 0
        self.hashes = np.zeros(1 << 16, dtype=np.uint64)
        self.weights = np.zeros((1 << 16, 3))  # of the word, of its n-grams together, their number

    def _learn(self) -> None:
        n = len(self.ids)
        if n > len(self.hashes):
            grown = max(n, 2 * len(self.hashes))
            self.hashes, self.weights = np.resize(self.hashes, grown), np.resize(self.weights, (grown, 3))
        fresh, table = (list(self.ids)[self.filled :] if self.filled < n else []), self.model.weights
        for at in range(0, len(fresh), 20_000):
            own, first = fresh[at : at + 20_000], self.filled + at
            hashes = _word_hashes(own)
            owner, grams = _char_buckets(own)
            self.hashes[first : first + len(own)] = hashes
            self.weights[first : first + len(own)] = np.stack(
                (table[_bucket(hashes, 0)], np.bincount(owner, weights=table[grams], minlength=len(own)), np.bincount(owner, minlength=len(own))), axis=1
            )
        self.filled = n

    def batch(self, texts: list[bytes]) -> tuple[list[list[int]], np.ndarray]:
        """(n_words, n_symbols, n_dup_lines, n_repeat_words) and the logit of each text."""
        if len(self.ids) > self.limit:
            self._clear()
        split = [t.split() for t in texts]
        sizes = np.array([len(w) for w in split], dtype=np.int64)
        index = np.fromiter((i for w in split for i in map(self.ids.__getitem__, w)), dtype=np.int64, count=int(sizes.sum()))
        self._learn()
        table, ends = self.model.weights, np.cumsum(sizes)
        rows, logits = [], np.full(len(texts), self.model.bias)
        for k, (text, a, b) in enumerate(zip(texts, (ends - sizes).tolist(), ends.tolist(), strict=True)):
            own = index[a:b]
            lines = [x for x in text.split(b"\n") if x.strip()]
            rows.append([b - a, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len({*lines}), repeated_words(own)])
            if b > a:
                word, gram, grams = self.weights[own].sum(axis=0)
                logits[k] += word / (b - a) + (gram / grams if grams else 0.0)
                if b - a > 1:
                    hashes = self.hashes[own]
                    logits[k] += table[_pair_buckets(hashes[:-1], hashes[1:])].mean()
        return rows, logits


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in three-word windows found twice or more; ids number the words exactly."""
    n = len(ids)
    if n < 4:
        return 0
    if ids.max() >= 1 << 21:  # three numbers then no longer fit 63 bits
        ids = np.unique(ids, return_inverse=True)[1]
        if ids.max() >= 1 << 21:
            pair = np.unique(ids[:-1] << 32 | ids[1:], return_inverse=True)[1]
            windows = pair[:-1] << 32 | pair[1:]
        else:
            windows = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    else:
        windows = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n - 2, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    inside = np.zeros(n, dtype=bool)
    for k in range(3):
        inside[k : n - 2 + k] |= again
    return int(inside.sum())


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on a bounded sample of the labelled rows, chosen by hash of the id."""
    some = hash_sample(labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL"), rows)
    own = id_and_text(docs, id_col, text_col).where(F.octet_length("text") <= TRAINING_TEXT_BYTES)
    found = own.join(F.broadcast(some), "doc_id").limit(2 * rows).select("text", "label").collect()  # the sample is bounded
    return QualityModel.fit([r.text.encode() for r in found], [r.label for r in found])


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"


def _scorer(spark: SparkSession, model: QualityModel) -> Callable[[], _Scorer]:
    """Gets a worker's scorer, made once and kept between tasks."""
    key = hashlib.sha256(model.weights.tobytes() + repr((model.bias, model.slope, model.offset)).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(model)  # one table of 2**18 weights: one megabyte

    return lambda: sole(("quality", key), lambda: _Scorer(shared.value))


def _failed(words: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    return (words < LEAST_WORDS) | (100 * repeats > MOST_REPEATED_PERCENT * words)


def score(docs: DataFrame, model: QualityModel, keep: float = KEEP_PROBABILITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, the calibrated probability and the verdict on every whole text."""
    get = _scorer(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = get()
        for batch in slices(batches):
            texts = raw_texts(batch.column("text"))
            rows, logits = scorer.batch(texts)
            n, symbols, lines, repeats = np.array(rows, dtype=np.int64).T
            white = np.array([len(t) - len(t.translate(None, WHITE)) for t in texts], dtype=np.int64)
            points = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            failed, p = _failed(n, repeats), scorer.model.probability(logits)
            columns = [pa.array(x) for x in (n, points - white, symbols, lines, repeats, failed, p, ~failed & (p >= keep))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=[x.split()[0] for x in RESULT.split(", ")])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, RESULT)


def keep_good(docs: DataFrame, model: QualityModel, keep: float = KEEP_PROBABILITY, text_col: str = "text") -> DataFrame:
    """Documents, as they were, that pass the base rules and the model."""
    get = _scorer(docs.sparkSession, model)

    def verdict() -> Callable[[pa.RecordBatch], np.ndarray]:
        def decide(batch: pa.RecordBatch) -> np.ndarray:
            rows, logits = get().batch(raw_texts(batch.column(text_col)))
            n, _, _, repeats = np.array(rows, dtype=np.int64).T
            return ~_failed(n, repeats) & (get().model.probability(logits) >= keep)

        return decide

    return keep_rows(docs, verdict, text_col)
