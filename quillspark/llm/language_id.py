"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A
word's probability is the sum, over all its segmentations into pieces, of the
products of their probabilities: a forward pass over the word's automaton
matches. A text's score is the sum of its words' log probabilities, and the
posterior of the best language, at equal priors, is the reported score.

Piece probabilities are fitted by expectation-maximisation (forward-backward
over all segmentations) on the words of a bounded sample of labelled documents.

Words are runs of letters, lower-cased, with the vocabulary's mark for a word
start. Forward passes run for all new words of a batch at once, position by
position; scores of words are kept per worker, in bounded tables. Every
``RESCALE`` positions the states that a later piece can still start from are
divided by the largest of them, and its logarithm is carried on, so that a word
of any length is summed over all its segmentations without leaving the range of
a double.

Defined cases: a null text or one without a letter is ``und`` with score 0; ties
go to the language that sorts first; a text whose words hold no known character
is scored by its word starts, all that languages then differ in; languages
unseen in training are never predicted; very long texts and words are scored whole, in time proportional to their length;
a null id is not held out and kept as null; repeated rows are separate documents;
other columns, whatever their names, are not looked at; an empty table gives no
rows, and without a learned language every text is ``und``.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .pieces import SPACE, PieceModel, cached_pieces
from .words import WordIds, hash_sample, id_and_text, keep_rows, raw_texts, slices, sole

LETTERS = regex.compile(r"\p{L}+")
UNDETERMINED = "und"

#: Labelled documents the model is fitted on (about so many, at most twice as many).
TRAINING_DOCUMENTS = 3_000
#: Longer texts are scored like all others but do not take part in the fit.
TRAINING_TEXT_BYTES = 65_536
ROUNDS = 3
#: Languages of a model, which is sent to every task: 134 MB of probabilities.
MOST_LANGUAGES = 512
#: Smallest probability of a piece, and of an unknown character in every language.
FLOOR, UNKNOWN = 1e-7, 1e-7
#: Positions between two rescalings: 1e-7 ** (16 + 8) is far from the smallest double.
RESCALE = 8


class Matches:
    """Automaton matches of many words, flat, ordered by end position within the word."""

    def __init__(self, model: PieceModel, words: list[str]):
        self.sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.base = np.concatenate(([0], np.cumsum(self.sizes + 1)))[:-1]  # a word of n characters has n + 1 states
        self.last = self.base + self.sizes
        self.states = int(self.sizes.sum()) + len(words)
        self.reach = model.longest
        ends, starts, pieces, depth = (array("i") for _ in range(4))  # four bytes each, not objects
        known = model.characters
        for base, word in zip(self.base.tolist(), words, strict=True):
            for last, (size, _, i) in model.automaton.iter(word):
                ends.append(base + last + 1)
                starts.append(base + last + 1 - size)
                pieces.append(i)
                depth.append(last)
            if not known.issuperset(word):
                for last, c in enumerate(word):
                    if c not in known:
                        ends.append(base + last + 1)
                        starts.append(base + last)
                        pieces.append(-1)
                        depth.append(last)
        depth = np.array(depth, dtype=np.int32)
        order = np.argsort(depth, kind="stable")
        self.end, self.start, self.piece = (np.array(x, dtype=np.int32)[order] for x in (ends, starts, pieces))
        self.cuts = np.searchsorted(depth[order], np.arange(depth.max(initial=-1) + 2))
        self.long = np.flatnonzero(self.sizes > RESCALE)
        self.long = self.long[np.argsort(-self.sizes[self.long], kind="stable")]  # those that go on come first

    def _rescale(self, x: np.ndarray, position: int, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Divide the states within reach of ``position`` by their largest value; (words, logarithms)."""
        words = self.long[: np.searchsorted(-self.sizes[self.long], -position)]  # longer than position
        window = self.base[words][:, None] + np.arange(max(0, position - self.reach + 1), position + 1)
        largest = x[window].max(axis=1)
        x[window] /= largest[:, None]
        logs[words] += np.log(largest)
        return words, np.log(largest)

    def _per_state(self, steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]], width: int) -> np.ndarray | None:
        """Sum of the logarithms that apply to each state; a step is (first states, states after the last, logarithms)."""
        if not steps:
            return None
        change = np.zeros((self.states + 1, width))
        for first, after, log in steps:
            np.add.at(change, first, log)
            np.subtract.at(change, after, log)
        return np.cumsum(change, axis=0)[:-1]

    def scaled_forward(self, p: np.ndarray, per_state: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Summed probability of all segmentations up to each state, for each column of p.

        Returns (alpha, logs, of_states): a word's total is ``log(alpha[last]) +
        logs``; if asked, ``of_states`` holds the logarithm each state's value
        has been divided by, or is None where no word is long.
        """
        alpha = np.zeros((self.states, p.shape[1]))
        alpha[self.base] = 1.0
        logs, steps, weight = np.zeros((len(self.sizes), p.shape[1])), [], p[self.piece]
        for position, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True), 1):
            np.add.at(alpha, self.end[a:b], alpha[self.start[a:b]] * weight[a:b])
            if position % RESCALE == 0 and len(self.long):
                words, log = self._rescale(alpha, position, logs)
                if per_state:
                    steps.append((self.base[words] + max(0, position - self.reach + 1), self.last[words] + 1, log))
        return alpha, logs, self._per_state(steps, p.shape[1])

    def scaled_backward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """The same from the words' ends, with the logarithm of each state."""
        beta = np.zeros((self.states, p.shape[1]))
        beta[self.last] = 1.0
        logs, steps, weight = np.zeros((len(self.sizes), p.shape[1])), [], p[self.piece]
        for position in range(len(self.cuts) - 2, -1, -1):  # pieces that end at position + 1 are the next ones
            a, b = self.cuts[position], self.cuts[position + 1]
            np.add.at(beta, self.start[a:b], beta[self.end[a:b]] * weight[a:b])
            if position and position % RESCALE == 0 and len(self.long):
                words, log = self._rescale(beta, position, logs)
                steps.append((self.base[words], self.base[words] + position + 1, log))
        return beta, logs, self._per_state(steps, p.shape[1])

    def forward(self, p: np.ndarray) -> np.ndarray:
        """(states, languages): the probabilities themselves, which a double holds for words of some 40 characters."""
        alpha, _, ahead = self.scaled_forward(p, per_state=True)
        return alpha if ahead is None else alpha * np.exp(ahead)

    def backward(self, p: np.ndarray) -> np.ndarray:
        beta, _, behind = self.scaled_backward(p)
        return beta if behind is None else beta * np.exp(behind)

    def expected(self, p: np.ndarray, times: np.ndarray, size: int) -> np.ndarray:
        """Expected uses of each of ``size`` entries of the one-column p, words counted ``times``."""
        alpha, logs, ahead = self.scaled_forward(p, per_state=True)
        beta, _, behind = self.scaled_backward(p)
        total = np.log(alpha[self.last, 0]) + logs[:, 0]
        own = np.searchsorted(self.base, self.start, side="right") - 1
        scale = -total[own]
        if ahead is not None:
            scale += ahead[self.start, 0]
        if behind is not None:
            scale += behind[self.end, 0]
        uses = alpha[self.start, 0] * p[self.piece, 0] * beta[self.end, 0] * np.exp(scale) * times[own]
        return np.bincount(self.piece % size, weights=uses, minlength=size)


def letters(chunk: bytes) -> list[str]:
    """Words of a chunk in the vocabulary's form."""
    return [SPACE + w for w in LETTERS.findall(chunk.decode().lower())]


class LanguageModel:
    """Languages in order and (pieces + 1, languages) probabilities; the last row is an unknown character's."""

    def __init__(self, languages: list[str], probabilities: np.ndarray):
        self.languages, self.probabilities = languages, probabilities

    @classmethod
    def fit(cls, model: PieceModel, samples: list[tuple[str, bytes]], rounds: int = ROUNDS) -> LanguageModel:
        """Expectation-maximisation from equal probabilities of all pieces, each language on its own words."""
        counts: dict[str, Counter] = {}
        for language, text in samples:
            counts.setdefault(language, Counter()).update(text.split())
        languages = sorted(counts)
        if len(languages) > MOST_LANGUAGES:
            raise ValueError(f"{len(languages)} languages are more than the {MOST_LANGUAGES} of a model that every task takes")
        size = len(model.pieces)
        out = np.full((size + 1, len(languages)), FLOOR)
        for k, language in enumerate(languages):
            words = Counter()
            for chunk, n in counts[language].items():
                for w in letters(chunk):
                    words[w] += n
            p = np.full((size + 1, 1), 1.0 / size)
            p[-1] = UNKNOWN
            if words:
                forms, times = list(words), np.array(list(words.values()), dtype=float)
                blocks = [(Matches(model, forms[i : i + 20_000]), times[i : i + 20_000]) for i in range(0, len(forms), 20_000)]
                for _ in range(rounds):
                    total = sum(matches.expected(p, n, size + 1) for matches, n in blocks)[:size]
                    p[:size, 0] = np.maximum(total / max(total.sum(), 1e-300), FLOOR)
            out[:, k] = p[:, 0]
        out[-1] = UNKNOWN
        return cls(languages, out)

    def word_scores(self, model: PieceModel, words: list[str]) -> np.ndarray:
        """(words, languages) log probabilities."""
        matches = Matches(model, words)
        alpha, logs, _ = matches.scaled_forward(self.probabilities)
        return np.log(alpha[matches.last]) + logs


class _Scorer:
    """Scores of chunks between white space, kept for the next batches."""

    def __init__(self, model: PieceModel, languages: LanguageModel, limit: int = 600_000):
        self.model, self.languages, self.limit = model, languages, limit
        self._clear()

    def _clear(self) -> None:
        self.ids, self.scores, self.lettered, self.filled = WordIds(), np.zeros((1 << 16, len(self.languages.languages))), np.zeros(1 << 16, dtype=bool), 0

    def _learn(self) -> None:
        n = len(self.ids)
        if n > len(self.scores):
            grown = max(n, 2 * len(self.scores))
            self.scores = np.resize(self.scores, (grown, self.scores.shape[1]))
            self.lettered = np.resize(self.lettered, grown)
        chunks = list(self.ids)[self.filled :] if self.filled < n else []
        for at in range(0, len(chunks), 20_000):
            own = [letters(c) for c in chunks[at : at + 20_000]]
            first = self.filled + at
            index = np.repeat(np.arange(first, first + len(own)), [len(w) for w in own])
            self.scores[first : first + len(own)] = 0.0
            if len(index):
                np.add.at(self.scores, index, self.languages.word_scores(self.model, [w for x in own for w in x]))
            self.lettered[first : first + len(own)] = [bool(w) for w in own]
        self.filled = n

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        if len(self.ids) > self.limit:
            self._clear()
        split = [t.split() for t in texts]
        sizes = np.array([len(w) for w in split], dtype=np.int64)
        index = np.fromiter((i for w in split for i in map(self.ids.__getitem__, w)), dtype=np.int64, count=int(sizes.sum()))
        self._learn()
        names, scores, ends = [], [], np.cumsum(sizes)
        for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
            own = index[a:b]
            if not self.lettered[own].any() or not self.languages.languages:
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            total = self.scores[own].sum(axis=0)
            best = int(total.argmax())
            names.append(self.languages.languages[best])
            scores.append(float(1.0 / np.exp(total - total[best]).sum()))
        return names, scores


def held_out(column: str = "doc_id") -> F.Column:
    """Documents kept out of training: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, vocabulary: str, documents: int = TRAINING_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on a bounded sample of the documents that are not held out and have a language."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = hash_sample(own.where(~held_out() & F.col("lang").isNotNull() & (F.octet_length("text") <= TRAINING_TEXT_BYTES)), documents).select("lang", "text").collect()
    return LanguageModel.fit(cached_pieces(vocabulary).model, [(r.lang, r.text.encode()) for r in rows])


def _scorer(spark: SparkSession, model: LanguageModel, vocabulary: str) -> Callable[[], _Scorer]:
    """Gets a worker's scorer, made once and kept between tasks."""
    shared = spark.sparkContext.broadcast(model)  # pieces times languages: one megabyte for four
    key = hashlib.sha256(model.probabilities.tobytes() + repr((model.languages, vocabulary)).encode()).hexdigest()

    return lambda: sole(("language", key), lambda: _Scorer(cached_pieces(vocabulary).model, shared.value))


def identify(docs: DataFrame, model: LanguageModel, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text; the text is all that is looked at."""
    get = _scorer(docs.sparkSession, model, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = get()
        for batch in slices(batches):
            names, scores = scorer.predict(raw_texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: LanguageModel, vocabulary: str, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """Documents, as they were, whose language is determined with a score of ``least`` or more."""
    get = _scorer(docs.sparkSession, model, vocabulary)

    def verdict() -> Callable[[pa.RecordBatch], np.ndarray]:
        def decide(batch: pa.RecordBatch) -> np.ndarray:
            names, scores = get().predict(raw_texts(batch.column(text_col)))
            return np.array([n != UNDETERMINED and x >= least for n, x in zip(names, scores, strict=True)])

        return decide

    return keep_rows(docs, verdict, text_col)
