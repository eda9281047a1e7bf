"""Words of whole texts in Arrow batches, and token ids by cached words."""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Rows of a record batch handled at once end before this many text bytes,
#: so that memory does not follow the longest texts times the batch size.
BATCH_BYTES = 8 << 20
#: Words whose ids are laid out at once.
BLOCK_WORDS = 1 << 18


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of ``column``.

    A single longer text still forms a batch of its own: texts are never cut.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text; null gives the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def values(column: pa.LargeStringArray) -> list[bytes]:
    """UTF-8 bytes of every value of a column without nulls, cut from its one buffer."""
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return [b""] * len(column)
    raw, at = data.to_pybytes(), np.frombuffer(offsets, "<i8")[column.offset : column.offset + len(column) + 1].tolist()
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names.

    Other columns, whatever their names, never reach an operator's task.
    """
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


class WordIds(dict):
    """Numbers words by first sight: ``list(map(ids.__getitem__, words))``."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


#: Runs of letters that no normal form, and no lower case but that of each letter, changes: ASCII and Latin up to U+017F
#: without the signs U+00D7 and U+00F7 and the dotted capital I (whose lower case has a mark of its own).
LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf])+")
#: ASCII signs: neither letters nor digits nor white space.
SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())

#: What a vocabulary's file must say for runs of letters to be encoded apart from the signs after them.
LETTER_RUNS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class CachedTokenizer:
    """Token ids of whole texts by the ``tokenizers`` library, one call per new word.

    The vocabulary's normaliser and splitter never look across white space, so
    the ids of a text are those of its parts between ASCII white space, in
    order. Each part goes through the library once per worker and is then kept
    as packed little-endian unsigned 32-bit ids; when ``limit`` parts are held,
    only those of the batch at hand stay, so memory stays bounded and common
    parts are not learned again. ASCII letters are lower-cased before the
    lookup, as the vocabulary's own normaliser does, except where a combining
    mark (UTF-8 lead bytes CC and CD) could compose with them.

    Where the vocabulary splits as LETTER_RUNS says, letters followed by signs
    are the ids of both, and runs of letters go through the library's model
    without its normaliser and splitter, which would leave them as they are;
    the model marks the last id of a run.
    """

    #: Joins new parts into one call; parts that hold it go one by one.
    SEPARATOR = b"|"

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[bytes, bytes] = {}
        self.limit = limit
        [self.separator] = self._encode(self.SEPARATOR)
        self.folds = self._encode(b"AbC") == self._encode(b"abc")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix")
        self.runs = bool(
            spec["model"]["type"] == "BPE" and suffix and not spec["model"].get("continuing_subword_prefix") and not spec["model"].get("dropout")
            and all(spec[k] == v for k, v in LETTER_RUNS.items())
            and not spec["post_processor"] and all("<" in t["content"] for t in spec["added_tokens"])
        )
        if self.runs:
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            self.plain, self.latin = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)  # one model in memory
            self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            self.latin.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _encode(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, words: set[bytes]) -> None:
        if not self.runs:
            return self._learn_whole(words)
        cache, letters = self.cache, LETTERS.fullmatch
        plain, latin, whole, signed = set(), set(), set(), []
        for w in words:
            head = w.rstrip(SIGNS)
            if not letters(head):
                whole.add(w)
                continue
            if len(head) < len(w):
                tail = w[len(head) :]
                signed.append((w, head, tail))
                if tail not in cache:
                    whole.add(tail)
                if head in cache:
                    continue
            (plain if head.isascii() else latin).add(head)
        self._learn_runs(self.plain, list(plain))
        self._learn_runs(self.latin, list(latin))
        self._learn_whole(whole)
        cache.update([(w, cache[head] + cache[tail]) for w, head, tail in signed])

    def _learn_runs(self, tokenizer: object, runs: list[bytes]) -> None:
        """Ids of runs of letters; each ends with an id that the model gives to ends of words only."""
        for i in range(0, len(runs), 8192):
            part = runs[i : i + 8192]
            texts = [b" ".join(part[k : k + 128]).decode().lower() for k in range(0, len(part), 128)]
            ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            ends = (np.flatnonzero(self.last[ids]) + 1) * 4
            if len(ends) != len(part):
                self.cache.update((w, self._encode(w).tobytes()) for w in part)
                continue
            packed, ends = ids.tobytes(), ends.tolist()
            self.cache.update((w, packed[a:b]) for w, a, b in zip(part, [0, *ends[:-1]], ends, strict=True))

    def _learn_whole(self, words: set[bytes]) -> None:
        cache = self.cache
        fresh = []
        for w in words:
            if self.SEPARATOR in w or b"<" in w:
                cache[w] = self._encode(w).tobytes()
            else:
                fresh.append(w)
        for i in range(0, len(fresh), 4096):
            part = fresh[i : i + 4096]
            ids = self._encode(b" | ".join(part))
            cuts = np.flatnonzero(ids == self.separator)
            if len(cuts) != len(part) - 1:
                cache.update((w, self._encode(w).tobytes()) for w in part)
                continue
            packed = ids.tobytes()
            starts = [0, *((cuts + 1) * 4).tolist()]
            ends = [*(cuts * 4).tolist(), len(packed)]
            cache.update((w, packed[a:b]) for w, a, b in zip(part, starts, ends, strict=True))

    def packed(self, text: bytes) -> bytes:
        """Packed ids of one whole text."""
        return self.packed_batch([text])[0]

    def packed_batch(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of several texts; each different word is looked up once, all new ones go to the library together."""
        folded = [t.lower() if self.folds and b"\xcc" not in t and b"\xcd" not in t else t for t in texts]
        split = pc.ascii_split_whitespace(pa.array(folded, pa.large_string()))
        encoded = split.flatten().dictionary_encode()
        words = values(encoded.dictionary)
        if len(self.cache) > self.limit:
            self.cache = {w: self.cache[w] for w in words if w in self.cache}
        self.cache[b""] = b""  # beside white space at an end of a text
        ids = list(map(self.cache.get, words))
        holes = [i for i, x in enumerate(ids) if x is None]
        if holes:
            self._learn({words[i] for i in holes})
            for i in holes:
                ids[i] = self.cache[words[i]]
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        starts = np.cumsum(lengths) - lengths
        places = encoded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(lengths[places])])
        out = np.empty(ends[-1], dtype="<u4")
        for i in range(0, len(places), BLOCK_WORDS):
            own = places[i : i + BLOCK_WORDS]
            first, stop = ends[i], ends[i + len(own)]
            out[first:stop] = flat[np.repeat(starts[own] - ends[i : i + len(own)], lengths[own]) + np.arange(first, stop)]
        packed = out.tobytes()
        bounds = (4 * ends[split.offsets.to_numpy()]).tolist()
        return [packed[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


#: The one large cache of this Python worker, by key.
_SOLE: dict[object, object] = {}


def sole(key: object, make: Callable[[], object]) -> object:
    """The worker's cache under ``key``, kept between tasks.

    Workers outlive a stage; a cache of another operator is dropped first, so a
    pipeline's worker never holds the sum of its stages' caches.
    """
    if key not in _SOLE:
        _SOLE.clear()
        gc.collect()
        _SOLE[key] = make()
    return _SOLE[key]


def cached_tokenizer(path: str) -> CachedTokenizer:
    """One per Python worker, kept between tasks."""
    return sole(("tokenizer", path), lambda: CachedTokenizer(path))


def public_vocabulary(name: str) -> str:
    """Default place of a public vocabulary file; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def hash_sample(df: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """About ``rows`` rows, at most twice as many, those with the smallest hash of their key.

    The threshold follows the number of rows, so no task sends more than its
    share: nothing is sorted or gathered to find the sample.
    """
    total = df.count()
    if total <= rows:
        return df
    return df.where(F.xxhash64(key) < F.lit(int(rows / total * 2**64) - 2**63)).limit(2 * rows)


def keep_rows(df: DataFrame, verdict: Callable[[], Callable[[pa.RecordBatch], np.ndarray]], text_col: str = "text") -> DataFrame:
    """Rows for which a task's verdict on their batch is true, all columns as they were.

    ``verdict()`` is called once a task; its function gets batches of bounded
    text and returns one boolean a row. Nothing is shuffled or joined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = verdict()
        for batch in slices(batches, text_col):
            yield batch.filter(pa.array(decide(batch), pa.bool_()))

    return df.mapInArrow(run, df.schema)
