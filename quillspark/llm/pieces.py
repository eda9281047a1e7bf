"""Public vocabularies of pieces as an Aho-Corasick automaton, and Viterbi over it.

The pieces and scores come from a SentencePiece model file. A text is brought
into the model's form (a leading space, every space as U+2581) and cut where no
piece can reach across, at each U+2581 after another character; parts are
segmented once per worker and kept, so that a long text costs one lookup a word.

Segmentation is the model's unigram mode in exact arithmetic: the best sum of
scores wins; of equal sums at a position, the one found first when start
positions are tried in ascending order, so the longest last piece, is kept. A
character that is no piece costs ``unknown`` and is written as its UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick

SPACE = "▁"
_SPACE = SPACE.encode()
#: Types of pieces in a model file that stand for text.
NORMAL, BYTE = 1, 6
#: What one unknown character costs below the lowest score of a piece.
UNKNOWN_PENALTY = 10
INFINITY = float("inf")


class PieceModel:
    """Pieces, scores and the automaton of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.scores = [model.get_score(i) for i in range(n)]
        self.normal = [i for i in range(n) if not special(i)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown_id = model.unk_id()
        self.unknown = min(self.scores[i] for i in self.normal) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for i in self.normal:
            if self.pieces[i]:
                self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), self.scores[i], i))
        self.automaton.make_automaton()
        #: Characters that are pieces by themselves; only others can be unknown.
        self.characters = frozenset(self.pieces[i] for i in self.normal if len(self.pieces[i]) == 1)
        self.sizes = list(map(len, self.pieces))
        self.packed_ids = [i.to_bytes(4, "little") for i in range(n)]
        self.longest = max((len(self.pieces[i]) for i in self.normal), default=1)
        self.inner_space = any(SPACE in p.lstrip(SPACE) for p in (self.pieces[i] for i in self.normal))
        self.raw = [self.pieces[i].encode() for i in range(n)]
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        for i in range(n):
            if model.is_control(i) or model.is_unknown(i):
                self.raw[i] = b""

    def viterbi(self, text: str) -> tuple[list[float], list[int], list[int]]:
        """Best score, start and piece (-1: unknown) of the best segmentation up to each position.

        One pass: the automaton reports, in order of end position, the longest
        piece that ends there and, by its output links, every shorter one. A
        longer match starts earlier, so ``>`` keeps the first of equal sums; an
        unknown character starts last.
        """
        n, known, unknown = len(text), self.characters, self.unknown
        best, start, piece = [0.0] + [-INFINITY] * n, [0] * (n + 1), [-1] * (n + 1)
        closed = 0

        def close(upto: int) -> None:
            for p in range(closed + 1, upto + 1):
                if text[p - 1] not in known and best[p - 1] + unknown > best[p]:
                    best[p], start[p], piece[p] = best[p - 1] + unknown, p - 1, -1

        for last, (size, score, i) in self.automaton.iter(text):
            if last > closed:
                close(last)
                closed = last
            value = best[last + 1 - size] + score
            if value > best[last + 1]:
                best[last + 1], start[last + 1], piece[last + 1] = value, last + 1 - size, i
        close(n)
        return best, start, piece

    def encode_part(self, text: str) -> list[int]:
        """Ids of one part by back pointers of the Viterbi pass."""
        if self.characters.issuperset(text):
            # no character is unknown: the back pointer is the last piece alone, and -1 is the place before the first
            n, sizes, out = len(text), self.sizes, []
            best, piece = [-INFINITY] * n + [0.0], [0] * n
            for last, (size, score, i) in self.automaton.iter(text):
                value = best[last - size] + score
                if value > best[last]:
                    best[last], piece[last] = value, i
            at = n - 1
            while at >= 0:
                i = piece[at]
                out.append(i)
                at -= sizes[i]
            return out[::-1]
        _, start, piece = self.viterbi(text)
        out: list[int] = []
        at = len(text)
        while at:
            if piece[at] >= 0:
                out.append(piece[at])
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(text[start[at] : at].encode())]
            elif not out or out[-1] != self.unknown_id:  # unknown neighbours form one id
                out.append(self.unknown_id)
            at = start[at]
        return out[::-1]

    def count_part(self, text: str) -> int:
        """Number of ids of one part, carrying best score and count alone, no back pointers."""
        n, known, unknown = len(text), self.characters, self.unknown
        if known.issuperset(text):
            best, count = [-INFINITY] * n + [0.0], [0] * (n + 1)  # -1 is the place before the first
            for last, (size, score, _) in self.automaton.iter(text):
                value = best[last - size] + score
                if value > best[last]:
                    best[last], count[last] = value, count[last - size] + 1
            return count[n - 1]
        best, count, closed = [0.0] + [-INFINITY] * n, [0] * (n + 1), 0

        def close(upto: int) -> None:
            for p in range(closed + 1, upto + 1):
                if text[p - 1] not in known and best[p - 1] + unknown > best[p]:
                    best[p] = best[p - 1] + unknown
                    # neighbours that are unknown share one id unless written as bytes
                    again = not self.bytes and p > 1 and text[p - 2] not in known
                    count[p] = count[p - 1] + (len(text[p - 1].encode()) if self.bytes else 1 - again)

        for last, (size, score, _) in self.automaton.iter(text):
            if last > closed:
                close(last)
                closed = last
            value = best[last + 1 - size] + score
            if value > best[last + 1]:
                best[last + 1], count[last + 1] = value, count[last + 1 - size] + 1
        close(n)
        return count[n]

    def decode(self, ids: Iterator[int]) -> bytes:
        """UTF-8 bytes of the text whose ids these are."""
        out = b"".join(map(self.raw.__getitem__, ids)).replace(_SPACE, b" ")
        return out[1:] if out[:1] == b" " else out


def parts(text: bytes) -> list[bytes]:
    """Parts of a text between which no piece reaches, each without its first space.

    Every part stands for U+2581 followed by it; spaces inside a part come first
    in it, from runs of several spaces.
    """
    if not text:
        return []
    if b"  " in text or text[0] == 32:
        return [x[1:] for x in re.findall(rb" +[^ ]*", b" " + text)]
    return text.split(b" ")


class CachedPieces:
    """Encodes and counts whole texts with one Viterbi pass per new part."""

    def __init__(self, model: PieceModel, limit: int = 500_000):
        self.model, self.limit = model, limit
        self.ids: dict[bytes, bytes] = {}
        self.counts: dict[bytes, int] = {}
        if model.inner_space:
            raise ValueError("this vocabulary has pieces that reach across words")

    @staticmethod
    def _form(part: bytes) -> str:
        return SPACE + (part.decode().replace(" ", SPACE) if b" " in part else part.decode())

    def packed(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        own, cache = parts(text), self.ids
        try:
            return b"".join(map(cache.__getitem__, own))
        except KeyError:
            pass
        if len(cache) > self.limit:
            cache.clear()
        for x in own:
            if x not in cache:
                cache[x] = b"".join(map(self.model.packed_ids.__getitem__, self.model.encode_part(self._form(x))))
        return b"".join(map(cache.__getitem__, own))

    def count(self, text: bytes) -> int:
        own, cache = parts(text), self.counts
        try:
            return sum(map(cache.__getitem__, own))
        except KeyError:
            pass
        if len(cache) > self.limit:
            cache.clear()
        for x in own:
            if x not in cache:
                cache[x] = self.model.count_part(self._form(x))
        return sum(map(cache.__getitem__, own))


_MODELS: dict[str, CachedPieces] = {}


def cached_pieces(path: str) -> CachedPieces:
    """One per Python worker, kept between tasks."""
    if path not in _MODELS:
        _MODELS[path] = CachedPieces(PieceModel(path))
    return _MODELS[path]
