"""Keys and comparisons of personal names, as native expressions and for use inside a group."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, functions as F

# ---- fixed values -----------------------------------------------------------

#: Particles that no key has, and words that are no surname.
PARTICLES = "de da do dos das e d".split()
NO_SURNAME = "de da do dos das e junior jr filho neto sobrinho".split()
#: Typographic apostrophes, quotation marks, hyphens and dashes that stand between words.
BETWEEN_WORDS = "’‘`´“”–—‐‑‒―−"

# -----------------------------------------------------------------------------


@cache
def _plain_letters() -> tuple[str, str]:
    """Characters of the basic plane that decompose to one ASCII character, and that character."""
    pairs = ((chr(i), unicodedata.normalize("NFKD", chr(i)).encode("ascii", "ignore").decode()) for i in range(0x80, 0x10000) if not 0xD800 <= i < 0xE000)
    kept = [(c, plain) for c, plain in pairs if len(plain) == 1]
    return "".join(c for c, _ in kept), "".join(p for _, p in kept)


def text_key(text: Column) -> Column:
    """ASCII letters and digits in lower case without accents, single spaces; typographic marks part words."""
    spaced = F.translate(text, BETWEEN_WORDS + "ı", " " * len(BETWEEN_WORDS) + "i")
    plain = F.regexp_replace(F.translate(spaced, *_plain_letters()), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", " "))


def _words(key: Column, without: list[str]) -> Column:
    return F.filter(F.split(key, " "), lambda w: (w != "") & ~w.isin(*without))


def name_parts(name: Column) -> Column:
    """Parts of a name without particles; ``jr`` is ``junior``."""
    return F.transform(_words(text_key(name), PARTICLES), lambda w: F.when(w == "jr", "junior").otherwise(w))


def surname_parts(name: Column) -> Column:
    return _words(text_key(name), NO_SURNAME)


def share_a_part(a: Column, b: Column) -> Column:
    """Whether a part of one name after its first is in the other: parts by ``surname_parts``."""
    later = lambda x, y: F.exists(F.slice(x, 2, F.greatest(F.size(x), F.lit(1))), lambda p: F.array_contains(y, p))
    return later(a, b) | later(b, a)


def same_part(a: Column, b: Column) -> Column:
    """Whether two parts are equal or one is the other's initial."""
    return (a == b) | ((F.length(a) == 1) & b.startswith(a)) | ((F.length(b) == 1) & a.startswith(b))


def holds(longer: Column, shorter: Column) -> Column:
    """Whether each part of the shorter name has a part of the longer one to itself."""

    def take(left: Column, part: Column) -> Column:
        at = F.array_position(F.transform(left, lambda q: same_part(part, q)), True)
        rest = F.concat(F.slice(left, 1, F.greatest(at - 1, F.lit(0)).cast("int")), F.slice(left, (at + 1).cast("int"), F.size(left)))
        return F.when(at > 0, rest)  # null once a part has no match

    return F.aggregate(shorter, longer, take).isNotNull()


def comparable(a: Column, b: Column) -> Column:
    """Whether two names may be one person's: the same first part or its initial, and one holds the other."""
    there = (F.size(a) > 0) & (F.size(b) > 0)
    return F.coalesce(there & same_part(F.get(a, F.lit(0)), F.get(b, F.lit(0))) & (holds(a, b) | holds(b, a)), F.lit(False))


def blocks(parts: Column) -> Column:
    """Keys by which comparable names meet: the first letter, with each later part's first letter, or alone.

    Two comparable names share their first letter. If both have later parts, the
    shorter one's parts stand in the longer one, so the letter of one of them is
    shared; a name without later parts meets all names of its first letter.
    """
    first = F.substring(F.get(parts, F.lit(0)), 1, 1)
    letters = F.array_distinct(F.transform(parts, lambda p: F.substring(p, 1, 1)))
    return F.when(F.size(parts) > 0, F.transform(letters, lambda x: F.concat(first, F.lit("|"), x)))


def holds_names(longer: list[str], shorter: list[str]) -> bool:
    """``holds`` for lists of parts."""
    left = list(longer)
    for part in shorter:
        match = next((q for q in left if q == part or (len(part) == 1 and q.startswith(part)) or (len(q) == 1 and part.startswith(q))), None)
        if match is None:
            return False
        left.remove(match)
    return True


def comparable_names(a: list[str], b: list[str]) -> bool:
    return bool(a and b) and holds_names(a[:1], b[:1]) and (holds_names(a, b) or holds_names(b, a))


def one_holds_all(names: list[list[str]]) -> bool:
    """Whether one of the names, with no initial in it, holds all the others and starts like them."""
    return any(all(len(p) > 1 for p in whole) and all(holds_names(whole[:1], n[:1]) and holds_names(whole, n) for n in names) for whole in names if whole)
