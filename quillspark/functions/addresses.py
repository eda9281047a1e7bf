"""E-mail addresses in text, also with spaces around the sign and in spelled-out forms.

Every sign that may belong to an address is looked at once: what stands before it
is read backwards, what follows is read as labels and the joints between them,
and the forms below say which of them make an address. One detector serves
cleaning and publication.
"""

from __future__ import annotations

import re
from functools import cache
from importlib import resources
from pathlib import Path
from typing import NamedTuple

# ---- fixed values -----------------------------------------------------------

#: Generic top-level domains that count.
GENERIC = "com org net edu gov mil int info biz name pro cat eus gal museum coop aero asia app dev online site xyz tech"
#: Country domains that are no ISO 3166 code, and codes that are no domain.
COUNTRY_MORE, COUNTRY_LESS = "ac eu su uk", "bl bq eh mf um"
#: Left out before looking: soft hyphen, zero-width space, non-joiner and joiner, word joiner, byte-order mark; the wide full stop is one.
INVISIBLE = {0x00AD: None, 0x200B: None, 0x200C: None, 0x200D: None, 0x2060: None, 0xFEFF: None, 0xFF0E: "."}

# -----------------------------------------------------------------------------

SIGN = re.compile("[@＠﹫]|[\\[({][ \\t]*(?:at|arroba)[ \\t]*[\\])}]", re.IGNORECASE)
SPELLED_DOT = re.compile(r"[ \t]*[\[({][ \t]*(?:dot|ponto)[ \t]*[\])}][ \t]*", re.IGNORECASE)
LABEL = re.compile(r"[\w-]+")
GAP = re.compile(r"[ \t]*")


@cache
def top_level() -> frozenset[str]:
    """Generic and country domains; the codes of ISO 3166 are those of the time-zone database."""
    try:
        listed = (resources.files("tzdata") / "zoneinfo" / "iso3166.tab").read_text(encoding="utf-8")
    except ModuleNotFoundError:
        listed = Path("/usr/share/zoneinfo/iso3166.tab").read_text(encoding="utf-8")
    codes = {line.split("\t")[0].lower() for line in listed.splitlines() if line and line[0] != "#"}
    return frozenset((codes | {*COUNTRY_MORE.split(), *GENERIC.split()}) - {*COUNTRY_LESS.split()})


class Label(NamedTuple):
    """A label of a domain and the joint before it: ``.``, ``. `` or ``spelled``."""

    joint: str
    start: int
    end: int


def _labels(text: str, at: int) -> list[Label]:
    """Labels from ``at`` on, as far as joints lead."""
    out, joint = [], ""
    while found := LABEL.match(text, at):
        out.append(Label(joint, found.start(), found.end()))
        at = found.end()
        if text[at : at + 1] == "." and LABEL.match(text, at + 1):
            joint, at = ".", at + 1
        elif text[at : at + 2] == ". ":
            joint, at = ". ", at + 2
        elif dot := SPELLED_DOT.match(text, at):
            joint, at = "spelled", dot.end()
        else:
            break
    return out


def _joined(labels: list[Label], joints: tuple[str, ...]) -> list[Label]:
    """The first labels, up to a joint of another kind."""
    n = next((k for k, label in enumerate(labels) if k and label.joint not in joints), len(labels))
    return labels[:n]


def _top(text: str, labels: list[Label]) -> tuple[int, int] | None:
    """(index, end) of the last label, not the first, that is a top-level domain or starts with one and a hyphen."""
    for k in range(len(labels) - 1, 0, -1):
        name = text[labels[k].start : labels[k].end].partition("-")[0]
        if name in top_level():
            return k, labels[k].start + len(name)
    return None


def _end(text: str, sign: re.Match, apart: bool) -> tuple[int, bool] | None:
    """Where the address of a sign ends, and whether what stands before the sign belongs to it.

    ``apart``: there is space between the sign and the word before it.
    """
    after = GAP.match(text, sign.end()).end()
    labels, at_sign = _labels(text, after), len(sign.group()) == 1
    if not labels:
        return None
    dots = _joined(labels, (".",))
    if at_sign and apart and after == sign.end() and (top := _top(text, dots)):
        # "word @site.br" may be a profile: only the sign and its domain count
        k, end = top
        return (dots[-1].end if end == dots[k].end else end), False
    spelled = _joined(labels, (".", "spelled"))
    if not at_sign or after > sign.end():
        top = _top(text, spelled)
        return (top[1], True) if top else None
    # the last top-level domain of a domain with a spelled-out dot must come after that dot
    first = next((k for k, label in enumerate(spelled) if label.joint == "spelled"), None)
    if first is not None and (top := _top(text, spelled)) and top[0] >= first:
        return top[1], True
    if apart:
        return None
    name = text[labels[0].start : labels[0].end]
    loose = _joined(labels, (".", ". "))
    if len(name) > 1 and any(c.isalpha() for c in name) and (top := _top(text, loose)):
        return top[1], True
    return (dots[-1].end, True) if len(dots) > 1 else None


def spans(text: str) -> list[tuple[int, int]]:
    """What to cut out of a text: (start, end) of its addresses, from left to right."""
    out, done = [], 0
    for sign in SIGN.finditer(text):
        if sign.start() < done:
            continue
        word = sign.start()
        while word > done and text[word - 1] in " \t":
            word -= 1
        start = word
        while start > 0 and (text[start - 1].isalnum() or text[start - 1] in "_.+-"):
            start -= 1
        if start == word or start < done:
            continue
        found = _end(text, sign, word < sign.start())
        if not found:
            continue
        end, whole = found
        plain = word == sign.start() and len(sign.group()) == 1
        if not plain and text[word - 1] in ".+-":  # only plain addresses may end their first part so
            continue
        out.append((start if whole else sign.start(), end))
        done = end
    return out


def visible(text: str) -> str:
    return text.translate(INVISIBLE)


def contains_email(text: str) -> bool:
    return bool(spans(visible(text)))


def without_emails(text: str) -> str:
    """Addresses out, again until none is left, as one may appear when its neighbour goes.

    A text without an address keeps its invisible characters; white space is
    brought to single spaces in all.
    """
    seen = visible(text)
    if found := spans(seen):
        text = seen
        while found:
            keep = zip([0, *(end for _, end in found)], [*(start for start, _ in found), len(text)], strict=True)
            text = "".join(text[a:b] for a, b in keep)
            found = spans(text)
    return " ".join(text.split()).strip(" ,;")
