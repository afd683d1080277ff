"""Shapes of text lines: entries, rows, forms and garbage against sentences."""

from __future__ import annotations

import re

import numpy as np

from .words import Words

# Frequent words of English, Spanish, French, German, Italian and Portuguese.
FUNCTION_WORDS = frozenset(
    "the of and to in a is was were that this it he she they we you i not on at by for with from had has have be been but or as which who "
    "whom when where while before after because whether neither nor until there any only each every another some other one an its his her "
    "their our my me him them us do did does no yes than then so if into over under during without within about would could should "
    "el la los las un una unos unas de del al y o que en con por para su sus se no es fue era sin sobre entre cuando como pero más ya lo le "
    "le les des du et ou dans sur pour par avec sans ce cette ces il elle ils nous vous je ne pas qui au aux est était sous entre mais comme "
    "der die das den dem des ein eine einen einem einer und oder nicht ist war mit von zu im am auf für bei aus nach über gegen ohne durch "
    "seit während zwischen laut noch schon dort diese dieser diesen dieses sich auch als wie "
    "il lo gli dei della nel con per non che sono da dos das em um uma não os".split()
)

MAIL_HEADER = re.compile(r"^\s*(?:from|to|cc|bcc|sent|date|subject|re|von|an|betreff|de|para|asunto|à|objet)\s*:", re.I)
MARGIN_NUMBER = re.compile(r"^\s{0,4}\d{1,3}(?:\s{2,}|\t|$)")
BULLET = re.compile(r"^\s*(?:[-*•·–—▪◦‣○●]|\(?\d{1,4}[.)]|\(?[A-Za-z][.)]|\[[ xX]?\])\s+")
FORM = re.compile(r"^\s*[^\W\d_][^:\n]{0,40}:\s*(?:[_.\s█■▇x-]*|\[[\s_x.]*\]|n/?a\.?|none|unknown|[^\s]+(?:\s+[^\s]+){0,3})\s*$", re.I)
BLANK_VALUE = re.compile(r":\s*(?:[_.\s█■▇-]*|x{1,6}|\[[\s_x.]*\]|n/?a\.?)\s*$", re.I)
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
SENTENCE_END = re.compile(r"[.!?][\"'”’)\]]*\s*$")
_DIGIT, _GAP = re.compile(r"\d"), re.compile(r"\S {2,}(?=\S)")
_VOWEL = re.compile(r"[aeiouyáéíóúàèìòùâêîôûäëïöüåæøœãõ]", re.I)
_REDACTION = re.compile(r"█+|\[[^\]\n]{0,14}\]|\((?:REDACTED|b\)\(\d.?\)|_+)|\bX{4,}\b|_{4,}|\*{4,}|\(b\)\(\d\)(?:\([A-Z]\))?", re.I)

NEUTRAL, PROSE, ENTRY, ROW, FORM_LINE, GARBAGE = range(6)


def readable(words: list[str]) -> bool:
    """Whether most words of some length have a vowel and a plausible length."""
    long = [w for w in words if len(w) > 2]
    if not long:
        return True
    good = sum(1 for w in long if _VOWEL.search(w) and len(w) <= 24)
    return good >= 0.6 * len(long)


def line_kind(line: str) -> int:
    """The kind of one line, seen by itself."""
    text = _REDACTION.sub(" ", line).strip()
    raw = line.strip()
    if not raw:
        return NEUTRAL
    some = raw.lower().split()
    if len(some) >= 5 and "|" not in raw and "\t" not in raw and len([w for w in some if w in FUNCTION_WORDS]) >= max(2, 0.2 * len(some)):
        return PROSE
    if BLANK_VALUE.search(raw) and FORM.match(raw):
        return FORM_LINE
    if not text:
        return NEUTRAL
    body = MARGIN_NUMBER.sub("", line)
    body = _REDACTION.sub(" ", body)
    words = WORD.findall(body)
    parts = text.split()
    visible = sum(map(len, parts))
    letters = sum(map(len, words))
    frequent = len([w for w in words if w.lower() in FUNCTION_WORDS])
    if visible > 3 and letters < 0.35 * visible and not _DIGIT.search(text):
        return GARBAGE
    if max(map(len, parts)) > 34 and not text.startswith(("http", "www", "<", "mailto")) and "@" not in text and "://" not in text:
        return GARBAGE
    if len(words) >= 3 and not readable(words):
        return GARBAGE
    if len(words) >= 3 and frequent <= 0.15 * len(words) and not text.isascii():
        odd = sum(1 for c in text if ord(c) > 0xA0 and not c.isalpha() and c not in "“”‘’«»–—…•·°§½¼¾€£☎🙂")
        strange = sum(1 for w in words if any(ord(c) > 0xBF for c in w))
        if odd > 0.05 * visible or strange > 0.6 * len(words):
            return GARBAGE
    body = body.strip()
    fields = max(body.count("|"), body.count("\t"), body.count("; ") if frequent == 0 else 0, len(_GAP.findall(body)) if "  " in body else 0)
    if fields >= 2 and frequent <= 0.15 * len(words):
        return ROW
    if fields >= 1 and frequent == 0 and ("|" in body or "\t" in body):
        return ROW
    if letters < 0.5 * visible and frequent == 0:
        return ROW if _DIGIT.search(text) and visible > 8 else NEUTRAL
    if frequent >= 1 and (frequent >= 0.12 * len(words) or SENTENCE_END.search(text)):
        return PROSE
    if MAIL_HEADER.match(raw):
        return NEUTRAL
    if BULLET.match(line) and frequent <= 0.1 * len(words) and not SENTENCE_END.search(text):
        return ENTRY
    if FORM.match(raw) and not SENTENCE_END.search(text) and not re.match(r"^[QA]\s*[:.]", raw):
        return FORM_LINE
    return NEUTRAL


def settled(kinds: list[int], sizes: list[int], lines: list[str]) -> list[int]:
    """Kinds in which undecided lines go with their neighbours.

    An undecided line next to prose is its continuation; one beside entries, rows or
    forms is one of them.
    """
    out = list(kinds)
    for i, k in enumerate(kinds):
        if k != NEUTRAL or not sizes[i]:
            continue
        above = kinds[i - 1] if i and sizes[i - 1] else NEUTRAL
        below = kinds[i + 1] if i + 1 < len(kinds) and sizes[i + 1] else NEUTRAL
        if above == NEUTRAL and below == NEUTRAL or MAIL_HEADER.match(lines[i]):
            continue
        if PROSE in (above, below):
            out[i] = PROSE
        elif above > PROSE and below > PROSE or NEUTRAL in (above, below):
            out[i] = max(above, below)
    return out


def kind_sizes(texts: list[str], words: Words, frequent: np.ndarray) -> np.ndarray:
    """Visible characters of each text in lines of each kind (a row a text, a column a kind).

    Lines with five words or more, a fifth of them function words, and no bar or tab
    are prose; that is settled for all lines at once. Every other line is looked at by
    itself. `words` are the words of the texts, `frequent` marks the function words.
    """
    codes, offsets = words.codes, words.offsets
    ends = np.flatnonzero((codes == 0x0A) | (codes == 0))
    ends = np.append(ends, len(codes))
    starts = np.concatenate(([0], ends[:-1] + 1))
    owner = np.searchsorted(offsets, starts, side="right") - 1
    at = np.searchsorted(ends, words.starts)
    n, known = np.bincount(at, minlength=len(ends)), np.bincount(at, weights=frequent, minlength=len(ends))
    shown = np.concatenate(([0], np.cumsum(~((codes <= 0x20) | (codes == 0xA0)))))
    bars = np.concatenate(([0], np.cumsum((codes == 0x7C) | (codes == 0x09))))
    sizes = shown[ends] - shown[starts]
    kinds = np.where((n >= 5) & (bars[ends] == bars[starts]) & (known >= np.maximum(2, 0.2 * n)), PROSE, NEUTRAL)
    out = np.zeros((len(texts), 6), dtype=np.int64)
    open_lines = (kinds == NEUTRAL) & (sizes > 0)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i in np.unique(owner[open_lines]):
        text, lo, hi = texts[i], first[i], first[i + 1]
        own, size = kinds[lo:hi].tolist(), sizes[lo:hi].tolist()
        bounds = [(int(a), int(b)) for a, b in zip(starts[lo:hi] - offsets[i], ends[lo:hi] - offsets[i], strict=True)]
        lines = [text[a:b] for a, b in bounds]
        for k in np.flatnonzero(open_lines[lo:hi]):
            own[k] = line_kind(lines[k])
        kinds[lo:hi] = settled(own, size, lines)
    np.add.at(out, (owner, kinds), sizes)
    return out
