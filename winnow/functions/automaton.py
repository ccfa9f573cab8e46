"""All terms of a lexicon in one pass over a text, with an Aho-Corasick automaton.

A term matches where its folded form stands between characters that are no word characters. Texts are folded
in the same step, so they travel to Python once and only matches come back.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from winnow.functions.text import _ACCENTED, _BARE

Term = tuple[str, str, str, bool]
MATCH_TYPE = "array<struct<kind: string, entity: string, term: string, ambiguous: boolean>>"
_ASCII_SPACES = "\t\n\x0b\x0c\r"
_OTHER_SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_PLAIN_MARKS = str.maketrans(_ACCENTED, _BARE)


def _without_marks(text: str) -> str:
    """``text`` without non-spacing marks. Only its own distinct characters are looked up: a pattern of all marks tests each character
    against hundreds of ranges beyond the first plane."""
    marks = [c for c in set(text) if c > "\x7f" and unicodedata.category(c) == "Mn"]
    if len(marks) > 8:
        return text.translate(dict.fromkeys(map(ord, marks)))
    for c in marks:
        text = text.replace(c, "")
    return text


def _single_spaced(text: str) -> str:
    """``text`` with one space for each run of white space. Most runs are one space already, so a pattern would replace every space by itself."""
    for c in _ASCII_SPACES if text.isascii() else _ASCII_SPACES + _OTHER_SPACES:
        text = text.replace(c, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return text


def folded(text: str, unicode: str) -> tuple[str, str]:
    """The folded text and the same without marks, as ``with_folded`` gives them."""
    if text.isascii():
        norm = _single_spaced(text.lower())
        return norm, norm
    if unicode == "native":
        norm = _single_spaced(text.lower().replace("ß", "ss"))
        return norm, norm.translate(_PLAIN_MARKS)
    norm = unicodedata.normalize("NFKC", text).casefold()
    bare = _without_marks(unicodedata.normalize("NFD", norm))
    return _single_spaced(norm), _single_spaced(bare)


def _is_word(c: str) -> bool:
    return c == "_" or c.isalnum()


class TermAutomaton:
    """Finds the terms (kind, entity, term, ambiguous) of a lexicon.

    A term with marks is also tried without them on text without them; a pan-regional term is tried as it is on both.
    """

    def __init__(self, terms: list[Term], unicode: str = "full"):
        import ahocorasick

        self.terms, self.unicode = terms, unicode
        forms: dict[str, tuple[list[int], list[int]]] = {}
        for k, (kind, _, term, _) in enumerate(terms):
            norm, bare = folded(term, unicode)
            tries = [(0, norm)]
            if kind == "pan" or bare != norm:
                tries.append((1, norm if kind == "pan" else bare))
            for stripped, form in tries:
                form = form.strip(" ")
                if any(map(_is_word, form)):
                    forms.setdefault(form, ([], []))[stripped].append(k)
        self._automaton = ahocorasick.Automaton() if forms else None
        for form, (plain, stripped) in forms.items():
            self._automaton.add_word(form, (len(form), plain, stripped))
        if forms:
            self._automaton.make_automaton()

    def _hits(self, text: str, out: set[int], kinds: tuple[int, ...]) -> None:
        n = len(text)
        for end, value in self._automaton.iter(text):
            before = end - value[0]
            if (before < 0 or not _is_word(text[before])) and (end + 1 >= n or not _is_word(text[end + 1])):
                for kind in kinds:
                    out.update(value[kind])

    def __call__(self, text: str | None) -> list[int]:
        """Numbers of the terms in ``text``."""
        out: set[int] = set()
        if text and self._automaton is not None:
            norm, bare = folded(text, self.unicode)
            if norm == bare:
                self._hits(norm, out, (1, 2))
            else:
                self._hits(norm, out, (1,))
                self._hits(bare, out, (2,))
        return sorted(out)


def found_terms(terms: list[Term], unicode: str = "full") -> Callable[[Column], Column]:
    """The distinct terms in a text column, as an array. The automaton is built once in each task."""

    @F.pandas_udf(MATCH_TYPE)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = TermAutomaton(terms, unicode)
        rows = [{"kind": k, "entity": e, "term": t, "ambiguous": a} for k, e, t, a in terms]
        for texts in batches:
            yield pd.Series([[rows[i] for i in automaton(t)] for t in texts], dtype=object)

    return find
