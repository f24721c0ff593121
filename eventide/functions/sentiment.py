"""Lexicon hit counts for headlines: one pass over a text with one automaton for all terms."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from eventide import fixed_values as fv
from eventide.functions.text import clean_text
from eventide.workers import find_package

# A word character as JVM patterns with Unicode classes have it.
_WORD_CHARACTER = regex.compile(r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}]")


@dataclass(frozen=True)
class Lexicon:
    """Phrases match anywhere, words match at a word start; positive hits can be negated."""

    negative_phrases: tuple = fv.NEGATIVE_PHRASES
    positive_phrases: tuple = fv.POSITIVE_PHRASES
    negative_words: tuple = fv.NEGATIVE_WORDS
    positive_words: tuple = fv.POSITIVE_WORDS
    negators: str = fv.NEGATORS
    reach: int = fv.NEGATION_REACH


@lru_cache(maxsize=1 << 16)
def _in_word(character: str) -> bool:
    return _WORD_CHARACTER.match(character) is not None


class Matcher:
    """All terms of a lexicon in one automaton.

    Every occurrence of every term counts, also where terms overlap; occurrences of one term do not
    overlap each other. A positive hit with a negator among the `reach` characters before it is
    negative. Empty terms never match.
    """

    def __init__(self, lex: Lexicon):
        self.reach = lex.reach
        self.negator = regex.compile(lex.negators)
        self.terms: list[tuple[int, bool, bool, bool]] = []
        groups = ((lex.negative_phrases, False, False), (lex.positive_phrases, False, True),
                  (lex.negative_words, True, False), (lex.positive_words, True, True))
        by_term: dict[str, list[int]] = {}
        for terms, at_start, positive in groups:
            for t in filter(None, terms):
                by_term.setdefault(t, []).append(len(self.terms))
                self.terms.append((len(t), at_start, positive, _in_word(t[0])))
        self.automaton = ahocorasick.Automaton()
        for t, numbers in by_term.items():
            self.automaton.add_word(t, tuple(numbers))
        if by_term:
            self.automaton.make_automaton()

    def hits(self, text: str) -> tuple[int, int]:
        """Positive and negative hits of a lower-case text."""
        pos = neg = 0
        if not self.terms or not text:
            return pos, neg
        free = [0] * len(self.terms)
        for last, numbers in self.automaton.iter(text):
            for k in numbers:
                size, at_start, positive, starts_word = self.terms[k]
                start = last + 1 - size
                if start < free[k] or (at_start and starts_word == (
                        start > 0 and _in_word(text[start - 1]))):
                    continue
                free[k] = last + 1
                if positive and not self.negator.search(text[max(0, start - self.reach):start]):
                    pos += 1
                else:
                    neg += 1
        return pos, neg


@lru_cache(maxsize=8)
def matcher(lex: Lexicon) -> Matcher:
    """The automaton of a lexicon, built once in a worker."""
    return Matcher(lex)


def lexicon_hits(text: Column, lex: Lexicon = Lexicon()) -> Column:
    """struct(pos, neg): positive and negative hit counts of a text.

    A text crosses to Python once, in Arrow batches, and is read once however many terms there are.
    """
    find_package(SparkSession.active())

    def count(texts: pa.Array) -> pa.Array:
        one = matcher(lex)
        found = [one.hits(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([f[i] for f in found], pa.int32()) for i in (0, 1)], names=["pos", "neg"])
    counted = F.arrow_udf(count, "pos int, neg int")
    return counted(F.lower(clean_text(text)))
