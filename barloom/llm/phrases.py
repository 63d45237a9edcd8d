"""Substring dedup by words: repeated-phrase automata.

``repeats`` deals passages around equal anchors to shards. In a shard, word windows that occur
at two places are confirmed as recurring phrases, an Aho-Corasick automaton is compiled from
them (a word is one letter of its alphabet), and every passage of the shard is streamed
through it, which locates every occurrence. A shard works on about ``repeats.BATCH`` windows at
a time, which bounds the automaton.

Defined cases: null texts have no words; texts of fewer words than ``width`` keep everything;
a text that occurs twice is removed wholly if it is long enough; matches never cross
documents and ignore how much white space stands between words; an empty table gives an
empty result; other columns are ignored or kept.
"""

from __future__ import annotations

from collections import Counter

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.repeats import Kind, per_document, remove_repeats, texts_left

PHRASE = Kind(words=True, width=35, gram=8, chunk=28, sub=4)
_FIRST, _SURROGATES = 0x100, 0xD800


def _letter(n: int) -> str:
    """A character of its own for the n-th word of a shard."""
    n += _FIRST
    return chr(n if n < _SURROGATES else n + 0x800)


def resolve(kind: Kind, groups: list[list[tuple[int, bytes, int]]]) -> list[list[np.ndarray]]:
    w = kind.width
    alphabet: dict[bytes, str] = {}
    spelled = [["".join(alphabet.setdefault(x, _letter(len(alphabet))) for x in content.split(b" ")) for _, content, _ in group] for group in groups]
    flags = [[np.full(len(s) - w + 1, n > 1) for s, (_, _, n) in zip(ss, group, strict=True)] for ss, group in zip(spelled, groups, strict=True)]
    seen: Counter[str] = Counter()
    for ss, group in zip(spelled, groups, strict=True):
        if len(group) > 1 and any(n == 1 for _, _, n in group):
            for s, (_, _, n) in zip(ss, group, strict=True):
                for i in range(len(s) - w + 1):
                    seen[s[i : i + w]] += n
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for phrase, n in seen.items():
        if n > 1:
            automaton.add_word(phrase)
    if not len(automaton):
        return flags
    automaton.make_automaton()
    for ss, fs in zip(spelled, flags, strict=True):
        for s, f in zip(ss, fs, strict=True):
            if not f.all():
                for end, _ in automaton.iter(s):
                    f[end - w + 1] = True
    return flags


def dedup(docs: DataFrame, kind: Kind = PHRASE, keep_text: bool = False) -> DataFrame:
    """One row per distinct text with what is left of it, see ``remove_repeats``."""
    return remove_repeats(docs, kind, resolve, keep_text)


def digests(docs: DataFrame, classes: DataFrame) -> DataFrame:
    return per_document(docs, classes.select("_h1", "_h2", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256"), "doc_id")


def dedup_texts(docs: DataFrame, kind: Kind = PHRASE) -> DataFrame:
    """``docs`` with recurring phrases taken out of ``text``, words joined by one space; null texts stay null."""
    return texts_left(docs, dedup(docs, kind, keep_text=True))
