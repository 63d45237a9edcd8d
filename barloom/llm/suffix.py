"""Suffix-array dedup: deep-shallow sorting of the suffixes that can match.

``repeats`` brings together the text around equal anchors; here the suffixes that start in it
are sorted, each to ``width`` bytes:

* shallow: multikey quicksort, eight bytes a character: each group is sorted by its next
  character, and only what is still equal goes one character deeper, down to ``SHALLOW``;
* deep: each remaining group with its long common prefix goes through a blind trie, which
  branches on single bytes, is descended without comparing and then compared once with the
  leaf it reached. Suffixes that share a leaf agree in all ``width`` bytes.

Windows of words are sorted the same way: a word is four bytes then, its number in the task, and
suffixes start at words.

Defined cases: null texts are empty; texts shorter than ``width`` bytes keep everything; a
text that occurs twice (repeated rows, any ids) is removed wholly if it is long enough;
matches never cross documents; any length of text and any number of copies is worked through;
an empty table gives an empty result; other columns are ignored or kept. Removal is by bytes:
where a removed run cuts a character, ``dedup_texts`` drops the rest of that character.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.repeats import Kind, cut_repeats, per_document, remove_repeats, texts_left

BYTES = Kind(words=False, width=400, gram=64, chunk=128, sub=8)
#: Passages of more than 50 words, whatever white space stands between them and however few bytes they have.
PASSAGE = Kind(words=True, width=51, gram=8, chunk=28, sub=4)
SHALLOW = 64


def _words8(blob: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as one number in byte order."""
    padded = np.concatenate([blob, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(blob), np.uint64)
    for i in range(8):
        out |= padded[i : i + len(blob)] << np.uint64(56 - 8 * i)
    return out


def shallow_sort(blob: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int) -> list[np.ndarray]:
    """Runs of indexes into ``starts``, in suffix order within each group, that agree in ``depth`` bytes (two or more)."""
    word = _words8(blob)
    index, where = np.arange(len(starts)), group.astype(np.int64)
    for d in range(0, depth, 8):
        if not len(index):
            return []
        character = word[starts[index] + d]
        order = np.lexsort((character, where))
        index, where, character = index[order], where[order], character[order]
        new = np.concatenate([[True], (where[1:] != where[:-1]) | (character[1:] != character[:-1])])
        where = np.cumsum(new) - 1
        several = np.bincount(where)[where] > 1
        index, where = index[several], where[several]
    cuts = np.flatnonzero(np.diff(where)) + 1
    return np.split(index, cuts) if len(index) else []


class _Branch:
    __slots__ = ("children", "depth")

    def __init__(self, depth: int, children: dict):
        self.depth, self.children = depth, children


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two different strings of one length."""
    lo, hi = 0, len(a)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
    return lo


def blind_trie(strings: list[bytes]) -> list[list[int]]:
    """Indexes of ``strings`` (all of one length) in order, equal ones together."""
    root: tuple | _Branch = (strings[0], [0])
    for i, s in enumerate(strings[1:], 1):
        node = root
        while node.__class__ is _Branch:  # blind: bytes in between aren't looked at
            node = node.children.get(s[node.depth]) or next(iter(node.children.values()))
        other, members = node
        if other == s:
            members.append(i)
            continue
        n, above, node = _common(s, other), None, root
        while node.__class__ is _Branch and node.depth < n:
            above, node = node, node.children[s[node.depth]]
        if node.__class__ is _Branch and node.depth == n:
            node.children[s[n]] = (s, [i])
            continue
        branch = _Branch(n, {other[n]: node, s[n]: (s, [i])})
        if above is None:
            root = branch
        else:
            above.children[s[above.depth]] = branch
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.__class__ is _Branch:
            todo += [node.children[c] for c in sorted(node.children, reverse=True)]
        else:
            out.append(node[1])
    return out


def _coded(kind: Kind, groups: list[list[tuple[int, bytes, int]]]) -> tuple[int, list[list[bytes]]]:
    """(bytes of a unit, contents): bytes as they are, words as numbers of four bytes."""
    if not kind.words:
        return 1, [[content for _, content, _ in group] for group in groups]
    number: dict[bytes, int] = {}
    return 4, [[np.array([number.setdefault(x, len(number)) for x in content.split(b" ")], ">u4").tobytes() for _, content, _ in group] for group in groups]


def resolve(kind: Kind, groups: list[list[tuple[int, bytes, int]]]) -> list[list[np.ndarray]]:
    """Which windows repeat, for every content of every group."""
    unit, coded = _coded(kind, groups)
    w = kind.width * unit
    flags = [[np.full((len(content) - w) // unit + 1, n > 1) for content, (_, _, n) in zip(contents, group, strict=True)] for contents, group in zip(coded, groups, strict=True)]
    parts, owner, where, size = [], [], [], 0
    for g, (contents, group) in enumerate(zip(coded, groups, strict=True)):
        if len(group) > 1 and any(n == 1 for _, _, n in group):
            for c, content in enumerate(contents):
                n = len(flags[g][c])
                parts.append(content)
                owner.append((g, c, size, n))
                where.append(np.full(n, g))
                size += len(content)
    if not parts:
        return flags
    raw = b"".join(parts)
    starts = np.concatenate([at + unit * np.arange(n) for _, _, at, n in owner])
    content_of = np.repeat(np.arange(len(owner)), [n for *_, n in owner])
    shallow = min(SHALLOW, w // 8 * 8)
    for run in shallow_sort(np.frombuffer(raw, np.uint8), starts, np.concatenate(where), shallow):
        at = starts[run].tolist()
        for leaf in blind_trie([raw[x + shallow : x + w] for x in at]) if w > shallow else [list(range(len(at)))]:
            if len(leaf) > 1:
                for j in leaf:
                    g, c, begin, _ = owner[content_of[run[j]]]
                    flags[g][c][(at[j] - begin) // unit] = True
    return flags


def dedup(docs: DataFrame, kind: Kind = BYTES, keep_text: bool = False) -> DataFrame:
    """One row per distinct text with what is left of it, see ``remove_repeats``."""
    return remove_repeats(docs, kind, resolve, keep_text)


def digests(docs: DataFrame, classes: DataFrame) -> DataFrame:
    return per_document(docs, classes.select("_h1", "_h2", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256"), "doc_id")


def dedup_texts(docs: DataFrame, kind: Kind = BYTES) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text``; null texts stay null."""
    return texts_left(docs, dedup(docs, kind, keep_text=True))


def cut_texts(docs: DataFrame, *kinds: Kind) -> DataFrame:
    """``docs`` without what repeated windows of any of ``kinds`` cover in ``text``; the rest of it keeps its white space."""
    return texts_left(docs, cut_repeats(docs, list(kinds), resolve))
