"""Token counts of a document's sections, by offsets.

Each text is encoded once as a whole; the tokens' spans are interval-joined to the sections by
binary search over both sorted lists. Sections are lines (each with its line end), or blocks of a
fixed number of characters. A token that crosses a boundary belongs to the section that holds its
first character, and is counted in ``n_crossing``. Byte-level tokens may start inside a character;
sections start at characters, so byte spans and character spans give the same owner.

The split pattern's engine can't go through runs of about a million white-space characters. Such a
run is one piece of the pattern, but for its last character where something follows (that one may
belong to what follows, and the pattern looks no further back). So runs of more than ``RUN`` are merged
as the piece that they are, and what stands before and behind them is encoded by itself: the tokens
are those of the whole text.

Defined cases: a null or empty text has no sections and no tokens; a text of any length is
encoded whole, whatever its runs; repeated rows and null ids pass through; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a block, and of a run of white space that is merged apart.
BLOCK, RUN = 500, 10_000
#: Fixed value: what the pattern's engine takes for white space.
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_SECTIONS = "array<struct<start:long,tokens:long>>"
SCHEMA = f"doc_id long, n_tokens long, lines {_SECTIONS}, lines_crossing long, blocks {_SECTIONS}, blocks_crossing long"


def line_starts(raw: np.ndarray) -> np.ndarray:
    """First byte of each line."""
    return np.append(0, np.flatnonzero(raw[:-1] == 10) + 1)


def block_starts(raw: np.ndarray, size: int) -> np.ndarray:
    """First byte of each ``size`` characters; bytes 80 to BF (hex) go on with a character."""
    return np.flatnonzero((raw & 0xC0) != 0x80)[::size]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        known = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split, self.merge = known.encode_ordinary, known._encode_single_piece
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, at in ranks.items():
            self.sizes[at] = len(token)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        done = 0
        for run in re.finditer(f"{SPACE}{{{RUN + 1},}}", text):
            end = run.end() - (run.end() < len(text))
            out += self.split(text[done : run.start()]) + self.merge(text[run.start() : end].encode())
            done = end
        return out + self.split(text[done:])

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(first byte, end) of every token."""
        ends = np.cumsum(self.sizes[np.asarray(self.encode(text), np.int64)])
        return np.append(0, ends)[:-1], ends


def attribute(begins: np.ndarray, ends: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """(tokens owned by each section, tokens that cross a boundary) of tokens' and sections' bytes."""
    owner = np.searchsorted(starts, begins, "right") - 1
    return np.bincount(owner, minlength=len(starts)), int((ends > np.append(starts[1:], size)[owner]).sum())


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """One row per document: its tokens, and those of its lines and blocks (start in bytes, tokens).

    A map over partitions, no shuffle. The vocabulary (a fixed file of about a megabyte) is
    read on the driver and broadcast, so executors need no copy of it.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("tokens", pa.int64())]))

    def listed(starts: list[np.ndarray], tokens: list[np.ndarray]) -> pa.Array:
        offsets = np.cumsum([0, *map(len, starts)], dtype=np.int32)
        flat = [pa.array(np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64)) for x in (starts, tokens)]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(flat, names=["start", "tokens"])).cast(kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                n: list[int] = []
                found: list[tuple[list, list, list]] = [([], [], []), ([], [], [])]
                for text in batch.column(1)[at : at + 200]:
                    text = text.as_py() or ""
                    raw = np.frombuffer(text.encode(), np.uint8)
                    begins, ends = encoder.spans(text)
                    n.append(len(begins))
                    for (starts, tokens, crossing), mine in zip(found, (line_starts(raw), block_starts(raw, block)) if text else (np.empty(0, np.int64),) * 2, strict=True):
                        owned, across = attribute(begins, ends, mine, len(raw))
                        starts.append(mine)
                        tokens.append(owned)
                        crossing.append(across)
                columns = [c for starts, tokens, crossing in found for c in (listed(starts, tokens), pa.array(crossing, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 200], pa.array(n, pa.int64()), *columns], names=["doc_id", "n_tokens", "lines", "lines_crossing", "blocks", "blocks_crossing"])

    return docs.select("doc_id", "text").mapInArrow(work, SCHEMA)
