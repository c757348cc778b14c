"""Edit-aware token counts: a kept segment tree of pre-token counts for each document, updated where edits touch it.

A text falls into segments at borders that no token crosses and that hang on the two characters around them alone: a
space after a non-space begins a segment, so does a letter or other non-space after a line break. A segment's tokens are
therefore the same wherever it stands, and a document's count is the sum over its segments. The tree's leaves hold
segments' lengths and counts, inner nodes hold sums, so an offset is found and a sum is updated in logarithmic time. An
edit re-encodes the segments that it touches and the boundary context on both sides, nothing else.

``keep_trees`` encodes each text once and returns its leaves as a column; ``count_edits`` takes trees in, encodes only what
edits touch and returns the trees as they are then, so batch after batch of edits goes on from kept trees.

Edits are (start, removed, text): code points are removed from ``start`` on, then the text is put there; offsets refer to
the text as the edits before have left it. Defined results: null and empty texts count 0 tokens and can be edited; a null
edit changes nothing, a null start or removal is 0 and a null text empty; starts and removals beyond the end stop at the
end, negative ones at 0; repeated rows are counted apiece. A null tree is made from the text; one that belongs to another
text (its lengths differ) is an error.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import slices, written
from .packing import encoder, tokenizer_path

#: A space after a non-space, and a non-space after a single line break that follows a non-space, begin a segment.
BORDER = regex.compile(r"(?<=\S)(?= )|(?<=\S\n)(?=\S)")
#: Code points on each side of an edit that may decide whether there is a border.
CONTEXT = 2


def segments(text: str) -> list[str]:
    return [s for s in BORDER.split(text) if s]


class SegmentTree:
    """A text and its segments' (length, tokens) in blocks of rows; each node of a flat binary tree over blocks holds their sums.

    ``leaves`` are those of a tree of the same text, from ``pack``; without them the text is encoded.
    """

    def __init__(self, text: str | None, count: Callable[[str], int], leaves: bytes | None = None, block: int = 64):
        self.now, self.count, self.block, self.encoded = text or "", count, block, 0
        rows = self._encoded(self.now) if leaves is None else np.frombuffer(leaves, "<u4").reshape(-1, 2).astype(np.int64)
        if int(rows[:, 0].sum()) != len(self.now):
            raise ValueError("the tree belongs to another text")
        self._fill(rows)

    def _encoded(self, text: str) -> np.ndarray:
        self.encoded += len(text)
        some = segments(text)
        return np.array([*map(len, some), *map(self.count, some)], np.int64).reshape(2, -1).T

    def _fill(self, rows: np.ndarray) -> None:
        self.blocks = [rows[i : i + self.block] for i in range(0, len(rows), self.block)] or [rows]
        self.size = 1 << (len(self.blocks) - 1).bit_length()
        sums = np.add.reduceat(rows, np.arange(0, len(rows), self.block)).T.tolist() if len(rows) else [[0], [0]]
        # Plain numbers: single nodes are read and written far more often than all of them.
        self.length, self.tokens = ([0] * self.size + x + [0] * (self.size - len(x)) for x in sums)
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.length[i] = self.length[2 * i] + self.length[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_chars(self) -> int:
        return len(self.now)

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return self.now

    def pack(self) -> bytes:
        """The leaves, to be kept: two little-endian unsigned 32-bit numbers for each segment."""
        return np.concatenate(self.blocks).astype("<u4").tobytes()

    def find(self, at: int) -> tuple[int, int, int]:
        """(block, segment, its start) of the code point at ``at``; the last segment for the end."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if at >= start + self.length[i] and self.length[i + 1]:
                start += self.length[i]
                i += 1
        b = i - self.size
        rows = self.blocks[b][:, 0].tolist()
        for k, n in enumerate(rows):
            if at < start + n or k == len(rows) - 1:
                return b, k, start
            start += n
        return b, 0, start

    def edit(self, start: int, removed: int, put: str) -> int:
        """Applies one edit and returns the change of the count."""
        before, n = self.n_tokens, len(self.now)
        start = min(max(start, 0), n)
        end = min(start + max(removed, 0), n)
        # Whole segments around the edit, with the context that borders hang on.
        b0, k0, at0 = self.find(max(0, start - CONTEXT - 1))
        b1, k1, at1 = self.find(min(n, end + CONTEXT))
        last = at1 + int(self.blocks[b1][k1, 0]) if len(self.blocks[b1]) else n
        new = self._encoded(self.now[at0:start] + put + self.now[end:last])
        self.now = self.now[:start] + put + self.now[end:]
        head, tail = self.blocks[b0][:k0], self.blocks[b1][k1 + 1 :]
        for b in range(b0, b1 + 1):
            self.blocks[b] = new[:0]
        self.blocks[b0] = np.concatenate([head, new, tail] if b0 == b1 else [head, new])
        if b0 != b1:
            self.blocks[b1] = tail
        for b in range(b0, b1 + 1):
            self.length[self.size + b], self.tokens[self.size + b] = self.blocks[b].sum(axis=0).tolist()
        low, high = (self.size + b0) // 2, (self.size + b1) // 2
        while low:
            for i in range(low, high + 1):
                self._sum(i)
            low, high = low // 2, high // 2
        if len(self.blocks[b0]) > 8 * self.block:
            self._fill(np.concatenate(self.blocks))
        return self.n_tokens - before


def _counter(path: str, remember: int = 200_000) -> Callable[[str], int]:
    encode, seen = encoder(path), {}

    def count(s: str) -> int:
        if (n := seen.get(s)) is None:
            if len(seen) >= remember:
                seen.clear()
            n = seen[s] = len(encode(s))
        return n

    return count


def keep_trees(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """(id, text, n_tokens, tree) of every document, and its edits if a column has them; ``tree`` holds the leaves."""
    path = path or tokenizer_path()
    kept = df.select(id_col, text_col, *([edits_col] if edits_col else []))
    names = [*kept.columns, "n_tokens", "tree"]

    def run(batches):
        count = _counter(path)
        for b in slices(batches):
            made = [SegmentTree(t, count) for t in b.column(1).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array([t.n_tokens for t in made], pa.int64()), pa.array([t.pack() for t in made], pa.binary())], names=names)

    return kept.mapInArrow(run, StructType([*kept.schema, StructField("n_tokens", LongType()), StructField("tree", BinaryType())]))


def count_edits(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", tree_col: str | None = None) -> DataFrame:
    """(id, n_tokens before, n_tokens_after, n_chars_after, chars_reencoded, text_after, tree_after) of every document.

    ``edits_col`` is an array of structs (start, removed, put), null for none; ``tree_col`` has the trees of ``keep_trees``, or
    of an earlier call, which then spare all encoding but that of what edits touch; ``text_after`` is the edited text.
    """
    path = path or tokenizer_path()
    kind = df.schema[id_col].dataType.simpleString()
    tree = F.col(tree_col) if tree_col else F.lit(None).cast("binary")

    def run(batches):
        count = _counter(path)
        for b in slices(batches):
            cols: list[list] = [[] for _ in range(6)]
            for text, edits, leaves in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                t = SegmentTree(text, count, leaves)
                before = t.n_tokens
                # What is re-encoded for edits; without a kept tree the first encoding is no part of it.
                t.encoded = 0
                for e in edits or ():
                    if e is not None:
                        t.edit(e["start"] or 0, e["removed"] or 0, e["put"] or "")
                for c, v in zip(cols, (before, t.n_tokens, t.n_chars, t.encoded, t.text(), t.pack()), strict=True):
                    c.append(v)
            yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(cols, (*(pa.int64(),) * 4, pa.string(), pa.binary()), strict=True))], names=names)

    names = [id_col, "n_tokens", "n_tokens_after", "n_chars_after", "chars_reencoded", "text_after", "tree_after"]
    own = df.select(id_col, text_col, edits_col, tree.alias("kept"))
    return own.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_tokens_after long, n_chars_after long, chars_reencoded long, text_after string, tree_after binary")


def edited(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """``count_edits`` over kept trees: texts are encoded once and written with their trees, and edits are counted from there."""
    return count_edits(written(keep_trees(df, path, id_col, text_col, edits_col), "trees"), path, id_col, text_col, edits_col, "tree")


def sample_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """``df`` with a column of n edits whose places and texts follow from the id: a stand-in for an editor's log."""
    size = F.length(F.coalesce(F.col(text_col), F.lit("")))
    puts = F.array(*(F.lit(x) for x in (" revised", "X", "", "\nNew line. ", "  ", "é🙂")))

    def one(k: int):
        h = F.xxhash64(F.col(id_col), F.lit(k))
        return F.struct(
            F.pmod(h, size + 1).alias("start"),
            F.pmod(F.shiftright(h, 20), F.lit(12)).cast("long").alias("removed"),
            F.get(puts, F.pmod(F.shiftright(h, 40), F.lit(6)).cast("int")).alias("put"),
        )

    return df.withColumn("edits", F.array(*(one(k) for k in range(n))))
