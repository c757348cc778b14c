"""Best-fit packing by a grouping genetic algorithm, distributed as islands with elite migration.

Documents become token ids and end with id 0. Only documents above the capacity are cut, into pieces of exactly the
capacity with a shorter first piece where needed. A full piece is a sequence of its own; all other pieces are dealt into
groups of about ``group_pieces``. For each group, islands evolve populations of packings in which a gene is a whole bin:

* crossover injects well-filled bins of one parent into the other and drops the bins that would repeat a document;
* mutation dissolves the worst-filled bins and a few others;
* displaced documents first change places with one or two of a kept bin wherever that fills the bin better, and what is
  loose then is best-fitted again, largest first;
* an island stops at a lower bound on the bins, which proves its packing best, or once ``PATIENCE`` children in a row have
  not beaten its elite; the number of generations has no limit;
* after each epoch every island hands its elite to the next island of its group (a ring; migration is a shuffle of one
  compact assignment for each island).

The best packing of a group wins. Bins below ``settle`` of the capacity are dissolved and their pieces dealt into fewer
groups for another round, so that groups don't cost open bins; the last round keeps all bins.

Defined results: a null or empty text is id 0 alone; ties go to the smaller piece key; repeated rows are documents of
their own; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

CAPACITY = 2048
GROUP_PIECES, ISLANDS, EPOCHS, SETTLE = 4096, 2, 2, 0.98
POPULATION, PATIENCE = 4, 60


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids, equal to tokenizers' ``encode(text, add_special_tokens=False)`` with special tokens' strings as ordinary text.

    The vocabulary and merge order of the tokenizers file, run by tiktoken's matcher, which is several times as fast.
    A file that isn't a byte-level BPE whose ids follow the merges is run by tokenizers itself.
    """
    import json

    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    spec = json.load(open(path, encoding="utf-8"))
    vocab, kind = spec["model"].get("vocab", {}), spec.get("pre_tokenizer") or {}
    if spec["model"].get("type") != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec.get("normalizer"):
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    import public_tokenizers
    import tiktoken

    # Byte-level vocabularies write bytes as printable characters: those that print stand for themselves, the rest follow from 256.
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    special = {x["content"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(table[c] for c in piece): i for piece, i in vocab.items() if piece not in special}
    fast = tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return fast.encode_ordinary


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; the first takes the remainder."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32), with the ids themselves where asked for."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        encode = encoder(path)
        for b in slices(batches):
            rows: list[list] = [[] for _ in range(6)]
            for at, text in enumerate(b.column(1).to_pylist()):
                ids = np.array([*encode(text), 0] if text else [0], "<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    part = ids[s : s + n]
                    for c, v in zip(rows, (at, k, s, n, zlib.crc32(part.tobytes()), part.astype(np.int64) if with_ids else None), strict=True):
                        c.append(v)
            cols = [b.column(0).take(pa.array(rows[0], pa.int64())), *(pa.array(c, k) for c, k in zip(rows[1:5], (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(rows[5], pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.record_batch(cols, names=names)

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


class _Open:
    """Open bins by free room: best fit finds the least room that takes a piece, by a bit set over all rooms."""

    def __init__(self, capacity: int):
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0

    def put(self, room: int, b: int) -> None:
        if room:
            self.at[room].append(b)
            self.bits |= 1 << room

    def take(self, length: int) -> tuple[int, int] | None:
        if not (above := self.bits >> length):
            return None
        room = length + (above & -above).bit_length() - 1
        b = self.at[room].pop()
        if not self.at[room]:
            self.bits &= ~(1 << room)
        return room, b


def best_fit(lengths: np.ndarray, order, bins: np.ndarray, rooms: dict[int, int], capacity: int) -> int:
    """Puts the pieces of ``order`` into the bins with these rooms or into new ones; bins is changed; returns the next bin number."""
    free, new = _Open(capacity), max(rooms, default=-1) + 1
    for b, r in rooms.items():
        free.put(r, b)
    each = lengths.tolist()
    for i in order:
        n = each[i]
        if (got := free.take(n)) is None:
            bins[i], room = new, capacity - n
            free.put(room, new)
            new += 1
        else:
            bins[i] = got[1]
            free.put(got[0] - n, got[1])
    return new


def _renumber(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1]


def bound(lengths: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing can do with less: the most that several dual feasible functions of the lengths give."""
    size = np.arange(capacity + 1, dtype=np.int64)
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    total = count * size
    least = -(-int(total.sum()) // capacity)
    # Lengths in steps of a (k + 1)-th of the capacity, rounded down to whole k-ths unless they hit a step.
    for k in range(1, 33):
        steps = (k + 1) * size
        least = max(least, -(-int((count * np.where(steps % capacity == 0, k * size, steps // capacity * capacity)).sum()) // (capacity * k)))
    # Pieces shorter than a don't count, and one that leaves less than a has a bin of its own.
    a = np.arange(1, capacity // 2 + 1)
    n, t = count.cumsum(), total.cumsum()
    own, rest = n[capacity] - n[capacity - a], t[capacity - a] - t[a - 1]
    return max(least, int((own - (-rest // capacity)).max(initial=0)))


def fitness(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> float:
    """Mean squared fill of the bins, more for fewer bins: what grouping algorithms climb instead of the bare count."""
    fill = np.bincount(bins, lengths) / capacity
    return float((fill**2).sum() / len(fill) - len(fill))


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator, share: float = 0.3) -> np.ndarray:
    """A child of ``a``: well-filled whole bins of ``b`` come in, bins of ``a`` that repeat their pieces go, displaced pieces are packed again."""
    fill = np.bincount(b, lengths)
    full = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    come = rng.choice(full, max(1, int(share * len(full))), replace=False)
    into = np.zeros(len(fill), bool)
    into[come] = True
    mine = into[b]
    gone = np.zeros(int(a.max()) + 1, bool)
    gone[a[mine]] = True
    stay = ~gone[a]
    child = np.where(mine, b + len(gone), a)
    loose = ~mine & ~stay
    return _repair(child, loose, lengths, capacity, rng)


def mutate(a: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator, share: float = 0.01) -> np.ndarray:
    """The worst-filled bins, and a few at random, are dissolved and their pieces packed again."""
    fill = np.bincount(a, lengths)
    k = max(2, int(share * len(fill)))
    gone = np.zeros(len(fill), bool)
    gone[np.argsort(fill, kind="stable")[:k]] = True
    gone[rng.integers(0, len(fill), k)] = True
    return _repair(a.copy(), gone[a], lengths, capacity, rng)


def _exchange(bins: np.ndarray, loose: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator, reach: int = 3, mates: int = 128) -> int:
    """One or two pieces of a bin change places with one or two loose ones that fill it better; the tightest fits go first.

    bins and loose are changed; a bin takes part once a call; returns the number of exchanges. Two pieces of a bin are tried
    together up to ``reach`` places apart, and pairs of ``mates`` loose pieces, drawn anew for each call.
    """
    kept, free = np.flatnonzero(~loose), np.flatnonzero(loose)
    order = kept[np.argsort(bins[kept], kind="stable")]
    room = capacity - np.bincount(bins[order], lengths[order]).astype(np.int64)
    outs = [(order, np.full(len(order), -1))]
    for d in range(1, reach + 1):
        same = bins[order[d:]] == bins[order[:-d]]
        outs.append((order[:-d][same], order[d:][same]))
    out, out2 = (np.concatenate(x) for x in zip(*outs, strict=True))
    some = rng.permutation(free)[:mates]
    i, j = np.triu_indices(len(some), 1)
    come, come2 = np.concatenate([free, some[i]]), np.concatenate([np.full(len(free), -1), some[j]])
    gives, takes = (lengths[x] + np.where(y < 0, 0, lengths[y]) for x, y in ((out, out2), (come, come2)))
    at = np.argsort(takes, kind="stable")
    takes = takes[at]
    # The most that goes into the room that is there without the pieces that leave.
    k = np.searchsorted(takes, gives + room[bins[out]], side="right") - 1
    better = np.flatnonzero((k >= 0) & (takes[k] > gives))
    gain = takes[k[better]] - gives[better]
    best = np.lexsort((-gain, room[bins[out[better]]] - gain))
    best = best[np.sort(np.unique(bins[out[better[best]]], return_index=True)[1])]
    unused, done = loose.copy(), 0
    for q, new in zip(better[best].tolist(), at[k[better[best]]].tolist(), strict=True):
        ins = [x for x in (come[new], come2[new]) if x >= 0]
        if all(unused[x] for x in ins):
            b = bins[out[q]]
            for x in ins:
                unused[x] = loose[x] = False
                bins[x] = b
            for x in (out[q], out2[q]):
                if x >= 0:
                    loose[x] = True
            done += 1
    return done


def _repair(bins: np.ndarray, loose: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator, passes: int = 3) -> np.ndarray:
    for _ in range(passes):
        if not loose.any() or loose.all() or not _exchange(bins, loose, lengths, capacity, rng):
            break
    kept = np.flatnonzero(~loose)
    numbers, back = np.unique(bins[kept], return_inverse=True)
    bins[kept] = back
    rooms = dict(enumerate((capacity - np.bincount(back, lengths[kept], len(numbers))).astype(int).tolist())) if len(kept) else {}
    out = np.flatnonzero(loose)
    best_fit(lengths, out[np.argsort(-lengths[out], kind="stable")].tolist(), bins, rooms, capacity)
    return _renumber(bins)


def evolve(lengths: np.ndarray, capacity: int, seed: int, guests: list[np.ndarray], population: int = POPULATION, patience: int = PATIENCE) -> np.ndarray:
    """The best packing an island finds from a few best-fit starts and the guests; never worse than its starts.

    Ends when the bins are as few as ``bound`` or ``patience`` children in a row have not beaten the best packing.
    """
    rng = np.random.default_rng(seed)
    least = bound(lengths, capacity)
    pool = [g.copy() for g in guests]
    while len(pool) < population:
        noise = 0.0 if not pool else 0.03 * len(pool)
        keys = lengths * (1 + noise * rng.standard_normal(len(lengths)))
        bins = np.zeros(len(lengths), np.int64)
        best_fit(lengths, np.argsort(-keys, kind="stable").tolist(), bins, {}, capacity)
        pool.append(bins)
    marks = [fitness(p, lengths, capacity) for p in pool]
    stale = 0
    while stale < patience:
        top = int(np.argmax(marks))
        if int(pool[top].max()) + 1 <= least:
            break
        i, j = rng.choice(len(pool), 2, replace=False)
        if marks[j] > marks[i]:
            i, j = j, i
        child = mutate(crossover(pool[top] if rng.random() < 0.5 else pool[i], pool[j], lengths, capacity, rng), lengths, capacity, rng)
        mark, low = fitness(child, lengths, capacity), int(np.argmin(marks))
        stale = 0 if mark > marks[top] else stale + 1
        if mark > marks[low]:
            pool[low], marks[low] = child, mark
    return pool[int(np.argmax(marks))]


def _islands(dealt: DataFrame, groups: int, capacity: int, islands: int, epochs: int, last: bool, settle: float) -> DataFrame:
    """dealt: (group, key, length) -> (key, bin, room left) by the best packing of each group.

    Island state is one row for each (group, island): sorted keys, their lengths and a bin for each. A group has a bounded
    number of pieces, so a row is bounded too; groups are dealt by hash, whatever source the pieces come from.
    """
    state = dealt.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("key", "length"))).alias("items"))
    state = state.select("grp", F.col("items.key").alias("keys"), F.col("items.length").alias("lengths"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    state = state.withColumn("bins", F.array().cast("array<array<int>>")).repartition(max(1, groups * islands), "grp", "island")
    for epoch in range(epochs):

        def run(batches, epoch=epoch):
            for pdf in batches:
                out = []
                for g, isl, lengths, guests in zip(pdf["grp"], pdf["island"], pdf["lengths"], pdf["bins"], strict=True):
                    n = np.asarray(lengths, np.int64)
                    best = evolve(n, capacity, int(g) * 1009 + int(isl) * 31 + epoch, [np.asarray(x, np.int64) for x in guests])
                    out.append([best.astype(np.int32)])
                yield pdf.assign(bins=out)

        state = state.mapInPandas(run, state.schema)
        if epoch < epochs - 1:
            # An island keeps its own elite and gets that of the island before it.
            moved = state.select("grp", "keys", "lengths", "island", F.col("bins")[0].alias("own"))
            moved = moved.select("grp", "keys", "lengths", F.explode(F.array(F.col("island"), (F.col("island") + 1) % islands)).alias("island"), "own")
            state = moved.groupBy("grp", "island").agg(F.first("keys").alias("keys"), F.first("lengths").alias("lengths"), F.collect_set("own").alias("bins")).select(*state.columns)
            state = written(state, "islands")

    def best(batches):
        for pdf in batches:
            for _, x in pdf.iterrows():
                n = np.asarray(x["lengths"], np.int64)
                top = max((np.asarray(b, np.int64) for b in x["all_bins"]), key=lambda b: fitness(b, n, capacity))
                fill = np.bincount(top, n).astype(np.int64)
                order = np.lexsort((x["keys"], top))
                b = top[order]
                ends = np.cumsum(n[order])
                starts = ends - n[order]
                offset = starts - starts[np.searchsorted(b, b)]
                yield pd.DataFrame({"key": np.asarray(x["keys"], np.int64)[order], "sequence_id": (int(x["grp"]) << 32) + b, "offset": offset, "open": fill[b] < (0 if last else settle * capacity)})

    elites = state.groupBy("grp").agg(F.first("keys").alias("keys"), F.first("lengths").alias("lengths"), F.collect_list(F.col("bins")[0]).alias("all_bins"))
    return elites.mapInPandas(best, "key long, sequence_id long, offset long, open boolean")


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, islands: int = ISLANDS, epochs: int = EPOCHS, settle: float = SETTLE) -> DataFrame:
    """``cut_pieces`` (with ``length``) plus sequence_id and offset.

    Sequence ids hold the round in the top bits, then the group and the bin; full pieces have ids below zero.
    """
    keyed = written(cut_pieces.withColumn("key", F.monotonically_increasing_id()), "pieces")
    loose = keyed.filter(F.col("length") < capacity).select("key", "length")
    n, done = loose.count(), []
    for r in range(3):
        groups = max(1, -(-n // group_pieces))
        last = groups == 1 or r == 2
        # A group's size is its share of a hash; it stays near group_pieces at any number of pieces.
        dealt = loose.withColumn("grp", F.pmod(F.xxhash64("key", F.lit(r)), F.lit(groups)))
        packed = written(_islands(dealt, groups, capacity, islands, epochs, last, settle), "packed")
        done.append(packed.filter(~F.col("open")).select("key", (F.col("sequence_id") + (r << 56)).alias("sequence_id"), "offset"))
        if last:
            break
        loose = packed.filter("open").join(loose, "key").select("key", "length")
        if not (n := loose.count()):
            break
    placed = done[0]
    for x in done[1:]:
        placed = placed.unionByName(x)
    whole = keyed.filter(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.col("key")).withColumn("offset", F.lit(0).cast("long"))
    some = keyed.filter(F.col("length") < capacity).join(placed, "key")
    return some.unionByName(whole).drop("key")


def pack_documents(df: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, **options) -> DataFrame:
    """One row for each piece: (id, piece, start, length, ids_crc32, sequence_id, offset), with ``ids`` where asked for."""
    return pack(pieces(df, path or tokenizer_path(), capacity, id_col, text_col, with_ids), capacity, **options)
