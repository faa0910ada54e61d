"""Best-fit packing of token sequences with swap-based local search."""

from __future__ import annotations

import os
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrigenda.llm.common import cut, field_of, map_batches
from corrigenda.llm.tokens import encoder

CAPACITY = 2048
#: Pieces a shard packs together, in either round.
SHARD_PIECES = 4_096
#: Sequences filled less than this go to the second round.
LOOSE = 0.99


def cut_points(n: int, capacity: int = CAPACITY) -> list[int]:
    """Starts of a document's pieces: whole if it fits, else full pieces behind a shorter first one."""
    if n <= capacity:
        return [0]
    first = n % capacity or capacity
    return [0, *range(first, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """``id, piece, start, length, ids_crc32``: each text's ids and ``end_id``, cut where longer than ``capacity``.

    Null text is empty: its only token is ``end_id``. Repeated and null ids keep their rows.
    """
    schema = T.StructType([
        field_of(docs, id_col), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])
    end = np.array([end_id], "<u4").tobytes()

    def run(ids, texts):
        path = tokenizer if os.path.sep in tokenizer else public_tokenizers.path(tokenizer)
        out: dict = {f.name: [] for f in schema.fields}
        for key, raw in zip(ids.to_pylist(), encoder(path).encode([t or "" for t in texts.to_pylist()])):
            raw += end
            starts = cut_points(len(raw) // 4, capacity)
            for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(raw) // 4])):
                for name, v in zip(out, (key, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b]))):
                    out[name].append(v)
        yield out

    return map_batches(docs, [id_col, text_col], schema, run)


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that takes it."""
    by_room: dict[int, list[list[int]]] = {}
    rooms = 0  # bit r: a bin has exactly r free
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            bins = by_room[room]
            b = bins.pop()
            if not bins:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, []
        b.append(i)
        by_room.setdefault(room - n, []).append(b)
        rooms |= 1 << (room - n)
    return [b for bins in by_room.values() for b in bins]


class _Bins:
    """Underfull bins, and a table of what each could give: single items and pairs, by size."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.bins, self.lengths, self.capacity = bins, lengths, capacity
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.holders: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.sizes = 0  # bit s: some bin in the table has an item, or a pair, of size s

    def offers(self, k: int) -> dict[int, tuple[int, ...]]:
        """Size -> items, of every single item and every pair of bin k."""
        own, n = self.bins[k], self.lengths
        out = {n[i] + n[j]: (i, j) for x, i in enumerate(own) for j in own[x + 1 :]}
        out.update((n[i], (i,)) for i in own)
        return out

    def enter(self, k: int) -> None:
        for s in self.offers(k):
            self.holders[s].add(k)
            self.sizes |= 1 << s

    def leave(self, k: int) -> None:
        for s in self.offers(k):
            self.holders[s].discard(k)
            if not self.holders[s]:
                self.sizes &= ~(1 << s)

    def exchange(self, k: int, a: int, back: tuple[int, ...], out: tuple[int, ...]) -> None:
        gain = sum(self.lengths[i] for i in out) - sum(self.lengths[i] for i in back)
        self.bins[k] = [i for i in self.bins[k] if i not in back] + list(out)
        self.bins[a] = [i for i in self.bins[a] if i not in out] + list(back)
        self.fill[k] += gain
        self.fill[a] -= gain

    def best_gain(self, k: int) -> tuple[int, tuple[int, ...], int]:
        """(gain, what bin k gives back, size it takes) of the exchange with a bin in the table that fills k most."""
        free, best = self.capacity - self.fill[k], (0, (), 0)
        for given, back in [(0, ()), *self.offers(k).items()]:
            reach = self.sizes & ((1 << (given + free + 1)) - 1)
            size = reach.bit_length() - 1
            while size - given > best[0] and len(back) == 2 and not any(len(self.offers(a)[size]) == 1 for a in self.holders[size]):
                reach &= (1 << size) - 1  # two go only for one
                size = reach.bit_length() - 1
            if size - given > best[0]:
                best = (size - given, back, size)
                if best[0] == free:
                    break
        return best


def local_search(bins: list[list[int]], lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Empty underfull bins: move an item, or exchange one for one, two for one or one for two.

    The fullest underfull bin takes, from bins that are no fuller, what fills it most, until nothing
    does; then the next. An exchange into a bin at least as full raises the sum of squared fills, so the
    search ends: when no exchange is left in a whole pass over the underfull bins, or when the total
    length leaves no bin to save. After a pass with an exchange all bins are tried again.
    """
    t = _Bins([list(b) for b in bins if b], lengths, capacity)
    least = max(1, -(-sum(t.fill) // capacity))
    moved = True
    while moved and sum(1 for b in t.bins if b) > least:
        moved = False
        order = sorted((k for k, b in enumerate(t.bins) if b and t.fill[k] < capacity), key=lambda k: (-t.fill[k], k))
        for k in order:
            t.enter(k)
        for k in order:
            t.leave(k)  # those behind are no fuller: they only lose while this one gains
            if not t.bins[k]:
                continue
            while t.fill[k] < capacity:
                gain, back, size = t.best_gain(k)
                if not gain:
                    break
                a = max((a for a in t.holders[size] if len(back) < 2 or len(t.offers(a)[size]) == 1), key=lambda a: (-t.fill[a], a))
                if t.fill[k] + gain <= t.fill[a]:
                    break
                t.leave(a)
                t.exchange(k, a, back, t.offers(a)[size])
                t.enter(a)
                moved = True
    return [b for b in t.bins if b]


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds ``sequence_id, offset`` to ``pieces``; sequences hold at most ``capacity`` tokens, without gaps.

    Pieces are dealt by hash to shards of about SHARD_PIECES rows, each packed by best fit and local
    search in one task; what remains in loosely filled sequences (few a shard, unless the lengths
    pack badly) is dealt and packed once more. No row is dropped, and no task grows with the input.
    Null and repeated ids keep their rows; equal lengths are taken in the order of ids; an empty table
    stays empty.
    """
    rows = cut(pieces, "pieces")
    n = rows.count()
    shards = max(1, n // shard_pieces)
    out_schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("_fill", T.LongType())])

    def packer(round_no: int):
        def run(key, pdf):
            pdf = pdf.sort_values(["length", id_col, "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
            lengths = pdf["length"].astype(int).tolist()
            bins = local_search(best_fit(lengths, capacity), lengths, capacity)
            seq, off, fill = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for k, b in enumerate(bins):
                size = [lengths[i] for i in b]
                seq[b] = (round_no << 62) + (int(key[0]) << 24) + k
                off[b] = np.cumsum([0, *size[:-1]])
                fill[b] = sum(size)
            return pdf.drop(columns=["_shard"]).assign(sequence_id=seq, offset=off, _fill=fill)[out_schema.names]

        return run

    shard = F.pmod(F.xxhash64(*[c for c in rows.columns]), F.lit(shards)).cast("int")
    first = cut(rows.withColumn("_shard", shard).groupBy("_shard").applyInPandas(packer(0), out_schema), "packed")
    loose = F.col("_fill") < int(LOOSE * capacity)
    again = first.where(loose).drop("sequence_id", "offset", "_fill")
    left = max(1, again.count() // shard_pieces)
    # loose sequences of one shard would only come together as they were: deal their pieces anew
    deal = F.pmod(F.xxhash64(*rows.columns, F.lit(1)), F.lit(left)).cast("int")
    second = again.withColumn("_shard", deal).groupBy("_shard").applyInPandas(packer(1), out_schema)
    return first.where(~loose).unionByName(second).drop("_fill")
