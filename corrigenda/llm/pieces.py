"""Exact merge-type (BPE) piece encoding by backtracking, and its decoding."""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corrigenda.llm.common import field_of, map_batches

SPACE = "▁"
#: Units, and adjacent pairs, kept by a worker's caches before they start anew.
CACHE_UNITS, CACHE_PAIRS = 150_000, 400_000


class PieceEncoder:
    """Encodes as a merge-type sentence-piece model with byte fallback and identity normalisation.

    Merging picks, again and again, the adjacent pair whose joined piece ranks best (leftmost
    first). The result is the only sequence of pieces in which every adjacent pair survives its own
    re-merging. So: take the longest match at each place (all matches come from one Aho-Corasick
    pass), check it against the previous piece by re-merging the two, else try the next shorter
    one, else step back; a bit field marks places from which no valid way leads on. Each place fails
    at most once, which keeps very long words linear.

    No piece of the model holds a space mark behind another character, so a text falls apart at
    each run of marks and every distinct unit is encoded once.
    """

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        spec, kinds = m.normalizer_spec, {p.type for p in m.pieces}
        if m.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not m.trainer_spec.byte_fallback or kinds - {1, 2, 3, 6}:
            raise ValueError("only merge-type models with byte fallback, identity normalisation and no user pieces")
        self.id = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 1}
        self.score = {p.piece: p.score for p in m.pieces if p.type == 1}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        if any(SPACE in s.lstrip(SPACE) for s in self.id):
            raise ValueError("a piece runs across a space")
        self.shown = [p.piece.replace(SPACE, " ") if p.type == 1 else "" for p in m.pieces]
        for b, i in self.byte_id.items():  # single bytes of a longer character join on encoding
            self.shown[i] = chr(b) if b < 128 else chr(0xDC00 + b)
        self.number = [str(i) for i in range(len(m.pieces))]
        #: pieces that merging can reach at all
        whole = [s for s in self.id if len(s) == 1 or self.merged(s) == [s]]
        self.matches = ahocorasick.Automaton()
        for s in whole:
            self.matches.add_word(s, (len(s) - 1, s))
        self.matches.make_automaton()
        known = self.whole = set(whole)
        #: neighbours within a piece; no merge ever joins two characters that are not among them
        self.inside = {s[k : k + 2] for s in whole for k in range(len(s) - 1)}
        #: the next shorter match at the same place; a single character always is one
        self.shorter = {s: next((s[:k] for k in range(len(s) - 1, 1, -1) if s[:k] in known), s[0]) for s in whole if len(s) > 1}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.units: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merged(self, s: str) -> list[str]:
        """The merging itself, for the short strings of one or two pieces."""
        parts, score = list(s), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                x = score.get(parts[k] + parts[k + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            # a joined piece that merging can reach is what the two would become
            got = self.pairs[a, b] = a + b not in self.whole and self.merged(a + b) == [a, b]
        return got

    def unit(self, s: str) -> list[str]:
        """Pieces of one unit, by backtracking."""
        longest = list(s)
        for end, (back, piece) in self.matches.iter(s):  # by rising end: the last one at a place is the longest
            longest[end - back] = piece
        longest.append("")
        done: list[str] = []
        failed = bytearray(len(longest))
        pairs, shorter = self.pairs, self.shorter
        pos, last, piece = 0, "", longest[0]
        while piece:
            end = pos + len(piece)
            if not failed[end] and (not last or (pairs[last, piece] if (last, piece) in pairs else self.compatible(last, piece))):
                done.append(piece)
                pos, last, piece = end, piece, longest[end]
            elif piece in shorter:
                piece = shorter[piece]
            else:  # no match leads on from here: never come back to this place
                failed[pos] = 1
                piece = done.pop()
                pos -= len(piece)
                last = done[-1] if done else ""
        return done

    def _learn(self, unit: str) -> tuple[int, ...]:
        if len(self.units) > CACHE_UNITS:
            self.older, self.units = self.units, {}
        got = self.older.get(unit)
        if got is None and len(unit) > 2 and unit[-2:] not in self.inside:
            body = unit[:-1]  # punctuation that no piece joins to a word: the word may be known
            if (got := self.units.get(body) or self.older.get(body)) is None:
                got = self.units[body] = self._ids(body)
            got += self._ids(unit[-1])
        if got is None:
            got = self._ids(unit)
        self.units[unit] = got
        return got

    def _ids(self, unit: str) -> tuple[int, ...]:
        out: list[int] = []
        for s in self.unit(unit):
            i = self.id.get(s)
            out += [i] if i is not None else [self.byte_id[b] for b in s.encode()]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """All ids of a whole text."""
        if not text:
            return []
        if "  " in text or SPACE in text or text[0] == " ":
            units = _UNIT.findall(SPACE + text.replace(" ", SPACE))
        else:
            units = (SPACE + text.replace(" ", " " + SPACE)).split(" ")
        get, learn = self.units.get, self._learn
        return list(chain.from_iterable([get(u) or learn(u) for u in units]))

    def decode_utf8(self, ids: list[int]) -> bytes:
        """The decoded text in UTF-8: pieces joined, marks as spaces, without the space put in front."""
        s = "".join(map(self.shown.__getitem__, ids))
        return (s[1:] if s[:1] == " " and ids[0] not in (self.byte_id[32],) else s).encode("utf-8", "surrogateescape")

    def decode(self, ids: list[int]) -> str:
        return self.decode_utf8(ids).decode("utf-8", "replace")


_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_encoders: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _path(model: str) -> str:
    return model if os.path.sep in model else public_tokenizers.path(model)


def encode_pieces(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids array<int>`` of every row. Null text has no ids; rows are kept one to one."""
    schema = T.StructType([field_of(docs, id_col), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(ids, texts):
        enc = piece_encoder(_path(model))
        yield {id_col: ids, "ids": [enc.encode(t or "") for t in texts.to_pylist()]}

    return map_batches(docs, [id_col, text_col], schema, run)


def decode_pieces(encoded: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id, text`` from ``encode_pieces`` or any other ids; null or empty ids give an empty text."""
    schema = T.StructType([field_of(encoded, id_col), T.StructField("text", T.StringType())])

    def run(ids, lists):
        enc = piece_encoder(_path(model))
        yield {id_col: ids, "text": [enc.decode(x) if x else "" for x in lists.to_pylist()]}

    return map_batches(encoded, [id_col, ids_col], schema, run)


def piece_digests(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` of every row: encoded, then decoded from its ids.

    One pass without a shuffle; a worker holds the ids of one text at a time. Null text is empty
    (no ids, digests of the empty string); null and repeated ids keep one row each.
    """
    schema = T.StructType([
        field_of(docs, id_col), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ])

    def run(keys, texts):
        enc = piece_encoder(_path(model))
        n, a, b = [], [], []
        for t in texts:
            ids = enc.encode(t.as_py() or "")
            n.append(len(ids))
            a.append(hashlib.sha256(",".join(map(enc.number.__getitem__, ids)).encode()).hexdigest())
            b.append(hashlib.sha256(enc.decode_utf8(ids)).hexdigest())
        yield {id_col: keys, "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

    return map_batches(docs, [id_col, text_col], schema, run)
