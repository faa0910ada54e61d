"""Token counts of whole texts, by overlap resynchronisation for huge documents."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cached_property

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corrigenda.llm.common import field_of, map_batches

#: Texts longer than this many code points are encoded in overlapping chunks.
CHUNK_CHARS = 65_536
#: First overlap of two chunks, doubled whenever no common boundary is found in it.
OVERLAP_CHARS = 1_024
#: Characters before a chunk's end whose pre-tokens may still change: the look-ahead of the
#: pre-tokenizer (three characters) and the longest special string.
MARGIN_CHARS = 32


class ByteLevelEncoder:
    """Ids of a byte-level BPE.

    Texts longer than ``chunk_chars`` go through ``encode_long``: overlapping chunks with offsets,
    spliced at proven common boundaries. Others are encoded in one piece.
    """

    def __init__(self, path: str, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        self.path, self.chunk_chars, self.overlap = path, chunk_chars, overlap
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t["content"] for t in spec["added_tokens"]]
        self.fast = _same_as_ranks(path, spec)
        self.special = re.compile("|".join(map(re.escape, added))) if added else re.compile("(?!)")
        self.margin = max([MARGIN_CHARS, *(len(s) + 4 for s in added)])

    @cached_property
    def lib(self):
        """The library's tokenizer; loaded where a text needs offsets or holds special strings."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [self._encode_one(t) for t in texts]

    def _encode_one(self, text: str) -> bytes:
        if len(text) > self.chunk_chars:
            return b"".join(map(_pack, self.encode_long(text)))
        if self.fast is None or self.special.search(text):
            return _pack(self.lib.encode(text, add_special_tokens=False).ids)
        return _pack(self.fast.encode_ordinary(text))

    def encode_long(self, text: str) -> Iterator[list[int]]:
        """Ids of a huge text, chunk by chunk.

        A chunk that starts at a true pre-token boundary has true boundaries up to ``margin``
        characters before its end. The next chunk starts at an arbitrary place, but pre-tokens are
        found left to right without look-behind: from any boundary it shares with a proven one, it
        is proven too. If the overlap holds no common boundary it is doubled and both are encoded
        again; at the latest the left chunk then reaches the end of the text.
        """
        n, start, proven = len(text), 0, 0
        overlap = self.overlap
        left = self._words(text, 0, min(n, self.chunk_chars + overlap))
        while True:
            begin = start + self.chunk_chars  # of the next chunk
            end = min(n, begin + overlap)
            if end >= n:
                yield [i for p, ids in left if p >= proven for i in ids]
                return
            right = self._words(text, begin, min(n, begin + self.chunk_chars + self.overlap))
            known = {p for p, _ in left if begin <= p <= end - self.margin and p >= proven}
            common = min((p for p, _ in right if p in known), default=None)
            if common is None:
                overlap *= 2
                left = self._words(text, start, min(n, begin + overlap))
                continue
            yield [i for p, ids in left if proven <= p < common for i in ids]
            start, proven, left, overlap = begin, common, right, self.overlap

    def _words(self, text: str, lo: int, hi: int) -> list[tuple[int, list[int]]]:
        """(start in text, ids) of each pre-token of a chunk."""
        e = self.lib.encode(text[lo:hi], add_special_tokens=False)
        out: list[tuple[int, list[int]]] = []
        last: int | None = -1
        for i, w, (s, _) in zip(e.ids, e.word_ids, e.offsets):
            if w is None or w != last:
                out.append((lo + s, [i]))
            else:
                out[-1][1].append(i)
            last = w
        return out


def _same_as_ranks(path: str, spec: dict):
    """The file's vocabulary as a tiktoken encoding, if its merges are in the order of the ids.

    Both then give the same ids for text without special strings, and this one is several times
    faster. None where the file does not allow it.
    """
    import tiktoken

    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    vocab = model["vocab"]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    shown = [b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)]  # bytes that stand for themselves
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    added = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(map(byte.__getitem__, s)): i for s, i in vocab.items() if s not in added}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _pack(ids: list[int]) -> bytes:
    import array

    return array.array("I", ids).tobytes()


_encoders: dict[tuple, ByteLevelEncoder] = {}


def encoder(path: str, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> ByteLevelEncoder:
    """One encoder per worker process and file."""
    key = (path, chunk_chars, overlap)
    if key not in _encoders:
        _encoders[key] = ByteLevelEncoder(*key)
    return _encoders[key]


def token_counts(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1024,
    chunk_chars: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` of every row, in a single pass without a shuffle.

    ``tokenizer`` names a file of ``public_tokenizers`` or is a path. Null text counts as empty
    (0 bytes, 0 tokens, not over the limit); null and repeated ids keep one row each; other columns
    are not read. A text of any length is encoded whole, in chunks of bounded memory.
    """
    schema = T.StructType([
        field_of(docs, id_col), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()),
    ])

    def count(ids, texts):
        path = tokenizer if os.path.sep in tokenizer else public_tokenizers.path(tokenizer)
        texts = [t or "" for t in texts.to_pylist()]
        n = [len(b) // 4 for b in encoder(path, chunk_chars, overlap).encode(texts)]
        yield {id_col: ids, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [k > limit for k in n]}

    return map_batches(docs, [id_col, text_col], schema, count)
