"""Chinese over characters or words: costs from lexical tables, merging of aligned steps, types, spelling.

What is known about words and characters comes in tables: ``classes(word, code)`` with nested class codes (a
letter, a letter, two digits), ``confusions(char, alike array<string>)`` and ``sounds(char, sounds
array<string>)``. A lexicon of the tokens that occur is made of them; a small one goes to the workers, a larger
one is joined to the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrigenda.functions.text import MISSING, normalized_similarity
from corrigenda.operators.align import Costs, _text_key, align_numbered, numbered, op_name
from corrigenda.operators.extract import IN_ROWS, PAIR, ROWS, in_rows

#: Fixed values; the full stop 。 is not among them.
PUNCTUATION = (
    "！？｡＂＃＄％＆＇（）＊＋，－／：；＜＝＞＠［＼］＾＿｀｛｜｝～｟｠｢｣､、〃》「」『』【】〔〕〖〗〘〙〚〛〜〝〞〟〰〾〿–—‘'‛“”„‟…‧﹏."
    "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    "•・·"
)
#: Categories by the tags of words.
CATEGORIES = {
    "n": "NOUN", "nd": "NOUN", "nh": "NOUN-NE", "ni": "NOUN-NE", "nl": "NOUN-NE", "ns": "NOUN-NE", "nt": "NOUN-NE", "nz": "NOUN-NE",
    "v": "VERB", "a": "ADJ", "b": "ADJ", "c": "CONJ", "r": "PRON", "d": "ADV", "u": "AUX", "m": "NUM", "p": "PERP", "q": "QUAN", "wp": "PUNCT",
}
#: Tokens of a lexicon that may go to the workers.
SMALL = 200_000
#: A token of the lexicon: class code, sounds, and for each of its characters those that are taken for it.
ENTRY = "struct<code:string,sounds:array<string>,alike:array<array<string>>>"
SPANS = "system_id string, sample_id bigint, side string, target_id int, src_start int, src_end int, tgt_start int, tgt_end int, ops string, edit_no int"


def lexicon(pairs: DataFrame, classes: DataFrame | None = None, confusions: DataFrame | None = None, sounds: DataFrame | None = None) -> DataFrame:
    """``token, entry`` (ENTRY) for every token of ``pairs`` that one of the tables knows."""
    tokens = pairs.select(F.explode("src_tokens").alias("token")).unionByName(pairs.select(F.explode("tgt_tokens").alias("token"))).distinct()
    spark = pairs.sparkSession
    classes = spark.createDataFrame([], "word string, code string") if classes is None else classes
    confusions = spark.createDataFrame([], "char string, alike array<string>") if confusions is None else confusions
    sounds = spark.createDataFrame([], "char string, sounds array<string>") if sounds is None else sounds
    each = tokens.select("token", F.posexplode(F.filter(F.split("token", ""), lambda c: c != "")).alias("at", "char"))
    known = each.join(confusions.select("char", "alike"), "char", "left").join(sounds.select("char", "sounds"), "char", "left")
    none = F.array().cast("array<string>")
    by_token = known.groupBy("token").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("alike", none).alias("a")))), lambda x: x["a"]).alias("alike"),
        F.array_distinct(F.flatten(F.collect_list(F.coalesce("sounds", none)))).alias("sounds"),
    )
    code = classes.groupBy(F.col("word").alias("token")).agg(F.min("code").alias("code"))
    out = by_token.join(code, "token", "left")
    useful = F.col("code").isNotNull() | (F.size("sounds") > 0) | F.exists("alike", lambda a: F.size(a) > 0)
    return out.where(useful).select("token", F.struct("code", F.array_sort("sounds").alias("sounds"), "alike").alias("entry"))


def _is_chinese(text: str) -> bool:
    return all("一" <= c <= "鿿" for c in text)


class TokenCosts(Costs):
    """Costs for tokens (text, tag, class code, sounds, characters taken for each of its own)."""

    words = False

    def __init__(self, vocabulary: Sequence[tuple]) -> None:
        self.tokens = list(vocabulary)
        self.tag = numbered([t[1] for t in vocabulary])[1]
        self.mark = np.array([t[0] in PUNCTUATION for t in vocabulary], bool)
        self.levels = [np.where([t[2] is not None for t in vocabulary], numbered([t[2] and t[2][k] for t in vocabulary])[1], -1) for k in (slice(0, 1), slice(1, 2), slice(2, 4))]
        self.spelled: dict[tuple[int, int], float] = {}

    def _meaning(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """By class: 4 where one is unknown, else 2 for each of three levels that differs; of 6."""
        unknown = (self.levels[0][a] < 0) | (self.levels[0][b] < 0)
        differ = sum((x[a] != x[b]).astype(np.int64) for x in self.levels)
        return np.where(unknown, 4, 2 * differ) / 6.0

    def _kind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """By tag for words; for characters by whether both, one or none is a punctuation mark."""
        if self.words:
            return np.where(self.tag[a] == self.tag[b], 0.0, 0.499)
        return np.where(self.mark[a] & self.mark[b], 0.0, np.where(self.mark[a] | self.mark[b], 0.499, 0.25))

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._meaning(a, b) + self._kind(a, b) - 1e-9  # sums in another order may be smaller

    def cost(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = len(self.tokens)
        keys, at = np.unique(a * n + b, return_inverse=True)
        spell = np.fromiter((self._spelling(*divmod(k, n)) for k in keys.tolist()), np.float64, len(keys))[at]
        if self.words:
            return self._meaning(a, b) + self._kind(a, b) + spell
        return self._meaning(a, b) + spell + self._kind(a, b)

    def _spelling(self, a: int, b: int) -> float:
        """The share of the shorter token's characters that no character of the other is like, halved."""
        if (a, b) not in self.spelled:
            x, y = self.tokens[a], self.tokens[b]
            if not (_is_chinese(x[0]) and _is_chinese(y[0])):
                out = 0.5
            elif x[0] == y[0] or not x[0] or not y[0]:
                out = 0.0
            else:
                if len(x[0]) > len(y[0]):
                    x, y = y, x
                heard = not set(x[3]).isdisjoint(y[3])
                like = sum(heard or any(c == d or c in _at(y[4], k) or d in _at(x[4], i) for k, d in enumerate(y[0])) for i, c in enumerate(x[0]))
                out = (len(x[0]) - like) / (len(x[0]) * 2)
            self.spelled[a, b] = out
        return self.spelled[a, b]


class WordCosts(TokenCosts):
    words = True


def _at(alike: tuple, k: int) -> tuple:
    return alike[k] if k < len(alike) else ()


def _distance(a: str, b: str) -> int:
    """Edit distance, which is asked for only up to 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 1:
        return 2
    short, long = sorted((a, b), key=len)
    k = next((i for i, c in enumerate(short) if c != long[i]), len(short))
    return 1 if short[k + (len(a) == len(b)) :] == long[k + 1 :] else 2


Step = tuple[str, int, int, int, int]


def _runs(steps: Sequence[Step], words: bool) -> list[Step]:
    """Matches in one; reorderings alone; runs of other steps in one, unless they only delete and insert, or replace words."""
    out: list[Step] = []
    at = 0
    while at < len(steps):
        kind = steps[at][0][0]
        group = kind if kind in "MT" else "DIS"
        end = at + 1
        while end < len(steps) and group != "T" and steps[end][0][0] in group:
            end += 1
        part = steps[at:end]
        ops = {s[0][0] for s in part}
        if len(part) == 1 or ops == {"D", "I"} or (words and ops == {"S"}):
            out += part
        else:
            out.append((ops.pop() if len(ops) == 1 else "S", part[0][1], part[-1][2], part[0][3], part[-1][4]))
        at = end
    return out


def _exchanged(one: tuple[str, str], other: tuple[str, str]) -> bool:
    """Whether two replacements put each other's text in their place; a slip of one character is allowed where no side is a single one."""
    slack = 0 if min(map(len, (*one, *other))) == 1 else 1
    return _distance(one[0], other[1]) <= slack and _distance(one[1], other[0]) <= slack


def _carried(gone: str, come: str) -> bool:
    """Whether what is deleted here is inserted there: the same, a slip of one character, or turned round."""
    long, short = sorted((gone, come), key=len, reverse=True)
    if long in PUNCTUATION or short in PUNCTUATION or len(long) - len(short) > 1:
        return False
    if len(short) == 1:
        return long == short
    return _distance(long, short) <= 1 or (len(long) == len(short) and short in long + long)


def _folded(parts: list[Step], text: Callable[[Step], tuple[str, str]]) -> Iterator[Step]:
    """Three parts that move a text become one reordering, from left to right; matches go."""
    at = 0
    while at < len(parts):
        kinds = "".join(p[0][0] for p in parts[at : at + 3])
        moved = False
        if kinds == "SMS":
            moved = _exchanged(text(parts[at]), text(parts[at + 2]))
        elif kinds in ("DMI", "DTI"):
            moved = _carried(text(parts[at])[0], text(parts[at + 2])[1])
        elif kinds in ("IMD", "ITD"):
            moved = _carried(text(parts[at + 2])[0], text(parts[at])[1])
        if moved:
            a, b = parts[at], parts[at + 2]
            yield f"T{b[2] - a[1]}", a[1], b[2], a[3], b[4]
        elif kinds[0] != "M":
            yield parts[at]
        at += 3 if moved else 1


def _common_ends(src: Sequence[str], tgt: Sequence[str], whole: str) -> tuple[int, int]:
    """How many tokens at the beginning of both sides make the same text: the longest run of ``src`` that ``whole`` begins with, if ``tgt`` has a border there."""
    n = size = 0
    while n < len(src) and whole.startswith(src[n], size):
        size += len(src[n])
        n += 1
    m = 0
    while size > 0 and m < len(tgt):
        size -= len(tgt[m])
        m += 1
    return (n, m) if n and m and size == 0 else (0, 0)


def _trimmed(p: Step, src: Sequence[str], tgt: Sequence[str]) -> Step:
    """A replacement without what both sides begin and end with; nothing left of one side makes it a deletion or an insertion."""
    _, a, b, c, d = p
    whole = "".join(tgt[c:d])
    n, m = _common_ends(src[a:b], tgt[c:d], whole)
    a, c = a + n, c + m
    back = [t[::-1] for t in reversed(src[a:b])], [t[::-1] for t in reversed(tgt[c:d])]
    x, y = _common_ends(*back, whole[::-1])
    b, d = b - x, d - y
    return ("I" if a == b else "D" if c == d else "S"), a, b, c, d


def merged(steps: Sequence[Step], src: Sequence[str], tgt: Sequence[str], words: bool = False, heuristic: bool = True) -> list[Step]:
    """Edits from the steps of one pair: runs, moved texts, trimmed replacements; what changes no text goes.

    Without ``heuristic`` the runs alone, without matches.
    """
    text = lambda p: ("".join(src[p[1] : p[2]]), "".join(tgt[p[3] : p[4]]))
    parts = _runs(steps, words)
    if not heuristic:
        return [p for p in parts if p[0] != "M"]
    changed = (p for p in _folded(parts, text) if text(p)[0] != text(p)[1])
    return [_trimmed(p, src, tgt) if p[0] == "S" else p for p in changed]


@dataclass(frozen=True)
class Entries:
    """The entry of a token from codes by word, and rows of alike characters and of sounds by character."""

    code: dict[str, str]
    alike: dict[str, list[tuple]]
    sounds: dict[str, list[tuple]]

    def __call__(self, token: str) -> tuple:
        own = [(sorted(self.alike.get(c, [()])), self.sounds.get(c, [()])) for c in token]
        heard = sorted({x for _, s in own for values in s for x in values})
        return self.code.get(token), tuple(heard), tuple(x for a, s in own for x in a for _ in s)


@dataclass(frozen=True)
class Looked:
    """The entry of a token from a lexicon."""

    table: dict[str, tuple]

    def __call__(self, token: str) -> tuple:
        return self.table.get(token, NOTHING)


@dataclass(frozen=True)
class Lexical:
    """The tables of ``lexicon``, before any token is looked up."""

    classes: DataFrame | None = None
    confusions: DataFrame | None = None
    sounds: DataFrame | None = None

    def lookup(self) -> Callable[[str], tuple] | None:
        """The entry of a token, where no table has more than SMALL rows: what ``lexicon`` has of it, without a look at the pairs."""
        rows = []
        for table, key, value in ((self.classes, "word", "code"), (self.confusions, "char", "alike"), (self.sounds, "char", "sounds")):
            if table is not None and value == "code":
                table = table.groupBy(key).agg(F.min(value).alias(value))
            rows.append([] if table is None else table.select(key, value).limit(SMALL + 1).collect())
        if max(map(len, rows)) > SMALL:
            return None
        code = dict(map(tuple, rows[0]))
        alike, sounds = {}, {}
        for known, found in zip((alike, sounds), rows[1:]):
            for char, values in found:
                known.setdefault(char, []).append(tuple(values or ()))

        return Entries(code, alike, sounds)


def _vocabulary(part: pa.RecordBatch, entry: Callable[[str], tuple]) -> tuple[list[tuple], list[tuple[np.ndarray, np.ndarray]]]:
    """The different tokens (text, tag, and what is known of the text) of the pairs, and of each pair their numbers."""
    columns = [part.column("src_tokens"), part.column("tgt_tokens")]
    coded = pa.concat_arrays([c.flatten() for c in columns]).dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in columns]).astype(np.int64)
    tags = [t for side in ("src_tags", "tgt_tags") for t in part.column(side).to_pylist()]
    known = [(t, *entry(t)) for t in coded.dictionary.to_pylist()]
    if any(tags):
        flat = [x for own, n in zip(tags, size.tolist()) for x in (own or ["unk"] * n)]
        seen, number = numbered(list(zip(number.tolist(), flat)))
        vocabulary = [(known[k][0], tag, *known[k][1:]) for k, tag in seen]
    else:
        vocabulary = [(k[0], "unk", *k[1:]) for k in known]
    cuts = [number[e - n : e] for e, n in zip(np.cumsum(size).tolist(), size.tolist())]
    return vocabulary, list(zip(cuts[: part.num_rows], cuts[part.num_rows :]))


def _merged_rows(vocabulary: list[tuple], numbers: list[tuple[np.ndarray, np.ndarray]], words: bool, heuristic: bool) -> list[tuple]:
    """(row, s0, s1, t0, t1, kind, number of the edit) of every edit."""
    texts = [t[0] for t in vocabulary]
    out = []
    for k, (cols, (s, t)) in enumerate(zip(align_numbered(vocabulary, numbers, WordCosts if words else TokenCosts, _text_key), numbers)):
        steps = [(op_name(kind), *x) for kind, *x in zip(*(c.tolist() for c in cols))]
        for no, p in enumerate(merged(steps, [texts[x] for x in s.tolist()], [texts[x] for x in t.tolist()], words, heuristic)):
            out.append((k, *p[1:], p[0], no))
    return out


def _with_tags(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({c: F.lit(None).cast("array<string>") for c in ("src_tags", "tgt_tags") if c not in pairs.columns})


def merge_chinese(pairs: DataFrame, lex: DataFrame | Lexical, words: bool = False, heuristic: bool = True) -> DataFrame:
    """Edit spans (SPANS; ``ops`` is the kind of the edit) of ``src_tokens, tgt_tokens`` and, optionally, ``src_tags, tgt_tags``.

    ``lex`` has ``token, entry``: up to SMALL tokens it goes to the workers, else it is joined to the
    tokens of the pairs. Tables of up to SMALL rows (``Lexical``) go to the workers as they are. Identical pairs have no edits.
    """
    todo = _with_tags(pairs.where(F.col("src_tokens") != F.col("tgt_tokens")))
    columns = ["src_tokens", "tgt_tokens", "src_tags", "tgt_tags"]
    entry = None
    if isinstance(lex, Lexical):
        entry = lex.lookup()
        lex = None if entry else lexicon(pairs, lex.classes, lex.confusions, lex.sounds)
    if entry is None:
        rows = lex.limit(SMALL + 1).collect()
        if len(rows) <= SMALL:
            entry = Looked({r.token: _entry(r.entry) for r in rows})
    given = pairs.sparkSession.sparkContext.broadcast(entry) if entry else None
    if not entry:
        for side in ("src", "tgt"):
            each = todo.select(*PAIR, F.posexplode(f"{side}_tokens").alias("at", "token")).join(lex, "token", "left")
            known = each.groupBy(*PAIR).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "entry"))), lambda x: x["entry"]).alias(f"{side}_known"))
            todo = todo.join(known, PAIR, "left")
        columns += ["src_known", "tgt_known"]

    def read(texts: list[str], tags: list[str] | None, known: list | None) -> list[tuple]:
        return [(t, g, *_entry(e)) for t, g, e in zip(texts, tags or ["unk"] * len(texts), known or [None] * len(texts))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                if given is not None:
                    vocabulary, numbers = _vocabulary(part, given.value)
                else:
                    sides = [side for r in zip(*(c.to_pylist() for c in part.columns[len(PAIR) :])) for side in (read(r[0], r[2], r[4]), read(r[1], r[3], r[5]))]
                    vocabulary, number = numbered([t for side in sides for t in side])
                    cuts = [number[e - n : e] for n, e in zip(map(len, sides), np.cumsum([len(side) for side in sides], dtype=np.int64).tolist())]
                    numbers = list(zip(cuts[::2], cuts[1::2]))
                owner, *cols = zip(*rows) if (rows := _merged_rows(vocabulary, numbers, words, heuristic)) else [()] * 7
                kinds = [pa.int32()] * 4 + [pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(owner, pa.int64())) for k in range(len(PAIR))), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[*PAIR, "src_start", "src_end", "tgt_start", "tgt_end", "ops", "edit_no"])

    return todo.select(*PAIR, *columns).mapInArrow(run, SPANS)


def edits_in_rows(pairs: DataFrame, tables: Lexical, words: bool = False, heuristic: bool = True) -> DataFrame:
    """``PAIR, src_tokens, edits`` (IN_ROWS): each pair with the edits of ``merge_chinese`` in order, identical pairs with none, in one pass.

    Where a table has more than SMALL rows, the spans are joined to their pairs.
    """
    entry = tables.lookup()
    if entry is None:
        spans = merge_chinese(pairs, tables, words, heuristic)
        e = chinese_edits(pairs, spans).drop("types").join(spans.select(*PAIR, "edit_no", "ops"), [*PAIR, "edit_no"])
        own = e.groupBy(*PAIR).agg(F.sort_array(F.collect_list(F.struct("edit_no", "src_start", "src_end", "tgt_start", "tgt_end", "src_tokens", "tgt_tokens", "ops"))).alias("edits"))
        none = F.array().cast(own.schema["edits"].dataType)
        return pairs.select(*PAIR, "src_tokens").join(own, PAIR, "left").withColumn("edits", F.coalesce("edits", none))
    given = pairs.sparkSession.sparkContext.broadcast(entry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                whole = batch.slice(lo, ROWS)
                changed = np.flatnonzero(whole.column("_changed").fill_null(False).to_numpy(zero_copy_only=False))
                part = whole.take(pa.array(changed))
                row, s0, s1, t0, t1, ops, number = zip(*rows) if (rows := _merged_rows(*_vocabulary(part, given.value), words, heuristic)) else [()] * 7
                yield in_rows(whole, part, changed, *(np.array(c, np.int64) for c in (row, number, s0, s1, t0, t1)), ops)

    wanted = [*PAIR, "src_tokens", "tgt_tokens", "src_tags", "tgt_tags", (F.col("src_tokens") != F.col("tgt_tokens")).alias("_changed")]
    return _with_tags(pairs).select(*wanted).mapInArrow(run, IN_ROWS)


NOTHING: tuple = (None, (), ())


def _entry(e) -> tuple:
    return NOTHING if e is None else (e["code"], tuple(e["sounds"] or ()), tuple(tuple(a) for a in e["alike"] or ()))


def chinese_edits(pairs: DataFrame, spans: DataFrame) -> DataFrame:
    """Edit rows with tokens and a type: T, U, M or S over characters; with ``src_tags, tgt_tags`` in ``pairs`` the category of a single character too."""
    tagged = "src_tags" in pairs.columns
    j = spans.join(pairs.select(*PAIR, F.col("src_tokens").alias("_s"), F.col("tgt_tokens").alias("_t"), *([F.col("src_tags").alias("_x"), F.col("tgt_tags").alias("_y")] if tagged else [])), PAIR)
    src = F.slice("_s", F.col("src_start") + 1, F.col("src_end") - F.col("src_start"))
    tgt = F.slice("_t", F.col("tgt_start") + 1, F.col("tgt_end") - F.col("tgt_start"))
    kind = F.substring("ops", 1, 1)
    label = F.when(kind == "D", "U").when(kind == "I", "M").otherwise(kind)
    if tagged:
        label = word_type(kind, src, tgt, F.try_element_at("_x", F.col("src_start") + 1), F.try_element_at("_y", F.col("tgt_start") + 1))
    return j.select(*PAIR, "edit_no", "src_start", "src_end", "tgt_start", "tgt_end", src.alias("src_tokens"), tgt.alias("tgt_tokens"), F.array(label).alias("types"))


def word_type(kind: Column, src: Column, tgt: Column, src_tag: Column, tgt_tag: Column, misspelled: Column | None = None) -> Column:
    """Type of an edit over words. Longer texts are OTHER; a replacement that is ``misspelled`` is SPELL, by default one with the same characters in another order."""
    table = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in ("NOUN" if v == "NOUN-NE" else v for v in kv)])
    a, b = F.array_join(src, " "), F.array_join(tgt, " ")
    category = lambda tag: F.when(b == MISSING, "MC").otherwise(F.coalesce(F.try_element_at(table, tag), F.lit("OTHER")))
    if misspelled is None:
        x, y = F.array_join(src, ""), F.array_join(tgt, "")
        misspelled = (F.length(x) == F.length(y)) & (F.array_sort(F.split(x, "")) == F.array_sort(F.split(y, "")))
    return (
        F.when(kind == "T", "T")
        .when(kind == "D", F.when(F.length(a) > 1, "R:OTHER").otherwise(F.concat(F.lit("U:"), category(src_tag))))
        .when(kind == "I", F.when((F.length(b) > 1) & (b != MISSING), "M:OTHER").otherwise(F.concat(F.lit("M:"), category(tgt_tag))))
        .otherwise(F.when(misspelled, "S:SPELL").when((F.length(b) > 1) & (b != MISSING), "S:OTHER").otherwise(F.concat(F.lit("S:"), category(tgt_tag))))
    )


def sound_similarity(a: Column, b: Column) -> Column:
    """The largest likeness of any two sounds of two characters; 0 without sounds."""
    best = F.array_max(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: normalized_similarity(x, y)))))
    return F.coalesce(best, F.lit(0.0))


def spelling_errors(pairs: DataFrame, characters: DataFrame, keys: list[str], threshold: float = 0.8) -> DataFrame:
    """``keys, likeness, misspelled`` for texts ``a, b`` of ``pairs``: whether b is a spelling of a.

    They have one length, and either the same characters in another order, or each two characters that differ
    stand in ``characters(char, shape, sounds)`` and are like one another: likeness of shapes and sounds together
    reach ``threshold``, or they share a sound. ``likeness`` is the least of any place, null if there is none to look at.
    """
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    same_length = F.length("a") == F.length("b")
    turned = F.array_sort(chars("a")) == F.array_sort(chars("b"))
    known = characters.groupBy("char").agg(F.min("shape").alias("shape"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sounds")))).alias("sounds"))
    todo = pairs.where(same_length & ~turned)
    each = todo.select(*keys, F.explode(F.filter(F.arrays_zip(chars("a").alias("x"), chars("b").alias("y")), lambda p: p["x"] != p["y"])).alias("p")).select(*keys, "p.x", "p.y")
    # a pair of characters is looked up once, however many texts have it
    both = each.select("x", "y").distinct()
    one, two = (known.select(F.col("char").alias(c), F.col("shape").alias(f"shape_{c}"), F.col("sounds").alias(f"sounds_{c}")) for c in "xy")
    looked = both.join(one, "x").join(two, "y")
    shape = normalized_similarity(F.col("shape_x"), F.col("shape_y"))
    sure = F.arrays_overlap("sounds_x", "sounds_y")
    looked = looked.select("x", "y", (shape + sound_similarity(F.col("sounds_x"), F.col("sounds_y"))).alias("like"), F.coalesce(sure, F.lit(False)).alias("heard"))
    found = each.join(looked, ["x", "y"], "left").groupBy(*keys).agg(
        F.min("like").alias("likeness"), F.coalesce(F.every(F.coalesce((F.col("like") >= threshold) | F.col("heard"), F.lit(False))), F.lit(False)).alias("misspelled")
    )
    rest = pairs.where(~same_length | turned).select(*keys, F.lit(None).cast("double").alias("likeness"), (same_length & turned).alias("misspelled"))
    return found.unionByName(rest)
