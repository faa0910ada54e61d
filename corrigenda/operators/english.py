"""English over annotated tokens: which aligned steps make one edit, and the category of an edit.

Annotations come with the data, as arrays of ``TOKEN`` (``src_ann``, ``tgt_ann``): coarse part of speech, Penn
tag, dependency label, and the index of the token it depends on (its own for a root).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrigenda.operators.align import align_numbered, op_name
from corrigenda.operators.extract import PAIR, ROWS, WordCosts, _trimmed, indel_distance, operation, slices

TOKEN = "struct<text:string,lemma:string,pos:string,tag:string,dep:string,head:int>"
SPANS = "system_id string, sample_id bigint, side string, target_id int, src_start int, src_end int, tgt_start int, tgt_end int, ops string, edit_no int"
IN_ROWS = (
    "system_id string, sample_id bigint, side string, target_id int, src_tokens array<string>, edits array<struct<edit_no:int,src_start:int,src_end:int,"
    f"tgt_start:int,tgt_end:int,src_tokens:array<string>,tgt_tokens:array<string>,aux:boolean,a:array<{TOKEN}>,b:array<{TOKEN}>>>"
)

# Penn tags by the category they are reported as.
TAGS = {
    "ADJ": ("AFX", "JJ", "JJR", "JJS"),
    "ADV": ("RB", "RBR", "RBS", "WRB"),
    "CONJ": ("CC",),
    "DET": ("DT", "PDT", "PRP$", "WDT", "WP$"),
    "INTJ": ("UH",),
    "NOUN": ("NN", "NNP", "NNPS", "NNS"),
    "NUM": ("CD",),
    "PART": ("POS", "RP", "TO"),
    "PREP": ("IN",),
    "PRON": ("EX", "PRP", "WP"),
    "PUNCT": ("''", ",", "-LRB-", "-RRB-", ".", ":", "HYPH", "``", '""'),
    "SPACE": ("SP", "_SP"),
    "SYM": ("#", "$", "SYM"),
    "VERB": ("BES", "HVS", "MD", "VB", "VBD", "VBG", "VBN", "VBP", "VBZ"),
    "X": ("ADD", "FW", "GW", "LS", "NFP", "NIL", "XX"),
}
DEPENDENCIES = {"acomp": "ADJ", "amod": "ADJ", "advmod": "ADV", "det": "DET", "prep": "PREP", "prt": "PART", "punct": "PUNCT"}
CONTRACTIONS = ("'d", "'ll", "'m", "n't", "'re", "'s", "'ve")
SHORT_AUXILIARIES = {"ca": "can", "sha": "shall", "wo": "will"}
RARE = ("INTJ", "NUM", "SYM", "X")
INFLECTED = ("ADJ", "ADV", "NOUN", "VERB")
CONTENT = {"ADJ", "ADV", "AUX", "NOUN", "VERB"}
VERBAL = {"AUX", "PART", "VERB"}
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words that are told apart by themselves: source, target, whether also the other way round, category (None: the target's).
WORD_PAIRS = (
    ("the", "that", False, "PRON"), ("all", "everything", False, "PRON"), ("that", "what", True, "PRON"), ("good", "well", True, None),
    ("after", "later", True, None), ("therefor", "therefore", False, "SPELL"), ("though", "thought", True, "SPELL"),
)
#: By length of the source word: lengths of the target word, similarity (from, to), category (None: the target's).
ANY = (0.0, 1.0)
BY_LENGTH = (
    (1, 2, 2, (0.5, 0.5), "SPELL"), (2, 2, 3, (0.5, 1.0), "SPELL"), (3, 2, 4, (0.5, 1.0), "SPELL"),
    (4, 3, 3, (0.500001, 1.0), "SPELL"), (4, 4, 4, (0.5, 1.0), "SPELL"), (4, 5, 5, (0.8, 0.8), "SPELL"), (4, 6, None, (0.500001, 1.0), None),
    (5, 4, 4, (0.8, 0.8), "SPELL"), (5, 5, 5, (0.6, 1.0), "SPELL"), (5, 6, None, ANY, None),
)


class Token(NamedTuple):
    text: str
    lemma: str
    pos: str
    tag: str


def _solid(tokens: list[Token]) -> str:
    return "".join(t.text.lower() for t in tokens).replace("'", "").replace("-", "")


def _like(a: Token, b: Token) -> bool:
    return 1 - indel_distance(a.text, b.text) > 0.75


def _cut(i: int, j: int, ops: str, s: list[Token], t: list[Token]) -> tuple[int, int] | None:
    """What the window of steps i to j, with tokens s and t, says about its run ``ops``.

    (a, b): steps from a to before b are one edit, those around it are looked at anew; a == b only
    parts the run there. None: nothing.
    """
    first, last, sides = (s[0], t[0]), (s[-1], t[-1]), (s, t)
    pair, window, part = (j - 1, j + 1), (i, j + 1), (i + 1, i + 1)
    if i == 0 and "POS" in [x.tag for x in first]:
        return 0, 1
    if "POS" in [x.tag for x in last]:
        return pair
    if last[0].text.lower() == last[1].text.lower():
        if i == 0 and any(len(x) == 1 and y[0].text[:1].isupper() for x, y in (sides, sides[::-1])):
            return window
        if any(len(x) > 1 and (x[-2].pos == "PUNCT" or x[-2].text in PUNCTUATION) for x in sides):
            return pair
    kinds = {x.pos for side in sides for x in side}
    if _solid(s) == _solid(t) or (len(s) != len(t) and (len(kinds) == 1 or kinds <= VERBAL)):
        return window
    if j == i + 1:
        if len(s) == len(t) == 2 or (ops[i] == "S" and _like(*first)) or (ops[j] == "S" and _like(*last)):
            return part
        if j == len(ops) - 1 and any(ops[j] in (op, "S") and x.pos == "DET" for op, x in zip("DI", last)):
            return j, j + 1
    return None


def merged(steps: list[tuple[str, int, int, int, int]], src: list[Token], tgt: list[Token]) -> list[tuple[int, int]]:
    """(first step, step behind) of every edit; a reordering is one by itself, matches are none.

    A run of other steps is one edit if it only deletes or only inserts. Else its windows with a
    replacement are tried, widest first, until one decides; undecided runs are one edit if such a
    window has a content word, and an edit per step if not.
    """
    todo, out, begin = [], [], None
    for k, op in enumerate([*(s[0][0] for s in steps), "M"]):
        if op in "MT":
            if begin is not None:
                todo.append((begin, k))
            begin = None
            if op == "T":
                out.append((k, k + 1))
        elif begin is None:
            begin = k
    while todo:
        a, b = todo.pop()
        n, ops = b - a, "".join(s[0][0] for s in steps[a:b])
        if n < 2 or ops in ("D" * n, "I" * n):
            out += [(a, b)] * (n > 0)
            continue
        content = False
        for i, j in ((i, i + w) for w in range(n - 1, 0, -1) for i in range(n - w)):
            if "S" not in ops[i : j + 1]:
                continue
            s, t = src[steps[a + i][1] : steps[a + j][2]], tgt[steps[a + i][3] : steps[a + j][4]]
            cut = _cut(i, j, ops, s, t)
            if cut:
                x, y = a + cut[0], a + cut[1]
                out += [(x, y)] * (y > x)
                todo += [(a, x), (y, b)]
                break
            content = content or any(x.pos in CONTENT for x in (*s, *t))
        else:
            out += [(a, b)] if content else [(k, k + 1) for k in range(a, b)]
    return sorted(out)


def _fields(column: pa.ListArray) -> dict[str, pa.Array]:
    flat = column.flatten()
    return dict(zip((f.name for f in flat.type), flat.flatten()))


def _numbered(part: pa.RecordBatch) -> tuple[list[Token], list[tuple[list[int], list[int]]]]:
    """The different tokens of the annotated pairs, and of each pair their numbers."""
    columns = [part.column("src_ann"), part.column("tgt_ann")]
    sides = [_fields(c) for c in columns]
    key = np.zeros(len(sides[0]["text"]) + len(sides[1]["text"]), np.int64)
    for name in Token._fields:
        coded = pa.concat_arrays([side[name] for side in sides]).dictionary_encode(null_encoding="encode")
        # numbers of what came so far stay small, however many fields there are
        key = np.unique(key * max(len(coded.dictionary), 1) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    first = pa.array(np.unique(key, return_index=True)[1])
    vocabulary = list(map(Token, *(pa.concat_arrays([side[name] for side in sides]).take(first).to_pylist() for name in Token._fields)))
    size = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in columns]).astype(np.int64)
    cuts = [key[e - n : e] for e, n in zip(np.cumsum(size).tolist(), size.tolist())]
    return vocabulary, list(zip(cuts[: part.num_rows], cuts[part.num_rows :]))


def _merged_steps(part: pa.RecordBatch) -> list[tuple[int, int, int, int, int, str, int]]:
    """(row, s0, s1, t0, t1, ops, number of the edit) of every edit of the pairs."""
    vocabulary, numbers = _numbered(part)
    rows = []
    for k, (columns, (src, tgt)) in enumerate(zip(align_numbered(vocabulary, numbers, WordCosts), numbers)):
        steps = [(op_name(kind), *x) for kind, *x in zip(*(c.tolist() for c in columns))]
        src, tgt = ([vocabulary[n] for n in side.tolist()] for side in (src, tgt))
        for no, (a, b) in enumerate(merged(steps, src, tgt)):
            rows.append((k, steps[a][1], steps[b - 1][2], steps[a][3], steps[b - 1][4], "".join(s[0][0] for s in steps[a:b]), no))
    return rows


def merge_annotated(pairs: DataFrame) -> DataFrame:
    """Edit spans of pairs with ``src_ann, tgt_ann``: pairs are aligned many at a time, and merged in the same pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                owner, *cols = zip(*rows) if (rows := _merged_steps(part)) else [()] * 7
                kinds = [pa.int32()] * 4 + [pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(owner, pa.int64())) for k in range(len(PAIR))), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[*PAIR, "src_start", "src_end", "tgt_start", "tgt_end", "ops", "edit_no"])

    text = lambda c: F.transform(c, lambda t: t["text"])
    return pairs.where(text("src_ann") != text("tgt_ann")).select(*PAIR, "src_ann", "tgt_ann").mapInArrow(run, SPANS)


def _helped(src: list[dict], s0: int, tgt: list[dict], t0: int) -> bool:
    """``_auxiliary_before`` of one edit."""
    is_aux = lambda t: t["dep"] is not None and t["dep"].startswith("aux")
    helpers = lambda sent, head: [t for i, t in enumerate(sent) if head is not None and t["head"] == head != i and is_aux(t)]
    places = ((src, s0), (tgt, t0))
    if all(i < len(sent) and is_aux(sent[i]) for sent, i in places):
        texts = [(next((t["text"] for t in helpers(sent, sent[i]["head"])), None), sent[i]["text"]) for sent, i in places]
        return all(a is not None and b is not None and a != b for a, b in texts)
    return all(any(t["dep"] in ("aux", "auxpass") for t in helpers(sent, i)) for sent, i in places)


def edits_in_rows(pairs: DataFrame) -> DataFrame:
    """``PAIR, src_tokens, edits``: each pair (``src_tokens, src_ann, tgt_ann``) with its merged edits in order, identical pairs with none.

    Where both sides are equal their annotations may be null. An edit has the annotated tokens of both sides,
    ``a, b``, and whether auxiliaries stand before it, so that its category needs no other row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                whole = batch.slice(lo, ROWS)
                changed = np.flatnonzero(whole.column("_changed").fill_null(False).to_numpy(zero_copy_only=False))
                part = whole.take(pa.array(changed))
                row, s0, s1, t0, t1, _, number = zip(*rows) if (rows := _merged_steps(part)) else [()] * 7
                row, s0, s1, t0, t1 = (np.array(c, np.int64) for c in (row, s0, s1, t0, t1))
                texts, tokens, helped = [], [], [False] * len(row)
                for side, a, b in (("src", s0, s1), ("tgt", t0, t1)):
                    column = part.column(f"{side}_ann")
                    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                    tokens.append(slices(column.flatten(), (np.cumsum(size) - size)[row] + a, b - a))
                    texts.append(pa.ListArray.from_arrays(tokens[-1].offsets, _fields(tokens[-1])["text"]))
                deps = [_fields(part.column(f"{side}_ann"))["dep"].unique().to_pylist() for side in ("src", "tgt")]
                if all(any(d is not None and d.startswith("aux") for d in side) for side in deps):
                    sent = [part.column(f"{side}_ann").to_pylist() for side in ("src", "tgt")]
                    helped = [_helped(sent[0][k], a, sent[1][k], c) for k, a, c in zip(row.tolist(), s0.tolist(), t0.tolist())]
                edits = pa.StructArray.from_arrays(
                    [*(pa.array(c, pa.int32()) for c in (number, s0, s1, t0, t1)), *texts, pa.array(helped, pa.bool_()), *tokens],
                    ["edit_no", "src_start", "src_end", "tgt_start", "tgt_end", "src_tokens", "tgt_tokens", "aux", "a", "b"],
                )
                ends = np.cumsum(np.bincount(changed[row], minlength=whole.num_rows))
                yield pa.RecordBatch.from_arrays([*(whole.column(c) for c in (*PAIR, "src_tokens")), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), edits)], names=[*PAIR, "src_tokens", "edits"])

    return pairs.select(*PAIR, "src_tokens", "src_ann", "tgt_ann", (F.col("src_ann.text") != F.col("tgt_ann.text")).alias("_changed")).mapInArrow(run, IN_ROWS)


def _first(rules: list[tuple[Column, Column | str]], otherwise: str) -> Column:
    out = F
    for condition, label in rules:
        out = out.when(condition, label)
    return out.otherwise(otherwise)


def _only(values: Column, *allowed: str) -> Column:
    return F.forall(values, lambda x: x.isin(*allowed))


def _exactly(values: Column, *wanted: str) -> Column:
    found = _only(values, *wanted)
    for w in wanted:
        found = found & F.array_contains(values, w)
    return found


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _single(values: Column) -> Column:
    """The one value all have, else null."""
    d = F.array_distinct(values)
    return F.when(F.size(d) == 1, F.try_element_at(d, F.lit(1)))


def _auxiliary_before(src: Column, s0: Column, tgt: Column, t0: Column) -> Column:
    """Whether an auxiliary stands before the tokens at s0 and t0 of both sentences."""

    def helpers(sent: Column, head: Column) -> Column:
        return F.filter(sent, lambda t, i: (t["head"] == head) & (i != head) & t["dep"].startswith("aux"))

    def at(sent: Column, i: Column) -> Column:
        return F.try_element_at(sent, i + 1)

    def later(sent: Column, i: Column) -> Column:
        return F.try_element_at(helpers(sent, at(sent, i)["head"]), F.lit(1))["text"] != at(sent, i)["text"]

    def helped(sent: Column, i: Column) -> Column:
        return F.exists(helpers(sent, i), lambda t: t["dep"].isin("aux", "auxpass"))

    auxiliaries = at(src, s0)["dep"].startswith("aux") & at(tgt, t0)["dep"].startswith("aux")
    return F.coalesce(F.when(auxiliaries, later(src, s0) & later(tgt, t0)).otherwise(helped(src, s0) & helped(tgt, t0)), F.lit(False))


def one_sided(tok: Column, pos: Column, dep: Column) -> Column:
    """Category of tokens that are only missing or only unnecessary."""
    x = F.try_element_at(tok, F.lit(1))
    one, low = F.size(tok) == 1, F.lower(x["text"])
    alone, label = _single(pos), _lookup(DEPENDENCIES, _single(dep))
    return _first([
        (one & (x["tag"] == "POS"), "NOUN:POSS"),
        (one & low.isin(*CONTRACTIONS), "CONTR"),
        (one & (low == "to") & (x["pos"] == "PART") & (x["dep"] != "prep"), "VERB:FORM"),
        (_only(dep, "aux", "auxpass"), "VERB:TENSE"),
        (alone.isNotNull() & ~alone.isin(*RARE), alone),
        (label.isNotNull(), label),
        (_exactly(pos, "PART", "VERB"), "VERB"),
    ], "OTHER")


def plain_stem(word: Column) -> Column:
    """The word in lower case without a common ending, at least three letters long."""
    return F.regexp_replace(F.lower(word), "(?<=.{3})(ations?|ments?|ness|ings?|edly|ed|ers?|ly|able|ful|ies|es|s|y|e)$", "")


def two_sided(stem: Callable[[Column], Column] | None = plain_stem) -> Column:
    """Category of a replacement, from the columns that ``annotated_edits`` derives; without ``stem`` those of the stems, ``_as, _bs``, too."""
    c = F.col
    head = lambda name: F.get(name, F.lit(0))
    x, y, xl, yl = head("_a"), head("_b"), head("_al"), head("_bl")
    op, cp, od, cd = head("_apos"), head("_bpos"), head("_adep"), head("_bdep")
    n, m, sim = F.length(x["text"]), F.length(y["text"]), c("_sim")
    letters = [t["text"].rlike("^\\p{L}+$") for t in (x, y)]
    common = ~cp.isin(*RARE)
    same, lemma = op == cp, x["lemma"] == y["lemma"]
    tag = lambda *tags: x["tag"].isin(*tags) | y["tag"].isin(*tags)
    pair = lambda a, b: ((xl == a) & (yl == b)) | ((xl == b) & (yl == a))
    aux = od.startswith("aux") & cd.startswith("aux")
    pos, dep = F.concat("_apos", "_bpos"), F.concat("_adep", "_bdep")
    strange = letters[0] & ~c("_known")
    both_inflected = op.isin(*INFLECTED) & cp.isin(*INFLECTED)
    kin = lemma & both_inflected
    verbs = kin & same & (op == "VERB")
    short = list(SHORT_AUXILIARIES)

    special = [
        (tag("POS"), "NOUN:POSS"),
        ((xl.isin(*CONTRACTIONS) | yl.isin(*CONTRACTIONS)) & same, "CONTR"),
        (F.coalesce(yl == _lookup(SHORT_AUXILIARIES, xl), xl == _lookup(SHORT_AUXILIARIES, yl), F.lit(False)), "CONTR"),
        (xl.isin(*short) | yl.isin(*short), "VERB:TENSE"),
        (pair("was", "were"), "VERB:SVA"),
    ]
    spelling = [(strange & condition, label) for condition, label in (
        (lemma & same & op.isin("NOUN", "VERB"), F.concat(op, F.lit(":INFL"))),
        (lemma, "MORPH"),
        (sim > 0.55, "SPELL"),
        (((sim == 0.5) | (F.round(sim, 3) == 0.333)) & (n <= 4) & (m <= 4), "SPELL"),
        (common, cp),
        (F.lit(True), "OTHER"),
    )]
    forms = [
        (kin & same & (op == "ADJ"), "ADJ:FORM"),
        (kin & same & (op == "NOUN"), "NOUN:NUM"),
        (verbs & (c("_aux") | tag("VBG", "VBN")), "VERB:FORM"),
        (verbs & tag("VBD"), "VERB:TENSE"),
        (verbs & tag("VBZ"), "VERB:SVA"),
        (verbs & aux, "VERB:TENSE"),
        (kin & od.isin("acomp", "amod") & cd.isin("acomp", "amod"), "ADJ:FORM"),
        (kin & (op == "ADJ") & (y["tag"] == "NNS"), "NOUN:NUM"),
        *[(kin & y["tag"].isin(*tags), label) for tags, label in ((("VBG", "VBN"), "VERB:FORM"), (("VBD",), "VERB:TENSE"), (("VBZ",), "VERB:SVA"))],
        (kin, "MORPH"),
        (both_inflected & (stem(x["text"]) == stem(y["text"]) if stem else c("_as") == c("_bs")), "MORPH"),
    ]
    general = [
        (aux, "VERB:TENSE"),
        (same & common, op),
        ((od == cd) & od.isin(*DEPENDENCIES), _lookup(DEPENDENCIES, od)),
        (_exactly(pos, "PART", "PREP") | _exactly(dep, "prt", "prep"), "PART"),
        (_exactly(pos, "DET", "PRON") & cd.isin("nsubj", "nsubjpass", "dobj", "pobj"), "PRON"),
        (_exactly(pos, "DET", "PRON") & (cd == "poss"), "DET"),
        (_exactly(pos, "NUM", "DET") | pair("other", "another"), "DET"),
        ((xl == "your") & (yl == "yours"), "PRON"),
        (pair("no", "not"), "OTHER"),
    ]
    by_text = [((pair(a, b) if both else (xl == a) & (yl == b)) & (F.lit(True) if label else common), label or cp) for a, b, both, label in WORD_PAIRS]
    for size, lo, hi, (least, most), label in BY_LENGTH:
        fits = (n == size) & (m >= lo) & (m <= hi if hi else F.lit(True)) & sim.between(least, most)
        by_text.append((fits & (F.lit(True) if label else common), label or cp))
    long = (n > 5) & (m > 5)
    by_text += [
        (long & (x["text"].startswith(y["text"]) | y["text"].startswith(x["text"])) & (sim >= 0.66), "MORPH"),
        (long & (sim > 0.8), "SPELL"),
        (long & (sim < 0.55) & common, cp),
    ]
    single = [*special, *spelling, *forms, *general, *[(letters[0] & letters[1] & k, v) for k, v in by_text], (~(letters[0] & letters[1]), "OTHER")]
    alone, label = _single(pos), _lookup(DEPENDENCIES, _single(dep))
    end = F.try_element_at("_a", F.lit(-1))["lemma"] == F.try_element_at("_b", F.lit(-1))["lemma"]
    noun = F.array(F.lit("NOUN"), F.lit("PART"))
    return _first([
        (F.array_join("_al", "") == F.array_join("_bl", ""), "ORTH"),
        (F.array_sort("_al") == F.array_sort("_bl"), "WO"),
        *[(c("_one") & k, v) for k, v in single],
        (_only(dep, "aux", "auxpass"), "VERB:TENSE"),
        ((alone == "VERB") & end, "VERB:TENSE"),
        (alone.isNotNull() & ~alone.isin(*RARE), alone),
        (label.isNotNull(), label),
        (_exactly(pos, "PART", "VERB"), F.when(end, "VERB:FORM").otherwise("VERB")),
        (((c("_apos") == noun) | (c("_bpos") == noun)) & lemma, "NOUN:POSS"),
        ((xl.isin("most", "more") | yl.isin("most", "more")) & end & (F.size("_a") <= 2) & (F.size("_b") <= 2), "ADJ:FORM"),
    ], "OTHER")


def annotated_edits(pairs: DataFrame, spans: DataFrame, words: DataFrame | None = None, stem: Callable[[Column], Column] | DataFrame = plain_stem) -> DataFrame:
    """Edit rows with tokens and a type (``M:``, ``U:``, ``R:`` and a category, or ``UNK``) from spans of annotated pairs.

    ``words`` (column ``word``): the words taken for well spelled, joined like any other table; without it
    all are. ``stem``: a function, or a table ``word, stem`` in lower case that a stemmer has made, joined alike;
    a word that it does not have is its own stem, and of several the smallest counts. Trailing tokens that differ
    in case only don't count. A tag that is not in ``TAGS`` is X.
    """
    part = lambda side: F.slice(f"{side}_ann", F.col(f"{side}_start") + 1, F.col(f"{side}_end") - F.col(f"{side}_start"))
    e = spans.join(pairs.select(*PAIR, "src_ann", "tgt_ann"), PAIR)
    e = e.withColumn("_aux", _auxiliary_before(F.col("src_ann"), F.col("src_start"), F.col("tgt_ann"), F.col("tgt_start")))
    return _typed(e.select(*PAIR, "edit_no", "src_start", "src_end", "tgt_start", "tgt_end", "_aux", part("src").alias("_a"), part("tgt").alias("_b")), words, stem)


def english_edits(pairs: DataFrame, words: DataFrame | None = None, stem: Callable[[Column], Column] | DataFrame = plain_stem) -> DataFrame:
    """``annotated_edits(pairs, merge_annotated(pairs), words, stem)`` in one pass over pairs that also have ``src_tokens``."""
    e = edits_in_rows(pairs).select(*PAIR, F.explode("edits").alias("e"))
    return _typed(e.select(*PAIR, *[f"e.{c}" for c in ("edit_no", "src_start", "src_end", "tgt_start", "tgt_end")], F.col("e.aux").alias("_aux"), F.col("e.a").alias("_a"), F.col("e.b").alias("_b")), words, stem)


def _typed(e: DataFrame, words: DataFrame | None, stem: Callable[[Column], Column] | DataFrame) -> DataFrame:
    """Edits with annotated tokens ``_a, _b`` and ``_aux``, with their tokens and types."""
    tags = {tag: pos for pos, of in TAGS.items() for tag in of}
    e = e.withColumns({"src_tokens": F.transform("_a", lambda t: t["text"]), "tgt_tokens": F.transform("_b", lambda t: t["text"])})
    a, b = F.col("src_tokens"), F.col("tgt_tokens")
    e = e.withColumns({"_op": operation(a, b), "_na": F.size(_trimmed(a, b)), "_nb": F.size(_trimmed(b, a))})
    e = e.withColumns({"_a": F.slice("_a", F.lit(1), F.col("_na")), "_b": F.slice("_b", F.lit(1), F.col("_nb"))})
    new = {"_one": (F.col("_na") == 1) & (F.col("_nb") == 1)}
    for s in ("_a", "_b"):
        new[f"{s}l"] = F.transform(s, lambda t: F.lower(t["text"]))
        new[f"{s}pos"] = F.transform(s, lambda t: F.coalesce(_lookup(tags, t["tag"]), F.lit("X")))
        new[f"{s}dep"] = F.transform(s, lambda t: t["dep"])
    e = e.withColumns(new)
    x, y = F.get("_al", F.lit(0)), F.get("_bl", F.lit(0))
    e = e.withColumns({"_sim": F.when(F.col("_one"), 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))), "_w": F.when(F.col("_one"), F.get("_a", F.lit(0))["text"])})
    if words is None:
        e = e.withColumn("_known", F.lit(True))
    else:
        known = words.select(F.col("word").alias("_k")).where("_k is not null").distinct()
        e = e.join(known, F.col("_w") == F.col("_k"), "left").withColumnRenamed("_k", "_k1")
        e = e.join(known, F.lower("_w") == F.col("_k"), "left").withColumn("_known", F.coalesce("_k1", "_k").isNotNull())
    if isinstance(stem, DataFrame):
        stems = stem.where("word is not null").groupBy(F.col("word").alias("_k")).agg(F.min("stem").alias("_stem"))
        for s, first in (("_as", x), ("_bs", y)):
            e = e.withColumn("_key", first).join(stems, F.col("_key") == F.col("_k"), "left").withColumn(s, F.coalesce("_stem", "_key")).drop("_key", "_k", "_stem")
    kind = F.when(F.col("_op") == "R", two_sided(None if isinstance(stem, DataFrame) else stem)).when(F.col("_op") == "M", one_sided(F.col("_b"), F.col("_bpos"), F.col("_bdep"))).otherwise(one_sided(F.col("_a"), F.col("_apos"), F.col("_adep")))
    types = F.array(F.when(F.col("_op") == "UNK", "UNK").otherwise(F.concat_ws(":", "_op", kind)))
    return e.select(*PAIR, "edit_no", "src_start", "src_end", "tgt_start", "tgt_end", "src_tokens", "tgt_tokens", types.alias("types"))
