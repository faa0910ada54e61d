"""Merging and categories over annotated tokens, case by case."""

import pytest

from corrigenda.operators.english import SPANS, TOKEN, Token, annotated_edits, merge_annotated, merged


def tok(words: str) -> list[tuple]:
    """``text/lemma/pos/tag/dep`` of each word; what is left out: lower case, NOUN, NN, dobj. Heads: the first token."""
    out = []
    for w in words.split():
        parts = [*w.split("/"), *[""] * 5][:5]
        t = parts[0]
        out.append((t, parts[1] or t.lower(), parts[2] or "NOUN", parts[3] or "NN", parts[4] or "dobj", 0))
    return out


def tokens(words: str) -> list[Token]:
    return [Token(*t[:4]) for t in tok(words)]


def steps(ops: str) -> list[tuple]:
    out, s, t = [], 0, 0
    for op in ops:
        ds, dt = op != "I", op != "D"
        out.append((op, s, s + ds, t, t + dt))
        s, t = s + ds, t + dt
    return out


@pytest.mark.parametrize("ops, src, tgt, want", [
    ("DD", "a b", "", [(0, 2)]),
    ("MDDMII", "m a b n", "m n c d", [(1, 3), (4, 6)]),
    ("S", "a", "b", [(0, 1)]),
    ("SS", "aa/aa/VERB bb/bb/ADV", "cc/cc/VERB dd/dd/ADV", [(0, 1), (1, 2)]),
    ("IS", "Cat", "The/the/DET cat", [(0, 2)]),
    ("SI", "friends", "friend 's/'s/PART/POS", [(0, 2)]),
    ("SD", "'/'/PART/POS xx", "yyy", [(0, 1), (1, 2)]),
    ("SI", "acat", "a/a/DET cat", [(0, 2)]),
    ("DS", "to/to/PART eat/eat/VERB", "eating/eat/VERB", [(0, 2)]),
    ("SI", "house", "houses the/the/DET", [(0, 1), (1, 2)]),
    ("SI", "on/on/ADP", "xx/xx/ADP the/the/DET", [(0, 1), (1, 2)]),
    ("SI", "on/on/ADP", "walked/walk/VERB off/off/ADP", [(0, 2)]),
    ("SI", "on/on/ADP", "xx/xx/PRON yy/yy/SCONJ", [(0, 1), (1, 2)]),
    ("DS", ",/,/PUNCT/, we/we/PRON", "We/we/PRON", [(0, 2)]),
])
def test_merging(ops, src, tgt, want):
    assert merged(steps(ops), tokens(src), tokens(tgt)) == want


def test_a_reordering_is_an_edit_by_itself():
    assert merged([("D", 0, 1, 0, 0), ("T2", 1, 3, 0, 2), ("M", 3, 4, 2, 3), ("I", 4, 4, 3, 4)], tokens("x a b m"), tokens("b a m z")) == [(0, 1), (1, 2), (3, 4)]


CASES = [
    ("", "'s/'s/PART/POS/case", "M:NOUN:POSS"), ("n't/not/PART/RB/neg", "", "U:CONTR"), ("", "to/to/PART/TO/aux", "M:VERB:FORM"),
    ("", "has/have/AUX/VBZ/aux been/be/AUX/VBN/aux", "M:VERB:TENSE"), ("the/the/DET/DT/det", "", "U:DET"), ("", "!/!/SYM/SYM/punct", "M:PUNCT"),
    ("", "to/to/PART/TO/aux eat/eat/VERB/VB/xcomp", "M:VERB"), ("", "5/5/NUM/CD/nummod", "M:OTHER"),
    ("Cat", "cat", "R:ORTH"), ("sub way", "subway", "R:ORTH"), ("a b", "b a", "R:WO"),
    ("ca/can/VERB/MD/aux", "can/can/VERB/MD/aux", "R:CONTR"), ("wo/will/AUX/MD/aux", "should/should/AUX/MD/aux", "R:VERB:TENSE"),
    ("was/be/AUX/VBD/ROOT", "were/be/AUX/VBD/ROOT", "R:VERB:SVA"),
    ("eles/eles", "else/else/ADV/RB", "R:SPELL"), ("getted/get/VERB/VBD", "got/get/VERB/VBD", "R:VERB:INFL"), ("qqqqqq", "number", "R:NOUN"),
    ("big/big/ADJ/JJ", "bigger/big/ADJ/JJR", "R:ADJ:FORM"), ("cat/cat", "cats/cat/NOUN/NNS", "R:NOUN:NUM"),
    ("eat/eat/VERB/VB", "eating/eat/VERB/VBG", "R:VERB:FORM"), ("eat/eat/VERB/VB", "ate/eat/VERB/VBD", "R:VERB:TENSE"), ("eat/eat/VERB/VB", "eats/eat/VERB/VBZ", "R:VERB:SVA"),
    ("health/health", "healthy/healthy/ADJ/JJ", "R:MORPH"), ("big/big/ADJ/JJ", "small/small/ADJ/JJ", "R:ADJ"),
    ("up/up/ADP/RP/prt", "on/on/ADP/IN/prep", "R:PART"), ("one/one/NUM/CD/nummod", "a/a/DET/DT/det", "R:DET"), ("your/your/DET/PRP$/poss", "yours/yours/PRON/PRP/pobj", "R:PRON"),
    ("no/no/DET/DT/det", "not/not/PART/RB/neg", "R:OTHER"), ("the/the/DET/DT/det", "that/that/PRON/WP/nsubj", "R:PRON"), ("then/then/ADV/RB/advmod", "than/than/ADP/IN/prep", "R:SPELL"),
    ("house/house/NOUN/NN/dobj", "domestic/domestic/ADJ/JJ/amod", "R:ADJ"), ("5/5/NUM/CD/nummod", "on/on/ADP/IN/prep", "R:OTHER"),
    ("eat/eat/VERB/VB", "has/have/AUX/VBZ eaten/eat/VERB/VBN", "R:VERB:TENSE"), ("to/to/PART/TO eat/eat/VERB/VB", "eating/eat/VERB/VBG", "R:VERB:FORM"),
    ("friends/friend/NOUN/NNS", "friend/friend 's/'s/PART/POS", "R:NOUN:POSS"), ("more/more/ADV/RBR free/free/ADJ/JJ", "freer/free/ADJ/JJR", "R:ADJ:FORM"),
    ("Doctor", "The/the/DET/DT/det doctor", "M:DET"), ("x", "x", "UNK"),
]
KNOWN = "big bigger cat cats eat ate health house no one small the then to up was were your you friends free more ca wo on".split()


def test_categories(spark):
    pairs = spark.createDataFrame([("s", k, "ref", 0, tok(a), tok(b)) for k, (a, b, _) in enumerate(CASES)], f"system_id string, sample_id bigint, side string, target_id int, src_ann array<{TOKEN}>, tgt_ann array<{TOKEN}>")
    spans = spark.createDataFrame([("s", k, "ref", 0, 0, len(tok(a)), 0, len(tok(b)), "S", 0) for k, (a, b, _) in enumerate(CASES)], SPANS)
    words = spark.createDataFrame([(w,) for w in [*KNOWN, "cat", None]], "word string")
    got = {r.sample_id: r.types for r in annotated_edits(pairs, spans, words).collect()}
    assert [(a, b, got[k][0]) for k, (a, b, _) in enumerate(CASES)] == CASES


def test_auxiliary_before_a_verb_and_no_edits(spark):
    has, had = ("has", "have", "AUX", "VBZ", "aux", 1), ("has", "have", "AUX", "VBZ", "aux", 1)
    src, tgt = [has, ("ate", "eat", "VERB", "VBD", "ROOT", 1)], [had, ("eat", "eat", "VERB", "VB", "ROOT", 1)]
    schema = f"system_id string, sample_id bigint, side string, target_id int, src_ann array<{TOKEN}>, tgt_ann array<{TOKEN}>"
    pairs = spark.createDataFrame([("s", 0, "ref", 0, src, tgt), ("s", 1, "ref", 0, src, src), ("s", 2, "ref", 0, [], src)], schema)
    got = sorted((r.sample_id, r.types[0]) for r in annotated_edits(pairs, merge_annotated(pairs)).collect())
    assert got == [(0, "R:VERB:FORM"), (2, "M:VERB")]
    none = spark.createDataFrame([], schema)
    assert annotated_edits(none, merge_annotated(none)).count() == 0


def test_stems_from_a_table(spark):
    # what a stemmer makes of these words; the default rule knows the first pair only
    table = [("acting", "act"), ("acted", "act"), ("possession", "possess"), ("possessive", "possess"), ("maximum", "maxim"), ("maximal", "maxim"), ("cat", "cat"), ("cat", "zz"), (None, "x")]
    cases = [
        ("acting/acting/NOUN/NN", "acted/act/VERB/VBD", True, True), ("possession/possession/NOUN/NN", "possessive/possessive/ADJ/JJ", False, True),
        ("Maximum/maximum/NOUN/NN", "maximal/maximal/ADJ/JJ", False, True), ("cat/cat/NOUN/NN", "dogged/dogged/ADJ/JJ", False, False), ("thinking/thinking/NOUN/NN", "thoughtful/thoughtful/ADJ/JJ", False, False),
    ]
    schema = f"system_id string, sample_id bigint, side string, target_id int, src_ann array<{TOKEN}>, tgt_ann array<{TOKEN}>"
    pairs = spark.createDataFrame([("s", k, "ref", 0, tok(a), tok(b)) for k, (a, b, *_) in enumerate(cases)], schema)
    spans = spark.createDataFrame([("s", k, "ref", 0, 0, 1, 0, 1, "S", 0) for k in range(len(cases))], SPANS)
    stems = spark.createDataFrame(table, "word string, stem string")
    for given, at in (({}, 2), ({"stem": stems}, 3)):
        got = {r.sample_id: r.types == ["R:MORPH"] for r in annotated_edits(pairs, spans, **given).collect()}
        assert got == {k: c[at] for k, c in enumerate(cases)}
