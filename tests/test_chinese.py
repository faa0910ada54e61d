"""Chinese costs, merging, types and spelling against plain code and hand-made cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrigenda.operators import chinese as Z

PAIRS = "system_id string, sample_id bigint, side string, target_id int, src_tokens array<string>, tgt_tokens array<string>"


def token(text, tag="unk", code=None, sounds=(), alike=()):
    return text, tag, code, sounds, alike


def one_cost(a, b, words=False):
    table = (Z.WordCosts if words else Z.TokenCosts)([a, b])
    x, y = np.array([0]), np.array([1])
    assert table.least(x, y)[0] <= table.cost(x, y)[0]
    return table.cost(x, y)[0]


def test_costs_of_characters():
    # meaning (of 6), spelling (halved share of unlike characters), punctuation
    assert one_cost(token("他"), token("她")) == 4 / 6 + 0.5 + 0.25
    assert one_cost(token("他", code="Aa01"), token("她", code="Aa01")) == 0.5 + 0.25
    assert one_cost(token("他", code="Aa01"), token("她", code="Aa02")) == 2 / 6 + 0.5 + 0.25
    assert one_cost(token("他", code="Aa01"), token("她", code="Ba01")) == 2 / 6 + 0.5 + 0.25  # the later levels still count
    assert one_cost(token("他", code="Aa01"), token("她", code="Bb02")) == 1 + 0.5 + 0.25
    assert one_cost(token("他", sounds=("ta",)), token("她", sounds=("ta", "jie"))) == 4 / 6 + 0.25
    assert one_cost(token("己", alike=(("已",),)), token("已")) == 4 / 6 + 0.25
    assert one_cost(token("己"), token("已", alike=(("己",),))) == 4 / 6 + 0.25
    assert one_cost(token("，"), token("！")) == 4 / 6 + 0.5
    assert one_cost(token("，"), token("她")) == 4 / 6 + 0.5 + 0.499
    assert one_cost(token("a"), token("b")) == 4 / 6 + 0.5 + 0.25


def test_costs_of_words():
    assert one_cost(token("高兴", "a"), token("高心", "a"), True) == 4 / 6 + 0.25
    assert one_cost(token("高兴", "a"), token("心", "n"), True) == 4 / 6 + 0.499 + 0.5
    assert one_cost(token("兴", "a"), token("高兴", "n"), True) == 4 / 6 + 0.499


def kinds(src, tgt, words=False, heuristic=True, costs=None):
    from corrigenda.operators.align import _text_key, align_many, op_name

    sides = [([token(t) for t in src], [token(t) for t in tgt])]
    (cols,) = align_many(sides, costs or (Z.WordCosts if words else Z.TokenCosts), _text_key)
    steps = [(op_name(k), *x) for k, *x in zip(*(c.tolist() for c in cols))]
    return Z.merged(steps, src, tgt, words, heuristic)


@pytest.mark.parametrize(
    ("src", "tgt", "words", "want"),
    [
        ("我喜欢吃", "我喜欢吃", False, []),
        ("我很喜欢", "我喜欢", False, [("D", 1, 2, 1, 1)]),
        ("我喜欢吃饭", "我喜吃", False, [("D", 2, 3, 2, 2), ("D", 4, 5, 3, 3)]),
        ("他去学校", "他去了学校", False, [("I", 2, 2, 2, 3)]),
        ("学中我文", "学我中文", False, [("T2", 1, 3, 1, 3)]),
        (["冬阴功", "对", "外国人"], ["外国人", "对", "冬阴功"], True, [("T3", 0, 3, 0, 3)]),
        (["冬阴功", "对", "外国人"], ["外国", "对", "冬阴功"], True, [("T3", 0, 3, 0, 3)]),  # a slip of one character
        (["旅游", "去", "陌生", "地方"], ["去", "陌生", "地方", "旅游"], True, None),
        (["大家", "好"], ["你们", "早"], True, [("S", 0, 1, 0, 1), ("S", 1, 2, 1, 2)]),
        ("大家好", "你们早", False, [("S", 0, 3, 0, 3)]),
    ],
)
def test_merging(src, tgt, words, want):
    got = kinds(list(src), list(tgt), words)
    if want is None:
        assert [g[0][0] for g in got] == ["T"] and got[0][1:] == (0, 4, 0, 4)
    else:
        assert got == want


def test_steps_are_merged_by_their_kinds():
    src, tgt = list("甲乙丙丁"), list("戊乙己庚")
    steps = [("S", 0, 1, 0, 1), ("M", 1, 2, 1, 2), ("D", 2, 3, 2, 2), ("S", 3, 4, 2, 3), ("I", 4, 4, 3, 4)]
    assert Z.merged(steps, src, tgt) == [("S", 0, 1, 0, 1), ("S", 2, 4, 2, 4)]
    assert Z.merged([("D", 0, 1, 0, 0), ("I", 1, 1, 0, 1)], ["甲"], ["乙"]) == [("D", 0, 1, 0, 0), ("I", 1, 1, 0, 1)]
    # moved behind a match, or behind a reordering; punctuation is never carried
    assert Z.merged([("D", 0, 1, 0, 0), ("M", 1, 2, 0, 1), ("I", 2, 2, 1, 2)], ["甲", "乙"], ["乙", "甲"]) == [("T2", 0, 2, 0, 2)]
    assert Z.merged([("I", 0, 0, 0, 1), ("M", 0, 1, 1, 2), ("D", 1, 2, 2, 2)], ["乙", "甲"], ["甲", "乙"]) == [("T2", 0, 2, 0, 2)]
    assert Z.merged([("D", 0, 1, 0, 0), ("T2", 1, 3, 0, 2), ("I", 3, 3, 2, 3)], ["甲", "乙", "丙"], ["丙", "乙", "甲"]) == [("T3", 0, 3, 0, 3)]
    assert len(Z.merged([("D", 0, 1, 0, 0), ("M", 1, 2, 0, 1), ("I", 2, 2, 1, 2)], ["，", "乙"], ["乙", "，"])) == 2
    # one text turned round, and single characters that differ
    assert Z.merged([("D", 0, 1, 0, 0), ("M", 1, 2, 0, 1), ("I", 2, 2, 1, 2)], ["甲乙丙", "丁"], ["丁", "乙丙甲"]) == [("T2", 0, 2, 0, 2)]
    assert len(Z.merged([("D", 0, 1, 0, 0), ("M", 1, 2, 0, 1), ("I", 2, 2, 1, 2)], ["甲", "丁"], ["丁", "乙"])) == 2


def test_replacements_lose_what_both_sides_share():
    assert Z.merged([("S", 0, 1, 0, 1), ("I", 1, 1, 1, 2), ("I", 1, 1, 2, 3)], ["负责任"], ["负", "责任", "的"], words=True) == [("I", 1, 1, 2, 3)]
    assert Z.merged([("D", 0, 1, 0, 0), ("S", 1, 2, 0, 1)], ["時", "住"], ["時住"], words=True) == []
    assert Z.merged([("S", 0, 1, 0, 1), ("S", 1, 2, 1, 2)], ["甲", "乙"], ["丙", "乙"]) == [("S", 0, 1, 0, 1)]
    assert Z.merged([("S", 0, 1, 0, 1), ("D", 1, 2, 1, 1)], ["甲", "乙"], ["乙"]) == [("D", 0, 1, 0, 0)]


def apply(src, tgt, edits):
    out, at = [], 0
    for _, a, b, c, d in edits:
        out += src[at:a] + tgt[c:d]
        at = b
    return "".join(out + src[at:])


@pytest.mark.parametrize("words", [False, True])
@pytest.mark.parametrize("heuristic", [False, True])
def test_edits_rebuild_the_target(words, heuristic):
    rng = random.Random(3)
    for _ in range(1500):
        src = ["".join(rng.choice("甲乙丙，") for _ in range(rng.choice([1, 1, 2, 3]) if words else 1)) for _ in range(rng.randint(0, 8))]
        tgt = list(src)
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(tgt) + 1)
            if rng.random() < 0.3:
                tgt.insert(k, rng.choice("甲乙丙丁"))
            elif k < len(tgt):
                if rng.random() < 0.5:
                    tgt.insert(rng.randrange(len(tgt)), tgt.pop(k))
                else:
                    tgt[k] = rng.choice("甲乙丙丁")
        got = kinds(src, tgt, words, heuristic)
        assert apply(src, tgt, got) == "".join(tgt)
        assert all(a[2] <= b[1] and a[4] <= b[3] for a, b in zip(got, got[1:]))


def lexical_tables(spark):
    classes = spark.createDataFrame([("他", "Aa01"), ("她", "Aa01"), ("大家", "Ab02")], "word string, code string")
    confusions = spark.createDataFrame([("己", ["已", "巳"])], "char string, alike array<string>")
    sounds = spark.createDataFrame([("他", ["ta"]), ("她", ["ta"]), ("家", ["jia", "jie"]), ("大", ["da", "dai"])], "char string, sounds array<string>")
    return classes, confusions, sounds


def test_tables_given_and_joined(spark, monkeypatch):
    rows = [("s", 1, "ref", 0, list("他去己家"), list("她去已家")), ("s", 2, "ref", 0, ["大家"], ["大家"]), ("s", 3, "ref", 0, [], ["他"]), ("s", 4, "ref", 1, list("我中学文"), list("我学中文"))]
    pairs = spark.createDataFrame(rows, PAIRS)
    lex = Z.lexicon(pairs, *lexical_tables(spark))
    entries = {r.token: r.entry for r in lex.collect()}
    assert set(entries) == {"他", "她", "己", "家", "大家"}
    assert entries["大家"].code == "Ab02" and entries["大家"].sounds == ["da", "dai", "jia", "jie"] and entries["己"].alike == [["已", "巳"]]
    given = sorted(map(tuple, Z.merge_chinese(pairs, lex).collect()))
    monkeypatch.setattr(Z, "SMALL", 2)
    assert sorted(map(tuple, Z.merge_chinese(pairs, lex).collect())) == given
    assert given == [("s", 1, "ref", 0, 0, 1, 0, 1, "S", 0), ("s", 1, "ref", 0, 2, 3, 2, 3, "S", 1), ("s", 3, "ref", 0, 0, 0, 0, 1, "I", 0), ("s", 4, "ref", 1, 1, 3, 1, 3, "T2", 0)]
    edits = Z.chinese_edits(pairs, Z.merge_chinese(pairs, lex)).select("sample_id", "edit_no", "types", "src_tokens", "tgt_tokens")
    assert sorted(map(tuple, edits.collect())) == [(1, 0, ["S"], ["他"], ["她"]), (1, 1, ["S"], ["己"], ["已"]), (3, 0, ["M"], [], ["他"]), (4, 0, ["T"], ["中", "学"], ["学", "中"])]
    assert Z.merge_chinese(pairs.limit(0), lex).count() == 0
    assert Z.lexicon(pairs).count() == 0


def test_types_of_words(spark):
    rows = [("D", ["好"], [], "a", None, "U:ADJ"), ("D", ["很好"], [], "a", None, "R:OTHER"), ("I", [], ["了"], None, "u", "M:AUX"), ("I", [], ["[缺失成分]"], None, None, "M:MC"), ("I", [], ["北京"], None, "ns", "M:OTHER"),
            ("S", ["高兴"], ["兴高"], "a", "a", "S:SPELL"), ("S", ["人"], ["京"], "n", "ns", "S:NOUN"), ("S", ["人"], ["他们"], "n", "r", "S:OTHER"), ("T", ["a", "b"], ["b", "a"], None, None, "T"), ("I", [], ["啊"], None, "zz", "M:OTHER")]
    df = spark.createDataFrame(rows, "k string, s array<string>, t array<string>, x string, y string, want string")
    assert df.where(Z.word_type(*map(F.col, ("k", "s", "t", "x", "y"))) != F.col("want")).count() == 0


def test_spelling(spark):
    chars = spark.createDataFrame([("己", "5150", ["ji"]), ("已", "5151", ["yi"]), ("他", "923", ["ta"]), ("她", "453", ["ta"]), ("山", "252", ["shan"])], "char string, shape string, sounds array<string>")
    rows = [(1, "高兴", "兴高"), (2, "己", "已"), (3, "他己", "她已"), (4, "他", "山"), (5, "他", "他们"), (6, "他", "X"), (7, "", ""), (8, None, "他"), (9, "他他", "山她")]
    got = {r.id: (r.misspelled, r.likeness) for r in Z.spelling_errors(spark.createDataFrame(rows, "id int, a string, b string"), chars, ["id"]).collect()}
    assert {k for k, v in got.items() if v[0]} == {1, 2, 3, 7}
    assert got[2][1] == 0.75 + 0.5 and got[1][1] is None and got[6][1] is None and 8 not in got
