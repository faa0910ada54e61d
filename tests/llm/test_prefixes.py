"""The conversation trie against a plain one built turn by turn."""

import hashlib
import random
import re
from zlib import crc32

from corrigenda.llm import prefixes

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, a string"


def plain_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(x)] for c, x in convs.items()}
    built = {}
    for c, own in convs.items():
        h = crc32(str(c).encode()) % 4
        built[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    members = {}
    for c, x in built.items():
        for d in range(len(x) + 1):
            members.setdefault(tuple(x[:d]), []).append(c)
    down = {p: [] for p in members}
    for p in members:
        if p:
            down[p[:-1]].append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        sums[p] = (sum(sums[q][0] for q in down[p]) or 1, (len(members[p]) - 1) * words + sum(sums[q][1] for q in down[p]))
    out = set()
    for p, m in members.items():
        ended = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(down[p]), *sums[p], hashlib.sha256(ended.encode()).hexdigest()))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = [tuple(r) for r in prefixes.conversation_trie(df).collect()]
    want = plain_trie(rows)
    assert len(got) == len(want) and set(got) == want


def test_trie_equals_plain_one(spark):
    rng = random.Random(12)
    rows = []
    for c in range(160):
        for t in range(rng.choice([1, 1, 2, 3, 4, 5, 8, 9, 13, 30])):
            rows.append((c * 3, t, rng.choice(["user", "bot"]) if rng.random() < 0.3 else "user", rng.choice(["a b", "a b", "c", ""]) if t < 12 else "more of it"))
    rng.shuffle(rows)
    check(spark, rows)


def test_nulls_ties_hot_copies_and_long_ones(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "ID_RANGE", 8)
    rows = [(c, t, "user", "one two three") for c in range(1, 120) for t in range(3)]  # a third of all rows are copies
    rows += [(200, t, "user", f"turn {t % 2}") for t in range(500)]
    rows += [(220, t, "user", f"turn {t % 2}") for t in range(501)]
    rows += [(240, None, None, None), (240, None, None, None), (240, 1, "b", "x"), (240, 1, "a", "x"), (240, 1, "a", "x"), (None, 0, "a", "lost")]
    rows += [(c, 0, "user", None) for c in range(300, 330)]
    check(spark, rows)


def test_chains_of_paths(spark):
    # each conversation leaves the one with the next larger id one turn later
    check(spark, [(1000 - 20 * k, t, "u", "w" if t < k else f"end {k}") for k in range(40) for t in range(k + 1)])


def test_empty_table(spark):
    assert prefixes.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_plain_trie(spark):
    from corrigenda.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    got = [tuple(r) for r in queries.op12_prefix_trie(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows)
