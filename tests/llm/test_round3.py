"""Brute force for what the first rounds left to hand-made rows; repeated rows, rows without an id."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from corrigenda.llm import html_text, lines, packing, quality, simhash, spans, urls


def test_density_finds_the_text_without_telling_names():
    prose = lambda n: " ".join(f"word{i}" for i in range(n))
    links = "".join(f"<div><a href=/{i}>menu {i}</a></div>" for i in range(20))
    page = f"<body><div>{links}</div><div><div>{''.join(f'<div>{prose(60)} {k}</div>' for k in range(5))}</div></div><div>{links}</div></body>"
    got = html_text.main_text(page)
    assert got == "\n".join(f"{prose(60)} {k}" for k in range(5))
    assert html_text.main_text("<div>" * 2000 + "<p>x</b>" * 2000).count("x") == 2000


def test_base_counts_equal_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        t = "".join(rng.choice("ab \n\t\x0b\x0c\r#*$%&|<>é\x85 ") for _ in range(rng.randint(0, 60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        got = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        win = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        rep = {i + k for i, w in enumerate(win) if win.count(w) > 1 for k in range(3)}
        assert quality.rule_stats(t)[0] == [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(got) - len(set(got)), len(rep)]


def test_hosts_paths_and_rules_equal_brute_force(spark):
    rng = random.Random(7)
    pick = lambda: "".join(rng.choice(["://", "/", "?", "#", "A", "org", ".", "example.org", "com", "/es/", "/en/1", "/de/", "x"]) for _ in range(rng.randint(0, 8)))
    rows = [(i, None if i == 0 else pick()) for i in range(400)] + [(400, "http://" + "x" * 1_500 + ".org/")] * 2
    want = {}
    for i, u in rows:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split("[/?#]", rest)[0]
            path = re.split("[?#]", rest[len(host) :])[0]
        host = host.translate(str.maketrans(urls.UPPER, urls.LOWER))
        fits = [(len(h + p), v, h + p) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want[i] = (host, path, max(fits)[2] if fits else None, max(fits)[1] if fits else None)
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], "page_id bigint, url string, host string, rule string")
    got = urls.judge_urls(df, urls.RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = want[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict) and (host or r.verdict == "allow")
    assert urls.judge_urls(df.limit(0), []).count() == 0
    assert {r.rule for r in urls.judge_urls(df, []).collect()} == {None}


def test_many_leaves_and_dealt_shards(spark, monkeypatch):
    for name, value in (("SHARD_ROWS", 50), ("TASK_ROWS", 40), ("LEAF_ROWS", 8)):
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 63, 120, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 120, dtype=np.uint64)) for _ in range(4))]))
    nodes = spark.createDataFrame([(i, int(x)) for i, x in enumerate(fps.view(np.int64))], "node bigint, fp bigint")
    root = list(range(len(fps)))

    def find(x, r):
        while r[x] != x:
            x = r[x]
        return x

    got = list(root)
    for e in simhash.near_edges(nodes).collect():
        a, b = sorted((find(e.u, got), find(e.v, got)))
        got[b] = a
    for i, j in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)):
        a, b = sorted((find(i, root), find(j, root)))
        root[b] = a
    assert [find(i, got) for i in range(len(fps))] == [find(i, root) for i in range(len(fps))]


def test_packing_in_shards(spark):
    rng = random.Random(2)
    rows = [(i % 50 or None, i, 0, rng.randint(1, 100), i) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    got = packing.pack(df, capacity=100, shard_pieces=64).collect()
    assert sorted(r.piece for r in got) == list(range(600))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 100
    assert len(bins) <= 1.05 * len(packing.best_fit([r[3] for r in rows], 100))


def test_repeated_rows_and_rows_without_id(spark):
    line = "one two three four five six seven eight nine"
    data = [(1, line, "k"), (1, line, "k"), (None, line, "k"), (None, "own " + line[4:], "k"), (2, "other text", "k")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, k string")
    got = lines.dedup_lines(df)
    assert got.columns == df.columns and sorted(r.text for r in got.collect()) == sorted(["", "", "", line, "other text"])
    passage = ". ".join(f"Sentence {i} of a passage with words" for i in range(12)) + "."
    rows = [(5, passage, "k"), (5, passage, "k"), (None, "Mine first here. " + passage, "k"), (None, passage + " Mine last here.", "k"), (None, None, "k")]
    got = spans.dedup_spans(spark.createDataFrame(rows, df.schema)).collect()
    assert sorted(str(r.text).strip() for r in got) == sorted([passage, "", "Mine first here.", "Mine last here.", "None"])
    kept = simhash.keep_one(df.where(F.col("text") == line))
    assert [r.doc_id for r in kept.collect()] == [1]


def test_rare_shingles_lose_no_pair(spark):
    from corrigenda.llm import similar

    rng = random.Random(8)
    base = [f"w{i}" for i in range(70)]
    texts = []
    for _ in range(90):
        w = list(base)
        for p in rng.sample(range(70), rng.randint(1, 3)):
            w[p] = f"{rng.choice('abc')}{p}"
        texts.append(" ".join(w[: rng.randint(60, 70)]))
    sets = {int(similar._digest(s)): {int(v) for v in s.view(np.int64)} for s in map(similar.shingle_set, texts)}
    table = spark.createDataFrame([(d, sorted(s)) for d, s in sets.items()], "sd bigint, s array<bigint>")
    rows = table.select(F.struct(F.lit(0).cast("long").alias("k"), F.col("sd").alias("d"), F.size("s").alias("n")).alias("x"), F.col("sd").alias("c"))
    likely = similar._by_rare(rows, table, 0.8)
    got = {(min(r.u.d, r.v.d), max(r.u.d, r.v.d)) for r in similar._similar(likely, table, 0.8).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert want and got == want and likely.count() < len(sets) * (len(sets) - 1) // 2
    assert similar._by_rare(rows.limit(0), table, 0.8).count() == 0


def test_near_copies_of_repeated_rows_and_rows_without_id(spark):
    from corrigenda.llm import similar

    w = [f"t{i}" for i in range(90)]
    near = " ".join([*w[:40], "changed", *w[41:]])
    data = [(3, " ".join(w), "x"), (3, near, "y"), (None, near, "z"), (None, "alone here", "z"), (7, "alone here", "k"), (3, "of its own", "c")]
    got = similar.keep_one_similar(spark.createDataFrame(data, "doc_id bigint, text string, k string"))
    rows = sorted((r.doc_id or 0, r.text) for r in got.collect())
    assert [i for i, _ in rows] == [3, 3, 7] and rows[0][1] == "of its own" and rows[1][1] in (" ".join(w), near) and rows[2][1] == "alone here"
