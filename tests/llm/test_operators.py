"""Operators against brute force on small fixtures with nulls, ties, copies, empty tables and extra columns."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from corrigenda.llm import html_text, lines, lz, packing, pieces, quality, queries, simhash, spans, tokens, urls

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, fingerprint string, _gone string, k int"


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [line(12) for _ in range(8)]
    out = [None, "", " \n\t ", "one", "é日本 \x00 <|endoftext|> x", "x" * 3000, "\n".join(base), "\n".join(base)]
    for k in range(12):
        w = base[k % 8].split()
        w[k % 12] = "zz"
        out.append("\n".join([" ".join(w), line(9), base[(k + 1) % 8], line(2)]))
    out.append(base[0] + " extra\n" + " ".join(base[1].split()[:-1]))
    out += ["Read the whole story\nPage 12 of the book", "Read the whole storys\nPage 13 of the book\nRead"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "f", "g", 1) for i, t in enumerate(texts())]
    rows += [rows[6], (None, "no id at all", "f", "g", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for chunk in (65_536, 90):
        got = tokens.token_counts(docs, chunk_chars=chunk, overlap=40)
        want = sorted(str((i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids))) for i, t in rows_of(docs))
        assert sorted(str((r.doc_id, r.n_bytes, r.n_tokens)) for r in got.collect()) == want
    assert tokens.token_counts(none).count() == 0


def test_pieces(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    enc = pieces.piece_encoder(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(9)
    for t in [t for _, t in rows_of(docs) if t] + ["".join(rng.choice("ab \n'rel 1é▁日. th") for _ in range(rng.randint(1, 50))) for _ in range(500)]:
        ids = enc.encode(t)
        assert ids == sp.encode(t) and enc.decode(ids) == sp.decode(ids)
    r = {x.doc_id: x for x in pieces.piece_digests(docs).collect()}[0]
    assert r.n_tokens == 0 and r.ids_sha256 == hashlib.sha256(b"").hexdigest()
    back = pieces.decode_pieces(pieces.encode_pieces(docs.where("doc_id = 12")))
    assert back.first().text == rows_of(docs.where("doc_id = 12"))[0][1]
    assert pieces.piece_digests(none).count() == 0


def test_simhash(docs, none):
    for distance in (3, 9):
        got = simhash.near_duplicates(docs, distance=distance).collect()
        rows = [(r.doc_id, np.int64(r.fp).view(np.uint64)) for r in got]
        comp = {i: i for i, _ in rows if i is not None}

        def root(x):
            while comp[x] != x:
                x = comp[x]
            return x

        for i, a in rows:
            for j, b in rows:
                if i is not None and j is not None and int(np.bitwise_count(a ^ b)) <= distance:
                    lo, hi = sorted((root(i), root(j)))
                    comp[hi] = lo
        assert all(r.component_id == root(r.doc_id) for r in got if r.doc_id is not None)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 24) == [0, 9, 12, 15, 18]


def test_vantage_routing_is_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 32, 3000, dtype=np.uint32)
    y = x ^ (np.uint32(1) << rng.integers(0, 32, 3000, dtype=np.uint32))
    tree = simhash.VantageTree(x[:500], 16, rng)
    home = np.empty(3000, int)
    for leaf, mine, _ in tree.route(x, 1):
        home[mine] = leaf
    reach = {(leaf, int(i)) for leaf, a, b in tree.route(y, 1) for i in np.concatenate([a, b])}
    assert all((int(home[i]), i) in reach for i in range(3000))


@pytest.mark.parametrize("hot_parts", [1, 2_000])  # no line is hot, every line is
def test_lines(docs, none, monkeypatch, hot_parts):
    monkeypatch.setattr(lines, "HOT_PARTS", hot_parts)
    rows = sorted(rows_of(docs), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    first: dict = {}
    for at, (_, t) in enumerate(rows):
        for n, s in enumerate((t or "").split("\n")):
            if s.split():
                first.setdefault(tuple(s.split()), (at, n))
    near = set()
    for w in first:
        for v in first:
            a, b = (list(x) if len(x) >= 8 else list(" ".join(x)) for x in (w, v))
            if first[v] < first[w] and (len(w) >= 8) == (len(v) >= 8) and min(len(" ".join(w)), len(" ".join(v))) >= 12 and edits(a, b) == 1:
                if len(w) >= 8 or not any(c.isdigit() for c in changed(a, b)):
                    near.add(w)

    def brute(at, t):
        if t is None:
            return None
        out, seen = [], set()
        for s in t.split("\n"):
            w = tuple(s.split())
            if w and (w in near or first[w][0] < at or w in seen):
                continue
            seen.add(w)
            out.append(s)
        return "\n".join(out)

    got = lines.dedup_lines(docs)
    assert near and got.columns == docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in got.collect()) == sorted(str((i, brute(at, t))) for at, (i, t) in enumerate(rows))
    assert lines.dedup_lines(none).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def changed(a, b):
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k : k + 1] + b[k : k + 1]


def test_spans(spark, none):
    p = "This first sentence has exactly these nine plain words. " + "Here is a second one of the very same passage with words. " + "And then a third sentence comes to close the passage off."
    data = [(1, "Own start one. " + p + " Own end one."), (2, "Another text begins here now. " + p + "\nIt ends."), (3, p), (4, None), (5, ""), (6, "Clean text. Nothing repeated in it."), (7, p + " " + p)]
    got = {r.doc_id: r.text for r in spans.dedup_spans(spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    assert got[1] == data[0][1] and got[2] == "Another text begins here now. It ends." and got[3] == "" and got[4] is None and got[5] == "" and got[6] == data[5][1] and got[7] == ""
    assert spans.dedup_spans(none).count() == 0
    for t in ("a. b! c", "x\n\n y. z ", ""):
        assert "".join(spans.sentences(t)) == t


def test_quality(spark, docs, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.judge_quality(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    j = got.join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k"))
    k = {r.quality: r.k for r in j.collect()}
    assert k[1] > 0.99 and k.get(0, 0) < 0.5
    assert quality.rule_stats("a b c a b c\nq\nq\n#$ ")[0] == [9, 10, 2, 1, 6] and quality.rule_stats(None)[0] == [0] * 5
    assert quality.judge_quality(docs, labels.limit(0)).count() == docs.count() and quality.judge_quality(none, labels).count() == 0


def test_pages(spark):
    page = """<html><body><header><h1>Site</h1></header><nav><a href=/>home</a></nav><div id="cookie-notice">We use cookies</div>
    <div class="post has-sidebar"><h2>Title &amp; more</h2><div class="post-body"><p>First  para with <a href=x>link</a> and words.<p>Second &eacute;.
    <ul><li>one<li>two</ul></div></div><div class="sidebar"><p>Related</p></div><div class="comments"><p>Reader says hi</p></div><script>var t="</p>";</script><footer>c</footer></body></html>"""
    assert html_text.main_text(page) == "Title & more\nFirst para with link and words.\nSecond é.\none\ntwo"
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "plain <b>text"), (4, "x", "<" * 50_000)], "page_id bigint, url string, html string")
    r = {x.page_id: x for x in html_text.extract_pages(df).collect()}
    assert len(r) == 5 and r[2].text == "" and r[2].n_chars == 0 and r[3].text == "plain text"


@pytest.mark.parametrize("parts", [1, 3])
def test_edited_likeness(spark, docs, none, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = lz.edited_likeness(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
        assert lz.edited_likeness(none).count() == 0 and lz.edited_likeness(docs).count() == docs.count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    d = sorted({i: t or "" for i, t in rows_of(docs) if i is not None}.items(), reverse=True)
    at = {r.doc_id: r for r in got}
    for k, (i, t) in enumerate(d):
        n = d[(k + 1) % len(d)][1]
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        f, g, h = (lz.fingerprint(x) for x in (t, e, n))
        r = at[i]
        assert (r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (hashlib.sha256(e.encode()).hexdigest(), lz.hex_signature(f), lz.hex_signature(g))
        assert r.near_edited == lz.likeness(f, g) and r.near_next == lz.likeness(f, h)


def test_urls(spark):
    rows = [(1, "HTTP://A.Example.ORG/es/3?x"), (2, "http://example.org/en/12"), (3, "http://casino-win.example.net/en/5"), (4, "http://blog.thers.example.net/en/5"), (5, None), (6, "no scheme"), (7, "http://x.com/de/1"), (8, "http://x.org")]
    r = {x.page_id: x for x in urls.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string"), urls.RULES).collect()}
    assert (r[1].host, r[1].path, r[1].rule, r[1].verdict) == ("a.example.org", "/es/3", "example.org/es/", "block")
    assert (r[2].rule, r[2].verdict, r[7].verdict) == ("example.org/en/1", "block", "block")
    assert r[3].verdict == "block" and r[4].verdict == "allow" and r[5].host == r[5].path == r[6].host == "" and r[8].rule is None


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(packing.token_pieces(docs, capacity=64), capacity=64).collect()
    want = []
    for i, t in rows_of(docs):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = packing.cut_points(len(ids), 64)
        want += [str((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))) for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)]))]
    assert sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got) == sorted(want)
    bins: dict = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for off, n in sorted(b):
            assert off == end
            end += n
        assert end <= 64
    assert packing.pack(packing.token_pieces(none)).count() == 0
    sizes = [random.Random(i).randint(600, 900) for i in range(200)]
    first = packing.best_fit(sizes)
    better = packing.local_search(first, sizes)
    assert sorted(i for b in better for i in b) == list(range(200)) and len(better) <= len(first) and all(sum(sizes[i] for i in b) <= 2048 for b in better)


def test_pipeline_and_registry(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "substring_dedup", "best_fit_packing"]
    got = corpus_pipeline.run(spark, SF)
    ids = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    con = duckdb.connect()
    base = {r[0] for r in con.sql(f"select doc_id from '{SF}/documents.parquet' where len(string_split_regex(trim(text, ' \t\n'), '[ \t\n]+')) >= 50").fetchall()}
    assert ids and ids <= base and len(queries.QUERIES) == 13
