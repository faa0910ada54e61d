"""Block files of any kind, listing, options of readers and writers, merging of annotations."""

import gzip
import random

import pytest

from corrigenda import model
from corrigenda.operators import edits as E
from corrigenda.sources.blocks import read_blocks, write_blocks
from corrigenda.sources.files import first_samples, list_files, places, text_blocks
from corrigenda.sources.nested import read_json, read_parallel, write_json

SAMPLES = [
    ["S a b c", "A 1 2|||R:X|||x y|||REQUIRED|||-NONE-|||0", "A 0 1|||U:X||||||REQUIRED|||-NONE-|||1"],
    ["S d e", "A -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||0"],
    ["S f", "T0 ", "A 0 1|||U:X||||||REQUIRED|||-NONE-|||0", "T1 f"],
    ["S g h i", "A 3 3|||M:X|||j|||REQUIRED|||-NONE-|||0"],
]
WANT = {(0, 0): "a x y c", (0, 1): "b c", (1, 0): "d e", (2, 0): "", (2, 1): "f", (3, 0): "g h i j"}


def texts(d):
    return {(r.sample_id, r.target_id): " ".join(r.tgt_tokens) for r in d["targets"].collect()}


@pytest.mark.parametrize("ends", ["\n", "\r\n", "mixed", "gz"])
def test_line_ends_and_compression(spark, tmp_path, ends):
    rng = random.Random(1)
    end = lambda: rng.choice(["\n", "\r\n"]) if ends == "mixed" else "\r\n" if ends == "\r\n" else "\n"
    body = "﻿" if ends == "\r\n" else ""
    for k, sample in enumerate(SAMPLES):
        body += "".join(line + end() for line in sample) + "".join(rng.choice(["", " \t"]) + end() for _ in range(1 + k))
    path = tmp_path / ("in.gz" if ends == "gz" else "in")
    path.write_bytes(gzip.compress(body.encode()) if ends == "gz" else body.encode())
    got = read_blocks(spark, str(path), "s", "ref")
    sources = {r.sample_id: r.src_tokens for r in got["samples"].collect()}
    assert [" ".join(sources[k]).lstrip("﻿") for k in range(4)] == ["a b c", "d e", "f", "g h i"] and texts(got) == WANT
    assert E.invalid_edits(got["samples"], got["targets"], got["edits"]).count() == 0


@pytest.mark.parametrize("size", [7, 64, 1000])
def test_blocks_over_splits(spark, tmp_path, size):
    rng = random.Random(size)
    blocks = [[f"{k}-{i} " + "x" * rng.randint(0, 40) for i in range(rng.randint(1, 6))] for k in range(200)]
    cut = 120
    for name, part in (("a", blocks[:cut]), ("b", blocks[cut:])):
        (tmp_path / name).write_bytes("".join(rng.choice(["", "\n", "\r\n"]) * (k == 0) + "".join(line + rng.choice(["\n", "\r\n"]) for line in b) + rng.choice(["\n", "\n \n", "\r\n\r\n"]) for k, b in enumerate(part)).rstrip().encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        got = {r.sample_id: r.lines for r in text_blocks(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert [[x.rstrip() for x in got[k]] for k in range(200)] == [[x.rstrip() for x in b] for b in blocks]


def test_characters_and_first_blocks(spark, tmp_path):
    (tmp_path / "in").write_text("S 我 们好\nA 1 2|||S|||好 的|||REQUIRED|||-NONE-|||0\n\nS 二\n\nS 三\n")
    got = read_blocks(spark, str(tmp_path / "in"), "s", "ref", char_level=True, max_sample=2)
    assert texts(got) == {(0, 0): "我 好 的 好", (1, 0): "二"}
    assert [(r.src_start, r.tgt_end, r.tgt_tokens) for r in got["edits"].collect()] == [(1, 3, ["好", "的"])]
    assert read_blocks(spark, str(tmp_path / "in"), "s", max_sample=0)["samples"].count() == 0
    (tmp_path / "none").write_text(" \n\n")
    assert read_blocks(spark, str(tmp_path / "none"), "s")["samples"].count() == 0


def test_listing(spark, tmp_path):
    for name in ("b.txt", "a.txt", "skip.log", "sub/c.txt", "sub/d.log"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("S x\n")
    short = lambda **more: [p.removeprefix(f"file:{tmp_path}/") for p in list_files(spark, str(tmp_path), **more)]
    assert short() == ["a.txt", "b.txt", "skip.log"]
    assert short(exclude=["*.log"], recursive=True) == ["a.txt", "b.txt", "sub/c.txt"]
    assert short(recursive=True, exclude=["sub/*"], limit=2) == ["a.txt", "b.txt"]
    with pytest.raises(ValueError):
        short(exclude=["*"])
    assert read_blocks(spark, list_files(spark, str(tmp_path), recursive=True), "s")["samples"].count() == 5


def dataset(spark, tmp_path, **options):
    (tmp_path / "in").write_text("\n\n".join("\n".join(s) for s in SAMPLES))
    return read_blocks(spark, str(tmp_path / "in"), "s", "ref", **options)


def test_options_of_readers(spark, tmp_path):
    one = lambda n: dataset(spark, tmp_path, **n)
    assert texts(one({"remove_empty": True})) == {**{k: v for k, v in WANT.items() if k[0] != 2}, (2, 0): "f"}
    got = one({"remove_unchanged": True})
    assert texts(got) == {(0, 0): "a x y c", (0, 1): "b c", (2, 0): "", (3, 0): "g h i j"}
    assert got["edits"].count() == 4 and E.invalid_edits(got["samples"], got["targets"], got["edits"]).count() == 0
    assert texts(one({"remove_whitespace": True})) == {k: v.replace(" ", "") for k, v in WANT.items()}
    got = one({"flatten": True, "remove_empty": True})
    assert texts(got) == {(0, 0): "a x y c", (1, 0): "b c", (2, 0): "d e", (3, 0): "f", (4, 0): "g h i j"}
    assert {r.sample_id: len(r.src_tokens) for r in got["samples"].collect()} == {0: 3, 1: 3, 2: 2, 3: 1, 4: 3}
    assert E.invalid_edits(got["samples"], got["targets"], got["edits"]).count() == 0
    (tmp_path / "bad").write_text("S \nA -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||0\n")
    assert read_blocks(spark, str(tmp_path / "bad"), "s")["samples"].count() == 1
    with pytest.raises(Exception, match="no source"):
        read_blocks(spark, str(tmp_path / "bad"), "s", remove_empty=True)["samples"].collect()


def test_options_of_writers_in_both_formats(spark, tmp_path):
    d = dataset(spark, tmp_path)
    tables = d["samples"], d["targets"], d["edits"]
    same = lambda got: (texts(got), {r.sample_id: tuple(r.src_tokens) for r in got["samples"].collect()}, got["edits"].count())
    for texts_too in (False, True):
        path = str(tmp_path / f"blocks{texts_too}")
        write_blocks(*tables, path, texts=texts_too)
        assert same(read_blocks(spark, path, "s", "ref")) == same(d)
    lines = [r.value for r in spark.read.text(str(tmp_path / "blocksTrue")).collect()]
    assert "T1 f" in lines and "T0 d e" in lines and not any("noop" in x for x in lines)
    for n, left in ((-1, 4), (0, 0), (2, 2)):
        write_blocks(*tables, str(tmp_path / f"b{n}"), max_sample=n)
        write_json(*tables, str(tmp_path / f"j{n}"), max_sample=n)
        assert read_blocks(spark, str(tmp_path / f"b{n}"), "s", "ref")["samples"].count() == left
        assert {r.sample_id for r in read_json(spark, str(tmp_path / f"j{n}"))["samples"].collect()} == set(range(left))
        assert read_json(spark, str(tmp_path / "j-1"), max_sample=n)["samples"].count() == left
    write_json(*tables, str(tmp_path / "flat"), flatten=True, max_sample=3)
    assert texts(read_json(spark, str(tmp_path / "flat"))) == {(0, 0): "a x y c", (1, 0): "b c", (2, 0): "d e"}
    write_blocks(*tables, str(tmp_path / "flatb"), flatten=True)
    assert texts(read_blocks(spark, str(tmp_path / "flatb"), "s", "ref")) == dict(enumerate_texts())


def enumerate_texts():
    return (((k, 0), WANT[key]) for k, key in enumerate(sorted(WANT)))


def test_parallel_text_with_options(spark, tmp_path):
    (tmp_path / "s").write_text("a b\nc d\n")
    (tmp_path / "t").write_text("a b\ta x\n\tc d\n")
    got = read_parallel(spark, str(tmp_path / "s"), str(tmp_path / "t"), "x", remove_unchanged=True)
    assert texts(got) == {(0, 0): "a x", (1, 0): ""}
    assert texts(read_parallel(spark, str(tmp_path / "s"), str(tmp_path / "t"), "x", remove_empty=True, max_sample=1)) == {(0, 0): "a b", (0, 1): "a x"}


def test_places_and_first_of_each_system(spark):
    rng = random.Random(4)
    rows = [(s, i * 5, []) for s in ("a", "b", "c") for i in range(rng.randint(50, 90))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, model.SAMPLES).repartition(7)
    at = {(r.system_id, r.sample_id): r.at for r in places(df, ["system_id", "sample_id"], "at").collect()}
    assert at == {k: i for i, k in enumerate(sorted(r[:2] for r in rows))}
    assert {(r.system_id, r.sample_id) for r in first_samples(df, 3).collect()} == {(s, i) for s in "abc" for i in (0, 5, 10)}
    assert places(df.limit(0), ["sample_id"], "at").count() == 0


def test_merging_of_annotations(spark, tmp_path):
    d = dataset(spark, tmp_path)
    both = E.merge_annotations(d, d)
    assert texts(both) == {**WANT, (0, 2): "a x y c", (0, 3): "b c", (1, 1): "d e", (2, 2): "", (2, 3): "f", (3, 1): "g h i j"}
    assert E.invalid_edits(both["samples"], both["targets"], both["edits"]).count() == 0 and both["edits"].count() == 2 * d["edits"].count()
    for other in (d["samples"].where("sample_id > 0"), d["samples"].withColumn("src_tokens", __import__("pyspark").sql.functions.reverse("src_tokens"))):
        with pytest.raises(ValueError, match="one source"):
            E.merge_annotations(d, {**d, "samples": other})
