"""Languages, own scorers, settings of the evaluation, small tables, reports."""

import pytest
from pyspark.sql import functions as F

from corrigenda.operators import vocabulary as U
from corrigenda.plans import evaluate as V
from corrigenda.plans import reports as P
from corrigenda.plans.languages import LANGUAGES, Language, tokenized
from corrigenda.plans.testbed import annotate, tables

SF = "/root/testdata/sf0.001"
TEXTS = "system_id string, sample_id bigint, side string, source string, targets array<string>"


def few(spark):
    return {k: v.where("sample_id % 89 = 2") for k, v in tables(spark, SF).items()}


def test_two_languages_by_one_entry(spark):
    eng = spark.createDataFrame([("s", 0, "hyp", "This are a tset", ["This is a test"]), ("s", 0, "ref", "This are a tset", ["This is a test", "These are a test"])], TEXTS)
    zho = spark.createDataFrame([("s", 0, "hyp", "我中学文", ["我学中文"]), ("s", 0, "ref", "我中学文", ["我学中文", "我学文"])], TEXTS)
    sounds = spark.createDataFrame([("中", ["zhong"])], "char string, sounds array<string>")
    for name, texts, given, types in (("eng", eng, {"annotate": annotate}, {"R:"}), ("zho", zho, {"sounds": sounds}, {"T", "U"}), ("plain", eng, {}, {"R:"})):
        d = tokenized(texts, name)
        d["samples"] = d["samples"].distinct()
        got = V.with_edits(d, lang=name, **given)["edits"].collect()
        assert got and {r.types[0] if name == "zho" else r.types[0][:2] for r in got} <= types
        score, m = V.evaluate(d, "chunk", language=name, given=given)
        assert score.first().num_sample == 1 and score.first().f == 1.0
    own = Language(*[getattr(LANGUAGES["plain"], x) for x in ("tokens", "text")], lambda pairs, strategy: LANGUAGES["plain"].edits(pairs, "split"))
    assert V.with_edits(tokenized(eng, own), lang=own)["edits"].count() >= 5
    for lang in ("split", "merge", "equal"):
        assert V.with_edits(tokenized(zho, "zho"), strategy=lang, lang="zho")["edits"].count() > 0
        assert V.with_edits(tokenized(eng, "eng"), strategy=lang, lang="eng", annotate=annotate)["edits"].count() > 0
    with pytest.raises(ValueError):
        V.with_edits(tokenized(eng, "eng"), lang="none")


def test_own_scorers(spark):
    d = few(spark)
    hits = lambda counts, how: counts.groupBy("system_id").agg(F.sum("tp").alias("hits"), F.lit(how.beta).alias("beta"))
    want = V.evaluate(d)[1].where("outcome = 'tp'").count()
    assert V.evaluate(d, scorer=hits)[0].first().hits == want
    V.SCORERS.pop("hits", None)
    V.register_scorer("hits", hits)
    with pytest.raises(ValueError):
        V.register_scorer("hits", hits)
    assert V.evaluate(d, scorer="hits", beta=1.0)[0].first().asDict() == {"system_id": "sys", "hits": want, "beta": 1.0}
    with pytest.raises(ValueError):
        V.evaluate(d, scorer="none")


def test_unchanged_references_go(spark):
    rows = [("s", 1, "hyp", 0, ["b"]), ("s", 1, "ref", 0, ["a"]), ("s", 1, "ref", 1, ["b"]), ("s", 2, "hyp", 0, ["c"]), ("s", 2, "ref", 0, ["c"])]
    d = {"samples": spark.createDataFrame([("s", 1, ["a"]), ("s", 2, ["c"])], "system_id string, sample_id bigint, src_tokens array<string>"), "targets": spark.createDataFrame(rows, "system_id string, sample_id bigint, side string, target_id int, tgt_tokens array<string>")}
    assert {(r.sample_id, r.ref_id) for r in V.evaluate(d, drop_unchanged=True)[1].collect()} == {(1, 1), (2, 0)}
    assert {(r.sample_id, r.ref_id) for r in V.evaluate(d)[1].collect()} == {(1, 0), (1, 1), (2, 0)}


def test_many_systems_in_one_pass(spark):
    d = few(spark)
    names = spark.createDataFrame([(f"sys{k}", k) for k in range(50)], "name string, k int")
    many = {t: v.crossJoin(F.broadcast(names)).withColumn("system_id", F.col("name")).drop("name", "k") for t, v in d.items()}
    one = V.evaluate(d, weigher="length")[0].drop("system_id").first()
    got = V.evaluate(many, weigher="length")[0]
    assert got.count() == 50 and {r for r in got.drop("system_id").collect()} == {one}
    # scans of the texts do not follow the number of systems
    counts = V._counts(many, V.G.drop_empty_refs(many["grouped"]), V.Setting(weigher="length"))[0]
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 2


def test_vocabulary(spark):
    types = U.edit_type_table(spark)
    assert types.count() == 55 and {r.type: r.type_no for r in types.collect()}["R:SPELL"] == 32
    assert [r.type_no for r in U.edit_type_table(spark, "zho").orderBy("type_no").collect()] == [0, 1, 2, 3]
    e = spark.createDataFrame([(1, ["UNK"]), (2, ["R:VERB:SVA", "X"]), (3, []), (4, None), (5, ["no"])], "id int, types array<string>")
    assert {r.id: r.type_no for r in U.numbered_types(e, types).collect()} == {1: 54, 2: 36, 3: None, 4: None, 5: None}
    assert {(r.type, r.n) for r in U.unknown_types(e, types).collect()} == {("X", 1), ("no", 1)}
    with pytest.raises(ValueError):
        U.looked_up(e, "id", types.unionByName(types), "type", "type_no")
    tags = {r.tag: r.category for r in U.tag_table(spark).collect()}
    assert tags["PRP$"] == "DET" and tags["VBZ"] == "VERB" and len(tags) == 57


def test_large_tables_are_joined(spark, monkeypatch):
    monkeypatch.setattr(U, "SMALL", 3)
    e = spark.createDataFrame([("UNK",), ("?",)], "t string")
    assert {r.t: r.type_no for r in U.looked_up(e, "t", U.edit_type_table(spark), "type", "type_no").collect()} == {"UNK": 54, "?": None}


GRID = """\
╒═══════════╤═════════════════════╤════════╤════════╤════════╤════════╤════════╤════════╤════════╤════════╕
│ system_id │ metric              │ F      │ P      │ R      │ ACC    │ TP     │ FP     │ FN     │ TN     │
╞═══════════╪═════════════════════╪════════╪════════╪════════╪════════╪════════╪════════╪════════╪════════╡
│ a         │ corpus_unweighted   │ 0.5000 │ 0.2500 │ 1.0000 │ 0.1235 │ 1.0000 │ 3.0000 │ 0.0000 │ 7.0000 │
├───────────┼─────────────────────┼────────┼────────┼────────┼────────┼────────┼────────┼────────┼────────┤
│ a         │ corpus_weighted     │ 0.5000 │ 0.2500 │ 1.0000 │ N/A    │ 1.5000 │ 3.0000 │ 0.0000 │ 7.0000 │
├───────────┼─────────────────────┼────────┼────────┼────────┼────────┼────────┼────────┼────────┼────────┤
│ b         │ sentence_unweighted │ 0.1000 │ 0.2500 │ 1.0000 │ 0.5000 │ 1.0000 │ 3.0000 │ 0.0000 │ 7.0000 │
╘═══════════╧═════════════════════╧════════╧════════╧════════╧════════╧════════╧════════╧════════╧════════╛"""


def test_tables_for_people(spark):
    rows = [("sentence", False, "b", 0.1, 0.25, 1.0, 0.5, 1.0, 3.0, 0.0, 7.0), ("corpus", True, "a", 0.5, 0.25, 1.0, None, 1.5, 3.0, 0.0, 7.0), ("corpus", False, "a", 0.5, 0.25, 1.0, 0.12345678, 1.0, 3.0, 0.0, 7.0)]
    scores = spark.createDataFrame(rows, "level string, weighted boolean, system_id string, f double, p double, r double, acc double, tp double, fp double, fn double, tn double")
    assert P.drawn(P.score_table(scores, "prf")) == GRID
    wide = P.side_by_side(scores, "f")
    assert wide.columns == ["system_id", "corpus_unweighted", "corpus_weighted", "sentence_unweighted", "sentence_weighted"]
    assert sorted(map(tuple, wide.collect())) == [("a", 0.5, 0.5, None, None), ("b", None, None, 0.1, None)]
    assert "N/A" in P.drawn(P.score_table(scores.drop("tn"), "heuo")) and P.drawn(wide).count("\n") == 6
    assert P.score_table(scores, "gleu").columns == ["system_id", "metric", "score", "std"]


def test_four_scores_have_all_columns(spark):
    got = V.evaluate_all(few(spark), "chunk")
    assert {(r.level, r.weighted) for r in got.collect()} == set(P.KEYS) and "f" in got.columns
    assert P.drawn(P.score_table(V.evaluate_all(few(spark), "heuo"), "heuo")).count("\n") == 10
