"""Samples, targets and edits derived from ``documents`` by integer arithmetic.

Every line is cut into pieces of at most 40 tokens; each piece is a source, so no word is left out. p is the
number of the piece in its document. At even token positions i, b = (131 doc + 31 p + 17 i) mod 23 makes an
error site where b < 4: replace, delete, insert before, replace two. Side k (0: hypothesis, 1 and 2:
references) acts where (b + 7 i + 5 k + p) mod 3 is not 0; every seventh sample has one reference.

The id of a sample is 2**24 doc + p.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrigenda.operators.grouped import GROUPED, grouped_record, ungroup
from corrigenda.tables import spread

TOKENS, PIECES, DOCS = 40, 1 << 24, 1 << 38


def pieces(text: str) -> list[list[str]]:
    lines = ([t for t in line.split(" ") if t] for line in text.split("\n"))
    return [a[k : k + TOKENS] for a in lines for k in range(0, len(a), TOKENS)]


def side_edits(src: list[str], doc: int, p: int, k: int) -> list[tuple[int, int, list[str], str]]:
    """(start, end, new tokens, kind) of the edits of side k."""
    out = []
    for i in range(0, len(src), 2):
        b = (doc * 131 + p * 31 + i * 17) % 23
        if b < 4 and (b + i * 7 + k * 5 + p) % 3:
            v, t = "ab"[(i + k) % 2], src[i]
            out.append(((i, i + 1, [t + v], "R:X"), (i, i + 1, [], "U:X"), (i, i, ["ins" + v], "M:X"), (i, min(i + 2, len(src)), [t + "q" + v], "R:X"))[b])
    return out


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sample with its targets and their edits, in one pass without a shuffle."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                ids, sources, sides, tgt, edits = [], [], [], [], []
                for doc, text in zip(*(c.to_pylist() for c in batch.slice(lo, 64).columns)):
                    for p, src in enumerate(pieces(text or "")):
                        if not 0 <= doc < DOCS or p >= PIECES:
                            raise ValueError("no sample id for this document or piece")
                        ids.append(doc * PIECES + p)
                        sources.append(src)
                        ks = (0, 1) if ids[-1] % 7 == 0 else (0, 1, 2)
                        sides.append(ks)
                        tgt.append([])
                        edits.append([])
                        for k in ks:
                            out, own, at = [], [], 0
                            for a, b, new, kind in side_edits(src, doc, p, k):
                                out += src[at:a]
                                own.append((len(own), a, b, len(out), len(out) + len(new), src[a:b], new, [kind]))
                                out += new
                                at = b
                            tgt[-1].append(out + src[at:])
                            edits[-1].append(own)
                yield grouped_record(["sys"] * len(ids), ids, sources, [["ref" if k else "hyp" for k in ks] for ks in sides], [[max(k - 1, 0) for k in ks] for ks in sides], tgt, edits)

    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id").mapInArrow(run, GROUPED)


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """``samples, targets, edits`` as tables, and ``grouped``, which they are derived from row by row."""
    g = grouped(spark, sf_dir)
    return {**ungroup(g), "grouped": g}


def annotate(tokens: Column) -> Column:
    """Annotations by the look of a token, for want of a tagger: tag by its ending, all depend on the first."""

    def tag(t: Column) -> Column:
        low = F.lower(t)
        of = (
            F.when(~t.rlike("\\p{L}"), ".").when(F.length(t) <= 2, "IN").when(F.length(t) == 3, "DT").when(low.endswith("s"), "NNS")
            .when(low.endswith("ed"), "VBD").when(low.endswith("ng"), "VBG").when(low.endswith("y"), "JJ").otherwise("NN")
        )
        return F.struct(t.alias("text"), low.alias("low"), of.alias("tag"))

    def one(x: Column) -> Column:
        tag = x["tag"]
        pos = F.when(tag == ".", "PUNCT").when(tag == "IN", "ADP").when(tag == "DT", "DET").when(tag.startswith("V"), "VERB").when(tag == "JJ", "ADJ").otherwise("NOUN")
        dep = F.when(tag == ".", "punct").when(tag == "IN", "prep").when(tag == "DT", "det").when(tag == "JJ", "amod").otherwise("dobj")
        return F.struct(x["text"].alias("text"), F.regexp_replace(x["low"], "(ed|ing|s)$", "").alias("lemma"), pos.alias("pos"), tag.alias("tag"), dep.alias("dep"), F.lit(0).alias("head"))

    # tags first: each is made once, however often it is asked for
    return F.transform(F.transform(tokens, tag), one)
