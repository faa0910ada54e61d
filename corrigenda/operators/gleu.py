"""The n-gram metric."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrigenda.model import KEYS
from corrigenda.operators.extract import slices
from corrigenda.operators.grouped import mapped

ORDER = 4
#: Rows whose n-grams are counted at a time.
ROWS = 2048


def ngrams(tokens: Column, n: int) -> Column:
    some = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1))), lambda i: F.slice(tokens, i, n))
    return F.when(F.size(tokens) >= n, some).otherwise(F.array().cast("array<array<string>>"))


def ngram_counts(df: DataFrame, keys: list[str], tokens: str, order: int = ORDER, unique: bool = False) -> DataFrame:
    """``keys, n, gram, c``. Where no two rows share their keys (``unique``) a row's own counts are all there is, and nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                values = part.column(len(keys)).flatten()
                size = part.column(len(keys)).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(len(size)), size)
                left = np.repeat(np.cumsum(size), size) - np.arange(len(values))  # tokens of the row from here on
                coded = values.dictionary_encode(null_encoding="encode")
                token = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                gram = np.zeros(len(token), np.int64)
                for n in range(1, order + 1):
                    at = np.flatnonzero(left >= n)
                    gram[at] = np.unique(gram[at] * (len(coded.dictionary) + 1) + token[at + n - 1], return_inverse=True)[1]
                    first, count = np.unique(owner[at] * (len(token) + 1) + gram[at], return_index=True, return_counts=True)[1:]
                    start = at[first]
                    own = [part.column(k).take(pa.array(owner[start])) for k in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(start), n), pa.int32()), slices(values, start, np.full(len(start), n)), pa.array(count, pa.int64())], names=[*keys, "n", "gram", "c"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    e = df.select(*keys, F.col(tokens)).mapInArrow(run, f"{kinds}, n int, gram array<string>, c bigint")
    return e if unique else e.groupBy(*keys, "n", "gram").agg(F.sum("c").alias("c"))


def gleu_parts(g: DataFrame, order: int = ORDER) -> DataFrame:
    """Per (sample, reference, n): clipped overlap with the reference, less that with grams only the source has.

    ``g`` has one row per sample (see ``grouped``); grams never leave it. Samples without a hypothesis have no parts.
    """

    def rows(src, targets):
        hyp = next((t[2] for t in targets if t[0] == "hyp"), None)
        if hyp is None:
            return
        grams = lambda t: [list(zip(*(t[i:] for i in range(n)))) for n in range(1, order + 1)]
        of_hyp, of_src = grams(hyp), grams(src)
        sets, src_sets = [set(h) for h in of_hyp], [set(s) for s in of_src]
        # grams that the hypothesis has once count 1 wherever they are found; only the others need numbers
        more = [{g: c for g, c in Counter(h).items() if c > 1} if len(h) > len(u) else {} for h, u in zip(of_hyp, sets)]
        for side, ref, tokens in targets:
            if side == "ref":
                for n, (u, r, s) in enumerate(zip(sets, grams(tokens), src_sets), 1):
                    own = set(r)
                    x = len(u & own) - len((u - own) & s)
                    for g, c in more[n - 1].items():
                        if g in own:
                            x += min(c, r.count(g)) - 1
                        elif g in s:
                            x -= min(c, of_src[n - 1].count(g)) - 1
                    yield ref, n, max(x, 0), max(len(hyp) + 1 - n, 0), len(hyp), len(tokens)

    return mapped(g, "system_id string, sample_id bigint, ref_id int, n int, numerator bigint, denominator bigint, hyp_len int, ref_len int", rows, "tgt_tokens")


def gleu_corpus(parts: DataFrame, smoothing: bool = False, order: int = ORDER) -> DataFrame:
    """Expected score of drawing a reference per sample at random: numbers are averaged over its references."""
    one = parts.groupBy(*KEYS, "n").agg(*[F.avg(c).alias(c) for c in ("numerator", "denominator", "hyp_len", "ref_len")])
    t = one.groupBy("system_id", "n").agg(*[F.sum(c).alias(c) for c in ("numerator", "denominator", "hyp_len", "ref_len")])
    fix = (lambda c: F.when(F.col(c) == 0, 1.0).otherwise(F.col(c))) if smoothing else F.col
    log = F.sum(F.log(fix("numerator") / fix("denominator"))) / order
    return t.groupBy("system_id").agg(F.exp(F.least(F.lit(0.0), 1 - F.max("ref_len") / F.max("hyp_len")) + log).alias("score"))


def gleu_corpus_sampled(parts: DataFrame, num_iter: int = 500, seed: int = 0, order: int = ORDER) -> DataFrame:
    """The same with ``num_iter`` seeded draws of a reference per sample."""
    refs = parts.select(*KEYS, "ref_id").distinct().groupBy(*KEYS).agg(F.sort_array(F.collect_list("ref_id")).alias("ids"))
    draw = refs.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(num_iter)))).withColumn("ref_id", F.col("ids")[(F.pmod(F.xxhash64(*KEYS, "i", F.lit(seed)), F.size("ids"))).cast("int")])
    times = draw.groupBy(*KEYS, "ref_id").agg(F.count("*").alias("k"))
    t = parts.join(times, [*KEYS, "ref_id"]).groupBy("system_id", "n").agg(*[F.sum(F.col(c) * F.col("k")).alias(c) for c in ("numerator", "denominator", "hyp_len", "ref_len")])
    log = F.sum(F.log(F.col("numerator") / F.col("denominator"))) / order
    return t.groupBy("system_id").agg(F.exp(F.least(F.lit(0.0), 1 - F.max("ref_len") / F.max("hyp_len")) + log).alias("score"))


def gleu_sentence(parts: DataFrame, order: int = ORDER) -> DataFrame:
    """Mean and population deviation over all (sample, reference) pairs; zero counts and lengths become 1."""
    fix = lambda c: F.when(F.col(c) == 0, 1.0).otherwise(F.col(c))
    one = parts.groupBy(*KEYS, "ref_id").agg(
        F.exp(F.least(F.lit(0.0), 1 - F.max(fix("ref_len")) / F.max(fix("hyp_len"))) + F.sum(F.log(fix("numerator") / fix("denominator"))) / order).alias("s")
    )
    return one.groupBy("system_id").agg(F.avg("s").alias("score"), F.stddev_pop("s").alias("std"))
