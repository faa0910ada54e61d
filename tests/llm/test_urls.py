"""N-grams of urls against plain slices, and urls of any length."""

import time

from pyspark.sql import functions as F

from corrigenda.llm import urls


def test_ngrams_equal_slices(spark):
    texts = ["", "a", "ab", "abc", "a.b-c/d", "héé\U0001f600x", "x" * 300, "a\tb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for sizes in ((3,), (3, 4), (1, 5)):
        for r in df.select("t", urls.ngrams(F.col("t"), "h", sizes).alias("g")).collect():
            framed = f"^{r.t}$"
            assert r.g == ["h" + framed[i : i + n] for n in sizes for i in range(len(framed) - n + 1)]


def test_a_url_of_a_million_characters(spark):
    df = spark.range(1).select(F.lit(1).cast("long").alias("page_id"), F.concat(F.lit("http://host.org/"), F.repeat(F.lit("abcdefghij"), 100_000)).alias("url"))
    t = time.time()
    r = urls.judge_urls(df, urls.RULES).first()
    assert len(r.path) == 1_000_001 and r.host == "host.org" and time.time() - t < 120
