"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space beyond ASCII, sentence ends, punctuation, CJK ranges.
SPACES = r"[\s\u0085   -     　\u001c-\u001f]"
ENDS = {"eng": ".!?", "zho": "。！？…", "all": ".!?。！？…"}
PUNCT = r"^[!-/:-@\[-`{-~，。！？；：、（）《》“”‘’…—【】]+$"
CJK = r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{20000}-\x{2a6df}\x{2a700}-\x{2ebef}\x{f900}-\x{faff}\x{2f800}-\x{2fa1f}"
MISSING = "[缺失成分]"


def tokenize(text: Column) -> Column:
    return F.filter(F.split(text, SPACES + "+"), lambda t: t != "")


def detokenize(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def remove_space(text: Column) -> Column:
    return F.regexp_replace(text, SPACES + "+", "")


def char_tokens(text: Column) -> Column:
    """Characters without white space; the marker of a missing part is one token."""
    return F.regexp_extract_all(remove_space(text), F.lit(r"(\[缺失成分\]|.)"), 1)


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def is_punct(text: Column) -> Column:
    return text.rlike(PUNCT)


def all_cjk(text: Column) -> Column:
    return text.rlike(f"^[{CJK}]+$")


def has_cjk(text: Column) -> Column:
    return text.rlike(f"[{CJK}]")


def split_sentences(text: Column, lang: str = "all", limit: int = 510) -> Column:
    """Cut behind sentence ends (and a closing quote), then hard at ``limit`` characters."""
    marked = F.regexp_replace(text, rf"([{ENDS[lang]}]+[”\"’']?)", "$1\n")
    parts = F.filter(F.transform(F.split(marked, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    cut = F.transform(parts, lambda s: F.transform(F.sequence(F.lit(0), ((F.length(s) - 1) / limit).cast("int")), lambda k: F.substring(s, k * limit + 1, F.lit(limit))))
    return F.flatten(cut)


def subword_words(subwords: Column) -> Column:
    """Word number of every subword, where ``@@`` at the end joins it to the next."""
    ends = F.aggregate(
        subwords, F.struct(F.lit(0).alias("w"), F.array().cast("array<int>").alias("out")),
        lambda s, t: F.struct((s["w"] + F.when(t.endswith("@@"), 0).otherwise(1)).cast("int").alias("w"), F.concat(s["out"], F.array(s["w"])).alias("out")),
        lambda s: s["out"],
    )
    return ends


def is_rotation(a: Column, b: Column) -> Column:
    return (F.length(a) == F.length(b)) & F.contains(F.concat(a, a), b)


def normalized_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def same_spelling(a: Column, b: Column, similar: Column | None = None) -> Column:
    """Same length, and a permutation of characters or (where given) similar enough in shape and sound."""
    perm = F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, ""))
    return (F.length(a) == F.length(b)) & (perm if similar is None else perm | (similar >= 0.8))


def simplify(text: Column, traditional: str, simplified: str) -> Column:
    """Characters replaced by a user's mapping table."""
    return F.translate(text, traditional, simplified)
