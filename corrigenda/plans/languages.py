"""What depends on the language of the texts, under one name: tokens, extraction of edits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrigenda.functions.text import char_tokens, tokenize
from corrigenda.operators.chinese import Lexical, chinese_edits, merge_chinese
from corrigenda.operators.english import annotated_edits, english_edits, plain_stem
from corrigenda.operators.extract import align_pairs, merge_steps, parallel_to_edits, to_edits

#: Strategies that need nothing but the steps of an alignment.
STEPWISE = ("split", "merge", "equal")


@dataclass(frozen=True)
class Language:
    """``tokens`` of a text column, the ``text`` of tokens, and ``edits(pairs, strategy, **given)`` of pairs of token arrays."""

    tokens: Callable[[Column], Column]
    text: Callable[[Column], Column]
    edits: Callable[..., DataFrame]


def _plain(pairs: DataFrame, strategy: str = "rules") -> DataFrame:
    return parallel_to_edits(pairs, strategy)


def _english(pairs: DataFrame, strategy: str = "rules", annotate: Callable[[Column], Column] | None = None, words: DataFrame | None = None, stem: Callable[[Column], Column] | DataFrame = plain_stem) -> DataFrame:
    """Annotations are in ``src_ann, tgt_ann``, or made by ``annotate`` from the tokens; without either, by what text alone shows."""
    if annotate is not None:
        pairs = pairs.withColumns({f"{s}_ann": annotate(F.col(f"{s}_tokens")) for s in ("src", "tgt")})
    if "src_ann" not in pairs.columns:
        return parallel_to_edits(pairs, strategy)
    if strategy == "rules":
        return english_edits(pairs, words, stem)
    more = {f"{s}_{x}": F.col(f"{s}_ann.{x}") for s in ("src", "tgt") for x in ("lemma", "pos")}
    return annotated_edits(pairs, merge_steps(align_pairs(pairs.withColumns(more)), strategy), words, stem)


def _chinese(pairs: DataFrame, strategy: str = "rules", words: bool = False, classes: DataFrame | None = None, confusions: DataFrame | None = None, sounds: DataFrame | None = None, heuristic: bool = True) -> DataFrame:
    """Over characters, or over ``words`` (with ``src_tags, tgt_tags``, if there are any); the tables are those of ``lexicon``."""
    if strategy in STEPWISE:
        return to_edits(pairs, merge_steps(align_pairs(pairs), strategy))
    return chinese_edits(pairs, merge_chinese(pairs, Lexical(classes, confusions, sounds), words, heuristic))


LANGUAGES: dict[str, Language] = {
    "plain": Language(tokenize, lambda t: F.array_join(t, " "), _plain),
    "eng": Language(tokenize, lambda t: F.array_join(t, " "), _english),
    "zho": Language(char_tokens, lambda t: F.array_join(t, ""), _chinese),
}


def language(name: str | Language) -> Language:
    """A language by its name, or one of the caller's own."""
    if isinstance(name, Language):
        return name
    if name not in LANGUAGES:
        raise ValueError(f"{name!r} is none of {', '.join(LANGUAGES)}")
    return LANGUAGES[name]


def tokenized(texts: DataFrame, lang: str | Language) -> dict[str, DataFrame]:
    """``samples, targets`` from ``system_id, sample_id, source, targets array<string>, side``, by the language's tokens."""
    of = language(lang).tokens
    each = texts.select("system_id", "sample_id", "side", F.posexplode("targets").alias("target_id", "text"))
    return {
        "samples": texts.select("system_id", "sample_id", of(F.col("source")).alias("src_tokens")),
        "targets": each.select("system_id", "sample_id", "side", F.col("target_id").cast("int").alias("target_id"), of(F.col("text")).alias("tgt_tokens")),
    }
