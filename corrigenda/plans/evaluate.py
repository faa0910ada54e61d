"""The public entry: validate, prepare, match, weigh, score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrigenda.model import KEYS
from corrigenda.operators import edits as E
from corrigenda.operators import gleu as L
from corrigenda.operators import grouped as G
from corrigenda.operators import outcomes as O
from corrigenda.operators import scores as S
from corrigenda.operators import weights as W
from corrigenda.plans.languages import Language, language
from corrigenda.sources.nested import persist as write_results
from corrigenda.tables import saved

#: Factors (hit, err, und, ove) of ``adapt``, by level and whether counts are weighted.
ADAPTED = {
    ("corpus", False): (0.60, 0.10, 0.10, 0.20), ("corpus", True): (0.60, 0.30, 0.05, 0.05),
    ("sentence", False): (0.60, 0.10, 0.05, 0.25), ("sentence", True): (0.15, 0.35, 0.35, 0.15),
}
#: Weighers that need pseudo-hypotheses: matches, samples, targets, chunks, similarity -> matches with ``weight``.
BY_TEXT: dict[str, Callable[..., DataFrame]] = {"similarity": W.weigh_by_similarity, "replacement": W.weigh_by_replacement}
#: Scorers of the caller's own by name: counts per reference, setting -> scores. Added by ``register_scorer``.
SCORERS: dict[str, Callable[[DataFrame, Setting], DataFrame]] = {}
#: What the library scores by itself.
METRICS = ("edit", "chunk", "heuo", "gleu")


def register_scorer(name: str, scorer: Callable[[DataFrame, Setting], DataFrame]) -> None:
    """A scorer for ``evaluate(..., scorer=name)``: a function of the counts (a row for each reference of a sample) and the setting."""
    if name in SCORERS:
        raise ValueError(f"there is a scorer {name!r}")
    SCORERS[name] = scorer


@dataclass(frozen=True)
class Setting:
    """What to evaluate.

    metric: ``edit``, ``chunk`` (p, r, f, acc), ``heuo`` (hit, err, und, ove, com) or ``gleu``. weigher:
    ``none``, ``length``, a name of ``BY_TEXT``, or such a function. ``sim`` maps two token columns to a
    similarity, or is a job over pairs. ``factors`` of ``heuo``: by level where None, or ``ADAPTED`` with
    ``adapt``. ``scorer``: a name of ``SCORERS`` or such a function, in the place of the metric's own.
    ``drop_unchanged``: references that equal their source go first, if another stays. ``language`` (a name or
    the caller's own) extracts missing edits, with what is ``given`` to it.
    """

    metric: str = "chunk"
    assumption: str = "dependent"
    weigher: str | Callable[..., DataFrame] = "none"
    level: str = "corpus"
    detection: bool = False
    preset: W.LengthPreset = field(default=W.CORPUS)
    sim: Callable[[Column, Column], Column] = W.token_f1
    beta: float = S.BETA
    factors: tuple[float, float, float, float] | None = None
    adapt: bool = False
    merge_distance: int = 0
    smoothing: bool = False
    scorer: str | Callable[[DataFrame, Setting], DataFrame] | None = None
    drop_unchanged: bool = False
    language: str | Language = "plain"
    given: dict = field(default_factory=dict)

    def __post_init__(self):
        for value, known in ((self.metric, METRICS), (self.assumption, ("dependent", "independent")), (self.level, ("corpus", "sentence"))):
            if value not in known:
                raise ValueError(f"{value!r} is none of {', '.join(known)}")
        if isinstance(self.weigher, str) and self.weigher not in ("none", "length", *BY_TEXT):
            raise ValueError(f"unknown weigher {self.weigher!r}")
        if isinstance(self.scorer, str) and self.scorer not in SCORERS:
            raise ValueError(f"unknown scorer {self.scorer!r}")


def dataset(hyp: dict[str, DataFrame], ref: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Stacks hypothesis and references of the same samples; references serve every system."""
    names = hyp["samples"].select("system_id", "sample_id")
    spread = lambda d: d.drop("system_id").join(names, "sample_id")
    out = {"samples": hyp["samples"]}
    for t in ("targets", "edits"):
        r = spread(ref[t]).withColumn("side", F.lit("ref"))
        out[t] = hyp[t].withColumn("side", F.lit("hyp")).unionByName(r.select(*hyp[t].columns))
    return out


def with_edits(data: dict[str, DataFrame], refresh: bool = False, strategy: str = "rules", lang: str | Language = "plain", **given) -> dict[str, DataFrame]:
    """``data`` with edits: those of targets that have none are extracted; with ``refresh``, of all targets.

    A target that equals its source has none, and needs none. The language says how; ``given`` are tables and
    settings of its own.
    """
    extract = language(lang).edits
    pairs = data["targets"].join(data["samples"], KEYS)
    if refresh or "edits" not in data:
        return {**data, "edits": extract(pairs, strategy, **given)}
    key = [*KEYS, "side", "target_id"]
    bare = pairs.join(data["edits"].select(*key).distinct(), key, "left_anti")
    found = extract(bare, strategy, **given)
    return {**{k: v for k, v in data.items() if k != "grouped"}, "edits": data["edits"].unionByName(found.select(*data["edits"].columns))}


def check(data: dict[str, DataFrame]) -> None:
    """Raises where a sample cannot be scored, or an edit does not fit its texts; names a few of them."""
    bad = E.violations(data["samples"], data["targets"]).select(*KEYS).take(5)
    if bad:
        raise ValueError(f"samples without a source, one hypothesis and a reference: {[tuple(r) for r in bad]}")
    wrong = E.invalid_edits(data["samples"], data["targets"], data["edits"]).select(*KEYS, "side", "target_id").take(5)
    if wrong:
        raise ValueError(f"edits that do not fit their texts: {[tuple(r) for r in wrong]}")


def _counts(data: dict[str, DataFrame], g: DataFrame, how: Setting) -> tuple[DataFrame, DataFrame]:
    """(counts per reference, matches)."""
    if how.metric == "edit":
        return G.edit_counts(g, how.detection), O.edit_outcomes(data["targets"], data["edits"], how.detection)
    m = G.match_rows(g, how.assumption, how.detection, how.merge_distance)
    if how.weigher == "none":
        return G.counts(g, how.assumption, how.detection, None, how.merge_distance), m
    if how.weigher == "length":
        bias = {r.system_id: r.bias for r in G.length_bias(g).collect()}  # a row per system
        weights = {system: W.length_weight_of(b, how.preset) for system, b in bias.items()}
        counts = G.counts(g, how.assumption, how.detection, weights, how.merge_distance)
        table = m.join(F.broadcast(m.sparkSession.createDataFrame(list(bias.items()), "system_id string, bias double")), "system_id", "left")
        return counts, table.withColumn("weight", W.length_weight(F.col("length"), F.col("bias"), F.col("outcome"), how.preset)).drop("bias")
    weigh = BY_TEXT[how.weigher] if isinstance(how.weigher, str) else how.weigher
    live = G.ungroup(g)
    m = weigh(m, live["samples"], live["targets"], G.chunk_rows(g, how.merge_distance), how.sim)
    return S.ref_counts(m, S.reference_pairs(live["targets"]), F.col("weight")), m


def _score(counts: DataFrame, how: Setting) -> DataFrame:
    if how.scorer is not None:
        return (SCORERS[how.scorer] if isinstance(how.scorer, str) else how.scorer)(counts, how)
    if how.metric == "heuo":
        weighted = how.weigher != "none"
        factors = ADAPTED[how.level, weighted] if how.adapt else how.factors or (S.CORPUS_FACTORS if how.level == "corpus" else S.SENTENCE_FACTORS)
        return S.with_need(S.heuo_corpus(counts, factors) if how.level == "corpus" else S.heuo_sentence(counts, factors), weighted)
    return S.prf_corpus(counts, how.beta) if how.level == "corpus" else S.prf_sentence(counts, how.beta)


def evaluate(data: dict[str, DataFrame], metric: str = "chunk", assumption: str = "dependent", weigher: str | Callable = "none", level: str = "corpus", detection: bool = False, validate: bool = False, persist: str | None = None, **more) -> tuple[DataFrame, DataFrame]:
    """``(scores, matches)`` of all systems in ``data`` (samples, targets, edits), see ``Setting`` for the rest.

    Without edits they are extracted. ``validate`` checks samples and edits first; ``persist`` writes
    scores and matches to that folder. Reads the corpus once or twice, whatever the metric.
    """
    how = Setting(metric, assumption, weigher, level, detection, **more)
    if "edits" not in data:
        data = with_edits(data, lang=how.language, **how.given)
    if how.drop_unchanged:
        kept = E.drop_unchanged_refs(data["samples"], data["targets"])
        data = {"samples": data["samples"], "targets": kept, "edits": E.keep_edits_of(data["edits"], kept)}
    if validate:
        check(data)
    g = data["grouped"] if "grouped" in data else G.group(data["samples"], data["targets"], data["edits"])
    if how.metric == "gleu":
        parts = L.gleu_parts(g)
        scores, m = (L.gleu_corpus(parts, how.smoothing) if how.level == "corpus" else L.gleu_sentence(parts)), parts
    else:
        counts, m = _counts(data, g if how.metric == "edit" else G.drop_empty_refs(g), how)
        scores = _score(counts, how)
    if persist:
        write_results(scores, m, persist)
    return scores, m


def evaluate_all(data: dict[str, DataFrame], metric: str = "chunk", weigher: str | Callable = "length", **more) -> DataFrame:
    """The four scores of a metric at once: ``level, weighted`` and the score columns, a row each per system."""
    shared = {"assumption", "detection", "preset", "beta", "factors", "adapt", "merge_distance", "scorer"}
    both = None
    if weigher == "length" and metric in ("chunk", "heuo") and "edits" in data and shared.issuperset(more):
        both = _both_counts(data, Setting(metric, weigher=weigher, **more))
    out = None
    for level in ("corpus", "sentence"):
        for weighted in (False, True):
            how = weigher if weighted else "none"
            s = _score(both[weighted], Setting(metric, weigher=how, level=level, **more)) if both else evaluate(data, metric, weigher=how, level=level, **more)[0]
            s = s.select(F.lit(level).alias("level"), F.lit(weighted).alias("weighted"), *s.columns)
            out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def _both_counts(data: dict[str, DataFrame], how: Setting) -> dict[bool, DataFrame]:
    """Plain counts and counts weighed by length, made in one pass behind the one for the weights, and saved: they are a few numbers for each reference."""
    g = data["grouped"] if "grouped" in data else G.group(data["samples"], data["targets"], data["edits"])
    weights = {r.system_id: W.length_weight_of(r.bias, how.preset) for r in G.length_bias(G.drop_empty_refs(g)).collect()}  # a row per system
    counts = saved(G.all_counts(g, weights, how.assumption, how.detection, how.merge_distance, plain=True), "counts")
    keys = [*KEYS, "ref_id"]
    return {True: counts.select(*keys, *G.COUNTS), False: counts.select(*keys, *[F.col(f"plain_{c}").alias(c) for c in G.COUNTS])}
