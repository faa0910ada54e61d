"""One row per sample, its targets with their edits inside; chunks, outcomes and counts of it in one pass.

A sample's islands, chunks and outcomes depend on nothing but the sample. So they need no join, no window
and no shuffle: the corpus is read once, whatever the metric. The rules are those of ``chunks`` and
``outcomes``, over Arrow batches: as expressions of nested arrays they took several times as long.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrigenda.model import KEYS, TARGET

EDIT = ["edit_no", "src_start", "src_end", "tgt_start", "tgt_end", "src_tokens", "tgt_tokens", "types"]
_EDIT = "struct<edit_no:int,src_start:int,src_end:int,tgt_start:int,tgt_end:int,src_tokens:array<string>,tgt_tokens:array<string>,types:array<string>>"
GROUPED = f"system_id string, sample_id bigint, src_tokens array<string>, t array<struct<side:string,target_id:int,tgt_tokens:array<string>,edits:array<{_EDIT}>>>"
_ROW = "system_id string, sample_id bigint, "
CHUNKS = _ROW + "chunk_idx int, src_start int, src_end int, side string, target_id int, src_tokens array<string>, tgt_tokens array<string>, types array<string>, is_marked boolean"
MATCHES = _ROW + "ref_id int, chunk_idx int, outcome string, fp_kind string, length int"

#: (tokens, types, marked) of a target's chunk; (start, end, is an island) of a chunk's place.
Chunk = tuple[list[str], list[str], bool]
Bound = tuple[int, int, bool]


def _lists(values: Sequence[Sequence], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, values))], pa.int32()), pa.array([x for v in values for x in v], kind))


def grouped_record(systems: list[str], ids: list[int], sources: list[list[str]], sides: list[Sequence[str]], numbers: list[Sequence[int]], texts: list[list[list[str]]], edits: list[list[list[tuple]]]) -> pa.RecordBatch:
    """Rows of GROUPED: of each sample its source, and side, number, tokens and edits (tuples in the order of EDIT) of its targets."""
    own = [e for sample in edits for e in sample]
    flat = [e for target in own for e in target]
    cols = list(zip(*flat)) or [()] * len(EDIT)
    e = pa.StructArray.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:5]), *(_lists(c, pa.string()) for c in cols[5:])], EDIT)
    e = pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, own))], pa.int32()), e)
    t = pa.StructArray.from_arrays([pa.array([x for s in sides for x in s], pa.string()), pa.array([x for n in numbers for x in n], pa.int32()), _lists([x for s in texts for x in s], pa.string()), e], ["side", "target_id", "tgt_tokens", "edits"])
    t = pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, sides))], pa.int32()), t)
    return pa.RecordBatch.from_arrays([pa.array(systems, pa.string()), pa.array(ids, pa.int64()), _lists(sources, pa.string()), t], ["system_id", "sample_id", "src_tokens", "t"])


def group(samples: DataFrame, targets: DataFrame, edits: DataFrame) -> DataFrame:
    """``keys, src_tokens, t``: ``t`` is an array of (side, target_id, tgt_tokens, edits), hypotheses first."""
    e = edits.groupBy(*TARGET).agg(F.sort_array(F.collect_list(F.struct("src_start", "src_end", "edit_no", F.struct(*EDIT).alias("e")))).alias("e"))
    own = F.coalesce(F.transform("e", lambda x: x["e"]), F.array().cast(f"array<{_EDIT}>"))
    t = targets.join(e, TARGET, "left").groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("side", "target_id", "tgt_tokens", own.alias("edits")))).alias("t"))
    return samples.join(t, KEYS).select(*KEYS, "src_tokens", "t")


def ungroup(g: DataFrame) -> dict[str, DataFrame]:
    """The three tables of a grouped one."""
    t = g.select(*KEYS, F.explode("t").alias("t"))
    e = t.select(*KEYS, "t.side", "t.target_id", F.explode("t.edits").alias("e"))
    return {"samples": g.select(*KEYS, "src_tokens"), "targets": t.select(*KEYS, "t.side", "t.target_id", "t.tgt_tokens"), "edits": e.select(*TARGET, "e.*")}


def drop_empty_refs(g: DataFrame) -> DataFrame:
    """References without a token go; if all are empty the first stays."""
    refs = F.filter("t", lambda x: x["side"] == "ref")
    full = F.filter(refs, lambda x: F.size(x["tgt_tokens"]) > 0)
    return g.withColumn("t", F.concat(F.filter("t", lambda x: x["side"] != "ref"), F.when(F.size(full) > 0, full).otherwise(F.slice(refs, 1, 1))))


def bounds_of(n: int, spans: list[tuple[int, int]], distance: int = 0) -> list[Bound]:
    """Places of the chunks of ``n`` source tokens: islands of spans that touch, or lie within the distance, and the gaps."""
    out: list[Bound] = []
    at, k = 0, 0
    spans = sorted(spans)
    while k < len(spans):
        start, end = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] <= end + distance:
            end = max(end, spans[k][1])
            k += 1
        if start > at:
            out.append((at, start, False))
        out.append((start, end, True))
        at = end
    if n > at:
        out.append((at, n, False))
    return out or [(0, 0, False)]


def chunks_of(src: list[str], bounds: list[Bound], edits: list[tuple[int, int, list[str], list[str]]]) -> list[Chunk]:
    """A target's chunks at ``bounds``: its source slice with the target's own edits inside the island applied."""
    out: list[Chunk] = []
    k = 0
    for start, end, island in bounds:
        at, tokens, types = start, [], []
        while island and k < len(edits) and edits[k][0] <= end:
            a, b, new, kinds = edits[k]
            tokens += src[at:a]
            tokens += new
            types += kinds
            at = b
            k += 1
        out.append(([*tokens, *src[at:end]] if tokens else src[at:end], types, bool(types)))
    return out


def outcomes_of(bounds: list[Bound], hyp: list[Chunk], refs: list[list[Chunk]], independent: bool, detection: bool) -> list[list[tuple[str, str | None]]]:
    """(outcome, kind of a wrong one) per reference and chunk."""
    out = []
    for one in [refs] if independent else [[r] for r in refs]:
        row = []
        for i, (tokens, _, marked) in enumerate(hyp):
            own = [r[i] for r in one]
            found = any(c[2] for c in own) if detection else any(c[0] == tokens for c in own)
            if marked:
                row.append(("tp", None) if found else ("fp", None if detection else "ne" if any(c[2] for c in own) else "un"))
            else:
                missed = all(c[2] for c in own) if independent or detection else not found
                row.append(("fn" if missed else "tn", None))
        out.append(row)
    return out * len(refs) if independent else out


Target = tuple[str, int, list[tuple[int, int, list[str], list[str]]]]


def _samples(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str], list[Target]]]:
    """(row, source, targets) of a batch; nested columns are opened as columns, not value by value."""
    src = batch.column("src_tokens").to_pylist()
    t = batch.column("t")
    t_at, t = t.offsets.to_pylist(), t.values
    e = t.field("edits")
    e_at, e = e.offsets.to_pylist(), e.values
    edits = list(zip(*(e.field(c).to_pylist() for c in ("src_start", "src_end", "tgt_tokens", "types"))))
    sides, ids = t.field("side").to_pylist(), t.field("target_id").to_pylist()
    for r, tokens in enumerate(src):
        yield r, tokens, [(sides[j], ids[j], edits[e_at[j] : e_at[j + 1]]) for j in range(t_at[r], t_at[r + 1])]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str], list[tuple[str, int, list[str]]]]]:
    """(row, source, targets) of a batch, with the targets' tokens instead of their edits."""
    t = batch.column("t")
    t_at, t = t.offsets.to_pylist(), t.values
    rows = list(zip(*(t.field(c).to_pylist() for c in ("side", "target_id", "tgt_tokens"))))
    for r, tokens in enumerate(batch.column("src_tokens").to_pylist()):
        yield r, tokens, rows[t_at[r] : t_at[r + 1]]


def _all(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str], list[tuple]]]:
    """(row, source, targets) of a batch; a target is (side, id, edits, tokens)."""
    for (r, src, targets), (_, _, texts) in zip(_samples(batch), _texts(batch)):
        yield r, src, [(*t, text[2]) for t, text in zip(targets, texts)]


FIELDS = {"edits": (_samples, ["edits"]), "tgt_tokens": (_texts, ["tgt_tokens"]), "all": (_all, ["edits", "tgt_tokens"])}


@contextmanager
def uncollected() -> Iterator[None]:
    """Without the search for cycles, which goes over all rows again and again; the rows of a batch have none."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def mapped(g: DataFrame, schema: str, fn: Callable, field: str = "edits", by_system: bool = False) -> DataFrame:
    """``fn(source, targets)`` yields tuples behind the keys, for each sample; a target is (side, id, ``field``), with ``all`` (side, id, edits, tokens). With ``by_system`` it is told the system too."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    read, wanted = FIELDS[field]

    def made(batch):
        at, rows = [], []
        system = batch.column("system_id").to_pylist() if by_system else None
        for r, src, targets in read(batch):
            for row in fn(src, targets, system[r]) if by_system else fn(src, targets):
                at.append(r)
                rows.append(row)
        take = pa.array(at, pa.int64())
        cols = list(zip(*rows)) or [[]] * (len(arrow) - 2)
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in KEYS), *(pa.array(c, f.type) for c, f in zip(cols, list(arrow)[2:]))], schema=arrow)

    def run(batches):
        for batch in batches:
            with uncollected():
                out = made(batch)
            yield out

    slim = F.transform("t", lambda x: F.struct(x["side"].alias("side"), x["target_id"].alias("target_id"), *[x[c].alias(c) for c in wanted]))
    return g.select(*KEYS, "src_tokens", slim.alias("t")).mapInArrow(run, schema)


def chunk_rows(g: DataFrame, distance: int = 0) -> DataFrame:
    """The chunk table: a row per target and chunk; the sequences of a sample all have the same chunk numbers."""

    def rows(src, targets):
        bounds = bounds_of(len(src), [e[:2] for t in targets for e in t[2]], distance)
        for side, target, edits in targets:
            for i, ((a, b, _), (tokens, types, marked)) in enumerate(zip(bounds, chunks_of(src, bounds, edits))):
                yield i, a, b, side, target, src[a:b], tokens, types, marked

    return mapped(g, CHUNKS, rows)


def _judged(independent: bool, detection: bool, distance: int):
    """src, targets -> (reference ids, bounds, hypothesis' chunks, outcomes), or None without a hypothesis or a reference."""

    def judge(src, targets):
        hyp = next((t for t in targets if t[0] == "hyp"), None)
        refs = [t for t in targets if t[0] == "ref"]
        if hyp is None or not refs:
            return None
        bounds = bounds_of(len(src), [e[:2] for t in targets for e in t[2]], distance)
        own = chunks_of(src, bounds, hyp[2])
        return [t[1] for t in refs], bounds, own, outcomes_of(bounds, own, [chunks_of(src, bounds, t[2]) for t in refs], independent, detection)

    return judge


def match_rows(g: DataFrame, assumption: str = "dependent", detection: bool = False, distance: int = 0) -> DataFrame:
    """A row per reference and chunk of every sample that has a hypothesis: ``ref_id, chunk_idx, outcome, fp_kind, length``."""
    judge = _judged(assumption == "independent", detection, distance)

    def rows(src, targets):
        if got := judge(src, targets):
            ids, bounds, own, found = got
            size = [max(b - a, len(c[0])) for (a, b, _), c in zip(bounds, own)]
            for ref, row in zip(ids, found):
                for i, (outcome, kind) in enumerate(row):
                    yield ref, i, outcome, kind, size[i]

    return mapped(g, MATCHES, rows)


COUNTS = ["tp", "fp", "fn", "tn", "fp_ne", "fp_un"]
_PLACE = {c: i for i, c in enumerate(COUNTS)}


def live_targets(targets: list[tuple]) -> list[tuple]:
    """``drop_empty_refs`` of one sample's targets with all fields."""
    refs = [t for t in targets if t[0] == "ref"]
    return [t for t in targets if t[0] != "ref"] + ([t for t in refs if t[3]] or refs[:1])


def _sums(row: list[tuple[str, str | None]], size: list[int], weigh: Callable[[str, int], float] | None) -> list[float]:
    sums = [0.0] * 6
    for (outcome, kind), n in zip(row, size):
        w = 1.0 if weigh is None else weigh(outcome, n) or 1.0
        sums[_PLACE[outcome]] += w
        if kind:
            sums[_PLACE["fp_" + kind]] += w
    return sums


def all_counts(g: DataFrame, weight: dict[str, Callable[[str, int], float]], assumption: str = "dependent", detection: bool = False, distance: int = 0, plain: bool = False) -> DataFrame:
    """``counts`` by the weights of each system for every reference, those that are dropped as empty, or have no hypothesis, with zeros.

    With ``plain`` those of the references that stay, with the plain counts in columns ``plain_*`` beside them.
    """
    judge = _judged(assumption == "independent", detection, distance)
    names = [*COUNTS, *(f"plain_{c}" for c in COUNTS if plain)]

    def rows(src, targets, system):
        got = judge(src, live_targets(targets))
        found = {}
        if got:
            ids, bounds, own, out = got
            size = [max(b - a, len(c[0])) for (a, b, _), c in zip(bounds, own)]
            found = {ref: _sums(row, size, weight.get(system)) + (_sums(row, size, None) if plain else []) for ref, row in zip(ids, out)}
        for side, ref, *_ in targets:
            if side == "ref" and (ref in found or not plain):
                yield ref, *found.get(ref, [0.0] * len(names))

    return mapped(g, _ROW + "ref_id int, " + ", ".join(f"{c} double" for c in names), rows, "all", by_system=True)


def counts(g: DataFrame, assumption: str = "dependent", detection: bool = False, weight: Callable[[str, int], float] | dict[str, Callable[[str, int], float]] | None = None, distance: int = 0) -> DataFrame:
    """Counts, or sums of ``weight(outcome, length)``, per reference: ``keys, ref_id, tp, fp, fn, tn, fp_ne, fp_un``.

    ``weight`` may be one function for each system, which is a small dict whatever the number of rows: all
    systems are counted in one pass.
    """
    judge = _judged(assumption == "independent", detection, distance)
    place = {c: i for i, c in enumerate(COUNTS)}

    several = isinstance(weight, dict)

    def rows(src, targets, system=None):
        weigh = weight.get(system) if several else weight
        if got := judge(src, targets):
            ids, bounds, own, found = got
            for ref, row in zip(ids, found):
                sums = [0.0] * 6
                for i, (outcome, kind) in enumerate(row):
                    w = 1.0 if weigh is None else weigh(outcome, max(bounds[i][1] - bounds[i][0], len(own[i][0]))) or 1.0
                    sums[place[outcome]] += w
                    if kind:
                        sums[place["fp_" + kind]] += w
                yield ref, *sums

    return mapped(g, _ROW + "ref_id int, " + ", ".join(f"{c} double" for c in COUNTS), rows, by_system=several)


def edit_counts(g: DataFrame, detection: bool = False) -> DataFrame:
    """Counts of equal edits per reference, as ``counts`` of ``outcomes.edit_outcomes``; nothing is left unmatched, so tn is 0."""

    def rows(src, targets):
        key = lambda e: e[:2] if detection else (*e[:2], tuple(e[2]))
        hyp = [key(e) for t in targets if t[0] == "hyp" for e in t[2]]
        for side, ref, edits in targets:
            if side == "ref":
                own = [key(e) for e in edits]
                hit = sum(e in own for e in hyp)
                yield ref, float(hit), float(len(hyp) - hit), float(sum(e not in hyp for e in own)), 0.0, 0.0, 0.0

    return mapped(g, _ROW + "ref_id int, " + ", ".join(f"{c} double" for c in COUNTS), rows)


def edit_rows(g: DataFrame, detection: bool = False) -> DataFrame:
    """``outcomes.edit_outcomes`` of a grouped dataset, row by row; with ``detection`` without the tokens."""

    def rows(src, targets):
        key = lambda e: e[:2] if detection else (*e[:2], tuple(e[2]))
        hyp = [key(e) for t in targets if t[0] == "hyp" for e in t[2]]
        of_hyp = set(hyp)
        for side, ref, edits in targets:
            if side == "ref":
                own = [key(e) for e in edits]
                of_ref = set(own)
                for e in hyp:
                    yield ref, *e, "tp" if e in of_ref else "fp"
                for e in own:
                    if e not in of_hyp:
                        yield ref, *e, "fn"

    return mapped(g, _ROW + "ref_id int, src_start int, src_end int, " + ("" if detection else "tgt_tokens array<string>, ") + "outcome string", rows)


def reverted_rows(g: DataFrame, side: str = "ref") -> DataFrame:
    """``weights.reverted_targets`` of a grouped dataset, row by row."""

    def rows(src, targets):
        bounds = bounds_of(len(src), [e[:2] for t in targets for e in t[2]])
        for kind, target, edits in targets:
            if kind == side:
                own = chunks_of(src, bounds, edits)
                for i, (a, b, _) in enumerate(bounds):
                    if own[i][2]:
                        yield target, i, with_chunk([c[0] for c in own], i, src[a:b])

    return mapped(g, _ROW + "target_id int, chunk_idx int, tokens array<string>", rows)


def with_chunk(chunks: list[list[str]], i: int, tokens: list[str]) -> list[str]:
    """The tokens of ``chunks`` with others in the place of chunk ``i``; empty ones go."""
    return [x for k, c in enumerate(chunks) for x in (tokens if k == i else c) if x != ""]


def length_bias(g: DataFrame) -> DataFrame:
    """``bias, plain``: mean length of marked and of unmarked reference chunks, per system."""

    def rows(src, targets):
        bounds = bounds_of(len(src), [e[:2] for t in targets for e in t[2]])
        n, total = [0, 0], [0, 0]
        for side, _, edits in targets:
            if side == "ref":
                for (a, b, _), c in zip(bounds, chunks_of(src, bounds, edits)):
                    n[c[2]] += 1
                    total[c[2]] += max(b - a, len(c[0])) if c[2] else b - a
        yield n[1], total[1], n[0], total[0]

    s = mapped(g, _ROW + "n long, a long, m long, b long", rows).groupBy("system_id").agg(*[F.sum(c).alias(c) for c in "namb"])
    return s.select("system_id", (F.col("a") / F.nullif("n", F.lit(0))).alias("bias"), (F.col("b") / F.nullif("m", F.lit(0))).alias("plain"))
