"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from corrigenda.operators.english import TAGS
from corrigenda.operators.vocabulary import EDIT_TYPES

_COMMON = """
WITH RECURSIVE ln AS MATERIALIZED (
  SELECT doc_id, flatten(list_transform(list_transform(string_split(text, chr(10)), lambda x: list_filter(string_split(x, ' '), lambda w: w <> '')),
    lambda a: list_transform(range(0, len(a), 40), lambda o: a[o + 1:o + 40]))) AS ps FROM documents),
samples AS MATERIALIZED (SELECT doc_id * 16777216 + line AS sample_id, doc_id, line, src, CAST(len(src) AS INT) AS n
  FROM (SELECT doc_id, unnest(ps) AS src, generate_subscripts(ps, 1) - 1 AS line FROM ln)),
sides AS MATERIALIZED (SELECT sample_id, k FROM samples, (VALUES (0), (1), (2)) v(k) WHERE NOT (sample_id % 7 = 0 AND k = 2)),
tok AS MATERIALIZED (SELECT sample_id, doc_id, line, n, unnest(src) AS t, CAST(unnest(range(len(src))) AS INT) AS i FROM samples),
site AS (SELECT *, (doc_id * 131 + line * 31 + i * 17) % 23 AS b FROM tok WHERE i % 2 = 0),
e0 AS (SELECT s.*, k, CASE WHEN (i + k) % 2 = 0 THEN 'a' ELSE 'b' END AS v FROM site s JOIN sides USING (sample_id)
       WHERE b < 4 AND (b + i * 7 + k * 5 + line) % 3 <> 0),
e1 AS (SELECT sample_id, k, i AS src_start, CAST(CASE WHEN b = 2 THEN i WHEN b = 3 THEN least(i + 2, n) ELSE i + 1 END AS INT) AS src_end,
       CASE b WHEN 0 THEN t || v WHEN 1 THEN '' WHEN 2 THEN 'ins' || v ELSE t || 'q' || v END AS tgt,
       CASE b WHEN 1 THEN 'U' WHEN 2 THEN 'M' ELSE 'R' END AS op FROM e0),
edits AS MATERIALIZED (SELECT *, CASE WHEN k = 0 THEN 'hyp' ELSE 'ref' END AS side, greatest(k - 1, 0) AS target_id,
       CAST(row_number() OVER (PARTITION BY sample_id, k ORDER BY src_start) - 1 AS INT) AS edit_no,
       CAST(src_start + coalesce(sum((tgt <> '')::INT - (src_end - src_start)) OVER (PARTITION BY sample_id, k ORDER BY src_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS tgt_start
       FROM e1),
gone AS (SELECT sample_id, k, CAST(unnest(range(src_start, src_end)) AS INT) AS i FROM edits),
pieces AS MATERIALIZED (
  SELECT sample_id, k, src_start AS pos, 0 AS kind, tgt AS t FROM edits WHERE tgt <> ''
  UNION ALL
  SELECT t.sample_id, d.k, t.i, 1, t.t FROM tok t JOIN sides d USING (sample_id) ANTI JOIN gone g ON g.sample_id = t.sample_id AND g.k = d.k AND g.i = t.i),
targets0 AS (SELECT d.sample_id, d.k, coalesce(string_agg(t, ' ' ORDER BY pos, kind), '') AS tgt FROM sides d LEFT JOIN pieces p USING (sample_id, k) GROUP BY ALL),
targets AS MATERIALIZED (SELECT *, CASE WHEN k = 0 THEN 'hyp' ELSE 'ref' END AS side, greatest(k - 1, 0) AS target_id, CASE WHEN tgt = '' THEN [] ELSE string_split(tgt, ' ') END AS tt FROM targets0)
"""

_ISLANDS = """, isl0 AS (SELECT *, max(src_end) OVER (PARTITION BY sample_id ORDER BY src_start, src_end, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM edits),
isl1 AS (SELECT *, CAST(sum((pe IS NULL OR src_start > pe + {d})::INT) OVER (PARTITION BY sample_id ORDER BY src_start, src_end, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS INT) AS island_id FROM isl0),
islands AS (SELECT sample_id, island_id, min(src_start) AS st, max(src_end) AS en FROM isl1 GROUP BY ALL)
"""

_CHUNKS = _ISLANDS.format(d=0) + """, b0 AS (
  SELECT sample_id, st, en, island_id FROM islands
  UNION ALL SELECT sample_id, lag(en, 1, 0) OVER (PARTITION BY sample_id ORDER BY st, en), st, NULL FROM islands
  UNION ALL SELECT s.sample_id, coalesce(m.en, 0), s.n, NULL FROM samples s LEFT JOIN (SELECT sample_id, max(en) AS en FROM islands GROUP BY 1) m USING (sample_id)),
bounds AS (SELECT sample_id, st AS src_start, en AS src_end, island_id, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY st, en) - 1 AS INT) AS chunk_idx
           FROM b0 WHERE island_id IS NOT NULL OR en > st),
cp AS (
  SELECT b.sample_id, b.chunk_idx, p.k, p.pos, p.kind, p.t FROM bounds b JOIN pieces p ON p.sample_id = b.sample_id AND (
    (p.kind = 1 AND p.pos >= b.src_start AND p.pos < b.src_end) OR (p.kind = 0 AND b.island_id IS NOT NULL AND p.pos >= b.src_start AND p.pos <= b.src_end))),
mk AS (SELECT DISTINCT b.sample_id, b.chunk_idx, e.k FROM bounds b JOIN isl1 e ON e.sample_id = b.sample_id AND e.island_id = b.island_id),
live AS (SELECT sample_id, k FROM targets t WHERE k = 0 OR tgt <> '' OR (k = 1 AND NOT EXISTS (SELECT 1 FROM targets u WHERE u.sample_id = t.sample_id AND u.k > 0 AND u.tgt <> ''))),
ch AS (SELECT b.sample_id, b.chunk_idx, d.k, b.src_start, b.src_end, coalesce(string_agg(c.t, ' ' ORDER BY c.pos, c.kind), '') AS tgt, any_value(m.k) IS NOT NULL AS marked
       FROM bounds b JOIN live d USING (sample_id) LEFT JOIN cp c USING (sample_id, chunk_idx, k) LEFT JOIN mk m USING (sample_id, chunk_idx, k) GROUP BY ALL)
"""

_LEN = "greatest(h.src_end - h.src_start, CASE WHEN h.tgt = '' THEN 0 ELSE len(string_split(h.tgt, ' ')) END)"
_DEP = _CHUNKS + f""", m AS (SELECT h.sample_id, r.k - 1 AS ref_id, h.chunk_idx,
  CASE WHEN h.marked THEN CASE WHEN h.tgt = r.tgt THEN 'tp' ELSE 'fp' END WHEN h.tgt <> r.tgt THEN 'fn' ELSE 'tn' END AS outcome,
  CASE WHEN h.marked AND h.tgt <> r.tgt THEN CASE WHEN r.marked THEN 'ne' ELSE 'un' END END AS fp_kind,
  CASE WHEN h.marked THEN CASE WHEN r.marked THEN 'tp' ELSE 'fp' END WHEN r.marked THEN 'fn' ELSE 'tn' END AS found, {_LEN} AS length
  FROM ch h JOIN ch r USING (sample_id, chunk_idx) WHERE h.k = 0 AND r.k > 0)
"""
_IND = _CHUNKS + f""", by_ref AS (SELECT sample_id, chunk_idx, list(tgt) AS ts, bool_or(marked) AS any_, bool_and(marked) AS all_ FROM ch WHERE k > 0 GROUP BY ALL),
m AS (SELECT h.sample_id, d.k - 1 AS ref_id, h.chunk_idx,
  CASE WHEN h.marked THEN CASE WHEN list_contains(ts, h.tgt) THEN 'tp' ELSE 'fp' END WHEN all_ THEN 'fn' ELSE 'tn' END AS outcome,
  CASE WHEN h.marked AND NOT list_contains(ts, h.tgt) THEN CASE WHEN any_ THEN 'ne' ELSE 'un' END END AS fp_kind,
  CASE WHEN h.marked THEN CASE WHEN any_ THEN 'tp' ELSE 'fp' END WHEN all_ THEN 'fn' ELSE 'tn' END AS found, {_LEN} AS length
  FROM ch h JOIN by_ref USING (sample_id, chunk_idx) JOIN live d ON d.sample_id = h.sample_id AND d.k > 0 WHERE h.k = 0)
"""
_W = """, clen AS (SELECT marked, greatest(src_end - src_start, CASE WHEN tgt = '' THEN 0 ELSE len(string_split(tgt, ' ')) END) AS l, src_end - src_start AS sl FROM ch WHERE k > 0),
bias AS (SELECT avg(l) FILTER (WHERE marked) AS bias, avg(sl) FILTER (WHERE NOT marked) AS plain FROM clen),
mw AS (SELECT m.*, CASE WHEN outcome = 'tn' THEN 1.0 ELSE least(greatest(2.0 / (1 + exp(CASE WHEN outcome = 'fp' THEN length - bias ELSE bias - length END)), 0.75), 1.25) END AS w FROM m, bias)
"""
_CNT = """, cnt AS (SELECT d.sample_id, d.k - 1 AS ref_id, {sums} FROM {pairs} d LEFT JOIN {m} m ON m.sample_id = d.sample_id AND m.ref_id = d.k - 1 WHERE d.k > 0 GROUP BY ALL)
"""


def _cnt(m: str = "m", w: str = "1.0", pairs: str = "sides") -> str:
    s = [f"coalesce(sum({w}::DOUBLE) FILTER (WHERE outcome = '{o}'), 0) AS {o}" for o in ("tp", "fp", "fn", "tn")]
    s += [f"coalesce(sum({w}::DOUBLE) FILTER (WHERE outcome = 'fp' AND fp_kind = '{k}'), 0) AS fp_{k}" for k in ("ne", "un")]
    return _CNT.format(sums=", ".join(s), m=m, pairs=pairs)


_P = "CASE WHEN fp = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fp) END"
_R = "CASE WHEN fn = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fn) END"


def _prf(src: str, name: str = "prf") -> str:
    return f""", {name}0 AS (SELECT *, {_P} AS p0, {_R} AS r0 FROM {src}),
{name} AS (SELECT * EXCLUDE (p0, r0), round(p0, 4) AS p, round(r0, 4) AS r, CASE WHEN p0 + r0 = 0 THEN 0 ELSE round(1.25 * p0 * r0 / (0.25 * p0 + r0), 4) END AS f,
  CASE WHEN tp + fp + fn + tn = 0 THEN 0 ELSE round((tp + tn) / (tp + fp + fn + tn), 4) END AS acc FROM {name}0)
"""


def _heuo(src: str, k: tuple[float, ...], name: str = "heuo") -> str:
    return f""", {name}0 AS (SELECT *, CASE WHEN tp + fp_ne + fn = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fp_ne + fn) END AS hit, CASE WHEN tp + fp_ne + fn = 0 THEN 0.0::DOUBLE ELSE fp_ne / (tp + fp_ne + fn) END AS err,
  CASE WHEN tp + fp_ne + fn = 0 THEN 0.0::DOUBLE ELSE fn / (tp + fp_ne + fn) END AS und, CASE WHEN tp + fp_ne + fp_un = 0 THEN 0.0::DOUBLE ELSE fp_un / (tp + fp_ne + fp_un) END AS ove FROM {src}),
{name} AS (SELECT *, {k[0]}::DOUBLE * hit + {k[1]}::DOUBLE * (1 - err) + {k[2]}::DOUBLE * (1 - und) + {k[3]}::DOUBLE * (1 - ove) AS com FROM {name}0)
"""


_C6 = ("tp", "fp", "fn", "tn", "fp_ne", "fp_un")
_C4 = _C6[:4]


def _fold(score: str, cols=_C6) -> str:
    """The ordered fold: per sample the reference that makes the best running score; the first wins ties."""
    st = lambda p, s="": "{" + ", ".join(f"'{c}': {p}{c}{s}" for c in cols) + "}"
    add = lambda x: "{" + ", ".join(f"'{c}': z.{c} + v.{x}.{c}" for c in cols) + ", 'a': v.a, 'b': v.b}"
    of = lambda x: score.format(**{c: f"(z.{c} + v.{x}.{c})" for c in _C6 if c in cols})
    row = lambda x: f"row({of(x)}, v.{x}.tp, -v.{x}.fp, -v.{x}.fn, v.{x}.tn)"
    zero = "{" + ", ".join(f"'{c}': 0.0::DOUBLE" for c in cols) + "}"
    return f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ref_id) AS rn FROM cnt),
lst AS (SELECT a.sample_id, {st('a.')} AS a, CASE WHEN b.sample_id IS NULL THEN {st('a.')} ELSE {st('b.')} END AS b
  FROM ranked a LEFT JOIN ranked b ON b.sample_id = a.sample_id AND b.rn = 2 WHERE a.rn = 1),
agg AS (SELECT count(*) AS num_sample, list({{{", ".join(f"'{c}': 0.0::DOUBLE" for c in cols)}, 'a': a, 'b': b}} ORDER BY sample_id) AS l FROM lst),
red AS (SELECT num_sample, list_reduce(list_concat([{{{", ".join(f"'{c}': 0.0::DOUBLE" for c in cols)}, 'a': {zero}, 'b': {zero}}}], l), lambda z, v: CASE WHEN {row('a')} >= {row('b')} THEN {add('a')} ELSE {add('b')} END) AS z FROM agg),
tot AS (SELECT num_sample, {", ".join(f"z.{c} AS {c}" for c in cols)} FROM red)
"""


_FP = "(CASE WHEN {fp} = 0 THEN 1.0::DOUBLE ELSE {tp} / ({tp} + {fp}) END)"
_FR = "(CASE WHEN {fn} = 0 THEN 1.0::DOUBLE ELSE {tp} / ({tp} + {fn}) END)"
_FOLD_F = f"(CASE WHEN {_FP} + {_FR} = 0 THEN 0 ELSE round(1.25 * {_FP} * {_FR} / (0.25 * {_FP} + {_FR}), 4) END)"
_NEED = "({tp} + {fp_ne} + {fn})"
_FOLD_COM = (
    f"(0.45::DOUBLE * (CASE WHEN {_NEED} = 0 THEN 0 ELSE {{tp}} / {_NEED} END) + 0.35::DOUBLE * (1 - (CASE WHEN {_NEED} = 0 THEN 0 ELSE {{fp_ne}} / {_NEED} END))"
    f" + 0.15::DOUBLE * (1 - (CASE WHEN {_NEED} = 0 THEN 0 ELSE {{fn}} / {_NEED} END)) + 0.05::DOUBLE * (1 - (CASE WHEN {{tp}} + {{fp_ne}} + {{fp_un}} = 0 THEN 0 ELSE {{fp_un}} / ({{tp}} + {{fp_ne}} + {{fp_un}}) END)))"
)
_R6 = lambda *cols: ", ".join(f"round({c}, 6) AS {c}" for c in cols)
_EM = """, he AS MATERIALIZED (SELECT h.sample_id, d.k, h.src_start, h.src_end, h.tgt FROM edits h JOIN sides d ON d.sample_id = h.sample_id AND d.k > 0 WHERE h.k = 0),
re AS MATERIALIZED (SELECT sample_id, k, src_start, src_end, tgt FROM edits WHERE k > 0),
em AS (SELECT h.sample_id, h.k - 1 AS ref_id, h.src_start, h.src_end, h.tgt, 'tp' AS outcome FROM he h SEMI JOIN re r ON r.sample_id = h.sample_id AND r.k = h.k AND r.src_start = h.src_start AND r.src_end = h.src_end {and_}
  UNION ALL SELECT h.sample_id, h.k - 1, h.src_start, h.src_end, h.tgt, 'fp' FROM he h ANTI JOIN re r ON r.sample_id = h.sample_id AND r.k = h.k AND r.src_start = h.src_start AND r.src_end = h.src_end {and_}
  UNION ALL SELECT r.sample_id, r.k - 1, r.src_start, r.src_end, r.tgt, 'fn' FROM re r ANTI JOIN he h ON r.sample_id = h.sample_id AND r.k = h.k AND r.src_start = h.src_start AND r.src_end = h.src_end {and_}),
m AS (SELECT *, NULL::VARCHAR AS fp_kind FROM em)
"""
_EC, _ED = _EM.format(and_="AND r.tgt = h.tgt"), _EM.format(and_="")
_GRAMS = """, side_t AS (SELECT sample_id, -1 AS k, src AS tt FROM samples UNION ALL SELECT sample_id, k, tt FROM targets),
gr AS (SELECT sample_id, k, n, array_to_string(tt[i:i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(tt) + 2 - n)) AS i FROM (SELECT *, unnest([1, 2, 3, 4]) AS n FROM side_t) WHERE len(tt) >= n)),
g AS (SELECT sample_id, k, n, gram, count(*) AS c FROM gr GROUP BY ALL)
"""
_GLEU = _GRAMS + """, num AS (SELECT h.sample_id, d.k, h.n, sum(CASE WHEN r.c IS NOT NULL THEN least(h.c, r.c) WHEN s.c IS NOT NULL THEN -least(h.c, s.c) ELSE 0 END) AS x
  FROM g h JOIN sides d ON d.sample_id = h.sample_id AND d.k > 0 LEFT JOIN g r ON r.sample_id = h.sample_id AND r.k = d.k AND r.n = h.n AND r.gram = h.gram
  LEFT JOIN g s ON s.sample_id = h.sample_id AND s.k = -1 AND s.n = h.n AND s.gram = h.gram WHERE h.k = 0 GROUP BY ALL),
parts AS (SELECT r.sample_id, r.k - 1 AS ref_id, v.n, CAST(greatest(coalesce(x, 0), 0) AS BIGINT) AS numerator, CAST(greatest(len(h.tt) + 1 - v.n, 0) AS BIGINT) AS denominator, CAST(len(h.tt) AS INT) AS hyp_len, CAST(len(r.tt) AS INT) AS ref_len
  FROM targets r JOIN targets h ON h.sample_id = r.sample_id AND h.k = 0 CROSS JOIN (VALUES (1), (2), (3), (4)) v(n) LEFT JOIN num ON num.sample_id = r.sample_id AND num.k = r.k AND num.n = v.n WHERE r.k > 0)
"""
_PSEUDO = """, pse AS (SELECT h.sample_id, h.k, h.chunk_idx, coalesce(string_agg(CASE WHEN c.chunk_idx = h.chunk_idx THEN c.tgt ELSE array_to_string(s.src[c.src_start + 1:c.src_end], ' ') END, ' ' ORDER BY c.chunk_idx)
     FILTER (WHERE CASE WHEN c.chunk_idx = h.chunk_idx THEN c.tgt <> '' ELSE c.src_end > c.src_start END), '') AS tokens
  FROM ch h JOIN ch c ON c.sample_id = h.sample_id AND c.k = h.k JOIN samples s ON s.sample_id = h.sample_id WHERE h.marked GROUP BY ALL)
"""
_F1 = "(CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE 2.0 * coalesce(list_sum(list_transform(list_distinct({a}), lambda t: least(len(list_filter({a}, lambda x: x = t)), len(list_filter({b}, lambda x: x = t))))), 0) / (len({a}) + len({b})) END)"
_EDIT_COLS = "sample_id, side, target_id, edit_no, src_start, src_end, tgt_start, CAST(tgt_start + (tgt <> '')::INT AS INT) AS tgt_end"
_SCAN = _COMMON + f"SELECT {_EDIT_COLS}, array_to_string(s.src[src_start + 1:src_end], ' ') AS src_tokens, tgt AS tgt_tokens FROM edits JOIN samples s USING (sample_id)"
_APPLY = _COMMON + "SELECT sample_id, side, target_id, tgt AS tgt_tokens FROM targets"
_PRF_OUT = "num_sample, p, r, f, acc, tp, fp, fn, tn"
_SENT = ", best AS (SELECT sample_id, arg_max(prf, row(f, p, r, acc, -ref_id)) AS x FROM prf GROUP BY 1) SELECT count(*) AS num_sample, round(avg(x.p), 6) AS p, round(avg(x.r), 6) AS r, round(avg(x.f), 6) AS f, round(avg(x.acc), 6) AS acc, sum(x.tp) AS tp, sum(x.fp) AS fp, sum(x.fn) AS fn, sum(x.tn) AS tn FROM best"

_LETTERS, _CHARACTERS = "abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(0x4E00, 0x4E00 + 26)))
_CHUNKS_ALL = _COMMON + _CHUNKS
_ONE_REF = ", cnt0 AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ref_id) AS rn FROM cnt), tot AS (SELECT count(*) AS num_sample, " + ", ".join(f"sum({c}) AS {c}" for c in _C6) + " FROM cnt0 WHERE rn = 1)"

ORACLES: dict[str, str] = {
    "prf_corpus_dependent": _COMMON + _DEP + _cnt(pairs="live") + _fold(_FOLD_F) + _prf("tot") + f"SELECT {_PRF_OUT} FROM prf",
    "edits_scan": _SCAN,
    "json_round_trip": _SCAN,
    "apply_edits": _APPLY,
    "extract_round_trip": _APPLY,
    "english_round_trip": _APPLY,
    "invalid_edits": _COMMON + "SELECT 0::BIGINT AS n_bad, count(*) AS n_edits FROM edits",
    **{f"edit_{o}": _COMMON + _EC + f"SELECT sample_id, ref_id, src_start, src_end, tgt AS tgt_tokens FROM em WHERE outcome = '{o}'" for o in ("tp", "fp", "fn")},
    "edit_detection": _COMMON + _ED + "SELECT sample_id, ref_id, src_start, src_end, outcome FROM em",
    "edit_prf_corpus": _COMMON + _EC + _cnt() + _fold(_FOLD_F) + _prf("tot") + f"SELECT {_PRF_OUT} FROM prf",
    "edit_prf_sentence": _COMMON + _EC + _cnt() + _prf("cnt") + _SENT,
    "islands": _COMMON + _ISLANDS.format(d=0) + 'SELECT sample_id, island_id, st AS start, en AS "end" FROM islands',
    "islands_distance1": _COMMON + _ISLANDS.format(d=1) + 'SELECT sample_id, island_id, st AS start, en AS "end" FROM islands',
    "chunk_bounds": _COMMON + _CHUNKS + "SELECT sample_id, chunk_idx, src_start, src_end FROM bounds",
    "chunks": _COMMON + _CHUNKS + "SELECT sample_id, chunk_idx, CASE WHEN k = 0 THEN 'hyp' ELSE 'ref' END AS side, greatest(k - 1, 0) AS target_id, src_start, src_end, tgt AS tgt_tokens, marked AS is_marked FROM ch",
    "chunk_table": _COMMON + _CHUNKS + """SELECT c.sample_id, chunk_idx, CASE WHEN k = 0 THEN 'hyp' ELSE 'ref' END AS side, greatest(k - 1, 0) AS target_id, tgt AS text,
      min(tgt) OVER w <> max(tgt) OVER w OR bool_or(tgt <> array_to_string(s.src[c.src_start + 1:c.src_end], ' ')) OVER w AS changed FROM ch c JOIN samples s USING (sample_id) WINDOW w AS (PARTITION BY c.sample_id, chunk_idx)""",
    "outcome_dependent": _COMMON + _DEP + "SELECT sample_id, ref_id, chunk_idx, outcome, fp_kind FROM m",
    "outcome_independent": _COMMON + _IND + "SELECT sample_id, ref_id, chunk_idx, outcome, fp_kind FROM m",
    "detect_dependent": _COMMON + _DEP + "SELECT sample_id, ref_id, chunk_idx, found AS outcome FROM m",
    "detect_independent": _COMMON + _IND + "SELECT sample_id, ref_id, chunk_idx, found AS outcome FROM m",
    "length_bias": _COMMON + _DEP + _W + "SELECT round(bias, 6) AS bias, round(plain, 6) AS plain FROM bias",
    "length_weights": _COMMON + _DEP + _W + "SELECT sample_id, ref_id, chunk_idx, outcome, round(w, 6) AS weight FROM mw",
    "ref_counts": _COMMON + _DEP + _cnt() + "SELECT * FROM cnt",
    "ref_counts_weighted": _COMMON + _DEP + _W + _cnt("mw", "w") + f"SELECT sample_id, ref_id, {_R6(*_C6)} FROM cnt",
    "prf_sentence": _COMMON + _DEP + _cnt(pairs="live") + _prf("cnt") + _SENT,
    "prf_sentence_independent": _COMMON + _IND + _cnt(pairs="live") + _prf("cnt") + _SENT,
    "prf_corpus_independent": _COMMON + _IND + _cnt(pairs="live") + ", cnt0 AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ref_id) AS rn FROM cnt), tot AS (SELECT count(*) AS num_sample, " + ", ".join(f"sum({c}) AS {c}" for c in _C6) + " FROM cnt0 WHERE rn = 1)" + _prf("tot") + "SELECT num_sample, p, r, f, acc, " + ", ".join(_C6) + " FROM prf",
    "heuo_corpus_independent": _COMMON + _IND + _cnt(pairs="live") + ", cnt0 AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ref_id) AS rn FROM cnt), tot AS (SELECT count(*) AS num_sample, " + ", ".join(f"sum({c}) AS {c}" for c in _C6) + " FROM cnt0 WHERE rn = 1)" + _heuo("tot", (0.45, 0.35, 0.15, 0.05)) + f"SELECT num_sample, {', '.join(_C6)}, {_R6('hit', 'err', 'und', 'ove', 'com')} FROM heuo",
    "heuo_corpus_dependent": _COMMON + _DEP + _cnt(pairs="live") + _fold(_FOLD_COM) + _heuo("tot", (0.45, 0.35, 0.15, 0.05)) + f"SELECT num_sample, {', '.join(_C6)}, {_R6('hit', 'err', 'und', 'ove', 'com')} FROM heuo",
    "prf_corpus_weighted": _COMMON + _DEP + _W + _cnt("mw", "w", "live") + _fold(_FOLD_F) + _prf("tot") + f"SELECT num_sample, {_R6(*_C6)}, p, r, f, acc FROM prf",
    "heuo_sentence": _COMMON + _DEP + _cnt(pairs="live") + _heuo("cnt", (0.35, 0.25, 0.2, 0.2)) + ", best AS (SELECT sample_id, arg_max(heuo, row(com, hit, -err, -und, -ove, -ref_id)) AS x FROM heuo GROUP BY 1) SELECT count(*) AS num_sample, " + ", ".join(f"round(avg(x.{c}), 6) AS {c}" for c in ("hit", "err", "und", "ove", "com")) + ", " + ", ".join(f"sum(x.{c}) AS {c}" for c in _C6) + " FROM best",
    "pseudo_hyp": _COMMON + _CHUNKS + _PSEUDO + "SELECT sample_id, chunk_idx, tokens FROM pse WHERE k = 0",
    "similarity_weights": _COMMON + _DEP + _PSEUDO + """, cand AS (SELECT m.sample_id, m.ref_id, m.chunk_idx, m.outcome, s.src, r.tt AS ref, CASE WHEN coalesce(CASE WHEN outcome = 'fn' THEN b.tokens ELSE a.tokens END, '') = '' THEN s.src ELSE string_split(CASE WHEN outcome = 'fn' THEN b.tokens ELSE a.tokens END, ' ') END AS c
      FROM m JOIN samples s USING (sample_id) JOIN targets r ON r.sample_id = m.sample_id AND r.k = m.ref_id + 1 LEFT JOIN pse a ON a.sample_id = m.sample_id AND a.k = 0 AND a.chunk_idx = m.chunk_idx
      LEFT JOIN pse b ON b.sample_id = m.sample_id AND b.k = m.ref_id + 1 AND b.chunk_idx = m.chunk_idx WHERE outcome <> 'tn') """ + f"SELECT sample_id, ref_id, chunk_idx, outcome, round(abs({_F1.format(a='src', b='ref')} - {_F1.format(a='c', b='ref')}), 6) AS weight FROM cand",
    "replacement_weights": _COMMON + _DEP + _PSEUDO + """, rep AS (SELECT m.sample_id, m.ref_id, m.chunk_idx, coalesce(string_agg(CASE WHEN c.chunk_idx = m.chunk_idx THEN h.tgt ELSE c.tgt END, ' ' ORDER BY c.chunk_idx) FILTER (WHERE CASE WHEN c.chunk_idx = m.chunk_idx THEN h.tgt ELSE c.tgt END <> ''), '') AS t
      FROM m JOIN ch h ON h.sample_id = m.sample_id AND h.k = 0 AND h.chunk_idx = m.chunk_idx JOIN ch c ON c.sample_id = m.sample_id AND c.k = m.ref_id + 1 WHERE outcome IN ('fp', 'fn') GROUP BY m.sample_id, m.ref_id, m.chunk_idx),
    cand AS (SELECT m.sample_id, m.ref_id, m.chunk_idx, m.outcome, s.src AS a, CASE WHEN coalesce(p.tokens, '') = '' THEN s.src ELSE string_split(p.tokens, ' ') END AS b
      FROM m JOIN samples s USING (sample_id) LEFT JOIN pse p ON p.sample_id = m.sample_id AND p.k = 0 AND p.chunk_idx = m.chunk_idx WHERE outcome = 'tp'
      UNION ALL SELECT m.sample_id, m.ref_id, m.chunk_idx, m.outcome, CASE WHEN x.t = '' THEN [] ELSE string_split(x.t, ' ') END, r.tt
      FROM m JOIN rep x ON x.sample_id = m.sample_id AND x.ref_id = m.ref_id AND x.chunk_idx = m.chunk_idx JOIN targets r ON r.sample_id = m.sample_id AND r.k = m.ref_id + 1) """ + f"SELECT sample_id, ref_id, chunk_idx, outcome, round(1 - {_F1.format(a='a', b='b')}, 6) AS weight FROM cand",
    "source_similarity": _COMMON + f"SELECT r.sample_id, r.k - 1 AS ref_id, round({_F1.format(a='s.src', b='r.tt')}, 6) AS sim_src_tgt FROM targets r JOIN samples s USING (sample_id) WHERE r.k > 0",
    "ngram_counts": _COMMON + _GRAMS + "SELECT sample_id, n, gram, c FROM g WHERE k = -1",
    "gleu_parts": _COMMON + _GLEU + "SELECT * FROM parts",
    "gleu_corpus": _COMMON + _GLEU + ", o AS (SELECT sample_id, n, avg(numerator) AS a, avg(denominator) AS d, avg(hyp_len) AS h, avg(ref_len) AS r FROM parts GROUP BY ALL), t AS (SELECT n, sum(a) AS a, sum(d) AS d, sum(h) AS h, sum(r) AS r FROM o GROUP BY n) SELECT round(exp(least(0.0, 1 - max(r) / max(h)) + sum(ln(a / d)) / 4), 6) AS score FROM t",
    "gleu_sentence": _COMMON + _GLEU + ", o AS (SELECT sample_id, ref_id, exp(least(0.0::DOUBLE, 1 - max(CASE WHEN ref_len = 0 THEN 1 ELSE ref_len END) / max(CASE WHEN hyp_len = 0 THEN 1 ELSE hyp_len END)::DOUBLE) + sum(ln(CASE WHEN numerator = 0 THEN 1 ELSE numerator END / CASE WHEN denominator = 0 THEN 1 ELSE denominator END::DOUBLE)) / 4) AS s FROM parts GROUP BY ALL) SELECT round(avg(s), 6) AS score, round(stddev_pop(s), 6) AS std FROM o",
    "op_type": _COMMON + "SELECT sample_id, side, target_id, edit_no, op FROM edits",
    "drop_unchanged_refs": _COMMON + ", t AS (SELECT t.*, t.tt <> s.src AS good FROM targets t JOIN samples s USING (sample_id)), w AS (SELECT *, bool_or(good) OVER (PARTITION BY sample_id, side) AS any_, min(target_id) OVER (PARTITION BY sample_id, side) AS f FROM t) SELECT sample_id, side, target_id FROM w WHERE side = 'hyp' OR good OR (NOT any_ AND target_id = f)",
    "drop_empty_refs": _COMMON + ", w AS (SELECT *, bool_or(tgt <> '') OVER (PARTITION BY sample_id, side) AS any_, min(target_id) OVER (PARTITION BY sample_id, side) AS f FROM targets) SELECT sample_id, side, target_id FROM w WHERE side = 'hyp' OR tgt <> '' OR (NOT any_ AND target_id = f)",
    "flatten_pairs": _COMMON + "SELECT t.sample_id, side, target_id, array_to_string(s.src, ' ') AS source, tgt AS target FROM targets t JOIN samples s USING (sample_id)",
    "merge_datasets": _COMMON + ", r AS (SELECT sample_id, target_id, tgt, count(*) OVER (PARTITION BY sample_id) AS n FROM targets WHERE k > 0) SELECT sample_id, target_id, tgt AS tgt_tokens FROM r UNION ALL SELECT sample_id, CAST(target_id + n AS INT), tgt FROM r",
    "extend_datasets": _COMMON + ", b AS (SELECT max(sample_id) + 1 AS b FROM samples) SELECT sample_id, array_to_string(src, ' ') AS src_tokens FROM samples UNION ALL SELECT sample_id + b, array_to_string(src, ' ') FROM samples, b",
    "sample_flags": _COMMON + "SELECT t.sample_id, bool_or(tgt = '') AS has_empty, count(DISTINCT tgt) < count(*) AS has_repeated, bool_or(tt = s.src) AS has_unchanged FROM targets t JOIN samples s USING (sample_id) GROUP BY 1",
    "check_datasets": _COMMON + ", t AS (SELECT u.* FROM targets u JOIN samples s USING (sample_id) WHERE k = 0 OR s.src[1] < 'n'), n AS (SELECT sample_id, count(*) FILTER (WHERE k = 0) AS h, count(*) FILTER (WHERE k > 0) AS r FROM t GROUP BY 1) SELECT s.sample_id FROM samples s LEFT JOIN n USING (sample_id) WHERE coalesce(h, 0) <> 1 OR coalesce(r, 0) < 1",
    "block_round_trip": _COMMON + "SELECT array_to_string(s.src, ' ') AS source, target_id, src_start, src_end, tgt_start, tgt AS tgt_tokens, count(*) AS n FROM edits JOIN samples s USING (sample_id) WHERE k > 0 GROUP BY ALL",
    "subword_align": _COMMON + ", u AS (SELECT sample_id, t, i, length(t) > 4 AS two FROM tok), x AS (SELECT sample_id, i AS word, unnest(CASE WHEN two THEN [0, 1] ELSE [0] END) AS j FROM u) SELECT sample_id, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY word, j) - 1 AS INT) AS pos, word FROM x",
    "char_tokens": _COMMON + "SELECT sample_id, CAST(length(regexp_replace(array_to_string(src, ''), '\\s', '', 'g')) AS BIGINT) AS n_chars FROM samples",
    "token_similarity": _COMMON + ", o AS (SELECT e.*, s.src[src_start + 1] AS a FROM edits e JOIN samples s USING (sample_id) WHERE src_end - src_start = 1 AND tgt <> '') SELECT sample_id, side, target_id, edit_no, round(1 - levenshtein(a, tgt)::DOUBLE / greatest(length(a), length(tgt)), 6) AS similarity, length(a) = length(tgt) AND contains(a || a, tgt) AS rotation FROM o",
    "cjk_filter": "SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 37) || '...' ELSE text END AS head, regexp_matches(substr(text, 1, 1), '[!-/:-@\\[-`{-~]') AS punct FROM documents WHERE NOT regexp_matches(text, '[\\x{3400}-\\x{9fff}]')",
    "reverted_refs": _CHUNKS_ALL + ", b1 AS (SELECT sample_id, k, chunk_idx FROM ch WHERE k > 0 AND marked), p1 AS (SELECT b.sample_id, b.k, b.chunk_idx, c.chunk_idx AS ci, CASE WHEN c.chunk_idx = b.chunk_idx THEN array_to_string(s.src[c.src_start + 1:c.src_end], ' ') ELSE c.tgt END AS x FROM b1 b JOIN ch c ON c.sample_id = b.sample_id AND c.k = b.k JOIN samples s ON s.sample_id = b.sample_id) SELECT sample_id, CAST(k - 1 AS INT) AS target_id, chunk_idx, coalesce(string_agg(x, ' ' ORDER BY ci) FILTER (WHERE x <> ''), '') AS tokens FROM p1 GROUP BY sample_id, k, chunk_idx",
    "vector_similarity": _COMMON + """, nn AS (SELECT count(*) AS n FROM embeddings),
a AS (SELECT t.sample_id, t.i, (length(t) * 31 + ascii(t) * 7 + ascii(right(t, 1)) * 13) % nn.n AS v FROM tok t, nn),
b AS (SELECT sample_id, k, i, (length(t) * 31 + ascii(t) * 7 + ascii(right(t, 1)) * 13) % nn.n AS v FROM (SELECT sample_id, k, unnest(tt) AS t, unnest(range(len(tt))) AS i FROM targets WHERE k > 0), nn),
used AS MATERIALIZED (SELECT DISTINCT v FROM (SELECT v FROM a UNION ALL SELECT v FROM b)),
e AS MATERIALIZED (SELECT vec_id AS v, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IN (SELECT v FROM used)),
cs AS MATERIALIZED (SELECT p.v AS va, q.v AS vb, list_cosine_similarity(p.x, q.x) AS c FROM e p, e q),
al AS MATERIALIZED (SELECT sample_id, v, count(*) AS n FROM a GROUP BY ALL), bl AS MATERIALIZED (SELECT sample_id, k, v, count(*) AS n FROM b GROUP BY ALL),
m AS MATERIALIZED (SELECT bl.sample_id, bl.k, al.v AS va, bl.v AS vb, al.n AS na, bl.n AS nb, cs.c FROM bl JOIN al USING (sample_id) JOIN cs ON cs.va = al.v AND cs.vb = bl.v),
p AS (SELECT sample_id, k, sum(na * c) / sum(na) AS p FROM (SELECT sample_id, k, va, any_value(na) AS na, max(c) AS c FROM m GROUP BY ALL) GROUP BY ALL),
r AS (SELECT sample_id, k, sum(nb * c) / sum(nb) AS r FROM (SELECT sample_id, k, vb, any_value(nb) AS nb, max(c) AS c FROM m GROUP BY ALL) GROUP BY ALL)
SELECT t.sample_id, CAST(t.k - 1 AS INT) AS ref_id, round(CASE WHEN t.tgt = '' OR s.n = 0 THEN CAST(t.tgt = '' AND s.n = 0 AS INT) WHEN p > 0 AND r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS sim_src_tgt
FROM targets t JOIN samples s USING (sample_id) LEFT JOIN p USING (sample_id, k) LEFT JOIN r USING (sample_id, k) WHERE t.k > 0""",
    "chinese_round_trip": _COMMON + f"SELECT sample_id, side, target_id, translate(tgt, '{_LETTERS}', '{_CHARACTERS}') AS tgt_tokens FROM targets",
    "spelling_errors": _COMMON + """, w AS (SELECT e.sample_id, side, target_id, edit_no, s.src[src_start + 1] AS a, src_start % 4 = 0 AS even FROM edits e JOIN samples s USING (sample_id) WHERE src_end - src_start = 1),
x AS MATERIALIZED (SELECT sample_id, side, target_id, edit_no, a, CASE WHEN even THEN translate(a, 'aeiou', 'eioua') ELSE reverse(a) END AS b FROM w),
y AS MATERIALIZED (SELECT *, list_sort(string_split(a, '')) = list_sort(string_split(b, '')) AS turned FROM x),
z AS (SELECT DISTINCT a, b, unnest(string_split(a, '')) AS c, unnest(string_split(b, '')) AS d FROM y WHERE NOT turned),
q AS MATERIALIZED (SELECT DISTINCT c, d FROM z WHERE c <> d),
k AS (SELECT c, d, ascii(c) % 11 <> 0 AND ascii(d) % 11 <> 0 AS known, bin(ascii(c)) AS sc, bin(ascii(d)) AS sd,
  [chr(97 + ascii(c) % 7) || chr(97 + ascii(c) % 3), chr(97 + ascii(c) % 5) || chr(97 + ascii(c) % 2)] AS pc, [chr(97 + ascii(d) % 7) || chr(97 + ascii(d) % 3), chr(97 + ascii(d) % 5) || chr(97 + ascii(d) % 2)] AS pd FROM q),
l AS MATERIALIZED (SELECT c, d, CASE WHEN known THEN 1 - levenshtein(sc, sd)::DOUBLE / greatest(length(sc), length(sd)) + greatest(
  1 - levenshtein(pc[1], pd[1])::DOUBLE / 2, 1 - levenshtein(pc[1], pd[2])::DOUBLE / 2, 1 - levenshtein(pc[2], pd[1])::DOUBLE / 2, 1 - levenshtein(pc[2], pd[2])::DOUBLE / 2) END AS likeness,
  known AND list_has_any(pc, pd) AS heard FROM k),
g AS (SELECT a, b, min(likeness) AS likeness, bool_and(coalesce(likeness >= 0.8, false) OR heard) AS ok FROM z JOIN l USING (c, d) GROUP BY ALL)
SELECT sample_id, side, target_id, edit_no, round(g.likeness, 6) AS likeness, turned OR coalesce(g.ok, false) AS misspelled FROM y LEFT JOIN g ON NOT turned AND g.a = y.a AND g.b = y.b""",
    "block_texts_round_trip": _COMMON + "SELECT array_to_string(s.src, ' ') AS src_tokens, tgt AS tgt_tokens, 0 AS target_id, count(*) AS n FROM targets t JOIN samples s USING (sample_id) WHERE k > 0 AND tt <> s.src GROUP BY ALL",
    "source_conflicts": _COMMON + "SELECT sample_id FROM samples WHERE regexp_matches(src[1], '^[aeiou]')",
    "edit_type_numbers": _COMMON + f""", v AS (SELECT * FROM (VALUES {", ".join(f"('{t}', {k})" for k, t in enumerate(EDIT_TYPES["eng"]))}) v(type, type_no)),
e AS (SELECT op || ':' || (['NOUN', 'VERB:TENSE', 'DET', 'WO', 'WORD'])[length(array_to_string(list_concat(s.src[src_start + 1:src_end], CASE WHEN tgt = '' THEN [] ELSE [tgt] END), ' ')) % 5 + 1] AS type FROM edits JOIN samples s USING (sample_id))
SELECT type, coalesce(type_no, -1) AS type_no, count(*) AS n FROM e LEFT JOIN v USING (type) GROUP BY ALL""",
    "tag_categories": _COMMON + f""", g AS (SELECT CASE WHEN NOT regexp_matches(t, '\\p{{L}}') THEN '.' WHEN length(t) <= 2 THEN 'IN' WHEN length(t) = 3 THEN 'DT' WHEN lower(t) LIKE '%s' THEN 'NNS' WHEN lower(t) LIKE '%ed' THEN 'VBD' WHEN lower(t) LIKE '%ng' THEN 'VBG' WHEN lower(t) LIKE '%y' THEN 'JJ' ELSE 'NN' END AS tag FROM tok),
c AS (SELECT * FROM (VALUES {", ".join(f"('{t}', '{c}')" for c, ts in TAGS.items() for t in ts if "'" not in t)}) v(tag, category))
SELECT tag, category, count(*) AS n FROM g LEFT JOIN c USING (tag) GROUP BY ALL""",
    "scores_side_by_side": "SELECT " + ", ".join(f"(SELECT round(f, 6) FROM ({q})) AS {name}" for name, q in {
        "corpus_unweighted": _COMMON + _IND + _cnt(pairs="live") + _ONE_REF + _prf("tot") + "SELECT f FROM prf", "corpus_weighted": _COMMON + _IND + _W + _cnt("mw", "w", "live") + _ONE_REF + _prf("tot") + "SELECT f FROM prf",
        "sentence_unweighted": _COMMON + _IND + _cnt(pairs="live") + _prf("cnt") + _SENT, "sentence_weighted": _COMMON + _IND + _W + _cnt("mw", "w", "live") + _prf("cnt") + _SENT,
    }.items()),
    "edit_types": _COMMON + """, x AS (SELECT tgt, src_end - src_start AS n, lower(s.src[src_start + 1]) AS a, lower(tgt) AS b FROM edits JOIN samples s USING (sample_id)),
c AS (SELECT CASE WHEN n = 0 THEN 'M:OTHER' WHEN tgt = '' THEN 'U:OTHER' WHEN n > 1 THEN 'R:OTHER' WHEN a = b THEN 'R:ORTH'
  WHEN length(a) > 3 AND length(b) > 3 AND substr(a, 1, 4) = substr(b, 1, 4) THEN 'R:MORPH' WHEN 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) > 0.5 THEN 'R:SPELL' ELSE 'R:OTHER' END AS type FROM x)
SELECT type, count(*) AS n FROM c GROUP BY 1""",
    "sentence_split": """WITH m AS (SELECT doc_id, string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?]+[”"’'']?)', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(parts, lambda x: trim(x, ' ')), lambda x: x <> '') AS parts FROM m),
c AS (SELECT doc_id, flatten(list_transform(parts, lambda x: list_transform(range(0, CAST(floor((length(x) - 1) / 510.0) AS BIGINT) + 1), lambda k: substr(x, CAST(k * 510 + 1 AS BIGINT), 510)))) AS s FROM p)
SELECT doc_id, CAST(unnest(range(len(s))) AS INT) AS no, unnest(s) AS sentence FROM c""",
}
