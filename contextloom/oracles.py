"""Training in SQL: the trainers on two features as a recursive query, a step for each row of a stream, for DuckDB to check them by.

A state holds a stream's models with the rows of their memories, the buffer and the current model. Scores need no
decomposition: with two features the truncated form is l1 (c1 . d)^2 = l1 (d'Sd - l2 |d|^2) / (l1 - l2).
"""

from __future__ import annotations

from contextloom.plans.kernel import Params

_ROW = "STRUCT(seq BIGINT, a DOUBLE, b DOUBLE)"
_MODEL = f"STRUCT(id BIGINT, r {_ROW}[], last BIGINT, m1 DOUBLE, m2 DOUBLE, s11 DOUBLE, s12 DOUBLE, s22 DOUBLE, l1 DOUBLE, l2 DOUBLE, k INTEGER)"
_HELD = "STRUCT(seq BIGINT, a DOUBLE, b DOUBLE, s DOUBLE)"
_LABEL = "STRUCT(seq BIGINT, context_id BIGINT, score DOUBLE, is_outlier BOOLEAN)"


def _let(name: str, value: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _model(model_id: str, rows: str, last: str, p_var: float) -> str:
    """A model struct from a list of rows."""
    n = "len(u.r)"
    sums = lambda x, y, p, q: f"CASE WHEN {n} > 1 THEN list_sum(list_transform(u.r, lambda r: (r.{x} - u.{p}) * (r.{y} - u.{q}))) / ({n} - 1) ELSE 0 END"
    means = f"{{'r': w, 'm1': list_avg(list_transform(w, lambda r: r.a)), 'm2': list_avg(list_transform(w, lambda r: r.b))}}"
    cov = f"{{'s11': {sums('a', 'a', 'm1', 'm1')}, 's12': {sums('a', 'b', 'm1', 'm2')}, 's22': {sums('b', 'b', 'm2', 'm2')}}}"
    eig = "{'mid': (c.s11 + c.s22) / 2, 'off': sqrt((c.s11 - c.s22) * (c.s11 - c.s22) / 4 + c.s12 * c.s12)}"
    k = "2" if p_var >= 1 else f"CASE WHEN e.mid > 0 AND (e.mid + e.off) / (e.mid + e.off + greatest(e.mid - e.off, 0)) >= {p_var} THEN 1 ELSE 2 END"
    whole = f"CAST({{'id': {model_id}, 'r': u.r, 'last': {last}, 'm1': u.m1, 'm2': u.m2, 's11': c.s11, 's12': c.s12, 's22': c.s22, 'l1': e.mid + e.off, 'l2': greatest(e.mid - e.off, 0), 'k': {k}}} AS {_MODEL})"
    return _let("w", rows, _let("u", means, _let("c", cov, _let("e", eig, whole))))


def score(m: str, kind: str) -> str:
    d1, d2 = f"(x1 - {m}.m1)", f"(x2 - {m}.m2)"
    form = f"({m}.s11 * {d1} * {d1} + 2 * {m}.s12 * {d1} * {d2} + {m}.s22 * {d2} * {d2})"
    first = f"(({form} - {m}.l2 * ({d1} * {d1} + {d2} * {d2})) / nullif({m}.l1 - {m}.l2, 0))"
    if kind == "mahalanobis":
        both = f"(({m}.s22 * {d1} * {d1} - 2 * {m}.s12 * {d1} * {d2} + {m}.s11 * {d2} * {d2}) / ({m}.s11 * {m}.s22 - {m}.s12 * {m}.s12))"
        return f"sqrt(greatest(CASE WHEN {m}.l2 > 1e-24 THEN {both} ELSE coalesce({first} / nullif({m}.l1, 0), 0) END, 0))"
    return f"sqrt(greatest(CASE WHEN {m}.k = 2 THEN {form} ELSE {m}.l1 * {first} END, 0))"


def trainer(source: str, params: list[Params]) -> str:
    """CTEs st (states: pid, uid, k, models, ...) and lab (pid, uid, seq, context_id, score, is_outlier) of the first
    algorithm, after the CTEs of `source`, which end in z (user_id, seq, x1, x2). The parameter sets differ in drift_threshold
    and drift_size alone. The first of its CTEs needs WITH RECURSIVE."""
    p = params[0]
    grid = ", ".join(f"({i}, CAST({q.drift_threshold} AS DOUBLE), {q.drift_size}, {q.first_rows})" for i, q in enumerate(params))
    # What a model learns in a step: the buffer goes to the best or the current one, the row to the best.
    bare = "list_transform(buf, lambda h: {'seq': h.seq, 'a': h.a, 'b': h.b})"
    to = "best.id" if p.partial_memory_to == "best" else "cur"
    learnt = f"(m.r || CASE WHEN m.id = {to} THEN {bare} ELSE CAST([] AS {_ROW}[]) END || CASE WHEN m.id = best.id THEN [now] ELSE CAST([] AS {_ROW}[]) END)[-{p.model_mem}:]"
    named = "best.id" if p.partial_label_to == "best" else "cur"
    far = "list_append(buf, {'seq': seq, 'a': x1, 'b': x2, 's': best.s})"
    waiting = "list_append(wait, now)"
    said = lambda rows, to, s, o: f"list_transform({rows}, lambda h: CAST({{'seq': h.seq, 'context_id': {to}, 'score': {s}, 'is_outlier': {o}}} AS {_LABEL}))"
    changed = f"m.id = best.id OR (m.id = {to} AND len(buf) > 0)"
    return f"""{source},
zz AS (SELECT user_id AS uid, seq, x1, x2, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k FROM z),
pr(pid, thr, size, init) AS (VALUES {grid}),
st AS (
  SELECT pid, uid, CAST(0 AS BIGINT) AS k, thr, size, init, CAST(0 AS BIGINT) AS cur, CAST([] AS {_MODEL}[]) AS models, CAST([] AS {_HELD}[]) AS buf, CAST([] AS {_ROW}[]) AS wait, CAST([] AS {_LABEL}[]) AS labels
  FROM (SELECT DISTINCT uid FROM zz) CROSS JOIN pr
  UNION ALL
  SELECT pid, uid, k, thr, size, init,
    CASE kind WHEN 'first' THEN 1 WHEN 'near' THEN best.id WHEN 'born' THEN len(models) + 1 ELSE cur END,
    CASE kind WHEN 'first' THEN [{_model('1', waiting, 'seq', p.p_var)}]
      WHEN 'born' THEN list_append(models, {_model('len(models) + 1', f"list_transform({far}, lambda h: {{'seq': h.seq, 'a': h.a, 'b': h.b}})", 'seq', p.p_var)})
      WHEN 'near' THEN list_transform(models, lambda m: CASE WHEN {changed} THEN {_model('m.id', learnt, 'seq', p.p_var)} ELSE m END) ELSE models END,
    CASE kind WHEN 'far' THEN {far} ELSE CAST([] AS {_HELD}[]) END,
    CASE kind WHEN 'wait' THEN {waiting} ELSE CAST([] AS {_ROW}[]) END,
    CASE kind WHEN 'first' THEN {said(waiting, '1', 'CAST(NULL AS DOUBLE)', 'false')} WHEN 'born' THEN {said(far, 'len(models) + 1', 'h.s', 'true')}
      WHEN 'near' THEN list_append({said('buf', named, 'h.s', 'true')}, CAST({{'seq': seq, 'context_id': best.id, 'score': best.s, 'is_outlier': false}} AS {_LABEL})) ELSE CAST([] AS {_LABEL}[]) END
  FROM (SELECT *, CASE WHEN len(models) = 0 THEN CASE WHEN len(wait) + 1 = init THEN 'first' ELSE 'wait' END WHEN best.s <= thr THEN 'near' WHEN len(buf) + 1 >= size THEN 'born' ELSE 'far' END AS kind
    FROM (SELECT st.* EXCLUDE (k), zz.k, seq, x1, x2, CAST({{'seq': seq, 'a': x1, 'b': x2}} AS {_ROW}) AS now,
            list_min(list_transform(models, lambda m: {{'s': {score('m', p.score)}, 'id': m.id}})) AS best
          FROM st JOIN zz ON zz.uid = st.uid AND zz.k = st.k + 1))),
fin AS (SELECT pid, uid, arg_max({{'cur': cur, 'models': models, 'buf': buf, 'wait': wait}}, k) AS f, max(k) AS n FROM st GROUP BY pid, uid),
la AS (SELECT pid, uid, unnest(labels) AS l FROM st UNION ALL
  SELECT pid, uid, unnest(CASE WHEN len(f.models) = 0 THEN {said('f.wait', '1', 'CAST(NULL AS DOUBLE)', 'false')} ELSE {said('f.buf', 'f.cur', 'h.s', 'true')} END) FROM fin),
lab AS (SELECT pid, uid, l.seq AS seq, l.context_id AS context_id, l.score AS score, l.is_outlier AS is_outlier FROM la),
mo AS (SELECT pid, uid, unnest(CASE WHEN len(f.models) = 0 AND len(f.wait) > 0 THEN [{_model('1', 'f.wait', 'f.wait[-1].seq', p.p_var)}]
    WHEN len(f.buf) > 0 THEN list_transform(f.models, lambda m: CASE WHEN m.id = f.cur THEN {_model('m.id', "(m.r || list_transform(f.buf, lambda h: {'seq': h.seq, 'a': h.a, 'b': h.b}))[-" + str(p.model_mem) + ":]", 'f.buf[-1].seq', p.p_var)} ELSE m END) ELSE f.models END) AS m FROM fin)"""


LABELS = " SELECT uid AS stream_key, CAST(seq AS BIGINT) AS seq, CAST(context_id AS INTEGER) AS context_id, round(score, 6) AS score, is_outlier FROM lab"
