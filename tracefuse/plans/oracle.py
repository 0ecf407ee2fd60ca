"""Independent DuckDB SQL for each registered query (correctness oracle).

These are written straightforwardly (windows, cross joins with small grids)
because they only run at the check scale; the library versions are the
scalable ones.
"""

from __future__ import annotations

SCORES = """s AS (
  SELECT doc_id, CAST(toxic AS INTEGER) AS scenario, CAST(quality AS INTEGER) AS y,
         (doc_id * 7919 % 1000) / 1000 AS p_sys, (doc_id * 104729 % 1000) / 1000 AS p_net
  FROM labels)"""

FUSED = SCORES + """,
f AS (
  SELECT *, CAST(p_sys >= 0.5 AS INTEGER) AS pred_syscall, CAST(p_net >= 0.5 AS INTEGER) AS pred_network,
         CASE WHEN p_sys >= 0.6 THEN 1 WHEN p_net >= 0.5 AND p_sys >= 0.1 THEN 1 ELSE 0 END AS pred_hybrid,
         CASE WHEN p_sys >= 0.6 THEN 'syscall_dominant'
              WHEN p_net >= 0.5 AND p_sys >= 0.1 THEN 'network_corroborates' ELSE 'none' END AS fired_rule
  FROM s),
u AS (
  SELECT scenario, y, 'syscall' AS model, pred_syscall AS pred FROM f UNION ALL
  SELECT scenario, y, 'network', pred_network FROM f UNION ALL
  SELECT scenario, y, 'hybrid', pred_hybrid FROM f)"""

CONF = """CAST(SUM(CASE WHEN y = 0 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(SUM(CASE WHEN y = 0 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(SUM(CASE WHEN y = 1 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(SUM(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp"""


def _div(n: str, d: str) -> str:
    return f"CASE WHEN ({d}) > 0 THEN CAST({n} AS DOUBLE) / ({d}) ELSE CAST(0.0 AS DOUBLE) END"


RATES = ", ".join([
    f"{_div('tp + tn', 'tp + tn + fp + fn')} AS accuracy",
    f"{_div('tp', 'tp + fp')} AS precision",
    f"{_div('tp', 'tp + fn')} AS recall",
    f"{_div('2 * tp', '2 * tp + fp + fn')} AS f1",
    f"{_div('fp', 'fp + tn')} AS fpr",
    f"{_div('fn', 'fn + tp')} AS fnr",
])

STACK = SCORES + """,
st AS (SELECT y, 'syscall' AS model, p_sys AS score FROM s UNION ALL
       SELECT y, 'network', p_net FROM s)"""

AUC_FROM = """g AS (
  SELECT {keys}, score, CAST(SUM(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
         CAST(SUM(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS neg
  FROM {src} WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY {keys}, score),
r AS (
  SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY {keys} ORDER BY score
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM g),
auc AS (
  SELECT {keys},
         CASE WHEN SUM(pos) > 0 AND SUM(neg) > 0
              THEN CAST(SUM(pos * (2 * below + neg)) AS DOUBLE) / CAST(2 * SUM(pos) * SUM(neg) AS DOUBLE) END AS roc_auc,
         CAST(SUM(pos) AS BIGINT) AS n_pos, CAST(SUM(neg) AS BIGINT) AS n_neg
  FROM r GROUP BY {keys})"""

ALIASES = """a(name, feature) AS (VALUES ('view', 'evt_read'), ('click', 'evt_read'),
  ('purchase', 'evt_write'), ('signup', 'evt_openat'))"""

EVENT_WIDE = """CAST(COUNT(*) FILTER (WHERE feature IN ('evt_read','evt_write','evt_openat','evt_close')) AS DOUBLE) AS total_events,
  CAST(COUNT(*) FILTER (WHERE feature = 'evt_read') AS DOUBLE) AS evt_read,
  CAST(COUNT(*) FILTER (WHERE feature = 'evt_write') AS DOUBLE) AS evt_write,
  CAST(COUNT(*) FILTER (WHERE feature = 'evt_openat') AS DOUBLE) AS evt_openat,
  CAST(COUNT(*) FILTER (WHERE feature = 'evt_close') AS DOUBLE) AS evt_close"""

EVENT_COLS = ["total_events", "evt_read", "evt_write", "evt_openat", "evt_close"]


def _zero(cols, t="c"):
    return ", ".join(f"COALESCE({t}.{c}, 0.0) AS {c}" for c in cols)


WINDOW_FEATURES = ALIASES + """,
ev AS (SELECT user_id AS container, epoch_us(ts) // 1000000 AS ts_s, event_type FROM events),
m AS (SELECT container, MIN(ts_s) AS start_ts FROM ev WHERE event_type = 'signup' GROUP BY container),
e AS (SELECT ev.container, ev.ts_s - COALESCE(m.start_ts, 0) AS elapsed, a.feature
      FROM ev JOIN a ON a.name = ev.event_type LEFT JOIN m ON m.container = ev.container),
w(window_tag, lim) AS (VALUES ('N3', 3 * 86400), ('N5', 5 * 86400), ('N10', 10 * 86400),
                              ('N15', 15 * 86400), ('full', NULL)),
x AS (SELECT w.window_tag, e.container, e.feature FROM e JOIN w ON w.lim IS NULL OR e.elapsed <= w.lim),
c AS (SELECT window_tag, container, """ + EVENT_WIDE + """ FROM x GROUP BY window_tag, container),
k AS (SELECT DISTINCT user_id AS container, CAST(user_id % 3 = 0 AS INTEGER) AS label FROM events),
kw AS (SELECT w.window_tag, k.container, k.label FROM k CROSS JOIN w),
wf AS (SELECT kw.window_tag, kw.container, kw.label, """ + _zero(EVENT_COLS) + """
       FROM kw LEFT JOIN c ON c.window_tag = kw.window_tag AND c.container = kw.container)"""

WINDOW_SCORES = WINDOW_FEATURES + """,
ws AS (SELECT window_tag, container, label AS y,
              CASE WHEN total_events > 0 THEN (evt_write + evt_openat) / total_events ELSE 0.0 END AS p
       FROM wf),
wp AS (SELECT *, CAST(p >= 0.5 AS INTEGER) AS pred, p AS score FROM ws),
""" + AUC_FROM.format(keys="window_tag", src="wp") + """,
wm AS (
  SELECT cm.*, auc.roc_auc, sep.separation FROM
    (SELECT window_tag, """ + CONF + """ FROM wp GROUP BY window_tag) cm
    LEFT JOIN auc USING (window_tag)
    LEFT JOIN (SELECT window_tag, ROUND(AVG(CASE WHEN y = 1 THEN p END) - AVG(CASE WHEN y = 0 THEN p END), 6)
                      AS separation FROM wp GROUP BY window_tag) sep USING (window_tag))"""

STRACE_LONG = """sl AS (SELECT user_id % 10 AS container, 'evt_' || event_type AS feature, COUNT(*) AS n
       FROM events GROUP BY 1, 2)"""

PACKETS = """p AS (
  SELECT CASE WHEN l_suppkey % 4 = 0 THEN 'mal_' ELSE '' END || 'cap' || CAST(l_suppkey AS VARCHAR) || '_network.pcap' AS file,
         CASE WHEN l_discount > 0 THEN l_quantity END AS frame_len,
         CASE WHEN l_returnflag = 'R' THEN '6' WHEN l_returnflag = 'A' THEN '17' ELSE '6,17' END AS ip_proto,
         CASE WHEN l_linestatus = 'O' THEN l_partkey END AS tcp_dstport,
         CASE WHEN l_tax > 0 THEN l_partkey + 100000 END AS udp_dstport,
         CASE WHEN l_linenumber <> 7 THEN CAST(epoch_us(l_shipdate) // 1000000 AS DOUBLE) END AS t,
         l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity
  FROM lineitem),
agg AS (
  SELECT file, COUNT(frame_len) AS n_pkts, SUM(frame_len) AS s_bytes, AVG(frame_len) AS a_mean,
         STDDEV_SAMP(frame_len) AS a_std, MIN(frame_len) AS a_min, MAX(frame_len) AS a_max,
         COUNT(t) AS n_t, MAX(t) - MIN(t) AS span,
         MAX(CASE WHEN ip_proto = '6' THEN 1 ELSE 0 END) AS tcp,
         MAX(CASE WHEN ip_proto = '17' THEN 1 ELSE 0 END) AS udp,
         FIRST(COALESCE(tcp_dstport, udp_dstport) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity)
           FILTER (WHERE COALESCE(tcp_dstport, udp_dstport) IS NOT NULL) AS first_port
  FROM p GROUP BY file),
feat AS (
  SELECT file, CAST(COALESCE(first_port, 0) AS DOUBLE) AS dport, CAST(n_pkts AS DOUBLE) AS pkts,
         COALESCE(s_bytes, 0.0) AS bytes, CASE WHEN n_t > 1 THEN span ELSE 0.0 END AS dur,
         COALESCE(a_mean, 0.0) AS a_mean, CASE WHEN n_pkts > 1 THEN a_std ELSE 0.0 END AS a_std,
         COALESCE(a_min, 0.0) AS a_min, COALESCE(a_max, 0.0) AS a_max, tcp, udp
  FROM agg)"""

TRAINING = """t AS (
  SELECT l_quantity, l_discount, l_tax, l_linenumber, CAST(l_linestatus = 'O' AS INTEGER) AS is_open,
         1.0::DOUBLE AS const_one, CASE WHEN l_returnflag = 'Z' THEN 1.0::DOUBLE END AS sparse,
         CAST(l_returnflag = 'R' AS INTEGER) AS label_bin
  FROM lineitem),
d AS (SELECT DISTINCT * FROM t)"""

LABELLED = """lb AS (SELECT doc_id, CAST(quality AS INTEGER) AS y, doc_id * 7919 % 10007 AS h FROM labels),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY y ORDER BY h, doc_id) AS rank,
              COUNT(*) OVER (PARTITION BY y) AS class_n FROM lb)"""

FILES = """fn AS (
  SELECT doc_id,
         CASE doc_id % 4 WHEN 0 THEN 'mal_' WHEN 1 THEN 'MAL_' WHEN 2 THEN 'benign_' ELSE 'malicious-' END AS prefix,
         source, lang FROM documents),
nm AS (SELECT doc_id, prefix || source || '.logs_' || lang || '.log' AS sys_file,
              prefix || source || '_network.pcap' AS net_file FROM fn)"""

PAIR = """c AS (
  SELECT CAST(c_nationkey AS BIGINT) AS base,
         CAST(c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') AS INTEGER) AS label,
         (c_acctbal + 1000.0::DOUBLE) / 11000.0::DOUBLE AS p_sys,
         ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer),
sp AS (
  SELECT CAST(s_nationkey AS BIGINT) AS network_base, (s_acctbal + 1000.0::DOUBLE) / 11000.0::DOUBLE AS p_net,
         ROW_NUMBER() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier),
b AS (SELECT CAST(n_nationkey AS BIGINT) AS base, CAST((n_nationkey * 7) % 31 AS BIGINT) AS network_base FROM nation)"""

HOURLY = """hl AS (SELECT user_id AS container,
              'evt_' || event_type || '_' || lpad(CAST(hour(ts) AS VARCHAR), 2, '0') AS feature,
              COUNT(*) AS n FROM events GROUP BY 1, 2)"""

SWEEP = SCORES + """,
g AS (SELECT a.range AS a, b.range AS b, f.range AS f FROM range(21) a, range(21) b, range(21) f),
sw AS (
  SELECT a / 20 AS sys_hi, b / 20 AS net_hi, f / 20 AS sys_floor,
         CAST(SUM(CASE WHEN y = 1 AND (p_sys >= a / 20 OR (p_net >= b / 20 AND p_sys >= f / 20)) THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(SUM(CASE WHEN y = 0 AND (p_sys >= a / 20 OR (p_net >= b / 20 AND p_sys >= f / 20)) THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(SUM(CASE WHEN y = 1 AND NOT (p_sys >= a / 20 OR (p_net >= b / 20 AND p_sys >= f / 20)) THEN 1 ELSE 0 END) AS BIGINT) AS fn,
         CAST(SUM(CASE WHEN y = 0 AND NOT (p_sys >= a / 20 OR (p_net >= b / 20 AND p_sys >= f / 20)) THEN 1 ELSE 0 END) AS BIGINT) AS tn
  FROM g CROSS JOIN s GROUP BY a, b, f),
swr AS (SELECT *, """ + ", ".join([
    f"{_div('tp', 'tp + fn')} AS recall",
    f"{_div('tp', 'tp + fp')} AS precision",
    f"{_div('2 * tp', '2 * tp + fp + fn')} AS f1",
    f"{_div('fp', 'fp + tn')} AS fpr"]) + " FROM sw)"


def _report_rows() -> str:
    cols = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "is_open", "const_one", "sparse"]
    parts = [f"""SELECT '{c}' AS "column", COUNT({c}) AS n_nonnull, CAST(MIN({c}) AS DOUBLE) AS min_value,
       CAST(MAX({c}) AS DOUBLE) AS max_value FROM d""" for c in cols]
    return " UNION ALL ".join(parts)


SYSDIG = r"""ln AS (
  SELECT CASE WHEN event_type = 'error' THEN 'u' || user_id || ' ' || (epoch_us(ts) // 1000000)
              WHEN value < 2 THEN 'u' || user_id || ' t' || (epoch_us(ts) // 1000000) || ' ' || event_type
              WHEN event_type = 'purchase' THEN 'u' || user_id || ' ' || (epoch_us(ts) // 1000000) || ' ' || upper(event_type) || ' extra'
              WHEN event_type = 'view' THEN ' ' || chr(9) || 'u' || user_id || chr(9) || ' ' || (epoch_us(ts) // 1000000) || '  ' || event_type || chr(9)
              ELSE 'u' || user_id || ' ' || (epoch_us(ts) // 1000000) || ' ' || event_type END AS value
  FROM events),
tk AS (SELECT regexp_replace(value, '^\s+|\s+$', '', 'g') AS v FROM ln),
sp AS (SELECT v, string_split_regex(v, '\s+') AS t FROM tk),
ps AS (SELECT t[1] AS container, TRY_CAST(t[2] AS BIGINT) AS ts_s, lower(t[3]) AS syscall,
              CASE WHEN v = '' THEN 'blank' WHEN starts_with(v, 'SYSDIG_UNAVAILABLE') THEN 'sentinel'
                   WHEN len(t) < 3 THEN 'short' WHEN TRY_CAST(t[2] AS BIGINT) IS NULL THEN 'bad_time'
                   ELSE 'ok' END AS status FROM sp)"""

RUNTIME = ALIASES + """,
k AS (SELECT range AS container, CAST(range >= 5 AS INTEGER) AS label FROM range(12)),
e AS (SELECT user_id % 10 AS container, a.feature FROM events JOIN a ON a.name = events.event_type),
c AS (SELECT container, """ + EVENT_WIDE + """ FROM e GROUP BY container),
ss AS (SELECT k.container AS base, k.label,
              CASE WHEN COALESCE(c.total_events, 0.0) > 0
                   THEN (COALESCE(c.evt_write, 0.0) + COALESCE(c.evt_openat, 0.0)) / c.total_events
                   ELSE 0.0 END AS p_sys
       FROM k LEFT JOIN c ON c.container = k.container),
ns AS (SELECT l_suppkey AS network_base,
              CAST(COUNT(CASE WHEN l_discount > 0 THEN l_quantity END) AS DOUBLE) AS pkts FROM lineitem GROUP BY l_suppkey),
br AS (SELECT range AS base, (range * 7) % 13 + 1 AS network_base FROM range(12)),
rt AS (SELECT br.base, br.network_base, ss.label, ss.p_sys, ns.pkts / (ns.pkts + 100.0::DOUBLE) AS p_net
       FROM br JOIN ss ON ss.base = br.base JOIN ns ON ns.network_base = br.network_base),
rf AS (SELECT *, CAST(p_sys >= 0.5 AS INTEGER) AS pred_syscall, CAST(p_net >= 0.5 AS INTEGER) AS pred_network,
              CASE WHEN p_sys >= 0.6 THEN 1 WHEN p_net >= 0.5 AND p_sys >= 0.1 THEN 1 ELSE 0 END AS pred_hybrid FROM rt),
ru AS (SELECT label AS y, 'syscall' AS model, pred_syscall AS pred FROM rf UNION ALL
       SELECT label, 'network', pred_network FROM rf UNION ALL
       SELECT label, 'hybrid', pred_hybrid FROM rf)"""

def _uniform(key: str, part: int) -> str:
    """Uniform number of a text's MD5, as the library draws it."""
    return f"((('0x' || substr(md5({key}), {1 + 13 * part}, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def _normal(key: str) -> str:
    return f"(sqrt(-2::DOUBLE * ln({_uniform(key, 0)})) * cos(2 * pi() * {_uniform(key, 1)}))"


def _shrink(p: str, signal: str) -> str:
    draw = _normal(f"'42:' || s.doc_id || ':' || gr.i || ':{signal}'")
    return (f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + gr.scale * ({p} - 0.5::DOUBLE) "
            f"+ {draw} * ((1.0::DOUBLE - gr.scale) * 0.1::DOUBLE)))")


NOISY_SWEEP = f"""WITH {SCORES},
  gr(i, n_window, scale) AS (VALUES (0, 5, 0.25::DOUBLE), (1, 10, 0.5::DOUBLE), (2, 15, 0.75::DOUBLE), (3, 30, 1.0::DOUBLE)),
  x AS (SELECT gr.n_window, gr.scale, s.y, {_shrink('s.p_sys', 's')} AS ps, {_shrink('s.p_net', 'n')} AS pn
        FROM s CROSS JOIN gr),
  pr AS (SELECT n_window, scale, y, ps >= 0.5 AS a, pn >= 0.5 AS b, ps >= 0.6 OR (pn >= 0.5 AND ps >= 0.1) AS h FROM x),
  m AS (SELECT n_window, scale, y, model, pred FROM pr UNPIVOT (pred FOR model IN (a, b, h))),
  c AS (SELECT n_window, scale, model, count(*) FILTER (y = 1 AND pred) AS tp, count(*) FILTER (y = 0 AND pred) AS fp,
               count(*) FILTER (y = 1 AND NOT pred) AS fn FROM m GROUP BY ALL),
  f AS (SELECT n_window, scale, model, {_div('2 * tp', '2 * tp + fp + fn')} AS f1 FROM c)
SELECT CAST(n_window AS INTEGER) AS n_window, scale, max(f1) FILTER (model = 'a') AS f1_syscall,
       max(f1) FILTER (model = 'b') AS f1_network, max(f1) FILTER (model = 'h') AS f1_hybrid FROM f GROUP BY ALL"""

FOURIER = f"""WITH w AS (SELECT j, i, {_normal("'7:' || j || ':' || i")} * sqrt(2::DOUBLE / 64) AS w
                FROM range(8) a(j), range(64) b(i)),
  b AS (SELECT j, 2 * pi() * {_uniform("'7:' || j || ':phase'", 0)} AS b FROM range(8) a(j)),
  x AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
  z AS (SELECT vec_id, w.j, round(0.5::DOUBLE * cos(sum(x * w ORDER BY w.i) + any_value(b)), 9) AS z
        FROM x JOIN w ON w.i = x.i JOIN b ON b.j = w.j GROUP BY vec_id, w.j)
SELECT vec_id, {", ".join(f"max(z) FILTER (j = {j}) AS z{j}" for j in range(8))} FROM z GROUP BY vec_id"""

PLATT = """WITH m AS (SELECT doc_id, 2.0::DOUBLE * (doc_id % 2) - 1 AS margin,
                  CASE WHEN doc_id % 2 = 0 THEN CAST(quality AS INTEGER) ELSE 1 - CAST(quality AS INTEGER) END AS y FROM labels),
  n AS (SELECT count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM m),
  r AS (SELECT margin, avg(CASE WHEN y = 1 THEN (n1 + 1)::DOUBLE / (n1 + 2) ELSE 1::DOUBLE / (n0 + 2) END) AS p
        FROM m, n GROUP BY margin)
SELECT doc_id, m.margin, round(p, 6) AS p FROM m JOIN r ON r.margin = m.margin"""

ORACLE: dict[str, str] = {
    "detector_metrics": f"WITH {FUSED}, cm AS (SELECT model, {CONF} FROM u GROUP BY model) "
                        f"SELECT model, tn, fp, fn, tp, {RATES} FROM cm",
    "confusion_by_model": f"WITH {FUSED} SELECT scenario, model, {CONF} FROM u GROUP BY scenario, model",
    "fusion_decision": f"WITH {FUSED} SELECT doc_id, y, p_sys, p_net, pred_syscall, pred_network, "
                       "pred_hybrid, fired_rule FROM f",
    "fusion_rule_counts": f"WITH {FUSED} SELECT y, fired_rule, COUNT(*) AS n FROM f GROUP BY y, fired_rule",
    "probability_bands": f"""WITH {SCORES},
  bd AS (SELECT *, CASE WHEN p_sys >= 0.6 AND p_net < 0.5 THEN 'A'
                        WHEN p_sys < 0.1 AND p_net >= 0.6 THEN 'B'
                        WHEN p_sys >= 0.1 AND p_sys < 0.6 AND p_net >= 0.5 THEN 'C'
                        WHEN p_sys >= 0.6 AND p_net >= 0.5 THEN 'D'
                        WHEN p_sys < 0.1 AND p_net < 0.5 THEN 'E' END AS band FROM s),
  nb AS (SELECT band, COUNT(*) AS n_in_band FROM bd WHERE band IS NOT NULL GROUP BY band),
  fb AS (SELECT * FROM bd WHERE band IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY band ORDER BY doc_id) = 1)
  SELECT fb.band, fb.doc_id, fb.y, fb.p_sys, fb.p_net, nb.n_in_band,
         CASE WHEN p_sys >= 0.6 THEN 1 WHEN p_net >= 0.5 AND p_sys >= 0.1 THEN 1 ELSE 0 END AS pred_hybrid
  FROM fb JOIN nb USING (band)""",
    "class_distribution": f"""WITH {SCORES}, c AS (SELECT y AS label, COUNT(*) AS n FROM s GROUP BY y)
  SELECT label, n, n / SUM(n) OVER () AS share FROM c""",
    "class_report": f"""WITH {FUSED}, cm AS (SELECT model, {CONF} FROM u GROUP BY model),
  pc AS (SELECT model, tn, fp, fn, tp,
      {_div('tp', 'tp + fp')} AS p1, {_div('tp', 'tp + fn')} AS r1, {_div('2 * tp', '2 * tp + fp + fn')} AS f1_1,
      {_div('tn', 'tn + fn')} AS p0, {_div('tn', 'tn + fp')} AS r0, {_div('2 * tn', '2 * tn + fn + fp')} AS f1_0,
      tp + fn AS s1, tn + fp AS s0 FROM cm)
  SELECT model, '0' AS class_name, p0 AS precision, r0 AS recall, f1_0 AS f1, CAST(s0 AS BIGINT) AS support FROM pc
  UNION ALL SELECT model, '1', p1, r1, f1_1, CAST(s1 AS BIGINT) FROM pc
  UNION ALL SELECT model, 'accuracy', NULL::DOUBLE, NULL::DOUBLE, {_div('tp + tn', 's0 + s1')}, CAST(s0 + s1 AS BIGINT) FROM pc
  UNION ALL SELECT model, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, CAST(s0 + s1 AS BIGINT) FROM pc
  UNION ALL SELECT model, 'weighted avg',
      CASE WHEN s0 + s1 > 0 THEN (p0 * s0 + p1 * s1) / (s0 + s1) ELSE 0.0 END,
      CASE WHEN s0 + s1 > 0 THEN (r0 * s0 + r1 * s1) / (s0 + s1) ELSE 0.0 END,
      CASE WHEN s0 + s1 > 0 THEN (f1_0 * s0 + f1_1 * s1) / (s0 + s1) ELSE 0.0 END,
      CAST(s0 + s1 AS BIGINT) FROM pc""",
    "roc_auc": f"WITH {STACK}, {AUC_FROM.format(keys='model', src='st')} SELECT * FROM auc",
    "roc_points": f"""WITH {STACK},
  g AS (SELECT model, score, SUM(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos,
               SUM(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS neg FROM st WHERE score IS NOT NULL GROUP BY model, score),
  t AS (SELECT model, SUM(pos) AS n_pos, SUM(neg) AS n_neg FROM g GROUP BY model),
  c AS (SELECT model, score, pos, neg, SUM(pos) OVER w AS cp, SUM(neg) OVER w AS cn,
               ROW_NUMBER() OVER (PARTITION BY model ORDER BY score DESC) AS rn,
               LEAD(pos) OVER (PARTITION BY model ORDER BY score DESC) AS npos,
               LEAD(neg) OVER (PARTITION BY model ORDER BY score DESC) AS nneg FROM g
        WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  SELECT model, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr, NULL::DOUBLE AS threshold FROM t
  UNION ALL
  SELECT c.model, {_div('cn', 'n_neg')} AS fpr, {_div('cp', 'n_pos')} AS tpr, score AS threshold
  FROM c JOIN t USING (model)
  WHERE rn = 1 OR npos IS NULL OR npos <> pos OR nneg <> neg""",
    "separation_gap": f"""WITH {STACK}
  SELECT model, ROUND(COALESCE(AVG(CASE WHEN y = 1 THEN score END), 0.0), 6) AS mean_pos,
         ROUND(COALESCE(AVG(CASE WHEN y = 0 THEN score END), 0.0), 6) AS mean_neg,
         ROUND(COALESCE(AVG(CASE WHEN y = 1 THEN score END), 0.0) - COALESCE(AVG(CASE WHEN y = 0 THEN score END), 0.0), 6) AS separation
  FROM st GROUP BY model""",
    "row_breakdown": f"""WITH {FUSED}
  SELECT doc_id, y, pred_hybrid AS pred,
         CASE WHEN y = 1 THEN 'Malicious' ELSE 'Benign' END AS true_label,
         CASE WHEN pred_hybrid = 1 THEN 'Malicious' ELSE 'Benign' END AS predicted,
         CASE WHEN pred_hybrid = 1 THEN 'MALICIOUS' ELSE 'BENIGN' END AS verdict,
         CAST(y = pred_hybrid AS INTEGER) AS correct,
         CAST(y = 0 AND pred_hybrid = 1 AS INTEGER) AS fp,
         CAST(y = 1 AND pred_hybrid = 0 AS INTEGER) AS fn
  FROM f""",
    "accuracy_summary": f"""WITH {FUSED},
  a AS (SELECT model, CAST(SUM(CASE WHEN y = pred THEN 1 ELSE 0 END) AS BIGINT) AS correct, COUNT(*) AS total
        FROM u GROUP BY model)
  SELECT model, correct, total, {_div('correct', 'total')} AS accuracy, {_div('correct * 100', 'total')} AS accuracy_pct FROM a""",
    "rule_agreement": f"""WITH {SCORES}
  SELECT CASE WHEN p_sys >= 0.6 OR (p_net >= 0.5 AND p_sys >= 0.1) THEN 1 ELSE 0 END AS pred_a,
         CASE WHEN p_sys >= 0.5 OR p_net >= 0.9 OR (p_net >= 0.5 AND p_sys >= 0.2) THEN 1 ELSE 0 END AS pred_b,
         COUNT(*) AS n
  FROM s GROUP BY 1, 2""",
    "robustness_sweep": f"""WITH {SCORES},
  gr(n_window, scale) AS (VALUES (5, 0.25::DOUBLE), (10, 0.5::DOUBLE), (15, 0.75::DOUBLE), (30, 1.0::DOUBLE)),
  x AS (SELECT gr.n_window, gr.scale, s.y,
               greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + gr.scale * (s.p_sys - 0.5::DOUBLE))) AS ps,
               greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + gr.scale * (s.p_net - 0.5::DOUBLE))) AS pn
        FROM s CROSS JOIN gr),
  pr AS (SELECT n_window, scale, y, CAST(ps >= 0.5 AS INTEGER) AS a, CAST(pn >= 0.5 AS INTEGER) AS b,
                CASE WHEN ps >= 0.6 THEN 1 WHEN pn >= 0.5 AND ps >= 0.1 THEN 1 ELSE 0 END AS h FROM x),
  c AS (SELECT n_window, scale,
          SUM(CASE WHEN y=1 AND a=1 THEN 1 ELSE 0 END) AS tpa, SUM(CASE WHEN y=0 AND a=1 THEN 1 ELSE 0 END) AS fpa,
          SUM(CASE WHEN y=1 AND a=0 THEN 1 ELSE 0 END) AS fna,
          SUM(CASE WHEN y=1 AND b=1 THEN 1 ELSE 0 END) AS tpb, SUM(CASE WHEN y=0 AND b=1 THEN 1 ELSE 0 END) AS fpb,
          SUM(CASE WHEN y=1 AND b=0 THEN 1 ELSE 0 END) AS fnb,
          SUM(CASE WHEN y=1 AND h=1 THEN 1 ELSE 0 END) AS tph, SUM(CASE WHEN y=0 AND h=1 THEN 1 ELSE 0 END) AS fph,
          SUM(CASE WHEN y=1 AND h=0 THEN 1 ELSE 0 END) AS fnh
        FROM pr GROUP BY n_window, scale)
  SELECT CAST(n_window AS INTEGER) AS n_window, scale,
         {_div('2 * tpa', '2 * tpa + fpa + fna')} AS f1_syscall,
         {_div('2 * tpb', '2 * tpb + fpb + fnb')} AS f1_network,
         {_div('2 * tph', '2 * tph + fph + fnh')} AS f1_hybrid FROM c""",
    "threshold_sweep": f"WITH {SWEEP} SELECT sys_hi, net_hi, sys_floor, tp, fp, fn, tn, recall, precision, f1, fpr FROM swr",
    "threshold_choice": f"""WITH {SWEEP} SELECT sys_hi, net_hi, sys_floor, tp, fp, fn, tn, recall, precision, f1, fpr
  FROM swr WHERE fpr <= 0 ORDER BY recall DESC, f1 DESC, sys_hi DESC, net_hi DESC, sys_floor DESC LIMIT 1""",
    "pair_predictions": f"""WITH {PAIR}
  SELECT b.base, b.network_base, c.label, c.p_sys, sp.p_net,
         CAST(c.p_sys >= 0.5 AS INTEGER) AS pred_syscall, CAST(sp.p_net >= 0.5 AS INTEGER) AS pred_network,
         CASE WHEN c.p_sys >= 0.6 THEN 1 WHEN sp.p_net >= 0.5 AND c.p_sys >= 0.1 THEN 1 ELSE 0 END AS pred_hybrid
  FROM b JOIN c ON c.base = b.base AND c.rn = 1 JOIN sp ON sp.network_base = b.network_base AND sp.rn = 1""",
    "pair_unmatched": f"""WITH {PAIR},
  x AS (SELECT b.base, b.network_base,
               EXISTS (SELECT 1 FROM c WHERE c.base = b.base) AS hs,
               EXISTS (SELECT 1 FROM sp WHERE sp.network_base = b.network_base) AS hn FROM b)
  SELECT base, network_base,
         CASE WHEN NOT hs AND NOT hn THEN 'both' WHEN NOT hs THEN 'syscall' ELSE 'network' END AS missing_side
  FROM x WHERE NOT hs OR NOT hn""",
    "label_from_name": f"""WITH {FILES}
  SELECT doc_id, sys_file, net_file,
         CAST(contains(lower(sys_file), 'mal_') OR contains(lower(sys_file), 'malicious') AS INTEGER) AS sys_label,
         CAST(contains(net_file, 'mal_') AS INTEGER) AS net_label FROM nm""",
    "base_name": f"""WITH {FILES}
  SELECT doc_id, replace(sys_file, '.log', '') AS sys_base,
         replace(replace(net_file, '_network.pcap', ''), '.pcap', '') AS net_base FROM nm""",
    "event_feature_counts": f"""WITH {ALIASES},
  k AS (SELECT range AS container, CAST(range >= 5 AS INTEGER) AS label FROM range(12)),
  e AS (SELECT user_id % 10 AS container, a.feature FROM events JOIN a ON a.name = events.event_type),
  c AS (SELECT container, {EVENT_WIDE} FROM e GROUP BY container)
  SELECT k.container, k.label, {_zero(EVENT_COLS)} FROM k LEFT JOIN c ON c.container = k.container""",
    "prefix_window_features": f"WITH {WINDOW_FEATURES} SELECT * FROM wf",
    "window_metrics": f"WITH {WINDOW_SCORES} SELECT window_tag, tn, fp, fn, tp, {RATES}, roc_auc, separation FROM wm",
    "recommended_window": f"""WITH {WINDOW_SCORES},
  sec(window_tag, n) AS (VALUES ('N3', 3), ('N5', 5), ('N10', 10), ('N15', 15)),
  rw AS (SELECT wm.window_tag, {_div('2 * tp', '2 * tp + fp + fn')} AS f1, separation FROM wm)
  SELECT CAST(COALESCE(MIN(CASE WHEN f1 >= 0.7 AND separation >= 0.4 THEN sec.n END), 15) AS INTEGER) AS recommended_n
  FROM rw LEFT JOIN sec USING (window_tag)""",
    "window_breakdown": f"""WITH {WINDOW_SCORES}
  SELECT container, y, p AS score, pred,
         CASE WHEN y = 1 THEN 'Malicious' ELSE 'Benign' END AS true_label,
         CASE WHEN pred = 1 THEN 'Malicious' ELSE 'Benign' END AS predicted,
         CASE WHEN pred = 1 THEN 'MALICIOUS' ELSE 'BENIGN' END AS verdict,
         CAST(y = pred AS INTEGER) AS correct, CAST(y = 0 AND pred = 1 AS INTEGER) AS fp,
         CAST(y = 1 AND pred = 0 AS INTEGER) AS fn
  FROM wp WHERE window_tag = 'full'""",
    "schema_align": f"""WITH {STRACE_LONG}
  SELECT container, CAST(SUM(n) AS DOUBLE) AS total_events,
         CAST(COALESCE(SUM(n) FILTER (WHERE feature = 'evt_click'), 0) AS DOUBLE) AS evt_click,
         CAST(COALESCE(SUM(n) FILTER (WHERE feature = 'evt_view'), 0) AS DOUBLE) AS evt_view,
         CAST(COALESCE(SUM(n) FILTER (WHERE feature = 'evt_purchase'), 0) AS DOUBLE) AS evt_purchase,
         CAST(COALESCE(SUM(n) FILTER (WHERE feature = 'evt_signup'), 0) AS DOUBLE) AS evt_signup,
         CAST(COALESCE(SUM(n) FILTER (WHERE feature = 'evt_logout'), 0) AS DOUBLE) AS evt_logout
  FROM sl GROUP BY container""",
    "schema_drift_report": f"""WITH {STRACE_LONG},
  con(feature) AS (VALUES ('evt_click'), ('evt_view'), ('evt_purchase'), ('evt_signup'), ('evt_logout')),
  seen AS (SELECT feature, COUNT(DISTINCT container) AS n_keys, SUM(n) AS n_events FROM sl GROUP BY feature)
  SELECT COALESCE(seen.feature, con.feature) AS feature,
         CASE WHEN seen.feature IS NULL THEN 'missing' WHEN con.feature IS NULL THEN 'dropped' ELSE 'kept' END AS status,
         CAST(COALESCE(n_keys, 0) AS BIGINT) AS n_keys, CAST(COALESCE(n_events, 0) AS BIGINT) AS n_events
  FROM seen FULL OUTER JOIN con ON seen.feature = con.feature""",
    "log_call_counts": r"""WITH
  ln AS (SELECT CASE WHEN page_id % 20 >= 15 THEN 'mal_' ELSE 'benign_' END || 'site' || CAST(page_id % 20 AS VARCHAR) || '.log' AS file,
                unnest(string_split(html, chr(10))) AS line FROM pages),
  cl AS (SELECT file, 'evt_' || regexp_extract(line, '(^|[^\p{L}\p{N}_])([A-Za-z_][A-Za-z0-9_]*)\(', 2) AS feature
         FROM ln WHERE regexp_extract(line, '(^|[^\p{L}\p{N}_])([A-Za-z_][A-Za-z0-9_]*)\(', 2) <> '')
  SELECT file, CAST(COUNT(*) AS DOUBLE) AS total_events,
         CAST(COUNT(*) FILTER (WHERE feature = 'evt_track') AS DOUBLE) AS evt_track,
         CAST(COUNT(*) FILTER (WHERE feature = 'evt_open') AS DOUBLE) AS evt_open,
         CAST(COUNT(*) FILTER (WHERE feature = 'evt_read') AS DOUBLE) AS evt_read,
         CAST(contains(lower(file), 'mal_') OR contains(lower(file), 'malicious') AS INTEGER) AS label
  FROM cl GROUP BY file""",
    "sysdig_line_parse": f"""WITH {SYSDIG}
  SELECT status, syscall, COUNT(*) AS n, COUNT(DISTINCT container) AS n_containers FROM ps GROUP BY status, syscall""",
    "top_features_per_container": f"""WITH {HOURLY},
  al AS (SELECT container, feature, n FROM hl UNION ALL
         SELECT container, 'total_events', SUM(n) FROM hl GROUP BY container)
  SELECT container, feature, CAST(n AS BIGINT) AS n, rank FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY container ORDER BY n DESC, feature ASC) AS rank FROM al)
  WHERE rank <= 5""",
    "nonzero_features": f"""WITH {HOURLY}
  SELECT container, CAST(SUM(CASE WHEN n > 0 THEN 1 ELSE 0 END) + CASE WHEN SUM(n) > 0 THEN 1 ELSE 0 END AS BIGINT)
         AS nonzero_features FROM hl GROUP BY container""",
    "packet_features": f"""WITH {PACKETS}
  SELECT file, CAST(contains(file, 'mal_') AS INTEGER) AS label, dport, pkts, bytes, 0.0::DOUBLE AS seq, dur,
         ROUND(a_mean, 6) AS mean, ROUND(a_std, 6) AS stddev, bytes AS "sum", a_min AS "min", a_max AS "max",
         pkts AS spkts, 0.0::DOUBLE AS dpkts, bytes AS sbytes, 0.0::DOUBLE AS dbytes,
         CASE WHEN dur > 0 THEN pkts / dur ELSE 0.0 END AS rate,
         CASE WHEN dur > 0 THEN pkts / dur ELSE 0.0 END AS srate, 0.0::DOUBLE AS drate,
         0.0::DOUBLE AS proto_arp, 0.0::DOUBLE AS proto_icmp, 0.0::DOUBLE AS "proto_ipv6-icmp",
         0.0::DOUBLE AS proto_proto, CAST(tcp AS DOUBLE) AS proto_tcp, CAST(udp AS DOUBLE) AS proto_udp
  FROM feat""",
    "runtime_hybrid_detection": f"""WITH {RUNTIME}
  SELECT base, network_base, label, p_sys, p_net, pred_syscall, pred_network, pred_hybrid FROM rf""",
    "runtime_hybrid_metrics": f"""WITH {RUNTIME}, cm AS (SELECT model, {CONF} FROM ru GROUP BY model)
  SELECT model, tn, fp, fn, tp, {RATES} FROM cm""",
    "dedup_and_constant_columns": f"""WITH {TRAINING},
  r AS ({_report_rows()})
  SELECT "column", (SELECT COUNT(*) FROM lineitem) AS rows_before, (SELECT COUNT(*) FROM d) AS rows_after,
         n_nonnull, min_value, max_value,
         CAST(n_nonnull = 0 OR min_value = max_value AS INTEGER) AS is_constant FROM r""",
    "training_prep": f"""WITH {TRAINING}
  SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_discount AS DOUBLE) AS l_discount,
         CAST(l_tax AS DOUBLE) AS l_tax, CAST(l_linenumber AS DOUBLE) AS l_linenumber,
         CAST(is_open AS DOUBLE) AS is_open, label_bin FROM d""",
    "stratified_split": f"""WITH {LABELLED}
  SELECT doc_id, y, rank, CASE WHEN rank <= ROUND(class_n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM rk""",
    "sample_per_class": f"WITH {LABELLED} SELECT doc_id, y, rank FROM rk WHERE rank <= 15",
    "rebalance_classes": f"""WITH {LABELLED},
  mn AS (SELECT MIN(class_n) AS minority_n FROM (SELECT DISTINCT y, class_n FROM rk)),
  kp AS (SELECT rk.*, least(class_n, floor(minority_n * 1.0::DOUBLE)) AS keep_n FROM rk, mn)
  SELECT doc_id, y, rank,
         CASE WHEN rank <= ROUND(keep_n * 0.7::DOUBLE) THEN 'train'
              WHEN rank <= ROUND(keep_n * 0.85::DOUBLE) THEN 'validation' ELSE 'test' END AS split
  FROM kp WHERE rank <= keep_n""",
    "pair_within_label": f"""WITH {LABELLED},
  er AS (SELECT vec_id, CAST(label >= 5 AS INTEGER) AS y,
                ROW_NUMBER() OVER (PARTITION BY label >= 5 ORDER BY vec_id * 7919 % 10007, vec_id) AS rank
         FROM embeddings)
  SELECT rk.y, rk.rank, rk.doc_id, er.vec_id FROM rk JOIN er ON er.y = rk.y AND er.rank = rk.rank""",
}

MODEL_ROWS = """mr AS (
  SELECT doc_id, CAST(doc_id % 2 AS DOUBLE) AS x,
         CASE WHEN doc_id % 2 = 0 THEN CAST(quality AS INTEGER) ELSE 1 - CAST(quality AS INTEGER) END AS y FROM labels)"""


def _leaves(p: str) -> str:
    """Scores per value of x, where p is an expression over the class rate r."""
    return f"""WITH {MODEL_ROWS}, r AS (SELECT x, COUNT(*) AS n, SUM(y) AS n_pos, AVG(y) AS r FROM mr GROUP BY x)
  SELECT x, ROUND({p}, 5) AS p, CAST(r >= 0.5 AS INTEGER) AS pred, n, CAST(n_pos AS BIGINT) AS n_pos FROM r"""


_CALLS = ORACLE["log_call_counts"][:ORACLE["log_call_counts"].index("  SELECT file, CAST(COUNT(*)")]

ORACLE |= {
    "packet_line_parse": """WITH p AS (
  SELECT CASE WHEN l_linenumber = 7 THEN 'short' ELSE 'ok' END AS status, l_linenumber = 7 AS cut,
         CASE WHEN l_returnflag = 'R' THEN '6' WHEN l_returnflag = 'A' THEN '17' ELSE '6,17' END AS ip_proto,
         CASE WHEN l_discount > 0 THEN l_quantity END AS frame_len, l_linestatus = 'O' AS open, l_tax > 0 AS taxed,
         l_shipdate FROM lineitem)
  SELECT status, ip_proto, COUNT(*) AS n, COUNT(frame_len) AS n_len, SUM(frame_len) AS sum_len,
         COUNT(*) FILTER (WHERE open) AS n_tcp, COUNT(*) FILTER (WHERE taxed AND NOT cut) AS n_udp,
         COUNT(l_shipdate) FILTER (WHERE NOT cut) AS n_t
  FROM p GROUP BY status, ip_proto""",
    "manifest_parse": """WITH ev AS (SELECT user_id AS container, epoch_us(ts) // 1000000 AS ts_s, event_type FROM events)
  SELECT 'u' || CAST(container AS VARCHAR) AS container, CAST(container % 3 = 0 AS INTEGER) AS label,
         MIN(ts_s) AS start_ts, MIN(ts_s) + 86400 AS end_ts FROM ev WHERE event_type = 'signup' GROUP BY container""",
    "counts_with_silent_files": _CALLS + """,
  k AS (SELECT CASE WHEN i % 20 >= 15 THEN 'mal_' ELSE 'benign_' END || 'site' || CAST(i AS VARCHAR) || '.log' AS file
        FROM range(24) t(i)),
  c AS (SELECT file, COUNT(*) AS n, COUNT(*) FILTER (WHERE feature = 'evt_track') AS a,
               COUNT(*) FILTER (WHERE feature = 'evt_open') AS b, COUNT(*) FILTER (WHERE feature = 'evt_read') AS d
        FROM cl GROUP BY file)
  SELECT k.file, CAST(COALESCE(n, 0) AS DOUBLE) AS total_events, CAST(COALESCE(a, 0) AS DOUBLE) AS evt_track,
         CAST(COALESCE(b, 0) AS DOUBLE) AS evt_open, CAST(COALESCE(d, 0) AS DOUBLE) AS evt_read,
         CAST(contains(k.file, 'mal_') AS INTEGER) AS label
  FROM k LEFT JOIN c USING (file)""",
    "flows_with_empty_captures": f"""WITH {PACKETS.replace("FROM lineitem)", "FROM lineitem WHERE l_suppkey % 5 <> 0)")},
  k AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'mal_' ELSE '' END || 'cap' || CAST(s_suppkey AS VARCHAR)
               || '_network.pcap' AS file FROM supplier)
  SELECT k.file, CAST(contains(k.file, 'mal_') AS INTEGER) AS label, COALESCE(dport, 0.0::DOUBLE) AS dport,
         COALESCE(pkts, 0.0::DOUBLE) AS pkts, COALESCE(bytes, 0.0::DOUBLE) AS bytes, COALESCE(dur, 0.0::DOUBLE) AS dur,
         COALESCE(a_min, 0.0::DOUBLE) AS "min", COALESCE(a_max, 0.0::DOUBLE) AS "max",
         CAST(COALESCE(tcp, 0) AS DOUBLE) AS proto_tcp, CAST(COALESCE(udp, 0) AS DOUBLE) AS proto_udp
  FROM k LEFT JOIN feat USING (file)""",
    "prepared_columns": """SELECT CAST(l_returnflag = 'R' AS INTEGER) AS label, COUNT(*) AS n, SUM(l_quantity) AS sum_quantity,
         CAST(SUM(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS n_open,
         'l_quantity,l_discount,l_tax,l_linenumber,is_open' AS features FROM lineitem GROUP BY 1""",
    "complete_packets": """SELECT CASE WHEN l_returnflag = 'R' THEN '6' WHEN l_returnflag = 'A' THEN '17' ELSE '6,17' END AS ip_proto,
         COUNT(*) AS n, SUM(l_quantity) AS sum_len FROM lineitem
  WHERE l_discount > 0 AND l_quantity IS NOT NULL AND l_linenumber <> 7 AND l_shipdate IS NOT NULL GROUP BY 1""",
    "contract_report": f"""WITH {PACKETS}, n AS (SELECT COUNT(*) AS a, COUNT(frame_len) AS f, COUNT(tcp_dstport) AS t,
         COUNT(udp_dstport) AS u, COUNT(t) AS w FROM p)
  SELECT 'frame_len' AS "column", 0 AS position, 1 AS in_place, a - f AS n_missing FROM n
  UNION ALL SELECT 'tcp_dstport', 1, 0, a - t FROM n UNION ALL SELECT 'udp_dstport', 2, 0, a - u FROM n
  UNION ALL SELECT 't', 3, 1, a - w FROM n UNION ALL SELECT 'absent', 4, 0, a FROM n""",
    "presented_metrics": f"WITH {FUSED}, cm AS (SELECT model, {CONF} FROM u GROUP BY model), "
                         f"m AS (SELECT model, tn, fp, fn, tp, {RATES} FROM cm) "
                         "SELECT model, tn, fp, fn, tp, " + ", ".join(
                             f"ROUND({c}, 4) AS {c}" for c in ("accuracy", "precision", "recall", "f1", "fpr", "fnr"))
                         + " FROM m",
    "reference_delta": f"""WITH {FUSED}, a AS (SELECT model, {CONF} FROM u GROUP BY model),
  b AS (SELECT model, {CONF} FROM u WHERE scenario = 0 GROUP BY model),
  ra AS (SELECT model, {RATES} FROM a), rb AS (SELECT model, {RATES} FROM b)
  SELECT model, rb.f1 AS reference_f1, ra.f1 AS current_f1, rb.f1 - ra.f1 AS delta FROM ra JOIN rb USING (model)""",
    "labelled_concat": """SELECT s_suppkey AS key, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment, 0 AS label FROM supplier
  UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment, 1 FROM customer""",
    "scaled_features": """WITH m AS (SELECT AVG(c_acctbal) AS a, STDDEV_POP(c_acctbal) AS s, AVG(c_nationkey) AS b,
         STDDEV_POP(c_nationkey) AS t FROM customer)
  SELECT c_custkey, ROUND((c_acctbal - a) / s, 4) AS balance, ROUND((c_nationkey - b) / t, 4) AS nation FROM customer, m""",
    "class_weights": """WITH c AS (SELECT CAST(quality AS INTEGER) AS quality, COUNT(*) AS n FROM labels GROUP BY 1)
  SELECT quality, CAST(SUM(n) OVER () AS DOUBLE) / (COUNT(*) OVER () * n) AS weight, n FROM c""",
    "binary_rate_scores": _leaves("r"),
    "boosted_stage_scores": _leaves("1 / (1 + exp(-2 * (2 * r - 1)))"),
    "tree_leaf_scores": _leaves("r"),
    "tree_importance": """SELECT 'x' AS feature, 1.0::DOUBLE AS value, 'importance' AS kind, CAST(1 AS BIGINT) AS rank
  UNION ALL SELECT 'z', 0.0::DOUBLE, 'importance', 2""",
    "best_candidate": f"""WITH {MODEL_ROWS}, rates AS (SELECT x, AVG(y) AS score FROM mr GROUP BY x),
  st AS (SELECT 'logistic_regression' AS model, y, score, CAST(score >= 0.5 AS INTEGER) AS pred FROM mr JOIN rates USING (x)),
  {AUC_FROM.format(keys="model", src="st")},
  cm AS (SELECT model, {CONF} FROM st GROUP BY model), m AS (SELECT model, tn, fp, fn, tp, {RATES} FROM cm)
  SELECT model, 0 AS ordinal, tn, fp, fn, tp, accuracy, f1, roc_auc FROM m JOIN auc USING (model)""",
    "candidate_overfit": f"""WITH {MODEL_ROWS},
  r AS (SELECT x, CAST(AVG(y) >= 0.5 AS INTEGER) AS pred FROM mr WHERE doc_id % 5 <> 0 GROUP BY x),
  h AS (SELECT CAST(COUNT(*) FILTER (WHERE y = pred AND doc_id % 5 <> 0) AS DOUBLE) / COUNT(*) FILTER (WHERE doc_id % 5 <> 0) AS a,
               CAST(COUNT(*) FILTER (WHERE y = pred AND doc_id % 5 = 0) AS DOUBLE) / COUNT(*) FILTER (WHERE doc_id % 5 = 0) AS b
        FROM mr JOIN r USING (x))
  SELECT 'one_tree' AS model, a AS train_accuracy, b AS test_accuracy, a - b AS gap, CAST(a - b > 0.05 AS INTEGER) AS overfit FROM h""",
}

ORACLE |= {"robustness_sweep_noisy": NOISY_SWEEP, "fourier_features": FOURIER, "platt_probabilities": PLATT}

LOGS = """lg AS (SELECT page_id // 8 AS site, page_id % 5 AS k, 'call' || page_id % 5 || '(' || url || ')' || chr(10) AS line FROM pages),
  fl AS (SELECT CASE WHEN site % 4 = 0 THEN 'mal_' ELSE 'site_' END || site || '.log' AS file, site % 3 = 0 AS silent,
                sum(octet_length(encode(line)))::BIGINT AS bytes, count(*) AS n, count(DISTINCT k) AS names FROM lg GROUP BY site)"""

ORACLE |= {
    "log_inventory": f"""WITH {LOGS}
  SELECT row_number() OVER (ORDER BY file) AS place, file, CASE WHEN silent THEN 0 ELSE bytes END AS bytes,
         CASE WHEN silent THEN 0 ELSE n END AS n_calls, CASE WHEN silent THEN 0 ELSE names END AS n_names,
         CAST(starts_with(file, 'mal_') AS INTEGER) AS label FROM fl""",
    "log_preview": f"""WITH {LOGS}
  SELECT file, CASE WHEN silent THEN 0 ELSE bytes END AS bytes FROM fl ORDER BY file LIMIT 10""",
    "checked_window_features": f"""WITH {WINDOW_FEATURES},
  seen AS (SELECT count(*) AS events, count(*) FILTER (event_type = 'error') AS errors FROM events),
  put AS (SELECT count(*) AS written FROM wf)
  SELECT window_tag, count(*) AS n_rows, {", ".join(f"CAST(sum({c}) AS BIGINT) AS sum_{c}" for c in EVENT_COLS)},
         any_value(events) AS events, any_value(errors) AS errors, any_value(written) AS written
  FROM wf, seen, put GROUP BY window_tag""",
}
