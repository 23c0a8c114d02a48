"""DuckDB SQL equivalents of the registered queries (same column names,
types and 6-decimal rounding).  ``events`` and the other tables are views."""

from __future__ import annotations

PACKETS = """packets AS (
  SELECT event_id, ts, epoch_us(ts) AS us, user_id AS device_id,
         CAST(floor(value) AS BIGINT) AS tcp_len,
         CASE event_id % 3 WHEN 0 THEN '0x0018' WHEN 1 THEN '0x0010' ELSE '2' END AS tcp_flags,
         value / 100.0 AS tcp_time_delta,
         CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(floor(value * 2) AS BIGINT) END AS mqtt_msg,
         (event_id * 37) % 512 AS mqtt_hdrflags,
         CASE WHEN event_id % 5 = 0 THEN 2 ELSE 0 END AS mqtt_conflags,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 2 END AS mqtt_conack_flags,
         CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 3 END AS mqtt_qos,
         CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 WHEN 'signup' THEN 4 ELSE 3 END AS target
  FROM events)"""


def hexsql(x: str) -> str:
    t = f"trim(CAST({x} AS VARCHAR))"
    return (f"coalesce(CASE WHEN regexp_matches({t}, '^0[xX][0-9a-fA-F]+$') "
            f"THEN TRY_CAST('0x' || substr({t}, 3) AS BIGINT) "
            f"ELSE CAST(trunc(TRY_CAST({t} AS DOUBLE)) AS BIGINT) END, 0)")


def zerosql(x: str) -> str:
    t = f"trim(CAST({x} AS VARCHAR))"
    return f"coalesce(CAST(trunc(TRY_CAST({t} AS DOUBLE)) AS BIGINT), 0)"


MAPPED = f"""mapped AS (
  SELECT event_id, ts, us, device_id, tcp_len, tcp_flags, tcp_time_delta, mqtt_msg, target,
         CAST(tcp_len AS DOUBLE) AS frame_length,
         {hexsql('tcp_flags')} AS protocol_flags,
         CAST(CASE WHEN ((mqtt_hdrflags >> 4) & 15) = 0 AND mqtt_hdrflags > 16 THEN 3
                   ELSE (mqtt_hdrflags >> 4) & 15 END AS INTEGER) AS mqtt_msgtype,
         CAST(coalesce(mqtt_qos, 0) AS INTEGER) AS mqtt_qos,
         CAST(mqtt_msg AS DOUBLE) AS mqtt_payload_len,
         CAST(mqtt_hdrflags & 1 AS INTEGER) AS mqtt_retain,
         CAST(coalesce(mqtt_conack_flags, 0) AS INTEGER) AS mqtt_client_id_hash
  FROM packets)"""

WITH_P = f"WITH {PACKETS}"
WITH_M = f"WITH {PACKETS}, {MAPPED}"


def rd(x: str, name: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) AS {name}"


def win_cols(windows, part: str = "", value: str = "coalesce(mqtt_payload_len, 0)",
             rate=True, stats=True) -> str:
    """Inclusive range windows."""
    out = []
    for w in windows:
        fr = f"OVER ({part} ORDER BY us RANGE BETWEEN {w * 1000000} PRECEDING AND CURRENT ROW)"
        n = f"CAST(count(*) {fr} AS DOUBLE)"
        s = f"sum({value}) {fr}"
        if rate:
            out.append(rd(f"{n} / {w}", f"msg_rate_{w}s"))
        if stats:
            out.append(rd(f"{s} / {n}", f"rolling_mean_payload_{w}s"))
            out.append(rd(f"coalesce(stddev_pop({value}) {fr}, 0)", f"rolling_std_payload_{w}s"))
    return ",\n  ".join(out)


WIDE = (60, 600, 3600)
DEVICE_WINDOWS = (3600, 86400, 604800)


def _exclusive_sql(windows) -> str:
    cols = []
    for w in windows:
        fr = f"OVER (ORDER BY us RANGE BETWEEN {w * 1000000} PRECEDING AND 1 PRECEDING)"
        tie = "OVER (PARTITION BY us ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        p = "coalesce(mqtt_payload_len, 0)"
        cols.append(f"CAST(count(*) {fr} AS DOUBLE) + CAST(count(*) {tie} AS DOUBLE) AS n{w}")
        cols.append(f"coalesce(sum({p}) {fr}, 0) + coalesce(sum({p}) {tie}, 0) AS s{w}")
        cols.append(f"coalesce(sum({p} * {p}) {fr}, 0) + coalesce(sum({p} * {p}) {tie}, 0) AS ss{w}")
    outs = []
    for w in windows:
        n, s, ss = f"n{w}", f"s{w}", f"ss{w}"
        outs.append(rd(f"{n} / {w}", f"msg_rate_{w}s"))
        outs.append(rd(f"CASE WHEN {n} > 0 THEN {s} / {n} ELSE 0 END", f"rolling_mean_payload_{w}s"))
        outs.append(rd(f"CASE WHEN {n} > 1 THEN sqrt(greatest({ss} / {n} - ({s} / {n}) * ({s} / {n}), 0)) ELSE 0 END",
                       f"rolling_std_payload_{w}s"))
    return (f"{WITH_M}, x AS (SELECT event_id, {', '.join(cols)} FROM mapped)\n"
            f"SELECT event_id, {', '.join(outs)} FROM x")


RAW = ["tcp_len", "mqtt_msg", "tcp_time_delta"]


def _bounds_cte(cols, factor, src="packets", name="b") -> str:
    parts = []
    for c in cols:
        parts.append(f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3")
    sel = ", ".join(parts)
    lo_hi = ", ".join(f"{c}_q1 - {factor} * ({c}_q3 - {c}_q1) AS {c}_lo, {c}_q3 + {factor} * ({c}_q3 - {c}_q1) AS {c}_hi"
                      for c in cols)
    return f"{name}0 AS (SELECT {sel} FROM {src}), {name} AS (SELECT *, {lo_hi} FROM {name}0)"


def _clip(c, b="b") -> str:
    return (f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest(CAST({c} AS DOUBLE), {b}.{c}_lo), {b}.{c}_hi) END")


def _preprocess_sql() -> str:
    W = (1, 10, 60)
    wins = []
    for w in W:
        fr = f"OVER (ORDER BY us RANGE BETWEEN {w * 1000000} PRECEDING AND CURRENT ROW)"
        p = "coalesce(mqtt_payload_len, 0)"
        n = f"CAST(count(*) {fr} AS DOUBLE)"
        s = f"sum({p}) {fr}"
        ss = f"sum({p} * {p}) {fr}"
        wins.append(f"{n} / {w} AS msg_rate_{w}s")
        wins.append(f"{s} / {n} AS rolling_mean_payload_{w}s")
        wins.append(f"CASE WHEN {n} > 1 THEN sqrt(greatest({ss} / {n} - ({s} / {n}) * ({s} / {n}), 0)) ELSE 0 END "
                    f"AS rolling_std_payload_{w}s")
    scale = ["tcp_len", "mqtt_msg", "iat", "frame_length", "mqtt_payload_len",
             "msg_rate_1s", "msg_rate_10s", "msg_rate_60s",
             "rolling_mean_payload_1s", "rolling_mean_payload_10s", "rolling_mean_payload_60s",
             "rolling_std_payload_1s", "rolling_std_payload_10s", "rolling_std_payload_60s"]
    sc_stats = ", ".join(f"avg({c}) AS {c}_m, CASE WHEN coalesce(stddev_pop({c}), 0) = 0 THEN 1 ELSE stddev_pop({c}) END AS {c}_s"
                         for c in scale)
    features = ["frame_length", "protocol_flags", "mqtt_msgtype", "mqtt_qos", "mqtt_payload_len", "mqtt_retain",
                "mqtt_client_id_hash", "iat", "msg_rate_1s", "msg_rate_10s", "msg_rate_60s",
                "rolling_mean_payload_1s", "rolling_std_payload_1s", "rolling_mean_payload_10s",
                "rolling_std_payload_10s", "rolling_mean_payload_60s", "rolling_std_payload_60s"]
    ints = {"protocol_flags", "mqtt_msgtype", "mqtt_qos", "mqtt_retain", "mqtt_client_id_hash"}
    out = []
    for c in features:
        if c in ints:
            out.append(c)
        else:
            out.append(rd(f"({c} - s.{c}_m) / s.{c}_s", c))
    return f"""{WITH_M},
{_bounds_cte(['tcp_len', 'mqtt_msg'], 3.0, 'mapped', 'b')},
capped AS (SELECT mapped.* REPLACE ({_clip('tcp_len')} AS tcp_len, {_clip('mqtt_msg')} AS mqtt_msg) FROM mapped, b),
temporal AS (
  SELECT *, coalesce(tcp_time_delta - lag(tcp_time_delta) OVER (ORDER BY us, event_id), 0) AS iat,
         row_number() OVER (ORDER BY us, event_id) - 1 AS idx,
         count(*) OVER () AS n_all,
         {', '.join(wins)}
  FROM capped),
{_bounds_cte(['iat'], 3.0, 'temporal', 'c')},
capped2 AS (SELECT temporal.* REPLACE ({_clip('iat', 'c')} AS iat) FROM temporal, c),
s AS (SELECT {sc_stats} FROM capped2)
SELECT event_id, {', '.join(out)}, target,
  CASE WHEN idx < floor(n_all * CAST(0.6 AS DOUBLE)) THEN 'train'
       WHEN idx < floor(n_all * CAST(0.6 AS DOUBLE)) + floor(n_all * CAST(0.2 AS DOUBLE)) THEN 'validation'
       ELSE 'test' END AS split
FROM capped2, s"""


ORACLE = {
    "packet_map": f"""{WITH_M}
SELECT event_id, {rd('frame_length', 'frame_length')}, protocol_flags, mqtt_msgtype, mqtt_qos,
       {rd('mqtt_payload_len', 'mqtt_payload_len')}, mqtt_retain, mqtt_client_id_hash, target
FROM mapped""",
    "hex_coerce": f"""{WITH_P}
SELECT p.event_id, p.tcp_flags, {hexsql('p.tcp_flags')} AS flags_parse, {zerosql('p.tcp_flags')} AS flags_zero,
       {hexsql('e.props')} AS props_int, {hexsql('e.value')} AS value_int
FROM packets p JOIN events e ON p.event_id = e.event_id""",
    "msgtype_hist": f"""{WITH_M}
SELECT mqtt_msgtype, count(*) AS n, CAST(sum(mqtt_retain) AS BIGINT) AS n_retain FROM mapped GROUP BY mqtt_msgtype""",
    "binary_relabel": f"""{WITH_P}
SELECT event_id, target, CAST(CASE WHEN target = 3 THEN 1 ELSE -1 END AS INTEGER) AS y FROM packets""",
    "iat_gap": f"""{WITH_P}
SELECT event_id, {rd('coalesce(CAST(us - lag(us) OVER (ORDER BY us, event_id) AS DOUBLE) / 1000000.0, 0)', 'iat')}
FROM packets""",
    "iat_delta": f"""{WITH_P}
SELECT event_id, {rd('coalesce(tcp_time_delta - lag(tcp_time_delta) OVER (ORDER BY us, event_id), 0)', 'iat')}
FROM packets""",
    "msg_rate": f"""{WITH_M}
SELECT event_id, {win_cols(WIDE, stats=False)} FROM mapped""",
    "rolling_payload": f"""{WITH_M}
SELECT event_id, {win_cols(WIDE, rate=False)} FROM mapped""",
    "rolling_exclusive": _exclusive_sql(WIDE),
    "rolling_by_device": f"""{WITH_M}
SELECT event_id, device_id, {win_cols(DEVICE_WINDOWS, part='PARTITION BY device_id')} FROM mapped""",
    "time_split": f"""{WITH_P}, x AS (
  SELECT event_id, row_number() OVER (ORDER BY us, event_id) - 1 AS idx, count(*) OVER () AS n FROM packets)
SELECT event_id,
  CASE WHEN idx < floor(n * CAST(0.6 AS DOUBLE)) THEN 'train'
       WHEN idx < floor(n * CAST(0.6 AS DOUBLE)) + floor(n * CAST(0.2 AS DOUBLE)) THEN 'validation'
       ELSE 'test' END AS split
FROM x""",
    "split_profile": f"""{WITH_P}, x AS (
  SELECT us, row_number() OVER (ORDER BY us, event_id) - 1 AS idx, count(*) OVER () AS n FROM packets),
y AS (SELECT us, CASE WHEN idx < floor(n * CAST(0.6 AS DOUBLE)) THEN 'train'
       WHEN idx < floor(n * CAST(0.6 AS DOUBLE)) + floor(n * CAST(0.2 AS DOUBLE)) THEN 'validation'
       ELSE 'test' END AS split FROM x)
SELECT split, count(*) AS rows, min(us) AS min_us, max(us) AS max_us,
       {rd('CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE)', 'share')}
FROM y GROUP BY split""",
    "quantiles": f"""{WITH_P}
""" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column, {rd(f'quantile_cont({c}, 0.25)', 'q1')}, {rd(f'quantile_cont({c}, 0.5)', 'median')}, "
        f"{rd(f'quantile_cont({c}, 0.75)', 'q3')} FROM packets" for c in RAW),
    "quantiles_ties": f"""{WITH_P}, t AS (SELECT 7.0::DOUBLE AS constant, tcp_len,
  CASE WHEN event_id % 10 = 0 THEN event_id::DOUBLE ELSE 0.0 END AS ties FROM packets)
""" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column, {rd(f'quantile_cont({c}, 0.05)', 'q05')}, {rd(f'quantile_cont({c}, 0.5)', 'median')}, "
        f"{rd(f'quantile_cont({c}, 0.95)', 'q95')} FROM t" for c in ("constant", "ties", "tcp_len")),
    "iqr_cap": f"""{WITH_P}, {_bounds_cte(RAW, 1.0)}
SELECT event_id, {', '.join(rd(_clip(c), c) for c in RAW)} FROM packets, b""",
    "zscore_cap": f"""{WITH_P}, z AS (SELECT {', '.join(f'avg({c}) AS {c}_m, stddev_samp({c}) AS {c}_s' for c in RAW)} FROM packets)
SELECT event_id, {', '.join(rd(f'CASE WHEN abs(({c} - {c}_m) / {c}_s) > 1.5 THEN sign({c} - {c}_m) * (1.5 * {c}_s) + {c}_m ELSE {c} END', c) for c in RAW)}
FROM packets, z""",
    "cap_counts": f"""{WITH_P}, {_bounds_cte(RAW, 1.0)}
""" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} < b.{c}_lo) AS n_lower, "
        f"count(*) FILTER (WHERE {c} > b.{c}_hi) AS n_upper FROM packets, b" for c in RAW),
    "standardise": f"""{WITH_P}, s AS (SELECT {', '.join(f'avg({c}) AS {c}_m, CASE WHEN coalesce(stddev_pop({c}), 0) = 0 THEN 1 ELSE stddev_pop({c}) END AS {c}_s' for c in RAW)} FROM packets)
SELECT event_id, {', '.join(rd(f'({c} - {c}_m) / {c}_s', c) for c in RAW)} FROM packets, s""",
    "scaler_state": f"""{WITH_P}
""" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column, {rd(f'avg({c})', 'mean')}, {rd(f'stddev_pop({c})', 'std_pop')}, "
        f"{rd(f'quantile_cont({c}, 0.25)', 'q1')}, {rd(f'quantile_cont({c}, 0.75)', 'q3')}, "
        f"{rd(f'quantile_cont({c}, 0.25) - 3.0 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))', 'lower')}, "
        f"{rd(f'quantile_cont({c}, 0.75) + 3.0 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))', 'upper')}, "
        f"'all' AS fitted_on FROM packets" for c in RAW),
    "preprocess_features": _preprocess_sql(),
    "class_distribution": f"""{WITH_P}
SELECT target, count(*) AS n, {rd('CAST(count(*) AS DOUBLE) * 100.0 / CAST(sum(count(*)) OVER () AS DOUBLE)', 'pct')}
FROM packets GROUP BY target""",
    "class_weights": f"""{WITH_P}
SELECT target, {rd('CAST(sum(count(*)) OVER () AS DOUBLE) / (CAST(count(*) OVER () AS DOUBLE) * count(*))', 'weight')}
FROM packets GROUP BY target""",
    "stratified_folds": f"""{WITH_P}
SELECT event_id, target,
  CAST((row_number() OVER (PARTITION BY target ORDER BY md5(concat('42|', CAST(event_id AS VARCHAR), '|fold')), event_id) - 1) % 5 AS INTEGER) AS fold
FROM packets""",
}


# ---------------------------------------------------------------- evaluation

BASE = f"""{WITH_P}, base AS (
  SELECT event_id, target AS label,
         CASE WHEN event_id % 7 = 0 THEN (target + 1) % 6 ELSE target END AS prediction,
         CAST(-((event_id * 7919) % 1000) AS DOUBLE) / 1000.0 AS score, us
  FROM packets),
bbase AS (SELECT event_id, CAST(CASE WHEN label = 3 THEN 1 ELSE -1 END AS INTEGER) AS label,
                 CAST(CASE WHEN prediction = 3 THEN 1 ELSE -1 END AS INTEGER) AS prediction, score FROM base)"""

CLASS_NAME = ("CASE class_label WHEN 0 THEN 'bruteforce' WHEN 1 THEN 'dos' WHEN 2 THEN 'flood' "
              "WHEN 3 THEN 'legitimate' WHEN 4 THEN 'malformed' WHEN 5 THEN 'slowite' "
              "ELSE 'class_' || CAST(class_label AS VARCHAR) END")


def conf_sql(src: str) -> str:
    return f"""cnt AS (SELECT label, prediction, count(*) AS n FROM {src} GROUP BY label, prediction),
labs AS (SELECT label AS c FROM {src} UNION SELECT prediction AS c FROM {src}),
conf AS (SELECT a.c AS label, b.c AS prediction, coalesce(cnt.n, 0) AS n
         FROM labs a CROSS JOIN labs b LEFT JOIN cnt ON cnt.label = a.c AND cnt.prediction = b.c),
t AS (SELECT label AS class_label, sum(n) AS support FROM conf GROUP BY label),
p AS (SELECT prediction AS class_label, sum(n) AS predicted FROM conf GROUP BY prediction),
tp AS (SELECT label AS class_label, n AS tp FROM conf WHERE label = prediction),
cm0 AS (SELECT class_label, CAST(t.support AS BIGINT) AS support, CAST(p.predicted AS DOUBLE) AS predicted,
               CAST(tp.tp AS DOUBLE) AS tp FROM t JOIN p USING (class_label) JOIN tp USING (class_label)),
cm1 AS (SELECT class_label, support,
               CASE WHEN predicted <> 0 THEN tp / predicted ELSE 0 END AS precision,
               CASE WHEN support <> 0 THEN tp / support ELSE 0 END AS recall FROM cm0),
cm AS (SELECT *, CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1_score,
              {CLASS_NAME} AS class_name FROM cm1),
acc AS (SELECT CAST(sum(n) FILTER (WHERE label = prediction) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS accuracy,
               CAST(sum(n) AS BIGINT) AS n FROM conf)"""


def _auc_sql(src: str, y: str, s: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""g AS (SELECT {g}{s} AS s, CAST(count(*) FILTER (WHERE {y} = 1) AS DOUBLE) AS pos,
                   CAST(count(*) FILTER (WHERE {y} <> 1) AS DOUBLE) AS neg FROM {src} GROUP BY {g}{s}),
gc AS (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g),
auc AS (SELECT {g}CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (nb + 0.5 * neg)) / (sum(pos) * sum(neg)) END AS roc_auc
        FROM gc {('GROUP BY ' + group) if group else ''})"""


SCALED = """mm AS (SELECT min(-score) AS mn, max(-score) AS mx FROM base),
sc AS (SELECT event_id, CASE WHEN label <> 3 THEN 1 ELSE 0 END AS y01,
              (-score - mn) / (mx - mn + 1e-10) AS score_scaled FROM base, mm)"""

SWEEP_PCTS = ([1 + 0.5 * i for i in range(18)] + [10.0 + i for i in range(15)] + [25.0 + 2 * i for i in range(13)])


def _sweep_sql() -> str:
    fr = ", ".join(repr(p / 100.0) for p in SWEEP_PCTS)
    vals = ", ".join(f"({i}, {p!r})" for i, p in enumerate(SWEEP_PCTS))
    return f"""{BASE},
b AS (SELECT label AS y, score FROM bbase),
q AS (SELECT quantile_cont(score, [{fr}]) AS qs FROM b),
pt AS (SELECT * FROM (VALUES {vals}) v(pos, pct)),
t AS (SELECT pos, CAST(pct AS DOUBLE) AS pct, list_extract(qs, pos + 1) AS thr FROM pt, q),
m AS (SELECT t.pos, t.pct, t.thr,
             CAST(count(*) FILTER (WHERE b.score <= t.thr AND b.y = -1) AS DOUBLE) AS tpa,
             CAST(count(*) FILTER (WHERE b.score <= t.thr AND b.y = 1) AS DOUBLE) AS fpa,
             CAST(count(*) FILTER (WHERE b.score > t.thr AND b.y = -1) AS DOUBLE) AS fna,
             CAST(count(*) FILTER (WHERE b.score > t.thr AND b.y = 1) AS DOUBLE) AS tna
      FROM t, b GROUP BY t.pos, t.pct, t.thr),
r1 AS (SELECT *, CASE WHEN tpa + fpa > 0 THEN tpa / (tpa + fpa) ELSE 0 END AS pa,
              CASE WHEN tpa + fna > 0 THEN tpa / (tpa + fna) ELSE 0 END AS ra,
              CASE WHEN tna + fna > 0 THEN tna / (tna + fna) ELSE 0 END AS pn,
              CASE WHEN tna + fpa > 0 THEN tna / (tna + fpa) ELSE 0 END AS rn FROM m),
r2 AS (SELECT *, CASE WHEN pa + ra > 0 THEN 2 * pa * ra / (pa + ra) ELSE 0 END AS fa,
              CASE WHEN pn + rn > 0 THEN 2 * pn * rn / (pn + rn) ELSE 0 END AS fn_ FROM r1),
r3 AS (SELECT pos, pct, thr, (pa + pn) / 2 AS precision_macro, (ra + rn) / 2 AS recall_macro,
              (fa + fn_) / 2 AS f1_macro, (pa + pn) / 2 >= 0.1 AS eligible FROM r2),
best AS (SELECT pos, row_number() OVER (ORDER BY f1_macro DESC, pos) AS rk FROM r3 WHERE eligible)
SELECT CAST(r3.pos AS INTEGER) AS pos, {rd('pct', 'percentile')}, {rd('thr', 'threshold')},
       {rd('precision_macro', 'precision_macro')}, {rd('recall_macro', 'recall_macro')}, {rd('f1_macro', 'f1_macro')},
       eligible, coalesce(best.rk = 1, false) AS selected
FROM r3 LEFT JOIN best USING (pos)"""


IMP_COLS = ["tcp_len", "mqtt_msg", "tcp_time_delta", "mqtt_hdrflags", "mqtt_conflags",
            "mqtt_conack_flags", "mqtt_qos"]
IMP = (f"{WITH_P}, a AS (SELECT "
       + ", ".join(f"abs(corr(CAST({c} AS DOUBLE), CAST(target AS DOUBLE))) AS {c}" for c in IMP_COLS)
       + " FROM packets), l AS ("
       + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v FROM a" for c in IMP_COLS)
       + "), imp AS (SELECT feature, v / sum(v) OVER () AS importance FROM l)")

ORACLE.update({
    "confusion": f"{BASE}, {conf_sql('base')}\nSELECT label, prediction, n FROM conf",
    "confusion_normalised": f"""{BASE}, {conf_sql('base')}
SELECT label, prediction, n,
  {rd('CASE WHEN sum(n) OVER (PARTITION BY label) <> 0 THEN CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY label) ELSE 0 END', 'share')}
FROM conf""",
    "class_metrics": f"""{BASE}, {conf_sql('base')}
SELECT class_label, class_name, {rd('precision', 'precision')}, {rd('recall', 'recall')}, {rd('f1_score', 'f1_score')}, support FROM cm""",
    "macro_metrics": f"""{BASE}, {conf_sql('base')}
SELECT {rd('accuracy', 'accuracy')}, {rd('avg(precision)', 'precision_macro')}, {rd('avg(recall)', 'recall_macro')},
       {rd('avg(f1_score)', 'f1_macro')}, any_value(acc.n) AS n FROM cm, acc GROUP BY accuracy""",
    "classification_report": f"""{BASE}, {conf_sql('base')}
SELECT class_name AS row, CAST(class_label AS INTEGER) AS pos, {rd('precision', 'precision')}, {rd('recall', 'recall')},
       {rd('f1_score', 'f1_score')}, support FROM cm
UNION ALL SELECT 'accuracy', 1000, NULL, NULL, {rd('accuracy', 'f1_score')}, (SELECT CAST(sum(support) AS BIGINT) FROM cm) FROM acc
UNION ALL SELECT 'macro avg', 1001, {rd('avg(precision)', 'p')}, {rd('avg(recall)', 'r')}, {rd('avg(f1_score)', 'f')},
       CAST(sum(support) AS BIGINT) FROM cm
UNION ALL SELECT 'weighted avg', 1002, {rd('sum(precision * support) / sum(support)', 'p')},
       {rd('sum(recall * support) / sum(support)', 'r')}, {rd('sum(f1_score * support) / sum(support)', 'f')},
       CAST(sum(support) AS BIGINT) FROM cm""",
    "binary_counts": f"""{BASE}, {conf_sql('bbase')}
SELECT CAST(sum(n) FILTER (WHERE label = -1 AND prediction = -1) AS BIGINT) AS tp,
       CAST(sum(n) FILTER (WHERE label = -1 AND prediction = 1) AS BIGINT) AS fn,
       CAST(sum(n) FILTER (WHERE label = 1 AND prediction = -1) AS BIGINT) AS fp,
       CAST(sum(n) FILTER (WHERE label = 1 AND prediction = 1) AS BIGINT) AS tn FROM conf""",
    "binary_metrics": f"""{BASE}, {conf_sql('bbase')}
SELECT {rd('precision', 'precision_binary')}, {rd('recall', 'recall_binary')}, {rd('f1_score', 'f1_binary')}
FROM cm WHERE class_label = 1""",
    "metrics_chart": f"""{BASE}, {conf_sql('base')}
SELECT class_label,
       CASE WHEN class_label IN (0, 1, 2, 3, 4, 5) THEN upper(substr(class_name, 1, 1)) || substr(class_name, 2)
            ELSE 'Class_' || CAST(class_label AS VARCHAR) END AS display_name,
       {rd('precision', 'precision')}, {rd('recall', 'recall')}, {rd('f1_score', 'f1_score')} FROM cm""",
    "label_set": f"{BASE}\nSELECT label AS class_label FROM base UNION SELECT prediction FROM base",
    "minmax_scores": f"{BASE}, {SCALED}\nSELECT event_id, {rd('score_scaled', 'score_scaled')} FROM sc",
    "roc_auc": f"{BASE}, {SCALED}, {_auc_sql('sc', 'y01', 'score_scaled')}\nSELECT {rd('roc_auc', 'roc_auc')} FROM auc",
    "average_precision": f"""{BASE}, {SCALED},
g AS (SELECT score_scaled AS s, CAST(count(*) FILTER (WHERE y01 = 1) AS DOUBLE) AS pos,
             CAST(count(*) FILTER (WHERE y01 <> 1) AS DOUBLE) AS neg FROM sc GROUP BY score_scaled),
c AS (SELECT *, sum(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tpc,
             sum(pos + neg) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS allc FROM g)
SELECT {rd('CASE WHEN sum(pos) > 0 THEN sum(pos * tpc / allc) / sum(pos) END', 'average_precision')} FROM c""",
    "roc_auc_ovr": f"""{WITH_P},
x AS (SELECT CAST(event_id % 6 AS INTEGER) AS label, c.cls,
             CAST((event_id * (2 * c.cls + 3) + c.cls) % 10 AS DOUBLE) / 10.0 AS p
      FROM packets CROSS JOIN (SELECT unnest(range(6)) AS cls) c),
xy AS (SELECT cls, p, CASE WHEN label = cls THEN 1 ELSE 0 END AS y FROM x),
{_auc_sql('xy', 'y', 'p', 'cls')}
SELECT {rd('CASE WHEN count(*) FILTER (WHERE roc_auc IS NULL) = 0 THEN avg(roc_auc) END', 'roc_auc_ovr')} FROM auc""",
    "contamination": f"""{WITH_P}, x AS (
  SELECT target, row_number() OVER (ORDER BY us, event_id) - 1 AS idx, count(*) OVER () AS n FROM packets),
s AS (SELECT avg(CASE WHEN target = 3 THEN 0.0 ELSE 1.0 END) AS a FROM x
      WHERE idx < floor(n * CAST(0.6 AS DOUBLE)) + floor(n * CAST(0.2 AS DOUBLE)))
SELECT {rd('a', 'anomaly_rate')}, a > 0.5 AS flipped, {rd('CASE WHEN a > 0.5 THEN 1 - a ELSE a END', 'contamination')} FROM s""",
    "threshold_sweep": _sweep_sql(),
    "topk": f"{IMP}\nSELECT feature, {rd('importance', 'importance')} FROM imp ORDER BY importance DESC, feature LIMIT 3",
    "importance_summary": f"""{IMP}, rk AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS r FROM imp)
SELECT count(*) AS n_features, {rd('sum(importance)', 'total')}, {rd('max(importance)', 'max_importance')},
       {rd('avg(importance)', 'mean_importance')}, {rd('quantile_cont(importance, 0.5)', 'median_importance')},
       {rd('sum(CASE WHEN r <= 5 THEN importance ELSE 0 END) * 100.0 / sum(importance)', 'top_share_pct')} FROM rk""",
    "importance_cumulative": f"""{IMP}, c AS (SELECT feature, importance,
    sum(importance) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING) AS cumulative,
    sum(importance) OVER () AS total FROM imp)
SELECT feature, {rd('importance', 'importance')}, {rd('cumulative', 'cumulative')},
       {rd('cumulative * 100.0 / total', 'cumulative_pct')} FROM c""",
})


# ---------------------------------------------------------------- faults

FAULT_FEATURES = ["frame_length", "protocol_flags", "mqtt_msgtype", "mqtt_qos", "mqtt_payload_len",
                  "mqtt_retain", "mqtt_client_id_hash"]


def _fault_sql(kind: str) -> str:
    from packetspark.functions import draws as D
    from packetspark.operators.faults import choose_columns
    import warnings
    warnings.simplefilter("ignore")
    cols = {"event_id", "scenario_id"}
    FF = FAULT_FEATURES
    fb = (f"{WITH_M}, sp AS (SELECT *, row_number() OVER (ORDER BY us, event_id) - 1 AS idx, count(*) OVER () AS n_all FROM mapped),"
          f" fb AS (SELECT event_id, {', '.join(FF)}, target,"
          f" CASE WHEN idx < floor(n_all * CAST(0.6 AS DOUBLE)) THEN 'train'"
          f" WHEN idx < floor(n_all * CAST(0.6 AS DOUBLE)) + floor(n_all * CAST(0.2 AS DOUBLE)) THEN 'validation'"
          f" ELSE 'test' END AS split FROM sp)")

    def corrupt(rate, noise, seed=42, salt=(), where=None, src="fb"):
        chosen = choose_columns(FF, rate, seed, list(salt))
        stats = ", ".join(f"stddev_samp(CAST({c} AS DOUBLE)) AS {c}_s" for c in chosen)
        wh = f" WHERE {where}" if where else ""
        exprs = {}
        for c in FF:
            base = f"CAST({c} AS DOUBLE)"
            if c in chosen:
                g = D.sql_gaussian([seed, *salt, "event_id", c], cols)
                noisy = f"{base} + {g} * (CASE WHEN st.{c}_s > 0 THEN st.{c}_s * {noise!r} ELSE {noise!r} END)"
                exprs[c] = f"CASE WHEN {where} THEN {noisy} ELSE {base} END" if where else noisy
            else:
                exprs[c] = base
        return f"st AS (SELECT {stats} FROM {src}{wh})", exprs, chosen

    def loss(rate, seed=42, salt=(), where=None, src="fb"):
        h = D.sql_hash60([seed, *salt, "event_id", "loss"], cols)
        wh = f" WHERE {where}" if where else ""
        return (f"lr AS (SELECT event_id, row_number() OVER (ORDER BY {h}, event_id) AS rn, count(*) OVER () AS nn FROM {src}{wh}),"
                f" lo AS (SELECT event_id FROM lr WHERE rn <= greatest(1, floor(nn * CAST({rate!r} AS DOUBLE))))")

    if kind == "feature_corruption":
        st, ex, _ = corrupt(0.3, 0.3)
        return f"{fb}, {st}\nSELECT event_id, {', '.join(rd(ex[c], c) for c in FF)} FROM fb, st"
    if kind == "payload_loss":
        ex = {c: f"CAST({c} AS DOUBLE)" for c in FF}
        ex["mqtt_payload_len"] = "CASE WHEN affected THEN 0.0 ELSE CAST(mqtt_payload_len AS DOUBLE) END"
        ex["mqtt_qos"] = "CASE WHEN affected THEN 0.0 ELSE CAST(mqtt_qos AS DOUBLE) END"
        return (f"{fb}, {loss(0.3)}, x AS (SELECT fb.*, lo.event_id IS NOT NULL AS affected FROM fb LEFT JOIN lo USING (event_id))\n"
                f"SELECT event_id, affected, {', '.join(rd(ex[c], c) for c in FF)} FROM x")
    if kind in ("combined_faults", "fault_report"):
        st, ex, chosen = corrupt(0.2, 0.1)
        y = (f"{fb}, {st}, {loss(0.15)},"
             f" c AS (SELECT event_id, {', '.join(f'{ex[c]} AS {c}' for c in FF)} FROM fb, st),"
             f" x AS (SELECT c.*, lo.event_id IS NOT NULL AS affected FROM c LEFT JOIN lo USING (event_id))")
        if kind == "fault_report":
            return (f"{y}\nSELECT 'default' AS scenario_id, '{','.join(chosen)}' AS corrupted_features,"
                    f" {rd(repr(len(chosen) / len(FF)), 'corruption_rate')}, {rd('0.1', 'noise_std')},"
                    f" CAST({len(chosen)} AS INTEGER) AS n_features_corrupted, CAST({len(FF)} AS INTEGER) AS n_total_numeric_features,"
                    f" count(*) FILTER (WHERE affected) AS affected_samples,"
                    f" {rd('CAST(count(*) FILTER (WHERE affected) AS DOUBLE) / count(*)', 'sample_rate')},"
                    f" 'mqtt_payload_len' AS payload_feature, true AS payload_zeroed, '' AS dropped_features,"
                    f" CAST(NULL AS VARCHAR) AS drop_mode FROM x")
        ex2 = {c: c for c in FF}
        ex2["mqtt_payload_len"] = "CASE WHEN affected THEN 0.0 ELSE mqtt_payload_len END"
        return f"{y}\nSELECT event_id, affected, {', '.join(rd(ex2[c], c) for c in FF)} FROM x"
    if kind == "fault_target":
        w = "split = 'test'"
        st, ex, _ = corrupt(0.2, 0.1, salt=("test",), where=w)
        ex2 = {c: c for c in FF}
        ex2["mqtt_payload_len"] = "CASE WHEN affected THEN 0.0 ELSE mqtt_payload_len END"
        return (f"{fb}, {st}, {loss(0.15, salt=('test',), where=w)},"
                f" c AS (SELECT event_id, split, {', '.join(f'{ex[c]} AS {c}' for c in FF)} FROM fb, st),"
                f" x AS (SELECT c.*, lo.event_id IS NOT NULL AS affected FROM c LEFT JOIN lo USING (event_id))\n"
                f"SELECT event_id, split, affected, {', '.join(rd(ex2[c], c) for c in FF)} FROM x")
    if kind == "fault_sweep":
        from packetspark.plans.catalog import SWEEP
        stats = ", ".join(f"stddev_samp(CAST({c} AS DOUBLE)) AS {c}_s" for c in FF)
        parts = []
        for sid, rate, noise, lrate in SWEEP:
            chosen = choose_columns(FF, rate, 42, [sid])
            ex = {}
            for c in FF:
                base = f"CAST({c} AS DOUBLE)"
                if c in chosen:
                    g = D.sql_gaussian([42, sid, "event_id", c], cols)
                    ex[c] = f"{base} + {g} * (CASE WHEN st.{c}_s > 0 THEN st.{c}_s * {noise!r} ELSE {noise!r} END)"
                else:
                    ex[c] = base
            h = D.sql_hash60([42, sid, "event_id", "loss"], cols)
            ex["mqtt_payload_len"] = f"CASE WHEN rn <= greatest(1, floor(nn * CAST({lrate!r} AS DOUBLE))) THEN 0.0 ELSE {ex['mqtt_payload_len']} END"
            parts.append(
                f"SELECT '{sid}' AS scenario_id, event_id, rn <= greatest(1, floor(nn * CAST({lrate!r} AS DOUBLE))) AS affected, "
                f"{', '.join(rd(ex[c], c) for c in FF)} FROM (SELECT fb.*, row_number() OVER (ORDER BY {h}, event_id) AS rn, "
                f"count(*) OVER () AS nn FROM fb) fbr, st")
        return f"{fb}, st AS (SELECT {stats} FROM fb)\n" + "\nUNION ALL\n".join(parts)
    raise KeyError(kind)


for _k in ("feature_corruption", "payload_loss", "combined_faults", "fault_target", "fault_sweep", "fault_report"):
    ORACLE[_k] = _fault_sql(_k)


# ---------------------------------------------------------------- streaming, labels

def _stream_replay_sql(windows) -> str:
    cols = []
    for w in windows:
        fr = f"OVER (PARTITION BY device_id ORDER BY us RANGE BETWEEN {w * 1000000} PRECEDING AND 1 PRECEDING)"
        tie = "OVER (PARTITION BY device_id, us ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        p = "coalesce(CAST(mqtt_msg AS DOUBLE), 0)"
        cols.append(f"CAST(count(*) {fr} AS DOUBLE) + CAST(count(*) {tie} AS DOUBLE) AS n{w}")
        cols.append(f"coalesce(sum({p}) {fr}, 0) + coalesce(sum({p}) {tie}, 0) AS s{w}")
        cols.append(f"coalesce(sum({p} * {p}) {fr}, 0) + coalesce(sum({p} * {p}) {tie}, 0) AS ss{w}")
    outs = []
    for w in windows:
        n, s, ss = f"n{w}", f"s{w}", f"ss{w}"
        outs.append(rd(f"{n} / {w}", f"msg_rate_{w}s"))
        outs.append(rd(f"CASE WHEN {n} > 0 THEN {s} / {n} ELSE 0 END", f"rolling_mean_payload_{w}s"))
        outs.append(rd(f"CASE WHEN {n} > 1 THEN sqrt(greatest({ss} / {n} - ({s} / {n}) * ({s} / {n}), 0)) ELSE 0 END",
                       f"rolling_std_payload_{w}s"))
    iat = "coalesce(CAST(us - lag(us) OVER (PARTITION BY device_id ORDER BY us, event_id) AS DOUBLE) / 1000000.0, 0)"
    return (f"{WITH_P}, x AS (SELECT event_id, device_id, {iat} AS iat, {', '.join(cols)} FROM packets)\n"
            f"SELECT event_id, device_id, {rd('iat', 'iat')}, {', '.join(outs)} FROM x")


ORACLE.update({
    "stream_replay_window": _stream_replay_sql(WIDE),
    "stream_dead_letter": "SELECT event_id, 'bad' AS status FROM events WHERE event_id % 97 = 0",
    "label_imbalance": """SELECT toxic, count(*) AS n,
  round(CAST(count(*) AS DOUBLE) * 100.0 / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS pct,
  round(CAST(sum(count(*)) OVER () AS DOUBLE) / (CAST(count(*) OVER () AS DOUBLE) * count(*)), 6) AS weight
FROM labels GROUP BY toxic""",
})

ORACLE["tumbling_rate"] = f"""{WITH_M}
SELECT device_id, us - ((us % 3600000000) + 3600000000) % 3600000000 AS window_start_us, count(*) AS n,
       {rd('avg(mqtt_payload_len)', 'mean_payload')}
FROM mapped GROUP BY device_id, window_start_us"""


# ---------------------------------------------------------------- streams in several micro-batches

# Micro-batch, watermark (ms, of the micro-batches before) and payload of every record.
ARRIVALS = f"""{WITH_M}, range_ AS (SELECT min(us) AS lo, max(us) AS hi FROM mapped),
b AS (SELECT event_id, device_id, us, coalesce(CAST(mqtt_msg AS DOUBLE), 0) AS p, mqtt_payload_len,
        CASE WHEN event_id % 50 = 7 THEN 3 ELSE CAST(floor(CAST((us - lo) * 4 AS DOUBLE) / (hi - lo + 1)) AS INTEGER) END AS batch
      FROM mapped, range_),
wm AS (SELECT batch, max(high) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 - 3600000 AS wm
       FROM (SELECT batch, max(us) AS high FROM b GROUP BY batch))"""

ORACLE["stream_late"] = f"""{ARRIVALS}
SELECT i.event_id, i.device_id, CASE WHEN any_value(i.us) // 1000 < any_value(wm) THEN 'late' ELSE 'ok' END AS status,
       {rd('count(j.event_id) / 3600.0', 'msg_rate_3600s')}, {rd('coalesce(avg(j.p), 0)', 'rolling_mean_payload_3600s')}
FROM b i JOIN wm ON wm.batch = i.batch
LEFT JOIN b j ON j.device_id = i.device_id AND j.us BETWEEN i.us - 3600000000 AND i.us
  AND (j.batch < i.batch OR (j.batch = i.batch AND (j.us < i.us OR (j.us = i.us AND j.event_id < i.event_id))))
GROUP BY i.event_id, i.device_id"""

# A row whose window was closed before its micro-batch is left out; a window comes out once the last watermark is beyond it.
ORACLE["tumbling_stream"] = f"""{ARRIVALS}, w AS (SELECT *, us - us % 3600000000 AS window_start_us FROM b)
SELECT device_id, window_start_us, count(*) AS n, {rd('avg(p)', 'mean_payload')}
FROM w JOIN wm USING (batch), range_
WHERE wm IS NULL OR (window_start_us + 3600000000) // 1000 > wm
GROUP BY device_id, window_start_us, hi HAVING (window_start_us + 3600000000) // 1000 <= hi // 1000 - 3600000"""

ORACLE["stream_limit"] = f"""{ARRIVALS}
SELECT event_id, status FROM (
  SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'bad' ELSE 'ok' END AS status,
         coalesce(sum(CASE WHEN event_id % 97 = 0 THEN 0 ELSE 1 END) OVER (ORDER BY batch, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         count(*) OVER () // 3 AS most
  FROM b) WHERE before < most"""


def _rate(name: str, k: int, modulus: int) -> str:
    text = f"printf('%.2f', event_id * {k} % {modulus} / 100.0)"
    short = rf"regexp_replace(regexp_replace({text}, '0+$', ''), '\.$', '')"
    return f"('_{name}' || CASE WHEN {short} IN ('0', '1') THEN {text} ELSE {short} END)"


def _tag(name: str, k: int, gap: int) -> str:
    return f"CASE WHEN event_id % {gap} <> 0 THEN {_rate(name, k, 101)} ELSE '' END"


ORACLE["run_tags"] = f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'models' ELSE 'models' || {_tag('corruption', 7, 5)} || {_tag('noise', 13, 6)} || {_tag('payload', 29, 7)}
  || CASE WHEN event_id % 11 <> 0 THEN '_' || ['train', 'validation', 'test', 'all'][event_id % 4 + 1] ELSE '' END END AS run_tag FROM events"""


# ---------------------------------------------------------------- isolation trees by hash draws

def _iforest_sql(select: str, n_trees: int = 100, psi: int = 256, seed: int = 42) -> str:
    """Samples, trees (a level of all trees at a time) and path lengths."""
    from packetspark.functions import draws as D
    feats = ["frame_length", "protocol_flags", "mqtt_msgtype", "mqtt_qos", "mqtt_payload_len", "mqtt_retain", "mqtt_client_id_hash", "tcp_time_delta"]
    levels = (psi - 1).bit_length()
    def u(what):
        return D.sql_uniform([seed, "tree_id", "node", what], {"tree_id", "node"})
    ctes = [PACKETS, MAPPED,
            f"rows_ AS MATERIALIZED (SELECT event_id, CASE WHEN target = 3 THEN 1 ELSE -1 END AS y, [{', '.join(f'coalesce(CAST({c} AS DOUBLE), 0)' for c in feats)}] AS x FROM mapped)",
            f"size_ AS (SELECT *, greatest(1, round_even(n * pool_p, 0)) AS m FROM (SELECT *, least(1.0::DOUBLE, 2.0::DOUBLE * {n_trees} * psi / greatest(n, 1)) AS pool_p "
            f"FROM (SELECT count(*) AS n, least({psi}, count(*)) AS psi FROM rows_)))",
            "limit_ AS (SELECT greatest(1, CAST(ceil(log2(greatest(psi, 2))) AS INTEGER)) AS deepest FROM size_)",
            f"pool_ AS (SELECT rows_.* FROM rows_, size_ WHERE {D.sql_uniform([seed, 'event_id', 'pool'], {'event_id'})} < pool_p)",
            f"drawn_ AS (SELECT tree_id, event_id, x, {D.sql_uniform([seed, 'tree_id', 'event_id', 'tree'], {'tree_id', 'event_id'})} AS u FROM pool_, range({n_trees}) t(tree_id))",
            "l0 AS MATERIALIZED (SELECT tree_id, event_id, x, 1 AS node FROM drawn_, size_ WHERE u < least(1.0::DOUBLE, 3.0::DOUBLE * psi / m) "
            "QUALIFY row_number() OVER (PARTITION BY tree_id ORDER BY u, event_id) <= psi)"]
    for k in range(levels + 1):
        lo, hi = (f"[{', '.join(f'{f}(x[{i + 1}])' for i in range(len(feats)))}]" for f in ("min", "max"))
        ctes.append(f"g{k} AS (SELECT tree_id, node, count(*) AS n, {lo} AS lo, {hi} AS hi FROM l{k} GROUP BY tree_id, node)")
        ctes.append(f"c{k} AS (SELECT *, list_filter(range(1, {len(feats) + 1}), lambda i: hi[i] > lo[i]) AS usable FROM g{k}, limit_)")
        ctes.append(f"f{k} AS (SELECT *, CASE WHEN {k} < deepest AND len(usable) > 0 THEN usable[1 + CAST(floor({u('feature')} * len(usable)) AS INTEGER)] END AS f FROM c{k})")
        ctes.append(f"s{k} AS MATERIALIZED (SELECT tree_id, node, n, {k} AS depth, f, lo[f] + {u('threshold')} * (hi[f] - lo[f]) AS drawn, lo[f] AS least_, hi[f] AS most_ FROM f{k})")
        if k < levels:
            ctes.append(f"l{k + 1} AS MATERIALIZED (SELECT l.tree_id, l.event_id, l.x, 2 * l.node + CASE WHEN l.x[s.f] < CASE WHEN s.drawn > s.least_ THEN s.drawn ELSE s.most_ END THEN 0 ELSE 1 END AS node "
                        f"FROM l{k} l JOIN s{k} s USING (tree_id, node) WHERE s.f IS NOT NULL)")
    union = " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(levels + 1))
    ctes.append(f"nodes AS MATERIALIZED (SELECT tree_id, node, n, depth, f, CASE WHEN drawn > least_ THEN drawn ELSE most_ END AS threshold FROM ({union}))")
    return "WITH " + ",\n".join(ctes) + select


def _iforest_scores_sql(levels: int = 8) -> str:
    def c(n):
        return f"CASE WHEN {n} > 2 THEN 2.0::DOUBLE * (ln({n} - 1.0::DOUBLE) + 0.5772156649015329) - 2.0::DOUBLE * ({n} - 1.0::DOUBLE) / {n} WHEN {n} = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    walk = ["w0 AS (SELECT event_id, x, t.tree_id, 1 AS node FROM rows_, range(100) t(tree_id))"]
    for k in range(levels + 1):
        walk.append(f"v{k} AS MATERIALIZED (SELECT w.*, s.f, s.threshold, s.n, s.depth FROM w{k} w JOIN nodes s USING (tree_id, node))")
        walk.append(f"w{k + 1} AS (SELECT event_id, x, tree_id, 2 * node + CASE WHEN x[f] < threshold THEN 0 ELSE 1 END AS node FROM v{k} WHERE f IS NOT NULL)")
    ends = " UNION ALL ".join(f"SELECT event_id, tree_id, depth + {c('n')} AS h FROM v{k} WHERE f IS NULL" for k in range(levels + 1))
    return ",\n".join(["", *walk, f"ends AS ({ends})",
        "h AS (SELECT event_id, list_sum(list(h ORDER BY tree_id)) / 100.0::DOUBLE AS h FROM ends GROUP BY event_id)",
        f"sc AS MATERIALIZED (SELECT event_id, -pow(2.0::DOUBLE, -h / ({c('psi')})) AS score FROM h, size_)",
        "k AS (SELECT a > 0.5 AS flipped, CASE WHEN a > 0.5 THEN 1.0 - a ELSE a END AS c, (n - 1) * CASE WHEN a > 0.5 THEN 1.0 - a ELSE a END AS h "
        "FROM (SELECT avg(CAST(y = -1 AS DOUBLE)) AS a, count(*) AS n FROM rows_))",
        "r AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i FROM sc)",
        "o AS (SELECT lo + (h - floor(h)) * (hi - lo) AS off FROM (SELECT any_value(h) AS h, max(score) FILTER (i = floor(h)) AS lo, max(score) FILTER (i = ceil(h)) AS hi FROM r, k))"]) + f"""
SELECT event_id, {rd('score', 'score')}, round(score - off, 6) + 0.0::DOUBLE AS decision,
       CASE WHEN (score < off) = flipped THEN 1 ELSE -1 END AS prediction FROM sc, o, k"""


ORACLE["iforest_trees"] = _iforest_sql(f"""
SELECT tree_id, node AS node_id, coalesce(f - 1, -1) AS feature, {rd('coalesce(threshold, 0)', 'threshold')}, n, depth FROM nodes""")
ORACLE["iforest_scores"] = _iforest_sql(_iforest_scores_sql())


# ---------------------------------------------------------------- metadata, scenarios and saved state

ORACLE["metadata_encode"] = """WITH codes AS (
  SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events WHERE event_type <> 'error'))
SELECT event_id, e.event_type, coalesce(code, -1) AS code, CASE WHEN code IS NULL THEN 'unknown' ELSE 'ok' END AS status FROM events e LEFT JOIN codes USING (event_type)"""

ORACLE["scenario_table"] = f"""WITH s AS (
  SELECT event_id, 'e' || event_id AS scenario_id, event_id % 3 <> 0 AS enabled, event_id * 7 % 131 / 100.0 AS c, event_id * 29 % 113 / 100.0 AS p,
         ['train', 'validation', 'test', 'all', 'live'][event_id % 5 + 1] AS target FROM events),
v AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN 'missing enabled' WHEN event_id % 23 = 0 THEN 'missing target'
                     WHEN event_id % 17 = 0 THEN 'missing corruption.noise_std' WHEN event_id % 19 = 0 THEN 'missing payload_loss.payload_feature'
                     WHEN c > 1 THEN 'corruption.rate not in [0, 1]' WHEN p > 1 THEN 'payload_loss.rate not in [0, 1]'
                     WHEN target = 'live' THEN 'unknown target' END AS reason FROM s)
SELECT scenario_id, reason, CASE WHEN reason IS NULL THEN CASE WHEN enabled THEN 'models' || {_rate('corruption', 7, 131)} || {_rate('noise', 13, 101)} || {_rate('payload', 29, 113)} || '_' || target ELSE 'models' END END AS run_tag
FROM v"""

ORACLE["apply_saved_state"] = f"""{WITH_P}, {_bounds_cte(RAW, 3.0)},
z AS (SELECT {', '.join(f'avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s' for c in RAW)}, count(*) AS n_rows, min(us) AS from_us, max(us) AS to_us FROM packets)
SELECT event_id, {', '.join(rd(f'({_clip(c)} - {c}_m) / {c}_s', c) for c in RAW)}, 1 AS version, n_rows, from_us, to_us FROM packets, b, z"""


# A device's last time, and whether it is over when the micro-batch's watermark has passed that time by a day.
ORACLE["stream_idle"] = f"""{ARRIVALS},
after AS (SELECT batch, max(high) OVER (ORDER BY batch) // 1000 - 3600000 AS wm_after FROM (SELECT batch, max(us) AS high FROM b GROUP BY batch)),
own AS (SELECT device_id, batch, max(us) AS high FROM b GROUP BY device_id, batch),
g AS (SELECT d.device_id, after.batch, wm, wm_after, high, max(high) OVER (PARTITION BY d.device_id ORDER BY after.batch) AS seen
      FROM (SELECT DISTINCT device_id FROM b) d, after JOIN wm ON wm.batch = after.batch LEFT JOIN own ON own.device_id = d.device_id AND own.batch = after.batch),
e AS (SELECT *, coalesce(lag(seen // 1000 + 86400001 < wm_after) OVER (PARTITION BY device_id ORDER BY batch), false) AS anew FROM g),
k AS (SELECT *, sum(CAST(anew AS INTEGER)) OVER (PARTITION BY device_id ORDER BY batch) AS segment,
        CASE WHEN anew THEN high ELSE seen END AS last FROM e),
x AS (SELECT b.*, wm, segment FROM b JOIN k USING (device_id, batch))
SELECT event_id, device_id, us, {rd('coalesce((us - lag(us) OVER (PARTITION BY device_id, segment ORDER BY batch, us, event_id)) / 1000000.0, 0)', 'iat')},
       CASE WHEN us // 1000 < wm THEN 'late' ELSE 'ok' END AS status FROM x
UNION ALL
SELECT -1, device_id, (SELECT max_by(us, us) FROM b WHERE b.device_id = k.device_id AND b.batch = (SELECT max(batch) FROM own WHERE own.device_id = k.device_id AND own.batch <= k.batch)), 0.0, 'ended'
FROM k WHERE last IS NOT NULL AND greatest(last // 1000 + 86400000, coalesce(CASE WHEN high IS NOT NULL THEN wm END, 0)) + 1 < wm_after"""
