"""Registry of named queries and the shared SQL of their independent checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its inventory id; ``sql`` is its DuckDB equivalent."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


TABLES = {
    "code_lookup": """SELECT CAST(p_partkey AS BIGINT) alarm_code,
        concat(trim(p_name), ' ', CAST(p_partkey AS VARCHAR)) description, CAST(p_size % 2 AS INT) stopping
        FROM part WHERE p_size <= 35""",
    "station_metadata": """SELECT CAST(n_nationkey AS VARCHAR) station_id,
        concat('T', lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0')) turbine_name FROM nation""",
    "alarms": """SELECT e.event_id seq, e.ts, CAST(e.user_id % 27 AS VARCHAR) turbine_id, e.alarm_code,
        coalesce(d.description, '(undocumented)') description, coalesce(d.stopping, -1) stopping
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) alarm_code FROM events) e
        LEFT JOIN code_lookup d ON d.alarm_code = e.alarm_code""",
    "alarms_dup": "SELECT * FROM alarms UNION ALL SELECT * FROM alarms WHERE seq % 29 = 0",
    "scada_long": """SELECT event_id seq, ts, CAST(user_id % 27 AS VARCHAR) turbine_id, event_type signal,
        CASE WHEN value < 1 THEN NULL ELSE value END AS value FROM events""",
    "scada_grid": """SELECT event_id seq, date_trunc('day', ts) ts, CAST(user_id % 27 AS VARCHAR) turbine_id,
        event_type signal, CASE WHEN value < 1 THEN NULL ELSE value END AS value FROM events""",
    "scada_wide": """SELECT l_orderkey * 10 + l_linenumber seq, l_shipdate ts, CAST(l_suppkey % 27 AS VARCHAR) turbine_id,
        l_quantity, l_extendedprice, nullif(l_discount, 0.0) l_discount, l_tax FROM lineitem""",
    "raw_log": """SELECT l_orderkey * 10 + l_linenumber seq, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') time_on,
        CASE WHEN l_returnflag <> 'N' THEN strftime(l_shipdate + to_minutes(CAST(l_quantity AS INT)), '%Y-%m-%dT%H:%M:%S') END time_off,
        CAST(l_suppkey % 27 AS VARCHAR) station, CAST(l_partkey AS VARCHAR) code FROM lineitem""",
    "bins": """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) n FROM alarms GROUP BY 1""",
    "bursts": "SELECT * FROM bins WHERE n > 16",
    "runs": """SELECT min(start) AS start, max(start) + INTERVAL 1 HOUR AS stop, count(*) bins, CAST(sum(n) AS BIGINT) records, max(n) peak
        FROM (SELECT *, sum(opens) OVER (ORDER BY start) run_no FROM
          (SELECT *, CASE WHEN lag(start) OVER (ORDER BY start) = start - INTERVAL 1 HOUR THEN 0 ELSE 1 END opens FROM bursts)) GROUP BY run_no""",
    "rules": """SELECT CAST(p_partkey AS BIGINT) code, p_size % 7 kind, CAST(p_partkey % 270 AS VARCHAR) station,
        concat('r', CAST(p_partkey AS VARCHAR)) rule_id, round(0.5 + (p_partkey % 5) / 10.0, 2) confidence, p_partkey % 3 <> 0 reversible,
        CASE WHEN p_size % 7 IN (2, 4) THEN 'collapse' WHEN p_size % 7 = 3 THEN 'escalate' ELSE 'suppress' END AS action
        FROM part""",
    "scored": """SELECT e.event_id seq, e.ts, epoch_us(e.ts) us, CAST(e.user_id % 27 AS VARCHAR) turbine_id,
        CASE WHEN e.user_id % 10 <> 9 THEN CAST(json_extract_string(e.props, '$.k') AS BIGINT) END alarm_code,
        e.event_type sig, e.value val, round(e.value * 2, 2) load, (e.value > 60 OR e.user_id % 37 = 5) is_critical FROM events e""",
    "matched": """SELECT e.seq, r.code, r.kind, r.rule_id, r.confidence, r.action FROM scored e JOIN rules r ON
        (r.kind IN (0, 2) AND e.alarm_code = r.code) OR (r.kind IN (1, 4) AND e.alarm_code = r.code AND e.turbine_id = r.station)
        OR (r.kind = 3 AND e.alarm_code = r.code AND e.load >= 30) OR (r.kind = 5 AND e.alarm_code = r.code AND e.load < 40)
        OR (r.kind = 6 AND e.turbine_id = r.station AND e.sig = 'click' AND e.val < 5 AND (e.alarm_code IS NULL OR e.alarm_code <> 7))""",
    "picked": """SELECT seq, max(confidence) FILTER (action = 'escalate') esc,
        min(code) FILTER (action = 'suppress' AND kind <> 5) sup, min(code) FILTER (action = 'collapse') col,
        min(code) FILTER (kind = 5) lea FROM matched GROUP BY seq""",
    "decided": """SELECT e.*, p.esc, CASE WHEN e.is_critical THEN 'critical' WHEN p.esc IS NOT NULL THEN 'escalate'
        WHEN p.sup IS NOT NULL THEN 'suppress' WHEN p.col IS NOT NULL THEN 'collapse' ELSE 'classify' END stage,
        CASE WHEN e.is_critical OR p.esc IS NOT NULL THEN NULL ELSE coalesce(p.sup, p.col, p.lea) END rule_code
        FROM scored e LEFT JOIN picked p ON p.seq = e.seq""",
    "fold_base": """SELECT rule_code, turbine_id, seq, us, row_number() OVER (PARTITION BY rule_code, turbine_id ORDER BY seq) rn
        FROM decided WHERE stage = 'collapse'""",
    "folded": """SELECT rule_code, turbine_id, seq, rn, us anchor, false hidden FROM fold_base WHERE rn = 1
        UNION ALL SELECT b.rule_code, b.turbine_id, b.seq, b.rn,
          CASE WHEN b.us - f.anchor >= 0 AND b.us - f.anchor < 14400000000 THEN f.anchor ELSE b.us END,
          b.us - f.anchor >= 0 AND b.us - f.anchor < 14400000000
        FROM folded f JOIN fold_base b ON b.rule_code = f.rule_code AND b.turbine_id = f.turbine_id AND b.rn = f.rn + 1""",
    "verdict": """SELECT d.seq, d.ts, d.turbine_id, d.alarm_code, d.stage,
        NOT (d.stage = 'suppress' OR coalesce(f.hidden, false)) AS show,
        CASE WHEN d.stage = 'suppress' OR coalesce(f.hidden, false) THEN r.rule_id END suppressed_by,
        CASE WHEN d.stage = 'critical' THEN 1.0 WHEN d.stage = 'escalate' THEN d.esc WHEN d.stage = 'classify' THEN 0.5 ELSE r.confidence END confidence
        FROM decided d LEFT JOIN folded f ON f.seq = d.seq LEFT JOIN rules r ON r.code = d.rule_code""",
    "lifetimes": """SELECT t.*, t.i + 1 v_from, coalesce(u.v_to, 4611686018427387904) v_to FROM
        (SELECT *, row_number() OVER (ORDER BY code) i FROM rules) t LEFT JOIN
        (SELECT code, (SELECT count(*) FROM rules) + row_number() OVER (ORDER BY code) + 1 v_to FROM rules WHERE reversible AND code % 4 = 1) u
        ON u.code = t.code""",
    "revisions": """SELECT version, CAST(floor(version * (SELECT count(*) FROM events) / (SELECT max(v) FROM (SELECT max(v_from) v FROM lifetimes UNION ALL SELECT max(v_to) FROM lifetimes WHERE v_to < 4611686018427387904))) AS BIGINT) applied_at FROM
        (SELECT v_from AS version FROM lifetimes UNION ALL SELECT v_to FROM lifetimes WHERE v_to < 4611686018427387904)""",
    "revised": """SELECT e.seq, coalesce(max(v.version), 1) revision FROM scored e LEFT JOIN revisions v ON v.applied_at - 500 <= e.seq GROUP BY e.seq""",
    "long_readings": """SELECT *, count(value) OVER w n, avg(value) OVER w mean, stddev_pop(value) OVER w std, min(value) OVER w lo, max(value) OVER w hi
        FROM scada_long WHERE value IS NOT NULL
        WINDOW w AS (PARTITION BY turbine_id, signal ORDER BY seq ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)""",
    "zscores": """SELECT seq, turbine_id, signal, CASE WHEN n < 2 THEN 0.0 WHEN lo = hi THEN abs(value - lo) / 1e-9
        ELSE abs(value - mean) / greatest(std, 1e-9) END score FROM long_readings""",
    "layers": """SELECT *, row_number() OVER (PARTITION BY ts, turbine_id, signal ORDER BY seq) - 1 AS layer FROM scada_grid""",
    "stream": """SELECT row_number() OVER (ORDER BY ts, is_alarm, turbine_id, rnk, src) - 1 AS seq, ts, turbine_id, alarm_code, is_alarm, readings FROM (
        SELECT ts, turbine_id, alarm_code, true is_alarm, alarm_code rnk, seq src, '' readings FROM alarms UNION ALL
        SELECT ts, turbine_id, NULL, false, layer, 0, string_agg(concat(signal, '=', CASE WHEN value IS NULL THEN 'null' ELSE printf('%.2f', value) END), ',' ORDER BY signal)
        FROM layers GROUP BY ts, turbine_id, layer)""",
}
_NEEDS = {
    "alarms": ["code_lookup"],
    "alarms_dup": ["alarms"],
    "bins": ["alarms"],
    "bursts": ["bins"],
    "runs": ["bursts"],
    "matched": ["scored", "rules"],
    "picked": ["matched"],
    "decided": ["scored", "picked"],
    "fold_base": ["decided"],
    "folded": ["fold_base"],
    "verdict": ["decided", "folded", "rules"],
    "lifetimes": ["rules"],
    "revisions": ["lifetimes"],
    "revised": ["scored", "revisions"],
    "long_readings": ["scada_long"],
    "zscores": ["long_readings"],
    "layers": ["scada_grid"],
    "stream": ["alarms", "layers"],
}


def sql(body: str, *needs: str, **extra: str) -> str:
    """SQL text with the shared tables it needs in front; ``extra`` adds or replaces tables."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in _NEEDS.get(name, []):
            visit(n)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    parts = [f"{n} AS ({extra.pop(n, TABLES.get(n))})" for n in order]
    parts += [f"{n} AS ({text})" for n, text in extra.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body
