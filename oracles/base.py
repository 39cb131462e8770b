"""Common table expressions shared by the SQL queries, and their composition."""

from __future__ import annotations

from gatherline.sources import venue


def rnd(x: str, n: int) -> str:
    return f"(floor(({x}) * 1e{n} + 0.5) / 1e{n})"


def mean(x: str) -> str:
    return f"(CAST(sum(CAST(floor(({x}) * 1e9 + 0.5) AS BIGINT)) AS DOUBLE) / (count({x}) * 1e9))"


def band(x: str) -> str:
    return f"CASE WHEN {x} < 0.35 THEN 'low' WHEN {x} < 0.60 THEN 'moderate' WHEN {x} < 0.80 THEN 'high' ELSE 'critical' END"


def bucket(width: str, time: str = "time") -> str:
    return f"time_bucket(INTERVAL '{width}', {time}, TIMESTAMP '1970-01-01')"


def text_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def rows(values) -> str:
    def one(v):
        if isinstance(v, str):
            return f"'{v}'"
        if isinstance(v, list):
            return text_list(v)
        if isinstance(v, float):
            return f"{v!r}::DOUBLE"
        return str(v)

    return ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in values)


def percent(x: str) -> str:
    return f"CAST(CAST(floor({x} * 100.0 + 0.5) AS BIGINT) AS VARCHAR) || '%'"


def whole(x: str) -> str:
    return f"CAST(CAST(floor({x} + 0.5) AS BIGINT) AS VARCHAR)"


def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S.%f')"


def uuid(*parts: str) -> str:
    h = "md5(concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "))"
    return f"(substr({h},1,8)||'-'||substr({h},9,4)||'-'||substr({h},13,4)||'-'||substr({h},17,4)||'-'||substr({h},21,12))"


K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
ZONE = f"{text_list(venue.ZONES)}[user_id % 12 + 1]"


def seat(n: str) -> str:
    return f"(['V','U','L'][{n} % 3 + 1] || CAST({n} AS VARCHAR))"


def seat_zone(s: str) -> str:
    return (
        f"CASE upper(substr({s},1,1)) WHEN 'V' THEN 'VIP-Lounge' WHEN 'U' THEN 'Upper-Stands' ELSE 'Lower-Stands' END"
    )


def erlang(l: str, mu: str, c: str) -> str:
    a = f"(({l}) / {mu})"
    r = f"(({l}) / {mu} / {c})"
    top = f"(pow({a}, {c}) / factorial({c}) / (1 - {r}))"
    below = f"list_sum(list_transform(range(0, {c}), lambda k: pow({a}, k) / factorial(CAST(k AS INTEGER))))"
    return f"CASE WHEN ({l}) <= 0 THEN 0.0 WHEN {r} >= 1 THEN 1.0 ELSE {top} / ({below} + {top}) END"


def mean_wait(l: str, mu: str, c: str) -> str:
    r = f"(({l}) / {mu} / {c})"
    queued = f"({erlang(l, mu, c)}) / ({c} * {mu} * (1 - {r}))"
    return (
        f"CASE WHEN ({l}) <= 0 THEN 0.0 WHEN {r} >= 1 THEN least(60.0, ({l}) / ({c} * {mu})) "
        f"ELSE {rnd(f'least({queued}, 60.0)', 2)} END"
    )


# name -> (needs, SQL)
CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (list(needs), sql)


def compose(body: str, *needs: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with the CTEs it needs, in order of dependency."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for n in CTES[name][0]:
            add(n)
        order.append(name)

    for n in needs:
        add(n)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" if not CTES[n][1].startswith("--r") else f"{n} AS ({CTES[n][1][3:]})" for n in order]
    parts += [f"{n} AS ({s})" for n, s in (extra or {}).items()]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body


cte("stands_dim", f"SELECT * FROM (VALUES {rows([(i, *s) for i, s in enumerate(venue.STANDS)])}) t(stand_order, stand_id, stand_name, zone, capacity, c, mu)")
cte("edges", f"SELECT a AS u, b AS v, s FROM (VALUES {rows(venue.CORRIDORS)}) t(a, b, s) UNION ALL SELECT b, a, s FROM (VALUES {rows(venue.CORRIDORS)}) t(a, b, s)")
cte("zones_dim", f"SELECT * FROM (VALUES {rows(list(enumerate(venue.ZONES)))}) t(zone_order, zone)")
cte("seating", f"SELECT * FROM (VALUES {rows([(i, z, g) for i, (z, g) in enumerate(venue.SEATING_GATES)])}) t(seat_order, zone, own)")

cte(
    "crowd",
    f"""SELECT ts AS time, event_id AS tie, {ZONE} AS zone,
        'CS-' || {ZONE} || '-' || CAST(user_id % 2 + 1 AS VARCHAR) AS sensor_id,
        CAST({K} AS DOUBLE) / 100 AS density, {K} * 10 AS headcount, value AS flow_rate,
        CASE WHEN CAST({K} AS DOUBLE) / 100 > 0.75 THEN 'outbound' WHEN CAST({K} AS DOUBLE) / 100 < 0.3 THEN 'inbound' ELSE 'mixed' END AS direction
        FROM events""",
)
cte(
    "queue",
    """SELECT ts AS time, event_id AS tie, 'QS-' || stand_id AS sensor_id, stand_id, stand_name, zone,
        CAST(floor(value / 10) AS INTEGER) AS queue_length, floor(value / 4) / 3.5::DOUBLE AS wait_minutes,
        least(1.0::DOUBLE, CAST(floor(value / 10) AS DOUBLE) / capacity) AS capacity_pct, event_id % 50 <> 0 AS is_open
        FROM events JOIN stands_dim ON stand_order = user_id % 8""",
    "stands_dim",
)
cte(
    "ble",
    f"""SELECT ts AS time, event_id AS tie, 'BLE-' || CAST(user_id % 15 + 1 AS VARCHAR) AS beacon_id,
        'Beacon ' || CAST(user_id % 15 + 1 AS VARCHAR) AS location_label, {ZONE} AS zone, {K} * 10 AS active_devices,
        -55.0::DOUBLE - CAST({K} AS DOUBLE) / 10 AS rssi_avg, value AS dwell_time_avg FROM events""",
)
cte(
    "cctv",
    f"""SELECT ts AS time, event_id AS tie, 'CAM-' || CAST(user_id % 12 + 1 AS VARCHAR) AS camera_id, {ZONE} AS zone,
        {K} * 10 AS headcount_estimate, CAST({K} AS DOUBLE) / 100 AS motion_intensity, event_type = 'error' AS anomaly_detected,
        CASE WHEN event_type = 'error' THEN {text_list(venue.ANOMALY_TYPES)}[{K} % 5 + 1] END AS anomaly_type FROM events""",
)
cte(
    "requests",
    f"""SELECT ts AS placed_at, event_id AS tie, {seat('user_id')} AS seat_id,
        {text_list([s[0] for s in venue.STANDS] + ['ZZ99'])}[{K} % 9 + 1] AS stand_id, {K} % 22 AS quantity, value AS price
        FROM events WHERE event_type = 'purchase'""",
)
cte(
    "heads",
    f"""SELECT o_orderdate AS placed_at, CAST(o_orderkey AS VARCHAR) AS order_id, o_orderkey, {seat('o_custkey')} AS seat_id,
        stand_id, stand_name,
        CASE WHEN o_orderkey % 5 = 1 THEN 'Concourse-A' WHEN o_orderkey % 5 <> 0 THEN {seat_zone(seat('o_custkey'))} END AS zone,
        CASE o_orderstatus WHEN 'O' THEN 'placed' WHEN 'P' THEN 'preparing' ELSE 'delivered' END AS status
        FROM orders JOIN stands_dim ON stand_order = o_custkey % 8""",
    "stands_dim",
)
cte(
    "items",
    """SELECT l_orderkey, l_linenumber, p_name AS name, (CAST(l_quantity AS INTEGER) - 1) % 20 + 1 AS quantity, p_retailprice AS price
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
# Sums in line order, as an order's items are listed.
cte(
    "totals",
    f"""SELECT o_orderkey, count(l_orderkey) AS n,
        {rnd("coalesce(list_sum(list(price * quantity ORDER BY l_linenumber, name, quantity, price) FILTER (WHERE l_orderkey IS NOT NULL)), 0.0)", 2)} AS total
        FROM orders LEFT JOIN items ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
    "items",
)
cte("zone_state", f"SELECT zone, time AS last_updated, density, headcount, flow_rate, direction, {band('density')} AS congestion_level FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY time DESC, tie DESC) rn FROM crowd) WHERE rn = 1", "crowd")
cte(
    "stand_state",
    """SELECT d.stand_id, d.stand_name, d.zone, q.time AS last_updated, coalesce(queue_length, 0) AS queue_length,
        coalesce(wait_minutes, 0.0) AS wait_minutes, coalesce(capacity_pct, 0.0) AS capacity_pct, coalesce(is_open, true) AS is_open
        FROM stands_dim d LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY stand_id ORDER BY time DESC, tie DESC) rn FROM queue) q
        ON q.stand_id = d.stand_id AND rn = 1""",
    "stands_dim", "queue",
)
cte(
    "rates",
    f"""SELECT *, CASE WHEN q1 IS NULL THEN c * mu * 0.9::DOUBLE ELSE {rnd('greatest(0.1::DOUBLE, c * mu + (queue_length - q1))', 3)} END AS lam,
        coalesce(q2 < q1 AND q1 < queue_length AND CAST(queue_length - q2 AS DOUBLE) / greatest(1, q2) > 0.2::DOUBLE, false) AS spike
        FROM (SELECT q.*, d.c, d.mu, lag(queue_length, 1) OVER w AS q1, lag(queue_length, 2) OVER w AS q2
              FROM queue q JOIN stands_dim d USING (stand_id) WINDOW w AS (PARTITION BY stand_id ORDER BY time, tie))""",
    "queue", "stands_dim",
)
cte(
    "forecast",
    f"""SELECT *, {rnd('lam', 3)} AS lam3, {rnd('lam / (c * mu)', 3)} AS rho3, lam / (c * mu) AS rho,
        {mean_wait('lam', 'mu', 'c')} AS w0,
        {rnd(mean_wait('(lam * CASE WHEN spike THEN 1.4::DOUBLE ELSE 1.1::DOUBLE END)', 'mu', 'c'), 2)} AS w5,
        {rnd(mean_wait('(lam * CASE WHEN spike THEN 2.8::DOUBLE ELSE 1.2::DOUBLE END)', 'mu', 'c'), 2)} AS w10
        FROM rates""",
    "rates",
)
cte(
    "advice",
    f"""SELECT *, CASE WHEN spike THEN 'Halftime surge imminent at ' || stand_name || ' — open reserve till or push mobile-order nudge now'
        WHEN rho > 0.85 THEN stand_name || ' near saturation (ρ=' || printf('%.2f', {rnd('rho', 2)}) || ') — consider second server'
        WHEN w0 > 12 THEN 'Long wait at ' || stand_name || ' — surface shorter alternatives to nearby fans'
        ELSE stand_name || ' operating normally (ρ=' || printf('%.2f', {rnd('rho', 2)}) || ')' END AS recommendation
        FROM forecast""",
    "forecast",
)
cte(
    "cold",
    f"SELECT stand_id, {rnd(mean_wait('(c * mu * 0.9::DOUBLE * 1.1::DOUBLE)', 'mu', 'c'), 2)} AS w5 FROM stands_dim",
    "stands_dim",
)
cte(
    "sensor_alerts",
    f"""SELECT time, tie, 1 AS source_order, 'queue' AS category, zone, stand_id,
        CASE WHEN wait_minutes > 15 THEN 'Long queue at ' || stand_name || ' (' || {whole('wait_minutes')} || ' min wait) — consider opening reserve stand'
        ELSE 'Moderate queue at ' || stand_name || ' (' || {whole('wait_minutes')} || ' min wait)' END AS message
        FROM queue WHERE wait_minutes > 10
        UNION ALL SELECT time, tie, 2, 'crowd', zone, NULL, 'High crowd density in ' || zone || ' (' || {percent('density')} || ') — activate crowd management'
        FROM crowd WHERE density > 0.85
        UNION ALL SELECT time, tie, 3, 'cctv', zone, NULL, 'Anomaly detected by ' || camera_id || ' in ' || zone || ': ' || anomaly_type
        FROM cctv WHERE anomaly_detected""",
    "queue", "crowd", "cctv",
)
cte(
    "alerts",
    f"""SELECT time, {uuid('source_order', 'tie')} AS alert_id, CASE WHEN category = 'queue' THEN 'warning' ELSE 'critical' END AS severity,
        category, zone, stand_id, message, tie % 3 = 0 AS resolved FROM (
        SELECT * FROM sensor_alerts UNION ALL
        SELECT time, tie, 5, 'queue', NULL, stand_id, recommendation FROM advice WHERE spike)""",
    "sensor_alerts", "advice",
)

# Count-based runs.
cte("indexed", "SELECT *, row_number() OVER (ORDER BY time, tie) AS i, count(*) OVER () AS total FROM crowd", "crowd")
cte("members", "SELECT *, unnest(generate_series((i + 4) // 5, least((i + 54) // 5, total // 5))) AS run FROM indexed", "indexed")
cte("run_zones", f"SELECT run, zone, {mean('density')} AS d, min(i) AS appeared FROM members GROUP BY run, zone", "members")
cte("run_times", "SELECT i // 5 AS run, time FROM indexed WHERE i % 5 = 0", "indexed")
cte("run_steps", "SELECT *, row_number() OVER (PARTITION BY zone ORDER BY run) AS step FROM run_zones", "run_zones")
cte(
    "smoothed",
    """--r SELECT zone, run, step, 0.3::DOUBLE * d + 0.7::DOUBLE * d AS s FROM run_steps WHERE step = 1
        UNION ALL SELECT z.zone, z.run, z.step, 0.3::DOUBLE * z.d + 0.7::DOUBLE * e.s FROM smoothed e JOIN run_steps z ON z.zone = e.zone AND z.step = e.step + 1""",
    "run_steps",
)
cte(
    "avoid",
    """SELECT a.run, a.zone, coalesce(string_agg(b.zone, ',' ORDER BY b.appeared) FILTER (WHERE b.d > 0.7 AND b.zone <> a.zone), '') AS avoid_zones
        FROM run_zones a JOIN run_zones b USING (run) GROUP BY a.run, a.zone""",
    "run_zones",
)


def route_ctes(prefix: str, snaps: str, sources: str, rounds: int = 11) -> dict[str, str]:
    """CTEs of a relaxation: ``snaps``(sid, zone, d), ``sources``(sid, src).

    The last ones are ``{prefix}dist``(sid, src, node, cost) and ``{prefix}pred``.
    """
    p = prefix
    out = {
        f"{p}w AS MATERIALIZED": f"""SELECT k.sid, e.u, e.v, e.s * (1 + 4.0::DOUBLE * (coalesce(b.d, 0.0) * coalesce(b.d, 0.0))) AS w
            FROM (SELECT DISTINCT sid FROM {sources}) k, edges e
            LEFT JOIN {snaps} a ON a.sid = k.sid AND a.zone = e.u LEFT JOIN {snaps} b ON b.sid = k.sid AND b.zone = e.v
            WHERE coalesce(a.d, 0.0) < 0.9 AND coalesce(b.d, 0.0) < 0.9""",
        f"{p}d0 AS MATERIALIZED": f"SELECT sid, src, src AS node, 0.0::DOUBLE AS cost FROM {sources}",
    }
    for r in range(rounds):
        out[f"{p}d{r + 1} AS MATERIALIZED"] = f"""SELECT sid, src, node, min(cost) AS cost FROM (
            SELECT * FROM {p}d{r} UNION ALL SELECT d.sid, d.src, w.v, d.cost + w.w FROM {p}d{r} d JOIN {p}w w ON w.sid = d.sid AND w.u = d.node)
            GROUP BY sid, src, node"""
    out[f"{p}pred AS MATERIALIZED"] = f"""SELECT sid, src, node, u FROM (
            SELECT t.sid, t.src, t.node, f.node AS u, row_number() OVER (PARTITION BY t.sid, t.src, t.node ORDER BY f.cost, f.node) AS rn
            FROM {p}d{rounds} t JOIN {p}w w ON w.sid = t.sid AND w.v = t.node
            JOIN {p}d{rounds} f ON f.sid = t.sid AND f.src = t.src AND f.node = w.u AND f.cost + w.w = t.cost
            WHERE t.node <> t.src) WHERE rn = 1"""
    out[f"{p}dist"] = f"SELECT * FROM {p}d{rounds}"
    return out


def path_ctes(prefix: str, targets: str, sep: str, rounds: int = 11) -> dict[str, str]:
    """Walk back from ``targets``(sid, src, dst): ``{prefix}paths``(sid, src, dst, cost, path)."""
    p = prefix
    out = {
        f"{p}p0 AS MATERIALIZED": f"SELECT t.sid, t.src, t.dst, d.cost, t.dst AS cur, t.dst AS path FROM {targets} t JOIN {p}dist d ON d.sid = t.sid AND d.src = t.src AND d.node = t.dst"
    }
    for r in range(rounds):
        out[f"{p}p{r + 1} AS MATERIALIZED"] = f"""SELECT a.sid, a.src, a.dst, a.cost, b.u AS cur, CASE WHEN b.u IS NULL THEN a.path ELSE b.u || '{sep}' || a.path END AS path
            FROM {p}p{r} a LEFT JOIN {p}pred b ON b.sid = a.sid AND b.src = a.src AND b.node = a.cur"""
    out[f"{p}paths"] = f"SELECT sid, src, dst, cost, path FROM {p}p{rounds}"
    return out


def compose_with(body: str, needs: list[str], *extras: dict[str, str]) -> str:
    """Like :func:`compose`, with further CTEs after the shared ones."""
    merged: list[str] = []
    for e in extras:
        for name, sql in e.items():
            merged.append(f"{name} ({sql})" if " AS MATERIALIZED" in name else f"{name} AS ({sql})")
    head = compose("", *needs)
    joined = head.rstrip() + (",\n" if head else "WITH RECURSIVE ") + ",\n".join(merged)
    return joined + "\n" + body
