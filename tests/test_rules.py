"""Hand-computed cases of the column functions and small operators."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from gatherline.functions import crowd as crowd_f
from gatherline.functions import queueing, text
from gatherline.functions.numbers import exact_mean, round_half_up
from gatherline.operators import alerts, egress, heatmap, latest, orders, rollup, wait
from gatherline.sources import messages, venue


def t(minute, second=0):
    return datetime(2024, 1, 1, 12, minute, second, tzinfo=timezone.utc)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_bands(spark):
    rows = spark.createDataFrame([(0.3499,), (0.35,), (0.60,), (0.80,), (1.0,)], "d double")
    bands = [r[0] for r in rows.orderBy("d").select(crowd_f.congestion_band(F.col("d"))).collect()]
    assert bands == ["low", "moderate", "high", "critical", "critical"]


def test_rounding_is_half_up(spark):
    r = one(spark, a=round_half_up(F.lit(0.125), 2), b=round_half_up(F.lit(1.083), 1), c=round_half_up(F.lit(-0.25), 1))
    assert (r.a, r.b, r.c) == (0.13, 1.1, -0.2)


def test_mean_does_not_depend_on_order(spark):
    values = [0.1 * (i % 10) for i in range(1000)]
    means = set()
    for parts in (1, 3, 7):
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(parts)
        means.add(df.agg(exact_mean(F.col("v"))).first()[0])
    assert means == {0.45}


def test_erlang_c_edges(spark):
    p = queueing.erlang_c
    r = one(
        spark,
        none=p(F.lit(0.0), F.lit(1.0), F.lit(2)),
        full=p(F.lit(4.0), F.lit(1.0), F.lit(2)),
        single=p(F.lit(0.5), F.lit(1.0), F.lit(1)),
        no_tills=p(F.lit(1.0), F.lit(1.0), F.lit(0)),
        no_rate=p(F.lit(1.0), F.lit(0.0), F.lit(2)),
    )
    assert (r.none, r.full, r.single, r.no_tills, r.no_rate) == (0.0, 1.0, 0.5, 0.0, 0.0)


@pytest.mark.parametrize(
    "stand, lengths, expected",
    [
        ("C4", [4], (5.4, 0.9, 1.36, 16.35, 1.08, False)),
        ("C4", [4, 5], (7.0, 1.167, 1.1667, 1.28, 1.4, False)),
        ("C4", [4, 5, 7], (8.0, 1.333, 1.3333, 1.87, 3.73, True)),
        ("C4", [4, 5, 7, 7], (6.0, 1.0, 1.0, 1.1, 1.2, False)),
        ("D2", [10, 2], (1.2, 0.13, 0.0, 0.0, 0.0, False)),
        ("A7", [100, 105, 115], (12.4, 5.167, 5.1667, 5.68, 6.2, False)),
        ("ZZ", [1], (2.7, 0.9, 2.84, 32.83, 1.08, False)),
    ],
)
def test_wait_forecasts(spark, stand, lengths, expected):
    rows = [(t(i), i, stand, "Stand", n) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "time timestamp, tie long, stand_id string, stand_name string, queue_length int")
    r = wait.wait_forecasts(df).orderBy("tie").collect()[-1]
    got = (
        r.arrival_rate_lambda, r.utilization_rho, round(r.current_wait_min, 4), r.predicted_wait_5min,
        r.predicted_wait_10min, r.halftime_spike_expected,
    )
    assert got == expected


def test_buffer_size(spark):
    rows = [(t(i), i, "C4", "Stand", n) for i, n in enumerate([4, 5, 7])]
    df = spark.createDataFrame(rows, "time timestamp, tie long, stand_id string, stand_name string, queue_length int")
    spikes = {n: wait.wait_forecasts(df, n).where("halftime_spike_expected").count() for n in (1, 2, 3, 5)}
    assert spikes == {1: 0, 2: 0, 3: 1, 5: 1}
    assert {r[0] for r in wait.wait_forecasts(df, 1).select("arrival_rate_lambda").collect()} == {5.4}


def test_recommendation_order(spark):
    def say(spike, load, wait_minutes):
        return one(spark, r=queueing.recommendation(F.lit(spike), F.lit(load), F.lit(wait_minutes), F.lit("Bar"))).r

    assert say(True, 0.9, 20.0).startswith("Halftime surge imminent at Bar")
    assert say(False, 0.86, 20.0) == "Bar near saturation (ρ=0.86) — consider second server"
    assert say(False, 0.5, 12.5).startswith("Long wait at Bar")
    assert say(False, 0.5, 12.0) == "Bar operating normally (ρ=0.50)"


def test_seat_zones(spark):
    seats = {"V12": "VIP-Lounge", "vip-3": "VIP-Lounge", "u-3": "Upper-Stands", "D-14": "Lower-Stands"}
    for seat, zone in seats.items():
        assert one(spark, z=crowd_f.seat_zone(F.lit(seat))).z == zone


def test_uuid_forms(spark):
    good = "123e4567-e89b-12d3-a456-426614174000"
    forms = [good, good.upper(), "{" + good + "}", "urn:uuid:" + good, good.replace("-", "")]
    for form in forms:
        r = one(spark, ok=text.is_uuid(F.lit(form)), c=text.canonical_uuid(F.lit(form)))
        assert r.ok and r.c == good
    for form in ["", "x", good[:-1], good + "0", "g" + good[1:]]:
        assert not one(spark, ok=text.is_uuid(F.lit(form))).ok


def test_items_from_json(spark):
    r = one(
        spark,
        good=F.size(text.items_from_json(F.lit('[{"name":"A","quantity":2,"price":1.5}]'))),
        bad=F.size(text.items_from_json(F.lit("not json"))),
    )
    assert (r.good, r.bad) == (1, 0)


def test_path_text(spark):
    r = one(
        spark,
        two=text.path_text(F.array(F.lit("A"), F.lit("B"))),
        own=text.path_text(F.array(F.lit("A"))),
        none=text.path_text(F.array().cast("array<string>")),
    )
    assert (r.two, r.own, r.none) == ("A → B", None, None)


def _message(**changes):
    import json

    fields = {
        "sensor_id": "CS-1", "zone": "Concourse-B", "timestamp": "2024-01-01T12:00:00Z", "density": 0.55,
        "headcount": 275, "flow_rate": 2.1, "direction": "inbound",
    }
    fields.update(changes)
    return json.dumps({k: v for k, v in fields.items() if v is not None})


def test_crowd_messages(spark):
    texts = [
        _message(), _message(density=1.2), _message(zone=None), "{bad", _message(timestamp="yesterday"),
        _message(density="dense"),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "tie long, value string")
    parsed = messages.parse(df, venue.CROWD_TOPIC)
    assert [r.zone for r in messages.accepted(parsed).collect()] == ["Concourse-B"]
    reasons = {r.tie: r.reasons for r in messages.quarantined(parsed).collect()}
    assert reasons == {
        1: ["density outside 0..1"], 2: ["missing zone"], 3: ["unreadable"], 4: ["bad timestamp"], 5: ["unreadable"],
    }


def test_times(spark):
    wanted = {
        "2024-01-01T12:00:00Z": t(0), "2024-01-01T14:00:00+02:00": t(0), "2024-01-01T12:00:00": t(0), "nope": None,
    }
    for written, expected in wanted.items():
        found = one(spark, s=F.unix_seconds(text.parse_time(F.lit(written)))).s
        assert found == (int(expected.timestamp()) if expected else None)


def test_stand_state_keeps_first_name_and_seeds(spark):
    rows = [
        (t(0), 0, "X9", "First", "Gate-East", 3, 1.0, 0.1, True),
        (t(1), 1, "X9", "Second", "Gate-West", 5, 2.0, 0.2, False),
    ]
    df = spark.createDataFrame(
        rows,
        "time timestamp, tie long, stand_id string, stand_name string, zone string, queue_length int, "
        "wait_minutes double, capacity_pct double, is_open boolean",
    )
    state = {r.stand_id: r for r in latest.stand_state(df).collect()}
    assert len(state) == 9
    assert (state["X9"].stand_name, state["X9"].zone, state["X9"].queue_length) == ("First", "Gate-East", 5)
    assert (state["C4"].queue_length, state["C4"].is_open, state["C4"].last_updated) == (0, True, None)


def test_gate_density(spark):
    recent = spark.createDataFrame(
        [("Gate-North", 0.40, 3.0, 10), ("Gate-South", 0.92, 2.0, 20)],
        "zone string, avg_density double, avg_flow_rate double, max_headcount int",
    )
    zones = spark.createDataFrame(
        [("Gate-North", 0.95), ("Gate-East", 0.70), ("Gate-West", None), ("Concourse-A", 0.99)], "zone string, density double"
    )
    rows = {r.gate: (r.avg_density, r.avg_flow_rate) for r in egress.gate_densities(recent, zones).collect()}
    assert rows == {
        "Gate-North": (0.95, 3.0), "Gate-South": (0.92, 2.0), "Gate-East": (0.70, 0.0), "Gate-West": (0.0, 0.0),
    }


def _plan(spark, blocked, densities=None):
    plans = spark.createDataFrame([(t(0),)], "plan_time timestamp")
    zones = spark.createDataFrame([(t(0), z, d) for z, d in (densities or {}).items()], "plan_time timestamp, zone string, density double")
    gates = spark.createDataFrame([(t(0), g, 0.95) for g in blocked] or [(t(0), "Gate-West", 0.1)], "plan_time timestamp, gate string, avg_density double")
    return egress.exit_plans(plans, zones, gates).orderBy("priority").collect()


def test_exit_plan(spark):
    densities = {
        "VIP-Lounge": 0.30, "Concourse-C": 0.35, "Concourse-B": 0.45, "Concourse-A": 0.60, "Upper-Stands": 0.65, "Lower-Stands": 0.80,
    }
    rows = _plan(spark, ["Gate-North"], densities)
    got = [(r.priority, r.zone, r.departure_offset_minutes, r.recommended_gate, r.gate_was_rerouted) for r in rows]
    assert got == [
        (1, "VIP-Lounge", 6.5, "Gate-East", True),
        (2, "Concourse-C", 6.75, "Gate-South", False),
        (3, "Concourse-B", 7.25, "Gate-East", False),
        (4, "Concourse-A", 8.0, "Gate-East", False),
        (5, "Upper-Stands", 16.5, "Gate-East", False),
        (6, "Lower-Stands", 18.0, "Gate-East", False),
    ]
    assert rows[0].blocked == ["Gate-North"] and "Gate-East" in rows[0].note
    assert (rows[0].window_end - rows[0].window_start).total_seconds() == 300


def test_exit_plan_with_all_gates_blocked(spark):
    own = {z: g[0] for z, g in venue.SEATING_GATES}
    rows = _plan(spark, venue.GATES_BY_PRIORITY)
    assert {r.zone: r.recommended_gate for r in rows} == own
    assert all(r.gate_was_rerouted for r in rows)
    # Without densities, equal offsets keep the seating order.
    assert [r.zone for r in rows] == ["VIP-Lounge", "Concourse-A", "Concourse-B", "Concourse-C", "Lower-Stands", "Upper-Stands"]


def test_exit_plan_argument(spark):
    with pytest.raises(ValueError):
        egress.exit_plans(spark.createDataFrame([(t(0),)], "plan_time timestamp"), None, None, 121)


def test_hops(spark):
    hops = {r.zone: r.hops for r in egress.gate_hops(spark).collect()}
    assert {z: hops[z] for z, _ in venue.SEATING_GATES} == {
        "VIP-Lounge": 1, "Lower-Stands": 2, "Upper-Stands": 2, "Concourse-A": 1, "Concourse-B": 1, "Concourse-C": 1,
    }
    assert hops["Gate-North"] == 0 and hops["Parking-P1"] == 1
    cut_off = {r.zone: r.hops for r in egress.gate_hops(spark, [("Upper-Stands", "Lower-Stands", 1.0)]).collect()}
    assert (cut_off["Upper-Stands"], cut_off["VIP-Lounge"], cut_off["Parking-P1"]) == (3, 1, 3)


def test_heatmap(spark):
    zones = spark.createDataFrame(
        [("Gate-North", t(0), 0.95, 10, 1.0, "mixed", "critical", None), ("Concourse-B", t(0), 0.2, 5, 1.0, "mixed", "low", True)],
        "zone string, last_updated timestamp, density double, headcount int, flow_rate double, direction string, "
        "congestion_level string, anomaly_active boolean",
    )
    stands = spark.createDataFrame(
        [("B2", "Beer", "Concourse-B", 1, None), ("B5", "Burgers", "Concourse-B", 1, 7.0), ("B8", "Grill", "Concourse-B", 1, 3.0), ("C4", "Dogs", "Aisle", 1, 1.0)],
        "stand_id string, stand_name string, zone string, queue_length int, wait_minutes double",
    ).withColumns({"capacity_pct": F.lit(0.5), "predicted_wait_5min": F.lit(None).cast("double"), "is_open": F.lit(True), "halftime_spike_expected": F.lit(None).cast("boolean")})
    heat = heatmap.heatmap(zones, stands)
    rows = heatmap.in_display_order(heat).collect()
    assert [r.zone for r in rows] == ["Concourse-B", "Gate-North", "Aisle"]
    assert [s.stand_id for s in rows[0].stands] == ["B8", "B5", "B2"]
    assert rows[1].stands == [] and rows[2].density is None and not rows[2].anomaly_active
    totals = heatmap.totals(heat).first()
    assert (totals.total_zones, totals.total_stands, totals.critical_zones) == (3, 4, ["Gate-North"])


def test_order_checks_and_total(spark):
    items = [("Nachos", 2, 8.50), ("Cola", 1, 3.25)]
    many = [("Nachos", 21, 8.50)]
    negative = [("Nachos", 1, -0.01)]
    rows = [
        ("D-14", "c4", items, None), ("D-14", "ZZ99", items, None), ("D-14", "C4", [], None), ("D-14", "C4", many, None),
        ("D-14", "C4", negative, None), ("D-14", "C4", items, "x" * 201), ("D-14", "C4", items, "x" * 200),
    ]
    df = spark.createDataFrame(rows, "seat_id string, stand_id string, items array<struct<name:string,quantity:int,price:double>>, special_instructions string")
    got = [r.reasons for r in orders.checked(df).collect()]
    assert got == [[], ["stand not found"], ["no items"], ["quantity outside 1..20"], ["price below 0"], ["instructions too long"], []]
    assert df.select(orders.order_total(F.col("items")).alias("x")).first().x == 20.25


def test_routing_rooms(spark):
    import json

    def alert(**fields):
        return (venue.ALERTS_TOPIC, "k", json.dumps(fields))

    rows = [
        (venue.INTELLIGENCE_TOPIC, "flow:Gate-East", "{}"), (venue.INTELLIGENCE_TOPIC, "wait:C4", "{}"), (venue.INTELLIGENCE_TOPIC, "other", "{}"),
        alert(seat_id="D-14", zone="Gate-East"), alert(zone="Gate-East"), alert(stand_id="c4"), alert(stand_id="X1"), alert(),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, topic string, key string, value string")
    rooms = {}
    for r in alerts.route_messages(df).collect():
        rooms.setdefault(r.i, []).append(r.room)
    assert [sorted(rooms[i]) for i in range(len(rows))] == [
        ["ops", "zone:Gate-East"], ["ops"], ["ops"], ["fan:D-14", "ops"], ["ops", "zone:Gate-East"], ["ops", "zone:Concourse-A"], ["ops"], ["ops"],
    ]


def test_valid_flag(spark):
    import json

    full = {"severity": "warning", "category": "queue", "message": "m", "timestamp": "now", "zone": "Gate-East"}
    flow = {
        "zone": "Gate-East", "current_density": 0.1, "predicted_density": 0.1, "congestion_risk": "low",
        "recommended_route": "Gate-East → Concourse-A", "avoid_zones": [], "generated_at": "now",
    }
    rows = [
        (venue.ALERTS_TOPIC, "k", json.dumps(full)), (venue.ALERTS_TOPIC, "k", json.dumps({**full, "message": None})),
        (venue.INTELLIGENCE_TOPIC, "flow:Gate-East", json.dumps(flow)),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, topic string, key string, value string")
    valid = {r.i: r.valid for r in alerts.route_messages(df).collect()}
    assert valid == {0: True, 1: False, 2: False}


def test_resolution(spark):
    ids = [f"00000000-0000-0000-0000-00000000000{i}" for i in range(3)]
    found = spark.createDataFrame([(ids[0], False), (ids[1], True), (ids[2], False)], "alert_id string, resolved boolean")
    asked = spark.createDataFrame([("{" + ids[0] + "}",), (ids[1],), ("junk",)], "alert_id string")
    updated, outcomes = alerts.resolve(found, asked)
    assert {r.alert_id: r.resolved for r in updated.collect()} == {ids[0]: True, ids[1]: True, ids[2]: False}
    assert sorted(r.outcome for r in outcomes.collect()) == ["invalid_id", "not_found", "resolved"]


def test_messages_are_parsed_once_and_passed_on(spark):
    """Payloads of every kind, of the wrong types and of no JSON: rooms by what can be read, the text as it came."""
    full = '{"stand_id":"C4","stand_name":"x","predicted_wait_5min":1.5,"predicted_wait_10min":2,"halftime_spike_expected":false,"recommendation":"r","generated_at":"t"}'
    rows = [
        ("vf_intelligence_out", "wait:C4", full),
        ("vf_intelligence_out", "wait:C4", full.replace("1.5", '"many"')),
        ("vf_intelligence_out", "flow:Gate-East", "{oops"),
        ("vf_alerts", "k", '{"seat_id":"","zone":"Gate-East","severity":"warning","category":"c","message":"m","timestamp":"t","_type":"own","_routed_at":"then"}'),
        ("vf_alerts", "k", '{"stand_id":"c4","extra":{"a":[1,2]}}'),
        ("vf_alerts", "k", "[1]"),
        ("vf_alerts", "k", None),
    ]
    sent = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, topic string, key string, value string")
    told = alerts.route_messages(sent)
    got = {(r.n, r.room): (r.type, r.valid, r.value) for r in told.collect()}
    zone = "zone:" + next(s[2] for s in venue.STANDS if s[0] == "C4")
    assert {k: v[:2] for k, v in got.items()} == {
        (0, "ops"): ("wait_intelligence", True), (1, "ops"): ("wait_intelligence", False),
        (2, "zone:Gate-East"): ("flow_intelligence", False), (2, "ops"): ("flow_intelligence", False),
        (3, "zone:Gate-East"): ("own", True), (3, "ops"): ("own", True),
        (4, zone): ("alert", False), (4, "ops"): ("alert", False), (5, "ops"): ("alert", False), (6, "ops"): ("alert", False),
    }
    assert all(v[2] == rows[n][2] for (n, _), v in got.items())
    assert {r.routed_at for r in told.where("n = 3").collect()} == {"then"}
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") + plan.count("parse_json") == 1 and "from_json" not in plan and "get_json_object" not in plan


def test_repeated_resolutions(spark):
    """Of requests for one alert the first of the order resolves it; alerts are never doubled."""
    ids = [f"00000000-0000-0000-0000-00000000000{i}" for i in range(2)]
    found = spark.createDataFrame([(ids[0], False), (ids[1], None)], "alert_id string, resolved boolean")
    rows = [(ids[0], 2, "late"), ("{" + ids[0] + "}", 1, "first"), (ids[1], None, "no place"), (ids[1], 5, "after"), (None, 3, "none")]
    asked = spark.createDataFrame(rows, "alert_id string, at int, name string")
    updated, outcomes = alerts.resolve(found, asked, "at")
    assert sorted((r.alert_id, r.resolved) for r in updated.collect()) == [(ids[0], True), (ids[1], True)]
    got = {r.name: r.outcome for r in outcomes.collect()}
    assert got == {"late": "not_found", "first": "resolved", "no place": "resolved", "after": "not_found", "none": "invalid_id"}
    _, at_once = alerts.resolve(found, asked)
    assert {r.outcome for r in at_once.where("name != 'none'").collect()} == {"resolved"}


def test_history_argument(spark):
    with pytest.raises(ValueError):
        rollup.history(None, "zone", "Gate-North", t(0), 4)


def test_latency_report(spark):
    rows = [("a", float(i)) for i in range(101)] + [("b", 5.0), ("b", 6.0)] + [("c", 1.0)] + [(None, 2.0), (None, 4.0), ("c", None)]
    df = spark.createDataFrame(rows, "route string, ms double")
    for most in (1_000_000, 10):
        got = {r.route: (r.p50, round(r.p95, 9), round(r.p99, 9)) for r in rollup.latency_report(df, "ms", ["route"], most).collect()}
        assert got == {"a": (50.0, 95.0, 99.0), "b": (5.5, 5.95, 5.99), "c": (1.0, 1.0, 1.0), None: (3.0, 3.9, 3.98)}
    assert rollup.latency_report(df.limit(0), "ms", ["route"]).collect() == []
    assert rollup.latency_report(df.where("route = 'a'"), "ms", []).first().p50 == 50.0


def test_places_of_a_hot_group_are_found_by_narrowing(spark):
    """Two hundred thousand values with long series of equal ones, huge spreads and both signs: exact, and no whole sort."""
    i = F.col("id")
    value = (
        F.when(i % 3 == 0, F.lit(7.0))
        .when(i % 3 == 1, (F.xxhash64(i) % 1000) / 7.0)
        .otherwise(F.exp((F.xxhash64(i, F.lit(1)) % 600).cast("double")) * F.when(i % 2 == 0, 1).otherwise(-1))
    )
    df = spark.range(200_000).select(F.when(i % 50 == 0, "cold").otherwise("hot").alias("k"), value.alias("v")).cache()
    ranks = [0, 1, 500, 65_000, 66_000, 98_000, 130_000, 195_998, 195_999]
    asked = spark.createDataFrame([("hot", r) for r in ranks] + [("cold", 17)], "k string, rank long")
    found = {(r.k, r["rank"]): r.v for r in rollup.order_statistics(df, ["k"], asked, 300).collect()}
    order = {k: sorted(r.v for r in df.where(F.col("k") == k).collect()) for k in ("hot", "cold")}
    assert len(order["hot"]) == 196_000
    assert found == {("hot", r): order["hot"][r] for r in ranks} | {("cold", 17): order["cold"][17]}
