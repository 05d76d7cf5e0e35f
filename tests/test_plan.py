import pytest

from framedrift.plans import plan


def test_names_defaults_and_aliases():
    steps = plan.read_plan(
        [
            {"type": "Loss", "pct": 0.1},
            {"type": "retrans", "pct": "0.2", "params": None},
            {"type": "jitter", "pct": 1},
            {"type": "seq_offset", "pct": 0.5, "params": {}},
            {"type": "length_forge", "pct": 0.5, "params": {"new_len": 0, "pad_byte": "zz"}},
            {"type": "rate_modify", "params": {"delay_sec": 0.05}},
        ]
    )
    assert [s.type for s in steps] == [
        "loss", "retransmit", "reorder", "seq_offset", "length_forge", "rate_modify",
    ]
    assert [s.number for s in steps] == list(range(6))
    assert steps[2].params == {"m": 5} and steps[3].params == {"offset": 1000}
    assert steps[4].params == {"new_len": None, "pad": b"\0"}
    assert steps[5].pct == 1.0
    assert plan.load_plan(plan.plan_text(steps[:3])) == steps[:3]


@pytest.mark.parametrize(
    "bad",
    [
        [],
        [{"type": "unheard of", "pct": 0.1}],
        [{"type": "loss", "pct": 1.5}],
        [{"type": "loss", "pct": -0.1}],
        [{"type": "reorder", "pct": 0.1, "params": {"m": 1}}],
    ],
)
def test_bad_plans(bad):
    with pytest.raises(ValueError):
        plan.read_plan(bad)


def test_quick_flags_keep_their_order():
    steps = plan.plan_from_flags(length_forge="0.01:512", loss=0.0, seq_offset="0.02:500", retransmit=0.3)
    assert [(s.type, s.pct) for s in steps] == [
        ("loss", 0.0), ("retransmit", 0.3), ("seq_offset", 0.02), ("length_forge", 0.01),
    ]
    assert steps[2].params == {"offset": 500} and steps[3].params["new_len"] == 512
    with pytest.raises(ValueError):
        plan.plan_from_flags()


def test_pad_bytes():
    assert plan.parse_hex_pad("aa") == b"\xaa" and plan.parse_hex_pad(b"\x01") == b"\x01"
    assert plan.parse_hex_pad("aabb") == plan.parse_hex_pad("x") == plan.parse_hex_pad(None) == b"\0"
    cases = {"0x0f": 15, "15": 15, "0F": 15, " 0xFF ": 255, "ff": 255, "10": 10, "0": 0}
    for text, value in cases.items():
        assert plan.parse_pad_argument(text) == bytes([value])
    for text in ("256", "0x100", "-1", "zz", ""):
        with pytest.raises(ValueError):
            plan.parse_pad_argument(text)
    assert plan.check_percent(100) == 100.0
    for value in (-1, 100.1, float("nan")):
        with pytest.raises(ValueError):
            plan.check_percent(value)


def test_quick_flags_say_what_they_take():
    for flags in ({"seq_offset": "0.1"}, {"loss": "0.1:5"}, {"length_forge": "0.1:x"}, {"loss": "many"}):
        with pytest.raises(ValueError, match="takes pct"):
            plan.plan_from_flags(**flags)


def test_reorder_method_of_a_plan():
    steps = plan.read_plan([{"type": "reorder", "pct": 0.1, "params": {"method": "greedy"}}])
    assert steps[0].params == {"m": 5, "method": "greedy"}
    with pytest.raises(ValueError, match="method"):
        plan.read_plan([{"type": "reorder", "pct": 0.1, "params": {"method": "sort"}}])


def test_plans_of_any_length(spark):
    from pyspark.sql import functions as F

    from framedrift.operators.statistics import run_counts
    from framedrift.plans.perturb import perturb

    df = spark.range(40).select(F.lit("a").alias("capture_id"), F.col("id").alias("packet_no"), (F.col("id") * 10).alias("ts_us"), F.lit(1).alias("linktype"))
    raw = [{"type": "loss", "pct": 0.02} for _ in range(70)]
    raw[65] = {"type": "retransmit", "pct": 0.5}
    steps = plan.read_plan(raw)
    tracked = perturb(df, steps, 3, 10, track=True)
    counts = run_counts(tracked, steps).first()
    lost = tracked.filter("lost_at is not null").collect()
    assert counts.loss_drop == len(lost) > 5 and all(r.applied[-1] == r.lost_at for r in lost) and any(r.lost_at > 62 for r in lost)
    assert counts.step_65 == tracked.filter(F.array_contains("applied", 65)).count() == counts.retransmit_dup > 3
    # The same draws as in a short plan: each step's own.
    short = perturb(df, plan.read_plan(raw[:60]), 3, 10).select("packet_no").collect()
    assert {r.packet_no for r in perturb(df, steps, 3, 10).select("packet_no").collect()} <= {r.packet_no for r in short}


def test_copying_steps_without_end(spark):
    from pyspark.sql import functions as F

    from framedrift.plans.perturb import perturb

    df = spark.range(3).select(F.lit("a").alias("capture_id"), F.col("id").alias("packet_no"), (F.col("id") * 10).alias("ts_us"), F.lit(1).alias("linktype"))
    raw = [{"type": "retransmit", "pct": 1.0 if i in (0, 30, 65) else 0.0} for i in range(66)]
    rows = perturb(df, plan.read_plan(raw), 3, 10).orderBy("pos").collect()
    assert [r.packet_no for r in rows] == [0, 1, 2] * 8 and len({(r.packet_no, r.copy_no) for r in rows}) == 24
    assert [r.ts_new_us for r in rows] == sorted({r.ts_new_us for r in rows})
    plan.register_row_step("twice", lambda frame: [frame, frame])
    df = df.withColumn("frame", F.encode(F.col("packet_no").cast("string"), "UTF-8")).withColumn("orig_len", F.lit(1).cast("long"))
    listed = perturb(df, plan.read_plan([*raw, {"type": "twice", "pct": 1}]), 3, 10)
    assert listed.count() == listed.select("packet_no", "copy_no").distinct().count() == 48
