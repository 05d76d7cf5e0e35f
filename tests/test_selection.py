import json
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framedrift.functions.draws import row_draw
from framedrift.operators import selection
from framedrift.operators.retime import number_positions, retime
from framedrift.operators.statistics import run_counts, selected_counts
from framedrift.plans.perturb import perturb
from framedrift.plans.plan import load_plan, read_plan, register_step

SCHEMA = "capture_id string, packet_no long, ts_us long, orig_len long, frame binary, linktype int"


def packets(spark, sizes, times=None, partitions=4):
    data = [
        (name, i, times[i] if times else i * 1000, 3, bytearray(f"{i:03}", "ascii"), 1)
        for name, n in sizes.items()
        for i in range(n)
    ]
    return spark.createDataFrame(data, SCHEMA).repartition(partitions)


def ordered(df, *columns):
    rows = df.filter("lost_at is null").orderBy("capture_id", "chunk_id", "pos", "copy_no")
    return [tuple(r) for r in rows.select(*columns).collect()]


PLAN = [
    {"type": "LOSS", "pct": 0.2},
    {"type": "retrans", "pct": 0.3},
    {"type": "jitter", "pct": 0.8, "params": {"m": 4}},
    {"type": "retransmit", "pct": 0.2},
    {"type": "loss", "pct": 0.1},
    {"type": "rate_modify"},
]


@pytest.mark.parametrize("method", ["blocks", "greedy"])
def test_same_rows_under_any_partitioning(spark, method):
    results = []
    for partitions in (1, 8, 64):
        df = perturb(packets(spark, {"a": 230, "b": 7}, partitions=partitions), read_plan(PLAN), 7, 50,
                     chunks_per_part=2, reorder_method=method)
        results.append(ordered(df, "capture_id", "packet_no", "copy_no", "ts_new_us", "applied"))
    assert results[0] == results[1] == results[2]
    keys = [(c, p, k) for c, p, k, *_ in results[0]]
    assert len(set(keys)) == len(keys), "copies are told apart"


def test_tracking_changes_no_output(spark):
    source = packets(spark, {"a": 230, "b": 7, "c": 1})
    plain = perturb(source, read_plan(PLAN), 7, 50)
    tracked = perturb(source, read_plan(PLAN), 7, 50, track=True)
    columns = ["capture_id", "packet_no", "copy_no", "ts_new_us", "applied"]
    assert ordered(plain, *columns) == ordered(tracked, *columns)


def test_loss_share_and_seed(spark):
    df = selection.start_trace(packets(spark, {"a": 20_000}), 5000)
    kept = selection.lose(df, 0.3, 1, 0)
    n = kept.count()
    assert abs(n - 14_000) < 5 * math.sqrt(20_000 * 0.21)
    assert kept.join(selection.lose(df, 0.3, 2, 0), "packet_no", "left_semi").count() != n
    assert selection.lose(df, 0.0, 1, 0).count() == 20_000
    assert selection.lose(df, 1.0, 1, 0).count() == 0


def test_copies_go_to_the_end_of_their_chunk(spark):
    df = perturb(packets(spark, {"a": 25}), read_plan([{"type": "retransmit", "pct": 0.5}] * 2), 3, 10)
    rows = ordered(df, "chunk_id", "packet_no", "copy_no")
    for chunk in range(3):
        mine = [(p, c) for k, p, c in rows if k == chunk]
        firsts = [p for p, c in mine if c == 0]
        assert firsts == list(range(chunk * 10, min(25, chunk * 10 + 10)))
        assert mine[: len(firsts)] == [(p, 0) for p in firsts]
        later = [p for p, c in mine if c & 2]
        second_round_source = [(p, c) for p, c in mine if not c & 2]
        assert mine == second_round_source + [(p, c) for p, c in mine if c & 2]
        assert later == [p for p, c in second_round_source if (p, c | 2) in mine]


def test_adjacent_copies(spark):
    df = selection.start_trace(packets(spark, {"a": 25}), 10)
    df = selection.retransmit(df, 0.5, 3, 0, 10, placement="adjacent")
    rows = ordered(df, "packet_no", "copy_no")
    assert [p for p, c in rows if c == 0] == list(range(25))
    assert all(rows[i - 1] == (p, 0) for i, (p, c) in enumerate(rows) if c == 1)
    assert any(c for _, c in rows)
    with pytest.raises(ValueError):
        selection.retransmit(df, 0.5, 3, 0, 10, placement="middle")


def test_rate_modify_against_the_rule(spark):
    for n in (0, 1, 2, 3, 4, 7, 8, 11):
        if n == 0:
            continue
        df = selection.rate_modify(selection.start_trace(packets(spark, {"a": n}), 100), 1.0, 0, 0)
        expected = []
        for i in range(n):
            expected.append(i)
            if i % 4 == 2:
                expected.append(i - 1)
        assert [p for (p,) in ordered(df, "packet_no")] == expected


@pytest.mark.parametrize("method", ["blocks", "greedy"])
@pytest.mark.parametrize("m", [2, 5])
def test_reorder_is_a_bounded_permutation(spark, method, m):
    source = packets(spark, {"a": 103, "b": 2, "c": 3, "d": 1})
    df = selection.start_trace(source, 20)
    df = selection.reorder(df, 1.0, m, 5, 0, method)
    rows = ordered(df, "capture_id", "chunk_id", "packet_no", "pos", "applied")
    moved = 0
    for capture, chunk in {(r[0], r[1]) for r in rows}:
        mine = [r for r in rows if r[:2] == (capture, chunk)]
        numbers = [r[2] for r in mine]
        assert sorted(numbers) == list(range(chunk * 20, chunk * 20 + len(numbers)))
        assert [r[3] for r in mine] == list(range(len(mine)))
        for place, (_, _, number, _, applied) in enumerate(mine):
            assert abs(number - chunk * 20 - place) < m
            if number - chunk * 20 != place:
                assert applied == 1
                moved += 1
        if len(mine) <= 2:
            assert numbers == sorted(numbers) and not any(r[4] for r in mine)
    assert moved > 10
    with pytest.raises(ValueError):
        selection.reorder(df, 0.5, 1, 0, 0)
    with pytest.raises(ValueError):
        selection.reorder(df, 0.5, 3, 0, 0, "other")


@pytest.mark.parametrize("m,pct,share", [(2, 0.2, 0.331), (5, 0.1, 0.281), (5, 1.0, 0.792), (10, 0.5, 0.697)])
def test_greedy_reorder_covers_the_published_share(spark, m, pct, share):
    df = selection.start_trace(packets(spark, {"a": 40_000}), 5000)
    moved = selection.reorder(df, pct, m, 1, 0, "greedy").filter("applied = 1").count()
    assert abs(moved / 40_000 - share) < 0.012


@pytest.mark.parametrize("m,dense", [(2, 1.0), (4, 0.7), (9, 1.0), (30, 0.4)])
def test_segments_stand_as_if_tried_one_by_one(spark, m, dense):
    draw = random.Random(m)
    tries = {}
    for chunk in range(12):
        n = draw.choice([3, 40, 200])
        tries[chunk] = [(i, min(i + draw.randint(2, m), n), draw.randint(0, 50)) for i in range(n) if draw.random() < dense]  # with ties
    rows = [("c", 0, c, s, s, e, p) for c, found in tries.items() for s, e, p in found]
    df = spark.createDataFrame(rows, "capture_id string, part_id long, chunk_id long, pos long, start long, stop long, priority long")
    got = {}
    for r in selection.disjoint_segments(df.repartition(3), m).collect():
        got.setdefault(r.chunk_id, []).append((r.start, r.stop))
    for chunk, found in tries.items():
        standing = []
        for start, stop, _ in sorted(found, key=lambda x: (x[2], x[0])):
            if all(start >= b or stop <= a for a, b in standing):
                standing.append((start, stop))
        assert sorted(got.get(chunk, [])) == sorted(standing)


def test_greedy_reorder_keeps_lost_rows_and_frames_out_of_python(spark):
    source = packets(spark, {"a": 200}).withColumn("frame", F.encode(F.col("packet_no").cast("string"), "UTF-8"))
    df = selection.lose(selection.start_trace(source, 50, track=True), 0.3, 1, 0, track=True)
    done = selection.reorder(df, 0.8, 4, 1, 1, "greedy")
    assert done.columns == df.columns and done.count() == 200
    assert done.filter("lost_at is not null and pos is not null").count() == 0
    kept = done.filter("lost_at is null")
    assert kept.filter("cast(decode(frame, 'UTF-8') as long) <> packet_no").count() == 0
    places = kept.groupBy("chunk_id").agg(F.count("*").alias("n"), F.max("pos").alias("last"), F.countDistinct("pos").alias("places"))
    assert places.filter("n <> places or last <> n - 1").count() == 0
    text = done._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in text and "Python" not in text and text.count("Exchange hashpartitioning") == 1


def slow_retime(times):
    out = []
    for i, t in enumerate(times):
        if i == 0:
            out.append(t)
        else:
            step = t - times[i - 1]
            out.append(out[-1] + step if step > 0 else out[-1] + 1)
    return out


def test_retiming(spark):
    draw = random.Random(8)
    times = [draw.choice([5, 5, 999_999, 1_000_000, 1_000_001, 3_999_999]) for _ in range(97)]
    df = retime(selection.start_trace(packets(spark, {"a": 97, "b": 1}, times), 10))
    got = ordered(number_positions(df), "capture_id", "chunk_id", "out_no", "ts_new_us")
    for chunk in range(10):
        mine = [r[3] for r in got if r[:2] == ("a", chunk)]
        assert mine == slow_retime(times[chunk * 10 : chunk * 10 + 10])
        assert [r[2] for r in got if r[:2] == ("a", chunk)] == list(range(len(mine)))
    assert [r[3] for r in got if r[0] == "b"] == times[:1]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 11])
def test_chunk_edges(spark, n):
    plan = [{"type": "reorder", "pct": 1.0}, {"type": "loss", "pct": 0.0}]
    rows = ordered(perturb(packets(spark, {"a": n}), read_plan(plan), 1, 10), "packet_no", "ts_new_us")
    assert sorted(p for p, _ in rows) == list(range(n))


@pytest.mark.parametrize("percent", [0, 0.3, 10, 12.5, 50, 100])
def test_exact_sample_is_the_smallest_draws(spark, percent):
    source = packets(spark, {"a": 1000, "b": 20, "c": 1}).withColumn("copy_no", F.lit(0))
    flagged = selection.flag_exact(source, percent, 4)
    got = flagged.select("capture_id", "packet_no", "selected", row_draw(4, 0).alias("d")).collect()
    for capture, n in {"a": 1000, "b": 20, "c": 1}.items():
        mine = sorted((r.d, r.packet_no, r.selected) for r in got if r.capture_id == capture)
        k = round(n * percent / 100)
        assert [s for *_, s in mine] == [True] * k + [False] * (n - k)
    counted = {r.capture_id: (r.total, r.perturbed) for r in selected_counts(flagged).collect()}
    assert counted["a"] == (1000, round(10 * percent))


def test_bernoulli_and_chosen(spark):
    source = packets(spark, {"a": 10_000}).withColumn("copy_no", F.lit(0))
    n = selection.flag_bernoulli(source, 12.5, 3).filter("selected").count()
    assert abs(n - 1250) < 5 * math.sqrt(10_000 * 0.125 * 0.875)
    chosen = source.filter("packet_no % 1000 = 7").select("capture_id", "packet_no")
    assert selection.keep_chosen(source, chosen).count() == 10
    assert selection.count_packets(source).first().packets == 10_000


def test_counts(spark):
    plan = read_plan(PLAN)
    source = packets(spark, {"a": 230, "b": 40})
    trace = perturb(source, plan, 7, 50, track=True)
    counts = {r.capture_id: r for r in run_counts(trace, plan).collect()}
    for capture, n in (("a", 230), ("b", 40)):
        row = counts[capture]
        out = trace.filter(F.col("capture_id") == capture).filter("lost_at is null").count()
        assert (row.total_in, row.total_out) == (n, out)
        assert row.loss_drop == row.step_0 + row.step_4 > 0
        assert row.retransmit_dup == row.step_1 + row.step_3
        assert row.reorder_packets == row.step_2
        assert out == n - row.loss_drop + row.retransmit_dup + row.step_5
    first = selection.start_trace(source, 50)
    dropped = 230 - selection.lose(first, 0.2, 7, 0).filter("capture_id = 'a'").count()
    assert counts["a"].step_0 == dropped


def test_content_steps_in_a_plan(spark):
    from tests import build

    frame = build.ether(0x800, build.ipv4(6, build.tcp(5, b"0123456789")))
    source = packets(spark, {"a": 400}).withColumn("frame", F.lit(frame)).withColumn(
        "orig_len", F.lit(900).cast("long")
    )
    raw = [
        {"type": "seq_offset", "pct": 0.5, "params": {"offset": 7}},
        {"type": "loss", "pct": 0.1},
        {"type": "retransmit", "pct": 0.5},
        {"type": "length_forge", "pct": 0.5, "params": {"new_len": 12, "pad_byte": "aa"}},
    ]
    plan = read_plan(raw)
    results = {}
    for mode in ("keep", "revert"):
        df = perturb(source, plan, 2, 100, on_length_change=mode, track=True)
        results[mode] = run_counts(df, plan).first()
        for r in df.filter("lost_at is null").select("frame", "applied", "orig_len").collect():
            got, forged = bytes(r.frame), r.applied & 8
            assert build.checksums_hold(got)
            assert (got[38:42] == b"\0\0\0\x0c") == bool(r.applied & 1)
            assert len(got) == len(frame) + (2 if forged else 0)
            assert r.orig_len == (len(got) if forged else 900)
            if forged:
                assert mode == "keep" and got[-2:] == b"\xaa\xaa"
    assert results["keep"].step_3 > 100 and results["revert"].step_3 == 0
    assert results["keep"].total_out == results["revert"].total_out
    assert results["revert"].step_0 < results["keep"].step_0
    copies = perturb(source, plan, 2, 100).groupBy("packet_no").agg(
        F.count("*").alias("n"), F.countDistinct(F.col("applied").bitwiseAND(1)).alias("kinds")
    )
    assert copies.filter("n = 2 and kinds = 2").count() > 20, "each copy draws for itself"


def test_custom_step(spark):
    def every_other(df, step, seed):
        return df.filter(F.col("packet_no") % step.params["of"] == 0)

    register_step("thin", every_other)
    plan = read_plan([{"type": "thin", "pct": 1, "params": {"of": 2}}, {"type": "loss", "pct": 0.0}])
    assert perturb(packets(spark, {"a": 30}), plan, 0, 10).count() == 15
    with pytest.raises(ValueError):
        register_step("loss", every_other)


def test_one_shuffle_serves_all_windows(spark):
    plan = load_plan(json.dumps(PLAN[:3] + [{"type": "seq_offset", "pct": 0.5}]))
    df = perturb(packets(spark, {"a": 30}).coalesce(1), plan, 0, 10)
    df = df.sortWithinPartitions("capture_id", "part_id", "chunk_id", F.col("pos").asc_nulls_last())
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1, text
    assert isinstance(df.schema, T.StructType)
