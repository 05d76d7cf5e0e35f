import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framedrift.operators import rowwise
from framedrift.operators.statistics import run_counts
from framedrift.plans.job import run_captures, run_directory
from framedrift.plans.perturb import perturb
from framedrift.plans.plan import read_plan, register_row_step, register_step
from framedrift.sources import discovery
from tests import build


def vary(frame, mark="!"):
    """By the first byte: d drops, l gives a list, e an empty one, others get a byte more."""
    if frame[:1] == b"d":
        return None
    if frame[:1] == b"l":
        return [frame, frame + mark.encode(), b"short"]
    return [] if frame[:1] == b"e" else frame + mark.encode()


def vary_batch(frames, mark="!"):
    out = [vary(f, mark) for f in frames.to_pylist()]
    return pa.array([None if o is None else [o] if isinstance(o, bytes) else o for o in out], pa.list_(pa.binary()))


def packets(spark, frames, capture="a"):
    rows = [(capture, i, 1_000_000 + 10 * i, len(f), len(f), bytearray(f), 1) for i, f in enumerate(frames)]
    return spark.createDataFrame(rows, "capture_id string, packet_no long, ts_us long, incl_len int, orig_len long, frame binary, linktype int")


FRAMES = [b"d0", b"l1", b"e2", b"x3", b"d4", b"l5", b"x6"]
GIVEN = [b"l1", b"l1!", b"short", b"e2", b"x3!", b"l5", b"l5!", b"short", b"x6!"]


@pytest.mark.parametrize("batched", [False, True])
def test_drop_keep_and_multiply(spark, batched):
    register_row_step("vary", vary_batch if batched else vary, batched)
    plan = read_plan([{"type": "VARY", "pct": 1}])
    rows = perturb(packets(spark, FRAMES), plan, 1, 4).orderBy("packet_no", "copy_no").collect()
    assert [bytes(r.frame) for r in rows] == GIVEN
    assert [r.copy_no for r in rows] == [0, 1, 2, 0, 0, 0, 1, 2, 0]
    assert [r.ts_new_us - 1_000_000 for r in rows] == [10, 10, 10, 20, 30, 50, 50, 50, 60]
    assert [r.orig_len for r in rows] == [len(f) for f in GIVEN] and {r.applied for r in rows} == {1}
    assert "_closed" not in rows[0] and perturb(packets(spark, FRAMES), read_plan([{"type": "vary", "pct": 0}]), 1, 4).count() == 7


def test_functions_and_names_are_checked(spark):
    register_row_step("short", lambda frames: frames[:1], True)
    with pytest.raises(Exception, match="1 lists for 7 frames"):
        perturb(packets(spark, FRAMES).coalesce(1), read_plan([{"type": "short", "pct": 1}]), 1, 9).collect()
    with pytest.raises(ValueError):
        register_row_step("reorder", vary)
    register_step("vary", lambda df, step, seed: df.limit(0))
    assert perturb(packets(spark, FRAMES), read_plan([{"type": "vary", "pct": 1}]), 1, 9).count() == 0
    register_row_step("vary", vary)
    assert perturb(packets(spark, FRAMES), read_plan([{"type": "vary", "pct": 1}]), 1, 9).count() == 9


def test_order_of_content_steps(spark):
    """What a list gives is not edited again; other packets are, whatever the order of steps."""
    register_row_step("vary", vary)
    register_row_step("mark", lambda frame, with_: frame + with_.encode())
    raw = [{"type": "mark", "pct": 1, "params": {"with_": "1"}}, {"type": "vary", "pct": 1, "params": {"mark": "#"}}, {"type": "mark", "pct": 1, "params": {"with_": "2"}}]
    rows = perturb(packets(spark, FRAMES), read_plan(raw), 1, 4).orderBy("packet_no", "copy_no").collect()
    assert [bytes(r.frame) for r in rows] == [b"l11", b"l11#", b"short", b"e21", b"x31#2", b"l51", b"l51#", b"short", b"x61#2"]
    reverted = perturb(packets(spark, FRAMES), read_plan(raw), 1, 4, on_length_change="revert").orderBy("packet_no", "copy_no").collect()
    # Single frames that changed their length are as they were; those of a list are not looked at.
    assert [bytes(r.frame) for r in reverted] == [b"l11", b"l11#", b"short", b"e21", b"x3", b"l51", b"l51#", b"short", b"x6"]


def test_sampling_copies_and_statistics(spark):
    register_row_step("vary", vary)
    frames = [bytes([c]) + str(i).encode() for i, c in enumerate(b"dlx" * 200)]
    raw = [{"type": "loss", "pct": 0.2}, {"type": "retransmit", "pct": 0.3}, {"type": "reorder", "pct": 0.5}, {"type": "vary", "pct": 0.5}, {"type": "loss", "pct": 0.1}]
    plan = read_plan(raw)
    plain = perturb(packets(spark, frames), read_plan([*raw[:3], {"type": "loss", "pct": 0}, raw[4]]), 5, 50)
    tracked = perturb(packets(spark, frames), plan, 5, 50, track=True)
    alive = {(r.packet_no, r.copy_no): r for r in tracked.where("lost_at is null").collect()}
    assert set(alive) == {(r.packet_no, r.copy_no) for r in perturb(packets(spark, frames), plan, 5, 50).collect()}
    times = {(r.packet_no, r.copy_no): r.ts_new_us for r in plain.collect()}
    for (number, copy), r in alive.items():
        assert r.ts_new_us == times[number, copy & 1]  # nothing else moves
    dropped = tracked.where("lost_at = 3").collect()
    assert dropped and all(r.frame is None and r.pos is None and r.ts_new_us is None and frames[r.packet_no][:1] == b"d" for r in dropped)
    hit = sum(bool(r.applied & 8) for r in alive.values())
    counts = run_counts(tracked, plan).first()
    assert counts.total_out == len(alive) and counts.total_in == 600 and counts.step_3 == hit + len(dropped)
    assert len(alive) + len(dropped) == len(times) + sum(c > 1 for _, c in alive)


def test_job_writes_what_the_function_gives(spark, tmp_path):
    register_row_step("vary", vary)
    (tmp_path / "in").mkdir()
    frames = FRAMES * 30
    (tmp_path / "in/capA").write_bytes(build.pcap([(1_000_000 + 10 * i, f) for i, f in enumerate(frames)]))
    plan = read_plan([{"type": "vary", "pct": 1}])
    runs = run_directory(spark, str(tmp_path / "in"), str(tmp_path / "out"), plan, chunk_size=20, chunks_per_part=2).collect()
    assert [(r.status, r.total_in, r.total_out, r.parts) for r in runs] == [("done", 210, 270, 6)]
    got = build.read_pcap((tmp_path / "out/capA.pcap").read_bytes())
    assert [f for *_, f in got] == GIVEN * 30
    # The function must not see, nor drop, what carries the header of an empty capture.
    (tmp_path / "in/capE").write_bytes(build.pcap([]))
    run_captures(discovery.discover(spark, str(tmp_path / "in")), str(tmp_path / "out2"), plan)
    assert len((tmp_path / "out2/capE.pcap").read_bytes()) == 24


def test_table_function_in_sql(spark):
    df = packets(spark, FRAMES).withColumn("copy_no", F.lit(0).cast("long"))
    rowwise.register_table_function(spark, "vary_packets", df.schema, vary, {"mark": "?"})
    df.createOrReplaceTempView("some_packets")
    rows = spark.sql("SELECT * FROM vary_packets(TABLE(some_packets)) ORDER BY packet_no, copy_no").collect()
    assert [bytes(r.frame) for r in rows] == [f.replace(b"!", b"?") for f in GIVEN]


def test_no_shuffle_beside_the_one(spark):
    register_row_step("vary", vary)
    df = perturb(packets(spark, FRAMES), read_plan([{"type": "reorder", "pct": 0.5}, {"type": "vary", "pct": 1}]), 1, 4)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "ArrowEvalPythonUDTF" in text
