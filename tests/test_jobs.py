import json
import random

import pytest
from pyspark.sql import functions as F

from framedrift import __main__ as command
from framedrift.operators import selection
from framedrift.plans.fixed_length import force_length
from framedrift.plans.job import run_captures, run_directory, run_fixed_length, summary
from framedrift.plans.perturb import perturb
from framedrift.plans.plan import load_plan, read_plan, register_step
from framedrift.sources import discovery
from framedrift.sources.packets import read_packets
from framedrift.streaming.arrivals import perturb_arrivals
from tests import build

PLAN = read_plan(
    [
        {"type": "loss", "pct": 0.2},
        {"type": "retransmit", "pct": 0.3},
        {"type": "reorder", "pct": 0.8, "params": {"m": 4}},
    ]
)
NOTHING = read_plan([{"type": "loss", "pct": 0.0}])


def put(root, name, data):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def some_packets(n, seed=1):
    draw = random.Random(seed)
    return [(1_600_000_000_000_000 + i * 1000, draw.randbytes(draw.randint(1, 90))) for i in range(n)]


@pytest.fixture()
def tree(tmp_path):
    put(tmp_path / "in", "d1/capA", build.pcap(some_packets(230), ">", linktype=101))
    put(tmp_path / "in", "d1/sub/capB.x", build.pcap(some_packets(40, 2), nanos=True))
    put(tmp_path / "in", "d2/capEmpty", build.pcap([], linktype=113))
    put(tmp_path / "in", "d2/capJunk", b"this is no capture at all")
    put(tmp_path / "in", "d2/capShort", build.pcap([])[:20])
    put(tmp_path / "in", "d2/encrypted_pcaps/capC", build.pcap(some_packets(3)))
    return tmp_path


def test_round_trip_of_one_and_several_parts(spark, tree):
    runs = run_directory(spark, str(tree / "in"), str(tree / "out"), NOTHING, chunk_size=20, chunks_per_part=3)
    by_id = {r.capture_id: r for r in runs.collect()}
    assert by_id["d1/capA"].parts == 4 and by_id["d1/sub/capB.x"].parts == 1
    got = build.read_pcap((tree / "out/d1/capA.pcap").read_bytes())
    assert [(t, f) for t, _, _, f in got] == some_packets(230)
    assert (tree / "out/d1/capA.pcap").read_bytes()[16:24] == b"\xff\xff\0\0\x65\0\0\0"
    got = build.read_pcap((tree / "out/d1/sub/capB.x.pcap").read_bytes())
    assert [(t, f) for t, _, _, f in got] == some_packets(40, 2)
    assert (tree / "out/d2/capEmpty.pcap").read_bytes()[20:24] == b"\x71\0\0\0"
    assert len((tree / "out/d2/capEmpty.pcap").read_bytes()) == 24
    assert len((tree / "out/d2/capShort.pcap").read_bytes()) == 24
    assert not (tree / "out/d2/capJunk.pcap").exists()
    assert by_id["d2/capJunk"].status == "error" and by_id["d2/capJunk"].error == "unknown capture format"
    assert by_id["d1/capA"].total_in == by_id["d1/capA"].total_out == 230
    assert by_id["d2/capEmpty"].status == "done" and by_id["d2/capEmpty"].total_in == 0
    assert set(by_id) == {"d1/capA", "d1/sub/capB.x", "d2/capEmpty", "d2/capJunk", "d2/capShort"}
    assert [json.loads(line)["capture_id"] for line in summary(runs)] == sorted(by_id)
    fragments = [p for p in (tree / "out").rglob("*") if p.is_file() and "_staging" in str(p) and "ledger" not in str(p)]
    assert fragments == []


def test_output_equals_the_trace(spark, tree):
    options = dict(seed=3, chunk_size=20, chunks_per_part=2)
    runs = run_directory(spark, str(tree / "in"), str(tree / "out"), PLAN, **options)
    captures = discovery.read_headers(discovery.discover(spark, str(tree / "in")))
    trace = perturb(read_packets(captures), PLAN, **options)
    rows = trace.filter("capture_id = 'd1/capA'").orderBy("chunk_id", "pos").collect()
    got = build.read_pcap((tree / "out/d1/capA.pcap").read_bytes())
    assert [(t, f) for t, _, _, f in got] == [(r.ts_new_us, bytes(r.frame)) for r in rows]
    run = runs.filter("capture_id = 'd1/capA'").first()
    assert run.total_out == len(rows) == 230 - run.loss_drop + run.retransmit_dup
    assert run.loss_drop > 20 and run.reorder_packets > 50
    again = run_directory(spark, str(tree / "in"), str(tree / "out2"), PLAN, **(options | {"chunks_per_part": 50}))
    assert again.filter("capture_id = 'd1/capA'").first().parts == 1
    assert (tree / "out/d1/capA.pcap").read_bytes() == (tree / "out2/d1/capA.pcap").read_bytes()
    other = run_directory(spark, str(tree / "in"), str(tree / "out3"), PLAN, seed=4, chunk_size=20)
    assert other.count() == 5
    assert (tree / "out/d1/capA.pcap").read_bytes() != (tree / "out3/d1/capA.pcap").read_bytes()


def test_resume_and_clashes(spark, tree):
    first = run_directory(spark, str(tree / "in"), str(tree / "out"), NOTHING, limit=1, resume=True)
    assert [r.capture_id for r in first.collect()] == ["d1/capA"]
    stamp = (tree / "out/d1/capA.pcap").stat().st_mtime_ns
    second = run_directory(spark, str(tree / "in"), str(tree / "out"), NOTHING, resume=True)
    status = {r.capture_id: (r.status, r.reason) for r in second.collect()}
    assert status["d1/capA"] == ("skipped", "exists") and status["d1/sub/capB.x"] == ("done", None)
    assert (tree / "out/d1/capA.pcap").stat().st_mtime_ns == stamp
    put(tree / "in", "d1/other/capA", build.pcap([]))
    with pytest.raises(ValueError, match="capA.pcap"):
        run_directory(spark, str(tree / "in"), str(tree / "dated"), NOTHING, layout="date")


def test_repair_counts_in_the_ledger(spark, tmp_path):
    data = build.pcap([(1, b"one"), (2, b"", 0, 0), (3, b"three"), (4, b"cut off", 50, 50)])
    put(tmp_path / "in", "d/capA", data)
    run = run_directory(spark, str(tmp_path / "in"), str(tmp_path / "out"), NOTHING).first()
    assert (run.total_in, run.total_out, run.repaired_packets, run.discarded_records) == (3, 3, 1, 1)
    got = build.read_pcap((tmp_path / "out/d/capA.pcap").read_bytes())
    assert [f for *_, f in got] == [b"one", b"three", b"cut off"]


def test_content_steps_through_files(spark, tmp_path):
    frame = build.ether(0x800, build.ipv4(6, build.tcp(5, b"0123456789")))
    put(tmp_path / "in", "d/capA", build.pcap([(i, frame, len(frame), 500) for i in range(60)]))
    plan = read_plan(
        [{"type": "seq_offset", "pct": 1, "params": {"offset": 1}}, {"type": "length_forge", "pct": 0.5}]
    )
    run = run_directory(spark, str(tmp_path / "in"), str(tmp_path / "out"), plan, chunk_size=25).first()
    rows = build.read_pcap((tmp_path / "out/d/capA.pcap").read_bytes())
    assert len(rows) == 60 and run.step_0 == 60 and 10 < run.step_1 < 50
    longer = [r for r in rows if r[1] == len(frame) + 5]
    assert len(longer) == run.step_1 and all(r[2] == r[1] for r in longer)
    assert all(r[2] == 500 for r in rows if r[1] == len(frame))
    assert all(build.checksums_hold(r[3]) and r[3][38:42] == b"\0\0\0\6" for r in rows)


def test_fixed_length_job(spark, tree):
    captures = discovery.read_headers(discovery.discover(spark, str(tree / "in")))
    packets = read_packets(captures)
    forced = force_length(packets, 12.5, 40, b"\x0f", 9, exact=True)
    counts = {r.capture_id: r.n for r in forced.filter("selected").groupBy("capture_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {"d1/capA": round(230 * 0.125), "d1/sub/capB.x": 5}
    frames = {i: f for i, (_, f) in enumerate(some_packets(230))}
    for r in forced.filter("capture_id = 'd1/capA'").collect():
        before = frames[r.packet_no]
        assert bytes(r.frame) == ((before + b"\x0f" * 40)[:40] if r.selected else before)
    with pytest.raises(ValueError):
        force_length(packets, 101, 40)
    with pytest.raises(ValueError):
        force_length(packets, 10, -1)


def test_command_line(spark, tree, capsys):
    plan = tree / "plan.json"
    plan.write_text('[{"type": "loss", "pct": 0.05, "params": {}}]')
    roots = ["--in-root", str(tree / "in"), "--out-root", str(tree / "out")]
    command.main(["perturb", *roots, "--plan", str(plan), "--seed", "5", "--limit", "2"])
    lines = [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]
    assert [line["capture_id"] for line in lines] == ["d1/capA", "d1/sub/capB.x"]
    roots[-1] = str(tree / "fixed")
    command.main(["fix-length", *roots, "-n", "10", "-l", "30", "--pad", "15", "--exact"])
    lines = [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]
    assert {"capture_id": "d1/capA", "total": 230, "perturbed": 23} in lines
    rows = build.read_pcap((tree / "fixed/d1/capA.pcap").read_bytes())
    assert [t for t, *_ in rows] == [t for t, _ in some_packets(230)]
    with pytest.raises(SystemExit):
        command.arguments(["perturb", *roots])
    with pytest.raises(SystemExit):
        command.arguments(["perturb", *roots, "--loss", "0.1", "--plan", "x.json"])


def test_arriving_captures(spark, tmp_path):
    put(tmp_path / "in", "d/capA", build.pcap(some_packets(50)))
    arguments = (spark, str(tmp_path / "in"), str(tmp_path / "out"), NOTHING, str(tmp_path / "check"))
    perturb_arrivals(*arguments, chunk_size=20).awaitTermination()
    stamp = (tmp_path / "out/d/capA.pcap").stat().st_mtime_ns
    put(tmp_path / "in", "d/capB", build.pcap(some_packets(60, 4)))
    perturb_arrivals(*arguments, chunk_size=20).awaitTermination()
    assert (tmp_path / "out/d/capA.pcap").stat().st_mtime_ns == stamp
    got = build.read_pcap((tmp_path / "out/d/capB.pcap").read_bytes())
    assert [(t, f) for t, _, _, f in got] == some_packets(60, 4)


def test_ungathered_parts_are_refused(spark, tmp_path):
    from framedrift.sinks.captures import place_fragments, write_fragments

    data = [("c", i, i, 1, bytearray(b"x"), 1) for i in range(40)]
    df = spark.createDataFrame(data, "capture_id string, packet_no long, ts_us long, orig_len long, frame binary, linktype int")
    trace = selection.start_trace(df.repartition(4), 10).withColumn("ts_new_us", F.col("ts_us"))
    root = str(tmp_path)
    write_fragments(trace, f"{root}/_staging").write.parquet(f"{root}/ledger")
    outputs = discovery.with_output(discovery.with_names(df.select("capture_id").distinct()), root)
    with pytest.raises(RuntimeError, match="written twice"):
        place_fragments(spark.read.parquet(f"{root}/ledger"), outputs, f"{root}/_staging")
    assert load_plan('[{"type": "LOSS", "pct": 1}]')[0].type == "loss"


def test_custom_step_may_drop_the_first_part(spark, tree):
    register_step("drop_head", lambda df, step, seed: df.filter("packet_no >= 100"))
    plan = read_plan([{"type": "drop_head", "pct": 1.0}])
    runs = run_directory(spark, str(tree / "in"), str(tree / "out"), plan, chunk_size=20, chunks_per_part=2)
    by_id = {r.capture_id: r for r in runs.collect()}
    got = build.read_pcap((tree / "out/d1/capA.pcap").read_bytes())
    assert [(t, f) for t, _, _, f in got] == some_packets(230)[100:]
    assert len((tree / "out/d1/sub/capB.x.pcap").read_bytes()) == 24 and by_id["d1/sub/capB.x"].status == "done"


def test_greedy_reorder_in_the_job(spark, tree):
    """Many shuffle partitions that are not merged: parts must stay whole behind the Arrow step."""
    plan = read_plan([{"type": "reorder", "pct": 0.5, "params": {"m": 4, "method": "greedy"}}])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        runs = run_directory(spark, str(tree / "in"), str(tree / "out"), plan, seed=3, chunk_size=20, chunks_per_part=3)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.status for r in runs.collect() if r.capture_id != "d2/capJunk"} == {"done"}
    got = [f for _, _, _, f in build.read_pcap((tree / "out/d1/capA.pcap").read_bytes())]
    before = [f for _, f in some_packets(230)]
    assert sorted(got) == sorted(before) and got != before
    place = {f: i for i, f in enumerate(before)}
    assert all(abs(place[f] - i) < 4 for i, f in enumerate(got))


def test_fixed_length_job_keeps_every_capture(spark, tree):
    for exact in (True, False):
        out = tree / f"fixed{exact}"
        runs = run_fixed_length(discovery.discover(spark, str(tree / "in")), str(out), 10, 30, exact=exact)
        by_id = {r.capture_id: r for r in runs.collect()}
        assert by_id["d2/capJunk"].error == "unknown capture format" and not (out / "d2/capJunk.pcap").exists()
        assert by_id["d2/capEmpty"].status == "done" and len((out / "d2/capEmpty.pcap").read_bytes()) == 24
        assert by_id["d1/capA"].total == 230 and (by_id["d1/capA"].perturbed == 23 or not exact)
        got = build.read_pcap((out / "d1/capA.pcap").read_bytes())
        assert len(got) == 230 and sum(len(f) == 30 for _, _, _, f in got) >= by_id["d1/capA"].perturbed


def test_single_capture_of_any_name(spark, tree):
    put(tree, "one/dump.bin", build.pcap(some_packets(50)))
    runs = run_captures(discovery.single_capture(spark, str(tree / "one/dump.bin")), str(tree / "out"), NOTHING).collect()
    assert [(r.capture_id, r.status) for r in runs] == [("dump.bin", "done")]
    assert len(build.read_pcap((tree / "out/dump.bin.pcap").read_bytes())) == 50


def test_part_files(spark, tree):
    """Finished captures per part, which need no writing at an offset."""
    options = dict(chunk_size=20, chunks_per_part=3, part_files=True)
    runs = run_directory(spark, str(tree / "in"), str(tree / "out"), NOTHING, **options)
    assert {r.capture_id: r.parts for r in runs.collect()}["d1/capA"] == 4
    parts = sorted((tree / "out/d1").glob("capA.part-*.pcap"))
    assert [p.name for p in parts] == [f"capA.part-{i:05d}.pcap" for i in range(4)]
    assert [(t, f) for p in parts for t, _, _, f in build.read_pcap(p.read_bytes())] == some_packets(230)


def test_output_without_a_mount_is_refused_first(spark, tree):
    with pytest.raises(ValueError, match="part_files"):
        run_directory(spark, str(tree / "nowhere"), "hdfs://none:1/out", NOTHING)


def test_leftovers_of_a_longer_file_do_not_stay(tmp_path):
    from framedrift.sinks import captures

    (tmp_path / "fragment").write_bytes(b"hello")
    (tmp_path / "joined").write_bytes(b"x" * 100)
    row = {"fragment": str(tmp_path / "fragment"), "target": str(tmp_path / "joined"), "offset": 0, "size": 5}
    captures._start_joined(row)
    captures._join_part(row)
    assert (tmp_path / "joined").read_bytes() == b"hello"


def test_a_stopped_run_goes_on_at_its_unfinished_parts(spark, tmp_path):
    put(tmp_path / "in", "d/capA", build.pcap(some_packets(400)))
    put(tmp_path / "in", "d/capB", build.pcap(some_packets(50, 2)))
    marker = tmp_path / "stop"
    stopped = F.when((F.col("capture_id") == "d/capA") & (F.col("packet_no") >= 300), F.raise_error(F.lit("stopped"))).otherwise(F.lit(True))
    register_step("halt", lambda df, step, seed: df.filter(stopped) if marker.exists() else df)
    plan = read_plan([{"type": "loss", "pct": 0.2}, {"type": "reorder", "pct": 0.5}, {"type": "halt", "pct": 1}])
    options = {"seed": 4, "chunk_size": 20, "chunks_per_part": 2, "run_id": "one", "resume_parts": True}
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    expected = run_directory(spark, source, str(tmp_path / "plain"), plan, 0, **options | {"resume_parts": False}).orderBy("capture_id").collect()
    # Some parts get written: those of the run's first half.
    from framedrift.plans import job
    from framedrift.plans.plan import plan_text

    marker.touch()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        with pytest.raises(Exception, match="stopped"):
            run_directory(spark, source, out, plan, **options)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    staging = next((tmp_path / "out").glob("_staging-one-*"))
    notes = {p.name: json.loads(p.read_text()) for p in staging.rglob("*.finished.json")}
    marker.unlink()
    seen = {}
    place = job.place_fragments
    job.place_fragments = lambda ledger, *rest: seen.update({(r.capture_id, r.part_id): r.fragment for r in ledger.collect()}) or place(ledger, *rest)
    try:
        runs = run_directory(spark, source, out, plan, **options).orderBy("capture_id").collect()
    finally:
        job.place_fragments = place
    for note in notes.values():
        assert seen[note["capture_id"], note["part_id"]].rpartition("/")[2] in {n["fragment"].rpartition("/")[2] for n in notes.values()}
    assert sum(r.parts_kept for r in runs) == len({(n["capture_id"], n["part_id"]) for n in notes.values()})
    for name in ("d/capA.pcap", "d/capB.pcap"):
        assert (tmp_path / "out" / name).read_bytes() == (tmp_path / "plain" / name).read_bytes()
    for a, b in zip(runs, expected):
        assert (a.total_in, a.total_out, a.loss_drop, a.step_1, a.parts) == (b.total_in, b.total_out, b.loss_drop, b.step_1, b.parts)
    assert not list((tmp_path / "out").glob("_staging-*")) and plan_text(plan)


def test_parts_of_a_changed_capture_are_not_kept(spark, tmp_path):
    from framedrift.plans import job

    put(tmp_path / "in", "d/capA", build.pcap(some_packets(100)))
    plan = read_plan([{"type": "loss", "pct": 0.0}])
    options = {"chunk_size": 10, "chunks_per_part": 2, "run_id": "one", "resume_parts": True}
    place = job.place_fragments
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def fail(*_):
        raise RuntimeError("before placing")

    job.place_fragments = fail
    try:
        with pytest.raises(RuntimeError):
            run_directory(spark, source, out, plan, **options)
        staging = next((tmp_path / "out").glob("_staging-one-*"))
        assert len(list(staging.rglob("*.finished.json"))) == 5
        next(p for p in staging.rglob("parts/*/*") if not p.name.endswith("json")).unlink()  # a fragment that is gone
    finally:
        job.place_fragments = place
    kept = run_directory(spark, source, out, plan, **options).first()
    assert kept.parts_kept == 4 and kept.total_out == 100
    job.place_fragments = fail
    try:
        with pytest.raises(RuntimeError):
            run_directory(spark, source, out, plan, **options)
    finally:
        job.place_fragments = place
    put(tmp_path / "in", "d/capA", build.pcap(some_packets(130, 7)))
    row = run_directory(spark, source, out, plan, **options).first()
    assert row.parts_kept == 0 and row.total_out == 130
    assert [f for *_, f in build.read_pcap((tmp_path / "out/d/capA.pcap").read_bytes())] == [f for _, f in some_packets(130, 7)]
    with pytest.raises(ValueError, match="run_id"):
        run_directory(spark, source, out, plan, resume_parts=True)


def test_a_job_leaves_nothing_behind(spark, tree):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    import os

    before = set(os.listdir(folder))
    run_directory(spark, str(tree / "in"), str(tree / "out"), PLAN, chunk_size=20, split_bytes=500).collect()
    assert set(os.listdir(folder)) == before
    assert not [n for n in os.listdir(tree / "out") if n.startswith("_staging")]


def test_metadata_beside_each_output(spark, tree):
    runs = run_directory(spark, str(tree / "in"), str(tree / "out"), PLAN, chunk_size=20, metadata=True)
    held = json.loads((tree / "out/d1/capA.metadata.json").read_text())
    row = runs.filter("capture_id = 'd1/capA'").first()
    assert held["total_in"] == row.total_in == 230 and held["capture_id"] == "d1/capA" and json.loads(held["plan"])[0]["type"] == "loss"
    assert not (tree / "out/d2/capJunk.metadata.json").exists()
