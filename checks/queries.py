"""One query per operator, over whole tables."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs
from checks.inputs import CHUNK, scratch, start, table
from framedrift.functions import frames
from framedrift.functions.draws import row_draw
from framedrift.operators import content, drift, selection, statistics
from framedrift.operators.retime import number_positions, retime
from framedrift.plans.fixed_length import force_length, force_trace
from framedrift.plans.job import run_captures, run_directory, run_fixed_length
from framedrift.plans.perturb import perturb
from framedrift.plans.plan import read_plan, register_row_step, register_step
from framedrift.sinks.captures import file_header
from framedrift.sources import discovery, index
from framedrift.sources.capture_format import register_format
from framedrift.sources.files import resolve, spread_small
from framedrift.sources.packets import read_content, read_packets
from framedrift.streaming.arrivals import perturb_arrivals, stream_packets
from framedrift.streaming.growing import Growing

SEED = 7
PLAN = [
    {"type": "loss", "pct": 0.1},
    {"type": "retransmit", "pct": 0.15},
    {"type": "reorder", "pct": 0.6, "params": {"m": 5}},
]
KEYS = ["capture_id", "chunk_id", "packet_no", "copy_no"]


def hexed(column: str | Column = "frame") -> Column:
    return F.hex(column).alias("frame_hex")


def loaded(spark: SparkSession, root: str, mode: str = "STRICT") -> DataFrame:
    return read_packets(discovery.read_headers(discovery.discover(spark, root)), mode)


# --- sources -------------------------------------------------------------------------


def s1_discover(spark, sf):
    found = discovery.captures_from_listing(inputs.listing(spark, sf), "/data/in")
    return found.select("capture_id", "date_dir", "base_name")


def s2_skip_encrypted(spark, sf):
    named = inputs.listing(spark, sf).select(
        discovery.relative_to(F.col("path"), "file:///data/in/").alias("capture_id")
    )
    return named.filter(discovery.outside_encrypted(F.col("capture_id")))


def s3_limit(spark, sf):
    found = discovery.captures_from_listing(inputs.listing(spark, sf), "/data/in", 25)
    return found.select("capture_id")


def s4_sniff(spark, sf):
    return discovery.decode_header(inputs.file_heads(spark, sf)).select("event_id", "kind")


def s5_header(spark, sf):
    headed = discovery.decode_header(inputs.file_heads(spark, sf))
    return headed.select("event_id", "big_endian", "nanos", "snaplen", "linktype")


def s6_scan(spark, sf):
    root = scratch(spark)
    inputs.store_packets(spark, sf, root)
    return loaded(spark, root).select(
        "capture_id", "packet_no", "ts_us", "incl_len", "orig_len", hexed(), "linktype"
    )


def s7_pcapng(spark, sf):
    return read_content(inputs.pcapng_content(spark, sf)).select(
        "capture_id", "packet_no", "ts_us", "incl_len", "orig_len", hexed(), "linktype"
    )


def s8_repair(spark, sf):
    return read_content(inputs.damaged_content(spark, sf), "REPAIR").select(
        "capture_id", "packet_no", "ts_us", "incl_len", "orig_len", hexed(), "repaired"
    )


def _split(spark, root, mode="STRICT"):
    return read_packets(discovery.read_headers(discovery.discover(spark, root)), mode, inputs.SPLIT)


def s6_scan_split(spark, sf):
    """A capture of many ranges, most of all packets, beside small ones."""
    root = scratch(spark)
    inputs.store_hot(spark, sf, root)
    return _split(spark, root).select("capture_id", "packet_no", "ts_us", "incl_len", "orig_len", hexed(), "linktype")


def s6_index_range(spark, sf):
    """Packets 200 to 419 of each capture, and a twelfth of the time, from the ranges that hold them."""
    root, folder = scratch(spark), scratch(spark)
    inputs.store_hot(spark, sf, root)
    stored = index.write_index(discovery.discover(spark, root), folder, index_bytes=inputs.SPLIT)
    low, high = stored.agg(F.min("least_us"), F.max("most_us")).first()
    times = low + (high - low) // 4, low + (high - low) // 3
    found = [("number", index.read_indexed(stored, packets=(200, 420))), ("time", index.read_indexed(stored, times=times))]
    by_number, by_time = (df.select("capture_id", "packet_no", "ts_us", hexed(), F.lit(by).alias("by")) for by, df in found)
    return by_number.unionByName(by_time)


def s7_split_be(spark, sf):
    root = scratch(spark)
    inputs.store_hot_pcapng(spark, sf, root)
    return _split(spark, root).select("capture_id", "packet_no", "ts_us", "incl_len", "orig_len", hexed(), "linktype")


def s7_damaged(spark, sf):
    root = scratch(spark)
    inputs.store_hot_pcapng(spark, sf, root, damaged=True)
    return _split(spark, root, "REPAIR").select("capture_id", "packet_no", "ts_us", "incl_len", "orig_len", hexed(), "repaired")


def s8_repair_split(spark, sf):
    root = scratch(spark)
    inputs.store_hot_damaged(spark, sf, root)
    return _split(spark, root, "REPAIR").select("capture_id", "packet_no", "ts_us", "incl_len", "orig_len", hexed(), "repaired")


def s8_resync(spark, sf):
    """Junk between records, and records of false lengths: the walk goes on at the next sound ones."""
    root = scratch(spark)
    inputs.store_hot_gaps(spark, sf, root)
    return _split(spark, root, "RESYNC").select("capture_id", "packet_no", "ts_us", "incl_len", "orig_len", hexed(), "repaired")


def a6_errors_split(spark, sf):
    """Captures with damaged blocks give one error row each, whatever their size."""
    root = scratch(spark)
    inputs.store_hot_pcapng(spark, sf, root, damaged=True)
    failed = F.max(F.regexp_replace("error", " at byte.*", "")).alias("error")
    df = _split(spark, root)
    bad = df.filter("error is not null").groupBy("capture_id").agg(F.count("*").alias("errors"), failed)
    return df.select("capture_id").distinct().join(bad, "capture_id", "left")


def k1_part_files(spark, sf):
    """Each part a finished capture: what they hold, read back."""
    source, target = scratch(spark), scratch(spark)
    inputs.store_hot(spark, sf, source)
    plan = read_plan([{"type": "loss", "pct": 0.1}])
    run_directory(spark, source, target, plan, seed=SEED, chunk_size=CHUNK, chunks_per_part=4, part_files=True, split_bytes=inputs.SPLIT)
    return loaded(spark, target).select("capture_id", "packet_no", "incl_len", hexed())


def k1_datasource(spark, sf):
    """Captures written and read as a format of Spark, a part of a large one per task."""
    register_format(spark)
    root = scratch(spark)
    part = F.floor(F.col("packet_no") / (4 * CHUNK))
    df = inputs.hot_packets(spark, sf, frames=True).drop("event_id", "user_id")
    df.repartition("capture_id", part).sortWithinPartitions("capture_id", "packet_no").write.format("pcap").mode("append").save(root)
    back = spark.read.format("pcap").load(root).filter("error is null")
    return back.select(F.regexp_replace("capture_id", r"[.]part-.*", "").alias("capture_id"), "ts_us", "incl_len", "orig_len", hexed(), "linktype")


def s9_chunks(spark, sf):
    return selection.with_chunks(inputs.packets(spark, sf), CHUNK).select(
        "capture_id", "packet_no", "chunk_id"
    )


def s10_count(spark, sf):
    return selection.count_packets(inputs.packets(spark, sf))


def s14_flow_csv(spark, sf):
    root = scratch(spark)
    flows = table(spark, sf, "lineitem")
    flows.toDF(*[f" {name} " for name in flows.columns]).write.csv(root, header=True)
    return drift.trim_names(drift.load_flow_csv(spark, root))


# --- sinks ---------------------------------------------------------------------------


def k1_write(spark, sf):
    root = scratch(spark)
    inputs.store_packets(spark, sf, root)
    written = discovery.read_headers(discovery.discover(spark, root))
    return written.select("capture_id", "length", "kind", "big_endian", "nanos", "snaplen", "linktype")


def k4_patch_time(spark, sf):
    root = scratch(spark)
    trace = perturb(inputs.packets(spark, sf, frames=True), read_plan(PLAN), SEED, CHUNK, 2)
    inputs.store(trace, root)
    return loaded(spark, root).select("capture_id", "packet_no", "ts_us", "incl_len", hexed())


def k5_output(spark, sf):
    found = discovery.captures_from_listing(inputs.listing(spark, sf), "/data/in")
    mirrored = discovery.with_output(found, "/out/").withColumnRenamed("output", "mirrored")
    return discovery.with_output(mirrored.drop("metadata_path"), "/out", "date").select(
        "capture_id", "mirrored", F.col("output").alias("dated"), "metadata_path"
    )


def k5_clashes(spark, sf):
    files = inputs.listing(spark, sf).withColumn(
        "capture_id", F.concat(F.lit("d/"), F.substring_index("path", "/", -2), F.lit("/cap"), F.col("user_id"))
    )
    return discovery.output_clashes(discovery.with_output(discovery.with_names(files), "/out", "date"))


def k6_resume(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("capture_id"), "o_orderstatus")
    done = orders.filter("o_orderstatus = 'F'")
    return discovery.without_done(orders, done)


def k6_resume_parts(spark, sf):
    """A run that stopped half way through its parts, started again: the same captures, and what it kept."""
    source, target = scratch(spark), scratch(spark)
    inputs.store_hot(spark, sf, source)
    stops = [True]
    late = F.when(F.col("packet_no") >= 400, F.raise_error(F.lit("stopped"))).otherwise(F.lit(True))
    register_step("stopping", lambda df, step, seed: df.filter(late) if stops else df)
    plan = read_plan([*PLAN[:1], {"type": "stopping", "pct": 1}])
    options = {"seed": SEED, "chunk_size": CHUNK, "chunks_per_part": 2, "run_id": "again", "resume_parts": True}
    try:
        run_directory(spark, source, target, plan, **options)
    except PySparkException:
        stops.clear()
    runs = run_directory(spark, source, target, plan, **options).select("capture_id", (F.col("parts_kept") <= 2).alias("kept_few"), "total_in", "loss_drop")
    written = loaded(spark, target).groupBy(F.regexp_replace("capture_id", r"[.]pcap$", "").alias("capture_id")).agg(
        F.count("*").alias("packets"), F.sum(F.conv(F.substring(F.md5(F.hex("frame")), 1, 8), 16, 10).cast("long")).alias("frames")
    )
    return runs.join(written, "capture_id")


def k9_single(spark, sf):
    root = scratch(spark)
    forced = force_length(inputs.packets(spark, sf, frames=True), 20, 48, seed=SEED, exact=True)
    inputs.store(force_trace(forced, chunk_size=CHUNK, chunks_per_part=2), root)
    return loaded(spark, root).select("capture_id", "packet_no", "ts_us", "incl_len", hexed())


def j1_directory_job(spark, sf):
    source, target = scratch(spark), scratch(spark)
    inputs.store_packets(spark, sf, source)
    runs = run_directory(spark, source, target, read_plan(PLAN), seed=SEED, chunk_size=CHUNK, chunks_per_part=2)
    counts = ["total_in", "total_out", "loss_drop", "retransmit_dup", "reorder_packets"]
    return runs.select("capture_id", "status", *counts)


def j1_greedy(spark, sf):
    """The greedy method in a job whose shuffle partitions are not merged."""
    source, target = scratch(spark), scratch(spark)
    inputs.store_packets(spark, sf, source)
    plan = read_plan([{"type": "reorder", "pct": 0.6, "params": {"m": 5, "method": "greedy"}}])
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(merging)
    spark.conf.set(merging, "false")
    try:
        runs = run_directory(spark, source, target, plan, seed=SEED, chunk_size=CHUNK, chunks_per_part=2)
    finally:
        spark.conf.set(merging, before)
    return runs.select("capture_id", "status", "total_in", "total_out", "parts")


def k7_runs(spark, sf):
    """The ledger of a run in which some captures were done before."""
    source, target = scratch(spark), scratch(spark)
    inputs.store_packets(spark, sf, source)
    plan = read_plan(PLAN[:1])
    first = discovery.discover(spark, source).filter(F.col("base_name").rlike("[05].pcap$"))
    run_captures(first, target, plan, seed=SEED, chunk_size=CHUNK)
    runs = run_directory(spark, source, target, plan, seed=SEED, chunk_size=CHUNK, resume=True, run_id="second")
    return runs.select("capture_id", "run_id", "plan", "seed", "chunk_size", "status", "reason", "error", "total_in")


def k9_job(spark, sf):
    """Fixed lengths over a directory that also holds an empty and an unknown capture."""
    source, target = scratch(spark), scratch(spark)
    inputs.store_packets(spark, sf, source)
    for name, data in (("odd/capEmpty", file_header(1)), ("odd/capUnknown", b"no capture")):
        system, inner = resolve(f"{source}/{name}")
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        with system.open_output_stream(inner) as out:
            out.write(data)
    runs = run_fixed_length(discovery.discover(spark, source), target, 20, 48, seed=SEED, exact=True, chunk_size=CHUNK)
    written = discovery.read_headers(discovery.discover(spark, target))
    written = written.select(F.regexp_replace("capture_id", r"\.pcap$", "").alias("capture_id"), F.col("length").alias("size"))
    return runs.join(written, "capture_id", "left").select(
        "capture_id", "status", "error", "total", "perturbed", (F.col("size") > 0).alias("has_file")
    )


# --- selection -----------------------------------------------------------------------


def r1_draws(spark, sf):
    return start(spark, sf).select(*KEYS, *[row_draw(SEED, 3, i).alias(f"draw{i}") for i in range(4)])


def r2_loss(spark, sf):
    return selection.lose(start(spark, sf), 0.1, SEED, 0).select(*KEYS, "ts_us")


def r3_retransmit(spark, sf):
    return selection.retransmit(start(spark, sf), 0.15, SEED, 1, CHUNK).select(*KEYS, "pos", "ts_us")


def r4_adjacent(spark, sf):
    copied = selection.retransmit(start(spark, sf), 0.15, SEED, 1, CHUNK, placement="adjacent")
    return copied.select(*KEYS, "pos", "ts_us")


def r5_blocks(spark, sf):
    return selection.reorder(start(spark, sf), 0.6, 5, SEED, 2).select(*KEYS, "pos", "applied")


def r5_greedy(spark, sf):
    return selection.reorder(start(spark, sf), 0.6, 5, SEED, 2, "greedy").select(*KEYS, "pos", "applied")


def r5_greedy_facts(spark, sf):
    """Of each chunk: positions stay a permutation, moves are short, and only flagged packets move."""
    df = selection.reorder(start(spark, sf), 0.6, 5, SEED, 2, "greedy")
    moved = F.col("pos") != F.col("packet_no") % CHUNK
    flagged = F.col("applied").bitwiseAND(F.lit(4)) != 0
    return df.groupBy("capture_id", "chunk_id").agg(
        F.count("*").alias("packets"),
        F.countDistinct("pos").alias("positions"),
        (F.max(F.abs(F.col("pos") - F.col("packet_no") % CHUNK)) < 5).alias("near"),
        F.max(moved & ~flagged).alias("moved_unflagged"),
        (F.count_if(flagged) > 0).alias("some_flagged"),
    )


def r6_exact(spark, sf):
    source = inputs.packets(spark, sf).withColumn("copy_no", F.lit(0))
    return selection.flag_exact(source, 12.5, SEED).select("capture_id", "packet_no", "selected")


def r7_bernoulli(spark, sf):
    source = inputs.packets(spark, sf).withColumn("copy_no", F.lit(0))
    return selection.flag_bernoulli(source, 12.5, SEED).select("capture_id", "packet_no", "selected")


def r8_content_sampling(spark, sf):
    raw = [PLAN[1], {"type": "seq_offset", "pct": 0.5}, {"type": "length_forge", "pct": 0.25}]
    trace = perturb(inputs.packets(spark, sf, frames=True), read_plan(raw), SEED, CHUNK, 2)
    return trace.select(*KEYS, "applied")


def r9_rate_modify(spark, sf):
    return number_positions(selection.rate_modify(start(spark, sf), 1.0, SEED, 0)).select(*KEYS, "out_no")


def r11_plan(spark, sf):
    trace = perturb(inputs.packets(spark, sf), read_plan(PLAN), SEED, CHUNK, 2)
    return trace.select(*KEYS, "pos", "ts_new_us", "applied")


def r13_chosen(spark, sf):
    chosen = table(spark, sf, "events").filter("event_type = 'click'").select(
        inputs.capture_of(F.col("event_id")).alias("capture_id"),
        (F.col("event_id") % inputs.BLOCK).alias("packet_no"),
    )
    return selection.keep_chosen(inputs.packets(spark, sf), chosen).select("capture_id", "packet_no", "ts_us")


def w2_retime(spark, sf):
    copied = selection.retransmit(selection.lose(start(spark, sf), 0.1, SEED, 0), 0.15, SEED, 1, CHUNK)
    return retime(selection.gather_parts(copied)).select(*KEYS, "ts_new_us")


def w3_positions(spark, sf):
    return number_positions(selection.lose(start(spark, sf), 0.1, SEED, 0)).select(*KEYS, "out_no")


# --- bytes ---------------------------------------------------------------------------


def _flagged(spark, sf):
    return inputs.packets(spark, sf, frames=True).withColumn("flag", F.lit(True))


def b1_header(spark, sf):
    fields = ["eth_type", "l3_off", "ihl", "ip_total_len", "proto", "l4_off", "tcp_seq", "payload_off"]
    fields += ["payload_len", "has_ip", "has_tcp", "has_udp"]
    df = frames.with_header(inputs.packets(spark, sf, frames=True))
    return df.select("event_id", *[F.col(f"hdr.{name}").alias(name) for name in fields])


def b1_chain(spark, sf):
    """Headers behind IPv6 extension headers."""
    fields = ["ihl", "l4_off", "ip_total_len", "proto", "tcp_seq", "payload_off", "payload_len", "has_tcp"]
    df = frames.with_header(inputs.chained_frames(spark, sf))
    return df.select("event_id", *[F.col(f"hdr.{name}").alias(name) for name in fields])


def b2_chain(spark, sf):
    """Sequence numbers behind IPv6 extension headers, checksums over the last stop of a route."""
    return frames.shift_sequence(inputs.chained_frames(spark, sf), "flag", 1000).select("event_id", hexed(), "flag")


def b2_seq_offset(spark, sf):
    df = content.edit_frames(
        start(spark, sf, frames=True),
        [lambda df, native: content.seq_offset(df, 0.5, SEED, 0, 1000, native)],
        SEED,
    )
    return df.select("event_id", hexed(), "applied")


def b3_ip_checksum(spark, sf):
    df = inputs.packets(spark, sf, frames=True).filter("event_id % 4 <> 2")
    header = F.substr("frame", F.when(F.col("event_id") % 4 == 3, 19).otherwise(15), F.lit(20))
    return df.select("event_id", frames.ip_header_checksum(header).alias("checksum"))


def b4_l4_checksum(spark, sf):
    return frames.shift_sequence(_flagged(spark, sf), "flag", 0).select("event_id", hexed(), "flag")


def b4_l4_checksum_native(spark, sf):
    df = frames.shift_sequence(_flagged(spark, sf), "flag", 0, native=True)
    return df.select("event_id", hexed(), "flag")


def b4_incremental(spark, sf):
    """Sound frames, shifted with checksums worked out from the words that change."""
    sound = frames.shift_sequence(_flagged(spark, sf), "flag", 0)
    return frames.shift_sequence(sound, "flag", 70_000, checksums="update").select("event_id", hexed(), "flag")


def b5_lengths(spark, sf):
    df = frames.with_header(frames.forge_length(_flagged(spark, sf), "flag", 24))
    return df.select("event_id", F.col("hdr.ip_total_len").alias("ip_total_len"), F.col("hdr.payload_len").alias("payload_len"))


def b6_length_forge(spark, sf):
    forged = frames.forge_payload(F.encode("text", "UTF-8"), None, b"\xaa")
    return _digest(table(spark, sf, "documents"), forged)


def b7_dummy(spark, sf):
    payload = F.when(F.col("lang") == "en", F.encode("text", "UTF-8")).otherwise(F.lit(b""))
    return _digest(table(spark, sf, "documents"), frames.forge_payload(payload, None, b"\x55"))


def _digest(df: DataFrame, data: Column) -> DataFrame:
    df = df.select("doc_id", data.alias("data"))
    return df.select("doc_id", F.length("data").alias("n_bytes"), F.md5(F.hex("data")).alias("digest"))


def b8_forged_frames(spark, sf):
    return frames.forge_length(_flagged(spark, sf), "flag", 24, b"\xee").select("event_id", hexed())


def b11_fixed_len(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("source").alias("capture_id"),
        F.col("doc_id").alias("packet_no"),
        F.octet_length("text").cast("long").alias("orig_len"),
        F.encode("text", "UTF-8").alias("frame"),
        "doc_id",
    )
    forced = force_length(docs, 20, 256, seed=SEED)
    return forced.select("doc_id", "selected", "orig_len", F.md5(F.hex("frame")).alias("digest"))


def b12_guard(spark, sf):
    raw = [
        {"type": "seq_offset", "pct": 0.5, "params": {"offset": 5}},
        {"type": "length_forge", "pct": 0.25, "params": {"new_len": 20}},
    ]
    source = inputs.packets(spark, sf, frames=True)
    trace = perturb(source, read_plan(raw), SEED, CHUNK, 2, on_length_change="revert")
    return trace.select("event_id", hexed(), "applied")


def b13_passthrough(spark, sf):
    df = _flagged(spark, sf).withColumn("linktype", F.when(F.col("event_id") % 3 == 0, 101).otherwise(1))
    return frames.shift_sequence(df, "flag", 7).select("event_id", hexed(), "flag")


# --- statistics ----------------------------------------------------------------------


def _counts(spark, sf):
    plan = read_plan(PLAN)
    return statistics.run_counts(perturb(inputs.packets(spark, sf), plan, SEED, CHUNK, 2, track=True), plan)


def a1_totals(spark, sf):
    return _counts(spark, sf).select("capture_id", "total_in", "total_out")


def a2_loss(spark, sf):
    return _counts(spark, sf).select("capture_id", "loss_drop")


def a3_duplicates(spark, sf):
    return _counts(spark, sf).select("capture_id", "retransmit_dup")


def a4_reordered(spark, sf):
    return _counts(spark, sf).select("capture_id", "reorder_packets")


def a5_repairs(spark, sf):
    plan = read_plan([{"type": "loss", "pct": 0.1}])
    source = read_content(inputs.damaged_content(spark, sf), "REPAIR")
    counts = statistics.run_counts(perturb(source, plan, SEED, CHUNK, 2, track=True), plan)
    return counts.select("capture_id", "total_in", "repaired_packets", "discarded_records", "loss_drop")


def a6_errors(spark, sf):
    """Captures with an unknown format give an error row, the others their packets."""
    files = inputs.damaged_content(spark, sf)
    block = F.substring_index("capture_id", "cap", -1).cast("long")
    broken = F.concat(F.lit(b"\xca\xfe\xba\xbe"), F.substr("content", F.lit(5), F.length("content")))
    files = files.withColumn("content", F.when(block % 3 == 0, broken).otherwise(F.col("content")))
    return read_content(files).groupBy("capture_id").agg(
        F.count_if(F.col("error").isNull()).alias("packets"), F.max("error").alias("error")
    )


def a7_selected(spark, sf):
    source = inputs.packets(spark, sf).withColumn("copy_no", F.lit(0))
    return statistics.selected_counts(selection.flag_bernoulli(source, 12.5, SEED))


# --- drift ---------------------------------------------------------------------------



def flows(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Line items as flows, before and after: a draw drops some, prices and quantities shift."""
    before = spread_small(table(spark, sf, "lineitem")).withColumns(
        {
            "Flow IDLE Mean": F.col("l_tax") * 2,
            "constant": F.lit(3),
            "balance": F.when(F.col("l_linenumber") % 2 == 0, 0.0),
        }
    )
    drawn = before.withColumns(
        {
            "capture_id": F.col("l_orderkey"),
            "packet_no": F.col("l_linenumber"),
            "copy_no": F.col("l_partkey"),
        }
    )
    kept = selection.lose(drawn, 0.2, SEED, 0).drop("capture_id", "packet_no", "copy_no", "l_shipdate")
    after = kept.withColumns(
        {
            "l_extendedprice": F.col("l_extendedprice") * 1.05,
            "l_quantity": F.col("l_quantity") + F.when(F.col("l_linenumber") == 1, 10.0).otherwise(0.0),
            "l_tax": F.when(F.col("l_linenumber") == 2, F.lit(float("nan"))).otherwise(F.col("l_tax")),
            "balance": F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")),
        }
    )
    return before.toDF(*[f" {c}" for c in before.columns]), after.toDF(*[f"{c} " for c in after.columns])


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    """Eight digits: means of cents over 6,000 to 600,000 rows never end in an exact half there."""
    return df.withColumns({name: F.round(name, 8) for name in names})


def dr_clean(spark, sf):
    """DR1 to DR6: the features that remain to be compared."""
    return drift.feature_drift(*flows(spark, sf)).select("feature")


def dr4_constant(spark, sf):
    before = drift.trim_names(flows(spark, sf)[0])
    names = drift.numeric_names(before)
    return drift.varying(drift.profile(before, names)).select("feature")


def dr7_means(spark, sf):
    after = drift.trim_names(flows(spark, sf)[1])
    profiled = drift.profile(after, drift.numeric_names(after))
    return _rounded(profiled.select("feature", "mean", "deviation", "known"), "mean", "deviation")


def dr8_drift(spark, sf):
    """DR8 to DR11: aligned means, differences, significance."""
    return _rounded(drift.feature_drift(*flows(spark, sf)), "mean_before", "mean_after", "abs_diff")


def dr12_ranked(spark, sf):
    ranked = drift.ranked(drift.feature_drift(*flows(spark, sf)))
    return _rounded(ranked.select("feature", "rel_pct", "abs_diff"), "abs_diff")


def dr13_topk(spark, sf):
    return drift.top_features(drift.feature_drift(*flows(spark, sf)), 3).select("feature", "rel_pct")


def dr14_hist(spark, sf):
    items = table(spark, sf, "lineitem")
    bars = drift.histogram(items, "l_extendedprice", *drift.choose_bins(items, "l_extendedprice", "sturges"))
    return bars.select("bin", F.round("left", 6).alias("left"), "count", F.round("density", 12).alias("density"))


def dr14_hist_auto(spark, sf):
    """The default rule: bins by the interquartile range; empty neighbours are one bin."""
    bars = drift.distributions(table(spark, sf, "lineitem"), ["l_quantity"]).filter("kind = 'histogram'")
    return bars.select(F.round("x", 6).alias("left"), F.round("width", 6).alias("width"), "count", F.round("density", 12).alias("density"))


CURVED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey"]


def dr_distributions(spark, sf):
    """Histograms and curves of six features, both sides."""
    found = drift.key_distributions(*flows(spark, sf), CURVED, "sturges")
    rounded = {name: F.round(name, 6) for name in ("x", "width")} | {"density": F.round("density", 9)}
    return found.withColumns(rounded)


def dr15_kde(spark, sf):
    items = spread_small(table(spark, sf, "lineitem").select("l_extendedprice"))
    curve = drift.density_curve(items, "l_extendedprice")
    return curve.select("point", F.round("x", 6).alias("x"), F.round("density", 12).alias("density"))


def dr16_row_delta(spark, sf):
    return drift.row_delta(*flows(spark, sf))


def dr17_chart(spark, sf):
    return _rounded(drift.drift_report(*flows(spark, sf))["chart"], "mean_before", "mean_after")


def dr18_significant(spark, sf):
    return drift.significance_counts(drift.feature_drift(*flows(spark, sf)))


# --- streams and custom steps ----------------------------------------------------------


def st1_stream(spark, sf):
    """Captures arrive as files; loss and copies run on the stream."""
    root, out = scratch(spark), scratch(spark)
    inputs.store_packets(spark, sf, root)
    trace = selection.start_trace(stream_packets(spark, root), CHUNK, 2)
    trace = selection.retransmit(selection.lose(trace, 0.1, SEED, 0), 0.15, SEED, 1, CHUNK)
    query = (
        trace.select(*KEYS, "pos", "ts_us")
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch(spark))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(out)


def st1_stream_job(spark, sf):
    """Captures arrive as files; whole batches go through the directory job."""
    root, out = scratch(spark), scratch(spark)
    inputs.store_packets(spark, sf, root)
    perturb_arrivals(
        spark, root, out, read_plan(PLAN), scratch(spark), seed=SEED, chunk_size=CHUNK, chunks_per_part=2
    ).awaitTermination()
    return loaded(spark, out).select("capture_id", "packet_no", "ts_us", "incl_len")


def st1_growing(spark, sf):
    """Captures that grow between two batches: finished parts, and in the end the rest, as in the batch job."""
    source, grown, out = scratch(spark), scratch(spark), scratch(spark)
    inputs.store_hot(spark, sf, source)
    plan = read_plan([{"type": "loss", "pct": 0.1}])
    growing = Growing(out, plan, scratch(spark), seed=SEED, chunk_size=CHUNK, chunks_per_part=4)
    for share in (0.55, 1.0):
        inputs.copy_share(spark, source, grown, share)
        growing.start(spark, grown).awaitTermination()
    growing.finish(spark)
    return loaded(spark, out).select("capture_id", "packet_no", "incl_len", hexed())


def u1_custom_step(spark, sf):
    register_step("thin", lambda df, step, seed: df.filter(F.col("packet_no") % step.params["of"] == 0))
    raw = [{"type": "thin", "pct": 1, "params": {"of": 3}}, PLAN[0]]
    trace = perturb(inputs.packets(spark, sf), read_plan(raw), SEED, CHUNK, 2)
    return trace.select(*KEYS, "ts_new_us")


def _by_last_digit(frame: bytes, tail: str):
    """Drop, lengthen or triple a packet, by the last digit of its payload."""
    digit = frame[-2] - ord("0")
    if digit < 4:
        return None
    return frame + tail.encode() if digit < 7 else [frame, frame + tail.encode(), frame]


def u1_rowwise(spark, sf):
    """A function of one packet with a parameter, between loss, copies, reordering and re-timing."""
    register_row_step("by_last_digit", _by_last_digit)
    raw = [*PLAN, {"type": "by_last_digit", "pct": 0.5, "params": {"tail": "!"}}]
    trace = perturb(inputs.packets(spark, sf), read_plan(raw), SEED, CHUNK, 2)
    return trace.select(*KEYS, "pos", "ts_new_us", "applied", "orig_len", hexed())


def u1_drops_first_part(spark, sf):
    """A step that removes whole parts, the first among them, leaves complete files."""
    register_step("late", lambda df, step, seed: df.filter(F.col("packet_no") >= step.params["least"]))
    source, target = scratch(spark), scratch(spark)
    inputs.store_packets(spark, sf, source)
    plan = read_plan([{"type": "late", "pct": 1, "params": {"least": 230}}])
    run_directory(spark, source, target, plan, seed=SEED, chunk_size=CHUNK, chunks_per_part=1)
    return loaded(spark, target).select("capture_id", "packet_no", hexed())


def _is_query(name: str, value) -> bool:
    return callable(value) and getattr(value, "__module__", "") == __name__ and name[0] in "abdjkrsuw"


HELPERS = {"hexed", "loaded", "flows"}
QUERIES = {
    name: value
    for name, value in list(globals().items())
    if _is_query(name, value) and name not in HELPERS
}
