"""Which packets appear, how often and in which order.

The operators work on a *trace*: packets plus the columns

* ``part_id``  a run of chunks of one capture, the unit of shuffling and of writing;
* ``pos``      order inside the chunk, null once a packet is lost;
* ``copy_no``  0 for the packet itself, other values for its copies, unique per packet;
* ``applied``  bit mask, bit k set where step k acted on this row; in plans of more than MASK_STEPS steps
               an array of the numbers of these steps;
* ``lost_at``  null, the step that dropped the packet, or -1 for a record never readable.

Lost rows stay only when a caller wants statistics; they carry no frame bytes then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framedrift.functions.draws import chance, draw, row_draw
from framedrift.functions.octets import opaque
from framedrift.sources.files import broadcast_if_small, settle

DEFAULT_CHUNK = 10_000
DEFAULT_CHUNKS_PER_PART = 16
CHUNK_KEYS = ("capture_id", "part_id", "chunk_id")
ORDER_BUCKET_BITS = 16
MASK_STEPS = 62  # steps that fit into a bit mask
COPYING_AT_ONCE = 29  # doublings of a position below 2^32
ROUNDS_AT_ONCE = 3


def with_chunks(packets: DataFrame, chunk_size: int = DEFAULT_CHUNK) -> DataFrame:
    """Add ``chunk_id``: runs of ``chunk_size`` consecutive input packets of a capture."""
    if chunk_size < 1:
        raise ValueError(f"chunk_size must be positive, not {chunk_size}")
    return packets.withColumn("chunk_id", F.floor(F.col("packet_no") / chunk_size).cast("long"))


def start_trace(
    packets: DataFrame,
    chunk_size: int = DEFAULT_CHUNK,
    chunks_per_part: int = DEFAULT_CHUNKS_PER_PART,
    track: bool = False,
    wide: bool = False,
) -> DataFrame:
    """Turn packets into a trace in which nothing has happened yet.

    ``track`` keeps records without bytes as lost rows, for the statistics. ``wide`` makes ``applied``
    an array, for plans of any length.
    """
    df = packets
    if "error" in df.columns:
        # A file that failed has no packets to number; its row travels in the first part.
        df = df.withColumn("repaired", F.coalesce("repaired", F.when(F.col("error").isNotNull(), "header")))
        df = df.withColumn("packet_no", F.coalesce("packet_no", F.lit(0)))
    if "repaired" in df.columns:
        unreadable = F.coalesce(F.col("repaired").isin("discarded", "header"), F.lit(False))
        if not track:
            df = df.filter(~unreadable)
    else:
        unreadable = F.lit(False)
    df = with_chunks(df, chunk_size)
    inside = F.col("packet_no") - F.col("chunk_id") * chunk_size
    return df.withColumns(
        {
            "part_id": F.floor(F.col("chunk_id") / chunks_per_part).cast("long"),
            "copy_no": F.lit(0).cast("long"),
            "pos": F.when(~unreadable, inside),
            "applied": F.array().cast("array<int>") if wide else F.lit(0).cast("long"),
            "lost_at": F.when(unreadable, F.lit(-1)),
        }
    )


def alive() -> Column:
    return F.col("lost_at").isNull()


def is_wide(df: DataFrame) -> bool:
    return dict(df.dtypes)["applied"].startswith("array")


def mark(df: DataFrame, step: int, hit: Column) -> DataFrame:
    """Note in ``applied`` that ``step`` acted where ``hit``."""
    if is_wide(df):
        marked = F.concat("applied", F.array(F.lit(step)))
    else:
        marked = F.col("applied").bitwiseOR(F.lit(1 << step).cast("long"))
    return df.withColumn("applied", F.when(hit, marked).otherwise(F.col("applied")))


def was_applied(step: int, wide: bool = False) -> Column:
    if wide:
        return F.array_contains("applied", step)
    return F.col("applied").bitwiseAND(F.lit(1 << step).cast("long")) != 0


def renumber(df: DataFrame) -> DataFrame:
    """The same order with small ``pos`` and ``copy_no``, of a gathered trace: both are below the rows of a chunk.

    Copying doubles the range of both, so plans that copy very often need it now and then.
    """
    packet = Window.partitionBy(*CHUNK_KEYS, "packet_no").orderBy("copy_no")
    place = (F.row_number().over(chunk_order()) - 1).cast("long")
    return df.withColumns({"pos": F.when(alive(), place), "copy_no": (F.row_number().over(packet) - 1).cast("long")})


def chunk_order() -> Window:
    """Packets of one chunk in output order, lost ones last."""
    return Window.partitionBy(*CHUNK_KEYS).orderBy(F.col("pos").asc_nulls_last())


def gather_parts(df: DataFrame) -> DataFrame:
    """The one shuffle of a run: windows over chunks and the writer share it."""
    return df.repartition("capture_id", "part_id")


def lose(df: DataFrame, pct: float, seed: int, step: int, track: bool = False) -> DataFrame:
    """Drop each packet with probability ``pct``."""
    hit = chance(row_draw(seed, step), pct)
    if not track:
        return df.filter(~hit)
    df = df.withColumn("_hit", opaque(hit & alive()))
    df = mark(df, step, F.col("_hit"))
    emptied = {"lost_at": F.when(F.col("_hit"), F.lit(step)).otherwise(F.col("lost_at"))}
    emptied["pos"] = F.when(~F.col("_hit"), F.col("pos"))
    if "frame" in df.columns:
        emptied["frame"] = F.when(~F.col("_hit"), F.col("frame"))
    return df.withColumns(emptied).drop("_hit")


def _with_copies(df: DataFrame, step: int, hit: Column, position: Column, round_no: int) -> DataFrame:
    """Emit a second row for every hit; ``position`` may use ``_copy`` (0 or 1)."""
    both = F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))
    only = F.array(F.lit(0).cast("long"))
    own = F.array(F.lit(step)) if is_wide(df) else F.lit(1 << step).cast("long")
    df = df.withColumn("_copy", F.explode(F.when(F.coalesce(hit, F.lit(False)), both).otherwise(only)))
    return df.withColumns(
        {
            "pos": position,
            "copy_no": F.col("copy_no") + F.col("_copy") * (1 << (round_no - 1)),
            # A copy did not exist in earlier steps, so it starts its own record.
            "applied": F.when(F.col("_copy") == 1, own).otherwise(F.col("applied")),
        }
    ).drop("_copy")


def retransmit(
    df: DataFrame,
    pct: float,
    seed: int,
    step: int,
    span: int,
    round_no: int = 1,
    placement: str = "end",
) -> DataFrame:
    """Copy each packet once with probability ``pct``.

    ``placement='end'`` puts the copies after all packets of their chunk, in order;
    ``'adjacent'`` puts each copy right behind its packet. ``span`` is an upper bound of
    ``pos`` (the caller doubles it after each call), ``round_no`` counts copying steps.
    Neither needs a window or a shuffle.
    """
    hit = chance(row_draw(seed, step), pct) & alive()
    if placement == "end":
        position = F.col("pos") + F.col("_copy") * span
    elif placement == "adjacent":
        position = F.col("pos") * 2 + F.col("_copy")
    else:
        raise ValueError(f"placement must be 'end' or 'adjacent', not {placement!r}")
    return _with_copies(df, step, hit, position, round_no)


def rate_modify(df: DataFrame, pct: float, seed: int, step: int, round_no: int = 1) -> DataFrame:
    """Thicken the traffic: behind every third packet of four, repeat the one before it.

    Each packet sees itself whether the next one is such a third packet, so no frame
    passes through a window buffer. ``pct`` thins the repetitions.
    """
    order = chunk_order()
    df = df.withColumns(
        {"_rn": F.row_number().over(order) - 1, "_next": F.lead("pos").over(order)}
    )
    hit = (F.col("_rn") % 4 == 1) & F.col("_next").isNotNull() & alive()
    hit = hit & chance(row_draw(seed, step), pct)
    place = (F.col("_rn") * 2 + F.col("_copy") * 3).cast("long")
    df = _with_copies(df, step, hit, F.when(alive(), place), round_no)
    return df.drop("_rn", "_next")


def reorder(
    df: DataFrame, pct: float, m: int, seed: int, step: int, method: str = "blocks"
) -> DataFrame:
    """Shuffle short segments of each chunk of more than two packets.

    ``method='blocks'``: each run of ``m`` packets triggers with probability ``pct`` and
    shuffles 2..m neighbours at a drawn place. ``method='greedy'``: segments start at any
    packet, with probability ``pct``, wherever they do not overlap an earlier choice; this
    reads the packets twice and gathers the parts itself.
    """
    if m < 2:
        raise ValueError(f"reorder needs m >= 2, not {m}")
    if method == "blocks":
        return _reorder_blocks(df, pct, m, seed, step)
    if method == "greedy":
        return _reorder_greedy(df, pct, m, seed, step)
    raise ValueError(f"method must be 'blocks' or 'greedy', not {method!r}")


def _reorder_blocks(df: DataFrame, pct: float, m: int, seed: int, step: int) -> DataFrame:
    order = chunk_order()
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumns(
        {"_rn": F.row_number().over(order) - 1, "_n": F.count("pos").over(whole)}
    )
    df = df.withColumn("_block", F.floor(F.col("_rn") / m).cast("long"))
    word = lambda part: draw(seed, step, "capture_id", "chunk_id", "_block", part=part)
    df = df.withColumns({"_trigger": word(0), "_size": 2 + word(1) % (m - 1), "_where": word(2)})
    df = df.withColumn("_start", F.col("_where") % (m - F.col("_size") + 1))
    offset = F.col("_rn") % m
    member = (
        chance(F.col("_trigger"), pct)
        & (F.col("_n") > 2)
        & (offset >= F.col("_start"))
        & (offset < F.col("_start") + F.col("_size"))
        & alive()
    )
    df = df.withColumn("_member", member)
    df = df.withColumns(
        {
            "_slot": F.when(F.col("_member"), F.col("_block") * m + F.col("_start")).otherwise(
                F.col("_rn")
            ),
            "_rank": F.when(F.col("_member"), row_draw(seed, f"{step}s")).otherwise(F.lit(0)),
        }
    )
    shuffled = Window.partitionBy(*CHUNK_KEYS).orderBy("_slot", "_rank", "_rn")
    df = df.withColumn(
        "pos", F.when(alive(), (F.row_number().over(shuffled) - 1).cast("long"))
    )
    df = mark(df, step, F.col("_member"))
    scratch = ["_rn", "_n", "_block", "_trigger", "_size", "_where", "_start", "_member"]
    return df.drop(*scratch, "_slot", "_rank")


def _short_segments(keys: DataFrame, pct: float, m: int, seed: int, step: int) -> DataFrame:
    """Candidate segments [start, stop) of chunks, by the places of their packets, each with a priority."""
    order = chunk_order()
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = keys.withColumns({"start": F.row_number().over(order) - 1, "_n": F.count("pos").over(whole)})
    df = df.filter(alive() & (F.col("_n") > 2) & chance(row_draw(seed, step), pct))
    stop = F.least(F.col("start") + 2 + row_draw(seed, step, 1) % (m - 1), F.col("_n"))
    start = F.col("start").cast("long")
    return df.select(*CHUNK_KEYS, "pos", start.alias("start"), stop.alias("stop"), row_draw(seed, step, 2).alias("priority"))


def disjoint_segments(candidates: DataFrame, m: int) -> DataFrame:
    """The segments that stand when they are tried one by one by (priority, start), and overlap none before them.

    In each round a segment stands if it comes first among all undecided ones that it overlaps, and
    those overlap a standing one and fall. That is the outcome of trying one by one, as a segment waits
    exactly for those that come before it. A segment of up to ``m`` packets only overlaps starts less
    than ``m`` away, so a round is two windows over short ranges; the undecided go on, a small part of
    them each time. Rounds are settled a few at a time, and none of them sees a frame.
    """
    chunk = Window.partitionBy(*CHUNK_KEYS).orderBy("start")
    sides = chunk.rangeBetween(-(m - 1), -1), chunk.rangeBetween(1, m - 1)

    def around(item: Column, where: Column) -> Column:
        return F.concat(*[F.collect_list(F.when(where, item)).over(side) for side in sides])

    overlaps = lambda x: (x["start"] < F.col("stop")) & (x["stop"] > F.col("start"))
    me = F.struct("priority", "start", "stop")
    open_ = candidates.withColumns({"_open": F.lit(True), "_stands": F.lit(False)})
    standing = None
    while True:
        for _ in range(ROUNDS_AT_ONCE):
            open_ = open_.withColumn("_rivals", F.filter(around(me, F.col("_open")), overlaps))
            first = F.array_min(F.transform("_rivals", lambda x: F.struct(x["priority"], x["start"])))
            wins = F.col("_open") & F.coalesce(F.struct("priority", "start") < first, F.lit(True))
            open_ = open_.withColumn("_wins", wins)
            beaten = F.exists(around(F.struct("start", "stop"), F.col("_wins")), overlaps)
            open_ = open_.withColumns(
                {"_stands": F.col("_stands") | F.col("_wins"), "_open": F.col("_open") & ~F.col("_wins") & ~beaten}
            ).drop("_rivals", "_wins")
        rounds = settle(open_)
        found = rounds.filter("_stands").drop("_open", "_stands")
        standing = found if standing is None else standing.unionByName(found)
        open_ = rounds.filter("_open")
        if open_.isEmpty():
            return standing.drop("priority")


def _reorder_greedy(df: DataFrame, pct: float, m: int, seed: int, step: int) -> DataFrame:
    """Segments are found on the keys alone; then they join the packets as rows of their own, in the one shuffle.

    A segment's row stands right before its first packet, so a running window tells each packet its segment.
    """
    keys = df.select(*CHUNK_KEYS, "packet_no", "copy_no", "pos", "lost_at")
    found = disjoint_segments(_short_segments(keys, pct, m, seed, step), m)
    found = found.select(*CHUNK_KEYS, "pos", F.struct("start", "stop").alias("_segment"))
    both = gather_parts(df.unionByName(found, allowMissingColumns=True))
    is_packet = F.col("_segment").isNull()
    order = Window.partitionBy(*CHUNK_KEYS).orderBy(F.col("pos").asc_nulls_last(), is_packet)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumns(
        {"_rn": F.count(F.when(is_packet, 1)).over(upto) - 1, "_in": F.last("_segment", ignorenulls=True).over(upto)}
    )
    both = both.filter(is_packet).drop("_segment")
    both = both.withColumn("_member", F.coalesce((F.col("_rn") < F.col("_in.stop")) & alive(), F.lit(False)))
    both = both.withColumns(
        {
            "_slot": F.when(F.col("_member"), F.col("_in.start")).otherwise(F.col("_rn")),
            "_rank": F.when(F.col("_member"), row_draw(seed, f"{step}s")).otherwise(F.lit(0)),
        }
    )
    shuffled = Window.partitionBy(*CHUNK_KEYS).orderBy("_slot", "_rank", "_rn")
    both = both.withColumn("pos", F.when(alive(), (F.row_number().over(shuffled) - 1).cast("long")))
    return mark(both, step, F.col("_member")).drop("_rn", "_in", "_member", "_slot", "_rank").select(*df.columns)


def flag_bernoulli(packets: DataFrame, percent: float, seed: int, step: int = 0) -> DataFrame:
    """Add ``selected``: each packet with probability ``percent`` / 100."""
    return packets.withColumn("selected", chance(row_draw(seed, step), percent / 100))


def exact_thresholds(packets: DataFrame, percent: float, seed: int, step: int = 0) -> DataFrame:
    """Per capture: its total, its k, and the k-th smallest (draw, packet_no).

    Packets are counted in 65,536 draw buckets per capture (partial aggregation first), the
    bucket that holds the k-th draw is found on those counts, and only the packets of that
    bucket are ranked. A capture with most of the rows is therefore never sorted whole.
    """
    drawn = packets.select("capture_id", "packet_no", row_draw(seed, step).alias("_draw"))
    drawn = drawn.withColumn("_bucket", F.shiftright("_draw", 32 - ORDER_BUCKET_BITS))
    counts = drawn.groupBy("capture_id", "_bucket").agg(F.count("*").alias("_count"))
    capture = Window.partitionBy("capture_id")
    running = capture.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumns(
        {"_upto": F.sum("_count").over(running), "total": F.sum("_count").over(capture)}
    )
    wanted = F.bround(F.col("total") * F.lit(percent) / 100).cast("long")
    counts = counts.withColumn("k", F.least(F.greatest(wanted, F.lit(0)), F.col("total")))
    edges = counts.filter(
        (F.col("k") > F.col("_upto") - F.col("_count")) & (F.col("k") <= F.col("_upto"))
    ).select(
        "capture_id",
        "_bucket",
        "total",
        "k",
        (F.col("k") - F.col("_upto") + F.col("_count")).alias("_rank"),
    )
    # One row per capture: while that is small it is broadcast, and no packet is shuffled.
    edges = settle(edges)
    edges = broadcast_if_small(edges, edges.count())
    inside = drawn.join(edges, ["capture_id", "_bucket"])
    by_draw = capture.orderBy("_draw", "packet_no")
    last = inside.withColumn("_rn", F.row_number().over(by_draw)).filter("_rn = _rank")
    return last.select(
        "capture_id",
        "total",
        "k",
        F.col("_draw").alias("last_draw"),
        F.col("packet_no").alias("last_packet_no"),
    )


def flag_exact(
    packets: DataFrame, percent: float, seed: int, step: int = 0, drawn_from: DataFrame | None = None
) -> DataFrame:
    """Add ``selected``: the round(total * percent / 100) packets of each capture with the smallest draws.

    Packets are compared with the threshold of their capture. The thresholds, one row per
    capture, are broadcast while they are small; beyond that it is a plain join. ``drawn_from`` are the
    same packets without what the draws do not need, for the two scans that find the thresholds.
    """
    limits = settle(exact_thresholds(packets if drawn_from is None else drawn_from, percent, seed, step))
    limits = broadcast_if_small(limits, limits.count())
    limits = limits.select("capture_id", "last_draw", "last_packet_no")
    df = packets.withColumn("_draw", row_draw(seed, step)).join(limits, "capture_id", "left")
    hit = (F.col("_draw") < F.col("last_draw")) | (
        (F.col("_draw") == F.col("last_draw")) & (F.col("packet_no") <= F.col("last_packet_no"))
    )
    df = df.withColumn("selected", F.coalesce(hit, F.lit(False)))
    return df.drop("_draw", "last_draw", "last_packet_no")


def count_packets(packets: DataFrame) -> DataFrame:
    """Packets per capture."""
    return packets.groupBy("capture_id").agg(F.count("*").alias("packets"))


def keep_chosen(packets: DataFrame, chosen: DataFrame) -> DataFrame:
    """Packets whose (capture_id, packet_no) is in ``chosen``."""
    return packets.join(chosen.select("capture_id", "packet_no"), ["capture_id", "packet_no"], "left_semi")
