"""The queries in SQL, written from the rules and not from the Spark code."""

from __future__ import annotations

import math

SEED = 7
LOSS, COPY, JITTER, EXACT = (math.ceil(p * 2**32) for p in (0.1, 0.15, 0.6, 0.125))
HALF, QUARTER, FIFTH = (math.ceil(p * 2**32) for p in (0.5, 0.25, 0.2))


def draw(step, keys="capture_id, packet_no, copy_no", part=0) -> str:
    digest = f"md5(concat_ws('|', '{SEED}', '{step}', {keys}))"
    return f"(('0x' || substr({digest}, {8 * part + 1}, 8))::UBIGINT)::BIGINT"


def with_(*tables: str) -> str:
    return "WITH " + ",\n".join(tables) + "\n"


PACKETS = """packets AS (
  SELECT 'day' || (event_id // 5000) || '/cap' || (event_id // 500) AS capture_id,
         event_id % 500 AS packet_no, (event_id % 500) // 100 AS chunk_id,
         0::BIGINT AS copy_no, event_id % 100 AS pos, epoch_us(ts) AS ts_us,
         event_id, user_id, hex(encode(props)) AS pay
  FROM events)"""
# The same captures read back from files that carry one more suffix.
STORED = PACKETS.replace("(event_id // 500) AS", "(event_id // 500) || '.pcap' AS")


def plan_tables(source: str = "packets") -> list[str]:
    """loss, retransmit, reorder in blocks of five, re-timing."""
    block = "capture_id, chunk_id, block"
    return [
        f"kept AS (SELECT * FROM {source} WHERE {draw(0)} >= {LOSS})",
        f"""copied AS (
  SELECT *, 0::BIGINT AS bits FROM kept
  UNION ALL
  SELECT * REPLACE (1::BIGINT AS copy_no, pos + 100 AS pos), 2::BIGINT FROM kept
  WHERE {draw(1)} < {COPY})""",
        """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY capture_id, chunk_id ORDER BY pos) - 1 AS rn,
         count(*) OVER (PARTITION BY capture_id, chunk_id) AS n FROM copied)""",
        "blocked AS (SELECT *, rn // 5 AS block FROM numbered)",
        f"""sized AS (
  SELECT *, {draw(2, block, 0)} AS w0, 2 + {draw(2, block, 1)} % 4 AS size,
         {draw(2, block, 2)} AS w2 FROM blocked)""",
        """placed AS (SELECT *, w2 % (5 - size + 1) AS first FROM sized)""",
        f"""members AS (
  SELECT *, (w0 < {JITTER} AND n > 2 AND rn % 5 >= first AND rn % 5 < first + size) AS member
  FROM placed)""",
        f"""slots AS (
  SELECT *, CASE WHEN member THEN block * 5 + first ELSE rn END AS slot,
         CASE WHEN member THEN {draw('2s')} ELSE 0 END AS shuffle FROM members)""",
        """shuffled AS (
  SELECT * REPLACE (row_number() OVER (PARTITION BY capture_id, chunk_id
                    ORDER BY slot, shuffle, rn) - 1 AS pos),
         bits + CASE WHEN member THEN 4 ELSE 0 END AS applied FROM slots)""",
        *retimed("shuffled"),
    ]


def retimed(source: str) -> list[str]:
    order = "PARTITION BY capture_id, chunk_id ORDER BY pos"
    return [
        f"""gaps AS (
  SELECT *, greatest(ts_us - lag(ts_us) OVER ({order}), 1) AS gap,
         lag(ts_us) OVER ({order}) IS NULL AS opening FROM {source})""",
        f"""timed AS (
  SELECT *, first_value(ts_us) OVER ({order}) +
         sum(CASE WHEN opening THEN 0 ELSE gap END) OVER ({order}) AS t FROM gaps)""",
    ]


KEYS = "capture_id, chunk_id, packet_no, copy_no"
PLANNED = with_(PACKETS, *plan_tables())


def words(h: str) -> str:
    """Sum of the 16-bit words of a hex string."""
    padded = f"rpad({h}, ((length({h}) + 3) // 4 * 4)::INT, '0')"
    return (
        f"list_sum(list_transform(range(0, length({padded}) // 4), "
        f"lambda i: ('0x' || substr({padded}, (4 * i + 1)::INT, 4))::BIGINT))::BIGINT"
    )


PARTS = f"""parts AS (
  SELECT *, event_id % 4 AS kind, event_id % 4 = 2 AS v6, event_id % 4 <> 1 AS tcp,
         '020000000001020000000002' ||
         CASE event_id % 4 WHEN 2 THEN '86DD' WHEN 3 THEN '810000050800' ELSE '0800' END AS eth,
         CASE WHEN event_id % 4 = 1 THEN '11' ELSE '06' END AS proto,
         CASE WHEN event_id % 4 = 2 THEN '20010DB8' || repeat('0', 20) ELSE '0A00' END
           || printf('%04X', user_id % 65536) AS src,
         CASE WHEN event_id % 4 = 2 THEN '20010DB8' || repeat('0', 22) || '01'
              ELSE 'C0A80001' END AS dst,
         (event_id * 1000003) % 4294967296 AS seq
  FROM packets)"""


def framed(name: str, source: str, seq: str = "seq", pay: str = "pay") -> list[str]:
    """Tables that build frames: ``blank`` with checksums zero, ``sealed`` with right ones."""
    return [
        f"{name}_p AS (SELECT *, ({seq}) AS seq2, ({pay}) AS pay2 FROM {source})",
        f"""{name}_s AS (SELECT *, CASE WHEN tcp
    THEN '04D20050' || printf('%08X', seq2) || '0000000750180200' || '00000000' || pay2
    ELSE '003514E9' || printf('%04X', 8 + length(pay2) // 2) || '0000' || pay2 END AS seg FROM {name}_p)""",
        f"""{name}_i AS (SELECT *, CASE WHEN v6
    THEN '60000000' || printf('%04X', length(seg) // 2) || proto || '40' || src || dst
    ELSE '4500' || printf('%04X', 20 + length(seg) // 2) || printf('%04X', event_id % 65536)
         || '400040' || proto || '0000' || src || dst END AS ip FROM {name}_s)""",
        f"""{name}_w AS (SELECT *, {words("ip")} AS ip_words,
    {words("src || dst || seg")} + ('0x' || proto)::BIGINT + length(seg) // 2 AS seg_words FROM {name}_i)""",
        f"""{name}_c AS (SELECT *, (65535 - ip_words % 65535) % 65535 AS ip_check,
    CASE WHEN (65535 - seg_words % 65535) % 65535 = 0 AND NOT tcp THEN 65535
         ELSE (65535 - seg_words % 65535) % 65535 END AS check_ FROM {name}_w)""",
        f"""{name} AS (SELECT *, eth || ip || seg AS blank,
    eth || CASE WHEN v6 THEN ip ELSE substr(ip, 1, 20) || printf('%04X', ip_check) || substr(ip, 25) END
    || CASE WHEN tcp THEN substr(seg, 1, 32) || printf('%04X', check_) || substr(seg, 37)
            ELSE substr(seg, 1, 12) || printf('%04X', check_) || substr(seg, 17) END AS sealed FROM {name}_c)""",
    ]


FRAMES = with_(PACKETS, PARTS, *framed("plain", "parts"))
STORED_FRAMES = with_(STORED, PARTS, *framed("plain", "parts"))

LISTING = """listing AS (
  SELECT 'd' || (event_id % 7) || '/' ||
         CASE event_id % 5 WHEN 0 THEN 'sub/cap' WHEN 1 THEN 'encrypted_pcaps/cap'
              WHEN 2 THEN 'x/Encrypted/y/cap' WHEN 3 THEN 'other' ELSE 'notencrypted/cap host-' END
         || event_id AS capture_id, event_id % 5 AS kind, 'd' || (event_id % 7) AS date_dir, user_id
  FROM events)"""
FOUND = "SELECT *, list_last(string_split(capture_id, '/')) AS base_name FROM listing WHERE kind IN (0, 4)"

HEADS = """heads AS (
  SELECT event_id, event_id % 6 AS magic, event_id % 11 = 10 AS short,
         user_id * 3000 % 400000 AS snap, CASE WHEN event_id % 4 = 0 THEN 101 ELSE 1 END AS link
  FROM events)"""

DAMAGED = """marked AS (
  SELECT *, event_id % 7 = 3 AND packet_no <> 499 AS gone, packet_no = 499 AS last,
         (event_id // 500) % 2 = 1 AS odd FROM packets)"""

FLOWS = f"""drawn AS (
  SELECT *, {draw(0, "l_orderkey, l_linenumber, l_partkey")} AS u FROM lineitem),
flows_before AS (
  SELECT l_orderkey::DOUBLE AS l_orderkey, l_partkey::DOUBLE AS l_partkey,
         l_suppkey::DOUBLE AS l_suppkey, l_linenumber::DOUBLE AS l_linenumber,
         l_quantity, l_extendedprice, l_discount, l_tax,
         CASE WHEN l_linenumber % 2 = 0 THEN 0.0::DOUBLE END AS balance FROM lineitem),
flows_after AS (
  SELECT l_orderkey::DOUBLE AS l_orderkey, l_partkey::DOUBLE AS l_partkey,
         l_suppkey::DOUBLE AS l_suppkey, l_linenumber::DOUBLE AS l_linenumber,
         l_quantity + CASE WHEN l_linenumber = 1 THEN 10 ELSE 0 END AS l_quantity,
         l_extendedprice * 1.05::DOUBLE AS l_extendedprice, l_discount,
         CASE WHEN l_linenumber <> 2 THEN l_tax END AS l_tax,
         CASE WHEN l_linenumber % 2 = 0 THEN l_quantity + CASE WHEN l_linenumber = 1 THEN 10 ELSE 0 END
         END AS balance
  FROM drawn WHERE u >= {FIFTH})"""

FEATURES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]
FEATURES += ["l_discount", "l_tax", "balance"]


def profile(table: str, out: str, names: list[str] = FEATURES) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{n}' AS feature, avg({n}) AS mean, stddev_samp({n}) AS deviation, "
        f"count({n}) AS known FROM {table}"
        for n in names
    )
    return f"{out} AS ({rows})"


DRIFT = with_(
    FLOWS,
    profile("flows_before", "p_before"),
    profile("flows_after", "p_after"),
    """joined AS (
  SELECT b.feature, b.mean AS mean_before, a.mean AS mean_after, a.mean - b.mean AS abs_diff
  FROM p_before b JOIN p_after a USING (feature)
  WHERE (b.deviation IS NULL OR b.deviation <> 0) AND (a.deviation IS NULL OR a.deviation <> 0))""",
    """drift AS (
  SELECT *, round_even(abs_diff / nullif(mean_before, 0) * 100, 2) AS rel_pct FROM joined)""",
    """judged AS (
  SELECT *, coalesce(abs(rel_pct) > 1 OR abs(abs_diff) > 10, false) AS significant FROM drift)""",
)

EXACT_RANKS = f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY {draw(0)}, packet_no) AS rk,
         count(*) OVER (PARTITION BY capture_id) AS total FROM {{}})"""

GROWN = "greatest(1, (octet_length(encode(text)) * 3) // 2)"

# Seven of eight events are one capture; read back, names have a suffix.
HOT = PACKETS.replace("'day' || (event_id // 5000) || '/cap' || (event_id // 500) AS", """CASE WHEN event_id % 8 = 0
         THEN 'day1/cap' || (event_id // 4000) ELSE 'day0/capBig' END || '.pcap' AS""").replace(
    "event_id % 500 AS packet_no, (event_id % 500) // 100 AS chunk_id",
    """CASE WHEN event_id % 8 = 0 THEN (event_id % 4000) // 8 ELSE event_id - event_id // 8 - 1 END AS packet_no,
         packet_no // 100 AS chunk_id""",
)
HOT_FRAMES = with_(HOT, PARTS, *framed("plain", "parts"))
READ_BACK = """capture_id, packet_no, ts_us, length(blank) // 2 AS incl_len, length(blank) // 2 AS orig_len,
         blank AS frame_hex, 1 AS linktype FROM plain"""

CHAINED = with_(
    PACKETS,
    """chained AS (
  SELECT *, event_id % 6 AS kind, (event_id * 1000003) % 4294967296 AS seq, printf('%04X', user_id % 65536) AS who,
         '20010DB8' || repeat('0', 20) || printf('%04X', user_id % 65536) AS src FROM packets)""",
    """headed AS (
  SELECT *, CASE kind WHEN 0 THEN '0600010400000000'
              WHEN 1 THEN '0602000100000000' || '20010DB8' || repeat('0', 18) || 'FF' || who
              WHEN 2 THEN '0600000000000007' WHEN 3 THEN '0600001000000007'
              WHEN 4 THEN '3C000104000000000600010400000000' ELSE '0604' || repeat('0', 44) END AS ext,
         CASE kind WHEN 1 THEN '2B' WHEN 2 THEN '2C' WHEN 3 THEN '2C' WHEN 5 THEN '33' ELSE '00' END AS nh,
         CASE WHEN kind = 1 THEN '20010DB8' || repeat('0', 18) || 'FF' || who
              ELSE '20010DB8' || repeat('0', 22) || '01' END AS last_stop FROM chained)""",
    """segmented AS (
  SELECT *, '04D20050' || printf('%08X', CASE WHEN kind = 3 THEN seq ELSE (seq + 1000) % 4294967296 END)
         || '0000000750180200' || '00000000' || pay AS seg FROM headed)""",
    f"""summed AS (SELECT *, {words("src || last_stop || seg")} + 6 + length(seg) // 2 AS total FROM segmented)""",
)

ORACLE = {
    # sources
    "s1_discover": with_(LISTING) + f"SELECT capture_id, date_dir, base_name FROM ({FOUND})",
    "s2_skip_encrypted": with_(LISTING) + "SELECT capture_id FROM listing WHERE kind NOT IN (1, 2)",
    "s3_limit": with_(LISTING) + f"SELECT capture_id FROM ({FOUND}) ORDER BY capture_id LIMIT 25",
    "s4_sniff": with_(HEADS)
    + """SELECT event_id, CASE WHEN magic < 4 THEN 'pcap' WHEN magic = 4 THEN 'pcapng'
         ELSE 'unknown' END AS kind FROM heads""",
    "s5_header": with_(HEADS)
    + """SELECT event_id, magic IN (1, 3) AS big_endian, magic IN (2, 3) AS nanos,
         CASE WHEN magic = 5 THEN NULL WHEN magic = 4 OR short OR snap = 0 OR snap > 262144 THEN 262144
              ELSE snap END AS snaplen,
         CASE WHEN magic = 4 THEN 1 WHEN magic = 5 OR short THEN NULL ELSE link END AS linktype FROM heads""",
    "s6_scan": STORED_FRAMES
    + """SELECT capture_id, packet_no, ts_us, length(blank) // 2 AS incl_len,
         length(blank) // 2 AS orig_len, blank AS frame_hex, 1 AS linktype FROM plain""",
    "s7_pcapng": with_(PACKETS)
    + """SELECT capture_id, packet_no, ts_us, length(pay) // 2 AS incl_len,
         length(pay) // 2 AS orig_len, pay AS frame_hex, 1 AS linktype FROM packets""",
    "s8_repair": with_(PACKETS, DAMAGED)
    + """SELECT capture_id,
         count(*) FILTER (NOT gone) OVER (PARTITION BY capture_id ORDER BY packet_no
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (NOT gone)::INT AS packet_no,
         ts_us, CASE WHEN gone THEN 0 ELSE length(pay) // 2 END AS incl_len,
         length(pay) // 2 AS orig_len, CASE WHEN NOT gone THEN pay END AS frame_hex,
         CASE WHEN gone THEN 'discarded' WHEN last AND odd THEN 'capped'
              WHEN last THEN 'truncated' END AS repaired FROM marked""",
    "s6_scan_split": HOT_FRAMES + f"SELECT {READ_BACK}",
    "k1_datasource": HOT_FRAMES.replace(" || '.pcap' AS capture_id", " AS capture_id")
    + """SELECT capture_id, ts_us, length(blank) // 2 AS incl_len, length(blank) // 2 AS orig_len, blank AS frame_hex, 1 AS linktype
         FROM plain""",
    "s6_index_range": HOT_FRAMES
    + """SELECT capture_id, packet_no, ts_us, blank AS frame_hex, 'number' AS by FROM plain WHERE packet_no BETWEEN 200 AND 419
         UNION ALL
         SELECT capture_id, packet_no, ts_us, blank, 'time' FROM plain, (SELECT min(ts_us) AS low, max(ts_us) AS high FROM packets)
         WHERE ts_us >= low + (high - low) // 4 AND ts_us < low + (high - low) // 3""",
    "s7_split_be": with_(HOT)
    + """SELECT capture_id, packet_no, ts_us, length(pay) // 2 AS incl_len, length(pay) // 2 AS orig_len, pay AS frame_hex,
         1 AS linktype FROM packets""",
    "s7_damaged": with_(HOT, "marked AS (SELECT *, event_id % 97 = 5 AS bad FROM packets)")
    + """SELECT capture_id, count(*) FILTER (NOT bad) OVER (PARTITION BY capture_id ORDER BY packet_no
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (NOT bad)::INT AS packet_no,
         CASE WHEN bad THEN 0 ELSE ts_us END AS ts_us, CASE WHEN bad THEN 0 ELSE length(pay) // 2 END AS incl_len,
         CASE WHEN bad THEN 0 ELSE length(pay) // 2 END AS orig_len, CASE WHEN NOT bad THEN pay END AS frame_hex,
         CASE WHEN bad THEN 'discarded' END AS repaired FROM marked""",
    "s8_repair_split": with_(HOT, "marked AS (SELECT *, event_id % 7 = 3 AS gone FROM packets)")
    + """SELECT capture_id, count(*) FILTER (NOT gone) OVER (PARTITION BY capture_id ORDER BY packet_no
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (NOT gone)::INT AS packet_no,
         ts_us, CASE WHEN gone THEN 0 ELSE length(pay) // 2 END AS incl_len, length(pay) // 2 AS orig_len,
         CASE WHEN NOT gone THEN pay END AS frame_hex, CASE WHEN gone THEN 'discarded' END AS repaired FROM marked
         UNION ALL SELECT capture_id, count(*) FILTER (NOT gone), 1000002, 10, 10, repeat('AB', 10), 'capped' FROM marked GROUP BY 1""",
    "s8_resync": with_(
        HOT,
        """marked AS (SELECT *, event_id % 101 = 7 AS gap, event_id % 101 = 7 AND (event_id // 101) % 2 = 1 AS lost FROM packets)""",
        """counted AS (SELECT *, count(*) FILTER (NOT lost) OVER (PARTITION BY capture_id ORDER BY packet_no
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM marked)""",
    )
    + """SELECT capture_id, upto - 1 AS packet_no, ts_us, length(pay) // 2 AS incl_len, length(pay) // 2 AS orig_len,
           pay AS frame_hex, NULL AS repaired FROM counted WHERE NOT lost
         UNION ALL SELECT capture_id, upto, 0, 0, 0, NULL, 'discarded' FROM counted WHERE gap""",
    "a6_errors_split": with_(HOT)
    + """SELECT capture_id, CASE WHEN bool_or(event_id % 97 = 5) THEN 1 END AS errors,
         CASE WHEN bool_or(event_id % 97 = 5) THEN 'ValueError: damaged block' END AS error FROM packets GROUP BY 1""",
    "k1_part_files": with_(HOT, PARTS, *framed("plain", "parts"))
    + f"""SELECT capture_id || '.part-' || printf('%05d', part) || '.pcap' AS capture_id,
         row_number() OVER (PARTITION BY capture_id, part ORDER BY packet_no) - 1 AS packet_no,
         length(blank) // 2 AS incl_len, blank AS frame_hex
         FROM (SELECT *, packet_no // 400 AS part FROM plain) WHERE {draw(0)} >= {LOSS}""",
    "s9_chunks": with_(PACKETS) + "SELECT capture_id, packet_no, chunk_id FROM packets",
    "s10_count": with_(PACKETS) + "SELECT capture_id, count(*) AS packets FROM packets GROUP BY 1",
    "s14_flow_csv": "SELECT * FROM lineitem",
    # sinks
    "k1_write": STORED_FRAMES
    + """SELECT capture_id, 24 + sum(16 + length(blank) // 2) AS length, 'pcap' AS kind,
         false AS big_endian, false AS nanos, 65535 AS snaplen, 1 AS linktype FROM plain GROUP BY 1""",
    "k4_patch_time": with_(
        PACKETS, PARTS, *framed("plain", "parts"), *plan_tables("plain")
    )
    + """SELECT capture_id || '.pcap' AS capture_id,
         row_number() OVER (PARTITION BY capture_id ORDER BY chunk_id, pos) - 1 AS packet_no,
         t AS ts_us, length(blank) // 2 AS incl_len, blank AS frame_hex FROM timed""",
    "k5_output": with_(LISTING)
    + f"""SELECT capture_id, '/out/' || capture_id || '.pcap' AS mirrored,
         '/out/' || date_dir || '/' || base_name || '.pcap' AS dated,
         '/out/' || date_dir || '/' || base_name || '.metadata.json' AS metadata_path FROM ({FOUND})""",
    "k5_clashes": """SELECT '/out/d/cap' || user_id || '.pcap' AS output, count(*) AS captures
        FROM events GROUP BY 1 HAVING count(*) > 1""",
    "k6_resume": """SELECT o_orderkey AS capture_id, o_orderstatus FROM orders o
        WHERE NOT EXISTS (SELECT 1 FROM orders d WHERE d.o_orderstatus = 'F' AND d.o_orderkey = o.o_orderkey)""",
    "k6_resume_parts": HOT_FRAMES
    + f"""SELECT capture_id, true AS kept_few, count(*) AS total_in, count(*) FILTER (NOT kept) AS loss_drop,
         count(*) FILTER (kept) AS packets,
         sum(CASE WHEN kept THEN ('0x' || substr(md5(blank), 1, 8))::UBIGINT END)::BIGINT AS frames
         FROM (SELECT *, {draw(0)} >= {LOSS} AS kept FROM plain) GROUP BY 1""",
    "k9_single": with_(PACKETS, PARTS, *framed("plain", "parts"), EXACT_RANKS.format("plain"))
    + """SELECT capture_id || '.pcap' AS capture_id, packet_no, ts_us,
         CASE WHEN rk <= round_even(total * 20 / 100, 0) THEN 48 ELSE length(blank) // 2 END AS incl_len,
         CASE WHEN rk <= round_even(total * 20 / 100, 0)
              THEN substr(blank || repeat('0F', 48), 1, 96) ELSE blank END AS frame_hex FROM ranked""",
    "j1_directory_job": with_(STORED, *plan_tables())
    + f"""SELECT capture_id, 'done' AS status, total_in, total_out, total_in - kept_n AS loss_drop,
         retransmit_dup, reorder_packets
         FROM (SELECT capture_id, count(*) AS total_in FROM packets GROUP BY 1)
         JOIN (SELECT capture_id, count(*) AS kept_n FROM kept GROUP BY 1) USING (capture_id)
         JOIN (SELECT capture_id, count(*) AS total_out, count(*) FILTER (copy_no = 1) AS retransmit_dup,
                      count(*) FILTER (member) AS reorder_packets FROM members GROUP BY 1) USING (capture_id)""",
    # selection
    "r1_draws": with_(PACKETS)
    + f"SELECT {KEYS}, " + ", ".join(f"{draw(3, part=i)} AS draw{i}" for i in range(4)) + " FROM packets",
    "r2_loss": with_(PACKETS) + f"SELECT {KEYS}, ts_us FROM packets WHERE {draw(0)} >= {LOSS}",
    "r3_retransmit": with_(PACKETS)
    + f"""SELECT {KEYS}, pos, ts_us FROM packets UNION ALL
         SELECT capture_id, chunk_id, packet_no, 1, pos + 100, ts_us FROM packets WHERE {draw(1)} < {COPY}""",
    "r4_adjacent": with_(PACKETS)
    + f"""SELECT {KEYS}, pos * 2 AS pos, ts_us FROM packets UNION ALL
         SELECT capture_id, chunk_id, packet_no, 1, pos * 2 + 1, ts_us FROM packets WHERE {draw(1)} < {COPY}""",
    "j1_greedy": with_(STORED)
    + """SELECT capture_id, 'done' AS status, count(*) AS total_in, count(*) AS total_out,
         count(DISTINCT chunk_id // 2) AS parts FROM packets GROUP BY 1""",
    "k7_runs": with_(STORED)
    + """SELECT capture_id, 'second' AS run_id, '[{"type": "loss", "pct": 0.1, "params": {}}]' AS plan,
         7 AS seed, 100 AS chunk_size, CASE WHEN min(event_id // 500) % 5 = 0 THEN 'skipped' ELSE 'done' END AS status,
         CASE WHEN min(event_id // 500) % 5 = 0 THEN 'exists' END AS reason, NULL::VARCHAR AS error,
         CASE WHEN min(event_id // 500) % 5 <> 0 THEN count(*) END AS total_in
         FROM packets GROUP BY 1""",
    "k9_job": with_(STORED)
    + """SELECT capture_id, 'done' AS status, NULL::VARCHAR AS error, count(*) AS total,
         round_even(count(*) * 20 / 100, 0)::BIGINT AS perturbed, true AS has_file FROM packets GROUP BY 1
         UNION ALL SELECT 'odd/capEmpty', 'done', NULL, 0, 0, true
         UNION ALL SELECT 'odd/capUnknown', 'error', 'unknown capture format', NULL, NULL, NULL""",
    # Segments are tried one by one here, by priority, against all that stand.
    "r5_greedy": "WITH RECURSIVE "
    + ",\n".join(
        [
            PACKETS,
            f"""placed AS (SELECT *, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY capture_id, chunk_id) AS n
  FROM packets WINDOW w AS (PARTITION BY capture_id, chunk_id ORDER BY pos))""",
            f"""tries AS (SELECT capture_id, chunk_id, rn AS a, least(rn + 2 + {draw(2, part=1)} % 4, n) AS b,
         row_number() OVER (PARTITION BY capture_id, chunk_id ORDER BY {draw(2, part=2)}, rn) AS k
  FROM placed WHERE n > 2 AND {draw(2)} < {JITTER})""",
            """taken AS (
  SELECT DISTINCT capture_id, chunk_id, 0::BIGINT AS k, []::STRUCT(a BIGINT, b BIGINT)[] AS segments FROM placed
  UNION ALL
  SELECT t.capture_id, t.chunk_id, r.k, CASE WHEN len(list_filter(t.segments, lambda s: s.a < r.b AND s.b > r.a)) = 0
         THEN list_append(t.segments, {'a': r.a, 'b': r.b}) ELSE t.segments END
  FROM taken t JOIN tries r ON r.capture_id = t.capture_id AND r.chunk_id = t.chunk_id AND r.k = t.k + 1)""",
            """segments AS (
  SELECT capture_id, chunk_id, unnest(segments, recursive := true) FROM (
    SELECT * FROM taken QUALIFY k = max(k) OVER (PARTITION BY capture_id, chunk_id)))""",
            """members AS (
  SELECT p.*, s.a FROM placed p LEFT JOIN segments s
    ON s.capture_id = p.capture_id AND s.chunk_id = p.chunk_id AND p.rn >= s.a AND p.rn < s.b)""",
        ]
    )
    + f"""
SELECT {KEYS}, row_number() OVER (PARTITION BY capture_id, chunk_id
         ORDER BY coalesce(a, rn), CASE WHEN a IS NULL THEN 0 ELSE {draw('2s')} END, rn) - 1 AS pos,
       CASE WHEN a IS NULL THEN 0 ELSE 4 END AS applied FROM members""",
    "r5_greedy_facts": with_(PACKETS)
    + """SELECT capture_id, chunk_id, count(*) AS packets, count(*) AS positions, true AS near,
         false AS moved_unflagged, true AS some_flagged FROM packets GROUP BY 1, 2""",
    "u1_rowwise": PLANNED
    + f"""SELECT capture_id, chunk_id, packet_no, copy_no + 2 * nth AS copy_no, pos, t AS ts_new_us,
         CASE WHEN NOT flag THEN applied WHEN nth = 0 THEN applied + 8 ELSE 8 END AS applied,
         length(pay) // 2 + longer::INT AS orig_len, pay || CASE WHEN longer THEN '21' ELSE '' END AS frame_hex
         FROM (SELECT *, flag AND (digit < 7 OR nth = 1) AS longer
               FROM (SELECT *, {draw(3)} < {HALF} AS flag, ('0x' || substr(pay, length(pay) - 3, 2))::INT - 48 AS digit FROM timed),
                    range(3) r(nth)
               WHERE nth = 0 AND (NOT flag OR digit >= 4) OR nth > 0 AND flag AND digit >= 7)""",
    "u1_drops_first_part": STORED_FRAMES
    + """SELECT capture_id || '.pcap' AS capture_id, packet_no - 230 AS packet_no, blank AS frame_hex
         FROM plain WHERE packet_no >= 230""",
    "r5_blocks": with_(PACKETS, "kept AS (SELECT *, 0::BIGINT AS bits FROM packets)", *plan_tables()[2:])
    .replace("FROM copied", "FROM kept")
    + f"SELECT {KEYS}, pos, applied FROM shuffled",
    "r6_exact": with_(PACKETS, EXACT_RANKS.format("packets"))
    + "SELECT capture_id, packet_no, rk <= round_even(total * 12.5 / 100, 0) AS selected FROM ranked",
    "r7_bernoulli": with_(PACKETS) + f"SELECT capture_id, packet_no, {draw(0)} < {EXACT} AS selected FROM packets",
    "r8_content_sampling": with_(
        PACKETS,
        f"""copied AS (SELECT *, 0 AS bits FROM packets UNION ALL
          SELECT * REPLACE (1 AS copy_no), 1 FROM packets WHERE {draw(0)} < {COPY})""",
    )
    + f"""SELECT {KEYS}, bits + CASE WHEN {draw(1)} < {HALF} AND event_id % 4 <> 1 THEN 2 ELSE 0 END
         + CASE WHEN {draw(2)} < {QUARTER} THEN 4 ELSE 0 END AS applied FROM copied""",
    "r9_rate_modify": with_(
        PACKETS,
        """numbered AS (SELECT *, row_number() OVER (PARTITION BY capture_id, chunk_id ORDER BY pos) - 1 AS i
          FROM packets)""",
        """repeated AS (
          SELECT capture_id, chunk_id, packet_no, 0 AS copy_no, i AS place, 0 AS second FROM numbered
          UNION ALL
          SELECT a.capture_id, a.chunk_id, b.packet_no, 1, a.i, 1 FROM numbered a JOIN numbered b
            ON a.capture_id = b.capture_id AND a.chunk_id = b.chunk_id AND b.i = greatest(0, a.i - 1)
          WHERE a.i % 4 = 2)""",
    )
    + f"""SELECT {KEYS}, row_number() OVER (PARTITION BY capture_id, chunk_id ORDER BY place, second) - 1 AS out_no
         FROM repeated""",
    "r11_plan": PLANNED + f"SELECT {KEYS}, pos, t AS ts_new_us, applied FROM timed",
    "r13_chosen": with_(PACKETS)
    + """SELECT capture_id, packet_no, ts_us FROM packets
         WHERE event_id IN (SELECT event_id FROM events WHERE event_type = 'click')""",
    "w2_retime": with_(PACKETS, *plan_tables()[:2], *retimed("copied")) + f"SELECT {KEYS}, t AS ts_new_us FROM timed",
    "w3_positions": with_(PACKETS, *plan_tables()[:1])
    + f"""SELECT {KEYS}, row_number() OVER (PARTITION BY capture_id, chunk_id ORDER BY pos) - 1 AS out_no FROM kept""",
    # bytes
    "b1_header": FRAMES
    + """SELECT event_id, CASE WHEN v6 THEN 34525 ELSE 2048 END AS eth_type,
         CASE WHEN kind = 3 THEN 18 ELSE 14 END AS l3_off, CASE WHEN v6 THEN 40 ELSE 20 END AS ihl,
         (length(ip) + length(seg)) // 2 AS ip_total_len, CASE WHEN tcp THEN 6 ELSE 17 END AS proto,
         (length(eth) + length(ip)) // 2 AS l4_off, CASE WHEN tcp THEN seq END AS tcp_seq,
         (length(blank) - length(pay)) // 2 AS payload_off, length(pay) // 2 AS payload_len,
         true AS has_ip, tcp AS has_tcp, NOT tcp AS has_udp FROM plain""",
    "b1_chain": CHAINED
    + """SELECT event_id, 40 + length(ext) // 2 AS ihl, 54 + length(ext) // 2 AS l4_off,
         40 + (length(ext) + length(seg)) // 2 AS ip_total_len, 6 AS proto, CASE WHEN kind <> 3 THEN seq END AS tcp_seq,
         54 + length(ext) // 2 + CASE WHEN kind = 3 THEN 0 ELSE 20 END AS payload_off,
         length(pay) // 2 + CASE WHEN kind = 3 THEN 20 ELSE 0 END AS payload_len, kind <> 3 AS has_tcp FROM summed""",
    "b2_chain": CHAINED
    + """SELECT event_id, kind <> 3 AS flag, '02000000000102000000000286DD60000000'
         || printf('%04X', (length(ext) + length(seg)) // 2) || nh || '40' || src || '20010DB8' || repeat('0', 22) || '01' || ext
         || CASE WHEN kind = 3 THEN seg ELSE
              substr(seg, 1, 32) || printf('%04X', (65535 - total % 65535) % 65535) || substr(seg, 37) END AS frame_hex
         FROM summed""",
    "b4_incremental": with_(PACKETS, PARTS, *framed("plain", "parts", "(seq + CASE WHEN tcp THEN 70000 ELSE 0 END) % 4294967296"))
    + "SELECT event_id, CASE WHEN tcp THEN sealed ELSE blank END AS frame_hex, tcp AS flag FROM plain",
    "b2_seq_offset": with_(PACKETS, PARTS, *framed("plain", "parts", "(seq + 1000) % 4294967296"))
    + f"""SELECT event_id, CASE WHEN tcp AND {draw(0)} < {HALF} THEN sealed
           ELSE eth || ip || CASE WHEN tcp THEN substr(seg, 1, 8) || printf('%08X', seq) || substr(seg, 17)
                                  ELSE seg END END AS frame_hex,
         CASE WHEN tcp AND {draw(0)} < {HALF} THEN 1 ELSE 0 END AS applied FROM plain""",
    "b3_ip_checksum": FRAMES + "SELECT event_id, ip_check AS checksum FROM plain WHERE NOT v6",
    "b4_l4_checksum": FRAMES
    + "SELECT event_id, CASE WHEN tcp THEN sealed ELSE blank END AS frame_hex, tcp AS flag FROM plain",
    "b5_lengths": FRAMES
    + """SELECT event_id, (length(ip) + length(seg) - length(pay)) // 2 + 24 AS ip_total_len,
         24 AS payload_len FROM plain""",
    "b6_length_forge": f"""SELECT doc_id, n AS n_bytes,
         md5(substr(h || repeat('AA', (n - length(h) // 2)::BIGINT), 1, (n * 2)::BIGINT)) AS digest
         FROM (SELECT doc_id, hex(encode(text)) AS h,
               CASE WHEN text = '' THEN 32 ELSE {GROWN} END AS n FROM documents)""",
    "b7_dummy": f"""SELECT doc_id, n AS n_bytes, md5(h || repeat('55', (n - length(h) // 2)::BIGINT)) AS digest
         FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN hex(encode(text)) ELSE '' END AS h,
               CASE WHEN lang = 'en' AND text <> '' THEN {GROWN} ELSE 32 END AS n FROM documents)""",
    "b8_forged_frames": with_(
        PACKETS, PARTS, *framed("plain", "parts", pay="substr(pay || repeat('EE', 24), 1, 48)")
    )
    + "SELECT event_id, sealed AS frame_hex FROM plain",
    "b11_fixed_len": f"""SELECT doc_id, selected,
         CASE WHEN selected THEN 256 ELSE length(h) // 2 END AS orig_len,
         md5(CASE WHEN selected THEN substr(h || repeat('0F', 256), 1, 512) ELSE h END) AS digest
         FROM (SELECT doc_id, hex(encode(text)) AS h, {draw(0, "source, doc_id, 0")} < {FIFTH} AS selected
               FROM documents)""",
    "b12_guard": with_(PACKETS, PARTS, *framed("plain", "parts", "(seq + 5) % 4294967296"))
    + f"""SELECT event_id, CASE WHEN tcp AND {draw(0)} < {HALF} AND {draw(1)} >= {QUARTER} THEN sealed
           ELSE eth || ip || CASE WHEN tcp THEN substr(seg, 1, 8) || printf('%08X', seq) || substr(seg, 17)
                                  ELSE seg END END AS frame_hex,
         CASE WHEN tcp AND {draw(0)} < {HALF} AND {draw(1)} >= {QUARTER} THEN 1 ELSE 0 END AS applied FROM plain""",
    "b13_passthrough": with_(PACKETS, PARTS, *framed("plain", "parts", "(seq + 7) % 4294967296"))
    + """SELECT event_id, tcp AND event_id % 3 <> 0 AS flag, CASE WHEN tcp AND event_id % 3 <> 0 THEN sealed
           ELSE eth || ip || CASE WHEN tcp THEN substr(seg, 1, 8) || printf('%08X', seq) || substr(seg, 17)
                                  ELSE seg END END AS frame_hex FROM plain""",
    # statistics
    "a1_totals": PLANNED
    + """SELECT capture_id, total_in, total_out
         FROM (SELECT capture_id, count(*) AS total_in FROM packets GROUP BY 1)
         JOIN (SELECT capture_id, count(*) AS total_out FROM copied GROUP BY 1) USING (capture_id)""",
    "a2_loss": with_(PACKETS)
    + f"SELECT capture_id, count(*) FILTER ({draw(0)} < {LOSS}) AS loss_drop FROM packets GROUP BY 1",
    "a3_duplicates": PLANNED
    + "SELECT capture_id, count(*) FILTER (copy_no = 1) AS retransmit_dup FROM copied GROUP BY 1",
    "a4_reordered": PLANNED
    + "SELECT capture_id, count(*) FILTER (member) AS reorder_packets FROM members GROUP BY 1",
    "a5_repairs": with_(
        PACKETS,
        DAMAGED,
        """read AS (SELECT capture_id, gone, last, 0 AS copy_no,
             count(*) FILTER (NOT gone) OVER (PARTITION BY capture_id ORDER BY packet_no
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (NOT gone)::INT AS packet_no FROM marked)""",
    )
    + f"""SELECT capture_id, count(*) FILTER (NOT gone) AS total_in, count(*) FILTER (last) AS repaired_packets,
         count(*) FILTER (gone) AS discarded_records,
         count(*) FILTER (NOT gone AND {draw(0)} < {LOSS}) AS loss_drop FROM read GROUP BY 1""",
    "a6_errors": with_(PACKETS)
    + """SELECT capture_id, CASE WHEN min(event_id // 500) % 3 = 0 THEN 0 ELSE count(*) END AS packets,
         CASE WHEN min(event_id // 500) % 3 = 0 THEN 'ValueError: unknown capture format' END AS error
         FROM packets GROUP BY capture_id""",
    "a7_selected": with_(PACKETS)
    + f"""SELECT capture_id, count(*) AS total, count(*) FILTER ({draw(0)} < {EXACT}) AS perturbed
         FROM packets GROUP BY 1""",
    # drift
    "dr_clean": DRIFT + "SELECT feature FROM judged",
    "dr4_constant": with_(
        "more AS (SELECT *, l_tax * 2 AS idle, 3 AS constant FROM lineitem)",
        profile("more", "p", FEATURES[:8] + ["idle", "constant"]),
    )
    + """SELECT CASE feature WHEN 'idle' THEN 'Flow IDLE Mean' ELSE feature END AS feature FROM p
         WHERE deviation IS NULL OR deviation <> 0""",
    "dr7_means": with_(
        FLOWS,
        f"""more AS (SELECT a.*, i.idle, 3 AS constant FROM flows_after a POSITIONAL JOIN
             (SELECT l_tax * 2 AS idle FROM drawn WHERE u >= {FIFTH}) i)""",
        profile("more", "p", FEATURES[:8] + ["idle", "constant", "balance"]),
    )
    + """SELECT CASE feature WHEN 'idle' THEN 'Flow IDLE Mean' ELSE feature END AS feature,
         round(mean, 8) AS mean, round(deviation, 8) AS deviation, known FROM p""",
    "dr8_drift": DRIFT
    + """SELECT feature, round(mean_before, 8) AS mean_before, round(mean_after, 8) AS mean_after,
         round(abs_diff, 8) AS abs_diff, rel_pct, significant FROM judged""",
    "dr12_ranked": DRIFT
    + """SELECT feature, rel_pct, round(abs_diff, 8) AS abs_diff FROM judged WHERE significant
         ORDER BY abs(rel_pct) DESC NULLS LAST, feature""",
    "dr13_topk": DRIFT
    + """SELECT feature, rel_pct FROM judged WHERE significant
         ORDER BY abs(rel_pct) DESC NULLS LAST, feature LIMIT 3""",
    "dr14_hist": """WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n,
           ceil(log2(count(*)) + 1)::INT AS nb FROM lineitem),
         b AS (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / nb))::INT, nb - 1) AS bin FROM lineitem, s),
         c AS (SELECT bin, count(*) AS c FROM b GROUP BY 1)
         SELECT r.i::INT AS bin, round(lo + r.i * ((hi - lo) / nb), 6) AS left, coalesce(c, 0) AS count,
           round(coalesce(c, 0) / (n * ((hi - lo) / nb)), 12) AS density
         FROM s CROSS JOIN range((SELECT nb FROM s)) r(i) LEFT JOIN c ON c.bin = r.i""",
    "dr15_kde": """WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n,
           stddev_samp(l_extendedprice) * power(count(*), -0.2) AS h FROM lineitem),
         g AS (SELECT r.i::INT AS point, lo + r.i * ((hi - lo) / 199) AS x, n, h FROM s, range(200) r(i))
         SELECT point, round(x, 6) AS x, round(sum(exp(-0.5 * ((x - l_extendedprice) / h) *
           ((x - l_extendedprice) / h))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 12) AS density
         FROM g, lineitem GROUP BY point, x""",
    "dr16_row_delta": with_(FLOWS)
    + """SELECT b AS rows_before, a AS rows_after, b - a AS rows_lost, round_even(100.0 * (b - a) / b, 2) AS lost_pct
         FROM (SELECT count(*) AS b FROM flows_before), (SELECT count(*) AS a FROM flows_after)""",
    "dr17_chart": DRIFT
    + """SELECT feature, round(mean_before, 8) AS mean_before, round(mean_after, 8) AS mean_after
         FROM judged WHERE significant ORDER BY abs(rel_pct) DESC NULLS LAST, feature LIMIT 20""",
    "dr18_significant": DRIFT
    + "SELECT count(*) FILTER (significant) AS significant, count(*) AS compared FROM judged",
    # streams and custom steps
    "st1_stream": with_(STORED, *plan_tables()[:2]) + f"SELECT {KEYS}, pos, ts_us FROM copied",
    "st1_stream_job": with_(STORED, PARTS, *framed("plain", "parts"), *plan_tables("plain"))
    + """SELECT capture_id || '.pcap' AS capture_id,
         row_number() OVER (PARTITION BY capture_id ORDER BY chunk_id, pos) - 1 AS packet_no,
         t AS ts_us, length(blank) // 2 AS incl_len FROM timed""",
    "u1_custom_step": with_(
        PACKETS,
        f"kept AS (SELECT * FROM packets WHERE packet_no % 3 = 0 AND {draw(1)} >= {LOSS})",
        *retimed("kept"),
    )
    + f"SELECT {KEYS}, t AS ts_new_us FROM timed",
}

# Bins by the larger number of Sturges' and the interquartile rule; runs of empty ones are joined.
ORACLE["dr14_hist_auto"] = """WITH s AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS n,
    greatest(ceil(log2(count(*)) + 1), ceil((max(l_quantity) - min(l_quantity)) /
      (2 * (quantile_disc(l_quantity, 0.75) - quantile_disc(l_quantity, 0.25)) * power(count(*), -1.0 / 3))))::INT AS nb FROM lineitem),
  b AS (SELECT least(floor((l_quantity - lo) / ((hi - lo) / nb))::INT, nb - 1) AS bin FROM lineitem, s),
  c AS (SELECT r.i AS bin, count(b.bin) AS n FROM range((SELECT nb FROM s)) r(i) LEFT JOIN b ON b.bin = r.i GROUP BY 1),
  g AS (SELECT *, CASE WHEN n > 0 THEN bin ELSE -1 - (bin - row_number() OVER (PARTITION BY n > 0 ORDER BY bin)) END AS run FROM c)
  SELECT round(lo + min(bin) * ((hi - lo) / nb), 6) AS left, round(count(*) * ((hi - lo) / nb), 6) AS width, sum(g.n)::BIGINT AS count,
    round(sum(g.n) / (s.n * (count(*) * ((hi - lo) / nb))), 12) AS density
  FROM g, s GROUP BY run, g.n > 0, lo, hi, nb, s.n"""


def distribution(table: str, side: str, name: str) -> str:
    value = f"(SELECT {name} AS v FROM {table} WHERE {name} IS NOT NULL)"
    facts = f"""(SELECT min(v) AS lo, max(v) AS hi, count(*) AS n, ceil(log2(count(*)) + 1)::INT AS nb,
      stddev_samp(v) * power(count(*), -0.2) AS h FROM {value})"""
    return f"""
      SELECT '{side}' AS side, '{name}' AS feature, 'histogram' AS kind, round(lo + min(bin) * w, 6) AS x, round(count(*) * w, 6) AS width,
        sum(c)::BIGINT AS count, round(sum(c) / (n * count(*) * w), 9) AS density
      FROM (SELECT *, CASE WHEN c > 0 THEN bin ELSE -1 - (bin - row_number() OVER (PARTITION BY c > 0 ORDER BY bin)) END AS run
        FROM (SELECT r.i AS bin, count(b.v) AS c, any_value(s.lo) AS lo, any_value(s.n) AS n, any_value((s.hi - s.lo) / s.nb) AS w
          FROM {facts} s JOIN range(64) r(i) ON r.i < s.nb
          LEFT JOIN (SELECT v, least(floor((v - lo) / ((hi - lo) / nb))::INT, nb - 1) AS bin FROM {value}, {facts}) b ON b.bin = r.i
          GROUP BY r.i)) GROUP BY run, c > 0, lo, n, w
      UNION ALL
      SELECT '{side}', '{name}', 'curve', round(x, 6), NULL, NULL,
        round(sum(exp(-0.5 * ((x - v) / h) * ((x - v) / h))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9)
      FROM (SELECT r.i, lo + r.i * ((hi - lo) / 199) AS x, n, h FROM {facts}, range(200) r(i)), {value} GROUP BY i, x"""


CURVED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey"]
ORACLE["dr_distributions"] = with_(FLOWS) + " UNION ALL ".join(
    distribution(f"flows_{side}", side, name) for side in ("before", "after") for name in CURVED
)
ORACLE["st1_growing"] = ORACLE["k1_part_files"]
ORACLE["b4_l4_checksum_native"] = ORACLE["b4_l4_checksum"]
