"""Queries S01-S27. Files and lines are derived from the given tables by Spark itself."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from netlens.operators import features as FT, prep, rules as R
from netlens.operators.core import materialize, scratch_path
from netlens.operators.learn import content_digest
from netlens.plans import q_features  # noqa: F401  (named subqueries)
from netlens.plans.adapt import DAY_US as D, SCOPE, SQL_VIEWS, STEP_US as S, sql, table, view
from netlens.plans.q_prep import H
from netlens.plans.registry import add, r6
from netlens.sources import capture as C, events as EV, pcap as P, tables as TB

PER_FILE = 500


def hx(c: Column, digits: int) -> Column:
    return F.lpad(F.hex(c.cast("long")), digits, "0")


def swap(h: Column, n: int) -> Column:
    """Byte order of an n-byte hex text reversed."""
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(n))])


def ip_hex(c: Column) -> Column:
    return F.concat(*[hx(F.split(c, r"\.")[i].cast("int"), 2) for i in range(4)])


def frame_hex(p: DataFrame) -> Column:
    """Ethernet frame of a packet row as hex text; every fifth is untagged, every seventh double-tagged."""
    c = F.col
    n = c("arrival")
    tag = F.concat(F.lit("8100"), hx(c("vlan"), 4))
    tags = F.when(n % 5 == 0, "").when(n % 7 == 0, F.concat(tag, F.lit("81000063"))).otherwise(tag)
    ip = F.concat(F.lit("4500"), hx(c("ip_length"), 4), hx(c("ip_id"), 4), F.when(c("fragmented"), "2000").otherwise("4000"), hx(c("ttl"), 2), hx(c("protocol"), 2), F.lit("0000"), ip_hex(c("src_ip")), ip_hex(c("dst_ip")))
    tcp = F.concat(hx(c("src_port"), 4), hx(c("dst_port"), 4), hx(c("tcp_seq"), 8), F.lit("0000000050"), hx(c("tcp_flags"), 2), F.lit("ffff00000000"))
    udp = F.concat(hx(c("src_port"), 4), hx(c("dst_port"), 4), F.lit("00080000"))
    icmp = F.concat(hx(F.greatest(c("icmp_type"), F.lit(0)), 2), F.lit("000000"), hx(F.greatest(c("icmp_id"), F.lit(0)), 4), F.lit("0001"))
    body = F.when(c("protocol") == 6, tcp).when(c("protocol") == 17, udp).otherwise(icmp)
    arp = F.concat(F.lit("0806"), F.lit("000108000604"), F.when(n % 2 == 0, "0001").otherwise("0002"), F.lit("0200000000aa"), ip_hex(c("src_ip")), F.lit("000000000000"), ip_hex(c("dst_ip")))
    is_arp = n % 13 == 0
    return F.concat(F.lit("0200000000bb0200000000"), hx(n % 4, 2), tags, F.when(is_arp, arp).otherwise(F.concat(F.lit("0800"), ip, body)))


def records(p: DataFrame, fno: Column) -> DataFrame:
    """Capture records of packet rows as hex text: fno, arrival, rec; the number of a file tells its format."""
    x = p.select(fno.alias("fno"), "arrival", "ts_us", frame_hex(p).alias("h"))
    big, nano = _format()
    word = lambda v: F.when(big, hx(v, 8)).otherwise(swap(hx(v, 8), 4))
    size = F.length("h") / 2
    frac = F.pmod("ts_us", F.lit(1_000_000)) * F.when(nano, 1000).otherwise(1)
    rec = F.concat(word(F.floor(F.col("ts_us") / 1_000_000)), word(frac), word(size), word(size), "h")
    return x.select("fno", "arrival", rec.alias("rec"))


def _format() -> tuple[Column, Column]:
    return F.col("fno") % 2 == 1, F.col("fno") % 4 >= 2


def file_head() -> Column:
    big, nano = _format()
    magic = F.when(big & nano, "a1b23c4d").when(big, "a1b2c3d4").when(nano, "4d3cb2a1").otherwise("d4c3b2a1")
    return F.concat(magic, F.when(big, "00020004").otherwise("02000400"), F.lit("0000000000000000"), F.when(big, "0000ffff").otherwise("ffff0000"), F.when(big, "00000001").otherwise("01000000"))


def captures(s, d, damaged: bool = False) -> DataFrame:
    """Capture files of 500 packets each in all four formats; on request some lose their tail."""
    x = records(table(s, d, "packets"), F.floor(F.col("arrival") / PER_FILE).cast("long"))
    g = x.groupBy("fno").agg(F.sort_array(F.collect_list(F.struct("arrival", "rec"))).alias("rs"))  # 500 packets per file
    text = F.concat(file_head(), F.array_join(F.transform("rs", lambda r: r["rec"]), ""))
    if damaged:
        g = g.withColumn("t", text)
        text = F.when(F.col("fno") % 6 == 5, F.expr("substring(t, 1, length(t) - 6)")).when(F.col("fno") % 9 == 4, F.concat(F.lit("00000000"), F.col("t"))).otherwise(F.col("t"))
    return g.select(F.concat(F.lit("f"), F.col("fno").cast("string")).alias("path"), F.unhex(text).alias("content"))


def frames(s, d):
    return P.frames_of(captures(s, d))


view("frm", "packets", f"SELECT *, 'f'||(arrival//{PER_FILE}) AS file, row_number() OVER (PARTITION BY arrival//{PER_FILE} ORDER BY arrival)-1 AS rec_no FROM packets")
SPLIT, TASK = 16_384, 32 << 20


def s01(s, d):
    folder = scratch_path(s)
    C.write_files(captures(s, d), folder)
    x = C.numbered(C.read_capture(s, folder, SPLIT, task=TASK), SPLIT)
    return x.select(F.element_at(F.split("file", "/"), -1).alias("file"), "rec_no", "ts_us", F.length("frame").cast("int").alias("size"))


add("S01_pcap_frames", s01, sql("frm", """SELECT file, rec_no, ts_us,
 CAST(14+CASE WHEN arrival%5=0 THEN 0 WHEN arrival%7=0 THEN 8 ELSE 4 END+CASE WHEN arrival%13=0 THEN 28 WHEN protocol=6 THEN 40 ELSE 28 END AS INT) AS size FROM frm"""))
add("S02_unreadable_files", lambda s, d: P.unreadable(P.frames_of(captures(s, d, True), "count")), sql("frm", """SELECT CASE WHEN n%6=5 THEN 'truncated frame' ELSE 'unsupported magic' END AS error, CAST(count(*) AS BIGINT) AS files
 FROM (SELECT DISTINCT CAST(substr(file,2) AS BIGINT) AS n FROM frm) WHERE n%6=5 OR n%9=4 GROUP BY 1"""))
DEC = """file, rec_no, ts_us, src_ip, dst_ip, ip_length, protocol, ttl, fragmented, src_port, dst_port, tcp_flags, tcp_seq, tcp_payload_length, icmp_type, CASE WHEN protocol=1 THEN icmp_id ELSE 0 END AS icmp_id"""
add("S03_decode_packets", lambda s, d: P.decode_packets(frames(s, d)).drop("vlan", "ip_id"), sql("frm", f"SELECT {DEC} FROM frm WHERE arrival%13<>0"))
add("S04_decode_basic", lambda s, d: P.decode_packets_basic(frames(s, d)), sql("frm", "SELECT file, rec_no, ts_us, src_ip, dst_ip, ip_length, protocol, src_port, dst_port, tcp_flags FROM frm WHERE arrival%13<>0"))
add("S05_decode_l2", lambda s, d: P.decode_l2(frames(s, d)), sql("frm", """SELECT file, rec_no, ts_us, CASE WHEN arrival%5=0 THEN 0 ELSE vlan END AS vlan, '02:00:00:00:00:0'||(arrival%4) AS src_mac, src_ip AS sender_ip, arrival%13=0 AND arrival%2=0 AS arp_request,
 CASE WHEN arrival%13=0 THEN -1 ELSE protocol END AS protocol FROM frm"""))
add("S06_frame_context", lambda s, d: P.decode_packets(frames(s, d)).select("file", "rec_no", "vlan", "ip_id"), sql("frm", "SELECT file, rec_no, CASE WHEN arrival%5=0 THEN 0 ELSE vlan END AS vlan, ip_id FROM frm WHERE arrival%13<>0"))


# --- sensor events -------------------------------------------------------------------------------

def iso(c: Column, style: Column | None = None) -> Column:
    base = F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(base, F.lit("+0000"))


def lines(s, d) -> DataFrame:
    """JSON lines of every event type, one per row of ``events``."""
    x = table(s, d, "dns").join(table(s, d, "ev").select(F.col("event_id").alias("arrival"), "k", "user_id", "event_type"), "arrival")
    n = F.col("arrival")
    kind = F.element_at(F.array(*map(F.lit, ("http", "dns", "tls", "flow", "alert", "stats"))), (n % 6 + 1).cast("int"))
    st = F.struct
    k = F.col("k")
    src = F.when((n % 6 == 2) & (k % 3 == 0), "172.16.0.1").otherwise(F.col("src_ip"))
    body = st(
        kind.alias("event_type"), F.when(n % 97 > 0, iso(F.col("ts_us"))).alias("timestamp"), F.when(k % 4 > 0, n * 10).alias("flow_id"), src.alias("src_ip"), F.col("src_port"), F.when(n % 6 == 2, F.col("src_ip")).otherwise(F.col("dest_ip")).alias("dest_ip"), F.lit(53).alias("dest_port"),
        F.when(n % 6 == 0, st((F.lit(200) + k * 3).alias("status"), F.when(k % 5 > 0, "get").alias("http_method"))).alias("http"),
        F.when(n % 6 == 1, st(F.col("dns_event").alias("type"), F.col("name").alias("rrname"), F.nullif("rcode", F.lit("")).alias("rcode"))).alias("dns"),
        F.when(n % 6 == 2, st(F.when(k % 2 == 0, "TLS 1.3").alias("version"))).alias("tls"),
        F.when(n % 6 == 3, st(iso(F.col("ts_us") - H).alias("start"), iso(F.col("ts_us")).alias("end"), k.alias("pkts_toserver"), (k * 2).alias("pkts_toclient"), (k * 100).alias("bytes_toserver"), F.when(k % 9 > 0, k * 10).alias("bytes_toclient"))).alias("flow"),
        F.when(n % 6 == 4, st((F.lit(9_000_000) + k).alias("signature_id"))).alias("alert"),
        F.when(n % 6 == 5, st(n.alias("uptime"), F.when(k % 8 > 0, st((n * 3).alias("kernel_packets"), F.when(k % 7 > 0, F.floor(n / 90)).alias("kernel_drops"))).alias("capture"))).alias("stats"))
    return x.select("arrival", F.to_json(body).alias("value"))


def events(s, d):
    return EV.parse_events(lines(s, d))


view("lj", "dns ev", """SELECT dns.*, ev.k, ev.event_type, CASE WHEN dns.arrival%6=2 AND k%3=0 THEN '172.16.0.1' ELSE src_ip END AS src, CASE WHEN dns.arrival%6=2 THEN src_ip ELSE dest_ip END AS dst, dns.arrival%97>0 AS hast,
  strftime(make_timestamp(dns.ts_us), '%Y-%m-%dT%H:%M:%S.%f')||'+0000' AS iso, dns.arrival AS n FROM dns JOIN ev ON ev.event_id=dns.arrival""")
view("appo", "lj", """SELECT n AS arrival, ts_us, src AS entity_ip, 'http' AS kind, 200+k*3 AS status, CASE WHEN k%5>0 THEN 'GET' ELSE '' END AS method, '' AS dns_name, '' AS event_key, '' AS tls_version FROM lj WHERE n%6=0 AND hast AND src LIKE '10.10.%'
 UNION ALL SELECT n, ts_us, src, CASE WHEN dns_event='query' THEN 'dns_query' ELSE 'dns_nxdomain' END, 0, '', CASE WHEN dns_event='query' THEN name ELSE '' END, '', '' FROM lj WHERE n%6=1 AND hast AND src LIKE '10.10.%' AND (dns_event='query' OR rcode='NXDOMAIN')
 UNION ALL SELECT n, ts_us, CASE WHEN src LIKE '10.10.%' THEN src ELSE dst END, 'tls', 0, '', '', CASE WHEN k%4>0 THEN CAST(n*10 AS STRING) ELSE iso END, CASE WHEN k%2=0 THEN 'TLS 1.3' ELSE '' END FROM lj WHERE n%6=2 AND hast""")
add("S07_app_observations", lambda s, d: EV.app_observations(events(s, d), SCOPE), sql("appo", "SELECT * FROM appo"))
add("S08_app_basic", lambda s, d: EV.app_observations_basic(events(s, d), SCOPE), sql("appo", "SELECT arrival, ts_us, entity_ip, kind, (kind='http' AND status>=400) OR kind='dns_nxdomain' AS error, event_key FROM appo"))


def span(s, d):
    t = table(s, d, "ev").agg(F.min("ts_us"), F.max("ts_us")).first()
    return t[0] + 4 * D, t[1] - 4 * D


A, B = f"((SELECT min(ts_us) FROM ev)+{4 * D})", f"((SELECT max(ts_us) FROM ev)-{4 * D})"
add("S09_flow_starts", lambda s, d: EV.flow_starts(events(s, d), None, *span(s, d)).select("src_ip", "ts_us"), sql("lj", f"SELECT src AS src_ip, ts_us-{H} AS ts_us FROM lj WHERE n%6=3 AND ts_us-{H} >= {A} AND ts_us-{H} < {B}"))


def s10(s, d):
    f = EV.flow_volumes(events(s, d), *span(s, d))
    return EV.volume_per_client(f, "9.9.9.9").unionByName(EV.volume_per_client(f, "10.10.1.1"))


add("S10_flow_volumes", s10, sql("lj", f"""WITH f AS (SELECT src, dst, k*3 AS p, k*100+CASE WHEN k%9>0 THEN k*10 ELSE 0 END AS b FROM lj WHERE n%6=3 AND ts_us BETWEEN {A} AND {B})
SELECT src AS client, CAST(count(*) AS BIGINT) AS flows, CAST(sum(p) AS BIGINT) AS packets, CAST(sum(b) AS BIGINT) AS bytes FROM f WHERE dst='9.9.9.9' GROUP BY 1
UNION ALL SELECT CASE WHEN dst='10.10.1.1' THEN src ELSE dst END, CAST(count(*) AS BIGINT), CAST(sum(p) AS BIGINT), CAST(sum(b) AS BIGINT) FROM f WHERE dst='10.10.1.1' OR src='10.10.1.1' GROUP BY 1"""))


def s11(s, d):
    x = lines(s, d)
    again = x.where("arrival % 30 = 5")
    odd = again.where("arrival % 60 = 5").withColumn("value", F.regexp_replace("value", '"uptime":', '"uptime":1'))
    return EV.stats_samples(EV.parse_events(x.unionByName(again).unionByName(odd))).where("ts_us is not null")


add("S11_stats_samples", s11, sql("lj", """SELECT ts_us, CAST(CASE WHEN n%60=5 THEN 3 WHEN n%30=5 THEN 2 ELSE 1 END AS BIGINT) AS copies, CASE WHEN n%60=5 THEN 'conflict' WHEN n%30=5 THEN 'repeated' ELSE 'sample' END AS state, n AS uptime_s,
  CASE WHEN k%8>0 THEN n*3 END AS packets, CASE WHEN k%8>0 AND k%7>0 THEN n//90 END AS drops FROM lj WHERE n%6=5 AND hast"""))


def s12(s, d):
    """Counter blocks written as text by Spark and read back through the block separator."""
    x = table(s, d, "ev")
    t = F.timestamp_micros("ts_us")
    up = F.col("event_id") * 8
    head = F.concat(F.lit("Date: "), F.date_format(t, "M/d/yyyy -- HH:mm:ss"), F.format_string(" (uptime: %dd, %02dh %02dm %02ds)", F.floor(up / 86400), F.floor(up % 86400 / 3600), F.floor(up % 3600 / 60), up % 60))
    rule = F.lit("-" * 20)
    rows = [head, rule, F.format_string("%-28s | Total | %d", F.lit("capture.kernel_packets"), F.col("event_id") * 7), F.when(F.col("k") % 6 > 0, F.format_string("%-28s | Total | %d", F.lit("capture.kernel_drops"), F.col("k"))), rule]
    path = scratch_path(s)
    x.select(F.concat_ws("\n", *rows)).write.text(path)
    return EV.read_stats_log(s, path)


add("S12_stats_log", s12, sql("ev", "SELECT ts_us//1000000*1000000 AS ts_us, event_id*8 AS uptime_s, event_id*7 AS packets, CASE WHEN k%6>0 THEN CAST(k AS BIGINT) END AS drops FROM ev"))
add("S13_alert_marks", lambda s, d: EV.alert_marks(events(s, d), *span(s, d)), sql("lj", f"SELECT ts_us AS mark_us, unnest([src, dst]) AS entity_ip FROM lj WHERE n%6=4 AND hast AND ts_us >= {A} AND ts_us < {B}"))
add("S14_alerts_to_signals", lambda s, d: EV.alerts_to_signals(events(s, d), 9_000_020, 9_000_060).where("trigger_us is not null"),
    sql("lj", "SELECT src AS src_ip, dst AS dest_ip, ts_us AS trigger_us, CAST(9000000+k AS BIGINT) AS sid, substr(sha256(src||'|'||dst||'|'||iso||'|'||(9000000+k)),1,16) AS signal_id FROM lj WHERE n%6=4 AND hast AND k BETWEEN 20 AND 60"))


def s15(s, d):
    """A current log and a compressed older generation, written and read as one table."""
    x = table(s, d, "dec")
    end = F.date_format(F.timestamp_micros("window_us"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    h = F.filter(F.array(*[F.struct(F.col(f"rule{i}").alias("heuristico"), F.lit("BLOCK").alias("accion")) for i in (1, 2)]), lambda r: r["heuristico"] != "")
    rec = x.select(F.when(F.col("k") % 10 == 9, "ciclo").otherwise("decision").alias("event"), "decision_id", "entity_ip", end.alias("window_end_utc"), "decision", "detector_name", "score", h.alias("heuristicos"), "k", "arrival")
    a, b = scratch_path(s), scratch_path(s)
    rec.where("arrival % 3 > 0").drop("k", "arrival").write.json(a)
    rec.where("arrival % 3 = 0").drop("k", "arrival").write.option("compression", "gzip").json(b)
    return EV.read_decisions(s, [a, b]).select("decision_id", "window_us", "decision", F.size("heuristicos").alias("rules"))


add("S15_read_decisions", s15, sql("dec", "SELECT decision_id, window_us, decision, CAST((rule1<>'')::INT+(rule2<>'')::INT AS INT) AS rules FROM dec WHERE k%10<>9"))


def s16(s, d):
    x = table(s, d, "ev")
    m = x.select(F.concat(F.lit("e"), F.floor(F.col("event_id") / 2).cast("string")).alias("episodio_id"), F.when(F.col("event_id") % 2 == 0, "inicio").when(F.col("k") % 4 > 0, "fin").otherwise("nota").alias("evento"), "ts_us",
                 F.concat(F.lit("s"), (F.col("k") % 5).cast("string")).alias("escenario"), F.concat(F.lit("10.20.0."), (F.col("k") % 3).cast("string")).alias("destino"), F.when(F.col("k") % 7 == 0, "fallido").alias("estado"))
    return EV.episodes(m)


add("S16_episode_marks", s16, sql("ev", """SELECT 'e'||a.event_id//2 AS episode_id, a.ts_us AS t0_us, CASE WHEN b.k%4>0 THEN b.ts_us END AS t1_us, 's'||(a.k%5) AS scenario, '10.20.0.'||(a.k%3) AS destination, CASE WHEN b.k IS NULL OR b.k%4=0 THEN 'sin_fin' WHEN b.k%7=0 THEN 'fallido' ELSE 'ok' END AS state
 FROM ev a LEFT JOIN ev b ON b.event_id=a.event_id+1 WHERE a.event_id%2=0"""))
META, NAMES = ["campaign_id", "entity_ip", "window_us", "eligible_training"], ["x1", "x2", "x3", "x6"]


def written(s, d):
    x = table(s, d, "ds").withColumnRenamed("eligible", "eligible_training").withColumns({"x6": F.col("x6") / 3, "row": F.col("row_id")})
    path = scratch_path(s)
    TB.write_features(x, path, META, NAMES, "csv")
    return TB.read_features_csv(s, path, META, NAMES)


ROWS = "campaign_id, entity_ip, CAST(window_us AS STRING) AS window_us, eligible AS eligible_training, x1, x2, x3, round(x6/3,8) AS x6"
add("S17_read_features_csv", written, sql("ds", f"SELECT {ROWS} FROM ds"))
add("S18_write_features", lambda s, d: written(s, d).groupBy("campaign_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if("eligible_training").alias("eligible"), F.round(F.sum("x1"), 4).alias("x1"), F.round(F.sum("x6"), 4).alias("x6")),
    sql("ds", "SELECT campaign_id, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE eligible) AS BIGINT) AS eligible, round(sum(x1),4) AS x1, round(sum(round(x6/3,8)),4) AS x6 FROM ds GROUP BY 1"))


def s20(s, d):
    rows = table(s, d, "app").select("entity_ip", ((F.col("ts_us") + S - 1) / S).cast("long").alias("b")).distinct().select("entity_ip", (F.col("b") * S).alias("window_us"))
    old = rows.where(F.pmod(F.col("window_us") / S, F.lit(3)) == 0)
    return TB.accumulate(rows, old, span(s, d), 2 * D, D, ["10.10.1.0/27"])


add("S20_accumulate", s20, sql("app", f"""SELECT DISTINCT entity_ip, (ts_us+{S}-1)//{S}*{S} AS window_us FROM app WHERE (ts_us+{S}-1)//{S}*{S} BETWEEN {A}+{2 * D} AND {B}-{D} AND ((ts_us+{S}-1)//{S})%3<>0 AND CAST(split_part(entity_ip,'.',4) AS INT)>=32"""))


def s21(s, d):
    a, b = span(s, d)
    x = EV.slice_events(table(s, d, "app"), a, b, 9 * H, H)
    return EV.drop_before_packets(x, table(s, d, "packets").where(F.col("ts_us") >= a)).select("arrival", "kind")


add("S21_slice_events", s21, sql("app", f"SELECT arrival, kind FROM app WHERE ts_us >= (SELECT min(ts_us) FROM ev WHERE ts_us >= {A}) AND ts_us <= {B}+{H}"))


def s22(s, d):
    a, b = span(s, d)
    p = P.decode_packets(P.slice_frames(frames(s, d), a, b)).withColumn("arrival", F.col("rec_no"))
    return P.slice_dns(p, "10.20.0.3", a, b, 24 * H).select("file", "rec_no", "src_ip", "dst_ip")


add("S22_slice_frames", s22, sql("frm", f"""WITH p AS (SELECT *, lag(ts_us) OVER (PARTITION BY src_ip, dst_ip, src_port, dst_port, ip_length, ip_id ORDER BY ts_us, rec_no) AS pt FROM frm WHERE arrival%13<>0 AND ts_us BETWEEN {A} AND {B} AND protocol=17 AND ((dst_ip='10.20.0.3' AND dst_port=53) OR (src_ip='10.20.0.3' AND src_port=53)))
SELECT file, rec_no, src_ip, dst_ip FROM p WHERE pt IS NULL OR ts_us-pt >= {24 * H}"""))


def s23(s, d):
    x = table(s, d, "ev").select(F.concat(F.lit("d"), (F.col("user_id") % 9).cast("string")).alias("directory"), F.col("event_id").alias("file"), F.col("ts_us").alias("start_us"))
    return P.closed_files(x, "start_us", 12 * D, span(s, d)[1] + 4 * D)


add("S23_closed_files", s23, sql("ev", f"SELECT 'd'||(user_id%9) AS directory, event_id AS file, ts_us AS start_us FROM ev e WHERE ts_us < (SELECT max(ts_us) FROM ev f WHERE f.user_id%9=e.user_id%9) AND (SELECT max(ts_us) FROM ev)-ts_us <= {12 * D}"))
add("S26_file_inventory", lambda s, d: P.file_inventory(P.frames_of(captures(s, d, True), "count")), sql("frm", """WITH g AS (SELECT file, CAST(substr(file,2) AS BIGINT) AS n, count(*) AS c, min(ts_us) AS a, max(ts_us) AS b FROM frm GROUP BY 1, 2),
 l AS (SELECT file, max(ts_us) AS b2 FROM (SELECT *, max(rec_no) OVER (PARTITION BY file) AS m FROM frm) WHERE rec_no<m GROUP BY 1)
SELECT g.file, CAST(CASE WHEN n%6=5 THEN c-1 WHEN n%9=4 THEN 0 ELSE c END AS BIGINT) AS records, CASE WHEN n%6<>5 AND n%9=4 THEN NULL ELSE a END AS first_us, CASE WHEN n%6=5 THEN b2 WHEN n%9=4 THEN NULL ELSE b END AS last_us,
 CASE WHEN n%6=5 THEN 'truncated frame' WHEN n%9=4 THEN 'unsupported magic' END AS error FROM g LEFT JOIN l USING (file)"""))


def s27(s, d):
    x = table(s, d, "ds")
    path = scratch_path(s)
    dig = TB.write_lot(x, path, ["row_id", "label"])
    back = content_digest(s.read.schema("row_id long, label string").parquet(path), [], ["row_id", "label"])
    return dig.select("rows", "xor_digest").join(F.broadcast(back.select(F.col("rows").alias("rows_back"), F.col("xor_digest").alias("digest_back"))))  # one row each


add("S27_content_digest", s27, sql("ds", "WITH g AS (SELECT CAST(count(*) AS BIGINT) AS n, bit_xor(CAST('0x'||substr(sha256(row_id||'|'||label),1,15) AS BIGINT)) AS x FROM ds) SELECT n AS rows, x AS xor_digest, n AS rows_back, x AS digest_back FROM g"))


# --- from capture files to rules ------------------------------------------------------------------

# Packets of one hour share their instant and are dealt to seven files, so that time alone orders few of them
# and record numbers repeat from file to file: only (time, file, record) tells which packet of a flow came first.
FILES = 7
CHAIN = ("packets", "flowed", "firsts", "owned", "obs", "stamps", "grid", "g3")


def _in_files(text: str) -> str:
    return re.sub(rf"\b({'|'.join(CHAIN)})\b(?!\.)", r"\1_cap", text)


view("packets_cap", "packets", f"""SELECT ts_us - ts_us % {H} AS ts_us, (arrival % {FILES}) * 1000000000 + arrival AS arrival, src_ip, dst_ip, protocol, src_port, dst_port, ip_length, ttl, fragmented,
 tcp_flags, tcp_seq, tcp_payload_length, icmp_type, CASE WHEN protocol=1 THEN icmp_id ELSE 0 END AS icmp_id FROM packets WHERE arrival % 13 <> 0""")
for _name in CHAIN[1:]:
    _needs, _text = SQL_VIEWS[_name]
    view(f"{_name}_cap", _in_files(" ".join(_needs)), _in_files(_text))
LOW = R.THRESHOLDS | {"port_scan": R.THRESHOLDS["port_scan"] | {
    "min_flow_attempt_30s": 3, "min_unique_dst_port_ratio_30s": 0.6, "max_syn_completion_ratio_10s": 0.2, "min_flow_attempt_burst_30s": 4, "max_syn_completion_burst_10s": 0.5, "min_unique_dst_port_ratio_burst_30s": 0.9}}


def capture_to_rules(s, d):
    p = table(s, d, "packets").withColumn("ts_us", F.col("ts_us") - F.pmod("ts_us", F.lit(H)))
    x = records(p, F.pmod("arrival", F.lit(FILES)).cast("long"))
    folder = scratch_path(s)
    C.write_records(x.select(F.concat(F.lit("f"), F.col("fno").cast("string")).alias("path"), "arrival", F.unhex(file_head()).alias("head"), F.unhex("rec").alias("record")), "arrival", folder)
    frames = C.read_capture(s, folder, 4 * SPLIT, task=TASK)
    packets = materialize(P.decode_packets(frames, "arrival"))  # read by four branches
    names = ["flow_attempt_count_30s", "unique_dst_port_ratio_30s", "syn_completion_ratio_10s", "tcp_retransmission_ratio_10s", "flow_duration_mean_30s"]
    rows = FT.features(prep.attribute(packets, SCOPE), table(s, d, "app"), None, S, names)
    top = R.top_rule(R.all_rules(rows, LOW))
    return r6(top.select("entity_ip", "anchor", *names, F.col("top.rule").alias("rule"))).withColumn("flow_duration_mean_30s", F.floor(F.col("flow_duration_mean_30s") * 1000 + 0.2603).cast("long"))


add("T05_capture_to_rules", capture_to_rules, sql("g3_cap", """
WITH d AS (SELECT entity_ip, a, avg(m) AS m FROM (SELECT entity_ip, a, max(flow_duration_us) AS m FROM g3_cap WHERE ts_us IS NOT NULL GROUP BY entity_ip, a, peer_ip, target_port, protocol) GROUP BY 1, 2),
f AS (SELECT entity_ip, a, count(*) FILTER (WHERE flow_attempt) AS att, count(DISTINCT target_port) FILTER (WHERE flow_attempt AND target_port > 0) AS ports, count(*) FILTER (WHERE flow_attempt AND target_port > 0) AS attp,
  count(*) FILTER (WHERE here AND syn) AS syn, count(*) FILTER (WHERE here AND syn_ack) AS ack, count(*) FILTER (WHERE here AND retransmission) AS re, count(*) FILTER (WHERE here AND protocol=6 AND tcp_payload_length>0) AS seg FROM g3_cap GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN attp=0 THEN 0.0 ELSE ports/CAST(attp AS DOUBLE) END AS up, CASE WHEN syn=0 THEN 0.0 ELSE least(syn, ack)/CAST(syn AS DOUBLE) END AS sc, CASE WHEN seg=0 THEN 0.0 ELSE re/CAST(seg AS DOUBLE) END AS rr FROM f LEFT JOIN d USING (entity_ip, a))
SELECT entity_ip, CAST(a AS BIGINT) AS anchor, CAST(att AS BIGINT) AS flow_attempt_count_30s, round(up,6) AS unique_dst_port_ratio_30s, round(sc,6) AS syn_completion_ratio_10s, round(rr,6) AS tcp_retransmission_ratio_10s,
 CAST(floor(round(coalesce(m,0)/1000000,6)*1000 + 0.2603) AS BIGINT) AS flow_duration_mean_30s,
 CASE WHEN (att >= 3 AND up >= 0.6 AND sc <= 0.2) OR (att >= 4 AND sc <= 0.5 AND up >= 0.9) THEN 'port_scan' END AS rule FROM r"""))
