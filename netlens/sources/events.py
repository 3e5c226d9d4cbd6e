"""Sensor events (JSON lines), counter logs, marks and decision logs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from netlens.functions.columns import dns_name, in_scope, parse_ts_us

EVENT = (
    "event_type string, timestamp string, flow_id long, community_id string, tx_id long, src_ip string, src_port int, dest_ip string, dest_port int, proto string, vlan array<int>, "
    "http struct<url:string,status:string,http_method:string>, "
    "dns struct<type:string,id:long,rrname:string,rrtype:string,rcode:string,queries:array<struct<rrname:string,rrtype:string>>>, tls struct<version:string>, "
    "flow struct<start:string,end:string,pkts_toserver:long,pkts_toclient:long,bytes_toserver:long,bytes_toclient:long>, alert struct<signature_id:long,signature:string>, "
    "stats struct<uptime:long,capture:struct<kernel_packets:long,kernel_drops:long>>, _corrupt string"
)
DECISION = (
    "event string, decision_id string, entity_ip string, window_end_utc string, logged_at double, decision string, detector_name string, score double, threshold double, "
    "heuristicos array<struct<heuristico:string,accion:string,motivo:string>>, http_vista struct<httph_peticiones_60s:double,httph_fallo_auth_ratio_60s:double>, auth_failure struct<autoriza:boolean>"
)


def parse_events(lines: DataFrame, on_error: str = "fail", value: str = "value") -> DataFrame:
    """Events of JSON lines under an explicit schema; a line that is no JSON fails the job or,
    with ``count``, stays with its text in ``_corrupt``. Lines without a timestamp are dropped."""
    e = F.from_json(value, EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    x = lines.where(F.length(F.trim(value)) > 0).select(*[c for c in lines.columns if c != value], e.alias("e")).select(*[c for c in lines.columns if c != value], "e.*")
    if on_error == "fail":
        message = F.concat(F.lit("invalid event line: "), F.col("_corrupt"))
        return x.where(F.when(F.col("_corrupt").isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))).drop("_corrupt")
    return x


def read_events(spark: SparkSession, path: str, on_error: str = "fail", contains: str | None = None) -> DataFrame:
    """Event files. ``contains`` drops lines without the text before they are parsed."""
    lines = spark.read.text(path)
    return parse_events(lines.where(F.col("value").contains(contains)) if contains else lines, on_error)


def app_observations(events: DataFrame, scope: str) -> DataFrame:
    """HTTP, DNS query, DNS NXDOMAIN and TLS observations of entities in scope.

    Answers carry the addresses of their flow, so the asker is ``src_ip`` there too. TLS
    falls back to the destination when the source is out of scope.
    """
    keep = [c for c in events.columns if c in ("arrival", "file", "rec_no")]
    ts = parse_ts_us(F.col("timestamp")).alias("ts_us")
    src, dst = in_scope(F.col("src_ip"), scope), in_scope(F.col("dest_ip"), scope)
    e = events.where("timestamp is not null and timestamp <> ''")
    status = F.coalesce(F.col("http.status").try_cast("int"), F.lit(0))
    lit = lambda v: F.lit(v)
    rows = lambda df, ip, kind, status=lit(0), method=lit(""), name=lit(""), key=lit(""), version=lit(""): df.select(
        *keep, ts, ip.alias("entity_ip"), lit(kind).alias("kind"), status.alias("status"), method.alias("method"), name.alias("dns_name"), key.alias("event_key"), version.alias("tls_version"))
    http = rows(e.where((F.col("event_type") == "http") & src), F.col("src_ip"), "http", status, F.upper(F.coalesce("http.http_method", lit(""))))
    dns = e.where((F.col("event_type") == "dns") & src)
    query = rows(dns.where("dns.type = 'query'"), F.col("src_ip"), "dns_query", name=dns_name())
    nx = rows(dns.where("dns.type = 'answer' and dns.rcode = 'NXDOMAIN'"), F.col("src_ip"), "dns_nxdomain")
    owner = F.when(src, F.col("src_ip")).when(dst, F.col("dest_ip"))
    key = F.coalesce(F.col("flow_id").cast("string"), F.nullif(F.col("community_id"), lit("")), F.col("timestamp"))
    tls = rows(e.where((F.col("event_type") == "tls") & (src | dst)), owner, "tls", key=key, version=F.coalesce("tls.version", lit("")))
    return http.unionByName(query).unionByName(nx).unionByName(tls)


def app_observations_basic(events: DataFrame, scope: str) -> DataFrame:
    """The first contract: HTTP error flag, DNS kinds and the TLS key only."""
    x = app_observations(events, scope)
    keep = [c for c in x.columns if c in ("arrival", "file", "rec_no")]
    error = ((F.col("kind") == "http") & (F.col("status") >= 400)) | (F.col("kind") == "dns_nxdomain")
    return x.select(*keep, "ts_us", "entity_ip", "kind", error.alias("error"), "event_key")


def flow_starts(events: DataFrame, ips: list[str] | None, t0_us: int, t1_us: int) -> DataFrame:
    """Start of every flow of the addresses in [t0, t1)."""
    t = parse_ts_us(F.col("flow.start"))
    x = events.where("event_type = 'flow'").select("src_ip", "dest_ip", "dest_port", "proto", t.alias("ts_us"))
    x = x.where((F.col("ts_us") >= t0_us) & (F.col("ts_us") < t1_us))
    return x.where(F.col("src_ip").isin(ips)) if ips is not None else x


def flow_volumes(events: DataFrame, t0_us: int, t1_us: int) -> DataFrame:
    """Flows that end inside [t0, t1] with packets and bytes of both directions added."""
    c = F.col
    z = lambda a: F.coalesce(c(a), F.lit(0))
    x = events.where("event_type = 'flow'").select(
        "src_ip", "dest_ip", "dest_port", parse_ts_us(c("flow.end")).alias("end_us"), (z("flow.pkts_toserver") + z("flow.pkts_toclient")).alias("packets"), (z("flow.bytes_toserver") + z("flow.bytes_toclient")).alias("bytes"))
    return x.where(c("end_us").between(t0_us, t1_us))


def volume_per_client(flows: DataFrame, server: str) -> DataFrame:
    c = F.col
    client = F.when(c("dest_ip") == server, c("src_ip")).otherwise(c("dest_ip"))
    x = flows.where((c("dest_ip") == server) | (c("src_ip") == server))
    return x.groupBy(client.alias("client")).agg(F.count(F.lit(1)).alias("flows"), F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"))


def stats_samples(events: DataFrame) -> DataFrame:
    """Counter samples per instant: sample, repeated, conflict or invalid. 0 and missing stay apart."""
    c = F.col
    pos = lambda e: F.when(c(e) >= 0, c(e))
    s = events.where("event_type = 'stats'").select(parse_ts_us(c("timestamp")).alias("ts_us"), pos("stats.uptime").alias("uptime_s"), pos("stats.capture.kernel_packets").alias("packets"), pos("stats.capture.kernel_drops").alias("drops"))
    key = F.struct(F.coalesce("uptime_s", F.lit(-1)), F.coalesce("packets", F.lit(-1)), F.coalesce("drops", F.lit(-1)))
    g = s.groupBy("ts_us").agg(F.count(F.lit(1)).alias("copies"), F.count_distinct(key).alias("versions"), F.min_by(F.struct("uptime_s", "packets", "drops"), key).alias("v"))
    state = F.when(c("ts_us").isNull(), "invalid").when(c("versions") > 1, "conflict").when(c("copies") > 1, "repeated").otherwise("sample")
    return g.select("ts_us", "copies", state.alias("state"), "v.*")


_HEAD = r"^(\d{1,2})/(\d{1,2})/(\d{4}) -- (\d{2}):(\d{2}):(\d{2}) \(uptime: (\d+)d, (\d+)h (\d+)m (\d+)s\)"


def stats_blocks(blocks: DataFrame, value: str = "value") -> DataFrame:
    """Counter blocks of a text log, each beginning with its date: instant, uptime, counters."""
    v = F.col(value)
    g = lambda i: F.regexp_extract(v, _HEAD, i)
    x = blocks.where(v.rlike(_HEAD))
    ts = F.unix_micros(F.make_timestamp(g(3).cast("int"), g(1).cast("int"), g(2).cast("int"), g(4).cast("int"), g(5).cast("int"), g(6).cast("int")))
    up = g(7).cast("long") * 86400 + g(8).cast("long") * 3600 + g(9).cast("long") * 60 + g(10).cast("long")
    counter = lambda name: F.nullif(F.regexp_extract(v, rf"(?m)^{name}\s*\|\s*Total\s*\|\s*(\d+)", 1), F.lit("")).cast("long")
    return x.select(ts.alias("ts_us"), up.alias("uptime_s"), counter(r"capture\.kernel_packets").alias("packets"), counter(r"capture\.kernel_drops").alias("drops"))


def read_stats_log(spark: SparkSession, path: str) -> DataFrame:
    """A block is one record when the date prefix is the separator, so no state crosses lines."""
    return stats_blocks(spark.read.option("lineSep", "Date: ").text(path))


def alert_marks(events: DataFrame, t0_us: int, t1_us: int) -> DataFrame:
    """Both addresses of every alert with its instant, in [t0, t1)."""
    x = events.where("event_type = 'alert'").select(parse_ts_us(F.col("timestamp")).alias("mark_us"), F.explode(F.array("src_ip", "dest_ip")).alias("entity_ip"))
    return x.where((F.col("mark_us") >= t0_us) & (F.col("mark_us") < t1_us) & F.col("entity_ip").isNotNull() & (F.col("entity_ip") != ""))


def alerts_to_signals(events: DataFrame, sid_min: int, sid_max: int) -> DataFrame:
    """Alerts of a signature range as fast signals with a stable identity."""
    x = events.where((F.col("event_type") == "alert") & F.col("alert.signature_id").between(sid_min, sid_max))
    text = F.concat_ws("|", "src_ip", "dest_ip", F.col("timestamp"), F.col("alert.signature_id").cast("string"))
    return x.select("src_ip", "dest_ip", parse_ts_us(F.col("timestamp")).alias("trigger_us"), F.col("alert.signature_id").alias("sid"), F.substring(F.sha2(text, 256), 1, 16).alias("signal_id"))


def read_decisions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Decision log with its rotated and compressed generations; other records are left out."""
    x = spark.read.schema(DECISION).json(paths)
    return x.where("event = 'decision'").withColumn("window_us", parse_ts_us(F.col("window_end_utc")))


def episodes(marks: DataFrame) -> DataFrame:
    """Start and end marks folded into one row per episode; an open one is ``sin_fin``."""
    c = F.col
    at = lambda event, col: F.min(F.when(c("evento") == event, c(col)))
    x = marks.where("episodio_id is not null").groupBy("episodio_id").agg(
        at("inicio", "ts_us").alias("t0_us"), F.max(F.when(c("evento") == "fin", c("ts_us"))).alias("t1_us"), at("inicio", "escenario").alias("scenario"), at("inicio", "destino").alias("destination"), F.max(F.when(c("evento") == "fin", c("estado"))).alias("_end"))
    return x.where("t0_us is not null").select(c("episodio_id").alias("episode_id"), "t0_us", "t1_us", "scenario", "destination", F.when(c("t1_us").isNull(), "sin_fin").otherwise(F.coalesce("_end", F.lit("ok"))).alias("state"))


def slice_events(events: DataFrame, t0_us: int, t1_us: int, before_us: int, after_us: int) -> DataFrame:
    return events.where((F.col("ts_us") >= t0_us - before_us) & (F.col("ts_us") <= t1_us + after_us))


def drop_before_packets(app: DataFrame, packets: DataFrame) -> DataFrame:
    """Events before the first packet describe traffic no packet column can see."""
    first = packets.agg(F.min("ts_us").alias("_first"))
    return app.join(F.broadcast(first)).where(F.col("ts_us") >= F.col("_first")).drop("_first")  # one row
