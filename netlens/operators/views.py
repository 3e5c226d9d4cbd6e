"""Corrective views: own name-service queries without forwards, HTTP seen on the wire."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netlens.functions.columns import ceil_bucket, safe_ratio, tcp_pair_key
from netlens.operators.core import MINUTE, SECOND, asof, hop

QUERY_FLOW = ["src_ip", "src_port", "dest_ip", "dns_id", "name"]


def classify_queries(queries: DataFrame, resolvers: list[str], delta_us: int = 2 * SECOND, slice_us: int = MINUTE) -> DataFrame:
    """Queries with ``query_class`` and, for forwards, the client they serve.

    client: not sent by a resolver. inter_resolver: between resolvers. forward: a resolver
    asks outside and a client asked a resolver the same (name, type) at most ``delta_us``
    before. own: a resolver's other queries.
    """
    src_r, dst_r = F.col("src_ip").isin(resolvers), F.col("dest_ip").isin(resolvers)
    clients = queries.where(~src_r & dst_r)
    seen = asof(queries, clients, ["name", "rrtype"], "ts_us", "ts_us", {"ts_us": "client_ts", "src_ip": "client"}, slice_us, tie=["src_ip"])
    near = F.col("ts_us") - F.col("client_ts") <= delta_us
    kind = (
        F.when(~src_r, F.lit("client")).when(dst_r, F.lit("inter_resolver"))
        .when(near, F.lit("forward")).otherwise(F.lit("own"))
    )
    x = seen.withColumn("query_class", kind)
    return x.withColumn("client", F.when(F.col("query_class") == "forward", F.col("client"))).drop("client_ts")


def nx_flows(answers: DataFrame) -> DataFrame:
    """Last NXDOMAIN answer of each query flow."""
    return answers.where("rcode = 'NXDOMAIN'").groupBy(*QUERY_FLOW).agg(F.max("ts_us").alias("nx_ts"))


def dns_attribution(dns: DataFrame, resolvers: list[str], delta_us: int = 2 * SECOND, slice_us: int = MINUTE) -> DataFrame:
    """Classified queries with ``nx``: some answer of the flow said the name does not exist."""
    q = classify_queries(dns.where("dns_event = 'query'"), resolvers, delta_us, slice_us)
    nx = nx_flows(dns.where("dns_event = 'answer'"))
    return q.join(nx, QUERY_FLOW, "left").withColumn("nx", F.col("nx_ts").isNotNull())


def parent_domain(name: F.Column) -> F.Column:
    """Name without its first label when at least two labels remain."""
    return F.when(F.size(F.split(name, r"\.")) > 2, F.regexp_replace(name, r"^[^.]*\.", "")).otherwise(name)


def attribution_counts(classified: DataFrame) -> DataFrame:
    """Resolver x class x answer counts, forwards per client, own queries per parent domain."""
    r = classified.where("query_class <> 'client'")
    one = F.count(F.lit(1)).alias("n")
    ok = F.when(F.col("nx"), F.lit("NX")).otherwise(F.lit("ok"))
    a = r.groupBy(F.lit("resolver").alias("section"), F.concat_ws("|", "src_ip", "query_class", ok).alias("key")).agg(one)
    b = r.where("query_class = 'forward'").groupBy(F.lit("client").alias("section"), F.col("client").alias("key")).agg(one)
    c = r.where("query_class = 'own'").groupBy(F.lit("own_domain").alias("section"), parent_domain(F.col("name")).alias("key")).agg(one)
    return a.unionByName(b).unionByName(c)


def clients_behind(classified: DataFrame, fired: DataFrame, step_us: int) -> DataFrame:
    """Clients whose non-existing names were forwarded inside windows where a resolver's rule fired."""
    f = classified.where("query_class = 'forward' and nx").withColumn("bucket", ceil_bucket(F.col("ts_us"), step_us))
    f = f.groupBy("src_ip", "client", "bucket").agg(F.count(F.lit(1)).alias("n"))
    f = hop(f, 6).withColumnRenamed("src_ip", "entity_ip")
    return f.join(fired.select("entity_ip", "anchor"), ["entity_ip", "anchor"]).groupBy("client").agg(F.sum("n").alias("n"))


def dns_view(dns: DataFrame, resolvers: list[str], step_us: int, delta_us: int = 2 * SECOND, slice_us: int = MINUTE) -> DataFrame:
    """Own queries per (entity, anchor) over six steps, forwards excluded but counted.

    A query counts as NXDOMAIN at A when the flow's last such answer is not later than A.
    """
    q = dns_attribution(dns, resolvers, delta_us, slice_us)
    q = q.withColumns({
        "bucket": ceil_bucket(F.col("ts_us"), step_us), "nx_bucket": ceil_bucket(F.col("nx_ts"), step_us),
        "own": (F.col("query_class") != "forward"),
    })
    pre = q.groupBy(F.col("src_ip").alias("entity_ip"), "bucket", "own", "nx_bucket", "name").agg(F.count(F.lit(1)).alias("n"))
    nx = F.when(F.col("own") & (F.col("nx_bucket") <= F.col("anchor")), F.col("n")).otherwise(0)
    per_name = hop(pre, 6).groupBy("entity_ip", "anchor", "name").agg(
        F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).alias("own_n"), F.sum(nx).alias("nx_n"),
        F.sum(F.when(F.col("own"), 0).otherwise(F.col("n"))).alias("fwd_n"),
    )
    x = per_name.groupBy("entity_ip", "anchor").agg(
        F.sum("own_n").alias("dnsh_queries_60s"), F.sum("nx_n").alias("nx"),
        F.count_if(F.col("own_n") > 0).alias("names"), F.sum("fwd_n").alias("dnsh_forwards_excluded_60s"),
    )
    n = F.col("dnsh_queries_60s")
    return x.select(
        "entity_ip", "anchor", "dnsh_queries_60s", safe_ratio(F.col("nx"), n).alias("dnsh_nxdomain_ratio_60s"),
        safe_ratio(F.col("names"), n).alias("dnsh_unique_names_ratio_60s"), "dnsh_forwards_excluded_60s",
    )


def http_evidence(http: DataFrame, packets: DataFrame, tol_us: int = 2 * SECOND, slice_us: int = MINUTE) -> DataFrame:
    """HTTP records with ``frame_ts``: the first TCP frame of their flow within the tolerance.

    A forward as-of lookup from ``ts - tol``: no record x frame pairs are formed.
    """
    h = http.withColumn("pair", tcp_pair_key("src_ip", "src_port", "dest_ip", "dest_port")).withColumn("_from", F.col("ts_us") - tol_us)
    frames = packets.where("protocol = 6").select(tcp_pair_key().alias("pair"), "ts_us")
    x = asof(h, frames, ["pair"], "_from", "ts_us", {"ts_us": "frame_ts"}, slice_us, forward=True)
    ok = F.col("frame_ts") <= F.col("ts_us") + tol_us
    return x.withColumn("frame_ts", F.when(ok, F.col("frame_ts"))).drop("_from")


def http_view(http: DataFrame, packets: DataFrame, step_us: int, tol_us: int = 2 * SECOND, slice_us: int = MINUTE) -> DataFrame:
    """Requests seen on the wire per (source, anchor), authentication failures among them,
    and the late records left out. A frame only counts once the window end has passed it."""
    http = http.select("src_ip", "src_port", "dest_ip", "dest_port", "ts_us", "status")  # what the lookup would carry along
    e = http_evidence(http, packets, tol_us, slice_us).withColumns({
        "bucket": ceil_bucket(F.col("ts_us"), step_us), "frame_bucket": ceil_bucket(F.col("frame_ts"), step_us),
        "auth": F.col("status").isin(401, 403),
    })
    pre = e.groupBy(F.col("src_ip").alias("entity_ip"), "bucket", "frame_bucket", "auth").agg(F.count(F.lit(1)).alias("n"))
    valid = F.coalesce(F.col("frame_bucket") <= F.col("anchor"), F.lit(False))
    x = hop(pre, 6).groupBy("entity_ip", "anchor").agg(
        F.sum(F.when(valid, F.col("n")).otherwise(0)).alias("httph_requests_60s"),
        F.sum(F.when(valid & F.col("auth"), F.col("n")).otherwise(0)).alias("fails"),
        F.sum(F.when(valid, 0).otherwise(F.col("n"))).alias("httph_late_excluded_60s"),
    )
    return x.select(
        "entity_ip", "anchor", "httph_requests_60s",
        safe_ratio(F.col("fails"), F.col("httph_requests_60s")).alias("httph_auth_failure_ratio_60s"), "httph_late_excluded_60s",
    )
