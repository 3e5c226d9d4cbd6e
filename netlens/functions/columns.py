"""Column expressions shared by the operators. Everything stays JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# TCP flag bits, IP protocol numbers and well-known services.
FIN, SYN, RST, PSH, ACK, URG = 0x01, 0x02, 0x04, 0x08, 0x10, 0x20
FLAG_NAMES = ((SYN, "SYN"), (FIN, "FIN"), (RST, "RST"), (PSH, "PSH"), (ACK, "ACK"))
TCP, UDP, ICMP = 6, 17, 1
PROTOCOL_NAMES = {6: "TCP", 17: "UDP", 1: "ICMP"}
SERVICES = {
    22: "ssh", 53: "dns", 80: "http", 88: "kerberos", 123: "ntp", 135: "rpc", 161: "snmp", 162: "snmp-trap",
    389: "ldap", 443: "https", 445: "smb", 514: "syslog", 636: "ldaps", 1514: "wazuh", 1515: "wazuh-alta",
    3000: "grafana", 3268: "gc", 9090: "prometheus", 9100: "node-exporter", 10050: "zabbix-agente",
    10051: "zabbix-servidor", 55000: "wazuh-api",
}


def idiv(col: Column, n: int) -> Column:
    """Exact integer floor division of a LONG column by a constant."""
    return ((col - F.pmod(col, F.lit(n))) / F.lit(n)).cast("long")


def ceil_bucket(ts_us: Column, step_us: int) -> Column:
    """Index c of the half-open-left bucket ((c-1)*step, c*step] holding the instant."""
    return idiv(ts_us + F.lit(step_us - 1), step_us)


def safe_ratio(num: Column, den: Column) -> Column:
    """num/den, and 0.0 (never NULL) for a zero or missing denominator."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def clamped_ratio(num: Column, den: Column) -> Column:
    return F.least(F.lit(1.0), safe_ratio(num, den))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


# --- addresses ------------------------------------------------------------------

_IPV4 = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"


def ip_long(ip: Column) -> Column:
    """IPv4 dotted quad as LONG; NULL when it is not a valid address."""
    parts = F.split(ip, r"\.")
    octets = [F.try_element_at(parts, F.lit(i + 1)).try_cast("long") for i in range(4)]
    value = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    return F.when(ip.rlike(_IPV4), value)


def cidr_range(cidr: str) -> tuple[int, int]:
    """First and last address of a network, as integers."""
    address, _, bits = cidr.partition("/")
    size = 1 << (32 - int(bits or 32))
    value = 0
    for octet in address.split("."):
        value = value * 256 + int(octet)
    start = value - value % size
    return start, start + size - 1


def in_scope(ip: Column, cidrs: str | list[str]) -> Column:
    """True when the address lies in one of the networks; invalid text is False."""
    value = ip_long(ip)
    nets = [cidrs] if isinstance(cidrs, str) else list(cidrs)
    tests = [value.between(F.lit(lo), F.lit(hi)) for lo, hi in map(cidr_range, nets)]
    return F.coalesce(any_of(tests), F.lit(False))


# --- flows and packets -----------------------------------------------------------

def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def flow_key() -> Column:
    """Direction-free flow identity; protocols without ports carry the ICMP id."""
    a = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    b = F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    ported = F.col("protocol").isin(TCP, UDP)
    plain_a = F.struct(F.col("src_ip").alias("ip"), F.lit(0).alias("port"))
    plain_b = F.struct(F.col("dst_ip").alias("ip"), F.lit(0).alias("port"))
    ends = F.when(ported, F.array_sort(F.array(a, b))).otherwise(F.array_sort(F.array(plain_a, plain_b)))
    text = [F.concat_ws(":", ends[i]["ip"], ends[i]["port"].cast("string")) for i in (0, 1)]
    extra = F.when(ported, F.lit("")).otherwise(F.col("icmp_id").cast("string"))
    return F.concat_ws("|", F.col("protocol").cast("string"), *text, extra)


def tcp_pair_key(src="src_ip", sport="src_port", dst="dst_ip", dport="dst_port") -> Column:
    """Direction-free endpoint pair, shared by sensor events and frames."""
    ends = F.array_sort(F.array(
        F.struct(F.coalesce(F.col(src), F.lit("")).alias("ip"), F.coalesce(F.col(sport), F.lit(0)).cast("int").alias("p")),
        F.struct(F.coalesce(F.col(dst), F.lit("")).alias("ip"), F.coalesce(F.col(dport), F.lit(0)).cast("int").alias("p")),
    ))
    return F.concat_ws("|", *[F.concat_ws(":", ends[i]["ip"], ends[i]["p"].cast("string")) for i in (0, 1)])


def flag_name(flags: Column) -> Column:
    names = [F.when(has_flag(flags, bit), F.lit(name)) for bit, name in FLAG_NAMES]
    return F.concat_ws("-", *names)


def protocol_name(protocol: Column) -> Column:
    out = F.concat(F.lit("IP-"), protocol.cast("string"))
    for number, name in PROTOCOL_NAMES.items():
        out = F.when(protocol == number, F.lit(name)).otherwise(out)
    return out


def service_of(other_port: Column, own_port: Column) -> Column:
    """Service by the far port, else by the near one."""
    names = F.create_map(*[F.lit(x) for pair in SERVICES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, other_port), F.try_element_at(names, own_port), F.lit("other"))


# --- sensor event fields ----------------------------------------------------------

def dns_name(dns: str = "dns") -> Column:
    """rrname, else the first query's rrname, lower-cased; '' when there is none."""
    first = F.try_element_at(F.col(f"{dns}.queries"), F.lit(1))
    return F.lower(F.coalesce(F.nullif(F.col(f"{dns}.rrname"), F.lit("")), first["rrname"], F.lit("")))


def dns_type(dns: str = "dns") -> Column:
    first = F.try_element_at(F.col(f"{dns}.queries"), F.lit(1))
    has_name = F.coalesce(F.col(f"{dns}.rrname"), F.lit("")) != ""
    return F.coalesce(F.when(has_name, F.col(f"{dns}.rrtype")).otherwise(first["rrtype"]), F.lit(""))


def parse_ts(text: Column) -> Column:
    """ISO-8601 with 'Z', '+00:00' or '+0000'; NULL when it cannot be read."""
    colon = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.try_to_timestamp(colon)


def parse_ts_us(text: Column) -> Column:
    return F.unix_micros(parse_ts(text))


# --- statistics --------------------------------------------------------------------

def wilson(k: Column, n: Column, z: float) -> Column:
    """Score interval of a proportion as struct<low, high>, both fractions."""
    kk, nn = k.cast("double"), n.cast("double")
    p = F.try_divide(kk, nn)
    den = 1 + F.try_divide(F.lit(z * z), nn)
    centre = (p + F.try_divide(F.lit(z * z), 2 * nn)) / den
    half = z * F.sqrt(F.try_divide(p * (1 - p), nn) + F.try_divide(F.lit(z * z), 4 * nn * nn)) / den
    zero = F.lit(0.0)
    return F.struct(
        F.coalesce(F.greatest(zero, centre - half), zero).alias("low"),
        F.coalesce(F.least(F.lit(1.0), centre + half), zero).alias("high"),
    )


def all_true(flag: str) -> Column:
    """Aggregate over nullable verdicts: false beats not-measured, which beats true."""
    c = F.col(flag)
    return (
        F.when(F.count_if(~c) > 0, F.lit(False))
        .when(F.count_if(c.isNull()) > 0, F.lit(None).cast("boolean"))
        .when(F.count(F.lit(1)) > 0, F.lit(True))
    )


def tri_and(flags: list[Column]) -> Column:
    """Row-wise three-valued AND (Spark's own AND already lets false beat NULL)."""
    return reduce(lambda a, b: a & b, flags)
