"""Column functions: text repair, numbers in text, ports, labels, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ports and the names they are binned under.
PORT_SERVICES = {
    20: "FTP-Data", 21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 53: "DNS", 67: "DHCP", 68: "DHCP", 69: "TFTP", 80: "HTTP", 110: "POP3", 123: "NTP",
    137: "NetBIOS", 143: "IMAP", 161: "SNMP", 443: "HTTPS", 465: "SMTPS", 502: "Modbus", 514: "Syslog", 789: "CrimsonV3", 993: "IMAPS", 995: "POP3S",
    1883: "MQTT", 2222: "EtherNet/IP", 2404: "IEC-104", 3306: "MySQL", 3389: "RDP", 5060: "SIP", 5900: "VNC", 8080: "MQTT-WS", 8081: "MQTT-WSS", 8883: "MQTT-TLS",
    12345: "NetBus", 20000: "DNP3", 31337: "BackOrifice", 44818: "CIP",
}
# Upper ends of the port ranges and their names.
PORT_RANGES = [(255, "System_0_255"), (1023, "System_256_1023"), (49151, "Registered_1024_49151"), (57343, "Dynamic_49152_57343"), (65535, "Dynamic_57344_65535")]
IPV4 = r"^\s*(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}\s*$"
IPV6 = r"^\s*(([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|([0-9A-Fa-f]{1,4}:){1,7}:|:(:[0-9A-Fa-f]{1,4}){1,7}|([0-9A-Fa-f]{1,4}:){1,6}(:[0-9A-Fa-f]{1,4}){1,6}|::)\s*$"
MAC = r"^\s*([0-9A-Fa-f]{2}([:_-][0-9A-Fa-f]{2}){5}|[0-9A-Fa-f]{12})\s*$"


def binarize_label(label: Column, benign: str, good: str = "Benign", bad: str = "Malign") -> Column:
    """The benign literal against everything else; null stays null."""
    return F.when(label == benign, good).when(label.isNotNull(), bad)


def text_to_int(x: Column) -> Column:
    """Integer in a text: decimal with a point is truncated, ``0x`` is hexadecimal, else 0."""
    t = F.lower(F.trim(x))
    hexa = F.when(t.rlike("^0x[0-9a-f]{1,15}$"), F.conv(F.substring(t, 3, 15), 16, 10).try_cast("bigint"))
    point = F.when(t.contains("."), t.try_cast("double").try_cast("bigint"))
    return F.coalesce(hexa, point, t.try_cast("bigint"), F.lit(0).cast("bigint"))


def hex_to_int(x: Column) -> Column:
    """Hexadecimal text as decimal text; other texts unchanged."""
    return F.when(x.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(x, 3, 15), 16, 10)).otherwise(x)


def kmg_to_number(x: Column) -> Column:
    """``1.5K``, ``2M``, ``3.2G`` and ``12%`` as numbers; null where no number is."""
    t = F.upper(F.trim(x))
    value = F.regexp_extract(t, r"^([+-]?[0-9]*\.?[0-9]+)([KMG%]?)$", 1).try_cast("double")
    unit = F.regexp_extract(t, r"^([+-]?[0-9]*\.?[0-9]+)([KMG%]?)$", 2)
    return value * F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "G", 1e9).when(unit == "%", 0.01).otherwise(1.0)


def expand_suffix(x: Column) -> Column:
    """The text of ``kmg_to_number``'s value: ``5K`` to ``5000``, ``12%`` to ``0.12``; others unchanged."""
    value = kmg_to_number(x)
    whole = value == F.floor(value)
    return F.when(value.isNull(), x).when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def strip_markup(x: Column, literal: str = "<!DOCTYPE html>") -> Column:
    """A literal removed wherever it occurs."""
    return F.replace(x, F.lit(literal), F.lit(""))


def slug(x: Column) -> Column:
    """Everything but ASCII letters and digits as an underscore."""
    return F.regexp_replace(x, "[^A-Za-z0-9]", "_")


def strip_trailing_number(x: Column) -> Column:
    """White space and digits removed."""
    return F.regexp_replace(x, r"\s\d+", "")


def round_half_even(x: Column, digits: int = 3) -> Column:
    """Rounding halves to the even digit."""
    return F.bround(x, digits)


def port_service(p: Column) -> Column:
    """Service of a port, else the name of its range; null, negative and too large are ``Other``."""
    services = F.create_map(*[F.lit(v) for kv in PORT_SERVICES.items() for v in kv])
    out = F.when(p.isNull() | F.isnan(p.cast("double")) | (p < 0) | (p > 65535), "Other")
    out = out.when(services[p.cast("int")].isNotNull(), services[p.cast("int")])
    for top, name in PORT_RANGES:
        out = out.when(p <= top, name)
    return out


def log10_or_null(x: Column) -> Column:
    """Decimal logarithm of a number or numeric text; null where there is none."""
    v = x.cast("string").try_cast("double")
    return F.when(v > 0, F.log10(v))


def latency_exponent(x: Column) -> Column:
    """Decimal exponent as text, ``NaN`` for null and non-positive values."""
    return F.when(x > 0, F.floor(F.log10(x)).cast("string")).otherwise("NaN")


def comma_decimal(x: Column) -> Column:
    """A number written with a decimal comma."""
    return F.replace(x, F.lit(","), F.lit(".")).try_cast("double")


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds from one timestamp to another."""
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def entropy(p: Column, eps: float = 1e-10) -> Column:
    """Shannon entropy (nats) of an array of probabilities."""
    return F.aggregate(F.transform(p, lambda v: -v * F.log(v + eps)), F.lit(0.0), lambda a, b: a + b)


def row_mean(*columns: str) -> Column:
    """Mean of the columns' values, nulls left out."""
    values = F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda v: v.isNotNull())
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / F.nullif(F.size(values), F.lit(0))


def hash_key(key: Column, seed: int = 42) -> Column:
    """The text that orders rows reproducibly in any engine: md5 of the key and a seed."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))


def hash_share(key: Column, seed: int = 42) -> Column:
    """A reproducible value in [0, 1) for a key."""
    return F.conv(F.substring(hash_key(key, seed), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
