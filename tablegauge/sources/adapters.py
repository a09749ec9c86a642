"""Dataset adapters: one configuration each, one function for all."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import binarize_label, hex_to_int, kmg_to_number, slug, strip_markup, strip_trailing_number, text_to_int
from ..operators.clean import columns_of, rightmost, trimmed_names


@dataclass(frozen=True)
class Adapter:
    """How a source becomes features and a last column ``label``."""

    benign: tuple[str, ...]
    drop: tuple[str, ...] = ()
    label: tuple[str, ...] = ("label",)  # source columns, joined by an underscore
    from_name: str | None = None  # or a pattern on the file's name
    from_path: str | None = None  # or on its path
    attack_flag: str = ""  # a column whose 0 means the benign label instead
    label_rules: tuple[tuple[str, str], ...] = ()  # patterns and what replaces the whole label
    label_map: dict[str, str] = field(default_factory=dict)
    remove_from_label: str = ""
    lower_label: bool = False
    slug_label: bool = False
    trim: bool = False
    fill: dict[str, object] = field(default_factory=dict)
    integers: tuple[str, ...] = ()
    hexadecimal: bool = False
    suffixed: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    strip_numbers: tuple[str, ...] = ()
    dash_is_zero: tuple[str, ...] = ()
    markup: str = ""
    deduplicate_first: bool = False


# The columns and labels that the public sources use.
EVSE_DROP = ("id", "expiration_id", "src_ip", "dst_ip", "src_mac", "dst_mac", "src_oui", "dst_oui", "src_port", "requested_server_name", "client_fingerprint", "server_fingerprint", "user_agent", "content_type", "tunnel_id", "vlan_id")
ADAPTERS = {
    "KDD_Cup_1999": Adapter(("normal",), remove_from_label="."),
    "UNSW_NB15": Adapter(("Normal",), ("srcip", "dstip", "Label"), ("attack_cat",), trim=True, fill={"sport": "-1", "ct_ftp_cmd": "-1", "ct_flw_http_mthd": -1.0, "is_ftp_login": -1.0, "label": "Normal"}),
    "BoT_IoT_Macro": Adapter(("Normal",), ("pkSeqID", "stime", "saddr", "daddr", "seq", "ltime", "attack", "subcategory"), ("category",), integers=("sport", "dport")),
    "BoT_IoT_Micro": Adapter(("Normal_Normal",), ("pkSeqID", "stime", "saddr", "daddr", "seq", "ltime", "attack"), ("category", "subcategory"), integers=("sport", "dport")),
    "CIC_IDS_2017": Adapter(("BENIGN",), (), ("Label",)),
    "CIC_IOT_Dataset2023": Adapter(("BENIGN",), (), ("Label",)),
    "IoT_23": Adapter(("Benign",), ("ts", "uid", "service", "local_orig", "local_resp", "history", "id.orig_h", "id.resp_h"), dash_is_zero=("duration", "orig_bytes", "resp_bytes"), numeric=("duration", "orig_bytes", "resp_bytes"), label_rules=((r"(?i)^\S+ {3}benign {3}-$", "Benign"), (r"^\S+ {3}Malicious {3}(.+)$", "$1")), deduplicate_first=True),
    "IoT_Network_Intrusion_Macro": Adapter(("Normal",), ("_ws.col.Time", "_ws.col.cls_time"), (), from_name=r"^[^_]*_([^_.]+)"),
    "IoT_Network_Intrusion_Micro": Adapter(("Normal_Normal",), ("_ws.col.Time", "_ws.col.cls_time"), (), from_name=r"^[^_]*_([^_]+_[^_.]+)"),
    "MQTT_Biflow": Adapter(("normal",), ("ip_src", "ip_dst", "is_attack"), (), from_name=r"^(?:biflow_)?(.*?)\.csv", attack_flag="is_attack"),
    "MQTT_Uniflow": Adapter(("normal",), ("ip_src", "ip_dst", "is_attack"), (), from_name=r"^(?:uniflow_)?(.*?)\.csv", attack_flag="is_attack"),
    "MQTT_Packet": Adapter(("normal",), ("timestamp", "src_ip", "dst_ip", "is_attack"), (), from_name=r"^(.*?)\.csv", attack_flag="is_attack"),
    "CICIoMT2024_Bluetooth": Adapter(("Benign",), ("_ws.col.Time", "_ws.col.cls_time", "frame.number"), (), from_name=r"^[^_]*_([^_.]+)", hexadecimal=True),
    "CICIoMT2024_WiFi_and_MQTT": Adapter(("Benign",), (), (), from_name=r"^(.*?)(?:\d+)?(?=_test|_train)"),
    "BCCC": Adapter(("Benign Traffic",), ("Flow ID", "Src IP", "Dst IP", "Timestamp", "Label"), ("Attack Name",), trim=True),
    "CICAPT_IIoT_Micro": Adapter(("benign",), ("ts", "Sequence number", "Source IP", "Destination IP", "Source Port", "MAC", "label", "subLabelCat"), ("subLabel",), label_map={"0": "benign"}, slug_label=True),
    "CICAPT_IIoT_Macro": Adapter(("benign",), ("ts", "Sequence number", "Source IP", "Destination IP", "Source Port", "MAC", "label", "subLabel"), ("subLabelCat",), label_map={"0": "benign"}, slug_label=True),
    "CICEVSE2024_Micro": Adapter(("idle-benign", "charging-benign"), EVSE_DROP, (), from_name=r"^(?:EVSE-[AB]-)?(.*?)\.csv", lower_label=True),
    "CICEVSE2024_Macro": Adapter(("benign",), EVSE_DROP, (), from_name=r"^(?:EVSE-[AB]-)?(?:(?:charging|idle|Charging|Idle)-)?(.*?)\.csv", lower_label=True),
    "CICIoV2024_Micro": Adapter(("BENIGN_BENIGN",), ("label",), ("category", "specific_class")),
    "CICIoV2024_Macro": Adapter(("BENIGN",), ("label", "specific_class"), ("category",)),
    "EDGE_IIOTSET": Adapter(("Normal",), ("frame.time", "ip.src_host", "ip.dst_host", "arp.src.proto_ipv4", "arp.dst.proto_ipv4", "tcp.ack_raw", "tcp.payload", "tcp.options", "http.file_data", "http.request.full_uri", "http.request.uri.query", "http.referer", "Attack_label"), ("Attack_type",), trim=True),
    "N_BaIoT": Adapter(("benign_traffic",), (), (), from_path=r"((?:[^/]+_attacks/)?[^/]+)\.csv", label_rules=((r"^(.+)_attacks/(.+)$", "$1_$2"),), trim=True),
    "NIDS": Adapter(("Benign",), ("Flow ID", "Src IP", "Dst IP", "Timestamp", "Label", "Dataset", "IPV4_SRC_ADDR", "IPV4_DST_ADDR", "FLOW_START_MILLISECONDS", "FLOW_END_MILLISECONDS", "DNS_QUERY_ID", "DNS_QUERY_TYPE", "DNS_TTL_ANSWER"), ("Attack",), markup="<!DOCTYPE html>", trim=True),
    "ToN_IoT": Adapter(("normal",), ("date", "time", "ts", "src_ip", "dst_ip", "label"), ("type",), strip_numbers=("VGROW", "RGROW"), numeric=("WRDSK", "RDDSK", "DSK"), suffixed=("WCANCL", "MINFLT", "MAJFLT", "VSTEXT", "RSIZE")),
}


def adapted(df: DataFrame, spec: Adapter, binary: bool = False) -> DataFrame:
    """A raw table under an adapter: columns dropped, values repaired, ``label`` made and put last."""
    if spec.from_name or spec.from_path:
        pattern, source = (spec.from_name, "_metadata.file_name") if spec.from_name else (spec.from_path, "_metadata.file_path")
        df = df.withColumn("__label", F.regexp_extract(F.col(source), pattern, 1))
        if spec.attack_flag:
            df = df.withColumn("__label", F.when(F.col(spec.attack_flag).cast("string") == "0", spec.benign[0]).otherwise(F.col("__label")))
    df = trimmed_names(df)
    if spec.deduplicate_first:
        df = df.na.drop("any").dropDuplicates()
    if spec.label:
        parts = [F.col(f"`{c}`").cast("string") for c in spec.label]
        df = df.withColumn("__label", F.concat_ws("_", *parts) if len(parts) > 1 else parts[0])
    df = df.drop(*[c for c in (*spec.drop, *spec.label) if c in df.columns]).withColumnRenamed("__label", "label")
    text = set(columns_of(df, "text"))

    def repaired(c: str) -> Column:
        x = F.col(f"`{c}`")
        if c in text and spec.markup:
            x = strip_markup(x, spec.markup)
        if c in text and spec.trim:
            x = F.trim(x)
        if c in spec.strip_numbers:
            x = strip_trailing_number(x)
        if c in spec.dash_is_zero:
            x = F.when(F.trim(x) == "-", "0").otherwise(x)
        if c in spec.integers:
            x = text_to_int(x.cast("string"))
        elif c in spec.suffixed:
            x = kmg_to_number(x.cast("string"))
        elif c in spec.numeric:
            x = F.trim(x.cast("string")).try_cast("double")
        elif c in text and c != "label" and spec.hexadecimal:
            x = hex_to_int(x)
        return x.alias(c)

    df = df.select(*[repaired(c) for c in df.columns])
    if spec.fill:
        df = df.na.fill({k: v for k, v in spec.fill.items() if k in df.columns})
    label = F.col("label")
    if spec.remove_from_label:
        label = F.replace(label, F.lit(spec.remove_from_label), F.lit(""))
    for pattern, new in spec.label_rules:
        label = F.regexp_replace(label, pattern, new)
    for old, new in spec.label_map.items():
        label = F.when(label == old, new).otherwise(label)
    if spec.lower_label:
        label = F.lower(label)
    if spec.slug_label:
        label = slug(label)
    if binary:
        benign = label.isin(*spec.benign)
        label = binarize_label(F.when(benign, spec.benign[0]).otherwise(label), spec.benign[0])
    return rightmost(df.withColumn("label", label), "label")
