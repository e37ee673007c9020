"""Fixed schemas the engine builds against."""

from pyspark.sql import types as T

FLOW_KEY = ["capture_id", "src_ip", "dst_ip", "src_port", "dst_port", "proto"]

PACKETS = T.StructType([
    T.StructField("capture_id", T.StringType()),
    T.StructField("pkt_no", T.LongType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("proto", T.IntegerType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("ip_len", T.LongType()),
    T.StructField("tcp_flags", T.IntegerType()),
])

# The 23 per-flow features in the order the reference emits them.
FEATURES = [
    "protocol", "proto", "pkt_count", "flow_duration", "total_size",
    "avg_pkt_size", "mean_iat", "std_iat", "min_iat", "max_iat", "src_port",
    "dst_port", "syn_count", "fin_count", "rst_count", "psh_count",
    "ack_count", "urg_count", "pkt_rate", "byte_rate", "syn_rate",
    "fin_rate", "rst_rate",
]

_INT = {"protocol", "proto", "src_port", "dst_port"}
_LONG = {"pkt_count", "total_size", "syn_count", "fin_count", "rst_count",
         "psh_count", "ack_count", "urg_count"}


def _feature_type(name):
    if name in _INT:
        return T.IntegerType()
    if name in _LONG:
        return T.LongType()
    return T.DoubleType()


FLOWS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("capture_id", "src_ip", "dst_ip")]
    + [T.StructField("first_pkt_no", T.LongType())]
    + [T.StructField(c, _feature_type(c)) for c in FEATURES]
)

ATTACK_TYPE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("count", T.LongType()),
    T.StructField("percentage", T.DoubleType()),
    T.StructField("confidence", T.DoubleType()),
])

VERDICT = T.StructType([
    T.StructField("capture_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("details", T.StringType()),
    T.StructField("flows_analyzed", T.LongType()),
    T.StructField("normal_percentage", T.DoubleType()),
    T.StructField("attack_types", T.ArrayType(ATTACK_TYPE)),
])

ANALYSIS_RUNS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("progress", T.IntegerType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("completed_at", T.TimestampType()),
    T.StructField("result", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("error_details", T.StringType()),
])

# Fixed values that must equal the reference's: class names and the
# human-readable description of each (two spellings map to fuzzing).
KNOWN_LABELS = [
    "Normal", "Active_Wiretap", "ARP_MitM", "Fuzzing", "Mirai_Botnet",
    "OS_Scan", "SSDP_Flood", "SSL_Renegotiation", "SYN_DoS", "Video_Injection",
]
ATTACK_DESCRIPTIONS = [
    ("Normal", "Normal Traffic"),
    ("Active_Wiretap", "Active Wiretap Attack"),
    ("ARP_MitM", "ARP Man-in-the-Middle Attack"),
    ("Fuzzing", "Protocol Fuzzing Attack"),
    ("fuzzing", "Protocol Fuzzing Attack"),
    ("Mirai_Botnet", "Mirai Botnet Activity"),
    ("OS_Scan", "Operating System Scanning"),
    ("SSDP_Flood", "SSDP Flooding Attack"),
    ("SSL_Renegotiation", "SSL Renegotiation Attack"),
    ("SYN_DoS", "SYN Denial of Service"),
    ("Video_Injection", "Video Injection Attack"),
]
