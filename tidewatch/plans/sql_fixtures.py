"""DuckDB SQL for the packet stand-in and flow features (the oracle side).

The same integer rules as ``sources.fixtures``; ``%`` and ``//`` agree with
Spark's ``%`` and ``div`` on the non-negative values used here.
"""

from ..sources.fixtures import DST_PORT, EPOCH_2024_US, TIME_DIVISOR

_CAPTURE_SQL = {
    "single": "'cap0'",
    "by_class": "CAST(user_id % 8 AS VARCHAR)",
    "mixed": "'cap' || CAST((user_id // 8) % 4 AS VARCHAR)",
}


def _case(mapping):
    return "CASE " + " ".join(f"WHEN c = {k} THEN {v}" for k, v in mapping.items()) + " END"


def packets_sql(captures: str = "single") -> str:
    return f"""
    SELECT {_CAPTURE_SQL[captures]} AS capture_id,
           event_id AS pkt_no,
           (epoch_us(ts) - {EPOCH_2024_US}) // {_case(TIME_DIVISOR)} AS ts_us,
           '10.0.' || CAST(user_id // 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) AS src_ip,
           '192.168.0.1' AS dst_ip,
           CAST(CASE WHEN c IN (3, 5, 6) THEN 17 ELSE 6 END AS INTEGER) AS proto,
           CAST(CASE WHEN c = 1 THEN 1024 + event_id % 16 ELSE 40000 + user_id % 1000 END AS INTEGER) AS src_port,
           CAST({_case(DST_PORT)} AS INTEGER) AS dst_port,
           CAST(60 + (event_id * 37) % 1400 AS BIGINT) AS ip_len,
           CAST(CASE WHEN c IN (0, 4) THEN 24 WHEN c = 1 THEN 2
                     WHEN c = 2 THEN CASE WHEN event_type = 'purchase' THEN 20 ELSE 2 END
                     WHEN c = 7 THEN CASE WHEN event_type = 'error' THEN 17 ELSE 24 END
                     ELSE 0 END AS INTEGER) AS tcp_flags
    FROM (SELECT *, user_id % 8 AS c FROM events)
    """


KEY = "capture_id, src_ip, dst_ip, src_port, dst_port, proto"


def sessions_sql(captures: str, idle_us: int) -> str:
    """Packets with the number of idle gaps before them in their flow."""
    return f"""
    SELECT *, sum(idle) OVER (PARTITION BY {KEY} ORDER BY pkt_no) AS session FROM (
      SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY {KEY} ORDER BY pkt_no) > {idle_us}
                     THEN 1 ELSE 0 END AS idle FROM ({packets_sql(captures)}))
    """


def flows_sql(captures: str = "single", idle_us: int | None = None) -> str:
    """Flow features with full precision, one row per flow key (and session)."""
    if idle_us is None:
        return _features_sql(packets_sql(captures), KEY)
    return _features_sql(sessions_sql(captures, idle_us), f"{KEY}, session")


def _features_sql(packets: str, key: str) -> str:
    return f"""
    WITH p AS ({packets}),
    g AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY {key} ORDER BY pkt_no) AS gap FROM p),
    a AS (
      SELECT {key},
             min(pkt_no) AS first_pkt_no,
             count(*) AS pkt_count,
             arg_max(ts_us, pkt_no) - arg_min(ts_us, pkt_no) AS dur_us,
             sum(ip_len) AS total_size,
             count(gap) AS gap_n, avg(gap) AS gap_mean,
             sum(gap) AS gap_s1, sum(CAST(gap AS HUGEINT) * gap) AS gap_s2,
             min(gap) AS gap_min, max(gap) AS gap_max,
             count_if(proto = 6 AND (tcp_flags & 2) <> 0) AS syn_count,
             count_if(proto = 6 AND (tcp_flags & 1) <> 0) AS fin_count,
             count_if(proto = 6 AND (tcp_flags & 4) <> 0) AS rst_count,
             count_if(proto = 6 AND (tcp_flags & 8) <> 0) AS psh_count,
             count_if(proto = 6 AND (tcp_flags & 16) <> 0) AS ack_count,
             count_if(proto = 6 AND (tcp_flags & 32) <> 0) AS urg_count
      FROM g GROUP BY {key})
    SELECT capture_id, src_ip, dst_ip, CAST(first_pkt_no AS BIGINT) AS first_pkt_no,
           proto AS protocol, proto,
           CAST(pkt_count AS BIGINT) AS pkt_count,
           dur_us / 1000000.0 AS flow_duration,
           CAST(total_size AS BIGINT) AS total_size,
           total_size / pkt_count AS avg_pkt_size,
           CASE WHEN gap_n > 0 THEN gap_mean / 1000000.0 ELSE 0.0 END AS mean_iat,
           CASE WHEN gap_n > 0 THEN sqrt(CAST(gap_n * gap_s2 - gap_s1 * gap_s1 AS DOUBLE)
                / (CAST(gap_n AS DOUBLE) * CAST(gap_n AS DOUBLE))) / 1000000.0 ELSE 0.0 END AS std_iat,
           CASE WHEN gap_n > 0 THEN gap_min / 1000000.0 ELSE 0.0 END AS min_iat,
           CASE WHEN gap_n > 0 THEN gap_max / 1000000.0 ELSE 0.0 END AS max_iat,
           src_port, dst_port,
           CAST(syn_count AS BIGINT) AS syn_count, CAST(fin_count AS BIGINT) AS fin_count,
           CAST(rst_count AS BIGINT) AS rst_count, CAST(psh_count AS BIGINT) AS psh_count,
           CAST(ack_count AS BIGINT) AS ack_count, CAST(urg_count AS BIGINT) AS urg_count,
           CASE WHEN dur_us > 0 THEN pkt_count / (dur_us / 1000000.0) ELSE 0.0 END AS pkt_rate,
           CASE WHEN dur_us > 0 THEN total_size / (dur_us / 1000000.0) ELSE 0.0 END AS byte_rate,
           syn_count / pkt_count AS syn_rate,
           fin_count / pkt_count AS fin_rate,
           rst_count / pkt_count AS rst_rate
    FROM a
    """


def signatures_sql(captures: str = "single") -> str:
    """Flows plus sig_type / sig_confidence (C1, last match wins)."""
    return f"""
    WITH f AS ({flows_sql(captures)}),
    r AS (
      SELECT *,
        CASE WHEN proto = 6 AND (dst_port = 443 OR src_port = 443) AND pkt_count > 50 AND byte_rate > 1000 THEN 'SSL_Renegotiation'
             WHEN proto = 6 AND syn_count > 10 AND syn_rate > 0.7 THEN 'OS_Scan'
             WHEN proto = 17 AND dst_port = 1900 AND pkt_rate > 50 THEN 'SSDP_Flood'
             WHEN proto = 6 AND syn_count > 0 AND syn_count / pkt_count > 0.8 AND pkt_rate > 100 THEN 'SYN_DoS'
             WHEN syn_rate < 0.1 AND fin_rate < 0.1 AND rst_rate < 0.1 AND pkt_rate < 50 THEN 'Normal'
        END AS sig_type,
        CASE WHEN proto = 6 AND (dst_port = 443 OR src_port = 443) AND pkt_count > 50 AND byte_rate > 1000 THEN 85.0
             WHEN proto = 6 AND syn_count > 10 AND syn_rate > 0.7 THEN least(90.0, 70 + syn_count / 5)
             WHEN proto = 17 AND dst_port = 1900 AND pkt_rate > 50 THEN least(95.0, 70 + pkt_rate / 10)
             WHEN proto = 6 AND syn_count > 0 AND syn_count / pkt_count > 0.8 AND pkt_rate > 100 THEN least(95.0, 70 + syn_count / pkt_count * 20)
             WHEN syn_rate < 0.1 AND fin_rate < 0.1 AND rst_rate < 0.1 AND pkt_rate < 50 THEN 75.0
        END AS sig_confidence
      FROM f)
    SELECT * FROM r
    """


def labelled_sql(captures: str = "single") -> str:
    """Rules-only labels: signature type, else 'Unknown' at confidence 0."""
    return f"""
    SELECT capture_id, first_pkt_no,
           coalesce(sig_type, 'Unknown') AS label,
           coalesce(sig_confidence, 0.0) AS confidence
    FROM ({signatures_sql(captures)})
    """
