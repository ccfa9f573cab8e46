"""Verification over stored probe rows: outcome classes, liveness, identity and endpoint policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.ordered import top_n
from winnow.functions.text import endpoint_hash
from winnow.operators.score import lookup
from winnow.settings import DEFAULT, Rules

# Failure classes by probe error type; other errors are ``unreachable``.
FAILURE_BY_ERROR = {
    "private_target": "private_target",
    "method_unsupported": "method_unsupported",
    "rate_limited": "rate_limited",
    "oversized/malformed": "oversized/malformed",
}
UNREACHABLE, MISMATCH = "unreachable", "identity_mismatch"
NOT_ADVANCING, UNSUPPORTED = "non_advancing", "method_unsupported"
# IPv4 ranges that must not be contacted (first address, prefix length).
DENIED_IPV4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16),
    ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16),
    ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)


def error_type(message: Column) -> Column:
    """Error type from the text of a probe error."""
    m = F.lower(message)
    return (
        F.when(m.contains("429") | m.contains("rate limit"), "rate_limited")
        .when(m.contains("size limit"), "oversized/malformed")
        .otherwise("unreachable")
    )


def classify_probes(probes: DataFrame, networks: DataFrame) -> DataFrame:
    """Success and failure class of each probe (V1).

    A successful probe whose reported chain id differs from the published one fails as an identity
    mismatch.
    """
    published = networks.select("network_id", F.col("human_chain_id").alias("_published"))
    df = probes.join(published, "network_id", "left")
    mismatch = F.col("success") & (F.col("chain_id") != "") & (F.col("_published") != "") & (F.col("chain_id") != F.col("_published"))
    mismatch = F.coalesce(mismatch, F.lit(False))
    failure = F.when(~F.col("success"), lookup(FAILURE_BY_ERROR, F.col("error_type"), UNREACHABLE)).when(mismatch, MISMATCH)
    detail = F.when(
        mismatch,
        F.concat(F.lit("published chain ID "), F.col("_published"), F.lit(" but endpoint reported "), F.col("chain_id")),
    )
    return (
        df.withColumn("failure_class", failure)
        .withColumn("failure_detail", detail)
        .withColumn("success", F.col("success") & ~mismatch)
        .drop("_published")
    )


def fingerprint(namespace: Column, chain: Column, genesis: Column) -> Column:
    """``namespace:chain[:genesis]`` without empty parts; null when nothing is known (V2)."""
    text = F.concat_ws(":", *[F.nullif(c, F.lit("")) for c in (namespace, chain, genesis)])
    return F.nullif(text, F.lit(""))


def recent_pairs(probes: DataFrame) -> DataFrame:
    """Two newest observations per endpoint, ``rn`` 1 being the newest."""
    return top_n(probes, ["endpoint_hash"], [F.col("observed_at").desc(), F.col("probe_id").desc()], 2, rank="rn")


def verdict_columns(new: str, old: str) -> dict[str, Column]:
    """Verdict on a newer and an older observation, given as struct columns. Fails closed: a
    missing fingerprint is unknown identity, not a stable one."""
    n, o = F.col(new), F.col(old)
    paired = o.isNotNull()
    ok = paired & n["success"] & o["success"]
    heights = ok & n["block_height"].isNotNull() & o["block_height"].isNotNull()
    advancing = n["block_height"] > o["block_height"]
    fps = F.nullif(n["identity_fingerprint"], F.lit("")) == F.nullif(o["identity_fingerprint"], F.lit(""))
    stable = F.coalesce(fps, F.lit(False))
    failure = (
        F.when(~paired, F.lit(None))
        .when(~ok, F.coalesce(n["failure_class"], o["failure_class"], F.lit(UNREACHABLE)))
        .when(~heights, F.lit(UNSUPPORTED))
        .when(~advancing, F.lit(NOT_ADVANCING))
        .when(~stable, F.lit(MISMATCH))
    )
    detail = (
        F.when(~paired, "awaiting second observation")
        .when(~ok, "an observation of the pair failed")
        .when(~heights, "no comparable height")
        .when(~advancing, "height unchanged")
        .when(~stable, "identity changed or not reported")
        .otherwise("height advanced with stable identity")
    )
    return {
        "live": F.coalesce(heights & advancing & stable, F.lit(False)),
        "advancing": F.when(heights, advancing),
        "identity_stable": F.when(heights, stable),
        "first_height": F.when(ok | (paired & ~ok), o["block_height"]),
        "second_height": F.when(paired, n["block_height"]),
        "gap_seconds": F.when(paired, F.unix_timestamp(n["observed_at"]) - F.unix_timestamp(o["observed_at"])),
        "failure_class": failure,
        "detail": detail,
    }


OBSERVED = ("success", "block_height", "identity_fingerprint", "failure_class", "observed_at", "candidate_id")


def liveness(probes: DataFrame) -> DataFrame:
    """Liveness verdict per endpoint from its two newest observations.

    At most two rows per endpoint survive the map-side rank limit; a grouped pick pairs them.
    """
    packed = F.struct(*OBSERVED)
    pair = (
        recent_pairs(probes)
        .groupBy("endpoint_hash")
        .agg(
            F.max(F.when(F.col("rn") == 1, packed)).alias("_new"),
            F.max(F.when(F.col("rn") == 2, packed)).alias("_old"),
        )
    )
    cols = verdict_columns("_new", "_old")
    return pair.select("endpoint_hash", F.col("_new.candidate_id").alias("candidate_id"), *[c.alias(k) for k, c in cols.items()])


def apply_verified(probes: DataFrame, incarnations: DataFrame) -> DataFrame:
    """Incarnations with heights and time of their verified probes (V3). Only a genesis that an
    endpoint returned counts."""
    seen = (
        probes.filter(F.col("success") & (F.col("genesis_hash") != ""))
        .groupBy("network_id", F.col("genesis_hash").alias("genesis_fingerprint"))
        .agg(
            F.max("observed_at").alias("last_verified_at"),
            F.min_by("block_height", F.when(F.col("block_height").isNotNull(), F.struct("observed_at", "probe_id"))).alias("first_observed_height"),
            F.max_by("block_height", F.when(F.col("block_height").isNotNull(), F.struct("observed_at", "probe_id"))).alias("last_observed_height"),
        )
    )
    return incarnations.join(seen, ["network_id", "genesis_fingerprint"], "left")


def verification_summary(probes: DataFrame) -> DataFrame:
    """Per candidate: fingerprint seen, identity mismatch, endpoint failures, last success (V4)."""
    return probes.filter(F.col("candidate_id").isNotNull()).groupBy("candidate_id").agg(
        F.bool_or("success").alias("has_fingerprint"),
        F.coalesce(F.bool_or(F.col("failure_class") == MISMATCH), F.lit(False)).alias("identity_mismatch"),
        F.count_if(~F.col("success") & ~F.col("failure_class").eqNullSafe(MISMATCH)).alias("endpoint_failures"),
        F.max(F.when(F.col("success"), F.col("observed_at"))).alias("last_verified_at"),
    )


def resolve_endpoints(observations: DataFrame, network_urls: DataFrame) -> DataFrame:
    """Published URL behind each redacted observation, by hash within its network (V6)."""
    rpc = network_urls.filter(F.col("kind") == "rpc").select(
        "network_id", endpoint_hash(F.col("url")).alias("endpoint_hash"), "url"
    )
    return observations.join(rpc.dropDuplicates(["network_id", "endpoint_hash"]), ["network_id", "endpoint_hash"])


def _ipv4_number(host: Column) -> Column:
    p = F.split(host, r"\.")
    octets = [F.try_element_at(p, F.lit(i)).cast("bigint") for i in range(1, 5)]
    return octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]


def screen_endpoints(urls: DataFrame, url: str = "url", rules: Rules = DEFAULT) -> DataFrame:
    """Policy verdict on the text of an endpoint URL (V5): scheme, port and literal addresses.

    Host names are not resolved. IPv6 literals pass only if global unicast outside transition and
    documentation ranges; an IPv4 address inside one is judged as IPv4 by the mapped form.
    """
    rx = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::([^/?#]*))?(?:[/?#].*)?$"
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    v4 = rf"^{octet}\.{octet}\.{octet}\.{octet}$"
    # Each step is its own projection: the optimizer keeps costly columns that are used repeatedly
    # apart instead of copying their expression into every use.
    df = urls.withColumn("_u", F.trim(F.col(url)))
    df = df.select(
        *urls.columns,
        "_u",
        F.lower(F.regexp_extract("_u", rx, 1)).alias("_scheme"),
        F.regexp_replace(F.lower(F.regexp_extract("_u", rx, 2)), r"[\[\]]", "").alias("_host"),
        F.regexp_extract("_u", rx, 3).alias("_port"),
    )
    u, scheme, host = F.col("_u"), F.col("_scheme"), F.col("_host")
    mapped = F.regexp_extract(host, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    df = df.withColumn("_ip", F.when(host.rlike(v4), host).when(mapped.rlike(v4), mapped))
    default_port = F.when(scheme == "https", 443).otherwise(80)
    port_number = F.when(F.col("_port") == "", default_port).when(F.col("_port").rlike(r"^\d{1,5}$"), F.col("_port").cast("int"))
    df = df.withColumn("_n", _ipv4_number(F.col("_ip"))).withColumn("_pn", port_number)
    n, port = F.col("_n"), F.col("_pn")
    denied = F.lit(False)
    for first, bits in DENIED_IPV4:
        a, b, c, d = (int(x) for x in first.split("."))
        lo = ((a * 256 + b) * 256 + c) * 256 + d
        denied = denied | n.between(lo, lo + 2 ** (32 - bits) - 1)
    is_v6 = host.contains(":") & F.col("_ip").isNull()
    v6_ok = host.rlike(r"^[23][0-9a-f]{3}:") & ~host.rlike(r"^(2002|2001:0{0,3}db8|2001:0{0,4}:|2001::)")
    allowed_http = host.isin(*rules.allow_http_hosts) if rules.allow_http_hosts else F.lit(False)
    reason = (
        F.when(u.isNull() | (u == ""), "empty")
        .when(~scheme.isin("http", "https"), "scheme")
        .when(host == "", "host")
        .when(~scheme.isin(*rules.allowed_schemes) & ~((scheme == "http") & allowed_http), "scheme")
        .when(port.isNull() | ~port.isin(*rules.allowed_ports), "port")
        .when(F.coalesce(denied, F.lit(False)), "address")
        .when(is_v6 & ~v6_ok, "address")
    )
    out = df.withColumn("rejected_for", reason).withColumn("allowed", F.col("rejected_for").isNull())
    return out.drop("_u", "_scheme", "_host", "_port", "_ip", "_n", "_pn")
