"""Probe tables: outcome classes, liveness, identity, endpoint policy (V, W2, W3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.functions.text import endpoint_hash
from winnow.operators import verify as V
from winnow.plans.registry import query
from winnow.plans.roles import cte, role, sql_t, t, table

_PAIR = """, p2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY endpoint_hash ORDER BY observed_at DESC, probe_id DESC) rn FROM {f}) WHERE rn <= 2)
"""


@query("recent_probe_pairs", "W2", cte("probes") + _PAIR.format(f="probes") + "SELECT endpoint_hash, probe_id, CAST(rn AS INT) AS rn FROM p2")
def _(spark, sf):
    return V.recent_pairs(role(spark, sf, "probes")).select("endpoint_hash", "probe_id", "rn")


def hourly(spark, sf):
    """Probes keyed by user and day part, so that every failure branch of the verdict occurs."""
    p = role(spark, sf, "probes")
    return p.withColumn("endpoint_hash", F.concat("endpoint_hash", F.lit("-"), F.date_format("observed_at", "dd")))


VERDICT_SQL = """SELECT n.endpoint_hash, n.candidate_id, coalesce(o.probe_id IS NOT NULL AND n.success AND o.success AND n.block_height > o.block_height
   AND n.identity_fingerprint = o.identity_fingerprint, FALSE) AS live,
  CASE WHEN n.success AND o.success AND n.block_height IS NOT NULL AND o.block_height IS NOT NULL THEN n.block_height > o.block_height END AS advancing,
  CASE WHEN n.success AND o.success AND n.block_height IS NOT NULL AND o.block_height IS NOT NULL THEN coalesce(n.identity_fingerprint = o.identity_fingerprint, FALSE) END AS identity_stable,
  CASE WHEN o.probe_id IS NULL THEN NULL WHEN NOT (n.success AND o.success) THEN coalesce(n.failure_class, o.failure_class, 'unreachable')
   WHEN n.block_height IS NULL OR o.block_height IS NULL THEN 'method_unsupported' WHEN NOT n.block_height > o.block_height THEN 'non_advancing'
   WHEN NOT coalesce(n.identity_fingerprint = o.identity_fingerprint, FALSE) THEN 'identity_mismatch' END AS failure_class"""


@query(
    "liveness_verdicts",
    "W3 W2",
    cte("probes") + ", h AS (SELECT * REPLACE (endpoint_hash || '-' || strftime(observed_at, '%d') AS endpoint_hash) FROM probes)"
    + _PAIR.format(f="h") + VERDICT_SQL + " FROM (SELECT * FROM p2 WHERE rn = 1) n LEFT JOIN (SELECT * FROM p2 WHERE rn = 2) o ON n.endpoint_hash = o.endpoint_hash",
)
def _(spark, sf):
    return V.liveness(hourly(spark, sf)).select("endpoint_hash", "candidate_id", "live", "advancing", "identity_stable", "failure_class")


def published(spark, sf):
    """One published network per user, whose chain id disagrees with the probes for some."""
    u = table(spark, sf, "events").select("user_id").distinct()
    return u.select(
        F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("network_id"),
        F.col("user_id").alias("candidate_id"),
        F.when(F.col("user_id") % 6 != 0, ((F.col("user_id") + F.when(F.col("user_id") % 4 == 0, 1).otherwise(0)) % 40).cast("string")).alias("human_chain_id"),
        F.concat(F.lit("https://rpc.example.com/"), F.col("user_id").cast("string")).alias("url"),
    )


PUBLISHED = """, pub AS (SELECT DISTINCT 'n' || CAST(user_id AS STRING) AS network_id, CASE WHEN user_id % 6 <> 0 THEN CAST((user_id + CASE WHEN user_id % 4 = 0 THEN 1 ELSE 0 END) % 40 AS STRING) END AS published FROM events),
cls AS (SELECT p.* EXCLUDE (success, failure_class), success AND NOT coalesce(success AND chain_id <> published, FALSE) AS success,
  CASE WHEN NOT success THEN CASE WHEN failure_class IN ('rate_limited', 'method_unsupported') THEN failure_class ELSE 'unreachable' END
       WHEN chain_id <> published THEN 'identity_mismatch' END AS failure_class FROM probes p LEFT JOIN pub USING (network_id))
"""


def _classified(spark, sf):
    p = role(spark, sf, "probes").withColumn("error_type", F.col("failure_class"))
    return V.classify_probes(p, published(spark, sf))


@query("probe_classification", "V1", cte("probes") + PUBLISHED + "SELECT probe_id, success, failure_class FROM cls")
def _(spark, sf):
    return _classified(spark, sf).select("probe_id", "success", "failure_class")


@query(
    "identity_fingerprints",
    "V2",
    cte("probes") + "SELECT probe_id, concat_ws(':', 'eip155', nullif(chain_id, ''), nullif(genesis_hash, '')) AS fingerprint FROM probes",
)
def _(spark, sf):
    p = role(spark, sf, "probes")
    return p.select("probe_id", V.fingerprint(F.lit("eip155"), F.col("chain_id"), F.col("genesis_hash")).alias("fingerprint"))


@query(
    "verified_incarnations",
    "V3",
    cte("probes") + f"""SELECT network_id, genesis_hash AS genesis_fingerprint, {sql_t('max(observed_at)')} AS last_verified_at,
  arg_min(block_height, row(observed_at, probe_id)) FILTER (WHERE block_height IS NOT NULL) AS first_observed_height,
  arg_max(block_height, row(observed_at, probe_id)) FILTER (WHERE block_height IS NOT NULL) AS last_observed_height
FROM probes WHERE success AND genesis_hash <> '' GROUP BY 1, 2""",
)
def _(spark, sf):
    p = role(spark, sf, "probes")
    inc = p.filter("success AND genesis_hash <> ''").select("network_id", F.col("genesis_hash").alias("genesis_fingerprint")).distinct()
    df = V.apply_verified(p, inc)
    return df.select("network_id", "genesis_fingerprint", t("last_verified_at").alias("last_verified_at"), "first_observed_height", "last_observed_height")


@query(
    "verification_summary",
    "V4",
    cte("probes") + PUBLISHED + f"""SELECT candidate_id, bool_or(success) AS has_fingerprint, coalesce(bool_or(failure_class = 'identity_mismatch'), FALSE) AS identity_mismatch,
  count(*) FILTER (WHERE NOT success AND failure_class IS DISTINCT FROM 'identity_mismatch') AS endpoint_failures,
  {sql_t('max(CASE WHEN success THEN observed_at END)')} AS last_verified_at FROM cls GROUP BY 1""",
)
def _(spark, sf):
    df = V.verification_summary(_classified(spark, sf))
    return df.select("candidate_id", "has_fingerprint", "identity_mismatch", "endpoint_failures", t("last_verified_at").alias("last_verified_at"))


@query(
    "endpoint_resolution",
    "V6",
    cte("probes") + "SELECT probe_id, 'https://rpc.example.com/' || CAST(candidate_id AS STRING) AS url FROM probes WHERE probe_id % 2 = 0",
)
def _(spark, sf):
    """Even probes carry the hash of the published URL, odd ones of another URL."""
    p = role(spark, sf, "probes")
    base = F.concat(F.lit("https://rpc.example.com/"), F.col("candidate_id").cast("string"))
    obs = p.select("probe_id", "network_id", endpoint_hash(F.when(F.col("probe_id") % 2 == 0, base).otherwise(F.concat(base, F.lit("/old")))).alias("endpoint_hash"))
    urls = published(spark, sf).select("network_id", F.lit("rpc").alias("kind"), "url")
    return V.resolve_endpoints(obs, urls).select("probe_id", "url")


_ODD_URL = """CASE page_id % 8 WHEN 0 THEN 'https://10.' || CAST(page_id % 250 AS STRING) || '.0.1/rpc' WHEN 1 THEN 'https://8.8.8.' || CAST(page_id % 250 AS STRING) || ':8545'
 WHEN 2 THEN replace(url, 'http://', 'https://') || ':9' WHEN 3 THEN 'ftp://files.example.com/' || CAST(page_id AS STRING) WHEN 4 THEN 'https://172.' || CAST(page_id % 64 AS STRING) || '.0.1:443/'
 WHEN 5 THEN 'https://node' || CAST(page_id AS STRING) || '.example.com:' || CAST(9648 + page_id % 4 AS STRING) || '/x' ELSE url END"""


@query(
    "endpoint_screen",
    "V5",
    f""", u AS (SELECT page_id, {_ODD_URL} AS url FROM pages), q AS (SELECT *, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host,
 regexp_extract(url, '^[a-z]+://[^/?#:]*:([^/?#]*)', 1) AS port FROM u),
p AS (SELECT *, CASE WHEN port = '' THEN 443 ELSE TRY_CAST(port AS INT) END AS pn, CASE WHEN regexp_full_match(host, '[0-9.]+') THEN list_transform(string_split(host, '.'), lambda x: CAST(x AS INT)) END AS ip FROM q)
SELECT page_id, CASE WHEN scheme <> 'https' THEN 'scheme' WHEN pn NOT IN (80, 443, 8545, 8546, 26657, 9944, 8899, 9650, 4000) THEN 'port'
 WHEN ip[1] = 10 OR (ip[1] = 172 AND ip[2] BETWEEN 16 AND 31) THEN 'address' END AS rejected_for FROM p""".replace(", u AS", "WITH u AS", 1),
)
def _(spark, sf):
    u = table(spark, sf, "pages").selectExpr("page_id", f"{_ODD_URL} AS url")
    return V.screen_endpoints(u).select("page_id", "rejected_for")
