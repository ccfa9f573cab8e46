"""Text queries: keys and URLs, lexicon and geography, opportunities, funding claims.

The tables hold invented prose, so each document gets one closing line, chosen by its id, in which
the real terms occur; the whole text is matched.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.functions import text as X
from winnow.functions import timefn as TF
from winnow.operators import funding as FU
from winnow.operators import geography as G
from winnow.operators import opportunity as OP
from winnow.plans.registry import query
from winnow.plans.roles import AS_OF, ORDERS_AS_OF, cte, r, role, sql_t, t, table
from winnow.settings import DEFAULT
from winnow.sources.lexicon import PAN_TERMS, countries_dim, default_lexicon, default_rows

_TAILS = (
    "Open role: country manager who covers Nigeria and  Kenya from one desk.",
    "Yesterday Chad fixed the build and went home.",
    "Three new desks in West Africa, one each in Senegal, Niger and Mali.",
    "Mobile   money and M-Pesa payments for merchants.",
    "Lancement au Gabon et en Cote d''Ivoire: partenariat et ambassadeur.",
    "The hackathon in Lagos pays in NGN, a strategic partner of ECOWAS.",
    "A rede expande para Angola com parceria e embaixador na áfrica.",
    "Nothing to report on this page.",
    "Guinea pig trials in Togo, with a regulator and a central bank.",
    "Our Nairobi office serves Nigeriana and Kenya; developer grant and validator onboarding.",
    "Subvencao e subsidio, communaute: expansao em Cabo Verde.",
    "Cross-border payments, on-ramp and off-ramp for South Sudan and Sudan.",
)
_TEXT = "text || chr(10) || CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_TAILS)) + " END"
_FLAGS = {
    "is_official_source": "doc_id % 2 = 0",
    "has_local_team": "CASE WHEN doc_id % 7 = 0 THEN TRUE WHEN doc_id % 7 < 3 THEN FALSE END",
    "has_public_contact": "CASE WHEN doc_id % 5 = 0 THEN TRUE WHEN doc_id % 5 = 1 THEN FALSE END",
    "has_funding_or_activity": "CASE WHEN doc_id % 3 = 0 THEN TRUE WHEN doc_id % 3 = 1 THEN FALSE END",
}


def docs(spark, sf, flags: bool = False):
    extra = [f"{e} AS {c}" for c, e in _FLAGS.items()] if flags else []
    return table(spark, sf, "documents").selectExpr("doc_id", f"{_TEXT} AS text", *extra)


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# The same lexicon as VALUES, and the matches it has in every document. Each character that is no
# word character is set off by chr(1) on both sides, so a plain substring test respects word edges.
_LEX = ", ".join(f"({_quote(k)}, {_quote(e)}, {_quote(x)}, {str(a).upper()})" for k, e, x, a in default_rows())
_W = r"[\p{L}\p{N}_]"
DOCS_SQL = f"""WITH docs AS (SELECT doc_id, {_TEXT} AS text, {", ".join(f"{e} AS {c}" for c, e in _FLAGS.items())} FROM documents),
lex AS (SELECT *, replace(lower(term), 'ß', 'ss') AS norm, strip_accents(replace(lower(term), 'ß', 'ss')) AS bare FROM (VALUES {_LEX}) t(kind, entity, term, ambiguous)),
forms AS (SELECT kind, entity, term, ambiguous, FALSE AS stripped, norm AS form FROM lex UNION ALL
  SELECT kind, entity, term, ambiguous, TRUE, CASE WHEN kind = 'pan' THEN norm ELSE bare END FROM lex WHERE kind = 'pan' OR bare <> norm),
pats AS MATERIALIZED (SELECT *, chr(1) || regexp_replace(form, '([^\\p{{L}}\\p{{N}}_])', chr(1) || '\\1' || chr(1), 'g') || chr(1) AS needle FROM forms),
low AS MATERIALIZED (SELECT doc_id, regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g') AS norm FROM docs),
hay AS MATERIALIZED (SELECT doc_id, chr(1) || regexp_replace(norm, '([^\\p{{L}}\\p{{N}}_])', chr(1) || '\\1' || chr(1), 'g') || chr(1) AS norm,
  chr(1) || regexp_replace(strip_accents(norm), '([^\\p{{L}}\\p{{N}}_])', chr(1) || '\\1' || chr(1), 'g') || chr(1) AS bare FROM low),
hits AS MATERIALIZED (SELECT DISTINCT doc_id, kind, entity, term, ambiguous FROM hay, pats WHERE contains(CASE WHEN stripped THEN bare ELSE norm END, needle))
"""
_GEO = """, agg AS (SELECT doc_id, list_sort(list(DISTINCT entity) FILTER (WHERE kind = 'country' AND NOT ambiguous)) AS plain,
  list(DISTINCT entity) FILTER (WHERE kind = 'country' AND ambiguous) AS maybe, list(DISTINCT term) FILTER (WHERE kind = 'country' AND ambiguous) AS maybe_forms,
  list(DISTINCT entity) FILTER (WHERE kind = 'hub') AS hub_countries, list(DISTINCT term) FILTER (WHERE kind = 'hub') AS hub_cities, list(DISTINCT term) FILTER (WHERE kind = 'country' AND NOT ambiguous) AS plain_forms,
  coalesce(bool_or(kind = 'pan'), FALSE) AS pan, list(DISTINCT entity) FILTER (WHERE kind = 'region') AS regs, list(DISTINCT entity) FILTER (WHERE kind = 'bloc') AS blocs,
  list(DISTINCT entity) FILTER (WHERE kind = 'currency') AS curs, list(DISTINCT entity) FILTER (WHERE kind = 'rail') AS rails, list(DISTINCT entity) FILTER (WHERE kind = 'language') AS langs,
  list(DISTINCT entity) FILTER (WHERE kind = 'intent') AS packs, list(DISTINCT term) FILTER (WHERE kind = 'intent') AS intent_terms, list(DISTINCT entity) FILTER (WHERE kind = 'use_case') AS uses FROM hits GROUP BY 1),
a0 AS (SELECT docs.*, coalesce(plain, []) AS plain, coalesce(maybe, []) AS maybe, coalesce(maybe_forms, []) AS maybe_forms, coalesce(hub_countries, []) AS hub_countries, coalesce(hub_cities, []) AS hub_cities,
  coalesce(plain_forms, []) AS plain_forms, coalesce(pan, FALSE) AS pan, coalesce(regs, []) AS regs, coalesce(blocs, []) AS blocs, coalesce(curs, []) AS curs, coalesce(rails, []) AS rails,
  coalesce(langs, []) AS langs, coalesce(packs, []) AS packs, coalesce(intent_terms, []) AS intent_terms, coalesce(uses, []) AS uses FROM docs LEFT JOIN agg USING (doc_id)),
a1 AS (SELECT *, (pan OR len(plain) > 0 OR len(hub_countries) > 0 OR len(blocs) > 0 OR len(curs) > 0) AS ok FROM a0),
geo AS (SELECT *, list_sort(list_distinct(plain || hub_countries || CASE WHEN ok THEN maybe ELSE [] END)) AS countries,
  list_sort(regs || CASE WHEN pan THEN ['Pan-Africa'] ELSE [] END) AS regions, CASE WHEN ok THEN [] ELSE list_sort(maybe_forms) END AS rejected FROM a1)
"""
_FEATURES = """, f1 AS (SELECT *, (len(countries) > 0 OR len(hub_cities) > 0) AS near, (len(regions) > 0 OR len(blocs) > 0) AS wide, (len(rails) > 0 OR len(curs) > 0) AS money FROM geo),
f2 AS (SELECT *, CASE WHEN near THEN CASE WHEN is_official_source THEN 30 ELSE 15 END WHEN wide THEN CASE WHEN is_official_source THEN 20 ELSE 10 END ELSE 0 END AS eg,
  CASE WHEN near OR wide THEN least(20, CASE WHEN list_has_any(packs, ['hiring', 'market_entry']) THEN 12 ELSE 0 END + CASE WHEN list_has_any(packs, ['programs', 'partnership']) THEN 8 ELSE 0 END + CASE WHEN money THEN 8 ELSE 0 END) ELSE 0 END AS ra,
  least(15, 5 * len(uses)) AS uc, CASE WHEN has_local_team IS NULL THEN 0 WHEN NOT has_local_team THEN 15 ELSE 3 END AS ws, CASE WHEN has_public_contact THEN 10 ELSE 0 END AS ct,
  CASE WHEN has_funding_or_activity IS NULL THEN 0 WHEN has_funding_or_activity THEN 10 ELSE 3 END AS oc FROM f1),
feat AS (SELECT *, least(100, eg + ra + uc + ws + ct + oc)::DOUBLE AS total, CASE WHEN coalesce(has_local_team, FALSE) AND (near OR wide) THEN 'A5_already_covered'
  WHEN is_official_source AND (near OR wide) AND list_has_any(packs, ['hiring', 'market_entry', 'programs', 'partnership']) THEN 'A1_explicit_intent'
  WHEN (near OR wide) AND (ra >= 8 OR money OR len(langs) > 1) THEN 'A2_active_regional_motion' WHEN uc >= 5 OR near OR wide THEN 'A3_africa_compatible' ELSE 'A4_no_evidence' END AS label FROM f2)
"""
FEATURES_SQL = DOCS_SQL + _GEO + _FEATURES


@query("lexicon_matches", "C1 U1 S3", DOCS_SQL + "SELECT doc_id, kind, entity, term FROM hits")
def _(spark, sf):
    return G.match_lexicon(docs(spark, sf), default_lexicon(spark)).select("doc_id", "kind", "entity", "term")


@query(
    "geography",
    "C2",
    DOCS_SQL + _GEO + "SELECT doc_id, array_to_string(countries, ',') AS countries, array_to_string(regions, ',') AS regions, array_to_string(list_sort(blocs), ',') AS blocs, array_to_string(list_sort(hub_cities), ',') AS hubs, array_to_string(list_sort(curs), ',') AS currencies, array_to_string(list_sort(rails), ',') AS rails, array_to_string(list_sort(langs), ',') AS languages, array_to_string(rejected, ',') AS rejected_ambiguous FROM geo",
)
def _(spark, sf):
    g = G.extract_geography(docs(spark, sf), default_lexicon(spark))
    j = lambda c: F.array_join(c, ",")
    return g.select(
        "doc_id", *[j(c).alias(c) for c in ("countries", "regions", "blocs", "currencies", "rails", "languages", "rejected_ambiguous")],
        F.array_join(F.array_sort("hubs.city"), ",").alias("hubs"),
    )


@query("intent_packs", "C3", DOCS_SQL + "SELECT doc_id, entity AS pack, count(DISTINCT term) AS n_terms FROM hits WHERE kind = 'intent' GROUP BY 1, 2")
def _(spark, sf):
    hits = G.match_lexicon(docs(spark, sf), default_lexicon(spark), kinds=("intent",))
    return hits.groupBy("doc_id", F.col("entity").alias("pack")).agg(F.count_distinct("term").alias("n_terms"))


@query(
    "regional_fit_features",
    "C4 C5 C6",
    FEATURES_SQL + """SELECT doc_id, eg::DOUBLE AS explicit_geo, ra::DOUBLE AS regional_action, uc::DOUBLE AS use_case_fit, ws::DOUBLE AS whitespace, ct::DOUBLE AS contactability, oc::DOUBLE AS operating_capacity,
 total AS total_score, label, CASE WHEN label = 'A4_no_evidence' THEN 0 ELSE round((0.45 + CASE WHEN near THEN 0.25 WHEN wide THEN 0.15 ELSE 0 END + CASE WHEN is_official_source THEN 0.20 ELSE 0 END - CASE WHEN len(rejected) > 0 THEN 0.10 ELSE 0 END)::DOUBLE, 2) END AS label_confidence FROM feat""",
)
def _(spark, sf):
    df = G.africa_features(docs(spark, sf, flags=True), default_lexicon(spark))
    return df.select("doc_id", "explicit_geo", "regional_action", "use_case_fit", "whitespace", "contactability", "operating_capacity", "total_score", "label", "label_confidence")


@query(
    "evidence_snippets",
    "C7",
    DOCS_SQL + _GEO + """, nd AS (SELECT doc_id, text, list_distinct(list_transform(plain_forms || CASE WHEN ok THEN maybe_forms ELSE [] END || hub_cities || regions || blocs || rails || intent_terms, lambda x: strip_accents(replace(lower(x), 'ß', 'ss')))) AS needles FROM geo),
ln AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\r\\n|[\\n\\r]'), lambda l: trim(l)), lambda l: l <> '' AND len(list_filter(needles, lambda n: contains(strip_accents(replace(lower(l), 'ß', 'ss')), n))) > 0) AS lines FROM nd WHERE len(needles) > 0)
SELECT doc_id, array_to_string(list_transform(lines[1:5], lambda l: l[1:200]), '|') AS snippets FROM ln""",
)
def _(spark, sf):
    d = docs(spark, sf)
    out = G.snippets(d, G.extract_geography(d, default_lexicon(spark)))
    return out.select("doc_id", F.array_join("snippets", "|").alias("snippets"))


@query(
    "country_scores",
    "C8",
    FEATURES_SQL + """, x AS (SELECT doc_id, unnest(countries) AS country, packs, is_official_source FROM feat)
SELECT x.doc_id, country, round((0.4 + CASE WHEN EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = x.doc_id AND kind = 'hub' AND entity = country) THEN 0.2 ELSE 0 END + CASE WHEN len(packs) > 0 THEN 0.2 ELSE 0 END + CASE WHEN is_official_source THEN 0.2 ELSE 0 END)::DOUBLE, 2) AS strength,
 country IN ('Nigeria', 'Kenya', 'Ghana', 'South Africa', 'Rwanda', 'Egypt', 'Morocco', 'Uganda', 'Tanzania', 'Senegal', 'Cote d''Ivoire') AS is_priority_market FROM x""",
)
def _(spark, sf):
    df = G.africa_features(docs(spark, sf, flags=True), default_lexicon(spark))
    return G.country_scores(df, countries_dim(spark)).select("doc_id", "country", "strength", "is_priority_market")


@query(
    "priority_markets",
    "A3",
    DOCS_SQL + _GEO + ", x AS (SELECT unnest(countries) AS country FROM geo), m(iso2, country) AS (VALUES ('NG', 'Nigeria'), ('KE', 'Kenya'), ('GH', 'Ghana'), ('ZA', 'South Africa'), ('RW', 'Rwanda'), ('EG', 'Egypt'), ('MA', 'Morocco'), ('UG', 'Uganda'), ('TZ', 'Tanzania'), ('SN', 'Senegal'), ('CI', 'Cote d''Ivoire'))\n"
    "SELECT iso2, m.country, (SELECT count(*) FROM x WHERE x.country = m.country) AS chain_count FROM m",
)
def _(spark, sf):
    from winnow.operators.queues import priority_markets

    g = G.extract_geography(docs(spark, sf), default_lexicon(spark))
    return priority_markets(g, countries_dim(spark))


_PACKS = (("lifecycle", "public testnet"), ("program", "hackathon"), ("program", "ambassadeur"), ("jobs", "country manager"), ("english", "the"), ("german", "der"), ("security", "regulator"))


@query(
    "keyword_packs",
    "S7",
    f"WITH docs AS (SELECT doc_id, {_TEXT} AS text FROM documents), packs(pack, term) AS (VALUES {', '.join(f'({_quote(p)}, {_quote(x)})' for p, x in _PACKS)})\n"
    "SELECT DISTINCT doc_id, pack FROM docs, packs WHERE contains(lower(text), split_part(term, ' ', 1)) AND regexp_matches(replace(lower(text), 'ß', 'ss'), '(^|[^\\p{L}\\p{N}_])' || replace(term, ' ', '\\s+') || '($|[^\\p{L}\\p{N}_])')",
)
def _(spark, sf):
    packs = spark.createDataFrame(list(_PACKS), "pack string, term string")
    return G.tag_keyword_packs(docs(spark, sf), packs)


def _opp_sql() -> str:
    parts = [
        f"SELECT doc_id, {_quote(k)} AS opportunity_type, {_quote(resp)} AS response, regexp_extract(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])({terms})(?:$|[^\\p{{L}}\\p{{N}}_])', 1) AS matched FROM docs"
        for k, terms, resp in OP.OPPORTUNITIES
    ]
    return f"WITH docs AS (SELECT doc_id, {_TEXT} AS text FROM documents), opps AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE matched <> '')\n"


@query("opportunities", "C11", _opp_sql() + "SELECT doc_id, opportunity_type, response, matched FROM opps")
def _(spark, sf):
    return OP.classify_opportunities(docs(spark, sf)).select("doc_id", "opportunity_type", "response", "matched")


@query(
    "opportunity_records",
    "C12",
    _opp_sql() + """SELECT doc_id % 50 AS candidate_id, opportunity_type, arg_min(response || ' (matched: ' || matched || ')', doc_id) AS summary, count(DISTINCT doc_id) AS n_evidence FROM opps GROUP BY 1, 2""",
)
def _(spark, sf):
    d = docs(spark, sf).select(
        "doc_id", "text", (F.col("doc_id") % 50).alias("candidate_id"), F.col("doc_id").alias("evidence_id"), F.timestamp_seconds("doc_id").alias("observed_at")
    )
    out = OP.upsert_opportunities(OP.classify_opportunities(d))
    return out.select("candidate_id", "opportunity_type", "summary", "n_evidence")


# -- funding -------------------------------------------------------------------------------------

_N = "CAST(o_orderkey % 90 + 1 AS STRING)"
_NEWS = f"""'Order ' || CAST(o_orderkey AS STRING) || ' shipped for a $50 fee. ' || CASE o_orderkey % 9
 WHEN 0 THEN 'The team raised $' || {_N} || ' million in a seed round led by Fund ' || {_N} || ' Capital, with participation from Alpha Labs, Beta Ventures and Gamma.'
 WHEN 1 THEN 'Company ' || {_N} || ' secured €' || {_N} || 'm Series A led by Birch Street with others!'
 WHEN 2 THEN 'They announced a funding round of USD ' || {_N} || ',500,000.' || chr(10) || 'It raised $12 only.'
 WHEN 3 THEN 'A pre-seed raise is planned. The project closes its strategic round, backed by Delta.'
 WHEN 4 THEN 'It raises ' || {_N} || ' million soon. Nothing else was said.'
 WHEN 5 THEN 'It raised $' || {_N} || '.5bn. Later it raised $' || {_N} || '.5bn in an investment round led by Omega Group.'
 WHEN 6 THEN 'A grant was paid: they secured $' || {_N} || 'K? Alongside that, no round.'
 WHEN 7 THEN 'Raising a Series  B of £' || {_N} || ' thousand, joined by One, Two and Three.'
 ELSE 'No news today.' END"""


def news(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS doc_id", f"{_NEWS} AS text", "o_orderkey % 2 = 0 AS is_official", "CAST(o_orderdate AS TIMESTAMP) AS published_at", "o_custkey AS candidate_id"
    )


_FB, _FE = "(?:^|[^\\p{L}\\p{N}_])", "(?:$|[^\\p{L}\\p{N}_])"


def _duck(rx: str) -> str:
    """Word edges in the form DuckDB's regular expressions know."""
    return rx.replace(FU._B, _FB).replace(FU._E, _FE).replace("(?i)", "").replace("(?m)", "").replace("'", "''")


FUNDING_SQL = f"""WITH news AS (SELECT o_orderkey AS doc_id, {_NEWS} AS text, o_orderkey % 2 = 0 AS is_official, o_orderdate AS published_at, o_custkey AS candidate_id FROM orders),
s0 AS (SELECT *, unnest(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+')) AS sentence, generate_subscripts(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), 1) AS pos FROM news),
s1 AS (SELECT * FROM s0 WHERE regexp_matches(sentence, '{_duck(FU.RAISE_VERBS)}', 'i')),
s2 AS (SELECT *, list_filter(list_transform(range(1, len(regexp_extract_all(sentence, '{FU.AMOUNT}', 3)) + 1), lambda i: {{
   'txt': trim(regexp_extract_all(sentence, '{FU.AMOUNT}', 0)[i]), 'sign': regexp_extract_all(sentence, '{FU.AMOUNT}', 1)[i], 'code': upper(regexp_extract_all(sentence, '{FU.AMOUNT}', 2)[i]),
   'num': CAST(replace(regexp_extract_all(sentence, '{FU.AMOUNT}', 3)[i], ',', '') AS DOUBLE), 'mag': lower(regexp_extract_all(sentence, '{FU.AMOUNT}', 4)[i])}}),
   lambda x: (x.sign <> '' OR x.code <> '') AND (x.mag <> '' OR x.num >= 1000))[1] AS a,
  CASE {" ".join(f"WHEN regexp_matches(sentence, '{_duck(rx)}', 'i') THEN '{n}'" for n, rx in FU.ROUND_PATTERNS)} ELSE 'undisclosed' END AS round_type,
  trim(regexp_extract(sentence, '{_duck(FU.LEAD)}', 1)) AS lead, regexp_extract(sentence, '{_duck(FU.PARTICIPATION)}', 1, 'i') AS others FROM s1),
s3 AS (SELECT *, CASE a.sign WHEN '$' THEN 'USD' WHEN '€' THEN 'EUR' WHEN '£' THEN 'GBP' WHEN '¥' THEN 'JPY' ELSE nullif(a.code, '') END AS cur FROM s2 WHERE a.txt IS NOT NULL OR round_type <> 'undisclosed'),
s4 AS (SELECT doc_id, pos, round_type, CASE WHEN cur = 'USD' THEN a.num * CASE WHEN a.mag IN ('k', 'thousand') THEN 1e3 WHEN a.mag IN ('m', 'mm', 'million') THEN 1e6 WHEN a.mag IN ('b', 'bn', 'billion') THEN 1e9 ELSE 1 END END AS amount_usd,
  a.txt AS amount_as_published, coalesce(cur, 'USD') AS currency, nullif(lead, '') AS lead_investor, sentence[1:500] AS quote, published_at, candidate_id, is_official, lead, others FROM s3),
s5 AS (SELECT *, round((0.30 + CASE WHEN amount_usd IS NOT NULL THEN 0.30 ELSE 0 END + CASE WHEN round_type <> 'undisclosed' THEN 0.15 ELSE 0 END + CASE WHEN lead <> '' OR others <> '' THEN 0.10 ELSE 0 END + CASE WHEN is_official THEN 0.15 ELSE 0 END)::DOUBLE, 2) AS confidence FROM s4),
claims AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, round_type, amount_as_published ORDER BY confidence DESC, pos) rn FROM s5) WHERE rn = 1)
"""


@query(
    "funding_claims",
    "C13 C14 C15 C17 C18",
    FUNDING_SQL + "SELECT doc_id, round_type, amount_usd, amount_as_published, currency, lead_investor, quote, confidence FROM claims",
)
def _(spark, sf):
    return FU.extract_funding(news(spark, sf)).select("doc_id", "round_type", "amount_usd", "amount_as_published", "currency", "lead_investor", "quote", "confidence")


@query("funding_investors", "C16")
def _(spark, sf):
    return FU.extract_funding(news(spark, sf)).select("doc_id", "round_type", F.array_join("investors", "; ").alias("investors"))


@query(
    "funding_round_records",
    "C19",
    cte("rounds") + """, s AS (SELECT candidate_id % 40 AS c, round_type, CAST(amount_usd IS NULL AS STRING) AS amt, confidence, lead_investor, round_id, row_number() OVER (PARTITION BY candidate_id % 40, round_type, amount_usd IS NULL ORDER BY round_id) AS rn,
  max(confidence) OVER (PARTITION BY candidate_id % 40, round_type, amount_usd IS NULL ORDER BY round_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM rounds),
k AS (SELECT * FROM s WHERE before IS NULL OR confidence > before)
SELECT c AS candidate_id, round_type, amt AS amount_as_published, max(confidence) AS confidence, arg_min(lead_investor, round_id) FILTER (WHERE lead_investor IS NOT NULL) AS lead_investor FROM k GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    """Coarse keys, so that many announcements meet one record."""
    new = role(spark, sf, "rounds").select(
        (F.col("candidate_id") % 40).alias("candidate_id"), "round_type", F.col("amount_usd").isNull().cast("string").alias("amount_as_published"),
        F.lit(None).cast("timestamp").alias("announced_at"), "amount_usd", "currency", "lead_investor", F.lit(None).cast("string").alias("quote"),
        "source_url", "confidence", F.col("round_id").alias("seq"),
    )
    return FU.upsert_funding_rounds(new).select("candidate_id", "round_type", "amount_as_published", "confidence", "lead_investor")


@query(
    "funding_summary",
    "C20",
    cte("candidates", "rounds") + f""", g AS (SELECT candidate_id, sum(amount_usd) FILTER (WHERE amount_usd <> 0) AS total, count(*) AS n, count(*) FILTER (WHERE amount_usd <> 0) AS nd,
  arg_max(round_type, row(announced_at, -round_id)) FILTER (WHERE announced_at IS NOT NULL) AS lt, max(announced_at) AS la FROM rounds GROUP BY 1)
SELECT c.candidate_id, CASE WHEN total >= 15000000 THEN 'well_funded' WHEN total >= 2000000 THEN 'materially_funded' WHEN nd > 0 THEN 'lightly_funded' WHEN n > 0 THEN 'raised_amount_undisclosed' ELSE 'no_public_funding_evidence' END AS band,
  round(total, 2) AS total_disclosed_usd, coalesce(n, 0) AS rounds_recorded, coalesce(nd, 0) AS rounds_disclosed, lt AS latest_round_type, {sql_t('la')} AS latest_announced_at FROM candidates c LEFT JOIN g ON c.candidate_id = g.candidate_id""",
)
def _(spark, sf):
    df = FU.funding_summary(role(spark, sf, "rounds"), role(spark, sf, "candidates"))
    return df.select("candidate_id", "band", r("total_disclosed_usd", 2).alias("total_disclosed_usd"), "rounds_recorded", "rounds_disclosed", "latest_round_type", t("latest_announced_at").alias("latest_announced_at"))


@query(
    "top_investors",
    "C20",
    "WITH invs AS (SELECT DISTINCT o_custkey AS candidate_id, 'Investor ' || CAST((o_orderkey + p) % 50 AS STRING) AS investor FROM (SELECT *, unnest(range(0, o_orderkey % 3 + 1)) AS p FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 4 = 0))\n"
    "SELECT candidate_id, investor, CAST(rn AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY investor) rn FROM invs) WHERE rn <= 20",
)
def _(spark, sf):
    from winnow.plans.queues import investors

    return FU.top_investors(investors(spark, sf))


def kb(spark, sf):
    """Suppliers and part names as a curated announcement list with two aliases each."""
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("kb_id"),
        F.array(F.concat(F.lit("Customer#"), F.lpad(((F.col("p_partkey") * 3) % 500).cast("string"), 8, "0")), F.concat(F.lit("omer#0000000"), (F.col("p_partkey") % 90 + 10).cast("string"))).alias("names"),
        F.lit("seed").alias("round_type"),
        F.col("p_retailprice").alias("amount_usd"),
        F.concat(F.lit("$"), F.col("p_size").cast("string"), F.lit("M")).alias("amount_as_published"),
        F.lit("USD").alias("currency"),
        F.col("p_brand").alias("lead_investor"),
        F.array("p_brand").alias("investors"),
        F.concat(F.lit("https://kb.example.com/"), F.col("p_partkey").cast("string")).alias("source_url"),
        F.lit("quoted").alias("quote"),
        F.lit(0.95).alias("confidence"),
        (F.lit("2025-06-01 00:00:00").cast("timestamp") + F.expr("interval 1 day") * (F.col("p_partkey") % 90)).alias("announced_at"),
    )


_KB = """kb AS (SELECT p_partkey AS kb_id, unnest(['customer#' || lpad(CAST((p_partkey * 3) % 500 AS STRING), 8, '0'), 'omer#0000000' || CAST(p_partkey % 90 + 10 AS STRING)]) AS alias FROM part)"""


@query(
    "recent_raises",
    "S6",
    "SELECT p_partkey AS kb_id FROM part WHERE TIMESTAMP '2025-06-01 00:00:00' + INTERVAL '1' DAY * (p_partkey % 90) BETWEEN TIMESTAMP '2025-07-01 00:00:00' AND TIMESTAMP '2025-08-10 00:00:00'",
)
def _(spark, sf):
    return FU.recent_raises(kb(spark, sf), until="2025-08-10 00:00:00").select("kb_id")


@query(
    "knowledge_base_matches",
    "J15",
    cte("candidates") + f", {_KB} SELECT DISTINCT candidate_id, kb_id FROM candidates, kb WHERE lower(canonical_name) = alias OR slug = alias OR (len(alias) >= 4 AND contains(lower(canonical_name), alias)) OR (len(canonical_name) >= 4 AND contains(alias, lower(canonical_name)))",
)
def _(spark, sf):
    return FU.match_funding_kb(role(spark, sf, "candidates"), kb(spark, sf))


@query("funding_enrichment", "C21")
def _(spark, sf):
    cands = role(spark, sf, "candidates")
    n = news(spark, sf).withColumn("source_url", F.concat(F.lit("https://news.example.com/"), F.col("doc_id").cast("string")))
    _evidence, rounds = FU.enrich_funding(cands, kb(spark, sf), n, ORDERS_AS_OF)
    return rounds.select("candidate_id", "round_type", "amount_as_published", "confidence")


# -- keys, URLs, times -----------------------------------------------------------------------------


@query(
    "normalized_names",
    "N11 N12 N13",
    r"""WITH p AS (SELECT p_partkey, '  ' || p_name || ' Labs,  INC. (' || p_brand || ') Chain_x foundation!' AS name FROM part),
n AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(name)), '[^\w\s-]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM p)
SELECT p_partkey, norm, trim(regexp_replace(regexp_replace(norm, '\b(labs|foundation|network|protocol|technologies|technology|tech|llc|inc|ltd|gmbh|dao|ventures|group|chain)\b', '', 'g'), '\s+', ' ', 'g')) AS root,
 trim(regexp_replace(norm, '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM n""",
)
def _(spark, sf):
    name = F.concat(F.lit("  "), "p_name", F.lit(" Labs,  INC. ("), "p_brand", F.lit(") Chain_x foundation!"))
    return table(spark, sf, "part").select("p_partkey", X.normalize_name(name).alias("norm"), X.root_name(name).alias("root"), X.slug(name).alias("slug"))


@query(
    "effective_domains",
    "N14",
    r"SELECT page_id, regexp_replace(lower(regexp_extract(CASE WHEN page_id % 3 = 0 THEN 'User:pw@WWW.' || regexp_replace(url, '^https?://', '') ELSE url END, '^(?:https?://)?(?:[^/?#]*@)?([^/?#:]*)', 1)), '^www\.', '') AS domain FROM pages",
)
def _(spark, sf):
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("User:pw@WWW."), F.regexp_replace("url", "^https?://", ""))).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", X.domain(url).alias("domain"))


@query(
    "chain_ids",
    "N15 N16",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey AS STRING) WHEN 1 THEN CAST(c_custkey AS STRING) WHEN 2 THEN 'chain-' || CAST(c_custkey AS STRING)
 ELSE CAST(CAST(c_custkey AS HUGEINT) * 18446744073709551616 + 18446744073709551615 AS STRING) END AS chain_id,
 CASE lower(c_mktsegment) WHEN 'evm' THEN 'eip155' ELSE lower(c_mktsegment) END || ':' || CAST(c_custkey AS STRING) AS caip2 FROM customer""",
)
def _(spark, sf):
    raw = F.expr("CASE c_custkey % 4 WHEN 0 THEN '0x' || hex(c_custkey) WHEN 1 THEN ' 00' || c_custkey || ' ' WHEN 2 THEN 'chain-' || c_custkey ELSE '0X' || hex(c_custkey) || 'FFFFFFFFFFFFFFFF' END")
    seg = F.lower("c_mktsegment")
    return table(spark, sf, "customer").select(
        "c_custkey", X.chain_id(raw).alias("chain_id"), X.caip2(X.default_namespace(seg), F.col("c_custkey").cast("string")).alias("caip2")
    )


@query(
    "stable_keys",
    "N17",
    """WITH d AS (SELECT c_custkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('org:' || lower(c_name) || ':' || CAST(c_nationkey AS STRING))) AS h FROM customer)
SELECT c_custkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS key FROM d""",
)
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.stable_key(F.lit(" ORG"), F.col("c_name"), F.col("c_nationkey")).alias("key"))


@query(
    "redacted_urls",
    "N18",
    r"""SELECT page_id, regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '^(https?://)', '\1<redacted>@') || '/v2/<redacted>/x?api_key=<redacted>&q=1&sigh=<redacted>' AS url FROM pages""",
)
def _(spark, sf):
    base = F.regexp_extract("url", "^([^?#]*)", 1)
    url = F.concat(F.regexp_replace(base, "^(https?://)", "$1user:pass@"), F.lit("/v2/0123456789abcdefABCDEF_-xyz/x?api_key=SECRET&q=1&sigh=abc"))
    return table(spark, sf, "pages").select("page_id", X.redacted_url(url).alias("url"))


@query(
    "channel_hashes",
    "N19",
    "SELECT s_suppkey, sha256(lower(trim(' ' || s_name || '@Mail.example '))) AS channel_hash, sha256(trim(' ' || s_name || '@Mail.example ')) AS endpoint_hash FROM supplier",
)
def _(spark, sf):
    v = F.concat(F.lit(" "), "s_name", F.lit("@Mail.example "))
    return table(spark, sf, "supplier").select("s_suppkey", X.channel_hash(v).alias("channel_hash"), X.endpoint_hash(v).alias("endpoint_hash"))


@query(
    "time_helpers",
    "N20 N21",
    f"""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE {sql_t("date_trunc('second', ts)")} END AS parsed, round((epoch(TIMESTAMP '{AS_OF}') - epoch(ts)) / 86400, 6) AS age_days,
 {sql_t("ts + INTERVAL 1 HOUR")} AS shown, '15m:' || CAST(CAST(floor(epoch(ts) / 900) AS BIGINT) AS STRING) AS bucket FROM events""",
)
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    text = (
        F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("event_id") % 3 == 1, F.concat(F.date_format(F.col("ts") + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
        .otherwise(F.lit("last week"))
    )
    return e.select(
        "event_id", t(TF.parse_ts(text)).alias("parsed"), r(TF.age_days(F.col("ts"), AS_OF)).alias("age_days"),
        t(TF.display_tz(F.col("ts"))).alias("shown"), TF.observed_bucket(F.col("ts"), 15).alias("bucket"),
    )


@query(
    "sql_functions",
    "U3",
    r"""SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, 'eip155:' || CAST(c_custkey AS STRING) AS caip2, sha256(lower(c_name)) AS channel FROM customer""",
)
def _(spark, sf):
    from winnow.functions.sqlfn import register_functions

    register_functions(spark)
    return table(spark, sf, "customer").selectExpr("c_custkey", "w_slug(c_name) AS slug", "w_caip2(' EIP155', CAST(c_custkey AS STRING)) AS caip2", "w_channel_hash(c_name) AS channel")
