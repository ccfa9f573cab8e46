"""The lexicon as one long table: (kind, entity, term, ambiguous).

``load_lexicon`` reads a folder of JSON files, which is where complete alias lists belong;
``default_lexicon`` holds the names that reports and rules refer to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "kind string, entity string, term string, ambiguous boolean"

# Country names with ISO code and region.
COUNTRIES = (
    ("Algeria", "DZ", "North Africa"), ("Angola", "AO", "Southern Africa"), ("Benin", "BJ", "West Africa"),
    ("Botswana", "BW", "Southern Africa"), ("Burkina Faso", "BF", "West Africa"), ("Burundi", "BI", "East Africa"),
    ("Cabo Verde", "CV", "West Africa"), ("Cameroon", "CM", "Central Africa"),
    ("Central African Republic", "CF", "Central Africa"), ("Chad", "TD", "Central Africa"),
    ("Comoros", "KM", "East Africa"), ("Congo (Democratic Republic)", "CD", "Central Africa"),
    ("Congo (Republic)", "CG", "Central Africa"), ("Cote d'Ivoire", "CI", "West Africa"),
    ("Djibouti", "DJ", "East Africa"), ("Egypt", "EG", "North Africa"), ("Equatorial Guinea", "GQ", "Central Africa"),
    ("Eritrea", "ER", "East Africa"), ("Eswatini", "SZ", "Southern Africa"), ("Ethiopia", "ET", "East Africa"),
    ("Gabon", "GA", "Central Africa"), ("Gambia", "GM", "West Africa"), ("Ghana", "GH", "West Africa"),
    ("Guinea", "GN", "West Africa"), ("Guinea-Bissau", "GW", "West Africa"), ("Kenya", "KE", "East Africa"),
    ("Lesotho", "LS", "Southern Africa"), ("Liberia", "LR", "West Africa"), ("Libya", "LY", "North Africa"),
    ("Madagascar", "MG", "East Africa"), ("Malawi", "MW", "Southern Africa"), ("Mali", "ML", "West Africa"),
    ("Mauritania", "MR", "West Africa"), ("Mauritius", "MU", "East Africa"), ("Morocco", "MA", "North Africa"),
    ("Mozambique", "MZ", "Southern Africa"), ("Namibia", "NA", "Southern Africa"), ("Niger", "NE", "West Africa"),
    ("Nigeria", "NG", "West Africa"), ("Rwanda", "RW", "East Africa"), ("Sao Tome and Principe", "ST", "Central Africa"),
    ("Senegal", "SN", "West Africa"), ("Seychelles", "SC", "East Africa"), ("Sierra Leone", "SL", "West Africa"),
    ("Somalia", "SO", "East Africa"), ("South Africa", "ZA", "Southern Africa"), ("South Sudan", "SS", "East Africa"),
    ("Sudan", "SD", "North Africa"), ("Tanzania", "TZ", "East Africa"), ("Togo", "TG", "West Africa"),
    ("Tunisia", "TN", "North Africa"), ("Uganda", "UG", "East Africa"), ("Zambia", "ZM", "Southern Africa"),
    ("Zimbabwe", "ZW", "Southern Africa"),
)
# Surface forms that need corroboration.
AMBIGUOUS = (
    "Benin", "CAR", "Chad", "Congo", "Gambia", "Gold Coast", "Guinea", "Guinée", "Mali", "Maurice", "Niger", "Togo",
)
# Pan-regional terms; any of them corroborates an ambiguous form.
PAN_TERMS = (
    "africa", "african", "afrique", "africain", "africaine", "áfrica", "africano", "africana", "afrika",
    "sub-saharan", "subsaharan", "maghreb", "afcfta", "ecowas", "cedeao", "sadc", "comesa", "eac",
    "african union", "union africaine",
)
PAN_REGION = "Pan-Africa"
# Regions.
REGIONS = (
    "West Africa", "East Africa", "North Africa", "Central Africa", "Southern Africa", "Sub-Saharan Africa",
    "Francophone Africa", "Lusophone Africa",
)
# Economic blocs and their forms.
BLOCS = {
    "AfCFTA": ("AfCFTA", "ZLECAf"), "AU": ("AU", "African Union", "Union Africaine", "UA"),
    "ECOWAS": ("ECOWAS", "CEDEAO"), "EAC": ("EAC",), "SADC": ("SADC",), "COMESA": ("COMESA",),
    "WAEMU": ("WAEMU", "UEMOA"), "CEMAC": ("CEMAC",),
}
# Hub cities and their countries.
HUBS = (
    ("Lagos", "Nigeria"), ("Abuja", "Nigeria"), ("Nairobi", "Kenya"), ("Accra", "Ghana"),
    ("Johannesburg", "South Africa"), ("Cape Town", "South Africa"), ("Kigali", "Rwanda"), ("Cairo", "Egypt"),
    ("Casablanca", "Morocco"), ("Dakar", "Senegal"), ("Kampala", "Uganda"), ("Dar es Salaam", "Tanzania"),
    ("Abidjan", "Cote d'Ivoire"), ("Addis Ababa", "Ethiopia"),
)
# Currency codes.
CURRENCIES = ("NGN", "KES", "GHS", "ZAR", "EGP", "MAD", "XOF", "XAF", "UGX", "TZS", "RWF", "ETB")
# Payment rails.
RAILS = (
    "mobile money", "m-pesa", "mpesa", "momo", "mtn momo", "airtel money", "orange money", "chipper", "chipper cash",
    "flutterwave", "paystack", "moniepoint", "opay", "palmpay", "pesaflow", "ecocash", "wave", "remittance",
    "cross-border payments", "on-ramp", "off-ramp", "p2p rails", "fiat ramp", "ussd",
)
# Intent and geography terms that mark a language.
LANGUAGES = {
    "en": (
        "expansion", "hiring", "community", "ambassador", "grant", "hackathon", "partnership", "market entry",
        "developer relations", "devrel", "africa", "nigeria", "kenya", "ghana", "south africa", "rwanda", "uganda",
        "tanzania", "egypt",
    ),
    "fr": (
        "expansion", "recrutement", "communauté", "ambassadeur", "subvention", "bourse", "partenariat",
        "entrée sur le marché", "relations développeurs", "développement de marché", "afrique", "africain",
        "africaine", "sénégal", "côte d'ivoire", "cameroun", "bénin", "togo", "mali", "guinée", "burkina faso",
        "congo", "gabon", "madagascar", "niger",
    ),
    "pt": (
        "expansão", "contratação", "comunidade", "embaixador", "subsídio", "bolsa", "parceria", "entrada no mercado",
        "relações com desenvolvedores", "áfrica", "africano", "africana", "angola", "moçambique", "cabo verde",
        "guiné-bissau", "são tomé e príncipe",
    ),
    "ar": (
        "توسع", "توظيف", "مجتمع", "سفير", "منحة", "هاكاثون", "شراكة", "دخول السوق", "علاقات المطورين", "أفريقيا",
        "شمال أفريقيا", "مصر", "المغرب", "الجزائر", "تونس", "ليبيا", "السودان", "موريتانيا",
    ),
    "sw": (
        "upanuzi", "uajiri", "jumuiya", "balozi", "ruzuku", "ushirikiano", "kuingia sokoni",
        "uhusiano wa watengenezaji", "afrika", "afrika mashariki", "kenya", "tanzania", "uganda", "rwanda", "burundi",
        "kongo",
    ),
}
# Intent packs.
INTENT_PACKS = {
    "hiring": (
        "africa lead", "regional lead", "country manager", "community manager", "devrel", "developer relations",
        "developer advocate", "ecosystem growth", "head of growth africa", "partnerships manager",
        "business development", "government relations", "regional growth", "ecosystem lead",
    ),
    "programs": (
        "ambassador", "ambassador program", "community chapter", "developer grant", "ecosystem grant", "accelerator",
        "hackathon", "validator cohort", "campus ambassador", "university tour", "developer bootcamp", "fellowship",
    ),
    "market_entry": (
        "expand to africa", "expanding in africa", "launch in africa", "market entry", "africa expansion",
        "regional strategy", "go-to-market", "localize", "distribution partner", "entering nigeria",
        "entering kenya", "africa launch",
    ),
    "adoption": (
        "payments", "stablecoins", "remittance", "mobile money", "financial inclusion", "depin", "rwa",
        "real world assets", "identity", "cross-border trade", "sme payments", "merchant adoption", "airtime",
        "microfinance",
    ),
    "partnership": (
        "mou", "memorandum of understanding", "strategic partner", "integration partner", "ecosystem partner",
        "launch partner", "local operator", "government partner", "central bank pilot", "telecom partnership",
        "fintech integration",
    ),
    "capital": (
        "ecosystem fund", "africa fund", "strategic investment", "grant pool", "venture fund", "rfp", "vendor RFP",
        "co-investment",
    ),
}
# Use-case terms.
USE_CASES = (
    "payments", "stablecoin", "remittance", "mobile money", "financial inclusion", "depin", "rwa", "identity",
    "cross-border", "merchant", "microfinance", "trade finance", "off-ramp", "on-ramp",
)


def default_rows() -> list[tuple[str, str, str, bool]]:
    """Rows of the built-in lexicon."""
    low = {a.casefold() for a in AMBIGUOUS}
    rows = [("country", n, n, n.casefold() in low) for n, _, _ in COUNTRIES]
    rows += [("pan", PAN_REGION, t, False) for t in PAN_TERMS]
    rows += [("region", r, r, False) for r in REGIONS]
    rows += [("bloc", b, t, False) for b, ts in BLOCS.items() for t in sorted({b, *ts})]
    rows += [("hub", country, city, False) for city, country in HUBS]
    rows += [("currency", c, c, False) for c in CURRENCIES]
    rows += [("rail", t, t, False) for t in RAILS]
    rows += [("language", code, t, False) for code, ts in LANGUAGES.items() for t in ts]
    rows += [("intent", p, t, False) for p, ts in INTENT_PACKS.items() for t in ts]
    rows += [("use_case", t, t, False) for t in USE_CASES]
    return rows


def default_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(default_rows(), SCHEMA)


def countries_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COUNTRIES), "name string, iso2 string, region string")


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Lexicon from JSON files (S3).

    ``countries.json`` (name, aliases, demonyms, ambiguous_aliases), ``hubs_and_rails.json``,
    ``regions_and_blocs.json``, ``languages.json`` and ``intent_keywords.json``. Pan-regional and
    use-case terms are rules and come from the built-in lexicon.
    """
    false = F.lit(False)

    def js(name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).json(f"{path}/{name}.json", multiLine=True)

    def rows(df: DataFrame, kind: str, entity, term, ambiguous=false) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), entity.alias("entity"), term.alias("term"), ambiguous.alias("ambiguous"))

    c = js(
        "countries",
        "countries array<struct<name:string,aliases:array<string>,demonyms:array<string>,ambiguous_aliases:array<string>>>",
    ).select(F.explode("countries").alias("c"))
    none = F.array().cast("array<string>")
    amb = c.select(F.explode("c.ambiguous_aliases").alias("a")).select(F.lower("a").alias("low")).distinct()
    forms = c.select(
        F.col("c.name").alias("name"),
        F.explode(
            F.array_distinct(
                F.concat(F.array("c.name"), F.coalesce("c.aliases", none), F.coalesce("c.demonyms", none))
            )
        ).alias("form"),
    ).withColumn("low", F.lower("form"))
    country = forms.join(amb.withColumn("a", F.lit(True)), "low", "left")
    parts = [rows(country, "country", F.col("name"), F.col("form"), F.coalesce("a", false))]
    h = js(
        "hubs_and_rails",
        "priority_hubs array<struct<city:string,country:string>>, currencies array<struct<code:string>>, payment_rails array<string>",
    )
    hubs = h.select(F.explode("priority_hubs").alias("x"))
    parts.append(rows(hubs, "hub", F.col("x.country"), F.col("x.city")))
    cur = h.select(F.explode("currencies.code").alias("x"))
    parts.append(rows(cur, "currency", F.col("x"), F.col("x")))
    rails = h.select(F.explode("payment_rails").alias("x"))
    parts.append(rows(rails, "rail", F.col("x"), F.col("x")))
    rb = js("regions_and_blocs", "regions map<string,array<string>>, economic_blocs map<string,struct<aliases:array<string>>>")
    regions = rb.select(F.explode(F.map_keys("regions")).alias("x"))
    parts.append(rows(regions, "region", F.col("x"), F.col("x")))
    blocs = rb.select(F.explode("economic_blocs").alias("k", "v"))
    blocs = blocs.select("k", F.explode(F.array_distinct(F.concat(F.array("k"), F.coalesce("v.aliases", none)))).alias("x"))
    parts.append(rows(blocs, "bloc", F.col("k"), F.col("x")))
    lang = js("languages", "languages map<string,struct<intent_terms:array<string>,geography_terms:array<string>>>")
    lang = lang.select(F.explode("languages").alias("k", "v"))
    lang = lang.select("k", F.explode(F.array_distinct(F.concat(F.coalesce("v.intent_terms", none), F.coalesce("v.geography_terms", none)))).alias("x"))
    parts.append(rows(lang, "language", F.col("k"), F.col("x")))
    packs = js("intent_keywords", "intent_packs map<string,struct<terms:array<string>>>")
    packs = packs.select(F.explode("intent_packs").alias("k", "v")).select("k", F.explode("v.terms").alias("x"))
    parts.append(rows(packs, "intent", F.col("k"), F.col("x")))
    parts.append(default_lexicon(spark).filter(F.col("kind").isin("pan", "use_case")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("term") != "")
