"""Lexicon matching over text, geography with ambiguity, intent, feature vector and labels.

One automaton holds all terms and reads each text once, where it lies. A lexicon that is too large for that
meets the documents as a table instead, word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.automaton import found_terms
from winnow.functions.once import spread, with_once
from winnow.functions.text import NOT_WORD_AFTER, NOT_WORD_BEFORE, WORD, fold_text, with_folded
from winnow.settings import DEFAULT, Rules
from winnow.sources.lexicon import PAN_REGION

# Labels by strength.
A1, A2, A3 = "A1_explicit_intent", "A2_active_regional_motion", "A3_africa_compatible"
A4, A5 = "A4_no_evidence", "A5_already_covered"
LABEL_RANK = {A4: 0, A3: 1, A2: 2, A1: 3, A5: 4}
# Evidence families that come from the project itself, and that show it is active.
OFFICIAL_FAMILIES = ("registry", "official_web")
ACTIVE_FAMILIES = ("code_search", "careers", "official_web", "registry", "infrastructure")
# Fixed value: kinds that can support a label with a quote.
NEEDLE_KINDS = ("country", "region", "pan", "bloc", "hub", "rail", "intent")


def compiled_lexicon(lexicon: DataFrame, unicode: str = "full") -> DataFrame:
    """Lexicon rows ready to match: form, first word, and a pattern for terms of several words.

    A term with diacritics is also tried without them on text without them; a pan-regional term is
    tried as it is on both.
    """
    low = lexicon.withColumn("norm", fold_text(F.col("term"), unicode=unicode))
    low = low.withColumn("bare", F.when(F.col("kind") == "pan", F.col("norm")).otherwise(fold_text(F.col("term"), strip_marks=True, unicode=unicode)))
    variants = F.array(
        F.struct(F.lit(False).alias("stripped"), F.col("norm").alias("form")),
        F.when((F.col("kind") == "pan") | (F.col("bare") != F.col("norm")), F.struct(F.lit(True).alias("stripped"), F.col("bare").alias("form"))),
    )
    rows = low.select("kind", "entity", "term", "ambiguous", F.inline(F.array_compact(variants)))
    rows = rows.withColumn("form", F.regexp_replace(F.trim("form"), r"(?U)\s+", " "))
    quoted = F.regexp_replace("form", r"([^\p{L}\p{N}_ ])", r"\\$1")
    pattern = F.concat(F.lit(NOT_WORD_BEFORE), quoted, F.lit(NOT_WORD_AFTER))
    return rows.select(
        "kind", "entity", "term", "ambiguous", "stripped",
        F.regexp_extract("form", f"{WORD}+", 0).alias("first_token"),
        F.col("form").rlike(f"^{WORD}+$").alias("single"),
        "form",
        pattern.alias("pattern"),
    )


#: Largest lexicon, in terms and in characters of all terms, that becomes an automaton; it is built in every task.
MAX_TERMS, MAX_TERM_CHARS = 20_000, 400_000


def match_lexicon(
    docs: DataFrame, lexicon: DataFrame, unicode: str = "full", kinds: tuple[str, ...] | None = None, distinct: bool = True,
    max_terms: int = MAX_TERMS,
) -> DataFrame:
    """(doc_id, kind, entity, term, ambiguous) for every term found in ``docs.text``.

    Texts pass through an Aho-Corasick automaton of all terms: neither texts nor words are shuffled or joined. A lexicon
    of more than ``max_terms`` terms, or very long ones, is joined to the words of the texts; the result is the same.
    """
    if kinds:
        lexicon = lexicon.filter(F.col("kind").isin(*kinds))
    columns = ["kind", "entity", "term", "ambiguous"]
    size = lexicon.limit(max_terms + 1).agg(F.count("*"), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    if size[0] > max_terms or size[1] > MAX_TERM_CHARS:
        out = _match_by_words(docs, lexicon, unicode)
    else:
        terms = [tuple(r) for r in lexicon.select(*columns).collect()]
        found = found_terms(terms, unicode)(F.col("text"))
        # The outer form adds no size filter, whose pushdown would read the texts twice.
        out = spread(docs.select("doc_id", "text")).select("doc_id", F.explode_outer(found).alias("m"))
        out = out.filter("m IS NOT NULL").select("doc_id", *[F.col(f"m.{c}") for c in columns])
    return out.distinct() if distinct else out


def _match_by_words(docs: DataFrame, lexicon: DataFrame, unicode: str) -> DataFrame:
    """Documents meet the lexicon as (word) rows without text, on the first word of each term. One-word terms
    are then matched; text is joined back, by document, for the terms that need a look at it."""
    text = with_folded(spread(docs.select("doc_id", "text")), "text", unicode).select("doc_id", "_norm", "_bare")

    def words(c: str) -> Column:
        return F.regexp_extract_all(F.col(c), F.lit(f"{WORD}+"), F.lit(0))

    # Words of the bare text are needed only where stripping changed something.
    plain = F.col("_norm") == F.col("_bare")
    tokens = F.when(plain, words("_norm")).otherwise(F.concat(words("_norm"), words("_bare")))
    hay = F.when(F.col("stripped"), F.col("_bare")).otherwise(F.col("_norm"))
    # A one-word term is matched by its token, unless the token may stem from the other form.
    # A plain substring test comes before any regular expression.
    found = (F.col("single") & plain) | (hay.contains(F.col("form")) & F.rlike(hay, F.col("pattern")))
    compiled = compiled_lexicon(lexicon, unicode)
    # The outer form of explode adds no size filter, whose pushdown would tokenise twice.
    pairs = text.select("doc_id", plain.alias("_plain"), F.explode_outer(F.array_distinct(tokens)).alias("first_token")).join(compiled, "first_token")
    sure = F.col("single") & F.col("_plain")
    out = pairs.filter(sure).unionByName(pairs.filter(~sure).join(text, "doc_id").filter(found).select(*pairs.columns))
    return out.select("doc_id", "kind", "entity", "term", "ambiguous")


def document_matches(docs: DataFrame, lexicon: DataFrame, unicode: str = "full", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document with sorted match sets; documents without a match keep empty sets.

    The carried columns and the match rows meet in one aggregate by ``doc_id``: no join, and only
    short rows are shuffled.
    """
    hits = match_lexicon(docs, lexicon, unicode, distinct=False)
    null = {c: docs.schema[c].dataType for c in carry}
    base = docs.select("doc_id", *carry)
    for c in ("kind", "entity", "term"):
        base = base.withColumn(c, F.lit(None).cast("string"))
    base = base.withColumn("ambiguous", F.lit(False))
    for c, ty in null.items():
        hits = hits.withColumn(c, F.lit(None).cast(ty))
    both = base.unionByName(hits)
    kind, entity, term, amb = (F.col(c) for c in ("kind", "entity", "term", "ambiguous"))

    def found(k: str, value: Column) -> Column:
        return F.array_sort(F.collect_set(F.when(kind == k, value)))

    return both.groupBy("doc_id").agg(
        *[F.max(c).alias(c) for c in carry],
        F.array_sort(F.collect_set(F.when((kind == "country") & ~amb, entity))).alias("_plain"),
        F.collect_set(F.when((kind == "country") & amb, F.struct(entity.alias("country"), term.alias("form")))).alias("_maybe"),
        F.array_sort(F.collect_set(F.when((kind == "country") & ~amb, term))).alias("_plain_forms"),
        F.collect_set(F.when(kind == "hub", F.struct(term.alias("city"), entity.alias("country")))).alias("hubs"),
        F.coalesce(F.bool_or(kind == "pan"), F.lit(False)).alias("pan_regional"),
        found("region", entity).alias("_regions"),
        found("bloc", entity).alias("blocs"),
        found("currency", entity).alias("currencies"),
        found("rail", entity).alias("rails"),
        found("language", entity).alias("languages"),
        found("intent", entity).alias("intent_packs"),
        found("intent", term).alias("intent_terms"),
        found("use_case", entity).alias("use_cases"),
    )


def extract_geography(docs: DataFrame, lexicon: DataFrame, unicode: str = "full", carry: tuple[str, ...] = ()) -> DataFrame:
    """Geography per document with the ambiguity rule (C2) and the intent packs.

    An ambiguous form counts only next to a pan-regional term, another country, a bloc, a hub or a
    currency; otherwise it is recorded as rejected.
    """
    m = document_matches(docs, lexicon, unicode, carry)
    known = F.array_union(F.col("_plain"), F.col("hubs.country"))
    ok = (
        F.col("pan_regional") | (F.size(known) > 0) | (F.size("blocs") > 0) | (F.size("currencies") > 0)
    )
    empty = F.array().cast("array<string>")
    m = m.withColumn("_ok", ok)
    return m.select(
        "doc_id", *carry,
        F.array_sort(F.array_union(known, F.when(F.col("_ok"), F.col("_maybe.country")).otherwise(empty))).alias("countries"),
        F.array_sort(
            F.when(F.col("pan_regional"), F.array_union(F.col("_regions"), F.array(F.lit(PAN_REGION)))).otherwise(F.col("_regions"))
        ).alias("regions"),
        "blocs", "hubs", "currencies", "rails", "languages",
        F.array_sort(F.array_distinct(F.when(F.col("_ok"), empty).otherwise(F.col("_maybe.form")))).alias("rejected_ambiguous"),
        F.array_distinct(F.concat(
            F.col("_plain_forms"), F.col("hubs.city"), F.when(F.col("_ok"), F.col("_maybe.form")).otherwise(empty)
        )).alias("country_forms"),
        "intent_packs", "intent_terms", "use_cases",
    )


def africa_features(
    docs: DataFrame, lexicon: DataFrame, unicode: str = "full", rules: Rules = DEFAULT, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Regional-fit vector (C4), label (C5) and confidence (C6) per document.

    ``docs`` may carry ``is_official_source`` and the nullable flags ``has_local_team``,
    ``has_public_contact`` and ``has_funding_or_activity``; what was not observed scores zero.
    """
    flags = ("is_official_source", "has_local_team", "has_public_contact", "has_funding_or_activity")
    for f in flags:
        if f not in docs.columns:
            docs = docs.withColumn(f, F.lit(None).cast("boolean"))
    g = extract_geography(docs, lexicon, unicode, (*flags, *carry))
    return feature_columns(g, rules)


def feature_columns(g: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """C4–C6 over rows with the geography, intent and flag columns."""
    some = lambda c: F.size(c) > 0
    fired = lambda *packs: F.arrays_overlap("intent_packs", F.array(*[F.lit(p) for p in packs]))
    official = F.coalesce("is_official_source", F.lit(False))
    near = some("countries") | some("hubs")
    wide = some("regions") | some("blocs")
    has_geo = near | wide
    money = some("rails") | some("currencies")
    team, contact, active = F.col("has_local_team"), F.col("has_public_contact"), F.col("has_funding_or_activity")
    g = g.withColumn(
        "explicit_geo",
        F.when(near, F.when(official, 30.0).otherwise(15.0)).when(wide, F.when(official, 20.0).otherwise(10.0)).otherwise(0.0),
    ).withColumn(
        "regional_action",
        F.when(
            has_geo,
            F.least(
                F.lit(20.0),
                F.when(fired("hiring", "market_entry"), 12.0).otherwise(0.0)
                + F.when(fired("programs", "partnership"), 8.0).otherwise(0.0)
                + F.when(money, 8.0).otherwise(0.0),
            ),
        ).otherwise(0.0),
    ).withColumn("use_case_fit", F.least(F.lit(15.0), F.lit(5.0) * F.size("use_cases")))
    g = (
        g.withColumn("whitespace", F.when(team.isNull(), 0.0).when(~team, 15.0).otherwise(3.0))
        .withColumn("contactability", F.when(contact, 10.0).otherwise(0.0))
        .withColumn("operating_capacity", F.when(active.isNull(), 0.0).when(active, 10.0).otherwise(3.0))
    )
    parts = ("explicit_geo", "regional_action", "use_case_fit", "whitespace", "contactability", "operating_capacity")
    total = F.least(F.lit(100.0), sum((F.col(p) for p in parts), F.lit(0.0)))
    evidence_ok = official if rules.require_evidence_for_explicit_intent else F.lit(True)
    label = (
        F.when(F.coalesce(team, F.lit(False)) & has_geo, A5)
        .when(evidence_ok & has_geo & fired("hiring", "market_entry", "programs", "partnership"), A1)
        .when(has_geo & ((F.col("regional_action") >= 8.0) | money | (F.size("languages") > 1)), A2)
        .when((F.col("use_case_fit") >= 5.0) | has_geo, A3)
        .otherwise(A4)
    )
    g = g.withColumn("total_score", total).withColumn("label", label)
    conf = (
        F.lit(0.45)
        + F.when(near, 0.25).when(wide, 0.15).otherwise(0.0)
        + F.when(official, 0.20).otherwise(0.0)
        - F.when(some("rejected_ambiguous"), 0.10).otherwise(0.0)
    )
    conf = F.round(F.least(F.greatest(conf, F.lit(0.0)), F.lit(1.0)), 2)
    return g.withColumn("label_confidence", F.when(F.col("label") == A4, 0.0).otherwise(conf))


def snippets(docs: DataFrame, geography: DataFrame, unicode: str = "native", limit: int = 5, width: int = 200) -> DataFrame:
    """First ``limit`` lines per document that hold a matched form, cut to ``width``."""
    needles = geography.select(
        "doc_id",
        F.transform(
            F.array_distinct(F.concat("country_forms", "regions", "blocs", "hubs.city", "rails", "intent_terms")),
            lambda n: fold_text(n, strip_marks=True, unicode="native"),
        ).alias("_needles"),
    ).filter(F.size("_needles") > 0)
    ends = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
    pairs = F.arrays_zip(F.split("text", ends).alias("raw"), F.split("_f", ends).alias("low"))
    # Folded after the join: one text is shuffled, and none is folded in vain.
    df = docs.select("doc_id", "text").join(needles, "doc_id").withColumn("_f", fold_text(F.col("text"), strip_marks=True, unicode=unicode))
    df = with_once(df, _lines=pairs)
    hit = F.filter("_lines", lambda x: (F.trim(x["raw"]) != "") & F.exists("_needles", lambda n: x["low"].contains(n)))
    return df.select(
        "doc_id",
        F.transform(F.slice(hit, 1, limit), lambda x: F.substring(F.regexp_replace(x["raw"], r"^\s+|\s+$", ""), 1, width)).alias("snippets"),
    )


def country_scores(features: DataFrame, countries: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Strength per document and country."""
    df = features.select(
        "doc_id",
        F.explode("countries").alias("country"),
        "hubs",
        (F.size("intent_packs") > 0).alias("_intent"),
        F.coalesce("is_official_source", F.lit(False)).alias("_official"),
    )
    df = df.withColumn("matched_hubs", F.array_sort(F.filter("hubs", lambda h: h["country"] == F.col("country"))["city"]))
    one = lambda c: F.when(c, 0.2).otherwise(0.0)
    strength = F.lit(0.4) + one(F.size("matched_hubs") > 0) + one(F.col("_intent")) + one(F.col("_official"))
    dim = countries.select(F.col("name").alias("country"), "iso2", "region")
    return df.join(dim, "country", "left").select(
        "doc_id", "country", "iso2", "region",
        F.coalesce(F.col("iso2").isin(*rules.priority_markets), F.lit(False)).alias("is_priority_market"),
        "matched_hubs",
        F.round(F.least(F.lit(1.0), strength), 2).alias("strength"),
    )


def tag_keyword_packs(docs: DataFrame, packs: DataFrame, unicode: str = "native") -> DataFrame:
    """(doc_id, pack) for documents that hold a term of the pack."""
    lex = packs.select(F.lit("pack").alias("kind"), F.col("pack").alias("entity"), "term", F.lit(False).alias("ambiguous"))
    return match_lexicon(docs, lex, unicode).select("doc_id", F.col("entity").alias("pack")).distinct()
