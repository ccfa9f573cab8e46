"""Names, keys, URLs and hashes as native column expressions.

Character classes are spelled ``[\\p{L}\\p{N}_]`` because Java's ``\\w`` is ASCII and, with ``(?U)``,
also takes combining marks, which Unicode-aware ``\\w`` elsewhere does not.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.functions.once import with_once

WORD = r"[\p{L}\p{N}_]"
NOT_WORD_BEFORE = rf"(?<!{WORD})"
NOT_WORD_AFTER = rf"(?!{WORD})"

# Words dropped from a name to get its root form.
LEGAL_WORDS = (
    "labs", "foundation", "network", "protocol", "technologies", "technology", "tech", "llc",
    "inc", "ltd", "gmbh", "dao", "ventures", "group", "chain",
)
# Protocol namespace when none is given, by stack family.
DEFAULT_NAMESPACE = {"evm": "eip155", "cosmos": "cosmos", "svm": "solana", "starknet": "starknet"}
# Query parameters whose name holds one of these carry a secret.
SECRET_WORDS = ("key", "token", "secret", "auth", "apikey", "password", "sig")
# Fixed value: the RFC 4122 DNS namespace for UUIDv5.
DNS_NAMESPACE_HEX = "6ba7b8109dad11d180b400c04fd430c8"

# Letters of the Latin-1 and Latin Extended-A blocks, Arabic letters and plain punctuation are
# their own NFKC form. Text made of these alone needs no Python to be folded.
_PLAIN = (
    r"[^\x00-\x7FÀ-ÖØ-öø-ıĴ-ľŁ-ňŊ-žء-يḀ-ẏ–—‘’“”«»¿¡₦₵€£]|[Ḁ-ẏİ]"
)


def _mark_pairs() -> tuple[str, str]:
    """Accented letters and their bare letters, from the Unicode decomposition rule."""
    src, dst = [], []
    for cp in range(0xC0, 0x180):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(cp)) if unicodedata.category(c) != "Mn")
        if base != chr(cp) and len(base) == 1:
            src.append(chr(cp))
            dst.append(base)
    return "".join(src), "".join(dst)


_ACCENTED, _BARE = _mark_pairs()


def strip_marks_text(v: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", v) if unicodedata.category(c) != "Mn")


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(T.StringType())
def _nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())


@F.pandas_udf(T.StringType())
def _strip_marks(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else strip_marks_text(v))


def _needs_python(c: Column) -> Column:
    return c.rlike(_PLAIN)


def nfkc(c: Column, unicode: str = "full") -> Column:
    """NFKC form. ``unicode="native"`` skips the Arrow step for callers whose text is plain."""
    if unicode == "native":
        return c
    odd = _needs_python(c)
    return F.when(odd, _nfkc(F.when(odd, c))).otherwise(c)


def fold_text(c: Column, strip_marks: bool = False, unicode: str = "full") -> Column:
    """NFKC and casefold, optionally without combining marks.

    Plain rows are folded in the JVM; only rows with other characters travel through Arrow.
    """
    plain = F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    bare = F.translate(plain, _ACCENTED, _BARE)
    if unicode == "native":
        return bare if strip_marks else plain
    odd = _needs_python(c)
    folded = _nfkc_casefold(F.when(odd, c))
    if strip_marks:
        return F.when(odd, _strip_marks(folded)).otherwise(bare)
    return F.when(odd, folded).otherwise(plain)


@F.pandas_udf(T.StructType([T.StructField("norm", T.StringType()), T.StructField("bare", T.StringType())]))
def _fold_struct(s: pd.Series) -> pd.DataFrame:
    norm = s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())
    return pd.DataFrame({"norm": norm, "bare": norm.map(lambda v: None if v is None else strip_marks_text(v))})


def with_folded(df: DataFrame, text: str, unicode: str = "full") -> DataFrame:
    """Add ``_norm`` and ``_bare``: folded text, and the same without marks, whitespace collapsed.

    Each is computed once per row, and one Arrow step serves both for the rows that need it.
    """
    squeeze = lambda c: F.regexp_replace(c, r"(?U)\s+", " ")
    plain = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    if unicode == "native":
        df = with_once(df, _norm=squeeze(plain))
        return with_once(df, _bare=F.translate(F.col("_norm"), _ACCENTED, _BARE))
    df = with_once(df, _odd=_needs_python(F.col(text)))
    df = df.withColumn("_py", _fold_struct(F.when(F.col("_odd"), F.col(text))))
    df = with_once(df, _norm=squeeze(F.when(F.col("_odd"), F.col("_py.norm")).otherwise(plain)))
    bare = F.when(F.col("_odd"), squeeze(F.col("_py.bare"))).otherwise(F.translate(F.col("_norm"), _ACCENTED, _BARE))
    return with_once(df, _bare=bare).drop("_odd", "_py")


def normalize_name(c: Column, unicode: str = "full") -> Column:
    """Lower-case name with punctuation turned to spaces and whitespace collapsed."""
    low = F.lower(nfkc(c, unicode))
    spaced = F.regexp_replace(low, r"(?U)[^\p{L}\p{N}_\s-]", " ")
    return F.coalesce(F.trim(F.regexp_replace(spaced, r"(?U)\s+", " ")), F.lit(""))


def root_name(c: Column, unicode: str = "full") -> Column:
    """Normalised name without legal words (N12): an alias, never an identity."""
    words = "|".join(LEGAL_WORDS)
    cut = F.regexp_replace(
        normalize_name(c, unicode), rf"{NOT_WORD_BEFORE}(?:{words}){NOT_WORD_AFTER}", ""
    )
    return F.trim(F.regexp_replace(cut, r"\s+", " "))


def _unless_empty(c: Column) -> Column:
    """``nullif(c, '')`` that works ``c`` out once also where Spark shares no common expressions, as in generators."""
    return F.get(F.filter(F.array(c), lambda x: x != ""), F.lit(0))


def slug(c: Column, unicode: str = "full") -> Column:
    """URL slug; an empty one becomes ``unknown``."""
    s = F.regexp_replace(normalize_name(c, unicode), "[^a-z0-9]+", "-")
    return F.coalesce(_unless_empty(F.regexp_replace(s, "^-+|-+$", "")), F.lit("unknown"))


def domain(url: Column) -> Column:
    """Host of a URL, lower-case and without ``www.``; null if there is none."""
    u = F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    host = F.lower(
        F.regexp_extract(u, r"^https?://(?:[^/?#]*@)?(?:\[([^\]/?#]*)\]|([^/?#:\[\]]*))", 0)
    )
    host = F.regexp_replace(host, r"^https?://(?:[^/?#]*@)?|[\[\]]", "")
    host = F.regexp_replace(F.trim(host), r"^www\.", "")
    return _unless_empty(host)


def chain_id(c: Column) -> Column:
    """Canonical decimal text of a hex or decimal chain id; other text is only trimmed.

    Up to 31 hex digits are converted exactly; ``conv`` alone overflows at 16.
    """
    t = F.trim(c)
    digits = F.regexp_extract(t, r"^0[xX]0*([0-9a-fA-F]*)$", 1)
    is_hex = t.rlike(r"^0[xX][0-9a-fA-F]+$")

    def dec(h: Column) -> Column:
        return F.conv(h, 16, 10).cast("decimal(20,0)")

    low = F.when(F.length(digits) <= 16, F.concat(F.lit("0"), digits))
    low = dec(F.right(low, F.lit(16))).cast("string")
    high_part = F.when(F.length(digits).between(17, 31), F.substr(digits, F.lit(1), F.length(digits) - 16))
    wide = (
        dec(high_part) * F.lit("18446744073709551616").cast("decimal(20,0)")
        + dec(F.when(high_part.isNotNull(), F.right(digits, F.lit(16))))
    ).cast("string")
    signed = F.regexp_replace(F.regexp_replace(t, r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
    return (
        F.when(t.rlike("^(?:0|[1-9][0-9]*)$"), t)
        .when(is_hex & (F.length(digits) <= 16), low)
        .when(is_hex & (F.length(digits) <= 31), wide)
        .when(t.rlike(r"^[+-]?\d+$"), F.when(signed == "-0", F.lit("0")).otherwise(signed))
        .otherwise(t)
    )


def default_namespace(stack_family: Column) -> Column:
    pairs = [F.lit(x) for kv in DEFAULT_NAMESPACE.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), stack_family), stack_family)


def caip2(namespace: Column, reference: Column) -> Column:
    """``namespace:reference``, null when either is missing."""
    return F.concat(F.trim(F.lower(namespace)), F.lit(":"), F.trim(reference))


def key_text(*cols: Column) -> Column:
    """The trimmed, lower-case parts joined by ``:``, of which ``stable_key`` is the UUID. It is its own key text."""
    return F.concat_ws(":", *[F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))) for c in cols])


def stable_key(*cols: Column) -> Column:
    """UUIDv5 over the trimmed, lower-case parts joined by ``:``."""
    digest = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE_HEX)), F.encode(key_text(*cols), "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def redacted_url(url: Column) -> Column:
    """URL without user info, secret query values and key-like path segments."""
    rfc = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

    def part(i: int) -> Column:
        return F.regexp_extract(url, rfc, i)

    scheme, netloc, path, query, fragment = (part(i) for i in range(1, 6))
    netloc = F.regexp_replace(netloc, "^.*@", "<redacted>@")
    path = F.array_join(
        F.transform(
            F.split(path, "/"),
            lambda s: F.when(s.rlike(r"^[A-Za-z0-9_\-]{24,}$"), F.lit("<redacted>")).otherwise(s),
        ),
        "/",
    )
    secret = "(?i)" + "|".join(SECRET_WORDS)

    def pair(p: Column) -> Column:
        key = F.substring_index(p, "=", 1)
        return F.when(
            p.contains("=") & key.rlike(secret), F.concat(key, F.lit("=<redacted>"))
        ).otherwise(p)

    query = F.array_join(F.transform(F.split(query, "&"), pair), "&")
    return F.when(url == "", F.lit("")).otherwise(
        F.concat(
            F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(F.lit("")),
            F.when(netloc != "", F.concat(F.lit("//"), netloc)).otherwise(F.lit("")),
            path,
            F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
            F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
        )
    )


def endpoint_hash(url: Column) -> Column:
    """sha256 of the trimmed endpoint, an identifier that never shows its secret."""
    return F.sha2(F.trim(F.coalesce(url, F.lit(""))), 256)


@F.pandas_udf(T.StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else v.casefold())


def channel_hash(value: Column) -> Column:
    """sha256 of the trimmed, case-folded contact channel.

    ASCII is folded in the JVM; other values take an Arrow step, because suppression compares these
    hashes with those that others have recorded.
    """
    t = F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)^\s+|\s+$", "")
    odd = t.rlike(r"[^\x00-\x7F]")
    return F.sha2(F.when(odd, _casefold(F.when(odd, t))).otherwise(F.lower(t)), 256)


def canonical_json_hash(payload: Column) -> Column:
    """sha256 of JSON with sorted keys (S2): parsing re-serialises objects in key order.

    Text that is not JSON is hashed as it is. Characters beyond ASCII stay as they are and ``1.0`` becomes ``1``,
    so hashes are comparable within this library only.
    """
    return F.sha2(F.coalesce(F.to_json(F.try_parse_json(payload)), payload), 256)


def any_contains(c: Column, words) -> Column:
    """Whether the text holds any of the given plain substrings."""
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def sorted_union(c: Column) -> Column:
    """Aggregate: sorted distinct union of array values (nulls dropped)."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(c, F.array().cast("array<string>"))))))
