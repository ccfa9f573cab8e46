"""Quality rules that clean line by line and then judge the document.

Each line is held against punctuation, symbol, navigation and boilerplate rules. Failing lines go;
a document that loses more than a given share of its words goes as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules and of the verdict; all patterns are valid for re and RE2."""

    #: A line of fewer words must end in one of ``terminal``.
    short_words: int = 8
    terminal: str = ".!?:;,…。！？：；،؟।\"'”’»)]}"
    #: A line fails with this many symbols (or shouting marks), if they are also more than one per four (two) words.
    min_symbols: int = 3
    #: A line with this many separators fails, if it has no more than four words per separated part.
    min_separators: int = 3
    separators: str = "|»›•·→"
    #: Lines of up to this many words are searched for boilerplate.
    boilerplate_words: int = 25
    boilerplate: str = (
        "(?i)all rights reserved|(accept|use|uses|using) (all )?cookies|cookie (policy|settings|preferences)|privacy policy"
        "|terms (of|and) (use|service|conditions)|(enable|requires|activate) javascript|subscribe to our|sign up for our|skip to (main )?content"
        "|click here to|lorem ipsum|powered by wordpress|share (this )?on (facebook|twitter)|^(home|log ?in|sign ?up|next|previous|read more|back to top)$"
    )
    min_words: int = 50
    max_repeat_percent: int = 50
    max_lost_percent: int = 50

    def fails(self, line: str, n_words: int) -> bool:
        if not n_words:
            return False
        symbols = sum(map(line.count, "#*$%&|<>"))
        if symbols >= self.min_symbols and 4 * symbols > n_words:
            return True
        marks = line.count("!") + line.count("?")
        if marks >= self.min_symbols and 2 * marks > n_words:
            return True
        if n_words < self.short_words and line.rstrip(" \t\n\x0b\x0c\r")[-1] not in self.terminal:
            return True
        parts = 1 + sum(map(line.count, self.separators))
        if parts > self.min_separators and n_words <= 4 * parts:
            return True
        return n_words <= self.boilerplate_words and re.search(self.boilerplate, line) is not None


DEFAULT_RULES = LineRules()
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed_lines", "lost_chars")


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n + 2)
    pairs = np.unique(a[:-1] * len(ids) + a[1:], return_inverse=True)[1]
    _, at, count = np.unique(pairs[:-1] * len(ids) + a[2:], return_inverse=True, return_counts=True)
    twice = count[at] > 1
    inside = np.zeros(n + 2, bool)
    for i in range(3):
        inside[i : i + n] |= twice
    return int(inside.sum())


def _chars(text: str, raw: bytes) -> int:
    return len(text) - (len(raw) - len(raw.translate(None, SPACE)))


def judge_text(text: str | None, rules: LineRules = DEFAULT_RULES) -> tuple[list[int], str | None]:
    """The values of COUNTS, and the text without its failing lines."""
    if not text:
        return [0] * len(COUNTS), text
    raw = text.encode()
    words = raw.split()
    seen: set[str] = set()
    dups = failed = lost = lines = 0
    kept = []
    for line in text.split("\n"):
        in_line = len(line.encode().split())
        if in_line:
            lines += 1
            dups += line in seen
            seen.add(line)
        if rules.fails(line, in_line):
            failed += 1
            lost += _chars(line, line.encode())
        else:
            kept.append(line)
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return [len(words), _chars(text, raw), symbols, dups, repeated_words(words), lines, failed, lost], "\n".join(kept)


def judged(text: Column | str, rules: LineRules = DEFAULT_RULES, with_text: bool = True) -> Column:
    """Struct of COUNTS, and ``clean_text`` if asked for, of a text column."""
    schema = StructType([StructField(c, LongType()) for c in COUNTS] + [StructField("clean_text", StringType())] * with_text)

    @F.pandas_udf(schema)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [judge_text(t, rules) for t in texts]
            out = pd.DataFrame(np.array([r[0] for r in rows], np.int64).reshape(-1, len(COUNTS)), columns=list(COUNTS))
            if with_text:
                out["clean_text"] = pd.Series([r[1] for r in rows], dtype=object)
            yield out

    return judge.asNondeterministic()(text)  # so that a filter on its fields does not run it again


def quality(docs: DataFrame, rules: LineRules = DEFAULT_RULES, with_text: bool = True) -> DataFrame:
    """``docs`` with COUNTS, ``base_failed``, ``kept`` and, if asked for, ``clean_text``.

    A null or empty text has no words and fails. Rows are judged one by one: repeated rows stay, an
    empty table stays empty, very long texts take linear time, and a column of ``docs`` that has
    the name of a result is replaced by it.
    """
    base = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    lost = 100 * F.col("lost_chars") > rules.max_lost_percent * F.col("word_chars")
    new = [*COUNTS, *["clean_text"] * with_text]
    keep = [c for c in docs.columns if c not in {*new, "base_failed", "kept"}]
    return (
        docs.withColumn("_judged", judged("text", rules, with_text)).select(*keep, *[F.col(f"_judged.{c}").alias(c) for c in new])
        .withColumn("base_failed", base).withColumn("kept", ~(F.col("base_failed") | lost))
    )


def clean_documents(docs: DataFrame, rules: LineRules = DEFAULT_RULES) -> DataFrame:
    """The kept documents with their failing lines removed, in the columns of ``docs``."""
    out = quality(docs.select("text", F.struct(*docs.columns).alias("_all")), rules).filter("kept")
    changed = {"text": F.col("clean_text"), "n_chars": F.length("clean_text")}
    return out.select(*[changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col(f"_all.{c}") for c in docs.columns])


SQL_OP1 = rf"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS k FROM d),
l AS (SELECT doc_id, k, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
    length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS sym,
    length(line) - length(regexp_replace(line, '[!?]', '', 'g')) AS marks,
    1 + length(line) - length(regexp_replace(line, '[|»›•·→]', '', 'g')) AS parts,
    regexp_extract(line, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM lines),
r AS (SELECT *, n > 0 AND ((sym >= {DEFAULT_RULES.min_symbols} AND 4 * sym > n) OR (marks >= {DEFAULT_RULES.min_symbols} AND 2 * marks > n)
    OR (n < {DEFAULT_RULES.short_words} AND position(last IN '{DEFAULT_RULES.terminal.replace("'", "''")}') = 0)
    OR (parts > {DEFAULT_RULES.min_separators} AND n <= 4 * parts)
    OR (n <= {DEFAULT_RULES.boilerplate_words} AND regexp_matches(line, '{DEFAULT_RULES.boilerplate}'))) AS bad,
    n > 0 AND row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS dup FROM l),
s AS (SELECT doc_id, sum(n) AS n_words, sum(chars) AS word_chars, sum(sym) AS n_symbols, sum(dup::INT) AS n_dup_lines, sum((n > 0)::INT) AS n_lines,
    sum(bad::INT) AS n_failed_lines, sum(CASE WHEN bad THEN chars ELSE 0 END) AS lost_chars FROM r GROUP BY doc_id),
f AS (SELECT s.*, COALESCE(rep.n, 0) AS n_repeat_words FROM s LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    n_repeat_words::BIGINT AS n_repeat_words, n_lines::BIGINT AS n_lines, n_failed_lines::BIGINT AS n_failed_lines, lost_chars::BIGINT AS lost_chars,
    (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= {DEFAULT_RULES.max_lost_percent} * word_chars AS kept
FROM f
"""
