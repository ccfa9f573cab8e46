"""Personal data by weak supervision.

Strict patterns give the base spans. Looser patterns propose more. On every proposal several labelers vote for, against or not at
all: the strict pattern, the form of the value, gazetteers, words before it, and what it is part of. Expectation-maximisation
over the votes of the whole corpus estimates how reliable each labeler is, and so how likely each proposal is. A
logistic classifier of the span's features is fitted to these likelihoods and makes the decision for each span.

Votes and features are a few bits each. The corpus is summarised by the counts of their combinations, of which there are at most
``len(KINDS) * 3 ** len(LABELERS) * 2 ** len(FEATURES)``; only these counts reach the driver.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from winnow.llm.store import saved

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("strict", "form", "gazetteer", "context", "inside")
FEATURES = ("separated", "long", "known_start", "word_before", "word_against", "glued_before", "glued_after", "upper_near")
#: A proposal is a span from this likelihood on.
DECIDE = 0.5

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Proposals beyond the base: written-out e-mail addresses, and phone numbers without a plus sign.
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({<] ?(?:dot|DOT|\.) ?[\])}>]) ?[A-Za-z0-9-]{1,63})+")
LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")

TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co ai app dev me tv eu us uk de fr es it nl be ch at pl pt se no dk fi ie cz ru ua cn jp kr in au nz ca br mx ar za".split())
CALLING_CODES = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 98 212 213 216 234 254 351 352 353 358 380 420".split())
CARD_STARTS = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "6011", "65", "35", "22", "23", "24", "25", "26", "27")
WORDS_FOR = {
    "email": re.compile(r"e-?mail|correo|courriel|contact|write to|reach"), "ip": re.compile(r"\bip\b|address|adresse|host|server|client|login|from"),
    "card": re.compile(r"card|visa|master|amex|credit|debit|karte|carte|tarjeta|pay"), "phone": re.compile(r"phone|\btel\b|call|mobile|cell|fax|telefon|tel[eé]f|whatsapp|sms"),
}
WORDS_AGAINST = re.compile(r"version|\bv\b|isbn|issn|doi|order|invoice|section|chapter|figure|fig\.|table|page|build|release|serial|part no")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by the strict patterns: of each kind leftmost and without overlap; failing matches are dropped.

    The scans are linear in the text also where the plain patterns would try every character of a long run.
    """
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isalnum() and text[start - 1].isascii() or text[start - 1] in "._%+-"):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    for m in NUMBERS.finditer(text):
        if m.group().count(".") >= 3:
            parts = [(x.start() + m.start(), x.end() + m.start()) for x in re.finditer("[0-9]+", m.group())]
            for i in range(0, len(parts) - 3, 4):
                if all(int(text[a:b].lstrip("0")[:4] or 0) <= 255 for a, b in parts[i : i + 4]):
                    out.append((1, parts[i][0], parts[i + 3][1]))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 40:
            digits = re.sub("[^0-9]", "", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def proposals(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The base spans and those of the looser patterns that overlap none."""
    more = [(0, m.start(), m.end()) for m in SPELLED.finditer(text)] if any(c in text for c in "[({<") else []
    more += [(3, m.start(), m.end()) for m in LOCAL_PHONE.finditer(text)]
    taken = sorted((a, b) for _, a, b in base)
    out = list(base)
    for kind, a, b in sorted(more, key=lambda x: x[1]):
        i = bisect_left(taken, (b,))
        if not any(x < b and y > a for x, y in taken[max(0, i - 2) : i]):
            out.append((kind, a, b))
            insort(taken, (a, b))
    return out


def describe(text: str, kind: int, a: int, b: int, strict: bool) -> tuple[list[int], list[bool]]:
    """The votes (-1, 0, 1) of LABELERS and the FEATURES of a proposal."""
    value, before = text[a:b], text[max(0, a - 40) : a].lower()
    name = KINDS[kind]
    digits = re.sub("[^0-9]", "", value)
    left, right = text[a - 1 : a], text[b : b + 1]
    word_for, against = bool(WORDS_FOR[name].search(before)), bool(WORDS_AGAINST.search(before))
    inside = left.isalnum() or left in "/=_" and left != "" or right.isalnum() or right in "/_" and right != ""
    if name == "email":
        last = re.findall("[A-Za-z0-9-]+", value)[-1].lower()
        form, known = len(last) >= 2 and not last.isdigit(), last in TOP_DOMAINS
    elif name == "ip":
        parts = value.split(".")
        form, known = all(p == "0" or not p.startswith("0") for p in parts), parts[0] not in ("0", "127", "255")
    elif name == "card":
        form, known = 13 <= len(digits) <= 19 and luhn(digits), digits.startswith(CARD_STARTS)
    else:
        form, known = 9 <= len(digits) <= 15, digits.startswith(CALLING_CODES) if strict else len(digits) == 10 and digits[0] not in "01"
    votes = [1 if strict else 0, 1 if form else -1, 1 if known else 0, 1 if word_for and not against else -1 if against else 0, -1 if inside else 0]
    near = text[max(0, a - 12) : b + 12]
    features = [bool(re.search(r"[\s().-]", value)), b - a > 15, known, word_for, against, left.isalnum(), right.isalnum(), any(c.isupper() for c in near)]
    return votes, features


def code_of(kind: int, votes: list[int], features: list[bool]) -> int:
    code = kind
    for v in votes:
        code = code * 3 + v + 1
    for f in features:
        code = code * 2 + int(f)
    return code


def read_code(code: int) -> tuple[int, list[int], list[int]]:
    features, votes = [], []
    for _ in FEATURES:
        code, f = divmod(code, 2)
        features.append(f)
    for _ in LABELERS:
        code, v = divmod(code, 3)
        votes.append(v - 1)
    return code, votes[::-1], features[::-1]


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` without its text and with ``spans``: (kind, start, end, strict, code) of all proposals of each whole text."""
    item = StructType([StructField(n, IntegerType()) for n in ("kind", "start", "end", "strict")] + [StructField("code", LongType())])

    @F.pandas_udf(ArrayType(item))
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                base = base_spans(t) if t else []
                rows = []
                for i, (kind, a, b) in enumerate(proposals(t, base) if t else []):
                    strict = i < len(base)
                    rows.append((kind, a, b, int(strict), code_of(kind, *describe(t, kind, a, b, strict))))
                out.append(rows)
            yield pd.Series(out, dtype=object)

    return docs.withColumn("spans", find.asNondeterministic()("text")).drop("text")


@dataclass(frozen=True)
class SpanModel:
    """Reliabilities by (kind, class, labeler, vote), priors by kind, and the weights of the span classifier by kind."""

    reliability: np.ndarray
    prior: np.ndarray
    weights: np.ndarray

    def likelihood(self, kind: int, features: list[int]) -> float:
        w = self.weights[kind]
        return float(1 / (1 + np.exp(-(w[0] + w[1:] @ np.array(features, float)))))


def label_posteriors(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation: likelihood of each combination, and the estimated reliabilities and priors."""
    n_kinds, n_labelers = len(KINDS), votes.shape[1]
    post = 1 / (1 + np.exp(-2.0 * votes.sum(1) + 1.0))  # the vote of the majority
    rel, prior = np.full((n_kinds, 2, n_labelers, 3), 1 / 3), np.full(n_kinds, 0.5)
    for _ in range(rounds):
        for k in range(n_kinds):
            mine = kinds == k
            c, p, v = counts[mine], post[mine], votes[mine]
            for y, weight in ((1, c * p), (0, c * (1 - p))):
                for vote in (-1, 0, 1):  # a prior belief of two right votes in three keeps the classes apart
                    lean = 2.0 if vote == (1 if y else -1) else 1.0
                    rel[k, y, :, vote + 1] = (weight[:, None] * (v == vote)).sum(0) + lean
                rel[k, y] /= rel[k, y].sum(1, keepdims=True)
            prior[k] = ((c * p).sum() + 1) / (c.sum() + 2)
        at = np.arange(n_labelers)
        one = np.log(prior[kinds]) + np.log(rel[kinds[:, None], 1, at, votes + 1]).sum(1)
        none = np.log(1 - prior[kinds]) + np.log(rel[kinds[:, None], 0, at, votes + 1]).sum(1)
        post = 1 / (1 + np.exp(none - one))
    return post, rel, prior


def fit(cands: DataFrame) -> SpanModel:
    """Reliabilities and classifier from all proposals of the corpus, by counts of their codes."""
    rows = cands.select(F.explode("spans.code").alias("code")).groupBy("code").agg(F.count("*").alias("n")).orderBy("code").collect()
    weights = np.zeros((len(KINDS), 1 + len(FEATURES)))
    if not rows:
        return SpanModel(np.full((len(KINDS), 2, len(LABELERS), 3), 1 / 3), np.full(len(KINDS), 0.5), weights)
    read = [read_code(r.code) for r in rows]
    kinds, votes, counts = np.array([r[0] for r in read]), np.array([r[1] for r in read]), np.array([r.n for r in rows], float)
    x = np.hstack([np.ones((len(rows), 1)), np.array([r[2] for r in read], float)])
    post, rel, prior = label_posteriors(kinds, votes, counts)
    for k in range(len(KINDS)):
        mine = kinds == k
        if mine.any():
            weights[k] = _logistic(x[mine], post[mine], counts[mine])
    return SpanModel(rel, prior, weights)


def _logistic(x: np.ndarray, soft: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on soft labels (Newton steps with a small ridge)."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (counts * (p - soft)) + w
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), grad)
        w = w - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256`` and ``spans``.

    Counts and hash are of the base spans, ``spans`` also has what the classifier adds; offsets are code points and ends
    exclusive. A null or empty text has none. Rows are independent: repeated rows stay and an empty table stays empty;
    columns with the names of results are replaced.
    """
    new = {*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"}
    cands = saved(candidates(docs.select(*[c for c in docs.columns if c not in new])))
    model = fit(cands)

    @F.pandas_udf(StructType([StructField("base", StringType()), StructField("spans", StringType()), StructField("n_added", LongType())]))
    def decide(lists: pd.Series) -> pd.DataFrame:
        known: dict[int, bool] = {}
        out = []
        for spans in lists:
            base, every = [], []
            for s in spans:
                code = s["code"]
                if code not in known:
                    kind, _, features = read_code(code)
                    known[code] = model.likelihood(kind, features) >= DECIDE
                if s["strict"] or known[code]:
                    every.append((s["kind"], s["start"], s["end"]))
                    if s["strict"]:
                        base.append(every[-1])
            text = [",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(x)) for x in (base, every)]
            out.append((*text, len(every) - len(base)))
        return pd.DataFrame(out, columns=["base", "spans", "n_added"])

    counts = [F.size(F.filter("spans", lambda s: (s.kind == i) & (s.strict == 1))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    done = cands.withColumn("d", decide.asNondeterministic()("spans"))
    return done.select(*[c for c in cands.columns if c != "spans"], *counts, F.sha2("d.base", 256).alias("base_sha256"), "d.spans", "d.n_added")


def masked(text: str, spans: str) -> str:
    """``text`` with each span replaced by its kind in brackets."""
    found = sorted(((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)), reverse=True)
    edge = len(text) + 1
    for a, b, kind in found:
        if b <= edge:
            text, edge = f"{text[:a]}[{kind}]{text[b:]}", a
    return text
