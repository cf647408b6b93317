"""Personal data by weak supervision, on DataFrame functions alone.

Base spans come from four patterns with checks (email, ip, card, phone) and always stay.
Candidates that a base pattern or check turns down (written-out emails, card numbers with
a wrong check digit, phone numbers without country code) are judged by a span classifier
that no one labelled data for: five labellers (checksum and shape, boundary, gazetteer,
words before the span, the rest of the document) vote +1, 0 or -1 on every span;
expectation-maximisation estimates how reliable each labeller is; the posterior labels
train a logistic model, and spans it finds likely enough are added.

EM and the model see counts by (kind, votes): a table of 4 * 3**5 rows at most, summed
over all documents, which is why they run on the driver. Spans are found again, with the
weights as literals, in a second pass without any shuffle.

Positions are code points, ends exclusive. Matches are leftmost and do not overlap within
a kind. The patterns are written with possessive repeats and may only begin where a match
can, which finds the same matches in time linear in the text.

Defined cases: null and empty texts have no spans; repeated rows each get a row; an empty
table gives an empty result; a column of the input named ``pii`` is replaced.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfetch.llm.native import let

KINDS = ["email", "ip", "card", "phone"]
# The base patterns.
LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
OCTETS = r"^(?:0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(?:\.|$)){4}"
LOOSE = {
    "email": rf"(?<!{LOCAL}){LOCAL}++ ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z]{{2,}}+)++",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
NEAR = {                                              # gazetteer of words before a span
    "email": r"(?i)(?:e-?mail|mail|contact|kontakt|write to|correo|courriel|adres)",
    "ip": r"(?i)(?:\bip\b|host|server|address|adres)",
    "card": r"(?i)(?:card|visa|mastercard|amex|karte|carte|tarjeta|kredit|credit|payment)",
    "phone": r"(?i)(?:phone|tel\b|tel\.|mobile|call|fax|cell|telefon|tél|móvil)",
}
AGAINST = r"(?i)(?:order|isbn|version|serial|token|key|hash|commit|build|\bid\b|\bno\.)[^\n]{0,12}$"
TOP_LEVEL = r"(?i)(?:\.| dot |\[dot\] ?|\(dot\) ?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"
VOTERS = 5


def _found(text: Column, pattern: str) -> Column:
    """(start, end, match) structs of a pattern's matches. The text between matches comes
    from ``split``; a running sum gives the places."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def places(matches):
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
        return F.aggregate(pairs, zero, step, lambda acc: acc["out"])

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
               lambda m: F.when(F.size(m) > 0, places(m)).otherwise(zero["out"]))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def step(acc, i):
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when((F.length(digits) - i) % 2 == 1, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(OCTETS)
    if kind == "card":
        return let(_digits(match), lambda d: F.length(d).between(13, 19) & luhn(d))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def candidates(text: Column) -> Column:
    """(kind, start, end, match, base) structs, base spans first in each kind."""
    def tagged(k: int, spans: Column, base) -> Column:
        return F.transform(spans, lambda s: F.struct(
            F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"),
            base(s["match"]).alias("base")))

    parts = []
    for k, kind in enumerate(KINDS):
        spans = tagged(k, _found(text, PATTERNS[kind]), lambda m, kind=kind: _valid(kind, m))
        # a card that fails its check digit is a candidate; what is no number of the kind is not
        keep = ((lambda s: s["base"] | F.length(_digits(s["match"])).between(13, 19)) if kind == "card"
                else (lambda s: s["base"]))
        parts.append(F.filter(spans, keep))
    for kind, pattern in LOOSE.items():
        parts.append(tagged(KINDS.index(kind), _found(text, pattern), lambda m: F.lit(False)))

    def apart(all_spans: Column) -> Column:
        base = F.filter(all_spans, lambda s: s["base"])
        return let(base, lambda b: F.filter(all_spans, lambda s: s["base"] | ~F.exists(
            b, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"]))))

    return F.when(text.rlike("[0-9@]| at |\\[at\\]|\\(at\\)"), let(F.concat(*parts), apart)).otherwise(
        F.array().cast("array<struct<kind:int,start:int,end:int,match:string,base:boolean>>"))


def _votes(text: Column, spans: Column, s: Column) -> list[Column]:
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    kind = s["kind"]
    of = lambda **by: _case(kind, by)
    before = F.substring(text, F.greatest(s["start"] - 29, F.lit(1)), F.least(s["start"], F.lit(30)))
    around = F.concat(F.substring(text, F.greatest(s["start"], F.lit(1)), F.least(s["start"], F.lit(1))),
                      F.substring(text, s["end"] + 1, F.lit(1)))
    digits = _digits(s["match"])
    shape = vote(s["base"], of(email=F.lit(False), ip=F.lit(True), card=F.lit(True), phone=F.lit(False)))
    boundary = vote(~around.rlike(r"[A-Za-z0-9_/=]"), F.lit(True))
    known = of(email=s["match"].rlike(TOP_LEVEL), ip=s["match"].rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\."),
               card=digits.rlike("^[3-6]"), phone=~digits.rlike("^(?:1?0{3}|(.)\\1+$)"))
    near = _case(kind, {k: before.rlike(p) for k, p in NEAR.items()})
    # other personal data of the document, not this span
    other = F.exists(spans, lambda x: x["base"] & (x["start"] != s["start"]))
    return [shape, boundary, vote(known, F.lit(True)), vote(near, before.rlike(AGAINST)), vote(other, F.lit(False))]


def _case(kind: Column, by: dict[str, Column]) -> Column:
    out = F.lit(False)
    for name, value in by.items():
        out = F.when(kind == KINDS.index(name), value).otherwise(out)
    return out


def voted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with ``found``: their spans, each with its votes."""
    text = F.col("pii_text")
    docs = docs.withColumn("pii_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))

    def with_votes(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"),
            F.array(*_votes(text, spans, s)).alias("votes")))

    return docs.withColumn("found", let(candidates(text), with_votes))


def fit(votes: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> dict:
    """EM over (kind, votes, count) rows, then the logistic span model on its posteriors."""
    if not votes:
        return {"bias": 0.0, "kind": [0.0] * len(KINDS), "vote": [[0.0] * 3 for _ in range(VOTERS)]}
    kinds = np.array([v[0] for v in votes])
    table = np.array([v[1] for v in votes]) + 1
    count = np.array([v[2] for v in votes], float)
    post = 1 / (1 + np.exp(-(table - 1).sum(axis=1).astype(float)))       # begin at the majority
    for _ in range(rounds):
        prior = (count @ post + 1) / (count.sum() + 2)
        log_odds = np.full(len(count), math.log(prior / (1 - prior)))
        for j, v in itertools.product(range(VOTERS), range(3)):
            on = table[:, j] == v
            p = (count[on] @ post[on] + 1) / (count @ post + 3)
            q = (count[on] @ (1 - post[on]) + 1) / (count @ (1 - post) + 3)
            log_odds[on] += math.log(p / q)
        post = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    x = np.concatenate([np.ones((len(count), 1)), np.eye(len(KINDS))[kinds],
                        *(np.eye(3)[table[:, j]] for j in range(VOTERS))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(25):                                                    # Newton steps, ridge 1
        p = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (count * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (count * (p - post)) + w)
    at = 1 + len(KINDS)
    return {"bias": float(w[0]), "kind": w[1:at].tolist(), "vote": w[at:].reshape(VOTERS, 3).tolist()}


def find_pii(docs: DataFrame, text_col: str = "text", threshold: float = 0.9) -> DataFrame:
    """The documents with ``pii``: (kind, start, end, base) structs by kind, then start."""
    others = [c for c in docs.columns if c not in ("pii", text_col)]
    docs = docs.select(F.struct(*others).alias("others"), F.col(text_col).alias("given"))
    spans = voted(docs.select("given"), "given")
    rows = (spans.select(F.explode("found").alias("s")).groupBy("s.kind", "s.votes").count()
            .orderBy("kind", "votes").collect())                           # 4 * 3**5 rows at most
    model = fit([(r[0], tuple(r[1]), r[2]) for r in rows])
    pick = lambda index, weights: F.element_at(F.array(*map(F.lit, weights)), index)

    def likely(s: Column) -> Column:
        score = F.lit(model["bias"]) + pick(s["kind"] + 1, model["kind"])
        for j, weights in enumerate(model["vote"]):
            score = score + pick(s["votes"][j] + 2, weights)
        return score >= math.log(threshold / (1 - threshold))

    kept = F.transform(F.filter("found", lambda s: s["base"] | likely(s)), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
    return voted(docs, "given").select("others.*", F.col("given").alias(text_col), F.array_sort(kept).alias("pii"))


def render(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the
    first names the whole stretch."""
    def step(acc, s):
        label = F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)), F.lit("]"))
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(
            acc["out"], gap, label).alias("out"))).otherwise(
            F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("minus_end"), s["kind"].alias("kind"), s["end"].alias("end"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(
        ordered, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))))
