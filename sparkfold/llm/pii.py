"""Personal data by weak supervision, with DataFrame functions alone.

Candidates are the matches of one pattern per kind. Four labelers vote on each: its shape, a
gazetteer, the words before it and the characters beside it (1 personal, -1 not, 0 no opinion).
Expectation-maximisation over the counts of vote patterns, taken over all documents, estimates how
reliable each labeler is; its posteriors train a logistic span classifier on the votes and kinds.
Counts of vote patterns are bounded by 3**4 for each kind, so that both fits run on the driver over
a few hundred rows at any size of corpus. Base kinds are found by their rules and always kept; the
classifier decides on candidates of the other kinds.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .spans import with_spans

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "ssn", "iban", "tel", "name", "key", "jwt", "address", "person")
LABELERS = ("shape", "gazetteer", "context", "beside")
# Gazetteers and cue words of the labelers.
DOMAINS = r"(?i)\.(com|org|net|edu|gov|mil|int|info|biz|io|eu|de|fr|es|it|uk|us|ca|nl|be|ch|at|se|no|pl|pt|br|mx|ar|cn|jp|in|ru|au)$"
TITLES = r"Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora"
GIVEN = "James|Mary|John|Anna|Robert|Linda|Michael|Sarah|David|Laura|Peter|Maria|Thomas|Julia|Hans|Petra|Pierre|Claire|Jean|Marie|José|Carmen|Juan|Lucía"
FIRST_NAMES = rf" ({GIVEN})\b"
STREETS = "Street|Avenue|Road|Lane|Drive|Boulevard|Court|Square|Place|Terrace|Way|St|Ave|Rd|Blvd"
KEY_MARKS = "sk_live_|sk_test_|pk_live_|sk-|ghp_|gho_|github_pat_|glpat-|xoxb-|xoxp-|AKIA|ASIA|AIza|hf_|npm_|SG\\."
CUES = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": r"\bip\b|host|server|address|adresse",
    "card": "card|visa|master|amex|karte|carte|tarjeta",
    "phone": r"tel|phone|call|fax|mobile|\bfon\b",
    "secret": "token|key|secret|passw|auth|credential",
    "ssn": r"\bssn\b|social",
    "iban": "iban|account|konto|compte|cuenta",
    "tel": r"tel|phone|call|fax|mobile|\bfon\b",
    "name": "name|contact|signed|from|dear|nom|nombre",
    "key": "token|key|secret|passw|auth|credential",
    "jwt": "token|bearer|auth|cookie|session",
    "address": r"address|adresse|lives?|office|street|postal|\bat\b",
    "person": r"name|contact|signed|from|dear|author|\bby\b|nom|nombre",
}
# The first four are the base rules. Repeats that nothing follows are possessive, which changes no
# match and keeps the matcher from recursing; a run is entered only at its start.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,128}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Z0-9])",
    "tel": r"(?<!\+[0-9]{1,3} )\([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "name": rf"(?<!\p{{L}})(?:{TITLES})\.? \p{{Lu}}\p{{Ll}}{{1,30}}(?: \p{{Lu}}\p{{Ll}}{{1,30}})?",
    "key": rf"(?<![0-9A-Za-z_-])(?:{KEY_MARKS})[0-9A-Za-z_-]{{12,200}}",
    "jwt": r"(?<![0-9A-Za-z_-])eyJ[0-9A-Za-z_-]{4,4000}\.[0-9A-Za-z_-]{4,4000}\.[0-9A-Za-z_-]{4,4000}",
    "address": rf"(?<![0-9])[0-9]{{1,5}}[A-Za-z]? (?:\p{{Lu}}\p{{L}}{{0,30}} ){{1,3}}(?:{STREETS})\b",
    "person": rf"(?<!\p{{L}})(?<!(?:{TITLES})\.? )(?:{GIVEN}) \p{{Lu}}\p{{Ll}}{{1,30}}",
}


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    """The rule that a base kind's match must pass."""
    if kind == "ip":
        return found.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2}|)(?:\.|$)){4}$")
    n = F.length(_digits(found))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), _luhn(_digits(found))).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).when(F.lit(False) if no is None else no, -1).otherwise(0)


def _votes(kind: str, x: Column) -> list[Column]:
    found, digits = x["found"], _digits(x["found"])
    apart = (F.length(x["after"]) == 0) | ~x["after"].rlike(r"[\p{L}\p{N}]")
    left = F.right(x["before"], F.lit(1))
    apart = apart & ((F.length(left) == 0) | ~left.rlike(r"[\p{L}\p{N}]"))
    mixed = found.rlike("[0-9]") & found.rlike("[A-Za-z]")
    shape = {
        "email": found.rlike(r"\.[A-Za-z]{2,24}$") & ~found.contains(".."),
        "ip": ~found.rlike(r"(^|\.)0[0-9]"),
        "card": F.length(digits).isin(13, 15, 16),
        "phone": F.length(digits) >= 10,
        "secret": mixed,
        "ssn": ~found.rlike(r"^(000|666|9)|-00-|-0000$"),
        "iban": found.rlike("[0-9]{8}"),
        "tel": F.lit(True),
        "name": F.lit(True),
        "key": mixed,
        "jwt": F.length(found) >= 40,
        "address": ~found.rlike("^0"),
        "person": ~found.rlike(rf" (?:{GIVEN}|{STREETS})$"),
    }[kind]
    gazetteer = {
        "email": found.rlike(DOMAINS),
        "ip": ~found.rlike(r"^(0|255)\."),
        "card": digits.rlike("^(4|5[1-5]|2[2-7]|3[47]|35|6011|65)"),
        "phone": digits.rlike("^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"),
        "secret": F.length(found).isin(32, 40, 56, 64, 96, 128),
        "ssn": F.lit(None).cast("boolean"),
        "iban": found.rlike("^(AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)"),
        "tel": ~found.rlike(r"^\([01]"),
        "name": found.rlike(FIRST_NAMES),
        "key": ~found.rlike(r"(?i)x{6}|example|your|0{6}|1234567"),
        "jwt": found.startswith("eyJhbGciOi") | found.startswith("eyJ0eXAiOi"),
        "address": ~found.rlike("(?i) (wall|sesame|main) street$"),
        "person": F.lit(None).cast("boolean"),
    }[kind]
    return [_vote(shape, ~shape), _vote(gazetteer, ~gazetteer), _vote(x["before"].rlike(f"(?i){CUES[kind]}")), _vote(apart, ~apart)]


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``spans``: every candidate by kind as listed, then start, with its votes."""
    docs = docs.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    docs = docs.withColumn("_digit", F.col("_text").rlike("[0-9]"))
    holds = lambda *words: reduce(Column.__or__, [F.col("_text").contains(w) for w in words])
    may = {
        "email": holds("@"), "phone": F.col("_digit") & holds("+"), "jwt": holds("eyJ"), "key": holds(*KEY_MARKS.replace("\\.", ".").split("|")),
        "name": holds(*TITLES.split("|")), "person": holds(*[f"{x} " for x in GIVEN.split("|")]), "address": F.col("_digit") & holds(*[f" {x}" for x in STREETS.split("|")]),
    }
    docs = with_spans(docs, "_text", {f"_{k}": (PATTERNS[k], may.get(k, F.col("_digit"))) for k in KINDS})

    def of(number: int, kind: str) -> Column:
        kept = F.filter(f"_{kind}", lambda x: _valid(kind, x["found"])) if kind in BASE else F.col(f"_{kind}")
        row = lambda x: F.struct(F.lit(number).alias("no"), F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.array(*_votes(kind, x)).alias("votes"))
        return F.when(F.col(f"_{kind}").isNotNull(), F.transform(kept, row))

    lists = {f"_{k}": of(i, k) for i, k in enumerate(KINDS)}
    docs = docs.withColumns(lists)
    none = F.array().cast("array<struct<no:int,kind:string,start:bigint,end:bigint,votes:array<int>>>")
    return docs.withColumn("spans", F.concat(*[F.coalesce(F.col(f"_{k}"), none) for k in KINDS])).drop("_text", "_digit", *lists)


def fit(counts: list[tuple[str, tuple, int]], rounds: int = 30, steps: int = 300) -> dict:
    """Classifier weights from (kind, votes, count): expectation-maximisation, then logistic regression.

    Begins from the mean vote. With no candidates at all the weights are zero.
    """
    belief = {(k, v): min(0.95, max(0.05, 0.5 + 0.5 * sum(v) / len(v))) for k, v, _ in counts}
    for _ in range(rounds):
        prior = defaultdict(lambda: [1.0, 1.0])
        # Votes against and for, in the classes not personal and personal; a labeler without opinion tells nothing.
        seen = {(labeler, c): [8.0 - 6.0 * c, 2.0 + 6.0 * c] for labeler in range(len(LABELERS)) for c in (0, 1)}
        for k, v, n in counts:
            p = belief[k, v]
            for c, share in ((0, 1 - p), (1, p)):
                prior[k][c] += n * share
                for labeler, vote in enumerate(v):
                    if vote:
                        seen[labeler, c][vote > 0] += n * share
        for k, v, _ in counts:
            odds = math.log(prior[k][1] / prior[k][0])
            for labeler, vote in enumerate(v):
                if vote:
                    one, zero = seen[labeler, 1], seen[labeler, 0]
                    odds += math.log(one[vote > 0] / sum(one)) - math.log(zero[vote > 0] / sum(zero))
            belief[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    weights: dict = defaultdict(float)
    grads: dict = defaultdict(lambda: 1e-8)
    whole = sum(n for *_, n in counts) or 1
    for _ in range(steps):
        slope: dict = defaultdict(float)
        for k, v, n in counts:
            names = [("bias",), ("kind", k), *((i, x) for i, x in enumerate(v))]
            p = 1 / (1 + math.exp(-sum(weights[f] for f in names)))
            for f in names:
                slope[f] += n / whole * (p - belief[k, v])
        for f, g in slope.items():
            g += 1e-4 * weights[f]
            grads[f] += g * g
            weights[f] -= 0.5 * g / math.sqrt(grads[f])
    return dict(weights)


def vote_counts(marked: DataFrame) -> list[tuple[str, tuple, int]]:
    """(kind, votes, count) over all candidates of all documents.

    The outer explode keeps the optimiser from pushing a test of the spans' number, and with it a
    second copy of every regular expression, down to the scan.
    """
    rows = marked.select(F.explode_outer("spans").alias("s")).groupBy("s.kind", "s.votes").count().filter("kind is not null").collect()
    return sorted((r["kind"], tuple(r["votes"]), r["count"]) for r in rows)


def _score(x: Column, weights: dict) -> Column:
    odds = F.lit(weights.get(("bias",), 0.0))
    for k in KINDS:
        if w := weights.get(("kind", k)):
            odds = odds + F.when(x["kind"] == k, w).otherwise(0.0)
    for i in range(len(LABELERS)):
        for vote in (-1, 0, 1):
            if w := weights.get((i, vote)):
                odds = odds + F.when(x["votes"][i] == vote, w).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def find_pii(docs: DataFrame, text: str = "text", threshold: float = 0.5, with_text: bool = True) -> DataFrame:
    """docs with ``spans``: array of (kind, start, end, base, score), by kind as listed, then start.

    One pass over the texts writes the candidates with their votes beside the rows of docs (without the text if
    ``with_text`` is false). Vote patterns are counted in these; base spans stay, and of the others those
    that the classifier scores at least ``threshold``. Offsets are code points, end exclusive. A null or
    empty text has no spans; other columns, null or not, pass through; repeated rows are found each;
    texts of any length are searched whole; an empty table stays empty. Spans of different kinds may overlap; ties of start within a kind
    can't occur.
    """
    marked = candidates(docs, text)
    marked = materialize(marked if with_text else marked.drop(text))
    weights = fit(vote_counts(marked))
    base = lambda x: x["kind"].isin(*BASE)
    scored = F.transform("spans", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), base(x).alias("base"), _score(x, weights).alias("score")))
    return marked.withColumn("spans", F.filter(scored, lambda x: x["base"] | (x["score"] >= threshold)))


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the spans of ``find_pii`` in column text by <KIND>; overlapping ones by the first's."""
    body = F.col(text)
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"], (-x["end"]).alias("end"), x["kind"])))

    def step(a: Column, x: Column) -> Column:
        start, end = x["start"], -x["end"]
        piece = F.when(start >= a["at"], F.array(F.substring(body, (a["at"] + 1).cast("int"), (start - a["at"]).cast("int")), F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(a["at"], end).alias("at"), F.concat(a["out"], piece).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda a: F.concat(F.array_join(a["out"], ""), F.substring(body, (a["at"] + 1).cast("int"), F.length(body)))
    return found.withColumn(text, F.when(F.size("spans") > 0, F.aggregate(ordered, start, step, rest)).otherwise(body))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256 and spans as text."""
    mark = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    listed = lambda c: F.array_join(F.transform(c, mark), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, BASE),
        F.sha2(listed(F.filter("spans", lambda x: x["base"])), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
