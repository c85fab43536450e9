"""Personal data by rules and weak supervision, in DataFrame functions only.

Rules find emails, addresses of the internet protocol, card numbers and phone numbers; their spans
always stand. Further candidates are credential-like words (letters and digits, 16 or
more) and bare phone-like numbers. Labelers vote +1, 0 or -1 on every span, rule-found or
not: a shape labeler (regular expressions), a gazetteer labeler (known endings, issuer digits, country codes,
key prefixes, reserved networks), a context labeler (words to the left) and a texture
labeler (mix of characters). Expectation-maximisation on the counts of vote patterns
estimates each labeler's reliability without any labels; its posteriors, as soft labels, train a naive
Bayes classifier on kind, votes, length and texture, and candidates that it accepts are
added. Only the counts of patterns and the sums of each round reach the driver; their
number is bounded by the features' values, not by the data.

Positions are counted in code points, ends exclusive. Matches are leftmost and do not overlap
within their kind; the patterns use possessive repeats and look-behinds so that the same spans
cost linear time on long texts. Null texts count as empty and have no spans; repeated rows and
ids, and null ids, each keep a row. An empty table gives no rows. Other columns are not
read. Texts are scanned once; later steps read the stored spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnmill.llm.common import staged

# the rules' kinds in their order among spans with one start
KINDS = ["email", "ip", "card", "phone"]
EXTRA = ["secret", "number"]
_LOCAL = "[A-Za-z0-9._%+-]"
_LABEL = "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ \-]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9\-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])[A-Za-z0-9_]{16,}+",
    "number": r"(?<![A-Za-z0-9+.])\(?[0-9]{3}\)?[ .\-][0-9]{3}[ .\-][0-9]{4}(?![A-Za-z0-9.])",
}
# cheap tests that spare most texts the scan
NEEDS = {"email": "@", "phone": "+"}
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
IP_PARTS = rf"^{_PART}(?:\.{_PART}){{3}}$"
CONTEXT = 24

# Gazetteers of the labelers
ENDINGS = r"\.(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|ch|at|it|nl)$"
RESERVED = r"^(?:0|10|127|255)\.|^192\.168\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^169\.254\.|^2(?:2[4-9]|3[0-9])\."
ISSUERS = "^[3-6]"
COUNTRIES = r"^\+(?:1|3[0-69]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
KEYS = r"^(?:ghp_|gho_|github_pat_|sk_|pk_|AKIA|ASIA|AIza|xox[abp])"
NEAR = {
    "email": "(?i)mail|contact|write|reach",
    "ip": r"(?i)\bip\b|address|host|server|login",
    "card": "(?i)card|visa|master|credit|pay|carte|tarjeta|karte",
    "phone": r"(?i)tel|phone|call|fax|mobile|\bsms\b",
    "secret": "(?i)token|secret|key|passw|auth|credential|bearer",
    "number": r"(?i)tel|phone|call|fax|mobile|\bsms\b",
}
AGAINST = r"(?i)(?:version|chapter|isbn|doi|page|commit|sha|md5|release)\W{0,3}$"

LABELERS = ["shape", "gazetteer", "context", "texture"]
FEATURES = ["kind", *LABELERS, "length"]
ROUNDS = 10


def spans_of(text: Column, kind: str) -> Column:
    """All matches as structs (start, stop, value, left), before any test of the kind."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if kind in NEEDS:
        found = F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(F.array().cast("array<string>"))
    return found


# Running sums in two steps, each over short lists: within blocks of 64 and over the blocks.
# A fold over the whole list would copy what it has for every match.
_BLOCK = 64
_RUNNING = """
transform(array({lengths}), l -> transform(array(transform(sequence(0, (size(l) - 1) div {block}), b -> slice(l, b * {block} + 1, {block}))), blocks ->
  transform(array(aggregate(blocks, CAST(array(0) AS array<int>),
      (s, x) -> concat(s, array(element_at(s, -1) + aggregate(x, 0, (t, y) -> t + y))))), ahead ->
    flatten(transform(blocks, (x, b) -> slice(aggregate(x, array(ahead[b]), (s, y) -> concat(s, array(element_at(s, -1) + y))), 1, size(x))))
  )[0])[0])[0]"""
_PLACED = """
CASE WHEN size({m}) = 0 THEN CAST(array() AS array<struct<start:int,stop:int,value:string,left:string>>) ELSE
transform({before}, (before, i) -> named_struct(
  'start', before + length({p}[i]), 'stop', before + length({p}[i]) + length({m}[i]), 'value', {m}[i], 'left', right({p}[i], {context}))) END"""


def located(df: DataFrame, kind: str) -> DataFrame:
    """Adds column ``kind``: the matches in ``text`` with their places."""
    m, p = f"__m_{kind}", f"__p_{kind}"
    df = df.withColumn(m, spans_of(F.col("text"), kind))
    # the pieces between the matches give their places
    df = df.withColumn(p, F.when(F.size(m) > 0, F.split("text", PATTERNS[kind], -1)))
    lengths = f"transform({m}, (x, i) -> length({p}[i]) + length(x))"
    before = _RUNNING.format(lengths=lengths, block=_BLOCK)
    return df.withColumn(kind, F.expr(_PLACED.format(m=m, p=p, before=before, context=CONTEXT))).drop(m, p)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    """The checksum of a digit string of up to 19 digits."""
    padded = F.lpad(number, 20, "0")
    total = F.lit(0)
    for k in range(1, 21):
        digit = F.substring(padded, k, 1).cast("int")
        total = total + (digit if k % 2 == 0 else digit * 2 - F.when(digit > 4, 9).otherwise(0))
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(IP_PARTS)
    if kind == "card":
        number = digits(value)
        return F.length(number).between(12, 19) & F.when(F.length(number) <= 19, passes_luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    if kind == "secret":
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return F.lit(True)


def sign(yes: Column, no: Column | None = None) -> Column:
    vote = F.when(yes, 1)
    return (vote.when(no, -1) if no is not None else vote).otherwise(0)


def votes(kind: str, value: Column, left: Column) -> dict[str, Column]:
    shape, gazetteer, texture = F.lit(0), F.lit(0), F.lit(0)
    share = F.length(digits(value)) / F.length(value)
    if kind == "email":
        # addresses have at most 254 characters; longer ones are not put to the pattern
        short = F.length(value) <= 254
        shape = sign(short & F.when(short, value).rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}$"), ~short | ~value.rlike("[A-Za-z0-9]@"))
        gazetteer = sign(F.lower(value).rlike(ENDINGS), value.rlike("[0-9]$"))
        texture = sign(F.length(value) <= 64, F.length(value) > 254)
    elif kind == "ip":
        shape = sign(value.rlike(r"^[1-9][0-9]{0,2}(?:\.(?:0|[1-9][0-9]{0,2})){3}$"), value.rlike(r"(?:^|\.)0[0-9]"))
        gazetteer = sign(~value.rlike(RESERVED), value.rlike(r"^(?:0|255)\."))
        texture = sign(F.length(value) >= 9, F.length(value) <= 7)
    elif kind == "card":
        shape = sign(value.rlike(r"^[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}$|^[0-9]{15,16}$"))
        gazetteer = sign(value.rlike(ISSUERS), ~value.rlike("^[2-6]"))
        texture = sign(~value.rlike(r"([0-9])\1{5}"), value.rlike(r"([0-9])\1{7}"))
    elif kind == "phone":
        shape = sign(value.rlike(r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{2,4}[ .-]?[0-9]{2,9}$"))
        gazetteer = sign(value.rlike(COUNTRIES), value.rlike(r"^\+0"))
        texture = sign(share >= 0.6, share < 0.4)
    elif kind == "secret":
        shape = sign(value.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$"), value.rlike("^[a-z]+[0-9]{1,4}$"))
        gazetteer = sign(value.rlike(KEYS))
        texture = sign(share.between(0.15, 0.85) & value.rlike("[0-9][A-Za-z]") & value.rlike("[A-Za-z][0-9]"), share < 0.1)
    else:
        shape = sign(value.rlike(r"^\([0-9]{3}\) [0-9]{3}-[0-9]{4}$|^[0-9]{3}-[0-9]{3}-[0-9]{4}$"), value.rlike(r"\..* |\.[0-9]{3} "))
        gazetteer = sign(value.rlike("^[(]?[2-9][0-9]{2}"), value.rlike("^[(]?[01]"))
        texture = sign(share >= 0.7)
    return {"shape": shape, "gazetteer": gazetteer, "context": sign(left.rlike(NEAR[kind]), left.rlike(AGAINST)), "texture": texture}


def described(kind: str, spans: Column) -> Column:
    """Valid spans as structs (start, stop, kind, the labelers' votes, length class)."""

    def describe(s: Column) -> Column:
        value, left = s["value"], s["left"]
        marks = [vote.cast("int").alias(name) for name, vote in votes(kind, value, left).items()]
        size = F.least(F.floor(F.log2(F.length(value).cast("double"))), F.lit(9)).cast("int").alias("length")
        return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(kind).alias("kind"), *marks, size)

    return F.transform(F.filter(spans, lambda s: valid(kind, s["value"])), describe)


def candidates(docs: DataFrame) -> DataFrame:
    """Stored (doc_id, base, extra): described spans of the rules and of the candidates."""
    df = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for kind in KINDS + EXTRA:
        df = located(df, kind)
    base = F.concat(*[described(kind, F.col(kind)) for kind in KINDS])
    extra = F.concat(*[described(kind, F.col(kind)) for kind in EXTRA])
    df = df.select("doc_id", base.alias("base"), extra.alias("extra"))
    clear = F.filter("extra", lambda e: ~F.exists("base", lambda b: (b["start"] < e["stop"]) & (e["start"] < b["stop"])))
    return staged(df.select("doc_id", "base", clear.alias("extra")), "pii-spans")


# ---------------------------------------------------------------- weak supervision


def learned(patterns: DataFrame, posterior: Column, names: list[str]) -> tuple[dict[str, dict], float]:
    """Log odds of each feature value and of the whole, from soft labels; counts are
    smoothed by one. The values of a feature are few."""
    soft = patterns.select("*", (F.col("n") * posterior).alias("yes"), (F.col("n") * (1 - posterior)).alias("no"))
    sums = [F.sum("yes").alias("yes"), F.sum("no").alias("no")]
    # one pass: a row for the whole and one for each value of each feature
    sets = [F.struct(F.lit(name).alias("name"), F.col(name).cast("string").alias("value")) for name in names]
    rows = soft.select(F.explode(F.array(F.struct(F.lit("").alias("name"), F.lit("").alias("value")), *sets)).alias("f"), "yes", "no").groupBy("f").agg(*sums).collect()
    by_name: dict[str, dict] = {name: {} for name in ["", *names]}
    for r in rows:
        by_name[r["f"]["name"]][r["f"]["value"]] = (r["yes"], r["no"])
    yes, no = by_name[""].get("", (0.0, 0.0))

    def odds(pair: tuple[float, float], size: int) -> float:
        return math.log((pair[0] + 1) / (yes + size)) - math.log((pair[1] + 1) / (no + size))

    return {name: {v: odds(pair, len(by_name[name])) for v, pair in sorted(by_name[name].items())} for name in names}, math.log((yes + 1) / (no + 1))


def classifier(spans: DataFrame) -> tuple[dict[str, dict], float]:
    """The final classifier's tables from all spans of ``spans`` (base, extra)."""
    every = spans.select(F.explode(F.concat("base", "extra")).alias("s")).select("s.*")
    patterns = staged(every.groupBy(*[F.col(name).cast("string").alias(name) for name in FEATURES]).agg(F.count(F.lit(1)).alias("n")), "pii-patterns")
    return learned(patterns, posterior_of(patterns), FEATURES)


def posterior_of(patterns: DataFrame) -> Column:
    """Probability that a vote pattern marks personal data, by expectation-maximisation.

    A labeler that votes is right with its own probability, whatever the kind; a kind's
    share of true spans is its own. Votes of 0 say nothing.
    """
    reliability = dict.fromkeys(LABELERS, 0.8)
    share: dict[str, float] = {}
    vote = {name: F.col(name).cast("int") for name in LABELERS}
    for _ in range(ROUNDS + 1):
        logit = F.lit(0.0)
        for kind, value in share.items():
            logit = F.when(F.col("kind") == kind, F.lit(math.log(value / (1 - value)))).otherwise(logit)
        for name, value in reliability.items():
            logit = logit + vote[name] * F.lit(math.log(value / (1 - value)))
        posterior = 1 / (1 + F.exp(-logit))
        right = [F.sum(F.col("n") * F.when(v > 0, posterior).when(v < 0, 1 - posterior).otherwise(0.0)).alias(f"right_{name}") for name, v in vote.items()]
        cast = [F.sum(F.col("n") * F.abs(v)).alias(f"cast_{name}") for name, v in vote.items()]
        # a row for each kind
        rows = patterns.groupBy("kind").agg(F.sum(F.col("n") * posterior).alias("yes"), F.sum("n").alias("n"), *right, *cast).collect()
        share = {r["kind"]: (r["yes"] + 1) / (r["n"] + 2) for r in rows}
        for name in LABELERS:
            # a labeler is at least better than a coin
            value = (sum(r[f"right_{name}"] for r in rows) + 8) / (sum(r[f"cast_{name}"] for r in rows) + 10)
            reliability[name] = min(max(value, 0.55), 0.98)
    return posterior


def accepted(weights: dict[str, dict], prior: float, span: Column) -> Column:
    total = F.lit(float(prior))
    for name in FEATURES:
        term = F.lit(0.0)
        for value, weight in weights[name].items():
            term = F.when(span[name].cast("string") == value, F.lit(float(weight))).otherwise(term)
        total = total + term
    return (total > 0) & (span["shape"] + span["gazetteer"] + span["context"] + span["texture"] >= 1)


def joined(spans: Column) -> Column:
    order = {kind: k for k, kind in enumerate(KINDS + EXTRA)}

    def rank(s: Column) -> Column:
        place = F.lit(len(order))
        for kind, k in order.items():
            place = F.when(s["kind"] == kind, k).otherwise(place)
        return place

    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    texts = F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
    return F.array_join(texts, ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added."""
    spans = candidates(docs)
    weights, prior = classifier(spans)
    added = F.filter("extra", lambda s: accepted(weights, prior, s))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return spans.select(
        "doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", added)).alias("spans"), F.size(added).cast("bigint").alias("n_added")
    )
