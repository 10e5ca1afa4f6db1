"""Personal data in texts, with Spark's own functions only: one projection, no shuffle, no Python on the executors.

Regular expressions propose spans, validators confirm them (octets of an ip, Luhn's sum of a card,
the remainder modulo 97 of an IBAN, digit counts), words near a span raise its score.

The patterns are written with possessive loops and tests of what stands before, which find the
same matches as the plain patterns of the rule (tested) in linear time and constant stack.

Defined cases: null text counts as empty and has no spans; rows are judged one by one, so repeated
rows repeat their result; an empty table gives an empty result; other columns are ignored.
Spans count code points and end before ``end``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")

#: Characters of an IBAN by country.
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_SIZED = "|".join(rf"(?:{names.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_SIZES.items())
_LISTED = "|".join(IBAN_SIZES.values()).replace(" ", "|")

#: Java forms. \G: also where the last match ended, as a search goes on from there.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # Looks ahead only, so that a proposal that fails hides none that starts inside it. Countries outside the list take all that follows.
    "iban": rf"(?<![A-Za-z0-9])(?=((?:{_SIZED}|(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+)(?![A-Za-z0-9])))",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}

#: Kinds whose matches are empty, with the proposal as group 1.
AHEAD = ("iban",)

#: A cheap test that a text can hold a match at all.
_HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"),
    "ssn": lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"),
}

#: Score without context, and the words (a Java pattern) that raise it by CONTEXT when they stand within NEAR characters before.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT_WORDS = {
    "email": r"(?i)\b(e-?mail|mail|contact|kontakt|correo|courriel|write)\b",
    "ip": r"(?i)\b(ip|host|server|address|adresse|direcci[oó]n)\b",
    "card": r"(?i)\b(card|karte|tarjeta|carte|visa|mastercard|payment|credit)\b",
    "phone": r"(?i)\b(tel|phone|call|fax|mobile|telefon|tel[eé]fono|t[eé]l[eé]phone|whatsapp)\b",
    "iban": r"(?i)\b(iban|account|konto|cuenta|compte|bank)\b",
    "ssn": r"(?i)\b(ssn|social security)\b",
}
CONTEXT, NEAR = 0.2, 40
#: Kinds beyond the base count from this score on; base spans always stay.
LEAST = 0.5


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _octets(m: Column) -> Column:
    significant = F.transform(F.split(m, r"\."), lambda x: F.ltrim(x, F.lit("0")))
    return F.forall(significant, lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= F.lit("255"))))


def _remainder_97(m: Column) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    step = lambda a, c: F.when(c.between("0", "9"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c)).cast("int"))


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": _octets,
    "card": lambda m: F.length(_digits(m)).between(16, 19) & F.call_function("luhn_check", _digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
    "iban": lambda m: F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & (_remainder_97(m) == 1),
    "ssn": lambda m: ~F.substring(m, 1, 3).isin("000", "666") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000"),
}


def _spans(kind: str) -> Column:
    """array<struct<kind,start,end,score>> from the columns found_<kind> and gaps_<kind>: matches and what stands before each."""
    found, gaps = F.col(f"found_{kind}"), F.col(f"gaps_{kind}")
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    pieces = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(
        F.length(g).cast("long").alias("gap"),
        F.length(m).cast("long").alias("size"),
        _VALID[kind](m).alias("valid"),
        F.right(g, F.lit(NEAR)).alias("before"),
        F.right(m, F.lit(NEAR)).alias("tail"),
    ))
    used = (lambda p: F.lit(0).cast("long")) if kind in AHEAD else (lambda p: p["size"])

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + p["gap"]
        near = F.right(F.concat(a["near"], p["before"]), F.lit(NEAR))
        score = F.lit(PRIOR[kind]) + F.when(near.rlike(CONTEXT_WORDS[kind]), CONTEXT).otherwise(0.0)
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + p["size"]).alias("end"), score.alias("score"))
        holds = p["valid"] & (start >= a["end"])
        return F.struct(
            (start + used(p)).alias("at"),
            F.when(holds, start + p["size"]).otherwise(a["end"]).alias("end"),
            (near if kind in AHEAD else F.right(F.concat(near, p["tail"]), F.lit(NEAR))).alias("near"),
            F.when(holds, F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"),
        )

    # a text that is searched for empty matches has one more character in front
    first = F.struct(F.lit(-1 if kind in AHEAD else 0).cast("long").alias("at"), F.lit(0).cast("long").alias("end"), F.lit("").alias("near"), none.alias("spans"))
    walked = F.aggregate(pieces, first, step, lambda a: a["spans"])
    return F.when(F.size(found) > 0, walked).otherwise(none)


def find_pii(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, then spans_<kind> (kind, start, end, score) for each of KINDS."""
    out = docs.select(*(F.col(c).alias(f"kept_{c}") for c in keep), F.coalesce("text", F.lit("")).alias("body"))
    body = F.col("body")
    empty = F.array().cast("array<string>")
    out = out.select("*", *(F.when(_HINTS[k](body), F.regexp_extract_all(body, F.lit(p), F.lit(int(k in AHEAD)))).otherwise(empty).alias(f"found_{k}") for k, p in PATTERNS.items()))
    # Java's split has no piece before an empty match at the very start: a character in front keeps pieces and matches in step
    searched = lambda k: F.concat(F.lit("\n"), body) if k in AHEAD else body
    out = out.select("*", *(F.when(F.size(f"found_{k}") > 0, F.split(searched(k), p, -1)).otherwise(empty).alias(f"gaps_{k}") for k, p in PATTERNS.items()))
    spans = {k: _spans(k) for k in KINDS}
    for k in KINDS[len(BASE_KINDS) :]:
        spans[k] = F.filter(spans[k], lambda s: s["score"] >= LEAST)
    return out.select(*(F.col(f"kept_{c}").alias(c) for c in keep), *(s.alias(f"spans_{k}") for k, s in spans.items()))


def _joined(kinds: tuple[str, ...]) -> Column:
    parts = F.concat(*(F.col(f"spans_{k}") for k in kinds))
    return F.array_join(F.transform(parts, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_pii(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with each span of ``text`` replaced by its kind in brackets; overlapping spans become one, under the first's kind."""
    names = docs.columns  # as fields of a row, whatever they are called
    found = find_pii(docs.select(F.struct("*").alias("row"), "text"), ("row",))
    every = F.array_sort(F.concat(*(F.transform(f"spans_{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))) for k in KINDS)))
    out = found.select("row", every.alias("spans"), F.coalesce("row.text", F.lit("")).alias("body"))

    def step(a: Column, s: Column) -> Column:
        start = F.greatest(s["start"], a["at"])
        before = F.substring(F.col("body"), (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int"))
        fresh = s["start"] >= a["at"]
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fresh, F.concat(a["done"], F.array(F.concat(before, F.lit("["), F.upper(s["kind"]), F.lit("]"))))).otherwise(a["done"]).alias("done"), start.alias("start"))

    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("done"), F.lit(0).cast("long").alias("start"))
    whole = F.aggregate("spans", first, step, lambda a: F.concat(F.array_join(a["done"], ""), F.substring("body", (a["at"] + 1).cast("int"), F.lit(2147483647))))
    out = out.select("row", F.when(F.size("spans") > 0, whole).alias("redacted"))
    changed = {"text": F.coalesce("redacted", "row.text")}
    if "n_chars" in names:
        changed["n_chars"] = F.coalesce(F.length("redacted").cast(docs.schema["n_chars"].dataType), "row.n_chars")
    return out.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in names))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"), ("doc_id",))
    spans = F.transform(F.concat(*(F.col(f"spans_{k}") for k in KINDS)), lambda s: F.concat_ws(":", s["kind"], F.round(s["score"], 2).cast("string")))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(F.size(f"spans_{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(_joined(BASE_KINDS), 256).alias("base_sha256"),
        _joined(KINDS).alias("spans"),
        F.array_join(spans, ",").alias("scores"),
    )
