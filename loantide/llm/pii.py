"""Personal data in built-in functions: patterns propose spans, checksums confirm them, nearby words adjust the score.

Kinds of the base: email, ip, card (Luhn), phone. Added by the method: iban (mod-97) and ssn, which needs a
supporting word nearby. Each span's score is its kind's prior, raised by a supporting word within ``NEAR`` code
points on either side and lowered by a contrary one.

Defined results: a null text is the empty text and has no spans; positions are code points; repeated rows give
repeated results; an empty table gives an empty one; further columns are ignored.

The patterns equal the stated ones; look-behinds and possessive quantifiers only keep long runs of letters or
digits linear. ``\\G`` lets a match begin where the one before ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loantide.llm.common import whole_texts
from loantide.llm.spans import joined, spans

EMAIL = "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = "[0-9](?:[\\x20-]?[0-9])++"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
#: Countries by the length of their IBANs; a proposal ends there, so that capitals or digits after it stay outside.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_LISTED = "(?:" + "|".join(" ".join(IBAN_LENGTHS.values()).split()) + ")[0-9]{2}"
_BY_LENGTH = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
#: Other codes have no known length: they take all that follows, up to a listed country.
_OTHER = f"(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?:(?!\\x20{_LISTED})\\x20?[A-Z0-9]){{11,30}}+"
IBAN = f"(?<![A-Za-z0-9])(?:{_BY_LENGTH}|{_OTHER})(?![A-Za-z0-9])"
SSN = "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
NEAR = 40
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
SUPPORT = {
    "email": "mail|contact|write",
    "ip": "\\bip\\b|address|server|host|login",
    "card": "card|visa|master|credit|payment|pay",
    "phone": "phone|call|tel|mobile|fax|contact",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "ssn": "\\bssn\\b|social security|tax id",
}
CONTRARY = {
    "email": "example",
    "ip": "version|release|section",
    "card": "order|serial|tracking|isbn",
    "phone": "serial|tracking|order",
    "iban": "serial",
    "ssn": "serial|part no",
}


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass the Luhn checksum."""
    from_right = F.transform(F.filter(F.split(F.reverse(number), "", -1), lambda c: c != ""), lambda c, i: (c.cast("int") * (1 + i % 2)).cast("int"))
    return F.aggregate(from_right, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces has remainder 1: the first four characters last, A-Z as 10-35."""
    turned = F.concat(F.substring(iban, 5, 1000), F.substring(iban, 1, 4))
    chars = F.filter(F.split(turned, "", -1), lambda c: c != "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda a, c: ((a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97).cast("int")) == 1


def _byte(part: Column) -> Column:
    return part.rlike("^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])$")


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, "\\.", -1), _byte),
    "card": lambda m: F.length(digits(m)).between(12, 19) & luhn(digits(m)),
    "phone": lambda m: F.length(digits(m)).between(9, 15),
    "iban": lambda m: F.length(F.replace(m, F.lit(" "))).between(15, 34) & mod97(F.replace(m, F.lit(" "))),
    "ssn": lambda m: ~m.rlike("^(000|666|9)|-00-|-0000$"),
}
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN}
HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike("[0-9]\\.[0-9]"),
    "card": lambda t: t.rlike("[0-9](?:[\\x20-]?[0-9]){11}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "iban": lambda t: t.rlike("[A-Z]{2}[0-9]{2}"),
    "ssn": lambda t: t.rlike("-[0-9]{2}-"),
}


def context_score(text: Column, kind: str, span: Column) -> Column:
    """The prior of a kind, plus 0.3 for a supporting word nearby, minus 0.3 for a contrary one; within 0 and 1."""
    before = F.substring(text, F.greatest(span["s"] + 1 - NEAR, F.lit(1)), F.least(span["s"], F.lit(NEAR)))
    near = F.lower(F.concat(before, F.lit(" "), F.substring(text, span["e"] + 1, F.lit(NEAR))))
    score = PRIOR[kind] + F.when(near.rlike(SUPPORT[kind]), 0.3).otherwise(0.0) - F.when(near.rlike(CONTRARY[kind]), 0.3).otherwise(0.0)
    return F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 2)


def find_pii(docs: DataFrame, least_ssn: float = 0.5) -> DataFrame:
    """``doc_id, text``, one span array per kind, and ``scores`` in the order of the spans."""
    t, text = whole_texts(docs), F.col("text")
    t = t.select("doc_id", "text", *[spans(text, PATTERNS[k], k, i, VALID[k], HINTS[k](text)).alias(k) for i, k in enumerate(KINDS)])
    t = t.withColumn("ssn", F.filter("ssn", lambda x: context_score(text, "ssn", x) >= least_ssn))

    def scorer(kind: str):
        return lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), context_score(text, kind, x).alias("score"))

    scored = [F.transform(k, scorer(k)) for k in KINDS]
    return t.withColumn("scores", F.transform(F.sort_array(F.concat(*scored)), lambda x: x["score"]))


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans of ``find_pii``."""
    base, every = F.concat(*KINDS[:4]), F.concat(*KINDS)
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(every).alias("spans"),
        F.array_join(F.transform("scores", lambda x: x.cast("string")), ",").alias("scores"),
    )
