"""Secret scans in built-in functions: known patterns, and the entropy of candidate strings in a sliding window.

A candidate is a run of at least ``WINDOW`` characters of the base-64 alphabets. A window moves over it one character
at a time: the counts of the character that leaves and of the one that enters change the sum of c*log2(c), from which
the entropy follows, the numbers of capitals, small letters, digits, others and hexadecimal characters, and the number
of neighbours of different class. These numbers tell the alphabet of the window, which sets its threshold
(``THRESHOLDS``). Words have few changes of class, so that names and paths stay below. Windows that touch an
allow-listed stretch (placeholders, alphabets in order) are suppressed, as are whole candidates that are UUIDs or
have no letter, and candidates inside a known pattern.

Defined results: a null text is the empty text and has no spans; positions are code points; repeated rows give
repeated results; an empty table gives an empty one; further columns of the input are ignored by ``secret_scan``
and kept by ``mask_secrets``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loantide.llm.common import whole_texts
from loantide.llm.spans import joined, masked, no_spans, spans

WINDOW = 20
#: Bits per character that a window must reach, and changes of class that it must have, by the alphabet of the window.
#: The bits are what nine of ten random strings of 24 characters of that alphabet reach, but for ``letters`` in one case
#: and ``joined``, which words reach as well.
THRESHOLDS = {
    "hex": (3.0, 0),  # 0-9 and A-F
    "all": (3.85, 8),  # capitals, small letters and digits
    "cases": (3.8, 6),  # capitals and small letters, at least five of each
    "base32": (3.5, 3),  # capitals and digits
    "base36": (3.5, 5),  # small letters and digits
    "digits": (3.9, 0),  # any other window with a digit
    "letters": (4.1, 0),  # any other window
}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}+"
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]++)"
ACCESS = "AKIA[A-Z0-9]++"
HEX = "[0-9a-f]{16,}+"
ALLOWED_WHOLE = "^[0-9_=+/-]+$|^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
ALLOWED_PART = "(?i)example|placeholder|dummy|your[_-]|changeme|redacted|x{6,}+|abcdefghij|0123456789|qwertyuiop"


def _f(c: Column) -> Column:
    """c * log2(c), zero at zero."""
    return F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def _kind(i: Column) -> Column:
    """0 for no character, then capital, small letter, digit, other."""
    return F.when(i == 0, 0).when(i <= 26, 1).when(i <= 52, 2).when(i <= 62, 3).otherwise(4)


def _is_hex(i: Column) -> Column:
    return i.between(1, 6) | i.between(27, 32) | i.between(53, 62)


def _limit(n: Column) -> tuple[Column, Column]:
    """The threshold and the least number of changes for a window with these numbers of characters."""
    upper, lower, digits, others = (n[c] > 0 for c in ("upper", "lower", "digits", "others"))
    alphabet = [
        ("hex", n["hex"] == n["upper"] + n["lower"] + n["digits"] + n["others"]),
        ("all", upper & lower & digits),
        ("cases", ~digits & ~others & (n["upper"] >= 5) & (n["lower"] >= 5)),
        ("base32", digits & ~lower & ~others),
        ("base36", digits & ~upper & ~others),
        ("digits", digits),
    ]
    out = []
    for part in (0, 1):
        c = F.lit(THRESHOLDS["letters"][part])
        for name, condition in reversed(alphabet):
            c = F.when(condition, THRESHOLDS[name][part]).otherwise(c)
        out.append(c)
    return out[0], out[1]


def _windows(candidate: Column, width: int) -> Column:
    """The largest ``entropy`` of any ``width`` consecutive characters, and whether one ``reaches`` the threshold of its alphabet.

    Characters outside the alphabet end a window.
    """
    index = F.transform(F.filter(F.split(candidate, "", -1), lambda c: c != ""), lambda c: F.position(c, F.lit(ALPHABET)))
    # beside each character those that leave (0 while the window fills), so that no lambda reads a whole array
    before = lambda n: F.slice(F.concat(F.array_repeat(F.lit(0), n), index), 1, F.length(candidate))
    moves = F.arrays_zip(index.alias("new"), before(1).alias("prev"), before(width).alias("old"), before(width - 1).alias("next"))
    names = ("upper", "lower", "digits", "others", "hex", "changes", "run")
    zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0.0).alias("sum"), *[F.lit(0).alias(x) for x in names], F.lit(0.0).alias("entropy"), F.lit(False).alias("reaches"))
    one = lambda c: F.when(c, 1).otherwise(0)

    def count(acc: Column, x: Column) -> Column:
        left = F.when(x["old"] > 0, F.get(acc["n"], x["old"] - 1)).otherwise(F.lit(0))
        come = F.when(x["new"] > 0, F.get(acc["n"], x["new"] - 1)).otherwise(F.lit(0)) - one((x["old"] == x["new"]) & (x["new"] > 0))
        total = acc["sum"] - _f(left) + _f(F.greatest(left - 1, F.lit(0))) - _f(come) + _f(come + one(x["new"] > 0))
        n = F.transform(acc["n"], lambda c, j: c + one(j == x["new"] - 1) - one(j == x["old"] - 1))
        new, old = _kind(x["new"]), _kind(x["old"])
        kinds = [(acc[name] + one(new == k) - one(old == k)).alias(name) for k, name in enumerate(names[:4], 1)]
        in_hex = acc["hex"] + one(_is_hex(x["new"])) - one(_is_hex(x["old"]))
        changes = acc["changes"] + one((x["prev"] > 0) & (new != _kind(x["prev"]))) - one((x["old"] > 0) & (old != _kind(x["next"])))
        run = F.when(x["new"] > 0, acc["run"] + 1).otherwise(0)
        return F.struct(n.alias("n"), total.alias("sum"), *kinds, in_hex.alias("hex"), changes.alias("changes"), run.alias("run"), acc["entropy"].alias("entropy"), acc["reaches"].alias("reaches"))

    def judge(acc: Column) -> Column:
        bits, least = _limit(acc)
        full = acc["run"] >= width
        h = F.when(full, F.log2(F.lit(float(width))) - acc["sum"] / width).otherwise(F.lit(0.0))
        # the sum comes from many additions: a difference of 1e-9 bits is none
        reaches = acc["reaches"] | (full & (h >= bits - 1e-9) & (acc["changes"] >= least))
        return F.struct(*[acc[x].alias(x) for x in ("n", "sum", *names)], F.greatest(acc["entropy"], h).alias("entropy"), reaches.alias("reaches"))

    # a second, one-element lambda binds the counts, so that they are computed once
    step = lambda acc, x: F.get(F.transform(F.array(count(acc, x)), judge), 0)
    return F.aggregate(moves, zero, step, lambda acc: F.struct(acc["entropy"], acc["reaches"]))


def window_entropy(candidate: Column, width: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits per character, of any ``width`` consecutive characters."""
    return _windows(candidate, width)["entropy"]


def is_random(candidate: Column, width: int = WINDOW) -> Column:
    """Whether a window outside allow-listed stretches reaches the threshold of its alphabet."""
    # a space is in no alphabet
    return ~candidate.rlike(ALLOWED_WHOLE) & _windows(F.regexp_replace(candidate, ALLOWED_PART, " "), width)["reaches"]


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the known patterns, per kind in the listed order."""
    return {
        "assign": spans(text, ASSIGN, "assign", 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 12),
        "access": spans(text, ACCESS, "access", 1, lambda m: F.length(m) >= 18, F.contains(text, F.lit("AKIA"))),
        "hex": spans(text, HEX, "hex", 2, lambda m: F.length(m) >= 16),
    }


def secret_scan(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and the span arrays ``assign, access, hex, entropy`` of every row."""
    t = whole_texts(docs)
    t = t.select("doc_id", "text", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    t = t.withColumn("_entropy", spans(F.col("text"), CANDIDATE, "entropy", 3, is_random))
    known = F.concat("assign", "access", "hex")
    outside = F.filter("_entropy", lambda x: ~F.exists(known, lambda b: (b["s"] <= x["s"]) & (x["e"] <= b["e"])))
    return t.select("doc_id", "text", "assign", "access", "hex", F.when(F.size("_entropy") == 0, no_spans()).otherwise(outside).alias("entropy"))


def mask_secrets(docs: DataFrame) -> DataFrame:
    """The same rows and columns with every found secret replaced by its kind; ``n_chars`` follows the text, where given."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = [*base_spans(text).values(), spans(text, CANDIDATE, "entropy", 3, is_random)]
    out = docs.withColumn("__spans", F.concat(*parts)).withColumn("__new", masked(text, F.col("__spans")))
    out = out.withColumn("text", F.when(F.size("__spans") == 0, F.col("text")).otherwise(F.col("__new")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__spans") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def digest(scan: DataFrame) -> DataFrame:
    """Counts and joined spans of ``secret_scan``."""
    base = F.concat("assign", "access", "hex")
    return scan.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.size("entropy").cast("long").alias("n_entropy"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(base, F.col("entropy"))).alias("spans"),
    )
