"""Field rules and their compact notation (VAL1, VAL4).

A line is ``kind: fields``. Fields are numbers or ranges. Kinds:

``text``, ``flag`` (Y or N), ``num`` (at least 0), ``anynum``, ``int`` (0 to 9999), ``date`` (not after
the as-of date), ``anydate``, ``codeN`` (1 to N), ``codes A-B`` (A to B), ``pct`` (0 to 100), ``textN`` (at most N
characters), ``like PATTERN``, ``oneof A B C``. A trailing ``!`` makes the fields required.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """``max`` may be ``today`` or ``today+N`` days, resolved against the as-of date."""

    field: str
    type: str  # string, number, integer, datetime
    nullable: bool = True
    min: str | float | None = None
    max: str | float | None = None
    allowed: tuple[str, ...] | None = None
    regex: str | None = None
    maxlength: int | None = None
    label: str | None = None


def expand(spec: str) -> list[int]:
    """Numbers of a list such as ``2-5 8 10``."""
    out: list[int] = []
    for part in spec.split():
        lo, _, hi = part.partition("-")
        out.extend(range(int(lo), int(hi or lo) + 1))
    return out


def _of_kind(kind: str, field: str, nullable: bool) -> Rule:
    word, _, arg = kind.partition(" ")
    make = lambda type_, **kw: Rule(field, type_, nullable, **kw)
    if word == "text":
        return make("string")
    if word.startswith("text"):
        return make("string", maxlength=int(word[4:]))
    if word == "flag":
        return make("string", allowed=("Y", "N"))
    if word == "like":
        return make("string", regex=arg)
    if word == "oneof":
        return make("string", allowed=tuple(arg.split()))
    if word == "codes":
        return make("string", allowed=tuple(str(i) for i in expand(arg)))
    if word.startswith("code"):
        return make("string", allowed=tuple(str(i) for i in range(1, int(word[4:]) + 1)))
    if word == "num":
        return make("number", min=0.0)
    if word == "anynum":
        return make("number")
    if word == "pct":
        return make("number", min=0.0, max=100.0)
    if word == "int":
        return make("integer", min=0, max=9999)
    if word == "date":
        return make("datetime", max="today")
    if word == "anydate":
        return make("datetime", min=arg.split("..")[0] or None, max=(arg.split("..") + [""])[1] or None)
    raise ValueError(f"unknown rule kind {kind!r}")


def parse_rules(prefix: str, text: str) -> dict[str, Rule]:
    rules: dict[str, Rule] = {}
    for line in text.strip().splitlines():
        kind, _, fields = line.strip().rpartition(":")
        required = kind.endswith("!")
        for n in expand(fields):
            name = f"{prefix}{n}"
            rules[name] = _of_kind(kind.rstrip("!").strip(), name, not required)
    return dict(sorted(rules.items(), key=lambda kv: int(kv[0][len(prefix):])))


# Span of the amortisation fields and the horizon of their dates.
AMORTISATION_FIELDS = range(150, 270)
AMORTISATION_MIN_DATE = "2012-01-01"
AMORTISATION_HORIZON_DAYS = 13880


def amortisation_rules() -> dict[str, Rule]:
    """Loan id, then balance (even) and date (odd) of each period (VAL4)."""
    rules = {"AS3": Rule("AS3", "string", False, label="Loan Identifier")}
    for i in AMORTISATION_FIELDS:
        name, period = f"AS{i}", (i - AMORTISATION_FIELDS.start) // 2 + 1
        if i % 2 == 0:
            rules[name] = Rule(name, "number", False, min=0.0, label=f"Balance, period {period}")
        else:
            rules[name] = Rule(
                name, "datetime", False, min=AMORTISATION_MIN_DATE,
                max=f"today+{AMORTISATION_HORIZON_DAYS}", label=f"Date, period {period}",
            )
    return rules
