"""Personal data, native: patterns propose spans, checksums confirm them, words close by adjust the score.

Emails, IPv4 addresses, payment cards (Luhn), phone numbers and IBANs (mod 97). All of it is DataFrame functions in one
projection: no shuffle, no Python on executors. Patterns are written so that a scan is linear: a run of characters is
tried once, at its start or where the last match ended, and is never given back. An IBAN has its country's length; with any
other country code it ends at the last space (or the end) of the run up to which mod 97 holds.

Score of a span: 0.5, plus 0.3 if a checksum confirmed it, plus 0.2 if a word for its kind stands in
the 40 characters on either side, less 0.3 if a word against it does (a version before four numbers, an order number before
digits) and none for it. Redaction takes spans of 0.5 and more, so words against a span without a checksum save it.

Defined cases: a null text counts as empty and has no spans; repeated rows give equal results; texts are scanned whole;
other columns pass through, one named like the output is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemint.llm import spans as S

KINDS = ["email", "ip", "card", "phone", "iban"]
BASE = 4
#: Countries by the length of their IBANs.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
KNOWN = "|".join(c for names in IBAN_LENGTHS.values() for c in names.split())
FIXED = "|".join(
    rf"(?:{names.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items()
)
#: What is found, and a cheap test that a text may hold it.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?:{FIXED}|(?!{KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])",
}
#: Words that, close to a span, speak for its kind or against it.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|client)\b",
    "card": r"(?i)\b(?:card|credit|debit|visa|payment|cc)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|dial)\b",
    "iban": r"(?i)\b(?:iban|account|bank|transfer)\b",
}
AGAINST = {
    "email": r"(?i)\b(?:git|ssh|scp|rsync)\b",
    "ip": r"(?i)\b(?:version|release|firmware|section|chapter|build)\b",
    "card": r"(?i)\b(?:isbn|order|invoice|serial|tracking|part)\b",
    "phone": r"(?i)\b(?:isbn|order|invoice|serial|tracking|utc|gmt)\b",
    "iban": r"(?i)\b(?:isbn|serial|tracking|licence|license)\b",
}
START, CHECKED, FOR, COUNTER = 0.5, 0.3, 0.2, 0.3
WINDOW = 40


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    each = F.transform(F.split(F.reverse(number), "", F.length(number)), worth)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN (letters, digits and spaces) leaves 1 when moved round and divided by 97."""
    bare = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))

    def fold(rest: Column, c: Column) -> Column:
        n = F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        return (rest * F.when(n > 9, 100).otherwise(10) + n) % 97

    return F.aggregate(F.split(turned, "", F.length(turned)), F.lit(0), fold) == 1


def part_fits(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return F.when(F.length(bare) > 3, False).otherwise(F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), part_fits),
    "card": lambda v: luhn(digits(v)),
    "phone": lambda v: F.length(digits(v)).between(9, 15),
    "iban": lambda v: F.length(F.replace(v, F.lit(" "), F.lit(""))).between(15, 34) & mod97(v),
}


def confirmed(kind: str):
    return lambda span: VALID[kind](span["value"])


def iban_ends(span: Column) -> Column:
    """An IBAN's span, for countries without a known length cut to the longest run of its parts that is valid."""
    parts = F.split(span["value"], " ")
    runs = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), " "))
    valid = F.get(F.filter(runs, VALID["iban"]), F.lit(0))
    value = F.when(F.rlike(span["value"], F.lit(f"^(?:{KNOWN})")), span["value"]).otherwise(F.coalesce(valid, span["value"]))
    return S.let(value, lambda v: F.struct(span["kind"], span["start"], (span["start"] + F.length(v)).alias("end"), v.alias("value")))


def found(text: Column) -> Column:
    """Confirmed spans of all kinds, by kind and start: array<struct<kind, start, end, value>>."""
    gates = {
        "email": F.contains(text, F.lit("@")),
        "ip": F.rlike(text, F.lit(PATTERNS["ip"])),
        "card": F.rlike(text, F.lit(PATTERNS["card"])),
        "phone": F.contains(text, F.lit("+")),
        "iban": F.rlike(text, F.lit(PATTERNS["iban"])),
    }
    ended = dict.fromkeys(KINDS, lambda spans: spans) | {"iban": lambda spans: F.transform(spans, iban_ends)}
    each = [
        F.when(gates[k], F.filter(ended[k](S.matches(text, PATTERNS[k], i)), confirmed(k))).otherwise(S.none())
        for i, k in enumerate(KINDS)
    ]
    return F.concat(*each)


def score(text: Column, span: Column) -> Column:
    before = F.substring(text, F.greatest(span["start"] - WINDOW, F.lit(0)) + 1, F.least(span["start"], F.lit(WINDOW)))
    around = F.concat(before, F.lit(" \u2029 "), F.substring(text, span["end"] + 1, F.lit(WINDOW)))

    def of_kind(k: str) -> Column:
        worth = START + (CHECKED if k in ("card", "iban") else 0.0)
        speaks = F.rlike(around, F.lit(CONTEXT[k]))
        against = F.rlike(around, F.lit(AGAINST[k]))
        return F.when(speaks, worth + FOR).when(against, worth - COUNTER).otherwise(worth)

    out = F.lit(0.0)
    for i, k in enumerate(KINDS):
        out = F.when(span["kind"] == i, of_kind(k)).otherwise(out)
    return F.round(out, 3)


def scan(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Add ``out``: array<struct<kind, start, end, value, score>> by kind and start; kind is an index into KINDS."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    scored = S.let(
        F.struct(found(whole).alias("s"), whole.alias("t")),
        lambda r: F.transform(
            r["s"],
            lambda s: F.struct(s["kind"], s["start"], s["end"], s["value"], score(r["t"], s).alias("score")),
        ),
    )
    return docs.withColumn(out, scored)


def redact(docs: DataFrame, text: str = "text", least_score: float = 0.5) -> DataFrame:
    """Replace each span of at least ``least_score`` by its kind in brackets; of overlapping spans the first one names it.

    Null texts stay null. The order of rows and all other columns stay.
    """
    column = F.col(f"`{text}`")
    ordered = F.array_sort(
        F.transform(
            F.filter("__pii", lambda s: s["score"] >= least_score),
            lambda s: F.struct(s["start"], s["kind"], s["end"]),
        )
    )
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def cut(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(column, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(
            F.when(fresh, F.concat(acc["out"], gap, F.element_at(names, s["kind"] + 1))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        )

    done = F.aggregate(ordered, start, cut, lambda a: F.concat(a["out"], F.substr(column, a["at"] + 1)))
    clean = F.when(F.size("__pii") > 0, done).otherwise(column)
    return scan(docs, text, "__pii").withColumn(text, clean).drop("__pii")
