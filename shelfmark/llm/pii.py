"""Personal data: patterns propose, checksums confirm, words nearby adjust the score.

Everything is column expressions on the text of a row: no Python runs on the executors and
nothing is shuffled. Patterns are possessive, so their time is linear in the text also where
nothing matches, and a kind is only looked for in texts that hold its mark.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import common
from shelfmark.llm.exprs import bind, located

BASE = ("email", "ip", "card", "phone")
KINDS = BASE + ("iban",)
SPANS = "array<struct<kind:string,start:int,stop:int,score:double>>"
#: Characters before and after a span in which context words count.
BEFORE, AFTER = 40, 20
#: Spans of kinds other than the base ones are reported from this score on.
THRESHOLD = 0.5

# The base patterns, written so that they match the same spans in linear time.
# A run of local characters is tried once, from its start or from the end of the last match.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
_CARD = r"[0-9](?:[\x20-]?+[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# The head of an account number; what may be its rest is looked at but not consumed, with a
# letter or digit after it if one follows, as it is the checksum that tells where it ends.
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?+[A-Z0-9]){11,30}+[A-Za-z0-9]?+))"
#: Characters of an account number by country; others may have 15 to 34.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_LEAST, IBAN_MOST = 15, 34


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    mark: str
    score: float
    for_it: str
    against_it: str


# Context words are whole words, any case.
RULES = (
    Kind("email", _EMAIL, "@", 0.85, "e-?mail|mail|contact|write", "example|noreply"),
    Kind("ip", _IP, ".", 0.6, "ip|address|host|server|login", "version|release|section|v"),
    Kind("card", _CARD, "", 0.75, "card|visa|mastercard|amex|credit|debit|pay", "order|invoice|serial|isbn|id"),
    Kind("phone", _PHONE, "+", 0.65, "phone|tel|call|mobile|fax|whatsapp", "sum|total|score"),
    Kind("iban", _IBAN, "", 0.7, "iban|bank|account|transfer|konto|cuenta|compte", "serial|part|model|sku"),
)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_valid(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def mod97_valid(value: Column) -> Column:
    """ISO 7064 mod 97-10 of an account number: letters count 10 to 35, the rest must be 1."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1


def confirmed(kind: str, value: Column) -> Column:
    """Whether a proposed span is one of its kind."""
    n = F.length(_digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return n.between(13, 19) & luhn_valid(_digits(value))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _account(proposed: Column) -> Column:
    """The account number that a text starts with, or null: of its country's length if such a
    prefix is confirmed, else the longest confirmed one. A prefix ends where a word does."""

    def prefixes(words: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " ")
        )

    def size(p: Column) -> Column:
        return F.length(F.replace(p, F.lit(" "), F.lit("")))

    def good(p: Column) -> Column:
        return F.when(size(p).between(IBAN_LEAST, IBAN_MOST) & ~p.rlike("[a-z]"), mod97_valid(p)).otherwise(F.lit(False))

    known = F.create_map(*[
        F.lit(x) for n, names in IBAN_LENGTHS.items() for name in names.split() for x in (name, n)
    ])
    usual = F.try_element_at(known, F.left(proposed, F.lit(2)))
    return bind(
        F.filter(bind(F.split(proposed, " "), prefixes), good),
        lambda all_: F.coalesce(
            F.get(F.filter(all_, lambda p: size(p) == usual), F.lit(0)), F.try_element_at(all_, F.lit(-1))
        ),
    )


def _accounts(text: Column) -> Column:
    """Account numbers as ``located`` gives matches; of overlapping ones the first counts."""
    found = F.array().cast("array<struct<start:int,stop:int>>")

    def add(kept: Column, m: Column) -> Column:
        free = m["value"].isNotNull() & (m["start"] >= F.coalesce(F.try_element_at(kept, F.lit(-1))["stop"], F.lit(0)))
        span = F.struct(m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("stop"))
        return F.when(free, F.array_append(kept, span)).otherwise(kept)

    def around(kept: Column) -> Column:
        def at(s: Column, i: Column) -> Column:
            low = F.greatest(s["start"] - BEFORE, F.coalesce(F.get(kept, i - 1)["stop"], F.lit(0)))
            high = F.coalesce(F.get(kept, i + 1)["start"], s["stop"] + AFTER)
            return F.struct(
                s["start"].alias("start"), s["stop"].alias("stop"),
                F.substring(text, low + 1, s["start"] - low).alias("before"),
                F.substring(text, s["stop"] + 1, high - s["stop"]).alias("after"),
            )

        return F.transform(kept, at)

    proposed = F.zip_with(
        located(text, _IBAN), F.regexp_extract_all(text, F.lit(_IBAN), F.lit(1)),
        lambda m, rest: F.struct(m["start"].alias("start"), _account(F.concat(m["value"], rest)).alias("value")),
    )
    return bind(F.aggregate(proposed, found, add), around)


def adjusted(kind: Kind, match: Column) -> Column:
    """The kind's score, more or less by the words around the match, within 0 and 1."""
    around = F.lower(F.concat(F.right(match["before"], F.lit(BEFORE)), F.lit(" \n "), F.left(match["after"], F.lit(AFTER))))
    more = F.when(around.rlike(rf"\b(?:{kind.for_it})\b"), 0.2).otherwise(0.0)
    less = F.when(around.rlike(rf"\b(?:{kind.against_it})\b"), 0.3).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(kind.score) + more - less)), 4)


def find(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind, by start."""
    if kind.name == "iban":
        good = _accounts(text)
    else:
        good = F.filter(located(text, kind.pattern), lambda m: confirmed(kind.name, m["value"]))
    spans = F.transform(
        good,
        lambda m: F.struct(
            F.lit(kind.name).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"),
            adjusted(kind, m).alias("score"),
        ),
    )
    if kind.name not in BASE:
        spans = F.filter(spans, lambda s: s["score"] >= THRESHOLD)
    there = F.contains(text, F.lit(kind.mark)) if kind.mark else text.rlike("[0-9]")
    return F.when(there, spans).otherwise(F.array().cast(SPANS))


def all_spans(text: Column) -> Column:
    """Spans of all kinds, in the order of ``KINDS``, then by start."""
    return F.concat(*[find(text, kind) for kind in RULES])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` of every row; positions are code points, ends exclusive.

    Base kinds are reported whatever their score. A null or empty text has no spans. Null ids
    stay, repeated rows are searched each, other columns are left behind, an empty table
    gives no rows.
    """
    return common.texts(docs, id_col, text_col).select("doc_id", all_spans(F.col("text")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind; overlapping spans by the first one's."""

    def by_start(spans_: Column) -> Column:
        return F.sort_array(F.transform(spans_, lambda s: F.struct(s["start"], s["stop"], s["kind"])))

    def cut(state: Column, s: Column) -> Column:
        kept = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        label = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        new = s["start"] >= state["at"]
        return F.struct(
            F.when(new, F.concat(state["out"], kept, label)).otherwise(state["out"]).alias("out"),
            F.greatest(state["at"], s["stop"]).alias("at"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    folded = bind(
        F.aggregate(by_start(spans), start, cut),
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, folded).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, with the spans of the text replaced; a null text stays null."""
    text = F.col(f"`{text_col}`")
    own = "spans"
    while own in docs.columns:
        own += "_"
    found = docs.withColumn(own, all_spans(F.coalesce(text, F.lit(""))))
    return found.withColumn(text_col, redacted(text, F.col(own))).drop(own)
