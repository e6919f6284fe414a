"""Scalar expressions: canonical contact details, masking, weights, scores and hints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The abbreviations and company suffixes that canonical forms are defined by.
ABBREVIATIONS = {
    "rd": "road",
    "st": "street",
    "ave": "avenue",
    "apt": "apartment",
    "blvd": "boulevard",
    "ln": "lane",
    "dr": "drive",
    "no": "number",
}
COMPANY_SUFFIXES = ("pvt ltd", "private limited", "pvt. ltd.", "& sons", "and sons", "ltd", "limited", "inc", "llc")
PHONE = r"^(?:\+91|0091|91)?0?([1-9][0-9]{9})$"
# Fixed values of the public numbering plans: country code, whether numbers are dialled with a 0 at home, first digits, further digits (least, most).
COUNTRIES = (
    ("1", False, "2-9", 9, 9),
    ("27", True, "1-8", 8, 8),
    ("33", True, "1-9", 8, 8),
    ("44", True, "1-9", 8, 9),
    ("49", True, "1-9", 5, 10),
    ("55", True, "1-9", 9, 10),
    ("60", True, "1-9", 7, 9),
    ("61", True, "2-478", 8, 8),
    ("62", True, "2-9", 7, 11),
    ("65", False, "3689", 7, 7),
    ("7", False, "3-9", 9, 9),
    ("81", True, "1-9", 8, 9),
    ("86", True, "1-9", 9, 10),
    ("880", True, "1-9", 8, 9),
    ("94", True, "1-9", 8, 8),
    ("966", True, "1-9", 8, 8),
    ("971", True, "2-9", 7, 8),
    ("977", True, "1-9", 8, 9),
)
# Country codes are prefix-free, so one pattern at most fits; the second takes the home prefix out.
ABROAD = "^(?:" + "|".join(f"{code}{'0?' if zero else ''}[{first}][0-9]{{{least},{most}}}" for code, zero, first, least, most in COUNTRIES) + ")$"
HOME_PREFIX = "^(" + "|".join(code for code, zero, *_ in COUNTRIES if zero) + ")0"
# The scores from which a claim is flagged or reviewed.
FLAG_AT, REVIEW_AT = 0.75, 0.40


def phone(raw: Column) -> Column:
    """E.164 form of a number: Indian, or of a country in `COUNTRIES` with + or 00 before its code.

    Indian: ten digits, not 0 first, after an optional +91, 0091 or 91 and an
    optional 0. Others: the country's lengths, with or without the 0 that is
    dialled at home. Null for any other input, impossible lengths too.
    """
    plus = F.when(F.trim(raw).startswith("+"), "+").otherwise("")
    dialled = F.concat(plus, F.regexp_replace(raw, "[^0-9]", ""))
    local = F.regexp_extract(dialled, PHONE, 1)
    rest = F.regexp_extract(dialled, r"^(?:\+|00)([0-9]+)$", 1)
    abroad = F.when(rest.rlike(ABROAD), F.concat(F.lit("+"), F.regexp_replace(rest, HOME_PREFIX, "$1")))
    return F.when(local != "", F.concat(F.lit("+91"), local)).otherwise(abroad)


def address(raw: Column) -> Column:
    """Lower-case words in order, abbreviations written out, repeated words kept."""
    words = F.filter(F.split(F.regexp_replace(F.lower(raw), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: w != "")
    known = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    return F.array_join(F.sort_array(F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w))), " ")


def shop(raw: Column) -> Column:
    """Lower case without company suffixes, which are taken out wherever they stand, in order."""
    text = F.regexp_replace(F.lower(raw), r"[^a-z0-9\s&]", " ")
    for suffix in COMPANY_SUFFIXES:
        text = F.replace(text, F.lit(suffix), F.lit(" "))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def masked(value: Column) -> Column:
    """First and last two characters shown; nothing of values up to four characters."""
    n = F.length(value)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(value, 1, 2), F.repeat(F.lit("*"), n - 4), F.right(value, F.lit(2))))


def idf_weight(degree: Column) -> Column:
    """1 / ln(1 + degree); 0 without an edge."""
    return F.when(degree > 0, 1 / F.log1p(degree)).otherwise(0.0)


def per_entity(claims: Column, entities: Column) -> Column:
    return F.when(entities > 0, claims / entities).otherwise(0.0)


def suspiciousness(ratio: Column, burst: Column) -> Column:
    """Up to 0.85 for claims an entity (saturated at 5) and 0.15 for burstiness, to four digits."""
    dense = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (ratio - 1) / 4))
    return F.round(F.least(F.lit(1.0), 0.85 * dense + 0.15 * burst), 4)


def decision_hint(score: Column, flag_at: float = FLAG_AT, review_at: float = REVIEW_AT) -> Column:
    return F.when(score >= flag_at, "FLAG").when(score >= review_at, "REVIEW").otherwise("CLEAR")
