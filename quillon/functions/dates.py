"""References to dates in texts, read into dates: several written forms, what the text says exactly and what only about."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months, the forms of dates, and how sure a form is.
MONTHS = "january february march april may june july august september october november december".split()
NUMERIC = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
WRITTEN = r"(?i)\b(?:" + "|".join(MONTHS) + r")\s+\d{1,2},?\s+\d{4}\b"
ISO = r"\b\d{4}-\d{2}-\d{2}\b"
EXACT, APPROXIMATE = 0.9, 0.7
#: Two-digit years from this one on are of the last century.
PIVOT = 69


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.try_to_number(F.regexp_extract(text, pattern, group), F.lit("9999")).cast("int")


def _date(year: Column, month: Column, day: Column) -> Column:
    """The date, or null if the calendar has none."""
    shown = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull() & (year > 0), F.try_to_date(shown, "yyyy-MM-dd"))


def _month(text: Column) -> Column:
    """The number of the month that a text begins with."""
    low = F.lower(text)
    out = F.lit(None).cast("int")
    for n, name in enumerate(MONTHS, 1):
        out = F.when(F.startswith(low, F.lit(name)), n).otherwise(out)
    return out


def numeric_date(text: Column) -> Column:
    """Month, day and year in numbers. A first number over 12 is the day; years of two digits are those from 1969 to 2068; three digits are none."""
    p = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})$"
    a, b, y = (_number(text, p, k) for k in (1, 2, 3))
    digits = F.length(F.regexp_extract(text, p, 3))
    year = F.when(digits == 4, y).when(digits == 2, y + F.when(y >= PIVOT, 1900).otherwise(2000))
    return F.when(a > 12, _date(year, b, a)).otherwise(_date(year, a, b))


def written_date(text: Column) -> Column:
    p = r"(?i)^[a-z]+\s+(\d{1,2}),?\s+(\d{4})$"
    return _date(_number(text, p, 2), _month(text), _number(text, p, 1))


def iso_date(text: Column) -> Column:
    p = r"^(\d{4})-(\d{2})-(\d{2})$"
    return _date(*(_number(text, p, k) for k in (1, 2, 3)))


def approximate_date(sentence: Column) -> Column:
    """The first of the first month that a sentence names together with a year, in either order with a day between or none; null without a year."""
    months = "|".join(MONTHS)
    after = rf"(?i)\b({months})\b(?:\s+\d{{1,2}}(?:st|nd|rd|th)?)?,?(?:\s+of)?\s+((?:1[89]|20)\d{{2}})\b"
    named, year = F.regexp_extract(sentence, after, 1), _number(sentence, after, 2)
    return _date(year, _month(named), F.lit(1))


def date_references(text: Column) -> Column:
    """An array of (date_text, date, is_approximate, confidence, form) of a text.

    Exact ones by form, then in order: month/day/year in numbers, a written month with day and year, ISO. Then sentences (what stands between full
    stops) that name a month and a year: their first of the month, approximate, with the sentence as the text. What the calendar doesn't have
    keeps its text with a null date. A null text has none.
    """

    def exact(pattern: str, read, form: str) -> Column:  # noqa: ANN001
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.transform(hits, lambda t: F.struct(t.alias("date_text"), read(t).alias("date"), F.lit(False).alias("is_approximate"), F.lit(EXACT).alias("confidence"), F.lit(form).alias("form")))

    sentences = F.filter(F.transform(F.split(text, r"\."), lambda s: F.trim(s)), lambda s: s.rlike(r"(?i)\b(?:" + "|".join(MONTHS) + r")\b"))
    about = F.transform(sentences, lambda s: F.struct(s.alias("date_text"), approximate_date(s).alias("date"), F.lit(True).alias("is_approximate"), F.lit(APPROXIMATE).alias("confidence"), F.lit("sentence").alias("form")))
    parts = F.concat(exact(NUMERIC, numeric_date, "numeric"), exact(WRITTEN, written_date, "written"), exact(ISO, iso_date, "iso"), F.filter(about, lambda r: r["date"].isNotNull()))
    return F.coalesce(parts, F.array().cast("array<struct<date_text:string,date:date,is_approximate:boolean,confidence:double,form:string>>"))


def document_date(references: Column) -> Column:
    """The first exact date that the calendar has, else the first approximate one, else null."""
    good = F.filter(references, lambda r: r["date"].isNotNull())
    return F.try_element_at(F.transform(F.concat(F.filter(good, lambda r: ~r["is_approximate"]), F.filter(good, lambda r: r["is_approximate"])), lambda r: r["date"]), F.lit(1))
