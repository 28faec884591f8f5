"""Citations, tables and margins of filings as text, by Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import legal, text


def _some(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def _plain(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def deposition(name: Column, content: Column, page: Column) -> Column:
    """X Dep. page:line by the content, or the page alone; the deponent by the document's name."""
    deponent = F.coalesce(_some(F.trim(F.regexp_extract(name, r"(?i)deposition\s+of\s+([^,\-]+)", 1))), F.trim(F.split(name, "_")[0]))
    place = F.coalesce(_some(F.regexp_extract(content, r"\d+:\d+(?:-\d+)?", 0)), page.cast("string"))
    return F.concat_ws(" ", F.concat(deponent, F.lit(" Dep.")), place)


def expert(name: Column, page: Column) -> Column:
    who = F.coalesce(_some(F.trim(F.regexp_extract(name, r"(?i)(?:dr\.|mr\.|ms\.)\s*[^,\-_]+", 0))), F.trim(F.split(name, "_")[0]))
    exhibit = _some(F.regexp_extract(name, legal.EXHIBIT, 1))
    return F.concat(F.lit("Expert Report of "), who, F.coalesce(F.concat(F.lit(" at "), page.cast("string")), F.lit("")), F.coalesce(F.concat(F.lit(", Ex. "), exhibit), F.lit("")))


def exhibit(name: Column, kind: Column) -> Column:
    number = F.coalesce(_some(F.regexp_extract(name, legal.EXHIBIT, 1)), _some(F.regexp_extract(name, r"\d+", 0)), F.lit("?"))
    described = F.when(F.coalesce(kind, F.lit("")).isin("", "exhibit"), "").otherwise(F.concat(F.lit(" ("), _plain(kind), F.lit(")")))
    return F.concat(F.lit("Ex. "), number, described)


def _date(name: Column, content: Column) -> Column:
    return _some(F.regexp_extract(F.concat(name, F.lit(" "), F.left(content, F.lit(200))), text.DATE, 0))


def internal(name: Column, content: Column, kind: Column) -> Column:
    """An e-mail by sender and date, a policy by its kind, anything else by its name."""
    date = _date(name, content)
    sender = F.coalesce(_some(F.trim(F.regexp_extract(F.left(content, F.lit(200)), r"(?i)from[:\s]+([^,\n]+)", 1))), F.lit("Company Official"))
    dated = F.coalesce(F.concat(F.lit(" dated "), date), F.lit(""))
    email = F.concat(F.lit("Email from "), sender, dated)
    policy = F.concat(F.lit("Company "), F.initcap(kind), F.coalesce(F.concat(F.lit(" ("), date, F.lit(")")), F.lit("")))
    return F.when(F.contains(kind, F.lit("email")), email).when(kind.rlike("policy|manual"), policy).otherwise(F.concat(_plain(name), dated))


def document(name: Column, content: Column, page: Column) -> Column:
    return F.concat(_plain(name), F.coalesce(F.concat(F.lit(" at "), page.cast("string")), F.lit("")), F.coalesce(F.concat(F.lit(" ("), _date(name, content), F.lit(")")), F.lit("")))


def of_result(name: Column, content: Column, kind: Column, page: Column) -> Column:
    """A search result's citation, by the form that its kind and name ask for."""
    kind = F.lower(kind)
    is_exhibit = F.contains(kind, F.lit("exhibit")) | name.rlike(r"(?i)ex(?:hibit)?\s*\d+")
    return (
        F.when(F.contains(kind, F.lit("deposition")) | F.contains(F.lower(name), F.lit("depo")), deposition(name, content, page))
        .when(F.contains(kind, F.lit("expert")) & F.contains(kind, F.lit("report")), expert(name, page))
        .when(is_exhibit, exhibit(name, kind))
        .when(kind.rlike("email|memo|policy|manual"), internal(name, content, kind))
        .otherwise(document(name, content, page))
    )


def case_law(name: Column, reporter: Column, year: Column, pinpoint: Column, note: Column) -> Column:
    """Name, reporter, pinpoint (year) (note); what is null is left out."""
    in_parens = lambda c: F.coalesce(F.concat(F.lit(" ("), c, F.lit(")")), F.lit(""))
    return F.concat(F.concat_ws(", ", name, reporter, pinpoint), in_parens(year), in_parens(note))


def contents_line(title: Column, page: Column, level: Column) -> Column:
    """A line of a table of contents: indent by level, dots up to 70 characters (three at least), page."""
    indent, number = F.repeat(F.lit("    "), level - 1), page.cast("string")
    dots = F.greatest(F.lit(70) - F.length(indent) - F.length(title) - F.length(number), F.lit(3))
    return F.concat(indent, title, F.lit(" "), F.repeat(F.lit("."), dots), F.lit(" "), number)


def numbered_lines(content: Column, start: int = 1) -> Column:
    """The text with a number in front of each line that isn't blank."""
    zero = F.struct(F.lit(start).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        blank = F.trim(x) == ""
        shown = F.when(blank, x).otherwise(F.concat(F.lpad(a["n"].cast("string"), 3, " "), F.lit("  "), x))
        return F.struct((a["n"] + F.when(blank, 0).otherwise(1)).alias("n"), F.concat(a["out"], F.array(shown)).alias("out"))

    return F.aggregate(F.split(content, "\n", -1), zero, step, lambda a: F.array_join(a["out"], "\n"))


def with_context(chunk: Column, context: Column) -> Column:
    return F.concat(F.lit("[Document Context: "), context, F.lit("]\n\n"), chunk)
