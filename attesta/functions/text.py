"""Texts of pages and statements: subject identifiers, job links, candidates, figures and display."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions import identifiers
from attesta.functions.names import normalize_name
from attesta.functions.numbers import parse_localised
from attesta.functions.rules import let

#: Fixed values.
LABELLED = r"(?i)(?:org(?:anisasjons)?\.?\s*(?:nr|nummer)\.?|vat(?:\s*(?:id|number))?)\s*[:#]?\s*(?:NO\s*)?([0-9]{9}|[0-9]{3}(?:[\s.\-][0-9]{3}){2})(?![0-9])"
OTHERS = r"(?iU)\b(customer|client|kunde|supplier|leverandør)\b"
FIGURES = [
    ("driftsinntekter|omsetning|operat?:?\\s*inntekter", "revenue"),
    ("driftsresultat", "operating_result"),
    ("(?:årsresultat|ar:?\\s*resultat| result of the year)", "annual_result"),
    ("sum\\s+eiendeler|total\\s+assets", "total_assets"),
    ("egenkapital", "equity"),
    ("sum\\s+gjeld|total\\s+liabilities", "total_liabilities"),
    ("gjennomsnittlig\\s+antall\\s+ansatte|antall\\s+ansatte", "employees"),
    ("regnskapsåret|regnskap[åa]r", "fiscal_year"),
]
CELL = r"\([0-9][0-9 \u00a0\u202f.,]*\)|[+\-\u2212]?[0-9][0-9\u00a0\u202f.,]*"
MOST_LINE = 300
JOB_PATH = r"(?i)/(?:stilling(?:er)?|ledige-stillinger|vacanc|vacant|open-positions|available-positions|jobs?|jobb)([-_/]|$)"
JOB_SEGMENT = r"(?i)/(?:stilling|vacanc|vacant|ledige|open-position|available-position)"
QUOTED_TITLE = "(?i)stilling(?:en)?\\s*[\u2018\"\u201c]([^\u2019\"\u201d]+)[\u2019\"\u201d]"
NO_PAGE = "(?i)^(#|mailto:|tel:|javascript:)"
CONTEXT = 120
MOST_LINKS, MOST_DOCUMENTS = 40, 5


def subject_ids(text: Column) -> Column:
    """Valid labelled identifiers in order, unless the same clause names a customer or supplier before them.

    The text is cut in front of each label, so a piece's end is the context of the
    label that follows, without a search for offsets.
    """
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), f"({LABELLED})", "\x01$1")
    pieces = F.split(marked, "\x01")
    pairs = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.struct(F.get(pieces, i - 1).alias("before"), F.get(pieces, i).alias("here")))
    own = F.filter(F.when(F.size(pieces) > 1, pairs).otherwise(F.array().cast("array<struct<before:string,here:string>>")), lambda p: ~F.element_at(F.split(F.right(p["before"], F.lit(CONTEXT)), r"[.!?;\n]"), -1).rlike(OTHERS))
    numbers = F.transform(own, lambda p: F.regexp_replace(F.regexp_extract(p["here"], LABELLED, 1), r"[\s.\-]", ""))
    return F.array_distinct(F.filter(numbers, lambda n: n.rlike("^[0-9]{9}$") & identifiers.checksum_ok(F.when(n.rlike("^[0-9]{9}$"), n))))


def guessed_name(text: Column, target: Column) -> Column:
    """The target if the text has it, else what stands before a legal form, else the beginning."""
    before = F.regexp_extract(text, r"([A-ZÆØÅ][\wÆØÅæøå&.\- ]{1,60}?)\s+(?:ASA|AS|NUF|ANS|DA|SA)\b", 1)
    return F.when(F.contains(F.lower(text), F.lower(target)), target).when(before != "", F.trim(before)).otherwise(F.trim(F.left(text, F.lit(80))))


def candidate_urls(name: Column, registered: Column) -> Column:
    """The registered site, then the name's first word and its first two words, joined by a hyphen, under .no and .com; none that differs from an earlier one by a slash at its end alone."""
    words = F.filter(F.split(normalize_name(name), " "), lambda w: w != "")
    brands = F.array_distinct(F.array_compact(F.array(F.get(words, F.lit(0)), F.when(F.size(words) > 1, F.array_join(F.slice(words, 1, 2), "-")))))
    made = F.flatten(F.transform(brands, lambda b: F.array(*(F.concat(F.lit("https://www."), b, F.lit(f".{tld}")) for tld in ("no", "com")))))
    plain = lambda u: F.regexp_replace(u, "/+$", "")
    return F.array_compact(F.concat(F.array(F.nullif(registered, F.lit(""))), F.filter(made, lambda u: ~F.coalesce(plain(u) == plain(registered), F.lit(False)))))


def figure_lines(text: Column) -> Column:
    """array of struct(line, field, value): for each line of up to MOST_LINE characters the first figure named in it; value only if it has one number.

    An ordinary space sets columns apart, no-break spaces group digits, so two
    years side by side give no value.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct((i + 1).alias("line"), F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "").alias("text")))
    # one pass tells which lines name a figure; the rest is for these only
    named = F.filter(lines, lambda x: (F.length(x["text"]) <= MOST_LINE) & x["text"].rlike("(?iu)" + "|".join(f"(?:{pattern})" for pattern, _ in FIGURES)))

    def of(x: Column) -> Column:
        field = F.lit(None).cast("string")
        for pattern, name in reversed(FIGURES):
            field = F.when(x["text"].rlike(f"(?iu){pattern}"), F.lit(name)).otherwise(field)
        cells = F.regexp_extract_all(x["text"], F.lit(CELL), F.lit(0))
        value = let(F.when(F.size(cells) == 1, F.get(cells, F.lit(0))), lambda cell: parse_localised(cell))
        return F.struct(x["line"].alias("line"), field.alias("field"), value.alias("value"))

    return F.transform(named, of)


def page_links(found: Column, domain: Column, of_url: Callable[[Column], Column]) -> Column:
    """struct(internal, documents) of anchors: distinct http links of the same registrable domain, fragments off, and documents, MOST_LINKS and MOST_DOCUMENTS at most."""
    fit = F.filter(found, lambda a: (a["href"] != "") & ~a["href"].rlike(NO_PAGE) & F.coalesce(a["url"].startswith("http"), F.lit(False)))
    urls = lambda rows: F.array_distinct(F.transform(rows, lambda a: F.substring_index(a["url"], "#", 1)))
    path = lambda a: F.lower(F.regexp_extract(a["url"], "^[^:]*://[^/?#]*([^?#]*)", 1))
    document = lambda a: path(a).endswith(".pdf") | path(a).contains("/pdf")
    inside = F.filter(fit, lambda a: ~document(a) & (of_url(a["url"]) == domain))
    return F.struct(F.slice(urls(inside), 1, MOST_LINKS).alias("internal"), F.slice(urls(F.filter(fit, document)), 1, MOST_DOCUMENTS).alias("documents"))


def job_links(found: Column) -> Column:
    """array of struct(url, title) of anchors: links to job paths whose text has 4 to 120 characters, fragments off, each once; a quoted title alone stands for its text."""
    path = lambda a: F.regexp_extract(a["url"], "^[^:]*://[^/?#]*([^?#]*)", 1)
    fit = F.filter(found, lambda a: a["url"].isNotNull() & ~a["href"].rlike(NO_PAGE) & F.length(a["text"]).between(4, 120) & (path(a).rlike(JOB_PATH) | path(a).rlike(JOB_SEGMENT)))
    title = lambda t: F.left(F.coalesce(F.nullif(F.trim(F.regexp_extract(t, QUOTED_TITLE, 1)), F.lit("")), t), F.lit(120))
    rows = F.transform(fit, lambda a: F.struct(F.substring_index(a["url"], "#", 1).alias("url"), title(a["text"]).alias("title")))
    first = F.array_distinct(F.transform(rows, lambda x: x["url"]))
    return F.transform(first, lambda u: F.get(F.filter(rows, lambda x: x["url"] == u), F.lit(0)))


def display_number(value: Column) -> Column:
    return F.translate(F.format_number(value.cast("decimal(38,0)"), 0), ",", " ")


def exit_code(states: Column, valid: Column) -> Column:
    """Aggregate: 1 if any failed, else 2 if any input was invalid, else 0."""
    return F.when(F.bool_or(states == "failed"), 1).when(F.bool_or(~valid), 2).otherwise(0)
