"""Pages and URLs: classes, families, links, contacts and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Page classes by keywords of the first two path segments, in order.
CLASSES = [
    (("jobb", "karriere", "careers", "jobs", "vacancies", "ledige-stillinger"), "CAREERS", 75),
    (("presse", "media", "news", "nyheter", "aktuelt", "presserom"), "NEWS", 70),
    (("ledelse", "management", "styret", "board", "governance"), "LEADERSHIP", 65),
    (("investor", "finans", "rapporter", "reports", "ir"), "FINANCIAL", 70),
    (("kontakt", "contact"), "CONTACT", 75),
    (("produkter", "products"), "PRODUCT", 80),
    (("tjenester", "services", "losninger", "solutions"), "SERVICE", 80),
    (("om-oss", "om", "about", "selskapet", "company", "histoire"), "ABOUT", 85),
]
JUNK = (
    r"(?i)/(privacy|cookies?|gdpr|terms|legal|imprint|wp-admin|wp-content|wp-includes|feed|xmlrpc|login|cart|checkout|category|tag|author|page/[0-9]+)"
    r"|\.((css|js|jpg|jpeg|png|gif|svg|webp|ico|woff2?|ttf|mp4|zip)(\?.*)?)$"
)
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
PHONE = r"(?:\+47[\s-]?)?[0-9]{2}[\s-]?[0-9]{2}[\s-]?[0-9]{2}[\s-]?[0-9]{2}(?:[\s-]?[0-9]{2})?|(?:\+47[\s-]?)?[0-9]{3}[\s-]?[0-9]{2}[\s-]?[0-9]{3}"
ADDRESS = r"(?U)\b[A-ZÆØÅ][\wæøå-]+(?:veien|gata|gaten|street|road|vei|allé|all)\s*[0-9]+[A-Za-z]?\b"
ROLES = [
    (r"(konserndirektør|administrerende direktør|adm\. dir\.|CEO)", "CEO"),
    (r"(daglig leder)", "daglig leder"),
    (r"(styreleder|chair)", "styreleder"),
    (r"(CFO|finansdirektør)", "CFO"),
    (r"(CTO|teknologidirektør)", "CTO"),
]
ROLE_NAME = r"\s*[:\-]?\s*([A-ZÆØÅ][\wæøå.\- ]{2,50})"
FAMILIES = {"registry_accounts": "financials", "company_document": "financials", "company_website": "website", "public_sector": "jobs", "job_board": "jobs"}
PREFIX_SLACK = 12


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[^:/?#]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def classify_url(url: Column) -> Column:
    """struct(page_type, priority)."""
    path = F.regexp_replace(F.lower(path_of(url)), "^/+|/+$", "")
    segments = F.slice(F.filter(F.split(path, "/"), lambda s: s != ""), 1, 2)
    answer = lambda kind, priority: F.struct(F.lit(kind).alias("page_type"), F.lit(priority).alias("priority"))

    def hit(keywords):
        def of(segment):
            tests = [(segment == k) | F.array_contains(F.split(segment, "[-_]"), k) | (segment.startswith(k) & (F.length(segment) <= len(k) + PREFIX_SLACK)) for k in keywords]
            return reduce(lambda a, b: a | b, tests)

        return F.exists(segments, of)

    out = F.when(path == "", answer("HOME", 60)).when(F.concat(F.lit("/"), path).rlike(JUNK), answer("OTHER", 0))
    for keywords, kind, priority in CLASSES:
        out = out.when(hit(keywords), answer(kind, priority))
    return out.otherwise(answer("OTHER", 20))


def source_family(source_type: Column, url: Column) -> Column:
    path = F.regexp_replace(path_of(url), "/+$", "")
    registry = F.when(path.endswith("/roller"), "leadership").when(path.contains("/underenheter"), "locations").otherwise("identity")
    other = reduce(lambda c, kv: F.when(source_type == kv[0], F.lit(kv[1])).otherwise(c), FAMILIES.items(), F.lit("other"))
    return F.when(source_type == "registry", registry).otherwise(other)


def contacts(text: Column) -> Column:
    """struct(emails, phones, addresses), three of each at most; null if there is none."""
    first = lambda pattern: F.slice(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), 1, 3)
    emails, phones, addresses = first(EMAIL), first(PHONE), first(ADDRESS)
    return F.when(F.size(emails) + F.size(phones) + F.size(addresses) > 0, F.struct(emails.alias("emails"), phones.alias("phones"), addresses.alias("addresses")))


def _labelled(role: str):
    return lambda name: F.struct(name.alias("name"), F.lit(role).alias("role"))


def role_names(text: Column) -> Column:
    """array of struct(name, role): names of two to five words behind a role's words; eight at most."""
    parts = []
    for role, label in ROLES:
        names = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?i)" + role + ROLE_NAME), F.lit(2))
        names = F.transform(names, lambda n: F.regexp_replace(F.trim(n), "[.,;]+$", ""))
        fit = F.filter(names, lambda n: F.size(F.split(n, r"\s+")).between(2, 5) & ~F.array_contains(F.split(n, r"\s+"), "og"))
        parts.append(F.transform(fit, _labelled(label)))
    return F.slice(F.concat(*parts), 1, 8)


def page_title(html: Column) -> Column:
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.left(F.trim(F.regexp_replace(title, r"\s+", " ")), F.lit(120))


def links(html: Column) -> Column:
    """Distinct href targets in order, without fragments, mail, phone and script links."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, F.trim), lambda h: (h != "") & ~h.rlike("(?i)^(#|mailto:|tel:|javascript:)")))


def website(raw: Column) -> Column:
    """Scheme and host in lower case, https by default, no fragment; null for other schemes and for credentials."""
    value = F.trim(raw)
    full = F.when(value.contains("://"), value).otherwise(F.concat(F.lit("https://"), value))
    pattern = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)([^#]*)"
    scheme, host, rest = (F.regexp_extract(full, pattern, i) for i in (1, 2, 3))
    return F.when(F.lower(scheme).isin("http", "https") & (host != "") & ~host.contains("@"), F.concat(F.lower(scheme), F.lit("://"), F.lower(host), rest))


def address_line(lines: Column, postcode: Column, place: Column) -> Column:
    text = F.concat_ws(" ", F.nullif(F.array_join(lines, " "), F.lit("")), F.nullif(postcode, F.lit("")), F.nullif(place, F.lit("")))
    return F.nullif(text, F.lit(""))


def registry_status(deleted: Column, bankrupt: Column, liquidation: Column, compulsory: Column) -> Column:
    """Three-valued flags in order of weight; active only if all three are literally false."""
    return (
        F.when(F.coalesce(deleted, F.lit("")) != "", "deleted")
        .when(bankrupt, "bankrupt")
        .when(liquidation, "under_liquidation")
        .when(compulsory, "under_compulsory_liquidation")
        .when(~bankrupt & ~liquidation & ~compulsory, "active")
        .otherwise("unknown")
    )
