"""The brief of an entity: what is known of it in a fixed order, each sentence with the claims that it rests on.

One aggregation takes the latest observation of each field, a ranked one the first
few statements, subunits, roles and events; the sentences are expressions.  What an
entity has beyond these few is never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.rules import let, literal
from attesta.operators.profile_rules import availability, notices
from attesta.operators.views import top_each

#: Amounts in order, what scopes and units are called, categories whose absence is said, and how many of a kind are shown.
AMOUNTS = {"total_operating_revenue": "total operating revenue", "operating_result": "operating result", "annual_result": "annual result", "equity": "equity", "total_assets": "total assets", "total_liabilities": "total liabilities"}
SCOPES = {"legal_entity": "legal entity", "group": "group", "branch": "branch", "brand": "brand"}
UNITS = {"currency_unit_x1": "whole currency units"}
UNKNOWN = {"financials": "Annual accounts", "leadership": "Board/management roles", "products_services": "Products/services", "jobs": "Job postings", "recent_activity": "Recent public activity", "business_description": "Business description", "locations": "Location details", "website": "Company website"}
SHOWN = {"statement": 2, "branch": 3, "role": 5, "activity": 3}
NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"


def cite(claim: Column) -> Column:
    return F.concat(F.lit("["), claim, F.lit("]"))


def plain_text(value: Column) -> Column:
    """A JSON value as text: strings without quotes, others as they are."""
    return let(F.try_parse_json(value), lambda v: F.coalesce(literal(v), F.to_json(v)))


def grouped(number: Column) -> Column:
    """A plain number with a space between groups of three digits before the point."""
    whole = F.regexp_extract(number, "^-?[0-9]+", 0)
    return F.concat(F.regexp_replace(whole, r"(?<=[0-9])(?=(?:[0-9]{3})+$)", " "), F.substring(number, F.length(whole) + 1, F.length(number)))


def named(names: dict[str, str], key: Column, other: Column | None = None) -> Column:
    out = F.lit(None).cast("string") if other is None else other
    for name, text in names.items():
        out = F.when(key == name, F.lit(text)).otherwise(out)
    return out


def amount_text(fact: Column) -> Column:
    """An amount with currency, unit, period and scope; null where one of them is missing or the value is no plain number of at most 256 digits."""
    number = fact["text"]
    fit = fact["currency"].rlike("^[A-Z]{3}$") & (F.trim(fact["unit"]) != "") & (F.trim(fact["period"]) != "") & fact["scope"].isin(*SCOPES) & number.rlike(NUMBER) & (F.length(F.regexp_replace(number, "[-.]", "")) <= 256)
    return F.when(fit, F.concat(fact["currency"], F.lit(" "), grouped(number), F.lit(" (unit: "), named(UNITS, fact["unit"], fact["unit"]), F.lit("; period: "), fact["period"], F.lit("; "), named(SCOPES, fact["scope"]), F.lit(")")))


def _latest(facts: DataFrame, key: str) -> DataFrame:
    """One row an entity: of each field the observation of the latest period, the earliest to arrive of several."""
    whole = F.struct("claim_id", "text", "currency", "unit", "period", "scope", "from_page")
    order = F.struct(F.coalesce("period", F.lit("")), -F.col("seq"))
    fields = [("identity", f) for f in ("legal_name", "industry_description", "industry_code", "employee_count")] + [("business_description", "description")] + [("financials", f) for f in AMOUNTS]
    of = lambda category, field: (F.col("category") == category) & (F.col("field") == field)
    return facts.groupBy(key).agg(F.count("*").alias("published"), *(F.max_by(F.when(of(*f), whole), F.when(of(*f), order)).alias(f[1]) for f in fields))


def _lists(facts: DataFrame, key: str) -> DataFrame:
    """(key, statement, branch, role, activity): the texts of the first few of each kind, and how many subunits there are."""
    v = F.try_parse_json("value")
    text = lambda name: literal(F.try_variant_get("_v", f"$.{name}", "variant"))
    has = lambda *names: F.forall(F.array(*(text(n) for n in names)), lambda x: x.isNotNull())
    full = lambda name: F.coalesce(text(name), F.lit("")) != ""
    is_ = lambda category, field=None: (F.col("category") == category) & (F.lit(True) if field is None else F.col("field") == field)
    kind = (
        F.when(is_("accounting_filings", "statement") & (F.col("scope") == "legal_entity") & has("record_id", "period_start", "period_end", "currency"), "statement")
        .when(is_("locations", "branch") & (text("parent_orgnr") == F.col(key)) & full("name") & (text("orgnr") == F.col("item_key")) & (F.col("item_key") != ""), "branch")
        .when(is_("leadership") & full("name"), "role")
        .when(is_("recent_activity"), "activity")
    )
    rows = facts.withColumn("_v", v).withColumn("_kind", kind).filter("_kind IS NOT NULL")
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    cited = say(" ", cite(F.col("claim_id")))
    statement = say("Accounts record ", text("record_id"), ": ", text("period_start"), " to ", text("period_end"), "; source currency ", text("currency"), "; legal entity.", cited)
    where = F.concat_ws(" ", *(F.nullif(text(n), F.lit("")) for n in ("physical_address", "postal_code", "postal_area")))
    ends = [F.when(full(n), say(f", {label} ", text(n))).otherwise("") for n, label in (("closure_date", "closed"), ("deleted_date", "deleted"))]
    branch = say(text("name"), " (orgnr ", text("orgnr"), ")", F.when(where != "", say(", ", where)).otherwise(""), *ends, cited)
    role = say(text("name"), " (", F.coalesce(text("role"), "field"), ")", cited)
    day = F.coalesce(F.nullif(text("date"), F.lit("")), F.nullif(text("registered"), F.lit("")))
    event = F.when(F.schema_of_variant("_v").startswith("OBJECT"), say(F.coalesce(text("event"), "field"), F.when(day.isNotNull(), say(" (", day, ")")).otherwise(""))).otherwise(F.col("text"))
    said = F.when(kind == "statement", statement).when(kind == "branch", branch).when(kind == "role", role).otherwise(say(event, cited))
    # statements by period, the latest first; subunits by their number; the rest by slot; then as they came
    item, of_kind = F.coalesce("item_key", F.lit("")), F.col("_kind")
    turned = F.when(of_kind == "statement", F.translate(F.coalesce("period", F.lit("")), "0123456789", "9876543210")).when(of_kind == "branch", item).otherwise(F.col("field"))
    rows = rows.select(key, "_kind", turned.alias("_first"), F.when(of_kind.isin("role", "activity"), item).otherwise("").alias("_then"), "seq", said.alias("text"))
    shown = top_each(rows, [key, "_kind"], max(SHOWN.values()), "_first", "_then", "seq").filter(F.col("position") <= named({k: str(n) for k, n in SHOWN.items()}, F.col("_kind")).cast("int"))
    texts = shown.groupBy(key).agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("_kind") == k, F.struct("position", "text")))), lambda x: x["text"]).alias(k) for k in SHOWN))
    return texts.join(rows.filter("_kind = 'branch'").groupBy(key).agg(F.count("*").alias("branches")), key, "left")


def briefs(facts: DataFrame, entities: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """(key, brief) of every entity.

    facts: key, claim_id, category, field, item_key, scope, period, value (JSON),
    currency, unit, from_page (is it located in a page?), seq (order of arrival): the
    current, published ones.  entities: key, coverage (map of category to state),
    previous_run_id, conflicts (their number).  changes: as profile_rules.notices()
    takes them.

    Rows: an entity without facts has a brief of what isn't known; a null value is
    no description; periods compare as texts; numbers with exponents count as not
    safely rendered.
    """
    facts = facts.withColumn("text", plain_text(F.col("value")))
    latest, lists = _latest(facts, key), _lists(facts, key)
    rows = entities.join(latest, key, "left").join(lists, key, "left").withColumns({"published": F.coalesce("published", F.lit(0))})
    noted = notices(changes, rows.select(key, "previous_run_id", "published", F.lit(0).alias("last_known")), key)
    rows = rows.join(noted.select(key, "notice"), key)
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    state = lambda category: F.coalesce(F.try_element_at(F.col("coverage"), F.lit(category)), F.lit("not_found"))
    c, claim = F.col, lambda name: cite(F.col(f"{name}.claim_id"))
    value = lambda name: F.col(f"{name}.text")
    there = lambda name: F.col(name).isNotNull() & ~F.coalesce(value(name), F.lit("null")).isin("null", "")
    amounts = F.array(*(F.when(c(f).isNotNull(), F.coalesce(say(f"{label} ", amount_text(c(f)), " ", claim(f)), F.lit(""))) for f, label in AMOUNTS.items()))
    rows = rows.withColumn("_amounts", F.array_compact(amounts))
    safe = F.filter("_amounts", lambda a: a != "")
    listed = lambda name, between: F.array_join(F.coalesce(c(name), F.array().cast("array<string>")), between)
    some = lambda name: F.coalesce(F.size(c(name)), F.lit(0)) > 0
    unknown = F.array_join(F.array_compact(F.array(*(F.when(state(k) != "found", say(f"{label} (", availability(state(k)), ")")) for k, label in UNKNOWN.items()))), "; ")
    sentences = [
        F.when(c("legal_name").isNull(), say("Organisation ", c(key), " (legal name unresolved)")).otherwise(say(value("legal_name"), " (orgnr ", c(key), ") ", claim("legal_name"))),
        F.when(there("description"), say(F.when(c("description.from_page"), "Website description").otherwise("What it does"), ": ", value("description"), " ", claim("description"))).otherwise(say("What it does: ", availability(state("business_description")), ".")),
        F.when(there("industry_description"), say("Industry: ", value("industry_description"), " ", claim("industry_description"), F.when(c("industry_code").isNotNull(), say(" (", value("industry_code"), " ", claim("industry_code"), ")")).otherwise(""))).otherwise("Industry: not verified in this run."),
        F.when(F.size(safe) > 0, say("Financials: ", F.array_join(safe, "; "), ".")).when(F.size("_amounts") > 0, "Financials: monetary values could not be safely rendered.").otherwise(say("Financials: ", availability(state("financials")), ".")),
        F.when((F.size(safe) > 0) & (F.size(safe) < F.size("_amounts")), "Some monetary observations could not be safely rendered and are withheld."),
        F.when(c("employee_count").isNotNull(), say("Registered employees: ", F.when(value("employee_count").rlike(NUMBER), grouped(value("employee_count"))).otherwise(value("employee_count")), ". ", claim("employee_count"))),
        F.when(some("statement"), listed("statement", " ")),
        F.when(some("branch"), say("Registered subunits observed: ", listed("branch", "; "), ".")),
        F.when(c("branches") > SHOWN["branch"], "Additional verified subunit observations appear in the profile."),
        F.when(some("role"), say("Key roles: ", listed("role", ", "), ".")).otherwise(say("Key roles: ", availability(state("leadership")), ".")),
        F.when(some("activity"), say("Activity observations: ", listed("activity", "; "), ".")).otherwise(say("Recent activity: ", availability(state("recent_activity")), ".")),
        c("notice"),
        F.when(unknown != "", say("Unknowns: ", unknown, ".")),
        F.when(c("conflicts") > 0, "Some sources disagree. Disputed values are withheld; their evidence remains available."),
    ]
    return rows.select(key, F.concat_ws(" ", *sentences).alias("brief"))
