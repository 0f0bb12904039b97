"""Descriptions of organisations in pages' JSON-LD: nodes are exploded, and declared rules judge each.

A script is parsed into a VARIANT once; its typed roots and graph items become
rows, and the first rule that a row breaks is its reason.

Rows: a null page has no script; repeated keys give repeated rows; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.identifiers import valid_digits
from attesta.functions.rules import first_failure, has, items, literal, variant_at
from attesta.functions.structured_data import page_content

#: Fixed values.
MOST_SCRIPTS, MOST_NODES, MOST_TEXT, MOST_IDENTIFIERS = 32, 128, 4_000, 16
CONTEXTS = ["https://schema.org", "https://schema.org/", "http://schema.org", "http://schema.org/"]
TYPES = ["Organization", "Corporation"]
LABELS = ["orgnr", "org.nr", "org.nr.", "organisasjonsnummer", "norwegian organisation number"]
TAX_KEYS = ["vatID", "taxID"]


def folded(text: Column) -> Column:
    """White space squeezed, cases folded."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " "))), "ß", "ss")


def _typed(node: Column, names: list[str]) -> Column:
    kinds = items(node, "@type")
    return (F.size(kinds) > 0) & F.forall(kinds, lambda k: F.coalesce(literal(k).isin(names), F.lit(False)))


def nodes(scripts: DataFrame, key: str) -> DataFrame:
    """(key, script, pointer, said, problem) of every typed root and graph item; a script that is refused as a whole has one row with its problem.

    ``said`` is what the node says of its subject (see subject_of).

    scripts: key and script, a struct of index, text and problem.
    """
    doc = scripts.select(key, F.col("script.index").alias("script"), F.col("script.problem").alias("_bad"), F.when(F.col("script.problem").isNull(), F.try_parse_json("script.text")).alias("_doc"))
    listed = F.try_variant_get("_doc", "$", "array<variant>")
    doc = doc.select(key, "script", "_bad", listed.isNotNull().alias("_listed"), F.when(F.col("_doc").isNotNull(), F.coalesce(listed, F.array("_doc"))).alias("_roots"))
    context = lambda root: F.try_variant_get(root, "$['@context']", "variant")
    graph = lambda root: F.try_variant_get(root, "$['@graph']", "array<variant>")
    is_object = lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False))
    problem = lambda root: first_failure(
        (is_object(root), "unsupported JSON root"),
        (~has(root, "@context") | (F.schema_of_variant(context(root)) == "VOID") | literal(context(root)).isin(CONTEXTS), "unsupported root literal context"),
        (~has(root, "@graph") | graph(root).isNotNull(), "graph must be a literal array"),
        (F.forall(F.coalesce(graph(root), F.array().cast("array<variant>")), is_object), "graph item must be an object"),
    )
    made = lambda root: F.when(has(root, "@type"), 1).otherwise(0) + F.coalesce(F.size(graph(root)), F.lit(0))
    doc = doc.withColumns({"_why": F.get(F.array_compact(F.transform("_roots", problem)), F.lit(0)), "_n": F.aggregate(F.transform("_roots", made), F.lit(0), lambda a, b: a + b)})
    whole = F.coalesce("_bad", "_why", F.when(F.greatest("_n", F.size("_roots")) > MOST_NODES, "structured node capacity exceeded"))
    doc = doc.withColumn("problem", whole)
    refused = doc.filter("problem IS NOT NULL").select(key, "script", "problem")
    roots = doc.filter("problem IS NULL").select(key, "script", "_listed", F.posexplode("_roots").alias("_i", "_root"))
    at = F.when(F.col("_listed"), F.concat(F.lit("/"), F.col("_i").cast("string"))).otherwise("")
    roots = roots.withColumns({"_at": at, "context": literal(context(F.col("_root"))), "_graph": graph(F.col("_root"))})
    top = roots.filter(has(F.col("_root"), "@type")).select(key, "script", F.col("_at").alias("pointer"), F.col("_root").alias("node"), "context")
    inner = roots.select(key, "script", "_at", "context", F.posexplode("_graph").alias("_k", "node"))
    inner = inner.select(key, "script", F.concat("_at", F.lit("/@graph/"), F.col("_k").cast("string")).alias("pointer"), "node", "context")
    said = top.unionByName(inner).select(key, "script", "pointer", subject_of(F.col("node"), F.col("context")).alias("said"), F.lit(None).cast("string").alias("problem"))
    return said.unionByName(refused, allowMissingColumns=True)


def subject_of(node: Column, context: Column) -> Column:
    """What a node says of its subject, whoever that is: struct of shape (why it can't describe an organisation), name, prefixed (tax numbers carry the country), taxes and labels (valid numbers, null for others), identifiers (why they can't be read), description, bounded."""
    text = lambda k: literal(variant_at(node, k))
    known = lambda of: F.coalesce(literal(variant_at(of, "@context")).isin(CONTEXTS), F.lit(False))
    given = items(node, "identifier")
    labelled = F.filter(given, lambda i: F.coalesce(folded(literal(variant_at(i, "propertyID"))).isin(LABELS), F.lit(False)))
    taxes = F.array_compact(F.array(*(F.when(has(node, k), F.struct(text(k).alias("stated"))) for k in TAX_KEYS)))
    description = text("description")
    parts = {
        "shape": first_failure((F.when(has(node, "@context"), known(node)).otherwise(context.isin(CONTEXTS)), "unsupported literal context"), (_typed(node, TYPES), "unsupported literal organization type")),
        "name": folded(F.when(has(node, "legalName"), text("legalName")).otherwise(text("name"))),
        "prefixed": F.forall(taxes, lambda t: F.coalesce(F.trim(t["stated"]).rlike(r"(?i)^NO\s*[0-9]"), F.lit(False))),
        "taxes": F.transform(taxes, lambda t: valid_digits(t["stated"])),
        "identifiers": first_failure(
            (F.size(given) <= MOST_IDENTIFIERS, "identifier capacity exceeded"),
            (F.forall(labelled, lambda i: (~has(i, "@context") | known(i)) & _typed(i, ["PropertyValue"])), "unsupported identifier vocabulary/type"),
        ),
        "labels": F.transform(labelled, lambda i: valid_digits(literal(variant_at(i, "value")))),
        "description": description,
        "bounded": (F.trim(F.regexp_replace(description, r"(?U)\s+", " ")) != "") & (F.length(description) <= MOST_TEXT) & ~description.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"),
    }
    return F.struct(*(v.alias(k) for k, v in parts.items()))


def refusal(said: Column, name: Column, number: Column) -> Column:
    """The first rule that keeps a node from describing the named and numbered organisation; null if none does."""
    all_are = lambda numbers: F.forall(numbers, lambda n: n.eqNullSafe(number))
    return first_failure(
        (said["shape"].isNull(), said["shape"]),
        ((F.trim(name) != "") & (said["name"] == folded(name)), "exact legal name not established"),
        (said["prefixed"], "Norwegian VAT country prefix missing"),
        (all_are(said["taxes"]), "VAT subject differs or is invalid"),
        (said["identifiers"].isNull(), said["identifiers"]),
        (all_are(said["labels"]), "labelled organisation subject differs or is invalid"),
        ((F.size(said["taxes"]) > 0) | (F.size(said["labels"]) > 0), "explicit Norwegian identifier not established"),
        (said["bounded"], "description must be a bounded nonempty literal text"),
    )


def descriptions(pages: DataFrame, key: str, html: Column, name: Column, number: Column) -> DataFrame:
    """(key, script, pointer, text, reason): every candidate description of each page; reason is null where it is one of the named and numbered organisation."""
    of = pages.select(key, name.alias("_name"), number.alias("_number"), page_content(html).alias("_page"))
    whole = first_failure((F.col("_page.count") <= MOST_SCRIPTS, "structured script capacity exceeded"), (valid_digits(F.col("_number")).isNotNull(), "invalid target organisation number"))
    # the page's columns travel with its scripts, so that nothing is joined back
    of = of.withColumn("_whole", whole)
    refused = of.filter("_whole IS NOT NULL").select(key, F.col("_whole").alias("reason"))
    packed = of.filter("_whole IS NULL").select(F.struct(F.col(key).alias("k"), F.col("_name").alias("name"), F.col("_number").alias("number")).alias("of"), F.explode("_page.scripts").alias("script"))
    rows = nodes(packed, "of")
    number = valid_digits(F.col("of.number"))
    why = F.coalesce("problem", refusal(F.col("said"), F.col("of.name"), number))
    rows = rows.select(F.col("of.k").alias(key), "script", F.concat("pointer", F.lit("/description")).alias("pointer"), F.col("said.description").alias("text"), why.alias("reason"))
    return rows.unionByName(refused, allowMissingColumns=True)
