"""Scalar operators over names, keys, pages and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import identifiers, json_tokens, names, numbers, web
from attesta.plans.registry import query, read

CHECK = "(3*CAST(v[1] AS INT)+2*CAST(v[2] AS INT)+7*CAST(v[3] AS INT)+6*CAST(v[4] AS INT)+5*CAST(v[5] AS INT)+4*CAST(v[6] AS INT)+3*CAST(v[7] AS INT)+2*CAST(v[8] AS INT)) % 11"


@query(
    "id_checksum",
    f"""WITH k AS (SELECT c_custkey, CAST(900000000 + c_custkey AS VARCHAR) AS v, c_custkey % 5 AS kind FROM customer)
        SELECT c_custkey, CASE WHEN kind = 4 THEN left(v, 7) WHEN kind = 3 THEN 'x' || v ELSE v END AS value,
               kind < 3 AND (11 - {CHECK}) % 11 <> 10 AND (11 - {CHECK}) % 11 = CAST(v[9] AS INT) AS valid,
               CASE WHEN kind = 4 THEN 'expected 9 digits, got 7' WHEN kind = 3 THEN 'contains non-digit characters'
                    WHEN (11 - {CHECK}) % 11 <> 10 AND (11 - {CHECK}) % 11 = CAST(v[9] AS INT) THEN 'valid format and checksum' ELSE 'checksum failed (modulus 11)' END AS reason
        FROM k""",
)
def id_checksum(spark, sf_dir):
    v = (F.lit(900000000) + F.col("c_custkey")).cast("string")
    spaced = F.concat_ws(" ", F.substring(v, 1, 3), F.substring(v, 4, 3), F.substring(v, 7, 3))
    kind = F.col("c_custkey") % 5
    raw = F.when(kind == 4, F.left(v, F.lit(7))).when(kind == 3, F.concat(F.lit("x"), v)).when(kind == 2, F.concat(F.lit(" NO "), spaced, F.lit(" MVA"))).when(kind == 1, F.translate(spaced, " ", ".")).otherwise(v)
    checked = identifiers.validate_id(raw)
    return read(spark, sf_dir, "customer").select("c_custkey", checked.alias("c")).select("c_custkey", "c.value", "c.valid", "c.reason")


@query(
    "ids_in_text",
    f"""WITH k AS (SELECT c_custkey, CAST(900000000 + c_custkey AS VARCHAR) AS v FROM customer)
        SELECT c_custkey, CASE WHEN (11 - {CHECK}) % 11 <> 10 AND (11 - {CHECK}) % 11 = CAST(v[9] AS INT) THEN v ELSE '' END AS found FROM k""",
)
def ids_in_text(spark, sf_dir):
    v = (F.lit(900000000) + F.col("c_custkey")).cast("string")
    text = F.concat(F.lit("see 1"), v, F.lit(" and "), v, F.lit(", or "), F.substring(v, 1, 3), F.lit(" "), F.substring(v, 4, 3), F.lit(" "), F.substring(v, 7, 3), F.lit("."))
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(identifiers.ids_in_text(text), ",").alias("found"))


@query(
    "name_normalise",
    r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' & ' || p_type || ' AS+' || p_brand || ' stiftelse'), '[&+]', ' og ', 'g').replace(' as ', '   ').replace(' stiftelse', ' '), '[^0-9a-z]+', ' ', 'g')) AS name FROM part""",
)
def name_normalise(spark, sf_dir):
    raw = F.concat("p_name", F.lit(" & "), "p_type", F.lit(" AS+"), "p_brand", F.lit(" stiftelse"))
    return read(spark, sf_dir, "part").select("p_partkey", names.normalize_name(raw).alias("name"))


@query(
    "url_domain",
    """WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM pages)
       SELECT page_id, host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain FROM h""",
)
def url_domain(spark, sf_dir):
    host = names.host_of(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", host.alias("host"), names.registrable_domain(host).alias("domain"))


def _class_sql() -> str:
    seg = "list_filter(string_split(p, '/'), lambda s: s <> '')[1:2]"
    arms = []
    for keywords, kind, priority in web.CLASSES:
        tests = " OR ".join(f"s = '{k}' OR list_contains(string_split_regex(s, '[-_]'), '{k}') OR (starts_with(s, '{k}') AND length(s) <= {len(k) + web.PREFIX_SLACK})" for k in keywords)
        arms.append(f"WHEN len(list_filter({seg}, lambda s: {tests})) > 0 THEN '{kind} {priority}'")
    return f"""WITH x AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^(?:[^:/?#]*:)?(?://[^/?#]*)?([^?#]*)', 1)), '^/+|/+$', '', 'g') AS p0 FROM pages),
      y AS (SELECT page_id, replace(replace(p0, 'en/', 'om-oss/'), 'de/', 'produkter') AS p FROM x),
      z AS (SELECT page_id, CASE WHEN p = '' THEN 'HOME 60' WHEN regexp_matches('/' || p, '{web.JUNK}') THEN 'OTHER 0' {" ".join(arms)} ELSE 'OTHER 20' END AS c FROM y)
      SELECT page_id, split_part(c, ' ', 1) AS page_type, CAST(split_part(c, ' ', 2) AS INTEGER) AS priority FROM z"""


@query("url_classify", _class_sql())
def url_classify(spark, sf_dir):
    """Page paths, with language folders put as sections so that several classes occur."""
    path = F.regexp_replace(F.lower(web.path_of(F.col("url"))), "^/+|/+$", "")
    url = F.concat(F.lit("https://x/"), F.replace(F.replace(path, F.lit("en/"), F.lit("om-oss/")), F.lit("de/"), F.lit("produkter")))
    return read(spark, sf_dir, "pages").select("page_id", web.classify_url(url).alias("c")).select("page_id", "c.page_type", "c.priority")


@query(
    "source_families",
    """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN CASE WHEN page_id % 8 = 0 THEN 'leadership' WHEN page_id % 3 = 0 THEN 'locations' ELSE 'identity' END
                            WHEN page_id % 4 = 1 THEN 'financials' WHEN page_id % 4 = 2 THEN 'website' ELSE 'other' END AS family FROM pages""",
)
def source_families(spark, sf_dir):
    k = F.col("page_id")
    kind = F.when(k % 4 == 0, "registry").when(k % 4 == 1, "registry_accounts").when(k % 4 == 2, "company_website").otherwise("news")
    url = F.concat(F.lit("https://reg.example/enheter/"), k.cast("string"), F.when(k % 8 == 0, "/roller/").when(k % 3 == 0, "/underenheter?page=1").otherwise(""))
    return read(spark, sf_dir, "pages").select("page_id", web.source_family(kind, url).alias("family"))


@query("page_titles", r"""SELECT page_id, left(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), 120) AS title FROM pages""")
def page_titles(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", web.page_title(F.col("html")).alias("title"))


@query(
    "link_extract",
    r"""WITH l AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1), lambda h: trim(h)), lambda h: h <> '' AND NOT regexp_matches(h, '(?i)^(#|mailto:|tel:|javascript:)')) AS h FROM pages),
        u AS (SELECT page_id, unnest(h) AS link, unnest(range(1, len(h) + 1)) AS pos FROM l), d AS (SELECT page_id, link, min(pos) AS pos FROM u GROUP BY 1, 2)
        SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS position FROM d""",
)
def link_extract(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", F.posexplode(web.links(F.col("html"))).alias("p", "link"))
    return rows.select("page_id", "link", (F.col("p") + 1).cast("long").alias("position"))


@query(
    "contact_extract",
    r"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '[\w.+-]+@[\w-]+\.[\w.-]+')[1:3] AS e FROM documents) SELECT doc_id, array_to_string(e, ' ') AS emails FROM m WHERE len(e) > 0""",
)
def contact_extract(spark, sf_dir):
    found = read(spark, sf_dir, "documents").select("doc_id", F.array_join(web.contacts(F.col("text"))["emails"], " ").alias("emails"))
    return found.filter("emails <> ''")


@query("json_pointer_lookup", "SELECT event_id, CAST(props::JSON->>'k' AS VARCHAR) AS k FROM events")
def json_pointer_lookup(spark, sf_dir):
    token = json_tokens.at_pointer(F.col("t"), "/k")
    return read(spark, sf_dir, "events").select("event_id", json_tokens.json_tokens("props").alias("t")).select("event_id", token["value"].alias("k"))


@query(
    "claim_ids",
    """SELECT o_orderkey, 'claim_v1_' || sha256('["' || o_custkey || '","' || o_orderpriority || '",' || CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '"' || o_orderstatus || '"' END || ']') AS claim_id FROM orders""",
)
def claim_ids(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return read(spark, sf_dir, "orders").select("o_orderkey", json_tokens.claim_id(F.col("o_custkey"), F.col("o_orderpriority"), status).alias("claim_id"))


@query(
    "canonical_amount",
    r"""SELECT o_orderkey, regexp_replace(regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '(\.[0-9]*?)0+$', '\1'), '\.$', '') AS amount FROM orders""",
)
def canonical_amount(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", numbers.canonical_decimal(F.col("o_totalprice").cast("decimal(18,2)")).alias("amount"))


@query(
    "localised_numbers",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN '-' ELSE '' END || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount FROM orders""",
)
def localised_numbers(spark, sf_dir):
    """Amounts printed in four conventions and read back."""
    us = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    k = F.col("o_orderkey") % 4
    printed = F.when(k == 0, us).when(k == 1, F.translate(us, ".,", ",.")).when(k == 2, F.translate(us, ".,", ", ")).otherwise(F.concat(F.lit("("), F.translate(us, ",", ""), F.lit(")")))
    return read(spark, sf_dir, "orders").select("o_orderkey", numbers.parse_localised(printed).alias("amount"))


@query(
    "quoted_numbers",
    """WITH o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders)
       SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN true WHEN 1 THEN v = v + 1 WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN v = 0 WHEN 5 THEN true WHEN 6 THEN false ELSE v = 0 END AS quoted FROM o""",
)
def quoted_numbers(spark, sf_dir):
    """Eight ways in which a text holds a price or doesn't: grouped, another, beyond 38 digits, inside a longer number, in brackets, negative in brackets, before a letter, none."""
    c = F.col
    price = c("o_totalprice").cast("decimal(18,2)")
    k, long = c("o_orderkey") % 8, F.concat(F.lit("9" * 40), price.cast("string"))
    shown = lambda x: F.translate(F.format_number(x, 2), ",", " ")
    said = F.when(k == 0, F.concat(F.lit("In 2024 the total was "), shown(price), F.lit(" NOK."))).when(k == 1, F.concat(F.lit("total "), shown(price + 1), F.lit(" NOK"))).when(k == 2, F.concat(F.lit("sum "), long))
    said = said.when(k == 3, F.concat(F.lit("sum x"), price.cast("string"))).when(k.isin(4, 5), F.concat(F.lit("sum ("), price.cast("string"), F.lit(") NOK"))).when(k == 6, F.concat(price.cast("string"), F.lit("kr"))).otherwise("none")
    value = F.when(k == 2, long).when(k == 5, (-price).cast("string")).otherwise(price.cast("string"))
    return read(spark, sf_dir, "orders").select("o_orderkey", numbers.quoted_number(value, said).alias("quoted"))
