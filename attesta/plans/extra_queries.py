"""Lookups, top-k, accounts, URL policy and text operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.functions import net, structured_data, text, web
from attesta.functions.names import host_of, registrable_domain
from attesta.operators import accounts, ledger, profile_rules
from attesta.plans.registry import query, read


@query("recent_runs", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def recent_runs(spark, sf_dir):
    """A top-k report: TakeOrderedAndProject."""
    return read(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("F", "P")).orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(50).select("o_orderkey", "o_custkey", "o_orderstatus")


@query(
    "crawl_frontier",
    """WITH h AS (SELECT page_id, regexp_extract(url, '^[^:]*://([^/?#:]*)', 1) AS host, length(url) AS priority FROM pages)
       SELECT host, page_id, n AS position FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY priority DESC, page_id) AS n FROM h) WHERE n <= 8""",
)
def crawl_frontier(spark, sf_dir):
    """Eight pages a host by priority, the earlier first."""
    n = F.row_number().over(Window.partitionBy("host").orderBy(F.length("url").desc(), "page_id"))
    rows = read(spark, sf_dir, "pages").select("page_id", "url", host_of(F.col("url")).alias("host")).withColumn("position", n.cast("long"))
    return rows.filter("position <= 8").select("host", "page_id", "position")


@query(
    "first_roles",
    "SELECT conv_id, role, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS n FROM conversations) WHERE n = 1",
)
def first_roles(spark, sf_dir):
    return ledger.first_by(read(spark, sf_dir, "conversations"), ["conv_id", "role"], F.col("turn").asc(), F.col("text").asc()).select("conv_id", "role", "turn")


@query(
    "latest_accounts",
    """WITH m AS (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC) AS n FROM orders)
       SELECT o_custkey, count(*) AS records, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) ELSE 'ambiguous' END AS state FROM m WHERE n = 1 GROUP BY 1""",
)
def latest_accounts(spark, sf_dir):
    last = F.rank().over(Window.partitionBy("o_custkey").orderBy(F.to_date("o_orderdate").desc()))
    rows = read(spark, sf_dir, "orders").withColumn("n", last).filter("n = 1")
    return rows.groupBy("o_custkey").agg(F.count("*").alias("records"), F.when(F.count_distinct("o_orderstatus") == 1, F.min("o_orderstatus")).otherwise("ambiguous").alias("state"))


@query(
    "url_policy",
    """SELECT page_id, CASE WHEN page_id % 5 > 1 THEN regexp_replace(regexp_replace(url, '#.*$', ''), '^([^?]*//[^/?]*)([?]|$)', '\\1\\2') END AS url,
              CASE page_id % 5 WHEN 0 THEN 'unsupported scheme' WHEN 1 THEN 'credentials in URL' END AS reason FROM pages""",
)
def url_policy(spark, sf_dir):
    k, url = F.col("page_id") % 5, F.col("url")
    given = F.when(k == 1, F.regexp_replace(url, "://", "://me:pw@")).when(k == 2, F.regexp_replace(F.regexp_replace(url, "^(http)://([^/]*)", "$1://$2:80"), "^(https)://([^/]*)", "$1://$2:443")).otherwise(url)
    given = F.when(k == 0, F.concat(F.lit("ftp:"), F.regexp_extract(url, "^[^:]*:(.*)$", 1))).otherwise(given)
    return read(spark, sf_dir, "pages").select("page_id", net.normalized_url(given).alias("u")).select("page_id", "u.url", "u.reason")


@query("unsafe_addresses", "SELECT c_custkey, c_custkey % 6 <> 0 AS unsafe FROM customer")
def unsafe_addresses(spark, sf_dir):
    k = F.col("c_custkey")
    low = (k % 200 + 1).cast("string")
    ip = F.when(k % 6 == 0, F.concat(F.lit("8.8.4."), low)).when(k % 6 == 1, F.concat(F.lit("10.0.0."), low)).when(k % 6 == 2, F.concat(F.lit("100.64.1."), low)).when(k % 6 == 3, F.concat(F.lit("::ffff:127.0.0."), low)).when(k % 6 == 4, "fe80::1").otherwise("not an address")
    return read(spark, sf_dir, "customer").select("c_custkey", net.is_unsafe_address(ip).alias("unsafe"))


@query(
    "subject_ids",
    """WITH k AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '971277025' ELSE '' END AS found FROM customer) SELECT * FROM k""",
)
def subject_ids(spark, sf_dir):
    k = F.col("c_custkey") % 3
    said = F.when(k == 0, "Org.nr: 971 277 025. Our customer has org nr 982463718").when(k == 1, "Supplier VAT NO 971277025 only").otherwise("call 971277025, org.nr 123456789")
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(text.subject_ids(said), ",").alias("found"))


@query(
    "candidate_urls",
    """WITH n AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)
       SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'https://www.' || w[1] || '.no/' ELSE 'https://reg.example/' || p_partkey || '/' END || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ',https://www.' || w[1] || '.no' END || ',https://www.' || w[1] || '.com'
         || CASE WHEN len(w) = 1 THEN '' ELSE ',https://www.' || w[1] || '-' || w[2] || '.no,https://www.' || w[1] || '-' || w[2] || '.com' END AS urls FROM n""",
)
def candidate_urls(spark, sf_dir):
    first = F.concat(F.lit("https://www."), F.substring_index("p_name", " ", 1), F.lit(".no/"))
    site = F.when(F.col("p_partkey") % 3 == 0, first).otherwise(F.concat(F.lit("https://reg.example/"), F.col("p_partkey").cast("string"), F.lit("/")))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(text.candidate_urls(F.col("p_name"), site), ",").alias("urls"))


@query(
    "figure_lines",
    """WITH o AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS v FROM orders)
       SELECT o_orderkey, 1 AS line, 'revenue' AS field, v AS value FROM o
       UNION ALL SELECT o_orderkey, 3, 'total_assets', NULL FROM o UNION ALL SELECT o_orderkey, 4, 'equity', NULL FROM o
       UNION ALL SELECT o_orderkey, 5, 'annual_result', '-' || v FROM o UNION ALL SELECT o_orderkey, 6, 'operating_result', NULL FROM o""",
)
def figure_lines(spark, sf_dir):
    """Digits grouped by no-break spaces, columns of two years, brackets, and a line that is too long."""
    us = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    grouped = F.translate(us, ".,", ",\u00a0")
    body = F.concat(
        F.lit("  Sum driftsinntekter: "), grouped, F.lit("\nnothing 5\nSum eiendeler 1 234 og 77\nEgenkapital "), F.translate(us, ",", ""), F.lit(" 200\n\u00c5rsresultat ("), F.translate(us, ".,", ", "),
        F.lit(")\nDriftsresultat "), F.translate(us, ",", ""), F.lit(" and 5 more\nSum gjeld 7 " + "x" * 300),
    )
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.explode(text.figure_lines(body)).alias("f"))
    return rows.select("o_orderkey", "f.line", "f.field", "f.value")


def _bodies(spark, sf_dir):
    """Account documents made of orders: a list a customer, one record an order, a year each."""
    c = F.col
    org = F.when(c("o_orderkey") % 20 == 0, "982463718").otherwise("971277025")
    number = F.format_string("%s.%s0", F.floor("o_totalprice").cast("string"), (c("o_orderkey") % 10).cast("string"))
    record = F.concat(
        F.lit('{"id":'), (c("o_orderkey") + 1).cast("string"), F.lit(',"virksomhet":{"organisasjonsnummer":"'), org, F.lit('"},"regnskapstype":"SELSKAP","valuta":"NOK","avviklingsregnskap":'),
        F.when(c("o_orderstatus") == "P", "true").otherwise("false"), F.lit(',"regnskapsperiode":{"fraDato":"'), F.year("o_orderdate").cast("string"), F.lit('-01-01","tilDato":"'), F.year("o_orderdate").cast("string"),
        F.lit('-12-31"},"eiendeler":{"sumEiendeler":'), number, F.lit("}}"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("o_orderkey", record.alias("r"))))
    lists = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["r"]), ","), F.lit("]")).alias("body"))
    return lists.withColumn("org_number", F.lit("971277025"))


@query(
    "account_amounts",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
       g AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n, min(i) AS i, min(o_orderkey) AS k, min(o_orderstatus) AS s, min(CAST(floor(o_totalprice) AS BIGINT)) AS whole FROM r WHERE o_orderkey % 20 <> 0 GROUP BY 1, 2)
       SELECT o_custkey, '/' || i || '/eiendeler/sumEiendeler' AS pointer, whole || CASE WHEN k % 10 = 0 THEN '' ELSE '.' || (k % 10) END AS value, CAST(k + 1 AS VARCHAR) AS record_id, y || '-01-01/' || y || '-12-31' AS period
       FROM g WHERE n = 1 AND s <> 'P'""",
)
def account_amounts(spark, sf_dir):
    rows = accounts.records(_bodies(spark, sf_dir), document="o_custkey")
    return accounts.amounts(rows).select(F.col("document").alias("o_custkey"), "pointer", "value", "record_id", "period")


@query(
    "account_statements",
    "SELECT o_custkey, CAST(o_orderkey + 1 AS VARCHAR) AS record_id, 'NOK' AS currency FROM orders WHERE o_orderkey % 20 <> 0",
)
def account_statements(spark, sf_dir):
    rows = accounts.records(_bodies(spark, sf_dir), document="o_custkey")
    return accounts.statements(rows).select(F.col("document").alias("o_custkey"), "record_id", "currency")


@query(
    "registry_activity",
    """SELECT c_custkey, 'capital' AS kind, CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS detail FROM customer WHERE c_acctbal > 5000
       UNION ALL SELECT c_custkey, 'registration', c_mktsegment FROM customer WHERE c_custkey % 2 = 0""",
)
def registry_activity(spark, sf_dir):
    c, day = F.col, F.lit("2024-01-01")
    events = {"capital": (F.when(c("c_acctbal") > 5000, F.floor("c_acctbal")), day), "registration": (F.when(c("c_custkey") % 2 == 0, c("c_mktsegment")), day)}
    return accounts.activity(read(spark, sf_dir, "customer"), "c_custkey", events).drop("date")


@query(
    "batch_exit_codes",
    """SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 1 WHEN bool_or(o_orderkey % 9 = 0) THEN 2 ELSE 0 END AS code FROM orders GROUP BY 1""",
)
def batch_exit_codes(spark, sf_dir):
    states = F.when(F.col("o_orderstatus") == "P", "failed").otherwise("available")
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(text.exit_code(states, F.col("o_orderkey") % 9 != 0).alias("code"))


@query(
    "display_values",
    """SELECT c_custkey, left(c_name || c_name || c_name, 40) || CASE WHEN length(c_name || c_name || c_name) > 40 THEN '…' ELSE '' END AS name, regexp_replace(CAST(c_custkey * 12345 AS VARCHAR), '([0-9])([0-9]{3})$', '\\1 \\2') AS number,
              CASE c_custkey % 4 WHEN 0 THEN 'verification blocked' WHEN 1 THEN 'no supported observation available' WHEN 2 THEN 'evidence unresolved or conflicting' ELSE 'not verified in this run' END AS phrase FROM customer WHERE c_custkey * 12345 < 1000000
       UNION ALL SELECT c_custkey, left(c_name || c_name || c_name, 40) || CASE WHEN length(c_name || c_name || c_name) > 40 THEN '…' ELSE '' END, regexp_replace(regexp_replace(CAST(c_custkey * 12345 AS VARCHAR), '([0-9])([0-9]{3})$', '\\1 \\2'), '([0-9])([0-9]{3}) ', '\\1 \\2 '),
              CASE c_custkey % 4 WHEN 0 THEN 'verification blocked' WHEN 1 THEN 'no supported observation available' WHEN 2 THEN 'evidence unresolved or conflicting' ELSE 'not verified in this run' END FROM customer WHERE c_custkey * 12345 >= 1000000""",
)
def display_values(spark, sf_dir):
    state = F.element_at(F.array(*map(F.lit, ("blocked", "not_available", "ambiguous", "other"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "customer").select("c_custkey", profile_rules.shortened(F.concat("c_name", "c_name", "c_name")).alias("name"), text.display_number(F.col("c_custkey") * 12345).alias("number"), profile_rules.availability(state).alias("phrase"))


@query(
    "visible_text",
    rf"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>', chr(1), 'g'), '(?s)<!--.*?-->', chr(1), 'g') AS x FROM pages),
         b AS (SELECT page_id, regexp_replace(regexp_replace(x, '(?i)</?(?:br|hr|{"|".join(sorted(structured_data.BLOCKS, key=len, reverse=True))})(?:\s[^>]*)?/?>', chr(2), 'g'), '<[^>]*>', chr(1), 'g') AS x FROM t),
         u AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&') AS x FROM b),
         s AS (SELECT page_id, list_transform(string_split(x, chr(2)), lambda l: array_to_string(list_filter(list_transform(string_split(l, chr(1)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> ''), ' ')) AS l FROM u),
         l AS (SELECT page_id, array_to_string(list_filter(l, lambda s: s <> ''), chr(10)) AS text FROM s)
         SELECT page_id, length(text) AS chars, 0 AS scripts, sha256(text) AS text_sha256 FROM l""",
)
def visible_text(spark, sf_dir):
    """Visible text of every whole page: texts of one block parted by a space, others by a newline; and its JSON-LD scripts."""
    rows = read(spark, sf_dir, "pages").select("page_id", structured_data.page_content("html").alias("c"))
    return rows.select("page_id", F.length("c.text").cast("long").alias("chars"), F.size("c.scripts").alias("scripts"), F.sha2("c.text", 256).alias("text_sha256"))


LINKS_SQL = r"""l AS (SELECT page_id, regexp_extract(url, '^([^:]*://[^/?#]*)', 1) AS site, list_zip(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1), regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS a FROM pages),
     u AS (SELECT page_id, site, trim(replace(x[1], '&amp;', '&')) AS href, trim(regexp_replace(replace(replace(replace(x[2], '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS said, i FROM (SELECT page_id, site, unnest(a) AS x, unnest(range(1, len(a) + 1)) AS i FROM l))"""


@query(
    "job_links",
    f"""WITH {LINKS_SQL}, j AS (SELECT *, site || replace(replace(replace(href, '/th', '/stilling/th'), '/de', '/jobb-de'), '/en', '/x/vacancen') AS url FROM u WHERE (starts_with(href, '/th') OR starts_with(href, '/de') OR starts_with(href, '/en')) AND length(said) BETWEEN 4 AND 120)
        SELECT page_id, url, arg_min(said, i) AS title FROM j GROUP BY 1, 2""",
)
def job_links(spark, sf_dir):
    """Links to job paths; navigation words stand in for job pages, so that there are some."""
    html = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", 'href="/th', 'href="/stilling/th'), 'href="/de', 'href="/jobb-de'), 'href="/en', 'href="/x/vacancen')
    rows = read(spark, sf_dir, "pages").select("page_id", structured_data.anchors(html, "url").alias("a"))
    return rows.select("page_id", F.explode(text.job_links(F.col("a"))).alias("j")).select("page_id", "j.url", "j.title")


@query(
    "page_links",
    f"""WITH {LINKS_SQL}, d AS (SELECT page_id, site || href AS link, min(i) AS i FROM u WHERE href <> '' GROUP BY 1, 2)
        SELECT page_id, link, n AS position FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS n FROM d) WHERE n <= 40""",
)
def page_links(spark, sf_dir):
    """Internal links, resolved against the page."""
    domain = lambda u: registrable_domain(host_of(u))
    rows = read(spark, sf_dir, "pages").select("page_id", "url", structured_data.anchors("html", "url").alias("a"))
    links = text.page_links(F.col("a"), domain(F.col("url")), domain)["internal"]
    return rows.select("page_id", F.posexplode(links).alias("p", "link")).select("page_id", "link", (F.col("p") + 1).cast("long").alias("position"))


@query(
    "page_words",
    r"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script)\b.*?</script>|<style\b.*?</style>|<footer\b.*?(</footer>|$)', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS x FROM pages)
       SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))) AS text_sha256 FROM t""",
)
def page_words(spark, sf_dir):
    """The words of every whole page without scripts, styles and footers."""
    return read(spark, sf_dir, "pages").select("page_id", F.sha2(structured_data.cleaned_text("html"), 256).alias("text_sha256"))


def _names_sql() -> str:
    found = [f"list_transform(regexp_extract_all(x, '(?i){role}{web.ROLE_NAME}', 2), lambda n: {{'name': regexp_replace(trim(n), '[.,;]+$', ''), 'role': '{label}'}})" for role, label in web.ROLES]
    fit = "len(string_split_regex(n.name, '\\s+')) BETWEEN 2 AND 5 AND NOT list_contains(string_split_regex(n.name, '\\s+'), 'og')"
    return f"""WITH d AS (SELECT doc_id, text AS x FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, list_filter(flatten([{", ".join(found)}]), lambda n: {fit})[1:8] AS names FROM d)
        SELECT doc_id, 'Kari Nordmann' AS name, 'CEO' AS role FROM documents UNION ALL SELECT doc_id, r.name, r.role FROM (SELECT doc_id, unnest(names) AS r FROM n)"""


@query("page_names", _names_sql())
def page_names(spark, sf_dir):
    """Names by role in the whole text of every document, beside one planted line; the line takes none of the text's places."""
    found = F.concat(web.role_names(F.lit("CEO: Kari Nordmann\n")), web.role_names(F.col("text")))
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("r")).select("doc_id", "r.name", "r.role")
