"""Registry documents, sources, pages and bundles, made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import net, web
from attesta.functions.names import host_of
from attesta.functions.text import guessed_name
from attesta.operators import jsonld, matching, publication, registry_scans, support
from attesta.plans.registry import epoch_us, query, read
from attesta.plans.support_queries import ORGS
from attesta.sources import readers, sinks

c = F.col
quoted = support.quoted


def _bodies(spark, sf_dir):
    """Entity documents: most sound, some of another organisation or without a name."""
    k = c("c_custkey")
    org = F.element_at(F.array(*map(F.lit, ORGS)), (k % 5 + 1).cast("int"))
    body = F.concat(
        F.lit('{"organisasjonsnummer":'), F.when(k % 9 == 1, '"1"').otherwise(quoted(org)), F.lit(',"navn":'), F.when(k % 9 == 2, '" "').otherwise(quoted(c("c_name"))), F.lit(',"konkurs":'), F.when(k % 4 == 1, "true").otherwise("false"), F.lit(',"underAvvikling":'),
        F.when(k % 4 == 2, "null").otherwise("false"), F.lit(',"underTvangsavviklingEllerTvangsopplosning":false'), F.when(k % 4 == 3, ',"slettedato":"2024-01-01"').otherwise(""), F.lit(',"antallAnsatte":'), (k % 50).cast("string"), F.lit(',"hjemmeside":"X'), k.cast("string"),
        F.lit('.NO/a#b","forretningsadresse":{"adresse":["Gata '), k.cast("string"), F.lit('","B"],"postnummer":"0001","poststed":"OSLO"},"postadresse":{"kommune":"BERGEN"},"kapital":{"belop":'), F.floor("c_acctbal").cast("string"),
        F.lit(',"valuta":"NOK","innfortDato":"2020-02-02"},"registreringsdatoForetaksregisteret":"2019-01-01"}'),
    )
    return read(spark, sf_dir, "customer").select("c_custkey", org.alias("org"), body.alias("body"))


@query(
    "registry_entities",
    """SELECT c_custkey, CASE c_custkey % 9 WHEN 1 THEN 'id differs' WHEN 2 THEN 'no name' ELSE 'ok' END AS state, CASE c_custkey % 4 WHEN 3 THEN 'deleted' WHEN 1 THEN 'bankrupt' WHEN 2 THEN 'unknown' ELSE 'active' END AS status,
              'Gata ' || c_custkey || ' B 0001 OSLO' AS registered_address, 'BERGEN' AS municipality, 'https://x' || c_custkey || '.no/a' AS website, c_custkey % 50 AS employee_count FROM customer""",
)
def registry_entities(spark, sf_dir):
    rows = readers.parse_entities(_bodies(spark, sf_dir), "org", "body", keep=["c_custkey"])
    return rows.select("c_custkey", "state", "status", "registered_address", "municipality", "website", "employee_count")


@query(
    "registry_roles",
    """SELECT c_custkey, code AS role_code, name, row_number() OVER (PARTITION BY c_custkey ORDER BY p) AS position FROM (
         SELECT c_custkey, 'LEDE' AS code, 'Kari ' || c_custkey || ' Hansen' AS name, 1 AS p FROM customer UNION ALL SELECT c_custkey, 'MEDL', 'Ola Berg', 2 FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'REVI', 'Revisor AS', 3 FROM customer)""",
)
def registry_roles(spark, sf_dir):
    """A holder twice, one who has left, one without a name, and an organisation."""
    k = c("c_custkey").cast("string")
    lead = F.concat(F.lit('{"type":{"kode":"LEDE"},"avregistrert":false,"person":{"navn":{"fornavn":"Kari","mellomnavn":"'), k, F.lit('","etternavn":"Hansen"}}}'))
    member = F.concat(F.lit('{"type":{"kode":"MEDL"},"avregistrert":'), F.when(c("c_custkey") % 2 == 0, "false").otherwise("true"), F.lit(',"person":{"navn":{"fornavn":"Ola","etternavn":"Berg"}}}'))
    body = F.concat(F.lit('{"rollegrupper":[{"roller":['), lead, F.lit(","), lead, F.lit(',{"type":{"kode":"MEDL"}}]},{"roller":['), member, F.lit(',{"type":{"kode":"REVI"},"enhet":{"navn":["Revisor AS"]}}]}]}'))
    return readers.parse_roles(read(spark, sf_dir, "customer").select("c_custkey", body.alias("body")), "c_custkey", "body").select("c_custkey", "role_code", "name", c("position").cast("long").alias("position"))


PARENT, CHILDREN = "971277025", ["974760673", "982463718", "923609016"]


def _pages(spark, sf_dir):
    """Two pages a customer: three records, then none or a repeated one; every fifth has another total, every seventh a record of another parent."""
    k = c("c_custkey")
    unit = lambda i, parent=F.lit(PARENT): F.concat(F.lit('{"organisasjonsnummer":"%s","overordnetEnhet":' % CHILDREN[i]), quoted(parent), F.lit(',"navn":"U%d"}' % i))
    pages = read(spark, sf_dir, "customer").select("c_custkey", F.lit(PARENT).alias("org"), F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    total = F.when(k % 5 == 0, "9").when(k % 3 == 0, "4").otherwise("3")
    first = F.concat(unit(0), F.lit(","), unit(1, F.when(k % 7 == 0, "958973306").otherwise(PARENT)), F.lit(","), unit(2))
    second = F.when(k % 3 == 0, unit(0)).otherwise("")
    body = F.concat(F.lit('{"_embedded":{"underenheter":['), F.when(c("n") == 0, first).otherwise(second), F.lit(']},"page":{"number":'), c("n").cast("string"), F.lit(',"size":3,"totalElements":'), total, F.lit(',"totalPages":'), F.when(k % 3 == 0, "2").otherwise("1"), F.lit("}}"))
    return pages.filter((c("n") == 0) | (k % 3 == 0)).select("c_custkey", "org", c("n").alias("number"), F.lit("success").alias("access_status"), F.lit(200).alias("http_status"), F.lit(None).cast("string").alias("error_detail"), body.alias("body"))


@query(
    "registry_subunits",
    """WITH made AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 9 WHEN c_custkey % 3 = 0 THEN 4 ELSE 3 END AS elements, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS total FROM customer),
         page AS (SELECT k, n, elements, total, 3 AS size, CASE n WHEN 0 THEN 3 ELSE 1 END AS units FROM made, range(0, 2) AS p(n) WHERE n < total),
         judged AS (SELECT *, (elements + size - 1) // size <> total AS broken FROM page),
         walked AS (SELECT *, coalesce(bool_or(broken) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM judged),
         unit AS (SELECT k, n, i, CASE WHEN n = 1 THEN 0 ELSE i END AS item, k % 7 = 0 AND n = 0 AND i = 1 AS foreign_ FROM walked, range(0, 3) AS u(i) WHERE NOT ended AND i < units),
         kept AS (SELECT *, row_number() OVER (PARTITION BY k, item, foreign_ ORDER BY n, i) > 1 AS again FROM unit),
         counts AS (SELECT k, count(*) FILTER (NOT foreign_ AND NOT again) AS supported, count(*) FILTER (foreign_ OR again) AS refused FROM kept GROUP BY k),
         ends AS (SELECT k, count(*) AS pages, sum(units) AS rows, any_value(elements) AS elements, bool_or(broken) AS broken FROM walked WHERE NOT ended GROUP BY k)
       SELECT k AS c_custkey, pages, CAST(rows AS BIGINT) AS rows, supported, refused, CASE WHEN broken THEN 'failed' WHEN rows <> elements OR refused > 0 THEN 'ambiguous' ELSE 'available' END AS state,
              CASE WHEN broken THEN 'Subunit page counts are inconsistent.' WHEN rows <> elements OR refused > 0 THEN 'Subunit collection incomplete or rejected records.' ELSE 'All reported subunit pages traversed and parent mappings validated.' END AS reason,
              CASE WHEN NOT broken AND rows = elements AND refused = 0 THEN 'complete' ELSE 'partial' END AS completeness FROM ends JOIN counts USING (k)""",
)
def registry_subunits(spark, sf_dir):
    """The walk over collections' pages: what is supported and refused, and how each collection ends."""
    collections = registry_scans.subunits(_pages(spark, sf_dir), "c_custkey", "org", page_size=3)[2]
    return collections.withColumnRenamed("found", "supported")


@query(
    "activity_events",
    """SELECT c_custkey, 'status_event' AS field, 'bankruptcy_filing' AS detail, NULL AS date FROM customer WHERE c_custkey % 4 = 1 UNION ALL SELECT c_custkey, 'status_event', 'deleted', '2024-01-01' FROM customer WHERE c_custkey % 4 = 3
       UNION ALL SELECT c_custkey, 'employee_registration', CAST(c_custkey % 50 AS VARCHAR), NULL FROM customer UNION ALL SELECT c_custkey, 'capital', CAST(floor(c_acctbal) AS BIGINT) || ' NOK', '2020-02-02' FROM customer
       UNION ALL SELECT c_custkey, 'registration', 'Foretaksregisteret', '2019-01-01' FROM customer""",
)
def activity_events(spark, sf_dir):
    k = c("c_custkey")
    rows = _bodies(spark, sf_dir).select("c_custkey", "body", F.lit(False).alias("under_liquidation"), (k % 4 == 1).alias("bankrupt"), F.when(k % 4 == 3, "2024-01-01").alias("deleted_date"), (k % 50).alias("employee_count"))
    return registry_scans.activity_events(rows, "c_custkey", "body")


@query("job_board", "SELECT c_custkey, 'blocked' AS access_status FROM customer")
def job_board(spark, sf_dir):
    return registry_scans.job_board(read(spark, sf_dir, "customer"), "c_custkey", "https://jobs.example/feed").select("c_custkey", "access_status")


@query(
    "replayed_captures",
    """SELECT doc_id AS source_id, CASE WHEN doc_id % 6 > 0 AND text IS NOT NULL THEN 200 END AS status, CASE WHEN doc_id % 6 = 0 THEN 'snapshot integrity failure' END AS error FROM documents WHERE text IS NOT NULL""",
)
def replayed_captures(spark, sf_dir):
    """Responses from stored bytes; a sixth has another length than was stated."""
    docs = read(spark, sf_dir, "documents").filter("text IS NOT NULL").withColumn("content", F.encode("text", "UTF-8"))
    captures = docs.select(c("doc_id").alias("source_id"), F.sha2("content", 256).alias("content_hash"), (F.octet_length("content") + F.when(c("doc_id") % 6 == 0, 1).otherwise(0)).alias("byte_count"), F.lit(support.BODY).alias("snapshot_representation"), F.lit(200).alias("http_status"), F.lit("text/plain").alias("content_type"))
    rows = registry_scans.replayed(captures, sinks.new_blobs(docs, None))
    return rows.select("source_id", "status", "error")


@query(
    "run_lookups",
    """SELECT 'run' AS what, count(*) AS n FROM orders WHERE o_orderkey = 7 UNION ALL SELECT 'facts', count(*) FROM events WHERE user_id = 3 AND event_type IN ('click', 'error') UNION ALL SELECT 'evidence', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 5
       UNION ALL SELECT 'results', count(*) FROM orders WHERE o_custkey = 5""",
)
def run_lookups(spark, sf_dir):
    """Lookups by key: filters that reach the scan."""
    t = lambda n: read(spark, sf_dir, n)
    orders = t("orders")
    parts = {
        "run": orders.filter("o_orderkey = 7"), "facts": t("events").filter("user_id = 3 AND event_type IN ('click', 'error')"),
        "evidence": t("lineitem").join(orders.filter("o_custkey = 5"), c("l_orderkey") == c("o_orderkey"), "left_semi"), "results": orders.filter("o_custkey = 5"),
    }
    counts = [df.agg(F.lit(name).alias("what"), F.count("*").alias("n")) for name, df in parts.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query(
    "homepage_attachment",
    """SELECT c_custkey, c_custkey % 6 IN (1, 2) AS attached, CASE c_custkey % 6 WHEN 0 THEN 'candidate carries foreign organisation number' WHEN 1 THEN 'labelled organisation number identifies document subject' WHEN 2 THEN 'full legal name and registered address present on page'
              ELSE 'legal attachment ambiguous: identifier or full legal name/address required' END AS reason FROM customer""",
)
def homepage_attachment(spark, sf_dir):
    k = c("c_custkey") % 6
    page = F.when(k == 1, "Org.nr. 971 277 025").when(k == 2, F.concat(F.lit("This is "), F.upper("c_name"), F.lit(",\n at Gata  1 OSLO"))).when(k == 3, F.concat(c("c_name"), F.lit("s, Gata 1 Oslo"))).when(k == 4, c("c_name")).otherwise("Gata 1 Oslo")
    state = registry_scans.attached(page, F.lit("971277025"), c("c_name"), F.lit("Gata 1 Oslo"), F.when(k == 0, "candidate carries foreign organisation number"))
    return read(spark, sf_dir, "customer").select("c_custkey", state["attached"].alias("attached"), state["reason"].alias("reason"))


@query(
    "suffix_domains",
    """WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM pages), s AS (SELECT *, string_split(host, '.') AS l FROM h),
            t AS (SELECT *, CASE WHEN ends_with(host, 'example.net') THEN 3 WHEN ends_with(host, '.free-bets.example.com') OR host = 'free-bets.example.com' THEN 3 WHEN ends_with(host, '.example.com') THEN 4 ELSE 2 END AS take FROM s)
       SELECT page_id, CASE WHEN len(l) >= take THEN array_to_string(l[len(l) - take + 1:], '.') END AS domain FROM t""",
)
def suffix_domains(spark, sf_dir):
    """A plain suffix, one for any label, and an exception."""
    rules = spark.createDataFrame([("com",), ("net",), ("org",), ("example.net",), ("*.example.com",), ("!free-bets.example.com",)], "suffix string")
    hosts = read(spark, sf_dir, "pages").select("page_id", host_of(c("url")).alias("host"))
    return registry_scans.registrable(hosts, "host", rules).select("page_id", "domain")


@query(
    "starter_claims",
    """SELECT 'c' || event_id AS id, CASE WHEN event_type = 'click' THEN 'website' ELSE 'name' END AS canonical_field, CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'registered_website' WHEN event_type = 'click' THEN 'website' ELSE 'name' END AS field, 'available' AS availability, value AS confidence, CAST(user_id AS VARCHAR) AS evidence FROM events""",
)
def starter_claims(spark, sf_dir):
    facts = read(spark, sf_dir, "events").select(F.concat(F.lit("c"), c("event_id").cast("string")).alias("claim_id"), F.when(c("event_type") == "click", "website").otherwise("name").alias("field"), F.when(c("event_id") % 2 == 0, "identity").otherwise("jobs").alias("category"), c("value").alias("fact_confidence"), c("user_id").cast("string").alias("evidence_id"))
    return registry_scans.starter_claims(facts).withColumn("evidence", F.array_join("evidence_ids", ",")).drop("evidence_ids")


@query(
    "projection_differences",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 THEN 'missing' ELSE 'differs' END AS problem FROM orders WHERE o_orderkey % 10 = 1 OR (o_orderkey % 10 = 2 AND o_orderstatus <> 'X') UNION ALL SELECT -1, 'extra'""",
)
def projection_differences(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    shown = rows.filter("o_orderkey % 10 <> 1").withColumn("o_orderstatus", F.when(c("o_orderkey") % 10 == 2, "X").otherwise(c("o_orderstatus")))
    extra = spark.createDataFrame([(-1, "X", 0)], "o_orderkey long, o_orderstatus string, o_custkey long")
    return registry_scans.projection_differences(rows, shown.unionByName(extra), "o_orderkey")


@query(
    "bundle_problems",
    """WITH i AS (SELECT DISTINCT c_custkey AS k FROM customer), r AS (SELECT o_custkey AS k, o_orderstatus FROM orders), u AS (SELECT DISTINCT l_partkey AS h FROM lineitem), m AS (SELECT p_partkey AS h FROM part WHERE p_partkey % 10 > 0 UNION ALL SELECT -5)
       SELECT 'input without result' AS problem, count(*) AS n FROM i WHERE k NOT IN (SELECT k FROM r) UNION ALL SELECT 'result without input', count(*) FROM (SELECT DISTINCT k FROM r) WHERE k NOT IN (SELECT k FROM i) UNION ALL SELECT 'result twice', count(*) FROM (SELECT k FROM r GROUP BY 1 HAVING count(*) > 1)
       UNION ALL SELECT 'result of another run', count(*) FROM r WHERE o_orderstatus = 'P' UNION ALL SELECT 'capture missing', count(*) FROM u WHERE h NOT IN (SELECT h FROM m) UNION ALL SELECT 'unexpected member', count(*) FROM m WHERE h NOT IN (SELECT h FROM u)""",
)
def bundle_problems(spark, sf_dir):
    t = lambda n: read(spark, sf_dir, n)
    results = t("orders").select(c("o_custkey").alias("k"), (c("o_orderstatus") != "P").alias("run_ok"))
    members = t("part").filter("p_partkey % 10 > 0").select(c("p_partkey").alias("content_hash")).unionByName(spark.createDataFrame([(-5,)], "content_hash long"))
    return registry_scans.bundle_problems(t("customer").select(c("c_custkey").alias("k")), results, t("lineitem").select(c("l_partkey").alias("content_hash")), members, "k")


@query(
    "concurrent_requests",
    """WITH e AS (SELECT user_id, epoch_us(ts) AS t, 1 AS s FROM events UNION ALL SELECT user_id, epoch_us(ts) + 7200000000, -1 FROM events), r AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY t, s ROWS UNBOUNDED PRECEDING) AS n FROM e)
       SELECT user_id, CAST(max(n) AS BIGINT) AS most_at_once, max(n) <= 2 AS kept FROM r GROUP BY 1""",
)
def concurrent_requests(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", epoch_us(c("ts")).alias("us"), F.lit(7_200_000_000).cast("long").alias("took"))
    return registry_scans.concurrency(events, "user_id", "us", "took", 2)


@query(
    "pointer_results",
    """SELECT event_id, CASE event_id % 7 WHEN 0 THEN CAST(props::JSON->>'k' AS VARCHAR) WHEN 1 THEN '[1,{"k":' || CAST(props::JSON->>'k' AS VARCHAR) || '}]' WHEN 2 THEN '! JSON pointer not found' WHEN 3 THEN '! JSON pointer traverses a scalar' WHEN 4 THEN '! invalid JSON array index' WHEN 5 THEN '! invalid JSON pointer escape' ELSE '! JSON pointer must start with /' END AS result FROM events""",
)
def pointer_results(spark, sf_dir):
    """Scalars, containers and every way in which a pointer leads nowhere."""
    pointer = F.element_at(F.array(*map(F.lit, ("/a/1/k", "/a", "/a/2", "/a/0/x", "/a/01", "/a~2", "a"))), (c("event_id") % 7 + 1).cast("int"))
    body = F.concat(F.lit('{"a":[1,'), c("props"), F.lit("]}"))
    return read(spark, sf_dir, "events").select("event_id", registry_scans.pointer_result(body, pointer).alias("result"))


@query(
    "jsonld_descriptions",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 < 2 THEN '/description We sell ' || c_mktsegment WHEN c_custkey % 5 = 2 THEN '! exact legal name not established' WHEN c_custkey % 5 = 3 THEN '! VAT subject differs or is invalid' ELSE '! unsupported root literal context' END AS found FROM customer""",
)
def jsonld_descriptions(spark, sf_dir):
    k = c("c_custkey") % 5
    node = F.concat(
        F.lit('{"@context":"'), F.when(k == 4, "https://other.example").otherwise("https://schema.org"), F.lit('","@type":["Organization"],"name":'), F.when(k == 2, '"Other"').otherwise(quoted(F.upper("c_name"))), F.lit(',"taxID":"NO '), F.when(k == 3, "982463718").otherwise("971277025"),
        F.lit('","description":'), quoted(F.concat(F.lit("We sell "), c("c_mktsegment"))), F.lit("}"),
    )
    html = F.concat(F.lit('<html><script type="application/ld+json">'), node, F.lit("</script></html>"))
    rows = jsonld.descriptions(read(spark, sf_dir, "customer"), "c_custkey", html, c("c_name"), F.lit("971277025"))
    return rows.select("c_custkey", F.when(c("reason").isNull(), F.concat_ws(" ", "pointer", "text")).otherwise(F.concat(F.lit("! "), c("reason"))).alias("found"))


@query(
    "published_or_refused",
    """SELECT verdict, published, count(*) AS n FROM (SELECT CASE c_custkey % 4 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'LIKELY' WHEN 2 THEN 'AMBIGUOUS' ELSE 'REJECTED' END AS verdict, c_custkey % 4 < 2 AS published FROM customer) GROUP BY ALL""",
)
def published_or_refused(spark, sf_dir):
    verdict = F.element_at(F.array(*map(F.lit, ("VERIFIED", "LIKELY", "AMBIGUOUS", "REJECTED"))), (c("c_custkey") % 4 + 1).cast("int"))
    good, bad = matching.firewall(read(spark, sf_dir, "customer").select("c_custkey", verdict.alias("verdict")))
    return good.withColumn("published", F.lit(True)).unionByName(bad.drop("reason").withColumn("published", F.lit(False))).groupBy("verdict", "published").agg(F.count("*").alias("n"))


@query(
    "contact_details",
    r"""SELECT c_custkey, '22 33 44 5' || c_custkey % 10 AS phones, 'Storgata ' || c_custkey AS addresses, 'a' || c_custkey || '@b.no' AS emails FROM customer WHERE c_custkey % 3 > 0""",
)
def contact_details(spark, sf_dir):
    k = c("c_custkey")
    said = F.when(k % 3 > 0, F.concat(F.lit("Ring 22 33 44 5"), (k % 10).cast("string"), F.lit(" eller a"), k.cast("string"), F.lit("@b.no, Storgata "), k.cast("string"), F.lit("."))).otherwise("nothing here")
    rows = read(spark, sf_dir, "customer").select("c_custkey", web.contacts(said).alias("x")).filter("x IS NOT NULL")
    return rows.select("c_custkey", *(F.array_join(c("x")[n], "|").alias(n) for n in ("phones", "addresses", "emails")))


@query(
    "guessed_names",
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN 'Fjord Kraft' ELSE 'plain words only' END AS name FROM customer""",
)
def guessed_names(spark, sf_dir):
    k = c("c_custkey") % 3
    said = F.when(k == 0, F.concat(F.lit("about "), F.lower("c_name"), F.lit(" AS"))).when(k == 1, "Velkommen til Fjord Kraft AS i dag").otherwise("plain words only")
    target = F.when(k == 0, c("c_name")).otherwise("Zzz")
    return read(spark, sf_dir, "customer").select("c_custkey", F.regexp_replace(guessed_name(said, target), "^Velkommen til ", "").alias("name"))


@query(
    "new_blobs",
    """SELECT sha256(text) AS content_hash, CAST(octet_length(encode(any_value(text))) AS BIGINT) AS byte_count FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 4 = 0 AND text IS NOT NULL) GROUP BY 1""",
)
def new_blobs(spark, sf_dir):
    """Bytes that aren't stored yet, each once; a quarter is."""
    docs = read(spark, sf_dir, "documents").filter("text IS NOT NULL").withColumn("content", F.encode("text", "UTF-8"))
    return sinks.new_blobs(docs, sinks.new_blobs(docs.filter("doc_id % 4 = 0"), None)).select("content_hash", "byte_count")


@query("new_envelopes", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 > 0")
def new_envelopes(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return sinks.new_rows(rows, rows.filter("o_orderkey % 3 = 0"), ["o_orderkey"], "o_orderstatus").select("o_orderkey")


@query(
    "result_ids",
    "SELECT o_orderkey, 'ev_' || left(sha256(o_custkey || '|' || o_orderkey), 16) AS id FROM orders",
)
def result_ids(spark, sf_dir):
    """Ids that follow from what they name, so that a run made again gives them again."""
    return read(spark, sf_dir, "orders").select("o_orderkey", publication.stable_id("ev", c("o_custkey"), c("o_orderkey")).alias("id"))


@query(
    "url_allow_lists",
    """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://www.good.no/a' WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'https://good.no:8443/' ELSE NULL END AS url,
              CASE page_id % 6 WHEN 1 THEN 'host outside allowed domains' WHEN 2 THEN 'URL origin outside source policy' WHEN 4 THEN 'URL scheme outside source policy' WHEN 5 THEN 'address literal' END AS reason FROM pages""",
)
def url_allow_lists(spark, sf_dir):
    """Domains, which stand for their subdomains, schemes, and exact origins with their ports."""
    given = F.element_at(F.array(*map(F.lit, ("HTTPS://www.Good.no/a#x", "https://bad.no/", "https://good.no:444/", "https://good.no:8443", "http://good.no/", "https://0x7f000001/"))), (c("page_id") % 6 + 1).cast("int"))
    u = net.policy(given, domains=["good.no"], schemes=["https"], origins=["https://good.no:8443", "HTTPS://www.good.no:443/", "https://0x7f000001", "https://bad.no"])
    return read(spark, sf_dir, "pages").select("page_id", u.alias("u")).select("page_id", "u.url", "u.reason")


@query(
    "full_citations",
    """SELECT c_custkey AS fact_id, CASE c_custkey % 7 WHEN 1 THEN 'source access_status=blocked' WHEN 2 THEN 'financial currency absent from evidence' WHEN 3 THEN 'financial value absent from evidence' WHEN 4 THEN 'snapshot support: amount value or qualifiers differ from retained statement'
              WHEN 5 THEN 'snapshot support: amount locator differs from retained statement' WHEN 6 THEN 'financial reporting year absent from evidence' ELSE 'ok' END AS reason FROM customer""",
)
def full_citations(spark, sf_dir):
    """The whole chain over amounts: records first, then qualifiers in the evidence's text, then the retained bytes."""
    from attesta.plans.support_queries import amount_tables

    return publication.full_reasons(*amount_tables(spark, sf_dir))
