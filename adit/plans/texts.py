"""Queries on text, identifiers, indexes, search and training examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from adit.functions import identifiers as ids
from adit.functions import texts as t
from adit.operators import exports as x
from adit.operators import relations as r
from adit.operators import training as tr
from adit.plans.graphs import E
from adit.plans.registry import query
from adit.runtime import table


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_ANY_REJECT = " OR ".join(f"contains(lower(text), '{p}')" for p in t.REJECTED)


@query(f"SELECT doc_id, doc_type FROM documents WHERE text IS NOT NULL AND text <> '' AND NOT ({_ANY_REJECT})")
def reject_filter(spark, d):
    """Texts without any of the phrases of rejected records."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL AND text <> ''")
    return docs.filter(~t.contains_any(F.col("text"), t.REJECTED)).select("doc_id", "doc_type")


_CPE = """concat_ws(':', 'cpe', '2.3', coalesce(cpe_part, '*'), replace(coalesce(normalized_vendor, '*'), ':', ''), replace(coalesce(product, '*'), ':', ''), replace(coalesce(version_text, '*'), ':', ''), coalesce(update_tag, '-'))"""


@query(f"""WITH s AS (SELECT component_id, {_CPE} AS cpe FROM cpe_components), p AS (SELECT component_id, string_split(substr(cpe, 9), ':') AS x FROM s)
 SELECT component_id, CASE x[1] WHEN '-' THEN '' ELSE x[1] END AS part, CASE x[3] WHEN '-' THEN '' ELSE x[3] END AS product, CASE x[4] WHEN '-' THEN '' ELSE x[4] END AS version, coalesce(x[5], '*') AS update_raw,
  CASE WHEN len(x) >= 11 THEN x[11] ELSE '*' END AS other FROM p""")
def id_parse(spark, d):
    """Identifiers built from the components' columns, taken apart again."""
    c = F.col
    given = F.concat_ws(":", F.lit("cpe"), F.lit("2.3"), F.coalesce(c("cpe_part"), F.lit("*")), *[F.replace(F.coalesce(c(n), F.lit("*")), F.lit(":"), F.lit("")) for n in ("normalized_vendor", "product", "version_text")], F.coalesce(c("update_tag"), F.lit("-")))
    rows = table(spark, d, "cpe_components").select("component_id", given.alias("cpe")).withColumn("p", ids.parsed(F.col("cpe")))
    return rows.select("component_id", "p.part", "p.product", "p.version", F.when(F.col("p.update") == "", "-").otherwise(F.col("p.update")).alias("update_raw"), "p.other")


_KIND = r"""CASE WHEN version_text IS NULL OR version_text IN ('', '*') THEN 'unknown' WHEN regexp_matches(version_text, '^(\d+)\.(\d+)') THEN 'semantic' WHEN regexp_matches(version_text, '^\d{4}') THEN 'date_based'
 WHEN regexp_matches(version_text, '^\d+') THEN 'build_number' WHEN regexp_matches(version_text, '^(\d+\.?\d*)\s*-?\s*(alpha|beta|rc|release|final)') THEN 'alpha_beta'
 WHEN regexp_matches(version_text, '^(vista|xp|2000|2003|2008|2012|2016|2019|2022)') THEN 'windows_version' ELSE 'custom' END"""


@query(f"""WITH k AS (SELECT component_id, version_text, {_KIND} AS kind FROM cpe_components)
 SELECT component_id, kind, CASE WHEN kind = 'semantic' THEN coalesce(try_cast(regexp_extract(version_text, '^(\\d+)\\.(\\d+)(?:\\.(\\d+))?', 1) AS BIGINT), 0) END AS major,
  CASE WHEN kind = 'semantic' THEN coalesce(try_cast(regexp_extract(version_text, '^(\\d+)\\.(\\d+)(?:\\.(\\d+))?', 2) AS BIGINT), 0) END AS minor,
  CASE WHEN kind = 'semantic' THEN coalesce(try_cast(regexp_extract(version_text, '^(\\d+)\\.(\\d+)(?:\\.(\\d+))?', 3) AS BIGINT), 0) END AS patch FROM k""")
def version_classify(spark, d):
    v = F.col("version_text")
    return table(spark, d, "cpe_components").select("component_id", ids.version_kind(v).alias("kind"), *[ids.version_number(v, i).alias(n) for i, n in ((1, "major"), (2, "minor"), (3, "patch"))])


def _vendor_sql() -> str:
    spoken = "replace(lower(vendor), '_', ' ')"
    for s in sorted(ids.VENDOR_SUFFIXES, key=len, reverse=True):
        spoken = f"replace({spoken}, ' {s}', '')"
    cases = " ".join(f"WHEN {_sql_list([a.replace('_', ' ') for a in aliases])}.list_contains({spoken}) THEN '{name}'" for name, aliases in ids.VENDOR_ALIASES.items())
    return f"SELECT component_id, CASE WHEN vendor IS NULL OR vendor IN ('', '*') THEN vendor {cases} ELSE replace(lower(vendor), ' ', '_') END AS vendor FROM cpe_components"


@query(_vendor_sql())
def vendor_normalise(spark, d):
    return table(spark, d, "cpe_components").select("component_id", ids.normal_vendor(F.col("vendor")).alias("vendor"))


@query(
    "SELECT component_id, CASE WHEN product IS NULL OR product IN ('', '*') THEN product "
    + " ".join(f"WHEN contains(replace(lower(product), '_', ' '), '{v}') THEN '{n}'" for v, n in ids.PRODUCT_VARIANTS.items())
    + " ELSE replace(lower(product), ' ', '_') END AS product FROM cpe_components"
)
def product_normalise(spark, d):
    return table(spark, d, "cpe_components").select("component_id", ids.normal_product(F.col("product")).alias("product"))


@query("""SELECT component_id, (coalesce(vendor = '*', false) OR coalesce(product = '*', false) OR coalesce(version_text = '*', false)) AS wildcard,
 round(greatest(0.0, 1.0 - CASE WHEN vendor = '*' THEN 0.3 ELSE 0 END - CASE WHEN product = '*' THEN 0.4 ELSE 0 END - CASE WHEN version_text = '*' THEN 0.2 ELSE 0 END
  - CASE WHEN length(vendor) <= 2 AND vendor <> '*' THEN 0.1 ELSE 0 END - CASE WHEN length(product) <= 2 AND product <> '*' THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS confidence FROM cpe_components""")
def confidence_score(spark, d):
    v, p, n = F.col("vendor"), F.col("product"), F.col("version_text")
    return table(spark, d, "cpe_components").select("component_id", ids.is_wildcard(v, p, n).alias("wildcard"), ids.confidence(v, p, n).alias("confidence"))


@query("SELECT product_row, array_to_string(list_transform(regexp_extract_all(product_name, '[A-Za-z]+|[^A-Za-z]+'), lambda x: upper(x[1]) || lower(x[2:])), '') AS title FROM product_nodes")
def title_case(spark, d):
    return table(spark, d, "product_nodes").select("product_row", t.title(F.col("product_name")).alias("title"))


@query(r"SELECT doc_id, x AS cve_id FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, 'CVE-\d{4}-\d+'))) AS x FROM documents)")
def regex_ids(spark, d):
    """Records that a text names."""
    return table(spark, d, "documents").select("doc_id", F.explode(ids.ids_in(F.col("text"))).alias("cve_id"))


@query(r"""SELECT edge_id, CASE WHEN starts_with(upper(c), 'CWE-') THEN upper(c) WHEN regexp_full_match(c, '\d+') THEN 'CWE-' || c WHEN regexp_matches(c, '(?i)cwe[- ]?\d') THEN 'CWE-' || regexp_extract(c, '(?i)cwe[- ]?(\d+)', 1) END AS weakness,
 regexp_extract(c, '\d+', 0) AS number FROM (SELECT edge_id, trim(cwe_id) AS c FROM cve_edges WHERE trim(cwe_id) <> '')""")
def weakness_normalise(spark, d):
    c = F.trim("cwe_id")
    return table(spark, d, "cve_edges").filter(c != "").select("edge_id", ids.weakness_id(c).alias("weakness"), ids.first_number(c).alias("number"))


def _joined_sql(col: str, limit: int | None = None) -> str:
    part = f"list_filter(coalesce({col}, []), lambda x: x IS NOT NULL)"
    part = f"{part}[1:{limit}]" if limit else part
    return f"nullif(array_to_string({part}, ', '), '')"


#: Records with what lookups add: a second score, tactics, advisories, exploits and references.
_ADDED = """doc AS (SELECT cve_id, list_sort(list('A' || doc_id) FILTER (doc_type = 'advisory')) AS advisory_ids, list_sort(list('E' || doc_id) FILTER (doc_type = 'incident')) AS exploit_ids FROM documents WHERE cve_id IS NOT NULL GROUP BY 1),
 c AS (SELECT cves.*, cves.cve_id AS id, advisory_ids, exploit_ids, CASE WHEN ingest_id % 2 = 0 THEN cvss_v3.base_score END AS score2, list_transform(mitre_techniques, lambda x: 'TA' || substr(x, 2, 2)) AS mitre_tactics,
   ['https://a.example/' || cves.cve_id, 'https://b.example/' || ingest_id] AS refs FROM cves LEFT JOIN doc ON cves.cve_id = doc.cve_id)"""


def _added(spark, d):
    docs = table(spark, d, "documents").filter("cve_id IS NOT NULL").groupBy("cve_id").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("doc_type") == kind, F.concat(F.lit(mark), "doc_id")))).alias(name) for kind, mark, name in (("advisory", "A", "advisory_ids"), ("incident", "E", "exploit_ids"))]
    )
    c = F.col
    second = F.when(c("ingest_id") % 2 == 0, F.struct(c("cvss_v3.base_score").alias("base_score"), c("cvss_v3.base_severity").alias("severity"), c("cvss_v3.vector_string").alias("vector_string")))
    tactics = F.transform("mitre_techniques", lambda x: F.concat(F.lit("TA"), F.substring(x, 2, 2)))
    refs = F.array(F.concat(F.lit("https://a.example/"), "cve_id"), F.concat(F.lit("https://b.example/"), "ingest_id"))
    return table(spark, d, "cves").join(docs, "cve_id", "left").withColumns({"id": c("cve_id"), "cvss_v2": second, "mitre_tactics": tactics, "references": refs})


_V3 = "'CVSS v' || coalesce(cvss_v3.cvss_version, '3.x')"


@query(f"""WITH {_ADDED} SELECT ingest_id, md5(concat_ws(chr(10), description,
  CASE WHEN cvss_v3.base_score <> 0 THEN {_V3} || ' Score: ' || cvss_v3.base_score || ' (' || coalesce(cvss_v3.base_severity, 'Unknown') || ')' END,
  CASE WHEN cvss_v3.base_score <> 0 THEN {_V3} || ' Vector: ' || nullif(cvss_v3.vector_string, '') END,
  CASE WHEN score2 <> 0 THEN 'CVSS v2.0 Score: ' || score2 || ' (' || coalesce(cvss_v3.base_severity, 'Unknown') || ')' END, CASE WHEN score2 <> 0 THEN 'CVSS v2.0 Vector: ' || nullif(cvss_v3.vector_string, '') END,
  'Affected Products: ' || {_joined_sql("affected_products", 5)}, 'Related CWEs: ' || {_joined_sql("cwe_refs")}, 'Related CAPECs: ' || {_joined_sql("capec_entries", 3)},
  'MITRE ATT&CK Techniques: ' || {_joined_sql("mitre_techniques", 3)}, 'MITRE ATT&CK Tactics: ' || {_joined_sql("mitre_tactics", 3)},
  CASE WHEN is_in_kev THEN 'WARNING: This vulnerability is in CISA''s Known Exploited Vulnerabilities (KEV) catalog' END,
  'CSAF Advisories: ' || {_joined_sql("advisory_ids", 3)}, 'ExploitDB IDs: ' || {_joined_sql("exploit_ids", 3)}, 'References: ' || {_joined_sql("refs", 3)})) AS content_md5 FROM c WHERE description <> ''""")
def content_builder(spark, d):
    """Lines of a record's content in a fixed order, without empty ones; compared by their MD5."""
    rows = _added(spark, d).filter("description <> ''")
    return rows.select("ingest_id", F.md5(x.content(rows)).alias("content_md5"))


_EMBED = f"""'CVE ID: ' || coalesce(id, ''), 'Title: ' || nullif(title, ''), 'Description: ' || nullif(description, ''), 'Severity: ' || nullif(cvss_v3.base_severity, ''), 'CVSS v3 Score: ' || nullif(cvss_v3.base_score, 0),
  'CVSS v3 Vector: ' || nullif(cvss_v3.vector_string, ''), 'CVSS v2 Score: ' || nullif(score2, 0), CASE WHEN score2 IS NOT NULL OR ingest_id % 2 = 0 THEN 'CVSS v2 Vector: ' || nullif(cvss_v3.vector_string, '') END, 'Affected Products: ' || {_joined_sql("affected_products")}"""


@query(f"""WITH {_ADDED} SELECT ingest_id, md5(concat_ws(' | ', {_EMBED}, 'Common Weaknesses: ' || {_joined_sql("cwe_refs")}, 'Attack Patterns: ' || {_joined_sql("capec_entries")},
  'MITRE ATT&CK Techniques: ' || {_joined_sql("mitre_techniques")}, 'MITRE ATT&CK Tactics: ' || {_joined_sql("mitre_tactics")})) AS text_md5 FROM c""")
def embedding_text(spark, d):
    """The text for embedding of every record; compared by its MD5."""
    rows = _added(spark, d)
    return rows.select("ingest_id", F.md5(x.embedding_text(rows)).alias("text_md5"))


_NEIGHBOURS = f"""{E}, t AS (SELECT DISTINCT cve_id AS src, y AS dst FROM (SELECT cve_id, unnest(mitre_techniques) AS y FROM cves WHERE cve_id IS NOT NULL) WHERE trim(y) <> ''),
 every AS (SELECT src, rel, dst FROM e UNION ALL SELECT src, 'USES_TECHNIQUE', dst FROM t UNION ALL SELECT DISTINCT src, 'BELONGS_TO_TACTIC', 'TA' || substr(dst, 2, 2) FROM t),
 n AS (SELECT src, list_sort(list(dst) FILTER (rel = 'AFFECTS')) AS rp, list_sort(list(dst) FILTER (rel = 'HAS_WEAKNESS')) AS rw, list_sort(list(dst) FILTER (rel = 'HAS_ATTACK_PATTERN')) AS ra, list_sort(list(dst) FILTER (rel = 'USES_TECHNIQUE')) AS rt, list_sort(list(dst) FILTER (rel = 'BELONGS_TO_TACTIC')) AS rc FROM every GROUP BY src),
 one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY ingest_id) AS k FROM c WHERE cve_id IS NOT NULL) WHERE k = 1)"""


@query(f"""WITH {_ADDED}, {_NEIGHBOURS} SELECT id, coalesce(cvss_v3.base_severity, 'UNKNOWN') AS severity, len(coalesce(rp, [])) AS n_products, len(coalesce(rt, [])) AS n_techniques, md5(concat_ws(' | ', {_EMBED}, 'Related Products: ' || {_joined_sql("rp")},
  'Common Weaknesses: ' || {_joined_sql("rw")}, 'Attack Patterns: ' || {_joined_sql("ra")}, 'MITRE ATT&CK Techniques: ' || {_joined_sql("rt")}, 'MITRE ATT&CK Tactics: ' || {_joined_sql("rc")})) AS text_md5,
  coalesce(array_to_string(list_filter(affected_products, lambda y: y IS NOT NULL), ', '), '-') AS products FROM one LEFT JOIN n ON src = id""")
def graph_documents(spark, d):
    """Documents of records with the lists of five families of edges, their text for embedding and metadata as texts."""
    from adit.operators import graph as g

    t = g.technique_edges(table(spark, d, "cves"))
    tactics = t.select("src", F.lit("BELONGS_TO_TACTIC").alias("rel"), F.concat(F.lit("TA"), F.substring("dst", 2, 2)).alias("dst")).distinct()
    every = g.edges_of(table(spark, d, "cve_edges")).unionByName(t).unionByName(tactics)
    rows = _added(spark, d)
    first = r.latest(rows.filter("cve_id IS NOT NULL").withColumn("o", -F.col("ingest_id")), "cve_id", ["o"]).drop("o")
    docs = x.record_documents(first, every)
    m = lambda k, none: F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit(none))
    return docs.select("id", m("severity", "").alias("severity"), F.size("related_products").cast("bigint").alias("n_products"), F.size("mitre_techniques").cast("bigint").alias("n_techniques"), F.md5("text_for_embedding").alias("text_md5"), m("products", "-").alias("products"))


def _product_sql(vendor: str, figures: bool) -> str:
    more = "'Criticality Score: ' || coalesce(criticality_score, 0.0)," if figures else ""
    last = ", 'Vulnerability Count: ' || coalesce(p.vulnerability_count, 0)" if figures else ""
    return f"""concat_ws(' | ', 'Product: ' || coalesce(p.display_name, ''), 'Vendor: ' || coalesce({vendor}, ''), 'Category: ' || coalesce(category, ''), 'Family: ' || coalesce(family, ''), {more} 'Aliases: ' || {_joined_sql("p.aliases")}, 'Versions: ' || {_joined_sql("versions")}{last})"""


@query(f"""SELECT product_row, {_product_sql("v.display_name", True)} AS text, {_product_sql("p.vendor_name", False)} AS short_text
 FROM product_nodes p LEFT JOIN (SELECT vendor_name, min(display_name) AS display_name FROM vendor_nodes GROUP BY 1) v ON p.vendor_name = v.vendor_name""")
def product_text(spark, d):
    """Products with their vendors' names as text, in two forms."""
    v = table(spark, d, "vendor_nodes").groupBy("vendor_name").agg(F.min("display_name").alias("vendor"))
    p = table(spark, d, "product_nodes").join(v, "vendor_name", "left")
    return p.select("product_row", x.product_text(F.col("vendor"), True).alias("text"), x.product_text(F.col("vendor_name"), False).alias("short_text"))


@query("""SELECT 'records' AS figure, count(*) AS n FROM cves UNION ALL SELECT 'exploited', count(*) FROM cves WHERE is_in_kev UNION ALL SELECT 'with score', count(*) FROM cves WHERE cvss_v3.base_score > 0
 UNION ALL SELECT 'severity ' || coalesce(cvss_v3.base_severity, 'UNKNOWN'), count(*) FROM cves GROUP BY 1 UNION ALL """ + " UNION ALL ".join(f"SELECT '{n}', count(DISTINCT e) FROM (SELECT unnest({c}) AS e FROM cves)" for n, c in (("products", "affected_products"), ("vendors", "affected_vendors"), ("weaknesses", "cwe_refs"), ("patterns", "capec_entries"), ("techniques", "mitre_techniques"))))
def record_statistics(spark, d):
    """The figures that go with an export of records."""
    return x.record_statistics(table(spark, d, "cves"))


@query("""SELECT 'KEV-' || cve_id AS id, md5(concat_ws(chr(10), 'Known Exploited Vulnerability: ' || cve_id, 'Vendor/Project: ' || coalesce(nullif(source, ''), 'Unknown'), 'Product: ' || coalesce(nullif(title, ''), 'Unknown'), 'Vulnerability Name: Unknown',
  'Date Added to KEV: ' || coalesce(nullif(published_date, ''), 'Unknown'), 'Required Action: None specified', 'Due Date: None specified', 'Notes: ' || nullif(description, ''))) AS content_md5 FROM cves WHERE is_in_kev AND cve_id <> ''""")
def exploited_documents(spark, d):
    """Documents of the exploited list; compared by the MD5 of their content."""
    from adit.operators.records import exploited_documents as of

    kev = table(spark, d, "cves").filter("is_in_kev").select(F.col("cve_id").alias("id"), F.col("source").alias("vendor_project"), F.col("title").alias("product"), F.col("published_date").alias("date_added"), F.col("description").alias("notes"))
    return of(kev).select("id", F.md5("content").alias("content_md5"))


@query("SELECT 'token' AS term, count(*) FILTER (contains(lower(text), 'token')) AS n, count(*) FILTER (length(text) BETWEEN 50 AND 5000) AS usable FROM documents UNION ALL SELECT 'restart', count(*) FILTER (contains(lower(text), 'restart')), count(*) FILTER (length(text) BETWEEN 50 AND 5000) FROM documents")
def term_mentions(spark, d):
    """Texts that mention each of some terms, and texts of a usable length."""
    return t.mention_counts(table(spark, d, "documents"), "text", ["token", "restart"])


def _tags_sql() -> str:
    none = "CAST([] AS VARCHAR[])"
    some = lambda c: f"list_filter(coalesce({c}, []), lambda x: x IS NOT NULL)"
    weak = " ".join(f"WHEN contains(x, '{p}') THEN {_sql_list(v)}" for p, v in t.WEAKNESS_TAGS)
    prod = " ".join(f"WHEN contains(lower(x), '{a}') OR contains(lower(x), '{b}') THEN ['{n}']" for (a, b), n in t.PRODUCT_TAGS)
    parts = [
        f"flatten(list_transform({some('cwe_refs')}, lambda x: CASE {weak} ELSE {none} END))",
        f"flatten(list_transform({some('affected_products')}, lambda x: CASE {prod} ELSE {none} END))",
        f"CASE WHEN len({some('capec_entries')}) > 0 THEN ['capec'] ELSE {none} END",
        f"list_transform({some('capec_entries')}[1:3], lambda x: 'capec_' || lower(x))",
        f"CASE WHEN len({some('mitre_techniques')}) > 0 THEN ['mitre_attack'] ELSE {none} END",
        f"list_transform({some('mitre_techniques')}[1:3], lambda x: 'technique_' || lower(x))",
        f"list_transform({some('tactics')}[1:3], lambda x: 'tactic_' || lower(x))",
        f"CASE WHEN is_in_kev THEN ['kev', 'exploited', 'critical'] ELSE {none} END",
    ]
    every = parts[0]
    for p in parts[1:]:
        every = f"list_concat({every}, {p})"
    return f"SELECT ingest_id, array_to_string(list_sort(list_distinct({every})), ', ') AS tags FROM (SELECT *, list_transform(mitre_techniques, lambda x: 'TA' || substr(x, 2, 2)) AS tactics FROM cves)"


@query(_tags_sql())
def tags(spark, d):
    c = F.col
    tactics = F.transform("mitre_techniques", lambda y: F.concat(F.lit("TA"), F.substring(y, 2, 2)))
    found = t.tags(c("cwe_refs"), c("affected_products"), c("capec_entries"), c("mitre_techniques"), c("is_in_kev"), tactics)
    return table(spark, d, "cves").select("ingest_id", F.array_join(found, ", ").alias("tags"))


_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
_CHUNKS = rf"""w AS (SELECT doc_id, text, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
 c AS (SELECT doc_id, CASE WHEN len(w) <= 512 THEN [text] ELSE list_transform(range(0, len(w), 462), lambda i: array_to_string(w[i + 1:i + 512], ' ')) END AS c FROM w),
 x AS (SELECT doc_id, generate_subscripts(c, 1) - 1 AS chunk_no, unnest(c) AS chunk FROM c)"""


def _documents(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL")


@query(f"WITH {_CHUNKS} SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, md5(chunk) AS chunk_md5 FROM x")
def chunks(spark, d):
    """Windows of 512 words, 50 of them shared; compared by their MD5."""
    c = _documents(spark, d).select("doc_id", F.posexplode(t.chunks(F.col("text"))).alias("chunk_no", "chunk"))
    return c.select("doc_id", "chunk_no", F.md5("chunk").alias("chunk_md5"))


@query(f"WITH {_CHUNKS} SELECT n_chunks, count(*) AS n FROM (SELECT doc_id, count(*) AS n_chunks FROM x GROUP BY 1) GROUP BY 1")
def chunk_counts(spark, d):
    return _documents(spark, d).select(F.size(t.chunks(F.col("text"))).cast("bigint").alias("n_chunks")).groupBy("n_chunks").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT split_part(cve_id, '-', 2) AS year, ingest_id, round(((length(lower(description)) - length(replace(lower(description), 'token', ''))) / 5) / greatest(1, length(description))::DOUBLE, 9) AS score
  FROM cves WHERE cve_id IS NOT NULL AND contains(lower(description), 'token'))
 SELECT year, ingest_id, score FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY score DESC, ingest_id) AS k FROM s) WHERE k <= 5 ORDER BY score DESC, ingest_id LIMIT 20""")
def lexical_search_by_year(spark, d):
    """The densest mentions of a word: five of each year, twenty overall."""
    s = table(spark, d, "cves").filter(F.col("cve_id").isNotNull() & F.contains(F.lower("description"), F.lit("token")))
    s = s.select(ids.record_year(F.col("cve_id")).alias("year"), "ingest_id", F.round(t.density(F.col("description"), "token"), 9).alias("score"))
    return r.top_per_group(s, "year", [F.desc("score"), F.col("ingest_id")], 5).orderBy(F.desc("score"), "ingest_id").limit(20)


@query("SELECT ingest_id FROM cves WHERE len(list_filter(affected_vendors, lambda v: contains(lower(v), 'labs') OR contains(lower(v), 'cloud'))) > 0 OR len(list_filter(affected_products, lambda v: contains(lower(v), 'vault'))) > 0")
def term_match_search(spark, d):
    return table(spark, d, "cves").filter(t.mentions(F.col("affected_vendors"), ["labs", "cloud"]) | t.mentions(F.col("affected_products"), ["Vault"])).select("ingest_id")


def _keywords_sql() -> str:
    hits = ", ".join([f"CASE WHEN contains(low, '{k}') THEN '{k}' END" for k in t.TERMS] + [f"CASE WHEN contains(low, '{full}') OR contains(low, '{short}') THEN '{short}' END" for short, full in t.SHORT_TERMS.items()])
    return rf"""k AS (SELECT ingest_id, unnest(list_concat([{hits}], list_filter(list_transform(coalesce(affected_products, [])[1:5], lambda p: regexp_extract(lower(p), '\S+', 0)), lambda w: length(w) > 2))) AS keyword
      FROM (SELECT ingest_id, affected_products, lower(coalesce(description, '')) AS low FROM cves))"""


@query(f"WITH {_keywords_sql()} SELECT DISTINCT keyword, ingest_id FROM k WHERE keyword IS NOT NULL")
def keyword_index(spark, d):
    """Keyword and row of every keyword of every record."""
    k = t.keywords(F.col("description"), F.col("affected_products"))
    return table(spark, d, "cves").select(F.explode(k).alias("keyword"), "ingest_id")


@query(f"WITH {_keywords_sql()} SELECT keyword, count(DISTINCT ingest_id) AS n FROM k WHERE keyword IS NOT NULL GROUP BY 1")
def doc_frequency(spark, d):
    k = t.keywords(F.col("description"), F.col("affected_products"))
    return table(spark, d, "cves").select(F.explode(k).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))


@query("SELECT split_part(cve_id, '-', 2) AS year, count(DISTINCT cve_id) AS n, min(cve_id) AS first_id, max(cve_id) AS last_id FROM cves WHERE cve_id IS NOT NULL GROUP BY 1")
def year_index(spark, d):
    return table(spark, d, "cves").filter("cve_id IS NOT NULL").groupBy(ids.record_year(F.col("cve_id")).alias("year")).agg(F.countDistinct("cve_id").alias("n"), F.min("cve_id").alias("first_id"), F.max("cve_id").alias("last_id"))


_KEYWORDS = ("cve", "vulnerability", "security", "attack", "exploit", "mitigation", "buffer overflow", "sql injection", "xss", "authentication", "authorization")


@query(" UNION ALL ".join(f"SELECT '{k}' AS term, count(*) FILTER (contains(lower(output), '{k}')) AS n FROM training_examples" for k in _KEYWORDS))
def answer_keywords(spark, d):
    """Answers that mention each of eleven keywords."""
    return t.mention_counts(table(spark, d, "training_examples"), "output", list(_KEYWORDS)).select("term", "n")


@query("SELECT doc_id, doc_type FROM documents ORDER BY doc_id LIMIT 25")
def first_rows(spark, d):
    """The first rows in a stated order."""
    return table(spark, d, "documents").select("doc_id", "doc_type").orderBy("doc_id").limit(25)


_MULTI = {
    "year": "[split_part(cve_id, '-', 2)]",
    "severity": "[lower(coalesce(cvss_v3.base_severity, 'unknown'))]",
    "weakness": "coalesce(cwe_refs, [])",
    "pattern": "coalesce(capec_entries, [])",
    "tactic": "list_transform(list_filter(coalesce(mitre_techniques, []), lambda x: contains(x, '.')), lambda x: lower(split_part(x, '.', 1)))",
    "technique": "list_transform(coalesce(mitre_techniques, []), lambda x: lower(x))",
    "keyword": "coalesce(kw, [])",
}
_INDEX = f"WITH {_keywords_sql()}, kws AS (SELECT ingest_id, list_distinct(list(keyword)) AS kw FROM k WHERE keyword IS NOT NULL GROUP BY 1), i AS (" + " UNION ".join(f"SELECT '{n}' AS idx, unnest({e}) AS key, cve_id FROM cves LEFT JOIN kws USING (ingest_id) WHERE cve_id IS NOT NULL" for n, e in _MULTI.items()) + ")"


def _index(spark, d):
    return x.index_entries(table(spark, d, "cves"))


@query(f"{_INDEX} SELECT idx, key, count(DISTINCT cve_id) AS n FROM i WHERE key IS NOT NULL GROUP BY 1, 2")
def inverted_indexes(spark, d):
    """Seven indexes in one pass, with the number of records of each key."""
    return _index(spark, d).groupBy("idx", "key").agg(F.count("*").alias("n"))


@query(f"{_INDEX} SELECT DISTINCT idx, key, cve_id FROM i WHERE key IS NOT NULL")
def index_entries(spark, d):
    """The records of every key of every index."""
    return _index(spark, d)


@query(f"{_INDEX} SELECT idx, count(DISTINCT key) AS n_keys, count(DISTINCT (key, cve_id)) AS n_entries FROM i WHERE key IS NOT NULL GROUP BY 1")
def index_sizes(spark, d):
    """Keys and entries of each index."""
    return _index(spark, d).groupBy("idx").agg(F.countDistinct("key").alias("n_keys"), F.count("*").alias("n_entries"))


def _phrases_sql() -> str:
    hits = ", ".join(f"CASE WHEN contains(low, '{p}') THEN {_sql_list(v)} ELSE CAST([] AS VARCHAR[]) END" for p, v in t.PHRASE_TECHNIQUES.items())
    return f"SELECT doc_id, array_to_string(list_sort(list_distinct(flatten([{hits}]))), ', ') AS techniques FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents)"


@query(_phrases_sql())
def keyword_techniques(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(t.phrase_techniques(F.col("text")), ", ").alias("techniques"))


@query("SELECT example_id, CASE WHEN length(output) > 200 THEN output[1:200] || '...' ELSE output END AS short FROM training_examples WHERE output IS NOT NULL")
def shortened_text(spark, d):
    return table(spark, d, "training_examples").filter("output IS NOT NULL").select("example_id", t.shortened(F.col("output"), 200).alias("short"))


@query("SELECT min(example_id) AS example_id, count(*) AS copies FROM training_examples GROUP BY instruction, input, output")
def dedup_examples(spark, d):
    """The first of equal examples."""
    return tr.without_repeats(table(spark, d, "training_examples"), "example_id")


@query("""SELECT count(*) AS n, count(DISTINCT instruction) AS instructions, round(count(DISTINCT instruction) / count(*)::DOUBLE, 9) AS instruction_diversity, count(DISTINCT md5(coalesce(output, ''))) AS outputs,
 round(1 - count(DISTINCT (md5(coalesce(instruction, '')), md5(coalesce(input, '')), md5(coalesce(output, '')))) / count(*)::DOUBLE, 9) AS repeat_ratio FROM training_examples""")
def dataset_quality(spark, d):
    """Diversity and repeats of a set of examples."""
    return tr.quality(table(spark, d, "training_examples"))


_REACH = "CASE WHEN contains(vec, 'AV:N') THEN 'It can be reached over the network.' WHEN contains(vec, 'AV:A') THEN 'It can be reached from the same network segment.' WHEN contains(vec, 'AV:L') THEN 'It needs local access.' WHEN contains(vec, 'AV:P') THEN 'It needs physical access.' END"
_RIGHTS = "CASE WHEN contains(vec, 'PR:N') THEN 'No rights are needed.' WHEN contains(vec, 'PR:L') THEN 'Low rights are needed.' WHEN contains(vec, 'PR:H') THEN 'High rights are needed.' END"
_EXAMPLES = f"""known AS (SELECT technique_id, min(concat_ws(' ', '- **' || technique_id || ':** ', technique_name)) AS line FROM mitre_techniques WHERE technique_id IS NOT NULL GROUP BY 1),
 tl AS (SELECT ingest_id, list_sort(list(line)) AS ls FROM (SELECT DISTINCT ingest_id, unnest(mitre_techniques) AS y FROM cves) JOIN known ON y = technique_id GROUP BY 1),
 b AS (SELECT cves.*, nullif(array_to_string(ls[1:3], chr(10)), '') AS ls3, coalesce(cvss_v3.base_severity, 'UNKNOWN') AS sev, coalesce(cvss_v3.base_score, 0.0) AS score, coalesce(cvss_v3.vector_string, '') AS vec, coalesce({_joined_sql("affected_products")}, 'Not specified') AS products
   FROM cves LEFT JOIN tl USING (ingest_id) WHERE title <> '' AND description <> ''),
 p AS (SELECT *, concat('CVE ID: ', coalesce(cve_id, ''), chr(10), 'Title: ', title, chr(10), 'Description: ', description, chr(10), 'Affected Products: ', products) AS input, {_REACH} AS reach, {_RIGHTS} AS rights FROM b),
 ex AS (SELECT ingest_id, 'analysis' AS kind, 'Analyze the following record and provide a security assessment.' AS instruction, input, concat_ws(chr(10), '**Severity:** ' || sev, '**Details:**' || chr(10) || description, reach, '**Weaknesses:** ' || {_joined_sql("cwe_refs")}, CASE WHEN is_in_kev THEN 'It is known to be exploited.' END) AS output FROM p
   UNION ALL SELECT ingest_id, 'remediation', 'Write remediation guidance for this record.', input, concat_ws(chr(10), 'Affected: ' || products, 'Update ' || CASE WHEN score >= 9 THEN 'immediately' WHEN score >= 7 THEN 'within days' ELSE 'with the next regular update' END || '.', rights) FROM p
   UNION ALL SELECT ingest_id, 'technical', 'Explain the technical details of this record.', input, concat_ws(chr(10), description, 'Vector: ' || nullif(vec, ''), reach, rights) FROM p
   UNION ALL SELECT ingest_id, 'detection', 'Describe how an attempt could be detected.', input, 'Watch for these techniques:' || chr(10) || ls3 FROM p WHERE ls3 IS NOT NULL
   UNION ALL SELECT ingest_id, 'mitigation', 'Suggest mitigations for the techniques involved.', input, 'Mitigate these techniques:' || chr(10) || ls3 FROM p WHERE ls3 IS NOT NULL)"""


@query(f"WITH {_EXAMPLES} SELECT ingest_id, kind, instruction, md5(input) AS input_md5, md5(output) AS output_md5 FROM ex")
def training_examples(spark, d):
    """Five kinds of examples of every record with a title and a description; texts compared by their MD5."""
    return tr.examples(table(spark, d, "cves"), table(spark, d, "mitre_techniques")).select("ingest_id", "kind", "instruction", F.md5("input").alias("input_md5"), F.md5("output").alias("output_md5"))


def _hash_sql(a: str, b: str) -> str:
    return f"CAST('0x' || substr(md5('42|' || {a} || '|' || {b}), 1, 7) AS BIGINT)"


_DIVERSE = rf"""{_EXAMPLES}, num AS (SELECT *, row_number() OVER (ORDER BY ingest_id, kind) - 1 AS number, {_hash_sql("ingest_id", "kind")} AS h, {_hash_sql("kind", "ingest_id")} AS h2 FROM ex),
 dv AS (SELECT ingest_id, kind, number, h2, {_sql_list(tr.INSTRUCTIONS + tr.ASPECTS)}[number % 23 + 1] || CASE WHEN h % 10 < 3 THEN ' ' || {_sql_list(tr.ASPECTS)}[(h // 10) % 8 + 1] ELSE '' END AS instruction, {_sql_list(tr.INPUT_HEADS)}[number % 8 + 1] || chr(10) || input AS input,
   {_sql_list(tr.OUTPUT_HEADS)}[number % 8 + 1] || chr(10) || regexp_replace(regexp_replace(regexp_replace(output, '(?m)^#+\s*.*?
', '', 'g'), '(?m)^\*\*.*?\*\*:
', '', 'g'), '^\s+|\s+$', '', 'g') AS output FROM num),
 once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instruction, input, output ORDER BY number) AS k FROM dv) WHERE k = 1)"""


def _diverse(spark, d, limit=None):
    return tr.diversified(tr.examples(table(spark, d, "cves"), table(spark, d, "mitre_techniques")), limit)


@query(f"WITH {_DIVERSE} SELECT number, instruction, md5(input) AS input_md5, md5(output) AS output_md5 FROM once")
def diversified_examples(spark, d):
    """Examples with instructions, inputs and outputs in rotating forms, each once; texts compared by their MD5."""
    return _diverse(spark, d).select("number", "instruction", F.md5("input").alias("input_md5"), F.md5("output").alias("output_md5"))


@query(f"WITH {_DIVERSE} SELECT number, md5('Instruction: ' || CASE WHEN length(instruction) > 100 THEN instruction[1:100] || '...' ELSE instruction END || chr(10) || 'Input: ' || CASE WHEN length(input) > 400 THEN input[1:400] || '...' ELSE input END || chr(10) || 'Output: ' || CASE WHEN length(output) > 250 THEN output[1:250] || '...' ELSE output END) AS text_md5 FROM (SELECT * FROM once ORDER BY h2, number LIMIT 1500)")
def shuffled_prompts(spark, d):
    """The first 1500 examples of a shuffle by hash, formatted as prompts."""
    return tr.prompts(_diverse(spark, d, 1500)).select("number", F.md5("text").alias("text_md5"))


@query(f"""WITH {E}, nb AS (SELECT src, list_sort(list(dst) FILTER (rel = 'HAS_WEAKNESS')) AS w, list_sort(list(dst) FILTER (rel = 'HAS_ATTACK_PATTERN')) AS a FROM e GROUP BY src),
 one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY ingest_id) AS k FROM cves WHERE cve_id IS NOT NULL) WHERE k = 1),
 tech AS (SELECT technique_id, arg_min(technique_name, sheet_row) AS name FROM mitre_techniques WHERE technique_id IS NOT NULL AND technique_name IS NOT NULL GROUP BY 1),
 pl AS (SELECT cve_id, generate_subscripts(l, 1) AS i, unnest(l) AS y FROM (SELECT cve_id, list_filter(mitre_techniques, lambda x: x IS NOT NULL) AS l FROM one)),
 det AS (SELECT cve_id, string_agg(y || '=' || name, ';' ORDER BY i) AS details FROM pl JOIN tech ON y = technique_id GROUP BY 1)
 SELECT one.cve_id AS id, coalesce(cvss_v3.base_score, 0.0) AS score, coalesce(cvss_v3.base_severity, 'UNKNOWN') AS severity, EXISTS (SELECT 1 FROM cves x WHERE x.is_in_kev AND x.cve_id = one.cve_id) AS is_in_kev,
  coalesce(array_to_string(w, ', '), '') AS cwes, coalesce(array_to_string(a, ', '), '') AS capecs, coalesce(details, '') AS details FROM one LEFT JOIN nb ON src = one.cve_id LEFT JOIN det ON det.cve_id = one.cve_id""")
def assembled_records(spark, d):
    """Records with what examples are made of: edges, the exploited flag, and details of techniques in their order."""
    from adit.operators.graph import edges_of

    first = r.latest(table(spark, d, "cves").filter("cve_id IS NOT NULL").withColumn("o", -F.col("ingest_id")), "cve_id", ["o"]).drop("o")
    named = table(spark, d, "mitre_techniques").filter("technique_id IS NOT NULL AND technique_name IS NOT NULL").groupBy("technique_id").agg(F.min_by(F.struct(F.col("technique_name").alias("name"), "description", "detection", "data_sources"), "sheet_row").alias("r")).select("technique_id", "r.*")
    got = tr.enriched_records(first, edges_of(table(spark, d, "cve_edges")), table(spark, d, "cves").filter("is_in_kev"), named)
    details = F.array_join(F.transform("technique_details", lambda y: F.concat_ws("=", y["id"], y["name"])), ";")
    return got.select("id", "score", "severity", "is_in_kev", F.array_join("cwes", ", ").alias("cwes"), F.array_join("capecs", ", ").alias("capecs"), details.alias("details"))
