"""Queries on the property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adit.operators import graph as g
from adit.operators.orphans import name_key
from adit.plans.registry import query
from adit.runtime import table

E = r"""e AS (
  SELECT DISTINCT cve_id AS src, 'AFFECTS' AS rel, replace(lower(trim(product_name)), ' ', '_') AS dst FROM cve_edges WHERE trim(product_name) <> ''
  UNION ALL SELECT DISTINCT cve_id, 'HAS_WEAKNESS', 'CWE-' || regexp_replace(regexp_extract(cwe_id, '(\d+)\D*$', 1), '^0+(\d)', '\1') FROM cve_edges WHERE trim(cwe_id) <> ''
  UNION ALL SELECT DISTINCT cve_id, 'HAS_ATTACK_PATTERN', 'CAPEC-' || regexp_replace(regexp_extract(capec_id, '(\d+)\D*$', 1), '^0+(\d)', '\1') FROM cve_edges WHERE trim(capec_id) <> '')"""
MB = "mb AS (SELECT replace(lower(trim(product_name)), ' ', '_') AS product, min(vendor_name) AS vendor FROM product_nodes GROUP BY 1)"
NODES = r"""nodes AS (
  SELECT DISTINCT 'CVE' AS kind, cve_id AS id FROM cves WHERE cve_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'Product', replace(lower(trim(product_name)), ' ', '_') FROM product_nodes
  UNION ALL SELECT DISTINCT 'Vendor', vendor_name FROM vendor_nodes
  UNION ALL SELECT DISTINCT 'CWE', 'CWE-' || regexp_replace(regexp_extract(cwe_id, '(\d+)\D*$', 1), '^0+(\d)', '\1') FROM cwe_nodes
  UNION ALL SELECT DISTINCT 'CAPEC', 'CAPEC-' || regexp_replace(regexp_extract(capec_id, '(\d+)\D*$', 1), '^0+(\d)', '\1') FROM capec_nodes)"""
FIRST = "(SELECT min(src) FROM e)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    return g.edges_of(table(spark, d, "cve_edges"))


def vendors(spark: SparkSession, d: str) -> DataFrame:
    return g.made_by(table(spark, d, "product_nodes"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return g.nodes_of(*[table(spark, d, t) for t in ("cves", "product_nodes", "vendor_nodes", "cwe_nodes", "capec_nodes")])


def affected(spark: SparkSession, d: str) -> DataFrame:
    """Records with their products and the products' vendors."""
    return edges(spark, d).filter("rel = 'AFFECTS'").join(vendors(spark, d), F.col("dst") == F.col("product")).select("src", "product", "vendor")


@query(f"""WITH {E}, {MB} SELECT vendor, count(DISTINCT src) AS records, count(DISTINCT dst) AS products, round(CAST(count(DISTINCT src) AS DOUBLE) / count(DISTINCT dst), 6) AS ratio
 FROM e JOIN mb ON dst = product WHERE rel = 'AFFECTS' AND vendor IS NOT NULL GROUP BY vendor ORDER BY ratio DESC, vendor LIMIT 15""")
def vendor_record_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Records per affected product of each vendor; the 15 highest."""
    reached = affected(spark, d).filter("vendor IS NOT NULL")
    # Distinct edges: a product's records are its rows; a record that affects several products of a vendor counts once.
    products = reached.groupBy("vendor", "product").agg(F.lit(1).alias("one")).groupBy("vendor").agg(F.count("*").alias("products"))
    records = reached.select("vendor", "src").distinct().groupBy("vendor").agg(F.count("*").alias("records"))
    ratio = records.join(products, "vendor").select("vendor", "records", "products", F.round(F.col("records") / F.col("products"), 6).alias("ratio"))
    return g.top(ratio, "ratio", "vendor", 15)


@query("""WITH aff AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), mb AS (SELECT l_partkey, min(l_suppkey) AS s FROM lineitem GROUP BY 1)
SELECT CAST(s AS BIGINT) AS vendor, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS records, CAST(count(DISTINCT aff.l_partkey) AS BIGINT) AS products,
 round(CAST(count(DISTINCT l_orderkey) AS DOUBLE) / count(DISTINCT aff.l_partkey), 6) AS ratio
FROM aff JOIN mb ON aff.l_partkey = mb.l_partkey GROUP BY 1 ORDER BY ratio DESC, vendor LIMIT 15""")
def supplier_order_ratio(spark: SparkSession, d: str) -> DataFrame:
    """The same over orders, parts and their first suppliers."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    per_part = lines.groupBy("l_partkey").agg(F.min("l_suppkey").alias("vendor"))
    # Every part has an edge, so that a vendor's parts are the rows of per_part; records are counted on distinct pairs.
    products = per_part.groupBy("vendor").agg(F.count("*").alias("products"))
    records = lines.join(per_part, "l_partkey").select("vendor", "l_orderkey").distinct().groupBy("vendor").agg(F.count("*").alias("records"))
    ratio = records.join(products, "vendor").select("vendor", "records", "products", F.round(F.col("records") / F.col("products"), 6).alias("ratio"))
    return g.top(ratio, "ratio", "vendor", 15)


_T = "t AS (SELECT DISTINCT cve_id AS src, 'USES_TECHNIQUE' AS rel, dst FROM (SELECT cve_id, unnest(mitre_techniques) AS dst FROM cves WHERE cve_id IS NOT NULL) WHERE trim(dst) <> '')"
_V = "ver AS (SELECT DISTINCT src, 'HAS_VERSION' AS rel, v || '|' || src AS dst FROM (SELECT replace(lower(trim(product_name)), ' ', '_') AS src, unnest(versions) AS v FROM product_nodes WHERE product_name IS NOT NULL) WHERE trim(v) <> '' AND v <> '*')"


def technique_tactics(spark: SparkSession, d: str) -> DataFrame:
    """technique_id and tactic, from the packed column."""
    from adit.operators.packed import listed, unpack

    cells = table(spark, d, "mitre_techniques").filter("technique_id IS NOT NULL").select("technique_id", F.lit("tactics").alias("field_name"), F.col("tactics").alias("cell"))
    return unpack(cells, "cell", "field_name", listed(table(spark, d, "listed_names")), ["technique_id"], value_col="tactic").select("technique_id", "tactic").distinct()


def threats(spark: SparkSession, d: str) -> DataFrame:
    """All edges of records but those to products."""
    t = g.technique_edges(table(spark, d, "cves"))
    return edges(spark, d).filter("rel <> 'AFFECTS'").unionByName(t).unionByName(g.tactic_edges(t, technique_tactics(spark, d)))


_THREATS = f"""{E}, {_T}, threat AS (SELECT * FROM e WHERE rel <> 'AFFECTS' UNION ALL SELECT * FROM t),
 node AS (SELECT CASE rel WHEN 'HAS_WEAKNESS' THEN 'CWE' WHEN 'HAS_ATTACK_PATTERN' THEN 'CAPEC' ELSE 'MITRE_TECHNIQUE' END AS node_type, dst AS id,
   CASE rel WHEN 'HAS_WEAKNESS' THEN 'Common Weakness Enumeration ' WHEN 'HAS_ATTACK_PATTERN' THEN 'Common Attack Pattern ' ELSE 'MITRE ATT&CK Technique ' END || dst AS name, count(*) AS vulnerability_count FROM threat GROUP BY rel, dst)"""


@query(f"WITH {_T}, {_V} SELECT rel, count(*) AS n FROM t GROUP BY rel UNION ALL SELECT rel, count(*) FROM ver GROUP BY rel")
def further_edge_counts(spark, d):
    """Edges to techniques and versions."""
    return g.counts_by(g.technique_edges(table(spark, d, "cves")).unionByName(g.version_edges(table(spark, d, "product_nodes"))), "rel")


@query(f"WITH {_T} SELECT src, dst FROM t")
def technique_edges(spark, d):
    return g.technique_edges(table(spark, d, "cves")).select("src", "dst")


@query(f"WITH {_V} SELECT src, dst FROM ver")
def version_edges(spark, d):
    return g.version_edges(table(spark, d, "product_nodes")).select("src", "dst")


_PARENTS = f"{_T}, par AS (SELECT DISTINCT src, 'BELONGS_TO_TACTIC' AS rel, split_part(dst, '.', 1) AS dst FROM t WHERE contains(dst, '.'))"


@query(f"WITH {_PARENTS} SELECT src, rel, dst FROM par")
def parent_edges(spark, d):
    """Records with the techniques of their sub-techniques, as their tactics."""
    return g.parent_edges(g.technique_edges(table(spark, d, "cves")))


@query(f"WITH {_PARENTS} SELECT 'MITRE_TACTIC' AS node_type, dst AS id, 'MITRE ATT&CK Tactic ' || dst AS name, count(*) AS vulnerability_count FROM par GROUP BY dst")
def parent_nodes(spark, d):
    return g.threat_nodes(g.parent_edges(g.technique_edges(table(spark, d, "cves"))))


@query()
def tactic_edges(spark, d):
    """Records with the tactics of their techniques."""
    return g.tactic_edges(g.technique_edges(table(spark, d, "cves")), technique_tactics(spark, d)).select("src", "dst")


@query(f"WITH {_THREATS} SELECT * FROM node")
def threat_nodes(spark, d):
    """Weaknesses, patterns and techniques with their names and numbers of records."""
    return g.threat_nodes(threats(spark, d)).filter("node_type <> 'MITRE_TACTIC'")


@query(f"""WITH {_THREATS} SELECT node_type AS document_type, id, name, vulnerability_count, CASE node_type WHEN 'MITRE_TECHNIQUE' THEN 'MITRE Technique' ELSE node_type END || ' ' || id || ': ' || name || ' - ' || vulnerability_count || ' vulnerabilities' AS text_for_embedding FROM node""")
def threat_documents(spark, d):
    """The same as documents for retrieval."""
    return g.threat_documents(g.threat_nodes(threats(spark, d)).filter("node_type <> 'MITRE_TACTIC'"))


@query()
def tactic_documents(spark, d):
    """Tactics as documents for retrieval."""
    return g.threat_documents(g.threat_nodes(threats(spark, d)).filter("node_type = 'MITRE_TACTIC'"))


@query(f"WITH {_T} SELECT dst, count(*) AS n FROM t GROUP BY dst ORDER BY n DESC, dst LIMIT 10")
def top_techniques(spark, d):
    return g.top(g.counts_by(g.technique_edges(table(spark, d, "cves")), "dst"), "n", "dst", 10)


@query(f"""WITH {E}, {MB}, r AS (SELECT vendor, product, src FROM e JOIN mb ON dst = product WHERE rel = 'AFFECTS' AND vendor IS NOT NULL)
 SELECT vendor, count(DISTINCT product) AS products, count(DISTINCT r.src) AS records, count(DISTINCT w.dst) AS weaknesses FROM r LEFT JOIN e w ON r.src = w.src AND w.rel = 'HAS_WEAKNESS' GROUP BY vendor""")
def impact_network(spark, d):
    """Each vendor with its affected products, their records, and the weaknesses that these have."""
    r = affected(spark, d).filter("vendor IS NOT NULL")
    w = edges(spark, d).filter("rel = 'HAS_WEAKNESS'").select("src", F.col("dst").alias("weakness"))
    pairs = r.select("vendor", "src").distinct()
    weak = pairs.join(w, "src").select("vendor", "weakness").distinct().groupBy("vendor").agg(F.count("*").alias("weaknesses"))
    counts = r.groupBy("vendor").agg(F.countDistinct("product").alias("products"), F.countDistinct("src").alias("records"))
    return counts.join(weak, "vendor", "left").select("vendor", "products", "records", F.coalesce("weaknesses", F.lit(0)).cast("bigint").alias("weaknesses"))


@query(f"""WITH {MB}, f AS (SELECT min(vendor) AS v FROM mb) SELECT product, count(*) AS n_rows FROM mb, f JOIN product_nodes p ON replace(lower(trim(p.product_name)), ' ', '_') = mb.product WHERE vendor = v GROUP BY product""")
def products_of_vendor(spark, d):
    """The products of the first vendor, with the rows that name each."""
    m = vendors(spark, d)
    first = m.agg(F.min("vendor")).first()[0] or ""
    own = m.filter(F.col("vendor") == first).select("product")
    return table(spark, d, "product_nodes").select(name_key(F.col("product_name")).alias("product")).join(own, "product", "left_semi").groupBy("product").agg(F.count("*").alias("n_rows"))


@query(f"""WITH {E}, c AS (SELECT rel, dst, count(*) AS size FROM e WHERE rel = 'HAS_WEAKNESS' GROUP BY rel, dst HAVING count(*) >= 5 UNION ALL SELECT rel, dst, count(*) FROM e WHERE rel = 'AFFECTS' GROUP BY rel, dst HAVING count(*) >= 10)
 SELECT rel, dst, src AS member FROM e JOIN c USING (rel, dst)""")
def cluster_members(spark, d):
    """The members of every cluster, one row each, so that a hot one is spread as its edges are."""
    e = edges(spark, d)
    parts = [g.clusters(e, r, n).withColumn("rel", F.lit(r)).select("rel", "dst") for r, n in (("HAS_WEAKNESS", 5), ("AFFECTS", 10))]
    return e.join(parts[0].unionByName(parts[1]), ["rel", "dst"], "left_semi").select("rel", "dst", F.col("src").alias("member"))


@query(f"""WITH {E}, {NODES}, {MB}, deg AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id)
 SELECT 'nodes' AS figure, count(*)::DOUBLE AS value FROM nodes UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'edges ' || rel, count(*) FROM e GROUP BY rel UNION ALL SELECT 'nodes ' || kind, count(*) FROM nodes GROUP BY kind
 UNION ALL SELECT 'degree max', max(d) FROM deg UNION ALL SELECT 'degree avg', round(avg(d), 6) FROM deg UNION ALL SELECT 'clusters', count(*) FROM (SELECT 1 FROM e WHERE rel = 'HAS_WEAKNESS' GROUP BY dst HAVING count(*) >= 5)""")
def graph_features(spark, d):
    """The graph's figures as one table: counts by type, degrees, clusters."""
    return g.features(nodes(spark, d), edges(spark, d))


@query(f"""WITH {E} SELECT 'records' AS figure, count(DISTINCT cve_id) AS n FROM cves UNION ALL SELECT 'exploited', count(DISTINCT cve_id) FROM cves WHERE is_in_kev UNION ALL SELECT 'with score', count(DISTINCT cve_id) FROM cves WHERE cvss_v3.base_score > 0
 UNION ALL SELECT 'severity ' || coalesce(cvss_v3.base_severity, 'UNKNOWN'), count(*) FROM cves GROUP BY 1 UNION ALL SELECT 'edges ' || rel, count(*) FROM e GROUP BY rel""")
def knowledge_statistics(spark, d):
    """Figures of records and edges as one table."""
    return g.statistics(table(spark, d, "cves"), edges(spark, d))


@query(f"WITH {NODES} SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
def node_counts(spark, d):
    return g.counts_by(nodes(spark, d), "kind")


@query(f"WITH {E}, {MB} SELECT rel, count(*) AS n FROM e GROUP BY rel UNION ALL SELECT 'MANUFACTURED_BY', count(*) FROM mb WHERE vendor IS NOT NULL")
def edge_counts(spark, d):
    made = vendors(spark, d).filter("vendor IS NOT NULL").agg(F.count("*").alias("n")).select(F.lit("MANUFACTURED_BY").alias("rel"), "n")
    return g.counts_by(edges(spark, d), "rel").unionByName(made)


@query(f"WITH {E}, {NODES} SELECT 'node' AS what, kind AS label FROM nodes GROUP BY kind UNION ALL SELECT 'edge', rel FROM e GROUP BY rel")
def label_list(spark, d):
    return nodes(spark, d).select(F.lit("node").alias("what"), F.col("kind").alias("label")).distinct().union(edges(spark, d).select(F.lit("edge"), "rel").distinct())


@query("SELECT split_part(cve_id, '-', 2) AS year, count(DISTINCT cve_id) AS n FROM cves WHERE cve_id IS NOT NULL GROUP BY 1")
def records_by_year(spark, d):
    from adit.functions.identifiers import record_year

    return table(spark, d, "cves").filter("cve_id IS NOT NULL").groupBy(record_year(F.col("cve_id")).alias("year")).agg(F.countDistinct("cve_id").alias("n")).orderBy(F.desc("year"))


@query("SELECT coalesce(cvss_v3.base_severity, 'UNKNOWN') AS severity, count(*) AS n FROM cves GROUP BY 1")
def severity_distribution(spark, d):
    return table(spark, d, "cves").groupBy(F.coalesce("cvss_v3.base_severity", F.lit("UNKNOWN")).alias("severity")).agg(F.count("*").alias("n"))


@query("SELECT cvss_v3.base_severity AS severity, count(DISTINCT cve_id) AS n FROM cves WHERE cvss_v3.base_severity IS NOT NULL GROUP BY 1")
def records_by_severity(spark, d):
    return table(spark, d, "cves").select("cve_id", F.col("cvss_v3.base_severity").alias("severity")).filter("severity IS NOT NULL").groupBy("severity").agg(F.countDistinct("cve_id").alias("n"))


@query(f"WITH {E}, {MB} SELECT vendor, count(DISTINCT src) AS n FROM e JOIN mb ON dst = product WHERE rel = 'AFFECTS' GROUP BY vendor ORDER BY n DESC, vendor LIMIT 10")
def top_vendors(spark, d):
    return g.top(affected(spark, d).groupBy("vendor").agg(F.countDistinct("src").alias("n")), "n", "vendor", 10)


@query(f"WITH {E}, {MB} SELECT product, vendor, count(*) AS n FROM e JOIN mb ON dst = product WHERE rel = 'AFFECTS' GROUP BY product, vendor ORDER BY n DESC, product LIMIT 10")
def top_products_paths(spark, d):
    return g.top(affected(spark, d).groupBy("product", "vendor").agg(F.count("*").alias("n")), "n", "product", 10)


def _top_rel(rel: str):
    return f"WITH {E} SELECT dst, count(*) AS n FROM e WHERE rel = '{rel}' GROUP BY dst ORDER BY n DESC, dst LIMIT 10"


@query(_top_rel("HAS_WEAKNESS"))
def top_weaknesses(spark, d):
    return g.top(g.counts_by(edges(spark, d).filter("rel = 'HAS_WEAKNESS'"), "dst"), "n", "dst", 10)


@query(_top_rel("HAS_ATTACK_PATTERN"))
def top_patterns(spark, d):
    return g.top(g.counts_by(edges(spark, d).filter("rel = 'HAS_ATTACK_PATTERN'"), "dst"), "n", "dst", 10)


@query(f"WITH {MB} SELECT vendor, count(*) AS n FROM mb WHERE vendor IS NOT NULL GROUP BY vendor ORDER BY n DESC, vendor LIMIT 15")
def vendor_product_counts(spark, d):
    return g.top(g.counts_by(vendors(spark, d).filter("vendor IS NOT NULL"), "vendor"), "n", "vendor", 15)


@query(f"""WITH {E} SELECT a.dst AS weakness, b.dst AS pattern, count(*) AS n FROM e a JOIN e b ON a.src = b.src
 WHERE a.rel = 'HAS_WEAKNESS' AND b.rel = 'HAS_ATTACK_PATTERN' GROUP BY 1, 2 ORDER BY n DESC, weakness, pattern LIMIT 20""")
def weakness_pattern_cooccurrence(spark, d):
    e = edges(spark, d)
    w = e.filter("rel = 'HAS_WEAKNESS'").select("src", F.col("dst").alias("weakness"))
    p = e.filter("rel = 'HAS_ATTACK_PATTERN'").select("src", F.col("dst").alias("pattern"))
    return w.join(p, "src").groupBy("weakness", "pattern").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "weakness", "pattern").limit(20)


_VERSIONS = "v AS (SELECT DISTINCT replace(lower(trim(product_name)), ' ', '_') AS product, unnest(versions) AS version FROM product_nodes)"


def _versions(spark, d):
    return table(spark, d, "product_nodes").select(name_key(F.col("product_name")).alias("product"), F.explode("versions").alias("version")).distinct()


@query(f"""WITH {_VERSIONS}, {MB} SELECT count(*) AS products, count(n) AS with_version, round(100.0 * count(n) / count(*), 6) AS percent
 FROM mb LEFT JOIN (SELECT product, count(*) AS n FROM v WHERE version IS NOT NULL GROUP BY product) USING (product)""")
def version_coverage(spark, d):
    have = _versions(spark, d).filter("version IS NOT NULL").groupBy("product").agg(F.count("*").alias("n"))
    both = vendors(spark, d).join(have, "product", "left").agg(F.count("*").alias("products"), F.count("n").alias("with_version"))
    return both.withColumn("percent", F.round(100 * F.col("with_version") / F.col("products"), 6))


@query(f"WITH {_VERSIONS} SELECT product, count(version) AS n FROM v GROUP BY product HAVING count(version) > 1 ORDER BY n DESC, product LIMIT 20")
def multi_version_products(spark, d):
    return g.top(_versions(spark, d).groupBy("product").agg(F.count("version").alias("n")).filter("n > 1"), "n", "product", 20)


@query(f"WITH {E}, {MB} SELECT DISTINCT dst AS product FROM e WHERE rel = 'AFFECTS' AND NOT EXISTS (SELECT 1 FROM mb WHERE product = dst)")
def products_without_vendor(spark, d):
    return edges(spark, d).filter("rel = 'AFFECTS'").select(F.col("dst").alias("product")).distinct().join(vendors(spark, d), "product", "left_anti")


@query(f"WITH {E} SELECT DISTINCT cve_id FROM cves WHERE cve_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e WHERE rel = 'AFFECTS' AND src = cve_id)")
def records_without_products(spark, d):
    with_products = edges(spark, d).filter("rel = 'AFFECTS'").select(F.col("src").alias("cve_id"))
    return table(spark, d, "cves").select("cve_id").filter("cve_id IS NOT NULL").distinct().join(with_products, "cve_id", "left_anti")


@query("SELECT count(*) AS n, count(DISTINCT cve_id) AS records FROM cves WHERE cvss_v3.base_score IS NULL")
def null_score_records(spark, d):
    return table(spark, d, "cves").filter("cvss_v3.base_score IS NULL").agg(F.count("*").alias("n"), F.countDistinct("cve_id").alias("records"))


@query("SELECT product_name, vendor_name, count(*) AS n FROM product_nodes GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_products(spark, d):
    return table(spark, d, "product_nodes").groupBy("product_name", "vendor_name").agg(F.count("*").alias("n")).filter("n > 1")


@query(f"""WITH {E}, n AS (SELECT src, rel, string_agg(dst, ', ' ORDER BY dst) AS s FROM e GROUP BY src, rel)
 SELECT cve_id, (SELECT s FROM n WHERE src = cve_id AND rel = 'AFFECTS') AS products, (SELECT s FROM n WHERE src = cve_id AND rel = 'HAS_WEAKNESS') AS weaknesses,
   (SELECT s FROM n WHERE src = cve_id AND rel = 'HAS_ATTACK_PATTERN') AS patterns FROM (SELECT DISTINCT cve_id FROM cves WHERE cve_id IS NOT NULL)""")
def records_with_neighbours(spark, d):
    """Each record with its sorted neighbours: every edge family is nested before the join, so that none multiplies another."""
    e = edges(spark, d)
    text = lambda rel: F.array_join(F.array_sort(F.collect_list(F.when(F.col("rel") == rel, F.col("dst")))), ", ")
    nested = e.groupBy(F.col("src").alias("cve_id")).agg(*[F.when(F.count_if(F.col("rel") == r) > 0, text(r)).alias(n) for r, n in (("AFFECTS", "products"), ("HAS_WEAKNESS", "weaknesses"), ("HAS_ATTACK_PATTERN", "patterns"))])
    return table(spark, d, "cves").select("cve_id").filter("cve_id IS NOT NULL").distinct().join(nested, "cve_id", "left")


@query(f"WITH {_VERSIONS}, {MB} SELECT product, vendor, string_agg(version, ', ' ORDER BY version) AS versions FROM mb LEFT JOIN v USING (product) GROUP BY product, vendor")
def product_versions(spark, d):
    v = _versions(spark, d).groupBy("product").agg(F.array_join(F.array_sort(F.collect_list("version")), ", ").alias("versions"))
    return vendors(spark, d).join(v.filter("versions <> ''"), "product", "left")


@query(f"WITH {E}, {MB} SELECT src, rel, dst FROM e UNION ALL SELECT product, 'MANUFACTURED_BY', vendor FROM mb WHERE vendor IS NOT NULL")
def edge_projections(spark, d):
    made = vendors(spark, d).filter("vendor IS NOT NULL").select(F.col("product").alias("src"), F.lit("MANUFACTURED_BY").alias("rel"), F.col("vendor").alias("dst"))
    return edges(spark, d).unionByName(made)


@query(f"""WITH {E}, r AS (SELECT cve_id, max(published_date) AS published FROM cves WHERE cve_id IS NOT NULL AND published_date IS NOT NULL GROUP BY cve_id ORDER BY published DESC, cve_id LIMIT 20)
 SELECT cve_id, published, dst AS product FROM r LEFT JOIN e ON src = cve_id AND rel = 'AFFECTS'""")
def recent_records(spark, d):
    r = table(spark, d, "cves").filter("cve_id IS NOT NULL AND published_date IS NOT NULL").groupBy("cve_id").agg(F.max("published_date").alias("published")).orderBy(F.desc("published"), "cve_id").limit(20)
    e = edges(spark, d).filter("rel = 'AFFECTS'").select(F.col("src").alias("cve_id"), F.col("dst").alias("product"))
    return r.join(e, "cve_id", "left")


@query(f"WITH {E}, {MB} SELECT DISTINCT src AS cve_id, vendor FROM e JOIN mb ON dst = product WHERE rel = 'AFFECTS' AND regexp_full_match(vendor, '(?i).*LABS.*')")
def vendor_regex(spark, d):
    """A whole-string match, whatever the case."""
    wanted = vendors(spark, d).filter(F.col("vendor").rlike("(?i)^.*LABS.*$"))
    return edges(spark, d).filter("rel = 'AFFECTS'").join(wanted, F.col("dst") == F.col("product")).select(F.col("src").alias("cve_id"), "vendor").distinct()


@query(f"""WITH {E}, x AS (SELECT rel, dst AS id FROM e WHERE src = {FIRST} UNION SELECT rel, src FROM e WHERE dst = {FIRST}) SELECT rel, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM x GROUP BY rel""")
def ego_network(spark, d):
    """The neighbours of the first record, by kind of edge."""
    e = edges(spark, d)
    return g.neighbours(e, e.agg(F.min("src")).first()[0] or "").groupBy("rel").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


_KEYS = {"cves": "ingest_id", "nvd_records": "record_id", "cpe_components": "component_id", "product_nodes": "product_row", "cve_edges": "edge_id", "mitre_techniques": "sheet_row", "documents": "doc_id", "training_examples": "example_id"}


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows, count(DISTINCT {k}) AS n_keys FROM {t}" for t, k in _KEYS.items()))
def key_uniqueness(spark, d):
    """Rows and different keys of each table: uniqueness as a test."""
    parts = [table(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n_rows"), F.countDistinct(k).alias("n_keys")) for t, k in _KEYS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query(f"""WITH {E}, {NODES} SELECT rel, count(*) AS n FROM e WHERE EXISTS (SELECT 1 FROM nodes WHERE kind = 'CVE' AND id = src) AND
 EXISTS (SELECT 1 FROM nodes WHERE id = dst AND kind = CASE rel WHEN 'AFFECTS' THEN 'Product' WHEN 'HAS_WEAKNESS' THEN 'CWE' ELSE 'CAPEC' END) GROUP BY rel""")
def semi_edges(spark, d):
    """Edges of which both ends exist, by kind."""
    n = nodes(spark, d)
    kind = F.when(F.col("rel") == "AFFECTS", "Product").when(F.col("rel") == "HAS_WEAKNESS", "CWE").otherwise("CAPEC")
    e = edges(spark, d).withColumn("kind", kind).join(n.filter("kind = 'CVE'").select(F.col("id").alias("src")), "src", "left_semi")
    return g.counts_by(e.join(n.select("kind", F.col("id").alias("dst")), ["kind", "dst"], "left_semi"), "rel")


@query(f"""WITH {E}, near AS (SELECT DISTINCT dst FROM e WHERE src = {FIRST}) SELECT DISTINCT src AS id FROM e WHERE dst IN (SELECT dst FROM near) AND src <> {FIRST}""")
def two_hop_neighbours(spark, d):
    """Records that share a neighbour with the first record."""
    e = edges(spark, d)
    first = e.agg(F.min("src")).first()[0] or ""
    near = e.filter(F.col("src") == first).select("dst").distinct()
    return e.join(near, "dst", "left_semi").filter(F.col("src") != first).select(F.col("src").alias("id")).distinct()


@query(f"WITH {E}, {NODES} SELECT n_nodes, n_edges, round(n_edges / (n_nodes::DOUBLE * (n_nodes - 1)), 12) AS density, round(2 * n_edges / n_nodes::DOUBLE, 9) AS avg_degree FROM (SELECT count(*) AS n_nodes FROM nodes), (SELECT count(*) AS n_edges FROM e)")
def degree_density(spark, d):
    return g.density(nodes(spark, d), edges(spark, d))


@query(f"""WITH {E} SELECT rel, dst, count(*) AS size, min(src) AS first_member, max(src) AS last_member FROM e WHERE rel = 'HAS_WEAKNESS' GROUP BY rel, dst HAVING count(*) >= 5
 UNION ALL SELECT rel, dst, count(*), min(src), max(src) FROM e WHERE rel = 'AFFECTS' GROUP BY rel, dst HAVING count(*) >= 10""")
def clusters_having(spark, d):
    e = edges(spark, d)
    parts = [g.clusters(e, r, n).withColumn("rel", F.lit(r)) for r, n in (("HAS_WEAKNESS", 5), ("AFFECTS", 10))]
    return parts[0].unionByName(parts[1]).select("rel", "dst", "size", "first_member", "last_member")


def _scores(spark, d):
    return table(spark, d, "cves").select(F.col("cve_id").alias("src"), F.col("cvss_v3.base_score").alias("score"))


_SIMILAR = """deg AS (SELECT src, count(*) FILTER (rel = 'AFFECTS') AS d0, count(*) FILTER (rel = 'HAS_WEAKNESS') AS d1, count(*) FILTER (rel = 'HAS_ATTACK_PATTERN') AS d2 FROM e GROUP BY src),
 sh AS (SELECT q.src AS q, o.src AS other, count(*) FILTER (o.rel = 'AFFECTS') AS c0, count(*) FILTER (o.rel = 'HAS_WEAKNESS') AS c1, count(*) FILTER (o.rel = 'HAS_ATTACK_PATTERN') AS c2
   FROM e q JOIN e o ON q.rel = o.rel AND q.dst = o.dst AND q.src <> o.src WHERE q.src IN (SELECT src FROM queries) GROUP BY 1, 2),
 sc AS (SELECT cve_id AS src, max(cvss_v3.base_score) AS score FROM cves GROUP BY 1),
 sim AS (SELECT q AS src, other, (CASE WHEN x.score > 0 AND y.score > 0 THEN 1 - abs(x.score - y.score) / 10 ELSE 0 END * 0.1 + c1::DOUBLE / greatest(1, a.d1 + b.d1 - c1) * 0.4
   + c0::DOUBLE / greatest(1, a.d0 + b.d0 - c0) * 0.3 + c2::DOUBLE / greatest(1, a.d2 + b.d2 - c2) * 0.2) AS exact
   FROM sh JOIN deg a ON q = a.src JOIN deg b ON other = b.src LEFT JOIN sc x ON x.src = q LEFT JOIN sc y ON y.src = other),
 ranked AS (SELECT src, other, round(exact, 6) AS similarity, row_number() OVER (PARTITION BY src ORDER BY exact DESC, other) AS rank FROM sim WHERE exact > 0)"""


@query(f"WITH {E}, queries AS (SELECT {FIRST} AS src), {_SIMILAR} SELECT src, other, similarity, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10")
def similar_records(spark, d):
    """The ten records most like the first one."""
    e = edges(spark, d)
    return g.similar_records(e, _scores(spark, d), e.agg(F.min("src").alias("src")), 10)


@query(f"""WITH {E}, queries AS (SELECT src FROM (SELECT cve_id AS src, max(cvss_v3.base_score) AS s FROM cves WHERE cve_id IN (SELECT src FROM e) GROUP BY 1) WHERE s > 0 ORDER BY s DESC, src LIMIT 1000), {_SIMILAR}
 SELECT src, other, similarity, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 20""")
def similarity_matrix(spark, d):
    """The 20 most similar records of each of the 1000 with the highest scores."""
    e = edges(spark, d)
    s = _scores(spark, d).groupBy("src").agg(F.max("score").alias("score")).filter("score > 0").join(e.select("src").distinct(), "src", "left_semi")
    return g.similar_records(e, _scores(spark, d), s.orderBy(F.desc("score"), "src").limit(1000), 20)


_LINKS = "und AS (SELECT src, dst, count(*)::DOUBLE AS w FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) GROUP BY 1, 2), tot AS (SELECT src, sum(w) AS t FROM und GROUP BY 1), l AS (SELECT und.src, dst, w / t AS s FROM und JOIN tot USING (src)), n AS (SELECT count(*) AS n FROM tot)"


def _round(i: int) -> str:
    return f"r{i} AS (SELECT dst AS id, (1 - 0.85) / (SELECT n FROM n) + 0.85 * sum(rank * s) AS rank FROM l JOIN r{i - 1} ON id = src GROUP BY dst)"


@query(f"WITH {E}, {_LINKS}, r0 AS (SELECT src AS id, 1.0::DOUBLE / (SELECT n FROM n) AS rank FROM tot), {_round(1)}, {_round(2)}, {_round(3)} SELECT id, round(rank, 9) AS rank FROM r3")
def pagerank_rounds(spark, d):
    return g.pagerank(edges(spark, d), rounds=3, converge=False).select("id", F.round("rank", 9).alias("rank"))


@query()
def pagerank(spark, d):
    return g.pagerank(edges(spark, d), rounds=40)


@query()
def betweenness(spark, d):
    """Betweenness of every node of the graph of records."""
    return g.betweenness(edges(spark, d))
