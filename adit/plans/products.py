"""Queries on the product dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from adit.functions.identifiers import VENDOR_ALIASES
from adit.operators import products as p
from adit.plans.registry import query
from adit.runtime import table


def _text(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


_META = "meta(product, category, family, criticality, aliases) AS (VALUES " + ", ".join(
    f"({_text(name)}, {_text(c)}, {_text(f)}, {k}, {_text(', '.join(a))})" for name, (c, f, k, a) in p.KNOWN_PRODUCTS.items()
) + ")"
_TITLE = "array_to_string(list_transform(regexp_extract_all({0}, '[A-Za-z]+|[^A-Za-z]+'), lambda x: upper(x[1]) || lower(x[2:])), '')"
_KEYED = "k AS (SELECT *, coalesce(normalized_vendor, '') || ':' || coalesce(normalized_product, '') AS product_key FROM cpe_components)"
_PRODUCTS = f"""{_META}, {_KEYED},
 g AS (SELECT product_key, count(DISTINCT version_text) AS n_versions, count(*) AS vulnerability_count, count(DISTINCT cve_id) AS n_records, min(component_id) AS first_id FROM k GROUP BY 1),
 d AS (SELECT g.product_key, k.normalized_vendor AS vendor, k.normalized_product AS product, concat_ws(' ', k.vendor, k.product) AS display_name,
   coalesce(m.category, CASE k.cpe_part WHEN 'a' THEN 'Application' WHEN 'o' THEN 'Operating System' WHEN 'h' THEN 'Hardware' ELSE 'Unknown' END) AS category,
   coalesce(m.family, {_TITLE.format('k.product')}) AS family, coalesce(m.criticality, 5.0)::DOUBLE AS criticality_score, coalesce(m.aliases, k.product) AS aliases, n_versions, g.vulnerability_count, n_records
   FROM g JOIN k ON component_id = first_id LEFT JOIN meta m ON m.product = k.normalized_product)"""


def _dictionary(spark, d):
    return p.product_dictionary(table(spark, d, "cpe_components"))


@query(f"WITH {_PRODUCTS} SELECT * FROM d")
def product_dictionary(spark, d):
    """Products with category, family, criticality, aliases and counts."""
    return _dictionary(spark, d).withColumn("aliases", F.array_join("aliases", ", "))


@query(f"WITH {_KEYED} SELECT product_key, version_text AS version, count(*) AS vulnerability_count, count(DISTINCT cve_id) AS n_records FROM k WHERE version_text <> '*' GROUP BY 1, 2")
def product_version_nodes(spark, d):
    """Versions of products, wildcards left out."""
    return p.product_versions(table(spark, d, "cpe_components"))


_ALIASES = " ".join(f"WHEN {_text(n)} THEN {_text(', '.join(a))}" for n, a in VENDOR_ALIASES.items())


@query(f"""WITH {_KEYED}, g AS (SELECT normalized_vendor AS v, count(DISTINCT product_key) AS n_products, count(*) AS vulnerability_count, count(DISTINCT cve_id) AS n_records, min(component_id) FILTER (vendor IS NOT NULL) AS first_id FROM k WHERE normalized_vendor IS NOT NULL GROUP BY 1)
 SELECT v AS vendor, {_TITLE.format('k.vendor')} AS display_name, CASE v {_ALIASES} ELSE k.vendor END AS aliases, n_products, g.vulnerability_count, n_records FROM g LEFT JOIN k ON component_id = first_id""")
def vendor_dictionary(spark, d):
    """Vendors with aliases and counts, each described by its first identifier."""
    return p.vendor_dictionary(table(spark, d, "cpe_components").filter("vendor IS NOT NULL OR normalized_vendor IS NOT NULL")).withColumn("aliases", F.array_join("aliases", ", "))


@query(f"""WITH {_PRODUCTS} SELECT level, name, count(*) AS n_products, CAST(sum(vulnerability_count) AS BIGINT) AS vulnerability_count FROM (
 SELECT 'vendor' AS level, vendor AS name, vulnerability_count FROM d UNION ALL SELECT 'category', category, vulnerability_count FROM d UNION ALL SELECT 'family', family, vulnerability_count FROM d) GROUP BY 1, 2""")
def product_hierarchy(spark, d):
    return p.hierarchy(_dictionary(spark, d))


@query(f"""WITH {_PRODUCTS}, c AS (SELECT product, sum(vulnerability_count) AS counted, max(criticality_score) AS criticality FROM d GROUP BY 1)
 SELECT product_row, product_name, CAST(coalesce(counted, 0) AS BIGINT) AS counted, criticality FROM product_nodes LEFT JOIN c ON product = product_name""")
def product_counts(spark, d):
    """Counts joined back to the product dimension."""
    return p.counted_again(table(spark, d, "product_nodes").select("product_row", "product_name"), _dictionary(spark, d)).select("product_row", "product_name", "counted", "criticality")


@query(f"""WITH {_PRODUCTS}, m AS (SELECT vendor, product_key, vulnerability_count, row_number() OVER (PARTITION BY vendor ORDER BY vulnerability_count DESC, product_key) AS k FROM d WHERE vendor IS NOT NULL)
 SELECT vendor, CAST(k AS INTEGER) AS place, product_key, vulnerability_count FROM m WHERE k <= 5""")
def vendor_ecosystem(spark, d):
    """The five most named products of each vendor."""
    from adit.operators.relations import ranked_per_group

    rows = _dictionary(spark, d).filter("vendor IS NOT NULL").select("vendor", "product_key", "vulnerability_count")
    return ranked_per_group(rows, "vendor", [F.desc("vulnerability_count"), F.col("product_key")], 5, "place")


@query(f"WITH {_KEYED} SELECT DISTINCT product_key, cve_id FROM k WHERE cve_id IS NOT NULL")
def product_members(spark, d):
    """The records of each product, one row each."""
    from adit.operators.relations import product_key

    return table(spark, d, "cpe_components").filter("cve_id IS NOT NULL").select(product_key().alias("product_key"), "cve_id").distinct()


@query(f"""WITH {_PRODUCTS}, ven AS (SELECT v, {_TITLE.format("k2.vendor")} AS display_name, n FROM (SELECT normalized_vendor AS v, count(*) AS n, min(component_id) FILTER (vendor IS NOT NULL) AS first_id FROM k WHERE normalized_vendor IS NOT NULL GROUP BY 1) LEFT JOIN k k2 ON component_id = first_id)
 SELECT product_key, concat_ws(' | ', 'Product: ' || display_name_p, 'Vendor: ' || coalesce(display_name, ''), 'Category: ' || category, 'Family: ' || coalesce(family, ''), 'Criticality Score: ' || criticality_score, 'Aliases: ' || nullif(aliases, ''), 'Vulnerability Count: ' || vulnerability_count) AS text, n AS vendor_count
 FROM (SELECT * RENAME (display_name AS display_name_p) FROM d) LEFT JOIN ven ON vendor = v""")
def product_documents(spark, d):
    """Products of the dictionary as documents, with their vendors' facts."""
    from adit.operators.exports import product_documents as of

    c = table(spark, d, "cpe_components")
    rows = _dictionary(spark, d).withColumns({"product_name": F.col("product"), "versions": F.array().cast("array<string>")})
    return of(rows, p.vendor_dictionary(c.filter("vendor IS NOT NULL OR normalized_vendor IS NOT NULL"))).select("product_key", F.col("text_for_embedding").alias("text"), F.col("vendor_info.vulnerability_count").alias("vendor_count"))
