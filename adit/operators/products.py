"""The product dictionary: products and vendors with what is known of them, from parsed product identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adit.functions.identifiers import VENDOR_ALIASES
from adit.functions.texts import title
from adit.operators.relations import product_key

#: Known products with category, family, criticality and aliases; categories of other products by part.
KNOWN_PRODUCTS = {
    "android": ("Mobile OS", "Android", 9.0, ["android"]),
    "linux_kernel": ("Operating System", "Linux", 8.5, ["linux_kernel", "linux", "gnu_linux"]),
    "junos": ("Network OS", "Juniper Junos", 8.0, ["junos", "juniper_junos"]),
    "commerce": ("E-commerce", "Adobe Commerce", 8.0, ["commerce", "adobe_commerce", "magento_commerce"]),
    "checkmk": ("Monitoring", "Checkmk", 7.5, ["checkmk"]),
    "ios": ("Network OS", "Cisco IOS", 8.5, ["ios", "cisco_ios"]),
    "junos_os_evolved": ("Network OS", "Juniper Junos OS Evolved", 8.0, ["junos_os_evolved", "juniper_junos_os_evolved"]),
    "ios_xe": ("Network OS", "Cisco IOS XE", 8.5, ["ios_xe", "cisco_ios_xe"]),
    "adaptive_security_appliance_software": ("Security Appliance", "Cisco ASA", 8.5, ["adaptive_security_appliance_software", "cisco_asa"]),
    "magento": ("E-commerce", "Adobe Magento", 8.0, ["magento", "adobe_magento"]),
    "digital_experience_platform": ("Portal", "Liferay DXP", 7.5, ["digital_experience_platform", "liferay_dxp"]),
    "secure_firewall_management_center": ("Security Appliance", "Cisco Secure Firewall Management Center", 8.0, ["secure_firewall_management_center", "cisco_firewall_management_center"]),
    "windows_server_2012": ("Operating System", "Windows Server", 9.0, ["windows_server_2012", "windows_server", "microsoft_windows_server_2012"]),
    "nx-os": ("Network OS", "Cisco NX-OS", 8.0, ["nx-os", "cisco_nx-os"]),
    "identity_services_engine": ("Security Appliance", "Cisco ISE", 8.0, ["identity_services_engine", "cisco_ise"]),
    "macos": ("Operating System", "Apple macOS", 8.5, ["macos", "apple_macos", "osx"]),
    "windows_10_22h2": ("Operating System", "Windows 10", 9.0, ["windows_10_22h2", "windows_10", "microsoft_windows_10_22h2"]),
    "windows_10_1809": ("Operating System", "Windows 10", 9.0, ["windows_10_1809", "windows_10", "microsoft_windows_10_1809"]),
    "windows_server_2008": ("Operating System", "Windows Server", 8.5, ["windows_server_2008", "windows_server", "microsoft_windows_server_2008"]),
    "windows": ("Operating System", "Windows", 9.0, ["windows", "win", "microsoft_windows"]),
    "linux": ("Operating System", "Linux", 8.5, ["linux", "gnu_linux", "linux_kernel"]),
    "http_server": ("Web Server", "Apache HTTP Server", 8.0, ["apache", "httpd", "apache_httpd"]),
    "mysql": ("Database", "MySQL", 7.5, ["mysql", "mysql_server"]),
}
PART_CATEGORIES = {"a": "Application", "o": "Operating System", "h": "Hardware"}
UNKNOWN_CRITICALITY = 5.0


def _known(key: Column, place: int, kind: str) -> Column:
    """A field of a known product; null for others."""
    pairs = [x for name, values in KNOWN_PRODUCTS.items() for x in (F.lit(name), F.array(*[F.lit(v) for v in values[place]]) if isinstance(values[place], list) else F.lit(values[place]))]
    return F.try_element_at(F.create_map(*pairs), key).cast(kind)


def described(product: Column, raw_vendor: Column, raw_product: Column, part: Column) -> dict[str, Column]:
    """display_name, category, family, criticality_score and aliases of a product, as its first identifier tells them."""
    by_part = F.create_map(*[F.lit(x) for kv in PART_CATEGORIES.items() for x in kv])
    return {
        "display_name": F.concat_ws(" ", raw_vendor, raw_product),
        "category": F.coalesce(_known(product, 0, "string"), F.try_element_at(by_part, part), F.lit("Unknown")),
        "family": F.coalesce(_known(product, 1, "string"), title(raw_product)),
        "criticality_score": F.coalesce(_known(product, 2, "double"), F.lit(UNKNOWN_CRITICALITY)),
        "aliases": F.coalesce(_known(product, 3, "array<string>"), F.array(raw_product)),
    }


def product_dictionary(components: DataFrame) -> DataFrame:
    """One row per product: product_key, vendor, product, display_name, category, family, criticality_score, aliases,
    n_versions, vulnerability_count (identifiers that name it) and n_records.

    components has one parsed identifier per row (component_id, cve_id, cpe_part, vendor, product, version_text,
    normalized_vendor, normalized_product). What describes a product comes from its first row by component_id. Null
    names count as empty ones; null versions are no versions.
    """
    c = F.col
    first = F.min_by(F.struct("vendor", "product", "cpe_part", "normalized_vendor", "normalized_product"), "component_id").alias("f")
    grouped = components.withColumn("product_key", product_key()).groupBy("product_key").agg(
        first, F.countDistinct("version_text").alias("n_versions"), F.count("*").alias("vulnerability_count"), F.countDistinct("cve_id").alias("n_records")
    )
    facts = described(c("f.normalized_product"), c("f.vendor"), c("f.product"), c("f.cpe_part"))
    return grouped.select("product_key", c("f.normalized_vendor").alias("vendor"), c("f.normalized_product").alias("product"), *[v.alias(n) for n, v in facts.items()], "n_versions", "vulnerability_count", "n_records")


def product_versions(components: DataFrame) -> DataFrame:
    """The versions of each product, without '*': product_key, version, vulnerability_count, n_records."""
    named = components.filter(F.col("version_text") != "*").withColumn("product_key", product_key())
    return named.groupBy("product_key", F.col("version_text").alias("version")).agg(F.count("*").alias("vulnerability_count"), F.countDistinct("cve_id").alias("n_records"))


def vendor_dictionary(components: DataFrame) -> DataFrame:
    """One row per vendor: vendor, display_name, aliases, n_products, vulnerability_count and n_records."""
    rows = components.filter(F.col("normalized_vendor").isNotNull())
    grouped = rows.groupBy(F.col("normalized_vendor").alias("vendor")).agg(
        F.min_by("vendor", "component_id").alias("raw"), F.countDistinct(product_key()).alias("n_products"), F.count("*").alias("vulnerability_count"), F.countDistinct("cve_id").alias("n_records")
    )
    known = F.create_map(*[x for name, others in VENDOR_ALIASES.items() for x in (F.lit(name), F.array(*[F.lit(o) for o in others]))])
    return grouped.select("vendor", title(F.col("raw")).alias("display_name"), F.coalesce(F.try_element_at(known, F.col("vendor")), F.array("raw")).alias("aliases"), "n_products", "vulnerability_count", "n_records")


def hierarchy(products: DataFrame) -> DataFrame:
    """Products and identifiers by vendor, by category and by family: level, name, n_products, vulnerability_count."""
    cells = F.array(*[F.struct(F.lit(x).alias("level"), F.col(x).alias("name")) for x in ("vendor", "category", "family")])
    return products.select(F.inline(cells), "vulnerability_count").groupBy("level", "name").agg(F.count("*").alias("n_products"), F.sum("vulnerability_count").alias("vulnerability_count"))


def counted_again(nodes: DataFrame, products: DataFrame) -> DataFrame:
    """nodes (with product_name) with the counts of the dictionary joined back; 0 where nothing names the product.

    A name may be that of several vendors' products: their counts are added before the join.
    """
    counts = products.groupBy(F.col("product").alias("product_name")).agg(F.sum("vulnerability_count").alias("counted"), F.max("criticality_score").alias("criticality"))
    return nodes.join(counts, "product_name", "left").withColumn("counted", F.coalesce("counted", F.lit(0)))
