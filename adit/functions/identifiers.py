"""Column functions on identifiers: product identifiers, versions, vendors, weaknesses, techniques."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The parts of a 2.3 product identifier, in order.
PARTS = ("part", "vendor", "product", "version", "update", "edition", "language", "sw_edition", "target_sw", "target_hw", "other")
#: Canonical vendors with what they are also called, and suffixes that say nothing.
VENDOR_ALIASES = {
    "microsoft": ["microsoft", "ms", "msft", "redmond"],
    "apache": ["apache", "apache_software_foundation", "asf"],
    "oracle": ["oracle", "oracle_corporation", "sun_microsystems"],
    "google": ["google", "alphabet", "google_llc"],
    "amazon": ["amazon", "aws", "amazon_web_services"],
    "redhat": ["redhat", "red_hat", "rh"],
    "canonical": ["canonical", "ubuntu"],
    "mozilla": ["mozilla", "mozilla_foundation"],
    "adobe": ["adobe", "adobe_systems", "macromedia"],
    "ibm": ["ibm", "international_business_machines"],
}
VENDOR_SUFFIXES = ("the", "inc", "corp", "corporation", "ltd", "limited", "llc")
#: Variants of product names, the first that is contained wins.
PRODUCT_VARIANTS = {
    "http server": "http_server",
    "web server": "web_server",
    "mysql server": "mysql",
    "sql server": "sql_server",
    "internet explorer": "internet_explorer",
}
#: Kinds of versions, the first that matches wins.
VERSION_KINDS = (
    ("semantic", r"^(\d+)\.(\d+)(?:\.(\d+))?(?:\.(\d+))?"),
    ("date_based", r"^(\d{4})(?:\.(\d{2}))?(?:\.(\d{2}))?"),
    ("build_number", r"^(\d+)(?:\.(\d+))*(?:-(\w+))?"),
    ("alpha_beta", r"^(\d+\.?\d*)\s*-?\s*(alpha|beta|rc|release|final)"),
    ("windows_version", r"^(vista|xp|2000|2003|2008|2012|2016|2019|2022)"),
)


def percent_decoded(c: Column) -> Column:
    """Percent codes resolved; a plus stays a plus, and text with broken codes stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def product_of(c: Column) -> Column:
    """The product of an identifier; '' where it has too few parts."""
    return F.coalesce(F.get(F.split(c, ":"), F.lit(4)), F.lit(""))


def unescaped_product(c: Column) -> Column:
    return F.replace(c, F.lit("\\/"), F.lit("//"))


def parsed(c: Column) -> Column:
    """The eleven parts of a 2.3 identifier as a struct; null for other text. Missing parts are '*', '-' is ''."""
    given = F.split(F.substring(c, 9, 1 << 20), ":")
    padded = F.slice(F.concat(given, F.array_repeat(F.lit("*"), len(PARTS))), 1, len(PARTS))
    part = lambda i: F.when(padded[i] == "*", "*").when(padded[i] == "-", "").otherwise(percent_decoded(padded[i]))
    return F.when(c.startswith("cpe:2.3:"), F.struct(*[part(i).alias(n) for i, n in enumerate(PARTS)]))


def normal_vendor(c: Column) -> Column:
    """Canonical vendor by alias, else in small letters with underscores. Both sides of the comparison are written alike."""
    spoken = F.replace(F.lower(c), F.lit("_"), F.lit(" "))
    for s in sorted(VENDOR_SUFFIXES, key=len, reverse=True):
        spoken = F.replace(spoken, F.lit(f" {s}"), F.lit(""))
    known = {a.replace("_", " "): name for name, aliases in VENDOR_ALIASES.items() for a in aliases}
    lookup = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.when(c.isNull() | c.isin("", "*"), c).otherwise(F.coalesce(F.try_element_at(lookup, spoken), F.replace(F.lower(c), F.lit(" "), F.lit("_"))))


def normal_product(c: Column) -> Column:
    spoken = F.replace(F.lower(c), F.lit("_"), F.lit(" "))
    out = F.when(c.isNull() | c.isin("", "*"), c)
    for variant, name in PRODUCT_VARIANTS.items():
        out = out.when(spoken.contains(variant), name)
    return out.otherwise(F.replace(F.lower(c), F.lit(" "), F.lit("_")))


def is_wildcard(vendor: Column, product: Column, version: Column) -> Column:
    return F.coalesce(vendor == "*", F.lit(False)) | F.coalesce(product == "*", F.lit(False)) | F.coalesce(version == "*", F.lit(False))


def confidence(vendor: Column, product: Column, version: Column) -> Column:
    """1 less 0.3, 0.4 and 0.2 for a wildcard vendor, product and version, and 0.1 for each name of at most two letters; not below 0."""
    off = lambda cond, by: F.when(cond, by).otherwise(0.0)
    short = lambda c: (F.length(c) <= 2) & (c != "*")
    total = F.lit(1.0) - off(vendor == "*", 0.3) - off(product == "*", 0.4) - off(version == "*", 0.2) - off(short(vendor), 0.1) - off(short(product), 0.1)
    return F.round(F.greatest(F.lit(0.0), total), 6)


def version_kind(c: Column) -> Column:
    out = F.when(c.isNull() | c.isin("", "*"), "unknown")
    for kind, pattern in VERSION_KINDS:
        out = out.when(c.rlike(pattern), kind)
    return out.otherwise("custom")


def version_number(c: Column, place: int) -> Column:
    """Number 1 to 4 of a semantic version, 0 where it is missing; null for other kinds."""
    return F.when(version_kind(c) == "semantic", F.coalesce(F.regexp_extract(c, VERSION_KINDS[0][1], place).try_cast("bigint"), F.lit(0).cast("bigint")))


def weakness_id(c: Column) -> Column:
    """CWE-n from any spelling with a number; null without."""
    return F.when(F.upper(c).startswith("CWE-"), F.upper(c)).when(c.rlike(r"^\d+$"), F.concat(F.lit("CWE-"), c)).when(
        c.rlike(r"(?i)cwe[- ]?\d"), F.concat(F.lit("CWE-"), F.regexp_extract(c, r"(?i)cwe[- ]?(\d+)", 1))
    )


def first_number(c: Column) -> Column:
    return F.regexp_extract(c, r"\d+", 0)


def parent_technique(c: Column) -> Column:
    """The technique of a sub-technique; null for others."""
    return F.when(c.contains("."), F.substring_index(c, ".", 1))


def record_year(c: Column) -> Column:
    return F.get(F.split(c, "-"), F.lit(1))


def ids_in(c: Column) -> Column:
    """Record identifiers that a text names, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"CVE-\d{4}-\d+"), F.lit(0)))
