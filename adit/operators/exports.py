"""Texts and documents of records and products: content, texts for embedding, and what retrieval is given."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adit.functions import texts as t
from adit.functions.identifiers import parent_technique, record_year
from adit.runtime import small_enough

_STRINGS = "array<string>"
#: The five families of edges as the lists of a document.
LISTS = {"AFFECTS": "related_products", "HAS_WEAKNESS": "weaknesses", "HAS_ATTACK_PATTERN": "attack_patterns", "USES_TECHNIQUE": "mitre_techniques", "BELONGS_TO_TACTIC": "mitre_tactics"}
#: Fixed value: the line of records that are known to be exploited.
EXPLOITED = "WARNING: This vulnerability is in CISA's Known Exploited Vulnerabilities (KEV) catalog"


def _fields(df: DataFrame, path: str) -> bool:
    """Whether df has a column, or a field of a struct column."""
    schema = df.schema
    for part in path.split("."):
        if not hasattr(schema, "fieldNames") or part not in schema.fieldNames():
            return False
        schema = schema[part].dataType
    return True


def _get(df: DataFrame, path: str, kind: str = "string") -> Column:
    """A field that may be missing."""
    return F.col(path) if _fields(df, path) else F.lit(None).cast(kind)


def _list(df: DataFrame, *names: str) -> Column:
    """The first of the list columns that df has, without null elements; an empty list where there is none."""
    name = next((n for n in names if _fields(df, n)), None)
    return F.array_compact(F.coalesce(F.col(name), F.array().cast(_STRINGS))) if name else F.array().cast(_STRINGS)


def _joined(label: str, values: Column, limit: int | None = None) -> Column:
    return t.labelled(label, t.joined(values, limit))


def _scored(score: Column, text: Column) -> Column:
    """A line that needs a score; 0 is none."""
    return F.when(score != 0, text)


def content(df: DataFrame) -> Column:
    """A record's content: what is known of it, line by line, in a fixed order, without empty lines.

    Columns that df hasn't are empty: cvss_v2, mitre_tactics, advisory_ids, exploit_ids and references may be missing.
    """
    version = F.coalesce(_get(df, "cvss_v3.version"), _get(df, "cvss_v3.cvss_version"), F.lit("3.x"))
    s3, s2 = _get(df, "cvss_v3.base_score", "double"), _get(df, "cvss_v2.base_score", "double")
    head3 = F.concat(F.lit("CVSS v"), version)
    severity = lambda path: F.coalesce(_get(df, path), F.lit("Unknown"))
    return t.lines(
        F.col("description"),
        _scored(s3, F.concat(head3, F.lit(" Score: "), s3.cast("string"), F.lit(" ("), severity("cvss_v3.base_severity"), F.lit(")"))),
        _scored(s3, t.after(F.concat(head3, F.lit(" Vector: ")), _get(df, "cvss_v3.vector_string"))),
        _scored(s2, F.concat(F.lit("CVSS v2.0 Score: "), s2.cast("string"), F.lit(" ("), severity("cvss_v2.severity"), F.lit(")"))),
        _scored(s2, t.labelled("CVSS v2.0 Vector: ", _get(df, "cvss_v2.vector_string"))),
        _joined("Affected Products: ", _list(df, "affected_products"), 5),
        _joined("Related CWEs: ", _list(df, "cwe_refs", "cwe_ids")),
        _joined("Related CAPECs: ", _list(df, "capec_entries"), 3),
        _joined("MITRE ATT&CK Techniques: ", _list(df, "mitre_techniques"), 3),
        _joined("MITRE ATT&CK Tactics: ", _list(df, "mitre_tactics"), 3),
        F.when(F.col("is_in_kev"), EXPLOITED),
        _joined("CSAF Advisories: ", _list(df, "advisory_ids"), 3),
        _joined("ExploitDB IDs: ", _list(df, "exploit_ids"), 3),
        _joined("References: ", _list(df, "references"), 3),
    )


def embedding_text(df: DataFrame, related: bool = False) -> Column:
    """A record's text for embedding, its parts joined by ' | ', without empty ones.

    df has id, title, description, the scores, affected_products, tags and, as far as they are known, the lists. With
    `related`, the lists are those of the graph's edges, among them related_products.
    """
    s3, s2 = _get(df, "cvss_v3.base_score", "double"), _get(df, "cvss_v2.base_score", "double")
    figure = lambda label, score: _scored(score, F.concat(F.lit(label), score.cast("string")))
    weak, pattern = (("weaknesses",), ("attack_patterns",)) if related else (("cwe_refs",), ("capec_entries",))
    return t.lines(
        F.concat(F.lit("CVE ID: "), F.coalesce("id", F.lit(""))),
        t.labelled("Title: ", F.col("title")),
        t.labelled("Description: ", F.col("description")),
        t.labelled("Severity: ", _get(df, "cvss_v3.base_severity")),
        figure("CVSS v3 Score: ", s3),
        t.labelled("CVSS v3 Vector: ", _get(df, "cvss_v3.vector_string")),
        figure("CVSS v2 Score: ", s2),
        t.labelled("CVSS v2 Vector: ", _get(df, "cvss_v2.vector_string")),
        t.labelled("Attack Vector: ", _get(df, "cvss_v3.attack_vector")),
        t.labelled("Attack Complexity: ", _get(df, "cvss_v3.attack_complexity")),
        _joined("Affected Products: ", _list(df, "affected_products")),
        _joined("Related Products: ", _list(df, "related_products")) if related else F.lit(None).cast("string"),
        _joined("Common Weaknesses: ", _list(df, *weak)),
        _joined("Attack Patterns: ", _list(df, *pattern)),
        _joined("MITRE ATT&CK Techniques: ", _list(df, "mitre_techniques")),
        _joined("MITRE ATT&CK Tactics: ", _list(df, "mitre_tactics")),
        _joined("Tags: ", _list(df, "tags")),
        separator=" | ",
    )


def record_documents(cves: DataFrame, edges: DataFrame, key: str = "cve_id") -> DataFrame:
    """Records with the neighbours of their edges as sorted lists, and the text for embedding that they make.

    cves has one row per key, and id. Every family of edges is nested before the join, so that none multiplies another;
    the lists are a document's own. Edges of other kinds are ignored. A record without edges has empty lists.
    """
    lists = [F.array_sort(F.collect_set(F.when(F.col("rel") == rel, F.col("dst")))).alias(name) for rel, name in LISTS.items()]
    nested = edges.groupBy(F.col("src").alias(key)).agg(*lists)
    base = cves.drop(*[c for c in LISTS.values() if c in cves.columns])
    both = base.join(nested, key, "left").withColumns({n: F.coalesce(n, F.array().cast(_STRINGS)) for n in LISTS.values()})
    document = both.withColumn("text_for_embedding", embedding_text(both, True))
    return document.withColumn("metadata", metadata({"document_type": F.lit("CVE"), "severity": F.coalesce(_get(both, "cvss_v3.base_severity"), F.lit("UNKNOWN")), "cvss_score": _get(both, "cvss_v3.base_score"), "products": F.col("affected_products") if "affected_products" in both.columns else F.lit(None)}, both))


def metadata(fields: dict[str, Column], df: DataFrame | None = None) -> Column:
    """A map of texts: lists joined by ', ', other values as texts, nulls left out."""
    kinds = df.limit(0).select(*[v.alias(n) for n, v in fields.items()]).schema if df is not None else None
    pairs = []
    for name, value in fields.items():
        text = F.array_join(value, ", ") if kinds is not None and kinds[name].dataType.typeName() == "array" else value.cast("string")
        pairs += [F.lit(name), text]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def product_text(vendor: Column, figures: bool) -> Column:
    """A product's text for embedding; with figures, also its criticality and number of records.

    Fields: display_name, category, family, aliases, versions, criticality_score, vulnerability_count.
    """
    always = lambda label, c: F.concat(F.lit(label), F.coalesce(c.cast("string"), F.lit("")))
    own = lambda c: F.array_compact(F.coalesce(c, F.array().cast(_STRINGS)))
    more = [always("Criticality Score: ", F.coalesce("criticality_score", F.lit(0.0)))] if figures else []
    last = [always("Vulnerability Count: ", F.coalesce("vulnerability_count", F.lit(0)))] if figures else []
    return t.lines(
        always("Product: ", F.col("display_name")), always("Vendor: ", vendor), always("Category: ", F.col("category")), always("Family: ", F.col("family")), *more,
        _joined("Aliases: ", own("aliases")), _joined("Versions: ", own("versions")), *last, separator=" | ",
    )


def record_statistics(cves: DataFrame) -> DataFrame:
    """Figures of records for an export: figure and n. Severities and flags by row, dimensions by different elements."""
    dims = {"products": "affected_products", "vendors": "affected_vendors", "weaknesses": "cwe_refs", "patterns": "capec_entries", "techniques": "mitre_techniques"}
    flags = cves.agg(F.count("*").alias("records"), F.count_if(F.col("is_in_kev")).alias("exploited"), F.count_if(F.coalesce("cvss_v3.base_score", F.lit(0.0)) > 0).alias("with score"))
    rows = flags.select(F.inline(F.array(*[F.struct(F.lit(c).alias("figure"), F.col(f"`{c}`").alias("n")) for c in flags.columns])))
    severity = cves.groupBy(F.concat(F.lit("severity "), F.coalesce("cvss_v3.base_severity", F.lit("UNKNOWN"))).alias("figure")).agg(F.count("*").alias("n"))
    cells = cves.select(F.inline(F.array(*[F.struct(F.lit(n).alias("figure"), F.col(c).alias("a")) for n, c in dims.items()])))
    different = cells.select("figure", F.explode("a").alias("x")).groupBy("figure").agg(F.countDistinct("x").alias("n"))
    return reduce(DataFrame.unionByName, [rows, severity, different])


def index_entries(cves: DataFrame, key: str = "cve_id") -> DataFrame:
    """Seven inverted indexes as rows (idx, key, cve_id), each once: year, severity, weakness, pattern, tactic (the
    technique of a sub-technique), technique and keyword. Null keys and records without an id are left out."""
    none = F.array().cast(_STRINGS)
    lower = lambda a: F.transform(a, lambda v: F.lower(v))
    techniques = F.coalesce("mitre_techniques", none)
    cells = {
        "year": F.array(record_year(F.col(key))),
        "severity": F.array(F.lower(F.coalesce("cvss_v3.base_severity", F.lit("unknown")))),
        "weakness": F.coalesce("cwe_refs", none),
        "pattern": F.coalesce("capec_entries", none),
        "tactic": lower(F.array_compact(F.transform(techniques, parent_technique))),
        "technique": lower(techniques),
        "keyword": t.keywords(F.col("description"), F.col("affected_products")),
    }
    rows = cves.filter(F.col(key).isNotNull()).select(F.col(key).alias("cve_id"), F.inline(F.array(*[F.struct(F.lit(n).alias("idx"), a.alias("keys")) for n, a in cells.items()])))
    return rows.select("idx", F.explode("keys").alias("key"), "cve_id").filter("key IS NOT NULL").distinct()


def direct_documents(records: DataFrame) -> DataFrame:
    """Records as documents for retrieval, without a graph: 16 fields and text_for_embedding.

    records: id, title, content (as description) and what is known of them; fields that they haven't are null or empty.
    """
    base = records.withColumn("description", F.col("content")) if "content" in records.columns else records
    texts, lists = ("title", "description", "source", "published_date", "last_modified_date"), ("affected_products", "cwe_refs", "capec_entries", "mitre_techniques", "mitre_tactics", "tags")
    columns = ["id"] + [F.coalesce(_get(base, c), F.lit("")).alias(c) for c in texts] + [F.col(c) for c in ("cvss_v3", "cvss_v2", "cpe_configurations") if c in base.columns] + [_list(base, c).alias(c) for c in lists]
    return base.select(*columns, F.coalesce(_get(base, "is_in_kev", "boolean"), F.lit(False)).alias("is_in_kev"), embedding_text(base).alias("text_for_embedding"))


def product_documents(products: DataFrame, vendors: DataFrame) -> DataFrame:
    """Products as documents for retrieval, with their vendor's facts and metadata; a product of an unknown vendor keeps none.

    products: product_key, product_name, vendor and the fields of product_text. vendors: vendor, display_name, vulnerability_count, n_products.
    """
    facts = vendors.select("vendor", F.struct(F.col("vendor").alias("name"), "display_name", "vulnerability_count", F.col("n_products").alias("product_count")).alias("vendor_info"))
    both = products.join(F.broadcast(facts) if small_enough(facts) else facts, "vendor", "left")
    about = metadata({"document_type": F.lit("PRODUCT"), "category": F.col("category"), "family": F.col("family"), "criticality": F.col("criticality_score")})
    return both.withColumns({"text_for_embedding": product_text(F.col("vendor_info.display_name"), True), "metadata": about})


def pattern_documents(patterns: DataFrame) -> DataFrame:
    """Attack patterns (capec_id, name, description) as documents: id, document_type, title, content."""
    return patterns.filter(F.col("capec_id") != "").select(F.col("capec_id").alias("id"), F.lit("CAPEC").alias("document_type"), F.coalesce("name", "capec_id").alias("title"), F.trim(F.coalesce("description", F.lit(""))).alias("content"))


def advisory_documents(advisories: DataFrame) -> DataFrame:
    """Advisories (id, title, cve_ids) as documents; an id in capital letters. Those without an id are left out."""
    return advisories.filter(F.col("id") != "").select(F.upper("id").alias("id"), F.lit("CSAF").alias("document_type"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("cve_ids", F.array().cast(_STRINGS)).alias("cve_refs"))


def technique_tactics(techniques: DataFrame, tactics: DataFrame, key: str = "technique_id", packed: str = "tactics") -> DataFrame:
    """Techniques with the ids of the tactics that they name, in order: key, tactic_ids. Names that no tactic has are left out.

    tactics: tactic_name, tactic_id, one row per name. packed is a list of names behind commas. A technique without known
    tactics has an empty list.
    """
    named = techniques.filter(F.trim(key) != "").select(key, F.posexplode_outer(t.listed(F.coalesce(packed, F.lit("")), ",")).alias("place", "tactic_name"))
    side = F.broadcast(tactics) if small_enough(tactics) else tactics
    found = named.join(side.select("tactic_name", "tactic_id"), "tactic_name", "left")
    rows = found.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("tactic_id").isNotNull(), F.struct("place", "tactic_id")))).alias("a"))
    return rows.select(key, F.transform("a", lambda v: v["tactic_id"]).alias("tactic_ids"))
