"""Records of both feed dialects in one form, their enrichment by keyed lookups, and documents of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adit.functions.identifiers import parent_technique, product_of, unescaped_product
from adit.functions.texts import REJECTED, contains_any, labelled, lines, tags
from adit.operators.exports import content
from adit.runtime import small_enough

_STRINGS = "array<string>"


def _first_english(texts: Column) -> Column:
    return F.coalesce(F.get(F.transform(F.filter(texts, lambda x: x["lang"] == "en"), lambda x: x["value"]), F.lit(0)), F.lit(""))


def _some(a: Column, kind: str = _STRINGS) -> Column:
    return F.coalesce(a, F.array().cast(kind))


def _urls(refs: Column) -> Column:
    return F.filter(_some(F.transform(refs, lambda x: x["url"])), lambda u: u.isNotNull() & (u != ""))


def _weaknesses(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(_some(values), lambda x: x.startswith("CWE-"))))


def _products(identifiers: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(_some(identifiers), lambda c: unescaped_product(product_of(c))), lambda p: p != "")))


def normalised_1(items: DataFrame) -> DataFrame:
    """1.1 items as records: cve_id, description, weaknesses, references, identifiers (children's included), products, scores, dates."""
    weak = F.flatten(F.flatten(F.transform("cve.problemtype.problemtype_data", lambda p: F.array(F.transform(p["description"], lambda d: d["value"])))))
    nodes = F.col("configurations.nodes")
    uris = lambda m: F.coalesce(F.transform(m, lambda x: x["cpe23Uri"]), F.array().cast(_STRINGS))
    found = F.flatten(F.transform(nodes, lambda n: F.concat(uris(n["cpe_match"]), F.coalesce(F.flatten(F.transform(n["children"], lambda c: uris(c["cpe_match"]))), F.array().cast(_STRINGS)))))
    v3, v2 = F.col("impact.baseMetricV3.cvssV3"), F.col("impact.baseMetricV2")
    return items.select(
        F.col("cve.CVE_data_meta.ID").alias("cve_id"),
        _first_english(F.col("cve.description.description_data")).alias("description"),
        _weaknesses(weak).alias("cwe_ids"),
        _urls(F.col("cve.references.reference_data")).alias("references"),
        F.array_compact(_some(found)).alias("identifiers"),
        _products(found).alias("affected_products"),
        _score3(v3, F.lit("3.0")).alias("cvss_v3"),
        F.when(v2["cvssV2"]["baseScore"].isNotNull(), F.struct(v2["cvssV2"]["baseScore"].alias("base_score"), v2["severity"].alias("severity"), v2["cvssV2"]["vectorString"].alias("vector_string"))).alias("cvss_v2"),
        F.col("publishedDate").alias("published_date"),
        F.col("lastModifiedDate").alias("last_modified_date"),
        F.lit("1.1").alias("dialect"),
    ).filter("cve_id <> ''")


def _score3(v: Column, version: Column) -> Column:
    """Score, severity and vector; null as a whole without a score."""
    return F.when(v["baseScore"].isNotNull(), F.struct(version.alias("version"), v["baseScore"].alias("base_score"), v["baseSeverity"].alias("base_severity"), v["vectorString"].alias("vector_string")))


def normalised_2(records: DataFrame) -> DataFrame:
    """2.0 records in the same form; the 3.1 score goes before the 3.0 one."""
    weak = F.flatten(F.transform("weaknesses", lambda w: F.transform(F.filter(w["description"], lambda d: d["lang"] == "en"), lambda d: d["value"])))
    uris = lambda m: F.coalesce(F.transform(m, lambda x: x["criteria"]), F.array().cast(_STRINGS))
    found = F.flatten(
        F.transform("configurations", lambda k: F.flatten(F.transform(k["nodes"], lambda n: F.concat(uris(n["cpeMatch"]), F.coalesce(F.flatten(F.transform(n["children"], lambda c: uris(c["cpeMatch"]))), F.array().cast(_STRINGS))))))
    )
    v31, v30, v2 = (F.get(F.col(f"metrics.{m}"), F.lit(0)) for m in ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2"))
    return records.select(
        F.col("id").alias("cve_id"),
        _first_english(F.col("descriptions")).alias("description"),
        _weaknesses(weak).alias("cwe_ids"),
        _urls(F.col("references")).alias("references"),
        F.array_compact(_some(found)).alias("identifiers"),
        _products(found).alias("affected_products"),
        F.coalesce(_score3(v31["cvssData"], F.lit("3.1")), _score3(v30["cvssData"], F.lit("3.0"))).alias("cvss_v3"),
        F.when(v2["cvssData"]["baseScore"].isNotNull(), F.struct(v2["cvssData"]["baseScore"].alias("base_score"), v2["baseSeverity"].alias("severity"), v2["cvssData"]["vectorString"].alias("vector_string"))).alias("cvss_v2"),
        F.col("published").alias("published_date"),
        F.col("lastModified").alias("last_modified_date"),
        F.lit("2.0").alias("dialect"),
    ).filter("cve_id <> ''")


def current(records: DataFrame) -> DataFrame:
    """The latest record of each id by its modification date; rejected ones are left out."""
    rest = [c for c in records.columns if c != "cve_id"]
    best = records.groupBy("cve_id").agg(F.max_by(F.struct(*rest), F.struct(F.coalesce("last_modified_date", F.lit("")), "dialect")).alias("r")).select("cve_id", "r.*")
    return best.filter(~contains_any(F.col("description"), REJECTED))


def enriched(records: DataFrame, exploited: DataFrame, advisories: DataFrame, exploits: DataFrame, mapping: DataFrame) -> DataFrame:
    """Records with is_in_kev, advisory and exploit ids, and the patterns, techniques and parent techniques of their weaknesses.

    Every many-side is nested by its key before it is joined. exploited: id; advisories: cve_id, advisory_id; exploits:
    cve_id, exploit_id; mapping: weakness, capecs, mitre_techniques.
    """
    kev = exploited.select(F.col("id").alias("cve_id")).distinct().withColumn("is_in_kev", F.lit(True))
    adv = advisories.groupBy("cve_id").agg(F.array_sort(F.collect_set("advisory_id")).alias("advisory_ids"))
    exp = exploits.groupBy("cve_id").agg(F.array_sort(F.collect_set("exploit_id")).alias("exploit_ids"))
    found = records.select("cve_id", F.explode("cwe_ids").alias("weakness"))
    side = F.broadcast(mapping) if small_enough(mapping) else mapping
    looked = found.join(side.select("weakness", "capecs", "mitre_techniques"), "weakness").groupBy("cve_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("capecs")))).alias("capec_entries"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("mitre_techniques")))).alias("mitre_techniques")
    )
    out = records
    for part in (kev, adv, exp, looked):
        out = out.join(part, "cve_id", "left")
    for c in ("advisory_ids", "exploit_ids", "capec_entries", "mitre_techniques"):
        out = out.withColumn(c, _some(F.col(c)))
    parents = F.array_sort(F.array_distinct(F.array_compact(F.transform("mitre_techniques", parent_technique))))
    return out.withColumn("is_in_kev", F.coalesce("is_in_kev", F.lit(False))).withColumn("parent_techniques", parents)


def weakness_mapping(weaknesses: DataFrame, patterns: DataFrame, techniques: DataFrame) -> DataFrame:
    """weakness, capecs, mitre_techniques, mitre_description from weaknesses (cwe_id, capecs), patterns (capec_id,
    techniques) and technique texts (technique_id, description): two hops; the text is that of the last technique by id."""
    pairs = weaknesses.select(F.col("cwe_id").alias("weakness"), F.explode("capecs").alias("capec_id"))
    hop = pairs.join(patterns.select("capec_id", F.explode_outer("techniques").alias("technique_id")), "capec_id", "left")
    named = hop.join(techniques.groupBy("technique_id").agg(F.max("description").alias("d")), "technique_id", "left")
    return named.groupBy("weakness").agg(
        F.array_sort(F.collect_set("capec_id")).alias("capecs"), F.array_sort(F.collect_set("technique_id")).alias("mitre_techniques"), F.max_by("d", F.when(F.col("d").isNotNull(), F.col("technique_id"))).alias("mitre_description")
    )


def combined_techniques(mapped: Column, inferred: Column) -> Column:
    """Mapped techniques, then inferred ones that are new, each once in order."""
    a, b = _some(mapped), _some(inferred)
    return F.array_distinct(F.concat(a, F.array_except(b, a)))


def documents_of(records: DataFrame) -> DataFrame:
    """Documents of enriched records: id, title, content, document_type and what retrieval filters by."""
    c = F.col
    return records.filter("description <> ''").select(
        c("cve_id").alias("id"), F.concat(F.lit("CVE "), "cve_id").alias("title"), content(records).alias("content"), F.lit("CVE").alias("document_type"), c("cwe_ids").alias("cwe_refs"), "capec_entries", "mitre_techniques", "affected_products",
        "cvss_v3", "published_date", "last_modified_date", "is_in_kev", tags(c("cwe_ids"), c("affected_products"), c("capec_entries"), c("mitre_techniques"), c("is_in_kev"), c("mitre_tactics") if "mitre_tactics" in records.columns else None).alias("tags"),
    )


def exploited_documents(exploited: DataFrame) -> DataFrame:
    """Documents of the exploited list, of their own kind; union them by name with allowMissingColumns. Rows without an id have none."""
    part = lambda label, c, none="Unknown": F.concat(F.lit(label), F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(none)) if c in exploited.columns else F.lit(none))
    more = lambda label, c: labelled(label, F.col(c)) if c in exploited.columns else F.lit(None).cast("string")
    content = lines(
        part("Known Exploited Vulnerability: ", "id"), part("Vendor/Project: ", "vendor_project"), part("Product: ", "product"), part("Vulnerability Name: ", "vulnerability_name"), part("Date Added to KEV: ", "date_added"),
        part("Required Action: ", "required_action", "None specified"), part("Due Date: ", "due_date", "None specified"), more("Known Ransomware Campaign Use: ", "known_ransomware"), more("Notes: ", "notes"),
    )
    tags = F.array(*[F.lit(x) for x in ("exploited", "critical", "kev", "cisa")])
    return exploited.filter(F.col("id") != "").select(F.concat(F.lit("KEV-"), "id").alias("id"), F.concat(F.lit("Known Exploited Vulnerability - "), "id").alias("title"), content.alias("content"), F.lit("KEV").alias("document_type"), F.array("id").alias("cve_refs"), F.lit("Critical").alias("severity"), tags.alias("tags"))
