"""Schemas of the raw feeds, as DDL. They are fixed: inferring them would make optional keys unstable."""

from __future__ import annotations

_TEXTS = "ARRAY<STRUCT<lang: STRING, value: STRING>>"
_BOUNDS = "versionStartIncluding: STRING, versionStartExcluding: STRING, versionEndIncluding: STRING, versionEndExcluding: STRING, vulnerable: BOOLEAN"
_M1 = f"ARRAY<STRUCT<cpe23Uri: STRING, {_BOUNDS}>>"
_M2 = f"ARRAY<STRUCT<criteria: STRING, {_BOUNDS}, matchCriteriaId: STRING>>"
_V3 = "STRUCT<baseScore: DOUBLE, vectorString: STRING, baseSeverity: STRING, attackVector: STRING, attackComplexity: STRING, privilegesRequired: STRING, userInteraction: STRING, scope: STRING, confidentialityImpact: STRING, integrityImpact: STRING, availabilityImpact: STRING>"
_V2 = "STRUCT<baseScore: DOUBLE, vectorString: STRING, accessVector: STRING, accessComplexity: STRING, authentication: STRING, confidentialityImpact: STRING, integrityImpact: STRING, availabilityImpact: STRING>"

#: The 1.1 feed: an object with a list of items.
FEED_1 = f"""CVE_Items ARRAY<STRUCT<
  cve: STRUCT<CVE_data_meta: STRUCT<ID: STRING>, description: STRUCT<description_data: {_TEXTS}>,
    problemtype: STRUCT<problemtype_data: ARRAY<STRUCT<description: {_TEXTS}>>>, references: STRUCT<reference_data: ARRAY<STRUCT<url: STRING>>>>,
  configurations: STRUCT<nodes: ARRAY<STRUCT<operator: STRING, cpe_match: {_M1}, children: ARRAY<STRUCT<cpe_match: {_M1}>>>>>,
  impact: STRUCT<baseMetricV3: STRUCT<cvssV3: {_V3}>, baseMetricV2: STRUCT<severity: STRING, cvssV2: {_V2}>>,
  publishedDate: STRING, lastModifiedDate: STRING>>"""
#: The 2.0 feed: an object with a list of objects that hold a record each.
FEED_2 = f"""vulnerabilities ARRAY<STRUCT<cve: STRUCT<id: STRING, published: STRING, lastModified: STRING, descriptions: {_TEXTS},
  metrics: STRUCT<cvssMetricV31: ARRAY<STRUCT<cvssData: {_V3}>>, cvssMetricV30: ARRAY<STRUCT<cvssData: {_V3}>>, cvssMetricV2: ARRAY<STRUCT<baseSeverity: STRING, cvssData: {_V2}>>>,
  weaknesses: ARRAY<STRUCT<description: {_TEXTS}>>, references: ARRAY<STRUCT<url: STRING>>,
  configurations: ARRAY<STRUCT<nodes: ARRAY<STRUCT<operator: STRING, negate: BOOLEAN, cpeMatch: {_M2}, children: ARRAY<STRUCT<cpeMatch: {_M2}>>>>>>>>>"""
MAPPING = "MAP<STRING, STRUCT<capecs: ARRAY<STRING>, mitre_techniques: ARRAY<STRING>, mitre_description: STRING>>"
KEV_CSV = "cveID STRING, vendorProject STRING, product STRING, vulnerabilityName STRING, dateAdded STRING, shortDescription STRING, requiredAction STRING, dueDate STRING, knownRansomwareCampaignUse STRING, notes STRING, cwes STRING"
EXPLOIT = "id STRING, cve_refs ARRAY<STRING>"
WEAKNESS_XML = "_ID STRING, _Name STRING, Related_Attack_Patterns STRUCT<Related_Attack_Pattern: ARRAY<STRUCT<_CAPEC_ID: STRING>>>"
PATTERN_XML = "_ID STRING, _Name STRING, Description STRING, Taxonomy_Mappings STRUCT<Taxonomy_Mapping: ARRAY<STRUCT<_Taxonomy_Name: STRING, Entry_ID: STRING>>>"
