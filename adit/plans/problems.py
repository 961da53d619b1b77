"""Queries on the general data problems: packed fields (1), orphan references (4), nested records (7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adit.operators.nested import flatten_configurations
from adit.operators.orphans import Target, name_key, number_key, orphan_counts, orphans
from adit.operators.packed import listed, unpack
from adit.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "mitre_techniques")
    cells = t.select(F.col("sheet_row").alias("row_key"), F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("cell")) for f in ("tactics", "platforms")])))
    c = table(spark, d, "cpe_components").select(F.col("component_id").alias("row_key"), F.lit("target_sw").alias("field_name"), F.col("target_sw").alias("cell"))
    names = listed(table(spark, d, "listed_names"))
    return unpack(cells.unionByName(c), "cell", "field_name", names, ["field_name", "row_key"])


def _targets(spark: SparkSession, d: str) -> list[Target]:
    return [
        Target("cwe_id", table(spark, d, "cwe_nodes"), "cwe_id", number_key),
        Target("capec_id", table(spark, d, "capec_nodes"), "capec_id", number_key),
        Target("product_name", table(spark, d, "product_nodes"), "product_name", name_key),
    ]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans(table(spark, d, "cve_edges"), _targets(spark, d))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(table(spark, d, "cve_edges"), _targets(spark, d))


def _flat(spark: SparkSession, d: str):
    return flatten_configurations(table(spark, d, "nvd_records"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d).matches.select("record_id", "node_path", "match_pos", "criteria")


def p7_configurations(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d).configurations


def p7_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d).nodes


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d).matches


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p4_found, p4_counts, p7_found, p7_configurations, p7_nodes, p7_matches)
}

_REFS = r"""
refs AS (
  SELECT edge_id, 'cwe_id' AS ref_field, CASE WHEN regexp_matches(cwe_id, '\d') THEN regexp_replace(regexp_extract(cwe_id, '(\d+)\D*$', 1), '^0+(\d)', '\1') ELSE lower(trim(cwe_id)) END AS key, loaded_at FROM cve_edges WHERE trim(cwe_id) <> ''
  UNION ALL
  SELECT edge_id, 'capec_id', CASE WHEN regexp_matches(capec_id, '\d') THEN regexp_replace(regexp_extract(capec_id, '(\d+)\D*$', 1), '^0+(\d)', '\1') ELSE lower(trim(capec_id)) END, loaded_at FROM cve_edges WHERE trim(capec_id) <> ''
  UNION ALL
  SELECT edge_id, 'product_name', replace(lower(trim(product_name)), ' ', '_'), loaded_at FROM cve_edges WHERE trim(product_name) <> ''),
targets AS (
  SELECT 'cwe_id' AS ref_field, regexp_replace(regexp_extract(cwe_id, '(\d+)\D*$', 1), '^0+(\d)', '\1') AS key, created_at, deleted_at FROM cwe_nodes
  UNION ALL
  SELECT 'capec_id', regexp_replace(regexp_extract(capec_id, '(\d+)\D*$', 1), '^0+(\d)', '\1'), created_at, deleted_at FROM capec_nodes
  UNION ALL
  SELECT 'product_name', replace(lower(trim(product_name)), ' ', '_'), created_at, deleted_at FROM product_nodes),
judged AS (
  SELECT r.edge_id, r.ref_field, strftime(any_value(r.loaded_at), '%Y-%m') AS load_month,
    CASE WHEN count(t.key) = 0 THEN 'missing'
         WHEN coalesce(bool_or(t.created_at <= r.loaded_at AND (t.deleted_at IS NULL OR t.deleted_at > r.loaded_at)), false) THEN 'live'
         WHEN min(t.created_at) > any_value(r.loaded_at) THEN 'late' ELSE 'deleted' END AS reason
  FROM refs r LEFT JOIN targets t ON r.ref_field = t.ref_field AND r.key = t.key
  GROUP BY r.edge_id, r.ref_field)
"""

def _listed(j: str) -> str:
    return f"CASE json_type({j}) WHEN 'ARRAY' THEN json_extract({j}, '$[*]') WHEN 'OBJECT' THEN [{j}] ELSE CAST([] AS JSON[]) END"


#: A walk of its own over the JSON, level by level: texts are decoded until they are none, then nodes and their children follow.
_WALK = f"""texts AS (SELECT record_id, configurations AS x FROM nvd_records WHERE configurations IS NOT NULL
   UNION ALL SELECT record_id, json_extract_string(x, '$') FROM texts WHERE json_valid(x) AND json_type(x) = 'VARCHAR'),
 tops AS (SELECT record_id, CAST(x AS JSON) AS v FROM texts WHERE json_valid(x) AND json_type(x) IN ('OBJECT', 'ARRAY')),
 confs AS (SELECT record_id, k - 1 AS i, l[k] AS conf FROM (SELECT record_id, {_listed("v")} AS l FROM tops), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS k)),
 nodes AS (SELECT record_id, i || '/' || (k - 1) AS path, CAST(i AS VARCHAR) AS parent, l[k] AS node FROM (SELECT record_id, i, {_listed("json_extract(conf, '$.nodes')")} AS l FROM confs WHERE json_type(conf) = 'OBJECT'), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS k)
   UNION ALL SELECT record_id, path || '/' || (k - 1), path, l[k] FROM (SELECT record_id, path, {_listed("json_extract(node, '$.children')")} AS l FROM nodes WHERE json_type(node) = 'OBJECT'), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS k)),
 lists AS (SELECT record_id, path, parent, node, CASE WHEN json_type(node) = 'OBJECT' THEN list_concat({_listed("json_extract(node, '$.cpeMatch')")}, {_listed("json_extract(node, '$.cpe_match')")}) ELSE [] END AS l FROM nodes),
 entries AS (SELECT record_id, path AS node_path, CAST(k - 1 AS INTEGER) AS match_pos, l[k] AS m FROM lists, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS k)),
 matches AS (SELECT *, coalesce(nullif(json_extract_string(m, '$.criteria'), ''), nullif(json_extract_string(m, '$.cpe23Uri'), '')) AS criteria FROM entries WHERE json_type(m) = 'OBJECT')"""
_ENDS = {"version_start_including": "versionStartIncluding", "version_start_excluding": "versionStartExcluding", "version_end_including": "versionEndIncluding", "version_end_excluding": "versionEndExcluding", "match_criteria_id": "matchCriteriaId"}

SQL: dict[str, str] = {
    "p7_found": f"WITH RECURSIVE {_WALK} SELECT record_id, node_path, match_pos, criteria FROM matches WHERE criteria IS NOT NULL",
    "p7_matches": f"WITH RECURSIVE {_WALK} SELECT record_id, node_path, match_pos, criteria, lower(json_extract_string(m, '$.vulnerable')) AS vulnerable, "
    + ", ".join(f"json_extract_string(m, '$.{k}') AS {n}" for n, k in _ENDS.items())
    + " FROM matches WHERE criteria IS NOT NULL",
    "p7_nodes": f"""WITH RECURSIVE {_WALK} SELECT record_id, path AS node_path, parent AS parent_path, CAST(len(string_split(path, '/')) - 2 AS INTEGER) AS depth, upper(json_extract_string(node, '$.operator')) AS operator,
        lower(json_extract_string(node, '$.negate')) AS negate, CAST(len(l) AS INTEGER) AS n_matches FROM lists""",
    "p7_configurations": f"""WITH RECURSIVE {_WALK} SELECT record_id, CAST(i AS INTEGER) AS config_pos, upper(json_extract_string(conf, '$.operator')) AS operator, CAST(len({_listed("json_extract(conf, '$.nodes')")}) AS INTEGER) AS n_nodes
        FROM confs WHERE json_type(conf) = 'OBJECT'""",
    "p4_found": f"WITH {_REFS} SELECT edge_id, ref_field, reason, load_month FROM judged WHERE reason <> 'live'",
    "p4_counts": f"""WITH {_REFS} SELECT ref_field, load_month, count(*) FILTER (reason = 'missing') AS n_missing, count(*) FILTER (reason = 'late') AS n_late,
        count(*) FILTER (reason = 'deleted') AS n_deleted, count(*) AS n_refs FROM judged GROUP BY ref_field, load_month""",
}
