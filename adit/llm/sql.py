"""SQL of the queries that SQL can express."""

_BASKETS = """
latest AS (SELECT cve_id, arg_max(struct_pack(cwe_refs := cwe_refs, mitre_techniques := mitre_techniques, affected_vendors := affected_vendors),
                  struct_pack(a := coalesce(last_modified_at, TIMESTAMP '0001-01-01'), b := ingest_id)) AS r FROM cves WHERE cve_id IS NOT NULL GROUP BY cve_id),
items AS (
  SELECT DISTINCT cve_id, 'cwe_refs' AS field_name, unnest(r.cwe_refs) AS item FROM latest
  UNION ALL SELECT DISTINCT cve_id, 'mitre_techniques', unnest(r.mitre_techniques) FROM latest
  UNION ALL SELECT DISTINCT cve_id, 'affected_vendors', unnest(r.affected_vendors) FROM latest),
present AS (SELECT * FROM items WHERE item IS NOT NULL),
n AS (SELECT field_name, count(DISTINCT cve_id) AS n_records FROM present GROUP BY 1),
one AS (SELECT field_name, item, count(*) AS c FROM present GROUP BY 1, 2),
two AS (SELECT a.field_name, a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM present a JOIN present b
        ON a.cve_id = b.cve_id AND a.field_name = b.field_name AND a.item < b.item GROUP BY 1, 2, 3),
pairs AS (SELECT two.*, x.c AS n_a, y.c AS n_b, n.n_records FROM two JOIN one x ON two.field_name = x.field_name AND item_a = x.item
          JOIN one y ON two.field_name = y.field_name AND item_b = y.item JOIN n ON two.field_name = n.field_name
          WHERE n_ab >= 3 AND 1000 * n_ab >= n_records)
"""

SQL: dict[str, str] = {
    "p3_found": """SELECT ingest_id, field_name FROM (
        SELECT ingest_id, 'text_for_embedding' AS field_name, length(text_for_embedding) AS n FROM cves
        UNION ALL SELECT ingest_id, 'description', length(description) FROM cves) t
      JOIN size_limits USING (field_name) WHERE n > max_size""",
    "p5_found": f"WITH {_BASKETS} SELECT field_name, item_a, item_b FROM pairs WHERE n_ab * n_records >= 4 * n_a * n_b",
    "p5_pairs": f"""WITH {_BASKETS} SELECT field_name, item_a, item_b, n_ab, n_a, n_b, n_records,
        round(CAST(n_ab * n_records AS DOUBLE) / (n_a * n_b), 6) AS lift FROM pairs""",
}
