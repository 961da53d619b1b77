"""Queries on joins, aggregations, set operations and nested columns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from adit.functions.texts import joined
from adit.operators import relations as r
from adit.operators.orphans import name_key
from adit.plans.graphs import E, edges, technique_tactics
from adit.plans.registry import query
from adit.runtime import table

_NONE = "array<string>"


@query("""SELECT count(*) AS n_rows, count(*) FILTER (cvss_v3.base_score > 0) AS with_score, count(*) FILTER (cvss_v3.base_severity IN ('CRITICAL', 'HIGH')) AS severe,
 count(*) FILTER (is_in_kev) AS exploited, count(*) FILTER (len(coalesce(cwe_refs, [])) > 0) AS with_weakness, count(*) FILTER (source = 'NVD') AS from_nvd FROM cves""")
def conditional_counts(spark, d):
    t = table(spark, d, "cves")
    return t.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.coalesce("cvss_v3.base_score", F.lit(0.0)) > 0).alias("with_score"),
        F.count_if(F.col("cvss_v3.base_severity").isin("CRITICAL", "HIGH")).alias("severe"),
        F.count_if("is_in_kev").alias("exploited"),
        F.count_if(F.size(F.coalesce("cwe_refs", F.array().cast(_NONE))) > 0).alias("with_weakness"),
        F.count_if(F.col("source") == "NVD").alias("from_nvd"),
    )


@query("SELECT CAST(sum(len(coalesce(cwe_refs, []))) AS BIGINT) AS weaknesses, CAST(sum(len(coalesce(mitre_techniques, []))) AS BIGINT) AS techniques, CAST(sum(len(coalesce(affected_vendors, []))) AS BIGINT) AS vendors FROM cves")
def array_size_sums(spark, d):
    size = lambda c: F.sum(F.size(F.coalesce(c, F.array().cast(_NONE))))
    return table(spark, d, "cves").agg(size("cwe_refs").alias("weaknesses"), size("mitre_techniques").alias("techniques"), size("affected_vendors").alias("vendors"))


_DIMS = ("cwe_refs", "capec_entries", "mitre_techniques", "affected_vendors")


@query(" UNION ALL ".join(f"SELECT '{c}' AS dim, count(DISTINCT x) AS n FROM (SELECT unnest({c}) AS x FROM cves)" for c in _DIMS))
def distinct_dims(spark, d):
    """Different elements of four array columns, in one pass over them."""
    cells = F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).alias("a")) for c in _DIMS])
    every = table(spark, d, "cves").select(F.inline(cells)).select("dim", F.explode_outer("a").alias("x"))
    return every.groupBy("dim").agg(F.countDistinct("x").alias("n"))


@query("""SELECT vendor_name, category, family, count(*) AS n, CAST(sum(vulnerability_count) AS BIGINT) AS vulnerabilities FROM product_nodes
 GROUP BY GROUPING SETS ((vendor_name), (category), (family))""")
def hierarchy_grouping_sets(spark, d):
    table(spark, d, "product_nodes").createOrReplaceTempView("adit_products")
    return spark.sql("""SELECT vendor_name, category, family, count(*) AS n, sum(vulnerability_count) AS vulnerabilities FROM adit_products
      GROUP BY GROUPING SETS ((vendor_name), (category), (family))""")


_KEY = "coalesce(normalized_vendor, '') || ':' || coalesce(normalized_product, '')"


@query(f"SELECT {_KEY} AS product_key, count(*) AS matches, count(DISTINCT cve_id) AS records, count(DISTINCT version_text) AS versions, min(component_id) AS first_row, round(avg(confidence_score), 6) AS confidence FROM cpe_components GROUP BY 1")
def product_grouping(spark, d):
    t = table(spark, d, "cpe_components").withColumn("product_key", r.product_key())
    return t.groupBy("product_key").agg(
        F.count("*").alias("matches"), F.countDistinct("cve_id").alias("records"), F.countDistinct("version_text").alias("versions"), F.min("component_id").alias("first_row"), F.round(F.avg("confidence_score"), 6).alias("confidence")
    )


@query(f"SELECT {_KEY} AS product_key, version_text, count(*) AS matches, count(DISTINCT cve_id) AS records FROM cpe_components GROUP BY 1, 2")
def version_grouping(spark, d):
    t = table(spark, d, "cpe_components").withColumn("product_key", r.product_key())
    return t.groupBy("product_key", "version_text").agg(F.count("*").alias("matches"), F.countDistinct("cve_id").alias("records"))


@query("WITH kev AS (SELECT DISTINCT cve_id FROM cves WHERE is_in_kev) SELECT doc_id, kev.cve_id IS NOT NULL AS exploited FROM documents d LEFT JOIN kev ON d.cve_id = kev.cve_id")
def flag_left_join(spark, d):
    kev = table(spark, d, "cves").filter("is_in_kev").select("cve_id").distinct()
    return r.flagged(table(spark, d, "documents").select("doc_id", "cve_id"), kev, "cve_id", "exploited").select("doc_id", "exploited")


@query("""WITH n AS (SELECT cve_id, count(*) AS n_docs, string_agg(doc_type, ', ' ORDER BY doc_id) AS types FROM documents WHERE cve_id IS NOT NULL GROUP BY cve_id)
 SELECT c.cve_id, coalesce(n_docs, 0) AS n_docs, types FROM (SELECT DISTINCT cve_id FROM cves WHERE cve_id IS NOT NULL) c LEFT JOIN n USING (cve_id)""")
def nested_left_join(spark, d):
    """Records with their documents nested; the many side is nested before the join."""
    docs = table(spark, d, "documents").filter("cve_id IS NOT NULL").groupBy("cve_id").agg(F.count("*").alias("n_docs"), F.array_sort(F.collect_list(F.struct("doc_id", "doc_type"))).alias("docs"))
    types = F.array_join(F.filter(F.transform("docs", lambda x: x["doc_type"]), lambda x: x.isNotNull()), ", ")
    docs = docs.select("cve_id", "n_docs", F.when(F.size(F.filter("docs", lambda x: x["doc_type"].isNotNull())) > 0, types).alias("types"))
    return table(spark, d, "cves").select("cve_id").filter("cve_id IS NOT NULL").distinct().join(docs, "cve_id", "left").select("cve_id", F.coalesce("n_docs", F.lit(0)).cast("bigint").alias("n_docs"), "types")


@query("""WITH m AS (SELECT technique_id, min(technique_name) AS name FROM mitre_techniques WHERE technique_id IS NOT NULL GROUP BY 1),
 x AS (SELECT DISTINCT ingest_id, unnest(mitre_techniques) AS t FROM cves)
 SELECT c.ingest_id, s.names, coalesce(s.n, 0) AS n FROM cves c LEFT JOIN (SELECT ingest_id, string_agg(name, ', ' ORDER BY name) AS names, count(*) AS n FROM x JOIN m ON t = technique_id GROUP BY 1) s USING (ingest_id)""")
def explode_join_regroup(spark, d):
    """Names of each row's techniques: explode, look up, nest again, and join back."""
    names = table(spark, d, "mitre_techniques").filter("technique_id IS NOT NULL").groupBy("technique_id").agg(F.min("technique_name").alias("name"))
    rows = table(spark, d, "cves").select("ingest_id", "mitre_techniques")
    nested = r.looked_up(rows, "ingest_id", "mitre_techniques", names, "technique_id", "name")
    return rows.select("ingest_id").join(nested, "ingest_id", "left").select("ingest_id", joined(F.col("name")).alias("names"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@query("SELECT r_name AS region, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS segments, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")
def two_hop_composition(spark, d):
    hop = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "n_nationkey")
    both = table(spark, d, "customer").join(hop, F.col("c_nationkey") == F.col("n_nationkey"))
    return both.groupBy(F.col("r_name").alias("region")).agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ", ").alias("segments"), F.count("*").alias("n"))


@query(f"""WITH {E}, p AS (SELECT replace(lower(trim(product_name)), ' ', '_') AS product, min(product_row) AS product_row FROM product_nodes GROUP BY 1)
 SELECT src, dst, product_row FROM e JOIN p ON dst = product WHERE rel = 'AFFECTS'""")
def first_match_join(spark, d):
    p = table(spark, d, "product_nodes").groupBy(name_key(F.col("product_name")).alias("dst")).agg(F.min("product_row").alias("product_row"))
    return edges(spark, d).filter("rel = 'AFFECTS'").join(p, "dst").select("src", "dst", "product_row")


@query(f"""WITH {E} SELECT src, count(*) AS n, min(product_row) AS first_row, max(product_row) AS last_row FROM e JOIN product_nodes ON dst = replace(lower(trim(product_name)), ' ', '_') WHERE rel = 'AFFECTS' GROUP BY src""")
def fanout_join(spark, d):
    """All rows of a name, not one of them."""
    p = table(spark, d, "product_nodes").select(name_key(F.col("product_name")).alias("dst"), "product_row")
    return edges(spark, d).filter("rel = 'AFFECTS'").join(p, "dst").groupBy("src").agg(F.count("*").alias("n"), F.min("product_row").alias("first_row"), F.max("product_row").alias("last_row"))


@query("SELECT feed_dialect, count(*) AS n FROM (SELECT feed_dialect FROM nvd_records WHERE feed_dialect = '1.1' UNION ALL SELECT feed_dialect FROM nvd_records WHERE feed_dialect = '2.0') GROUP BY 1")
def union_all_dialects(spark, d):
    t = table(spark, d, "nvd_records")
    return t.filter("feed_dialect = '1.1'").unionByName(t.filter("feed_dialect = '2.0'")).groupBy("feed_dialect").agg(F.count("*").alias("n"))


@query("""SELECT 'record' AS kind, cve_id AS id, source, CAST(NULL AS VARCHAR) AS lang FROM cves UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), source, lang FROM documents""")
def union_doc_types(spark, d):
    a = table(spark, d, "cves").select(F.lit("record").alias("kind"), F.col("cve_id").alias("id"), "source")
    b = table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"), "source", "lang")
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text")
def first_wins_dedup(spark, d):
    """The first of equal texts. Texts meet by their SHA-256, so that they aren't shuffled."""
    return r.first_of_equals(table(spark, d, "documents"), "text", "doc_id")


@query("""SELECT cve_id, title, source, ingest_id FROM (SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY coalesce(last_modified_at, TIMESTAMP '0001-01-01') DESC, ingest_id DESC) AS k FROM cves WHERE cve_id IS NOT NULL) WHERE k = 1""")
def last_wins_upsert(spark, d):
    return r.latest(table(spark, d, "cves").select("cve_id", "title", "source", "ingest_id", "last_modified_at"), "cve_id", ["last_modified_at", "ingest_id"]).drop("last_modified_at")


@query("""SELECT ingest_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(cwe_refs, []), coalesce(capec_entries, [])))), ', ') AS both_sorted,
 len(list_distinct(list_intersect(coalesce(affected_vendors, []), coalesce(affected_products, [])))) AS shared FROM cves""")
def set_algebra(spark, d):
    none = F.array().cast(_NONE)
    some = lambda c: F.array_compact(F.coalesce(c, none))
    return table(spark, d, "cves").select(
        "ingest_id",
        F.array_join(F.array_sort(F.array_union(some(F.col("cwe_refs")), some(F.col("capec_entries")))), ", ").alias("both_sorted"),
        F.size(F.array_intersect(some(F.col("affected_vendors")), some(F.col("affected_products")))).cast("bigint").alias("shared"),
    )


@query("""WITH x AS (SELECT ingest_id, generate_subscripts(a, 1) AS k, unnest(a) AS v FROM (SELECT ingest_id, list_concat(coalesce(cwe_refs, []), coalesce(mitre_techniques, [])) AS a FROM cves)),
 f AS (SELECT ingest_id, v, min(k) AS k FROM x WHERE v IS NOT NULL GROUP BY 1, 2)
 SELECT ingest_id, string_agg(v, ', ' ORDER BY k) AS merged FROM f GROUP BY ingest_id""")
def ordered_dedup_concat(spark, d):
    """Two lists one behind the other, the first of equal elements kept in its place."""
    none = F.array().cast(_NONE)
    merged = F.array_distinct(F.array_compact(F.concat(F.coalesce("cwe_refs", none), F.coalesce("mitre_techniques", none))))
    return table(spark, d, "cves").select("ingest_id", merged.alias("m")).filter(F.size("m") > 0).select("ingest_id", F.array_join("m", ", ").alias("merged"))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT k) AS kinds, CAST(min(k) AS BIGINT) AS lo, CAST(max(k) AS BIGINT) AS hi, round(avg(value), 6) AS mean
 FROM (SELECT event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""")
def json_props(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, d, "events").withColumn("k", k).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("k").alias("kinds"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT doc_type, min(n_chars) AS lo, max(n_chars) AS hi, round(avg(n_chars), 6) AS mean, count(*) AS n FROM documents GROUP BY 1")
def min_max_avg(spark, d):
    return table(spark, d, "documents").groupBy("doc_type").agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"), F.round(F.avg("n_chars"), 6).alias("mean"), F.count("*").alias("n"))


@query("""SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS k FROM documents) WHERE k <= 3 ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 20""")
def top_per_group_then_overall(spark, d):
    """The longest three of each source, and of those the longest twenty."""
    t = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return r.top_per_group(t, "source", [F.desc_nulls_last("n_chars"), F.col("doc_id")], 3).orderBy(F.desc_nulls_last("n_chars"), "doc_id").limit(20)


@query("""WITH k AS (SELECT technique_id, min(name) AS name FROM (SELECT technique_id, technique_name AS name FROM mitre_techniques WHERE technique_id IS NOT NULL) GROUP BY 1)
 SELECT technique_id, name, CASE WHEN contains(technique_id, '.') THEN split_part(technique_id, '.', 1) END AS parent FROM k""")
def parent_techniques(spark, d):
    from adit.functions.identifiers import parent_technique

    t = table(spark, d, "mitre_techniques").filter("technique_id IS NOT NULL").groupBy("technique_id").agg(F.min("technique_name").alias("name"))
    return t.withColumn("parent", parent_technique(F.col("technique_id")))


@query("""SELECT count(*) AS total, count(*) FILTER (len(list_filter(coalesce(cwe_refs, []), lambda x: x IS NOT NULL)) > 0) AS with_weakness, count(*) FILTER (len(list_filter(coalesce(mitre_techniques, []), lambda x: x IS NOT NULL)) > 0) AS with_technique,
 (SELECT count(DISTINCT x) FROM (SELECT unnest(cwe_refs) AS x FROM cves)) AS weaknesses, (SELECT count(DISTINCT x) FROM (SELECT unnest(mitre_techniques) AS x FROM cves)) AS techniques FROM cves""")
def mapping_statistics(spark, d):
    none = F.array().cast(_NONE)
    t = table(spark, d, "cves")
    some = lambda c: F.size(F.array_compact(F.coalesce(c, none))) > 0
    counts = t.agg(F.count("*").alias("total"), F.count_if(some(F.col("cwe_refs"))).alias("with_weakness"), F.count_if(some(F.col("mitre_techniques"))).alias("with_technique"))
    cells = F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).alias("a")) for c in ("cwe_refs", "mitre_techniques")])
    dims = t.select(F.inline(cells)).select("dim", F.explode("a").alias("x")).agg(
        F.countDistinct(F.when(F.col("dim") == "cwe_refs", F.col("x"))).alias("weaknesses"), F.countDistinct(F.when(F.col("dim") == "mitre_techniques", F.col("x"))).alias("techniques")
    )
    return counts.withColumn("one", F.lit(1)).join(dims.withColumn("one", F.lit(1)), "one").drop("one")


@query()
def technique_tactic_map(spark, d):
    """Both ways between techniques and tactics, from the packed column: kind, key, members, n."""
    pairs = technique_tactics(spark, d)
    a = pairs.groupBy(F.col("technique_id").alias("key")).agg(F.array_sort(F.collect_list("tactic")).alias("members"))
    b = pairs.groupBy(F.col("tactic").alias("key")).agg(F.array_sort(F.collect_list("technique_id")).alias("members"))
    return a.select(F.lit("technique").alias("kind"), "key", F.array_join("members", ", ").alias("members"), F.size("members").alias("n")).union(b.select(F.lit("tactic"), "key", F.array_join("members", ", "), F.size("members")))


@query("""WITH l AS (SELECT listed_name AS name, 'TA' || row_number() OVER (ORDER BY listed_name) AS id FROM listed_names WHERE field_name = 'tactics'),
 r AS (SELECT technique_id, sheet_row, generate_subscripts(a, 1) AS i, unnest(a) AS name FROM (SELECT technique_id, sheet_row, list_transform(string_split(tactics, ','), lambda x: trim(x)) AS a FROM mitre_techniques WHERE trim(technique_id) <> '' AND tactics IS NOT NULL)),
 j AS (SELECT technique_id, count(*) AS n, count(DISTINCT l.id) AS kinds, min(l.id) AS first_id FROM r JOIN l USING (name) WHERE name <> '' GROUP BY 1)
 SELECT technique_id, coalesce(n, 0) AS n, coalesce(kinds, 0) AS kinds, first_id FROM (SELECT DISTINCT technique_id FROM mitre_techniques WHERE trim(technique_id) <> '') LEFT JOIN j USING (technique_id)""")
def tactic_ids(spark, d):
    """Techniques with the ids of the tactics that they name; names without an id are left out."""
    from adit.operators.exports import technique_tactics

    names = table(spark, d, "listed_names").filter("field_name = 'tactics'")
    # The list of names is of fixed size, so that one window numbers it.
    ids = names.select(F.col("listed_name").alias("tactic_name"), F.concat(F.lit("TA"), F.row_number().over(Window.orderBy("listed_name"))).alias("tactic_id"))
    got = technique_tactics(table(spark, d, "mitre_techniques"), ids)
    return got.select("technique_id", F.size("tactic_ids").cast("bigint").alias("n"), F.size(F.array_distinct("tactic_ids")).cast("bigint").alias("kinds"), F.array_min("tactic_ids").alias("first_id"))


@query("""WITH m AS (SELECT cwe_id AS w, capec_id AS c, edge_id FROM cve_edges WHERE trim(cwe_id) <> '' AND trim(capec_id) <> ''), hop AS (SELECT DISTINCT w, c FROM m),
 t AS (SELECT c, 'T' || (edge_id % 50) AS t, edge_id AS o FROM m), p AS (SELECT w, t, o FROM hop JOIN t USING (c))
 SELECT w AS weakness, (SELECT count(DISTINCT c) FROM hop h WHERE h.w = p.w) AS patterns, count(DISTINCT t) AS techniques, arg_max(t, o) AS last_technique FROM p GROUP BY w""")
def weakness_technique_composition(spark, d):
    """Weaknesses to patterns to techniques, with the last technique by the order of what names it."""
    m = table(spark, d, "cve_edges").filter("trim(cwe_id) <> '' AND trim(capec_id) <> ''").select(F.col("cwe_id").alias("weakness"), F.col("capec_id").alias("c"), "edge_id")
    hop = m.select("weakness", "c").distinct()
    # A pattern's techniques are nested with their last order before the second hop, so that its rows don't multiply.
    t = m.groupBy("c", F.concat(F.lit("T"), F.col("edge_id") % 50).alias("t")).agg(F.max("edge_id").alias("o"))
    return hop.join(t, "c").groupBy("weakness").agg(F.countDistinct("c").alias("patterns"), F.countDistinct("t").alias("techniques"), F.max_by("t", "o").alias("last_technique"))
