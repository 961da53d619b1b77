"""Queries on records and techniques."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from adit.functions.texts import PHRASE_TECHNIQUES
from adit.operators import mapping as m
from adit.plans.registry import query
from adit.plans.texts import _sql_list
from adit.runtime import table

_NORMAL = r"""CASE WHEN starts_with(upper(c), 'CWE-') THEN upper(c) WHEN regexp_full_match(c, '\d+') THEN 'CWE-' || c WHEN regexp_matches(c, '(?i)cwe[- ]?\d') THEN 'CWE-' || regexp_extract(c, '(?i)cwe[- ]?(\d+)', 1) END"""
_WEAK = f"weak AS (SELECT DISTINCT ingest_id, {_NORMAL} AS weakness FROM (SELECT ingest_id, unnest(cwe_refs) AS c FROM cves) WHERE c IS NOT NULL)"
#: The mapping that the queries use: of each weakness, the patterns and techniques of the newest record that has it and both.
_MAPPING = f"""{_WEAK}, cells AS (SELECT weakness, ingest_id, list_sort(list_distinct(list_filter(capec_entries, lambda x: x IS NOT NULL))) AS capecs, list_sort(list_distinct(list_filter(mitre_techniques, lambda x: x IS NOT NULL))) AS techniques
   FROM weak JOIN cves USING (ingest_id) WHERE weakness IS NOT NULL AND capec_entries IS NOT NULL AND mitre_techniques IS NOT NULL),
 mapping AS (SELECT weakness, arg_max(capecs, ingest_id) AS capecs, arg_max(techniques, ingest_id) AS techniques FROM cells GROUP BY 1)"""


def _mapping(spark, d):
    from adit.functions.identifiers import weakness_id

    c = table(spark, d, "cves").filter("capec_entries IS NOT NULL AND mitre_techniques IS NOT NULL")
    names = lambda x: F.array_sort(F.array_distinct(F.array_compact(x)))
    cells = c.select("ingest_id", F.explode(F.array_distinct(F.array_compact(F.transform("cwe_refs", weakness_id)))).alias("weakness"), names(F.col("capec_entries")).alias("capecs"), names(F.col("mitre_techniques")).alias("mitre_techniques"))
    best = cells.groupBy("weakness").agg(F.max_by(F.struct("capecs", "mitre_techniques"), "ingest_id").alias("r"))
    return best.select("weakness", "r.capecs", "r.mitre_techniques")


_BY_WEAKNESS = f"""{_MAPPING}, by_weakness AS (SELECT ingest_id, list_sort(list_distinct(flatten(list(techniques)))) AS techniques, count(*) AS n_mappings,
   string_agg(weakness || '>' || array_to_string(capecs, '+') || '>' || array_to_string(techniques, '+'), ' ' ORDER BY weakness) AS details
   FROM weak JOIN mapping USING (weakness) WHERE len(techniques) > 0 GROUP BY ingest_id)"""


@query(f"WITH {_BY_WEAKNESS} SELECT ingest_id, array_to_string(techniques, ', ') AS techniques, n_mappings, details FROM by_weakness")
def record_techniques(spark, d):
    """Techniques of each record over its weaknesses, with the mappings that gave them."""
    found = m.by_weakness(table(spark, d, "cves"), "ingest_id", "cwe_refs", _mapping(spark, d))
    detail = F.transform("mappings", lambda x: F.concat_ws(">", x["weakness"], F.array_join(x["capecs"], "+"), F.array_join(x["techniques"], "+")))
    return found.select("ingest_id", F.array_join("techniques", ", ").alias("techniques"), F.size("mappings").cast("bigint").alias("n_mappings"), F.array_join(detail, " ").alias("details"))


@query(f"WITH {_MAPPING} SELECT weakness, array_to_string(capecs, ', ') AS capecs, array_to_string(techniques, ', ') AS techniques FROM mapping WHERE weakness = (SELECT min(weakness) FROM mapping)")
def weakness_lookup(spark, d):
    """The patterns and techniques of one weakness, given in another spelling."""
    mapping = _mapping(spark, d)
    name = mapping.agg(F.min("weakness")).first()[0] or ""
    return m.point_lookup(mapping, name.replace("CWE-", "cwe ")).select("weakness", F.array_join("capecs", ", ").alias("capecs"), F.array_join("mitre_techniques", ", ").alias("techniques"))


@query(f"""WITH {_WEAK}, j AS (SELECT ingest_id, list_sort(list_distinct(list_filter(list(weakness), lambda x: x IS NOT NULL))) AS w FROM weak GROUP BY 1)
 SELECT ingest_id, coalesce(array_to_string(w, ', '), '') AS weaknesses FROM cves LEFT JOIN j USING (ingest_id)""")
def weakness_layouts(spark, d):
    """The weaknesses of records of three layouts: each record is written in one of them by its number, and read back."""
    c = F.col
    value = lambda x: F.struct(x.alias("value"))
    listed = F.transform(F.coalesce("cwe_refs", F.array().cast("array<string>")), lambda x: F.struct(F.array(value(x)).alias("description")))
    layouts = {0: F.to_json(F.struct(c("cwe_refs").alias("cwe_ids"))), 1: F.to_json(F.struct(listed.alias("weaknesses"))), 2: F.to_json(F.struct(F.struct(listed.alias("problemtype_data")).alias("problemtype")))}
    text = F.when(c("ingest_id") % 3 == 0, layouts[0]).when(c("ingest_id") % 3 == 1, layouts[1]).otherwise(layouts[2])
    read = table(spark, d, "cves").select("ingest_id", F.try_parse_json(text).alias("record"))
    return read.select("ingest_id", F.array_join(m.weaknesses_of(c("record")), ", ").alias("weaknesses"))


#: Vectors of techniques: the named ones in order of their ids, each with the embedding of that number.
_IDS = sorted({t for ts in PHRASE_TECHNIQUES.values() for t in ts} - {"T1496"})
_FACTORS = f"""ids AS (SELECT DISTINCT t FROM (SELECT unnest({_sql_list(_IDS)}) AS t UNION ALL SELECT technique_id FROM mitre_techniques WHERE technique_id IS NOT NULL)),
 factors AS (SELECT t AS technique_id, CAST(embedding AS DOUBLE[]) AS v FROM (SELECT t, row_number() OVER (ORDER BY t) - 1 AS n FROM ids) JOIN embeddings ON n = vec_id)"""
_HITS = ", ".join(f"CASE WHEN contains(low, '{p}') THEN {_sql_list(v)} ELSE CAST([] AS VARCHAR[]) END" for p, v in PHRASE_TECHNIQUES.items())
_INFERRED = f"""{_FACTORS}, obs AS (SELECT ingest_id, list_sort(list_distinct(flatten([{_HITS}]))) AS observed FROM (SELECT ingest_id, lower(description) AS low FROM cves WHERE description <> '')),
 sets AS (SELECT DISTINCT observed FROM obs WHERE len(observed) > 0),
 x AS (SELECT observed, i, avg(v[i]) AS m, count(*) AS n_known FROM (SELECT observed, unnest(observed) AS t FROM sets) JOIN factors ON t = technique_id, range(1, 65) r(i) GROUP BY 1, 2),
 means AS (SELECT observed, list(m ORDER BY i) AS m FROM x GROUP BY 1),
 sims AS (SELECT observed, technique_id, list_cosine_similarity(v, m) AS c FROM means, factors WHERE NOT list_contains(observed, technique_id)),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY observed ORDER BY round(c, 12) DESC, technique_id) AS k FROM sims WHERE c > {{0}}) WHERE k <= 10),
 inf AS (SELECT observed, list(technique_id ORDER BY k) AS inferred, round(max(c), 6) AS confidence FROM best GROUP BY 1)"""


def _factors(spark, d):
    named = spark.createDataFrame([(t,) for t in _IDS], "technique_id string")
    ids = named.union(table(spark, d, "mitre_techniques").select("technique_id").filter("technique_id IS NOT NULL")).distinct()
    # The list of techniques is of fixed size, so that one window numbers it.
    numbered = ids.withColumn("vec_id", (F.row_number().over(Window.orderBy("technique_id")) - 1).cast("bigint"))
    return numbered.join(table(spark, d, "embeddings"), "vec_id").select("technique_id", "embedding")


@query(f"""WITH {_INFERRED.format(0.1)} SELECT ingest_id, CASE WHEN len(obs.observed) > 0 AND means.m IS NULL THEN 'keyword' ELSE 'likeness' END AS method,
 array_to_string(list_concat(obs.observed, coalesce(inferred, [])), ', ') AS techniques, confidence FROM obs LEFT JOIN means ON obs.observed = means.observed LEFT JOIN inf ON obs.observed = inf.observed""")
def infer_techniques(spark, d):
    """Techniques of every description: those of its words, and the ten most like their mean vector."""
    got = m.by_description(table(spark, d, "cves"), "ingest_id", "description", _factors(spark, d), 0.1)
    return got.select("ingest_id", "method", F.array_join("techniques", ", ").alias("techniques"), F.round(F.get("inferred", F.lit(0))["confidence"], 6).alias("confidence"))


_COMBINED = f"""{_BY_WEAKNESS}, {_INFERRED.format(0.15)}, pair AS (SELECT ingest_id, coalesce(w.techniques, []) AS mapped,
   list_filter(list_concat(coalesce(obs.observed, []), coalesce(inferred, [])), lambda x: NOT list_contains(coalesce(w.techniques, []), x)) AS new
   FROM cves LEFT JOIN by_weakness w USING (ingest_id) LEFT JOIN obs USING (ingest_id) LEFT JOIN inf ON obs.observed = inf.observed)"""


def _combined(spark, d):
    return m.combined(table(spark, d, "cves"), "ingest_id", "cwe_refs", "description", _mapping(spark, d), _factors(spark, d), 0.15)


@query(f"""WITH {_COMBINED} SELECT ingest_id, array_to_string(list_concat(mapped, new), ', ') AS techniques, concat_ws('+', CASE WHEN len(mapped) > 0 THEN 'weakness' END, CASE WHEN len(new) > 0 THEN 'likeness' END) AS methods,
 CAST(len(mapped) + len(new) AS INTEGER) AS n_techniques FROM pair""")
def combined_techniques(spark, d):
    """Techniques over weaknesses, then new ones from descriptions, with the methods that gave any."""
    return _combined(spark, d).select("ingest_id", F.array_join("techniques", ", ").alias("techniques"), F.array_join("methods", "+").alias("methods"), "n_techniques")


@query(f"WITH {_COMBINED}, a AS (SELECT list_concat(mapped, new) AS t FROM pair) SELECT count(*) AS n_records, count(*) FILTER (len(t) > 0) AS n_mapped, (SELECT count(DISTINCT x) FROM (SELECT unnest(t) AS x FROM a)) AS n_techniques FROM a")
def mapping_totals(spark, d):
    return m.mapping_summary(_combined(spark, d))


@query(f"WITH {_MAPPING} SELECT count(DISTINCT ingest_id) AS records, count(DISTINCT weakness) AS weaknesses FROM weak WHERE weakness IN (SELECT weakness FROM mapping)")
def mapped_any(spark, d):
    """Records with any weakness that the mapping knows, and how many of its weaknesses occur."""
    from adit.functions.identifiers import weakness_id

    w = table(spark, d, "cves").select("ingest_id", F.explode(F.array_distinct(F.transform("cwe_refs", weakness_id))).alias("weakness"))
    return w.join(_mapping(spark, d).select("weakness"), "weakness", "left_semi").agg(F.countDistinct("ingest_id").alias("records"), F.countDistinct("weakness").alias("weaknesses"))
