"""Queries on sources, sinks, records and streams: tables are written as the raw files that a reader takes, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adit.operators import records as r
from adit.plans.registry import query
from adit.runtime import scratch, table
from adit.sources import readers, sinks
from adit.streaming import records as streams

_STRINGS = "array<string>"
#: Records of a file.
_FILE = 500


def _objects(df: DataFrame, name: str, key: str = "ingest_id", root: str | None = None) -> str:
    """Write the column `item` as files of one JSON document each: an object with the list `root`, or a bare list."""
    path = scratch(df.sparkSession, name)
    groups = df.groupBy(F.floor(F.col(key) / _FILE)).agg(F.collect_list("item").alias(root or "items"))
    text = F.to_json(F.struct(root)) if root else F.to_json("items")
    groups.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def _some(c: str) -> Column:
    return F.array_compact(F.coalesce(c, F.array().cast(_STRINGS)))


def _one(name: str, value: Column) -> Column:
    return F.struct(value.alias(name))


def _texts(*pairs: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(lang).alias("lang"), value.alias("value")) for lang, value in pairs])


def _identifiers(c: str, uri: str) -> Column:
    """Products as match entries of identifiers."""
    return F.transform(_some(c), lambda x: F.struct(F.concat(F.lit("cpe:2.3:a:v:"), F.replace(x, F.lit(":"), F.lit("")), F.lit(":1:*")).alias(uri)))


def _first_dialect(c: DataFrame) -> DataFrame:
    """Rows as items of the 1.1 dialect: the first two products in a node, the others in its child."""
    v = F.col
    weak = F.transform(_some("cwe_refs"), lambda x: F.struct(F.lit("en").alias("lang"), x.alias("value")))
    match = _identifiers("affected_products", "cpe23Uri")
    node = F.struct(F.slice(match, 1, 2).alias("cpe_match"), F.array(_one("cpe_match", F.slice(match, 3, 1 << 20))).alias("children"))
    score = F.when(v("cvss_v3.base_score").isNotNull(), F.struct(_one("cvssV3", F.struct(v("cvss_v3.base_score").alias("baseScore"), v("cvss_v3.base_severity").alias("baseSeverity"))).alias("baseMetricV3")))
    cve = F.struct(
        _one("ID", v("cve_id")).alias("CVE_data_meta"),
        _one("description_data", _texts(("de", v("title")), ("en", v("description")), ("en", v("title")))).alias("description"),
        _one("problemtype_data", F.array(_one("description", weak))).alias("problemtype"),
        _one("reference_data", F.array(_one("url", F.lit("https://a.example/")), _one("url", F.lit("")), _one("url", v("source")))).alias("references"),
    )
    item = F.struct(cve.alias("cve"), _one("nodes", F.array(node)).alias("configurations"), score.alias("impact"), v("published_date").alias("publishedDate"), v("last_modified_at").cast("string").alias("lastModifiedDate"))
    return c.select("ingest_id", item.alias("item"))


def _second_dialect(c: DataFrame) -> DataFrame:
    """Rows as records of the 2.0 dialect; every third score is a 3.0 one."""
    v = F.col
    weak = F.transform(_some("cwe_refs"), lambda x: _one("description", _texts(("en", x), ("de", F.lit("CWE-1")))))
    match = _identifiers("affected_products", "criteria")
    nodes = F.array(F.struct(F.slice(match, 1, 2).alias("cpeMatch"), F.array(_one("cpeMatch", F.slice(match, 3, 1 << 20))).alias("children")))
    data = F.array(_one("cvssData", F.struct(v("cvss_v3.base_score").alias("baseScore"), v("cvss_v3.base_severity").alias("baseSeverity"))))
    has, old = v("cvss_v3.base_score").isNotNull(), v("ingest_id") % 3 == 0
    record = F.struct(
        v("cve_id").alias("id"), v("published_date").alias("published"), v("last_modified_at").cast("string").alias("lastModified"), _texts(("de", v("title")), ("en", v("description")), ("en", v("title"))).alias("descriptions"),
        F.struct(F.when(has & ~old, data).alias("cvssMetricV31"), F.when(has, data).alias("cvssMetricV30")).alias("metrics"), weak.alias("weaknesses"),
        F.array(_one("url", F.lit("https://a.example/")), _one("url", v("source"))).alias("references"), F.array(_one("nodes", nodes)).alias("configurations"),
    )
    return c.select("ingest_id", _one("cve", record).alias("item"))


def _feeds(spark: SparkSession, d: str) -> tuple[str, str]:
    c = table(spark, d, "cves")
    first = _objects(_first_dialect(c.filter("ingest_id % 2 = 0")), "feed-1", root="CVE_Items")
    return first, _objects(_second_dialect(c.filter("ingest_id % 2 = 1")), "feed-2", root="vulnerabilities")


def _records(spark: SparkSession, d: str) -> DataFrame:
    """The records of two feeds, one in each dialect, in one form."""
    first, second = _feeds(spark, d)
    return r.normalised_1(readers.feed_1(spark, first)).unionByName(r.normalised_2(readers.feed_2(spark, second)))


_SORTED = "list_sort(list_distinct(list_filter({}, lambda x: x IS NOT NULL)))"
_RECORDS = f"""rec AS (SELECT cve_id, coalesce(description, '') AS description, coalesce(array_to_string({_SORTED.format("list_filter(coalesce(cwe_refs, []), lambda x: starts_with(x, 'CWE-'))")}, ', '), '') AS weaknesses,
   coalesce(array_to_string(list_filter({_SORTED.format("list_transform(coalesce(affected_products, []), lambda x: replace(replace(x, ':', ''), chr(92) || '/', '//'))")}, lambda x: x <> ''), ', '), '') AS products,
   cvss_v3.base_score AS score, cvss_v3.base_severity AS severity, CASE WHEN cvss_v3.base_score IS NULL THEN NULL WHEN ingest_id % 2 = 0 OR ingest_id % 3 = 0 THEN '3.0' ELSE '3.1' END AS version,
   CASE WHEN ingest_id % 2 = 0 THEN '1.1' ELSE '2.0' END AS dialect, 'https://a.example/, ' || source AS refs, published_date, strftime(last_modified_at, '%Y-%m-%d %H:%M:%S.%f') AS modified, ingest_id FROM cves WHERE cve_id <> '')"""


@query(f"WITH {_RECORDS} SELECT cve_id, md5(description) AS description, weaknesses, products, score, CASE WHEN score IS NOT NULL THEN severity END AS severity, version, dialect, refs, published_date AS published FROM rec")
def feed_records(spark, d):
    """Both dialects read from files and brought into one form: first English text, weaknesses, products of nodes and children, scores, references."""
    c = F.col
    return _records(spark, d).select(
        "cve_id", F.md5("description").alias("description"), F.array_join("cwe_ids", ", ").alias("weaknesses"), F.array_join("affected_products", ", ").alias("products"), c("cvss_v3.base_score").alias("score"), c("cvss_v3.base_severity").alias("severity"),
        c("cvss_v3.version").alias("version"), "dialect", F.array_join("references", ", ").alias("refs"), c("published_date").alias("published"),
    )


@query("SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS records, CAST(sum(n) FILTER (before < 600) AS BIGINT) AS capped FROM (SELECT *, sum(n) OVER (ORDER BY g) - n AS before FROM (SELECT ingest_id // 500 AS g, count(*) AS n FROM cves WHERE ingest_id % 2 = 0 GROUP BY 1))")
def capped_files(spark, d):
    """Files of a feed, their records, and the records of the first files that reach 600. All files but the last hold as many, so their order doesn't matter."""
    c = table(spark, d, "cves").filter("ingest_id % 2 = 0")
    path = _objects(_first_dialect(c), "capped", root="CVE_Items")
    counts = sorted(readers.file_counts(spark, path), key=lambda x: -x[1])
    kept = readers.feed_1(spark, readers.first_files(counts, 600)).count()
    return spark.createDataFrame([(len(counts), sum(n for _, n in counts), kept)], "files bigint, records bigint, capped bigint")


@query("SELECT w AS weakness, array_to_string(list_sort(list(c)), ', ') AS capecs, min(c) AS first_pattern FROM (SELECT DISTINCT trim(cwe_id) AS w, trim(capec_id) AS c FROM cve_edges WHERE trim(cwe_id) <> '' AND trim(capec_id) <> '') GROUP BY 1")
def keyed_mapping(spark, d):
    """A mapping keyed by weakness, written as objects and read from the second of two places, the first of which isn't there."""
    pairs = table(spark, d, "cve_edges").select(F.trim("cwe_id").alias("w"), F.trim("capec_id").alias("c")).filter("w <> '' AND c <> ''").distinct()
    rows = pairs.groupBy("w").agg(F.array_sort(F.collect_list("c")).alias("capecs"))
    path = scratch(spark, "mapping")
    entries = F.collect_list(F.struct("w", F.struct("capecs", F.slice("capecs", 1, 1).alias("mitre_techniques"))))
    objects = rows.groupBy(F.pmod(F.hash("w"), F.lit(8))).agg(F.map_from_entries(entries).alias("m"))
    objects.select(F.to_json("m").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return readers.mapping(spark, f"{path}-none", path).select("weakness", F.array_join("capecs", ", ").alias("capecs"), F.get("mitre_techniques", F.lit(0)).alias("first_pattern"))


@query(r"""WITH a AS (SELECT 'ADV-' || doc_id AS advisory_id, cve_id, text FROM documents WHERE doc_type = 'advisory' AND doc_id % 5 <> 0)
 SELECT DISTINCT advisory_id, x AS cve_id FROM (SELECT advisory_id, cve_id AS x FROM a UNION ALL SELECT advisory_id, unnest(regexp_extract_all(text, 'CVE-\d{4}-\d+')) FROM a) WHERE x IS NOT NULL""")
def advisory_index(spark, d):
    """Advisories read from lists of objects: the records that they list or name in any text. Those without a document section don't count."""
    c = F.col
    docs = table(spark, d, "documents").filter("doc_type = 'advisory'")
    name = F.concat(F.lit("ADV-"), "doc_id")
    section = F.when(c("doc_id") % 5 != 0, F.struct(F.lit("t").alias("title"), _one("id", name).alias("tracking")))
    item = F.struct(F.when(c("doc_id") % 2 == 0, name).alias("id"), section.alias("document"), c("text").alias("notes"), c("n_chars").alias("size"), F.array(_one("cve", c("cve_id"))).alias("vulnerabilities"))
    path = _objects(docs.select("doc_id", item.alias("item")), "advisories", "doc_id")
    return readers.advisory_ids(readers.advisories(spark, path))


@query("SELECT DISTINCT cve_id, 'EDB-' || doc_id AS exploit_id FROM documents WHERE starts_with(cve_id, 'CVE-')")
def exploit_index(spark, d):
    item = F.struct(F.concat(F.lit("EDB-"), "doc_id").alias("id"), F.array(F.col("cve_id"), F.lit("OSVDB-1")).alias("cve_refs"))
    return readers.exploits(spark, _objects(table(spark, d, "documents").select("doc_id", item.alias("item")), "exploits", "doc_id"))


@query("SELECT cve_id AS id, min(source) AS vendor_project, min(coalesce(title, '')) AS product FROM cves WHERE is_in_kev AND cve_id IS NOT NULL GROUP BY 1")
def exploited_csv(spark, d):
    """The exploited list as CSV, quotes and line breaks included."""
    path = scratch(spark, "kev")
    rows = table(spark, d, "cves").filter("is_in_kev AND cve_id IS NOT NULL").select(F.col("cve_id").alias("cveID"), F.col("source").alias("vendorProject"), F.coalesce("title", F.lit("")).alias("product"), F.lit(" CWE-1 , ,CWE-2").alias("cwes"))
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    read = readers.exploited_csv(spark, path).filter(F.array_join("cwes", "+") == "CWE-1+CWE-2")
    return read.groupBy("id").agg(F.min("vendor_project").alias("vendor_project"), F.min("product").alias("product"))


@query("SELECT cve_id AS id, arg_max(title, ingest_id) AS product FROM cves WHERE starts_with(cve_id, 'CVE-') AND is_in_kev AND title <> '' GROUP BY 1")
def exploited_json(spark, d):
    """The exploited list as JSON; the last row of each id is written as the only one of its file."""
    best = table(spark, d, "cves").filter("is_in_kev AND title <> ''").groupBy("cve_id").agg(F.max_by("title", "ingest_id").alias("t"), F.max("ingest_id").alias("ingest_id"))
    path = _objects(best.select("ingest_id", F.struct(F.col("cve_id").alias("id"), F.col("t").alias("product")).alias("item")), "kev-json")
    return readers.exploited_json(spark, path).select("id", "product")


@query("""WITH p AS (SELECT DISTINCT regexp_replace(trim(cwe_id), '\\D', '', 'g') AS w, regexp_replace(trim(capec_id), '\\D', '', 'g') AS c FROM cve_edges WHERE regexp_matches(cwe_id, '\\d') AND regexp_matches(capec_id, '\\d')),
 w AS (SELECT w, list(c) AS cs FROM p GROUP BY 1)
 SELECT 'CWE-' || w AS weakness, array_to_string(list_sort(list_transform(cs, lambda x: 'CAPEC-' || x)), ', ') AS capecs, array_to_string(list_sort(list_transform(list_filter(cs, lambda x: CAST(x AS BIGINT) % 2 = 0), lambda x: 'T1' || x)), ', ') AS techniques FROM w""".replace("\\\\", "\\"))
def mapping_from_xml(spark, d):
    """Weaknesses and patterns written as XML and read back, joined over two hops. Even patterns name a technique."""
    digits = lambda c: F.regexp_replace(F.trim(c), r"\D", "")
    pairs = table(spark, d, "cve_edges").select(digits("cwe_id").alias("w"), digits("capec_id").alias("c")).filter("w <> '' AND c <> ''").distinct()
    weak, pat = scratch(spark, "weaknesses-xml"), scratch(spark, "patterns-xml")
    related = _one("Related_Attack_Pattern", F.collect_list(_one("_CAPEC_ID", F.col("c"))))
    pairs.groupBy(F.col("w").alias("_ID")).agg(related.alias("Related_Attack_Patterns")).write.format("xml").option("rowTag", "Weakness").option("rootTag", "Weaknesses").save(weak)
    taxonomy = F.struct(F.when(F.col("c").cast("bigint") % 2 == 0, "ATTACK").otherwise("OTHER").alias("_Taxonomy_Name"), F.concat(F.lit("1"), "c").alias("Entry_ID"))
    pats = pairs.select("c").distinct().select(F.col("c").alias("_ID"), F.lit("n").alias("_Name"), F.lit("some text").alias("Description"), _one("Taxonomy_Mapping", F.array(taxonomy)).alias("Taxonomy_Mappings"))
    pats.write.format("xml").option("rowTag", "Attack_Pattern").option("rootTag", "Attack_Patterns").save(pat)
    none = spark.createDataFrame([], "technique_id string, description string")
    m = r.weakness_mapping(readers.weaknesses_xml(spark, weak), readers.patterns_xml(spark, pat), none)
    return m.select("weakness", F.array_join("capecs", ", ").alias("capecs"), F.array_join("mitre_techniques", ", ").alias("techniques"))


@query("SELECT cve_id AS id, count(*) AS n FROM cves WHERE cve_id IS NOT NULL GROUP BY 1")
def records_of_any_shape(spark, d):
    """Records of four shapes of files: both feeds, lists, single objects."""
    c = table(spark, d, "cves").filter("cve_id IS NOT NULL")
    part = lambda k: c.filter(F.col("ingest_id") % 4 == k)
    flat = part(2).select("ingest_id", _one("id", F.col("cve_id")).alias("item"))
    single = scratch(spark, "single")
    part(3).select(F.to_json(F.struct("cve_id")).alias("value")).write.option("maxRecordsPerFile", 1).text(single)
    paths = [_objects(_first_dialect(part(0)), "any-1", root="CVE_Items"), _objects(_second_dialect(part(1)), "any-2", root="vulnerabilities"), _objects(flat, "any-3"), single]
    every = readers.any_shape(spark, paths[0])
    for p in paths[1:]:
        every = every.unionByName(readers.any_shape(spark, p))
    return every.groupBy("id").agg(F.count("*").alias("n"))


@query("""SELECT product_name AS asset, n AS component, w AS cwe_id, count(*) AS n FROM (SELECT product_name, 'part' AS n, unnest(CASE WHEN product_row % 2 = 0 THEN ['CWE-1'] ELSE ['CWE-2', 'CWE-3'] END) AS w FROM product_nodes WHERE product_name IS NOT NULL) GROUP BY ALL""")
def asset_weaknesses(spark, d):
    """An inventory of assets whose weaknesses are one text or a list."""
    c = F.col
    base = table(spark, d, "product_nodes").filter("product_name IS NOT NULL")
    def item(w):  # noqa: E306
        return F.struct(c("product_name").alias("name"), F.array(F.struct(F.lit("part").alias("name"), F.array(_one("cwe_id", w)).alias("vulnerabilities"))).alias("components"))
    paths = [_objects(base.filter(f"product_row % 2 = {k}").select("product_row", item(w).alias("item")), f"assets-{k}", "product_row", "Assets") for k, w in ((0, F.lit("CWE-1")), (1, F.array(F.lit("CWE-2"), F.lit("CWE-3"))))]
    both = readers.assets(spark, paths[0]).unionByName(readers.assets(spark, paths[1]))
    return both.groupBy("asset", "component", "cwe_id").agg(F.count("*").alias("n"))


@query(r"SELECT 'CWE-' || regexp_extract(cwe_id, '\d+', 0) AS cwe_id, count(*) AS pages, 'CWE-' || regexp_extract(cwe_id, '\d+', 0) || '1' AS follows FROM cwe_nodes WHERE regexp_matches(cwe_id, '\d') GROUP BY ALL")
def follow_pages(spark, d):
    """Pages of weaknesses: the id from the title, followers from the rows that say so."""
    number = F.regexp_extract("cwe_id", r"\d+", 0)
    html = F.concat(F.lit("<html><head><title>"), F.lit("CWE-"), number, F.lit(": x</title></head><table><tr><td>ChildOf</td><td>B</td><td>no</td></tr><tr><td>CanFollow</td><td>B</td><td> CWE-"), number, F.lit("1 </td></tr></table></html>"))
    pages = table(spark, d, "cwe_nodes").filter(number != "").select(html.alias("html"))
    return readers.can_follow(pages).groupBy("cwe_id", F.array_join("cwe_canfollow", ", ").alias("follows")).agg(F.count("*").alias("pages"))


@query("SELECT CASE WHEN cve_id IS NULL OR cve_id = '' THEN 'unknown' WHEN regexp_full_match(split_part(cve_id, '-', 2), '\\d{4}') THEN split_part(cve_id, '-', 2) ELSE 'other' END AS year, count(*) AS n, min(ingest_id) AS first_row FROM cves WHERE is_in_kev GROUP BY 1".replace("\\\\", "\\"))
def documents_by_year(spark, d):
    """Documents written by year, twice with the same result, and read back by kind."""
    path = scratch(spark, "documents")
    docs = table(spark, d, "cves").select(F.col("cve_id").alias("id"), "ingest_id", F.when(F.col("is_in_kev"), "CVE").otherwise("KEV").alias("document_type"))
    for _ in range(2):
        sinks.documents(docs, path)
    return readers.documents(spark, path).groupBy(F.col("year").cast("string").alias("year")).agg(F.count("*").alias("n"), F.min("ingest_id").alias("first_row"))


@query("SELECT example_id % 7 AS part, count(*) AS n, count(input) AS inputs, md5(string_agg(md5(coalesce(output, '-')), '' ORDER BY md5(coalesce(output, '-')))) AS outputs FROM training_examples GROUP BY 1")
def example_files(spark, d):
    """Training examples written as JSON lines and read back; nulls stay nulls."""
    path = scratch(spark, "examples")
    t = table(spark, d, "training_examples")
    for k in range(7):
        sinks.examples(t.filter(f"example_id % 7 = {k}"), f"{path}/part={k}")
    read = spark.read.schema("instruction string, input string, output string, part bigint").json(path)
    marks = read.groupBy("part", F.md5(F.coalesce("output", F.lit("-"))).alias("m")).agg(F.count("*").alias("n"), F.count("input").alias("inputs"))
    text = F.md5(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("m", "n"))), lambda x: F.array_repeat(x["m"], x["n"].cast("int")))), ""))
    return marks.groupBy("part").agg(F.sum("n").alias("n"), F.sum("inputs").alias("inputs"), text.alias("outputs"))


@query("""SELECT cve_id, arg_max(title, (m, ingest_id)) AS title, max((m, ingest_id)).ingest_id AS ingest_id FROM (SELECT *, coalesce(last_modified_at, TIMESTAMP '0001-01-01') AS m FROM cves WHERE cve_id IS NOT NULL) GROUP BY 1""".replace("max((m, ingest_id)).ingest_id", "arg_max(ingest_id, (m, ingest_id))"))
def streamed_latest(spark, d):
    """The latest state of each record, kept by a stream of batches that arrive in no order."""
    source, target = scratch(spark, "stream-in"), scratch(spark, "stream-out")
    rows = table(spark, d, "cves").select("cve_id", "title", "ingest_id", "last_modified_at").withColumn("last_modified_at", F.coalesce("last_modified_at", F.lit("0001-01-01").cast("timestamp_ntz")))
    rows.repartition(3, "ingest_id").write.parquet(source)
    stream = streams.read_records(spark, source, rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), 1)
    streams.keep_latest(stream, target, f"{target}-log", "cve_id", ["last_modified_at", "ingest_id"]).awaitTermination()
    return streams.latest_state(spark, target).select("cve_id", "title", "ingest_id")


@query("""WITH old AS (SELECT * FROM cves WHERE ingest_id % 2 = 0 AND cve_id IS NOT NULL), new AS (SELECT * FROM cves WHERE ingest_id % 2 = 1 AND cve_id IS NOT NULL)
 SELECT cve_id, arg_max(source, (o, side)) AS source, arg_max(ingest_id, (o, side, ingest_id)) AS ingest_id FROM (SELECT cve_id, source, ingest_id, ingest_id // 4 AS o, 0 AS side FROM old UNION ALL SELECT cve_id, source, ingest_id, ingest_id // 4, 1 FROM new) GROUP BY 1""")
def upsert(spark, d):
    """New rows merged into old ones by an order with ties, which the new ones win."""
    t = table(spark, d, "cves").filter("cve_id IS NOT NULL").select("cve_id", "source", "ingest_id", F.floor(F.col("ingest_id") / 4).alias("o"))
    # Within a side the order has ties as well; the greater row stands for its side.
    side = lambda k: t.filter(f"ingest_id % 2 = {k}").groupBy("cve_id", "o").agg(F.max_by("source", "ingest_id").alias("source"), F.max("ingest_id").alias("ingest_id"))
    return sinks.merged(side(0), side(1), "cve_id", "o").select("cve_id", "source", "ingest_id")


@query(f"""WITH {_RECORDS}, cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY coalesce(modified, '') DESC, dialect DESC, ingest_id DESC) AS k FROM rec) WHERE k = 1),
 adv AS (SELECT cve_id, list_sort(list(DISTINCT 'A' || doc_id)) AS a FROM documents WHERE doc_type = 'advisory' AND cve_id IS NOT NULL GROUP BY 1),
 kev AS (SELECT DISTINCT cve_id FROM cves WHERE is_in_kev)
 SELECT cur.cve_id, kev.cve_id IS NOT NULL AS exploited, coalesce(array_to_string(a, ', '), '') AS advisories, weaknesses FROM cur LEFT JOIN adv USING (cve_id) LEFT JOIN kev ON kev.cve_id = cur.cve_id
 WHERE NOT regexp_matches(lower(description), 'rejected reason|rejected:|rejection reason|this cve has been rejected|cve rejected|rejected cve|not a vulnerability|duplicate of|duplicate cve|withdrawn|withdrawal reason')""")
def enriched_records(spark, d):
    """The latest record of each id from both feeds, without rejected ones, with the exploited flag and nested advisories."""
    docs, cves = table(spark, d, "documents"), table(spark, d, "cves")
    kev = cves.filter("is_in_kev").select(F.col("cve_id").alias("id"))
    adv = docs.filter("doc_type = 'advisory' AND cve_id IS NOT NULL").select("cve_id", F.concat(F.lit("A"), "doc_id").alias("advisory_id"))
    none = spark.createDataFrame([], "cve_id string, exploit_id string")
    mapping = spark.createDataFrame([], "weakness string, capecs array<string>, mitre_techniques array<string>")
    got = r.enriched(r.current(_records(spark, d)), kev, adv, none, mapping)
    return got.select("cve_id", F.col("is_in_kev").alias("exploited"), F.array_join("advisory_ids", ", ").alias("advisories"), F.array_join("cwe_ids", ", ").alias("weaknesses"))


@query("SELECT doc_id, md5(text) AS text FROM documents WHERE text <> '' AND doc_id % 2 = 0 AND NOT contains(text, chr(13)) AND NOT contains(text, chr(0))")
def encoded_files(spark, d):
    """Texts written with a mark of UTF-8 and read back by whichever encoding fits."""
    path = scratch(spark, "texts")
    rows = table(spark, d, "documents").filter("text <> '' AND doc_id % 2 = 0").filter(~F.contains("text", F.lit("\r")) & ~F.contains("text", F.lit("\0")))
    # One file holds many texts: each begins with its number on a line of marks.
    body = F.concat(F.lit("\x1e"), F.col("doc_id").cast("string"), F.lit("\x1f"), "text")
    rows.select(body.alias("value")).write.text(path, lineSep="\x1d")
    read = readers.text_any_encoding(spark, path).select(F.explode(F.split("text", "\x1d")).alias("t")).filter(F.col("t").startswith("\x1e"))
    return read.select(F.substring_index(F.substring("t", 2, 1 << 30), "\x1f", 1).cast("bigint").alias("doc_id"), F.md5(F.regexp_extract("t", "(?s)^[^\x1f]*\x1f(.*)$", 1)).alias("text"))



@query(f"""WITH {_RECORDS}, cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY coalesce(modified, '') DESC, dialect DESC, ingest_id DESC) AS k FROM rec) WHERE k = 1
   AND NOT regexp_matches(lower(description), 'rejected reason|rejected:|rejection reason|this cve has been rejected|cve rejected|rejected cve|not a vulnerability|duplicate of|duplicate cve|withdrawn|withdrawal reason')),
 e AS (SELECT cve_id, 'AFFECTS' AS rel, unnest(string_split(products, ', ')) AS dst FROM cur UNION ALL SELECT cve_id, 'HAS_WEAKNESS', unnest(string_split(weaknesses, ', ')) FROM cur)
 SELECT 'records' AS name, count(*) AS n FROM cur UNION ALL SELECT 'documents', count(*) FROM cur WHERE description <> '' UNION ALL SELECT 'edges', count(DISTINCT (cve_id, rel, dst)) FROM e WHERE dst <> '' UNION ALL SELECT 'figures', count(DISTINCT rel) FROM e WHERE dst <> ''""")
def pipeline_tables(spark, d):
    """Rows of the tables that the whole pipeline writes from feeds of both dialects."""
    from adit import pipeline

    first, second = _feeds(spark, d)
    written = pipeline.run(spark, scratch(spark, "pipeline"), first, second)
    parts = [t.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, t in written.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT 'nodes' AS name, count(*) AS n FROM (SELECT DISTINCT vendor_name FROM vendor_nodes) UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT edge_id FROM cve_edges) UNION ALL SELECT 'products', count(*) FROM (SELECT DISTINCT coalesce(normalized_vendor, '') || ':' || coalesce(normalized_product, '') FROM cpe_components) UNION ALL SELECT 'factors', count(*) FROM embeddings")
def written_tables(spark, d):
    """Nodes, edges, the product dictionary and factors written as tables, twice, and read back by name."""
    from adit.operators.products import product_dictionary

    root = scratch(spark, "tables")
    parts = {"nodes": table(spark, d, "vendor_nodes").select("vendor_name").distinct(), "edges": table(spark, d, "cve_edges"), "products": product_dictionary(table(spark, d, "cpe_components")), "factors": table(spark, d, "embeddings")}
    for _ in range(2):
        sinks.tables(parts, root)
    out = None
    for name, t in readers.tables(spark, root).items():
        part = t.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT count(*) AS n, count(DISTINCT cve_id) AS records, CAST(sum(CASE WHEN is_in_kev THEN 1 ELSE 0 END) AS BIGINT) AS exploited FROM cves")
def summary_file(spark, d):
    """A row of figures written as one JSON file and read back."""
    path = scratch(spark, "summary")
    sinks.summary(table(spark, d, "cves").agg(F.count("*").alias("n"), F.countDistinct("cve_id").alias("records"), F.count_if("is_in_kev").alias("exploited")), path)
    return spark.read.schema("n bigint, records bigint, exploited bigint").json(path)


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def streamed_windows(spark, d):
    """Rows and their mean by kind and hour, counted by a stream."""
    source = scratch(spark, "events")
    e = table(spark, d, "events")
    e.write.parquet(source)
    counts = streams.windowed_counts(streams.read_records(spark, source, e.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")))
    name = "windows_" + source.rsplit("-", 1)[1]
    counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", "mean")
