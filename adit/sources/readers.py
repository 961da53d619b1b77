"""Readers of the raw files. All are lazy; files that aren't valid give no rows instead of ending the job."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adit.functions.identifiers import ids_in
from adit.sources import schemas as s


def zipped(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """Members of archives: archive, member, text (UTF-8). Each archive is opened where it is read; broken ones give no rows."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for m in z.infolist():
                            if not m.is_dir():
                                yield pd.DataFrame({"archive": [archive], "member": [m.filename], "text": [z.read(m).decode("utf-8", "replace")]})
                except zipfile.BadZipFile:
                    continue

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(unpack, "archive string, member string, text string")


def _feed(spark: SparkSession, source: str | DataFrame, schema: str) -> DataFrame:
    """Feed objects of files, or of the column `text` of a DataFrame such as `zipped` gives; broken ones have no items."""
    if isinstance(source, DataFrame):
        return source.select(F.from_json("text", schema).alias("f")).select("f.*")
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(source)


def feed_1(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """Items of feeds in the 1.1 dialect, one row each; source is a path or texts."""
    return _feed(spark, source, s.FEED_1).select(F.explode("CVE_Items").alias("item")).select("item.*")


def feed_2(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """Records of feeds in the 2.0 dialect, one row each; source is a path or texts."""
    return _feed(spark, source, s.FEED_2).select(F.explode("vulnerabilities").alias("v")).select("v.cve.*")


def file_counts(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """The files of feeds in either dialect, in order of their names, with their numbers of records."""
    both = spark.read.schema(f"{s.FEED_1}, {s.FEED_2}").option("multiLine", True).json(path)
    n = F.coalesce(F.size("CVE_Items"), F.lit(0)) + F.coalesce(F.size("vulnerabilities"), F.lit(0))
    counted = both.groupBy(F.input_file_name().alias("file")).agg(F.sum(F.greatest(n, F.lit(0))).alias("n"))
    return [(r.file, r.n) for r in counted.orderBy("file").collect()]


def first_files(files_with_counts: list[tuple[str, int]], most: int) -> list[str]:
    """Files in order until their records reach `most`: the cap falls between files, never within one."""
    out, seen = [], 0
    for path, n in files_with_counts:
        if seen >= most:
            break
        out.append(path)
        seen += n
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def mapping(spark: SparkSession, *paths: str) -> DataFrame:
    """weakness, capecs, mitre_techniques, mitre_description from the first of the paths that exists."""
    path = next((p for p in paths if exists(spark, p)), None)
    if path is None:
        raise FileNotFoundError(", ".join(paths))
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", s.MAPPING)).alias("weakness", "m")).select("weakness", "m.*")


def technique_names(spark: SparkSession, path: str) -> DataFrame:
    """technique_id and name from objects with a map of techniques."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "techniques MAP<STRING, STRUCT<name: STRING>>")["techniques"]).alias("technique_id", "t")).select("technique_id", "t.name")


def advisories(spark: SparkSession, path: str) -> DataFrame:
    """Advisories, an object or a list to a file, that have a document section: id, cve_ids.

    cve_ids are those that the advisory lists, then those that any of its top-level strings names. The id is its own,
    else the one of its tracking section.
    """
    from adit.operators.nested import as_list

    v = spark.read.option("wholetext", True).text(path).select(F.explode(as_list(F.try_parse_json("value"))).alias("v"))
    got = lambda p, kind: F.try_variant_get("v", p, kind)
    listed = F.transform(got("$.vulnerabilities", "array<variant>"), lambda x: F.try_variant_get(x, "$.cve", "string"))
    fields = got("$", "map<string,variant>")
    texts = F.transform(F.map_values(fields), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    none = F.array().cast("array<string>")
    every = F.array_compact(F.array_union(F.coalesce(listed, none), ids_in(F.concat_ws(" ", texts))))
    return v.filter(got("$.document", "variant").isNotNull()).select(F.coalesce(got("$.id", "string"), got("$.document.tracking.id", "string")).alias("id"), every.alias("cve_ids"))


def advisory_ids(advisories: DataFrame) -> DataFrame:
    """cve_id and advisory id, one row per pair."""
    return advisories.select(F.explode("cve_ids").alias("cve_id"), F.col("id").alias("advisory_id")).distinct()


def exploits(spark: SparkSession, path: str) -> DataFrame:
    """cve_id and exploit id, one row per reference."""
    rows = spark.read.schema(s.EXPLOIT).option("multiLine", True).json(path)
    return rows.select(F.explode(F.filter("cve_refs", lambda x: x.startswith("CVE-"))).alias("cve_id"), F.col("id").alias("exploit_id")).distinct()


def exploited_json(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the exploited list, one object to a file; of equal ids the last file by name counts."""
    rows = spark.read.option("multiLine", True).schema("id STRING, vendor_project STRING, product STRING, vulnerability_name STRING, date_added STRING").json(path)
    rows = rows.withColumn("file", F.input_file_name()).filter(F.col("id").startswith("CVE-"))
    rest = [c for c in rows.columns if c not in ("id", "file")]
    return rows.groupBy("id").agg(F.max_by(F.struct(*rest), "file").alias("r")).select("id", "r.*")


def exploited_csv(spark: SparkSession, path: str) -> DataFrame:
    """The exploited list as documents; the key may be in one of three columns. Rows without a key are left out."""
    rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    key = F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in ("cveID", "cve_id", "CVE ID") if c in rows.columns])
    get = lambda c: F.coalesce(F.trim(c), F.lit("")) if c in rows.columns else F.lit("")
    cwes = F.filter(F.transform(F.split(get("cwes"), ","), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select(key.alias("id"), get("vendorProject").alias("vendor_project"), get("product").alias("product"), get("vulnerabilityName").alias("vulnerability_name"), get("dateAdded").alias("date_added"), cwes.alias("cwes")).filter("id IS NOT NULL")


def patterns_xml(spark: SparkSession, path: str) -> DataFrame:
    """Attack patterns: capec_id (with its prefix), name, techniques of the ATTACK taxonomy."""
    rows = spark.read.format("xml").option("rowTag", "Attack_Pattern").schema(s.PATTERN_XML).load(path)
    entries = F.filter(F.coalesce("Taxonomy_Mappings.Taxonomy_Mapping", F.array().cast("array<struct<_Taxonomy_Name:string,Entry_ID:string>>")), lambda m: (m["_Taxonomy_Name"] == "ATTACK") & m["Entry_ID"].isNotNull())
    return rows.select(F.concat(F.lit("CAPEC-"), "_ID").alias("capec_id"), F.col("_Name").alias("name"), F.trim("Description").alias("description"), F.transform(entries, lambda m: F.concat(F.lit("T"), m["Entry_ID"])).alias("techniques"))


def weaknesses_xml(spark: SparkSession, path: str) -> DataFrame:
    """Weaknesses: cwe_id and the patterns related to it."""
    rows = spark.read.format("xml").option("rowTag", "Weakness").schema(s.WEAKNESS_XML).load(path)
    related = F.coalesce("Related_Attack_Patterns.Related_Attack_Pattern", F.array().cast("array<struct<_CAPEC_ID:string>>"))
    return rows.select(F.concat(F.lit("CWE-"), "_ID").alias("cwe_id"), F.array_distinct(F.transform(related, lambda r: F.concat(F.lit("CAPEC-"), r["_CAPEC_ID"]))).alias("capecs"))


def any_shape(spark: SparkSession, path: str) -> DataFrame:
    """Records of files in whichever shape: an object with items of either feed, a list, or one record. Columns: id, record (VARIANT)."""
    from adit.operators.nested import as_list

    v = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("v")).filter("v IS NOT NULL")
    part = lambda k: F.try_variant_get("v", f"$.{k}", "array<variant>")
    rows = v.select(F.explode(F.coalesce(part("CVE_Items"), part("vulnerabilities"), as_list(F.col("v")))).alias("record"))
    paths = ("$.cve.CVE_data_meta.ID", "$.cve.id", "$.id", "$.cve_id")
    return rows.select(F.coalesce(*[F.try_variant_get("record", p, "string") for p in paths]).alias("id"), "record").filter("id IS NOT NULL")


def assets(spark: SparkSession, path: str) -> DataFrame:
    """asset, component and weakness of an inventory; cwe_id may be one string or a list."""
    v = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("v"))
    a = v.select(F.explode(F.try_variant_get("v", "$.Assets", "array<variant>")).alias("a"))
    c = a.select(F.try_variant_get("a", "$.name", "string").alias("asset"), F.explode(F.try_variant_get("a", "$.components", "array<variant>")).alias("c"))
    w = c.select("asset", F.try_variant_get("c", "$.name", "string").alias("component"), F.explode(F.try_variant_get("c", "$.vulnerabilities", "array<variant>")).alias("w"))
    both = F.coalesce(F.try_variant_get("w", "$.cwe_id", "array<string>"), F.array(F.try_variant_get("w", "$.cwe_id", "string")))
    return w.select("asset", "component", F.explode(both).alias("cwe_id")).filter("cwe_id IS NOT NULL")


class _Page(HTMLParser):
    def __init__(self):
        super().__init__()
        self.title, self.cells, self.rows, self.inside = "", [], [], ""

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.inside = "title"
        elif tag == "tr":
            self.cells = []
        elif tag == "td":
            self.inside = "td"
            self.cells.append("")

    def handle_endtag(self, tag):
        if tag in ("title", "td"):
            self.inside = ""
        elif tag == "tr" and self.cells:
            self.rows.append(self.cells)

    def handle_data(self, data):
        if self.inside == "title":
            self.title += data
        elif self.inside == "td":
            self.cells[-1] += data


def can_follow(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """cwe_id and cwe_canfollow (array) of weakness pages: the id from the title, followers from the third cells of rows that say CanFollow."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for html in batch[html_col]:
                page = _Page()
                page.feed(html or "")
                found = re.search(r"CWE-\d+", page.title)
                if found:
                    follow = [c[2].strip() for c in page.rows if len(c) > 2 and c[0].strip() == "CanFollow" and c[2].strip()]
                    out.append((found[0], follow))
            yield pd.DataFrame(out, columns=["cwe_id", "cwe_canfollow"])

    return pages.select(html_col).mapInPandas(scan, "cwe_id string, cwe_canfollow array<string>")


def text_any_encoding(spark: SparkSession, path: str) -> DataFrame:
    """path and text of files in UTF-8, with or without its mark, else in Latin-1."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    utf8 = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    text = F.regexp_replace(F.coalesce(utf8, F.decode("content", "ISO-8859-1")), "^\ufeff", "")
    return raw.select("path", text.alias("text"))


def _cells(content: bytes) -> Iterator[list[str | None]]:
    """The rows of the first sheet of an XLSX file: its texts and numbers as they are written; nothing if it is none."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            shared = []
            if "xl/sharedStrings.xml" in names:
                for _, e in ElementTree.iterparse(z.open("xl/sharedStrings.xml")):
                    if e.tag.endswith("}si"):
                        shared.append("".join(t.text or "" for t in e.iter() if t.tag.endswith("}t")))
            sheets = sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
            if not sheets:
                return
            for _, row in ElementTree.iterparse(z.open(sheets[0])):
                if not row.tag.endswith("}row"):
                    continue
                out: list[str | None] = []
                for c in row:
                    # A cell names its column, as empty ones are left out.
                    letters = re.match("[A-Z]*", c.get("r", ""))[0]
                    at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else len(out)
                    out += [None] * (at + 1 - len(out))
                    value = "".join(t.text or "" for t in c.iter() if t.tag.endswith(("}v", "}t")))
                    out[at] = shared[int(value)] if c.get("t") == "s" and value else value
                yield out
                row.clear()
    except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, IndexError):
        return


def sheet_rows(spark: SparkSession, path: str, pattern: str = "*.xlsx") -> DataFrame:
    """The rows of XLSX files, each read where it is: file, row_no, cells. Temporary and broken files give no rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = list(_cells(content))
                columns = [pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["file", "row_no", "cells"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.filter(~F.element_at(F.split("path", "/"), -1).startswith("~$")).mapInArrow(read, "file string, row_no int, cells array<string>")


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet as all-string columns named by its first row: from XLSX, CSV or Parquet. Empty cells are empty texts in XLSX."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".xlsx"):
        rows = sheet_rows(spark, path)
        head = rows.filter("row_no = 0").orderBy("file").first()
        names = [x for x in (head.cells if head else []) if x]
        at = {x: head.cells.index(x) for x in names}
        return rows.filter("row_no > 0").select(*[F.coalesce(F.get("cells", F.lit(at[x])), F.lit("")).alias(x) for x in names])
    # Temporary files of an office program, which begin with ~$, are no sheets.
    rows = spark.read.option("header", True).csv(path)
    return rows.filter(~F.col("_metadata.file_name").startswith("~$"))


def tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables that sinks.tables wrote under a folder, by name: nodes, edges, products, factors, features, indexes."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = [f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p) if f.isDirectory()]
    return {name: spark.read.parquet(f"{root}/{name}") for name in sorted(found) if not name.startswith(("_", "."))}


def documents(spark: SparkSession, path: str, years: list[str] | None = None, kind: str | None = "CVE") -> DataFrame:
    """Documents that sinks.documents wrote; years and kind reach the scan as partition and pushed filters."""
    df = spark.read.parquet(path)
    if years is not None:
        df = df.filter(F.col("year").isin(*years))
    return df.filter(F.col("document_type") == kind) if kind else df
