import json
import zipfile

import pytest
from pyspark.sql import functions as F

from adit.operators import records as r
from adit.sources import readers, sinks


@pytest.fixture
def feeds(tmp_path):
    one = {
        "CVE_Items": [
            {
                "cve": {
                    "CVE_data_meta": {"ID": "CVE-2023-12345"},
                    "description": {"description_data": [{"lang": "de", "value": "nein"}, {"lang": "en", "value": "A flaw."}, {"lang": "en", "value": "second"}]},
                    "problemtype": {"problemtype_data": [{"description": [{"lang": "en", "value": "CWE-79"}, {"lang": "en", "value": "NVD-CWE-Other"}]}]},
                    "references": {"reference_data": [{"url": "https://a.example"}, {"url": ""}]},
                },
                "configurations": {
                    "nodes": [
                        {
                            "operator": "OR",
                            "cpe_match": [{"cpe23Uri": "cpe:2.3:a:apache:http_server:2.4.41:*:*:*:*:*:*:*"}],
                            "children": [{"cpe_match": [{"cpe23Uri": "cpe:2.3:a:apache:http_server:2.4.42:*:*:*:*:*:*:*"}]}],
                        }
                    ]
                },
                "impact": {"baseMetricV3": {"cvssV3": {"baseScore": 9.8, "baseSeverity": "CRITICAL", "vectorString": "CVSS:3.0/AV:N"}}},
                "publishedDate": "2023-01-01",
                "lastModifiedDate": "2023-01-02",
            },
            {"cve": {"CVE_data_meta": {"ID": ""}}},
        ]
    }
    two = {
        "vulnerabilities": [
            {
                "cve": {
                    "id": "CVE-2023-12345",
                    "published": "2023-01-01",
                    "lastModified": "2023-05-02",
                    "descriptions": [{"lang": "en", "value": "A newer text."}],
                    "metrics": {"cvssMetricV30": [{"cvssData": {"baseScore": 5.0}}], "cvssMetricV31": [{"cvssData": {"baseScore": 7.5, "baseSeverity": "HIGH"}}]},
                    "weaknesses": [{"description": [{"lang": "en", "value": "CWE-89"}, {"lang": "es", "value": "CWE-1"}]}],
                    "configurations": [{"nodes": [{"operator": "OR", "negate": False, "cpeMatch": [{"criteria": "cpe:2.3:o:microsoft:windows_10:1909:*:*:*:*:*:*:*"}]}]}],
                }
            },
            {"cve": {"id": "CVE-2023-67890", "descriptions": [{"lang": "en", "value": "Rejected reason: duplicate of another."}]}},
            {"cve": {"id": "CVE-2022-1", "lastModified": "2022", "descriptions": []}},
        ]
    }
    (tmp_path / "nvdcve-1.1-2023.json").write_text(json.dumps(one, indent=1))
    (tmp_path / "nvdcve-2.0-2023.json").write_text(json.dumps(two, indent=1))
    (tmp_path / "nvdcve-2.0-broken.json").write_text('{"vulnerabilities": [')
    return tmp_path


def test_feeds_to_documents(spark, feeds, rows, tmp_path):
    a = r.normalised_1(readers.feed_1(spark, f"{feeds}/nvdcve-1.1-*.json"))
    b = r.normalised_2(readers.feed_2(spark, f"{feeds}/nvdcve-2.0-*.json"))
    first = a.collect()
    assert len(first) == 1 and first[0].description == "A flaw." and first[0].cwe_ids == ["CWE-79"] and first[0].references == ["https://a.example"]
    assert first[0].affected_products == ["http_server"] and len(first[0].identifiers) == 2 and first[0].cvss_v3.base_score == 9.8 and first[0].cvss_v2 is None
    records = r.current(a.unionByName(b))
    got = {x.cve_id: x for x in records.collect()}
    assert set(got) == {"CVE-2023-12345", "CVE-2022-1"}
    assert got["CVE-2023-12345"].cvss_v3.version == "3.1" and got["CVE-2023-12345"].cwe_ids == ["CWE-89"]
    kev = spark.createDataFrame([("CVE-2023-12345",), ("CVE-2023-12345",)], "id string")
    adv = spark.createDataFrame([("CVE-2023-12345", "A2"), ("CVE-2023-12345", "A1")], "cve_id string, advisory_id string")
    exp = spark.createDataFrame([], "cve_id string, exploit_id string")
    mapping = spark.createDataFrame([("CWE-89", ["CAPEC-66", "CAPEC-7"], ["T1190", "T1548.001"])], "weakness string, capecs array<string>, mitre_techniques array<string>")
    e = r.enriched(records, kev, adv, exp, mapping)
    x = {y.cve_id: y for y in e.collect()}
    assert x["CVE-2023-12345"].is_in_kev and x["CVE-2023-12345"].advisory_ids == ["A1", "A2"] and x["CVE-2023-12345"].parent_techniques == ["T1548"]
    assert not x["CVE-2022-1"].is_in_kev and x["CVE-2022-1"].capec_entries == [] and e.count() == 2
    docs = r.documents_of(e)
    assert docs.count() == 1 and "Related CAPECs: CAPEC-66, CAPEC-7" in docs.first().content and {"capec_capec-66", "sql_injection", "kev"} <= set(docs.first().tags)
    out = f"{tmp_path}/docs"
    sinks.documents(docs, out)
    sinks.documents(docs, out)
    assert readers.documents(spark, out, ["2023"]).count() == 1 and readers.documents(spark, out, ["2022"]).count() == 0
    assert "PartitionFilters: [isnotnull(year" in readers.documents(spark, out, ["2023"])._jdf.queryExecution().toString()


def test_small_readers(spark, tmp_path, rows):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/one.json", '{"a": 1}')
    (tmp_path / "bad.zip").write_bytes(b"not a zip")
    assert rows(readers.zipped(spark, str(tmp_path)).select("member", "text")) == [("x/one.json", '{"a": 1}')]
    with zipfile.ZipFile(tmp_path / "feed.zip", "w") as z:
        z.writestr("f.json", json.dumps({"CVE_Items": [{"cve": {"CVE_data_meta": {"ID": "CVE-2020-7"}}}]}))
    zipped = readers.zipped(spark, str(tmp_path), "feed.zip")
    assert rows(r.normalised_1(readers.feed_1(spark, zipped)).select("cve_id")) == [("CVE-2020-7",)]
    (tmp_path / "names.json").write_text(json.dumps({"techniques": {"T1": {"name": "one"}, "T2": {}}}))
    assert rows(readers.technique_names(spark, f"{tmp_path}/names.json")) == [("T1", "one"), ("T2", None)]
    (tmp_path / "sheets").mkdir()
    (tmp_path / "sheets" / "a.csv").write_text("id,name\n1,x\n")
    (tmp_path / "sheets" / "~$a.csv").write_text("id,name\n2,y\n")
    assert rows(readers.sheet(spark, f"{tmp_path}/sheets")) == [("1", "x")]
    assert readers.first_files([("a", 5), ("b", 5), ("c", 5)], 6) == ["a", "b"]
    (tmp_path / "map.json").write_text(json.dumps({"CWE-79": {"capecs": ["CAPEC-63"], "mitre_techniques": ["T1059"]}}))
    assert rows(readers.mapping(spark, f"{tmp_path}/none.json", f"{tmp_path}/map.json").select("weakness", "capecs")) == [("CWE-79", ["CAPEC-63"])]
    (tmp_path / "adv.json").write_text(json.dumps([{"id": "X", "notes": "on CVE-2020-1111", "n": 5, "document": {"title": "CVE-2020-3333"}, "vulnerabilities": [{"cve": "CVE-2020-2"}]}, {"id": "no document"}]))
    adv = readers.advisories(spark, f"{tmp_path}/adv.json")
    assert rows(readers.advisory_ids(adv)) == [("CVE-2020-1111", "X"), ("CVE-2020-2", "X")]
    (tmp_path / "exp.json").write_text(json.dumps({"id": "E", "cve_refs": ["CVE-1-1", "OTHER", None]}))
    assert rows(readers.exploits(spark, f"{tmp_path}/exp.json")) == [("CVE-1-1", "E")]
    (tmp_path / "kev.csv").write_text('cveID,vendorProject,product,vulnerabilityName,dateAdded,cwes\nCVE-1-2,V,P,"a, b",2020,"CWE-1, CWE-2"\n,V,P,x,2020,\n')
    got = readers.exploited_csv(spark, f"{tmp_path}/kev.csv").collect()
    assert len(got) == 1 and got[0].cwes == ["CWE-1", "CWE-2"] and got[0].vulnerability_name == "a, b"
    (tmp_path / "c.xml").write_text(
        '<?xml version="1.0"?><Attack_Pattern_Catalog xmlns="http://capec.mitre.org/capec-3"><Attack_Patterns><Attack_Pattern ID="66" Name="Q"><Description>d</Description>'
        "<Taxonomy_Mappings><Taxonomy_Mapping Taxonomy_Name=\"ATTACK\"><Entry_ID>1190</Entry_ID></Taxonomy_Mapping></Taxonomy_Mappings></Attack_Pattern></Attack_Patterns></Attack_Pattern_Catalog>"
    )
    assert rows(readers.patterns_xml(spark, f"{tmp_path}/c.xml").select("capec_id", "techniques")) == [("CAPEC-66", ["T1190"])]
    (tmp_path / "w.xml").write_text('<W><Weakness ID="89" Name="n"><Related_Attack_Patterns><Related_Attack_Pattern CAPEC_ID="66"/></Related_Attack_Patterns></Weakness></W>')
    assert rows(readers.weaknesses_xml(spark, f"{tmp_path}/w.xml")) == [("CWE-89", ["CAPEC-66"])]
    m = r.weakness_mapping(readers.weaknesses_xml(spark, f"{tmp_path}/w.xml"), readers.patterns_xml(spark, f"{tmp_path}/c.xml"), spark.createDataFrame([("T1190", "text")], "technique_id string, description string"))
    assert rows(m) == [("CWE-89", ["CAPEC-66"], ["T1190"], "text")]
    for name, body in (("s1", {"CVE_Items": [{"cve": {"CVE_data_meta": {"ID": "CVE-1-1"}}}]}), ("s2", [{"id": "CVE-1-2"}]), ("s3", {"cve_id": "CVE-1-3"}), ("s4", {"vulnerabilities": [{"cve": {"id": "CVE-1-4"}}]})):
        (tmp_path / f"{name}.shape").write_text(json.dumps(body))
    (tmp_path / "s5.shape").write_text("{")
    assert rows(readers.any_shape(spark, f"{tmp_path}/*.shape").select("id")) == [(f"CVE-1-{i}",) for i in (1, 2, 3, 4)]
    (tmp_path / "assets.json").write_text(json.dumps({"Assets": [{"name": "a", "components": [{"name": "c", "vulnerabilities": [{"cwe_id": "CWE-1"}, {"cwe_id": ["CWE-2", "CWE-3"]}, {}]}]}]}))
    assert [x[2] for x in rows(readers.assets(spark, f"{tmp_path}/assets.json"))] == ["CWE-1", "CWE-2", "CWE-3"]
    (tmp_path / "l.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "u.txt").write_bytes(b"\xef\xbb\xbf" + "é".encode())
    assert [x[0] for x in rows(readers.text_any_encoding(spark, f"{tmp_path}/*.txt").select("text"))] == ["é", "é"]


def test_pages(spark, rows):
    html = "<html><title>CWE - CWE-119: x</title><table><tr><td>CanFollow</td><td>B</td><td> 20 </td></tr><tr><td>PeerOf</td><td>B</td><td>3</td></tr></table></html>"
    df = spark.createDataFrame([(html,), ("<title>none</title>",), (None,)], "html string")
    assert rows(readers.can_follow(df)) == [("CWE-119", ["20"])]


def test_upsert(spark, rows):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, v int, t string")
    new = spark.createDataFrame([("a", 1, "z"), ("b", 4, "no"), ("c", 1, "w")], "k string, v int, t string")
    assert rows(sinks.merged(old, new, "k", "v")) == [("a", 1, "z"), ("b", 5, "y"), ("c", 1, "w")]


def test_stream(spark, tmp_path, rows):
    from adit.streaming.records import keep_latest, latest_state, read_records, windowed_counts

    src = f"{tmp_path}/src"
    schema = "cve_id string, v int"
    spark.createDataFrame([("a", 2), ("b", 1), (None, 9)], schema).coalesce(1).write.parquet(src)
    for i, batch in enumerate(([("a", 1), ("b", 3)], [("c", 1)])):
        q = keep_latest(read_records(spark, src, schema), f"{tmp_path}/out", f"{tmp_path}/cp", "cve_id", ["v"])
        q.awaitTermination()
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
    q = keep_latest(read_records(spark, src, schema), f"{tmp_path}/out", f"{tmp_path}/cp", "cve_id", ["v"])
    q.awaitTermination()
    assert rows(latest_state(spark, f"{tmp_path}/out").select("cve_id", "v")) == [("a", 2), ("b", 3), ("c", 1)]
    folder = f"{tmp_path}/events"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(folder)
    events = read_records(spark, folder, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    q = windowed_counts(events).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM windows").first()[0] == spark.read.parquet(folder).count()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("i", None, "o")], "instruction string, input string, output string")
    sinks.examples(df, f"{tmp_path}/e")
    assert spark.read.json(f"{tmp_path}/e").count() == 1
    sinks.tables({"n": df, "m": df}, f"{tmp_path}/t")
    sinks.summary(df.agg(F.count("*").alias("n")), f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/t/m").count() == spark.read.json(f"{tmp_path}/s").first().n == 1


def test_workbook(spark, tmp_path, rows):
    """Shared, inline and missing cells; temporary and broken files are no sheets."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda r, t, v: f'<c r="{r}" t="{t}"><v>{v}</v></c>'
    body = [cell("A1", "s", 0) + cell("B1", "s", 1) + cell("D1", "s", 2), cell("A2", "s", 3) + '<c r="D2"><v>7.5</v></c>', '<c r="B3" t="inlineStr"><is><t>in</t></is></c>' + cell("A3", "s", 4)]
    for name in ("a.xlsx", "~$a.xlsx"):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{x}</t></si>" for x in ("ID", "name", "score", "T1")) + "<si><r><t>T</t></r><r><t>2</t></r></si></sst>")
            z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>" + "".join(f"<row>{r}</row>" for r in body) + "</sheetData></worksheet>")
    (tmp_path / "b.xlsx").write_bytes(b"no")
    got = readers.sheet(spark, f"{tmp_path}/*.xlsx")
    assert got.columns == ["ID", "name", "score"] and rows(got) == [("T1", "", "7.5"), ("T2", "in", "")]


def test_documents_of_feeds(spark, rows):
    from adit.operators.exports import advisory_documents, direct_documents, pattern_documents

    p = spark.createDataFrame([("CAPEC-1", None, " text "), ("", "x", "y"), (None, "x", "y")], "capec_id string, name string, description string")
    assert rows(pattern_documents(p).select("id", "title", "content")) == [("CAPEC-1", "CAPEC-1", "text")]
    a = spark.createDataFrame([("x-1", None, ["CVE-1-1"]), (None, "t", None)], "id string, title string, cve_ids array<string>")
    assert rows(advisory_documents(a)) == [("X-1", "CSAF", "", ["CVE-1-1"])]
    d = spark.createDataFrame([("CVE-1-1", "t", "body", ["CWE-1", None])], "id string, title string, content string, cwe_refs array<string>")
    got = direct_documents(d).first()
    assert got.text_for_embedding == "CVE ID: CVE-1-1 | Title: t | Description: body | Common Weaknesses: CWE-1" and got.tags == [] and got.is_in_kev is False


def test_command(capsys):
    from adit.__main__ import main

    assert main(["nothing"]) == 2 and "record_techniques" in capsys.readouterr().out
