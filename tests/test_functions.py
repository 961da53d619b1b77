from pyspark.sql import functions as F

from adit.functions import identifiers as i
from adit.functions import texts as t
from adit.operators import vectors as v


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first().r


def test_identifiers(spark):
    p = one(spark, "cpe:2.3:a:apache:http%20server:-:x+y:%zz", i.parsed)
    assert (p.part, p.vendor, p.product, p.version, p.update, p.edition, p.other) == ("a", "apache", "http server", "", "x+y", "%zz", "*")
    assert one(spark, "nope", i.parsed) is None and one(spark, None, i.parsed) is None
    assert one(spark, "Red_Hat Inc", i.normal_vendor) == "redhat" and one(spark, "Foo Bar", i.normal_vendor) == "foo_bar" and one(spark, "*", i.normal_vendor) == "*"
    assert one(spark, "Apache HTTP_Server", i.normal_product) == "http_server"
    assert [one(spark, x, i.version_kind) for x in ("2.4.41", "1909", "12-rc", "beta", "xp", "*", None)] == ["semantic", "date_based", "build_number", "custom", "windows_version", "unknown", "unknown"]
    assert one(spark, "2.4", lambda c: i.version_number(c, 3)) == 0
    assert [one(spark, x, i.weakness_id) for x in ("cwe-79", "79", "cwe 79", "x")] == ["CWE-79", "CWE-79", "CWE-79", None]
    assert one(spark, "T1548.004", i.parent_technique) == "T1548" and one(spark, "T1548", i.parent_technique) is None
    assert one(spark, "a:b", i.product_of) == ""


def test_texts(spark):
    assert one(spark, "linux_kernel's foo2bar", t.title) == "Linux_Kernel'S Foo2Bar"
    text = " ".join(f"w{k}" for k in range(1000))
    got = one(spark, text, t.chunks)
    assert len(got) == 3 and got[1].startswith("w462 ") and got[-1].endswith("w999")
    assert one(spark, " a  b ", t.chunks) == [" a  b "] and one(spark, None, t.chunks) == [] and one(spark, "", t.chunks) == [""]
    assert one(spark, "A remote code execution vulnerability exists that allows an attacker to execute arbitrary commands via SQL injection attacks.", t.phrase_techniques) == ["T1059", "T1190", "T1203", "T1210"]
    assert one(spark, "buffer overflow allows remote code execution via command injection", t.phrase_techniques) == ["T1055", "T1059", "T1190", "T1203", "T1210"]
    assert one(spark, "## H\n**B**:\nrest", t.without_headers) == "rest"
    assert one(spark, "a, b;;c", t.listed) == ["a", "b", "c"]
    assert one(spark, ["Foo Labs", None], lambda c: t.mentions(c, ["labs"]), "array<string>") and not one(spark, None, lambda c: t.mentions(c, ["labs"]), "array<string>")


def test_vectors(spark, rows):
    df = spark.createDataFrame([(k, [float(k == j) for j in range(3)], k % 2) for k in range(3)] + [(9, None, 0)], "vec_id bigint, embedding array<float>, label int")
    assert [r.vec_id for r in v.search(df.filter("embedding IS NOT NULL"), [1.0, 0.5, 0.0], 2).collect()] == [0, 1]
    got = rows(v.neighbours(df, df, 1).select("query_id", "vec_id"))
    assert got == [(0, 1), (1, 0), (2, 0)]
    assert v.mean(df.filter("label = 0 AND embedding IS NOT NULL")).first()[0] == [0.5, 0.0, 0.5]
    e = v.hashed_text(spark.createDataFrame([(1, "a b a"), (2, None)], "k int, text string"), "text").collect()
    assert abs(sum(x * x for x in e[0].embedding) - 1) < 1e-6 and not any(e[1].embedding)
