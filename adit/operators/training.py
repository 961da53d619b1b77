"""Instruction examples from records: assembly, templates, rotation of forms, repeats, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adit.functions import texts as t
from adit.operators.relations import flagged, looked_up, numbered
from adit.runtime import small_enough

_NONE = "array<string>"
#: Instructions and frames that examples rotate through.
INSTRUCTIONS = (
    "Analyze this CVE vulnerability and provide a comprehensive security assessment.",
    "Examine the following CVE and explain its technical details and potential impact.",
    "Provide a detailed analysis of this cybersecurity vulnerability with mitigation strategies.",
    "Investigate this CVE and describe its attack vectors and security implications.",
    "Conduct a thorough security analysis of this vulnerability, including risk assessment.",
    "Review this CVE and provide technical insights along with recommended countermeasures.",
    "Analyze the security implications of this vulnerability and suggest protective measures.",
    "Examine this CVE for potential threats and provide detailed security recommendations.",
    "Provide a comprehensive vulnerability analysis with technical details and remediation steps.",
    "Investigate this cybersecurity issue and explain its severity and potential exploits.",
    "Conduct a detailed security review of this CVE with attack scenario analysis.",
    "Analyze this vulnerability's technical aspects and provide security best practices.",
    "Review this CVE for security risks and provide detailed mitigation guidance.",
    "Examine this vulnerability and explain its technical characteristics and security impact.",
    "Provide a thorough analysis of this CVE with technical details and security recommendations.",
)
ASPECTS = (
    "Focus on the technical implementation details and code-level analysis.",
    "Emphasize the business impact and risk assessment aspects.",
    "Include MITRE ATT&CK framework mapping and attack patterns.",
    "Provide detailed remediation steps and security controls.",
    "Analyze the vulnerability from an attacker's perspective.",
    "Focus on detection methods and monitoring strategies.",
    "Include compliance implications and regulatory considerations.",
    "Provide detailed patch analysis and update recommendations.",
)
INPUT_HEADS = ("CVE Information:", "Vulnerability Details:", "Security Issue:", "CVE Analysis Request:", "Vulnerability Assessment:", "Security Analysis:", "CVE Details:", "Vulnerability Report:")
OUTPUT_HEADS = ("## Analysis", "**Security Assessment:**", "### Vulnerability Analysis", "**CVE Analysis:**", "## Security Review", "**Technical Assessment:**", "### Security Analysis", "**Vulnerability Assessment:**")
#: Three examples of ten get an aspect behind their instruction.
ASPECT_SHARE = 3


def _some(c: str) -> Column:
    return F.array_compact(F.coalesce(c, F.array().cast(_NONE)))


def examples(cves: DataFrame, techniques: DataFrame) -> DataFrame:
    """ingest_id, kind, instruction, input, output: analysis, remediation and technical for every record with a title and
    a description, detection and mitigation for those with known techniques.

    What the vector says of reach, rights and effort is taken from it, not assumed.
    """
    known = techniques.filter("technique_id IS NOT NULL").groupBy("technique_id").agg(F.min(F.concat_ws(" ", F.concat(F.lit("- **"), "technique_id", F.lit(":** ")), "technique_name")).alias("line"))
    base = cves.filter((F.col("title") != "") & (F.col("description") != ""))
    with_lines = base.join(looked_up(base.select("ingest_id", "mitre_techniques"), "ingest_id", "mitre_techniques", known, "technique_id", "line").withColumnRenamed("line", "technique_lines").drop("n"), "ingest_id", "left")
    c = F.col
    severity, score = F.coalesce("cvss_v3.base_severity", F.lit("UNKNOWN")), F.coalesce(c("cvss_v3.base_score"), F.lit(0.0))
    vector = F.coalesce("cvss_v3.vector_string", F.lit(""))
    products = F.coalesce(t.joined(_some("affected_products")), F.lit("Not specified"))
    prompt = F.concat(F.lit("CVE ID: "), F.coalesce("cve_id", F.lit("")), F.lit("\nTitle: "), "title", F.lit("\nDescription: "), "description", F.lit("\nAffected Products: "), products)
    reach = F.when(vector.contains("AV:N"), "It can be reached over the network.").when(vector.contains("AV:A"), "It can be reached from the same network segment.").when(vector.contains("AV:L"), "It needs local access.").when(vector.contains("AV:P"), "It needs physical access.")
    rights = F.when(vector.contains("PR:N"), "No rights are needed.").when(vector.contains("PR:L"), "Low rights are needed.").when(vector.contains("PR:H"), "High rights are needed.")
    lines = F.array_join(F.slice("technique_lines", 1, 3), "\n")
    urgent = F.when(score >= 9, "immediately").when(score >= 7, "within days").otherwise("with the next regular update")
    kinds = {
        "analysis": ("Analyze the following record and provide a security assessment.", t.lines(F.concat(F.lit("**Severity:** "), severity), F.concat(F.lit("**Details:**\n"), "description"), reach, t.labelled("**Weaknesses:** ", t.joined(_some("cwe_refs"))), F.when(c("is_in_kev"), "It is known to be exploited."))),
        "remediation": ("Write remediation guidance for this record.", t.lines(F.concat(F.lit("Affected: "), products), F.concat(F.lit("Update "), urgent, F.lit(".")), rights)),
        "technical": ("Explain the technical details of this record.", t.lines(c("description"), F.when(vector != "", F.concat(F.lit("Vector: "), vector)), reach, rights)),
        "detection": ("Describe how an attempt could be detected.", F.when(lines != "", F.concat(F.lit("Watch for these techniques:\n"), lines))),
        "mitigation": ("Suggest mitigations for the techniques involved.", F.when(lines != "", F.concat(F.lit("Mitigate these techniques:\n"), lines))),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("instruction"), prompt.alias("input"), o.alias("output")) for k, (i, o) in kinds.items()])
    return with_lines.select("ingest_id", F.inline(rows)).filter(F.col("output").isNotNull())


def _pick(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def _chance(*parts: Column | str, seed: int) -> Column:
    """A number below 2 ** 28 that follows from the parts and a seed."""
    text = F.concat_ws("|", F.lit(seed), *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("bigint")


def diversified(df: DataFrame, limit: int | None = None, seed: int = 42, forms: tuple[tuple[str, ...], ...] = (INSTRUCTIONS + ASPECTS, ASPECTS, INPUT_HEADS, OUTPUT_HEADS)) -> DataFrame:
    """Examples in rotating forms, without repeats: ingest_id, kind, number, instruction, input, output.

    The form follows from the number of the example in the order of ingest_id and kind, as a walk over all of them would
    give; three of ten get an aspect, by a hash in place of chance. Headings of outputs go. Of equal examples the first
    counts. `limit` takes the first by another hash, as a shuffle would. forms: instructions, aspects, heads of inputs
    and of outputs.
    """
    instructions, aspects, input_heads, output_heads = forms
    rows = numbered(df, [F.col("ingest_id"), F.col("kind")], "number")
    number, chance = F.col("number"), _chance("ingest_id", "kind", seed=seed)
    aspect = F.when(chance % 10 < ASPECT_SHARE, F.concat(F.lit(" "), _pick(aspects, F.floor(chance / 10))))
    body = F.regexp_replace(t.without_headers(F.col("output")), r"^\s+|\s+$", "")
    out = rows.select(
        "ingest_id",
        "kind",
        "number",
        F.concat(_pick(instructions, number), F.coalesce(aspect, F.lit(""))).alias("instruction"),
        F.concat(_pick(input_heads, number), F.lit("\n"), "input").alias("input"),
        F.concat(_pick(output_heads, number), F.lit("\n"), body).alias("output"),
    )
    kept = out.join(without_repeats(out, "number").select("number"), "number", "left_semi")
    return kept.orderBy(_chance("kind", "ingest_id", seed=seed), "number").limit(limit) if limit else kept


def enriched_records(cves: DataFrame, edges: DataFrame, exploited: DataFrame, techniques: DataFrame) -> DataFrame:
    """Records as examples are made of them: id, title, description, score, severity, affected_products, is_in_kev, cwes,
    mitre_techniques, technique_details (in the order of the techniques), mitre_tactics, capecs.

    cves: one row per cve_id, with mitre_techniques. edges: those to weaknesses, patterns and tactics. exploited: cve_id.
    techniques: technique_id, name, description, detection, data_sources, one row each; unknown ones have no details.
    """
    kinds = {"HAS_WEAKNESS": "cwes", "HAS_ATTACK_PATTERN": "capecs", "BELONGS_TO_TACTIC": "mitre_tactics"}
    nested = edges.groupBy(F.col("src").alias("cve_id")).agg(*[F.array_sort(F.collect_set(F.when(F.col("rel") == r, F.col("dst")))).alias(n) for r, n in kinds.items()])
    places = cves.select("cve_id", F.posexplode(_some("mitre_techniques")).alias("place", "technique_id"))
    fields = ["name", "description", "detection", "data_sources"]
    side = F.broadcast(techniques) if small_enough(techniques) else techniques
    detail = places.join(side, "technique_id").groupBy("cve_id").agg(F.array_sort(F.collect_list(F.struct("place", F.col("technique_id").alias("id"), *fields))).alias("technique_details"))
    flagged_rows = flagged(cves, exploited.select("cve_id").distinct(), "cve_id", "in_kev")
    both = flagged_rows.join(nested, "cve_id", "left").join(detail, "cve_id", "left")
    none = F.array().cast(_NONE)
    return both.select(
        F.col("cve_id").alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("cvss_v3.base_score", F.lit(0.0)).alias("score"),
        F.coalesce("cvss_v3.base_severity", F.lit("UNKNOWN")).alias("severity"), _some("affected_products").alias("affected_products"), F.col("in_kev").alias("is_in_kev"), F.coalesce("cwes", none).alias("cwes"), _some("mitre_techniques").alias("mitre_techniques"),
        F.coalesce("technique_details", F.array()).alias("technique_details"), F.coalesce("mitre_tactics", none).alias("mitre_tactics"), F.coalesce("capecs", none).alias("capecs"),
    )


def prompts(df: DataFrame, instruction_size: int = 100, input_size: int = 400, output_size: int = 250) -> DataFrame:
    """Examples as one text each, `text`, their parts cut to a size and marked where cut."""
    part = lambda c, n: t.shortened(F.coalesce(c, F.lit("")), n)
    text = F.concat(F.lit("Instruction: "), part("instruction", instruction_size), F.lit("\nInput: "), part("input", input_size), F.lit("\nOutput: "), part("output", output_size))
    return df.withColumn("text", text)


def without_repeats(df: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The first key of equal examples, and how many there are. Texts meet by their SHA-256, nulls equal to nulls only."""
    text = F.to_json(F.struct("instruction", "input", "output"), {"ignoreNullFields": "false"})
    marks = df.select(key, *keep, F.unhex(F.sha2(text, 256)).alias("mark"))
    best = F.min(F.struct(key, *keep))
    return marks.groupBy("mark").agg(best.alias("k"), F.count("*").alias("copies")).select("k.*", "copies")


def quality(df: DataFrame) -> DataFrame:
    """Numbers of examples, different instructions and outputs, and ratios of diversity and repeats, as one row."""
    mark = lambda c: F.md5(F.coalesce(c, F.lit("")))
    n = F.count("*")
    return df.agg(
        n.alias("n"),
        F.countDistinct("instruction").alias("instructions"),
        F.round(F.countDistinct("instruction") / n, 9).alias("instruction_diversity"),
        F.countDistinct(mark("output")).alias("outputs"),
        F.round(1 - F.countDistinct(F.concat(mark("instruction"), mark("input"), mark("output"))) / n, 9).alias("repeat_ratio"),
    )
