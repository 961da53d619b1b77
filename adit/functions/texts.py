"""Column functions on text: phrases, titles, content, chunks, tags, templates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases of rejected records.
REJECTED = (
    "rejected reason",
    "rejected:",
    "rejection reason",
    "this cve has been rejected",
    "cve rejected",
    "rejected cve",
    "not a vulnerability",
    "duplicate of",
    "duplicate cve",
    "withdrawn",
    "withdrawal reason",
)
#: Phrases with the techniques they point to.
PHRASE_TECHNIQUES = {
    "remote code execution": ["T1203", "T1210"],
    "rce": ["T1203", "T1210"],
    "arbitrary code": ["T1203", "T1055"],
    "code execution": ["T1203", "T1059"],
    "privilege escalation": ["T1068", "T1078", "T1548"],
    "elevation of privilege": ["T1068", "T1548"],
    "root access": ["T1068", "T1548.001"],
    "admin access": ["T1078", "T1098"],
    "sql injection": ["T1190"],
    "command injection": ["T1059", "T1190"],
    "code injection": ["T1055", "T1055.001"],
    "ldap injection": ["T1190"],
    "cross-site scripting": ["T1059.007", "T1189"],
    "xss": ["T1059.007", "T1189"],
    "csrf": ["T1185"],
    "xxe": ["T1190"],
    "ssrf": ["T1190", "T1090"],
    "buffer overflow": ["T1203", "T1055"],
    "heap overflow": ["T1203", "T1055"],
    "stack overflow": ["T1203", "T1055"],
    "use after free": ["T1055", "T1203"],
    "memory corruption": ["T1055", "T1203"],
    "authentication bypass": ["T1078", "T1110"],
    "access control": ["T1078", "T1548"],
    "unauthorized access": ["T1078", "T1190"],
    "denial of service": ["T1499", "T1498"],
    "dos": ["T1499", "T1498"],
    "resource exhaustion": ["T1499", "T1496"],
    "information disclosure": ["T1005", "T1083", "T1057"],
    "data exposure": ["T1005", "T1530"],
    "sensitive information": ["T1005", "T1552"],
    "directory traversal": ["T1083", "T1570"],
    "path traversal": ["T1083", "T1570"],
    "file inclusion": ["T1055", "T1574"],
}
#: Terms of the keyword index, and short forms with the phrase they stand for.
TERMS = (
    "apache", "nginx", "iis", "tomcat", "docker", "kubernetes", "windows", "linux", "ubuntu", "debian", "redhat",
    "macos", "chrome", "firefox", "safari", "edge", "mysql", "postgresql", "mongodb", "oracle", "redis", "java",
    "python", "php", "ruby", "javascript", "node.js", "wordpress", "drupal", "joomla", "aws", "azure", "gcp",
    "vmware", "cisco", "microsoft", "adobe", "apple", "google", "android", "ios", "mobile", "5g", "4g", "lte",
    "wifi", "bluetooth",
)
SHORT_TERMS = {
    "rce": "remote code execution",
    "sqli": "sql injection",
    "xss": "cross-site scripting",
    "dos": "denial of service",
    "privesc": "privilege escalation",
    "overflow": "buffer overflow",
}
#: Tags by what a weakness or product contains; of each list the first that is contained wins.
WEAKNESS_TAGS = (
    ("787", ["buffer_overflow", "memory_corruption"]),
    ("125", ["buffer_overflow", "information_disclosure"]),
    ("89", ["sql_injection", "database"]),
    ("79", ["xss", "cross_site_scripting"]),
    ("352", ["csrf", "cross_site_request_forgery"]),
)
PRODUCT_TAGS = ((("web", "server"), "web_application"), (("database", "sql"), "database"), (("os", "operating_system"), "operating_system"))
#: Words of a chunk, and how many of them the next one repeats.
CHUNK_WORDS, CHUNK_OVERLAP = 512, 50


def _with(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def contains_any(c: Column, phrases: tuple[str, ...]) -> Column:
    """Whether the lower-case text holds any of the phrases: one pass of one expression."""
    return F.lower(c).rlike("|".join(re.escape(p) for p in phrases))


def title(c: Column) -> Column:
    """Every run of letters with a capital first and small letters after; ASCII letters."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0)), lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, 2, 1 << 20)))), "")


def joined(a: Column, limit: int | None = None, separator: str = ", ") -> Column:
    """Elements in one string, the first `limit` of them; null where there is none."""
    part = F.slice(a, 1, limit) if limit else a
    return F.when(F.size(a) > 0, F.concat_ws(separator, part))


def lines(*parts: Column, separator: str = "\n") -> Column:
    """Parts in order, without null and empty ones."""
    return F.concat_ws(separator, *[F.when(p != "", p) for p in parts])


def labelled(label: str, value: Column) -> Column:
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(label), value))


def after(label: Column, value: Column) -> Column:
    """A value behind a label that is computed; null without a value."""
    return F.when(value.isNotNull() & (value != ""), F.concat(label, value))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def chunks(c: Column, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Windows of `size` words that start every size - overlap words, joined by blanks; a text of one window stays as it is."""
    w, step = words(c), size - overlap
    cut = F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(step)), lambda at: F.concat_ws(" ", F.slice(w, at + 1, size)))
    return F.when(c.isNull(), F.array().cast("array<string>")).when(F.size(w) <= size, F.array(c)).otherwise(cut)


def density(c: Column, query: str) -> Column:
    """Occurrences of query, without overlap, for each character of the text; both in small letters."""
    low, q = F.lower(c), query.lower()
    return ((F.length(low) - F.length(F.replace(low, F.lit(q), F.lit("")))) / F.lit(len(q))) / F.greatest(F.lit(1), F.length(low))


def mentions(values: Column, terms: list[str]) -> Column:
    """Whether any element holds any term, whatever the case."""
    wanted = F.array(*[F.lit(t.lower()) for t in terms])
    return F.coalesce(F.exists(values, lambda v: F.exists(wanted, lambda t: F.contains(F.lower(v), t))), F.lit(False))


def shortened(c: Column, size: int, mark: str = "...") -> Column:
    return F.when(F.length(c) > size, F.concat(F.left(c, F.lit(size)), F.lit(mark))).otherwise(c)


def without_headers(c: Column) -> Column:
    # The two kinds of headings.
    return F.regexp_replace(F.regexp_replace(c, r"(?m)^#+\s*.*?\n", ""), r"(?m)^\*\*.*?\*\*:\n", "")


def listed(c: Column, separator: str = "[,;]") -> Column:
    """The parts of a list written in one text, without blanks of any kind around them and without empty ones."""
    return F.filter(F.transform(F.split(c, separator), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def phrase_techniques(c: Column) -> Column:
    """Techniques that the phrases of a text point to, sorted."""
    none = F.array().cast("array<string>")

    def found(low: Column) -> Column:
        return F.flatten(F.array(*[F.when(low.contains(p), F.array(*[F.lit(t) for t in ts])).otherwise(none) for p, ts in PHRASE_TECHNIQUES.items()]))

    return F.array_sort(F.array_distinct(_with(F.lower(F.coalesce(c, F.lit(""))), found)))


def keywords(text: Column, products: Column, first_products: int = 5) -> Column:
    """Terms and short terms of a text, and the first words of its first products, sorted."""

    def hits(low: Column) -> Column:
        return F.array(*[F.when(low.contains(t), F.lit(t)) for t in TERMS], *[F.when(low.contains(full) | low.contains(short), F.lit(short)) for short, full in SHORT_TERMS.items()])

    heads = F.filter(F.transform(F.slice(F.coalesce(products, F.array().cast("array<string>")), 1, first_products), lambda p: F.get(words(F.lower(p)), F.lit(0))), lambda w: F.length(w) > 2)
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(_with(F.lower(F.coalesce(text, F.lit(""))), hits), heads))))


def tags(weaknesses: Column, products: Column, patterns: Column, techniques: Column, exploited: Column, tactics: Column | None = None) -> Column:
    """Tags by ordered rules on what elements contain, with the first three patterns, techniques and tactics, sorted, each once."""
    none = F.array().cast("array<string>")

    def by_weakness(x: Column) -> Column:
        out = None
        for part, names in WEAKNESS_TAGS:
            value = F.array(*[F.lit(n) for n in names])
            out = F.when(x.contains(part), value) if out is None else out.when(x.contains(part), value)
        return out.otherwise(none)

    def by_product(x: Column) -> Column:
        low, out = F.lower(x), None
        for parts, name in PRODUCT_TAGS:
            hit = low.contains(parts[0]) | low.contains(parts[1])
            out = F.when(hit, F.array(F.lit(name))) if out is None else out.when(hit, F.array(F.lit(name)))
        return out.otherwise(none)

    some = lambda a: F.array_compact(F.coalesce(a, none))
    prefixed = lambda a, p: F.transform(F.slice(some(a), 1, 3), lambda x: F.concat(F.lit(p), F.lower(x)))
    parts = [
        F.flatten(F.transform(some(weaknesses), by_weakness)),
        F.flatten(F.transform(some(products), by_product)),
        F.when(F.size(some(patterns)) > 0, F.array(F.lit("capec"))).otherwise(none),
        prefixed(patterns, "capec_"),
        F.when(F.size(some(techniques)) > 0, F.array(F.lit("mitre_attack"))).otherwise(none),
        prefixed(techniques, "technique_"),
        none if tactics is None else prefixed(tactics, "tactic_"),
        F.when(exploited, F.array(F.lit("kev"), F.lit("exploited"), F.lit("critical"))).otherwise(none),
    ]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def mention_counts(df: DataFrame, text: str, terms: list[str], least: int = 50, most: int = 5000) -> DataFrame:
    """For each term, the rows whose text mentions it, whatever the case, and the rows of a usable length: term, n, usable."""
    counts = [F.struct(F.lit(x).alias("term"), F.count_if(F.contains(F.lower(text), F.lit(x.lower()))).alias("n"), F.count_if(F.length(text).between(least, most)).alias("usable")) for x in terms]
    return df.agg(F.array(*counts).alias("a")).select(F.inline("a"))
