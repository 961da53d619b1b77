"""Property graph as two tables: nodes(id, kind) and edges(src, rel, dst), and what is computed over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adit.functions.identifiers import parent_technique
from adit.operators.orphans import name_key, number_key
from adit.operators.relations import numbered
from adit.runtime import cut, small_enough


def _filled(c: Column) -> Column:
    return F.trim(c) != ""


def edges_of(cve_edges: DataFrame) -> DataFrame:
    """Distinct edges (src, rel, dst) of records to products, weaknesses and patterns, in canonical spelling.

    Null and blank references are no edges; repeats collapse, as merging them one by one would.
    """
    cells = F.array(
        F.struct(F.lit("AFFECTS").alias("rel"), F.when(_filled(F.col("product_name")), name_key(F.col("product_name"))).alias("dst")),
        F.struct(F.lit("HAS_WEAKNESS").alias("rel"), F.when(_filled(F.col("cwe_id")), F.concat(F.lit("CWE-"), number_key(F.col("cwe_id")))).alias("dst")),
        F.struct(F.lit("HAS_ATTACK_PATTERN").alias("rel"), F.when(_filled(F.col("capec_id")), F.concat(F.lit("CAPEC-"), number_key(F.col("capec_id")))).alias("dst")),
    )
    return cve_edges.select(F.col("cve_id").alias("src"), F.inline(cells)).filter(F.col("dst").isNotNull()).distinct()


def technique_edges(cves: DataFrame) -> DataFrame:
    """Distinct edges (src, 'USES_TECHNIQUE', dst) of records to the techniques they list."""
    rows = cves.filter("cve_id IS NOT NULL").select(F.col("cve_id").alias("src"), F.explode("mitre_techniques").alias("dst"))
    return rows.filter(F.trim("dst") != "").select("src", F.lit("USES_TECHNIQUE").alias("rel"), "dst").distinct()


def tactic_edges(technique_edges: DataFrame, tactics: DataFrame) -> DataFrame:
    """Distinct edges (src, 'BELONGS_TO_TACTIC', dst) of records to the tactics (technique_id, tactic) of their techniques."""
    pairs = tactics.select(F.col("technique_id").alias("dst"), "tactic").distinct()
    side = F.broadcast(pairs) if small_enough(pairs) else pairs
    return technique_edges.join(side, "dst").select("src", F.lit("BELONGS_TO_TACTIC").alias("rel"), F.col("tactic").alias("dst")).distinct()


def parent_edges(technique_edges: DataFrame) -> DataFrame:
    """Distinct edges (src, 'BELONGS_TO_TACTIC', dst) of records to the techniques of their sub-techniques, which records list as tactics."""
    return technique_edges.filter(F.contains("dst", F.lit("."))).select("src", F.lit("BELONGS_TO_TACTIC").alias("rel"), parent_technique(F.col("dst")).alias("dst")).distinct()


def version_edges(product_nodes: DataFrame) -> DataFrame:
    """Distinct edges (src, 'HAS_VERSION', dst) of products to their versions, without '*'. A version's key is the version
    with the product's name, so that products of one name share it."""
    name = name_key(F.col("product_name"))
    rows = product_nodes.filter(F.col("product_name").isNotNull()).select(name.alias("src"), F.explode("versions").alias("v"))
    return rows.filter((F.trim("v") != "") & (F.col("v") != "*")).select("src", F.lit("HAS_VERSION").alias("rel"), F.concat_ws("|", "v", "src").alias("dst")).distinct()


#: How nodes of each kind are named.
NODE_NAMES = {
    "HAS_WEAKNESS": ("CWE", "Common Weakness Enumeration "),
    "HAS_ATTACK_PATTERN": ("CAPEC", "Common Attack Pattern "),
    "USES_TECHNIQUE": ("MITRE_TECHNIQUE", "MITRE ATT&CK Technique "),
    "BELONGS_TO_TACTIC": ("MITRE_TACTIC", "MITRE ATT&CK Tactic "),
}


def threat_nodes(edges: DataFrame) -> DataFrame:
    """The nodes that records' edges lead to: node_type, id, name, vulnerability_count."""
    kinds = F.create_map(*[F.lit(x) for rel, (kind, _) in NODE_NAMES.items() for x in (rel, kind)])
    names = F.create_map(*[F.lit(x) for rel, (_, name) in NODE_NAMES.items() for x in (rel, name)])
    counted = edges.filter(F.col("rel").isin(*NODE_NAMES)).groupBy("rel", F.col("dst").alias("id")).agg(F.count("*").alias("vulnerability_count"))
    return counted.select(F.try_element_at(kinds, F.col("rel")).alias("node_type"), "id", F.concat(F.try_element_at(names, F.col("rel")), "id").alias("name"), "vulnerability_count")


def threat_documents(nodes: DataFrame) -> DataFrame:
    """Nodes as documents for retrieval: document_type, id, name, vulnerability_count, text_for_embedding."""
    label = F.when(F.col("node_type") == "MITRE_TECHNIQUE", "MITRE Technique").when(F.col("node_type") == "MITRE_TACTIC", "MITRE Tactic").otherwise(F.col("node_type"))
    text = F.concat(label, F.lit(" "), "id", F.lit(": "), "name", F.lit(" - "), F.col("vulnerability_count").cast("string"), F.lit(" vulnerabilities"))
    return nodes.select(F.col("node_type").alias("document_type"), "id", "name", "vulnerability_count", text.alias("text_for_embedding"))


def made_by(product_nodes: DataFrame) -> DataFrame:
    """Each product's vendor (product, vendor): the first by name where rows disagree."""
    return product_nodes.groupBy(name_key(F.col("product_name")).alias("product")).agg(F.min("vendor_name").alias("vendor"))


def nodes_of(cves: DataFrame, product_nodes: DataFrame, vendor_nodes: DataFrame, cwe_nodes: DataFrame, capec_nodes: DataFrame) -> DataFrame:
    """Distinct nodes (kind, id)."""
    parts = [
        cves.select(F.lit("CVE").alias("kind"), F.col("cve_id").alias("id")),
        product_nodes.select(F.lit("Product"), name_key(F.col("product_name"))),
        vendor_nodes.select(F.lit("Vendor"), "vendor_name"),
        cwe_nodes.select(F.lit("CWE"), F.concat(F.lit("CWE-"), number_key(F.col("cwe_id")))),
        capec_nodes.select(F.lit("CAPEC"), F.concat(F.lit("CAPEC-"), number_key(F.col("capec_id")))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.filter(F.col("id").isNotNull()).distinct()


def counts_by(df: DataFrame, key: str, label: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(label))


def top(df: DataFrame, measure: str, key: str, n: int) -> DataFrame:
    """The n rows of the greatest measure, ties by key."""
    return df.orderBy(F.desc(measure), key).limit(n)


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """Direct neighbours of a node either way: rel, id."""
    out = edges.filter(F.col("src") == node).select("rel", F.col("dst").alias("id"))
    return out.union(edges.filter(F.col("dst") == node).select("rel", "src")).distinct()


def neighbour_sets(edges: DataFrame, rel: str, name: str) -> DataFrame:
    return edges.filter(F.col("rel") == rel).groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias(name))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; 0 when either side has none."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.coalesce(F.size(a), F.lit(0)) == 0) | (F.coalesce(F.size(b), F.lit(0)) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def closeness(a: Column, b: Column) -> Column:
    """1 less a tenth of the difference of two scores; 0 unless both are positive."""
    return F.when((a > 0) & (b > 0), 1 - F.abs(a - b) / 10).otherwise(0.0)


#: Shares of the parts of a similarity.
WEIGHTS = {"HAS_WEAKNESS": 0.4, "AFFECTS": 0.3, "HAS_ATTACK_PATTERN": 0.2}
SCORE_WEIGHT = 0.1


def similar_records(edges: DataFrame, scores: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """For each query (column src), the k records most like it: src, other, similarity, rank.

    Candidates share a neighbour. The similarity blends the Jaccard ratios of the three neighbour sets with the
    closeness of scores; ranks are of the exact blend, ties by name. Records are numbered in the order of their names,
    so that numbers stand for names until the k best are known. Shared neighbours are counted in the join of the queries'
    edges with all edges, partly before the shuffle, and sizes of sets give the unions, so that no set is carried about.
    The queries are a set of stated size; their edges are counted before they are broadcast, and beyond that joined by
    shuffle.
    """
    names = cut(numbered(edges.select("src").distinct(), [F.col("src")], "id"), "names")
    kinds = F.create_map(*[F.lit(x) for i, r in enumerate(WEIGHTS) for x in (r, i)])
    links = cut(edges.join(names, "src").select("id", F.try_element_at(kinds, F.col("rel")).cast("byte").alias("rel"), F.col("dst")).filter("rel IS NOT NULL"), "links")
    top = scores.groupBy("src").agg(F.max("score").alias("score"))
    each = lambda x: [F.count_if(F.col("rel") == i).cast("int").alias(f"{x}{i}") for i in range(len(WEIGHTS))]
    facts = links.groupBy("id").agg(*each("d")).join(names, "id").join(top, "src", "left").drop("src")
    wanted = names.join(queries.select("src").distinct(), "src", "left_semi").select("id")
    mine = links.join(wanted, "id", "left_semi").select(F.col("id").alias("q"), "rel", "dst")
    side = F.broadcast(mine) if small_enough(mine, 200_000) else mine
    shared = links.join(side, ["rel", "dst"]).filter("id <> q").groupBy("q", "id").agg(*each("c"))
    own = facts.join(wanted, "id", "left_semi").select(F.col("id").alias("q"), F.col("score").alias("q_score"), *[F.col(f"d{i}").alias(f"e{i}") for i in range(len(WEIGHTS))])
    both = shared.join(facts, "id").join(own, "q")
    total = closeness(F.col("q_score"), F.col("score")) * SCORE_WEIGHT
    for i, w in enumerate(WEIGHTS.values()):
        c = F.col(f"c{i}")
        total = total + F.when(c > 0, c / (F.col(f"d{i}") + F.col(f"e{i}") - c)).otherwise(0.0) * w
    ranked = both.select("q", "id", total.alias("similarity")).filter("similarity > 0")
    best = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "id"))).filter(F.col("rank") <= k)
    named = best.join(names.select(F.col("id").alias("q"), "src"), "q").join(names.select("id", F.col("src").alias("other")), "id")
    return named.select("src", "other", F.round("similarity", 6).alias("similarity"), "rank")


def clusters(edges: DataFrame, rel: str, least: int) -> DataFrame:
    """Records by shared neighbour, where there are at least `least`: dst, size, first_member, last_member.

    Members are counted, not collected, so that a hot neighbour is one row like others; a join of edges with the
    clusters lists them.
    """
    return edges.filter(F.col("rel") == rel).groupBy("dst").agg(F.count("*").alias("size"), F.min("src").alias("first_member"), F.max("src").alias("last_member")).filter(F.col("size") >= least)


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """n_nodes, n_edges, density m / (n (n - 1)) and average degree 2 m / n, as one row."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    n = nodes.select(one.alias("v"), none.alias("e")).union(edges.select(none, one)).agg(F.coalesce(F.sum("v"), none).alias("n_nodes"), F.coalesce(F.sum("e"), none).alias("n_edges"))
    size = F.col("n_nodes").cast("double")
    return n.select(
        "n_nodes", "n_edges", F.round(F.when(size > 1, F.col("n_edges") / (size * (size - 1))).otherwise(0.0), 12).alias("density"), F.round(F.when(size > 0, 2 * F.col("n_edges") / size).otherwise(0.0), 9).alias("avg_degree")
    )


def features(nodes: DataFrame, edges: DataFrame, least: int = 5) -> DataFrame:
    """A graph's figures: figure and value, for nodes and edges by kind, degrees, and clusters by weakness."""
    value = lambda c: c.cast("double").alias("value")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    parts = [
        nodes.agg(value(F.count("*"))).select(F.lit("nodes").alias("figure"), "value"),
        edges.agg(value(F.count("*"))).select(F.lit("edges").alias("figure"), "value"),
        edges.groupBy("rel").agg(value(F.count("*"))).select(F.concat(F.lit("edges "), "rel").alias("figure"), "value"),
        nodes.groupBy("kind").agg(value(F.count("*"))).select(F.concat(F.lit("nodes "), "kind").alias("figure"), "value"),
        ends.agg(F.max("d").cast("double").alias("a"), F.round(F.avg("d"), 6).alias("b")).select(F.inline(F.array(F.struct(F.lit("degree max").alias("figure"), F.col("a").alias("value")), F.struct(F.lit("degree avg").alias("figure"), F.col("b").alias("value"))))),
        clusters(edges, "HAS_WEAKNESS", least).agg(value(F.count("*"))).select(F.lit("clusters").alias("figure"), "value"),
    ]
    return reduce(DataFrame.unionByName, parts)


def statistics(cves: DataFrame, edges: DataFrame) -> DataFrame:
    """Figures of records and edges: figure and n. Records are counted once, severities by row."""
    once = cves.agg(
        F.countDistinct("cve_id").alias("records"), F.countDistinct(F.when(F.col("is_in_kev"), F.col("cve_id"))).alias("exploited"), F.countDistinct(F.when(F.col("cvss_v3.base_score") > 0, F.col("cve_id"))).alias("with score")
    )
    rows = once.select(F.inline(F.array(*[F.struct(F.lit(c).alias("figure"), F.col(f"`{c}`").alias("n")) for c in once.columns])))
    severity = cves.groupBy(F.concat(F.lit("severity "), F.coalesce("cvss_v3.base_severity", F.lit("UNKNOWN"))).alias("figure")).agg(F.count("*").alias("n"))
    return reduce(DataFrame.unionByName, [rows, severity, edges.groupBy(F.concat(F.lit("edges "), "rel").alias("figure")).agg(F.count("*").alias("n"))])


def undirected(edges: DataFrame) -> DataFrame:
    """src, dst, weight either way; the weights of parallel edges are added."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src")))
    return both.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def pagerank(edges: DataFrame, rounds: int = 100, damping: float = 0.85, tolerance: float = 1e-6, converge: bool = True) -> DataFrame:
    """Rank of every node of the undirected weighted graph: id, rank; the ranks add up to 1.

    Links and their shares of a node's weight are written once; a round is one join and one aggregation by node. Every
    fifth round is written to the shared folder, which cuts the lineage and tells how far ranks still move.
    """
    links = undirected(edges)
    links = cut(links.join(links.groupBy("src").agg(F.sum("weight").alias("total")), "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "links")
    n = links.select("src").distinct().count()
    if not n:
        return links.select(F.col("src").alias("id"), F.lit(0.0).alias("rank"))
    ids = links.select(F.col("src").alias("id")).distinct()
    ranks = last = ids.withColumn("rank", F.lit(1.0 / n))
    for i in range(1, rounds + 1):
        given = links.join(ranks, links["src"] == ranks["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        ranks = given.select("id", (F.lit((1 - damping) / n) + damping * F.col("got")).alias("rank"))
        if i % 5 == 0 and i < rounds:
            ranks = cut(ranks, "ranks")
            if converge:
                moved = ranks.join(last.withColumnRenamed("rank", "old"), "id").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
                if moved < n * tolerance:
                    break
                last = ranks
    return ranks


def betweenness(edges: DataFrame, pivots: int = 100) -> DataFrame:
    """Approximate betweenness of an undirected graph from shortest paths of `pivots` sources: id, betweenness.

    Sources are the first nodes by hash. All of them go outward together, a level at a time: a join with the links gives
    the next level with its numbers of shortest paths, and then the levels give back, from the last to the first, what
    paths through them contribute. Levels are written, so that a job holds one of them; neither the nodes nor the links
    go to the driver. Sums are scaled to all sources and normalized. A node that no path passes has 0.
    """
    pairs = edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst").distinct()
    links = cut(pairs, "links")
    nodes = links.select(F.col("src").alias("id")).distinct()
    n = nodes.count()
    if n < 3:
        return nodes.withColumn("betweenness", F.lit(0.0))
    first = nodes.orderBy(F.xxhash64("id"), "id").limit(pivots).select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("ways"))
    levels = [cut(first, "level")]
    while True:
        near = levels[-1].join(links, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.sum("ways").alias("ways"))
        # A neighbour of a level is in it, in the one before or in the next.
        for known in levels[-2:]:
            near = near.join(known.select("s", "v"), ["s", "v"], "left_anti")
        near = cut(near, "level")
        if near.isEmpty():
            break
        levels.append(near)
    shares = levels[-1].withColumn("share", F.lit(0.0))
    parts = []
    for level in reversed(levels[:-1]):
        parts.append(shares.select("v", "share"))
        given = shares.select("s", F.col("v").alias("w"), ((1 + F.col("share")) / F.col("ways")).alias("g"))
        back = given.join(links, F.col("w") == F.col("src")).select("s", F.col("dst").alias("v"), "g").groupBy("s", "v").agg(F.sum("g").alias("g"))
        shares = cut(level.join(back, ["s", "v"], "left").select("s", "v", "ways", (F.col("ways") * F.coalesce("g", F.lit(0.0))).alias("share")), "shares")
    scale = n / min(pivots, n) / ((n - 1) * (n - 2))
    empty = links.limit(0).select(F.col("src").alias("v"), F.lit(0.0).alias("share"))
    sums = reduce(DataFrame.unionByName, parts, empty).groupBy(F.col("v").alias("id")).agg((F.sum("share") * F.lit(scale)).alias("b"))
    return nodes.join(sums, "id", "left").select("id", F.coalesce("b", F.lit(0.0)).alias("betweenness"))
