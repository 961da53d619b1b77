"""Deeply nested semi-structured records to flat tables that keep parent-child links.

JSON text becomes VARIANT, so that optional keys, single objects in place of lists and both dialects need no schema.
One projection of nested transforms walks the tree and attaches the path of every ancestor; each target table is one
flatten and one inline of it. The projection is unrolled to `levels` of children. Only what text that names children
more often than that has below is walked on by a stack, on Arrow batches, to whatever depth. Nothing runs while a query
is being built.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH_LISTS, MATCH_IDS = ("cpeMatch", "cpe_match"), ("criteria", "cpe23Uri")


def decoded(text: Column) -> Column:
    """The value of a JSON text that may be encoded more than once; null when any layer isn't valid JSON.

    Every layer of encoding doubles the backslashes of the one below it, so that a text has fewer layers than its length
    has binary digits: so many are undone.
    """
    is_text = lambda t: t.rlike(r'^[ \t\r\n]*"')

    def undo(t: Column, _: Column) -> Column:
        return F.when(is_text(t), F.try_variant_get(F.try_parse_json(t), "$", "string")).otherwise(t)

    layers = F.sequence(F.lit(1), F.length(F.bin(F.length(text).cast("bigint"))) + 1)
    return F.try_parse_json(F.when(is_text(text), F.aggregate(layers, text, undo)).otherwise(text))


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def as_list(v: Column) -> Column:
    """A list's elements; an object is a list of one; anything else an empty list."""
    whole = F.try_variant_get(v, "$", "array<variant>")
    return F.coalesce(whole, F.when(is_object(v), F.array(v)), F.array().cast("array<variant>"))


def _get(v: Column, key: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", kind)


def _child(v: Column, key: str) -> Column:
    return as_list(_get(v, key, "variant"))


def _join(path: Column, i: Column) -> Column:
    return F.concat(path, F.lit("/"), i.cast("string"))


def _node(v: Column, path: Column, parent: Column, levels: int) -> Column:
    """All nodes of the tree at v, outermost first: path, parent, operator, negate, match lists, children not walked."""
    here = F.array(
        F.struct(
            path.alias("node_path"),
            parent.alias("parent_path"),
            F.upper(_get(v, "operator", "string")).alias("operator"),
            F.lower(_get(v, "negate", "string")).cast("string").alias("negate"),
            F.concat(*[_child(v, k) for k in MATCH_LISTS]).alias("matches"),
            (F.array().cast("array<variant>") if levels else _child(v, "children")).alias("rest"),
        )
    )
    if not levels:
        return here
    below = F.flatten(F.transform(_child(v, "children"), lambda c, i: _node(c, _join(path, i), path, levels - 1)))
    return F.concat(here, below)


class FlatTables:
    """The tables of one input: configurations, nodes and matches, each row with the key of its record and its parent."""

    def __init__(self, configurations: DataFrame, nodes: DataFrame, matches: DataFrame):
        self.configurations, self.nodes, self.matches = configurations, nodes, matches


def flatten_configurations(records: DataFrame, key_col: str = "record_id", text_col: str = "configurations", levels: int = 6) -> FlatTables:
    """Flat tables of a column of configurations in either dialect.

    configurations(key, config_pos, operator, n_nodes); nodes(key, node_path, parent_path, depth, operator, negate,
    n_matches); matches(key, node_path, match_pos, criteria, vulnerable, version_start_including, version_start_excluding,
    version_end_including, version_end_excluding, match_criteria_id). Positions are 0-based. Null or empty text, text
    that isn't valid JSON and JSON without objects give no rows. Null entries and entries without identifier keep their
    positions; matches has only entries with a non-empty identifier. Repeated records each give their rows. Other
    columns of `records` are ignored.
    """
    base = records.filter(F.col(text_col).isNotNull()).select(F.col(key_col), decoded(F.col(text_col)).alias("v"))
    tops = base.select(key_col, F.posexplode(as_list(F.col("v"))).alias("config_pos", "conf"))
    tops = tops.filter(is_object(F.col("conf")))
    configurations = tops.select(key_col, "config_pos", F.upper(_get(F.col("conf"), "operator", "string")).alias("operator"), F.size(_child(F.col("conf"), "nodes")).alias("n_nodes"))

    nodes = base.select(key_col, F.inline(_walked(levels)))
    # Only text that names children more than `levels` times can nest deeper, so that most text isn't parsed for this. A
    # key may be written with escapes for its letters, and every encoding hides some; such text is parsed too.
    names = F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("children"), F.lit("")))
    deep = records.filter(F.col(text_col).isNotNull() & ((names > 8 * levels) | F.contains(F.col(text_col), F.lit("\\u00"))))
    left = deep.select(F.col(key_col), decoded(F.col(text_col)).alias("v")).select(key_col, F.inline(_walked(levels))).filter(F.size("rest") > 0)
    every = nodes.drop("rest").unionByName(_below(left, key_col))
    flat_nodes = every.select(
        key_col, "node_path", "parent_path", (F.size(F.split("node_path", "/")) - 2).alias("depth"), "operator", "negate", F.size("matches").alias("n_matches")
    )
    entries = every.select(key_col, "node_path", F.posexplode("matches").alias("match_pos", "m"))
    m = F.col("m")
    ids = [_get(m, k, "string") for k in MATCH_IDS]
    matches = entries.select(
        key_col,
        "node_path",
        "match_pos",
        F.coalesce(*[F.when(x != "", x) for x in ids]).alias("criteria"),
        F.lower(_get(m, "vulnerable", "string")).alias("vulnerable"),
        _get(m, "versionStartIncluding", "string").alias("version_start_including"),
        _get(m, "versionStartExcluding", "string").alias("version_start_excluding"),
        _get(m, "versionEndIncluding", "string").alias("version_end_including"),
        _get(m, "versionEndExcluding", "string").alias("version_end_excluding"),
        _get(m, "matchCriteriaId", "string").alias("match_criteria_id"),
    ).filter(F.col("criteria").isNotNull())
    return FlatTables(configurations, flat_nodes, matches)


def _walked(levels: int) -> Column:
    """All nodes of all configurations of the value v."""
    return F.flatten(
        F.transform(as_list(F.col("v")), lambda conf, i: F.flatten(F.transform(_child(conf, "nodes"), lambda n, j: _node(n, _join(i.cast("string"), j), i.cast("string"), levels))))
    )


def _listed(x: object) -> list:
    return x if isinstance(x, list) else [x] if isinstance(x, dict) else []


def _word(x: object) -> str | None:
    """A scalar as the text that a variant gives for it."""
    return x if isinstance(x, str) or x is None else None if isinstance(x, (list, dict)) else json.dumps(x)


def _below(left: DataFrame, key_col: str) -> DataFrame:
    """The nodes under the children that the projection left: a stack in place of recursion, so that no depth is too much."""
    kind = left.schema[key_col].dataType.simpleString()
    given = left.select(key_col, "node_path", F.to_json(F.struct("rest")).alias("rest"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, columns = [], [[] for _ in range(5)]
            for i, (path, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                stack = [(path, k, v) for k, v in reversed(list(enumerate(json.loads(text)["rest"])))]
                while stack:
                    parent, k, v = stack.pop()
                    own = f"{parent}/{k}"
                    node = v if isinstance(v, dict) else {}
                    operator, negate = _word(node.get("operator")), _word(node.get("negate"))
                    matches = [m for name in MATCH_LISTS for m in _listed(node.get(name))]
                    rows.append(i)
                    for c, value in zip(columns, (own, parent, operator and operator.upper(), negate and negate.lower(), [json.dumps(m) for m in matches])):
                        c.append(value)
                    stack += [(own, j, c) for j, c in reversed(list(enumerate(_listed(node.get("children")))))]
            kinds = [pa.string()] * 4 + [pa.list_(pa.string())]
            names = [key_col, "node_path", "parent_path", "operator", "negate", "matches"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names)

    found = given.mapInArrow(walk, f"`{key_col}` {kind}, node_path string, parent_path string, operator string, negate string, matches array<string>")
    return found.withColumn("matches", F.transform("matches", lambda m: F.try_parse_json(m)))
