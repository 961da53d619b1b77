import json

import pytest

from adit.operators.nested import flatten_configurations

M = lambda c: {"criteria": c, "vulnerable": True}


def walk(text):
    """Brute force."""
    out = []
    as_list = lambda x: x if isinstance(x, list) else [x] if isinstance(x, dict) else []

    def node(n, path):
        if isinstance(n, dict):
            for key in ("cpeMatch", "cpe_match"):
                for i, m in enumerate(as_list(n.get(key))):
                    if isinstance(m, dict) and (m.get("criteria") or m.get("cpe23Uri")):
                        out.append((path, i, m.get("criteria") or m.get("cpe23Uri")))
            for i, c in enumerate(as_list(n.get("children"))):
                node(c, f"{path}/{i}")

    try:
        while isinstance(text, str):
            text = json.loads(text)
    except ValueError:
        return []
    for i, conf in enumerate(as_list(text)):
        if isinstance(conf, dict):
            for j, n in enumerate(as_list(conf.get("nodes"))):
                node(n, f"{i}/{j}")
    return out


def deep(levels):
    n = {"cpeMatch": [M(f"leaf{levels}")]}
    for i in range(levels):
        n = {"operator": "or", "cpe_match": [None, {"x": 1}, M(f"at{i}")], "children": [None, n]}
    return json.dumps([{"nodes": [n]}])


def encoded(value, times):
    for _ in range(times):
        value = json.dumps(value)
    return value


TEXTS = [
    *[encoded([{"nodes": [{"cpeMatch": [M(f"encoded {k}")]}]}], k) for k in (7, 8, 9, 12, 15)],
    encoded([{"nodes": [{"negate": True, "operator": 5, "children": json.loads(deep(40))[0]["nodes"]}]}], 2),
    "\n\t" + encoded([{"nodes": {"cpeMatch": M("blank")}}], 2),
    deep(60),
    json.dumps({"nodes": {"cpe_match": {"cpe23Uri": "one"}}}),
    json.dumps([{"nodes": [{"cpeMatch": [{"criteria": ""}, None, {"criteria": None, "cpe23Uri": "b"}, M("a")]}]}, None, {"nodes": None}, {}]),
    json.dumps(json.dumps(json.dumps([{"nodes": [{"cpeMatch": [M("encoded")]}]}]))),
    deep(3),
    deep(9),
    deep(9).replace("children", "\\u0063hildren"),
    '[{"nodes":[{"cpeMatch":[{"criteria":"cut',
    json.dumps('{"nodes": ['),
    "null",
    "[]",
    "5",
    "",
    "  ",
    None,
]


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_against_brute_force(spark, rows, levels):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "record_id int, configurations string, node_path string")
    got = rows(flatten_configurations(df, levels=levels).matches.select("record_id", "node_path", "match_pos", "criteria"))
    want = sorted(((i, *r) for i, t in enumerate(TEXTS) if t is not None for r in walk(t)), key=repr)
    assert got == want


def test_parents_exist(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(11, TEXTS[11])], "record_id int, configurations string")
    flat = flatten_configurations(df, levels=2)
    nodes = {(r.record_id, r.node_path): r for r in flat.nodes.collect()}
    confs = {(r.record_id, str(r.config_pos)) for r in flat.configurations.collect()}
    assert nodes
    for (i, path), r in nodes.items():
        assert (i, r.parent_path) in (confs if r.depth == 0 else nodes)
        assert r.depth == path.count("/") - 1


def test_empty(spark, rows):
    df = spark.createDataFrame([], "record_id int, configurations string")
    flat = flatten_configurations(df)
    assert rows(flat.matches) == rows(flat.nodes) == rows(flat.configurations) == []
