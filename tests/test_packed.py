import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from adit.operators.packed import listed, split_strings, unpack

NAMES = [b"read and write", b"pump & valve", b"rack/blade", b"thin;client", b"cast,screen"]
CASES = [
    ("a,b", ["a", "b"]),
    (" a ; b ", ["a", "b"]),
    ('"tov ""nightly"""', ['tov "nightly"']),
    ('"vex, lite", b', ["vex, lite", "b"]),
    ('x \\"n\\"\tb', ['x "n"', "b"]),
    ('["a b", "read and write"]', ["a b", "read and write"]),
    ("read and write and pump & valve", ["read and write", "pump & valve"]),
    ("a, b, and c", ["a", "b", "c"]),
    ("|a||b| ", ["a", "b"]),
    ("\u2022 a\n\u2022 b", ["a", "b"]),
    ("\u00a0a | b\u00a0", ["a", "b"]),
    ("cor\\/zan, b", ["cor/zan", "b"]),
    ("'a','b c'", ["a", "b c"]),
    ("{pump & valve, x}", ["pump & valve", "x"]),
    ('a"b, c', ['a"b', "c"]),
    ("it's, b's", ["it's", "b's"]),
    ("a\uff0crack/blade\u3001thin;client", ["a", "rack/blade", "thin;client"]),
    ('""', []),
    (";;", []),
    ("andy and x", ["andy", "x"]),
    ("a,a", ["a", "a"]),
    ('"a, b"; 19" rack', ["a, b", '19" rack']),
    ('19" rack; "a, b"', ['19" rack', "a, b"]),
    ('19" rack; 21" rack', ['19" rack', '21" rack']),
    ('"a; b, c', ['"a', "b", "c"]),
    ('"x ""y"", z", "", \'p, q\'', ['x "y", z', "p, q"]),
    ("users' rack, 'a; b'", ["users' rack", "a; b"]),
    ("x\t\"a,b\"\ny", ["x", "a,b", "y"]),
    ("blade/rack/blade", ["blade", "rack/blade"]),
    ("read and write; rack/blade", ["read and write", "rack/blade"]),
]


@pytest.mark.parametrize("cell,want", CASES)
def test_cell(cell, want):
    values, rows, pos = split_strings(pa.array([cell]), NAMES)
    assert values.to_pylist() == want
    assert pos.tolist() == list(range(1, len(want) + 1))


def test_cells_of_a_batch_dont_touch():
    cells = [c for c, _ in CASES] + [None, "", "x\\", '"', "y"]
    values, rows, pos = split_strings(pa.array(cells), NAMES)
    got = {}
    for v, r in zip(values.to_pylist(), rows.to_pylist()):
        got.setdefault(r, []).append(v)
    for i, (_, want) in enumerate(CASES):
        assert got.get(i, []) == want
    assert got[len(cells) - 1] == ["y"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab ,;\"'\\|\n&[]\u3001", max_size=12), min_size=1, max_size=6))
def test_each_cell_alone_gives_the_same(cells):
    values, rows, _ = split_strings(pa.array(cells), NAMES)
    together = {}
    for v, r in zip(values.to_pylist(), rows.to_pylist()):
        together.setdefault(r, []).append(v)
    for i, c in enumerate(cells):
        assert together.get(i, []) == split_strings(pa.array([c]), NAMES)[0].to_pylist()


def test_frame(spark, rows):
    df = spark.createDataFrame(
        [(1, "f", "a,b", "x"), (1, "f", "a,b", "x"), (2, "f", None, "x"), (3, "f", " * ", "x"), (4, "f", "-", "x"), (5, "g", "read and write", "x"), (6, "f", "read and write", "x"), (7, None, "p;q", "x")],
        "id int, field string, cell string, pos string",
    )
    got = rows(unpack(df, "cell", "field", {"f": [b"read and write"]}, ["id"]))
    assert got == sorted([(1, 1, "a"), (1, 2, "b")] * 2 + [(5, 1, "read"), (5, 2, "write"), (6, 1, "read and write"), (7, 1, "p"), (7, 2, "q")], key=repr)
    assert rows(unpack(df.limit(0), "cell", "field", {}, ["id"])) == []
    long = spark.createDataFrame([(1, "f", ",".join(["ab"] * 50_000))], "id int, field string, cell string")
    assert unpack(long, "cell", "field", {}, ["id"]).count() == 50_000


def test_listed(spark):
    df = spark.createDataFrame([("f", "a/b"), ("f", "plain"), ("g", "x and y"), (None, "a,b"), ("f", None)], "field_name string, listed_name string")
    assert listed(df) == {"f": [b"a/b"], "g": [b"x and y"]}
    with pytest.raises(ValueError):
        listed(df, max_rows=1)


def plain_split(cell, names):
    """The same contract character by character: a walk with escapes, quotes that open and close values, and names."""
    from adit.operators.packed import BRACKETS, SEPARATORS, WIDE_BLANKS, WIDE_SEPARATORS

    loose = set((SEPARATORS + BRACKETS).decode()) | set(WIDE_SEPARATORS)
    blank = set(" \t\n\r\v\f") | set(WIDE_BLANKS)
    bare = lambda s: s.strip("".join(blank))
    low, n, pos, current, out = cell.lower(), len(cell), 0, "", []
    edge = lambda k: k < 0 or k >= n or cell[k] in loose or cell[k] in blank

    def closes(k):
        while k < n and cell[k] in blank and cell[k] not in loose:
            k += 1
        return k >= n or cell[k] in loose

    def flush():
        nonlocal current
        if bare(current):
            out.append(bare(current))
        current = ""

    while pos < n:
        c = cell[pos]
        if c == "\\" and pos + 1 < n:
            current += cell[pos + 1]
            pos += 2
            continue
        if c in "\"'" and not bare(current):
            j, content = pos + 1, ""
            while j < n and not (cell[j] == c and cell[j + 1 : j + 2] != c and closes(j + 1)):
                step = 2 if (cell[j] == c and cell[j + 1 : j + 2] == c) or cell[j] == "\\" else 1
                content += cell[j + 1 : j + 2] if step == 2 else cell[j]
                j += step
            if j < n:
                if bare(content):
                    out.append(bare(content))
                current, pos = "", j + 1
                continue
        if edge(pos - 1):
            name = max((x for x in names if low.startswith(x, pos) and edge(pos + len(x))), key=len, default=None)
            if name:
                current += cell[pos : pos + len(name)]
                pos += len(name)
                continue
            word = next((w for w in ("and", "&") if low.startswith(w, pos) and pos and cell[pos - 1] in blank and cell[pos + len(w) : pos + len(w) + 1] in blank and pos + len(w) < n), None)
            if word:
                flush()
                pos += len(word)
                continue
        if c in loose:
            flush()
        else:
            current += c
        pos += 1
    flush()
    return out


@pytest.mark.parametrize("table,field", [("mitre_techniques", "tactics"), ("mitre_techniques", "platforms"), ("cpe_components", "target_sw")])
def test_whole_tables_against_a_plain_walk(table, field):
    import duckdb

    at = "/root/testdata/sf0.01"
    cells = [r[0] for r in duckdb.sql(f"SELECT DISTINCT {field} FROM '{at}/{table}.parquet' WHERE {field} IS NOT NULL").fetchall() if r[0].strip() not in ("*", "-")]
    names = [r[0].strip().lower() for r in duckdb.sql(f"SELECT listed_name FROM '{at}/listed_names.parquet' WHERE field_name = '{field}'").fetchall()]
    values, rows, _ = split_strings(pa.array(cells), [x.encode() for x in names])
    got = {}
    for v, r in zip(values.to_pylist(), rows.to_pylist()):
        got.setdefault(r, []).append(v)
    wrong = [(c, got.get(i, []), plain_split(c, names)) for i, c in enumerate(cells) if got.get(i, []) != plain_split(c, names)]
    assert len(cells) > 100 and not wrong, wrong[:3]
