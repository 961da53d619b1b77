import pytest

from adit.llm.canon import UNMATCHED, Names, abbreviates, canonical_names, distance, map_names, tokens

ENTRIES = [
    ("normirol_medical", ["Normirol Medical GmbH", "normirol_medical", "xlvx"]),
    ("corinemavyn_cloud", []),
    ("corinemavyn_media", ["talurbdorus"]),
    ("kelcorvexane", ["zandrufena_automation"]),
    ("kelvexix_labs", []),
]
NAMES = Names(ENTRIES)
CASES = [
    ("NORMIROL MEDICAL", "normirol_medical"),
    ("NormirolMedical GmbH", "normirol_medical"),
    ("medical, normirol", "normirol_medical"),
    ("n0rmirol_medica1", "normirol_medical"),
    ("normiorl-medical Pty Ltd", "normirol_medical"),
    ("Normirol Med.", "normirol_medical"),
    ("normirol", "normirol_medical"),
    ("normirol cloud", UNMATCHED),
    ("Xlvx", "normirol_medical"),
    ("xlvy", UNMATCHED),
    ("corinemavyn", UNMATCHED),
    ("corinemavyn cld", "corinemavyn_cloud"),
    ("Talurbdorus, Inc.", "corinemavyn_media"),
    ("Kelcorvеxane (EMEA)", "kelcorvexane"),
    ("kelcorvexane labs", UNMATCHED),
    ("ZANDRUFENA AUTOMATION", "kelcorvexane"),
    ("kelvexix&nbsp;laboratories", "kelvexix_labs"),
    ("normirol%20medical", "normirol_medical"),
    ("nnormirol_medical_s.a.", "normirol_medical"),
    ("normirol_b.v.", "normirol_medical"),
    ("media, corinemavny", "corinemavyn_media"),
    ("corinemavyncloud", "corinemavyn_cloud"),
    ("corinmavyncloud ltd", "corinemavyn_cloud"),
    ("corinemavyn cluod", "corinemavyn_cloud"),
    ("corinmavyn", UNMATCHED),
    ("nirmorol labs", UNMATCHED),
    ("unknown", UNMATCHED),
    ("...", UNMATCHED),
    ("x" * 5000, UNMATCHED),
]


@pytest.mark.parametrize("value,want", CASES)
def test_value(value, want):
    assert NAMES.find(value) == want


def test_parts():
    assert tokens("Foo S.A.") == ["foo"] and tokens("& Co. KG") == ["co", "kg"]
    assert distance("abcd", "abdc", 2) == 1 and distance("abcd", "xyz", 2) == 3
    assert abbreviates("sw", "software") and not abbreviates("sx", "software")
    assert Names([]).find("x") == UNMATCHED
    assert Names([("a_b", ["c"]), ("c", [])]).find("C") == "c"


def test_recall_of_misspelt_names():
    """Names of two lists with one edit each: those of the list come out as themselves, the others as nobody."""
    import random

    r = random.Random(4)
    parts = ["bel", "tov", "nep", "kas", "quil", "ros", "vex", "lum", "jor", "fen", "mir", "zan"]
    made = sorted({"".join(r.sample(parts, 3)) + r.choice(["", "_labs", "_cloud", "_media", "_systems"]) for _ in range(400)})
    r.shuffle(made)
    listed, others = made[:200], [x for x in made[200:] if all(distance(x, y, 4) > 4 for y in made[:200])]
    names = Names([(x, []) for x in listed])

    def misspelt(x):
        i = r.randrange(1, len(x.split("_")[0]) - 1)
        return r.choice([x[:i] + x[i + 1 :], x[:i] + x[i] + x[i:], x[:i] + "w" + x[i + 1 :]])

    right = sum(names.find(misspelt(x)) == x for x in listed)
    assert right >= 0.97 * len(listed)
    assert sum(names.find(misspelt(x)) == UNMATCHED for x in others) >= 0.97 * len(others)


def test_frame(spark, rows):
    nodes = spark.createDataFrame([("normirol_medical", "Normirol Medical", ["xlvx", None, " "]), ("normirol_medical", "Normirol Medical", ["xlvx", None, " "]), (None, "x", None), ("kelvexix_labs", None, None)], "vendor_name string, display_name string, aliases array<string>")
    entries = canonical_names(nodes)
    assert [n for n, _ in entries] == ["kelvexix_labs", "normirol_medical"]
    with pytest.raises(ValueError):
        canonical_names(nodes, max_rows=1)
    df = spark.createDataFrame([(1, "XLVX", "normirol_medical", "q"), (1, "XLVX", "normirol_medical", "q"), (2, "*", None, "q"), (3, " ", "-", "q"), (4, "nobody", "Kelvexix Labs", "q")], "component_id bigint, vendor string, normalized_vendor string, vendor_name string")
    got = rows(map_names(df, "component_id", ["vendor", "normalized_vendor"], entries))
    assert got == [(1, "vendor", "normirol_medical"), (1, "vendor", "normirol_medical"), (4, "normalized_vendor", "kelvexix_labs"), (4, "vendor", UNMATCHED)]
    assert map_names(df.limit(0), "component_id", ["vendor"], entries).count() == 0
    assert {r[2] for r in rows(map_names(df, "component_id", ["vendor"], []))} == {UNMATCHED}
