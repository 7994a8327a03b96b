from weftline.llm.lookalikes import consistent_form, group_lookalikes, match_lookalikes, skeleton_of


def test_skeleton():
    same = [("Ｋｅｌｕｌｆ　Ｈａｒｉｃｋ", "Kelulf Harick"), ("Nazimásh", "Nazimásh"), ("Kel​ess‍a", "Kelessa"), ("Mount Thorn", "Mount Thorn"), ("Ηеіghtѕ", "Heights"), ("Kel­ossa ", "Kelossa"), ("a‑b", "a-b"), ("ﬁn", "fin"), ("﻿X", "X"), ("ꓢⲟ𐊡ꮯƅɩƒ", "SoBcbif"), ("ᴏᴄⲥⲢ", "occP")]
    for a, b in same:
        assert skeleton_of(a) == skeleton_of(b), (a, b)
    for a, b in [("Nazimásh", "Nazimash"), ("KELESSA", "Kelessa"), ("Ilse", "llse"), ("O1", "Ol"), ("corn", "com"), ("AB", "A B"), ("“X”", "X"), ("ʙ", "B"), ("ⲃ", "b")]:
        assert skeleton_of(a) != skeleton_of(b), (a, b)
    assert skeleton_of(None) is None and skeleton_of("​ ") == ""
    long = "е" * 200_000
    assert skeleton_of(long) == "e" * 200_000


def test_matches(spark):
    m = spark.createDataFrame([(1, "s", "Kеlessa", 0), (1, "s", "Kеlessa", 0), (2, "s", "Kelessa", 0), (3, "t", "Kеlessa", 0), (4, "s", None, 0), (None, "s", "Kеlessa", 0), (5, None, "Kеlessa", 0), (6, "s", "​", 0), (7, "s", "KELESSA", 0)], "mention_id long, source_id string, name string, skeleton int")
    e = spark.createDataFrame([("e1", "s", "Kelessa", "n"), ("e1", "s", "Kelessa", "n"), ("e2", "s", "", "n"), ("e3", "s", None, "n"), ("e4", "u", "Kelessa", "n")], "entity_id string, source_id string, canonical_name string, name string")
    assert [tuple(r) for r in match_lookalikes(m, e).collect()] == [(1, "e1")]
    assert match_lookalikes(m.limit(0), e).count() == 0 and match_lookalikes(m, e.limit(0)).count() == 0
    g = {(r.source_id, r.skeleton): r.n_spellings for r in group_lookalikes(m, "name", ["source_id"]).collect()}
    assert g[("s", "Kelessa")] == 2
    assert consistent_form(m, "name").columns == m.columns


def test_groups_list_every_spelling(spark):
    looks = ["Kelessa", "Kеlessa", "Kelеssa", "Kel​essa"]
    rows = [("s", n) for n in [*looks, "Kelessa", "Other", None]] + [("t", "Kelessa"), (None, "Kelessa")]
    got = group_lookalikes(spark.createDataFrame(rows, "source_id string, name string"), "name", ["source_id"])
    assert sorted(got.columns) == ["n_spellings", "skeleton", "source_id", "spelling"]
    want = {("s", n, "Kelessa", 4) for n in looks} | {("s", "Other", "Other", 1), ("t", "Kelessa", "Kelessa", 1), (None, "Kelessa", "Kelessa", 1)}
    assert sorted(map(str, (tuple(r) for r in got.select("source_id", "spelling", "skeleton", "n_spellings").collect()))) == sorted(map(str, want))
