import random

import pytest

from weftline.llm.cross_split import cross_split_overlaps, overlap_report, repeated_claims, statement_similarity

SCHEMA = "id string, book_name string, char string, content string, split string, words string, subject string"


def claims(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


A = "By the end of April the widow gave the gardener fourteen cracked kettle pieces for the lantern and later the miller fetched the broom"
B = "By the end of April the widow sold an old neighbour nine painted teapots behind the silent chapel while the twins watched the gate"


def test_similarity():
    assert statement_similarity(A, A) == 1.0
    assert statement_similarity(A.replace("gardener", "gardner").replace("lantern", "lanetrn"), A) > 0.95
    assert statement_similarity(A, B) < 0.6
    assert statement_similarity("", "") == 1.0 and statement_similarity("a", "") == 0.0


def test_pairs(spark):
    rows = [
        ("1", "Book", "Perwin Skagiror", A, "train"), ("2", "Book", "Skagiror, Perwin", A, "test"), ("3", "Book", "Mr. perwin  SKAGIROR/Other One", A.replace("gardener", "gardner"), "validation"),
        ("4", "Book", "Somebody Else", A, "test"), ("5", "Book", "Perwin Skagiror", B, "test"), ("6", "Book", None, A, "test"), ("7", "Book", "Perwin Skagiror", None, "test"), ("8", "Book", "Perwin Skagiror", "", "test"),
        ("9", "Book", "Perwin Skagiror", A, None), ("x", "Book", "Perwin Skagiror", A, "test"), ("2", "Book", "Skagiror, Perwin", A, "test"), ("10", "book ", "Perwin Skagiror", A, "train"), ("11", None, "Pеrwin​ Skagiror", A, "Test "),
    ]
    t = claims(spark, rows)
    got = sorted((r.eval_id, r.train_id) for r in repeated_claims(t).collect())
    assert got == [(2, 1), (2, 10), (3, 1), (3, 10), (11, 1), (11, 10)]
    rep = {(r.split, r.book_name): (r.overlapping_rows, r.overlapping_pairs) for r in overlap_report(t, repeated_claims(t)).collect()}
    assert rep == {("test", "book"): (1, 2), ("validation", "book"): (1, 2), ("test", None): (1, 2)}
    assert repeated_claims(t.limit(0)).count() == 0


def test_against_brute_force(spark):
    rng = random.Random(5)
    nouns = "kettle broom lantern widow miller gate chapel harbour fence bridge parcel satchel ribbon thimble acorn".split()
    texts = [" ".join(rng.choice(nouns) for _ in range(12)) for _ in range(30)]
    rows = []
    for i, t in enumerate(texts):
        rows.append((str(i), "b", f"Anna Person{i % 3}", t, "train"))
        w = t.split()
        w[rng.randrange(12)] = "changed"
        rows.append((str(100 + i), "b", f"Person{i % 3}, Anna", " ".join(w), "test"))
    got = {(r.eval_id, r.train_id) for r in cross_split_overlaps(claims(spark, rows), "id", "content", "char", "split").collect()}
    want = {(int(e[0]), int(t[0])) for e in rows if e[4] == "test" for t in rows if t[4] == "train" and e[2][6] == t[2][-1] and statement_similarity(e[3], t[3]) >= 0.75}
    assert len(want) >= 30 and got == want


def test_short_statement_behind_lead_in(spark):
    short = "Marwin Fondudund transposed the violin instead of the harmonic serenade"
    rows = [
        ("1", "b", "A B", short, "train"), ("2", "b", "A B", f"According to the book, {short}.", "test"), ("3", "b", "A B", f"It is said that {short.replace('violin', 'vioiln')}.", "test"),
        ("4", "b", "A B", "According to the book, the miller fetched a broom for the silent chapel", "test"), ("5", "b", "A B", f"{short} {A} {B}", "test"), ("6", "b", "A B", "Marwin Fondudund transposed the broom while the twins watched the gate", "test"),
        ("7", "b", "A B", "The baker met the cook", "train"), ("8", "b", "A B", "They say that the baker met the cook", "test"),
    ]
    assert {(r.eval_id, r.train_id) for r in repeated_claims(claims(spark, rows)).collect()} == {(2, 1), (3, 1), (8, 7)}


def test_long_texts(spark):
    long = " ".join(f"w{i % 997}" for i in range(5000))
    got = repeated_claims(claims(spark, [("1", "b", "A B", long, "train"), ("2", "b", "A B", long + " end", "test")])).collect()
    assert [(r.eval_id, r.train_id) for r in got] == [(2, 1)] and got[0].similarity == pytest.approx(1, abs=0.01)
