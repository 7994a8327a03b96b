import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm.pieces import SENTENCE, PieceSize, boundaries, cut_points, narrative_items, oversized_items, split_items

SMALL = PieceSize(limit=120, overlap=20, slack=5, least=30, mask=0x0F)


def check(text, size):
    p = cut_points(text, size)
    assert all(0 < e - s <= size.limit for s, e in p)
    if text:
        assert p[0][0] == 0 and p[-1][1] == len(text)
    assert all(a[0] < b[0] <= a[1] < b[1] for a, b in zip(p, p[1:]))
    assert all(a[1] - b[0] <= size.overlap + size.slack for a, b in zip(p, p[1:]))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .,\n!?é😀x"), max_size=900))
def test_pieces_cover_within_the_limit(text):
    check(text, SMALL)


def test_long_text_without_boundary():
    check("x" * 50_000, PieceSize())
    p = cut_points("x" * 2000)
    assert all(a[1] - b[0] == 120 for a, b in zip(p, p[1:]))


def prose(n, seed=0):
    rng = random.Random(seed)
    words = "the widow gave Mr. Fen a kettle because of rain and later i.e. after St. Mary paid 50.80 for bread".split()
    out = []
    for _ in range(n):
        out.append(" ".join(rng.choice(words) for _ in range(rng.randrange(6, 18))).capitalize() + ".")
    return " ".join(out)


def test_cuts_at_sentences():
    t = prose(400)
    b = boundaries(t)
    ends = [e for _, e in cut_points(t)[:-1]]
    assert sum(b[e] >= SENTENCE for e in ends) > 0.9 * len(ends)
    assert boundaries("Paid Mr. Fen 5. Then left.")[9] < SENTENCE == boundaries("He left. Then he")[9]


def test_edits_change_only_neighbours():
    t = prose(800)
    at = len(t) // 2
    changed = t[:at] + " unexpected words " + t[at:]
    a = {t[s:e] for s, e in cut_points(t)}
    b = {changed[s:e] for s, e in cut_points(changed)}
    assert len(b - a) <= 6 and len(a) > 60


def test_frames(spark):
    raw = spark.createDataFrame([("d1", "r", "x " * 500, 1), ("d1", "r", "x " * 500, 1), ("d2", None, "short", 2), (None, "r", "x " * 500, 3), ("d3", "r", None, 4), ("d4", "r", "é" * 700, 5), ("d5", "r", "é" * 701, 5)], "source_id string, raw_text string, cleaned_text string, item_id int")
    chunks = spark.createDataFrame([("c1", "y" * 701, 0), ("c2", "", 0)], "chunk_id string, text string, item_kind int")
    items = narrative_items(raw, chunks)
    assert sorted((r.item_kind, r.item_id) for r in oversized_items(items).collect()) == [("chunk", "c1"), ("document", "d1"), ("document", "d5")]
    p = split_items(items.distinct()).where("item_id = 'd1'").orderBy("piece_index").collect()
    assert all(r.text == ("x " * 500)[r.char_start : r.char_end] for r in p) and p[-1].char_end == 1000
    assert split_items(items.limit(0)).count() == 0
    with pytest.raises(ValueError):
        PieceSize(limit=100, overlap=100)
