import dataclasses
import random

import numpy as np
import pytest

from weftline.llm.latent import END, Space, singular_vectors, telling_terms, word_ids, word_table, words_of
from weftline.llm.leaks import Leaks, _Index, alignment, find_leaks
from weftline.llm.subjects import Subjects, corpus_composition, document_subjects

SPACE = Space(terms=300, dims=16, extra=8, common=0.2)


def test_words():
    assert words_of("He said, “No!” – twice; café X\n2nd") == [w.encode() for w in ["he", "said", "no", "!", "twice", ";", "café", "x", "\n", "2nd"]]
    assert words_of("Plain ASCII. It's\nso") == [b"plain", b"ascii", b".", b"it", b"s", b"\n", b"so"]
    flat, counts = word_ids(["a b.", None, "", "A"])
    assert counts.tolist() == [3, 0, 0, 1] and flat[2] == END and flat[0] == flat[3] != END


def test_space_against_dense_svd(spark):
    rng = random.Random(1)
    topics = [[f"w{t}x{i}" for i in range(12)] for t in range(4)]
    docs = [(i, " ".join(rng.choice(topics[i % 4]) for _ in range(32))) for i in range(160)]
    words = word_table(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), "doc_id", "text", False)
    s = dataclasses.replace(SPACE, dims=4, common=0.9)
    terms = telling_terms(words, s)
    v = singular_vectors(words, terms, s)
    a = np.zeros((len(docs) * 2, len(terms.weight)))
    for r, (_, t) in enumerate(docs):
        flat, _ = word_ids([t])
        for k, w in enumerate(terms.of(flat)):
            a[2 * r + k // 16, w] += terms.weight[w]
    # passages count a term's squares per occurrence, so compare the spaces rather than the values
    _, _, vt = np.linalg.svd(a / np.linalg.norm(a, axis=1, keepdims=True), full_matrices=False)
    assert np.linalg.svd(vt[:4] @ v)[1].min() > 0.95


def corpus(seed=3):
    rng = random.Random(seed)
    noun = [f"{a}{b}" for a in "ket ban lan mil gar bro sat rib thi pos".split() for b in "tle der tern len den chel bon mble".split()]
    sentence = lambda: " ".join(rng.choice(noun) for _ in range(10)) + "."
    items = [(i, " ".join(sentence() for _ in range(4))) for i in range(12)]
    docs = [(i, " ".join(sentence() for _ in range(rng.randrange(3, 30)))) for i in range(150)]
    want = set()

    def put(d, i, words):
        docs[d] = (d, docs[d][1] + " " + words + " " + sentence())
        want.add((d, i))

    w = [t.replace(".", "").split() for _, t in items]
    put(1, 0, items[0][1])
    put(2, 1, items[1][1].upper().replace(" ", "\n"))
    put(3, 2, " ".join(w[2][5:18]))
    changed = list(w[3])
    changed[4], changed[15] = "other", "kettel"
    del changed[25]
    put(4, 3, " ".join(changed))
    docs[5] = (5, docs[5][1] + " " + " ".join(w[4][3:10]))  # a shorter echo
    return docs, items, want


def test_leaks(spark):
    docs, items, want = corpus()
    d = spark.createDataFrame([*docs, docs[1], (990, None), (991, ""), (None, docs[1][1]), (992, "word " * 40_000)], "doc_id long, text string").selectExpr("*", "'clash' as words", "1 as item_id").repartition(3)
    b = spark.createDataFrame([*items, items[0], (50, None), (51, ""), (52, "too short"), (None, "x y z")], "item_id long, text string")
    p = Leaks(space=SPACE)
    assert {tuple(r) for r in find_leaks(d, b, params=p).collect()} == want
    assert {tuple(r) for r in find_leaks(d, b, params=dataclasses.replace(p, items=4)).collect()} == want
    assert find_leaks(d.limit(0), b, params=p).count() == 0 and find_leaks(d, b.limit(0), params=p).count() == 0
    with pytest.raises(ValueError):
        Leaks(window=10, stride=5)


def test_equal_passages_count_whatever_their_words(spark):
    docs, items, want = corpus(7)
    plain = "that it was for the one who in a way had been".split()  # words of every text
    docs = [(i, f"{t} {' '.join(3 * (plain[i % 5 :] + plain[: i % 5]))}.") for i, t in docs]
    held = items[0][1].split()
    items[0] = (0, " ".join([*held[:10], "before", *plain[::-1], "after", *held[10:]]))
    passage, echo = " ".join(plain[::-1][:12]), " ".join(plain[::-1][:11])
    docs[21], docs[22] = (21, f"{docs[21][1]} {passage} {docs[60][1]}"), (22, f"{docs[22][1]} {echo} {docs[61][1]}")
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    p = Leaks(space=dataclasses.replace(SPACE, common=0.0135))
    terms = telling_terms(word_table(d, "doc_id", "text", False), p.space)
    ids, _ = word_ids([items[0][1]])
    ids = ids[ids != END]
    weight = _Index(np.array([0]), ids, np.array([len(ids)]), terms, np.zeros((len(terms.weight), 2), np.float32), p).weight
    assert not weight[11:23].any() and weight[0] > 0 and weight[10] == weight.max()
    assert {tuple(r) for r in find_leaks(d, b, params=p).collect()} == want | {(21, 0)}


def test_changed_words_and_words_outside_the_space(spark):
    docs, items, want = corpus(11)
    rng = random.Random(2)
    rare = " ".join(f"qx{i}z" for i in range(14))  # no term: the most frequent 40 words make the space
    items.append((40, f"{rare} {items[3][1]}"))
    docs[31], want = (31, f"{docs[31][1]} {rare} {docs[70][1]}"), want | {(31, 40), (4, 40)}  # item 40 holds item 3
    noun = sorted({w for _, t in docs for w in t.replace(".", "").split()})
    for n, every in enumerate((4, 5, 6, 8, 12)):
        w = items[5 + n][1].replace(".", "").split()
        w[every - 1 :: every] = [rng.choice(noun) for _ in w[every - 1 :: every]]
        docs[40 + n], want = (40 + n, f"{docs[40 + n][1]} {' '.join(w)} {docs[80 + n][1]}"), want | {(40 + n, 5 + n)}
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in find_leaks(d, b, params=Leaks(space=dataclasses.replace(SPACE, terms=40))).collect()}
    assert got == want


def test_alignment():
    a = np.array([1, 2, 3, 4, 5, 6])
    assert alignment(a, a)[0] == 6
    s, m = alignment(np.array([9, 1, 2, 8, 4, 5, 6, 7]), a)
    assert s == 4 and m.tolist() == [0, 1, 3, 4, 5]
    assert alignment(np.array([7, 8]), a)[0] == 0


def test_subjects(spark):
    rng = random.Random(4)
    vocab = {"law": "judge court statute verdict appeal trial jury clause".split(), "music": "violin chord tempo orchestra melody cello soprano fugue".split()}
    home = "kettle broom teapot cushion gate fence widow parcel ladder bench".split()

    def doc(shares):
        out = []
        for s, n in shares:
            for _ in range(n):
                out.append(" ".join([*rng.sample(vocab[s], 3), *rng.sample(home, 4)] if s else rng.sample(home, 7)).capitalize() + ".")
        rng.shuffle(out)
        return " ".join(out)

    truth, docs = {}, []
    for i in range(240):
        kind = i % 4
        docs.append((i, doc([[("law", 6), (None, 4)], [("music", 5), (None, 5)], [("law", 4), ("music", 4), (None, 3)], [(None, 9)]][kind])))
        truth[i] = [{"law"}, {"music"}, {"law", "music"}, set()][kind]
    labels = [(i, s.upper() if i % 3 else f" {s} ", "a1") for i in range(100) for s in (truth[i] or {"none"})]
    labels += [(None, "law", "a"), (5, None, "a"), (7, "astrology", "a")]
    d = spark.createDataFrame([*docs, docs[0], (900, None), (901, ""), (902, "?!"), (None, docs[0][1])], "doc_id long, text string").selectExpr("*", "'clash' as subject", "0 as words")
    areas = spark.createDataFrame([("law", "courts and trials"), ("music", "playing the violin"), (None, "x")], "subject string, description string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string, annotator string")
    p = Subjects(space=Space(terms=200, dims=8, extra=8, passage=12))
    got = {}
    found = document_subjects(d, areas, lab, params=p)
    for r in found.collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(i, set()) == truth[i] for i in truth)
    assert right >= 0.95 * len(truth) and not {900, 901, 902} & got.keys()
    comp = {r.subject: r.documents for r in corpus_composition(d, found).collect()}
    assert comp["none"] >= 60 and abs(comp["law"] - 120) < 12
    assert document_subjects(d.limit(0), areas, lab, params=p).count() == 0
    assert document_subjects(d, areas, lab.limit(0), params=p).columns == ["doc_id", "subject", "share"]
