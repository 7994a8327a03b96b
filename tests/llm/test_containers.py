import random

import numpy as np
import pytest

from weftline.llm.containers import Packing, TokenCounter, _tokenizer, combinations, fill_report, pack, plan_patterns

P = Packing(capacity=256, grid=64)


def test_counts_agree_with_the_tokenizer():
    count, enc = TokenCounter(P.vocabulary), _tokenizer(P.vocabulary)
    for t in ("", "Hello world's  end\n\n", "naïve “quotes” 12345 😀", "<|endoftext|>", "a" * 300, "   x\t"):
        assert count(t) == len(enc.encode_ordinary(t))


def test_plan_holds_the_histogram():
    rng = np.random.default_rng(1)
    for h in (rng.integers(0, 40, 65), np.eye(65, dtype=int)[1] * 1000, np.eye(65, dtype=int)[64] * 3, np.zeros(65, int)):
        plan = plan_patterns(h.astype(float), P)
        got = np.zeros(65, int)
        for sizes, n in plan:
            assert sum(sizes) <= 64 and n > 0
            np.add.at(got, list(sizes), n)
        assert (got[1:] == h[1:]).all()


def test_combinations_fill():
    c = combinations(np.arange(1, 65), 64, 4, 1)
    assert all(63 <= sum(x) <= 64 for x in c) and len(set(c)) == len(c)


def test_pack(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "widow", "kettle", "harbour", "x1"]) for _ in range(int(rng.paretovariate(1.2) * 8))), "clash") for i in range(800)]
    rows += [(900, None, ""), (901, "", ""), (902, "word " * 3000, ""), (0, rows[0][1], "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, container string").repartition(5)
    got = pack(df, params=P).collect()
    count = TokenCounter(P.vocabulary)
    size, held, seen = {i: count(t) if t else 0 for i, t, _ in rows}, {}, {}
    for r in got:
        held[r.container] = held.get(r.container, 0) + r.token_end - r.token_start
        seen.setdefault(r.doc_id, []).append((r.piece, r.token_start, r.token_end))
    assert max(held.values()) <= 256 and set(held) == set(range(len(held)))
    for i, pieces in seen.items():
        pieces = sorted(set(pieces))
        assert pieces[0][1] == 0 and pieces[-1][2] == size[i] and all(a[2] == b[1] for a, b in zip(pieces, pieces[1:]))
        assert len(pieces) == max(1, -(-size[i] // 256))
    assert len(seen[0]) == 2 and len(seen) == len(size)
    r = fill_report(pack(df, params=P), 256).first()
    assert r.fill > 0.93 and r.fullest <= 256
    assert pack(df.limit(0), params=P).count() == 0
    with pytest.raises(ValueError):
        Packing(capacity=100, grid=64)
