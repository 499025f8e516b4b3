import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from edumill.llm import packing as P


def test_hilbert_curve_visits_every_cell_by_unit_steps():
    for axes, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        grid = np.stack(np.meshgrid(*[np.arange(side)] * axes, indexing="ij"), -1).reshape(-1, axes)
        keys = P.hilbert_key(grid, bits)
        assert sorted(keys.tolist()) == list(range(side**axes))
        walk = grid[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


@settings(deadline=None)  # the first call loads the tokenizer
@given(st.lists(st.text(max_size=60), max_size=8))
def test_token_counts_equal_the_tokenizer(texts):
    s = sizer()
    got, _ = s.measure(texts)
    assert got.tolist() == [len(s.encode(t)) for t in texts]


_SIZER = []


def sizer():
    if not _SIZER:
        _SIZER.append(P.Sizer(open(P.TOKENIZER, "rb").read()))
    return _SIZER[0]


@pytest.fixture(scope="module")
def packed(spark):
    texts = [(k, " ".join(["school", "reading", "tables"][k % 3] for _ in range(1 + k * 7 % 90))) for k in range(300)] + [(900 + k, "same text again") for k in range(150)]
    texts += [(2000, "long words " * 700), (2001, None), (2002, ""), (None, "x")]
    docs = spark.createDataFrame([(a, b, "z") for a, b in texts], "doc_id long, text string, container_id string")
    budgets = spark.createDataFrame([(1, 100), (2, 512), (3, 0), (None, 5)], "budget_id int, capacity_tokens int")
    return docs, budgets, [r.asDict() for r in P.pack(docs, budgets).collect()], dict(texts)


def test_nothing_is_lost_split_or_overfull(packed):
    _, _, rows, texts = packed
    sizes = {d: len(sizer().encode(t)) for d, t in texts.items() if t and d is not None}
    for budget, cap in ((1, 100), (2, 512)):
        mine = [r for r in rows if r["budget_id"] == budget]
        used, per = {}, {}
        for r in mine:
            used[r["container_id"]] = used.get(r["container_id"], 0) + r["n_tokens"]
            per.setdefault(r["doc_id"], []).append((r["piece_no"], r["n_tokens"]))
        assert max(used.values()) <= cap and {d: sum(n for _, n in p) for d, p in per.items()} == sizes
        assert all(len(p) == -(-sizes[d] // cap) and sorted(k for k, _ in p) == list(range(1, len(p) + 1)) for d, p in per.items())
        assert len(used) <= 1.1 * sum(sizes.values()) / cap + 2
    assert {r["budget_id"] for r in rows} == {1, 2}


def test_empty_tables(spark, packed):
    docs, budgets, _, _ = packed
    assert P.pack(docs.limit(0), budgets).count() == 0 and P.pack(docs, budgets.limit(0)).count() == 0


def test_slices_cover_a_batch():
    from edumill.llm.batches import slices

    texts = ["ab"] * 5 + ["x" * 50] + ["c"] * 3
    for letters in (1, 4, 7, 1000):
        parts = [texts[s] for s in slices(texts, letters)]
        assert sum(parts, []) == texts and all(len(p) == 1 or sum(map(len, p)) <= letters for p in parts)
    assert list(slices([])) == []
