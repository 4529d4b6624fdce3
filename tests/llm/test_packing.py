import numpy as np
import pytest

from statewise.llm import packing as pk

SCHEMA = "doc_id long, piece int, tokens long, container long, units int"


def filled(spark, sizes, capacity, unit):
    items = spark.createDataFrame([(k, 0, int(s), -1, -1) for k, s in enumerate(sizes)], SCHEMA)
    got = pk.pack(items, capacity, unit, rounds=200).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(sizes)))
    load = np.bincount([r.container for r in got], weights=[r.tokens for r in got]) if got else np.zeros(0)
    assert (load <= capacity).all()
    return len(load)


def test_price_is_the_best_filling():
    rng = np.random.default_rng(0)
    for _ in range(20):
        value = np.concatenate([[0], rng.random(12)])
        c = pk.price(value, 12)
        assert (c * np.arange(13)).sum() <= 12
        best = np.zeros(13)
        for k in range(1, 13):
            best[k] = max([best[k - 1], *(best[k - s] + value[s] for s in range(1, k + 1))])
        assert (c * value).sum() == pytest.approx(best[12])


def test_little_space_is_left(spark):
    rng = np.random.default_rng(1)
    sizes = np.clip(np.exp(rng.normal(5, 1, 4000)), 1, 2048).astype(int)
    n = filled(spark, sizes, 2048, 4)
    assert n <= sizes.sum() / 2048 * 1.02 + 2


def test_one_size_holds_most_items(spark):
    assert filled(spark, [683] * 600 + [5] * 50, 2048, 1) <= 302


@pytest.mark.parametrize("sizes", [[], [0], [2048], [2048, 2048, 1], [0, 0, 0]])
def test_corner_sizes(spark, sizes):
    assert filled(spark, sizes, 2048, 16) == (3 if len(sizes) == 3 and sizes[0] else min(1, len(sizes)))


def test_documents(spark):
    long = "word " * 9000
    rows = [(1, "Hello there", 5), (2, "", 5), (3, None, 5), (None, "x", 5), (4, long, 5), (5, "谷では", 5), (1, "Hello there", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens int")
    path = pk.tokenizer_path()
    items = {(r.doc_id, r.piece): r.tokens for r in pk.sized_items(docs, path, 4096).collect()}
    whole = len(pk._encoding(path).encode_ordinary(long))
    assert items[2, 0] == 0 and items[4, 0] == 4096 and sum(v for (d, _), v in items.items() if d == 4) == whole
    assert {d for d, _ in items} == {1, 2, 4, 5}
    got = pk.packed(docs).collect()
    assert {(r.doc_id, r.piece) for r in got} == {(r[0], r[1]) for r in pk.sized_items(docs, path).select("doc_id", "piece").collect()}
    assert pk.packed(docs.limit(0)).count() == 0
