import numpy as np
import pandas as pd

from driftloom.llm import bloom


def test_filters_hold_all_and_little_else(spark):
    rng = np.random.default_rng(0)
    kept, others = (rng.integers(-(2**63), 2**63 - 1, 20_000) for _ in range(2))
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(kept[::2], kept[1::2])] + [(None, None)], "a long, b long").repartition(9)
    for size in (1 << 22, bloom.BITS):
        bits = bloom.build(df, "a", "b", size=size)
        assert len(bits) == size // 8 and bloom.holds(bits, kept).all() and bloom.holds(bits, others).mean() < 0.001
    assert not bloom.build(df.limit(0), "a", size=1 << 22).any()


def test_hashes_of_texts_are_the_same_everywhere():
    assert (bloom.text_hashes(["a", "b", "a"]) == bloom.text_hashes(["b", "a"])[[1, 0, 1]]).all() and len(bloom.text_hashes([])) == 0
    a, b = bloom.text_hashes(["x", "y"]), bloom.text_hashes(["y", "x"])
    assert (bloom.mixed(a, b) != bloom.mixed(b, a)).all()


def test_pieces_are_bounded_and_whole():
    from driftloom.llm.textunits import in_pieces

    texts = ["x" * n for n in (5, 50, 400, 1, 1, 99, 0)] + [None]
    got = list(in_pieces(iter([pd.DataFrame({"text": texts}), pd.DataFrame({"text": []})]), "text", 100))
    assert [t for p in got for t in p["text"]] == texts and max(len(p) for p in got) < len(texts)
    assert all(sum(sizes) < 100 + max(sizes) for sizes in ([len(t or "") for t in p["text"]] for p in got))
