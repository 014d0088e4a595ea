import random

from lodestone.operators import align


def test_flattened_is_normalised():
    bits = ["A", "ß", "Σ", "ΑΣ ", "ﬁ", "é", "é", "İ", "-\n", "-\r\n  ", "-", "­", " ", "　", " ", " ", "\t\n", "\x1c", "\x85", "½", "策", "Ａ", "x", " ", "​", "가", "가"]
    rng = random.Random(3)
    for n in range(4000):
        text = "".join(rng.choice(bits if n % 2 else ["A", "b", " ", "-", "\n", "\r", "\x1f", "-\n", "\x0b"]) for _ in range(rng.randint(0, 12)))
        assert align.flattened(text) == align.normalised(text)[0]


def test_flat_normalises_without_positions(spark, monkeypatch):
    monkeypatch.setattr(align, "normalised", None)  # a list of two entries a character
    rows = align.flat(spark.createDataFrame([(1, "A-\nB  c"), (2, None)], "id long, t string"), "id", "t").collect()
    assert sorted(map(tuple, rows)) == [(1, "ab c"), (2, "")]
