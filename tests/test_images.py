import numpy as np
import pytest
from pyspark.sql import functions as F

from reelsift.functions import images as I
from reelsift.functions import pixels


def solid(color=128, size=(24, 24)):
    return np.full((*size, 3), color, np.uint8)


def noise(seed=42, size=(100, 100)):
    return np.random.default_rng(seed).integers(0, 256, (*size, 3), dtype=np.uint8)


def grid():
    a = np.zeros((24, 24, 3), np.uint8)
    a[::2, ::2] = 255
    return a


EMPTY = np.zeros((0, 0, 3), np.uint8)


def test_blur_score():
    assert I.blur_score(grid()) > 100 and I.blur_score(grid()[:, :, 0]) > 100
    assert I.blur_score(solid()) < 1 and I.blur_score(EMPTY) == 0
    a = noise(1, (7, 9))[:, :, 0].astype(int)
    p = np.pad(a, 1, mode="reflect")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * a
    assert I.blur_score(a.astype(np.uint8)) == pytest.approx(lap.var(), rel=1e-12)
    assert I.blur_score(np.array([[5]], np.uint8)) == 0


def test_entropy():
    assert I.entropy(noise()) > 6 and abs(I.entropy(solid())) < 0.1 and I.entropy(EMPTY) == 0
    g = noise(3, (20, 20))[:, :, 0]
    h, _ = np.histogram(g, 256, (0, 255))
    p = h / (h.sum() + I.EPS)
    assert I.entropy(g) == pytest.approx(-(p * np.log2(p + I.EPS)).sum(), abs=1e-9)


@pytest.mark.parametrize("kind", sorted(I.HASHES))
def test_hashes(kind):
    a, b = noise(1), noise(2)
    size = 3 if kind == "colorhash" else 8
    h = I.image_hash(a, kind, size)
    assert h == I.image_hash(a.copy(), kind, size) and int(h, 16) >= 0
    assert len(h) == (-(-14 * 3 // 4) if kind == "colorhash" else 16)
    if kind != "colorhash":
        assert h != I.image_hash(b, kind, size)
        white = np.zeros((24, 24, 3), np.uint8)
        white[7:17, 7:17] = 255
        near = white.copy()
        near[7:17, 17] = 255
        assert (int(I.image_hash(white, kind), 16) ^ int(I.image_hash(near, kind), 16)).bit_count() <= 20


def test_hash_errors_and_resizing():
    with pytest.raises(ValueError, match="hash type"):
        I.image_hash(solid(), "md5")
    with pytest.raises(ValueError, match="power of two"):
        I.image_hash(solid(), "whash", 6)
    assert (I.resize(solid()[:, :, 0], 5, 7) == 128).all() and I.resize(noise()[:, :, 0], 8, 9).shape == (8, 9)
    assert (I.resize_bilinear(solid()[:, :, 0], 30, 10) == 128).all()


def test_motion():
    black, white = np.zeros((8, 8), np.uint8), np.full((8, 8), 255, np.uint8)
    assert I.motion(black, black) == 0 and I.motion(black, white) == 255 and I.motion(black, white, "mse") == 65025
    assert I.motion(black, black, "histogram") == pytest.approx(0, abs=1e-12) and I.motion(black, np.full((4, 4), 255, np.uint8)) == 255
    with pytest.raises(ValueError, match="method"):
        I.motion(black, white, "flow")


def test_other_measures():
    assert sum(I.color_histogram(noise())) == pytest.approx(1) and I.edge_density(solid())[1] == 0 and I.edge_density(np.repeat([0, 255], 5).astype(np.uint8) * np.ones((6, 1), np.uint8)) == (0.2, 12)
    assert I.edge_density(EMPTY) == (0.0, 0) and I.mean_and_deviation(solid(7)).tolist() == [7, 7, 7, 0, 0, 0]
    h, s, v = I.hsv(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9]]], np.uint8))
    assert h.tolist() == [[0, 85, 170, 0]] and s.tolist() == [[255, 255, 255, 0]] and v.tolist() == [[255, 255, 255, 9]]


def test_expressions_equal_numpy(spark):
    frames = [noise(i, (8, 8))[:, :, 0] for i in range(20)] + [np.zeros((8, 8), np.uint8), np.full((8, 8), 255, np.uint8)]
    df = spark.createDataFrame([(i, f.ravel().tolist()) for i, f in enumerate(frames)], "i int, px array<int>")
    px = F.col("px")
    rows = df.select("i", pixels.blur_score(px, 8, 8).alias("b"), pixels.entropy(px).alias("e"), pixels.average_hash(px).alias("a"), pixels.difference_hash(px, 8, 8).alias("d")).collect()
    for r in rows:
        f = frames[r.i]
        assert r.b == I.blur_score(f) and r.e == pytest.approx(I.entropy(f), abs=1e-9)
        assert r.a == I.bits_hex(f > f.mean()) and r.d == I.bits_hex(f[:, 1:] > f[:, :-1])
