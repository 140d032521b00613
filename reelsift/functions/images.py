"""Pixel measures and perceptual hashes in numpy, for whole frames.

Gray conversions differ by measure on purpose: sharpness weighs RGB in fixed
point, motion weighs the same numbers as BGR, entropy uses unrounded luma, and
hashes see swapped channels. Hashes follow the public definitions of average,
difference, DCT, wavelet and colour hashing.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

EPS = np.finfo(float).eps


def _weighed(a: np.ndarray, weights: tuple[int, int, int], bits: int) -> np.ndarray:
    """Rounded fixed-point sum of three channels; below 2^24 single precision is exact."""
    flat = a.reshape(-1, 3).astype(np.float32) @ np.array(weights, np.float32)
    return ((flat + np.float32(1 << (bits - 1))).astype(np.int32) >> bits).astype(np.uint8).reshape(a.shape[:2])


def gray_rgb(a: np.ndarray) -> np.ndarray:
    """Fixed-point luma of RGB, rounded; other frames as they are."""
    if a.ndim != 3 or a.shape[2] != 3:
        return a if a.ndim == 2 else a[:, :, 0]
    return _weighed(a, (9798, 19235, 3735), 15)


def gray_bgr(a: np.ndarray) -> np.ndarray:
    """The same luma with the channels taken as BGR."""
    return gray_rgb(a[:, :, ::-1]) if a.ndim == 3 and a.shape[2] == 3 else gray_rgb(a)


def blur_score(a: np.ndarray) -> float:
    """Population variance of the 4-neighbour Laplacian with reflected borders; 0 for empty frames."""
    if not a.size:
        return 0.0
    g = gray_rgb(a).astype(np.int16)
    h, w = g.shape
    p = np.empty((h + 2, w + 2), np.int16)
    p[1:-1, 1:-1] = g
    p[0, 1:-1], p[-1, 1:-1] = g[min(1, h - 1)], g[max(h - 2, 0)]
    p[1:-1, 0], p[1:-1, -1] = g[:, min(1, w - 1)], g[:, max(w - 2, 0)]
    lap = p[:-2, 1:-1] + p[2:, 1:-1]
    lap += p[1:-1, :-2]
    lap += p[1:-1, 2:]
    lap -= 4 * g
    # Whole numbers, so the variance is exact up to its last division.
    flat = lap.ravel().astype(np.float64)
    n, s, q = flat.size, int(flat.sum()), int(flat @ flat)
    return (q * n - s * s) / (n * n)


def entropy(a: np.ndarray) -> float:
    """Shannon entropy in bits over 256 equal bins of 0 to 255; 0 for empty frames."""
    if not a.size:
        return 0.0
    if a.ndim == 3 and a.shape[2] == 3:
        # Luma in ten-thousandths is whole, so no value falls into the wrong bin by rounding.
        g = a.reshape(-1, 3).astype(float) @ np.array([2989.0, 5870.0, 1140.0])
        counts = np.bincount(np.minimum((g * 256 / 2550000).astype(np.int64), 255), minlength=256)
    else:
        per_value = np.bincount(a.ravel(), minlength=256)
        counts = np.bincount(np.minimum(np.arange(256) * 256 // 255, 255), per_value, 256)
    p = counts / (counts.sum() + EPS)
    return float(-(p * np.log2(p + EPS)).sum())


@lru_cache(maxsize=64)
def _lanczos(n: int, to: int) -> np.ndarray:
    """Weights (to, n) of a Lanczos-3 resampling that is widened when it shrinks."""
    scale = n / to
    width = max(scale, 1.0)
    centers = (np.arange(to) + 0.5) * scale
    x = (np.arange(n)[None, :] + 0.5 - centers[:, None]) / width
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize(g: np.ndarray, height: int, width: int) -> np.ndarray:
    """A gray frame resampled to (height, width), rounded to bytes after each direction."""
    if g.shape == (height, width):
        return g
    across = np.clip(np.rint(g.astype(float) @ _lanczos(g.shape[1], width).T), 0, 255)
    return np.clip(np.rint(_lanczos(g.shape[0], height) @ across), 0, 255).astype(np.uint8)


def resize_bilinear(g: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resampling without widening, for motion between frames of different sizes."""

    def places(n: int, to: int):
        x = np.clip((np.arange(to) + 0.5) * n / to - 0.5, 0, n - 1)
        lo = np.floor(x).astype(int)
        return lo, np.minimum(lo + 1, n - 1), x - lo

    r0, r1, fr = places(g.shape[0], height)
    c0, c1, fc = places(g.shape[1], width)
    x = g.astype(float)
    rows = x[r0] * (1 - fr)[:, None] + x[r1] * fr[:, None]
    return np.rint(rows[:, c0] * (1 - fc) + rows[:, c1] * fc).astype(np.uint8)


def luma_swapped(a: np.ndarray) -> np.ndarray:
    """Gray for hashing: three-channel frames have their channels swapped, then luma with 16-bit weights."""
    if a.ndim == 2:
        return a
    if a.shape[2] != 3:
        return a[:, :, 0]
    x = a[:, :, ::-1].astype(np.uint32)
    return ((x[:, :, 0] * 19595 + x[:, :, 1] * 38470 + x[:, :, 2] * 7471 + 0x8000) >> 16).astype(np.uint8)


def bits_hex(bits: np.ndarray) -> str:
    flat = np.asarray(bits, bool).ravel()
    return f"{int(''.join('1' if b else '0' for b in flat), 2):0{-(-len(flat) // 4)}x}"


@lru_cache(maxsize=16)
def _cosines(n: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    return 2 * np.cos(np.pi * k * (2 * i + 1) / (2 * n))


def average_bits(a: np.ndarray, size: int) -> np.ndarray:
    g = resize(luma_swapped(a), size, size).astype(float)
    return g > g.mean()


def difference_bits(a: np.ndarray, size: int) -> np.ndarray:
    g = resize(luma_swapped(a), size, size + 1).astype(int)
    return g[:, 1:] > g[:, :-1]


def dct_bits(a: np.ndarray, size: int) -> np.ndarray:
    """The low frequencies of the cosine transform of a frame four times the hash's size, above their median."""
    g = resize(luma_swapped(a), 4 * size, 4 * size).astype(float)
    c = _cosines(4 * size)
    low = (c @ g @ c.T)[:size, :size]
    return low > np.median(low)


def wavelet_bits(a: np.ndarray, size: int) -> np.ndarray:
    """Haar averages of a frame without its mean, above their median."""
    if size & (size - 1):
        raise ValueError("the size of a wavelet hash must be a power of two")
    g = luma_swapped(a)
    scale = max(1 << (int(min(g.shape)).bit_length() - 1), size)
    # Neither the mean nor the scale changes what is above the median, so sums stay whole.
    x = resize(g, scale, scale).astype(np.int64)
    while x.shape[0] > size:
        x = x[0::2, 0::2] + x[0::2, 1::2] + x[1::2, 0::2] + x[1::2, 1::2]
    return x > np.median(x)


def hsv(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue, saturation and value of an RGB frame, each 0 to 255."""
    x = a.astype(float)
    hi, lo = x.max(axis=2), x.min(axis=2)
    span = hi - lo
    safe = np.where(span == 0, 1, span)
    r, g, b = (x[:, :, i] for i in range(3))
    hue = np.where(hi == r, (g - b) / safe % 6, np.where(hi == g, (b - r) / safe + 2, (r - g) / safe + 4))
    hue = np.where(span == 0, 0, hue)
    sat = np.where(hi == 0, 0, span / np.where(hi == 0, 1, hi))
    return (hue / 6 * 255).astype(int), (sat * 255).astype(int), hi.astype(int)


def saturation(a: np.ndarray) -> float:
    """Mean saturation, 0 to 1, of bytes of saturation; 0 for gray and empty frames."""
    if a.ndim != 3 or a.shape[2] < 3 or not a.size:
        return 0.0
    s = hsv(a[:, :, :3])[1]
    return int(s.sum()) / s.size / 255


def color_bits(a: np.ndarray, bits: int) -> np.ndarray:
    """Shares of black, gray and six faint and six bright hues, each in ``bits`` bits."""
    rgb = np.repeat(a[:, :, None], 3, axis=2) if a.ndim == 2 else a[:, :, :3][:, :, ::-1]
    h, s, _ = hsv(rgb)
    black = luma_swapped(a) < 32
    gray = (s < 85) & ~black
    colored = ~black & (s >= 85)
    n = max(1, int(colored.sum()))
    edges = np.linspace(0, 255, 7)
    faint, bright = (np.histogram(h[colored & m], edges)[0] for m in (s < 170, s > 170))
    most = 2**bits
    values = [min(most - 1, int(x.mean() * most)) if x.size else 0 for x in (black, gray)]
    values += [min(most - 1, int(c * most / n)) for c in (*faint, *bright)]
    return np.array([[v >> (bits - 1 - i) & 1 for i in range(bits)] for v in values], bool)


HASHES = {"phash": dct_bits, "ahash": average_bits, "dhash": difference_bits, "whash": wavelet_bits, "colorhash": color_bits}


def image_hash(a: np.ndarray, kind: str = "phash", size: int = 8) -> str:
    """Hex of a perceptual hash; ``ValueError`` for other kinds."""
    if kind not in HASHES:
        raise ValueError(f"hash type must be one of {sorted(HASHES)}, not {kind!r}")
    return bits_hex(HASHES[kind](a, size))


def hash_difference(a: str, b: str) -> int:
    """Number of differing bits of two hashes."""
    return (int(a, 16) ^ int(b, 16)).bit_count()


def color_histogram(a: np.ndarray, bins: int = 32) -> np.ndarray:
    """Histograms of hue, saturation and value one after another, scaled to a sum of 1."""
    rgb = np.repeat(a[:, :, None], 3, axis=2) if a.ndim == 2 else a[:, :, :3]
    counts = np.concatenate([np.histogram(c, bins, (0, 256))[0] for c in hsv(rgb)]).astype(float)
    return counts / max(counts.sum(), 1)


def edge_density(a: np.ndarray, low: float = 50, high: float = 150) -> tuple[float, int]:
    """Share and number of edge pixels: Sobel gradients above ``high``, or above ``low`` beside those."""
    if not a.size:
        return 0.0, 0
    p = np.pad(gray_rgb(a).astype(int), 1, mode="edge")
    rows = p[:-2] + 2 * p[1:-1] + p[2:]
    cols = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    size = np.abs(rows[:, 2:] - rows[:, :-2]) + np.abs(cols[2:] - cols[:-2])
    strong = np.pad(size >= high, 1)
    beside = sum(strong[1 + i : strong.shape[0] - 1 + i, 1 + j : strong.shape[1] - 1 + j].astype(int) for i in (-1, 0, 1) for j in (-1, 0, 1)) > 0
    edges = (size >= high) | (size >= low) & beside
    return float(edges.mean()), int(edges.sum())


def mean_and_deviation(a: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of each channel."""
    x = np.repeat(a[:, :, None], 3, axis=2) if a.ndim == 2 else a
    return np.concatenate([x.mean(axis=(0, 1)), x.std(axis=(0, 1))])


def motion(a: np.ndarray, b: np.ndarray, method: str = "mean_diff") -> float:
    """How far gray frame ``a`` is from ``b``, which is resized to it if need be."""
    if a.shape != b.shape:
        b = resize_bilinear(b, *a.shape)
    if method == "mean_diff":
        return float(np.abs(a.astype(int) - b.astype(int)).mean())
    if method == "mse":
        return float(((a.astype(float) - b.astype(float)) ** 2).mean())
    if method != "histogram":
        raise ValueError(f"motion method must be mean_diff, mse or histogram, not {method!r}")
    x, y = (np.bincount(g.ravel(), minlength=256).astype(float) for g in (a, b))
    x, y = (h / (h.sum() + 1e-7) for h in (x, y))
    x, y = x - x.mean(), y - y.mean()
    norm = np.sqrt((x * x).sum() * (y * y).sum())
    return float(1 - ((x * y).sum() / norm if norm > 0 else 1.0))
