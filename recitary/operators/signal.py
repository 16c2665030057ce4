"""Signals to features, in numpy behind Arrow UDFs; per-row numeric parts are native."""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATE, N_FFT, HOP, N_MFCC, N_MELS = 16_000, 400, 160, 13, 128
EPS = 1e-8


def decode_wav(data: bytes, rate: int = RATE) -> np.ndarray:
    """PCM wave bytes to mono float32 at `rate`: resampled, channels averaged (both are linear, so in either order)."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, own = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        x = (v - ((v & 0x800000) << 1)) / 2.0**23
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float64) / 2.0 ** (8 * width - 1)
    x = x.reshape(-1, channels).mean(1)
    return resample(x, own, rate).astype(np.float32)


def encode_wav(samples, rate: int = RATE, channels: int = 1) -> bytes:
    """A 16-bit wave file of samples; those of several channels take turns."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(np.asarray(samples, dtype=np.float64), -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


def resample(x: np.ndarray, own: int, rate: int, lobes: int = 6, rolloff: float = 0.99) -> np.ndarray:
    """x at another rate: each new sample is a sum of old ones under a sinc that passes `rolloff` of the lower rate's
    band, cut off by a cosine window after `lobes` zeros to each side. New samples fall on as many phases between
    old ones as the reduced new rate has; each phase is one product with the old samples around it."""
    if own == rate or not len(x):
        return x
    g = math.gcd(own, rate)
    old, new = own // g, rate // g
    band = min(old, new) * rolloff
    width = math.ceil(lobes * old / band)
    padded = np.pad(np.asarray(x, dtype=np.float64), (width, width + old))
    around = np.lib.stride_tricks.sliding_window_view(padded, 2 * width + old)[::old]  # from width before old * k on
    out = np.empty((len(around), new))
    place = np.arange(-width, width + old) / old
    for phase in range(new):
        t = (place - phase / new) * band
        taps = np.where(np.abs(t) < lobes, np.cos(np.clip(t, -lobes, lobes) * np.pi / lobes / 2) ** 2, 0) * np.sinc(t) * (band / old)
        out[:, phase] = around @ taps
    return out.ravel()[: math.ceil(len(x) * rate / own)]


def peak_normalize(x: np.ndarray) -> np.ndarray:
    return x / (np.abs(x).max(initial=0.0) + EPS)


@lru_cache(maxsize=64)
def butterworth(order: int, cut: float | tuple[float, float], kind: str, rate: int) -> np.ndarray:
    """A digital Butterworth filter as second-order sections (b0, b1, b2, 1, a1, a2), by bilinear transform of the
    analog prototype. As one fraction of high order the low cutoffs lose up to ten digits."""
    edges = np.atleast_1d(np.asarray(cut, dtype=float)) * 2 / rate
    warped = 4 * np.tan(np.pi * edges / 2)
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if kind == "high":
        poles = warped[0] / poles
        gain = np.real(4.0**order / np.prod(4.0 - poles))
        zeros = np.ones(order)
    else:
        width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = poles * width / 2
        root = np.sqrt(half**2 - centre**2 + 0j)
        poles = np.r_[half + root, half - root]
        gain = np.real((4.0 * width) ** order / np.prod(4.0 - poles))
        zeros = np.tile([1.0, -1.0], order)
    p = (4.0 + poles) / (4.0 - poles)
    # a pole and its conjugate go together, and real ones by twos
    real = np.sort(p[np.abs(p.imag) < 1e-12].real)
    pairs = [(z, z.conjugate()) for z in p[p.imag >= 1e-12]] + [tuple(real[i : i + 2]) for i in range(0, len(real), 2)]
    out, at = [], 0
    for pair in pairs:
        zs = zeros[at : at + len(pair)]
        at += len(pair)
        out.append(np.r_[np.pad(np.poly(zs), (0, 2 - len(pair))), np.pad(np.real(np.poly(pair)), (0, 2 - len(pair)))])
    out[0][:3] *= gain
    return np.array(out)


def notch(freq: float, q: float, rate: int) -> np.ndarray:
    w = 2 * np.pi * freq / rate
    gain = 1 / (1 + np.tan(w / q / 2))
    return np.array([[gain, -2 * gain * np.cos(w), gain, 1, -2 * gain * np.cos(w), 2 * gain - 1]])


#: Samples that the scan of a filter takes at once.
SCAN = 128


@lru_cache(maxsize=256)
def _scan(b: tuple[float, ...], a: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For one block: the product with its samples, what a state gives in it, what each sample adds to the state
    at its end, and how a state moves over it. They follow from the coefficients, so each filter has them once."""
    n, m = len(a) - 1, SCAN
    step = np.zeros((n, n))
    step[:, 0] = -np.array(a[1:])
    step[:-1, 1:] += np.eye(n - 1)
    into = np.array(b[1:]) - np.array(a[1:]) * b[0]
    powers = [np.eye(n)]
    for _ in range(m):
        powers.append(powers[-1] @ step)
    ring = np.stack([p[0] for p in powers[:m]])
    impulse = np.r_[b[0], ring[:-1] @ into]
    response = impulse[np.abs(np.subtract.outer(np.arange(m), np.arange(m)))] * np.tri(m)
    return response, ring, np.stack([powers[m - 1 - j] @ into for j in range(m)]), powers[m]


def _lfilter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The recursion over the samples as a scan over blocks. Within a block the output is a product with the impulse
    response, plus what the state at its start rings on for; the state moves a whole block by one matrix."""
    response, ring, fed, over = _scan(tuple(b.tolist()), tuple(a.tolist()))
    blocks = np.pad(x, (0, -len(x) % SCAN)).reshape(-1, SCAN)
    added, states = blocks @ fed, np.empty((len(blocks), len(state)))
    for k in range(len(blocks)):
        states[k] = state
        state = over @ state + added[k]
    return (blocks @ response.T + states @ ring.T).ravel()[: len(x)]


def _settled(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x through all sections, which have had its first sample as input for ever."""
    held = x[0]
    for sec in sections:
        b, a = sec[:3], sec[3:]
        step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
        state = np.linalg.solve(np.eye(2) - step, b[1:] - a[1:] * b[0]) * held
        held = held * b.sum() / a.sum()
        x = _lfilter(b, a, x, state)
    return x


def filter_both_ways(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero-phase filtering: forwards and backwards with odd extension and settled initial state."""
    order = int((sections[:, 4] != 0).sum() + (sections[:, 5] != 0).sum())
    pad = min(3 * (order + 1), len(x) - 1)
    if pad < 1:
        return x
    ext = np.r_[2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]
    return _settled(sections, _settled(sections, ext)[::-1])[::-1][pad:-pad]


def band_pass(x: np.ndarray, low: float = 300, high: float = 4500, rate: int = RATE, order: int = 4) -> np.ndarray:
    return filter_both_ways(butterworth(order, (low, high), "band", rate), np.asarray(x, dtype=np.float64))


def high_pass(x: np.ndarray, rate: int = RATE, cutoff: float = 80, order: int = 4) -> np.ndarray:
    return filter_both_ways(butterworth(order, cutoff, "high", rate), np.asarray(x, dtype=np.float64))


def notch_filter(x: np.ndarray, rate: int = RATE, freq: float = 50, q: float = 30) -> np.ndarray:
    return filter_both_ways(notch(freq, q, rate), np.asarray(x, dtype=np.float64))


def _frames(x: np.ndarray, size: int, hop: int, centre: bool = True, mode: str = "constant") -> np.ndarray:
    x = np.pad(x, size // 2, mode=mode) if centre else x
    n = max(0, 1 + (len(x) - size) // hop)
    return x[np.arange(size)[None] + hop * np.arange(n)[:, None]] if n else np.zeros((0, size))


def _hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def trim_silence(x: np.ndarray, top_db: float = 35, size: int = 2048, hop: int = 512) -> np.ndarray:
    """From the first to the last frame whose level is within top_db of the loudest."""
    power = (_frames(x, size, hop) ** 2).mean(1)
    if not len(power):
        return x
    db = 10 * np.log10(np.maximum(power, 1e-10)) - 10 * np.log10(max(power.max(), 1e-10))
    loud = np.flatnonzero(db > -top_db)
    return x[loud[0] * hop : min(len(x), (loud[-1] + 1) * hop)] if len(loud) else x[:0]


def stft(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """(frames, bins), frames centred on every hop-th sample."""
    return np.fft.rfft(_frames(x, size, hop) * _hann(size), axis=1)


def istft(spec: np.ndarray, size: int, hop: int, n: int) -> np.ndarray:
    """n samples by overlapping sums, over those of the squared windows. hop divides size."""
    window = _hann(size)
    parts, k = np.fft.irfft(spec, size, axis=1) * window, size // hop
    out, norm = np.zeros((len(spec) + k - 1, hop)), np.zeros((len(spec) + k - 1, hop))
    for i in range(k):
        out[i : i + len(spec)] += parts[:, i * hop : (i + 1) * hop]
        norm[i : i + len(spec)] += window[i * hop : (i + 1) * hop] ** 2
    out = out.ravel() / np.maximum(norm.ravel(), 1e-8)
    return out[size // 2 : size // 2 + n]


def _smooth(gains: np.ndarray, frames: int, bins: int) -> np.ndarray:
    """Means under a triangle of so many frames and bins to each side; beyond the edges there is nothing."""
    for axis, half in ((0, frames), (1, bins)):
        weight = (half + 1 - np.abs(np.arange(-half, half + 1))) / (half + 1.0) ** 2
        padded = np.pad(gains, [(half, half) if k == axis else (0, 0) for k in range(2)])
        n = gains.shape[axis]
        gains = sum(w * np.take(padded, range(i, i + n), axis=axis) for i, w in enumerate(weight))
    return gains


def _gate(x: np.ndarray, rate: int, amount: float, size: int, smooth_hz: float, smooth_ms: float, open_: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """x with each bin of each frame scaled by 1 - amount where open_ (0 to 1, by magnitudes) is 0, smoothed over neighbours."""
    hop = size // 4
    if len(x) < size:
        return x
    spec = stft(x, size, hop)
    near = max(1, int(smooth_ms * rate / hop / 1000)), max(1, int(smooth_hz * size / 2 / rate))
    return istft(spec * (1 - amount + _smooth(open_(np.abs(spec)) * amount, *near)), size, hop, len(x))


def stationary_gate(
    x: np.ndarray, rate: int = RATE, noise_seconds: float = 0.2, amount: float = 1.0, size: int = 2048, deviations: float = 1.5, smooth_hz: float = 500, smooth_ms: float = 50
) -> np.ndarray:
    """Turns down what doesn't rise above the level of the first seconds: in decibels, by bin, their mean and so many
    deviations. Levels more than 80 decibels below a bin's loudest count as 80 below."""

    def db(mag: np.ndarray) -> np.ndarray:
        level = 20 * np.log10(mag + 1e-10)
        return np.maximum(level, level.max(0) - 80)

    noise = x[: int(noise_seconds * rate)]
    known = db(np.abs(stft(noise, size, size // 4)))
    limit = known.mean(0) + deviations * known.std(0)
    return _gate(x, rate, amount, size, smooth_hz, smooth_ms, lambda mag: (db(mag) > limit).astype(float))


def running_gate(
    x: np.ndarray, rate: int = RATE, amount: float = 0.8, size: int = 1024, seconds: float = 2.0, above: float = 2.0, slope: float = 10.0, smooth_hz: float = 500, smooth_ms: float = 50
) -> np.ndarray:
    """Turns down what stays near a floor that is followed in time: the magnitudes, smoothed over some seconds by a
    first-order recursion forwards and backwards. The gate opens softly where a bin exceeds its floor by `above` times."""
    frames = seconds * rate / (size // 4)
    take = (np.sqrt(1 + 4 * frames**2) - 1) / (2 * frames**2)

    def follow(mag: np.ndarray) -> np.ndarray:
        out, floor = np.empty_like(mag), mag[0]
        for t, m in enumerate(mag):
            floor = take * m + (1 - take) * floor
            out[t] = floor
        return out

    def open_(mag: np.ndarray) -> np.ndarray:
        floor = np.maximum(follow(follow(mag)[::-1])[::-1], 1e-10)
        return 1 / (1 + np.exp(np.clip(-((mag - floor) / floor - above) * slope, -500, 500)))

    return _gate(x, rate, amount, size, smooth_hz, smooth_ms, open_)


def spectral_gate(x: np.ndarray, rate: int = RATE, noise_seconds: float | None = 0.3, amount: float = 0.7, size: int = 1024) -> np.ndarray:
    """Against the level of the first noise_seconds, or with None against a floor followed in time."""
    return running_gate(x, rate, amount, size) if noise_seconds is None else stationary_gate(x, rate, noise_seconds, amount, size)


def mel_bank(rate: int = RATE, n_fft: int = N_FFT, n_mels: int = N_MELS) -> np.ndarray:
    """Triangles of equal area, evenly spaced on a scale linear to 1 kHz and logarithmic above."""
    to_mel = lambda f: np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1e-9) / 1000) / (np.log(6.4) / 27))
    to_hz = lambda m: np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * np.log(6.4) / 27))
    edges = to_hz(np.linspace(0, to_mel(np.array(rate / 2.0)), n_mels + 2))
    f = np.linspace(0, rate / 2, n_fft // 2 + 1)
    up = (f[None] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - f[None]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def mfcc(x: np.ndarray, rate: int = RATE, n_fft: int = N_FFT, hop: int = HOP, n: int = N_MFCC) -> np.ndarray:
    """(frames, n): power spectrum, mel bank, decibels cut at 80 below the top, orthonormal DCT."""
    power = np.abs(np.fft.rfft(_frames(np.asarray(x, dtype=np.float64), n_fft, hop) * _hann(n_fft), axis=1)) ** 2
    mel = power @ mel_bank(rate, n_fft).T
    db = 10 * np.log10(np.maximum(mel, 1e-10))
    db = np.maximum(db, db.max(initial=-100.0) - 80)
    k = np.arange(N_MELS)
    basis = np.cos(np.pi * np.outer(np.arange(n), 2 * k + 1) / (2 * N_MELS)) * np.sqrt(2 / N_MELS)
    basis[0] /= np.sqrt(2)
    return db @ basis.T


def delta(x: np.ndarray, width: int = 9, order: int = 1) -> np.ndarray:
    """Slope (order 1) or curvature (order 2) of a local least-squares polynomial of that
    order; at the edges that of the first or last full window."""
    half = width // 2
    if len(x) < width:
        raise ValueError(f"at least {width} frames are needed")
    t = np.arange(-half, half + 1)
    fit = np.linalg.pinv(np.vander(t, order + 1, increasing=True))
    factor = 1 if order == 1 else 2
    inner = sum(fit[order, k] * x[k : len(x) - width + 1 + k] for k in range(width)) * factor
    return np.concatenate([np.repeat(inner[:1], half, 0), inner, np.repeat(inner[-1:], half, 0)])


def cmvn(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(0)) / (x.std(0) + EPS)


def features(x: np.ndarray) -> np.ndarray:
    """(frames, 39): cepstra with both deltas, normalised by dimension."""
    m = mfcc(x)
    return cmvn(np.concatenate([m, delta(m), delta(m, order=2)], axis=1))


def preprocess(x: np.ndarray, rate: int = RATE) -> np.ndarray:
    """The full chain on a waveform: normalise, band-pass, denoise, trim, features."""
    return features(trim_silence(spectral_gate(band_pass(peak_normalize(x), rate=rate), rate)))


def uniform(*parts) -> Column:
    """A number between 0 and 1 drawn by the parts, say a seed, an id and a place: 52 bits of their md5, which any engine
    repeats. Not a stream: each number stands by itself, whatever the layout of the rows."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def add_noise(samples: Column, level: float = 0.005, seed: int = 0, key: Column | None = None) -> Column:
    """Gaussian noise, drawn by seed, key (the row's id; by default its samples) and place."""
    key = F.xxhash64(samples) if key is None else key
    normal = lambda i: F.sqrt(-2 * F.log(uniform(seed, key, i, "r"))) * F.cos(2 * np.pi * uniform(seed, key, i, "a"))
    return F.transform(samples, lambda x, i: x + level * normal(i))


def random_gain(samples: Column, low: float = 0.8, high: float = 1.2, seed: int = 0, key: Column | None = None) -> Column:
    """One factor for all samples of a row."""
    g = low + (high - low) * uniform(seed, F.xxhash64(samples) if key is None else key, "g")
    return F.get(F.transform(F.array(g), lambda y: F.transform(samples, lambda x: x * y)), F.lit(0))


def augment(samples: Column, noise: float = 0.005, seed: int = 0, key: Column | None = None) -> Column:
    """Noise and gain, each for half of the rows."""
    key = F.xxhash64(samples) if key is None else key
    noisy = F.when(uniform(seed, key, "n") < 0.5, add_noise(samples, noise, seed, key)).otherwise(samples)
    loud = F.get(F.transform(F.array(noisy), lambda y: random_gain(y, seed=seed, key=key)), F.lit(0))
    return F.when(uniform(seed, key, "h") < 0.5, loud).otherwise(noisy)


def mask_frames(frames: Column, start: Column, width: int = 10, dim: Column | None = None, dims: int = 5) -> Column:
    """One run of frames and one of dimensions set to zero, in array<array<double>>."""
    zero = lambda f, i: F.transform(f, lambda x, d: F.when((i >= start) & (i < start + width), F.lit(0.0)).when((d >= dim) & (d < dim + dims), F.lit(0.0)).otherwise(x) if dim is not None else F.when((i >= start) & (i < start + width), F.lit(0.0)).otherwise(x))
    return F.transform(frames, zero)


def mask_batch(rows: DataFrame, batch: str = "batch", frames: str = "frames", seed: int = 0, times: int = 2, time_most: int = 8, dims: int = 2, dim_most: int = 10) -> DataFrame:
    """The same random time and dimension masks for all rows of a batch, drawn from its number."""
    draw = lambda k, most: F.floor(uniform(seed, F.col(batch), k) * most).cast("int")
    shortest = F.min(F.size(frames)).over(Window.partitionBy(batch))
    width = F.size(F.get(F.col(frames), F.lit(0)))
    out = rows.withColumn("__t", shortest).withColumn("__d", width)
    x = F.col(frames)
    for k in range(times):
        w = draw(4 * k, time_most + 1)
        s = draw(4 * k + 1, F.greatest(F.col("__t") - w, F.lit(1)))
        x = F.transform(x, lambda f, i: F.when((i >= s) & (i < s + w), F.transform(f, lambda v: F.lit(0.0).cast("double"))).otherwise(f))
    for k in range(dims):
        w = draw(1000 + 4 * k, dim_most + 1)
        s = draw(1001 + 4 * k, F.greatest(F.col("__d") - w, F.lit(1)))
        x = F.transform(x, lambda f: F.transform(f, lambda v, d: F.when((d >= s) & (d < s + w), F.lit(0.0)).otherwise(v)))
    return out.withColumn(frames, x).drop("__t", "__d")


def slice_clip(samples: Column, start: Column, end: Column, rate: int = RATE) -> Column:
    """The samples from start to end seconds, cut at whole milliseconds."""
    a = F.floor(F.floor(start * 1000) * rate / 1000).cast("int")
    b = F.floor(F.floor(end * 1000) * rate / 1000).cast("int")
    return F.slice(samples, a + 1, F.greatest(b - a, F.lit(0)))


#: Rows of a batch whose results are held at once, whatever the session's batches are.
ROWS = 256


def signal_udf(f: Callable[[np.ndarray], np.ndarray], out: str = "array<float>"):
    """A numpy function of one waveform as an Arrow UDF. Results stay arrays and leave ROWS at a time, so that a worker's
    memory grows neither with the table nor with the session's batches."""

    def one(x) -> np.ndarray | list | None:
        if x is None:
            return None
        y = np.asarray(f(np.asarray(x, dtype=np.float64)))
        return y if y.ndim == 1 else list(y)

    @F.pandas_udf(out)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            for k in range(0, len(rows), ROWS):
                yield pd.Series([one(x) for x in rows[k : k + ROWS]], dtype="object")

    return run


def cmvn_long(cells: DataFrame, utt: str = "utt", dim: str = "dim", value: str = "x") -> DataFrame:
    """z-scores of long-form cells within (utt, dim); population deviation. Means come from partial
    aggregates and a join, so a long utterance is never sorted in one task."""
    key = [utt, dim]
    by = cells.groupBy(*key).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__dev"))
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in key]
    out = cells.alias("c").join(by.alias("s"), on, "left")
    return out.select("c.*", ((F.col(f"c.{value}") - F.col("s.__mean")) / (F.col("s.__dev") + EPS)).alias("z"))


def peak_normalize_long(cells: DataFrame, utt: str = "utt", value: str = "x") -> DataFrame:
    by = cells.groupBy(utt).agg(F.max(F.abs(value)).alias("__peak"))
    out = cells.alias("c").join(by.alias("s"), F.col(f"c.{utt}").eqNullSafe(F.col(f"s.{utt}")), "left")
    return out.select("c.*", (F.col(f"c.{value}") / (F.col("s.__peak") + EPS)).alias("y"))


def delta_long(cells: DataFrame, utt: str = "utt", t: str = "t", value: str = "x", half: int = 4) -> DataFrame:
    """Slopes of full windows only (rows half+1 to n-half of each utterance)."""
    w = Window.partitionBy(utt).orderBy(t)
    total = 2 * sum(k * k for k in range(1, half + 1))
    slope = sum((F.lead(value, k).over(w) - F.lag(value, k).over(w)) * k for k in range(1, half + 1)) / total
    return cells.withColumn("delta", slope).where(F.col("delta").isNotNull())
