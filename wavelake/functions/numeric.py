"""Dense kernels on NumPy for what runs inside one group or on small matrices of the driver."""

from __future__ import annotations

import math

import numpy as np


def beta_continued(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + k / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * beta_continued(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * beta_continued(b, a, 1 - x) / b


def t_two_sided(t: float, dof: float) -> float:
    """P(|T| >= |t|) of Student's t."""
    return incomplete_beta(dof / 2, 0.5, dof / (dof + t * t))


def fast_length(n: int) -> int:
    """The smallest 2^a 3^b 5^c that is n or more."""
    best, five = 1 << max(0, (n - 1).bit_length()), 1
    while five < best:
        three = five
        while three < best:
            need = -(-n // three)
            best = min(best, three << max(0, (need - 1).bit_length()))
            three *= 3
        five *= 5
    return best


def analytic(x: np.ndarray, n: int | None = None) -> np.ndarray:
    """Analytic signal over the first axis by FFT, zero-padded to n."""
    size, n = len(x), n or len(x)
    spectrum = np.fft.fft(x, n, axis=0)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(spectrum * gain.reshape(-1, *[1] * (x.ndim - 1)), axis=0)[:size]


def low_pass(taps: int, cutoff: float, srate: float) -> np.ndarray:
    """Hamming-windowed sinc with gain 1 at frequency 0."""
    m = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(2 * cutoff / srate * m) * np.hamming(taps)
    return h / h.sum()


def edge_filtered(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """'valid' convolution after padding with the edge values."""
    half = len(taps) // 2
    return np.convolve(np.pad(x, (half, half), mode="edge"), taps, mode="valid")


def recursive(b: np.ndarray, a: np.ndarray, x: np.ndarray, block: int = 128) -> np.ndarray:
    """Recursive filter b, a over time; columns of x at once. State-space form, a block of samples a step: what a block's input and the state before it add
    to its output are two matrices, so the loop runs over blocks, not samples."""
    b, a = np.asarray(b, float) / a[0], np.asarray(a, float) / a[0]
    n, block = max(len(a), len(b), 2), max(1, min(block, len(x)))
    b, a = np.pad(b, (0, n - len(b))), np.pad(a, (0, n - len(a)))
    move = np.eye(n - 1, k=1)
    move[:, 0] -= a[1:]
    enter = b[1:] - a[1:] * b[0]
    seen, given = [np.eye(n - 1)[0]], [enter]
    for _ in range(block - 1):
        seen.append(seen[-1] @ move)
        given.append(move @ given[-1])
    seen, given = np.array(seen), np.array(given)
    impulse = np.r_[b[0], seen[:-1] @ enter]
    lag = np.arange(block)[:, None] - np.arange(block)[None, :]
    inside = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
    jump = np.linalg.matrix_power(move, block)
    flat = x.reshape(len(x), -1).astype(float)
    out, state = np.empty_like(flat), np.zeros((n - 1, flat.shape[1]))
    for t in range(0, len(flat), block):
        part = flat[t : t + block]
        k = len(part)
        out[t : t + k] = inside[:k, :k] @ part + seen[:k] @ state
        if k == block:
            state = jump @ state + given[::-1].T @ part
    return out.reshape(x.shape)


def chebyshev2(order: int, ripple: float, band: tuple[float, float] | float, srate: float, kind: str = "bandpass") -> tuple[np.ndarray, np.ndarray]:
    """Chebyshev type II filter (stop-band attenuation ripple in dB) by the bilinear transform: numerator and denominator."""
    mu = np.arcsinh(1 / (1 / np.sqrt(10 ** (ripple / 10) - 1))) / order
    m = np.arange(-order + 1, order, 2)
    odd = m[m != 0]
    zeros = -np.conj(1j / np.sin(odd * np.pi / (2 * order)))
    poles = -np.exp(1j * np.pi * m / (2 * order))
    poles = np.sinh(mu) * poles.real + 1j * np.cosh(mu) * poles.imag
    poles = 1 / poles
    gain = np.real(np.prod(-poles) / np.prod(-zeros))
    warp = 4 * np.tan(np.pi * np.atleast_1d(np.asarray(band, float)) / srate)
    if kind == "bandpass":
        width, centre = warp[1] - warp[0], np.sqrt(warp[0] * warp[1])
        degree = len(poles) - len(zeros)
        both = lambda r: np.concatenate([r * width / 2 + s * np.sqrt((r * width / 2) ** 2 - centre**2) for s in (1, -1)])
        zeros, poles, gain = np.append(both(zeros), np.zeros(degree)), both(poles), gain * width**degree
    elif kind == "lowpass":
        degree = len(poles) - len(zeros)
        zeros, poles, gain = zeros * warp[0], poles * warp[0], gain * warp[0] ** degree
    else:
        raise ValueError(kind)
    degree = len(poles) - len(zeros)
    gain = gain * np.real(np.prod(4 - zeros) / np.prod(4 - poles))
    zeros, poles = np.append((4 + zeros) / (4 - zeros), -np.ones(degree)), (4 + poles) / (4 - poles)
    return np.real(gain * np.poly(zeros)), np.real(np.poly(poles))


def resampled(x: np.ndarray, n: int) -> np.ndarray:
    """Fourier resampling to n samples."""
    size = len(x)
    spectrum, keep = np.fft.rfft(x), min(n, size)
    out = np.zeros(n // 2 + 1, complex)
    k = keep // 2 + 1
    out[:k] = spectrum[:k]
    if keep % 2 == 0 and n != size:
        out[keep // 2] *= 2 if n < size else 0.5
    return np.fft.irfft(out, n) * n / size


def decimated(x: np.ndarray, factor: int) -> np.ndarray:
    """Every factor-th sample after a Kaiser (beta 5) low-pass of half length 10 * factor, zeros outside."""
    half = 10 * factor
    m = np.arange(-half, half + 1)
    h = np.sinc(m / factor) * np.kaiser(2 * half + 1, 5.0)
    h /= h.sum()
    return np.convolve(x, h, mode="full")[half : half + len(x)][::factor]


def morlet(frequency: float, srate: float, cycles: float = 7.0) -> np.ndarray:
    """Complex Morlet wavelet of unit energy."""
    sigma = cycles / (2 * np.pi * frequency)
    half = int(np.ceil(5 * sigma * srate))
    t = np.arange(-half, half + 1) / srate
    w = np.exp(2j * np.pi * frequency * t - t**2 / (2 * sigma**2))
    return w / np.sqrt((np.abs(w) ** 2).sum() / 2)


def cross_spectrum(x: np.ndarray, srate: float, points: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One Hann segment over all samples, mean removed, zero-padded to points: frequencies, and density (channel, channel, frequency)."""
    n = len(x)
    points = points or n
    if points < n:
        raise ValueError("points must not be fewer than the samples")
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) if n > 1 else np.ones(n)
    f = np.fft.fft((x - x.mean(axis=0)) * w[:, None], points, axis=0)
    return np.fft.fftfreq(points, 1 / srate), np.einsum("fi,fj->ijf", np.conj(f), f) / (srate * (w**2).sum())


def gammatone(x: np.ndarray, srate: float, centre: float, rectify: bool = False) -> dict[str, np.ndarray]:
    """Fourth-order gammatone channel: displacement, envelope, unwrapped phase, instantaneous frequency."""
    n = np.arange(len(x))
    turn = 2 * np.pi * centre / srate
    b = 2 * np.pi / srate * 24.7 * (0.00437 * centre + 1) * 1.019
    a = np.exp(-b)
    p = recursive(np.array([1.0]), np.array([1, -4 * a, 6 * a**2, -4 * a**3, a**4]), np.stack([x * np.cos(turn * n), -x * np.sin(turn * n)], axis=1))
    u = p.copy()
    u[1:] += 4 * a * p[:-1]
    u[2:] += a**2 * p[:-2]
    z = (u[:, 0] + 1j * u[:, 1]) * b**4 / 3
    moved = np.real(z * np.exp(1j * turn * n))
    phase = np.unwrap(np.angle(z))
    freq = np.full(len(x), float(centre))
    freq[:-1] += np.diff(phase) * srate / (2 * np.pi)
    return {"displacement": np.maximum(moved, 0) if rectify else moved, "envelope": np.abs(z), "phase": phase, "frequency": freq}


def generalised_eigh(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a v = w b v for symmetric a and positive definite b: ascending values, vectors with v' b v = 1."""
    low = np.linalg.cholesky(b)
    inner = np.linalg.solve(low, np.linalg.solve(low, a).T)
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    return value, np.linalg.solve(low.T, vector)


def signed(vectors: np.ndarray) -> np.ndarray:
    """Columns with their largest entry positive."""
    top = np.abs(vectors).argmax(axis=0)
    return vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1, 1)


def positive_definite(a: np.ndarray) -> bool:
    """Exactly symmetric, and a Cholesky factor exists."""
    if not np.array_equal(a, a.T):
        return False
    try:
        np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        return False
    return True
