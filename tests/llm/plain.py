"""The classifiers once more, as plain loops over dictionaries, for comparison."""

import math

import numpy as np


def ftrl(rows, labels, classes, alpha, epochs, seed, beta=1.0, l1=1e-3, l2=1e-3):
    """rows: dictionaries feature -> value. Returns feature -> weights of the classes."""
    z, n = {}, {}

    def weights(f):
        out = []
        for zc, nc in zip(z.get(f, [0.0] * classes), n.get(f, [0.0] * classes)):
            shrunk = math.copysign(max(abs(zc) - l1, 0.0), zc)
            out.append(-shrunk / ((beta + math.sqrt(nc)) / alpha + l2))
        return out

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            w = {f: weights(f) for f in rows[i]}
            p = softmax([sum(x * w[f][c] for f, x in rows[i].items()) for c in range(classes)])
            for f, x in rows[i].items():
                zf, nf = z.setdefault(f, [0.0] * classes), n.setdefault(f, [0.0] * classes)
                for c in range(classes):
                    g = x * (p[c] - (c == labels[i]))
                    zf[c] += g - (math.sqrt(nf[c] + g * g) - math.sqrt(nf[c])) / alpha * w[f][c]
                    nf[c] += g * g
    return {f: weights(f) for f in z}


def softmax(s):
    e = [math.exp(x - max(s)) for x in s]
    return [x / sum(e) for x in e]


def scores(row, weights, classes):
    none = [0.0] * classes
    return [sum(x * weights.get(f, none)[c] for f, x in row.items()) for c in range(classes)]


def calibrated(margins, marks, ridge=1e-2):
    """Slope and offset by small damped steps on the penalised log loss."""
    m, y, a, b = np.array(margins), np.array(marks, float), 1.0, 0.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        ga, gb = (m * (p - y)).sum() + ridge * (a - 1), (p - y).sum() + ridge * b
        v = p * (1 - p)
        haa, hab, hbb = (m * m * v).sum() + ridge, (m * v).sum(), v.sum() + ridge
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - max(-1, min(1, da)), b - max(-1, min(1, db))
        if max(abs(da), abs(db)) < 1e-8:
            break
    return max(a, 0.0), b


MASK = (1 << 64) - 1
STEPS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def grams(text, bits):
    out = {}
    points = [ord(c) for c in text.lower()]
    for n in (1, 2, 3):
        for at in range(len(points) - n + 1):
            h = n
            for k in range(n):
                h = (h + points[at + k] + 1) * STEPS[k] & MASK
                h ^= h >> 29
            f = (h * STEPS[0] & MASK) >> (64 - bits)
            out[f] = out.get(f, 0) + 1
    return out
