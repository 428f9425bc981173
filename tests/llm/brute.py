"""The quality classifier by the textbook, in plain Python over texts: nothing of the library is called."""

import math
import re
from collections import Counter

import numpy as np

_SETS = {"bar": "|", "mark": "!?", "stop": ".,;:'\"()-", "symbol": "%#*&$@^~_=+<>{}[]\\/`"}


def words_of(text):
    return [w.lower() for w in re.findall(rb"(?:[A-Za-z0-9]|[\x80-\xff])+", (text or "").encode())]


def keys_of(words):
    """Words, and the beginnings of longer ones."""
    return [("word", w) for w in words] + [("lead", w[:6]) for w in words if len(w) > 6]


def plain_features(text):
    raw = (text or "").encode()
    n = max(1, len(raw))
    count = lambda test: sum(map(test, raw))
    lines = count(lambda c: c in b"\n\r")
    shares = [count(lambda c: 65 <= c <= 90), count(lambda c: 48 <= c <= 57), count(lambda c: c in b" \t"), lines]
    shares += [count(lambda c, s=s: chr(c) in s) for s in _SETS.values()] + [count(lambda c: c >= 128)]
    words = words_of(text)
    k = max(1, len(words))
    again = sum(a == b for a, b in zip(words, words[1:]))
    rest = [math.log1p(len(words)), len(set(words)) / k, math.sqrt(again / k), sum(map(len, words)) / k, math.log1p(len(words) / (lines + 1))]
    return [math.sqrt(x / n) for x in shares] + rest


def sides_of(labels):
    """0 preferred, 1 of low quality, 2 toxic."""
    side = {}
    for doc, quality, toxic in labels:
        bad = 2 if toxic == 1 else None if quality is None else 1 - quality
        if doc is not None and bad is not None:
            side[doc] = max(side.get(doc, 0), bad)
    return side


def markers_of(texts, side):
    counts = {k: Counter() for k in (0, 1, 2)}
    for doc, s in side.items():
        counts[s].update(set(keys_of(words_of(texts[doc]))))
    total = Counter(side.values())
    out = {}
    for key in set().union(*counts.values()):
        best = None
        for k in (1, 2):
            if not total[k]:
                continue
            a, b = counts[k][key], counts[0][key]
            p = (a + b) / (total[k] + total[0])
            term = lambda x, e: x * math.log(x / e) if x else 0.0
            g2 = 2 * (term(a, p * total[k]) + term(b, p * total[0]))
            odds = math.log(((a + 0.5) / (total[k] + 1)) / ((b + 0.5) / (total[0] + 1)))
            if odds > 0:
                best = max(best or (0, 0), (g2, odds))
        if best and best[0] >= 30:
            out[key] = best[1]
    return out


def features_of(text, markers):
    words = words_of(text)
    hits = [markers[k] for k in keys_of(words) if k in markers]
    return plain_features(text) + [math.log1p(sum(hits)), math.sqrt(len(hits) / max(1, len(words)))]


def fitted(good, bad, l2=1e-3):
    """Gradient steps of Newton over every pair, written out."""
    d = (good[:, None] - bad[None]).reshape(-1, good.shape[1])
    w = np.zeros(d.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(d @ w))
        grad = -(d * p[:, None]).mean(0) + l2 * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        loss = lambda v: np.logaddexp(0, -(d @ v)).mean() + l2 / 2 * v @ v
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-9:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return w


def quality(docs, labels):
    """{doc: score} of all documents and the threshold; ``docs`` maps ids to texts."""
    side = {d: s for d, s in sides_of(labels).items() if d in docs}
    markers = markers_of(docs, side)
    x = {d: np.array(features_of(t, markers)) for d, t in docs.items()}
    sample = np.stack([x[d] for d in side])
    mean, scale = sample.mean(0), sample.std(0)
    scale[scale < 1e-9] = 1
    z = {d: (v - mean) / scale for d, v in x.items()}
    good, bad = ([z[d] for d in side if (side[d] > 0) == k] for k in (False, True))
    w = fitted(np.stack(good), np.stack(bad))
    score = {d: float(v @ w) for d, v in z.items()}
    a, b = (np.array([score[d] for d in side if (side[d] > 0) == k]) for k in (False, True))
    best = None
    for q in (0.0, 0.0005, 0.001, 0.002, 0.005):
        t = np.quantile(a, q, method="lower")
        gain = (a >= t).mean() - (b >= t).mean()
        if best is None or gain > best[0]:
            best = gain, float(t)
    return score, best[1]
