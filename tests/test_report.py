"""The scoring report and the prototypes against one dense calculation of the same definitions."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from arclume.plans.geometry import spherical_kmeans
from arclume.plans.pipeline import three_method_report

SF = "/root/testdata/sf0.001"
LO, KAPPA = 1 - 1e-7, 1 / 0.3


def unit(x):
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def log(x, mu):
    d = np.clip(x @ mu, -LO, LO)[:, None]
    r = x - d * mu
    return r / np.maximum(np.sqrt((r * r).sum(1, keepdims=True)), 1e-8) * np.arccos(d)


def mean_direction(x):
    x = unit(x)
    mu = unit(x.mean(0)[None])[0]
    for _ in range(5):
        step = log(x, mu).mean(0)
        t = max(np.sqrt((step * step).sum()), 1e-8)
        mu = unit((np.cos(t) * mu + np.sin(t) * step / t)[None])[0]
    return mu


def prototypes(x, k, rounds=100):
    """Farthest-point start, then Lloyd's rounds, one row at a time."""
    x = unit(x)
    c = [x[0]]
    while len(c) < k:
        c.append(max(x, key=lambda v: min(1 - v @ p for p in c)))
    c = np.array(c)
    for _ in range(rounds):
        own = [max(range(k), key=lambda j: (v @ c[j], -j)) for v in x]
        new = np.array([np.mean([v for v, o in zip(x, own) if o == j], axis=0) if j in own else c[j] for j in range(k)])
        new = unit(new)
        if np.abs(new - c).max() < 1e-12:
            return new
        c = new
    return c


def probability(x, n, a):
    angle = lambda p: np.arccos(np.clip(x @ p.T, -LO, LO)).min(1)
    ln, la = -KAPPA * angle(n), -KAPPA * angle(a)
    m = np.maximum(ln, la)
    return np.exp(la - m) / (np.exp(ln - m) + np.exp(la - m) + 1e-8)


def ap_auc(score, label):
    score, label = np.round(score, 12), np.asarray(label)
    pos, neg = label.sum(), (1 - label).sum()
    ap, seen = 0.0, 0.0
    for t in sorted(set(score), reverse=True):
        hit = label[score >= t].sum() / pos
        ap += (hit - seen) * label[score >= t].mean()
        seen = hit
    if not neg:
        return ap, None
    wins = sum((p > score[label == 0]).sum() + 0.5 * (p == score[label == 0]).sum() for p in score[label == 1])
    return ap, wins / pos / neg


def smoothed(x, sigma):
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, r, mode="symmetric"), w / w.sum(), mode="valid")


def report():
    t = pq.read_table(f"{SF}/embeddings.parquet")
    ids, label = np.array(t["vec_id"]), np.array(t["label"])
    x = np.array(t["embedding"].to_pylist(), np.float64)
    video, abnormal = ids // 10, (label >= 5).astype(int)
    train = video % 5 == 0
    m1, h = unit(log(unit(x), mean_direction(x))), unit(log(unit(x[:, ::-1]), mean_direction(x[:, ::-1])))
    order = np.argsort(ids)
    normal, abn = (prototypes(np.array([m1[i] for i in order if train[i] and abnormal[i] == a]), k) for a, k in ((0, 3), (1, 5)))
    test = np.flatnonzero(~train)
    e = m1.copy()
    for i in test:
        near = sorted((j for j in test if j != i and h[i] @ h[j] >= 0.45), key=lambda j: (-(h[i] @ h[j]), ids[j]))[:200]
        if near:
            s = h[near] @ h[i]
            e[i] = unit((0.65 * m1[i] + 0.35 * (s @ m1[near]) / s.sum())[None])[0]
    s1, s2 = probability(m1, normal, abn), probability(e, normal, abn)
    c = np.median(s2[test])
    r = np.median(np.abs(s2[test] - c))
    low, high = max(0, c - r), min(1, c + r)
    pulled = e.copy()
    for v in set(video[test]):
        own = [i for i in test if video[i] == v]
        hit = sum(s2[own] > high) >= 3
        protos = abn if hit else normal
        votes = np.bincount((e[own] @ protos.T).argmax(1), minlength=len(protos))
        best = [p for p in sorted(range(len(protos)), key=lambda p: (-votes[p], p)) if votes[p]][: 1 if hit else 2]
        for i in own:
            if low <= s2[i] <= high:
                p = protos[min(best, key=lambda p: np.arccos(np.clip(e[i] @ protos[p], -LO, LO)))]
                th = np.arccos(np.clip(e[i] @ p, -LO, LO))
                pulled[i] = unit(((np.sin(0.7 * th) * e[i] + np.sin(0.3 * th) * p) / max(np.sin(th), 1e-8))[None])[0]
    s3 = probability(pulled, normal, abn)
    out = {}
    for name, s in (("M1", s1), ("M2", s2), ("M3", s3)):
        frames, truth, tops, videos = [], [], [], []
        for v in sorted(set(video[test])):
            own = [i for i in order if i in set(test) and video[i] == v]
            frames.append(smoothed(np.repeat(s[own], 24), 5))
            truth.append(np.repeat(abnormal[own], 24))
            tops.append((s2 if name == "M3" else s)[own].max())
            videos.append(abnormal[own].max())
        ap, auc = ap_auc(np.concatenate(frames), np.concatenate(truth))
        out[name] = (ap, auc, ap_auc(np.array(tops), videos)[1])
    return out


def test_report(spark):
    want = report()
    for r in three_method_report(spark, SF).collect():
        assert (r.frame_ap, r.frame_auc) == pytest.approx(want[r.method][:2], abs=2e-6)
        assert r.video_auc == (None if want[r.method][2] is None else pytest.approx(want[r.method][2], abs=2e-6))


def test_spherical_kmeans(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pandas().sort_values("vec_id")
    want = prototypes(np.stack(t[t.label >= 5].embedding.to_list()).astype(np.float64), 5, 20)
    got = np.zeros_like(want)
    for r in spherical_kmeans(spark, SF).collect():
        got[r.k, r.dim] = r.x
    assert got == pytest.approx(want, abs=1e-4)
