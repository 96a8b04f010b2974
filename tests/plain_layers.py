"""Attention in numpy, for small graphs."""

import numpy as np


def numpy_attended(edges, xs, xd, p, attr=None):
    heads, dim = p.attend.shape
    out = np.zeros((len(xd), dim))
    hl, hr = xs @ p.left.T, xd @ p.right.T
    for i in range(len(xd)):
        mine = [n for n, (s, t) in enumerate(edges) if t == i]
        for h in range(heads):
            part = slice(h * dim, (h + 1) * dim)
            if mine:
                z = np.array([hl[edges[n][0], part] + hr[i, part] + (p.edge @ attr[n])[part] if p.edge is not None else hl[edges[n][0], part] + hr[i, part] for n in mine])
                logit = np.where(z > 0, z, 0.2 * z) @ p.attend[h]
                w = np.exp(logit - logit.max())
                out[i] += (w / w.sum()) @ hl[[edges[n][0] for n in mine], part] / heads
    return out + p.bias
