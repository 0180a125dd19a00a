"""A character-level bidirectional LSTM with CRF transitions, in numpy: training and batched decoding."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

#: Kinds of spans; the tags are O, then B and I of each kind.
KINDS = ("email", "phone", "id_number", "address", "name")
TAGS = 1 + 2 * len(KINDS)
#: Character codes: printable ASCII, then classes of all other characters.
_ASCII = 95
PAD, NEWLINE, SPACE, CJK, LETTER, UPPER, DIGIT, PUNCT, OTHER, SURNAME = range(_ASCII, _ASCII + 10)
CODES = _ASCII + 10
EMBED, HIDDEN = 24, 40
#: The most frequent Chinese family names, which have a code of their own.
FAMILY_NAMES = frozenset("王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范石廖贾夏韦付方邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严武戴莫孔向汤")


@lru_cache(maxsize=1 << 16)
def code(c: str) -> int:
    """The code of a character; accented Latin letters have that of their base letter."""
    o = ord(c)
    if 32 <= o < 127:
        return o - 32
    if c in "\n\r  ":
        return NEWLINE
    if c.isspace():
        return SPACE
    base = unicodedata.normalize("NFD", c)[0]
    if 32 <= ord(base) < 127:
        return ord(base) - 32
    if c.isalpha():
        return SURNAME if c in FAMILY_NAMES else CJK if 0x2E80 <= o < 0xA000 or 0xAC00 <= o < 0xD7B0 else UPPER if c.isupper() else LETTER
    return DIGIT if c.isnumeric() else PUNCT if unicodedata.category(c)[0] == "P" else OTHER


_TABLE = np.full(0x3000, OTHER, np.uint8)
_TABLE[:] = [code(chr(i)) for i in range(0x3000)]


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _TABLE[np.minimum(points, 0x2FFF)]
    high = points >= 0x3000
    if high.any():
        out[high] = [code(chr(p)) for p in points[high]]
    return out


def new_weights(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {"emb": rng.normal(0, 0.3, (CODES, EMBED))}
    for d in "fb":
        w |= {f"w{d}": rng.normal(0, EMBED**-0.5, (EMBED, 4 * HIDDEN)), f"u{d}": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)), f"b{d}": np.zeros(4 * HIDDEN)}
        w[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1
    w |= {"out": rng.normal(0, 0.1, (2 * HIDDEN, TAGS)), "bias": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS)), "start": np.zeros(TAGS)}
    return {k: v.astype(np.float32) for k, v in w.items()}


def allowed() -> np.ndarray:
    """Which tag may follow which: I only after B or I of its kind."""
    ok = np.ones((TAGS, TAGS), bool)
    for i in range(2, TAGS, 2):
        ok[:, i] = False
        ok[i - 1, i] = ok[i, i] = True
    return ok


def _run(x: np.ndarray, u: np.ndarray, keep: bool):
    """LSTM over (T, B, 4H) inputs; gates in order i, f, o, g. States of all steps, with gates if ``keep``."""
    t, b, _ = x.shape
    h, c = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
    hs = np.empty((t, b, HIDDEN), np.float32)
    gates, cells = (np.empty_like(x), np.empty((t, b, HIDDEN), np.float32)) if keep else (None, None)
    z = np.empty((b, 4 * HIDDEN), np.float32)
    scale = np.full(4 * HIDDEN, 0.5, np.float32)
    scale[3 * HIDDEN :] = 1
    us = u * scale
    for k in range(t):
        np.dot(h, us, out=z)
        z += x[k] * scale
        np.tanh(z, out=z)
        s = z[:, : 3 * HIDDEN]
        s *= 0.5
        s += 0.5
        c = c * z[:, HIDDEN : 2 * HIDDEN] + z[:, :HIDDEN] * z[:, 3 * HIDDEN :]
        h = z[:, 2 * HIDDEN : 3 * HIDDEN] * np.tanh(c)
        hs[k] = h
        if keep:
            gates[k], cells[k] = z, c
    return hs, gates, cells


def _back(dh_all, x, u, gates, cells, hs):
    """Gradients of inputs and recurrent weights."""
    t, b, _ = x.shape
    dx, du = np.empty_like(x), np.zeros_like(u)
    dh, dc = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
    for k in range(t - 1, -1, -1):
        i, f, o, g = np.split(gates[k], 4, axis=1)
        tc = np.tanh(cells[k])
        dh = dh + dh_all[k]
        dc = dc + dh * o * (1 - tc * tc)
        before = cells[k - 1] if k else 0.0
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dx[k] = dz
        if k:
            du += hs[k - 1].T @ dz
        dh, dc = dz @ u.T, dc * f
    return dx, du


def emissions(w: dict, codes: np.ndarray) -> np.ndarray:
    """(T, B, TAGS) scores of (T, B) codes. Inputs are looked up step by step and states leave as scores, so what a
    step touches stays in the cache."""
    t, b = codes.shape
    e = np.empty((t, b, TAGS), np.float32)
    e[:] = w["bias"]
    scale = np.full(4 * HIDDEN, 0.5, np.float32)
    scale[3 * HIDDEN :] = 1
    z, part, x = np.empty((b, 4 * HIDDEN), np.float32), np.empty((b, TAGS), np.float32), np.empty((b, 4 * HIDDEN), np.float32)
    ig, tc = np.empty((b, HIDDEN), np.float32), np.empty((b, HIDDEN), np.float32)
    for n, d in enumerate("fb"):
        table = ((w["emb"] @ w[f"w{d}"] + w[f"b{d}"]) * scale).astype(np.float32)
        u, out = np.ascontiguousarray(w[f"u{d}"] * scale), np.ascontiguousarray(w["out"][n * HIDDEN : (n + 1) * HIDDEN])
        h, c = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            np.dot(h, u, out=z)
            np.take(table, codes[k], axis=0, out=x, mode="clip")
            z += x
            np.tanh(z, out=z)
            gates = z[:, : 3 * HIDDEN]
            gates *= 0.5
            gates += 0.5
            np.multiply(z[:, :HIDDEN], z[:, 3 * HIDDEN :], out=ig)
            c *= z[:, HIDDEN : 2 * HIDDEN]
            c += ig
            np.tanh(c, out=tc)
            np.multiply(z[:, 2 * HIDDEN : 3 * HIDDEN], tc, out=h)
            np.dot(h, out, out=part)
            e[k] += part
    return e


def loss_and_gradients(w: dict, codes: np.ndarray, tags: np.ndarray, mask: np.ndarray):
    """Negative log-likelihood per sequence of (T, B) arrays; ``mask`` is 1 up to each sequence's end."""
    t, b = codes.shape
    x = w["emb"][codes]
    runs, sides = {}, []
    for d in "fb":
        xi = x if d == "f" else x[::-1]
        z = xi @ w[f"w{d}"] + w[f"b{d}"]
        runs[d] = (z, *_run(z, w[f"u{d}"], True))
        sides.append(runs[d][1] if d == "f" else runs[d][1][::-1])
    hid = np.concatenate(sides, axis=2)
    e = hid @ w["out"] + w["bias"]
    tr = np.where(allowed(), w["trans"], -1e4).astype(np.float32)
    st = w["start"].copy()
    st[2::2] = -1e4
    m = mask.astype(np.float32)
    alpha = np.empty_like(e)
    alpha[0] = st + e[0]
    lse = lambda v, axis: (mx := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - mx).sum(axis))
    for k in range(1, t):
        a = lse(alpha[k - 1][:, :, None] + tr[None], 1) + e[k]
        alpha[k] = np.where(m[k][:, None] > 0, a, alpha[k - 1])
    z = lse(alpha[-1], 1)
    beta = np.zeros_like(e)
    g_tr, r = np.zeros_like(tr), np.arange(b)
    for k in range(t - 2, -1, -1):
        v = tr[None] + (e[k + 1] + beta[k + 1])[:, None, :]
        beta[k] = np.where(m[k + 1][:, None] > 0, lse(v, 2), 0)
        p = np.exp(alpha[k][:, :, None] + v - z[:, None, None]) * m[k + 1][:, None, None]
        g_tr += p.sum(0)
    post = np.exp(alpha + beta - z[None, :, None]) * m[:, :, None]
    gold = np.zeros_like(post)
    gold[np.arange(t)[:, None], r[None], tags] = m
    score = (e[np.arange(t)[:, None], r[None], tags] * m).sum() + st[tags[0]].sum() + (tr[tags[:-1], tags[1:]] * m[1:]).sum()
    np.add.at(g_tr, (tags[:-1].ravel(), tags[1:].ravel()), -m[1:].ravel())
    de = (post - gold) / b
    g = {"trans": np.where(allowed(), g_tr, 0) / b, "start": de[0].sum(0) * (np.arange(TAGS) % 2 | (np.arange(TAGS) == 0)), "out": np.einsum("tbh,tbk->hk", hid, de), "bias": de.sum((0, 1))}
    dhid, demb = de @ w["out"].T, np.zeros_like(w["emb"])
    for n, d in enumerate("fb"):
        part = dhid[:, :, n * HIDDEN : (n + 1) * HIDDEN]
        zx, hs, gates, cells = runs[d]
        dz, g[f"u{d}"] = _back(part if d == "f" else part[::-1], zx, w[f"u{d}"], gates, cells, hs)
        xi = x if d == "f" else x[::-1]
        g[f"w{d}"], g[f"b{d}"] = np.einsum("tbe,tbk->ek", xi, dz, optimize=True), dz.sum((0, 1))
        dx = dz @ w[f"w{d}"].T
        np.add.at(demb, (codes if d == "f" else codes[::-1]).ravel(), dx.reshape(-1, EMBED))
    g["emb"] = demb
    return float(z.sum() - score) / b, g


def train(w: dict, steps: int, gradients, rate: float = 6e-3, report=None) -> dict:
    """Adam with gradient clipping and a linear decay of the rate; ``gradients`` gives loss and gradients at weights."""
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        loss, g = gradients(w)
        norm = float(np.sqrt(sum(float((x * x).sum()) for x in g.values())))
        lr = rate * max(0.03, 1 - step / steps)
        for k in w:
            x = (g[k] * min(1.0, 5.0 / (norm + 1e-9))).astype(np.float32)
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.999 * v[k] + 0.001 * x * x
            w[k] = (w[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        if report:
            report(step, loss)
    return w


def viterbi(w: dict, e: np.ndarray) -> np.ndarray:
    """Best tags (T, B) of (T, B, TAGS) emissions."""
    t, b, _ = e.shape
    tr = np.where(allowed(), w["trans"], -1e4).astype(np.float32)
    st = w["start"].copy()
    st[2::2] = -1e4
    back = np.empty((t, b, TAGS), np.int8)
    at = st + e[0]
    for k in range(1, t):
        s = at[:, :, None] + tr[None]
        back[k] = s.argmax(1)
        at = np.take_along_axis(s, back[k][:, None, :].astype(np.int64), 1)[:, 0] + e[k]
    out = np.empty((t, b), np.int8)
    out[-1] = at.argmax(1)
    for k in range(t - 1, 0, -1):
        out[k - 1] = back[k][np.arange(b), out[k]]
    return out


def certain(w: dict, e: np.ndarray) -> np.ndarray:
    """Which sequences surely have O throughout as best path: no span, followed from its first tag on, ever scores as
    much as O would. One small pass over bounds of the scores instead of the search."""
    tr = np.where(allowed(), w["trans"], -1e4) - w["trans"][0, 0]
    first, more = np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)
    enter, onward, join = tr[0, first], tr[first, more], tr[more, more]
    jump, leave = float(tr[1:][:, first].max()), max(float(tr[1:, 0].max()), 0.0)
    lead = e[:, :, 1:] - e[:, :, :1]
    begin, inside = lead[:, :, 0::2], lead[:, :, 1::2]
    b = begin[0] + (w["start"][first] - w["start"][0])
    i = np.full_like(b, -1e4)
    most = b.max(1)
    top = most.copy()
    for k in range(1, len(e)):
        i = inside[k] + np.maximum(b + onward, i + join)
        b = begin[k] + np.maximum(enter, (top + jump)[:, None])
        top = np.maximum(b, i).max(1)
        np.maximum(most, top, out=most)
    return most + leave < 0


def decode(w: dict, codes: np.ndarray) -> np.ndarray:
    """Best tags (T, B) of (T, B) codes; sequences that are certain to be all O skip the search."""
    e = emissions(w, codes)
    e[codes == PAD] = np.where(np.arange(TAGS) == 0, 0, -50)  # nothing lies beyond the end
    open_ = np.nonzero(~certain(w, e))[0]
    out = np.zeros(codes.shape, np.int8)
    if len(open_):
        out[:, open_] = viterbi(w, np.ascontiguousarray(e[:, open_]))
    return out
