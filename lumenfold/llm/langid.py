"""Language identification: a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in windows, forwards and backwards, and gives every byte a
probability for each language; a document's probabilities are the means over its bytes.
It is trained in numpy by backpropagation through time, with a label at every position.

Defined results: a null text, and one without a letter, is ``und`` with score 0; extra
columns of the input are ignored by the model; repeated rows are scored alike, and are one
training document; an empty training set gives a model that knows no language, and every row
is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.arrow import map_rows
from lumenfold.llm.names import Working, col

PAD = 256
UNKNOWN = "und"


@dataclass(frozen=True)
class LangConfig:
    hidden: int = 8
    window: int = 64
    #: Training bounds: languages learned, those with most documents; documents of a language, and
    #: pieces of each, that the driver gets at most.
    most_langs: int = 256
    docs_per_lang: int = 300
    pieces_per_doc: int = 8
    piece_chars: int = 56
    steps: int = 160
    batch: int = 160
    rate: float = 0.02
    seed: int = 7


@dataclass
class ByteBiGRU:
    """Weights; axis 0 is the direction.  Gates are in the order update, reset, candidate."""

    langs: list[str]
    e: np.ndarray  # (2, 257, 3h) input weights, biases included
    u: np.ndarray  # (2, h, 3h)
    w: np.ndarray  # (2, h, c)
    b: np.ndarray  # (c,)
    losses: list[float] = field(default_factory=list)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def windows_of(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, width) byte ids padded with PAD, and the windows that each text has."""
    counts = np.array([-(-len(t) // width) for t in texts], dtype=np.int64)
    out = np.full((int(counts.sum()), width), PAD, dtype=np.uint16)
    flat = out.reshape(-1)
    at = 0
    for t, n in zip(texts, counts, strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, dtype=np.uint8)
        at += int(n) * width
    return out, counts


def train(pieces: list[tuple[str, bytes]], cfg: LangConfig) -> ByteBiGRU:
    """Backpropagation through time with Adam over (language, bytes) pieces."""
    rng = np.random.default_rng(cfg.seed)
    langs = sorted({k for k, _ in pieces})
    h, c = cfg.hidden, max(1, len(langs))
    net = ByteBiGRU(
        langs,
        rng.normal(0, 0.3, (2, 257, 3 * h)).astype(np.float32),
        rng.normal(0, 0.5 / np.sqrt(h), (2, h, 3 * h)).astype(np.float32),
        rng.normal(0, 1 / np.sqrt(2 * h), (2, h, c)).astype(np.float32),
        np.zeros(c, dtype=np.float32),
    )
    if len(langs) < 2:
        return net
    width = cfg.window
    x, y = [], []
    for lang, piece in pieces:
        got, _ = windows_of([piece], width)
        x.append(got)
        y += [langs.index(lang)] * len(got)
    x, y = np.concatenate(x), np.array(y)
    groups = [np.flatnonzero(y == k) for k in range(c)]
    params = [net.e, net.u, net.w, net.b]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, cfg.steps + 1):
        pick = np.concatenate([rng.choice(g, max(1, cfg.batch // c)) for g in groups])
        loss, grads = _loss_and_grads(net, x[pick], y[pick])
        net.losses.append(loss)
        rate = cfg.rate * (1 - step / (cfg.steps + 1))
        for p, g, a, b in zip(params, grads, m1, m2, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return net


def _loss_and_grads(net: ByteBiGRU, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    n, width = x.shape
    h = net.u.shape[1]
    both = np.stack([x, x[:, ::-1]])  # (2, n, width)
    inputs = np.stack([net.e[d][both[d]] for d in (0, 1)])  # (2, n, width, 3h)
    states = np.zeros((width + 1, 2, n, h), dtype=np.float32)
    kept = []
    for t in range(width):
        prev = states[t]
        g = prev @ net.u
        a = inputs[:, :, t]
        zr = _sigmoid(a[..., : 2 * h] + g[..., : 2 * h])
        z, r, q = zr[..., :h], zr[..., h:], g[..., 2 * h :]
        cand = np.tanh(a[..., 2 * h :] + r * q)
        states[t + 1] = cand + z * (prev - cand)
        kept.append((z, r, q, cand))
    forward, backward = states[1:, 0], states[1:, 1][::-1]  # (width, n, h), both by position
    logits = forward @ net.w[0] + backward @ net.w[1] + net.b
    logits -= logits.max(-1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(-1, keepdims=True)
    real = (x.T != PAD).astype(np.float32)
    total = max(1.0, float(real.sum()))
    at_y = np.take_along_axis(p, np.broadcast_to(y[None, :, None], (width, n, 1)), 2)[..., 0]
    loss = float(-(np.log(at_y + 1e-12) * real).sum() / total)
    d = p.copy()
    d[:, np.arange(n), y] -= 1
    d *= (real / total)[..., None]
    flat = d.reshape(-1, d.shape[-1])
    grad_w = np.stack([forward.reshape(-1, h).T @ flat, backward.reshape(-1, h).T @ flat])
    d_state = np.stack([d @ net.w[0].T, (d @ net.w[1].T)[::-1]], axis=1)  # (width, 2, n, h)
    d_in = np.empty_like(inputs)
    grad_u = np.zeros_like(net.u)
    carried = np.zeros((2, n, h), dtype=np.float32)
    for t in range(width - 1, -1, -1):
        z, r, q, cand = kept[t]
        prev = states[t]
        dh = d_state[t] + carried
        d_cand = dh * (1 - z) * (1 - cand * cand)
        dz = dh * (prev - cand) * z * (1 - z)
        dr = d_cand * q * r * (1 - r)
        dg = np.concatenate([dz, dr, d_cand * r], axis=-1)
        d_in[:, :, t] = np.concatenate([dz, dr, d_cand], axis=-1)
        grad_u += prev.transpose(0, 2, 1) @ dg
        carried = dh * z + dg @ net.u.transpose(0, 2, 1)
    grad_e = np.zeros_like(net.e)
    for k in (0, 1):
        ids = both[k].reshape(-1)
        order = np.argsort(ids, kind="stable")
        ordered = ids[order]
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        grad_e[k][ordered[starts]] = np.add.reduceat(d_in[k].reshape(-1, 3 * h)[order], starts, axis=0)
    grads = [grad_e, grad_u, grad_w, d.sum((0, 1))]
    norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
    return loss, [g * np.float32(min(1.0, 1.0 / (norm + 1e-9))) for g in grads]


class Labeller:
    """Labels the bytes of many texts at once; windows lie along the last axis of each array."""

    def __init__(self, net: ByteBiGRU, width: int, block: int = 4096):
        self.net, self.width, self.block = net, width, block
        self.h = net.u.shape[1]
        self.e = [np.ascontiguousarray(net.e[d].T) for d in (0, 1)]
        self.u = [np.ascontiguousarray(net.u[d].T) for d in (0, 1)]
        self.w = [np.ascontiguousarray(net.w[d].T) for d in (0, 1)]

    def _pass(self, d: int, x: np.ndarray, logits: np.ndarray) -> None:
        h, n = self.h, x.shape[1]
        state = np.zeros((h, n), dtype=np.float32)
        a = np.empty((3 * h, n), dtype=np.float32)
        g = np.empty((3 * h, n), dtype=np.float32)
        zr, cand = a[: 2 * h], a[2 * h :]
        for t in range(self.width) if d == 0 else range(self.width - 1, -1, -1):
            np.take(self.e[d], x[t], axis=1, out=a, mode="clip")
            np.matmul(self.u[d], state, out=g)
            np.add(zr, g[: 2 * h], out=zr)
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            np.add(zr, 1, out=zr)
            np.reciprocal(zr, out=zr)
            q = g[2 * h :]
            np.multiply(q, zr[h:], out=q)
            np.add(cand, q, out=cand)
            np.tanh(cand, out=cand)
            np.subtract(state, cand, out=state)
            np.multiply(state, zr[:h], out=state)
            np.add(state, cand, out=state)
            logits[t] += self.w[d] @ state

    def documents(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) mean probabilities, and the positions labelled with each language."""
        c = len(self.net.langs)
        sums, votes = np.zeros((len(texts), c)), np.zeros((len(texts), c), dtype=np.int64)
        x, counts = windows_of(texts, self.width)
        owner = np.repeat(np.arange(len(texts)), counts)
        for at in range(0, len(x), self.block):
            part = np.ascontiguousarray(x[at : at + self.block].T)
            logits = np.empty((self.width, c, part.shape[1]), dtype=np.float32)
            logits[:] = self.net.b[None, :, None]
            self._pass(0, part, logits)
            self._pass(1, part, logits)
            real = part != PAD
            top = logits.max(1, keepdims=True)
            is_top = ((logits == top) & real[:, None, :]).sum(0)
            np.subtract(logits, top, out=logits)
            np.exp(logits, out=logits)
            logits *= (real / logits.sum(1))[:, None, :]
            p = logits.sum(0, dtype=np.float64)
            own = owner[at : at + self.block]
            for k in range(c):
                sums[:, k] += np.bincount(own, p[k], len(texts))
                votes[:, k] += np.bincount(own, is_top[k], len(texts)).astype(np.int64)
        lengths = np.array([max(1, len(t)) for t in texts])
        return sums / lengths[:, None], votes


def training_pieces(docs: DataFrame, cfg: LangConfig, text: str, lang: str, key: str) -> list[tuple[str, bytes]]:
    """A bounded sample: up to docs_per_lang documents of each language, chosen by a hash of key
    and text, and from each of them pieces at hashed places all over the text."""
    usable = docs.select(col(lang).alias("lang"), col(key).alias("key"), col(text).alias("text")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    totals = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).orderBy(F.desc("docs"), "lang").limit(cfg.most_langs)
    drawn = usable.join(F.broadcast(totals), "lang").withColumn("draw", F.pmod(F.xxhash64(F.lit(cfg.seed), "key", "text"), F.lit(1 << 30)))
    # Copies have one draw and count once, so that no text fills the sample.
    some = drawn.where(F.col("draw") < F.lit(float(cfg.docs_per_lang << 30)) / F.col("docs"))
    spare = F.greatest(F.lit(1), F.length("text") - cfg.piece_chars + 1)
    pieces = F.transform(
        F.sequence(F.lit(1), F.lit(cfg.pieces_per_doc)),
        lambda k: F.col("text").substr((F.pmod(F.xxhash64("draw", k), spare) + 1).cast("int"), F.lit(cfg.piece_chars)),
    )
    chosen = some.select("lang", "draw", pieces.alias("pieces")).groupBy("lang", "draw").agg(F.min("pieces").alias("pieces"))
    out: list[tuple[str, bytes]] = []
    taken: dict[str, int] = {}
    for row in sorted(chosen.collect(), key=lambda r: (r["draw"], r["lang"])):
        if (n := taken.get(row["lang"], 0)) < cfg.docs_per_lang:
            taken[row["lang"]] = n + 1
            out += [(row["lang"], p.encode()) for p in dict.fromkeys(row["pieces"]) if p]
    return out


def fit(docs: DataFrame, cfg: LangConfig | None = None, *, text: str = "text", lang: str = "lang", key: str = "doc_id") -> ByteBiGRU:
    cfg = cfg or LangConfig()
    return train(training_pieces(docs, cfg, text, lang, key), cfg)


def predict(docs: DataFrame, net: ByteBiGRU, cfg: LangConfig | None = None, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with lang_pred, score, n_bytes and top_bytes (bytes labelled lang_pred).

    The whole text is read.  The weights (about 60 kB, whatever the data) travel with the task.
    """
    cfg = cfg or LangConfig()
    keep = keep or ["doc_id"]
    w = Working(keep)
    frame = docs.select(*[col(c) for c in keep], F.when(col(text).rlike(r"\p{L}"), col(text)).alias(w.text))

    def make():
        labeller = Labeller(net, cfg.window)

        def block(columns: list[list]) -> list[list]:
            texts = [(t or "").encode() for t in columns[0]]
            if len(net.langs) < 1:
                best, means, votes = np.full(len(texts), -1), None, None
            else:
                means, votes = labeller.documents(texts)
                best = means.argmax(1)
            langs, scores, tops = [], [], []
            for i, (t, k) in enumerate(zip(texts, best, strict=True)):
                known = bool(t) and k >= 0
                langs.append(net.langs[k] if known else UNKNOWN)
                scores.append(min(1.0, float(means[i, k])) if known else 0.0)
                tops.append(int(votes[i, k]) if known else 0)
            return [langs, scores, [len(t) for t in texts], tops]

        return block

    return map_rows(frame, [w.text], "lang_pred string, score double, n_bytes long, top_bytes long", make, keep=keep)
