"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)),
so that all pairwise interactions cost time linear in the number of features.

Features of a whole text: its words, hashed into ``buckets``; statistics of its structure
(cases, digits, symbols, repeats, line shapes); and the metadata column ``n_chars``
(magnitude, and whether it agrees with the text).

Defined results: a null or empty text is scored from its metadata and structure slots
alone; repeated rows get equal scores; without training labels every score is 0.5; of several
texts under a labelled key the least is learned from; keys are of any ordered type.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.arrow import map_rows
from lumenfold.llm.names import Working, col

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_STOPS = np.zeros(256, dtype=bool)
_STOPS[[ord(c) for c in ".,;:?'\"()-"]] = True
_SIGNS = np.zeros(256, dtype=bool)
_SIGNS[33:127] = True
_SIGNS &= ~(_UPPER | _LOWER | _DIGIT | _STOPS)
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")

STRUCTURE = (
    "bias", "upper", "lower", "digit", "sign", "stop", "wide", "bang", "bar", "unique_words", "top_word",
    "word_length", "line_words", "dup_lines", "few_words", "many_words", "caps_words", "echoes", "chars_off", "chars_null",
)
MAGNITUDES = 24


@dataclass(frozen=True)
class FMConfig:
    buckets: int = 1 << 14
    rank: int = 6
    #: Training bound: labelled documents whose features the driver gets at most.
    max_labelled: int = 4000
    #: The words of a document count for so much against its structure.
    word_weight: float = 0.5
    #: Passes over the sample; small samples get more, until there are ``least_steps``.
    epochs: int = 12
    least_steps: int = 300
    batch: int = 128
    rate: float = 0.03
    decay: float = 1e-4
    seed: int = 11


@dataclass
class FM:
    w0: float
    w: np.ndarray
    v: np.ndarray


class Features:
    """Sparse features of a text: (slots, values)."""

    def __init__(self, cfg: FMConfig):
        self.cfg = cfg
        self.slots: dict[str, int] = {}

    def size(self) -> int:
        return self.cfg.buckets + len(STRUCTURE) + MAGNITUDES

    def _slot(self, word: str) -> int:
        k = self.slots.get(word)
        if k is None:
            if len(self.slots) > 50_000:
                self.slots.clear()
            k = self.slots[word] = zlib.crc32(word.encode()) % self.cfg.buckets
        return k

    def of(self, text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        data = text.encode()
        by_byte = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
        words = _WORDS.findall(text)
        counts = Counter(words)
        lines = [x for x in text.split("\n") if x.strip()]
        n, m = max(1, len(words)), max(1, int(by_byte.sum() - by_byte[_SPACE].sum()))
        some = int(by_byte[33:].sum() > 0)
        top = max(counts.values(), default=0)
        stats = [
            1.0,
            by_byte[_UPPER].sum() / m,
            by_byte[_LOWER].sum() / m,
            by_byte[_DIGIT].sum() / m,
            min(1.0, 4 * by_byte[_SIGNS].sum() / m),
            min(1.0, 4 * by_byte[_STOPS].sum() / m),
            by_byte[128:].sum() / m,
            min(1.0, by_byte[33] / n),
            min(1.0, by_byte[124] / n),
            len(counts) / n,
            (top / n) if len(words) >= 5 else 0.0,
            min(2.0, m / n / 10),
            min(1.0, n / max(1, len(lines)) / 100),
            1 - len(set(lines)) / max(1, len(lines)),
            float(len(words) < 10),
            min(1.0, len(words) / 5000),
            some * sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / n,
            sum(map(eq, words, words[1:])) / n,
            float(n_chars is not None and n_chars != len(text)),
            float(n_chars is None),
        ]
        k = self.cfg.buckets
        slot = self._slot
        ids = np.fromiter((slot(w) for w in counts), dtype=np.int64, count=len(counts))
        x = np.sqrt(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
        ids, inverse = np.unique(ids, return_inverse=True)
        x = np.bincount(inverse, x, len(ids)) if len(ids) else x
        x *= self.cfg.word_weight / max(1e-9, float(np.sqrt((x * x).sum())))
        extra = np.arange(len(STRUCTURE)) + k
        magnitude = k + len(STRUCTURE) + min(MAGNITUDES - 1, int(max(0, n_chars or 0)).bit_length())
        return np.concatenate([ids, extra, [magnitude]]), np.concatenate([x, stats, [0.5]])


def _pad(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.concatenate([r[0] for r in rows]).astype(np.int64)
    x = np.concatenate([r[1] for r in rows]).astype(np.float64)
    starts = np.r_[0, np.cumsum([len(r[0]) for r in rows])[:-1]]
    return ids, x, starts


def raw_scores(fm: FM, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Scores of rows by the sum-of-squares identity; each has the bias slot, so none is empty."""
    ids, x, starts = _pad(rows)
    vx = fm.v[ids] * x[:, None]
    total, squares = np.add.reduceat(vx, starts, axis=0), np.add.reduceat(vx * vx, starts, axis=0)
    return fm.w0 + np.add.reduceat(fm.w[ids] * x, starts) + 0.5 * (total * total - squares).sum(1)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, cfg: FMConfig) -> FM:
    """Logistic loss, Adam over the touched slots."""
    rng = np.random.default_rng(cfg.seed)
    fm = FM(0.0, np.zeros(size), rng.normal(0, 0.05, (size, cfg.rank)))
    if not len(rows):
        return FM(0.0, fm.w, np.zeros_like(fm.v))
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    fm.w0 = float(np.log(share / (1 - share)))
    m1, m2 = np.zeros((size, cfg.rank + 1)), np.full((size, cfg.rank + 1), 1e-8)
    epochs = max(cfg.epochs, -(-cfg.least_steps // -(-len(rows) // cfg.batch)))
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        rate = cfg.rate * (1 - epoch / epochs)
        for at in range(0, len(order), cfg.batch):
            pick = order[at : at + cfg.batch]
            ids, x, starts = _pad([rows[i] for i in pick])
            lengths = np.diff(np.r_[starts, len(ids)])
            vx = fm.v[ids] * x[:, None]
            total = np.add.reduceat(vx, starts, axis=0)
            raw = fm.w0 + np.add.reduceat(fm.w[ids] * x, starts) + 0.5 * (total**2 - np.add.reduceat(vx * vx, starts, axis=0)).sum(1)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[pick]) / len(pick)
            each = np.repeat(error, lengths)
            grad_v = each[:, None] * (x[:, None] * np.repeat(total, lengths, axis=0) - vx * x[:, None])
            touched, inverse = np.unique(ids, return_inverse=True)
            grads = np.zeros((len(touched), cfg.rank + 1))
            grads[:, 0] = np.bincount(inverse, each * x, len(touched))
            for f in range(cfg.rank):
                grads[:, f + 1] = np.bincount(inverse, grad_v[:, f], len(touched))
            now = np.concatenate([fm.w[touched, None], fm.v[touched]], axis=1)
            grads += cfg.decay * now
            m1[touched] += 0.1 * (grads - m1[touched])
            m2[touched] += 0.02 * (grads * grads - m2[touched])
            now -= rate * m1[touched] / (np.sqrt(m2[touched]) + 1e-6)
            fm.w[touched], fm.v[touched] = now[:, 0], now[:, 1:]
            fm.w0 -= rate * float(error.sum())
    return fm


def fit(docs: DataFrame, labels: DataFrame, cfg: FMConfig | None = None, *, text: str = "text", key: str = "doc_id", label: str = "quality") -> FM:
    """Train on at most ``max_labelled`` labelled documents, chosen by a hash of their key.

    Only keys and labels are broadcast for the lookup, a number bounded by ``max_labelled``;
    texts become sparse features on the executors, and those come to the driver.
    """
    cfg = cfg or FMConfig()
    usable = labels.where(col(label).isNotNull() & col(key).isNotNull()).select(col(key).alias("key"), col(label).cast("int").alias("label"))
    chosen = usable.groupBy("key").agg(F.max("label").alias("label")).orderBy(F.xxhash64(F.lit(cfg.seed), "key"), "key").limit(cfg.max_labelled)
    features = Features(cfg)
    met = docs.select(col(key).alias("key"), col(text).alias("text"), F.col("n_chars").cast("long").alias("n")).join(F.broadcast(chosen), "key")
    found = met.groupBy("key", "label").agg(F.min(F.struct("text", "n")).alias("one")).select("key", "label", "one.text", "one.n")

    def make():
        own = Features(cfg)

        def block(columns: list[list]) -> list[list]:
            got = [own.of(t, n) for t, n in zip(*columns, strict=True)]
            return [[g[0].tolist() for g in got], [g[1].tolist() for g in got]]

        return block

    rows = sorted(map_rows(found, ["text", "n"], "ids array<int>, x array<double>", make, keep=["key", "label"]).collect(), key=lambda r: r["key"])
    got = [(np.array(r["ids"], dtype=np.int64), np.array(r["x"])) for r in rows]
    return train(got, np.array([r["label"] for r in rows], dtype=float), features.size(), cfg)


def score(docs: DataFrame, fm: FM, cfg: FMConfig | None = None, *, text: str = "text", keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """``keep`` columns with score (0 to 1) and predicted (1 if score >= threshold)."""
    cfg = cfg or FMConfig()
    keep = keep or ["doc_id"]
    w = Working(keep)
    frame = docs.select(*[col(c) for c in keep], col(text).alias(w.text), F.col("n_chars").cast("long").alias(w.n))

    def make():
        own = Features(cfg)

        def block(columns: list[list]) -> list[list]:
            raw = raw_scores(fm, [own.of(t, n) for t, n in zip(*columns, strict=True)])
            scores = 1 / (1 + np.exp(-np.clip(raw, -40, 40)))
            return [scores.tolist(), (scores >= threshold).astype(int).tolist()]

        return block

    return map_rows(frame, [w.text, w.n], "score double, predicted int", make, keep=keep)
