"""Near-duplicate documents by Order MinHash.

Texts become five-word shingles, each labelled with its occurrence number.  Under each of
``bands * rows`` hash functions the ``ell`` smallest labelled shingles are taken and hashed in
the order in which they stand in the text, so that a match needs the same sample in the same
order.  Rows are banded; texts that share a band are candidates.

A pair is verified by banded alignment: labelled shingles are matched one to one, matches
farther off the diagonal than a similar pair can have are ignored, and the longest run of
matches that rise in both texts is their alignment.  With a of them aligned, the similarity
is a / (n + m - a), at most the Jaccard similarity of the labelled shingles and equal to it
if the order is kept.  Pairs of at least ``threshold`` are linked; classes are the connected
components.

Hot groups: equal word sequences are one representative from the start (combined before the
shuffle); a bucket's members are first compared with its least member, in parts of ``part``
where it has many; then, in buckets that still hold several classes, members of different
classes are held against each other in blocks of ``block`` rows until their classes are joined.
No bucket's pairs are emitted, and no link between the classes of candidates is lost.

Texts stand for themselves: a representative is found by the digest of its words and numbered
by its row, and ids come in only at the end.  So texts that share an id are kept apart.

Defined results: a text without words (or null) is a class of its own and never a copy;
texts of one to four words have a single shingle; the class id is the least id in it, which may
be of any ordered type, and null only if no row of the class has one; rows that share an id but
not a text belong to the classes of their texts; of each class the row with the least id is
kept, nulls last, and of repeated rows one; other columns are ignored or, by ``keep_one``, passed through.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.arrow import map_rows
from lumenfold.llm.names import Working, col
from lumenfold.operators.components import min_labels
from lumenfold.operators.lineage import cut, written

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_U = np.uint64
#: Hash values held at a time, 256 kB of them unless a single text has more shingles.
CHUNK = 1 << 15


@dataclass(frozen=True)
class NearConfig:
    k: int = 5
    threshold: float = 0.8
    ell: int = 2
    bands: int = 16
    rows: int = 2
    #: Texts, and shingles, of a bucket that a block holds.
    block: int = 512
    block_words: int = 1 << 21
    #: Pairs with a bucket's least member that share a key.
    part: int = 256
    seed: int = 5


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def labelled_shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of hashed words, each mixed with its occurrence number."""
    w = words.astype(np.uint32).astype(np.uint64)
    n = len(w) - k + 1
    if not len(w):
        return np.zeros(0, dtype=np.uint64)
    if n < 1:
        n, k = 1, len(w)
    h = np.full(n, _U(k))
    for j in range(k):
        h = h * _U(0x9E3779B97F4A7C15) + w[j : j + n]
    h = _mix(h)
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    if new.all():
        return _mix(h)
    at = np.arange(n)
    number = np.empty(n, dtype=np.uint64)
    number[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return _mix(h + number * _U(0xD1342543DE82EF95))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = zlib.crc32(word.encode())
        return h


class Sketcher:
    def __init__(self, cfg: NearConfig):
        rng = np.random.default_rng(cfg.seed)
        m = cfg.bands * cfg.rows
        self.cfg, self.m = cfg, m
        self.xor = rng.integers(0, 1 << 63, m, dtype=np.uint64)[:, None]
        self.buffer = np.empty(CHUNK, dtype=np.uint64)
        self.mul = (rng.integers(0, 1 << 63, m, dtype=np.uint64) * _U(2) + _U(1))[:, None]

    def of(self, shingles: np.ndarray) -> np.ndarray:
        """The m ordered samples, hashed, as signed 64-bit values."""
        n, ell = len(shingles), min(self.cfg.ell, len(shingles))
        step = max(1, min(self.m, CHUNK // n))
        if self.buffer.size < step * n:
            self.buffer = np.empty(step * n, dtype=np.uint64)
        found = np.empty((self.m, ell), dtype=np.int64)
        for at in range(0, self.m, step):
            rows = min(step, self.m - at)
            v = self.buffer[: rows * n].reshape(rows, n)
            np.bitwise_xor(shingles[None, :], self.xor[at : at + rows], out=v)
            np.multiply(v, self.mul[at : at + rows], out=v)
            for j in range(ell):
                place = v.argmin(1)
                found[at : at + rows, j] = place
                if j + 1 < ell:
                    v[np.arange(rows), place] = _U(0xFFFFFFFFFFFFFFFF)
        found.sort(axis=1)
        h = np.full(self.m, _U(ell))
        for j in range(ell):
            h = h * _U(0x9E3779B97F4A7C15) + shingles[found[:, j]]
        return _mix(h).view(np.int64)


    def bands(self, shingles: np.ndarray) -> np.ndarray:
        """A hash of each band's samples and its number."""
        samples = self.of(shingles).view(np.uint64).reshape(self.cfg.bands, self.cfg.rows)
        h = np.arange(self.cfg.bands, dtype=np.uint64)
        for r in range(self.cfg.rows):
            h = _mix(h * _U(0x9E3779B97F4A7C15) + samples[:, r])
        return h.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = 0.8) -> float:
    """Ordered similarity of two arrays of labelled shingles by banded alignment.

    A pair of at least ``threshold`` aligns a shingles with n + m - 2 a <= (1 / threshold - 1) a,
    so that no aligned match is farther off the diagonal than (1 / threshold - 1) min(n, m).
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(at_a - at_b) <= (1 / threshold - 1) * min(n, m) + 1
    at_a, at_b = at_a[near], at_b[near]
    if len(at_a) < threshold * (n + m - len(at_a)):
        return len(at_a) / (n + m - len(at_a)) if len(at_a) else 0.0
    line = at_b[np.argsort(at_a)]
    aligned = len(line)
    if (np.diff(line) < 0).any():
        tails: list[int] = []
        for x in line.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        aligned = len(tails)
    return aligned / (n + m - aligned)


def sketches(docs: DataFrame, cfg: NearConfig, names: Working, *, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns with row, digest, n, bands and words; digest is null for a text without words.

    Rows are numbered as they are written, so that the numbers stay.
    """

    def make():
        sketcher = Sketcher(cfg)
        memory = _WordHashes()

        def block(columns: list[list]) -> list[list]:
            digests, sizes, found, hashed = [], [], [], []
            for t in columns[0]:
                words = _WORDS.findall(t or "")
                if len(memory) > 100_000:
                    memory.clear()
                w = np.fromiter(map(memory.__getitem__, words), dtype=np.uint32, count=len(words))
                digests.append(hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest() if words else None)
                sizes.append(max(1, len(words) - cfg.k + 1) if words else 0)
                found.append(sketcher.bands(labelled_shingles(w, cfg.k)) if words else None)
                hashed.append(w.view(np.int32))
            return [digests, sizes, found, hashed]

        return block

    schema = f"{names.digest} binary, {names.n} int, {names.bands} array<long>, {names.words} array<int>"
    made = map_rows(docs, [text], schema, make, keep=keep)
    return written(made.withColumn(names.row, F.monotonically_increasing_id()), "sketches")


def _alike(x: str, y: str, cfg: NearConfig) -> Column:
    """Sizes that allow the threshold."""
    return F.least(x, y) >= F.floor(F.lit(cfg.threshold) * F.greatest(x, y))


def verified(pairs: DataFrame, words: DataFrame, cfg: NearConfig) -> DataFrame:
    """Pairs (a, b, part) of at least the threshold; ``words`` has row and words of each text.

    ``a`` may be in many pairs: they are dealt to parts, and its words go to each of them.
    """
    centres = pairs.groupBy("a").agg(F.max("part").alias("last"))
    words_a = words.join(centres, words["row"] == centres["a"]).select("a", F.col("words").alias("words_a"), F.explode(F.sequence(F.lit(0), "last")).alias("part"))
    one = pairs.join(words.select(F.col("row").alias("b"), F.col("words").alias("words_b")), "b")
    two = one.join(words_a, ["a", "part"])

    def make():
        last: dict[int, np.ndarray] = {}

        def block(columns: list[list]) -> list[list]:
            out = []
            for a, wa, wb in zip(*columns, strict=True):
                if a not in last:
                    last.clear()
                    last[a] = labelled_shingles(np.array(wa, dtype=np.int32), cfg.k)
                out.append(similarity(last[a], labelled_shingles(np.array(wb, dtype=np.int32), cfg.k), cfg.threshold))
            return [out]

        return block

    return map_rows(two, ["a", "words_a", "words_b"], "sim double", make, keep=["a", "b"]).where(F.col("sim") >= cfg.threshold)


def common_counts(left: list[np.ndarray], right: list[np.ndarray], cells: int = 1 << 21) -> np.ndarray:
    """(left, right): how many values each two arrays of distinct values have in common.

    Values on both sides are columns of 0-1 matrices, ``cells`` of them at a time, and the counts
    are sums of their products, exact below 2**24.
    """
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    values = np.intersect1d(np.concatenate(left), np.concatenate(right))
    if not len(values):
        return out

    def places(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, rows = np.concatenate(arrays), np.repeat(np.arange(len(arrays)), [len(x) for x in arrays])
        columns = np.minimum(np.searchsorted(values, flat), len(values) - 1)
        met = np.flatnonzero(values[columns] == flat)
        met = met[np.argsort(columns[met], kind="stable")]
        return rows[met], columns[met]

    (rows_a, columns_a), (rows_b, columns_b) = places(left), places(right)
    width = max(64, cells // max(len(left), len(right)))
    for at in range(0, len(values), width):
        n = min(width, len(values) - at)
        parts = []
        for size, rows, columns in ((len(left), rows_a, columns_a), (len(right), rows_b, columns_b)):
            own = slice(*np.searchsorted(columns, [at, at + n]))
            x = np.zeros((size, n), dtype=np.float32)
            x[rows[own], columns[own] - at] = 1
            parts.append(x)
        out += parts[0] @ parts[1].T
    return out


def _links_between(members: DataFrame, words: DataFrame, cfg: NearConfig) -> DataFrame:
    """Links (a, b) that join different classes of a bucket, by pairs of blocks.

    Members outside a bucket's largest class (left) meet all of its members (right), so that a
    large class is not held against itself.  A pair of blocks counts the shingles that each two
    texts share, which bounds their similarity from above, and aligns those pairs that may reach
    the threshold, the most alike first, until their classes are joined there.  At most one link
    for each class comes out of a pair of blocks.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["side"].to_numpy()
        links: list[tuple[int, int]] = []
        if side.any() and not side.all():
            shingles = [labelled_shingles(np.asarray(w, dtype=np.int32), cfg.k) for w in pdf["words"]]
            at_l, at_r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            counts = common_counts([shingles[k] for k in at_l], [shingles[k] for k in at_r])
            n, ids = pdf["n"].to_numpy(), pdf["rep"].to_numpy()
            names, own = np.unique(pdf["label"].to_numpy(), return_inverse=True)
            alike = counts / (n[at_l][:, None] + n[at_r][None, :] - counts)
            x, y = np.nonzero((alike >= cfg.threshold) & (own[at_l][:, None] != own[at_r][None, :]))
            root = np.arange(len(names))
            for k in np.argsort(-alike[x, y], kind="stable"):
                i, j = at_l[x[k]], at_r[y[k]]
                if root[own[i]] != root[own[j]] and similarity(shingles[i], shingles[j], cfg.threshold) >= cfg.threshold:
                    links.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                    root[root == root[own[j]]] = root[own[i]]
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    several = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("size"))
    mixed = several.groupBy("bucket").agg(F.max(F.struct("rows", "size", "label")).alias("main"), F.sum("rows").alias("rows"), F.sum("size").alias("size")).where(F.col("rows") > F.col("main.rows"))
    blocks = lambda rows, size: F.ceil(F.greatest(rows / cfg.block, size / cfg.block_words)).cast("int")
    n_left = blocks(F.col("rows") - F.col("main.rows"), F.col("size") - F.col("main.size"))
    # Written, so that a join knows its size: a small table is broadcast, and no bucket meets in one task.
    mixed = written(mixed.select("bucket", F.col("main.label").alias("main"), blocks(F.col("rows"), F.col("size")).alias("n_right"), n_left.alias("n_left")), "mixed")
    dealt = members.join(mixed, "bucket").join(words.withColumnRenamed("row", "rep"), "rep")
    every = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    mine = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    right = every("n_left", lambda k: F.struct(k.alias("bl"), mine("n_right").alias("br"), F.lit(1).alias("side")))
    left = every("n_right", lambda k: F.struct(mine("n_left").alias("bl"), k.alias("br"), F.lit(0).alias("side")))
    to = F.when(F.col("label") != F.col("main"), F.concat(left, right)).otherwise(right)
    return dealt.select("bucket", "rep", "n", "words", "label", F.inline(to)).groupBy("bucket", "bl", "br").applyInPandas(compare, "a long, b long").distinct()


def _classes(rows: DataFrame, cfg: NearConfig) -> DataFrame:
    """(digest, class_id, kept): of each text that has copies, its class's least id and the row that stays.

    ``rows``: id, row, digest, n, bands, words.
    """
    known = rows.where(F.col("digest").isNotNull())
    first = F.struct(F.col("id").isNull().alias("anonymous"), "id", "row", "n", "bands")
    reps = known.groupBy("digest").agg(F.min(first).alias("m"), F.count(F.lit(1)).alias("copies"))
    reps = written(reps.select("digest", F.col("m.row").alias("rep"), F.struct("m.anonymous", "m.id", "m.row").alias("first"), "m.n", "m.bands", "copies"), "reps")
    keyed = reps.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("least"), F.count(F.lit(1)).alias("members")).where("members > 1")
    parts = F.ceil(F.col("members") / cfg.part).cast("int").alias("parts")
    buckets = written(keyed.join(shared, "bucket").select("bucket", "rep", "n", parts, F.col("least.rep").alias("least"), F.col("least.n").alias("least_n")), "buckets")
    pairs = buckets.where((F.col("rep") != F.col("least")) & _alike("n", "least_n", cfg)).groupBy(F.col("least").alias("a"), F.col("rep").alias("b"))
    pairs = written(pairs.agg(F.pmod(F.xxhash64("rep"), F.max("parts")).cast("int").alias("part")), "pairs")
    candidates = written(buckets.select(F.col("rep").alias("row")).distinct(), "candidates")
    words = written(rows.select("row", "words").join(candidates, "row"), "words")
    links = cut(verified(pairs, words, cfg).select("a", "b"))
    labels = min_labels(links, "a", "b")
    # Each bucket's least member has met all others, so that only those are held against each other.
    rest = buckets.where(F.col("rep") != F.col("least"))
    labelled = written(rest.join(labels, rest["rep"] == labels["id"], "left").select("bucket", "rep", "n", F.coalesce("label", "rep").alias("label")), "labelled")
    found = cut(_links_between(labelled, words, cfg))
    if found.limit(1).count():
        ends = found.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a", "left").join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b", "left")
        # Both ends of a new link now belong to one class: classes are joined by their labels.
        over = min_labels(ends.select(F.coalesce("la", "a").alias("src"), F.coalesce("lb", "b").alias("dst")).distinct())
        over = over.select(F.col("id").alias("old"), F.col("label").alias("new"))
        old = labels.select("id", "label").unionByName(ends.select(F.explode(F.array(F.when(F.col("la").isNull(), F.col("a")), F.when(F.col("lb").isNull(), F.col("b")))).alias("id")).where("id is not null").distinct().withColumn("label", F.col("id")))
        labels = old.join(over, old["label"] == over["old"], "left").select("id", F.coalesce("new", "label").alias("label"))
    linked = cut(reps.join(labels, reps["rep"] == labels["id"]).select("digest", "label", "first"))
    firsts = linked.groupBy("label").agg(F.min("first").alias("first"))
    alone = reps.where("copies > 1").join(linked, "digest", "left_anti").select("digest", "first")
    grouped = linked.select("digest", "label").join(firsts, "label").select("digest", "first").unionByName(alone)
    return written(grouped.select("digest", F.col("first.id").alias("class_id"), F.col("first.row").alias("kept")), "classes")


def classes(docs: DataFrame, cfg: NearConfig | None = None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, class_id, kept) of each row of ``docs``; one row of each class is kept."""
    cfg, names = cfg or NearConfig(), Working()
    given = docs.select(col(key).alias("id"), col(text).alias("text"))
    made = sketches(given, cfg, names, text="text", keep=["id"])
    rows = made.select("id", *[F.col(getattr(names, c)).alias(c) for c in ("row", "digest", "n", "bands", "words")])
    out = rows.select("id", "row", "digest").join(_classes(rows, cfg), "digest", "left")
    return out.select("id", F.when(F.col("kept").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce(F.col("kept") == F.col("row"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, cfg: NearConfig | None = None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class."""
    cfg, names = cfg or NearConfig(), Working(docs.columns)
    made = sketches(docs, cfg, names, text=text, keep=docs.columns)
    rows = made.select(col(key).alias("id"), *[F.col(getattr(names, c)).alias(c) for c in ("row", "digest", "n", "bands", "words")])
    grouped = _classes(rows, cfg)
    dropped = written(rows.select("row", "digest").join(grouped, "digest").where(F.col("row") != F.col("kept")).select(F.col("row").alias(names.row)), "dropped")
    return made.join(dropped, names.row, "left_anti").select(*[col(c) for c in docs.columns])
