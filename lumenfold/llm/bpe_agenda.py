"""Encoding and decoding with sentencepiece vocabularies of merge type.

A text becomes symbols, one for each character, and an agenda of adjacent pairs whose joined
text is a piece.  The pair of the highest score is merged first, the leftmost of equal ones,
until no pair is left; symbols outside the vocabulary fall back to their bytes.

No piece of such a vocabulary has a word mark after another character, so agendas of
different words never meet; a vocabulary that has one is refused.  The words of a batch that
are new to the task run their agendas together: words of a length form a matrix, one merge a
row and step, and only the pairs beside a merge are looked up again.  Words over
``LONG`` symbols use a heap.

All results are the agenda's.  Every text is also encoded by the library, a block of an Arrow
batch at a time, and a text on which the two differ is an error.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated
rows are encoded alike; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame

from lumenfold.llm.arrow import held, map_rows

MARK = "▁"
LONG = 48
#: Words of lengths up to a multiple of this share a matrix.
STEP = 4
#: Texts that the library gets at a time; it takes and gives ids as lists, ten times the size of arrays.
CHECKED = 128
#: Words that an agenda remembers in each of its two generations.
REMEMBERED = 300_000
#: Rows of a block: more than usual, so that a word new to several texts is looked up once.
BLOCK = 1024
#: Spaces stand for word marks until they are looked up.
_SEGMENTS = re.compile(" *[^ ]+| +")
NO_RANK = np.int32(2**31 - 1)


class Pairs:
    """Open-addressing table from a pair of symbols to (rank of the merge, merged symbol)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(len(left) * 4).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, dtype=np.int64)
        self.rank = np.full(size, NO_RANK, dtype=np.int32)
        self.merged = np.full(size, -1, dtype=np.int32)
        keys = left.astype(np.int64) << 32 | right
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] < 0
            first = np.unique(np.where(free, at[todo], -1 - np.arange(len(todo))), return_index=True)[1]
            put = todo[first[free[first]]]
            self.keys[at[put]], self.rank[at[put]], self.merged[at[put]] = keys[put], rank[put], merged[put]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & (size - 1)
        self.probes = 1 + int(((at - self._home(keys)) & (size - 1)).max(initial=0))

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NO_RANK if none) and merged symbol of each pair; symbols under 0 have none."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        at = self._home(keys)
        got = self.keys[at]
        for _ in range(self.probes - 1):
            miss = np.flatnonzero((got != keys) & (got >= 0))
            if not len(miss):
                break
            at[miss] = (at[miss] + 1) & (len(self.keys) - 1)
            got[miss] = self.keys[at[miss]]
        hit = got == keys
        return np.where(hit, self.rank[at], NO_RANK), np.where(hit, self.merged[at], -1)


class Agenda:
    """An encoder for a merge-type model; ``ids_of`` remembers the words that it has seen.

    Words are remembered in two generations: when the younger is full, the older is let go, so
    that frequent words stay.
    """

    def __init__(self, model_path: str, remembered: int = REMEMBERED):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2:
            raise ValueError("not a merge-type vocabulary")
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a normalizer that is not supported")
        self.prefix = spec.add_dummy_prefix
        self.remembered = remembered
        pieces = model.pieces
        if any(p.type in (4, 5) for p in pieces):
            raise ValueError("user-defined or unused pieces are not supported")
        normal = {p.piece: i for i, p in enumerate(pieces) if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece goes over the end of a word")
        self.unknown = next((i for i, p in enumerate(pieces) if p.type == 2), 0)
        self.bytes = [next((i for i, p in enumerate(pieces) if p.type == 6 and p.piece == f"<0x{b:02X}>"), -1) for b in range(256)]
        self.symbols = dict(normal)
        for p in normal:
            for c in p:
                self.symbols.setdefault(c, len(pieces) + len(self.symbols))
        self.symbols[" "] = self.symbols[MARK]
        self.n_pieces = len(pieces)
        order = {s: k for k, s in enumerate(sorted({pieces[i].score for i in normal.values()}, reverse=True))}
        rows = array("q")
        for p, i in normal.items():
            for cut in range(1, len(p)):
                a, b = self.symbols.get(p[:cut]), self.symbols.get(p[cut:])
                if a is not None and b is not None:
                    rows.extend((a, b, order[pieces[i].score], i))
        left, right, rank, merged = np.frombuffer(rows, dtype=np.int64).reshape(-1, 4).T
        self.pairs = Pairs(left, right, rank.astype(np.int32), merged.astype(np.int32))
        self._merges = left, right, rank, merged
        self.characters = np.full(0x110000, -1, dtype=np.int32)
        for c, i in self.symbols.items():
            if len(c) == 1:
                self.characters[ord(c)] = i
        self.spelled = np.array([f"{i},".encode() for i in range(self.n_pieces)])
        #: No piece goes over the end of a line, so that words are cut there too.
        self.lines = not any("\n" in p for p in normal)
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @cached_property
    def table(self) -> dict[tuple[int, int], tuple[int, int]]:
        """Rank and merged symbol of each pair, for agendas in a heap; few words need it."""
        left, right, rank, merged = (x.tolist() for x in self._merges)
        return dict(zip(zip(left, right, strict=True), zip(rank, merged, strict=True), strict=True))

    def _spell(self, symbols: list[int], starts: list[int], word: str) -> list[int]:
        out: list[int] = []
        for k, s in enumerate(symbols):
            if 0 <= s < self.n_pieces:
                out.append(s)
            else:
                raw = word[starts[k] : starts[k + 1] if k + 1 < len(starts) else len(word)].encode()
                out += [self.bytes[b] for b in raw] if self.bytes[0] >= 0 else [self.unknown]
        return out

    def one(self, word: str) -> list[int]:
        """The agenda of a single word, kept in a heap."""
        symbols = [self.symbols.get(c, -1) for c in word]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and (found := self.table.get((symbols[a], symbols[b]))):
                heapq.heappush(heap, (found[0], a, b, symbols[a], symbols[b]))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, x, y = heapq.heappop(heap)
            if not (alive[a] and alive[b] and symbols[a] == x and symbols[b] == y and after[a] == b):
                continue
            symbols[a] = self.table[x, y][1]
            alive[b] = False
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        starts = [k for k in range(n) if alive[k]]
        return self._spell([symbols[k] for k in starts], starts, word)

    def _together(self, words: list[str], length: int) -> list[bytes]:
        """Agendas of words of up to ``length`` symbols, a merge in each row at a step.

        Rows are padded at their end with symbols that are in no pair.
        """
        n = len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        real = np.arange(length) < lengths[:, None]
        s = np.full((n, length), -1, dtype=np.int32)
        s[real] = self.characters[np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")]
        starts = np.tile(np.arange(length, dtype=np.int8), (n, 1))
        rank = np.full((n, length), NO_RANK, dtype=np.int32)
        merged = np.full((n, length), -1, dtype=np.int32)
        r, m = self.pairs.find(s[:, :-1].ravel(), s[:, 1:].ravel())
        rank[:, :-1], merged[:, :-1] = r.reshape(n, length - 1), m.reshape(n, length - 1)
        live = np.arange(n)
        width = length
        done_s, done_starts = s.copy(), starts.copy()
        while len(live):
            at = rank.argmin(1)
            rows = np.arange(len(live))
            open_ = rank[rows, at] != NO_RANK
            if not open_.all():
                shut = np.flatnonzero(~open_)
                done_s[live[shut], :width], done_starts[live[shut], :width] = s[shut], starts[shut]
                keep = np.flatnonzero(open_)
                live, s, starts, rank, merged, at = live[keep], s[keep], starts[keep], rank[keep], merged[keep], at[keep]
                rows = np.arange(len(live))
                if not len(live):
                    break
            s[rows, at] = merged[rows, at]
            lengths[live] -= 1
            column = np.arange(width - 1)
            take = (rows * width)[:, None] + column + (column > at[:, None])
            s, starts, rank, merged = (x.reshape(-1).take(take) for x in (s, starts, rank, merged))
            width -= 1
            # The last pair now ends at the row's end; the pairs beside the merge are new.
            right = np.where(at + 1 < width, s[rows, np.minimum(at + 1, width - 1)], -1)
            rank[rows, at], merged[rows, at] = self.pairs.find(s[rows, at], right)
            some = np.flatnonzero(at > 0)
            if len(some):
                a = at[some]
                rank[some, a - 1], merged[some, a - 1] = self.pairs.find(s[some, a - 1], s[some, a])
        real = np.arange(length) < lengths[:, None]
        odd = np.flatnonzero((real & ((done_s < 0) | (done_s >= self.n_pieces))).any(1))
        flat, ends = done_s[real].astype("<i4").tobytes(), (4 * np.cumsum(lengths)).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        for k in odd.tolist():
            m = int(lengths[k])
            out[k] = np.array(self._spell(done_s[k, :m].tolist(), done_starts[k, :m].tolist(), words[k]), dtype="<i4").tobytes()
        return out

    def learned(self, words: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        if not words:
            return out
        whole = [" " + w if w[0] not in " \n" else w for w in words] if self.prefix else words
        sizes = np.fromiter(map(len, whole), dtype=np.int64, count=len(whole))
        sizes = np.minimum(-(-sizes // STEP) * STEP, LONG + STEP)
        order = np.argsort(sizes, kind="stable")
        lengths, starts = np.unique(sizes[order], return_index=True)
        for length, group in zip(lengths.tolist(), np.split(order, starts[1:]), strict=True):
            for at in range(0, len(group), 1 << 15):
                part = group[at : at + (1 << 15)].tolist()
                texts = [whole[k] for k in part]
                found = [np.array(self.one(t), dtype="<i4").tobytes() for t in texts] if length > LONG else self._together(texts, length)
                out.update(zip([words[k] for k in part], found, strict=True))
        return out

    def _words(self, text: str) -> list[str]:
        """Words of a text; one that stands after a single mark is named without it, and one that
        begins a line with the line's end before it."""
        if MARK in text:
            text = text.replace(MARK, " ")
        if self.prefix and text and "  " not in text and text[0] not in " \n" and text[-1] != " ":
            if "\n" not in text:
                return text.split(" ")
            if self.lines and " \n" not in text:
                return text.replace("\n", " \n").split(" ")
        return _SEGMENTS.findall((" " if self.prefix else "") + text) if text else []

    def ids_of(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        split = [self._words(t or "") for t in texts]
        new = set().union(*split)
        if len(self.memory) > self.remembered:
            self.older, self.memory = self.memory, {}
        new = new.difference(self.memory)
        if self.older:
            again = {w: self.older[w] for w in new if w in self.older}
            self.memory |= again
            new.difference_update(again)
        self.memory |= self.learned(list(new))
        get = self.memory.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), dtype="<i4") for words in split]


def _load(path: str) -> tuple[Agenda, object]:
    from sentencepiece import SentencePieceProcessor

    return Agenda(path), SentencePieceProcessor(model_file=path)


def encode_decode(
    docs: DataFrame,
    model_path: str,
    *,
    text: str = "text",
    keep: list[str] | None = None,
    with_ids: bool = False,
    remembered: int = REMEMBERED,
    rows: int = BLOCK,
) -> DataFrame:
    """``keep`` columns with n_tokens, ids_sha256 and decoded_sha256; ids if asked for.

    Fewer words ``remembered`` and ``rows`` of a block take less memory and more time; results are the same.
    Raises ValueError where the library gives other ids than the agenda.
    """
    key = ("pieces", model_path)

    def make():
        agenda, library = held(key, lambda: _load(model_path))
        agenda.remembered = remembered

        def block(columns: list[list]) -> list[list]:
            texts = [t or "" for t in columns[0]]
            found = agenda.ids_of(texts)
            decoded = []
            for at in range(0, len(texts), CHECKED):
                part, ids = texts[at : at + CHECKED], [x.tolist() for x in found[at : at + CHECKED]]
                for t, mine, theirs in zip(part, ids, library.encode(part, num_threads=1), strict=True):
                    if mine != theirs:
                        raise ValueError(f"the agenda and the library encode a text differently: {t[:200]!r}")
                decoded += [hashlib.sha256(t.encode()).hexdigest() for t in library.decode(ids, num_threads=1)]
            # The spellings are padded with zero bytes, and the last comma is too many.
            spelled = [hashlib.sha256(agenda.spelled[x].tobytes().replace(b"\0", b"")[:-1]).hexdigest() for x in found]
            return [list(map(len, found)), spelled, decoded, *([found] if with_ids else [])]

        return block

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_rows(docs, [text], schema, make, key, keep=keep or ["doc_id"], rows=rows)
