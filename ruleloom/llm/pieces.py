"""SentencePiece encoding and decoding: N-best segmentation by backward A-star under forward Viterbi scores."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Chunks up to this long are solved many at a time.
VECTOR_LENGTH = 48
#: Chunks kept in a task's memo before it is emptied: bounds its memory, not what is scored.
MEMO = 300_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


class Lattice:
    """The pieces of a model and the lattice of a text's segmentations.

    A character that is no piece makes an edge of its own, 10 below the lowest ordinary score, and is written as the
    byte pieces of its UTF-8. Pieces hold the space mark at their start only (checked), and a character that only
    occurs as a piece by itself, or in none, cannot be crossed: a text falls apart into chunks before each run of
    marks and around line breaks, and its segmentations are the products of its chunks' segmentations.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte_id, self.ids, self.scores = {}, {}, np.zeros(sp.get_piece_size())
        self.bytes: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                self.ids[piece], self.scores[i] = i, sp.get_score(i)
                self.bytes.append(piece.replace(SPACE, " ").encode())
        assert not any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in self.ids), "pieces cross chunks"
        self.longest = max(map(len, self.ids))
        self.unknown = min(s for s in (self.scores[i] for i in self.ids.values()) if s > -1e8) - 10
        self.split = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+").findall
        self._tables()

    def _tables(self) -> None:
        keys = np.array([self._hash(p) for p in self.ids], np.uint64)
        assert len(np.unique(keys)) == len(keys)
        self.keys, self.of = np.append(keys, np.uint64(0)), np.append(np.fromiter(self.ids.values(), np.int64, len(keys)), -1)
        rng = np.random.default_rng(7)
        self.table, self.mul = [], []
        left = np.arange(len(keys))
        for bits in (20, 17):
            while True:
                mul = rng.integers(0, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
                slot = (keys[left] * mul) >> np.uint64(64 - bits)
                first = np.unique(slot, return_index=True)[1]
                if bits == 20 or len(first) == len(left):
                    break
            table = np.full(1 << bits, len(keys), np.int32)
            table[slot[first]] = left[first]
            self.table.append((table, mul, np.uint64(64 - bits)))
            left = np.delete(left, first)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c)) & (2**64 - 1)
        return h

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, -1 where none."""
        (one, m1, s1), (two, m2, s2) = self.table
        at = one[(h * m1) >> s1]
        miss = self.keys[at] != h
        if miss.any():
            other = two[(h[miss] * m2) >> s2]
            at[miss] = np.where(self.keys[other] == h[miss], other, len(self.keys) - 1)
        return self.of[at]

    # -- one chunk

    def edges(self, chunk: str, end: int) -> Iterator[tuple[int, int, float]]:
        """start, piece id (or ~codepoint), score of the edges into a node, from the longest."""
        for start in range(max(0, end - self.longest), end):
            i = self.ids.get(chunk[start:end])
            if i is not None:
                yield start, i, self.scores[i]
            elif start == end - 1:
                yield start, ~ord(chunk[start]), self.unknown

    def forward(self, chunk: str) -> tuple[list[float], list[int], list[int], list[float]]:
        best, come, piece, loss = [0.0], [0], [0], [np.inf]
        for end in range(1, len(chunk) + 1):
            top, second, c, p = -np.inf, -np.inf, 0, 0
            for start, i, s in self.edges(chunk, end):
                v = best[start] + s
                if v > top:
                    top, second, c, p = v, top, start, i
                elif v > second:
                    second = v
            best.append(top), come.append(c), piece.append(p), loss.append(top - second)
        return best, come, piece, loss

    def n_best(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations (loss against the best, pieces), best first.

        Backward A-star: a hypothesis is a suffix of a path; its priority is the suffix's score plus the forward
        Viterbi score of its first node, which is exact, so paths leave the queue in order of their score.
        """
        best = self.forward(chunk)[0]
        queue, out = [(0.0, (), len(chunk), 0.0)], []
        while queue and len(out) < n:
            loss, path, node, g = heapq.heappop(queue)
            if node == 0:
                out.append((loss, path))
                continue
            for start, i, s in self.edges(chunk, node):
                heapq.heappush(queue, (best[-1] - (best[start] + s + g), (i, *path), start, g + s))
        return out

    # -- many chunks

    def solve(self, chunks: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Best pieces, score and loss of the second best (inf: none) of each chunk, by forward Viterbi."""
        pieces: list = [None] * len(chunks)
        score, loss = np.zeros(len(chunks)), np.full(len(chunks), np.inf)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(size, kind="stable")
        cuts = np.flatnonzero(np.diff(size[order])) + 1
        for group in np.split(order, cuts):
            n = int(size[group[0]]) if len(group) else 0
            for g in (group[i : i + 20_000] for i in range(0, len(group), 20_000)) if 0 < n <= VECTOR_LENGTH else ():
                self._solve(chunks, g, n, pieces, score, loss)
            if n > VECTOR_LENGTH:
                for i in group.tolist():
                    best, come, piece, lose = self.forward(chunks[i])
                    at, path, least = n, [], np.inf
                    while at:
                        least = min(least, lose[at])
                        path.append(piece[at])
                        at = come[at]
                    pieces[i], score[i], loss[i] = np.array(path[::-1], np.int64), best[-1], least
        for i, p in enumerate(pieces):
            if p is None:
                pieces[i] = np.empty(0, np.int64)
            elif len(p) and p.min() < 0:
                pieces[i] = np.array([y for x in p.tolist() for y in (self.as_bytes(x) if x < 0 else (x,))], np.int64)
        return pieces, score, loss

    def as_bytes(self, edge: int) -> list[int]:
        return [self.byte_id[b] for b in chr(~edge).encode("utf-8", "replace")]

    def _solve(self, chunks, group, n, pieces, score, loss) -> None:
        m = len(group)
        text = "".join([chunks[i] for i in group.tolist()])
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n).T.astype(np.uint64)
        h, power = [np.zeros(m, np.uint64)], [np.uint64(1)]
        for j in range(n):
            h.append(h[-1] * BASE + c[j])
        for _ in range(self.longest):
            power.append(np.uint64(int(power[-1]) * int(BASE) & (2**64 - 1)))
        scores = np.append(self.scores, -np.inf)
        best, come, piece, lose = [np.zeros(m)], [None], [None], [None]
        for j in range(1, n + 1):
            top, second = np.full(m, -np.inf), np.full(m, -np.inf)
            frm, pid = np.zeros(m, np.int64), np.zeros(m, np.int64)
            for i in range(max(0, j - self.longest), j):
                p = self.lookup(h[j] - h[i] * power[j - i])
                v = best[i] + scores[p]
                if i == j - 1 and (none := p < 0).any():
                    v = np.where(none, best[i] + self.unknown, v)
                    p = np.where(none, ~c[i].astype(np.int64), p)
                up = v > top
                second = np.where(up, top, np.maximum(second, v))
                np.copyto(top, v, where=up), np.copyto(frm, i, where=up), np.copyto(pid, p, where=up)
            with np.errstate(invalid="ignore"):
                best.append(top), come.append(frm), piece.append(pid), lose.append(top - second)
        score[group] = best[n]
        come, piece, lose = np.stack([np.zeros(m, np.int64), *come[1:]]), np.stack([np.zeros(m, np.int64), *piece[1:]]), np.stack([np.full(m, np.inf), *lose[1:]])
        at, rows, path, least = np.full(m, n), np.arange(m), [], np.full(m, np.inf)
        while (on := at > 0).any():
            path.append(np.where(on, piece[at, rows], -(2**40)))
            least = np.minimum(least, lose[at, rows])
            at = np.where(on, come[at, rows], 0)
        loss[group] = least
        path = np.stack(path[::-1], 1)
        used = path > -(2**40)
        flat, ends = path[used], np.cumsum(used.sum(1))
        for i, a, b in zip(group.tolist(), [0, *ends.tolist()], ends.tolist()):
            pieces[i] = flat[a:b]


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def merge_losses(lists: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n smallest sums of one loss from each list, and the places picked; each list starts at 0 and ascends."""
    queue, seen, out = [(0.0, (0,) * len(lists))], set(), []
    while queue and len(out) < n:
        total, picks = heapq.heappop(queue)
        out.append((total, picks))
        for k, p in enumerate(picks):
            if p + 1 < len(lists[k]) and (nxt := (*picks[:k], p + 1, *picks[k + 1 :])) not in seen:
                seen.add(nxt)
                heapq.heappush(queue, (total - lists[k][p] + lists[k][p + 1], nxt))
    return out


class Encoder:
    """Encodes texts, remembering chunks already solved."""

    def __init__(self, model: str, n_best: int):
        self.lattice, self.n = lattice(model), n_best
        self.reset()

    def reset(self) -> None:
        pending: list[str] = []

        class Memo(dict):
            def __missing__(self, chunk: str) -> int:
                self[chunk] = at = len(self)
                pending.append(chunk)
                return at

        self.memo, self.pending, self.names = Memo(), pending, []
        self.flat, self.start, self.count = np.empty(1 << 16, np.int32), np.empty(1 << 15, np.int64), np.empty(1 << 15, np.int64)
        self.score, self.loss = np.empty(1 << 15), np.empty(1 << 15)
        self.used, self.alternatives = 0, {}

    def _learn(self) -> None:
        if not self.pending:
            return
        pieces, score, loss = self.lattice.solve(self.pending)
        a, b = len(self.names), len(self.names) + len(self.pending)
        self.names += self.pending
        self.pending.clear()
        while b > len(self.start):
            self.start, self.count, self.score, self.loss = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.count, self.score, self.loss))
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        while self.used + size.sum() > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.start[a:b], self.count[a:b] = self.used + np.cumsum(size) - size, size
        self.flat[self.used : self.used + size.sum()] = np.concatenate(pieces)
        self.used += int(size.sum())
        self.score[a:b], self.loss[a:b] = score, loss

    def _alternatives(self, chunk: int) -> tuple[list[float], list[np.ndarray]]:
        """Losses and ids of a chunk's n best segmentations; the first is the Viterbi path, also where others equal it."""
        if chunk not in self.alternatives:
            best = self.flat[self.start[chunk] : self.start[chunk] + self.count[chunk]].copy()
            losses, ids = [0.0], [best]
            for loss, path in self.lattice.n_best(self.names[chunk], self.n):
                found = np.array([y for x in path for y in (self.lattice.as_bytes(x) if x < 0 else (x,))], np.int32)
                if len(ids) < self.n and not np.array_equal(found, best):
                    losses.append(max(loss, 0.0)), ids.append(found)
            self.alternatives[chunk] = losses, ids
        return self.alternatives[chunk]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, list[float]]]:
        """Best ids and the scores of the n best segmentations of each text."""
        return [(ids[0], scores) for ids, scores in self.n_best(texts)]

    def n_best(self, texts: list[str]) -> list[tuple[list[np.ndarray], list[float]]]:
        """Ids and scores of the n best segmentations of each text, best first."""
        if len(self.memo) > MEMO:
            self.reset()
        split, get = self.lattice.split, self.memo.__getitem__
        cut = [np.fromiter(map(get, split(SPACE + t.replace(" ", SPACE))), np.int64) if t else np.empty(0, np.int64) for t in texts]
        self._learn()
        out = []
        for chunks in cut:
            if not len(chunks):
                out.append(([np.empty(0, np.int32)], [0.0]))
                continue
            count = self.count[chunks]
            ends = np.cumsum(count)
            where = np.arange(ends[-1]) + np.repeat(self.start[chunks] - (ends - count), count)
            best = self.flat[where]
            top, ids, scores = float(self.score[chunks].sum()), [best], []
            if self.n > 1:
                loss = self.loss[chunks]
                few = np.argpartition(loss, self.n - 2)[: self.n - 1] if len(loss) >= self.n else np.arange(len(loss))
                few = np.sort(few[np.isfinite(loss[few])])
                lists = [self._alternatives(int(c)) for c in chunks[few]]
                for less, picks in merge_losses([x for x, _ in lists], self.n)[1:]:
                    parts, at = [], 0
                    for k, (_, other), p in zip(few.tolist(), lists, picks):
                        if p:
                            parts += [best[at : ends[k] - count[k]], other[p]]
                            at = ends[k]
                    ids.append(np.concatenate([*parts, best[at:]])), scores.append(top - less)
            out.append((ids, [top, *scores]))
        return out


def decode_ids(ids, table: list[bytes]) -> bytes:
    """Text of ids: pieces joined, marks as blanks, the blank before the text off."""
    return b"".join(map(table.__getitem__, ids))[1:]


def encode(docs: DataFrame, n_best: int = 3, model: str = MODEL) -> DataFrame:
    """doc_id, ids (best segmentation), alternatives (ids of the 2nd to n-th best), scores (of all, descending), decodes.

    There are fewer where a text has fewer segmentations. Whole texts are segmented; decodes tells whether decoding the
    ids of each gives the text back (a text's own space marks become blanks). Null and empty texts have no ids and the score 0. Rows keep their number and order within
    partitions; repeated rows are encoded alike and other columns are ignored. No shuffle; a task holds a batch of
    texts and a memo of bounded size.
    """
    src = fields(docs, doc_id=docs["doc_id"], text=F.coalesce(docs["text"].cast("string"), F.lit("")))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(model, n_best)
        table = coder.lattice.bytes
        for b in batches:
            for at in range(0, len(b), 256):
                c = b.slice(at, 256)
                texts = c.column(1).to_pylist()
                done = coder.n_best(texts)
                right = []
                for (ranks, _), t in zip(done, texts):
                    body = t.replace(SPACE, " ").encode()
                    right.append(all(decode_ids(i.tolist(), table) == body for i in ranks))
                best, others = [ranks[0] for ranks, _ in done], [i for ranks, _ in done for i in ranks[1:]]
                by_doc = pa.array(np.cumsum([0, *(len(ranks) - 1 for ranks, _ in done)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [c.column(0), _lists(best), pa.ListArray.from_arrays(by_doc, _lists(others)), pa.array([s for _, s in done], pa.list_(pa.float64())), pa.array(right)],
                    names=["doc_id", "ids", "alternatives", "scores", "decodes"],
                )

    return src.mapInArrow(run, f"doc_id {kind}, ids array<int>, alternatives array<array<int>>, scores array<double>, decodes boolean")


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32()))


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text of a table (doc_id, ids); null ids give an empty text."""
    src = fields(encoded, doc_id=encoded["doc_id"], ids=encoded["ids"])
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lattice(model).bytes
        for b in batches:
            texts = [decode_ids(i or (), table).decode("utf-8", "replace") for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return src.mapInArrow(run, f"doc_id {kind}, text string")
