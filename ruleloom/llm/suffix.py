"""Removal of byte strings that repeat across a corpus, by a prefix-aware distributed merge sort of suffixes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, fields, in_order, text_bytes, written
from .exchange import dealt, n_blocks, ordered, pack, unpack

BLOCK_BYTES = 12_000_000
SLICE = 1 << 19
#: A gram with more contexts than this is split by all further bytes of its windows, so that its contexts do not meet in
#: one owner: each block sends one entry for each distinct window, as a 64-bit hash. The spans are the same.
HOT = 2048


# -- anchors -----------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(3)
    base, n = 0x9E3779B97F4A7C15, SLICE + 1024
    inverse = pow(base, -1, 2**64)

    def series(b: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        step, width = b, 1
        while width < n:
            take = min(width, n - width)
            out[width : width + take] = out[:take] * np.uint64(step)
            step, width = step * step % 2**64, width * 2
        return out

    return series(base), series(inverse), rng.integers(1, 2**64, 256, np.uint64, endpoint=False), rng.integers(1, 2**64, 2048, np.uint64, endpoint=False) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(27))


class Block:
    """The texts of a block laid end to end, of those that are long enough to hold a match."""

    def __init__(self, bodies: list[bytes], length: int):
        self.length, self.gram = length, length // 2
        self.which = [i for i, b in enumerate(bodies) if len(b) >= length]
        self.text = np.frombuffer(b"".join([bodies[i] for i in self.which]), np.uint8)
        size = np.array([len(bodies[i]) for i in self.which], np.int64)
        self.ends = np.cumsum(size)
        self.starts = self.ends - size

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions that stand for all windows, and hashes of the grams there.

        Each window of `length` bytes has its smallest gram (of half that length, by hash, the first of equals) as
        anchor: equal windows have it at the same place, so windows can be equal only where their anchors' grams are.
        """
        pw, ipw, table, _ = _powers()
        n, k = self.length, self.gram
        w = n - k + 1
        places, hashes = [], []
        for s in range(0, len(self.text), SLICE):
            x = self.text[s : s + SLICE + n]
            if len(x) < n:
                break
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[x] * pw[: len(x)])])
            g = _mix((total[k:] - total[:-k]) * ipw[: len(x) - k + 1])
            low = (g & ~np.uint64((1 << 20) - 1)) | np.arange(len(g), dtype=np.uint64)
            width = 1
            while width * 2 <= w:
                low = np.minimum(low[:-width], low[width:])
                width *= 2
            if w > width:
                low = np.minimum(low[: len(low) - (w - width)], low[w - width :])
            low = low[: min(SLICE, len(x) - n + 1)]
            at = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
            doc = np.searchsorted(self.ends, [s, s + len(low) - 1], side="right")
            ok = np.ones(len(low), bool)
            for e in self.ends[doc[0] : doc[1] + 1]:
                ok[max(e - n + 1 - s, 0) : max(e - s, 0)] = False
            at = np.unique(at[ok])
            places.append(at + s), hashes.append(g[at])
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        place, first = np.unique(np.concatenate(places), return_index=True)
        return place, np.concatenate(hashes)[first]

    def reach(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of an anchor's document before and after it, as far as windows with that anchor can reach."""
        doc = np.searchsorted(self.ends, at, side="right")
        return np.minimum(at - self.starts[doc], self.length - self.gram), np.minimum(self.ends[doc] - at, self.length)

    def right(self, at: np.ndarray, after: np.ndarray) -> np.ndarray:
        x = self.text[np.minimum(at[:, None] + np.arange(self.length), len(self.text) - 1)]
        x[np.arange(self.length) >= after[:, None]] = 0
        return x

    def left(self, at: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Bytes before the anchors, the nearest first."""
        x = self.text[np.maximum(at[:, None] - 1 - np.arange(self.length - self.gram), 0)]
        x[np.arange(self.length - self.gram) >= before[:, None]] = 0
        return x

    def contexts(self, at: np.ndarray) -> np.ndarray:
        """64-bit hashes of all that windows with these anchors can hold."""
        factor, out = _powers()[3], np.empty(len(at), np.uint64)
        before, after = self.reach(at)
        n, k = self.length, self.length - self.gram
        for i in range(0, len(at), 4096):
            j = slice(i, i + 4096)
            h = self.right(at[j], after[j]) @ factor[:n] + self.left(at[j], before[j]) @ factor[n : n + k]
            out[j] = _mix(h + before[j].astype(np.uint64) * factor[-1] + after[j].astype(np.uint64) * factor[-2])
        return out

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all whole windows that hold one of these anchors' grams, each once, with their 64-bit hashes."""
        factor = _powers()[3]
        before, after = self.reach(at)
        n, k = self.length, self.length - self.gram
        starts = np.unique(np.concatenate([at[(before >= d) & (after >= n - d)] - d for d in range(k + 1)]))
        h = np.empty(len(starts), np.uint64)
        for i in range(0, len(starts), 4096):
            h[i : i + 4096] = _mix(self.text[starts[i : i + 4096, None] + np.arange(n)] @ factor[:n])
        return starts, h


# -- runs --------------------------------------------------------------------------------------------------------------


def shared_prefix(a: np.ndarray) -> np.ndarray:
    """Bytes that each row of a matrix shares with the row before it (0 for the first)."""
    out = np.zeros(len(a), np.int64)
    for i in range(1, len(a), 4096):
        differ = a[i : i + 4096] != a[i - 1 : i - 1 + len(a[i : i + 4096])]
        out[i : i + len(differ)] = np.where(differ.any(1), differ.argmax(1), a.shape[1])
    return out


def front_code(rows: np.ndarray) -> bytes:
    """A sorted run of equally long suffixes: what each shares with the one before, then the rest of its bytes."""
    share = shared_prefix(rows)
    rest = rows[np.arange(rows.shape[1]) >= share[:, None]]
    return pack(np.concatenate([share.astype("<u2").view(np.uint8), rest]))


def front_decode(code: bytes, n: int, length: int) -> tuple[list[int], list[bytes]]:
    raw = unpack(code, np.uint8)
    share, rest, at, out, last = raw[: 2 * n].view("<u2").tolist(), raw[2 * n :].tobytes(), 0, [], b""
    for s in share:
        last = last[:s] + rest[at : at + length - s]
        at += length - s
        out.append(last)
    return share, out


class LoserTree:
    """Merges front-coded runs without comparing bytes again that are known to be shared.

    Every head carries what it shares with the last suffix that left the tree. Of two heads the one that shares more
    comes first; only heads that share equally much are compared, from the first byte that is not known, and the loser
    then carries what it shares with the winner.
    """

    def __init__(self, runs: list[tuple[list[int], list[bytes]]], length: int):
        self.runs, self.length = runs, length
        self.size = 1
        while self.size < max(len(runs), 1):
            self.size *= 2
        self.at, self.head, self.share = [0] * len(runs), [r[1][0] if r[1] else None for r in runs], [0] * len(runs)
        self.compared = 0
        self.losers = [-1] * self.size
        self.winner = self._build(1) if runs else -1

    def _build(self, node: int) -> int:
        if node >= self.size:
            run = node - self.size
            return run if run < len(self.runs) and self.head[run] is not None else -1
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = self._play(a, b)
        self.losers[node] = lose
        return win

    def _play(self, a: int, b: int) -> tuple[int, int]:
        if a < 0 or b < 0:
            return (b, a) if a < 0 else (a, b)
        sa, sb = self.share[a], self.share[b]
        if sa != sb:
            return (a, b) if sa > sb else (b, a)
        x, y = self.head[a], self.head[b]
        self.compared += 1
        if x == y:
            self.share[b] = self.length
            return a, b
        differ = int.from_bytes(x[sa:], "big") ^ int.from_bytes(y[sa:], "big")
        common = self.length - (differ.bit_length() + 7) // 8
        win, lose = (a, b) if x[common] < y[common] else (b, a)
        self.share[lose] = common
        return win, lose

    def __iter__(self):
        """Run, position in it and what the suffix shares with the one before, in order."""
        while self.winner >= 0:
            run = self.winner
            i = self.at[run]
            yield run, i, self.share[run]
            self.at[run] = i = i + 1
            share, rows = self.runs[run]
            if i < len(rows):
                self.head[run], self.share[run] = rows[i], share[i]
                win = run
            else:
                self.head[run] = None
                win = -1
            node = (run + self.size) // 2
            while node:
                win, self.losers[node] = self._play(win, self.losers[node])
                node //= 2
            self.winner = win


def settle(rights: list[tuple[list[int], list[bytes]]], left: np.ndarray, before: np.ndarray, after: np.ndarray, many: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For contexts in runs (rights sorted; left, before, after, many laid run by run): how far before and after its
    anchor each is covered by windows that occur again; -1 where by none.

    Suffixes from the anchor are merged into one order with shared prefixes, the bytes before it are ordered too. A
    window with d bytes before the anchor occurs again if its anchor's right and left neighbours share at least
    length - d and d bytes: classes of both orders at these depths. many: the context occurs more than once in its run.
    """
    total = len(before)
    first = np.cumsum([0, *(len(r[1]) for r in rights)])
    order, share = np.empty(total, np.int64), np.empty(total, np.int64)
    for n, (run, i, s) in enumerate(LoserTree(rights, length)):
        order[n], share[n] = first[run] + i, s
    by_left = np.argsort(np.ascontiguousarray(left).view(f"S{left.shape[1]}").ravel(), kind="stable")
    share_left = shared_prefix(left[by_left])
    far_left, far_right = np.full(total, -1), np.full(total, -1)
    for d in range(length - gram + 1):
        a, b = np.empty(total, np.int64), np.empty(total, np.int64)
        a[order], b[by_left] = np.cumsum(share < length - d), np.cumsum(share_left < d)
        fit = np.flatnonzero((before >= d) & (after >= length - d))
        key = a[fit] * (total + 1) + b[fit]
        _, at, n = np.unique(key, return_inverse=True, return_counts=True)
        again = fit[(n[at] > 1) | many[fit]]
        far_left[again] = d
        far_right[again[far_right[again] < 0]] = length - d
    return far_left, far_right


# -- the operator ------------------------------------------------------------------------------------------------------


def remove_repeats(docs: DataFrame, length: int = 200, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal runs removed), kept (the remaining bytes).

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same document or another.
    Texts are taken as whole UTF-8 bytes (null: empty), matches stay within documents, what goes is judged on the input.

    1. Every window of `length` bytes has an anchor. Blocks of documents send the hashes of their anchors' grams; owners
       tell grams that occur once (their windows cannot repeat) from those that occur again.
    2. Blocks sort the suffixes at anchors whose gram occurs again and send front-coded runs to owners by gram; a loser
       tree merges them and the shared prefixes settle how far each is covered. Grams in very many contexts are split by
       the rest of their windows' bytes instead: one entry per block and distinct window, spread over all owners.
    3. Blocks cover their documents.
    Blocks are laid out by (doc_id, text), so a block that is made again, from rows in another order, is the same block.
    Grams and windows of split grams are 64-bit hashes; the sorted suffixes are compared byte by byte. Rows that
    repeat a text (and id) cover each other; an empty table gives no rows; other columns are ignored.
    """
    gram = length // 2
    src = fields(docs, doc_id=docs["doc_id"].cast("long"), body=text_bytes(docs))
    blocks = parts = n_blocks(src, F.length("body"), block_bytes)
    blocked = dealt(src.withColumn("block", F.pmod(F.xxhash64("doc_id", "body"), F.lit(blocks)).cast("int")), "block", blocks)
    row = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64())])
    ddl = "kind int, part int, block int, a binary, b binary, n long"

    def table(rows):
        return pa.Table.from_batches([batch(row, *(zip(*rows) if rows else [[]] * len(row)))])

    def ask(key, docs_):
        block = Block(in_order(docs_).column("body").to_pylist(), length)
        at, g = block.anchors()
        keys, cuts, place = ordered(g, parts)
        count = np.bincount(place, minlength=len(keys))
        # 0: once in this block; else in how many different contexts.
        code = np.zeros(len(keys), np.uint64)
        again = np.flatnonzero(count[place] > 1)
        if len(again):
            of, around = place[again], block.contexts(at[again])
            by = np.lexsort((around, of))
            of, around = of[by], around[by]
            fresh = np.append(True, (of[1:] != of[:-1]) | (around[1:] != around[:-1]))
            code = np.bincount(of[fresh], minlength=len(keys))
        code = np.minimum(code, 2**31).astype(np.uint32)
        return table([(0, p, key[0].as_py(), pack(keys[i:j]), pack(code[i:j]), 0) for p, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i])

    def judge(key, asked):
        """For each gram asked: 0 once, 1 again, 2 again and in very many contexts."""
        grams = [unpack(x, np.uint64) for x in asked.column("a").to_pylist()]
        code = np.concatenate([unpack(x, np.uint32) for x in asked.column("b").to_pylist()]).astype(np.int64)
        keys, at, n = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        again = (n > 1) | (np.bincount(at, code > 0, len(keys)) > 0)
        around = np.bincount(at, np.maximum(code, 1), len(keys))
        verdict = (again + (again & (around > hot))).astype(np.uint8)
        where = np.split(at, np.cumsum([len(x) for x in grams])[:-1])
        return table([(0, key[0].as_py(), b, pack(verdict[x]), b"", 0) for b, x in zip(asked.column("block").to_pylist(), where)])

    verdicts = written(dealt(blocked.groupBy("block").applyInArrow(ask, ddl), "part", parts).groupBy("part").applyInArrow(judge, ddl), "suffix-verdicts")

    def sort(key, docs_, replies):
        """Runs for owners (1), windows of split grams (2), and what the block must remember (9)."""
        me = key[0].as_py()
        block = Block(in_order(docs_).column("body").to_pylist(), length)
        at, g = block.anchors()
        keys, cuts, place = ordered(g, parts)
        got = dict(zip(replies.column("part").to_pylist(), replies.column("a").to_pylist()))
        verdict = np.concatenate([unpack(got[p], np.uint8) for p in sorted(got)] or [np.empty(0, np.uint8)])[place]
        rows = []
        repeated = np.flatnonzero(verdict == 1)
        part = np.searchsorted(cuts, place[repeated], side="right") - 1
        by = np.argsort(part, kind="stable")
        repeated, part = repeated[by], part[by]
        edges = np.searchsorted(part, np.arange(parts + 1))
        kept = []
        for p in np.unique(part).tolist():
            a = at[repeated[edges[p] : edges[p + 1]]]
            before, after = block.reach(a)
            right, left = block.right(a, after), block.left(a, before)
            whole = np.concatenate([right, left, before[:, None].astype("<u2").view(np.uint8), after[:, None].astype("<u2").view(np.uint8)], 1)
            first, same, n = _distinct(whole)
            order = np.argsort(np.ascontiguousarray(right[first]).view(f"S{length}").ravel(), kind="stable")
            first, n = first[order], n[order]
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            meta = np.concatenate([left[first].ravel(), before[first].astype("<u2").view(np.uint8), after[first].astype("<u2").view(np.uint8), (n > 1).astype(np.uint8)])
            rows.append((1, p, me, front_code(right[first]), pack(meta), len(first)))
            kept.append((p, a, back[same]))
        rows += [(9, p, me, pack(a), pack(s.astype(np.int32)), 1) for p, a, s in kept]
        very = at[verdict == 2]
        if len(very):
            starts, h = block.windows(very)
            keys, cuts, place = ordered(h, parts)
            n = np.bincount(place, minlength=len(keys))
            rows += [(2, p, me, pack(keys[i:j]), pack((n[i:j] > 1).astype(np.uint8)), 0) for p, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]
            rows.append((9, 0, me, pack(starts), pack(place), 2))
        return table(rows)

    runs = written(blocked.groupBy("block").cogroup(dealt(verdicts, "block", blocks).groupBy("block")).applyInArrow(sort, ddl), "suffix-runs")

    def merge(key, part):
        rows = part.to_pylist()
        out = []
        if sorted_runs := [r for r in rows if r["kind"] == 1]:
            k = length - gram
            rights = [front_decode(r["a"], r["n"], length) for r in sorted_runs]
            left, before, after, many = [], [], [], []
            for r in sorted_runs:
                m, n = unpack(r["b"], np.uint8), r["n"]
                left.append(m[: n * k].reshape(n, k))
                before.append(m[n * k : n * (k + 2)].view("<u2")), after.append(m[n * (k + 2) : n * (k + 4)].view("<u2"))
                many.append(m[n * (k + 4) :].astype(bool))
            l, r_ = settle(rights, np.concatenate(left), np.concatenate(before).astype(np.int64), np.concatenate(after).astype(np.int64), np.concatenate(many), length, gram)
            at = 0
            for r in sorted_runs:
                out.append((1, r["part"], r["block"], pack(np.stack([l[at : at + r["n"]], r_[at : at + r["n"]]]).astype(np.int16)), b"", 0))
                at += r["n"]
        if prints := [r for r in rows if r["kind"] == 2]:
            keys = [unpack(r["a"], np.uint64) for r in prints]
            distinct, at, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            again = (n > 1) | (np.bincount(at, np.concatenate([unpack(r["b"], np.uint8) for r in prints]), len(distinct)) > 0)
            for r, x in zip(prints, np.split(at, np.cumsum([len(x) for x in keys])[:-1])):
                out.append((2, r["part"], r["block"], pack(again[x].astype(np.uint8)), b"", 0))
        return table(out)

    settled = dealt(runs.filter("kind <> 9"), "part", parts).groupBy("part").applyInArrow(merge, ddl)
    # Written, so that the runs' shuffle is off the disks before whole texts are dealt out again.
    settled = written(settled, "suffix-settled")
    answers = dealt(settled.unionByName(runs.filter("kind = 9")), "block", blocks)
    kept_schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def cover(key, docs_, replies):
        docs_ = in_order(docs_)
        bodies = docs_.column("body").to_pylist()
        block = Block(bodies, length)
        rows = replies.to_pylist()
        of_run = {r["part"]: r["a"] for r in rows if r["kind"] == 1}
        of_print = {r["part"]: r["a"] for r in rows if r["kind"] == 2}
        lo, hi = [], []
        for r in rows:
            if r["kind"] != 9:
                continue
            at = unpack(r["a"], np.int64)
            if r["n"] == 1:
                l, h = unpack(of_run[r["part"]], np.int16).reshape(2, -1)[:, unpack(r["b"], np.int32)].astype(np.int64)
                lo.append(at[l >= 0] - l[l >= 0]), hi.append(at[l >= 0] + h[l >= 0])
            else:
                again = np.concatenate([unpack(of_print[p], np.uint8) for p in sorted(of_print)])[unpack(r["b"], np.int64)].astype(bool)
                lo.append(at[again]), hi.append(at[again] + length)
        step = np.zeros(len(block.text) + 1, np.int32)
        if lo:
            np.add.at(step, np.concatenate(lo), 1), np.add.at(step, np.concatenate(hi), -1)
        gone = np.cumsum(step[:-1]) > 0
        removed, spans, kept = [0] * len(bodies), [0] * len(bodies), list(bodies)
        for i, a, b in zip(block.which, block.starts.tolist(), block.ends.tolist()):
            x = gone[a:b]
            if n := int(x.sum()):
                removed[i], spans[i] = n, int(x[0]) + int((x[1:] & ~x[:-1]).sum())
                kept[i] = block.text[a:b][~x].tobytes()
        return pa.table({f.name: pa.array(c, f.type) if isinstance(c, list) else c for f, c in zip(kept_schema, [docs_.column("doc_id"), [len(b) for b in bodies], removed, spans, kept])})

    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cover, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First position, class and size of the classes of equal rows."""
    width = rows.shape[1]
    # A closing byte that is never 0: numpy leaves out trailing zeros of byte strings.
    whole = np.concatenate([rows, np.ones((len(rows), 1), np.uint8)], 1)
    _, first, same, n = np.unique(np.ascontiguousarray(whole).view(f"S{width + 1}").ravel(), return_index=True, return_inverse=True, return_counts=True)
    return first, same, n
