"""LM scoring by context-tree weighting over binary-decomposed bytes."""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, discard, fields, held_out, text_bytes, words, written
from .exchange import n_blocks, ordered, owner, pack, unpack
from .wordbytes import WordIds

#: Bytes of context at most; with the byte coded a window then fills 64 bits.
DEPTH = 7
#: Bytes of context if nothing else is asked for. Messages and memory grow 2.3-fold from 6 to 7, the code length of
#: held-out text falls by 2 %.
USUAL = 6
#: Subtrees below contexts of so many bytes are weighed as a whole, by one owner each.
CUT = 3
BLOCK_BYTES = 8_000_000
HALF = log(0.5)
END = np.uint64(0x5851F42D4C957F2D)
#: Closes a text and stands before it; no word holds it.
EDGE = b"\n"


def _lgamma_half(n: np.ndarray) -> np.ndarray:
    """log of Gamma(n + 1/2) / Gamma(1/2), by a table for small n and Stirling's series beyond."""
    n = np.asarray(n, np.float64)
    out = np.empty_like(n)
    small = n < len(_TABLE)
    out[small] = _TABLE[n[small].astype(np.int64)]
    x = n[~small] + 0.5
    out[~small] = (x - 0.5) * np.log(x) - x + 0.5 * log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) - 0.5 * log(np.pi)
    return out


_TABLE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(0, 4096) + 0.5))])
_FACT = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 4097)))])


def _lfact(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, np.float64)
    out = np.empty_like(n)
    small = n < len(_FACT)
    out[small] = _FACT[n[small].astype(np.int64)]
    x = n[~small] + 1
    out[~small] = (x - 0.5) * np.log(x) - x + 0.5 * log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return _lgamma_half(zeros) + _lgamma_half(ones) - _lfact(zeros + ones)


def weigh(zeros: np.ndarray, ones: np.ndarray, children: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probabilities of nodes and the share of their own estimate in them.

    Half is the node's own estimate, half its children's product (their sum of logs); leaves (None) have no half.
    """
    own = kt(zeros, ones)
    if children is None:
        return own, np.ones(len(own))
    both = np.logaddexp(HALF + own, HALF + children)
    return both, np.exp(HALF + own - both)


class State:
    """What the nodes of a path, from the root down, have settled of a decision: probability of a one so far, the share
    still open, and the deepest estimate that training has seen."""

    def __init__(self, one: np.ndarray, share: np.ndarray, last: np.ndarray):
        self.one, self.share, self.last = one, share, last

    @classmethod
    def start(cls, n: int) -> State:
        return cls(np.zeros(n), np.ones(n), np.full(n, 0.5))

    def at(self, parents: np.ndarray) -> State:
        return State(self.one[parents], self.share[parents], self.last[parents])

    def step(self, zeros: np.ndarray, ones: np.ndarray, stay: np.ndarray) -> State:
        """One depth further. Where training never came, all that is open goes to the last estimate."""
        n = zeros + ones
        seen, estimate = n > 0, (ones + 0.5) / (n + 1)
        part = np.where(seen, stay, 1.0)
        last = np.where(seen, estimate, self.last)
        return State(self.one + self.share * part * last, self.share * (1 - part), last)

    def end(self) -> np.ndarray:
        return self.one + self.share * self.last


class Tree:
    """Levels `low` to `depth` of the context tree over windows.

    A window is an integer: the bytes of its context, nearest first, then the byte coded. Windows are sorted, each with
    how often training has it (also never). Level d has a symbol for each context of d bytes and byte, and for each of
    the eight decisions of a byte the nodes are runs of symbols that share context and leading bits.
    """

    def __init__(self, window: np.ndarray, count: np.ndarray, depth: int, low: int):
        self.depth, self.low = depth, low
        self.symbols, self.up, self.count = {depth: window}, {}, {depth: count}
        for d in range(depth - 1, low - 1, -1):
            below = self.symbols[d + 1]
            self.symbols[d], self.up[d + 1] = np.unique(below >> np.uint64(16) << np.uint64(8) | below & np.uint64(255), return_inverse=True)
            self.count[d] = np.bincount(self.up[d + 1], self.count[d + 1], len(self.symbols[d])).astype(np.int64)

    def _runs(self, d: int, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the nodes of decision i at level d, their first symbols, and each symbol's node."""
        key = self.symbols[d] >> np.uint64(8 - i)
        new = np.append(np.ones(min(len(key), 1), bool), key[1:] != key[:-1])
        first = np.flatnonzero(new)
        return key[first], first, np.cumsum(new) - 1

    def decide(self, i: int, above=None):
        """Without `above`: keys (context << 8 | node within the byte), zeros, ones and log weights of the nodes of decision
        i at the lowest level. With `above`, the State of those nodes' parents: log10 probability of each window's bit."""
        runs = {d: self._runs(d, i) for d in range(self.low, self.depth + 1)}
        zeros, ones, stay, weighted, children = {}, {}, {}, None, None
        for d in range(self.depth, self.low - 1, -1):
            _, first, _ = runs[d]
            bit = (self.symbols[d] >> np.uint64(7 - i) & np.uint64(1)).astype(np.int64)
            ones[d] = np.add.reduceat(self.count[d] * bit, first)
            zeros[d] = np.add.reduceat(self.count[d], first) - ones[d]
            weighted, stay[d] = weigh(zeros[d], ones[d], children)
            if d > self.low:
                children = np.bincount(self._parents(runs, d), weighted, len(runs[d - 1][1]))
        if above is None:
            key = runs[self.low][0]
            low = np.uint64((1 << i) - 1)
            return key >> np.uint64(i) << np.uint64(8) | np.uint64(1 << i) | key & low, zeros[self.low], ones[self.low], weighted
        state = above
        for d in range(self.low, self.depth + 1):
            state = (state.at(self._parents(runs, d)) if d > self.low else state).step(zeros[d], ones[d], stay[d])
        one = state.end()[runs[self.depth][2]]
        return np.log10(np.where(self.symbols[self.depth] >> np.uint64(7 - i) & np.uint64(1), one, 1 - one))

    def _parents(self, runs: dict, d: int) -> np.ndarray:
        """Node one level up of each node of level d."""
        return runs[d - 1][2][self.up[d][runs[d][1]]]

    def summary(self) -> tuple[np.ndarray, ...]:
        """Keys, zeros, ones and log weights of the lowest level's nodes, decision after decision."""
        return tuple(map(np.concatenate, zip(*(self.decide(i) for i in range(8))))) if len(self.symbols[self.depth]) else (np.empty(0, np.uint64), *[np.empty(0)] * 3)

    def predict(self, above: State) -> np.ndarray:
        """log10 probability of each window's byte, given the State above each node of summary(), in that order."""
        total, at = np.zeros(len(self.symbols[self.depth])), 0
        for i in range(8 if len(total) else 0):
            n = len(self._runs(self.low, i)[0])
            total += self.decide(i, above.at(np.arange(at, at + n)))
            at += n
        return total


class Nodes:
    """Nodes of one level put together from what their children tell (keys context << 8 | node, zeros, ones, log weights)."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weighted: np.ndarray):
        parent = keys >> np.uint64(16) << np.uint64(8) | keys & np.uint64(255)
        self.keys, self.child = np.unique(parent, return_inverse=True)
        self.zeros, self.ones, children = (np.bincount(self.child, x, len(self.keys)) for x in (zeros, ones, weighted))
        self.weighted, self.stay = weigh(self.zeros, self.ones, children)

    def told(self) -> tuple[np.ndarray, ...]:
        return self.keys, self.zeros, self.ones, self.weighted

    def below(self, state: State) -> State:
        """State after these nodes, for each child, given the State above them."""
        return state.step(self.zeros, self.ones, self.stay).at(self.child)


def tokens(bodies: list[bytes]) -> tuple[list[bytes], list[np.ndarray], bytes]:
    """Distinct words, each text's words as positions in them, and all texts as coded: EDGE repeated, the words with a
    blank between two, EDGE."""
    ids = WordIds()
    get, cut, coded = ids.__getitem__, [], []
    for b in bodies:
        w = words(b)
        cut.append(np.fromiter(map(get, w), np.int64, len(w)))
        coded.append(EDGE * DEPTH + b" ".join(w) + EDGE)
    return list(ids), cut, b"".join(coded)


class Windows:
    """The window of each coded byte of a block."""

    def __init__(self, cut: list[np.ndarray], distinct: list[bytes], coded: bytes, depth: int):
        size = np.append(np.fromiter(map(len, distinct), np.int64, len(distinct)), 0) + 1
        # A text's words, each with what closes it; a text without words has an end only.
        self.n_bytes = np.array([size[c].sum() if len(c) else 1 for c in cut], np.int64)
        ends = np.cumsum(self.n_bytes + DEPTH)
        coded_at = np.ones(len(coded), bool)
        for d in range(DEPTH):
            coded_at[ends - self.n_bytes - DEPTH + d] = False
        # Byte by byte of the integers, so that nothing wider than a byte is made on the way.
        raw = np.frombuffer(coded, np.uint8)
        window = np.zeros((len(raw), 8), np.uint8)
        for d in range(depth + 1):
            window[d:, 0 if d == 0 else depth + 1 - d] = raw[: len(raw) - d]
        self.window = window.view("<u8").ravel()[coded_at]

    def of_texts(self, which: np.ndarray) -> np.ndarray:
        """Windows of the texts marked, sorted."""
        return np.sort(self.window if which.all() else self.window[np.repeat(which, self.n_bytes)])

    def counted(self, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct windows in order, and how often the texts marked have each."""
        learned, n = _runs(self.of_texts(learn))
        if learn.all():
            return learned, n
        other, _ = _runs(self.of_texts(~learn))
        both = _runs(np.sort(np.concatenate([learned, other])))[0]
        count = np.zeros(len(both), np.int64)
        count[np.searchsorted(both, learned)] = n
        return both, count

    def by_text(self, distinct: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Sum over the bytes of each text of a value of its window, given for the distinct windows."""
        at = pc.index_in(pa.array(self.window), value_set=pa.array(distinct)).to_numpy()
        return np.add.reduceat(value[at], np.cumsum(self.n_bytes) - self.n_bytes) if len(at) else np.empty(0)


def _runs(ordered_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    first = np.flatnonzero(np.append(np.ones(min(len(ordered_), 1), bool), ordered_[1:] != ordered_[:-1]))
    return ordered_[first], np.diff(np.append(first, len(ordered_)))


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, byte plane by byte plane."""
    return pack(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(unpack(b, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return pack(np.ascontiguousarray(counts, np.int64).view(np.uint8).reshape(-1, 8).T)


def unpack_counts(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack(b, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def pack_logs(p: np.ndarray) -> bytes:
    """log10 probabilities to the nearest 2**-20, byte plane by byte plane: the upper planes are nearly all zero."""
    return pack(np.rint(p * -(2.0**20)).astype("<u4").view(np.uint8).reshape(-1, 4).T)


def unpack_logs(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack(b, np.uint8).reshape(4, -1).T).view("<u4").ravel() * -(2.0**-20)


def _split(parts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by part, keeping it within parts, and where each part starts."""
    order = np.argsort(parts, kind="stable")
    return order, np.searchsorted(parts[order], np.arange(n + 1))


MESSAGE = pa.schema([("kind", pa.int32()), ("to", pa.int32()), ("sender", pa.int32()), ("keys", pa.binary()), ("numbers", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])
MESSAGE_DDL = "kind int, to int, sender int, keys binary, numbers binary, n long, v long"


def _messages(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([batch(MESSAGE, *(zip(*rows) if rows else [[]] * len(MESSAGE)))])


def _sent(table: pa.Table) -> list[dict]:
    """Messages in the order of their senders, whatever the order they came in."""
    return table.sort_by("sender").to_pylist()


def _merged(sent: list[dict]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of messages, their numbers added up, and where each message's keys are among them."""
    keys = [unpack_sorted(r["keys"]) for r in sent]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, at, np.concatenate([unpack_counts(r["numbers"]) for r in sent]))
    return distinct, total, np.split(at, np.cumsum([len(k) for k in keys])[:-1])


def score(docs: DataFrame, depth: int = USUAL, modulus: int = 7, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    A text is coded as its words, lower-cased, with a blank between two, and an end; the context of a byte is the `depth`
    bytes (at most 7) before it, across words. Each byte is eight binary decisions; each decision has a node at every
    depth, and the context tree weights their KT estimates. Statistics come from all documents that are not held out
    and are frozen; score is the log10 probability of the text, bits_per_byte its code length over the bytes coded.

    1. Blocks of documents send their distinct windows (context and byte) with counts, by a hash of the window; there
       the blocks' counts are added up, so what goes on is one entry a distinct window, however common.
    2. Owners of contexts of CUT bytes weigh the subtrees below them; owners of the nearest byte weigh the levels above;
       the root's 255 nodes are summed up by the driver.
    3. Mixtures go down the same way: to the owners, to the holders of windows, to the blocks that asked.
    Nothing that grows with the corpus is broadcast or collected. Counts are exact. Null and empty texts are one end; a
    null id counts as an empty one where documents are split; rows that repeat are scored and counted each; an empty
    table gives none.
    """
    if not CUT <= depth <= DEPTH:
        raise ValueError(f"depth is from {CUT} to {DEPTH}")
    src = fields(docs, doc_id=docs["doc_id"].cast("long"), body=text_bytes(docs), held_out=held_out(docs["doc_id"], modulus))
    blocks = n_blocks(src, F.length("body"), block_bytes)
    parts = max(4, blocks)
    blocked = src.withColumn("block", F.pmod(F.xxhash64("doc_id", "body"), F.lit(blocks)).cast("int")).repartition(blocks, "block")

    def ask(key, table):
        me = key[0].as_py()
        distinct, cut, coded = tokens(table.column("body").to_pylist())
        learn = ~np.array(table.column("held_out").to_pylist(), bool)
        n = np.bincount(np.concatenate(cut), np.repeat(learn, [len(c) for c in cut]), len(distinct)).astype(np.int64)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
        keys, cuts, place = ordered(np.append(hashes, END), parts)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, place, np.append(n, learn.sum()))
        rows = [(0, p, me, pack_sorted(keys[a:b]), pack_counts(counts[a:b]), 0, 0) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        window, counts = Windows(cut, distinct, coded, depth).counted(learn)
        order, cuts = _split(owner(window, parts), parts)
        window, counts = window[order], counts[order]
        rows += [(1, p, me, pack_sorted(window[a:b]), pack_counts(counts[a:b]), 0, 0) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        return _messages(rows)

    asked = written(blocked.groupBy("block").applyInArrow(ask, MESSAGE_DDL), "ctw-asked")

    def count_words(key, table):
        sent = _sent(table)
        _, total, where = _merged(sent)
        rows = [(0, r["sender"], key[0].as_py(), b"", pack_counts(total[w]), 0, 0) for r, w in zip(sent, where)]
        return _messages([*rows, (0, -1, key[0].as_py(), b"", b"", int(total.sum()), int((total > 0).sum()))])

    known = written(asked.filter("kind = 0").groupBy("to").applyInArrow(count_words, MESSAGE_DDL), "ctw-words")
    train_tokens, vocabulary = (int(x or 0) for x in known.agg(F.sum("n"), F.sum("v")).first())

    def subtree(window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _split(owner((window >> np.uint64(8 * (depth - CUT + 1))) + np.uint64(1), parts), parts)

    def add_up(key, table):
        window, total, _ = _merged(_sent(table))
        order, cuts = subtree(window)
        window, total = window[order], total[order]
        return _messages([(1, p, key[0].as_py(), pack_sorted(window[a:b]), pack_counts(total[a:b]), 0, 0) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a])

    asked_windows = asked.filter("kind = 1")
    totals = written(asked_windows.groupBy("to").applyInArrow(add_up, MESSAGE_DDL), "ctw-windows")

    def up(key, table):
        """What a subtree owner's lowest nodes tell the owners of their nearest byte."""
        window, total, _ = _merged(_sent(table))
        told = Tree(window, total, depth, CUT).summary()
        order, cuts = _split((told[0] >> np.uint64(8 * CUT)).astype(np.int64), 256)
        numbers = np.stack([np.asarray(x, np.float64)[order] for x in told[1:]])
        keys = told[0][order]
        return _messages([(2, p, key[0].as_py(), pack(keys[a:b]), pack(numbers[:, a:b]), 0, 0) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a])

    told = written(totals.groupBy("to").applyInArrow(up, MESSAGE_DDL), "ctw-nodes")

    def levels(sent: list[dict]) -> tuple[list[Nodes], list[int]]:
        """Levels CUT - 1 to 1 above what the senders tell."""
        keys = [unpack(r["keys"], np.uint64) for r in sent]
        numbers = np.concatenate([unpack(r["numbers"], np.float64).reshape(3, -1) for r in sent], 1)
        out = [Nodes(np.concatenate(keys), *numbers)]
        while len(out) < CUT - 1:
            out.append(Nodes(*out[-1].told()))
        return out, [len(k) for k in keys]

    def top(key, table):
        keys, zeros, ones, weighted = levels(_sent(table))[0][-1].told()
        return pa.table({"node": (keys & np.uint64(255)).astype(np.int64), "zeros": zeros, "ones": ones, "weighted": weighted})

    # At most 256 bytes of 255 nodes each, added up to 255 rows.
    top_rows = told.groupBy("to").applyInArrow(top, "node long, zeros double, ones double, weighted double")
    top_rows = top_rows.groupBy("node").agg(F.sum("zeros"), F.sum("ones"), F.sum("weighted")).orderBy("node").collect()
    root = {r[0]: tuple(r[1:]) for r in top_rows}

    def down(key, table):
        """The State above each node that a subtree owner told of."""
        sent = _sent(table)
        above, size = levels(sent)
        own = [root[k] for k in (above[-1].keys & np.uint64(255)).tolist()]
        zeros, ones, children = np.array(own, np.float64).T
        state = State.start(len(own)).step(zeros, ones, weigh(zeros, ones, children)[1])
        for nodes in reversed(above):
            state = nodes.below(state)
        all_ = np.stack([state.one, state.share, state.last])
        return _messages([(2, r["sender"], key[0].as_py(), b"", pack(x), 0, 0) for r, x in zip(sent, np.split(all_, np.cumsum(size)[:-1], 1))])

    def predict(key, table, states):
        """log10 probabilities of the windows that holders told of."""
        sent, replies = _sent(table), _sent(states)
        window, total, where = _merged(sent)
        tree = Tree(window, total, depth, CUT)
        keys = tree.summary()[0]
        # Replies are grouped by nearest byte, keeping the order within.
        order = np.argsort((keys >> np.uint64(8 * CUT)).astype(np.int64), kind="stable")
        state = np.empty((3, len(keys)))
        state[:, order] = np.concatenate([unpack(r["numbers"], np.float64).reshape(3, -1) for r in replies], 1)
        p = tree.predict(State(*state))
        return _messages([(1, r["sender"], key[0].as_py(), b"", pack_logs(p[w]), 0, 0) for r, w in zip(sent, where)])

    predicted = totals.groupBy("to").cogroup(told.groupBy("to").applyInArrow(down, MESSAGE_DDL).groupBy("to")).applyInArrow(predict, MESSAGE_DDL)

    def reply(key, table, found):
        sent = _sent(table)
        window, _, where = _merged(sent)
        order, _ = subtree(window)
        p = np.empty(len(window))
        p[order] = np.concatenate([unpack_logs(r["numbers"]) for r in _sent(found)])
        return _messages([(1, r["sender"], key[0].as_py(), b"", pack_logs(p[w]), 0, 0) for r, w in zip(sent, where)])

    answers = asked_windows.groupBy("to").cogroup(predicted.groupBy("to")).applyInArrow(reply, MESSAGE_DDL)
    answers = written(answers, "ctw-answers")
    discard(asked, totals, told)
    answers = known.filter("to >= 0").unionByName(answers).select("kind", F.col("to").alias("block"), "sender", "numbers").repartition(blocks, "block")
    log_base = np.log10(train_tokens + vocabulary + 1.0)
    out_schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])

    def finish(key, docs_, replies):
        distinct, cut, coded = tokens(docs_.column("body").to_pylist())
        sent = _sent(replies)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
        place = ordered(np.append(hashes, END), parts)[2]
        c = np.concatenate([unpack_counts(r["numbers"]) for r in sent if r["kind"] == 0])[place]
        w = Windows(cut, distinct, coded, depth)
        window = _runs(w.of_texts(np.ones(len(cut), bool)))[0]
        order, _ = _split(owner(window, parts), parts)
        p = np.empty(len(order))
        p[order] = np.concatenate([unpack_logs(r["numbers"]) for r in sent if r["kind"] == 1])
        base = np.log10(c + 1.0) - log_base
        n_known = [int((c[x] > 0).sum() + (c[-1] > 0)) for x in cut]
        cols = [docs_.column("doc_id"), docs_.column("held_out"), [len(x) + 1 for x in cut], n_known, [float(base[x].sum() + base[-1]) for x in cut], w.by_text(window, p), w.n_bytes]
        return pa.table({f.name: (col.cast(f.type) if isinstance(col, pa.ChunkedArray) else pa.array(col, f.type)) for f, col in zip(out_schema, cols)})

    scored = blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes",
        (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
