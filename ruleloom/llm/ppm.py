"""Language identification by prediction by partial matching with frozen statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, fields, text_bytes, words, written
from .wordbytes import WordIds, windows

ORDER = 4
#: Labelled bytes that the statistics are gathered from, all languages together: the bound of the sample.
SAMPLE_BYTES = 8_000_000
MAX_LANGS = 1000
#: The sample is drawn by a hash of this many values, enough for shares far below one in a billion.
DRAWS = 2**48
#: Bytes from one place where a text may be cut to the next; less where a language's share is small.
SEGMENT = 1024
#: What is drawn before the sample is cut to its bound, in parts of the bound.
SPARE = 2
STEPS = 1000
BLANKS = re.compile(rb"[\t-\r ]")
MEMO = 250_000
LETTER = re.compile(r"[^\W\d_]")


class PPM:
    """Variable-order byte contexts of each language, with escape method C and exclusions.

    A byte is coded in the longest context seen for the language: with count c of n and t distinct bytes it gets
    c / (n + t); else an escape t / (n + t) leads to the context one byte shorter, without the bytes that the longer
    context has seen (they would not have escaped); below order 0 the bytes never seen share the rest evenly.
    """

    def __init__(self, counts: dict[str, tuple[list[bytes], list[int]]], order: int = ORDER):
        self.order, self.langs = order, sorted(counts)
        grams, weights = [], []
        for lang in self.langs:
            distinct, count = counts[lang]
            w, starts = windows(distinct, order)
            grams.append(w)
            weights.append(np.repeat(np.asarray(count, np.float64), np.diff(np.append(starts, len(w)))))
        #: For each order: grams (context, byte), their counts by language; contexts, their n and t by language.
        self.tables = []
        if not self.langs:
            return
        for k in range(order + 1):
            cut = [self._cut(g[(g >> np.uint64(56)) >= k], k) for g in grams]
            keys = np.unique(np.concatenate(cut)) if cut else np.empty(0, np.uint64)
            c = np.stack([np.bincount(np.searchsorted(keys, x), w[(g >> np.uint64(56)) >= k], len(keys)) for x, g, w in zip(cut, grams, weights)], 1) if len(keys) else np.zeros((0, len(self.langs)))
            ctx, at = np.unique(keys >> np.uint64(8), return_inverse=True)
            n = np.stack([np.bincount(at, c[:, j], len(ctx)) for j in range(c.shape[1])], 1) if len(ctx) else np.zeros((0, len(self.langs)))
            t = np.stack([np.bincount(at, c[:, j] > 0, len(ctx)) for j in range(c.shape[1])], 1) if len(ctx) else n
            self.tables.append([keys, c, ctx, n, t, None])
        for k in range(1, order + 1):
            # What the bytes seen in a context count in the context one byte shorter.
            keys, c, ctx = self.tables[k][:3]
            lower, lower_c = self.tables[k - 1][:2]
            mask = np.uint64((1 << 8 * k) - 1)
            inside = lower_c[np.searchsorted(lower, keys & mask)] * (c > 0)
            at = np.searchsorted(ctx, keys >> np.uint64(8))
            self.tables[k][5] = np.stack([np.bincount(at, inside[:, j], len(ctx)) for j in range(c.shape[1])], 1)

    @staticmethod
    def _cut(window: np.ndarray, k: int) -> np.ndarray:
        return window & np.uint64((1 << 8 * (k + 1)) - 1)

    @staticmethod
    def _find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.full(len(x), -1)
        at = np.searchsorted(keys, x)
        at[at == len(keys)] = 0
        return np.where(keys[at] == x, at, -1)

    def cost(self, window: np.ndarray) -> np.ndarray:
        """Bits of each window's byte under each language."""
        shape = (len(window), len(self.langs))
        bits, done = np.zeros(shape), np.zeros(shape, bool)
        out_n, out_t = np.zeros(shape), np.zeros(shape)
        length = (window >> np.uint64(56)).astype(np.int64)
        for k in range(self.order, -1, -1):
            keys, c, ctx, n, t, inner = self.tables[k]
            gram = self._cut(window, k)
            g, x = self._find(keys, gram), self._find(ctx, gram >> np.uint64(8))
            usable = (length >= k) & (x >= 0)
            if not usable.any():
                continue
            here_n, here_t = n[x] * usable[:, None], t[x] * usable[:, None]
            free_n, free_t = here_n - out_n, here_t - out_t
            mine = c[g] * ((g >= 0) & usable)[:, None]
            seen = (here_n > 0) & ~done
            with np.errstate(divide="ignore", invalid="ignore"):
                hit = seen & (mine > 0)
                bits = np.where(hit, bits - np.log2(mine / (free_n + free_t)), bits)
                miss = seen & (mine == 0) & (free_t > 0)
                bits = np.where(miss, bits - np.log2(free_t / (free_n + free_t)), bits)
            done |= hit
            if k:
                out_n = np.where(seen, inner[x], out_n)
                out_t = np.where(seen, here_t, out_t)
            else:
                out_t = np.where(here_n > 0, here_t, out_t)
        return np.where(done, bits, bits + np.log2(np.maximum(256 - out_t, 1)))


def segment(body: bytes, k: int, size: int) -> bytes:
    """The k-th segment of a text: cut at the first blank from k * size on, or right there if a whole segment has none."""

    def place(p: int) -> int:
        found = BLANKS.search(body, p, p + size) if p else None
        return found.start() if found else min(p, len(body))

    return body[place(k * size) : place((k + 1) * size)]


def draws(text_hash: int, n: int) -> np.ndarray:
    """Numbers under DRAWS of the segments of a text; equal texts have the same."""
    x = np.uint64(text_hash & (2**64 - 1)) ^ (np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for mul in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(mul)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(16)).astype(np.int64)


def sample(labelled: DataFrame, budget: int) -> DataFrame:
    """lang, draw, body, n: segments of each language's distinct texts and how many rows have them.

    All of a language if its distinct texts have no more bytes than its share of the budget; else as many segments as
    fit in the share, those of the least draws (by hash of the text and the segment's place), one with a word at least.
    """
    rows = fields(labelled, lang=labelled["lang"].cast("string"), body=text_bytes(labelled)).filter("lang is not null")
    rows = rows.withColumn("h", F.xxhash64("body"))
    distinct = rows.groupBy("lang", "h").agg(F.max(F.length("body")).alias("size"))
    sizes = {r[0]: r[1] for r in distinct.groupBy("lang").agg(F.sum("size")).limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    share = budget // max(len(sizes), 1)
    ddl = "lang string, draw long, body binary, n long"
    schema = pa.schema([("lang", pa.string()), ("draw", pa.int64()), ("body", pa.binary()), ("n", pa.int64())])
    if not share:
        return labelled.sparkSession.createDataFrame([], ddl)
    # A segment has less than twice the step between its places.
    step = max(1, min(SEGMENT, share // 2))
    below = {k: DRAWS if v <= share else int(DRAWS * min(1.0, SPARE * share / v)) for k, v in sizes.items()}

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        least: dict[str, tuple] = {}
        for b in batches:
            for lang, body, h in zip(*(c.to_pylist() for c in b.columns)):
                d = draws(h, -(-len(body) // step))
                for k in np.flatnonzero(d < below[lang]).tolist():
                    if not (part := segment(body, k, step)).isspace() and part:
                        key = lang, int(d[k]), part
                        seen[key] = seen.get(key, 0) + 1
                # The least draw of all is kept whatever the rate.
                low = least.get(lang, (DRAWS,))[0]
                for k in sorted(np.flatnonzero((d >= below[lang]) & (d <= low)).tolist(), key=d.__getitem__):
                    if not (part := segment(body, k, step)).isspace() and part:
                        now = int(d[k])
                        same = now == low and least[lang][1] == part
                        if now < low or same:
                            least[lang] = now, part, least[lang][2] + 1 if same else 1
                        break
        out = [(*key, n) for key, n in seen.items()] + [(lang, *x) for lang, x in least.items()]
        for at in range(0, len(out), 4096):
            yield batch(schema, *zip(*out[at : at + 4096]))

    drawn = rows.mapInArrow(draw, ddl).groupBy("lang", "draw", "body").agg(F.sum("n").alias("n"))
    drawn = written(drawn, "language-sample")
    rate = F.element_at(F.create_map(*[x for k, v in below.items() for x in (F.lit(k), F.lit(v))]), F.col("lang"))
    stepped = drawn.withColumn("rate", rate).groupBy("lang", F.expr(f"draw * {STEPS} div rate").alias("step")).agg(F.sum(F.length("body")).alias("size"), F.min("draw").alias("least"))
    # Draws under `upto` stay: the steps that fit in the share, and the least draw of all.
    upto: dict[str, int] = {}
    used: dict[str, int] = {}
    for lang, at, size, first in sorted(stepped.collect()):
        used[lang] = used.get(lang, 0) + size
        if lang not in upto:
            upto[lang] = first + 1
        if at < STEPS and used[lang] <= share:
            upto[lang] = max(upto[lang], -(-below[lang] * (at + 1) // STEPS))
    if not upto:
        return drawn
    bound = F.element_at(F.create_map(*[x for k, v in upto.items() for x in (F.lit(k), F.lit(v))]), F.col("lang"))
    return drawn.filter(F.col("draw") < bound)


def train(labelled: DataFrame, order: int = ORDER, budget: int = SAMPLE_BYTES) -> PPM:
    """The model of a table (text, lang); rows without lang are left out. The driver gets the sample's distinct words."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for b in batches:
            for lang, body, n in zip(*(c.to_pylist() for c in b.columns)):
                of = seen.setdefault(lang, {})
                for w in words(body):
                    of[w] = of.get(w, 0) + n
        for lang, of in seen.items():
            yield batch(schema, [lang] * len(of), list(of), list(of.values()))

    counted = sample(labelled, budget).select("lang", "body", "n").mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n"))
    counts: dict[str, tuple[list, list]] = {}
    for lang, word, n in counted.toLocalIterator():
        of = counts.setdefault(lang, ([], []))
        of[0].append(bytes(word)), of[1].append(n)
    return PPM(counts, order)


class Scorer:
    """Bits of texts under each language, remembering words already scored."""

    def __init__(self, model: PPM):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.ids, self.cost = WordIds(), np.empty((1 << 14, len(self.model.langs)))

    def bits(self, bodies: list[bytes]) -> np.ndarray:
        if len(self.ids) > MEMO:
            self.reset()
        get = self.ids.__getitem__
        cut = [np.fromiter(map(get, words(b)), np.int64) for b in bodies]
        if fresh := self.ids.fresh:
            w, starts = windows(fresh, self.model.order)
            distinct, at = np.unique(w, return_inverse=True)
            a, b = len(self.ids) - len(fresh), len(self.ids)
            while b > len(self.cost):
                self.cost = np.concatenate([self.cost, np.empty_like(self.cost)])
            self.cost[a:b] = np.add.reduceat(self.model.cost(distinct)[at], starts, axis=0)
            fresh.clear()
        return np.stack([self.cost[c].sum(0) for c in cut]) if cut else np.empty((0, len(self.model.langs)))


def identify(docs: DataFrame, labelled: DataFrame, order: int = ORDER, budget: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), bits_per_byte, text_key (a hash of the text): the language whose statistics code the whole text shortest.

    labelled: documents with lang that the statistics come from (a bounded sample, see SAMPLE_BYTES; more than MAX_LANGS
    different values of lang, of which none could have a share of it, are a ValueError). score is the
    posterior of the language under equal priors. Texts that are null or have no letter, and all where nothing was
    learned, are `und` with score 0. Equal lengths go to the first language by name. Repeated rows are scored each.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(labelled, order, budget))
    src = fields(docs, doc_id=docs["doc_id"], text=F.coalesce(docs["text"].cast("string"), F.lit("")), text_key=F.xxhash64(docs["text"]))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        langs = scorer.model.langs
        for b in batches:
            for at in range(0, len(b), 256):
                c = b.slice(at, 256)
                texts = c.column(1).to_pylist()
                bodies = [t.encode() for t in texts]
                lettered = np.array([bool(LETTER.search(t)) for t in texts], bool) & bool(langs)
                if langs:
                    bits = scorer.bits(bodies)
                    best = bits.argmin(1)
                    low = bits[np.arange(len(bits)), best]
                    score = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(1)
                    pred = [langs[j] if ok else "und" for j, ok in zip(best, lettered)]
                else:
                    low = score = np.zeros(len(texts))
                    pred = ["und"] * len(texts)
                size = np.maximum([len(x) for x in bodies], 1)
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array(pred, pa.string()), pa.array(np.where(lettered, score, 0.0)), pa.array(low / size), c.column(2)], names=["doc_id", "lang_pred", "score", "bits_per_byte", "text_key"])

    return src.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, bits_per_byte double, text_key long")
