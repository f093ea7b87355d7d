"""Line dedup within one edit, by a deletion-neighbourhood join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, fields, written

#: Empty lines (paragraph breaks) always stay; all others take part.
MIN_CHARS = 1
LAST = 2**63 - 1
BASE = 0x9E3779B97F4A7C15
INVERSE = np.uint64(pow(BASE, -1, 2**64))


def _hashes(s: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(s.encode("utf-8", "surrogatepass"))
    return (h >> 64) - 2**63, (h & (2**64 - 1)) - 2**63


def half_keys(line: str) -> list[int]:
    """Keys of which two lines within one edit share at least one.

    For the shorter length m of a pair: its first m // 2 characters, or its last, are untouched by the edit. A line is the
    shorter (or equally long) one with m = its length, the longer with m one less. Order: prefix and suffix of m, of m - 1.
    """
    out, n = [], len(line)
    for m in (n, n - 1):
        h = m // 2
        for side, part in ((0, line[:h]), (1, line[n - h :])):
            out.append(xxhash.xxh3_64_intdigest(part.encode("utf-8", "surrogatepass"), 4 * m + side) - 2**63)
    return out


_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    """The first n powers of BASE; the table doubles where it is too short."""
    while len(_POWERS[0]) < n:
        _POWERS[0] = np.concatenate([_POWERS[0], _POWERS[0] * np.uint64(pow(BASE, len(_POWERS[0]), 2**64))])
    return _POWERS[0][:n]


def neighbourhood(line: str, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed keys of the variants of a line with at most one deletion, and their roles.

    mask tells which of the half keys are shared, so which half can hold the edit: only deletions there are made.
    Role 0, a deletion with its place: lines with the same are one substitution apart. Role 1, the line itself, and role
    2, a deletion: a line of role 2 is one insertion longer than that of role 1 with the same key.
    """
    n = len(line)
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    c = (c + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    c ^= c >> np.uint64(32)
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * _powers(n))])
    after = before[-1] - before[1:]
    # The characters after a deleted one move up a place.
    gone = before[:-1] + after * INVERSE
    whole = before[-1]
    keys, roles = [], []
    for i, m in enumerate((n, n, n - 1, n - 1)):
        if not mask >> i & 1:
            continue
        h = m // 2
        at = np.arange(h, n) if i % 2 == 0 else np.arange(0, n - h)
        if m == n:
            keys += [_mix(gone[at] ^ (at.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)), n), _mix(np.array([whole]), -1)]
            roles += [np.zeros(len(at), np.int8), np.ones(1, np.int8)]
        else:
            keys.append(_mix(gone[at], -1)), roles.append(np.full(len(at), 2, np.int8))
    keys, roles = np.concatenate(keys), np.concatenate(roles)
    order = np.lexsort((roles, keys))
    keys, roles = keys[order], roles[order]
    first = np.append(True, (keys[1:] != keys[:-1]) | (roles[1:] != roles[:-1]))
    return keys[first].view(np.int64), roles[first]


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64((salt * 0xA24BAED4963EE407) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _rows(docs: DataFrame) -> DataFrame:
    """doc (null ids last), key (of id and text: rows that share an id are told apart by their text), text."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return fields(docs, doc=F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)), key=F.xxhash64(docs["doc_id"].cast("long"), text), text=text)


def _met(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """A join by sorting both sides.

    Spark sizes a side by its files and does not see what halves, variants or packed columns add: sides of many times the
    threshold would be broadcast through the driver.
    """
    return left.join(right.hint("merge"), on, how)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed, kept (the text of the lines that stay).

    A line goes if a line within one edit of it (a character inserted, deleted or replaced; or equal) comes earlier,
    by doc_id, then place in the document; lines of fewer than min_chars characters (by default the empty ones) always stay.
    Lines end at line feeds.

    Equal lines become one by a 128-bit hash. Lines that share half of their characters at the right place with another
    emit their deletion neighbourhoods as hashed keys; joined on equal keys, each line meets the earliest of its
    neighbours; edit distances of those are verified. Groups are reduced to their earliest line by partial minima: no
    pairs within a group are made and none is capped. Null texts count as empty. Rows with a null id come last. Rows
    that share an id (or have none) are documents of their own if their texts differ, in the order of a hash of the
    text; rows equal in id and text count as one document, and all come back as it does. An empty table gives no rows.
    """
    src = _rows(docs)
    schema = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("line", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("halves", pa.list_(pa.int64()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 512):
                rows = []
                for doc, key, text in zip(*(c.to_pylist() for c in b.slice(at, 512).columns)):
                    rows += [(doc, key, i, *_hashes(x), half_keys(x)) for i, x in enumerate(text.split("\n")) if len(x) >= min_chars]
                if rows:
                    yield batch(schema, *zip(*rows))

    lines = written(src.mapInArrow(cut, "doc long, key long, line int, h1 long, h2 long, halves array<long>"), "lines")
    place = F.struct("doc", "key", "line")
    distinct = lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.first("halves").alias("halves"))
    distinct = written(distinct, "distinct-lines")
    # A distinct line goes by its first place here; h1 tells whether a half is that of one line only.
    halved = distinct.select("first.doc", "first.key", "first.line", "h1", F.posexplode("halves").alias("i", "half"))
    shared = halved.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low <> high").select(F.col("half").alias("shared_half"))
    masks = _met(halved, shared, halved.half == shared.shared_half).groupBy("doc", "key", "line").agg(F.bit_or(F.element_at(F.array(*[F.lit(1 << x) for x in range(4)]), F.col("i") + 1)).alias("mask"))
    wanted = masks.groupBy(F.col("doc").alias("of"), F.col("key").alias("of_key")).agg(F.collect_list(F.struct("line", "mask")).alias("wanted"))
    found_schema = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("line", pa.int32()), ("mask", pa.int32()), ("text", pa.string())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 256):
                rows = []
                for doc, key, text, want in zip(*(c.to_pylist() for c in b.slice(at, 256).columns)):
                    parts = text.split("\n")
                    rows += [(doc, key, w["line"], w["mask"], parts[w["line"]]) for w in want]
                if rows:
                    yield batch(found_schema, *zip(*rows))

    found = _met(src, wanted, (src.doc == wanted.of) & (src.key == wanted.of_key)).select("doc", "key", "text", "wanted")
    found = found.mapInArrow(fetch, "doc long, key long, line int, mask int, text string")
    found = written(found.dropDuplicates(["doc", "key", "line"]), "candidate-lines")
    variant_schema = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("line", pa.int32()), ("role", pa.int8()), ("variant", pa.int64())])

    def vary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 256):
                c = b.slice(at, 256)
                done = [neighbourhood(t, m) for t, m in zip(c.column("text").to_pylist(), c.column("mask").to_pylist())]
                if not done:
                    continue
                size = [len(k) for k, _ in done]
                yield batch(variant_schema, *[np.repeat(c.column(x).to_numpy(), size) for x in ("doc", "key", "line")], np.concatenate([r for _, r in done]), np.concatenate([k for k, _ in done]))

    variants = found.mapInArrow(vary, "doc long, key long, line int, role tinyint, variant long")
    least = lambda role: F.min(F.when(F.col("role") == role, place))
    groups = variants.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), least(0).alias("of_0"), least(1).alias("of_1"), least(2).alias("of_2"))
    groups = groups.filter("n > 1 and (of_0 is not null or (of_1 is not null and of_2 is not null))").withColumnRenamed("variant", "group_key")
    met = _met(variants, groups, variants.variant == groups.group_key)
    other = F.when(F.col("role") == 0, F.col("of_0")).when(F.col("role") == 1, F.col("of_2")).otherwise(F.col("of_1"))
    pairs = met.select(place.alias("mine"), other.alias("other")).filter(F.col("other") < F.col("mine")).distinct()
    one, two = found.select(place.alias("at_1"), F.col("text").alias("x")), found.select(place.alias("at_2"), F.col("text").alias("y"))
    pairs = _met(_met(pairs, one, F.col("mine") == F.col("at_1")), two, F.col("other") == F.col("at_2"))
    near = pairs.filter(F.levenshtein("x", "y", 1) >= 0).groupBy("mine").agg(F.min("other").alias("near"))
    ahead = _met(distinct.select("h1", "h2", "first"), near, F.col("first") == F.col("mine"), "left")
    ahead = ahead.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.coalesce("near", "first").alias("ahead"))
    gone = _met(lines, ahead, (lines.h1 == ahead.a1) & (lines.h2 == ahead.a2)).filter(F.col("ahead") < place)
    gone = gone.groupBy(F.col("doc").alias("of"), F.col("key").alias("of_key")).agg(F.collect_set("line").alias("gone"))
    # Written, so that what led here is off the disks before whole texts are dealt out.
    gone = written(gone, "gone-lines")
    out_schema = pa.schema([("doc", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 256):
                rows = []
                for doc, text, drop in zip(*(c.to_pylist() for c in b.slice(at, 256).columns)):
                    parts, out = text.split("\n"), set(drop or ())
                    stay = [x for i, x in enumerate(parts) if i not in out]
                    rows.append((doc, len(parts), len(parts) - len(stay), "\n".join(stay)))
                yield batch(out_schema, *(zip(*rows) if rows else [[]] * 4))

    out = _met(src, gone, (src.doc == gone.of) & (src.key == gone.of_key), "left").select("doc", "text", "gone").mapInArrow(rebuild, "doc long, n_lines long, n_removed long, kept string")
    return out.select(F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "n_lines", "n_removed", "kept")
