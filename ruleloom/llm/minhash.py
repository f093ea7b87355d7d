"""Near-dedup by min-max hashing: minimum and maximum under each permutation, banded, links confirmed on full sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, fields, text_bytes, words, written
from .components import components

#: Pairs at the threshold of 0.8 share none of 40 bands of 5 with probability (1 - 0.8**5)**40 = 1.3e-7.
BANDS, ROWS = 40, 5
#: Two sets of similarity 0.8 agree in 160 of 200 extremes on average (standard deviation 5.7): in fewer than these parts
#: of them with a probability below 1e-10. Only such pairs are spared the comparison of their whole sets.
AGREE = 0.6


def shingle_set(payload: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; the whole sequence is one where there are fewer words."""
    w = words(payload)
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    k, out = min(n, len(h)), np.full(max(len(h) - n + 1, 1), len(h) if len(h) < n else n, np.uint64)
    for i in range(k):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ h[i : i + len(out)]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


class MinMax:
    """Bands of a set's signature: half of them of minima, half of maxima, under bands * rows / 2 permutations."""

    def __init__(self, bands: int, rows: int, seed: int = 8):
        rng, n = np.random.default_rng(seed), -(-bands // 2) * rows
        self.a = rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, n, np.uint64)
        self.bands, self.rows = bands, rows

    def signature(self, s: np.ndarray) -> np.ndarray:
        low, high = np.full(len(self.a), 2**64 - 1, np.uint64), np.zeros(len(self.a), np.uint64)
        for at in range(0, len(s), 4096):
            h = np.multiply.outer(self.a, s[at : at + 4096])
            h += self.b[:, None]
            np.minimum(low, h.min(1), out=low)
            np.maximum(high, h.max(1), out=high)
        return np.concatenate([low, high])

    def keys(self, signature: np.ndarray) -> list[int]:
        parts = signature.reshape(-1, self.rows)[: self.bands]
        return [xxhash.xxh3_64_intdigest(p.tobytes(), i) - 2**63 for i, p in enumerate(parts)]

    def sketch(self, s: np.ndarray) -> tuple[bytes, bytes]:
        """A byte of each extreme, and 32 bits of each band's key."""
        signature = self.signature(s)
        return (signature >> np.uint64(24)).astype(np.uint8).tobytes(), np.array(self.keys(signature), np.int64).astype(np.uint32).tobytes()


def class_of(s: np.ndarray) -> int:
    """Key of a set: 64 bits of a hash of its members."""
    return int.from_bytes(hashlib.md5(s.tobytes()).digest()[:8], "little", signed=True)


def _signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, n_shingles, class (key of the set), bands (array); class and bands null where the set is empty."""
    src = fields(docs, doc_id=docs["doc_id"].cast("long"), body=text_bytes(docs), text_key=F.xxhash64(docs["text"]))
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinMax(bands, rows)
        for b in batches:
            size, classes, keys = [], [], []
            for body in b.column(1).to_pylist():
                s = shingle_set(body, n)
                size.append(len(s))
                classes.append(class_of(s) if len(s) else None)
                keys.append(hasher.keys(hasher.signature(s)) if len(s) else None)
            yield batch(schema, b.column(0), b.column(2), size, classes, keys)

    return src.mapInArrow(sign, "doc_id long, text_key long, n_shingles long, class long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """class, size, shingles of the sets named in wanted (class, id of a document)."""
    src = fields(docs, doc_id=docs["doc_id"].cast("long"), body=text_bytes(docs))
    schema = pa.schema([("class", pa.int64()), ("size", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 500):
                sets = [s for s in (shingle_set(x, n) for x in b.column(1).slice(at, 500).to_pylist()) if len(s)]
                yield batch(schema, [class_of(s) for s in sets], [len(s) for s in sets], [s.view(np.int64) for s in sets])

    found = src.join(wanted.select("id").distinct(), src.doc_id == F.col("id"), "left_semi").mapInArrow(cut, "class long, size long, shingles array<long>")
    # Rows that share an id bring sets that nobody asked for.
    return found.join(wanted.select(F.col("class").alias("class_")), F.col("class") == F.col("class_"), "left_semi").dropDuplicates(["class"])


def _sketches(sets: DataFrame, bands: int, rows: int) -> DataFrame:
    """class_, size, sketch, prints (of the bands' keys) of sets."""
    schema = pa.schema([("class_", pa.int64()), ("size", pa.int64()), ("sketch", pa.binary()), ("prints", pa.binary())])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinMax(bands, rows)
        for b in batches:
            done = [hasher.sketch(s.values.to_numpy().view(np.uint64)) for s in b.column(2)]
            yield batch(schema, b.column(0), b.column(1), [x for x, _ in done], [x for _, x in done])

    return sets.mapInArrow(draw, "class_ long, size long, sketch binary, prints binary")


def askable(ids: np.ndarray, comp: np.ndarray, size: np.ndarray, sketch: np.ndarray, prints: np.ndarray, band: int, home: np.ndarray, cross: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of members of a block (positions) that may be links between components and no earlier band has.

    They lie in different components, across the block (cross: which side of it a member is on; any pair if there is
    one side), not both away from home, are near enough in size, and their sketches agree often enough.
    """
    ask = (comp[:, None] != comp[None, :]) & (ids[:, None] < ids[None, :]) & (home[:, None] | home[None, :])
    if cross.any() and not cross.all():
        ask &= cross[:, None] != cross[None, :]
    ask &= np.minimum.outer(size, size) * 100 >= np.maximum.outer(size, size) * percent
    pairs, least = np.argwhere(ask), math.floor(AGREE / 0.8 * percent / 100 * sketch.shape[1])
    out = []
    for at in range(0, len(pairs), 16_384):
        i, j = pairs[at : at + 16_384].T
        fresh = ~(prints[i, :band] == prints[j, :band]).any(1)
        i, j = i[fresh], j[fresh]
        fit = (sketch[i] == sketch[j]).sum(1, dtype=np.uint16) >= least
        out.append(np.stack([i[fit], j[fit]], 1))
    return np.concatenate(out) if out else pairs


def block_links(pairs: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Those of the pairs (positions) whose whole sets are similar enough."""
    m, size = len(sets), np.array([len(x) for x in sets], np.int64)
    if not len(pairs):
        return pairs
    if len(pairs) < 4 * m:
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs.tolist()])
        return pairs[100 * common >= percent * (size[pairs].sum(1) - common)]
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    who = np.repeat(np.arange(m), size)
    often = n[at] > 1
    column = np.cumsum(n > 1) - 1
    who, at, width = who[often], column[at[often]], int((n > 1).sum())
    common, order = np.zeros((m, m), np.float32), np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    for c in range(0, width, 4096):
        i, j = np.searchsorted(at, [c, c + 4096])
        part = np.zeros((m, min(4096, width - c)), np.float32)
        part[who[i:j], at[i:j] - c] = 1
        common += part @ part.T
    common = common[pairs[:, 0], pairs[:, 1]].astype(np.int64)
    return pairs[100 * common >= percent * (size[pairs].sum(1) - common)]


def near_dedup(docs: DataFrame, n: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, chunk: int = 1024) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable over links), kept, text_key.

    Documents are linked if 100 * intersection >= percent * union of their sets of n-word shingles (64-bit hashes of
    lower-cased words); empty sets (null, empty or blank texts) link with nothing. Equal sets are one class, so copies
    cost one row. Classes that share a band are candidates: in each band one class is compared with the others (a
    star). Members of a band that are still in different components are then compared in blocks of `chunk` members of
    like size. A block is first given a sketch of each member, a byte for each of its extremes, and tells which members
    may be linked with another; whole sets go only to blocks that have such members. A block computes all their
    intersections at once and gives out links only. So no pairs are made as rows, no bucket is capped and no link
    between components is lost but by the chance that BANDS and AGREE tell.

    Rows that share an id are documents of their own, by their texts (text_key is a hash that tells them apart). Rows with a null id link with nothing and are
    kept, with a null component. An empty table gives no rows.
    """
    signed = written(_signed(docs, n, bands, rows), "signed")
    classes = signed.filter("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")
    banded = classes.select("class", "id", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("band", "key").agg(F.min("class").alias("hub"), F.max("class").alias("high")).filter("hub <> high")
    shared = shared.select(F.col("band").alias("band_"), F.col("key").alias("key_"), "hub")
    member = banded.join(shared, (banded.band == shared.band_) & (banded.key == shared.key_)).select("class", "id", "band", "key", "hub")
    member = written(member, "members")
    sets = written(_sets(docs, member.select("class", "id").distinct(), n), "sets")
    one, two = sets.select(F.col("class").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("class").alias("b"), F.col("shingles").alias("y"))
    star = member.filter("class <> hub").select(F.col("class").alias("a"), F.col("hub").alias("b")).distinct()
    both = star.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    links = both.filter((F.size("x") + F.size("y") - F.col("common")) * percent <= F.col("common") * 100).select("a", "b")
    links = written(links, "links")
    first = written(components(links).select(F.col("id").alias("of"), "component"), "components")
    # Two sets can only be linked if their sizes lie in the same range or in adjoining ones: a member is at home in the
    # cell of its own range and a guest in the next.
    width = math.log(100 / percent) * 1.0001 + 1e-6
    sized = sets.select(F.col("class").alias("class_"), "size", F.floor(F.log("size") / width).cast("int").alias("range"))
    now = member.join(first, F.col("class") == F.col("of"), "left").join(sized, F.col("class") == F.col("class_"))
    now = now.select("class", "band", "key", F.coalesce("component", "class").alias("comp"), "range", F.explode(F.array(F.col("range"), F.col("range") + 1)).alias("cell"))
    apart = now.groupBy("band", "key", "cell").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    apart = apart.filter("low <> high").select(F.col("band").alias("band_"), F.col("key").alias("key_"), F.col("cell").alias("cell_"), "chunks")
    rest = now.join(apart, (now.band == apart.band_) & (now.key == apart.key_) & (now.cell == apart.cell_)).withColumn("own", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
    rest = rest.select("class", "band", "key", "cell", "comp", (F.col("cell") == F.col("range")).alias("home"), "own", "chunks")
    rest = written(rest, "rest")
    left = rest.select(F.col("class").alias("class_")).distinct()
    sketches = written(_sketches(sets.join(left, F.col("class") == F.col("class_"), "left_semi").select("class", "size", "shingles"), bands, rows), "sketches")
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    rest_ddl = "class long, band int, key long, cell int, comp long, home boolean, i int, j int, own int, size long, sketch binary, prints binary"
    block = ["band", "key", "cell", "i", "j"]
    link_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(key, part):
        ids, rows_ = part.column("class").to_numpy(), lambda c, kind: np.frombuffer(b"".join(part.column(c).to_pylist()), kind).reshape(len(part), -1)
        i, j = key[3].as_py(), key[4].as_py()
        cross = part.column("own").to_numpy() == i if i != j else np.ones(len(ids), bool)
        home = np.array(part.column("home").to_pylist(), bool)
        return askable(ids, part.column("comp").to_numpy(), part.column("size").to_numpy(), rows_("sketch", np.uint8), rows_("prints", np.uint32), key[0].as_py(), home, cross, percent)

    def scan(key, part):
        return part.take(pa.array(np.unique(pairs(key, part))))

    def compare(key, part):
        ids = part.column("class").to_numpy()
        flat = part.column("shingles").combine_chunks().flatten().to_numpy()
        ends = np.cumsum(part.column("size").to_numpy())
        found = block_links(pairs(key, part), np.split(flat, ends[:-1]), percent)
        return pa.Table.from_batches([batch(link_schema, ids[found[:, 0]], ids[found[:, 1]])])

    rest = rest.join(sketches, F.col("class") == F.col("class_")).drop("class_").select(*[x.split()[0] for x in rest_ddl.split(", ")])
    rest = written(rest.groupBy(*block).applyInArrow(scan, rest_ddl), "candidates")
    whole = sets.select(F.col("class").alias("class_"), "shingles")
    rest = rest.join(whole, F.col("class") == F.col("class_")).drop("class_")
    more = written(rest.groupBy(*block).applyInArrow(compare, "a long, b long"), "links")
    reps = classes.select(F.col("class").alias("class_"), "id")
    if links.isEmpty() and more.isEmpty():
        reps = reps.withColumnRenamed("id", "component_id")
    else:
        comp = first if more.isEmpty() else written(components(links.union(more)).select(F.col("id").alias("of"), "component"), "components")
        reps = reps.join(comp, F.col("class_") == F.col("of"), "left").select("class_", "id", F.coalesce("component", "class_").alias("comp"))
        least = reps.groupBy(F.col("comp").alias("comp_")).agg(F.min("id").alias("component_id"))
        reps = reps.join(least, F.col("comp") == F.col("comp_")).select("class_", "component_id")
    out = signed.select("doc_id", "text_key", "n_shingles", "class")
    out = out.join(reps, (F.col("class") == F.col("class_")) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "text_key")
