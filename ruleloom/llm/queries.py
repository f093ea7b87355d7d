"""Queries over the operators of this subpackage, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    return archive_pages(_table(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ctw import score

    return score(_table(spark, sf_dir, "documents"))


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import held_out
    from .ppm import identify

    docs = _table(spark, sf_dir, "documents")
    return identify(docs, docs.filter(~held_out(docs["doc_id"], 4))).withColumn("held_out", held_out(F.col("doc_id"), 4))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import scaled, top_k

    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors.select("vec_id", scaled(vectors["embedding"]).alias("v")), F.col("vec_id") % 20 == 0)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode

    out = encode(_table(spark, sf_dir, "documents"), n_best=3)
    other = [F.try_element_at("alternatives", F.lit(i)) for i in (1, 2)]
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.element_at("scores", 1).alias("score"),
        F.try_element_at("scores", F.lit(2)).alias("score_2"), F.try_element_at("scores", F.lit(3)).alias("score_3"), "decodes",
        *[F.when(x.isNotNull(), F.xxhash64(x)).alias(f"ids_hash_{i}") for i, x in enumerate(other, 2)],
    )


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_dedup

    return near_dedup(_table(spark, sf_dir, "documents"), n=4).drop("text_key")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"), keep="largest")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_dedup

    out = line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_mixing": op1_mixing, "op2_warc": op2_warc, "op3_suffix_dedup": op3_suffix_dedup, "op4_ctw": op4_ctw, "op5_ppm": op5_ppm,
    "op6_top_k": op6_top_k, "op7_pieces": op7_pieces, "op8_near_dedup": op8_near_dedup, "op9_exact_dedup": op9_exact_dedup,
    "op10_line_dedup": op10_line_dedup, "pipeline": pipeline,
}

SQL = {
    # Every start of a document's bytes (as hex) with a digest of the 200 bytes from there.
    "op3_suffix_dedup": """
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        p AS (SELECT row, unnest(list_transform(range(0, length(h) // 2), lambda i: {'i': i, 'b': substring(h, 2 * i + 1, 2),
              'k': CASE WHEN i + 200 <= length(h) // 2 THEN md5_number(substring(h, 2 * i + 1, 400)) END})) AS x FROM d),
        g AS (SELECT row, x.i AS i, x.b AS b, x.k IS NOT NULL AND count(*) OVER (PARTITION BY x.k) > 1 AS again FROM p),
        c AS (SELECT row, i, b, bool_or(again) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM g),
        s AS (SELECT row, i, b, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY row ORDER BY i), false) AS opens FROM c),
        r AS (SELECT row, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept FROM s GROUP BY row)
        SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN r USING (row)""",
    # Pairs of different sets by the shingles they share; then all that is reachable over links.
    "op8_near_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
              ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id),
        c AS (SELECT k, min(doc_id) AS id, any_value(n) AS n FROM n GROUP BY k),
        o AS (SELECT s.* FROM s JOIN c ON c.id = s.doc_id),
        x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM o a JOIN o b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM x JOIN c ca ON ca.id = a JOIN c cb ON cb.id = b WHERE 100 * m >= 80 * (ca.n + cb.n - m)),
        u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r AS (SELECT id AS a, id AS b FROM c UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
        f AS (SELECT k, min(r.b) AS component FROM c JOIN r ON r.a = c.id GROUP BY k)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(f.component, d.doc_id) AS component_id, coalesce(f.component, d.doc_id) = d.doc_id AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN f USING (k)""",
    # A line, its deletions, and lines that share a deletion at the same place.
    "op10_line_dedup": """
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
        l AS (SELECT doc_id, unnest(p) AS x, unnest(range(len(p))) AS i FROM d),
        f AS (SELECT x, min(doc_id * 1000000 + i) AS first FROM l WHERE x <> '' GROUP BY x),
        v AS (SELECT x, first, j, substring(x, 1, j - 1) || substring(x, j + 1) AS y FROM (SELECT x, first, unnest(range(1, length(x) + 1)) AS j FROM f)),
        g AS (SELECT y, j, min(first) AS first FROM v GROUP BY ALL),
        n AS (SELECT x, first FROM f UNION ALL SELECT v.x, g.first FROM v JOIN g USING (y, j)
              UNION ALL SELECT v.x, f.first FROM v JOIN f ON f.x = v.y UNION ALL SELECT f.x, v.first FROM v JOIN f ON f.x = v.y),
        m AS (SELECT x, min(first) AS ahead FROM n GROUP BY x),
        o AS (SELECT doc_id, l.x, i, coalesce(ahead < doc_id * 1000000 + i, false) AS gone FROM l LEFT JOIN m USING (x))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM o GROUP BY doc_id""",
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g USING (t)""",
    "op6_top_k": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
              FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        f AS (SELECT h, min(page_id) AS first_id FROM p WHERE strlen(h) >= 100 GROUP BY h)
        SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha256(p.h) AS payload_digest,
               CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f USING (h)""",
}
