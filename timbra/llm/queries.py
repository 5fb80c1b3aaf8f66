"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_report

    return mix_report(documents(spark, sf_dir))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_report

    return secret_report(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identified

    return identified(spark.read.parquet(f"{sf_dir}/pages.parquet"), documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_report

    return quality_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_report

    return dedup_report(documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_report

    return simhash_report(documents(spark, sf_dir))


def op4_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .brown import lm_report

    return lm_report(documents(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encoded

    return encoded(documents(spark, sf_dir), digests=True)


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import repeat_report

    return repeat_report(documents(spark, sf_dir))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import minhash_report

    return minhash_report(documents(spark, sf_dir), words=3, percent=85)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codes import compressed

    return compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where vec_id is divisible by 7, the label first becomes the next one of ten."""
    from .negatives import hard_negatives

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", "embedding", label.alias("label")))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_language_id, op3_quality_rules, op4_brown_lm, op5_bpe, op6_mix_sources, op7_line_dedup, op8_top_k, op9_simhash, op10_suffix_dedup, op11_minhash, op12_vector_codes, op13_hard_negatives)}
#: Vectors as DuckDB lists of integers.
WHOLE = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def vector_codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Lloyd's rounds one after the other: entries (part, entry, place, c), then assignments."""
    steps = [f"""
        WITH {WHOLE},
        d AS (SELECT len(e) // {parts} AS w FROM v LIMIT 1),
        p AS MATERIALIZED (SELECT vec_id, label, CAST(part AS INTEGER) AS part, e[part * w + 1:(part + 1) * w] AS x FROM v, d, range({parts}) AS r(part)),
        c0 AS (SELECT part, entry, x AS c FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v) USING (vec_id) WHERE entry < {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""
        f{k} AS (SELECT vec_id, p.label, p.part, p.x, c{k}.entry, list_sum(list_transform(list_zip(p.x, c{k}.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far FROM p JOIN c{k} ON p.part = c{k}.part),
        a{k} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, part, any_value(x) AS x, min(struct_pack(far := CAST(far AS BIGINT), entry := entry)) AS best FROM f{k} GROUP BY vec_id, part)""")
        if k < rounds:
            steps.append(f"""
        m{k} AS (SELECT part, best.entry AS entry, place, CAST(floor(sum(x[place]) / count(*)) AS BIGINT) AS c FROM a{k}, d, range(1, w + 1) AS r(place) GROUP BY part, best.entry, place),
        n{k} AS (SELECT part, entry, list(c ORDER BY place) AS c FROM m{k} GROUP BY part, entry),
        c{k + 1} AS MATERIALIZED (SELECT c{k}.part, c{k}.entry, coalesce(n{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN n{k} ON c{k}.part = n{k}.part AND c{k}.entry = n{k}.entry)""")
    steps.append(f"""
        h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS digest FROM c{rounds}),
        o AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM o, h""")
    return ",".join(steps[:-1]) + "," + steps[-1]


SQL: dict[str, str] = {
    "op7_line_dedup": f"""
        WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        n AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM l),
        k AS (SELECT doc_id, pos, line, trim(translate(line, '{UPPER}', lower('{UPPER}')), {BLANKS}) AS key FROM n),
        g AS (SELECT key, min(doc_id) AS least FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
        m AS (SELECT doc_id, pos, line, coalesce(doc_id > least, false) AS gone FROM k LEFT JOIN g USING (key))
        SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op8_top_k": f"""
        WITH {WHOLE},
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_suffix_dedup": """
        WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
        w AS (SELECT doc_id, pos, b[pos:pos + 49] AS s FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS pos FROM b)),
        g AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING count(*) > 1),
        r AS (SELECT doc_id, pos, coalesce(pos > lag(pos) OVER d + 50, true) AS opens FROM w JOIN g USING (s) WHERE doc_id > least WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
        i AS (SELECT doc_id, pos, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM r),
        spans AS (SELECT doc_id, min(pos) AS a, max(pos) + 50 AS z FROM i GROUP BY doc_id, run),
        p AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS a, a AS z, 1 AS span, z - a AS gone FROM spans
              UNION ALL SELECT b.doc_id, coalesce(max(z), 1), any_value(octet_length(b)) + 1, 0, 0 FROM b LEFT JOIN spans USING (doc_id) GROUP BY b.doc_id)
        SELECT doc_id, any_value(octet_length(b)) AS n_bytes, CAST(sum(gone) AS BIGINT) AS n_removed, CAST(sum(span) AS BIGINT) AS n_spans,
               sha256(unhex(string_agg(hex(b[p.a:p.z - 1]), '' ORDER BY p.a, p.z))) AS kept_sha256 FROM p JOIN b USING (doc_id) GROUP BY doc_id""",
    "op11_minhash": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', lower('{UPPER}')), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                                                  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
        reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN links ON other = x),
        least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN n USING (doc_id)""",
    "op12_vector_codes": vector_codes_sql(),
    "op13_hard_negatives": f"""
        WITH {WHOLE},
        l AS (SELECT vec_id, e, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM v WHERE label IS NOT NULL),
        s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM l a JOIN l c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
              FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 30 * positive_score AND 90 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}
