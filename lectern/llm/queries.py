"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import table


def vocabulary() -> str:
    """The vocabulary file that the queries use; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_model() -> str:
    """The model file of pieces that the queries use; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.suffix_dedup import removed_passages

    return removed_passages(table(spark, sf_dir, "documents"), left="").drop("kept")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.quality import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.warc import through_archives

    return through_archives(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary())


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.url_filter import judged_urls

    return judged_urls(table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op9_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.bit_sliced import top_products

    return top_products(table(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.piece_bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), piece_model())


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.vector_codes import compressed

    return compressed(table(spark, sf_dir, "embeddings"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.alignment import aligned

    return aligned(table(spark, sf_dir, "documents"), vocabulary(), piece_model()).documents


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_bpe": op2_bpe,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality": op4_quality,
    "op5_warc": op5_warc,
    "op6_packing": op6_packing,
    "op7_url_filter": op7_url_filter,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_bit_sliced": op9_bit_sliced,
    "op10_simhash": op10_simhash,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_vector_codes": op12_vector_codes,
    "op13_alignment": op13_alignment,
}

def vector_codes_sql(rounds: int = 6) -> str:
    """The rounds of the codebooks, one after the other."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""
        a{n} AS MATERIALIZED (
          SELECT p.vec_id, p.part, any_value(p.x) AS x,
                 min(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 16 + b.entry) AS near
          FROM p JOIN b{n} b USING (part) GROUP BY p.vec_id, p.part
        )""")
        if n < rounds:
            steps.append(f"""
        s{n} AS (
          SELECT part, near % 16 AS entry, i, sum(x[i]) AS total, count(*) AS n
          FROM a{n}, unnest(range(1, len(x) + 1)) t(i) GROUP BY part, near % 16, i
        ),
        m{n} AS (
          SELECT part, entry, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{n} GROUP BY part, entry
        ),
        b{n + 1} AS MATERIALIZED (
          SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN m{n} m ON b.part = m.part AND b.entry = m.entry
        )""")
    return f"""
        WITH v AS (
          SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        p AS MATERIALIZED (
          SELECT vec_id, part, c[part * (len(c) // 8) + 1 : (part + 1) * (len(c) // 8)] AS x FROM v, range(8) t(part)
        ),
        b0 AS MATERIALIZED (
          SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p QUALIFY entry < 16
        ),{",".join(steps)},
        e AS (
          SELECT vec_id, string_agg(printf('%02x', CAST(near % 16 AS BIGINT)), '' ORDER BY part) AS code, CAST(sum(near // 16) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id
        )
        SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
        FROM e JOIN v USING (vec_id)
    """


#: Equivalent SQL, where SQL can say it.
SQL: dict[str, str] = {
    "op12_vector_codes": vector_codes_sql(),
    "op5_warc": """
        WITH p AS (
          SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
          SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to, true AS intact
        FROM f
    """,
    "op9_bit_sliced": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS code
          FROM embeddings
          WHERE embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                 CASE WHEN len(q.code) = 0 THEN 0 ELSE CAST(list_dot_product(CAST(q.code AS DOUBLE[]), CAST(c.code AS DOUBLE[])) AS BIGINT) END AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.code) = len(c.code) WHERE q.vec_id % 100 = 0
        ), r AS (
          SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op8_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, length(coalesce(text, '')) AS chars,
                 regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body
          FROM documents
        )
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, sha256(body) AS text_sha256, chars
        FROM d WINDOW w AS (PARTITION BY body ORDER BY chars DESC, doc_id)
    """,
}
