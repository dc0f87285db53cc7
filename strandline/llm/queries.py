"""The queries of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    pieces = pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), length=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    counts = token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op3_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_stream import encode

    coded = encode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    ruled = quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("score").alias("anomaly_score"), F.col("score_all").alias("anomaly_score_all"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import held_out, identify, training_samples

    docs = read(spark, sf_dir, "documents")
    found = identify(docs, training_samples(docs.filter(~held_out(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "confident")


def op6_rans_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rans_files import read_token_files, write_token_files

    folder = write_token_files(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_dedup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op8_vp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vp_search import nearest

    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import without_repeats

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs, length=400).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm_scoring import score

    return score(read(spark, sf_dir, "documents"))


def op11_latent_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import held_out
    from .latent_voting import score

    found = score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), held_out(F.col("doc_id")))
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_in_middle import fill_in_middle, restored

    made = fill_in_middle(read(spark, sf_dir, "documents"), grammar="character")
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    count = lambda x: F.length(x).cast("long")
    return made.select("doc_id", "n", "form", count("prefix").alias("prefix_chars"), count("middle").alias("middle_chars"), digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_ball_k_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ball_k_means import ball_k_means

    return ball_k_means(read(spark, sf_dir, "embeddings"), k=40, rounds=5)


def fill_in_middle_sql() -> str:
    """Texts cut by code points; their rebuilt form is the text."""
    draw = lambda k: f"('0x' || substring(seed, {8 * k + 1}, 8))::BIGINT"
    return f"""
        WITH cut AS (
            SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS seed FROM documents),
        drawn AS (
            SELECT *, {draw(0)} % (n + 1) AS x, {draw(1)} % (n + 1) AS y,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {draw(2)} % 100 >= 90 THEN 'plain'
                    WHEN {draw(3)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM cut),
        parts AS (
            SELECT *, substring(t, 1, least(x, y)) AS p, substring(t, least(x, y) + 1, abs(x - y)) AS m, substring(t, greatest(x, y) + 1) AS s FROM drawn)
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
            sha256(t) AS restored_sha256
        FROM parts"""


def k_means_sql(k: int = 40, rounds: int = 5) -> str:
    """Each round in turn: all distances, the nearest centroid, exact means."""
    steps = [
        """kept AS (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"""c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v AS centre FROM kept QUALIFY c < {k})""",
    ]
    for t in range(rounds + 1):
        steps.append(f"""d{t} AS MATERIALIZED (SELECT r, c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - centre[i]) * (v[i] - centre[i])))::BIGINT AS d FROM kept, c{t})""")
        steps.append(f"""a{t} AS MATERIALIZED (SELECT r, arg_min(c, d::HUGEINT * {k} + c) AS c, min(d) AS d FROM d{t} GROUP BY r)""")
        if t < rounds:
            part = "(SELECT c, i, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT a.c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept JOIN a{0} a USING (r)) GROUP BY c, i)".format(t)
            mean = "(s - ((s % n) + n) % n) // n"
            steps.append(f"""c{t + 1} AS MATERIALIZED (
                SELECT o.c, coalesce(m.centre, o.centre) AS centre FROM c{t} o
                LEFT JOIN (SELECT c, list(({mean})::BIGINT ORDER BY i) AS centre FROM {part} GROUP BY c) m USING (c))""")
    return f"""
        WITH {", ".join(steps)}
        SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
            sha256(array_to_string(centre, ',')) AS centroid_sha256
        FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} USING (c)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op12_fill_in_middle": fill_in_middle_sql(), "op13_ball_k_means": k_means_sql()}
