"""Registered queries of this subpackage: each operator over whole tables with production parameters, and SQL where it can say the same."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import ball_kmeans, bpe, exact_dedup, gif, language, licenses, multiset_hash, packing, periodic_runs, quality, sharding, simhash, substring_dedup
from riskweave.llm.common import documents

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(documents(spark, sf_dir)))


def op2_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(documents(spark, sf_dir))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = bpe.decode(bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), ranks, keep=False), ranks)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language.fit(docs.where(~held_out))
    main = language.main_language(F.col("spans"), model.languages)
    rows = language.label_spans(docs, model).withColumn("main", main).withColumnRenamed("id", "doc_id")
    return rows.select("doc_id", held_out.alias("held_out"), F.col("main.lang").alias("lang_pred"), F.col("main.share").alias("score"), F.size("spans").alias("n_spans"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir), keep="max")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_classes(documents(spark, sf_dir))
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_gif_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = documents(spark, sf_dir).select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), gif.padded(F.col("text")).alias("samples"))
    stored = gif.encode(docs, "samples", keep=False)
    read = gif.decode(stored).withColumn("payload", gif.grey_samples(F.col("frames"), F.col("canvas_width")))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        gif.described(F.col("frames")).alias("feature"),
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return substring_dedup.drop_repeats(docs, report=("spans_removed", "chars_removed"))


def op9_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rows.select(F.col("id").alias("doc_id"), "tokens", "log_weight", "worst", "value", "selected")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op11_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = multiset_hash.edited_fingerprints(documents(spark, sf_dir))
    own, edited, following = F.col("lanes"), F.col("edited_lanes"), F.col("next_lanes")
    like = multiset_hash.likeness
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", multiset_hash.text_form(own).alias("fingerprint"), multiset_hash.text_form(edited).alias("edited_fingerprint"),
        like(own, edited).alias("near_edited"), like(own, following).alias("near_next"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", periodic_runs.planted(F.col("text"), F.col("doc_id")).alias("text"))
    rows = periodic_runs.find_runs(docs).withColumn("best", periodic_runs.strongest(F.col("runs")))
    best = F.col("best")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(periodic_runs.lines(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.summary(ball_kmeans.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


QUERIES = {
    "op1_license_scans": op1_license_scans,
    "op2_rendezvous_sharding": op2_rendezvous_sharding,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_language_id": op4_language_id,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_gif_frames": op7_gif_frames,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_resampling": op9_quality_resampling,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_multiset_hash": op11_multiset_hash,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_ball_kmeans": op13_ball_kmeans,
}

def _op11_sql() -> str:
    """Both texts are hashed whole here, word pair by word pair."""
    number = lambda x, at: f"('0x' || substr({x}, {at}, 8))::BIGINT"
    exact = [f"coalesce(sum({number('sha', 1 + 8 * i)}), 0)" for i in range(multiset_hash.EXACT)]
    signs = [f"coalesce(sum(({x} >> {i}) & 1), 0)" for x in ("lo", "hi") for i in range(multiset_hash.SIGNS // 2)]
    sums = ", ".join(f"({x} % 4294967296)::BIGINT" for x in [*exact, "count(md)", *signs])
    first, last = multiset_hash.EXACT + 2, multiset_hash.LANES
    signed = lambda v: f"list_transform({v}[{first}:{last}], lambda c: (2 * c - {v}[{first - 1}])::DOUBLE)"
    dot = lambda x, y: f"list_dot_product({x}, {y})"
    like = lambda x, y, a, b: f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {dot(x, x)} * {dot(y, y)} = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, {dot(x, y)} / sqrt({dot(x, x)} * {dot(y, y)}))) END"
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
        f AS (SELECT *, coalesce(lead(t) OVER o, first_value(t) OVER o) AS u, coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id FROM d WINDOW o AS (ORDER BY doc_id)),
        e AS (SELECT doc_id, next_id, n, t, left(t, n - n // 2) || left(u, n // 2) AS edited FROM f),
        sides AS (SELECT doc_id, 0 AS side, t FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
        paragraphs AS (SELECT doc_id, side, p, list_filter(regexp_split_to_array(p, '[\x09-\x0D ]+'), lambda w: w <> '') AS w
                       FROM (SELECT doc_id, side, unnest(string_split(t, chr(10))) AS p FROM sides) WHERE p <> ''),
        pairs AS (SELECT doc_id, side, NULL AS sha, md5(unnest(list_transform(range(1, len(w) + 1), lambda i: w[i] || ' ' || coalesce(w[i + 1], '')))) AS md FROM paragraphs
                  UNION ALL SELECT doc_id, side, sha256(p), NULL FROM paragraphs
                  UNION ALL SELECT doc_id, side, NULL, NULL FROM sides),
        bits AS (SELECT doc_id, side, sha, md, {number('md', 1)} AS lo, {number('md', 9)} AS hi FROM pairs),
        lanes AS (SELECT doc_id, side, [{sums}] AS v FROM bits GROUP BY ALL),
        signed AS (SELECT doc_id, side, v, {signed('v')} AS x, array_to_string(list_transform(v, lambda c: printf('%08x', c)), '') AS fp FROM lanes)
        SELECT e.doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint,
               {like('a.x', 'b.x', 'a.v', 'b.v')} AS near_edited, {like('a.x', 'c.x', 'a.v', 'c.v')} AS near_next
        FROM e JOIN signed a ON a.doc_id = e.doc_id AND a.side = 0 JOIN signed b ON b.doc_id = e.doc_id AND b.side = 1 JOIN signed c ON c.doc_id = next_id AND c.side = 0"""


def _op13_sql(k: int = 8, rounds: int = 10) -> str:
    """Every round compares all vectors with all centroids."""
    steps = [f"""
        v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
              WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
        c0 AS MATERIALIZED (SELECT n - 1 AS c, x FROM (SELECT x, row_number() OVER (ORDER BY sha256('3:' || vec_id), x) AS n FROM v) WHERE n <= {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
        d{i} AS (SELECT vec_id, v.x, c, list_sum(list_transform(list_zip(v.x, c{i}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN c{i}),
        a{i} AS MATERIALIZED (SELECT vec_id, x, c, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, x ORDER BY d, c) AS n FROM d{i}) WHERE n = 1)""")
        if i < rounds:
            steps.append(f"""
        m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS x FROM (SELECT c, pos, sum(y)::BIGINT AS s, count(*) AS n FROM
                 (SELECT c, unnest(x) AS y, unnest(range(64)) AS pos FROM a{i}) GROUP BY ALL) GROUP BY c),
        c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (c))""")
    return f"""
        WITH {",".join(steps)}
        SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"""


ORACLE_SQL = {
    "op5_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op11_multiset_hash": _op11_sql(),
    "op13_ball_kmeans": _op13_sql(),
}
