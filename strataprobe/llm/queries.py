"""The registered queries of the training-data operators and their SQL.

Each takes (spark, sf_dir) and runs over the whole of its tables.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, quality, toxicity
from .decontamination import contaminations
from .exact_dedup import deduplicate_exact
from .jaccard_join import jaccard_classes
from .license_scan import scan_licenses
from .license_templates import TEMPLATES
from .mixing import mix_sources
from .sharding import shard_documents
from .token_counts import count_tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("window_word")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), keep_columns=False)
    return mixed.select("doc_id", "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), "target", "taken")


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), [(i, 1.0) for i in range(8)], grown=(8, 1.0), keep_columns=False)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate_exact(spark, f"{sf_dir}/documents.parquet")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out("doc_id", 5, 0)))
    scored = docs.select("doc_id", "text", toxicity.held_out("doc_id", 5, 0).alias("held_out"))
    return toxicity.score_toxicity(scored, model).select("doc_id", "held_out", "score", "predicted")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify_quality(docs, *quality.fit(docs)).drop("text")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def path() -> str:  # called where the tokenizer is opened
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")

    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), path, limit=512).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), k=3, threshold=Fraction(9, 10)).withColumnRenamed("id", "doc_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.held_out("doc_id", 4, 2)
    model = language_id.fit(docs.where(~out))
    return language_id.identify(docs.select("doc_id", "text", out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_mix_sources": op2_mix_sources,
    "op3_shard": op3_shard,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_decontamination": op6_decontamination,
    "op7_token_counts": op7_token_counts,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_language_id": op10_language_id,
}


def _containment_sql(items: str) -> str:
    """doc_id, item_id, n, shared of documents that hold four fifths of an item's five-word shingles; of items of fewer words, the whole sequence."""
    words = r"regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
        WITH words AS (SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, {words} AS w FROM documents UNION ALL SELECT 'i', CAST(item_id AS VARCHAR), {words} FROM {items}),
        grams AS (SELECT DISTINCT kind, id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT kind, id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
        sizes AS (SELECT id, count(*) AS n FROM grams WHERE kind = 'i' GROUP BY id),
        lines AS (SELECT kind, id, len(w) AS n, ' ' || array_to_string(w, ' ') || ' ' AS line FROM words WHERE len(w) > 0),
        found AS (SELECT CAST(d.id AS BIGINT) AS doc_id, i.id AS item_id, s.n, count(*) AS shared FROM grams i JOIN grams d ON d.kind = 'd' AND i.kind = 'i' AND d.g = i.g JOIN sizes s ON s.id = i.id
                  GROUP BY d.id, i.id, s.n HAVING count(*) * 5 >= s.n * 4
                  UNION ALL SELECT CAST(d.id AS BIGINT), i.id, 1, 1 FROM lines i JOIN lines d ON d.kind = 'd' AND i.kind = 'i' AND i.n < 5 AND contains(d.line, i.line))
    """


_WORDINGS = "(VALUES " + ", ".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, text in TEMPLATES.items()) + ") AS wording(item_id, text)"

ORACLES: dict[str, str] = {
    "op1_license_scan": _containment_sql(_WORDINGS)
    + "SELECT doc_id, split_part(item_id, '/', 1) AS license, split_part(item_id, '/', 2) AS wording, n AS n_template_shingles, shared AS n_shared, shared / n::DOUBLE AS containment FROM found",
    "op6_decontamination": _containment_sql("benchmark") + "SELECT doc_id, CAST(item_id AS BIGINT) AS item_id, n AS n_item_shingles, shared AS n_shared, shared / n::DOUBLE AS containment FROM found",
    "op9_jaccard_join": r"""
        WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
        links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b USING (g) JOIN sizes s ON s.doc_id = a.doc_id JOIN sizes t ON t.doc_id = b.doc_id
                  WHERE a.doc_id <> b.doc_id AND least(s.n, t.n) * 10 >= greatest(s.n, t.n) * 9
                  GROUP BY a.doc_id, b.doc_id, s.n, t.n HAVING 100 * count(*) >= 90 * (s.n + t.n - count(*))),
        reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
        SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, coalesce(k.n, 0) AS n_links
        FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT x AS doc_id, count(*) AS n FROM links GROUP BY x) k USING (doc_id)
        JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)
    """,
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
    "op2_mix_sources": r"""
        WITH RECURSIVE docs AS (
            SELECT doc_id, source,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || md5(coalesce(text, '')) || '/mix'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u,
                   greatest(1e-9::DOUBLE, coalesce(strlen(text), 0) / (coalesce(strlen(text), 0) + 512.0::DOUBLE)) AS appeal, row_number() OVER () AS nth
            FROM documents),
        s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
        s1 AS (SELECT source, source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap FROM s0),
        s2 AS (SELECT *, sum(source_size) OVER () * 1.0::DOUBLE - coalesce(sum(cap) OVER before, 0.0::DOUBLE) AS free,
                      sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0::DOUBLE) AS open_weight
               FROM s1 WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        s3 AS (SELECT *, free / open_weight AS level FROM s2),
        s4 AS (SELECT arg_min(level, cap / weight) AS level FROM s3 WHERE level * weight < cap),
        s5 AS (SELECT s3.source, s3.source_size, coalesce(least(cap, s4.level * weight), cap) AS target FROM s3 LEFT JOIN s4 ON true),
        s6 AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS ratio FROM s5),
        plan AS (SELECT *, CAST(floor(ratio + 1e-9::DOUBLE) AS BIGINT) AS whole,
                        greatest(0.0::DOUBLE, ratio - CAST(floor(ratio + 1e-9::DOUBLE) AS BIGINT)) AS p,
                        greatest(0.0::DOUBLE, target - CAST(floor(ratio + 1e-9::DOUBLE) AS BIGINT) * source_size) AS rest FROM s6),
        ranked AS (SELECT d.doc_id, d.nth, d.source, d.size, plan.source_size, plan.target, plan.whole, plan.rest,
                          CASE WHEN p > 0 AND size > 0 THEN u / (1.0::DOUBLE - u) / appeal END AS odds
                   FROM docs d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source),
        summed AS (SELECT *, CASE WHEN odds IS NOT NULL THEN sum(size) OVER (PARTITION BY source, odds IS NULL ORDER BY odds, doc_id, size, nth ROWS UNBOUNDED PRECEDING) END AS upto FROM ranked),
        marked AS (SELECT *, coalesce(upto <= rest, false) AS inside,
                          rest - coalesce(max(CASE WHEN upto <= rest THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM summed),
        filler AS (SELECT source, arg_min(nth, (abs(gap - size), odds, nth)) AS nth FROM marked
                   WHERE NOT inside AND odds IS NOT NULL AND abs(gap - size) < gap GROUP BY source)
        SELECT m.doc_id, m.size, m.source_size, m.target,
               CAST((m.whole + CASE WHEN m.inside OR f.nth IS NOT NULL THEN 1 ELSE 0 END) * m.size AS BIGINT) AS taken
        FROM marked m LEFT JOIN filler f ON m.source IS NOT DISTINCT FROM f.source AND m.nth = f.nth
    """,
}
