"""The operators of this subpackage as queries over the given tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, license_scan, line_dedup, lm_score, mixing, phrases, pii, quality, simhash, spelling, substring_dedup, token_files, toxicity
from plumbline.llm.common import ROW_KEY, new_folder


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, folder, "documents"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.grade_documents(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(_table(spark, folder, "documents"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op5_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.score(_table(spark, folder, "documents"))


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.passages(_table(spark, folder, "documents")).drop(*ROW_KEY)


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.rate(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op8_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(_table(spark, folder, "documents"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.schedule(_table(spark, folder, "documents"))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(_table(spark, folder, "documents"))


def op12_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = new_folder(spark)
    token_files.write(_table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_pii": op3_pii,
    "op4_decontamination": op4_decontamination,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality": op7_quality,
    "op8_licenses": op8_licenses,
    "op9_mixing": op9_mixing,
    "op10_simhash": op10_simhash,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_token_files": op12_token_files,
    "op13_collocations": op13_collocations,
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op4_decontamination": f"""
        WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item, least(len(w), 10) AS n,
              unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS win
            FROM items WHERE len(w) > 0),
        docs AS (SELECT doc_id, row_number() OVER () AS row_no, {_WORDS} AS w FROM documents),
        sizes AS (SELECT DISTINCT n FROM windows),
        spots AS (SELECT row_no, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n),
        found AS (SELECT row_no, s.n, i, item FROM spots s JOIN windows v ON v.n = s.n AND v.win = array_to_string(w[i:i + s.n - 1], ' ')),
        hits AS (SELECT row_no, count(DISTINCT place) AS n_hit FROM (SELECT row_no, unnest(range(i, i + n)) AS place FROM found) GROUP BY row_no),
        named AS (SELECT row_no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT row_no, item FROM found) GROUP BY row_no)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
          sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN hits USING (row_no) LEFT JOIN named USING (row_no)""",
    "op13_collocations": rf"""
        WITH split AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM split),
        sizes AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
        spots AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
        grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM spots GROUP BY ALL HAVING count(*) >= 100),
        kept AS (
            SELECT * FROM grams c WHERE k > 1 AND NOT EXISTS (
                SELECT 1 FROM grams g WHERE g.lang = c.lang AND g.k > c.k AND g.f >= c.f
                AND contains(' ' || g.phrase || ' ', ' ' || c.phrase || ' '))),
        cuts AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM kept),
        scored AS (
            SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, n, cut,
              (CAST(a AS HUGEINT) * 1000 * n) // (CAST(x.f AS HUGEINT) * y.f) AS score
            FROM cuts c
            JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ')
            JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:len(w)], ' ')
            JOIN sizes s ON s.lang = c.lang),
        best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM scored),
        ranked AS (
            SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
              CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
            FROM best WHERE place = 1)
        SELECT * FROM ranked WHERE rank <= 2000""",
}
