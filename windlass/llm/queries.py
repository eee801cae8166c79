"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, targets and words taken. Null text has size 0, a null source is the last source, equal doc_ids are taken alike; an empty table gives an empty result."""
    from .mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, words removed and the digest of the rest. Null and empty texts have no words; repeated rows repeat each other's windows; an empty table gives an empty result."""
    from .substrings import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log importance weights and the choice. Null and empty texts are not kept; rows of equal doc_id and text are chosen alike; null labels are ignored; empty tables give an empty result."""
    from .quality import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts. Null and empty html give the empty text, null ids stay null, repeated pages have a row each; an empty table gives an empty result."""
    from .extraction import extract_text

    return extract_text(_table(spark, sf_dir, "pages"))


def op5_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Places and checksums read back from the token files. Null and empty texts are the end id alone, a null doc_id comes first, repeated rows are written each; an empty table gives an empty result."""
    from .tokenfiles import token_files

    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return token_files(_table(spark, sf_dir, "documents"), tokenizer)


def op6_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses with spans and coverage. Null and empty texts match nothing, a null doc_id stays null, repeated rows are reported each; an empty table gives an empty result."""
    from .licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words hit and items found. Null and empty texts have no words, a null item_id is the text "null", repeated documents have a row each; empty tables give no hits, or no rows."""
    from .decontam import contamination

    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each query. Vectors that can't be compared and null ids take no part, ties go to the smaller vec_id, repeated queries ask once; an empty table gives an empty result."""
    from pyspark.sql import functions as F

    from .neighbours import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components. Null and empty texts have fingerprint 0 and link, a null doc_id never names a component, repeated rows have a row each; an empty table gives an empty result."""
    from pyspark.sql import functions as F

    from .simhash import hex_digits, near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents. Null and empty texts are one end token, a null doc_id counts as the empty text, repeated rows count and score each; an empty table gives an empty result."""
    from .pitmanyor import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_remove_repeats, op3_quality, op4_extract_text, op5_token_files, op6_scan_licenses, op7_decontaminate, op8_nearest, op9_simhash, op10_language_model)}


_OP1 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h
  FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, total * 2.0::DOUBLE AS most FROM t),
l AS (SELECT *, most / w AS ratio,
         (sum(total) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
g AS (SELECT source, total, coalesce(least(w * (SELECT max(level) FROM l WHERE level <= ratio), most), most) AS target FROM l),
p AS (SELECT *, CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END::BIGINT AS whole FROM g),
b AS (SELECT source, h, sum(size)::BIGINT AS inside FROM d GROUP BY source, h),
u AS (SELECT *, sum(inside) OVER (PARTITION BY source ORDER BY h)::BIGINT AS upto FROM b),
c AS (SELECT u.source, u.h + CASE WHEN upto - (target - whole * total) <= (target - whole * total) - (upto - inside) THEN 1 ELSE 0 END AS cut
  FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source
  WHERE target - whole * total > 0 AND upto >= target - whole * total AND upto - inside < target - whole * total)
SELECT doc_id, size, total AS source_size, target, ((whole + CASE WHEN h < coalesce(cut, 0) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""

_OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT k, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
x AS (SELECT k, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM p),
s AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY h) AS n FROM x) WHERE n > 1),
gone AS (SELECT DISTINCT k, i + j AS i FROM s, range(35) AS r(j)),
a AS (SELECT k, list(i) AS gone, count(*) AS n FROM gone GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda v, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN a USING (k)
"""

_OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i:i + 9], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT k, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM q) WHERE len(w) >= m),
o AS (SELECT k, i, p.m, item FROM p JOIN q ON p.m = q.m AND array_to_string(w[i:i + p.m - 1], ' ') = win),
hit AS (SELECT k, count(DISTINCT i + j) AS n FROM (SELECT DISTINCT k, i, m FROM o) t, range(10) AS r(j) WHERE j < m GROUP BY k),
it AS (SELECT k, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM o GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN it USING (k)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": _OP1, "op2_remove_repeats": _OP2, "op7_decontaminate": _OP7}
