"""One query per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chunk_bpe import op2_chunk_bpe
from .langid import op8_langid
from .license_scan import op1_license_scan
from .media import op10_media
from .minhash import op6_minhash
from .packing import op4_best_fit
from .quality import op7_quality
from .simhash import op9_simhash
from .token_store import op3_token_store
from .trie_counts import op5_token_counts


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_license_scan, op2_chunk_bpe, op3_token_store, op4_best_fit, op5_token_counts, op6_minhash, op7_quality, op8_langid, op9_simhash, op10_media, pipeline)
    return {f.__name__: f for f in found}


def _license_sql() -> str:
    """The license scan's rows, by searching every place and every block."""
    from .license_scan import THRESHOLD, templates

    def listed(exact: bool) -> str:
        return ", ".join(f"(string_split('{b' '.join(t.words).decode()}', ' '), '{t.label}', {t.overlap})" for t in templates() if t.exact == exact)

    overlaps = sorted({t.overlap for t in templates() if not t.exact})
    blocks = " UNION ALL ".join(f"SELECT doc_id, w, {n} AS n, {n} * unnest(generate_series(0, greatest(0, cast(ceil((len(w) - {2 * n}) / {n}.0) AS bigint)))) AS b FROM d" for n in overlaps)
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
phrases(p, label, n) AS (VALUES {listed(True)}),
notices(p, label, n) AS (VALUES {listed(False)}),
starts AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d),
hits AS (SELECT doc_id, i - 1 AS place, label FROM starts JOIN phrases ON w[i] = p[1] AND w[i : i + len(p) - 1] = p),
places AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS base FROM hits GROUP BY 1),
blocks AS ({blocks}),
shares AS (SELECT doc_id, label, len(list_intersect(list_distinct(w[b + 1 : b + 2 * blocks.n]), list_distinct(p))) / len(list_distinct(p)) AS share FROM blocks JOIN notices ON blocks.n = notices.n),
met AS (SELECT doc_id, max(share) AS top, list(DISTINCT label) AS more FROM shares WHERE share >= {THRESHOLD} - 1e-12 GROUP BY 1)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') AS labels, cast(greatest(coalesce(top, 0), CASE WHEN n_base > 0 THEN 1 ELSE 0 END) AS double) AS score
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN met USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the rows; the other queries are tested against brute force."""
    return {"op1_license_scan": _license_sql()}
