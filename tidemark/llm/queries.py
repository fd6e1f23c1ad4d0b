"""The registered queries of the training-data operators and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.exact_dedup import exact_dedup

    return exact_dedup(_docs(spark, sf_dir))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix

    return mix(_docs(spark, sf_dir))


def op3_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.scoring import score

    return score(_docs(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.packing import pack

    return pack(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.token_store import token_store

    return token_store(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.simhash import near_duplicates

    return near_duplicates(_docs(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.sharding import shard

    return shard(_docs(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import judge

    return judge(_docs(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.token_counts import token_counts

    return token_counts(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language_id import language_id

    return language_id(_docs(spark, sf_dir))


def _op8_sql() -> str:
    """The quality rules' SQL, with the same buckets and fences."""
    from tidemark.llm.quality import FENCE, LOWER, MIN_GROUP, MIN_WORDS, SLACK

    measure = {
        "symbol": "1000 * n_symbols // greatest(word_chars, 1)", "line": "1000 * n_dup_lines // greatest(n_lines, 1)",
        "repeat": "1000 * n_repeat_words // greatest(n_words, 1)", "length": "100 * word_chars // greatest(n_words, 1)",
    }
    quart = [f"{k}_{q}" for k in SLACK for q in ("q25", "q75")]

    def quartiles(keys: str) -> str:
        group, on = (f"{keys}, ", f"PARTITION BY {keys}, measure") if keys else ("", "PARTITION BY measure")
        at = lambda q: f"min(CASE WHEN upto * 4 >= total * {q} THEN low END)"
        pick = ", ".join(f"max(CASE WHEN measure = '{k}' THEN {q} END) AS {k}_{q}" for k in SLACK for q in ("q25", "q75"))
        by = f"GROUP BY {keys}" if keys else ""
        return f"""(SELECT {group}max(docs) AS docs, {pick} FROM (SELECT {group}measure, max(total) AS docs, {at(1)} AS q25, {at(3)} AS q75 FROM (
            SELECT *, sum(n) OVER ({on} ORDER BY b) AS upto, sum(n) OVER ({on}) AS total FROM (SELECT {group}measure, b, min(low) AS low, sum(n) AS n FROM sk GROUP BY {group}measure, b)) GROUP BY {group}measure) {by})"""

    fences = []
    for k, slack in SLACK.items():
        spread = f"({FENCE} * ({k}_q75 - {k}_q25) + {slack})"
        fences.append(f"coalesce(m_{k} <= {k}_q75 + {spread}, true)")
        if k in LOWER:
            fences.append(f"coalesce(m_{k} >= {k}_q25 - {spread}, true)")
    chosen = ", ".join(f"CASE WHEN a.docs >= {MIN_GROUP} THEN a.{c} WHEN l.docs >= {MIN_GROUP} THEN l.{c} ELSE o.{c} END AS {c}" for c in quart)
    return rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY 1),
b AS (SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             len(ln) AS n_lines, (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(f"{v} AS m_{k}" for k, v in measure.items())} FROM b),
e AS (SELECT lang, source, unnest([{", ".join(f"{{'measure': '{k}', 'v': m_{k}}}" for k in SLACK)}]) AS e FROM m WHERE NOT base_failed),
s0 AS (SELECT lang, source, e.measure AS measure, e.v AS v, greatest(length(bin(e.v)) - 6, 0)::INTEGER AS sh FROM e),
sk AS (SELECT lang, source, measure, sh * 32 + (v >> sh) AS b, ((v >> sh) << sh) AS low, count(*) AS n FROM s0 GROUP BY ALL),
rules AS (SELECT a.lang, a.source, {chosen} FROM {quartiles("lang, source")} a LEFT JOIN {quartiles("lang")} l ON a.lang IS NOT DISTINCT FROM l.lang, {quartiles("")} o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(fences)} AS kept
FROM m LEFT JOIN rules ON m.lang IS NOT DISTINCT FROM rules.lang AND m.source IS NOT DISTINCT FROM rules.source
"""


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_mixing": op2_mixing,
    "op3_scoring": op3_scoring,
    "op4_packing": op4_packing,
    "op5_token_store": op5_token_store,
    "op6_simhash": op6_simhash,
    "op7_sharding": op7_sharding,
    "op8_quality": op8_quality,
    "op9_token_counts": op9_token_counts,
    "op10_language_id": op10_language_id,
}
ORACLES = {"op1_exact_dedup": OP1_SQL, "op8_quality": _op8_sql()}
