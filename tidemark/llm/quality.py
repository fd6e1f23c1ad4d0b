"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document has four measures, as whole numbers: symbols per mille of its word characters, repeated lines per mille
of its lines, words in repeated three-word windows per mille of its words, and the mean word length in hundredths.
A quantile sketch of each measure is a table of counts by bucket: values below 64 have a bucket each, larger ones the
leading six binary digits (relative error 1/32 at most).  Sketches merge by adding counts, exactly and in any order.
They are built per (language, source) of the documents that pass the base rules; a group of fewer than ``MIN_GROUP``
documents uses its language's merged sketch, and a small language that of all documents.

A document is dropped if a measure lies beyond the far fence ``q75 + FENCE * (q75 - q25)`` of its group plus a slack
that keeps groups of nearly equal documents from losing their tail; the word length has a lower fence too.

Results: a null text has no words and fails the base rules.  Null languages and sources are groups of their own.
Only the named columns are read.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.llm.shared import materialize, words

MIN_WORDS = 50
FENCE = 3
MIN_GROUP = 100
#: Slack by measure: per mille, or hundredths of a character.
SLACK = {"symbol": 60, "line": 400, "repeat": 350, "length": 200}
LOWER = ("length",)


def base_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ("lang", "source")) -> DataFrame:
    """doc_id, the columns of ``keep``, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(docs[text_col], F.lit(""))
    df = docs.select(docs[id_col].alias("doc_id"), *[docs[c].alias(c) for c in keep], text.alias("t"), words(docs[text_col]).alias("w"))
    df = df.withColumn("n_words", F.size("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    windows = F.transform(F.sequence(F.lit(1), F.col("n_words") - 2), lambda i: F.xxhash64(F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2)))
    df = df.select(
        "doc_id", *keep, "n_words",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(F.col("n_words") >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    df = df.select("doc_id", *keep, "n_words", "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "h", (F.size(F.array_distinct("h")) < F.size("h")).alias("again"))
    # Only texts with a repeated window sort their windows: by hash and place, then the repeated ones by place.
    ordered = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = df.withColumn("s", F.when(F.col("again"), ordered)).drop("h")

    def twice(e: Column, i: Column) -> Column:
        before, after = F.get("s", i - 1)["x"], F.get("s", i + 1)["x"]
        return F.when(F.coalesce(before == e["x"], F.lit(False)) | F.coalesce(after == e["x"], F.lit(False)), e["i"])

    df = df.withColumn("p", F.when(F.col("again"), F.sort_array(F.filter(F.transform("s", twice), lambda x: x.isNotNull())))).drop("s")
    covered = F.aggregate(F.transform("p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("p", i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select("doc_id", *keep, F.col("n_words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.when(F.col("again"), covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"))


def bucket(v: Column) -> Column:
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return shift * 32 + F.call_function("shiftright", v, shift)


def lower_edge(b: Column) -> Column:
    shift = F.greatest(F.floor(b / 32) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", b - shift * 32, shift)


def measures() -> dict[str, Column]:
    n_words, lines, chars = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_lines", "word_chars"))
    whole = lambda a, b: F.floor(a / b).cast("long")
    return {
        "symbol": whole(1000 * F.col("n_symbols"), chars),
        "line": whole(1000 * F.col("n_dup_lines"), lines),
        "repeat": whole(1000 * F.col("n_repeat_words"), n_words),
        "length": whole(100 * F.col("word_chars"), n_words),
    }


def sketch(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts by (``by``, measure, bucket) of the columns m_*."""
    pairs = F.array(*[F.struct(F.lit(k).alias("measure"), bucket(F.col(f"m_{k}")).alias("b")) for k in SLACK])
    return df.select(*by, F.explode(pairs).alias("e")).groupBy(*by, "e.measure", "e.b").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "measure", "b").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    """One row for each group: docs and q25, q75 of every measure."""
    one = Window.partitionBy(*by, "measure")
    run = sketches.withColumn("upto", F.sum("n").over(one.orderBy("b"))).withColumn("total", F.sum("n").over(one))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, lower_edge(F.col("b"))))
    each = run.groupBy(*by, "measure").agg(F.max("total").alias("docs"), at(1).alias("q25"), at(3).alias("q75"))
    picked = [F.max(F.when(F.col("measure") == k, F.col(q))).alias(f"{k}_{q}") for k in SLACK for q in ("q25", "q75")]
    return each.groupBy(*by).agg(F.max("docs").alias("docs"), *picked)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", fence: int = FENCE, min_group: int = MIN_GROUP) -> DataFrame:
    """doc_id, n_words, the base measures, base_failed, kept of every row."""
    named = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"), docs[source_col].alias("source"))
    base = materialize(base_measures(named), "quality-base")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    base = base.withColumn("base_failed", failed).withColumns({f"m_{k}": v for k, v in measures().items()})
    fine = sketch(base.where(~F.col("base_failed")), ["lang", "source"])
    fine = materialize(fine, "quality-sketch")
    quart = [f"{k}_{q}" for k in SLACK for q in ("q25", "q75")]
    by_source = quartiles(fine, ["lang", "source"])
    by_lang = quartiles(merge(fine, ["lang"]), ["lang"]).select(F.col("lang").alias("l"), F.col("docs").alias("l_docs"), *[F.col(c).alias(f"l_{c}") for c in quart])
    overall = quartiles(merge(fine.withColumn("g", F.lit(0)), ["g"]), ["g"]).select(*[F.col(c).alias(f"a_{c}") for c in quart])
    rules = by_source.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left").join(overall, F.lit(True), "left")
    small = lambda c: F.when(F.col("docs") >= min_group, F.col(c)).when(F.col("l_docs") >= min_group, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}"))
    rules = rules.select(F.col("lang").alias("r_lang"), F.col("source").alias("r_source"), *[small(c).alias(c) for c in quart])
    joined = base.join(rules, F.col("lang").eqNullSafe(F.col("r_lang")) & F.col("source").eqNullSafe(F.col("r_source")), "left")
    verdict = ~F.col("base_failed")
    for k, slack in SLACK.items():
        spread = fence * (F.col(f"{k}_q75") - F.col(f"{k}_q25")) + slack
        verdict &= F.coalesce(F.col(f"m_{k}") <= F.col(f"{k}_q75") + spread, F.lit(True))
        if k in LOWER:
            verdict &= F.coalesce(F.col(f"m_{k}") >= F.col(f"{k}_q25") - spread, F.lit(True))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.alias("kept"))
