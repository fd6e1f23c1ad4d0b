"""The pipeline's stages against what each must do to its own input."""

from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm.packing import LENGTHS

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def make(spark, data):
    return spark.createDataFrame([(*r, len(r[1] or ""), "x") for r in data], COLUMNS)


@pytest.fixture(scope="module")
def docs(spark):
    para = "the quick brown fox jumps over the lazy dog while the old man reads a book under the tall tree near the quiet river bank "
    data = [(i, f"{para} number {i} " + " ".join(f"w{i * 31 % 97}x{k}" for k in range(30)), "en", f"s{i % 4}") for i in range(60)]
    data += [(100, data[0][1], "en", "s1"), (101, data[0][1].replace(" ", "  "), None, None), (102, None, None, None), (103, "", "en", "s0"), (104, "123 !!", "en", "s0")]
    long = para * 60
    data += [(105, long, "en", "s2"), (106, long + "end", "en", "s2"), (107, "word " * 9000, "en", "s3")]
    return make(spark, data)


def test_stages(spark, docs, tmp_path):
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, "")
        out.write.parquet(str(tmp_path / name))
        back = spark.read.parquet(str(tmp_path / name))
        seen[name] = back
        if name != "packing":
            assert back.columns == docs.columns
        now = back
    ids = {n: sorted(r["doc_id"] for r in d.select("doc_id").collect()) for n, d in seen.items() if n != "packing"}
    assert set(range(60)) <= set(ids["language_id"]) and not {102, 103, 104} & set(ids["language_id"])
    assert 0 in ids["exact_dedup"] and not {100, 101} & set(ids["exact_dedup"])
    assert 105 in ids["near_dedup"] and 106 not in ids["near_dedup"]
    assert set(ids["mixing"]) <= set(ids["near_dedup"])
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((r["doc_id"], *t.encode(r["text"], add_special_tokens=False).ids, 2) for r in seen["mixing"].collect())
    parts = {}
    for r in seen["packing"].collect():
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["n_tokens"] == len(ids) <= r["capacity"] and r["capacity"] in LENGTHS
        at = 0
        for i, s, n in zip(r["doc_ids"], r["starts"], r["lengths"], strict=True):
            parts.setdefault(i, []).append((s, tuple(ids[at : at + n])))
            at += n
    for i, mine in parts.items():  # every copy of a document is there, whole
        texts = [x[1:] for x, c in want.items() if x[0] == i for _ in range(c)]
        assert sorted(mine) == sorted((s, x[s : s + max(LENGTHS)]) for x in texts for s in range(0, len(x), max(LENGTHS)))
    assert set(parts) == {x[0] for x in want}


def test_names_of_the_operators_own(spark):
    """Every stage takes columns that are named like those it makes for itself."""
    names = "d s n c uid pid sha key keep_uid prefix bucket total row node sig keys id gone fp size rows class q bin mass extra copies times part ids _d _s _n _c _size _copy _gone root a b x y".split()
    para = "the quick brown fox jumps over the lazy dog while the old man reads a book under the tall tree "
    data = [(i, para * 3 + f"number {i // 2} " * 5, "en", f"s{i % 2}", *["v"] * len(names)) for i in range(12)] + [(None,) * (4 + len(names))]
    df = spark.createDataFrame(data, ", ".join(["doc_id long, text string, lang string, source string", *[f"`{n}` string" for n in names]]))
    now = df
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, "")
        assert out.count() > 0
        if name != "packing":
            assert out.columns == df.columns
            now = out


def test_run_leaves_its_stages_only(spark, tmp_path, docs):
    import os

    from tidemark.llm import shared

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    before = set(os.listdir(f"{shared.shared_dir(spark)}/tidemark"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(f"{shared.shared_dir(spark)}/tidemark")) - before}
    assert left == {*(f"pipeline-{name}" for name, _ in corpus_pipeline.STAGES[:-1]), "pack-ids"}


def test_near_dedup_reaches_the_threshold(spark):
    """Copies with words changed go at a five-word Jaccard of 0.8 or more, against brute force; others stay."""
    rng = np.random.default_rng(5)
    word = [f"w{k}" for k in range(5000)]
    texts = []
    for _ in range(40):
        base = rng.choice(word, 200).tolist()
        texts.append(base)
        for changes in (2, 3, 4, 6):
            copy = list(base)
            for at in rng.choice(200, changes, replace=False):
                copy[at] = "other"
            texts.append(copy)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {i for i in range(len(texts)) if find(i) == i}
    kept = corpus_pipeline.near_dedup(spark, make(spark, [(i, " ".join(t), "en", "s") for i, t in enumerate(texts)]), "")
    assert 40 < len(want) < len(texts) and {r["doc_id"] for r in kept.collect()} == want


def test_workers_keep_no_other_stage(spark):
    from tidemark.llm import shared

    def parser(batches):
        shared.keep("parser", lambda: [0])
        yield from batches

    def left(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(shared._kept)] * batch.num_rows, pa.int64())], ["id"])

    rows = spark.range(0, 32, 1, 16)
    kept = lambda keeps: {r[0] for r in rows.mapInArrow(shared.lean(left, keeps), "id long").collect()}
    rows.mapInArrow(shared.lean(parser, keeps=True), "id long").collect()
    assert kept(True) == {1}
    corpus_pipeline.near_dedup(spark, make(spark, [(i, f"{i} a b c d e", "en", "s") for i in range(32)]).repartition(16), "").collect()
    assert kept(True) == {0}


def test_empty(spark):
    now = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
        assert now.count() == 0


def test_registered(spark):
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in names if k.startswith("op") and k[2].isdigit()}
