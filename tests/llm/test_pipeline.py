"""The corpus pipeline on a small fixture, against what each stage is to do."""

from __future__ import annotations

import os
import random

import pytest

import corpus_pipeline
from condensa.llm import common
from condensa.llm.queries import ORACLES, QUERIES, tokenizer

needs_tokenizers = pytest.mark.skipif(not os.path.isfile(tokenizer("byte_bpe_50k.json")), reason="no tokenizer files")
rng = random.Random(9)
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "so", "ti") for c in ("n", "s", "", "la")]


def sentence(n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    clean = {i: sentence(80) for i in range(200)}
    toxic = {i: sentence(40) + " vile wretch " + sentence(30) for i in range(1000, 1120)}
    copies = {2000: clean[3], 2001: clean[3] + " ", 2002: clean[4].replace(" ", "\n", 1)}
    words = clean[5].split()
    words[40] = "changed"
    copies[2003] = " ".join(words)
    item = sentence(14)
    leaks = {3000: sentence(30) + " " + item + " " + sentence(30)}
    secret = {4000: sentence(40) + " token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff " + sentence(40)}
    rows = [(i, t, "en", "s", len(t)) for part in (clean, toxic, copies, leaks, secret) for i, t in part.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 1000)) for i in [*clean, *toxic]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item), (1, sentence(20))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, clean, {r[0]: r[1] for r in rows}


@needs_tokenizers
def test_stages(spark, folder):
    from tokenizers import Tokenizer

    path, clean, texts = folder
    want = {*clean, 4000}
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    got = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == want
    assert "24be6443" not in got[4000] and "[SECRET]" in got[4000] and all(got[i] == clean[i] for i in clean)
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    reference = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    common.remove_scratch(spark)
    out = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, path).collect()}
    assert common.remove_scratch(spark) >= len(corpus_pipeline.STAGES) and common.remove_scratch(spark) == 0
    assert out == {i: reference.encode(t, add_special_tokens=False).ids for i, t in got.items()}


@needs_tokenizers
def test_stages_on_edges(spark, folder):
    """Null and empty texts, null ids, repeated rows, further columns of odd names, and an empty table."""
    path, clean, _ = folder
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxic int, score double, node long, `key` string, secret_spans string"
    more = (1, 0.5, 7, "k", "s")
    rows = [(1, clean[0]), (1, clean[0]), (2, clean[0]), (3, None), (4, ""), (5, " \n"), (None, clean[1]), (None, None), (6, clean[2] + " token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *more) for i, t in rows], schema)
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), path).count() == 0 and stage(spark, docs, path).columns == docs.columns, name
    shown = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    assert shown(stages["toxicity"](spark, docs, path)) == shown(docs)
    kept = shown(stages["near_duplicates"](spark, docs, path))
    assert sorted((i for i, _ in kept), key=str) == [1, 3, 6, None] and (None, clean[1]) in kept  # of the empty texts the smallest id
    assert shown(stages["decontamination"](spark, docs, path)) == shown(docs)
    hidden = stages["secrets"](spark, docs, path)
    assert [t for i, t in shown(hidden) if i == 6] == [clean[2] + " [SECRET]"] and [t for i, t in shown(hidden) if i == 3] == [None]
    assert {r.n_chars for r in hidden.where("doc_id = 3").collect()} == {None} and hidden.where("secret_spans is null").count() == 0
    out = stages["bpe"](spark, docs, path)
    assert out.count() == len(rows) and {r.n_tokens for r in out.where("doc_id in (3, 4)").collect()} == {0}
    assert stages["bpe"](spark, docs.limit(0), path).count() == 0


def test_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "bpe"]
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES if k.startswith("op")) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, small, name):
    import glob

    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = QUERIES[name](spark, small)
    names = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*names).collect())
    assert got == sorted(tuple(map(str, r)) for r in c.sql(ORACLES[name]).project(",".join(f'"{x}"' for x in names)).fetchall())


def test_the_rest_imports_nothing_of_this():
    root = os.path.dirname(corpus_pipeline.__file__)
    for folder, _, files in os.walk(os.path.join(root, "condensa")):
        if "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    assert "condensa.llm" not in open(os.path.join(folder, f)).read(), f
