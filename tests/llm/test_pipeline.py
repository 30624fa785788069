"""Queries with SQL against DuckDB; the pipeline against its stages worked out plainly."""

import os
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from inkgraph.llm import language, mixing
from inkgraph.llm.queries import SQL, vocabulary
from inkgraph.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, db, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(db.sql(SQL[name]).df())


def test_stages(spark, tmp_path):
    from test_operators import brute_classes
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "mix", "token_output"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        before, at = docs.collect(), str(tmp_path / name)
        out.write.parquet(at)
        out = spark.read.parquet(at)
        after = out.collect()
        ids = {r["doc_id"] for r in after}
        if k < 4:
            assert out.columns == docs.columns
        if name == "language_id":
            assert ids == {r["doc_id"] for r in before if r["text"] and any(c.isalpha() for c in r["text"])}
        elif name == "near_dedup":
            assert ids == {i for i, (_, c) in brute_classes([(r["doc_id"], r["text"]) for r in before], 5, 80).items() if c == i}
        elif name == "decontamination":
            flat = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
            assert ids == {r["doc_id"] for r in before if not any(flat(b) in flat(r["text"]) for b in bench)}
        elif name == "mix":
            plan = mixing.mix_sizes(docs).where("taken > 0").collect()
            assert len(after) == sum(p["epochs"] + (p["last_words"] > 0) for p in plan)
            assert sum(len(r["text"].split()) for r in after) == sum(p["taken"] for p in plan)
        else:
            lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
            coded = [(r["doc_id"], np.array(lib.encode(r["text"], add_special_tokens=False).ids + [1], "<u4")) for r in sorted(before, key=lambda r: (r["doc_id"], r["text"]))]
            starts = np.cumsum([0, *[len(c) for _, c in coded]])
            want = [(i, int(s), len(c), zlib.crc32(c.tobytes())) for (i, c), s in zip(coded, starts, strict=False)]
            assert sorted(map(tuple, after)) == sorted(want)
        docs = out
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, after))


def test_trained_languages(spark):
    [model] = language.train(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang"))
    assert model.languages == ["de", "en", "es", "fr"]
