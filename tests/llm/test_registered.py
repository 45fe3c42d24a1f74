import os
import re
from collections import Counter

import pandas as pd
import pytest
from test_jaccard import plain as plain_classes
from test_quality import longest
from test_quality import plain as plain_repeats

import corpus_pipeline
from shelfmine.llm import queries, toxicity
from shelfmine.session import cut_lineage
from tools.check import comparable, connect

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def test_names():
    assert [n for n in queries.QUERIES if n.startswith("op")] and len(queries.QUERIES) == 14
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    cursor = connect(FOLDER).execute(queries.ORACLES[name])
    want = pd.DataFrame(cursor.fetchall(), columns=[d[0] for d in cursor.description])
    assert comparable(got).values.tolist() == comparable(want).values.tolist()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_pipeline_against_plain_stages(spark):
    """Every stage on what the one before it kept, beside a plain version of its decision."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    kinds = docs.dtypes
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}
    stages = dict(corpus_pipeline.STAGES)

    def after(name, docs):
        out = cut_lineage(stages[name](spark, docs, FOLDER))
        assert out.dtypes == kinds
        return out

    clean = after("toxicity", docs)
    scores = toxicity.scores(docs, labels).collect()
    assert rows(clean) == {i: t for i, t in rows(docs).items() if i in {r.doc_id for r in scores if r.predicted == 0}}
    marked = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert len(rows(docs).keys() - rows(clean).keys() - marked) <= 3

    good = after("quality rules", clean)

    def passes(text):
        w = words(text)
        repeated = plain_repeats(w, 8)
        return not (len(w) < 20 or 100 * repeated > 30 * len(w)) and plain_repeats(w, 5) <= 0.3 * len(w) and longest(w, 5) <= 100

    assert rows(good) == {i: t for i, t in rows(clean).items() if passes(t)}

    single = after("n-gram Jaccard join", good)
    before = sorted(rows(good).items())
    assert rows(single).keys() == {c for _, c, _ in plain_classes(before)}

    cut = after("substring dedup", single)
    shared = lambda texts: {g for g, n in Counter(g for t in texts.values() for g in {tuple(words(t)[k : k + 50]) for k in range(len(words(t)) - 49)}).items() if n > 1}
    assert rows(cut).keys() == rows(single).keys()
    assert len(shared(rows(cut))) <= len(shared(rows(single))) // 50
    for i, text in rows(cut).items():
        left = iter(words(rows(single)[i]))
        assert all(w in left for w in words(text))  # what stays is in order

    packed = stages["best-fit packing"](spark, cut, FOLDER).collect()
    assert {r.doc_id for r in packed} == rows(cut).keys()
    sequences = Counter()
    for r in packed:
        sequences[r.sequence_id] += r.length
    assert max(sequences.values()) <= 2048 and len(sequences) <= -(-sum(sequences.values()) // 2048) + 1
