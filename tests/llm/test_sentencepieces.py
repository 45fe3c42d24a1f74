import random

import pytest

from shelfmine.llm import sentencepieces

TEXTS = ["", " ", "   ", "Hello  world", "  a b ", "a\tb\nc", "é́ ﬁ Å", "　x", "日本𠮷😀", "▁a", "a▁▁b", "<s>x</s>", "<0x41>", "\x00a", "x" * 3000, "    indent\n        more  x", "the" * 200]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())


def test_ids_and_text_are_those_of_the_library(spark, library):
    rng = random.Random(3)
    random_texts = ["".join(rng.choice("abcdehilnorst  üß.,\n日") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    texts = TEXTS + random_texts
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    rows = sentencepieces.encoded(df).collect()
    for r in rows:
        assert r.ids == library.encode(texts[r.doc_id])
        assert r.restored == (library.decode(r.ids) == texts[r.doc_id])
    back = sentencepieces.decoded(sentencepieces.encoded(df).select("doc_id", "ids")).collect()
    assert all(r.text == library.decode(r.ids) for r in back)


def test_odd_rows(odd_docs, no_docs):
    rows = sentencepieces.encoded(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.ids == [] and r.n_ids == 0 for r in rows if r.doc_id in (2, 3))
    assert sentencepieces.encoded(no_docs).count() == 0
