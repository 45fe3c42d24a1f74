"""The hashing embedder beside its definition, and texts that are tokenised once for both indexes."""

import hashlib
import math

from shelfmine.operators.models import HashingEmbedder
from shelfmine.plans import ingest
from shelfmine.plans.search import embedded
from shelfmine.plans.suites import retrieval
from shelfmine.sources.segments import SegmentedLibrary


def test_vectors_are_normalised_counts(spark):
    texts = [(1, "the white Rabbit, white é"), (2, ""), (3, None), (4, "a the")]
    rows = spark.createDataFrame(texts, "id int, text string")
    got = {r["id"]: r["vector"] for r in HashingEmbedder(16).embed(rows, "text").collect()}
    assert HashingEmbedder(16).embed(rows, "text").columns == ["id", "text", "vector"]
    want = [0.0] * 16
    for term in ["white", "rabbit", "white", "é"]:
        want[int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % 16] += 1.0
    norm = math.sqrt(sum(x * x for x in want))
    assert got[1] == [x / norm for x in want]
    assert got[2] == got[3] == got[4] == [0.0] * 16


def test_texts_of_a_library_are_tokenised_once(spark):
    """Neither index reads the texts again: their terms come from one written table."""
    library = retrieval.document_library(spark, "/root/testdata/sf0.001")
    for frame in (library.vectors, library.index.postings, library.index.lengths):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "regexp_extract_all" not in plan and "documents.parquet" not in plan


def test_an_appended_batch_is_tokenised_once(spark, tmp_path, monkeypatch):
    """Vectors, lengths and postings of a batch come from one written table of terms."""
    plans, write = {}, SegmentedLibrary._write

    def watched(self, name, rows, *place):
        plans[name] = rows._jdf.queryExecution().executedPlan().toString()
        return write(self, name, rows, *place)

    monkeypatch.setattr(SegmentedLibrary, "_write", watched)
    rows = [("a", "A", "", "book", "# One\nThe white rabbit, white\n# Two\né and the rest"), ("b", "B", "", "book", "Only words")]
    incoming = spark.createDataFrame(rows, "slug string, title string, author string, doc_type string, text string")
    library = ingest.append(incoming, SegmentedLibrary.create(spark, str(tmp_path / "library")))
    assert all("regexp_extract_all" not in plans[name] for name in ("vectors", "lengths", "postings"))
    want = embedded(library.table("chunks"), HashingEmbedder())
    got = library.table("vectors")
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) != []
    # another size of vectors, given by the caller
    wide = ingest.append(incoming, SegmentedLibrary.create(spark, str(tmp_path / "wide")), embedder=HashingEmbedder(16))
    assert {len(r.vector) for r in wide.table("vectors").collect()} == {16}
