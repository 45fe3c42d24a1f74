import base64
import hashlib
import json
from html.parser import HTMLParser

import pandas as pd

from shelfmine.llm import warc


class Plain(HTMLParser):
    """Words and links of a page, by the standard library."""

    def __init__(self):
        super().__init__()
        self.words, self.hrefs, self.silent = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in ("script", "style", "title")
        if tag == "a":
            self.hrefs += [v for k, v in attrs if k == "href" and v]

    def handle_endtag(self, tag):
        self.silent -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.silent:
            self.words += data.split()


def test_pages_against_the_standard_parser(spark):
    pages = pd.read_parquet("/root/testdata/sf0.001/pages.parquet")
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = warc.derivatives(warc.responses(df)).collect()
    assert len(rows) == 2 * len(pages)
    plain = {r.page_id: r for r in rows if r.record_type == "conversion"}
    meta = {r.page_id: r for r in rows if r.record_type == "metadata"}
    for page in pages.itertuples():
        parser = Plain()
        parser.feed(page.html)
        assert "".join(plain[page.page_id].body.split()) == "".join("".join(parser.words).split())
        told = json.loads(meta[page.page_id].body)["Envelope"]
        http = told["Payload-Metadata"]["HTTP-Response-Metadata"]
        assert len([x for x in http["HTML-Metadata"]["Links"] if x["path"] == "A@/href"]) == len(parser.hrefs)
        payload = "sha1:" + base64.b32encode(hashlib.sha1(page.html.encode()).digest()).decode()
        assert plain[page.page_id].source_digest == http["Entity-Digest"] == told["WARC-Header-Metadata"]["WARC-Payload-Digest"] == payload
        assert plain[page.page_id].refers_to == meta[page.page_id].refers_to == told["WARC-Header-Metadata"]["WARC-Record-ID"]
    assert len({r.record_id for r in rows}) == len(rows)


def test_files_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/x\r\nEvil: 1", "<a href='b?c=1&amp;d'>t</a>"), (2, None, None)], "page_id bigint, url string, html string")
    sources = warc.responses(df).collect()
    (tmp_path / "a.warc").write_bytes(b"".join(r.record for r in sources))
    read = warc.read_responses(spark, str(tmp_path)).collect()
    assert [r.record for r in read] == [r.record for r in sources]
    made = warc.derivatives(warc.responses(df))
    (file,) = warc.to_files(made.coalesce(1)).collect()
    records = warc.parse_records(bytes(file.file))
    assert [r.headers["WARC-Type"] for r in records] == ["metadata", "conversion"] * 2
    assert all("Evil" not in r.headers for r in records)
    assert json.loads(records[0].block)["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]["Links"] == [
        {"path": "A@/href", "url": "http://a/b?c=1&d", "text": "t"}
    ]


def test_markup_that_is_cut_off():
    text, title, links = warc.read_html("<title>T &amp; U</title><p>a<br>b &lt; c<script>x<y</script> d<!-- e", "http://h/")
    assert (text, title, links) == ("a\nb < c d", "T & U", [])


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.derivatives(warc.responses(df)).count() == 0
