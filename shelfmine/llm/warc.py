"""WARC records: responses from crawled pages, and the metadata and plain-text records that derive from them."""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"

RECORDS = (
    "page_id bigint, record_type string, record_id string, refers_to string, target_uri string, source_digest string, "
    "block_digest string, n_links bigint, content_length bigint, body string, record binary"
)

# Fixed values of HTML: elements without text, elements that end a line, attributes that hold addresses.
SILENT = ("script", "style", "noscript", "template", "svg", "iframe", "object")
BREAKS = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main "
    "nav ol option p pre section select table tbody td tfoot th thead title tr ul".split()
)
LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "source": "src", "form": "action"}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<silent>" + "|".join(SILENT) + r")\b(?P<inside>[^>]*)>.*?(?:</(?P=silent)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    """Identifier of a record by its content, the same one whenever it is made again."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([str(p) for p in parts]))}>"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    def to_bytes(self) -> bytes:
        lines = [VERSION, *(f"{k}: {v}" for k, v in self.headers.items())]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + self.block + b"\r\n\r\n"


def header_value(text: str) -> str:
    """A header holds no line ends."""
    return re.sub(r"[\r\n]+", " ", text).strip()


def make_record(kind: str, ident: str, target: str, date: str, content_type: str, block: bytes, **more: str) -> Record:
    headers = {"WARC-Type": kind, "WARC-Record-ID": ident, "WARC-Date": date}
    if target:
        headers["WARC-Target-URI"] = header_value(target)
    headers |= {k: header_value(v) for k, v in more.items() if v}
    headers |= {"WARC-Block-Digest": digest(block), "Content-Type": content_type, "Content-Length": str(len(block))}
    return Record(headers, block)


def parse_records(data: bytes) -> list[Record]:
    """Records of an uncompressed WARC file, in order. A file that ends inside a record is an error."""
    out, at = [], 0
    while at < len(data):
        if data.startswith(b"\r\n", at):
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        headers = parse_headers(data[at:end].split(b"\r\n")[1:])
        size = int(header(headers, "Content-Length") or 0)
        if end + 4 + size > len(data):
            raise ValueError(f"record at byte {at} is cut off")
        out.append(Record(headers, data[end + 4 : end + 4 + size]))
        at = end + 4 + size
    return out


def parse_headers(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, sign, value = line.decode("utf-8", "replace").partition(":")
        if sign:
            out[name.strip()] = value.strip()
    return out


def header(headers: dict[str, str], name: str) -> str | None:
    return next((v for k, v in headers.items() if k.lower() == name.lower()), None)


def split_http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers and body of an HTTP message; a block without an empty line is all head."""
    head, _, body = block.partition(b"\r\n\r\n")
    first, *rest = head.split(b"\r\n")
    return first.decode("utf-8", "replace"), parse_headers(rest), body


def decoded_body(headers: dict[str, str], body: bytes) -> str:
    charset = re.search(r"charset=[\"']?([\w-]+)", header(headers, "Content-Type") or "", re.I)
    try:
        return body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def attributes(text: str) -> dict[str, str]:
    return {n.lower(): html.unescape(a or b or c) for n, a, b, c in reversed(_ATTRIBUTE.findall(text))}


def read_html(text: str, base: str) -> tuple[str, str, list[dict[str, str]]]:
    """Plain text, title and links of a page. Lines end at block elements, other white space becomes one space."""
    parts: list[str] = []
    links: list[dict[str, str]] = []
    anchors: list[tuple[dict[str, str], int]] = []
    title_at, title = -1, ""
    done = 0

    def add_link(name: str, inside: str) -> dict[str, str] | None:
        nonlocal base
        values = attributes(inside)
        if name == "base" and values.get("href"):
            base = joined(base, values["href"])
        address = values.get(LINKS.get(name, ""))
        if not address:
            return None
        links.append({"path": f"{name.upper()}@/{LINKS[name]}", "url": joined(base, address)})
        return links[-1]

    def words(start: int) -> str:
        return " ".join("".join(parts[start:]).split())

    for m in _MARKUP.finditer(text):
        if m.start() > done:
            parts.append(re.sub(r"\s+", " ", html.unescape(text[done : m.start()])))
        done = m.end()
        if m["silent"]:
            add_link(m["silent"].lower(), m["inside"])
            continue
        if not m["name"]:
            continue
        name = m["name"].lower()
        if name == "title" and not title:
            if not m["close"]:
                title_at = len(parts)
            elif title_at >= 0:
                title = words(title_at)
                del parts[title_at:]
        if name in BREAKS:
            parts.append("\n")
        if m["close"]:
            if name == "a" and anchors:
                link, start = anchors.pop()
                link["text"] = words(start)
        elif (link := add_link(name, m["attributes"])) is not None and name == "a":
            anchors.append((link, len(parts)))
    parts.append(re.sub(r"\s+", " ", html.unescape(text[done:])))
    lines = (" ".join(x.split()) for x in "".join(parts).split("\n"))
    return "\n".join(x for x in lines if x), title, links


def joined(base: str, address: str) -> str:
    try:
        return urljoin(base, address.strip())
    except ValueError:
        return address.strip()


def response(url: str, body: bytes, date: str = DATE) -> Record:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    payload = digest(body)
    more = {"WARC-Payload-Digest": payload}
    return make_record("response", record_id("response", url, date, payload), url, date, "application/http; msgtype=response", head + body, **more)


def derived(source: Record) -> list[tuple[Record, str, int]]:
    """The metadata and the conversion record of a response, each with its text and its number of links."""
    get = lambda name: header(source.headers, name) or ""
    ident, target, date = get("WARC-Record-ID"), get("WARC-Target-URI"), get("WARC-Date")
    status, http, body = split_http(source.block)
    text, title, links = read_html(decoded_body(http, body), target)
    payload = get("WARC-Payload-Digest") or digest(body)
    about = {
        "Envelope": {
            "WARC-Header-Metadata": source.headers,
            "Payload-Metadata": {
                "Actual-Content-Type": "application/http; msgtype=response",
                "HTTP-Response-Metadata": {
                    "Response-Message": {"Status-Line": status},
                    "Headers": http,
                    "Entity-Length": len(body),
                    "Entity-Digest": payload,
                    "HTML-Metadata": {"Head": {"Title": title}, "Links": links},
                },
            },
        }
    }
    told = json.dumps(about, ensure_ascii=False)
    refers = {"WARC-Refers-To": ident, "WARC-Refers-To-Target-URI": target, "WARC-Refers-To-Date": date}
    meta = make_record("metadata", record_id("metadata", ident), target, date, "application/json", told.encode(), **refers)
    plain = make_record("conversion", record_id("conversion", ident), target, date, "text/plain; charset=utf-8", text.encode(), **refers)
    return [(meta, told, len(links)), (plain, text, len(links))]


def _rows(page: object, kind: Record, body: str, n_links: int, source_digest: str) -> tuple:
    h = kind.headers
    return (
        page,
        h["WARC-Type"],
        h["WARC-Record-ID"],
        h.get("WARC-Refers-To"),
        h.get("WARC-Target-URI"),
        source_digest,
        h["WARC-Block-Digest"],
        n_links,
        len(kind.block),
        body,
        kind.to_bytes(),
    )


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """``(page_id, record)``: one response record per page, as the bytes of a WARC file. A null address or page is
    empty; repeated rows give repeated records."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages_ = zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist())
            made = [response(url or "", body or b"", date).to_bytes() for url, body in pages_]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["page_id", "record"])

    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string"), pages[html_col].cast("string"))
    return rows.mapInArrow(build, "page_id bigint, record binary")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, record)``: the response records of uncompressed WARC files; the number counts them in each file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                found = [r.to_bytes() for r in parse_records(data.as_py()) if r.headers.get("WARC-Type") == "response"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(found)), pa.int64()), pa.array(found, pa.binary())], names=["page_id", "record"]
                )

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, "page_id bigint, record binary")


def derivatives(records: DataFrame, id_col: str = "page_id", record_col: str = "record") -> DataFrame:
    """Two rows per response record: its metadata record (JSON of source headers, HTTP headers, digests, title and
    links) and its conversion record (plain text). Both name the response in ``refers_to`` and keep its payload digest.

    Each response is worked on by itself: repeated rows give repeated records, an empty table an empty result; a null
    record gives none; other columns are not read.
    """

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        types = [kinds[c.split()[1]] for c in RECORDS.split(", ")]
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                out = []
                for page, data in zip(*(c.to_pylist() for c in batch.slice(a, 256).columns)):
                    for source in parse_records(data or b""):
                        payload = header(source.headers, "WARC-Payload-Digest") or digest(split_http(source.block)[2])
                        out += [_rows(page, made, body, n, payload) for made, body, n in derived(source)]
                columns = zip(*out) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return records.select(records[id_col].cast("long"), records[record_col]).mapInArrow(derive, RECORDS)


def to_files(records: DataFrame) -> DataFrame:
    """``(part, file)``: the records of each partition as the bytes of one WARC file, in pieces of about 32 MB."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        n = size = 0
        for batch in batches:
            for data in batch.column(0).to_pylist():
                held.append(data)
                size += len(data)
                if size > 32 * 1024 * 1024:
                    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([b"".join(held)], pa.binary())], names=["part", "file"])
                    held, n, size = [], n + 1, 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([b"".join(held)], pa.binary())], names=["part", "file"])

    return records.select(F.col("record")).mapInArrow(write, "part bigint, file binary")
