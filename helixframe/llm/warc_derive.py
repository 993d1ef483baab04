"""WARC derivatives: metadata and plain-text conversion records for responses.

Each response gives a metadata record (its source headers, title and links)
and a conversion record (its plain text).  Both carry WARC-Refers-To with the
response's id, the target URI and date, and block digests (SHA-1, base 32);
ids are name-based UUIDs, so a second run gives the same records.

Pages are read in one pass forward, so time grows with their length whatever
they hold; a > inside a quoted value doesn't end a tag.  Links are seen from
the page: relative ones are joined to its base address or its own.

Defined results: null or empty html gives an empty text and no links; a null
url gives records without WARC-Target-URI; repeated rows each give their (equal)
records; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import gzip
import html as entities
import os
import re
import uuid
from collections.abc import Iterator
from io import BufferedReader, BytesIO
from urllib.parse import urljoin

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What opens a comment or a tag.
OPEN = re.compile(r"<(!--|[!/?a-zA-Z])")
#: An attribute: a name and, after =, a value in quotes or up to a blank; possessive, so no part is read twice.
ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+"""
#: A start or end tag; a > inside a quoted value doesn't end it.
TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]*+{ATTRIBUTE})*+)[\s/]*+>")
VALUES = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
#: Elements whose content is no text, and those that end a line.
HIDDEN = {"script", "style", "noscript", "template"}
BREAKS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "header", "footer", "nav", "blockquote", "pre", "title", "head", "body", "hr"}
CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in (*HIDDEN, "title")}
SPACE = re.compile(r"[ \t\r\f\v]+")
#: The date of records whose captures have none.
DATE = "1970-01-01T00:00:00Z"


def attribute(attributes: str, name: str) -> str | None:
    """The first value of this name, entities resolved; "" where it has none."""
    for m in VALUES.finditer(attributes):
        if m[1].lower() == name:
            return entities.unescape(next((g for g in m.groups()[1:] if g is not None), ""))
    return None


def page_parts(html: str) -> tuple[str, list[str], str, str | None]:
    """(text with tags taken out, links, title, base address) in one pass forward; nothing is looked for again once it isn't there.

    An unclosed comment or hidden element reaches to the end; from a tag that
    is never closed on, all is text.
    """
    parts, links, title, base, titled, done = [], [], "", None, False, 0
    while m := OPEN.search(html, done):
        start = m.start()
        parts.append(html[done:start])
        if m[1] == "!--":
            end = html.find("-->", start + 2)
            parts.append(" ")
            done = len(html) if end < 0 else end + 3
            continue
        tag = TAG.match(html, start)
        if not tag:
            end = -1 if html[start + 1] not in "!?/" or html[start + 2 : start + 3].isalpha() and html[start + 1] == "/" else html.find(">", start)
            if end < 0:
                done = start
                break
            done = end + 1  # a declaration, or an end tag without a name
            continue
        done, name, opens = tag.end(), tag[2].lower(), not tag[1]
        if opens and name in HIDDEN:
            close = CLOSE[name].search(html, done)
            parts.append(" ")
            done = close.end() if close else len(html)
            continue
        if opens and name == "a" and (link := attribute(tag[3], "href")) is not None:
            links.append(link)
        if opens and name == "base" and base is None:
            base = attribute(tag[3], "href")
        if opens and name == "title" and not titled:
            titled = True
            close = CLOSE["title"].search(html, done)
            title = html[done : close.start()] if close else ""
        if name in BREAKS:
            parts.append("\n")
    parts.append(html[done:])
    return "".join(parts), links, title, base


def absolute(link: str, base: str | None, url: str | None) -> str:
    """A link seen from the page: without blanks around it, joined to the base address, which is joined to the page's; unreadable ones as they are."""
    link = re.sub(r"[\t\r\n]+", "", link.strip())
    try:
        return urljoin(urljoin(url or "", base.strip()) if base else url or "", link)
    except ValueError:
        return link


def plain_text(text: str) -> str:
    """Entities resolved, runs of space as one, lines without ends or blanks."""
    lines = (x.strip() for x in SPACE.sub(" ", entities.unescape(text)).split("\n"))
    return "\n".join(x for x in lines if x)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def _record(kind: str, rid: str, refers: str, url: str | None, date: str, block: bytes, mime: str, payload: str) -> tuple[str, str]:
    """The header (without the blank line) and the block's digest."""
    d = digest(block)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Refers-To: {refers}"]
    lines += [f"WARC-Target-URI: {url}"] if url is not None else []
    lines += [f"WARC-Date: {date}", f"WARC-Block-Digest: {d}", f"X-Source-Payload-Digest: {payload}", f"Content-Type: {mime}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines), d


def derive_page(page_id, url: str | None, html: str | None, date: str | None, headers: str | None) -> list[dict]:
    """The two records of one response."""
    html, url = html or "", None if url is None else re.sub(r"[\r\n]+", "", url)
    payload = digest(html.encode())
    date = date or DATE
    source = record_id("response", str(page_id), url or "", payload)
    text, links, title, base = page_parts(html)
    title = " ".join(entities.unescape(page_parts(title)[0]).split())
    links = [absolute(x, base, url) for x in links]
    fields = [f"source-header: {x}" for x in (headers or "").splitlines() if x] + [f"title: {title}"] * bool(title) + [f"outlink: {' '.join(x.split())}" for x in links]
    blocks = [("metadata", "\r\n".join(fields).encode(), "application/warc-fields"), ("conversion", plain_text(text).encode(), "text/plain; charset=utf-8")]
    out = []
    for kind, block, mime in blocks:
        rid = record_id(kind, source)
        header, d = _record(kind, rid, source, url, date, block, mime, payload)
        out.append({"page_id": page_id, "record_type": kind, "record_id": rid, "refers_to": source, "payload_digest": payload, "block_digest": d, "header": header, "block": block.decode()})
    return out


def derive_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None, headers_col: str | None = None) -> DataFrame:
    """Two rows for each response: page_id, record_type, ids, digests, header and block; narrow."""
    none = F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), (F.col(date_col) if date_col else none).alias("date"), (F.col(headers_col) if headers_col else none).alias("headers"))
    names = ["record_type", "record_id", "refers_to", "payload_digest", "block_digest", "header", "block"]

    def derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                got = [r for row in zip(*(c.to_pylist() for c in part.columns)) for r in derive_page(*row)]
                yield pa.RecordBatch.from_arrays([pa.array([g["page_id"] for g in got], b.column(0).type), *(pa.array([g[n] for g in got], pa.string()) for n in names)], ["page_id", *names])

    return rows.mapInArrow(derived, f"page_id {rows.schema['page_id'].dataType.simpleString()}, " + ", ".join(f"{n} string" for n in names))


def write_warc(records: DataFrame, path: str) -> None:
    """Records as WARC files in a new folder, each record a gzip member of its own, a file a partition.

    A task writes to a name of its own attempt and reports it; the driver then
    gives the reported files their names, so what a lost executor left doesn't
    count.  The folder must be one that pyarrow's file systems reach.
    """
    files, root = filesystem(path)
    if files.get_file_info(root).type != pa.fs.FileType.NotFound:
        raise FileExistsError(path)
    files.create_dir(f"{root}/_attempts", recursive=True)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, out, n = TaskContext.get(), None, 0
        where, base = filesystem(path)
        name = f"{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        for b in batches:
            out = out or where.open_output_stream(f"{base}/_attempts/{name}", compression=None)
            for header, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out.write(gzip.compress(f"{header}\r\n\r\n{block}\r\n\r\n".encode(), mtime=0))
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["name", "n"])

    for r in records.select("header", "block").mapInArrow(written, "name string, n long").collect():  # a row a file
        files.move(f"{root}/_attempts/{r['name']}", f"{root}/part-{r['name'].split('-')[0]}.warc.gz")
    files.delete_dir(f"{root}/_attempts")
    with files.open_output_stream(f"{root}/_SUCCESS"):
        pass


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def records_in(stream) -> Iterator[dict]:
    """Records of an open WARC file, each as long as its Content-Length says."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        header = [line.decode("utf-8", "replace").rstrip("\r\n")]
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            header.append(line.decode("utf-8", "replace").rstrip("\r\n"))
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in header[1:])}
        block = stream.read(int(fields.get("content-length", 0)))
        yield {"record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "refers_to": fields.get("warc-refers-to"), "header": "\r\n".join(header), "block": block.decode("utf-8", "replace")}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record_type, record_id, refers_to, header and block of the records in WARC files; gzip, by file or by record, is undone.

    Spark lists the files; each is a task's own and is streamed record by
    record through pyarrow's file systems, so a file of any size fits.  From a
    store that only Spark reaches, files come whole (2 GB at most).
    """
    names = ["record_type", "record_id", "refers_to", "header", "block"]
    schema = pa.schema([(n, pa.string()) for n in names])

    def records(raw) -> Iterator[pa.RecordBatch]:
        buffered = BufferedReader(raw, 1 << 20)
        stream = gzip.GzipFile(fileobj=buffered) if buffered.peek(2)[:2] == b"\x1f\x8b" else buffered
        held, size = [], 0
        for r in records_in(stream):
            held.append(r)
            size += len(r["block"])
            if size > 1 << 22:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, schema)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in b.column(0).to_pylist():
                files, place = filesystem(at)
                with files.open_input_file(place) as raw:
                    yield from records(raw)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                yield from records(BytesIO(content.as_buffer()))

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter("length > 0")
    first = listed.select("path").first()
    ddl = ", ".join(f"{n} string" for n in names)
    try:
        reached = first is not None and filesystem(first["path"])[0] is not None
    except (pa.ArrowInvalid, OSError):
        return listed.select("content").mapInArrow(whole, ddl)
    paths = listed.select("path")
    return (paths.repartition(max(1, paths.count()), "path") if reached else paths).mapInArrow(streamed, ddl)
