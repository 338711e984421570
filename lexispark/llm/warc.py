"""WARC derivatives: for each response record a linked metadata record and a plain-text conversion record.

Both derived records refer to the response by its record id, target URI and date; the metadata record names the
conversion and carries the source's HTTP headers, digests, title and outlinks. Record ids are derived from the
source's id and payload, so that a repeated run (or a task that is run again) gives the same records and other content
under a used id gets ids of its own.

Responses are rows (record_id, target_uri, date, http, payload, payload_digest): the HTTP header block and the
payload as text. ``responses_from_warc`` makes them from the records that ``read_warc`` reads, ``responses_from_pages``
from a table of pages. Records are rows with the named WARC headers, the header block and the content block;
``serialized`` makes whole records of them, ``write_warc`` and ``read_warc`` go to files and back.

Defined results: a null payload is empty, and its conversion record has an empty block; a null payload digest is computed
from the payload; null headers are left out, and records of a response without an id refer to none (their own ids come
from its URI, date and payload); line ends inside header values become spaces; payloads are converted whole, very long
ones too; rows that repeat give records with equal ids; an empty table gives no records; other columns, whatever their
names, pass unread.
"""

from __future__ import annotations

import gzip
import hashlib
import html
import re
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.runtime import ARROW_BYTES, ARROW_ROWS, bounded_batches

# Elements without text of their own (those that HTML runs to the page's end if they are not closed, those
# that end with their own tag, the others), and elements that begin a line.
TO_END = frozenset("script style title textarea iframe".split())
FOREIGN = frozenset("svg math".split())
RAW = TO_END | FOREIGN | frozenset("noscript template object".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)

_OPEN = re.compile(r"<[!?/a-zA-Z]")
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+>""")  # only a value is quoted
_OTHER = re.compile(r"<[^>]*+>")
_UNQUOTED_END = re.compile(r"=\s*[^\s\"'>][^\s>]*/>\Z")  # the slash belongs to the last value
_HREF = re.compile(r"""[\s"'/]href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122

RECORD = (
    "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
    "content_length long, block_digest string, source_digest string, headers string, block string"
)
_FIELDS = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in RECORD.split(", ")])


class _Ends:
    """Where the next opening and end tags of an element are in a page; each place is looked for once."""

    def __init__(self, page: str):
        self.page, self.last = page, {}

    def next(self, name: str, at: int, closing: bool) -> tuple[int, int]:
        """Start and end of the next one from ``at`` on, else the page's length twice."""
        found = self.last.get((name, closing))
        if found is None or found[0] < at:
            m = re.compile(rf"</{re.escape(name)}\s*>" if closing else rf"<{re.escape(name)}(?=[\s/>])", re.I).search(self.page, at)
            found = self.last[name, closing] = m.span() if m else (len(self.page), len(self.page))
        return found


def _hidden_to(page: str, name: str, tag: str, end: int, ends: _Ends) -> int:
    """Where the hidden span of an opening tag that ends at ``end`` ends, or ``end`` if it opens none.

    HTML closes only foreign elements by a slash. Pages close others so too: these open a span only if an end tag
    follows before the next such opening tag.
    """
    closed = tag.endswith("/>") and not _UNQUOTED_END.search(tag)
    if closed and name in FOREIGN:
        return end
    start, stop = ends.next(name, end, True)
    if start < len(page):
        return end if closed and ends.next(name, end, False)[0] < start else stop
    return len(page) if name in TO_END and not closed else end


@dataclass
class Page:
    """A page's text without its tags, the first title outside hidden elements, the base and the links, in order."""

    text: str
    title: str
    base: str
    links: list[str]


def walk(page: str) -> Page:
    """Read a page's tags in order: nothing inside comments, scripts or other hidden elements counts."""
    out, at, ends, last = [], 0, _Ends(page), page.rfind(">")
    title, base, links = None, None, []
    while m := _OPEN.search(page, at):
        start = m.start()
        out.append(page[at:start])
        if page.startswith("<!--", start):
            at = _COMMENT.match(page, start).end()
            out.append(" ")
        elif start > last:  # no tag ends from here on
            at = start
            break
        elif tag := _TAG.match(page, start):
            name, at = tag[2].lower(), tag.end()
            hidden = at if tag[1] or name not in RAW else _hidden_to(page, name, tag[0], at, ends)
            if not tag[1] and name in ("a", "area", "base") and (href := _HREF.search(tag[0])):
                target = html.unescape(next(x for x in href.groups() if x is not None)).strip()
                if name != "base":
                    links.append(target)
                elif base is None:
                    base = target
            elif name == "title" and hidden > at and title is None:
                title = page[at : ends.next(name, at, True)[0]]
            out.append(" " if hidden > at else "\n" if name in BLOCK else "")
            at = hidden
        else:
            at = _OTHER.match(page, start).end()
    return Page("".join([*out, page[at:]]), one_line(html.unescape(title or "")), base or "", links)


def visible(text: str) -> str:
    """The text of ``walk`` with character references resolved, a line for each block element; white space inside a line
    is one space."""
    if "&" in text:
        text = html.unescape(text)
    return "\n".join(line for line in (" ".join(x.split()) for x in text.split("\n")) if line)


def plain_text(page: str) -> str:
    return visible(walk(page).text)


def one_line(value: str) -> str:
    return " ".join(value.split())


def outlinks(page: Page, target: str | None) -> list[str]:
    """Targets of the links of a page, in order, each once, without fragments or scripts, against the page's own base."""
    out = {}
    try:
        base = urljoin(target or "", page.base)
    except ValueError:  # not a URL
        base = target or ""
    for link in page.links:
        if link and not link.lower().startswith(("#", "javascript:", "mailto:", "data:")):
            try:
                out[one_line(urljoin(base, link)).split("#")[0]] = None
            except ValueError:
                continue
    return [x for x in out if x]


def derived_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{kind} of {source}')}>"


def digest(block: bytes) -> str:
    return f"sha256:{hashlib.sha256(block).hexdigest()}"


def header_block(values: dict[str, str | None]) -> str:
    return "WARC/1.1\r\n" + "".join(f"{k}: {one_line(v)}\r\n" for k, v in values.items() if v is not None)


def derive(record_id: str | None, target: str | None, date: str | None, http: str | None, payload: str | None, payload_digest: str | None) -> list[tuple]:
    """The metadata and conversion records of one response."""
    raw_page = payload or ""
    page = walk(raw_page)
    text = visible(page.text)
    sha = digest(raw_page.encode("utf-8", "surrogatepass"))
    payload_digest = payload_digest or sha
    source = f"{record_id or f'{target} {date}'} {sha}"
    conversion, metadata = derived_id(source, "conversion"), derived_id(source, "metadata")
    fields = [("title", page.title), ("conversion", conversion), ("source-payload-digest", payload_digest)]
    fields += [("source-header", one_line(x)) for x in (http or "").splitlines() if x.strip()]
    fields += [("outlink", x) for x in outlinks(page, target)]
    about = "".join(f"{k}: {v}\r\n" for k, v in fields)
    out = []
    for kind, ident, content, block in (("metadata", metadata, "application/warc-fields", about), ("conversion", conversion, "text/plain; charset=utf-8", text)):
        raw = block.encode("utf-8", "surrogatepass")
        sha = digest(raw)
        headers = header_block({
            "WARC-Type": kind, "WARC-Record-ID": ident, "WARC-Date": date, "WARC-Target-URI": target, "WARC-Refers-To": record_id,
            "WARC-Refers-To-Target-URI": target, "WARC-Refers-To-Date": date, "WARC-Source-Payload-Digest": payload_digest,
            "WARC-Block-Digest": sha, "Content-Type": content, "Content-Length": str(len(raw)),
        })
        out.append((kind, ident, record_id, target, date, content, len(raw), sha, payload_digest, headers, block))
    return out


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records (see ``RECORD``) for each row of ``responses``; one pass, no shuffle."""
    bounded_batches(responses.sparkSession)

    def built(batches):
        for batch in batches:
            rows = [r for x in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in derive(*x)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_FIELDS), _FIELDS, strict=True)], schema=_FIELDS)

    columns = ["record_id", "target_uri", "date", "http", "payload", "payload_digest"]
    return responses.select(*[F.col(c).cast("string") for c in columns]).mapInArrow(built, RECORD)


def responses_from_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a (page_id, url, html) table, with ids made from page_id, url and content."""
    page = F.coalesce("html", F.lit(""))
    h = F.md5(F.concat_ws("\u0001", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.md5(page)))
    urn = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(page).cast("string"), F.lit("\r\n"))
    return pages.select(
        urn.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), http.alias("http"), F.col("html").alias("payload"),
        F.concat(F.lit("sha256:"), F.sha2(page, 256)).alias("payload_digest"),
    )


def serialized(records: DataFrame) -> DataFrame:
    """Each record as it stands in a WARC file."""
    return records.select(F.concat("headers", F.lit("\r\n"), "block", F.lit("\r\n\r\n")).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files below ``path``, one for each task, by Spark's own writer (a failed task leaves no part file)."""
    serialized(records).select(F.expr("substring(value, 1, length(value) - 1)").alias("value")).write.text(path)


_BREAK, _NEXT = b"\r\n\r\n", b"\r\n\r\nWARC/1."
_HEAD = re.compile(rb"\A(?:WARC/1\.)?\d\r\n[A-Za-z-]+:")
_SIZE = re.compile(rb"^Content-Length:\s*(\d+)", re.I | re.M)


def pieced(pieces):
    """(header block, content, whole) of records, from a file's bytes cut at ``_NEXT``.

    A cut inside a content (its length shows it) is mended with the pieces that follow; a record whose rest is not
    there is given as far as it goes, with ``whole`` false.
    """
    head = body = size = None
    for piece in pieces:
        if head is not None and size is not None and len(body) < size:  # the cut was inside this record's content
            body += _NEXT + piece
        else:
            if head is not None:
                yield head, body[:size], True
            if not _HEAD.match(piece):
                head = None
                continue
            start, _, body = piece.partition(_BREAK)
            head = b"WARC/1." + start.removeprefix(b"WARC/1.") + b"\r\n"
            found = _SIZE.search(head)
            size = int(found[1]) if found else None
    if head is not None:
        yield head, body[:size], size is None or len(body) >= size


def parse(data: bytes) -> list[tuple[str, str]]:
    """(header block, content block) of the records of a WARC file, compressed or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    return [(h.decode("utf-8", "replace"), b.decode("utf-8", "replace")) for h, b, _ in pieced(data.split(_NEXT))]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files: their types, ids, header blocks and contents, as bytes and as text.

    Files are read record by record: memory holds a batch of records, whatever a file's size, and an uncompressed file is
    read by many tasks. Only a content that itself holds the mark between two records and crosses the border of two
    tasks is cut there; its ``whole`` is false.
    """
    bounded_batches(spark)

    def parsed(batches):
        def pieces():
            for batch in batches:
                yield from batch.column("value").to_pylist()

        rows, held = [], 0
        for row in pieced(pieces()):
            rows.append(row)
            held += len(row[1])
            if len(rows) >= ARROW_ROWS or held >= ARROW_BYTES:
                yield built(rows)
                rows, held = [], 0
        yield built(rows)

    def built(rows):
        heads, contents, whole = zip(*rows, strict=True) if rows else ((), (), ())
        texts = [c.decode("utf-8", "replace") for c in contents]
        return pa.RecordBatch.from_arrays(
            [pa.array([h.decode("utf-8", "replace") for h in heads], pa.string()), pa.array(texts, pa.string()), pa.array(contents, pa.binary()), pa.array(whole, pa.bool_())], ["headers", "block", "content", "whole"]
        )

    lines = spark.read.option("lineSep", _NEXT.decode()).text(path).select(F.col("value").cast("binary").alias("value"))
    rows = lines.mapInArrow(parsed, "headers string, block string, content binary, whole boolean")
    header = lambda name: F.nullif(F.regexp_extract("headers", rf"(?im)^{name}:\s*(.*?)\r?$", 1), F.lit(""))
    return rows.select(
        header("WARC-Type").alias("record_type"), header("WARC-Record-ID").alias("record_id"), header("WARC-Refers-To").alias("refers_to"), header("WARC-Target-URI").alias("target_uri"),
        header("WARC-Date").alias("date"), header("WARC-Payload-Digest").alias("payload_digest"), "headers", "block", "content", "whole",
    )


def payload_of(content: bytes | None) -> tuple[str, str | None]:
    """(HTTP header block, payload as text) of a response's content; null for a payload that is no text.

    Chunked and gzip-coded payloads are decoded; the character set is the header's, else UTF-8, with replacement
    characters for what it cannot read.
    """
    http, _, body = (content or b"").partition(_BREAK)
    head = http.decode("latin-1")
    named = lambda name: (m[1].strip() if (m := re.search(rf"^{name}:(.*)$", head, re.I | re.M)) else "")
    if named("Transfer-Encoding").lower() == "chunked":
        body = _unchunked(body)
    if named("Content-Encoding").lower() == "gzip":
        try:
            body = gzip.decompress(body)
        except (OSError, EOFError, zlib.error):  # stored decoded, as many archives do
            pass
    kind = named("Content-Type").lower()
    if kind and not re.match(r"text/|application/(xhtml|xml|json)", kind):
        return head, None
    charset = m[1] if (m := re.search(r"charset=[\"']?([\w.:-]+)", kind)) else "utf-8"
    try:
        return head, body.decode(charset, "replace")
    except LookupError:
        return head, body.decode("utf-8", "replace")


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while m := re.compile(rb"([0-9a-fA-F]+)[^\r\n]*\r\n").match(body, at):
        size = int(m[1], 16)
        if not size:
            return b"".join(out)
        out.append(body[m.end() : m.end() + size])
        at = m.end() + size + 2
    return b"".join(out) if out else body  # stored decoded


def responses_from_warc(records: DataFrame) -> DataFrame:
    """What ``derivatives`` takes, from the response records of ``read_warc``; other records are left out."""
    bounded_batches(records.sparkSession)

    def split(batches):
        for batch in batches:
            http, payload = zip(*map(payload_of, batch.column("content").to_pylist()), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(http, pa.string()), pa.array(payload, pa.string())], ["record_id", "target_uri", "date", "payload_digest", "http", "payload"])

    rows = records.where("record_type = 'response'").select("record_id", "target_uri", "date", "payload_digest", "content")
    return rows.mapInArrow(split, "record_id string, target_uri string, date string, payload_digest string, http string, payload string")
