"""WARC archives: writing with revisits, reading back, and capture histories by an external merge of index runs.

Writing. Records are made and written by Spark expressions, through Spark's text writer, so archives go to any file system
that Spark knows: plain WARC/1.1 files, in which a reader can seek a record by its offset. Pages are written by size classes (``CLASSES``), each with as many
records to a file as keep it under ``FILE_BYTES``; a record that is larger has a file of its own. Of pages with equal payloads of at
least ``least_bytes`` bytes (equal SHA-1 and length), that with the smallest page_id becomes a response, others revisits
of it. Groups are found by partial aggregation on digests; only groups of more than one page are joined back, by broadcast
if they have been measured to be small, else by a shuffle join that adaptive execution splits where a payload is hot.
The tables have no capture time: unless a column is named for it, it is the page_id as seconds after the start of 2020, so that time order is then the order of ids.

Reading. Each archive is parsed by content lengths as one binary file of bounded size; payload digests are computed anew and must
equal the header's. What a task reads gives one run of index entries, sorted by (URL key, time, page_id) and written.

Merging. Runs are cut at common range bounds of the whole key, so a hot URL is split too, and into pages of at most ``PAGE`` entries. Pages, not
entries, are sorted by their first keys; a range reads them in that order and merges the entries of those it has begun with a loser tree, which another page
joins when its first key is due. As a run's pages do not overlap, a range holds about one page of each run, whatever its length. The ranges in order are the global order.

Cases: a null html is an empty payload; a null url has no target line and an empty key; a null page_id has no number in its
record id and is never referred to, as long as another page has the payload; several rows with the smallest page_id of a payload are all
responses. Line breaks in a URL are percent-encoded. No pages give no archives' records and an empty history.
"""

from __future__ import annotations

import base64
import hashlib
import math
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, drop_cut, hash_sample, remove, small, work_path

LEAST_BYTES = 0
#: Bytes of an archive at most, and the largest payloads of the classes that share archives.
FILE_BYTES = 32 << 20
CLASSES = (1 << 14, 1 << 18, 1 << 22)
#: Room that headers have in an archive, for each record.
HEADERS = 2_048
#: Entries of a range of the merge, entries of a page, and keys from which the bounds of ranges are taken.
RANGE_ROWS, PAGE, KEYS = 2_000_000, 1_000, 10_000
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = "\r\n"
_INDEX = "url_key string, captured string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, run long, seq long"


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of the text's UTF-8 bytes: 5 hex digits make 4 letters."""
    code = F.sha1(F.encode(text, "UTF-8"))
    letters = []
    for i in range(0, 40, 5):
        v = F.conv(F.substring(code, i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_ALPHABET), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, 1) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def described(pages: DataFrame, captured: str | None = None) -> DataFrame:
    """page_id, url, captured, payload, payload_bytes, payload_digest."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    start = F.expr("timestamp_ntz'2020-01-01 00:00:00'")
    time = start + F.expr("make_dt_interval(0, 0, 0, coalesce(page_id, 0) % 1000000000)")
    if captured:
        time = F.coalesce(F.col(captured).cast("timestamp_ntz"), start)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", time.alias("captured"), payload.alias("payload"))
    return rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))


def records(pages: DataFrame, least_bytes: int = LEAST_BYTES, captured: str | None = None) -> DataFrame:
    """One WARC record a page, as the column ``record`` without its last line break, and payload_bytes. ``captured`` names a timestamp column."""
    rows = described(pages, captured)
    keys = ["payload_digest", "payload_bytes"]
    groups = rows.select("page_id", *keys).where(F.col("payload_bytes") >= least_bytes).groupBy(*keys).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    rows = rows.join(small(groups.where("n > 1").drop("n")), keys, "left")
    target = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))

    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda key, c: F.coalesce(F.concat(F.lit(key + ": "), c, F.lit(_CRLF)), F.lit(""))
    date = F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_CRLF * 2))
    block = F.when(target.isNull(), F.concat(http, F.col("payload"))).otherwise(http)
    clean = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"),
        line("WARC-Type", F.when(target.isNull(), F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Date", date),
        line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Profile", F.when(target.isNotNull(), F.lit(_PROFILE))),
        line("WARC-Refers-To", F.when(target.isNotNull(), name(target))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(_CRLF),
    )
    return rows.select(F.concat(head, block, F.lit(_CRLF)).alias("record"), "payload_bytes")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, captured: str | None = None) -> None:
    """Archives in ``folder``, a path for Spark's writers."""
    out, size = records(pages, least_bytes, captured), F.octet_length(F.coalesce("html", F.lit("")))
    edges = (-1, *CLASSES, 1 << 31)
    some = pages.agg(*[F.max((size > a) & (size <= b)) for a, b in zip(edges, edges[1:], strict=False)]).first()
    out.limit(0).select("record").write.text(folder)
    for here, least, most in zip(some, edges, edges[1:], strict=False):
        if here:
            own = out.where((F.col("payload_bytes") > least) & (F.col("payload_bytes") <= most)).select("record")
            own.write.mode("append").option("lineSep", _CRLF).option("maxRecordsPerFile", max(1, FILE_BYTES // (most + HEADERS))).text(folder)


def parse(archive: bytes | pa.Buffer) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(headers by lower-case name, block, offset) of each record."""
    archive, at = bytes(archive), 0
    while at < len(archive):
        stop = archive.index(b"\r\n\r\n", at)
        version, *lines = archive[at:stop].decode("utf-8", "replace").split(_CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        size = int(headers["content-length"])
        yield headers, archive[stop + 4 : stop + 4 + size], at
        at = stop + 4 + size + 4


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query, so that captures of a domain stand together."""
    if not url or "://" not in url:
        return url or ""
    rest = url.split("://", 1)[1].split("#", 1)[0]
    cuts = [i for i in (rest.find("/"), rest.find("?")) if i >= 0]
    host, tail = (rest[: min(cuts)], rest[min(cuts) :]) if cuts else (rest, "")
    return ",".join(reversed(host.lower().removeprefix("www.").split("."))) + ")" + (tail or "/")


def _entry(headers: dict[str, str], block: bytes) -> tuple:
    number = lambda name: int(x) if (x := headers.get(name, "").removeprefix("<urn:page:").removesuffix(">")).lstrip("-").isdigit() else None
    head, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":", 1)[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "response":
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if own != digest or len(payload) != size:
            raise ValueError(f"payload of {headers['warc-record-id']} is not what was written")
    url = headers.get("warc-target-uri")
    return url_key(url), headers["warc-date"], number("warc-record-id"), url, size, digest, headers["warc-type"], number("warc-refers-to")


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Index entries of all archives; those that one task reads (of archives of spark.sql.files.maxPartitionBytes) are a run, sorted by key, with their place in ``seq``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, run = [], None
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                run = run or int.from_bytes(hashlib.blake2b(path.encode(), digest_size=7).digest(), "big")
                rows += [(*_entry(h, x), path, at) for h, x, at in parse(content.as_buffer())]
        rows.sort(key=_order)
        for k in range(0, len(rows), 20_000):
            yield _batch([(*r, run, k + i) for i, r in enumerate(rows[k : k + 20_000])], _NAMES, _TYPES)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(read, _INDEX)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


_NAMES = [x.split()[0] for x in _INDEX.split(", ")]
_TYPES = [pa.int64() if x.endswith(" long") else pa.string() for x in _INDEX.split(", ")]


def _order(row: tuple) -> tuple:
    return row[0], row[1], -(1 << 63) if row[2] is None else row[2]


class LoserTree:
    """Merges sorted sequences: each inner node holds the loser of the match between its subtrees, the winner goes on."""

    def __init__(self, sequences: Iterable[Iterable[tuple]], key: Callable = lambda x: x):
        self.sources, self.key = [iter(s) for s in sequences], key
        self.k = len(self.sources)
        self.heads = [next(s, None) for s in self.sources]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.play()

    def play(self) -> None:
        """All matches anew, from the heads."""
        self.losers = [-1] * max(1, self.k)
        winners = [0] * (2 * self.k)
        for i in range(self.k):
            winners[self.k + i] = i
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.wins(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def join(self, sequences: list[Iterable[tuple]]) -> None:
        """Sequences that come later, in the places of those that have ended."""
        left = [i for i in range(self.k) if self.heads[i] is not None]
        new = [iter(s) for s in sequences]
        first = [next(s, None) for s in new]
        self.sources = [self.sources[i] for i in left] + new
        self.keys = [self.keys[i] for i in left] + [None if h is None else self.key(h) for h in first]
        self.heads = [self.heads[i] for i in left] + first
        self.k = len(self.sources)
        self.play()

    def wins(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def upto(self, limit=None) -> Iterator[tuple]:
        """What is not over the limit, or all."""
        while self.k and self.heads[self.winner] is not None and (limit is None or self.keys[self.winner] <= limit):
            w = self.winner
            yield self.heads[w]
            self.heads[w] = head = next(self.sources[w], None)
            self.keys[w] = None if head is None else self.key(head)
            node = (w + self.k) // 2
            while node:
                if self.wins(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w

    def __iter__(self) -> Iterator[tuple]:
        return self.upto()


def merge_pages(pages: Iterator[tuple], key: Callable = lambda x: x) -> Iterator[tuple]:
    """Merges pages, that is (first key, function that gives the sorted rows), which come in the order of their first keys. Pages are taken up as many at a
    time as are held, so that taking them up costs no more than merging them, and no page before it is due or next to one that is."""
    ahead, tree = next(pages, None), LoserTree([], key)
    while ahead is not None:
        new, most = [], max(1, sum(h is not None for h in tree.heads))
        while ahead is not None and len(new) < most:
            new.append(ahead[1]())
            ahead = next(pages, None)
        tree.join(new)
        yield from tree.upto(None if ahead is None else ahead[0])


def merge(index: DataFrame) -> DataFrame:
    """The entries of sorted runs in global order of (URL key, time, page_id): ``part`` numbers the ranges and ``place`` the entries in a range."""
    spark = index.sparkSession
    total = index.count()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / RANGE_ROWS))
    some = hash_sample(index.withColumn("__at", F.struct("run", "seq")), "__at", min(1.0, KEYS / max(1, total)), 17)
    keys = sorted(_order(tuple(r)) for r in some.select("url_key", "captured", "page_id").toLocalIterator())  # about KEYS at most
    bounds = [keys[len(keys) * i // n] for i in range(1, n)] if keys else []
    shared = spark.sparkContext.broadcast(bounds)

    def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, at = [], 0
            order = [_order(r) for r in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True)]
            run, parts = b.column("run").to_pylist(), [bisect_right(shared.value, k) for k in order]
            for i in range(1, b.num_rows + 1):
                if i == b.num_rows or i - at == PAGE or run[i] != run[at] or parts[i] != parts[at] or order[i] < order[i - 1]:
                    out.append((parts[at], *order[at], b.slice(at, i - at).serialize().to_pybytes()))
                    at = i
            if out:
                yield _batch(out, ["part", "k", "c", "i", "entries"], [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.binary()])

    def join_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(list(zip(_NAMES, _TYPES, strict=True)))

        def rows(data: bytes) -> Iterator[tuple]:
            return iter(list(zip(*[c.to_pylist() for c in pa.ipc.read_record_batch(pa.py_buffer(data), schema).columns], strict=True)))

        def pages() -> Iterator[tuple]:
            for b in batches:
                for k, c, i, data in zip(*[b.column(x).to_pylist() for x in ("k", "c", "i", "entries")], strict=True):
                    yield (k, c, i), lambda data=data: rows(data)

        out, place = [], 0
        for row in merge_pages(pages(), _order):
            out.append((*row, place))
            place += 1
            if len(out) == 20_000:
                yield _batch(out, [*_NAMES, "place"], [*_TYPES, pa.int64()])
                out = []
        if out:
            yield _batch(out, [*_NAMES, "place"], [*_TYPES, pa.int64()])

    dealt = index.mapInArrow(paged, "part int, k string, c string, i long, entries binary").repartitionById(n, "part").sortWithinPartitions("k", "c", "i")
    return dealt.mapInArrow(join_pages, _INDEX + ", place long").select(F.spark_partition_id().alias("part"), "*").drop("run", "seq")


def history(pages: DataFrame, least_bytes: int = LEAST_BYTES, captured: str | None = None) -> DataFrame:
    """Writes the pages to archives in the shared folder, reads them back, and returns the merged index; the archives go when it has been read."""
    spark = pages.sparkSession
    folder = work_path(spark, "archives")
    write_archives(pages, folder, least_bytes, captured)
    index = cut(runs(spark, folder), "index")
    remove(spark, folder)
    merged = cut(merge(index), "history")
    drop_cut(index)
    return merged


def captures(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, from the archives as read back."""
    return history(pages, least_bytes).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
