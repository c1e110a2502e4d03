"""JSON lines of reviews and product metadata, local, gzipped or over HTTP, as typed rows."""

from __future__ import annotations

import http.client
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from roundforge.functions import text
from roundforge.sources import stores

TIMEOUT, BATCH, PIECE = 60, 10_000, 1 << 18
#: Bytes of a file that one task reads; attempts in a row that may bring nothing; seconds before the second one, doubled each time.
RANGE_BYTES, RETRIES, PAUSE = 32_000_000, 5, 0.2


def _request(url: str, method: str = "GET", start: int = 0):
    headers = {"User-Agent": "roundforge/1"} | ({"Range": f"bytes={start}-"} if start else {})
    return urllib.request.urlopen(urllib.request.Request(url, headers=headers, method=method), timeout=TIMEOUT)


def stream(url: str, start: int = 0) -> Iterator[bytes]:
    """The bytes of an address from a place on. A connection that breaks, or ends too soon, is made anew at the first byte that is
    missing; if the file has changed since, that is an error. An address that is not there is none of these, and told at once."""
    at, failed, mark, last = start, 0, None, None
    while failed < RETRIES:
        if failed:
            time.sleep(PAUSE * 2 ** (failed - 1))
        before = at
        try:
            with _request(url, start=at) as raw:
                now = raw.headers.get("ETag") or raw.headers.get("Last-Modified")
                if mark is not None and now != mark:
                    raise ValueError(f"{url} has changed while it was read")
                mark = now
                skip = at if raw.status != 206 else 0  # a server that knows no ranges begins again
                length = raw.headers.get("Content-Length")
                end = None if length is None else int(length) + (0 if raw.status != 206 else at)
                while piece := raw.read(PIECE):
                    piece, skip = piece[skip:], max(0, skip - len(piece))
                    at += len(piece)
                    if piece:
                        yield piece
                if end is None or at >= end:
                    return
                last = f"{end - at} bytes are missing"
        except urllib.error.HTTPError as e:
            if e.code == 416:
                return  # nothing is behind the end
            if e.code < 500 and e.code not in (408, 429):
                raise
            last = str(e)
        except (OSError, http.client.HTTPException) as e:
            last = str(e)
        failed = 1 if at > before else failed + 1
    raise OSError(f"{url} broke off at byte {at}: {last}")


def _gunzipped(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Members of a gzip file, one after the other."""
    member = zlib.decompressobj(31)
    for piece in pieces:
        while piece:
            yield member.decompress(piece)
            piece = member.unused_data
            if member.eof:
                member = zlib.decompressobj(31)
            else:
                break


class HttpLines(DataSource):
    """Lines of addresses (option path, comma-separated), which \\n or \\r\\n ends. A file whose server tells its length and takes ranges is cut into ranges of
    ``rangeBytes``, a partition each, with the lines that begin there; a gzip file is one partition. A broken connection goes on where it broke."""

    @classmethod
    def name(cls) -> str:
        return "roundforge_http_lines"

    def schema(self) -> str:
        return "value string, line long, source string"

    def reader(self, schema) -> DataSourceReader:
        return HttpLinesReader(self.options["path"].split(","), int(self.options.get("rangeBytes", RANGE_BYTES)))


@dataclass
class Range(InputPartition):
    number: int
    url: str
    lo: int
    hi: int | None  # None: the end, wherever it is


class HttpLinesReader(DataSourceReader):
    def __init__(self, urls: list[str], range_bytes: int) -> None:
        self.urls, self.range_bytes = urls, range_bytes

    def _cuts(self, url: str) -> list[tuple[int, int | None]]:
        if url.lower().endswith(".gz"):
            return [(0, None)]
        try:
            with _request(url, "HEAD") as told:
                size = int(told.headers.get("Content-Length") or 0)
                ranged = told.headers.get("Accept-Ranges", "").lower() == "bytes"
        except (OSError, http.client.HTTPException):
            return [(0, None)]  # read() tells what is wrong, if it is
        if not ranged or size <= self.range_bytes:
            return [(0, None)]
        return [(lo, min(size, lo + self.range_bytes)) for lo in range(0, size, self.range_bytes)]

    def partitions(self) -> list[InputPartition]:
        cuts = [(u, lo, hi) for u in self.urls for lo, hi in self._cuts(u)]
        return [Range(k, *c) for k, c in enumerate(cuts)]

    @staticmethod
    def _lines(url: str, lo: int, hi: int | None) -> Iterator[bytes]:
        """Lines that begin in a range. Reading starts a byte early, as a line may begin just there."""
        at = max(0, lo - 1)
        pieces = stream(url, at)
        if url.lower().endswith(".gz"):
            pieces = _gunzipped(pieces)
        rest, skipping = b"", lo > 0
        for piece in pieces:
            parts = (rest + piece).split(b"\n")
            rest = parts.pop()
            for line in parts:
                if not skipping:
                    yield line.removesuffix(b"\r")
                skipping = False
                at += len(line) + 1
                if hi is not None and at >= hi:
                    return
        if rest and not skipping:
            yield rest.removesuffix(b"\r")

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows: list[str] = []
        at = partition.number << 33
        for line in self._lines(partition.url, partition.lo, partition.hi):
            rows.append(line.decode("utf-8"))
            if len(rows) == BATCH:
                yield self._batch(rows, at, partition.url)
                rows, at = [], at + BATCH
        if rows:
            yield self._batch(rows, at, partition.url)

    @staticmethod
    def _batch(rows: list[str], at: int, url: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(range(at, at + len(rows)), pa.int64()), pa.array([url] * len(rows))], names=["value", "line", "source"])


def read_lines(spark: SparkSession, source: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """value, pos, source. Over http(s) by the data source above; else Spark's text reader, whose codec opens .gz files. pos rises with
    the lines of a file."""
    if source.lower().startswith(("http://", "https://")):
        spark.dataSource.register(HttpLines)
        return spark.read.format("roundforge_http_lines").option("rangeBytes", range_bytes).load(source).withColumnRenamed("line", "pos")
    lines = spark.read.text(source).select("value", F.col("_metadata.file_path").alias("source"))
    return lines.withColumn("pos", F.monotonically_increasing_id())


def _before(lines: DataFrame) -> DataFrame:
    """part, n, before: the lines of each partition and of those before it, a row for each. pos has a partition in its upper bits and the
    place there in its lower ones."""
    sizes = lines.groupBy(F.shiftright("pos", 33).alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("before", before)


def numbered(lines: DataFrame) -> DataFrame:
    """Lines with number, from 0 without gaps."""
    sizes = _before(lines).select(F.col("part").alias("__part"), F.col("before").alias("__before"))
    number = F.col("__before") + F.col("pos").bitwiseAND(F.lit((1 << 33) - 1))
    return lines.withColumn("__part", F.shiftright("pos", 33)).join(F.broadcast(sizes), "__part").withColumn("number", number.cast("long")).drop("__part", "__before")


def capped(lines: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` physical lines; blank ones count. Where they end is one number, so what follows is never looked at."""
    if limit is None:
        return lines
    if limit < 1:
        return lines.limit(0)
    end = _before(lines).filter((F.col("before") < limit) & (F.col("before") + F.col("n") >= limit)).select(F.shiftleft("part", 33) + limit - F.col("before")).first()
    return lines.filter(F.col("pos") < end[0]) if end else lines


def decode(lines: DataFrame, strict: bool = True) -> DataFrame:
    """pos and doc, a variant: blank lines and values that are no objects are left out; a bad line is an error that names its source and
    place, or left out if not strict."""
    rows = lines.filter(F.trim("value") != "").withColumn("doc", F.try_parse_json("value"))
    if strict:
        bad = F.raise_error(F.concat(F.lit("invalid JSON in "), "source", F.lit(" at "), F.col("pos").cast("string")))
        rows = rows.withColumn("doc", F.when(F.col("doc").isNull() & ~F.col("value").rlike(r"^\s*null\s*$"), bad.cast("string").try_cast("variant")).otherwise(F.col("doc")))
    return rows.filter(F.schema_of_variant("doc").startswith("OBJECT")).select("pos", "doc")


def category_sources(category: str, raw: str | None, review_base: str = "", meta_base: str = "") -> tuple[str, str]:
    """Reviews and metadata of a category: below addresses, or files of a folder, gzipped first."""
    if raw is None:
        return f"{review_base}/{category}.jsonl", f"{meta_base}/meta_{category}.jsonl"
    out = []
    for stem in (category, f"meta_{category}"):
        found = [p for p in (f"{raw}/{stem}.jsonl.gz", f"{raw}/{stem}.jsonl") if stores.kind(p) is fs.FileType.File]
        if not found:
            raise FileNotFoundError(f"no file for {stem} in {raw}")
        out.append(found[0])
    return out[0], out[1]


def _get(doc: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(doc, path, kind)


def _string(doc: Column, path: str) -> Column:
    """The value at a path if it is a string."""
    value = _get(doc, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", _get(doc, path, "string"))


def first_url(doc: Column, keys: list[str], prefer_main: bool = False) -> Column:
    """The first http(s) URL of images, which is a list of objects (searched row by row, keys in order; if any is MAIN, those only) or
    an object of lists (searched key by key; places that are MAIN first)."""
    url = lambda s: s.rlike("^https?://")
    first = lambda a: F.get(F.filter(a, lambda s: F.coalesce(url(s), F.lit(False))), F.lit(0))
    items = F.coalesce(_get(doc, "$.images", "array<variant>"), F.array().cast("array<variant>"))
    if prefer_main:
        main = F.filter(items, lambda i: F.coalesce(_get(i, "$.variant", "string") == "MAIN", F.lit(False)))
        items = F.when(F.size(main) > 0, main).otherwise(items)
    by_row = first(F.flatten(F.transform(items, lambda i: F.array(*[_string(i, f"$.{k}") for k in keys]))))
    marks = F.coalesce(_get(doc, "$.images.variant", "array<string>"), F.array().cast("array<string>"))
    columns = []
    for k in keys:
        one = _string(doc, f"$.images.{k}")
        cells = F.coalesce(_get(doc, f"$.images.{k}", "array<string>"), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))
        if prefer_main:
            is_main = lambda i: F.coalesce(F.get(marks, i) == "MAIN", F.lit(False))
            cells = F.concat(F.filter(cells, lambda c, i: is_main(i)), F.filter(cells, lambda c, i: ~is_main(i)))
        columns.append(first(cells))
    kind = F.schema_of_variant(_get(doc, "$.images", "variant"))
    return F.when(kind.startswith("ARRAY"), by_row).when(kind.startswith("OBJECT"), F.coalesce(*columns))


def reviews(rows: DataFrame) -> DataFrame:
    """Candidates from decoded rows: image, ids, rating, title, text, votes, verified, timestamp in milliseconds."""
    doc = F.col("doc")
    kind = lambda k: F.schema_of_variant(_get(doc, f"$.{k}", "variant"))
    number = kind("rating").rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)")
    rating = F.when(kind("rating") == "BOOLEAN", _get(doc, "$.rating", "boolean").cast("double")).when(number, _get(doc, "$.rating", "double"))
    whole = lambda k: F.when(kind(k).rlike("^(BIGINT|INT|SMALLINT|TINYINT)"), _get(doc, f"$.{k}", "long"))
    verified = F.coalesce(_get(doc, "$.verified_purchase", "boolean"), F.lit(False))
    return rows.select(
        "pos",
        first_url(doc, ["large_image_url", "medium_image_url", "small_image_url"]).alias("review_image"),
        _string(doc, "$.asin").alias("asin"),
        _string(doc, "$.parent_asin").alias("parent_asin"),
        rating.alias("rating"),
        F.coalesce(text.normalize_title(_string(doc, "$.title")), F.lit("Customer review")).alias("review_title"),
        text.clean(_get(doc, "$.text", "string"), text.TEXT_CUT).alias("review_text"),
        F.coalesce(whole("helpful_vote"), F.lit(0)).alias("helpful_vote"),
        verified.alias("verified_purchase"),
        whole("timestamp").alias("timestamp"),
    )


def products(rows: DataFrame) -> DataFrame:
    """Products from decoded rows; those without a title or a parent are left out."""
    doc = F.col("doc")
    raw = F.transform(F.coalesce(_get(doc, "$.categories", "array<variant>"), F.array().cast("array<variant>")), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    path = text.normalize_categories(raw)
    main = F.nullif(text.clean(_string(doc, "$.main_category"), text.CATEGORY_CUT), F.lit(""))
    price_kind = F.schema_of_variant(_get(doc, "$.price", "variant"))
    amount = _get(doc, "$.price", "double")
    price = F.when(price_kind == "STRING", text.parse_price(_get(doc, "$.price", "string"))).when((price_kind != "BOOLEAN") & (amount > 0), amount)
    out = rows.select(
        "pos",
        _string(doc, "$.parent_asin").alias("parent_asin"),
        text.normalize_title(_string(doc, "$.title")).alias("title"),
        F.coalesce(main, F.get(path, F.lit(0)), F.lit("Amazon product")).alias("category"),
        path.alias("category_path"),
        price.alias("price"),
        first_url(doc, ["hi_res", "large", "thumb"], prefer_main=True).alias("product_image"),
        text.normalize_title(_string(doc, "$.store")).alias("store"),
    )
    leaf = F.when(F.size("category_path") > 0, F.element_at("category_path", -1)).otherwise(F.col("category"))
    return out.filter("title is not null and coalesce(parent_asin, '') != ''").withColumn("leaf_category", leaf)
