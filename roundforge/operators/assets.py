"""Image caches: extensions, exact and perceptual duplicates, references against files."""

from __future__ import annotations

import importlib.util
import io
import mimetypes
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundforge.functions import hashing, pictures
from roundforge.functions.text import safe_path
from roundforge.operators.screening import needs
from roundforge.session import checkpointed
from roundforge.sinks import writers
from roundforge.sources import images

MAX_THRESHOLD = 16
#: First bytes of image formats, and content types.
MAGIC = {".jpg": "FFD8FF", ".png": "89504E470D0A1A0A", ".gif": "47494638"}
CONTENT_TYPES = {".jpg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".webp": "image/webp", ".avif": "image/avif"}


def check_threshold(threshold: int) -> None:
    if not 0 <= threshold <= MAX_THRESHOLD:
        raise ValueError(f"the threshold must be 0 to {MAX_THRESHOLD}")


def extension(content: Column, content_type: Column, url: Column) -> Column:
    """By the first bytes, else the content type, else the URL's suffix, else '.img'."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.lit(None).cast("string")
    for e, m in MAGIC.items():
        out = F.coalesce(out, F.when(head.startswith(m), e))
    out = F.coalesce(out, F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), ".webp"))
    plain = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    for e, t in CONTENT_TYPES.items():
        out = F.coalesce(out, F.when(plain == t, e))
    suffix = F.lower(F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), r"(\.[A-Za-z0-9]{1,5})$", 1))
    suffix = F.when(suffix == ".jpeg", ".jpg").otherwise(suffix)
    return F.coalesce(out, F.when(suffix.isin(*CONTENT_TYPES), suffix), F.lit(".img"))


def public_path(prefix: str, name: Column) -> Column:
    return F.concat_ws("/", F.lit(prefix.strip("/")), name)


def _grey(content: bytes) -> np.ndarray | None:
    """The picture as 8 rows of 9 grey values; None if it can't be read. Pillow reads all formats; without it PNG files are read here."""
    try:
        if importlib.util.find_spec("PIL") is None:
            return pictures.shrunk(pictures.png_grey(bytes(content)), 9, 8)
        from PIL import Image, ImageOps

        with Image.open(io.BytesIO(content)) as image:
            return np.asarray(ImageOps.exif_transpose(image).convert("L").resize((9, 8), Image.Resampling.LANCZOS))
    except Exception:  # whatever a decoder raises for bytes that are no image
        return None


def dhash(images_: DataFrame) -> DataFrame:
    """``images_`` (path, content) with dhash, a 64-bit difference hash; null where the image can't be read."""

    def one(content: bytes) -> int | None:
        grey = _grey(content)
        if grey is None:
            return None
        value = sum(1 << i for i, darker in enumerate((grey[:, :-1] > grey[:, 1:]).ravel().tolist()) if darker)
        return value - (1 << 64) if value >> 63 else value

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "dhash": pd.array([one(c) for c in b["content"]], dtype="Int64")})

    return images_.select("path", "content").mapInPandas(run, "path string, dhash long")


def _part(x: Column, lo: int, width: int) -> Column:
    return x if width == 64 else F.shiftrightunsigned(x, lo).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _parts(hashes: DataFrame, threshold: int, name: str) -> DataFrame:
    cut = [F.struct(F.lit(i).alias("part"), _part(F.col("dhash"), lo, w).alias("value")) for i, (lo, w, _) in enumerate(hashing.multi_index(threshold))]
    return hashes.select(F.col("dhash").alias(f"h{name}"), F.explode(F.array(*cut)).alias("p")).select(f"h{name}", "p.part", F.col("p.value").alias(f"v{name}"))


def neighbours(values: DataFrame, threshold: int) -> DataFrame:
    """part, va, vb: every value of a part with the values of that part within its radius."""
    flips = [(i, sum(1 << b for b in bits)) for i, (_, w, r) in enumerate(hashing.multi_index(threshold)) for k in range(r + 1) for bits in combinations(range(w), k)]
    masks = values.sparkSession.createDataFrame(flips, "part int, mask long")  # 8192 at most, whatever the input
    return values.join(F.broadcast(masks), "part").select("part", "va", F.col("va").bitwiseXOR(F.col("mask")).alias("vb"))


def hamming_candidates(left: DataFrame, right: DataFrame, threshold: int) -> DataFrame:
    """part, ha, hb: hashes (column dhash, distinct) that are within the radius of a part, once for each such part.

    A value's neighbours are made once for each different value of a part, not for each hash that has it, and only those stay that are a value of
    the other side."""
    a, b = _parts(left, threshold, "a"), _parts(right, threshold, "b")
    near = neighbours(a.select("part", "va").distinct(), threshold).join(b.select("part", "vb").distinct(), ["part", "vb"], "left_semi")
    return a.join(near, ["part", "va"]).join(b, ["part", "vb"])


#: Hashes of a block, about: a unit of work holds two.
BLOCK = 32_768
#: Share of all pairs of random hashes that may meet in an index; beyond it, comparing all is less work than joining those that meet.
MEET_SHARE = 0.0005
_TILE = 64, 4096  # hashes that are compared at once


def _near(a: np.ndarray, b: np.ndarray, threshold: int) -> Iterator[pd.DataFrame]:
    """All pairs of hashes of two arrays within the threshold."""
    rows, width = _TILE
    for lo in range(0, len(a), rows):
        left, found = a[lo : lo + rows, None], []
        for at in range(0, len(b), width):
            bits = np.bitwise_count(left ^ b[at : at + width])
            x, y = np.divmod(np.flatnonzero(bits <= threshold), bits.shape[1])
            found.append((x + lo, y + at, bits[x, y]))
        x, y, bits = (np.concatenate(c) for c in zip(*found, strict=True)) if found else ([],) * 3
        if len(x):
            yield pd.DataFrame({"ha": a[x].view(np.int64), "hb": b[y].view(np.int64), "distance": bits.astype(np.int32)})


def _all_pairs(left: DataFrame, right: DataFrame | None, threshold: int) -> DataFrame:
    """ha, hb, distance of distinct hashes (column dhash) within the threshold: all against all, ha <= hb where there is no right side.

    Each side is dealt into blocks by a hash, and a pair of blocks is one unit of work and one partition. Work goes with the product of the sides' sizes, as the
    pairs of random hashes themselves do, but a task's work and memory are those of two blocks."""
    n = max(1, -(-left.count() // BLOCK))
    m = n if right is None else max(1, -(-right.count() // BLOCK))
    block = lambda k: F.pmod(F.xxhash64("dhash"), F.lit(k))
    each = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))).alias("other")
    if right is None:  # the first block is the larger one, so that units are numbered without gaps
        i, j = F.greatest("own", "other"), F.least("own", "other")
        sides = left.select("dhash", block(n).alias("own"), each(n))
        sides = sides.select("dhash", (F.col("own") == i).alias("a"), (F.col("own") == j).alias("b"), (F.floor(i * (i + 1) / 2) + j).cast("int").alias("unit"))
        units = n * (n + 1) // 2
    else:
        sides = left.select("dhash", block(n).alias("own"), each(m)).select("dhash", F.lit(True).alias("a"), F.lit(False).alias("b"), (F.col("own") * m + F.col("other")).cast("int").alias("unit"))
        more = right.select("dhash", block(m).alias("own"), each(n)).select("dhash", F.lit(False).alias("a"), F.lit(True).alias("b"), (F.col("other") * m + F.col("own")).cast("int").alias("unit"))
        sides, units = sides.union(more), n * m

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if held:
            h, a, b = (np.concatenate([x[c].to_numpy() for x in held]) for c in ("dhash", "a", "b"))
            yield from _near(h[a].view(np.uint64), h[b].view(np.uint64), threshold)

    found = sides.repartitionById(units, F.col("unit")).select("dhash", "a", "b").mapInPandas(run, "ha long, hb long, distance int")
    if right is not None:
        return found
    # within a block both orders are found, between two blocks one
    return found.select(F.least("ha", "hb").alias("ha"), F.greatest("ha", "hb").alias("hb"), "distance").distinct()


def _near_hashes(left: DataFrame, right: DataFrame | None, threshold: int) -> DataFrame:
    """ha, hb, distance of distinct hashes (column dhash) within the threshold, each pair once, equal hashes too; ha <= hb where there is no right side.

    Multi-index hashing where an index is selective: two such hashes are within a small radius in one of a few parts, so candidates meet in equi-joins of a part's values with
    the other side's neighbours of them. The distance is a condition of that join, and a pair counts in the first part that brings it,
    so only true pairs leave it, once each. Where no index is selective (at 16 of 64 bits 7 % of all pairs meet), all pairs are compared in blocks."""
    check_threshold(threshold)
    parts = hashing.multi_index(threshold)
    if sum(hashing.ball(w, r) / 2**w for _, w, r in parts) > MEET_SHARE:
        return _all_pairs(left, right, threshold)
    differ = F.col("ha").bitwiseXOR(F.col("hb"))
    first = F.coalesce(*[F.when(F.bit_count(_part(differ, lo, w)) <= r, F.lit(i)) for i, (lo, w, r) in enumerate(parts)])
    met = (hashing.hamming(F.col("ha"), F.col("hb")) <= threshold) & (first == F.col("part"))
    if right is None:
        met = met & (F.col("ha") <= F.col("hb"))
    return hamming_candidates(left, left if right is None else right, threshold).filter(met).select("ha", "hb", hashing.hamming(F.col("ha"), F.col("hb")).alias("distance"))


def hamming_pairs(left: DataFrame, threshold: int, right: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b, distance) of ids whose hashes differ in ``threshold`` bits at most; a < b in a self-join.

    Equal hashes are one row of the search, so that copies don't meet in pairs before they are known to be near something."""
    ids = checkpointed(left.filter("dhash is not null").select("dhash", "id").distinct())
    others = ids if right is None else checkpointed(right.filter("dhash is not null").select("dhash", "id").distinct())
    pairs = _near_hashes(ids.select("dhash").distinct(), None if right is None else others.select("dhash").distinct(), threshold)
    out = pairs.join(ids.select(F.col("dhash").alias("ha"), F.col("id").alias("x")), "ha").join(others.select(F.col("dhash").alias("hb"), F.col("id").alias("y")), "hb")
    if right is not None:
        return out.select(F.col("x").alias("a"), F.col("y").alias("b"), "distance")
    out = out.filter((F.col("ha") != F.col("hb")) | (F.col("x") < F.col("y")))
    return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def greedy_perceptual(rows: DataFrame, threshold: int) -> DataFrame:
    """Rows (id, pos, dhash, ...) in order, each dropped if it is within ``threshold`` of a row kept before. Rows without a hash stay.

    Of equal hashes only the first row can be kept, so hashes are settled, not rows: one is once all its earlier neighbours are, dropped if one of them is kept, else
    kept. Each round settles every hash whose earlier neighbours are settled; those without any are kept at once."""
    check_threshold(threshold)
    first = F.min(F.struct("pos", "id"))
    at = checkpointed(rows.filter("dhash is not null").groupBy("dhash").agg(first.alias("at")))
    pairs = _near_hashes(at.select("dhash"), None, threshold).filter("ha <> hb")
    edges = pairs.join(at.select(F.col("dhash").alias("ha"), F.col("at").alias("pa")), "ha").join(at.select(F.col("dhash").alias("hb"), F.col("at").alias("pb")), "hb")
    before = F.col("pa") < F.col("pb")
    edges = checkpointed(edges.select(F.when(before, F.col("ha")).otherwise(F.col("hb")).alias("first"), F.when(before, F.col("hb")).otherwise(F.col("ha")).alias("then")))
    state = checkpointed(edges.select(F.col("then").alias("dhash")).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while not state.filter("kept is null").isEmpty():
        # hashes that aren't in state have no earlier neighbour
        seen = edges.join(state.withColumnsRenamed({"dhash": "first", "kept": "first_kept"}).withColumn("known", F.lit(True)), "first", "left")
        kept = F.when(F.col("known").isNull(), True).otherwise(F.col("first_kept"))
        verdict = seen.withColumn("k", kept).groupBy(F.col("then").alias("dhash")).agg(F.bool_or("k").alias("any_kept"), F.count_if(F.col("k").isNull()).alias("open"))
        settled = F.when(F.coalesce("any_kept", F.lit(False)), False).when(F.col("open") == 0, True)
        state = checkpointed(state.join(verdict, "dhash").select("dhash", F.coalesce("kept", settled).alias("kept")))
    stay = at.join(state.filter("not kept"), "dhash", "left_anti").select(F.col("at.id").alias("id"), F.lit(True).alias("__stays"))
    return rows.join(stay, "id", "left").filter(F.col("dhash").isNull() | F.col("__stays")).select(*rows.columns)


def exact_distinct(rows: DataFrame, digest: str = "sha256", pos: str = "pos") -> DataFrame:
    """The first row of each digest; rows without one stay."""
    first = F.row_number().over(Window.partitionBy(F.coalesce(F.col(digest), F.col(pos).cast("string"))).orderBy(pos))
    return rows.withColumn("__n", first).filter("__n = 1").drop("__n")


def attach_images(rounds: DataFrame, fetched: DataFrame, keep_failed: bool = False) -> DataFrame:
    """Rounds with the fetched image of their URL (url, path, sha256, dhash): original and new path, digests."""
    joined = rounds.join(fetched.dropDuplicates(["url"]).withColumnRenamed("url", "review_image"), "review_image", "left")
    if not keep_failed:
        joined = joined.filter(F.col("path").isNotNull())
    out = joined.withColumn("review_image_original", F.when(F.col("path").isNotNull(), F.col("review_image"))).withColumn("review_image_sha256", F.col("sha256")).withColumn("review_image_dhash", F.when(F.col("dhash").isNotNull(), hashing.dhash_hex(F.col("dhash"))))
    return out.withColumn("review_image", F.coalesce("path", "review_image")).drop("path", "sha256", "dhash")


def cache_rounds(rounds: DataFrame, root: str, folder: str, prefix: str, *, keep_failed: bool = False, keep_exact: bool = False, threshold: int | None = None, max_bytes: int = 20_000_000, workers: int = 12) -> tuple[DataFrame, DataFrame]:
    """Rounds (pos, review_image) whose images are fetched, each address once, and stored in ``folder`` under their digests; and a row of counts.

    Rounds whose image can't be had go, or stay as they are if keep_failed; of rounds with the same image the first stays, and with a
    threshold (which needs Pillow) of those with similar ones."""
    if max_bytes < 1 or workers < 1:
        raise ValueError("max_bytes and workers must be positive")
    if threshold is not None:
        check_threshold(threshold)
        needs("PIL")
    got = checkpointed(images.fetch(rounds, root, workers, max_bytes))
    found = got.filter("error is null").withColumn("extension", extension(F.col("content"), F.col("content_type"), F.col("url")))
    stored = checkpointed(writers.write_assets(found, folder))
    hashes = dhash(found.withColumnRenamed("url", "path")).withColumnRenamed("path", "url") if threshold is not None else None
    known = stored.select("url", public_path(prefix, F.col("name")).alias("path"), "sha256")
    known = known.join(hashes, "url") if hashes is not None else known.withColumn("dhash", F.lit(None).cast("long"))
    attached = checkpointed(attach_images(rounds, known, keep_failed=True))
    good, failed = attached.filter("review_image_sha256 is not null"), attached.filter("review_image_sha256 is null")
    exact = good if keep_exact else exact_distinct(good, "review_image_sha256")
    kept = exact
    if threshold is not None:
        value = F.conv("review_image_dhash", 16, -10).cast("long")
        kept = greedy_perceptual(exact.withColumn("dhash", value), threshold).drop("dhash")
    out = checkpointed(kept.unionByName(failed) if keep_failed else kept)
    one = lambda df, name: df.agg(F.count("*").alias(name))
    stats = one(rounds, "rounds_before").join(one(out, "rounds_after")).join(one(failed, "failed")).join(one(good, "good")).join(one(exact, "exact")).join(one(kept, "kept"))
    sizes = stored.agg(F.coalesce(F.sum("bytes_written"), F.lit(0)).cast("long").alias("bytes_written")).join(one(got, "source_images"))
    files = kept.agg(F.countDistinct("review_image_sha256").alias("unique_files"))
    stats = stats.join(sizes).join(files)  # one row each
    counts = [(F.col("good") - F.col("exact")).alias("exact_duplicates"), (F.col("exact") - F.col("kept")).alias("perceptual_duplicates")]
    return out, stats.select("source_images", "rounds_before", "rounds_after", "failed", *counts, "unique_files", "bytes_written")


def references(*packs: DataFrame, prefix: str = "assets/reviews") -> DataFrame:
    """Distinct safe paths below the prefix that the packs' rounds refer to; the prefix is compared part by part."""
    parts = prefix.strip("/").split("/")
    rows = packs[0].select(F.col("review_image").alias("path"))
    for p in packs[1:]:
        rows = rows.union(p.select("review_image"))
    below = F.slice(F.split("path", "/"), 1, len(parts)) == F.array(*map(F.lit, parts))
    return rows.filter(safe_path(F.col("path")) & below & (F.size(F.split("path", "/")) > len(parts))).distinct()


def reconcile(refs: DataFrame, files: DataFrame) -> DataFrame:
    """path, state (existing, missing, orphaned) and length: references against files."""
    marked = refs.select("path", F.lit(True).alias("r")).join(files.select("path", "length", F.lit(True).alias("f")), "path", "full")
    state = F.when(F.col("r").isNull(), "orphaned").when(F.col("f").isNull(), "missing").otherwise("existing")
    return marked.select("path", state.alias("state"), "length")


def totals(reconciled: DataFrame) -> DataFrame:
    return reconciled.groupBy("state").agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"))


def content_type(path: Column) -> Column:
    """Guessed from the suffix, else octet-stream."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))
    guess = F.lit(None).cast("string")
    for e in [*CONTENT_TYPES, ".jpeg", ".svg", ".json", ".html", ".css", ".js", ".txt"]:
        guess = F.when(suffix == e, CONTENT_TYPES.get(e) or mimetypes.guess_type("x" + e)[0]).otherwise(guess)
    return F.coalesce(guess, F.lit("application/octet-stream"))


def upload_plan(files: DataFrame, root: str, prefix: str) -> DataFrame:
    """path, relative, key, size and content type of what would be published, in order of path."""
    relative = F.regexp_replace(F.substr(F.col("path"), F.lit(len(root) + 1)), "^/+", "")
    return files.filter(F.col("path").startswith(root)).select("path", relative.alias("relative"), public_path(prefix, relative).alias("object_key"), F.col("length").alias("size"), content_type(F.col("path")).alias("content_type")).orderBy("relative")


def deliver(image: Column, prefix: str, base_url: str) -> Column:
    """An asset path below the prefix as an address below the base; anything unsafe stays as it is."""
    start = prefix.strip("/") + "/"
    rest = F.substr(image, F.lit(len(start) + 1))
    return F.when(image.startswith(start) & safe_path(rest), F.concat(F.lit(base_url.rstrip("/") + "/"), rest)).otherwise(image)
