"""Privacy screening: text flags, image flags, model scores, roll-ups and filters."""

from __future__ import annotations

import importlib.util
import io
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundforge.functions import pictures

#: Patterns, flags and severities; letters match whatever their case where it says so.
TEXT_CHECKS = [
    ("contact_email", "high", r"(?iU)(?<![\w.+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}(?![\w-])"),
    ("contact_phone", "high", r"(?<!\d)(?:\+?1[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]\d{3}[ .-]\d{4}(?!\d)"),
    ("external_url", "medium", r"(?iU)\b(?:https?://|www\.)[^\s<>()]+"),
    ("social_handle", "medium", r"(?U)(?<![\w@])@[A-Za-z0-9_][A-Za-z0-9_.-]{2,30}(?![\w@])"),
    ("possible_coordinates", "high", r"(?<!\d)([-+]?(?:[0-8]?\d(?:\.\d+)?|90(?:\.0+)?))\s*,\s*([-+]?(?:1[0-7]\d(?:\.\d+)?|180(?:\.0+)?|(?:\d?\d)(?:\.\d+)?))(?!\d)"),
]
WEIGHTS = {"low": 5, "medium": 20, "high": 50}
EXIF_FLAGS = {315: "exif_artist", 33432: "exif_copyright", 37510: "exif_user_comment", 42032: "exif_camera_owner", 42033: "exif_camera_serial"}
FLAG = "struct<name:string,severity:string,source:string>"
REVIEW_THRESHOLD, HIGH_THRESHOLD = 0.60, 0.95


def flag(name: str, severity: str, source: str) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(severity).alias("severity"), F.lit(source).alias("source"))


def _blob(title: Column, text: Column) -> Column:
    """A review's title and text as one string."""
    part = lambda c: F.when(F.trim(c) != "", c)
    return F.concat_ws("\n", part(title), part(text))


def _may_have(name: str, blob: Column) -> Column:
    """What any match of a check has, and is found quickly: most texts need no more."""
    return {
        "contact_email": blob.contains("@"),
        "contact_phone": blob.rlike("[0-9]{3}[ .-][0-9]{4}"),
        "external_url": blob.contains("://") | blob.rlike("[Ww]{3}[.]"),
        "social_handle": blob.contains("@"),
        "possible_coordinates": blob.rlike(r"[0-9]\s*,\s*[-+]?[0-9]"),
    }[name]


def text_flags(title: Column, text: Column) -> Column:
    """Flags of a review's title and text, which are searched as one string."""
    return _blob_flags(_blob(title, text))


def _blob_flags(blob: Column) -> Column:
    return F.array_compact(F.array(*[F.when(_may_have(n, blob) & blob.rlike(p), flag(n, s, "review_text")) for n, s, p in TEXT_CHECKS]))


def summary_of(flags: Column) -> Column:
    """The struct screening of an array of flags, equal ones counted once."""
    own = F.array_distinct(flags)
    of = lambda s: F.size(F.filter(own, lambda f: f["severity"] == s))
    score = F.least(F.lit(100), sum((of(s) * w for s, w in WEIGHTS.items()), F.lit(0)))
    histogram = F.map_filter(F.create_map(*[x for s in ("high", "low", "medium") for x in (F.lit(s), of(s))]), lambda _, n: n > 0)
    return F.struct(score.cast("int").alias("risk_score"), (F.size(own) > 0).alias("needs_review"), (of("high") > 0).alias("high_risk"), own.alias("flags"), histogram.alias("severity_counts"))


def screen(rounds: DataFrame, extra: Column | None = None) -> DataFrame:
    """``rounds`` (review_title, review_text) with screening; ``extra`` flags come after those of the text."""
    flags = _blob_flags(F.col("__blob"))
    own = F.array_distinct(F.concat(flags, extra) if extra is not None else flags)
    # a row is exploded into itself: the patterns are searched once, however often the summary looks at the flags, and no filter on the summary goes below and searches again
    found = rounds.withColumn("__blob", _blob(F.col("review_title"), F.col("review_text"))).withColumn("__flags", F.explode_outer(F.array(own)))
    return found.withColumn("screening", summary_of(F.col("__flags"))).drop("__blob", "__flags")


def exclude_high(screened: DataFrame) -> DataFrame:
    return screened.filter(~F.col("screening.high_risk"))


def roll_up(screened: DataFrame, excluding: bool = False) -> DataFrame:
    """measure, key, n: rounds, needs_review, high_risk, and counts of flags and severities; excluded and written, where rounds of high
    risk are left out. Excluded rounds count in all the rest too."""
    high = F.col("screening.high_risk")
    left = [F.when(high, F.lit("excluded")).otherwise(F.lit("written"))] if excluding else []
    one = F.array(F.lit("rounds"), *left, F.when(F.col("screening.needs_review"), F.lit("needs_review")), F.when(F.col("screening.high_risk"), F.lit("high_risk")))
    pair = lambda m, k: F.struct(F.lit(m).alias("measure"), k.alias("key"))
    rows = F.concat(F.transform(F.array_compact(one), lambda k: pair("total", k)), F.transform("screening.flags", lambda f: pair("flag", f["name"])), F.transform("screening.flags", lambda f: pair("severity", f["severity"])))
    return screened.select(F.explode(rows).alias("x")).groupBy("x.measure", "x.key").agg(F.count("*").alias("n"))


def image_state_flags(path: Column, exists: Column) -> Column:
    """For a round whose image should be a local file."""
    return F.when(path.isNull(), F.array().cast(f"array<{FLAG}>")).when(exists.isNull(), F.array(flag("image_not_local", "low", "image"))).when(~exists, F.array(flag("image_missing", "high", "image"))).otherwise(F.array().cast(f"array<{FLAG}>"))


def _header_flags(content: bytes | None) -> list[dict]:
    """As _image_flags() without detectors, by the headers of JPEG and PNG files, where Pillow is missing. Other formats can't be told from bytes
    that are no image then, so they are an error."""
    if content and (content.startswith((b"GIF8", b"BM")) or content[8:12] == b"WEBP" or content[4:8] == b"ftyp"):
        needs("PIL")
    try:
        h = pictures.read_header(bytes(content))
    except (pictures.Unreadable, TypeError, struct.error):
        return [{"name": "image_unreadable", "severity": "medium", "source": "image"}]
    out = [("exif_gps_location", "high", "image_metadata")] * h.gps
    out += [(n, "medium", "image_metadata") for tag, n in EXIF_FLAGS.items() if h.tags.get(tag, b"").strip(b"\0")]
    out += [("very_small_image", "low", "image")] * (min(h.width, h.height) < 160)
    out += [("extreme_aspect_ratio", "low", "image")] * (max(h.width, h.height) >= 5 * max(1, min(h.width, h.height)))
    return [{"name": n, "severity": s, "source": w} for n, s, w in out]


def _image_flags(content: bytes | None, detectors: list[Callable]) -> list[dict]:
    from PIL import Image

    out = []
    try:
        with Image.open(io.BytesIO(content)) as image:
            width, height = image.size
            exif = image.getexif()
            if exif.get_ifd(0x8825):
                out.append(("exif_gps_location", "high", "image_metadata"))
            out += [(n, "medium", "image_metadata") for tag, n in EXIF_FLAGS.items() if exif.get(tag) or exif.get_ifd(0x8769).get(tag)]
            if min(width, height) < 160:
                out.append(("very_small_image", "low", "image"))
            if max(width, height) >= 5 * max(1, min(width, height)):
                out.append(("extreme_aspect_ratio", "low", "image"))
            for detect in detectors:
                out += detect(image)
    except Exception:  # whatever a decoder raises for bytes that are no image
        out = [("image_unreadable", "medium", "image")]
    return [{"name": n, "severity": s, "source": w} for n, s, w in out]


def opencv_detector(faces: bool = True, codes: bool = True) -> Callable:
    """A detector of faces and QR codes for image_flags(); its model is loaded on first use in a worker."""
    made: dict[str, object] = {}

    def detect(image) -> list[tuple[str, str, str]]:
        import cv2
        import numpy as np

        grey, out = np.asarray(image.convert("L")), []
        if faces:
            if "faces" not in made:
                made["faces"] = cv2.CascadeClassifier(f"{cv2.data.haarcascades}haarcascade_frontalface_default.xml")
            if len(made["faces"].detectMultiScale(grey, scaleFactor=1.1, minNeighbors=5, minSize=(30, 30))):
                out.append(("person_face_detected", "medium", "image"))
        if codes:
            text, corners, _ = cv2.QRCodeDetector().detectAndDecode(np.asarray(image.convert("RGB"))[:, :, ::-1])
            if text or corners is not None:
                out.append(("qr_code_detected", "medium", "image"))
        return out

    return detect


def needs(*modules: str) -> None:
    """An error that names what is missing, instead of images without flags."""
    for m in modules:
        if importlib.util.find_spec(m) is None:
            raise RuntimeError(f"screening of images needs the library {m}")


def image_flags(images: DataFrame, detectors: list[Callable] | None = None, faces: bool = False, codes: bool = False) -> DataFrame:
    """``images`` (path, content) with flags from metadata, size and detectors: the given ones (of a Pillow image; they return name, severity and
    source), and OpenCV's for faces and QR codes. Detectors need Pillow, and those for faces and codes OpenCV; without detectors the headers of
    JPEG and PNG files are enough where Pillow is missing."""
    plain = not (detectors or faces or codes) and importlib.util.find_spec("PIL") is None
    if not plain:
        needs("PIL", *["cv2"] * (faces or codes))
    detectors = [*(detectors or []), *([opencv_detector(faces, codes)] if faces or codes else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "flags": [_header_flags(c) if plain else _image_flags(c, detectors) for c in b["content"]]})

    return images.select("path", "content").mapInPandas(run, f"path string, flags array<{FLAG}>")


def normalize_label(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[\s_-]+", " "))


def check_thresholds(review: float, high: float) -> None:
    if not 0 <= review <= high <= 1:
        raise ValueError("thresholds must satisfy 0 <= review <= high <= 1")


def score_flags(scores: Column, positive: list[str], review: float = REVIEW_THRESHOLD, high: float = HIGH_THRESHOLD) -> Column:
    """Flags of classifier scores, an array of (label, score): the best positive label decides."""
    check_thresholds(review, high)
    if not positive:
        raise ValueError("at least one positive label is needed")
    wanted = F.array(*[normalize_label(F.lit(p)) for p in positive])
    own = F.filter(scores, lambda s: s["score"].between(0, 1) & F.array_contains(wanted, normalize_label(s["label"])))
    top = F.coalesce(F.array_max(F.transform(own, lambda s: s["score"])), F.lit(0.0))
    return F.when(top >= high, F.array(flag("model_nsfw_content", "high", "image_model"))).when(top >= review, F.array(flag("model_nsfw_content", "medium", "image_model"))).otherwise(F.array().cast(f"array<{FLAG}>"))


def parse_device(value: str | None) -> int | str | None:
    """Where a model runs: None chooses by itself, -1 is the CPU, a number is a device; anything else is passed on."""
    plain = (value or "").strip().lower()
    if plain in ("", "auto"):
        return None
    if plain == "cpu":
        return -1
    return int(plain) if plain.lstrip("+-").isdigit() else value


def device(value: Column) -> Column:
    """parse_device() for a column, as text."""
    plain = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(plain.isin("", "auto"), F.lit(None)).when(plain == "cpu", "-1").when(plain.rlike("^[+-]?[0-9]+$"), plain.cast("long").cast("string")).otherwise(value)


def classify(images: DataFrame, load: Callable[[], Callable[[bytes], list[dict]]]) -> DataFrame:
    """``images`` (path, content) with scores. The model is loaded once by each worker, and each distinct path is classified once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "scores": [model(c) for c in b["content"]]})

    return images.dropDuplicates(["path"]).select("path", "content").mapInPandas(run, "path string, scores array<struct<label:string,score:double>>")


def matches(screening: Column, choice: str) -> Column:
    """The curator's screening filter: review, high, clear, unscreened or all."""
    needs, high = needs_review(screening), high_risk(screening)
    return {"review": needs, "high": high, "clear": screening.isNotNull() & ~needs, "unscreened": screening.isNull()}.get(choice, F.lit(True))


def needs_review(screening: Column) -> Column:
    return F.coalesce(screening["needs_review"], F.lit(False)) | F.coalesce(F.size(screening["flags"]) > 0, F.lit(False))


def high_risk(screening: Column) -> Column:
    return F.coalesce(screening["high_risk"], F.lit(False)) | F.coalesce(F.exists(screening["flags"], lambda f: f["severity"] == "high"), F.lit(False))


def status_label(screening: Column) -> Column:
    return F.when(screening.isNull(), "Not screened").when(high_risk(screening), "High risk").when(needs_review(screening), "Review suggested").otherwise("Clear")


def sorted_flags(flags: Column) -> Column:
    """Worst first, then by name."""
    rank = lambda f: F.when(f["severity"] == "high", 3).when(f["severity"] == "medium", 2).when(f["severity"] == "low", 1).otherwise(0)
    keyed = F.array_sort(F.transform(flags, lambda f: F.struct((-rank(f)).alias("r"), f["name"].alias("n"), f.alias("f"))))
    return F.transform(keyed, lambda k: k["f"])
