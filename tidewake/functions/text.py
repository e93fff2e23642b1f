"""Times and labels from file names, tags and strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and tag names of radar products.
PRODUCT_NAME = r"S1[ABCD]_[A-Z0-9]{2}_[A-Z0-9]{4}_[0-9A-Z]{4}_(\d{8}T\d{6})_\d{8}T\d{6}"
GENERIC_TIME = r"(?<!\d)(\d{8})[T_-]?(\d{6})(?!\d)"
TIME_TAGS = ("ACQUISITION_START_TIME", "ACQUISITION_TIME", "TIFFTAG_DATETIME", "start_datetime", "datetime", "PRODUCT_START_TIME", "SENSING_START")
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss")
POLARISATION_TAGS = ("POLARISATION", "POLARIZATION", "polarization")


#: What a part of a format can look like; letters of any case, years of any length.
_PARTS = (("yyyy", r"\+?\d{4,}"), ("SSSSSS", r"\d+"), ("SSS", r"\d+"), ("MM", r"\d\d"), ("dd", r"\d\d"), ("HH", r"\d\d"), ("mm", r"\d\d"), ("ss", r"\d\d"), (".", r"\."), ("'", ""))


def _shape(form: str) -> str:
    """A pattern that every text of the format matches: what doesn't is not parsed, as a failed parse costs an exception."""
    out = ""
    while form:
        part, shape = next(((p, s) for p, s in _PARTS if form.startswith(p)), (form[0], form[0]))
        out, form = out + shape, form[len(part) :]
    return f"(?i)^{out}$"


def _time(text: Column, form: str) -> Column:
    return F.when(text.rlike(_shape(form)), F.try_to_timestamp(text, F.lit(form)))


def _first(values: Column, forms: tuple[str, ...]) -> Column:
    """(t, label) of the first of an array of (text, label) that any of the formats reads, null if none; each is parsed once."""
    times = F.transform(values, lambda v: F.struct(F.coalesce(*[_time(v["text"], f) for f in forms]).alias("t"), v["label"].alias("label")))
    return F.get(F.filter(times, lambda x: x["t"].isNotNull()), F.lit(0))


def _in_name(name: Column) -> Column:
    product = F.regexp_replace(F.regexp_extract(name, PRODUCT_NAME, 1), "T", "")
    generic = F.concat(F.regexp_extract(name, GENERIC_TIME, 1), F.regexp_extract(name, GENERIC_TIME, 2))
    both = ((product, "sentinel1_filename"), (generic, "filename_timestamp"))
    return _first(F.array(*[F.struct(text.alias("text"), F.lit(label).alias("label")) for text, label in both]), ("yyyyMMddHHmmss",))


def _in_tags(tags: Column) -> Column:
    values = F.array(*[F.struct(F.try_element_at(tags, F.lit(tag)).alias("text"), F.lit(f"tiff_tag:{tag}").alias("label")) for tag in TIME_TAGS])
    return _first(F.filter(values, lambda v: v["text"] != ""), TIME_FORMATS)


def filename_time(name: Column) -> tuple[Column, Column]:
    """(time, what it came from); null if the name has no time."""
    found = _in_name(name)
    return found["t"], found["label"]


def tag_time(tags: Column) -> tuple[Column, Column]:
    """First tag, in order, that any format reads; ``tags`` is a map."""
    found = _in_tags(tags)
    return found["t"], found["label"]


def scene_time_found(given: Column, tags: Column, name: Column) -> Column:
    """(t, label): the analyst's time, else the tags', else the name's, else now; a column of its own is worked out once a row."""

    def labelled(t: Column, label: str) -> Column:
        return F.struct(t.alias("t"), F.lit(label).alias("label"))

    return F.coalesce(F.when(given.isNotNull(), labelled(given, "analyst")), _in_tags(tags), _in_name(name), labelled(F.current_timestamp(), "assumed_now"))


def scene_time(given: Column, tags: Column, name: Column) -> tuple[Column, Column]:
    """The analyst's time, else the tags', else the name's, else now."""
    found = scene_time_found(given, tags, name)
    return found["t"], found["label"]


def polarisation(tags: Column, name: Column) -> Column:
    tagged = [F.upper(F.nullif(F.try_element_at(tags, F.lit(t)), F.lit(""))) for t in POLARISATION_TAGS]
    return F.coalesce(*tagged, F.upper(F.nullif(F.regexp_extract(name, r"(?i)[-_](vv|vh|hh|hv)\b", 1), F.lit(""))))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def epoch(ts: Column) -> Column:
    return F.unix_micros(ts) / 1e6


def utc_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm 'UTC'")
