"""Names of clips, speakers and runs from paths and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a tag may not hold, its greatest length, and the form of run ids.
NOT_IN_TAG = "[^A-Za-z0-9._-]+"
TAG_LENGTH = 48
RUN_ID = r"^(.+)__(\d{8}T\d{6}Z)__([0-9a-f]{7,40}|nogit)$"


def parts(path: Column) -> Column:
    """Components of a relative path without its extension; empty ones, . and .. are left out."""
    stem = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"(?<=[^/.])\.[^./]*$", "")
    return F.filter(F.split(stem, "/"), lambda p: ~p.isin("", ".", ".."))


def clip_id(path: Column) -> Column:
    """The components joined by two underscores; the path itself if there is none."""
    p = parts(path)
    return F.when(F.size(p) > 0, F.array_join(p, "__")).otherwise(path)


def speaker(path: Column, by: str | None) -> Column:
    """The speaker by parent_dir or top_dir where the path has two components or more, else null."""
    if by not in (None, "parent_dir", "top_dir"):
        raise ValueError(f"no such grouping: {by}")
    p = parts(path)
    found = {None: F.lit(None).cast("string"), "parent_dir": F.try_element_at(p, F.lit(-2)), "top_dir": F.try_element_at(p, F.lit(1))}[by]
    return F.when(F.size(p) >= 2, found)


def tag(name: Column) -> Column:
    """A dataset's name made fit for a path: other characters than letters, digits, . _ - become -, at most 48; run if none."""
    ends = r"^[-._]+|[-._]+$"
    cut = F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(name, NOT_IN_TAG, "-"), ends, ""), 1, TAG_LENGTH), ends, "")
    return F.when(cut != "", cut).otherwise("run")


def run_id(name: Column, moment: Column, revision: Column) -> Column:
    """tag__time__revision, the time in UTC if that is the session's zone."""
    return F.concat_ws("__", tag(name), F.date_format(moment, "yyyyMMdd'T'HHmmss'Z'"), revision)


def parse_run_id(text: Column) -> Column:
    """The parts of a run id as a struct; raises on other texts."""
    fields = F.struct(*[F.regexp_extract(text, RUN_ID, i + 1).alias(n) for i, n in enumerate(("tag", "timestamp", "revision"))])
    return F.when(text.rlike(RUN_ID), fields).otherwise(F.raise_error(F.concat(F.lit("no run id: "), text)).cast("struct<tag:string,timestamp:string,revision:string>"))
