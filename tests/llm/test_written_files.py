"""Intermediates that are written take files by the input's size, not by the session's shuffle setting."""

import contextlib
import glob

import pytest

import corpus_pipeline
from weftline.llm import common, queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def dealt(spark):
    """Shuffles to 64 partitions, none of which Spark joins up."""
    want = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    had = {k: spark.conf.get(k) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in had.items():
        spark.conf.set(k, v)


@contextlib.contextmanager
def written(spark):
    """Yields a table of the numbers of files that each new intermediate has, by its name and key; filled at the end."""
    root = common.shared_dir(spark).removeprefix("file://") + "/weftline/*"
    before, files = set(glob.glob(root)), {}
    yield files
    files |= {path.rpartition("/")[2]: len(glob.glob(path + "/part-*")) for path in set(glob.glob(root)) - before}


def test_warc_archives_are_few(dealt):
    with written(dealt) as files:
        rows = queries.QUERIES["op5_warc_normaliser"](dealt, DIR).count()
    assert rows == dealt.read.parquet(f"{DIR}/pages.parquet").count()
    assert len(files) == 2 and max(files.values()) <= 2 * dealt.sparkContext.defaultParallelism, files


def test_pipeline_intermediates_are_few(dealt):
    docs, most = dealt.read.parquet(f"{DIR}/documents.parquet"), 2 * dealt.sparkContext.defaultParallelism
    with written(dealt) as files:
        kept = corpus_pipeline.drop_near_duplicates(dealt, docs, DIR)
        rest = corpus_pipeline.drop_repeats(dealt, kept, DIR)
    assert kept.rdd.getNumPartitions() <= most and rest.count() <= kept.count() <= docs.count()
    assert len(files) > 10 and max(files.values()) <= most, files
