"""Resumable download of a url list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.utils import AnalysisException

from captionforge.operators.lookups import skip_processed
from captionforge.operators.models import URLS_PER_TASK, fetch, split_fetched


def download(urls: DataFrame, key: str, url: str, out: str, fetcher: Callable, urls_per_task: int = URLS_PER_TASK) -> None:
    """Fetch what no earlier run has tried and append it, failures included, to ``out``.

    The fetched table is its own ledger: one committed append holds contents, failures and the
    keys a later run skips, so a run that dies before its commit leaves nothing half recorded.
    """
    try:
        done = urls.sparkSession.read.parquet(out)
        urls = skip_processed(urls, done, key)
    except AnalysisException:
        pass  # first run
    fetch(urls, url, fetcher, urls_per_task=urls_per_task).write.mode("append").parquet(out)


def downloaded(spark, out: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with content, failure ledger) of all runs so far."""
    good, failed = split_fetched(spark.read.parquet(out), key)
    return good.drop("status", "attempts"), failed
