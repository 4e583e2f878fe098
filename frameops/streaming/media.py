"""Newly arrived media files as a running query."""

from pyspark.sql import DataFrame

from frameops.sources.media import VIDEO_EXTENSIONS, only_media


def stream_new_media(listing: DataFrame, exts: tuple[str, ...] = VIDEO_EXTENSIONS) -> DataFrame:
    """Media among the files a listing stream reports; keeps no state."""
    return only_media(listing, exts)
