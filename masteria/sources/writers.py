"""Writers."""

from __future__ import annotations

import posixpath
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame


def _place(path: str) -> tuple[str, str]:
    """(store, normalized path); a path without a scheme has no store of its own."""
    parts = urlparse(path)
    store = f"{parts.scheme}://{parts.netloc}" if parts.netloc else ""
    return store, posixpath.normpath(unquote(parts.path))


def _reads_from(frame: DataFrame, path: str) -> bool:
    store, target = _place(path)
    for file in frame.inputFiles():
        other_store, source = _place(file)
        inside = f"{source}/".startswith(f"{target}/") if target.startswith("/") else f"/{target}/" in f"{source}/"
        if inside and (not store or not other_store or store == other_store):
            return True
    return False


def write_models(models: DataFrame, path: str, format: str = "parquet") -> None:
    """Write the whole table, replacing what is there. A path that ``models`` is read from is
    refused: the input would be gone before it is read."""
    if format not in ("parquet", "json"):
        raise ValueError(f"format must be 'parquet' or 'json', not {format!r}")
    if _reads_from(models, path):
        raise ValueError(f"refusing to overwrite {path}: the models are read from it")
    writer = models.write.mode("overwrite")
    if format == "json":
        writer = writer.option("ignoreNullFields", False)
    writer.format(format).save(path)
