"""Writers: per-frame caches, reports, incremental runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_cache(df: DataFrame, path: str, by: str = "frame_id") -> None:
    """Parquet by frame; frames written again replace only themselves, so a run that stops can go on."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def pending(frames: DataFrame, done: DataFrame) -> DataFrame:
    """Frames that are not in ``done`` yet."""
    return frames.join(done.select("frame_id").distinct(), "frame_id", "left_anti")


def pending_all(frames: DataFrame, *caches: DataFrame) -> DataFrame:
    """Frames that at least one of the caches lacks."""
    done = caches[0].select("frame_id").distinct()
    for c in caches[1:]:
        done = done.intersect(c.select("frame_id").distinct())
    return pending(frames, done)


def save_mapping(mapping: DataFrame, path: str, mapper: str) -> None:
    """One JSON line {"mapper": .., "mapping": {term: class_id}}; a vocabulary is a few hundred terms."""
    row = mapping.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "class_id")))).alias("mapping"))
    row.select(F.lit(mapper).alias("mapper"), "mapping").coalesce(1).write.mode("overwrite").json(path)


def save_manifest(rows: DataFrame, keep: DataFrame, path: str) -> None:
    """The rows of a manifest whose (sequence, lidar_filename) are in ``keep``, as TSV with a header."""
    out = rows.join(keep.select("sequence", "lidar_filename").distinct(), ["sequence", "lidar_filename"], "left_semi").select(*rows.columns)
    out.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def save_report(report: DataFrame, path: str, form: str = "csv") -> None:
    """A report of a row per method, as one CSV or JSON file."""
    one = report.coalesce(1).write.mode("overwrite")
    one.option("header", True).csv(path) if form == "csv" else one.json(path)


def markdown(report: DataFrame) -> str:
    """A report as a Markdown table; reports have a row per method."""
    lines = ["| " + " | ".join(report.columns) + " |", "|" + "---|" * len(report.columns)]
    lines += ["| " + " | ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in report.collect()]
    return "\n".join(lines)


def leaderboard(report: DataFrame, metric: str, n: int) -> DataFrame:
    """The n best rows of a report."""
    return report.orderBy(F.col(metric).desc(), *[c for c in report.columns if c != metric][:1]).limit(n)


def best_per(report: DataFrame, by: str, metric: str, name: str) -> DataFrame:
    """The best row of each group: what a bar chart per mapper shows."""
    return report.groupBy(by).agg(F.max_by(name, metric).alias(name), F.max(metric).alias(metric))


def save_npy(predictions: DataFrame, root: str, value: str = "label", by: str = "frame_id", order: str = "point_id") -> DataFrame:
    """One ``<frame>.npy`` of ``value`` in order of ``order`` per frame below ``root`` (a URI): (frame, path, rows). A frame is one array in its task.

    Files are written under a private name and renamed, so a task that runs again replaces its own.
    """
    import io
    import uuid

    import numpy as np
    import pandas as pd
    from pyarrow import fs as pafs

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        store, base = pafs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        raw = io.BytesIO()
        np.save(raw, rows.sort_values(order)[value].to_numpy())
        path, temp = f"{base}/{key[0]}.npy", f"{base}/.{uuid.uuid4().hex}"
        with store.open_output_stream(temp, compression=None) as f:
            f.write(raw.getvalue())
        store.move(temp, path)
        return pd.DataFrame({"frame": [str(key[0])], "path": [path], "rows": [len(rows)]})

    return predictions.select(by, order, value).groupBy(by).applyInPandas(run, "frame string, path string, rows bigint")
