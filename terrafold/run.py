"""Run the clean protocol from a configuration: tables in, a report of every (variant, mapper) out."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .plans import pipeline
from .sources.sinks import save_report

#: Sections and keys that a configuration may have.
KEYS = {
    "name": None,
    "tables": {"points", "raster", "terms", "priors", "mappers"},
    "camera": {"fx", "fy", "cx", "cy", "width", "height", "y_sign", "z_sign"},
    "superpoints": {"backend", "target_superpoints", "least_voxel", "overshoot"},
    "lifting": {"primary", "variants"},
    "evaluation": {"classes", "mappers"},
    "output": {"path", "format"},
}
#: Other names of variants.
ALIASES = {"max": "top"}


def read_config(source: dict | str) -> dict:
    """A checked configuration from a dict, a JSON file, or a YAML file where PyYAML is installed. Unknown keys are an error."""
    if isinstance(source, dict):
        config = source
    elif Path(source).suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as missing:
            raise RuntimeError("YAML configurations need PyYAML; give a dict or a JSON file") from missing
        config = yaml.safe_load(Path(source).read_text())
    else:
        config = json.loads(Path(source).read_text())
    for section, keys in config.items():
        if section not in KEYS:
            raise ValueError(f"unknown section: {section}")
        if KEYS[section] is not None and (odd := set(keys) - KEYS[section]):
            raise ValueError(f"unknown keys in {section}: {', '.join(sorted(odd))}")
    missing = [k for k in ("tables", "camera", "evaluation") if k not in config]
    if missing:
        raise ValueError(f"missing sections: {', '.join(missing)}")
    return config


def protocol_of(config: dict) -> pipeline.Protocol:
    parts = config.get("superpoints", {})
    if parts.get("backend", "voxel") != "voxel":
        raise ValueError("only voxel partitions are built here; join others with geometry.external_partition")
    variants = [ALIASES.get(v, v) for v in config.get("lifting", {}).get("variants", pipeline.VARIANTS)]
    if odd := set(variants) - set(pipeline.VARIANTS):
        raise ValueError(f"unknown variants: {', '.join(sorted(odd))}")
    return pipeline.Protocol(
        classes=[int(c) for c in config["evaluation"]["classes"]],
        camera=config["camera"],
        target=int(parts.get("target_superpoints", 1200)),
        least_voxel=float(parts.get("least_voxel", 0.8)),
        overshoot=float(parts.get("overshoot", 1.25)),
        variants=tuple(variants),
    )


def run(spark: SparkSession, config: dict | str) -> DataFrame:
    """(variant, mapper, miou, macc, oa), also written to ``output.path`` if that is given.

    Tables are Parquet: points (frame_id, point_id, x, y, z, intensity, gt), raster (term, row, col, score), terms (term, term_idx),
    priors (frame_id, term, term_idx, presence, caption_freq), mappers (mapper, term, class_id).
    """
    config = read_config(config)
    protocol = protocol_of(config)
    t = {k: spark.read.parquet(p) for k, p in config["tables"].items()}
    own, evidence, validity = pipeline.lifted(t["points"], t["raster"], t["terms"], t["priors"], protocol)
    mappers = t["mappers"]
    if names := config["evaluation"].get("mappers"):
        mappers = mappers.where(mappers["mapper"].isin(names))
    report = pipeline.evaluate(own, evidence, validity, mappers, protocol)
    if out := config.get("output"):
        save_report(report, out["path"], out.get("format", "csv"))
    return report
