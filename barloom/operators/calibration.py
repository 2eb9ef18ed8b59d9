"""The nested parameter file that carries thresholds from the calibration sweeps to the report."""

from __future__ import annotations

import copy
import json

from pyspark.sql import Row, SparkSession

from barloom.operators.report import ReportConfig, StandardRules, TightEntry

#: What holds where a file says nothing.
DEFAULTS = {
    "daily_calibration": {
        "leader_min": 60.0,
        "standard_leader_min": 60.0,
        "tight_leader_min": 63.0,
        "leader_quantile": 0.85,
        "standard_setup_min": 68.0,
        "tight_setup_min": 55.0,
        "use_setup_max": False,
    },
    "intraday_calibration": {
        "standard_breakout": {
            "trigger_min": 0.0,
            "cum_vol_ratio_min": 1.5,
            "bar_vol_ratio_min": 0.0,
            "move_from_open_min": -1.0,
            "trigger_above_pivot_pct": 0.01,
        },
        "tight_reversal": {
            "trigger_min": 0.0,
            "cum_vol_ratio_min": 1.5,
            "bar_vol_ratio_min": 0.0,
            "entry_dist_norm_max": 1.0,
            "gap_norm_max": 1.1,
            "same_day_stop_rate_max": 0.35,
        },
    },
}


def calibrated(standard: Row | None, tight: Row | None, **metadata: str) -> dict:
    """Parameters from the best grid points of the two lanes (learn.select_best joined with its grid); None leaves a
    lane at its defaults. The smaller leader minimum counts for both."""
    out = copy.deepcopy(DEFAULTS)
    day, bars = out["daily_calibration"], out["intraday_calibration"]
    if standard is not None:
        day["standard_setup_min"] = float(standard.setup_min)
        bars["standard_breakout"] |= {"trigger_min": float(standard.trigger_min), "cum_vol_ratio_min": float(standard.cum_vol_min), "bar_vol_ratio_min": float(standard.bar_vol_min)}
    if tight is not None:
        day["tight_setup_min"] = float(tight.setup_min)
        bars["tight_reversal"] |= {"trigger_min": float(tight.trigger_min), "cum_vol_ratio_min": float(tight.cum_vol_min), "entry_dist_norm_max": float(tight.dist_max), "gap_norm_max": float(tight.gap_max)}
    leaders = [float(r.leader_min) for r in (standard, tight) if r is not None]
    if leaders:
        day["leader_min"] = min(leaders)
    day["use_setup_max"] = False
    out["metadata"] = dict(metadata)
    return out


def write_parameters(spark: SparkSession, params: dict, path: str) -> None:
    """One JSON text wherever Spark can write."""
    spark.createDataFrame([(json.dumps(params, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_parameters(spark: SparkSession, path: str | None) -> dict:
    """A parameter file over the defaults: a section's entries replace those of the defaults one by one."""
    out = copy.deepcopy(DEFAULTS)
    if path is None:
        return out
    found = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))  # one small file
    for section, values in found.items():
        if isinstance(values, dict) and isinstance(out.get(section), dict):
            out[section] |= values
        else:
            out[section] = values
    return out


def report_config(params: dict, **windows) -> ReportConfig:
    """Thresholds of the report from parameters; windows are the other fields of ReportConfig."""
    day = params.get("daily_calibration", {})
    standard, tight = (params.get("intraday_calibration", {}).get(k, {}) for k in ("standard_breakout", "tight_reversal"))
    leader = day.get("standard_leader_min", day.get("leader_min", 60.0))
    return ReportConfig(
        leader_min=float(leader),
        standard=StandardRules(
            leader_min=float(leader),
            trigger_min=float(standard.get("trigger_min", 72.0)),
            cum_vol_min=float(standard.get("cum_vol_ratio_min", 0.0)),
            bar_vol_min=float(standard.get("bar_vol_ratio_min", 0.0)),
            move_min=float(standard.get("move_from_open_min", 0.0)),
            above_pivot=float(standard.get("trigger_above_pivot_pct", 0.01)),
        ),
        tight=TightEntry(
            leader_min=float(day.get("tight_leader_min", day.get("leader_min", 60.0))),
            setup_min=float(day.get("tight_setup_min", 55.0)),
            trigger_min=float(tight.get("trigger_min", 69.0)),
            cum_vol_min=float(tight.get("cum_vol_ratio_min", 0.0)),
            bar_vol_min=float(tight.get("bar_vol_ratio_min", 0.0)),
            max_dist=float(tight.get("entry_dist_norm_max", 0.80)),
            max_gap=float(tight.get("gap_norm_max", 0.70)),
        ),
        compact_leader=float(day.get("leader_min", 60.0)),
        **windows,
    )
