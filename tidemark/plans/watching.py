"""Evaluation of watches over DataFrames."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from tidemark.operators import aggregates, anomaly
from tidemark.plans.stores import OPERATORS, Watches, stamp
from tidemark.sources.sinks import append_alert


def holds(value, op: str, bound) -> bool:
    """``value op bound``; an unknown operator counts as >, what isn't a number as not holding."""
    try:
        x, y = float(value), float(bound)
    except (TypeError, ValueError):
        return False
    op = op if op in OPERATORS else ">"
    return {">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y, "==": x == y, "!=": x != y}[op]


def threshold_state(df: DataFrame, params: dict, time_column: str = "timestamp") -> tuple[str, bool, float | None]:
    """(state, fired, value) of an aggregate against a bound."""
    agg, signal, op = params.get("aggregation", "avg"), params["signal"], params.get("op", ">")
    value = aggregates.aggregate(df, signal, agg, params.get("unit", ""), time=time_column).first()["value"]
    if value is None:
        return "no_data", False, None
    fired = holds(value, op, params.get("value"))
    return (f"breach:{agg}:{signal}:{op}:{params.get('value')}" if fired else "ok"), fired, value


def drift_state(df: DataFrame, baseline: dict | None, kind: str, time_column: str = "timestamp") -> tuple[str, bool, str]:
    """(state, fired, detail) of a window against a baseline; its state names what drifted, so that the same drift fires once."""
    if not baseline:
        return "no_baseline", False, ""
    found = anomaly.detect_drift(df, baseline, time_column)
    if kind == "regime":
        kinds = sorted({r["kind"] for r in found["regimes"] + found["transitions"]})
        return ("regime:" + ",".join(kinds) if kinds else "ok"), bool(kinds), anomaly.render_drift(found)
    counts: dict[str, int] = {}
    for r in found["structure"]:
        counts[r["scope"]] = counts.get(r["scope"], 0) + 1
    sign = ",".join(f"{s.replace('regime ', 'r')}:{n}" for s, n in sorted(counts.items()))
    return (f"drift:{sign}" if sign else "ok"), bool(sign), anomaly.render_drift(found)


def recent_dates(dates: list[str], baseline: dict | None) -> list[str]:
    """Dates the baseline doesn't cover, else the last two."""
    known = set((baseline or {}).get("dates", []))
    return [d for d in dates if d not in known] or dates[-2:]


def run_watches(watches: Watches, load: Callable[[dict], DataFrame], baselines: Callable[[str], dict | None], alerts: str | None = None, asset: str = "vessel-001", now: float | None = None, time_column: str = "timestamp") -> list[dict]:
    """Evaluates what is due; alerts where the state changed and fired. One that fails doesn't stop the rest and stays due."""
    now, out = time.time() if now is None else now, []
    for w in watches.due(now):
        try:
            df = load(w)
            if w["condition_type"] == "threshold":
                state, fired, detail = threshold_state(df, w["params"], time_column)
            else:
                state, fired, detail = drift_state(df, baselines(w["source"]), w["condition_type"], time_column)
        except Exception as failed:  # noqa: BLE001
            out.append({"watch_id": w["id"], "state": "error", "detail": str(failed)[:300]})
            continue
        if watches.record(w["id"], state, now) and fired:
            record = {"ts": stamp(), "asset": asset, "watch_id": w["id"], "source": w["source"], "condition_type": w["condition_type"], "state": state, "detail": str(detail), "value": detail if isinstance(detail, float) else None, "notify": w["notify"], "notify_actor_id": w["notify_actor_id"]}
            if alerts:
                append_alert(record, alerts)
            out.append(record)
    return out
