"""Artifacts: JSON beside the data, edges and series as Parquet, alerts as appended JSON lines."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame


class Artifacts:
    """JSON artifacts of one asset in a folder of the driver's: small control results, never data."""

    def __init__(self, folder: str, asset: str = "vessel-001"):
        self.folder, self.asset = folder, asset

    def path(self, kind: str, source: str) -> str:
        return os.path.join(self.folder, f"{kind}_{self.asset}_{source}.json")

    def save(self, kind: str, source: str, value) -> str:
        os.makedirs(self.folder, exist_ok=True)
        path = self.path(kind, source)
        with open(f"{path}.new", "w", encoding="utf-8") as f:
            json.dump(value, f, indent=1, default=str, sort_keys=True)
        os.replace(f"{path}.new", path)
        return path

    def load(self, kind: str, source: str):
        try:
            with open(self.path(kind, source), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return None

    def has(self, kind: str, source: str) -> bool:
        return os.path.exists(self.path(kind, source))


def append_alerts(alerts: DataFrame, path: str) -> None:
    """Alerts as JSON lines, appended; any file system."""
    alerts.write.mode("append").json(path)


def append_alert(record: dict, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(record, sort_keys=True, default=str) + "\n")


def write_edges(edges: DataFrame, path: str) -> None:
    edges.write.mode("overwrite").parquet(path)


def write_partitioned(df: DataFrame, path: str, date: str = "date") -> None:
    """Rows as date partitions, one shuffle by date so that a day isn't spread over many small files."""
    df.repartition(date).write.partitionBy(date).mode("append").parquet(path)
