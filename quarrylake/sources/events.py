"""The telemetry log: JSON lines, appended to and read with bad lines skipped."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

SCHEMA = S.StructType(
    [S.StructField(n, t) for n, t in (
        ("timestamp", S.StringType()), ("file_path", S.StringType()), ("symbol", S.StringType()), ("language", S.StringType()),
        ("raw_tokens", S.LongType()), ("sliced_tokens", S.LongType()), ("saved_tokens", S.LongType()), ("savings_percentage", S.DoubleType()),
        ("raw_lines", S.LongType()), ("sliced_lines", S.LongType()), ("source", S.StringType()), ("duration_ms", S.LongType()),
    )]
)
REQUIRED = ("timestamp", "file_path", "symbol", "raw_tokens", "sliced_tokens", "saved_tokens")


def clean(events: DataFrame) -> DataFrame:
    """Events with all required fields; optional numbers default to 0."""
    out = events.where(" AND ".join(f"{c} IS NOT NULL" for c in REQUIRED))
    for c in ("savings_percentage", "raw_lines", "sliced_lines"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0).cast(dict(out.dtypes)[c])))
    return out


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The log's events; malformed and blank lines and lines without a required field are skipped, and a
    missing log has none."""
    local = path.removeprefix("file://")
    if "://" not in local and not os.path.exists(local):
        return spark.createDataFrame([], SCHEMA)
    return clean(spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path))


def append_events(events: DataFrame, path: str) -> None:
    """Append events as JSON lines."""
    events.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMA if f.name in events.columns]).write.mode("append").json(path)


def append_event(event: dict, path: str) -> bool:
    """Append one event to a file of JSON lines, folders made as needed; what can't be written is dropped, never raised."""
    try:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "a", encoding="utf-8") as f:
            f.write(json.dumps(event, default=str) + "\n")
    except (OSError, TypeError, ValueError):
        return False
    return True


def merge_json(path: str, keys: tuple[str, ...], value) -> str:
    """Set ``value`` under nested ``keys`` of a JSON file and keep all else: 'made', 'changed' or 'same'.

    A file that isn't a JSON object is kept beside it as .bak before a new one is written.
    """
    status, whole = "changed", {}
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        whole = json.loads(text) if text.strip() else {}
        if not isinstance(whole, dict):
            raise ValueError
    except FileNotFoundError:
        status = "made"
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    except ValueError:
        os.replace(path, path + ".bak")
        whole = {}
    at = whole
    for k in keys[:-1]:
        if not isinstance(at.get(k), dict):
            at[k] = {}
        at = at[k]
    if at.get(keys[-1]) == value and status == "changed" and keys[-1] in at:
        return "same"
    at[keys[-1]] = value
    from quarrylake.operators.patching import replace_file

    replace_file(path, json.dumps(whole, indent=2) + "\n")
    return status


def clear_events(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").json(path)


def log_path(env: dict[str, str] | None = None) -> str:
    """Where the log is: a file named by the environment, a folder named by it, home, or here."""
    env = os.environ if env is None else env
    if env.get("QUARRYLAKE_METRICS_FILE"):
        return env["QUARRYLAKE_METRICS_FILE"]
    if env.get("QUARRYLAKE_HOME"):
        return os.path.join(env["QUARRYLAKE_HOME"], "metrics.jsonl")
    return os.path.join(env.get("HOME") or ".", ".quarrylake", "metrics.jsonl")
