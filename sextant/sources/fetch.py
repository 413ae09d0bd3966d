"""A hook for remote sources: the caller brings the request, this the checks.

The engine knows no addresses and opens no connections. ``get(address, timeout)``
returns the body of an answer, or raises ``OSError``.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession

Get = Callable[[str, float], bytes]


def fetch_object(get: Get, address: str, timeout: float = 30, required: str | None = None) -> dict:
    """The JSON object at an address. Failed requests, other answers and a missing
    ``required`` key raise ``RuntimeError`` with the reason."""
    check_timeout(timeout)
    try:
        found = json.loads(get(address, timeout))
    except OSError as e:
        raise RuntimeError(f"request failed: {e}") from e
    except ValueError as e:
        raise RuntimeError("the answer is not JSON") from e
    if not isinstance(found, dict):
        raise RuntimeError("the answer is not a JSON object")
    if required is not None and required not in found:
        raise RuntimeError(f"the answer lacks {required}")
    return found


def payloads(spark: SparkSession, *objects: dict) -> DataFrame:
    """Fetched objects as the text column that ``feeds.parse_feed`` reads."""
    return spark.createDataFrame([(json.dumps(x),) for x in objects], "payload string")


def fetch_history(load: Callable[[str, date, date], DataFrame], symbol: str, start: date, end: date) -> DataFrame:
    """Rows of ``[start, end)`` from a loader; none raise ``RuntimeError``."""
    found = load(check_symbol(symbol), start, end)
    if found.isEmpty():
        raise RuntimeError(f"no rows for {symbol} from {start} to {end}")
    return found


def fetch_table(spark: SparkSession, get: Get, address: str | None, folder: str, timeout: float = 30) -> str | None:
    """Land a remote table as a file in ``folder`` and return its path; without an address nothing is done."""
    if not address:
        return None
    path = f"{folder.rstrip('/')}/landed.txt"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(get(address, timeout)))
    finally:
        out.close()
    return path


def check_timeout(timeout: float) -> float:
    if timeout <= 0:
        raise ValueError("the timeout must be greater than zero")
    return timeout


def check_symbol(symbol: str) -> str:
    if not symbol.strip():
        raise ValueError("the symbol must not be empty")
    return symbol.strip()


def check_alert(low: float, high: float) -> tuple[float, float]:
    if not 0 <= low < high <= 100:
        raise ValueError("alert bounds must be 0 <= low < high <= 100")
    return low, high


def check_window(context: int, overlap: int) -> tuple[int, int]:
    """A year of sessions needs 370 days of context."""
    if context < 370:
        raise ValueError("context must be at least 370 days")
    if overlap < 0:
        raise ValueError("overlap must not be negative")
    return context, overlap

