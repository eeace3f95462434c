"""Samples of the machine's memory, processor and disks, and back-pressure by them. Linux only."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SAMPLE = "ts double, rss long, cpu double, read_sectors long"


def _fields(path: str) -> list[list[str]]:
    return [line.split() for line in Path(path).read_text().splitlines()]


def sample() -> tuple[float, int, float, int]:
    """(time, resident bytes of this process, its processor seconds, sectors that whole disks have read)."""
    rss = int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    t = os.times()
    disks = {p.name for p in Path("/sys/block").iterdir()} if Path("/sys/block").exists() else set()
    read = sum(int(f[5]) for f in _fields("/proc/diskstats") if f[2] in disks)
    return time.time(), rss, t.user + t.system, read


def samples(spark: SparkSession, n: int, every: float = 0.5) -> DataFrame:
    """n samples of the driver, for operators.workload.resource_use; cpu is the share of one processor since the sample before."""
    rows, before = [], sample()
    for _ in range(n):
        time.sleep(every)
        now = sample()
        rows.append((now[0], now[1], 100 * (now[2] - before[2]) / max(now[0] - before[0], 1e-9), now[3]))
        before = now
    return spark.createDataFrame(rows, SAMPLE)


def strained(load_per_cpu: float = 1.25, least_free: int = 4 << 30) -> bool:
    """Whether the machine has more running processes than it should, or less free memory."""
    free = next((int(f[1]) * 1024 for f in _fields("/proc/meminfo") if f[0] == "MemAvailable:"), least_free)
    return os.getloadavg()[0] > load_per_cpu * (os.cpu_count() or 1) or free < least_free


def wait_for_room(is_strained: Callable[[], bool] = strained, first: float = 1.0, longest: float = 30.0, factor: float = 1.5, limit: int = 20, sleep: Callable[[float], None] = time.sleep) -> float:
    """Waits, longer each time, while the machine is strained, at most `limit` times; gives the seconds waited."""
    waited, pause = 0.0, first
    for _ in range(limit):
        if not is_strained():
            break
        sleep(pause)
        waited += pause
        pause = min(pause * factor, longest)
    return waited
