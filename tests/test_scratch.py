"""Intermediate tables and the driver's memory."""

import re
from pathlib import Path

import pytest

from varstrata.scratch import drop, stash

BLOCK, BLOCKS = 64 << 10, 1600


def held(spark) -> int:
    """Bytes that the driver's JVM holds."""
    rollup = Path(f"/proc/{spark._jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")
    if not rollup.exists():
        pytest.skip("memory can't be read here")
    return 1024 * sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", rollup.read_text())))


def test_stash_gives_freed_memory_back(spark):
    """100 MB that are freed below a block which is still held, so that malloc alone returns none of them."""
    for _ in range(3):  # what a first table takes isn't measured
        drop(stash(spark.range(10).toDF("id"), "first"))
    field = spark._jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    unsafe = field.get(None)
    blocks = [unsafe.allocateMemory(BLOCK) for _ in range(BLOCKS)]
    for at in blocks:
        unsafe.setMemory(at, BLOCK, 1)
    for at in blocks[:-1]:
        unsafe.freeMemory(at)
    before = held(spark)
    table = stash(spark.range(10).toDF("id"), "ten")
    after = held(spark)
    assert sorted(r["id"] for r in table.collect()) == list(range(10))
    drop(table)
    unsafe.freeMemory(blocks[-1])
    assert before - after > BLOCK * BLOCKS // 2
