"""What the findings of round 3 on text operators were about."""

import ctypes
import re
from pathlib import Path

import pyarrow as pa
import pytest

from statefield.llm.common import tidy


def own_mb():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim") or not Path("/proc/self/smaps_rollup").exists(), reason="not glibc on Linux")
def test_workers_give_back_what_a_task_has_freed():
    kept = []

    def run(batches):
        held = []
        for b in batches:
            held += [ctypes.create_string_buffer(3000) for _ in range(40_000)]
            kept.append(ctypes.create_string_buffer(3000))  # lies behind what is freed, so that the heap can't shrink
            yield b
        held.clear()

    batch = pa.RecordBatch.from_pydict({"x": [1, 2]})
    assert list(run([batch])) == [batch]
    before = own_mb()
    assert list(tidy(run)([batch])) == [batch]
    assert own_mb() < before - 50
