"""Workers give memory back between the stages of a job."""

import pyarrow as pa

from assayer.llm.common import lean


def _held_mb():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096 / 1e6


def test_a_task_gives_its_memory_back():
    top = []

    def run(batches):
        parts = [bytearray(60_000) for _ in range(3000)]
        top.append(bytearray(60_000))  # lies behind them, so that the heap can't shrink by itself
        for batch in batches:
            assert len(parts) == 3000
            yield batch

    batch = pa.record_batch({"a": [1]})
    before = _held_mb()
    assert [b.num_rows for b in lean(run)([batch, batch])] == [1, 1]
    assert _held_mb() - before < 60
