import os
import re

import pandas as pd
import pytest

from catchment.llm import common


def held() -> float:
    with open("/proc/self/status") as f:
        return int(re.search(r"RssAnon:\s+(\d+)", f.read())[1]) / 1024


@pytest.mark.skipif(not os.path.exists("/proc/self/status"), reason="reads /proc")
def test_a_task_gives_back_what_it_has_freed(monkeypatch):
    """The function that workers run, run here: memory freed below a block in use goes back at its end."""
    class Frame:
        sparkSession = None

        def mapInPandas(self, run, schema):
            return run

    kept, freed = [], []

    def fn(batches):
        for batch in batches:
            blocks = [bytes(1000) for _ in range(200_000)]
            kept.append(blocks.pop())  # the end of the heap stays in use
            blocks.clear()
            freed.append(held())
            yield batch

    monkeypatch.setattr(common, "reachable", lambda spark: None)
    run = common.map_pandas(Frame(), fn, "x long")
    assert [len(f) for f in run([pd.DataFrame({"x": [1]}), pd.DataFrame({"x": []})])] == [1]
    assert held() < freed[-1] - 100
