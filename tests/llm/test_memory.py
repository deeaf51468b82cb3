"""Python workers give their free memory back after a task."""

import re

from textvariety.llm.chunks import give_back


def test_free_memory_goes_back_to_the_system():
    def held():
        with open("/proc/self/smaps_rollup") as told:
            return int(re.search(r"Pss_Anon:\s+(\d+)", told.read())[1]) // 1024

    blocks = [b"x" * 20_000 for _ in range(5000)]
    blocks = blocks[::100]  # holes between those that stay
    before = held()
    give_back()
    assert blocks and before - held() > 50
