"""What a Python worker keeps between its tasks.

Spark uses its workers again, for whatever stage comes next. An encoder with a full memo takes hundreds of MB, which it
would go on holding beside the work of stages that never encode; these call ``let_go`` first.
"""

from __future__ import annotations

import pyarrow as pa

#: By name; what is kept here can be made again at any time.
KEPT: dict[str, object] = {}


def let_go() -> None:
    KEPT.clear()
    pa.default_memory_pool().release_unused()
