"""What Python workers remember between tasks.

Workers outlive tasks and stages. An operator may keep things in them that
make its next task cheaper; when another operator's task comes, they go, so
that a worker holds the memory of one operator at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa

_held: list[tuple[str, Callable[[], None]]] = []


def claim(owner: str, forget: Callable[[], None] | None = None) -> None:
    """Begin a task of ``owner``; what another operator left is forgotten."""
    if _held and _held[0][0] != owner:
        _held.pop()[1]()
        pa.default_memory_pool().release_unused()
    if forget and not _held:
        _held.append((owner, forget))
