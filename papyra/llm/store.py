"""Written tables, as the rest of the library makes them, and names of carried columns."""

from __future__ import annotations

from collections.abc import Sequence

from papyra.store import CLEANUP, drop, drop_written, partitions, shared_dir, small_batches, written

__all__ = ["CLEANUP", "drop", "drop_written", "free", "partitions", "shared_dir", "small_batches", "written"]


def free(columns: Sequence[str], taken: Sequence[str]) -> list[str]:
    """The columns that no name of ``taken`` equals in any case."""
    names = {t.lower() for t in taken}
    return [c for c in columns if c.lower() not in names]
