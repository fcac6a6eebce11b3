"""Stand-in for a remote service: serves events as pages of a hundred records.

Its store is a folder of parquet files that does not change. A page opens the row groups that can have its ids, and the
last ones stay open for the pages to come, so a store in the order of its ids is read once by a walk over its pages.
"""

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as fs


@lru_cache(maxsize=1)
def _row_groups(path: str) -> tuple[list, np.ndarray, np.ndarray]:
    """Row groups, with the least and the greatest id of each."""
    path = re.sub(r"^file:/+", "/", path)
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    files = ds.dataset(inner, filesystem=system).get_fragments()
    groups = [group for file in files for group in file.split_by_row_group()]
    bounds, whole = [group.row_groups[0].statistics.get("event_id") for group in groups], np.iinfo(np.int64)
    least = np.array([b["min"] if b else whole.min for b in bounds], np.int64)
    return groups, least, np.array([b["max"] if b else whole.max for b in bounds], np.int64)


@lru_cache(maxsize=4)
def _rows(path: str, group: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a row group in ascending order, and the types beside them."""
    rows = _row_groups(path)[0][group].to_table(
        columns=["event_id", "event_type"], filter=pc.field("event_id").is_valid()
    ).sort_by("event_id")
    return rows["event_id"].to_numpy(), rows["event_type"].to_numpy()


def event_page(page: int, options: dict) -> str:
    path, low, high = options["path"], (page - 1) * 100, page * 100
    _, least, greatest = _row_groups(path)
    rows = []
    for group in np.flatnonzero((least < high) & (greatest >= low)).tolist():
        ids, types = _rows(path, group)
        found = slice(*np.searchsorted(ids, (low, high)))
        rows += zip(ids[found].tolist(), types[found].tolist())
    records = [{"id": i, "type": t} for i, t in sorted(rows)]
    return json.dumps(records)
