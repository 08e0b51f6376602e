"""Rows by a 64-bit class in sorted, memory-mapped files: a semi-join without a shuffle of what is looked up.

Files lie in the shared folder, one for each range of the class's high half,
written whole by the task that gathered the range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .eliasfano import load, save
from .shared import local_path, write_file
from .textkit import U64


def class_files(rows: DataFrame, folder: str, name: str, files: int) -> dict[int, str]:
    """Writes rows (class long, other longs); the path of each range that has rows."""
    root, cols = local_path(folder), ["class", *(c for c in rows.columns if c != "class")]

    def run(table: pa.Table) -> pa.Table:
        key = table.column("file")[0].as_py()
        arrays = {c: table.column(c).to_numpy() for c in cols}
        order = np.argsort(arrays["class"])
        path = f"{root}/{name}-{key:07d}.fef"
        write_file(path, save({c: x[order] for c, x in arrays.items()}))
        return pa.table({"file": pa.array([key], pa.int32()), "path": [path]})

    key = F.shiftrightunsigned(F.shiftrightunsigned(F.col("class"), 32) * files, 32).cast("int")
    made = rows.select(key.alias("file"), *cols).groupBy("file").applyInArrow(run, "file int, path string")
    return {r["file"]: r["path"] for r in made.collect()}  # a row per file


def file_of(h: np.ndarray, files: int) -> np.ndarray:
    """The file of each class (unsigned)."""
    return (((h >> U64(32)) * U64(files)) >> U64(32)).astype(np.int64)


def found_in(paths: dict[int, str], h: np.ndarray, files: int):
    """For each file: indices of the classes (unsigned) that it holds, their places in it, its arrays."""
    at = file_of(h, files)
    for k in np.unique(at):
        if int(k) in paths:
            f = load(paths[int(k)])
            own = np.flatnonzero(at == k)
            v = h[own].view(np.int64)
            e = np.searchsorted(f["class"], v)
            e[e == len(f["class"])] = 0
            hit = f["class"][e] == v
            yield own[hit], e[hit], f
