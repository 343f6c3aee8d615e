"""Structured Streaming over window files: what comes in order is written, what doesn't is told.

How far each chromosome is covered and which window came last is state, kept by groups of chromosomes. The stream's
checkpoint makes the writes exactly once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "chrom_id string, chrom_window_index bigint, write_start bigint, write_end bigint, problem string"
STATE = "chrom_ids array<string>, reached array<bigint>, last_index array<bigint>"
#: Groups of records that share a state.
BUCKETS = 1024


def step(index: int, begin: int, end: int, length: int, reached: int, last: int) -> tuple[tuple, int, int]:
    """(window index, start, stop, problem) of a window, and where its chromosome stands after it."""
    problem = "index" if index != last + 1 else "gap" if begin > reached else None
    start, stop = max(begin, reached), min(end, length)
    return (index, start, stop, problem), *((reached, last) if problem else (max(reached, stop), index))


def frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["chrom_id", "chrom_window_index", "write_start", "write_end", "problem"])


def sorted_windows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    data = pd.concat(list(batches)).sort_values(["chrom_id", "chrom_window_index"], kind="stable")
    return zip(*(data[c].tolist() for c in ("chrom_id", "chrom_window_index", "center_start", "center_end", "chrom_length")), strict=True)


def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The part that each window adds to its chromosome, or why it doesn't follow on."""
    reached, last = state.get if state.exists else (0, -1)
    rows = []
    for _, *window in sorted_windows(batches):
        said, reached, last = step(*window, reached, last)
        rows.append((key[0], *said))
    state.update((int(reached), int(last)))
    yield frame(rows)


def follow_group(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The same for a group of chromosomes at once."""
    held = {name: (reached, last) for name, reached, last in zip(*state.get, strict=True)} if state.exists else {}
    rows = []
    for name, *window in sorted_windows(batches):
        said, *held[name] = step(*window, *held.get(name, (0, -1)))
        rows.append((name, *said))
    state.update(([*held], [int(r) for r, _ in held.values()], [int(i) for _, i in held.values()]))
    yield frame(rows)


def covered(windows: DataFrame) -> DataFrame:
    """A stream of windows (chrom_id, chrom_length, chrom_window_index, center_start, center_end) to what each one writes."""
    chosen = windows.select(F.pmod(F.xxhash64("chrom_id"), F.lit(BUCKETS)).alias("bucket"), "chrom_id", "chrom_length", "chrom_window_index", "center_start", "center_end")
    return chosen.groupBy("bucket").applyInPandasWithState(follow_group, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
