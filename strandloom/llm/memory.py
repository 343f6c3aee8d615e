"""What a Python worker holds: rows of a batch, and what it remembers between rows and tasks, bounded in bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

#: Rows of an Arrow batch. Texts are long, and a task holds a batch several times over.
ROWS = 1000
#: Bytes from which a batch gets no more rows, where rows are large.
BYTES = 2 << 20
#: Bytes of an entry besides its key's and value's own.
OVERHEAD = 180


class Remembered(dict):
    """key -> make(key), made once while it is remembered. Keys and values are strings or bytes, or numbers.

    Two generations of half of `most` bytes each: a full one becomes the old one, from which keys in
    use return. What is forgotten is made again, so the bound changes no result.
    """

    def __init__(self, make: Callable, most: int) -> None:
        super().__init__()
        self.make, self.most, self.old, self.held = make, most // 2, {}, 0

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        size = OVERHEAD + len(key) + (len(found) if isinstance(found, (str, bytes)) else 8)
        if size > self.most:
            return found
        self.held += size
        if self.held > self.most:
            self.old, self.held = dict(self), size
            self.clear()
        self[key] = found
        return found


def in_small_batches(df: DataFrame) -> DataFrame:
    """`df`, after its session is told to hand rows to Python ROWS at a time, unless it asks for fewer."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "0")) <= ROWS:
        conf.set(name, str(ROWS))
    return df


def in_few_bytes(df: DataFrame) -> DataFrame:
    """`df`, after its session is told to end a batch for Python at BYTES, too, unless it asks for fewer. A row of more is a batch of its own."""
    df = in_small_batches(df)
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    found = conf.get(name, None)
    if found is None or not found.isdigit() or not 0 < int(found) <= BYTES:
        conf.set(name, str(BYTES))
    return df
