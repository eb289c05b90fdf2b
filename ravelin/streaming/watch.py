"""Watching for changes: a stream of (path, text, load_seq) rows, of which what is new about a file is indexed.

The trigger's interval gathers changes, as a debounce would. Of each file the
hash of what was seen last is kept as state by its path, in the checkpoint: a
row goes on only if its text is another one. So a batch costs what has changed,
not a look at all files that are stored, and a restart does not index anything
twice. A hash is kept for as long as the checkpoint is. A new checkpoint knows no
file yet: what `stored` has with the same hash is left out of a batch as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ravelin.operators.store import changed_files, with_hash

CHANGED = "path string, text string, load_seq long, hash string"


def watched(files: DataFrame) -> DataFrame:
    """The rows of a stream that matter: Swift files outside build folders."""
    path = F.col("path")
    return files.where(path.endswith(".swift") & ~F.concat(F.lit("/"), path).rlike("/(\\.build|DerivedData)/"))


def changed(stream: DataFrame) -> DataFrame:
    """Of each batch of a stream the last row of each file (by load_seq, then text) whose text is not the one seen last."""

    def work(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = None
        for frame in frames:
            best = frame.sort_values(["load_seq", "text"]).iloc[-1:]
            if last is None or (best.load_seq.iloc[0], best.text.iloc[0]) > (last.load_seq.iloc[0], last.text.iloc[0]):
                last = best
        known = state.get[0] if state.exists else None
        state.update((last.hash.iloc[0],))
        if last.hash.iloc[0] != known:
            yield last[["path", "text", "load_seq", "hash"]]

    rows = watched(stream).select("path", F.coalesce("text", F.lit("")).alias("text"), F.col("load_seq").cast("long").alias("load_seq"))
    by_path = with_hash(rows, "text").groupBy("path")
    return by_path.applyInPandasWithState(work, CHANGED, "hash string", "append", GroupStateTimeout.NoTimeout)


def start(
    stream: DataFrame, stored: Callable[[], DataFrame] | None, reindex: Callable[[DataFrame, int], object], checkpoint: str, every: str = "2 seconds", once: bool = False
) -> StreamingQuery:
    """Starts the watch; reindex gets each batch's changed files (path, text, load_seq, hash) and its number.

    stored() gives (path, hash) of what is stored as of now; None if reindex compares with that itself.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows = (changed_files(rows, stored()).select(*rows.columns) if stored else rows).persist()
        if not rows.isEmpty():
            reindex(rows, number)
        rows.unpersist()

    writer = changed(stream).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
