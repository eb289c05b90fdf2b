"""Where this folder's operators keep tables between stages, and names that clash with no column."""

from pyspark.sql import DataFrame

from ravelin.plans.tables import clear, drop, new_dir, shared_dir, table

__all__ = ["clear", "drop", "new_dir", "shared_dir", "table", "unused"]


def unused(df: DataFrame, name: str) -> str:
    """name, or with as many underscores at its end as it takes to differ from df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
