"""Order-dependent folds over many small groups."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from vellumspark.session import ship

#: Result rows that a task holds before it hands them on.
ROWS = 20_000


def fold_groups(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``fold`` makes of the sorted rows of every group; ``df`` has the keys first.

    Groups of a partition pass one after the other as a stream, so small groups cost no call to
    Python each, and a task holds one group and some result rows.
    """
    ship(df.sparkSession)
    names, n = [x.split()[0] for x in schema.split(", ")], len(keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        rows = (r for pdf in frames for r in pdf.itertuples(index=False, name=None))
        for _, own in itertools.groupby(rows, key=lambda r: r[:n]):
            out.extend(fold(list(own)))
            if len(out) >= ROWS:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
