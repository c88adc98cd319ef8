"""Results of queries kept by Spark's cache: at most MOST of them, the oldest go first, a write clears its dataset's."""

from __future__ import annotations

from pyspark.sql import DataFrame

MOST = 500


class ResultCache:
    """Persisted results by dataset and plan. Plans count as equal by Spark's own comparison, so order of calls, names of
    lambdas and the like do not matter."""

    def __init__(self, most: int = MOST) -> None:
        self.most = most
        self._held: list[tuple[str, int, DataFrame]] = []

    def __len__(self) -> int:
        return len(self._held)

    def rows(self, dataset: str, df: DataFrame) -> DataFrame:
        """df, persisted; the DataFrame kept before if its plan is the same."""
        key = df.semanticHash()
        for name, known, held in self._held:
            if name == dataset and known == key and held.sameSemantics(df):
                return held
        while len(self._held) >= self.most:
            self._held.pop(0)[2].unpersist()
        self._held.append((dataset, key, df.persist()))
        return df

    def clear(self, dataset: str | None = None) -> None:
        """Forget the results of a dataset, or all."""
        for name, _, df in self._held:
            if dataset in (None, name):
                df.unpersist()
        self._held = [x for x in self._held if dataset not in (None, x[0])]
