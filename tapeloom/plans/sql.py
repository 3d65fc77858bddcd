"""Declarative plans: chains of named SELECTs that run lazily on Spark DataFrames.

A plan is a list of (name, select) steps over input tables written as {table}.  ``run`` hands them to Spark SQL, where
Catalyst sees one query; ``text`` renders the same steps for another SQL engine, which the tests compare against.
A few functions that engines spell differently are written in upper case with a leading ``@``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

_SPARK = {"@PCT(": "percentile(", "@ROW(": "struct(", "@TS": "TIMESTAMP_NTZ", "@STR": "STRING", "@SKEW(": "skewness(", "@SKEWFIX": "1"}
_OTHER = {"@PCT(": "quantile_cont(", "@ROW(": "row(", "@TS": "TIMESTAMP", "@STR": "VARCHAR", "@SKEW(": "skewness(", "@SKEWFIX": "0"}


@dataclass(frozen=True)
class Plan:
    steps: tuple[tuple[str, str], ...] = field(default=())

    def then(self, name: str, select: str) -> Plan:
        return Plan((*self.steps, (name, select)))

    def given(self, name: str, table: str) -> Plan:
        """The plan with a step's rows taken from an input table."""
        return Plan(tuple((n, f"SELECT * FROM {{{table}}}" if n == name else s) for n, s in self.steps))

    def _render(self, words: dict[str, str]) -> str:
        head = ",\n".join(f"{n} AS ({s})" for n, s in self.steps[:-1])
        sql = (f"WITH {head}\n" if head else "") + self.steps[-1][1]
        for k, v in words.items():
            sql = sql.replace(k, v)
        return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", sql)  # doubles, not decimals

    def tables(self) -> list[str]:
        return sorted(set(re.findall(r"\{(\w+)\}", " ".join(s for _, s in self.steps))))

    def run(self, spark: SparkSession, **tables: DataFrame) -> DataFrame:
        return spark.sql(self._render(_SPARK), **{t: tables[t] for t in self.tables()})

    def over(self, spark: SparkSession, folder: str) -> DataFrame:
        """Runs over the Parquet tables of a folder."""
        return self.run(spark, **{t: spark.read.parquet(f"{folder}/{t}.parquet") for t in self.tables()})

    def text(self) -> str:
        return re.sub(r"\{(\w+)\}", r"\1", self._render(_OTHER))
