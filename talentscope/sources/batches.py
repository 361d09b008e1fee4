"""Appends in named batches that may be repeated (SNK-1), with rule counts taken on the way (VAL-5).

    rows/batch=<name>/      the rows of a batch, written as a whole
    ledger/batch=<name>/    one row: how many rows, and how many break each rule

A batch counts once its ledger row is there; readers see only such batches. An append
that failed before that is run again and overwrites its own folder alone; one that is
repeated after that adds nothing. Generated ids depend on table, batch and row key, so
the repeated rows are the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from talentscope import schemas as S
from talentscope.functions.ids import name_uuid
from talentscope.functions.time import DEFAULT_AS_OF, ts_ntz
from talentscope.session import folder_names

LEDGER = ("table_name string, n_rows long, "
          "rules array<struct<column_name:string,rule:string,violations:long>>, batch string")


def rules_of(table: str) -> list[tuple[str, str, Column]]:
    """(column, rule, condition that a row breaks it) of a table's column rules."""
    out = [(c, "not_null", F.col(c).isNull()) for c in S.NOT_NULL_COLUMNS.get(table, ())]
    out += [(c, f"max_length_{n}", F.length(c) > n) for c, n in S.VARCHAR_LIMITS.get(table, {}).items()]
    return out + [(c, "enum", F.col(c).isNotNull() & ~F.col(c).isin(*values))
                  for c, values in S.ENUM_COLUMNS.get(table, {}).items()]


def conformed(rows: DataFrame, table: str, batch: str, key: list[str],
              as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """New rows with all columns of the stored table: given values, else generated
    ids, column defaults and ``as_of`` for the times that default to now."""
    defaults, times = S.INSERT_DEFAULTS.get(table, {}), S.TIME_DEFAULTS[table]
    out = []
    for f in S.STORED_TABLES[table].fields:
        v = F.col(f.name) if f.name in rows.columns else F.lit(None)
        if f.name == "id":
            v = F.coalesce(v, name_uuid(table, batch, *[F.col(k) for k in key]))
        elif f.name in defaults:
            v = F.coalesce(v, F.lit(defaults[f.name]))
        elif f.name in times:
            v = F.coalesce(v, ts_ntz(as_of))
        out.append(v.cast(f.dataType).alias(f.name))
    return rows.select(*out)


class BatchTable:
    """One of the stored tables (``schemas.STORED_TABLES``) at ``path``."""

    def __init__(self, spark: SparkSession, path: str, table: str):
        self.spark, self.path, self.table = spark, path, table

    def batches(self) -> list[str]:
        return [n.split("=", 1)[1] for n in folder_names(self.spark, f"{self.path}/ledger")]

    def append(self, rows: DataFrame, batch: str, key: list[str], as_of: str = DEFAULT_AS_OF) -> bool:
        """Adds a batch; False if it is there already. The rule counts are observed
        while the rows are written: no scan of its own."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch name has letters, digits, - and _ only")
        if batch in self.batches():
            return False
        rules, seen = rules_of(self.table), Observation()
        counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(f"v{i}") for i, (_, _, c) in enumerate(rules)]
        (conformed(rows, self.table, batch, key, as_of)
         .observe(seen, F.count(F.lit(1)).alias("n_rows"), *counts)
         .write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}"))
        got = seen.get
        entry = (self.table, got["n_rows"],
                 [(c, rule, got[f"v{i}"]) for i, (c, rule, _) in enumerate(rules)])
        (self.spark.createDataFrame([entry], LEDGER.removesuffix(", batch string")).coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/ledger/batch={batch}"))
        return True

    def read(self) -> DataFrame:
        """The rows of all batches that count."""
        batches = self.batches()
        schema = S.STORED_TABLES[self.table]
        if not batches:
            return self.spark.createDataFrame([], schema)
        stored = self.spark.read.schema(schema).option("basePath", f"{self.path}/rows")
        return stored.parquet(*[f"{self.path}/rows/batch={b}" for b in batches]).select(*schema.names)

    def ledger(self) -> DataFrame:
        """(table_name, n_rows, rules, batch) of the batches that count."""
        if not self.batches():
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger")


def constraint_report(tables: list[BatchTable]) -> DataFrame:
    """VAL-5: violations per (table, column, rule), summed over the ledgers."""
    out = None
    for t in tables:
        rows = t.ledger().select("table_name", F.explode("rules").alias("r"))
        out = rows if out is None else out.unionByName(rows)
    return (out.groupBy("table_name", F.col("r.column_name").alias("column_name"),
                        F.col("r.rule").alias("rule"))
            .agg(F.sum("r.violations").alias("violations")))
