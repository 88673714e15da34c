"""The relational model as data (V7, K3): tables, typed columns, keys and references.

Load order, DDL text and the constraint checks of the data all derive from one ``Schema``.
Types are written as in SQL: ``INTEGER``, ``DATE``, ``VARCHAR(n)``, ``DECIMAL(p,s)``.

Checks look at the data as the load would: a value that the column's type cannot hold
(DECIMAL after rounding to its scale, VARCHAR by characters, INTEGER beyond 32 bits, no date)
is a violation of that column; NaN and infinite numbers load as NULL.  A table's key and row
conditions share one scan, all its references another one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.quality import constraint_report, fk_checks, table_checks, unique_violations

_TYPE = re.compile(r"(INTEGER|DATE|VARCHAR|DECIMAL)(?:\((\d+)(?:,\s*(\d+))?\))?")


def _finite(c):
    return F.when(F.abs(c) < float("inf"), c)  # NaN is above all numbers


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    null: bool = True
    default: str | None = None
    references: tuple[str, str] | None = None  # table, column

    def __post_init__(self):
        if not _TYPE.fullmatch(self.type):
            raise ValueError(f"{self.name}: unknown type {self.type}")

    def beyond(self, dtype: T.DataType):
        """(kind, condition of a value that the type cannot hold), or None where every value fits."""
        kind, size, scale = _TYPE.fullmatch(self.type).groups()
        c = F.col(f"`{self.name}`")
        if kind == "VARCHAR":
            return ("length", F.char_length(c.cast("string")) > int(size)) if size else None
        if kind == "DATE":
            return None if isinstance(dtype, (T.DateType, T.TimestampType)) else ("date", c.isNotNull() & c.cast("string").try_cast("date").isNull())
        number = c if isinstance(dtype, T.NumericType) else c.try_cast("double")
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            number = _finite(c)
        unread = c.isNotNull() & number.isNull() if isinstance(dtype, T.StringType) else F.lit(False)
        if kind == "INTEGER":
            return None if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType)) else ("range", unread | ~number.between(-(1 << 31), (1 << 31) - 1))
        p, s = int(size or 18), int(scale or 0)
        return ("range", unread | (F.abs(F.round(number, s)) >= F.lit(float(10 ** (p - s)))))


@dataclass(frozen=True)
class Table:
    name: str
    fields: tuple[Field, ...]
    key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = field(default=())

    def parents(self) -> set[str]:
        return {f.references[0] for f in self.fields if f.references and f.references[0] != self.name}

    def ddl(self) -> str:
        lines = []
        for f in self.fields:
            words = [f.name, f.type]
            if not f.null and self.key != (f.name,):
                words.append("NOT NULL")
            if f.default is not None:
                words.append(f"DEFAULT {f.default}")
            if f.references:
                words.append("REFERENCES {}({})".format(*f.references))
            lines.append(" ".join(words) + (" PRIMARY KEY" if self.key == (f.name,) else ""))
        if len(self.key) > 1:
            lines.append(f"PRIMARY KEY ({', '.join(self.key)})")
        lines += [f"UNIQUE ({', '.join(u)})" for u in self.unique]
        return f"CREATE TABLE {self.name} (\n    " + ",\n    ".join(lines) + "\n);\n"


class Schema:
    """Tables in load order: parents first, tables that are ready in the order given."""

    def __init__(self, tables):
        given = {t.name: t for t in tables}
        for t in given.values():
            for f in t.fields:
                if f.references and (f.references[0] not in given or f.references[1] not in {g.name for g in given[f.references[0]].fields}):
                    raise ValueError(f"{t.name}.{f.name} references {'.'.join(f.references)}, which the schema lacks")
        self.tables: dict[str, Table] = {}
        while len(self.tables) < len(given):
            ready = [t for t in given.values() if t.name not in self.tables and t.parents() <= self.tables.keys()]
            if not ready:
                raise ValueError("references form a cycle: " + ", ".join(n for n in given if n not in self.tables))
            self.tables[ready[0].name] = ready[0]

    def load_order(self) -> list[str]:
        return list(self.tables)

    def ddl(self) -> str:
        """CREATE TABLE statements in load order."""
        return "\n".join(t.ddl() for t in self.tables.values()) + "\n"

    def violations(self, frames: dict[str, DataFrame]) -> DataFrame:
        """V7: (constraint_name, violations) of every constraint, 0 where it holds: ``pk_<table>``,
        ``unique_<table>_<columns>``, ``nn_``, ``length_``, ``range_`` and ``date_<table>_<column>``,
        ``fk_<table>_<column>``.  Columns that a table lacks raise ValueError."""
        checks = []
        for t in self.tables.values():
            df = frames[t.name]
            lacking = [f.name for f in t.fields if f.name not in df.columns]
            if lacking:
                raise ValueError(f"{t.name} lacks {', '.join(lacking)}")
            rows = {}
            for f in t.fields:
                dtype = df.schema[f.name].dataType
                c = F.col(f"`{f.name}`")
                if not f.null and f.name not in t.key:
                    rows[f"nn_{t.name}_{f.name}"] = (_finite(c) if isinstance(dtype, (T.FloatType, T.DoubleType)) else c).isNull()
                beyond = f.beyond(dtype)
                if beyond:
                    rows[f"{beyond[0]}_{t.name}_{f.name}"] = beyond[1]
            checks.append(table_checks(df, f"pk_{t.name}", list(t.key), rows))
            checks += [unique_violations(f"unique_{t.name}_{'_'.join(u)}", df, list(u)) for u in t.unique]
            refs = {f"fk_{t.name}_{f.name}": (f.name, frames[f.references[0]], f.references[1]) for f in t.fields if f.references}
            if refs:
                checks.append(fk_checks(df, refs))
        return constraint_report(checks)

    def statements(self, frames: dict[str, DataFrame]) -> DataFrame:
        """K3: INSERT batches of every table in load order, rows by primary key, as ``write_sql_script`` takes them."""
        from tessera.sources.sinks import insert_statements

        parts = [insert_statements(frames[t.name].select(*[f.name for f in t.fields]), t.name, list(t.key)).withColumn("table_order", F.lit(i))
                 for i, t in enumerate(self.tables.values())]
        return reduce(DataFrame.unionByName, parts)

    def write_script(self, frames: dict[str, DataFrame], path: str) -> None:
        """K3: DDL, BEGIN, INSERT batches in load order, COMMIT."""
        from tessera.sources.sinks import write_sql_script

        write_sql_script(self.statements(frames), path, self.ddl())
