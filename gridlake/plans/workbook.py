"""A workbook of tables and formula columns, recalculated lazily.

A formula copied down a column is a family: one projection, whatever the number of rows. Families
are ordered by the columns they read; a cycle gives #CIRC!. Only what a result needs is built, and
every edit keeps the version before it for undo.
"""

from __future__ import annotations

import re
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..parser import FormulaError, parse, references
from ..relations import Aggregate, copied_down, spill


#: What to do with a formula that can't be read: refuse it, put an error in its cells, or keep it as text.
POLICIES = ("strict", "error", "text")


class Workbook:
    def __init__(self, malformed: str = "strict"):
        if malformed not in POLICIES:
            raise ValueError(f"malformed must be one of {POLICIES}")
        self.malformed = malformed
        self.places: dict[str, list[str]] = {}
        self.tables: dict[str, DataFrame] = {}
        self.formulas: dict[str, dict[str, str]] = {}
        self.functions: dict[str, object] = {}
        self.past: list[tuple[dict, dict]] = []
        self.future: list[tuple[dict, dict]] = []

    def _keep(self) -> None:
        self.past.append((dict(self.tables), {k: dict(v) for k, v in self.formulas.items()}))
        self.future.clear()

    def add_table(self, name: str, df: DataFrame, order: list[str] | None = None) -> None:
        """``order``: the columns that stand for the rows' places, by default the first."""
        self._keep()
        self.tables[name] = df
        self.places[name] = list(order if order is not None else df.columns[:1])
        self.formulas.setdefault(name, {})

    def set_formula(self, table: str, column: str, formula: str) -> None:
        try:
            parse(formula)
        except FormulaError:
            if self.malformed == "strict":
                raise
            formula = "=NA()" if self.malformed == "error" else '="' + formula.replace('"', '""') + '"'
        self._keep()
        self.formulas[table][column] = formula

    def edit(self, table: str, key: str, changes: DataFrame) -> None:
        """Cells of ``changes`` (key and some columns) replace those of equal key."""
        self._keep()
        base, names = self.tables[table], [c for c in changes.columns if c != key]
        new = changes.select(F.col(key).alias("__row_key"), *[F.col(c).alias(f"__new_{c}") for c in names], F.lit(True).alias("__row_hit"))
        out = base.join(new, base[key] == new["__row_key"], "left").withColumns({c: F.when(F.col("__row_hit"), F.col(f"__new_{c}")).otherwise(F.col(c)) for c in names})
        self.tables[table] = out.select(*base.columns)

    def remove_table(self, name: str) -> None:
        self._keep()
        self.tables.pop(name)
        self.formulas.pop(name, None)

    def rename_table(self, old: str, new: str) -> None:
        """The table under a new name; formulas that name it follow."""
        self._keep()
        self.tables[new], self.formulas[new], self.places[new] = self.tables.pop(old), self.formulas.pop(old), self.places.pop(old)
        swap = re.compile(rf"(?<![\w.]){re.escape(old)}(?=\[)", re.I)
        for columns in self.formulas.values():
            for c, f in columns.items():
                # texts in quotes stay as they are
                columns[c] = "".join(p if k % 2 else swap.sub(new, p) for k, p in enumerate(re.split(r'("(?:[^"]|"")*")', f)))

    def copy_table(self, name: str, new: str) -> None:
        self._keep()
        self.tables[new], self.formulas[new], self.places[new] = self.tables[name], dict(self.formulas[name]), list(self.places[name])

    def insert_rows(self, table: str, rows: DataFrame) -> None:
        self._keep()
        self.tables[table] = self.tables[table].unionByName(rows, allowMissingColumns=True)

    def delete_rows(self, table: str, key: str, gone: DataFrame) -> None:
        """Rows whose key is among ``gone``'s go."""
        self._keep()
        base = self.tables[table]
        self.tables[table] = base.join(gone.select(F.col(key).alias("__row_key")), base[key] == F.col("__row_key"), "left_anti")

    def delete_column(self, table: str, column: str) -> None:
        """Without the column; formulas that read it give #REF!, as their reference is gone."""
        self._keep()
        self.tables[table] = self.tables[table].drop(column)
        self.formulas[table].pop(column, None)

    def _known(self) -> dict[str, tuple[DataFrame, list[str]]]:
        return {n: (df, self.places[n]) for n, df in self.tables.items()}

    def spill(self, formula: str) -> DataFrame:
        """The rows of a formula that is an array."""
        return spill(next(iter(self.tables.values())).sparkSession, formula, self._known(), self.functions)

    def changes(self, table: str, key: str, before: DataFrame, wanted: list[str] | None = None) -> DataFrame:
        """Cells that differ from a former result: key, column, old and new text."""
        now = self.evaluate(table, wanted)
        names = [c for c in now.columns if c != key and c in before.columns]
        old = before.select(F.col(key).alias("__row_key"), *[F.col(c).cast("string").alias(f"__new_{c}") for c in names])
        both = now.join(old, now[key].eqNullSafe(old["__row_key"]), "full").select(F.coalesce(now[key], old["__row_key"]).alias(key), *[F.struct(F.lit(c).alias("column"), F.col(f"__new_{c}").alias("old"), F.col(c).cast("string").alias("new")).alias(f"s_{c}") for c in names])
        return both.select(key, F.inline(F.filter(F.array(*[f"s_{c}" for c in names]), lambda x: ~x["old"].eqNullSafe(x["new"]))))

    def register(self, name: str, f) -> None:
        """A custom function: takes and returns Vals."""
        self.functions[name.lower()] = f

    def register_aggregate(self, name: str, build, kind: str = "n") -> None:
        """A custom aggregate of whole columns: ``build`` makes an aggregate Column of a column of numbers."""
        self.functions[name.lower()] = Aggregate(build, kind)

    @contextmanager
    def cancellable(self, group: str):
        """Jobs that run inside belong to a group, which ``cancel`` stops."""
        context = next(iter(self.tables.values())).sparkSession.sparkContext
        context.setJobGroup(group, "workbook", interruptOnCancel=True)
        try:
            yield
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)

    def cancel(self, group: str) -> None:
        next(iter(self.tables.values())).sparkSession.sparkContext.cancelJobGroup(group)

    @contextmanager
    def transaction(self):
        """Edits inside are one step of undo, and none of them stays if an error leaves the block."""
        depth, state = len(self.past), (dict(self.tables), {k: dict(v) for k, v in self.formulas.items()}, {k: list(v) for k, v in self.places.items()})
        try:
            yield self
        except BaseException:
            self.tables, self.formulas, self.places = state
            del self.past[depth:]
            raise
        del self.past[depth + 1 :]

    def undo(self) -> None:
        self.future.append((self.tables, self.formulas))
        self.tables, self.formulas = self.past.pop()

    def redo(self) -> None:
        self.past.append((self.tables, self.formulas))
        self.tables, self.formulas = self.future.pop()

    def layers(self, table: str, wanted: list[str] | None = None) -> tuple[list[list[str]], set[str]]:
        """Formula columns in layers, each reading only what stands before it; and those in cycles."""
        formulas = self.formulas[table]
        lower = {c.lower(): c for c in formulas}
        reads = {c: {lower[n] for r in references(parse(f)) if (n := str(r.value[1] if isinstance(r.value, tuple) else r.value).lower()) in lower} for c, f in formulas.items()}
        need, todo = set(), list(wanted if wanted is not None else formulas)
        while todo:
            c = todo.pop()
            if c in formulas and c not in need:
                need.add(c)
                todo += reads[c]
        out, done = [], set()
        while ready := sorted(c for c in need - done if reads[c] <= done):
            out.append(ready)
            done |= set(ready)
        return out, need - done

    def evaluate(self, table: str, wanted: list[str] | None = None, errors: bool = False, iterations: int = 0, tolerance: float = 1e-3) -> DataFrame:
        """The table with its formula columns, or with those wanted.

        Columns in a cycle are #CIRC! (null), or with ``iterations`` are computed over and over from 0
        until none changes by more than ``tolerance``.
        """
        df = self.tables[table]
        layers, cyclic = self.layers(table, wanted)
        known = self._known()
        for layer in layers:
            known[table] = (df, self.places[table])
            df = copied_down(df, {c: self.formulas[table][c] for c in layer}, known, self.places[table], errors, self.functions)
        if not cyclic:
            return df
        names = sorted(cyclic)
        if not iterations:
            df = df.withColumns({c: F.lit(None).cast("double") for c in names})
            return df.withColumns({f"{c}__error": F.lit("#CIRC!") for c in names}) if errors else df
        return self._iterated(df, table, names, iterations, tolerance)

    def _iterated(self, df: DataFrame, table: str, names: list[str], iterations: int, tolerance: float) -> DataFrame:
        """Each round is one projection that takes the columns in turn; the plan is cut every ten rounds."""
        df = df.withColumns({c: F.lit(0.0) for c in names})
        for k in range(iterations):
            was = {c: f"__was_{i}" for i, c in enumerate(names)}
            df = df.withColumns({w: F.col(c) for c, w in was.items()})
            for c in names:
                known = self._known() | {table: (df, self.places[table])}
                df = copied_down(df, {c: self.formulas[table][c]}, known, self.places[table], False, self.functions)
                df = df.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
            if k % 10 == 9 or k == iterations - 1:
                df = cut(df)
                worst = df.agg(*[F.max(F.abs(F.col(c) - F.col(w))).alias(c) for c, w in was.items()]).first()
                if all(x is None or x <= tolerance for x in worst):
                    return df.drop(*was.values())
            df = df.drop(*was.values())
        return df


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder and read again, where the session has one."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        return df
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def scenarios(rows: DataFrame, model: dict[str, str]) -> DataFrame:
    """A model over many scenarios at once: each is a row, each output a formula over its inputs."""
    book = Workbook()
    book.add_table("s", rows)
    for name, f in model.items():
        book.set_formula("s", name, f)
    return book.evaluate("s")
