"""Chains of named operations: plain records that fold into one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame

from lodestrata.operators import duplicates, filters, group, model, paging, shape


@dataclass(frozen=True)
class Op:
    """A registered operation's name, its arguments after the table, and notes: `auto` marks generated cleaning, `quick` filters."""

    name: str
    args: tuple = ()
    meta: dict = field(default_factory=dict, compare=False, hash=False)

    @property
    def column(self):
        return self.args[0] if self.args else None


REGISTRY: dict[str, Callable] = {}


def register(name: str) -> Callable:
    """Registers a function (table, *args) -> table, or -> (table, notes by column)."""

    def wrap(fn: Callable) -> Callable:
        REGISTRY[name] = fn
        return fn

    return wrap


for _name, _fn in {
    "no_op": lambda df, *_: df, "drop_column": shape.drop_column, "drop_null_columns": shape.drop_null_columns, "fill_null": shape.fill_null, "one_hot": shape.one_hot, "replace": shape.replace_value,
    "safe_int": shape.safe_int, "narrow_int": shape.narrow_int, "coerce": shape.coerce, "to_datetime": shape.to_datetime_strict, "make_category": shape.make_category, "index": shape.promote_to_index,
    "search": filters.search, "search_column": filters.search_column, "range_filter": filters.range_filter, "remove_outliers": filters.remove_outliers, "only_outliers": filters.only_outliers, "any_outliers": filters.any_outliers, "rare_rows": filters.rare_rows,
    "rank": paging.rank, "group_by": group.group_by, "group_by_transform": group.group_by_transform, "drop_duplicates": duplicates.drop_duplicates, "distinct_on": duplicates.distinct_on, "linear_regression": model.linear_regression, "order_columns": model.order_columns,
}.items():
    REGISTRY[_name] = _fn
for _name, _clean in shape.CLEANERS.items():
    REGISTRY.setdefault(_name, lambda df, column, _clean=_clean: shape.replace_column(df, column, _clean(shape.col(column))))


def run(df: DataFrame, ops: list[Op]) -> tuple[DataFrame, dict]:
    """The table after all operations in order, and the notes by column that operations gave."""
    notes: dict = {}

    def step(table: DataFrame, op: Op) -> DataFrame:
        if op.name not in REGISTRY:
            raise ValueError(f"no operation {op.name}")
        out = REGISTRY[op.name](table, *op.args)
        if isinstance(out, tuple):
            out, found = out
            for c, v in found.items():
                notes.setdefault(c, {}).update(v)
        return out

    return reduce(step, ops, df), notes


def merge(existing: list[Op], cleaning: list[Op]) -> list[Op]:
    """Generated operations replace those generated before and come first; columns that the user cleans already are left to the user."""
    own = [o for o in existing if not o.meta.get("auto")]
    taken = {o.column for o in own if o.name in shape.CLEANERS or o.name in ("safe_int", "coerce", "to_datetime")}
    return [replace(o, meta={**o.meta, "auto": True}) for o in cleaning if o.column not in taken] + own


#: How many values each quick filter takes.
QUICK = {"search": 1, "search_column": 2, "range_filter": 3, "rare_rows": 0, "only_outliers": 2}


def quick_ops(asked: dict[str, list]) -> list[Op]:
    """Operations for quick filters by name; an empty value asks for none, and a wrong number of values is an error."""
    out = []
    for name, values in asked.items():
        if name not in QUICK:
            raise ValueError(f"no quick filter {name}")
        if len(values) != QUICK[name]:
            raise ValueError(f"{name} takes {QUICK[name]} values, not {len(values)}")
        if values and values[0] in (None, ""):
            continue
        out.append(Op(name, tuple(values), {"quick": True}))
    return out


def split(ops: list[Op]) -> tuple[list[Op], list[Op]]:
    """(operations that clean, operations that filter): a profile's cleaned scope ends before the first filter."""
    quick = [o for o in ops if o.meta.get("quick")]
    return [o for o in ops if not o.meta.get("quick")], quick


def process(df: DataFrame, fn: Callable[[DataFrame], DataFrame], strict: bool = False) -> DataFrame:
    """A user's table function applied. If it fails, or returns no table, the result is one row with the message in `err`; strict: the failure is raised."""
    try:
        out = fn(df)
        if not isinstance(out, DataFrame):
            raise TypeError(f"a table function returns a DataFrame, not {type(out).__name__}")
        return out
    except Exception as error:  # noqa: BLE001  a user's function may fail in any way
        if strict:
            raise
        return df.sparkSession.createDataFrame([(str(error),)], "err string")
