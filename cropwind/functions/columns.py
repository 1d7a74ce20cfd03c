"""Small helpers shared by the expression modules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_column(value: ColumnLike) -> Column:
    return F.col(quoted(value)) if isinstance(value, str) else value


def quoted(name: str) -> str:
    """Column name as an identifier, for names such as ``close_zs=f`` or ``a.b``."""
    return "`" + name.replace("`", "``") + "`"


def as_names(keys: str | Iterable[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def require_columns(available: Iterable[str], needed: Iterable[str], error: type[Exception] = ValueError) -> None:
    available = list(available)
    missing = [name for name in needed if name not in available]
    if missing:
        raise error(f"missing columns {missing}; available: {available}")


def text(value: str) -> str:
    """A string as an SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
