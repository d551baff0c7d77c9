"""What tests share."""

import os

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    """A value that compares alike from both engines."""
    if v is None or v != v:
        return "NULL"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


def rows_of(table) -> list[tuple]:
    """Sorted rows of a Spark frame or a DuckDB relation, columns by name."""
    names = sorted(table.columns)
    if hasattr(table, "toArrow"):
        data = table.toArrow().to_pylist()
    else:
        data = [dict(zip(table.columns, r)) for r in table.fetchall()]
    return sorted(tuple(plain(r[n]) for n in names) for r in data)
