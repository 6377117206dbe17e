"""Rows of a Spark result and of a DuckDB result as sorted lists of texts, columns by name."""

import math


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return "0" if v == 0 else f"{float(v):.9g}"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in data)


def assert_same(df, relation):
    assert sorted(df.columns) == sorted(relation.columns)
    ours, theirs = rows(df.columns, df.collect()), rows(relation.columns, relation.fetchall())
    assert len(ours) == len(theirs)
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    assert not wrong, wrong[:3]
