"""Words for the size of a statistic. A value belongs to the first band whose bound it is below."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bands and words of the reports.
AUC = [(0.6, "casi aleatorio"), (0.7, "separación débil"), (0.8, "separación moderada"), (None, "separación fuerte")]
COHEN_D = [(0.2, "despreciable"), (0.5, "pequeño"), (0.8, "mediano"), (None, "grande")]
IV = [(0.02, "inútil"), (0.10, "débil"), (0.30, "medio"), (0.50, "fuerte"), (None, "sospechoso, revisar leakage")]
CRAMERS_V = [(0.1, "despreciable"), (0.3, "débil"), (0.5, "moderada"), (None, "fuerte")]
KS_DRIFT = [(0.1, "sin drift"), (0.2, "drift leve"), (None, "drift significativo")]
PSI = [(0.1, "sin drift"), (0.25, "drift moderado"), (None, "drift significativo")]
#: These three are bounded from above: a value at the bound still belongs to the band.
VIF = [(5, "baja"), (10, "moderada"), (None, "severa")]
SKEW = [(0.5, "bajo"), (1, "moderado"), (None, "alto")]
OUTLIERS = [(0.01, "bajo"), (0.05, "moderado"), (None, "alto")]
NO_DATA = "sin datos"


def label(value: Column, bands: list, closed: bool = False, missing: str | None = None) -> Column:
    """The band's word. ``closed``: bounds belong to the band below; ``missing``: the word for null, else null."""
    out = F.when(value.isNull(), F.lit(missing))
    for bound, word in bands:
        out = out.otherwise(word) if bound is None else out.when(value <= bound if closed else value < bound, word)
    return out


def label_sql(value: str, bands: list, closed: bool = False, missing: str | None = None) -> str:
    parts = [f"WHEN {value} IS NULL THEN " + (f"'{missing}'" if missing else "NULL")]
    parts += [f"WHEN {value} {'<=' if closed else '<'} {bound} THEN '{word}'" for bound, word in bands if bound is not None]
    return "CASE " + " ".join(parts) + f" ELSE '{bands[-1][1]}' END"
