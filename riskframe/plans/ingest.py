"""From raw centre files or a headed registry file to the canonical record table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.operators import project as P, quality as Q
from riskframe.sources.tables import read_many, write_csv
from riskframe.spec import GENDER_CODES, HEART_SPEC, FeatureSpec


def canonical(
    raw: DataFrame, spec: FeatureSpec = HEART_SPEC, start: int = 20000, extra=(), order=None
) -> DataFrame:
    """Rename, binarise the label, keep the registry's columns, number the rows.

    Codes become whole numbers. `extra` columns, such as the centre, are kept at the end. `order`
    names the columns that identify a row for numbering, where there are any.
    """
    df = P.binarize_label(P.rename_map(raw), spec.label)
    kept = [F.col(c).cast("double") for c in spec.numeric]
    kept += [F.col(c).cast("int") for c in spec.categorical]
    df = df.select(*kept, spec.label, *extra)
    return P.add_surrogate_id(df, spec.id, start, order, if_absent=False)


def combine_registries(
    spark: SparkSession, folder: str, output: str | None = None, keep_center: bool = False
) -> DataFrame | None:
    """All centre files as one canonical table; written as CSV if `output` is given."""
    raw = read_many(spark, folder)
    if raw is None:
        return None
    df = canonical(raw, extra=["center"] if keep_center else [])
    if output:
        write_csv(df, output)
    return df


def standardize_registry(
    df: DataFrame,
    auto_offset: bool = True,
    start: int = 10000,
    output: str | None = None,
) -> DataFrame:
    """Bring a headed registry table to the canonical names and codes.

    Zero-indexed code columns are shifted, text genders mapped, `thal` dropped and an id added where
    there is none. The label keeps the name it has.
    """
    names = {k: v for k, v in P.SOURCE_NAMES.items() if v != HEART_SPEC.label}
    out = P.rename_map(df, names)
    if auto_offset:
        out = Q.align_offset(out)
    if "gender" in out.columns:
        out = P.map_code_column(out, "gender", GENDER_CODES)
    out = P.drop_if_exists(out, "thal")
    out = P.add_surrogate_id(out, HEART_SPEC.id, start)
    if output:
        write_csv(out, output)
    return out
