"""Exports: CSV datasets and bundles of named datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def write_csv(df: DataFrame, path: str) -> str:
    """UTF-8 CSV with header, one file per partition."""
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
    return path


def export_bundle(frames: dict[str, DataFrame], path: str) -> dict[str, str]:
    """One CSV dataset per name; an empty frame leaves a placeholder row.

    A dataset is a directory, so its whole name is kept; only path separators are replaced, and
    two names that would share a directory are an error.
    """
    folders = {name: name.replace("/", "_").replace(":", "_") for name in frames}
    if len(set(folders.values())) < len(folders):
        raise ValueError(f"dataset names collide: {sorted(frames)}")
    out = {}
    for name, frame in frames.items():
        sheet = folders[name]
        filled = frame
        if frame.isEmpty():
            filled = frame.sparkSession.range(1).select(F.lit("Sin datos").alias("info"))
        out[sheet] = write_csv(filled, f"{path}/{sheet}")
    return out


def experiment_sheets(result: dict[str, DataFrame], eda: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The nine datasets of an experiment export."""
    return {
        "Resumen": result["interpretacion"], "EDA": eda["descriptivas"], "Serie": result["series"],
        "Correlaciones": eda["correlaciones"], "Modelos": result["modelos"], "Validacion cruzada": result["folds"],
        "Hiperparametros": result.get("busqueda", result["ganadores"].limit(0)), "Pruebas": result["pruebas"],
        "Pronosticos": result["futuro"]}
