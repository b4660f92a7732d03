"""Significance tests between forecast models, for all series at once.

Input: ``errors(serie, modelo, fecha, e)`` with absolute errors on the same test dates, and
``best(serie, ganador)``. Ranks are windows inside one (series, date) or one (series, pair).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wastelens.functions.pvalues import chi2_tail, normal_two_sided, signed_rank_p
from wastelens.functions.scalar import fixed_text, steady_round

ALPHA = 0.05
MIN_DM, MIN_WILCOXON, MIN_MODELS, MIN_FRIEDMAN = 3, 5, 3, 3
SCHEMA = ["serie", "prueba", "modelo_a", "modelo_b", "n", "estadistico", "p_valor", "p_valor_ajustado", "significativo",
          "aplicable", "interpretacion"]


def errors(predictions: DataFrame) -> DataFrame:
    """Absolute errors at nine decimals, so that equal errors tie whatever the order of earlier sums."""
    gap = F.abs(F.col("y") - F.greatest(F.lit(0.0), F.col("yhat")))
    return predictions.select("serie", "modelo", "fecha", steady_round(gap, 9).alias("e"))


def pairs_with_best(errs: DataFrame, best: DataFrame) -> DataFrame:
    """Errors of every competitor beside those of the winner, dates where both exist."""
    rivals = errs.join(best.select("serie", "ganador"), "serie")
    mine = rivals.filter(F.col("modelo") == F.col("ganador")).select("serie", "fecha", F.col("e").alias("eg"))
    return (
        rivals.filter(F.col("modelo") != F.col("ganador")).join(mine, ["serie", "fecha"])
        .filter(F.col("e").isNotNull() & F.col("eg").isNotNull())
        .select("serie", "modelo", "ganador", "fecha", F.col("e").alias("ec"), "eg")
    )


def midrank(partition: list[str], value: str) -> Column:
    """Average rank of ties."""
    ordered = W.partitionBy(*partition).orderBy(value)
    return F.rank().over(ordered) + (F.count("*").over(W.partitionBy(*partition, value)) - 1) / 2


def _tie_term(partition: list[str], value: str) -> Column:
    """Per row t^2 - 1, whose sum over the rows is the sum of t^3 - t over the groups of ties."""
    t = F.count("*").over(W.partitionBy(*partition, value))
    return t * t - 1


def dm_statistic(pairs: DataFrame) -> DataFrame:
    """Diebold-Mariano statistic on squared loss; positive means the winner is more precise."""
    w = W.partitionBy("serie", "modelo").orderBy("fecha")
    d = pairs.withColumn("d", F.col("ec") * F.col("ec") - F.col("eg") * F.col("eg")).withColumn("d1", F.lag("d").over(w))
    sums = d.groupBy("serie", "modelo", "ganador").agg(
        F.count("*").alias("n"), F.avg("d").alias("m"), F.var_samp("d").alias("g0"), F.covar_samp("d", "d1").alias("g1"))
    var = (F.col("g0") + 2 * F.col("g1")) / F.col("n")
    stat = F.when(F.col("n") < MIN_DM, None).when(var > 0, F.col("m") / F.sqrt(var)).otherwise(0.0)
    return sums.select("serie", "modelo", "ganador", "n", stat.alias("dm"), (var <= 0).alias("sin_varianza"))


def diebold_mariano(pairs: DataFrame) -> DataFrame:
    p = F.when(F.col("sin_varianza"), 1.0).otherwise(normal_two_sided("dm"))
    tested = dm_statistic(pairs).withColumn("p", F.when(F.col("dm").isNotNull(), p))
    sure = F.coalesce(F.col("p") < ALPHA, F.lit(False))
    better = F.when(F.col("dm") > 0, F.col("ganador")).otherwise(F.col("modelo"))
    text = (
        F.when(F.col("dm").isNull(), F.lit(f"Muestra insuficiente para la prueba DM (mín. {MIN_DM} obs.)"))
        .when(F.col("sin_varianza"), F.lit("Varianza nula — ambos modelos producen errores idénticos"))
        .when(sure, F.concat(F.lit("Diferencia significativa al 5 % — "), better, F.lit(" presenta mayor precisión predictiva")))
        .otherwise(F.concat(F.lit("Sin diferencia estadísticamente significativa entre "), "modelo", F.lit(" y "), "ganador",
                            F.lit(" (p = "), fixed_text(F.col("p"), 4), F.lit(")"))))
    return tested.select(
        "serie", F.lit("diebold_mariano").alias("prueba"), F.col("modelo").alias("modelo_a"), F.col("ganador").alias("modelo_b"), "n",
        F.round("dm", 4).alias("estadistico"), F.round("p", 4).alias("p_valor"), F.lit(None).cast("double").alias("p_valor_ajustado"),
        sure.alias("significativo"), F.col("dm").isNotNull().alias("aplicable"), text.alias("interpretacion"))


def friedman_ranks(errs: DataFrame) -> DataFrame:
    """Mid-ranks of the models within each date on which all models have an error."""
    per_date, models = W.partitionBy("serie", "fecha"), W.partitionBy("serie")
    known = errs.filter(F.col("e").isNotNull())
    full = known.withColumns({
        "k": F.size(F.collect_set("modelo").over(models)), "en_fecha": F.count("*").over(per_date)}).filter("en_fecha = k")
    return full.withColumns({"rango": midrank(["serie", "fecha"], "e"), "empate": _tie_term(["serie", "fecha"], "e")})


def friedman_statistic(errs: DataFrame) -> DataFrame:
    per_model = friedman_ranks(errs).groupBy("serie", "k", "modelo").agg(
        F.count("*").alias("n"), F.sum("rango").alias("r"), F.sum("empate").alias("t"))
    sums = per_model.groupBy("serie", "k").agg(
        F.max("n").alias("n"), F.sum(F.col("r") * F.col("r")).alias("ss"), F.sum("t").alias("t"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    correction = 1 - F.col("t") / (n * k * (k * k - 1))
    stat = (12 / (k * n * (k + 1)) * F.col("ss") - 3 * n * (k + 1)) / F.when(correction > 0, correction)
    enough = (F.col("k") >= MIN_MODELS) & (F.col("n") >= MIN_FRIEDMAN)
    return sums.select("serie", F.col("k").cast("int").alias("k"), "n", F.when(enough, stat).alias("chi2"))


def friedman(errs: DataFrame) -> DataFrame:
    tested = friedman_statistic(errs).withColumn("p", chi2_tail("chi2", F.col("k") - 1))
    sure = F.coalesce(F.col("p") < ALPHA, F.lit(False))
    models, p = F.col("k").cast("string"), fixed_text(F.col("p"), 4)
    text = (
        F.when(F.col("chi2").isNull(), F.lit("Muestra insuficiente o menos de tres modelos para Friedman."))
        .when(sure, F.concat(F.lit("Diferencia estadísticamente significativa entre los "), models, F.lit(" modelos (p = "), p, F.lit(" < 0.05).")))
        .otherwise(F.concat(F.lit("Sin diferencia estadísticamente significativa entre los "), models, F.lit(" modelos (p = "), p, F.lit(" >= 0.05)."))))
    none = F.lit(None).cast("string")
    return tested.select(
        "serie", F.lit("friedman").alias("prueba"), none.alias("modelo_a"), none.alias("modelo_b"), "n",
        F.round("chi2", 4).alias("estadistico"), F.round("p", 4).alias("p_valor"), F.lit(None).cast("double").alias("p_valor_ajustado"),
        sure.alias("significativo"), F.col("chi2").isNotNull().alias("aplicable"), text.alias("interpretacion"))


def wilcoxon_statistic(pairs: DataFrame) -> DataFrame:
    """Smaller signed-rank sum of the winner's error minus the competitor's; zeros are dropped."""
    key = ["serie", "modelo"]
    diffs = pairs.withColumn("d", steady_round(F.col("eg") - F.col("ec"), 9)).withColumn("a", F.abs("d"))
    size = diffs.groupBy("serie", "modelo", "ganador").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("d") == 0, 1)).alias("ceros"))
    ranks = diffs.filter("d <> 0").withColumns({"rango": midrank(key, "a"), "empate": _tie_term(key, "a")})
    sums = ranks.groupBy(*key).agg(
        F.sum(F.when(F.col("d") > 0, F.col("rango")).otherwise(0.0)).alias("mas"),
        F.sum(F.when(F.col("d") < 0, F.col("rango")).otherwise(0.0)).alias("menos"), F.sum("empate").alias("empates"))
    w = F.when(F.col("n") < MIN_WILCOXON, None).otherwise(F.coalesce(F.least("mas", "menos"), F.lit(0.0)))
    return size.join(sums, key, "left").select(
        "serie", "modelo", "ganador", "n", "ceros", F.coalesce("empates", F.lit(0)).alias("empates"), w.alias("w"))


def holm(rows: DataFrame, family: list[str], p: str = "p_valor") -> DataFrame:
    """Step-down adjusted p-values inside each family; null p-values stay out of it."""
    has = F.col(p).isNotNull()
    part = W.partitionBy(*family, has)
    ordered = part.orderBy(p, "modelo_b")
    raw = F.least(F.lit(1.0), (F.count("*").over(part) - F.row_number().over(ordered) + 1) * F.col(p))
    running = F.max("escalon").over(ordered.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("escalon", F.when(has, raw)).withColumn("p_valor_ajustado", F.when(has, F.round(running, 4))).drop("escalon")


def wilcoxon(pairs: DataFrame) -> DataFrame:
    p = F.when(F.col("ceros") == F.col("n"), 1.0).otherwise(signed_rank_p("w", F.col("n") - F.col("ceros"), "empates", "ceros"))
    tested = wilcoxon_statistic(pairs).withColumn("p", F.when(F.col("w").isNotNull(), p)).select(
        "serie", F.lit("wilcoxon").alias("prueba"), F.col("ganador").alias("modelo_a"), F.col("modelo").alias("modelo_b"), "n",
        F.round("w", 4).alias("estadistico"), F.round("p", 4).alias("p_valor"), (F.col("ceros") == F.col("n")).alias("iguales"))
    sure = F.coalesce(F.col("p_valor_ajustado") <= ALPHA, F.lit(False))
    detail = F.concat(F.lit("(p original = "), fixed_text(F.col("p_valor"), 4), F.lit(", p ajustado = "), fixed_text(F.col("p_valor_ajustado"), 4))
    text = (
        F.when(F.col("estadistico").isNull(), F.concat(F.lit("Muestra insuficiente ("), F.col("n").cast("string"), F.lit(" obs.) para Wilcoxon (mín. 5).")))
        .when(F.col("iguales"), F.lit("Errores idénticos entre ambos modelos en todas las observaciones."))
        .when(sure, F.concat(F.lit("Diferencia significativa tras corrección Holm-Bonferroni "), detail, F.lit(" < 0.05).")))
        .otherwise(F.concat(F.lit("Sin diferencia significativa tras corrección Holm-Bonferroni "), detail, F.lit(" >= 0.05)."))))
    return holm(tested, ["serie"]).select(
        *SCHEMA[:8], sure.alias("significativo"), F.col("estadistico").isNotNull().alias("aplicable"), text.alias("interpretacion"))


def all_tests(predictions: DataFrame, best: DataFrame) -> DataFrame:
    """Friedman over all models, then the winner against each competitor, as one long table."""
    errs = errors(predictions)
    pairs = pairs_with_best(errs, best)
    return friedman(errs).unionByName(wilcoxon(pairs)).unionByName(diebold_mariano(pairs))
