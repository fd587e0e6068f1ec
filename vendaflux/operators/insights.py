"""The facts behind each executive summary, as rows (topico, chave, valor, texto)."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vendaflux.functions import measures as M
from vendaflux.functions import values as V
from vendaflux.functions.figures import money, percent, thousands
from vendaflux.functions.months import month_key, month_start
from vendaflux.operators.abc import _class_totals
from vendaflux.operators.adhoc import discount_correlation, product_delta, top_declines
from vendaflux.operators.cohort import cohort_averages, cohort_best_worst
from vendaflux.plans.materialise import materialise


def _fact(topic: str, key: Column | str, value: Column | None = None, text: Column | None = None) -> Column:
    return F.struct(
        F.lit(topic).alias("topico"), (F.lit(key) if isinstance(key, str) else key.cast("string")).alias("chave"),
        (F.lit(None) if value is None else value).cast("double").alias("valor"),
        (F.lit(None) if text is None else text).cast("string").alias("texto"))


def _facts(df: DataFrame, *facts: Column) -> DataFrame:
    return df.select(F.inline(F.array(*facts)))


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# How the figure of a fact is written: by topic and key, else by topic; facts without an entry are counts.
_WRITTEN = {
    "media": "percent", "melhores": "percent", "piores": "percent", "risco": "percent", "concentracao": "percent", "classe_A": "percent",
    ("classe_C", "pct_receita"): "percent", ("ultimo_mes", "realizado"): "money", ("ultimo_mes", "meta"): "money", ("ultimo_mes", "gap"): "signed money",
    ("ultimo_mes", "gap_pct"): "signed percent", "produto": "signed money", "canal": "signed money", "queda": "signed money", "correlacao": "number",
    ("decomposicao", "pct_volume"): "points", ("decomposicao", "pct_preco"): "points", "decomposicao": "signed money",
    "canal_efeito_volume": "signed money", "canal_efeito_preco": "signed money", "canal_efeito_cruzado": "signed money"}


def with_figures(facts: DataFrame) -> DataFrame:
    """Facts with ``formatado``: the value as a summary shows it (NULL without a value)."""
    x = F.col("valor")
    styles = {"money": money(x), "signed money": money(x, signed=True), "percent": percent(x), "signed percent": percent(x, signed=True),
              "points": F.concat(thousands(x), F.lit("%")), "number": thousands(x, 2)}
    written = None
    for of, style in sorted(_WRITTEN.items(), key=lambda kv: isinstance(kv[0], str)):  # topic and key first
        fits = F.col("topico") == of if isinstance(of, str) else (F.col("topico") == of[0]) & (F.col("chave") == of[1])
        written = F.when(fits, styles[style]) if written is None else written.when(fits, styles[style])
    return facts.withColumn("formatado", written.otherwise(thousands(x)))


def insights_cohort(summary: DataFrame) -> DataFrame:
    """Mean M1 to M3, and the strongest and weakest cohorts by M1."""
    summary = materialise(summary)  # one row per cohort, read by three branches
    means = _facts(cohort_averages(summary), *[_fact("media", f"m{k}", F.col(f"media_m{k}")) for k in (1, 2, 3)])
    ranked = cohort_best_worst(summary).select(
        F.col("grupo").alias("topico"), F.col("posicao").cast("string").alias("chave"),
        F.col("retencao_m1").alias("valor"), F.col("coorte").alias("texto"))
    return _union(means, ranked)


def insights_abc(abc: DataFrame) -> DataFrame:
    """Risk level, top shares, class sizes; one pass over the classified clients."""
    t = _class_totals(abc)
    total, n = F.col("total"), F.col("n")

    def share(num: str, den: Column) -> Column:
        return M.ratio(F.col(num), den)

    return _facts(
        t, _fact("risco", "nivel", share("top_10", total), M.risk_level(share("top_10", total))),
        _fact("concentracao", "top_10", share("top_10", total)), _fact("concentracao", "top_3", share("top_3", total)),
        _fact("classe_A", "pct_clientes", share("n_A", n)), _fact("classe_A", "pct_receita", share("r_A", total)),
        _fact("classe_B", "clientes", F.col("n_B")), _fact("classe_C", "clientes", F.col("n_C")),
        _fact("classe_C", "pct_receita", share("r_C", total)))


def insights_adhoc(v: DataFrame, as_of: date | None = None) -> DataFrame:
    """Products in decline, worst first, and the reading of the discount correlation (in the scope of ``as_of``)."""
    falls = top_declines(product_delta(v))
    pos = F.row_number().over(Window.orderBy("delta", "produto"))  # at most ten rows
    falls = falls.withColumn("_pos", pos).select(
        F.lit("queda").alias("topico"), F.col("_pos").cast("string").alias("chave"),
        F.col("delta").alias("valor"), F.col("produto").alias("texto"))
    corr = discount_correlation(v, as_of=as_of)
    if corr is None:
        return falls
    return _union(falls, _facts(corr, _fact("correlacao", "r", F.col("r"), F.col("interpretacao"))))


def _gap_levels(v: DataFrame, m: DataFrame, tolerance: float) -> DataFrame:
    """Realised, target and gap per month, product and channel, from one pass over the cells of sales and targets.

    A month counts when both sides have it; products and channels add up the cells that have both a sale and a target.
    """
    money = "decimal(28,4)"
    real = v.groupBy(month_start("data").alias("_mes"), *V.DIMENSIONS).agg(F.sum("receita").cast(money).alias("_r"))
    real = real.select(month_key("_mes").alias("mes_ref"), *V.DIMENSIONS, "_r")
    goal = m.groupBy(*V.TARGET_KEYS).agg(F.sum(F.col("meta_receita").cast(money)).alias("_m"))
    cells = real.join(goal, list(V.TARGET_KEYS), "full")
    month, product, channel = (F.col(c) for c in ("mes_ref", "produto", "canal"))
    level = F.when(F.grouping("mes_ref") == 0, "mes").when(F.grouping("produto") == 0, "produto").otherwise("canal")
    sums = cells.groupingSets([[month], [product], [channel]], month, product, channel).agg(
        level.alias("nivel"), F.sum("_r").alias("_r"), F.sum("_m").alias("_m"), F.count("_r").alias("_n"),
        F.coalesce(F.sum(F.col("_r") - F.col("_m")), F.lit(0)).alias("_g"))
    pct = M.half_even(M.ratio(F.col("_r") - F.col("_m"), F.col("_m")), 4)
    return sums.select(
        "nivel", F.coalesce("mes_ref", "produto", "canal").alias("chave"), "_r", "_m", "_n", M.as_double(F.col("_g")).alias("gap_celulas"),
        M.as_double(F.col("_r") - F.col("_m")).alias("gap"), pct.alias("gap_pct"), M.gap_status(pct, tolerance).alias("status"))


def insights_gap(v: DataFrame, m: DataFrame, decomp: DataFrame, tolerance: float = V.GAP_TOLERANCE) -> DataFrame:
    """Last month, months per status, drivers by product and channel, effects and the diagnosis.

    ``v`` are sales (or sums of them by ``data`` and dimensions), ``m`` targets.  Nothing is materialised: the levels
    come from one pass with grouping sets, and ordered aggregates turn them into one row that is unfolded to facts.
    Lists in that row hold a value per channel, none per month or client.
    """
    at = F.col("nivel")
    both = (at == "mes") & F.col("_r").isNotNull() & F.col("_m").isNotNull()
    figures = F.struct("chave", M.as_double(F.col("_r")).alias("realizado"), M.as_double(F.col("_m")).alias("meta"), "gap", "gap_pct", "status")
    # a product or channel that has only targets is no driver
    driver = F.col("_n") > 0
    worst = F.min(F.when((at == "produto") & driver, F.struct("gap_celulas", "chave")))
    best = F.min(F.when((at == "produto") & driver, F.struct((-F.col("gap_celulas")).alias("v"), "chave")))
    channels = F.sort_array(F.collect_list(F.when((at == "canal") & driver, F.struct("chave", "gap_celulas"))))
    one = _gap_levels(v, m, tolerance).agg(
        F.max(F.when(both, figures)).alias("u"), worst.alias("w"), best.alias("b"), channels.alias("c"),
        *[F.count(F.when(both & (F.col("status") == s), 1)).alias(s) for s in (V.GAP_ABOVE, V.GAP_ON, V.GAP_BELOW)])
    u = F.col("u")
    fixed = F.array(
        *[_fact("ultimo_mes", c, u[c], u["chave"]) for c in ("realizado", "meta", "gap", "gap_pct")], _fact("ultimo_mes", "status", None, u["status"]),
        *[_fact("meses", s, F.col(f"`{s}`")) for s in (V.GAP_ABOVE, V.GAP_ON, V.GAP_BELOW)],
        _fact("produto", "detrator", F.col("w.gap_celulas"), F.col("w.chave")), _fact("produto", "destaque", -F.col("b.v") + F.lit(0.0), F.col("b.chave")))
    per_channel = F.transform("c", lambda x: _fact("canal", x["chave"], x["gap_celulas"], F.when(x["gap_celulas"] < 0, "negativo").otherwise("positivo")))
    levels = one.select(F.inline(F.concat(F.filter(fixed, lambda f: (f["topico"] != "ultimo_mes") | u.isNotNull()), per_channel)))
    return levels.unionByName(_effect_facts(decomp))


def _effect_facts(decomp: DataFrame) -> DataFrame:
    """Totals of the effects and the effects per channel, from one read of the decomposition."""
    effects = ("efeito_volume", "efeito_preco", "efeito_cruzado")
    one = decomp.agg(*[F.round(F.sum(c), 2).alias(c) for c in (*effects, "gap_total")],
                     F.sort_array(F.collect_list(F.struct("canal", *[F.round(c, 2).alias(c) for c in effects]))).alias("c"))

    def pct(c: str) -> Column:
        return M.ratio_or_zero(F.abs(F.col(c)), F.abs(F.col("gap_total"))) * 100

    totals = [_fact("decomposicao", c, F.col(c)) for c in ("gap_total", *effects)]
    totals += [_fact("decomposicao", "pct_volume", pct("efeito_volume")), _fact("decomposicao", "pct_preco", pct("efeito_preco"))]
    known = F.filter(F.array(*totals), lambda f: f["valor"].isNotNull())
    dominant = F.array(_fact("decomposicao", "dominante", None, M.dominant_effect(F.col("efeito_volume"), F.col("efeito_preco"))))

    def of_channels(c: str) -> Column:
        return F.transform("c", lambda x: _fact(f"canal_{c}", x["canal"], x[c]))

    per_channel = [of_channels(c) for c in effects]
    return one.select(F.inline(F.concat(known, dominant, *per_channel)))
