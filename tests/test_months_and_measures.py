from datetime import date
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from vendaflux.functions import measures as M
from vendaflux.functions.months import month_diff, month_key, month_start


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_month_edges(spark):
    df = spark.createDataFrame(
        [(date(2024, 1, 31), date(2024, 2, 1)), (date(2024, 2, 1), date(2024, 2, 29)), (date(2023, 12, 31), date(2024, 1, 1)),
         (date(2024, 3, 1), date(2023, 3, 31))], "a date, b date")
    assert [r[0] for r in df.select(month_diff("a", "b")).collect()] == [1, 0, 1, -12]
    assert tuple(df.select(month_start("a"), month_key("a")).first()) == (date(2024, 1, 1), "2024-01")


def test_half_even(spark):
    assert one(spark, M.half_even(F.lit(1) / F.lit(32), 4)) == (0.0312,)
    values = [k / 100000 for k in range(4600, 4640)] + [-0.03125, 0.72, 1 / 3]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = [r[0] for r in df.select(M.half_even(F.col("x"))).collect()]
    assert got == [float(x) for x in np.round(np.array(values), 4)]


def test_ratio_on_zero(spark):
    assert one(spark, M.ratio(F.lit(1), F.lit(0)), M.ratio_or_zero(F.lit(1), F.lit(0))) == (None, 0.0)


def test_gap_border(spark):
    df = spark.createDataFrame([(0.02,), (-0.02,), (0.0200001,), (-0.03,), (None,)], "g double")
    assert [r[0] for r in df.select(M.gap_status(F.col("g"))).collect()] == ["Na Meta", "Na Meta", "Acima", "Abaixo", "Na Meta"]


def test_discount(spark):
    df = spark.createDataFrame([(Decimal("100"), Decimal("95")), (Decimal("100"), Decimal("100")), (Decimal("0"), Decimal("5")),
                                (Decimal("100"), Decimal("79.99")), (Decimal("100"), Decimal("80")), (Decimal("100"), Decimal("90.5"))],
                               "t decimal(18,4), r decimal(18,4)")
    pct = M.discount_pct(F.col("t"), F.col("r"))
    assert [r[0] for r in df.select(M.discount_band(pct)).collect()] == [
        "1-5%", "0% (sem desconto)", "0% (sem desconto)", "20%+", "10-20%", "5-10%"]
    assert df.select(M.discount_coverage(F.col("t"))).collect()[2][0] == "SEM desconto"


def test_net_revenue_is_exact(spark):
    df = spark.createDataFrame([(p / 100, d / 100) for p in (1, 99, 90101, 1049999, 9999999999) for d in range(0, 11)], "p double, d double")
    for r in df.select("p", "d", M.net_revenue(F.col("p"), F.col("d")).alias("x")).collect():
        assert r.x == Decimal(str(r.p)) * (1 - Decimal(str(r.d)))


def test_product_type_and_labels(spark):
    assert one(spark, M.product_type(F.lit("Vale Refeição")), M.product_type(F.lit("Gift"))) == ("recorrente", "complementar")
    labels = [M.correlation_label(F.lit(x)) for x in (0.7, 0.3, 0.29, -0.3, -0.7)]
    assert one(spark, *labels) == ("forte positiva", "moderada positiva", "fraca", "moderada negativa", "forte negativa")
    assert one(spark, M.risk_level(F.lit(0.5)), M.risk_level(F.lit(0.51)), M.risk_level(F.lit(0.35))) == ("ELEVADO", "CRÍTICO", "MODERADO")
    assert one(spark, M.clip(F.lit(0.3), 0.0, 0.25)) == (0.25,)


def test_figures_are_written_as_python_writes_them(spark):
    from vendaflux.functions.figures import money, percent, thousands

    values = [0.0, 0.5, 1.5, 2.5, -2.5, 1234567.4, -999.5, 999999.5, 12.345, 1e12, 0.0005, -0.3149]
    df = spark.createDataFrame([(x,) for x in values] + [(None,)], "x double")
    got = df.select("x", thousands(F.col("x")), money(F.col("x"), signed=True), percent(F.col("x")), percent(F.col("x"), 1, True), thousands(F.col("x"), 2)).collect()
    for r in got:
        x = r.x
        assert tuple(r)[1:] == ((None,) * 5 if x is None else (f"{x:,.0f}", f"R$ {x:+,.0f}", f"{x:.1%}", f"{x:+.1%}", f"{x:,.2f}"))


def test_facts_with_figures(spark):
    from vendaflux.operators.insights import with_figures

    facts = [("ultimo_mes", "gap", -1234.5), ("ultimo_mes", "gap_pct", 0.051), ("meses", "Acima", 12.0), ("canal", "X", 2500.0), ("media", "m1", 0.25),
             ("decomposicao", "pct_preco", 41.6), ("decomposicao", "gap_total", 10.0), ("decomposicao", "dominante", None)]
    df = spark.createDataFrame([(*f, None) for f in facts], "topico string, chave string, valor double, texto string")
    assert [r.formatado for r in with_figures(df).collect()] == ["R$ -1,234", "+5.1%", "12", "R$ +2,500", "25.0%", "42%", "R$ +10", None]
