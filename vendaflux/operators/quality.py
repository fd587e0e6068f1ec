"""Data quality as rows (regra, violacoes, ok).  Nothing is asserted and no row is dropped."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendaflux.functions import measures as M
from vendaflux.functions import values as V
from vendaflux.functions.months import month_diff, month_key, month_start
from vendaflux.operators.adhoc import client_discount_ticket, has_discount, latest_months, window_rows
from vendaflux.operators.joins import keys_only_in_left
from vendaflux.operators.profile import repeated_rows
from vendaflux.sources.schema import column_set_diff


def _rows(one_row: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    structs = [F.struct(F.lit(name).alias("regra"), F.coalesce(n.cast("bigint"), F.lit(0)).alias("violacoes"))
               for name, n in rules.items()]
    return one_row.select(F.inline(F.array(*structs))).withColumn("ok", F.col("violacoes") == 0)


def _fails(rule: Column, weight: Column | None = None) -> Column:
    """Rows for which the rule is not true (unknown counts as a violation)."""
    return F.sum(F.when(rule, 0).otherwise(F.lit(1) if weight is None else weight))


def _missing(df: DataFrame, required: Sequence[str]) -> Column:
    return F.lit(len(column_set_diff(df, required)))


def _nulls(df: DataFrame, required: Sequence[str]) -> Column:
    present = [c for c in required if c in df.columns]
    return sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in present), F.lit(0))


def dq_sales(v: DataFrame) -> DataFrame:
    """Columns, nulls, duplicate rows, discount range, positive figures.

    One pass combines the rules per row hash before the only shuffle of all rows, which carries the hash and counts;
    whole rows move only where a hash repeats (``repeated_rows``).  Rules on absent columns are left out.
    """
    cols = [c for c in V.REQUIRED_SALES if c in v.columns]
    aggs = {"nulos": F.sum(_nulls(v, cols))}
    if "desconto_pct" in cols:
        aggs["desconto_fora_da_faixa"] = _fails(F.col("desconto_pct").between(*V.DISCOUNT_RANGE))
    for c in ("quantidade", "receita", "custo"):
        if c in cols:
            aggs[f"{c}_nao_positiva"] = _fails(F.col(c) > 0)
    one = v.agg(*[a.alias(name) for name, a in aggs.items()])
    copies = repeated_rows(v, cols).agg(F.coalesce(F.sum(F.col("ocorrencias") - 1), F.lit(0)).alias("linhas_duplicadas"))
    rules = {"colunas_ausentes": _missing(v, V.REQUIRED_SALES), "nulos": F.col("nulos"), "linhas_duplicadas": F.col("linhas_duplicadas"),
             **{k: F.col(k) for k in aggs if k != "nulos"}}
    return _rows(one.withColumn("linhas_duplicadas", copies.scalar()), rules)


def dq_targets(m: DataFrame) -> DataFrame:
    """Columns, nulls, unique key, positive target."""
    g = m.groupBy(*V.TARGET_KEYS).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(_nulls(m, V.REQUIRED_TARGETS)).alias("_nulos"),
        _fails(F.col("meta_receita") > 0).alias("_meta"))
    one = g.agg(F.sum("_nulos").alias("a"), F.sum(F.col("_n") - 1).alias("b"), F.sum("_meta").alias("c"))
    return _rows(one, {"colunas_ausentes": _missing(m, V.REQUIRED_TARGETS), "nulos": F.col("a"),
                       "chave_duplicada": F.col("b"), "meta_nao_positiva": F.col("c")})


def _input(v: DataFrame, required: Sequence[str], revenue: tuple[str, Column]) -> DataFrame:
    name, rule = revenue
    one = v.agg(_fails(F.col("cliente_id").isNotNull()).alias("a"), _fails(rule).alias("b"))
    return _rows(one, {"colunas_ausentes": _missing(v, required), "cliente_nulo": F.col("a"), name: F.col("b")})


def dq_cohort_input(v: DataFrame) -> DataFrame:
    return _input(v, V.REQUIRED_COHORT, ("receita_nao_positiva", F.col("receita") > 0))


def dq_pareto_input(v: DataFrame) -> DataFrame:
    """Zero revenue is allowed here."""
    return _input(v, V.REQUIRED_ABC, ("receita_negativa", F.col("receita") >= 0))


def dq_adhoc_input(v: DataFrame, recent: int = V.RECENT_MONTHS, prior: int = V.PRIOR_MONTHS,
                   as_of: date | None = None) -> DataFrame:
    """Columns, enough months, no negative revenue, no empty month in the windows, products in both
    windows, a possible correlation, and product deltas that add up to the total delta."""
    need = recent + prior
    required = sorted({*V.REQUIRED_DECLINE, *V.REQUIRED_CORRELATION} - ({"desconto_pct"} if has_discount(v) else set()))
    months = latest_months(v, need)
    calendar = months.agg(F.count(F.lit(1)).alias("n"), (month_diff(F.min("_mes"), F.max("_mes")) + 1).alias("span"))
    rows = window_rows(v, recent, prior, None)
    is_recent = F.col("ordem") <= recent
    per_product = rows.groupBy("produto").agg(
        F.sum(F.when(is_recent, F.col("receita"))).alias("r"), F.sum(F.when(~is_recent, F.col("receita"))).alias("p"))
    rec, ant = F.coalesce("r", F.lit(0)).cast("double"), F.coalesce("p", F.lit(0)).cast("double")
    deltas = per_product.agg(
        F.count(F.when(F.col("r").isNull() | F.col("p").isNull(), 1)).alias("solo"),
        F.sum(rec / recent - ant / prior).alias("by_product"),
        (F.sum(rec) / recent - F.sum(ant) / prior).alias("overall"))
    negative = v.agg(_fails(F.col("receita") >= 0).alias("n"))
    possible = has_discount(v) and {"cliente_id", "canal"} <= set(v.columns)
    r = client_discount_ticket(v, as_of=as_of).agg(F.corr("desconto_medio", "ticket_medio").alias("r")) if possible else None
    corr = F.lit(None).cast("double") if r is None else r.scalar()
    one = deltas.select("*", calendar.select("n").scalar().alias("n"), calendar.select("span").scalar().alias("span"),
                        negative.scalar().alias("negative"), corr.alias("corr"))
    return _rows(one, {
        "colunas_ausentes": _missing(v, required),
        "meses_insuficientes": F.greatest(F.lit(need) - F.col("n"), F.lit(0)),
        "receita_negativa": F.col("negative"),
        "meses_zerados": F.col("span") - F.col("n"),
        "produto_em_uma_so_janela": F.col("solo"),
        "correlacao_fora_de_faixa": (F.abs("corr") > 1).cast("int"),
        "soma_dos_deltas": (F.abs(F.col("by_product") - F.col("overall")) > V.CLOSURE_TOLERANCE).cast("int"),
    })


def dq_gap_input(v: DataFrame, m: DataFrame) -> DataFrame:
    """Columns on both sides, positive targets, and channels with a target but no sales (a warning)."""
    orphans = keys_only_in_left(m, v, "canal").agg(F.count(F.lit(1)))
    one = m.agg(_fails(F.col("meta_receita") > 0).alias("a")).withColumn("b", orphans.scalar())
    return _rows(one, {
        "colunas_ausentes_vendas": _missing(v, V.REQUIRED_GAP_SALES),
        "colunas_ausentes_metas": _missing(m, V.REQUIRED_GAP_TARGETS),
        "meta_nao_positiva": F.col("a"), "canal_sem_vendas": F.col("b")})


def dq_cohort_output(retention: DataFrame, summary: DataFrame) -> DataFrame:
    """One base row per cohort, retention in [0, 1], M0 = 1, positive revenue."""
    base_rows = F.count(F.when(F.col("periodo_idx") == 0, 1))
    g = retention.groupBy("coorte").agg(
        base_rows.alias("_b"), _fails(F.col("retencao").between(0, 1)).alias("_faixa"),
        F.count(F.when((F.col("periodo_idx") == 0) & (F.col("retencao") != 1), 1)).alias("_m0"))
    revenue = summary.agg(_fails(F.col("receita") > 0)).scalar()
    one = g.agg(_fails(F.col("_b") == 1).alias("a"), F.sum("_faixa").alias("b"), F.sum("_m0").alias("c")).withColumn("d", revenue)
    return _rows(one, {"base_por_coorte": F.col("a"), "retencao_fora_de_faixa": F.col("b"),
                       "m0_diferente_de_1": F.col("c"), "receita_nao_positiva": F.col("d")})


def dq_abc_output(abc: DataFrame, v: DataFrame) -> DataFrame:
    """Cumulative share ends at 1, one class per client, A near 80 % of revenue and at most 30 % of
    clients, and no revenue lost on the way."""
    money = F.col("receita").cast("decimal(28,4)")
    original = v.agg(F.sum("receita")).scalar()
    is_a = F.col("classe_abc") == "A"
    t = abc.agg(
        F.max("pct_acumulado").alias("end"), _fails(F.col("classe_abc").isin("A", "B", "C")).alias("unclassed"),
        (F.count(F.lit(1)) - F.countDistinct("cliente_id")).alias("repeated"),
        M.ratio(F.sum(F.when(is_a, money)), F.sum(money)).alias("a_share"),
        M.ratio(F.count(F.when(is_a, 1)), F.count(F.lit(1))).alias("a_clients"), F.sum(money).alias("ranked"),
    ).withColumn("original", original)
    low, high = V.ABC_A_SHARE_RANGE

    def bad(rule: Column) -> Column:
        return F.when(rule, 0).otherwise(1)

    return _rows(t, {
        "acumulado_final": bad(F.abs(F.col("end") - 1) < V.CUMULATIVE_TOLERANCE),
        "cliente_sem_classe": F.col("unclassed"),
        "cliente_repetido": F.col("repeated"),
        "classe_A_receita": bad(F.col("a_share").between(low, high)),
        "classe_A_clientes": bad(F.col("a_clients") <= V.ABC_A_MAX_CLIENT_SHARE),
        "receita_perdida": bad(F.col("ranked") == F.col("original")),
    })


def dq_gap_output(decomp: DataFrame, v: DataFrame, m: DataFrame) -> DataFrame:
    """Effects close, channel gaps add up to the total, every month is on both sides."""
    effects = F.col("efeito_volume") + F.col("efeito_preco") + F.col("efeito_cruzado")
    cents = V.CLOSURE_TOLERANCE
    months = v.groupBy(month_start("data").alias("_mes")).agg(F.sum("receita").alias("_r")).select(
        month_key("_mes").alias("mes_ref"), "_r")
    pair = decomp.groupBy("mes_anterior", "mes_atual").agg(
        F.sum(F.col("gap_total").cast("decimal(28,4)")).alias("gap"),
        _fails(F.abs(effects - F.col("gap_total")) < cents).alias("open"))
    pair = pair.join(months.select(F.col("mes_ref").alias("mes_atual"), F.col("_r").alias("r1")), "mes_atual", "left")
    pair = pair.join(months.select(F.col("mes_ref").alias("mes_anterior"), F.col("_r").alias("r0")), "mes_anterior", "left")
    one_side = months.select("mes_ref", F.lit(1).alias("s")).join(
        m.select("mes_ref").distinct().withColumn("t", F.lit(1)), "mes_ref", "full")
    lonely = one_side.agg(F.count(F.when(F.col("s").isNull() | F.col("t").isNull(), 1))).scalar()
    t = pair.agg(F.sum("open").alias("open"),
                 _fails(F.abs(F.col("gap") - (F.col("r1") - F.col("r0"))) < cents).alias("sum")).withColumn("lonely", lonely)
    return _rows(t, {"efeitos_nao_fecham": F.col("open"), "soma_canais_difere": F.col("sum"),
                     "mes_em_um_so_lado": F.col("lonely")})
