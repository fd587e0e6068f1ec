from vendaflux.__main__ import main


def test_generate_then_analyse(spark, tmp_path):
    data = str(tmp_path / "data")
    assert set(main(["synth", "--out", data, "--rows", "2000", "--clients", "80", "--format", "csv"])) == {"vendas", "metas"}
    common = ["--sales", f"{data}/vendas", "--input-format", "csv"]
    out = main(["targets", *common, "--targets", f"{data}/metas", "--out", str(tmp_path / "gap")])
    assert {"resumo", "detalhe", "parametros", "decomposicao"} <= set(out)
    assert spark.read.parquet(out["detalhe"]).filter("forecast_receita IS NULL").count() == 0
    out = main(["cohort", *common, "--out", str(tmp_path / "cohort"), "--format", "csv"])
    assert spark.read.option("header", True).csv(out["detalhe"]).columns[:2] == ["coorte", "m0"]
