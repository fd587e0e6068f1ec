"""Fixed values.

They must equal the published business rules for results to match, so they are
stated here once, in plain text.  Operators take most of them as default
arguments; nothing else in the package repeats them.
"""

# --- fixed values: transaction status -------------------------------------
STATUS_EFFECTIVE = "Efetivado"
STATUS_REVERSED = "Estornado"

# --- fixed values: product vocabulary --------------------------------------
PRODUCT_RECURRING = "recorrente"
PRODUCT_COMPLEMENTARY = "complementar"
RECURRING_PRODUCTS = ("Vale Alimentação", "Vale Refeição", "Vale Combustível")

# --- fixed values: required columns per analysis ---------------------------
REQUIRED_COHORT = ("cliente_id", "data", "receita")
REQUIRED_ABC = ("cliente_id", "receita")
REQUIRED_DECLINE = ("data", "produto", "receita")
REQUIRED_CORRELATION = ("cliente_id", "receita", "desconto_pct")
REQUIRED_GAP_SALES = ("data", "receita", "canal", "regional", "produto", "cliente_id")
REQUIRED_GAP_TARGETS = ("mes_ref", "canal", "regional", "produto", "meta_receita")
REQUIRED_SALES = (
    "data", "mes_ref", "cliente_id", "produto", "canal",
    "regional", "quantidade", "receita", "custo", "desconto_pct",
)
REQUIRED_TARGETS = (
    "mes_ref", "canal", "regional", "produto", "meta_receita", "forecast_receita",
)
TARGET_KEYS = ("mes_ref", "canal", "regional", "produto")
DIMENSIONS = ("canal", "regional", "produto")

# --- fixed values: thresholds ----------------------------------------------
ABC_A = 0.80
ABC_B = 0.95
ABC_A_SHARE_RANGE = (0.75, 0.85)
ABC_A_MAX_CLIENT_SHARE = 0.30
CUMULATIVE_TOLERANCE = 0.001
RISK_CRITICAL = 0.50
RISK_HIGH = 0.35
GAP_TOLERANCE = 0.02
CLOSURE_TOLERANCE = 0.01
DISCOUNT_RANGE = (0.0, 0.25)
INACTIVE_AFTER_MONTHS = 3
TARGET_GROWTH = 0.05
RECENT_MONTHS = 2
PRIOR_MONTHS = 3
TOP_DECLINES = 10
TOP_CLIENTS = 10
TOP_PRODUCTS = 5
PARETO_POINTS = 50
MIN_TRANSACTIONS = 3
LOST_AFTER_MONTHS = 3
DORMANT_AFTER_MONTHS = 12

# --- fixed values: output labels -------------------------------------------
RISK_LABELS = ("CRÍTICO", "ELEVADO", "MODERADO")
GAP_ABOVE, GAP_ON, GAP_BELOW = "Acima", "Na Meta", "Abaixo"
FLAG_YES, FLAG_NO = "SIM", "NAO"
EFFECT_VOLUME, EFFECT_PRICE = "VOLUME", "PREÇO"
LIFE_ACTIVE, LIFE_BACK, LIFE_LOST, LIFE_DORMANT = "Ativo", "Reativado", "Lost", "Inativo"
LIFE_AT_RISK = "Em risco"  # our own name for the first months without recurring billing
DISCOUNT_BANDS = ("0% (sem desconto)", "1-5%", "5-10%", "10-20%", "20%+")
DISCOUNT_BAND_LIMITS = (0.0, 0.05, 0.10, 0.20)
DISCOUNT_COVERED, DISCOUNT_UNCOVERED = "COM desconto calculável", "SEM desconto"
CORRELATION_LIMITS = (0.3, 0.7)
CORRELATION_LABELS = (
    "forte positiva", "moderada positiva", "fraca", "moderada negativa", "forte negativa",
)

# --- fixed values: ABC summary rows (kpi, description), in output order ------
ABC_KPIS = (
    ("clientes_total", "Total de clientes na base"),
    ("receita_total", "Receita total no período (R$)"),
    ("top_10_participacao", "% da receita concentrada nos 10 maiores clientes"),
    ("classe_A_clientes", "Quantidade de clientes Classe A"),
    ("classe_A_participacao", "% da receita gerada pela Classe A"),
    ("classe_A_pct_clientes", "% dos clientes que são Classe A"),
    ("classe_B_clientes", "Quantidade de clientes Classe B"),
    ("classe_B_participacao", "% da receita gerada pela Classe B"),
    ("classe_C_clientes", "Quantidade de clientes Classe C"),
    ("classe_C_participacao", "% da receita gerada pela Classe C"),
)

# --- fixed values: parameter sheet texts -------------------------------------
PARAM_COHORT_DEFINITION = "Mês da primeira compra por cliente"
PARAM_RETENTION_METRIC = "clientes_ativos / clientes_base (M0)"
PARAM_ABC_RULE = "A até 80%, B até 95%, C restante"
PARAM_GAP_GRAIN = "mes_ref × canal × regional × produto"
PARAM_GAP_METHOD = "Efeito Volume + Efeito Preço + Efeito Cruzado (aditivo)"

# --- fixed values: synthetic data (name, weight, base price) -----------------
SYNTH_PRODUCTS = (
    ("Vale Alimentação", 0.22, 620),
    ("Vale Refeição", 0.20, 580),
    ("Vale Combustível", 0.15, 450),
    ("Vale Transporte", 0.10, 320),
    ("Home Office", 0.08, 280),
    ("Gift", 0.07, 200),
    ("Vale Cultura", 0.07, 150),
    ("Vale Saúde", 0.06, 380),
    ("Vale Mobilidade", 0.05, 250),
)
# (channel, weight, smallest quantity, largest quantity, largest extra discount)
SYNTH_CHANNELS = (
    ("PME", 0.40, 1, 10, 0.0),
    ("Corporativo", 0.30, 5, 30, 0.0),
    ("Grandes Contas", 0.18, 20, 80, 0.10),
    ("Setor Público", 0.12, 10, 50, 0.10),
)
SYNTH_REGIONS = (
    ("Norte", 0.08), ("Nordeste", 0.18), ("Centro-Oeste", 0.10), ("Sudeste", 0.42), ("Sul", 0.22),
)
SYNTH_SEASON = {1: 1.03, 2: 0.99, 11: 1.02, 12: 1.02}
SYNTH_BASE_DISCOUNT = (0.0, 0.15)
SYNTH_NOISE_SD = 0.08
SYNTH_COST_RANGE = (0.55, 0.82)
SYNTH_MIN_REVENUE = 30
SYNTH_MIN_COST = 10
SYNTH_TARGET_RANGE = (0.95, 1.08)
SYNTH_FORECAST_RANGE = (0.96, 1.04)
SYNTH_ROWS = 120_000
SYNTH_CLIENTS = 5_000
SYNTH_FIRST_CLIENT = 10_000
SYNTH_SEED = 42
SYNTH_START, SYNTH_END = "2021-01-01", "2026-01-31"
# Names of the tables that the parameter rows refer to.
PARAM_SALES_SOURCE = "base_vendas_historica.csv"
PARAM_TARGET_SOURCE = "forecast_mensal.csv"
