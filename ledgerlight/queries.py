"""Registered queries over the star-schema tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions import fixed, text
from ledgerlight.operators import detection
from ledgerlight.plans.adapters import event_charges, order_charges, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


KEYS = ["service", "category"]
EVENTS = "SELECT user_id::VARCHAR || '/' || event_type AS service, event_id AS id, value AS amount, ts::DATE AS date FROM events"
ORDERS = "SELECT o_custkey::VARCHAR AS service, o_orderkey AS id, o_totalprice AS amount, o_orderdate::DATE AS date FROM orders"
FIT = "greatest(" + ", ".join(f"count(*) FILTER (gap BETWEEN {low} AND {high})" for _, low, high, _ in fixed.CYCLES) + ")"
CYCLE = (
    f"CASE WHEN {FIT} = 0 THEN 30 "
    + " ".join(f"WHEN count(*) FILTER (gap BETWEEN {low} AND {high}) = {FIT} THEN {days}" for _, low, high, days in fixed.CYCLES)
    + " END"
)


def _tiers(source: str) -> str:
    """Judged charges in SQL: prefixes, a recursive walk in order of amount for the tiers, then the baseline of each charge."""
    return f"""
WITH RECURSIVE txn AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY date, id) AS pos FROM ({source})),
pre AS (SELECT c.service, c.pos AS i, h.id, h.amount, h.date, row_number() OVER (PARTITION BY c.service, c.pos ORDER BY h.amount, h.date, h.id) AS rk
  FROM txn c JOIN txn h ON h.service = c.service AND h.pos < c.pos WHERE c.pos >= 3),
walk AS (SELECT service, i, rk, amount AS rep, 1 AS tier FROM pre WHERE rk = 1
  UNION ALL
  SELECT p.service, p.i, p.rk, CASE WHEN w.rep > 0 AND abs(p.amount - w.rep) / w.rep <= 0.3 THEN w.rep ELSE p.amount END,
    CASE WHEN w.rep > 0 AND abs(p.amount - w.rep) / w.rep <= 0.3 THEN w.tier ELSE w.tier + 1 END
  FROM walk w JOIN pre p ON p.service = w.service AND p.i = w.i AND p.rk = w.rk + 1),
item AS (SELECT p.*, w.rep, w.tier FROM pre p JOIN walk w USING (service, i, rk)),
gapped AS (SELECT *, date_diff('day', lag(date) OVER (PARTITION BY service, i, tier ORDER BY date, id), date) AS gap FROM item),
tier AS (SELECT service, i, tier, min(rep) AS rep, median(amount) AS med, count(*) AS n, {FIT} / nullif(count(gap), 0) AS fit FROM gapped GROUP BY ALL),
same AS (SELECT t.service, t.i, min(t.tier) AS tier FROM tier t JOIN txn c ON c.service = t.service AND c.pos = t.i
  WHERE t.rep > 0 AND abs(c.amount - t.rep) / t.rep <= 0.3 GROUP BY ALL),
top AS (SELECT service, i, arg_max(tier, (med, -tier)) AS tier FROM tier WHERE n >= 2 AND fit >= 0.6 GROUP BY ALL),
base AS (SELECT t.service, t.i, t.tier FROM tier t JOIN same s USING (service, i, tier) WHERE n >= 2 AND fit >= 0.6
  UNION ALL SELECT top.* FROM top ANTI JOIN same USING (service, i)),
recent AS (SELECT item.*, row_number() OVER (PARTITION BY service, i ORDER BY date DESC, id DESC) AS back FROM item JOIN base USING (service, i, tier)),
latest AS (SELECT *, date_diff('day', lag(date) OVER (PARTITION BY service, i ORDER BY date, id), date) AS gap FROM recent WHERE back <= 6),
expect AS (SELECT service, i, round(median(amount)::DECIMAL(18, 4), 2)::DOUBLE AS expected, {CYCLE} AS cycle_days FROM latest GROUP BY ALL),
rise AS (SELECT c.service, c.id AS transaction_id, c.amount, e.expected, e.cycle_days, c.amount - e.expected AS diff, (c.amount - e.expected) / e.expected AS pct
  FROM expect e JOIN txn c ON c.service = e.service AND c.pos = e.i WHERE c.amount > e.expected AND e.expected <> 0),
score AS (SELECT *, least(1.0::DOUBLE, pct) * 0.60::DOUBLE + least(1.0::DOUBLE, diff / greatest(expected, 1.0::DOUBLE)) * 0.40::DOUBLE AS score FROM rise WHERE diff >= 5 AND pct >= 0.2::DOUBLE)
"""


RULES = "(VALUES " + ", ".join(f"('{r[0]}', {r[1]}::DOUBLE, {r[2]}::DOUBLE, {r[3]}, {r[4]})" for r in fixed.RULES) + ") r(category, least_diff, least_pct, lookback, seasonal)"
#: Events spread over three years, with the categories in turn.
YEARS = f"SELECT user_id::VARCHAR || '/' || event_type AS service, ({fixed.CATEGORIES})[(user_id % {len(fixed.CATEGORIES)})::INT + 1] AS category, event_id AS id, value AS amount, ts::DATE + ((event_id % 3) * 365)::INT AS date FROM events"


def _by_rules(source: str) -> str:
    """As :func:`_tiers`, with the thresholds, lookbacks and seasons of the categories."""
    head = _tiers(source)
    head = head[: head.index("latest AS (")]
    return head + f"""
ruled AS (SELECT c.service, c.pos AS i, c.id AS now_id, c.amount AS now_amount, c.date AS now_date, r.* FROM txn c JOIN {RULES} USING (category)),
latest AS (SELECT recent.service, recent.i, recent.id, recent.amount, recent.date FROM recent JOIN ruled USING (service, i) WHERE back <= lookback),
season AS (SELECT p.service, p.i, p.id, p.amount, p.date FROM pre p JOIN base USING (service, i) JOIN ruled r ON r.service = p.service AND r.i = p.i
  WHERE r.seasonal AND abs(date_diff('day', p.date, (r.now_date - INTERVAL 1 YEAR)::DATE)) <= 30 AND (p.service, p.i, p.id) NOT IN (SELECT (service, i, id) FROM latest)),
whole AS (SELECT *, date_diff('day', lag(date) OVER (PARTITION BY service, i ORDER BY date), date) AS gap FROM (SELECT * FROM latest UNION ALL SELECT * FROM season)),
expect AS (SELECT service, i, round(median(amount)::DECIMAL(18, 4), 2)::DOUBLE AS expected, {CYCLE} AS cycle_days FROM whole GROUP BY ALL),
rise AS (SELECT service, category, now_id AS transaction_id, now_amount AS amount, expected, cycle_days, now_amount - expected AS diff, (now_amount - expected) / expected AS pct, least_diff, least_pct
  FROM expect JOIN ruled USING (service, i) WHERE now_amount > expected AND expected <> 0),
score AS (SELECT *, least(1.0::DOUBLE, pct) * 0.60::DOUBLE + least(1.0::DOUBLE, diff / greatest(expected, 1.0::DOUBLE)) * 0.40::DOUBLE AS score FROM rise WHERE diff >= least_diff AND pct >= least_pct)
"""


_ALERTS = """SELECT service, transaction_id::VARCHAR AS transaction_id, expected, round(amount, 2) AS actual, round(diff, 2) AS difference, round(pct * 100, 1) AS percentage_change,
  round(score, 3) AS outlier_score, CASE WHEN score >= 0.85 THEN 'high' WHEN score >= 0.65 THEN 'warning' ELSE 'low' END AS severity, cycle_days::INTEGER AS cycle_days
FROM score WHERE score >= 0.4"""
ALERT_COLUMNS = ["service", "transaction_id", "expected", "actual", "difference", "percentage_change", "outlier_score", "severity", "cycle_days"]


@query(_tiers(EVENTS) + _ALERTS)
def recurring_alerts_events(spark, sf_dir: str) -> DataFrame:
    return detection.alerts(event_charges(spark, sf_dir), KEYS).select(*ALERT_COLUMNS)


@query(_by_rules(YEARS) + _ALERTS.replace("SELECT service,", "SELECT service, category,"))
def alerts_by_category(spark, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    names = F.array(*map(F.lit, fixed.CATEGORIES))
    txns = events.select(
        F.concat(F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("service"), F.get(names, (F.col("user_id") % len(fixed.CATEGORIES)).cast("int")).alias("category"),
        F.col("event_id").alias("transaction_id"), F.col("event_id").alias("seq"), F.col("value").alias("amount"), F.date_add(F.to_date("ts"), ((F.col("event_id") % 3) * 365).cast("int")).alias("date"),
    )
    return detection.alerts(txns, KEYS).select("category", *ALERT_COLUMNS)


@query(_tiers(ORDERS) + _ALERTS)
def recurring_alerts_orders(spark, sf_dir: str) -> DataFrame:
    return detection.alerts(order_charges(spark, sf_dir), KEYS).select(*ALERT_COLUMNS)


@query(_tiers(EVENTS) + ", a AS (" + _ALERTS + ") SELECT s.severity, count(a.severity) AS n FROM (VALUES ('high'), ('warning'), ('low')) s(severity) LEFT JOIN a USING (severity) GROUP BY 1")
def severity_counts(spark, sf_dir: str) -> DataFrame:
    from ledgerlight.plans.report import severity_counts as counts

    return counts(detection.alerts(event_charges(spark, sf_dir), KEYS))


_PATTERNS = """
WITH RECURSIVE txn AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY amount, date, id) AS rk FROM (%s)),
walk AS (SELECT service, rk, amount AS rep, 0 AS tier FROM txn WHERE rk = 1
  UNION ALL
  SELECT t.service, t.rk, CASE WHEN w.rep <> 0 AND abs(t.amount - w.rep) / w.rep <= 0.3 THEN w.rep ELSE t.amount END,
    CASE WHEN w.rep <> 0 AND abs(t.amount - w.rep) / w.rep <= 0.3 THEN w.tier ELSE w.tier + 1 END
  FROM walk w JOIN txn t ON t.service = w.service AND t.rk = w.rk + 1),
item AS (SELECT t.*, w.tier, date_diff('day', lag(date) OVER (PARTITION BY service, tier ORDER BY date, id), date) AS gap, median(amount) OVER (PARTITION BY service, tier) AS med FROM txn t JOIN walk w USING (service, rk)),
"""


@query(_PATTERNS % ORDERS + "x AS (SELECT 1) SELECT service, tier, count(*) AS n, round(min(amount), 2) AS least, round(max(amount), 2) AS most FROM item GROUP BY ALL")
def amount_tiers(spark, sf_dir: str) -> DataFrame:
    df = detection.tiered(order_charges(spark, sf_dir), ["service"], positive_only=False).groupBy("service", "tier")
    return df.agg(F.count("*").alias("n"), F.round(F.min("amount"), 2).alias("least"), F.round(F.max("amount"), 2).alias("most"))


@query(
    _PATTERNS % ORDERS
    + f"""p AS (SELECT service, tier, count(*) AS charges, {CYCLE} AS cycle_days, {FIT} / nullif(count(gap), 0) AS fit, any_value(med) AS med, avg(abs(amount - med) / med) AS spread FROM item GROUP BY ALL)
SELECT service, tier, charges, cycle_days, round(fit * 0.45 + greatest(0, 1 - spread) * 0.35 + least(1, charges / 6) * 0.20, 3) AS confidence FROM p WHERE charges >= 2 AND fit >= 0.6"""
)
def recurring_patterns(spark, sf_dir: str) -> DataFrame:
    return detection.recurring_patterns(order_charges(spark, sf_dir), ["service"])


@query(f"SELECT service, id, date_diff('day', lag(date) OVER (PARTITION BY service ORDER BY date, id), date) AS gap FROM ({ORDERS})")
def day_gaps(spark, sf_dir: str) -> DataFrame:
    before = F.lag("date").over(Window.partitionBy("service").orderBy("date", "seq"))
    return order_charges(spark, sf_dir).select("service", F.col("transaction_id").alias("id"), F.datediff("date", before).cast("bigint").alias("gap"))


@query(
    f"""WITH g AS (SELECT service, date_diff('day', lag(date) OVER (PARTITION BY service ORDER BY date, id), date) AS gap FROM ({ORDERS}))
SELECT service, {CYCLE} AS cycle_days, round(coalesce({FIT} / nullif(count(gap), 0), 0), 6) AS fit, count(*) >= 2 AND coalesce({FIT} / nullif(count(gap), 0), 0) >= 0.6 AS recurring FROM g GROUP BY 1"""
)
def best_cycle(spark, sf_dir: str) -> DataFrame:
    df = detection.charges(order_charges(spark, sf_dir), ["service"]).withColumn("days", detection.gaps(F.transform("all", lambda t: t["date"])))
    df = df.withColumn("fit", detection.cycle_fit(F.col("days")))
    return df.select("service", F.col("fit.days").alias("cycle_days"), F.round("fit.fit", 6).alias("fit"), ((F.size("all") >= 2) & (F.col("fit.fit") >= detection.FIT)).alias("recurring"))


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY date DESC, id DESC) AS k FROM ({ORDERS})) SELECT service, round(median(amount), 4) AS expected FROM r WHERE k <= 6 GROUP BY 1")
def median_last_k(spark, sf_dir: str) -> DataFrame:
    from ledgerlight.operators.prediction import median_of_last

    return median_of_last(order_charges(spark, sf_dir), ["service"], 6).select("service", F.round("expected", 4).alias("expected"))


@query(f"SELECT a.service, a.id, count(b.id) AS n, round(median(b.amount), 4) AS season FROM ({ORDERS}) a JOIN ({ORDERS}) b ON a.service = b.service AND (b.date, b.id) < (a.date, a.id) AND abs(date_diff('day', b.date, (a.date - INTERVAL 1 YEAR)::DATE)) <= 30 GROUP BY ALL")
def seasonal_reference(spark, sf_dir: str) -> DataFrame:
    from ledgerlight.operators.prediction import seasonal

    return seasonal(order_charges(spark, sf_dir), ["service"]).select("service", F.col("transaction_id").alias("id"), "n", F.round("season", 4).alias("season"))


_RISES = "SELECT o_orderkey, o_totalprice AS a, median(o_totalprice) OVER (PARTITION BY o_custkey) AS e FROM orders"


@query(
    f"""WITH x AS ({_RISES}), y AS (SELECT *, a - e AS d, (a - e) / e AS p, CASE WHEN e < 20 THEN 3 WHEN e < 100 THEN 10 ELSE 25 END AS td, CASE WHEN e < 20 THEN 0.2 WHEN e < 100 THEN 0.15 ELSE 0.1 END::DOUBLE AS tp FROM x),
z AS (SELECT *, least(1.0::DOUBLE, p) * 0.6::DOUBLE + least(1.0::DOUBLE, d / greatest(e, 1.0::DOUBLE)) * 0.4::DOUBLE AS s FROM y WHERE d >= td AND p >= tp)
SELECT o_orderkey, round(s, 3) AS outlier_score, CASE WHEN s >= 0.85 THEN 'high' WHEN s >= 0.65 THEN 'warning' WHEN s >= 0.4 THEN 'low' ELSE 'none' END AS severity FROM z"""
)
def universal_thresholds(spark, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    middle = orders.groupBy("o_custkey").agg(F.median("o_totalprice").alias("e"))
    df = orders.join(middle, "o_custkey").withColumn("d", F.col("o_totalprice") - F.col("e")).withColumn("p", F.col("d") / F.col("e"))
    least, share = detection.universal_thresholds(F.col("e"))
    score = detection.outlier_score(F.col("d"), F.col("p"), F.col("e"))
    return df.filter((F.col("d") >= least) & (F.col("p") >= share)).select("o_orderkey", F.round(score, 3).alias("outlier_score"), detection.severity(score).alias("severity"))


@query(
    "WITH r AS (SELECT c_mktsegment, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) SELECT c_mktsegment, k, c_custkey, c_acctbal FROM r WHERE k <= 3"
)
def top_candidates(spark, sf_dir: str) -> DataFrame:
    from ledgerlight.operators.resolution import top_n

    return top_n(table(spark, sf_dir, "customer"), ["c_mktsegment"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 3).select("c_mktsegment", F.col("rank").alias("k"), "c_custkey", "c_acctbal")


_NAMES = "(SELECT p_partkey AS id, p_name AS raw FROM part UNION ALL SELECT c_custkey + 10000000, c_name || ' #' || c_custkey || ' 866-579-7172 CA' FROM customer UNION ALL SELECT s_suppkey + 20000000, s_name || '.com *X' || s_suppkey || ' Inc' FROM supplier)"


def _names(spark, sf_dir: str) -> DataFrame:
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return (
        table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("id"), F.col("p_name").alias("raw"))
        .union(customer.select(F.col("c_custkey") + 10000000, F.concat("c_name", F.lit(" #"), F.col("c_custkey").cast("string"), F.lit(" 866-579-7172 CA"))))
        .union(supplier.select(F.col("s_suppkey") + 20000000, F.concat("s_name", F.lit(".com *X"), F.col("s_suppkey").cast("string"), F.lit(" Inc"))))
    )


def _clean_sql(x: str) -> str:
    """The strip patterns for an engine without look-ahead: spaces are doubled where one must be seen twice."""
    out = f"lower({x})"
    for pattern in fixed.STRIP:
        if "(?=" in pattern:
            out = rf"regexp_replace(replace({out}, ' ', '  '), '\b[a-z]{{2}}(\s|$)', ' ', 'g')"
        else:
            out = f"regexp_replace({out}, '{pattern}', ' ', 'gi')"
    out = rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"
    out = f"regexp_replace({out}, '{fixed.DOMAIN_ENDINGS}', ' ', 'g')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


@query(f"SELECT id, {_clean_sql('raw')} AS cleaned FROM {_NAMES}")
def clean_names(spark, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("id", text.cleaned(F.col("raw")).alias("cleaned"))


@query(rf"SELECT id, array_to_string(list_transform(regexp_extract_all({_clean_sql('raw')}, '([a-z]+|[^a-z]+)'), lambda x: upper(x[1]) || x[2:]), '') AS name FROM {_NAMES}")
def title_names(spark, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("id", text.normalized(F.col("raw")).alias("name"))


#: Characters and what decomposing and cleaning leave of them.
_DECOMPOSED = {"é": "e ", "Ü": "u ", "ﬁ": "fi", "Ａ": "a", "ñ": "n "}
_FOREIGN = "Crédit ﬁn Ａ&Ü Señor "


def _decomposed_sql(x: str) -> str:
    for k, v in _DECOMPOSED.items():
        x = f"replace({x}, '{k}', '{v}')"
    return x


@query(f"SELECT id, cleaned, CASE WHEN contains(cleaned, '&') THEN upper(cleaned) END AS name FROM (SELECT id, {_clean_sql(_decomposed_sql(f"'{_FOREIGN}' || raw"))} AS cleaned FROM {_NAMES})")
def clean_names_any(spark, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(_FOREIGN), F.col("raw"))
    return _names(spark, sf_dir).select("id", text.cleaned_any(raw).alias("cleaned"), text.normalized(raw).alias("name"))


_KEYWORD_SQL = "CASE " + " ".join(f"WHEN regexp_matches(%s, '(?i){p}') THEN '{c}'" for p, c in fixed.KEYWORDS) + " ELSE 'general' END"


@query("SELECT doc_id, " + _KEYWORD_SQL.replace("%s", "text") + " AS category FROM documents")
def classify_keywords(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.keyword_category(F.coalesce("text", F.lit(""))).alias("category"))


_MCC_CODE = "(ARRAY['4812','4899','4900','5045','5945','8011','9999'])[p_size % 7 + 1]"


@query(
    f"""SELECT p_partkey, coalesce(m.category, {_KEYWORD_SQL.replace('%s', 'p_name')}) AS category
FROM part LEFT JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in fixed.MCC.items())}) m(code, category) ON m.code = {_MCC_CODE}"""
)
def classify_codes(spark, sf_dir: str) -> DataFrame:
    code = F.get(F.array(*[F.lit(x) for x in ("4812", "4899", "4900", "5045", "5945", "8011", "9999")]), F.col("p_size") % 7)
    return table(spark, sf_dir, "part").select("p_partkey", text.category(F.col("p_name"), code).alias("category"))


@query(
    f"""SELECT p_partkey, r.least_diff, r.least_pct, r.lookback FROM (SELECT p_partkey, {_KEYWORD_SQL.replace('%s', 'p_name')} AS category FROM part)
JOIN (VALUES {', '.join(f"('{r[0]}', {r[1]}::DOUBLE, {r[2]}::DOUBLE, {r[3]})" for r in fixed.RULES)}) r(category, least_diff, least_pct, lookback) USING (category)"""
)
def rule_lookup(spark, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", text.keyword_category(F.col("p_name")).alias("category"))
    return parts.join(F.broadcast(detection.rules(spark)), "category").select("p_partkey", "least_diff", "least_pct", "lookback")


@query(
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k, min(event_id) OVER (PARTITION BY user_id, event_type) AS first_id FROM events) SELECT user_id, event_type, event_id, value, first_id FROM r WHERE k = 1"
)
def dedupe_keep_last(spark, sf_dir: str) -> DataFrame:
    from ledgerlight.operators.registry import keep_last

    df = table(spark, sf_dir, "events")
    kept = keep_last(df, ["user_id", "event_type"], ["ts", "event_id"], "event_id")
    return kept.select("user_id", "event_type", "event_id", "value", F.col("first").alias("first_id"))


_DATE_TEXT = "(CASE o_orderkey % 8 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 3 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 4 THEN strftime(o_orderdate, '%m-%d-%Y') WHEN 5 THEN strftime(o_orderdate, '%Y%m%d') WHEN 6 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') ELSE 'soon' END)"


@query(
    f"""WITH t AS (SELECT o_orderkey, split_part({_DATE_TEXT}, 'T', 1) AS d FROM orders)
SELECT o_orderkey, coalesce(try_strptime(d, '%Y-%m-%d'), try_strptime(d, '%m/%d/%Y'), try_strptime(d, '%d/%m/%Y'), try_strptime(d, '%Y/%m/%d'), try_strptime(d, '%m-%d-%Y'), try_strptime(d, '%d-%m-%Y'), try_strptime(d, '%Y%m%d'))::DATE AS date FROM t"""
)
def parse_dates(spark, sf_dir: str) -> DataFrame:
    forms = ["yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "MM-dd-yyyy", "yyyyMMdd", "yyyy-MM-dd'T'HH:mm:ss"]
    written = F
    for k, form in enumerate(forms):
        written = written.when(F.col("o_orderkey") % 8 == k, F.date_format("o_orderdate", form))
    df = table(spark, sf_dir, "orders").select("o_orderkey", written.otherwise("soon").alias("d"))
    return df.select("o_orderkey", text.parsed_date(F.col("d")).alias("date"))


@query(
    "SELECT o_orderkey, try_cast(replace(replace(trim(t), ',', ''), '$', '') AS DOUBLE) AS amount FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' $' || o_totalprice WHEN 1 THEN o_totalprice::VARCHAR WHEN 2 THEN '1,' || o_orderkey || '.50' ELSE 'free' END AS t FROM orders)"
)
def parse_amounts(spark, sf_dir: str) -> DataFrame:
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("string")
    written = F.when(key % 4 == 0, F.concat(F.lit(" $"), price)).when(key % 4 == 1, price).when(key % 4 == 2, F.concat(F.lit("1,"), key.cast("string"), F.lit(".50"))).otherwise("free")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.parsed_amount(written).alias("amount"))




_FEEDBACK = "SELECT user_id, CASE event_type WHEN 'purchase' THEN 'expected' WHEN 'view' THEN 'expected' WHEN 'click' THEN 'expected' WHEN 'error' THEN 'unexpected' WHEN 'signup' THEN 'cancel' ELSE 'remind_later' END AS f, event_id FROM events"
_TOLERANCE = f"""SELECT user_id, round(list_reduce(list_prepend(1.0::DOUBLE, list(CASE f WHEN 'expected' THEN 0.25::DOUBLE WHEN 'unexpected' THEN -0.15::DOUBLE WHEN 'cancel' THEN -0.15::DOUBLE ELSE 0::DOUBLE END ORDER BY event_id)),
  lambda m, d: CASE WHEN d > 0 THEN least(m + d, 3.0::DOUBLE) WHEN d < 0 THEN greatest(m + d, 1.0::DOUBLE) ELSE m END), 3) AS multiplier FROM ({_FEEDBACK}) GROUP BY 1"""


def _feedback(spark, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("purchase", "view", "click"), "expected").when(F.col("event_type") == "error", "unexpected").when(F.col("event_type") == "signup", "cancel")
    return table(spark, sf_dir, "events").select("user_id", kind.otherwise("remind_later").alias("feedback"), F.col("event_id").alias("seq"))


@query(_TOLERANCE)
def feedback_multiplier(spark, sf_dir: str) -> DataFrame:
    from ledgerlight.operators.feedback import tolerances

    return tolerances(_feedback(spark, sf_dir), "user_id")


@query(
    _tiers(EVENTS) + f", a AS ({_ALERTS}), m AS ({_TOLERANCE}), j AS (SELECT a.*, m.multiplier, m.multiplier > 1 AS up FROM a JOIN m ON m.user_id = split_part(a.service, '/', 1)::BIGINT) "
    "SELECT transaction_id, CASE WHEN up THEN round((outlier_score / multiplier)::DECIMAL(18, 9), 3)::DOUBLE ELSE outlier_score END AS outlier_score, up AS feedback_adjusted, "
    "CASE WHEN NOT up THEN severity WHEN outlier_score / multiplier >= 0.85 THEN 'high' WHEN outlier_score / multiplier >= 0.65 THEN 'warning' WHEN outlier_score / multiplier >= 0.4 THEN 'low' ELSE 'none' END AS severity FROM j"
)
def feedback_adjust(spark, sf_dir: str) -> DataFrame:
    from ledgerlight.operators.feedback import adjusted

    found = detection.alerts(event_charges(spark, sf_dir), KEYS).withColumn("user_id", F.substring_index("service", "/", 1).cast("bigint"))
    return adjusted(found, _feedback(spark, sf_dir), "user_id").select("transaction_id", "outlier_score", "feedback_adjusted", "severity")


_ALIASES = "(VALUES " + ", ".join(f"({k}, '{a}')" for k, (_, _, aliases) in enumerate(fixed.SEEDS) for a in aliases) + ") v(service_ord, alias)"


@query(f"SELECT p_partkey, min(service_ord) AS service_ord FROM (SELECT p_partkey, (ARRAY['netflix', 'pg e', 'office 365', 'state farm', 'nobody'])[p_size % 5 + 1] AS cleaned FROM part) JOIN {_ALIASES} ON alias = cleaned GROUP BY 1")
def alias_exact_join(spark, sf_dir: str) -> DataFrame:
    from ledgerlight.operators import registry, resolution

    name = F.get(F.array(*[F.lit(x) for x in ("netflix", "pg e", "office 365", "state farm", "nobody")]), F.col("p_size") % 5)
    parts = table(spark, sf_dir, "part").select("p_partkey", name.alias("cleaned"))
    return resolution.exact(parts, registry.seeds(spark)).select("p_partkey", "service_ord")


@query(
    "SELECT o_custkey, count(*) AS n, min(o_orderdate)::DATE AS first_seen, max(o_orderdate)::DATE AS last_seen FROM orders GROUP BY 1"
)
def registry_bump(spark, sf_dir: str) -> DataFrame:
    from ledgerlight.operators import registry

    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("service_ord"), F.col("c_custkey").cast("string").alias("canonical_name"), F.lit("general").alias("category"), F.array().cast("array<string>").alias("aliases"))
    services = registry.registered(customers)
    sightings = table(spark, sf_dir, "orders").select(registry.service_id(F.col("o_custkey").cast("string")).alias("service_id"), F.to_date("o_orderdate").alias("date"))
    return registry.seen(services, sightings).filter("transaction_count > 0").select(F.col("service_ord").alias("o_custkey"), F.col("transaction_count").alias("n"), "first_seen", "last_seen")


@query("SELECT c_nationkey * 2 AS service_ord, count(*) AS aliases, sum(c_custkey) AS n FROM customer GROUP BY 1")
def registry_merge(spark, sf_dir: str) -> DataFrame:
    from ledgerlight.operators import registry

    customer = table(spark, sf_dir, "customer").withColumn("k", F.col("c_nationkey") * 2 + F.col("c_custkey") % 2)
    rows = customer.groupBy("k").agg(F.collect_list(F.lower("c_name")).alias("aliases"), F.sum("c_custkey").alias("n"))
    services = registry.registered(rows.select(F.col("k").alias("service_ord"), F.col("k").cast("string").alias("canonical_name"), F.lit("general").alias("category"), "aliases"))
    services = services.join(rows.select(F.col("k").alias("service_ord"), "n"), "service_ord").withColumn("transaction_count", F.col("n")).drop("n").select(services.columns)
    pairs = spark.range(25).select(registry.service_id((F.col("id") * 2).cast("string")).alias("keep"), registry.service_id((F.col("id") * 2 + 1).cast("string")).alias("drop"))
    return registry.merged(services, pairs).select("service_ord", F.size("aliases").cast("bigint").alias("aliases"), F.col("transaction_count").alias("n"))


@query("SELECT canonical_name, coalesce(m.source, 'manual') AS source FROM (VALUES " + ", ".join(f"('{s[0]}')" for s in fixed.SEEDS) + ") s(canonical_name) LEFT JOIN (VALUES ('Netflix', 'auto'), ('Hulu', 'auto')) m(name, source) ON m.name = canonical_name")
def registry_seed(spark, sf_dir: str) -> DataFrame:
    from ledgerlight.operators import registry

    known = spark.createDataFrame([(0, "Netflix", "streaming", ["netflix"]), (1, "Hulu", "streaming", ["hulu"])], "service_ord long, canonical_name string, category string, aliases array<string>")
    return registry.with_missing_seeds(registry.registered(known)).select("canonical_name", "source")


@query(
    "WITH s AS (SELECT s_suppkey::INT AS num, s_name AS provider FROM supplier WHERE s_suppkey <= 50), n AS (SELECT s_name AS provider FROM supplier WHERE s_suppkey > 40) "
    "SELECT num, provider FROM s UNION ALL SELECT (50 + row_number() OVER (ORDER BY lower(replace(provider, '#', ' #'))))::INT, provider FROM n WHERE provider NOT IN (SELECT provider FROM s)"
)
def guide_upsert(spark, sf_dir: str) -> DataFrame:
    from ledgerlight.operators.registry import upserted

    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("#"), F.translate("s_name", "#0123456789", " abcdefghij").alias("Provider"), "s_name")
    done = upserted(supplier.filter("`#` <= 50"), supplier.filter("`#` > 40").drop("#"))
    return done.select(F.col("#").alias("num"), F.col("s_name").alias("provider"))


_GRAMS = r"""
words AS (SELECT name, ' ' || unnest(list_filter(regexp_split_to_array(lower(trim(name)), '\s+'), lambda x: x <> '')) || ' ' AS w FROM n),
grams AS (SELECT name, unnest(flatten(list_transform([2, 3, 4], lambda k: CASE WHEN k = 2 OR length(w) >= k THEN list_transform(range(1, greatest(length(w) - k + 1, 1) + 1), lambda j: substr(w, j::INT, k)) ELSE []::VARCHAR[] END))) AS gram FROM words),
tf AS (SELECT name, gram, count(*) AS tf FROM grams GROUP BY ALL),
weighted AS (SELECT name, gram, tf * (ln((1 + (SELECT count(*) FROM n)) / (1 + count(*) OVER (PARTITION BY gram))) + 1) AS w FROM tf),
vectors AS (SELECT name, gram, w / sqrt(sum(w * w) OVER (PARTITION BY name)) AS weight FROM weighted)
"""


@query("WITH n AS (SELECT DISTINCT p_name AS name FROM part)," + _GRAMS + "SELECT name AS p_name, gram, round(weight, 6) AS weight FROM vectors")
def tfidf_char_wb(spark, sf_dir: str) -> DataFrame:
    from ledgerlight.functions.similarity import tfidf

    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return tfidf(names, "p_name", "p_name").select("p_name", "gram", F.round("weight", 6).alias("weight"))


@query(
    "WITH RECURSIVE n AS (SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1)," + _GRAMS
    + r""", edges AS (SELECT a.name AS a, b.name AS b FROM vectors a JOIN vectors b USING (gram) WHERE a.name <> b.name GROUP BY ALL HAVING sum(a.weight * b.weight) >= 0.6 - 1e-9),
reach AS (SELECT name, name AS other FROM n UNION SELECT r.name, e.b FROM reach r JOIN edges e ON e.a = r.other),
c AS (SELECT name, min(other) AS cluster FROM reach GROUP BY 1), s AS (SELECT *, sum(n) OVER (PARTITION BY cluster) AS size, first_value(name) OVER (PARTITION BY cluster ORDER BY n DESC, length(name), name) AS chosen FROM c JOIN n USING (name))
SELECT name, cluster, CASE WHEN contains(chosen, '&') THEN upper(chosen) ELSE array_to_string(list_transform(regexp_extract_all(lower(chosen), '([a-z]+|[^a-z]+)'), lambda x: upper(x[1]) || x[2:]), '') END AS canonical, size::BIGINT AS size FROM s"""
)
def connected_clusters(spark, sf_dir: str) -> DataFrame:
    from ledgerlight.operators.resolution import clustered

    return clustered(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")))


@query()
def similarity_top3(spark, sf_dir: str) -> DataFrame:
    from ledgerlight.operators import registry, resolution

    names = table(spark, sf_dir, "part").select(text.cleaned(F.col("p_name")).alias("cleaned")).distinct()
    return resolution.candidates(names, registry.seeds(spark))


@query(
    f"""WITH n AS (SELECT DISTINCT p_name, {_clean_sql('p_name')} AS c FROM part), a AS (SELECT service_ord, alias, {_clean_sql('alias')} AS a FROM {_ALIASES}),
s AS (SELECT p_name, alias, CASE WHEN c = a THEN 1.0 WHEN contains(c, a) THEN 0.92 WHEN contains(a, c) THEN 0.86 WHEN len(list_filter(string_split(a, ' '), lambda w: NOT list_contains(string_split(c, ' '), w))) = 0 THEN 0.82 ELSE 0 END AS score FROM n, a WHERE c <> '' AND a <> '')
SELECT p_name, alias, score::DOUBLE AS score FROM s WHERE score > 0"""
)
def guide_match_score(spark, sf_dir: str) -> DataFrame:
    from ledgerlight.operators import guidance, registry

    guides = registry.seeds(spark).select(F.lit(1).alias("priority"), F.col("service_ord").alias("ord"), "aliases")
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    return guidance.matches(names, guides).select(F.col("name").alias("p_name"), "alias", "score")


def _guides_sql() -> str:
    from ledgerlight.operators import guidance as g

    text_of = lambda x: "'" + x.replace("'", "''") + "'"
    lines = lambda xs: "\n".join(xs)
    numbers = lambda xs: lines(f"{k}. {x}" for k, x in enumerate(xs, 1))
    rows = ", ".join(
        "(" + ", ".join([str(k), str(j), *map(text_of, (name, alias, manage, source, f"Type: {name}\nDirect link: {manage}\n\nWorkflow:\n{numbers(steps)}\n\nWatch-out:\n" + lines(f"- {x}" for x in notes), lines(steps), lines(notes)))]) + ")"
        for k, (name, aliases, manage, source, steps, notes) in enumerate(g.BUILT_IN)
        for j, alias in enumerate(aliases)
    )
    search = "'https://www.google.com/search?q=' || replace(replace(replace(url_encode(trim(n.name) || ' official cancel subscription'), '%20', '+'), '*', '%2A'), '%7E', '~')"
    title = "array_to_string(list_transform(regexp_extract_all(lower(trim(n.name)), '([a-z]+|[^a-z]+)'), lambda x: upper(x[1]) || x[2:]), '')"
    tail = f"\n\nWorkflow:\n{numbers(g.FALLBACK_STEPS)}\n\nWatch-out:\n{g.FALLBACK_WATCH}"
    return f"""WITH n AS (SELECT name, {_clean_sql('name')} AS c FROM (SELECT DISTINCT p_name AS name FROM part UNION SELECT s_name || ' ' || (ARRAY['canva', 'google youtube', 'spot', '365 office'])[s_suppkey % 4 + 1] FROM supplier)),
g AS (SELECT *, {_clean_sql('alias')} AS a FROM (VALUES {rows}) v(ord, place, service, alias, manage, source, process, steps, notes)),
m AS (SELECT n.name, g.*, CASE WHEN c = a THEN 1.0 WHEN contains(c, a) THEN 0.92 WHEN contains(a, c) THEN 0.86 WHEN len(list_filter(string_split(a, ' '), lambda w: NOT list_contains(string_split(c, ' '), w))) = 0 THEN 0.82 ELSE 0 END AS score FROM n, g WHERE c <> ''),
b AS (SELECT * FROM m WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, ord, place) = 1)
SELECT n.name, coalesce(service, {title}) AS service_name, coalesce(alias, trim(n.name)) AS matched_name, coalesce(score, 0)::DOUBLE AS confidence, CASE WHEN score IS NULL THEN 'web_search' ELSE 'built_in_database' END AS source,
coalesce(manage, '') AS manage_url, coalesce(b.source, '') AS source_url, {search} AS search_url, CASE WHEN score IS NULL THEN 'general' ELSE '' END AS category, coalesce(manage, '') AS website,
coalesce(process, {text_of(g.FALLBACK_HEAD + chr(10) + 'Web search: ')} || {search} || {text_of(tail)}) AS cancellation_process, coalesce(b.source, {search}) AS additional_resources,
coalesce(steps, {text_of(lines(g.FALLBACK_STEPS))}) AS steps, coalesce(notes, {text_of('Detected category: general.' + chr(10) + g.FALLBACK_NOTE)}) AS notes FROM n LEFT JOIN b USING (name)"""


@query(_guides_sql())
def guide_best(spark, sf_dir: str) -> DataFrame:
    from ledgerlight.operators import guidance

    ends = F.array(*map(F.lit, ("canva", "google youtube", "spot", "365 office")))
    more = table(spark, sf_dir, "supplier").select(F.concat("s_name", F.lit(" "), F.get(ends, (F.col("s_suppkey") % 4).cast("int"))).alias("name"))
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).union(more).distinct().withColumn("category", F.lit("general"))
    found = guidance.guide(names, guidance.built_in(spark)).drop("market_position", "price_range", "billing_cycle")
    return found.withColumns({c: F.array_join(c, "\n") for c in ("steps", "notes")})


_DEMO = [("t013", "Adobe", 19.99, 1.0, "high"), ("t023", "Canva", 12.99, 1.0, "high"), ("t037", "Apple", 9.99, 0.501, "low"), ("t053", "Verizon", 86.0, 0.686, "warning"), ("t063", "PG&E", 92.0, 1.0, "high"), ("t073", "GitHub", 4.0, 1.0, "high")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{n}', {e}::DOUBLE, {s}::DOUBLE, '{v}')" for i, n, e, s, v in _DEMO) + ") v(transaction_id, canonical_name, expected, outlier_score, severity)")
def demo_alerts(spark, sf_dir: str) -> DataFrame:
    from ledgerlight.plans import report
    from ledgerlight.sources import demo

    return report.analyze(demo.charges(spark))["alerts"].select("transaction_id", "canonical_name", "expected", "outlier_score", "severity")


@query(
    "SELECT page_id, 'https://www.google.com/search?q=' || replace(replace(replace(url_encode(url || ' official cancel subscription'), '%20', '+'), '*', '%2A'), '%7E', '~') AS search_url, "
    r"rtrim(regexp_extract(html, 'https?://[^\s)>\]]+'), '.,;') AS first_url, CASE WHEN regexp_matches(trim(url), '^https?://') THEN trim(url) WHEN contains(url, '.') THEN 'https://' || trim(url) ELSE '' END AS site_url FROM pages"
)
def guide_links(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text.search_url(F.col("url")).alias("search_url"), text.first_url(F.col("html")).alias("first_url"), text.site_url(F.col("url")).alias("site_url"))


def _html_sql() -> str:
    from ledgerlight.sources.receipts import ENTITIES, LINE_STEPS, PAGE_STEPS

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    out = "coalesce(html, '')"
    for pattern, new in PAGE_STEPS:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(new)}, 'g')"
    for entity, plain in ENTITIES:
        out = f"replace({out}, {quoted(entity)}, {quoted(plain)})"
    for pattern, new in LINE_STEPS:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(new)}, 'g')"
    return f"SELECT page_id, trim({out}) AS text FROM pages"


@query(_html_sql())
def html_text(spark, sf_dir: str) -> DataFrame:
    from ledgerlight.sources.receipts import html_text as visible

    return table(spark, sf_dir, "pages").select("page_id", visible(F.col("html")).alias("text"))


def _links_sql() -> str:
    from ledgerlight.sources.receipts import LINK, LINK_WORDS

    found = lambda k: f"regexp_extract_all(html, '{LINK.replace(chr(39), chr(39) * 2)}', {k})"
    return rf"""WITH a AS (SELECT page_id, unnest({found(1)}) AS url, unnest({found(2)}) AS raw, generate_subscripts({found(1)}, 1) AS k FROM pages),
l AS (SELECT page_id, k, trim(url) AS url, coalesce(nullif(trim(regexp_replace(regexp_replace(raw, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), ''), url) AS label FROM a),
w AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY k) AS nth FROM l WHERE url <> '' AND regexp_matches(lower(label || ' ' || url), '{'|'.join(LINK_WORDS)}')),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) AS place FROM w WHERE nth = 1)
SELECT page_id, coalesce(string_agg(label || ' <' || url || '>', chr(10) ORDER BY place) FILTER (place <= 8), '') AS links FROM (SELECT page_id FROM pages) LEFT JOIN f USING (page_id) GROUP BY 1"""


@query(_links_sql())
def action_links(spark, sf_dir: str) -> DataFrame:
    from ledgerlight.sources.receipts import action_links as links

    written = F.transform(links(F.col("html")), lambda x: F.concat(x["label"], F.lit(" <"), x["url"], F.lit(">")))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(written, "\n").alias("links"))


_FEATURES = f"""WITH h AS (SELECT *, o_totalprice AS x, row_number() OVER w AS k, o_custkey % 14 AS category_index, 5 + 40 * (o_custkey % 11) AS cycle_days FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, o_orderkey DESC)),
f AS (SELECT o_custkey, count(*) AS n, max(x) AS most, min(x) AS least, median(x) AS median, avg(x) AS mean, coalesce(stddev_pop(x), 0) AS std, max(x) FILTER (k = 1) AS last, coalesce(max(x) FILTER (k = 2), max(x) FILTER (k = 1)) AS second_last,
  CASE WHEN count(*) < 2 THEN 0 ELSE regr_slope(x, -k) FILTER (k <= 6) END AS raw, any_value(category_index) AS category_index, any_value(cycle_days) AS cycle_days, date_diff('day', max(o_orderdate)::DATE, DATE '1999-01-01') AS gap FROM h GROUP BY 1)
SELECT o_custkey, n, most, least, round(median, 6) AS median, round(mean, 7) AS mean, round(std, 5) AS std, round(last, 2) AS last, round(second_last, 2) AS second_last, round(least(std / median, 5), 6) AS cv, round((last - second_last) / second_last, 6) AS last_delta,
  round(raw / median, 6) AS slope, least(n, 12)::DOUBLE AS n_obs, list_position(list_transform({[c[-1] for c in fixed.CYCLES]}, lambda d: abs(cycle_days - d)), list_min(list_transform({[c[-1] for c in fixed.CYCLES]}, lambda d: abs(cycle_days - d))))::DOUBLE - 1 AS cycle,
  category_index::DOUBLE AS category_index, least(gap, 400)::DOUBLE AS days FROM f"""


@query(_FEATURES)
def features_14(spark, sf_dir: str) -> DataFrame:
    from ledgerlight.operators.prediction import features

    names = F.array(*map(F.lit, fixed.CATEGORIES))
    key = F.col("service").cast("bigint")
    txns = order_charges(spark, sf_dir).drop("category")
    last = txns.groupBy("service").agg(F.datediff(F.lit("1999-01-01").cast("date"), F.max("date")).alias("gap"))
    txns = txns.join(last, "service").withColumn("category", F.get(names, (key % 14).cast("int"))).withColumn("cycle_days", 5 + 40 * (key % 11))
    df = features(txns, ["service", "category", "gap", "cycle_days"], F.col("cycle_days"), F.col("gap"))
    r = lambda c, n: F.round(c, n).alias(c)
    return df.select(key.alias("o_custkey"), "n", "most", "least", r("median", 6), r("mean", 7), r("std", 5), r("last", 2), r("second_last", 2), r("cv", 6), r("last_delta", 6), r("slope", 6), "n_obs", "cycle", "category_index", "days")


@query()
def ml_predict(spark, sf_dir: str) -> DataFrame:
    from ledgerlight.operators.prediction import AmountModel, features

    return AmountModel(spark).predict(features(order_charges(spark, sf_dir), ["service"]))


@query(
    _tiers(EVENTS) + f", a AS ({_ALERTS}), m AS ({_TOLERANCE}), d AS (SELECT a.*, e.ts::DATE AS date, e.event_id, multiplier FROM a JOIN events e ON e.event_id = a.transaction_id::BIGINT JOIN m ON m.user_id = e.user_id), "
    "j AS (SELECT *, CASE WHEN multiplier <= 1 THEN severity WHEN outlier_score / multiplier >= 0.85 THEN 'high' WHEN outlier_score / multiplier >= 0.65 THEN 'warning' WHEN outlier_score / multiplier >= 0.4 THEN 'low' END AS later FROM d), "
    "b AS (SELECT service, arg_max(severity, (date, event_id)) AS before FROM j GROUP BY 1), c AS (SELECT service, arg_max(later, (date, event_id)) AS after FROM j WHERE later IS NOT NULL GROUP BY 1) "
    "SELECT service, before, coalesce(after, 'suppressed') AS after FROM b LEFT JOIN c USING (service)"
)
def before_after(spark, sf_dir: str) -> DataFrame:
    from ledgerlight.operators.feedback import adjusted
    from ledgerlight.plans.report import compared

    before = detection.alerts(event_charges(spark, sf_dir), KEYS).withColumn("user_id", F.substring_index("service", "/", 1).cast("bigint"))
    after = adjusted(before, _feedback(spark, sf_dir), "user_id").filter("severity <> 'none'")
    return compared(before, after, "service")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, event_type, (props->>'k')::BIGINT AS k FROM events")
def json_roundtrip(spark, sf_dir: str) -> DataFrame:
    from ledgerlight.sources import sinks

    events = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("date"), "event_type", F.from_json("props", "k bigint").alias("props"))
    read = F.from_json("json", "event_id bigint, date string, event_type string, props struct<k:bigint>")
    return sinks.json_rows(sinks.records(events)).select(read.alias("r")).select("r.event_id", "r.date", "r.event_type", "r.props.k")


@query("SELECT o_orderkey, [round((o_totalprice / 2)::DECIMAL(18, 4), 2)::DOUBLE, 1.05::DOUBLE, 3.45::DOUBLE, round(o_totalprice::DECIMAL(18, 4), 2)::DOUBLE] AS amounts FROM orders")
def money_extract(spark, sf_dir: str) -> DataFrame:
    from ledgerlight.sources.receipts import money

    price = F.col("o_totalprice")
    written = F.format_string("Order 17 of 2024-01-31\nSubtotal $%,.2f\nTax 1.05 USD and 3.456 or .5\nTotal charged US$ %.2f", F.round(F.round(price / 2, 4), 2), price)
    return table(spark, sf_dir, "orders").select("o_orderkey", money(written).alias("amounts"))


_REASON_LIST = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.CATEGORY_REASONS.items()) + f" ELSE {fixed.OTHER_REASONS} END"
_CHECK_LIST = "CASE category " + " ".join(f"WHEN '{r[0]}' THEN {[fixed.CHECK_REASONS[c] for c in r[6]]}" for r in fixed.RULES if r[6]) + " ELSE []::VARCHAR[] END"


@query(
    f"""WITH c AS (SELECT p_partkey, p_size, {_KEYWORD_SQL.replace('%s', 'p_name')} AS category FROM part), b AS (SELECT *, {_REASON_LIST} AS base, {_CHECK_LIST} AS more FROM c)
SELECT p_partkey, array_to_string(list_concat(CASE WHEN p_size >= 25 THEN ['{fixed.DOUBLED_REASON}'] ELSE []::VARCHAR[] END, list_concat(base, list_filter(more, lambda x: NOT list_contains(base, x)))), '; ') AS reasons FROM b"""
)
def reasons(spark, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", text.keyword_category(F.col("p_name")).alias("category"))
    df = parts.join(F.broadcast(detection.rules(spark)), "category")
    return df.select("p_partkey", F.concat_ws("; ", detection.reasons(F.col("p_size") / 25, F.col("category"), F.col("extra_checks"))).alias("reasons"))


_RAW = "SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE 'payee ' || o_custkey END AS payee, CASE WHEN o_orderkey % 5 = 0 THEN 'free' WHEN o_orderkey % 5 = 1 THEN '' ELSE '7.25' END AS charge, CASE WHEN o_orderkey % 3 = 0 THEN 'soon' ELSE '2024-01-31' END AS posted_date FROM orders"


def _raw(spark, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("seq"), F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit("payee "), F.col("o_custkey").cast("string"))).alias("Payee"),
        F.when(k % 5 == 0, "free").when(k % 5 == 1, "").otherwise("7.25").alias("Charge"), F.when(k % 3 == 0, "soon").otherwise("2024-01-31").alias("Posted-Date"),
    )


@query(
    f"""SELECT seq AS row_no, 'Row ' || seq || ': ' || CASE WHEN trim(payee) = '' THEN 'missing merchant (merchant_raw / merchant / description)' WHEN charge = '' THEN 'empty amount'
WHEN charge = 'free' THEN 'could not convert string to float: free' ELSE 'unrecognized date format: soon' END AS error FROM ({_RAW}) WHERE trim(payee) = '' OR charge <> '7.25' OR posted_date = 'soon'"""
)
def parse_rejects(spark, sf_dir: str) -> DataFrame:
    from ledgerlight.sources import ingest

    return ingest.typed(_raw(spark, sf_dir))[1]


@query(
    f"""SELECT 'ingest-' || substr(sha256(seq || '|' || payee || '|' || charge || '|' || posted_date), 1, 8) AS transaction_id, payee AS merchant_raw, 7.25::DOUBLE AS amount, DATE '2024-01-31' AS date,
'USD' AS currency, seq FROM ({_RAW}) WHERE trim(payee) <> '' AND charge = '7.25' AND posted_date <> 'soon'"""
)
def parse_valid(spark, sf_dir: str) -> DataFrame:
    from ledgerlight.sources import ingest

    return ingest.typed(_raw(spark, sf_dir))[0].select("transaction_id", "merchant_raw", "amount", "date", "currency", "seq")


@query("SELECT o_orderkey, round(o_totalprice, 2) AS amount, 'Canva' AS merchant FROM orders")
def best_amount(spark, sf_dir: str) -> DataFrame:
    from ledgerlight.sources.receipts import pasted

    price = F.col("o_totalprice")
    orders = table(spark, sf_dir, "orders").repartition(spark.sparkContext.defaultParallelism)  # the file is small, the parsing is not
    texts = orders.select(F.col("o_orderkey").cast("string").alias("path"), F.lit("Your Canva receipt").alias("subject"), F.lit("").alias("sender"), F.format_string("Subtotal $%.2f\nTax $1.05\nTotal charged $%,.2f", price / 2, price).alias("body"))
    return pasted(texts).select(F.col("path").cast("bigint").alias("o_orderkey"), "amount", F.col("merchant_raw").alias("merchant"))


@query()
def resolve_names(spark, sf_dir: str) -> DataFrame:
    from ledgerlight.operators import registry, resolution

    txns = _names(spark, sf_dir).select(F.col("raw").alias("merchant_raw"), F.lit("2024-01-01").cast("date").alias("date"), F.lit(None).cast("string").alias("category_mcc"), F.col("id").alias("seq"))
    return resolution.resolved(txns, registry.seeds(spark))[0].select("seq", "merchant_raw", "cleaned", "canonical_name", "service_category", "method", "confidence")


@query()
def receipts_from_pages(spark, sf_dir: str) -> DataFrame:
    from ledgerlight.sources.receipts import receipts

    head = F.concat(F.lit("From: Shop <mail@shop.example>\nSubject: Your Canva receipt\nContent-Type: text/html; charset=\"utf-8\"\n\n<p>Total charged $"), F.format_string("%d.50", F.col("page_id") + 1), F.lit("</p>"))
    mails = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.concat(head, F.coalesce("html", F.lit(""))).cast("binary").alias("content"))
    return receipts(mails)
