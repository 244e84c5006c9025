"""A sales ledger made from a seed, as one plan of built-in functions.

Every draw is a hash of the seed, a name and the row's own keys, so the ledger is the same however its rows
are spread over tasks, and a lost task makes the same rows again. Customers are exploded into business
days, days into orders, orders into lines, lines into lines with their cancellation or return.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import holiday

BRANCH = "Head office"
DEPARTMENTS = ("Sales 1", "Sales 2", "Solutions")
AREAS = ("Aichi", "Gifu", "Mie", "Shizuoka", "Nagano", "Tokyo", "Osaka")
MAX_REPS = 20


@dataclass(frozen=True)
class Product:
    """ceiling is the largest discount; the price stays above unit_cost up to it. A sale of follows makes this one likelier."""

    name: str
    category: str
    list_price: int
    unit_cost: int
    ceiling: float
    quantity: float
    weights: tuple[float, float, float]
    follows: int | None = None


PRODUCTS = (
    Product("Fastener set", "Parts", 1_200, 620, 0.40, 40, (9.0, 6.0, 0.4)),
    Product("Bearing", "Parts", 3_600, 1_900, 0.40, 24, (7.0, 8.0, 0.3)),
    Product("Seal kit", "Parts", 900, 480, 0.40, 36, (5.0, 3.0, 0.2), 1),
    Product("Valve", "Parts", 8_400, 4_700, 0.35, 12, (3.0, 5.0, 0.5)),
    Product("Pump", "Parts", 46_000, 27_000, 0.35, 4, (1.0, 2.0, 1.0)),
    Product("Controller", "Systems", 98_000, 58_000, 0.32, 3, (0.3, 0.5, 5.0)),
    Product("Sensor pack", "Systems", 14_000, 7_800, 0.36, 10, (0.5, 0.6, 7.0), 5),
    Product("Gateway", "Systems", 62_000, 38_000, 0.30, 3, (0.1, 0.3, 4.0), 5),
    Product("Service visit", "Systems", 35_000, 21_000, 0.30, 3, (0.2, 0.4, 6.0), 7),
    Product("Spare filter", "Parts", 2_200, 1_150, 0.40, 18, (2.0, 4.0, 0.3), 4),
)

SEASON = (0.90, 0.95, 1.30, 0.85, 0.90, 1.00, 0.95, 0.85, 1.15, 1.00, 1.00, 1.15)
WEEKDAY = (1.05, 1.00, 1.00, 0.95, 1.00, 0.0, 0.0)
#: Rates, spans and factors that a ledger of this kind is made with.
YEAR_SIGMA, MONTH_SIGMA = 0.09, 0.13
ORDERS_A_DAY = 0.19
FOLLOW_DAYS, FOLLOW_BOOST = 90, 3.0
LARGE_A_MONTH, LARGE_TIMES = 7.0, (25.0, 90.0)
TYPO, DISCOUNT_ERROR, PUSH_SALE, RETURN = 0.003, 0.002, 0.002, 0.005
CANCEL_DAYS, RETURN_DAYS = 35, 60
REP_CHANGE, CHURN_AFTER_CHANGE = 0.15, 1.8


@dataclass(frozen=True)
class LedgerConfig:
    start: date = date(2022, 1, 1)
    end: date = date(2024, 12, 31)
    n_customers: int = 200
    reps_per_department: int = 5
    new_customer_ratio: float = 0.25
    churn_ratio: float = 0.20

    def __post_init__(self) -> None:
        if self.end <= self.start:
            raise ValueError("end lies after start")
        if self.n_customers < 1:
            raise ValueError("n_customers is at least 1")
        if not 1 <= self.reps_per_department <= MAX_REPS:
            raise ValueError(f"reps_per_department lies between 1 and {MAX_REPS}")
        if min(self.new_customer_ratio, self.churn_ratio) < 0 or self.new_customer_ratio + self.churn_ratio >= 0.9:
            raise ValueError("new_customer_ratio and churn_ratio add up to less than 0.9")

    @property
    def months(self) -> int:
        return (self.end.year - self.start.year) * 12 + self.end.month - self.start.month + 1


class Ledger(NamedTuple):
    transactions: DataFrame
    customers: DataFrame
    anomaly_labels: DataFrame


class Draws:
    """Random columns of one seed."""

    def __init__(self, seed: int):
        self.seed = seed

    def uniform(self, name: str, *keys: Column) -> Column:
        """Above 0 and below 1."""
        return (F.pmod(F.xxhash64(F.lit(self.seed), F.lit(name), *keys), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)

    def below(self, n: Column | int, name: str, *keys: Column) -> Column:
        return F.floor(self.uniform(name, *keys) * n).cast("int")

    def normal(self, name: str, *keys: Column) -> Column:
        return F.sqrt(-2 * F.ln(self.uniform(f"{name} r", *keys))) * F.cos(2 * math.pi * self.uniform(f"{name} a", *keys))

    def gamma2(self, scale: float, name: str, *keys: Column) -> Column:
        """Gamma with shape 2: a sum of two exponentials."""
        return -scale * (F.ln(self.uniform(f"{name} 1", *keys)) + F.ln(self.uniform(f"{name} 2", *keys)))


def poisson(u: Column, z: Column, mean: Column) -> Column:
    """By inversion of the uniform u up to a mean of 30, beyond by the normal z."""

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * mean / i
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.when(u > s["c"], i).otherwise(s["k"]).alias("k"))

    zero = F.exp(-mean)
    counted = F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.struct(zero.alias("p"), zero.alias("c"), F.lit(0).alias("k")), step, lambda s: s["k"])
    return F.when(mean <= 30, counted).otherwise(F.greatest(F.round(mean + F.sqrt(mean) * z), F.lit(0.0)).cast("int"))


def _of(values, index: Column) -> Column:
    """The value at an index from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def _customers(spark: SparkSession, cfg: LedgerConfig, d: Draws) -> DataFrame:
    """Customers with what drives their orders: size, representatives, entry, decline."""
    c, months, reps = F.col("id"), cfg.months, cfg.reps_per_department
    base = spark.range(cfg.n_customers).withColumns(
        {
            "customer_code": F.format_string("C%04d", c + 1), "customer_name": F.format_string("Customer %04d", c + 1), "customer_area": _of(AREAS, d.below(len(AREAS), "area", c)),
            "dept": d.below(len(DEPARTMENTS), "department", c), "size": d.gamma2(0.5, "size", c), "rep": d.below(reps, "rep", c),
            "changes": (d.uniform("rep change", c) < REP_CHANGE) & F.lit(reps > 1), "change_month": 1 + d.below(max(1, months - 1), "change month", c),
            "entry": F.when(d.uniform("new", c) < cfg.new_customer_ratio, 1 + d.below(max(1, int(months * 0.6)), "entry", c)).otherwise(0),
        }
    )
    risk = cfg.churn_ratio * F.when(F.col("changes"), CHURN_AFTER_CHANGE).otherwise(1.0)
    earliest = F.greatest(F.col("entry") + 3, F.when(F.col("changes"), F.col("change_month")).otherwise(0))
    return base.withColumns(
        {
            "next_rep": F.when(F.col("changes"), F.pmod(F.col("rep") + 1 + d.below(max(1, reps - 1), "next rep", c), F.lit(reps))).otherwise(F.col("rep")),
            "decline": F.when((d.uniform("churn", c) < risk) & (earliest < months - 2), earliest + d.below(months - 2 - earliest, "decline", c)),
            "span": 3 + d.below(4, "span", c),
        }
    )


def business_day(day: Column) -> Column:
    return (F.weekday(day) < 5) & ~holiday(day)


def _next_business_day(day: Column) -> Column:
    """No run of days off has two weeks."""
    return F.filter(F.sequence(day, F.date_add(day, 14)), business_day)[0]


def _orders(customers: DataFrame, cfg: LedgerConfig, d: Draws) -> DataFrame:
    """One row an order: a draw for each customer and business day."""
    c, day = F.col("id"), F.col("day")
    days = customers.withColumn("day", F.explode(F.sequence(F.lit(cfg.start), F.lit(cfg.end)))).filter(business_day(day))
    month = (F.year(day) - cfg.start.year) * 12 + F.month(day) - cfg.start.month
    days = days.withColumn("m", month).filter("m >= entry")
    fade = F.when(F.col("m") >= F.col("decline"), F.greatest(F.lit(0.0), 1 - (F.col("m") - F.col("decline") + 1) / F.col("span"))).otherwise(1.0)
    level = F.exp(F.aggregate(F.sequence(F.lit(cfg.start.year), F.year(day)), F.lit(0.0), lambda s, y: s + YEAR_SIGMA * d.normal("year", y)))
    jitter = F.exp(MONTH_SIGMA * d.normal("month", F.year(day), F.month(day)))
    edge = F.when(F.dayofmonth(day) <= 5, 0.85).when(F.dayofmonth(day) >= 25, 1.25).otherwise(1.0)
    factor = _of(SEASON, F.month(day) - 1) * _of(WEEKDAY, F.weekday(day)) * level * jitter * edge
    chance = ORDERS_A_DAY * F.least(F.sqrt("size") + 0.1, F.lit(1.8)) * factor * F.col("fade")
    return days.withColumn("fade", fade).filter(d.uniform("order", c, F.datediff(day, F.lit("1970-01-01").cast("date"))) < chance)


def _lines(orders: DataFrame, d: Draws) -> DataFrame:
    """One row a line: one to three distinct products, drawn by weight; recent sales draw what follows them."""
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    c, n = F.col("id"), F.col("number")

    def scores(name: str, boosted: bool) -> Column:
        found = []
        for i, p in enumerate(PRODUCTS):
            weight = _of(p.weights, F.col("dept"))
            if boosted and p.follows is not None:
                weight = weight * F.when(F.array_contains("recent", p.follows), FOLLOW_BOOST).otherwise(1.0)
            found.append(F.struct((-F.ln(d.uniform(name, c, n, F.lit(i))) / weight).alias("score"), F.lit(i).alias("item")))
        return F.array(*found)

    past = Window.partitionBy("id").orderBy("number").rangeBetween(-FOLLOW_DAYS, -1)
    first = orders.withColumn("number", number).withColumn("first", F.array_min(scores("first", False))["item"]).withColumn("recent", F.collect_set("first").over(past))
    ranked = first.withColumn("others", F.transform(F.array_sort(scores("item", True)), lambda s: s["item"]))
    chosen = F.slice(F.concat(F.array("first"), F.array_remove("others", F.col("first"))), 1, 1 + d.below(3, "items", c, n))
    lines = ranked.select("*", F.posexplode(chosen).alias("pos", "item")).drop("others", "recent", "first")
    at = (c, n, F.col("pos"))
    ceiling = _of([p.ceiling for p in PRODUCTS], F.col("item"))
    share = F.least(F.greatest(0.5 + 0.12 * d.normal("discount", *at) + 0.25 * (1 - F.col("fade")), F.lit(0.0)), F.lit(1.0))
    drawn = lines.withColumns(
        {
            "mean": _of([float(p.quantity) for p in PRODUCTS], F.col("item")) * F.col("size") * (0.4 + 0.6 * F.col("fade")) * d.gamma2(0.5, "quantity", *at),
            "u": d.uniform("poisson", *at), "z": d.normal("poisson", *at), "discount": F.round(ceiling * share, 4),
        }
    )
    return drawn.withColumn("quantity", F.greatest(poisson(F.col("u"), F.col("z"), F.col("mean")), F.lit(1)).cast("bigint")).drop("mean", "u", "z")


def _with_large_deals(lines: DataFrame, d: Draws) -> DataFrame:
    """A few lines a month, likelier those of large customers, grow to large deals.

    Ranks are cut at 80 before the shuffle: the number of a month is a Poisson draw of mean LARGE_A_MONTH
    (7), which passes 80 with a probability below 1e-50, so the cut drops no deal.
    """
    at = (F.col("id"), F.col("number"), F.col("pos"))
    key = -F.ln(d.uniform("large", *at)) / (F.col("size") + 1e-9)
    limit = poisson(d.uniform("large count", F.col("m")), F.lit(0.0), F.lit(LARGE_A_MONTH))
    low, high = LARGE_TIMES
    ranked = lines.select("id", "number", "pos", "m", key.alias("key")).withColumn("rank", F.row_number().over(Window.partitionBy("m").orderBy("key", "id", "number", "pos"))).filter("rank <= 80")
    grown = ranked.filter(F.col("rank") <= limit).select("id", "number", "pos", (low + (high - low) * d.uniform("large times", *at)).alias("times"))
    return lines.join(grown, ["id", "number", "pos"], "left").withColumn("quantity", F.round(F.col("quantity") * F.coalesce("times", F.lit(1.0))).cast("bigint")).drop("times")


def _entries(lines: DataFrame, cfg: LedgerConfig, d: Draws) -> DataFrame:
    """Lines with their errors, cancellations and returns, and the kind of anomaly where there is one."""
    at = (F.col("id"), F.col("number"), F.col("pos"))
    u = F.col("u")
    drawn = lines.withColumns(
        {
            "u": d.uniform("anomaly", *at), "cancelled": _next_business_day(F.date_add("day", 5 + d.below(CANCEL_DAYS - 18, "cancel", *at))),
            "returned": _next_business_day(F.date_add("day", 3 + d.below(RETURN_DAYS - 16, "return day", *at))), "part": d.uniform("return part", *at),
        }
    )
    pushed = (u >= TYPO + DISCOUNT_ERROR) & (u < TYPO + DISCOUNT_ERROR + PUSH_SALE) & (F.col("cancelled") <= F.lit(cfg.end))
    kind = F.when(u < TYPO, "quantity_typo").when(u < TYPO + DISCOUNT_ERROR, "discount_error").when(pushed, "push_sale")
    drawn = drawn.withColumns({"kind": kind, "back": (d.uniform("return", *at) < RETURN) & (F.col("returned") <= F.lit(cfg.end)) & (F.coalesce(kind, F.lit("")) != "push_sale")})
    drawn = drawn.withColumns(
        {
            "quantity": F.when(F.col("kind") == "quantity_typo", F.col("quantity") * 10).otherwise(F.col("quantity")),
            "discount": F.when(F.col("kind") == "discount_error", F.round(0.85 + 0.1 * d.uniform("error", *at), 4)).otherwise(F.col("discount")),
        }
    )

    def entry(prefix: str, day: str, quantity: Column, kind: Column) -> Column:
        return F.struct(F.lit(prefix).alias("prefix"), F.col(day).alias("order_date"), quantity.alias("quantity"), kind.alias("kind"))

    own = entry("SO", "day", F.col("quantity"), F.col("kind"))
    cancel = F.when(F.col("kind") == "push_sale", entry("CN", "cancelled", -F.col("quantity"), F.col("kind")))
    back = F.when(F.col("back"), entry("RT", "returned", -F.greatest(F.floor(F.col("quantity") * F.col("part")), F.lit(1)), F.lit(None).cast("string")))
    return drawn.withColumn("e", F.explode(F.array_compact(F.array(own, cancel, back)))).drop("quantity", "kind").select("*", "e.*").drop("e")


def _ledger(entries: DataFrame) -> DataFrame:
    """The ledger's columns and kind; a cancellation or return carries the number of its order, so keys are unique."""
    item = F.col("item")
    rep = F.when(F.col("m") >= F.col("change_month"), F.col("next_rep")).otherwise(F.col("rep"))
    priced = entries.withColumns(
        {
            "list_price": _of([p.list_price for p in PRODUCTS], item).cast("bigint"), "unit_cost": _of([p.unit_cost for p in PRODUCTS], item).cast("bigint"),
            "quantity": F.col("quantity").cast("bigint"),
        }
    )
    priced = priced.withColumn("unit_price", F.bround(F.col("list_price") * (1 - F.col("discount")) / 10).cast("bigint") * 10)
    department = _of(DEPARTMENTS, F.col("dept"))
    return priced.select(
        F.concat("prefix", F.date_format("day", "yyyyMMdd"), F.lit("-"), "customer_code").alias("order_no"), (F.col("pos") + 1).cast("bigint").alias("line_no"), "order_date",
        "customer_code", "customer_name", "customer_area", F.lit(BRANCH).alias("branch"), department.alias("department"),
        F.concat(department, F.lit(" rep "), rep + 1).alias("sales_rep"), _of([p.name for p in PRODUCTS], item).alias("product"), _of([p.category for p in PRODUCTS], item).alias("category"),
        "quantity", "list_price", "discount", "unit_price", (F.col("unit_price") * F.col("quantity")).alias("amount"), "unit_cost",
        (F.col("unit_cost") * F.col("quantity")).alias("cost"), ((F.col("unit_price") - F.col("unit_cost")) * F.col("quantity")).alias("profit"), "kind",
    )


def generate(spark: SparkSession, cfg: LedgerConfig = LedgerConfig(), seed: int = 42) -> Ledger:
    """Order lines, customers (without a word on who leaves) and labels of the anomalies put in."""
    d = Draws(seed)
    customers = _customers(spark, cfg, d)
    full = _ledger(_entries(_with_large_deals(_lines(_orders(customers, cfg, d), d), d), cfg, d))
    entry = F.add_months(F.lit(cfg.start.replace(day=1)), F.col("entry"))
    known = customers.select("customer_code", "customer_name", "customer_area", F.lit(BRANCH).alias("branch"), entry.alias("entry_month"))
    return Ledger(full.drop("kind"), known, full.filter("kind is not null").select("order_no", "line_no", "kind"))


def generate_plain(spark: SparkSession, cfg: LedgerConfig = LedgerConfig(), seed: int = 42) -> DataFrame:
    """A simpler ledger, without numbers of orders and lines: nobody enters or leaves, nothing comes back, is cancelled or wrong, and there are no large deals."""
    d = Draws(seed)
    fixed = replace(cfg, new_customer_ratio=0.0, churn_ratio=0.0)
    lines = _lines(_orders(_customers(spark, fixed, d), fixed, d), d)
    entries = lines.withColumns({"prefix": F.lit("SO"), "order_date": F.col("day"), "kind": F.lit(None).cast("string")})
    return _ledger(entries).drop("order_no", "line_no", "kind")
