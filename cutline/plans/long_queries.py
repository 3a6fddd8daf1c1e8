"""Very long series and groups: all orders of a status are one series, all lines of a status one group. Cells are small here, so that small tables have many."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.operators import ledger, long, segments

from .tables import table

#: Rows to a cell; elements between cuts; places of an override, and its length.
ROWS, APART, EVERY, LASTS = 2_000, 90, 32, 12
SERIES = ["o_orderstatus"]


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderstatus", F.col("o_orderkey").cast("long").alias("pos"), "o_orderpriority", "o_totalprice")


def _cells(orders: DataFrame) -> long.Cells:
    return long.cells(orders, SERIES, "pos", ROWS)


def _info(orders: DataFrame) -> DataFrame:
    return orders.groupBy(*SERIES).agg((F.max("pos") + 1).alias("n_elements"))


def _urgent(orders: DataFrame) -> DataFrame:
    return orders.filter("o_orderpriority like '1%'").select(*SERIES, "pos")


def long_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments between urgent orders."""
    orders = _orders(spark, sf)
    return segments.from_cuts(_urgent(orders), _info(orders), SERIES, split=_cells(orders))


def long_costs(spark: SparkSession, sf: str) -> DataFrame:
    """How far each order's price is from that of the order before."""
    orders = _orders(spark, sf)
    costs = segments.scalar_costs(orders, SERIES, "pos", "o_totalprice", F.lit(100_000.0), split=_cells(orders))
    return costs.select(*SERIES, "pos", F.round("inter_cost", 2).alias("inter_cost"))


def long_increments(spark: SparkSession, sf: str) -> DataFrame:
    """By how much an order exceeds all orders before it."""
    orders = _orders(spark, sf)
    found = ledger.increments(orders, SERIES, ["pos"], "o_totalprice", split=_cells(orders))
    return found.select(*SERIES, "pos", F.round("increment", 2).alias("increment"))


def long_running(spark: SparkSession, sf: str) -> DataFrame:
    """Number, urgent orders so far, last urgent order and next order of each order."""
    orders = _orders(spark, sf)
    urgent = F.when(F.col("o_orderpriority").startswith("1"), F.col("pos"))
    wants = {"number": ("row",), "urgent": ("sum", F.when(urgent.isNotNull(), 1).otherwise(0)), "last_urgent": ("last", urgent), "next_order": ("next", F.col("pos"))}
    return long.running(orders, SERIES, ["pos"], wants, _cells(orders)).drop("o_orderpriority", "o_totalprice")


def long_min_length(spark: SparkSession, sf: str) -> DataFrame:
    """Urgent orders at least 90 places apart."""
    orders = _orders(spark, sf)
    cuts = _urgent(orders).select(*SERIES, "pos", F.lit(APART).alias("min_len"), F.lit(0).alias("scope_start"))
    return long.spaced(cuts, SERIES, long.cells(cuts, SERIES, "pos", ROWS // 8))


def long_attach(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the override that holds them; one begins at every order whose key 32 divides."""
    orders = _orders(spark, sf)
    overrides = orders.filter(F.col("pos") % EVERY == 0).select(*SERIES, F.col("pos").alias("start"), (F.col("pos") + LASTS).alias("end"), F.col("o_orderpriority").alias("priority"))
    return long.swept(orders.select(*SERIES, "pos"), overrides, SERIES, split=_cells(orders))


def long_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Floor-index percentiles and the median of prices by line status, by ranges of values."""
    lines = table(spark, sf, "lineitem").select("l_linestatus", "l_extendedprice")
    found = long.percentiles(lines, ["l_linestatus"], "l_extendedprice", [1, 50, 99, 100], rows=ROWS)
    middle = long.median(lines, ["l_linestatus"], "l_extendedprice", rows=ROWS)
    return long.joined(found, middle.withColumn("median", F.round("median", 4)), ["l_linestatus"])


def level_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """The fifth percentile of prices by flag and status, by flag, and of all; is the merged sketch within its bound?"""
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    found = long.levels(lines, ["l_returnflag", "l_linestatus"], "l_extendedprice", 5, rows=ROWS)
    return found.select("l_returnflag", "l_linestatus", "level", "n", "exact", F.expr("estimate between low and high").alias("within"))


QUERIES = {f.__name__: f for f in (long_segments, long_costs, long_increments, long_running, long_min_length, long_attach, long_percentiles, level_percentiles)}

_O = "o AS (SELECT o_orderstatus, o_orderkey::BIGINT AS pos, o_orderpriority, o_totalprice FROM orders)"
_W = "WINDOW w AS (PARTITION BY o_orderstatus ORDER BY pos)"
_LEVEL = "SELECT {a} AS l_returnflag, {b} AS l_linestatus, {level} AS level, count(*) AS n, list_sort(list(l_extendedprice))[floor(count(*) * 0.05)::BIGINT + 1]::DOUBLE AS exact, true AS within FROM lineitem GROUP BY ALL"

SQL = {
    "long_segments": f"""WITH {_O}, i AS (SELECT o_orderstatus, max(pos) + 1 AS n FROM o GROUP BY 1), b AS (SELECT o_orderstatus, pos AS start FROM o WHERE o_orderpriority LIKE '1%' AND pos > 0 UNION SELECT o_orderstatus, 0 FROM i)
        SELECT o_orderstatus, row_number() OVER w - 1 AS seg_idx, start, coalesce(lead(start) OVER w, n) AS "end" FROM b JOIN i USING (o_orderstatus) WINDOW w AS (PARTITION BY o_orderstatus ORDER BY start)""",
    "long_costs": f"WITH {_O} SELECT o_orderstatus, pos, round(abs(o_totalprice - lag(o_totalprice) OVER w), 2) AS inter_cost FROM o {_W}",
    "long_increments": f"WITH {_O} SELECT o_orderstatus, pos, round(greatest(o_totalprice - coalesce(max(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0), 2) AS increment FROM o",
    "long_running": f"WITH {_O} SELECT o_orderstatus, pos, row_number() OVER w AS number, sum((o_orderpriority LIKE '1%')::INT) OVER w AS urgent, last_value(CASE WHEN o_orderpriority LIKE '1%' THEN pos END IGNORE NULLS) OVER w AS last_urgent, lead(pos) OVER w AS next_order FROM o {_W}",
    "long_min_length": f"""WITH RECURSIVE {_O}, c AS MATERIALIZED (SELECT o_orderstatus, pos FROM o WHERE o_orderpriority LIKE '1%'),
        r AS (SELECT o_orderstatus, min(pos) AS pos FROM c WHERE pos >= {APART} GROUP BY 1 UNION ALL SELECT r.o_orderstatus, min(c.pos) FROM r JOIN c ON c.o_orderstatus = r.o_orderstatus AND c.pos >= r.pos + {APART} GROUP BY r.o_orderstatus, r.pos) SELECT * FROM r""",
    "long_attach": f"""WITH {_O}, v AS (SELECT o_orderstatus AS s, pos AS override_start, pos + {LASTS} AS override_end, o_orderpriority AS priority FROM o WHERE pos % {EVERY} = 0)
        SELECT o_orderstatus, pos, override_start, override_end, priority FROM o LEFT JOIN v ON s = o_orderstatus AND pos >= override_start AND pos < override_end""",
    "long_percentiles": """WITH s AS (SELECT l_linestatus, list_sort(list(l_extendedprice)) AS x, count(*) AS n, round(median(l_extendedprice::DOUBLE), 4) AS median FROM lineitem GROUP BY 1)
        SELECT l_linestatus, x[floor(0.01 * n)::BIGINT + 1] AS p1, x[floor(0.5 * n)::BIGINT + 1] AS p50, x[floor(0.99 * n)::BIGINT + 1] AS p99, x[1] AS p100, median FROM s""",
    "level_percentiles": " UNION ALL ".join((_LEVEL.format(a="l_returnflag", b="l_linestatus", level=2), _LEVEL.format(a="l_returnflag", b="NULL", level=1), _LEVEL.format(a="NULL", b="NULL", level=0))),
}
