"""Registered queries on cleaning and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import text
from tidemill.operators import clean, joins, quality
from tidemill.plans.registry import query
from tidemill.plans.storing import CHANGED_ORDERS_SQL, order_changes
from tidemill.sources.tables import read_table, spread

# Part types and their codes; LARGE is left out on purpose.
PART_TYPE_CODES = {
    "economy": "ECO",
    "medium": "MED",
    "promo": "PRO",
    "small": "SML",
    "standard": "STD",
}


@query(
    "quarantine_rows",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate, o_orderdate,
           concat_ws(',', CASE WHEN l_shipdate < o_orderdate THEN 'shipped_before_order' END,
                          CASE WHEN l_quantity > 49 THEN 'quantity_over_limit' END) AS reasons
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE l_shipdate < o_orderdate OR l_quantity > 49
    """,
)
def quarantine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that break a rule, with the rules they break."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate"
    )
    rules = {
        "shipped_before_order": F.col("l_shipdate") >= F.col("o_orderdate"),
        "quantity_over_limit": F.col("l_quantity") <= 49,
    }
    _, rejects = clean.quarantine(joins.enrich(lines, [(orders, {"l_orderkey": "o_orderkey"})]), rules)
    return rejects.drop("o_orderkey").withColumn("reasons", F.array_join("reasons", ","))


@query(
    "dedup_exact",
    """
    SELECT d.doc_id AS doc_id, lang, source, n_chars, copies
    FROM documents d JOIN (SELECT min(doc_id) AS doc_id, count(*) AS copies
                           FROM documents GROUP BY text) k ON d.doc_id = k.doc_id
    """,
)
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per distinct text, with the number of copies."""
    documents = read_table(spark, sf_dir, "documents")
    return clean.dedup_exact(documents, ["text"], "doc_id").drop("text")


@query(
    "dedup_latest",
    """
    SELECT * EXCLUDE (rn) FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC,
                 l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC,
                 l_linestatus DESC) AS rn
      FROM lineitem) WHERE rn = 1
    """,
)
def dedup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of each order line; other columns decide equal dates."""
    order = [
        "l_shipdate",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        "l_returnflag",
        "l_linestatus",
    ]
    lines = read_table(spark, sf_dir, "lineitem")
    return quality.newest_per_key(lines, ["l_orderkey", "l_linenumber"], order)


@query(
    "standardize_values",
    """
    SELECT p_partkey, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS p_name,
           CASE p_type WHEN 'ECONOMY' THEN 'ECO' WHEN 'MEDIUM' THEN 'MED' WHEN 'PROMO' THEN 'PRO'
                       WHEN 'SMALL' THEN 'SML' WHEN 'STANDARD' THEN 'STD'
                       ELSE lower(p_type) END AS p_type,
           p_type <> 'LARGE' AS p_type_known
    FROM part
    """,
)
def standardize_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names cleaned and part types mapped to codes."""
    parts = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    codes = spark.createDataFrame(list(PART_TYPE_CODES.items()), "value string, code string")
    return clean.standardize(parts, {"p_name": None, "p_type": codes})


@query(
    "normalize_urls",
    """
    SELECT page_id, url,
           lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^([A-Za-z]+://[^/]*)', 1))
           || regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z]+://[^/]*', '') AS url_norm
    FROM pages
    """,
)
def normalize_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses in a comparable form."""
    return text.normalize_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), "url")


@query(
    "safe_cast",
    """
    SELECT p_partkey, TRY_CAST(split_part(p_brand, '#', 2) AS INTEGER) AS brand_no,
           split_part(p_brand, '#', 2) IS NOT NULL
             AND TRY_CAST(split_part(p_brand, '#', 2) AS INTEGER) IS NULL AS brand_no_failed,
           p_name IS NOT NULL AND TRY_CAST(p_name AS INTEGER) IS NULL AS name_no_failed
    FROM part
    """,
)
def safe_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand numbers, and names that are none, cast with a failure flag."""
    parts = read_table(spark, sf_dir, "part").select(
        "p_partkey",
        F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("brand_no"),
        F.col("p_name").alias("name_no"),
    )
    return clean.safe_cast(clean.safe_cast(parts, "brand_no", "int"), "name_no", "int").drop("name_no")


@query(
    "fill_missing",
    """
    SELECT o_orderkey, coalesce(n_lines, 0) AS n_lines, coalesce(quantity, 0.0) AS quantity
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS quantity
                           FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
    """,
)
def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and quantity per order, zero for orders without lines."""
    lines = (
        read_table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity"))
    )
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return clean.fill_missing(joined.drop("l_orderkey"), {"n_lines": 0, "quantity": 0.0})


@query(
    "flag_outliers",
    """
    WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1,
                      quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
    SELECT o_orderkey, o_orderpriority, o_totalprice, round(q1, 4) AS q1, round(q3, 4) AS q3,
           o_totalprice < q1 - 0.4 * (q3 - q1) OR o_totalprice > q3 + 0.4 * (q3 - q1) AS is_outlier
    FROM orders JOIN q USING (o_orderpriority)
    """,
)
def flag_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders flagged by the quartiles of their priority.

    Totals are spread evenly, so the usual factor of 1.5 would flag none.
    """
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    flagged = clean.flag_outliers(orders, "o_totalprice", ["o_orderpriority"], k=0.4)
    return flagged.withColumns({"q1": F.round("q1", 4), "q3": F.round("q3", 4)})


@query(
    "redact_pii",
    """
    SELECT doc_id, regexp_replace(
             regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}',
                            '[EMAIL]', 'g'),
             '\\(?[0-9]{3}\\)?[ .-][0-9]{3}[.-][0-9]{4}', '[PHONE]', 'g') AS text
    FROM documents
    """,
)
def redact_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with e-mail addresses and phone numbers replaced."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return text.redact(spread(documents), "text")


_PROFILED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query(
    "profile_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_nulls,"
        f" count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS VARCHAR) AS min_value,"
        f" CAST(max({c}) AS VARCHAR) AS max_value FROM orders"
        for c in _PROFILED
    ),
)
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, nulls, distinct values and range of the order columns."""
    return quality.profile(read_table(spark, sf_dir, "orders"), exact=_PROFILED)


@query(
    "profile_sketched",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_nulls,"
        f" count(DISTINCT {c}) AS n_exact, TRUE AS close FROM orders"
        for c in _PROFILED
    ),
)
def profile_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile from one scan, and whether its estimates are within four standard errors."""
    orders, rsd = read_table(spark, sf_dir, "orders"), 0.02
    guess = quality.profile(orders, rsd=rsd).select("column", "n_rows", "n_nulls", F.col("n_distinct").alias("guess"))
    exact = quality.profile(orders, exact=_PROFILED).select("column", F.col("n_distinct").alias("n_exact"))
    close = F.abs(F.col("guess") - F.col("n_exact")) <= 4 * rsd * F.col("n_exact")
    return guess.join(exact, "column").withColumn("close", close).drop("guess")


@query(
    "run_expectations",
    """
    SELECT check_name, CAST(n_failed AS BIGINT) AS n_failed, n_failed = 0 AS passed FROM (
      SELECT 'not_null(l_shipdate)' AS check_name, count(*) FILTER (l_shipdate IS NULL) AS n_failed
      FROM lineitem UNION ALL
      SELECT 'in_set(l_returnflag)', count(*) FILTER (l_returnflag NOT IN ('A', 'N')) FROM lineitem
      UNION ALL
      SELECT 'in_range(l_discount)', count(*) FILTER (l_discount < 0 OR l_discount > 0.08)
      FROM lineitem UNION ALL
      SELECT 'unique(l_orderkey,l_linenumber)',
             count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem
      UNION ALL
      SELECT 'foreign_key(l_orderkey)', count(*) FROM lineitem
      WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))
    """,
)
def run_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five checks on line items, four of which find something."""
    finished = read_table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    checks = [
        quality.NotNull("l_shipdate"),
        quality.InSet("l_returnflag", ("A", "N")),
        quality.InRange("l_discount", 0.0, 0.08),
        quality.Unique(("l_orderkey", "l_linenumber")),
        quality.ForeignKey("l_orderkey", finished, "o_orderkey"),
    ]
    return quality.expect(read_table(spark, sf_dir, "lineitem"), checks)


@query(
    "reconcile_tables",
    f"""
    WITH b AS ({CHANGED_ORDERS_SQL})
    SELECT coalesce(orders.o_orderkey, b.o_orderkey) AS o_orderkey,
           CASE WHEN b.o_orderkey IS NULL THEN 'missing' WHEN orders.o_orderkey IS NULL THEN 'extra'
                ELSE 'changed' END AS status
    FROM orders FULL JOIN b ON orders.o_orderkey = b.o_orderkey
    WHERE orders IS DISTINCT FROM b
    """,
)
def reconcile_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against the version a change batch leaves."""
    orders = read_table(spark, sf_dir, "orders")
    after = quality.upsert(
        orders, order_changes(orders), ["o_orderkey"], ["o_orderdate"], delete_flag="deleted"
    )
    return quality.reconcile(orders, after, ["o_orderkey"])
