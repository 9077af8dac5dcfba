"""Stand-in input: the driver's order/lineitem tables re-typed as the clinic tables.

This module only renames and re-types columns so the clinic jobs have rows of
their schema to run on; it does none of the jobs' work.  Mapping:

* clinic       <- nation x region
* staff        <- supplier
* patient      <- customer
* appointment  <- orders x customer, staff = smallest supplier on the order
* diagnosis    <- one row per lineitem x part
* medication   <- part
* prescription <- the lineitems whose part key is not a multiple of 10
* bill         <- lineitem amounts summed per order x orders

Everything is lazy: the jobs that read these DataFrames prune the columns and
tables they do not need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Tables, conform

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def read_driver_tables(spark: SparkSession, sf_dir: str,
                       names: tuple[str, ...] = DRIVER_TABLES) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names}


def _pad6(c) -> F.Column:
    return F.lpad(c.cast("string"), 6, "0")


def _by_mod(key, n: int, values: tuple[str, ...]) -> F.Column:
    expr = None
    for i, v in enumerate(values):
        cond = (key % n) == i
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    return expr


def _days_after(start: str, days) -> F.Column:
    return F.date_add(F.lit(start).cast("date"), days.cast("int"))


# Total order of lineitems: every column, so rows that tie are identical rows.
LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
              "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
_NUMBERED: dict[tuple[str, int], DataFrame] = {}


def _lines(li: DataFrame) -> DataFrame:
    """Lineitems with a unique id: their 1-based rank in ``LINE_ORDER``.

    The rank comes from a range-partitioned sort (``positions``), so one order with
    very many lines is spread over several sort partitions instead of one task.
    The numbered table is written once per session and folder and then reused.
    """
    from ..operators.tableview import positions

    spark = li.sparkSession
    # the same plan over the same files (their names, not only the folder, are part of it) is numbered once
    key = (spark.sparkContext.applicationId, li.semanticHash())
    if key not in _NUMBERED:
        _NUMBERED[key] = positions(li, [F.col(c).asc_nulls_first() for c in LINE_ORDER], name="line_id", rows=li.count())
    return _NUMBERED[key]


def clinic_tables(spark: SparkSession, sf_dir: str) -> Tables:
    d = read_driver_tables(spark, sf_dir)
    nation, region, customer = d["nation"], d["region"], d["customer"]
    supplier, part, orders, lineitem = d["supplier"], d["part"], d["orders"], d["lineitem"]

    cid = F.col("n_nationkey")
    clinic = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        cid.alias("clinic_id"),
        F.col("n_name").alias("clinic_name"),
        F.concat(F.col("n_name"), F.lit(", "), F.col("r_name")).alias("location"),
        F.col("r_name").alias("district"),
        F.concat(F.lit("+232-76-"), _pad6(cid)).alias("phone"),
        F.when(cid % 5 == 0, None).otherwise(
            F.concat(F.lower("n_name"), F.lit("@clinic.example"))).alias("email"),
        _days_after("2005-01-01", cid * 100).alias("established_date"),
    )

    sid = F.col("s_suppkey")
    staff = supplier.select(
        sid.alias("staff_id"),
        F.col("s_nationkey").alias("clinic_id"),
        F.lit("Staff").alias("first_name"),
        F.col("s_name").alias("last_name"),
        _by_mod(sid, 3, ("Doctor", "Nurse", "Receptionist")).alias("role"),
        _by_mod(sid, 3, ("Female", "Male", "Other")).alias("gender"),
        F.concat(F.lit("+232-77-"), _pad6(sid)).alias("phone"),
        F.when(sid % 4 == 0, None).otherwise(F.lower("s_name")).alias("email"),
        _days_after("2010-01-01", sid % 3000).alias("hire_date"),
    )

    pid = F.col("c_custkey")
    patient = customer.select(
        pid.alias("patient_id"),
        F.col("c_mktsegment").alias("first_name"),
        F.col("c_name").alias("last_name"),
        _days_after("1950-01-01", (pid * 37) % 20000).alias("date_of_birth"),
        _by_mod(pid, 3, ("Female", "Male", "Other")).alias("gender"),
        F.concat(F.col("c_name"), F.lit(" Street")).alias("address"),
        F.concat(F.lit("+232-78-"), _pad6(pid)).alias("phone"),
        F.when(pid % 6 == 0, None).otherwise(F.lit("O+")).alias("blood_type"),
        _days_after("2023-01-01", pid % 730).alias("registration_date"),
    )

    first_supplier = lineitem.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("min_supp"))
    oid = F.col("o_orderkey")
    appointment = (
        orders.join(customer.select("c_custkey", "c_nationkey"), orders.o_custkey == customer.c_custkey)
        .join(first_supplier, oid == first_supplier.l_orderkey, "left")
        .select(
            oid.alias("appointment_id"),
            F.col("o_custkey").alias("patient_id"),
            F.coalesce(F.col("min_supp"), F.lit(0)).alias("staff_id"),
            (F.col("c_nationkey") % 20).alias("clinic_id"),
            F.col("o_orderdate").cast("date").alias("appointment_date"),
            F.concat(F.lpad((8 + oid % 9).cast("string"), 2, "0"), F.lit(":"),
                     F.lpad(((oid % 4) * 15).cast("string"), 2, "0"), F.lit(":00")
                     ).alias("appointment_time"),
            F.col("o_orderpriority").alias("reason"),
            F.when(F.col("o_orderstatus") == "F", "Completed")
            .when(F.col("o_orderstatus") == "O", "Scheduled")
            .when(F.col("o_orderstatus") == "P", "Cancelled").alias("status"),
        )
    )

    def diagnosis() -> DataFrame:
        lines = _lines(lineitem)
        return conform(lines.join(part.select("p_partkey", "p_type", "p_name"),
                                  lines.l_partkey == part.p_partkey).select(
            F.col("line_id").alias("diagnosis_id"),
            F.col("l_orderkey").alias("appointment_id"),
            F.col("p_type").alias("diagnosis_code"),
            F.col("p_name").alias("description"),
            F.when(F.col("l_returnflag") == "R", "Severe")
            .when(F.col("l_returnflag") == "A", "Moderate")
            .when(F.col("l_returnflag") == "N", "Mild").alias("severity"),
            F.col("l_shipdate").cast("date").alias("diagnosed_date"),
        ), "diagnosis")

    mid = F.col("p_partkey")
    medication = part.select(
        mid.alias("medication_id"),
        F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand")).alias("medication_name"),
        F.when(mid % 7 == 0, None).otherwise(F.col("p_type")).alias("description"),
        _by_mod(mid, 3, ("tablet", "capsule", "sachet")).alias("unit"),
        F.col("p_size").alias("stock_quantity"),
    )

    qty = F.col("l_quantity").cast("int")

    def prescription() -> DataFrame:
        return conform(_lines(lineitem).select(
            F.col("line_id").alias("prescription_id"),
            F.col("line_id").alias("diagnosis_id"),
            F.col("l_partkey").alias("medication_id"),
            F.concat(qty.cast("string"), F.lit("mg")).alias("dosage"),
            F.when(F.col("l_linestatus") == "F", "Once daily")
            .when(F.col("l_linestatus") == "O", "Twice daily").alias("frequency"),
            qty.alias("duration_days"),
            F.col("l_shipdate").cast("date").alias("prescribed_date"),
        ), "prescription")

    price = F.col("l_extendedprice").cast("decimal(12,2)")
    per_order = lineitem.groupBy("l_orderkey").agg(
        F.sum(price).alias("total"),
        F.sum(F.when(F.col("l_linestatus") == "F", price).otherwise(F.lit(0))).alias("paid"),
    )
    total = F.col("total").cast("decimal(10,2)")
    paid = F.col("paid").cast("decimal(10,2)")
    bill = per_order.join(orders.select("o_orderkey", "o_custkey", "o_orderdate"),
                          per_order.l_orderkey == orders.o_orderkey).select(
        F.col("l_orderkey").alias("bill_id"),
        F.col("o_custkey").alias("patient_id"),
        F.col("l_orderkey").alias("appointment_id"),
        total.alias("total_amount"),
        paid.alias("amount_paid"),
        F.col("o_orderdate").cast("date").alias("bill_date"),
        F.when(paid == total, "Paid").when(paid > 0, "Partial").otherwise("Unpaid").alias("payment_status"),
    )

    raw = {"clinic": clinic, "staff": staff, "patient": patient, "appointment": appointment,
           "medication": medication, "bill": bill}
    out = Tables({name: conform(df, name) for name, df in raw.items()})
    # built on first use: they need the numbered lineitems (one sort of lineitem per session)
    out["diagnosis"] = diagnosis
    out["prescription"] = prescription
    return out
