"""DuckDB SQL for the clinic tables over the driver's tables (the oracle side).

Mirrors ``carelake.sources.adapter`` in plain SQL so that each oracle query can
start with ``WITH <clinic views>``.  Only the stand-in mapping lives here.
"""

CLINIC_VIEWS = {
    "clinic": """
SELECT CAST(n.n_nationkey AS BIGINT) AS clinic_id, n.n_name AS clinic_name,
       n.n_name || ', ' || r.r_name AS location, r.r_name AS district,
       '+232-76-' || lpad(CAST(n.n_nationkey AS VARCHAR), 6, '0') AS phone,
       CASE WHEN n.n_nationkey % 5 = 0 THEN NULL ELSE lower(n.n_name) || '@clinic.example' END AS email,
       DATE '2005-01-01' + CAST(n.n_nationkey * 100 AS INTEGER) AS established_date
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "staff": """
SELECT CAST(s_suppkey AS BIGINT) AS staff_id, CAST(s_nationkey AS BIGINT) AS clinic_id,
       'Staff' AS first_name, s_name AS last_name,
       CASE s_suppkey % 3 WHEN 0 THEN 'Doctor' WHEN 1 THEN 'Nurse' ELSE 'Receptionist' END AS role,
       CASE s_suppkey % 3 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' ELSE 'Other' END AS gender,
       '+232-77-' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS phone,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE lower(s_name) END AS email,
       DATE '2010-01-01' + CAST(s_suppkey % 3000 AS INTEGER) AS hire_date
FROM supplier""",
    "patient": """
SELECT CAST(c_custkey AS BIGINT) AS patient_id, c_mktsegment AS first_name, c_name AS last_name,
       DATE '1950-01-01' + CAST((c_custkey * 37) % 20000 AS INTEGER) AS date_of_birth,
       CASE c_custkey % 3 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' ELSE 'Other' END AS gender,
       c_name || ' Street' AS address,
       '+232-78-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS phone,
       CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'O+' END AS blood_type,
       DATE '2023-01-01' + CAST(c_custkey % 730 AS INTEGER) AS registration_date
FROM customer""",
    "appointment": """
SELECT CAST(o.o_orderkey AS BIGINT) AS appointment_id, CAST(o.o_custkey AS BIGINT) AS patient_id,
       CAST(coalesce(f.min_supp, 0) AS BIGINT) AS staff_id,
       CAST(c.c_nationkey % 20 AS BIGINT) AS clinic_id,
       CAST(o.o_orderdate AS DATE) AS appointment_date,
       lpad(CAST(8 + o.o_orderkey % 9 AS VARCHAR), 2, '0') || ':' ||
         lpad(CAST((o.o_orderkey % 4) * 15 AS VARCHAR), 2, '0') || ':00' AS appointment_time,
       o.o_orderpriority AS reason,
       CASE o.o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Scheduled'
            WHEN 'P' THEN 'Cancelled' END AS status
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS min_supp FROM lineitem GROUP BY l_orderkey) f
  ON o.o_orderkey = f.l_orderkey""",
    "line": """
SELECT *, row_number() OVER (ORDER BY l_orderkey NULLS FIRST, l_linenumber NULLS FIRST,
          l_partkey NULLS FIRST, l_suppkey NULLS FIRST, l_shipdate NULLS FIRST, l_extendedprice NULLS FIRST,
          l_quantity NULLS FIRST, l_discount NULLS FIRST, l_tax NULLS FIRST, l_returnflag NULLS FIRST,
          l_linestatus NULLS FIRST) AS line_id
FROM lineitem""",
    "diagnosis": """
SELECT CAST(l.line_id AS BIGINT) AS diagnosis_id, CAST(l.l_orderkey AS BIGINT) AS appointment_id,
       p.p_type AS diagnosis_code, p.p_name AS description,
       CASE l.l_returnflag WHEN 'R' THEN 'Severe' WHEN 'A' THEN 'Moderate' WHEN 'N' THEN 'Mild' END AS severity,
       CAST(l.l_shipdate AS DATE) AS diagnosed_date
FROM line l JOIN part p ON l.l_partkey = p.p_partkey""",
    "medication": """
SELECT CAST(p_partkey AS BIGINT) AS medication_id, p_name || ' ' || p_brand AS medication_name,
       CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS description,
       CASE p_partkey % 3 WHEN 0 THEN 'tablet' WHEN 1 THEN 'capsule' ELSE 'sachet' END AS unit,
       CAST(p_size AS INTEGER) AS stock_quantity
FROM part""",
    "prescription": """
SELECT CAST(line_id AS BIGINT) AS prescription_id, CAST(line_id AS BIGINT) AS diagnosis_id,
       CAST(l_partkey AS BIGINT) AS medication_id,
       CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || 'mg' AS dosage,
       CASE l_linestatus WHEN 'F' THEN 'Once daily' WHEN 'O' THEN 'Twice daily' END AS frequency,
       CAST(l_quantity AS INTEGER) AS duration_days,
       CAST(l_shipdate AS DATE) AS prescribed_date
FROM line""",
    "bill": """
SELECT CAST(t.l_orderkey AS BIGINT) AS bill_id, CAST(o.o_custkey AS BIGINT) AS patient_id,
       CAST(t.l_orderkey AS BIGINT) AS appointment_id,
       CAST(t.total AS DECIMAL(10,2)) AS total_amount, CAST(t.paid AS DECIMAL(10,2)) AS amount_paid,
       CAST(o.o_orderdate AS DATE) AS bill_date,
       CASE WHEN CAST(t.paid AS DECIMAL(10,2)) = CAST(t.total AS DECIMAL(10,2)) THEN 'Paid'
            WHEN t.paid > 0 THEN 'Partial' ELSE 'Unpaid' END AS payment_status
FROM (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS total,
             sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_extendedprice AS DECIMAL(12,2)) ELSE 0 END) AS paid
      FROM lineitem GROUP BY l_orderkey) t
JOIN orders o ON t.l_orderkey = o.o_orderkey""",
}

PREFIX = "WITH " + ",\n".join(f"{name} AS ({sql}\n)" for name, sql in CLINIC_VIEWS.items())


def with_views(body: str) -> str:
    """Prepend the clinic views to a query over them."""
    return PREFIX + "\n" + body
