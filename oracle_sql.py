"""DuckDB oracle SQL for every registered query.

Each statement starts from the clinic views of ``oracle_views`` and ends in the
same plain column types the registry hands to the comparison: typed dates as
ISO text, money as DOUBLE (cast from the exact DECIMAL result), integers as
BIGINT.  Display columns are text on both sides.
"""

from __future__ import annotations

from oracle_views import with_views


def _d(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def _dd(x: str) -> str:
    return f"strftime({x}, '%d %b %Y')"


def _m(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def _mt(x: str) -> str:
    return f"'Le ' || format('{{:,}}', CAST(round({x}, 0) AS BIGINT))"


def _th(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


NAME = "(p.first_name || ' ' || p.last_name)"
SNAME = "(s.first_name || ' ' || s.last_name)"

# Visit rows pairing each diagnosis with the first bill and each further bill
# with the first diagnosis of the same appointment.
FIRSTS = """
fb AS (SELECT b.* FROM bill b JOIN (SELECT appointment_id, min(bill_id) AS id FROM bill GROUP BY 1) f
       ON b.bill_id = f.id),
fd AS (SELECT d.* FROM diagnosis d JOIN (SELECT appointment_id, min(diagnosis_id) AS id FROM diagnosis GROUP BY 1) f
       ON d.diagnosis_id = f.id),
xb AS (SELECT b.* FROM bill b JOIN fb ON b.appointment_id = fb.appointment_id AND b.bill_id <> fb.bill_id)"""


def _q(body: str) -> str:
    return with_views(body)


def _with_firsts(body: str) -> str:
    # chain extra CTEs after the clinic views
    return with_views("").rstrip() + "," + FIRSTS + "\n" + body


REPORT_SQL: dict[str, str] = {
    "dashboard_metrics": _q(f"""
SELECT (SELECT count(*) FROM patient) AS patients, (SELECT count(*) FROM staff) AS staff,
       (SELECT count(*) FROM clinic) AS clinics, (SELECT count(*) FROM appointment) AS appointments,
       {_m("(SELECT coalesce(sum(amount_paid), 0) FROM bill)")} AS collected,
       {_m("(SELECT coalesce(sum(total_amount - amount_paid), 0) FROM bill)")} AS outstanding"""),
    "recent_appointments": _q(f"""
SELECT a.appointment_id, {_dd("a.appointment_date")} AS appointment_date,
       substr(a.appointment_time, 1, 5) AS appointment_time, {NAME} AS patient_name,
       {SNAME} AS staff_name, c.clinic_name, a.status
FROM appointment a JOIN patient p ON a.patient_id = p.patient_id
JOIN staff s ON a.staff_id = s.staff_id JOIN clinic c ON a.clinic_id = c.clinic_id
ORDER BY a.appointment_date DESC, a.appointment_time DESC, a.appointment_id LIMIT 10"""),
    "patient_list": _q(f"""
SELECT patient_id, first_name || ' ' || last_name AS full_name, {_dd("date_of_birth")} AS date_of_birth,
       gender, phone, coalesce(blood_type, '-') AS blood_type, {_dd("registration_date")} AS registration_date
FROM patient"""),
    "staff_list": _q(f"""
SELECT s.staff_id, {SNAME} AS staff_name, s.role, c.clinic_name, s.gender, s.phone,
       coalesce(s.email, '-') AS email, {_dd("s.hire_date")} AS hire_date
FROM staff s JOIN clinic c ON s.clinic_id = c.clinic_id"""),
    "clinic_activity": _q("""
SELECT clinic_id, clinic_name, district, location, phone, coalesce(email, '-') AS email,
       (SELECT count(*) FROM staff WHERE staff.clinic_id = clinic.clinic_id) AS staff_count,
       (SELECT count(*) FROM appointment WHERE appointment.clinic_id = clinic.clinic_id) AS appointment_count
FROM clinic"""),
    "appointment_list": _q(f"""
SELECT a.appointment_id, {_dd("a.appointment_date")} AS appointment_date,
       substr(a.appointment_time, 1, 5) AS appointment_time, {NAME} AS patient_name,
       {SNAME} AS staff_name, c.clinic_name, a.status, a.reason
FROM appointment a JOIN patient p ON a.patient_id = p.patient_id
JOIN staff s ON a.staff_id = s.staff_id JOIN clinic c ON a.clinic_id = c.clinic_id"""),
    "diagnosis_list": _q(f"""
SELECT d.diagnosis_id, {_dd("d.diagnosed_date")} AS diagnosed_date, {NAME} AS patient_name,
       d.diagnosis_code, d.description, d.severity, a.status AS visit_status
FROM diagnosis d JOIN appointment a ON d.appointment_id = a.appointment_id
JOIN patient p ON a.patient_id = p.patient_id"""),
    "prescription_list": _q(f"""
SELECT pr.prescription_id, {_dd("pr.prescribed_date")} AS prescribed_date, {NAME} AS patient_name,
       m.medication_name, pr.dosage, pr.frequency, CAST(pr.duration_days AS VARCHAR) || ' days' AS duration
FROM prescription pr JOIN diagnosis d ON pr.diagnosis_id = d.diagnosis_id
JOIN appointment a ON d.appointment_id = a.appointment_id
JOIN patient p ON a.patient_id = p.patient_id
JOIN medication m ON pr.medication_id = m.medication_id"""),
    "medication_inventory": _q("""
SELECT medication_id, medication_name, unit, CAST(stock_quantity AS BIGINT) AS stock_quantity,
       coalesce(description, '-') AS description FROM medication"""),
    "bill_list": _q(f"""
SELECT b.bill_id, {NAME} AS patient_name, {_dd("b.bill_date")} AS bill_date,
       {_mt("b.total_amount")} AS total_amount, {_mt("b.amount_paid")} AS amount_paid,
       {_mt("b.total_amount - b.amount_paid")} AS balance, b.payment_status
FROM bill b JOIN patient p ON b.patient_id = p.patient_id"""),
    "patient_visit_history": _with_firsts(f"""
, v AS (SELECT a.*, c.clinic_name, {SNAME} AS staff_name FROM appointment a
        JOIN clinic c ON a.clinic_id = c.clinic_id JOIN staff s ON a.staff_id = s.staff_id),
rows AS (
  SELECT v.*, d.description AS diagnosis, d.severity, b.total_amount, b.payment_status
  FROM v LEFT JOIN diagnosis d ON v.appointment_id = d.appointment_id
         LEFT JOIN fb b ON v.appointment_id = b.appointment_id
  UNION ALL
  SELECT v.*, d.description, d.severity, b.total_amount, b.payment_status
  FROM v JOIN xb b ON v.appointment_id = b.appointment_id
         LEFT JOIN fd d ON v.appointment_id = d.appointment_id)
SELECT patient_id, appointment_id, {_dd("appointment_date")} AS appointment_date,
       substr(appointment_time, 1, 5) AS appointment_time, clinic_name, staff_name, status, reason,
       coalesce(diagnosis, '-') AS diagnosis, coalesce(severity, '-') AS severity,
       coalesce({_mt("total_amount")}, '-') AS bill_total, coalesce(payment_status, '-') AS payment_status
FROM rows"""),
    "patient_header": _q(f"""
, per_visit AS (
  SELECT a.patient_id,
         greatest(coalesce(nd.n, 0), 1) + greatest(coalesce(nb.n, 0) - 1, 0) AS n_rows
  FROM appointment a
  LEFT JOIN (SELECT appointment_id, count(*) AS n FROM diagnosis GROUP BY 1) nd ON a.appointment_id = nd.appointment_id
  LEFT JOIN (SELECT appointment_id, count(*) AS n FROM bill GROUP BY 1) nb ON a.appointment_id = nb.appointment_id
  WHERE a.clinic_id IN (SELECT clinic_id FROM clinic) AND a.staff_id IN (SELECT staff_id FROM staff))
SELECT p.patient_id, {NAME} AS patient_name, p.phone, coalesce(p.blood_type, 'Unknown') AS blood_type,
       p.gender, CAST(coalesce(sum(v.n_rows), 0) AS BIGINT) AS visit_rows
FROM patient p LEFT JOIN per_visit v ON p.patient_id = v.patient_id
GROUP BY p.patient_id, p.first_name, p.last_name, p.phone, p.blood_type, p.gender""".replace(
        "\n, per_visit", ", per_visit", 1)),
    "unbilled_appointments": _q(f"""
SELECT a.appointment_id, a.patient_id, {NAME} AS patient_name,
       {_dd("a.appointment_date")} AS appointment_date, c.clinic_name
FROM appointment a JOIN patient p ON a.patient_id = p.patient_id
JOIN clinic c ON a.clinic_id = c.clinic_id
LEFT JOIN bill b ON a.appointment_id = b.appointment_id
WHERE b.bill_id IS NULL"""),
    "outstanding_bills": _q(f"""
SELECT b.bill_id, {NAME} AS patient_name, {_m("b.total_amount")} AS total_amount,
       {_m("b.amount_paid")} AS amount_paid, {_m("b.total_amount - b.amount_paid")} AS balance
FROM bill b JOIN patient p ON b.patient_id = p.patient_id
WHERE b.total_amount > b.amount_paid"""),
    "appointment_options": _q(f"""
SELECT a.appointment_id, {NAME} AS patient_name, {_dd("a.appointment_date")} AS appointment_date, a.status
FROM appointment a JOIN patient p ON a.patient_id = p.patient_id"""),
    "diagnosis_options": _q(f"""
SELECT d.diagnosis_id, d.diagnosis_code, {NAME} AS patient_name, {_dd("d.diagnosed_date")} AS diagnosed_date
FROM diagnosis d JOIN appointment a ON d.appointment_id = a.appointment_id
JOIN patient p ON a.patient_id = p.patient_id"""),
    "staff_directory": _q("""
SELECT staff_id, first_name || ' ' || last_name AS staff_name, role FROM staff"""),
    "patient_options": _q("""
SELECT patient_id, first_name || ' ' || last_name AS patient_name FROM patient"""),
    "medication_stock_options": _q("""
SELECT medication_id, medication_name, CAST(stock_quantity AS BIGINT) AS stock_quantity FROM medication"""),
    "revenue_by_clinic": _q(f"""
, money AS (SELECT appointment_id, sum(total_amount) AS total, sum(amount_paid) AS paid FROM bill GROUP BY appointment_id),
per_clinic AS (SELECT clinic_id, count(*) AS visits, sum(total) AS total, sum(paid) AS paid
               FROM appointment LEFT JOIN money USING (appointment_id) GROUP BY clinic_id)
SELECT clinic_id, clinic_name, coalesce(visits, 0) AS visits, {_m("coalesce(total, 0)")} AS total_billed,
       {_m("coalesce(paid, 0)")} AS total_collected, {_m("coalesce(total - paid, 0)")} AS total_outstanding
FROM clinic LEFT JOIN per_clinic USING (clinic_id)"""),
    "common_diagnoses": _q("""
SELECT diagnosis_code, description, count(*) AS total_cases,
       count(*) FILTER (severity = 'Severe') AS severe_cases,
       count(*) FILTER (severity = 'Moderate') AS moderate_cases,
       count(*) FILTER (severity = 'Mild') AS mild_cases
FROM diagnosis GROUP BY ALL"""),
    "outstanding_by_patient": _q(f"""
, owed AS (SELECT patient_id, payment_status, sum(total_amount) - sum(amount_paid) AS balance
           FROM bill WHERE amount_paid < total_amount GROUP BY patient_id, payment_status),
per_patient AS (SELECT patient_id, sum(balance) AS balance,
                       array_to_string(list_filter(['Unpaid', 'Partial', 'Paid'], lambda s: list_contains(list(payment_status), s)), ', ') AS statuses
                FROM owed GROUP BY patient_id)
SELECT o.patient_id, {NAME} AS patient_name, p.phone, {_m("o.balance")} AS outstanding_balance, o.statuses AS payment_statuses
FROM per_patient o JOIN patient p USING (patient_id)"""),
    "top_medications": _q("""
, times AS (SELECT medication_id, count(*) AS n FROM prescription GROUP BY medication_id),
ranked AS (SELECT medication.*, coalesce(times.n, 0) AS n,
                  row_number() OVER (ORDER BY coalesce(times.n, 0) DESC, medication_id) AS place
           FROM medication LEFT JOIN times USING (medication_id))
SELECT medication_id, medication_name, n AS times_prescribed, concat(stock_quantity, ' ', unit) AS stock
FROM ranked WHERE place <= 10"""),
    "patients_basic": _q(f"""
SELECT patient_id, first_name || ' ' || last_name AS full_name, {_d("date_of_birth")} AS date_of_birth,
       gender, phone FROM patient"""),
    "patients_registered_since": _q(f"""
SELECT patient_id, first_name || ' ' || last_name AS full_name, {_d("registration_date")} AS registration_date
FROM patient WHERE registration_date >= DATE '2024-01-01'"""),
    "clinic_visits_by_status": _q(f"""
SELECT a.appointment_id, {NAME} AS patient_name, {_d("a.appointment_date")} AS appointment_date,
       a.reason, a.status
FROM appointment a JOIN patient p ON a.patient_id = p.patient_id
WHERE a.clinic_id = 1 AND a.status = 'Completed'"""),
    "bills_by_amount": _q(f"""
, named AS (SELECT patient_id, {NAME} AS patient_name FROM patient p)
SELECT bill_id, (SELECT patient_name FROM named WHERE named.patient_id = bill.patient_id) AS patient_name, {_m("total_amount")} AS total_amount,
       {_m("amount_paid")} AS amount_paid, {_m("total_amount - amount_paid")} AS outstanding_balance, payment_status
FROM bill"""),
    "appointments_per_clinic": _q("""
, visits AS (SELECT clinic_id, count(*) AS n FROM appointment GROUP BY clinic_id)
SELECT clinic_id, clinic_name, coalesce(n, 0) AS total_appointments FROM clinic LEFT JOIN visits USING (clinic_id)"""),
    "revenue_by_billed_clinic": _q(f"""
, placed AS (SELECT (SELECT a.clinic_id FROM appointment a WHERE a.appointment_id = bill.appointment_id) AS clinic_id, total_amount, amount_paid FROM bill),
per_clinic AS (SELECT clinic_id, sum(total_amount) AS total, sum(amount_paid) AS paid FROM placed GROUP BY clinic_id)
SELECT clinic_id, clinic_name, {_m("total")} AS total_billed, {_m("paid")} AS total_collected, {_m("total - paid")} AS total_outstanding
FROM per_clinic JOIN clinic USING (clinic_id)"""),
    "billing_per_patient": _q(f"""
, per_patient AS (SELECT patient_id, count(*) AS n, sum(total_amount) AS total FROM bill GROUP BY patient_id)
SELECT x.patient_id, {NAME} AS patient_name, n AS number_of_visits, {_m("total")} AS total_billed,
       CAST((CAST(total * 100 AS HUGEINT) * 20000 + n) // (2 * n) AS DOUBLE) / 1000000 AS avg_bill_amount
FROM per_patient x JOIN patient p USING (patient_id)"""),
    "outstanding_by_patient_status": _q(f"""
, open_ AS (SELECT patient_id, payment_status, sum(total_amount) - sum(amount_paid) AS balance
               FROM bill WHERE payment_status <> 'Paid' GROUP BY ALL)
SELECT p.patient_id, {NAME} AS patient_name, p.phone, {_m("open_.balance")} AS outstanding_balance, open_.payment_status
FROM open_ JOIN patient p USING (patient_id)"""),
    "diagnosis_counts": _q("""
SELECT diagnosis_code, description, count(*) AS total_cases,
       count(*) FILTER (severity = 'Severe') AS severe_cases,
       count(*) FILTER (severity = 'Moderate') AS moderate_cases,
       count(*) FILTER (severity = 'Mild') AS mild_cases
FROM diagnosis GROUP BY ALL"""),
    "top_prescribed_medications": _q("""
, times AS (SELECT medication_id, count(*) AS n FROM prescription GROUP BY medication_id),
ranked AS (SELECT medication_id, n, row_number() OVER (ORDER BY n DESC, medication_id) AS place
           FROM times WHERE medication_id IN (SELECT medication_id FROM medication))
SELECT medication_id, medication_name, unit, n AS times_prescribed
FROM ranked JOIN medication USING (medication_id) WHERE place <= 5"""),
    "latest_patients": _q(f"""
SELECT patient_id, first_name || ' ' || last_name AS full_name, {_d("registration_date")} AS registration_date
FROM patient ORDER BY registration_date DESC, patient_id LIMIT 5"""),
    "full_visit_history": _with_firsts(f"""
, v AS (SELECT a.appointment_id, a.patient_id, a.appointment_date, {NAME} AS patient_name, c.clinic_name
        FROM appointment a JOIN patient p ON a.patient_id = p.patient_id
        JOIN clinic c ON a.clinic_id = c.clinic_id),
rows AS (
  SELECT v.*, d.description AS diagnosis, d.severity, b.total_amount, b.payment_status
  FROM v JOIN diagnosis d ON v.appointment_id = d.appointment_id
         JOIN fb b ON v.appointment_id = b.appointment_id
  UNION ALL
  SELECT v.*, d.description, d.severity, b.total_amount, b.payment_status
  FROM v JOIN xb b ON v.appointment_id = b.appointment_id
         JOIN fd d ON v.appointment_id = d.appointment_id)
SELECT patient_id, patient_name, {_d("appointment_date")} AS appointment_date, clinic_name, diagnosis,
       severity, {_m("total_amount")} AS total_amount, payment_status
FROM rows"""),
    "clinic_directory": _q("SELECT clinic_id, clinic_name FROM clinic"),
    "appointment_statistics": _q("""
SELECT c.clinic_id, c.clinic_name, count(a.appointment_id) AS total_appointments,
       count(a.appointment_id) FILTER (WHERE a.status = 'Scheduled') AS scheduled_appointments,
       count(a.appointment_id) FILTER (WHERE a.status = 'Completed') AS completed_appointments,
       count(a.appointment_id) FILTER (WHERE a.status = 'Cancelled') AS cancelled_appointments
FROM clinic c LEFT JOIN appointment a ON c.clinic_id = a.clinic_id
GROUP BY c.clinic_id, c.clinic_name"""),
    "medication_inventory_report": _q("""
SELECT m.medication_id, m.medication_name, m.unit, CAST(m.stock_quantity AS BIGINT) AS stock_quantity,
       m.description, count(pr.prescription_id) AS times_prescribed
FROM medication m LEFT JOIN prescription pr ON m.medication_id = pr.medication_id
GROUP BY m.medication_id, m.medication_name, m.unit, m.stock_quantity, m.description"""),
    "patient_activity": _q(f"""
SELECT p.patient_id, {NAME} AS patient_name,
       (SELECT count(*) FROM appointment a WHERE a.patient_id = p.patient_id) AS visits,
       (SELECT count(*) FROM diagnosis d JOIN appointment a ON d.appointment_id = a.appointment_id
         WHERE a.patient_id = p.patient_id) AS diagnoses,
       {_m("(SELECT coalesce(sum(b.total_amount), 0) FROM bill b WHERE b.patient_id = p.patient_id)")} AS total_billed,
       {_m("(SELECT coalesce(sum(b.amount_paid), 0) FROM bill b WHERE b.patient_id = p.patient_id)")} AS total_paid,
       {_m("(SELECT coalesce(sum(b.total_amount - b.amount_paid), 0) FROM bill b WHERE b.patient_id = p.patient_id)")}
         AS total_outstanding
FROM patient p"""),
    "monthly_revenue": _q(f"""
SELECT {_d("CAST(date_trunc('month', bill_date) AS DATE)")} AS month, count(*) AS bills,
       {_m("sum(total_amount)")} AS total_billed, {_m("sum(amount_paid)")} AS total_collected,
       {_m("sum(total_amount - amount_paid)")} AS total_outstanding
FROM bill GROUP BY date_trunc('month', bill_date)"""),
}
