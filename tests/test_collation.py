"""Text under a collation: facet, sort, grouped reports and names, on spellings that differ in case and accent."""

from pyspark.sql import functions as F

from carelake.functions import expr as X
from carelake.operators import changes as C
from carelake.operators import tableview as TV
from carelake.plans import reports as R

WORDS = ["Fever", "fever", "FEVER", "Fèver", "malaria", "Malaria", None, "12", "3"]


def _words(spark):
    return spark.createDataFrame(list(enumerate(WORDS)), "id int, word string")


def test_facet(spark):
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(TV.facet(_words(spark), "word", "fEVER", X.ANY_CASE)) == [0, 1, 2]
    assert ids(TV.facet(_words(spark), "word", "fEVER", "UNICODE_CI_AI")) == [0, 1, 2, 3]
    assert ids(TV.facet(_words(spark), "word", "All", X.ANY_CASE)) == list(range(len(WORDS)))
    assert ids(TV.facet(_words(spark), "word", "-", X.ANY_CASE)) == [6]
    assert TV.facet(_words(spark), "word", "fever", X.ANY_CASE).schema == _words(spark).schema


def test_sort(spark):
    order = lambda *a, **k: [r.id for r in TV.typed_sort(_words(spark), "word", *a, base_order=[F.col("id")], **k).collect()]
    assert order(collation=X.ANY_CASE) == [8, 7, 6, 0, 1, 2, 3, 4, 5]  # numbers first, then text, page order among equals
    assert order(False, collation=X.ANY_CASE) == [4, 5, 3, 0, 1, 2, 6, 7, 8]
    assert order(mode="typed") == [6, 7, 8, 2, 0, 3, 5, 1, 4]
    assert order(mode="typed", collation=X.ANY_CASE) == [6, 7, 8, 0, 1, 2, 3, 4, 5]
    page = TV.table_view(_words(spark), facet_on=("word", "MALARIA"), sort_on=("word", True), base_order=[F.col("id").desc()], collation=X.ANY_CASE)
    assert [r.id for r in page.collect()] == [5, 4]


def test_grouped_reports(spark, seed):
    """Every second diagnosis and bill in capitals: the same counts and sums, in the least spelling, plain text out."""
    half = lambda df, c, k: df.withColumn(c, F.when(F.col(k) % 2 == 0, F.upper(c)).otherwise(F.col(c)))
    mixed = seed.replace(diagnosis=half(half(half(seed.diagnosis, "description", "diagnosis_id"), "severity", "diagnosis_id"), "diagnosis_code", "diagnosis_id"),
                         bill=half(seed.bill, "payment_status", "bill_id"))
    for report in (R.common_diagnoses, R.diagnosis_counts):
        want = [(r.diagnosis_code.lower(), r.description.lower(), *r[2:]) for r in report(seed).collect()]
        got = report(mixed, collation=X.ANY_CASE)
        assert sorted((r.diagnosis_code.lower(), r.description.lower(), *r[2:]) for r in got.collect()) == sorted(want)
        assert got.schema["diagnosis_code"].dataType.simpleString() == "string"
        assert [r.total_cases for r in got.collect()] == sorted([w[2] for w in want], reverse=True)
    want = {(r.patient_id, r.payment_status.lower(), r.outstanding_balance) for r in R.outstanding_by_patient_status(seed).collect()}
    got = R.outstanding_by_patient_status(mixed, collation=X.ANY_CASE).collect()
    assert {(r.patient_id, r.payment_status.lower(), r.outstanding_balance) for r in got} == want
    assert len(R.outstanding_by_patient_status(mixed).collect()) < len(got)


def test_lists_order_names_in_any_case(spark, seed):
    mixed = seed.replace(patient=seed.patient.withColumn("last_name", F.when(F.col("patient_id") % 2 == 0, F.lower("last_name")).otherwise(F.col("last_name"))))
    ids = lambda df: [r.patient_id for r in df.collect()]
    assert ids(R.patient_list(mixed, collation=X.ANY_CASE)) == ids(R.patient_list(seed)) != ids(R.patient_list(mixed))
    assert R.staff_directory(seed, collation=X.ANY_CASE).collect() == R.staff_directory(seed).collect()
    assert R.clinic_directory(seed, collation=X.ANY_CASE).collect() == R.clinic_directory(seed).collect()


def test_restock_by_name(spark, seed):
    name = seed.medication.orderBy("medication_id").first().medication_name
    batch = spark.createDataFrame([(1, f" {name.upper()} ", "5"), (2, name, "1"), (3, "nothing of the kind", "1")], "seq long, medication_name string, quantity string")
    ch = C.restock(seed.medication, batch, X.ANY_CASE)
    assert [(r.deliveries, r.added) for r in ch.accepted.collect()] == [(2, 6)]
    assert [(r.seq, r.errors) for r in ch.rejected.collect()] == [(3, ["Medication does not exist"])]
    assert [(r.deliveries, r.added) for r in C.restock(seed.medication, batch).accepted.collect()] == [(1, 1)]


def test_restock_by_a_name_that_many_share(spark, seed):
    rows = [(i, f"Same {'name' if i % 2 else 'NAME'}", None, "tablet", C.MOST_STOCK if i == 1 else 1) for i in range(1, 301)] + [(301, "Other", None, "tablet", 1)]
    stock = spark.createDataFrame(rows, seed.medication.schema)
    texts = [(i, ["same name", " SAME NAME", "Same Name "][i % 3], str(i % 2)) for i in range(400)] + [(400, "other", "7"), (401, "gone", "1"), (402, None, "x")]
    ch = C.restock(stock, spark.createDataFrame(texts, "seq long, medication_name string, quantity string"), X.ANY_CASE)
    plan = ch.accepted._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "Join" in line and "_asked" in line)
    assert any("Aggregate" in line and "_asked" in line for line in plan[at + 1:]), "deliveries are summed per name before they meet the medications"
    got = {r.medication_id: (r.deliveries, r.added) for r in ch.accepted.collect()}
    assert got == {**{i: (200, 200) for i in range(2, 301)}, 301: (1, 7)}
    errors = ch.rejected.groupBy("seq", F.array_join("errors", "; ").alias("errors")).count().collect()
    want = {(i, "Quantity must be a whole number greater than zero"): 300 for i in range(0, 400, 2)}
    want |= {(i, "Stock would exceed its limit"): 1 for i in range(1, 400, 2)}
    want |= {(401, "Medication does not exist"): 1, (402, "Quantity must be a whole number greater than zero; Medication does not exist"): 1}
    assert {(r.seq, r.errors): r["count"] for r in errors} == want
    assert {r.medication_id: r.stock_quantity for r in ch.table.where("medication_id < 3").collect()} == {1: C.MOST_STOCK, 2: 201}
