"""Reports from the ledger equal those from the tables after random batches, without a scan of the bills."""

import random

import pytest

from carelake.operators import changes as C
from carelake.plans import reports as R
from carelake.plans import upkeep as U
from carelake.session import stored
from carelake.sources.tables import Tables, load_tables

BILLS = "seq long, appointment_id string, total_amount string, amount_paid string, bill_date string"
VISITS = ("seq long, patient_id string, staff_id string, clinic_id string, appointment_date string, appointment_time string, "
          "reason string, status string")


def rows(df):
    return [tuple(r) for r in df.collect()]


def assert_kept_up(ledger, t):
    assert rows(U.dashboard_metrics(ledger)) == rows(R.dashboard_metrics(t))
    assert rows(U.dashboard_metrics(ledger, display=True)) == rows(R.dashboard_metrics(t, display=True))
    assert rows(U.revenue_by_clinic(ledger, t.clinic)) == rows(R.revenue_by_clinic(t))
    assert rows(U.revenue_by_billed_clinic(ledger, t.clinic)) == rows(R.revenue_by_billed_clinic(t))
    assert rows(U.monthly_revenue(ledger)) == rows(R.monthly_revenue(t))


@pytest.fixture(scope="module")
def written_tables(spark, seed, tmp_path_factory):
    folder = tmp_path_factory.mktemp("clinic")
    for name in seed:
        seed[name].write.parquet(str(folder / name))
    return str(folder)


def test_three_random_batches(spark, written_tables):
    t, rng = load_tables(spark, written_tables), random.Random(5)
    ledger = stored(U.of_tables(t), "ledger")
    assert_kept_up(ledger, t)
    high = {"appointment": 10_000, "bill": 20_000}
    for _ in range(3):
        ids = [r[0] for r in t.appointment.select("appointment_id").collect()]
        bill_ids = [r[0] for r in t.bill.select("bill_id").collect()]
        visits = [(i, str(rng.randint(0, 6)), str(rng.randint(1, 5)), str(rng.randint(0, 5)), f"2024-0{rng.randint(1, 9)}-11", "10:00", "Check",
                   rng.choice(["Cancelled", "Scheduled", "Done"])) for i in range(12)]
        new_visits = C.register_appointments(t, spark.createDataFrame(visits, VISITS), high["appointment"])
        taken = [(i, str(rng.choice(bill_ids + [-1])), rng.choice(["1000", "12.345", "0", "x", "99999999"])) for i in range(15)]
        paid = C.apply_payments(t.bill, spark.createDataFrame(taken, "seq long, bill_id string, amount string")).stored()
        t2 = t.replace(appointment=stored(new_visits.table, "appointment"), bill=stored(paid.table, "bill"))
        bills = [(i, str(rng.choice(ids + list(range(10_001, 10_030)))), str(rng.randint(0, 500)), str(rng.randint(0, 300)),
                  f"202{rng.randint(3, 5)}-1{rng.randint(0, 2)}-05") for i in range(15)]
        billed = C.create_bills(t2, spark.createDataFrame(bills, BILLS), high["bill"])
        t3 = t2.replace(bill=stored(billed.table, "bill"))
        asked = [(i, str(a)) for i, a in enumerate(rng.choices(ids + [77_777], k=10))] + [(99, str(ids[0])), (100, "x")]
        gone = C.delete_restrict(t3, "appointment", spark.createDataFrame(asked, "seq long, id string"), guard=("status", "Cancelled"))
        accepted = stored(gone.accepted, "gone")
        ledger = stored(U.merged(ledger, U.of_new_visits(new_visits.accepted), U.of_payments(paid.moved, t.appointment),
                                 U.of_new_bills(billed.accepted, t2.appointment), U.of_deleted_visits(accepted, t3.appointment)), "ledger")
        t = t3.replace(appointment=stored(gone.table, "appointment"))
        assert_kept_up(ledger, t)
        high = {"appointment": high["appointment"] + 100, "bill": high["bill"] + 100}


def test_the_bills_are_not_read_again(spark, written_tables):
    t = load_tables(spark, written_tables)
    ledger = stored(U.of_tables(t), "ledger")
    paid = C.apply_payments(t.bill, spark.createDataFrame([(1, "2", "5")], "seq long, bill_id string, amount string")).stored()
    billed = C.create_bills(t, spark.createDataFrame([(1, "4", "50", "", "2024-06-01")], BILLS), 900)
    after = U.merged(ledger, U.of_payments(paid.moved, t.appointment), U.of_new_bills(billed.accepted, t.appointment))
    read = after.inputFiles()
    assert any("/appointment/" in f for f in read) and not any("/bill/" in f for f in read)


def test_bills_without_visit_or_date_and_empty_tables(spark, seed):
    lost = spark.createDataFrame([(901, 1, 777_777, "10.00", "4.00", None, "Partial"), (902, 1, None, "7.00", "0.00", "2024-05-03", "Unpaid")],
                                 "bill_id long, patient_id long, appointment_id long, total string, paid string, day string, payment_status string")
    lost = lost.selectExpr("bill_id", "patient_id", "appointment_id", "cast(total as decimal(10,2)) total_amount",
                           "cast(paid as decimal(10,2)) amount_paid", "cast(day as date) bill_date", "payment_status")
    t = seed.replace(bill=seed.bill.unionByName(lost))
    assert_kept_up(U.of_tables(t), t)
    empty = Tables({name: df.limit(0) for name, df in seed.items()})
    assert_kept_up(U.of_tables(empty), empty)
