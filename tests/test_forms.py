"""C1/C2 for every entry form (declarative specs)."""


from carelake.operators import forms as FM


def test_insert_patients(spark, seed):
    b = spark.createDataFrame([
        (1, "Ama", "Kanu", "1990-1-2", "Female", "1 Road", "+232", "None", "2024-05-01"),
        (2, "", "Kanu", "1990-01-02", "Female", "1 Road", "+232", "O+", "2024-05-01"),
        (3, "Ama", "Kanu", "1990-02-30", "Female", "1 Road", "+232", "O+", "2024-05-01"),
        (4, "Ama", "Kanu", "1990-01-02", "Unknown", "1 Road", "+232", "Z", "2024-05-01"),
        (5, "Ama", "K" * 51, "1990-01-02", "Other", "1 Road", "+232", "AB-", " 2024-5-1 "),
    ], "seq long, first_name string, last_name string, date_of_birth string, gender string, "
       "address string, phone string, blood_type string, registration_date string")
    ch = FM.insert_rows(seed, "patient", b, high_water=10)
    acc = {r.patient_id: r for r in ch.accepted.collect()}
    assert sorted(acc) == [11]
    assert acc[11].blood_type is None and str(acc[11].date_of_birth) == "1990-01-02"
    rej = {r.seq: r.errors for r in ch.rejected.collect()}
    assert rej[2] == ["First Name is required"]
    assert rej[3] == ["Date of Birth must be a date (YYYY-MM-DD)"]
    assert rej[4] == ["Gender must be one of Male, Female, Other",
                      "Blood Type must be one of A+, A-, B+, B-, AB+, AB-, O+, O-"]
    assert rej[5] == ["Last Name is longer than 50 characters"]
    assert ch.table.count() == 11


def test_insert_prescription_and_diagnosis(spark, seed):
    p = spark.createDataFrame([
        (1, "1", "2", "500mg", "Daily", "0", "2024-05-01"), (2, "1", "2", "500mg", "Daily", "-1", "2024-05-01"),
        (3, "1", "2", "500mg", "Daily", "5.0", "2024-05-01"), (4, "1", "2", " ", "Daily", "5", "2024-05-01"),
        (5, "99", "2", "500mg", "Daily", "5", "2024-05-01"), (6, "1", "2", "500mg", "Daily", " 7 ", "2024-05-01"),
    ], "seq long, diagnosis_id string, medication_id string, dosage string, frequency string, "
       "duration_days string, prescribed_date string")
    ch = FM.insert_rows(seed, "prescription", p, high_water=14)
    assert [(r.prescription_id, r.duration_days) for r in ch.accepted.collect()] == [(15, 7)]
    assert sorted(r.seq for r in ch.rejected.collect()) == [1, 2, 3, 4, 5]
    d = spark.createDataFrame([(1, "13", "A00", "Cholera", "", "2024-06-10")],
                              "seq long, appointment_id string, diagnosis_code string, description string, "
                              "severity string, diagnosed_date string")
    r = FM.insert_rows(seed, "diagnosis", d, high_water=11).accepted.first()
    assert (r.diagnosis_id, r.severity) == (12, "Mild")


def test_update_medications(spark, seed):
    u = spark.createDataFrame([
        (1, "1", "Artemether", "", "tablet", "700"), (2, "2", "Amox", "x", "", "10"),
        (3, "77", "Ghost", "x", "tablet", "1"), (4, "3", "Metformin", "y", "tablet", "-4"),
        (5, "1", "Again", "", "tablet", "5"),
    ], "seq long, medication_id string, medication_name string, description string, unit string, "
       "stock_quantity string")
    ch = FM.update_rows(seed, "medication", u)
    assert [tuple(r) for r in ch.accepted.collect()] == [(1, 1, "Artemether", None, "tablet", 700)]
    new = {r.medication_id: r for r in ch.table.collect()}
    assert new[1].description is None and new[1].stock_quantity == 700 and new[2].medication_name == "Amoxicillin"
    rej = {r.seq: r.errors for r in ch.rejected.collect()}
    assert rej == {2: ["Unit is required"], 3: ["id does not exist"],
                   4: ["Stock Quantity must be a whole number, not negative"], 5: ["duplicate in batch"]}


def test_insert_clinics_and_staff(spark, seed):
    c = spark.createDataFrame([
        (1, "New Clinic", "Road 1, Town", "District A", "+232-1", "  ", ""),
        (2, "Other Clinic", "Road 2, Town", "District B", "+232-2", "x@y.z", "2020-2-29"),
        (3, "Bad Clinic", "Road 3", "District C", "", "", "2021-02-29"),
    ], "seq long, clinic_name string, location string, district string, phone string, email string, "
       "established_date string")
    ch = FM.insert_rows(seed, "clinic", c, high_water=5)
    acc = {r.clinic_id: r for r in ch.accepted.collect()}
    assert sorted(acc) == [6, 7]
    assert acc[6].email is None and acc[6].established_date is None
    assert str(acc[7].established_date) == "2020-02-29"
    assert [r.errors for r in ch.rejected.collect()] == [[
        "Phone is required", "Established Date must be a date (YYYY-MM-DD)"]]
    s = spark.createDataFrame([
        (1, "9", "Ada", "Lee", "Nurse", "Female", "+232-3", "", "2020-01-01"),
        (2, "2", "Bo", "Kai", "Doctor", "Male", "+232-4", "bo@x.y", "2020-01-01"),
    ], "seq long, clinic_id string, first_name string, last_name string, role string, gender string, "
       "phone string, email string, hire_date string")
    ch = FM.insert_rows(seed, "staff", s, high_water=8)
    assert [(r.staff_id, r.clinic_id) for r in ch.accepted.collect()] == [(9, 2)]
    assert [r.errors for r in ch.rejected.collect()] == [["Clinic does not exist"]]


def test_update_appointment_to_null_free_fields(spark, seed):
    u = spark.createDataFrame([(1, "12", "3", "1", "1", "2024-06-06", "9:15", "Respiratory re-check", "Cancelled")],
                              "seq long, appointment_id string, patient_id string, staff_id string, clinic_id string, "
                              "appointment_date string, appointment_time string, reason string, status string")
    ch = FM.update_rows(seed, "appointment", u)
    r = ch.table.where("appointment_id = 12").first()
    assert (str(r.appointment_date), r.appointment_time, r.status) == ("2024-06-06", "09:15:00", "Cancelled")
    assert ch.table.count() == 13
