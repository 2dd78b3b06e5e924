"""Gold hours and payslip comparison."""

from datetime import date

import pytest

from dutyflow import schemas
from dutyflow.functions import dates
from dutyflow.operators import payroll

H = {h: i for i, h in enumerate(schemas.HOURS)}


def duty(ord_, id_, category, match=None, codes=None, **hours):
    return (ord_, id_, category, match, codes, *[hours.get(h) for h in schemas.HOURS])


@pytest.fixture(scope="module")
def calendar(spark):
    return dates.calendar(spark, 2025, 2027).cache()


def profile(spark, family):
    duties = [
        duty(0, "NIGHT", "Bereitschaft", "night", None, paid_bd=6.03, bd_night=5.0, bd_night004=4.0),
        duty(1, "WORK", "Arbeit", "work"),
        duty(2, "ITS_MO_DO", "Hausdienst", None, ["ITS"], paid_bd=9.0, bd_night=4.5, bd_night004=6.0, active_night=4.0),
        duty(3, "ITS_FR_VF", "Hausdienst", None, [], paid_bd=9.0, bd_night=4.5, bd_night004=6.0),
        duty(4, "OP_MO_DO", "Rufdienst", None, ["OP"], paid_bd=4.5, bd_night=6.0, bd_night004=4.0),
        duty(5, "OP_SA_SO_FT_NACHT_VF", "Rufdienst", None, [], paid_bd=5.0),
    ]
    lines = [(0, "100", "Grundgehalt", "gross", True), (1, "304", "BD", "zuschlag", True), (2, "316", "Nacht", "zuschlag", True), (3, "LST", "Lohnsteuer", "deduction", True)]
    tariff = [("P8", 5, 3000.0, 23.23), ("III", 1, 6000.0, 40.0), ("III", 2, 6500.0, 42.0), ("III", 3, 7000.0, 44.0)]
    make = spark.createDataFrame
    return payroll.Profile(family, make(duties, schemas.DUTY_TYPES), make(lines, schemas.PAY_LINES), make(tariff, schemas.TARIFF))


def shifts(spark, *items):
    rows = [(i, "w", d, t, s, e, a, None) for i, (d, t, s, e, a) in enumerate(items)]
    return spark.createDataFrame(rows, "id int, workplace_id string, date date, type string, start string, end string, all_day boolean, actual string")


TYPES = [("N", None, None, "night", 0), ("F", "07:00", "15:00", "work", 1)]


def types(spark):
    return spark.createDataFrame(TYPES, "code string, start string, end string, duty_type string, ord int")


def test_nurse_hours(spark, calendar):
    s = shifts(
        spark,
        (date(2026, 7, 14), "N", "19:30", "07:30", False),
        (date(2026, 7, 31), "n", "19:30", "07:30", False),  # night into the next month
        (date(2026, 7, 18), "XX", "07:00", "15:00", False),  # Saturday, type by times
        (date(2026, 7, 20), "URLAUB", None, None, True),
        (date(2026, 7, 21), "KRANK", None, None, True),
        (date(2026, 7, 22), "FREI", None, None, True),
        (date(2026, 7, 23), "??", "01:00", "02:00", False),
    )
    got = {r["id"]: r for r in payroll.hours(s, profile(spark, payroll.NURSES), calendar, types(spark)).collect()}
    assert (got[0]["paid_bd"], got[0]["bd_night"], got[0]["bd_night004"]) == (6.03, 5.0, 4.0)
    assert (got[1]["bd_night"], got[1]["bd_night004"]) == (4.0, 0.0)
    assert got[2]["saturday_reg"] == 8.0 and got[2]["matched"]
    assert got[3]["vacation"] and got[3]["matched"]
    assert got[4]["matched"] and not got[4]["vacation"]
    assert not got[5]["matched"] and not got[5]["unmatched"]
    assert got[6]["unmatched"]


def test_physician_hours(spark, calendar):
    s = shifts(
        spark,
        (date(2026, 7, 14), "ITS", "16:00", "08:00", False),  # Tuesday
        (date(2026, 4, 30), "ITS", "16:00", "08:00", False),  # the eve of a holiday, into the next month
        (date(2026, 7, 18), "OP", "08:00", "08:00", False),  # Saturday
        (date(2026, 7, 15), "RD", "08:00", "08:00", False),
    )
    got = {r["id"]: r for r in payroll.hours(s, profile(spark, payroll.PHYSICIANS), calendar).collect()}
    assert (got[0]["duty_id"], got[0]["bd_night"], got[0]["bd_night004"], got[0]["active_night"]) == ("ITS_MO_DO", 4.5, 6.0, 4.0)
    assert (got[1]["duty_id"], got[1]["bd_sun_hol25"], got[1]["bd_night004"], got[1]["bd_night"]) == ("ITS_FR_VF", 0.0, 0.0, 4.0)
    assert got[2]["duty_id"] == "OP_SA_SO_FT_NACHT_VF"
    assert got[3]["duty_id"] == "OP_MO_DO"


def test_check_nurses(spark, calendar):
    s = shifts(spark, (date(2026, 6, 9), "N", "19:30", "07:30", False), (date(2026, 5, 9), "N", "19:30", "07:30", False))
    slips = spark.createDataFrame([("w", "2026-07", None, "P8", 5)], "workplace_id string, pay_month string, service_month string, eg string, stage int")
    lines = spark.createDataFrame(
        [("w", "2026-07", "304", "BD", 6.03, 23.23, 140.08), ("w", "2026-07", "316", "Nacht", 5.0, 3.48, 17.45), ("w", "2026-07", "LST", "Steuer", None, None, -50.0), ("w", "2026-07", "BRG", "Brutto", None, None, 2000.0), ("w", "2026-07", "100", "Grund", None, None, 1800.0)],
        "workplace_id string, pay_month string, la string, text string, qty double, rate double, amount double",
    )
    rows, total = payroll.check(s, slips, lines, profile(spark, payroll.NURSES), payroll.Tariff(), calendar, types(spark))
    got = {r["la"]: r for r in rows.collect()}
    assert set(got) == {"100", "304", "316", "317"}
    assert got["304"]["ok"] and got["304"]["expected_amount"] == 140.08
    assert got["316"]["ok"] is False and got["316"]["delta"] == pytest.approx(0.05)
    assert got["317"]["ok"] is None and got["317"]["actual_amount"] is None
    t = total.first()
    assert t["service_month"] == "2026-06" and t["actual_gross"] == 2000.0 and t["n_matched"] == 1


def test_check_physicians_and_other_family(spark, calendar):
    s = shifts(spark, (date(2026, 6, 9), "ITS", "16:00", "08:00", False))
    slips = spark.createDataFrame([("w", "2026-07", "2026-06", "III", 2)], "workplace_id string, pay_month string, service_month string, eg string, stage int")
    lines = spark.createDataFrame([("w", "2026-07", "100", "Grund", None, None, 6500.0)], "workplace_id string, pay_month string, la string, text string, qty double, rate double, amount double")
    rows, _ = payroll.check(s, slips, lines, profile(spark, payroll.PHYSICIANS), payroll.Tariff(shift_allowance=True), calendar)
    got = {r["la"]: r["expected_amount"] for r in rows.collect()}
    assert got["100"] == 6500.0 and got["200"] == 6.65 and got["245"] == 315.0
    assert got["304"] == 378.0  # 9 h x 42
    assert got["314"] == pytest.approx(4 * 8.05)  # a fifth of 7000 / 173.92
    rows, total = payroll.check(s, slips, lines, profile(spark, "other"), payroll.Tariff(), calendar)
    assert [r["la"] for r in rows.collect()] == ["100"]


def test_tariff_merge():
    t = payroll.merged_tariff(payroll.Tariff(eg="A", vl=1.0), payroll.Tariff(eg="B", stage=2), payroll.Tariff(eg="C"))
    assert (t.eg, t.stage, t.vl) == ("C", 2, 1.0)
