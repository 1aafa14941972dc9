"""Scalars, names in files and the weight grammar, by golden cases."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import numbers as n
from tallyforge.functions import text as t
from tallyforge.functions import weights as w
from tallyforge.operators import etl
from tallyforge.operators.cube import day_coverage
from tallyforge.sources.files import SHEET_ROWS, sheet_guard, sniff


@pytest.mark.parametrize(
    ("title", "unit", "total"),
    [
        ("Сахар 1кг", 1.0, 1.0),
        ("Мыло 3 шт. - 175 г", 0.175, 0.525),
        ("Мыло 4 x 90 г", 0.09, 0.36),
        ("Соус 2 по 1,5 л", 1.5, 3.0),
        ("Чай 10 г * 100 шт", 0.01, 1.0),
        ("Соус 600 мл, комплект: 16 упаковок по 600 г", 0.6, 9.6),
        ("Масло 7 упаковок по 1 л", 1.0, 7.0),
    ],
)
def test_weights_in_titles(title, unit, total):
    found = w.parse(title)
    assert found == pytest.approx((unit, total))


def test_titles_without_weight():
    assert w.parse(None) is None and w.parse("") is None and w.parse("Соус 100млн") is None


def test_sanitised_weights():
    kg, odd, why = w.sanitise("Средство 174л", 174.0)
    assert (kg, odd) == (1.74, True) and "fixed_liters" in why
    assert w.sanitise("x", None)[2] == "empty_or_bad"
    assert w.sanitise("Шампунь 1000500 мл", 1000.5)[0] == 0.5
    assert w.sanitise("x", 50.0)[2].startswith("too_big")
    assert w.sanitise("x", 2.0) == (2.0, False, "ok")


def test_parsed_report(spark):
    row = ("01.02.2025", "Ozon", "Мыло", "12.0", "DAVE ", "Мыло 3 шт. - 175 г", "20", "Shop", "100", "2 000,50")
    df = spark.createDataFrame([row], [*etl.CANON])
    r = w.with_weights(df).first()
    assert r["Вес, кг (ед.)"] == pytest.approx(0.175) and r["Вес, кг"] == pytest.approx(0.525)
    assert r["Объем, кг"] == pytest.approx(10.5) and r["Цена за кг"] == pytest.approx(100 / 0.525)
    assert (r["SKU"], r["Бренд"], r["Год"], r["Вес аномалия"], r["Выручка, руб"]) == ("12", "dave", 2025, False, 2000.5)


def test_family_titles():
    assert w.family_title("Кокосовое масло Aroy-D, 500 мл, 6 шт", "Aroy-D", "Кокосовое масло") == "Кокосовое масло"
    assert w.family_title("Соус чили Heinz 350 г", "Heinz", "Соусы") == "Соус чили"
    assert w.family_title("", "x", "y") == ""


def test_dirty_numbers(spark):
    rows = [("1 234,5", 1234.5), ("5d", None), ("", None), (None, None), ("-2.5", -2.5), ("1e3", 1000.0), ("12 000", 12000.0)]
    df = spark.createDataFrame(rows, "x string, y double").withColumn("z", n.num(F.col("x")))
    assert all(r.y == r.z for r in df.collect())


def test_close_and_packs(spark):
    r = spark.range(1).select(
        n.close(F.lit(1.0), F.lit(1.04), 0.02, 0.05).alias("a"), n.close(F.lit(None), F.lit(1.0), 1, 1).alias("b"), n.multipack(F.lit(2.0), F.lit(5.0)).alias("c"), n.multipack(F.lit(4.0), F.lit(1.0)).alias("d"), n.multipack_at_least_one(F.lit(4.0), F.lit(1.0)).alias("e")
    )
    assert tuple(r.first()) == (True, False, 2.0, None, 1.0)


def test_names_in_files(spark):
    assert etl.filename_date("ozon_2024-02-30_01.03.2024__Соусы.csv") == date(2024, 3, 1)
    assert etl.filename_date("x20240105.csv") is None and etl.filename_date("x 20240105.csv") == date(2024, 1, 5)
    df = spark.createDataFrame([("wb_a__Соусы.csv",), ("none.csv",)], "f string")
    assert [tuple(r) for r in df.select(etl.filename_marketplace(F.col("f")), etl.filename_category(F.col("f"))).collect()] == [("Wildberries", "Соусы"), ("Unknown", "Unknown")]


def test_tokens_and_empties(spark):
    df = spark.createDataFrame([("Соус Чили острый 200 мл",), (None,)], "x string")
    assert [r[0] for r in df.select(t.flavors(F.col("x"))).collect()] == [["острый", "чили"], []]
    assert [r[0] for r in df.select(t.is_empty(F.col("x"))).collect()] == [False, True]


def test_day_coverage():
    today = date(2024, 3, 10)
    assert day_coverage(2024, 2, today) == (29, 29, date(2024, 2, 29))
    assert day_coverage(2024, 3, today) == (10, 31, date(2024, 3, 10))
    assert day_coverage(2024, 4, today) == (0, 30, None)


def test_sniffing_and_limits():
    assert sniff("﻿a;b\n1;2\n".encode()) == ("utf-8-sig", ";")
    assert sniff("а,б\n1,2\n".encode("cp1251")) == ("cp1251", ",")
    with pytest.raises(ValueError, match="rows"):
        sheet_guard(SHEET_ROWS + 1)
