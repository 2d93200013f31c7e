"""Exact values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from tidyshelf.functions import text, units


def values(spark, fn, cells):
    rows = [(i, c) for i, c in enumerate(cells)]
    df = spark.createDataFrame(rows, "i int, c string").select("i", fn(F.col("c")).alias("v"))
    return [r["v"] for r in df.orderBy("i").collect()]


@pytest.mark.parametrize("fn,cases", [
    (text.clean_text, {
        " a  b\t": "a b", "N/A": "", " - ": "", "nan": "", "<p>x</p><b>y": "x y", None: "",
        "a b": "a b", " ": "", "a < b": "a < b", "nano": "nano", "<b>nan</b>": "nan"}),
    (text.canonical_brand, {"abb": "ABB", "siemens simatic": "Siemens", " skf ": "SKF",
                            "Acme": "Acme", "n/a": ""}),
    (units.power_text, {
        "15 KW": "15.0 kW", "15000 W": "15.0 kW", "20 HP": "14.91 kW", "2 mw": "2000.0 kW",
        "250 kVA": "250.0 kVA", "7.5": "7.5 kW", "630 A Rating": "630 A Rating", "": "",
        "1.2.3 kW": "1.2.3 kW", "5 horse power": "3.73 kW", "30 watts": "0.03 kW",
        "12345678 kW": "12345678.0 kW", "0.0005 kW": "0.0005 kW"}),
    (units.power_value, {"20 HP": 14.91, "630 A Rating": None, "250 kVA": 250.0}),
    (units.voltage_text, {
        "400 V": "400 V", "0.4 kV": "400 V", "24 VDC": "24 V DC", "230/400V": "400 V",
        "380-415 volts": "380-415 V", "LOOP POWERED": "LOOP POWERED", "415 VAC": "415 V AC",
        "24VDC / 120VAC": "24 V DC AC", "": ""}),
    (units.frequency_text, {"50hz": "50 Hz", "50/60 Hz": "50/60 Hz", "60 HZ": "60 Hz",
                            "Direct Current": "DC", "5 MHz": "5 MHz"}),
    (units.rpm_text, {"1450 rpm": "1450 RPM", "max 3000": "3000 RPM", "variable": "variable"}),
    (units.weight_text, {
        "12.5 kg": "12.5 kg", "22 lbs": "10.0 kg", "450 g": "0.45 kg", "142.5": "142.5 kg",
        "86": "86.0 kg", "3 kilograms": "3.0 kg", "heavy": "heavy"}),
    (units.dimensions_text, {
        "10 x 20 x 30 mm": "10 x 20 x 30 mm", "1.5x2x3 cm": "15 x 20 x 30 mm",
        '1" x 2" x 3"': "25 x 51 x 76 mm", "L:10 W:7 H:9": "10 x 7 x 9 mm", "5 x 6": "5 x 6",
        "1.2.3 x 4 x 5 inch": "1.2.3 x 4 x 5 mm"}),
    (units.ip_text, {"ip55": "IP55", "IP 68": "IP68", "ip69k": "IP69K", "Ex d IIC": "EX D IIC",
                     "IP54 Outdoor": "IP54", "Open": "Open"}),
    (units.price_value, {"$1,234.50": 1234.5, "CONTACT SALES": None, "-50": -50.0, "$ -5": -5.0,
                         "1.2.3": None, None: None, "ref 7": 7.0}),
    (text.strip_promo, {"*** SALE *** pump": "pump", "a * b": "a * b"}),
    (text.repair_url, {"example.com/x": "https://example.com/x", "bad": "bad",
                       "http://a.b/c": "http://a.b/c", "": ""}),
    (text.is_url, {"https://www.example.com/a": True, "httpx://a.com": False,
                   "http://localhost:80": True, "http://a.museums": False}),
    (text.key_string, {"ABB-M 1": "abbm1", None: ""}),
    (text.compare_string, {" A  b,c! ": "a bc", "x_y-z.1": "x_y-z.1"}),
    (text.is_source_value, {"-- Unbranded --": False, " TBD ": False, "ABB": True, "": False}),
    (text.field_label, {"product_id": "Part Number / SKU", "lead_time": "Lead Time"}),
])
def test_values(spark, fn, cases):
    assert values(spark, fn, list(cases)) == list(cases.values())


def test_currency(spark):
    rows = [("$5", "", "USD"), ("5", "€", "EUR"), ("£5", "USD", "GBP"), ("5", "chf", "CHF"),
            ("5", "", "USD")]
    df = spark.createDataFrame(rows, "p string, c string, want string")
    got = df.select("want", units.currency_code(F.col("p"), F.col("c")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)
