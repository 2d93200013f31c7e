"""Validation, scores, mapping, record assembly."""

from tidyshelf.operators import conflicts, mapping, score, validate
from tidyshelf.operators.normalize import TEXT_FIELDS, normalize


def product(spark, **given):
    row = {f: "" for f in TEXT_FIELDS} | {"price": None, "row_idx": 0} | given
    types = ", ".join(f"{k} " + {"price": "double", "row_idx": "long"}.get(k, "string") for k in row)
    df = spark.createDataFrame([tuple(row.values())], types)
    return df.selectExpr("*", "map('price', 'ask') AS raw_data",
                         "cast(map() AS map<string,string>) AS additional_attributes")


def test_invalid_row(spark):
    df = validate.validate(product(spark, product_name="X", price=-50.0,
                                   product_url="httpx://bad-url", power="5 A", voltage="loop",
                                   ip_rating="Open", technical_document="x"))
    issues = {(r["field"], r["issue_type"], r["severity"]) for r in
              validate.issue_rows(df).collect()}
    assert df.first()["validation_status"] == "invalid"
    assert issues == {
        ("product_id", "missing_value", "high"), ("product_name", "missing_value", "high"),
        ("category", "missing_value", "high"), ("brand", "missing_value", "medium"),
        ("price", "out_of_range", "high"), ("power", "unit_mismatch", "medium"),
        ("voltage", "invalid_format", "low"), ("ip_rating", "invalid_format", "low"),
        ("product_url", "invalid_url", "low"), ("technical_document", "invalid_url", "low"),
        ("description", "missing_value", "low")}


def test_valid_row(spark):
    df = validate.validate(product(
        spark, product_id="PID-100", product_name="Servo Motor", brand="Siemens",
        category="Motors", price=1250.0, power="5.5 kW", voltage="400 V", ip_rating="IP65",
        description="Permanent magnet servo motor with resolver."))
    assert df.first()["validation_status"] == "valid" and df.first()["issues"] == []


def test_full_row_scores_100(spark):
    row = product(spark, product_id="P", product_name="ABB Motor", brand="ABB", category="M",
                  subcategory="I", model_number="M3", description="High efficiency motor, 3 phases",
                  price=1500.0, voltage="400 V", power="15.0 kW", weight="85.0 kg",
                  dimensions="4 x 3 x 3 mm", ip_rating="IP55", supplier="A",
                  product_url="https://example.com")
    got = score.score(validate.validate(row)).first()
    assert got["completeness_score"] == 1.0 and got["quality_score"] == 100.0
    hit = score.score(validate.validate(row), spark.range(1).toDF("row_idx")).first()
    assert hit["source_agreement_score"] == 0.6 and hit["quality_score"] == 96.0


CATALOGUES = [
    ({"Mfg_Part_Num": "ABB-1", "Part_Desc": "Heavy Motor 15kW", "E1_Brand": "ABB",
      "Part_Manuf": "ABB"}, ["mpn", "product_description", "brand", "manufacturer"]),
    ({"SKU": "SKU-1", "Item_Name": "AC Motor", "Maker": "Nidec", "Supplier": "North",
      "Price": "3450.00"}, ["sku", "product_name", "manufacturer", "supplier", "price"]),
    ({"ProductCode": "PRD-1", "LongDescription": "Duty Motor 20 HP", "ManufacturerName": "B",
      "BrandName": "B", "VoltageRating": "460 V AC", "WeightKg": "142.5"},
     ["product_identifier", "product_description", "manufacturer", "brand", "voltage", "weight"]),
    ({"MFR": "12.5", "Width": "7", "Blatt": "https://a.b/c.pdf", "Colour": "red"},
     ["additional_attributes", "product_identifier", "technical_document",
      "additional_attributes"]),
]


def test_mapping_of_catalogues(spark):
    for row, want in CATALOGUES:
        df = spark.createDataFrame([(0, *row.values())], ["row_idx", *row])
        got = mapping.analyze(df).orderBy("position").collect()
        assert [r["canonical_field"] for r in got] == want, row


def test_fingerprint_is_stable(spark):
    df = spark.createDataFrame([(0, "x", "y"), (1, "z", "w")], "row_idx long, b string, a string")
    one = mapping.fingerprint(df).first()[0]
    assert len(one) == 64 and one == mapping.fingerprint(df.repartition(3)).first()[0]


def test_first_filled_column_wins_and_rest_is_left_over(spark):
    df = spark.createDataFrame(
        [(0, "", "Diablo", "3M", "x"), (1, "ABB", "ABB", "", " ")],
        "row_idx long, E1_Brand string, Unilog_Brand string, DIB_Brand string, Extra string")
    by = {c: "brand" for c in ("E1_Brand", "Unilog_Brand", "DIB_Brand")}
    rows = normalize(df, by).orderBy("row_idx").collect()
    assert [r["brand"] for r in rows] == ["Diablo", "ABB"]
    assert rows[0]["additional_attributes"] == {"DIB_Brand": "3M", "Extra": "x"}
    assert rows[1]["additional_attributes"] == {"Unilog_Brand": "ABB"}
    assert rows[0]["product_name"] == "Industrial Equipment Component"
    found = conflicts.brand_conflicts(normalize(df, by), df.columns[1:]).collect()
    assert [(r["row_idx"], r["value_a"], r["value_b"]) for r in found] == [(0, "3M", "Diablo")]
