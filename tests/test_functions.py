import pytest
from pyspark.sql import functions as F

from siltstone.functions import contact, money, text, validate


def value(spark, expr, *args):
    df = spark.createDataFrame([tuple(args) or (None,)], ", ".join(f"a{k} string" for k in range(max(1, len(args)))))
    out = df.select(expr(*[F.col(f"a{k}") for k in range(len(args))]).alias("x")).first()["x"]
    return tuple(out) if hasattr(out, "asDict") else out


@pytest.mark.parametrize(
    "given, low, high",
    [
        ("Rs. 50 Lakhs - 75 Lakhs", 5000000, 7500000),
        ("upto 20 Lakhs", None, 2000000),
        ("1.5 Cr - 2 Cr", 15000000, 20000000),
        ("Above ₹10 Lakhs", 1000000, None),
        ("2.3 lakh", 229999, None),
        ("50 Lakhs - 1 Crore", 5000000, 100000),
        ("", None, None),
        (None, None, None),
    ],
)
def test_investment_range(spark, given, low, high):
    assert value(spark, money.investment_range, given) == (low, high)


@pytest.mark.parametrize("given, low, high", [("1000 - 2000 sq ft", 1000, 2000), ("500 sq ft", 500, None), ("1,000 sq ft", 1, 0)])
def test_area_range(spark, given, low, high):
    assert value(spark, money.area_range, given) == (low, high)


@pytest.mark.parametrize(
    "check, given, want",
    [
        (validate.name, "Beatbox Gym", "Beatbox Gym"),
        (validate.name, "Franchise Opportunity", None),
        (validate.year, "Established in 2016", "2016"),
        (validate.year, "Not Revealed", None),
        (validate.duration, "5 Years", "5"),
        (validate.duration, "Yes", None),
        (validate.phones, "+91 99999-88888", "+91 99999-88888"),
        (validate.phones, "3000 - 5000", None),
        (validate.phones, "+91 99999-88888, short, +91-11111-22222", "+91 99999-88888, +91-11111-22222"),
        (validate.email, "contact@beatboxgym.com", "contact@beatboxgym.com"),
        (validate.email, "invalid_email", None),
        (validate.numbers, "30% - 40%", "30 - 40"),
        (validate.numbers, "High Return", None),
        (validate.investment, "Rs. 15Lakhs - 20Lakhs", "₹15 Lakhs - ₹20 Lakhs"),
        (validate.investment, "Moderate", None),
        (validate.investment, "5%", "₹5"),
        (validate.area, "3000 - 5000 Sq.ft", "3000-5000 Sq.ft"),
        (validate.area, "Spacious Room", None),
        (money.hours_text, "8 Hours", "8 hrs/month"),
        (money.currency, "₹25 Lakhs", "2500000"),
        (money.currency, "Rs. 5.5 Lakhs", "550000"),
        (money.currency, "INR 50,000", "50000"),
        (money.currency, "$10,000", "10000"),
        (money.currency, "1.2 Crore", "12000000"),
        (money.currency, "$60,000", None),
        (money.currency, "2 - 3 Lakhs", "200000 - 300000"),
        (money.quantity, "500 Sq Ft", "500"),
        (money.quantity, "30%", "30"),
        (money.quantity, "10 yr", "10"),
        (money.quantity, "none", None),
        (contact.phone, "9876543210", "+91 9876543210"),
        (contact.domain, "HTTPS://www.Example.com:8080/x", "example.com"),
        (contact.untracked, "https://a.b/c?utm_source=x&id=3&gclid=9", "https://a.b/c?id=3"),
        (contact.untracked, "https://a.b/c?utm_source=x", "https://a.b/c"),
        (text.field_name, "Expected No of Hours", "expected_no_of_hours"),
        (text.field_name, " Franchise - Fee ", "franchise_fee"),
    ],
)
def test_values(spark, check, given, want):
    assert value(spark, check, given) == want


@pytest.mark.parametrize(
    "key, given, want",
    [
        ("Phone", "+1 (555) 123-4567 ext 90", "+1 (555) 123-4567 ext 90"),
        ("Mobile", "+91-98765#43210", "+91-9876543210"),
        ("Email", " Admin@ACME.com ", "admin@acme.com"),
        ("Website", "www.cult.fit", "https://www.cult.fit"),
        ("Founded", "on 3/4/2021", "2021-04-03"),
    ],
)
def test_by_kind(spark, key, given, want):
    assert value(spark, contact.by_kind, key, given) == want


def test_lists(spark):
    df = spark.createDataFrame([(["Site selection", "Marketing", "Site selection"], "Space Required", ["Area Required", "Space", "Space Required"])], "a array<string>, n string, k array<string>")
    r = df.select(text.joined_distinct(F.col("a")).alias("a"), text.lookup_keys(F.col("n"), F.col("k")).alias("k"), text.slug(F.col("n"), "x").alias("s")).first()
    assert (r["a"], r["k"], r["s"]) == ("Site selection | Marketing", ["space_required", "area_required", "space"], "Space_Required")


def test_record_and_ranges(spark):
    df = spark.createDataFrame([("Rs. 15Lakhs - 20Lakhs", "3000 - 5000 Sq.ft", "", None)], "investment_required string, area_required string, phone string, email string")
    r = validate.ranges(validate.validated(df)).first()
    assert (r["investment_required"], r["area_required"], r["phone"], r["email"]) == ("₹15 Lakhs - ₹20 Lakhs", "3000-5000 Sq.ft", "", None)
    assert (r["investment_min"], r["investment_max"], r["area_min"], r["area_max"]) == (1500000.0, 2000000.0, 3000.0, 5000.0)
    assert r["normalized_from"] == {"normalized_from_investment_required": "Rs. 15Lakhs - 20Lakhs", "normalized_from_area_required": "3000 - 5000 Sq.ft"}


def test_label_pairs(spark):
    df = spark.createDataFrame([("Name: ABC\nInvestment: Rs. 20 Lakhs\nArea: 3000 sqft",), ("This company has operated since 2023.",)], "t string")
    assert [len(r["p"]) for r in df.select(text.label_pairs(F.col("t")).alias("p")).collect()] == [3, 0]
