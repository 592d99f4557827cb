"""Scalar functions against the reference's inline cases."""

import pytest
from pyspark.sql import functions as F

from runlens.functions import text as T


def one(spark, col, **vals):
    schema = ", ".join(f"{k} string" for k in vals) or "x string"
    df = spark.createDataFrame([tuple(vals.values()) or (None,)], schema)
    return df.select(col.alias("r")).first()["r"]


@pytest.mark.parametrize("err,expected", [
    (None, "Unknown error"),
    ("", "Unknown error"),
    ("HTTPError('422 Client Error: Unprocessable Entity for url: https://api.zenrows.com/v1/?apikey=x&url=y')"
     "Traceback (most recent call last):", "422 Client Error: Unprocessable Entity - api.zenrows.com"),
    ("ValueError: bad value\nTraceback (most recent call last):\n  File x", "ValueError: bad value"),
    ("ReadTimeout: HTTPSConnectionPool", "Request timeout"),
    ("the request hit a Timeout", "Request timeout"),
    ("a" * 200, "a" * 147 + "..."),
    ("short message", "short message"),
])
def test_clean_error(spark, err, expected):
    assert one(spark, T.clean_error(F.col("e")), e=err) == expected


@pytest.mark.parametrize("name,error,expected", [
    ("BTC_scraper", None, "BTC"),
    ("ETH-USD price", None, "ETH"),
    ("zenrows_scraper", "failed for SOL token", "SOL"),
    ("BITCOIN_price", None, "BITCOIN"),
    ("scraper", "continue later", "DOGE"),  # loose substring family: 'INU' in CONTINUE
    ("due_diligence", None, "Unknown"),
    ("Zenrows_Scraper_BTC", None, "BTC"),
    ("website polygon check", None, "POLYGON"),
    ("cardano-node", None, "CARDANO"),
    ("ada token", None, "ADA"),
])
def test_symbol_text_scan(spark, name, error, expected):
    assert one(spark, T.crypto_symbol(None, F.col("n"), F.col("e")), n=name, e=error) == expected


def test_symbol_cascade_from_document(spark, docs_df):
    runs = [
        {"id": "1", "name": "x", "inputs": {"input_data": {"crypto_symbol": "btc"}}},
        {"id": "2", "name": "x", "inputs": {"input_data": {"name": " eth "}}},
        {"id": "3", "name": "x", "inputs": {"input_data": {"name": "a very long token name"}}, "metadata": {"symbol": "sol"}},
        {"id": "4", "name": "x", "extra": {"crypto": "doge"}},
        {"id": "5", "name": "MATIC_scraper"},
        {"id": "6", "name": "nothing here"},
    ]
    df = docs_df(runs)
    got = dict(df.select("run_id", T.crypto_symbol(F.col("doc"), F.col("name"), F.col("error")).alias("s")).collect())
    assert got == {"1": "BTC", "2": "ETH", "3": "SOL", "4": "DOGE", "5": "MATIC", "6": "Unknown"}


@pytest.mark.parametrize("url,norm", [
    ("https://www.example.com/", "example.com"),
    ("http://example.com", "example.com"),
    ("  HTTPS://WWW.EXAMPLE.COM/  ", "example.com"),
    ("www.example.com/", "example.com"),
    ("example.com", "example.com"),
    (None, ""),
])
def test_normalize_url(spark, url, norm):
    assert one(spark, T.normalize_url(F.col("u")), u=url) == norm


@pytest.mark.parametrize("url,domain", [
    ("https://www.example.com/path", "example.com"),
    ("http://sub.example.org:8080/x", "sub.example.org"),
    ("example.net/page", "example.net"),
    ("localhost", "unknown"),
    ("HTTPS://EXAMPLE.COM/", "unknown"),
    ("", "unknown"),
])
def test_url_domain(spark, url, domain):
    assert one(spark, T.url_domain(F.col("u")), u=url) == domain


@pytest.mark.parametrize("e,t,rate", [(2, 10, 20.0), (0, 0, 0.0), (1, 3, 33.3), (2, 3, 66.7), (5, 4, 125.0)])
def test_error_rate(spark, e, t, rate):
    df = spark.createDataFrame([(e, t)], "e long, t long")
    assert df.select(T.error_rate(F.col("e"), F.col("t")).alias("r")).first()["r"] == rate


def test_quality_score_order(spark):
    rows = [("https://a.com", True, "Website accessible - analysis completed successfully"),
            ("https://b.com", True, "ok"), ("", None, "")]
    df = spark.createDataFrame(rows, "u string, a boolean, n string")
    got = [r["s"] for r in df.select(T.quality_tenths(F.col("u"), F.col("a"), F.col("n")).alias("s")).collect()]
    assert got == [28, 20, 0]


def test_date_key(spark):
    assert one(spark, T.date_key(F.col("s")), s="2025-08-29T06:44:12.622037Z") == "2025-08-29"
    assert one(spark, T.date_key(F.col("s")), s="2025-08-29 06:44:12.622037") == "2025-08-29"


def test_sanitize_project(spark):
    assert one(spark, T.sanitize_project(F.col("p")), p="my proj/é-1.x_") == "myprojé-1.x_"
    assert one(spark, T.sanitize_project(F.col("p")), p=None) == "unknown-project"
