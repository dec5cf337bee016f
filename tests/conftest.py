from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

CUSTOMERS = [
    ("K1", "Ada Obi", "ada@example.com", "+254700111222", "2025-03-01", "Kenya", "Active", "40.5"),
    ("K2", "Ben Ito", "ben.example.com", "0700111222", "2025-03-02", "Kenya", "active", "42.0"),
    ("K3", "Cy Mora", "cy@example.com", "+254700333444", "2025-03-03", "Kenya", "Active", "41.0"),
    ("K4", "Di Noor", "di@nowhere", "+254700444555", "2025-03-04", "Kenya", "Inactive", "12.0"),
    ("K5", "Ed Pole", None, "bad", "2025-03-05", "Kenya", "Inactive", "13.0"),
    ("K6", "Flo Quin", "flo@example.com", "+254700555666", "2025-03-06", "Kenya", "Active", "44.0"),
    ("K6", "Flo Quin", "flo@example.com", "+254700555666", "2025-03-06", "Kenya", "Active", "44.0"),
    ("K7", "Gus Rao", "gus@example.com", "+254700666777", "2025-03-08", "Kenya", "ACTIVE", "4000"),
    ("K8", "Hal Sy", "hal@example.com", "+254700777888", None, "Kenya", "Active", "43.0"),
    ("K9", "Ivy Tan", "ivy@example.com", "+254700888999", "2025-03-10", "Kenya", "Active", "45.0"),
]
COLUMNS = ["customer_id", "name", "email", "phone", "signup_date", "country", "status", "monthly_spend"]


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("dqspark-tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def customers(spark):
    return spark.createDataFrame(CUSTOMERS, ", ".join(f"{c} string" for c in COLUMNS))
