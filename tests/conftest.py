import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfspark.session import local_session, shared_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(shuffle_partitions=4, **{"spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    shared_dir(session)
    return session


GOLDEN = [
    ("Gaming Laptop Dell XPS", "amazon", "prod1", 599.99, 4.5, "2025-06-30 10:00:00", "laptop", "static"),
    ("iPhone 15 Pro Max", "ebay", "prod2", 299.99, 4.0, "2025-06-30 11:00:00", "phone", "selenium"),
    ("Samsung Galaxy Tab S9", "walmart", "prod3", 199.99, 3.8, "2025-06-30 12:00:00", "tablet", "static"),
]


@pytest.fixture(scope="session")
def golden(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(
        GOLDEN,
        "title string, source string, product_id string, price double, rating double, scraped_at string, "
        "search_keyword string, scraper_type string",
    )
    return df.withColumn("scraped_at", F.col("scraped_at").cast("timestamp_ntz")).withColumn(
        "url", F.concat(F.lit("https://shop.example.com/"), "product_id")
    )
