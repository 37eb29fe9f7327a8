import os
import re
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from check import TABLES, session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session("8")


@pytest.fixture(scope="session")
def documented(spark):
    """The two-sided fixtures written down in FIXTURES.md, over the sf0.01 tables."""
    for table in TABLES:
        path = f"/root/testdata/sf0.01/{table}.parquet"
        if os.path.exists(path):
            spark.read.parquet(path).createOrReplaceTempView(table)
    with open(os.path.join(ROOT, "FIXTURES.md")) as text:
        blocks = re.findall(r"```sql\n-- (\w+)\n(.*?)```", text.read(), re.DOTALL)
    return {name: spark.sql(sql) for name, sql in blocks}
