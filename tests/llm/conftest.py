import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import get_spark
    return get_spark(master="local[*]", shuffle_partitions=8)


@pytest.fixture(scope="session")
def docs(spark):
    """Small table with copies, nulls, empty and long texts, ties, a repeated
    row and columns that clash with result columns."""
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w30", "x")
    rows = [(1, base), (2, base), (3, near), (4, base.upper()), (5, None), (6, ""), (7, "  \n\t "), (8, "one two"),
            (9, "one two"), (10, " ".join(f"z{i % 977}" for i in range(30000))), (11, "solo words stand here alone"),
            (11, "solo words stand here alone"), (12, "first line of the text\nShared line number one here\nlast"),
            (13, "Shared  line number one here \nother line of its own\nshared line number one here"),
            (14, "shared line number onehere\n\nanother line that is alone"), (None, "text without an id at all")]
    return spark.createDataFrame([(i, t, "s", 0.5, 1) for i, t in rows],
                                 "doc_id long, text string, source string, score double, n_lines int")
