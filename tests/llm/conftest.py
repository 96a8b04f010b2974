import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).parent))
from small_tables import sample_rows, tables  # noqa: E402


@pytest.fixture(scope="session")
def small(spark, tmp_path_factory):
    rows = sample_rows()
    items = [(1, " ".join(rows[5][1].split()[:14])), (10, "one two three"), (2, "one two three"), (3, None), (None, "one"), (4, "  "), (5, " ".join(rows[30][1].split()[3:15]))]
    html = "<p>" + "payload é " * 30 + "</p>"
    pages = [(5, "http://a.example.com/en/1?x=1", html), (2, "HTTPS://B.Example.NET/de/8/x#f", html), (9, "http://c.org/es/", html), (7, None, None), (8, "no scheme", ""), (11, "http://x", "short"), (12, "http://x", "short"), (None, "http://e.com/en/", html), (13, "http://e.com", "q" * 100), (14, "http://e.com/en/7", "q" * 100)]
    return tables(spark, tmp_path_factory.mktemp("small"), rows, items, pages), rows, items, pages


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("empty"), [])
