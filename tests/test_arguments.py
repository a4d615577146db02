from datetime import datetime

import pytest

from chronolake.functions import arguments

NOW = datetime(2024, 3, 31, 12)


@pytest.mark.parametrize(("text", "want"), [
    ("2024-01-02", datetime(2024, 1, 2)), ("2024-01-02T03:04:05", datetime(2024, 1, 2, 3, 4, 5)), ("yesterday", datetime(2024, 3, 30, 12)), ("2 weeks ago", datetime(2024, 3, 17, 12)),
    ("1 month ago", datetime(2024, 2, 29, 12)), ("3 months ago", datetime(2023, 12, 31, 12)), ("1 year ago", datetime(2023, 3, 31, 12)),
])
def test_dates(text, want):
    assert arguments.date_filter(text, NOW) == want


def test_line_ranges():
    lines = ["a", "start", "b", "end"]
    assert arguments.line_range("2,3", lines) == (2, 3)
    assert arguments.line_range("2,+2", lines) == (2, 3)
    assert arguments.line_range("/start/,/end/", lines) == (2, 4)
    for bad in ("0,2", "3,2", "1,9", "/x/,/y/", "x"):
        with pytest.raises(ValueError):
            arguments.line_range(bad, lines)


def test_revision_ranges():
    assert arguments.revision_range("a..b") == (["b"], ["a"], False)
    assert arguments.revision_range("a...") == (["a", "HEAD"], [], True)
    assert arguments.revision_range("^a b") == (["b"], ["a"], False)
