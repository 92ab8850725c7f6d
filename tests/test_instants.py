import json
from datetime import UTC, datetime

import pytest

from letterloom.operators import instants

MESSAGES = "id long, from_email string, date_ts long, headers_json string, sent_ts string"
ZONES = [("koethenau.example", "Europe/Berlin"), ("belmoor.example", "America/New_York"), (None, "Asia/Tokyo")]


def epoch(*at):
    return int(datetime(*at, tzinfo=UTC).timestamp())


CASES = [
    ("Wed, 03 Feb 2021 09:47:58 +0100", None, "a@x.example", epoch(2021, 2, 3, 8, 47, 58)),
    ("Tue, 10 May 2022 08:00 +0200", None, "a@x.example", epoch(2022, 5, 10, 6)),
    ("Sun, 26 Feb 23 07:38:56 GMT", None, "a@x.example", epoch(2023, 2, 26, 7, 38, 56)),
    ("Thu,\n 27 Apr 2023 05:54:26 +0100 (BST)", None, "a@x.example", epoch(2023, 4, 27, 4, 54, 26)),
    ("Thu Dec 29 19:16:59 2022", None, "A@KOETHENAU.example", epoch(2022, 12, 29, 18, 16, 59)),
    ("Thu Dec 29 19:16:59 2022", None, "a@unknown.example", None),
    ("2022-04-22T14:37:04.999999+05:30", None, None, epoch(2022, 4, 22, 9, 7, 4)),
    ("20231027T065618Z", None, None, epoch(2023, 10, 27, 6, 56, 18)),
    ("1745492240399", None, None, 1745492240),
    ("2023-04-09 11:14:26[Europe/Berlin]", None, None, epoch(2023, 4, 9, 9, 14, 26)),
    ("16. März 2024 08:21:49 +0000", None, None, epoch(2024, 3, 16, 8, 21, 49)),
    ("12 févr. 2022 05:03:25 +0100", None, None, epoch(2022, 2, 12, 4, 3, 25)),
    ("12/19/2022 2:43:09 PM", None, "a@belmoor.example", epoch(2022, 12, 19, 19, 43, 9)),
    ("03/01/2022 00:07:44 +0100", "Mon, 03 Jan 2022 00:09:11 +0100", None, epoch(2022, 1, 2, 23, 7, 44)),
    ("03/01/2022 00:07:44 +0100", None, None, None),  # either order may be meant
    ("30 Feb 2022 10:00:00 +0100", None, None, None),
    ("2024-10-27 02:30:00", "Sun, 27 Oct 2024 01:31:00 +0000", "a@koethenau.example", epoch(2024, 10, 27, 1, 30)),  # shown twice
    ("2024-10-27 02:30:00", "Sun, 27 Oct 2024 00:31:00 +0000", "a@koethenau.example", epoch(2024, 10, 27, 0, 30)),
    ("2024-03-31 02:30:00", None, "a@koethenau.example", epoch(2024, 3, 31, 1, 30)),  # never shown
    ("yesterday 10:00:00", None, "a@koethenau.example", None),
    ("", None, "a@koethenau.example", None),
]


@pytest.fixture(scope="module")
def read(spark):
    rows = []
    for i, (date, received, sender, _) in enumerate(CASES):
        headers = {"DATE": date} | ({"Received": f"from a by b; {received}"} if received else {})
        rows.append((i, sender, 0, json.dumps(headers), "clash"))
    n = len(CASES)
    rows += [(n, None, 5, None, None), (n + 1, None, None, "{broken", None), (n + 2, "a@x.example", None, '{"date": "1745492240"}', None), (n + 2, "a@x.example", None, '{"date": "1745492240"}', None)]
    df = spark.createDataFrame(rows, MESSAGES)
    zones = spark.createDataFrame(ZONES, "domain string, zone string")
    return df, zones


def test_cases(read):
    got = {r["id"]: r["sent_ts"] for r in instants.sending_instants(*read).collect()}
    for i, case in enumerate(CASES):
        assert got[i] == case[3], case


def test_nulls_duplicates_and_found(read):
    df, zones = read
    out = instants.sending_instants(df, zones)
    assert out.count() == df.count()
    found = [r["id"] for r in instants.wrong_instants(df, zones).collect()]
    assert len(found) == len(set(found))
    n = len(CASES)
    assert n not in found and n + 1 not in found and n + 2 in found
    assert instants.sending_instants(df.limit(0), zones).count() == 0
