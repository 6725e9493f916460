import pytest

from assayer.plans import weighing

#: Shares for and against, and numbers of polar items, hosts and items, worked out apart from this library.
WANTED = {1: (0.130398, 0.114336, 1166, 100, 7254), 2: (0.177385, 0.16145, 1156, 100, 4215), 3: (0.239978, 0.247059, 3693, 100, 5552), 4: (0.000713, 0.000713, 0, 100, 3512), 5: (0.333333, 0.333333, 0, 0, 0)}


def test_verdicts(spark):
    rows = {r["claim_id"]: r for r in weighing.verdicts(spark, "/root/testdata/sf0.01").collect()}
    for claim, (f, a, n_full, hosts, items) in WANTED.items():
        r = rows[claim]
        assert (r["for_share"], r["against_share"]) == (pytest.approx(f, abs=2e-6), pytest.approx(a, abs=2e-6))
        assert (r["n_full"], r["hosts"], r["items"]) == (n_full, hosts, items)
    assert (rows[1]["verdict"], rows[3]["verdict"], rows[4]["verdict"]) == ("neutral", "unresolved", "unresolved")
