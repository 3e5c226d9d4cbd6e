"""Every surveyed operator has a query; all but a few have reference SQL."""

import re

from netlens.plans import catalog

IDS = (
    [f"S{i:02d}" for i in (*range(1, 19), 20, 21, 22, 23, 26, 27)] + [f"P{i:02d}" for i in range(1, 18)] + [f"D{i:02d}" for i in (*range(1, 11), 12, 13, 14, 15)]
    + [f"F{i:02d}" for i in range(1, 38)] + [f"R{i:02d}" for i in range(1, 23)] + [f"N{i:02d}" for i in range(1, 11)] + [f"A{i:02d}" for i in range(1, 20)]
    + [f"B{i:02d}" for i in range(1, 20)] + [f"L{i:02d}" for i in range(1, 16)] + [f"M{i:02d}" for i in (*range(1, 12), 14, 15, 16, 19) if i not in (12, 13)]
    + [f"X{i:02d}" for i in (*range(1, 19), 20)] + [f"E{i:02d}" for i in range(1, 25)] + [f"Q{i:02d}" for i in range(1, 21)] + [f"W{i:02d}" for i in (1, 2, 3, 4, 8, 9, 11, 12)]
)
# Seeded or iterative fits: their rows have no SQL form.
NO_SQL = {"M02", "M03", "M04", "M06", "M15", "X04", "X07", "X09", "X13", "X15", "flagship"}


def test_every_operator_has_a_query():
    have = {k.split("_")[0] for k in catalog.QUERIES}
    assert not [i for i in IDS if i not in have]


def test_reference_sql_is_complete():
    missing = {k.split("_")[0] for k in catalog.QUERIES if k not in catalog.ORACLES}
    assert missing <= NO_SQL
    assert all(re.search(r"\bselect\b", v, re.I) for v in catalog.ORACLES.values())
