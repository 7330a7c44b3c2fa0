"""Property tests of the guarded ledger fold (pure kernel, no Spark needed)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from stockflow.operators import ledger as L

COMMANDS = ["receive", "reserve", "release", "issue", "adjust", "adjust_by"]

command = st.tuples(st.integers(0, 3), st.sampled_from(COMMANDS), st.one_of(st.none(), st.integers(-20, 60)))


def frame(rows, opening):
    rows = sorted(rows, key=lambda r: r[0])
    return pd.DataFrame({
        "inventory_id": np.array([r[0] for r in rows], dtype=np.int64),
        "command_id": [f"{i:05d}" for i in range(len(rows))],
        "ts": pd.Timestamp("2024-01-01"),
        "command": [r[1] for r in rows],
        "quantity": pd.array([r[2] for r in rows], dtype="Int32"),
        "work_order_id": pd.array([None] * len(rows), dtype="Int64"),
        "opening_on_hand": [opening[r[0]][0] for r in rows],
        "opening_reserved": [opening[r[0]][1] for r in rows],
    })


@settings(max_examples=150, deadline=None)
@given(st.lists(command, min_size=1, max_size=60), st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)),
                                                            min_size=4, max_size=4), st.integers(1, 59))
def test_invariants_and_batch_split(rows, opens, cut):
    opening = {k: (max(a, b), min(a, b)) for k, (a, b) in enumerate(opens)}  # valid: reserved <= on hand
    pdf = frame(rows, opening)
    whole = L._ledger_kernel(pdf, {}, vectorized=True)
    walk = L._ledger_kernel(pdf, {}, vectorized=False)
    cols = ["accepted", "reason", "on_hand_after", "reserved_after"]
    assert whole[cols].astype(object).equals(walk[cols].astype(object))
    # the same rows fed in two batches (a location may span them) give the same answer
    cut = min(cut, len(pdf))
    carry: dict = {}
    parts = [L._ledger_kernel(pdf.iloc[:cut].reset_index(drop=True), carry)] if cut else []
    if cut < len(pdf):
        parts.append(L._ledger_kernel(pdf.iloc[cut:].reset_index(drop=True), carry))
    split = pd.concat(parts, ignore_index=True)
    assert split[cols].astype(object).equals(whole[cols].astype(object))
    # 0 <= reserved <= on hand after every command; closing = opening + accepted signed moves
    assert (whole["reserved_after"] >= 0).all() and (whole["reserved_after"] <= whole["on_hand_after"]).all()
    for k, g in whole.groupby("inventory_id"):
        acc = g[g["accepted"]]
        moves = (acc["on_hand_after"] - acc["on_hand_before"]).sum()
        assert g["on_hand_after"].iloc[-1] == opening[k][0] + moves
