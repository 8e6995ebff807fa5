"""Membership with one name for each index against a plain replay."""

import datetime
from collections import defaultdict

from panelspark.plans import panel as P
from panelspark.queries import core

SMALL = "/root/testdata/sf0.001"


def test_one_name_for_each_index(spark):
    gate = defaultdict(dict)
    for r in core.gated(spark, SMALL).collect():
        gate[r.code][r.date] = (r.floor_ok, r.pctl_ok, r.adv)
    listed = {r.code: (r.list_date, r.delist_date) for r in core.catalogue(spark, SMALL).collect()}
    idx = {r.code: r.idx for r in P.instruments(spark, SMALL).collect()}
    days = sorted({d for g in gate.values() for d in g})

    def season(code, at):
        start, end = listed[code]
        return at >= start + datetime.timedelta(days=182) and (end is None or at < end)

    state, held, chosen = {}, {}, defaultdict(dict)
    for d in days:
        elig = defaultdict(dict)
        for code, g in gate.items():
            state[code] = g.get(d, state.get(code))
            if state[code] and season(code, d) and state[code][0] and state[code][1] and state[code][2] is not None:
                elig[idx[code]][code] = state[code][2]
        for i in set(idx.values()):
            names = elig.get(i, {})
            best = max(sorted(names), key=names.get, default=None)
            if held.get(i) not in names or names[best] >= 1.25 * names[held[i]]:
                held[i] = best
        for code in gate:
            chosen[code][d] = held.get(idx[code]) == code
    want = set()
    for r in P.grid(P.cells(spark, SMALL)).collect():
        past = [d for d in days if listed[r.code][0] <= d <= r.bar - datetime.timedelta(days=7)]
        if past and chosen[r.code][past[-1]] and season(r.code, r.bar):
            want.add((r.bar, r.code))
    got = {tuple(r) for r in core.membership_one_per_index(spark, SMALL).collect()}
    assert got == want and got
    events = {r.event for r in core.index_membership_events(spark, SMALL).collect()}
    assert "enter" in events and events <= {"enter", "exit_delist", "exit_floor", "exit_pctl", "repr_switch"}
