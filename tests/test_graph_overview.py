"""The overview of graphs against plain counts over all quads."""

from collections import defaultdict

from quadrille.plans import catalog
from quadrille.sources import lift


def test_every_graph_with_both_counts(spark, sf):
    n, subjects = defaultdict(int), defaultdict(set)
    for r in lift.documents(spark, sf).select("s", "g").collect():
        n[r["g"]] += 1
        subjects[r["g"]].add(r["s"])
    got = catalog.queries()["g_graph_overview"](spark, sf)
    assert sorted(got.columns) == ["g", "n_subjects", "n_triples"]
    assert {r["g"]: (r["n_triples"], r["n_subjects"]) for r in got.collect()} == {g: (n[g], len(subjects[g])) for g in n}
    assert {lift.STRUCT, lift.META} == set(n)
