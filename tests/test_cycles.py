"""Inclusion cycles of any length."""

from quadrille.functions.terms import PREFIX
from quadrille.operators.quads import SCHEMA
from quadrille.operators.validate import cycles


def test_long_cycle(spark):
    ring, p = [f"r{k}" for k in range(11)], PREFIX["rico"] + "isOrWasIncludedIn"
    edges = [*zip(ring, ring[1:] + ring[:1], strict=True), ("leaf", "r0"), ("r3", "root")]
    q = spark.createDataFrame([(s, p, o, "g", "iri", None, None) for s, o in edges], SCHEMA)
    assert sorted(r["s"] for r in cycles(q).collect()) == sorted(ring)
