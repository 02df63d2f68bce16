"""The acceptance queries over the animals knowledge base."""

from pathlib import Path

import pytest

from weftgraph.functions.handles import link_handle, node_handle
from weftgraph.operators.paths import find_paths
from weftgraph.plans.compiler import Compiler, QueryOptions
from weftgraph.plans.patterns import parse, parse_tokens
from weftgraph.sources.expressions import load_file, read

DATA = Path(__file__).parent / "data"


@pytest.fixture(scope="module")
def kb(spark):
    nodes, links = load_file(spark, str(DATA / "animals.txt"))
    return nodes.cache(), links.cache()


U = QueryOptions(unique_assignment=True)
UV = QueryOptions(unique_assignment=True, unique_value=True)
SIM, INH = '(Similarity $v1 "{}")', '(Inheritance $v1 "{}")'
CHAIN_UP = '(chain 0 1 2 $v1 "{}" (Inheritance $vc1 $vc2))'
PAIRS = "(Similarity $v1 $v2)"
GOLDEN = {
    "q1": (PAIRS, None, 14),
    "q2": ('(Similarity "human" $v1)', None, 3),
    "q3": (f'(and {SIM.format("human")} {INH.format("plant")})', None, 1),
    "q4": (f"(and {PAIRS} (Similarity $v2 $v3))", None, 26),
    "q4uv": (f"(and {PAIRS} (Similarity $v2 $v3))", UV, 12),
    "q5": (f'(or {SIM.format("human")} {SIM.format("snake")})', None, 5),
    "q6": (f'(or {SIM.format("human")} {SIM.format("chimp")})', U, 4),
    "q8": (f'(chain 0 1 2 "chimp" "ent" {PAIRS})', None, 2),
    "q9": (f'(chain 0 1 2 "ent" "animal" (or {PAIRS} (Inheritance $v1 $v2)))', None, 5),
    "q10": (f'(chain 1 1 2 "chimp" "ent" (and (or (Inheritance $v1 "mammal") (Inheritance $v2 "mammal")) {PAIRS}))', None, 2),
    "q11": (f'(and (Similarity "human" $v1) {CHAIN_UP.format("animal")})', U, 2),
    "q12": (f'(and (Similarity "human" $v1) (or {CHAIN_UP.format("animal")} {CHAIN_UP.format("plant")}))', U, 3),
    "q13": (f'(and {PAIRS} (and {CHAIN_UP.format("animal")} (chain 0 1 2 $v2 "plant" (Inheritance $vc1 $vc2))))', U, 2),
    "q15": (f'(andnot {SIM.format("human")} {INH.format("plant")})', None, 2),
    "q16": (f'(andnot {SIM.format("human")} {CHAIN_UP.format("animal")})', None, 1),
    "nest1": ("(OddLink (Similarity $v1 $v2))", None, 8),
    "nest2": (f'(and {SIM.format("human")} (OddLink (Similarity $v1 $v2)))', None, 1),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden_counts(spark, kb, name):
    text, options, n = GOLDEN[name]
    assert Compiler(spark, kb[1], None, options or QueryOptions()).compile(text).count() == n


def test_handles():
    sim = lambda r, a, b: link_handle([node_handle(r), node_handle(f'"{a}"'), node_handle(f'"{b}"')])
    assert sim("Similarity", "ent", "human") == "d610ca5aa289bf532010cb6fe79f754e"
    assert sim("Inheritance", "ent", "plant") == "434d4303c556d94d2774ff70a5140b23"


def test_columns_agree_with_values(spark, kb):
    row = kb[1].where('expr = \'(Similarity "ent" "human")\'').first()
    assert row["handle"] == "d610ca5aa289bf532010cb6fe79f754e"


def test_tokens_and_text_agree():
    text = parse('(and (Similarity $v1 "human") (OddLink (Similarity $v1 $v2)))')
    sim = "NODE Symbol Similarity"
    tokens = f'AND 2 LINK_TEMPLATE Expression 3 {sim} VARIABLE v1 NODE Symbol "human" LINK_TEMPLATE Expression 2 NODE Symbol OddLink LINK_TEMPLATE Expression 3 {sim} VARIABLE v1 VARIABLE v2'
    assert parse_tokens(tokens) == text


@pytest.mark.parametrize("bad", ["BLAH", "AND 11", "LINK_TEMPLATE Expression 1 NODE Symbol a", "LINK Expression 1 VARIABLE x", "NODE Symbol a"])
def test_bad_tokens(bad):
    with pytest.raises(ValueError):
        parse_tokens(bad)


@pytest.mark.parametrize("bad", ["(a b", "(a))", "()", "(and (a $x))", '(chain 0 1 2 $a $b (r $x $y))', "(a b)", "(chain 0 1 2 x $b (r $x $y))"])
def test_bad_text(bad):
    with pytest.raises(ValueError):
        parse(bad)


def test_numbers():
    assert read('(a 007 1.5 "x y" b)') == [["a", "7", "1.500000", '"x y"', "b"]]


EDGES = "S1 S2 ST S4 S5 S9 S20 1-2 2-3 3T 4-1 5-7 5-6 6-8 9-10 9-11 9-12 10-13 10-14 11-15 11-16 12-17 12-18 14-19 15T 17-9 18-12 19T 20T"


def test_seven_simple_paths(spark):
    rows = []
    for e in EDGES.split():
        a, b = e.split("-") if "-" in e else (e[0], e[1:]) if e[0] == "S" else (e[:-1], "T")
        rows.append((e, a, b, 0.5))
    edges = spark.createDataFrame(rows, "handle string, src string, dst string, importance double")
    found = find_paths(edges, "S", "T").collect()
    assert len(found) == 7
    assert {round(r["importance"], 6) for r in found if len(r["links"]) == 1} == {0.5}
    assert {round(r["importance"], 6) for r in found if len(r["links"]) == 2} == {round(1 / 3, 6)}
    with_dead_ends = find_paths(edges, "S", "T", incomplete=True).collect()
    assert {tuple(r["links"]) for r in found} < {tuple(r["links"]) for r in with_dead_ends}
