"""Engine, store, attention, inference and mapper, on small inputs with known results."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.engine import Engine, evolution_from_text, schema_pairs
from weftgraph.functions.handles import link_handle, md5, node_handle
from weftgraph.operators import accessors, linking, paths
from weftgraph.operators.attention import Attention, Rates, context_lines
from weftgraph.operators.evolution import FITNESS, Evolution, fitness_called, fitness_importance, substituted
from weftgraph.operators.linking import Knowledge, Limits
from weftgraph.operators.paths import find_paths
from weftgraph.operators.store import SKIP, THROW, Federation, Peer, Store, federated
from weftgraph.plans.compiler import QueryOptions, best_share
from weftgraph.plans.patterns import parse
from weftgraph.sources.expressions import NODES, as_links, load_expressions
from weftgraph.sources.relational import TableSpec, map_table, referenced_rows
from pathlib import Path

DATA = Path(__file__).parent / "data"


@pytest.fixture
def engine(spark):
    return Engine.from_config(spark, {"type": "file", "path": str(DATA / "animals.txt")})


def test_attention_after_a_query(engine):
    assert engine.query('(Similarity "human" $v1)', attention_update=True, attention_correlation="handles").count() == 3
    sets = engine.attention()
    assert sets.tokens in (0.0, 1.0)
    assert engine.query("(Similarity $v1 $v2)", QueryOptions(count_only=True, max_answers=5)).first()["count"] == 5
    with pytest.raises(ValueError):
        QueryOptions(disregard_importance=True, positive_importance=True)


def network(spark):
    """Six handles; 1 and 2 correlate twice."""
    sets = [["h0", "h1", "h2", "h3"], ["h1", "h2", "h4", "h5"]]
    return Attention.empty(spark).correlate(spark.createDataFrame([(s,) for s in sets], "handles array<string>"))


def test_stimulus_follows_the_closed_form(spark):
    state = network(spark)
    assert {r["handle"]: r["cnt"] for r in state.nodes.collect()} == {"h0": 1, "h1": 2, "h2": 2, "h3": 1, "h4": 1, "h5": 1}
    edges = {(r["src"], r["dst"]): r["cnt"] for r in state.edges.collect()}
    assert edges["h1", "h2"] == 2 and edges["h0", "h3"] == 1 and ("h0", "h4") not in edges
    even = state.nodes.select("handle", F.lit(1).alias("n"))
    state = state.stimulate(even)
    for _ in range(2):
        before = {r["handle"]: r["importance"] for r in state.nodes.collect()}
        state = state.stimulate(even)
        weights = {h: {b: c / {"h1": 2, "h2": 2}.get(h, 1) for (a, b), c in edges.items() if a == h} for h in before}
        pool = 0.75 * sum(before.values())
        updated = {h: 0.25 * i + pool / 6 for h, i in before.items()}
        want = {h: 0.9 * u for h, u in updated.items()}
        for h, w in weights.items():
            for other, x in w.items():
                want[other] += 0.1 * updated[h] * x / sum(w.values())
        assert {r["handle"]: r["importance"] for r in state.nodes.collect()} == pytest.approx(want)


def test_determiners(spark):
    state = Attention.empty(spark)
    state = Attention(spark.createDataFrame([("a", 1, 0.2), ("b", 1, 0.4), ("c", 1, 0.9)], "handle string, cnt long, importance double"), state.edges, state.determiners)
    lists = spark.createDataFrame([(["a", "b", "x"],), (["b", "c"],)], "handles array<string>")
    state = state.set_determiners(lists)
    assert {r["handle"]: r["importance"] for r in state.importance().collect()} == pytest.approx({"c": 0.9, "b": 0.65, "x": 0.0, "a": 0.85 / 3})
    assert {r["handle"]: r["importance"] for r in state.importance("greatest").collect()}["a"] == pytest.approx(0.9)
    with pytest.raises(ValueError):
        state.set_determiners(spark.createDataFrame([(["c", "a"],)], "handles array<string>")).importance()


def test_context_lines_replay(spark, tmp_path):
    one = lambda *h: spark.createDataFrame([(list(h),)], "handles array<string>")
    state = Attention.empty(spark).replay(context_lines(one("a", "b"), one("a", "c", "d"), one("c", "c", "d")))
    assert {(r["src"], r["dst"]) for r in state.edges.collect()} == {("a", "c"), ("a", "d")}
    assert state.determiners.count() == 1
    state.save(str(tmp_path / "s"))
    again = Attention.load(spark, str(tmp_path / "s"))
    assert sorted(again.nodes.collect()) == sorted(state.nodes.collect()) and again.tokens == 0.0


def test_store_rules(spark, engine):
    store = engine.store
    ent = link_handle([node_handle("Similarity"), node_handle('"ent"'), node_handle('"human"')])
    links = store.links.where(F.col("handle") == ent).select("handle", "type", "targets", "is_toplevel", "expr")
    with pytest.raises(ValueError):
        store.add_links(links, THROW)
    assert store.add_links(links, SKIP).links.count() == store.links.count()
    assert store.get([ent])[1].count() == 1
    one = spark.createDataFrame([(node_handle('"ent"'),)], "handle string")
    assert store.exist(one).count() == 1
    assert store.delete(one).nodes.count() == store.nodes.count()  # links hold it
    cut = store.delete(one, with_incoming=True)
    assert cut.nodes.count() == store.nodes.count() - 1
    assert cut.links.where(F.col("expr").contains('"ent"')).count() == 0
    odd = store.links.where(F.col("expr") == '(OddLink (Similarity "ent" "human"))').select("handle")
    names = {r["handle"] for r in store.reachable(odd).select("handle").collect()}
    assert names == {node_handle(n) for n in ("OddLink", "Similarity", '"ent"', '"human"')}
    assert {r["handle"] for r in store.reachable(odd, skip_heads=True).select("handle").collect()} == {node_handle(n) for n in ('"ent"', '"human"')}
    assert store.composite_types().count() == store.links.count()
    assert federated([store, store]).links.count() == store.links.count()
    missing = links.withColumn("targets", F.array(F.lit("nowhere"))).withColumn("handle", F.lit("new"))
    with pytest.raises(ValueError):
        store.add_links(missing, check_targets=True)


def test_paths_of_any_length(spark):
    edges = spark.createDataFrame([(f"l{i}", f"n{i}", f"n{i + 1}", 0.0) for i in range(33)], "handle string, src string, dst string, importance double").coalesce(1)
    assert [r["links"] for r in find_paths(edges, "n0", "n33").collect()] == [[f"l{i}" for i in range(33)]]
    with pytest.raises(ValueError):
        find_paths(edges, "n0", "n33", max_hops=2)


def test_all_paths_are_stored_once_and_not_shuffled(spark, monkeypatch):
    """Of a search for all continuations only links, nodes and totals of paths are stored, and no shuffle looks for doubles."""
    rng = random.Random(5)
    rows = [(f"l{i}", f"n{rng.randint(0, 6)}", f"n{rng.randint(0, 6)}", 1.0) for i in range(14)]
    edges = spark.createDataFrame(rows + rows[:5], "handle string, src string, dst string, importance double")
    shapes, keep = [], paths.stored
    monkeypatch.setattr(paths, "stored", lambda df, *a, **b: (shapes.append(df.columns), keep(df, *a, **b))[1])
    for source, target in ((None, "n0"), ("n0", None), ("n0", "n3")):
        found = find_paths(edges, source, target, incomplete=True, all_prefixes=True)
        want, front = [], [((), (source or target,))]
        while front:
            front = [(ls + (h,), ns + (far,)) for ls, ns in front for h, a, b, _ in rows for near, far in [(a, b) if source else (b, a)] if near == ns[-1] and far not in ns]
            want += [ls if source else ls[::-1] for ls, _ in front]
            front = [x for x in front if not (source and x[1][-1] == target)]
        assert sorted(tuple(r["links"]) for r in found.collect()) == sorted(want)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert all("before" not in columns for columns in shapes)


def test_a_chain_broadcasts_no_table_by_estimate(spark, tmp_path, monkeypatch):
    """Importance and links join by merge, whatever Spark thinks of their sizes."""
    from weftgraph import queries
    from weftgraph.plans import compiler

    class Planned(Exception):
        pass

    def planned(edges, *_, **__):
        raise Planned(edges._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(compiler, "find_paths", planned)
    spark.range(200).selectExpr("id AS p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    for name in ("chain_greatest", "chain_best_child"):
        with pytest.raises(Planned) as plan:
            queries.QUERIES[name](spark, str(tmp_path))
        assert "SortMergeJoin" in str(plan.value) and "Broadcast" not in str(plan.value)


@pytest.mark.parametrize(("job", "depth"), [("types", 33), ("incoming", 65), ("targets", 65)])
def test_deep_nesting(spark, job, depth):
    names = ["leaf", *(f"link{i}" for i in range(depth))]
    rows = [(names[i + 1], "Expression", [names[i]], True, None) for i in range(depth)]
    links = as_links(spark.createDataFrame(rows, "handle string, type string, targets array<string>, is_toplevel boolean, expr string").coalesce(1)).cache()
    store = Store(spark.createDataFrame([("leaf", "Symbol", "leaf", False)], NODES).coalesce(1).cache(), links)
    if job == "types":
        assert store.composite_types().count() == depth
    else:
        end = spark.createDataFrame([("leaf" if job == "incoming" else names[-1],)], "handle string")
        cut = store.delete(end, with_incoming=job == "incoming", with_targets=job == "targets")
        assert (cut.nodes.count(), cut.links.count()) == (0, 0)


def test_path_hops(engine):
    found = engine.query('(chain 0 1 2 "chimp" "ent" (Similarity $a $b))').withColumn("id", F.lit(1))
    row = accessors.path_hops(found.limit(1), engine.store.links, ">0_1_2", "id").first()
    assert row["hops"][0] == node_handle('"chimp"') and row["hops"][-1] == node_handle('"ent"')


def test_accessors_miss(engine):
    found = engine.query('(Similarity "human" $a)')
    assert found.select(accessors.element(found, "$b", strict=False).alias("x")).first()["x"] == ""
    with pytest.raises(Exception):
        found.select(accessors.element(found, "$b")).collect()


ORGANISM = "organism_id int, genus string, species string, common_name string, abbreviation string, comment string"
FEATURE = "feature_id int, organism_id int, type_id int, name string, uniquename string, residues string, seqlen int, md5checksum string, is_analysis boolean, is_obsolete boolean"
FEATURES = [
    (1, 1, 1, "white", "FBgn0003996", "ATGCGATCGATCG", 13, None, False, False), (2, 1, 1, "yellow", "FBgn0004034", "GCTAGCTAGCTAG", 13, None, False, False), (3, 1, 1, "vermilion", "FBgn0003979", None, None, None, False, False),
    (4, 1, 2, "white-RA", "FBtr0070001", "ATGCGATCG", 9, None, False, False), (5, 1, 2, "white-RB", "FBtr0070002", "ATGCGA", 6, None, False, False),
]
REFERS = {"organism_id": "public.organism", "type_id": "public.cvterm"}


def n_atoms(pair):
    return pair[0].count() + pair[1].count()


def test_relational_mapper(spark):
    organism = spark.createDataFrame([(1, "Drosophila", "melanogaster", "fruit fly", "Dmel", "Model organism for genetics")], ORGANISM)
    assert n_atoms(map_table(organism, TableSpec("public.organism", "organism_id"))) == 34
    feature = spark.createDataFrame(FEATURES, FEATURE)
    spec = TableSpec("public.feature", "feature_id", REFERS)
    assert n_atoms(map_table(feature.where("feature_id = 1"), spec)) == 54
    cvterm = spark.createDataFrame([(1, "gene", "A region of biological sequence that encodes a gene", False, False)], "cvterm_id int, name string, definition string, is_obsolete boolean, is_relationshiptype boolean")
    assert n_atoms(map_table(cvterm, TableSpec("public.cvterm", "cvterm_id"))) == 28
    assert n_atoms(map_table(feature, TableSpec("public.feature", "feature_id", REFERS, ("residues", "md5checksum", "seqlen")))) == 114
    assert n_atoms(map_table(feature.limit(0), spec)) == 0
    assert referenced_rows(feature, "organism_id", organism, "organism_id").count() == 1


def test_weighted_counts(spark):
    facts = spark.createDataFrame([("p", "x", 1.0), ("p", "x", 0.5), ("p", "y", 0.5), ("q", "x", 0.6), ("q", "z", 1.0)], "owner string, key string, w double")
    pairs = spark.createDataFrame([("p", "q")], "a string, b string")
    r = linking.weighted_counts(pairs, facts, facts).first()
    assert (r["count_a"], r["count_b"], r["common"], r["either"]) == pytest.approx((1.5, 1.6, 0.6, 2.5))
    none = spark.createDataFrame([], "a string, b string")
    assert linking.implications(facts, none).first()["strength"] == pytest.approx(0.4)
    assert linking.equivalences(facts, none).count() == 2
    assert linking.equivalences(facts, pairs).count() == 0
    implied = spark.createDataFrame([("p", "q", 0.5)], "a string, b string, strength double")
    new = linking.evaluations(facts, implied, implied.limit(0)).collect()
    assert [(r["owner"], r["key"], r["w"]) for r in new] == [("q", "y", 0.25)]
    assert linking.and_predicates(facts, none).count() == 1
    words = spark.createDataFrame([("s", "a", 1), ("s", "b", 1), ("t", "a", 2)], "sentence string, word string, n long")
    assert linking.similar_sentences(words, 0.1).first()["similarity"] == pytest.approx(0.75)


def test_similar_sentences_keep_no_pair_below_the_threshold(spark, monkeypatch):
    """Sentences of three words that share one at most: what is stored grows with the words, not with the pairs that share one."""
    rows = [(i, w, 1) for i in range(400) for w in (f"r{i // 20}", f"c{i % 20}", f"d{(i // 20 + i % 20) % 20}")]
    rows += [(900, "x", 1), (900, "y", 1), (900, None, 1), (901, "x", 1), (901, "y", 1)]
    counts, keep = [], linking.stored
    monkeypatch.setattr(linking, "stored", lambda df, *a: (out := keep(df, *a), counts.append(out.count()))[0])
    found = linking.similar_sentences(spark.createDataFrame(rows, "sentence long, word string, n long"), 0.6).collect()
    assert [(r["a"], r["b"], r["similarity"]) for r in found] == [(900, 901, pytest.approx(0.8))]
    assert max(counts) <= len(rows)


def test_similar_sentences_by_force(spark):
    rng = random.Random(2)
    rows = {s: {"the": rng.randint(1, 3), rng.choice("of,to".split(",")): 1, **{f"w{rng.randint(0, 25)}": rng.randint(1, 2) for _ in range(rng.randint(1, 6))}} for s in range(70)}
    words = spark.createDataFrame([(s, w, n) for s, ws in rows.items() for w, n in ws.items()], "sentence int, word string, n int")
    for threshold in (0.0, 0.3, 0.5, 0.8):
        want = {}
        for a, x in rows.items():
            for b, y in rows.items():
                likeness = sum(x[w] + y[w] for w in x.keys() & y.keys()) / (sum(x.values()) + sum(y.values()))
                if a < b and x.keys() & y.keys() and likeness >= threshold:
                    want[a, b] = pytest.approx(likeness)
        assert {(r["a"], r["b"]): r["similarity"] for r in linking.similar_sentences(words, threshold).collect()} == want
    texts = {s: " ".join(ws) for s, ws in rows.items()}
    sentences = spark.createDataFrame(list(texts.items()), "sentence int, text string")
    places = lambda x, y: sum(p == q for p, q in zip(x, y, strict=False)) / max(len(x), len(y))
    want = {(a, b) for a in texts for b in texts if a < b and places(texts[a], texts[b]) >= 0.4}
    assert {(r["a"], r["b"]) for r in linking.similar_by_place(sentences, 0.4).collect()} == want


def test_links_are_created_once(engine):
    before = engine.store.links.count()
    assert engine.create_links("(Similarity $a $b)", "(Alike $a $b)").count() == 14
    assert engine.store.links.count() == before + 14
    assert engine.create_links("(Similarity $a $b)", "(Alike $a $b)").count() == 0


def test_evolution(engine):
    e = Evolution("(Similarity $a $b)", fitness_importance, population=10, generations=2, selection_rate=0.3, correlations=[(parse("(Inheritance $x $y)"), {"x": "$a"}, {"$a": "$y"})])
    assert engine.evolve(e, "other") and engine.attention("other").edges.count() == 0  # correlation queries answer by positive importance only
    engine.query("(Inheritance $x $y)", attention_update=True, attention_correlation="both")
    weight = engine.attention().edges.agg(F.sum("cnt")).first()[0]
    found = engine.evolve(e)
    fits = [r["strength"] for r in found]
    assert fits == sorted(fits) and engine.attention().edges.agg(F.sum("cnt")).first()[0] > weight
    assert len(e.statistics) == 2 and e.statistics[0]["renew_rate"] == 1 and e.statistics[1]["renew_rate"] == 0
    assert Evolution("(a $b)", fitness_importance, selection_rate=0.25, elitism_rate=0.05).select(10, random.Random(1))[0] == 0
    assert len(Evolution("(a $b)", fitness_importance, selection_rate=0.25).select(10, random.Random(1))) == 3  # 2.5 rounds up
    with pytest.raises(ValueError):
        Evolution("(a $b)", fitness_importance, correlations=[(["VARIABLE", "x"], {}, {})])
    called = Evolution("(Similarity $a $b)", fitness_called(lambda rows: [float(i) for i in range(len(rows))], 14), population=14, generations=1)
    assert [r["strength"] for r in engine.evolve(called)] == [float(i) for i in range(14)]
    strengths = engine.query('(Similarity "human" $v)').select(F.get("handles", F.lit(0)).alias("handle"), F.lit(0.5).alias("strength"))
    for tag in ("multiply_strength", "inference_toy"):
        one = Evolution('(Similarity "human" $v)', FITNESS[tag](strengths), generations=1)
        assert {r["strength"] for r in engine.evolve(one)} == {0.5}
    assert substituted(parse("(Inheritance $x $y)"), {"x": "h"}).variables() == ["y"]
    text = '((query (Similarity $a $b)) (ff unit_test) (cq (Inheritance $x $y)) (cr ((x $a))) (cm (($a $y))))'
    assert evolution_from_text(text, strengths).correlations[0][1] == {"x": "$a"}
    assert schema_pairs("a:b,c:d") == [("a", "b"), ("c", "d")]


def test_context_from_query(engine):
    state = engine.create_context("c", '(Similarity "human" $v1)', [("_0", "$v1")], ["$v1"])
    assert state.determiners.count() == 3 and state.nodes.where("importance > 0").count() == 3


def test_stream_of_atoms(spark, tmp_path):
    from weftgraph.streaming.ingest import ingest, ingested

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('(a "x")\n(a "y")\n(a "x")\n')
    for _ in range(2):
        ingest(spark.readStream.text(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        store = ingested(spark, str(tmp_path / "out"))
        assert (store.nodes.count(), store.links.count()) == (3, 2)
        (tmp_path / "in" / "b.txt").write_text('(a "y")\n')


def test_every_registered_query_has_a_name_in_sql_or_none():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rounds_of_link_creation(engine):
    assert engine.creation_rounds("(Similarity $a $b)", "template", rounds=3, template=parse("(Alike $a $b)")) == [{"created": 14, "unproductive": 0, "attempts": 0}, {"created": 0, "unproductive": 0, "attempts": 14}]
    assert engine.creation_rounds("(Similarity $a $b)", "template", template=parse("(Alike $a $b)"), limits=Limits(unproductive=3)) == [{"created": 0, "unproductive": 3, "attempts": 0}]
    assert engine.creation_rounds("(Similarity $a $b)", "template", template=parse("(Near $a $b)"), limits=Limits(created=4)) == [{"created": 4, "unproductive": 0, "attempts": 0}]
    assert engine.query("(Near $a $b)").count() == 4
    with pytest.raises(NotImplementedError):
        engine.creation_rounds("(Similarity $a $b)", "remote_link_creator")


def test_links_with_strengths(spark, engine):
    known = Knowledge(engine.store, engine.strengths_or_none(), Attention.empty(spark))
    h = [node_handle(f'"{x}"') for x in ("human", "monkey", "chimp")]
    rows = lambda *r: spark.createDataFrame(list(r), "a string, b string, strength double")
    known, done = known.add_or_update("Implication", rows((h[0], h[1], 0.5), (h[0], h[2], 0.05)))
    assert [(r["created"], r["updated"]) for r in done.collect()] == [(True, False)]
    assert known.attention.determiners.count() == 2 and known.attention.edges.count() == 2
    known, done = known.add_or_update("Implication", rows((h[0], h[1], 0.5)))
    assert [(r["created"], r["updated"]) for r in done.collect()] == [(False, False)]
    known, done = known.add_or_update("Implication", rows((h[0], h[1], 0.7)))
    assert [(r["created"], r["updated"]) for r in done.collect()] == [(False, True)]
    assert [r["strength"] for r in known.strengths.collect()] == [0.7]
    names = linking.mentioned(engine.store, engine.store.match([node_handle("Similarity"), h[0], h[2]]).select("handle"))
    assert sorted(r["name"] for r in names.collect()) == ['"chimp"', '"human"', "Similarity"]


def test_inference_through_links(spark):
    facts = spark.createDataFrame([("p", "c1", 1.0), ("q", "c2", 0.5), ("p", "c3", 0.4), ("q", "c3", 0.6)], "owner string, key string, w double")
    none = spark.createDataFrame([], "a string, b string")
    equal = spark.createDataFrame([("c1", "c2", 0.5)], "a string, b string, strength double")
    got = linking.implications(facts, none, 0.1).collect()
    assert [(r["a"], r["b"], round(r["strength"], 6)) for r in got] == [("q", "p", round(0.4 / 1.1, 6))]
    # p holds of c2 too now, with 1.0 * 0.5.
    got = linking.implications(facts, none, 0.1, equal=equal).collect()
    assert [(r["a"], r["b"], round(r["strength"], 6)) for r in got] == [("q", "p", round(0.9 / 1.1, 6))]
    share = spark.createDataFrame([("p", "base"), ("q", "base")], "owner string, name string")
    assert linking.implications(facts, none, 0.1, mentions=share).count() == linking.and_predicates(facts, none, share).count() == 0
    assert linking.and_predicates(facts, none).count() == 1
    # A key that everyone has pairs no one by itself, and what it adds to others isn't lost.
    rows = [(f"o{i}", "hub", 1) for i in range(40)] + [(f"o{i}", f"k{i // 2}", 9) for i in range(40)]
    hubs = spark.createDataFrame(rows, "owner string, key string, w int")
    pairs = linking.shared_weights(hubs, 0.5)
    assert pairs.count() == 20 and {r["common"] for r in pairs.collect()} == {10}


@pytest.mark.parametrize("rule", ["equivalences", "implications"])
def test_owners_with_equal_facts_are_compared_once(spark, monkeypatch, rule):
    """Classes give the pairs that owners give one by one, of copies too, and compare only one owner of each."""
    rng = random.Random(3)
    kinds = [{k: rng.randint(8, 10) for k in range(5)} for _ in range(6)]
    rows = [(f"o{i}", f"k{k}", w) for i in range(40) for k, w in kinds[rng.randrange(6)].items()]
    facts, linked = spark.createDataFrame(rows, "owner string, key string, w long"), spark.createDataFrame([("o1", "o2"), ("o9", "o3")], "a string, b string")
    compared, counted = [], linking.shared_weights
    monkeypatch.setattr(linking, "CHUNK", 3)
    monkeypatch.setattr(linking, "TASK_PAIRS", 100)
    monkeypatch.setattr(linking, "shared_weights", lambda f, *a: (compared.append(f.select("owner").distinct().count()), counted(f, *a))[1])
    for known in (linked, linked.limit(0)):
        got, want = (sorted(map(tuple, getattr(linking, rule)(facts, known, 0.93, classes=c, digits=6).collect())) for c in (True, False))
        assert got == want and len(want) > 100
    assert compared == [6, 40, 6, 40]


def test_federation_writes_to_writable_peers(spark, engine):
    nodes, links = load_expressions(spark.createDataFrame([('(New "a" "b")',)], "value string"))
    both = Federation((Peer(Store.empty(spark)), Peer(engine.store, writable=False)))
    after = both.added(Store(nodes, links))
    new = [r["handle"] for r in links.collect()]
    assert after.store().links.where(F.col("handle").isin(new)).count() == 1
    assert after.peers[1].store().links.where(F.col("handle").isin(new)).count() == 0
    near = after.peers[1].fetched([node_handle("Similarity"), None, None])
    assert near.local.links.count() == 14 and near.released().local is None
    kept = after.peers[0].flushed()
    assert kept.written is None and kept.store().links.count() == 1
    gone = after.deleted(links.select("handle")).store()
    assert gone.links.where(F.col("handle").isin(new)).count() == 0
    assert Store.empty(spark).is_empty() and not engine.store.is_empty()
    assert engine.store.matching(name='"human"')[0].count() == 1 and engine.store.matching(key=[node_handle("Similarity"), None, None])[1].count() == 14


def test_contexts_are_kept_by_name(engine, tmp_path):
    ask = ('(Similarity "human" $v)', "_0:$v", "$v")
    first = engine.create_context("c", *ask, cache=str(tmp_path))
    engine.contexts.clear()
    again = engine.create_context("c", "(no $such)", "", "", cache=str(tmp_path))
    assert again.nodes.count() == first.nodes.count() > 0
    assert engine.create_context("c", "(Similarity $no $such)", "", "", cache=str(tmp_path), recreate=True).nodes.count() == 0
    with pytest.raises(ValueError):
        engine.create_context("c", *ask, cache=str(tmp_path), use_cache=False, recreate=True)
    engine.set_rates(Rates(0.5, 0.2, 0.2), "c")
    assert engine.attention("c").rates.rent == 0.5 and engine.attention("d").rates.rent == 0.75


def test_products_by_blocks(spark, engine, monkeypatch):
    """A large product has the rows of a plain one, and its plan no product."""
    from weftgraph.plans import compiler

    left, right = (spark.range(50).selectExpr(f"concat('n', id) AS {c}", f"array(id) AS h{c}") for c in "lr")
    monkeypatch.setattr(compiler, "BLOCK", 7)
    for on in ([], [F.col("l") != F.col("r")]):
        monkeypatch.setattr(compiler, "SMALL_PRODUCT", 10_000)
        want = sorted(map(tuple, compiler.product(left, right, on).collect()))
        monkeypatch.setattr(compiler, "SMALL_PRODUCT", 100)
        got = compiler.product(left, right, on)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == want and len(want) == 2500 - 50 * len(on)
        assert "SortMergeJoin" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    answers = []
    for most in (10_000, 0):
        monkeypatch.setattr(compiler, "SMALL_PRODUCT", most)
        found = engine.query("(and (Similarity $a $b) (Inheritance $c $d))", QueryOptions(unique_value=True))
        answers.append(sorted((r["v_a"], r["v_b"], r["v_c"], r["v_d"], *r["handles"]) for r in found.collect()))
    assert answers[0] == answers[1] and answers[0]


def test_best_share(spark):
    rows = [(md5(str(i)), float(i % 3 == 0) + 0.5 * float(i == 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "handle string, importance double")
    order = [h for h, i in sorted(rows, key=lambda r: (-r[1], r[0]))]
    for share, n in ((0.001, 1), (0.3, 90), (0.34, 102), (0.5, 150), (1, 1)):
        for sorted_rows in (0, 1000):
            assert sorted(r["handle"] for r in best_share(df, share, sorted_rows).collect()) == sorted(order[:n])
    assert best_share(df.limit(0), 0.3).count() == 0
