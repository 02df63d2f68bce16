"""Files, generated workloads and materialised mappings."""

import pytest

from weftgraph.plans.compiler import Compiler
from weftgraph.sources import jdbc
from weftgraph.sources.expressions import handle_of, load_file, statements, write_expressions
from weftgraph.sources.generated import sentences
from weftgraph.sources.relational import TableSpec, map_query, map_tables, synced
from weftgraph.streaming.ingest import compacted, events_of, ingested


def test_expressions_over_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text('(a ; note\n  "x y")\n\n(b (a "x y"))\n')
    nodes, links = load_file(spark, str(tmp_path / "a.txt"), multiline=True)
    assert sorted(r["expr"] for r in links.where("is_toplevel").collect()) == ['(a "x y")', '(b (a "x y"))']
    write_expressions(links, str(tmp_path / "out"))
    again = load_file(spark, str(tmp_path / "out"))
    assert {r["handle"] for r in again[1].collect()} == {r["handle"] for r in links.collect()}
    assert nodes.count() == 3


def test_statements():
    assert statements("select 1\n-- note\nselect 2\nfrom t\n\nselect 3") == ["select 1", "select 2\nfrom t", "select 3"]


def test_generated_sentences(spark):
    nodes, links = sentences(spark, 50, letters=2, word_length=1, words=3)
    found = Compiler(spark, links).compile('(Contains (Sentence $s) (Word "a"))')
    texts = {r["name"] for r in nodes.where("name like '% %'").collect()}
    assert found.count() == sum("a" in t for t in texts)


def test_materialised_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "k int, v string")
    spec = [TableSpec("t", "k")]
    first = synced(spark, str(tmp_path), {"t": df}, spec)[1].count()
    assert synced(spark, str(tmp_path), {"t": df.limit(0)}, spec)[1].count() == first > 0


def test_query_columns_are_mapped_by_name(spark):
    spark.createDataFrame([(1, "x", 7)], "k int, v string, r int").createOrReplaceTempView("t_view")
    _, links = map_query(spark, "SELECT k AS t__k, v AS t__v, r AS u__k FROM t_view", {"t": TableSpec("t", "k"), "u": TableSpec("u", "k")})
    top = {r["expr"] for r in links.where("is_toplevel").collect()}
    assert top == {'(Evaluation (Predicate t) (Concept (t "1")))', '(Evaluation (Predicate (t t.v "x")) (Concept (t "1")))', '(Evaluation (Predicate u) (Concept (u "7")))'}


def tops(links):
    return {r["expr"] for r in links.where("is_toplevel").collect()}


def test_conditions_and_referenced_rows(spark):
    tables = {
        "t": spark.createDataFrame([(1, 7, "x"), (2, 8, "x"), (3, 9, "y"), (4, None, "x")], "k int, r int, v string"),
        "u": spark.createDataFrame([(7, "seven"), (8, "eight"), (9, "nine")], "id int, name string"),
    }
    spec = TableSpec("t", "k", {"r": "u"}, where=("v = 'x'", "k <> 2"))
    _, links = map_tables(tables, [spec], [TableSpec("u", "id")])
    assert tops(links) == {
        '(Evaluation (Predicate t) (Concept (t "1")))', '(Evaluation (Predicate (t.r (Concept (u "7")))) (Concept (t "1")))', '(Evaluation (Predicate (t t.v "x")) (Concept (t "1")))',
        '(Evaluation (Predicate t) (Concept (t "4")))', '(Evaluation (Predicate (t t.v "x")) (Concept (t "4")))',
        '(Evaluation (Predicate u) (Concept (u "7")))', '(Evaluation (Predicate (u u.name "seven")) (Concept (u "7")))',
    }
    assert tops(map_tables(tables, [spec])[1]) == {e for e in tops(links) if "Predicate u)" not in e and "u.name" not in e}


def test_database(spark):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    url = "jdbc:derby:memory:weftgraph;create=true"
    with jdbc.connected(spark, url) as c:
        run = c.createStatement().execute
        run("CREATE TABLE BIG (ID INT PRIMARY KEY, NAME VARCHAR(20))")
        run("CREATE TABLE SMALL (CODE VARCHAR(5) PRIMARY KEY, BIG_ID INT REFERENCES BIG)")
        run("CREATE TABLE PAIRED (A INT NOT NULL, B INT NOT NULL, PRIMARY KEY (A, B))")
        run("INSERT INTO BIG VALUES " + ", ".join(f"({i}, 'n{i}')" for i in range(1, 41)))
        run("INSERT INTO SMALL VALUES ('a', 3), ('b', 9), ('c', NULL)")
    assert jdbc.table_names(spark, url, "APP") == ["PAIRED", "SMALL", "BIG"]
    specs = jdbc.table_specs(spark, url, ["SMALL", "BIG"], "APP")
    assert specs == [TableSpec("SMALL", "CODE", {"BIG_ID": "BIG"}), TableSpec("BIG", "ID")]
    with pytest.raises(ValueError):
        jdbc.table_specs(spark, url, ["PAIRED"], "APP")
    tables = {s.name: jdbc.read_table(spark, url, s, 4, "APP") for s in specs}
    assert tables["BIG"].rdd.getNumPartitions() == 4 and tables["BIG"].count() == 40
    assert "PushedFilters: [*IsNotNull(ID), *LessThan(ID,5)]" in tables["BIG"].where("ID < 5")._jdf.queryExecution().toString()
    _, links = map_tables(tables, [specs[0]], [specs[1]])
    assert {e for e in tops(links) if "BIG.NAME" in e} == {f'(Evaluation (Predicate (BIG BIG.NAME "n{i}")) (Concept (BIG "{i}")))' for i in (3, 9)}


def logged(spark, path, number, rows):
    events_of(spark.createDataFrame(rows, "seq long, command string, value string")).write.mode("overwrite").parquet(f"{path}/batch={number}")


def state(spark, path):
    store = ingested(spark, path)
    return sorted((r["expr"], r["is_toplevel"]) for r in store.links.collect()), sorted(r["name"] for r in store.nodes.collect())


def test_deletes_in_a_log(spark, tmp_path):
    path, h = str(tmp_path / "log"), handle_of
    inner, outer = ["a", "x"], ["b", ["a", "x"]]
    assert state(spark, path) == ([], [])
    logged(spark, path, 0, [(0, "add_atoms", "(a x)"), (1, "add_atoms", "(b (a x))"), (2, None, "(a y)")])
    assert state(spark, path) == ([("(a x)", True), ("(a y)", True), ("(b (a x))", True)], ["a", "b", "x", "y"])
    logged(spark, path, 1, [(0, "delete_atoms", f"{h(inner)} {h(['a', 'y'])}"), (0, "delete_atoms", h("y")), (1, "delete_atoms", h("unknown"))])
    held = ([("(a x)", False), ("(b (a x))", True)], ["a", "b", "x"])  # what (b (a x)) holds stays
    for _ in range(2):
        assert state(spark, path) == held
        logged(spark, path, 1, [(0, "delete_atoms", f"{h(inner)} {h(['a', 'y'])} {h('y')}")])  # a batch that is written anew
    compacted(spark, path, str(tmp_path / "short"))
    assert state(spark, str(tmp_path / "short")) == held
    logged(spark, path, 2, [(5, "delete_atoms", h(outer)), (1, "add_atoms", "(a z)")])
    assert state(spark, path) == ([("(a z)", True)], ["a", "b", "x", "z"])  # the deletes of before take effect
    logged(spark, path, 3, [(0, "add_atoms", "(b (a x))"), (1, "delete_atoms", h(outer))])
    assert state(spark, path)[0] == [("(a x)", False), ("(a z)", True)]  # an expression's addition adds all within it
    logged(spark, path, 4, [(0, "add_atoms", "(a x)")])
    assert state(spark, path)[0] == [("(a x)", True), ("(a z)", True)]
    with pytest.raises(Exception, match="unknown command"):
        logged(spark, path, 5, [(0, "forget", "(a x)")])
    assert state(spark, path)[0] == [("(a x)", True), ("(a z)", True)]
