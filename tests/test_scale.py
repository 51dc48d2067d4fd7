"""Odd rows and dense groups that larger tables hold, against the SQL of the query or a plain version."""

import hashlib
import shutil

import duckdb

import __spark_entry__ as entry
from lodestrand.operators import compose as P
from lodestrand.operators import contracts as C
from lodestrand.operators import graph as G
from lodestrand.operators import tuning as T


def said(name, **tables):
    con = duckdb.connect()
    for t, path in tables.items():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    found = con.sql(entry.oracle_sql()[name])
    return sorted(tuple(r) for r in found.fetchall()), found.columns


def test_boolean_questions_of_other_scripts(spark, tmp_path):
    texts = ["Doó que", "Isñ", "İs it", " 　 Is it", "is", "Is-it", "\tis it", "isa", None, "is2", "do_it", "did́"]
    spark.createDataFrame([(k, 0, "user", t) for k, t in enumerate(texts)], "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    expected, columns = said("boolean_questions", conversations=f"{tmp_path}/conversations.parquet/*.parquet")
    found = entry.queries()["boolean_questions"](spark, str(tmp_path))
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == expected
    assert [r[-1] for r in expected] == [1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 1]


def test_manifest_of_a_table_of_several_files(spark, sf_dir, tmp_path):
    """A row for a table, whether it is a file or a folder of files; the hash tells a change in any of them."""
    shutil.copy(f"{sf_dir}/customer.parquet", tmp_path)
    spark.read.parquet(f"{sf_dir}/labels.parquet").repartition(3).write.parquet(f"{tmp_path}/labels.parquet")
    found = entry.queries()["file_manifest"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == said("file_manifest")[0]
    whole = lambda top: {r["name"]: r for r in C.manifest(spark, [f"{top}/labels.parquet", f"{tmp_path}/customer.parquet"]).collect()}
    before = whole(tmp_path)
    assert before["customer.parquet"]["sha256"] == hashlib.sha256((tmp_path / "customer.parquet").read_bytes()).hexdigest()
    parts = sorted((tmp_path / "labels.parquet").glob("part-*"))
    assert before["labels.parquet"]["size"] == sum(p.stat().st_size for p in parts)
    copy, other = tmp_path / "copy" / "labels.parquet", tmp_path / "other" / "labels.parquet"
    for top in (copy, other):
        top.mkdir(parents=True)
        for p in parts:
            (top / p.name).write_bytes(p.read_bytes()[::-1] if top is other and p is parts[1] else p.read_bytes())
    assert whole(tmp_path / "copy") == before
    assert whole(tmp_path / "other")["labels.parquet"]["sha256"] != before["labels.parquet"]["sha256"]


def test_support_vectors_try_patterns_once(spark, sf_dir):
    """The plan holds the patterns of a unit and of the question a few times, not once for each value that uses them."""
    plan = entry.queries()["support_vectors"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("regexp_extract") < 40


def test_enumerated_lists_stand_once_for_pools_of_a_size(spark):
    pools = spark.createDataFrame([(k, [f"{k}-{c}" for c in "dabce"]) for k in range(3)], "example int, units array<string>")
    lists = P.enumerated_lists(pools, 2, 11, 7).orderBy("example", "size").collect()
    assert [(r["size"], r["before"], len(r["members"])) for r in lists] == [(1, 0, 5), (2, 5, 6)] * 3
    assert len({str(r["members"]) for r in lists}) == 2
    rows = P.enumerated(pools, 2, 11, 7).where("example = 1").orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(1, 12)) and rows[5]["units"] == ["1-a", "1-d"]


def test_paths_go_no_further_than_their_goals(spark):
    """The graph goes on for a hundred steps behind the goal; only the goal's two are taken."""
    links = spark.createDataFrame([(f"n{k}", "to", f"n{k + 1}") for k in range(100)], "src string, rel string, dst string")
    goals = spark.createDataFrame([("n0", "n2"), ("n0", "n0"), ("n50", "n49")], "root string, goal string")
    found = {(r["root"], r["goal"]): (r["nodes"], r["relations"]) for r in G.all_shortest_paths(goals, links).collect()}
    assert found == {("n0", "n2"): (["n0", "n1", "n2"], ["to", "to"]), ("n0", "n0"): (["n0"], []), ("n50", "n49"): (["n50", "n49"], ["to"])}


def test_trials_take_the_first_of_the_best(spark):
    rows = spark.createDataFrame([("a", 1, "y", 1.0, 0.25, 0.0), ("a", 1, "x", 1.0, 0.5, 0.0), ("a", 1, "z", 0.0, 1.0, 2.0), ("a", 2, "x", 0.5, 0.0, 1.0), ("b", 3, "x", None, 0.75, 1.0), ("b", 4, "x", 0.1, None, 1.0), ("b", 4, "y", 0.1, 0.125, 1.0), ("b", 5, "x", 0.1, 0.625, 1.0)], "dataset string, example int, identity string, base double, f1 double, size double")
    assert T.evaluate(T.grouped(rows, ["size"]), [{"size": 0.0}, {"size": 1.0}]) == [{"a": 0.25, "b": 0.625}, {"a": 0.5, "b": 0.625}]


def dense_graph(spark):
    """Two examples of 70 and 5 nodes, sentences beyond one word of bits, some of them anchors; and what they are in plain Python."""
    rows = [(e, a, b) for e, n in ((1, 70), (2, 5)) for a in range(n) for b in range(a + 1, n) if (a * 7 + b * 3) % 5 < 2]
    nodes = [(e, k, round(0.013 * (k % 9), 6), k % 6 == 1) for e, n in ((1, 70), (2, 5)) for k in range(n)]
    near = {}
    for e, a, b in rows:
        near.setdefault((e, a), set()).add(b)
        near.setdefault((e, b), set()).add(a)
    return spark.createDataFrame(nodes, "example long, node int, score double, is_anchor boolean"), spark.createDataFrame(rows, "example long, src int, dst int"), nodes, near


def test_triples_are_counted_without_a_list(spark):
    nodes, edges, given, near = dense_graph(spark)
    sets = {(e, *sorted((x, y, z))) for e, x, _, anchor in given if anchor for y in near.get((e, x), ()) for z in near[e, x] | near[e, y] if z not in (x, y)}
    expected = {e: (sum(s[0] == e for s in sets), sum(s[1] * 961 + s[2] * 31 + s[3] for s in sets if s[0] == e)) for e in {s[0] for s in sets}}
    assert {r["example"]: (r["triples"], r["checksum"]) for r in G.closure_triple_sums(nodes, edges, (961, 31, 1)).collect()} == expected
    assert {tuple(r) for r in G.closure_triples(nodes, edges).collect()} == sets


def test_anchor_pairs_make_no_row_of_a_neighbour(spark):
    nodes, edges, given, near = dense_graph(spark)
    expected = {(e, x, y): len((near[e, x] | near[e, y]) - {x, y}) for e, x, _, anchor in given if anchor for y in near.get((e, x), ())}
    assert {(r["example"], r["seed"], r["other"]): r["around"] for r in G.anchor_pairs(nodes, edges).collect()} == expected


def test_titles_of_one_common_word(spark, tmp_path):
    """Titles share their words, pages their titles; a title counts once in a sentence, whole words alone."""
    texts = ["alpha beta gamma delta epsilon. alpha beta gamma delta zeta", "the alpha alpha alpha alpha alpha. Alpha-beta", "alphabeta gamma. alpha", None, "beta gamma delta"]
    titles = ["alpha beta gamma delta epsilon", "Alpha", "alpha", "alpha alpha alpha alpha alpha", "alpha alpha alpha alpha beta", "beta gamma", "a", "", "gamma delta", "zzz yyy"]
    spark.createDataFrame([(k, t, "en", "web") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, f"<title>{t}</title>") for k, t in enumerate(titles)], "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    expected, columns = said("title_mentions", documents=f"{tmp_path}/documents.parquet/*.parquet", pages=f"{tmp_path}/pages.parquet/*.parquet")
    found = entry.queries()["title_mentions"](spark, str(tmp_path))
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == expected and len(expected) == 6


def test_edges_of_documents_equal_those_of_joins(spark, sf_dir):
    """All four rules at once within a document, against the operators that join on terms."""
    from lodestrand.jobs import graphs as J

    q = entry.queries()
    rules = [q[n](spark, sf_dir) for n in ("adjacent_sentences", "title_token_edges", "shared_entity_edges", "bridge_token_edges")]
    joined = rules[0].union(rules[1]).union(rules[2]).union(rules[3]).distinct()
    edges = J._graph(spark, sf_dir)[1]
    assert edges.schema.simpleString() == joined.schema.simpleString()
    assert edges.count() == joined.count() and edges.exceptAll(joined).isEmpty()


def test_beams_unit_by_unit_equal_those_over_whole_contexts(spark):

    units = [(k, p, u, 0.1 * (p % 4)) for k in (1, 2) for p, u in enumerate([*(f"c{j} in n{j % k}" for j in range(14)), "SubObjectPropertyOf(in,at)", "a b c d", "n0 at r", "SubObjectPropertyOf(at,near)"])]
    rows = spark.createDataFrame(units, "example int, place int, unit string, score double")
    asked = spark.createDataFrame([(1, ["c1", "r"], ["at"]), (2, ["n1"], ["in"])], "example int, entities array<string>, properties array<string>")
    sets = lambda df: sorted((r["example"], tuple(r["members"]), r["score"]) for r in df.collect())
    assert sets(P.axiom_beam_rows(rows, 1, 4, 5, 9)) == sets(P.axiom_beam(P.contexts(rows), 1, 4, 5, 9))
    w = P.Weights(beam=6, most_subsets=100)
    info = P.contexts(rows).join(asked, "example")
    assert sets(P.compose_rows(rows, asked, 3, w)) == sets(P.compose(info, 3, w))
    assert "near" not in P.context_rows(rows).select("node.*").columns


def test_degrees_of_edges_that_stand_once(spark):
    nodes, edges, given, near = dense_graph(spark)
    asked = nodes.selectExpr("example", "node", "1 as overlap", "0 as title_overlap", "2 as asked")
    for once in (False, True):
        assert {(r["example"], r["node"]): r["degree"] for r in G.node_scores(asked, edges, once).collect()} == {(e, k): len(near.get((e, k), ())) for e, k, _, _ in given}
