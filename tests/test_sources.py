"""Trace tree, audit, side files, HTML, fingerprints, stores and rebuilds."""

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from plumbline.fixed_values import SIGNATURE_FIELDS
from plumbline.plans import audit as A
from plumbline.plans import cohorts as C
from plumbline.sources import files as S
from plumbline.sources import html as H
from plumbline.sources import manifests as M
from plumbline.sources import trace as T
from plumbline.streaming import incremental as I

CAND = ["run_number", "node_number", "node_depth", "sep_round_node", "root", "is_forced",
        "is_selected", "is_applied", "cut_id", "rank", "coeff_sparsity_ratio",
        *SIGNATURE_FIELDS]
OTHER = {
    "applied_cuts.csv": ["run_number", "cut_name"],
    "lp_states.csv": ["run_number"],
    "sep_round_transitions.csv": ["run_number", "node_depth"],
}
COLUMNS = {"candidate_cuts.csv": CAND, **OTHER}


def line(cut, applied="False", forced="False", step="1"):
    row = {c: "1.0" for c in CAND} | {
        "run_number": "1", "node_number": "1", "node_depth": "0", "sep_round_node": step,
        "root": "True", "is_forced": forced, "is_selected": "True" if forced == "True" else "",
        "is_applied": applied, "cut_id": cut, "cut_name": '"assign(A,B)"', "origin_type": "SEPA",
    }
    return ",".join(row[c] for c in CAND)


def unit(root, split, name, lines, stats="hybrid : 0.03 0.00 2 1 2 0 2 9", runs=1):
    d = root / f"benchmark_output_{split}" / name
    d.mkdir(parents=True)
    (d / "candidate_cuts.csv").write_text("\n".join([",".join(CAND), *lines]) + "\n")
    (d / "applied_cuts.csv").write_text('run_number,cut_name\n1,"pairUp(C,D)"\n1,last\n')
    (d / "lp_states.csv").write_text("run_number\n1\n")
    (d / "sep_round_transitions.csv").write_text("run_number,node_depth\n1,0\n1,0\n")
    (d / "summary.json").write_text(
        json.dumps({"status": "optimal", "n_candidate_cuts": len(lines), "n_lp_states": 1}, indent=1)
    )
    logger = stats.replace("hybrid", "py_cutsel_logger")
    (d / "scip_statistics.txt").write_text(f"  {logger}\n  {stats}\n number of runs : {runs}\n")
    return d


@pytest.fixture
def tree(tmp_path):
    unit(tmp_path, "train", "u1", [line("1", "True"), line("1", step="1"), line("2"), line("3", step="2")])
    return tmp_path


def audited(spark, tree, **kw):
    return A.audit_corpus(spark, str(tree), COLUMNS, expected_units=1, **kw)


def failed(audit):
    return {r["check"] for r in audit.checks.collect() if not r["passed"]}


def test_audit_of_a_small_tree(spark, tree):
    a = audited(spark, tree)
    r = a.report.first()
    assert (r["rows"], r["decision_groups"], r["groups_with_duplicate_id"]) == (4, 2, 1)
    assert (r["calls"], r["selected"], r["filtered"], r["candidate_rows"]) == (2, 2, 2, 4)
    assert (r["duplicate_applied_rows"], r["transition_rows"]) == (0, 2)
    assert failed(a) == {"sparsity_feature_is_nonconstant", "applied_label_has_no_ambiguous_ids"}
    ratios = {x["metric"]: x["value"] for x in a.ratios.collect()}
    assert ratios["applied_label_fraction"] == 0.25 and ratios["transition_coverage"] == 1.0


def test_audit_reports_faults(spark, tree):
    bad = unit(tree, "val", "u2", [line("7")], runs=3)
    (bad / "lp_states.csv").write_text("runs\n1\n")
    gone = unit(tree, "val", "u3", [line("7")])
    (gone / "summary.json").unlink()
    a = audited(spark, tree)
    assert [(r["unit"], r["file"]) for r in a.missing_files.collect()] == [("u3", "summary.json")]
    assert [(r["unit"], r["file"]) for r in a.header_mismatches.collect()] == [("u2", "lp_states.csv")]
    assert [r["unit"] for r in a.run_mismatches.collect()] == ["val/u2"]
    assert {"all_required_files_present", "headers_are_consistent", "observed_runs_match_reported"} <= failed(a)


def test_quoted_names_malformed_rows_and_order(spark, tree):
    path = tree / "benchmark_output_train" / "u1" / "applied_cuts.csv"
    path.write_text('run_number,cut_name\n1,"pairUp(C,D)"\nbroken\n2,last\n')
    rows = T.read_trace(spark, str(tree), "applied_cuts.csv", OTHER["applied_cuts.csv"], ordered=True)
    got = [(r["run_number"], r["cut_name"], r["unit"], r["split"]) for r in rows.orderBy("_block", "_row").collect()]
    assert got == [("1", "pairUp(C,D)", "u1", "train"), ("2", "last", "u1", "train")]
    marked = T.read_trace(
        spark, str(tree), "applied_cuts.csv", OTHER["applied_cuts.csv"], malformed=True
    )
    r = T.malformed_counts(marked, "run_number").first()
    assert (r["rows"], r["malformed_rows"], r["parsed_rows"]) == (3, 1, 2)


def test_statistics_text(spark):
    df = spark.createDataFrame([("x\n  hybrid : 0.03 0.00 99 11 2838 0 10789\n",), ("none",)], "value string")
    got = [tuple(r[c] for c in T.STATISTICS) for r in T.selector_statistics(df, "hybrid").collect()]
    assert got == [(99, 11, 2838, 0, 10789), (None,) * 5]


def test_headers_follow_the_split_order_and_are_parsed(spark):
    head = spark.createDataFrame(
        [("test", "a", "x,z"), ("train", "b", '"x",y'), ("train", "c", "x,y"), ("val", "d", '"x","y"')],
        "split string, unit string, header string",
    )
    assert [r["unit"] for r in T.header_mismatches(head).collect()] == ["a"]


def test_cell_text_keeps_parts_apart_and_decodes_references(spark):
    df = spark.createDataFrame(
        [("2<br>3 <b>x</b>y caf&eacute; &#233;&#xE9; &amp;lt; &nope; &#128512; a&b &nbsp;",)], "h string"
    )
    got = df.select(H.inner_text(F.col("h"))).first()[0]
    assert got == "2 3 x y café éé &lt; &nope; \U0001f600 a&b"


def test_line_lists_and_metadata(spark, tmp_path):
    (tmp_path / "a.test").write_text("# head\n a \n\nb\na\n")
    lines = T.read_lines(spark, str(tmp_path / "a.test"), comments=True)
    assert sorted(r[0] for r in lines.collect()) == ["a", "a", "b"]
    assert [r["line"] for r in T.duplicate_lines(lines).collect()] == ["a"]
    (tmp_path / "m.csv").write_text("instance_name,group\na,\nb,B\n")
    df = T.read_metadata(spark, str(tmp_path / "m.csv"), ["group"], "instance_name")
    assert sorted(map(tuple, df.collect())) == [("a", ""), ("b", "B")]
    with pytest.raises(ValueError, match="lacks columns"):
        T.read_metadata(spark, str(tmp_path / "m.csv"), ["tags"], "instance_name")
    (tmp_path / "m.csv").write_text("instance_name,group\na,\na,B\n")
    with pytest.raises(ValueError, match="duplicate"):
        T.read_metadata(spark, str(tmp_path / "m.csv"), ["group"], "instance_name")


def test_manifest_to_pairs(spark, tmp_path):
    outcome = {"status": "optimal", "primal_bound": "inf", "nodes": 3}
    action = {"outcome": outcome, "selector": {"interventions": 1}, "comparison": {"safe": True}}
    doc = {"time_limit": 60, "per_instance": [{"instance_id": "u", "pairs": [
        {"seed": s, "native_outcome": outcome, "actions": {"a": action, "b": action}} for s in (1, 2)
    ]}]}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=1))
    flat = M.flat_manifest(M.read_manifest(spark, str(tmp_path / "m.json")))
    got = flat.select("unit", "seed", "arm", "native.primal_bound", "treatment.selector.interventions")
    assert sorted(map(tuple, got.collect())) == [
        ("u", s, a, "inf", 1) for s in (1, 2) for a in ("a", "b")
    ]


def test_gzip_records(spark, tmp_path):
    M.write_records(spark.range(3), str(tmp_path / "r"))
    files = list((tmp_path / "r").glob("*.gz"))
    text = "".join(gzip.decompress(f.read_bytes()).decode() for f in files)
    assert sorted(text.split()) == ['{"id":0}', '{"id":1}', '{"id":2}']


def cell_row(name, group, status):
    cells = [name, *"123456", "me", group, status, "9*"]
    return "<tr>" + "".join(f"<td> {c}</td>" for c in cells) + "</tr>"


def page(*rows):
    return f'<table id="c"><thead><tr><th>x</th></tr></thead><tbody>{"".join(rows)}</tbody></table>'


def test_collection_metadata(spark):
    html = page(cell_row("a", "g", "Easy"), cell_row("b", "–", "hard"), cell_row("c", "-", "easy"))
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    easy = spark.createDataFrame([("a",), ("b",)], "unit string")
    infeasible = spark.createDataFrame([("b",)], "unit string")
    got = C.collection_metadata(pages, easy, infeasible, table_id="c").orderBy("unit").collect()
    assert [r["status"] for r in got] == ["easy", "infeasible", "not-easy-current"]
    assert [r["group"] for r in got] == ["g", "", ""] and got[1]["tags"] == "infeasible"
    bad = spark.createDataFrame([(1, page("<tr><td>x</td></tr>"))], "page_id int, html string")
    with pytest.raises(Exception, match="11 cells"):
        H.checked_cells(H.table_rows(bad, "c"), C.CELL_NAMES).collect()


def test_fingerprints_and_verification(spark, tmp_path):
    for name in ("a.txt", "b.txt", "c.md"):
        (tmp_path / name).write_text(name)
    tiers = {"all": [str(tmp_path / "*")], "text": [str(tmp_path / "*.txt")]}
    prints = S.fingerprint(spark, tiers)
    totals = {r["tier"]: (r["files"], r["bytes"]) for r in S.tier_totals(prints).collect()}
    assert totals == {"all": (3, 14), "text": (2, 10)}
    kept = spark.createDataFrame(prints.collect(), prints.schema)
    (tmp_path / "a.txt").write_text("changed")
    (tmp_path / "c.md").unlink()
    (tmp_path / "d.md").write_text("new")
    now = S.fingerprint(spark, {"all": [str(tmp_path / "*")]})
    got = {r["path"].rsplit("/", 1)[1]: r["problem"] for r in S.verify(kept, now).collect()}
    assert got == {"a.txt": "content-mismatch", "c.md": "missing", "d.md": "unexpected"}
    with pytest.raises(Exception):
        S.fingerprint(spark, {"none": [str(tmp_path / "*.nothing")]}).collect()


@pytest.mark.parametrize("limit", [0, 1000, 1 << 30])
def test_large_files_are_streamed_to_the_same_digests(spark, tmp_path, limit):
    texts = {"a.txt": b"", "b c%20é.txt": b"x" * 1000, "d#?.txt": bytes(range(256)) * 70_000}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    got = S.fingerprint(spark, {"all": [str(tmp_path)]}, whole_bytes=limit).collect()
    assert {r["path"].rsplit("/", 1)[1]: (r["sha256"], r["bytes"]) for r in got} == {
        n: (hashlib.sha256(t).hexdigest(), len(t)) for n, t in texts.items()
    }


def test_sealed_subsets_cannot_be_loaded(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "seen_family_test")], "x int, subset string")
    S.write_ranking_dataset(df, str(tmp_path / "d"))
    assert S.read_ranking_dataset(spark, str(tmp_path / "d"), "train").count() == 1
    with pytest.raises(ValueError, match="sealed"):
        S.read_ranking_dataset(spark, str(tmp_path / "d"), "seen_family_test")
    with pytest.raises(ValueError, match="prohibited"):
        S.write_ranking_dataset(df.withColumn("solving_time", F.lit(1)), str(tmp_path / "e"))


def test_only_changed_sources_are_rebuilt(spark, tree, tmp_path):
    unit(tree, "val", "u2", [line("7")])
    glob = "benchmark_output_*/*/candidate_cuts.csv"
    sink, log = str(tmp_path / "sink"), str(tmp_path / "log")

    def step(revision):
        listing = T.file_listing(spark, str(tree), glob)
        done = spark.read.parquet(log) if (tmp_path / "log").exists() else None
        todo = I.source_signatures(listing, revision)
        built = I.rebuild(todo, done, lambda t: t.select("split", "unit", "length"), sink, log)
        return sorted(r["unit"] for r in I.pending(todo, done).collect()), built

    assert step("r1")[0] == ["u1", "u2"]
    assert step("r1")[0] == []
    path = tree / "benchmark_output_val" / "u2" / "candidate_cuts.csv"
    path.write_text(path.read_text() + line("8") + "\n")
    assert step("r1")[0] == ["u2"]
    assert step("r2")[0] == ["u1", "u2"]
    assert spark.read.parquet(sink).count() == 2


def test_headers_sort_no_lines(spark, tmp_path, capsys):
    for unit in range(3):
        folder = tmp_path / f"benchmark_output_train/u{unit}"
        folder.mkdir(parents=True)
        (folder / "x.csv").write_text(f"a,b{unit}\n" + "z,1\na,2\n" * 30_000)
    head = T.headers(spark, str(tmp_path), "x.csv")
    assert sorted((r["unit"], r["header"]) for r in head.collect()) == [(f"u{i}", f"a,b{i}") for i in range(3)]
    head.explain()
    assert "Sort" not in capsys.readouterr().out
