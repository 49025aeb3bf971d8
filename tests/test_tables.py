"""Sources, store, review, patches and the light queries against DuckDB."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from codesift import schemas as S
from codesift.operators import findings, patch, state, views
from codesift.plans.oracles import ORACLES
from codesift.plans.queries import QUERIES
from codesift.sources import files, store

SF = "/root/testdata/sf0.001"
HEAVY = {n for n in QUERIES if n.startswith(("rule_", "py_", "sql_", "candidates", "scan_", "scala_"))} | {
    "comment_mask", "default_findings", "job_summary", "lex_status"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(set(QUERIES) - HEAVY) + ["scala_string_literals", "rule_select_star"])
def test_against_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    want = sorted(duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall(), key=repr)
    assert got == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_local_tree(spark, tmp_path):
    (tmp_path / "a" / "venv").mkdir(parents=True)
    (tmp_path / "a" / "x.py").write_text("print('é')\n", encoding="utf-8")
    (tmp_path / "a" / "bad.sql").write_bytes(b"SELECT \xff")
    (tmp_path / "a" / "venv" / "y.py").write_text("1")
    (tmp_path / ".py").write_text("1")
    (tmp_path / "big.SQL").write_text("SELECT 1" * 10)
    (tmp_path / "data.bin").write_bytes(b"0" * 10_000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)  # a file that is opened in vain fails the scan
    rows = {r.path: r for r in files.scan_local_tree(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a/x.py", "big.SQL"}
    spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert rows["a/x.py"].content == "print('é')\n" and rows["a/x.py"].repo == f"local/{tmp_path.name}"
    assert {r.path for r in files.scan_local_tree(spark, str(tmp_path), max_file_bytes=20).collect()} == {"a/x.py"}


def sample(spark, rows):
    base = {f.name: None for f in S.FINDINGS.fields}
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], S.FINDINGS)


def test_store(spark, tmp_path):
    path = str(tmp_path / "findings")
    store.save_findings(sample(spark, [{"id": "1", "job_id": "a", "title": "old"}, {"id": "2", "job_id": "b"}]), path)
    store.save_findings(sample(spark, [{"id": "1", "job_id": "a", "title": "new"}]), path)
    store.save_findings(sample(spark, [{"id": "3", "job_id": "a"}]), path)
    assert {(r.id, r.title) for r in store.load_findings(spark, path).collect()} == {("1", "new"), ("2", None), ("3", None)}
    jobs = spark.createDataFrame([("j", "r", "main", "local", "", 1, 2, 3)], S.JOBS)
    store.save_jobs(jobs, str(tmp_path / "jobs"), 1)
    store.save_jobs(jobs.withColumn("repo", F.lit("s")), str(tmp_path / "jobs"), 2)
    assert [r.repo for r in store.load_jobs(spark, str(tmp_path / "jobs")).collect()] == ["s"]
    with pytest.raises(ValueError):
        views.list_findings(store.load_findings(spark, path), status="open")


def test_store_keeps_its_state_when_a_save_stops(spark, tmp_path, monkeypatch):
    """A save that stops after its rows are written and before the swap changes nothing; the next one goes through."""
    path = str(tmp_path / "findings")
    store.save_findings(sample(spark, [{"id": "1", "job_id": "a/b=c", "title": "old"}, {"id": "2", "job_id": "b"}]), path)
    before, swap = store.current_folders(spark, path), store.swap_folders

    def stop(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(store, "swap_folders", stop)
    with pytest.raises(KeyboardInterrupt):
        store.save_findings(sample(spark, [{"id": "1", "job_id": "a/b=c", "title": "new"}]), path)
    assert store.current_folders(spark, path) == before
    titles = lambda: {(r.id, r.title) for r in store.load_findings(spark, path).collect()}
    assert titles() == {("1", "old"), ("2", None)}
    monkeypatch.setattr(store, "swap_folders", swap)
    held = store.load_findings(spark, path)  # a reader of the state before
    store.save_findings(sample(spark, [{"id": "1", "job_id": "a/b=c", "title": "new"}, {"id": "9", "job_id": "c"}]), path)
    assert titles() == {("1", "new"), ("2", None), ("9", None)} and held.count() == 2
    with pytest.raises(RuntimeError, match="another save"):
        store.swap_folders(spark, path, before, [])
    assert store.load_findings(spark, str(tmp_path / "none")).count() == 0


def test_patches_never_broadcast_contents(spark):
    source = spark.createDataFrame([("r", "m", "a.py", "", 0, "x")], S.SOURCE_FILES)
    edits = sample(spark, [{"id": "1", "start_line": 1, "end_line": 1, "snippet": "x", "proposed_snippet": "y", "repo": "r", "ref": "m",
                            "file_path": "a.py"}])
    plan = patch.patched_files(edits, source)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "ShuffledHashJoin" in plan


# name of the file: its text, its findings as (id, start line, end line, snippet, rewrite), and the text they must give
PATCHED = {
    "one.py": ("red\ngreen\nblue\n", [("a", 2, 2, "green", "teal")], "red\nteal\nblue\n"),
    "first.py": ("x x x", [("a", 1, 1, "x", "y")], "y x x"),
    "lines.py": ("a\nb\nc\nd\n", [("a", 2, 3, "not there", "B\nC\nCC")], "a\nB\nC\nCC\nd\n"),
    "beyond.py": ("a\nb", [("a", 2, 9, "gone", "z")], "a\nz"),
    "three.py": ("k\nl\nm\nn\n", [("a", 1, 1, "k", "K"), ("b", 3, 3, "absent", "M\nMM"), ("c", 4, 4, "n", "")],
                 "K\nl\nM\nMM\n\n"),
    "top.py": ("a\n", [("a", 1, 1, "", "# new\n")], "# new\na\n"),
    # the lower edit goes first; what it wrote is what the upper one finds
    "overlap.py": ("p\nq\nr\n", [("a", 1, 2, "p\nQ", "done"), ("b", 2, 2, "q", "Q")], "done\nr\n"),
    "forty.py": ("".join(f"n{k:02d}\n" for k in range(40)), [(f"{k:02d}", k + 1, k + 1, f"n{k:02d}", f"m{k}") for k in range(40)],
                 "".join(f"m{k}\n" for k in range(40))),
}


def test_patches(spark):
    approved = sample(spark, [
        {"id": i, "start_line": s, "end_line": e, "snippet": old, "proposed_snippet": new, "repo": "r", "ref": "m", "file_path": path}
        for path, (_, edits, _) in PATCHED.items() for i, s, e, old, new in edits])
    source = spark.createDataFrame(
        [("r", "m", path, "", 0, text) for path, (text, _, _) in PATCHED.items()] + [("r", "m", "none.py", "", 0, "x")],
        S.SOURCE_FILES)
    got = {r.path: r for r in patch.patched_files(approved, source).collect()}
    assert {p: r.content for p, r in got.items()} == {p: want for p, (_, _, want) in PATCHED.items()}
    assert {p: r.n_applied for p, r in got.items()} == {p: len(edits) for p, (_, edits, _) in PATCHED.items()}
    assert [p for p, r in got.items() if r.overlap] == ["overlap.py"]


def test_numbered(spark):
    paths = ["a.py", "src/b.py", "src/a/x.py", "src/a/y.py", "src/a/b/c/d.py", "src-old/z.py", "src/a/b/c/e.py", "z"]
    rows = spark.createDataFrame([(repo, p) for repo in "rs" for p in paths], "repo string, path string")
    for depth in (1, 2, 3, 9):
        got = {(r.repo, r.path): (r.position, r.total) for r in views.numbered(rows, ["repo"], depth=depth).collect()}
        want = sorted(paths, key=lambda p: p.split("/"))
        assert got == {(repo, p): (want.index(p) + 1, len(paths)) for repo in "rs" for p in paths}


def test_answers(spark):
    raws = ['{"is_real_issue": 0}', '{"is_real_issue": "0"}', '{"is_real_issue": null}', '{"is_real_issue": []}', "[1]", None,
            '{"confidence": "high"}', '{"confidence": "0.7"}', "nope"]
    rows = findings.parse_answers(
        spark.createDataFrame([(str(i), raw, None) for i, raw in enumerate(raws)], "finding_id string, raw string, error string")
    ).orderBy("finding_id").collect()
    assert [r.is_bad for r in rows] == [False, False, False, False, True, False, True, False, True]
    assert [r.is_real for r in rows if not r.is_bad] == [False, True, False, False, True, True]


def test_answers_once_and_empty_values(spark):
    candidate = spark.createDataFrame(
        [(i, "j", "r", "m", "a.py", "python", "py.time_sleep", "time.sleep", 1, 1, "snip", "hint") for i in ("1", "2", "3")],
        "id string, job_id string, repo string, ref string, file_path string, language string, rule_id string, title string, "
        "start_line int, end_line int, snippet string, hint string")
    answers = spark.createDataFrame(
        [("1", '{"title": "old"}', None, 1), ("1", '{"title": "new"}', None, 2), ("2", '{"title": 0, "confidence": []}', None, 1),
         ("3", '{"title": false, "reasoning": {}, "impact": [], "confidence": null}', None, 1)],
        "finding_id string, raw string, error string, seq int")
    got = {r.id: r for r in findings.reviewed_findings(candidate, answers).collect()}
    assert len(got) == 3 and got["1"].title == "new"
    assert (got["2"].title, got["2"].confidence) == ("time.sleep", S.REVIEW_CONFIDENCE)
    assert (got["3"].title, got["3"].reasoning, got["3"].impact) == ("time.sleep", "hint", S.REVIEW_IMPACT)


def test_decisions(spark):
    table = sample(spark, [{"id": "1", "status": "applied", "proposed_snippet": "p", "reviewer_notes": "n"}, {"id": "2", "status": "pending"}])
    decisions = spark.createDataFrame(
        [("1", 1, "approve", "a", "new"), ("1", 2, "reject", "", " \n"), ("2", 3, "later", "x", "y"), ("3", 4, "approve", "", "")],
        S.DECISIONS)
    rows = {r.id: r for r in state.apply_decisions(table, decisions).collect()}
    assert (rows["1"].status, rows["1"].reviewer_notes, rows["1"].proposed_snippet) == ("rejected", "", "new")
    assert rows["2"].status == "pending" and rows["2"].reviewer_notes is None
    assert {(r.finding_id, r.reason) for r in state.decision_rejects(table, decisions).collect()} == {
        ("2", "unknown action"), ("3", "unknown finding")}


def test_queue_shortens(spark):
    table = sample(spark, [{"id": str(n), "reasoning": "x" * n, "file_path": "a", "start_line": 1} for n in (180, 181)])
    got = {r.id: r.reasoning for r in views.queue_view(table).collect()}
    assert got == {"180": "x" * 180, "181": "x" * 180 + "…"}
