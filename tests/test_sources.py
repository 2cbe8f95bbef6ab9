from __future__ import annotations

import csv
import json

import pytest

from runsieve.operators import anchor, enrich
from runsieve.plans import enrichment, workflow
from runsieve.sources import records, schemas, staging, tables

from .rows import metadata, run


def write(path, content: str, encoding: str = "utf-8") -> str:
    path.write_text(content, encoding=encoding, newline="")
    return str(path)


def read_csv(folder) -> list[list[str]]:
    lines = []
    for part in sorted(folder.glob("part-*.csv")):
        with open(part, newline="", encoding="utf-8") as handle:
            lines += list(csv.reader(handle))
    return lines


def test_sheet_with_byte_order_mark_quotes_and_line_breaks(spark, tmp_path):
    content = 'bioproject,note,n\r\nPRJ1,"a ""b"", c\nd",\r\nPRJ2,é,7\r\n'
    path = write(tmp_path / "sheet.csv", content, "utf-8-sig")
    sheet = tables.read_sheet(spark, path)
    assert sheet.columns == ["bioproject", "note", "n"]
    assert {tuple(r) for r in sheet.collect()} == {
        ("PRJ1", 'a "b", c\nd', ""),
        ("PRJ2", "é", "7"),
    }
    flat = write(tmp_path / "flat.csv", "bioproject,n\nPRJ1,07\n", "utf-8-sig")
    assert [tuple(r) for r in tables.read_sheet(spark, flat, multi_line=False).collect()] == [
        ("PRJ1", "07")
    ]


@pytest.mark.parametrize("multi_line", [True, False])
def test_sheet_errors(spark, tmp_path, multi_line):
    empty = write(tmp_path / "empty.csv", "bioproject,n\n")
    with pytest.raises(ValueError, match="is empty"):
        tables.read_sheet(spark, empty, multi_line)
    nothing = write(tmp_path / "nothing.csv", "")
    with pytest.raises(ValueError, match="is empty"):
        tables.read_sheet(spark, nothing, multi_line)
    other = write(tmp_path / "other.csv", "project,n\nPRJ1,1\n")
    with pytest.raises(ValueError, match="no 'bioproject' column"):
        tables.read_sheet(spark, other, multi_line)


def test_sheet_round_trip(spark, tmp_path):
    frame = spark.createDataFrame(
        [("b", ["x", "y"], 'q "1", 2'), ("a", [], None)],
        "bioproject string, terms array<string>, note string",
    )
    target = tmp_path / "out"
    tables.write_sheet(frame, str(target), order_by=["bioproject"])
    assert read_csv(target) == [
        ["bioproject", "terms", "note"],
        ["a", "[]", ""],
        ["b", "[x,y]", 'q "1", 2'],
    ]
    again = tables.read_sheet(spark, str(target))
    assert {tuple(r) for r in again.collect()} == {("a", "[]", ""), ("b", "[x,y]", 'q "1", 2')}


def test_intervals(spark, tmp_path):
    path = write(
        tmp_path / "sites.saf",
        "GeneID\tChr\tStart\tEnd\tStrand\ns1\tchr15\t25028445\t25028594\t+\n",
    )
    frame = tables.read_intervals(spark, path)
    assert frame.schema == schemas.INTERVALS
    assert [tuple(r) for r in frame.collect()] == [("s1", "chr15", 25028445, 25028594, "+")]


def test_study_tables_and_accession_list(spark, tmp_path):
    case = [("disease", "Alzheimer")]
    rows = [
        run(case, bioproject="PRJ1"),
        run([("group", "control")], bioproject="PRJ1", organism="Rattus norvegicus"),
        run(case, bioproject="PRJ1", consent="controlled"),
        run(bioproject="PRJ2"),
        run(case, bioproject="PRJ3", organism="Rattus norvegicus"),
        run(case, bioproject="PRJ4", consent="controlled"),
        run(case, bioproject=None),
    ]
    path = str(tmp_path / "metadata")
    metadata(spark, rows).write.parquet(path)
    source = tables.read_run_metadata(spark, path)
    for _ in range(2):  # replaced when run again
        anchors, runs = workflow.build_study_tables(source, "screening")
    assert {r.bioproject for r in anchors.collect()} == {"PRJ1", None}
    assert {r.acc for r in runs.collect()} == {rows[0]["acc"], rows[1]["acc"]}
    assert runs.columns == schemas.STUDY_RUNS.names
    assert tuple(anchor.stage_audit(anchors, runs).first()) == (1, 1, 2)
    tables.write_accession_list(runs, "PRJ1", str(tmp_path / "list"))
    assert {r.value for r in spark.read.text(str(tmp_path / "list")).collect()} == {
        rows[0]["acc"],
        rows[1]["acc"],
    }
    inspected = anchor.inspect_studies(runs, ["PRJ1"]).collect()
    assert [r.acc for r in inspected] == sorted([rows[0]["acc"], rows[1]["acc"]])
    assert inspected[0].gb == 1.0 and inspected[0].label_blob == "disease=alzheimer"


def document(*records_, uids=None):
    named = {uid: body for uid, body in records_}
    order = [uid for uid, _ in records_] if uids is None else uids
    return json.dumps({"header": {}, "result": {"uids": order, **named}})


def test_study_records(spark, tmp_path):
    folder = tmp_path / "records"
    folder.mkdir()
    write(
        folder / "a.json",
        document(
            ("1", {"project_acc": "PRJ1", "project_title": "old", "organism": {"x": [1]}}),
            ("2", {"project_acc": "", "project_title": "no accession"}),
            ("3", {"project_title": "no accession either"}),
            ("9", {"project_acc": "PRJ9", "project_title": "not listed"}),
            uids=["1", "2", "3", "absent"],
        ),
    )
    write(folder / "b.json", document(("4", {"project_acc": "PRJ1", "project_title": "new"})))
    write(folder / "c.json", '{"error": "nothing"}')
    write(folder / "d.json", "not json")
    found = records.read_study_records(spark, str(folder)).orderBy("seq").collect()
    assert [(r.project_acc, r.project_title) for r in found] == [
        ("PRJ1", "old"),
        ("PRJ1", "new"),
    ]
    lines = write(
        tmp_path / "records.jsonl",
        document(("1", {"project_acc": "PRJ1"})) + "\n" + document(("2", {"project_acc": "PRJ2"})),
    )
    by_line = records.read_study_records(spark, lines, one_per_line=True)
    assert [r.project_acc for r in by_line.orderBy("seq").collect()] == ["PRJ1", "PRJ2"]


def test_staging_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert staging.shared_folder(spark) == shared
    frame = spark.range(5).selectExpr("id", "CAST(NULL AS STRING) AS s")
    staged = staging.stage(frame, "numbers")
    assert f"{shared}/runsieve/numbers-" in staged.inputFiles()[0]
    assert staged.schema.names == ["id", "s"] and staged.count() == 5


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://somewhere:7077"
        applicationId = "x"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_folder(Session())


def test_sheet_keeps_blanks_and_order(spark, tmp_path):
    rows = [(f"PRJ{i % 7}", cell) for i, cell in enumerate([" x ", "\ty", 'q "a", b ', "line\nbreak", "", "z  "] * 20)]
    path = tmp_path / "in.csv"
    with open(path, "w", newline="", encoding="utf-8") as handle:
        csv.writer(handle).writerows([("bioproject", "note"), *rows])
    sheet = tables.read_sheet(spark, str(path), position="_at")
    mixed = sheet.repartition(4, "note")
    tables.write_sheet(mixed, str(tmp_path / "out"), position="_at")
    parts = read_csv(tmp_path / "out")
    assert [tuple(row) for row in parts if row != ["bioproject", "note"]] == rows


def test_equal_headings_are_an_error(spark, tmp_path):
    path = write(tmp_path / "twice.csv", "bioproject,a,a\nPRJ1,1,2\n")
    with pytest.raises(ValueError, match="equal headings: a"):
        tables.read_sheet(spark, path)


def test_tables_keep_a_study_in_few_files(spark, tmp_path):
    frame = spark.range(20_000).selectExpr("'PRJ' || (id % 100) AS bioproject", "'SRR' || id AS acc")
    sizes = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        # Partitions below this are joined, whatever the advisory size is.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k",
    }
    for name, size in sizes.items():
        spark.conf.set(name, size)
    try:
        stored = tables.write_table(
            frame.repartition(8), "clustered_runs", cluster_by=("bioproject",), sort_by=("acc",)
        )
        files = stored.selectExpr("bioproject", "_metadata.file_path AS f").distinct()
        assert files.select("f").distinct().count() > 1
        assert files.count() <= 2 * 100
    finally:
        for name in sizes:
            spark.conf.unset(name)
        spark.sql("DROP TABLE IF EXISTS clustered_runs")


def test_missing_columns_of_a_table_are_named(spark):
    spark.range(3).write.mode("overwrite").saveAsTable("narrow")
    with pytest.raises(ValueError, match="no column"):
        tables.from_table(spark, "narrow", schemas.STUDY_RUNS)
    spark.sql("DROP TABLE narrow")


def test_unreadable_documents_are_reported(spark):
    docs = spark.createDataFrame([(1, '{"result": {"uids": []}}'), (2, '{"result": {"uid'), (3, None)], "document_seq int, value string")
    assert [r.document_seq for r in records.unreadable_documents(docs, "value").collect()] == [2]


def test_staged_tables_can_be_dropped(spark):
    staged = staging.stage(spark.range(5), "gone")
    assert staged.count() == 5
    assert staging.drop_staged(spark) >= 1
    assert staging.drop_staged(spark) == 0


def test_enrichment_run_reports_what_it_could_not_find_or_read(spark, tmp_path):
    sheet = write(tmp_path / "sheet.csv", "note,bioproject\nc,PRJ3\na,PRJ1\nb, PRJ2\nz,PRJ9\n")
    folder = tmp_path / "records"
    folder.mkdir()
    write(folder / "a.json", document(("1", {"project_acc": "PRJ1", "project_title": "old"}), ("2", {"project_acc": "PRJ2", "project_title": " Amyloid\n"})))
    write(folder / "b.json", document(("1", {"project_acc": "PRJ1", "project_title": "small RNA"}), ("3", {"project_acc": "PRJ3"})))
    write(folder / "broken.json", document(("4", {"project_acc": "PRJ9"}))[:-9])
    write(folder / "twice.json", '{"result": {"uids": ["5"], "5": {"project_acc": "PRJ9", "project_acc": "PRJ9"}}}')
    found = enrichment.enrich_sheet(spark, sheet, str(folder), str(tmp_path / "out"))
    assert [r.bioproject for r in found.missing.collect()] == ["PRJ9"]
    assert sorted(r.file.rsplit("/", 1)[1] for r in found.unreadable.collect()) == ["broken.json", "twice.json"]
    rows = read_csv(tmp_path / "out")
    assert [row[:3] for row in rows[1:]] == [["c", "PRJ3", ""], ["a", "PRJ1", "small RNA"], ["b", " PRJ2", "Amyloid"], ["z", "PRJ9", ""]]
    assert [row[-2:] for row in rows[1:]] == [["False", "False"], ["False", "True"], ["True", "False"], ["False", "False"]]


def test_a_document_is_parsed_once_and_winners_are_found_without_texts(spark):
    """Texts are neither in an aggregate nor parsed a second time."""
    docs = spark.createDataFrame([(1, "{}")], "document_seq long, value string")
    parsed = records.parse_documents(docs, "value")
    text = records.records_of(parsed)._jdf.queryExecution().executedPlan().toString()
    assert text.count("parseJson") == 1 and "from_json" not in text
    raw = staging.stage(spark.createDataFrame([("PRJ1", "t", 1)], "project_acc string, project_title string, seq long").selectExpr(
        "*", *(f"'' AS {c}" for c in records.RAW_FIELDS if c not in ("project_acc", "project_title"))
    ), "raw")
    plan = enrich.normalise_records(raw)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "LeftSemi" in plan
    aggregates = [line for line in plan.splitlines() if "HashAggregate" in line]
    assert aggregates and not any("project_title" in line for line in aggregates)
