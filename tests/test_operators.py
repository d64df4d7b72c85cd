"""Operators on small inputs: errors that must stop a query, ties, empty and null input, and plain models of the folds."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docquarry.functions import numbers, text, urls
from docquarry.operators import chunking, context, evidence, ingest, retrieval, sessions, tables
from docquarry.sources import files


def test_table_number_stops_on_text(spark):
    with pytest.raises(Exception, match="Non-numeric table value"):
        spark.createDataFrame([("abc",)], "v string").select(numbers.table_number(F.col("v"))).collect()


def test_exact_sum_and_its_errors(spark):
    cells = [("a", {"v": "0,10", "k": "X"}), ("b", {"v": "0,20", "k": "x"}), ("c", {"v": "1000,00", "k": "X"}), ("d", {"v": "oops", "k": "y"})]
    rows = spark.createDataFrame(cells, "chunk_id string, row_values map<string,string>")
    got = tables.aggregate_rows(rows, "sum", "v", {"k": "x"}, keep_ids=True).first()
    assert (str(got["result"]), got["scanned_rows"], got["matched_rows"], got["input_chunk_ids"]) == ("1000.30000000", 4, 3, ["a", "b", "c"])
    with pytest.raises(Exception, match="No structured table rows"):
        tables.aggregate_rows(retrieval.in_scope(rows, [], "chunk_id"), "count").collect()
    with pytest.raises(Exception, match="No matching rows"):
        tables.aggregate_rows(rows, "max", "v", {"k": "none"}).collect()
    with pytest.raises(Exception, match="Non-numeric"):
        tables.aggregate_rows(rows, "sum", "v").collect()
    assert tables.aggregate_rows(rows, "count", equals={"k": "none"}).first()["result"] == 0


def test_scope_comes_before_the_cut(spark):
    near = [("a1", "in", [1.0, 0.1]), ("a2", "in", [1.0, 0.0])] + [(f"z{i:03d}", "out", [1.0, 0.0]) for i in range(100)]
    vectors = spark.createDataFrame(near, "chunk_id string, document_id string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    assert [r["chunk_id"] for r in retrieval.dense_top_k(vectors, q, 2, ["in"]).orderBy("rank").collect()] == ["a2", "a1"]
    assert [r["chunk_id"] for r in retrieval.dense_top_k(vectors, q, 2).orderBy("rank").collect()] == ["a2", "z000"]
    assert retrieval.dense_top_k(vectors, q, 2, []).count() == 0


def test_fusion_counts_both_ranks(spark):
    rank = lambda rows: spark.createDataFrame(rows, "query_id int, chunk_id string, rank int")
    got = retrieval.fuse(rank([(1, "a", 1), (1, "a", 3), (1, "b", 2)]), rank([(1, "a", 2)])).where("chunk_id = 'a'").first()
    assert got["rrf_score"] == pytest.approx(1 / 61 + 1 / 62) and got["rank"] == 1


def test_rerank_refuses_bad_scores(spark):
    fused = spark.createDataFrame([(1, "a", float("nan"))], "query_id int, chunk_id string, s double")
    with pytest.raises(Exception, match="no finite score"):
        retrieval.rerank(fused, F.col("s")).collect()


def test_admission_passes_over_and_goes_on(spark):
    rows = [("q", i + 1, f"p{i}", "d", c) for i, c in enumerate([50, 80, 40])]
    df = spark.createDataFrame(rows, "query_id string, rank int, parent_id string, document_id string, cost int")
    assert [r["admitted"] for r in context.admit(df, budget=100).orderBy("rank").collect()] == [True, False, True]


def test_admission_against_a_plain_model(spark):
    draw = random.Random(5)
    rows = [(f"q{q}", r, f"p{draw.randint(0, 8)}", f"d{draw.randint(0, 2)}", draw.randint(0, 60)) for q in range(40) for r in range(1, 15)]
    df = spark.createDataFrame(rows, "query_id string, rank int, parent_id string, document_id string, cost int")
    got = {(r["query_id"], r["rank"]): (r["admitted"], r["used"], r["reason"]) for r in context.admit(df, budget=150, per_document=90).collect()}
    for q in range(40):
        used, per, known = 0, {}, set()
        for _, rank, parent, doc, cost in sorted(r for r in rows if r[0] == f"q{q}"):
            reason = None
            if parent in known:
                reason = "known"
            elif per.get(doc, 0) + cost > 90:
                reason = "document_token_budget"
            elif used + cost > 150:
                reason = "token_budget"
            else:
                used, known = used + cost, known | {parent}
                per[doc] = per.get(doc, 0) + cost
            assert got[f"q{q}", rank] == (reason is None, used, reason)


def test_next_fit_batches(spark):
    rows = [("q", i, f"p{i}", c) for i, c in enumerate([50, 60, 40, 200, 10])]
    df = spark.createDataFrame(rows, "query_id string, ord int, parent_id string, cost int")
    assert [r["batch"] for r in context.batches(df, budget=100).orderBy("ord").collect()] == [0, 1, 1, None, 2]


def test_claim_ids_must_differ(spark):
    claims = spark.createDataFrame([("q", "C1", ["E1"]), ("q", "C1", ["E1"])], "query_id string, claim_id string, evidence_ids array<string>")
    verdicts = spark.createDataFrame([("q", "C1", "SUPPORTED")], "query_id string, claim_id string, status string")
    with pytest.raises(Exception, match="claim id occurs twice"):
        evidence.claim_verdicts(claims, verdicts, spark.createDataFrame([("q", "E1")], "query_id string, evidence_id string")).collect()


def test_references_are_checked(spark):
    facts = spark.createDataFrame([(["E1", "E7"],)], "evidence_ids array<string>")
    with pytest.raises(ValueError):
        evidence.require_references(facts, spark.createDataFrame([("E1",)], "evidence_id string"))


def test_chunk_ids_depend_on_path_and_content(spark):
    rows = [("a/x.md", "/s/a/x.md", "a", 0, "# Title\none two three\n## Part\nfour"), ("b/x.md", "/s/b/x.md", "b", 1, "# Title\none two three\n## Part\nfour"), ("a/x.md", "/s/a/x.md", "c", 2, "later copy")]
    df = spark.createDataFrame(rows, "relative_path string, source string, collection_name string, collection_order int, text string")
    one = chunking.chunk_documents(df, parent_tokens=2, child_tokens=1).collect()
    two = chunking.chunk_documents(df, parent_tokens=2, child_tokens=1).collect()
    assert sorted(r["chunk_id"] for r in one) == sorted(r["chunk_id"] for r in two) and len({r["chunk_id"] for r in one}) == len(one)
    assert {r["document_name"] for r in one} == {"Title"} and len({r["document_id"] for r in one}) == 2
    for r in one:
        assert r["text"].split("\n")[-1] in r["parent_text"]
    assert sorted(r["chunk_order"] for r in one if r["relative_path"] == "a/x.md") == list(range(len(one) // 2))


def test_stale_sidecar_stops(spark):
    docs = spark.createDataFrame([("a.md", "text")], "relative_path string, text string")
    side = spark.createDataFrame([("a.md", "0" * 64, [("t", "b")])], "relative_path string, markdown_sha256 string, sections array<struct<title:string,text:string>>")
    with pytest.raises(Exception, match="stale structure sidecar"):
        files.with_sidecars(docs, side).collect()


def test_collections_overlap_and_missing_folders(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "01_a.md").write_text("# A\nx", encoding="utf-8")
    (tmp_path / "b.md").write_bytes("caf\xe9".encode("latin-1"))
    got = files.scan_collection(spark, str(tmp_path), ["__root__", "one"])
    assert {(r["relative_path"], r["collection_name"]) for r in files.inventory(got).collect()} == {("one/01_a.md", "one"), ("b.md", "__root__")}
    assert files.documents(got).where("relative_path = 'b.md'").first()["text"] == "café"
    assert [r["label"] for r in files.library(got).collect()] == ["b", "a"]
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        files.scan_collection(spark, str(tmp_path), ["empty"])


def test_question_sets(spark, tmp_path):
    good = tmp_path / "q.json"
    good.write_text('[{"id": " 1 ", "collection": "c", "question": "q", "expected_answer": "a", "accepted_answers": ["x", "x"]}]')
    assert files.load_questions(spark, str(good)).first()["accepted_answers"] == ["x"]
    for bad in ("[]", '[{"id": "1", "collection": "c", "question": " ", "expected_answer": "a"}]', '[{"id": "1", "collection": "c", "question": "q", "expected_answer": "a"}, {"id": "1 ", "collection": "c", "question": "q", "expected_answer": "a"}]'):
        path = tmp_path / "bad.json"
        path.write_text(bad)
        with pytest.raises(ValueError):
            files.load_questions(spark, str(path))


def test_csv_sheets(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("a;b;b\n\n1;2,5;x\n;;\n3;;y\n")
    got = tables.build_sheet(files.read_csv_sheet(spark, str(path))).orderBy("row_number").collect()
    assert [(r["row_number"], r["row_values"]) for r in got] == [(2, {"a": "1", "b": "2,5", "b_2": "x"}), (3, {"a": "3", "b_2": "y"})]


def test_index_is_rebuilt_when_unsound(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "p1", "t")], "chunk_id string, parent_id string, text string")
    index = spark.createDataFrame([("t", "c1", 1.0)], "token string, chunk_id string, weight double")
    files.save_index(chunks, index, str(tmp_path), "good")
    assert files.load_index(spark, str(tmp_path), "good")[0].count() == 1
    assert files.load_index(spark, str(tmp_path), "none") is None
    files.save_index(chunks.union(chunks), index, str(tmp_path), "twice")
    assert files.load_index(spark, str(tmp_path), "twice") is None
    files.save_index(chunks, index.withColumn("weight", F.lit(-1.0)), str(tmp_path), "minus")
    assert files.load_index(spark, str(tmp_path), "minus") is None


def test_fingerprint_ignores_order(spark):
    rows = [("a.md", "1"), ("b.md", "2")]
    make = lambda r: spark.createDataFrame(r, "relative_path string, sha256 string")
    assert files.fingerprint(make(rows), {"k": 1}) == files.fingerprint(make(rows[::-1]), {"k": 1})
    assert len({files.fingerprint(make(rows), {"k": 1}), files.fingerprint(make(rows), {"k": 2}), files.fingerprint(make(rows[:1]), {"k": 1})}) == 3


def test_numbers_skip_what_is_used(spark):
    wanted = spark.createDataFrame([("b",), ("a",), ("c",)], "name string")
    used = spark.createDataFrame([(1,), (3,), (900,)], "number long")
    assert {r["name"]: r["number"] for r in ingest.allocate_numbers(wanted, used, ["name"]).collect()} == {"a": 2, "b": 4, "c": 5}


def test_keep_first_leaves_rows_without_key(spark):
    df = spark.createDataFrame([("u", 2), ("u", 1), (None, 3), (None, 4)], "url string, ord int")
    assert sorted(r["ord"] for r in ingest.keep_first(df, "url", "ord").collect()) == [1, 3, 4]


def test_documents_are_deleted_by_safe_paths_only(spark):
    docs = spark.createDataFrame([("a.md",), ("b.md",)], "relative_path string")
    assert files.delete_documents(docs, ["a.md"]).count() == 1
    for path in ("../a.md", "/a.md", "a.txt"):
        with pytest.raises(ValueError):
            files.delete_documents(docs, [path])


def test_accents_against_the_decomposition(spark):
    import unicodedata

    chars = [chr(c) for low, high in ((0xA0, 0x250), (0x1E00, 0x1F00), (0xFB00, 0xFB07), (0xFF10, 0xFF5B)) for c in range(low, high)]
    rows = spark.createDataFrame([(i, f"x{c}y") for i, c in enumerate(chars)], "i int, t string")
    got = {r["i"]: r["n"] for r in rows.select("i", text.normalize_identifier(F.col("t")).alias("n")).collect()}

    def model(t: str) -> str:
        import re

        plain = "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))
        return re.sub(r"[^a-z0-9]+", " ", plain).strip()

    assert {i: model(f"x{c}y") for i, c in enumerate(chars)} == got


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert chunking.children(chunking.parents(chunking.prose(none))).count() == 0
    assert retrieval.postings(none, "doc_id").count() == 0
    assert none.select(urls.normalize_url(F.col("text"))).count() == 0


def test_follow_ups(spark):
    yes = ["e quais?", "mas quais sao", "ok", "e mas", "beleza mas os nomes", "certo as planilhas", "quais", "qual delas?", "os nomes", "entendi, os pdfs"]
    no = ["", "as planilhas", "quais arquivos", "e a outra", "mas mas mas", "ok quais sao elas", "nomes", "os pdfs"]
    df = spark.createDataFrame([(t,) for t in yes + no], "t string").select("t", sessions.is_follow_up(F.col("t")).alias("f"))
    assert sorted(r["t"] for r in df.collect() if r["f"]) == sorted(yes)


def test_entries_meet_needles_by_whole_words(spark):
    from docquarry.operators import reports as R

    entries = spark.createDataFrame([(1, ["premium", "plan"]), (2, ["plans", "mium"]), (3, ["other"]), (4, [""])], "entry int, words array<string>")
    needles = spark.createDataFrame([("a", ["mium", "plan"]), ("b", ["absent", "plan"]), ("c", ["the", "other"]), ("d", ["mi"])], "needle string, words array<string>")
    got = {(r["entry"], r["needle"]) for r in R.word_candidates(entries, needles).collect()}
    assert {(1, "a"), (2, "a")} <= got <= {(1, "a"), (2, "a"), (1, "b"), (2, "b"), (3, "c")}


def test_report_reads_results_once(spark):
    from docquarry.operators import reports as R

    rows = spark.range(3).select(F.col("id").cast("string").alias("id"), F.lit("no_failure").alias("failure"), F.lit("grounded").alias("grounding"), F.lit(0.5).alias("confidence"), F.lit(False).alias("abstained"), F.lit(1.0).alias("context_hit_rate"))
    got = R.report_lines(rows)
    assert "Range (" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == 8


def test_inventory_answers_are_written_by_all_tasks(spark):
    asked = spark.createDataFrame([(k, 1, "files") for k in range(40)], "conv_id int, turn int, resolved string")
    files_ = spark.createDataFrame([(f"n{k}", "pdf") for k in range(30)], "name string, kind string")
    got = sessions.inventory_answer(asked, files_)
    spread = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(r["count"] for r in spread) == 1200


def test_inventory_answers_take_little_disk(spark, tmp_path):
    asked = spark.range(400).select("id", F.lit(1).alias("turn"), F.lit("pdfs").alias("resolved")).withColumnRenamed("id", "conv_id")
    files_ = spark.range(9000).select(F.sha2(F.col("id").cast("string"), 512).alias("name"), F.lit("pdf").alias("kind"))
    sessions.inventory_answer(asked, files_).write.parquet(str(tmp_path / "answers"))
    assert spark.read.parquet(str(tmp_path / "answers")).groupBy("conv_id").agg(F.countDistinct("name").alias("n")).where("n = 9000").count() == 400
    assert sum(p.stat().st_size for p in (tmp_path / "answers").glob("*.parquet")) < 2 * 400 * 9000


def test_inventory_answers_keep_equal_rows(spark):
    asked = spark.createDataFrame([(1, 1, "pdfs"), (1, 1, "pdfs"), (2, None, "files"), (3, 1, "images"), (4, 1, None)], "conv_id int, turn int, resolved string")
    files_ = spark.createDataFrame([("a", "pdf"), ("a", "pdf"), (None, "pdf"), ("b", None)], "name string, kind string")
    got = Counter(tuple(r) for r in sessions.inventory_answer(asked, files_).collect())
    assert got == {(1, 1, "pdfs", 3, "a"): 4, (1, 1, "pdfs", 3, None): 2, (2, None, "files", 4, "a"): 2, (2, None, "files", 4, None): 1, (2, None, "files", 4, "b"): 1, (3, 1, "images", 0, None): 1}


def test_values_in_text_writes_its_text_once(spark, small):
    from docquarry.plans import sheets

    plan = sheets.values_in_text(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("date_format(") == 1


def test_evidence_numbers_of_digits_alone(spark):
    told = ["0", "00", "007", "12", "1234", "999999999999999999", "1000000000000000000", "12%", "1,5", "-3", "--4", "", "x", None, "12345678901234567890123456789"]
    got = [r["v"] for r in spark.createDataFrame([(k, t) for k, t in enumerate(told)], "k int, t string").select("k", numbers.evidence_number(F.col("t")).alias("v")).orderBy("k").collect()]
    assert got == ["0", "0", "7", "12", "1234", "999999999999999999", "1000000000000000000", "12", "1.5", "-3", "-4", None, None, None, None]


def test_spreadsheet_lines_are_cleaned_as_rows(spark):
    from docquarry.operators import spreadsheet

    told = "# f.xlsx\r\n\r\n  Document type:   Spreadsheet \n \t \n## Sheet: A\r\nSheet name: A\nRow records:\n-  Spreadsheet file f | Sheet A | Row 2: K=1\n"
    lines = spreadsheet.parse_lines(spark.createDataFrame([("d", told), ("e", " \n\n"), ("f", None)], "document_id string, text string"))
    assert "array_join" not in lines._jdf.queryExecution().optimizedPlan().toString()
    got = [tuple(r) for r in lines.orderBy("document", "line_no").collect()]
    assert got == [("d", 1, None, "summary", "Document type: Spreadsheet"), ("d", 3, "A", "sheet_summary", "Sheet name: A"), ("d", 5, "A", "row_record", "Spreadsheet file f | Sheet A | Row 2: K=1")]


def test_dense_search_gives_workers_small_batches(spark):
    vectors = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(5)], "chunk_id long, embedding array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    found = retrieval.dense_top_k(vectors, vectors.where("chunk_id < 2").withColumnRenamed("chunk_id", "query_id"), 2)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == f"{4 << 20}b" and found.count() == 4
