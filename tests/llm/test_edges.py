"""Nulls, empty and long texts, repeated rows, empty tables and columns of clashing names, for every operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docquarry.llm import embedding_dedup, exact_dedup, filter_audit, lexical, mixing, packing, pii, quality, sentencepieces, simhash, substring_dedup, suffix_dedup, warc

LONG = " ".join(f"word{i % 7919}" for i in range(60_000))
ROWS = [(1, "one two three four"), (1, "one two three four"), (2, "ONE two three FOUR"), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, LONG), (None, "no identifier"), (8, "é" * 5000), (9, "spam " * 4000)]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.lit("s"))).withColumn("n_chars", F.length("text").cast("long"))
    for clash in ("doc", "digest", "kept", "fp", "tid", "body", "score", "block", "slot", "row", "member_id", "label", "value", "key", "a.b", "shard", "nid", "c0", "keep_id"):
        df = df.withColumn(clash, F.lit(clash))
    return df.persist()


OPERATORS = {
    "pii": pii.find_pii,
    "substring": substring_dedup.near_passages,
    "simhash": simhash.simhash_components,
    "exact": exact_dedup.exact_dedup,
    "mixing": mixing.mix_sources,
    "packing": lambda df: packing.pack(df, packing.default_vocabulary()),
    "suffix": suffix_dedup.remove_repeats,
    "quality": lambda df: quality.score(df, quality.fit(df, df.select("doc_id", F.lit(1).alias("quality")))),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(odd, name):
    got = OPERATORS[name](odd).collect()
    if name in ("pii", "simhash", "exact", "mixing", "suffix", "quality"):
        assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r["row"]["doc_id"] if name == "mixing" else r["doc"], []).append(r)
    if name == "pii":
        assert all(r["spans"] == [] for r in got)
    elif name == "substring":
        assert {(r["doc"], r["other"]) for r in got} == {(7, 6)} and all(r["similarity"] == 1.0 and r["stop"] == 60_000 for r in got)
    elif name == "simhash":
        assert {by[d][0]["component_id"] for d in (3, 4, 5)} == {3} and {r["component_id"] for r in by[1] + by[2]} == {1} and by[7][0]["component_id"] == 6 and by[None][0]["component_id"] is None
    elif name == "mixing":
        assert len({(r["slot"], r["place"]) for r in got}) == len(ROWS) and {r["source"] for r in got} == {None, "s"}
    elif name == "suffix":
        sizes = {d: (by[d][0]["n_bytes"], by[d][0]["n_removed"]) for d in (3, 4, 5, 6, 7, 8, 9, None)}
        assert sizes[3] == sizes[4] == (0, 0) and sizes[5] == (4, 0) and all(n == gone for n, gone in (sizes[6], sizes[7], sizes[8], sizes[9])) and sizes[None] == (13, 0)
    elif name == "quality":
        assert all(0 <= r["score"] <= 1 for r in got) and by[3][0]["score"] == by[4][0]["score"]
    elif name == "packing":
        assert [len(by[d]) for d in (1, 2, 3, 4, 5, None)] == [2, 1, 1, 1, 1, 1]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(odd, name):
    assert OPERATORS[name](odd.limit(0)).collect() == []


def test_embeddings_and_pages_without_rows(spark):
    assert embedding_dedup.embedding_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    folder = f"{suffix_dedup.materialize(spark.range(1), 'x').inputFiles()[0].rsplit('/', 1)[0]}-warc"
    manifest = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert manifest.count() == 0 and warc.read_archives(manifest, folder).count() == 0


def test_exact_repeats(odd):
    got = sorted((r["doc"] or -1, r["keep_id"] if r["keep_id"] is not None else -1, r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(odd, keep="largest").collect())
    assert got == [(-1, -1, 1, True), (1, 2, 3, False), (1, 2, 3, False), (2, 2, 3, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 7, 2, False), (7, 7, 2, True), (8, 8, 1, True), (9, 9, 1, True)]


def test_copies_go_and_columns_stay(odd):
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or -1 for r in kept.select("doc_id").collect()) == [-1, 2, 4, 5, 7, 8, 9]
    twice = odd.where("doc_id = 1")
    assert exact_dedup.drop_exact_copies(twice).count() == 1 and simhash.drop_near_copies(twice).count() == 1


def test_packing_of_odd_rows(odd):
    got = packing.pack(odd, packing.default_vocabulary()).collect()
    for d in (3, 4, 5):
        assert [(r["length"], r["start"]) for r in got if r["doc"] == d] == [(1, 0)]
    assert sum(r["doc"] == 1 for r in got) == 2


@pytest.mark.parametrize("name", ["quality", "exact", "near", "mix"])
def test_stages_keep_the_columns(spark, odd, small, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    for rows in (odd, odd.limit(0)):
        assert stage(spark, rows, small).columns == odd.columns
    assert stage(spark, odd.limit(0), small).count() == 0


def test_near_copies_are_judged_by_row(spark):
    one, two, three, four = (" ".join(f"{c}{k}" for k in range(60)) for c in "abcd")
    data = [(1, one), (1, two), (1, two), (2, one), (None, three), (None, four), (3, two)]
    kept = simhash.drop_near_copies(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, three), (0, four), (1, one), (1, two)]


def test_odd_pages(spark, tmp_path):
    big = "<p>" * 400
    rows = [(None, None, big), (None, "http://a/1", big), (1, None, None), (1, None, None), (1, "", ""), (2, "http://a b/\r\n", big), (2, "http://a b/\r\n", big), (3, "http://é/", "é")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for clash in ("page", "digest", "place", "kind", "shard", "first", "times", "payload", "a.b"):
        df = df.withColumn(clash, F.lit(clash))
    folder = f"file:{tmp_path}/warc"
    got = sorted((r["page"] or 0, r["type"], r["payload_bytes"], r["refers_to"] or 0) for r in warc.read_archives(warc.write_archives(df, folder), folder).collect())
    assert got == [(0, "revisit", 1200, 2)] * 2 + [(1, "response", 0, 0)] * 3 + [(2, "response", 1200, 0)] * 2 + [(3, "response", 2, 0)]


@pytest.mark.parametrize("ids", ["null", "equal"])
def test_no_group_holds_all_rows_of_an_identifier(spark, monkeypatch, ids):
    """Many rows without an identifier, or under one, in op6 and op9."""
    n = 3_000
    doc = F.lit(None).cast("long") if ids == "null" else F.lit(7).cast("long")
    df = spark.range(n).select(doc.alias("doc_id"), F.lit("s").alias("source"), F.lit("the same words").alias("text"))
    monkeypatch.setattr(mixing, "GROUP_ROWS", 100)
    monkeypatch.setattr(packing, "GROUP_ROWS", 100)
    seen = []
    keep = mixing._split_hot
    monkeypatch.setattr(mixing, "_split_hot", lambda dealt: seen.append(keep(dealt)) or seen[-1])
    got = mixing.mix_sources(df).select("slot", "place", "nth").collect()
    assert sorted(r["nth"] for r in got) == list(range(n)) and len({(r["slot"], r["place"]) for r in got}) == n
    sizes = [r["size"] for r in seen[0][1].collect()]
    assert sum(sizes) == n and max(sizes) <= 200
    packed = packing.pack(df, packing.default_vocabulary()).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == n
    tables = []
    write = packing.materialize
    monkeypatch.setattr(packing, "materialize", lambda d, label: tables.append(write(d, label)) or tables[-1])
    packing.pack(df, packing.default_vocabulary())
    groups = tables[0].groupBy("length", F.pmod(F.xxhash64("uid"), F.lit(n // 100))).count().collect()
    assert max(r["count"] for r in groups) <= 200


def test_search_of_odd_rows(odd):
    index = lexical.build_index(odd)
    assert index.documents == 8  # null, empty and blank texts have no term
    items = odd.select(F.col("doc_id").alias("item_id"), "text", "doc", "score", "`a.b`").withColumnRenamed("score", "term")
    got = [tuple(r) for r in lexical.search(index, items).collect()]
    best = {item: doc for item, rank, doc, _ in got if rank == 1}
    assert {k: v for k, v in best.items() if k in (6, 9, None)} == {6: 6, 9: 9, None: None} and best[1] == 1 and best[2] == 1 and not {3, 4, 5} & set(best)
    assert [(r, d) for i, r, d, _ in sorted(got, key=lambda r: r[1]) if i == 2] == [(1, 1), (2, 1), (3, 2)]  # letter case apart they are equal; the smaller identifier first
    dotted = odd.select(F.col("doc_id").alias("a.b"), "text")
    assert lexical.search(lexical.build_index(dotted, "a.b"), dotted, id_col="a.b").count() == len(got)


def test_audit_of_odd_rows(odd):
    labels = odd.select("doc_id", F.lit(1).alias("quality"), F.lit(None).cast("int").alias("toxic"))
    got = filter_audit.audit(filter_audit.flagged(odd, labels)).collect()
    assert len(got) == 600 and {r["part"] for r in got} == {"en"}
    first = next(r for r in got if r["filter_order"] == "EABCD" and r["step"] == 1)
    assert (first["kept"], first["removed"], first["good_lost"], first["toxic_lost"]) == (9, 2, 2, 0)  # 4 repeats 3, 7 repeats 6; rows of one identifier do not count against each other
    assert filter_audit.audit(filter_audit.flagged(odd.limit(0), labels)).collect() == [] and filter_audit.audit(filter_audit.flagged(odd, labels.limit(0))).count() == 600


def test_pieces_of_odd_rows(odd):
    model = sentencepieces.default_model()
    got = {}
    for r in sentencepieces.encode(odd, model, decoded=True).collect():
        got.setdefault(r["doc"], []).append(r)
    assert sum(map(len, got.values())) == len(ROWS) and all(r["decoded"] == (t or "") for d, t in ROWS for r in got[d])
    assert got[3][0]["ids"] == got[4][0]["ids"] and len(got[3][0]["ids"]) == 8
    assert sentencepieces.encode(odd.limit(0), model).collect() == []
    dotted = odd.select(F.col("doc_id").alias("a.b"), "text")
    assert sentencepieces.encode(dotted, model, "a.b").count() == len(ROWS)
