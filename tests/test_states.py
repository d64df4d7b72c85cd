"""States with versions, and the import that commits by one."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docquarry import importing
from docquarry.sources import files, states

SCHEMA = "id string, n int"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_an_empty_state_replaces_the_old_one(spark, tmp_path):
    path = f"file:{tmp_path}/s"
    assert files.load_state(spark, path, SCHEMA).count() == 0
    assert files.save_state(spark.createDataFrame([("a", 1)], SCHEMA), path) == 1
    assert files.save_state(spark.createDataFrame([], SCHEMA), path) == 2
    assert files.load_state(spark, path, SCHEMA).count() == 0


def test_what_has_no_marker_is_not_read(spark, tmp_path):
    path = f"file:{tmp_path}/s"
    files.save_state(spark.createDataFrame([("a", 1)], SCHEMA), path)
    spark.createDataFrame([("b", 2)], SCHEMA).write.parquet(f"{path}/versions/000000000002-killed")
    (tmp_path / "s" / "commits" / "000000000002").write_bytes(b"")  # a writer that died between marker and content
    assert rows(files.load_state(spark, path, SCHEMA)) == [("a", 1)]


def test_of_two_writers_one_tries_again(spark, tmp_path):
    path = f"file:{tmp_path}/s"
    base = files.save_state(spark.createDataFrame([("a", 1)], SCHEMA), path)
    assert files.save_state(spark.createDataFrame([("b", 2)], SCHEMA), path, base) == 2
    with pytest.raises(states.Conflict):
        files.save_state(spark.createDataFrame([("c", 3)], SCHEMA), path, base)
    assert rows(files.load_state(spark, path, SCHEMA)) == [("b", 2)]
    seen = []

    def add(old):
        if not seen:  # another writer comes in between
            states.save(old.unionByName(spark.createDataFrame([("x", 9)], SCHEMA)), path)
        seen.append(1)
        return old.unionByName(spark.createDataFrame([("d", 4)], SCHEMA))

    assert states.change(spark, path, SCHEMA, add) == 4 and len(seen) == 2
    assert rows(files.load_state(spark, path, SCHEMA)) == [("b", 2), ("d", 4), ("x", 9)]


def test_sidecars_of_other_texts_stay(spark, tmp_path):
    path, form = f"file:{tmp_path}/side", "relative_path string, text string, sections array<string>"
    files.save_sidecars(spark.createDataFrame([("p1", "one", ["s"]), ("p2", "two", ["t"])], form), path)
    files.save_sidecars(spark.createDataFrame([("p1", "new", ["u"])], form), path)
    kept = lambda: {r["relative_path"]: r["sections"] for r in files.load_state(spark, path, "relative_path string, markdown_sha256 string, sections array<string>").collect()}
    assert kept() == {"p1": ["u"], "p2": ["t"]}
    files.save_sidecars(spark.createDataFrame([("p2", "two", [])], form), path)
    assert kept() == {"p1": ["u"]}


LISTING = "id string, name string, signature string, ord int"


def listing(spark, *data):
    return spark.createDataFrame([(i, n, s, k) for k, (i, n, s) in enumerate(data)], LISTING)


def extracted(text):
    return lambda df: df.select("id", F.when(F.col("name").contains("blank"), " ").otherwise(F.concat(F.lit(text), F.lit(" of "), "name")).alias("text"))


def never(df):
    return df.select("id", F.raise_error(F.lit("must not extract")).cast("string").alias("text"))


def kept(spark, folder):
    return {r["output_file"]: r["text"] for r in importing.documents(spark, folder).collect()}


def test_imports(spark, tmp_path):
    folder = f"file:{tmp_path}/c"
    one = importing.run_import(listing(spark, ("f1", "Ata.pdf", "s1"), ("f2", "Novo.pdf", "t1"), ("f3", "blank.pdf", "u1")), folder, extracted("text"), "plain")
    count = lambda x: {k: v for k, v in x.counters.first().asDict().items() if v}
    assert count(one) == {"checked": 3, "new": 3, "processed": 2}
    assert kept(spark, folder) == {"01_Ata.md": "# Ata.pdf\n\nExtraction method: plain\n\ntext of Ata.pdf\n", "02_Novo.md": "# Novo.pdf\n\nExtraction method: plain\n\ntext of Novo.pdf\n"}
    same = importing.run_import(listing(spark, ("f1", "Ata.pdf", "s1"), ("f2", "Novo.pdf", "t1")), folder, never, "plain")
    assert count(same) == {"checked": 2, "cached": 2} and {r["status"] for r in same.files.collect()} == {"cached"}
    changed = importing.run_import(listing(spark, ("f1", "Ata.pdf", "s2"), ("f2", "Novo.pdf", "t1"), ("f4", "Ata.pdf", "v1")), folder, extracted("again"), "plain")
    assert count(changed) == {"checked": 3, "cached": 1, "new": 1, "changed": 1, "processed": 2}
    assert kept(spark, folder)["01_Ata.md"].endswith("again of Ata.pdf\n") and sorted(kept(spark, folder)) == ["01_Ata.md", "02_Novo.md", "03_Ata.md"]
    gone = importing.run_import(listing(spark, ("f1", "Ata.pdf", "s2")), folder, never, "plain")
    assert count(gone) == {"checked": 1, "cached": 1, "deleted": 2} and sorted(kept(spark, folder)) == ["01_Ata.md"]
    empty = importing.run_import(spark.createDataFrame([], LISTING), folder, never, "plain")
    assert count(empty) == {"deleted": 1} and kept(spark, folder) == {}


def test_outputs_without_a_manifest_are_adopted(spark, tmp_path):
    folder = f"file:{tmp_path}/c"
    importing.adopt(spark.createDataFrame([("57_Ata.md", "# Ata.pdf\n\ncached")], "output_file string, text string"), folder)
    got = importing.run_import(listing(spark, ("f1", "Ata.pdf", "s1")), folder, never, "plain")
    assert [(r["status"], r["output_file"]) for r in got.files.collect()] == [("cached", "57_Ata.md")] and kept(spark, folder) == {"57_Ata.md": "# Ata.pdf\n\ncached"}


def test_a_killed_run_changes_nothing_and_is_repeated(spark, tmp_path, monkeypatch):
    folder = f"file:{tmp_path}/c"
    first = listing(spark, ("f1", "Ata.pdf", "s1"))
    importing.run_import(first, folder, extracted("old"), "plain")
    before = kept(spark, folder)
    second = listing(spark, ("f1", "Ata.pdf", "s2"), ("f2", "Novo.pdf", "t1"))
    with monkeypatch.context() as m:
        m.setattr(importing.states, "save", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            importing.run_import(second, folder, extracted("new"), "plain")
    assert kept(spark, folder) == before
    done = importing.run_import(second, folder, extracted("new"), "plain")
    assert done.version == 2 and kept(spark, folder)["01_Ata.md"].endswith("new of Ata.pdf\n") and len(kept(spark, folder)) == 2
    assert importing.run_import(second, folder, never, "plain").counters.first()["processed"] == 0
