"""A mixed collection through one builder, and what a second load encodes."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docquarry import answer
from docquarry.boundary import HashEncoder
from docquarry.operators import building
from docquarry.sources import files

SHEET = """# people.xlsx
Document type: Spreadsheet
Spreadsheet file: people.xlsx

## Sheet: Staff
Sheet name: Staff
Column profiles:
- Name: text
Row records:
- Spreadsheet file people.xlsx | Sheet Staff | Row 2: Name=Ana Souza | City=Fortaleza and a long remark that would be cut if records were not whole
- Spreadsheet file people.xlsx | Sheet Staff | Row 3: Name=Rui Lima | City=Natal"""
HEADED = "before all\n# Title\none two three four five\n## Empty\n\n## Next\nsix"
TOLD = "# Other\nthis text is not what the sidecar says"


def plain(texts, sections, parent, child):
    """(path, title, parent words, child words) of texts that are no spreadsheets, step by step."""
    out = []
    for path, text in texts.items():
        if path in sections:
            parts = [(t, b) for t, b in sections[path]]
        else:
            parts, title, body = [], "", []
            for line in [*text.split("\n"), None]:
                if line is None or line.startswith("#"):
                    if " ".join(body).strip():
                        parts.append((title, " ".join(body)))
                    title, body = (line or "").lstrip("#").strip(), []
                else:
                    body.append(line)
        for title, body in parts:
            words = body.split()
            for p in range(0, len(words), parent):
                for c in range(p, min(p + parent, len(words)), child):
                    out.append((path, title, " ".join(words[p : p + parent]), " ".join(words[c : min(c + child, p + parent)])))
    return sorted(out)


def test_mixed_collection(spark):
    told = [("First", "alpha beta gamma delta"), ("Second", "epsilon")]
    rows = [("h.md", "s/h.md", 0, HEADED, None), ("t.md", "s/t.md", 0, TOLD, told), ("x.md", "s/x.md", 1, SHEET, told), ("h.md", "again", 2, "# not this one\nat all", None), ("e.md", "s/e.md", 0, " \n", [])]
    df = spark.createDataFrame([(p, s, o, t, None if x is None else [(a, b, json.dumps([{"page_no": 1}])) for a, b in x]) for p, s, o, t, x in rows], "relative_path string, source string, collection_order int, text string, sections array<struct<title: string, text: string, provenance: string>>")
    got = building.build_chunks(df, 3, 2).collect()
    body = lambda title, text: text[len(title) + 1 :] if title else text
    prose = sorted((r["relative_path"], r["title"], " ".join(body(r["title"], r["parent_text"]).split()), " ".join(body(r["title"], r["text"]).split())) for r in got if r["relative_path"] != "x.md")
    assert prose == plain({"h.md": HEADED, "t.md": TOLD}, {"t.md": told}, 3, 2)
    assert {r["provenance"] for r in got if r["relative_path"] == "t.md"} == {'[{"page_no": 1}]'} and {r["source"] for r in got if r["relative_path"] == "h.md"} == {"s/h.md"}
    records = [r for r in got if r["chunk_kind"] == "row_record"]
    assert len(records) == 2 and all(r["row_values"] and r["text"].count("Row") == 1 for r in records) and any("records were not whole" in r["text"] for r in records)
    assert {r["entity_name"] for r in records} == {"Ana Souza", "Rui Lima"} and {r["title"] for r in records} == {"Staff"}
    for path in ("h.md", "t.md", "x.md"):
        assert sorted(r["chunk_order"] for r in got if r["relative_path"] == path) == list(range(sum(r["relative_path"] == path for r in got)))
    assert len({r["chunk_id"] for r in got}) == len(got)
    listed = {r["relative_path"]: r["document_name"] for r in building.catalog(df).collect()}
    assert listed == {"h.md": "Title", "t.md": "Other", "x.md": "people.xlsx", "e.md": "e.md"}


def test_only_what_is_new_is_encoded(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    class Counting:
        identity = "counting-1"

        def encode(self, texts):
            calls.add(len(texts))
            return HashEncoder().encode(texts)

    root, folder = tmp_path / "collections", f"file:{tmp_path}/index"
    for k in range(6):
        (root / ("a" if k < 4 else "b")).mkdir(parents=True, exist_ok=True)
        (root / ("a" if k < 4 else "b") / f"{k}.md").write_text(f"# Doc {k}\ntext number {k}\n# More\nof {k}")
    load = lambda *names, **more: answer.load_collection(spark, f"file:{root}", names, Counting(), folder, **more)
    first = load("a", "b")
    assert calls.value == 12 and first.chunks.count() == 12 and first.documents.count() == 6
    load("a", "b")
    assert calls.value == 12
    assert load("a").chunks.count() == 8 and calls.value == 12  # another subset
    (root / "a" / "2.md").write_text("# Doc 2\nchanged\n# More\nof 2")
    assert load("a", "b").chunks.count() == 12 and calls.value == 13  # one section of one file
    sides = spark.createDataFrame([("b/5.md", "# Doc 5\ntext number 5\n# More\nof 5", [("s", "told", None)])], "relative_path string, text string, sections array<struct<title: string, text: string, provenance: string>>")
    files.save_sidecars(sides, f"{folder}/sides")
    kept = files.load_state(spark, f"{folder}/sides", "relative_path string, markdown_sha256 string, sections array<struct<title: string, text: string, provenance: string>>")
    assert load("b", sidecars=kept).chunks.where(F.col("text") == "s\ntold").count() == 1 and calls.value == 14
    (root / "c").mkdir()
    (root / "c" / "x.md").write_text(" ")
    with pytest.raises(ValueError, match="no text"):
        load("c")
