import io
import re
import tracemalloc
import zipfile

import pytest
from hypothesis import given, settings, strategies
from pyspark.sql import functions as F

from noticeflow.operators import documents as docs
from noticeflow.operators.reports import kind_summary
from noticeflow.sources import landed

NS = 'xmlns:hp="urn:hancom"'


def archive(files: dict[str, str | bytes]) -> bytes:
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as out:
        for name, data in files.items():
            out.writestr(name, data)
    return raw.getvalue()


def p(text):
    return f"<hp:p><hp:run><hp:t>{text}</hp:t></hp:run></hp:p>"


def tc(text, attributes=""):
    return f"<hp:tc {attributes}>{p(text)}</hp:tc>"


def tr(*cells):
    return f"<hp:tr>{''.join(cells)}</hp:tr>"


def tbl(*rows):
    return f"<hp:tbl>{''.join(rows)}</hp:tbl>"


def section(*blocks):
    return f'<?xml version="1.0" encoding="UTF-8"?><hp:sec {NS}>{"".join(blocks)}</hp:sec>'


def document(*blocks) -> bytes:
    return archive({"Contents/section0.xml": section(*blocks)})


IDS = [f"ECR-{'PQXYZ'[i % 5] * 2}-{3 * i + 5:03d}" for i in range(31)]
SAMPLE = document(
    p(" ".join(IDS) + "◦ 점검" * 57),
    tbl(tr(tc("점검 주기", 'colSpan="2"')), tr(tc("발전기"), tc("30일"))),
)


@pytest.fixture
def convert(spark):
    def run(files: dict[str, bytes]):
        df = spark.createDataFrame(
            [("n1", f"/files/n1/{name}", name, content) for name, content in files.items()],
            "notice string, path string, name string, content binary",
        )
        manifest = docs.convert_documents(df).withColumn("markdown", docs.to_markdown("blocks"))
        return {(r["sequence"], r["original_name"]): r for r in manifest.collect()}

    return run


def test_sample_document(convert):
    made = convert({"01_a.hwpx": SAMPLE})["01", "01_a.hwpx"]
    assert made["kind"] == "hwpx" and made["reason"] is None
    assert sum(i in made["markdown"] for i in IDS) == 31
    assert made["stats"].asDict() == {"sections": 1, "tables": 1, "rows": 2, "cells": 3, "bullets": 57}
    assert "| 점검 주기 | 점검 주기 |\n| --- | --- |\n| 발전기 | 30일 |" in made["markdown"]
    assert made["markdown"].startswith("<!-- Contents/section0.xml -->\n\n" + IDS[0] + " ")
    assert made["markdown"].endswith("|\n")


@pytest.mark.parametrize(
    "rows, grid",
    [
        ([[(1, 2, "a"), (1, 1, "b")], [(1, 1, "c")]], [["a", "b"], ["a", "c"]]),
        ([[(2, 1, "a")], [(1, 1, "b")]], [["a", "a"], ["b", ""]]),
        ([[(1, 1, "a"), (1, 2, "b")], [(1, 1, "c"), (1, 1, "d")]], [["a", "b", ""], ["c", "b", "d"]]),
        ([[(1, 3, "a")]], [["a"], ["a"], ["a"]]),  # a span below the last row
        ([[], [(1, 1, "a")]], [[""], ["a"]]),
        ([], []),
        # a wide cell that starts left of a reserved column covers it
        ([[(1, 1, "a"), (1, 2, "b")], [(2, 1, "c")]], [["a", "b"], ["c", "c"]]),
    ],
)
def test_grid(rows, grid):
    assert written(docs.fill_grid(rows)) == grid


def written(rows):
    return [[text for columns, text in cells for _ in range(columns)] for times, cells in rows for _ in range(times)]


def plain_grid(rows):
    """The grid as a matrix, cell by cell."""
    grid = {}
    for y, row in enumerate(rows):
        x = 0
        for columns, lines, text in row:
            while (y, x) in grid:
                x += 1
            grid |= {(y + i, x + k): text for i in range(lines) for k in range(columns)}
            x += columns
    height = max([len(rows), *(y + 1 for y, _ in grid)])
    width = max((x + 1 for _, x in grid), default=0)
    return [[grid.get((y, x), "") for x in range(width)] for y in range(height)]


cells = strategies.tuples(strategies.integers(1, 4), strategies.integers(1, 4), strategies.sampled_from("abcdef"))


@given(strategies.lists(strategies.lists(cells, max_size=5), max_size=6))
@settings(max_examples=400, deadline=None)
def test_grid_by_spans_is_the_grid_by_cells(rows):
    assert written(docs.fill_grid(rows)) == plain_grid(rows)


def test_huge_spans_take_no_memory(convert):
    rows = [[(7100, 7100, "x"), (1, 1, "y")], [(2, 1, "z")]]
    tracemalloc.start()
    counted = sum(times * sum(columns for columns, _ in cells) for times, cells in docs.fill_grid(rows))
    assert counted == 7100 * 7102 and tracemalloc.get_traced_memory()[1] < 100_000
    tracemalloc.stop()
    made = convert({"01_a.hwpx": document(tbl(tr(tc("x", 'rowSpan="7100" colSpan="300"')), tr(tc("y"))))})["01", "01_a.hwpx"]
    assert [(r["times"], [tuple(c) for c in r["cells"]]) for r in made["blocks"][1]["rows"]] == [
        (1, [(300, "x"), (1, "")]), (1, [(300, "x"), (1, "y")]), (7098, [(300, "x"), (1, "")]),
    ]
    assert made["markdown"].count("| x ") == 7100 * 300


def test_broken_files_are_error_rows(convert):
    inner = document(p("fine"))
    corrupt = bytearray(archive({"a.hwpx": inner, "b.hwpx": document(p("more"))}))
    middle = len(corrupt) // 3
    corrupt[middle : middle + 40] = bytes(40)
    deep = "<hp:p>" * 5000 + "</hp:p>" * 5000
    made = convert(
        {
            "01_bad.zip": bytes(corrupt),
            "02_deep.hwpx": archive({"Contents/section0.xml": f"<hp:sec xmlns:hp='x'>{deep}</hp:sec>"}),
            "03_enc.hwpx": archive({"Contents/section0.xml": b"<?xml version='1.0' encoding='euc-kr-none'?><a/>"}),
            "04_ok.hwpx": inner,
        }
    )
    kinds = {name: row["kind"] for (_, name), row in made.items()}
    assert kinds["01_bad.zip"] == "error" and "a.hwpx" not in kinds  # nothing of a broken archive comes out
    assert kinds["03_enc.hwpx"] == "error" and kinds["04_ok.hwpx"] == "hwpx" and kinds["02_deep.hwpx"] in ("error", "hwpx")


def test_nested_tables_follow_their_block(convert):
    inner = tbl(tr(tc("in")))
    nested_cell = f"<hp:tc>{p('out')}<hp:p><hp:run>{inner}</hp:run></hp:p></hp:tc>"
    in_paragraph = f"<hp:p><hp:run><hp:t>before</hp:t>{inner}<hp:t>after</hp:t></hp:run></hp:p>"
    made = convert({"01_a.hwpx": document(tbl(tr(nested_cell)), in_paragraph)})["01", "01_a.hwpx"]
    def rows(block):
        return block["rows"] and written((r["times"], [tuple(c) for c in r["cells"]]) for r in block["rows"])

    assert [(b["kind"], b["text"], rows(b)) for b in made["blocks"]][1:] == [
        ("table", None, [["out"]]),
        ("table", None, [["in"]]),
        ("paragraph", "before after", None),
        ("table", None, [["in"]]),
    ]


def test_sections_in_numeric_order_and_entities(convert):
    content = archive(
        {
            "Contents/section10.xml": section(p("ten")),
            "Contents/section2.xml": section(p("&#xAC00;&#44032; &amp;lt; a<hp:t>b</hp:t>")),
            "Contents/header.xml": "<x/>",
        }
    )
    made = convert({"01_a.hwpx": content})["01", "01_a.hwpx"]
    assert made["markdown"] == (
        "<!-- Contents/section2.xml -->\n\n가가 &lt; a b\n\n<!-- Contents/section10.xml -->\n\nten\n"
    )


def test_archives_and_routes(convert):
    inner = archive({"deep.zip": archive({"x.hwpx": SAMPLE}), "b.PDF": b"%PDF"})
    files = {
        "01_a.zip": archive({"../evil.pdf": b"x", "d/c.hwpx": SAMPLE, "note.txt": b"x", "in.zip": inner}),
        "02_b.zip": archive({"readme.txt": b"x"}),
        "03_c.zip": b"no archive",
        "04_d.hwpx": b"no archive",
        "05_e.hwpx": document("<hp:p>"),
        "06_f.xlsx": b"x",
        "07_g": b"x",
        "08_h.pdf": b"%PDF",
        "09_i.hwp": b"x",
    }
    made = convert(files)
    kinds = {key: row["kind"] for key, row in made.items()}
    assert kinds == {
        ("011", "d/c.hwpx"): "hwpx",
        ("0121", "deep.zip"): "skipped",  # archives are opened two levels deep
        ("0122", "b.PDF"): "pdf",
        ("02", "02_b.zip"): "skipped",
        ("03", "03_c.zip"): "error",
        ("04", "04_d.hwpx"): "error",
        ("05", "05_e.hwpx"): "error",
        ("06", "06_f.xlsx"): "skipped",
        ("07", "07_g"): "skipped",
        ("08", "08_h.pdf"): "pdf",
        ("09", "09_i.hwp"): "skipped",
    }
    assert made["07", "07_g"]["reason"].endswith("없음")
    assert made["02", "02_b.zip"]["reason"] == docs.EMPTY_ARCHIVE


def test_archive_limits(monkeypatch):
    content = archive({f"{i}.pdf": b"x" * 10 for i in range(5)})
    monkeypatch.setattr(docs, "MAX_ENTRIES", 4)
    with pytest.raises(docs.DocumentError):
        list(docs.archive_entries(content))
    monkeypatch.setattr(docs, "MAX_ENTRIES", 5)
    monkeypatch.setattr(docs, "MAX_BYTES", 49)
    with pytest.raises(docs.DocumentError):
        list(docs.archive_entries(content))


def test_documents_from_folders(spark, tmp_path):
    for notice, name, content in [("n1", "01_a.hwpx", SAMPLE), ("n1", "02_b.pdf", b"%PDF"), ("n2", "01_c.txt", b"x")]:
        (tmp_path / notice).mkdir(exist_ok=True)
        (tmp_path / notice / name).write_bytes(content)
    files = landed.read_documents(spark, str(tmp_path))
    summary = kind_summary(docs.convert_documents(files), ["notice"]).orderBy("notice").collect()
    assert [tuple(r) for r in summary] == [("n1", 1, 1, 0), ("n2", 0, 0, 1)]
    assert landed.take_sorted(files, "notice", 1).select("notice").distinct().collect()[0][0] == "n1"
    opened = docs.expand_archives(files.where("notice = 'n1'"))
    assert sorted(r["name"] for r in opened.select("name").collect()) == ["01_a.hwpx", "02_b.pdf"]


def test_blocks_keep_order(spark):
    xml = section(p("one"), tbl(tr(tc("t"))), p("two"))
    df = spark.createDataFrame([(1, xml), (2, "<broken")], "id int, xml string")
    parsed = df.select("id", docs.section_blocks("xml").alias("s"))
    blocks = docs.document_blocks(parsed.select("id", "s.blocks"), ["id"]).orderBy("pos").collect()
    assert [(r["pos"], r["kind"], r["text"]) for r in blocks] == [
        (0, "paragraph", "one"), (1, "table", "| t |\n| --- |"), (2, "paragraph", "two"),
    ]
    assert parsed.where("id = 2").select("s.error").first()[0]


def test_html_blocks_hold_all_text(one):
    html = (
        "before<head><title>T</title><meta x></head><body>x<H1 class='a'>T&amp;</h1><p>a<p>b <b>c</b><script><p>no</p></script></p>"
        "<!-- <p>no --><div>in<ul><li>d<li>e</ul>out</div></section><table><tr><td>1<td>2</table>z<footer>foot</footer>"
    )
    found = one(docs.html_blocks(F.lit(html)))
    assert [(b["kind"], b["text"]) for b in found] == [
        ("text", "before"), ("title", "T"), ("body", "x"), ("h1", "T&"), ("p", "a"), ("p", "b c"), ("div", "in"), ("li", "d"), ("li", "e"),
        ("div", "out"), ("td", "1"), ("td", "2"), ("body", "z"), ("footer", "foot"),
    ]
    assert one(docs.html_blocks("html"), html=(None, "string")) == [] == one(docs.html_blocks(F.lit(" <p> </p>")))


@given(strategies.lists(strategies.sampled_from(["<p>", "</p>", "<div a='b'>", "</div>", "<li>", "</ul>", "<td>", "word", " ", "<b>", "<pre", ">"])))
@settings(max_examples=300, deadline=None)
def test_runs_of_a_page_leave_out_nothing_but_block_tags(pieces):
    page = "".join(pieces)
    assert "".join(text for _, text in docs.text_runs(page)) == re.sub(r"</?(p|div|li|ul|td|pre)( [^>]*)?>", "", page)
