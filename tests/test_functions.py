from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from noticeflow.functions import cells, dates, ids, names, text


def lit(value):
    return F.lit(value)


def test_wide_whitespace(one):
    value = "\ufeff a\u00a0\u3000b\t\nc "
    assert one(text.squash_ws(lit(value))) == "abc"
    assert one(text.normalise_ws(lit(value))) == "a b c"
    assert one(text.strip_ws(lit(value))) == "a\u00a0\u3000b\t\nc"
    assert one(text.normalise_ws(F.lit(None).cast("string"))) == ""


def test_first_non_empty_keeps_blanks(one):
    assert one(text.non_empty(lit(""), F.lit(None).cast("string"), lit(" "), lit("x"))) == " "
    assert one(text.non_empty(lit(""))) == ""


@pytest.mark.parametrize(
    "written, read",
    [
        ("&#xAC00;&#44032;&amp;", "가가&"),
        ("&amp;lt;", "&lt;"),
        ("&#x26;#44032;", "가"),  # hexadecimal first, then decimal
        ("&#38;lt;", "<"),
        ("&#1114112;", "&#1114112;"),  # beyond the last character
        ("&#x1F600;", "\U0001f600"),
        ("&nbsp;", "&nbsp;"),
    ],
)
def test_entities(one, written, read):
    assert one(text.decode_entities(lit(written))) == read


def test_markup_text(one):
    markup = "<hp:t>a</hp:t><hp:t>b</hp:t> ◦one\n\t◦  two &lt;c&gt;"
    assert one(text.markup_text(lit(markup))) == "a b ◦ one ◦ two <c>"


def test_markdown_table(one):
    rows = F.array(F.array(lit("a|b"), lit("")), F.array(lit("x\ny"), lit("1")))
    assert one(text.markdown_table(rows)) == "| a\\|b |   |\n| --- | --- |\n| x<br>y | 1 |"
    assert one(text.markdown_table(F.array().cast("array<array<string>>"))) == ""


def test_join_text(one):
    values = F.array(lit("a"), lit(""), F.lit(None).cast("string"), lit("b"))
    assert one(text.join_text(values)) == "a, b"
    assert one(text.join_text(F.array().cast("array<string>"))) == "-"


@pytest.mark.parametrize(
    "written, day, digits, shown",
    [
        ("2026-07-01 10:00", "2026-07-01", "20260701", "2026-07-01"),
        ("2026.07.01", "2026-07-01", "20260701", "2026-07-01"),
        ("20260701 1030", "2026-07-01", "20260701", "2026-07-01"),
        ("July 2026", "undated", "2026", "-"),
        ("", "undated", "", "-"),
    ],
)
def test_dates(one, written, day, digits, shown):
    assert one(dates.record_day(lit(written))) == day
    assert one(dates.digits8(lit(written))) == digits
    assert one(dates.date_display(lit(written))) == shown


def test_date_arithmetic(one):
    begin, end = lit(date(2024, 2, 1)), lit(date(2024, 3, 1))
    assert one(dates.days_between(begin, end)) == 30
    assert one(dates.ymd(begin)) == "20240201"
    now = datetime(2024, 3, 1, 9, 5)
    assert one(dates.end_time(end, now)) == "0905"
    assert one(dates.end_time(begin, now)) == "2359"


def test_range_checks():
    dates.check_range(date(2024, 1, 1), date(2024, 1, 1), date(2024, 1, 1))
    for begin, end in [(None, date(2024, 1, 1)), (date(2024, 1, 2), date(2024, 1, 1)), (date(2024, 1, 1), date(2024, 1, 3))]:
        with pytest.raises(ValueError):
            dates.check_range(begin, end, date(2024, 1, 2))


@pytest.mark.parametrize(
    "url, name",
    [
        ("https://h/x.do?orgFileNm=b.pdf&fileNm=%EA%B0%80+1.hwp", "가 1.hwp"),
        ("https://h/x.do?orgFileNm=b.pdf", "b.pdf"),
        ("https://h/a/%EA%B0%80.hwp?x=1", "가.hwp"),
        ("https://h/a/b.hwp/", "b.hwp"),
        ("https://h/a+b.zip", "a+b.zip"),
        ("https://h/view.jsp?seq=7", "첨부파일 7"),
        ("https://h/view?fileSeq=3&seq=7", "첨부파일 3"),
        ("https://h/view", "첨부파일 5"),
        ("https://h/view.do?fileNm=%zz", "첨부파일 5"),
        ("https://h/%zz.hwp", "첨부파일 5"),
        ("no url", "첨부파일 5"),
        ("https://", "첨부파일 5"),
    ],
)
def test_guess_name(one, url, name):
    assert one(names.guess_name(lit(url), F.lit(4))) == name


@pytest.mark.parametrize(
    "name, safe",
    [
        ("a/b:c?.pdf", "b_c_.pdf"),
        ("...", "_"),
        ("", "spare"),
        (" a\x01 ", "a_"),
        ("x" * 200, "x" * 180),
        ("dir/", "dir"),
    ],
)
def test_safe_name(one, name, safe):
    assert one(names.safe_name(lit(name), "spare")) == safe


@pytest.mark.parametrize(
    "name, extension", [("a.HWP", ".hwp"), ("a.b.Zip", ".zip"), (".hwp", ""), ("a", ""), ("d.x/a", "")]
)
def test_file_extension(one, name, extension):
    assert one(names.file_extension(lit(name))) == extension


def test_url_guard(one):
    assert one(names.url_guard(lit("HTTPS:x"))) is True
    assert one(names.url_guard(lit("HTTPS:x"), strict=True)) is False
    assert one(names.url_guard(lit("ftp://x"))) is False


def test_ids(one):
    value = "요구ECR-001을 ECR-0012 ECR–HW-01, SER-7 ECR-001"
    assert one(ids.extract_ids(lit(value))) == ["ECR-001"]
    assert one(ids.extract_ids(lit(value), ids.PROMPT_ID)) == ["ECR-001", "ECR-0012", "ECR–HW-01"]
    assert one(ids.loose_ids(lit(value))) == ["ECR-001", "ECR-0012", "ECR-HW-01", "SER-7"]
    listed = F.array(lit(" ecr-1 "), lit("SER-1"), lit("ECR–2"), lit("ecr-1"))
    assert one(ids.id_filter(listed)) == ["ecr-1", "ECR–2"]


def test_excerpt_window(one):
    value = "ECR-1 first " + "a" * 300 + "ECR-1" + "b" * 2000
    window = one(ids.excerpt_window(lit(value), lit("ECR-1")))
    assert window == "a" * 220 + "ECR-1" + "b" * 1345
    assert one(ids.excerpt_window(lit("x ECR-1"), lit("ECR-1"))) == "x ECR-1"
    assert one(ids.excerpt_window(lit("x"), lit("ECR-1"))) == "[ECR-1 원문을 찾지 못함]"


@pytest.mark.parametrize("value", ["", "a", '"', '=x', '="y"', "a,b\nc", "000"])
def test_cells(one, value):
    assert one(cells.untext_cell(cells.text_cell(lit(value)))) == value


def test_older_cells(one):
    assert one(cells.untext_cell(lit("=00123"))) == "00123"
    assert one(cells.untext_cell(lit('="'))) == '"'
    assert one(cells.csv_escape(lit('a"b'))) == '"a""b"'
    assert one(cells.csv_escape(lit("plain"))) == "plain"
