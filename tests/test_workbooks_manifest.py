import io
import os
import zipfile

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from checkviews import sheets
from rillwater.config import Roles
from rillwater.operators import cleaning
from rillwater.sources import manifest, sinks, workbooks


def put(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content)
    return path


def test_kinds_of_cells(spark, tmp_path):
    raw = {(1, 0): '<c t="inlineStr"><is><r><t>in </t></r><r><t>line</t></r><rPh><t>x</t></rPh></is></c>',
           (1, 1): '<c t="b"><v>1</v></c>', (1, 2): '<c t="e"><v>#N/A</v></c>',
           (2, 0): '<c t="str"><f>A1</f><v>made_x000A_up</v></c>', (2, 1): "<c><v>1.5E-3</v></c>", (2, 2): "<c/>"}
    rows = [["text", "", "text", "wide"], ["", "", "", "a\n\"b\" <&> ñ"], ["", "", "", " 36526 "], [None, None, None, 36526.25], []]
    put(str(tmp_path / "in" / "a.xlsx"), sheets.workbook(rows, raw=raw))
    df = workbooks.read_workbooks(spark, str(tmp_path / "in"))
    assert df.columns == ["workbook", "sheet_row", "text", "unnamed_1", "text.1", "wide"]
    assert {f.dataType.typeName() for f in df.schema.fields[2:]} == {"string"}
    got = [tuple(r)[1:] for r in df.orderBy("sheet_row").collect()]
    assert got == [(2, "in line", "TRUE", None, 'a\n"b" <&> ñ'), (3, "made\nup", "1.5E-3", None, " 36526 "),
                   (4, None, None, None, "36526.25"), (5, None, None, None, None)]


def test_files_of_other_order_and_empty_ones(spark, tmp_path):
    at = lambda name: str(tmp_path / "in" / name)
    put(at("a.xlsx"), sheets.workbook([["Station Code", "Date", "Y"], ["s1 ", 36526, "N/D"], ["S2", 36527, 2.5]]))
    put(at("b.xlsx"), sheets.workbook([["Y", "Station Code", "More"], [7, "S3", "x"]]))
    put(at("c.xlsx"), sheets.workbook([]))
    put(at("d.xlsx"), sheets.workbook([["Y", "Date"]]))
    put(at("e.xlsx"), b"")
    df = workbooks.read_workbooks(spark, str(tmp_path / "in"))
    assert df.columns[2:] == ["Station Code", "Date", "Y", "More"]
    clean = cleaning.clean_samples(df, Roles(target="y")).orderBy("station_code").collect()
    assert [(r["station_code"], r["date"] and r["date"].strftime("%Y-%m-%d"), r["y"], r["more"]) for r in clean] == [
        ("S1", "2000-01-01", None, None), ("S2", "2000-01-02", 2.5, None), ("S3", None, 7.0, "x")]
    one = workbooks.read_workbooks(spark, [at("b.xlsx"), at("c.xlsx")], names=["More", "Absent"])
    assert [tuple(r)[1:] for r in one.collect()] == [(2, "x", None)]
    nothing = workbooks.read_workbooks(spark, at("c.xlsx"))
    assert nothing.count() == 0 and nothing.columns == ["workbook", "sheet_row"]


def test_more_rows_than_a_batch_and_far_columns(spark, tmp_path):
    rows = [["id"] + [f"c{i}" for i in range(30)]] + [[n] + [None] * 29 + [f"t{n % 7}"] for n in range(2 * workbooks.BATCH_ROWS + 3)]
    path = put(str(tmp_path / "long.xlsx"), sheets.workbook(rows))
    df = workbooks.read_workbooks(spark, path)
    row = df.agg(F.count("*"), F.sum("id"), F.countDistinct("c29"), F.count("c3"), F.max("sheet_row")).first()
    n = 2 * workbooks.BATCH_ROWS + 3
    assert tuple(row) == (n, n * (n - 1) / 2, 7, 0, n + 1)


def book_of(data, strings="<sst/>"):
    """A workbook whose sheet and strings are the given XML."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(sheets.workbook([]))) as plain, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name in plain.namelist():
            text = {"xl/sharedStrings.xml": strings, "xl/worksheets/sheet2.xml": data}.get(name)
            book.writestr(name, plain.read(name) if text is None else text)
    return out.getvalue()


def parsed(content):
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings = [workbooks._text(s) for s in workbooks._elements(book, "xl/sharedStrings.xml", "si")]
        return list(workbooks._parsed_rows(book, "xl/worksheets/sheet2.xml", strings))


def test_a_look_at_the_header_leaves_the_other_strings_alone(monkeypatch):
    rows = [["a", "b"], *([f"text {n}", f"{n} and more"] for n in range(60000))]
    content, read = sheets.workbook(rows), []
    texts = workbooks._plain_strings
    monkeypatch.setattr(workbooks, "_plain_strings", lambda *a: (read.append(t) or t for t in texts(*a)))
    assert next(workbooks.sheet_rows(content, "data", "x", head=True)) == (1, ["a", "b"]) and read == ["a", "b"]
    got = list(workbooks.sheet_rows(content, "data", "x"))
    assert got == [(n + 1, row) for n, row in enumerate(rows)] == parsed(content)


def test_rows_written_otherwise_are_parsed(monkeypatch):
    row = lambda n, cells, more="": f'<row r="{n}"{more}>{cells}</row>'
    plain = "".join(row(n, f'<c r="A{n}" t="s"><v>{n % 3}</v></c><c r="AB{n}" s="2"><v>{n}.5</v></c><c r="B{n}" s="1"/>', ' spans="1:28"')
                    for n in range(1, 9001))
    strings = "<sst><si><t>a &lt;&amp;&quot; ]x_x000A_</t></si><si><t xml:space=\"preserve\"> ñ </t></si><si><t></t></si></sst>"
    odd = ("", row(9001, '<c r="A1" t="inlineStr"><is><t>in</t></is></c>'), row(9001, '<c r="A1"><f>B1</f><v>1</v></c>'), "<row><c><v>7</v></c></row>",
           row(9001, '<!-- c --><c r="A1"><v><![CDATA[8]]></v></c>'), row(9001, '<c t="str" r="A1"><v>&#65;</v></c>'), '<row r="9005"/>')
    parses, of = [], workbooks._parsed_rows
    monkeypatch.setattr(workbooks, "_parsed_rows", lambda *a: parses.append(1) or of(*a))
    for n, last in enumerate(odd):
        for around in ("<worksheet><sheetData>{}</sheetData></worksheet>", '<?xml version="1.0"?><x:worksheet xmlns:x="u"><x:sheetData/><sheetData>{}</sheetData></x:worksheet>',
                       "<worksheet><sheetData>{}</sheetData><rest><row><c><v>9</v></c></row></rest></worksheet>"):
            content = book_of(around.format(plain + last + row(9009, '<c r="A9"><v>3</v></c>')), strings)
            parses.clear()
            got = list(workbooks.sheet_rows(content, "data", "x"))
            assert bool(parses) == (n > 0 or "rest" in around)
            assert got == parsed(content) and len(got) == 9001 + bool(last) + ("rest" in around), last


def test_what_is_no_whole_xml_is_an_error():
    good = '<row r="1"><c r="A1"><v>a</v></c></row><row r="2"><c r="A2"><v>b</v></c></row>'
    for bad in (good.replace("b", "\x01"), good.replace("b", "]]>"), good.replace("b", "&no;"), good + "</worksheet>", good.replace('r="2"', 'r="2" s="1" s="1"'),
                good.replace('r="2"', 'r="2" r="1"'), good.replace("b", "\ufffe"), good.replace("b", "<i>"), good + "<row>"):
        with pytest.raises(ValueError, match="x is no whole workbook"):
            list(workbooks._batches("x", book_of(f"<worksheet><sheetData>{bad}</sheetData></worksheet>"), "data", ["a"]))


def test_what_is_no_workbook_is_an_error(spark, tmp_path):
    whole = sheets.workbook([["a"], [1]])
    for name, content, said in (("cut.xlsx", whole[: len(whole) // 2], "cut.xlsx is no whole workbook"),
                                ("other.xlsx", sheets.workbook([["a"]], sheet="else"), "has no sheet 'data'")):
        path = put(str(tmp_path / name), content)
        with pytest.raises(PythonException, match=said):
            workbooks.read_workbooks(spark, path, names=["a"]).collect()
    clash = put(str(tmp_path / "clash.xlsx"), sheets.workbook([["sheet_row"], [1]]))
    with pytest.raises(ValueError, match="sheet_row"):
        workbooks.read_workbooks(spark, clash)
    assert workbooks.read_workbooks(spark, put(str(tmp_path / "first.xlsx"), whole), sheet=None).count() == 0


def test_only_changed_files_are_scanned(spark, tmp_path):
    root, kept = str(tmp_path / "in put"), str(tmp_path / "manifest")
    rows = spark.range(1000).select("id", F.concat(F.lit("t"), F.col("id") % 7).alias("t"), F.lit(1).alias("path"))
    rows.repartition(10).write.parquet(root)
    read_of = []

    def read(session, paths):
        read_of.append(len(paths))
        return session.read.parquet(*paths)

    first = manifest.content_fingerprint(spark, root, kept, read=read)
    again = manifest.content_fingerprint(spark, root, kept, read=read)
    assert read_of == [10] and again == (first.digest, [], 10) and first.digest.startswith("1000-")
    # One of ten replaced: one scan, another digest. Put back under another name: the content of before.
    victim = sorted(f for f in os.listdir(root) if f.endswith(".parquet"))[3]
    where = os.path.join(root, victim)
    old = spark.read.parquet(where).toPandas()
    spark.createDataFrame(old.assign(id=old["id"] + 1), "id long, t string, path int").coalesce(1).write.parquet(str(tmp_path / "new"))
    spark.createDataFrame(old, "id long, t string, path int").coalesce(1).write.parquet(str(tmp_path / "old"))
    for source, same in (("new", False), ("old", True)):
        part = next(f for f in os.listdir(tmp_path / source) if f.endswith(".parquet"))
        os.remove(where)
        where = os.path.join(root, f"{source}.parquet")
        os.rename(tmp_path / source / part, where)
        now = manifest.content_fingerprint(spark, root, kept, read=read)
        assert read_of[-1] == 1 and [os.path.basename(p) for p in now.scanned] == [f"{source}.parquet"]
        assert (now.digest == first.digest) is same and now.n_files == 10
    os.remove(where)
    gone = manifest.content_fingerprint(spark, root, kept, read=read)
    assert gone.n_files == 9 and gone.scanned == [] and gone.digest != first.digest
    # A version that was cut off does not count.
    os.remove(os.path.join(kept, max(os.listdir(kept), key=int), "_SUCCESS"))
    assert manifest.content_fingerprint(spark, root, kept, read=read).digest == gone.digest


def test_no_files_and_equal_rows(spark, tmp_path):
    os.makedirs(tmp_path / "none")
    nothing = manifest.content_fingerprint(spark, str(tmp_path / "none"), str(tmp_path / "m0"))
    assert nothing == ("0-0-0", [], 0)
    digests = set()
    for i, files in enumerate((1, 3)):
        spark.createDataFrame([("a",)] * 5 + [(None,)], "t string").repartition(files).write.parquet(str(tmp_path / f"r{i}"))
        digests.add(manifest.content_fingerprint(spark, str(tmp_path / f"r{i}"), str(tmp_path / f"m{i + 1}")).digest)
    assert len(digests) == 1
    assert sinks.finished(spark, str(tmp_path / "m1" / "1"))
