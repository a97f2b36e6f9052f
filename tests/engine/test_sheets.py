import io
import zipfile

from scrivel.sources import files


def xlsx(rows, shared):
    """rows: lists of (reference, kind, value)."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda r, t, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>' if t == "inlineStr" else f'<c r="{r}"' + (f' t="{t}"' if t else "") + f"><v>{v}</v></c>"
    body = "".join(f'<row r="{n}">' + "".join(cell(*c) for c in cells) + "</row>" for n, cells in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for s in shared) + "</sst>")
    return out.getvalue()


def test_dictionaries_of_spreadsheets(spark, tmp_path):
    fields = [(1, [("A1", "inlineStr", "id")]), (2, [("A2", "s", 0), ("C2", "inlineStr", "Name"), ("E2", "inlineStr", "y")]), (3, [("B3", "inlineStr", "String")]), (5, [("A5", "inlineStr", "gender"), ("B5", "inlineStr", "Picklist"), ("D5", "", "12.0")])]
    (tmp_path / "f.xlsx").write_bytes(xlsx(fields, ["fullName"]))
    got = [tuple(r) for r in files.field_definitions(spark, str(tmp_path / "f.xlsx")).orderBy("ordinal").collect()]
    assert got == [(0, "fullName", "String", "Name", None, True, "", ""), (1, "gender", "Picklist", "", "12", False, "", "")]
    lists = [(2, [("B2", "inlineStr", "no")]), (3, [("B3", "s", 0), ("D3", "", 7), ("F3", "inlineStr", "Nữ"), ("G3", "inlineStr", "Female"), ("I3", "", "101.0")]), (4, [("B4", "s", 0), ("H4", "inlineStr", "I"), ("I4", "", 0)]), (5, [("A5", "", 1)])]
    (tmp_path / "p.xlsx").write_bytes(xlsx(lists, ["gender"]))
    got = [tuple(r) for r in files.picklists(spark, str(tmp_path / "p.xlsx")).orderBy("ordinal").collect()]
    assert got == [("gender", 0, "7", "Nữ", "Female", "101", "A"), ("gender", 1, "", "", "", "", "I")]
