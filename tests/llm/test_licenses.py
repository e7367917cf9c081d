from factweave.llm import licenses

MIT = licenses.TEMPLATES["MIT"]


def test_blocks_are_named_and_differences_told(spark, docs_of):
    rows = [
        (1, "Some prose here.\nReleased under the MIT License.\nMore prose."), (2, f"MIT License\n\nCopyright (c) 2020 Ann\n\n{MIT}\n\ncode follows"),
        (3, "You need a license to drive a car, and copyright is a right."), (4, None), (5, ""), (6, "This work is licensed under the GNU General Public License, version 2."),
        (7, "This work is licensed under the GNU General Public License, version 3. All rights reserved."), (8, MIT.replace("furnished to do so", "furnished so") + " "), (8, "Licensed under CC BY 4.0."),
        (9, "x" * 300_000 + "\nLicensed under CC BY-NC 4.0."), (None, "ALL RIGHTS RESERVED."),
    ]
    found = licenses.license_blocks(docs_of(rows)).collect()
    got = {(r.doc_id, r.license): r for r in found}
    assert sorted(got, key=str) == sorted([(1, "MIT (named)"), (2, "MIT"), (6, "GPL-2.0 (named)"), (7, "GPL-3.0 (named)"), (7, "All rights reserved"), (8, "MIT"), (8, "CC-BY-4.0 (named)"), (9, "CC-BY-NC-4.0 (named)"), (None, "All rights reserved")], key=str)
    assert rows[0][1][got[1, "MIT (named)"].start : got[1, "MIT (named)"].end] == "Released under the MIT License."
    assert got[8, "MIT"].missing == ["to", "do"] and got[8, "MIT"].extra == []
    assert all(r.saved > 0 for r in found)
    assert licenses.license_blocks(docs_of([])).collect() == []


def test_the_template_itself_saves_most():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.9)
    for name, text in licenses.TEMPLATES.items():
        assert scanner.judge(text)["license"] == name


def test_numbers_and_marks_must_agree():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.9)
    assert scanner.judge("Licensed under the Apache License, Version 1.1.") is None
    assert scanner.judge("Licensed under CC BY-ND 4.0.") is None
