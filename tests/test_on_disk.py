"""Downloads that are whole on disk, from a real folder tree."""

import json

import pytest

from quarrylark.operators import files as L

KIND = "uid string, folder string"


def tree(root):
    """Folders by name with their notes and files."""
    made = {
        "whole": ({"status": "ok", "source": "pmc", "license": "CC", "fetched_on": "2024-01-02T03:04", "files": {"paper.pdf": {"url": "u"}}}, ["paper.pdf", "paper.md", "paper.txt", "paper.jats.xml"]),
        "no listed": ({"status": "ok", "files": {"paper.pdf": {"url": "u"}}}, ["paper.md", "paper.txt"]), "text only": ({"status": "ok"}, ["paper.md", "paper.txt"]), "md only": ({"status": "ok", "files": {}}, ["paper.md"]),
        "partial": ({"status": "partial"}, ["paper.md", "paper.txt"]), "pdf": ({"status": "ok"}, ["paper.pdf"]),
    }
    for name, (note, files) in made.items():
        (root / name).mkdir()
        (root / name / "metadata.json").write_text(json.dumps({"fulltext": note, "other": 1}))
        for f in files:
            (root / name / f).write_bytes(b"\0\1")
    (root / "broken").mkdir()
    (root / "broken" / "metadata.json").write_text("{")
    (root / "bare").mkdir()
    (root / "bare" / "paper.md").write_text("x")
    return [*made, "broken", "bare", "absent"]


@pytest.mark.parametrize(("formats", "want"), [({"pdf", "md", "txt", "xml"}, {"whole", "text only"}), ({"md"}, {"whole", "text only", "md only"}), ({"pdf"}, {"whole", "pdf"}), ({"xml"}, {"whole"}), ({"pdf", "xml"}, {"whole"})])
def test_from_disk(spark, tmp_path, formats, want):
    names = tree(tmp_path)
    notes, found = L.on_disk(spark, str(tmp_path))
    base = notes.first().folder.rsplit("/", 1)[0]
    folder = lambda n: f"{base}/{n}".replace(" ", "%20")
    seen = {r.folder.rsplit("/", 1)[1].replace("%20", " ") for r in notes.collect()}
    assert seen == {*names} - {"bare", "absent"}
    encoded = any("%20" in r.folder for r in notes.collect())
    wanted = spark.createDataFrame([(n, folder(n) if encoded else f"{base}/{n}") for n in names], KIND)
    got = {r.uid: r for r in L.from_disk(wanted, notes, found, "2024-06-01", formats).collect()}
    assert set(got) == want
    w = got["whole"]
    assert (w.source, w.license, w.pdf_url, w.checked_on, w.has_xml, w.has_pdf) == ("pmc", "CC", "u", "2024-01-02", True, True)
    assert "text only" not in got or got["text only"].checked_on == "2024-06-01" and not got["text only"].has_pdf
