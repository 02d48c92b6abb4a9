"""Whole results of adjacent license copies and of groups whose columns come in several chunks."""

from types import SimpleNamespace

import pyarrow as pa
import pytest

from jobloom.llm import jaccard_join, licenses


def exact_copies(ws, template):
    """Brute force: windows of the template's length that equal it, from the left."""
    out, i = [], 0
    while i + len(template) <= len(ws):
        if ws[i : i + len(template)] == template:
            out.append((i, i + len(template)))
            i += len(template)
        else:
            i += 1
    return out


@pytest.mark.parametrize("copies", [1, 2, 3, 20])
def test_adjacent_licenses_are_all_found(copies):
    known = licenses.Templates(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        for between in (" ", " Copyright of some other author. "):
            whole = "Notices. " + between.join([text] * copies) + " End of the software."
            ws, spans = licenses.words(whole)
            want = [(spans[a][0], spans[b - 1][1]) for a, b in exact_copies(ws, licenses.words(text)[0])]
            got = [(s, e) for n, c, s, e in known.find(whole) if n == name and c == 1.0]
            assert len(want) == copies and got == want, (name, between)


def test_adjacent_changed_licenses_are_all_found():
    known, template = licenses.Templates(licenses.TEMPLATES), licenses.TEMPLATES["MIT"]
    changed = [template.rsplit(" ", 1)[0], template.replace("charge", "fee"), template.replace("sublicense, ", "")]
    got = [x for x in known.find(" ".join(changed * 4)) if x[0] == "MIT"]
    assert len(got) == 12 and all(0.95 < c < 1.01 for _, c, *_ in got)


def test_groups_of_several_chunks_keep_all_links(monkeypatch):
    """A column that Arrow leaves in chunks, as beyond 2 GiB, loses no nodes."""
    apart = SimpleNamespace(from_batches=lambda parts: SimpleNamespace(combine_chunks=lambda: SimpleNamespace(to_batches=lambda: parts)))
    monkeypatch.setattr(jaccard_join, "pa", SimpleNamespace(**{**vars(pa), "Table": apart}))
    text = " ".join(f"w{i}" for i in range(60))
    batches = [pa.RecordBatch.from_pydict({"grp": pa.array([5] * len(ns), pa.int64()), "node": pa.array(ns, pa.int64()), "copies": pa.array([1] * len(ns), pa.int64()), "half": pa.array([2] * len(ns), pa.int32()), "text": [text] * len(ns)}) for ns in ([9, 3], [7, 3], [1])]
    got = [r for b in jaccard_join._verify(iter(batches)) for r in b.to_pylist()]
    assert got == [{"node": n, "links": 3, "label": 1} for n in (1, 3, 7, 9)]
