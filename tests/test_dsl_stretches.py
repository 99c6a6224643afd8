"""Tasks of a large DSL file read their own stretch of it."""

from __future__ import annotations

import pytest

from lexarium.sources import formats, lexicon_source

CARD = "word {i}\nalias {i}\n\t[m1]body {i} é𝄞[/m]\n  more {i}\n"
ODD = CARD + "{{{{ note {i}\nlost {i}\n\tnot read\n}}}}\n#NOTE x\n\n\nplain{{{{x}}}} {i}\n\t[m2]one two {i}[/m]\n[b]{i}\n\tlast\n"


@pytest.mark.parametrize("codec", ["utf-16", "utf-8-sig"])
@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("card", [CARD, ODD])
def test_stretches_read_what_the_whole_does(tmp_path, monkeypatch, codec, strict, card):
    path = tmp_path / "d.dsl"
    path.write_bytes(('#NAME "d"\n\n' + "".join(card.format(i=i) for i in range(60))).encode(codec))
    whole = list(formats.Dsl(str(path), strict).entries(0, 1 << 62))
    for step in (50, 333, 1000):
        monkeypatch.setattr(lexicon_source, "TASK_BYTES", step)
        reader = lexicon_source.LexiconReader({"path": str(path), "strict": str(strict)}, "dsl")
        slices = reader.partitions()
        assert len(slices) > 3 and [s.window.byte for s in slices[1:]] == [s.window.stop for s in slices[:-1]]
        assert max(s.window.stop - s.window.byte for s in slices) <= step + 2 * len(card.format(i=60).encode("utf-16")) * 2
        rows = [r for s in slices for b in reader.read(s) for r in b.to_pylist()]
        assert [(r["ord"], r["key"], r["entry"]) for r in rows] == whole


def test_files_that_cannot_be_cut_are_read_whole(tmp_path):
    plain, open_, broken = tmp_path / "a.dsl", tmp_path / "b.dsl", tmp_path / "c.dsl"
    text = "".join(CARD.format(i=i) for i in range(60))
    plain.write_bytes(text.encode())
    open_.write_bytes(("{{ not closed\n" + text).encode("utf-16"))
    broken.write_bytes(b"\xef\xbb\xbfa\n\tb\xff\n" + text.encode())
    assert formats.Dsl(str(plain)).stretches(100) == [] == formats.Dsl(str(broken)).stretches(100)
    assert [(w.start, w.end) for w in formats.Dsl(str(open_)).stretches(100)] == [(0, formats.Dsl(str(open_)).rows())]
