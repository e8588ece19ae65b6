import random

import numpy as np

from shelfspark.llm.common import word_hashes
from shelfspark.llm.license_texts import TEMPLATES
from shelfspark.llm.licenses import TemplateBands, band_count, scan, scan_licenses, shingles, sliding_min, words_of

from odd_rows import ODD_ROWS


def filler(rng, n):
    return [f"w{rng.randrange(10**5)}" for _ in range(n)]


def plain(text, containment):
    """Templates whose shingles stand in some stretch of the text as long as the template and its slack."""
    words = words_of(text.encode())
    marks = shingles(word_hashes(words)).tolist() if len(words) >= 3 else []
    out = set()
    for name, template in TEMPLATES.items():
        hashes = word_hashes(words_of(template.encode()))
        own = set(shingles(hashes).tolist())
        length = len(hashes)
        for start in range(-length, len(words)):
            near = set(marks[max(0, start) : max(0, start + length)])
            if len(own & near) >= containment * len(own):
                out.add(name)
    return out


def test_sliding_min():
    values = np.random.default_rng(1).integers(0, 100, 50)
    for width in range(1, 20):
        assert sliding_min(values, width).tolist() == [values[i : i + width].min() for i in range(51 - width)]


def test_bands_keep_their_promise():
    assert band_count(0.5, 1, 0.999) == 10 and (1 - 0.5**1) ** 10 <= 0.001


def test_planted_templates():
    rng = random.Random(2)
    bands = TemplateBands(TEMPLATES, 0.5, 1, 0.999)
    for name, template in TEMPLATES.items():
        for share in (0.0, 0.03):
            words = [w if rng.random() >= share else "changed" for w in template.split()]
            text = " ".join(filler(rng, rng.randrange(300)) + words + filler(rng, 50)).upper()
            found = {bands.names[m[0]] for m in scan(text.encode(), bands, 0.75)}
            assert found >= plain(text, 0.75) and (share or name in found), name
    assert scan(" ".join(filler(rng, 5000)).encode(), bands, 0.75) == []


def test_places(spark, make):
    line = TEMPLATES["mit-line"]
    rows = [(1, f"start {line}\nmiddle middle middle {line} end", "s"), (2, line, "s"), (3, "Released under no license at all", "s")]
    got = sorted((r.doc_id, r.license, r.start_word, r.end_word) for r in scan_licenses(make(rows)).collect())
    assert got == [(1, "mit-line", 1, 6), (1, "mit-line", 9, 14), (2, "mit-line", 0, 5)]
    split = scan_licenses(make(rows), most_templates=3)
    assert sorted((r.doc_id, r.license, r.start_word, r.end_word) for r in split.collect()) == got


def test_odd_rows(spark, make):
    assert scan_licenses(make(ODD_ROWS)).count() == 0
    assert scan_licenses(make(ODD_ROWS), {"two": "one two"}).count() == 0
    assert {str(r.doc_id) for r in scan_licenses(make(ODD_ROWS), {"t": "two three four"}).collect()} == {"9", "10", "None"}
    assert scan_licenses(make(ODD_ROWS).limit(0)).count() == 0


def test_texts_shorter_than_the_window():
    """A short text that is a notice without its first or last words is compared whole."""
    bands = TemplateBands(TEMPLATES, 0.5, 1, 0.999)
    short = set()
    for name, template in TEMPLATES.items():
        words = template.split()
        for cut in range(1, 9):
            for text in (" ".join(words[cut:]), " ".join(words[:-cut])):
                if len(text.split()) < min(32, len(words)) and name in plain(text, 0.75):
                    assert name in {bands.names[m[0]] for m in scan(text.encode(), bands, 0.75)}, (name, cut)
                    short.add(name)
    assert {"isc", "mpl-2.0"} <= short
    assert scan(b"", bands, 0.75) == [] and scan(b"permission to use", bands, 0.75) == []
