import re

import pytest

from packetloom.llm import license_scan as ls


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(lab, i) for p, lab in ls.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), sorted(places, key=lambda x: (x[1], x[0]))


@pytest.mark.parametrize("text", ["", "Released under the MIT License.", "cc by nc cc BY-NC", "é under the mit license CC_BY_NC Apache License, Version 2.0", "xunder the mit license", "ünder the mit license under the\nmit\tlicense", "cc by ncé"])
def test_base_places(text):
    n, places, _, _ = ls.scan_text(text.encode())
    assert (n, [(p["label"], p["word"]) for p in places if p["base"]]) == plain(text)


def test_expressions():
    value = lambda s: ls.evaluate(ls.parse_expression(s))
    assert value("MIT") == ({"mit"}, True)
    assert value("GPL-3.0 OR MIT AND ISC") == ({"gpl-3.0", "mit", "isc"}, True)
    assert value("(GPL-3.0 OR MIT) AND GPL-2.0") == ({"gpl-3.0", "mit", "gpl-2.0"}, False)
    assert value("GPL-2.0 WITH Classpath-exception-2.0 OR MIT") == ({"gpl-2.0", "mit"}, True)
    assert value("MIT */ more text") == ({"mit"}, True)
    for bad in ("", "AND MIT", "(MIT", "MIT OR", "()"):
        with pytest.raises(ValueError):
            ls.parse_expression(bad)


def test_tables(spark):
    rows = [(1, None), (2, "SPDX-License-Identifier: MIT OR GPL-3.0"), (3, "All rights reserved. " * 3), (3, "x " * 200_000 + "under the MIT license")]
    out = {(r.doc_id, r.n_words): r for r in ls.digest(ls.scan(spark.createDataFrame([(*x, "s", 1) for x in rows], "doc_id long, text string, score string, n_words int"))).collect()}
    assert out[1, 0].labels == "" and out[1, 0].score == 0 and out[1, 0].first_word is None
    assert out[2, 8].labels == "gpl-3.0,mit" and out[2, 8].score > 0.9
    assert out[3, 9].base_labels == "" and out[3, 9].labels == "all-rights-reserved"
    assert out[3, 200_004].n_base == 1 and out[3, 200_004].first_word == 200_000
    assert ls.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
