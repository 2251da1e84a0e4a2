import random
import re
import time

from packetloom.llm import decontam as dc


def distance(item, text):
    """Fewest edits that turn the item into some stretch of the text."""
    row = [0] * (len(text) + 1)
    for j, c in enumerate(item):
        new = [j + 1]
        for i, t in enumerate(text):
            new.append(min(row[i] + (c != t), row[i + 1] + 1, new[i] + 1))
        row = new
    return min(row)


def flat(text):
    """The normal form by regular expressions, for texts whose capitals are lowered one for one."""
    low = re.sub("[\x00-\x20\xa0\u2000-\u200a\u3000]+", " ", text.lower())
    return re.sub(r"(.)\1{3,}", r"\1\1\1", low)


def edited(r, text, n):
    for _ in range(n):
        i, k = r.randrange(len(text)), r.randrange(3)
        text = text[:i] + (r.choice("abc ") if k else "") + text[i + (k != 2) :]
    return text


def test_nothing_within_the_budget_is_lost():
    r = random.Random(4)
    items = [(10 * i, "".join(r.choice("abcde ") for _ in range(r.choice([33, 60, 90, 140])))) for i in range(6)]
    tool = dc.index(items)
    docs = []
    for _ in range(60):
        pad = lambda: "".join(r.choice("abcde ") for _ in range(r.randrange(60)))
        _, t = r.choice(items)
        docs.append(pad() + edited(r, t, r.randrange(20)).upper().replace(" ", "\n") + pad())
    docs += ["", "a", items[0][1], items[0][1] + items[1][1] + items[0][1]]
    for d, hits in zip(docs, dc.search(docs, tool), strict=True):
        low = flat(d)
        for (i, t), k in zip(items, tool.budget, strict=True):
            t = flat(t).strip()
            mine = [h for h in hits if h[0] == i]
            best = distance(t, low)
            assert bool(mine) == (best <= k)
            if mine:
                assert min(h[3] for h in mine) == best
                assert all(distance(t, flat(d[h[1] : h[2]])) <= h[3] + dc.RUN for h in mine)
    assert len(dc.search(docs[-1:], tool)[0]) == 3


def test_windows_and_small_pieces_change_nothing(monkeypatch):
    r = random.Random(9)
    items = [(i, "".join(r.choice("abc -") for _ in range(r.choice([20, 40, 90])))) for i in range(8)] + [(8, "- " * 30), (9, "if x:\n" + " " * 60 + "return --- x ---")]
    docs = ["".join(r.choice("abc -") for _ in range(400)) + edited(r, r.choice(items)[1], 2) + "- " * r.randrange(200) + r.choice(items)[1] for _ in range(30)]
    tool = dc.index(items)
    want = dc.search(docs, tool)
    assert sum(map(len, want)) > 60
    for window, matches in ((64, 1 << 21), (1 << 15, 7), (100, 50)):
        monkeypatch.setattr(dc, "WINDOW", window)
        monkeypatch.setattr(dc, "MATCHES", matches)
        got = dc.search(docs, tool)
        # which of the places that overlap is the best may depend on the window; the items found do not
        assert [{x[0] for x in hits} for hits in got] == [{x[0] for x in hits} for hits in want]


def test_hard_texts_take_time_in_proportion():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = [(i, f"def {word()}({word()}):\n{' ' * 60}return {word()}\n{'-' * 40}\n{word()} = {word()} {'a' * 30}") for i in range(50)]
    tool = dc.index(items)
    for filler in (" ", "-", "a", "\n", "\t "):
        start = time.process_time()
        text = filler * (1_000_000 // len(filler)) + items[7][1] + filler * 1000
        hits = dc.search([text], tool)[0]
        assert [h[0] for h in hits] == [7] and time.process_time() - start < 20, filler


def test_tables(spark, monkeypatch):
    r = random.Random(5)
    items = [(i, " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(12))) for i in range(4)] + [(9, None), (8, "short"), (1, "")]
    rows = [(1, None), (2, ""), (3, "clean " * 50), (4, "x " * 30_000 + items[2][1] + " y" * 30_000), (4, items[0][1] + "\n" + items[3][1]), (None, items[1][1])]
    docs = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, hits string")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    for chunk in (1 << 20, 100):
        monkeypatch.setattr(dc, "CHUNK_CHARS", chunk)
        got = sorted((x.doc_id or -1, h.item_id, h.start, h.end, h.edits) for x in dc.find(docs, bench).collect() for h in x.hits)
        assert got == [(-1, 1, 0, 71, 0), (4, 0, 0, 71, 0), (4, 2, 60_000, 60_071, 0), (4, 3, 72, 143, 0)]
        assert sorted(x.doc_id for x in dc.clean(docs, bench).collect()) == [1, 2, 3]
    assert dc.find(docs, bench.limit(0)).count() == 0 and dc.clean(docs, bench.limit(0)).count() == 6
    assert dc.find(docs.limit(0), bench).count() == 0
