import random
import re

from packetloom.llm import decontam as dc
from tests.llm.test_decontam import distance, edited, flat


def plain(item, text):
    """Places of a short item as a whole word."""
    left = r"(?<![^\W_])" if item[0].isalnum() else ""
    right = r"(?![^\W_])" if item[-1].isalnum() else ""
    return [m.span() for m in re.finditer(left + re.escape(item) + right, text)]


def test_items_of_all_lengths():
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abcd -") for _ in range(n))
    items = [(i, t) for i in range(120) if (t := word(1 + i % 40)).strip()]
    tool = dc.index(items)
    docs = [word(r.randrange(80)) + edited(r, r.choice(items)[1] + " ", r.randrange(3)) + word(r.randrange(80)) for _ in range(150)] + ["", "a", "ab"]
    for d, hits in zip(docs, dc.search(docs, tool), strict=True):
        low = flat(d)
        for i, t in items:
            mine, t = [x for x in hits if x[0] == i], flat(t).strip()
            if len(t) < 8:
                assert len(mine) == len(plain(t, low)) and all(flat(d[s:e]).endswith(t) for _, s, e, _ in mine)
            else:
                k = min(len(t) // 10, len(t) // 8 - 1)
                assert bool(mine) == (distance(t, low) <= k)


def test_scripts_and_blanks():
    tool = dc.index([(1, "你好"), (2, "Été"), (3, "  \n"), (4, ""), (5, " " * 40), (6, "x\x00y"), (7, "ÉTÉ")])
    assert dc.search(["说你好吗", "en été.", "l'étéx", " " * 90, "X Y", None or ""], tool) == [[(1, 1, 3, 0)], [(2, 3, 6, 0), (7, 3, 6, 0)], [], [], [(6, 0, 3, 0)], []]


def test_short_items_of_a_table(spark):
    docs = spark.createDataFrame([(1, "Q: Who wrote Emma?\nA: Austen"), (2, "who rote emma"), (3, "is it 42 or so"), (4, "it is 420")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "who wrote emma?"), (2, "42"), (3, " ")], "item_id long, text string")
    got = sorted((x.doc_id, *h) for x in dc.find(docs, bench).collect() for h in x.hits)
    assert got == [(1, 1, 3, 18, 0), (3, 2, 6, 8, 0)]
    assert sorted(x.doc_id for x in dc.clean(docs, bench).collect()) == [2, 4]
