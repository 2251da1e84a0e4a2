import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from packetloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])

    def sums(d):
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and sums(digits(m))]
    return out + [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("ab@.-+ ()0123459é\n%"), max_size=60))
def test_base_equals_the_plain_patterns(text):
    assert pii.find(text) == plain(text)
    assert [x[:3] for x in pii.spans_of(text) if x[3]] == plain(text)


def found(text):
    return [(pii.KINDS[k], text[s:e], b) for k, s, e, b in pii.spans_of(text)]


def test_disguises_map_back_to_the_source():
    assert found("write to jo.doe [at] mail [dot] example (dot) org now") == [("email", "jo.doe [at] mail [dot] example (dot) org", False)]
    assert found("jo at mail dot example dot org") == [("email", "jo at mail dot example dot org", False)]
    assert found("call +four nine 30 one two three four five six.") == [("phone", "+four nine 30 one two three four five six", False)]
    assert found("аnna@ехample.org") == [("email", "аnna@ехample.org", False)]
    assert found("host １２７.0.0.1 up") == [("ip", "１２７.0.0.1", False)]
    card = "four one one one one one one one one one one one one one one one"
    assert found(f"pay {card}!") == [("card", card, False)]


def test_clean_text_and_long_text():
    assert found("meet at noon, one two three. The dot was red at dawn.") == []
    assert pii.spans_of("") == []
    assert pii.spans_of("1" * 300_000) == [] and pii.spans_of("a" * 300_000) == []
    assert pii.spans_of("@" * 300_000) == [] and pii.spans_of("+1" + " " * 300_000) == []
    assert found("x@y.z " * 20_000)[-1] == ("email", "x@y.z", True)


def test_redaction():
    assert pii.redact_text("a b@c.de 10.0.0.1 (f [at] g [dot] hi)") == "a [EMAIL] [IP] ([EMAIL])"


def test_tables(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "mail a@b.co", "x"), (3, "mail a@b.co", "x"), (None, "1.2.3.4", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = pii.digest(pii.scan(df)).collect()
    assert sorted((r.n_email, r.n_ip, r.spans) for r in out) == [(0, 0, ""), (0, 0, ""), (0, 1, "ip:0:7"), (1, 0, "email:5:11"), (1, 0, "email:5:11")]
    assert pii.scan(df.limit(0)).count() == 0
    assert sorted(r.text or "" for r in pii.redact(df).collect()) == ["", "", "[IP]", "mail [EMAIL]", "mail [EMAIL]"]


def test_hard_texts_take_time_in_proportion():
    hint = "jo [at] mail [dot] example (dot) org "
    for filler in (" ", "\t", "-", "a", "(", "[ ", "dot ", "1 ", "one ", "at ", "@", "+1", ". "):
        text = hint + filler * (1_000_000 // len(filler)) + hint
        start = time.process_time()
        spans = pii.spans_of(text)
        assert time.process_time() - start < 40, filler
        assert spans[0][:2] == (0, 0) and not spans[0][3]
    many = "mail a@b.co or jo [at] x [dot] org " * 20_000
    start = time.process_time()
    assert len(pii.spans_of(many)) == 40_000 and time.process_time() - start < 40


def test_blanks_around_brackets():
    for text in ("jo  [ at ]  x  ( dot )  org", "jo[at]x[dot]org", "jo [at][ ] x", "a [dot] [dot] b@c [dot] d", "x [dot] y dot z at q"):
        wide = pii.normalise(text).text
        assert " @" not in wide and "@ " not in wide and " ." not in wide.replace("[ ]", "")
    assert found("a@b [dot]  co") == [("email", "a@b [dot]  co", False)]
