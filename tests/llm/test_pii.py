import random
import re
import time
from hashlib import sha256

from atomsift.llm import pii

TEXT = (
    "write john.doe [at] mail (dot) example.com or jane at example dot org; ip 10.0.0.256 10.0.0.25 8.8.8.8.8; "
    "card 4111 1111 1111 1111 and four one one one one one one one one one one one one one one one; "
    "+49 (30) 1234567 adm\u0456n@ex\u0430mple.com 5\uff1500-0000-0000-0004; 192 dot 168 dot 0 dot 12"
)


def brute(text):
    """The plain patterns with a regex engine over the whole text."""
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [(k, *m.span()) for k, p, ok in rules for m in re.finditer(p, text) if ok(m[0])]


def test_plain_equals_whole_text_patterns():
    import random

    rnd = random.Random(4)
    parts = ["a@b.c", "x..y%@q-.z-1", "@", "@@", "1.2.3.4", "001.2.3.400", "4111111111111111", "4111-1111 1111 1111", " ",
             "+1 (234) 567-89", "+", "-", "9", "é", "5.5", "a", "a@b@c.d.e", "."]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
        assert pii.find(text)[0] == brute(text)


def test_disguises_map_back():
    base, added = pii.find(TEXT)
    assert base == brute(TEXT)
    got = {(k, TEXT[s:e]) for k, s, e in added}
    assert ("email", "john.doe [at] mail (dot) example.com") in got
    assert ("email", "jane at example dot org") in got
    assert ("email", "adm\u0456n@ex\u0430mple.com") in got
    assert ("card", "four one one one one one one one one one one one one one one one") in got
    assert ("card", "5\uff1500-0000-0000-0004") in got
    assert ("ip", "192 dot 168 dot 0 dot 12") in got
    spoken = "host one nine two dot one six eight dot zero dot One, call plus four nine three zero one two three four five six"
    assert {(k, spoken[s:e]) for k, s, e in pii.find(spoken)[1]} == {
        ("ip", "one nine two dot one six eight dot zero dot One"),
        ("phone", "plus four nine three zero one two three four five six"),
    }
    plain = "Meet me at the dot on one two three plans (at noon) in part two."
    assert pii.find(plain) == ([], []) and pii.redact(plain) == plain


def test_each_disguise_alone():
    alone = {
        "john @ example.com": "email",
        "jane at example.com": "email",
        "JANE AT EXAMPLE.COM": "email",
        "jane at example dot org": "email",
        "x@example{dot}com": "email",
        "x@example<dot>com": "email",
        "x@example [ dot ] com": "email",
        "john { at } example.com": "email",
        "john(AT)example.com": "email",
        "adm\u0456n@ex\u0430mple.com": "email",
        "plus 49 170 1234567": "phone",
        "plus four nine three zero one two three four five six": "phone",
        "10 point 20 point 30 point 40": "ip",
        "10.20.30 dot one": "ip",
        "5500-0000-0000-00O4": "card",
        "four one one one one one one one one one one one one one one one": "card",
    }
    for disguise, kind in alone.items():
        # the capital I with a dot becomes two characters in lower case
        for before, after in (("", ""), ("To ", ", please."), ("\u0130: ", "; \u0130"), ("\u00e9 ", " \u00e9")):
            text = before + disguise + after
            assert pii.find(text) == ([], [(kind, len(before), len(before) + len(disguise))]), text
    for plain in ("See you at noon.", "a <b> at (x) @ home", "one plus four", "x at y.zz", "two points dot"):
        assert pii.normalise(plain) is None and pii.find(plain) == ([], [])


def test_table(spark, docs_of):
    rows = [(1, TEXT), (2, None), (3, ""), (4, "a@b.cd"), (4, "a@b.cd"), (5, "x " * 200_000 + "a@b.cd"), (None, "1.2.3.4")]
    got = pii.digest(pii.find_spans(docs_of(rows))).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["base_sha256"] == sha256(b"").hexdigest() and by[2]["spans"] == ""
    assert by[4]["spans"] == "email:0:6" and by[5]["spans"] == "email:400000:400006" and by[None]["n_ip"] == 1
    line = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(TEXT))
    assert by[1]["base_sha256"] == sha256(line.encode()).hexdigest()
    assert pii.find_spans(docs_of([])).count() == 0
    clean = pii.redact_documents(docs_of(rows))
    assert clean.columns == docs_of([]).columns
    assert sorted(r["text"] or "" for r in clean.where("doc_id IN (2, 3, 4)").collect()) == ["", "", "[email]", "[email]"]


def test_addresses_begin_where_digits_do():
    """The search from beginnings of runs finds what the plain pattern finds, in time linear in the text."""
    pattern, rnd = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), random.Random(5)
    for _ in range(3000):
        text = "".join(rnd.choice("12.. a") for _ in range(rnd.randint(0, 40)))
        assert [m.span() for m in pii._IP.finditer(text)] == [m.span() for m in pattern.finditer(text)]
    for long in ("1" * 1_000_000 + ".", "1." * 500_000, ("1" * 1000 + ".x") * 1000, "+1" + " " * 1_000_000, "a" * 1_000_000 + "@"):
        started = time.perf_counter()
        pii.plain(long)
        assert time.perf_counter() - started < 3
