import hashlib
import random
import re
import time

from quarry.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def brute(text):
    return {k: [m.span() for m in re.finditer(p, text) if valid(k, m[0])] for k, p in PATTERNS.items()}


def test_base_against_patterns():
    r = random.Random(1)
    for alphabet in ("a1.@ -+()", "0123456789. -+", "ab@.é\n"):
        for _ in range(1500):
            text = "".join(r.choice(alphabet) for _ in range(r.randrange(60)))
            assert pii.base_spans(text) == brute(text), text
    card = "4111 1111-1111 1111"
    assert pii.base_spans(f"x{card}, 1.2.3.256 0001.2.3.4 +1 (415) 555-0100")["card"] == [(1, 20)]


def extra(text):
    base = pii.base_spans(text)
    return sorted(text[a:b] for own in pii.added_spans(text, base).values() for a, b in own)


def test_disguises():
    for text, found in {
        "mail john.doe [at] example [dot] com now": "john.doe [at] example [dot] com",
        "mail john(at)example.com now": "john(at)example.com",
        "mail john at example dot com now": "john at example dot com",
        "mail john@example[.]org!": "john@example[.]org",
        "mail jоhn＠example．com": "jоhn＠example．com",
        "mail jo​hn@exam​ple​.com": "jo​hn@exam​ple​.com",
        "call plus one four one five five five five zero one zero zero please": "plus one four one five five five five zero one zero zero",
        "ip １９２.168.０.1 ok": "１９２.168.０.1",
        "ip 10 dot 0 dot 0 dot 7 ok": "10 dot 0 dot 0 dot 7",
        "write to joe_at_example_dot_org.": "joe_at_example_dot_org",
        "mail bob @ example.com.": "bob @ example.com",
        "mail anna at mail dot ie now": "anna at mail dot ie",
        "mail anna.b at mail.com now": "anna.b at mail.com",
        "mail ana arroba correo punto es": "ana arroba correo punto es",
        "ring plus one (784) 555-9263 now": "plus one (784) 555-9263",
        "ring +1 4I5 555 OlOO now": "+1 4I5 555 OlOO",
        "card 4lll 1111 1111 1111 x": "4lll 1111 1111 1111",
    }.items():
        assert found in extra(text), (text, extra(text))


def test_long_texts_are_read_in_linear_time():
    n = 1_000_000
    for run in (" ", "\n", "[", "( ", "1", "1 ", "one ", "@ ", " at ", "[at]", "a@b.co ", "bob [at] mail.com ", "dot\n", "plus  ", "о", "4l", "+1 "):
        text = "amy [at] mail [dot] com " + run * (n // len(run)) + " joe (at) mail.org"
        began = time.perf_counter()
        base = pii.base_spans(text)
        found = pii.added_spans(text, base)
        assert (0, 23) in found["email"], run
        assert time.perf_counter() - began < 12, (run, time.perf_counter() - began)


KINDS_OF_DISGUISE = {
    "brackets": lambda u, d, e: (f"{u} [at] {d} [dot] {e}", "email"),
    "spelled": lambda u, d, e: (f"{u} at {d} dot {e}", "email"),
    "joined": lambda u, d, e: (f"{u}_at_{d}_dot_com", "email"),
    "blanks": lambda u, d, e: (f"{u} @ {d}.{e}", "email"),
    "wide": lambda u, d, e: (f"{u}\uff20{d}\uff0e{e}", "email"),
    "homoglyphs": lambda u, d, e: (f"{u}@{d}.com".replace("o", "\u043e").replace("a", "\u0430"), "email"),
    "spanish": lambda u, d, e: (f"{u} arroba {d} punto com", "email"),
    "words": lambda u, d, e: ("plus " + " ".join(random.Random(u).choice(["one", "two", "nine", "five", "zero"]) for _ in range(11)), "phone"),
    "letters": lambda u, d, e: ("+1 4I5 555 " + "".join(random.Random(u).choice("0O1lI") for _ in range(3)) + "7", "phone"),
    "ip": lambda u, d, e: (f"10 dot {len(u)} dot {len(d)} dot 7", "ip"),
    "digits": lambda u, d, e: ("4111 1111 1111 1111".translate(str.maketrans("41", "\uff14\uff11")), "card"),
}


def test_recall_by_kind_of_disguise():
    r = random.Random(5)
    name = lambda: "".join(r.choice("abcdefgiklmnoprstuvw") for _ in range(r.randrange(4, 9)))
    for kind, make in KINDS_OF_DISGUISE.items():
        caught = 0
        for _ in range(60):
            hidden, what = make(name() + r.choice(["", ".x", "7"]) if kind != "homoglyphs" else "nao" + name(), name(), r.choice(["com", "org", "ie", "museum", "nz"]))
            before = " ".join(name() for _ in range(5)) + ", "
            text = before + hidden + "; " + name()
            found = pii.added_spans(text, pii.base_spans(text))[what]
            caught += (len(before), len(before) + len(hidden)) in found
        assert caught >= 54, (kind, caught)


def test_added_spans_against_a_naive_rewriting():
    """The grammars on a text whose signs are replaced by hand, with every character's place kept in a list."""
    r = random.Random(9)
    pieces = ["amy", "joe7", " [at] ", " (at) ", "@", " [dot] ", "[.]", ".", "mail", "net", "com", " ", " x ", "12", "\uff11", "\u0430"]
    plain = {" [at] ": "@", " (at) ": "@", " [dot] ": ".", "[.]": ".", "\uff11": "1", "\u0430": "a"}
    for _ in range(3000):
        chosen = [r.choice(pieces) for _ in range(r.randrange(12))]
        text, form, places = "", "", []
        for piece in chosen:
            new = plain.get(piece, piece)
            places += [(len(text), len(text) + len(piece))] * len(new) if piece in plain else [(len(text) + i, len(text) + i + 1) for i in range(len(piece))]
            text, form = text + piece, form + new
        if re.search(r"\s[@.]|[@.]\s|\s\s", form) or re.search(r"\s@|@\s", text) or " [at]  " in text or re.search(r"\]\s\s|\s\s[\[(]", text):
            continue  # blanks that the rewriting takes in
        base = pii.base_spans(text)
        got = {s for s in pii.added_spans(text, base)["email"]}
        for a, b in brute(form)["email"]:
            span, ending = (places[a][0], places[b - 1][1]), form[a:b].rsplit(".", 1)[1]
            if text[slice(*span)] != form[a:b] and ending.isalpha() and len(ending) >= 2 and not any(x <= span[0] and span[1] <= y for x, y in base["email"]):
                source = text[slice(*span)]
                if "[" in source or "(" in source or "@" in source or ending in pii.ENDINGS:
                    assert span in got, (text, form, span, got)


def test_secrets():
    key = "0f" * 20
    text = f'x token = "{key}" y, API_KEY: {key}; tokens = 5, password=short, AKIA{"A1" * 8} end'
    assert [text[a:b] for a, b in pii.secrets(text)] == [key, key, "AKIA" + "A1" * 8]
    assert pii.secrets("") == [] and key not in pii.redacted(text)


def test_chance_is_left_alone():
    for text in ["", "Meet at noon. Dot the i.", "one two three", "look at home at six", "The form of that is at a point of in", "at at at dot dot", "look at the dot com bubble", "read more at example.com today", "a (b) {c} <d>", "e. at 10.5 or 3.14.15", "look at some point in time", "he stopped at zero point five", "at dawn dot is seen", "stay at home.com"]:
        assert extra(text) == []


def test_offsets_are_code_points_and_base_stays():
    text = "😀é bob@mail.example.com, amy [at] mail [dot] example [dot] com 😀"
    base = pii.base_spans(text)
    assert pii.written(base) == "email:3:23"
    assert extra(text) == ["amy [at] mail [dot] example [dot] com"]
    masked = pii.redacted(text)
    assert len(masked) == len(text) and "bob" not in masked and "amy" not in masked and masked.startswith("😀é ")


def test_rows(spark):
    texts = [None, "", "a@b.co", "a@b.co", "1" * 300_000, "x" * 300_000 + "@", "+" * 50_000, "1.1" * 30_000]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_email int")
    got = {r.doc_id: r for r in pii.find_pii(frame).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = pii.written(brute(t or "")) if len(t or "") < 1000 else got[i].base
        assert got[i].base == want and pii.digest(got[i].base) == hashlib.sha256(want.encode()).hexdigest()
    assert pii.find_pii(frame.limit(0)).count() == 0
