"""Personal data by offset-preserving deobfuscation.

Base spans are what the plain grammars of four kinds match in the text itself. Then transducers rewrite the text: homoglyphs
and compatibility forms to ASCII, invisible characters to nothing, spelled at/dot signs to signs, spelled digits to
digits. Each output character keeps the interval of source characters that it came from, so the same grammars run on the
normal form and their matches map back to source spans. Spans that the rewriting made possible are added; base spans stay.

A rewriting that could be chance (a bare "at", a spelled digit) counts only where the whole match bears it out: _plausible
states what a disguised address must show; spelled digits must come in runs. Secrets (access keys, assigned tokens and
passwords) are looked for in the text as it stands and told apart from the four kinds.

Scale. One pass over the texts, no shuffle; every scan is linear in the text's length (the address grammar is anchored at
its at sign, signs are matched at a character that is not blank, spans are looked up by place). Only texts that show a
trace of a disguise are rewritten, and a rewritten text holds its replacements only, not a place for each character.

Defined cases: null and empty texts have no spans; ties cannot arise, as spans of a kind do not overlap unless a disguised
address holds a base one; repeated rows give repeated rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Kept, text_batches
from quarry.session import ship

KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses, found from each at sign: the local part is the run of its characters before it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            done = max(done, at + 1)
            at = text.find("@", at + 1)
    return out


def ips(text: str) -> list[Span]:
    """Four dotted numbers of at most 255."""
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    """Digits with single spaces or hyphens: 14 to 19 that pass the Luhn test."""
    return [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 14 and 14 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[Span]:
    """A plus sign and 10 to 15 digits with usual separators."""
    return [m.span() for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.sub("", m[0])) <= 15]


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}
#: What a text must hold for a kind to occur.
_NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of each kind in the text as it stands."""
    return {kind: find(text) if _NEEDS[kind] in text else [] for kind, find in FINDERS.items()}


# --- transducers -----------------------------------------------------------------------------------------------------

#: Letters of other scripts that look like ASCII ones.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһӏԛԝАВЕКМНОРСТУХІЈЅαορνικτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlqwABEKMHOPCTYXIJSaopviktuABEZHIKMNOPTYX"))
#: Signs that compatibility forms do not cover.
SIGNS = {
    "․": ".", "。": ".", "·": ".", "•": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-",
    "\u00a0": " ", "\u2007": " ", "\u2009": " ", "\u202f": " ", "\u3000": " ",
}
#: Characters that show nothing.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\ufeff\u180e"
#: Spelled digits of the four languages.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
AT_WORDS, DOT_WORDS, PLUS_WORDS = ("at", "arroba", "arobase", "klammeraffe"), ("dot", "punkt", "punto", "point"), ("plus", "más")

_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
#: Every alternative begins and ends with a character that is not blank (but "plus", which ends with blanks that it alone
#: reads), so a run of blanks is not tried again from each of its places; spelled_signs takes in the blanks around a match.
_REWRITE = re.compile(
    rf"(?P<at>{_OPEN}\s*(?:{'|'.join(AT_WORDS)}|@|a)\s*{_CLOSE}|(?<=\s)(?:{'|'.join(AT_WORDS)})(?=\s)|(?<=\w)[_-](?:at|AT)[_-](?=\w)|@)"
    rf"|(?P<dot>{_OPEN}\s*(?:{'|'.join(DOT_WORDS)}|\.)\s*{_CLOSE}|(?<=\s)(?:{'|'.join(DOT_WORDS)})(?=\s)|(?<=\w)[_-](?:dot|DOT)[_-](?=\w))"
    rf"|(?P<plus>\b(?:{'|'.join(PLUS_WORDS)})\s+(?=(?:{_WORDS}|[0-9])))"
    rf"|(?P<digit>\b(?:(?P<times>double|triple)\s+)?(?P<word>{_WORDS})\b)"
    r"|(?P<letter>(?<=[0-9])[OolI]{1,4}(?=[ -]?[0-9])|(?<=[0-9][ -])[OolI]{1,4}(?=[0-9])|(?<=[0-9][ -])[OolI]{2,4}(?![A-Za-z]))",
    re.IGNORECASE,
)
_ODD = re.compile(r"[^\x00-\x7fÀ-ÿ]")
_BRACKETED = re.compile(rf"{_OPEN}\s*(?:{'|'.join(AT_WORDS + DOT_WORDS)}|@|a|\.)\s*{_CLOSE}")
_SPELLED_DOT = re.compile(rf"\b(?:{'|'.join(DOT_WORDS)})\b")
_LETTER_IN_DIGITS = re.compile(r"[0-9][ -]?[oli]{1,4}[ -]?[0-9]|[0-9][ -][oli]{2,4}\b")
_AT_DOMAIN = re.compile(r"\sat\s{1,4}[a-z0-9-]+\.[a-z]{2}")
_SPACED_AT = re.compile(r"\s@|@\s")
_BESIDE = " \t\n\r,.-()"


_KEPT = Kept()


def _digit_words():
    import ahocorasick

    out = ahocorasick.Automaton()
    for word in DIGIT_WORDS:
        out.add_word(word, len(word))
    out.make_automaton()
    return out


def _spelled_run(low: str) -> bool:
    """Whether a spelled digit stands beside another one or beside a digit."""
    last = -9
    for at, n in _KEPT.once("digits", _digit_words).iter(low):
        start, end = at - n + 1, at + 1
        if start and low[start - 1].isalnum() or end < len(low) and low[end].isalnum():
            continue
        if start - last <= 3 and not low[last:start].strip(_BESIDE):
            return True
        last = end
        if low[max(0, start - 3) : start].strip(_BESIDE)[-1:].isdigit() or low[end : end + 3].strip(_BESIDE)[:1].isdigit():
            return True
        if low[max(0, start - 7) : start].strip(_BESIDE) in ("double", "triple"):
            return True
    return False


def traces(text: str) -> bool:
    """Whether a text shows a trace of a spelled disguise; cheap tests first, all linear."""
    low = text.lower()
    return (
        any(c in low for c in "[({<") and _BRACKETED.search(low) is not None
        or any(w in low for w in DOT_WORDS) and _SPELLED_DOT.search(low) is not None
        or any(w in low for w in ("_at_", "-at-", "_dot_", "-dot-"))
        or " at " in low and _AT_DOMAIN.search(low) is not None
        or "@" in low and _SPACED_AT.search(low) is not None
        or _LETTER_IN_DIGITS.search(low) is not None
        or _spelled_run(low)
    )


class Traced:
    """A text that came from another one by replacing intervals, and the way back. Only the replacements are held: where each
    begins and ends in this text, and where in the one before."""

    def __init__(self, text: str, before: Traced | None = None, held: tuple[list[int], ...] = ()):
        self.text, self.before, self.held = text, before, held

    def _back(self, at: int, end: bool) -> int:
        """Place in the text before of a character: where it begins, or with end where it ends. A replaced one stands for its
        whole interval."""
        begins, ends, source_begins, source_ends = self.held
        i = bisect_right(begins, at) - 1
        if i < 0:
            return at + end
        if at < ends[i]:
            return source_ends[i] if end else source_begins[i]
        return at - ends[i] + source_ends[i] + end

    def span(self, a: int, b: int) -> Span:
        """Source interval of the characters from a to b."""
        return (a, b) if self.before is None else self.before.span(self._back(a, False), self._back(b - 1, True))

    def rewritten(self, parts: list[tuple[int, int, str]]) -> Traced:
        """Replace the given intervals, in order."""
        text, at, length = [], 0, 0
        held: tuple[list[int], ...] = ([], [], [], [])
        for a, b, new in parts:
            text += [self.text[at:a], new]
            length += a - at
            for own, place in zip(held, (length, length + len(new), a, b)):
                own.append(place)
            length += len(new)
            at = b
        return Traced("".join([*text, self.text[at:]]), self, held)


def plain_characters(text: Traced) -> Traced:
    """Homoglyphs, compatibility forms and invisible characters."""
    parts = []
    for m in _ODD.finditer(text.text):
        c = m[0]
        if c in INVISIBLE:
            new = ""
        elif (new := HOMOGLYPHS.get(c) or SIGNS.get(c)) is None:
            form = unicodedata.normalize("NFKC", c)
            digit = unicodedata.digit(c, None)
            new = str(digit) if digit is not None else form if form.isascii() else c
        if new != c:
            parts.append((*m.span(), new))
    return text.rewritten(parts) if parts else text


def spelled_signs(text: Traced) -> Traced:
    """At, dot and plus signs and digits that are spelled, and the letters O, o, l and I among digits."""
    own, parts, done, last_digit = text.text, [], 0, None
    for m in _REWRITE.finditer(own):
        a, b = m.span()
        if m["at"] or m["dot"]:
            if own[a] not in "_-":  # the blanks around a sign belong to it
                while a > done and own[a - 1].isspace():
                    a -= 1
                while b < len(own) and own[b].isspace():
                    b += 1
            if m[0] == "@" and b - a == 1:
                continue
            parts.append((a, b, "@" if m["at"] else "."))
        elif m["plus"]:
            parts.append((a, b, "+"))
        elif m["letter"]:
            parts += [(i, i + 1, "0" if own[i] in "Oo" else "1") for i in range(a, b)]
        else:
            times = {"double": 2, "triple": 3}.get((m["times"] or "").lower(), 1)
            if last_digit is not None and last_digit == done < a and not own[last_digit:a].strip(" \t\r\n,"):
                parts.append((last_digit, a, ""))
            parts.append((a, b, DIGIT_WORDS[m["word"].lower()] * times))
            last_digit = b
        done = b
    return text.rewritten(parts) if parts else text


#: Endings that a spelled address may have where its dot is written as a dot.
ENDINGS = {"com", "org", "net", "edu", "gov", "io", "co", "info", "biz", "de", "fr", "es", "uk", "us", "eu", "at", "ch", "it", "nl", "be", "pt", "ca", "au", "jp", "cn", "in", "br", "mx", "ru", "pl", "se", "no", "fi", "dk", "app", "dev", "ai", "me"}


#: Words that no address has for a domain, as in "look at the dot".
ARTICLES = {"the", "a", "an", "this", "that", "each", "every", "my", "your", "our", "his", "her", "their"}
#: Words that follow a dot in a sentence and are no ending of an address.
NO_ENDINGS = {"is", "on", "of", "to", "or", "and", "the", "that", "for", "with", "from", "was", "are", "as", "we", "he", "she", "they", "here", "there"}
_BRACKET_OR_SIGN = re.compile(rf"{_OPEN}|[@＠﹫]")
_JOINED_SIGN = re.compile(r"[_-](?:at|dot)[_-]", re.IGNORECASE)
_DOT = re.compile(r"\bdot\b", re.IGNORECASE)
#: A dot word of another language counts with an at word of that language.
_PAIRED = re.compile(r"\b(?:at|klammeraffe)\b.*\bpunkt\b|\barroba\b.*\bpunto\b|\barobase\b.*\bpoint\b", re.IGNORECASE | re.DOTALL)
_USER_NAME = re.compile(r"[0-9._+-]")


def _plausible(kind: str, found: str, source: str) -> bool:
    """Whether a match that is only there after rewriting is more than chance. An address needs an ending of 2 to 24 letters
    and one of: a bracket or a sign in the source; other letters than ASCII with a known ending; or, where its domain is no
    article, a spelled "dot" with an ending that is no common word; a dot word that fits its at word, or signs between hyphens or
    underscores, with a known ending; a bare "at" before a domain with a known ending, if the part before it has a digit,
    dot, plus, hyphen or underscore, as user names do and words do not."""
    if kind != "email":
        return True
    local, domain = found.split("@", 1)
    first, ending = domain.lower().split(".", 1)[0], domain.lower().rsplit(".", 1)[1]
    if not (2 <= len(ending) <= 24 and ending.isalpha()):
        return False
    if _BRACKET_OR_SIGN.search(source):
        return True
    if first in ARTICLES:
        return False
    if not source.isascii():
        return ending in ENDINGS
    if _DOT.search(source):
        return ending not in NO_ENDINGS
    return ending in ENDINGS and (_PAIRED.search(source) or _JOINED_SIGN.search(source) or _USER_NAME.search(local)) is not None


class Layer:
    """Spans in order that do not overlap, looked up by place."""

    def __init__(self, spans: list[Span]):
        self.spans, self.ends = list(spans), [b for _, b in spans]

    def add(self, span: Span) -> None:
        self.spans.append(span)
        self.ends.append(span[1])

    def touched(self, a: int, b: int) -> list[Span]:
        i, out = bisect_right(self.ends, a), []
        while i < len(self.spans) and self.spans[i][0] < b:
            out.append(self.spans[i])
            i += 1
        return out


def added_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that appear only once the text is rewritten. A span that lies in a base span, or touches a base span of its
    kind without being an address that holds it, is left out."""
    plain = plain_characters(Traced(text)) if _ODD.search(text) else Traced(text)
    forms = [plain] if plain.text != text else []
    if traces(plain.text):
        forms.append(spelled_signs(plain))
    layers = {kind: [Layer(base[kind])] for kind in KINDS}
    for form in forms:
        for kind, spans in base_spans(form.text).items():
            own = Layer([])
            for a, b in spans:
                span = form.span(a, b)
                source = text[slice(*span)]
                if source == form.text[a:b] or not _plausible(kind, form.text[a:b], source):
                    continue
                near = [s for layer in layers[kind] for s in layer.touched(*span)]
                if any(s[0] <= span[0] and span[1] <= s[1] for s in near) or near and kind != "email":
                    continue
                own.add(span)
            layers[kind].append(own)
    return {kind: [s for layer in own[1:] for s in layer.spans] for kind, own in layers.items()}


#: Forms of access keys, and names that a secret is assigned to.
SECRET = re.compile(
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----|\bAKIA[0-9A-Z]{16}\b|\bgh[opsu]_[A-Za-z0-9]{36,}|\bsk-[A-Za-z0-9_-]{20,}|\bxox[abprs]-[A-Za-z0-9-]{10,}"
    r"|\b(?:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|secret[_-]?key)[\"']?[ \t]{0,4}[:=][ \t]{0,4}[\"']?(?P<value>[A-Za-z0-9+/_=-]{16,})",
    re.IGNORECASE,
)
_SECRET_SIGNS = ("-----begin", "akia", "gh", "sk-", "xox", "token", "secret", "passw", "pwd", "key")


def secrets(text: str) -> list[Span]:
    """Access keys and assigned secrets; of an assignment the value."""
    low = text.lower()
    if not any(sign in low for sign in _SECRET_SIGNS):
        return []
    return [m.span("value") if m["value"] else m.span() for m in SECRET.finditer(text)]


def written(spans: dict[str, list[Span]]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    rows = sorted((a, KINDS.index(kind), b) for kind, own in spans.items() for a, b in own)
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in rows)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in text_batches(batches):
        base = [base_spans(t or "") for t in texts]
        every = []
        for t, b in zip(texts, base):
            more = added_spans(t, b) if t else {}
            every.append({k: b[k] + more.get(k, []) for k in KINDS})
        keys = [secrets(t or "") for t in texts]
        columns = [pa.array(ids, pa.int64()), *(pa.array([len(s[k]) for s in base], pa.int64()) for k in KINDS)]
        columns += [pa.array([written(s) for s in x], pa.string()) for x in (base, every)]
        columns += [pa.array([",".join(f"secret:{a}:{b}" for a, b in own) for own in keys], pa.string())]
        columns += [pa.array([sum(map(len, s.values())) + len(own) for s, own in zip(every, keys)], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "secrets", "n_found"])


def find_pii(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, the number of base spans of each kind, base and all spans as kind:start:end, comma-joined,
    spans of secrets (a kind of its own, apart from the four), and the number of all spans and secrets."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _found, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, secrets string, n_found long"
    )


def redacted(text: str, mask: str = "█") -> str:
    """The text with every span's characters masked; offsets stay."""
    base = base_spans(text)
    more = added_spans(text, base)
    chars = list(text)
    for a, b in [s for k in KINDS for s in base[k] + more[k]] + secrets(text):
        chars[a:b] = mask * (b - a)
    return "".join(chars)


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()


ship(__name__)
