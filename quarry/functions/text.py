"""Text functions as Column expressions: normalizers, n-grams, templates, ratios, answer extraction, redaction.

Character classes are spelled out (letters and numbers of all scripts), since Java's word class is ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def tokens_v2(text: Column) -> Column:
    """Tokens of the spaced normal form: lower case, dollar signs and LaTeX spacing gone, punctuation apart, and only tokens
    with a letter or digit kept (so x_1 stays one token)."""
    low = F.regexp_replace(F.lower(text), r"\$", "")
    low = F.regexp_replace(low, r"\\(?:left|right|quad)(?![a-z])|\\[()\[\],;!]", "")
    low = F.regexp_replace(low, r"([^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\p{Z}])", " $1 ")
    return F.filter(F.split(low, SPACE + "+"), lambda t: t.rlike(r"[\p{L}\p{N}]"))


def normal_v2(text: Column) -> Column:
    return F.array_join(tokens_v2(text), " ")


def normal_lexical(text: Column) -> Column:
    """The lexical normal form: lower case, layout commands gone, fraction commands alike, text commands unwrapped, then
    runs of letters and runs of digits (so x2 is two tokens and the underscore goes)."""
    low = F.lower(text)
    plain = F.regexp_replace(low, r"\\(?:left|right|displaystyle|textstyle|scriptstyle|scriptscriptstyle|quad|qquad|enspace|thinspace)\b", " ")
    plain = F.regexp_replace(plain, r"\\[,;! :]|\$", " ")
    plain = F.regexp_replace(plain, r"\\(?:dfrac|tfrac)\b", r"\\frac")
    plain = F.regexp_replace(plain, r"\\(?:mathrm|mathbf|mathit|text|textrm|operatorname)\s*\{([^{}]*)\}", " $1 ")
    # each command begins with a backslash, and a dollar sign alone parts runs as a space does
    low = F.when(F.contains(text, F.lit("\\")), plain).otherwise(low)
    return F.array_join(F.regexp_extract_all(low, F.lit(r"([\p{L}\p{Nl}\p{No}]+|\p{Nd}+)"), F.lit(1)), " ")


def words(normal: Column) -> Column:
    return F.when(normal == "", F.array().cast("array<string>")).otherwise(F.split(normal, " "))


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once per row: a lambda that mentions a column expression computes it anew for
    each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def grams(tokens: Column, n: int, distinct: bool = True) -> Column:
    """n-grams of an array of tokens, space-joined; none where the array is shorter."""

    def made(own: Column) -> Column:
        starts = F.slice(own, 1, F.greatest(F.size(own) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda _, i: F.array_join(F.slice(own, i + 1, n), " "))

    out = bound(tokens, made)
    return F.array_distinct(out) if distinct else out


def shingles(normal: Column, n: int) -> Column:
    """n-grams of a normal form, or the whole of it where it is shorter."""
    own = grams(words(normal), n)
    return F.when(F.size(own) > 0, own).otherwise(F.array(normal))


def gram_hashes(tokens: Column, n: int) -> Column:
    """64-bit hashes of the n-grams of an array of tokens, repeats included; none where the array is shorter."""

    def made(own: Column) -> Column:
        starts = F.slice(own, 1, F.greatest(F.size(own) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda h, i: F.xxhash64(h, *[F.get(own, i + k) for k in range(1, n)]))

    return bound(F.transform(tokens, lambda w: F.xxhash64(w)), made)


def shingle_hashes(normal: Column, n: int) -> Column:
    """64-bit hashes of the distinct n-grams of a normal form (of the whole of it where it is shorter), ascending."""
    whole = F.array(F.xxhash64(normal))
    return F.sort_array(F.array_distinct(bound(gram_hashes(words(normal), n), lambda h: F.when(F.size(h) > 0, h).otherwise(whole))))


def numeric_template(normal: Column) -> Column:
    """The normal form with every number that stands alone replaced."""
    return F.array_join(F.transform(words(normal), lambda w: F.when(w.rlike(r"^\p{Nd}+$"), F.lit("NUM")).otherwise(w)), " ")


def hangul_ratio(text: Column) -> Column:
    """Share of Hangul among the letters; 0 without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    hangul = F.length(F.regexp_replace(text, r"[^\x{ac00}-\x{d7a3}\x{1100}-\x{11ff}\x{3130}-\x{318f}]", ""))
    return F.when(letters > 0, hangul / letters).otherwise(F.lit(0.0))


#: How a chosen option is declared.
CHOICE = r"(?i)(?:the\s+(?:best\s+)?answer\s+is|final\s+answer\s*:|answer\s*:)\s*\**\s*\(?([A-J])\)?(?=[\s.,:;!*\)]|$)"
CHOICE_ALONE = r"(?i)^\s*\(?([A-J])\)?[.\s]*$"
DECLARED = r"(?i)(?:the\s+answer\s+is|final\s+answer\s*:)"


def choice_answer(text: Column, choices: Column) -> Column:
    """The last declared option letter, or that of an answer-only text; null unless it is one of the choices."""
    declared = F.regexp_extract_all(text, F.lit(CHOICE), F.lit(1))
    alone = F.regexp_extract(text, CHOICE_ALONE, 1)
    value = F.upper(F.when(F.size(declared) > 0, F.element_at(declared, -1)).otherwise(alone))
    return F.when(F.array_contains(choices, value), value)


def declared_answer(text: Column, target: Column) -> Column:
    """The first line after the last declaration (or the whole text), without a final dot; for a target that is an option
    in parentheses, the option in that form or null."""
    parts = F.split(text, DECLARED)
    tail = F.trim(F.element_at(parts, -1))
    value = F.when(F.size(parts) > 1, F.trim(F.get(F.split(tail, "\n"), F.lit(0)))).otherwise(F.trim(text))
    value = F.trim(F.regexp_replace(value, r"\.$", ""))
    option = F.regexp_extract(value, r"^\(?([A-Z])\)?$", 1)
    return F.when(target.rlike(r"^\([A-Z]\)$"), F.when(option != "", F.concat(F.lit("("), option, F.lit(")")))).otherwise(F.nullif(value, F.lit("")))


def split_reasoning(response: Column) -> Column:
    """Struct of reasoning, answer and status of a response with think tags."""
    opened, closed = F.instr(response, "<think>") > 0, F.instr(response, "</think>") > 0
    inner = F.substring_index(F.when(opened, F.substring_index(response, "<think>", -1)).otherwise(response), "</think>", 1)
    return F.struct(
        F.when(closed | opened, F.trim(inner)).alias("reasoning"),
        F.when(closed, F.trim(F.substring_index(response, "</think>", -1))).when(~opened, F.trim(response)).alias("answer"),
        F.when(closed, F.lit("complete")).when(opened, F.lit("unclosed")).otherwise(F.lit("none")).alias("status"),
    )


def redacted(text: Column, most: int = 2000) -> Column:
    """Error text without API keys, at most so many characters."""
    return F.substring(F.regexp_replace(text, r"sk-[A-Za-z0-9_-]+", "[redacted]"), 1, most)


def retry_after(value: Column, now: Column) -> Column:
    """Seconds that a Retry-After header asks for: a number, or an HTTP date less the present time; never below 0, and 0 for
    null and for what is neither."""
    number = F.when(value.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"), F.trim(value).try_cast("double"))
    date = F.try_to_timestamp(F.regexp_replace(value, r"^\s*[A-Za-z]+,\s*", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    left = F.unix_micros(date) / 1e6 - F.unix_micros(now) / 1e6
    return F.greatest(F.lit(0.0), F.coalesce(number, left, F.lit(0.0)))


def has_chat_token(text: Column, tokens: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>")) -> Column:
    """Whether a text holds a token of the chat format, which would break a rendered example."""
    out = F.lit(False)
    for t in tokens:
        out = out | F.contains(text, F.lit(t))
    return out


def derived_seed(*parts: Column) -> Column:
    """A seed below 2^32 from the SHA-256 of the parts joined by colons."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 8), 16, 10).cast("long")


def rank_key(seed: int, *parts: Column) -> Column:
    """SHA-256 of the canonical JSON list of a seed and strings: the sampler's rank."""
    quoted = [F.concat(F.lit('"'), p, F.lit('"')) for p in parts]
    return F.sha2(F.concat(F.lit(f"[{seed}, "), F.concat_ws(", ", *quoted), F.lit("]")), 256)
