"""Scalar functions over text and bytes, as built-in expressions.

Offsets of ``regex_find`` and of slices are bytes of UTF-8, from 0. Slices end at whole characters.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIFF = 4096
#: Magic bytes of the media kinds (fixed values): hex prefix, kind, format.
MAGIC = (
    ("255044462D", "document", "pdf"), ("89504E47", "image", "png"), ("FFD8FF", "image", "jpeg"), ("47494638", "image", "gif"),
)
KIND = "struct<kind: string, format: string>"


class PatternError(ValueError):
    """A pattern that can't be used, found when the plan is made."""


def dialect(pattern: str) -> str:
    """A pattern with Unicode classes and case, as Java spells it; look-around and back-references don't exist."""
    if re.search(r"\(\?(?:[=!]|<[=!])", pattern):
        raise PatternError(f"look-around isn't supported: {pattern!r}")
    if re.search(r"(?<!\\)(?:\\\\)*\\(?:[1-9]|k<)", pattern):
        raise PatternError(f"back-references aren't supported: {pattern!r}")
    try:
        re.compile(re.sub(r"\\[pPzZGQEhHRXvV](?:\{\w+\})?|\(\?<(?=\w)", lambda m: "(?P<" if m[0] == "(?<" else "x", pattern))
    except re.error as e:
        raise PatternError(f"invalid pattern {pattern!r}: {e}") from None
    out = re.sub(r"\(\?i", "(?iu", pattern)
    return f"(?U){out}" if re.search(r"\\[dDsSwWbB]|\(\?iu|\[\[:", out) else out


def regex_test(text: Column, pattern: str) -> Column:
    return text.rlike(dialect(pattern))


def regex_find(text: Column, pattern: str) -> Column:
    """struct<found, start, end, text> of the first match; (false, -1, -1, "") where there is none."""
    p = F.lit(dialect(pattern))
    hit, place = F.regexp_substr(text, p), F.regexp_instr(text, p)
    start = F.octet_length(F.substring(text, F.lit(1), place - 1)).cast("long")
    found = F.struct(F.lit(True).alias("found"), start.alias("start"), (start + F.octet_length(hit)).alias("end"), hit.alias("text"))
    none = F.struct(F.lit(False).alias("found"), F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"), F.lit("").alias("text"))
    return F.when(text.isNull(), None).when(hit.isNull(), none).otherwise(found)


def regex_replace_all(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, dialect(pattern), by)


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def _continues(content: Column, at: Column) -> Column:
    """Whether the byte at ``at`` goes on with a character that began before it."""
    return F.coalesce(F.hex(F.substring(content, at + 1, F.lit(1))).between("80", "BF"), F.lit(False))


def whole_end(content: Column, end: Column) -> Column:
    """The last place up to ``end`` where a character begins or the content ends."""
    out = end - 3
    for back in (2, 1, 0):
        out = F.when(_continues(content, end - back), out).otherwise(end - back)
    return out


def slice_text(content: Column, offset: int | Column, size: int | Column) -> Column:
    """struct<text, next_offset, error> of a window cut back to whole characters."""
    offset, size, total = _long(offset), _long(size), F.octet_length(content).cast("long")
    end = whole_end(content, F.least(offset + size, total))
    text = F.substring(content, (offset + 1).cast("int"), (end - offset).cast("int")).cast("string")
    error = F.when(offset > total, "offset past the end").when((offset < total) & (end <= offset), "window smaller than one character")
    ok = error.isNull()
    return F.struct(F.when(ok, text).alias("text"), F.when(ok, F.greatest(end, offset)).alias("next_offset"), error.alias("error"))


def _long(value: int | Column) -> Column:
    return F.lit(value).cast("long") if isinstance(value, int) else value.cast("long")


def slice_bytes(content: Column, offset: int, size: int) -> Column:
    """base64 of exact bytes, without line breaks, clamped to the content."""
    return F.regexp_replace(F.base64(F.substring(content, offset + 1, size)), r"[\r\n]", "")


_CHUNK = 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def windows(text: Column, size: int) -> Column:
    """array<struct<offset, next_offset, text>> of the windows of a text; null if a window can't hold a character.

    The cuts are found in chunks of bounded size, so time stays in proportion to the number of windows.
    """

    def walk(content: Column) -> Column:
        total = F.length(content)
        most = F.greatest(F.ceil(total / max(size - 3, 1)).cast("int"), F.lit(1))

        def inner(acc: Column, _: Column) -> Column:
            end = whole_end(content, F.least(acc["at"] + size, total))
            more = lambda e: F.when(e <= acc["at"], acc).otherwise(F.struct(e.alias("at"), F.concat(acc["cuts"], F.array(e)).alias("cuts")))
            return F.when(acc["at"] >= total, acc).otherwise(_let(end, more))

        def outer(acc: Column, _: Column) -> Column:
            empty = F.struct(acc["at"].alias("at"), F.array().cast("array<int>").alias("cuts"))
            part = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(_CHUNK), most)), empty, inner)
            done = _let(part, lambda p: F.struct(p["at"].alias("at"), F.concat(acc["parts"], F.array(p["cuts"])).alias("parts")))
            return F.when(acc["at"] >= total, acc).otherwise(done)

        start = F.struct(F.lit(0).alias("at"), F.array(F.array(F.lit(0))).alias("parts"))
        cuts = F.aggregate(F.sequence(F.lit(1), F.ceil(most / _CHUNK).cast("int")), start, outer, lambda acc: F.flatten(acc["parts"]))

        def window(c: Column):
            def at(a: Column, i: Column) -> Column:
                stop = F.coalesce(F.get(c, i + 1), a)
                return F.struct(a.cast("long").alias("offset"), stop.cast("long").alias("next_offset"), F.substring(content, a + 1, stop - a).cast("string").alias("text"))

            # a walk that stopped short met a window that can't hold a character
            whole = F.element_at(c, -1) == total
            return F.when(whole, F.transform(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(1))), at))

        return _let(cuts, window)

    return _let(F.encode(text, "UTF-8"), walk)


def classify(head: Column) -> Column:
    """KIND of content by its first bytes; empty is text, and so is UTF-8 whose last character is cut."""
    head = F.substring(head, 1, SNIFF)
    kind = None
    for magic, name, fmt in MAGIC:
        value = F.struct(F.lit(name).alias("kind"), F.lit(fmt).alias("format"))
        test = F.hex(F.substring(head, 1, len(magic) // 2)) == magic
        kind = F.when(test, value) if kind is None else kind.when(test, value)
    webp = (F.hex(F.substring(head, 1, 4)) == "52494646") & (F.hex(F.substring(head, 9, 4)) == "57454250")
    text = F.struct(F.lit("text").alias("kind"), F.lit(None).cast("string").alias("format"))
    binary = F.struct(F.lit("binary").alias("kind"), F.lit(None).cast("string").alias("format"))
    n = F.length(head)
    valid = F.is_valid_utf8(head.cast("string"))
    # a head may end within a character: its last bytes must begin one that isn't finished
    lead = lambda k: F.hex(F.substring(head, n - k + 1, F.lit(1)))
    begins = lambda k: {1: lead(k).between("C2", "F4"), 2: lead(k).between("E0", "F4"), 3: lead(k).between("F0", "F4")}[k]
    cut = F.lit(False)
    for k in (1, 2, 3):
        tail = F.lit(True)
        for j in range(1, k):
            tail = tail & lead(j).between("80", "BF")
        cut = cut | ((n > k) & begins(k) & tail & F.is_valid_utf8(F.substring(head, F.lit(1), n - k).cast("string")))
    return kind.when(webp, F.struct(F.lit("image").alias("kind"), F.lit("webp").alias("format"))).when(valid | F.coalesce(cut, F.lit(False)), text).otherwise(binary)


def stub_reply(reply: Column, max_tokens: int) -> Column:
    """The stub backend's answer: the first words of a canned reply."""
    kept = F.slice(F.filter(F.split(reply, r"\s+"), lambda w: w != ""), 1, max_tokens)
    return F.array_join(kept, " ")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


#: Model families known to reason, and known not to (fixed values).
REASONING = ("deepseek-r1", "qwq", "qwen3", "phi4-reasoning", "magistral", "marco-o1")
PLAIN = ("llama3", "llama2", "gemma", "mistral", "phi3", "phi4-mini", "codellama", "starcoder")


def reasoning_tag(name: Column) -> Column:
    """True, false, or null where it isn't known; embedding models are never known."""
    low = F.lower(name)
    some = lambda names: low.rlike("|".join(re.escape(n) for n in names))
    return F.when(low.contains("embed"), None).when(some(REASONING), True).when(some(PLAIN), False)


_NAME = "[A-Za-z0-9._-]+"


def is_catalog_name(text: Column) -> Column:
    """``name@version``."""
    return F.coalesce(text.rlike(rf"^{_NAME}@{_NAME}$"), F.lit(False))


#: Names that some systems keep for devices (fixed values).
DEVICES = ("con", "prn", "aux", "nul") + tuple(f"com{i}" for i in range(1, 10)) + tuple(f"lpt{i}" for i in range(1, 10))


def is_block_name(text: Column) -> Column:
    return F.coalesce(text.rlike("^[A-Za-z][A-Za-z0-9_-]*$") & ~F.lower(text).isin(*DEVICES), F.lit(False))


def rfc3339(timestamp: Column) -> Column:
    return F.date_format(F.date_trunc("second", timestamp), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def strict_json(text: Column) -> Column:
    """The VARIANT of JSON text, null if it isn't one whole value.

    The parser stops after the first value, whatever follows; so the text must also read as a list's only
    member and as a record's only field.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    field = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    one = F.size(listed.try_cast("array<variant>")) == 1
    return F.when(one & field.isNotNull(), F.try_variant_get(listed, "$[0]", "variant"))


def parsed(text: Column) -> Column:
    """struct<value: variant, error: string>: JSON text that can't be read is an error to be caught, and null is none."""
    value = strict_json(text)
    return F.struct(value.alias("value"), F.when(value.isNull() & text.isNotNull(), F.lit("not JSON")).alias("error"))


def prompt(text: Column, before: str, after: str = "") -> Column:
    """A prompt around a text without the white space at its ends."""
    return F.concat(F.lit(before), F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(after))
