"""Column functions over names, paths, lines and texts; all stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
#: What counts as one heuristic token though it has more than one character.
PIECE = r"[\p{L}\p{N}_]{2,3}|\s\s+"
TEST_PATH = r"(^|/)tests?/|(^|/)test_[^/]+$|[^/]_test\.[^/.]+$|[^/]\.(test|spec)\.[^/.]+$"
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx",
}
CONTAINERS = ("class", "interface", "enum", "module", "type", "struct")
CALLABLES = ("function", "method")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token_count(text: Column | str) -> Column:
    """Heuristic tokens: a word costs a third of its characters, rounded up; any other character and any white space run one.

    Pieces of a token each become one character, so that no list of them is made.
    """
    return F.char_length(F.regexp_replace(_col(text), PIECE, "x")).cast("long")


def line_count(text: Column | str) -> Column:
    """Lines of a text; a last line without line feed counts."""
    t = _col(text)
    return (F.char_length(t) - F.char_length(F.replace(t, F.lit("\n"), F.lit(""))) + F.when((t == "") | F.endswith(t, F.lit("\n")), 0).otherwise(1)).cast("int")


def tail_of(name: Column | str) -> Column:
    """Last dotted segment."""
    return F.substring_index(_col(name), ".", -1)


def parent_of(name: Column | str) -> Column:
    """All but the last dotted segment; empty for a plain name."""
    n = _col(name)
    return F.when(F.contains(n, F.lit(".")), F.regexp_replace(n, r"\.[^.]*$", "")).otherwise(F.lit(""))


def is_test_path(path: Column | str) -> Column:
    return _col(path).rlike(TEST_PATH)


def normalised_path(path: Column | str) -> Column:
    """Forward slashes, and no leading "./", however often it is written."""
    return F.regexp_replace(F.replace(_col(path), F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def in_focus(path: Column | str, prefixes: Sequence[str]) -> Column:
    """Whether a path is one of the prefixes or under one; empty prefixes don't count."""
    p = _col(path)
    found = F.lit(False)
    for prefix in prefixes:
        plain = re.sub(r"^(\./)+", "", prefix.replace("\\", "/")).rstrip("/")
        if plain:
            found = found | (p == plain) | F.startswith(p, F.lit(plain + "/"))
    return found


def language_of(path: Column | str) -> Column:
    """Language by the file's extension, null if it isn't supported."""
    pairs = [x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.regexp_extract(_col(path), r"(\.[^./]+)$", 1)))


def priority(kind: Column | str, exported: Column | str) -> Column:
    """Order within a file: containers, exported callables, other exported names, the rest."""
    k = _col(kind)
    return F.when(k.isin(*CONTAINERS), 0).when(_col(exported) & k.isin(*CALLABLES), 1).when(_col(exported), 2).otherwise(3)


def is_exact(name: Column | str, wanted: str) -> Column:
    """Whether a name or its last segment is ``wanted``, whatever the case."""
    low = F.lower(_col(name))
    return (low == wanted.lower()) | (tail_of(low) == wanted.lower())


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a shell pattern, for Java and RE2 alike."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            j = i + (pattern[i : i + 1] == "!")
            j += pattern[j : j + 1] == "]"
            end = pattern.find("]", j)
            if end < 0:
                out += "\\["
                continue
            body = pattern[i:end]
            negated = body.startswith("!")
            body = re.sub(r"([\\\[\]&^~])", r"\\\1", body[negated:])
            out += f"[{'^' if negated else ''}{body}]"
            i = end + 1
        else:
            out += re.sub(r"([^\w\s])", r"\\\1", c) if c.isascii() else c
    return f"(?s)^{out}$"


def is_glob(pattern: str) -> bool:
    return any(c in pattern for c in "*?[")


def matches(name: Column | str, pattern: str) -> Column:
    """Substring match without regard to case, or a glob on the name or its last segment."""
    low = F.lower(_col(name))
    if is_glob(pattern):
        regex = glob_regex(pattern.lower())
        return low.rlike(regex) | tail_of(low).rlike(regex)
    return F.contains(low, F.lit(pattern.lower()))


def collapsed(text: Column | str) -> Column:
    """White space runs as one space, none at either end."""
    return F.trim(F.regexp_replace(_col(text), r"(?U)\s+", " "))


def tidied(text: Column | str) -> Column:
    """A signature without the spaces and commas that line breaks leave behind brackets."""
    t = F.regexp_replace(_col(text), r"([(\[{])\x20+", "$1")
    t = F.regexp_replace(t, r"\x20+([)\]},;])", "$1")
    return F.regexp_replace(t, r",([)\]}])", "$1")


def shortened(text: Column | str, limit: int) -> Column:
    """At most ``limit`` characters, dots for what is cut."""
    t = _col(text)
    return F.when(F.char_length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("...")))


def clipped(text: Column | str, limit: int = 200) -> Column:
    """Collapsed and cut at ``limit`` characters, as call arguments are recorded."""
    return F.substring(collapsed(text), 1, limit)


def byte_capped(data: Column | str, cap: int) -> Column:
    """The longest valid UTF-8 prefix of at most ``cap`` bytes."""
    b = _col(data).cast("binary")
    return F.coalesce(*(F.try_validate_utf8(F.substring(b, 1, cap - k).cast("string")) for k in range(4)), F.lit(""))


def looks_binary(head: Column | str, sniffed: int = 8192) -> Column:
    """Whether the first bytes hold a NUL; unreadable content counts as binary."""
    return F.coalesce(F.expr("position(x'00', " + f"substring({head}, 1, {sniffed})) > 0") if isinstance(head, str) else F.lit(True), F.lit(True))


def file_header(path: Column | str, loc: Column | str) -> Column:
    return F.concat(_col(path), F.lit(" ("), _col(loc).cast("string"), F.lit(" loc)"))


def symbol_text(signature: Column | str = "signature", line: Column | str = "line", doc: Column | str = "doc") -> Column:
    """A symbol's line in a map, without its indent."""
    d = F.coalesce(_col(doc), F.lit(""))
    return F.concat(_col(signature), F.lit(" :"), _col(line).cast("string"), F.when(d != "", F.concat(F.lit(" - "), d)).otherwise(F.lit("")))


def hit_text() -> Column:
    """A found symbol's line: path:line, its qualified name if that says more, signature, doc."""
    d = F.coalesce(F.col("doc"), F.lit(""))
    qualified = F.when(F.contains("name", F.lit(".")), F.concat(F.lit(" "), F.col("name"), F.lit(":"))).otherwise(F.lit(""))
    return F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), qualified, F.lit(" "), F.col("signature"), F.when(d != "", F.concat(F.lit(" - "), d)).otherwise(F.lit("")))
