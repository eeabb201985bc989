"""Text functions of content filtering, as Column expressions.

Null gives null everywhere unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper-case letters that the body fold lowers: A to Z and the Latin-1 letters, not the multiplication sign.
FOLD_UPPER = "".join(map(chr, [*range(0x41, 0x5B), *(c for c in range(0xC0, 0xDE) if c != 0xD7)]))
FOLD_LOWER = FOLD_UPPER.lower()
_ASCII_UPPER, _ASCII_LOWER = FOLD_UPPER[:26], FOLD_LOWER[:26]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _ASCII_UPPER, _ASCII_LOWER)


def ascii_upper(c: Column) -> Column:
    return F.translate(c, _ASCII_LOWER, _ASCII_UPPER)


def fold(c: Column) -> Column:
    """Body fold: lower case as above; tab, line feed and carriage return become spaces."""
    return F.translate(c, FOLD_UPPER + "\t\n\r", FOLD_LOWER + "   ")


def white_to_space(c: Column) -> Column:
    """The fold without the change of case."""
    return F.translate(c, "\t\n\r", "   ")


def smart_strip(c: Column) -> Column:
    """Drops tags (an unterminated one to the end), one space for each ">", runs of spaces to one, one in front.

    The text between tags is meant: "a<b>c" gives " a c".
    """
    open_end = F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), "<[^>]*$", "")
    return F.concat(F.lit(" "), F.ltrim(F.regexp_replace(F.translate(open_end, ">", " "), " +", " ")))


def meta_title(c: Column) -> Column:
    """Text of meta tags and titles up to the end of the head (else the start of the body), for folded text.

    Punctuation , = " ' ( ) . becomes a space, runs of spaces one; "" where there is none.
    """
    head = F.when(c.contains("</head"), F.substring_index(c, "</head", 1)).otherwise(F.substring_index(c, "<body", 1))
    parts = F.regexp_extract_all(head, F.lit("<(?:meta |title>)([^<>]*)"), F.lit(1))
    text = F.translate(F.array_join(parts, " "), ",=\"'().", "       ")
    return F.trim(F.regexp_replace(text, " +", " "))


def passes(c: Column, mode: int = 2, preserve_case: int = 0) -> Column:
    """Array of (pass, text) that phrases are searched in.

    mode: 0 raw, 1 tags stripped, 2 both, 3 meta and title only. preserve_case: 0 folded, 1 kept, 2 both.
    """
    if mode not in range(4) or preserve_case not in range(3):
        raise ValueError("mode must be 0 to 3 and preserve_case 0 to 2")
    cased = {0: [("folded", fold(c))], 1: [("kept", white_to_space(c))]}.get(preserve_case) or [("folded", fold(c)), ("kept", white_to_space(c))]
    out = []
    for name, text in cased:
        if mode in (0, 2):
            out.append((f"{name}_raw", text))
        if mode in (1, 2):
            out.append((f"{name}_smart", smart_strip(text)))
        if mode == 3:
            out.append((f"{name}_meta", meta_title(text)))
    return F.array(*[F.struct(F.lit(n).alias("pass"), t.alias("text")) for n, t in out])


def pass_names(mode: int = 2, preserve_case: int = 0) -> list[str]:
    """Names of the passes that `passes` gives."""
    kinds = {0: ["raw"], 1: ["smart"], 2: ["raw", "smart"], 3: ["meta"]}[mode]
    return [f"{name}_{kind}" for name in {0: ["folded"], 1: ["kept"], 2: ["folded", "kept"]}[preserve_case] for kind in kinds]


def after(c: Column, mark: str) -> Column:
    """What follows the first mark; "" where it is missing."""
    at = F.locate(mark, c)
    return F.when(at > 0, F.substring(c, at + len(mark), F.length(c))).otherwise(F.when(c.isNotNull(), F.lit("")))


def before(c: Column, mark: str) -> Column:
    """What stands before the first mark; "" where it is missing."""
    return F.when(F.locate(mark, c) > 0, F.substring_index(c, mark, 1)).otherwise(F.when(c.isNotNull(), F.lit("")))


def remove_white_space(c: Column) -> Column:
    """Without space, tab, CR and LF at both ends; a text of nothing else stays as it is."""
    t = F.btrim(c, F.lit(" \t\r\n"))
    return F.when(t == "", c).otherwise(t)


def collapse(c: Column, char: str) -> Column:
    """Runs of a character to one."""
    e = "\\" + char if not char.isalnum() and char != " " else char
    return F.regexp_replace(c, f"{e}+", F.lit(char.replace("\\", "\\\\").replace("$", "\\$")))


def chop(c: Column) -> Column:
    return F.left(c, F.greatest(F.length(c) - 1, F.lit(0)))


def lop(c: Column) -> Column:
    return F.substring(c, 2, 1 << 30)


def to_int(c: Column) -> Column:
    """Leading integer as C reads it; 0 where there is none or it doesn't fit."""
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.when(c.isNotNull(), F.lit(0)))


def hex_to_int(c: Column) -> Column:
    """Value of a hexadecimal text, null if it isn't one of at most 15 digits."""
    return F.when(c.rlike("^[0-9A-Fa-f]{1,15}$"), F.conv(c, 16, 10).cast("long"))


def md5_upper(*parts: Column) -> Column:
    return F.upper(F.md5(F.concat(*parts)))


def percent_decode(c: Column) -> Column:
    """%XX decoded as UTF-8; bad sequences are kept, "+" stands for itself.

    A text is decoded as a whole by the built-in function after marks that aren't of the form %XX are
    protected; where the bytes aren't UTF-8 they come out as replacement characters.
    """
    safe = F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(F.replace(safe, F.lit("+"), F.lit("%2B"))), c)


def safe_decode(c: Column) -> Column:
    """Decodes only %XX of letters, digits and the hyphen, in one pass: what is decoded is never decoded again.

    The text is cut at "%"; each part after the first begins with the two digits, if they are any.
    """
    parts = F.split(c, "%")
    plain = "(?i)^(?:3[0-9]|4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A]|2D)"
    one = lambda x: F.when(x.rlike(plain), F.concat(F.char(F.conv(F.left(x, F.lit(2)), 16, 10).cast("long")), F.substring(x, 3, 1 << 30))).otherwise(F.concat(F.lit("%"), x))
    tail = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one)
    return F.when(c.contains("%"), F.concat(F.get(parts, F.lit(0)), F.array_join(tail, ""))).otherwise(c)


def mini_url_encode(c: Column) -> Column:
    """Every byte but letters and digits as %xx in lower case."""
    chars = F.split(c, "")
    one = lambda x: F.when(x.rlike("^[A-Za-z0-9]*$"), x).otherwise(F.lower(F.regexp_replace(F.hex(F.encode(x, "UTF-8")), "(..)", "%$1")))
    return F.when(c.rlike("^[A-Za-z0-9]*$"), c).otherwise(F.array_join(F.transform(chars, one), ""))


def display_url(c: Column) -> Column:
    """41 or more characters: the first 40 and an ellipsis."""
    return F.when(F.length(c) > 40, F.concat(F.left(c, F.lit(40)), F.lit("..."))).otherwise(c)


def byte_size(c: Column) -> Column:
    """Bytes as text: plain below 1 KiB, else with one decimal in KiB or MiB, halves rounded up."""
    n = c.cast("long")

    def scaled(unit: int, name: str) -> Column:
        tenths = F.floor((n * 20 + unit) / (2 * unit))
        return F.format_string(f"%d.%d {name}", F.floor(tenths / 10), tenths % 10)

    return F.when(n < 1024, F.format_string("%d bytes", n)).when(n < 1048576, scaled(1024, "KiB")).otherwise(scaled(1048576, "MiB"))


def duration(seconds: Column) -> Column:
    """H:MM:SS of whole seconds."""
    s = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def overlapping_count(text: Column, phrase: str) -> Column:
    """Occurrences of a phrase, overlapping ones too; 0 for an empty phrase."""
    if not phrase:
        return F.lit(0)
    if any(phrase.startswith(phrase[k:]) for k in range(1, len(phrase))):
        quoted = "(?=\\Q" + phrase.replace("\\E", "\\E\\\\E\\Q") + "\\E)"
        n = F.regexp_count(text, F.lit(quoted))
    else:  # no end of it is its beginning, so occurrences can't overlap, and leaving them out counts them
        n = ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")
    return F.when(text.contains(phrase), n).otherwise(F.when(text.isNotNull(), F.lit(0)))


def java_replacement(replacement: str) -> str:
    r"""A list's replacement (\1 to \9, $1 to $9, \\, \$) as the JVM's."""
    out, i = [], 0
    while i < len(replacement):
        c, d = replacement[i], replacement[i + 1 : i + 2]
        if c in "\\$" and d.isdigit() and d.isascii() and d != "0":
            out.append(f"${d}")
            # a digit after the group number would be read as part of it
            if replacement[i + 2 : i + 3].isdigit():
                out.append("\\")
            i += 2
        elif c == "\\" and d in ("\\", "$"):
            out.append("\\" + d)
            i += 2
        else:
            out.append("\\" + c if c in "\\$" else c)
            i += 1
    return "".join(out)


def rewrite(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered replacements, each on what the one before it left; case is ignored, "." matches line ends.

    Patterns stay literals, so each is compiled once. A pattern that matches nothing leaves the text as is.
    """
    for pattern, replacement in rules:
        c = F.regexp_replace(c, F.lit("(?is)" + java_pattern(pattern)), F.lit(java_replacement(replacement)))
    return c


_POSIX = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "punct": "Punct", "space": "Space", "xdigit": "XDigit"}


def java_pattern(pattern: str) -> str:
    """A list's pattern as the JVM's: POSIX classes such as [[:alpha:]] are put in its words."""
    for posix, java in _POSIX.items():
        pattern = pattern.replace(f"[:{posix}:]", f"\\p{{{java}}}")
    return pattern
