"""Text expressions: tokens, lengths, control characters, boilerplate, HTML."""

from __future__ import annotations

import html.entities
import json
import operator
import sys
import unicodedata
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python's str.split() and regex \s take for whitespace: the Unicode White_Space
# property plus the four separators U+001C to U+001F.
_SPACE = r"[\s\x1c-\x1f]"
_NOT_SPACE = r"[^\s\x1c-\x1f]"

# The boilerplate tokens of known publishers.
BOILERPLATE_TOKENS = (
    "(Reuters)",
    "copyright Reuters",
    "Reuters Image",
    "REUTERS/",
    "Vox",
)

# The line-breaking control characters that cleaning deletes.
CONTROL_CHARACTERS = "\r\n\t"

# What is dropped from a page, each in one pass that never looks at a character twice.
# A comment, script or style that is never closed runs to the end, as in a browser.
_HTML_HIDDEN = r"(?is)<(?:!--(?:.*?-->|.*)|script[\s/>](?:.*?</script\s*>|.*)|style[\s/>](?:.*?</style\s*>|.*))"
# Between two ends of such an element, all from its first start goes. Without an end only
# the tag goes: the page is cut at the ends first, so no start is searched for an end.
_HTML_ELEMENTS = ("head", "nav")
# A tag begins with a letter, '/', '!' or '?'; a quoted value after '=' may hold any '>'.
# Any other '<' is text. Possessive loops neither backtrack nor recurse.
_HTML_TAG = r"""<[a-zA-Z/!?](?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>"""

# Character references: the names of the HTML standard, as Python's library lists them. Some
# may stand without a semicolon. Numbers 128 to 159 mean Windows-1252, as in browsers.
_NAMED = {name.rstrip(";"): char for name, char in html.entities.html5.items()}
_BARE = sorted((name for name in html.entities.html5 if not name.endswith(";")), key=len, reverse=True)
_WINDOWS = {n: bytes([n]).decode("cp1252", "replace") for n in range(128, 160)}
_REFERENCE = r"(?s)^(?:#(\d+);?|#[xX]([0-9a-fA-F]+);?|(?:([A-Za-z][A-Za-z0-9]*);|(" + "|".join(_BARE) + r")))(.*)$"

# Elements that begin and end a block of text.
_BLOCKS = (
    "address", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "article", "section", "ol", "p", "pre",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
# Elements whose text is never the article's.
_ASIDE = ("head", "nav", "footer", "aside", "form", "button", "select", "noscript")
# Characters that stand for the ends of blocks and of links while a page is cut up.
_BLOCK, _LINK, _LINK_END = "\x01", "\x02", "\x03"
_REST_OF_TAG = _HTML_TAG.removeprefix("<[a-zA-Z/!?]")
# A block counts in words: every word of a link takes so many off, the count stays between two
# bounds, and the block and its neighbours (once each, itself twice) must be above four times the least.
_LINK_COST, _FEWEST_WORDS, _MOST_WORDS, _LEAST_WORDS = 3, -10, 30, 12


# The ranges of ideographs that are words of their own.
_IDEOGRAPHS = (
    (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F),
    (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F),
)
_APART = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in _IDEOGRAPHS) + r"!-/:-@\[-`{-~\p{P}]"
# Control and format characters, NUL and the replacement character; tabs and line ends stay.
_UNSEEN = r"[\x{FFFD}\p{Cc}\p{Cf}&&[^\t\n\r]]"
# The same of plain ASCII.
_NOT_ASCII, _UNSEEN_ASCII, _APART_ASCII = r"[^\x00-\x7f]", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", r"[!-/:-@\[-`{-~]"
_GAP, _NO_GAP = r"[ \t\n\r]", r"[^ \t\n\r]"
_HANGUL = ("가", "힣")
# The consonants and vowels that a Hangul syllable is made of, in the order of its number.
_JAMO = tuple("".join(map(chr, range(a, b + 1))) for a, b in ((0x1100, 0x1112), (0x1161, 0x1175), (0x11A8, 0x11C2)))


def _bare_letters() -> dict[str, str]:
    """What is left of each character that Unicode decomposes once its marks are dropped; Hangul apart."""
    def bare(char: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")

    chars = (chr(k) for k in range(0x80, sys.maxunicode + 1) if unicodedata.decomposition(chr(k)))
    return {c: bare(c) for c in chars if bare(c) != c and not _HANGUL[0] <= c <= _HANGUL[1]}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_control(text: Column | str) -> Column:
    """Delete CR, LF and TAB; the words on either side join up.

    Three byte searches: less than half the time of ``translate``, which looks at
    every character.
    """
    return reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), CONTROL_CHARACTERS, _col(text))


def strip_boilerplate(
    text: Column | str, mode: str = "literal", tokens: Sequence[str] = BOILERPLATE_TOKENS
) -> Column:
    """Delete boilerplate tokens together with the whitespace character on either side.

    ``literal`` gives the published corpora: one pass per listed token, each deleting
    the *word* "token" (matches share spaces, so the number of passes shows).
    ``listed`` deletes the listed tokens themselves, in order.
    """
    if mode == "literal":
        words = ["token"] * len(tokens)
    elif mode == "listed":
        words = list(tokens)
    else:
        raise ValueError(f"mode must be 'literal' or 'listed', not {mode!r}")
    source = _col(text)
    if not words:
        return source
    quoted = [word.replace(r"\E", r"\E\\E\Q") for word in words]
    patterns = [rf"(?U){_SPACE}\Q{word}\E{_SPACE}" for word in quoted]
    stripped = reduce(lambda c, p: F.regexp_replace(c, F.lit(p), F.lit("")), patterns, source)
    # The first deletion needs one of the words in the raw text; a byte search for them
    # spares most texts the regex passes.
    present = reduce(operator.or_, [F.contains(source, F.lit(w)) for w in dict.fromkeys(words)])
    return F.when(present, stripped).otherwise(source)


def clean(text: Column | str, mode: str = "literal", tokens: Sequence[str] = BOILERPLATE_TOKENS) -> Column:
    """Boilerplate first, control characters second: a newline may flank a token."""
    return strip_control(strip_boilerplate(text, mode, tokens))


def space_pieces(text: Column | str) -> Column:
    """Number of pieces between single spaces, empty ones included (no array is built).

    Deleting control characters never changes it, so raw text serves as well.
    """
    c = _col(text)
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit(""))) + 1


def has_min_words(text: Column | str, words: int = 50) -> Column:
    return space_pieces(text) >= words


def has_min_chars(text: Column | str, chars: int = 1000) -> Column:
    return F.length(_col(text)) >= chars


def split_words(text: Column | str) -> Column:
    """Lower-cased whitespace pieces; one at either end may be empty."""
    return F.split(F.lower(_col(text)), rf"(?U){_SPACE}+")


def tokens(text: Column | str) -> Column:
    """Lower-cased whitespace tokens, empty pieces dropped."""
    return F.array_remove(split_words(text), "")


def lead_text(text: Column | str, n: int) -> Column:
    """The first ``n`` tokens as they stand, from the first one's start to the last one's
    end; '' where there is none. Possessive quantifiers rule out backtracking."""
    if n <= 0:
        return F.lit("")
    return F.regexp_extract(
        _col(text), rf"(?U)^{_SPACE}*+({_NOT_SPACE}++(?:{_SPACE}++{_NOT_SPACE}++){{0,{n - 1}}}+)", 1
    )


def first_tokens(text: Column | str, n: int) -> Column:
    """The first ``n`` tokens; equal to slicing ``tokens(text)`` but the regex stops there."""
    lead = lead_text(text, n)
    return F.when(lead == "", F.array().cast("array<string>")).otherwise(split_words(lead))


def token_count(text: Column | str, at_most: int) -> Column:
    """Size of ``first_tokens(text, at_most)``."""
    lead = lead_text(text, at_most)
    return F.when(lead == "", 0).otherwise(F.size(F.split(lead, rf"(?U){_SPACE}+")))


def strip_accents(text: Column | str) -> Column:
    """Characters decomposed and nonspacing marks dropped. Text of plain ASCII is left as it is."""
    bare = _bare_letters()
    single = [c for c, left in bare.items() if len(left) == 1]
    gone = [c for c, left in bare.items() if not left]
    longer = {c: left for c, left in bare.items() if len(left) > 1}

    def letters(char: Column) -> Column:
        number = F.ascii(char) - ord(_HANGUL[0])
        first, second, last = (F.floor(number / 588), F.floor(F.pmod(number, F.lit(588)) / 28), F.pmod(number, F.lit(28)))
        taken = [F.substr(F.lit(jamo), (at + 1).cast("int"), F.lit(1)) for jamo, at in zip(_JAMO, (first, second, last - 1), strict=True)]
        parts = F.concat(taken[0], taken[1], F.when(last > 0, taken[2]).otherwise(""))
        return F.when(char.between(*_HANGUL), parts).otherwise(char)

    def several(out: Column) -> Column:
        spelt = reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), longer.items(), out)
        return F.when(out.rlike("[" + "".join(longer) + "]"), spelt).otherwise(out)

    def syllables(out: Column) -> Column:
        spelt = F.array_join(F.transform(F.split(out, ""), letters), "")
        return F.when(out.rlike(f"[{_HANGUL[0]}-{_HANGUL[1]}]"), spelt).otherwise(out)

    def stripped(source: Column) -> Column:
        # What has nothing left stands last, without a counterpart: such characters are deleted.
        out = F.translate(source, "".join(single + gone), "".join(bare[c] for c in single))
        out = _let(_let(out, several), syllables)
        return F.when(source.rlike(_NOT_ASCII), F.regexp_replace(out, r"\p{Mn}+", "")).otherwise(source)

    return _let(_col(text), stripped)


def basic_words(text: Column | str) -> Column:
    """Text in which the basic tokens stand between spaces: control characters deleted, lower case,
    without accents, every punctuation character and ideograph a word of its own.

    Text of plain ASCII, most of many a corpus, needs no look-up in Unicode's tables.
    """
    def plain(source: Column) -> Column:
        return F.regexp_replace(F.lower(F.regexp_replace(source, _UNSEEN_ASCII, "")), f"({_APART_ASCII})", " $1 ")

    def any_text(source: Column) -> Column:
        seen = F.regexp_replace(source, _UNSEEN, "")
        return F.regexp_replace(strip_accents(F.lower(seen)), rf"({_APART})", " $1 ")

    return _let(_col(text), lambda source: F.when(source.rlike(_NOT_ASCII), any_text(source)).otherwise(plain(source)))


def basic_tokens(text: Column | str) -> Column:
    """The tokens that word pieces are cut from: ``tokens`` of ``basic_words``."""
    return F.array_remove(F.split(basic_words(text), rf"(?U){_SPACE}+"), "")


def gap_words(text: Column | str) -> Column:
    """Words between spaces, tabs and line ends, which no step to ``basic_tokens`` changes: the basic
    tokens of a text are those of its words, one after the other."""
    return F.split(_col(text), f"{_GAP}+")


def first_basic_tokens(text: Column | str, n: int) -> Column:
    """The first ``n`` of ``basic_tokens``.

    A word has one token at least, unless all its characters go. So the first ``n`` words are looked at
    first, cut at spaces, tabs and line ends, which no step changes; the rest only where they are too few.
    """
    if n <= 0:
        return F.slice(basic_tokens(text), F.lit(1), F.lit(0))
    lead = F.regexp_extract(_col(text), rf"^{_GAP}*+({_NO_GAP}++(?:{_GAP}++{_NO_GAP}++){{0,{n - 1}}}+)", 1)
    return _let(
        basic_tokens(lead),
        lambda found: F.slice(F.when(F.size(found) >= n, found).otherwise(basic_tokens(text)), F.lit(1), F.lit(n)),
    )


def squeeze_spaces(text: Column | str) -> Column:
    """Runs of whitespace become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(_col(text), rf"(?U){_SPACE}+", " "))


def decode_or_empty(raw: Column | str) -> Column:
    """Text of a whole-file scan; '' where the bytes are not UTF-8."""
    return F.coalesce(F.try_validate_utf8(_col(raw)), F.lit(""))


def universal_newlines(text: Column | str) -> Column:
    """CR LF and CR as LF, as text files are read."""
    lf = F.lit("\n")
    return F.replace(F.replace(_col(text), F.lit("\r\n"), lf), F.lit("\r"), lf)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without_element(page: Column, name: str) -> Column:
    """Drop ``<name ...> ... </name>``, from the first start since the last end."""
    def bare(parts: Column) -> Column:
        ended = F.slice(parts, F.lit(1), F.size(parts) - 1)
        cut = F.transform(ended, lambda part: F.regexp_replace(part, rf"(?is)<{name}[\s/>].*", ""))
        return F.array_join(F.concat(cut, F.slice(parts, F.size(parts), F.lit(1))), " ")

    return _let(F.split(page, rf"(?i)</{name}\s*>"), bare)


def _code_point(code: Column) -> Column:
    """The character of a number; U+FFFD where there is none. Null and overlong numbers too."""
    wrong = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    known = F.element_at(F.from_json(F.lit(json.dumps(_WINDOWS)), "map<string,string>"), code.cast("string"))
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(wrong | code.isNull(), "\ufffd").otherwise(F.coalesce(known, plain))


def _reference(piece: Column) -> Column:
    """A piece of text that came after an ``&``, with the reference it begins with decoded."""
    def decoded(parts: Column) -> Column:
        decimal, hexadecimal, name, rest = (F.element_at(parts, k) for k in (2, 3, 4, 5))
        number = F.when(decimal != "", decimal.try_cast("bigint")).otherwise(
            F.when(F.length(hexadecimal) <= 15, F.conv(hexadecimal, 16, 10).cast("bigint")))
        named = F.element_at(F.from_json(F.lit(json.dumps(_NAMED)), "map<string,string>"), name)
        char = F.when((decimal != "") | (hexadecimal != ""), _let(number, _code_point)).when(name != "", named)
        return F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), piece))

    # All groups by one match, set apart by a character that no group but the rest can hold.
    cut = F.split(F.regexp_replace(piece, _REFERENCE, "\x00$1\x00$2\x00$3$4\x00$5"), "\x00", 5)
    found = _let(cut, lambda parts: F.when(F.element_at(parts, 1) == "", decoded(parts)).otherwise(F.concat(F.lit("&"), piece)))
    return F.when(piece.rlike("^(?:#[0-9xX]|[A-Za-z])"), found).otherwise(F.concat(F.lit("&"), piece))


def decode_references(text: Column | str) -> Column:
    """Named and numeric character references as characters, each once; unknown ones stay."""
    def joined(pieces: Column) -> Column:
        return F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), _reference), ""))

    return F.when(F.contains(_col(text), F.lit("&")), _let(F.split(_col(text), "&"), joined)).otherwise(_col(text))


def html_text(html: Column | str) -> Column:
    """Visible text of a page: head, scripts, styles, navigation, comments and tags go."""
    shown = F.regexp_replace(_col(html), _HTML_HIDDEN, " ")
    shown = reduce(_without_element, _HTML_ELEMENTS, shown)
    return squeeze_spaces(decode_references(F.regexp_replace(shown, _HTML_TAG, " ")))


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"(?U){_NOT_SPACE}++"))


def _block(marked: Column) -> Column:
    """Text of a block and its words, those of links taken off."""
    links = F.aggregate(
        F.slice(F.split(marked, _LINK), F.lit(2), F.size(F.split(marked, _LINK))), F.lit(0),
        lambda acc, part: acc + _words(F.substring_index(part, _LINK_END, 1)))
    plain = F.translate(marked, _LINK + _LINK_END, "  ")
    own = F.when(F.contains(marked, F.lit(_LINK)), _words(plain) - _LINK_COST * links).otherwise(_words(plain))
    return F.struct(squeeze_spaces(plain).alias("text"), F.greatest(F.least(own, F.lit(_MOST_WORDS)), F.lit(_FEWEST_WORDS)).alias("own"))


def _region(blocks: Column) -> Column:
    """First and last place (from 1) of the blocks with the highest sum; 0, 0 if none is positive."""
    def next_(acc: Column, value: Column) -> Column:
        fresh = acc["sum"] <= 0
        begin = F.when(fresh, acc["at"] + 1).otherwise(acc["begin"])
        total = F.when(fresh, value).otherwise(acc["sum"] + value)
        better = total > acc["most"]
        return F.struct(
            (acc["at"] + 1).alias("at"), total.alias("sum"), begin.alias("begin"), F.greatest(total, acc["most"]).alias("most"),
            F.when(better, begin).otherwise(acc["first"]).alias("first"), F.when(better, acc["at"] + 1).otherwise(acc["last"]).alias("last"))

    value = F.transform(blocks, lambda block, k: (
        2 * block["own"] + F.coalesce(F.get(blocks, k - 1)["own"], F.lit(0)) + F.coalesce(F.get(blocks, k + 1)["own"], F.lit(0))
        - 4 * _LEAST_WORDS))
    start = F.struct(*[F.lit(0).alias(c) for c in ("at", "sum", "begin", "most", "first", "last")])
    return F.aggregate(value, start, next_)


def article_text(html: Column | str, between: str = " ") -> Column:
    """The article of a page: the contiguous blocks that are densest in words outside links.

    A page without head, navigation, footers, asides, forms, scripts and comments is cut at
    the tags of blocks. A block counts its words, less three for every word inside a link, from -10 to 30; with the
    counts of its neighbours smoothed in, what is above 12 words speaks for the article and what is
    below against it. The article is the run of blocks with the highest sum, of equal ones the first; a page
    without any has the text ''. Menus, teasers, short comments and notices between, before and
    after paragraphs drop out, whatever they are called. All steps are linear in the page.
    """
    # Such references would be taken for the marks below; a page shows nothing for them.
    shown = F.regexp_replace(F.translate(_col(html), _BLOCK + _LINK + _LINK_END, "   "), r"(?i)&#(?:0*[123](?![0-9])|x0*[123](?![0-9a-f]));?", " ")
    shown = reduce(_without_element, _ASIDE, F.regexp_replace(shown, _HTML_HIDDEN, " "))
    marked = F.regexp_replace(shown, rf"(?i)</?(?:{'|'.join(_BLOCKS)})(?=[\s/>]){_REST_OF_TAG}", _BLOCK)
    marked = F.regexp_replace(marked, rf"(?i)<a(?=[\s/>]){_REST_OF_TAG}", _LINK)
    marked = F.regexp_replace(marked, r"(?i)</a\s*+>", _LINK_END)
    marked = decode_references(F.regexp_replace(marked, _HTML_TAG, " "))
    blocks = F.filter(F.transform(F.split(marked, _BLOCK), _block), lambda block: block["text"] != "")

    def kept(blocks: Column) -> Column:
        return _let(_region(blocks), lambda region: F.array_join(
            F.transform(F.slice(blocks, F.greatest(region["first"], F.lit(1)), region["last"] - region["first"] + F.when(region["last"] > 0, 1).otherwise(0)),
                        lambda block: block["text"]), between))

    return _let(blocks, kept)
