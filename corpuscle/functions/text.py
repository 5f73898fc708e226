"""Column functions on text. All are built-in expressions; null texts count as empty unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed

#: ASCII punctuation, as a character class.
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _split(text: Column, pattern: str) -> Column:
    return F.array_remove(F.split(text, pattern), "")


def tokens(text: Column) -> Column:
    """lower case, ASCII punctuation to spaces, split at white space."""
    return _split(F.regexp_replace(F.lower(text_of(text)), PUNCTUATION, " "), r"(?U)\s+")


def counted(words: Column) -> Column:
    """The different words of an array with their counts, sorted: an array of (token, c). Texts need not be taken apart for it."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda k: (k == 1) | (F.get(s, k - 1) != F.get(s, k - 2)))
        ends = lambda at: F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(s) + 1))
        return F.get(F.transform(F.array(starts), lambda at: F.zip_with(at, ends(at), lambda a, b: F.struct(F.get(s, a - 1).alias("token"), (b - a).cast("long").alias("c")))), F.lit(0))

    return F.when(F.size(words) > 0, F.get(F.transform(F.array(F.sort_array(words)), runs), F.lit(0)))


def grams(words: Column, n: int) -> Column:
    """The n-grams of an array of words, joined by spaces: an array."""
    m = F.size(words) - (n - 1)
    out = F.slice(words, F.lit(1), F.greatest(m, F.lit(0)))
    for k in range(1, n):
        out = F.zip_with(out, F.slice(words, F.lit(k + 1), F.greatest(m, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return out


def ascii_words(text: Column) -> Column:
    """Runs of ASCII letters and apostrophes."""
    return F.regexp_extract_all(text_of(text), F.lit("([A-Za-z']+)"), 1)


def space_words(text: Column) -> Column:
    """What stands between white space."""
    return _split(text_of(text), r"(?U)\s+")


def word_count(text: Column) -> Column:
    """F16: white-space words."""
    return F.size(space_words(text)).cast("long")


def strip(text: Column) -> Column:
    """Without white space (of any kind) at either end."""
    return F.regexp_replace(text_of(text), r"(?U)^\s+|\s+$", "")


def blank(text: Column) -> Column:
    """Without any character that is not white space."""
    return ~text_of(text).rlike(r"(?U)\S")


def passage(text: Column) -> Column:
    """a text as an encoder wants it."""
    return F.concat(F.lit(fixed.PASSAGE), text_of(text))


def sentences(text: Column) -> Column:
    """split after a full stop, exclamation or question mark that white space follows."""
    return _split(strip(text), r"(?<=[.!?])(?U:\s+)")


def opener(text: Column, label: str) -> Column:
    """whether a pattern of the label occurs in the first characters."""
    joined = "|".join(fixed.OPENERS[label])
    return F.substring(text_of(text), 1, fixed.OPENER_LENGTH).rlike(f"(?iu)(?:{joined})")


def opener_hedges(text: Column) -> Column:
    """number of hedges among the first characters' words."""
    words = F.regexp_extract_all(F.lower(F.substring(text_of(text), 1, fixed.OPENER_LENGTH)), F.lit("([A-Za-z']+)"), 1)
    return F.size(F.filter(words, lambda w: w.isin(fixed.OPENER_HEDGES))).cast("long")


def fences(text: Column) -> Column:
    return F.regexp_extract_all(text_of(text), F.lit(f"({fixed.CODE_FENCE})"), 1)


def fence_share(text: Column) -> Column:
    """characters inside code fences over all, to 4 places."""
    inside = F.aggregate(fences(text), F.lit(0), lambda a, x: a + F.char_length(x))
    return F.round(inside / F.greatest(F.char_length(text_of(text)), F.lit(1)), 4)


def has_html(text: Column) -> Column:
    return text_of(text).rlike(fixed.HTML_TAG)


def without_fences(text: Column) -> Column:
    """each code fence as a placeholder."""
    return F.regexp_replace(text_of(text), fixed.CODE_FENCE, "[CODE_BLOCK]")


def truncated(text: Column) -> Column:
    """empty, or long and without a terminal mark."""
    bare = F.regexp_replace(text_of(text), r"(?U)\s+$", "")
    least = fixed.MAX_TOKENS / fixed.TOKENS_PER_WORD * fixed.TRUNCATION_SHARE
    return (bare == "") | (~bare.rlike(fixed.TERMINAL) & (F.size(ascii_words(bare)) >= least))


def normalised(text: Column) -> Column:
    """F13 without entities: CRLF to LF, three and more line ends to two, stripped. Entities: see `unescape`."""
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(text_of(text), "\r\n", "\n"), "\r", "\n"), "\n{3,}", "\n\n"))


@F.pandas_udf(T.StringType())
def unescape(text):
    """HTML character references decoded; the table of names has no built-in equivalent."""
    import html

    return text.map(lambda t: html.unescape(t) if t and "&" in t else t)


def normalised_post(text: Column) -> Column:
    """character references decoded, then `normalised`."""
    return normalised(unescape(text_of(text)))


def pseudonym(name: Column, salt: str) -> Column:
    """16 hex digits of SHA-256 over salt, NUL and name."""
    return F.substring(F.sha2(F.concat(F.lit(salt), F.char(F.lit(0)), name).cast("binary"), 256), 1, 16)


def content_hash(text: Column, prefix: int | None = None) -> Column:
    """SHA-256 of the text, or of its first characters."""
    return F.sha2((text if prefix is None else F.substring(text, 1, prefix)).cast("binary"), 256)


def discourse_features() -> dict[str, tuple[str, str]]:
    """feature to (category, pattern)."""
    words = lambda w: r"(?iu)\b" + r"\s+".join(w.split()) + r"\b"
    return (
        {k: ("punctuation", v) for k, v in fixed.PUNCTUATION.items()}
        | {w: ("discourse_markers", words(w)) for w in fixed.MARKERS}
        | {w: ("hedges", words(w)) for w in fixed.HEDGES}
    )


def draw(*parts: Column | str) -> Column:
    """A number in 0 to 2^32 - 1 from md5 of the parts: the same in any engine, whatever the partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)).cast("binary")), 1, 8), 16, 10).cast("long")
