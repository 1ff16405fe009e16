"""Text, array and struct column functions.

Everything here is a native Catalyst expression (regex, higher-order array
functions), so no row leaves the JVM.  Patterns avoid ``\\w``/``\\b`` because
their meaning differs between Java regex and RE2; Unicode classes are used
instead so the DuckDB oracle sees the same tokens.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lookup import sql_literal

# The default English stop-word list shipped with Spark ML
# (StopWordsRemover.loadDefaultStopWords("english")), in its natural order.
ENGLISH_STOP_WORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
her hers herself it its itself they them their theirs themselves what which who whom this that
these those am is are was were be been being have has had having do does did doing a an the and
but if or because as until while of at by for with about against between into through during
before after above below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor not only own same
so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd
you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've they've
isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't
shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's what's
when's where's who's why's would
""".split())

# Regex patterns shared by the Spark plans and the DuckDB oracle.
CODE_BLOCK_RE = r"(?is)<code[^>]*>(.*?)</code>"
COMMENT_RE = r"(?s)<!--.*?-->"
SCRIPT_STYLE_RE = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
TAG_RE = r"<[^>]*>"
EDGE_SPACE_RE = r"^\s+|\s+$"
# The white-space characters stripped from both ends (ASCII \s and the
# no-break space, which text nodes of markup often consist of).
WS_CHARS = " \t\n\r\x0b\x0c\xa0"
WORD_RE = r"[\p{L}\p{N}]+"
ALPHA_RE = r"^\p{L}+$"
TFIDF_TOKEN_RE = r"[\p{L}\p{N}_]{2,}"
MATH_RE = r"(?s)\$\$?([^$]+)\$\$?"
# A character reference: decimal, hexadecimal or named.
ENTITY_RE = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def named_entities() -> dict[str, dict[str, str]]:
    """The public HTML table of named references (from the standard library), by first letter."""
    from html.entities import html5

    out: dict[str, dict[str, str]] = {}
    for name, text in sorted(html5.items()):
        if name.endswith(";"):
            out.setdefault(name[0], {})[name[:-1]] = text
    return out


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _character(code) -> Column:
    """The character of a code point as text (null: no such character)."""
    ok = ((code >= 1) & (code <= 0x10FFFF)) & ~code.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def unescape_entities(col) -> Column:
    """Character references decoded: decimal, hexadecimal and all named ones.  Unknown names
    and impossible numbers stay as they are."""
    c = _c(col)
    table = F.expr("map(" + ", ".join(
        f"{sql_literal(k)}, map({', '.join(f'{sql_literal(n)}, {sql_literal(t)}' for n, t in names.items())})"
        for k, names in named_entities().items()) + ")")

    def decoded(ref):
        number = F.when(F.lower(F.substring(ref, 2, 1)) == "x", F.conv(F.substring(ref, 3, 6), 16, 10)).otherwise(F.substring(ref, 2, 7))
        named = F.try_element_at(F.try_element_at(table, F.substring(ref, 1, 1)), ref)
        text = F.when(F.substring(ref, 1, 1) == "#", _character(number.try_cast("long"))).otherwise(named)
        return F.when(ref.isNotNull(), F.coalesce(text, F.concat(F.lit("&"), ref, F.lit(";"))))

    pieces = F.arrays_zip(F.split(c, ENTITY_RE, -1), F.regexp_extract_all(c, F.lit(ENTITY_RE), F.lit(1)))
    joined = F.array_join(F.transform(pieces, lambda z: F.concat(z["0"], F.coalesce(decoded(z["1"]), F.lit("")))), "")
    return F.when(F.contains(c, F.lit("&")), joined).otherwise(c)


def strip_ws(col) -> Column:
    """Strip leading/trailing white space (``WS_CHARS``, not only blanks);
    a character-set trim, no regex scan over the text."""
    return F.btrim(_c(col), F.lit(WS_CHARS))


def text_nodes_joined(html) -> Column:
    """Text of markup: split on tags, strip every text node, drop empty ones,
    join with a single space (``get_text(separator=" ", strip=True)``)."""
    nodes = F.split(_c(html), TAG_RE, -1)
    nodes = F.transform(nodes, lambda x: strip_ws(unescape_entities(x)))
    return F.array_join(F.filter(nodes, lambda x: x != F.lit("")), " ")


def code_blocks(html) -> Column:
    """Contents of every ``<code>`` element (inner tags removed, entities decoded)."""
    blocks = F.regexp_extract_all(_c(html), F.lit(CODE_BLOCK_RE), 1)
    return F.transform(blocks, lambda b: unescape_entities(F.regexp_replace(b, TAG_RE, "")))


def prose_text(html) -> Column:
    """Visible text without code, comments, scripts and styles."""
    h = F.regexp_replace(_c(html), COMMENT_RE, " ")
    h = F.regexp_replace(h, SCRIPT_STYLE_RE, " ")
    h = F.regexp_replace(h, CODE_BLOCK_RE, " ")
    return text_nodes_joined(h)


# Markup read piece by piece: comments, scripts and styles, tags, text runs.
PIECE_RE = (r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<[a-z/!?][^>]*>"
            r"|[^<]+")
# A "<" that begins no markup is text.
STRAY_RE = r"<(?![a-zA-Z/!?])"


def split_nested(html) -> Column:
    """X1 for nested or unclosed markup: struct of visible text and code blocks.

    One fold over the pieces of the markup keeps the depth of open ``<code>`` elements:
    nested code belongs to the outermost block, an unclosed block ends with the page.
    """
    text, code = F.array().cast("array<string>"), F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("buf"), text.alias("text"), code.alias("code"))

    def step(s, p):
        tag = p.rlike("(?i)^<[a-z/!?]")
        opens, closes = p.rlike(r"(?i)^<code[\s/>]"), p.rlike(r"(?i)^</code[\s>]") & (s["depth"] > 0)
        data = unescape_entities(p)
        seen = strip_ws(data)
        return F.struct(
            F.when(opens, s["depth"] + 1).when(closes, s["depth"] - 1).otherwise(s["depth"]).alias("depth"),
            F.when(opens & (s["depth"] == 0), F.lit("")).when(~tag & (s["depth"] > 0), F.concat(s["buf"], data)).otherwise(s["buf"]).alias("buf"),
            F.when(~tag & (s["depth"] == 0) & (seen != ""), F.concat(s["text"], F.array(seen))).otherwise(s["text"]).alias("text"),
            F.when(closes & (s["depth"] == 1), F.concat(s["code"], F.array(s["buf"]))).otherwise(s["code"]).alias("code"))

    def finish(s):
        return F.struct(F.array_join(s["text"], " ").alias("text"),
                        F.when(s["depth"] > 0, F.concat(s["code"], F.array(s["buf"]))).otherwise(s["code"]).alias("code"))

    c = _c(html)
    return F.when(c.isNotNull(), F.aggregate(
        F.regexp_extract_all(F.regexp_replace(c, STRAY_RE, "&lt;"), F.lit(PIECE_RE), F.lit(0)), start, step, finish))


def split_tags(col) -> Column:
    """Strip one leading and one trailing ``|`` then split on ``|``."""
    return F.split(F.regexp_replace(_c(col), r"^[|]|[|]$", ""), "[|]", -1)


def clean_lower(col) -> Column:
    """Lower-case, strip, empty -> null."""
    s = strip_ws(F.lower(_c(col)))
    return F.when(s != F.lit(""), s)


def filter_tokens(text, stop_words: Iterable[str] = ENGLISH_STOP_WORDS,
                  remove_stops: bool = True) -> Column:
    """Word tokens; drop stop words, punctuation and 1-char non-letters.

    Duplicates are kept (no ``array_except``).  A text of only stop words gives
    ``""`` (still a document); null stays null.
    """
    toks = F.regexp_extract_all(_c(text), F.lit(WORD_RE), 0)
    if remove_stops:
        stops = list(stop_words)   # IN over many literals becomes a hashed InSet
        # cheap tests first: the letter-only regex runs for 1-character tokens only
        toks = F.filter(toks, lambda x: ~x.isin(stops)
                        & ((F.char_length(x) > 1) | x.rlike(ALPHA_RE)))
    return F.array_join(toks, " ")


def tfidf_tokens(text) -> Column:
    """F1: lower-case runs of >= 2 letters/digits/underscore."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TFIDF_TOKEN_RE), 0)


def with_bigrams(tokens) -> Column:
    """unigrams followed by space-joined bigrams (safe for 0/1-token arrays)."""
    t = _c(tokens)
    n = F.greatest(F.size(t) - 1, F.lit(0))
    left = F.slice(t, 1, n)
    right = F.slice(t, 2, n)
    bigrams = F.zip_with(left, right, lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(t, F.when(n > 0, bigrams).otherwise(F.array().cast("array<string>")))


def math_length(text) -> Column:
    """X15 (equation forums): total length of ``$…$`` / ``$$…$$`` contents."""
    parts = F.regexp_extract_all(_c(text), F.lit(MATH_RE), 1)
    return F.char_length(F.array_join(parts, ""))


def with_term_counts(df, col: str, out: str = "terms", keep=()):
    """Per-row term frequencies without a shuffle: sort the array and read run
    lengths.  Adds ``out`` = ``array<struct<term, tf>>`` sorted by term.

    Each intermediate array is its own projected column (Catalyst does not inline
    a non-trivial expression used more than once), and every lambda reads only its
    own arguments, so a row costs one sort plus linear passes.
    """
    base = [F.col(k) for k in keep]
    s1 = df.select(*base, F.sort_array(F.col(col)).alias("_s"))
    s2 = s1.select(*base, "_s", F.size("_s").alias("_n"),
                   F.slice(F.zip_with("_s", F.concat(F.array(F.lit(None).cast("string")), F.col("_s")),
                                      lambda a, b: b.isNull() | (a != b)), 1, F.size("_s")).alias("_f"))
    s3 = s2.select(*base, "_n",
                   F.filter(F.zip_with(F.sequence(F.lit(0), F.greatest(F.col("_n") - 1, F.lit(0))), "_f",
                                       lambda i, f: F.when(f, i)), lambda x: x.isNotNull()).alias("_st"),
                   F.filter(F.zip_with("_s", "_f", lambda t, f: F.when(f, t)),
                            lambda x: x.isNotNull()).alias("_u"))
    ends = F.concat(F.slice("_st", 2, F.greatest(F.size("_st") - 1, F.lit(0))), F.array(F.col("_n")))
    s4 = s3.select(*base, "_n", "_u", F.zip_with("_st", ends, lambda a, b: (b - a).cast("long")).alias("_tf"))
    pairs = F.zip_with("_u", "_tf", lambda t, c: F.struct(t.alias("term"), c.alias("tf")))
    return s4.select(*base, F.when(F.col("_n") > 0, pairs).otherwise(
        F.array().cast("array<struct<term:string,tf:bigint>>")).alias(out))
