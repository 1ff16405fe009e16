"""DuckDB spellings of the text expressions in ``functions.text`` (oracle side only).

The patterns and word lists are the same constants the Spark plans use.
"""

from __future__ import annotations

from ..functions import text as X


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOPS = "[" + ", ".join(lit(w) for w in X.ENGLISH_STOP_WORDS) + "]"


_NAMED = "MAP {" + ", ".join(f"{lit(n)}: {lit(t)}" for names in X.named_entities().values() for n, t in names.items()) + "}"
_CODE = "CASE WHEN lower(r[2]) = 'x' THEN TRY_CAST('0x' || substr(r, 3) AS BIGINT) ELSE TRY_CAST(substr(r, 2) AS BIGINT) END"
_DECODED = (f"coalesce(CASE WHEN r[1] = '#' THEN CASE WHEN ({_CODE}) BETWEEN 1 AND 1114111 AND NOT ({_CODE}) BETWEEN 55296 AND 57343 "
            f"THEN chr(CAST(({_CODE}) AS INTEGER)) END ELSE map_extract({_NAMED}, r)[1] END, '&' || r || ';')")


def unescape(e: str) -> str:
    gaps = f"regexp_split_to_array({e}, {lit(X.ENTITY_RE.replace('(#', '(?:#'))})"
    refs = f"list_append(list_transform(regexp_extract_all({e}, {lit(X.ENTITY_RE)}, 1), lambda r: {_DECODED}), '')"
    joined = f"array_to_string(list_transform(list_zip({gaps}, {refs}), lambda z: concat(z[1], z[2])), '')"
    return f"CASE WHEN contains({e}, '&') THEN {joined} ELSE {e} END"


WS = " || ".join(f"chr({ord(c)})" for c in X.WS_CHARS)


def strip_ws(e: str) -> str:
    return f"trim({e}, {WS})"


def text_nodes_joined(e: str) -> str:
    nodes = f"regexp_split_to_array({e}, {lit(X.TAG_RE)})"
    nodes = f"list_transform({nodes}, lambda x: {strip_ws(unescape('x'))})"
    return f"array_to_string(list_filter({nodes}, lambda x: x <> ''), ' ')"


def code_blocks(e: str) -> str:
    blocks = f"regexp_extract_all({e}, {lit(X.CODE_BLOCK_RE)}, 1)"
    inner = unescape(f"regexp_replace(b, {lit(X.TAG_RE)}, '', 'g')")
    return f"list_transform({blocks}, lambda b: {inner})"


def prose_text(e: str) -> str:
    h = f"regexp_replace({e}, {lit(X.COMMENT_RE)}, ' ', 'g')"
    h = f"regexp_replace({h}, {lit(X.SCRIPT_STYLE_RE)}, ' ', 'g')"
    h = f"regexp_replace({h}, {lit(X.CODE_BLOCK_RE)}, ' ', 'g')"
    return text_nodes_joined(h)


def split_tags(e: str) -> str:
    return f"string_split(regexp_replace({e}, '^[|]|[|]$', '', 'g'), '|')"


def clean_lower(e: str) -> str:
    s = strip_ws(f"lower({e})")
    return f"CASE WHEN {s} <> '' THEN {s} END"


def filter_tokens(e: str) -> str:
    toks = f"regexp_extract_all({e}, {lit(X.WORD_RE)}, 0)"
    keep = (f"lambda x: NOT list_contains({STOPS}, x) AND "
            f"(regexp_matches(x, {lit(X.ALPHA_RE)}) OR length(x) > 1)")
    return f"array_to_string(list_filter({toks}, {keep}), ' ')"


def tfidf_tokens(e: str) -> str:
    return f"regexp_extract_all(lower({e}), {lit(X.TFIDF_TOKEN_RE)}, 0)"


def lenient_date(e: str) -> str:
    return f"TRY_CAST(substr({e}, 1, 10) AS DATE)"


def lenient_timestamp(e: str) -> str:
    return f"TRY_CAST({e} AS TIMESTAMP)"
