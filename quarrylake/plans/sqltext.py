"""DuckDB expressions that say what functions/text.py says, for the SQL of queries."""

from __future__ import annotations

from ..functions import text as T


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(items: list[str]) -> str:
    return ", ".join(lit(x) for x in items)


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def every(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), {lit(pattern)}, {group})"


def scopes(x: str) -> str:
    return f"list_filter(list_transform({every(x, T.SITE, 1)}, lambda s: regexp_replace(lower(regexp_extract(s, '^[^?]*')), '\\.+$', '')), lambda s: s <> '')"


def without_sites(x: str) -> str:
    return squeeze(f"regexp_replace({x}, {lit(T.SITE)}, ' ', 'g')")


def _token(r: str) -> str:
    t = f"regexp_replace(regexp_replace({r}, '^[-_]+|[-_]+$', '', 'g'), '\\.+$', '')"
    t = f"CASE WHEN starts_with({t}, '.') AND NOT regexp_matches({t}, '^\\.[A-Za-z][A-Za-z0-9]*$') THEN regexp_replace({t}, '^\\.+', '') ELSE {t} END"
    return f"CASE WHEN regexp_matches({t}, '[\\p{{L}}\\p{{N}}]') THEN lower({t}) ELSE '' END"


def tokens(x: str) -> str:
    """Distinct tokens, in any order."""
    pieces = f"CASE WHEN length(r) >= 2 AND regexp_matches(r, {lit(f'^[{T.CJK}]+$')}) THEN list_concat([r], list_transform(range(1, length(r)), lambda i: substr(r, i, 2))) ELSE [{_token('r')}] END"
    found = f"list_filter(flatten(list_transform({every(without_sites(x), T.RUN)}, lambda r: {pieces})), lambda t: t <> '')"
    hosts = f"list_transform({scopes(x)}, lambda s: regexp_extract(s, '^[^/]*'))"
    return f"list_distinct(list_concat({found}, {hosts}))"


def terms(x: str) -> str:
    return f"list_filter({tokens(x)}, lambda t: length(t) > 2 OR regexp_matches(t, '[+#.]|[^\\x00-\\x7F]'))"


def quoted(x: str) -> str:
    return f"list_distinct(list_filter(list_transform(list_zip({every(x, T.QUOTED, 1)}, {every(x, T.QUOTED, 2)}), lambda p: {squeeze('CASE WHEN p[1] <> chr(0) AND p[1] <> ' + lit('') + ' THEN p[1] ELSE p[2] END')}), lambda p: p <> ''))"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0 END"


def title_words(x: str) -> str:
    return f"list_distinct(list_transform({every(x, T.TITLE_WORD)}, lambda w: lower(w)))"


def syndication(x: str) -> str:
    return f"list_sort({terms(f'regexp_replace(lower({x}), {lit(T.SYNDICATION)}, {lit(chr(32))}, {lit(chr(103))})')})"


def stem(t: str) -> str:
    cut = f"CASE WHEN length({t}) > 4 AND ends_with({t}, 'ies') THEN {t}[:-4] || 'y' WHEN length({t}) > 4 AND ends_with({t}, 'ing') THEN {t}[:-4] WHEN length({t}) > 4 AND ends_with({t}, 'ed') THEN {t}[:-3] WHEN length({t}) > 3 AND ends_with({t}, 's') AND NOT regexp_matches({t}, '(ss|us|is)$') THEN {t}[:-2] ELSE {t} END"
    return f"CASE WHEN length({cut}) > 3 AND ends_with({cut}, 'e') THEN left({cut}, -1) ELSE {cut} END".replace("[:-4]", "[1:-4]").replace("[:-3]", "[1:-3]").replace("[:-2]", "[1:-2]")


def story_words(x: str) -> str:
    return f"list_distinct(list_transform(list_filter(list_transform({every(x, T.TITLE_WORD)}, lambda w: lower(w)), lambda w: w NOT IN ({words(T.STORY_STOPWORDS)})), lambda t: {stem('t')}))"


def content_list(x: str) -> str:
    """Content words in order, repeats included."""
    low = f"list_transform({every(x, T.CONTENT_WORD)}, lambda w: regexp_replace(lower(w), '^[''\\-]+|[''\\-]+$', '', 'g'))"
    return f"list_filter({low}, lambda w: length(w) >= 3 AND w NOT IN ({words(T.STOPWORDS + T.GENERIC_TERMS)}) AND NOT regexp_matches(w, '^[0-9]+$'))"


def content_terms(x: str) -> str:
    return f"list_distinct({content_list(x)})"


def ordered(x: str) -> str:
    """Distinct elements of a short list, in their order."""
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def clean_markup(x: str) -> str:
    t = f"regexp_replace(coalesce({x}, ''), '(?s)```.*?```', chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    t = f"regexp_replace({t}, '!\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g')"
    t = f"regexp_replace({t}, '\\[([^\\]]+)\\]\\([^)]*\\)', '\\1', 'g')"
    lines = f"list_filter(string_split_regex({t}, '\\r\\n|\\n|\\r'), lambda x: NOT regexp_matches(x, '\\|.*\\|') AND NOT regexp_matches(x, {lit(T.SHELLISH)}))"
    prefix = lit(r"^\s{0,3}(?:#{1,6}\s+|[-*+]\s+|[0-9]+[.)]\s+|>\s*)")
    return f"array_to_string(list_transform({lines}, lambda x: regexp_replace(regexp_replace(regexp_replace(x, {prefix}, ''), '\\*\\*|__|`', '', 'g'), 'https?://\\S+', ' ', 'g')), chr(10))"


def sentences(x: str) -> str:
    parts = f"list_transform(string_split_regex(regexp_replace({clean_markup(x)}, '([.!?])\\s+', '\\1' || chr(1), 'g'), '[\\x01\\n]+'), lambda p: {squeeze('p')})"
    return f"list_filter({parts}, lambda p: len(string_split(p, ' ')) BETWEEN 6 AND 40 AND length(regexp_replace(p, '[^\\p{{L}}]', '', 'g')) >= length(p) * 0.6)"


def measurements(x: str) -> str:
    return f"list_filter({every(x, T.NUMBER)}, lambda n: NOT regexp_matches(n, '^(19|20)[0-9][0-9]$'))"


def negated(x: str) -> str:
    return f"list_has_any(list_transform(regexp_extract_all({x}, '[A-Za-z'']+'), lambda w: regexp_replace(lower(w), '^''+|''+$', '', 'g')), [{words(T.NEGATIONS)}])"


def flags(x: str) -> str:
    by: dict[str, list[str]] = {}
    for name, pattern in T.INJECTION:
        by.setdefault(name, []).append(f"regexp_matches({x}, {lit('(?i)' + pattern)})")
    cases = [f"CASE WHEN regexp_matches({x}, {lit(T.INVISIBLE)}) THEN 'invisible_characters' END"] + [f"CASE WHEN {' OR '.join(hits)} THEN 'prompt_injection:{name}' END" for name, hits in by.items()]
    return f"list_sort(list_filter([{', '.join(cases)}], lambda f: f IS NOT NULL))"
