"""Text normal forms, tokens, sentences and set measures as column expressions.

Everything stays inside the JVM. Patterns carry ``(?U)`` where Unicode classes
matter, because corpora are multilingual.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lists


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(values) -> Column:
    """A literal array of strings (one literal that the optimizer folds, however long the list)."""
    return F.split(F.lit("\n".join(values)), "\n", -1)


def any_of(text, phrases) -> Column:
    """True when any phrase occurs as a substring."""
    return col(text).rlike("|".join(quote(p) for p in phrases))


def quote(phrase: str) -> str:
    return "".join("\\" + ch if not (ch.isalnum() or ch.isspace()) else ch for ch in phrase)


def let(value: Column, body) -> Column:
    """``body`` with ``value`` computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# -- whitespace -----------------------------------------------------------------

#: The characters of ``(?U)\s``.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def squeeze(x) -> Column:
    return F.trim(F.regexp_replace(col(x), r"(?U)\s+", " "))


def strip(x) -> Column:
    return F.btrim(col(x), F.lit(WHITE))


def rstrip(x) -> Column:
    return F.rtrim(col(x), F.lit(WHITE))


def strip_chars(x, chars: str) -> Column:
    cls = "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in chars)
    return F.regexp_replace(col(x), f"^[{cls}]+|[{cls}]+$", "")


def is_blank(x) -> Column:
    return F.length(strip(x)) == 0


def shorten(x, limit: int) -> Column:
    """Whole when short enough, else cut so that text plus ``...`` fits ``limit``."""
    c = col(x)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(rstrip(F.substring(c, 1, limit - 3)), F.lit("...")))


def preview(x, limit: int = 160) -> Column:
    return shorten(squeeze(x), limit)


def excerpt(x, limit: int = 4000) -> Column:
    c = strip(x)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(rstrip(F.substring(c, 1, limit)), F.lit("...")))


def corpus_clean(x) -> Column:
    """Drop the ebook licence frame, unify line ends, squeeze blanks and blank lines."""
    c = col(x)
    opening = r"(?is)^.*?\*\*\*\s*START OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*?\*\*\*"
    closing = r"(?is)\*\*\*\s*END OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*?\*\*\*.*$"
    framed = F.when(
        c.contains("***"),
        F.regexp_replace(F.regexp_replace(c, opening, ""), closing, ""),
    ).otherwise(c)
    lines = F.when(c.contains("\r"), F.regexp_replace(framed, "\r\n?", "\n")).otherwise(framed)
    lines = F.replace(lines, F.lit("\x00"), F.lit(" "))
    return strip(F.regexp_replace(F.regexp_replace(lines, "[ \t]{2,}|\t", " "), "\n{3,}", "\n\n"))


# -- question and search normal forms ---------------------------------------------

def question_norm(x) -> Column:
    kept = F.regexp_replace(F.lower(col(x)), r"(?U)[^a-z0-9\s]", "")
    return squeeze(kept)


@lru_cache(maxsize=1)
def _compat_pairs() -> tuple[str, str]:
    """Characters whose compatibility form is one ASCII character, by the Unicode rule."""
    source, target = [], []
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        if 0xD800 <= code <= 0xDFFF or unicodedata.decomposition(ch) == "":
            continue
        form = unicodedata.normalize("NFKC", ch)
        if len(form) == 1 and ord(form) < 0x80 and (form.isalnum() or form in " ?<>|'"):
            source.append(ch)
            target.append(form)
    return "".join(source), "".join(target)


@lru_cache(maxsize=1)
def _compat_runs() -> dict[str, str]:
    """Characters whose compatibility form has several characters, of which one is ASCII, by the Unicode rule."""
    forms = ((chr(code), unicodedata.normalize("NFKC", chr(code))) for code in range(0x80, sys.maxunicode + 1)
             if not 0xD800 <= code <= 0xDFFF and unicodedata.decomposition(chr(code)))
    return {ch: form for ch, form in forms if len(form) > 1 and not form.isspace() and any(ord(x) < 0x80 for x in form)}


def _char_class(codes) -> str:
    """A pattern class of code points, consecutive ones merged to ranges."""
    ranges: list[list[int]] = []
    for code in sorted(codes):
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


#: Combining marks that may compose with an ASCII letter before them.
_MARKS = range(0x300, 0x370)
#: The letters of most Latin texts; what the rule leaves alone among them is told apart first.
_LATIN = range(0x250)


@lru_cache(maxsize=1)
def _composed() -> str:
    """A pattern of an ASCII letter and a mark that compose to another letter, by the Unicode rule."""
    letters: dict[str, str] = {}
    for mark in map(chr, _MARKS):
        for letter in map(chr, range(0x41, 0x7B)):
            if letter.isalpha() and len(unicodedata.normalize("NFC", letter + mark)) == 1:
                letters[mark] = letters.get(mark, "") + letter
    return f"(?=[A-Za-z][{_char_class(_MARKS)}])(?:" + "|".join(f"[{own}]{mark}" for mark, own in letters.items()) + ")"


@lru_cache(maxsize=1)
def _changing() -> str:
    """A pattern of the characters that the compatibility form may change.

    ASCII fails its first class, one range, and the unchanged Latin letters its second; all others are looked up in merged ranges.
    """
    codes = {ord(ch) for ch in (*_compat_pairs()[0], *_compat_runs())} | set(_MARKS)
    return f"[\\x{{80}}-\\x{{10FFFF}}&&[^{_char_class(set(_LATIN) - codes - set(range(0x80)))}]&&[{_char_class(codes)}]]"


def compat_form(x) -> Column:
    """Unicode compatibility form as far as ASCII characters go, without leaving the JVM.

    Characters that become ASCII are spelled out; an ASCII letter that composes with the
    mark behind it becomes a letter that isn't ASCII. Two tests per text find those that hold
    no such character, which is nearly all: whether it is ASCII as a whole, and one pattern.
    """
    c = col(x)
    forms = F.from_json(F.lit(json.dumps(_compat_runs())), "map<string,string>")
    held = f"[\\x{{80}}-\\x{{10FFFF}}&&[{_char_class(map(ord, _compat_runs()))}]]"
    spelled = F.when(c.rlike(held), F.array_join(F.transform(F.split(c, ""), lambda ch: F.when(
        ch.rlike(held), F.coalesce(F.try_element_at(forms, ch), ch)).otherwise(ch)), "")).otherwise(c)
    composed = F.regexp_replace(spelled, _composed(), "\u00e9")
    changed = F.when(c.rlike(_changing()), F.translate(composed, *_compat_pairs())).otherwise(c)
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(changed)


def search_norm(x) -> Column:
    """Lower-case letters, digits, blanks and apostrophes; a question mark counts as an apostrophe."""
    c = F.replace(F.replace(compat_form(x), F.lit("?"), F.lit("'")), F.lit("<channel|>"), F.lit(" "))
    return squeeze(F.regexp_replace(F.lower(c), r"(?U)[^a-z0-9\s']", " "))


def _bare_words(norm) -> Column:
    """Apostrophes at word edges and a closing ``'s`` removed, over the whole text at once."""
    edges = F.regexp_replace(col(norm), r"'(?:'*(?![^ ])|(?<![^ ]')'*)", "")
    return F.regexp_replace(edges, r"'s(?![^ ])", "")


def search_tokens(norm, stopwords=lists.SEARCH_STOPWORDS) -> Column:
    """Tokens in order, repeats kept, of a search normal form."""
    stop = words(stopwords)
    return F.filter(F.split(_bare_words(norm), " +"), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def search_token_set(norm, stopwords=lists.SEARCH_STOPWORDS) -> Column:
    return F.filter(F.array_except(F.split(_bare_words(norm), " +"), words(stopwords)), lambda t: F.length(t) > 1)


def support_terms(x, stopwords=lists.SUPPORT_STOPWORDS) -> Column:
    return F.filter(F.array_except(F.split(question_norm(x), " "), words(stopwords)), lambda t: F.length(t) > 1)


def word_set(norm) -> Column:
    """Distinct non-empty words of an already normalised text."""
    return F.array_except(F.split(col(norm), " "), words([""]))


# -- query shape --------------------------------------------------------------------

ENTITY = r"(?U)\b[A-Z][a-z']{2,}\b"


def canonical_word(x) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(x)), r"^'+|'+$", ""), r"'s$", "")


def entity_words(query) -> Column:
    """Capitalised words in order, repeats and spelling kept, stop words removed."""
    stop = words(lists.SEARCH_STOPWORDS)
    found = F.regexp_extract_all(col(query), F.lit(ENTITY), F.lit(0))
    return F.filter(found, lambda w: ~F.array_contains(stop, canonical_word(w)))


def entity_tokens(query) -> Column:
    return F.array_distinct(F.transform(entity_words(query), canonical_word))


def quoted_phrases(query) -> Column:
    c = col(query)
    double = F.regexp_extract_all(c, F.lit('"([^"]{8,})"'), F.lit(1))
    single = F.filter(
        F.regexp_extract_all(c, F.lit("'([^']{8,})'"), F.lit(1)), lambda p: F.length(p) - F.length(F.replace(p, F.lit(" "))) >= 2)
    kept = F.filter(F.concat(double, single), lambda p: ~is_blank(p))
    return F.array_distinct(F.transform(kept, search_norm))


def is_role_query(query) -> Column:
    return any_of(F.lower(col(query)), lists.ROLE_QUERY_WORDS)


def is_description_query(query) -> Column:
    opening = strip(F.lower(col(query))).rlike("^(?:" + "|".join(lists.ENTITY_QUESTION_STARTS) + ")")
    return opening | (is_role_query(query) & (F.size(entity_tokens(query)) > 0))


def is_multi_part(query) -> Column:
    lowered = F.lower(col(query))
    return (
        any_of(lowered, lists.MULTI_PART_JOINTS + lists.MULTI_PART_NOUNS)
        | (lowered.contains(" and ") & (F.size(search_tokens(search_norm(query))) >= 10))
    )


def query_variants(query) -> Column:
    """The query, its parts, and entity-centred forms, distinct and in order."""
    subject = F.trim(F.array_join(F.slice(entity_words(query), 1, 2), " "))
    return let(subject, lambda bound: _variants(col(query), bound))


def _variants(c: Column, subject: Column) -> Column:
    has_subject = F.length(subject) > 0
    parts = F.filter(
        F.transform(F.split(c, r"(?iU)\s+and\s+", -1), lambda p: strip_chars(p, " ,.?")), lambda p: F.length(p) > 0)
    with_subject = F.flatten(F.transform(parts, lambda p: F.when(
        has_subject & ~F.contains(F.lower(p), F.lower(subject)),
        F.array(p, F.concat(subject, F.lit(" "), p))).otherwise(F.array(p))))
    none = F.array().cast("array<string>")
    split_up = F.when(is_multi_part(c), with_subject).otherwise(none)
    described = F.when(
        is_description_query(c) & has_subject,
        F.when(is_role_query(c), F.array(
            subject, F.concat(subject, F.lit(" responsibilities")), F.concat(subject, F.lit(" role in the house")),
        )).otherwise(F.array(subject)),
    ).otherwise(none)
    return F.array_distinct(F.filter(F.concat(F.array(strip(c)), split_up, described), lambda v: F.length(v) > 0))


def expanded_terms(query, direct_terms, synonyms: dict[str, str] | None = None) -> Column:
    """Synonyms and cue terms of a query, without its direct terms and stop words."""
    table = lists.QUERY_SYNONYMS if synonyms is None else synonyms
    lookup = F.from_json(F.lit(json.dumps({k: v.split() for k, v in table.items()})), "map<string,array<string>>")
    none = F.array().cast("array<string>")
    direct = col(direct_terms)
    lowered = F.lower(col(query))
    parts = [F.flatten(F.transform(direct, lambda t: F.coalesce(F.try_element_at(lookup, t), none)))]
    cues = [(is_role_query(query), [*lists.ROLE_CUES, *lists.ROLE_QUERY_EXTRA.split()]),
            (is_description_query(query), [*lists.DESCRIPTION_CUES, *lists.DESCRIPTION_QUERY_EXTRA.split()])]
    cues += [(any_of(lowered, hints), terms.split()) for hints, terms in lists.QUERY_CUE_EXPANSIONS]
    parts += [F.when(test, words(terms)).otherwise(none) for test, terms in cues]
    unwanted = F.array_union(words(lists.SEARCH_STOPWORDS), direct)
    return F.filter(F.array_except(F.concat(*parts), unwanted), lambda t: F.length(t) > 1)


# -- sentences ------------------------------------------------------------------------

SENTENCE_BREAK = r"(?U)(?<=[.!?])\s+|;\s+"


def sentences(x, min_chars: int = 1) -> Column:
    parts = F.transform(F.split(col(x), SENTENCE_BREAK, -1), squeeze)
    return F.filter(parts, lambda s: F.length(s) >= min_chars)


#: Characters of a window: of a pair of sentences at most, of any at least.
WINDOW_MOST, WINDOW_LEAST = 420, 30


def sentence_windows(x, max_chars: int = WINDOW_MOST, min_chars: int = WINDOW_LEAST) -> Column:
    """Each sentence, and each sentence joined to its successor while the pair is short."""
    return let(sentences(x), lambda parts: _windows(parts, max_chars, min_chars))


def _windows(parts: Column, max_chars: int, min_chars: int) -> Column:

    def both(sentence, index):
        pair = F.concat(sentence, F.lit(" "), F.get(parts, index + 1))
        return F.when(F.length(pair) <= max_chars, F.array(sentence, pair)).otherwise(F.array(sentence))

    return F.filter(F.array_distinct(F.flatten(F.transform(parts, both))), lambda w: F.length(w) >= min_chars)


def quoted_segments(x) -> Column:
    """Contents of straight or curly double quotes, trimmed of marks."""
    found = F.regexp_extract_all(col(x), F.lit('["“”](.*?)["“”]'), F.lit(1))
    return F.filter(F.transform(found, lambda s: squeeze(strip_chars(s, " ,;:-"))), lambda s: F.length(s) > 0)


def quoted_content(x) -> Column:
    return squeeze(F.array_join(quoted_segments(x), " "))


# -- grading and history terms --------------------------------------------------------------

def grading_norm(x) -> Column:
    spaced = F.regexp_replace(F.lower(compat_form(x)), r"(?U)([.!?;:,])(?=[^\s])", "$1 ")
    return squeeze(F.regexp_replace(spaced, r"(?U)[^a-z0-9\s]", " "))


def content_terms(x, stopwords=lists.GRADING_STOPWORDS) -> Column:
    """Singular forms of the content words, as a set."""
    c = grading_norm(x)
    for pattern, stem in ((r"(?<![^ ])([^ ]{2,})ies(?![^ ])", "$1y"),
                          (r"(?<![^ ])([^ ]{2,}[^ s])es(?![^ ])", "$1"),
                          (r"(?<![^ ])([^ ]{3,}[^ s])s(?![^ ])", "$1")):
        c = F.regexp_replace(c, pattern, stem)
    for word, replacement in lists.TOKEN_OVERRIDES:
        c = F.regexp_replace(c, f"(?<![^ ]){word}(?![^ ])", replacement)
    return F.filter(F.array_except(F.split(c, " "), words(stopwords)), lambda t: F.length(t) > 1)


def history_norm(x) -> Column:
    return F.lower(squeeze(F.coalesce(col(x), F.lit(""))))


def history_terms(x, stopwords=lists.HISTORY_STOPWORDS) -> Column:
    stop = words(stopwords)
    raw = F.transform(F.regexp_extract_all(F.lower(col(x)), F.lit(r"[a-z0-9+#._-]{2,}"), F.lit(0)),
                      lambda t: strip_chars(t, "._-"))
    kept = F.array_except(raw, F.array_append(stop, F.lit("")))

    def stem(t):
        n = F.length(t)
        cut = lambda k: F.substring(t, F.lit(1), n - k)
        return (F.when(t.endswith("ing") & (n > 6), cut(3))
                .when(t.endswith("ed") & (n > 5), cut(2))
                .when(t.endswith("es") & (n > 5), cut(2))
                .when(t.endswith("s") & (n > 4) & ~t.endswith("ss"), cut(1))
                .otherwise(t))

    return F.array_except(F.transform(kept, stem), F.array_append(stop, F.lit("")))


# -- set measures ----------------------------------------------------------------------------

def overlap(a, b) -> Column:
    return F.size(F.array_intersect(col(a), col(b)))


def ratio(part: Column, whole: Column) -> Column:
    """part / max(whole, 1)"""
    return part.cast("double") / F.greatest(whole, F.lit(1))


def jaccard(a, b) -> Column:
    a, b = col(a), col(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        ratio(overlap(a, b), F.size(F.array_union(a, b))))


# -- titles, names, mail -------------------------------------------------------------------------

def is_default_title(title) -> Column:
    t = F.lower(squeeze(F.coalesce(col(title), F.lit(""))))
    return (t == "new chat") | t.startswith("new chat ") | t.startswith("learning session ")


def title_from_message(message, limit: int = 60) -> Column:
    return shorten(F.array_join(F.slice(F.split(squeeze(message), " "), 1, 10), " "), limit)


def title_from_attachments(attachments) -> Column:
    """``attachments`` is an array of structs with ``name`` and ``kind``."""
    a = col(attachments)
    first = F.get(a, F.lit(0))
    kind = F.coalesce(F.nullif(strip(first["kind"]), F.lit("")), F.lit("file"))
    return (F.when(F.size(a) < 1, "").when(F.size(a) == 1, F.concat(F.initcap(kind), F.lit(": "), first["name"]))
            .otherwise(F.array_join(F.transform(F.slice(a, 1, 2), lambda x: x["name"]), ", ")))


def email_norm(x) -> Column:
    return F.lower(strip(x))


def email_valid(x) -> Column:
    e = email_norm(x)
    return e.contains("@") & ~e.startswith("@") & ~e.endswith("@")


def display_name(name, email) -> Column:
    given = strip(F.coalesce(col(name), F.lit("")))
    local = squeeze(F.translate(F.substring_index(col(email), "@", 1), "._-", "   "))
    # every run of letters starts with a capital, digits and apostrophes end a run
    titled = F.array_join(F.transform(F.regexp_extract_all(F.lower(local), F.lit(r"(?U)\p{L}+|\P{L}+"), F.lit(0)),
                                      F.initcap), "")
    made = F.when(F.length(local) > 0, titled).otherwise(F.lit("User"))
    return F.substring(F.when(F.length(given) > 0, given).otherwise(made), 1, 255)


def initials(name) -> Column:
    parts = F.filter(F.split(squeeze(name), " "), lambda p: F.length(p) > 0)
    letters = F.array_join(F.transform(F.slice(parts, 1, 2), lambda p: F.upper(F.substring(p, 1, 1))), "")
    return F.when(F.size(parts) == 0, F.lit("U")).otherwise(letters)


# -- vectors ---------------------------------------------------------------------------------------

def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda s, v: s + v)


def cosine(a, b) -> Column:
    a, b = col(a), col(b)
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(_dot(a, b) / norms)


def squared_distance(a, b) -> Column:
    gaps = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v * v)


def relevance(distance) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.greatest(col(distance), F.lit(0.0)))
