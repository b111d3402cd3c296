"""Page cleanup rules as column expressions (order matters)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lists
from .text import col, let, quote, strip, words

_ANY = "(?U)"


def light_clean(x) -> Column:
    c = F.regexp_replace(col(x), r"(?U)https?://\S+", "")
    return strip(F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), "[ \t]{2,}", " "))


def plain_punctuation(x) -> Column:
    """Curly quotes, dashes and hard blanks to ASCII; damage and soft hyphens dropped."""
    return F.translate(col(x), "‘’“”–—\u00a0\ufffd\ufffe\u00ad", "''\"\"-- ")


def join_breaks(x) -> Column:
    c = F.regexp_replace(col(x), "(?U)([a-zA-Z])[-~\u00ad]\\s*\n\\s*([a-z])", "$1$2")
    return F.regexp_replace(c, r"(?U)([a-z])~\s*([a-z])", "$1$2")


def split_glued(x) -> Column:
    c = col(x)
    for pattern, flags in ((lists.PREPOSITION_GLUE, "(?iU)"), (lists.SUBJECT_GLUE, "(?iU)"),
                           (lists.CAMEL_GLUE, "(?U)"), (lists.QUANTITY_GLUE, "(?iU)"),
                           (lists.TRAILING_OF_GLUE, "(?U)")):
        c = F.regexp_replace(c, flags + pattern, "$1 $2")
    return c


def drop_cap_across_lines(x) -> Column:
    """``Africa`` / ``rica`` over a line end: the tail repeats the end of the word."""
    pattern = r"(?U)\b([A-Z][a-zA-Z]*?([a-zA-Z]{3,}))\s*\n\s*(?=[a-z])((?i:\2))\b"
    return F.regexp_replace(col(x), pattern, "$1")


def drop_cap_inline(x) -> Column:
    return F.regexp_replace(col(x), r"(?U)\b([A-Z]([a-z]{3,}))\s+\2\b", "$1")


def space_after_marks(x) -> Column:
    c = F.regexp_replace(col(x), r"([.!?])([A-Z][a-z])", "$1 $2")
    return F.regexp_replace(c, r",([a-zA-Z])", ", $1")


def _lines(x) -> Column:
    return F.split(col(x), "\n", -1)


def merge_spaced_letters(x) -> Column:
    def fix(line):
        s = strip(line)
        return F.when(s.rlike(r"(?U)^[A-Z](\s+[A-Z]){1,12}$"), F.replace(s, F.lit(" "))).otherwise(line)
    c = col(x)
    return F.when(c.rlike(r"(?mU)^\s*[A-Z]\s+[A-Z]"), F.array_join(F.transform(_lines(c), fix), "\n")).otherwise(c)


def collapse_repeats(x) -> Column:
    """Drop a line equal to the line right before it; a blank line starts afresh."""
    def keep(pairs):
        bare = lambda i: F.get(pairs, i)["bare"]
        kept = F.filter(pairs, lambda p, i: (p["bare"] == "") | (i == 0) | (p["bare"] != bare(i - 1)))
        return F.array_join(F.transform(kept, lambda p: p["line"]), "\n")
    return let(F.transform(_lines(x), lambda s: F.struct(s.alias("line"), strip(s).alias("bare"))), keep)


def is_noise_line(line) -> Column:
    return let(strip(line), lambda s: (F.length(s) > 0) & (
        s.rlike(r"(?U)^[\W_]+$|^\d{1,4}$") | s.rlike(r"^[a-zA-Z0-9]{1,2}$")
        | s.rlike(r"""(?U)^[|{}()\[\]<>/\\!?*+=\-_~`^"'.,;:\s]{0,4}$""")))


def drop_noise_lines(x) -> Column:
    kept = F.filter(_lines(x), lambda s: ~is_noise_line(s))
    blanked = F.transform(kept, lambda s: F.when(strip(s) == "", F.lit("")).otherwise(s))
    return strip(F.regexp_replace(F.array_join(blanked, "\n"), "\n{3,}", "\n\n"))


STEPS = (plain_punctuation, join_breaks, drop_cap_across_lines, split_glued, drop_cap_inline, space_after_marks,
         merge_spaced_letters, collapse_repeats, drop_noise_lines)


def heavy_clean(x, steps=STEPS) -> Column:
    """All text-only cleanup steps for one page, in order."""
    c = col(x)
    for step in steps:
        c = let(c, step)
    return c


def is_bad_extraction(x) -> Column:
    """Whether extracted text looks broken and another reading of the page is wanted."""
    text = strip(F.coalesce(col(x), F.lit("")))

    def judged(s):
        count = lambda part: F.length(s) - F.length(F.replace(s, F.lit(part)))
        letters = F.length(s) - F.length(F.regexp_replace(s, r"[a-zA-Z\p{L}]+", ""))
        lines = F.filter(F.transform(F.split(s, "\n", -1), strip), lambda v: v != "")
        few = lambda own: F.size(F.filter(own, lambda v: F.length(v) <= 2)).cast("double")
        short = F.sort_array(F.regexp_extract_all(s, F.lit(r"(?U)\b\w{1,3}\b"), F.lit(0)))

        def monotonous(own):
            # in sorted order a word that is more than half of all stands in the middle
            middle = F.get(own, F.floor(F.size(own) / 2).cast("int"))
            top = F.size(own) - F.size(F.array_remove(own, middle))
            return F.when(F.size(own) >= 20, (top > 12) & (top / F.size(own) > 0.5)).otherwise(False)

        return (
            F.when(F.length(s) < 30, True)
            .when((count("\ufffd") > 3) | (count("\u00ad") > 8), True)
            .when(letters / F.length(s) < 0.4, True)
            .when(let(lines, lambda own: (F.size(own) >= 8) & (few(own) / F.size(own) > 0.35)), True)
            .otherwise(let(short, monotonous)))

    return let(text, judged)


# -- lines ---------------------------------------------------------------------------------

def is_boilerplate(line, patterns=lists.BOILERPLATE_LINES, credits=lists.CREDIT_MARKS) -> Column:
    return let(strip(line), lambda s: _is_furniture(s, patterns, credits))


def _has_choice(pattern: str) -> bool:
    """Whether a pattern may have alternatives outside of groups."""
    bare = re.sub(r"\\.", "", pattern)
    while (inner := re.sub(r"\([^()]*\)", "", bare)) != bare:
        bare = inner
    return "|" in bare


def _is_furniture(s: Column, patterns, credits) -> Column:
    hit = s.rlike("(?iU)" + lists.MAP_COORDINATE)
    if credits:
        initials = "".join(sorted({quote(m[0]) for m in credits if m}))
        hit = hit | s.rlike(("" if "" in credits else f"(?=[{initials}])") + "(?:" + "|".join(quote(m) for m in credits) + ")")
    for flags, own in (("(?U)", [p for p, ignore in patterns if not ignore]), ("(?iU)", [p for p, ignore in patterns if ignore])):
        # a pattern that begins with its anchor is tried once, an alternative with one at every place
        opening = [p for p in own if p.startswith("^") and not _has_choice(p)]
        others = [p for p in own if p not in opening]
        if opening:
            hit = hit | s.rlike(f"{flags}^(?:" + "|".join(f"(?:{p[1:]})" for p in opening) + ")")
        if others:
            hit = hit | s.rlike(flags + "|".join(f"(?:{p})" for p in others))
    kept = F.lit(False)
    for start in lists.KEPT_LINE_STARTS:
        kept = kept | s.startswith(start)
    return (F.length(s) > 0) & ~kept & hit


def is_heading(line) -> Column:
    return let(strip(line), _reads_like_heading)


def _reads_like_heading(s: Column) -> Column:
    tokens = F.regexp_extract_all(s, F.lit(r"(?U)[A-Za-z][\w'-]*"), F.lit(0))
    fillers = words(lists.HEADING_FILLERS)
    solid = F.filter(tokens, lambda w: ~F.array_contains(fillers, F.lower(w)))
    capped = F.filter(solid, lambda w: w.rlike("^[A-Z]"))
    all_caps = s.rlike(r"\p{Lu}") & ~s.rlike(r"\p{Ll}") & (F.length(s) <= 50)
    return (
        (F.length(s) > 0) & (F.length(s) <= 64) & ~s.rlike(r"""[.,;?"']$""")
        & F.size(tokens).between(1, 8)
        & (all_caps | ((F.size(solid) > 0) & (F.size(capped) == F.size(solid))))
    )


def tagged_line(line) -> Column:
    c = col(line)
    return let(strip(c), lambda s: _tagged(c, s))


def _tagged(c: Column, s: Column) -> Column:
    return (
        F.when((s == "") | s.rlike(lists.TAGGED_LINE), c)
        .when(s.rlike("(?U)" + lists.NUMBERED_QUESTION), F.concat(F.lit("[Review Question] "), s))
        .when(s.rlike("(?iU)" + lists.FIGURE_CAPTION) | s.rlike("(?iU)" + lists.TABLE_CAPTION),
              F.concat(F.lit("[Caption] "), s))
        .when(s.rlike("(?iU)" + lists.MAP_OR_TEXTBOX), F.concat(F.lit("[Map/Textbox] "), s))
        .otherwise(c)
    )


# -- captions ------------------------------------------------------------------------------

def _flat(x) -> Column:
    return strip(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"(?U)\s+", " "))


def is_caption_refusal(x) -> Column:
    return _flat(x).rlike("(?isU)" + lists.CAPTION_REFUSAL)


def caption_without_echo(x) -> Column:
    c = _flat(x)
    for pattern in (lists.CAPTION_PROMPT_ECHO, lists.CAPTION_CHECKLIST_ECHO):
        c = strip(F.regexp_replace(c, "(?iU)" + pattern, ""))

    def behind(s):
        lead = F.when(s.rlike(r"(?iU)(?:The|This) image\b"), F.regexp_extract(s, r"(?iU)^(.*?)(?:The|This) image\b", 1)).otherwise("")
        return let(lead, lambda v: F.when(_echoes(v), strip(F.substr(s, F.length(v) + 1))).otherwise(s))

    return let(c, behind)


def _echoes(lead: Column) -> Column:
    echoed = F.lit(False)
    for token in lists.CAPTION_ECHO_TOKENS:
        echoed = echoed | F.lower(lead).contains(token)
    return (F.length(lead) > 0) & echoed


def caption_clean(x) -> Column:
    """Keep the description part of a caption that shows its working."""
    return let(strip(F.replace(F.coalesce(col(x), F.lit("")), F.lit("\r"))), _described)


def _described(original: Column) -> Column:
    c = F.regexp_replace(original, r"(?iU)^\s*thinking process:\s*", "")
    c = F.regexp_replace(c, r"(?iU)^\s*here(?:'s| is)\s+a\s+thinking\s+process.*?:\s*", "")
    c = let(c, lambda t: F.when(t.rlike("(?iU)" + lists.CAPTION_MARKER), F.regexp_replace(
        F.regexp_replace(t, "(?isU)^.*?" + lists.CAPTION_MARKER, ""), r"^[ :*\-]+", "")).otherwise(t))

    def tidy(line):
        s = F.regexp_replace(strip(line), r"(?U)^(?:[-*]\s*)+", "")
        s = strip(F.replace(s, F.lit("**")))
        s = F.regexp_replace(s, r"(?iU)^\((?:Section by Section|Initial Scan & Context)\)\s*:\s*", "")
        return F.regexp_replace(s, "(?iU)" + lists.CAPTION_TITLE_LABEL, "Title: ")

    filled = F.filter(F.split(c, "\n", -1), lambda s: strip(s) != "")
    kept = F.filter(F.transform(filled, tidy), lambda s: ~s.rlike("(?iU)" + lists.CAPTION_STEP)
                    & ~s.rlike("(?iU)" + lists.CAPTION_NOISE))
    trim_marks = lambda t: F.regexp_replace(t, r"^[ :\-]+|[ :\-]+$", "")
    body = trim_marks(F.regexp_replace(F.array_join(kept, " "), r"(?U)\s+", " "))
    parts = F.struct(body.alias("body"), strip(F.regexp_replace(original, r"(?U)\s+", " ")).alias("flat"))
    return F.when(original == "", F.lit("")).otherwise(let(parts, lambda p: _with_fallback(p["body"], p["flat"])))


def _with_fallback(body: Column, flat: Column) -> Column:
    """Title and first image sentence where too little of the caption is left."""
    trim_marks = lambda t: F.regexp_replace(t, r"^[ :\-]+|[ :\-]+$", "")
    title = F.regexp_replace(strip(F.regexp_extract(flat, "(?iU)" + lists.CAPTION_TITLE, 1)), r"^[ .:\-]+|[ .:\-]+$", "")
    image = trim_marks(F.regexp_extract(flat, "(?iU)" + lists.CAPTION_IMAGE_SENTENCE, 1))
    bits = F.filter(F.array(
        F.when(title != "", F.concat(F.lit("Title: "), title, F.lit("."))),
        F.when(image != "", F.concat(F.regexp_replace(image, r"\.+$", ""), F.lit("."))),
    ), lambda b: b.isNotNull())
    weak = (F.length(body) < 48) | body.rlike("(?iU)" + lists.CAPTION_NOISE)
    second = F.when(weak, let(bits, lambda b: F.when(F.size(b) > 0, F.array_join(b, " ")).otherwise(body))).otherwise(body)
    tail = lambda: F.regexp_extract(flat, "(?iU)" + lists.CAPTION_IMAGE_TAIL, 1)
    return let(second, lambda t: F.when((F.length(t) < 48) & (tail() != ""), trim_marks(tail())).otherwise(t))
