"""Content policy: five rule-based categories over a text and its purpose.

Each phrase list is one alternation, so a clean text costs a few scans and no
array work. Exact phrase labels are only built for texts that are flagged.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import policy_lists as P
from .text import any_of, col, let, quote, squeeze

FINDING = "struct<category:string,reason:string,confidence:double>"


def phrase_pattern(phrases) -> str:
    """One alternation for whole-phrase hits; a phrase with a leading dot is a plain substring."""
    whole = [quote(p) for p in phrases if not p.startswith(".")]
    parts = [quote(p) for p in phrases if p.startswith(".")]
    if whole:
        parts.append(r"\b(?:" + "|".join(whole) + r")\b")
    return "|".join(parts)


def has_phrase(normalized, phrases) -> Column:
    # the first letter is looked at before the word border, which costs far more in Unicode
    initials = "".join(sorted({quote(p[0]) for p in phrases}))
    return col(normalized).rlike(f"(?U)(?=[{initials}])(?:{phrase_pattern(phrases)})")


def phrase_hits(normalized, phrases) -> Column:
    """Every phrase that occurs, sorted. Overlapping phrases all count."""
    table = json.dumps([{"label": p, "pattern": "(?U)" + phrase_pattern([p])} for p in sorted(phrases)])
    pairs = F.from_json(F.lit(table), "array<struct<label:string,pattern:string>>")
    return F.transform(F.filter(pairs, lambda p: F.rlike(col(normalized), p["pattern"])), lambda p: p["label"])


def _label(hits: Column) -> Column:
    return F.array_join(F.slice(hits, 1, 2), ", ")


def matches(text, patterns) -> Column:
    hit = F.lit(False)
    for p in patterns:
        flags = "(?iU)" if not p.startswith("(?m)") else "(?imU)"
        hit = hit | col(text).rlike(flags + p.removeprefix("(?m)"))
    return hit


def secret_literal(text) -> Column:
    """First literal secret, trying the patterns in order; null when there is none."""
    c = col(text)
    return F.coalesce(*[F.nullif(F.regexp_extract(c, "(?iU)" + p, 0), F.lit("")) for p in P.SECRET_PATTERNS])


def secret_preview(literal) -> Column:
    c = col(literal)
    return F.when(F.length(c) > 12, F.concat(F.substring(c, 1, 8), F.lit("..."))).otherwise(c)


def is_educational(n) -> Column:
    return col(n).rlike("^(?:" + "|".join(P.EDUCATIONAL_STARTS) + ")") | any_of(n, P.EDUCATIONAL_HINTS)


def is_creative(n) -> Column:
    return has_phrase(n, P.CREATIVE_VERBS) & has_phrase(n, P.CREATIVE_NOUNS)


def is_direct(n) -> Column:
    return ~col(n).rlike("^(?:" + "|".join(P.EDUCATIONAL_STARTS) + ")") & any_of(n, P.DIRECT_REQUESTS)


def is_artifact(n) -> Column:
    return any_of(n, P.ARTIFACT_PHRASES)


def _finding(category: str, reason, confidence) -> Column:
    wrap = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(F.lit(category).alias("category"), wrap(reason).alias("reason"),
                    wrap(confidence).cast("double").alias("confidence"))


def _self_harm(n, t, purpose: str) -> Column:
    lesson = is_educational(n) & ~is_direct(n)
    trio = has_phrase(n, P.MEANS_HINTS) & has_phrase(n, P.METHOD_ASK_HINTS)
    method = matches(n, P.HARM_METHOD_PATTERNS) | (trio & has_phrase(n, P.BODY_HINTS))
    mixed = trio & has_phrase(n, P.DISTRESS_HINTS)
    mixed_finding = _finding(
        "self_harm", "The request combines distress, available means, and a request for harmful instructions", 0.97)
    if purpose == "model_output":
        shaped = matches(t, P.LIST_SHAPE_PATTERNS) & (
            matches(n, P.OUTPUT_METHOD_PATTERNS)
            | (has_phrase(n, P.OUTPUT_HINTS) & has_phrase(n, P.OUTPUT_DANGER_HINTS)))
        return (F.when(lesson, F.lit(None)).when(mixed, mixed_finding)
                .when(shaped, _finding(
                    "self_harm", "The generated response contains actionable self-harm instructions", 0.94)))
    return (
        F.when(lesson, F.lit(None))
        .when(matches(n, P.EXPLICIT_HARM_PATTERNS), _finding(
            "self_harm", "The request indicates possible self-harm intent or asks for self-harm methods", 0.99))
        .when(method, _finding("self_harm", "The request asks for actionable self-harm method instructions", 0.98))
        .when(is_creative(n), F.lit(None))
        .when(mixed, mixed_finding)
    )


def _sensitive_data(n, t, purpose: str) -> Column:
    literal = secret_literal(t)
    targets = phrase_hits(n, P.SECRET_TARGETS)
    access = phrase_hits(n, P.ACCESS_ACTIONS)
    actions = F.when(F.size(access) > 0, access).otherwise(phrase_hits(n, P.EXFILTRATION_HINTS))
    real = has_phrase(n, P.REAL_TARGETS)
    asked = has_phrase(n, P.SECRET_TARGETS) & has_phrase(n, P.ACCESS_ACTIONS + P.EXFILTRATION_HINTS)
    excused = (is_educational(n) & ~is_direct(n)) | (
        is_creative(n) & ~has_phrase(n, P.INSTRUCTIONAL_HINTS) & ~real)
    if purpose in ("generated_content", "model_output"):
        excused = excused | (~has_phrase(n, P.SYSTEM_SECRET_TARGETS) & ~real)
    strong = real | has_phrase(n, [".env", "environment variables"])
    return (
        F.when(literal.isNotNull(), _finding(
            "sensitive_data",
            F.concat(F.lit("The content includes a real secret or private identifier ("), secret_preview(literal),
                     F.lit(").")), 0.99))
        .when(asked & ~excused, _finding(
            "sensitive_data",
            F.concat(F.lit("The request asks to "), _label(actions), F.lit(" real sensitive data such as "),
                     _label(targets)),
            F.when(strong, 0.9).otherwise(0.82)))
    )


def _prompt_injection(n, t, purpose: str) -> Column:
    internal = has_phrase(n, P.INTERNAL_TARGETS)
    exposing = internal & has_phrase(n, P.ACCESS_ACTIONS)
    override = matches(n, P.OVERRIDE_PATTERNS)
    guarded = has_phrase(n, P.GUARDRAIL_TARGETS)
    excused = (is_educational(n) & ~is_direct(n)) | (is_creative(n) & ~has_phrase(n, P.INSTRUCTIONAL_HINTS))
    if purpose in ("generated_content", "model_output"):
        excused = excused | (override & ~internal & ~guarded)
    barrier = F.coalesce(F.nullif(_label(phrase_hits(n, P.GUARDRAIL_TARGETS)), F.lit("")),
                         F.lit("the assistant safeguards"))
    return (
        F.when(~(override | exposing) | excused, F.lit(None))
        .when(exposing, _finding(
            "prompt_injection",
            F.concat(F.lit("The request tries to expose hidden system data such as "),
                     _label(phrase_hits(n, P.INTERNAL_TARGETS))), 0.92))
        .otherwise(_finding(
            "prompt_injection", F.concat(F.lit("The request attempts to override or disable "), barrier), 0.84))
    )


def _security_bypass(n, t, purpose: str) -> Column:
    steps = has_phrase(n, P.INSTRUCTIONAL_HINTS)
    real = has_phrase(n, P.REAL_TARGETS)
    excused = (is_educational(n) & ~(steps | is_direct(n))) | (is_creative(n) & ~steps)
    strong = real | has_phrase(n, ["bypass auth", "bypass authentication"])
    return F.when(
        has_phrase(n, P.BYPASS_TERMS) & ~excused & (steps | real | is_direct(n)),
        _finding("security_bypass",
                 F.concat(F.lit("The request asks for help bypassing or exploiting "),
                          _label(phrase_hits(n, P.BYPASS_TERMS))),
                 F.when(strong, 0.9).otherwise(0.8)))


def _malicious_action(n, t, purpose: str) -> Column:
    build = has_phrase(n, P.BUILD_HINTS)
    steps = has_phrase(n, P.INSTRUCTIONAL_HINTS)
    excused = (is_educational(n) & ~(build | steps)) | (is_creative(n) & ~steps & ~is_artifact(n))
    return F.when(
        has_phrase(n, P.MALICIOUS_TERMS) & ~excused & (build | steps | is_direct(n)),
        _finding("malicious_action",
                 F.concat(F.lit("The request asks for actionable assistance with "),
                          _label(phrase_hits(n, P.MALICIOUS_TERMS))),
                 F.when(is_artifact(n), 0.9).otherwise(0.82)))


RULES = {"self_harm": _self_harm, "sensitive_data": _sensitive_data, "prompt_injection": _prompt_injection,
         "security_bypass": _security_bypass, "malicious_action": _malicious_action}
MIN_CONFIDENCE = 0.75


def with_policy(df: DataFrame, text: str, purpose: str, out: str = "decision") -> DataFrame:
    """Add ``out``: struct<blocked, categories, findings, confidence> for one text column.

    Findings keep category order; confidence is the highest of them.
    """
    return df.withColumn(out, policy_decision(text, purpose))


def policy_decision(text, purpose: str) -> Column:
    """The decision as one expression: the normal form and the findings are each bound once."""
    allowed = P.PURPOSE_CATEGORIES.get(purpose, P.PURPOSE_CATEGORIES["user_query"])
    t = F.coalesce(col(text), F.lit(""))
    none = F.array().cast(f"array<{FINDING}>")

    def findings(n):
        found = F.array(*[RULES[c](n, t, purpose).cast(FINDING) for c in P.CATEGORY_ORDER if c in allowed])
        kept = F.filter(found, lambda x: x.isNotNull() & (x["confidence"] >= MIN_CONFIDENCE))
        return F.when(F.length(n) == 0, none).otherwise(kept)

    def decide(f):
        return F.struct(
            (F.size(f) > 0).alias("blocked"),
            F.array_distinct(F.transform(f, lambda x: x["category"])).alias("categories"),
            f.alias("findings"),
            F.coalesce(F.array_max(F.transform(f, lambda x: x["confidence"])), F.lit(0.0)).alias("confidence"))

    return let(F.lower(squeeze(t)), lambda n: let(findings(n), decide))


def is_blocked(df: DataFrame, text: str, purpose: str, out: str = "blocked") -> DataFrame:
    return df.withColumn(out, policy_decision(text, purpose)["blocked"])


def refusal_message(decision) -> Column:
    d = col(decision)
    first = F.get(d["categories"], F.lit(0))
    base = F.coalesce(*[F.when(first == c, F.lit(m)) for c, m in P.CATEGORY_MESSAGES.items()], F.lit(P.BLOCKED_TEXT))
    detail = F.regexp_replace(F.get(d["findings"], F.lit(0))["reason"], r"\.+$", "")
    return F.when((F.size(d["categories"]) == 0) | (first == "self_harm"), base).otherwise(
        F.concat(base, F.lit(" "), detail, F.lit(".")))


def is_refusal(x) -> Column:
    n = squeeze(F.coalesce(col(x), F.lit("")))
    hit = F.lit(False)
    for message in P.CATEGORY_MESSAGES.values():
        base = " ".join(message.split())
        hit = hit | (n == base) | n.startswith(base + " ")
    return hit
